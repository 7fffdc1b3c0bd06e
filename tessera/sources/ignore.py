"""Ignore files of every folder: each path is held against the rules of all folders above it, the deepest first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import file_name

# Fixed names of ignore files, the stronger one last.
IGNORE_FILES = (".gitignore", ".ignore")


def rule_pattern(rule: Column) -> Column:
    """A rule (without ``!``) as a regular expression over paths relative to its folder; with a slash inside it holds from there, else at any depth."""
    bare = F.regexp_replace(F.regexp_replace(rule, "/+$", ""), r"^\\(?=[#!])", "")
    anchored = bare.contains("/")
    body = F.regexp_replace(F.regexp_replace(bare, "^/+", ""), r"([.+^$(){}|\\])", r"\\$1")
    for mark, meaning in ((r"\[!", "[^"), (r"\*\*/", "\u0001"), (r"/\*\*$", "\u0002"), (r"\*+", "[^/]*"), (r"\?", "[^/]"), ("\u0001", "(?:[^/]+/)*"), ("\u0002", "/.+")):
        body = F.regexp_replace(body, mark, F.lit(meaning))
    return F.concat(F.lit("^"), F.when(anchored, "").otherwise("(?:[^/]+/)*"), body, F.lit("$"))


def ignore_rules(files: DataFrame) -> DataFrame:
    """``folder, number, back, folders_only, pattern``: the rules in the ignore files among ``files`` (``path, text``); blank lines and comments are none."""
    name = file_name(F.col("path"))
    own = files.where(name.isin(*IGNORE_FILES)).select(F.regexp_replace("path", "/?[^/]*$", "").alias("folder"), F.array_position(F.array(*map(F.lit, IGNORE_FILES)), name).alias("kind"), F.posexplode(F.split("text", "\r?\n")).alias("line", "raw"))
    rules = own.withColumn("rule", F.regexp_replace("raw", r"(?<!\\)[ \t]+$", "")).where("rule <> '' and rule not like '#%'")
    return compiled(rules.select("folder", (F.col("kind") * 1_000_000_000 + F.col("line")).alias("number"), "rule"))


def compiled(rules: DataFrame) -> DataFrame:
    """Rules (``folder, number, rule``; the root is ``''``) ready to be matched."""
    back = F.col("rule").startswith("!")
    bare = F.when(back, F.substring(F.col("rule"), F.lit(2), F.char_length("rule"))).otherwise(F.col("rule"))
    return rules.select("folder", F.col("number").cast("long").alias("number"), back.alias("back"), bare.endswith("/").alias("folders_only"), rule_pattern(bare).alias("pattern"))


def ignored_entries(entries: DataFrame, rules: DataFrame) -> DataFrame:
    """Those of the ``entries`` (``entry, is_folder``) that the last fitting rule of the deepest folder ignores."""
    names = F.split("entry", "/")
    above = entries.select("entry", "is_folder", F.explode(F.sequence(F.lit(0), F.size(names) - 1)).alias("depth"))
    above = above.select("entry", "is_folder", "depth", F.array_join(F.slice(names, F.lit(1), F.col("depth")), "/").alias("folder"), F.array_join(F.slice(names, F.col("depth") + 1, F.size(names)), "/").alias("rest"))
    met = above.join(rules, "folder").where((~F.col("folders_only") | F.col("is_folder")) & F.rlike(F.col("rest"), F.col("pattern")))
    last = met.groupBy("entry", "is_folder").agg(F.max_by("back", F.struct("depth", "number")).alias("back"))
    return last.where(~F.col("back")).select("entry", "is_folder")


def visible_files(files: DataFrame, rules: DataFrame) -> DataFrame:
    """``files`` (``path``) without hidden ones (a name that begins with a dot) and without those that a rule ignores, or a folder of theirs.

    Nothing below an ignored folder comes back. Folders are decided once, however many files are below.
    """
    shown = files.where(~F.col("path").rlike(r"(^|/)\."))
    names = F.split("path", "/")
    parts = shown.select("path").distinct().select("path", F.size(names).alias("n"), F.explode(F.sequence(F.lit(1), F.size(names))).alias("k"), names.alias("names"))
    parts = parts.select("path", F.array_join(F.slice("names", F.lit(1), F.col("k")), "/").alias("entry"), (F.col("k") < F.col("n")).alias("is_folder"))
    ignored = ignored_entries(parts.select("entry", "is_folder").distinct(), rules)
    hidden = parts.join(ignored, ["entry", "is_folder"], "left_semi").select("path").distinct()
    return shown.join(hidden, "path", "left_anti")
