"""Files from a folder or a table: globs, text checks and changes."""

from __future__ import annotations

import re
import subprocess
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.constants import EXCLUDED_GLOBS
from tessera.functions.text import is_binary


def glob_pattern(glob: str) -> str:
    """A glob as a regular expression over whole paths; one without a slash fits any file of that name."""
    if "/" not in glob:
        glob = "**/" + glob
    out, at = "", 0
    while at < len(glob):
        if glob.startswith("**/", at):
            out, at = out + "(?:[^/]+/)*", at + 3
        elif glob.startswith("/**", at) and at + 3 == len(glob):
            out, at = out + "/.*", at + 3
        elif glob[at] == "*":
            out, at = out + "[^/]*", at + 1
        elif glob[at] == "?":
            out, at = out + "[^/]", at + 1
        else:
            out, at = out + re.escape(glob[at]), at + 1
    return f"^{out}$"


def glob_filter(path: Column, globs: Sequence[str] = ()) -> Column:
    """Included by the caller's globs where there are such, by none of the caller's exclusions (``!``) nor the built-in ones."""
    include = [glob_pattern(g) for g in globs if not g.startswith("!")]
    exclude = [glob_pattern(g[1:]) for g in globs if g.startswith("!")] + [glob_pattern(g) for g in EXCLUDED_GLOBS]
    wanted = path.rlike("|".join(include)) if include else F.lit(True)
    return wanted & ~path.rlike("|".join(exclude))


def ignore_pattern(rule: str) -> str:
    """An ignore rule as a regular expression over paths: with a slash before its end it holds from the root, else anywhere; what is below an ignored folder is ignored."""
    folder = rule.endswith("/")
    bare = rule.strip("/") if folder else rule.lstrip("/")
    anchored = "/" in rule.rstrip("/")
    body = glob_pattern(bare if anchored or "/" in bare else "**/" + bare)[1:-1]
    return f"^{body}{'/.*' if folder else '(?:/.*)?'}$"


def visible(path: Column, rules: Sequence[str] = ()) -> Column:
    """Not hidden, and not ignored: of the rules that fit a path the last one decides, ``!`` brings it back; empty ones and comments say nothing."""
    ignored = F.lit(False)
    for rule in rules:
        rule = rule.strip()
        if rule and not rule.startswith("#"):
            back = rule.startswith("!")
            ignored = F.when(path.rlike(ignore_pattern(rule[back:])), F.lit(not back)).otherwise(ignored)
    return ~path.rlike(r"(^|/)\.") & ~ignored


def untracked_changes(files: DataFrame, most_bytes: int | None = 64_000) -> DataFrame:
    """``path, whole_file, start_line, end_line, text`` of files (``path, content``) that no commit has: changed as a whole.

    Of the text the first ``most_bytes`` bytes are read; where these are no UTF-8, or end inside a character, or the
    content is null, it is empty. Without a bound it is the whole text, and null stays null.
    """
    head = F.col("content") if most_bytes is None else F.substring("content", 1, most_bytes)
    text = F.coalesce(F.try_validate_utf8(head.cast("string")), F.lit(""))
    if most_bytes is None:
        text = F.when(F.col("content").isNotNull(), text)
    return files.select("path", F.lit(True).alias("whole_file"), F.lit(1).alias("start_line"), F.lit(2**31 - 1).alias("end_line"), text.alias("text"))


def all_changes(tracked: DataFrame, untracked: DataFrame) -> DataFrame:
    """The hunks of tracked files (``path, start_line, end_line, text``) and the untracked files, in one table."""
    return tracked.select("path", F.lit(False).alias("whole_file"), "start_line", "end_line", "text").unionByName(untracked)


def read_text_files(spark: SparkSession, root: str, globs: Sequence[str] = (), max_bytes: int = 512_000) -> DataFrame:
    """``path, bytes, line_count, lines`` of the text files under ``root``: not too long, no NUL early on, valid UTF-8."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = spark._jvm.org.apache.hadoop.fs.Path(root).toUri().getPath().rstrip("/")
    path = F.expr(f"regexp_replace(path, '^.*?{re.escape(base)}/', '')")
    found = raw.where(F.col("length") <= max_bytes).withColumn("path", path).where(glob_filter(F.col("path"), globs) & ~is_binary(F.col("path")))
    text = F.try_validate_utf8(F.col("content").cast("string"))
    found = found.where(F.locate("\0", F.substring("content", 1, 8192).cast("string")) == 0).withColumn("text", text).where("text is not null")
    split = F.transform(F.split("text", "\n"), lambda x: F.regexp_replace(x, "\r$", ""))
    return found.select("path", F.col("length").alias("bytes"), F.size(split).alias("line_count"), split.alias("lines"), "text")


def diff_hunks(diff: DataFrame) -> DataFrame:
    """``file, start_line, end_line, added`` from ``line_no, line`` of a unified diff (and a ``diff_id``).

    A header line counts only outside a hunk's body, so added text that looks like one is text. A hunk that
    only deletes has no range.
    """
    header = F.regexp_extract("line", r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@", 1)
    size = F.regexp_extract("line", r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@", 2)
    rows = diff.groupBy("diff_id").agg(F.array_sort(F.collect_list(F.struct("line_no", F.col("line"), F.when(header != "", header.cast("int")).alias("start"), F.when(size != "", size.cast("int")).otherwise(1).alias("count")))).alias("rows"))
    empty = F.expr("named_struct('file', cast(null as string), 'left', 0, 'out', cast(array() as array<struct<file:string,start_line:int,end_line:int>>))")

    def step(state, row):
        inside = state["left"] > 0
        names = ~inside & row["line"].startswith("+++ b/")
        file = F.when(names, F.substring(row["line"], 7, 1_000_000)).otherwise(state["file"])
        left = F.when(inside & row["line"].startswith("+"), state["left"] - 1).when(row["start"].isNotNull() & ~inside, row["count"]).otherwise(state["left"])
        hunk = F.struct(state["file"].alias("file"), row["start"].alias("start_line"), (row["start"] + row["count"] - 1).alias("end_line"))
        out = F.when(~inside & row["start"].isNotNull() & (row["count"] > 0), F.concat(state["out"], F.array(hunk))).otherwise(state["out"])
        return F.struct(file.alias("file"), left.alias("left"), out.alias("out"))

    done = rows.select("diff_id", F.explode(F.aggregate("rows", empty, step)["out"]).alias("hunk"))
    return done.select("diff_id", "hunk.file", "hunk.start_line", "hunk.end_line")


def git_changes(spark: SparkSession, folder: str, base: str = "HEAD") -> DataFrame:
    """``file, start_line, end_line`` of the lines that differ from ``base``, from the local git program."""
    command = ["git", "--no-optional-locks", "-C", folder, "-c", "core.quotepath=off", "diff", "--unified=0", "--diff-filter=ACMR", "--src-prefix=a/", "--dst-prefix=b/", base]
    text = subprocess.run(command, capture_output=True, text=True, check=True).stdout
    rows = [(0, i, line) for i, line in enumerate(text.split("\n"))]
    return diff_hunks(spark.createDataFrame(rows, "diff_id int, line_no int, line string")).drop("diff_id")
