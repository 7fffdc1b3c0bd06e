"""Repositories as Spark data sources: the text files of a folder tree, and what is changed in a work tree.

The folder has to be one that all executors see. Files are opened step by step below the root, never through a
link, and measured before and after reading.
"""

from __future__ import annotations

import os
import re
import stat
import subprocess
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tessera.functions.constants import DIFF_TEXT
from tessera.plans.retrieve import Change

#: Bytes in which a NUL marks a file as binary, and bytes of text of an untracked file.
EARLY, UNTRACKED_BYTES = 8192, 64_000
#: Paths that a task reads where they are named.
NAMED = 64


@dataclass(frozen=True)
class Limits:
    """Bounds of what is read: larger files are left out, more files or bytes in all are an error."""

    max_files: int = 30
    max_file_bytes: int = 512_000
    max_total_bytes: int = 2_000_000


def relative_parts(root: str, path: str) -> tuple[str, ...]:
    """The names of a path below ``root``; an error where it leads out."""
    if os.path.isabs(path):
        if os.path.commonpath([root, path]) != root:
            raise ValueError(f"path escapes the working folder: {path}")
        path = os.path.relpath(path, root) if path != root else ""
    parts = tuple(p for p in path.split("/") if p not in ("", "."))
    if not parts or ".." in parts:
        raise ValueError(f"path escapes the working folder: {path}")
    return parts


def open_below(root: str, parts: Sequence[str]) -> int:
    """A descriptor of the file, each folder and the file itself opened without following links."""
    plain = os.O_RDONLY | os.O_CLOEXEC | os.O_NOFOLLOW
    at = os.open(root, os.O_RDONLY | os.O_CLOEXEC | os.O_DIRECTORY)
    for i, name in enumerate(parts):
        try:
            # A pipe would wait for a writer.
            following = os.open(name, plain | (os.O_NONBLOCK if i + 1 == len(parts) else os.O_DIRECTORY), dir_fd=at)
        finally:
            os.close(at)
        at = following
    return at


def read_below(root: str, parts: Sequence[str], most: int) -> bytes | None:
    """The content of a regular file; None if it is too long, an error if it changes while it is read."""
    descriptor = open_below(root, parts)
    before = os.fstat(descriptor)
    if not stat.S_ISREG(before.st_mode):
        os.close(descriptor)
        raise ValueError(f"path is not a regular file: {'/'.join(parts)}")
    with os.fdopen(descriptor, "rb") as file:
        if before.st_size > most:
            return None
        content = file.read(most + 1)
        after = os.fstat(descriptor)
    if len(content) > most:
        return None
    seen = [(s.st_dev, s.st_ino, s.st_size, s.st_mtime_ns) for s in (before, after)]
    if seen[0] != seen[1] or len(content) != after.st_size:
        raise ValueError(f"file changed while being read: {'/'.join(parts)}")
    return content


def text_row(parts: Sequence[str], content: bytes | None) -> tuple | None:
    """``path, bytes, line_count, text``; None for what is too long, binary or no UTF-8."""
    if content is None or b"\0" in content[:EARLY]:
        return None
    try:
        text = content.decode()
    except UnicodeDecodeError:
        return None
    return "/".join(parts), len(content), text.count("\n") + 1, text


@dataclass
class Part(InputPartition):
    """A folder, with or without what is below it, or some named files."""

    folder: tuple[str, ...] = ()
    deep: bool = True
    named: tuple[tuple[str, ...], ...] | None = None


class RepositoryFiles(DataSource):
    """``spark.read.format("repository").load(root)``: ``path, bytes, line_count, text`` of every text file below ``root``.

    Options: ``max_file_bytes``, ``depth`` (folders down to it are partitions of their own), ``hidden`` (``true``
    also reads names that begin with a dot), ``named`` (named files instead, a line each; each has to be there and
    regular). Links are not followed. Files that are too long, hold a NUL early on or are no UTF-8 are left out.
    """

    @classmethod
    def name(cls) -> str:
        return "repository"

    def schema(self) -> str:
        return "path string, bytes long, line_count int, text string"

    def reader(self, schema) -> DataSourceReader:
        return RepositoryReader(dict(self.options))


class RepositoryReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        options = {k.lower(): v for k, v in options.items()}
        self.root = os.path.realpath(options["path"])
        self.most = int(options.get("max_file_bytes", Limits.max_file_bytes))
        self.depth, self.hidden = int(options.get("depth", 2)), options.get("hidden", "false").lower() == "true"
        self.paths = options["named"].split("\n") if "named" in options else None

    def partitions(self) -> list[Part]:
        if self.paths is not None:
            named = list(dict.fromkeys(relative_parts(self.root, p) for p in self.paths))
            return [Part(named=tuple(named[i : i + NAMED])) for i in range(0, len(named), NAMED)] or [Part(named=())]
        if not os.path.isdir(self.root):
            raise ValueError(f"no such folder: {self.root}")
        found, level = [], [()]
        for depth in range(self.depth + 1):
            last = depth == self.depth
            found += [Part(folder, last) for folder in level]
            level = [] if last else [(*folder, e.name) for folder in level for e in self.entries(folder) if e.is_dir(follow_symlinks=False)]
        return found

    def entries(self, folder: tuple[str, ...]) -> list[os.DirEntry]:
        with os.scandir(os.path.join(self.root, *folder)) as entries:
            return sorted((e for e in entries if self.hidden or not e.name.startswith(".")), key=lambda e: e.name)

    def read(self, partition: Part) -> Iterator[tuple]:
        if partition.named is not None:
            rows = (text_row(parts, read_below(self.root, parts, self.most)) for parts in partition.named)
        else:
            rows = self.below(partition.folder, partition.deep)
        return (row for row in rows if row is not None)

    def below(self, folder: tuple[str, ...], deep: bool) -> Iterator[tuple | None]:
        for entry in self.entries(folder):
            parts = (*folder, entry.name)
            if entry.is_file(follow_symlinks=False):
                yield text_row(parts, read_below(self.root, parts, self.most))
            elif deep and entry.is_dir(follow_symlinks=False):
                yield from self.below(parts, True)


def git(folder: str, *arguments: str) -> bytes:
    """What the git program prints, in a form that settings of the user do not change; an error with its message."""
    fixed = ["git", "--no-optional-locks", "-C", folder, "-c", "diff.noprefix=false", "-c", "diff.mnemonicprefix=false", "-c", "core.quotepath=false"]
    done = subprocess.run([*fixed, *arguments], capture_output=True, check=False)
    if done.returncode:
        raise ValueError(f"git {arguments[0]} failed: {done.stderr.decode(errors='replace').strip()}")
    return done.stdout


def hunks(diff: str) -> Iterator[tuple]:
    """``path, whole_file, start_line, end_line, text`` of every hunk of a diff without context; a file that only loses lines has a row without lines.

    The lines of a hunk are counted, so that added text which looks like a header stays text.
    """
    path, held, left = None, 0, 0
    row: list = []
    for line in diff.split("\n"):
        if left:
            left -= not line.startswith("\\")  # a remark that the file does not end with a line break
            if line.startswith("+"):
                row[-1] += line[1:] + "\n"
            if not left and row[2] is not None:  # a hunk that only deletes has no lines
                yield tuple(row)
                held += 1
            continue
        if line.startswith("diff --git "):
            if path is not None and not held:
                yield path, False, None, None, ""
            path, held = None, 0
        elif line.startswith("+++ "):
            path = line[6:].rstrip("\t") if line.startswith("+++ b/") else None
        elif (found := re.match(r"@@ -\d+(?:,(\d+))? \+(\d+)(?:,(\d+))? @@", line)) and path is not None:
            gone, start, new = (1 if n is None else int(n) for n in found.groups())
            row, left = [path, False, start if new else None, start + new - 1 if new else None, ""], gone + new
    if path is not None and not held:
        yield path, False, None, None, ""


def untracked_text(root: str, parts: Sequence[str], most: int = UNTRACKED_BYTES) -> str:
    """The start of a file that no commit has; empty where it cannot be read, is no UTF-8 or is cut inside a character."""
    try:
        with os.fdopen(open_below(root, parts), "rb") as file:
            return file.read(most).decode() if stat.S_ISREG(os.fstat(file.fileno()).st_mode) else ""
    except (OSError, UnicodeDecodeError):
        return ""


class WorkTreeChanges(DataSource):
    """``spark.read.format("changes").option("base", "HEAD").load(folder)``: ``path, whole_file, start_line, end_line, text``.

    A row for each hunk of lines that differ from ``base`` (added, copied, changed or renamed files; paths are relative
    to ``folder``), with its added text; and one for each untracked file that no ignore rule hides, changed as a whole.
    Without commits, or with a base that is not known, there are untracked files only.
    """

    @classmethod
    def name(cls) -> str:
        return "changes"

    def schema(self) -> str:
        return "path string, whole_file boolean, start_line int, end_line int, text string"

    def reader(self, schema) -> DataSourceReader:
        options = {k.lower(): v for k, v in self.options.items()}
        return ChangesReader(os.path.realpath(options["path"]), options.get("base", "HEAD"))


class ChangesReader(DataSourceReader):
    def __init__(self, folder: str, base: str):
        self.folder, self.base = folder, base

    def partitions(self) -> list[Part]:
        listed = git(self.folder, "ls-files", "--others", "--exclude-standard", "-z").decode(errors="surrogateescape")
        named = [tuple(p.split("/")) for p in listed.split("\0") if p]
        return [Part(), *(Part(named=tuple(named[i : i + NAMED])) for i in range(0, len(named), NAMED))]

    def read(self, partition: Part) -> Iterator[tuple]:
        if partition.named is not None:
            for parts in partition.named:
                yield "/".join(parts).encode(errors="replace").decode(), True, 1, 2**31 - 1, untracked_text(self.folder, parts)
            return
        try:
            diff = git(self.folder, "diff", "--no-color", "--no-ext-diff", "--unified=0", "--diff-filter=ACMR", "--relative", "--end-of-options", self.base, "--")
        except ValueError as error:
            if any(known in str(error) for known in ("unknown revision", "bad revision", "ambiguous argument")):
                return
            raise
        yield from hunks(diff.decode(errors="replace"))


def register(spark: SparkSession) -> None:
    """The formats ``repository`` and ``changes`` for this session."""
    spark.dataSource.register(RepositoryFiles)
    spark.dataSource.register(WorkTreeChanges)


def repository_files(spark: SparkSession, root: str, **options: str) -> DataFrame:
    """The files below ``root`` as :func:`tessera.plans.retrieve.retrieved` takes them; ``doc_id`` is a hash of the path."""
    register(spark)
    rows = spark.read.format("repository").options(**options).load(root)
    return rows.select("path", F.xxhash64("path").alias("doc_id"), "text", "bytes", "line_count")


def load_documents(spark: SparkSession, root: str, paths: Sequence[str], limits: Limits = Limits()) -> DataFrame:
    """``path, bytes, line_count, numbered_content, allowed_ranges`` of named files.

    No path at all, more than the bound, one that leads out of ``root``, through a link or to no regular file, one that
    changes meanwhile, and more bytes in all than the bound are errors. A path that is named twice counts once.
    """
    if not paths:
        raise ValueError("at least one path is required")
    if len(paths) > limits.max_files:
        raise ValueError(f"too many files: {len(paths)} exceeds {limits.max_files}")
    rows = repository_files(spark, root, named="\n".join(paths), max_file_bytes=str(limits.max_file_bytes)).persist()
    total = rows.agg(F.sum("bytes")).first()[0] or 0
    if total > limits.max_total_bytes:
        raise ValueError(f"input exceeds the aggregate limit of {limits.max_total_bytes} bytes")
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.concat((i + 1).cast("string"), F.lit(": "), F.regexp_replace(x, "\r$", "")))
    whole = F.array(F.struct(F.lit(1).alias("start_line"), F.col("line_count").alias("end_line")))
    return rows.select("path", "bytes", "line_count", F.array_join(lines, "\n").alias("numbered_content"), whole.alias("allowed_ranges"))


def work_tree_change(spark: SparkSession, folder: str, base: str = "HEAD") -> Change:
    """The change to search in, from a work tree: its ranges, paths and text (``DIFF_TEXT`` characters); none is an error."""
    register(spark)
    rows = spark.read.format("changes").option("base", base).load(folder).persist()
    first = rows.groupBy("path").agg(F.min("whole_file").alias("later"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start_line", "text"))), lambda x: x["text"]), "").alias("text"))
    # Paths and the start of each text; what a person changed in a work tree.
    found = first.select("path", F.substring("text", 1, DIFF_TEXT).alias("text")).orderBy("later", "path").collect()
    if not found:
        raise ValueError(f"no local changes against {base}: nothing to search in")
    return Change(rows.drop("text"), tuple(r["path"] for r in found), "\n".join(r["text"] for r in found)[:DIFF_TEXT])
