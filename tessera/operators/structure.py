"""Structure of text files: blocks around a line, windows, merged ranges and their token counts."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.constants import BLOCK_LINES, ENVELOPE_TOKENS, GAP_LINES, WINDOW_LINES
from tessera.functions.text import estimate_tokens, is_annotation, is_continuation, line_indent


def line_tokens(lines: DataFrame) -> DataFrame:
    """``path, line_no, line, tok, cum``: tokens of the numbered line, and of all lines up to it.

    Line ends break runs, so counts add up over lines and a range costs two lookups.
    """
    tok = estimate_tokens(F.concat(F.col("line_no").cast("string"), F.lit(": "), F.col("line")))
    upto = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("tok", tok).withColumn("cum", F.sum("tok").over(upto))


def range_tokens(ranges: DataFrame, tokens: DataFrame) -> DataFrame:
    """``ranges`` (``path, start_line, end_line``) with the tokens that delivering them takes.

    Two lookups in the running sums, however long a range is; a range that ends after its file goes to the end.
    """
    sums = tokens.select("path", "line_no", "cum", (F.col("cum") - F.col("tok")).alias("before"))
    ends = tokens.groupBy("path").agg(F.max("line_no").alias("last"))
    asked = ranges.join(ends, "path").where("start_line <= last and start_line <= end_line").withColumn("upto", F.least("end_line", "last"))
    low = sums.select("path", F.col("line_no").alias("start_line"), "before")
    high = sums.select("path", F.col("line_no").alias("upto"), "cum")
    found = asked.join(low, ["path", "start_line"]).join(high, ["path", "upto"]).withColumn("content_tokens", F.col("cum") - F.col("before"))
    return found.select("path", "start_line", "end_line", "content_tokens", (F.col("content_tokens") + estimate_tokens(F.col("path")) + ENVELOPE_TOKENS).alias("tokens"))


def fixed_windows(lines: DataFrame, span: int = WINDOW_LINES) -> DataFrame:
    """Windows of a fixed number of lines that are not all blank: ``path, start_line, end_line``."""
    width = max(1, min(span, WINDOW_LINES))
    window = F.floor((F.col("line_no") - 1) / width)
    blank = ~F.col("line").rlike(r"[^\p{IsWhite_Space}]")
    grouped = lines.groupBy("path", window.alias("w")).agg(F.min("line_no").alias("start_line"), F.max("line_no").alias("end_line"), F.min(blank.cast("int")).alias("blank"))
    return grouped.where("blank = 0").select("path", "start_line", "end_line")


def block_bounds(indents: list[int | None], continues: list[bool], notes: list[bool], asked: list[int], max_span: int = BLOCK_LINES) -> list[tuple[int, int] | None]:
    """The block (first and last line, from 1) around each of the ``asked`` lines of a file, or None.

    One pass finds for every line with text the nearest earlier one with less indent (its header) and the nearest
    later one with no more (where a block that it heads has ended); a header's signature is looked for once.
    """
    n = len(indents)
    header, ended, before = [-1] * n, [n] * n, [-1] * (n + 1)
    less: list[int] = []  # lines with text of growing indent
    for i, indent in enumerate(indents):
        before[i + 1] = before[i]
        if indent is None:
            continue
        before[i + 1] = i
        while less and indents[less[-1]] >= indent:
            ended[less.pop()] = i
        header[i] = less[-1] if less else -1
        less.append(i)
    starts: dict[int, int] = {}

    def start_of(head: int) -> int:
        if head not in starts:
            at, indent = head, indents[head]
            if continues[head]:
                while at > 0 and head - at < max_span and indents[at - 1] is not None and indents[at - 1] >= indent:
                    at -= 1
            while at > 0 and head - at < max_span and indents[at - 1] == indent and notes[at - 1]:
                at -= 1
            starts[head] = at
        return starts[head]

    out: list[tuple[int, int] | None] = []
    for line in asked:
        i = line - 1
        if not 0 <= i < n or indents[i] is None or header[i] < 0:
            out.append(None)
            continue
        # Text between the header and the line is at least as deep as the line, so the header's end is the block's.
        first, last = start_of(header[i]), before[ended[header[i]]]
        out.append((first + 1, last + 1) if last - first < max_span else None)
    return out


def enclosing_block(lines: DataFrame, hits: DataFrame, max_span: int = BLOCK_LINES) -> DataFrame:
    """``path, line_no, start_line, end_line`` of the block around each hit; nulls where there is none.

    The header is the nearest line before the hit, not blank, with less indent; the block goes on to the last line
    that is deeper than the header. A header that only continues a signature takes in the unbroken run of lines
    above that are no less indented; then notes right above at the header's own indent come in. A hit without
    indent, or a block of more than ``max_span`` lines, has none. A file with hits is one row of short arrays.
    """
    asked = hits.groupBy("path").agg(F.collect_set("line_no").alias("asked"))
    shape = lines.join(asked.select("path"), "path", "left_semi").select("path", F.struct(F.col("line_no").alias("no"), line_indent(F.col("line")).cast("int").alias("indent"), is_continuation(F.col("line")).alias("continues"), is_annotation(F.col("line")).alias("notes")).alias("s"))
    files = shape.groupBy("path").agg(F.array_sort(F.collect_list("s")).alias("s")).join(asked, "path")
    files = files.select("path", "asked", *[F.col("s").getField(c).alias(c) for c in ("indent", "continues", "notes")])

    def run(batches):
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for path, numbers, *shapes in zip(*(batch.column(c).to_pylist() for c in ("path", "asked", "indent", "continues", "notes")), strict=True):
                for number, found in zip(numbers, block_bounds(*shapes, numbers, max_span), strict=True):
                    for column, value in zip(out, (path, number, *(found or (None, None))), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, (pa.string(), pa.int32(), pa.int32(), pa.int32()), strict=True)], ["path", "line_no", "start_line", "end_line"])

    return files.mapInArrow(run, "path string, line_no int, start_line int, end_line int")


def merge_with_gap(ranges: DataFrame, gap: int = GAP_LINES, by: Sequence[str] = ("path",)) -> DataFrame:
    """Ranges of a path (``by``) that are at most ``gap`` lines apart become one."""
    order = Window.partitionBy(*by).orderBy("start_line", "end_line")
    before = F.max("end_line").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(before.isNull() | (F.col("start_line") > before + gap + 1), 1).otherwise(0)
    islands = ranges.withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(order))
    return islands.groupBy(*by, "island").agg(F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line")).drop("island")
