"""The operators as stages of a corpus pipeline: each takes (spark, docs, sf_dir) and returns documents.

All but the last return the columns of their input; rows may go, and texts may change.
"""

from __future__ import annotations

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm import jaccard, mixing, packing, suffix_dedup, toxicity
from tessera.llm.common import cut, frugal, slices, text_bytes
from tessera.llm.membership import bitmap, maybe
from tessera.sources.tables import table

THRESHOLD = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose toxicity score is below the threshold; the model learns from the labelled ones among ``docs``.

    Null, empty and wordless texts score 0 and stay, rows without an id are scored like others, repeated rows alike;
    an empty table stays empty. Every column is kept, whatever its name.
    """
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"))

    def run(batches):
        for part in slices(batches):
            keep = pa.array(model.scores(text_bytes(part.column("text"))) < THRESHOLD)
            yield part.filter(keep)

    return docs.mapInArrow(frugal(run), docs.schema)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id; of rows that repeat an id and a text one.

    Documents without words, and those without an id, stay. An id with several texts goes when all their groups
    have a smaller one; otherwise all its texts stay. An empty table stays empty.
    """
    groups = cut(jaccard.jaccard_components(docs))
    known = groups.where("doc_id is not null")
    several = known.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), F.sum((F.col("doc_id") != F.col("component_id")).cast("int")).alias("others"))
    gone = cut(several.where("others = rows").select("doc_id"))
    twice = cut(several.where("rows > 1 and others < rows").select("doc_id"))
    flagged = maybe(docs, "doc_id", bitmap(gone.union(twice), "doc_id")).withColumn("__maybe", F.col("__maybe") & F.col("doc_id").isNotNull())
    looked_at = flagged.where("__maybe").drop("__maybe").join(gone, "doc_id", "left_anti")
    copy = F.row_number().over(Window.partitionBy("doc_id", "text").orderBy(F.to_json(F.struct(*docs.columns))))
    looked_at = looked_at.withColumn("__copy", copy).where("__copy = 1")
    return flagged.where("not __maybe").drop("__maybe").select(docs.columns).union(looked_at.select(docs.columns))


def drop_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without the strings that repeat; a document that is all repeats keeps its row, with an empty text."""
    return suffix_dedup.without_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes: a row for a document's words that are taken, another for those taken twice.

    Runs of words are kept as they stand and joined by line feeds. Documents of which nothing is taken go. A
    document's words stay together, whichever shards its blocks were drawn for.
    """
    sized = cut(mixing.sized_documents(docs))
    plan = mixing.source_plan(sized)
    if not plan.sources:
        return docs
    blocks = mixing.mix_blocks(sized, plan, sized.count())
    item = F.struct("first", "last", F.size("places").alias("times"))
    taken = blocks.groupBy(*(F.col(c).alias(f"__of_{c}") for c in mixing.ROW)).agg(F.collect_list(item).alias("__blocks"))
    numbered = docs.withColumn("__key", F.xxhash64("text")).withColumn("__copy", F.lit(1))
    if not sized.where("copy > 1").isEmpty():  # rows that repeat an id and a text are told apart as above
        own = F.row_number().over(Window.partitionBy("doc_id", "__key").orderBy("source"))
        numbered = numbered.withColumn("__copy", own)
    joined = numbered.join(taken, F.col("doc_id").eqNullSafe(F.col("__of_doc_id")) & (F.col("__key") == F.col("__of_key")) & (F.col("__copy") == F.col("__of_copy")))
    names = docs.columns

    def run(batches):
        for part in slices(batches):
            rows, texts = [], []
            for i, (text, own) in enumerate(zip(text_bytes(part.column("text")), part.column("__blocks").to_pylist(), strict=True)):
                for times in (1, 2):
                    kept = taken_text(text, [(b["first"], b["last"]) for b in own if b["times"] >= times])
                    if kept:
                        rows.append(i)
                        texts.append(kept.decode())
            if rows:
                picked = part.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == "text" else picked.column(c) for c in names], names)

    mixed = joined.select(*names, "__blocks").mapInArrow(frugal(run), docs.schema)
    if "n_chars" in names:
        mixed = mixed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cut(mixed.select(names))  # written with small Arrow batches: rows that are taken twice carry their text


def taken_text(text: bytes, ranges: list[tuple[int, int]]) -> bytes:
    """The text from the first word to the last of each range of word numbers; ranges that meet are one."""
    runs: list[list[int]] = []
    for first, last in sorted(ranges):
        if runs and first <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], last)
        else:
            runs.append([first, last])
    if not runs:
        return b""
    white = jaccard.WHITE[np.frombuffer(text, np.uint8)]
    begin = np.flatnonzero(~white & np.r_[True, white[:-1]])
    end = np.flatnonzero(~white & np.r_[white[1:], True]) + 1
    return b"\n".join(text[begin[a] : end[b - 1]] for a, b in runs if a < b)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document, and its place in a sequence."""
    return packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"))
