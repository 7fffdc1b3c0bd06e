"""Retrieval by words and by meaning together: an index of blocks, the nearest to the question, and their fusion."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.constants import DENSE_TOP
from tessera.operators import dense_index
from tessera.plans.retrieve import Change, Options, Retrieved, retrieved
from tessera.sources.files import glob_filter

Embed = Callable[[list[str]], list[list[float]]]


@dataclass(frozen=True)
class Index:
    """How blocks are embedded: ``embed`` gives a vector a text and runs on the workers; ``cache`` is a shared folder for vectors of ``model``.

    ``max_files`` and ``max_blocks`` are the engine's bounds; ``None`` lifts them.
    """

    embed: Embed
    model: str = "default"
    cache: str | None = None
    max_files: int | None = dense_index.INDEX_FILES
    max_blocks: int | None = dense_index.INDEX_BLOCKS
    keep: int = DENSE_TOP


def indexed_blocks(files: DataFrame, index: Index, options: Options = Options()) -> DataFrame:
    """The blocks of the files that the globs allow, within the index's bounds."""
    wanted = dense_index.listed_files(files.where(glob_filter(F.col("path"), options.globs)), index.max_files)
    return dense_index.index_blocks(wanted, index.max_blocks, by_definition=options.by_definition)


def recalled(files: DataFrame, question: str, index: Index, options: Options = Options()) -> DataFrame:
    """``query_id, path, start_line, end_line, similarity, rank``: the blocks nearest to the question, ``keep`` of them."""
    vectors = dense_index.with_vectors(indexed_blocks(files, index, options), index.embed, index.model, index.cache)
    (query,) = index.embed([question])
    return dense_index.recall(vectors, query, index.keep).withColumn("query_id", F.lit(0).cast("long"))


def retrieved_by_meaning(files: DataFrame, question: str, index: Index, options: Options = Options(), change: Change | None = None, expansion: tuple[str, ...] = ()) -> Retrieved:
    """As :func:`tessera.plans.retrieve.retrieved`, with what is near to the question in meaning.

    The recalled blocks, ``keep`` at most, are kept: they are read several times, and the index is not built again.
    """
    near = recalled(files, question, index, options).drop("rank").persist()
    return retrieved(files, question, options, change, expansion=expansion, dense_hits=near)
