"""Mixing sources to target weights by a low-discrepancy schedule.

Each source's documents are shuffled (by a hash of the id) into one stream of words that
is cut in blocks of equal size, the last one shorter.  A source's quota is the number of
slots that reach its target, whole blocks in stream order, pass after pass; its last slot
takes only the words still due, so every source gives its target to the word.  Slot ``i``
of the schedule draws the point ``frac(i * golden ratio)``, in exact 64-bit arithmetic;
mapped through the cumulative quotas it names a source, and the slot takes that source's
next block.  Draws beyond a source's quota, a few for each source, go in order to the
sources that are short of theirs.  Golden-ratio points leave every source within a few
slots of its share at any moment, so the mix is even in every prefix, and a rerun gives the
same mix.

Targets: the sources, by code point and null last, weigh as told; they share a multiple
of all words; no target exceeds a multiple of its source's words, the excess is shared
again by weight.

Defined results: null text has no words; documents without words are in no block; a null
source is a source; repeated rows are documents of their own; an empty table gives an empty
mix; a very long text is cut in blocks like any other; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .chunks import CHUNKS_PER_PARTITION, partitions
from .common import WORD, checkpointed, streamed

#: 2**64 divided by the golden ratio, made odd.
GOLDEN = 0x9E3779B97F4A7C15
_SLOTS_PER_TASK = 1 << 14


@dataclass(frozen=True)
class Source:
    index: int
    name: str | None
    words: int
    target: float


@dataclass(frozen=True)
class Plan:
    """Targets and block size of a mix.  It holds one entry per source, and ``plan`` refuses more than ``max_sources``."""

    sources: tuple[Source, ...]
    block_words: int
    most: float

    @property
    def wanted(self) -> list[int]:
        """Words that each source gives: its target, at least one where it has a target and words."""
        return [min(int(self.most * s.words), max(1, round(s.target))) if s.target > 0 else 0 for s in self.sources]

    @property
    def quotas(self) -> list[int]:
        """Slots of each source: all blocks for each whole pass, and those that the rest of its words begins in."""
        size = self.block_words
        return [w // s.words * -(-s.words // size) + -(-(w % s.words) // size) if w else 0 for w, s in zip(self.wanted, self.sources, strict=True)]

    @property
    def slots(self) -> int:
        return sum(self.quotas)


def targets(sizes: Sequence[int], weights: Sequence[float], total: float, most: float) -> list[float]:
    """Share ``total`` by weight; what exceeds ``most * size`` goes to the others by weight, until none is above."""
    out = [0.0] * len(sizes)
    open_, left = set(range(len(sizes))), total
    while open_:
        unit = left / sum(weights[i] for i in open_)
        full = {i for i in open_ if unit * weights[i] >= most * sizes[i]}
        if not full:
            for i in open_:
                out[i] = unit * weights[i]
            break
        for i in full:
            out[i] = most * sizes[i]
            left -= out[i]
        open_ -= full
    return out


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def plan(sizes: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, block_words: int = 256, max_sources: int = 100_000) -> Plan:
    """Targets for rows of (source, size), of which there is one entry at the driver: more than ``max_sources`` raise an error."""
    found = sizes.groupBy("source").agg(F.sum("size").alias("words")).limit(max_sources + 1).collect()
    if len(found) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    found.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    words = [int(r["words"] or 0) for r in found]
    goal = targets(words, [weights[i % len(weights)] for i in range(len(found))], share * sum(words), most)
    return Plan(tuple(Source(i, r["source"], w, t) for i, (r, w, t) in enumerate(zip(found, words, goal, strict=True))), block_words, most)


def source_table(spark: SparkSession, p: Plan) -> DataFrame:
    """One row per source, bounded by the plan's limit."""
    return spark.createDataFrame([(s.index, s.name, s.words, s.target) for s in p.sources], "source_index int, source_name string, source_size long, target double")


def schedule(spark: SparkSession, p: Plan) -> DataFrame:
    """The mix: rows (slot, source_index, rank, block, upto).

    Ranks count a source's slots; a slot takes the words of its block that are before
    ``upto`` in the source's stream.  Tasks first count the sources of their own slots, the
    counts are summed in order, and the same slots are made again with ranks.  Slots drawn
    beyond a quota, a few for each source, are collected and handed to the sources that
    are short of as many.
    """
    n, sources = p.slots, len(p.sources)
    quota, wanted, words = (np.array(x, np.int64) for x in (p.quotas, p.wanted, [s.words for s in p.sources]))
    edges = np.array([min((c << 64) // n, 2**64 - 1) for c in np.cumsum(quota).tolist()] if n else [], np.uint64)
    blocks = np.maximum(1, -(-words // p.block_words))
    tasks = spark.range(0, -(-n // _SLOTS_PER_TASK), 1, max(1, min(partitions(spark.range(1)), -(-n // _SLOTS_PER_TASK)))).withColumnRenamed("id", "task")

    def ranked(given: np.ndarray, to: np.ndarray, over: bool) -> tuple[DataFrame, DataFrame]:
        """Slots by task and source, and the slots with ranks, or only those ``over`` a quota; the ``given`` slots go to other sources."""

        def drawn(task: int) -> tuple[np.ndarray, np.ndarray]:
            low, high = task * _SLOTS_PER_TASK, min(n, (task + 1) * _SLOTS_PER_TASK)
            slots = np.arange(low, high, dtype=np.uint64)
            at = np.minimum(np.searchsorted(edges, slots * np.uint64(GOLDEN), "right"), sources - 1)
            i, j = np.searchsorted(given, [low, high])
            at[given[i:j] - low] = to[i:j]
            return slots.astype(np.int64), at

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for task in batch.column(0).to_pylist():
                    found, k = np.unique(drawn(task)[1], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), task, np.int64)), pa.array(found.astype(np.int32)), pa.array(k.astype(np.int64))], ["task", "source_index", "n"])

        def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    slots, at = drawn(row["task"])
                    first = np.zeros(sources, np.int64)
                    for s in row["starts"]:
                        first[s["source_index"]] = s["before"]
                    order = np.argsort(at, kind="stable")
                    run = np.diff(np.flatnonzero(np.r_[True, np.diff(at[order]) != 0, True])) if len(order) else np.zeros(0, np.int64)
                    within = np.empty(len(at), np.int64)
                    within[order] = np.arange(len(at)) - np.repeat(np.cumsum(run) - run, run)
                    ranks = first[at] + within
                    block = ranks % blocks[at]
                    upto = np.minimum(np.minimum((block + 1) * p.block_words, words[at]), wanted[at] - ranks // blocks[at] * words[at])
                    ok = (ranks >= quota[at]) == over
                    yield pa.RecordBatch.from_arrays([pa.array(x[ok]) for x in (slots, at.astype(np.int32), ranks, block, upto)], ["slot", "source_index", "rank", "block", "upto"])

        counts = tasks.mapInArrow(streamed(count), "task long, source_index int, n long")
        before = F.sum("n").over(Window.partitionBy("source_index").orderBy("task")) - F.col("n")
        starts = counts.withColumn("before", before).groupBy("task").agg(F.collect_list(F.struct("source_index", "before")).alias("starts"))
        return counts, starts.mapInArrow(streamed(rank), "slot long, source_index int, rank long, block long, upto long")

    none = np.zeros(0, np.int64)
    counts, extra = ranked(none, none, True)
    had = np.zeros(sources, np.int64)
    for r in counts.groupBy("source_index").agg(F.sum("n").alias("n")).collect():
        had[r["source_index"]] = r["n"]
    short = np.repeat(np.arange(sources), np.maximum(0, quota - had))
    given = np.array(sorted(r["slot"] for r in extra.select("slot").collect()), np.int64) if len(short) else none
    # in golden-ratio order too, so that no source's come together
    return ranked(given, short[np.argsort(np.arange(len(short), dtype=np.uint64) * np.uint64(GOLDEN), kind="stable")], False)[1]


def streams(docs: DataFrame, p: Plan, seed: int = 0, carry: Sequence[str] = ()) -> DataFrame:
    """Place documents (doc_id, source, size) in their source's shuffled stream.

    Adds source_index, source_size, target, ``start`` (words before the document) and
    ``place`` (rank among the rows of its bucket).  Running sums are over buckets of each source's
    hash range, then over a bucket's rows, so a source with a third of all rows is spread.
    """
    n = CHUNKS_PER_PARTITION * partitions(docs)
    sources = F.broadcast(source_table(docs.sparkSession, p))
    keyed = docs.join(sources, docs["source"].eqNullSafe(sources["source_name"]), "left").drop("source_name")
    keyed = keyed.withColumn("_key", F.xxhash64(F.lit(seed), "doc_id", "size")).withColumn("bucket", F.pmod("_key", F.lit(n)).cast("int"))
    sums = keyed.groupBy("source_index", "bucket").agg(F.sum("size").alias("words"))
    sums = sums.withColumn("base", F.sum("words").over(Window.partitionBy("source_index").orderBy("bucket")) - F.col("words")).drop("words")
    inside = Window.partitionBy("source_index", "bucket").orderBy("_key", "doc_id", "size", *carry)
    keyed = keyed.withColumn("place", F.row_number().over(inside)).withColumn("_before", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size"))
    return keyed.join(sums, ["source_index", "bucket"]).withColumn("start", F.col("base") + F.col("_before")).drop("_key", "_before", "base")


def pieces(placed: DataFrame, p: Plan) -> DataFrame:
    """Cut each document at block bounds: adds block, ``word`` (first word in the document) and ``words``.

    A document without words has one piece of none, with a null block.
    """
    size = p.block_words
    first, last = F.floor(F.col("start") / size), F.floor((F.col("start") + F.col("size") - 1) / size)
    cut = placed.withColumn("block", F.explode(F.when(F.col("size") > 0, F.sequence(first, last)).otherwise(F.array(F.lit(None).cast("long")))))
    low = F.greatest(F.col("block") * size, F.col("start"))
    high = F.least((F.col("block") + 1) * size, F.col("start") + F.col("size"))
    return cut.withColumn("word", low - F.col("start")).withColumn("words", F.when(F.col("block").isNull(), F.lit(0)).otherwise(high - low).cast("long"))


def _taken() -> Column:
    """Words of a piece that its slot takes."""
    return F.greatest(F.lit(0), F.least("words", F.col("upto") - F.col("start") - F.col("word")))


def sized(docs: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"), *carry)


def mix(docs: DataFrame, p: Plan | None = None, carry: Sequence[str] = (), **options) -> tuple[Plan, DataFrame, DataFrame]:
    """Mix documents (doc_id, text, source).

    Returns the plan, the placed documents and the mix: rows (slot, rank, doc_id, source_index,
    bucket, place, size, word, words) say which words of which document a slot takes.  Columns
    to ``carry`` come along.
    """
    sizes = checkpointed(sized(docs, carry))
    p = p or plan(sizes, **options)
    placed = streams(sizes, p, carry=carry)
    taken = pieces(placed, p).join(schedule(docs.sparkSession, p).hint("merge"), ["source_index", "block"]).withColumn("words", _taken()).where("words > 0")
    return p, placed, taken.select("slot", "rank", "doc_id", "source_index", "bucket", "place", "size", "word", "words", *carry)


def taken_words(docs: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, size, source_size, target and the words the mix takes of it."""
    sizes = checkpointed(sized(docs))
    p = plan(sizes, **options)
    cut = pieces(streams(sizes, p), p)
    joined = cut.join(schedule(docs.sparkSession, p).hint("merge"), ["source_index", "block"], "left")
    return (
        joined.groupBy("source_index", "bucket", "place", "doc_id", "size", "source_size", "target")
        .agg(F.sum(F.when(F.col("slot").isNotNull(), _taken()).otherwise(0)).alias("taken"))
        .select("doc_id", "size", "source_size", "target", "taken")
    )
