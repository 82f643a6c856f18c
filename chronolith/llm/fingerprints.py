"""Document fingerprints: MinHash over word shingles.

A text's shingles are its runs of five words (a shorter text: its whole word sequence).
Each of the hash permutations ``a * x + b`` (mod 2**64, upper half kept: a universal
family) gives the minimum over the shingles; the fingerprint holds the low 16 bits of
each minimum in hexadecimal.  The likeness of two fingerprints, the share of equal
entries, estimates the Jaccard similarity of the shingle sets.

Defined results: null and empty texts, and texts of white space only, have the
fingerprint of the empty set, which is like only itself.  Rows with equal ids are
neighbours in the order of their texts, null texts first; an empty table gives an empty
result; other columns are not read.  A very long text is held whole by one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import CHUNK, with_chunk
from .common import checkpointed, grouped, streamed
from .graph import connected_components
from .words import Words, blocks, distinct_sets, shingles

WIDTH = 5
PERMUTATIONS = 128
#: Bands of a fingerprint; texts with a Jaccard similarity of 0.8 share one with a probability of 0.94, of 0.9 with more than 0.9999.
BANDS = 16
THRESHOLD = (80, 100)
EMPTY = 0xFFFF
_STEP = 1 << 15


def _family(k: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 2**64, k, np.uint64) | np.uint64(1), rng.integers(0, 2**64, k, np.uint64)


def signatures(texts: pa.Array, permutations: int = PERMUTATIONS, width: int = WIDTH) -> np.ndarray:
    """A row of 16-bit entries for each text."""
    a, b = _family(permutations)
    out = np.full((len(texts), permutations), EMPTY, np.uint16)
    for low, high in blocks(texts):
        values, counts = shingles(Words(texts[low:high]), width)
        full = np.flatnonzero(counts)
        if not len(full):
            continue
        ends = np.cumsum(counts[full])
        minima = np.full((permutations, len(full)), 2**32 - 1, np.uint32)
        at, first = 0, 0
        while at < len(values):  # a few texts at a time, so that the values stay in cache
            last = max(first + 1, int(np.searchsorted(ends, at + _STEP, "right")))
            part = values[at : ends[last - 1]]
            starts = np.r_[0, ends[first : last - 1] - at]
            for k in range(permutations):
                mapped = ((part * a[k] + b[k]) >> np.uint64(32)).astype(np.uint32)
                minima[k, first:last] = np.minimum.reduceat(mapped, starts)
            at, first = int(ends[last - 1]), last
        out[low + full] = (minima.T & 0xFFFF).astype(np.uint16)
    return out


def to_text(signature: np.ndarray) -> list[str]:
    return [row.tobytes().hex() for row in np.ascontiguousarray(signature.astype(">u2"))]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    empty_a, empty_b = (a == EMPTY).all(axis=1), (b == EMPTY).all(axis=1)
    return np.where(empty_a ^ empty_b, 0.0, (a == b).mean(axis=1))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", permutations: int = PERMUTATIONS, width: int = WIDTH) -> DataFrame:
    """Rows (id, fingerprint) for every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(to_text(signatures(batch.column(1), permutations, width)), pa.string())], ["id", "fingerprint"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(streamed(run), f"id {kind}, fingerprint string").withColumnRenamed("id", id_col)


def edited(text: str, other: str) -> str:
    """The last half of the code points replaced by the first as many of another text."""
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


def with_next_in_chunk(docs: DataFrame, id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Documents by chunk, and for each chunk the document that follows its last one.

    The order is by descending id (null last), then by text (null first), from the last on to
    the first.  Only the largest id of each chunk goes to the driver, one per chunk.
    """
    chunked, _ = with_chunk(docs, id_col, descending=True)
    tops = sorted(((r[CHUNK], r["top"]) for r in chunked.groupBy(CHUNK).agg(F.max(id_col).alias("top")).collect()), key=lambda r: r[0])
    follow = docs.sparkSession.createDataFrame([(tops[k][0], tops[k - 1][0], tops[k][1]) for k in range(len(tops))], "_from int, _to int, _top long")
    firsts = chunked.join(F.broadcast(follow), (F.col(CHUNK) == F.col("_from")) & F.col(id_col).eqNullSafe(F.col("_top")))
    chosen = firsts.groupBy("_to", id_col).agg(F.min(F.struct("text")).alias("t")).select(F.col("_to").alias(CHUNK), id_col, "t.text")
    return chunked, chosen


def edit_study(docs: DataFrame) -> DataFrame:
    """Fingerprint every text (doc_id, text), its edited text, and compare them and the next document's."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    chunked, following = with_next_in_chunk(rows)
    both = chunked.select(CHUNK, "doc_id", "text", F.lit(False).alias("beyond")).unionByName(following.select(CHUNK, "doc_id", "text", F.lit(True).alias("beyond")))

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table["beyond"].to_pylist(), table["doc_id"].to_pylist(), table["text"].to_pylist(), strict=True), key=lambda r: (r[0], r[1] is None, -(r[1] or 0), r[2] is not None, r[2] or ""))
        texts = [r[2] or "" for r in rows]
        n = sum(not r[0] for r in rows)
        changed = [edited(x, y) for x, y in zip(texts[:n], texts[1:], strict=False)]
        own, new = signatures(pa.array(texts, pa.large_string())), signatures(pa.array(changed, pa.large_string()))
        return pa.table(
            {
                "doc_id": pa.array([r[1] for r in rows[:n]], pa.int64()),
                "n_chars": pa.array([len(x) for x in texts[:n]], pa.int64()),
                "edited_sha256": pa.array([hashlib.sha256(x.encode()).hexdigest() for x in changed], pa.string()),
                "fingerprint": pa.array(to_text(own[:n]), pa.string()),
                "edited_fingerprint": pa.array(to_text(new), pa.string()),
                "near_edited": pa.array(likeness(own[:n], new), pa.float64()),
                "near_next": pa.array(likeness(own[:n], own[1 : n + 1]), pa.float64()),
            }
        )

    return both.groupBy(CHUNK).applyInArrow(grouped(run), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: int = BANDS, width: int = WIDTH) -> DataFrame:
    """Rows (id, class_id): classes of texts joined by verified near copies.

    Fingerprints are cut in bands; texts that share a band are candidates, and the exact
    Jaccard similarity of their shingles decides.  First each text is verified against the
    smallest id of each of its bands; components of these links are computed; members of a
    band that are still in different components are paired and verified too.  So a band of
    near copies costs its size, and only one of texts just below the threshold of each other
    costs pairs.  A class's name is its smallest id.  Copies of a text are one from the start.
    Empty texts stay alone; rows of one id are one document, all of whose texts count; rows
    without id are left out; an empty table gives an empty result; other columns are not read.
    A pair is missed only if it shares no band.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id IS NOT NULL")
    keyed = rows.withColumn("sha", F.sha2(F.coalesce("text", F.lit("")), 256))
    marks = fingerprints(rows, "id", "text", width=width).join(keyed.select("id", "sha").distinct(), "id")
    size = 4 * PERMUTATIONS // bands
    band = F.explode(F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.struct(b.alias("b"), F.substring("fingerprint", b * size + 1, F.lit(size)).alias("key"))))
    none = to_text(np.full((1, PERMUTATIONS), EMPTY, np.uint16))[0]
    first = marks.where(F.col("fingerprint") != none).groupBy("sha", "fingerprint").agg(F.min("id").alias("id"))
    cut = checkpointed(first.select("id", band.alias("x")).select("id", "x.*"))
    heads = cut.groupBy("b", "key").agg(F.min("id").alias("head"))
    pairs = checkpointed(cut.join(heads, ["b", "key"]).where("id <> head").select(F.col("id").alias("x"), F.col("head").alias("y")).distinct())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        num, den = THRESHOLD
        for batch in batches:
            a, b = (distinct_sets(*shingles(Words(batch.column(k)), width)) for k in (2, 3))
            ends = [np.r_[0, np.cumsum(x[1])] for x in (a, b)]
            ok = []
            for k in range(batch.num_rows):
                x, y = a[0][ends[0][k] : ends[0][k + 1]], b[0][ends[1][k] : ends[1][k + 1]]
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(den * both >= num * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    left, right = rows.toDF("x", "tx"), rows.toDF("y", "ty")

    def linked(pairs: DataFrame) -> DataFrame:
        return pairs.join(left, "x").join(right, "y").select("x", "y", "tx", "ty").mapInArrow(streamed(run), "x long, y long")

    full = keyed.join(marks.where(F.col("fingerprint") != none).select("id").distinct(), "id", "left_semi")
    copies = full.join(first.select("sha", F.col("id").alias("y")), "sha").where("id <> y").select(F.col("id").alias("x"), "y")
    parts = connected_components(linked(pairs).unionByName(copies)).toDF("id", "part")
    member = cut.join(parts, "id", "left").withColumn("part", F.coalesce("part", "id"))
    split = member.groupBy("b", "key").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low <> high").select("b", "key")
    open_ = checkpointed(member.join(split, ["b", "key"], "left_semi"))
    one, other = (open_.select("b", "key", F.col("id").alias(c), F.col("part").alias(f"p{c}")) for c in "xy")
    rest = one.join(other, ["b", "key"]).where("px < py").select("x", "y").distinct()
    tried = pairs.unionByName(pairs.select(F.col("y").alias("x"), F.col("x").alias("y")))
    more = linked(checkpointed(rest.join(tried, ["x", "y"], "left_anti")))
    ends = more.join(parts.toDF("x", "px"), "x", "left").join(parts.toDF("y", "py"), "y", "left")
    bridges = connected_components(ends.select(F.coalesce("px", "x").alias("u"), F.coalesce("py", "y").alias("v"))).toDF("part", "class_id")
    found = rows.select("id").distinct().join(parts, "id", "left").withColumn("part", F.coalesce("part", "id"))
    return found.join(bridges, "part", "left").select(F.col("id").alias(id_col), F.coalesce("class_id", "part").alias("class_id"))
