"""Documents in chunks of consecutive ids, the unit of work of several operators.

A chunk is a range of ids with about as much text as any other, a few megabytes however large
the table is.  Operators exchange messages between chunks instead of moving documents: a key
that holds a third of all rows costs at most one message entry per chunk.

Rows are in order of id, null first, and those with equal ids in order of the text, so that
an id which many rows share is cut too (rows of one id whose texts begin alike stay together).
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of a chunk's text; a longer text is a chunk alone.
CHUNK_BYTES = 4 << 20
#: Of tables smaller than that: chunks for each shuffle partition, so that hashing chunks to partitions stays even, of so many documents at least.
CHUNKS_PER_PARTITION, LEAST_DOCUMENTS = 4, 128
#: Chunks have one bound each in the plan; there are no more, so beyond 4 TB of text they grow (100 MB each at 100 TB).
MOST_CHUNKS = 1 << 20
#: Rows sampled for each chunk, and for all of them at most, to find the bounds.
SAMPLE_PER_CHUNK, MOST_SAMPLED = 64, 1 << 22
#: What a row counts besides its text.
_ROW_BYTES = 64
#: The column that ``with_chunk`` adds.
CHUNK = "_chunk"
#: Characters of a text that tell rows of one id apart.
_PREFIX = 32
_LEAST, _MOST = -(2**63), 2**63 - 1
Bound = tuple[int, str]


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def range_index(value: Column, tie: Column, bounds: list[Bound]) -> Column:
    """How many of the sorted ``bounds`` are below (value, tie), by binary search."""
    if not bounds:
        return F.lit(0)
    values = F.split(F.lit(",".join(str(v) for v, _ in bounds)), ",").cast(T.ArrayType(T.LongType()))
    ties = F.from_json(F.lit(json.dumps([t for _, t in bounds])), T.ArrayType(T.StringType()))
    steps = [1 << k for k in reversed(range(len(bounds).bit_length()))]

    def below(at: Column) -> Column:
        return (F.get(values, at) < value) | ((F.get(values, at) == value) & (F.get(ties, at) < tie))

    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda low, step: F.when((low + step <= len(bounds)) & below(low + step - 1), low + step).otherwise(low))


def bounds_of(sizes: DataFrame, n: int, rows: int) -> list[Bound]:
    """At most ``n - 1`` pairs that cut rows (value, tie, size) in ``n`` ranges of about equal size.

    They come from a sample of bounded length (all rows of small tables).  Where the cuts
    fall affects balance only.
    """
    if n < 2:
        return []
    share = min(SAMPLE_PER_CHUNK * n, MOST_SAMPLED) / rows
    got = (sizes.sample(share, seed=17) if share < 1 else sizes).toArrow().sort_by([("value", "ascending"), ("tie", "ascending")])
    if not got.num_rows:
        return []
    total = got["size"].to_numpy().cumsum()
    cuts = got.take(sorted({int(i) for i in total.searchsorted([total[-1] * k / n for k in range(1, n)])}))
    values, ties = cuts["value"].to_pylist(), cuts["tie"].to_pylist()
    shared = {v for v, before in zip(values[1:], values, strict=False) if v == before}  # other ids need no text to be told apart
    return sorted({(v, t if v in shared else "") for v, t in zip(values, ties, strict=True)})


def with_chunk(df: DataFrame, id_col: str, text_col: str = "text", descending: bool = False, chunk_bytes: int | None = None) -> tuple[DataFrame, int]:
    """Add ``CHUNK``, an int that never decreases in the order of rows; also the bytes of all rows.

    ``descending``: ids from the largest to the smallest and null last, equal ones still by text.
    """
    id_ = F.col(id_col).cast("long")
    value = F.coalesce(-id_, F.lit(_MOST)) if descending else F.coalesce(id_, F.lit(_LEAST))
    tie = F.coalesce(F.substring(F.col(text_col), 1, _PREFIX), F.lit(""))
    size = F.coalesce(F.octet_length(text_col), F.lit(0)) + _ROW_BYTES
    found = df.agg(F.count(F.lit(1)).alias("rows"), F.sum(size).alias("bytes")).first()
    rows, total = found["rows"], found["bytes"] or 0
    n = -(-total // (chunk_bytes or CHUNK_BYTES))
    n = min(MOST_CHUNKS, max(n, min(CHUNKS_PER_PARTITION * partitions(df), -(-rows // LEAST_DOCUMENTS))))
    bounds = bounds_of(df.select(value.alias("value"), tie.alias("tie"), size.alias("size")), n, rows)
    return df.withColumn(CHUNK, range_index(value, tie, bounds).cast("int")), total
