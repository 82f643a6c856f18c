"""N-gram Jaccard join: a size-aware heavy-light set similarity join, and its components.

Texts become sets of hashed word shingles; equal sets are one class from then on.  Two
sets of sizes a and b link if they share at least ``c(a, b)`` shingles.

* Light sets, up to a boundary size, enumerate their subsets of the fixed sizes
  ``c(a, b)``: two light sets that link have such a subset in common.
* Heavy sets put the first shingles of a global order, rare ones first, into inverted
  lists that are scanned: a set can't link without one of them.  Light sets near the
  boundary are in these lists too, for pairs of a light and a heavy set.

The boundary is where the number of subsets outgrows the entries of the lists, by a
histogram of all set sizes.

Pairs are verified in two steps: histograms of the hashes, a thirtieth of a set's size,
bound the intersection from above; the sets themselves, taken from the texts, are only
compared where that bound allows a link.

A list of L sets is not expanded into its pairs.  First every member is verified against
one pivot, the member that is in most lists, which among near copies is the text they
come from; components of these links are computed; only members of a list that are still
in different components are paired, if their sizes and the positions of the shared shingle
in the order allow a link (what comes before their first common shingle is not shared).
So groups of near copies cost their size, and no link that would join two components is lost.

Hashed shingles have 64 bits.  Class ids are 64-bit hashes of sets.  That no id stands for two
sets is checked with a second hash; ids that do are taken back, their sets get ids of all 128
bits of both hashes, and the texts are hashed again.

Defined results: null and blank texts have the empty set and link with nothing; rows with
equal ids are one vertex; rows with a null id are returned with a null component; an empty
table gives an empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chunks import partitions
from .common import broadcast_if_small, checkpointed, grouped, hand_out, streamed
from .graph import connected_components
from .words import Words, blocks, mix, shingles

_U = np.uint64
#: At most so many frequent shingles are ordered by frequency; the order of the rest is by hash.  It affects cost only.
ORDERED_SHINGLES = 1 << 17
#: A shingle is counted as frequent where so many sets of a block of texts have it.
_OFTEN = 3
_LARGEST_BOUNDARY = 24
#: Cost of an entry of an inverted list in subsets.
_LIST_COST = 4
_BLOCK = 4 << 20
#: Shingles for each bucket of lists, so that what a task scans stays small however large the table is.
_BUCKET_SHINGLES = 1 << 22
#: Classes that a task remembers to have sent; beyond them a class may be sent again, and counts once.
_REMEMBERED = 1 << 17


def least_overlap(a: int, b: int, num: int, den: int) -> int:
    """Smallest intersection of sets of sizes a and b with ``den * intersection >= num * union``."""
    return -(-num * (a + b) // (num + den))


def _sizes_near(s: int, num: int, den: int) -> range:
    return range(-(-num * s // den), den * s // num + 1)


def subset_sizes(s: int, num: int, den: int) -> list[int]:
    return sorted({c for t in _sizes_near(s, num, den) if (c := least_overlap(s, t, num, den)) <= min(s, t)})


def prefix_length(s: int, num: int, den: int) -> int:
    """So many shingles of a set of size s must hold one of any set that links with it."""
    return s - -(-num * s // den) + 1


def boundary(histogram: dict[int, int], num: int, den: int) -> int:
    """The largest light size, by cost."""

    def cost(b: int) -> int:
        light = sum(n * sum(comb(s, c) for c in subset_sizes(s, num, den)) for s, n in histogram.items() if s <= b)
        return light + _LIST_COST * sum(n * prefix_length(s, num, den) for s, n in histogram.items() if s * den >= num * (b + 1))

    return min(range(_LARGEST_BOUNDARY + 1), key=lambda b: (cost(b), b))


NO_CLASHES = np.zeros(0, np.int64)


class Sets:
    """Distinct sorted shingles of a block of texts.

    ``clashes``: sorted class ids that stand for several sets; such sets get other ids.
    ``class_bits``: bits of a class id, fewer than 64 only to test clashes.
    """

    def __init__(self, texts: pa.Array, width: int, clashes: np.ndarray = NO_CLASHES, class_bits: int = 64):
        values, counts = shingles(Words(texts, lower=True), width)
        ends = np.cumsum(counts)
        keep = np.ones(len(values), bool)
        for i, j in zip((ends - counts).tolist(), ends.tolist(), strict=True):
            values[i:j].sort()
        keep[1:] = values[1:] != values[:-1]
        keep[(ends - counts)[counts > 0]] = True
        total = np.r_[0, np.cumsum(keep)]
        self.values = values[keep]
        self.ends = total[ends]
        self.sizes = self.ends - total[ends - counts]
        self.starts = self.ends - self.sizes
        # A set's class, and a second hash of it
        self.classes = self._folded(mix(self.values ^ _U(0x8EBC6AF09C88C6E3)))
        self.checks = self._folded(mix(self.values * _U(0x589965CC75374CC3)))
        if class_bits < 64:
            self.classes = self.classes & ((1 << class_bits) - 1)
        while len(at := np.flatnonzero(np.isin(self.classes, clashes))):
            self.classes[at] = mix(self.classes[at].view(np.uint64) * _U(0xFF51AFD7ED558CCD) + mix(self.checks[at].view(np.uint64))).view(np.int64)

    def sketches(self, chosen: np.ndarray) -> list[bytes]:
        """Histograms of some sets' hashes over a power of two of buckets, about one for four shingles.

        One with a count beyond a byte is left empty: it bounds nothing.
        """
        out = []
        for d in chosen.tolist():
            buckets = 1 << max(3, int(-(-int(self.sizes[d]) // 4) - 1).bit_length())
            counts = np.bincount((self.values[self.starts[d] : self.ends[d]] >> _U(20)).astype(np.int64) & (buckets - 1), minlength=buckets)
            out.append(counts.astype(np.uint8).tobytes() if counts.max() < 256 else b"")
        return out

    def _folded(self, x: np.ndarray) -> np.ndarray:
        total = np.r_[_U(0), np.cumsum(x, dtype=np.uint64)]
        return mix(total[self.ends] - total[self.starts] + self.sizes.astype(np.uint64)).view(np.int64)


def _text_blocks(batches: Iterator[pa.RecordBatch], *how: Any) -> Iterator[tuple[pa.RecordBatch, Sets]]:
    for batch in batches:
        for i, j in blocks(batch.column(batch.num_columns - 1), _BLOCK):
            part = batch.slice(i, j - i)
            yield part, Sets(part.column(part.num_columns - 1), *how)


def shingle_sets(docs: DataFrame, *how: Any) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (doc_id, n, class, check) for each document, (class, sketch) for the sets, and counts (shingle, n) of frequent shingles.

    A class's sketch comes once from each block of texts that has it.  ``how``: as for ``Sets``.
    """
    schema = "kind int, doc_id long, n long, class long, check long, sketch binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kind", "doc_id", "n", "class", "check", "sketch"]
        for part, sets in _text_blocks(batches, *how):
            k = len(sets.sizes)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(k, np.int32)), part.column(0), pa.array(sets.sizes.astype(np.int64)), pa.array(sets.classes), pa.array(sets.checks), pa.nulls(k, pa.binary())], names)
            one = np.unique(sets.classes, return_index=True)[1]
            m = len(one)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(m, 2, np.int32)), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.array(sets.classes[one]), pa.nulls(m, pa.int64()), pa.array(sets.sketches(one), pa.binary())], names)
            found = np.sort(sets.values)
            new = np.flatnonzero(np.r_[True, found[1:] != found[:-1]]) if len(found) else np.zeros(0, np.int64)
            count = np.diff(np.r_[new, len(found)])
            often = count >= _OFTEN
            m = int(often.sum())
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(m, np.int32)), pa.nulls(m, pa.int64()), pa.array(count[often]), pa.array(found[new[often]].view(np.int64)), pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary())], names)

    both = checkpointed(docs.mapInArrow(streamed(run), schema))
    return both.where("kind = 0").select("doc_id", "n", "class", "check"), both.where("kind = 2").select("class", "sketch"), both.where("kind = 1").select(F.col("class").alias("shingle"), "n")


class Order:
    """The global order of shingles: by counted frequency (0 for most), then by hash."""

    def __init__(self, counts: list[tuple[int, int]]):
        found = sorted((s & (2**64 - 1), n) for s, n in counts)
        self.shingles = np.array([s for s, _ in found], np.uint64)
        self.counts = np.array([n for _, n in found], np.int64)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.shingles >> _U(44)).astype(np.int64)] = True

    def frequency(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros(len(values), np.int64)
        at = np.flatnonzero(self.maybe[(values >> _U(44)).astype(np.int64)])
        if len(at) and len(self.shingles):
            place = np.minimum(np.searchsorted(self.shingles, values[at]), len(self.shingles) - 1)
            out[at] = np.where(self.shingles[place] == values[at], self.counts[place], 0)
        return out


def _keys(sets: Sets, chosen: np.ndarray, order: Order, bound: int, num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """List keys of some sets, the number of the set of each, and its position in the order (0 for subsets)."""
    keys, owner, place = [], [], []
    frequency = order.frequency(sets.values)
    for d in chosen.tolist():
        i, j, s = sets.starts[d], sets.ends[d], int(sets.sizes[d])
        values = sets.values[i:j]
        if s <= bound:
            for c in subset_sizes(s, num, den):
                picked = np.array(list(combinations(range(s), c)), np.int64)
                keys.append(mix(mix(values ^ _U(0xE7037ED1A0B428DB))[picked].sum(axis=1, dtype=np.uint64) + _U(c)))
                owner.append(np.full(len(picked), d))
                place.append(np.zeros(len(picked), np.int32))
        if s * den >= num * (bound + 1):
            n = prefix_length(s, num, den)
            f = frequency[i:j]
            first = values[:n] if not f[:n].any() else values[np.argsort(f, kind="stable")[:n]]
            keys.append(first)
            owner.append(np.full(n, d))
            place.append(np.arange(n, dtype=np.int32))
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
    return np.concatenate(keys), np.concatenate(owner), np.concatenate(place)


def _scan(num: int, den: int):
    """The lists of a bucket: rows (list, class, size, place) of those with a pair of sizes that can link."""

    def run(table: pa.Table) -> pa.Table:
        columns = (("keys", np.uint64), ("classes", np.int64), ("sizes", np.int32), ("places", np.int32))
        key, cls, size, place = (np.concatenate([np.frombuffer(x, t) for x in table[c].to_pylist()]) for c, t in columns)
        size = size.astype(np.int64)
        order = np.lexsort((place, cls, size, key))
        key, cls, size, place = key[order], cls[order], size[order], place[order]
        keep = np.r_[True, (key[1:] != key[:-1]) | (cls[1:] != cls[:-1])]
        key, cls, size, place = key[keep], cls[keep], size[keep], place[keep]
        near = np.r_[False, (key[1:] == key[:-1]) & (size[:-1] * den >= num * size[1:])]
        keep = near | np.r_[near[1:], False]
        key, cls, size, place = key[keep], cls[keep], size[keep], place[keep]
        if not len(key):
            name = np.zeros(0, np.int64)
        else:
            bounds = np.r_[True, (key[1:] != key[:-1]) | (size[:-1] * den < num * size[1:])]
            at = np.flatnonzero(bounds)
            content = np.add.reduceat(mix(cls.view(np.uint64)), at)
            name = np.repeat(mix(content).view(np.int64), np.diff(np.r_[at, len(key)]))
        return pa.table({"list": name, "class": cls, "size": pa.array(size, pa.int32()), "place": pa.array(place, pa.int32())})

    return run


def candidate_lists(docs: DataFrame, how: tuple, order: Order, bound: int, num: int, den: int, buckets: int) -> DataFrame:
    """Rows (list, class, size, place): lists of at least two classes whose sizes can link.

    Lists of the same classes are one, with the least place of each class.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[int] = set()
        keys, owners, sizes, places = [], [], [], []
        held = 0

        def out() -> pa.RecordBatch:
            a, *rest = (np.concatenate(x) for x in (keys, owners, sizes, places))
            bucket = (a % _U(buckets)).astype(np.int64)
            at = np.argsort(bucket, kind="stable")
            found, low = np.unique(bucket[at], return_index=True)
            cuts = list(zip(low, np.r_[low[1:], len(a)].astype(np.int64), strict=True))
            sent = [x[at] for x in (a, *rest)]
            return pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), *(pa.array([x[i:j].tobytes() for i, j in cuts], pa.binary()) for x in sent)], ["bucket", "keys", "classes", "sizes", "places"])

        for _, sets in _text_blocks(batches, *how):
            _, first = np.unique(sets.classes, return_index=True)
            chosen = np.array([d for d in np.sort(first).tolist() if sets.sizes[d] and int(sets.classes[d]) not in known], np.int64)
            if len(known) > _REMEMBERED:
                known.clear()
            known.update(sets.classes[chosen].tolist())
            a, owner, place = _keys(sets, chosen, order, bound, num, den)
            if len(a):
                keys.append(a)
                owners.append(sets.classes[owner])
                sizes.append(sets.sizes[owner].astype(np.int32))
                places.append(place)
                held += len(a)
            if held >= 1 << 19:
                yield out()
                keys, owners, sizes, places, held = [], [], [], [], 0
        if held:
            yield out()

    sent = docs.select("text").mapInArrow(streamed(send), "bucket int, keys binary, classes binary, sizes binary, places binary")
    found = sent.groupBy("bucket").applyInArrow(grouped(_scan(num, den)), "list long, class long, size int, place int")
    return found.groupBy("list", "class", "size").agg(F.min("place").alias("place"))


def _can_link(num: int, den: int) -> Column:
    """Whether the sizes sx, sy and the places ix, iy of a shared shingle allow enough common ones."""
    left = F.least(F.col("sx") - F.col("ix"), F.col("sy") - F.col("iy"))
    return (left * (num + den) >= num * (F.col("sx") + F.col("sy"))) & (F.col("sx") * den >= F.col("sy") * num) & (F.col("sy") * den >= F.col("sx") * num)


def possible(pairs: DataFrame, sketches: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (x, y, sx, sy) of classes and their sizes whose sketches allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = np.ones(batch.num_rows, bool)
            for k, (m, n, a, b) in enumerate(zip(*(batch.column(c).to_pylist() for c in (2, 3, 4, 5)), strict=True)):
                if not a or not b:
                    continue
                a, b = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
                if len(a) > len(b):
                    a, b = b, a
                both = int(np.minimum(a, b.reshape(-1, len(a)).sum(0) if len(b) > len(a) else b).sum())
                ok[k] = den * both >= num * (m + n - both)
            yield batch.select([0, 1]).filter(pa.array(ok))

    wanted = pairs.select(F.explode(F.array("x", "y")).alias("class")).distinct()
    known = sketches.join(wanted, "class", "left_semi").groupBy("class").agg(F.first("sketch").alias("sketch"))
    rows = pairs.join(known.toDF("x", "a"), "x").join(known.toDF("y", "b"), "y").select("x", "y", "sx", "sy", "a", "b")
    return checkpointed(rows.mapInArrow(streamed(run), "x long, y long").distinct())


def verified(pairs: DataFrame, rows: DataFrame, holders: DataFrame, how: tuple, num: int, den: int) -> DataFrame:
    """The pairs (x, y) of classes that link, by the exact intersection of their sets.

    ``holders`` names a document of each class; only the texts of classes in pairs are read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = np.zeros(batch.num_rows, bool)
            for k, (a, b) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                a, b = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                if len(a) > len(b):
                    a, b = b, a
                both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
                ok[k] = den * both >= num * (len(a) + len(b) - both)
            yield batch.select([0, 1]).filter(pa.array(ok))

    if pairs.isEmpty():
        return pairs
    wanted = pairs.select(F.explode(F.array("x", "y")).alias("class")).distinct()
    sets = checkpointed(_sets_of(rows, broadcast_if_small(holders.join(wanted, "class", "left_semi")), how))
    left = sets.select(F.col("class").alias("x"), F.col("shingles").alias("sx"))
    right = sets.select(F.col("class").alias("y"), F.col("shingles").alias("sy"))
    return checkpointed(pairs.join(left, "x").join(right, "y").select("x", "y", "sx", "sy").mapInArrow(streamed(run), "x long, y long").distinct())


def component_table(docs: DataFrame, width: int = 4, num: int = 85, den: int = 100, class_bits: int = 64) -> DataFrame:
    """Per document (doc_id, text): doc_id, n_shingles and component_id, the smallest id reachable by links."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    clashes = NO_CLASHES
    while True:
        how = (width, clashes, class_bits)
        marks, sketches, counts = shingle_sets(rows, *how)
        full = marks.where("n > 0")
        clash = full.groupBy("class").agg(F.min("check").alias("a"), F.max("check").alias("b"), F.min("n").alias("c"), F.max("n").alias("d")).where("a <> b OR c <> d").select("class").toArrow()["class"].to_numpy()
        if not len(clash):
            break
        clashes = np.union1d(clashes, clash)  # n sets have n * n / 2**65 of them: three in ten thousand million
    buckets = max(partitions(docs), (full.agg(F.sum("n")).first()[0] or 0) // _BUCKET_SHINGLES)
    often = counts.groupBy("shingle").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "shingle").limit(ORDERED_SHINGLES).collect()
    order = Order([(r["shingle"], r["n"]) for r in often])
    histogram = {r["n"]: r["k"] for r in full.where(F.col("n") <= 2 * _LARGEST_BOUNDARY).select("class", "n").distinct().groupBy("n").agg(F.count(F.lit(1)).alias("k")).collect()}
    lists = checkpointed(candidate_lists(rows, how, order, boundary(histogram, num, den), num, den, buckets))

    holders = checkpointed(full.where("doc_id IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("doc_id")).join(lists.select("class").distinct(), "class", "left_semi"))
    degree = lists.groupBy("class").agg(F.count(F.lit(1)).alias("degree"))
    pivot = lists.join(degree, "class").groupBy("list").agg(F.max(F.struct("degree", "class", "size", "place")).alias("p"), F.count(F.lit(1)).alias("n"))
    pivot = checkpointed(pivot.select("list", F.col("p.class").alias("y"), F.col("p.size").alias("sy"), F.col("p.place").alias("iy"), "n"))
    stars = hand_out(lists.select("list", F.col("class").alias("x"), F.col("size").alias("sx"), F.col("place").alias("ix")), pivot, "list")
    stars = checkpointed(stars.where((F.col("x") != F.col("y")) & _can_link(num, den)).select("x", "y", "sx", "sy").distinct())
    several = full.groupBy("doc_id").agg(F.min("class").alias("u"), F.max("class").alias("v")).where("doc_id IS NOT NULL AND u <> v").select(F.col("doc_id").alias("d"), "u")
    same_id = full.join(several, F.col("doc_id") == F.col("d")).select("u", F.col("class").alias("v"))
    links = verified(possible(stars, sketches, num, den), rows, holders, how, num, den).toDF("u", "v").unionByName(same_id)
    parts = connected_components(links)

    member = checkpointed(lists.join(parts.withColumnRenamed("node", "class"), "class", "left").select("list", "class", "size", "place", F.coalesce("component", "class").alias("part")))
    split = checkpointed(member.groupBy("list").agg(F.min("part").alias("a"), F.max("part").alias("b"), F.count(F.lit(1)).alias("n")).where("a <> b").select("list", "n"))
    open_ = checkpointed(hand_out(member, split, "list"))
    every = open_.groupBy("class").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "list"))), lambda e: e.list).alias("lists"))
    full_rows = open_.join(every, "class")
    one, other = (full_rows.select("list", F.col("class").alias(c), F.col("size").alias(f"s{c}"), F.col("place").alias(f"i{c}"), F.col("part").alias(f"p{c}"), F.col("lists").alias(f"l{c}")) for c in "xy")
    first = F.get(F.array_intersect("lx", "ly"), F.lit(0)) == F.col("list")  # a pair comes once, from the first list that both are in
    rest = one.join(other, "list").where((F.col("px") < F.col("py")) & _can_link(num, den) & first).select("x", "y", "sx", "sy")
    tried = stars.select("x", "y").unionByName(stars.select(F.col("y").alias("x"), F.col("x").alias("y")))
    rest = checkpointed(rest.join(tried, ["x", "y"], "left_anti"))
    more = verified(possible(rest, sketches, num, den), rows, holders, how, num, den)
    ends = more.join(parts.toDF("x", "cx"), "x", "left").join(parts.toDF("y", "cy"), "y", "left")
    bridges = connected_components(ends.select(F.coalesce("cx", "x").alias("u"), F.coalesce("cy", "y").alias("v")))

    known = full.where("doc_id IS NOT NULL")
    classes = known.groupBy("class").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("rows"))
    classes = classes.join(parts.toDF("class", "a"), "class", "left").withColumn("a", F.coalesce("a", "class"))
    classes = checkpointed(classes.join(broadcast_if_small(bridges.toDF("a", "b")), "a", "left").select("class", "least", "rows", F.coalesce("b", "a").alias("part")))
    least = checkpointed(classes.groupBy("part").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n")))
    named = checkpointed(hand_out(classes, least, "part").select("class", "component_id", F.col("rows").alias("n")))
    of = hand_out(known.select("doc_id", "class"), named, "class").select("doc_id", "component_id").distinct()
    return marks.select("doc_id", F.col("n").alias("n_shingles")).join(of, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def _sets_of(rows: DataFrame, holders: DataFrame, how: tuple) -> DataFrame:
    """Rows (class, shingles): the sorted shingles of one document of each class (repeated rows repeat it)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sets in _text_blocks(batches, *how):
            mine = np.flatnonzero(sets.classes == part.column(0).to_numpy())
            raw = [sets.values[sets.starts[d] : sets.ends[d]].tobytes() for d in mine]
            yield pa.RecordBatch.from_arrays([pa.array(sets.classes[mine]), pa.array(raw, pa.binary())], ["class", "shingles"])

    return rows.join(holders, "doc_id").select("class", "text").mapInArrow(streamed(run), "class long, shingles binary")
