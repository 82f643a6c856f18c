"""Exact BM25 top-k search by block-max WAND over document-aligned blocks.

The corpus is indexed in shards, one for each run of documents of an input partition:
sorted term hashes, their postings in blocks of ``BLOCK`` documents, and for each term and
block the largest contribution that one of its postings makes (block maxima, rounded up to a
byte).  A query is a set of terms.  In a shard,

1. the block maxima of its terms, times their weights, add up to an upper bound for each block:
   no posting is read;
2. the blocks are visited by bound, the highest first.  The threshold is the k-th best score so
   far; the pivot is the last block whose bound reaches it, and all blocks behind the pivot are
   skipped.  Each visited block is scored in full.

Only queries without a threshold need the first steps: they visit a few blocks to get one, and
then all up to the pivot at once, as the others do.  Queries that will visit much the same blocks
go side by side: the postings of frequent terms of a block are a matrix, so a block is scored for
all of them by one product.  Terms in fewer documents have lists; a query that visits a good part
of the shard reads those whole, since that is cheaper than to skip in them, and what it so adds
up in blocks behind the pivot is left out.  All other postings are read by block, for as many
queries at once as the CPU's cache holds.

Documents of a shard are ordered by their most frequent term, which puts texts of one
language together and makes block maxima tight.  A first part of the shards is searched
alone; the k-th best scores it finds are the thresholds that the other shards start from.

Document frequencies, the number of documents and their mean length are those of the
whole corpus, so scores of different shards compare, and the best k of all shards are
the exact result.  Scores are rounded to four decimals; ties go to the smaller id.

Queries are a set of their own that meets all documents.  They are written to the shared
folder in blocks of about ``QUERY_TERMS`` terms, which the tasks read one after the other;
nothing of them goes through the driver.

Terms are words, A-Z in lower case; a query has each of its terms once.
Defined results: a query without terms finds nothing; documents without terms are
found by no query but count in the statistics; rows with a null id are left out; rows
with equal ids are documents of their own, and queries with equal ids one query of all their
terms; an empty table finds nothing; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpointed, grouped, scratch, streamed
from .words import Words, blocks

K1, B = 1.2, 0.75
TOP = 10
BLOCK = 64
QUERY_TERMS = 1 << 18
#: Documents of a shard, at most.
SHARD = 8192
#: A term of more than this share of a shard's documents is frequent; at most so many are.
_FREQUENT, _MOST_FREQUENT = 1 / 16, 512
_U = np.uint64
#: One of so many shards is searched first, for the thresholds.
_FIRST = 8
_COLUMNS = ("ids", "lengths", "terms", "counts", "docs", "tf", "entries", "blocks", "sizes", "maxima")
_INDEX = "part int, mean double, " + ", ".join(f"{c} binary" for c in _COLUMNS)
#: A block maximum of ``n`` stands for ``n * _STEP``; no contribution is above ``K1 + 1``.
_STEP = (K1 + 1) / 255
#: Blocks that a query without a threshold visits to get one; then all up to the pivot.
_VISITS = 8
_SLACK = 1e-3
#: Another term of more than this share has a list, which a query that visits more than one in ``_WHOLE`` blocks reads whole: that is cheaper than to skip in it.
_LISTED, _WHOLE = 1 / 128, 8
#: Queries that are sorted by the parts, of so many blocks, that they will visit; block maxima or postings that are added up at once.
_SORTED, _PART, _AT_ONCE = 1024, 16, 1 << 16


def _distinct_terms(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Terms, the text of each, and how often it has it, by term, then text."""
    h = words.hashes(5)
    owner = np.repeat(np.arange(len(words.counts)), words.counts)
    order = np.lexsort((owner, h))
    h, owner = h[order], owner[order]
    new = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])]) if len(h) else np.zeros(0, np.int64)
    return h[new], owner[new], np.diff(np.r_[new, len(h)])


def _impacts(tf: np.ndarray, lengths: np.ndarray, mean: float) -> np.ndarray:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths / mean))


def _pack(part: int, mean: float, ids: list[np.ndarray], parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], lengths: list[np.ndarray]) -> pa.RecordBatch:
    term, doc, tf = (np.concatenate([p[k] for p in parts]) for k in range(3))
    n = sum(map(len, ids))
    leading = np.zeros(n, np.uint64)
    by_count = np.lexsort((term, tf, doc))
    leading[doc[by_count]] = term[by_count]  # the last one of each document stays
    order = np.argsort(leading, kind="stable")
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    doc = place[doc]
    sorted_ = np.lexsort((doc, term))
    term, doc, tf = term[sorted_], doc[sorted_], tf[sorted_]
    size = np.concatenate(lengths)[order]
    none = np.zeros(0, np.int64)
    new = np.r_[True, term[1:] != term[:-1]] if len(term) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    counts = np.diff(np.r_[at, len(term)])
    entry = np.flatnonzero(new | np.r_[True, doc[1:] // BLOCK != doc[:-1] // BLOCK]) if len(term) else none
    best = np.maximum.reduceat(_impacts(tf.astype(np.float64), size[doc], mean), entry) if len(entry) else none
    small = np.uint16 if not len(tf) or tf.max() < 65536 else np.uint32
    columns = (
        np.concatenate(ids)[order], size, term[at], counts.astype(np.int32), doc.astype(np.uint16), tf.astype(small),
        np.diff(np.r_[np.searchsorted(entry, at), len(entry)]).astype(np.int32), (doc[entry] // BLOCK).astype(np.uint16), np.diff(np.r_[entry, len(term)]).astype(np.uint8), np.minimum(np.ceil(best / _STEP + 1e-9), 255).astype(np.uint8),
    )
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([mean]), *(pa.array([x.tobytes()], pa.binary()) for x in columns)], ["part", "mean", *_COLUMNS])


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard: int = SHARD) -> DataFrame:
    """Index all documents; the shards are files in the shared folder.

    A first pass counts words, since block maxima need the mean length.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id IS NOT NULL")
    mean = mean_length(rows.select("text")) or 1.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts, lengths, held = [], [], [], 0
        part = TaskContext.get().partitionId() % _FIRST
        for batch in batches:
            for i, j in blocks(batch.column(1), 4 << 20):
                for low in range(i, j, shard):
                    high = min(j, low + shard)
                    if held + high - low > shard:
                        yield _pack(part, mean, ids, parts, lengths)
                        ids, parts, lengths, held = [], [], [], 0
                    words = Words(batch.column(1)[low:high], lower=True)
                    term, doc, tf = _distinct_terms(words)
                    parts.append((term, doc + held, tf))
                    ids.append(batch.column(0)[low:high].to_numpy(zero_copy_only=False).astype(np.int64))
                    lengths.append(words.counts.astype(np.int32))
                    held += high - low
        if held:
            yield _pack(part, mean, ids, parts, lengths)

    path = f"{scratch(docs.sparkSession, 'bm25')}/index"
    rows.mapInArrow(streamed(run), _INDEX).write.parquet(path)
    return docs.sparkSession.read.schema(_INDEX).parquet(path)


def term_counts(index: DataFrame) -> DataFrame:
    """Rows (term, df) over the whole corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for terms, counts in zip(batch.column(0), batch.column(1), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(terms.as_buffer(), np.int64)), pa.array(np.frombuffer(counts.as_buffer(), np.int32))], ["term", "df"])

    return index.select("terms", "counts").mapInArrow(streamed(run), "term long, df int").groupBy("term").agg(F.sum("df").alias("df"))


def mean_length(texts: DataFrame) -> float:
    """The mean number of words of rows (text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = words = 0
        for batch in batches:
            for i, j in blocks(batch.column(0), 4 << 20):
                words += int(Words(batch.column(0)[i:j]).counts.sum())
            n += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([words], pa.int64())], ["n", "words"])

    r = texts.mapInArrow(streamed(run), "n long, words long").agg(F.sum("n").alias("n"), F.sum("words").alias("words")).first()
    return (r["words"] or 0) / max(r["n"] or 0, 1)


def query_terms(queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (query, term), each term of a query once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in blocks(batch.column(1)):
                term, row, _ = _distinct_terms(Words(batch.column(1)[i:j], lower=True))
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j].take(pa.array(row)), pa.array(term.view(np.int64))], ["query", "term"])

    return queries.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id IS NOT NULL").mapInArrow(streamed(run), "query long, term long").distinct()


class Shard:
    def __init__(self, row: dict, mean: float):
        self.ids = np.frombuffer(row["ids"], np.int64)
        lengths = np.frombuffer(row["lengths"], np.int32)
        self.n = len(self.ids)
        self.terms = np.frombuffer(row["terms"], np.uint64)
        self.counts = np.frombuffer(row["counts"], np.int32).astype(np.int64)
        ends = np.cumsum(self.counts)
        self.docs = np.frombuffer(row["docs"], np.uint16).astype(np.int32)
        tf = np.frombuffer(row["tf"], np.uint16 if len(row["tf"]) == 2 * len(self.docs) else np.uint32).astype(np.float64)
        self.impacts = _impacts(tf, lengths[self.docs], mean)
        #: Of each term, its blocks; of each of those, the block, its upper bound and the place of its postings, up to the next one's.
        self.entries = np.frombuffer(row["entries"], np.int32).astype(np.int64)
        self.entry_ends = np.cumsum(self.entries)
        self.block = np.frombuffer(row["blocks"], np.uint16).astype(np.int64)
        self.first = np.r_[0, np.cumsum(np.frombuffer(row["sizes"], np.uint8), dtype=np.int64)]
        self.most = np.frombuffer(row["maxima"], np.uint8) * _STEP
        often = np.flatnonzero(self.counts > max(_FREQUENT * self.n, 8))
        often = np.sort(often[np.argsort(-self.counts[often], kind="stable")[:_MOST_FREQUENT]])
        self.blocks = -(-self.n // BLOCK)
        #: Frequent terms' contributions by block, term and document, and their maxima by block.
        self.dense = np.zeros((self.blocks, len(often), BLOCK))
        self.maxima = np.zeros((self.blocks, len(often)))
        self.column = np.full(len(self.terms), -1, np.int32)
        self.column[often] = np.arange(len(often))
        for k, t in enumerate(often):
            at = slice(ends[t] - self.counts[t], ends[t])
            self.dense[self.docs[at] // BLOCK, k, self.docs[at] % BLOCK] = self.impacts[at]
            at = slice(self.entry_ends[t] - self.entries[t], self.entry_ends[t])
            self.maxima[self.block[at], k] = self.most[at]
        #: Of other terms in many documents, the lists: where each begins, its postings, and its maxima by block.
        listed = np.flatnonzero((self.counts > max(_LISTED * self.n, 8)) & (self.column < 0))
        self.place = np.full(len(self.terms), -1, np.int32)
        self.place[listed] = np.arange(len(listed))
        at, self.cuts = _ranges(ends[listed] - self.counts[listed], self.counts[listed])
        self.list_docs, self.list_impacts = self.docs[at].astype(np.int64), self.impacts[at]
        entry, cuts = _ranges(self.entry_ends[listed] - self.entries[listed], self.entries[listed])
        self.list_maxima = np.zeros((len(listed), self.blocks))
        self.list_maxima[np.repeat(np.arange(len(listed)), np.diff(cuts)), self.block[entry]] = self.most[entry]

    def search(self, terms: np.ndarray, weights: np.ndarray, pairs: np.ndarray, bounds: np.ndarray, floors: np.ndarray, top: int, most: int = 256) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Documents and scores for each query, whose terms are ``terms[pairs[bounds[q]:bounds[q + 1]]]``: all that reach its floor and are among the best ``top``.

        Side by side go ``most`` queries that will visit much the same blocks.
        """
        if not len(self.terms):
            return
        found = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        weight = np.where(self.terms[found] == terms, weights, 0.0)
        known = weight[pairs] > 0
        ends = np.r_[0, np.cumsum(known)][bounds]
        pairs = pairs[known]
        lists = Lists(self, found[weight > 0], weight[weight > 0])
        for low in range(0, len(bounds) - 1, _SORTED):
            high = min(low + _SORTED, len(bounds) - 1)
            at = pairs[ends[low] : ends[high]]
            asked = Asked(lists, found[at], weight[at], ends[low : high + 1] - ends[low])
            bound = asked.bounds()
            near = bound >= np.maximum(floors[low:high], bound.max(1) / 2)[:, None]
            parts = np.add.reduceat(near, np.arange(0, self.blocks, _PART), axis=1, dtype=np.int64) * 2 >= _PART
            order = np.lexsort((near.sum(1), *parts.T))
            for i in range(0, len(order), most):
                some = order[i : i + most]
                for q, docs, score in Visits(asked.take(some), bound[some], floors[low + some], top).best():
                    yield low + int(some[q]), docs, score


class Lists:
    """A shard's lists with the contributions times the weights of the terms that are asked for, and room for those of one query."""

    def __init__(self, shard: Shard, term: np.ndarray, weight: np.ndarray):
        self.shard = shard
        place = shard.place[term]
        times = np.zeros(len(shard.cuts) - 1)
        times[place[place >= 0]] = weight[place >= 0]
        value = shard.list_impacts * np.repeat(times, np.diff(shard.cuts))
        cuts = shard.cuts.tolist()
        self.docs, self.values = ([x[i:j] for i, j in pairwise(cuts)] for x in (shard.list_docs, value))
        self._docs, self._values = np.empty_like(shard.list_docs), np.empty_like(value)

    def add(self, score: np.ndarray, places: np.ndarray) -> None:
        """Add whole lists to the scores of a query's documents."""
        n = int((self.shard.cuts[places + 1] - self.shard.cuts[places]).sum())
        places = places.tolist()
        np.concatenate([self.docs[k] for k in places], out=self._docs[:n])
        np.concatenate([self.values[k] for k in places], out=self._values[:n])
        np.add.at(score, self._docs[:n], self._values[:n])


class Asked:
    """Queries of a shard: ``dense`` has their weights of frequent terms, the others are pairs (term, weight) from ``ends[q]`` to ``ends[q + 1]``."""

    def __init__(self, lists: Lists, term: np.ndarray, weight: np.ndarray, ends: np.ndarray):
        self.lists, self.shard = lists, lists.shard
        query = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
        column = self.shard.column[term]
        rare = column < 0
        self.dense = np.zeros((len(ends) - 1, self.shard.dense.shape[1]))
        self.dense[query[~rare], column[~rare]] = weight[~rare]
        self.term, self.weight, self.ends = term[rare], weight[rare], np.r_[0, np.cumsum(rare)][ends]

    def take(self, some: np.ndarray) -> Asked:
        """These queries, in this order."""
        out = Asked.__new__(Asked)
        at, out.ends = _ranges(self.ends[some], self.ends[some + 1] - self.ends[some])
        out.lists, out.shard, out.dense, out.term, out.weight = self.lists, self.shard, self.dense[some], self.term[at], self.weight[at]
        return out

    def listed(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Each query with terms that have lists, the places of these and the terms' weights."""
        place = self.shard.place[self.term]
        has = place >= 0
        ends = np.r_[0, np.cumsum(has)][self.ends]
        place, weight = place[has], self.weight[has]
        for q in np.flatnonzero(np.diff(ends)).tolist():
            at = slice(ends[q], ends[q + 1])
            yield q, place[at], weight[at]

    def entries(self, pairs: np.ndarray, of_term: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """The posting blocks of these pairs, for runs of queries whose terms have about ``_AT_ONCE`` of what ``of_term`` counts, which the CPU's cache holds.

        First query, end, posting blocks, (query, block) cell of each, its pair, and the pairs' weights.
        """
        s = self.shard
        ends = np.r_[0, np.cumsum(pairs)][self.ends]
        terms, weights = self.term[pairs], self.weight[pairs]
        total = np.r_[0, np.cumsum(of_term[terms])][ends]
        low = 0
        while low < len(ends) - 1:
            high = max(low + 1, int(np.searchsorted(total, total[low] + _AT_ONCE, "right")) - 1)
            at = slice(ends[low], ends[high])
            n = s.entries[terms[at]]
            entry, _ = _ranges(s.entry_ends[terms[at]] - n, n)
            query = np.repeat(np.arange(high - low), np.diff(ends[low : high + 1]))
            pair = np.repeat(np.arange(len(n)), n)
            yield low, high, entry, s.block[entry] + (query * s.blocks)[pair], pair, weights[at]
            low = high

    def bounds(self) -> np.ndarray:
        """Of each query and block, the sum of the block maxima times weights; no posting is read."""
        s = self.shard
        out = self.dense @ s.maxima.T
        for low, high, entry, cell, pair, weight in self.entries(s.place[self.term] < 0, s.entries):
            out[low:high] += np.bincount(cell, s.most[entry] * weight[pair], (high - low) * s.blocks).reshape(high - low, -1)
        for q, place, weight in self.listed():
            out[q] += weight @ s.list_maxima[place]
        return out


def _ranges(first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all ranges of ``n`` from ``first`` on, and where each range begins and the last one ends."""
    ends = np.r_[0, np.cumsum(n)]
    out = np.repeat(first - ends[:-1], n)
    out += np.arange(len(out))
    return out, ends


class Visits:
    """The visits of queries that go side by side to the blocks of their shard."""

    def __init__(self, asked: Asked, bound: np.ndarray, floors: np.ndarray, top: int):
        self.asked, self.bound, self.floor, self.top = asked, bound, floors.copy(), top
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def _frequent(self, chosen: np.ndarray) -> np.ndarray:
        """What frequent terms add to the scores in the blocks that any query has ``chosen``."""
        s = self.asked.shard
        out = np.zeros((*chosen.shape, BLOCK))
        used = np.flatnonzero(self.asked.dense.any(0))
        weight = np.ascontiguousarray(self.asked.dense[:, used])
        every = 4 * len(used) > 3 * s.dense.shape[1]
        for b in np.flatnonzero(chosen.any(0)).tolist() if len(used) else ():
            who = np.flatnonzero(chosen[:, b])
            here = s.dense[b] if every else s.dense[b].take(used, 0)
            mine = self.asked.dense if every else weight
            if 2 * len(who) > len(chosen):
                np.matmul(mine, here, out=out[:, b])
            else:
                out[who, b] = mine[who] @ here
        return out

    def _scores(self, chosen: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """Runs of queries and their documents' scores: whole in the blocks that are ``chosen``, in others a part at most."""
        s, a = self.asked.shard, self.asked
        scores, width = self._frequent(chosen).reshape(len(chosen), -1), s.blocks * BLOCK
        whole = chosen.sum(1) * _WHOLE > s.blocks
        for q, place, _ in a.listed():
            if whole[q]:
                a.lists.add(scores[q], place)
        skipping = (s.place[a.term] < 0) | ~np.repeat(whole, np.diff(a.ends))
        for low, high, entry, cell, pair, weight in a.entries(skipping, s.counts):
            mine = np.flatnonzero(chosen[low:high].ravel()[cell])
            if len(mine):
                entry, pair, query = entry[mine], pair[mine], cell[mine] // s.blocks
                start = np.flatnonzero(np.r_[True, (entry[1:] != entry[:-1] + 1) | (pair[1:] != pair[:-1])])
                first = s.first[entry[start]]
                n = s.first[entry[np.r_[start[1:], len(entry)] - 1] + 1] - first
                at, _ = _ranges(first, n)
                slot = np.repeat(query[start] * width, n)
                slot += s.docs[at]
                value = np.repeat(weight[pair[start]], n)
                value *= s.impacts[at]
                np.add.at(scores[low:high].reshape(-1), slot, value)
            yield low, high, scores[low:high]

    def _keep(self, low: int, high: int, scores: np.ndarray, chosen: np.ndarray) -> None:
        least = np.maximum(self.floor[low:high] - _SLACK, 1e-300)
        query, doc = np.divmod(np.flatnonzero(scores >= least[:, None]), scores.shape[1])
        mine = chosen[query + low, doc // BLOCK]
        query, doc = query[mine], doc[mine]
        self.found.append((query + low, doc, scores[query, doc]))

    def best(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Visit blocks until all that are left are behind the pivot.  A little slack covers rounding."""
        s = self.asked.shard
        left = self.bound > 0
        new = np.flatnonzero(self.floor <= 0)
        if len(new) and s.blocks > _VISITS:
            highest = np.argpartition(-self.bound, _VISITS - 1, axis=1)[:, :_VISITS]
            chosen = np.zeros_like(left)
            chosen[new[:, None], highest[new]] = True
            chosen &= left
            for low, high, scores in self._scores(chosen):
                if self.top <= _VISITS * BLOCK:
                    at = highest[low:high, :, None]
                    seen = np.take_along_axis(scores.reshape(high - low, -1, BLOCK), at, 1) * np.take_along_axis(chosen[low:high, :, None], at, 1)
                    self.floor[low:high] = np.maximum(self.floor[low:high], np.partition(seen.reshape(high - low, -1), -self.top, axis=1)[:, -self.top])
                self._keep(low, high, scores, chosen)
            left &= ~chosen
        left &= self.bound >= self.floor[:, None] - _SLACK
        if left.any():
            for low, high, scores in self._scores(left):
                self._keep(low, high, scores, left)
        if not self.found:
            return
        query, docs, score = (np.concatenate(x) for x in zip(*self.found, strict=True))
        if not len(query):
            return
        ids, score = s.ids[docs], np.round(score, 4)
        order = np.lexsort((ids, -score, query))
        query, ids, score = query[order], ids[order], score[order]
        start = np.flatnonzero(np.r_[True, query[1:] != query[:-1]])
        for i, j in zip(start.tolist(), [*start[1:].tolist(), len(query)], strict=True):
            j = min(j, i + self.top)
            yield int(query[i]), ids[i:j], score[i:j]


def _query_blocks(asked: DataFrame, parts: int) -> str:
    """Write rows (query, term, weight, floor) in blocks, one row each, below the shared folder; a term has one weight, whatever the query."""

    def pack(table: pa.Table) -> pa.Table:
        query, term, weight, floor = table["query"].to_numpy(), table["term"].to_numpy().view(np.uint64), table["weight"].to_numpy(), table["floor"].to_numpy()
        order = np.lexsort((term, query))
        names, at = np.unique(query[order], return_index=True)
        terms, one, pairs = np.unique(term[order], return_index=True, return_inverse=True)
        packed = (names, terms, weight[order][one], pairs.astype(np.int32), np.append(at, len(query)), floor[order][at])
        return pa.table({c: pa.array([x.tobytes()], pa.binary()) for c, x in zip(_QUERY, packed, strict=True)})

    path = f"{scratch(asked.sparkSession, 'bm25')}/queries"
    blocks_ = asked.groupBy(F.pmod(F.xxhash64("query"), F.lit(parts)).alias("block")).applyInArrow(grouped(pack), ", ".join(f"{c} binary" for c in _QUERY))
    blocks_.write.parquet(path)
    return path


_QUERY = ("names", "terms", "weights", "pairs", "bounds", "floors")
_KINDS = (np.int64, np.uint64, np.float64, np.int32, np.int64, np.float64)


def _read_blocks(path: str) -> Iterator[tuple[np.ndarray, ...]]:
    store, root = pafs.FileSystem.from_uri(path)
    for f in store.get_file_info(pafs.FileSelector(root)):
        if f.base_name.startswith("part-"):
            with store.open_input_file(f.path) as source:
                for batch in pq.ParquetFile(source).iter_batches(1):
                    yield tuple(np.frombuffer(batch.column(c)[0].as_buffer(), kind) for c, kind in zip(_QUERY, _KINDS, strict=True))


def search(index: DataFrame, queries: DataFrame, id_col: str = "doc_id", text_col: str = "text", top: int = TOP, query_terms_at_once: int = QUERY_TERMS) -> DataFrame:
    """Rows (query, rank, doc_id, score): the best ``top`` documents of every query."""
    n = index.agg(F.sum(F.octet_length("ids"))).first()[0] or 0
    frequency = F.log1p((F.lit(n // 8) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    asked = checkpointed(query_terms(queries, id_col, text_col).join(term_counts(index), "term").select("query", "term", frequency.alias("weight")))
    parts = max(1, -(-asked.count() // query_terms_at_once))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "doc_id")
    first = checkpointed(_found(index.where("part = 0"), _query_blocks(asked.withColumn("floor", F.lit(0.0)), parts), top))
    floors = first.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == top).select("query", F.col("score").alias("floor"))
    told = asked.join(floors, "query", "left").withColumn("floor", F.coalesce("floor", F.lit(0.0)))
    rest = _found(index.where("part <> 0"), _query_blocks(told, parts), top)
    return first.unionByName(rest).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("query", "rank", "doc_id", "score")


def _found(index: DataFrame, path: str, top: int) -> DataFrame:
    """Rows (query, doc_id, score): what each shard finds for the query blocks below ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                shard = Shard({c: batch.column(c)[row].as_buffer() for c in _COLUMNS}, batch.column("mean")[row].as_py())
                for names, term, weight, pairs, bounds, least in _read_blocks(path):
                    rows = [(np.full(len(ids), names[q]), ids, score) for q, ids, score in shard.search(term, weight, pairs, bounds, least, top)]
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*rows, strict=True)], ["query", "doc_id", "score"])

    return index.drop("part").mapInArrow(streamed(run), "query long, doc_id long, score double")


def hundredth(id_col: Column) -> Column:
    return id_col % 100 == 0
