"""Exact removal of repeated word passages by de Bruijn compaction.

Runs of ``WINDOW`` words are the edges of a de Bruijn graph, their shared inner words its
nodes.  Consecutive edges whose rarest-hashed short word run (their minimizer) is the same
occurrence form a path.  Equal edges have equal minimizers, so all places of an edge lie
in paths of one minimizer, and paths are compacted by it:

1. Every chunk of documents sends one entry for each minimizer: the fingerprint of its
   path, or a mark if it holds several.  Where all chunks agree, the path does not branch:
   it is one unit, and all places but the first, by source coordinate, are repeats.
2. Paths that branch are taken apart into their edges, which are exchanged likewise, by
   two independent 64-bit hashes of the words.
3. Repeated units that are consecutive in both places join to long spans with source
   coordinates (chunk, word).  A digest of a span's words goes to the chunk of the source,
   which compares it with that of its own words there; spans that differ are not removed.
4. Every chunk joins the answers to its documents, marks the repeated edges and removes
   the words that they cover.

Chunks are ranges of document ids in order, so the first chunk of a key has its first
place.  A document moves once (the exchange of documents to chunks is reused by all four
steps), and a key that a third of all rows share costs one entry per chunk.

Defined results: null and empty texts have no words; documents of fewer than ``WINDOW``
words keep all; rows with equal ids are documents of their own, ordered by text; a null
id comes first; an empty table gives an empty one.  A very long text is a chunk alone, held
whole by one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .chunks import CHUNK, partitions, with_chunk
from .common import cogrouped, grouped
from .words import Words, mix, window_hashes, window_rows

WINDOW = 20
#: Words of a minimizer.
SEED_WORDS = 8
#: Bytes of text for each bucket of keys, so that what a task judges stays small however large the table is.
BUCKET_BYTES = 16 << 20
_U = np.uint64
_BASE = (0xD1342543DE82EF95, 0xAF251AF3B0F025B5, 0x2545F4914F6CDD1D)
#: Fingerprint of several paths.
_BRANCHES = _U(0)
_MESSAGE = "receiver int, chunk int, a binary, b binary, c binary"
_ANSWER = "chunk int, kind int, a binary, b binary"
_UNIT_REPEATED, _BRANCHING, _EDGE_REPEATED, _DIFFERENT = 0, 1, 2, 3


def _spans_hash(words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of ``words[start:end]`` for each pair, by prefix sums."""
    base = _BASE[2] | 1
    power = np.full(len(words) + 1, base, np.uint64)
    power[0] = 1
    power = np.cumprod(power, dtype=np.uint64)
    inverse = np.full(len(words) + 1, pow(base, -1, 2**64), np.uint64)
    inverse[0] = 1
    inverse = np.cumprod(inverse, dtype=np.uint64)
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * power[:-1], dtype=np.uint64, out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts])


class Paths:
    """The paths of one chunk's documents, in the order of the documents."""

    def __init__(self, texts: pa.Array, window: int = WINDOW, seed_words: int = SEED_WORDS):
        self.window = window
        self.words = w = Words(texts)
        self.h = w.hashes(0)
        self.g = w.hashes(1)
        n = len(self.h) - window + 1
        self.starts, self.counts = window_rows(w.offsets, window)
        if n <= 0 or not len(self.starts):
            empty = np.zeros(0, np.int64)
            self.run, self.size, self.key, self.print = empty, empty, empty.astype(np.uint64), empty.astype(np.uint64)
            return
        seeds = window_hashes(self.h, seed_words, _BASE[0])
        least, at = seeds[:n].copy(), np.arange(n)
        for j in range(1, window - seed_words + 1):
            lower = seeds[j : j + n] < least
            least[lower] = seeds[j : j + n][lower]
            at[lower] = np.flatnonzero(lower) + j
        key, place = least[self.starts], at[self.starts]
        new = np.ones(len(self.starts), bool)
        new[1:] = (np.diff(self.starts) != 1) | (np.diff(place) != 0)
        self.run = np.flatnonzero(new)
        self.size = np.diff(np.r_[self.run, len(self.starts)])
        first = self.starts[self.run]
        self.key = key[self.run]
        shape = (self.size.astype(np.uint64) << _U(32)) | (place[self.run] - first).astype(np.uint64)
        self.print = np.maximum(_spans_hash(self.g, first, first + self.size + window - 1) ^ mix(shape), _U(1))

    def units(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct keys, the fingerprint of each (or the mark of several), and its first path."""
        order = np.argsort(self.key, kind="stable")
        key = self.key[order]
        bounds = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        if not len(bounds):
            return key, key, bounds
        prints = self.print[order]
        low, high = np.minimum.reduceat(prints, bounds), np.maximum.reduceat(prints, bounds)
        return key[bounds], np.where(low == high, low, _BRANCHES), order[bounds]

    def edges(self, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Edges of some paths: their numbers and two hashes of each."""
        size = self.size[runs]
        at = np.repeat(self.run[runs], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        places = self.starts[at]
        return at, window_hashes(self.h, self.window, _BASE[1])[places] if len(at) else self.h[:0], window_hashes(self.g, self.window, _BASE[0])[places] if len(at) else self.h[:0]


def _member(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Which values are among sorted ones."""
    if not len(among):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(among, values), len(among) - 1)
    return among[at] == values


def _both(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One hash of two, to compare edges within a chunk."""
    return mix(a ^ mix(b + _U(_BASE[2])))


def _first_of_each(values: np.ndarray) -> np.ndarray:
    """Whether an entry is the first with its value."""
    out = np.zeros(len(values), bool)
    out[np.unique(values, return_index=True)[1]] = True
    return out


def _ends(starts: np.ndarray, n: int) -> np.ndarray:
    """Where each group ends, given where it starts among n."""
    return np.append(starts[1:], n)[: len(starts)].astype(np.int64)


def _messages(receiver: np.ndarray, chunk: int, *columns: np.ndarray) -> pa.Table:
    """Messages of a chunk, one row for each receiver; rows of each column go to the receiver at their place."""
    order = np.argsort(receiver, kind="stable")
    found, at = np.unique(receiver[order], return_index=True)
    ends = _ends(at, len(receiver))
    packed = [[x[order[i:j]].tobytes() for i, j in zip(at, ends, strict=True)] for x in columns]
    packed += [[b""] * len(found)] * (3 - len(columns))
    return pa.table({"receiver": pa.array(found, pa.int32()), "chunk": pa.array(np.full(len(found), chunk), pa.int32())} | {name: pa.array(x, pa.binary()) for name, x in zip("abc", packed, strict=True)})


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Receivers of keys: below zero, to differ from chunks."""
    return -1 - (keys % _U(buckets)).astype(np.int64)


def _received(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The entries of a bucket: chunk, a, b."""
    a = [np.frombuffer(x, np.uint64) for x in table["a"].to_pylist()]
    b = [np.frombuffer(x, np.uint64) for x in table["b"].to_pylist()]
    chunk = np.repeat(table["chunk"].to_numpy(), [len(x) for x in a])
    return chunk, np.concatenate(a), np.concatenate(b)


def _answer(parts: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]) -> pa.Table:
    """Answers (kind, chunk, a, b), one row for each chunk and kind."""
    rows = []
    for kind, chunk, a, b in parts:
        order = np.argsort(chunk, kind="stable")
        chunk, a, b = chunk[order], a[order], b[order] if len(b) else b
        found, at = np.unique(chunk, return_index=True)
        for c, i, j in zip(found.tolist(), at, _ends(at, len(chunk)), strict=True):
            rows.append((c, kind, a[i:j].tobytes(), b[i:j].tobytes()))
    columns = list(zip(*rows, strict=True)) if rows else [(), (), (), ()]
    return pa.table({"chunk": pa.array(columns[0], pa.int32()), "kind": pa.array(columns[1], pa.int32()), "a": pa.array(columns[2], pa.binary()), "b": pa.array(columns[3], pa.binary())})


def _judge_units(table: pa.Table) -> pa.Table:
    """For each key in several chunks: whether it is one unit, and then its source as ``chunk << 32 | word``."""
    chunk, key, prints = _received(table)
    place = np.concatenate([np.frombuffer(x, np.uint32) for x in table["c"].to_pylist()])
    order = np.lexsort((chunk, key))
    chunk, key, prints, place = chunk[order], key[order], prints[order], place[order]
    new = np.r_[True, key[1:] != key[:-1]]
    bounds = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    low, high = np.minimum.reduceat(prints, bounds), np.maximum.reduceat(prints, bounds)
    several = np.diff(np.r_[bounds, len(key)]) > 1
    unit = (several & (low == high) & (low != _BRANCHES))[group] & ~new
    branching = (several & ((low != high) | (low == _BRANCHES)))[group]
    source = ((chunk.astype(np.uint64) << _U(32)) | place)[bounds][group]
    return _answer([(_UNIT_REPEATED, chunk[unit], key[unit], source[unit]), (_BRANCHING, chunk[branching], key[branching], key[:0])])


def _judge_edges(table: pa.Table) -> pa.Table:
    chunk, a, b = _received(table)
    order = np.lexsort((chunk, b, a))
    chunk, a, b = chunk[order], a[order], b[order]
    later = np.r_[False, (a[1:] == a[:-1]) & (b[1:] == b[:-1])]
    return _answer([(_EDGE_REPEATED, chunk[later], a[later], b[later])])


def _answers(table: pa.Table, kind: int) -> tuple[np.ndarray, np.ndarray]:
    rows = [(a, b) for k, a, b in zip(table["kind"].to_pylist(), table["a"].to_pylist(), table["b"].to_pylist(), strict=True) if k == kind]
    a, b = ([np.frombuffer(r[i], np.uint64) for r in rows] for i in (0, 1))
    return (np.concatenate(a) if a else np.zeros(0, np.uint64)), (np.concatenate(b) if b else np.zeros(0, np.uint64))


def _ordered(table: pa.Table, id_col: str, text_col: str) -> pa.Table:
    return table.take(pc.sort_indices(table, sort_keys=[(id_col, "ascending"), (text_col, "ascending")], null_placement="at_start"))


def _texts(table: pa.Table, id_col: str, text_col: str) -> pa.Array:
    return _ordered(table.select([id_col, text_col]), id_col, text_col)[text_col].combine_chunks()


class Verdict:
    """What the answers to a chunk say of its paths."""

    def __init__(self, p: Paths, chunk: int, answers: pa.Table):
        unit, source = _answers(answers, _UNIT_REPEATED)
        branching = _answers(answers, _BRANCHING)[0]
        keys, prints, first = p.units()
        self.apart = _member(p.key, np.sort(np.r_[branching, keys[prints == _BRANCHES]]))
        order = np.argsort(unit)
        unit, source = unit[order], source[order]
        known = _member(keys, unit)
        #: Of each distinct key, where its source is: elsewhere, or the first path here.
        at = (_U(chunk) << _U(32)) | p.starts[p.run[first]].astype(np.uint64)
        at[known] = source[np.searchsorted(unit, keys[known])]
        later = np.ones(len(p.run), bool)
        later[first] = known
        #: The repeated units, and the source of each.
        self.units = np.flatnonzero(~self.apart & later)
        self.source = at[np.searchsorted(keys, p.key[self.units])]

    def spans(self, p: Paths) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Units that are consecutive here and at the source, joined: first word here, words, and source."""
        start, size, source = p.starts[p.run[self.units]], p.size[self.units], self.source
        new = np.ones(len(start), bool)
        new[1:] = (start[1:] != start[:-1] + size[:-1]) | (source[1:] != source[:-1] + size[:-1].astype(np.uint64))
        at = np.flatnonzero(new)
        total = np.add.reduceat(size, at) if len(at) else size
        return start[at], total + p.window - 1, source[at]


def _repeated(p: Paths, chunk: int, answers: pa.Table) -> np.ndarray:
    """Which edges of a chunk start earlier too."""
    out = np.zeros(len(p.starts), bool)
    if not len(p.run):
        return out
    v = Verdict(p, chunk, answers)
    size = p.size[v.units]
    out[np.repeat(p.run[v.units], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)] = True
    for start, n in zip(*_answers(answers, _DIFFERENT), strict=True):
        at = int(np.searchsorted(p.starts, int(start)))
        out[at : at + int(n) - p.window + 1] = False
    at, a, b = p.edges(np.flatnonzero(v.apart))
    own = _both(a, b)
    known = np.sort(_both(*_answers(answers, _EDGE_REPEATED)))
    out[at] = ~_first_of_each(own) | _member(own, known)
    return out


class Digests:
    """Digests of spans of words, spaces apart."""

    def __init__(self, words: Words):
        self.words, self.raw, self.known = words, words.buf.tobytes(), {}

    def __call__(self, start: int, n: int) -> bytes:
        found = self.known.get((start, n))
        if found is None:
            w = self.words
            text = b" ".join([self.raw[i:j] for i, j in zip(w.starts[start : start + n].tolist(), w.ends[start : start + n].tolist(), strict=True)])
            found = self.known[start, n] = xxhash.xxh3_128_digest(text)
        return found


def _removed_words(p: Paths, repeated: np.ndarray) -> np.ndarray:
    n, starts = len(p.h), p.starts[repeated]
    return np.cumsum(np.bincount(starts, minlength=n + 1) - np.bincount(starts + p.window, minlength=n + 1))[:n] > 0


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """All columns of ``docs`` plus ``n_words``, ``n_removed``, ``spans`` (removed words as [start, end)) and ``kept``.

    ``kept`` is the words that stay, joined by one space.  Columns of these names are replaced.
    """
    docs = docs.drop("n_words", "n_removed", "spans", "kept")
    chunked, size = with_chunk(docs, id_col, text_col)
    buckets = max(partitions(docs), -(-size // BUCKET_BYTES))
    seed_words = min(SEED_WORDS, window)
    of = lambda table: Paths(_texts(table, id_col, text_col), window, seed_words)
    nothing = np.zeros(0, np.uint64)

    def send_units(table: pa.Table) -> pa.Table:
        p = of(table)
        keys, prints, first = p.units()
        return _messages(_bucket(keys, buckets), table[CHUNK][0].as_py(), keys, prints, p.starts[p.run[first]].astype(np.uint32) if len(first) else nothing)

    def send_edges_and_spans(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _messages(nothing.astype(np.int64), 0)
        p, chunk = of(table), table[CHUNK][0].as_py()
        if not len(p.run):
            return _messages(nothing.astype(np.int64), chunk)
        branching = np.sort(_answers(answers, _BRANCHING)[0])
        _, a, b = p.edges(np.flatnonzero(_member(p.key, branching)))
        first = _first_of_each(_both(a, b))
        edges = _messages(_bucket(a[first], buckets), chunk, a[first], b[first])
        start, n, source = Verdict(p, chunk, answers).spans(p)
        digest = Digests(p.words)
        prints = np.frombuffer(b"".join([digest(i, k) for i, k in zip(start.tolist(), n.tolist(), strict=True)]), "V16")
        place = np.stack([source & _U(0xFFFFFFFF), n.astype(np.uint64), start.astype(np.uint64)], 1)
        return pa.concat_tables([edges, _messages((source >> _U(32)).astype(np.int64), chunk, place, prints)])

    def judge(table: pa.Table, messages: pa.Table) -> pa.Table:
        """Edges of a bucket, or spans whose source is in a chunk."""
        if not messages.num_rows:
            return _answer([])
        if not table.num_rows:
            return _judge_edges(messages)
        words = Words(_texts(table, id_col, text_col))
        digest, wrong = Digests(words), []
        for chunk, places, prints in zip(messages["chunk"].to_pylist(), messages["a"].to_pylist(), messages["b"].to_pylist(), strict=True):
            places = np.frombuffer(places, np.uint64).reshape(-1, 3).astype(np.int64)
            for k, (start, n, there) in enumerate(places.tolist()):
                if digest(start, n) != prints[16 * k : 16 * k + 16]:
                    wrong.append((chunk, there, n))
        if not wrong:
            return _answer([])
        chunk, there, n = (np.array(x, np.int64) for x in zip(*wrong, strict=True))
        return _answer([(_DIFFERENT, chunk, there.astype(np.uint64), n.astype(np.uint64))])

    def resolve(table: pa.Table, answers: pa.Table) -> pa.Table:
        table = _ordered(table, id_col, text_col)
        texts = table[text_col].combine_chunks()
        p = Paths(texts, window, seed_words)
        gone = _removed_words(p, _repeated(p, table[CHUNK][0].as_py(), answers))
        offsets = p.words.offsets
        spans, kept, n_gone = [], [], []
        for d, text in enumerate(texts):
            low, high = offsets[d], offsets[d + 1]
            mine = gone[low:high]
            n = int(mine.sum())
            words = (text.as_py() or "").encode().split()
            turn = np.flatnonzero(np.diff(np.r_[False, mine, False])) if n else np.zeros(0, np.int64)
            spans.append([{"start": int(i), "end": int(j)} for i, j in turn.reshape(-1, 2)])
            if n:
                stay = np.r_[0, turn, len(words)].reshape(-1, 2)
                words = [w for i, j in stay for w in words[i:j]]
            kept.append(b" ".join(words).decode())
            n_gone.append(n)
        out = table.drop_columns([CHUNK])
        out = out.append_column("n_words", pa.array(np.diff(offsets), pa.int64())).append_column("n_removed", pa.array(n_gone, pa.int64()))
        return out.append_column("spans", pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))).append_column("kept", pa.array(kept, pa.string()))

    by_chunk = chunked.groupBy(CHUNK)
    units = by_chunk.applyInArrow(grouped(send_units), _MESSAGE).groupBy("receiver").applyInArrow(grouped(_judge_units), _ANSWER)
    sent = by_chunk.cogroup(units.groupBy("chunk")).applyInArrow(cogrouped(send_edges_and_spans), _MESSAGE)
    rest = by_chunk.cogroup(sent.groupBy("receiver")).applyInArrow(cogrouped(judge), _ANSWER)
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    added = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("spans", T.ArrayType(span)), T.StructField("kept", T.StringType())]
    return by_chunk.cogroup(units.unionByName(rest).groupBy("chunk")).applyInArrow(cogrouped(resolve), T.StructType([*docs.schema.fields, *added]))
