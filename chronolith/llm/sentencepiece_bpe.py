"""SentencePiece BPE encoding and decoding by a prefix table.

In a merge-type vocabulary, the encodings of all prefixes of a text are consistent:
the encoding of a prefix is the encoding of a shorter prefix plus one last token.
So one forward pass stores each prefix's unique last token.  An automaton over the
pieces lists the tokens that end at a position; the right one is that which is
compatible with the last token of the prefix before it.  Walking the table backwards
gives the ids.

Texts are first cut where no piece of the vocabulary spans two characters; no merge
crosses such a cut, so each part is encoded alone and cached.

Defined results: null text and empty text have no ids and decode to the empty string;
characters outside the vocabulary become byte tokens.  A column of the result's name is
replaced.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from itertools import chain

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import kept, streamed

SPACE = "▁"
#: Entries of each generation of a cache; longer keys are not kept.
_MAX_CACHED, _LONG = 150_000, 200
#: Above all ids.
_OTHER = 1 << 20
#: The name under which workers keep their encoders.
KEPT = "sentencepiece"


class Vocabulary:
    """Pieces, merge ranks and the last merge that makes each piece."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2

        spec = sentencepiece_model_pb2.ModelProto()
        spec.ParseFromString(model)
        norm = spec.normalizer_spec
        if spec.trainer_spec.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or not norm.add_dummy_prefix or spec.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only BPE models with identity normalisation, a dummy prefix and kept white space are supported")
        kinds = [p.type for p in spec.pieces]
        if any(k in (4, 5) for k in kinds):
            raise ValueError("models with user-defined or unused pieces are not supported")
        self.pieces = [p.piece for p in spec.pieces]
        self.unknown = kinds.index(2)
        self.control = {i for i, k in enumerate(kinds) if k == 3}
        self.byte_ids = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, kinds, strict=True)) if k == 6}
        self.unknown_surface = spec.trainer_spec.unk_surface.encode()
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, kinds, strict=True)) if k == 1}
        scores = {p: spec.pieces[i].score for p, i in self.ids.items()}
        rank = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        self.rank = {p: rank[s] for p, s in scores.items()}
        #: Pairs of characters that stand side by side in some piece.
        self.inner = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.split: dict[str, tuple[str, str] | None] = {}
        for p in self.ids:
            last = self._last_merge(p)
            if last is not False:
                self.split[p] = last

    def _last_merge(self, piece: str) -> tuple[str, str] | None | bool:
        """Merge the characters of a piece by the rules: its last merge, None for one character, False if the piece can't arise."""
        parts, last = list(piece), None
        while len(parts) > 1:
            best = min(((self.rank[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.rank), default=None)
            if best is None:
                return False
            i = best[1]
            last = (parts[i], parts[i + 1])
            parts[i : i + 2] = ["".join(last)]
        return last


class _Cache(dict):
    """Results of a function, in two generations: when the young one is full, it becomes the old one."""

    def __init__(self, make: Callable[[str], tuple[int, ...]]):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, key: str) -> tuple[int, ...]:
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
        if len(key) <= _LONG:
            if len(self) >= _MAX_CACHED:
                self.old = dict(self)
                self.clear()
            self[key] = found
        return found


class Encoder:
    """Encodes and decodes texts; one for each Python worker and model."""

    def __init__(self, model: bytes):
        self.vocab = v = Vocabulary(model)
        self.automaton = ahocorasick.Automaton()
        for p in v.split:
            self.automaton.add_word(p, (v.ids[p], len(p)))
        self.automaton.make_automaton()
        #: Whether token b may follow token a, by ``a << 20 | b``.
        self.compatible: dict[int, bool] = {}
        self.surface = [p.replace(SPACE, " ").encode() for p in v.pieces]
        for b, i in v.byte_ids.items():
            self.surface[i] = bytes([b])
        for i in v.control:
            self.surface[i] = b""
        self.surface[v.unknown] = v.unknown_surface
        self.parts = _Cache(self._by_prefix_table)
        self.segments = _Cache(self._by_parts)

    def release(self) -> None:
        """Drop what was not used of late: a worker outlives its task."""
        self.segments.old, self.parts.old = {}, {}

    def _joins(self, left: str, right: str) -> bool:
        """Whether ``left`` then ``right`` is the encoding of their concatenation.

        Merges run by rank, then from the left.  Undo them from the last back: had the
        two tokens at the boundary had a merge that comes before the one just undone,
        that merge would have taken place instead.
        """
        rank, split = self.vocab.rank, self.vocab.split
        a, b = left, right
        undone: tuple[int, int] = (1 << 30, 0)  # rank of the undone merge; 0: it stands left of the boundary, 1: right
        while True:
            r = rank.get(a + b)
            if r is not None and (r < undone[0] or (r == undone[0] and undone[1])):
                return False
            cut_a, cut_b = split.get(a), split.get(b)
            if cut_a is None and cut_b is None:
                return True
            if cut_b is None or (cut_a is not None and rank[a] > rank[b]):
                undone, a = (rank[a], 0), cut_a[1]
            else:
                undone, b = (rank[b], 1), cut_b[0]

    def _cut(self, segment: str) -> Iterator[str]:
        inner, start = self.vocab.inner, 0
        for i in range(1, len(segment)):
            if segment[i - 1 : i + 1] not in inner:
                yield segment[start:i]
                start = i
        yield segment[start:]

    def _by_parts(self, segment: str) -> tuple[int, ...]:
        parts = list(self._cut(segment))
        if len(parts) == 1:  # the segment itself will be cached
            return self._by_prefix_table(segment)
        return tuple(chain.from_iterable([self.parts[p] for p in parts]))

    def _by_prefix_table(self, part: str) -> tuple[int, ...]:
        """Last tokens of all prefixes, then the ids backwards.

        A character outside the vocabulary stands alone, as ``_OTHER`` plus its code point.
        """
        if part in self.vocab.split:
            return (self.vocab.ids[part],)
        last: list[int] = []
        sizes: list[int] = []
        add, add_size, known = last.append, sizes.append, self.compatible
        if len(known) > 2 * _MAX_CACHED:
            known.clear()
        done = 0  # prefixes whose last token is found
        for end, (token, size) in self.automaton.iter(part):
            if end < done:
                continue
            while done < end:
                add(_OTHER + ord(part[done]))
                add_size(1)
                done += 1
            before = end - size
            if before >= 0:
                key = last[before] << 20 | token
                fits = known.get(key)
                if fits is None:
                    fits = known[key] = self._joins(self._piece(last[before]), self.vocab.pieces[token])
                if not fits:
                    continue
            add(token)
            add_size(size)
            done += 1
        for c in part[done:]:
            add(_OTHER + ord(c))
            add_size(1)
        ids: list[int] = []
        i, byte_ids = len(part) - 1, self.vocab.byte_ids
        while i >= 0:
            token = last[i]
            if token < _OTHER:
                ids.append(token)
            elif byte_ids:
                ids.extend(byte_ids[b] for b in reversed(chr(token - _OTHER).encode()))
            else:
                ids.append(self.vocab.unknown)
            i -= sizes[i]
        ids.reverse()
        return tuple(ids)

    def _piece(self, token: int) -> str:
        return self.vocab.pieces[token] if token < _OTHER else chr(token - _OTHER)

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        words = text.replace(SPACE, " ").split(" ")
        if "" in words:
            marked = (SPACE + text).replace(" ", SPACE)
            words = [w[1:] if w[0] == SPACE else w for w in re.findall(f"{SPACE}*[^{SPACE}]+|{SPACE}+", marked)]
        get = self.segments
        return list(chain.from_iterable([get[SPACE + w] for w in words]))

    def decode_bytes(self, ids: Sequence[int]) -> bytes:
        """The decoded text in UTF-8: one leading space goes, bytes that form no character become U+FFFD."""
        surface, control = self.surface, self.vocab.control
        out = b"".join([surface[i] for i in ids])
        try:
            out.decode()
            plain = control.isdisjoint(ids)
        except UnicodeDecodeError:
            plain = False
        if not plain:
            out = self._by_byte_runs(ids)
        for i in ids:
            if i not in control:
                return out[1:] if self.vocab.pieces[i].startswith(SPACE) else out
        return out

    def _by_byte_runs(self, ids: Sequence[int]) -> bytes:
        """Each run of byte tokens is decoded by itself; a byte that begins no character becomes U+FFFD."""
        run, out = b"", []
        from_byte = set(self.vocab.byte_ids.values())
        for i in [*ids, None]:
            if i in from_byte:
                run += self.surface[i]
                continue
            at = 0
            while at < len(run):
                for size in (1, 2, 3, 4):
                    try:
                        run[at : at + size].decode()
                    except UnicodeDecodeError:
                        continue
                    out.append(run[at : at + size])
                    at += size
                    break
                else:
                    out.append("\ufffd".encode())
                    at += 1
            run = b""
            if i is not None:
                out.append(self.surface[i])
        return b"".join(out)

    def decode(self, ids: Sequence[int]) -> str:
        return self.decode_bytes(ids).decode()


def encoder(model: bytes) -> Encoder:
    """The worker's encoder of a model; it holds one model at a time, and tasks of other operators drop it."""
    found = kept(KEPT, dict)
    if model not in found:
        found.clear()
        found[model] = Encoder(model)
    return found[model]


def read_model(path: str) -> bytes:
    """The model file's bytes (about half a megabyte); they travel to the executors with the task."""
    with open(path, "rb") as f:
        return f.read()


def _mapped(df: DataFrame, model: bytes, column: str, out: str, kind: T.DataType, arrow: pa.DataType, apply: Callable) -> DataFrame:
    kept = [c for c in df.columns if c != out]
    schema = T.StructType([*(df.schema[c] for c in kept), T.StructField(out, kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(model)
        try:
            for batch in batches:
                values = batch.column(batch.schema.get_field_index(column))
                yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), pa.array([apply(coder, x.as_py()) for x in values], arrow)], [*kept, out])
        finally:
            coder.release()

    return df.mapInArrow(streamed(run, KEPT), schema)


def encode(df: DataFrame, model: bytes, text_col: str = "text", out: str = "ids") -> DataFrame:
    """Add the ids of each whole text as array<int>.  Null and empty texts have an empty array."""
    return _mapped(df, model, text_col, out, T.ArrayType(T.IntegerType()), pa.list_(pa.int32()), Encoder.encode)


def decode(df: DataFrame, model: bytes, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """Add the text of each id array.  A null array decodes to the empty string."""
    return _mapped(df, model, ids_col, out, T.StringType(), pa.string(), lambda coder, ids: coder.decode(ids or []))
