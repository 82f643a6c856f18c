"""Operators 1, 3, 5, 6 and 9 against plain versions, on whole small tables and edge cases."""

import base64
import gzip
import hashlib
import random
import re
from collections import defaultdict

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chronolith.llm import chat, fingerprints, mixing, queries, sentencepiece_bpe, warc

EDGE_DOCS = [
    (5, None, "en", None, 0),
    (1, "", None, "b", 0),
    (2, " \t\n ", "en", "a", 4),
    (3, "one two three four five six seven", "en", "a", 1),
    (4, "one two three four five six seven", "en", "a", 1),
    (7, "x" * 5000, "en", "B", 1),
    (8, "é😀 " * 3000, "en", "ä", 1),
    (9, "word " * 2000, None, "a", None),
    (9, "repeated id", None, "a", None),
]


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


@pytest.fixture(scope="module")
def library():
    import public_tokenizers

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(queries.PIECE_MODEL))


@pytest.fixture(scope="module")
def coder():
    return sentencepiece_bpe.encoder(queries.piece_model())


PARTS = ["a", "b", " ", "  ", "▁", "\n", "é", "😀", "日", "the", "ing", " th", "</s>", "<0x41>", "\t", "----", "\0", "    ", "1"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(PARTS), st.text(max_size=6)), max_size=40))
def test_encode_like_library(parts):
    import public_tokenizers

    coder = sentencepiece_bpe.encoder(queries.piece_model())
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(queries.PIECE_MODEL))
    text = "".join(parts).encode("utf-8", "ignore").decode()
    ids = sp.encode(text)
    assert coder.encode(text) == ids
    assert coder.decode(ids) == sp.decode(ids)


def test_decode_any_ids(coder, library):
    rnd = random.Random(3)
    for _ in range(3000):
        ids = [rnd.choice([rnd.randrange(32000), rnd.randrange(260)]) for _ in range(rnd.randrange(12))]
        assert coder.decode(ids) == library.decode(ids)


def test_op1(spark, sf, library):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for d in (docs, docs_of(spark, EDGE_DOCS), docs_of(spark, [])):
        got = sorted(map(tuple, queries.sentencepiece_digests(d, queries.piece_model()).collect()))
        want = []
        for r in d.collect():
            ids = library.encode(r["text"] or "")
            want.append((r["doc_id"], len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids) if ids else "")))
        assert got == sorted(want)


def test_encode_decode_columns(spark):
    d = docs_of(spark, EDGE_DOCS)
    model = queries.piece_model()
    out = sentencepiece_bpe.decode(sentencepiece_bpe.encode(d, model), model).collect()
    assert all(r["decoded"] == (r["text"] or "") for r in out)
    assert sentencepiece_bpe.encode(d.withColumn("ids", F.lit(1)), model).schema["ids"].dataType.simpleString() == "array<int>"


def test_op3(spark, sf):
    got = {r["page_id"]: r for r in queries.op3_warc(spark, sf).collect()}
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    assert len(got) == len(pages)
    for p in pages:
        data = (p["html"] or "").encode()
        r = got[p["page_id"]]
        assert r["payload_bytes"] == len(data)
        assert r["payload_digest"] == base64.b32encode(hashlib.sha1(data).digest()).decode()


def test_warc_duplicates_and_nulls(spark):
    rows = [(5, "u", "same"), (2, None, "same"), (9, "v\r\nx: y", "same"), (3, "w", None), (4, "w", ""), (None, "n", "same"), (None, None, "lone"), (7, "z", "é" * 9), (2, None, "same")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit("clash"))
    got = sorted((r["page_id"] if r["page_id"] is not None else -1, r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.page_digests(warc.round_trip(pages)).collect())
    assert got == sorted([(5, 4, "revisit", 2), (2, 4, "response", None), (2, 4, "response", None), (9, 4, "revisit", 2), (3, 0, "response", None), (4, 0, "revisit", 3), (-1, 4, "revisit", 2), (-1, 4, "response", None), (7, 18, "response", None)])
    assert warc.page_digests(warc.round_trip(pages.limit(0))).count() == 0


def test_warc_very_long_payloads(spark):
    rows = [(i, None, "é<b>" * 300_000) for i in (4, 2, 3)] + [(9, "u", "short"), (9, "u", "short"), (None, "u", "x" * 2_000_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("clash") for c in ("_sha", "_first", "_n", "_shared", "refers_to", "i", "u", "p", "r")})
    got = sorted((r["page_id"] if r["page_id"] is not None else -1, r["payload_bytes"], r["record_type"], r["refers_to"] or 0) for r in warc.page_digests(warc.round_trip(pages)).collect())
    assert got == [(-1, 2_000_000, "response", 0), (2, 1_500_000, "response", 0), (3, 1_500_000, "revisit", 2), (4, 1_500_000, "revisit", 2), (9, 5, "response", 0), (9, 5, "response", 0)]


def test_salvage():
    records = [gzip.compress(warc.record(i, "u", f"payload {i}".encode() * 50, None), mtime=0) for i in range(5)]
    whole = b"".join(records)
    assert [x.kind for x in warc.salvage(whole)] == ["record"] * 5
    broken = bytearray(whole)
    at = len(records[0]) + len(records[1])
    broken[at + 40] ^= 0xFF
    found = list(warc.salvage(bytes(broken)))
    assert [x.kind for x in found] == ["record", "record", "gap", "record", "record"]
    assert (found[2].offset, found[2].length) == (at, len(records[2]))
    cut = whole[: len(records[0]) + 30] + b"garbage" + records[3]
    assert [x.kind for x in warc.salvage(cut)] == ["record", "gap", "record"]
    plain = warc.record(1, None, b"a") + b"noise WARC/1.0\r\nbad" + warc.record(2, None, b"b") + b"tail"
    found = list(warc.salvage(plain))
    assert [x.kind for x in found] == ["record", "gap", "record", "gap"]
    assert [x.payload for x in found if x.kind == "record"] == [b"a", b"b"]
    tampered = warc.record(1, None, b"abc").replace(b"abc", b"abd") + warc.record(2, None, b"b")
    assert [x.kind for x in warc.salvage(tampered)] == ["gap", "record"]
    assert list(warc.salvage(b"")) == []


def test_salvage_inside_a_member():
    """Intact records of a damaged member of several records are found."""
    rnd = random.Random(2)
    plain = [warc.record(i, "u", rnd.randbytes(3000), None) for i in range(6)]
    whole, other = gzip.compress(b"".join(plain), mtime=0), gzip.compress(warc.record(9, "u", b"last", None), mtime=0)
    kinds = lambda data: [x.kind for x in warc.salvage(bytes(data))]
    assert kinds(whole + other) == ["record"] * 7
    assert kinds(whole[: len(whole) * 3 // 4]) == ["record"] * 4 + ["gap"]
    bad = bytearray(whole)
    bad[-8] ^= 0xFF
    assert kinds(bad + other) == ["record"] * 6 + ["gap", "record"]
    first = gzip.compress(b"XXXX" + b"".join(plain)[4:], mtime=0)
    assert kinds(first) == ["gap"] + ["record"] * 5


def brute_op5(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] is not None, r[1] or ""))
    out = []
    for k, (i, text) in enumerate(order):
        text, other = text or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        out.append((i, len(text), sha(text[: len(text) - half] + other[:half])))
    return out


def test_op5(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for d in (docs, docs_of(spark, EDGE_DOCS), docs_of(spark, EDGE_DOCS[:1]), docs_of(spark, [])):
        got = fingerprints.edit_study(d).collect()
        assert sorted((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == sorted(brute_op5([(r["doc_id"], r["text"]) for r in d.collect()]))
        text = {}
        for r in got:
            assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    by = defaultdict(set)
    for r in fingerprints.fingerprints(docs).join(docs, "doc_id").collect():
        by[r["text"]].add(r["fingerprint"])
    assert all(len(v) == 1 for v in by.values())


def test_likeness_estimates_jaccard():
    import pyarrow as pa

    rnd = random.Random(1)
    words = [f"w{rnd.randrange(10**6)}" for _ in range(1000)]
    a, b = " ".join(words[:800]), " ".join(words[200:])
    sig = fingerprints.signatures(pa.array([a, b, "", None, "x"]))
    assert abs(fingerprints.likeness(sig[:1], sig[1:2])[0] - 596 / 996) < 0.15
    assert fingerprints.likeness(sig[2:3], sig[3:4])[0] == 1
    assert fingerprints.likeness(sig[2:3], sig[4:5])[0] == 0


def check_mix(rows, got):
    words = [len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in rows]
    size = defaultdict(int)
    for r, n in zip(rows, words, strict=True):
        size[r["source"]] += n
    order = sorted(size, key=lambda s: (s is None, s or ""))
    goal, left, open_ = {}, 1.5 * sum(words), [(s, (3, 1, 2)[i % 3]) for i, s in enumerate(order)]
    while open_:
        unit = left / sum(w for _, w in open_)
        full = [s for s, w in open_ if unit * w > 2 * size[s]]
        if not full:
            goal |= {s: unit * w for s, w in open_}
            break
        goal |= {s: 2.0 * size[s] for s in full}
        left -= sum(2 * size[s] for s in full)
        open_ = [(s, w) for s, w in open_ if s not in full]
    source = defaultdict(set)
    for r in rows:
        source[r["doc_id"]].add(r["source"])
    assert sorted((r["doc_id"], r["size"]) for r in got) == sorted((r["doc_id"], n) for r, n in zip(rows, words, strict=True))
    taken = defaultdict(int)
    for r in got:
        (s,) = source[r["doc_id"]]
        assert r["source_size"] == size[s] and abs(r["target"] - goal[s]) < 1e-6 * (1 + goal[s])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    for s, t in taken.items():
        assert abs(t - goal[s]) <= 1, (s, t, goal[s])


def test_op6(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for d in (docs, docs_of(spark, EDGE_DOCS), docs_of(spark, EDGE_DOCS[:2]), docs_of(spark, [])):
        first = mixing.taken_words(d).collect()
        check_mix(d.collect(), first)
        assert sorted(first) == sorted(mixing.taken_words(d.repartition(3)).collect())


def test_small_sources_give_their_targets(spark):
    """Full blocks of 256 words for a few large sources, and many sources below a block."""
    sizes = {f"big{i}": 20_000 for i in range(3)} | {f"tiny{i:03}": (3, 40, 150, 300)[i % 4] for i in range(200)}
    rows = [(i, "w " * n, "en", name, 1) for i, (name, n) in enumerate(sizes.items())]
    docs = docs_of(spark, rows)
    for share in (1.5, 0.01):
        got = mixing.taken_words(docs, share=share).collect()
        assert all(r["taken"] == max(1, round(r["target"])) for r in got)
        p, _, mix = mixing.mix(docs, share=share)
        mixed = mix.collect()
        assert p.block_words == 256 and sorted({r["slot"] for r in mixed}) == list(range(p.slots))
        taken = defaultdict(int)
        for r in mixed:
            taken[r["doc_id"]] += r["words"]
        assert taken == {r["doc_id"]: r["taken"] for r in got}


def test_mix_of_clashing_columns_and_long_texts(spark):
    """Other columns change nothing, whatever their names; a text of a million words is cut like any other."""
    d = docs_of(spark, [*EDGE_DOCS, (20, "long " * 1_000_000, "en", "a", 1)])
    clash = d.withColumns({c: F.lit("clash") for c in ("size", "start", "block", "word", "words", "bucket", "place", "target", "source_index", "source_size", "slot", "rank", "upto", "_key")})
    plain, other = (sorted((tuple(r) for r in mixing.taken_words(x).collect()), key=str) for x in (d, clash))
    assert plain == other and len(plain) == len(EDGE_DOCS) + 1
    assert all(taken <= 2 * size for _, size, _, _, taken in plain)
    goals, taken = {}, defaultdict(int)
    for _, _, words, target, t in plain:
        goals[words, target] = target
        taken[words, target] += t
    assert all(abs(taken[k] - target) <= 1 for k, target in goals.items())


def test_schedule_is_even(spark):
    p = mixing.Plan(tuple(mixing.Source(i, str(i), 10_000_000, t) for i, t in enumerate((300_000.0, 100_000.0, 0.0, 200_000.0))), 10, 2.0)
    rows = mixing.schedule(spark, p).orderBy("slot").collect()
    assert [r["slot"] for r in rows] == list(range(60_000))
    seen = [0] * 4
    for k, r in enumerate(rows, 1):
        assert r["rank"] == seen[r["source_index"]]
        seen[r["source_index"]] += 1
        if k % 997 == 0:
            assert all(abs(seen[i] - k * w) < 8 for i, w in enumerate((1 / 2, 1 / 6, 0, 1 / 3)))


def brute_chat(rows):
    out = []
    by = defaultdict(list)
    for r in rows:
        by[r[0]].append(r)
    for conv, turns in by.items():
        turns = sorted(((t, r or "", x or "") for _, t, r, x in turns), key=lambda t: (t[0] is not None, t))
        learned = "".join(x for _, r, x in turns if r == "assistant")
        out.append((conv, len(turns), sha("".join(f"{r}\n{x}\n" for _, r, x in turns)), len(learned), sha(learned)))
    return sorted(out, key=str)


def test_op9(spark, sf):
    got = sorted((tuple(r)[:5] for r in queries.op9_chat(spark, sf).collect()), key=str)
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    said = "</s>[INST] ok [/INST]"
    assert got == brute_chat([*rows, (-1, 0, "user", said), (-1, 1, "assistant", said)])


@settings(max_examples=20, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([None, "user", "assistant", "a\nb", "&#10;"]), st.lists(st.sampled_from(["<", "<s>", "</s>", "[", "[INST]", "[/INST]", "&", "amp;", "&lt;", "\n", "é", "&#91;"]), max_size=6)), max_size=5))
def test_chat_escapes(spark, turns):
    rows = [(1, k, r, "".join(x)) for k, (r, x) in enumerate(turns)]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.format_chats(chat.reconstruct(chat.messages_as_events(d))).select(chat.parse(F.col("formatted")).alias("t"), chat.loss_text(F.col("formatted"), F.col("loss")).alias("l")).collect()
    want = [(r or "", x) for _, _, r, x in rows]
    assert [[tuple(t) for t in r["t"]] for r in out] == ([want] if rows else [])
    assert [r["l"] for r in out] == (["".join(x for r, x in want if r == "assistant")] if rows else [])


def test_events_fold(spark):
    ev = [
        (1, 1, "message", "user", "hi", None), (1, 2, "message", "assistant", "", None), (1, 3, "delta", None, "He", 2), (1, 4, "delta", None, "llo", 2),
        (1, 5, "regenerate", None, None, 2), (1, 6, "delta", None, "Good", 2), (1, 7, "delta", None, " day", 2), (1, 8, "edit", None, "hi!", 1), (1, 9, "delta", None, "lost", 77),
    ]
    d = spark.createDataFrame(ev, "conv_id long, seq long, kind string, role string, text string, target long")
    got = [(r["seq"], r["role"], r["text"]) for r in chat.reconstruct(d).orderBy("seq").collect()]
    assert got == [(1, "user", "hi!"), (2, "assistant", "Good day")]


def test_events_of_other_kinds_and_odd_rows(spark):
    ev = [
        (1, 1, "message", "assistant", "yes", None), (1, 2, "tool_call", None, "secret", 1), (1, 2, None, None, "none", 1), (1, 3, "DELTA", None, "!", 1), (None, 5, "message", "user", "no id", None),
        (2, None, "message", "user", "first", 9), (2, 1, "message", "user", "x" * 300_000, 8), (2, 1, "message", "user", "a", 7), (2, 1, "message", "user", "a", 6), (2, 4, "delta", None, "b", 9),
    ]
    d = spark.createDataFrame(ev, "conv_id long, seq long, kind string, role string, text string, target long").withColumns({"e": F.lit(1), "at": F.lit(2), "ts": F.lit(3), "formatted": F.lit(4)})
    out = {r["conv_id"]: [t["text"] for t in r["t"]] for r in chat.format_chats(chat.reconstruct(d)).select("conv_id", chat.parse(F.col("formatted")).alias("t")).collect()}
    assert out == {1: ["yes!"], None: ["no id"], 2: ["firstb", "a", "a", "x" * 300_000]}
    assert chat.format_chats(chat.reconstruct(d.limit(0))).count() == 0


def test_streamed_log_folds_to_the_turns(spark):
    rows = [(c, t, r, x) for c in (1, 2, None) for t in (None, 1, 2, 3, 3) for r, x in (("user", "é😀 ok"), ("assistant", "abcdefg"), ("assistant", None), (None, ""))] * 2
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("target", F.lit("clash"))
    log = chat.streamed_log(d)
    assert {r["kind"] for r in log.collect()} == {"message", "delta", "edit", "regenerate"}
    got = sorted((tuple(r) for r in chat.reconstruct(log).collect()), key=str)
    assert got == sorted(((c, t, r or "", x or "") for c, t, r, x in rows), key=str)


def test_package_is_shipped(spark, tmp_path, monkeypatch):
    """Workers can import the package wherever the driver was started."""
    from chronolith.llm import common

    monkeypatch.chdir(tmp_path)
    monkeypatch.delenv("PYTHONPATH", raising=False)
    monkeypatch.setattr(common, "_shipped", set())
    added = []
    monkeypatch.setattr(spark.sparkContext, "addPyFile", added.append)
    common.ship(spark)
    common.ship(spark)
    assert len(added) == 1 and added[0].endswith(".zip")
