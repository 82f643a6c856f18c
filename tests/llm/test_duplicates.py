"""Operators 2 and 4 against brute force, on random near copies, whole small tables and edge cases."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from chronolith.llm import common, graph, ngram_join, substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
EDGES = [
    (None, "null id " * 30), (None, None), (1, None), (2, ""), (3, " \n"), (4, "Only Three words"), (5, "only three words"), (6, "a " * 500), (7, "a " * 300),
    (8, "x" * 30000), (9, "é😀" * 10), (10, "only three"), (11, "same id, one text " * 8), (11, "same id, other text " * 8), (11, None), (12, "same id, one text " * 8),
    (13, "same id, other text " * 8), (14, "twice"), (14, "twice"),
]


def random_docs(seed, n=150):
    """Groups of copies, chains of near copies, light and heavy sets, shared passages."""
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(4000)]
    passage = [rnd.choice(vocabulary) for _ in range(rnd.randrange(20, 60))]
    texts = []
    while len(texts) < n:
        kind = rnd.random()
        if not texts or kind < 0.3:
            words = [rnd.choice(vocabulary) for _ in range(rnd.choice([1, 3, 4, 9, 14, 17, 20, 24, 30, 80, 200]))]
        else:
            words = list(rnd.choice(texts))
            for _ in range(rnd.choice([0, 1, 1, 2, 4])):
                at = rnd.randrange(len(words) + 1)
                words[at : at + rnd.choice([0, 1, 1])] = [rnd.choice(vocabulary) for _ in range(rnd.choice([0, 1, 1]))]
        if kind > 0.85:
            at = rnd.randrange(len(words) + 1)
            words[at:at] = passage
        texts.append(words)
    ids = rnd.sample(range(10 * n), n)
    return [(i, " ".join(w).replace("w", rnd.choice("wW")) if w else "") for i, w in zip(ids, texts, strict=True)]


def table(spark, rows):
    return spark.createDataFrame([(*r, "en", 1) for r in rows], "doc_id long, text string, lang string, class int")


def brute_components(rows, width=4, percent=85):
    sets = []
    for i, text in rows:
        words = [w for w in WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))]
        sets.append((i, {tuple(words[k : k + width]) for k in range(len(words) - width + 1)} if len(words) >= width else {tuple(words)} if words else set()))
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            (i, s), (j, t) = sets[a], sets[b]
            if i is not None and j is not None and s and t and 100 * len(s & t) >= percent * len(s | t):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return sorted(((i, len(s), None if i is None else find(i)) for i, s in sets), key=str)


def components(spark, rows, width=4, percent=85):
    return sorted((tuple(r) for r in ngram_join.component_table(table(spark, rows), width, percent, 100).collect()), key=str)


@pytest.mark.parametrize(("seed", "width", "percent"), [(1, 4, 85), (2, 5, 80), (3, 1, 60)])
def test_components_random(spark, seed, width, percent):
    rows = random_docs(seed)
    want = brute_components(rows, width, percent)
    assert len({c for _, _, c in want}) < len(rows) - 20
    assert components(spark, rows, width, percent) == want


def test_components_edges(spark):
    assert components(spark, EDGES) == brute_components(EDGES)
    assert ngram_join.component_table(table(spark, [])).count() == 0


def test_components_large_group_is_linear(spark):
    """A group of near copies is verified against pivots: the pairs stay near the number of sets."""
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(300):
        mine = list(words)
        mine[rnd.randrange(120)] = f"new{i}"
        rows.append((i, " ".join(mine)))
    assert {c for _, _, c in components(spark, rows)} == {0}


@pytest.mark.parametrize(("hot_rows", "broadcast_rows"), [(1, 3), (4, 200_000), (1000, 0)])
def test_components_hot_keys(spark, monkeypatch, hot_rows, broadcast_rows):
    """Keys that are joined by broadcast, those beyond its bound, and none: the components are those of brute force."""
    monkeypatch.setattr(common, "HOT_ROWS", hot_rows)
    monkeypatch.setattr(common, "BROADCAST_ROWS", broadcast_rows)
    rows = random_docs(8, 60) + [(1000 + k, "one text that many rows have in common") for k in range(20)]
    rows += [(2000 + k, " ".join(f"n{i}" if i != 3 * k else "other" for i in range(60))) for k in range(20)]
    assert components(spark, rows) == brute_components(rows)


def test_hand_out_is_an_inner_join(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 2)
    monkeypatch.setattr(common, "BROADCAST_ROWS", 1)
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (2, "c"), (2, "d"), (2, "e"), (2, "f"), (3, "g"), (4, "h")], "k long, v string")
    values = spark.createDataFrame([(1, 3, "x"), (2, 4, "y"), (3, 1, None), (5, 9, "z")], "k long, n long, w string")
    want = sorted((tuple(r) for r in rows.join(values.drop("n"), "k").collect()), key=str)
    for given in (values, values.where("k = 3"), values.limit(0)):
        got = sorted((tuple(r) for r in common.hand_out(rows, given, "k").collect()), key=str)
        keys = {r["k"] for r in given.collect()}
        assert got == [r for r in want if r[0] in keys]


def test_boundary_and_subsets():
    assert ngram_join.least_overlap(12, 12, 85, 100) == 12
    assert ngram_join.least_overlap(13, 13, 85, 100) == 12
    for a in range(1, 40):
        for b in range(a, 60):
            c = ngram_join.least_overlap(a, b, 85, 100)
            assert 100 * c >= 85 * (a + b - c) and 100 * (c - 1) < 85 * (a + b - c + 1)
            if c <= a:
                assert c in ngram_join.subset_sizes(a, 85, 100) and c in ngram_join.subset_sizes(b, 85, 100)
                assert c >= a - ngram_join.prefix_length(a, 85, 100) + 1 and c >= b - ngram_join.prefix_length(b, 85, 100) + 1
    assert ngram_join.boundary({6: 10, 300: 1000}, 85, 100) >= 6
    assert ngram_join.boundary({}, 85, 100) == 0


def test_connected_components(spark):
    rnd = random.Random(2)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1064)] + [(5, None), (None, 5), (7, 7)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            root[max(find(a), find(b))] = min(find(a), find(b))
    got = {r["node"]: r["component"] for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in list(root)}


def brute_repeats(rows, window):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    seen, out = set(), []
    for i, text in rows:
        words = WORD.findall(text or "")
        gone = [False] * len(words)
        for k in range(len(words) - window + 1):
            edge = tuple(words[k : k + window])
            if edge in seen:
                gone[k : k + window] = [True] * window
            seen.add(edge)
        out.append((i, len(words), sum(gone), " ".join(w for w, g in zip(words, gone, strict=True) if not g)))
    return sorted(out, key=str)


def repeats(spark, rows, window):
    got = substring_dedup.remove_repeats(table(spark, rows).withColumnRenamed("class", "units"), window=window).collect()
    for r in got:
        assert sum(s["end"] - s["start"] for s in r["spans"]) == r["n_removed"]
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in got), key=str)


@pytest.mark.parametrize(("seed", "window"), [(1, 20), (2, 20), (3, 5), (4, 9)])
def test_repeats_random(spark, seed, window):
    rows = random_docs(seed)
    assert repeats(spark, rows, window) == brute_repeats(rows, window)


def test_repeats_edges(spark):
    for window in (2, 20):
        assert repeats(spark, EDGES, window) == brute_repeats(EDGES, window)
    assert substring_dedup.remove_repeats(table(spark, []).drop("class")).count() == 0
    clash = table(spark, EDGES).withColumns({"kept": F.lit(1), "chunk": F.lit(2)}).drop("class")
    assert substring_dedup.remove_repeats(clash, window=2).select("kept").distinct().count() > 3


def test_repeats_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = sorted((r["doc_id"], r["n_removed"], hashlib.sha256(r["kept"].encode()).hexdigest()) for r in substring_dedup.remove_repeats(docs).collect())
    want = sorted((i, n, hashlib.sha256(k.encode()).hexdigest()) for i, _, n, k in brute_repeats([(r["doc_id"], r["text"]) for r in docs.collect()], 20))
    assert got == want


def test_spans_that_differ_are_kept():
    """A span whose digest differs from that of its source is not removed."""
    import numpy as np
    import pyarrow as pa

    text = " ".join(f"w{i}" for i in range(60))
    p = substring_dedup.Paths(pa.array([text, "other words here", text]), 10)
    none = substring_dedup._answer([])
    assert substring_dedup._removed_words(p, substring_dedup._repeated(p, 7, none)).sum() == 60
    start, n, source = substring_dedup.Verdict(p, 7, none).spans(p)
    assert (start.tolist(), n.tolist(), source.tolist()) == ([63], [60], [7 << 32])
    digest = substring_dedup.Digests(p.words)
    assert digest(63, 60) == digest(0, 60) != digest(1, 60)
    wrong = substring_dedup._answer([(substring_dedup._DIFFERENT, np.array([7]), start.astype(np.uint64), n.astype(np.uint64))])
    assert not substring_dedup._repeated(p, 7, wrong).any()


def test_class_ids_that_stand_for_two_sets(spark):
    """With class ids of four bits nearly every id clashes; the components are those of brute force."""
    rows = random_docs(4, 80)
    got = sorted((tuple(r) for r in ngram_join.component_table(table(spark, rows), 2, 70, 100, class_bits=4).collect()), key=str)
    assert got == brute_components(rows, 2, 70)


def test_long_document_that_shares_passages(spark):
    """One very long text, with a passage of each of many others, and a near copy of it."""
    rnd = random.Random(9)
    others = [[f"t{i}_{k}" for k in range(60)] for i in range(80)]
    long = [w for o in others for w in o[10:40]] + [f"own{k}" for k in range(3000)]
    copy = list(long)
    for _ in range(20):
        copy[rnd.randrange(len(copy))] = "changed"
    rows = [(i, " ".join(o)) for i, o in enumerate(others)] + [(900, " ".join(long)), (500, " ".join(copy)), (901, " ".join(others[3][:-1]))]
    assert components(spark, rows) == brute_components(rows)


def test_chunks_cut_ids_that_many_rows_share(spark):
    """Small chunks, a third of all rows without an id: results are those of brute force, and the rows are spread."""
    from chronolith.llm import chunks, fingerprints

    rnd = random.Random(6)
    rows = [(None if i % 3 == 0 else i, " ".join(rnd.choice(["a", "b", "c", "dd"]) for _ in range(rnd.randrange(1, 80)))) for i in range(600)]
    d = table(spark, rows).withColumnRenamed("class", "n_chars")
    for down in (False, True):
        spread, size = chunks.with_chunk(d, "doc_id", descending=down, chunk_bytes=2000)
        counts = [r["count"] for r in spread.groupBy(chunks.CHUNK).count().collect()]
        assert size > 50_000 and len(counts) > 20 and max(counts) < 60
    old = chunks.CHUNK_BYTES
    chunks.CHUNK_BYTES = 2000
    try:
        assert repeats(spark, rows, 5) == brute_repeats(rows, 5)
        got = sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in fingerprints.edit_study(d).collect()), key=str)
    finally:
        chunks.CHUNK_BYTES = old
    from tests.llm.test_digests import brute_op5

    assert got == sorted(brute_op5(rows), key=str)
