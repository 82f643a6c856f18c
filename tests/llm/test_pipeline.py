"""The pipeline's stages against brute force."""

import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from chronolith.llm import mixing, queries, sentencepiece_bpe
from tests.llm.test_duplicates import brute_components, brute_repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars", "kept", "rank"]
ROWS = [
    (1, "the cat and the dog of the house " * 4, "en", "a", 5, 1, "x"),
    (1, "the cat and the dog of the house " * 4, "en", "a", 5, 1, "x"),
    (2, "the cat and the dog of the house " * 4, "en", None, None, None, None),
    (3, None, None, "b", None, 1, None),
    (4, "", "en", "b", 0, 1, "y"),
    (None, "a text without an id, about the cat", "en", "b", 3, 2, "y"),
    (6, "!!! ???", "en", "a", 7, 2, "y"),
    (7, "die Katze und der Hund von dem Haus, " + "wort " * 700, "de", "c", 7, 2, "y"),
    (8, "short", "en", "c", 7, 2, "y"),
    (9, "short", "de", "c", 7, 2, "z"),
    (8, "another text of the same id", "en", "c", 7, 2, "y"),
]


def edge_docs(spark, rows=ROWS):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept int, rank string")


def texts(df):
    return sorted((tuple(r) for r in df.select("doc_id", "text").collect()), key=str)


def test_stages_on_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = cp.language(spark, docs, sf)
    assert kept.columns == docs.columns
    rows = texts(kept)
    gone = set(texts(docs)) - set(rows)
    assert all(not re.search(r"[^\W_]", t or "") or len(t) < 20 for _, t in gone)

    kept = cp.near_duplicates(spark, kept, sf)
    stay = {i for i, _, c in brute_components(rows, 5, 80) if i == c}
    rows = [r for r in rows if r[0] in stay]
    assert kept.columns == docs.columns and texts(kept) == rows

    cut = cp.repeated_passages(spark, kept, sf)
    want = {i: (t, n) for i, _, n, t in brute_repeats(rows, 20)}
    rows = sorted(((i, want[i][0] if want[i][1] else t) for i, t in rows), key=str)
    assert cut.columns == docs.columns and texts(cut) == rows

    mixed = cp.mixture(spark, cut, sf)
    assert mixed.columns == docs.columns
    size = {i: len(WORD.findall(t or "")) for i, t in rows}
    taken, whole = defaultdict(int), Counter()
    text = dict(rows)
    for i, t in texts(mixed):
        n = len(WORD.findall(t))
        taken[i] += n
        whole[i] += n == size[i]
        assert n <= size[i] and (n < size[i] or t == text[i])
    assert max(whole.values()) <= 2
    digest = {r["doc_id"]: r["taken"] for r in mixing.taken_words(cut).collect()}
    assert {i: n for i, n in digest.items() if n} == dict(taken)

    model = queries.piece_model()
    coder = sentencepiece_bpe.encoder(model)
    assert sorted((r["doc_id"], r["n_tokens"]) for r in cp.tokens(spark, mixed, sf).collect()) == sorted((i, len(coder.encode(t))) for i, t in texts(mixed))


def test_run(spark, sf):
    out = cp.run(spark, sf)
    assert out.columns[:2] == ["doc_id", "n_tokens"] and out.count() > 100
    assert [name for name, _ in cp.STAGES] == ["language", "near_duplicates", "repeated_passages", "mixture", "tokens"] and cp.ORACLE_SQL is None


@pytest.mark.parametrize("rows", [ROWS, []])
def test_edges_in_every_stage(spark, sf, rows):
    docs = edge_docs(spark, rows)
    for name, stage in cp.STAGES:
        out = stage(spark, docs, sf)
        got = out.collect()
        if name != "tokens":
            assert out.columns == COLUMNS
        if not rows:
            assert not got


def test_names_that_stages_use_themselves(spark, sf):
    names = ["_cp_id", "_cp_hash", "_r_id", "_cp", "_chunk", "chunk", "spans", "n_words", "ll", "p", "class", "bucket", "accepted", "a.b", "nested"]
    docs = edge_docs(spark).drop("kept", "rank")
    for k, name in enumerate(names):
        docs = docs.withColumn(name, F.struct(F.lit(k).alias("k")) if name == "nested" else F.lit(k))
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert rows and all(list(r)[5:-1] == list(range(len(names) - 1)) and r["nested"]["k"] == len(names) - 1 for r in rows)


def test_edge_results(spark, sf):
    docs = edge_docs(spark)
    ids = lambda df: Counter(r["doc_id"] for r in df.collect())
    language = ids(cp.language(spark, docs, sf))
    assert 3 not in language and 4 not in language and 6 not in language and language[1] == 2 and language[None] == 1
    near = cp.near_duplicates(spark, docs, sf)
    assert ids(near) == Counter([1, 3, 4, None, 6, 7, 8])
    assert [r["text"] for r in near.where("doc_id = 8").collect()] == ["another text of the same id"]
    cut = {(r["doc_id"], r["text"]): r for r in cp.repeated_passages(spark, docs, sf).collect()}
    assert (2, "") in cut and (3, None) in cut and (8, "short") in cut
    mixed = cp.mixture(spark, docs, sf)
    assert set(ids(mixed)) <= {1, 2, 6, 7, 8, 9, None}


def test_unlabelled_documents_stay(spark, sf):
    docs = edge_docs(spark).withColumn("lang", F.lit(None).cast("string"))
    assert cp.language(spark, docs, sf).count() == len(ROWS)
