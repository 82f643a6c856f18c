"""Operators 7, 8 and 10: brute force, edge cases and held-out accuracy."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from chronolith.llm import bm25, fingerprints, language_id, quality, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")
EDGES = [(None, "lost and found"), (100, None), (200, ""), (300, "the"), (300, "the the THE end"), (5, "the end"), (5, "the end"), (6, "x" * 9000), (400, "é the END"), (7, "word " * 3000), (500, "never seen before")]


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", 3) for i, t in rows], "doc_id long, text string, lang string, term int")


def terms(text):
    return Counter(re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(text or ""))


def brute_search(rows, top):
    docs = [(i, terms(t)) for i, t in rows if i is not None]
    n = len(docs)
    mean = sum(sum(c.values()) for _, c in docs) / max(n, 1)
    df = Counter(w for _, c in docs for w in c)
    out = []
    asked = {}
    for i, c in docs:
        if i % 100 == 0:
            asked.setdefault(i, set()).update(c)
    for q, words in asked.items():
        scores = []
        for i, c in docs:
            size = sum(c.values())
            s = sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * size / mean)) for w in words & set(c))
            if s > 0:
                scores.append((-round(s, 4), i))
        out += [(q, k, i, -s) for k, (s, i) in enumerate(sorted(scores)[:top], 1)]
    return sorted(out)


def search(spark, rows, top, **options):
    d = table(spark, rows)
    return sorted(tuple(r) for r in bm25.search(bm25.build(d, shard=options.pop("shard", bm25.SHARD)), d.where(bm25.hundredth(F.col("doc_id"))), top=top, **options).collect())


def random_rows(seed, n):
    rnd = random.Random(seed)
    common, rare = [f"c{i}" for i in range(12)], [f"r{i}" for i in range(3000)]
    rows = [(i * 10, " ".join(rnd.choice(common if rnd.random() < 0.6 else rare) for _ in range(rnd.choice([1, 5, 30, 120])))) for i in range(n)]
    return rows + [(10 * n + k, rows[0][1]) for k in range(12)]


@pytest.mark.parametrize(("seed", "n", "shard"), [(1, 90, 8192), (2, 400, 70), (3, 300, 150)])
def test_search_random(spark, seed, n, shard):
    rows = random_rows(seed, n)
    want, got = brute_search(rows, 10), search(spark, rows, 10, shard=shard)
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert np.allclose([r[3] for r in got], [r[3] for r in want], atol=2e-4)


def test_search_in_blocks_of_queries(spark):
    rows = random_rows(4, 200)
    assert search(spark, rows, 3, query_terms_at_once=150) == search(spark, rows, 3)


def test_search_edges(spark):
    got, want = search(spark, EDGES, 10), brute_search(EDGES, 10)
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert search(spark, [], 10) == []


def test_query_blocks_have_a_term_once(spark):
    """Every shard reads all of them, so at 6 GB what is in them counts once for each shard."""
    rows = random_rows(6, 120)
    d = table(spark, rows)
    asked = bm25.query_terms(d, "doc_id", "text").withColumns({"weight": F.lit(1.5), "floor": F.lit(0.0)})
    blocks = list(bm25._read_blocks(bm25._query_blocks(asked, 1)))
    own = {i: set(terms(t)) for i, t in rows}
    assert len(blocks) == 1
    names, hashes, weights, pairs, bounds, _ = blocks[0]
    assert len(hashes) == len(weights) == len(set(hashes.tolist())) == len(set().union(*own.values()))
    assert len(pairs) == bounds[-1] and dict(zip(names.tolist(), np.diff(bounds).tolist(), strict=True)) == {i: len(t) for i, t in own.items()}


def test_language_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = language_id.train(docs)
    assert model.languages == ("de", "en", "es", "fr")
    got = language_id.identify_documents(docs, model).join(docs.select("doc_id", "lang", F.length("text").alias("size")), "doc_id").where("size > 40").collect()
    assert np.mean([r["language"] == r["lang"] for r in got]) > 0.98
    assert np.mean([r["accepted"] for r in got]) > 0.99
    pages = language_id.identify_pages(spark.read.parquet(f"{sf}/pages.parquet"), model).collect()
    assert np.mean([r["language"] == r["declared"] for r in pages]) > 0.97


def test_language_trained_on_half(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = language_id.train(docs.where("doc_id % 2 = 0"))
    got = language_id.identify_documents(docs.where("doc_id % 2 = 1"), model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r["language"] == r["lang"] for r in got]) > 0.95


FOREIGN = [
    "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa.",
    "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä.",
    "すべての人間は、生まれながらにして自由であり、かつ、尊厳と権利とについて平等である。人間は、理性と良心とを授けられており、互いに同胞の精神をもって行動しなければならない。",
    "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства.",
]


def test_text_in_no_trained_language_is_not_accepted(spark, sf):
    rnd = random.Random(1)
    noise = [" ".join("".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randrange(2, 10))) for _ in range(80)) for _ in range(300)]
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    sources = sorted(r["source"] for r in docs.select("source").distinct().collect())
    planted = spark.createDataFrame([(-1 - k, t, None, sources[k % len(sources)], len(t)) for k, t in enumerate(FOREIGN + noise)], docs.schema)
    both = docs.unionByName(planted)
    got = {r["doc_id"]: r for r in language_id.identify_documents(both, language_id.train(both)).collect()}
    clean = [got[r["doc_id"]] for r in docs.where(F.length("text") > 40).collect()]
    assert not any(got[-1 - k]["accepted"] for k in range(len(FOREIGN + noise)))
    assert np.mean([r["accepted"] for r in clean]) > 0.99
    kept = {r["doc_id"] for r in corpus_pipeline.language(spark, both, sf).collect()}
    assert min(kept) >= 0 and kept == {i for i, r in got.items() if r["accepted"]}


def test_no_label_is_dropped(spark):
    docs = spark.range(201).selectExpr("id AS doc_id", "concat('text ', id) AS text", "concat('l', id) AS lang")
    with pytest.raises(ValueError, match="more than 200 languages"):
        language_id.train(docs, max_languages=200)
    assert len(language_id.train(docs.limit(5), max_languages=5).languages) == 5


def test_digits_do_not_reject_a_text(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(1, "Anerre haing whinti, 25.102.19.31 aneand. +1 (208) 555-1177 4284896609045836"), (2, "44.144.126.223 +1 (906) 555-7738 Th anatble, thndstnd 4992883091964172 to ererthing helyou.")]
    got = language_id.identify_documents(spark.createDataFrame([(*r, None) for r in rows], "doc_id long, text string, source string"), language_id.train(docs)).collect()
    assert len(got) == 2 and all(r["accepted"] and r["language"] == "en" for r in got)


def test_short_texts_have_trigrams():
    model = language_id.Model(("en",), np.zeros((1, language_id.BUCKETS), np.float32))
    for kind in (pa.string(), pa.large_string()):
        assert model.likelihoods(pa.array(["ab", "a", "é", "", None, "!", "abc"], kind))[1].tolist() == [2, 1, 2, 0, 0, 0, 1]


def test_trigrams_like_brute_force():
    texts = ["Ab c!", None, "", "  ", "éa", "x", "ab"]
    got, bounds = language_id.trigrams(pa.array(texts))
    assert list(np.diff(bounds)) == [sum(g != b"   " for g in (f[k : k + 3] for k in range(len(f) - 2))) for f in (bytes(c + 32 if 65 <= c <= 90 else c if (48 <= c <= 57 or 97 <= c <= 122 or c >= 128) else 32 for c in (t or "").encode()) for t in texts)]
    again = np.concatenate([language_id.trigrams(pa.array([t]))[0] for t in texts])
    assert (again == got).all()


def test_evidence_is_fused(spark):
    """The host decides where the text says little, the markup where text and host are silent."""
    docs = spark.createDataFrame([(i, t, n) for i, (t, n) in enumerate([("the cat and the dog of the house", "en"), ("der hund und die katze von dem haus", "de")] * 20)], "doc_id long, text string, lang string")
    model = language_id.train(docs)
    html = lambda lang, text: f"<html lang='{lang}'><body><script>var the;</script><p>{text}</p></body></html>"
    rows = [(k, "https://a.example.de/x", html("de", "der hund und die katze")) for k in range(30)] + [(k + 50, "https://b.example.com/x", html("en", "the dog and the cat")) for k in range(30)]
    rows += [(100, "https://a.example.de/y", "<p>zq</p>"), (101, None, html("de", "zq")), (102, None, None), (103, "nonsense", "<p>the house of the cat</p>"), (104, "https://b.example.com/z", html("en", "zq"))]
    got = {r["page_id"]: r for r in language_id.identify_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), model).collect()}
    assert len(got) == len(rows)
    assert got[100]["language"] == "de" and got[101]["language"] == "de" and got[103]["language"] == "en" and got[104]["language"] == "en"
    assert not got[102]["accepted"] and got[0]["accepted"] and got[101]["declared"] == "de"


def test_language_edges(spark):
    docs = spark.createDataFrame([(1, None, None, None), (2, "", "en", "s"), (3, "the text", "en", None), (None, "the", None, "s"), (4, "!!! ???", "en", "s"), (4, "!!! ???", "en", "s")], "doc_id long, text string, lang string, source string")
    got = language_id.identify_documents(docs, language_id.train(docs)).collect()
    assert len(got) == 6 and sum(r["accepted"] for r in got) == 2
    assert language_id.identify_documents(docs, language_id.train(docs.limit(0))).where("accepted").count() == 0
    assert language_id.identify_documents(docs.limit(0), language_id.train(docs)).count() == 0


def test_held_out_is_crc32(spark):
    rows = spark.range(500).select("id", quality.held_out(F.col("id")).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 5 == 0) for r in rows)


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op10_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    good, bad = [r["score"] for r in got if r["quality"] == 1], [r["score"] for r in got if r["quality"] == 0]
    assert np.mean([a > b for a in good for b in bad]) > 0.97
    assert np.mean([r["predicted"] for r in got if r["quality"] == 1]) > 0.97


def test_quality_features():
    found, owner, n = quality.features(pa.array(["a a b", None, "", "ab"]))
    assert n.tolist() == [3 + 2 + 3, 0, 0, 1]
    assert (found[owner == 0] == 1).sum() >= 1


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "fine words here"), (None, "lost"), (3, "fine words here"), (4, "bad " * 3000)], "doc_id long, text string").withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(1, 1), (2, None), (3, 1), (4, 0), (9, 0), (None, 1), (4, 7)], "doc_id long, quality int")
    model = quality.fit(quality.training_rows(docs, labels))
    got = quality.score(docs, model).collect()
    assert len(got) == 6 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    empty = quality.fit(quality.training_rows(docs.limit(0), labels))
    assert quality.score(docs, empty).count() == 6 and quality.score(docs.limit(0), model).count() == 0


def test_near_duplicate_classes(spark):
    rnd = random.Random(3)
    base = [f"w{rnd.randrange(5000)}" for _ in range(300)]
    near = list(base)
    near[150] = "other"
    rows = [(1, " ".join(base)), (9, " ".join(base)), (4, " ".join(near)), (5, " ".join(f"v{rnd.randrange(5000)}" for _ in range(300))), (6, None), (7, ""), (8, "two words"), (3, "two words")]
    got = {r["doc_id"]: r["class_id"] for r in fingerprints.near_duplicate_classes(table(spark, rows)).collect()}
    assert got == {1: 1, 9: 1, 4: 1, 5: 5, 6: 6, 7: 7, 8: 3, 3: 3}


def test_near_duplicate_classes_of_boilerplate(spark):
    """Texts just below the threshold of each other, and planted pairs above it, against all pairs that share a band."""
    rnd = random.Random(5)
    word = lambda: f"w{rnd.randrange(10**9)}"
    shared = [word() for _ in range(204)]
    texts = [[word() for _ in range(30)] for _ in range(240)]
    for k in range(0, 160, 2):
        texts[k + 1][:11] = texts[k][:11]
    rnd.shuffle(texts)
    texts = [shared + t for t in texts]
    marks = fingerprints.signatures(pa.array([" ".join(t) for t in texts])).reshape(len(texts), fingerprints.BANDS, -1)
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if (marks[i] == marks[j]).all(axis=1).any() and 100 * both >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    got = {r["doc_id"]: r["class_id"] for r in fingerprints.near_duplicate_classes(table(spark, [(i, " ".join(t)) for i, t in enumerate(texts)])).collect()}
    wrong = [i for i in range(len(texts)) if got[i] != label[i]]
    assert len(set(label)) < 200 and not wrong, f"{len(wrong)} of {len(texts)} texts in another class"


def test_quality_scores_are_those_of_a_plain_version(spark):
    """Features counted one by one, over characters; a score is the logistic function of the bias and the mean of the table."""
    texts = ["Ein schöner Satz, ein Satz.", "日本語 日本語 text", "", None, "x", "a  b\tb " * 50]
    rng = np.random.default_rng(3)
    model = quality.Classifier(rng.normal(size=1 << quality.BITS).astype(np.float32), 0.25)

    for text, score in zip(texts, model.scores(pa.array(texts)), strict=True):
        words = WORD.findall(text or "")
        chars = text or ""
        want = len(words) + max(len(words) - 1, 0) + max(len(chars) - 2, 0)
        found, _, n = quality.features(pa.array([text]))
        assert n.tolist() == [want]
        # equal n-grams have equal buckets, different ones different (but for a few collisions)
        grams = [chars[i : i + 3] for i in range(len(chars) - 2)]
        buckets = found[len(found) - len(grams) :].tolist() if grams else []
        assert len(dict(zip(grams, buckets, strict=True))) == len(set(grams)) and all(buckets[grams.index(g)] == b for g, b in zip(grams, buckets, strict=True))
        total = model.bias + sum(float(model.table[f]) for f in found.tolist()) / max(want, 1)
        assert abs(score - 1 / (1 + math.exp(-total))) < 1e-9


def test_quality_sample_is_bounded_by_bytes(spark):
    docs = spark.createDataFrame([(i, "word " * (2000 if i == 3 else 10)) for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    learned = [i for i in range(40) if zlib.crc32(str(i).encode()) % 5]
    assert len(quality.training_rows(docs, labels)) == len(learned)
    small = quality.training_rows(docs, labels, sample_bytes=500)
    assert len(small) == 10 and len(quality.training_rows(docs, labels, sample=7)) == 7


def test_many_languages(spark):
    """Every label has a model, and more than the parameter allows raise an error."""
    rnd = random.Random(8)
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = []
    for k in range(260):
        own = rnd.sample(letters, 6)
        rows += [(2 * k + j, " ".join("".join(rnd.choice(own) for _ in range(5)) for _ in range(40)), f"l{k:03}") for j in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(docs)
    assert len(model.languages) == 260
    ll, _ = model.likelihoods(pa.array([r[1] for r in rows]))
    assert sum(model.languages[i] == r[2] for i, r in zip(ll[:, :-1].argmax(1), rows, strict=True)) > 500
    with pytest.raises(ValueError, match="more than 259"):
        language_id.train(docs, max_languages=259)


def test_fusion_is_that_of_a_plain_version(spark):
    """Columns of clashing names stay; the posterior is recomputed in plain numpy."""
    rnd = random.Random(5)
    english, german = "the cat and the dog of the house ".split(), "die Katze und der Hund von dem Haus ".split()
    rows = []
    for i in range(60):
        words = rnd.choice([english, german])
        text = " ".join(rnd.choice(words) for _ in range(rnd.choice([1, 3, 30]))) if i % 7 else None
        host = rnd.choice(["a.site.de", "b.site.de", "www.x.com", None])
        rows.append((i, text, host, ".".join(host.split(".")[-2:]) if host else None, host.split(".")[-1] if host else None, rnd.choice(["en", "de", None])))
    docs = spark.createDataFrame([(1, " ".join(english) * 9, "en"), (2, " ".join(german) * 9, "de")], "doc_id long, text string, lang string")
    model = language_id.train(docs)
    d = spark.createDataFrame(rows, "id long, text string, host string, domain string, suffix string, declared string")
    clash = d.withColumns({c: F.lit(7) for c in ("ll", "p", "grams", "c0", "row", "host_prior", "suffix_ll", "label")})
    out = language_id.fuse(clash, model)
    assert out.columns == [c for c in clash.columns if c != "text"] + ["language", "probability", "accepted"]
    got = {r["id"]: r for r in out.collect()}

    ll, grams = model.likelihoods(pa.array([r[1] for r in rows], pa.string()))
    soft = lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    p = {i: soft(ll[i]) for i in range(60) if grams[i]}
    add = lambda key: {v: sum(p[r[0]] for r in rows if r[0] in p and r[key] == v) for v in {r[key] for r in rows if r[0] in p and r[key] is not None}}
    overall = sum(p.values()) + 1
    world = overall / overall.sum()
    domain = {k: (c + 8 * world) / (c.sum() + 8) for k, c in add(3).items()}
    of_host = {r[2]: r[3] for r in rows}
    host = {k: (c + 8 * domain[of_host[k]]) / (c.sum() + 8) for k, c in add(2).items()}
    for r in rows:
        logs = ll[r[0]] + np.log(host.get(r[2], world))
        for key in (4, 5):
            sums = add(key)
            if r[key] in sums:
                logs = logs + np.log((sums[r[key]] + 1 / (len(sums) + 1)) / (overall + 1))
        q = soft(logs)[:-1]
        assert abs(got[r[0]]["probability"] - q.max()) < 1e-9 and got[r[0]]["language"] == model.languages[q.argmax()] and got[r[0]]["ll"] == 7
        assert got[r[0]]["accepted"] == bool(grams[r[0]] > 0 and q.max() >= language_id.ACCEPT)
    long = spark.createDataFrame([(1, "the cat and the dog " * 100_000), (1, "the cat and the dog " * 100_000)], "doc_id long, text string").withColumn("source", F.lit("s"))
    assert [r["language"] for r in language_id.identify_documents(long, model).collect()] == ["en", "en"]


def test_visible_text_of_broken_pages(spark):
    pages = ["<p>one <!-- gone --> two <script>x</script>three", "a <!-- never closed " * 20000, "<" * 100_000, "b<script>" * 20000]
    got = [r[0].split() for r in spark.createDataFrame([(p,) for p in pages], "html string").select(language_id.visible_text(F.col("html"))).collect()]
    assert got[0] == ["one", "two", "three"] and got[1] == ["a"] and got[3] == ["b"]


def test_near_duplicate_classes_of_odd_rows(spark):
    long = "w " * 100_000
    words = " ".join(f"w{k}" for k in range(50))
    rows = [(None, words), (1, None), (2, ""), (3, " "), (9, words), (9, words), (4, words), (5, long), (6, long), (7, "lone text of few words"), (8, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("id", "sha", "fingerprint", "b", "key", "part", "class_id")})
    got = sorted(tuple(r) for r in fingerprints.near_duplicate_classes(d).collect())
    assert got == [(1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (6, 5), (7, 7), (8, 8), (9, 4)]
    assert fingerprints.near_duplicate_classes(d.limit(0)).count() == 0


def test_fingerprint_study_is_that_of_a_plain_version(spark, sf):
    """Fingerprints and likeness recomputed one shingle and one permutation at a time, for some documents."""
    from chronolith.llm.words import Words, shingles

    docs = sorted(((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()), reverse=True)
    got = {r["doc_id"]: r for r in fingerprints.edit_study(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    a, b = (x.tolist() for x in fingerprints._family(fingerprints.PERMUTATIONS))

    def plain(text):
        values = set(shingles(Words(pa.array([text])), fingerprints.WIDTH)[0].tolist())
        return [min(((x * p + q) % 2**64) >> 32 for x in values) & 0xFFFF if values else 0xFFFF for p, q in zip(a, b, strict=True)]

    like = lambda x, y: sum(i == j for i, j in zip(x, y, strict=True)) / len(x)
    for k in range(0, len(docs), 23):
        (i, text), (_, other) = docs[k], docs[(k + 1) % len(docs)]
        if len(text) > 4000 or len(other) > 4000:
            continue
        half = len(text) // 2
        own, new, next_ = plain(text), plain(text[: len(text) - half] + other[:half]), plain(other)
        assert got[i]["fingerprint"] == "".join(f"{x:04x}" for x in own) and got[i]["edited_fingerprint"] == "".join(f"{x:04x}" for x in new)
        if text.split() and other.split():
            assert abs(got[i]["near_edited"] - like(own, new)) < 1e-12 and abs(got[i]["near_next"] - like(own, next_)) < 1e-12


def test_training_sample_is_that_of_the_smallest_hashes(spark):
    """The rows that a task gets of a label are bounded, and the choice is that of a full sort."""
    docs = spark.range(20000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"), F.when(F.col("id") % 50 == 0, "rare").otherwise("hot").alias("lang"))
    model = language_id.train(docs, sample=30)
    want = []
    for name in ("hot", "rare"):
        texts = [r["text"] for r in docs.where(F.col("lang") == name).orderBy(F.xxhash64("doc_id"), "doc_id").limit(30).collect()]
        found, _ = language_id.trigrams(pa.array(texts))
        count = np.bincount(found, minlength=language_id.BUCKETS)
        want.append(np.log((count + 0.5) / (count.sum() + 0.5 * language_id.BUCKETS)))
    assert model.languages == ("hot", "rare") and np.allclose(model.table, np.array(want, np.float32))
