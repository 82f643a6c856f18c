"""The queries that apply the operators, with production parameters, to whole tables."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bm25, chat, fingerprints, language_id, mixing, ngram_join, quality, sentencepiece_bpe, substring_dedup, warc
from .common import streamed, table

PIECE_MODEL = "piece_bpe_32k.model"


def piece_model() -> bytes:
    import public_tokenizers

    return sentencepiece_bpe.read_model(public_tokenizers.path(PIECE_MODEL))


def sentencepiece_digests(docs: DataFrame, model: bytes) -> DataFrame:
    """Encode and decode each text; keep counts and digests only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = sentencepiece_bpe.encoder(model)
        names = [str(i) for i in range(len(coder.vocab.pieces))]
        try:
            for batch in batches:
                rows: list[tuple[int, str, str]] = []
                for text in batch.column(1):
                    ids = coder.encode(text.as_py())
                    rows.append((len(ids), hashlib.sha256(",".join([names[i] for i in ids]).encode()).hexdigest(), hashlib.sha256(coder.decode_bytes(ids)).hexdigest()))
                n, ids_sha, decoded_sha = zip(*rows, strict=True) if rows else ((), (), ())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        finally:
            coder.release()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(streamed(run, sentencepiece_bpe.KEPT), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_digests(table(spark, sf_dir, "documents"), piece_model())


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return substring_dedup.remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.page_digests(warc.round_trip(table(spark, sf_dir, "pages")))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.component_table(table(spark, sf_dir, "documents"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edit_study(table(spark, sf_dir, "documents"))


def fingerprint_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 5's bands, joined and verified: the class of each document."""
    return fingerprints.near_duplicate_classes(table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(table(spark, sf_dir, "documents"))


def op7_bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document whose id is divisible by 100 is a query against all documents."""
    docs = table(spark, sf_dir, "documents")
    return bm25.search(bm25.build(docs), docs.where(bm25.hundredth(F.col("doc_id"))))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents (doc_id) and all pages (page_id), with the same models."""
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(docs)
    of_docs = language_id.identify_documents(docs, model).select("doc_id", F.lit(None).cast("long").alias("page_id"), F.lit(None).cast("string").alias("declared"), "language", "probability", "accepted")
    of_pages = language_id.identify_pages(table(spark, sf_dir, "pages"), model).select(F.lit(None).cast("long").alias("doc_id"), "page_id", "declared", "language", "probability", "accepted")
    return of_docs.unionByName(of_pages)


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All turns, as the log of events that a chat server would have written of them."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    said = f"{chat.CLOSE_ASSISTANT}{chat.OPEN_OTHER} ok {chat.CLOSE_OTHER}"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise(chat.ASSISTANT).alias("role"), F.lit(said).alias("text"))
    chats = chat.format_chats(chat.reconstruct(chat.streamed_log(rows.unionByName(extra))))
    read = chats.withColumns({"turns": chat.parse(F.col("formatted")), "learned": chat.loss_text(F.col("formatted"), F.col("loss"))})
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(quality.training_rows(docs, table(spark, sf_dir, "labels"))))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_warc": op3_warc,
    "op4_ngram_join": op4_ngram_join,
    "op5_fingerprints": op5_fingerprints,
    "fingerprint_classes": fingerprint_classes,
    "op6_mixing": op6_mixing,
    "op7_bm25_search": op7_bm25_search,
    "op8_language_id": op8_language_id,
    "op9_chat": op9_chat,
    "op10_quality": op10_quality,
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

ORACLES: dict[str, str] = {
    "op2_substring_dedup": f"""
        WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
        win AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w WHERE len(ws) >= 20),
        seen AS (SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(ws[i:i + 19], ' ') ORDER BY doc_id, i) AS nth FROM win),
        gone AS (SELECT DISTINCT doc_id, i + o.range AS k FROM seen, range(0, 20) o WHERE nth > 1),
        word AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS k FROM w),
        kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY k) AS kept, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id)
        SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM w LEFT JOIN kept USING (doc_id)""",
    "op3_warc": f"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        h AS (SELECT page_id, html, array_to_string(list_transform(string_split(sha1(html), ''), lambda c: lpad(bin(('0x' || c)::INT), 4, '0')), '') AS bits FROM p),
        d AS (SELECT page_id, html, array_to_string(list_transform(range(0, 160, 5), lambda b: substr('{_BASE32}', (1 + substr(bits, b + 1, 1)::INT * 16 + substr(bits, b + 2, 1)::INT * 8
            + substr(bits, b + 3, 1)::INT * 4 + substr(bits, b + 4, 1)::INT * 2 + substr(bits, b + 5, 1)::INT)::BIGINT, 1)), '') AS payload_digest FROM h),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS smallest FROM d)
        SELECT page_id, strlen(html)::BIGINT AS payload_bytes, payload_digest,
            CASE WHEN page_id = smallest THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN page_id <> smallest THEN smallest END AS refers_to
        FROM f""",
    "op4_ngram_join": f"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
        s AS (SELECT DISTINCT doc_id, sh FROM (
            SELECT doc_id, array_to_string(ws[i:i + 3], ' ') AS sh FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 2)) AS i FROM w WHERE len(ws) >= 4)
            UNION ALL SELECT doc_id, array_to_string(ws, ' ') || ' ' || len(ws) FROM w WHERE len(ws) BETWEEN 1 AND 3)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 85 * (a.n + b.n - k)),
        r AS (SELECT doc_id, doc_id AS at FROM documents UNION SELECT r.doc_id, e.y FROM r JOIN e ON r.at = e.x)
        SELECT r.doc_id, coalesce(max(n.n), 0)::BIGINT AS n_shingles, min(r.at) AS component_id
        FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id""",
    "op7_bm25_search": f"""
        WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
        tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(ws) AS term FROM w) GROUP BY 1, 2),
        df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
        st AS (SELECT count(*) AS n, avg(len(ws)) AS mean FROM w),
        s AS (SELECT q.doc_id AS query, d.doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * d.tf * 2.2 / (d.tf + 1.2 * (0.25 + 0.75 * len(w.ws) / mean))), 4) AS score
            FROM tf q JOIN df ON df.term = q.term JOIN tf d ON d.term = q.term JOIN w ON w.doc_id = d.doc_id, st WHERE q.doc_id % 100 = 0 GROUP BY 1, 2)
        SELECT query, rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 10""",
    "op9_chat": """
        WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
        e AS (SELECT *, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<s>', '&lt;s>'), '</s>', '&lt;/s>'), '[INST]', '&#91;INST]'), '[/INST]', '&#91;/INST]') AS body FROM r)
        SELECT conv_id, count(*) AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
            coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
            sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
            sum(CASE WHEN role = 'assistant' THEN 7 + length(body) ELSE 14 + length(role) + length(body) END)::BIGINT AS formatted_chars
        FROM e GROUP BY conv_id""",
}
