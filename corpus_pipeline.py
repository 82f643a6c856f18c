"""A training-data pipeline: five operators, one after the other, over ``documents``.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; its
result is written as Parquet and read again as the next one's documents.  All but the
last return the columns of ``documents``, extra columns included, whatever their names.
An empty table stays empty; null ids and texts, empty and very long texts and repeated rows
are as the operators define.

1. language: rows whose language stays undetermined go (no letters or digits at all, or
   no language that is likely enough).  Without any labelled row nothing goes.
2. near_duplicates: of each group of near copies (five-word shingles, a Jaccard similarity
   of 0.8 or more) the document with the smallest id stays;
   of rows that repeat its id, the one with the smallest text.  Rows without id stay.
3. repeated_passages: words of passages that occur earlier are cut from the texts; what
   stays is joined by one space.  Texts without such a passage stay as they are.
4. mixture: sources are mixed to their target weights.  A document has one row for each
   pass in which words of it are taken, with these words (its text as it is, where all
   are); documents that the mix does not reach, or without words, have none.  Rows that
   repeat an id and text are taken alike.
5. tokens: the texts are encoded and decoded; the result has counts and digests.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.llm import language_id, mixing, ngram_join, queries, substring_dedup
from chronolith.llm.common import WORD, broadcast_if_small, checkpointed, scratch, ship, table

#: Near copies: shingles of so many words, and at least this Jaccard similarity.
SHINGLE_WORDS, SIMILARITY = 5, (80, 100)
_ID, _HASH, _REST = "_cp_id", "_cp_hash", "_cp_rest"
DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _carrying(stage: Stage) -> Stage:
    """A stage to which all other columns are one, so that no name of theirs is in its way."""

    @functools.wraps(stage)
    def apply(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        rest = [c for c in docs.columns if c not in DOCUMENT]
        if not rest:
            return stage(spark, docs, sf_dir)
        packed = docs.select(*DOCUMENT, F.struct(*(F.col(f"`{c}`") for c in rest)).alias(_REST))
        return stage(spark, packed, sf_dir).select(*(F.col(c) if c in DOCUMENT else F.col(_REST)[c].alias(c) for c in docs.columns))

    return apply


def _keyed(docs: DataFrame) -> DataFrame:
    """A hash of the text beside the id, to tell rows with equal ids apart."""
    return docs.withColumns({_ID: F.col("doc_id").cast("long"), _HASH: F.xxhash64("text")})


def _same(left: DataFrame, right: DataFrame) -> Column:
    return left[_ID].eqNullSafe(right["_r_id"]) & (left[_HASH] == right["_r_hash"])


@_carrying
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language_id.train(docs)
    if not model.languages:
        return docs
    keyed = _keyed(docs)
    none = F.lit(None).cast("string")
    rows = keyed.select(F.col(_ID).alias("_r_id"), F.col(_HASH).alias("_r_hash"), F.col("source").cast("string").alias("host"), none.alias("domain"), none.alias("suffix"), none.alias("declared"), F.col("text").cast("string").alias("text"))
    rejected = broadcast_if_small(language_id.fuse(rows, model).where("NOT accepted").select("_r_id", "_r_hash").distinct())
    return keyed.join(rejected, _same(keyed, rejected), "left_anti").select(docs.columns)


@_carrying
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = checkpointed(ngram_join.component_table(docs, SHINGLE_WORDS, *SIMILARITY)).where("doc_id IS NOT NULL")
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("_r_id")).distinct()
    twice = found.where("doc_id = component_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias("_r_id"))
    keyed = docs.withColumn(_ID, F.col("doc_id").cast("long"))
    leave, merge = broadcast_if_small(gone.unionByName(twice).distinct()), broadcast_if_small(twice)
    one = keyed.join(leave, F.col(_ID) == F.col("_r_id"), "left_anti").select(docs.columns)
    rest = [c for c in docs.columns if c != "text"]
    several = keyed.join(merge, F.col(_ID) == F.col("_r_id"), "left_semi").groupBy(_ID).agg(F.min(F.struct("text", *rest)).alias("_cp"))
    return one.unionByName(several.select(*(F.col("_cp")[c].alias(c) for c in docs.columns)))


@_carrying
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = substring_dedup.remove_repeats(docs)
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    size = F.when(F.col("n_removed") > 0, F.length("kept")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return cut.withColumns({"text": text, "n_chars": size}).select(docs.columns)


@_carrying
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    keyed = _keyed(docs)
    plan, _, mix = mixing.mix(keyed.select(F.col(_ID).alias("doc_id"), "text", "source", F.col(_HASH).alias("carried")), carry=("carried",))
    blocks = mixing.source_table(spark, plan).select("source_index", F.greatest(F.lit(1), F.ceil(F.col("source_size") / plan.block_words)).alias("blocks"))
    taken = mix.join(F.broadcast(blocks), "source_index").withColumn("pass", F.floor(F.col("rank") / F.col("blocks")))
    parts = taken.groupBy("doc_id", "carried", "bucket", "place", "size", "pass").agg(F.sum("words").alias("taken"), F.sort_array(F.collect_list(F.struct("word", "words"))).alias("ranges"))
    parts = parts.groupBy("doc_id", "carried", "pass").agg(F.min(F.struct("bucket", "place", "size", "taken", "ranges")).alias("_cp")).select(F.col("doc_id").alias("_r_id"), F.col("carried").alias("_r_hash"), "_cp")
    joined = keyed.join(parts, _same(keyed, parts))
    words = F.regexp_extract_all(F.col("text"), F.lit(WORD), F.lit(0))
    some = F.array_join(F.flatten(F.transform("_cp.ranges", lambda r: F.slice(words, (r.word + 1).cast("int"), r.words.cast("int")))), " ")
    whole = F.col("_cp.taken") >= F.col("_cp.size")
    return joined.withColumns({"text": F.when(whole, F.col("text")).otherwise(some), "n_chars": F.when(whole, F.col("n_chars")).otherwise(F.length(some)).cast(docs.schema["n_chars"].dataType)}).select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return queries.sentencepiece_digests(docs, queries.piece_model())


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("mixture", mixture), ("tokens", tokens)]

#: The first stage's likelihoods and the schedule of the fourth are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each one's result is a folder of the shared folder."""
    docs = table(spark, sf_dir, "documents")
    folder = scratch(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
