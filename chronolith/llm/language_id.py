"""Language identification by Bayesian evidence fusion.

Four kinds of evidence are multiplied for every row:

* the likelihood of the text under a byte trigram model of each language,
* the language that the markup declares,
* the suffix of the address (its last label),
* the prior of the host, smoothed towards its domain, and that towards the whole table.

The trigram models are counted on a bounded sample of labelled texts (``SAMPLE`` per
language, chosen by a hash of the id).  The other three come from all rows at hand, by
grouped aggregation of the probabilities that the text alone gives: no label is read.

Beside the trained languages there is a background class, for which all trigram buckets are
equally likely; trigrams with a digit, of no language, are as likely for it as for the mean
language.  It takes part in all evidence as a language does, so a text that is unlike
every trained language (in another one, or gibberish) is not accepted.  A close relative of a
trained language can still be taken for it.

The text's likelihood is tempered: more than ``EFFECTIVE`` trigrams count as so many,
because trigrams of a text are not independent.  Texts too short for a trigram count as a
word between separators.

Defined results: a text without letters or digits gives no evidence; a row whose best
language has a probability below ``ACCEPT``, against the other languages and the background,
or that has no text evidence at all, is not accepted (its best language is still named).  Null hosts, suffixes and declarations give no
evidence.  Ties go to the first language in order of name.  Repeated rows are rows of their own,
and each counts for the priors; very long texts are read whole; an empty table gives an empty
result; without labels no row is accepted.  Columns named language, probability or accepted are
replaced, all others stay, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import checkpointed, grouped, streamed
from .words import blocks

BUCKETS = 1 << 14
#: Labelled texts for each language that the trigram models are counted on, at most, and bytes of each text's share of the counts.
SAMPLE = 1500
#: A model has 64 KB for each language and is sent to every task: 64 MB at most.  More labels raise an error.
MAX_LANGUAGES = 1000
EFFECTIVE = 200
ACCEPT = 0.5
_HOST_WEIGHT = 8.0
_SMOOTH = 0.5
_U = np.uint32
_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[0x41:0x5B] += 32
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: Everything that is no letter or digit counts as one separator.
_FOLD[~_LETTER] = 0x20


def _buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    texts = texts.cast(pa.large_string()).fill_null("")
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, bounds - bounds[0]


def trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the byte trigrams of all texts that are not all separators, and where each text's begin and end."""
    return _trigrams(texts)[:2]


def _trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``trigrams``, and which of them have a digit."""
    raw, bounds = _buffer(texts)
    folded = _FOLD[raw]
    n = max(len(raw) - 2, 0)
    grams = (folded[:n] << _U(16)) | (folded[1 : n + 1] << _U(8)) | folded[2 : n + 2]
    use = grams != _U(0x202020)
    cut = bounds[1:-1]
    for back in (1, 2):  # those that reach into the next text
        at = cut - back
        use[at[(at >= 0) & (at < n)]] = False
    mixed = grams * _U(0x9E3779B1)
    buckets = (mixed ^ (mixed >> _U(15))) & _U(BUCKETS - 1)
    total = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(use, out=total[1 : n + 1])
    total[n + 1 :] = total[n]
    digit = (folded >= 0x30) & (folded <= 0x39)
    return buckets[use], total[bounds], (digit[:n] | digit[1 : n + 1] | digit[2 : n + 2])[use]


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    #: Log probability of each trigram bucket, a row for each language.
    table: np.ndarray

    def likelihoods(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Tempered log likelihoods of the languages and, last, the background, a row for each text, and the trigrams of each text."""
        short = pc.less(pc.fill_null(pc.binary_length(texts), 0), 3)
        if pc.any(short).as_py():
            space = pa.scalar(" ", texts.type)
            texts = pc.if_else(short, pc.binary_join_element_wise(space, pc.fill_null(texts, ""), space, pa.scalar("", texts.type)), texts)
        out = np.zeros((len(texts), len(self.languages) + 1))
        counts = np.zeros(len(texts), np.int64)
        mean = self.table.mean(axis=0)
        for i, j in blocks(texts, 1 << 20):
            found, bounds, digit = _trigrams(texts[i:j])
            counts[i:j] = np.diff(bounds)
            total = np.zeros(len(found) + 1)
            for k, row in enumerate(self.table):
                np.cumsum(row[found], out=total[1:])
                out[i:j, k] = np.diff(total[bounds])
            np.cumsum(np.where(digit, mean[found], -np.log(BUCKETS)), out=total[1:])
            out[i:j, -1] = np.diff(total[bounds])
        return out * (np.minimum(counts, EFFECTIVE) / np.maximum(counts, 1))[:, None], counts


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", sample: int = SAMPLE, max_languages: int = MAX_LANGUAGES) -> Model:
    """Count trigram models on at most ``sample`` texts of each language.  More than ``max_languages`` labels raise an error.

    The chosen ids, a number bounded by ``sample`` and the languages, are broadcast; the
    counts, of a fixed size for each language, are summed on the driver.
    """
    ids = labelled.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).where("id IS NOT NULL AND label IS NOT NULL")
    counts = {r["label"]: r["n"] for r in ids.groupBy("label").agg(F.count(F.lit(1)).alias("n")).limit(max_languages + 1).collect()}
    names = sorted(counts)
    if len(names) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    if not names:
        return Model((), np.zeros((0, BUCKETS), np.float32))
    # the smallest hashes of a label are below a bound that leaves some four times as many rows as are wanted, however many it has
    bounds = [(x, min(2**63 - 1, -(2**63) + (4 * sample << 64) // n)) for x, n in counts.items()]
    few = ids.join(F.broadcast(labelled.sparkSession.createDataFrame(bounds, "label string, bound long")), "label").where(F.xxhash64("id") <= F.col("bound"))
    first = Window.partitionBy("label").orderBy(F.xxhash64("id"), "id")
    chosen = few.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= sample).select("id", "label")
    picked = labelled.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(text_col).alias("text")).join(F.broadcast(chosen), ["id", "label"], "left_semi")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            labels = np.array(batch.column(1).to_pylist(), object)
            for i, j in blocks(batch.column(2), 1 << 20):
                found, bounds = trigrams(batch.column(2)[i:j])
                for name in set(labels[i:j]):
                    mine = np.repeat(labels[i:j] == name, np.diff(bounds))
                    sums[name] = sums.get(name, 0) + np.bincount(found[mine], minlength=BUCKETS)
        for name, x in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([x.astype(np.int64).tobytes()], pa.binary())], ["label", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.int64) for x in table["counts"].to_pylist())
        return pa.table({"label": pa.array([table["label"][0].as_py()]), "counts": pa.array([total.tobytes()], pa.binary())})

    summed = {r["label"]: np.frombuffer(bytes(r["counts"]), np.int64) for r in picked.mapInArrow(streamed(count), "label string, counts binary").groupBy("label").applyInArrow(grouped(add), "label string, counts binary").collect()}
    rows = [np.log((summed.get(n, np.zeros(BUCKETS, np.int64)) + _SMOOTH) / (summed.get(n, np.zeros(1, np.int64)).sum() + _SMOOTH * BUCKETS)) for n in names]
    return Model(tuple(names), np.array(rows, np.float32))


def host_of(url: Column) -> Column:
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    return F.when(host != "", host)


def domain_of(host: Column) -> Column:
    return F.substring_index(host, ".", -2)


def suffix_of(host: Column) -> Column:
    return F.when(F.instr(host, ".") > 0, F.substring_index(host, ".", -1))


def declared_in(html: Column) -> Column:
    found = F.lower(F.regexp_extract(html, r"(?i)<html[^>]*\slang\s*=\s*[\"']?([a-z]{2,3})", 1))
    return F.when(found != "", found)


def visible_text(html: Column) -> Column:
    """A page without markup; what is not closed reaches to the end, so that each byte is looked at a few times only."""
    bare = F.regexp_replace(html, r"(?is)<script\b[^>]*>.*?(?:</script\s*>|\z)|<style\b[^>]*>.*?(?:</style\s*>|\z)|<!--.*?(?:-->|\z)|<[^<>]*>", " ")
    return F.regexp_replace(bare, r"&[A-Za-z#0-9]+;", " ")


def text_evidence(rows: DataFrame, model: Model) -> DataFrame:
    """Replace ``text`` by ``ll`` (tempered log likelihoods) and ``grams`` (trigrams seen)."""
    kept = [c for c in rows.columns if c != "text"]
    schema = T.StructType([*(f for f in rows.schema.fields if f.name != "text"), T.StructField("ll", T.ArrayType(T.DoubleType())), T.StructField("grams", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            ll, counts = model.likelihoods(batch.column(at))
            values = pa.ListArray.from_arrays(pa.array(np.arange(len(ll) + 1) * ll.shape[1], pa.int32()), pa.array(ll.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), values, pa.array(counts)], [*kept, "ll", "grams"])

    return rows.select(*kept, "text").mapInArrow(streamed(run), schema)


def _softmax(logs: Column) -> Column:
    top = F.array_max(logs)
    parts = F.transform(logs, lambda x: F.exp(x - top))
    total = F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)
    return F.transform(parts, lambda x: x / total)


def _sums(rows: DataFrame, key: str, n: int) -> DataFrame:
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(*(F.sum(F.col("p")[k]).alias(f"c{k}") for k in range(n)))


def fuse(rows: DataFrame, model: Model) -> DataFrame:
    """Add language, probability and accepted to rows with ``text``, ``host``, ``domain``, ``suffix`` and ``declared``.

    ``text`` goes; the other columns stay.  Hosts are joined by their key, never broadcast:
    their number has no bound.
    """
    rows = rows.drop("language", "probability", "accepted")
    if not model.languages:
        return rows.drop("text").withColumns({"language": F.lit(None).cast("string"), "probability": F.lit(0.0), "accepted": F.lit(False)})
    n = len(model.languages) + 1  # the background is the last
    own = F.struct(*(F.col(f"`{c}`") for c in rows.columns if c != "text")).alias("row")  # out of the way of the names below
    seen = checkpointed(text_evidence(rows.select(own, "host", "domain", "suffix", "declared", "text"), model)).withColumn("p", F.when(F.col("grams") > 0, _softmax(F.col("ll"))))
    clear = seen.where("grams > 0")
    names = F.array(*map(F.lit, model.languages))

    totals = clear.agg(*(F.coalesce(F.sum(F.col("p")[k]), F.lit(0.0)).alias(f"c{k}") for k in range(n))).first()
    overall = [float(x) + 1.0 for x in totals]
    world = [x / sum(overall) for x in overall]

    def smoothed(sums: DataFrame, above: list[Column], name: str) -> DataFrame:
        total = sum((F.col(f"c{k}") for k in range(n)), F.lit(0.0))
        return sums.withColumn(name, F.array(*((F.col(f"c{k}") + _HOST_WEIGHT * above[k]) / (total + _HOST_WEIGHT) for k in range(n))))

    domains = smoothed(_sums(clear, "domain", n), [F.lit(x) for x in world], "domain_prior").select("domain", "domain_prior")
    of_host = clear.where("host IS NOT NULL").groupBy("host").agg(F.min("domain").alias("domain"), *(F.sum(F.col("p")[k]).alias(f"c{k}") for k in range(n)))
    of_host = of_host.join(domains, "domain", "left").withColumn("domain_prior", F.coalesce("domain_prior", F.array(*map(F.lit, world))))
    hosts = smoothed(of_host, [F.col("domain_prior")[k] for k in range(n)], "host_prior").select("host", "host_prior")

    def likelihood(key: str, name: str) -> DataFrame:
        """Log of P(key | language), with one count shared by all values and one for those not seen."""
        sums = _sums(clear, key, n)
        kinds = sums.count() + 1
        return sums.select(key, F.array(*(F.log((F.col(f"c{k}") + 1.0 / kinds) / (overall[k] + 1.0)) for k in range(n))).alias(name))

    joined = seen.join(hosts, "host", "left").join(likelihood("suffix", "suffix_ll"), "suffix", "left").join(likelihood("declared", "declared_ll"), "declared", "left")
    none = F.array(*([F.lit(0.0)] * n))
    prior = F.transform(F.coalesce("host_prior", F.array(*map(F.lit, world))), lambda x: F.log(x))
    logs = F.zip_with(F.zip_with("ll", prior, lambda a, b: a + b), F.zip_with(F.coalesce("suffix_ll", none), F.coalesce("declared_ll", none), lambda a, b: a + b), lambda a, b: a + b)
    fused = joined.withColumn("p", _softmax(logs))
    best = F.array_max(F.slice("p", 1, n - 1))
    return fused.withColumns(
        {"language": F.element_at(names, F.array_position("p", best).cast("int")), "probability": best, "accepted": (F.col("grams") > 0) & (best >= ACCEPT)}
    ).select("row.*", "language", "probability", "accepted")


def identify_documents(docs: DataFrame, model: Model, id_col: str = "doc_id") -> DataFrame:
    """Rows (id, language, probability, accepted) of texts whose ``source`` stands for the host."""
    none = F.lit(None).cast("string")
    return fuse(docs.select(F.col(id_col), F.col("source").cast("string").alias("host"), none.alias("domain"), none.alias("suffix"), none.alias("declared"), F.col("text").cast("string").alias("text")), model).select(id_col, "language", "probability", "accepted")


def identify_pages(pages: DataFrame, model: Model, id_col: str = "page_id") -> DataFrame:
    """Rows (id, declared, language, probability, accepted) of web pages (url, html)."""
    host = host_of(F.col("url"))
    rows = pages.select(F.col(id_col), host.alias("host"), domain_of(host).alias("domain"), suffix_of(host).alias("suffix"), declared_in(F.col("html")).alias("declared"), visible_text(F.col("html")).alias("text"))
    return fuse(rows, model).select(id_col, "declared", "language", "probability", "accepted")
