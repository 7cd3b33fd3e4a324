"""Quality classifier by importance resampling.

Two generative models of hashed n-grams (words, signs and their pairs; equal neighbours are one
n-gram of their own): one of documents labelled good, one of all documents.  A document's log weight is
the log ratio of its probabilities under both.  Taken whole it grows with the length, and noise of a few units would
choose nothing: the sample would be the plain top k.  So documents are weighed by the mean per n-gram
over `TEMPERATURE`, in which usual texts lie within a few units.  The documents kept are a sample without
replacement by these weights, drawn by Gumbel top-k: weight + Gumbel noise, the k largest.

The raw model counts every n-gram of every document.  The target model is fitted on at most
`FIT_ROWS` good documents, chosen by a hash of their id; one in `PARTS` of them is left out, and sets, with as many bad ones at
most, the cut: k is the number of documents whose mean reaches it.  Both models have `BUCKETS` numbers.
The noise is a hash of id and text, so reruns agree.  The k-th key is found by counting keys in bins, ever finer.

Defined results: a null or empty text has log weight and mean 0; a very long text is counted whole, a batch of texts at once; null ids are carried; labels that are null
or of no document are ignored, several for one id count as their largest; without good labels
all weights are 1, and without bad ones everything is kept; equal keys at the cut are kept together; repeated rows get the
same key; an empty table gives an empty result; extra columns are ignored by `weigh` and carried by `keep`.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eodlake.llm.common import cut, lean, map_batches, table, text_bytes, unused

BUCKETS, FIT_ROWS, PARTS, SMOOTH, TEMPERATURE, SEED, BINS, FEW = 1 << 14, 20_000, 4, 1.0, 0.1, 7, 1024, 4096
_TOKEN = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[^\x00-\x200-9A-Za-z\x7f-\xff]+")


def ngrams(text: bytes) -> np.ndarray:
    """Buckets of a text's n-grams."""
    h = np.array(list(map(zlib.crc32, _TOKEN.findall(text))), np.uint64)
    pair = h[:-1] * np.uint64(0x9E3779B1) + h[1:]
    pair[h[:-1] == h[1:]] = 1
    both = np.concatenate((h, pair ^ np.uint64(1 << 40)))
    both = (both ^ (both >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((both ^ (both >> np.uint64(32))) % np.uint64(BUCKETS)).astype(np.int64)


def counts(texts: DataFrame) -> np.ndarray:
    """N-grams of all `texts` (text BINARY) by bucket; each task gives one row per bucket it met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for t in batch.column(0):
                n += np.bincount(ngrams(t.as_py()), minlength=BUCKETS)
        at = np.flatnonzero(n)
        yield pa.record_batch([pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], names=["bucket", "n"])

    out = np.zeros(BUCKETS, np.int64)
    for r in texts.mapInArrow(lean(run), "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def _labelled(labels: DataFrame, quality: int, rows: int) -> DataFrame:
    one = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return one.where(F.col("quality") == quality).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).select("doc_id")


def _texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """`ids` are at most FIT_ROWS numbers."""
    return docs.join(F.broadcast(ids), "doc_id", "left_semi").select(text_bytes(F.col("text")).alias("text"))


def log_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    if not target.sum():
        return np.zeros(BUCKETS)
    p, q = (target + SMOOTH) / (target.sum() + SMOOTH * BUCKETS), (raw + SMOOTH) / (raw.sum() + SMOOTH * BUCKETS)
    return np.log(p) - np.log(q)


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> tuple[np.ndarray, float]:
    """-> log ratio by bucket, cut of the mean between good and bad labels."""
    good, bad = cut(_labelled(labels, 1, rows), "good"), cut(_labelled(labels, 0, rows), "bad")
    part = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(PARTS))  # the cut is set on other documents than the model
    ratio = log_ratio(counts(_texts_of(docs, good.where(part > 0))), counts(docs.select(text_bytes(F.col("text")).alias("text"))))
    seen = [np.array([r[0] for r in _scored(_texts_of(docs, ids).withColumn("doc_id", F.lit(0).cast("bigint")), ratio).select("mean").collect()]) for ids in (good.where(part == 0), bad)]
    return ratio, best_cut(*seen)


def best_cut(good: np.ndarray, bad: np.ndarray) -> float:
    """The cut with the fewest errors in shares of both labels, a lost good one counting tenfold; -inf without bad ones."""
    if not len(bad) or not len(good):
        return float("-inf")
    good, bad = np.sort(good), np.sort(bad)
    cuts = np.concatenate((good, np.nextafter(bad, np.inf)))
    loss = 10 * np.searchsorted(good, cuts) / len(good) + 1 - np.searchsorted(bad, cuts) / len(bad)
    return float(cuts[loss.argmin()])


def weights(texts: pa.Array, ratio: np.ndarray) -> tuple[list[int], list[float]]:
    n, weight = [], []
    for t in texts:
        found = ngrams(t.as_py())
        n.append(len(found))
        weight.append(float(ratio[found].sum()))
    return n, weight


def means(n: list[int], weight: list[float]) -> np.ndarray:
    return np.array(weight, float) / np.maximum(np.array(n, float), 1)


def _scored(docs: DataFrame, ratio: np.ndarray) -> DataFrame:
    """(doc_id, text BINARY) -> doc_id, tk, n_grams, log_weight, mean."""

    def run(batch: pa.RecordBatch) -> dict[str, list]:
        n, weight = weights(batch.column(1), ratio)
        return {"doc_id": batch.column(0), "tk": batch.column(2), "n_grams": n, "log_weight": weight, "mean": means(n, weight)}

    some = docs.select("doc_id", "text", F.xxhash64("text").alias("tk"))
    return map_batches(some, run, "doc_id bigint, tk bigint, n_grams bigint, log_weight double, mean double")


def gumbel(seed: int, *of: Column) -> Column:
    u = (F.xxhash64(*of, F.lit(seed)).bitwiseAND(F.lit((1 << 52) - 1)).cast("double") + 0.5) / F.lit(float(1 << 52))
    return -F.log(-F.log(u))


def kth_largest(keys: DataFrame, k: int) -> float:
    """The k-th largest of `key`, without a sort of all: bins around it are counted, ever finer."""
    if k <= 0:
        return float("inf")
    low, high, n = keys.agg(F.min("key"), F.max("key"), F.count("key")).first()
    if not n or k >= n:
        return float("-inf")
    above = 0  # keys over `high`
    part = keys
    while True:
        if n <= FEW or low == high:
            top = sorted((r[0] for r in part.select("key").limit(FEW).collect()), reverse=True)
            return low if low == high else top[k - above - 1]
        width = (high - low) / BINS
        bin_of = F.least(F.floor((F.col("key") - F.lit(low)) / F.lit(width)), F.lit(BINS - 1))
        got = sorted(part.groupBy(bin_of.alias("b")).agg(F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")).collect(), key=lambda r: -r["b"])
        for r in got:
            if above + r["n"] >= k:
                low, high, n = r["lo"], r["hi"], r["n"]
                break
            above += r["n"]
        part = keys.where(F.col("key").between(F.lit(low), F.lit(high)))


def _sampled(docs: DataFrame, labels: DataFrame, rows: int, temperature: float, seed: int) -> tuple[DataFrame, np.ndarray, float]:
    """-> scored documents with their keys, log ratio by bucket, the smallest key that is kept."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    ratio, limit = fit(docs, labels, rows)
    scored = _scored(docs.select("doc_id", text_bytes(F.col("text")).alias("text")), ratio)
    keys = cut(scored.withColumn("key", F.col("mean") / temperature + gumbel(seed, F.col("doc_id"), F.col("tk"))), "keys")
    k = keys.where(F.col("mean") >= F.lit(limit)).count()
    return keys, ratio, kth_largest(keys, k)


def weigh(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, temperature: float = TEMPERATURE, seed: int = SEED) -> DataFrame:
    """-> doc_id, tk (hash of the text), n_grams, log_weight, mean, key, kept."""
    keys, _, least = _sampled(docs, labels, rows, temperature, seed)
    return keys.withColumn("kept", F.col("key") >= F.lit(least))


def keep(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, temperature: float = TEMPERATURE, seed: int = SEED) -> DataFrame:
    """`docs` that the sample keeps.  The keys are computed again where the rows are, which is cheaper
    than to shuffle the texts to their keys."""
    _, ratio, least = _sampled(docs, labels, rows, temperature, seed)
    (noise,) = unused(docs.columns, "noise")
    noisy = docs.withColumn(noise, gumbel(seed, F.col("doc_id").cast("bigint"), F.xxhash64(text_bytes(F.col("text")))))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = weights(batch.column(at).fill_null("").cast(pa.binary()), ratio)
            last = batch.num_columns - 1
            key = means(*found) / temperature + batch.column(last).to_numpy()
            yield batch.filter(pa.array(key >= least)).select(range(last))

    return noisy.mapInArrow(lean(run), docs.schema)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's weight and whether the sample keeps it."""
    return weigh(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("tk")
