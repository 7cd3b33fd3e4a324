"""Filter interaction audit: what each filter removes, at each place of each order of the filters.

A document is reduced to its mask, one bit per filter that it fails.  Rows of one part (a source), mask and pair of labels are counted
once, so the audit itself works on at most 32 x 4 weighted rows a part, whatever the number of documents:

* a mask row holds 0 where the filter fails and infinity elsewhere; a position matrix, the inverse of the permutations, holds the step of each filter
  in each order.  Their min-plus product is each mask's removal rank in each order: the step that removes it, or none;
* counts are scattered to (order, removal rank) with the rows' weights; a filter that fails at a later step than the rank is redundant there.

Whether a text is identical to one of a smaller id is found by digest (SHA-256 of its UTF-8 bytes): rows are counted per digest, part and labels before the
shuffle, together with the smallest id and the rows that have it, so that a text that a third of all rows hold is a few rows per task.

Defined results: a null text is the empty text, which fails A only (and E, if a smaller id's text is empty too); a very long text is read whole;
a null id is neither smaller nor larger than another (it never fails E, nor makes others fail) and has no labels; rows of one id tie, so a
repeated row fails E only for a smaller id; a document that is labelled more than once counts as good or toxic if any of its labels says so; a null
source is the part '', as an empty one; an empty table has no parts, so no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eodlake.llm.common import UPPER, map_batches, table, text_bytes

FILTERS = "ABCDE"
MIN_WORDS, DISTINCT_PERCENT, UPPER_PERCENT, SYMBOLS = 200, 50, 2, b"#$%&*|"
_UPPER, _CONTINUED = UPPER.encode(), bytes(range(0x80, 0xC0))
#: Bits of a signature: the five filters from bit 0 on, then good and toxic.
GOOD, TOXIC, SIGNATURES = 5, 6, 128

#: `orders` as letters, and the step (from 1) of each filter in each order: the permutations' inverses.
ORDERS = ["".join(p) for p in permutations(FILTERS)]
POSITIONS = np.array([[o.index(f) + 1 for f in FILTERS] for o in ORDERS])

SCHEMA = "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint"


def failures(text: bytes) -> int:
    """Bits of the filters that a text fails by itself (A to D)."""
    words = text.split()  # the white space of bytes is the six ASCII characters
    upper = len(text) - len(text.translate(None, _UPPER))
    points = len(text.translate(None, _CONTINUED))
    return (
        (len(words) < MIN_WORDS)
        | (100 * len(set(words)) < DISTINCT_PERCENT * len(words)) << 1
        | (100 * upper > UPPER_PERCENT * points) << 2
        | (len(text) != len(text.translate(None, SYMBOLS))) << 3
    )


def _read(docs: DataFrame) -> DataFrame:
    """-> doc_id, part, mask (A to D), digest: one row per row."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("source", F.lit("")).alias("part"), text_bytes(F.col("text")).alias("text"))

    def run(batch: pa.RecordBatch) -> dict[str, list]:
        texts = batch.column(2).to_pylist()
        return {"doc_id": batch.column(0), "part": batch.column(1), "mask": [failures(t) for t in texts], "digest": [hashlib.sha256(t).digest() for t in texts]}

    return map_batches(rows, run, "doc_id bigint, part string, mask int, digest binary")


def signatures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """-> part, signature (mask with E, good, toxic), n: documents by what they fail and are labelled."""
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(
        (F.max((F.col("quality") == 1).cast("int"))).alias("good"), (F.max((F.col("toxic") == 1).cast("int"))).alias("toxic")
    )
    read = _read(docs)
    named = read.where("doc_id is not null").join(marks, "doc_id", "left")
    bits = F.col("mask") + F.coalesce("good", F.lit(0)) * (1 << GOOD) + F.coalesce("toxic", F.lit(0)) * (1 << TOXIC)
    named = named.withColumn("signature", bits).groupBy("doc_id", "digest", "part", "signature").agg(F.count("*").alias("n"))
    # the smallest id of a group comes with the number of its rows: those don't fail E, if the id is the whole table's smallest too
    least = F.min(F.struct("doc_id", "n"))
    groups = named.groupBy("digest", "part", "signature").agg(F.sum("n").alias("n"), least.alias("least"))
    first = F.min("least.doc_id").over(Window.partitionBy("digest"))
    alone = F.when(F.col("least.doc_id") == first, F.col("least.n")).otherwise(F.lit(0).cast("bigint"))
    e = 1 << FILTERS.index("E")
    both = F.array(F.struct("signature", F.col("alone").alias("n")), F.struct((F.col("signature") + e).alias("signature"), (F.col("n") - F.col("alone")).alias("n")))
    split = groups.withColumn("alone", alone).select("part", F.explode(both).alias("s"))
    unnamed = read.where("doc_id is null").groupBy("part", F.col("mask").alias("signature")).agg(F.count("*").alias("n"))
    counted = split.select("part", "s.*").where("n > 0").union(unnamed)
    return counted.groupBy("part", "signature").agg(F.sum("n").alias("n"))


def removal_ranks() -> np.ndarray:
    """(masks x orders): the step that removes a mask, 6 if none does; the min-plus product of masks and positions."""
    masks = np.arange(1 << len(FILTERS))
    fails = masks[:, None] >> np.arange(len(FILTERS)) & 1
    cost = np.where(fails, 0.0, np.inf)  # masks x filters
    ranks = (cost[:, None, :] + POSITIONS[None, :, :]).min(axis=2)
    return np.where(np.isinf(ranks), len(FILTERS) + 1, ranks).astype(np.int64)


def audit_part(weights: np.ndarray, ranks: np.ndarray) -> dict[str, np.ndarray]:
    """Counts by (order, step) from the numbers of a part's documents by signature."""
    n_filters, orders = len(FILTERS), np.arange(len(ORDERS))
    by = weights.reshape(2, 2, 1 << n_filters)  # toxic, good, mask
    whole, good, toxic = by.sum((0, 1)), by[:, 1].sum(0), by[1].sum(0)

    def scatter(amount: np.ndarray) -> np.ndarray:
        out = np.zeros((len(ORDERS), n_filters + 2), np.int64)
        np.add.at(out, (orders[None, :], ranks), amount[:, None])
        return out[:, 1 : n_filters + 1]

    removed = scatter(whole)
    at = np.argsort(POSITIONS, axis=1)  # the filter of each step
    fails = (np.arange(1 << n_filters)[:, None] >> np.arange(n_filters) & 1).astype(bool)
    # of the documents that fail a step's filter, those that an earlier step has removed
    failing = fails[:, at]  # masks x orders x steps
    earlier = ranks[:, :, None] < np.arange(1, n_filters + 1)
    total = np.zeros(n_filters, np.int64)
    np.add.at(total, at, removed)
    return {
        "kept": whole.sum() - removed.cumsum(axis=1),
        "removed": removed,
        "redundant": (whole[:, None, None] * (failing & earlier)).sum(0),
        "unique_fails": whole[1 << np.arange(n_filters)][at],
        "good_lost": scatter(good),
        "toxic_lost": scatter(toxic),
        "shapley": total[at],
    }


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """-> SCHEMA: one row per part, order of the filters and step."""
    # at most 128 signatures a part
    parts = signatures(docs, labels).groupBy("part").agg(F.collect_list("signature").alias("signatures"), F.collect_list("n").alias("n"))

    def run(batch: pa.RecordBatch):
        ranks = removal_ranks()
        for part, signature, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            weights = np.zeros(SIGNATURES, np.int64)
            np.add.at(weights, signature, n)
            found = audit_part(weights, ranks)
            steps = len(FILTERS)
            head = {"part": [part] * len(ORDERS) * steps, "filter_order": np.repeat(ORDERS, steps), "step": np.tile(np.arange(1, steps + 1), len(ORDERS))}
            yield head | {k: v.ravel() for k, v in found.items()}

    return map_batches(parts, run, SCHEMA)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five filters over all `documents`, in all 120 orders, by source."""
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), l AS (
  SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), m AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, [
    len(w) < 200, 100 * list_unique(w) < 50 * len(w), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t),
    regexp_matches(t, '[#$%&*|]'), coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY t), false)] AS f
  FROM d LEFT JOIN l ON l.doc_id = d.doc_id
), g AS (
  SELECT part, f, count(*) AS n, count(*) FILTER (good) AS n_good, count(*) FILTER (toxic) AS n_toxic FROM m GROUP BY part, f
), k(i, c) AS (VALUES (1, 'A'), (2, 'B'), (3, 'C'), (4, 'D'), (5, 'E')
), p AS (
  SELECT [a.i, b.i, c.i, d.i, e.i] AS o, a.c || b.c || c.c || d.c || e.c AS filter_order FROM k a, k b, k c, k d, k e
  WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5
), s AS (
  SELECT part, filter_order, step::INT AS step, o[step] AS x, f[o[step]] AS fails, len(list_filter(o[:step - 1], lambda y: f[y])) > 0 AS gone, len(list_filter(f, lambda y: y)) AS n_fails, n, n_good, n_toxic
  FROM g, p, generate_series(1, 5) AS q(step)
), a AS (
  SELECT part, filter_order, step, x, coalesce(sum(n) FILTER (NOT gone AND NOT fails), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (NOT gone AND fails), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (gone AND fails), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (fails AND n_fails = 1), 0)::BIGINT AS unique_fails,
    coalesce(sum(n_good) FILTER (NOT gone AND fails), 0)::BIGINT AS good_lost, coalesce(sum(n_toxic) FILTER (NOT gone AND fails), 0)::BIGINT AS toxic_lost
  FROM s GROUP BY part, filter_order, step, x
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, x))::BIGINT AS shapley FROM a
"""
