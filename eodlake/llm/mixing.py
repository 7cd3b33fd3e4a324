"""Mixing sources to target weights by systematic sampling (DataFrame functions only).

Every document of a source has the same expected number of copies, target / source size.  The
expected copies are summed in an order of sizes, one random offset per source is added, and a
document is emitted once for each integer that its own step crosses.  Ordering by size spreads
the copies over short and long texts, so the words taken stay near the target.

Running sums are split: documents are ranked inside (source, size class, slice) groups, and the
groups' counts are summed per source.  A slice is a hash of the id, or of the text where the id is null, modulo their number: 16, or one per 2^20
documents where that is more.  A source of any size is thus ranked by many tasks, whatever its ids are.  Only the targets are set in one task, over one row per source; sources are corpora, not domains.

Defined results: a null text has size 0; a very long text is counted whole; null sources are one source, placed last; a source of
size 0 has target 0 and takes nothing; null ids count as id 0 for the order, and equal sizes and ids tie without effect on what
is taken of their texts' size; repeated rows are
ranked like any others; an empty table gives an empty result; extra columns are ignored by
`mix` and carried by `emit`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eodlake.llm.common import WORD, cut, table, unused

CAP, WEIGHTS, SLICES, SLICE_ROWS, SEED = 3.0, (1, 2, 3), 16, 1 << 20, "mix-1"


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("bigint"), F.lit(0).cast("bigint"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """(source, source_size) -> + weight, target: shares of all words by weight, none above
    cap x its source; what is cut off goes to the others by weight.

    Sources are taken in the order in which they meet their cap (cap x size / weight); with the
    first j capped, one level per weight is left for the rest.  The level rises until the next
    source is not capped by it.  One row per source, so a single ordered pass is small.
    """
    rank = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(rank) - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumn("weight", w).withColumn("_most", cap * F.col("source_size"))
    order = Window.orderBy(F.col("_most") / F.col("weight"), F.col("source").asc_nulls_last())
    before, everything = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    s = (
        s.withColumn("_capped", F.coalesce(F.sum("_most").over(before), F.lit(0.0)))
        .withColumn("_left", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("_level", (F.sum("source_size").over(everything) - F.col("_capped")) / F.col("_left"))
        .withColumn("_free", F.col("_level") * F.col("weight") <= F.col("_most"))
        .withColumn("_at", F.min(F.when(F.col("_free"), F.col("_most") / F.col("weight"))).over(everything))
        .withColumn("_share", F.min_by(F.when(F.col("_free"), F.col("_level")), F.when(F.col("_free"), F.col("_most") / F.col("weight"))).over(everything))
    )
    target = F.when(F.col("_share").isNotNull(), F.least(F.col("_share") * F.col("weight"), F.col("_most"))).otherwise(F.col("_most"))
    return s.select("source", "source_size", "weight", target.alias("target"))


def _offset(source: Column, seed: str) -> Column:
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(source, F.lit("<null>"))).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def size_class(size: Column) -> Column:
    """`size` cut to its three leading bits: grows with the size, few values."""
    unit = F.pow(F.lit(2.0), F.greatest(F.length(F.bin(size)) - 3, F.lit(0))).cast("bigint")
    return size - size % unit


def _key_hash(doc_id: Column, text: Column) -> Column:
    """31 bits of the id's digest, or of the text's where there is no id."""
    key = F.coalesce(doc_id.cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(text, F.lit("")).cast("binary"))))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("bigint")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED) -> DataFrame:
    """-> doc_id, source, size, source_size, target, copies, taken: one row per input row."""
    sized = cut(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), words_in(F.col(text_col)).alias("size"), _key_hash(F.col(id_col), F.col(text_col)).alias("_hash")), "sizes")
    return _mix_sized(sized, seed)


def _mix_sized(sized: DataFrame, seed: str) -> DataFrame:
    slices = max(SLICES, sized.count() // SLICE_ROWS)
    keyed = sized.withColumn("_class", size_class(F.col("size"))).withColumn("_slice", F.col("_hash") % slices)
    groups = cut(
        keyed.groupBy("source", "_class", "_slice").agg(F.count("*").alias("_n"), F.sum("size").alias("_words")), "groups"
    )
    goals = targets(groups.groupBy("source").agg(F.sum("_words").alias("source_size")))
    running = Window.partitionBy("source").orderBy("_class", "_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = groups.select(
        F.col("source").alias("_s"), F.col("_class").alias("_c"), F.col("_slice").alias("_l"), F.coalesce(F.sum("_n").over(running), F.lit(0)).alias("_before")
    )
    goals = goals.withColumnRenamed("source", "_s2")
    plan = offsets.join(goals, F.col("_s").eqNullSafe(F.col("_s2")))
    within = Window.partitionBy("source", "_class", "_slice").orderBy("size", F.coalesce("doc_id", F.lit(0)))
    ranked = keyed.withColumn("_rank", F.row_number().over(within))
    joined = ranked.join(plan, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_class") == F.col("_c")) & (F.col("_slice") == F.col("_l")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    at = F.col("_before") + F.col("_rank")
    copies = F.floor(rate * at + _offset(F.col("source"), seed)) - F.floor(rate * (at - 1) + _offset(F.col("source"), seed))
    return joined.select(
        "doc_id", "source", "size", "source_size", F.col("target"), copies.cast("bigint").alias("copies"), (copies * F.col("size")).cast("bigint").alias("taken")
    )


def emit(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """`docs` with each document once per copy taken, numbered from 1 in `copy_no` (which takes the place of a column of that name).

    Rows are matched by id; only where ids are repeated are rows of one id, source and size
    numbered, so that every row meets its own copies.
    """
    copies = mix(docs, seed=seed).select("doc_id", "source", "size", "copies")
    names = unused([*docs.columns, "doc_id", "source", "size", "copies"], "own", "of", "words", "times", "twin", "own_words", "own_twin")
    own, of, words, times, twin, own_words, own_twin = names
    copies = copies.toDF(own, of, words, times)
    if docs.groupBy("doc_id").count().where("count > 1").isEmpty():
        met = docs.join(copies.where(F.col(times) > 0).select(own, times), F.col("doc_id").eqNullSafe(F.col(own)))
    else:
        copies = copies.withColumn(twin, F.row_number().over(Window.partitionBy(own, of, words).orderBy(times)))
        left = docs.withColumn(own_words, words_in(F.col("text")))
        left = left.withColumn(own_twin, F.row_number().over(Window.partitionBy("doc_id", "source", own_words).orderBy(F.xxhash64("text"))))
        same = [F.col(x).eqNullSafe(F.col(y)) for x, y in (("doc_id", own), ("source", of), (own_words, words), (own_twin, twin))]
        met = left.join(copies, same[0] & same[1] & same[2] & same[3]).where(F.col(times) > 0)
    kept = [c for c in docs.columns if c != "copy_no"]
    return met.select(*kept, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(times))).alias("copy_no"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All `documents` mixed by the weights 1, 2, 3: words taken of each."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'text:' || md5(coalesce(text, '')))), 1, 8))::BIGINT AS h FROM documents
), k AS (
  SELECT *, size - size % (1::BIGINT << greatest(length(bin(size)) - 3, 0)) AS c,
         h % greatest(16, (SELECT count(*) FROM documents) // 1048576) AS l FROM d
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, [1.0, 2.0, 3.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight, 3.0 * source_size AS most FROM s
), x AS (
  SELECT *, most::DOUBLE / weight AS ratio,
         coalesce(sum(most::DOUBLE) OVER (ORDER BY most::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
         sum(weight) OVER (ORDER BY most::DOUBLE / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_w,
         sum(source_size) OVER () AS total FROM w
), y AS (
  SELECT *, (total::DOUBLE - capped) / left_w AS level FROM x
), z AS (
  SELECT (SELECT level FROM y WHERE level * weight <= most::DOUBLE ORDER BY ratio LIMIT 1) AS share
), t AS (
  SELECT source, source_size, least(coalesce(share * weight, most::DOUBLE), most::DOUBLE) AS target FROM y, z
), r AS (
  SELECT k.doc_id, k.source, k.size, row_number() OVER (PARTITION BY k.source ORDER BY c, l, size, coalesce(doc_id, 0)) AS n FROM k
), o AS (
  SELECT r.*, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
         ('0x' || substr(md5('mix-1:' || coalesce(r.source, '<null>')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
  FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source
), q AS (
  SELECT *, (floor(rate * n + u) - floor(rate * (n - 1) + u))::BIGINT AS copies FROM o
)
SELECT doc_id, size, source_size, target, copies * size AS taken, source, copies FROM q
"""
