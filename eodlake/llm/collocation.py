"""Phrase collocation mining by partitioning (SON): shards are mined at lowered support, then candidates are counted exactly.

Everything is per language.  Texts are cut to blocks of bounded size (at breaks, which no phrase crosses); a block belongs to one of `SHARDS` shards of its
language.  Shards grow with the corpus, so each is mined by many tasks; they are few, as a support of 10 leaves little to lower it by (two shards
of a half ask for 5 each):

* first pass: each block counts its phrases of 1 to 3 words by 48-bit hashes and sends them, sorted and packed, to the hashes' buckets.  There the counts of
  each shard are complete, and a hash that reaches the shard's support (the global support times the shard's share of the words, rounded up) in any shard is a
  candidate: a phrase that is frequent in all reaches it somewhere.  Equal hashes of different phrases only add candidates;
* second pass: each block gets the candidates that it holds, counts their phrases exactly, as words, and sends these counts alone.  Their sums are
  the global counts.

Parts of a frequent phrase are frequent, so scores find all their counts among these.  Products are decimals of 38 digits: exact for counts up to
10^16.

Defined results: a null text has no words, a null language is `und`; a very long text is cut to several blocks, at breaks (a piece without a break stays
whole); ties go by score, count and then the bytes of the phrase; repeated rows count as often as they stand; an empty table gives an empty
result; ids are not read, so null ones change nothing; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eodlake.llm.common import cut, gathered, pack, parted, table, text_bytes, unpack

SUPPORT, LONGEST, SHARDS, TOP, INSIDE_PERCENT = 10, 3, 2, 2000, 50
BLOCK_BYTES, BUCKET_ROWS, SPLITS = 8 << 20, 1 << 18, 128
FEW = 10_000  # shards' supports that are broadcast
UNKNOWN_LANG = "und"
#: Breaks between pieces become line ends, the white space between words blanks.
_BREAKS = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\t", b"\n" * 10 + b" ")
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def _sections(text: bytes, size: int) -> Iterator[bytes]:
    """Stretches of about `size` bytes that end at breaks."""
    at = 0
    while len(text) - at > size:
        end = text.rfind(b"\n", at, at + size)
        end = text.find(b"\n", at + size) if end < 0 else end
        if end < 0:
            break
        yield text[at:end]
        at = end + 1
    yield text[at:]


def blocks(docs: DataFrame, size: int = BLOCK_BYTES, shards: int = SHARDS) -> DataFrame:
    """-> block, lang, shard, n_words, text (compressed): texts of one language put together, up to about `size` bytes."""
    rows = docs.select(F.coalesce("lang", F.lit(UNKNOWN_LANG)).alias("lang"), text_bytes(F.col("text")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdCompressor(level=3)
        held: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}

        def flushed(lang: str) -> pa.RecordBatch:
            text = b"\n".join(held.pop(lang))
            del sizes[lang]
            return pa.record_batch([pa.array([lang]), pa.array([len(text.split())], pa.int64()), pa.array([press.compress(text)])], names=["lang", "n_words", "text"])

        for batch in batches:
            for lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for section in _sections(text.lower().translate(_BREAKS), size):
                    held.setdefault(lang, []).append(section)
                    sizes[lang] = sizes.get(lang, 0) + len(section) + 1
                    if sizes[lang] >= size:
                        yield flushed(lang)
                    # many languages share the bound
                    if sum(sizes.values()) >= 2 * size:
                        yield flushed(max(sizes, key=sizes.get))
        for lang in list(held):
            yield flushed(lang)

    made = rows.mapInArrow(run, "lang string, n_words bigint, text binary").withColumn("block", F.monotonically_increasing_id())
    return made.withColumn("shard", F.pmod(F.xxhash64("block"), F.lit(shards)).cast("int"))


class Block:
    """A block's phrases: places of words, and the exact keys and hashes of the phrases that start there."""

    def __init__(self, lang: str, text: bytes) -> None:
        import xxhash

        tokens = text.replace(b"\n", b" \n ").split(b" ")
        number = {b"": 0, b"\n": 1}
        ids = np.fromiter((number.setdefault(t, len(number)) for t in tokens), np.int64, len(tokens))
        self.ids, self.words = ids[ids != 0], list(number)
        seed = xxhash.xxh32_intdigest(lang.encode())
        digests = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in self.words), np.uint64, len(self.words))
        self.digests = digests[self.ids]

    def starts(self, k: int) -> np.ndarray:
        """Places where k words stand in one piece."""
        n = len(self.ids) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        whole = self.ids[:n] > 1
        for j in range(1, k):
            whole &= self.ids[j : n + j] > 1
        return np.flatnonzero(whole)

    def hashes(self, at: np.ndarray, k: int) -> np.ndarray:
        out = np.full(len(at), k, np.uint64)
        for j in range(k):
            out = (out ^ self.digests[at + j]) * _ODD[j]
            out ^= out >> np.uint64(29)
        return out >> np.uint64(16)

    def counted(self, at: np.ndarray, k: int) -> tuple[list[str], np.ndarray]:
        """Phrases at these places and their exact counts."""
        key = self.ids[at]
        for j in range(1, k):
            _, key = np.unique(key, return_inverse=True)  # ranks stay below the number of places, so keys stay below 2^63
            key = key * len(self.words) + self.ids[at + j]
        _, first, n = np.unique(key, return_index=True, return_counts=True)
        columns = [[self.words[i] for i in self.ids[at[first] + j]] for j in range(k)]
        return [b" ".join(p).decode() for p in zip(*columns, strict=True)], n


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(16)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _packed(hashes: np.ndarray, *others: np.ndarray) -> bytes:
    """Ascending hashes as differences, byte by byte, which compress well."""
    steps = np.diff(hashes, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8)
    return pack(np.ascontiguousarray(steps.T), *others)


def _unpacked(blob: bytes) -> tuple[np.ndarray, ...]:
    steps, *others = unpack(blob)
    return np.cumsum(np.ascontiguousarray(steps.T).view(np.uint64).ravel(), dtype=np.uint64), *others


def lowered_supports(cut_blocks: DataFrame, support: int) -> DataFrame:
    """-> lang, shard, support: the shard's share of `support`, rounded up (in whole numbers, as a rounding error could lose a phrase), 1 at least."""
    totals = cut_blocks.groupBy("lang", "shard").agg(F.sum("n_words").alias("own"))
    totals = totals.withColumn("all", F.greatest(F.sum("own").over(Window.partitionBy("lang")), F.lit(1)))
    return totals.select("lang", "shard", F.greatest(F.expr(f"({support} * own + all - 1) div all"), F.lit(1)).cast("int").alias("support"))


def candidates(spark: SparkSession, cut_blocks: DataFrame, support: int = SUPPORT) -> DataFrame:
    """-> block, blob: the hashes of each block that are frequent in a shard (one row per block and bucket)."""
    lowered = lowered_supports(cut_blocks, support)
    if lowered.limit(FEW + 1).count() <= FEW:
        lowered = F.broadcast(lowered)
    n = cut_blocks.agg(F.sum("n_words")).first()[0] or 0
    buckets = math.ceil(LONGEST * n / BUCKET_ROWS) or 1
    asked = cut_blocks.join(lowered, ["lang", "shard"]).select("block", "lang", "shard", "support", "text")

    def mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        for batch in batches:
            for block, lang, shard, least, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                b = Block(lang, zstandard.ZstdDecompressor().decompress(text))
                hashes, counts = np.unique(np.concatenate([b.hashes(b.starts(k), k) for k in range(1, LONGEST + 1)]), return_counts=True)
                counts = counts.astype(np.min_scalar_type(counts.max(initial=0)))
                out = [(k, _packed(hashes[at], counts[at], (block, shard, least))) for k, at in parted(_bucket(hashes, buckets))]
                yield pa.record_batch([pa.array([k for k, _ in out], pa.int64()), pa.array([x for _, x in out], pa.binary())], names=["bucket", "blob"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, blobs in gathered(batches):
            parts = [_unpacked(x) for x in blobs]
            hashes, counts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1].astype(np.int64) for p in parts])
            sizes = [len(p[0]) for p in parts]
            shard, least = (np.repeat([p[2][i] for p in parts], sizes) for i in (1, 2))
            found, inverse = np.unique(hashes, return_inverse=True)
            frequent = np.zeros(len(found), bool)
            for s in np.unique(shard):
                own = shard == s
                # two languages may share a hash: the smaller support counts
                low = np.full(len(found), np.iinfo(np.int64).max)
                np.minimum.at(low, inverse[own], least[own])
                frequent |= np.bincount(inverse[own], counts[own], len(found)) >= low
            kept, at, out = frequent[inverse], 0, []
            for p, size in zip(parts, sizes, strict=True):
                if (some := p[0][kept[at : at + size]]).size:
                    out.append((p[2][0], _packed(some)))
                at += size
            yield pa.record_batch([pa.array([x for x, _ in out], pa.int64()), pa.array([x for _, x in out], pa.binary())], names=["block", "blob"])

    mined = asked.mapInArrow(mine, "bucket bigint, blob binary").repartition("bucket").sortWithinPartitions("bucket")
    return cut(mined.mapInArrow(meet, "block bigint, blob binary"), "candidates")


def exact_counts(cut_blocks: DataFrame, frequent: DataFrame, support: int = SUPPORT) -> DataFrame:
    """-> lang, phrase, k, n: all candidates that reach the support, counted exactly."""
    texts = cut_blocks.select("block", "lang", F.col("text").alias("blob"))
    both = texts.unionByName(frequent.withColumn("lang", F.lit(None).cast("string")))
    met = both.repartition("block").sortWithinPartitions("block", F.col("lang").isNull()).select("block", "lang", "blob")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        def phrases(lang: str, text: bytes, hashes: np.ndarray) -> Iterator[pa.RecordBatch]:
            b = Block(lang, zstandard.ZstdDecompressor().decompress(text))
            for k in range(1, LONGEST + 1):
                at = b.starts(k)
                own = b.hashes(at, k)
                place = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
                found, n = b.counted(at[hashes[place] == own], k)
                for i in range(0, len(found), 10_000):
                    part = found[i : i + 10_000]
                    yield pa.record_batch([pa.array([lang] * len(part)), pa.array(part, pa.string()), pa.array([k] * len(part), pa.int32()), pa.array(n[i : i + 10_000], pa.int64())], names=["lang", "phrase", "k", "n"])

        lang = text = None
        held: list[np.ndarray] = []
        for batch in batches:
            for _, own, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own is None:
                    held.append(_unpacked(blob)[0])
                    continue
                if held:
                    yield from phrases(lang, text, np.sort(np.concatenate(held)))
                lang, text, held = own, blob, []
        if held:
            yield from phrases(lang, text, np.sort(np.concatenate(held)))

    counted = met.mapInArrow(count, "lang string, phrase string, k int, n bigint")
    return counted.groupBy("lang", "phrase", "k").agg(F.sum("n").alias("n")).where(F.col("n") >= support)


def scored(counts: DataFrame) -> DataFrame:
    """(lang, phrase, k, n) -> lang, phrase, a, l, r, score of the lowest-scoring cut, without phrases that stand mostly inside a longer one."""
    words = F.split("phrase", " ")
    join = lambda lo, n: F.concat_ws(" ", F.slice(words, lo, n))
    phrases = counts.where("k > 1").select("lang", "phrase", "k", F.col("n").alias("a"))
    inside = phrases.where(f"k = {LONGEST}").select("lang", "a", F.explode(F.array(join(F.lit(1), F.lit(LONGEST - 1)), join(F.lit(2), F.lit(LONGEST - 1)))).alias("phrase"))
    inside = inside.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = phrases.join(inside, ["lang", "phrase"], "left").where(~F.coalesce(100 * F.col("longer") >= INSIDE_PERCENT * F.col("a"), F.lit(False)))
    cuts = kept.select("lang", "phrase", "k", "a", F.explode(F.expr("sequence(1, k - 1)")).alias("cut"))
    cuts = cuts.withColumn("first", join(F.lit(1), F.col("cut"))).withColumn("rest", join(F.col("cut") + 1, F.col("k") - F.col("cut")))
    part = lambda key, n: counts.select("lang", F.col("phrase").alias(key), F.col("n").alias(n))
    met = cuts.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"])
    big = lambda c: f"cast({c} as decimal(16, 0))"
    # the product of 39 digits that Spark plans for fits in 38 up to counts of 10^16
    score = F.expr(f"cast(1000000 as decimal(7, 0)) * cast({big('a')} * {big('a')} as decimal(31, 0)) div ({big('l')} * {big('r')})")
    lowest = F.min(F.struct(score.alias("score"), "cut", "l", "r"))
    return met.groupBy("lang", "phrase", "a").agg(lowest.alias("s")).select("lang", "phrase", "a", "s.l", "s.r", "s.score")


def collocations(docs: DataFrame, support: int = SUPPORT, top: int = TOP) -> DataFrame:
    """-> lang, rank, phrase, a, l, r, n, score: the first `top` phrases of each language."""
    spark = docs.sparkSession
    made = cut(blocks(docs), "blocks")
    sizes = made.groupBy("lang").agg(F.sum("n_words").alias("n"))
    counts = cut(exact_counts(made, candidates(spark, made, support), support), "phrases")
    found = scored(counts)
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # the first of each split, then of all splits
    split = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SPLITS))).orderBy(*order)
    some = found.withColumn("rank", F.row_number().over(split)).where(F.col("rank") <= top)
    first = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).where(F.col("rank") <= top)
    return first.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of each language in all `documents`."""
    return collocations(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p
), s AS (
  SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang
), g AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM w, (VALUES (1), (2), (3)) AS x(k) WHERE len(w) >= k
), f AS (
  SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 10
), c AS (
  SELECT *, string_split(phrase, ' ') AS v FROM f WHERE k > 1
), i AS (
  SELECT lang, phrase, max(a) AS longer FROM (SELECT lang, a, unnest([array_to_string(v[1:2], ' '), array_to_string(v[2:3], ' ')]) AS phrase FROM c WHERE k = 3) GROUP BY ALL
), o AS (
  SELECT c.*, j FROM c LEFT JOIN i ON i.lang = c.lang AND i.phrase = c.phrase, (VALUES (1), (2)) AS y(j) WHERE j < c.k AND NOT coalesce(100 * longer >= 50 * a, false)
), t AS (
  SELECT o.lang, o.phrase, o.a, l.a AS l, r.a AS r, ((1000000::HUGEINT * o.a * o.a) // (l.a::HUGEINT * r.a))::BIGINT AS score, j
  FROM o JOIN f l ON l.lang = o.lang AND l.phrase = array_to_string(v[1:j], ' ') JOIN f r ON r.lang = o.lang AND r.phrase = array_to_string(v[j + 1:], ' ')
), b AS (
  SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1
)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM b JOIN s ON s.lang = b.lang QUALIFY rank <= 2000
"""
