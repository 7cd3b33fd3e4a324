"""URL filters by a Bloom filter cascade (DataFrame functions only).

The first level encodes the listed keys; every further level encodes the keys of the known
universe that the level before accepts wrongly, until none is left.  The first level that
rejects a key settles it: an odd level says "not listed", an even one "listed".  Over the keys
of the universe the answer is exact, whatever the sizes.

The first level is so large that about as many unlisted keys pass it as there are listed ones; further levels have
`BITS_PER_KEY` bits a key, and each holds about a quarter of the one before the last.  So the bits grow with the listed keys and
the logarithm of the others' share.  Keys fall into shards by a hash, whose bits are one row of at most about `MAX_BITS` bits a level; a
row of the pages meets the filter of its shard, never the list.  Spark sends a small filter to every task and deals out a large one.

Defined results: a null url and one without `://` have an empty host and path, no rule, and are
allowed; a very long url is read whole; of rules that fit equally long the last by name wins; repeated rows are judged alike, each where it
is; an empty table gives an empty result; extra columns of the input are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil, log2

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eodlake.llm.common import ascii_lower, cut, table

#: Bits and hashes of a key in the levels after the first; the most hashes in the first; bits of a shard in one level.
BITS_PER_KEY, HASHES, MOST_HASHES, MAX_BITS = 3, 2, 10, 1 << 23
PAGE = 256  # words that are filled together

#: The contract's rules as (host, path, verdict).
RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)


def host_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3))
    host = F.coalesce(ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", 1)), F.lit(""))
    return host, F.coalesce(F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", 2), F.lit(""))


@dataclass
class Level:
    """Number of bits in a shard, hashes of a key, and a salt: other hashes at each level, or keys that meet once would always meet."""

    bits: int
    hashes: int
    salt: int

    def positions(self, key: Column) -> list[Column]:
        # cut short, so that sums of multiples cannot overflow
        h1, h2 = (F.shiftright(F.xxhash64(key, F.lit(2 * self.salt + i)), 8) for i in (0, 1))
        return [F.pmod(h1 + F.lit(i) * h2, F.lit(self.bits)) for i in range(self.hashes)]

    def passes(self, key: Column, filled: Column) -> Column:
        """Whether all of a key's bits are set; a shard without keys has no bits."""
        out = F.lit(True)
        for p in self.positions(key):
            out &= F.getbit(F.element_at(filled, (F.floor(p / 64) + 1).cast("int")), (p % 64).cast("int")) == 1
        return F.coalesce(out, F.lit(False))

    def fill(self, keys: DataFrame) -> DataFrame:
        """(shard, key) -> shard, and the words of its bits in the column `l` and the salt."""
        at = keys.select("shard", F.explode(F.array(*self.positions(F.col("key")))).alias("p"))
        words = at.groupBy("shard", F.floor(F.col("p") / 64).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("b"))
        # words to pages, pages to the shard: a gap is looked for among `PAGE` words or among the pages, never among all words
        none = F.lit(0).cast("bigint")
        listed = lambda k, v: F.map_from_entries(F.collect_list(F.struct(k, v)))
        filled = lambda m, n, gap: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.coalesce(F.element_at(m, i), gap))
        page, last = F.floor(F.col("w") / PAGE).cast("int").alias("page"), self.bits // 64
        pages = words.groupBy("shard", page).agg(listed((F.col("w") % PAGE).alias("w"), "b").alias("m")).select("shard", "page", filled("m", PAGE, none).alias("words"))
        packed = pages.groupBy("shard").agg(listed("page", "words").alias("m"))
        full = F.slice(F.flatten(filled("m", ceil(last / PAGE), F.array_repeat(none, PAGE))), 1, last)
        return packed.select("shard", full.alias(f"l{self.salt}"))


@dataclass
class Cascade:
    """`filters`: one row per shard with an array of words for each level."""

    levels: list[Level]
    filters: DataFrame | None
    shards: int

    @classmethod
    def build(cls, keys: DataFrame, max_bits: int = MAX_BITS) -> Cascade:
        """`keys`: the universe as (key STRING, listed BOOLEAN), each key once."""
        rest = cut(keys, "universe")
        n, others = rest.agg(F.count_if("listed"), F.count_if(~F.col("listed"))).first()
        if not n:
            return cls([], None, 1)
        hashes = min(MOST_HASHES, max(HASHES, round(log2(max(others, 1) / n)) if others > n else HASHES))
        per_key = max(BITS_PER_KEY, ceil(1.45 * hashes))
        shards = max(1, ceil(n * per_key / max_bits))
        rest = rest.withColumn("shard", F.pmod(F.xxhash64("key", F.lit(-1)), F.lit(shards)).cast("int"))
        out, flag = cls([], None, shards), True
        while n:
            level = Level(64 * max(1, ceil(n * per_key / shards / 64)), hashes, len(out.levels) + 1)
            filled = cut(level.fill(rest.where(F.col("listed") == flag)), "level")
            out.levels.append(level)
            out.filters = filled if out.filters is None else out.filters.join(filled, "shard", "full")
            # the level's own keys go on (all pass it); of the others those that pass wrongly
            met = rest.join(filled, "shard", "left")
            rest = cut(met.where((F.col("listed") == flag) | level.passes(F.col("key"), F.col(f"l{level.salt}"))).select(*rest.columns), "universe")
            flag, hashes, per_key = not flag, HASHES, BITS_PER_KEY
            n = rest.where(F.col("listed") == flag).count()
        out.filters = cut(out.filters, "cascade")
        return out

    def _settled(self, key: Column, filled: list[Column]) -> Column:
        answer = F.lit(len(self.levels) % 2 == 1)
        for i in range(len(self.levels) - 1, -1, -1):
            answer = F.when(~self.levels[i].passes(key, filled[i]), F.lit(i % 2 == 1)).otherwise(answer)
        return answer

    def marked(self, df: DataFrame, key: Column, name: str) -> DataFrame:
        """`df` with a column that says whether the key is listed; exact for keys of the universe."""
        if self.filters is None:
            return df.withColumn(name, F.lit(False))
        met = df.withColumn("shard", F.pmod(F.xxhash64(key, F.lit(-1)), F.lit(self.shards)).cast("int")).join(self.filters, "shard", "left")
        return met.select(*df.columns, self._settled(key, [F.col(f"l{x.salt}") for x in self.levels]).alias(name))

    def with_listed(self, df: DataFrame, keys: Column, name: str) -> DataFrame:
        """`df` with those of an array of keys of the universe that are listed; for lists of one shard, such as written rules."""
        if self.filters is None:
            return df.withColumn(name, F.slice(keys, 1, 0))
        if self.shards > 1:
            raise ValueError("the list has several shards")
        filled = [F.col(f"l{x.salt}") for x in self.levels]
        met = df.withColumn("shard", F.pmod(F.hash(F.monotonically_increasing_id()), F.lit(self.shards))).join(F.broadcast(self.filters), "shard", "left")
        return met.select(*df.columns, F.filter(keys, lambda key: self._settled(key, filled)).alias(name))


def candidates(host: Column, path: Column, lengths: list[int]) -> Column:
    """Keys that could be listed: each domain above or at the host, with each path prefix of the
    lengths that the rules have, longest first; the host itself with no path comes last."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in sorted(set(lengths), reverse=True)])
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))
    return F.when(host != "", F.array_compact(keys)).otherwise(F.array().cast("array<string>"))


def judge(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, listed_hosts: DataFrame | None = None) -> DataFrame:
    """-> page_id, host, path, rule, verdict, listed_host.

    `rules` are few and written out; `listed_hosts` (host) may be large.  Each is a cascade of its own, the rules' over the
    universe of all candidate keys of `pages`, the hosts' over all hosts.  Where no rule fits,
    pages of a listed host are blocked and the others allowed.
    """
    spark = pages.sparkSession
    host, path = host_path(F.col("url"))
    base = pages.select("page_id", host.alias("host"), path.alias("path"))
    keys = candidates(F.col("host"), F.col("path"), [len(p) for _, p, _ in rules])
    written = spark.range(1).select(F.explode(F.array(*[F.lit(h + p) for h, p, _ in rules]) if rules else F.array().cast("array<string>")).alias("key"))
    ruled = Cascade.build(_universe(base.select(F.explode(keys).alias("key")), written), 1 << 30)
    if listed_hosts is not None:
        listed = Cascade.build(_universe(base.select(F.col("host").alias("key")), listed_hosts.select(F.col("host").alias("key"))))
        base = listed.marked(base, F.col("host"), "listed_host")
    else:
        base = base.withColumn("listed_host", F.lit(False))
    hits = F.transform("hits", lambda k: F.struct(F.length(k).alias("n"), k.alias("k")))
    found = ruled.with_listed(base, keys, "hits").withColumn("rule", F.array_max(hits)["k"])
    said = F.when(F.col("listed_host"), F.lit("block")).otherwise(F.lit("allow"))
    for h, p, v in rules:
        said = F.when(F.col("rule") == h + p, F.lit(v)).otherwise(said)
    return found.select("page_id", "host", "path", "rule", said.alias("verdict"), "listed_host")


def _universe(seen: DataFrame, listed: DataFrame) -> DataFrame:
    """Keys met and keys listed -> key, listed."""
    both = seen.distinct().select("key", F.lit(False).alias("l")).union(listed.select("key", F.lit(True).alias("l")))
    return both.groupBy("key").agg(F.max("l").alias("listed"))


def tracked_hosts(pages: DataFrame) -> DataFrame:
    """The list used by the query: hosts that hand out a link with a `utm_` campaign tag."""
    host, _ = host_path(F.col("url"))
    return pages.where(F.col("url").contains("utm_")).select(host.alias("host")).where("host <> ''").distinct()


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every url of `pages` against the rules and the list of tracked hosts."""
    pages = table(spark, sf_dir, "pages")
    return judge(pages, RULES, tracked_hosts(pages))


OP3_SQL = r"""
WITH u AS (
  SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, url,
         translate(regexp_extract(rest, '^([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^([^/?#]*)([^?#]*)', 2) AS path FROM u
), t AS (
  SELECT DISTINCT host FROM p WHERE contains(url, 'utm_') AND host <> ''
), rules(rhost, rpath, v) AS (
  VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')
), j AS (
  SELECT p.*, (SELECT max_by(struct_pack(r := rhost || rpath, v := v), length(rhost || rpath)) FROM rules
               WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)) AS fit FROM p
)
SELECT page_id, host, path, fit.r AS rule,
       coalesce(fit.v, CASE WHEN host IN (SELECT host FROM t) THEN 'block' ELSE 'allow' END) AS verdict,
       host IN (SELECT host FROM t) AS listed_host
FROM j
"""
