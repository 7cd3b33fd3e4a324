"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints are distinct first (equal ones are one node).  They have one or more words of 64 bits.
Of two fingerprints within the radius, one word differs in at most radius / words bits, so by the
pigeonhole principle this word agrees on `blocks - block_radius` of its `blocks` blocks, and the two
meet in at least one bucket of equal block combinations.  Inside a bucket the
fingerprints stand as bit planes: plane b holds bit b of 64 fingerprints in each word.  One
query against a plane is one XOR for 64 distances; the differing bits are summed by carry-save
counters, and a block of fingerprints is left as soon as all of its counters exceed the radius.

A bucket of more than `TILE` fingerprints is split into tiles, and every pair of tiles is a group
of its own: no task holds a whole bucket and no link is lost.  A group gives links that span its
components, never all of its pairs.

Blocks grow with the number of different fingerprints, so that a bucket holds a few random ones at most:
the keys and comparisons of a document stay level.

The pipeline's stage (`keep_first`) goes by the exact similarity of shingle sets: fingerprints only
propose pairs there, in the same buckets but at a wider radius, and a prefix filter over rare shingles finds those that they miss.
Before texts are asked for, pairs are cut down by bitmaps of their sets, whose differing bits are at most the shingles that differ.

Defined results: a null or blank text has fingerprint zero and links like any other; texts of
fewer words than a shingle are one shingle; a very long text is hashed whole, its bits summed `CHUNK` shingles at once; a bit
that is set in just half of the hashes is 0; repeated rows come back each; rows of a null id link like any others, but are no
component's smallest (a component of null ids only has a null one); an empty table gives an empty result;
components are followed until they settle, however many rounds that takes;
extra columns are ignored by `near_duplicates` and carried by `keep_first`.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eodlake.llm.common import components, cut, gathered, lean, map_batches, pack, parted, passing, table, text_bytes, unpack, unused

SEED, TILE, CHUNK, AT_ONCE, THRESHOLD = 42, 1024, 1 << 15, 1 << 17, 0.8
#: The stage compares fingerprints within this many bits; counts of shingles are kept by `SKETCH` hashes of them.
WIDE, SKETCH, SLICE, PART_ROWS = 13, 1 << 22, 1 << 18, 1 << 18
SLOTS = 1024


def shingle_hashes(words: list[bytes], n: int, seed: int = SEED) -> list[int]:
    """XXH64 of each n-word shingle, repeats included; fewer words make one shingle."""
    hash64 = xxhash.xxh64_intdigest
    if len(words) <= n:
        return [hash64(b" ".join(words), seed)] if words else []
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[: -n]))
    return [hash64(joined[a:b], seed) for a, b in zip(starts.tolist(), (ends[n - 1 :] - 1).tolist(), strict=True)]


def majority_bits(hashes: list[int]) -> int:
    """A bit is 1 if it is set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), CHUNK):
        h = np.array(hashes[at : at + CHUNK], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def simhash(text: bytes, shingle: int = 4, seed: int = SEED) -> int:
    return majority_bits(shingle_hashes(text.lower().split(), shingle, seed))  # bytes.lower() and split() are ASCII only


def fingerprints(docs: DataFrame, shingle: int = 4, seeds: tuple[int, ...] = (SEED,), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """-> doc_id, fp ARRAY<BIGINT>: 64 bits per seed, each as a signed number."""

    def run(batch: pa.RecordBatch) -> dict[str, list]:
        fps = []
        for t in batch.column(1):
            words = t.as_py().lower().split()
            fps.append([majority_bits(shingle_hashes(words, shingle, s)) for s in seeds])
        return {"doc_id": batch.column(0), "fp": np.array(fps, np.uint64).view(np.int64).tolist()}

    return map_batches(docs.select(F.col(id_col).cast("bigint"), text_bytes(F.col(text_col)).alias("text")), run, "doc_id bigint, fp array<bigint>")


def _keys(words: list[Column], radius: int, blocks: int) -> Column:
    """Bucket keys: the number of the word and combination, and the bits of its blocks."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    masks = [(1 << edges[i + 1]) - (1 << edges[i]) for i in range(blocks)]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    some = [sum(masks[b] for b in c) for c in combinations(range(blocks), blocks - radius)]
    each = [F.struct(F.lit(w * len(some) + i).alias("c"), fp.bitwiseAND(F.lit(signed(m))).alias("bits")) for w, fp in enumerate(words) for i, m in enumerate(some)]
    return F.explode(F.array(*each))


def planes(fps: np.ndarray) -> np.ndarray:
    """(n, words) uint64 fingerprints -> a row of words per bit; bit j of word w in row b is bit b of fingerprint 64w + j."""
    bits = np.unpackbits(np.ascontiguousarray(fps, "<u8").view(np.uint8), axis=1, bitorder="little")
    full = np.zeros((-(-len(fps) // 64) * 64, bits.shape[1]), np.uint8)
    full[: len(fps)] = bits
    return np.ascontiguousarray(np.packbits(full.T, axis=1, bitorder="little")).view("<u8")


def within(diff, n_planes: int, shape, radius: int) -> np.ndarray:
    """Bits of the columns whose count over the planes `diff(b)` is at most `radius`.

    Carry-save counters: one word per bit of the count and column word; what is carried out of the last one
    has passed the radius.  Columns that passed stay marked; when all have, the block is left."""
    counters = [np.zeros(shape, np.uint64) for _ in range(radius.bit_length())]
    over = np.zeros(shape, np.uint64)
    for b in range(n_planes):
        carry = diff(b)
        for i, c in enumerate(counters):
            counters[i], carry = c ^ carry, c & carry
        over |= carry
        if b % 8 == 7 and b > 2 * radius:
            over |= _above(counters, radius)
            if not np.any(~over):
                break
    return ~(over | _above(counters, radius))


def _above(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Columns whose count exceeds `radius`."""
    above = np.zeros_like(counters[0])
    same = ~above
    for bit, c in reversed(list(enumerate(counters))):
        if radius >> bit & 1:
            same &= c
        else:
            above |= same & c
            same &= ~c
    return above


def _unpacked(words: np.ndarray, n: int) -> np.ndarray:
    return np.unpackbits(words.view(np.uint8), bitorder="little")[:n].astype(bool)


def linked(fps: np.ndarray, group: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between fingerprints of the same group (groups stand together): (a, b) positions.

    Small groups are compared at once: lag d sets each fingerprint against the one d places on,
    so each plane is one XOR with the planes of those d places on.  Larger groups are searched from
    queries (`_linked_large`)."""
    n, out_a, out_b = len(fps), [], []
    start = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    size = np.diff(np.concatenate((start, [n])))
    # small groups, the largest first: those that reach lag d are a prefix
    few = np.flatnonzero(size <= 64)
    few = few[np.argsort(-size[few], kind="stable")]
    reach = size[few]
    at = np.repeat(start[few] - np.cumsum(reach) + reach, reach) + np.arange(reach.sum())
    g = np.repeat(np.arange(len(few)), reach)
    p = np.pad(planes(fps[at]), ((0, 0), (0, 1))) if len(at) else None
    for d in range(1, int(reach.max(initial=1))):
        m = int(reach[reach > d].sum())
        w, right, left = -(-m // 64), np.uint64(d), np.uint64(64 - d)
        # bit j of the shifted plane is bit j + d of the plane
        ok = _unpacked(within(lambda b, w=w, right=right, left=left: p[b, :w] ^ (p[b, :w] >> right | p[b, 1 : w + 1] << left), len(p), w, radius), m)
        i = np.flatnonzero(ok[: len(at) - d])
        i = i[g[i] == g[i + d]]
        out_a.append(at[i])
        out_b.append(at[i + d])
    for s, m in zip(start[size > 64].tolist(), size[size > 64].tolist(), strict=True):
        for a, b in _linked_large(fps, np.arange(s, s + m), radius):
            out_a.append(a)
            out_b.append(b)
    if not out_a:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(out_a), np.concatenate(out_b)


def _hits(fps: np.ndarray, q: np.ndarray, rest: np.ndarray, radius: int) -> np.ndarray:
    """Which of the columns `rest` are within the radius of which queries `q`."""
    p, bits = planes(fps[rest]), planes(fps[q])
    # all ones where the query's bit is set, one row per query
    flip = np.stack([np.where(_unpacked(bits[b], len(q)), ~np.uint64(0), np.uint64(0)) for b in range(len(p))])[:, :, None]
    ok = within(lambda b: p[b][None, :] ^ flip[b], len(p), (len(q), p.shape[1]), radius)
    return np.unpackbits(ok.view(np.uint8), axis=1, bitorder="little")[:, : len(rest)].astype(bool)


def _linked_large(fps: np.ndarray, rest: np.ndarray, radius: int, at_once: int = 64):
    """Links that span the components of one group.

    A component is searched from one member: what it reaches becomes a query against the rest, and
    is not compared with others that were reached.  Once a search finds a small component, the
    remaining members are compared in blocks of queries."""
    found = len(rest)
    while len(rest) > at_once and found >= at_once:
        frontier, rest, found = rest[:1], rest[1:], 1
        while len(frontier) and len(rest):
            q, frontier = frontier[:at_once], frontier[at_once:]
            hit = _hits(fps, q, rest, radius)
            reached = hit.any(0)
            yield q[hit.argmax(0)[reached]], rest[reached]
            frontier, rest = np.concatenate((frontier, rest[reached])), rest[~reached]
            found += int(reached.sum())
    while len(rest) > 1:
        a, b = np.nonzero(_hits(fps, rest[:at_once], rest, radius))
        a, b, rest = rest[a], rest[b], rest[at_once:]
        yield a[a < b], b[a < b]


def _spanning(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest position reachable from each of n."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def block_plan(n: int, block_radius: int = 4) -> int:
    """Blocks of a word for `n` fingerprints: the fewest that leave 32 random ones to a bucket at most, up to eight more than the radius."""
    blocks = block_radius + 2
    while blocks < block_radius + 8 and n >> 64 * (blocks - block_radius) // blocks > 32:
        blocks += 1
    return blocks


def links(nodes: DataFrame, radius: int = 4, words: int = 1, block_radius: int = 4, blocks: int | None = None, tile: int = TILE, all_within: bool = True) -> DataFrame:
    """Distinct (fp, id) -> links (a, b) between ids that span the components of each bucket.

    Of fingerprints that differ in at most `radius` of all bits, one of the words differs in at most
    radius / words; that must not exceed `block_radius`, the bits that the block keys allow for, unless
    pairs may be missed (not `all_within`)."""
    blocks = blocks or block_plan(nodes.count(), block_radius)
    if (all_within and radius // words > block_radius) or block_radius >= blocks:
        raise ValueError("block keys can miss pairs within the radius")
    named = [F.col("fp")[w] for w in range(words)]
    keyed = nodes.select("id", "fp", _keys(named, block_radius, blocks).alias("k")).select("id", "fp", "k.*")
    full = keyed.groupBy("c", "bits").agg(F.count("*").alias("n")).where("n > 1")
    split = F.ceil(F.col("n") / tile).cast("int")
    mine = F.pmod(F.xxhash64("fp"), F.col("s")).cast("int")
    met = keyed.join(full.select("c", "bits", split.alias("s")), ["c", "bits"])
    pairs = F.transform(F.sequence(F.lit(0), F.col("s") - 1), lambda t: F.struct(F.least(t, mine).alias("t"), F.greatest(t, mine).alias("u")))
    tiles = met.withColumn("p", F.explode(F.when(F.col("s") == 1, F.array(F.struct(F.lit(0).alias("t"), F.lit(0).alias("u")))).otherwise(pairs)))
    lists = [F.collect_list(F.struct("id", *[x.alias(f"w{w}") for w, x in enumerate(named)])).alias("members")]
    groups = tiles.groupBy("c", "bits", "p").agg(*lists)

    def run(batch: pa.RecordBatch):
        members = batch.column(0)
        sizes = np.diff(members.offsets.to_numpy())
        ends = np.cumsum(sizes)
        flat = members.flatten()
        all_ids = flat.field(0).to_numpy()
        all_fps = np.column_stack([flat.field(1 + w).to_numpy().view(np.uint64) for w in range(words)])
        done = 0
        while done < len(sizes):  # some groups at once
            lo = int(ends[done] - sizes[done])
            last = max(done + 1, int(np.searchsorted(ends, lo + AT_ONCE, "right")))
            hi = int(ends[last - 1])
            i, f = all_ids[lo:hi], all_fps[lo:hi]
            a, b = linked(f, np.repeat(np.arange(last - done), sizes[done:last]), radius)
            done = last
            if len(a):
                label = _spanning(a, b, len(f))
                at = np.flatnonzero(label != np.arange(len(f)))
                yield {"a": i[at], "b": i[label[at]]}

    return map_batches(groups.select("members"), run, "a bigint, b bigint")


def _numbered(nodes: DataFrame) -> tuple[DataFrame, int]:
    """(fp, id) -> the same with numbers above all ids where the id is null, and the first of these numbers.

    Numbers are dealt out in `SLOTS` slots by a hash, so no task ranks them all."""
    first = (nodes.agg(F.max("id")).first()[0] or 0) + 1
    slot = F.pmod(F.xxhash64("fp"), F.lit(SLOTS))
    rank = F.row_number().over(Window.partitionBy(slot).orderBy("fp")).cast("bigint") - 1
    unnamed = nodes.where("id is null").select("fp", (F.lit(first) + slot + rank * SLOTS).alias("id"))
    return cut(nodes.where("id is not null").union(unnamed), "nodes"), first


def near_duplicates(docs: DataFrame, shingle: int = 4, radius: int = 4, seeds: tuple[int, ...] = (SEED,), block_radius: int = 4, blocks: int | None = None) -> DataFrame:
    """-> doc_id, fp, component_id: the smallest id reachable over links of at most `radius` bits."""
    fps = cut(fingerprints(docs, shingle, seeds), "fingerprints")
    nodes, unnamed = _numbered(cut(fps.groupBy("fp").agg(F.min("doc_id").alias("id")), "fingerprints-once"))
    found = components(links(nodes, radius, len(seeds), block_radius, blocks))
    least = F.coalesce("component", "id")
    named = nodes.join(found, nodes["id"] == found["node"], "left").select(nodes["fp"].alias("_fp"), F.when(least < unnamed, least).alias("component_id"))
    return fps.join(named, fps["fp"] == named["_fp"], "left").select("doc_id", "fp", "component_id")


def _need(threshold: float, n: Column) -> Column:
    """The least whole number that is `threshold` of `n`."""
    return F.ceil(F.lit(threshold) * n - 1e-9)


def _distinct(text: bytes, shingle: int) -> np.ndarray:
    return np.unique(np.array(shingle_hashes(text.lower().split(), shingle), np.uint64))


def _digest(h: np.ndarray) -> tuple[int, bytes]:
    """A set's node number, and what tells sets apart."""
    full = xxhash.xxh3_128_digest(h.tobytes())
    return int.from_bytes(full[:8], "little", signed=True), full


def shingle_sets(docs: DataFrame, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """-> doc_id, h ARRAY<BIGINT>: the different shingles' hashes, in order."""

    def run(batch: pa.RecordBatch) -> dict[str, list]:
        return {"doc_id": batch.column(0), "h": [_distinct(t.as_py(), shingle).view(np.int64) for t in batch.column(1)]}

    return map_batches(docs.select(F.col(id_col).cast("bigint"), text_bytes(F.col(text_col)).alias("text")), run, "doc_id bigint, h array<bigint>")


def _identified(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id"), text_bytes(F.col("text")).alias("text"))


def _nodes(docs: DataFrame, shingle: int) -> DataFrame:
    """-> doc_id, fp, digest, node, n (different shingles), bits (a bitmap of them) of each document with an id; in rows of no
    id, `n` is a slice of a task's counts of shingles by hash, which are in `digest`."""
    names = ["doc_id", "fp", "digest", "node", "n", "bits"]
    kinds = [pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int64())]

    def run(batches) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(SKETCH, np.uint32)
        for batch in batches:
            fps, digests, nodes, sizes, bits, met = [], [], [], [], [], []
            for t in batch.column(1):
                hashes = shingle_hashes(t.as_py().lower().split(), shingle)
                own = np.unique(np.array(hashes, np.uint64))
                node, digest = _digest(own)
                fps.append(np.array([majority_bits(hashes)], np.uint64).view(np.int64))
                for x, v in zip((digests, nodes, sizes, bits, met), (digest, node, len(own), _bitmap(own), own), strict=True):
                    x.append(v)
            if met:
                at, n = np.unique((np.concatenate(met) % np.uint64(SKETCH)).astype(np.int64), return_counts=True)
                seen[at] += n.astype(np.uint32)
            yield pa.record_batch([batch.column(0), *(pa.array(c, k) for c, k in zip((fps, digests, nodes, sizes, bits), kinds[1:], strict=True))], names=names)
        cuts = range(0, SKETCH if seen.any() else 0, SLICE)
        none = [None] * len(cuts)
        cols = none, none, [pack(_narrow(seen[i : i + SLICE])) for i in cuts], none, [i // SLICE for i in cuts], none
        yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    return _identified(docs).mapInArrow(lean(run), "doc_id bigint, fp array<bigint>, digest binary, node bigint, n bigint, bits array<bigint>")


def _narrow(n: np.ndarray) -> np.ndarray:
    """The same numbers in as few bytes as they need."""
    return n.astype(np.min_scalar_type(int(n.max(initial=0))))


def _bitmap(own: np.ndarray) -> np.ndarray:
    """Parity of the hashes by their last bits, four to eight bits a hash, as words."""
    size = max(64, 1 << (4 * len(own) - 1).bit_length()) if len(own) else 64
    odd = np.bincount((own % np.uint64(size)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view("<i8")


def _counts(rows: DataFrame) -> np.ndarray:
    """How often shingles of each of `SKETCH` hashes stand in all documents: a table of fixed size."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for at, blobs in gathered(batches):
            total = np.zeros(SLICE, np.uint64)
            for (n,) in map(unpack, blobs):
                total += n
            yield pa.record_batch([pa.array([at], pa.int64()), pa.array([np.minimum(total, 2**32 - 1).astype(np.uint32).tobytes()], pa.binary())], names=["n", "total"])

    slices = rows.where("doc_id is null").select("n", "digest").repartition("n").sortWithinPartitions("n").mapInArrow(lean(run), "n bigint, total binary")
    out = np.zeros(SKETCH, np.uint32)
    for r in slices.collect():  # SKETCH / SLICE rows
        out[r["n"] * SLICE : (r["n"] + 1) * SLICE] = np.frombuffer(r["total"], np.uint32)
    return out


def _prefixes(docs: DataFrame, counts: np.ndarray, shingle: int, threshold: float, parts: int) -> DataFrame:
    """-> h, node, n, at: shingles that two documents have among the rarest of theirs, as many as one of
    similarity `threshold` cannot do without.

    What is rare is read off `counts`, the same for all; ties go by the hash.  Shingles travel packed by hash, one of each
    batch of documents; those met once in all of them end there."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(counts)

    def pieces(batch: pa.RecordBatch) -> dict[str, list]:
        known, hs, sizes = {}, [], []
        for t in batch.column(1):
            own = _distinct(t.as_py(), shingle)
            node, _ = _digest(own)
            if len(own) and node not in known:
                known[node] = len(own)
                first = np.lexsort((own, sent.value[(own % np.uint64(SKETCH)).astype(np.int64)]))
                hs.append(own[first[: len(own) - int(np.ceil(threshold * len(own) - 1e-9)) + 1]])
                sizes.append(len(hs[-1]))
        out: dict[str, list] = {"part": [], "piece": []}
        if not hs:
            return out
        h, doc = np.concatenate(hs), np.repeat(np.arange(len(hs)), sizes)
        at = np.arange(len(h)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        _, first, of, n = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
        # a shingle that the batch has twice is known to repeat; of each the first goes on to meet other batches
        part = np.where(first[of] == np.arange(len(h)), (h % np.uint64(parts)).astype(np.int64), -1)
        nodes, ns = np.array(list(known), np.int64), np.array(list(known.values()), np.int64)
        for key, i in parted(part):
            own, place = np.unique(doc[i], return_inverse=True)
            out["part"].append(key)
            out["piece"].append(pack(nodes[own], ns[own], place.astype(np.uint32), h[i], at[i].astype(np.uint32), n[of[i]] > 1))
        return out

    def rows_of(blobs: list[bytes]) -> tuple[np.ndarray, ...]:
        got = [unpack(b) for b in blobs]
        return tuple(np.concatenate(c) for c in zip(*((h, nodes[p], ns[p], at, twice) for nodes, ns, p, h, at, twice in got), strict=True))

    def batch_of(h, node, n, at) -> pa.RecordBatch:
        return pa.record_batch([pa.array(h.view(np.int64)), pa.array(node), pa.array(n), pa.array(at.astype(np.int32))], names=["h", "node", "n", "at"])

    def met(batches) -> Iterator[pa.RecordBatch]:
        for part, blobs in gathered(batches):
            if part < 0:
                for blob in blobs:
                    yield batch_of(*rows_of([blob])[:4])
                continue
            h, node, n, at, twice = rows_of(blobs)
            _, of, count = np.unique(h, return_inverse=True, return_counts=True)
            i = (count[of] > 1) | twice
            yield batch_of(h[i], node[i], n[i], at[i])

    schema = "h bigint, node bigint, n bigint, at int"
    dealt = cut(map_batches(_identified(docs), pieces, "part bigint, piece binary"), "prefixes")
    direct = dealt.where("part < 0").mapInArrow(lean(met), schema)
    return dealt.where("part >= 0").repartition("part").sortWithinPartitions("part").mapInArrow(lean(met), schema).union(direct).distinct()


def _in_index(threshold: float, n: Column, at: Column) -> Column:
    """Of two similar sets, the smaller one has a shared shingle in this shorter prefix."""
    return at <= n - _need(2 * threshold / (1 + threshold), n)


def _can_reach(threshold: float) -> Column:
    """Length and positional filter of sets (n_a, at_a) and (n_b, at_b) that share the shingles at these places."""
    least, most = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
    left = F.lit(1) + F.least(F.col("n_a") - F.col("at_a") - 1, F.col("n_b") - F.col("at_b") - 1)
    return (least >= _need(threshold, most)) & (left >= _need(threshold / (1 + threshold), F.col("n_a") + F.col("n_b")))


def _parts_can_reach(threshold: float, left: Column, lo: Column, hi: Column) -> Column:
    """The same filters for the best that sets of two parts can be: at most `left` and `left_q` shingles from the shared one on,
    sizes `lo` to `hi` and `lo_q` to `hi_q`, the first part's set not the larger one."""
    sizes = (hi >= _need(threshold, F.col("lo_q"))) & (lo <= F.col("hi_q"))
    return sizes & (F.least(left, F.col("left_q")) >= _need(threshold / (1 + threshold), lo + F.col("lo_q")))


def _folded(bits: Column) -> Column:
    """A bitmap at half its size."""
    half = (F.size(bits) / 2).cast("int")
    return F.transform(F.sequence(F.lit(1), half), lambda i: F.element_at(bits, i).bitwiseXOR(F.element_at(bits, i + half)))


def _likely(pairs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) but for those whose bitmaps differ in more bits than similar sets can.

    Similar sets are of like size, so their bitmaps are equally long or one is twice the other."""
    pairs = pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    for x in "ab":
        pairs = pairs.join(nodes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}")), x)
    pairs = pairs.where(F.least("n_a", "n_b") >= _need(threshold, F.greatest("n_a", "n_b")))
    a, b = F.col("bits_a"), F.col("bits_b")
    a, b = F.when(F.size(a) > F.size(b), _folded(a)).otherwise(a), F.when(F.size(b) > F.size(a), _folded(b)).otherwise(b)
    differ = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    both = F.col("n_a") + F.col("n_b")
    return pairs.where(both - differ >= 2 * _need(threshold / (1 + threshold), both)).select("a", "b")


def _verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, shingle: int, threshold: float) -> DataFrame:
    """The pairs (a, b) of nodes whose shingle sets have a similarity (Jaccard) of `threshold` or more."""
    pairs = cut(_likely(pairs, nodes, threshold), "pairs")
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    asked = cut(nodes.join(ends, "node", "left_semi").select("node", F.col("id").alias("doc_id")), "asked")  # written, so that its size is known
    texts = _identified(docs).join(asked.select("doc_id").distinct(), "doc_id", "left_semi")
    sets = cut(shingle_sets(texts, shingle).join(asked, "doc_id").select("node", "h"), "sets")
    met = pairs.join(sets.select(F.col("node").alias("a"), F.col("h").alias("_a")), "a").join(sets.select(F.col("node").alias("b"), F.col("h").alias("_b")), "b")
    both = F.size(F.array_intersect("_a", "_b"))
    return met.where(both >= F.lit(threshold) * (F.size("_a") + F.size("_b") - both) - 1e-9).select("a", "b")


def similar(docs: DataFrame, shingle: int = 5, radius: int = WIDE, threshold: float = THRESHOLD) -> DataFrame:
    """-> doc_id, component_id: the smallest id reachable over pairs of similarity `threshold` or more.

    Fingerprints' links and, for each shingle of the prefixes, the pairs with one set are verified first.
    Of the pairs that share a prefix shingle, which are all that can be similar, only those that are
    not in one component by then are verified after that: a large group of copies never gives all of its pairs."""
    rows = cut(_nodes(docs, shingle), "fingerprints")
    counts = _counts(rows)
    rows = rows.where("doc_id is not null")
    nodes = cut(rows.groupBy("digest").agg(F.min("doc_id").alias("id"), F.first("node").alias("node"), F.first("n").alias("n"), F.min("fp").alias("fp"), F.first("bits").alias("bits")), "nodes")
    size = nodes.agg(F.sum("n")).first()[0] or 0
    prefixes = _prefixes(docs, counts, shingle, threshold, int(size * (1 - threshold)) // PART_ROWS + 1)
    # shingles of two sets, in one of them where the smaller of a pair has it
    # a head has the fewest shingles that are rarer: of copies with edits, the one with the fewest edits, which most of them are similar to
    prefixes = cut(prefixes.withColumn("index", _in_index(threshold, F.col("n"), F.col("at"))), "repeated")
    many = prefixes.groupBy("h").agg(F.count("*").alias("_n"), F.max("index").alias("_i"), F.min_by(F.struct("node", "n", "at"), F.struct("at", F.xxhash64("node"))).alias("head")).where("_n > 1 AND _i")
    heads = many.select("h", F.col("head.node").alias("b"), F.col("head.n").alias("n_b"), F.col("head.at").alias("at_b"))
    stars = prefixes.withColumnsRenamed({"node": "a", "n": "n_a", "at": "at_a"}).join(heads, "h").where(_can_reach(threshold)).select("a", "b")
    one = cut(nodes.groupBy("fp").agg(F.min("node").alias("id")), "fingerprints")
    same = nodes.select("fp", F.col("node").alias("a")).join(one.select("fp", F.col("id").alias("b")), "fp").select("a", "b")
    twins = rows.groupBy("doc_id").agg(F.min("node").alias("b"), F.max("node").alias("_b")).where("b < _b")
    twins = rows.join(twins, "doc_id").select(F.col("node").alias("a"), "b")  # texts of one id go together
    near = links(one, radius, all_within=False).union(same).union(stars)
    found = components(_verified(near, docs, nodes, shingle, threshold).union(twins))
    named = cut(nodes.join(found, "node", "left").select("node", "digest", "id", F.coalesce("component", "node").alias("part")), "parts")
    shared = cut(prefixes.join(many.select("h"), "h", "left_semi"), "shared")
    # another set of each shingle against those of other parts, which leaves few parts of a group of copies
    held = shared.join(named.select("node", "part"), "node")
    heads = held.groupBy("h").agg(F.min("part").alias("_p"), F.max("part").alias("_q"), F.min_by(F.struct("node", "n", "at", "part"), F.xxhash64("node", F.lit(2))).alias("head")).where("_p < _q")
    heads = heads.select("h", F.col("head.node").alias("b"), F.col("head.n").alias("n_b"), F.col("head.at").alias("at_b"), F.col("head.part").alias("q"))
    stars = held.withColumnsRenamed({"node": "a", "n": "n_a", "at": "at_a"}).join(heads, "h").where((F.col("part") != F.col("q")) & _can_reach(threshold))
    named = _regrouped(named, _verified(stars.select("a", "b"), docs, nodes, shingle, threshold))
    # then all pairs of different parts: parts of a shingle first, then their sets; of a pair the smaller set by its index
    held = cut(shared.join(named.select("node", "part"), "node"), "held")
    mixed = held.groupBy("h").agg(F.min("part").alias("_p"), F.max("part").alias("_q")).where("_p < _q").select("h")
    held = held.join(mixed, "h", "left_semi")
    left = held.where("index").select("h", F.col("part").alias("p"), F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("at").alias("at_a"))
    right = held.select("h", F.col("part").alias("q"), F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("at").alias("at_b"))
    sides = [x.groupBy("h", p).agg(F.max(F.col(f"n_{a}") - F.col(f"at_{a}")).alias(f"left_{p}"), F.min(f"n_{a}").alias(f"lo_{p}"), F.max(f"n_{a}").alias(f"hi_{p}")) for x, p, a in ((left, "p", "a"), (right, "q", "b"))]
    some = _parts_can_reach(threshold, F.col("left_p"), F.col("lo_p"), F.col("hi_p"))
    across = sides[0].join(sides[1], "h").where((F.col("p") != F.col("q")) & some).select("h", "p", "q", "left_q", "lo_q", "hi_q")
    one = _parts_can_reach(threshold, F.col("n_a") - F.col("at_a"), F.col("n_a"), F.col("n_a"))
    smaller = (F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("a") < F.col("b")))
    rest = across.join(left, ["h", "p"]).where(one).join(right, ["h", "q"]).where(smaller & _can_reach(threshold)).select("a", "b")
    named = _regrouped(named, _verified(rest, docs, nodes, shingle, threshold))
    least = named.join(named.groupBy("part").agg(F.min("id").alias("component_id")), "part").select("digest", "component_id")
    return rows.select("doc_id", "digest").join(least, "digest").select("doc_id", "component_id")


def _regrouped(named: DataFrame, pairs: DataFrame) -> DataFrame:
    """`named` with the parts joined that pairs of their nodes link."""
    a, b = (named.select(F.col("node").alias(x), F.col("part").alias(f"_{x}")) for x in "ab")
    joined = components(pairs.join(a, "a").join(b, "b").select(F.col("_a").alias("a"), F.col("_b").alias("b")))
    met = named.join(joined, named["part"] == joined["node"], "left")
    return cut(met.select(named["node"], "digest", "id", F.coalesce("component", "part").alias("part")), "parts")


def keep_first(docs: DataFrame, shingle: int = 5, radius: int = WIDE, threshold: float = THRESHOLD) -> DataFrame:
    """`docs` without the documents that are joined to one of a smaller id by pairs of shingle sets of
    similarity `threshold` or more; of rows that share the id, one stays.  Rows of a null id stay.

    Every such pair counts, whatever the fingerprints say (`similar`)."""
    # written, so that its size is known
    gone = passing(docs.sparkSession, lambda: similar(docs, shingle, radius, threshold).where("doc_id <> component_id").select("doc_id").distinct(), "gone")
    kept = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    if docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        return kept
    (twin,) = unused(docs.columns, "twin")
    some = kept.where("doc_id is not null")
    some = some.withColumn(twin, F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text")))).where(F.col(twin) == 1).select(*docs.columns)
    return some.unionByName(kept.where("doc_id is null"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and component."""
    return near_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id", F.lpad(F.lower(F.hex(F.col("fp")[0])), 16, "0").alias("fingerprint"), "component_id"
    )
