"""Benchmark decontamination: item-sized windows, their SimHash, a multi-index, and exact verification.

An item of n words is held against every window of n words of a document.  A window that shares too few
5-word shingles with the whole benchmark cannot be similar to any item (a window of similarity
`threshold` has at least t / (1 + t) of the two's shingles from the item), and is skipped, which loses nothing.
Every other window gets the SimHash of its weighted shingles, `BITS` bits, from running sums of their bits.
Multi-index Hamming blocks name the items whose fingerprint is within `radius`, all of them: of `BLOCKS` blocks one
differs in at most radius / BLOCKS bits, and each block's table lists an item under all values that near.  A block
is so long that these are few: about one random item in fifteen is looked at.  What is within the radius is verified
exactly: weighted Jaccard similarity, sum of minima over sum of maxima of shingle counts.

At similarity 0.8 two fingerprints differ in 15 % of their bits on average, 78 of 512 with a standard deviation of 8; so `RADIUS`
finds all but about 1.4 % of the windows that are just that similar, and all of 0.83 or more but for one in a thousand.

A document of fewer words than the item is one window.  Its few shingles against one or two more of the item can tie
in many bits, so there the items that share enough shingles are verified at once.

The items are a benchmark: their number and words are checked against `MAX_WORDS` before they are
sent to the tasks; a larger benchmark is taken in several parts, each a pass of its own.

Words: A-Z lower-cased, maximal runs without ASCII white space.  Items under five words are one
shingle, their whole word sequence.

Defined results: null or blank items and texts match nothing; a very long text is searched whole, `AT_ONCE` windows at a time; of
windows of an item that tie the first is given; a null doc_id or item_id is carried;
repeated rows are reported each; equal items are reported each; an empty table on either side
gives an empty result; extra columns are ignored by `leaks` and carried by `without_leaks`.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eodlake.llm.common import cut, lean, table, text_bytes, unused
from eodlake.llm.simhash import SEED

SHINGLE, THRESHOLD, RADIUS, BITS, BLOCKS, MAX_WORDS, AT_ONCE = 5, 0.8, 95, 512, 32, 100_000, 4096


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()


def shingles_of(words: list[bytes], n: int = SHINGLE) -> list[bytes]:
    if len(words) <= n:
        return [b" ".join(words)] if words else []
    return [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]


def signs(shingles: list[bytes]) -> np.ndarray:
    """A row of BITS numbers 1 or -1 per shingle: the bits of its hash, mixed anew for each 64 of them."""
    h = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64, len(shingles))[:, None]
    x = h + np.arange(1, BITS // 64 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return 2 * np.unpackbits(np.ascontiguousarray(x, "<u8").view(np.uint8), axis=1, bitorder="little").astype(np.int8) - 1


def weighted_simhash(counts: Counter) -> np.ndarray:
    """BITS bits as numbers of 64; a bit is 1 if the shingles with it weigh more than those without."""
    total = (signs(list(counts)).astype(np.int64) * np.fromiter(counts.values(), np.int64, len(counts))[:, None]).sum(0)
    return np.packbits(total > 0, bitorder="little").view("<u8")


def similarity(a: Counter, b: Counter) -> float:
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both) if a or b else 0.0


class MultiIndex:
    """Fingerprints by the values of their blocks; `near` gives all within the radius, and only these."""

    def __init__(self, fps: np.ndarray, radius: int = RADIUS, blocks: int = BLOCKS) -> None:
        self.fps, self.radius = fps.reshape(-1, BITS // 64), radius
        self.width = BITS // blocks
        if self.width not in (8, 16):
            raise ValueError("blocks have 8 or 16 bits")
        own = self._values(self.fps)
        flips = np.array([sum(1 << i for i in c) for d in range(radius // blocks + 1) for c in combinations(range(self.width), d)], own.dtype)
        self.tables = []  # per block: where each value's items begin, and the items
        for b in range(blocks):
            values = (own[:, b, None] ^ flips).ravel()
            order = np.argsort(values, kind="stable")
            begin = np.searchsorted(values[order], np.arange((1 << self.width) + 1))
            self.tables.append((begin.astype(np.int32), (order // len(flips)).astype(np.int32)))

    def _values(self, fps: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(fps, "<u8").view(f"<u{self.width // 8}").reshape(len(fps), -1)

    def named(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, item) pairs that agree in some block but for a few bits."""
        values, n = self._values(fps), max(len(self.fps), 1)
        pairs = []
        for b, (begin, items) in enumerate(self.tables):
            first, size = begin[values[:, b]], begin[values[:, b].astype(np.int64) + 1] - begin[values[:, b]]
            query = np.repeat(np.arange(len(fps)), size)
            at = np.arange(len(query)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first, size)
            pairs.append(query * n + items[at])
        pairs = np.unique(np.concatenate(pairs))
        return pairs // n, pairs % n

    def near(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        query, item = self.named(fps)
        ok = np.bitwise_count(fps[query] ^ self.fps[item]).sum(1) <= self.radius
        return query[ok], item[ok]


class Benchmark:
    """Items as (item_id, text), prepared for the search."""

    def __init__(self, items: Iterable[tuple[int | None, bytes]], threshold: float = THRESHOLD, radius: int = RADIUS) -> None:
        self.threshold, self.ids, self.counts = threshold, [], []
        self.vocabulary: set[bytes] = set()
        self.holders: dict[bytes, list[int]] = {}  # shingle -> items
        sizes, fps = [], [np.empty((0, BITS // 64), np.uint64)]
        for item_id, text in items:
            words = words_of(text)
            if not words:
                continue
            counts = Counter(shingles_of(words))
            self.vocabulary.update(words)
            for s in counts:
                self.holders.setdefault(s, []).append(len(self.ids))
            self.ids.append(item_id)
            sizes.append(len(words))
            self.counts.append(counts)
            fps.append(weighted_simhash(counts)[None])
        self.sizes = np.array(sizes, np.int64)
        self.index = MultiIndex(np.concatenate(fps), radius)
        self.lengths = {n: [] for n in sorted({min(n, SHINGLE) for n in sizes})}  # shingles of items under five words are as long as these
        for n in sorted(set(sizes)):
            self.lengths[min(n, SHINGLE)].append(n)

    def _need(self, n: int, m: int) -> int:
        return int(np.ceil(self.threshold / (1 + self.threshold) * (n + m) - 1e-9))

    def _windows(self, words: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
        """First words and sizes of the windows that have enough shingles of the benchmark."""
        known = np.fromiter((w in self.vocabulary for w in words), np.int32, len(words))
        places = max(len(words) - length + 1, 0)
        hit = np.zeros(places + 1, np.int64)
        if places:
            for p in np.flatnonzero(np.convolve(known, np.ones(length, np.int32), "valid") == length).tolist():
                hit[p + 1] = b" ".join(words[p : p + length]) in self.holders
        upto = np.cumsum(hit)
        first, size = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for n in self.lengths[length] if upto[-1] else ():
            m = n - length + 1
            if n <= len(words):
                s = np.flatnonzero(upto[m:] - upto[:-m] >= self._need(m, m))
                first.append(s)
                size.append(np.full(len(s), n))
        first, size = np.concatenate(first), np.concatenate(size)
        by = np.lexsort((size, first))
        return first[by], size[by]

    def _near(self, words: list[bytes], length: int) -> Iterator[tuple[int, int]]:
        """(item, first word): windows whose fingerprint is near that of an item of their size."""
        first, size = self._windows(words, length)
        for at in range(0, len(first), AT_ONCE):
            s, n = first[at : at + AT_ONCE], size[at : at + AT_ONCE]
            lo, hi = int(s[0]), int((s + n).max()) - length + 1
            upto = np.zeros((hi - lo + 1, BITS), np.int32)
            np.cumsum(signs([b" ".join(words[p : p + length]) for p in range(lo, hi)]), axis=0, out=upto[1:])
            fps = np.packbits(upto[s + n - length + 1 - lo] > upto[s - lo], axis=1, bitorder="little").view("<u8")
            query, item = self.index.near(fps)
            ok = self.sizes[item] == n[query]
            yield from zip(item[ok].tolist(), s[query[ok]].tolist(), strict=True)

    def _of_short(self, words: list[bytes]) -> Iterator[tuple[int, int]]:
        """Items longer than the document that share enough of its shingles."""
        if not len(self.sizes) or len(words) >= self.sizes.max():
            return
        own = Counter(shingles_of(words))
        both: Counter = Counter()
        for s, n in own.items():
            for item in self.holders.get(s, ()):
                both[item] += min(n, self.counts[item][s])
        for item, n in both.items():
            if self.sizes[item] > len(words) and n >= self._need(own.total(), self.counts[item].total()):
                yield item, 0

    def search(self, text: bytes) -> list[tuple[int, int, float]]:
        """(item number, first word, similarity): the best window per item that meets the threshold."""
        words = words_of(text)
        best: dict[int, tuple[float, int]] = {}
        found = [pair for length in self.lengths for pair in self._near(words, length)] if words else []
        for item, p in [*found, *self._of_short(words)] if words else ():
            sim = similarity(Counter(shingles_of(words[p : p + int(self.sizes[item])])), self.counts[item])
            if sim >= self.threshold and (sim, -p) > (lambda b: (b[0], -b[1]))(best.get(item, (0.0, 0))):
                best[item] = sim, p
        return [(item, p, sim) for item, (sim, p) in best.items()]


def _parts(benchmark: DataFrame, max_words: int) -> Iterator[list[tuple[int | None, bytes]]]:
    """The benchmark's items in parts of at most `max_words` words (one item at least)."""
    part, size = [], 0
    for row in benchmark.select("item_id", "text").where("text is not null").toLocalIterator():
        n = len(row["text"].split())
        if part and size + n > max_words:
            yield part
            part, size = [], 0
        part.append((row["item_id"], row["text"].encode()))
        size += n
    if part:
        yield part


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, radius: int = RADIUS, max_words: int = MAX_WORDS) -> DataFrame:
    """-> doc_id, item_id, first_word, n_words, similarity: documents that hold an item."""
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_bytes(F.col("text")).alias("text"))
    schema = "doc_id bigint, item_id bigint, first_word bigint, n_words bigint, similarity double"
    out = None
    for items in _parts(benchmark, max_words):
        sent = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches, sent=sent) -> Iterator[pa.RecordBatch]:
            known = Benchmark(sent.value, threshold, radius)
            for batch in batches:
                rows = [
                    (d, known.ids[item], p, min(int(known.sizes[item]), len(words_of(t.as_py()))), sim)
                    for d, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True)
                    for item, p, sim in known.search(t.as_py())
                ]
                cols = list(zip(*rows, strict=True)) or [()] * 5
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
                yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "item_id", "first_word", "n_words", "similarity"])

        found = source.mapInArrow(lean(run), schema)
        out = found if out is None else out.union(found)
    return out or source.where("false").selectExpr(*[f"CAST(NULL AS {kind}) AS {name}" for name, kind in (c.split() for c in schema.split(", "))])


def without_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, radius: int = RADIUS) -> DataFrame:
    """`docs` without the documents that hold an item.  Rows of a null id are judged by a join too,
    on a hash of their text."""
    (key,) = unused([*docs.columns, "doc_id"], "key")
    own = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.col("doc_id").cast("bigint"))
    found = leaks(docs.select(own.alias("doc_id"), "text"), benchmark, threshold, radius)
    found = cut(found.select(F.col("doc_id").alias(key)).distinct(), "leaks")  # written, so that its size is known
    return docs.withColumn(key, own).join(found, key, "left_anti").select(*docs.columns)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document that holds an item of `benchmark`, with the best window per item."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
