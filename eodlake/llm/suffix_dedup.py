"""Exact removal of repeated byte strings, by sorting suffixes deep-shallow.

A byte goes if a string of `length` bytes that covers it also starts earlier (smaller document
id, or the same document further left).  Only the start matters of each such string, its window.

1. Each window is assigned to the smallest hash of the k-byte strings in it.  Neighbouring windows
   mostly share it, so a document falls into runs of about forty windows, and equal windows anywhere
   belong to runs of the same hash.  What is shuffled by hash is packed: five bytes of hash, a place and a
   length per run.  Runs whose hash is met once end there.
2. The others, with their bytes, come together by hash.  Hashes only group: the bytes decide.
   Runs of one length are ordered by a multikey quicksort to the shallow depth of `SHALLOW` bytes; those still tied go to a blind trie, which
   branches on the bytes that tell its members apart, compares a newcomer with one leaf only, and is read in order.
   A run that is equal to the one before it in that order is covered as a whole.
3. The windows of the runs that are left in a group (such as at the edges of a shared passage) are ordered in the
   same way, quicksort first and blind tries below it.
4. Covered windows come back per document, and the texts, compressed for the shuffle, meet them once.

Of equal runs in one batch of documents (compared byte by byte) only the first travels.  A hash with more than `SPLIT` runs is dealt to
several groups by a salt; runs that are equal to one in their group end there, and the windows of the others are
ordered by their whole strings in a Spark aggregate, so no task holds more than its share of a hash.

Defined results: a null text is empty; texts under `length` bytes keep everything; a very long text is taken in overlapping segments
of `SEGMENT` bytes; equal strings that start at once in rows of one place (a row repeated whole) do not cover each other; a null id sorts
after all others; rows that share the id are ordered by a hash of their text, and rows repeated
whole count as one document, reported each; an empty table gives an empty result; extra columns
are ignored by `repeats` and carried by `without_repeats`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eodlake.llm.common import cut, gathered, lean, map_batches, pack, parted, table, text_bytes, unpack, unused

LENGTH, K, SHALLOW, SPLIT, SEGMENT = 100, 24, 16, 4096, 1 << 18
#: Runs whose hashes, and bytes of runs, that one task holds at once.
PART_RUNS, PART_BYTES = 1 << 18, 8 << 20
LAST = (1 << 63) - 1
#: Bits of the hash that travel; the bits above them choose the part.
BITS = 40
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BYTES = np.random.default_rng(7).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_BASE), n, 1 << 64))


class _Rolling:
    """Hashes of all n-byte strings of `x`, put together from those of half the length."""

    def __init__(self, x: np.ndarray) -> None:
        self.at = {1: _BYTES[x]}

    def of(self, n: int) -> np.ndarray:
        if n not in self.at:
            a = 1 << ((n - 1).bit_length() - 1)  # the largest power of two below n
            left, right = self.of(a), self.of(n - a)
            m = len(self.at[1]) - n + 1
            self.at[n] = left[:m] * _power(n - a) + right[a : a + m]
        return self.at[n]


def _sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    n, out = 1, v
    while 2 * n <= w:
        out = np.minimum(out[:-n], out[n:])
        n *= 2
    return np.minimum(out[: len(v) - w + 1], out[w - n : w - n + len(v) - w + 1]) if n < w else out


def runs(x: np.ndarray, ends: np.ndarray, length: int = LENGTH, k: int = K) -> tuple[np.ndarray, ...]:
    """Runs of the texts that stand one after another in `x`, with these ends.

    -> first window's position, text number, windows (at most length - k + 1), hash of the run's
    k-byte string, hash of the run's bytes, whether windows inside it can be equal."""
    w = length - k + 1
    starts = np.concatenate(([0], ends[:-1]))
    n_win = np.maximum(ends - starts - length + 1, 0)
    total = int(n_win.sum())
    none = np.empty(0, np.int64)
    if not total:
        return none, none, none, none.astype(np.uint64), none, none.astype(bool)
    roll = _Rolling(x)
    order, whole = _mix(roll.of(k)), roll.of(length)
    del roll
    low = _sliding_min(order, w)
    text = np.repeat(np.arange(len(ends)), n_win)
    at = np.arange(total) - np.repeat(np.cumsum(n_win) - n_win, n_win) + starts[text]
    low_at = low[at]
    same = (text[1:] == text[:-1]) & (low_at[1:] == low_at[:-1])
    first = np.concatenate(([0], np.flatnonzero(~same) + 1))
    size = np.diff(np.concatenate((first, [total])))
    # equal windows of one run need its k-byte string at the start of a window that is not the last
    again = np.zeros(total, np.int8)
    again[:-1] = same & (order[at[:-1]] == low_at[:-1])
    again = np.add.reduceat(again, first) > 0
    pieces = -(-size // w)
    run = np.repeat(np.arange(len(first)), pieces)
    skip = (np.arange(len(run)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * w
    i = first[run] + skip
    n = np.minimum(size[run] - skip, w)
    p, q = at[i], at[i + n - 1]
    content = _mix(whole[p] + _mix(whole[q] ^ (n.astype(np.uint64) << np.uint64(48))))
    return p, text[i], n, low_at[i], content, again[run]


def _segments(texts: list[bytes], length: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Texts as (number, offset, bytes), together up to about SEGMENT bytes; longer texts are split
    so that each window is in one part."""
    some, size = [], 0
    for i, t in enumerate(texts):
        for at in range(0, max(len(t) - length + 1, 0), SEGMENT):
            part = t[at : at + SEGMENT + length - 1]
            some.append((i, at, part))
            size += len(part)
            if size >= SEGMENT:
                yield some
                some, size = [], 0
    if some:
        yield some


def _keyed(docs: DataFrame) -> DataFrame:
    """d: the id, nulls last; tk: tells apart rows that share it."""
    return docs.select(
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST)).alias("d"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("tk"), text_bytes(F.col("text")).alias("text")
    )


def _zipped(docs: DataFrame) -> DataFrame:
    """-> d, tk, z: texts compressed one by one, so that they shuffle at under half their size."""
    import zstandard

    def run(batch: pa.RecordBatch) -> dict[str, list]:
        z = zstandard.ZstdCompressor(level=3)
        return {"d": batch.column(0), "tk": batch.column(1), "z": [z.compress(t.as_py()) for t in batch.column(2)]}

    return map_batches(_keyed(docs), run, "d bigint, tk bigint, z binary")


def _unzip(z: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(z)


def _late(texts: list[bytes], number: np.ndarray, rank: np.ndarray, start: np.ndarray, n: np.ndarray, kh: np.ndarray, content: np.ndarray, length: int) -> np.ndarray:
    """Which runs of a batch are equal to an earlier one of another place in it."""
    by = np.lexsort((start, rank, content, kh))
    new = np.concatenate(([True], (kh[by][1:] != kh[by][:-1]) | (content[by][1:] != content[by][:-1])))
    head = by[np.flatnonzero(new)[np.cumsum(new) - 1]]
    late = np.zeros(len(by), bool)
    i, h = by[~new], head[~new]
    other = (rank[i] != rank[h]) | (start[i] != start[h])
    for a, b in zip(i[other].tolist(), h[other].tolist(), strict=True):
        p, q, m = start[a], start[b], n[a] + length - 1
        late[a] = n[a] == n[b] and texts[number[a]][p : p + m] == texts[number[b]][q : q + m]
    return late


def run_pieces(docs: DataFrame, length: int, parts: int) -> DataFrame:
    """-> part, piece: the runs of a batch of documents by the upper bits of their hashes; those that
    are covered by a run of the same batch are in the piece of part -1."""

    def run(batch: pa.RecordBatch) -> dict[str, list]:
        ids, tks, texts = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_pylist()
        found: list[tuple[np.ndarray, ...]] = []
        for some in _segments(texts, length):
            x = np.frombuffer(b"".join(t for _, _, t in some), np.uint8)
            ends = np.cumsum([len(t) for _, _, t in some])
            p, part, n, kh, content, again = runs(x, ends, length)
            begin = np.concatenate(([0], ends[:-1]))
            number, offset = (np.array([s[c] for s in some]) for c in (0, 1))
            found.append((number[part], p - begin[part] + offset[part], n, kh, content, again))
        out: dict[str, list] = {"part": [], "piece": []}
        if not found:
            return out
        number, start, n, kh, content, again = (np.concatenate(c) for c in zip(*found, strict=True))
        by = np.lexsort((tks, ids))
        rank = np.empty(len(by), np.int64)
        rank[by] = np.cumsum(np.concatenate(([0], (np.diff(ids[by]) != 0) | (np.diff(tks[by]) != 0))))
        late = _late(texts, number, rank[number], start, n, kh, content, length)
        part = np.where(late, -1, ((kh >> np.uint64(BITS)) % np.uint64(parts)).astype(np.int64))
        low = (kh & np.uint64((1 << BITS) - 1)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, : BITS // 8]
        for key, at in parted(part):
            own, doc = np.unique(number[at], return_inverse=True)
            out["part"].append(key)
            out["piece"].append(pack(ids[own], tks[own], doc.astype(np.uint32), start[at].astype(np.uint32), n[at].astype(np.uint16), again[at], low[at] if key >= 0 else None))
        return out

    return map_batches(_keyed(docs), run, "part int, piece binary")


def _rows_of(pieces: list[bytes]) -> tuple[np.ndarray, ...]:
    """d, tk, start, n, again, low bits of the hash."""
    cols = []
    for piece in pieces:
        ids, tks, doc, start, n, again, low = unpack(piece)
        wide = np.zeros((len(doc), 8), np.uint8)
        if low is not None:
            wide[:, : BITS // 8] = low
        cols.append((ids[doc], tks[doc], start.astype(np.int64), n.astype(np.int64), again, wide.view("<u8").ravel().astype(np.int64)))
    return tuple(np.concatenate(c) for c in zip(*cols, strict=True))


def repeated_runs(pieces: DataFrame) -> DataFrame:
    """-> d, tk, start, n, g, again, salts: runs whose hash is met twice, or whose own windows can be
    equal; `g` is the hash's group, dealt to `salts` groups where it is large."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, blobs in gathered(batches):
            d, tk, start, n, again, low = _rows_of(blobs)
            _, of, count = np.unique(low, return_inverse=True, return_counts=True)
            c = count[of]
            at = np.flatnonzero((c > 1) | again)
            cols = (d[at], tk[at], start[at].astype(np.int32), n[at].astype(np.int32), np.int64(part << BITS) | low[at], again[at], (-(-c[at] // SPLIT)).astype(np.int32))
            yield pa.record_batch([pa.array(c) for c in cols], names=["d", "tk", "start", "n", "g", "again", "salts"])

    dealt = pieces.where("part >= 0").repartition("part").sortWithinPartitions("part")
    return dealt.mapInArrow(lean(run), "d bigint, tk bigint, start int, n int, g bigint, again boolean, salts int")


def _settled(pieces: DataFrame) -> DataFrame:
    """-> d, tk, start, n of the runs covered by one of their own batch."""

    def run(batch: pa.RecordBatch) -> Iterator[dict[str, np.ndarray]]:
        for piece in batch.column(0).to_pylist():
            d, tk, start, n, *_ = _rows_of([piece])
            yield {"d": d, "tk": tk, "start": start.astype(np.int32), "n": n.astype(np.int32)}

    return map_batches(pieces.where("part = -1").select("piece"), run, "d bigint, tk bigint, start int, n int")


def run_bytes(docs: DataFrame, asked: DataFrame, length: int, parts: int) -> DataFrame:
    """-> part, piece: the asked runs with their bytes, by group."""
    lists = asked.groupBy("d", "tk").agg(F.collect_list(F.struct("start", "n", "g", "again", "salts")).alias("asked"))

    def run(batch: pa.RecordBatch) -> Iterator[dict[str, list]]:
        rows: list[tuple] = []
        bodies: list[bytes] = []
        size = 0
        for d, tk, z, own in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            text = _unzip(z)
            for a in own:
                s, n = a["start"], a["n"]
                salt = hash((d, tk, s)) % a["salts"]
                rows.append((d, tk, s, n, a["g"], a["again"], salt, a["salts"] > 1))
                bodies.append(text[s : s + n + length - 1])
                size += n + length
            if size > PART_BYTES // 2:
                yield dealt(rows, bodies)
                rows, bodies, size = [], [], 0
        if rows:
            yield dealt(rows, bodies)

    def dealt(rows: list[tuple], bodies: list[bytes]) -> dict[str, list]:
        cols = [np.array(c) for c in zip(*rows, strict=True)]
        g, salt = cols[4].astype(np.uint64), cols[6].astype(np.uint64)
        out: dict[str, list] = {"part": [], "piece": []}
        for part, at in parted((_mix(g ^ _mix(salt + np.uint64(1))) % np.uint64(parts)).astype(np.int64)):
            out["part"].append(part)
            out["piece"].append(pack(*[c[at] for c in cols], b"".join(bodies[i] for i in at.tolist())))
        return out

    return map_batches(_zipped(docs).join(lists, ["d", "tk"]).select("d", "tk", "z", "asked"), run, "part int, piece binary")


def _trie_order(buf: bytes, places: list[int], length: int, skip: int) -> list[list[int]]:
    """Numbers of the places in the order of their `length` bytes, equal ones together and ascending; all agree on the first `skip`.

    A blind trie: a leaf is a place, an inner node [depth, {byte: child}, a leaf below].  A newcomer goes down by the bytes that the nodes
    branch on, is compared with the one leaf that it comes to, and is put in where it first differs.  The leaves, read by their bytes, are the order."""
    root, equal = places[0], {places[0]: [0]}
    for number, p in enumerate(places[1:], 1):
        node = root
        while type(node) is list:
            child = node[1].get(buf[p + node[0]])
            node = node[2] if child is None else child
        if buf[p : p + length] == buf[node : node + length]:
            equal[node].append(number)
            continue
        equal[p] = [number]
        lo, hi = skip, length - 1  # the first byte that differs is in [lo, hi]
        while lo < hi:
            mid = (lo + hi) // 2
            if buf[p + lo : p + mid + 1] == buf[node + lo : node + mid + 1]:
                lo = mid + 1
            else:
                hi = mid
        above, below = None, root
        while type(below) is list and below[0] < lo:
            above, below = below, below[1][buf[p + below[0]]] if buf[p + below[0]] in below[1] else below[2]
        if type(below) is list and below[0] == lo:
            below[1][buf[p + lo]] = p
            continue
        leaf = below[2] if type(below) is list else below
        new = [lo, {buf[leaf + lo]: below, buf[p + lo]: p}, leaf]
        if above is None:
            root = new
        else:
            above[1][buf[p + above[0]]] = new
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if type(node) is list:
            stack.extend(node[1][c] for c in sorted(node[1], reverse=True))
        else:
            out.append(equal[node])
    return out


def shallow_sort(keys: list[np.ndarray], group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Multikey quicksort of strings by their groups and first bytes: (order, starts and ends in it of what is still tied).

    A character is eight bytes, as a number; `keys` has one array per depth.  Each open stretch of the order takes a pivot, the median of three of its
    characters, and is parted in place to what is less, equal and greater: the equal part goes on a character deeper, until the depth is
    reached and it is tied.  All stretches of all groups are parted at once, and parting keeps the order of the texts."""
    order = np.argsort(group, kind="stable")
    edges = np.flatnonzero(np.concatenate(([True], np.diff(group[order]) != 0))) if len(order) else np.zeros(0, np.int64)
    lo, hi = edges, np.append(edges[1:], len(order))
    depth, tied = np.zeros(len(lo), np.int64), []
    while True:
        deep = (depth == len(keys)) & (hi - lo > 1)
        tied.append((lo[deep], hi[deep]))
        some = (hi - lo > 1) & (depth < len(keys))
        lo, hi, depth = lo[some], hi[some], depth[some]
        if not len(lo):
            break
        size = hi - lo
        first = np.cumsum(size) - size
        of = np.repeat(np.arange(len(lo)), size)
        inside = np.arange(len(of)) - first[of]
        members = order[lo[of] + inside]
        c = keys[0][members]
        for d in range(1, len(keys)):
            deeper = depth[of] == d
            c[deeper] = keys[d][members[deeper]]
        pivot = np.sort([c[first], c[first + size // 2], c[first + size - 1]], axis=0)[1]
        less, same = c < pivot[of], c == pivot[of]
        n_less, n_same = np.add.reduceat(less, first, dtype=np.int64), np.add.reduceat(same, first, dtype=np.int64)
        less_before, same_before = np.cumsum(less) - less, np.cumsum(same) - same  # before each, from its stretch's start on:
        less_before, same_before = less_before - less_before[first][of], same_before - same_before[first][of]
        at = np.where(less, less_before, np.where(same, n_less[of] + same_before, n_less[of] + n_same[of] + inside - less_before - same_before))
        order[lo[of] + at] = members
        a, b = lo + n_less, lo + n_less + n_same
        lo, hi, depth = np.concatenate((lo, a, b)), np.concatenate((a, b, hi)), np.concatenate((depth, depth + 1, depth))
    starts, ends = (np.concatenate(t) for t in zip(*tied, strict=True))
    by = np.argsort(starts)
    return order, starts[by], ends[by]


def deep_shallow(buf: bytes, places: np.ndarray, group: np.ndarray, sizes: np.ndarray, keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The order of the strings at `places` within their groups, equal ones in the order given, and which are equal to an earlier one.

    Strings of one group have one size, of at least `SHALLOW` bytes; `keys` are their first ones."""
    order, starts, ends = shallow_sort(keys, group)
    late = np.zeros(len(order), bool)
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        members = order[a:b]
        found = _trie_order(buf, places[members].tolist(), int(sizes[members[0]]), SHALLOW)
        for same in found:
            if len(same) > 1:
                late[members[same[1:]]] = True
        order[a:b] = members[[i for same in found for i in same]]
    return order, late


def covered_in_group(buf: bytes, begin: np.ndarray, n: np.ndarray, group: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Windows that an earlier run of their group has too: (run, window).

    Runs stand in the order of groups, and inside a group in that of their documents and starts."""
    v = np.frombuffer(buf, np.uint8).astype(np.uint64)
    for step, bits in ((1, 8), (2, 16), (4, 32)):  # the eight bytes from each place as a number
        v = (v << np.uint64(bits)) | np.concatenate((v[step:], np.zeros(step, np.uint64)))
    run = np.repeat(np.arange(len(n)), n)
    window = np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
    at = begin[run] + window
    _, late = deep_shallow(buf, at, group[run], np.full(len(at), length), [v[at + i] for i in range(0, SHALLOW, 8)])
    found = np.flatnonzero(late)
    return run[found], window[found]


def equal_runs(buf: bytes, begin: np.ndarray, n: np.ndarray, group: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Which runs are equal to an earlier one of their group, of as many windows."""
    x = np.frombuffer(buf, np.uint8)
    first = np.ascontiguousarray(x[begin[:, None] + np.arange(SHALLOW)]).view(">u8").astype(np.uint64)
    _, alike = np.unique(np.stack((group, n)), axis=1, return_inverse=True)
    return deep_shallow(buf, begin, alike.ravel(), n + length - 1, list(first.T))[1]


def _compared(pieces: DataFrame, length: int) -> DataFrame:
    """-> d, tk, start, n: covered windows; `body` is set instead where a window of a dealt group is still to be compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, blobs in gathered(batches):
            got = [unpack(b) for b in blobs]
            d, tk, start, n, g, again, salt, hot = (np.concatenate(c) for c in list(zip(*got, strict=True))[:8])
            buf = b"".join(x[8] for x in got)
            del got
            size = n + length - 1
            begin = np.cumsum(size) - size
            by = np.lexsort((start, tk, d, salt, g))
            # a row repeated whole is one place
            twin = np.zeros(len(by), bool)
            twin[1:] = True
            for c in (g, d, tk, start):
                twin[1:] &= c[by][1:] == c[by][:-1]
            by = by[~twin]
            new = np.concatenate(([True], (g[by][1:] != g[by][:-1]) | (salt[by][1:] != salt[by][:-1])))
            group = np.cumsum(new) - 1
            edges = np.append(np.flatnonzero(new), len(by))
            upto = np.cumsum(np.add.reduceat(size[by], edges[:-1]))  # bytes at the end of each group
            done = 0
            while done < len(upto):  # about half a megabyte of whole groups at once
                last = max(done + 1, int(np.searchsorted(upto, (upto[done - 1] if done else 0) + (1 << 19))))
                lo, hi = edges[done], edges[last]
                i = by[lo:hi]
                text = b"".join([buf[b : b + s] for b, s in zip(begin[i].tolist(), size[i].tolist(), strict=True)])
                yield from chunk(text, d[i], tk[i], start[i], n[i], group[lo:hi] - done, again[i], hot[i])
                done = last

    def chunk(text, d, tk, start, n, group, again, hot) -> Iterator[pa.RecordBatch]:
        begin = np.cumsum(n + length - 1) - (n + length - 1)
        whole = equal_runs(text, begin, n, group, length)
        yield batch_of(d[whole], tk[whole], start[whole], n[whole])
        i = np.flatnonzero(~whole & hot)
        if len(i):
            one = np.repeat(i, n[i])
            w = np.arange(len(one)) - np.repeat(np.cumsum(n[i]) - n[i], n[i])
            yield batch_of(d[one], tk[one], start[one] + w, np.ones(len(one)), [text[p : p + length] for p in (begin[one] + w).tolist()])
        # a group of one run is done, if its own windows can't be equal
        left = ~whole & ~hot
        many = np.bincount(group[left], minlength=int(group[-1]) + 1)[group] > 1
        some = np.bincount(group[left & again], minlength=int(group[-1]) + 1)[group] > 0
        i = np.flatnonzero(left & (many | some))
        if not len(i):
            return
        body = b"".join([text[b : b + s] for b, s in zip(begin[i].tolist(), (n[i] + length - 1).tolist(), strict=True)])
        r, w = covered_in_group(body, np.cumsum(n[i] + length - 1) - (n[i] + length - 1), n[i], group[i], length)
        if len(r):  # neighbouring windows as one row
            by = np.lexsort((w, r))
            r, w = r[by], w[by]
            first = np.flatnonzero(np.concatenate(([True], (r[1:] != r[:-1]) | (w[1:] != w[:-1] + 1))))
            at = i[r[first]]
            yield batch_of(d[at], tk[at], start[at] + w[first], np.diff(np.append(first, len(r))))

    def batch_of(d, tk, start, n, body=None) -> pa.RecordBatch:
        cols = [pa.array(d, pa.int64()), pa.array(tk, pa.int64()), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(body or [None] * len(d), pa.binary())]
        return pa.record_batch(cols, names=["d", "tk", "start", "n", "body"])

    return pieces.repartition("part").sortWithinPartitions("part").mapInArrow(lean(run), "d bigint, tk bigint, start int, n int, body binary")


def covered(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """-> d, tk, start, n: windows that also stand earlier."""
    windows = docs.agg(F.sum(F.greatest(F.octet_length("text") - length + 1, F.lit(0)))).first()[0] or 0
    parts = min(windows // 40 // PART_RUNS + 1, 1 << 22)  # the bits above BITS tell no more parts than that apart
    pieces = cut(run_pieces(docs, length, parts), "runs")
    asked = cut(repeated_runs(pieces), "repeated")
    size = asked.agg(F.sum(F.col("n") + length)).first()[0] or 0
    found = cut(_compared(run_bytes(docs, asked, length, size // PART_BYTES + 1), length), "covered")
    # the windows of dealt groups, by their whole strings
    place = F.struct("d", "tk", "start")
    hot = found.where("body is not null")
    first = hot.groupBy("body").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").select("body", "first")
    late = hot.join(first, "body").where(place != F.col("first"))
    cols = ["d", "tk", "start", "n"]
    return _settled(pieces).unionByName(found.where("body is null").select(cols)).unionByName(late.select(cols))


def merge(spans: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """(start, windows) -> maximal byte spans [a, b)."""
    out: list[list[int]] = []
    for s, n in sorted(spans):
        e = s + n + length - 1
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(a, b) for a, b in out]


def _with_spans(docs: DataFrame, length: int) -> DataFrame:
    """-> d, tk, z, spans: every row once."""
    spans = covered(docs, length).groupBy("d", "tk").agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    return _zipped(docs).join(spans, ["d", "tk"], "left").select("d", "tk", "z", "spans")


def _kept(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, b in spans:
        out.append(text[at:a])
        at = b
    return b"".join((*out, text[at:]))


def repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """-> doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (start, end)."""

    def run(batch: pa.RecordBatch) -> dict[str, list]:
        cols = {c: [] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans")}
        for d, z, spans in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
            text, found = _unzip(z), merge([(s["start"], s["n"]) for s in spans or ()], length)
            cols["doc_id"].append(None if d == LAST else d)
            cols["n_bytes"].append(len(text))
            cols["n_removed"].append(sum(b - a for a, b in found))
            cols["n_spans"].append(len(found))
            cols["kept_sha256"].append(hashlib.sha256(_kept(text, found)).hexdigest())
            cols["spans"].append([{"start": a, "end": b} for a, b in found])
        return cols

    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<struct<start bigint, end bigint>>"
    return map_batches(_with_spans(docs, length), run, schema)


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """`docs` with repeated strings cut out of the text; what is left of a character that was cut
    goes too.  A row of whose text nothing but blanks is left (though there was more) goes; `n_chars`, where
    there is such a column, is counted anew.

    One pass of Python over the rows; a UDF would be run twice, by the filter and by the columns."""
    own, twin, spans = unused([*docs.columns, "d", "tk"], "own", "twin", "spans")
    keys = docs.select("*", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST)).alias(own), F.xxhash64(F.coalesce("text", F.lit(""))).alias(twin))
    found = covered(docs, length).groupBy("d", "tk").agg(F.collect_list(F.struct("start", "n")).alias(spans))
    met = keys.join(found.select(F.col("d").alias(own), F.col("tk").alias(twin), spans), [own, twin], "left").select(*docs.columns, spans)
    names = docs.columns
    at, chars = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols, last = list(batch.columns), batch.num_columns - 1
            changed = np.flatnonzero(cols[last].is_valid().to_numpy(zero_copy_only=False))
            texts, kept = cols[at].to_pylist(), np.ones(batch.num_rows, bool)
            for i in changed.tolist():
                texts[i] = _kept(texts[i].encode(), merge([(s["start"], s["n"]) for s in cols[last][i].as_py()], length)).decode("utf-8", "ignore")
                kept[i] = bool(texts[i].strip(" "))
            cols[at] = pa.array(texts, cols[at].type)
            if chars is not None:
                cols[chars] = pa.array([len(t or "") for t in texts]).cast(cols[chars].type)
            yield pa.RecordBatch.from_arrays(cols[:last], names=names).filter(pa.array(kept))

    return met.mapInArrow(lean(run), docs.schema)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: bytes, bytes removed, removed runs and the digest of what stays."""
    return repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
