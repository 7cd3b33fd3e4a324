"""Document fingerprints: a Merkle tree over sections and paragraphs.

A text falls into paragraphs (lines with their line end); `FANOUT` of them, or fewer up to a blank
line, are a section.  A paragraph's leaves are its sentences, cut further by content: after any `WINDOW` bytes of one sentence whose hash says
so (one in `SPACING`), at least `LEAST` bytes after the cut before, and after `MOST` bytes at the latest.  The rule is the same for all texts and sees only the sentence,
so what two texts share gives the same leaves, and a byte put in front of a long line changes one of them.  Each
node is the hash of its children's, each leaf the hash of its bytes, so equal roots mean equal
texts.  `aligned` sets the branches of two trees against each other by their hashes, whatever their places: equal ones at the ends first, then
the longest sequence of those that stand once in both; only what lies between is opened, a level down.  So a paragraph put in front moves the
others without making them differ.  `differing` gives the spans of bytes that are left, the edits.

The fingerprint is written as root ':' leaves, six hex digits each, with ',' after a paragraph and ';' after a
section, so the tree can be read from it.  The likeness of two is Dice's
share of the leaves that are aligned (1 for equal roots, which two empty texts have).

The edited text of a document takes its tail from the next one by id.  Documents are put in
ranges of ids, each range in a task's stream in order; only the first document of a range is also
sent to the range before it.  Ranges are taken from the ids' quantiles, as many as make `RANGE_BYTES` of text each; what a task holds at once
is two documents and a batch, so rows of a null id, which are one range, are read by one task but never held.

Defined results: a null text is empty; a very long text is one tree, in memory with its edited text's and the next one's; branches that stand several times
in both texts are aligned only at the ends of what differs; null ids come after all others; rows that share the id follow the order of a
hash of their text, so equal rows are each other's next; one document alone is its own next; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eodlake.llm.common import map_batches, table, text_bytes

FANOUT, WINDOW, SPACING, LEAST, MOST, DIGITS, RANGE_BYTES = 8, 4, 16, 4, 64, 6, 64 << 20
_SENTENCE = re.compile(rb"[^.!?\n]*(?:[.!?]+[ \t]*|\n|$)", re.DOTALL)
_LINE = re.compile(rb"[^\n]*\n|[^\n]+")
LOWEST = -(1 << 63)


@dataclass(slots=True)
class Node:
    digest: bytes
    start: int
    end: int
    children: list[Node]


def _inner(children: list[Node | Paragraph], at: int) -> Node:
    digest = hashlib.blake2b(b"".join(c.digest for c in children), digest_size=16).digest()
    return Node(digest, children[0].start if children else at, children[-1].end if children else at, children)


def _marks(text: bytes) -> np.ndarray:
    """Ends of the windows whose hash marks a cut, ascending."""
    n = len(text) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    windows = np.ndarray((n,), "<u4", text, strides=(1,)) * np.uint32(0x9E3779B1)
    return np.flatnonzero((windows >> np.uint32(15)) % np.uint32(SPACING) == 0) + WINDOW


class Paragraph:
    """A node whose leaves are kept as digests and lengths, and made when its branch is opened."""

    __slots__ = ("digest", "start", "end", "digests", "lengths")

    def __init__(self, start: int, digests: list[bytes], lengths: list[int]) -> None:
        self.digest = hashlib.blake2b(b"".join(digests), digest_size=16).digest()
        self.start, self.end, self.digests, self.lengths = start, start + sum(lengths), digests, lengths

    @property
    def children(self) -> list[Node]:
        out, at = [], self.start
        for d, n in zip(self.digests, self.lengths, strict=True):
            out.append(Node(d, at, at + n, []))
            at += n
        return out


Leaves = tuple[list[bytes], list[int]]  # digests, lengths


def _sentence_leaves(text: bytes, at: int, end: int, marks: list[int]) -> Leaves:
    """The leaves of a sentence, which stands from `at` to `end`; its bytes alone decide."""
    cuts, first, last = [], at + WINDOW, at  # windows stand in the sentence whole
    for k in range(bisect_left(marks, first), len(marks)):
        cut = marks[k]
        if cut >= end:
            break
        while cut - last > MOST:
            last += MOST
            cuts.append(last)
        if cut - last >= LEAST:
            cuts.append(cut)
            last = cut
    cuts.extend(range(last + MOST, end, MOST))
    edges = [at, *cuts, end]
    return [xxhash.xxh3_128_digest(text[x:y]) for x, y in zip(edges, edges[1:], strict=False)], [y - x for x, y in zip(edges, edges[1:], strict=False)]


def tree(text: bytes, known: dict[bytes, Leaves] | None = None) -> Node:
    """The tree of a text; `known` keeps the leaves of sentences between the trees of texts that share some."""
    known = {} if known is None else known
    sections, paragraphs, at, marks = [], [], 0, None
    for line in _LINE.findall(text):
        digests, lengths, start = [], [], at
        for sentence in _SENTENCE.findall(line):
            if not sentence:
                continue
            found = known.get(sentence)
            if found is None:
                marks = _marks(text).tolist() if marks is None else marks
                found = known[sentence] = _sentence_leaves(text, at, at + len(sentence), marks)
            digests += found[0]
            lengths += found[1]
            at += len(sentence)
        paragraphs.append(Paragraph(start, digests, lengths))
        if len(paragraphs) == FANOUT or not line.strip():
            sections.append(_inner(paragraphs, at))
            paragraphs = []
    if paragraphs:
        sections.append(_inner(paragraphs, at))
    return _inner(sections, 0)


def leaves(node: Node, depth: int = 0) -> Iterator[Node]:
    """Nodes of the lowest level."""
    if depth == 3:
        yield node
    else:
        for c in node.children:
            yield from leaves(c, depth + 1)


def fingerprint(root: Node) -> str:
    sections = ("".join(b"".join([x[: DIGITS // 2] for x in p.digests]).hex() + "," for p in s.children) + ";" for s in root.children)
    return root.digest.hex() + ":" + "".join(sections)


def read_tree(fp: str) -> Node:
    """The tree of a fingerprint: digests are what is written of a node, spans count leaves."""
    root, _, rest = fp.partition(":")
    sections, at = [], 0
    for section in rest.split(";")[:-1]:
        paragraphs = []
        for paragraph in section.split(",")[:-1]:
            found = [Node(paragraph[i : i + DIGITS].encode(), at + i // DIGITS, at + i // DIGITS + 1, []) for i in range(0, len(paragraph), DIGITS)]
            paragraphs.append(Node(paragraph.encode(), at, at + len(found), found))
            at += len(found)
        sections.append(Node(section.encode(), paragraphs[0].start if paragraphs else at, at, paragraphs))
    return Node(root.encode(), 0, at, sections)


def _anchors(a: list[bytes], b: list[bytes]) -> list[tuple[int, int]]:
    """Places of digests that stand once in both, as many as come in the same order."""
    once_a, once_b = Counter(a), Counter(b)
    where = {x: j for j, x in enumerate(b) if once_b[x] == 1}
    both = [(i, where[x]) for i, x in enumerate(a) if x in where and once_a[x] == 1]
    ends: list[int] = []  # longest increasing sequence of the places in b
    last: list[int] = []
    before: list[int] = []
    for n, (_, j) in enumerate(both):
        k = bisect_left(ends, j)
        before.append(last[k - 1] if k else -1)
        if k == len(ends):
            ends.append(j)
            last.append(n)
        else:
            ends[k], last[k] = j, n
    out, n = [], last[-1] if last else -1
    while n >= 0:
        out.append(both[n])
        n = before[n]
    return out[::-1]


def _equal_places(a: list[bytes], b: list[bytes]) -> list[tuple[int, int]]:
    """Places that are set against each other: equal ends, then anchors between them."""
    lo, na, nb = 0, len(a), len(b)
    while lo < na and lo < nb and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < na - lo and hi < nb - lo and a[na - 1 - hi] == b[nb - 1 - hi]:
        hi += 1
    middle = _anchors(a[lo : na - hi], b[lo : nb - hi]) if lo + hi < min(na, nb) else []
    return [*((i, i) for i in range(lo)), *((lo + i, lo + j) for i, j in middle), *((na - k, nb - k) for k in range(hi, 0, -1))]


def aligned(a: list[Node], b: list[Node], depth: int = 0) -> Iterator[tuple[Node | None, Node | None]]:
    """Nodes that are equal in both sequences, as pairs; leaves of `a` or `b` without an equal one, alone.

    `depth` is that of the nodes: 0 for roots, 3 for leaves."""
    i = j = 0
    for x, y in [*_equal_places([n.digest for n in a], [n.digest for n in b]), (len(a), len(b))]:
        gap_a, gap_b = a[i:x], b[j:y]
        if depth == 3:
            yield from ((n, None) for n in gap_a)
            yield from ((None, n) for n in gap_b)
        elif gap_a or gap_b:
            yield from aligned([c for n in gap_a for c in n.children], [c for n in gap_b for c in n.children], depth + 1)
        if x < len(a):
            yield a[x], b[y]
        i, j = x + 1, y + 1


def _digests(nodes: list[Node | Paragraph]) -> list[bytes]:
    """The digests of the nodes' children."""
    return [d for n in nodes for d in (n.digests if isinstance(n, Paragraph) else [c.digest for c in n.children])]


def _equal_leaves(a: list[Node], b: list[Node], depth: int = 0) -> int:
    """The leaves that `aligned` pairs, counted without making nodes of them."""
    total = i = j = 0
    for x, y in [*_equal_places([n.digest for n in a], [n.digest for n in b]), (len(a), len(b))]:
        gap_a, gap_b = a[i:x], b[j:y]
        if gap_a and gap_b:
            if depth == 2:
                total += len(_equal_places(_digests(gap_a), _digests(gap_b)))
            else:
                total += _equal_leaves([c for n in gap_a for c in n.children], [c for n in gap_b for c in n.children], depth + 1)
        if x < len(a):
            total += _leaves_below(a[x], depth)
        i, j = x + 1, y + 1
    return total


def _leaves_below(node: Node, depth: int) -> int:
    return len(node.digests) if isinstance(node, Paragraph) else sum(_leaves_below(c, depth + 1) for c in node.children) if depth < 3 else 1


def likeness(a: Node, b: Node) -> float:
    """Dice's share of aligned leaves, whose depth tells how many a pair stands for."""
    if a.digest == b.digest:
        return 1.0
    n, m = _leaves_below(a, 0), _leaves_below(b, 0)
    return 2 * _equal_leaves([a], [b]) / (n + m) if n + m else 1.0


def differing(a: Node, b: Node) -> list[tuple[int, int]]:
    """Spans of `b` that have no equal branch in `a`; where bytes of `a` are only missing, the empty span of that place."""
    out: list[list[int]] = []
    end = 0
    for x, y in aligned([a], [b]):
        if y is None:
            if not out or out[-1][1] != end:
                out.append([end, end])
            continue
        if x is None:
            if out and out[-1][1] == y.start:
                out[-1][1] = y.end
            else:
                out.append([y.start, y.end])
        end = y.end
    return [(s, e) for s, e in out]


def _bounds(ids: DataFrame, ranges: int) -> list[int]:
    """Ids that part the ranges; approximate quantiles, at most `ranges` numbers."""
    found = ids.where("doc_id is not null").approxQuantile("doc_id", [i / ranges for i in range(1, ranges)], 0.2 / ranges) if ranges > 1 else []
    return sorted({int(x) for x in found})


def _range_of(bounds: list[int], d: np.ndarray) -> np.ndarray:
    """Numbers of the ranges, 0 for the largest ids; null ids (LOWEST) are in the last."""
    return len(bounds) - np.searchsorted(np.array(bounds, np.int64), d)


def fingerprints(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """-> doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, edited_spans (bytes of the
    edited text that differing branches locate)."""
    import zstandard

    spark = docs.sparkSession
    ids = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = ranges or max(4, int(spark.conf.get("spark.sql.shuffle.partitions")), size // RANGE_BYTES)
    bounds = _bounds(ids, ranges)

    def tops(batch: pa.RecordBatch) -> dict[str, list]:
        d = np.sort(batch.column(0).fill_null(LOWEST).to_numpy())
        r, at = np.unique(_range_of(bounds, d)[::-1], return_index=True)  # the largest id of each range
        return {"r": r, "m": d[::-1][at]}

    firsts = {r: m for r, m in map_batches(ids, tops, "r int, m bigint").groupBy("r").agg(F.max("m").alias("m")).collect()}
    used = sorted(firsts)  # at most `ranges` numbers
    follows = {used[i]: used[i - 1] for i in range(len(used))}  # the first range closes the circle

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            cols: list[list] = [[], [], [], [], []]
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                key = LOWEST if d is None else d
                r = len(bounds) - bisect_left(bounds, key)
                text = t.as_py()
                row = (key, int.from_bytes(hashlib.blake2b(text, digest_size=7).digest(), "big"), pack.compress(text))
                for at, extra in ((r, False), *(((follows[r], True),) if key == firsts[r] else ())):
                    for c, v in zip(cols, (at, extra, *row), strict=True):
                        c.append(v)
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, (pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["r", "extra", "d", "tk", "z"])

    dealt = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_bytes(F.col("text")).alias("text")).mapInArrow(deal, "r int, extra boolean, d bigint, tk bigint, z binary")
    ordered = dealt.repartition(ranges, "r").sortWithinPartitions("r", "extra", F.desc("d"), "tk")

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """Documents with their next: both as (id, text, tree, leaves of its sentences)."""
        unpack, last, last_range, met_extra = zstandard.ZstdDecompressor(), None, None, False
        for batch in batches:
            for r, extra, d, z in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4)), strict=True):
                if r != last_range:
                    last_range, last, met_extra = r, None, False
                if met_extra:  # further rows that share the first id of the next range
                    continue
                met_extra = extra
                text = unpack.decompress(z)
                known: dict[bytes, Leaves] = {}  # of two documents at most
                own = (d, text.decode(), tree(text, known), known)
                if last:
                    yield last, own
                last = own

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for (d, text, own, known), (_, after, next_tree, next_known) in pairs(batches):
            n = len(text)
            edited = (text[: n - n // 3] + after[: n // 3]).encode()
            other = tree(edited, next_known | known)
            spans = [{"start": s, "end": e} for s, e in differing(own, other)]
            digest = hashlib.sha256(edited).hexdigest()
            rows.append((None if d == LOWEST else d, n, digest, fingerprint(own), fingerprint(other), likeness(own, other), likeness(own, next_tree), spans))
            if len(rows) >= 500:
                yield batch_of(rows)
                rows = []
        yield batch_of(rows)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), span)
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "edited_spans"]
        return pa.record_batch([pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) or [()] * 8, kinds, strict=True)], names=names)

    return ordered.mapInArrow(run, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, edited_spans array<struct<start bigint, end bigint>>")


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and that of its edited text."""
    return fingerprints(table(spark, sf_dir, "documents"))
