"""Token ids as files: a wavelet matrix per shard, with token access, counting and occurrence lookup.

Documents are tokenised, put in ascending order of their ids and dealt to shards of bounded size; a task writes each shard as one file:

* head: magic, version, number of tokens and documents, width of a token in bits, and the lengths of the sections that follow;
* documents: ids (64 bits, with marks of null ids) and numbers of tokens, compressed;
* one section per bit of a token, highest first: the number of its zeros and the bit plane, compressed.  In a wavelet matrix the tokens are
  dealt to those whose bit is 0 and those whose bit is 1, in their order, before the next plane is taken.

Ones before each block of 64 bits are summed when a plane is loaded (the rank directory).  With these, `access` reads a token, `rank` counts a token
before a place, `count` in a range, `select` finds its k-th place and `places` all of them, from the planes only; `tokens` turns all back at once.

Tasks write through the file system that the path names (`pyarrow.fs`), below a name of their own that is moved to the final one, so a task that runs
twice leaves one file.  Spark's reader lists and reads the files back.

A text's pieces are tokenised once each and remembered: this tokenizer drops white space, its normalizer and splits never look across it, and letters, digits
and signs of ASCII and Latin-1 letters are split by its pattern, so the ids are those of the whole text (tests hold them against it).  A tokenizer with
another normalizer or other splits is given whole texts.

Defined results: a null or empty text is its end id alone; a very long text is tokenised chunk by chunk and isn't parted: its ids are in one
shard (a shard ends after the document that fills it); null ids come first; documents of one id are ordered by the digest of their ids, equal ones by a
fixed number of each row, which also spreads them over tasks; repeated rows are written each; an empty table gives no files and an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import math
import os
import re
import struct
import sys
import types
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain, count, repeat
from pathlib import Path
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eodlake.llm.common import cut, map_batches, shared_dir, table, text_bytes

if TYPE_CHECKING:
    from tokenizers import Tokenizer

END, SHARD_TOKENS, KEEP, KEEP_BYTES = 1, 1 << 21, 1_000_000, 1 << 24
MAGIC, HEAD = b"WAVM", "<4sHHQQ"  # magic, version, bits, tokens, documents
RUN = 1 << 12  # partitions whose sums are added up by one task


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WaveletMatrix:
    """Bit planes of a sequence of numbers of `bits` bits."""

    def __init__(self, planes: list[np.ndarray], zeros: list[int], n: int) -> None:
        self.planes, self.zeros, self.n, self.bits = planes, zeros, n, len(planes)
        self._words: dict[int, np.ndarray] = {}
        self._before: dict[int, np.ndarray] = {}

    @classmethod
    def build(cls, tokens: np.ndarray, bits: int) -> WaveletMatrix:
        planes, zeros, left = [], [], np.asarray(tokens).astype(np.uint16 if bits <= 16 else np.uint32)
        for level in range(bits - 1, -1, -1):
            ones = (left & left.dtype.type(1 << level)).astype(bool)
            planes.append(np.packbits(ones, bitorder="little"))
            back, left = left, np.empty_like(left)
            n = len(left) - int(np.count_nonzero(ones))
            zeros.append(n)
            np.compress(~ones, back, out=left[:n])
            np.compress(ones, back, out=left[n:])
        return cls(planes, zeros, len(tokens))

    def _directory(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        """A plane as words of 64 bits, and the ones before each."""
        if level not in self._words:
            plane = self.planes[level]
            words = np.zeros(len(plane) // 8 + 1, "<u8")
            words.view(np.uint8)[: len(plane)] = plane
            self._words[level] = words
            self._before[level] = np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64)))
        return self._words[level], self._before[level]

    def _ones(self, level: int, i: np.ndarray) -> np.ndarray:
        """Ones among the first i bits of a plane, for each i."""
        words, before = self._directory(level)
        i = np.asarray(i, np.int64)
        at, rest = i >> 6, (i & 63).astype(np.uint64)
        mask = (np.uint64(1) << rest) - np.uint64(1)
        return before[at] + np.bitwise_count(words[at] & mask)

    def _bit(self, level: int, i: np.ndarray) -> np.ndarray:
        words, _ = self._directory(level)
        i = np.asarray(i, np.int64)
        return (words[i >> 6] >> (i & 63).astype(np.uint64) & np.uint64(1)).astype(np.int64)

    def access(self, i: np.ndarray | int) -> np.ndarray:
        """Tokens at the places i."""
        i = np.asarray(i, np.int64)
        out = np.zeros_like(i)
        for level in range(self.bits):
            bit, ones = self._bit(level, i), self._ones(level, i)
            out = out << 1 | bit
            i = np.where(bit == 1, self.zeros[level] + ones, i - ones)
        return out

    def tokens(self) -> np.ndarray:
        """The whole sequence: the deals of all planes are undone, the last first."""
        out = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for level in range(self.bits - 1, -1, -1):
            ones = np.unpackbits(self.planes[level], count=self.n, bitorder="little").view(bool)
            out[self.zeros[level] :] |= out.dtype.type(1 << self.bits - 1 - level)
            back = np.empty_like(out)
            back[~ones], back[ones] = out[: self.zeros[level]], out[self.zeros[level] :]
            out = back
        return out

    def _range(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        """Where the token's occurrences in [lo, hi) stand after the last deal."""
        for level in range(self.bits):
            ones = self._ones(level, np.array([lo, hi]))
            if token >> self.bits - 1 - level & 1:
                lo, hi = (self.zeros[level] + ones).tolist()
            else:
                lo, hi = (np.array([lo, hi]) - ones).tolist()
        return lo, hi

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """Occurrences in [lo, hi)."""
        if token >> self.bits:
            return 0
        lo, hi = self._range(token, lo, self.n if hi is None else hi)
        return hi - lo

    def rank(self, token: int, i: int) -> int:
        """Occurrences before place i."""
        return self.count(token, 0, i)

    def places(self, token: int, lo: int = 0, hi: int | None = None) -> np.ndarray:
        """All places of a token in [lo, hi), ascending."""
        if token >> self.bits:
            return np.zeros(0, np.int64)
        a, b = self._range(token, lo, self.n if hi is None else hi)
        at = np.arange(a, b)
        for level in range(self.bits - 1, -1, -1):
            one = token >> self.bits - 1 - level & 1
            at = self._select(level, at - self.zeros[level] if one else at, one)
        return at

    def select(self, token: int, k: int) -> int:
        """The place of occurrence k, from 0."""
        found = self.count(token)
        if not 0 <= k < found:
            raise IndexError(f"token {token} occurs {found} times")
        at = np.array([self._range(token, 0, self.n)[0] + k])
        for level in range(self.bits - 1, -1, -1):
            one = token >> self.bits - 1 - level & 1
            at = self._select(level, at - self.zeros[level] if one else at, one)
        return int(at[0])

    def _select(self, level: int, k: np.ndarray, one: int) -> np.ndarray:
        """The places of the k-th zeros or ones of a plane: the block by the directory, then by halves within its 64 bits."""
        words, before = self._directory(level)
        marks = before if one else (np.arange(len(before), dtype=np.int64) << 6) - before
        at = np.searchsorted(marks, k, side="right") - 1
        word, left = (words[at] if one else ~words[at]), (k - marks[at]).astype(np.uint64)
        place = np.zeros(len(at), np.uint64)
        for half in (32, 16, 8, 4, 2, 1):
            low = np.bitwise_count(word >> place & np.uint64((1 << half) - 1)).astype(np.uint64)
            up = left >= low
            left = np.where(up, left - low, left)
            place = np.where(up, place + np.uint64(half), place)
        return (at << 6) + place.astype(np.int64)


class ShardFile:
    """One shard: its documents and its tokens."""

    def __init__(self, doc_ids: list[int | None], lengths: np.ndarray, matrix: WaveletMatrix) -> None:
        self.doc_ids, self.lengths, self.matrix = doc_ids, lengths, matrix

    def to_bytes(self) -> bytes:
        import zstandard

        press = zstandard.ZstdCompressor(level=1).compress
        named = np.array([d is not None for d in self.doc_ids], bool)
        ids = np.array([d or 0 for d in self.doc_ids], "<i8")
        docs = press(np.packbits(named, bitorder="little").tobytes() + ids.tobytes() + np.asarray(self.lengths, "<i8").tobytes())
        planes = [press(p.tobytes()) for p in self.matrix.planes]
        m = self.matrix
        sections = np.array([len(docs), *(len(p) for p in planes), *m.zeros], "<u8").tobytes()
        return b"".join([struct.pack(HEAD, MAGIC, 1, m.bits, m.n, len(self.doc_ids)), sections, docs, *planes])

    @classmethod
    def from_bytes(cls, data: bytes) -> ShardFile:
        import zstandard

        magic, version, bits, n, n_docs = struct.unpack_from(HEAD, data)
        if magic != MAGIC or version != 1:
            raise ValueError("not a shard file")
        sections = np.frombuffer(data, "<u8", 1 + 2 * bits, struct.calcsize(HEAD))
        at, parts = struct.calcsize(HEAD) + sections.nbytes, []
        for size in sections[: bits + 1].tolist():
            parts.append(zstandard.ZstdDecompressor().decompress(data[at : at + size]))
            at += size
        marks = (n_docs + 7) // 8
        named = np.unpackbits(np.frombuffer(parts[0], np.uint8, marks), count=n_docs, bitorder="little").tolist()
        ids = np.frombuffer(parts[0], "<i8", n_docs, marks).tolist()
        lengths = np.frombuffer(parts[0], "<i8", n_docs, marks + 8 * n_docs)
        planes = [np.frombuffer(p, np.uint8) for p in parts[1:]]
        return cls([d if ok else None for d, ok in zip(ids, named, strict=True)], lengths, WaveletMatrix(planes, sections[bits + 1 :].tolist(), n))


#: What the pieces are cut by: white space, letters, a digit, other signs.
BLANK, LETTER, DIGIT, SIGN = range(4)
_KIND = np.full(256, SIGN, np.uint8)
_KIND[list(b"\t\n\v\f\r ")], _KIND[list(b"0123456789")] = BLANK, DIGIT
_KIND[[c for c in range(128) if chr(c).isalpha()]] = LETTER
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")] += 32
#: Bytes that keep their chunk whole, unless they are a letter of Latin-1 (C3 and one of _LATIN): control characters and all that isn't ASCII.
_ODD = np.array([(c < 32 and not chr(c).isspace()) or 28 <= c < 32 or c >= 127 for c in range(256)])
_LATIN = np.array([0x80 <= c < 0xC0 and c not in (0x97, 0xB7) for c in range(256)])  # not the signs of times and division
_PLAIN = re.compile(rb"[!-~]*+(?:(?:\xc3[\x9f-\xb6\xb8-\xbf])++[!-~]*+)*+")
#: What the splits and the ids of pieces rest on; other tokenizers are given whole texts.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = {"type": "Split", "pattern": {"Regex": _PATTERN}, "behavior": "Removed", "invert": True}
_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}


def _after(x: np.ndarray, by: int = 1) -> np.ndarray:
    """x moved down: the value `by` places later, 0 at the end."""
    out = np.zeros_like(x)
    out[:-by] = x[by:]
    return out


def pieces_of(texts: list[bytes]) -> pa.Array:
    """Pieces that the tokenizer takes by themselves, in their order, with a blank after those of each text.

    Its own splits are made over the bytes of all texts at once, in lower case as its normalizer makes them.  A chunk between white space that holds
    another character than ASCII and the letters of Latin-1 (it may be composed with its neighbours), a control character or what may begin a special
    token (which is told before all that) stays whole and as it is."""
    data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    kind, low, odd = _KIND[data], _LOWER[data], _ODD[data]
    if odd.any():
        second = np.zeros(len(data), bool)
        second[1:] = (data[:-1] == 0xC3) & _LATIN[data[1:]]
        letter = second | _after(second)
        odd &= ~letter
        kind[letter] = LETTER
        low[second & (data < 0x9F)] += 32
    odd |= (data == ord("<")) & (_after(data) == ord("|"))
    starts = np.ones(len(data), bool)
    starts[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
    # 's 't 'm 'd 're 've 'll, where the sign begins a piece: the next piece begins after them
    mark = np.flatnonzero((data == ord("'")) & starts)
    if len(mark):
        # the last byte is a blank, so one place after a sign there always is one, and what stands two after it is looked at only then
        one, two = low[mark + 1], low[np.minimum(mark + 2, len(data) - 1)]
        short = np.isin(one, list(b"stmd"))
        long = np.isin(one, list(b"rv")) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        starts[mark[short | long] + 1] = False
        starts[mark[short] + 2] = starts[mark[long] + 3] = True
    if odd.any():
        blanks = np.flatnonzero(kind == BLANK)
        chunk = np.unique(np.searchsorted(blanks, np.flatnonzero(odd)))
        begin, end = np.where(chunk > 0, blanks[chunk - 1] + 1, 0), blanks[chunk]
        inside = np.zeros(len(data), np.int8)
        inside[begin], inside[end] = 1, -1
        inside = np.cumsum(inside, dtype=np.int8).view(bool)
        low[inside] = data[inside]
        starts[inside] = False
        starts[begin] = True
    keep = kind != BLANK
    keep[ends] = starts[ends] = True
    starts[ends[:-1] + 1] = True
    low, at = low[keep], np.flatnonzero(starts[keep])
    offsets = np.append(at, len(low)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(low)])


class Encoder:
    """Ids of whole texts.  Pieces are numbered and their ids kept, up to a bound; those of a batch are learned together.

    Plain pieces (ASCII and lower-case letters of Latin-1, which the normalizer leaves as they are) go to the library's BPE without its normalizer and
    splits, which took two thirds of their time; all others to the whole tokenizer, each as a text."""

    def __init__(self, model: str, end: int = END) -> None:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks share the cores already
        self.tokenizer, self.end, parts = Tokenizer.from_str(model), end, json.loads(model)
        bpe, suffix = parts["model"], parts["model"].get("end_of_word_suffix")
        self.split = (
            parts["normalizer"] == _NORMALIZER
            and parts["pre_tokenizer"] == {"type": "Sequence", "pretokenizers": [_SPLIT, _BYTES]}
            and all(t["content"].startswith("<|") and not re.search(r"\s", t["content"]) and not (t["lstrip"] or t["rstrip"] or t["normalized"]) for t in parts["added_tokens"])
            and bpe["type"] == "BPE" and not bpe["dropout"] and bool(suffix)
        )
        if self.split:
            words = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, _BYTES]}
            self.bpe = Tokenizer.from_str(json.dumps(parts | {"added_tokens": [], "normalizer": None, "pre_tokenizer": words}))
            self.last = np.zeros(max(bpe["vocab"].values()) + 1, bool)  # tokens that end a piece
            self.last[[i for t, i in bpe["vocab"].items() if t.endswith(suffix)]] = True
        self.forget()

    def _ids(self, tokenizer: Tokenizer, texts: list[bytes]) -> list[np.ndarray]:
        return [np.array(x.ids, np.uint32) for x in tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]

    def forget(self) -> None:
        # number 0 is the end
        self.number, self.size = {b" ": 0}, 0
        self.flat, self.starts, self.lengths = np.array([self.end], np.uint32), np.zeros(1, np.int64), np.ones(1, np.int64)

    def _learn(self, pieces: list[bytes]) -> None:
        """Number pieces that are new, plain ones first."""
        plain, odd = [], []
        for c in pieces:
            (plain if _PLAIN.fullmatch(c) and b"<|" not in c else odd).append(c)
        flat, lengths = [self.flat], [self.lengths]
        for i in range(0, len(plain), 20_000):
            part = plain[i : i + 20_000]
            found = self._ids(self.bpe, [b" ".join(part)])[0]
            ends = np.flatnonzero(self.last[found])
            if len(ends) != len(part) or ends[-1] + 1 != len(found):
                raise ValueError("a piece doesn't end with a token that ends pieces")
            flat.append(found)
            lengths.append(np.diff(ends, prepend=-1))
        for i in range(0, len(odd), 1000):
            found = self._ids(self.tokenizer, odd[i : i + 1000])
            flat += found
            lengths.append(np.array([len(x) for x in found]))
        self.number.update(zip(chain(plain, odd), count(len(self.number)), strict=False))
        self.size += sum(map(len, pieces))
        self.flat, self.lengths = np.concatenate(flat), np.concatenate(lengths)
        self.starts = np.cumsum(self.lengths) - self.lengths

    def __call__(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each text with the end id after it."""
        if not texts:
            return []
        if not self.split:
            return [np.append(x, np.uint32(self.end)) for t in texts for x in self._ids(self.tokenizer, [t])]
        coded = pieces_of(texts).dictionary_encode()  # each distinct piece of the batch is looked up once
        pieces = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary), b"\n")[0].as_py().split(b"\n")
        numbers = np.fromiter(map(self.number.get, pieces, repeat(-1)), np.int64, len(pieces))
        late = np.flatnonzero(numbers < 0).tolist()
        if late:
            if len(self.number) + len(late) > KEEP or self.size > KEEP_BYTES:
                self.forget()
                late = [i for i, c in enumerate(pieces) if c != b" "]
                numbers[:] = 0
            new = [pieces[i] for i in late]
            self._learn(new)
            numbers[late] = np.fromiter(map(self.number.__getitem__, new), np.int64, len(new))
        at = numbers[coded.indices.to_numpy()]
        lengths = self.lengths[at]
        ends = np.cumsum(lengths)
        ids = self.flat[np.repeat(self.starts[at] - (ends - lengths), lengths) + np.arange(ends[-1])]
        return np.split(ids, ends[np.flatnonzero(at == 0)][:-1])


def _worker_encoder(model: str) -> Encoder:
    """The encoder that a Python worker keeps between its tasks, with what it has learned (bounded by `KEEP`).  Functions that are sent by value have no
    module to keep it in, so it has one of its own."""
    kept = sys.modules.setdefault("_eodlake_kept", types.ModuleType("_eodlake_kept")).__dict__
    key = hashlib.sha256(model.encode()).hexdigest()
    if key not in kept:
        kept[key] = Encoder(model)
    return kept[key]


def _encoded(docs: DataFrame, path: str) -> DataFrame:
    """-> doc_id, n, digest, ids (compressed), spread: one row per document."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_bytes(F.col("text")).alias("text"))
    model = docs.sparkSession.sparkContext.broadcast(Path(path).read_text())  # a few MB, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        encode, press = _worker_encoder(model.value), zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                ids = [x.astype("<u4").tobytes() for x in encode(part.column(1).to_pylist())]
                out = [part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64()), pa.array([press.compress(x) for x in ids], pa.binary())]
                yield pa.record_batch(out, names=["doc_id", "n", "digest", "ids"])

    made = rows.mapInArrow(run, "doc_id bigint, n bigint, digest bigint, ids binary")
    return made.withColumn("spread", F.xxhash64(F.spark_partition_id(), F.monotonically_increasing_id()))


def write_shards(docs: DataFrame, folder: str, path: str | None = None, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Write all documents as shard files below `folder`, a path that all machines share; -> file_name, n_docs, n_tokens of each.

    A partition holds a stretch of the order; its files are numbered in it, so the files' names sort as the documents do."""
    path = path or default_tokenizer()
    encoded = cut(_encoded(docs, path), "token-ids")
    total = encoded.agg(F.sum("n")).first()[0] or 0
    order = [F.col("doc_id").asc_nulls_first(), "digest", "spread"]
    parts = math.ceil(total / shard_tokens) or 1
    stretches = encoded.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    bits = _width(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        open_zip = zstandard.ZstdDecompressor()

        def written(part: int, number: int, ids: list[int | None], tokens: list[np.ndarray]) -> pa.RecordBatch:
            lengths = np.array([len(t) for t in tokens])
            body = ShardFile(ids, lengths, WaveletMatrix.build(np.concatenate(tokens), bits)).to_bytes()
            name = f"{part:09d}-{number:06d}.wavm"
            own = f"{base}/_{name}-{uuid.uuid4().hex}"
            with system.open_output_stream(own) as out:
                out.write(body)
            system.move(own, f"{base}/{name}")
            return pa.record_batch([pa.array([name]), pa.array([len(ids)], pa.int64()), pa.array([int(lengths.sum())], pa.int64())], names=["file_name", "n_docs", "n_tokens"])

        system.create_dir(base, recursive=True)
        part = number = size = 0
        ids, tokens = [], []
        for batch in batches:
            for part, doc_id, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids.append(doc_id)
                tokens.append(np.frombuffer(open_zip.decompress(blob), "<u4"))
                size += len(tokens[-1])
                if size >= shard_tokens:
                    yield written(part, number, ids, tokens)
                    ids, tokens, size, number = [], [], 0, number + 1
        if ids:
            yield written(part, number, ids, tokens)

    return cut(stretches.select("part", "doc_id", "ids").mapInArrow(run, "file_name string, n_docs bigint, n_tokens bigint"), "shards")


def _width(path: str) -> int:
    from tokenizers import Tokenizer

    return max(int(Tokenizer.from_file(path).get_vocab_size() - 1).bit_length(), 1)


def read_shards(spark: SparkSession, folder: str) -> DataFrame:
    """-> file_name, doc_id, at (ids of the file's documents before it), n_tokens, ids_crc32: one row per document."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wavm").schema("path string, modificationTime timestamp, length bigint, content binary").load(folder)

    def run(batch: pa.RecordBatch) -> Iterator[dict[str, list]]:
        for name, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            shard = ShardFile.from_bytes(body)
            tokens, ends = shard.matrix.tokens().astype("<u4"), np.cumsum(shard.lengths)
            starts = ends - shard.lengths
            crc = [zlib.crc32(tokens[a:b].tobytes()) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            yield {"file_name": [name] * len(crc), "doc_id": shard.doc_ids, "at": starts, "n_tokens": shard.lengths, "ids_crc32": crc}

    named = files.select(F.element_at(F.split("path", "/"), -1).alias("file_name"), "content")
    return map_batches(named, run, "file_name string, doc_id bigint, at bigint, n_tokens bigint, ids_crc32 bigint", rows=1)


def file_starts(files: DataFrame) -> DataFrame:
    """(file_name, n_tokens) -> file_name, start: tokens of all files before, in the order of names.  Sums are split by partition and by runs of partitions."""
    f = files.withColumn("part", F.substring_index("file_name", "-", 1).cast("bigint"))
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    before = lambda w: F.coalesce(F.sum("n").over(upto(w)), F.lit(0).cast("bigint"))
    parts = f.groupBy("part").agg(F.sum("n_tokens").alias("n")).withColumn("run", F.floor(F.col("part") / RUN))
    runs = parts.groupBy("run").agg(F.sum("n").alias("n")).select("run", before(Window.orderBy("run")).alias("run_before"))
    parts = parts.select("part", "run", before(Window.partitionBy("run").orderBy("part")).alias("part_before")).join(runs, "run")
    inside = f.select("file_name", "part", F.coalesce(F.sum("n_tokens").over(upto(Window.partitionBy("part").orderBy("file_name"))), F.lit(0).cast("bigint")).alias("file_before"))
    return inside.join(parts, "part").select("file_name", (F.col("run_before") + F.col("part_before") + F.col("file_before")).alias("start"))


def roundtrip(docs: DataFrame, path: str | None = None, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """-> doc_id, start, n_tokens, ids_crc32, as read from the files that were written."""
    spark = docs.sparkSession
    folder = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    files = write_shards(docs, folder, path, shard_tokens)
    if files.isEmpty():
        return spark.createDataFrame([], "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
    read, starts = read_shards(spark, folder), file_starts(files)
    return read.join(starts, "file_name").select("doc_id", (F.col("start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All `documents` as wavelet files, read back."""
    return roundtrip(table(spark, sf_dir, "documents"))
