"""Token counts without tokens: a Viterbi search that carries only the best score and piece count.

The vocabulary is a unigram model: pieces with scores.  An Aho-Corasick automaton lists the pieces
that end at each character; the search keeps, for each place, the best score and the number of
pieces of the path with it, never the path.  Rules of the tokenizer that are kept exactly:

* white space is escaped (a blank becomes the mark U+2581) and one mark is put before the text;
* of pieces that end at the same place the longest is tried first, and a later one replaces it only with a strictly
  higher score, so the earliest start wins a tie;
* a character that no piece of one character covers can be an unknown piece, with the lowest score
  of the vocabulary less 10; it is written as one byte piece per UTF-8 byte.

Pieces hold a mark only at their start (or are marks alone), so a text falls into parts at each mark
that follows another character, and the best path is made of those of its parts.  Equal parts are
searched once per task: a bounded dictionary holds their counts.

Defined results: a null or empty text has no tokens; a very long text is counted part by part, parts over 64 characters are not
remembered; ties go by the rules above; null ids are carried; repeated rows are
reported each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eodlake.llm.common import table

MARK, UNKNOWN_PENALTY, KEEP = "▁", 10.0, 200_000
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
_PART = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


def vocabulary(path: str = MODEL) -> list[tuple[str, float, bool]]:
    """(piece, score, plain) of a model file; plain pieces can be found in a text."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(m.id_to_piece(i), m.get_score(i), not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i))) for i in range(m.get_piece_size())]


class Counter:
    def __init__(self, pieces: Iterable[tuple[str, float, bool]], keep: int = KEEP) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        plain = [(p, s) for p, s, ok in pieces if ok and p]
        if any(MARK in p.lstrip(MARK) for p, _ in plain):
            raise ValueError("a piece holds a mark inside")
        for p, s in plain:
            self.automaton.add_word(p, (len(p), s))
        self.automaton.make_automaton()
        self.unknown = min(s for _, s in plain) - UNKNOWN_PENALTY
        self.keep, self.known = keep, {}

    def viterbi(self, part: str) -> int:
        """Pieces of the best path over one part."""
        # at place i: the best score and the pieces of the path with it
        n = len(part)
        best: list[float | None] = [0.0] + [None] * n
        count = [0] * (n + 1)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        for at, found in self.automaton.iter(part):
            ends[at + 1].append(found)
        for i in range(1, n + 1):
            single = False
            top, pieces = None, 0
            for length, score in ends[i]:  # the longest first
                single |= length == 1
                before = best[i - length]
                if top is None or before + score > top:
                    top, pieces = before + score, count[i - length] + 1
            if not single:
                score = best[i - 1] + self.unknown
                if top is None or score > top:
                    top, pieces = score, count[i - 1] + len(part[i - 1].encode())
            best[i], count[i] = top, pieces
        return count[n]

    def __call__(self, text: str) -> int:
        if not text:
            return 0
        known, total = self.known, 0
        for part in _PART.findall(MARK + text.replace(" ", MARK)):
            n = known.get(part)
            if n is None:
                n = self.viterbi(part)
                if len(known) >= self.keep:
                    known.clear()
                if len(part) <= 64:
                    known[part] = n
            total += n
        return total


def count_tokens(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """-> doc_id, n_tokens.  `path` is the model file, read on the driver; its pieces (some ten thousand) are sent to the tasks."""
    pieces = docs.sparkSession.sparkContext.broadcast(vocabulary(path))

    def run(batches):
        counter = Counter(pieces.value)
        for batch in batches:
            n = [counter(t or "") for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64())], names=["doc_id", "n_tokens"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, n_tokens bigint")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's number of tokens."""
    return count_tokens(table(spark, sf_dir, "documents"))
