"""Toxicity: a Levenshtein automaton run over a lexicon trie, with scores by context window.

The lexicon is learned: words whose document counts in toxic and other labelled texts differ by more
than chance (likelihood ratio) with toxic ones ahead; each has its log odds as
weight.  A text's words
are read by the product of the lexicon's trie and the Levenshtein automaton: a state is a set of
(trie node, edits used) without the pairs that others make needless.  States are numbered and steps between them remembered, a
deterministic automaton that is built as words need it, so a word that leads nowhere ends after a few
characters; when it holds `KEEP_PAIRS` pairs it is begun anew.  Terms of `FUZZY` letters may be misspelled by one edit, those of `FUZZY2` by two.
A token is tried without the signs around it and, if there are signs inside, in its pieces too; tokens of any length are read.

A misspelling has the weight of its own counts, or `UNSEEN` of its term's where it was never met.

A hit counts by its window of `WINDOW` words: inside quotation marks, or next to a word that reports
speech, it counts as quoted and by `QUOTED` of its weight.  A logistic model over the sums of
exact, misspelled and quoted hits gives the score.

The lexicon has at most `max_terms` terms, of `min_length` to `max_length` letters (parameters of `score_texts`).  Learning takes at most `FIT_ROWS` labelled rows, chosen
by a hash of their id: `PARTS - 1` of `PARTS` parts for the lexicon, the rest for the logistic
model.  Only the text is scored.

Defined results: a null or empty text has the score of a text without hits; a very long text is read whole; of terms equally near
the first in order counts, and of equally strong terms at the end of the lexicon the first by name stays; null ids are carried
and not held out; labels that are null or of no document are ignored, several for one id count as
their largest; without toxic labels there is no lexicon and every score is the share of toxic labels
(0.02 without labels); repeated rows score alike; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eodlake.llm.common import cut, map_batches, table

FIT_ROWS, MAX_TERMS, PARTS, MIN_G, MIN_ODDS, UNSEEN, FUZZY, FUZZY2 = 20_000, 4000, 4, 15.0, 2.5, 0.6, 5, 9
MIN_LENGTH, MAX_LENGTH = 3, 40
WINDOW, QUOTED, CUT, KEEP, KEEP_PAIRS = 8, 0.25, 0.3, 200_000, 500_000
MODULUS, HELD_OUT = 4, 2
#: Words next to a quoted term.
REPORTS = frozenset("said says say saying called calls call wrote writes word words term terms quote quoted quotes unquote".split())
OPEN, CLOSE = "\"“„«‹'‘(", "\"”“»›'’)"
_STRIP = ".,;:!?…*_~-—–()[]{}<>|/\\\"'“”„‘’«»‹›"


_INSIDE = re.compile(f"[{re.escape(_STRIP)}]+")


def words_of(text: str) -> list[str]:
    return text.lower().split()


def readings(token: str) -> list[str]:
    """A token without the signs around it, then its pieces between signs inside."""
    bare = token.strip(_STRIP)
    pieces = _INSIDE.split(bare)
    return [bare, *(p for p in pieces if p)] if len(pieces) > 1 else [bare]


class FuzzyTrie:
    """Trie of the lexicon and the states of its product with the Levenshtein automaton."""

    def __init__(self, terms: list[str], fuzzy: int = FUZZY, fuzzy2: int = FUZZY2, keep: int = KEEP_PAIRS) -> None:
        self.children: list[dict[str, int]] = [{}]
        self.term_at: list[int] = [-1]
        self.allowed = [2 if len(t) >= fuzzy2 else 1 if len(t) >= fuzzy else 0 for t in terms]
        most: list[int] = [0]  # edits that some term below a node may have
        for number, term in enumerate(terms):
            node, edits = 0, self.allowed[number]
            most[0] = max(most[0], edits)
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.term_at.append(-1)
                    most.append(0)
                node = self.children[node][c]
                most[node] = max(most[node], edits)
            self.term_at[node] = number
        self.most, self.keep, self.letters = most, keep, frozenset(c for t in terms for c in t)
        self._begin()

    def _begin(self) -> None:
        """State 0 leads nowhere, state 1 is the start.  A state is its pairs (node and edits as one number); `step` has a dictionary per state."""
        self.numbers: dict[frozenset, int] = {frozenset(): 0}
        self.pairs: list[frozenset] = [frozenset()]
        self.step: list[dict[str, int]] = [{}]
        self.held = 0
        self._number(self._closed({0: 0}.items()))

    def _number(self, pairs: frozenset) -> int:
        n = self.numbers.get(pairs)
        if n is None:
            n = self.numbers[pairs] = len(self.pairs)
            self.pairs.append(pairs)
            self.step.append({})
            self.held += len(pairs)
        return n

    def _closed(self, state: Iterable[tuple[int, int]]) -> frozenset:
        """With the lexicon's letters left out, (node, edits used); fewer edits make more needless."""
        todo, best = list(state), {}
        while todo:
            node, used = todo.pop()
            if used > self.most[node] or best.get(node, 99) <= used:
                continue
            best[node] = used
            todo.extend((child, used + 1) for child in self.children[node].values())
        return frozenset(node << 2 | used for node, used in best.items())

    def _next(self, state: frozenset, c: str) -> frozenset:
        out = set()
        for pair in state:
            node, used = pair >> 2, pair & 3
            child = self.children[node].get(c)
            if child is not None:
                out.add((child, used))
            if used < self.most[node]:
                out.add((node, used + 1))  # a letter too many
                out.update((other, used + 1) for x, other in self.children[node].items() if x != c)
        return self._closed(out)

    def find(self, word: str) -> tuple[int, int] | None:
        """(term, edits) of the nearest term, the first of equals."""
        if self.held > self.keep:
            self._begin()
        state = 1
        for c in word:
            if c not in self.letters:
                c = ""  # all other letters lead the same way
            got = self.step[state].get(c)
            if got is None:
                got = self._number(self._next(self.pairs[state], c))
                self.step[state][c] = got
                self.held += 1
            state = got
            if not state:
                return None
        ends = ((pair & 3, self.term_at[pair >> 2]) for pair in self.pairs[state])
        found = [(used, term) for used, term in ends if term >= 0 and used <= self.allowed[term]]
        if not found:
            return None
        used, term = min(found)
        return term, used


class Scanner:
    """Sums of a text's hits: exact, misspelled, quoted (weights), and the number of words."""

    def __init__(self, lexicon: list[tuple[str, float]], misspelled: dict[tuple[int, int], float] | None = None) -> None:
        self.trie = FuzzyTrie([t for t, _ in lexicon])
        self.weights, self.misspelled = [w for _, w in lexicon], misspelled or {}
        self.known: dict[str, tuple[float, bool] | None] = {}

    def _hit(self, token: str) -> tuple[float, bool] | None:
        """The strongest hit among a token's readings."""
        hits = [h for r in readings(token) if (h := self._reading(r))]
        return max(hits, key=lambda h: (h[0], not h[1])) if hits else None

    def _reading(self, word: str) -> tuple[float, bool] | None:
        found = self.trie.find(word)
        if not found:
            return None
        term, edits = found
        if not edits:
            return self.weights[term], False
        weight = self.misspelled.get(found, UNSEEN * self.weights[term])
        return (weight, True) if weight > 0 else None

    def hits(self, tokens: list[str]) -> list[tuple[int, float, bool]]:
        known, out = self.known, []
        for i, token in enumerate(tokens):
            if token in known:
                hit = known[token]
            else:
                if len(known) >= KEEP:
                    known.clear()
                hit = self._hit(token)
                if len(token) <= 64:
                    known[token] = hit
            if hit:
                out.append((i, *hit))
        return out

    @staticmethod
    def quoted(tokens: list[str], i: int) -> bool:
        around = tokens[max(i - WINDOW, 0) : i], tokens[i + 1 : i + 1 + WINDOW]
        if any(t.strip(_STRIP) in REPORTS for t in (*around[0][-3:], *around[1][:3])):
            return True
        own = tokens[i]
        opens = own[0] in OPEN or any(t[0] in OPEN for t in around[0])
        closes = own[-1] in CLOSE or own.rstrip(".,;:!?")[-1:] in tuple(CLOSE) or any(t.rstrip(".,;:!?")[-1:] in tuple(CLOSE) for t in around[1])
        return opens and closes

    def features(self, text: str) -> list[float]:
        tokens = words_of(text)
        sums = [0.0, 0.0, 0.0]
        for i, weight, fuzzy in self.hits(tokens):
            sums[2 if self.quoted(tokens, i) else int(fuzzy)] += weight
        exact, fuzzy, quoted = sums
        return [exact + QUOTED * quoted, fuzzy]


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % MODULUS == HELD_OUT


def _fit_labels(labels: DataFrame, rows: int) -> DataFrame:
    one = labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id")))
    one = one.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(PARTS)))


def learn_lexicon(texts: DataFrame, max_terms: int = MAX_TERMS, min_length: int = MIN_LENGTH, max_length: int = MAX_LENGTH) -> list[tuple[str, float]]:
    """(text, toxic) -> terms and weights, equal texts counted once."""

    def run(batch: pa.RecordBatch) -> dict[str, list]:
        words, toxic = [], []
        for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own = {r for w in words_of(t or "") for r in readings(w)}
            words += own
            toxic += [y] * len(own)
        return {"word": words, "toxic": toxic}

    once = texts.groupBy("text").agg(F.max("toxic").alias("toxic"))
    n, n_toxic = once.select(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not n_toxic or n_toxic == n:
        return []
    seen = map_batches(once, run, "word string, toxic int").where(F.length("word").between(min_length, max_length)).groupBy("word").agg(F.sum("toxic").alias("t"), F.count("*").alias("n"))
    t, c, all_t, all_n = F.col("t").cast("double"), (F.col("n") - F.col("t")).cast("double"), float(n_toxic), float(n)
    share = (t + c) / all_n
    term = lambda x, total: F.when(x > 0, x * F.log(x / (total * share))).otherwise(0.0)
    found = (
        seen.withColumn("g", 2 * (term(t, all_t) + term(c, all_n - all_t)))
        .withColumn("w", F.log((t + 0.5) / (all_t + 1)) - F.log((c + 0.5) / (all_n - all_t + 1)))
        .where((F.col("g") >= MIN_G) & (F.col("w") > MIN_ODDS))
        .orderBy(F.desc("g"), "word")
        .limit(max_terms)
    )
    return sorted((r["word"], r["w"]) for r in found.select("word", "w").collect())


def learn_misspellings(texts: DataFrame, lexicon: list[tuple[str, float]]) -> dict[tuple[int, int], float]:
    """(term number, edits) -> weight, from the same texts as the lexicon: what is near a term by chance
    stands in other texts as often.  At most two numbers a term; those never met are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, known = FuzzyTrie([t for t, _ in lexicon]), {}
        for batch in batches:
            rows: list[tuple[int, int, int]] = []
            for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = set()
                for w in {r for w in words_of(t or "") for r in readings(w)}:
                    if w not in known:
                        if len(known) >= KEEP:
                            known.clear()
                        found = trie.find(w)
                        if len(w) <= 64:
                            known[w] = found
                    else:
                        found = known[w]
                    own.add(found)
                rows += [(*found, y) for found in own if found and found[1]]
            yield pa.record_batch([pa.array(c, pa.int32()) for c in list(zip(*rows, strict=True)) or [()] * 3], names=["term", "edits", "toxic"])

    once = texts.groupBy("text").agg(F.max("toxic").alias("toxic"))
    n, n_toxic = once.select(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    seen = once.mapInArrow(run, "term int, edits int, toxic int").groupBy("term", "edits").agg(F.sum("toxic").alias("t"), F.count("*").alias("n"))
    out = {}
    for r in seen.collect():
        odds = np.log((r["t"] + 0.5) / (n_toxic + 1)) - np.log((r["n"] - r["t"] + 0.5) / (n - n_toxic + 1))
        out[r["term"], r["edits"]] = float(min(max(odds, 0.0), lexicon[r["term"]][1])) if odds > MIN_ODDS else 0.0
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Coefficients, the constant last; slopes are not below zero, so that more hits never lower a score."""
    a = np.column_stack((x, np.ones(len(x))))
    beta = np.zeros(a.shape[1])
    if not len(y):
        beta[-1] = np.log(0.02 / 0.98)
        return beta
    beta[-1] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    penalty = np.array([ridge] * x.shape[1] + [1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        gradient = a.T @ (y - p) - penalty * beta
        hessian = (a * (p * (1 - p))[:, None]).T @ a + np.diag(penalty)
        step = np.linalg.solve(hessian, gradient)
        beta = beta + np.clip(step, -2, 2)
        beta[:-1] = np.maximum(beta[:-1], 0)
        if np.abs(step).max() < 1e-8:
            break
    return beta


def score_texts(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, max_terms: int = MAX_TERMS, min_length: int = MIN_LENGTH, max_length: int = MAX_LENGTH) -> DataFrame:
    """-> doc_id, held_out, score, predicted, exact, misspelled."""
    fit = cut(_fit_labels(labels, rows), "toxic-labels")
    texts = cut(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(F.broadcast(fit), "doc_id").select("text", "toxic", "part"), "toxic-texts")
    lexicon = learn_lexicon(texts.where("part > 0").select("text", "toxic"), max_terms, min_length, max_length)

    misspelled = learn_misspellings(texts.where("part > 0").select("text", "toxic"), lexicon) if lexicon else {}

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(lexicon, misspelled)
        for batch in batches:
            got = np.array([scanner.features(t or "") for t in batch.column(0).to_pylist()], float).reshape(-1, 2)
            yield pa.record_batch([pa.array(got[:, 0]), pa.array(got[:, 1]), batch.column(1)], names=["exact", "misspelled", "toxic"])

    seen = np.array([tuple(r) for r in texts.where("part = 0").select("text", "toxic").mapInArrow(sums, "exact double, misspelled double, toxic int").collect()], float).reshape(-1, 3)
    beta = fit_logistic(np.log1p(seen[:, :2]), seen[:, 2])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(lexicon, misspelled)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.array([scanner.features(t or "") for t in batch.column(2).to_pylist()])
            score = 1 / (1 + np.exp(-(np.log1p(x) @ beta[:-1] + beta[-1])))
            cols = [batch.column(0), batch.column(1), pa.array(score), pa.array((score >= CUT).astype(np.int32)), pa.array(x[:, 0]), pa.array(x[:, 1])]
            yield pa.record_batch(cols, names=["doc_id", "held_out", "score", "predicted", "exact", "misspelled"])

    some = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "text")
    return some.mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int, exact double, misspelled double")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity."""
    return score_texts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")
