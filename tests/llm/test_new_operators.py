"""Filter audit, collocations and token files against brute force."""

from __future__ import annotations

import json
import random
import re
import zlib
from collections import Counter
from itertools import permutations
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from eodlake.llm import audit, collocation, wavelet
from eodlake.llm.common import cut

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, part string, lang_ string, phrase string, digest string, shard int"


def documents(spark, rows):
    """Rows of (doc_id, text, lang, source) with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(*r, 1, "p", "q", "r", "s", 3) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    words = ["".join(r.choice("abcDé&") for _ in range(r.randint(1, 5))) for _ in range(60)]
    out = []
    for i in range(90):
        text = "".join(r.choice(words) + r.choice([" ", "  ", "\t", ". ", "\n", "! "]) for _ in range(r.choice([0, 2, 30, 210, 400])))
        if i % 4 == 0 and out:
            text = out[r.randrange(len(out))][1]
        out.append((i, text, r.choice(["en", "fr", None]), r.choice(["a", "b", "", None])))
    out += [(None, out[3][1], "en", "a"), (None, None, None, None), (95, None, "en", "b"), (96, "", "en", "b"), out[5], out[5], (5, out[3][1], "fr", "a")]
    out.append((97, "Long word " * 60_000, "en", "a"))
    return out


@pytest.fixture(scope="module")
def empty(spark):
    return documents(spark, [])


# 11


def brute_audit(rows, labels):
    good, toxic = ({d for d, *q in labels if d is not None and q[i] == 1} for i in (0, 1))  # a null id has no labels
    low = {}
    for d, t, *_ in rows:
        if d is not None:
            low[t or ""] = min(low.get(t or "", d), d)
    docs = []
    for d, t, _, source in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search("[#$%&*|]", t)),
            "E": d is not None and low[t] < d,
        }
        docs.append((source or "", {f for f, x in fails.items() if x}, d in good, d in toxic))
    out = {}
    for part in {p for p, *_ in docs}:
        own = [x[1:] for x in docs if x[0] == part]
        shapley = Counter()
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[0]]
                redundant = sum(f in x[0] for x in own) - len(gone)
                left = [x for x in left if f not in x[0]]
                shapley[f] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), redundant, sum(x[0] == {f} for x in own), sum(x[1] for x in gone), sum(x[2] for x in gone)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(shapley[order[step - 1]])
    return out


def test_audit(spark, rows):
    labels = [(i, i % 2, int(i % 3 == 0)) for i in range(0, 98, 2)] + [(None, 1, 1), (4, 1, 1), (10, None, None), (500, 1, 1)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {(r["part"], r["filter_order"], r["step"]): list(r)[3:] for r in audit.audit(documents(spark, rows), table).collect()}
    assert got == brute_audit(rows, labels)


def test_audit_without_rows_or_labels(spark, rows, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audit(empty, none).count() == 0
    got = audit.audit(documents(spark, rows), none).agg(F.sum("good_lost"), F.sum("toxic_lost")).first()
    assert tuple(got) == (0, 0)


def test_removal_ranks_are_the_first_failing_step():
    ranks = audit.removal_ranks()
    for mask in range(32):
        for o, order in enumerate(audit.ORDERS):
            first = [s for s, f in enumerate(order, 1) if mask >> audit.FILTERS.index(f) & 1]
            assert ranks[mask, o] == min(first, default=6)


# 12


def brute_phrases(rows, support, top):
    f, n = {}, Counter()
    for _, t, lang, _ in rows:
        lang = lang or "und"
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    key = lang, tuple(w[i : i + k])
                    f[key] = f.get(key, 0) + 1
    found = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= support}
    out = []
    for (lang, p), a in found.items():
        if any(x == lang and len(q) > len(p) and p in (q[:2], q[1:]) and 100 * b >= 50 * a for (x, q), b in found.items()):
            continue
        cuts = [(10**6 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out.append((lang, score, a, " ".join(p), f[lang, p[:k]], f[lang, p[k:]]))
    want = []
    for lang in n:
        first = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[1], -x[2], x[3].encode()))[:top]
        want += [(lang, i, p, a, left, right, n[lang], s) for i, (_, s, a, p, left, right) in enumerate(first, 1)]
    return sorted(want)


@pytest.mark.parametrize(("support", "top", "block", "rows_a_bucket"), [(10, 2000, 8 << 20, 1 << 18), (3, 7, 400, 50)])
def test_collocations(spark, rows, support, top, block, rows_a_bucket, monkeypatch):
    monkeypatch.setattr(collocation, "BUCKET_ROWS", rows_a_bucket)
    plain = collocation.blocks
    monkeypatch.setattr(collocation, "blocks", lambda docs: plain(docs, block))
    got = collocation.collocations(documents(spark, rows), support, top).collect()
    assert sorted(tuple(r) for r in got) == brute_phrases(rows, support, top)
    assert got


def test_collocations_of_nothing(spark, empty):
    assert collocation.collocations(empty).count() == 0
    assert collocation.collocations(documents(spark, [(1, None, None, None), (2, ". . ?", "en", "s")])).count() == 0


def test_support_is_lowered_exactly(spark):
    """A phrase that stands five times in each of two equal shards is found; so are all at other shares."""
    for a, b in ((5, 5), (3, 7), (49, 1), (1, 6)):
        parts = [(1, "en", 0, a * 30), (2, "en", 1, b * 30)]
        got = {r["shard"]: r["support"] for r in collocation.lowered_supports(spark.createDataFrame(parts, "block long, lang string, shard int, n_words long"), 10).collect()}
        assert got == {0: -(-10 * a // (a + b)), 1: -(-10 * b // (a + b))}
    none = spark.createDataFrame([(1, "en", 0, 0)], "block long, lang string, shard int, n_words long")
    assert collocation.lowered_supports(none, 10).first()["support"] == 1


def test_one_shard_reaches_its_share(spark, rows):
    """What the first pass names holds all frequent phrases, and little else."""
    made = cut(collocation.blocks(documents(spark, rows), 300), "blocks")
    assert made.select("shard").distinct().count() == collocation.SHARDS
    assert max(r["n"] for r in made.selectExpr("length(text) AS n").collect()) < 5000
    named = collocation.candidates(spark, made, 10)
    counted = collocation.exact_counts(made, named, 10)
    low = collocation.exact_counts(made, collocation.candidates(spark, made, 1), 10)  # every phrase is a candidate
    assert sorted(map(tuple, counted.collect())) == sorted(map(tuple, low.collect()))


def test_scores_pass_64_bits(spark):
    big = 3 * 10**14
    rows = [("en", "a", 1, big), ("en", "b", 1, big + 7), ("en", "a b", 2, big - 5), ("en", "c", 1, 10**15), ("en", "b c", 2, 10), ("en", "a b c", 3, 10)]
    got = {r["phrase"]: tuple(r)[2:] for r in collocation.scored(spark.createDataFrame(rows, "lang string, phrase string, k int, n long")).collect()}
    assert got == {"a b": (big - 5, big, big + 7, 10**6 * (big - 5) ** 2 // (big * (big + 7))), "a b c": (10, big - 5, 10**15, 0)} or got["a b c"][1:3] == (big, 10)
    assert "b c" not in got


# 13


@given(st.lists(st.integers(0, 70), max_size=300), st.integers(0, 75), st.integers(0, 300), st.integers(0, 300))
@settings(max_examples=60, deadline=None)
def test_matrix(tokens, token, lo, hi):
    x = np.array(tokens, np.int64)
    m = wavelet.ShardFile.from_bytes(wavelet.ShardFile([1], np.array([len(x)]), wavelet.WaveletMatrix.build(x, 7)).to_bytes()).matrix
    assert m.tokens().tolist() == tokens and m.access(np.arange(len(x))).tolist() == tokens
    lo, hi = sorted((min(lo, len(x)), min(hi, len(x))))
    where = [i for i, t in enumerate(tokens) if t == token]
    assert m.places(token).tolist() == where and m.places(token, lo, hi).tolist() == [i for i in where if lo <= i < hi]
    assert m.count(token) == len(where) and m.rank(token, hi) == sum(i < hi for i in where)
    assert [m.select(token, k) for k in range(len(where))] == where
    with pytest.raises(IndexError):
        m.select(token, len(where))


ODD_TEXTS = [None, "", "It's  the END of 12 á ΑΣ. <|endoftext|>x'LL", "é\ńx \x1c\x85y", '"quoted" "', "x" * 5000, "<|startoftext|> <|endoftext|>", "漢字かな😀 ﬁ İ"]


def brute_files(rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(wavelet.default_tokenizer())
    ids = [(d, t.encode(x or "", add_special_tokens=False).ids + [1]) for d, x, *_ in rows]
    return [(d, len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for d, i in ids]


@pytest.mark.parametrize("shard_tokens", [300, 1 << 21])
def test_token_files(spark, rows, shard_tokens):
    rows = [*rows, *((200 + i, t, "en", "s") for i, t in enumerate(ODD_TEXTS)), (-4, "below zero", "en", "s")]
    got = wavelet.roundtrip(documents(spark, rows), shard_tokens=shard_tokens).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, r[1:])
    assert sorted(((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got), key=key) == sorted(brute_files(rows), key=key)
    order = sorted(got, key=lambda r: (r["start"]))
    assert [r["doc_id"] is not None for r in order] == sorted(r["doc_id"] is not None for r in order)
    ids = [r["doc_id"] for r in order if r["doc_id"] is not None]
    assert ids == sorted(ids)
    at = 0
    for r in order:
        assert r["start"] == at
        at += r["n_tokens"]


def test_files_answer_without_a_whole_read(spark, tmp_path):
    docs = documents(spark, [(i, f"a{'b' * (i % 3)} the end {i}", "en", "s") for i in range(50)])
    files = wavelet.write_shards(docs, str(tmp_path / "ids"), shard_tokens=60).collect()
    assert len(files) > 3 and sorted(p.name for p in (tmp_path / "ids").iterdir()) == sorted(r["file_name"] for r in files)
    assert sum(r["n_docs"] for r in files) == 50
    total = 0
    for r in files:
        shard = wavelet.ShardFile.from_bytes((tmp_path / "ids" / r["file_name"]).read_bytes())
        ends = shard.matrix.places(wavelet.END)
        assert ends.tolist() == (np.cumsum(shard.lengths) - 1).tolist()
        total += len(ends)
    assert total == 50


def encoder(**changes):
    model = json.loads(Path(wavelet.default_tokenizer()).read_text()) | changes
    return wavelet.Encoder(json.dumps(model))


@pytest.fixture(scope="module")
def known_encoder():
    return encoder()


ODD_PARTS = [*"abEsTmdrevl''\"<|!.-  \t\n\x0b\x1c\x00\x7f019éÉßẞÞÿ×÷ª½ņ\u0301\u0307\x85\xa0漢ΣςİKſ😀—“٣", "<|endoftext|>", "<|", "'ll", "'re", "The"]


@given(st.lists(st.lists(st.sampled_from(ODD_PARTS), max_size=30).map("".join), max_size=5))
@settings(max_examples=300, deadline=None)
def test_encoder(known_encoder, texts):
    want = [[*known_encoder.tokenizer.encode(t, add_special_tokens=False).ids, wavelet.END] for t in texts]
    assert [x.tolist() for x in known_encoder([t.encode() for t in texts])] == want


def test_plain_pieces_are_learned_once_and_without_the_normalizer(monkeypatch):
    e = encoder()
    text = "été, Été. (ÉTÉ) It's «it»"
    want = [*e.tokenizer.encode(text, add_special_tokens=False).ids, wavelet.END]
    asked, whole = [], e.tokenizer

    class Asked:
        def encode_batch_fast(self, texts, **options):
            asked.extend(texts)
            return whole.encode_batch_fast(texts, **options)

    e.tokenizer = Asked()
    assert [x.tolist() for x in e([text.encode()])] == [want]
    assert asked == ["«it»"]
    assert {k.decode() for k in e.number} == {" ", "été", ",", ".", "(", ")", "it", "'s", "«it»"}
    monkeypatch.setattr(wavelet, "KEEP", 10)  # what is kept is forgotten and learned anew
    assert [x.tolist() for x in e([text.encode(), b"new words", text.encode()])][::2] == [want, want]


def test_another_tokenizer_is_given_whole_texts():
    e = encoder(normalizer=None)
    texts = ["Upper Case it's", "", "Éa É\u0301"]
    assert [x.tolist() for x in e([t.encode() for t in texts])] == [[*e.tokenizer.encode(t, add_special_tokens=False).ids, wavelet.END] for t in texts]


def test_token_files_of_nothing(empty):
    assert wavelet.roundtrip(empty).count() == 0


def test_starts_are_summed_in_runs(spark, monkeypatch):
    monkeypatch.setattr(wavelet, "RUN", 3)
    r = random.Random(1)
    files = [(f"{p:09d}-{i:06d}.wavm", r.randrange(100)) for p in range(20) if p % 4 for i in range(p % 3 + 1)]
    got = {x["file_name"]: x["start"] for x in wavelet.file_starts(spark.createDataFrame(files, "file_name string, n_tokens long")).collect()}
    at = 0
    for name, n in sorted(files):
        assert got[name] == at
        at += n
