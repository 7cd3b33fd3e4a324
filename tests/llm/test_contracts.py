"""Each operator against brute force, on a small corpus with edges, ties, repeated and odd rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from eodlake.llm import decontaminate, fingerprint, licenses, mixing, quality, simhash, suffix_dedup, tokens, toxicity, url_filter
from eodlake.llm.common import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(n=120, seed=1):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefgé") for _ in range(r.randint(1, 9))) for _ in range(300)]
    passage = " ".join(r.choice(words) for _ in range(60))
    rows = []
    for i in range(n):
        text = " ".join(r.choice(words) for _ in range(r.choice([0, 1, 3, 40, 90])))
        if i % 5 == 0:
            text += "\n" + passage + "\t" + text
        if i % 7 == 0 and rows:
            text = rows[r.randrange(len(rows))][1] or ""
        if i % 11 == 0:
            text += " All rights reserved. Licensed under CC BY-NC 4.0."
        if i % 13 == 0:
            text += "The " * 80
        rows.append((i, text, "en", f"s{i % 4}", len(text)))
    rows += [(n, None, None, None, None), (n + 1, "", "en", None, 0), (n + 2, "x", "en", "s0", 1), (n + 3, "É😀 " * 40, "fr", "s1", 120)]
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids, rows repeated whole, ids repeated with other texts."""
    rows = [(None, "a b c d e f", "en", None, 1), (None, None, None, None, None), (1, "a b c d e f", "en", "s", 1), (1, "a b c d e f", "en", "s", 1), (1, "z y x w v", "en", "s", 1)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# 1

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def ascii_lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def test_licenses(docs, rows):
    got = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
    templates = licenses.make_templates()
    for i, t, *_ in rows:
        w = WORDS.findall(ascii_lower(t))
        places, base = [], set()
        for phrase, label in licenses.BASE:
            p = phrase.split()
            found = [k for k in range(len(w)) if w[k : k + len(p)] == p]
            places += found
            base |= {label} if found else set()
        labels, score = set(base), 1.0 if base else 0.0
        for x in templates:
            for k in range(0, len(w), x.block // 2):
                share = len({b.decode() for b in x.tokens} & set(w[k : k + x.block])) / len(x.tokens)
                if not x.phrase and share >= x.threshold - 1e-9:
                    labels.add(x.label)
                    score = max(score, share)
        g = got[i]
        assert (g["n_words"], g["n_base"], g["first_word"], g["last_word"]) == (len(w), len(places), min(places, default=None), max(places, default=None))
        assert (g["base_labels"], g["labels"], g["score"]) == (",".join(sorted(base)), ",".join(sorted(labels)), score)


def test_whole_license_texts(spark):
    """Anywhere in a text, with a sixth of the words left out; half of them aren't enough."""
    r = random.Random(2)
    rows, want = [], {}
    for n, (text, label) in enumerate(t for t in licenses.TEMPLATES if len(t[0].split()) > 40):
        w = text.split()
        tokens = sorted(set(WORDS.findall(ascii_lower(text))))
        for m, share in enumerate((0, 0.15, 0.5)):
            gone = set(r.sample(tokens, int(share * len(tokens))))
            some = [x for x in w if not gone & set(WORDS.findall(ascii_lower(x)))]
            noise = [f"n{r.randrange(9999)}" for _ in range(r.randrange(700))]
            rows.append((10 * n + m, " ".join([*noise, *some, *noise]), "en", "s", 0))
            want[10 * n + m] = label, share
    for x in licenses.scan(spark.createDataFrame(rows, SCHEMA)).collect():
        label, share = want[x["doc_id"]]
        if share == 0:
            assert label in x["labels"].split(",") and x["score"] == 1.0
        if share == 0.15 and x["score"] >= 0.8:
            assert label in x["labels"].split(",")
        if share == 0.5:
            assert label not in {s["label"] for s in x["spans"] if s["last"] - s["first"] > 64}


def test_licenses_odd(odd, empty):
    got = licenses.scan(odd.selectExpr("*", "1 AS words", "2 AS labels")).collect()
    assert sorted((r["doc_id"] or 0, r["n_words"], r["labels"]) for r in got) == [(0, 0, ""), (0, 6, ""), (1, 5, ""), (1, 6, ""), (1, 6, "")]
    assert licenses.scan(empty).count() == 0


def test_license_words_are_ascii_rules():
    assert licenses.words_of("ÀB cd_9 É\u00a0x\x7fy".encode()) == [x.encode() for x in WORDS.findall(ascii_lower("ÀB cd_9 É\u00a0x\x7fy"))]


# 2


def brute_simhash(t, n=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(t))
    s = [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] if len(w) >= n else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, linked):
    low = dict.fromkeys(ids)
    low = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            m = min(low[a], low[b])
            if low[a] != m or low[b] != m:
                low[a] = low[b] = m
                changed = True
    return low


def test_simhash_components(docs, rows):
    fp = {i: brute_simhash(t) for i, t, *_ in rows}
    ids = sorted(fp)
    linked = [(a, b) for a in ids for b in ids if a < b and (fp[a] ^ fp[b]).bit_count() <= 4]
    low = brute_components(ids, linked)
    got = {r["doc_id"]: (r["fp"][0] % (1 << 64), r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    assert got == {i: (fp[i], low[i]) for i in ids}


@pytest.mark.parametrize("words", [1, 2])
@pytest.mark.parametrize("radius", [3, 4, 7, 17])
@pytest.mark.parametrize(("n", "flips"), [(50, 4), (700, 6), (1500, 3), (300, 40)])
def test_bit_sliced_links_span_components(words, radius, n, flips):
    r = np.random.default_rng(n)
    f = r.integers(0, 2**63, (3, words), dtype=np.uint64)[r.integers(0, 3, n)]
    for _ in range(flips):
        f ^= np.uint64(1) << r.integers(0, 64, f.shape).astype(np.uint64)
    f = np.unique(f, axis=0)
    a, b = simhash.linked(f, np.zeros(len(f), int), radius)
    far = np.bitwise_count(f[:, None] ^ f[None, :]).sum(2)
    assert (far[a, b] <= radius).all()
    x, y = np.nonzero(far <= radius)
    assert (simhash._spanning(a, b, len(f)) == simhash._spanning(x, y, len(f))).all()


def test_tiles_lose_no_link(spark):
    r = random.Random(5)
    base = r.getrandbits(64)
    fps = {base}
    while len(fps) < 120:
        x = r.choice(sorted(fps))
        fps.add(x ^ 1 << r.randrange(64) ^ 1 << r.randrange(64))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    nodes = spark.createDataFrame([([signed(x)], i) for i, x in enumerate(sorted(fps))], "fp array<long>, id long")
    got = {r["node"]: r["component"] for r in components(simhash.links(nodes, tile=8)).collect()}
    assert got == dict.fromkeys(range(120), 0)


def test_stage_drops_near_copies_only(spark):
    r = random.Random(12)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    rows, near = [], set()
    for i in range(60):
        w = [word() for _ in range(150)]
        rows.append((i, " ".join(w)))
        if i % 3 == 0:
            w[r.randrange(150)] = "changed"
            near.add(1000 + i)
            rows.append((1000 + i, " ".join(w)))
    kept = {x["doc_id"] for x in simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept >= set(range(60)) and len(kept) <= 62  # one word of 150 changed: similarity 0.93, of which a few pass
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    fps = {x["doc_id"]: x["fp"] for x in simhash.fingerprints(docs, 5, (42, 43)).collect()}
    bits = lambda a, b: sum(((x ^ y) & (1 << 64) - 1).bit_count() for x, y in zip(fps[a], fps[b], strict=True))
    linked = [(a, b) for a in fps for b in fps if a < b and bits(a, b) <= 17]
    got = {x["doc_id"]: x["component_id"] for x in simhash.near_duplicates(docs, 5, 17, (42, 43), 8, 10).collect()}
    assert got == brute_components(sorted(fps), linked)


@pytest.mark.parametrize("group", [1, 30])
def test_stage_is_exact_at_its_threshold(spark, group, monkeypatch):
    monkeypatch.setattr(simhash, "PART_ROWS", 1 << 9)
    r = random.Random(21)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    common, rows = [word() for _ in range(40)], [(500, None), (501, " "), (502, "two words"), (503, "Two WORDS"), (504, "two word")]
    for i in range(40 // group + 1):
        w = [word() for _ in range(r.choice([20, 120, 300]))] + common
        rows.append((1000 * i, " ".join(w)))
        for j in range(1, 1 + max(2, group)):  # similarities about 0.8
            x = list(w)
            for at in r.sample(range(len(x)), max(1, round(len(x) * r.uniform(0.005, 0.04)))):
                x[at] = word()
            rows.append((1000 * i + j, " ".join(x)))
    sets = {i: {" ".join(w[k : k + 5]) for k in range(max(len(w) - 4, min(len(w), 1)))} for i, w in ((i, (t or "").lower().split()) for i, t in rows)}
    alike = lambda a, b: a == b or len(a & b) >= 0.8 * len(a | b)
    low = brute_components(sorted(sets), [(a, b) for a in sets for b in sets if a < b and alike(sets[a], sets[b])])
    got = {x["doc_id"] for x in simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i for i in low if low[i] == i}


def test_block_plan_keeps_buckets_small():
    assert simhash.block_plan(10_000) == 6
    for n in (1 << 20, 1 << 28, 1 << 36):
        blocks = simhash.block_plan(n)
        assert n / 2 ** (64 * (blocks - 4) / blocks) < 64


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(0, 200)] + [(1000, 1001), (1001, 1001), (1001, 1000)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == dict.fromkeys(range(201), 0) | {1000: 1000, 1001: 1000}


def flipped(text_bits):
    """A fingerprint with some bits of a base flipped."""
    return int(np.int64(np.uint64(0x0123456789ABCDEF ^ text_bits)))


def test_rows_of_a_null_id_link(spark, monkeypatch):
    """A to B 3 bits, B to C 4 bits, A to C 5 bits: B holds them together with an id or without; what only null ids reach has none."""
    a, b, c = 0, 0b111, 0b111101
    assert [(x ^ y).bit_count() for x, y in ((a, b), (b, c), (a, c))] == [3, 4, 5]
    rows = [(1, a), (None, b), (3, c), (None, 0xFFFF << 40), (None, (0xFFFF << 40) ^ 1), (9, 0xFF << 20), (None, (0xFF << 20) ^ 0b11), (7, (0xFF << 20) ^ 0b1111), (None, 0b111)]
    fps = spark.createDataFrame([(i, [flipped(x)]) for i, x in rows], "doc_id long, fp array<long>")
    monkeypatch.setattr(simhash, "fingerprints", lambda *_: fps)
    got = Counter((r["doc_id"], r["fp"][0], r["component_id"]) for r in simhash.near_duplicates(None).collect())
    assert got == Counter(zip([i for i, _ in rows], [flipped(x) for _, x in rows], smallest_linked(rows), strict=True))
    assert {k[2] for k in got if k[0] == 3} == {1} and sum(n for k, n in got.items() if k[2] is None) == 2


def smallest_linked(rows, radius=4):
    low = list(range(len(rows)))

    def top(i):
        while low[i] != i:
            i = low[i]
        return i

    for i, (_, x) in enumerate(rows):
        for j, (_, y) in enumerate(rows[:i]):
            if (x ^ y).bit_count() <= radius:
                low[top(i)] = top(j)
    ids = [[d for k, (d, _) in enumerate(rows) if top(k) == top(i) and d is not None] for i in range(len(rows))]
    return [min(x) if x else None for x in ids]


@pytest.mark.parametrize("seed", range(2))
def test_null_ids_against_brute_force(spark, monkeypatch, seed):
    r = random.Random(seed)
    rows, ids = [], iter(r.sample(range(1000), 300))
    for _ in range(40):
        x = r.getrandbits(64)
        for _ in range(r.randint(1, 6)):
            rows.append((r.choice([None, next(ids)]), x))
            for _ in range(r.randint(0, 4)):
                x ^= 1 << r.randrange(64)
    fps = spark.createDataFrame([(i, [int(np.uint64(x).astype(np.int64))]) for i, x in rows], "doc_id long, fp array<long>")
    monkeypatch.setattr(simhash, "fingerprints", lambda *_: fps)
    got = Counter((r["doc_id"], int(np.int64(r["fp"][0]).astype(np.uint64)), r["component_id"]) for r in simhash.near_duplicates(None).collect())
    assert got == Counter((d, x, c) for (d, x), c in zip(rows, smallest_linked(rows), strict=True))


def test_simhash_odd_rows(odd, empty):
    got = sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in simhash.near_duplicates(odd).collect())
    assert got == [(0, 0), (0, 1), (1, 1), (1, 1), (1, 1)]
    assert simhash.near_duplicates(empty).count() == 0
    assert sorted(r["doc_id"] or 0 for r in simhash.keep_first(odd.where("text like 'a%'")).collect()) == [0, 1]


# 3


def brute_judge(url, listed):
    if not url or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = ascii_lower(host)
    fit = [(h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule, verdict = max(fit, key=lambda x: len(x[0]), default=(None, "block" if host in listed else "allow"))
    return host, path, rule, verdict


URLS = [
    "http://a.example.com/en/7x?y", "https://EXAMPLE.com/en/1", "http://xcom/en/1", "ftp://b.net/de/8", "http://q.example.net/de/8/z#f", "http://example.net/de/", "http://a.org/es", "http://a.org/es/",
    "no url", "", None, "http://", "http://?q://r.com/en/", "http://listed.info/x", "http://sub.listed.info/x", "x://a.org/es/1\nz", "http://a.com/en/7", "a://com/en/", "http://com./en/",
]


@pytest.mark.parametrize("bits", [url_filter.MAX_BITS, 64])
def test_url_rules(spark, bits, monkeypatch):
    build = url_filter.Cascade.build.__func__
    monkeypatch.setattr(build, "__defaults__", (bits,))
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(URLS)] + [(0, URLS[0], "again")], "page_id long, url string, html string")
    listed = spark.createDataFrame([("listed.info",), ("other.info",), *((f"x{i}.info",) for i in range(200))], "host string")
    for some in (listed, None):
        names = {"listed.info"} if some else set()
        got = sorted((r["page_id"], r["host"], r["path"], r["rule"] or "", r["verdict"]) for r in url_filter.judge(pages.withColumn("host", pages["html"]).withColumn("shard", pages["html"]), listed_hosts=some).collect())
        want = sorted((i, h, p, r or "", v) for i, u in [*enumerate(URLS), (0, URLS[0])] for h, p, r, v in [brute_judge(u, names)])
        assert got == want


@pytest.mark.parametrize(("every", "bits"), [(7, url_filter.MAX_BITS), (2000, 1024), (2, 256), (1, 64)])
def test_cascade_is_exact(spark, every, bits):
    keys = spark.range(20000 if every == 2000 else 3000).selectExpr("concat('k', id) AS key", f"id % {every} = 0 AS listed")
    cascade = url_filter.Cascade.build(keys, bits)
    assert cascade.levels and (cascade.shards > 1) == (bits < 1024)  # ten keys among 20,000 stay one small cascade
    assert cascade.marked(keys, keys["key"], "found").where("found <> listed").count() == 0


def test_full_shards_fill_in_pages(spark):
    """Several shards of many words each, against bits set one by one."""
    level = url_filter.Level(1 << 20, 2, 5)
    keys = spark.range(300_000).selectExpr("concat('k', id) AS key", "cast(id % 2 AS int) AS shard")
    filled = {r["shard"]: np.array(r["l5"], np.int64).view(np.uint64) for r in level.fill(keys).collect()}
    want = {s: np.zeros(1 << 14, np.uint64) for s in (0, 1)}
    for r in keys.select("shard", F.array(*level.positions(F.col("key"))).alias("p")).toPandas().itertuples():
        for p in r.p:
            want[r.shard][p >> 6] |= np.uint64(1) << np.uint64(p & 63)
    assert all(np.array_equal(filled[s], want[s]) for s in want)


def test_cascade_of_no_listed_keys(spark):
    cascade = url_filter.Cascade.build(spark.range(5).selectExpr("cast(id as string) AS key", "false AS listed"))
    assert cascade.marked(spark.range(5).selectExpr("cast(id as string) AS key"), F.col("key"), "found").where("found").count() == 0


def test_urls_empty(spark):
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


# 4


def brute_repeats(rows, length=100):
    seen, out = set(), {}
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if b[p : p + length] in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(b[p : p + length])
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        out[i] = len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()
    return out


@pytest.mark.parametrize("split", [4096, 2])
@pytest.mark.parametrize("parts", [1 << 19, 40])
def test_repeats(docs, rows, split, parts, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SPLIT", split)
    monkeypatch.setattr(suffix_dedup, "PART_RUNS", parts)
    monkeypatch.setattr(suffix_dedup, "PART_BYTES", parts * 32)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.repeats(docs).collect()}
    assert got == brute_repeats([(i, t) for i, t, *_ in rows])


def test_repeats_of_odd_rows(spark, empty):
    rows = [(2, "x" * 130), (2, "x" * 130), (None, "y" + "x" * 120), (3, None), (1, "x" * 99)]
    got = sorted((r["doc_id"] or 9, r["n_removed"]) for r in suffix_dedup.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 0), (2, 129), (2, 129), (3, 0), (9, 120)]
    assert suffix_dedup.repeats(empty).count() == 0 and suffix_dedup.without_repeats(empty).count() == 0


def test_trie_finds_equal_places():
    r = random.Random(2)
    for _ in range(40):
        runs = [bytes(r.choice(b"ab") for _ in range(r.choice([20, 21, 40]))) for _ in range(6)]
        some = [(r.choice(runs), r.randrange(3)) for _ in range(30)]
        sizes = np.array([len(x) for x, _ in some])
        order = np.argsort([g for _, g in some], kind="stable")
        late = suffix_dedup.equal_runs(b"".join(some[i][0] for i in order), np.cumsum(sizes[order]) - sizes[order], sizes[order] - 19, np.array([some[i][1] for i in order]), 20)
        assert late.tolist() == [some[i] in [some[j] for j in order[:k]] for k, i in enumerate(order)]
    for _ in range(60):
        buf = bytes(r.choice(b"ab") for _ in range(60)) * 2
        places = [p for p in range(80) if buf[p : p + 3] == buf[0:3]]
        got = suffix_dedup._trie_order(buf, places, 20, 3)
        assert [i for same in got for i in same] == sorted(range(len(places)), key=lambda i: buf[places[i] : places[i] + 20])
        assert sorted(i for same in got for i in same[1:]) == [i for i, p in enumerate(places) if buf[p : p + 20] in {buf[q : q + 20] for q in places[:i]}]


@pytest.mark.parametrize("letters", [b"a", b"ab", b"abcdefgh \x00\xff"])
def test_suffixes_come_in_order(letters):
    """Quicksort to the shallow depth and tries below it give the order of a plain sort, in every group."""
    r = random.Random(len(letters))
    for size in (0, 1, 2, 300, 3000):
        buf = bytes(r.choice(letters) for _ in range(size // 3)) * 3 + bytes(r.choice(letters) for _ in range(120))
        places = np.arange(len(buf) - 100) if size else np.zeros(0, np.int64)
        r.shuffle(places)
        group = np.array([r.randrange(4) for _ in places], np.int64)
        keys = [np.array([int.from_bytes(buf[p + d : p + d + 8], "big") for p in places.tolist()], np.uint64) for d in (0, 8)]
        order, late = suffix_dedup.deep_shallow(buf, places, group, np.full(len(places), 100), keys)
        text = [(int(g), buf[p : p + 100]) for p, g in zip(places.tolist(), group.tolist(), strict=True)]
        assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i])
        met, want = set(), []
        for x in text:
            want.append(x in met)
            met.add(x)
        assert late.tolist() == want


def test_long_text_is_split_to_segments(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 500)
    r = random.Random(3)
    part = "".join(r.choice("abcdef") for _ in range(700))
    rows = [(1, part + "z" + part), (2, part[100:600] + "q" * 300)]
    got = {x["doc_id"]: (x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) for x in suffix_dedup.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_repeats(rows)


def test_texts_without_repeats(spark):
    long = "é" * 80
    rows = [(1, long, 80, "a", 1, 2), (2, "b" + long + "c", 82, "a", 1, 2), (3, long, 80, "a", 1, 2), (4, None, None, "a", 1, 2)]
    got = {r["doc_id"]: r for r in suffix_dedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string, n_chars long, d string, spans long, own long")).collect()}
    assert 3 not in got and got[1]["text"].startswith("é") and got[2]["text"] == "bc" and got[2]["n_chars"] == 2 and got[4]["text"] is None


# 5


def library():
    from tokenizers import Tokenizer, models

    voc = tokens.vocabulary()
    return Tokenizer(models.Unigram([(a, b) for a, b, ok in voc if ok or a == "<unk>"], unk_id=0, byte_fallback=False)), voc


def test_token_counts(docs, rows):
    lib, voc = library()
    counter = tokens.Counter(voc)
    got = {r["doc_id"]: r["n_tokens"] for r in tokens.count_tokens(docs).collect()}
    for i, t in [*((i, t) for i, t, *_ in rows), (None, "日本 語\ttab  ééé   x\n\n 😀😀 zz"), (None, " a  b "), (None, "▁▁ x")]:
        n = 0
        if t:
            text = tokens.MARK + t.replace(" ", tokens.MARK)
            e = lib.encode(text)
            n = sum(len(text[a:b].encode()) if k == 0 else 1 for k, (a, b) in zip(e.ids, e.offsets, strict=True))
        assert (counter(t) if t else 0) == n
        assert i is None or got[i] == n


def test_token_counts_odd(odd, empty):
    got = tokens.count_tokens(odd.selectExpr("*", "1 AS n_tokens")).collect()
    assert sorted((r["doc_id"] or 0, r["n_tokens"] > 0) for r in got) == [(0, False), (0, True), (1, True), (1, True), (1, True)]
    assert tokens.count_tokens(empty).count() == 0


def test_token_cache_is_bounded():
    counter = tokens.Counter([("▁a", -1.0, True), ("b", -2.0, True), ("▁ab", -3.0, True), ("a", -1.0, True), ("▁", -1.0, True)], keep=2)
    assert [counter(x) for x in ("ab", "a b", "abab", "bbb bb ab")] == [1, 3, 3, 8]
    assert len(counter.known) <= 2


# 6


def lev(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        c = [i]
        for j, y in enumerate(b, 1):
            c.append(min(p[j] + 1, c[-1] + 1, p[j - 1] + (x != y)))
        p = c
    return p[-1]


def test_automaton_against_distances():
    r = random.Random(3)
    terms = sorted({"".join(r.choice("abc") for _ in range(r.randint(3, 10))) for _ in range(40)})
    trie = toxicity.FuzzyTrie(terms, keep=3000)  # begun anew now and then
    for _ in range(1500):
        w = "".join(r.choice("abcd") for _ in range(r.randint(0, 11)))
        want = min(((lev(w, t), i) for i, t in enumerate(terms) if lev(w, t) <= trie.allowed[i]), default=None)
        got = trie.find(w)
        assert (got and (got[1], got[0])) == want


def test_quotes_lower_a_hit():
    s = toxicity.Scanner([("idiot", 4.0), ("worthless", 4.0)])
    assert s.features("you idiot") == [4.0, 0.0]
    assert s.features('he said "you idiot" there') == [4.0 * toxicity.QUOTED, 0.0]
    assert s.features("wrthless, idiott!")[1] > 0 and s.features("") == [0.0, 0.0]


def test_tokens_of_any_length_and_signs():
    s = toxicity.Scanner([("idiot", 4.0), ("worthless", 5.0)])
    for text in ("!" * 61 + "idiot", "idiot" + "." * 60, "idiot/idiot", "(an/idiot)", "\u2019idiot\u2019s"):
        assert s.features(text)[0] > 0, text
    assert s.features("x" * 5000) == [0.0, 0.0] and s.features("x" * 100 + "/idiot")[0] == 4.0
    assert toxicity.readings("--a/b--") == ["a/b", "a", "b"]


def test_automaton_stays_small():
    r = random.Random(8)
    terms = sorted({"".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(4, 14))) for _ in range(1500)})
    trie = toxicity.FuzzyTrie(terms, keep=50_000)
    most = 0
    for _ in range(300):
        trie.find("".join(r.choice("abcdefghijklmnopqrst") for _ in range(r.randint(3, 12))))
        most = max(most, trie.held)
    assert most < 50_000 + 12 * 2 * len(trie.children)


def toxic_corpus(n=900, seed=4):
    r = random.Random(seed)
    words = ["".join(r.choice("bcdfglmnrst") for _ in range(r.randint(3, 8))) for _ in range(200)]
    rows, labels = [], []
    for i in range(n):
        w = [r.choice(words) for _ in range(r.randint(15, 60))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(3):
                w.insert(r.randrange(len(w)), r.choice(["idiot", "trash", "worthless", "pathetic", "idiott", "wortless"]))
        rows.append((i, " ".join(w), "en", "s", 0))
        if i % 4:
            labels.append((i, 1, int(toxic)))
    return rows, labels


def test_toxicity(spark, empty):
    rows, labels = toxic_corpus()
    docs, marks = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([*labels, (None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score_texts(docs, marks).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for i, r in got.items())
    held = [i for i in got if got[i]["held_out"]]
    right = sum(got[i]["predicted"] == int(i % 6 == 0) for i in held)
    assert right / len(held) > 0.97
    other = spark.createDataFrame([(i, q, 1 - t) if zlib.crc32(str(i).encode()) % 4 == 2 else (i, q, t) for i, q, t in labels], "doc_id long, quality int, toxic int")
    again = {r["doc_id"]: r["score"] for r in toxicity.score_texts(docs, other).collect()}
    assert again == {i: r["score"] for i, r in got.items()}  # held-out labels are never read


def test_toxicity_without_labels(spark, docs, odd, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["predicted"] for r in toxicity.score_texts(odd, none).collect()} == {0}
    assert toxicity.score_texts(empty, none).count() == 0


# 7


def quality_corpus(n=300, seed=6):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(120)]
    rows, labels = [], []
    for i in range(n):
        w = [r.choice(words) for _ in range(r.randint(20, 80))]
        bad = i % 5 == 0
        text = " ".join(f"{x}%%%" if i % 2 else f"{x.upper()}!!" for x in w) if bad else " ".join(w) + "."
        rows.append((i, text, "en", "s", 0))
        if i % 3:
            labels.append((i, int(not bad), 0))
    return rows, labels


def brute_ngrams(text):
    """Buckets with plain numbers: words and signs, then pairs of neighbours."""
    h = [zlib.crc32(m.group().encode("latin-1")) for m in re.finditer("[0-9A-Za-z\x80-\xff]+|[^\x00-\x200-9A-Za-z\x7f-\xff]+", text.encode().decode("latin-1"))]
    pairs = [1 if x == y else (x * 0x9E3779B1 + y) % 2**64 for x, y in zip(h, h[1:], strict=False)]
    out = []
    for v in [*h, *(x ^ 1 << 40 for x in pairs)]:
        v = (v ^ v >> 29) * 0xBF58476D1CE4E5B9 % 2**64
        out.append((v ^ v >> 32) % quality.BUCKETS)
    return out


def test_quality(spark):
    rows, labels = quality_corpus()
    docs, marks = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    is_good = {i for i, q, _ in labels if q}
    part = {r["doc_id"]: r["p"] for r in docs.selectExpr("doc_id", f"pmod(xxhash64(doc_id, 1), {quality.PARTS}) AS p").collect()}
    model = {i for i in is_good if part[i]}
    grams = {i: brute_ngrams(t) for i, t, *_ in rows}
    raw, good = Counter(x for g in grams.values() for x in g), Counter(x for i in model for x in grams[i])
    share = lambda c, x: (c[x] + 1) / (c.total() + quality.BUCKETS)
    weight = {i: sum(np.log(share(good, x) / share(raw, x)) for x in g) for i, g in grams.items()}
    mean = {i: weight[i] / len(grams[i]) for i in grams}
    got = {r["doc_id"]: r for r in quality.weigh(docs, marks).collect()}
    assert all(got[i]["n_grams"] == len(grams[i]) and abs(got[i]["log_weight"] - weight[i]) < 1e-6 and abs(got[i]["mean"] - mean[i]) < 1e-9 for i in grams)
    kept = {i for i, r in got.items() if r["kept"]}
    seen, bad = [mean[i] for i in is_good - model], [mean[i] for i, q, _ in labels if not q]
    loss = lambda c: 10 * sum(x < c for x in seen) / len(seen) + sum(x >= c for x in bad) / len(bad)
    cut = min(sorted(seen) + [np.nextafter(x, np.inf) for x in sorted(bad)], key=loss)
    k = sum(x >= cut - 1e-12 for x in mean.values())
    assert kept == set(sorted(got, key=lambda i: -got[i]["key"])[:k])
    assert sum(i % 5 != 0 for i in kept) / 240 > 0.9 and sum(i % 5 == 0 for i in kept) <= 5
    assert {r["doc_id"] for r in quality.keep(docs.withColumn("noise", docs["doc_id"]), marks).collect()} == kept
    again = quality.keep(docs.repartition(5), marks)
    assert {r["doc_id"] for r in again.collect()} == kept and again.columns == docs.columns


def test_quality_is_a_sample_by_the_weights(spark):
    rows, labels = quality_corpus(1500)
    docs, marks = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    draws = []
    for seed in (1, 2):
        found = quality.weigh(docs, marks, temperature=1.0, seed=seed).collect()
        kept = {r["doc_id"] for r in found if r["kept"]}
        draws.append(kept)
        top = {r["doc_id"] for r in sorted(found, key=lambda r: -r["mean"])[: len(kept)]}
        assert len(kept - top) > 20  # not the plain top k
        noise = [r["key"] - r["mean"] for r in found]
        assert abs(np.mean(noise) - 0.5772) < 0.15 and abs(np.std(noise) - 1.2825) < 0.15
        # of the documents with like weights as many stay as these say: 1 - exp(-exp(weight - least key))
        least = min(r["key"] for r in found if r["kept"])
        for bad in (True, False):
            some = [r for r in found if (r["doc_id"] % 5 == 0) == bad]
            want = np.mean([1 - np.exp(-np.exp(r["mean"] - least)) for r in some])
            assert abs(np.mean([r["kept"] for r in some]) - want) < 0.07
    assert len(draws[0] ^ draws[1]) > 20


def test_kth_largest(spark, monkeypatch):
    monkeypatch.setattr(quality, "FEW", 10)
    monkeypatch.setattr(quality, "BINS", 4)
    r = random.Random(1)
    values = [r.gauss(0, 5) for _ in range(300)] + [2.0] * 40
    keys = spark.createDataFrame([(v,) for v in values], "key double")
    for k in (1, 7, 150, 339):
        assert quality.kth_largest(keys, k) == sorted(values, reverse=True)[k - 1]
    assert quality.kth_largest(keys, 340) == float("-inf") and quality.kth_largest(keys, 0) == float("inf")


def test_several_labels_of_one_id(spark):
    rows, labels = quality_corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    twice = [*labels, *((i, 0, 0) for i, *_ in labels[:50])]  # the largest counts
    got = [sorted((r["doc_id"], r["kept"]) for r in quality.weigh(docs, spark.createDataFrame(x, "doc_id long, quality int, toxic int")).collect()) for x in (labels, twice)]
    assert got[0] == got[1]
    rows, labels = toxic_corpus(300)
    docs = spark.createDataFrame(rows, SCHEMA)
    got = [sorted((r["doc_id"], r["score"]) for r in toxicity.score_texts(docs, spark.createDataFrame(x, "doc_id long, quality int, toxic int")).collect()) for x in (labels, [*labels, *((i, 1, 0) for i, *_ in labels)])]
    assert got[0] == got[1]


def test_leaks_odd(spark, odd):
    benchmark = spark.createDataFrame([(1, "a b c d e f", 0), (1, "a b c d e f", 0), (2, "z y x w v", 0)], "item_id long, text string, doc_id long")
    got = sorted((r["doc_id"] or 0, r["item_id"]) for r in decontaminate.leaks(odd, benchmark).collect())
    assert got == [(0, 1), (0, 1), (1, 1), (1, 1), (1, 1), (1, 1), (1, 2)]
    assert [r["text"] for r in decontaminate.without_leaks(odd, benchmark).collect()] == [None]


def test_very_long_texts(spark):
    """A megabyte in one row, beside a copy of its end."""
    r = random.Random(77)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9))) for _ in range(5000)]
    long = " ".join(r.choice(words) for _ in range(160_000))
    item = " ".join(long.split()[-40:])
    docs = spark.createDataFrame([(1, long, "en", "s", len(long)), (2, long[-3000:], "en", "s", 3000), (3, "short", "en", "s", 5)], SCHEMA)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {x["doc_id"]: x["n_words"] for x in licenses.scan(docs).collect()}[1] == 160_000
    assert {x["doc_id"]: x["fp"][0] % (1 << 64) for x in simhash.near_duplicates(docs).collect()}[1] == brute_simhash(long)
    assert {x["doc_id"]: x["n_removed"] for x in suffix_dedup.repeats(docs).collect()} == {1: 0, 2: 3000, 3: 0}
    assert tokens.count_tokens(docs.where("doc_id = 1")).first()["n_tokens"] == tokens.Counter(tokens.vocabulary())(long)
    assert toxicity.score_texts(docs, none).count() == quality.weigh(docs, none).count() == 3
    benchmark = spark.createDataFrame([(7, item)], "item_id long, text string")
    assert {(x["doc_id"], x["similarity"]) for x in decontaminate.leaks(docs, benchmark).collect()} == {(1, 1.0), (2, 1.0)}
    assert {x["doc_id"]: x["size"] for x in mixing.mix(docs).collect()}[1] == 160_000
    got = {x["doc_id"]: x for x in fingerprint.fingerprints(docs).collect()}
    assert got[1]["n_chars"] == len(long) and 0.6 < got[1]["near_edited"] < 1


def test_quality_odd(spark, odd, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.keep(odd, none).count() == 5 and quality.keep(empty, none).count() == 0


# 8


def bench_and_docs(seed=8):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(400)]
    pick = lambda n: [r.choice(words) for _ in range(n)]
    items = [(i, " ".join(pick(r.choice([3, 12, 20, 40])))) for i in range(20)] + [(20, None), (21, " "), (None, " ".join(pick(15)))]
    rows = []
    for i in range(100):
        w = pick(r.randint(0, 120))
        if i % 3 == 0:
            item = (r.choice(items[:20])[1]).split()
            if i % 2 and len(item) > 12:
                item[r.choice([0, -1])] = "changed"
            if i % 12 == 0 and len(item) > 12:
                item[len(item) // 2] = "changed"
            at = r.randint(0, len(w))
            w[at:at] = item
        rows.append((i, " ".join(w).title() if i % 4 == 0 else " ".join(w), "en", "s", 0))
    return items, rows


def test_leaks(spark, empty):
    items, rows = bench_and_docs()
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame([*rows, (200, None, "en", "s", 0)], SCHEMA)
    want = {}
    for i, t, *_ in rows:
        w = decontaminate.words_of(t.encode())
        for item, text in items:
            iw = decontaminate.words_of((text or "").encode())
            c = Counter(decontaminate.shingles_of(iw))
            best = max((decontaminate.similarity(Counter(decontaminate.shingles_of(w[p : p + len(iw)])), c) for p in range(len(w) - len(iw) + 1)), default=0) if iw else 0
            if best >= 0.8:
                want[i, item] = best
    for part in (1_000_000, 60):
        got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontaminate.leaks(docs, benchmark, max_words=part).collect()}
        assert got == want
    assert {r["doc_id"] for r in decontaminate.without_leaks(docs.withColumn("key", docs["doc_id"]), benchmark).where("key = doc_id").collect()} == {i for i, *_ in rows if i not in {a for a, _ in want}} | {200}
    assert decontaminate.leaks(empty, benchmark).count() == 0 and decontaminate.without_leaks(docs, benchmark.where("false")).count() == 101


def test_leaks_of_shorter_documents(spark):
    r = random.Random(31)
    items = [(i, " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(n))) for i, n in enumerate([3, 9, 9, 12, 20, 40, 100])]
    rows = [(100 * i + 10 * a + b, " ".join(t.split()[a : len(t.split()) - b])) for i, t in items for a in range(4) for b in range(4)]
    want = {}
    for d, t in rows:
        w = t.encode().split()
        for i, text in items:
            iw = text.encode().split()
            sim = decontaminate.similarity(Counter(decontaminate.shingles_of(w)), Counter(decontaminate.shingles_of(iw)))
            if len(w) <= len(iw) and sim >= 0.8:
                want[d, i] = sim
    found = decontaminate.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(x["doc_id"], x["item_id"]): x["similarity"] for x in found} == want and len(want) > 40
    assert {x["doc_id"]: x["n_words"] for x in found} == {d: len(t.split()) for d, t in rows if any(d == k for k, _ in want)}


def random_fps(r, n):
    return np.array([[r.getrandbits(64) for _ in range(decontaminate.BITS // 64)] for _ in range(n)], np.uint64)


def test_multi_index_finds_all_within_radius():
    r = random.Random(9)
    fps = random_fps(r, 200)
    index = decontaminate.MultiIndex(fps)
    queries = fps[[r.randrange(200) for _ in range(300)]].copy()
    for q in queries:
        for _ in range(r.randrange(180)):
            q[r.randrange(8)] ^= np.uint64(1 << r.randrange(64))
    far = np.bitwise_count(queries[:, None] ^ fps[None]).sum(2)
    assert sorted(zip(*(x.tolist() for x in index.near(queries)), strict=True)) == sorted(zip(*(x.tolist() for x in np.nonzero(far <= decontaminate.RADIUS)), strict=True))


def test_multi_index_names_few_random_items():
    r = random.Random(10)
    index = decontaminate.MultiIndex(random_fps(r, 1000))
    query, _ = index.named(random_fps(r, 100))
    assert len(query) < 0.08 * 100 * 1000


def test_recall_of_windows_about_the_threshold():
    r = random.Random(41)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6)).encode()
    items = [[word() for _ in range(r.randint(12, 60))] for _ in range(300)]
    known = decontaminate.Benchmark([(i, b" ".join(w)) for i, w in enumerate(items)])
    want = found = 0
    for i, w in enumerate(items):
        for _ in range(4):
            x = list(w)
            x[r.choice([0, 1, -1, -2])] = word()  # near an end, one word costs one or two shingles
            if len(x) > 50:
                x[r.randrange(5, len(x) - 5)] = word()
            sim = decontaminate.similarity(Counter(decontaminate.shingles_of(x)), known.counts[i])
            if 0.8 <= sim < 0.9:
                want += 1
                found += i in {item for item, *_ in known.search(b" ".join([word(), *x, word()]))}
    assert want > 200 and found / want > 0.97


# 9


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    target, left, free = dict.fromkeys(names, 0.0), float(sum(sizes.values())), set(names)
    while left > 1e-9 and free:
        unit = left / sum(weight[s] for s in free)
        for s in free:
            target[s] += unit * weight[s]
        left = sum(max(target[s] - 3 * sizes[s], 0) for s in free)
        for s in [s for s in free if target[s] >= 3 * sizes[s]]:
            target[s] = 3.0 * sizes[s]
            free.discard(s)
    return target


def test_mix(docs, rows):
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, *_ in rows}
    source = {i: s for i, _, _, s, _ in rows}
    sizes = {s: sum(size[i] for i in size if source[i] == s) for s in set(source.values())}
    target = brute_targets(sizes)
    got = mixing.mix(docs).collect()
    for r in got:
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(target[r["source"]])
        rate = r["target"] / r["source_size"] if r["source_size"] else 0
        assert int(rate) <= r["copies"] <= int(rate) + 1 and r["taken"] == r["copies"] * r["size"] <= 3 * r["size"]
    for s in sizes:
        taken = sum(r["taken"] for r in got if r["source"] == s)
        assert abs(taken - target[s]) <= 3 * max(size[i] for i in size if source[i] == s)
    assert sorted(got) == sorted(mixing.mix(docs.repartition(3)).collect())


def test_slices_spread_null_and_stepped_ids(spark):
    """Null ids by their texts, ids that step by the number of slices by their hash."""
    rows = [(None if i % 2 else 16 * i, f"w {i}", "en", "s", 0) for i in range(2000)]
    docs = spark.createDataFrame(rows, SCHEMA)
    slices = docs.groupBy(F.isnull("doc_id").alias("none"), (mixing._key_hash(F.col("doc_id"), F.col("text")) % 16).alias("l")).count().collect()
    assert len(slices) == 32 and max(r["count"] for r in slices) < 120
    got = mixing.mix(docs).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.mix(docs.repartition(5)).collect())) and abs(sum(r["taken"] for r in got) - 4000) <= 6


def test_targets_stop_at_three_times(spark):
    for sizes in ({"a": 1000, "b": 1, "c": 10}, {"a": 10, None: 5}, {"a": 0, "b": 7}, {"a": 0}, {"z": 5}, {"a": 1, "b": 1, "c": 1, "d": 100}):
        got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
        assert got == {s: pytest.approx(t) for s, t in brute_targets(sizes).items()}


def test_emitted_copies(docs, odd, empty):
    want = {r["doc_id"]: r["copies"] for r in mixing.mix(docs).collect()}
    got = Counter(r["doc_id"] for r in mixing.emit(docs).collect())
    assert got == Counter({i: c for i, c in want.items() if c})
    clash = docs.selectExpr("*", "doc_id AS size", "doc_id AS copies", "doc_id AS own", "doc_id AS twin", "0 AS copy_no", "doc_id AS own_r")
    found = mixing.emit(clash)
    assert sorted(found.columns) == sorted(clash.columns) and found.where("size = doc_id AND copies = doc_id AND own = doc_id AND twin = doc_id").count() == got.total()
    odd_clash = odd.selectExpr("*", "1 AS size", "2 AS own", "3 AS times_r")
    assert mixing.emit(odd_clash).where("size = 1 AND own = 2 AND times_r = 3").count() == mixing.emit(odd).count()
    assert mixing.emit(odd).columns == [*odd.columns, "copy_no"] and mixing.emit(empty).count() == mixing.mix(empty).count() == 0
    assert mixing.emit(odd).count() == sum(r["copies"] for r in mixing.mix(odd).collect())


def test_native_operators_run_no_python(docs, spark):
    for df in (mixing.mix(docs), mixing.emit(docs), url_filter.judge(spark.createDataFrame([(1, "http://a.com/en/")], "page_id long, url string"))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


# 10


def brute_leaves(t):
    """Sentences of each line, cut after each window whose hash says so, and after `MOST` bytes."""
    f = fingerprint
    out = []
    for line in re.findall(rb"[^\n]*\n|[^\n]+", t.encode()):
        for sentence in re.findall(rb"[^.!?\n]*(?:[.!?]+[ \t]*|\n|$)", line):
            leaf = b""
            for i in range(len(sentence)):
                leaf += sentence[i : i + 1]
                window = sentence[max(i + 1 - f.WINDOW, 0) : i + 1]
                mark = len(window) == f.WINDOW and ((int.from_bytes(window, "little") * 0x9E3779B1 & 0xFFFFFFFF) >> 15) % f.SPACING == 0
                if (mark and len(leaf) >= f.LEAST) or len(leaf) == f.MOST or i == len(sentence) - 1:
                    out.append(leaf)
                    leaf = b""
    return out


@pytest.mark.parametrize(("size", "kept", "edited"), [(300, 200, 209), (420, 280, 289), (256, 255, 255), (255, 170, 400), (5000, 5000, 5001)])
def test_texts_of_any_lengths_share_leaves(size, kept, edited):
    """The likeness follows what two texts share, whatever their lengths; the mean of some texts, as leaves are few."""
    r = random.Random(size)
    line = lambda n: " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9))) for _ in range(n))[:n].encode()
    near = []
    for _ in range(30):
        x = line(size)
        y = b"Q" + x if edited > size and kept == size else (x[:kept] + line(edited))[:edited]
        near.append(fingerprint.likeness(fingerprint.tree(x), fingerprint.tree(y)))
    shared = 2 * kept / (size + edited)
    assert shared - 0.1 <= sum(near) / len(near) <= shared + 0.03


def test_leaves_kept_between_trees_change_nothing():
    texts = [t.encode() for _, t, *_ in corpus(60, 9) if t]
    known = {}
    for t in texts:
        assert fingerprint.fingerprint(fingerprint.tree(t, known)) == fingerprint.fingerprint(fingerprint.tree(t))
        assert fingerprint.differing(fingerprint.tree(texts[0], known), fingerprint.tree(t, known)) == fingerprint.differing(fingerprint.tree(texts[0]), fingerprint.tree(t))
    assert fingerprint.likeness(fingerprint.tree(b"a" * 1000), fingerprint.tree(b"a" * 1064)) > 0.9


def test_fingerprints(docs, rows):
    order = sorted(rows, key=lambda r: -r[0])
    got = {r["doc_id"]: r for r in fingerprint.fingerprints(docs).collect()}
    assert len(got) == len(rows)
    for k, (i, t, *_) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        n = len(t)
        edited = t[: n - n // 3] + after[: n // 3]
        g = got[i]
        assert (g["n_chars"], g["edited_sha256"]) == (n, hashlib.sha256(edited.encode()).hexdigest())
        own, other, nxt = brute_leaves(t), brute_leaves(edited), brute_leaves(after)
        written = [g[c].partition(":")[2].replace(",", "").replace(";", "") for c in ("fingerprint", "edited_fingerprint")]
        assert written == ["".join(xxhash.xxh3_128_digest(x).hex()[:6] for x in leaf) for leaf in (own, other)]
        for near, x, y, same in ((g["near_edited"], own, other, t == edited), (g["near_next"], own, nxt, t == after)):
            # at least the common ends, at most the common leaves in any order
            ends = next((i for i, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))
            most = 2 * (Counter(x) & Counter(y)).total() / max(len(x) + len(y), 1)
            assert near == 1.0 if same else 2 * ends / max(len(x) + len(y), 1) - 1e-9 <= near <= most + 1e-9
        spans, b = [(s["start"], s["end"]) for s in g["edited_spans"]], edited.encode()
        if t != edited:  # what is outside the spans stands in the text, in order
            at, outside = 0, [b[p:q] for p, q in zip([0, *(e for _, e in spans)], [*(s for s, _ in spans), len(b)], strict=True)]
            for piece in outside:
                at = t.encode().find(piece, at)
                assert at >= 0
        else:
            assert not spans
    same = Counter(t or "" for _, t, *_ in rows)
    assert len({g["fingerprint"] for g in got.values()}) == len(same)


def test_fingerprints_odd(spark, odd, empty):
    assert fingerprint.fingerprints(odd).count() == 5 and fingerprint.fingerprints(empty).count() == 0
    one = fingerprint.fingerprints(spark.createDataFrame([(1, "abcd")], "doc_id long, text string")).first()
    assert one["near_next"] == 1.0 and one["edited_sha256"] == hashlib.sha256(b"abca").hexdigest()


def test_branches_locate_edits():
    text = "\n".join(f"Paragraph {i}. It has two sentences." for i in range(40)).encode()
    edited = text.replace(b"Paragraph 17", b"Paragraph XX")
    spans = fingerprint.differing(fingerprint.tree(text), fingerprint.tree(edited))
    at = edited.index(b"XX")
    assert len(spans) == 1 and spans[0][0] <= at < spans[0][1] and spans[0][1] - spans[0][0] < 60
    assert fingerprint.differing(fingerprint.tree(text), fingerprint.tree(text)) == []
    assert "".join(text[x.start : x.end].decode() for x in fingerprint.leaves(fingerprint.tree(text))) == text.decode()


def test_a_paragraph_in_front_is_one_edit():
    text = "\n".join(f"Paragraph {i}. It has two sentences." for i in range(40)).encode()
    front = b"A new paragraph.\n"
    a, b = fingerprint.tree(text), fingerprint.tree(front + text)
    assert fingerprint.differing(a, b) == [(0, len(front))]
    assert fingerprint.likeness(a, b) > 0.97
    gone = fingerprint.differing(b, a)
    assert gone == [(0, 0)]
    for x, y in ((a, b), (b, a), (a, fingerprint.tree(b"")), (fingerprint.tree(b""), fingerprint.tree(b""))):
        assert fingerprint.likeness(*(fingerprint.read_tree(fingerprint.fingerprint(t)) for t in (x, y))) == fingerprint.likeness(x, y)
