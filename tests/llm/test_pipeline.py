"""The pipeline's five stages on a small corpus, each against brute force on its own input."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from pathlib import Path

import pytest

import corpus_pipeline
from eodlake.llm import mixing, quality

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    """The smallest tables, with rows of a null id, an id of two texts and a row repeated whole."""
    base = str(tmp_path_factory.mktemp("sf"))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    some = docs.orderBy("doc_id").limit(40)
    odd = some.limit(2).selectExpr("CAST(NULL AS bigint) AS doc_id", "text", "lang", "source", "n_chars")
    odd = odd.union(some.limit(1)).union(some.limit(3).selectExpr("5L AS doc_id", "concat('another ', text) AS text", "lang", "CAST(NULL AS string) AS source", "n_chars"))
    docs.union(odd.selectExpr(*docs.columns)).write.parquet(f"{base}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{base}/{name}.parquet")
    return base


def words(t):
    return re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode().lower())


def shingles(w):
    return [b" ".join(w[i : i + 5]) for i in range(max(len(w) - 4, min(len(w), 1)))]


def near_groups(rows):
    sets = [frozenset(shingles(words(t))) for _, t in rows]
    low = list(range(len(rows)))

    def top(i):
        while low[i] != i:
            i = low[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if rows[a][0] == rows[b][0] or x == y or len(x & y) >= 0.8 * len(x | y):
                low[top(a)] = top(b)
    out = {}
    for i, (d, _) in enumerate(rows):
        out.setdefault(top(i), set()).add(d)
    return list(out.values())


def without_repeats(rows, length=100):
    """(id, text hash order) -> texts without the strings that stand earlier; a row repeated whole is one document."""
    seen, out = set(), {}
    for key, t in rows:
        if key in out:
            continue
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if b[p : p + length] in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(b[p : p + length])
        out[key] = bytes(c for c, g in zip(b, gone, strict=True) if not g).decode("utf-8", "ignore") if t is not None else None
    return out


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = corpus_pipeline.cut(stage(spark, docs, sf_dir), "test")
        kept[name] = before, docs.collect()
        assert docs.columns == (columns if name != "mix" else [*columns, "copy_no"]) and docs.count()
        assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000"

    before, after = kept["quality"]
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    found = quality.weigh(spark.createDataFrame(before, "doc_id long, text string, lang string, source string, n_chars long"), spark.read.parquet(f"{sf_dir}/labels.parquet")).collect()
    assert Counter(r["doc_id"] for r in after) == Counter(r["doc_id"] for r in found if r["kept"])
    good = [i for i, q in labels.items() if q == 1]
    assert len({r["doc_id"] for r in after} & set(good)) >= 0.95 * len(good)

    before, after = kept["near-duplicates"]
    groups = near_groups([(r["doc_id"], r["text"]) for r in before if r["doc_id"] is not None])
    assert sorted(r["doc_id"] for r in after if r["doc_id"] is not None) == sorted(map(min, groups))
    assert sum(r["doc_id"] is None for r in after) == sum(r["doc_id"] is None for r in before)

    before, after = kept["repeated passages"]
    order = {r["doc_id"]: r["k"] for r in spark.createDataFrame([(i, r["text"]) for i, r in enumerate(before)], "doc_id long, text string").selectExpr("doc_id", "xxhash64(coalesce(text, '')) AS k").collect()}
    ranked = sorted((r["doc_id"] is None, r["doc_id"] or 0, order[i], i) for i, r in enumerate(before))
    want = without_repeats([(k[:3], before[k[3]]["text"]) for k in ranked])
    want = [((None if k[0] else k[1]), want[k[:3]]) for k in ranked if not (want[k[:3]] is not None and before[k[3]]["text"] and not want[k[:3]].strip(" "))]
    assert sorted(((r["doc_id"] or -1), r["text"] or "", r["n_chars"]) for r in after) == sorted((d or -1, t or "", len(t or "")) for d, t in want)

    before, after = kept["benchmark leaks"]
    items = [words(r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect() if words(r["text"])]

    def leaked(t):
        w = words(t)
        for item in items:
            c = Counter(shingles(item))
            for p in range(max(len(w) - len(item), 0) + 1):
                o = Counter(shingles(w[p : p + len(item)]))
                both = (c & o).total()
                if both and both >= 0.8 * (c.total() + o.total() - both):
                    return True
        return False

    gone = {r["doc_id"] for r in before if leaked(r["text"])}
    assert gone and sorted((r["doc_id"] or -1, r["text"]) for r in after) == sorted((r["doc_id"] or -1, r["text"]) for r in before if not leaked(r["text"]))

    before, after = kept["mix"]
    copies = Counter((r["doc_id"], hashlib.md5((r["text"] or "").encode()).hexdigest()) for r in after)
    mixed = mixing.mix(spark.createDataFrame(before, "doc_id long, text string, lang string, source string, n_chars long")).collect()
    assert sum(copies.values()) == sum(r["copies"] for r in mixed)
    assert Counter(r["doc_id"] for r in after if r["doc_id"] is not None) == Counter({r["doc_id"]: r["copies"] for r in mixed if r["copies"] and r["doc_id"] is not None})
    assert {r["copy_no"] for r in after} <= {1, 2, 3, 4}


def test_stages_on_an_empty_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.cut(stage(spark, docs, sf_dir), "test")
        assert docs.count() == 0
