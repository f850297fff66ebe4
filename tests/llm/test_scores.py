"""Digests and the rule ensemble."""

import hashlib
import zlib

import numpy as np
import pytest

from dunegrid.llm import digest, quality, queries
from tests.llm.test_files import DOCS, ODD, SF, docs_of, empty_docs


def expect_digests(rows):
    """Brute force over (doc_id, text), already in order."""
    out = []
    for k, (i, t) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][1]
        e = digest.edited_text(t, nxt)
        a, b, c = digest.codes(t), digest.codes(e), digest.codes(nxt)
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), digest.fingerprint(a), digest.fingerprint(b),
                    digest.likeness(a, b), digest.likeness(a, c)))
    return out


@pytest.mark.parametrize("parts", [1, 7])
def test_digests_against_brute_force(spark, parts):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted((r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect())
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = sorted(tuple(r) for r in digest.digests(docs).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert got == sorted(expect_digests(rows))
    near, following = np.array([r[5] for r in got]), np.array([r[6] for r in got])
    same = np.array([rows[k][1] == rows[(k + 1) % len(rows)][1] for k in range(len(rows))])
    assert (near[~same] > following[~same]).mean() > 0.97
    assert ((near >= 0) & (near <= 1) & (following >= 0) & (following <= 1)).all()


def test_digests_of_odd_rows(spark):
    docs = spark.createDataFrame([(5 * k, t, "x") for k, t in enumerate(ODD)], "doc_id long, text string, part string")
    rows = [(5 * k, t or "") for k, t in enumerate(ODD)]
    assert sorted(tuple(r) for r in digest.digests(docs).collect()) == sorted(expect_digests(rows))
    assert digest.digests(empty_docs(spark)).collect() == []
    one = spark.createDataFrame([(None, "abcd")], "doc_id long, text string")
    assert digest.digests(one).collect()[0].edited_sha256 == hashlib.sha256(b"abab").hexdigest()
    twice = docs_of(spark, ["a b c d", "x"])
    assert digest.digests(twice).count() == 4


def test_fingerprints_hold_1024_counters(spark):
    docs = docs_of(spark, ODD)
    for r in digest.digests(docs).collect():
        for f in (r.fingerprint, r.edited_fingerprint):
            assert len(f) == 2 + 342 and len(digest.parse(f)) == 1 + 1024


def test_digest_parts():
    for t in ["", "a", "b", "word " * 300_000, "ä" * 10]:
        c = digest.codes(t)
        assert (digest.parse(digest.fingerprint(c)) == c).all() and digest.likeness(c, c) == 1.0
    assert digest.likeness(digest.codes(""), digest.codes("a")) == 0.0
    assert digest.fingerprint(digest.codes("a")) != digest.fingerprint(digest.codes("b"))
    long = "abcdefgh " * (digest.BLOCK // 9 + 5000)
    whole = digest._counts(long.encode())
    assert whole.sum() == len(long) + digest.TRIPLET[-1]


def test_quality_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in queries.QUERIES["op10_quality"](spark, sf).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [i for i in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i].held_out for i in held)
    assert not any(r.held_out for r in got.values() if zlib.crc32(str(r.doc_id).encode()) % 4 != 2)
    y, s = np.array([labels[i] for i in held]), np.array([got[i].score for i in held])
    assert ((s >= 0.7) == y).mean() > 0.97
    rank = s.argsort().argsort()
    auc = (rank[y == 1].mean() - (sum(y) - 1) / 2) / (y == 0).sum()
    assert auc > 0.98


def test_quality_odd_rows(spark):
    docs = docs_of(spark, ODD)
    labels = spark.createDataFrame([(0, 1, 0), (3, 1, 0), (None, 1, 0), (6, None, 0)],
                                   "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)
    rows = quality.score(docs, model).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    same = spark.createDataFrame([(i, "same text") for i in range(8)], "doc_id long, text string")
    mixed = spark.createDataFrame([(i, i % 2) for i in range(8)], "doc_id long, quality int")
    assert quality.fit(same, mixed).rules == ()
    none = quality.fit(empty_docs(spark), labels.limit(0))
    assert none.rules == () and {r.score for r in quality.score(docs, none).collect()} == {0.5}
    assert quality.score(empty_docs(spark), none).collect() == []
    clash = docs.withColumnRenamed("ids", "score").withColumnRenamed("shard", "_stats").withColumnRenamed("size", "a.b")
    assert quality.keep_good(clash, none, 0.1).columns == clash.columns


def test_rules_of_a_printed_tree():
    tree = """DecisionTreeClassificationModel: depth=2
  If (feature 0 <= 0.5)
   If (feature 1 <= 2.0)
    Predict: 0.0
   Else (feature 1 > 2.0)
    Predict: 1.0
  Else (feature 0 > 0.5)
   Predict: 1.0
"""
    assert quality.tree_rules(tree, ["a", "b"]) == [
        (("a", "<=", 0.5),), (("a", "<=", 0.5), ("b", "<=", 2.0)), (("a", "<=", 0.5), ("b", ">", 2.0)),
        (("a", ">", 0.5),)]
    assert quality.simplify([("a", "<=", 3.0), ("a", "<=", 2.0), ("a", ">", 1.0)]) == (("a", "<=", 2.0), ("a", ">", 1.0))
