"""Exact top-k against brute force."""

import math

import duckdb
import numpy as np
import pytest

from dunegrid.llm import queries, top_k
from tests.llm.test_files import SF

VECS = "vec_id long, embedding array<float>, cells string, bucket string"


def brute(rows, k, every):
    ok = {(r[0], tuple(math.floor(256 * float(np.float32(x))) for x in r[1])) for r in rows
          if r[0] is not None and r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])}
    out = []
    for q, a in ok:
        if q % every:
            continue
        s = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in ok if i != q and len(a) == len(b))
        out += [(q, n + 1, i, -v) for n, (v, i) in enumerate(s[:k])]
    return sorted(out)


@pytest.mark.parametrize("bucket_rows,block_rows,spread", [(4096, 256, 0.0), (64, 16, 0.0), (64, 16, 1.5)])
def test_top_k_against_brute_force(spark, bucket_rows, block_rows, spread):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(700, 12)) * np.exp(spread * rng.normal(size=(700, 1)))
    v[300:420] = v[300]  # a hot vector, all ties
    rows = [(i, [float(x) for x in r], "c", "b") for i, r in enumerate(v)]
    df = spark.createDataFrame(rows, VECS).repartition(3)
    got = sorted(tuple(r) for r in top_k.top_k(df, 5, 50, bucket_rows=bucket_rows, block_rows=block_rows).collect())
    assert got == brute(rows, 5, 50)


def test_top_k_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (50, [1.0]), (100, None), (150, [None, 1.0]), (200, [float("nan"), 1.0]),
            (250, [float("inf"), 1.0]), (1, [0.0, 0.0]), (2, [-1.0, -2.0]), (300, [0.0, 0.0]), (3, [3.0, 1.0]),
            (3, [3.0, 1.0]), (None, [1.0, 1.0]), (350, []), (4, []), (5, [1.0, 2.0]), (6, [1e6, -3e7]), (400, [4e7, 2e6])]
    df = spark.createDataFrame([(*r, "c", "b") for r in rows], VECS)
    got = sorted(tuple(r) for r in top_k.top_k(df, 2, 50, bucket_rows=2, block_rows=2).collect())
    assert got == brute(rows, 2, 50)
    assert top_k.top_k(df.limit(0)).collect() == []
    assert top_k.top_k(df.limit(1)).collect() == []


def test_coordinate_pruning_keeps_every_partner():
    rng = np.random.default_rng(2)
    p, q = rng.normal(size=(3000, 6)), rng.normal(size=6)
    norms = np.linalg.norm(p, axis=1)
    p = p[np.argsort(-norms)]
    norms = np.sort(norms)[::-1]
    qn = np.linalg.norm(q)
    for theta in (0.5, 2.0, 4.0, 6.0):
        at = top_k.candidates(p / norms[:, None], norms, q / qn, qn, theta)
        assert set(np.flatnonzero(p @ q >= theta)) <= set(at)
    assert len(top_k.candidates(p / norms[:, None], norms, q / qn, qn, 0.8 * norms[0] * qn)) < 300


def test_partitions_follow_rows_and_theta_rises(spark):
    """Partitions do not number the pairs; within a group later buckets are left out."""
    rng = np.random.default_rng(3)
    v = rng.normal(size=(3000, 12)) * np.exp(1.2 * rng.normal(size=(3000, 1)))
    df = spark.createDataFrame([(i, [float(x) for x in r], "c", "b") for i, r in enumerate(v)], VECS)
    found = top_k.survivors(df, 5, 5, "vec_id", "embedding", 64, 16, 512, 4)
    pairs = math.ceil(3000 / 64) * math.ceil(600 / 16)
    assert found.rdd.getNumPartitions() <= 2 * spark.sparkContext.defaultParallelism + 3000 // 512 < pairs / 50
    searched = {}
    for r in found.select("query_id", "searched", "vec_id", "score").collect():
        searched.setdefault(r.query_id, {})[r.searched, r.vec_id is None] = r.searched
    total = found.groupBy("query_id").agg({"searched": "max"}).count()
    assert total == 600
    asked = sum(sum(x.values()) for x in searched.values())
    assert asked < 600 * math.ceil(3000 / 64) / 3


def test_query_matches_oracle(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{SF}/embeddings.parquet')")
    exp = sorted(con.execute(queries.OP5_SQL).fetchall())
    assert sorted(tuple(r) for r in queries.op5_top_k(spark, SF).collect()) == exp
