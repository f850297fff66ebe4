"""Merkle manifest and importance resampling against plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from dunegrid.llm import merkle, resample
from tests.llm.test_files import SF, empty_docs


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def plain_leaf(r, delta=0):
    values = (r.doc_id, r.source, r.lang, None if r.n_chars is None else r.n_chars + delta, r.text)
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_levels(nodes, k):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i:i + k])) for i in range(0, len(out[-1]), k)])
    return out


def plain_path(levels, i, k):
    out = []
    for nodes in levels[:-1]:
        first = i // k * k
        out.append(("".join(nodes[first:i]), "".join(nodes[i + 1:first + k])))
        i //= k
    return out


def plain_manifest(rows, altered, k):
    """(doc_id, leaf, subroot, root, proof, folded root, verified) of every row."""
    trees = {}
    for r in rows:
        trees.setdefault(r.lang, []).append(r)
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    for x in langs:
        trees[x].sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, plain_leaf(r)))
    built = [plain_levels([plain_leaf(r) for r in trees[x]], k) for x in langs]
    top = plain_levels([b[-1][0] for b in built], k)
    out = []
    for t, x in enumerate(langs):
        for i, r in enumerate(trees[x]):
            path = plain_path(built[t], i, k) + plain_path(top, t, k)
            h = plain_leaf(r, 1 if altered(r) else 0)
            for before, after in path:
                h = sha(before + h + after)
            out.append((r.doc_id, plain_leaf(r), built[t][-1][0], top[-1][0], sha("".join(a + b for a, b in path)), h,
                        h == top[-1][0]))
    return out


def in_order(rows):
    return sorted(map(tuple, rows), key=str)


@pytest.mark.parametrize("fanout, stride, chunk", [(2, 6, 256), (3, 2, 4)])
def test_manifest_against_plain_python(spark, monkeypatch, fanout, stride, chunk):
    monkeypatch.setattr(merkle, "CHUNK", chunk)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = merkle.manifest(docs, merkle.every_seventh(), fanout, stride).collect()
    want = plain_manifest(docs.collect(), lambda r: zlib.crc32(str(r.doc_id).encode()) % 7 == 0, fanout)
    assert in_order(got) == in_order(want)
    assert 0 < sum(not r.verified for r in got) < len(got) / 3


def test_manifest_of_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, leaf string, `a.b` int, tree int"
    odd = [(7, "", "en", "s", 0), (7, "", "en", "s", 0), (None, None, "en", None, None), (8, "x" * 100_000, "en", "s", 5),
           (9, "ä\n", None, "s", 2), (10, "lone", "zz", "s", None), (3, "y", "én", "s", 1), (4, "y", "en", "s", 1),
           (11, "y", "en", "s", 1)]
    docs = spark.createDataFrame([(*r, "l", 1, 2) for r in odd], schema)
    got = merkle.manifest(docs, F.col("doc_id") > 6).collect()
    want = plain_manifest(docs.collect(), lambda r: (r.doc_id or 0) > 6, 2)
    assert in_order(got) == in_order(want)
    assert {r.doc_id: r.verified for r in got} == {7: False, None: True, 8: False, 9: False, 10: True, 3: True, 4: True,
                                                   11: False}
    assert merkle.manifest(docs.limit(0), F.lit(True)).collect() == []
    one = merkle.manifest(docs.filter("doc_id = 9"), F.lit(False)).collect()
    assert len(one) == 1 and one[0].leaf == one[0].subroot == one[0].root == one[0].folded_root
    assert one[0].proof_sha256 == sha("")


def plain_features(text, n):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    return words, [" ".join(words[i:i + k]) for k in range(1, n + 1) for i in range(len(words) - k + 1)]


def plain_ranks(rows, target, n, buckets, seed, percent, least):
    def counted(texts):
        c = Counter(zlib.crc32(f.encode()) % buckets for t in texts for f in plain_features(t, n)[1])
        return c, sum(c.values())

    (s, total_s), (t, total_t) = counted([x for _, x in rows]), counted(target)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (total_s + buckets) / ((s[b] + 1) * (total_t + buckets))))
            for b in range(buckets)]
    out = []
    for doc_id, text in rows:
        words, found = plain_features(text, n)
        weight = sum(gain[zlib.crc32(f.encode()) % buckets] for f in found) // len(found) if found else 0
        h = int(sha(f"{seed}:{'' if doc_id is None else doc_id}")[:8], 16)
        out.append([doc_id, len(found), weight,
                    weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    enough = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[2], r[1]))
    for k, r in enumerate(enough[:percent * len(enough) // 100]):
        r[4] = k + 1
    return [r[:5] for r in out]


@pytest.mark.parametrize("n, buckets, percent", [(1, 10_000, 10), (3, 500, 45)])
def test_ranks_against_plain_python(spark, n, buckets, percent):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    target = spark.read.parquet(f"{SF}/benchmark.parquet")
    got = resample.ranks(docs, target, n, buckets, 2024, percent, 20).collect()
    want = plain_ranks([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in target.collect()], n, buckets, 2024,
                       percent, 20)
    assert in_order(got) == in_order(want)


def test_ranks_of_odd_rows(spark):
    odd = [(1, "A b\nB c\n\n\nd"), (2, None), (None, "a\nb\nc\nd\ne f g"), (3, ""), (4, "a b " * 50_000), (4, "a b"), (5, "é É 1"),
           (6, "a b c"), (6, "a b c"), (7, "\n \n--\n")]
    docs = spark.createDataFrame([(*r, 1, "x") for r in odd], "doc_id long, text string, score int, `bucket.n` string")
    target = spark.createDataFrame([("a b c",), (None,), ("b\nc",)], "text string")
    for n in (1, 2, 4):
        got = resample.ranks(docs, target, n, 97, 5, 60, 2).collect()
        assert in_order(got) == in_order(plain_ranks(odd, ["a b c", None, "b\nc"], n, 97, 5, 60, 2))
    assert resample.ranks(docs, target.limit(0)).count() == len(odd)
    assert resample.ranks(empty_docs(spark), target).collect() == []
    drawn = resample.draw(docs, target, n=2, buckets=97, seed=5, percent=60, least_words=2)
    assert drawn.columns == docs.columns and 0 < drawn.count() < len(odd)
