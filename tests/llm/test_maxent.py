"""The hashed maximum-entropy model against plain Python."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from dunegrid.llm import maxent, queries
from tests.llm.test_files import ODD, SF, docs_of, empty_docs

MASK = (1 << 64) - 1
M = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93]


def plain_tokens(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lower) + [None]  # None: the end


def plain_base(rows):
    """(doc_id, held_out, n_tokens, n_known, N, base score) of (doc_id, text) rows."""
    held = [i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows]
    c = Counter(t for (_, text), h in zip(rows, held) if not h for t in plain_tokens(text))
    n, v = sum(c.values()), len(c)
    return [(i, h, len(plain_tokens(t)), sum(c[x] > 0 for x in plain_tokens(t)), n,
             math.fsum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in plain_tokens(t)))
            for (i, t), h in zip(rows, held)]


def by_id(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[2], r[5]))


def same(got, want):
    got = by_id([(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got])
    for g, w in zip(got, by_id(want), strict=True):
        assert g[:5] == w[:5] and math.isclose(g[5], w[5], rel_tol=1e-9, abs_tol=1e-9)


def test_base_counts_and_held_out_gain(spark):
    got = queries.QUERIES["op13_maxent"](spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    same(got, plain_base([tuple(r) for r in docs]))
    for held in (True, False):
        part = [r for r in got if r.held_out == held]
        tokens = sum(r.n_tokens for r in part)
        assert sum(r.score - r.base_score for r in part) / tokens > 0.05
        assert np.mean([r.score > r.base_score for r in part]) > 0.9


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(maxent, "KNOWN", 3)  # all other words take the joined counts
    monkeypatch.setattr(maxent, "HELD", 4)  # and partial counts are given away early
    docs = docs_of(spark, ODD + ["x" * 30 + " B b", "B " + "x" * 30 + " zz"])
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    same(maxent.scores(docs).collect(), plain_base(rows))
    assert maxent.scores(empty_docs(spark)).collect() == []
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    alone = spark.createDataFrame([(held, "a b")], "doc_id long, text string")
    assert [tuple(r)[:6] for r in maxent.scores(alone).collect()] == [(held, True, 3, 0, 0, 0.0)]
    assert maxent.scores(alone).collect()[0].score == pytest.approx(0, abs=1e-6)


def plain_hash(word, base):
    """Polynomial of the bytes plus 1, mixed; 0 for the end."""
    if word is None:
        return 0
    x = sum((b + 1) * pow(base, i, 1 << 64) for i, b in enumerate(word.encode())) & MASK
    x = ((x ^ (x >> 32)) * M[2]) & MASK
    return x ^ (x >> 29)


@pytest.mark.parametrize("cut", [0, 3])
def test_tokens_against_plain_python(cut):
    texts = [*ODD, "x" * 3000 + " end", "", None, "É b"]
    h1, h2, first = maxent.tokens(pa.array(texts)[cut:])
    words = [plain_tokens(t) for t in texts[cut:]]
    assert np.diff(np.append(first, len(h1))).tolist() == [len(w) for w in words]
    short = [(k, w) for k, w in enumerate(w for ws in words for w in ws) if w is None or len(w) < 100]
    for k, w in short[:2000]:
        assert (int(h1[k]), int(h2[k])) == (plain_hash(w, M[0]), plain_hash(w, M[1]))
    flat = [w for ws in words for w in ws]
    assert len({(int(a), int(b)) for a, b in zip(h1, h2)}) == len(set(flat))


def hashed(x, bits):
    x = ((x ^ (x >> 29)) * M[3]) & MASK
    return x >> (64 - bits)


def plain_rows(words, i, of_class):
    """Weight rows of a token of a text by the docstring's features."""
    one = plain_hash(words[i - 1], M[0]) * M[0] & MASK if i > 0 else 0
    two = plain_hash(words[i - 2], M[0]) * M[1] & MASK if i > 1 else 0
    c = (of_class + 1) * M[2] & MASK
    b, w = maxent.CLASS_BITS, maxent.WORD_BITS
    return ([hashed(one, b), hashed(two, b) + (1 << b)],
            [hashed((one + c) & MASK, w) + maxent.WORD_ROWS_AT,
             hashed((two + c) & MASK, w) + maxent.WORD_ROWS_AT + (1 << w)])


def plain_probability(base, weights, ranks, words, i):
    y = min(ranks[plain_hash(words[i], M[0])], maxent.OTHER)
    c, w = divmod(y, maxent.WIDTH)
    f, g = plain_rows(words, i, c)
    p = base.classes * np.exp(sum(weights[r].astype(float) for r in f))
    q = base.inside[c] * np.exp(sum(weights[r].astype(float) for r in g))
    return p / p.sum(), q / q.sum(), f, g, c, w


@pytest.fixture()
def small(spark):
    texts = ["a b a c", "b a", "", "a a a b d e f", None, "c a b " * 40]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    base = maxent.base_of(maxent.counts(docs))
    return docs, texts, base


def test_scores_and_gradient_against_loops(small):
    docs, texts, base = small
    rng = np.random.default_rng(5)
    weights = rng.normal(size=(maxent.ROWS, maxent.WIDTH)).astype(np.float32)
    ranks = {int(h): i for i, h in enumerate(base.h1)}
    want, seen, hoped = [], np.zeros(weights.shape), np.zeros(weights.shape)
    for t in texts:
        words, total = plain_tokens(t), 0.0
        for i in range(len(words)):
            p, q, f, g, c, w = plain_probability(base, weights, ranks, words, i)
            total += math.log10(p[c] * q[w])
            for r in f:
                hoped[r] += p
                seen[r, c] += 1
            for r in g:
                hoped[r] += q
                seen[r, w] += 1
        want.append(total)
    rows = maxent._row_scores(docs.selectExpr("*", "false AS held_out"), base, weights).collect()
    assert [r.score for r in sorted(rows, key=lambda r: r.doc_id)] == pytest.approx(want, abs=1e-3)
    step = maxent.gradient(docs, base, weights, len(texts), 4.0)
    assert np.allclose(step, (seen - hoped) / (seen + hoped + 4), atol=1e-4)


def test_without_weights_the_model_is_the_base(small):
    docs, _, base = small
    weights = np.zeros((maxent.ROWS, maxent.WIDTH), np.float32)
    for r in maxent._row_scores(docs.selectExpr("*", "false AS held_out"), base, weights).collect():
        assert r.score == pytest.approx(r.base, abs=1e-4)
    left = base.classes.astype(float)[:, None] * base.inside.astype(float)
    assert left.sum() == pytest.approx(1, abs=1e-5)


def test_rows_are_added_up():
    rng = np.random.default_rng(2)
    rows, values = rng.zipf(1.4, 9000) % 300, rng.random((9000, 4), dtype=np.float32)
    to, want = np.ones((300, 4), np.float32), np.ones((300, 4))
    maxent._add_rows(to, rows, values)
    np.add.at(want, rows, values)
    assert np.allclose(to, want, rtol=1e-4)
