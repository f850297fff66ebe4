"""Operators against versions written anew here, sharing no code with them."""

import base64
import hashlib
import math
import zlib

import pytest
import regex
import xxhash

from dunegrid.llm import digest, quality, sharding
from tests.llm.test_files import ODD, SF, docs_of


def plain_codes(text):
    """Length code and quartiles of 1024 counters of (byte 0, byte 3, byte 7) triplets."""
    data = text.encode()
    if not data:
        return [0] * 1025
    padded, counts = bytes(7) + data + bytes(7), [0] * 1024
    for i in range(len(padded) - 7):
        h = ((padded[i] << 16 | padded[i + 3] << 8 | padded[i + 7]) * 0x9E3779B1) % 2**32
        h = ((h ^ h >> 15) * 0x85EBCA77) % 2**32
        counts[h >> 22] += 1
    order = sorted(counts)
    quartile = [sum(c > order[q] for q in (255, 511, 767)) for c in counts]
    return [min(255, 1 + int(8 * math.log2(len(data)))), *quartile]


def plain_fingerprint(code):
    packed = bytes(sum(code[1 + 4 * k + j] << 2 * j for j in range(4)) for k in range(256))
    return f"{code[0]:02x}" + base64.urlsafe_b64encode(packed).decode().rstrip("=")


def plain_likeness(a, b):
    most, least = sum(map(max, a[1:], b[1:])), sum(map(min, a[1:], b[1:]))
    if not most:
        return 1.0
    return max(0.0, least / most * (1 - 0.03 * min(32, abs(a[0] - b[0])) / 32))


def test_digests(spark):
    texts = [t for t in ODD if len(t or "") < 5000]
    texts += [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(12).collect()]
    docs = spark.createDataFrame([(7 * k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in digest.digests(docs).collect()}
    assert len(got) == len(texts)
    for k, t in enumerate(texts):
        text, after = t or "", texts[(k + 1) % len(texts)] or ""
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        code, changed, follows = plain_codes(text), plain_codes(edited), plain_codes(after)
        r = got[7 * k]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (plain_fingerprint(code), plain_fingerprint(changed))
        assert r.near_edited == pytest.approx(plain_likeness(code, changed), abs=1e-12)
        assert r.near_next == pytest.approx(plain_likeness(code, follows), abs=1e-12)


def plain_statistics(text):
    words = [w for w in regex.split(r"[\x20\x09-\x0D]+", text) if w]
    lines, n, n_words = text.split("\n"), max(1, len(text)), max(1, len(words))
    return {
        "log_words": math.log1p(len(words)), "word_length": len(text) / n_words,
        "distinct_words": len(set(words)) / n_words, "distinct_root": len(set(words)) / math.sqrt(n_words),
        "capitals": len(regex.findall(r"\p{Lu}", text)) / n, "digits": len(regex.findall("[0-9]", text)) / n,
        "marks": len(regex.findall(r"[^\p{L}\p{N}\x20\x09-\x0D.,]", text)) / n,
        "stops": sum(c in ".," for c in text) / n_words, "line_words": n_words / len(lines),
        "distinct_lines": len(set(lines)) / len(lines)}


def test_rules_row_by_row(spark):
    """Every rule of a fitted model, read one by one, gives the compiled column's score."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.fit(docs, labels)
    assert len(model.rules) > 3
    texts = {r.doc_id: r.text for r in docs.collect()} | {10**6 + k: t for k, t in enumerate(ODD)}
    rows = quality.score(docs.unionByName(spark.createDataFrame(
        [(10**6 + k, t) for k, t in enumerate(ODD)], "doc_id long, text string")), model).collect()
    assert len(rows) == len(texts)
    for r in rows:
        stats = plain_statistics(texts[r.doc_id] or "")
        total = model.intercept
        for rule, weight in model.rules:
            if all(stats[name] <= at if op == "<=" else stats[name] > at for name, op, at in rule):
                total += weight
        assert r.score == pytest.approx(1 / (1 + math.exp(-total)), abs=1e-9)
        assert r.predicted == (1 if r.score >= 0.7 else 0)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


@pytest.mark.parametrize("shards, units_per_shard", [(2, 1), (4, 3), (5, 500)])
def test_schedule_with_bundles(spark, shards, units_per_shard):
    """Large groups are units, the others travel in hash bundles; the longest goes first."""
    texts = [t for t in ODD] + [f"text {k % 40} " * (1 + k % 17) for k in range(200)]
    docs = docs_of(spark, texts)
    rows = [(r.doc_id, (r.text or "").encode()) for r in docs.collect()]
    size, units = {}, shards * units_per_shard
    for _, data in rows:
        size[data] = size.get(data, 0) + len(data) + 8
    total, load, unit_of = sum(size.values()), {}, {}
    for data, n in size.items():
        name = hashlib.md5(data).hexdigest()
        if n * units < total:
            h = xxhash.xxh64_intdigest(name.encode(), seed=42)
            name = f"b{(h - 2**64 if h >= 2**63 else h) % units}"
        unit_of[data] = name
        load[name] = load.get(name, 0) + n
    full, shard_of = [0] * shards, {}
    for n, name in sorted((-n, name) for name, n in load.items()):
        at = full.index(min(full))
        shard_of[name], full[at] = at, full[at] - n
    got = sharding.shard_rows(docs, shards, units_per_shard).collect()
    want = sorted((repr(i), zlib.crc32(data), len(data) + 8, shard_of[unit_of[data]]) for i, data in rows)
    assert sorted((repr(r.doc_id), r.text_crc32, r.size, r.shard) for r in got) == want
    if units_per_shard < 500:
        assert any(name.startswith("b") for name in load) and any(len(name) == 32 for name in load)
    for s in range(shards):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
