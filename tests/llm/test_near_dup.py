"""Near-duplicate groups against all-pairs brute force."""

import random
import re

import pytest

from dunegrid.llm import near_dup, queries, shingles
from dunegrid.llm.components import components
from tests.llm.test_files import ODD, SF, docs_of, empty_docs


def shingle_tuples(text, k):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)])


def brute(rows, k, percent):
    """[(doc_id, n, component, kept)] over (doc_id, text), by every pair that shares a shingle."""
    sets = [shingle_tuples(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    by = {}
    for i, s in enumerate(sets):
        for x in s:
            by.setdefault(x, []).append(i)
    for i, s in enumerate(sets):
        for j in {j for x in s for j in by[x] if j < i}:
            both = len(s & sets[j])
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, len(sets[i]), least.get(find(i)), d == least.get(find(i))) for i, (d, _) in enumerate(rows)),
                  key=repr)


def got(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect()), key=repr)


@pytest.mark.parametrize("words,percent", [(3, 85), (5, 80)])
def test_given_documents(spark, words, percent):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert got(near_dup.groups(docs, words, percent)) == brute(rows, words, percent)


def family(rng, n, words, edits, first):
    """n edited copies of one text, each with its own few edits."""
    base = [f"w{rng.randrange(5000)}" for _ in range(words)]
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
        out.append((first + i, " ".join(w)))
    return out


@pytest.mark.parametrize("block", [1024, 16])
def test_hot_families_and_chains(spark, block):
    """A large group of near copies around the threshold, a chain, and a
    passage that many otherwise different documents share."""
    rng = random.Random(8)
    rows = family(rng, 260, 120, 9, 1000) + family(rng, 120, 40, 6, 5000)
    chain = [f"c{i}" for i in range(100)]
    for i in range(30):  # each link replaces three words; far ends share little
        chain[i * 3:i * 3 + 3] = [f"d{i}a", f"d{i}b", f"d{i}c"]
        rows.append((100 + i, " ".join(chain)))
    passage = " ".join(f"p{i}" for i in range(60))
    rows += [(8000 + i, passage + " " + " ".join(f"q{rng.randrange(10**6)}" for _ in range(12 + i % 30)))
             for i in range(200)]
    rows += [(9000 + i, " ".join(f"r{rng.randrange(10**6)}" for _ in range(50))) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got(near_dup.groups(docs, 3, 85, block=block)) == brute(rows, 3, 85)


def test_odd_rows(spark):
    docs = docs_of(spark, [*ODD, "A b", "a B", "a b c", "A  B\tC", "x y z w", "x y z w v"])
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert got(near_dup.groups(docs, 3, 85)) == brute(rows, 3, 85)
    kept = near_dup.keep_one(docs, 3, 85)
    assert kept.columns == docs.columns
    exp = sorted({(repr(d), t or "") for (d, t) in rows
                  for x in brute(rows, 3, 85) if x[0] == d and x[3] and x[1] == len(shingle_tuples(t, 3))})
    assert sorted((repr(r.doc_id), r.text or "") for r in kept.collect()) == exp
    assert near_dup.groups(empty_docs(spark), 3, 85).collect() == []
    assert near_dup.keep_one(empty_docs(spark)).collect() == []


def test_one_document_of_a_group_is_kept_without_or_with_equal_ids(spark):
    """Groups whose ids are all NULL, groups with a NULL, and an id that stands on several texts."""
    def copies(name, n):
        base = [f"{name}{i}" for i in range(60)]
        return [" ".join([*base, f"end{k}"]) for k in range(n)]

    none, mixed, twice, other = (copies(x, 4) for x in ("n", "m", "t", "o"))
    rows = [(None, t) for t in none] + [(None, none[0])] + [(9, mixed[0])] + [(None, t) for t in mixed[1:]]
    rows += [(5, twice[0]), (5, twice[1]), (6, twice[2]), (5, other[0]), (3, other[1]), (None, ""), (None, "alone here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = near_dup.groups(docs, 3, 85).filter("kept").select("doc_id", "key").distinct()
    assert sorted((repr(r.doc_id) for r in found.collect())) == ["3", "5", "9", "None", "None", "None"]
    kept = [(r.doc_id, r.text) for r in near_dup.keep_one(docs, 3, 85).collect()]
    assert len(kept) == len(set(kept)) == 6
    for group, doc_id in ((none, None), (mixed, 9), (twice, 5), (other, 3)):
        assert [d for d, t in kept if t in group] == [doc_id]
    assert {(None, ""), (None, "alone here")} <= set(kept)


def test_whole_sets_do_not_cross_rows_without_id(spark):
    docs = spark.createDataFrame([(None, f"a{i} b{i} c{i}") for i in range(50)], "doc_id long, text string")
    rows = near_dup.signatures(docs, 3, 2, 3)
    plan = near_dup.whole_sets(docs, rows.select("class", "doc_id", "key"), 3)
    assert plan.count() == 50
    joins = plan._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Join Inner, .*_key", joins)


def test_shingle_sets():
    for text in [*ODD, "A b c D", "ÄB äb"]:
        for k in (3, 5):
            assert len(shingles.shingle_set(text, k)) == len(shingle_tuples(text, k))
    assert (shingles.shingle_set("A B c", 3) == shingles.shingle_set("a b\x0bC", 3)).all()
    assert near_dup.hashes_needed(85, 3) == 13 and near_dup.hashes_needed(100, 3) == 1


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 150)] + [(200, 201), (201, 200), (300, 300)]
    df = spark.createDataFrame(links, "a long, b long")
    roots = {r.node: r.root for r in components(df).collect()}
    assert roots == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 150)}, 200: 200, 201: 200}
    assert components(df.limit(0)).collect() == []


def test_query(spark):
    assert queries.op3_near_dup(spark, SF).dtypes == [
        ("doc_id", "bigint"), ("n_shingles", "bigint"), ("component_id", "bigint"), ("kept", "boolean")]
