"""The pipeline's stages, each on its own input, against brute force."""

from collections import Counter, defaultdict

import corpus_pipeline as P
import __spark_entry__ as E
from dunegrid.llm import mixing, quality
from tests.llm.test_files import SF, WORD, check_mix, check_packing, expect_tokens
from tests.llm.test_near_dup import brute


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    steps = [docs]
    for name, stage in P.STAGES:
        stage(spark, steps[-1], SF).write.parquet(f"file://{tmp_path}/{name}")
        steps.append(spark.read.parquet(f"file://{tmp_path}/{name}"))
    given, good, single, mixed, packed = steps
    assert good.columns == single.columns == mixed.columns == columns

    model = quality.fit(given, spark.read.parquet(f"{SF}/labels.parquet"))
    expected = [r.doc_id for r in quality.score(given, model).collect() if r.predicted == 1]
    assert sorted(r.doc_id for r in good.collect()) == sorted(expected)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = set(expected)
    clean = [i for i, y in labels.items() if y == 1]
    assert sum(i in kept for i in clean) >= 0.98 * len(clean)
    junk = [i for i, y in labels.items() if y == 0]
    assert sum(i in kept for i in junk) <= 0.1 * len(junk)

    rows = [(r.doc_id, r.text) for r in good.collect()]
    assert sorted(r.doc_id for r in single.collect()) == [d for d, _, _, k in sorted(brute(rows, 5, 80)) if k]

    decided = mixing.decide(single).collect()
    check_mix(decided, single.collect(), lambda s, t: 0.05 * t + 50)
    times = Counter(r.doc_id for r in mixed.collect())
    assert times == Counter({r.doc_id: r.times for r in decided if r.times})

    rows = mixed.select("doc_id", "text").collect()
    texts = defaultdict(list)
    for r, ids in zip(rows, expect_tokens([r.text for r in rows], WORD, 2)):
        texts[r.doc_id].append(ids)
    padding, total = check_packing(packed.collect(), texts)
    assert padding == 0 and total == sum(len(x) // 4 for v in texts.values() for x in v)


def test_empty_documents(spark, tmp_path):
    for t in ("documents", "labels"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"file://{tmp_path}/{t}.parquet")
    assert E.queries()["pipeline"](spark, f"file://{tmp_path}").collect() == []


def test_ten_operators_are_registered():
    names = E.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
