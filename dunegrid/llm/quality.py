"""Sparse rule ensemble that scores text quality.

1. ``statistics`` of a text are Spark column expressions (shares of capitals,
   marks, digits, distinct words, word and line lengths ...).
2. A small forest is grown on a bounded sample of labelled rows; every path
   from a root to a node is a conjunctive rule over the statistics.
3. A logistic model with an L1 penalty weighs the rules; most weights become 0.
4. The rules left are compiled into one Spark column expression, so scoring is
   a single scan without Python.

Labels are learned only from rows outside the held-out fold, and from about
``sample_rows`` of them at most (a share chosen by the hash of doc_id); doc_id,
lang, source and labels are no statistics.  A NULL text is empty; empty and
very long texts are scored like any other; a NULL doc_id is not held out;
repeated rows score alike; several labels of one doc_id count by the smaller.
Without labelled rows, with labels of one class, or where no statistic tells the
classes apart, every score is the smoothed share of label 1.  An empty table gives no rows; other columns are kept.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dunegrid.llm.common import prepare, text_or_empty
from dunegrid.session import materialize

Rule = tuple[tuple[str, str, float], ...]  # (statistic, "<=" or ">", threshold), all of which hold
FOLDS, HELD_OUT_FOLD = 4, 2
#: Steps of a sample's share, many more than there are labels.
PLACES = 1 << 40


def held_out(doc_id: str = "doc_id") -> Column:
    fold = F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(FOLDS))
    return F.coalesce(fold == HELD_OUT_FOLD, F.lit(False))


def _left(text: Column, drop: str) -> Column:
    """Characters left when those of class ``drop`` are taken out."""
    return F.length(F.regexp_replace(text, f"[{drop}]+", ""))


def statistics(text: Column) -> dict[str, Column]:
    n = F.greatest(F.length(text), F.lit(1))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n_words = F.greatest(F.size(words), F.lit(1))
    lines = F.split(text, "\n")
    return {
        "log_words": F.log1p(F.size(words).cast("double")),
        "word_length": F.length(text) / n_words,
        "distinct_words": F.size(F.array_distinct(words)) / n_words,
        "distinct_root": F.size(F.array_distinct(words)) / F.sqrt(n_words),
        "capitals": _left(text, r"^\p{Lu}") / n,
        "digits": _left(text, "^0-9") / n,
        "marks": _left(text, r"\p{L}\p{N}\s.,") / n,
        "stops": _left(text, "^.,") / n_words,
        "line_words": n_words / F.size(lines),
        "distinct_lines": F.size(F.array_distinct(lines)) / F.size(lines),
    }


STATISTICS = ["log_words", "word_length", "distinct_words", "distinct_root", "capitals", "digits", "marks",
              "stops", "line_words", "distinct_lines"]


def with_statistics(df: DataFrame, text: str = "text", to: str = "_stats") -> DataFrame:
    """Add one struct column of statistics, so that names cannot clash."""
    return df.withColumn(to, F.struct(*[c.cast("double").alias(k)
                                        for k, c in statistics(text_or_empty(text)).items()]))


@dataclass(frozen=True)
class RuleModel:
    intercept: float
    rules: tuple[tuple[Rule, float], ...]

    def score(self, stats: str = "_stats") -> Column:
        total = F.lit(float(self.intercept))
        for rule, weight in self.rules:
            total = total + F.when(condition(rule, stats), F.lit(float(weight))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def condition(rule: Rule, stats: str = "_stats") -> Column:
    out = None
    for name, op, at in rule:
        c = F.col(f"{stats}.{name}")
        c = c <= F.lit(at) if op == "<=" else c > F.lit(at)
        out = c if out is None else out & c
    return out


def simplify(path: list[tuple[str, str, float]]) -> Rule:
    """One bound per statistic and side, the tightest."""
    best: dict[tuple[str, str], float] = {}
    for name, op, at in path:
        old = best.get((name, op))
        best[name, op] = at if old is None else (min(old, at) if op == "<=" else max(old, at))
    return tuple(sorted((n, o, v) for (n, o), v in best.items()))


def tree_rules(debug: str, names: list[str]) -> list[Rule]:
    """The conjunction of every path from a root to a node, from a tree's printed form."""
    out: list[Rule] = []
    path: list[tuple[int, tuple[str, str, float]]] = []
    for line in debug.splitlines():
        m = re.match(r"(\s*)(?:If|Else) \(feature (\d+) (<=|>) ([-+.\dEe]+)\)", line)
        if m:
            depth = len(m[1])
            path = [p for p in path if p[0] < depth] + [(depth, (names[int(m[2])], m[3], float(m[4])))]
            out.append(simplify([p[1] for p in path]))
    return out


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000, trees: int = 16, depth: int = 3,
        penalty: float = 2e-4, seed: int = 3) -> RuleModel:
    """Learn ``quality`` of ``labels`` (doc_id, quality) from ``docs`` (doc_id, text)."""
    prepare(docs.sparkSession)
    known = (labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("quality").cast("double").alias("_y"))
             .filter(F.col("_id").isNotNull() & F.col("_y").isin(0.0, 1.0) & ~held_out("_id"))
             .groupBy("_id").agg(F.min("_y").alias("_y")))
    n = known.count()
    share = min(1.0, sample_rows / max(1, n))
    known = known.filter(F.pmod(F.xxhash64(F.lit(seed), "_id"), F.lit(PLACES)) < math.ceil(share * PLACES))
    # about sample_rows ids at most, so they are broadcast
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), "text").join(F.broadcast(known), "_id")
    train = materialize(with_statistics(rows).select("_y", "_stats"), "quality-train")
    count, ones = train.agg(F.count(F.lit(1)), F.coalesce(F.sum("_y"), F.lit(0.0))).first()
    smoothed = (ones + 1) / (count + 2)
    constant = RuleModel(math.log(smoothed / (1 - smoothed)), ())
    if ones in (0, count):
        return constant
    flat = train.select("_y", *[F.col(f"_stats.{s}").alias(s) for s in STATISTICS])
    vectors = VectorAssembler(inputCols=STATISTICS, outputCol="_x").transform(flat).select("_y", "_x")
    forest = RandomForestClassifier(featuresCol="_x", labelCol="_y", numTrees=trees, maxDepth=depth,
                                    featureSubsetStrategy="onethird", seed=seed).fit(vectors)
    rules = sorted({r for t in forest.trees for r in tree_rules(t.toDebugString, STATISTICS)})
    if not rules:  # no statistic tells the classes apart
        return constant
    cols = [F.when(condition(r), 1.0).otherwise(0.0).alias(f"r{k}") for k, r in enumerate(rules)]
    hits = materialize(train.select("_y", F.array(*cols).alias("_hits")), "quality-hits")
    lasso = LogisticRegression(featuresCol="_x", labelCol="_y", elasticNetParam=1.0, regParam=penalty,
                               standardization=False, maxIter=60)
    model = lasso.fit(hits.select("_y", array_to_vector("_hits").alias("_x")))
    kept = tuple((r, float(w)) for r, w in zip(rules, model.coefficients) if abs(w) > 1e-6)
    return RuleModel(float(model.intercept), kept)


def score(docs: DataFrame, model: RuleModel) -> DataFrame:
    """doc_id, held_out, score, predicted (1 from 0.7 on)."""
    rows = with_statistics(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return rows.select("doc_id", held_out().alias("held_out"), model.score().alias("score")).withColumn(
        "predicted", F.when(F.col("score") >= 0.7, 1).otherwise(0))


def keep_good(docs: DataFrame, model: RuleModel, least: float = 0.7) -> DataFrame:
    """Rows of ``docs`` that score at least ``least``."""
    rows = docs.select(F.struct("*").alias("row"), F.col("text").alias("_text"))
    return with_statistics(rows, "_text").filter(model.score() >= least).select("row.*")
