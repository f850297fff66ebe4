"""Merkle manifest of a table, and every leaf's proof by a recursive climb.

Leaves are rows' digests.  Rows of one language form a tree, leaves in doc_id
order; the trees' roots, in order of language, form the top tree.  While a
level holds several nodes, every ``fanout`` consecutive ones (the last run:
what is left, even one) become the digest of their hexadecimal texts; a lone
leaf is its tree's root.

1. ``build`` makes ``stride`` levels a step: the ``fanout ** stride`` nodes
   under one ancestor are one bounded group, so a language of any size is many
   groups, and the levels are stored.
2. The stored levels become node rows, each linked to the ancestor where its
   step ends (the root of a language's tree is linked as a leaf of the top
   tree) and holding the siblings on the way.  A node row stands once per
   ``CHUNK`` consecutive leaves below it, so that the climb, which joins on
   (node, chunk), has no key with more than ``CHUNK`` leaves.
3. ``climb`` is one recursive Spark query: it starts from every leaf (or from
   the digest of its altered row), folds the digest with the siblings of a
   step, emits those siblings, and goes on from the ancestor.

NULL fields are '-'; a NULL language is a tree of its own and comes first; a
NULL doc_id comes first in its tree and is written '-'; rows that share
language and doc_id are leaves of their own, in order of their digest, so
repeated rows are neighbours with equal digests.  Empty and very long texts are
hashed like all others.  An empty table gives no rows; other columns are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dunegrid.llm.common import prepare, stored
from dunegrid.operators.ordering import with_position
from dunegrid.session import materialize

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Leaves that share one copy of a node row.
CHUNK = 256
TOP = 0  # number of the top tree; languages are 1, 2 ...


def leaf_digest(fields: Sequence[Column]) -> Column:
    """Hexadecimal SHA-256 of the fields, each '-' or UTF-8 byte count, ':', value."""
    parts = []
    for f in fields:
        s = f.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def leaves(docs: DataFrame, altered: Column, delta: int = 1) -> DataFrame:
    """lang, doc_id, leaf, start (binary digests): ``start`` is the digest of
    the row with ``delta`` more n_chars where ``altered`` holds, else the leaf."""
    plain = [F.col(c) for c in FIELDS]
    other = [(F.col(c) + F.lit(delta)).cast("long") if c == "n_chars" else F.col(c) for c in FIELDS]
    leaf = leaf_digest(plain)
    start = F.when(F.coalesce(altered, F.lit(False)), leaf_digest(other)).otherwise(leaf)
    return docs.select("lang", F.col("doc_id").cast("long").alias("doc_id"), F.unhex(leaf).alias("leaf"),
                       F.unhex(start).alias("start"))


def _text(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def _level(nodes: str, fanout: int) -> str:
    """The level above an array of hexadecimal digests."""
    return (f"transform(sequence(0, (size({nodes}) - 1) DIV {fanout}), "
            f"i -> sha2(array_join(slice({nodes}, CAST(i * {fanout} + 1 AS INT), {fanout}), ''), 256))")


def _steps(stride: int, fanout: int) -> Column:
    """Siblings (before, after) of the ``j``-th node and its ancestors, lowest first."""
    out = []
    for k in range(stride):
        at, first = f"(j DIV {fanout**k})", f"(j DIV {fanout**(k + 1)} * {fanout})"
        before = f"slice(l{k}, CAST({first} + 1 AS INT), CAST({at} - {first} AS INT))"
        after = f"slice(l{k}, CAST({at} + 2 AS INT), CAST({first} + {fanout - 1} - {at} AS INT))"
        out.append(f"struct(unhex(array_join({before}, '')) AS before, unhex(array_join({after}, '')) AS after)")
    return F.expr(f"slice(array({', '.join(out)}), 1, depth)")


def _stage(nodes: DataFrame, fanout: int, stride: int) -> DataFrame:
    """One row per group of ``fanout ** stride`` nodes of a tree that holds
    several: its members in order, their levels up to ``l<stride>`` and the
    number of levels (``depth``) it takes."""
    depth = " ".join(f"WHEN left <= {fanout**k} THEN {k}" for k in range(1, stride))
    groups = nodes.filter("left > 1").groupBy("tree", F.expr(f"idx DIV {fanout**stride}").alias("up_idx"), "left").agg(
        F.sort_array(F.collect_list(F.struct("idx", "hash", "lo", "hi", "row"))).alias("members"),
        F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    groups = groups.selectExpr("*", f"CASE {depth} ELSE {stride} END AS depth" if depth else f"{stride} AS depth",
                               "transform(members, m -> lower(hex(m.hash))) AS l0")
    for k in range(1, stride + 1):
        groups = groups.selectExpr("*", f"CASE WHEN depth >= {k} THEN {_level(f'l{k - 1}', fanout)} ELSE l{k - 1} END AS l{k}")
    return groups


def _above(groups: DataFrame, fanout: int, stride: int) -> DataFrame:
    """The nodes that the groups of a step end in."""
    return groups.selectExpr(
        "tree", "up_idx AS idx", f"(left - 1) DIV {fanout**stride} + 1 AS left", f"unhex(l{stride}[0]) AS hash",
        "lo", "hi", "CAST(NULL AS STRUCT<doc_id: BIGINT, start: BINARY>) AS row")


def _rows(groups: DataFrame, stage: int, fanout: int, stride: int) -> DataFrame:
    """Node rows of a step: the siblings up to its end, and the node there."""
    at = groups.selectExpr("*", "posexplode(members) AS (j, m)")
    return at.select("tree", F.lit(stage).alias("stage"), "m.*", _steps(stride, fanout).alias("steps"),
                     *_link(f"left <= {fanout**stride}", stage + 1, "up_idx"))


def _lone(nodes: DataFrame) -> DataFrame:
    """Node rows of trees with one leaf, which is the root."""
    none = "CAST(array() AS ARRAY<STRUCT<before: BINARY, after: BINARY>>) AS steps"
    return nodes.filter("left = 1").select("tree", F.lit(0).alias("stage"), "idx", "hash", "lo", "hi", "row",
                                           F.expr(none), *_link("true", 0, "0"))


def _link(last: str, stage: int, idx: str) -> list[Column]:
    """Where a node row leads: up its tree, from its root into the top tree, or nowhere."""
    ends = f"CASE WHEN NOT ({last}) THEN {{}} WHEN tree <> {TOP} THEN {{}} END"
    return [F.expr(ends.format("tree", TOP)).cast("long").alias("up_tree"),
            F.expr(ends.format(stage, 0)).cast("int").alias("up_stage"),
            F.expr(ends.format(idx, "tree - 1")).cast("long").alias("up_idx")]


def build(nodes: DataFrame, rows: int, fanout: int, stride: int) -> tuple[DataFrame, DataFrame]:
    """Node rows of all steps, and the trees' roots (nodes with left = 1)."""
    out, roots, stage = _lone(nodes), nodes.filter("left = 1"), 0
    while True:
        groups = stored(_stage(nodes, fanout, stride), "merkle-levels", rows)
        if groups.isEmpty():
            return out, roots
        out = out.unionByName(_rows(groups, stage, fanout, stride))
        nodes = _above(groups, fanout, stride)
        roots = roots.unionByName(nodes.filter("left = 1"))
        rows, stage = -(-rows // fanout**stride), stage + 1


@contextmanager
def _unbounded_recursion(spark: SparkSession) -> Iterator[None]:
    """A climb has a row per leaf and step, beyond the default limit of rows."""
    key = "spark.sql.cteRecursionRowLimit"
    old = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        yield
    finally:
        spark.conf.set(key, old)


CLIMB = """
WITH RECURSIVE climb AS (
  SELECT lo AS g, lo DIV {chunk} AS chunk, 0 AS step, tree, stage, hash, up_tree, up_stage, up_idx, row.doc_id AS doc_id,
         aggregate(steps, X'', (a, s) -> concat(a, s.before, s.after)) AS siblings,
         aggregate(steps, lower(hex(row.start)),
                   (a, s) -> sha2(concat(lower(hex(s.before)), a, lower(hex(s.after))), 256)) AS folded
  FROM {leaf_rows}
  UNION ALL
  SELECT c.g, c.chunk, c.step + 1, n.tree, n.stage, n.hash, n.up_tree, n.up_stage, n.up_idx, CAST(NULL AS BIGINT),
         aggregate(n.steps, X'', (a, s) -> concat(a, s.before, s.after)),
         aggregate(n.steps, c.folded,
                   (a, s) -> sha2(concat(lower(hex(s.before)), a, lower(hex(s.after))), 256))
  FROM climb c JOIN {node_rows} n
    ON n.tree = c.up_tree AND n.stage = c.up_stage AND n.idx = c.up_idx AND n.chunk = c.chunk
)
SELECT g, step, tree, stage, hash, doc_id, siblings, folded, up_tree IS NULL AS ends FROM climb
"""


def climb(leaf_rows: DataFrame, node_rows: DataFrame) -> DataFrame:
    """g, step, tree, stage, hash, doc_id, siblings, folded, ends: a row per leaf and step."""
    spark = leaf_rows.sparkSession
    with _unbounded_recursion(spark):
        return materialize(spark.sql(CLIMB, chunk=CHUNK, leaf_rows=leaf_rows, node_rows=node_rows), "merkle-climb")


def manifest(docs: DataFrame, altered: Column, fanout: int = 2, stride: int = 6) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for every row."""
    spark = docs.sparkSession
    prepare(spark)
    at = with_position(leaves(docs, altered), ["lang", "doc_id", "leaf"], pos_col="g")
    n = at.count()
    trees = with_position(at.groupBy("lang").agg(F.count(F.lit(1)).alias("left"), F.min("g").alias("first")),
                          ["lang"], pos_col="tree").withColumnRenamed("lang", "_lang")
    nodes = at.join(trees, F.col("lang").eqNullSafe(F.col("_lang"))).select(
        "tree", (F.col("g") - F.col("first")).alias("idx"), "left", F.col("leaf").alias("hash"),
        F.col("g").alias("lo"), F.col("g").alias("hi"), F.struct("doc_id", "start").alias("row"))
    rows, subroots = build(nodes, n, fanout, stride)
    subroots = materialize(subroots.select("tree", "hash", "lo", "hi", "row"), "merkle-subroots")
    count = subroots.count()
    top_rows, root = build(subroots.select(
        F.lit(TOP).cast("long").alias("tree"), (F.col("tree") - 1).alias("idx"), F.lit(count).cast("long").alias("left"),
        "hash", "lo", "hi", F.lit(None).cast(subroots.schema["row"].dataType).alias("row")), count, fanout, stride)

    leaf_rows = rows.filter("stage = 0")
    upper = rows.filter("stage > 0").unionByName(top_rows).drop("row")
    # two steps, so that no array of chunks is long
    far = F.explode(F.sequence(F.floor(F.col("lo") / CHUNK), F.floor(F.col("hi") / CHUNK), F.lit(4096).cast("long")))
    near = F.explode(F.sequence("far", F.least(F.col("far") + 4095, F.floor(F.col("hi") / CHUNK))))
    upper = upper.withColumn("far", far).withColumn("chunk", near).drop("far", "lo", "hi")
    upper = stored(upper, "merkle-nodes", n // 8 + 1)
    steps = climb(leaf_rows, upper)

    per_leaf = steps.groupBy("g").agg(
        F.max("doc_id").alias("doc_id"),
        F.max(F.when(F.col("step") == 0, F.col("hash"))).alias("leaf"),
        F.max(F.when((F.col("tree") == TOP) & (F.col("stage") == 0), F.col("hash"))).alias("subroot"),
        F.max(F.when(F.col("ends"), F.col("folded"))).alias("folded_root"),
        F.sort_array(F.collect_list(F.struct("step", "siblings"))).alias("path"))
    proof = F.array_join(F.transform("path", lambda s: _text(s["siblings"])), "")
    one = F.broadcast(root.select(_text(F.col("hash")).alias("root")))  # a single row
    return per_leaf.crossJoin(one).select(
        "doc_id", _text(F.col("leaf")).alias("leaf"), _text(F.col("subroot")).alias("subroot"), "root",
        F.sha2(proof, 256).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"))


def every_seventh(doc_id: str = "doc_id") -> Column:
    """Rows whose decimal doc_id has a CRC-32 that 7 divides."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(7)) == 0
