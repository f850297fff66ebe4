"""Jenks natural breaks (optimal 1-D k-means) as Spark jobs.

The classes minimise the total within-class sum of squared deviations.  Data
never goes through one task or the driver:

1. compress: ``groupBy(value).count()`` -> (value, w) over distinct values
   (equal values always share a class; partial aggregation on the map side);
2. prefix sums W, S = sum w x, Q = sum w x^2 over the ordered distinct values
   with the distributed running sum of :mod:`dunegrid.operators.ordering`
   (values are shifted by the minimum first, which keeps integer data exact and
   limits cancellation);
3. dynamic programme over classes c = 2..k:
   cost_c(l) = min_{i < l} cost_{c-1}(i) + SSD(i+1..l), with
   SSD(i+1..l) = (Q_l - Q_i) - (S_l - S_i)^2 / (W_l - W_i).
   The optimal split i*(l) is non-decreasing in l (the cost is a Monge
   array), so each layer is solved by divide and conquer: the middle l of a
   block is evaluated against its candidate range, which splits the block in
   two with narrower candidate ranges.  Every level is one Spark job over all
   open blocks (candidates are generated with ``sequence`` and equi-joined to
   the prefix and previous-layer tables); a block whose full candidate box is
   at most ``leaf_pairs`` is evaluated in one go.  Work per layer is
   O(n log n) candidate rows instead of O(n^2); the result is exact.
4. back-track the split points (k - 1 point look-ups) -> break values.

Each level and layer is checkpointed (reliable checkpoint folder) so lineage
stays short and a lost executor only recomputes one level.

Semantics (documented deviations from the original heap implementation):
breaks are [min, upper bound of class 1, ..., upper bound of class k-1, max];
if the first two breaks are equal the first becomes 0; ties between equal
costs take the smallest split.  The original could never put exactly one
element in the first class (its first-class cost at one element stayed +inf);
``compat_first_class=True`` reproduces that.  Fewer distinct values than k,
an empty input or k <= 1 raise ``ValueError``.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dunegrid.operators.ordering import with_position
from dunegrid.operators.stats import value_counts
from dunegrid.session import checkpoint_dir, ensure_on_executors, materialize

INF = float("inf")


def _prefix_table(df: DataFrame, col: str) -> tuple[DataFrame, int, float]:
    # one pass over the source: the compressed (value, count) table is written
    # and every later step (bounds, range sampling, running sums) reads it
    vc = materialize(value_counts(df, col), "jenks-values")
    stats = vc.agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("lo")).first()
    n, lo = int(stats["n"]), stats["lo"]
    if n == 0:
        raise ValueError("jenks: no data values")
    x = F.col("value") - F.lit(float(lo))
    vc = vc.select("value", F.col("w").cast("double").alias("w"),
                   (F.col("w") * x).alias("wx"), (F.col("w") * x * x).alias("wxx"))
    pos = with_position(vc, ["value"], ["w", "wx", "wxx"])
    spark = df.sparkSession
    zero = spark.createDataFrame([(0, None, 0.0, 0.0, 0.0)],
                                 "pos long, value double, W double, S double, Q double")
    prefix = pos.select(F.col("pos").cast("long").alias("pos"), F.col("value").cast("double").alias("value"),
                        F.col("cum_w").alias("W"), F.col("cum_wx").alias("S"), F.col("cum_wxx").alias("Q"))
    prefix = materialize(prefix.unionByName(zero), "jenks-prefix")
    return prefix, n, lo


def _ssd(Wl, Sl, Ql, Wi, Si, Qi):
    ds = Sl - Si
    return (Ql - Qi) - ds * ds / (Wl - Wi)


def _layer_table(prev: DataFrame, prefix: DataFrame, chunk: int) -> DataFrame:
    """Position i with its prefix sums and the previous layer's cost (both are
    stored tables), and the number of its chunk of ``chunk`` positions."""
    pv = prev.select(F.col("l").alias("pos"), F.col("cost").alias("prev_cost"))
    return prefix.join(pv, "pos").select(
        F.floor(F.col("pos") / chunk).cast("long").alias("chunk"), F.col("pos").alias("i"),
        F.col("W").alias("Wi"), F.col("S").alias("Si"), F.col("Q").alias("Qi"), "prev_cost")


def _evaluate(split_rows: DataFrame, table: DataFrame, prefix: DataFrame, chunk: int) -> DataFrame:
    """Split points (l, i_lo, i_hi) against their whole candidate ranges ->
    best (l, cost, arg) per l; ties -> smallest i.

    The few split points get their prefix sums first and are sent to the chunks
    of positions they cover; the (l, i) pairs exist only inside that join and
    are reduced to one row per task and l before anything is shuffled on l.
    """
    ie = F.least(F.col("i_hi"), F.col("l") - 1)
    points = split_rows.select("l", "i_lo", ie.alias("ie")).filter("i_lo <= ie").join(
        prefix.select(F.col("pos").alias("l"), F.col("W").alias("Wl"), F.col("S").alias("Sl"),
                      F.col("Q").alias("Ql")), "l")
    points = points.withColumn("chunk", F.explode(F.sequence(
        F.floor(F.col("i_lo") / chunk).cast("long"), F.floor(F.col("ie") / chunk).cast("long"))))
    j = table.join(points, "chunk").filter(F.col("i").between(F.col("i_lo"), F.col("ie")))
    cost = F.col("prev_cost") + _ssd(F.col("Wl"), F.col("Sl"), F.col("Ql"),
                                     F.col("Wi"), F.col("Si"), F.col("Qi"))
    best = j.groupBy("l").agg(F.min(F.struct(cost.alias("cost"), F.col("i").alias("arg"))).alias("b"))
    return best.select("l", F.col("b.cost").alias("cost"), F.col("b.arg").alias("arg"))


_LEAF_SCHEMA = "l long, cost double, arg long"
_LEAF_CELLS_PER_STEP = 1 << 20


def _leaf_block(pdf: pd.DataFrame) -> pd.DataFrame:
    """Solve one block exactly: every (l, i) of the block's box, i < l.

    Arithmetic is the same element-wise IEEE sequence as the Spark and SQL
    forms (prev + ((Ql - Qi) - (Sl - Si)^2 / (Wl - Wi))); ``argmin`` takes the
    first (smallest) i among equal costs.
    """
    ls = pdf[pdf["role"] == 0].sort_values("pos")
    cs = pdf[pdf["role"] == 1].sort_values("pos")
    if ls.empty:
        return pd.DataFrame({"l": [], "cost": [], "arg": []})
    ip = cs["pos"].to_numpy()[None, :]
    Wi, Si, Qi = (cs[c].to_numpy()[None, :] for c in ("W", "S", "Q"))
    prev = cs["prev_cost"].to_numpy()[None, :]
    l_pos = ls["pos"].to_numpy()
    W_all, S_all, Q_all = (ls[c].to_numpy() for c in ("W", "S", "Q"))
    best_cost = np.empty(len(ls))
    best_arg = np.empty(len(ls), dtype="int64")
    step = max(1, _LEAF_CELLS_PER_STEP // max(1, ip.shape[1]))
    for a in range(0, len(ls), step):  # bounded temporaries: step x |I| cells at a time
        b = min(len(ls), a + step)
        lp = l_pos[a:b, None]
        Wl, Sl, Ql = W_all[a:b, None], S_all[a:b, None], Q_all[a:b, None]
        with np.errstate(all="ignore"):
            ds = Sl - Si
            cost = prev + ((Ql - Qi) - ds * ds / (Wl - Wi))
        cost = np.where(ip < lp, cost, np.inf)
        k = np.argmin(cost, axis=1)
        best_cost[a:b] = cost[np.arange(b - a), k]
        best_arg[a:b] = cs["pos"].to_numpy()[k]
    return pd.DataFrame({"l": l_pos.astype("int64"), "cost": best_cost, "arg": best_arg})


def _solve_leaves(leaves: DataFrame, prev: DataFrame, prefix: DataFrame) -> DataFrame:
    """Route each leaf block's l rows and candidate rows to one group and
    solve it in numpy; a block has at most ``leaf_pairs`` (l, i) cells."""
    lrows = (leaves.select(F.col("l_lo").alias("task"), F.explode(F.sequence("l_lo", "l_hi")).alias("pos"))
             .join(prefix.select("pos", "W", "S", "Q"), "pos")
             .select("task", F.lit(0).alias("role"), "pos", "W", "S", "Q",
                     F.lit(None).cast("double").alias("prev_cost")))
    irows = (leaves.select(F.col("l_lo").alias("task"),
                           F.explode(F.sequence("i_lo", F.least(F.col("i_hi"), F.col("l_hi") - 1))).alias("pos"))
             .join(prefix.select("pos", "W", "S", "Q"), "pos")
             .join(prev.select(F.col("l").alias("pos"), F.col("cost").alias("prev_cost")), "pos")
             .select("task", F.lit(1).alias("role"), "pos", "W", "S", "Q", "prev_cost"))
    return lrows.unionByName(irows).groupBy("task").applyInPandas(_leaf_block, _LEAF_SCHEMA)


def _solve_layer(prev: DataFrame, prefix: DataFrame, tasks: DataFrame, leaf_pairs: int, chunk: int, fanout: int,
                 max_group_rows: int = 1 << 18) -> DataFrame:
    """cost_c(l) for the l of ``tasks`` (l_lo, l_hi, i_lo, i_hi: blocks of l with
    their candidates) from the previous layer.

    A block whose (l, i) box exceeds ``leaf_pairs`` (or whose rows exceed
    ``max_group_rows``) is cut at ``fanout - 1``
    split points, which are evaluated against their whole candidate range in
    one Spark job; the optimal splits bound the candidate ranges of the
    sub-blocks (monotone optimum).  Blocks within the bound are solved
    exactly in one grouped-map job.
    """
    parts: list[DataFrame] = []
    table = None  # made for the first split level only: a small layer is one leaf

    def leaf_flag(t):
        w_i = F.least(F.col("i_hi"), F.col("l_hi") - 1) - F.col("i_lo") + 1
        n_rows = F.col("l_hi") - F.col("l_lo") + 1
        return (n_rows * w_i <= F.lit(leaf_pairs)) & (n_rows + w_i <= F.lit(max_group_rows))

    def shape(t):
        flag = leaf_flag(t)
        return t.agg(F.coalesce(F.sum(flag.cast("int")), F.lit(0)), F.coalesce(F.sum((~flag).cast("int")), F.lit(0))).first()

    n_leaf, n_split = shape(tasks)
    while True:
        t = tasks.withColumn("leaf", leaf_flag(tasks))
        if n_leaf:
            parts.append(materialize(_solve_leaves(t.filter("leaf"), prev, prefix), "jenks-leaf"))
        if not n_split:
            break
        sp = t.filter(~F.col("leaf"))
        n_l = F.col("l_hi") - F.col("l_lo") + 1
        m = F.least(F.lit(fanout), n_l)
        points = F.array_distinct(F.transform(
            F.sequence(F.lit(1), m - 1),
            lambda j: F.col("l_lo") + F.floor(j * n_l / m).cast("long")))
        split_rows = sp.select("l_lo", "l_hi", "i_lo", "i_hi", F.explode(points).alias("l"))
        if table is None:
            table = _layer_table(prev, prefix, chunk)
        found = materialize(_evaluate(split_rows, table, prefix, chunk), "jenks-split")
        parts.append(found)
        # sub-blocks between consecutive split points (with the block ends as sentinels)
        marks = (split_rows.join(found, "l").select("l_lo", F.col("l").alias("p"), "arg")
                 .unionByName(sp.select("l_lo", (F.col("l_lo") - 1).alias("p"), F.col("i_lo").alias("arg")))
                 .unionByName(sp.select("l_lo", (F.col("l_hi") + 1).alias("p"), F.col("i_hi").alias("arg"))))
        w = Window.partitionBy("l_lo").orderBy("p")
        nxt = marks.select("p", "arg", F.lead("p").over(w).alias("np"), F.lead("arg").over(w).alias("na"))
        tasks = materialize(
            nxt.filter(F.col("np").isNotNull() & (F.col("p") + 1 <= F.col("np") - 1))
            .select((F.col("p") + 1).alias("l_lo"), (F.col("np") - 1).alias("l_hi"),
                    F.col("arg").alias("i_lo"), F.col("na").alias("i_hi")), "jenks-tasks")
        n_leaf, n_split = shape(tasks)
        if not n_leaf and not n_split:
            break
    if not parts:  # no block at all
        return prev.sparkSession.createDataFrame([], _LEAF_SCHEMA)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def jenks_breaks(df: DataFrame, col: str, k: int, compat_first_class: bool = False,
                 leaf_pairs: int = 1 << 24, chunk: int = 1 << 14, fanout: int = 64) -> list[float]:
    """Natural breaks of ``col`` into ``k`` classes: k + 1 break values."""
    if k <= 1:
        raise ValueError("jenks: the number of classes must be greater than 1")
    spark = df.sparkSession
    checkpoint_dir(spark)
    ensure_on_executors(spark)
    prefix, n, lo = _prefix_table(df, col)
    if n < k:
        raise ValueError(f"jenks: {n} distinct values cannot form {k} classes")
    # layer 1: one class over the first l values
    ssd1 = _ssd(F.col("W"), F.col("S"), F.col("Q"), F.lit(0.0), F.lit(0.0), F.lit(0.0))
    if compat_first_class:
        ssd1 = F.when((F.col("pos") == 1) & (F.col("W") == 1.0), F.lit(INF)).otherwise(ssd1)
    layer = prefix.filter(F.col("pos") >= 1).select(
        F.col("pos").alias("l"), ssd1.alias("cost"), F.lit(0).cast("long").alias("arg"))
    layers = [layer]
    for c in range(2, k + 1):
        # the last layer is only needed at l = n; earlier ones leave room for
        # the classes still to come
        l_lo = n if c == k else c
        l_hi = n - (k - c)
        block = spark.createDataFrame([(l_lo, l_hi, c - 1, l_hi - 1)], "l_lo long, l_hi long, i_lo long, i_hi long")
        layer = _solve_layer(layer, prefix, block, leaf_pairs, chunk, fanout)
        layers.append(layer)
    # back-track: end position of each class
    ends = [n]
    pos = n
    for c in range(k, 1, -1):
        row = layers[c - 1].filter(F.col("l") == pos).select("arg").first()
        pos = int(row["arg"])
        ends.append(pos)
    ends = sorted(ends)  # [e_1, ..., e_{k-1}, n]
    vals = {int(r["pos"]): float(r["value"]) for r in
            prefix.filter(F.col("pos").isin([1] + ends)).select("pos", "value").collect()}
    breaks = [vals[1]] + [vals[e] for e in ends]
    if breaks[0] == breaks[1]:
        breaks[0] = 0.0
    return breaks


def jenks_breaks_df(df: DataFrame, col: str, k: int, **kw) -> DataFrame:
    """Break values as a DataFrame (break_index, break_value)."""
    b = jenks_breaks(df, col, k, **kw)
    return df.sparkSession.createDataFrame([(i, float(v)) for i, v in enumerate(b)],
                                           "break_index int, break_value double")


def jenks_breaks_by(df: DataFrame, col: str, k: int, keys: Sequence[str], leaf_pairs: int = 1 << 24,
                    chunk: int = 1 << 14, fanout: int = 64) -> DataFrame:
    """Natural breaks of every group of ``keys``: keys, break_index, break_value.

    The groups' distinct values stand one after another on one axis of
    positions, with running sums that go on across them (differences inside a
    group are all that a cost reads), so every layer solves the blocks of all
    groups in the same jobs and the back-track is a join per class.  A group
    with fewer than ``k`` distinct values gets one class per value; a group
    without values gets no row; NULL keys are a group.
    """
    if k <= 1:
        raise ValueError("jenks: the number of classes must be greater than 1")
    spark, keys = df.sparkSession, list(keys)
    checkpoint_dir(spark)
    ensure_on_executors(spark)
    counts = materialize(df.filter(F.col(col).isNotNull()).groupBy(*keys, F.col(col).cast("double").alias("value")).agg(
        F.count(F.lit(1)).alias("w")), "jenks-values")
    groups = with_position(counts.groupBy(*keys).agg(F.min("value").alias("_lo"), F.count(F.lit(1)).alias("_n")), keys,
                           pos_col="_g")
    named = groups.select("_g", "_lo", *[F.col(x).alias(f"_k{i}") for i, x in enumerate(keys)])
    same = [F.col(x).eqNullSafe(F.col(f"_k{i}")) for i, x in enumerate(keys)]
    on = same[0]
    for s in same[1:]:
        on = on & s
    x, w = F.col("value") - F.col("_lo"), F.col("w").cast("double")
    rows = counts.join(named, on).select("_g", "value", w.alias("w"), (w * x).alias("wx"), (w * x * x).alias("wxx"))
    pos = with_position(rows, ["_g", "value"], ["w", "wx", "wxx"])
    zero = spark.createDataFrame([(0, 0, None, 0.0, 0.0, 0.0)],
                                 "_g long, pos long, value double, W double, S double, Q double")
    prefix = materialize(pos.select(F.col("_g").cast("long").alias("_g"), F.col("pos").cast("long").alias("pos"), "value",
                                    F.col("cum_w").alias("W"), F.col("cum_wx").alias("S"),
                                    F.col("cum_wxx").alias("Q")).unionByName(zero), "jenks-prefix")
    # a group's positions, its number of classes, and the sums before it
    spans = prefix.filter("pos > 0").groupBy("_g").agg(F.min("pos").alias("first"), F.max("pos").alias("last"))
    spans = spans.withColumn("classes", F.least(F.lit(k).cast("long"), F.col("last") - F.col("first") + 1))
    start = prefix.select((F.col("pos") + 1).alias("first"), F.col("W").alias("W0"), F.col("S").alias("S0"), F.col("Q").alias("Q0"))
    spans = materialize(spans.join(start, "first"), "jenks-groups")
    one = prefix.join(spans.select("_g", "W0", "S0", "Q0"), "_g")
    layers = [one.select(F.col("pos").alias("l"), _ssd(F.col("W"), F.col("S"), F.col("Q"), F.col("W0"), F.col("S0"),
                                                       F.col("Q0")).alias("cost"), F.lit(0).cast("long").alias("arg"))]
    before = F.col("first") - 1
    for c in range(2, k + 1):
        # as for one group: room for the classes still to come, and only the end of a group's last layer
        hi = F.col("last") - (F.col("classes") - c)
        lo = F.when(F.col("classes") == c, F.col("last")).otherwise(before + c)
        tasks = spans.filter(F.col("classes") >= c).select(
            lo.alias("l_lo"), hi.alias("l_hi"), (before + (c - 1)).alias("i_lo"), (hi - 1).alias("i_hi"))
        layers.append(_solve_layer(layers[-1], prefix.drop("_g"), materialize(tasks, "jenks-tasks"), leaf_pairs, chunk, fanout))
    ends = at = spans.select("_g", F.col("classes").alias("break_index"), F.col("last").alias("pos"))
    for c in range(k, 1, -1):
        step = at.filter(F.col("break_index") == c).join(layers[c - 1].select(F.col("l").alias("pos"), "arg"), "pos")
        at = at.filter(F.col("break_index") < c).unionByName(
            step.select("_g", F.lit(c - 1).cast("long").alias("break_index"), F.col("arg").alias("pos")))
        at = materialize(at, "jenks-back")
        ends = ends.unionByName(at.filter(F.col("break_index") == c - 1).join(
            spans.filter(F.col("classes") > c - 1).select("_g"), "_g", "left_semi"))
    ends = ends.unionByName(spans.select("_g", F.lit(0).cast("long").alias("break_index"), F.col("first").alias("pos")))
    values = ends.join(prefix.select("pos", "value"), "pos").select("_g", F.col("break_index").cast("int").alias("break_index"), "value")
    second = values.filter("break_index = 1").select("_g", F.col("value").alias("_second"))
    rule = F.when((F.col("break_index") == 0) & (F.col("value") == F.col("_second")), F.lit(0.0)).otherwise(F.col("value"))
    return values.join(second, "_g").join(groups.select("_g", *keys), "_g").select(*keys, "break_index", rule.alias("break_value"))


def classify(df: DataFrame, col: str, breaks: Sequence[float], out: str = "class") -> DataFrame:
    """Class 1..k per value with right-closed classes (b_{j-1}, b_j]."""
    from dunegrid.operators.mask import class_when
    return df.withColumn(out, class_when(F.col(col), breaks))


def jenks_sql(values_sql: str, k: int, lead: Sequence[tuple[str, str]] = (),
              classify_sql: str | None = None) -> str:
    """Brute-force DuckDB SQL for the oracle: full O(n^2) layers, same formulas.

    ``values_sql`` must expose a ``value`` column; ``lead`` CTEs come first.
    With ``classify_sql`` (exposing ``value`` and other columns) the result is
    the classified rows instead of the breaks.
    """
    ctes = list(lead) + [
        ("vals", f"SELECT value, count(*)::DOUBLE AS w FROM ({values_sql}) s WHERE value IS NOT NULL GROUP BY value"),
        ("shifted", "SELECT value, w, w * (value - (SELECT min(value) FROM vals)) AS wx, "
                    "w * (value - (SELECT min(value) FROM vals)) * (value - (SELECT min(value) FROM vals)) AS wxx FROM vals"),
        ("pre", "SELECT row_number() OVER (ORDER BY value) AS pos, value, "
                "sum(w) OVER (ORDER BY value ROWS UNBOUNDED PRECEDING) AS W, "
                "sum(wx) OVER (ORDER BY value ROWS UNBOUNDED PRECEDING) AS S, "
                "sum(wxx) OVER (ORDER BY value ROWS UNBOUNDED PRECEDING) AS Q FROM shifted"),
        ("p", "SELECT pos, value, W, S, Q FROM pre UNION ALL SELECT 0, NULL, 0.0, 0.0, 0.0"),
        ("L1", "SELECT pos AS l, (Q - 0.0) - (S - 0.0) * (S - 0.0) / (W - 0.0) AS cost FROM p WHERE pos >= 1"),
    ]
    for c in range(2, k + 1):
        ctes.append((f"C{c}", f"""
SELECT a.pos AS l, b.pos AS i,
       prev.cost + ((a.Q - b.Q) - (a.S - b.S) * (a.S - b.S) / (a.W - b.W)) AS cost
FROM p a JOIN p b ON b.pos >= {c - 1} AND b.pos < a.pos JOIN L{c - 1} prev ON prev.l = b.pos
WHERE a.pos >= {c}"""))
        ctes.append((f"M{c}", f"SELECT l, min(cost) AS cost FROM C{c} GROUP BY l"))
        ctes.append((f"L{c}", f"SELECT C{c}.l, M{c}.cost, min(C{c}.i) AS arg FROM C{c} JOIN M{c} "
                              f"ON C{c}.l = M{c}.l AND C{c}.cost = M{c}.cost GROUP BY C{c}.l, M{c}.cost"))
    ctes.append(("n", "SELECT max(pos) AS n FROM p"))
    ends = {k: "(SELECT n FROM n)"}
    for c in range(k, 1, -1):
        ends[c - 1] = f"(SELECT arg FROM L{c} WHERE l = {ends[c]})"
    rows = ["SELECT 0 AS break_index, (SELECT value FROM p WHERE pos = 1) AS bv"]
    for j in range(1, k + 1):
        rows.append(f"SELECT {j}, (SELECT value FROM p WHERE pos = {ends[j]})")
    ctes.append(("raw", " UNION ALL ".join(rows)))
    ctes.append(("breaks", """
SELECT CAST(break_index AS INT) AS break_index,
       CASE WHEN break_index = 0 AND bv = (SELECT bv FROM raw WHERE break_index = 1) THEN 0.0 ELSE bv END AS break_value
FROM raw"""))
    if classify_sql is None:
        body = "SELECT break_index, break_value FROM breaks"
    else:
        body = f"""
SELECT q.*, CASE WHEN q.value IS NULL THEN NULL ELSE CAST(1 + (SELECT count(*) FROM breaks
       WHERE break_index BETWEEN 1 AND {k - 1} AND break_value < q.value) AS INT) END AS class
FROM ({classify_sql}) q"""
    parts = ",\n".join(f"{nme} AS ({sql.strip()})" for nme, sql in ctes)
    return f"WITH {parts}\n{body.strip()}"
