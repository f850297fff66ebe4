"""Vectorising a class raster: connected regions of cells of one class.

Two cells touch when they share a side.  Two levels keep the graph small:

1. Inside a work tile (at most ``tile`` x ``tile`` cells) union by hooking and
   pointer jumping in numpy gives local regions, each with its cells, box and
   perimeter (the tile's border counts as an edge).
2. Cells on the borders of tiles meet their neighbours across them (an equi-join
   of border cells only); equal classes link two local regions.
3. The links are contracted on Spark: large-star and small-star rounds until
   every local region knows its component's least one.  What is joined is the
   border graph, never cells; a region that spans all tiles has many local
   regions but its smallest neighbour is a partial aggregate, so it is no hot
   key.
4. Local regions are added up per component (partial aggregates); each touching
   pair across a border takes two sides off the perimeter.

A component is named by its first cell in row order: row * 2**31 + column.
Cells without a class (NULL) and absent cells belong to no region; two rows of
one cell fail; cell coordinates must not be negative.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dunegrid.session import ensure_on_executors, materialize

LOCAL = ("label long, class long, cells long, col_min int, col_max int, row_min int, row_max int, perimeter long, "
         "border array<struct<c: int, r: int>>")


def label_grid(classes: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Flat index of the first cell of every cell's region (-1 where unknown)."""
    h, w = classes.shape
    index = np.arange(h * w).reshape(h, w)
    right = known[:, :-1] & known[:, 1:] & (classes[:, :-1] == classes[:, 1:])
    below = known[:-1] & known[1:] & (classes[:-1] == classes[1:])
    u = np.concatenate([index[:, :-1][right], index[:-1][below]])
    v = np.concatenate([index[:, 1:][right], index[1:][below]])
    root = index.ravel().copy()
    while len(u):
        a, b = root[u], root[v]
        apart = a != b
        if not apart.any():
            break
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:  # jump until every cell points at a root
            up = root[root]
            if (up == root).all():
                break
            root = up
    return np.where(known.ravel(), root, -1).reshape(h, w)


def _sides(label: np.ndarray) -> np.ndarray:
    """Sides of every cell that do not touch a cell of its region."""
    padded = np.pad(label, 1, constant_values=-2)
    mid = padded[1:-1, 1:-1]
    return sum((mid != x).astype(np.int64) for x in (padded[1:-1, :-2], padded[1:-1, 2:], padded[:-2, 1:-1], padded[2:, 1:-1]))


def local_regions(cells: DataFrame, class_col: str, tile: int, c: str = "c", r: str = "r") -> DataFrame:
    """Regions inside each tile (LOCAL), with their cells on the tile's border."""
    ensure_on_executors(cells.sparkSession)
    rows = cells.filter(F.col(class_col).isNotNull()).select(
        F.col(c).cast("int").alias("c"), F.col(r).cast("int").alias("r"), F.col(class_col).cast("long").alias("class"),
        F.floor(F.col(c) / tile).cast("int").alias("tc"), F.floor(F.col(r) / tile).cast("int").alias("tr"))

    def run(t: pa.Table) -> pa.Table:
        cc, rr, k = (t.column(x).to_numpy().astype(np.int64) for x in ("c", "r", "class"))
        if cc.min() < 0 or rr.min() < 0:
            raise ValueError("cell coordinates must not be negative")
        x, y = cc % tile, rr % tile
        known, classes = np.zeros((tile, tile), bool), np.zeros((tile, tile), np.int64)
        known[y, x], classes[y, x] = True, k
        if known.sum() < len(cc):
            raise ValueError("several rows for one cell")
        label = label_grid(classes, known)
        mine, first = label[y, x], np.zeros(tile * tile, np.int64)
        code = rr * 2**31 + cc
        first[y * tile + x] = code
        names, at = np.unique(mine, return_inverse=True)
        sides = _sides(label)[y, x]
        edge = (x == 0) | (x == tile - 1) | (y == 0) | (y == tile - 1)
        order = np.argsort(at[edge], kind="stable")
        ends = np.concatenate([[0], np.cumsum(np.bincount(at[edge], minlength=len(names)))])
        border = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(
            [pa.array(v[edge][order].astype("int32")) for v in (cc, rr)], ["c", "r"]))

        def by(f, v, start):
            out = np.full(len(names), start, np.int64)
            f.at(out, at, v)
            return out

        big = np.iinfo(np.int64).max
        columns = [first[names], by(np.maximum, k, -big), np.bincount(at, minlength=len(names)), by(np.minimum, cc, big),
                   by(np.maximum, cc, -1), by(np.minimum, rr, big), by(np.maximum, rr, -1),
                   by(np.add, sides, 0)]
        kinds = [pa.int64()] * 3 + [pa.int32()] * 4 + [pa.int64()]
        return pa.Table.from_arrays([*(pa.array(v.astype(k.to_pandas_dtype()), k) for v, k in zip(columns, kinds)), border],
                                    names=[f.split()[0] for f in LOCAL.split(", ")[:8]] + ["border"])

    return rows.groupBy("tc", "tr").applyInArrow(run, LOCAL)


def border_links(local: DataFrame, tile: int) -> DataFrame:
    """(a, b): labels of two local regions, one row per pair of touching cells across a border."""
    at = local.select("label", "class", F.explode("border").alias("p")).select("label", "class", "p.c", "p.r")
    steps = []
    for axis, other in (("c", "r"), ("r", "c")):
        near = at.filter((F.col(axis) % tile == 0) & (F.col(axis) > 0)).select(
            F.col("label").alias("a"), F.col("class").alias("_class"), (F.col(axis) - 1).alias(axis), F.col(other))
        far = at.filter(F.col(axis) % tile == tile - 1).select(F.col("label").alias("b"), "class", "c", "r")
        steps.append(near.join(far, ["c", "r"]).filter(F.col("_class") == F.col("class")).select("a", "b"))
    return steps[0].unionByName(steps[1])


def contract(links: DataFrame) -> DataFrame:
    """(label, component) of every label in ``links`` (a, b): the least label reachable.

    Rounds of large-star (a node's larger neighbours go to its least one) and
    small-star (its smaller ones do), each written to the shared folder, until
    every edge leads from a node to its component's least."""
    def ordered(e: DataFrame) -> DataFrame:
        return e.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    edges = materialize(ordered(links.select(F.col("a").alias("u"), F.col("b").alias("v"))), "region-links")
    while True:
        # settled: no node has two parents, and no parent has one
        parents = edges.groupBy(F.col("u").alias("node")).agg(F.count(F.lit(1)).alias("n"))
        if parents.filter("n > 1").isEmpty() and edges.join(parents, F.col("v") == F.col("node"), "left_semi").isEmpty():
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        edges = materialize(ordered(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))),
                            "region-large")
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        small = edges.join(least, "u")
        edges = materialize(ordered(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            small.select("u", F.col("m").alias("v")))), "region-small")
    return edges.select(F.col("u").alias("label"), F.col("v").alias("component"))


def class_regions(cells: DataFrame, class_col: str = "class", tile: int = 256, c: str = "c", r: str = "r") -> DataFrame:
    """component, class, cells, col_min, col_max, row_min, row_max, perimeter of every region."""
    local = materialize(local_regions(cells, class_col, tile, c, r), "local-regions")
    links = materialize(border_links(local, tile), "border-links")
    roots = contract(links)
    touching = links.groupBy(F.col("a").alias("label")).agg(F.count(F.lit(1)).alias("pairs"))
    rows = local.drop("border").join(touching, "label", "left").join(roots, "label", "left")
    return rows.groupBy(F.coalesce("component", "label").alias("component"), "class").agg(
        F.sum("cells").alias("cells"), F.min("col_min").alias("col_min"), F.max("col_max").alias("col_max"),
        F.min("row_min").alias("row_min"), F.max("row_max").alias("row_max"),
        F.sum(F.col("perimeter") - 2 * F.coalesce("pairs", F.lit(0))).alias("perimeter"))
