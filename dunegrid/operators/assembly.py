"""Band discovery, key tagging, band assembly and layer metadata.

Assembly never collects pixel lists per key: bands are placed into fixed band
columns with ``max(when(band_index = i, v))`` (a pivot over a known band list),
which Spark aggregates partially on the map side.  A duplicate band per key is
detected with a count and reported, not silently merged.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scene_of_path(path: Column | str) -> Column:
    """Scene id = name of the parent directory of a file path."""
    p = F.col(path) if isinstance(path, str) else path
    return F.element_at(F.split(p, "/"), -2)


def band_of_path(path: Column | str, pattern: str = r"_B(\d+)_REF\.TIF$") -> Column:
    """Landsat band number from a file name like ``..._B5_REF.TIF`` (NULL if none)."""
    p = F.col(path) if isinstance(path, str) else path
    s = F.regexp_extract(p, pattern, 1)
    return F.when(s != "", s.cast("int"))


def discover_band_files(paths: DataFrame, bands: Sequence[int], path_col: str = "path",
                        pattern: str = r"_B(\d+)_REF\.TIF$", strict: bool = True) -> DataFrame:
    """One file per (scene, requested band): (scene_id, band, band_index, path).

    ``band_index`` is the position of the band in the request (0-based).
    With ``strict`` every scene of *all* given files must have exactly one
    file per requested band, and there must be files; the check runs in the
    query's own job and fails it.
    """
    n = len(bands)
    asked = F.array_contains(F.array(*[F.lit(int(b)) for b in bands]), F.col("band"))
    files = (paths.select(F.col(path_col).alias("path")).distinct()
             .select(scene_of_path("path").alias("scene_id"),
                     band_of_path("path", pattern).alias("band"), "path"))
    if strict:
        # one aggregate over all scenes: a scene without any requested band
        # still has its row (and fails), a band with two files makes n_files > n
        one = F.struct("band", "path")
        scenes = files.groupBy("scene_id").agg(
            F.count(F.when(asked, 1)).alias("n_files"),
            F.count_distinct(F.when(asked, F.col("band"))).alias("n_bands"),
            F.collect_list(F.when(asked, one)).alias("found"))
        scenes = scenes.filter(_fail_if((F.col("n_files") != n) | (F.col("n_bands") != n),
                                        f"a scene does not have exactly one file for each of {n} bands"))
        # an empty listing has no scene row to fail on: one count row does it
        none = files.agg(F.count(F.lit(1)).alias("_n")).filter(
            _fail_if(F.col("_n") == 0, "no files")).select(
                F.lit(None).cast("string").alias("scene_id"),
                # never an entry, but not a constant, or the optimiser drops the check
                F.when(F.col("_n") < 0, F.array(F.struct(F.lit(0).alias("band"), F.lit("").alias("path")))).alias("found"))
        files = scenes.select("scene_id", "found").unionByName(none).select(
            "scene_id", F.explode("found").alias("f")).select("scene_id", "f.band", "f.path")
    else:
        files = files.filter(asked)
    return files.withColumn("band_index", tag_band_index(F.col("band"), bands))


def tag_band_index(band: Column, bands: Sequence[int]) -> Column:
    """Band index = position of the band in the requested list (0-based)."""
    return (F.array_position(F.array(*[F.lit(int(b)) for b in bands]), band) - 1).cast("int")


def _fail_if(cond: Column, message: str) -> Column:
    """Filter predicate that is always true but raises when ``cond`` holds, so
    a data check runs in the query's own job instead of a separate action."""
    return F.coalesce(F.when(cond, F.raise_error(F.lit(message))), F.lit(True))


def assemble_bands(df: DataFrame, n_bands: int, value_col: str = "v",
                   index_col: str = "band_index", path_col: str = "path",
                   x_col: str = "cx", y_col: str = "cy", digits: int = 5,
                   on_incomplete: str = "null", check_duplicates: bool = True) -> DataFrame:
    """Group single-band records into multiband records.

    Key = (parent directory of the path, centre rounded to ``digits``
    HALF_UP).  Output: scene_id, x, y, b0..b{n-1}, n_bands.
    ``on_incomplete``: 'null' keeps missing bands as NULL, 'drop' removes
    incomplete keys, 'error' raises.
    """
    if on_incomplete not in ("null", "drop", "error"):
        raise ValueError("on_incomplete must be null, drop or error")
    keyed = df.select(scene_of_path(path_col).alias("scene_id"),
                      F.round(F.col(x_col), digits).alias("x"),
                      F.round(F.col(y_col), digits).alias("y"),
                      F.col(index_col).alias("_bi"), F.col(value_col).alias("_v"))
    bands = [F.max(F.when(F.col("_bi") == i, F.col("_v"))).alias(f"b{i}") for i in range(n_bands)]
    # bands present, counted with one presence flag per band slot (no distinct
    # aggregate, so the aggregation stays a single partial + final pass)
    present = [F.coalesce(F.max(F.when(F.col("_bi") == i, F.lit(1))), F.lit(0)) for i in range(n_bands)]
    out = keyed.groupBy("scene_id", "x", "y").agg(
        *bands,
        sum(present[1:], present[0]).cast("long").alias("n_bands"),
        F.count(F.lit(1)).alias("_n_rec"))
    if check_duplicates:
        # checked inside the same job: a duplicate band record fails the query
        out = out.filter(_fail_if(F.col("_n_rec") != F.col("n_bands"),
                                  "duplicate or unknown band records for one scene and centre"))
    out = out.drop("_n_rec")
    if on_incomplete == "drop":
        out = out.filter(F.col("n_bands") == n_bands)
    elif on_incomplete == "error":
        out = out.filter(_fail_if(F.col("n_bands") != n_bands, "incomplete band set"))
    return out


def pivot_bands(df: DataFrame, keys: Sequence[str], band_col: str, value_col: str,
                bands: Sequence, names: Sequence[str] | None = None, agg=F.max,
                require_all: bool = False) -> DataFrame:
    """Spatial-key join of single-band layers as one aggregate.

    Instead of n-1 joins on the key, one ``groupBy(keys)`` with a fixed pivot
    list (no extra job to discover values, partial aggregation kept).  With
    ``require_all`` only keys that every band has a record for are kept (the
    inner join of the layers; a record whose value is nodata counts).
    """
    names = list(names or [f"b{b}" for b in bands])
    is_band = [F.col(band_col) == F.lit(b) for b in bands]
    present = [F.max(F.when(b, F.lit(1))).alias(f"_has_{n}") for b, n in zip(is_band, names)] if require_all else []
    out = df.groupBy(*keys).agg(*[
        agg(F.when(b, F.col(value_col))).alias(n) for b, n in zip(is_band, names)], *present)
    for n in names if require_all else ():
        out = out.filter(F.col(f"_has_{n}").isNotNull())
    return out.select(*keys, *names)


def join_bands(layers: Sequence[DataFrame], keys: Sequence[str] = ("c", "r")) -> DataFrame:
    """Equi-join single-band layers on the spatial key (inner, as ``spatialJoin``)."""
    out = layers[0]
    for other in layers[1:]:
        out = out.join(other, list(keys), "inner")
    return out


def layer_metadata(cells: DataFrame, c: str = "c", r: str = "r", crs_col: str | None = None,
                   time_col: str | None = None) -> DataFrame:
    """Bounds of a layer as one aggregate row (merging per-part metadata).

    With ``crs_col`` the number of distinct CRS codes is reported; more than
    one means the parts cannot be merged into one layer.
    """
    aggs = [F.min(c).alias("col_min"), F.max(c).alias("col_max"),
            F.min(r).alias("row_min"), F.max(r).alias("row_max"),
            F.count(F.lit(1)).alias("n_records")]
    if crs_col:
        aggs.append(F.count_distinct(crs_col).alias("n_crs"))
    if time_col:
        aggs += [F.min(time_col).alias("t_min"), F.max(time_col).alias("t_max")]
    return cells.agg(*aggs)


def merge_metadata(parts: DataFrame, crs_col: str = "crs", cell_cols=("dx", "dy")) -> DataFrame:
    """Merge per-part metadata rows (extent xmin/ymin/xmax/ymax, key bounds,
    CRS, cell size) into one layer row; parts in different CRSs or with
    different cell sizes cannot form one layer and fail the query."""
    aggs = [F.min("xmin").alias("xmin"), F.min("ymin").alias("ymin"),
            F.max("xmax").alias("xmax"), F.max("ymax").alias("ymax"),
            F.min(crs_col).alias(crs_col), F.count_distinct(crs_col).alias("_n_crs")]
    for cc in cell_cols:
        aggs += [F.min(cc).alias(cc), F.count_distinct(cc).alias(f"_n_{cc}")]
    out = parts.agg(*aggs)
    bad = F.col("_n_crs") > 1
    for cc in cell_cols:
        bad = bad | (F.col(f"_n_{cc}") > 1)
    return out.filter(_fail_if(bad, "parts differ in CRS or cell size")).drop(
        "_n_crs", *[f"_n_{cc}" for cc in cell_cols])
