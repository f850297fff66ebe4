"""GeoTIFF as a Spark data source: ``spark.read.format("geotiff")`` and
``df.write.format("geotiff")``.

Reading.  Files are listed under the path (options ``glob``, ``recursive``,
``tile_size``, ``task_bytes``, and ``cells``: false for windows without their
cells, for which headers are enough) and cut into partitions of about ``task_bytes``:
several small files, or a share of a large one's window rows.  No file is opened
for that; each task reads the header of its own files.  Rows are windows of at
most ``tile_size`` cells (the ``tiles`` form) with the scene (parent folder) and
the band (``_B<n>`` in the file's name).

Comparisons with literals are pushed down (``register`` turns that on): those on
``path``, ``scene_id`` and ``band`` drop files before any byte is read, those on
``col_key``, ``row_key`` and ``sample`` drop windows and planes before they are
decoded.

Writing.  A row (file, cols, rows, cells, xmin, ymax, dx, dy, and samples if
there are several) is one file, its name below the target path in ``file``.
Every attempt of a task writes to a folder of its own below ``_temporary`` of
the job; the job's commit moves the files of the attempts that Spark chose into
place and removes the rest, and its abort removes everything; an attempt that
ends after that finds the job's mark gone and removes its own files, so a lost,
late or speculative task leaves nothing.  Options: ``crs``, ``compress``, ``dtype``,
``predictor``, ``nodata``.

Files are opened by ``geotiff.resolve`` (local paths, S3 schemes, any URI of
``pyarrow.fs``); options that start with ``storage.`` go to the S3 client.
"""

from __future__ import annotations

import fnmatch
import operator
import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import types as T

from dunegrid.sources import geotiff

SCHEMA = T.StructType([*geotiff.TILE_SCHEMA.fields, T.StructField("scene_id", T.StringType()),
                       T.StructField("band", T.IntegerType())])
FILE_COLUMNS = ("path", "scene_id", "band")
WINDOW_COLUMNS = ("col_key", "row_key", "sample")
BAND = re.compile(r"_B(\d+)(?:_REF)?\.TIF$", re.I)


@dataclass(frozen=True)
class Test:
    """A pushed comparison of a column with literals (a NULL value meets none)."""

    column: str
    how: str
    value: object

    def __call__(self, value) -> bool:
        if value is None:
            return False
        if self.how == "in":
            return value in self.value
        if self.how in ("startswith", "endswith"):
            return getattr(value, self.how)(self.value)
        if self.how == "contains":
            return self.value in value
        return self.how == "known" or bool(getattr(operator, self.how)(value, self.value))


# Filters of the data source interface and the comparison each stands for.
COMPARISONS = {ds.EqualTo: "eq", ds.GreaterThan: "gt", ds.GreaterThanOrEqual: "ge", ds.LessThan: "lt",
               ds.LessThanOrEqual: "le", ds.In: "in", ds.StringStartsWith: "startswith", ds.StringEndsWith: "endswith",
               ds.StringContains: "contains", ds.IsNotNull: "known"}


def test_of(f: ds.Filter) -> Test | None:
    """The comparison of a filter on one of the columns known before decoding, else None."""
    how, column = COMPARISONS.get(type(f)), getattr(f, "attribute", None)
    if how is None or len(column) != 1 or column[0] not in FILE_COLUMNS + WINDOW_COLUMNS:
        return None
    value = getattr(f, "value", None)
    return Test(column[0], how, tuple(value) if how == "in" else value)


def file_facts(path: str) -> dict:
    """path, scene_id and band of a file, from its name."""
    band = BAND.search(path)
    parts = path.split("/")
    return {"path": path, "scene_id": parts[-2] if len(parts) > 1 else None, "band": int(band[1]) if band else None}


def storage_of(options: dict) -> dict | None:
    """Options of the S3 client."""
    words = {"true": True, "false": False}
    return {k[8:]: words.get(v.lower(), v) for k, v in options.items() if k.startswith("storage.")} or None


@dataclass
class Pieces(ds.InputPartition):
    """Files of a task, each with the share of its window rows: (path, k, of)."""

    files: list[tuple[str, int, int]]


class GeoTiffReader(ds.DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.glob = options.get("glob", "*.TIF")
        self.recursive = options.get("recursive", "true").lower() == "true"
        self.tile_size = int(options.get("tile_size", 512))
        self.task_bytes = int(options.get("task_bytes", 64 << 20))
        self.cells = options.get("cells", "true").lower() == "true"
        self.storage = storage_of(options)
        self.tests: list[Test] = []

    def pushFilters(self, filters: list[ds.Filter]) -> Iterator[ds.Filter]:
        for f in filters:
            test = test_of(f)
            if test is None:
                yield f
            else:
                self.tests.append(test)

    def _keeps(self, facts: dict) -> bool:
        return all(t(facts[t.column]) for t in self.tests if t.column in facts)

    def listed(self) -> list[tuple[str, int]]:
        """(path, bytes) of the files whose name passes the glob and the pushed comparisons."""
        from pyarrow import fs as pafs

        filesystem, inner = geotiff.resolve(self.path, self.storage)
        head = self.path[:len(self.path) - len(inner)] if self.path.endswith(inner) else ""
        found = filesystem.get_file_info(inner)
        infos = [found] if found.type == pafs.FileType.File else filesystem.get_file_info(
            pafs.FileSelector(inner, recursive=self.recursive))
        return sorted((head + i.path, i.size) for i in infos
                      if i.type == pafs.FileType.File and fnmatch.fnmatch(i.base_name, self.glob)
                      and not any(p.startswith(("_", ".")) for p in i.path[len(inner):].split("/"))
                      and self._keeps(file_facts(head + i.path)))

    def partitions(self) -> list[Pieces]:
        out: list[Pieces] = []
        files: list[tuple[str, int, int]] = []
        size = 0
        for path, n in self.listed():
            shares = -(-n // self.task_bytes)
            if shares > 1:
                out += [Pieces([(path, k, shares)]) for k in range(shares)]
                continue
            if files and size + n > self.task_bytes:
                out.append(Pieces(files))
                files, size = [], 0
            files.append((path, 0, 1))
            size += n
        # no partition at all is not a valid plan
        return out + ([Pieces(files)] if files or not out else [])

    def read(self, partition: Pieces) -> Iterator[pa.RecordBatch]:
        for path, k, of in partition.files:
            with geotiff._open(path, self.storage) as fh:
                info = geotiff.read_header(fh)
                down, across = (-(-n // self.tile_size) for n in (info.height, info.width))
                for row_key in range(down * k // of, down * (k + 1) // of):
                    for col_key in range(across):
                        yield from self._window(fh, info, path, col_key, row_key)

    def _window(self, fh, info, path: str, col_key: int, row_key: int) -> Iterator[pa.RecordBatch]:
        keys = {"col_key": col_key, "row_key": row_key}
        planes = [p for p in range(info.samples) if self._keeps({"sample": p})]
        if not planes or not self._keeps(keys):
            return
        ts, facts = self.tile_size, file_facts(path)
        c, r = col_key * ts, row_key * ts
        w, h = min(ts, info.width - c), min(ts, info.height - r)
        arr = geotiff.read_window(fh, info, c, r, w, h) if self.cells else None
        for p in planes:
            flat = np.zeros(0) if arr is None else arr[p].ravel()
            cells = pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), pa.array(flat, mask=np.isnan(flat)))
            values = [path, col_key, row_key, c, r, p, w, h, info.xmin + c * info.dx, info.ymax + r * info.dy,
                      info.dx, info.dy, info.crs, cells, facts["scene_id"], facts["band"]]
            types = {T.StringType: pa.string(), T.IntegerType: pa.int32(), T.DoubleType: pa.float64()}
            yield pa.RecordBatch.from_arrays(
                [v if f.name == "cells" else pa.array([v], types[type(f.dataType)]) for v, f in zip(values, SCHEMA.fields)],
                names=SCHEMA.fieldNames())


@dataclass
class Written(ds.WriterCommitMessage):
    """(file in the attempt's folder, name below the target) of an attempt."""

    files: list[tuple[str, str]]


class GeoTiffWriter(ds.DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.storage = storage_of(options)
        self.crs = int(options.get("crs", 0))
        nodata = options.get("nodata")
        self.encode = {"compress": options.get("compress", "deflate"), "dtype": options.get("dtype", "f8"),
                       "predictor": options.get("predictor", "false").lower() == "true",
                       "nodata": None if nodata is None else float(nodata) if "." in nodata else int(nodata)}
        self.job = f"_temporary/{uuid.uuid4().hex}"
        filesystem, root = geotiff.resolve(self.path, self.storage)
        filesystem.create_dir(f"{root}/{self.job}", recursive=True)
        with filesystem.open_output_stream(f"{root}/{self.job}/{self.MARK}", compression=None):
            pass  # the job is on (made once, on the driver)

    #: Stands in the job's folder until it is committed or aborted.
    MARK = "_started"

    def _is_on(self) -> bool:
        from pyarrow import fs as pafs

        filesystem, root = geotiff.resolve(self.path, self.storage)
        return filesystem.get_file_info(f"{root}/{self.job}/{self.MARK}").type == pafs.FileType.File

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        filesystem, root = geotiff.resolve(self.path, self.storage)
        attempt = f"{root}/{self.job}/{uuid.uuid4().hex}"
        files: list[tuple[str, str]] = []
        if not self._is_on():
            raise RuntimeError("the job has ended")
        for b in iterator:
            for i in range(b.num_rows):  # one tile in memory at a time
                rec = b.slice(i, 1).to_pylist()[0]
                if ".." in rec["file"].split("/"):
                    raise ValueError(f"{rec['file']}: a file's name must be below the target")
                arr = np.array(rec["cells"], dtype="float64").reshape(rec["rows"], rec["cols"], rec.get("samples") or 1)
                blob = geotiff.encode_geotiff(arr, rec["xmin"], rec["ymax"], rec["dx"], rec["dy"], self.crs, **self.encode)
                staged = f"{attempt}/{len(files)}.TIF"
                if not files:
                    filesystem.create_dir(attempt, recursive=True)
                with filesystem.open_output_stream(staged, compression=None) as out:
                    out.write(blob)
                files.append((staged, rec["file"]))
        if not self._is_on():  # aborted meanwhile
            self._clear()
            raise RuntimeError("the job has ended")
        return Written(files)

    def _clear(self) -> None:
        """Remove what attempts left of this job (and its parent, if nobody else writes)."""
        from pyarrow import fs as pafs

        filesystem, root = geotiff.resolve(self.path, self.storage)
        if filesystem.get_file_info(f"{root}/{self.job}").type == pafs.FileType.Directory:
            filesystem.delete_dir(f"{root}/{self.job}")
        above = f"{root}/_temporary"
        if (filesystem.get_file_info(above).type == pafs.FileType.Directory
                and not filesystem.get_file_info(pafs.FileSelector(above))):
            filesystem.delete_dir(above)

    def commit(self, messages: list[Written | None]) -> None:
        filesystem, root = geotiff.resolve(self.path, self.storage)
        files = [f for m in messages if m is not None for f in m.files]
        names = [name for _, name in files]
        if len(set(names)) < len(names):
            self._clear()
            raise ValueError("several rows have one file name")
        if self.overwrite:
            from pyarrow import fs as pafs

            if filesystem.get_file_info(root).type == pafs.FileType.Directory:
                for i in filesystem.get_file_info(pafs.FileSelector(root)):
                    if i.base_name != "_temporary":
                        filesystem.delete_dir(i.path) if i.type == pafs.FileType.Directory else filesystem.delete_file(i.path)
        for folder in sorted({os.path.dirname(f"{root}/{name}") for name in names}):
            filesystem.create_dir(folder, recursive=True)
        for staged, name in files:
            filesystem.move(staged, f"{root}/{name}")
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()


class GeoTiffSource(ds.DataSource):
    """See the module's docstring."""

    @classmethod
    def name(cls) -> str:
        return "geotiff"

    def schema(self) -> T.StructType:
        return SCHEMA

    def reader(self, schema: T.StructType) -> GeoTiffReader:
        return GeoTiffReader(dict(self.options))

    def writer(self, schema: T.StructType, overwrite: bool) -> GeoTiffWriter:
        missing = {"file", "cols", "rows", "cells", "xmin", "ymax", "dx", "dy"} - set(schema.fieldNames())
        if missing:
            raise ValueError(f"columns are missing: {sorted(missing)}")
        return GeoTiffWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    """Make ``geotiff`` a format of the session, with filter pushdown."""
    from dunegrid.session import ensure_on_executors

    ensure_on_executors(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(GeoTiffSource)
