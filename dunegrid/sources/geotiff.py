"""GeoTIFF scan and sink on Spark executors.

Scan (``read_geotiff``): the ``geotiff`` data source (``geotiff_source``) lists
files, cuts them into tasks by their bytes, and decodes one window of at most
``tile_size`` x ``tile_size`` at a time by reading only the strips or tiles it
overlaps.  Output is the ``tiles`` form: one row per window and sample with a
row-major ``cells`` array (nodata -> NULL).

Sinks: ``write_geotiff`` encodes one file per tile row; ``write_geotiff_windows``
streams the windows of each file in order into one tiled file, so no task ever
holds a raster.  Both write from the executors, so on a cluster the target must
be a URI that all of them share.

Supported encoding: classic little/big-endian TIFF, strips or tiles, one or
several samples per pixel (interleaved or in planes), no compression, deflate
or LZW, horizontal predictor for integer samples, unsigned/signed integer and
float samples; geo-referencing from ModelPixelScale + ModelTiepoint, EPSG code
from the GeoKey directory, nodata from the GDAL nodata tag.  Anything else
raises a clear error.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# TIFF tag numbers used here.
TAG_WIDTH, TAG_HEIGHT, TAG_BITS, TAG_COMPRESSION, TAG_PHOTOMETRIC = 256, 257, 258, 259, 262
TAG_STRIP_OFFSETS, TAG_SAMPLES, TAG_ROWS_PER_STRIP, TAG_STRIP_BYTES = 273, 277, 278, 279
TAG_PLANAR, TAG_PREDICTOR = 284, 317
TAG_TILE_WIDTH, TAG_TILE_LENGTH, TAG_TILE_OFFSETS, TAG_TILE_BYTES = 322, 323, 324, 325
TAG_SAMPLE_FORMAT = 339
TAG_PIXEL_SCALE, TAG_TIEPOINT, TAG_GEOKEYS, TAG_GDAL_NODATA = 33550, 33922, 34735, 42113
# TIFF field types -> (struct code, byte size).
FIELD_TYPES = {1: ("B", 1), 2: ("s", 1), 3: ("H", 2), 4: ("I", 4), 5: ("II", 8),
               6: ("b", 1), 8: ("h", 2), 9: ("i", 4), 11: ("f", 4), 12: ("d", 8), 16: ("Q", 8)}
# GeoKey ids of the projected and geographic CRS codes.
GEOKEY_PROJECTED, GEOKEY_GEOGRAPHIC = 3072, 2048

TILE_SCHEMA = T.StructType([
    T.StructField("path", T.StringType()), T.StructField("col_key", T.IntegerType()),
    T.StructField("row_key", T.IntegerType()), T.StructField("col_off", T.IntegerType()),
    T.StructField("row_off", T.IntegerType()), T.StructField("sample", T.IntegerType()),
    T.StructField("cols", T.IntegerType()),
    T.StructField("rows", T.IntegerType()), T.StructField("xmin", T.DoubleType()),
    T.StructField("ymax", T.DoubleType()), T.StructField("dx", T.DoubleType()),
    T.StructField("dy", T.DoubleType()), T.StructField("crs", T.IntegerType()),
    T.StructField("cells", T.ArrayType(T.DoubleType())),
])


# --- byte access -------------------------------------------------------------------

#: Schemes that Hadoop uses for S3, which pyarrow opens as ``s3``.
S3_SCHEMES = ("s3://", "s3a://", "s3n://")


def resolve(path: str, storage: dict | None = None):
    """(pyarrow file system, path in it) of a local path or a URI.

    ``storage`` holds options of the S3 client (``anonymous``, ``region``,
    ``access_key``, ``secret_key``, ``session_token``, ``endpoint_override``).
    """
    from pyarrow import fs as pafs

    for scheme in S3_SCHEMES:
        if path.startswith(scheme):
            return pafs.S3FileSystem(**(storage or {})), path[len(scheme):]
    if path.startswith("file:"):
        path = path[5:]
        while path.startswith("//"):
            path = path[1:]
    if "://" not in path:
        return pafs.LocalFileSystem(), os.path.abspath(path)
    return pafs.FileSystem.from_uri(path)


def _open(path: str, storage: dict | None = None):
    """Random-access file handle."""
    filesystem, inner = resolve(path, storage)
    return filesystem.open_input_file(inner)


def shared_target(spark: SparkSession, path: str) -> str:
    """The target itself; a path without a scheme is refused on a cluster, where
    every executor would write to its own disk."""
    master = spark.sparkContext.master
    if ":" not in path and not (master == "local" or master.startswith("local[")):
        raise ValueError("name a URI that all executors share, not a plain path")
    return path


def _read_at(fh, offset: int, size: int) -> bytes:
    fh.seek(offset)
    return fh.read(size)


# --- header ------------------------------------------------------------------------

class TiffInfo:
    def __init__(self, tags: dict, endian: str):
        self.tags = tags
        self.endian = endian
        self.width = int(tags[TAG_WIDTH][0])
        self.height = int(tags[TAG_HEIGHT][0])
        self.samples = int(tags.get(TAG_SAMPLES, [1])[0])
        self.planes = int(tags.get(TAG_PLANAR, [1])[0]) == 2 and self.samples > 1
        self.bits = int(tags.get(TAG_BITS, [1])[0])
        self.compression = int(tags.get(TAG_COMPRESSION, [1])[0])
        if self.compression not in (1, 5, 8, 32946):
            raise ValueError(f"unsupported TIFF compression {self.compression}")
        fmt = int(tags.get(TAG_SAMPLE_FORMAT, [1])[0])
        kind = {1: "u", 2: "i", 3: "f"}[fmt]
        if self.bits not in (8, 16, 32, 64) or len(set(tags.get(TAG_BITS, [1]))) > 1:
            raise ValueError("samples must have 8, 16, 32 or 64 bits, all the same")
        self.dtype = np.dtype(f"{endian}{kind}{self.bits // 8}")
        self.predictor = int(tags.get(TAG_PREDICTOR, [1])[0])
        if self.predictor not in (1, 2) or (self.predictor == 2 and kind == "f"):
            raise ValueError("only the horizontal predictor of integer samples is supported")
        self.tiled = TAG_TILE_OFFSETS in tags
        if self.tiled:
            self.block_w = int(tags[TAG_TILE_WIDTH][0])
            self.block_h = int(tags[TAG_TILE_LENGTH][0])
            self.offsets = [int(v) for v in tags[TAG_TILE_OFFSETS]]
            self.counts = [int(v) for v in tags[TAG_TILE_BYTES]]
        else:
            self.block_w = self.width
            self.block_h = int(tags.get(TAG_ROWS_PER_STRIP, [self.height])[0])
            self.offsets = [int(v) for v in tags[TAG_STRIP_OFFSETS]]
            self.counts = [int(v) for v in tags[TAG_STRIP_BYTES]]
        scale = tags.get(TAG_PIXEL_SCALE, [1.0, 1.0, 0.0])
        tie = tags.get(TAG_TIEPOINT, [0.0, 0.0, 0.0, 0.0, 0.0, 0.0])
        self.dx = float(scale[0])
        self.dy = -float(scale[1])
        self.xmin = float(tie[3]) - float(tie[0]) * self.dx
        self.ymax = float(tie[4]) - float(tie[1]) * self.dy
        self.crs = 0
        keys = tags.get(TAG_GEOKEYS)
        if keys:
            n = int(keys[3])
            for k in range(n):
                kid, loc, _cnt, val = (int(v) for v in keys[4 + 4 * k: 8 + 4 * k])
                if kid in (GEOKEY_PROJECTED, GEOKEY_GEOGRAPHIC) and loc == 0:
                    self.crs = val
        nd = tags.get(TAG_GDAL_NODATA)
        self.nodata = None
        if nd:
            txt = nd[0].strip("\x00 ").lower()
            if txt and txt != "nan":
                self.nodata = float(txt)


def read_header(fh) -> TiffInfo:
    head = _read_at(fh, 0, 8)
    endian = {b"II": "<", b"MM": ">"}.get(head[:2])
    if endian is None or struct.unpack(endian + "H", head[2:4])[0] != 42:
        raise ValueError("not a classic TIFF file")
    ifd = struct.unpack(endian + "I", head[4:8])[0]
    n = struct.unpack(endian + "H", _read_at(fh, ifd, 2))[0]
    raw = _read_at(fh, ifd + 2, 12 * n)
    tags = {}
    for k in range(n):
        tag, typ, cnt, val = struct.unpack(endian + "HHII", raw[12 * k: 12 * k + 12])
        code, size = FIELD_TYPES[typ]
        nbytes = size * cnt
        data = raw[12 * k + 8: 12 * k + 12] if nbytes <= 4 else _read_at(fh, val, nbytes)
        if typ == 2:
            tags[tag] = [data[:cnt].decode("latin-1")]
        elif typ == 5:
            v = struct.unpack(endian + "I" * (2 * cnt), data[:nbytes])
            tags[tag] = [v[2 * i] / v[2 * i + 1] for i in range(cnt)]
        else:
            tags[tag] = list(struct.unpack(endian + code * cnt, data[:nbytes]))
    return TiffInfo(tags, endian)


def lzw_decode(data: bytes) -> bytes:
    """TIFF LZW: codes of 9 to 12 bits, most significant bit first; 256 clears
    the table, 257 ends; the width grows one code early."""
    first = [bytes([i]) for i in range(256)] + [b"", b""]
    table, width, held, bits, prev = list(first), 9, 0, 0, b""
    out = []
    for byte in data:
        held = (held << 8) | byte
        bits += 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits
        held &= (1 << bits) - 1
        if code == 256:
            table, width, prev = list(first), 9, b""
            continue
        if code == 257:
            break
        if not prev:
            entry = table[code]
        else:
            entry = table[code] if code < len(table) else prev + prev[:1]
            table.append(prev + entry[:1])
        out.append(entry)
        prev = entry
        if len(table) + 1 >= 1 << width and width < 12:
            width += 1
    return b"".join(out)


def lzw_encode(data: bytes) -> bytes:
    """The counterpart of :func:`lzw_decode`."""
    out, held, bits = bytearray(), 0, 0

    def put(code: int, width: int) -> None:
        nonlocal held, bits
        held = (held << width) | code
        bits += width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits)
            held &= (1 << bits) - 1

    table = {bytes([i]): i for i in range(256)}
    width, size, have = 9, 258, b""
    put(256, width)
    for i in range(len(data)):
        more = have + data[i:i + 1]
        if more in table:
            have = more
            continue
        put(table[have], width)
        table[more] = size
        size += 1
        if size >= 1 << width and width < 12:
            width += 1
        if size >= 4095:
            put(256, width)
            table = {bytes([i]): i for i in range(256)}
            width, size = 9, 258
        have = data[i:i + 1]
    if have:
        put(table[have], width)
        size += 1
        if size >= 1 << width and width < 12:
            width += 1
    put(257, width)
    if bits:
        out.append(held << (8 - bits) & 255)
    return bytes(out)


def _read_block(fh, info: TiffInfo, idx: int, rows: int) -> np.ndarray:
    """One strip or tile as (rows, width, samples in it)."""
    buf = _read_at(fh, info.offsets[idx], info.counts[idx])
    if info.compression == 5:
        buf = lzw_decode(buf)
    elif info.compression != 1:
        buf = zlib.decompress(buf)
    per = 1 if info.planes else info.samples
    block = np.frombuffer(buf, dtype=info.dtype, count=rows * info.block_w * per)
    block = block.reshape(rows, info.block_w, per)
    if info.predictor == 2:  # differences along the row, wrapping like the sample type
        block = np.cumsum(block, axis=1, dtype=info.dtype.newbyteorder("="))
    return block


def read_window(fh, info: TiffInfo, col_off: int, row_off: int, w: int, h: int) -> np.ndarray:
    """Decode the window [row_off, row_off + h) x [col_off, col_off + w) as
    float64 (samples, h, w)."""
    out = np.empty((info.samples, h, w), dtype="float64")
    bw, bh = info.block_w, info.block_h
    across, down = -(-info.width // bw), -(-info.height // bh)
    for br in range(row_off // bh, (row_off + h - 1) // bh + 1):
        for bc in range(col_off // bw, (col_off + w - 1) // bw + 1):
            rows_here = bh if info.tiled else min(bh, info.height - br * bh)
            idx = br * across + bc if info.tiled else br
            if info.planes:
                size = across * down if info.tiled else down
                block = np.concatenate([_read_block(fh, info, idx + p * size, rows_here)
                                        for p in range(info.samples)], axis=2)
            else:
                block = _read_block(fh, info, idx, rows_here)
            r0, c0 = br * bh, bc * bw
            rs, re = max(row_off, r0), min(row_off + h, r0 + rows_here)
            cs, ce = max(col_off, c0), min(col_off + w, c0 + bw)
            out[:, rs - row_off:re - row_off, cs - col_off:ce - col_off] = np.moveaxis(
                block[rs - r0:re - r0, cs - c0:ce - c0], 2, 0)
    if info.nodata is not None:
        out[out == info.nodata] = np.nan
    return out


# --- Spark scan ----------------------------------------------------------------------

def read_geotiff(spark: SparkSession, path: str, tile_size: int = 512,
                 glob: str | None = "*.TIF", recursive: bool = True, storage: dict | None = None,
                 task_bytes: int = 64 << 20) -> DataFrame:
    """Scan GeoTIFF files under ``path`` into windows of at most ``tile_size``,
    one row per window and sample, about ``task_bytes`` of files per task: the
    ``geotiff`` format of :mod:`dunegrid.sources.geotiff_source`."""
    from dunegrid.sources import geotiff_source

    geotiff_source.register(spark)
    reader = spark.read.format("geotiff").options(tile_size=tile_size, glob=glob or "*", recursive=recursive,
                                                  task_bytes=task_bytes)
    for k, v in (storage or {}).items():
        reader = reader.option(f"storage.{k}", v)
    return reader.load(path).select(TILE_SCHEMA.fieldNames())


def with_scene_and_band(tiles: DataFrame, pattern: str = r"_B(\d+)(_REF)?\.TIF$") -> DataFrame:
    """Add scene_id (parent directory) and band number (from the file name)."""
    from dunegrid.operators.assembly import band_of_path, scene_of_path
    return tiles.withColumn("scene_id", scene_of_path("path")).withColumn(
        "band", band_of_path("path", pattern))


# --- sink ------------------------------------------------------------------------------

def _geo_entries(xmin: float, ymax: float, dx: float, dy: float, crs: int) -> list[tuple]:
    entries = [(TAG_PIXEL_SCALE, 12, [float(dx), float(-dy), 0.0]),
               (TAG_TIEPOINT, 12, [0.0, 0.0, 0.0, float(xmin), float(ymax), 0.0])]
    if crs:
        key = GEOKEY_GEOGRAPHIC if crs == 4326 else GEOKEY_PROJECTED
        entries.append((TAG_GEOKEYS, 3, [1, 1, 0, 2, 1024, 0, 1, 2 if key == GEOKEY_GEOGRAPHIC else 1,
                                         key, 0, 1, int(crs)]))
    return entries


def _directory(entries: list[tuple], offsets_tag: int, sizes: list[int]) -> bytes:
    """Header and directory of a file whose blocks of ``sizes`` bytes follow at
    once; fills in their offsets."""
    def pack(offsets: list[int]) -> bytes:
        every = sorted([*entries, (offsets_tag, 4, offsets)], key=lambda e: e[0])
        extra_off = 8 + 2 + 12 * len(every) + 4
        fields, extra = [], b""
        for tag, typ, vals in every:
            if typ == 2:
                payload, cnt = vals.encode("latin-1"), len(vals)
            else:
                payload, cnt = struct.pack("<" + FIELD_TYPES[typ][0] * len(vals), *vals), len(vals)
            if len(payload) <= 4:
                field = payload.ljust(4, b"\x00")
            else:
                field = struct.pack("<I", extra_off + len(extra))
                extra += payload + (b"\x00" if len(payload) % 2 else b"")
            fields.append(struct.pack("<HHI", tag, typ, cnt) + field)
        return (b"II" + struct.pack("<HI", 42, 8) + struct.pack("<H", len(every)) + b"".join(fields)
                + struct.pack("<I", 0) + extra)

    at, offsets = len(pack([0] * len(sizes))), []
    for n in sizes:
        offsets.append(at)
        at += n
    if at >= 1 << 32:
        raise ValueError("the file would pass the 4 GiB of classic TIFF")
    return pack(offsets)


COMPRESSIONS = {"none": 1, "lzw": 5, "deflate": 8}


def encode_geotiff(arr: np.ndarray, xmin: float, ymax: float, dx: float, dy: float,
                   crs: int = 0, compress: bool | str = True, rows_per_strip: int = 16,
                   dtype: str = "f8", predictor: bool = False, nodata: float | None = None) -> bytes:
    """Little-endian GeoTIFF in strips from (h, w) or (h, w, samples).

    ``compress`` is none, lzw or deflate; ``dtype`` a numpy sample type;
    ``predictor`` applies horizontal differencing (integers); NaN becomes
    ``nodata`` in integer files.
    """
    how = compress if isinstance(compress, str) else "deflate" if compress else "none"
    kind = np.dtype("<" + dtype)
    arr = arr if arr.ndim == 3 else arr[:, :, None]
    h, w, samples = arr.shape
    if kind.kind != "f":
        arr = np.where(np.isnan(arr), 0 if nodata is None else nodata, arr)
    data = np.ascontiguousarray(arr).astype(kind)
    if predictor:
        data = np.concatenate([data[:, :1], data[:, 1:] - data[:, :-1]], axis=1)
    strips = []
    for r0 in range(0, h, rows_per_strip):
        raw = data[r0:r0 + rows_per_strip].tobytes()
        strips.append(zlib.compress(raw, 6) if how == "deflate" else lzw_encode(raw) if how == "lzw" else raw)
    entries = [(TAG_WIDTH, 4, [w]), (TAG_HEIGHT, 4, [h]), (TAG_BITS, 3, [8 * kind.itemsize] * samples),
               (TAG_COMPRESSION, 3, [COMPRESSIONS[how]]), (TAG_PHOTOMETRIC, 3, [1]),
               (TAG_SAMPLES, 3, [samples]), (TAG_ROWS_PER_STRIP, 4, [rows_per_strip]),
               (TAG_STRIP_BYTES, 4, [len(x) for x in strips]), (TAG_PLANAR, 3, [1]),
               (TAG_PREDICTOR, 3, [2 if predictor else 1]),
               (TAG_SAMPLE_FORMAT, 3, [{"u": 1, "i": 2, "f": 3}[kind.kind]] * samples),
               *_geo_entries(xmin, ymax, dx, dy, crs),
               (TAG_GDAL_NODATA, 2, ("nan" if nodata is None else repr(nodata)) + "\x00")]
    return _directory(entries, TAG_STRIP_OFFSETS, [len(x) for x in strips]) + b"".join(strips)


WRITTEN_SCHEMA = "path string, n_bytes long"


def _put(path: str, storage: dict | None):
    """(stream, commit): the file gets its name only when it is complete."""
    filesystem, inner = resolve(path, storage)
    filesystem.create_dir(os.path.dirname(inner), recursive=True)
    part = f"{inner}.{os.urandom(6).hex()}.part"
    return filesystem.open_output_stream(part, compression=None), lambda: filesystem.move(part, inner)


def write_geotiff(tiles: DataFrame, out_dir: str, name_cols=("col_key", "row_key"),
                  prefix: str = "tile", crs: int = 0, compress: bool | str = True,
                  name_fmt: str | None = None, storage: dict | None = None, dtype: str = "f8",
                  predictor: bool = False, nodata: float | None = None) -> DataFrame:
    """Write one GeoTIFF per tile row; returns the (path, n_bytes) table,
    materialized so that the files are written exactly once.

    ``tiles`` needs cols, rows, cells, xmin, ymax, dx, dy (and the name
    columns); an optional ``samples`` column says how many values per pixel
    ``cells`` interleaves.  File names are ``<prefix>_<name cols>.TIF`` or
    ``name_fmt`` formatted with the row (it may contain sub-folders).
    """
    from dunegrid.session import ensure_on_executors, materialize

    ensure_on_executors(tiles.sparkSession)
    target_dir = shared_target(tiles.sparkSession, out_dir).rstrip("/")
    names = list(name_cols)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i in range(b.num_rows):  # one tile in memory at a time
                rec = b.slice(i, 1).to_pylist()[0]
                arr = np.array(rec["cells"], dtype="float64")  # None -> NaN
                arr = arr.reshape(rec["rows"], rec["cols"], rec.get("samples") or 1)
                blob = encode_geotiff(arr, rec["xmin"], rec["ymax"], rec["dx"], rec["dy"], crs, compress,
                                      dtype=dtype, predictor=predictor, nodata=nodata)
                fname = name_fmt.format(**rec) if name_fmt else (
                    prefix + "_" + "_".join(str(rec[c]) for c in names) + ".TIF")
                fh, commit = _put(f"{target_dir}/{fname}", storage)
                with fh:
                    fh.write(blob)
                commit()
                out.append((f"{target_dir}/{fname}", len(blob)))
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.string()),
                                              pa.array([n for _, n in out], pa.int64())], names=["path", "n_bytes"])

    cols = [*names, "cols", "rows", "cells", "xmin", "ymax", "dx", "dy",
            *(["samples"] if "samples" in tiles.columns else [])]
    return materialize(tiles.select(*dict.fromkeys(cols)).mapInArrow(write, WRITTEN_SCHEMA), "geotiff-written")


def write_geotiff_windows(windows: DataFrame, out_dir: str, file_col: str, width, height, tile_size: int,
                          xmin: float = 0.0, ymax=0.0, dx: float = 1.0, dy: float = -1.0,
                          crs: int = 0, storage: dict | None = None) -> DataFrame:
    """Write one tiled float64 GeoTIFF per value of ``file_col`` (a path below
    ``out_dir``) from windows (col_key, row_key, cols, rows, cells) of a
    ``tile_size`` grid (a multiple of 16).

    ``width``, ``height`` and ``ymax`` are numbers or columns of the windows.  The
    windows of a file come to one task in order and each is written and
    forgotten before the next; absent windows become nodata.  The uncompressed
    blocks have one size, so the directory is known before the first of them.
    """
    from dunegrid.session import ensure_on_executors, materialize

    if tile_size % 16:
        raise ValueError("tile_size must be a multiple of 16")
    spark = windows.sparkSession
    ensure_on_executors(spark)
    target_dir = shared_target(spark, out_dir).rstrip("/")
    size = [v if not isinstance(v, int) else F.lit(v) for v in (width, height)]
    rows = windows.select(F.col(file_col).alias("file"), size[0].cast("int").alias("width"),
                          size[1].cast("int").alias("height"),
                          (F.lit(ymax) if isinstance(ymax, (int, float)) else ymax).cast("double").alias("ymax"), "col_key", "row_key", "cols", "rows", "cells")
    rows = rows.repartition("file").sortWithinPartitions("file", "row_key", "col_key")
    block = tile_size * tile_size * 8
    blank = np.full((tile_size, tile_size), np.nan, "<f8").tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = fh = commit = None
        done, across, total, head = 0, 0, 0, b""

        def finish():
            nonlocal done
            while done < total:
                fh.write(blank)
                done += 1
            fh.close()
            commit()
            return pa.RecordBatch.from_arrays([pa.array([f"{target_dir}/{at}"]),
                                               pa.array([len(head) + total * block], pa.int64())],
                                              names=["path", "n_bytes"])

        for rec in (b.slice(i, 1).to_pylist()[0] for b in batches for i in range(b.num_rows)):
            if rec["file"] != at:
                if at is not None:
                    yield finish()
                at, done = rec["file"], 0
                across = -(-rec["width"] // tile_size)
                total = across * -(-rec["height"] // tile_size)
                entries = [(TAG_WIDTH, 4, [rec["width"]]), (TAG_HEIGHT, 4, [rec["height"]]), (TAG_BITS, 3, [64]),
                           (TAG_COMPRESSION, 3, [1]), (TAG_PHOTOMETRIC, 3, [1]), (TAG_SAMPLES, 3, [1]),
                           (TAG_PLANAR, 3, [1]), (TAG_TILE_WIDTH, 3, [tile_size]), (TAG_TILE_LENGTH, 3, [tile_size]),
                           (TAG_TILE_BYTES, 4, [block] * total), (TAG_SAMPLE_FORMAT, 3, [3]),
                           *_geo_entries(xmin, rec["ymax"], dx, dy, crs), (TAG_GDAL_NODATA, 2, "nan\x00")]
                head = _directory(entries, TAG_TILE_OFFSETS, [block] * total)
                fh, commit = _put(f"{target_dir}/{at}", storage)
                fh.write(head)
            k = rec["row_key"] * across + rec["col_key"]
            if k < done:
                raise ValueError(f"{at}: two windows at ({rec['col_key']}, {rec['row_key']})")
            while done < k:
                fh.write(blank)
                done += 1
            tile = np.full((tile_size, tile_size), np.nan, "<f8")
            tile[:rec["rows"], :rec["cols"]] = np.array(rec["cells"], "float64").reshape(rec["rows"], rec["cols"])
            fh.write(tile.tobytes())
            done += 1
        if at is not None:
            yield finish()

    return materialize(rows.mapInArrow(write, WRITTEN_SCHEMA), "geotiff-written")


def stack_samples(tiles: DataFrame, n: int, keys: Sequence[str] = (), sample: str = "sample") -> DataFrame:
    """The several-bands form: one row per window with columns b0 ... b{n-1}."""
    from dunegrid.operators.assembly import pivot_bands

    cols = [*keys, *[c for c in ("path", "col_key", "row_key", "col_off", "row_off", "cols", "rows", "xmin", "ymax",
                                 "dx", "dy", "crs") if c in tiles.columns and c not in keys]]
    return pivot_bands(tiles, cols, sample, "cells", list(range(n)))
