"""Grid codes and map projections as Column expressions."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# WGS84 semi-major axis (metres) used by spherical Web Mercator,
# and the half-width of the Web Mercator square in metres.
EARTH_RADIUS = 6378137.0
MERCATOR_HALF_WORLD = math.pi * EARTH_RADIUS

# Bit-spreading masks for a 2-D Morton (Z-order) code of two
# non-negative 31-bit integers, applied after shifts of 16, 8, 4, 2, 1.
_SPREAD_STEPS = (
    (16, 0x0000FFFF0000FFFF),
    (8, 0x00FF00FF00FF00FF),
    (4, 0x0F0F0F0F0F0F0F0F),
    (2, 0x3333333333333333),
    (1, 0x5555555555555555),
)


# The same for a 3-D code of three integers of at most 21 bits,
# applied after shifts of 32, 16, 8, 4, 2.
_SPREAD3_STEPS = (
    (32, 0x001F00000000FFFF),
    (16, 0x001F0000FF0000FF),
    (8, 0x100F00F00F00F00F),
    (4, 0x10C30C30C30C30C3),
    (2, 0x1249249249249249),
)


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _spread_bits(v: Column, steps=_SPREAD_STEPS) -> Column:
    x = v.cast("long")
    for shift, mask in steps:
        x = F.shiftleft(x, shift).bitwiseOR(x).bitwiseAND(F.lit(mask))
    return x


def morton2(col_idx, row_idx) -> Column:
    """Z-order code of (column, row): column bits take the odd (higher) positions.

    ``morton2(5, 3) == 39``.  Inputs must be non-negative and below 2**31.
    """
    return F.shiftleft(_spread_bits(_c(col_idx)), 1).bitwiseOR(_spread_bits(_c(row_idx)))


def morton3(col_idx, row_idx, step) -> Column:
    """Z-order code of (column, row, time step), in this order of bits.

    ``morton3(5, 3, 1) == 279`` (101, 011, 001 interleaved).  Inputs must be
    non-negative and below 2**21.
    """
    a, b, c = (_spread_bits(_c(x), _SPREAD3_STEPS) for x in (col_idx, row_idx, step))
    return F.shiftleft(a, 2).bitwiseOR(F.shiftleft(b, 1)).bitwiseOR(c)


def lonlat_to_mercator_x(lon) -> Column:
    return F.radians(_c(lon)) * F.lit(EARTH_RADIUS)


def lonlat_to_mercator_y(lat) -> Column:
    return F.log(F.tan(F.lit(math.pi / 4) + F.radians(_c(lat)) / 2)) * F.lit(EARTH_RADIUS)


def mercator_to_lon(x) -> Column:
    return F.degrees(_c(x) / F.lit(EARTH_RADIUS))


def mercator_to_lat(y) -> Column:
    return F.degrees(F.atan(F.exp(_c(y) / F.lit(EARTH_RADIUS))) * 2 - F.lit(math.pi / 2))


def mercator_resolution(zoom: int, tile_size: int = 256) -> float:
    """Metres per pixel of the zoomed Web Mercator layout."""
    return 2 * MERCATOR_HALF_WORLD / (tile_size * (2 ** zoom))


# --- UTM (transverse Mercator on the WGS84 ellipsoid) --------------------------------
# Series of Snyder, "Map Projections - A Working Manual" (USGS PP 1395, 1987),
# pp. 60-64; accuracy well below a millimetre inside a zone.

# WGS84 flattening and the UTM scale factor, false easting and
# false northing of the southern hemisphere.
WGS84_F = 1 / 298.257223563
UTM_K0 = 0.9996
UTM_FALSE_EASTING = 500000.0
UTM_FALSE_NORTHING_SOUTH = 10000000.0

_E2 = WGS84_F * (2 - WGS84_F)
_EP2 = _E2 / (1 - _E2)
_M1 = 1 - _E2 / 4 - 3 * _E2 ** 2 / 64 - 5 * _E2 ** 3 / 256
_M2 = 3 * _E2 / 8 + 3 * _E2 ** 2 / 32 + 45 * _E2 ** 3 / 1024
_M3 = 15 * _E2 ** 2 / 256 + 45 * _E2 ** 3 / 1024
_M4 = 35 * _E2 ** 3 / 3072
_E1 = (1 - math.sqrt(1 - _E2)) / (1 + math.sqrt(1 - _E2))


def utm_central_meridian(zone: int) -> float:
    return (zone - 1) * 6 - 180 + 3


def utm_forward_np(lon, lat, zone: int, south: bool = False):
    """Vectorised (numpy) UTM forward: degrees -> (easting, northing) metres."""
    import numpy as np
    a = EARTH_RADIUS
    phi = np.radians(np.asarray(lat, dtype="float64"))
    lam = np.radians(np.asarray(lon, dtype="float64")) - math.radians(utm_central_meridian(zone))
    s, co, tn = np.sin(phi), np.cos(phi), np.tan(phi)
    n = a / np.sqrt(1 - _E2 * s * s)
    t = tn * tn
    c = _EP2 * co * co
    aa = lam * co
    m = a * (_M1 * phi - _M2 * np.sin(2 * phi) + _M3 * np.sin(4 * phi) - _M4 * np.sin(6 * phi))
    x = UTM_K0 * n * (aa + (1 - t + c) * aa ** 3 / 6
                      + (5 - 18 * t + t * t + 72 * c - 58 * _EP2) * aa ** 5 / 120) + UTM_FALSE_EASTING
    y = UTM_K0 * (m + n * tn * (aa * aa / 2 + (5 - t + 9 * c + 4 * c * c) * aa ** 4 / 24
                                + (61 - 58 * t + t * t + 600 * c - 330 * _EP2) * aa ** 6 / 720))
    if south:
        y = y + UTM_FALSE_NORTHING_SOUTH
    return x, y


def utm_inverse_np(x, y, zone: int, south: bool = False):
    """Vectorised (numpy) UTM inverse: (easting, northing) metres -> degrees."""
    import numpy as np
    a = EARTH_RADIUS
    e1 = _E1
    yy = np.asarray(y, dtype="float64") - (UTM_FALSE_NORTHING_SOUTH if south else 0.0)
    mu = yy / UTM_K0 / (a * _M1)
    phi1 = (mu + (3 * e1 / 2 - 27 * e1 ** 3 / 32) * np.sin(2 * mu)
            + (21 * e1 ** 2 / 16 - 55 * e1 ** 4 / 32) * np.sin(4 * mu)
            + (151 * e1 ** 3 / 96) * np.sin(6 * mu) + (1097 * e1 ** 4 / 512) * np.sin(8 * mu))
    s, co, tn = np.sin(phi1), np.cos(phi1), np.tan(phi1)
    c1 = _EP2 * co * co
    t1 = tn * tn
    n1 = a / np.sqrt(1 - _E2 * s * s)
    r1 = a * (1 - _E2) / (1 - _E2 * s * s) ** 1.5
    d = (np.asarray(x, dtype="float64") - UTM_FALSE_EASTING) / (n1 * UTM_K0)
    phi = phi1 - (n1 * tn / r1) * (d * d / 2 - (5 + 3 * t1 + 10 * c1 - 4 * c1 * c1 - 9 * _EP2) * d ** 4 / 24
                                   + (61 + 90 * t1 + 298 * c1 + 45 * t1 * t1 - 252 * _EP2 - 3 * c1 * c1)
                                   * d ** 6 / 720)
    lam = (d - (1 + 2 * t1 + c1) * d ** 3 / 6
           + (5 - 2 * c1 + 28 * t1 - 3 * c1 * c1 + 8 * _EP2 + 24 * t1 * t1) * d ** 5 / 120) / co
    return np.degrees(lam) + utm_central_meridian(zone), np.degrees(phi)


def _pair_udf(fn, zone: int, south: bool, names: tuple[str, str]):
    from pyspark.sql import SparkSession
    from pyspark.sql.functions import pandas_udf

    from dunegrid.session import ensure_on_executors
    ensure_on_executors(SparkSession.getActiveSession())

    schema = f"{names[0]} double, {names[1]} double"

    @pandas_udf(schema)
    def apply(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        u, v = fn(a.to_numpy(dtype="float64", na_value=float("nan")),
                  b.to_numpy(dtype="float64", na_value=float("nan")), zone, south)
        return pd.DataFrame({names[0]: u, names[1]: v})

    return apply


def with_utm_forward(df, lon: str, lat: str, zone: int, south: bool = False,
                     out_x: str = "x", out_y: str = "y"):
    """Add UTM (easting, northing) of (lon, lat) degree columns.

    The series is evaluated with numpy in Arrow batches (one Pandas UDF call
    per batch); as a Catalyst expression it would be too large for
    whole-stage code generation.
    """
    t = "_utm_fwd"
    return (df.withColumn(t, _pair_udf(utm_forward_np, zone, south, ("x", "y"))(F.col(lon), F.col(lat)))
              .withColumn(out_x, F.col(f"{t}.x")).withColumn(out_y, F.col(f"{t}.y")).drop(t))


def with_utm_inverse(df, x: str, y: str, zone: int, south: bool = False,
                     out_lon: str = "lon", out_lat: str = "lat"):
    """Add (lon, lat) degrees of UTM (easting, northing) columns (numpy series)."""
    t = "_utm_inv"
    return (df.withColumn(t, _pair_udf(utm_inverse_np, zone, south, ("lon", "lat"))(F.col(x), F.col(y)))
              .withColumn(out_lon, F.col(f"{t}.lon")).withColumn(out_lat, F.col(f"{t}.lat")).drop(t))
