"""Spectral indices and per-cell band algebra, written once as Column functions.

Nodata rules (every operator relies on them):

* nodata is SQL NULL in flight; sentinels and NaN become NULL at the scan
  (:func:`nodata_from`), so NULL arithmetic propagates nodata for free;
* division by zero is nodata (Spark 4 runs ANSI, where ``x / 0`` raises, so
  every quotient goes through :func:`safe_div`);
* a square root of a negative number is nodata, not NaN.

All functions accept column names or Columns and stay inside whole-stage
codegen; on the ``tiles`` form apply them through ``zip_with``/``transform``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    if isinstance(x, Column):
        return x
    if isinstance(x, str):
        return F.col(x)
    return F.lit(x)


def safe_div(num, den) -> Column:
    """``num / den`` with a zero denominator giving NULL (nodata)."""
    return F.try_divide(_c(num), _c(den))


def nodata_from(x, sentinel: float | None = None) -> Column:
    """Turn NaN (and an optional sentinel value) into NULL."""
    col = _c(x).cast("double")
    cond = F.isnan(col)
    if sentinel is not None:
        cond = cond | (col == F.lit(float(sentinel)))
    return F.when(~cond, col)


def ndvi(red, nir) -> Column:
    """(nir - red) / (nir + red); nodata if either band is nodata or the sum is 0."""
    red, nir = _c(red), _c(nir)
    return safe_div(nir - red, nir + red)


def band_sum(*bands) -> Column:
    """Cell-wise sum of one or more bands; nodata in any band gives nodata."""
    if not bands:
        raise ValueError("band_sum needs at least one band")
    return reduce(lambda a, b: a + b, [_c(b) for b in bands])


def albedo(blue, red, nir, swir1, swir2) -> Column:
    """Broadband albedo from surface reflectance (Liang's five-band form)."""
    # Fixed coefficients of the albedo formula, in band order blue, red, nir,
    # swir1, swir2, then the constant term.
    return (_c(blue) * 0.356 + _c(red) * 0.13 + _c(nir) * 0.373
            + _c(swir1) * 0.085 + _c(swir2) * 0.072 - 0.0018)


def msavi(red, nir) -> Column:
    """Modified soil-adjusted vegetation index (Qi et al. 1994).

    ``(2n + 1 - sqrt((2n + 1)^2 - 8 (n - r))) / 2``; a negative radicand is
    nodata.
    """
    red, nir = _c(red), _c(nir)
    a = nir * 2 + 1
    disc = a * a - (nir - red) * 8
    return F.when(disc >= 0, (a - F.sqrt(disc)) / 2)


def tgsi(blue, green, red) -> Column:
    """Topsoil grain-size index: (red - blue) / (red + blue + green).

    The value is returned (the original declared the function as returning
    nothing, so the result was lost).
    """
    blue, green, red = _c(blue), _c(green), _c(red)
    return safe_div(red - blue, red + blue + green)


def fvc(ndvi_col, soil, veg, clamp_unit: bool = False) -> Column:
    """Fractional vegetation cover (ndvi - soil) / (veg - soil); soil == veg is nodata."""
    v = safe_div(_c(ndvi_col) - _c(soil), _c(veg) - _c(soil))
    if clamp_unit:
        v = clamp(v, 0.0, 1.0)
    return v


def threshold(z, upper: float = 10000.0) -> Column:
    """Cells above ``upper`` become nodata (``if z > upper then NODATA else z``)."""
    z = _c(z)
    return F.when(z <= F.lit(upper), z)


def clamp(z, lo: float, hi: float) -> Column:
    """Clamp data cells to [lo, hi]; nodata stays nodata.

    ``least``/``greatest`` skip NULLs in Spark, hence the explicit guard.
    """
    z = _c(z)
    return F.when(z.isNotNull(), F.least(F.greatest(z, F.lit(lo)), F.lit(hi)))


def rescale(z, old_lo: float, old_hi: float, new_lo: int = 0, new_hi: int = 255) -> Column:
    """Linear rescale to an integer range, truncating toward the lower value."""
    z = _c(z)
    v = (z - F.lit(old_lo)) * F.lit(new_hi - new_lo) / F.lit(old_hi - old_lo) + F.lit(new_lo)
    return F.floor(v).cast("int")


def rgb(red, green, blue, lo: float, hi: float) -> Column:
    """Colour composite: each band clamped to [lo, hi] and rescaled to 0..255."""
    return F.struct(
        rescale(clamp(red, lo, hi), lo, hi).alias("r"),
        rescale(clamp(green, lo, hi), lo, hi).alias("g"),
        rescale(clamp(blue, lo, hi), lo, hi).alias("b"),
    )
