"""Column -> Column functions (local map algebra, geometry, codes)."""

from dunegrid.functions.indices import (  # noqa: F401
    albedo, band_sum, clamp, fvc, msavi, ndvi, nodata_from, rescale, rgb,
    safe_div, tgsi, threshold,
)
from dunegrid.functions.geometry import (  # noqa: F401
    morton2, lonlat_to_mercator_x, lonlat_to_mercator_y,
    mercator_to_lat, mercator_to_lon,
)
