"""dunegrid: raster (earth-observation) analytics expressed as Spark DataFrames.

Rasters are held in two physical forms:

* ``cells``: one row per pixel, ``c`` (column) and ``r`` (row, grows downward)
  plus one column per band; nodata is SQL NULL.  Local map algebra, masks,
  joins and aggregates are plain Catalyst expressions on this form.
* ``tiles``: one row per tile, ``col_key``/``row_key`` plus ``cols``/``rows``
  and a row-major ``cells ARRAY<DOUBLE>``.  Used for storage and for
  neighbourhood work that needs a dense array.
"""

__version__ = "0.1.0"
