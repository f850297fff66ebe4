"""Fixed parameters of the registered queries (FIXTURES.md section 2.4)."""

# Period of the layer query, both ends inclusive.
PERIOD = ("1996-03-01", "1996-04-01")
# Box in cell space, c in [16, 80), r in [2, 12) as (xmin, ymin, xmax, ymax).
BOX = (16, 2, 80, 12)
# Polygon with one hole, rings as (x, y) vertex lists in cell space.
POLYGON = (
    ((10, 1), (100, 1), (100, 14), (10, 14)),
    ((40, 4), (60, 4), (60, 9), (40, 9)),
)
