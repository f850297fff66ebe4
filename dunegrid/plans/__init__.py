"""Registered queries: each one is a Spark plan over the test tables plus the
equivalent DuckDB SQL used as its oracle."""

from dunegrid.plans.registry import QUERIES, get, register  # noqa: F401
from dunegrid.plans import core, grid_plans, classify_plans, ml_plans, io_plans, polygon_plans, region_plans, scene_plans  # noqa: F401,E402
