"""SQL functions: transforms of a map or grid as temporary functions that Catalyst inlines."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..operators.transform import geo_of_uv, grid_place, map_uv
from ..plans.definitions import GridDef, MapDef
from .scalar import Now, Sql


LONGEST = 50_000


class Inlined(Now):
    """Steps that repeat their text in the next one: projections that iterate would make texts without bound."""

    def let(self, x):
        if isinstance(x, Sql) and len(x.sql) > LONGEST:
            raise ValueError("the projection takes too many steps for one expression: use the DataFrame functions")
        return x


def register_map(spark: SparkSession, name: str, m: MapDef) -> None:
    """``name_u(lat, lon)``, ``name_v(lat, lon)``, ``name_lat(u, v)`` and ``name_lon(u, v)`` for closed-form projections.

    Projections that iterate would repeat their steps in one expression: use the DataFrame functions for them.
    """
    u, v = map_uv(m, Inlined(), Sql("lat"), Sql("lon"))
    lat, lon = geo_of_uv(m, Inlined(), Sql("u"), Sql("v"))
    _create(spark, {f"{name}_u": ("lat", "lon", u), f"{name}_v": ("lat", "lon", v), f"{name}_lat": ("u", "v", lat), f"{name}_lon": ("u", "v", lon)})


def register_grid(spark: SparkSession, name: str, g: GridDef) -> None:
    """``name_col(lat, lon)`` and ``name_row(lat, lon)``."""
    col, row, _ = grid_place(g, Inlined(), Sql("lat"), Sql("lon"))
    _create(spark, {f"{name}_col": ("lat", "lon", col), f"{name}_row": ("lat", "lon", row)})


def _create(spark: SparkSession, functions: dict) -> None:
    for name, (a, b, body) in functions.items():
        Inlined().let(body)
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({a} DOUBLE, {b} DOUBLE) RETURNS DOUBLE RETURN {body.sql}")
