"""Nearest site inside the same country.

Comparing every pair inside a country grows with the product of both sides.
Instead the right side is summarised into a hierarchy of grid cells, and every
left point walks down it: at each level it keeps only the cells that may still
hold its nearest site, judged by the distance to the cell's bounding box
against the distance to one real site per cell.  The walk is exact, and a left
point meets a handful of cells per level however crowded the right side is.

The depth follows from the data: it is the first level at which no cell holds
more than ``leaf_sites`` distinct places, so small inputs need no grid at all.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.geo import box_lower_bound_km, haversine_km
from ..session import BROADCAST_ROWS, broadcast_if_small, frozen
from .aggregates import keep_first

#: Cell edge in degrees at level 1; each further level is eight times finer.
TOP_CELL_DEGREES = 10.0
REFINEMENT = 8
DEEPEST_LEVEL = 12
LEAF_SITES = 64


def _cell(latitude: str, longitude: str, level: int) -> Column:
    """Cell of a place at a level; level 0 is one cell for the whole country."""
    if level == 0:
        return F.struct(F.lit(0).cast("long").alias("row"), F.lit(0).cast("long").alias("col"))
    edge = TOP_CELL_DEGREES / REFINEMENT ** (level - 1)
    return F.struct(
        F.floor(F.col(latitude) / edge).cast("long").alias("row"),
        F.floor(F.col(longitude) / edge).cast("long").alias("col"),
    )


def _depth(places: DataFrame, leaf_sites: int) -> int:
    for level in range(DEEPEST_LEVEL + 1):
        crowd = places.groupBy("_country", _cell("_lat", "_lon", level).alias("_cell")).agg(
            F.count(F.lit(1)).alias("n")
        )
        if (crowd.agg(F.max("n").alias("n")).first()["n"] or 0) <= leaf_sites:
            return level
    return DEEPEST_LEVEL


def _cells(places: DataFrame, level: int) -> DataFrame:
    """Bounding box and one real place of every cell, with the cell above it."""
    place = F.struct("_lat", "_lon")
    return places.groupBy(
        "_country", _cell("_lat", "_lon", level - 1).alias("_parent"),
        _cell("_lat", "_lon", level).alias("_cell"),
    ).agg(
        F.min("_lat").alias("_lat_min"), F.max("_lat").alias("_lat_max"),
        F.min("_lon").alias("_lon_min"), F.max("_lon").alias("_lon_max"),
        F.min(place).alias("_real"),
    )


def _descend(frontier: DataFrame, cells: DataFrame, within_km: float | None) -> DataFrame:
    """Replace each kept cell by its children that may still hold the nearest place."""
    children = frontier.withColumnRenamed("_cell", "_parent").join(cells, ["_country", "_parent"])
    lat, lon = F.col("_left.lat"), F.col("_left.lon")
    rated = children.withColumns({
        "_at_least": box_lower_bound_km(
            lat, lon, F.col("_lat_min"), F.col("_lat_max"), F.col("_lon_min"), F.col("_lon_max")
        ),
        "_at_most": haversine_km(lat, lon, F.col("_real._lat"), F.col("_real._lon")),
    })
    # A left place meets few cells here, so this window stays small.
    here = W.partitionBy("_country", "_left")
    best = F.min("_at_most").over(here)
    rated = rated.withColumn("_best", best)
    kept = rated.where(F.col("_at_least") <= F.col("_best"))
    if within_km is not None:
        kept = kept.where(F.col("_at_least") <= within_km)
    return kept.select("_country", "_left", "_cell")


def nearest_match(
    left: DataFrame, right: DataFrame, country: str,
    left_place: tuple[str, str], right_place: tuple[str, str],
    within_km: float | None = None, leaf_sites: int = LEAF_SITES,
    right_columns: Sequence[str] | None = None, distance: str = "dist_km",
) -> DataFrame:
    """Each left row with its nearest right row(s) in the same country, ties kept.

    ``left_place`` and ``right_place`` are (latitude, longitude) column names.
    Left rows without any right row in their country, or beyond ``within_km``
    (exclusive), do not appear.
    """
    lat, lon = left_place
    sites = right.where(F.col(right_place[0]).isNotNull() & F.col(right_place[1]).isNotNull())
    # Written once: the depth check and every level read the copy.
    places = frozen(sites.where(F.col(country).isNotNull()).select(
        F.col(country).alias("_country"),
        F.col(right_place[0]).cast("double").alias("_lat"),
        F.col(right_place[1]).cast("double").alias("_lon"),
    ).distinct())
    depth = _depth(places, leaf_sites)

    # Work on distinct places; rows come back by an equi join at the end.
    origins = left.where(
        F.col(country).isNotNull() & F.col(lat).isNotNull() & F.col(lon).isNotNull()
    ).select(
        F.col(country).alias("_country"),
        F.struct(F.col(lat).cast("double").alias("lat"), F.col(lon).cast("double").alias("lon")).alias("_left"),
    ).distinct()
    frontier = origins.withColumn("_cell", _cell("_left.lat", "_left.lon", 0))
    for level in range(1, depth + 1):
        frontier = _descend(frontier, broadcast_if_small(_cells(places, level)), within_km)
    leaves = places.withColumn("_cell", _cell("_lat", "_lon", depth))
    if places.count() <= BROADCAST_ROWS:
        leaves = F.broadcast(leaves)
    candidates = frontier.join(leaves, ["_country", "_cell"]).withColumn(
        distance, haversine_km(F.col("_left.lat"), F.col("_left.lon"), F.col("_lat"), F.col("_lon"))
    )
    if within_km is not None:
        candidates = candidates.where(F.col(distance) < within_km)
    here = W.partitionBy("_country", "_left").orderBy(distance)
    nearest = candidates.withColumn("_rank", F.rank().over(here)).where(F.col("_rank") == 1)
    nearest = nearest.select(
        "_country", F.col("_left.lat").alias("_left_lat"), F.col("_left.lon").alias("_left_lon"),
        "_lat", "_lon", distance,
    )

    wanted = right_columns if right_columns is not None else [c for c in right.columns if c != country]
    matched_sites = sites.select(
        F.col(country).alias("_country"),
        F.col(right_place[0]).cast("double").alias("_lat"),
        F.col(right_place[1]).cast("double").alias("_lon"),
        *wanted,
    )
    keyed = left.withColumns({
        "_country": F.col(country),
        "_left_lat": F.col(lat).cast("double"),
        "_left_lon": F.col(lon).cast("double"),
    })
    return (
        keyed.join(nearest, ["_country", "_left_lat", "_left_lon"])
        .join(matched_sites, ["_country", "_lat", "_lon"])
        .select(*left.columns, *wanted, distance)
    )


def nearest_within_radius(left: DataFrame, right: DataFrame, *, radius_km: float, **names) -> DataFrame:
    """Nearest match, only where it is closer than the radius.

    The radius also prunes cells on the way down, so distant regions cost nothing.
    """
    return nearest_match(left, right, within_km=radius_km, **names)


def best_match_per_row(matches: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """One match per left key where ties remain."""
    return keep_first(matches, [key], [F.col(name) for name in order])

