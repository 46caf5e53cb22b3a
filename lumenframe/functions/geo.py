"""GPS fields and place labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.functions.text import col, filled


def ratio(numerator, denominator) -> Column:
    """A rational metadata value; 0 if it is none."""
    return F.coalesce(F.try_divide(col(numerator).cast("double"), col(denominator).cast("double")), F.lit(0.0))


def gps_decimal(degrees, minutes, seconds, ref) -> Column:
    """Signed degrees to 6 decimals; NULL if not finite or beyond the axis (90 for N and S, else 180)."""
    ref = F.upper(F.substring(F.trim(col(ref)), 1, 1))
    value = col(degrees) + col(minutes) / 60 + col(seconds) / 3600
    value = F.when(ref.isin("S", "W"), -value).otherwise(value)
    limit = F.when(ref.isin("N", "S"), 90.0).otherwise(180.0)
    return F.when(~F.isnan(value) & (F.abs(value) <= limit), F.round(value, 6))


def valid_point(lat, lon) -> Column:
    lat, lon = col(lat), col(lon)
    return lat.isNotNull() & lon.isNotNull() & ~F.isnan(lat) & ~F.isnan(lon) & (F.abs(lat) <= 90) & (F.abs(lon) <= 180)


def geotagged(df: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Rows with both coordinates; (0, 0) is a place."""
    return df.where(F.col(lat).isNotNull() & F.col(lon).isNotNull())


def nearest_places(points: DataFrame, places: DataFrame, cell: float = 1.0) -> DataFrame:
    """points(lat, lon) -> lat_r, lon_r, place for each distinct pair rounded to 2 decimals.

    Places meet points through a grid of `cell` degrees and its eight neighbours. Points whose nearest candidate may lie
    outside that ring, if it is farther than the ring's width, are compared with the coarser grids of doubled cells, so the
    answer is the nearest place of all. Distances are on the unit sphere's chord. Places are keyed by grid cell and
    never multiplied by all points.
    """
    keys = points.where(valid_point("lat", "lon")).select(F.round("lat", 2).alias("lat_r"), F.round("lon", 2).alias("lon_r")).distinct()
    label = F.nullif(F.concat_ws(", ", filled("name"), filled("admin1")), F.lit(""))
    places = places.select(label.alias("place"), F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon"))
    xyz = lambda lat, lon: (F.cos(F.radians(lat)) * F.cos(F.radians(lon)), F.cos(F.radians(lat)) * F.sin(F.radians(lon)), F.sin(F.radians(lat)))
    a, b = xyz(F.col("lat_r"), F.col("lon_r")), xyz(F.col("p_lat"), F.col("p_lon"))
    chord = F.sqrt(sum((p - q) * (p - q) for p, q in zip(a, b, strict=True)))
    out, rest, size = None, keys, cell
    while True:
        # On the sphere's chord grid: cells of a cube around the unit sphere, so poles and the date line need no care.
        width = 2 * min(size, 90.0) * 3.141592653589793 / 180
        at = lambda v: [F.floor(x / F.lit(width)) for x in v]  # noqa: E731, B023
        grid = places.withColumns(dict(zip(("gx", "gy", "gz"), at(b), strict=True)))
        shift = F.explode(F.array(*[F.array(*map(F.lit, (i, j, k))) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)]))
        near = rest.withColumn("s", shift)
        near = near.withColumns({g: (x + F.get("s", F.lit(i))) for i, (g, x) in enumerate(zip(("gx", "gy", "gz"), at(a), strict=True))})
        found = near.join(grid, ["gx", "gy", "gz"]).groupBy("lat_r", "lon_r").agg(F.min_by("place", F.struct(chord.alias("d"), "p_lat", "p_lon", F.coalesce("place", F.lit("")).alias("n"))).alias("place"), F.min(chord).alias("d"))
        last = width >= 2
        sure = found if last else found.where(F.col("d") <= width)
        out = sure.select("lat_r", "lon_r", "place") if out is None else out.unionByName(sure.select("lat_r", "lon_r", "place"))
        if last:
            return out
        rest = rest.join(sure, ["lat_r", "lon_r"], "left_anti")
        size *= 8
