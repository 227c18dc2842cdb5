"""Places: assets with coordinates, map clusters and the nearest entry of a gazetteer."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import place_distance2

#: Degrees of a cell; rings of cells searched before the whole gazetteer is.
CELL, RINGS = 1.0, 2
#: Places of a gazetteer at most; checked.
GAZETTEER = 200_000


def geo_assets(metadata: DataFrame) -> DataFrame:
    """(asset_id, lat, lon) of assets whose metadata have a valid pair."""
    wide = metadata.filter("key in ('latitude', 'longitude')").groupBy("asset_id").pivot("key", ["latitude", "longitude"]).agg(F.first("value_num"))
    rows = wide.select("asset_id", F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))
    return rows.filter(F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180))


def nearest_place(points: DataFrame, gazetteer: DataFrame, key: str) -> DataFrame:
    """(key, place, d2): the nearest place of every point, ties by name.

    Points meet places of the cells around them; one whose best lies within the rings is settled. The few
    others (far from all places) are compared with the whole gazetteer, whose size is checked.
    """
    cell = lambda c: F.floor(c / CELL)
    places = gazetteer.select("place", F.col("lat").alias("plat"), F.col("lon").alias("plon")).withColumns({"cy": cell(F.col("plat")), "cx": cell(F.col("plon"))})
    around = F.sequence(F.lit(-RINGS), F.lit(RINGS))
    near = points.select(key, "lat", "lon").withColumn("dy", F.explode(around)).withColumn("dx", F.explode(around)).withColumns({"cy": cell(F.col("lat")) + F.col("dy"), "cx": cell(F.col("lon")) + F.col("dx")})
    d2 = place_distance2(F.col("lat"), F.col("lon"), F.col("plat"), F.col("plon"))
    best = near.join(places, ["cy", "cx"]).groupBy(key).agg(F.min(F.struct(d2.alias("d2"), "place")).alias("best"))
    # Within the rings nothing outside them is nearer: a degree of longitude shrinks with latitude.
    sure = best.join(points.select(key, "lat"), key).filter(F.sqrt("best.d2") <= RINGS * CELL * F.cos(F.radians(F.least(F.abs("lat") + RINGS, F.lit(89.0)))))
    rest = points.select(key, "lat", "lon").join(sure.select(key), key, "left_anti")
    every = gazetteer.select("place", F.col("lat").alias("plat"), F.col("lon").alias("plon")).limit(GAZETTEER + 1).collect()
    if len(every) > GAZETTEER:
        raise ValueError(f"a gazetteer has {GAZETTEER} places at most")
    # Whatever is far from all places is compared with the gazetteer in Arrow batches, by numpy.
    names, plat, plon = np.array([p["place"] for p in every], object), np.array([p["plat"] for p in every], float), np.array([p["plon"] for p in every], float)
    order = np.argsort(names, kind="stable")  # so that the first of equally near ones is the least name
    names, plat, plon = names[order], plat[order], plon[order]

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            out = []
            for at in range(0, len(frame), 256):
                part = frame.iloc[at : at + 256]
                lat, lon = part["lat"].to_numpy(float)[:, None], part["lon"].to_numpy(float)[:, None]
                d = ((lon - plon) * np.cos(np.radians((lat + plat) / 2))) ** 2 + (lat - plat) ** 2
                i = d.argmin(axis=1)
                out.append(pd.DataFrame({key: part[key], "place": names[i], "d2": d[np.arange(len(part)), i]}))
            yield pd.concat(out) if out else pd.DataFrame({key: [], "place": [], "d2": []})

    found = sure.select(key, "best.place", "best.d2")
    if not every:
        return found
    kind = points.schema[key].dataType.simpleString()
    return found.unionByName(rest.mapInPandas(search, f"{key} {kind}, place string, d2 double"))
