"""From a mesh to the outline of its base: segments of a section become ordered rings, and rings a footprint.

A section's segments lie loose; rings() chains those of a mesh, which is one group. Rings are rows
(feature, part, ring, seq, x, y) like all shapes, so every check on borders works on meshes too.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions import geometry
from cairn.operators import raster

RINGS = "feature string, part int, ring int, seq int, x double, y double"


def chain(segments: list[tuple[float, float, float, float]], digits: int = 6) -> list[list[tuple[float, float]]]:
    """Rings of segments (x0, y0, x1, y1) that meet at their ends, rounded. Each segment is in one ring; where more than two meet,
    a ring goes on by any; open chains and segments without length are left out."""
    at: dict[tuple[float, float], list[int]] = {}
    ends = []
    for x0, y0, x1, y1 in segments:
        a, b = (round(x0, digits) + 0.0, round(y0, digits) + 0.0), (round(x1, digits) + 0.0, round(y1, digits) + 0.0)
        if a != b:
            for end in (a, b):
                at.setdefault(end, []).append(len(ends))
            ends.append((a, b))
    used = [False] * len(ends)
    out = []
    for first in range(len(ends)):
        if used[first]:
            continue
        used[first] = True
        path = [ends[first][0], ends[first][1]]
        while path[-1] != path[0]:
            here = at[path[-1]]
            while here and used[here[-1]]:
                here.pop()
            if not here:
                break
            k = here.pop()
            used[k] = True
            a, b = ends[k]
            path.append(b if a == path[-1] else a)
        if path[-1] == path[0] and len(path) > 3:
            out.append(path[:-1])
    return out


def rings(segments: DataFrame, feature: str = "feature") -> DataFrame:
    """Rings of each mesh's segments (feature, x0, y0, x1, y1), every one a part of its own; their order is that of their first points."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["x0", "y0", "x1", "y1"])
        found = chain(list(zip(rows.x0, rows.y0, rows.x1, rows.y1, strict=True)))
        name = str(rows.feature.iloc[0])
        return pd.DataFrame([(name, i, 0, k, x, y) for i, ring in enumerate(found) for k, (x, y) in enumerate(ring)], columns=["feature", "part", "ring", "seq", "x", "y"])

    return segments.select(F.col(feature).cast("string").alias("feature"), "x0", "y0", "x1", "y1").groupBy("feature").applyInPandas(run, RINGS)


def kept(outlines: DataFrame, least: float = 0.01) -> DataFrame:
    """The rings with more area than that."""
    large = geometry.ring_measures(outlines).where(F.col("area") > least).select("feature", "part", "ring")
    return outlines.join(large, ["feature", "part", "ring"])


def turned_round(outlines: DataFrame) -> DataFrame:
    """Both axes flipped and moved so that each feature starts at (0, 0), which is how borders lie."""
    most = outlines.groupBy("feature").agg(F.max("x").alias("mx"), F.max("y").alias("my"))
    return outlines.join(most, "feature").select("feature", "part", "ring", "seq", (F.col("mx") - F.col("x")).alias("x"), (F.col("my") - F.col("y")).alias("y"))


def footprint(outlines: DataFrame, cell: float) -> DataFrame:
    """feature, row, col: squares of `cell` whose centre lies in any ring. Rings are united, so a hole in a base counts as covered."""
    each = geometry.moved(outlines, sx=1 / cell, sy=1 / cell)
    single = each.select(F.concat_ws("\x1f", "feature", "part", "ring").alias("feature"), F.lit(0).alias("part"), F.lit(0).alias("ring"), "seq", "x", "y")
    return raster.rasterize(single).select(F.split("feature", "\x1f")[0].alias("feature"), "row", "col").distinct()
