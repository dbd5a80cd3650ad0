"""Neighbourhoods of cells, worked on by square tiles.

Cells are dealt to tiles of TILE x TILE once, with as wide a halo as the neighbourhood reaches; numpy
then works on whole tiles, so a cell moves once (those near a tile's rim up to four times) however
many neighbours it has. Several rasters can lie in one table: `by` names what tells them apart.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.storage import written
from cairn.operators.graph import components

CELL = ("row", "col")
TILE = 256


def mirrored(at: np.ndarray, n: int) -> np.ndarray:
    """Places on an axis of n cells, reflected at either rim, the cell at the rim repeated."""
    at = at % (2 * n)
    return np.where(at < n, at, 2 * n - 1 - at)


class Tile:
    """One tile's cells and those of its halo, from the rows dealt to it."""

    def __init__(self, table: pa.Table, halo: int, size: int) -> None:
        one = lambda c: int(table.column(c)[0].as_py())
        self.row, self.col = (np.asarray(table.column(c)) for c in CELL)
        self.low = (one("tr") * size, one("tc") * size)
        n = (one("n_rows"), one("n_cols"))
        self.high = tuple(min(m, low + size) for m, low in zip(n, self.low, strict=True))
        self.base = tuple(max(0, low - halo) for low in self.low)
        self.shape = tuple(min(m, high + halo) - base for m, high, base in zip(n, self.high, self.base, strict=True))
        self.take = tuple(mirrored(np.arange(low - halo, high + halo), m) - base for low, high, m, base in zip(self.low, self.high, n, self.base, strict=True))
        self.halo = halo

    def field(self, values: np.ndarray) -> np.ndarray:
        """The values over the tile and its halo, mirrored at the raster's rim; 0 where there is no cell."""
        held = np.zeros(self.shape, values.dtype)
        held[self.row - self.base[0], self.col - self.base[1]] = values
        return held[np.ix_(*self.take)]

    def own(self, field: np.ndarray) -> np.ndarray:
        return field[self.halo : self.halo + self.high[0] - self.low[0], self.halo : self.halo + self.high[1] - self.low[1]]

    def blurred(self, field: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """The tile's own cells, each the weighted sum of those around it on both axes."""
        height, width = (high - low for low, high in zip(self.low, self.high, strict=True))
        down = sum(w * field[k : k + height] for k, w in enumerate(weights))
        return sum(w * down[:, k : k + width] for k, w in enumerate(weights))

    def places(self, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row, col = np.nonzero(where)
        return (row + self.low[0]).astype(np.int32), (col + self.low[1]).astype(np.int32)


def sized(cells: DataFrame, by: tuple[str, ...], shape: tuple[int, int] | None) -> DataFrame:
    """The cells with n_rows and n_cols: the shape given, or what the cells of each raster need."""
    if shape is not None:
        return cells.withColumns({"n_rows": F.lit(shape[0]), "n_cols": F.lit(shape[1])})
    most = [(F.max(c) + 1).alias(n) for c, n in zip(CELL, ("n_rows", "n_cols"), strict=True)]
    if by:
        return cells.join(cells.groupBy(*by).agg(*most), list(by))
    return cells.crossJoin(F.broadcast(cells.agg(*most)))  # one row


def over_tiles(cells: DataFrame, halo: int, by: tuple[str, ...], schema: str, work: Callable[[Tile, pa.Table], dict[str, np.ndarray]], size: int = TILE) -> DataFrame:
    """What `work` makes of each tile (row, col and more, as in schema), with the columns of by. cells: as sized() gives them."""
    span = lambda c, n: F.explode(F.sequence(F.greatest(F.lit(0), F.floor((F.col(c) - halo) / size)), F.least(F.floor((F.col(n) - 1) / size), F.floor((F.col(c) + halo) / size))))
    dealt = cells.withColumn("tr", span("row", "n_rows")).withColumn("tc", span("col", "n_cols"))
    kinds = ", ".join([*(f"{b} {cells.schema[b].dataType.simpleString()}" for b in by), schema])

    def run(table: pa.Table) -> pa.Table:
        got = work(Tile(table, halo, size), table)
        n = len(got["row"])
        keys = {b: table.column(b).combine_chunks().take(pa.array(np.zeros(n, np.int64))) for b in by}
        return pa.table({**keys, **got})

    return dealt.groupBy(*by, "tr", "tc").applyInArrow(run, kinds)


def blur(cells: DataFrame, weights: list[float], values: list[str], by: tuple[str, ...], shape: tuple[int, int] | None) -> DataFrame:
    """by, row, col and the blurred values, for all cells of the tiles in which, or near which, there are cells."""
    kernel = np.array(weights)

    def work(tile: Tile, table: pa.Table) -> dict[str, np.ndarray]:
        out = {v: tile.blurred(tile.field(np.nan_to_num(table.column(v).to_numpy().astype(np.float64))), kernel).reshape(-1) for v in values}
        row, col = tile.places(np.ones([h - low for low, h in zip(tile.low, tile.high, strict=True)], bool))
        return {"row": row, "col": col, **out}

    own = sized(cells.select(*by, *CELL, *values), by, shape)
    return over_tiles(own, len(weights) // 2, by, "row int, col int, " + ", ".join(f"{v} double" for v in values), work)


def masked_blur(cells: DataFrame, weights: list[float], by: tuple[str, ...], shape: tuple[int, int] | None) -> DataFrame:
    """by, row, col, z, weight, blurred for each cell: the blur over those that have a z, renormalised; null where none is near."""
    kernel = np.array(weights)

    def work(tile: Tile, table: pa.Table) -> dict:
        z = table.column("z").to_numpy().astype(np.float64)
        some = ~np.isnan(z)
        field, weight = (tile.blurred(tile.field(x), kernel) for x in (np.where(some, z, 0.0), some.astype(np.float64)))
        there = tile.own(tile.field(np.ones(len(z), bool)))
        raw = tile.own(tile.field(np.where(some, z, np.nan)))[there]
        field, weight = field[there], weight[there]
        row, col = tile.places(there)
        near = weight > 0
        return {"row": row, "col": col, "z": pa.array(raw, mask=np.isnan(raw)), "weight": weight, "blurred": pa.array(field / np.where(near, weight, 1), mask=~near)}

    own = sized(cells.select(*by, *CELL, F.col("z").cast("double").alias("z")), by, shape)
    return over_tiles(own, len(weights) // 2, by, "row int, col int, z double, weight double, blurred double", work)


def joined_cells(row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """For each cell the place, among the cells, of the first (by row, then col) that a path of four neighbours leads to."""
    if not len(row):
        return np.zeros(0, np.int64)
    order = np.lexsort((col, row))
    r, c = row[order].astype(np.int64), col[order].astype(np.int64)
    head = np.ones(len(r), bool)
    head[1:] = (r[1:] != r[:-1]) | (c[1:] != c[:-1] + 1)
    run = np.cumsum(head) - 1
    wide = int(c.max()) + 2
    key = r * wide + c
    below = np.minimum(np.searchsorted(key, key + wide), len(key) - 1)
    hit = key[below] == key + wide
    a, b = run[hit], run[below[hit]]
    root = np.arange(run[-1] + 1)
    while True:
        x, y = root[a], root[b]
        if (x == y).all():
            break
        low = np.minimum(x, y)
        np.minimum.at(root, x, low)
        np.minimum.at(root, y, low)
        while not (root[root] == root).all():
            root = root[root]
    out = np.empty(len(r), np.int64)
    out[order] = order[np.flatnonzero(head)[root[run]]]
    return out


def label(mask: DataFrame, n_cols: int, by: tuple[str, ...] = (), size: int = TILE) -> DataFrame:
    """by, row, col, component of each cell of the mask: four neighbours; the least row * n_cols + col names a component.

    Cells are joined inside tiles; only the cells on two sides of a tile's rim then make a graph, of tiles' components.
    """
    def run(table: pa.Table) -> pa.Table:
        row, col = (np.asarray(table.column(c)) for c in CELL)
        first = joined_cells(row, col)
        name = row[first].astype(np.int64) * n_cols + col[first]
        return pa.table({**{b: table.column(b) for b in by}, "row": row, "col": col, "local": name})

    kinds = ", ".join([*(f"{b} {mask.schema[b].dataType.simpleString()}" for b in by), "row int, col int, local long"])
    dealt = mask.select(*by, *(F.col(c).cast("int").alias(c) for c in CELL)).distinct().withColumns({f"t{c}": F.floor(F.col(c) / size) for c in CELL})
    inside = written(dealt.groupBy(*by, "trow", "tcol").applyInArrow(run, kinds))
    node: Column = F.struct(*by, "local") if by else F.col("local")
    edges = None
    for c in CELL:
        before = inside.where(F.col(c) % size == size - 1).withColumn(c, F.col(c) + 1).select(*by, *CELL, node.alias("a"))
        after = inside.where(F.col(c) % size == 0).select(*by, *CELL, node.alias("b"))
        both = before.join(after, [*by, *CELL]).select("a", "b")
        edges = both if edges is None else edges.unionByName(both)
    found = components(edges.distinct())
    least = F.col("component.local") if by else F.col("component")
    return inside.withColumn("node", node).join(found, "node", "left").select(*by, *CELL, F.coalesce(least, "local").alias("component"))
