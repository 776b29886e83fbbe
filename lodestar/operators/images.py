"""Image operators over tables of pixels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.operators import graph

#: Width and height of a tile.
TILE = 32
_PARTS = ["kind", "y", "x", "x0", "y0", "x1", "y1", "area"]


def _label(cells: np.ndarray) -> np.ndarray:
    """For sorted cells (tile * TILE^2 + y * TILE + x within the tile) the place of the first cell of each one's region."""
    label, edges = np.arange(len(cells)), []
    for step, last in ((1, cells % TILE), (TILE, cells // TILE % TILE)):
        a = np.flatnonzero(last < TILE - 1)
        b = np.searchsorted(cells, cells[a] + step)
        there = cells[np.minimum(b, len(cells) - 1)] == cells[a] + step
        edges.append((a[there], b[there]))
    a, b = (np.concatenate(x) for x in zip(*edges, strict=True))
    while True:
        one, other = label[a], label[b]
        apart = one != other
        if not apart.any():
            return label
        np.minimum.at(label, np.maximum(one, other)[apart], np.minimum(one, other)[apart])
        while (label != label[label]).any():
            label = label[label]


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (image, ty, tx, cells). Kind 0: a tile's region, by its first pixel (y, x), with its box and area. Kind 1:
    a region and a place (x0, y0) beyond the tile that it touches, to the right or below. Kind 2: a region and its
    pixel in the tile's first column or row."""
    for batch in batches:
        lists = batch.column(3)
        n = np.asarray(lists.value_lengths()).astype(np.int64)
        if not n.sum():
            continue
        tile = np.repeat(np.arange(len(n)), n)
        cells = np.sort(tile * TILE**2 + np.asarray(lists.flatten()))
        ty, tx = (np.asarray(batch.column(i)).astype(np.int64)[tile] * TILE for i in (1, 2))
        within_y, within_x = cells // TILE % TILE, cells % TILE
        y, x = ty + within_y, tx + within_x
        label = _label(cells)
        first, at = np.unique(label, return_inverse=True)
        box = [np.full(len(first), v) for v in (x.max(), y.max(), x.min(), y.min())]
        for made, place, v in zip(box, (np.minimum.at, np.minimum.at, np.maximum.at, np.maximum.at), (x, y, x, y), strict=True):
            place(made, at, v)
        rows = [(first, np.zeros(len(first), np.int64), [box[0], box[1], box[2] + 1, box[3] + 1, np.bincount(at)])]
        for kind, some, dx, dy in ((1, within_x == TILE - 1, 1, 0), (1, within_y == TILE - 1, 0, 1), (2, (within_x == 0) | (within_y == 0), 0, 0)):
            k = np.flatnonzero(some)
            rows.append((label[k], np.full(len(k), kind), [x[k] + dx, y[k] + dy, *[np.zeros(len(k), np.int64)] * 3]))
        node = np.concatenate([r[0] for r in rows])
        columns = [np.concatenate([r[1] for r in rows]), y[node], x[node], *(np.concatenate(c) for c in zip(*(r[2] for r in rows), strict=True))]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(tile[node])), *(pa.array(c, pa.int64()) for c in columns)], ["image", *_PARTS])


def regions(spark: SparkSession, pixels: DataFrame, width: int, height: int, least: int = 1) -> DataFrame:
    """image, x0, y0, x1, y1 (both ends beyond), area of the 4-connected regions of the pixels (image, x, y)
    that have ``least`` pixels or more and don't fill the sheet (0.95 of its width and 0.9 of its height).
    Pixels are gathered by tiles, whose regions are found at once; those that touch across tiles are joined as
    components over the edges between them, so no image is gathered in one task and only borders are joined.
    Pixels with a null are left out, repeated ones count once; an empty table gives no rows."""
    p = pixels.select("image", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x")).dropna()
    bits = TILE.bit_length() - 1
    cell = (F.col("y").bitwiseAND(F.lit(TILE - 1)) * TILE + F.col("x").bitwiseAND(F.lit(TILE - 1))).cast("int")
    tiles = p.groupBy("image", F.shiftright("y", bits).alias("ty"), F.shiftright("x", bits).alias("tx")).agg(F.collect_set(cell).alias("cells"))
    kind = p.schema["image"].dataType.simpleString()
    parts = graph._cut(spark, tiles.mapInArrow(_tiles, f"image {kind}, " + ", ".join(f"{c} long" for c in _PARTS)))
    node = F.struct("image", "y", "x")
    side = lambda k, name: parts.where(F.col("kind") == k).select(node.alias(name), "image", "x0", "y0")
    # sizes of what a tile gives are not known to the planner: nothing here may be broadcast on its guess
    edges = graph._cut(spark, side(1, "a").join(side(2, "b").hint("merge"), ["image", "x0", "y0"]).select("a", "b").distinct())
    found = parts.where("kind = 0").withColumn("component", node)
    if not edges.isEmpty():
        joined = graph.components(spark, edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct(), edges)
        joined = joined.select("node", F.col("component").alias("least"))
        found = found.withColumnRenamed("component", "node").join(joined.hint("merge"), "node", "left").withColumn("component", F.coalesce("least", "node")).drop("node", "least")
    found = found.groupBy("component").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.sum("area").alias("area"))
    fills = ((F.col("x1") - F.col("x0")) / width > 0.95) & ((F.col("y1") - F.col("y0")) / height > 0.9)
    return found.where((F.col("area") >= least) & ~fills).select(F.col("component.image").alias("image"), "x0", "y0", "x1", "y1", "area")
