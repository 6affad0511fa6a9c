"""Recursive blur and unsharp masks of rasters, by tiles.

The blur is a linear recurrence y[i] = (1 - a) x[i] + a y[i - 1], run along rows in both directions and then along columns. Over a tile it
is y[last] = A y[before] + c for every row (or column), so a pass takes two looks at the tiles: the first gives A and c of each, the
second starts each tile from the state that the tiles before it compose to. Only the states of one line of tiles meet in a task
(two numbers for each pixel of a tile's side and each tile), never a row of the image. Pixels that are missing or null have no value and leave
the state as it is. A line's first pixel starts the state; on the way back its first pixel is left as it was.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.operators.shared import Written

SIDE = 256
TILES = "tr long, tc long, h int, w int, v array<double>"


def weight(blur: float) -> float:
    """The share of the state in the next pixel, for a blur radius in pixels; zero below 0.3, where nothing is blurred."""
    return 0.0 if blur < 0.3 else math.exp(math.log(0.25) / blur) ** 2


def _turned(v: np.ndarray, axis: int, back: bool) -> np.ndarray:
    """A view whose columns are taken from the left."""
    v = v.T if axis else v
    return v[:, ::-1] if back else v


def _run(v: np.ndarray, a: float, state: np.ndarray, write: bool, stop: int) -> np.ndarray:
    """The state after all columns but the last ``stop``; nan is no state yet, and takes the first value."""
    for k in range(v.shape[1] - stop):
        x = v[:, k]
        there = ~np.isnan(x)
        state = np.where(there, np.where(np.isnan(state), x, (1 - a) * x + a * state), state)
        if write:
            v[:, k] = np.where(there, state, np.nan)
    return state


def _pass(tiles: DataFrame, a: float, axis: int, back: bool, made: Written) -> DataFrame:
    line, place = ("tc", "tr") if axis else ("tr", "tc")
    square = lambda r: np.array(r.v, float).reshape(r.h, r.w)

    def local(batches):
        """Of each line of a tile: its first value, the share A of the state before it, and what it adds."""
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                v = _turned(square(r), axis, back)
                some = ~np.isnan(v)
                first = np.where(some.any(axis=1), v[np.arange(len(v)), some.argmax(axis=1)], np.nan)
                out.append((getattr(r, line), getattr(r, place), first, a ** some.sum(axis=1), _run(v, a, np.zeros(len(v)), False, 0)))
            yield pd.DataFrame(out, columns=["line", "place", "first", "share", "adds"])

    def compose(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("place", ascending=not back)
        states, state = [], np.full(max(map(len, group["first"])), np.nan)
        for first, share, adds in zip(group["first"], group["share"], group["adds"], strict=True):
            states.append(state.copy())
            n = len(first)
            state[:n] = np.where(np.isnan(first), state[:n], share * np.where(np.isnan(state[:n]), first, state[:n]) + adds)
        return pd.DataFrame({"line": group["line"], "place": group["place"], "state": states})

    coefficients = tiles.select("tr", "tc", "h", "w", "v").mapInPandas(local, "line long, place long, first array<double>, share array<double>, adds array<double>")
    states = coefficients.groupBy("line").applyInPandas(compose, "line long, place long, state array<double>")
    states = states.select(F.col("line").alias(line), F.col("place").alias(place), "state")

    def apply(batches):
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                v = square(r)
                view = _turned(v, axis, back)
                first_tile = back and getattr(r, place) == 0
                _run(view, a, np.array(r.state, float)[: len(view)], True, int(first_tile))
                out.append((r.tr, r.tc, r.h, r.w, v.ravel()))
            yield pd.DataFrame(out, columns=["tr", "tc", "h", "w", "v"])

    return made(tiles.join(states, ["tr", "tc"]).mapInPandas(apply, TILES), "blur")


def blurred(pixels: DataFrame, blur: float, side: int = SIDE) -> DataFrame:
    """pixels (row_, col, value), rows and columns from 0 -> row_, col, value, blurred by a radius in pixels; of several for one pixel the largest."""
    a = weight(blur)
    known = pixels.where("value is not null").groupBy("row_", "col").agg(F.max("value").cast("double").alias("value"))
    if a <= 0 or a >= 1:
        return known
    made = Written(pixels.sparkSession)

    def square(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        v = np.full((side, side), np.nan)
        v[rows["row_"] - key[0] * side, rows["col"] - key[1] * side] = rows["value"]
        return pd.DataFrame([(key[0], key[1], side, side, v.ravel())], columns=["tr", "tc", "h", "w", "v"])

    at = known.select(F.floor(F.col("row_") / side).alias("tr"), F.floor(F.col("col") / side).alias("tc"), "row_", "col", "value")
    tiles = made(at.groupBy("tr", "tc").applyInPandas(square, TILES), "blur")
    for _ in range(2):
        for axis in (0, 1):
            for back in (False, True):
                tiles = _pass(tiles, a, axis, back, made)
                made.drop(keep=1)
    cells = tiles.select("tr", "tc", "w", F.posexplode("v").alias("at", "value")).where(~F.isnan("value") & F.col("value").isNotNull())
    return cells.select((F.col("tr") * side + F.expr("at div w")).alias("row_"), (F.col("tc") * side + F.col("at") % F.col("w")).alias("col"), "value")


def sharpened(image: DataFrame, blur: float = 4.0, power: float = 30.0, threshold: float = 0.0, side: int = SIDE) -> DataFrame:
    """An unsharp mask on image (row_, col, r, g, b), channels from 0 to 1: the mean channel's distance from its blur is added to all channels.

    The distance is scaled by 25 (power / 100) ** 3; below the scaled threshold it fades to nothing at half of it. Pixels with a null channel are left out.
    """
    p = 2.5 * (power / 100) ** 3 * 10
    low = threshold * p / 250
    whole = image.where("row_ is not null and col is not null and r is not null and g is not null and b is not null")
    mean = ((F.col("r") + F.col("g") + F.col("b")) / 3).alias("value")
    soft = blurred(whole.select("row_", "col", mean), blur, side).withColumnRenamed("value", "soft")
    d = (mean - F.col("soft")) * p
    faded = F.when(F.abs(d) >= low, d).when(F.abs(d) > low / 2, F.signum(d) * (F.abs(d) - low / 2) * 2).otherwise(0.0)
    channel = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(c) + F.col("d"))).alias(c)
    return whole.join(soft, ["row_", "col"]).withColumn("d", faded).select("row_", "col", channel("r"), channel("g"), channel("b"))
