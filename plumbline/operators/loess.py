"""Seasonal-trend decomposition by local regression, STL (Cleveland et al. 1990), over row positions (TS-06).

Every smoother looks at a fixed number of positions, so an inner round reaches a fixed
distance. The series is cut into blocks that begin at a whole period; each is decomposed
with a margin on both sides as wide as all of its inner rounds reach, and the margin is dropped:
the result is that of the whole series in one piece. What looks at all positions, the
median of the residuals that robustness weights need, is an exact order statistic between two outer rounds.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.plans.aggplan import median
from plumbline.plans.shared import settled

BLOCK = 50_000


@dataclass(frozen=True)
class Spans:
    """Widths of the smoothers, all odd: over one phase of the season, the trend, and the low pass."""

    period: int = 7
    seasonal: int = 13
    trend: int | None = None
    low_pass: int | None = None

    def __post_init__(self):
        odd = lambda x: math.ceil(x) + (math.ceil(x) + 1) % 2
        if self.period < 2 or self.seasonal < 3 or self.seasonal % 2 == 0:
            raise ValueError("a period of 2 or more, an odd seasonal width of 3 or more")
        object.__setattr__(self, "trend", self.trend or odd(1.5 * self.period / (1 - 1.5 / self.seasonal)))
        object.__setattr__(self, "low_pass", self.low_pass or odd(self.period + 1))

    def reach(self) -> int:
        """Positions on either side that one inner round looks at, a whole number of periods."""
        far = self.period * (self.seasonal + 2) + 2 * self.period + self.low_pass + self.trend
        return -(-far // self.period) * self.period


def smooth(y: np.ndarray, width: int, weights: np.ndarray | None, total: int, outside: int = 0) -> np.ndarray:
    """Local linear regression at positions -outside .. len(y) - 1 + outside, over the `width` nearest points, tricube weights.

    total: the length of the series that y is a piece of; it sets from what spread of the weights on a slope is fitted.
    """
    n = len(y)
    at = np.arange(-outside, n + outside)
    q = min(width, n)
    left = np.clip(at - q // 2, 0, n - q)
    where = left[:, None] + np.arange(q)[None]
    # The largest distance within the window; a window wider than the series counts as reaching beyond it.
    h = np.maximum(at - left, left + q - 1 - at).astype(float)
    if width > total:
        h += (width - total) // 2
    r = np.abs(where - at[:, None])
    w = np.where(r <= 0.001 * h[:, None], 1.0, np.where(r <= 0.999 * h[:, None], (1 - (r / np.maximum(h, 1e-300)[:, None]) ** 3) ** 3, 0.0))
    if weights is not None:
        w = w * weights[where]
    whole = w.sum(axis=1)
    w = w / np.where(whole > 0, whole, 1)[:, None]
    centre = (w * where).sum(axis=1)
    spread = (w * (where - centre[:, None]) ** 2).sum(axis=1)
    sloped = np.sqrt(spread) > 0.001 * (total - 1)
    slope = np.where(sloped, (at - centre) / np.where(sloped, spread, 1), 0.0)
    w = w * (1 + slope[:, None] * (where - centre[:, None]))
    out = (w * y[where]).sum(axis=1)
    return np.where(whole > 0, out, y[np.clip(at, 0, n - 1)])


def _mean(x: np.ndarray, width: int) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(x, width).mean(axis=1)


def decompose_piece(y: np.ndarray, trend: np.ndarray, weights: np.ndarray | None, spans: Spans, rounds: int, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Seasonal and trend after so many inner rounds; y begins at phase 0 and is a piece of a series of `total` values."""
    p, n = spans.period, len(y)
    seasonal = np.zeros(n)
    for _ in range(rounds):
        cycle = np.zeros(n + 2 * p)
        free = y - trend
        for phase in range(min(p, n)):
            own = None if weights is None else weights[phase::p]
            cycle[phase::p] = smooth(free[phase::p], spans.seasonal, own, (total - 1 - phase) // p + 1, 1)
        low = smooth(_mean(_mean(_mean(cycle, p), p), 3), spans.low_pass, None, total)
        seasonal = cycle[p : p + n] - low
        trend = smooth(y - seasonal, spans.trend, weights, total)
    return seasonal, trend


def _round(rows: DataFrame, spans: Spans, rounds: int, total: int, block: int) -> DataFrame:
    """rows (i, y, trend, weight) with seasonal and trend after the inner rounds."""
    size = max(spans.period, block // spans.period * spans.period)
    margin = spans.reach() * rounds
    last = (total - 1) // size
    first = F.greatest(F.lit(0), F.floor((F.col("i") - margin) / size))
    until = F.least(F.lit(last), F.floor((F.col("i") + margin) / size))
    dealt = rows.withColumn("block", F.explode(F.sequence(first.cast("long"), until.cast("long"))))

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i", ignore_index=True)
        begin = int(pdf["i"].iloc[0])
        skip = -begin % spans.period  # pieces begin at phase 0
        if begin:
            pdf = pdf.iloc[skip:]
        weights = None if pdf["weight"].isna().any() else pdf["weight"].to_numpy()
        seasonal, trend = decompose_piece(pdf["y"].to_numpy(), pdf["trend"].to_numpy(), weights, spans, rounds, total)
        out = pd.DataFrame({"i": pdf["i"].to_numpy(), "y": pdf["y"].to_numpy(), "seasonal": seasonal, "trend": trend})
        return out[(out["i"] // size) == key[0]]

    return dealt.groupBy("block").applyInPandas(one, "i long, y double, seasonal double, trend double")


def stl(s: DataFrame, spans: Spans = Spans(), robust: bool = False, inner: int | None = None, outer: int | None = None, block: int = BLOCK) -> DataFrame:
    """(i, y), i from 0 without gaps: i, y, trend, seasonal, residual.

    inner, outer: rounds, by default 5 and 1, or 2 and 15 if robust. Series shorter than two periods have no rows.
    """
    inner = inner or (2 if robust else 5)
    outer = outer or (15 if robust else 1)
    rows = settled(s.select("i", "y", F.lit(0.0).alias("trend"), F.lit(None).cast("double").alias("weight")), "series")
    total = rows.count()
    if total < 2 * spans.period:
        return s.sparkSession.createDataFrame([], "i long, y double, trend double, seasonal double, residual double")
    for k in range(outer):
        found = _round(rows, spans, inner, total, block).withColumn("residual", F.col("y") - F.col("trend") - F.col("seasonal"))
        found = settled(found, "stl")
        if k + 1 < outer:
            h = 6 * (median(found, F.abs("residual")) or 0.0)
            r = F.abs("residual") / h if h > 0 else F.lit(0.0)
            weight = F.when(r <= 0.001, 1.0).when(r <= 0.999, (1 - r * r) ** 2).otherwise(0.0)
            rows = found.select("i", "y", "trend", weight.alias("weight"))
    return found.select("i", "y", "trend", "seasonal", "residual")
