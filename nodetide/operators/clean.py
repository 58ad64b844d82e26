"""Cleaning of node time series, before windowing: detrending, confound regression, band-pass, standardising.

Linear steps work on node means as well as on voxels, which is why they come after the mean. One-variable fits are built-in aggregates over the
run; several confounds and filtering need whole series at once and run as Arrow-batched functions, one group per run, whose size is the run's.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def detrend(long: DataFrame, keys: list[str], t: str = "t", x: str = "x") -> DataFrame:
    """Residuals of the line over time of each series."""
    w = W.partitionBy(*keys)
    tt, xx = F.col(t).cast("double"), F.col(x).cast("double")
    return long.withColumn(x, xx - (F.regr_intercept(xx, tt).over(w) + F.coalesce(F.regr_slope(xx, tt).over(w), F.lit(0.0)) * tt))


def standardize(long: DataFrame, keys: list[str], x: str = "x") -> DataFrame:
    """Sample z-scores of each series; NaN for constants and single frames."""
    w = W.partitionBy(*keys)
    sd = F.stddev_samp(x).over(w)
    return long.withColumn(x, F.when(sd > 0, (F.col(x) - F.avg(x).over(w)) / sd).otherwise(F.lit(float("nan"))))


def residual(long: DataFrame, keys: list[str], confound: str, x: str = "x") -> DataFrame:
    """Residuals of one confound column with an intercept."""
    w = W.partitionBy(*keys)
    c, xx = F.col(confound).cast("double"), F.col(x).cast("double")
    slope = F.coalesce(F.regr_slope(xx, c).over(w), F.lit(0.0))
    return long.withColumn(x, xx - (F.avg(xx).over(w) + slope * (c - F.avg(c).over(w))))


def butterworth(low: float | None, high: float | None, tr: float, order: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Digital Butterworth filter coefficients (b, a) by the bilinear transform; low and high are the pass band's edges in Hz."""
    nyquist = 0.5 / tr
    high = high if high and high < nyquist else None
    warp = lambda f: 4.0 * np.tan(np.pi * f * tr)  # noqa: E731  sampling at rate 2 in these units
    proto = np.exp(1j * np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order))
    if low and high:
        bw, centre = warp(high) - warp(low), np.sqrt(warp(high) * warp(low))
        half = proto * bw / 2
        root = np.sqrt(half**2 - centre**2)
        poles, zeros, gain = np.concatenate((half + root, half - root)), np.zeros(order), bw**order
    elif low:
        poles, zeros, gain = warp(low) / proto, np.zeros(order), np.real(1 / np.prod(-proto))
    elif high:
        poles, zeros, gain = proto * warp(high), np.zeros(0), warp(high) ** order
    else:
        return np.ones(1), np.ones(1)
    zd, pd_ = (4 + zeros) / (4 - zeros), (4 + poles) / (4 - poles)
    gain = gain * np.real(np.prod(4 - zeros) / np.prod(4 - poles))
    zd = np.concatenate((zd, -np.ones(len(pd_) - len(zd))))
    return np.real(gain * np.poly(zd)), np.real(np.poly(pd_))


def _filter(b: np.ndarray, a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Direct form II transposed along axis 0, from the steady state of the first sample."""
    n = max(len(a), len(b))
    b, a = np.pad(b, (0, n - len(b))), np.pad(a, (0, n - len(a)))
    companion = np.eye(n - 1) - np.column_stack((-a[1:], np.eye(n - 1)[:, : n - 2]))
    state = np.linalg.solve(companion, b[1:] - a[1:] * b[0])[:, None] * x[0] if n > 1 else np.zeros((0, x.shape[1]))
    out = np.empty_like(x)
    for t in range(len(x)):
        out[t] = b[0] * x[t] + (state[0] if n > 1 else 0)
        if n > 1:
            state = np.vstack((state[1:], np.zeros((1, x.shape[1])))) + b[1:, None] * x[t] - a[1:, None] * out[t]
    return out


def band_pass(x: np.ndarray, low: float | None, high: float | None, tr: float, order: int = 5) -> np.ndarray:
    """Zero-phase band-pass of the columns of x: forwards, then backwards, with odd reflection at both ends."""
    b, a = butterworth(low, high, tr, order)
    pad = min(3 * max(len(a), len(b)), len(x) - 1)
    if pad < 1:
        return x.copy()
    ext = np.concatenate((2 * x[:1] - x[pad:0:-1], x, 2 * x[-1:] - x[-2 : -pad - 2 : -1]))
    return _filter(b, a, _filter(b, a, ext)[::-1])[::-1][pad:-pad]


def clean_matrix(x: np.ndarray, confounds: np.ndarray | None, low: float | None, high: float | None, tr: float, detrending: bool, standardizing: bool) -> np.ndarray:
    """The whole chain on frames by nodes: detrend, band-pass (series and confounds), regress, standardise. Columns with NaN stay as they are."""
    out = x.astype(float).copy()
    use = ~np.isnan(out).any(0)
    y = out[:, use]
    if y.size:
        line = np.column_stack((np.ones(len(y)), np.arange(len(y))))
        fit = lambda d, v: v - d @ np.linalg.lstsq(d, v, rcond=None)[0]
        c = None if confounds is None or not confounds.size else np.nan_to_num(confounds.astype(float))
        if detrending:
            y, c = fit(line, y), None if c is None else fit(line, c)
        if low or high:
            y, c = band_pass(y, low, high, tr), None if c is None else band_pass(c, low, high, tr)
        if c is not None:
            c = c - c.mean(0)
            mean = y.mean(0)
            y = fit(c, y - mean) + mean
        if standardizing:
            sd = y.std(0, ddof=1)
            y = (y - y.mean(0)) / np.where(sd > 0, sd, np.nan)
    out[:, use] = y
    return out


def clean_runs(activation: DataFrame, tr: float, confounds: DataFrame | None = None, low: float | None = None, high: float | None = None, detrending: bool = False, standardizing: bool = False) -> DataFrame:
    """The array form cleaned run by run; confounds(run_key, t, c array). Does nothing if no step is asked for."""
    if confounds is None and not (low or high or detrending or standardizing):
        return activation
    d = activation if confounds is None else activation.join(confounds.select("run_key", "t", F.col("c").alias("_c")), ["run_key", "t"], "left")
    fields = [f for f in d.schema.fields if f.name != "_c"]

    def kernel(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("t").reset_index(drop=True)
        x = np.stack(frame["v"].to_numpy()).astype(float)
        c = np.stack(frame["_c"].to_numpy()) if "_c" in frame and frame["_c"].notna().all() else None
        frame["v"] = list(clean_matrix(x, c, low, high, tr, detrending, standardizing).astype(np.float32))
        return frame[[f.name for f in fields]]

    from pyspark.sql.types import StructType

    return d.groupBy("run_key").applyInPandas(kernel, StructType(fields))
