"""Geometry of masks and local features as vectorized functions on arrays."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def vectorized(kind: str) -> Callable:
    """A function of series as one of columns. The UDF is made when it is used: workers import this module without a session."""

    def wrap(f: Callable) -> Callable:
        def call(*columns: Column | str) -> Column:
            return F.pandas_udf(f, kind)(*columns)

        call.__doc__ = f.__doc__
        return call

    return wrap


def grid(rows) -> np.ndarray:
    return np.array([np.asarray(r) for r in rows]) if rows is not None and len(rows) else np.zeros((0, 0))


@vectorized("double")
def sharpness(images: pd.Series) -> pd.Series:
    """Variance of horizontal and of vertical differences, added."""

    def one(rows) -> float:
        a = grid(rows).astype(float)
        return float((np.diff(a, axis=1).var() if a.shape[1:] and a.shape[1] > 1 else 0.0) + (np.diff(a, axis=0).var() if a.shape[0] > 1 else 0.0))

    return images.map(one)


def largest_blob(mask: np.ndarray) -> np.ndarray:
    """The largest 4-connected component, the first on ties."""
    seen, best = np.zeros(mask.shape, bool), []
    for start in zip(*np.nonzero(mask), strict=True):
        if seen[start]:
            continue
        todo, blob = deque([start]), []
        seen[start] = True
        while todo:
            i, j = todo.popleft()
            blob.append((i, j))
            for x in ((i - 1, j), (i + 1, j), (i, j - 1), (i, j + 1)):
                if 0 <= x[0] < mask.shape[0] and 0 <= x[1] < mask.shape[1] and mask[x] and not seen[x]:
                    seen[x] = True
                    todo.append(x)
        best = blob if len(blob) > len(best) else best
    out = np.zeros(mask.shape, bool)
    if best:
        out[tuple(np.array(best).T)] = True
    return out


@vectorized("array<array<int>>")
def largest_component(masks: pd.Series) -> pd.Series:
    return masks.map(lambda m: [r.astype(np.int32).tolist() for r in largest_blob(grid(m) > 0)])


@vectorized("angle double, confidence double, long_extent double, short_extent double, fill double")
def body_axis(masks: pd.Series) -> pd.DataFrame:
    """The principal axis of a mask: its angle in degrees, how much longer it is, the extents along and across, how much of its box it fills."""

    def one(rows) -> tuple:
        y, x = np.nonzero(grid(rows) > 0) if len(rows) else (np.zeros(0), np.zeros(0))
        if len(x) < 3:
            return None, 0.0, None, None, None
        p = np.stack([x - x.mean(), y - y.mean()])
        values, vectors = np.linalg.eigh(p @ p.T / len(x))
        along, across = vectors[:, 1] @ p, vectors[:, 0] @ p
        angle = (np.degrees(np.arctan2(vectors[1, 1], vectors[0, 1])) + 90) % 180 - 90
        box = (np.ptp(x) + 1) * (np.ptp(y) + 1)
        return float(angle), float(1 - values[0] / values[1]) if values[1] > 0 else 0.0, float(np.ptp(along)), float(np.ptp(across)), float(len(x) / box)

    return pd.DataFrame([one(m) for m in masks], columns=["angle", "confidence", "long_extent", "short_extent", "fill"])


@vectorized("array<double>")
def column_profile(masks: pd.Series, bins: pd.Series) -> pd.Series:
    """The share of a mask's pixels in each of some equal column ranges."""

    def one(rows, k: int) -> list[float]:
        a = grid(rows) > 0
        sums = np.array([s.sum() for s in np.array_split(a.sum(0) if a.size else np.zeros(k), k)], float)
        return (sums / max(sums.sum(), 1)).tolist()

    return pd.Series([one(m, int(k)) for m, k in zip(masks, bins, strict=True)])


@vectorized("string")
def thicker_end(masks: pd.Series, margin: pd.Series) -> pd.Series:
    """missing, uncertain, left or right: at which end a mask's columns are thicker by a margin, in medians over the outer fifths."""

    def one(rows, least: float) -> str:
        thick = (grid(rows) > 0).sum(0) if len(rows) else np.zeros(0)
        thick = thick[thick > 0]
        edge = len(thick) // 5
        if edge < 1:
            return "missing"
        a, b = np.median(thick[:edge]), np.median(thick[-edge:])
        return "uncertain" if abs(a - b) < least * max(a, b) else "left" if a > b else "right"

    return pd.Series([one(m, float(x)) for m, x in zip(masks, margin, strict=True)])


@vectorized("overlap int, corr double, absdiff double, iou double, dice double")
def patch_metrics(a: pd.Series, b: pd.Series, ma: pd.Series, mb: pd.Series) -> pd.DataFrame:
    """How two patches with masks agree: correlation and difference where both are, IoU and Dice of the masks."""

    def one(x, y, p, q) -> tuple:
        x, y, p, q = np.asarray(x, float), np.asarray(y, float), np.asarray(p) > 0, np.asarray(q) > 0
        both, either = p & q, p | q
        n = int(both.sum())
        if not n:
            return 0, None, None, 0.0, 0.0
        u, v = x[both] - x[both].mean(), y[both] - y[both].mean()
        scale = np.sqrt((u @ u) * (v @ v))
        return n, float(u @ v / scale) if scale > 1e-12 else 0.0, float(np.abs(x[both] - y[both]).mean()), float(n / either.sum()), float(2 * n / (p.sum() + q.sum()))

    return pd.DataFrame([one(*r) for r in zip(a, b, ma, mb, strict=True)], columns=["overlap", "corr", "absdiff", "iou", "dice"])


@vectorized("array<double>")
def stretched(values: pd.Series, low: pd.Series, high: pd.Series) -> pd.Series:
    """Gray values between two percentiles stretched to 0 to 255; a flat image stays."""

    def one(x, a: float, b: float) -> list[float]:
        x = np.asarray(x, float)
        if not len(x):
            return []
        lo, hi = np.percentile(x, [a, b])
        return x.tolist() if hi - lo < 1e-9 else np.clip((x - lo) / (hi - lo) * 255, 0, 255).tolist()

    return pd.Series([one(*r) for r in zip(values, low, high, strict=True)])


@vectorized("inliers int, h array<double>")
def homography(points_a: pd.Series, points_b: pd.Series, tolerance: pd.Series) -> pd.DataFrame:
    """Matches (x, y pairs in order) within a tolerance of the best similarity hypothesis of two of them, and the homography of those by a normalised direct linear transform."""

    def one(a, b, t: float) -> tuple:
        a, b = np.array([list(p) for p in a], float).reshape(-1, 2), np.array([list(p) for p in b], float).reshape(-1, 2)
        if len(a) < 2:
            return 0, None
        za, zb, best = a @ [1, 1j], b @ [1, 1j], np.zeros(len(a), bool)
        for i in range(len(a)):
            j = (i + 1) % len(a)
            if za[i] == za[j]:
                continue
            m = (zb[i] - zb[j]) / (za[i] - za[j])
            close = np.abs(m * (za - za[i]) + zb[i] - zb) <= t
            best = close if close.sum() > best.sum() else best
        if best.sum() < 4:
            return int(best.sum()), None

        def normal(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            c = p.mean(0)
            s = np.sqrt(2) / max(np.sqrt(((p - c) ** 2).sum(1)).mean(), 1e-12)
            return (p - c) * s, np.array([[s, 0, -s * c[0]], [0, s, -s * c[1]], [0, 0, 1]])

        (p, tp), (q, tq) = normal(a[best]), normal(b[best])
        rows = np.concatenate([np.stack([[-x, -y, -1, 0, 0, 0, u * x, u * y, u], [0, 0, 0, -x, -y, -1, v * x, v * y, v]]) for (x, y), (u, v) in zip(p, q, strict=True)])
        h = np.linalg.inv(tq) @ np.linalg.svd(rows)[2][-1].reshape(3, 3) @ tp
        return int(best.sum()), (h / h[2, 2]).ravel().tolist() if abs(h[2, 2]) > 1e-12 else None

    return pd.DataFrame([one(*r) for r in zip(points_a, points_b, tolerance, strict=True)], columns=["inliers", "h"])


@vectorized("mean double, std double, p05 double, p95 double")
def contrast(values: pd.Series) -> pd.DataFrame:
    def one(x) -> tuple:
        x = np.asarray(x, float)
        return (None,) * 4 if not len(x) else (float(x.mean()), float(x.std()), *map(float, np.percentile(x, [5, 95])))

    return pd.DataFrame([one(x) for x in values], columns=["mean", "std", "p05", "p95"])
