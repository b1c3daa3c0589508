"""Page images made ready for recognition: grey, smoothed, bilevel, straightened, closed.

Works on rows of Spark's image source (``image: struct<origin, height, width, nChannels, mode, data>``, channels blue, green, red),
in Arrow batches of few images.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as K

#: Least votes of a line, angles (degrees) of lines that count, least skew that is corrected.
LINE_VOTES, ANGLES, LEAST_SKEW = 200, 45, 0.5


def grey(image: np.ndarray) -> np.ndarray:
    if image.ndim == 2 or image.shape[2] == 1:
        return image.reshape(image.shape[:2])
    return (image[..., :3] @ np.array([0.114, 0.587, 0.299])).round().astype(np.uint8)


def _around(image: np.ndarray, size: int) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(np.pad(image, size // 2, mode="edge"), (size, size))


def smoothed(image: np.ndarray) -> np.ndarray:
    """Three by three binomial weights, then the median of five by five."""
    weights = np.outer([1, 2, 1], [1, 2, 1]) / 16
    soft = np.einsum("ijkl,kl->ij", _around(image, 3), weights).round().astype(np.uint8)
    return np.median(_around(soft, 5), axis=(2, 3)).astype(np.uint8)


def bilevel(image: np.ndarray) -> np.ndarray:
    """0 and 255, cut where the variance between both sides is greatest."""
    n = np.bincount(image.ravel(), minlength=256).astype(float)
    below, mass = np.cumsum(n), np.cumsum(n * np.arange(256))
    above = below[-1] - below
    with np.errstate(divide="ignore", invalid="ignore"):
        between = below * above * (mass / below - (mass[-1] - mass) / above) ** 2
    return np.where(image > int(np.argmax(np.nan_to_num(between))), 255, 0).astype(np.uint8)


def skew(image: np.ndarray) -> float:
    """Median angle of the lines near the horizontal, in degrees; 0 without any."""
    edge = np.zeros(image.shape, bool)
    edge[1:] = image[1:] != image[:-1]
    y, x = np.nonzero(edge)
    found = []
    for degrees in range(-ANGLES + 1, ANGLES):
        a = np.deg2rad(degrees)
        votes = np.bincount((y * np.cos(a) - x * np.sin(a)).round().astype(int) + image.shape[1], minlength=1) if len(y) else np.zeros(1, int)
        found += [degrees] * int((votes >= LINE_VOTES).sum())
    return float(np.median(found)) if found else 0.0


def rotated(image: np.ndarray, degrees: float) -> np.ndarray:
    """Turned about its centre so that a line of this angle lies level; edges are carried on."""
    h, w = image.shape
    a, cy, cx = np.deg2rad(degrees), h // 2, w // 2
    y, x = np.mgrid[:h, :w] - np.array([cy, cx])[:, None, None]
    from_x, from_y = np.cos(a) * x - np.sin(a) * y + cx, np.sin(a) * x + np.cos(a) * y + cy
    return image[from_y.round().astype(int).clip(0, h - 1), from_x.round().astype(int).clip(0, w - 1)]


def closed(image: np.ndarray, size: int = 2) -> np.ndarray:
    """Greatest, then least value of each square of two."""
    for pick in (np.max, np.min):
        image = pick(np.lib.stride_tricks.sliding_window_view(np.pad(image, ((size // 2, 0), (size // 2, 0)), mode="edge"), (size, size)), axis=(2, 3))
    return image


def prepared(image: np.ndarray, deskew: bool = True) -> np.ndarray:
    flat = bilevel(smoothed(grey(image)))
    angle = skew(flat) if deskew else 0.0
    return closed(rotated(flat, angle) if abs(angle) >= LEAST_SKEW else flat)


def prepare(images: DataFrame, deskew: bool = True) -> DataFrame:
    """Adds prepared: the bilevel pixels, height * width bytes; null for an image that can't be read."""
    flat = images.select("*", F.col("image.height").alias("h_"), F.col("image.width").alias("w_"), F.col("image.nChannels").alias("c_"), F.col("image.data").alias("d_"))

    def one(h, w, c, data) -> bytes | None:
        try:
            return prepared(np.frombuffer(data, np.uint8).reshape(int(h), int(w), int(c)), deskew).tobytes()
        except (TypeError, ValueError):
            return None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.drop(columns=["h_", "w_", "c_", "d_"]).assign(prepared=[one(*x) for x in zip(pdf.h_, pdf.w_, pdf.c_, pdf.d_)])

    return flat.mapInPandas(run, K.StructType([*images.schema.fields, K.StructField("prepared", K.BinaryType())]))
