"""Page images to model inputs, and models as functions over batches of rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

_F = np.float32
#: Channel means and deviations; sides and limits of the models' inputs.
MEAN, DEVIATION = np.array([0.485, 0.456, 0.406], dtype=_F), np.array([0.229, 0.224, 0.225], dtype=_F)
LAYOUT_SIDE, MASK_SIDE, TABLE_SIDE = 800, 1024, 488
DETECTOR_LIMIT, DETECTOR_CAP = 960, 4000
LINE_HEIGHT, LINE_WIDTH, LINE_LEAST, LINE_MOST = 48, 320, 16, 2560
FORMULA_SIZE, FORMULA_MEAN, FORMULA_DEVIATION, MARGIN = (192, 672), 0.7931, 0.1738, 200
CLASS_SHORT, CLASS_CROP = 256, 224


def _triangle(x: np.ndarray) -> np.ndarray:
    return np.maximum(0, 1 - np.abs(x))


def _cubic(x: np.ndarray) -> np.ndarray:
    """Catmull-Rom."""
    x = np.abs(x)
    return np.where(x < 1, 1.5 * x**3 - 2.5 * x**2 + 1, np.where(x < 2, -0.5 * x**3 + 2.5 * x**2 - 4 * x + 2, 0))


KERNELS = {"linear": (_triangle, 1.0), "cubic": (_cubic, 2.0)}


def _weights(old: int, new: int, kernel: str) -> np.ndarray:
    """(new, old): how much of each old pixel is in each new one. When shrinking, the kernel is widened."""
    shape, reach = KERNELS[kernel]
    ratio = old / new
    wide = max(1.0, ratio)
    centre = (np.arange(new) + 0.5) * ratio
    w = shape((np.arange(old)[None, :] + 0.5 - centre[:, None]) / wide)
    w[np.abs(np.arange(old)[None, :] + 0.5 - centre[:, None]) > reach * wide] = 0
    return w / w.sum(axis=1, keepdims=True)


def resize(image: np.ndarray, width: int, height: int, kernel: str = "linear") -> np.ndarray:
    """A (height, width, channels) byte image at another size."""
    if not width or not height:
        raise ValueError("a side of the target size is 0")
    h, w = image.shape[:2]
    out = np.tensordot(_weights(h, height, kernel), image.astype(np.float64), axes=(1, 0))
    out = np.tensordot(_weights(w, width, kernel), out, axes=(1, 1)).transpose(1, 0, 2)
    return np.clip(np.floor(out + 0.5), 0, 255).astype(np.uint8)


def planes(image: np.ndarray, mean: np.ndarray | float = 0.0, deviation: np.ndarray | float = 1.0) -> np.ndarray:
    """(channels, height, width) floats: shares of 255, less the mean, by the deviation."""
    return ((image.astype(_F) / _F(255) - mean) / deviation).transpose(2, 0, 1).astype(_F)


def layout_input(image: np.ndarray) -> np.ndarray:
    return planes(resize(image, LAYOUT_SIDE, LAYOUT_SIDE, "cubic"))


def mask_input(image: np.ndarray) -> np.ndarray:
    return planes(resize(image, MASK_SIDE, MASK_SIDE))


def detector_size(width: int, height: int) -> tuple[int, int]:
    """Width and height of a text detector's input: the longer side at most the limit, both multiples of 32, 32 at least."""
    ratio = min(1.0, DETECTOR_LIMIT / max(width, height))
    ratio *= min(1.0, DETECTOR_CAP / (max(width, height) * ratio))
    return tuple(max(32, int(np.floor(v * ratio / 32 + 0.5)) * 32) for v in (width, height))


def line_input(image: np.ndarray) -> np.ndarray:
    """A text line as (3, 48, width) in blue, green, red order, values from -1 to 1, zeros to the right."""
    h, w = image.shape[:2]
    if not h or not w:
        raise ValueError("a side of the image is 0")
    own = int(np.ceil(_F(LINE_HEIGHT) * (_F(w) / _F(h))))
    canvas = min(max(own, LINE_LEAST, LINE_WIDTH), LINE_MOST)
    used = max(1, min(own, canvas))
    out = np.zeros((3, LINE_HEIGHT, canvas), dtype=_F)
    out[:, :, :used] = (resize(image, used, LINE_HEIGHT).astype(_F) / _F(127.5) - 1).transpose(2, 0, 1)[::-1]
    return out


def gray(image: np.ndarray) -> np.ndarray:
    """Luma of an RGB image in whole steps."""
    return (image.astype(np.uint32) @ np.array([2126, 7152, 722], dtype=np.uint32) // 10_000).astype(np.uint8)


def without_margin(image: np.ndarray) -> np.ndarray:
    """The part around pixels darker than the margin's limit, after stretching the grays to 0 to 255; all of an even image."""
    g = gray(image).astype(_F)
    low, high = g.min(), g.max()
    if low == high:
        return image
    y, x = np.nonzero(((g - low) / (high - low) * 255).astype(np.uint8) < MARGIN)
    return image[y.min() : y.max() + 1, x.min() : x.max() + 1] if len(x) else image


def formula_input(image: np.ndarray, size: tuple[int, int] = FORMULA_SIZE) -> np.ndarray:
    """(height, width) grays of a formula without margins, scaled to fit, on black in the middle, normalised."""
    part = without_margin(image)
    h, w = part.shape[:2]
    if not h or not w:
        raise ValueError("the image is empty")
    k = min(size[0] / h, size[1] / w)
    nw, nh = max(1, int(w * k)), max(1, int(h * k))
    canvas = np.zeros((*size, 3), dtype=np.uint8)
    top, left = (size[0] - nh) // 2, (size[1] - nw) // 2
    canvas[top : top + nh, left : left + nw] = resize(part, nw, nh)
    return (gray(canvas).astype(_F) - _F(FORMULA_MEAN * 255)) / _F(FORMULA_DEVIATION * 255)


def _nearest(count: int, ratio: float, last: int, first: int = 0) -> np.ndarray:
    at = (np.arange(first, first + count, dtype=_F) + _F(0.5)) / _F(ratio) - _F(0.5)
    return np.clip(np.trunc(at + np.copysign(_F(0.5), at)), 0, last).astype(int)


def structure_input(image: np.ndarray) -> np.ndarray:
    """A table as (3, 488, 488): the longer side 488 by nearest pixels, normalised, zeros to the right and below."""
    h, w = image.shape[:2]
    ratio = _F(TABLE_SIDE) / _F(max(h, w))
    nw, nh = (min(max(int(_F(v) * ratio), 1), TABLE_SIDE) for v in (w, h))
    out = np.zeros((3, TABLE_SIDE, TABLE_SIDE), dtype=_F)
    out[:, :nh, :nw] = planes(image[_nearest(nh, ratio, h - 1)][:, _nearest(nw, ratio, w - 1)], MEAN, DEVIATION)
    return out


def class_input(image: np.ndarray) -> np.ndarray:
    """(3, 224, 224): the shorter side 256 by nearest pixels, the middle cut out, normalised."""
    h, w = image.shape[:2]
    if not h or not w:
        raise ValueError("a side of the image is 0")
    ratio = _F(CLASS_SHORT) / _F(min(h, w))
    nw, nh = (max(1, int(np.floor(_F(v) * ratio + _F(0.5)))) for v in (w, h))
    rows = _nearest(CLASS_CROP, ratio, h - 1, (nh - CLASS_CROP) // 2)
    columns = _nearest(CLASS_CROP, ratio, w - 1, (nw - CLASS_CROP) // 2)
    return planes(image[rows][:, columns], MEAN, DEVIATION)


class DecodeStep(Protocol):
    """One step of a decoder: the next token after a token at a place."""

    def __call__(self, token: int, place: int) -> int: ...


def greedy(step: DecodeStep, start: int, end: int, most: int) -> tuple[list[int], bool]:
    """Tokens up to the end mark or ``most`` of them, and whether the end mark came."""
    out, token = [], start
    for place in range(most):
        token = step(token, place)
        if token == end:
            return out, True
        out.append(token)
    return out, False


def table_class(scores: np.ndarray) -> str:
    """Which kind of table two scores name; equal ones the second."""
    if len(scores) != 2:
        raise ValueError("two scores are wanted")
    return "wireless" if scores[1] >= scores[0] else "wired"


def with_model(rows: DataFrame, load: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str) -> DataFrame:
    """Applies a model to batches of rows. ``load`` runs once in a task and gives a function from a batch to a batch of ``schema``; rows
    are not shuffled. Weights come from files that the cluster's nodes can read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for batch in batches:
            yield model(batch)

    return rows.mapInPandas(run, schema)
