"""Renders against each other by their pixels: repairs, and two renderers of one source.

Renders are rows of pixel bytes with their width: RGB, three bytes a pixel, or RGBA, four. Each pair is one row,
compared in numpy within Arrow batches.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# How far from white ink is, how far apart channels differ, the grid and size of a component.
INK, APART = 3, 8
GRID, LEAST_PIXELS = 64, 4

REPAIR = T.StructType([
    T.StructField("problem", T.StringType()), T.StructField("diff_pixel_fraction", T.DoubleType()), T.StructField("preserved_pixel_fraction", T.DoubleType()), T.StructField("foreground_retention_fraction", T.DoubleType()),
    T.StructField("added_ink_fraction", T.DoubleType()), T.StructField("edit_locality", T.DoubleType()), T.StructField("introduced_components", T.LongType()), T.StructField("renders_match", T.BooleanType()),
])
COMPARED = T.StructType([T.StructField("problem", T.StringType()), T.StructField("mean_absolute_error", T.DoubleType()), T.StructField("differing_pixel_fraction", T.DoubleType()), T.StructField("maximum_channel_error", T.DoubleType())])


def _image(data: bytes | None, width: float | None, channels: int) -> np.ndarray | None:
    """Pixels by row and column; None where bytes and width are no image."""
    if not data or width is None or width != width or width < 1 or len(data) % (channels * int(width)):
        return None
    return np.frombuffer(data, np.uint8).reshape(-1, int(width), channels)


def thumbnail(mask: np.ndarray) -> np.ndarray:
    """The mask with no side over ``GRID``, by the pixels nearest to the middles of the grid's cells."""
    h, w = mask.shape
    if max(h, w) <= GRID:
        return mask
    rows, columns = (GRID, max(1, round(w * GRID / h))) if h >= w else (max(1, round(h * GRID / w)), GRID)
    middle = lambda n, of: ((np.arange(n) + 0.5) * (of / n)).astype(int)
    return mask[np.ix_(middle(rows, h), middle(columns, w))]


def component_sizes(mask: np.ndarray) -> list[int]:
    """Pixels of each component of a mask whose pixels touch by sides or corners. A row's pixels are
    taken as runs; runs that touch one of the row above are united."""
    h, w = mask.shape
    edges = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, start = np.nonzero(edges == 1)
    end = np.nonzero(edges == -1)[1]  # exclusive; as many as starts, in the same order
    root = list(range(len(row)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    first = np.searchsorted(row, np.arange(h + 1)).tolist()
    for r in range(1, h):
        i, j = first[r - 1], first[r]
        while i < first[r] and j < first[r + 1]:
            if start[i] <= end[j] and start[j] <= end[i]:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
            if end[i] < end[j]:
                i += 1
            else:
                j += 1
    roots = np.array([find(i) for i in range(len(root))], int)
    return np.bincount(roots, weights=end - start, minlength=len(root))[np.unique(roots)].astype(int).tolist() if len(root) else []


def _repair(before: np.ndarray | None, after: np.ndarray | None) -> tuple:
    if before is None or after is None:
        return ("no-render", *[None] * 7)
    if before.shape != after.shape:
        return ("other-canvas", *[None] * 7)
    was, now = ((255 - image[:, :, :3].astype(np.int16)).max(axis=2) > INK for image in (before, after))
    changed, added = was ^ now, now & ~was
    n, total, locality = int(changed.sum()), changed.size, 1.0
    if n:
        ys, xs = np.flatnonzero(changed.any(axis=1)), np.flatnonzero(changed.any(axis=0))
        locality = n / int((ys[-1] - ys[0] + 1) * (xs[-1] - xs[0] + 1))
    grown = sum(size >= LEAST_PIXELS for size in component_sizes(thumbnail(added)))
    return None, n / total, 1 - n / total, int((was & now).sum()) / max(1, int(was.sum())), int(added.sum()) / total, min(1.0, locality), grown, n == 0


@F.pandas_udf(REPAIR)
def _repair_udf(before: pd.Series, after: pd.Series, width: pd.Series, channels: pd.Series) -> pd.DataFrame:
    rows = [_repair(_image(b, w, int(c)), _image(a, w, int(c))) for b, a, w, c in zip(before, after, width, channels, strict=True)]
    return pd.DataFrame(rows, columns=REPAIR.names)


def repair_render(before: Column, after: Column, width: Column, channels: int = 3) -> Column:
    """How a repair changed a render: shares of pixels whose ink changed or stayed, of the ink that was kept, of
    pixels that got ink, how densely the changes fill their bounding box, components of new ink of at
    least ``LEAST_PIXELS`` on a grid of ``GRID``, and whether nothing changed. ``problem`` is set, and the
    rest null, for renders that are none or of another size."""
    return _repair_udf(before, after, width, F.lit(channels))


@F.pandas_udf(COMPARED)
def _compared_udf(left: pd.Series, right: pd.Series, width: pd.Series, channels: pd.Series) -> pd.DataFrame:
    out = []
    for a, b, w, c in zip(left, right, width, channels, strict=True):
        x, y = _image(a, w, int(c)), _image(b, w, int(c))
        if x is None or y is None or x.shape != y.shape:
            out.append(("no-render" if x is None or y is None else "other-canvas", None, None, None))
            continue
        apart = np.abs(x.astype(np.int16) - y)
        out.append((None, float(apart.mean() / 255), float((apart > APART).any(axis=2).mean()), float(apart.max() / 255)))
    return pd.DataFrame(out, columns=COMPARED.names)


def renders_compared(left: Column, right: Column, width: Column, channels: int = 4) -> Column:
    """How far two renders of one source are apart: mean and greatest error of a channel, from 0 to 1, and
    the share of pixels with a channel more than ``APART`` off."""
    return _compared_udf(left, right, width, F.lit(channels))
