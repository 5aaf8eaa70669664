"""Shape descriptors of rasters: Fourier, curvature scale space, edge histogram, HOG, GIST.

A raster is a square grid given by its active cells; values are 0 or 255.  Edge
histograms and HOG are sums over exploded cells in the DataFrame API: an active
cell adds its share to the filter responses of the pixels around it.  Outlines
and what is computed from them, and the Gabor bank of GIST, run per row over
Arrow batches.  The mean-pooled SIFT descriptor is in `keypoints`.  Borders are
mirrored without their edge, in SIFT empty.  Rasters without
active cells get zero vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .keypoints import SIFT_SIZE, pooled_entries

SIZE = 512
VALUE = 255.0
FIELDS = ("fourier", "css", "ehd", "hog", "gist", "sift")
PARTS = 4  # blocks along each side, of edge histograms and GIST
CELL, BINS = 21, 9  # pixels along a HOG cell's side, directions
SCALES, TURNS = 4, 8  # of the Gabor bank
#: The filters of the five edge kinds: vertical, horizontal, 45 degrees, 135 degrees, none.
EDGE_KERNELS = (
    (-1, 2, -1, -1, 2, -1, -1, 2, -1),
    (-1, -1, -1, 2, 2, 2, -1, -1, -1),
    (2, 2, -1, 2, -1, -1, -1, -1, -1),
    (-1, 2, 2, -1, -1, 2, -1, -1, -1),
    (1, 1, 1, 1, -8, 1, 1, 1, 1),
)
#: The eight neighbours of a cell, counter-clockwise on the screen from the east, as (row, column) steps.
AROUND = ((0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1), (1, 0), (1, 1))


def fitted(v: np.ndarray, size: int = SIZE) -> np.ndarray:
    out = np.zeros(size)
    out[: min(size, len(v))] = v[:size]
    return out


def gaussian(sigma: float, size: int | None = None) -> np.ndarray:
    """A normalised kernel of `size` places around zero, of about three deviations to each side unless given."""
    size = int(6 * sigma) + 1 if size is None else size
    k = np.exp(-0.5 * (np.arange(size // 2 + 1 - size, size // 2 + 1) / sigma) ** 2)
    return k / k.sum()


def regions(image: np.ndarray) -> np.ndarray:
    """Numbers of 8-connected regions, by spreading the largest label."""
    label = np.where(image > 0, np.arange(1, image.size + 1).reshape(image.shape), 0)
    while True:
        wide = np.pad(label, 1)
        spread = label.copy()
        for i, j in AROUND:
            spread = np.maximum(spread, wide[1 + i : wide.shape[0] - 1 + i, 1 + j : wide.shape[1] - 1 + j])
        spread[image <= 0] = 0
        if (spread == label).all():
            return label
        label = spread


def outline(inside: np.ndarray) -> np.ndarray:
    """All border points (x, y) of one region, counter-clockwise from its first pixel in reading order.

    Thin parts are passed on both sides; the walk ends where it would leave the first pixel as it did at the start.
    """
    wide = np.pad(inside, 1)
    start = tuple(int(v) for v in np.argwhere(wide)[0])
    step = lambda at, d: (at[0] + AROUND[d][0], at[1] + AROUND[d][1])
    # The point before the first: the first neighbour clockwise from the west.
    back = next((d % 8 for d in range(11, 3, -1) if wide[step(start, d % 8)]), None)
    if back is None:
        return np.array([[start[1] - 1.0, start[0] - 1.0]])
    before, at, points = step(start, back), start, []
    while True:
        points.append((at[1] - 1.0, at[0] - 1.0))
        turn = next(d % 8 for d in range(back + 1, back + 9) if wide[step(at, d % 8)])
        following = step(at, turn)
        if following == start and at == before:
            return np.array(points)
        at, back = following, (turn + 4) % 8


def area(points: np.ndarray) -> float:
    x, y = points[:, 0], points[:, 1]
    return 0.5 * abs(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1)))


def contour(image: np.ndarray) -> np.ndarray:
    """The outline with the largest area; of equal ones that of the region found last in reading order."""
    label = regions(image)
    found, first = np.unique(label[label > 0], return_index=True)
    return max((outline(label == found[k]) for k in np.argsort(-first)), key=area)


def fourier(points: np.ndarray, n: int = SIZE // 2) -> np.ndarray:
    """The n coefficients after the mean, over the first one's size: real parts, then imaginary ones."""
    f = np.fft.fft(points[:, 0] + 1j * points[:, 1])
    f[0] = 0
    size = abs(f[1]) if len(f) > 1 else 1.0
    f = f / size if size else f
    f = fitted(f.real, n + 1)[1:], fitted(f.imag, n + 1)[1:]
    return np.concatenate(f)


def curvature_space(points: np.ndarray, scales: int = 16, samples: int = 32) -> np.ndarray:
    """Curvature at `samples` places of the outline smoothed at `scales` widths."""
    out = []
    for sigma in range(1, scales + 1):
        x, y = (np.convolve(points[:, k], gaussian(sigma), mode="same") for k in (0, 1))
        dx, dy = np.gradient(x), np.gradient(y)
        bend = (dx * np.gradient(dy) - dy * np.gradient(dx)) / ((dx**2 + dy**2) ** 1.5 + 1e-8)
        out.append(np.interp(np.linspace(0, len(bend) - 1, samples), np.arange(len(bend)), bend))
    return np.concatenate(out)


def gabor(sigma: float, turn: float, wave: float = np.pi / 4, ratio: float = 0.5) -> np.ndarray:
    """A Gabor filter of int(6 sigma + 1) places, one more if even."""
    r = int(6 * sigma + 1) // 2
    y, x = np.mgrid[-r : r + 1, -r : r + 1]
    u, v = x * np.cos(turn) + y * np.sin(turn), -x * np.sin(turn) + y * np.cos(turn)
    return np.exp(-0.5 * (u**2 + (ratio * v) ** 2) / sigma**2) * np.cos(2 * np.pi * u / wave)


def filtered(image: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Correlation of the same size."""
    r = kernel.shape[0] // 2
    return np.einsum("ijkl,kl->ij", np.lib.stride_tricks.sliding_window_view(np.pad(image, r, mode="reflect"), kernel.shape), kernel)


def gist(image: np.ndarray) -> np.ndarray:
    """Mean responses of the Gabor bank in PARTS x PARTS blocks."""
    h, w = (n // PARTS for n in image.shape)
    out = []
    for s in range(SCALES):
        for t in range(TURNS):
            seen = np.abs(filtered(image, gabor(0.5 * (s + 1) * min(image.shape) / 100, t * np.pi / TURNS)))
            out.append(seen[: h * PARTS, : w * PARTS].reshape(PARTS, h, PARTS, w).mean((1, 3)).ravel())
    return fitted(np.concatenate(out))


def traced(cells: np.ndarray, side: int) -> dict[str, np.ndarray]:
    """Descriptors of one raster that need its outline or its whole image."""
    if not len(cells):
        return {f: np.zeros(SIZE) for f in ("fourier", "css", "gist")}
    image = np.zeros(side * side)
    image[cells] = VALUE
    image = image.reshape(side, side)
    points = contour(image)
    return {"fourier": fourier(points), "css": curvature_space(points), "gist": gist(image)}


def _pixels(vectors: DataFrame, side: int) -> DataFrame:
    """(vec_id, r, c) of active cells (vec_id, cells)."""
    cell = vectors.select("vec_id", F.explode(F.array_distinct("cells")).alias("cell"))
    return cell.select("vec_id", F.floor(F.col("cell") / side).cast("int").alias("r"), (F.col("cell") % side).cast("int").alias("c"))


def _vector(sums: DataFrame, size: int = SIZE, unit: bool = False) -> DataFrame:
    """(vec_id, v): dense vectors, of unit length if asked for, of entries (vec_id, at, x); one row's entries are at most `size`."""
    norm = F.sqrt(F.sum(F.col("x") * F.col("x"))) if unit else F.lit(1.0)
    per = sums.groupBy("vec_id").agg(F.map_from_entries(F.collect_list(F.struct("at", "x"))).alias("x"), norm.alias("norm"))
    scale = F.when(F.col("norm") > 0, F.col("norm")).otherwise(F.lit(1.0))
    return per.select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.coalesce(F.try_element_at("x", k) / scale, F.lit(0.0))).alias("v"))


def edge_histograms(vectors: DataFrame, side: int) -> DataFrame:
    """(vec_id, v): sums of absolute responses of five edge kinds in PARTS x PARTS blocks, kind by kind, of unit length; active rasters only."""
    # A border pixel's mirrored neighbours: cells next to the border stand outside it, too.
    mirrored = lambda x: F.array_compact(F.array(F.col(x), F.when(F.col(x) == 1, -1), F.when(F.col(x) == side - 2, side)))
    wide = _pixels(vectors, side).select("vec_id", F.explode(mirrored("r")).alias("r"), "c").select("vec_id", "r", F.explode(mirrored("c")).alias("c"))
    steps = F.array(*[F.struct(F.lit(k // 3 - 1).alias("dr"), F.lit(k % 3 - 1).alias("dc"), *[F.lit(VALUE * e[k]).alias(f"e{n}") for n, e in enumerate(EDGE_KERNELS)]) for k in range(9)])
    kinds = [f"e{n}" for n in range(len(EDGE_KERNELS))]
    at = wide.select("vec_id", "r", "c", F.explode(steps).alias("s")).select("vec_id", (F.col("r") - F.col("s.dr")).alias("r"), (F.col("c") - F.col("s.dc")).alias("c"), "s.*")
    block = side // PARTS
    at = at.where(f"r between 0 and {block * PARTS - 1} and c between 0 and {block * PARTS - 1}")
    response = at.groupBy("vec_id", "r", "c").agg(*[F.sum(k).alias(k) for k in kinds])
    where = (F.floor(F.col("r") / block) * PARTS + F.floor(F.col("c") / block)).cast("int")
    sums = response.groupBy("vec_id", where.alias("b")).agg(*[F.sum(F.abs(k)).alias(k) for k in kinds])
    entries = sums.select("vec_id", F.explode(F.array(*[F.struct((F.col("b") + n * PARTS * PARTS).alias("at"), F.col(k).alias("x")) for n, k in enumerate(kinds)])).alias("e")).select("vec_id", "e.*")
    return _vector(entries, unit=True)


def _gradient_kinds() -> tuple[np.ndarray, np.ndarray]:
    """(bin, magnitude) of the gradients (x, y) of 0/1 rasters, at 3 (x + 1) + y + 1."""
    x, y = VALUE * (np.arange(9) // 3 - 1.0), VALUE * (np.arange(9) % 3 - 1.0)
    angle = np.mod(np.degrees(np.arctan2(y, x)), 180.0)
    return np.mod(np.floor(angle / (180.0 / BINS)), BINS).astype(np.int64), np.sqrt(x * x + y * y)


def gradient_histograms(vectors: DataFrame, side: int) -> DataFrame:
    """(vec_id, v): unsigned gradient directions by magnitude in CELL x CELL cells; active rasters with a cell only.

    A map over rasters with distinct ids: pixels are neither exploded into rows nor shuffled, and no raster becomes dense.
    """
    cells, (kinds, sizes) = side // CELL, _gradient_kinds()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.asarray(batch["cells"].value_lengths().fill_null(0))
            row = np.repeat(np.arange(batch.num_rows), lengths)
            cell = batch["cells"].flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            row, cell = np.divmod(np.unique(row * np.int64(side * side) + cell), side * side)
            r, c = cell // side, cell % side
            keys, shares = [], []
            # At a border the mirrored neighbours are equal, so that only inner places have a share.
            for dr, dc, share in ((0, -1, 3), (0, 1, -3), (-1, 0, 1), (1, 0, -1)):
                at_r, at_c = r + dr, c + dc
                inner = at_c if dc else at_r
                own = (inner > 0) & (inner < side - 1) & (at_r < cells * CELL) & (at_c < cells * CELL)
                keys.append(((row * side + at_r) * side + at_c)[own])
                shares.append(np.full(int(own.sum()), share))
            key, at = np.unique(np.concatenate(keys), return_inverse=True)
            slope = np.bincount(at, np.concatenate(shares), len(key)).astype(np.int64) + 4
            row, place = np.divmod(key, side * side)
            entry = (place // side // CELL * cells + place % side // CELL) * BINS + kinds[slope]
            found, number = np.unique(row, return_inverse=True)
            few = entry < SIZE
            v = np.bincount(number[few] * SIZE + entry[few], sizes[slope[few]], len(found) * SIZE)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * SIZE), pa.array(v.astype(float)))
            yield pa.RecordBatch.from_arrays([batch["vec_id"].cast(pa.int64()).take(pa.array(found)), lists], names=["vec_id", "v"])

    return vectors.select("vec_id", F.col("cells").cast("array<long>").alias("cells")).mapInArrow(run, "vec_id long, v array<double>")


def _zeros(v: Column, size: int = SIZE) -> Column:
    return F.coalesce(v, F.array_repeat(F.lit(0.0), size)).cast("array<float>")


def describe(vectors: DataFrame, side: int) -> DataFrame:
    """(vec_id, fourier, css, ehd, hog, gist, sift) of rasters (vec_id, cells) with distinct ids; null cells are none."""
    names = ("fourier", "css", "gist")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [traced(np.asarray(c or [], np.int64), side) for c in batch["cells"].to_pylist()]
            arrays = [pa.array([r[f].astype(np.float32) for r in rows], pa.list_(pa.float32())) for f in names]
            yield pa.RecordBatch.from_arrays([batch["vec_id"].cast(pa.int64()), *arrays], names=["vec_id", *names])

    vectors = vectors.select("vec_id", "cells")
    out = vectors.mapInArrow(run, "vec_id long, " + ", ".join(f"{f} array<float>" for f in names))
    ehd, hog = (f(vectors, side).select(F.col("vec_id").alias(f"{n}_id"), F.col("v").alias(n)) for f, n in ((edge_histograms, "ehd"), (gradient_histograms, "hog")))
    sift = _vector(pooled_entries(vectors, side), SIFT_SIZE).select(F.col("vec_id").alias("sift_id"), F.col("v").alias("sift"))
    joined = out
    for name, made in (("ehd", ehd), ("hog", hog), ("sift", sift)):
        joined = joined.join(made, F.col("vec_id") == F.col(f"{name}_id"), "left")
    return joined.select("vec_id", "fourier", "css", _zeros(F.col("ehd")).alias("ehd"), _zeros(F.col("hog")).alias("hog"), "gist", _zeros(F.col("sift"), SIFT_SIZE).alias("sift"))
