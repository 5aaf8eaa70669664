import math

import numpy as np
import pytest

from tessera.operators import descriptors as ds


def pixels(rows):
    return np.array([[255.0 * (c == "#") for c in r] for r in rows])


def cells_of(image):
    return [int(k) for k in np.flatnonzero(image.ravel())]


def mirrored(image, r, c):
    h, w = image.shape
    r, c = abs(r), abs(c)
    return image[2 * (h - 1) - r if r >= h else r][2 * (w - 1) - c if c >= w else c]


def brute_edges(image):
    out, b = [], image.shape[0] // 4
    for kernel in ds.EDGE_KERNELS:
        for i in range(4):
            for j in range(4):
                total = 0.0
                for r in range(i * b, (i + 1) * b):
                    for c in range(j * b, (j + 1) * b):
                        total += abs(sum(kernel[3 * (dr + 1) + dc + 1] * mirrored(image, r + dr, c + dc) for dr in (-1, 0, 1) for dc in (-1, 0, 1)))
                out.append(total)
    norm = math.sqrt(sum(x * x for x in out)) or 1.0
    return [x / norm for x in out] + [0.0] * (512 - len(out))


def brute_gradients(image):
    n = image.shape[0] // 21
    out = [0.0] * 512
    for r in range(n * 21):
        for c in range(n * 21):
            x = mirrored(image, r, c + 1) - mirrored(image, r, c - 1)
            y = mirrored(image, r + 1, c) - mirrored(image, r - 1, c)
            out[((r // 21) * n + c // 21) * 9 + int(math.degrees(math.atan2(y, x)) % 180 // 20) % 9] += math.hypot(x, y)
    return out


BLOCK = ["........", ".####...", ".####...", ".####...", "........", "......#.", "........", "........"]


def test_outlines():
    inside = pixels(BLOCK) > 0
    found = ds.outline(inside & (np.arange(8)[:, None] < 4))
    assert found.tolist() == [[1, 1], [1, 2], [1, 3], [2, 3], [3, 3], [4, 3], [4, 2], [4, 1], [3, 1], [2, 1]]
    assert ds.contour(pixels(BLOCK)).tolist() == found.tolist() and ds.area(found) == 6
    assert ds.outline(pixels(["#"]) > 0).tolist() == [[0, 0]]
    assert ds.outline(pixels(["###"]) > 0).tolist() == [[0, 0], [1, 0], [2, 0], [1, 0]]
    # The first pixel is passed twice before the walk ends.
    assert ds.outline(pixels([".#.", "#.#"]) > 0).tolist() == [[1, 0], [0, 1], [1, 0], [2, 1]]


def test_fourier_and_curvature():
    points = ds.contour(pixels(BLOCK))
    n = len(points)
    f = [sum((x + 1j * y) * np.exp(-2j * np.pi * k * t / n) for t, (x, y) in enumerate(points)) for k in range(n)]
    got = ds.fourier(points)
    assert got[: n - 1] == pytest.approx([(v / abs(f[1])).real for v in f[1:]]) and got[256 : 256 + n - 1] == pytest.approx([(v / abs(f[1])).imag for v in f[1:]])
    assert not got[n - 1 : 256].any() and len(got) == 512
    assert ds.gaussian(1.0).tolist() == pytest.approx([math.exp(-k * k / 2) / sum(math.exp(-j * j / 2) for j in range(-3, 4)) for k in range(-3, 4)])
    css = ds.curvature_space(points)
    smooth = [[sum(ds.gaussian(1)[j] * points[k + 3 - j][axis] for j in range(7) if 0 <= k + 3 - j < n) for k in range(n)] for axis in (0, 1)]
    slope = lambda v: [v[1] - v[0], *((v[k + 1] - v[k - 1]) / 2 for k in range(1, len(v) - 1)), v[-1] - v[-2]]
    (dx, dy), (ddx, ddy) = [slope(v) for v in smooth], [slope(slope(v)) for v in smooth]
    bend = [(a * d - b * c) / ((a * a + b * b) ** 1.5 + 1e-8) for a, b, c, d in zip(dx, dy, ddx, ddy, strict=True)]
    at = [k * (n - 1) / 31 for k in range(32)]
    want = [bend[int(x)] + (x - int(x)) * (bend[min(int(x) + 1, n - 1)] - bend[int(x)]) for x in at]
    assert css[:32] == pytest.approx(want) and len(css) == 512
    assert len(ds.curvature_space(np.array([[3.0, 4.0]]))) == 512


def test_gist():
    image = (np.random.default_rng(3).random((44, 44)) < 0.3) * 255.0
    got = ds.gist(image)
    assert len(got) == 512
    for s, t in ((0, 0), (1, 3), (3, 5)):
        sigma, turn = 0.5 * (s + 1) * 44 / 100, t * math.pi / 8
        r = int(6 * sigma + 1) // 2
        total = 0.0
        for y in range(11):
            for x in range(11, 22):
                seen = 0.0
                for dy in range(-r, r + 1):
                    for dx in range(-r, r + 1):
                        u, v = dx * math.cos(turn) + dy * math.sin(turn), -dx * math.sin(turn) + dy * math.cos(turn)
                        seen += math.exp(-u * u / (2 * sigma**2) - v * v / (2 * (2 * sigma) ** 2)) * math.cos(8 * u) * mirrored(image, y + dy, x + dx)
                total += abs(seen)
        assert got[(8 * s + t) * 16 + 1] == pytest.approx(total / 121)


@pytest.mark.parametrize("side", [8, 45])
def test_descriptors_of_rasters(spark, side):
    rng = np.random.default_rng(side)
    images = [(rng.random((side, side)) < p) * 255.0 for p in (0.1, 0.5, 0.95)] + [np.full((side, side), 255.0), np.zeros((side, side))]
    if side == 8:
        images.append(pixels(BLOCK))
    rows = [(k, cells_of(v)) for k, v in enumerate(images)] + [(99, None)]
    found = {r.vec_id: r for r in ds.describe(spark.createDataFrame(rows, "vec_id long, cells array<int>"), side).collect()}
    assert len(found) == len(rows)
    for k, image in enumerate(images):
        if not image.any():
            continue
        assert list(found[k].ehd) == pytest.approx(brute_edges(image), abs=1e-6)
        assert list(found[k].hog) == pytest.approx(brute_gradients(image), rel=1e-5)
        assert list(found[k].gist) == pytest.approx(ds.gist(image), rel=1e-5) and list(found[k].fourier) == pytest.approx(ds.fourier(ds.contour(image)), rel=1e-5, abs=1e-5)
    for k in (4, 99):
        assert not any(any(found[k][f]) for f in ds.FIELDS) and [len(found[k][f]) for f in ds.FIELDS] == [512] * 5 + [128]


def test_gradients_are_a_map_over_rasters(spark):
    rows = spark.createDataFrame([(1, [0, 44, 45, 45, 900]), (2, [1763]), (3, []), (4, None), (5, [50, 52])], "vec_id long, cells array<int>")
    found = ds.gradient_histograms(rows, 42)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "MapInArrow" in plan
    got = {r.vec_id: np.array(r.v) for r in found.collect()}
    for i, cells in ((1, [0, 44, 45, 900]), (5, [50, 52])):
        image = np.zeros(42 * 42)
        image[cells] = 255.0
        gy, gx = np.zeros((2, 42, 42))
        image = image.reshape(42, 42)
        gx[:, 1:-1], gy[1:-1] = image[:, 2:] - image[:, :-2], image[2:] - image[:-2]
        kind = (np.degrees(np.arctan2(gy, gx)) % 180 // 20 % 9).astype(int)
        r, c = np.mgrid[:42, :42] // 21
        assert np.allclose(got[i][:36], np.bincount(((r * 2 + c) * 9 + kind).ravel(), np.hypot(gx, gy).ravel(), 36)) and len(got[i]) == 512
    assert 3 not in got and 4 not in got
