import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import keypoints as kp
from tessera.operators.descriptors import describe

SIDE = 32


def disk(r, c, radius):
    y, x = np.mgrid[:SIDE, :SIDE]
    return (y - r) ** 2 + (x - c) ** 2 <= radius**2


def shape(r, c):
    """Two unlike disks and a bar: no symmetry."""
    image = disk(r, c, 3) | disk(r + 5, c + 7, 2)
    image[r - 1 : r + 1, c : c + 8] = True
    return image


def frame(spark, images):
    rows = [(i, None if m is None else [int(k) for k in np.flatnonzero(m.ravel())]) for i, m in enumerate(images)]
    return spark.createDataFrame(rows, "vec_id long, cells array<int>")


def vectors(entries):
    out = {}
    for row in entries.collect():
        out.setdefault(row.vec_id, np.zeros(kp.SIFT_SIZE))[row["at"]] = row.x
    return out


def brute_levels(image, octave):
    o, step, n, reach, variances = kp.octave_plan(SIDE, octave + 1)[octave]
    grid, cells = np.arange(n) * step, np.arange(SIDE)
    d = grid[:, None] - cells[None, :]
    out = []
    for v in variances:
        w = np.where(abs(d) <= reach, np.exp(-(d**2) / (2 * v)) / np.sqrt(2 * np.pi * v), 0.0)
        out.append(w @ image.astype(float) @ w.T)
    return np.array(out)


def test_levels_are_convolutions(spark):
    image = shape(10, 12)
    found = kp.levels(frame(spark, [image]), SIDE, 2).collect()
    for octave in (0, 1):
        want, seen = brute_levels(image, octave), np.zeros((len(kp.LEVELS), SIDE >> octave, SIDE >> octave))
        for row in found:
            if row.o == octave:
                seen[:, row.r, row.c] = [row[f"l{k}"] for k in kp.LEVELS]
        assert np.allclose(seen, want, atol=1e-12)


def test_keypoints_are_extrema(spark):
    image = shape(10, 12) | disk(22, 8, 3)
    table = kp.slopes(kp.levels(frame(spark, [image]), SIDE, 1), SIDE, 1).where(F.size("found") > 0)
    found = {(k, row.r, row.c) for row in table.collect() for k in row.found}
    d = np.round(np.diff(brute_levels(image, 0), axis=0), 9)
    want = set()
    for k in kp.INNER:
        for r in range(kp.BORDER, SIDE - kp.BORDER):
            for c in range(kp.BORDER, SIDE - kp.BORDER):
                v, near, a = d[k, r, c], d[k - 1 : k + 2, r - 1 : r + 2, c - 1 : c + 2], d[k]
                xx, yy = a[r, c - 1] - 2 * v + a[r, c + 1], a[r - 1, c] - 2 * v + a[r + 1, c]
                xy = (a[r + 1, c + 1] + a[r - 1, c - 1] - a[r - 1, c + 1] - a[r + 1, c - 1]) / 4
                det = xx * yy - xy * xy
                top = v == near.max() if v > 0 else v == near.min()
                if top and abs(v) >= kp.CONTRAST / kp.LAYERS and det > 0 and (xx + yy) ** 2 * kp.EDGE < (kp.EDGE + 1) ** 2 * det:
                    want.add((k, r, c))
    assert found == want and found
    assert any(abs(r - 22) <= 1 and abs(c - 8) <= 1 for _, r, c in found), "the disk has a keypoint at its centre"


def test_descriptors_keep_under_shift_and_turn(spark):
    first = shape(12, 12)
    images = [first, np.roll(first, (-2, 2), (0, 1)), np.rot90(first), np.zeros((SIDE, SIDE), bool), None]
    found = vectors(kp.pooled_entries(frame(spark, images), SIDE, octaves=1))
    assert set(found) == {0, 1, 2}, "empty and null rasters have no keypoints"
    # What the sides cut off differs a little after a shift, and nothing after a quarter turn.
    assert np.linalg.norm(found[0] - found[1]) < 0.02 * np.linalg.norm(found[0])
    assert np.linalg.norm(found[0] - found[2]) < 1e-4 * np.linalg.norm(found[0])
    other = vectors(kp.pooled_entries(frame(spark, [disk(15, 15, 5) & ~disk(13, 17, 3)]), SIDE, octaves=1))
    assert np.linalg.norm(found[0] - other[0]) > 0.1 * np.linalg.norm(found[0])


def test_described_rasters_hold_the_pooled_descriptor(spark):
    images = [shape(12, 12), None, np.zeros((SIDE, SIDE), bool)]
    rows = {r.vec_id: np.array(r.sift) for r in describe(frame(spark, images), SIDE).collect()}
    want = vectors(kp.pooled_entries(frame(spark, images), SIDE))
    assert [len(rows[i]) for i in range(3)] == [kp.SIFT_SIZE] * 3
    assert rows[0] == pytest.approx(want[0], abs=1e-3) and rows[0].any() and not rows[1].any() and not rows[2].any()


def test_no_rows(spark):
    assert kp.pooled_entries(frame(spark, [shape(2, 2)]).where("vec_id < 0"), SIDE, octaves=1).isEmpty()
