"""Scale-invariant keypoints of rasters and their mean-pooled descriptor, in the DataFrame API.

A raster's active cells add Gaussian shares to the pixels of six levels in each
octave; an octave is evaluated on every 2^o-th pixel straight from the cells, so
that none waits for another.  Levels are columns of a pixel's row.  Keypoints are
extrema of differences of neighbouring levels, directions and descriptors sums
over the pixels around a keypoint.  Up to the table of slopes the rows of a
raster stay in one partition: there is one shuffle, of the cells.

Pixels outside the raster are empty.  Keypoints stand on pixels: their place is
not interpolated, and the raster is not doubled in size at first.
"""

from __future__ import annotations

from math import ceil, log2, pi, sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import cut

#: Blur of the first level, assumed blur of the raster, inner levels of an octave, contrast, ratio of curvatures.
SIGMA, OWN_BLUR, LAYERS, CONTRAST, EDGE = 1.6, 0.5, 3, 0.04, 10.0
#: Directions of a keypoint, their share of the highest, grid and directions of a descriptor, its limit, scale and largest entry.
TURNS, PEAK, GRID, BINS, LIMIT, SCALE, MOST = 36, 0.8, 4, 8, 0.2, 512.0, 255.0
BORDER, SIFT_SIZE = 5, GRID * GRID * BINS
LEVELS = range(LAYERS + 3)
INNER = range(1, LAYERS + 1)
#: Variance that a 3 x 3 Gaussian of deviation 1 adds before anything else: two of its three weights are exp(-1/2).
FIRST_BLUR = 2 * 0.6065306597126334 / (1 + 2 * 0.6065306597126334)


def octave_count(side: int) -> int:
    return max(1, round(log2(side)) - 2)


def octave_plan(side: int, octaves: int) -> list[tuple[int, int, int, int, list[float]]]:
    """Per octave: number, pixels of a step, steps along a side, reach of the shares in pixels, variances of its levels."""
    out = []
    for o in range(octaves):
        variances = [(SIGMA * 2 ** (o + k / LAYERS)) ** 2 - OWN_BLUR**2 + FIRST_BLUR for k in LEVELS]
        out.append((o, 2**o, ceil(side / 2**o), ceil(3 * sqrt(variances[-1])), variances))
    return out


def levels(vectors: DataFrame, side: int, octaves: int) -> DataFrame:
    """(vec_id, o, r, c, l0 .. l5): blurred levels at the pixels that active cells of (vec_id, cells) reach; r and c count steps.

    Cells are dealt to as many partitions as the session shuffles to: they are few bytes, what they become is not.
    """
    octave = octave_plan(side, octaves)
    of = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("o") + 1)
    step, n, reach = (of([x[i] for x in octave]) for i in (1, 2, 3))
    rate, top = [of([-0.5 / x[4][k] for x in octave]) for k in LEVELS], [of([1 / sqrt(2 * pi * x[4][k]) for x in octave]) for k in LEVELS]
    named = lambda df: df.select("*", step.alias("step"), *[rate[k].alias(f"e{k}") for k in LEVELS], *[top[k].alias(f"t{k}") for k in LEVELS])
    near = lambda x: F.explode(F.sequence(F.greatest(F.lit(0), F.ceil((F.col(x) - reach) / step).cast("int")), F.least(n - 1, F.floor((F.col(x) + reach) / step).cast("int"))))
    away = lambda df, g, x: named(df).withColumn("d", (F.col(g) * F.col("step") - F.col(x)).cast("double"))
    weight = lambda k: F.exp(F.col("d") * F.col("d") * F.col(f"e{k}")) * F.col(f"t{k}")
    partitions = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cell = vectors.select("vec_id", "cells").repartition(partitions, "vec_id").select("vec_id", F.explode(F.array_distinct("cells")).alias("cell"))
    place = cell.select("vec_id", F.floor(F.col("cell") / side).cast("int").alias("y"), (F.col("cell") % side).cast("int").alias("x"), F.explode(F.array(*[F.lit(x[0]) for x in octave])).alias("o"))
    down = away(place.withColumn("r", near("y")), "r", "y").groupBy("vec_id", "o", "r", "x").agg(*[F.sum(weight(k)).alias(f"a{k}") for k in LEVELS])
    across = away(down.withColumn("c", near("x")), "c", "x")
    return across.groupBy("vec_id", "o", "r", "c").agg(*[F.sum(F.col(f"a{k}") * weight(k)).alias(f"l{k}") for k in LEVELS])


def slopes(blurred: DataFrame, side: int, octaves: int, border: int = BORDER) -> DataFrame:
    """(vec_id, o, n, r, c, found, gx1, gy1 ..): of each pixel the inner levels with a keypoint, and every inner level's slopes.

    n counts the steps along a side, and pixels at a side are left out.

    A keypoint is at least (or at most) as large as its 26 neighbours, has CONTRAST / LAYERS,
    is no edge, and stands `border` steps from the sides.
    """
    # Each pixel adds its levels to the nine pixels around it; what it adds depends on the step.
    around = F.array(*[F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for dr in (-1, 0, 1) for dc in (-1, 0, 1)])
    dogs = [F.round(F.col(f"l{k + 1}") - F.col(f"l{k}"), 9).alias(f"d{k}") for k in range(LAYERS + 2)]
    each = blurred.select("vec_id", "o", "r", "c", *[f"l{k}" for k in INNER], *dogs, F.explode(around).alias("s"))
    each = each.select("vec_id", "o", (F.col("r") - F.col("s.dr")).alias("r"), (F.col("c") - F.col("s.dc")).alias("c"), F.col("s.dr").alias("dr"), F.col("s.dc").alias("dc"), *[f"l{k}" for k in INNER], *[f"d{k}" for k in range(LAYERS + 2)])
    dr, dc = F.col("dr"), F.col("dc")
    middle = (dr == 0) & (dc == 0)
    along = lambda on, over: F.when(over == 0, F.when(on == 0, -2.0).otherwise(1.0)).otherwise(0.0)
    sums = []
    for k in range(LAYERS + 2):
        d = F.col(f"d{k}")
        sums += [F.max(d).alias(f"high{k}"), F.min(d).alias(f"low{k}"), F.max(F.when(middle, d)).alias(f"own{k}")]
    for k in INNER:
        d, level = F.col(f"d{k}"), F.col(f"l{k}")
        sums += [F.sum(d * along(dc, dr)).alias(f"xx{k}"), F.sum(d * along(dr, dc)).alias(f"yy{k}"), F.sum(d * dr * dc / 4).alias(f"xy{k}")]
        sums += [F.sum(F.when(dr == 0, level * dc).otherwise(0.0)).alias(f"gx{k}"), F.sum(F.when(dc == 0, -level * dr).otherwise(0.0)).alias(f"gy{k}")]
    pixel = each.groupBy("vec_id", "o", "r", "c").agg(*sums)
    n = F.element_at(F.array(*[F.lit(x[2]) for x in octave_plan(side, octaves)]), F.col("o") + 1)
    inside = lambda width: (F.least("r", "c") >= width) & (F.greatest("r", "c") < n - width)

    def keypoint(k: int) -> Column:
        own, three = F.col(f"own{k}"), (k - 1, k, k + 1)
        top = (own > 0) & (own >= F.greatest(*[f"high{j}" for j in three]))
        bottom = (own < 0) & (own <= F.least(*[f"low{j}" for j in three]))
        trace, det = F.col(f"xx{k}") + F.col(f"yy{k}"), F.col(f"xx{k}") * F.col(f"yy{k}") - F.col(f"xy{k}") * F.col(f"xy{k}")
        return (top | bottom) & (F.abs(own) >= CONTRAST / LAYERS) & (det > 0) & (trace * trace * EDGE < (EDGE + 1) ** 2 * det)

    found = F.array_compact(F.array(*[F.when(inside(border) & keypoint(k), k) for k in INNER]))
    return pixel.where(inside(1)).select("vec_id", "o", n.alias("n"), "r", "c", found.alias("found"), *[f"g{a}{k}" for k in INNER for a in "xy"])


def patches(table: DataFrame) -> DataFrame:
    """(vec_id, o, k, r, c, x, y, size, length, angle): the pixels around each keypoint, by offsets to the right and upward."""
    size = SIGMA * F.pow(F.lit(2.0), F.col("k") / LAYERS)
    reach = F.ceil(3 * size * sqrt(2) * (GRID + 1) / 2).cast("int")
    points = table.where(F.size("found") > 0).select("vec_id", "o", "n", "r", "c", F.explode("found").alias("k")).withColumn("size", size).withColumn("reach", reach)
    within = lambda low, high: F.explode(F.sequence(F.greatest(-F.col("reach"), low), F.least(F.col("reach"), high)))
    spread = points.withColumn("x", within(-F.col("c"), F.col("n") - 1 - F.col("c"))).withColumn("y", within(F.col("r") - F.col("n") + 1, F.col("r")))
    spread = spread.select("vec_id", "o", "k", "r", "c", "size", "x", "y", (F.col("r") - F.col("y")).alias("pr"), (F.col("c") + F.col("x")).alias("pc"))
    pixels = table.select("vec_id", "o", F.col("r").alias("pr"), F.col("c").alias("pc"), *[f"g{a}{k}" for k in INNER for a in "xy"])
    of = lambda a: F.element_at(F.array(*[f"g{a}{k}" for k in INNER]), F.col("k"))
    joined = spread.join(pixels, ["vec_id", "o", "pr", "pc"]).select("vec_id", "o", "k", "r", "c", "x", "y", "size", of("x").alias("gx"), of("y").alias("gy"))
    return joined.select("vec_id", "o", "k", "r", "c", "x", "y", "size", F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")).alias("length"), F.pmod(F.degrees(F.atan2("gy", "gx")), F.lit(360.0)).alias("angle"))


KEY = ("vec_id", "o", "k", "r", "c")


def directions(patch: DataFrame) -> DataFrame:
    """(vec_id, o, k, r, c, turn): a keypoint's directions in degrees: peaks of its smoothed histogram near the highest."""
    d2 = (F.col("x") * F.col("x") + F.col("y") * F.col("y")).cast("double")
    near = patch.where(F.greatest(F.abs("x"), F.abs("y")) <= F.round(4.5 * F.col("size")))
    place = (F.floor(F.col("angle") * TURNS / 360 + 0.5) % TURNS).cast("int")
    sums = near.groupBy(*KEY, place.alias("at")).agg(F.sum(F.col("length") * F.exp(-d2 / (4.5 * F.col("size") * F.col("size")))).alias("h"))
    packed = sums.groupBy(*KEY).agg(F.map_from_entries(F.collect_list(F.struct("at", "h"))).alias("h"))
    whole = F.sequence(F.lit(0), F.lit(TURNS - 1))
    value = lambda a, i: F.get(a, F.pmod(i, F.lit(TURNS)))
    plain = packed.select(*KEY, F.transform(whole, lambda i: F.coalesce(F.try_element_at("h", i), F.lit(0.0))).alias("h"))
    smooth = lambda i: F.round((value("h", i - 2) + value("h", i + 2) + 4 * (value("h", i - 1) + value("h", i + 1)) + 6 * value("h", i)) / 16, 9)
    soft = plain.select(*KEY, F.transform(whole, smooth).alias("h"))
    peak = lambda i: (value("h", i) > value("h", i - 1)) & (value("h", i) > value("h", i + 1)) & (value("h", i) >= PEAK * F.array_max("h"))
    left, own, right = (value("h", F.col("i") + j) for j in (-1, 0, 1))
    turn = F.pmod((F.col("i") + (left - right) / (2 * (left - 2 * own + right))) * (360.0 / TURNS), F.lit(360.0))
    return soft.select(*KEY, "h", F.explode(F.filter(whole, peak)).alias("i")).select(*KEY, turn.alias("turn"))


def keypoint_entries(patch: DataFrame, turned: DataFrame) -> DataFrame:
    """(vec_id, o, k, r, c, turn, at, x): entries of each keypoint's descriptor that are not zero, cut at LIMIT and of length SCALE."""
    each = patch.join(turned, list(KEY))
    angle, wide = F.radians("turn"), 3 * F.col("size")
    u = (F.col("x") * F.cos(angle) + F.col("y") * F.sin(angle)) / wide
    v = (F.col("y") * F.cos(angle) - F.col("x") * F.sin(angle)) / wide
    b = F.pmod(F.col("angle") - F.col("turn"), F.lit(360.0)) * BINS / 360
    weight = F.col("length") * F.exp(-(u * u + v * v) / (GRID * GRID / 2))
    group = (*KEY, "turn")
    placed = each.select(*group, (u + GRID / 2 - 0.5).alias("u"), (v + GRID / 2 - 0.5).alias("v"), b.alias("b"), weight.alias("w"))
    placed = placed.where((F.col("u") > -1) & (F.col("u") < GRID) & (F.col("v") > -1) & (F.col("v") < GRID))
    # Shares of the two nearest places along each of three axes.
    part = lambda a, i: F.floor(a) + i, lambda a, i: (F.col(a) - F.floor(a)) if i else (1 - F.col(a) + F.floor(a))
    corner = lambda i, j, h: F.struct(part[0]("u", i).alias("u"), part[0]("v", j).alias("v"), (part[0]("b", h) % BINS).alias("b"), (F.col("w") * part[1]("u", i) * part[1]("v", j) * part[1]("b", h)).alias("x"))
    corners = F.array(*[corner(i, j, h) for i in (0, 1) for j in (0, 1) for h in (0, 1)])
    entry = placed.select(*group, F.explode(corners).alias("e")).select(*group, "e.*").where(F.col("u").between(0, GRID - 1) & F.col("v").between(0, GRID - 1))
    sums = entry.groupBy(*group, ((F.col("v") * GRID + F.col("u")) * BINS + F.col("b")).cast("int").alias("at")).agg(F.sum("x").alias("x")).where("x > 0")
    packed = sums.groupBy(*group).agg(F.collect_list(F.struct("at", "x")).alias("e"))
    norm = lambda e: F.sqrt(F.aggregate(e, F.lit(0.0), lambda a, y: a + y["x"] * y["x"]))
    limited = packed.withColumn("norm", norm(F.col("e"))).withColumn("e", F.transform("e", lambda y: F.struct(y["at"].alias("at"), F.least(y["x"] / F.col("norm"), F.lit(LIMIT)).alias("x"))))
    scaled = limited.withColumn("norm", norm(F.col("e"))).select(*group, "norm", F.explode("e").alias("e"))
    return scaled.select(*group, F.col("e.at").alias("at"), F.least(F.col("e.x") * SCALE / F.col("norm"), F.lit(MOST)).alias("x"))


def found_keypoints(vectors: DataFrame, side: int, octaves: int | None = None, border: int = BORDER) -> DataFrame:
    """The pixels around every keypoint of the rasters (vec_id, cells) of side x side cells, as `patches` gives them."""
    octaves = octave_count(side) if octaves is None else octaves
    return cut(patches(cut(slopes(levels(vectors, side, octaves), side, octaves, border))))


def pooled_entries(vectors: DataFrame, side: int, octaves: int | None = None, border: int = BORDER) -> DataFrame:
    """(vec_id, at, x): entries of the mean descriptor of each raster's keypoints; none for rasters without keypoints.

    A keypoint with several directions counts once for each.  Null and empty cells have no keypoints.
    """
    patch = found_keypoints(vectors, side, octaves, border)
    turned = cut(directions(patch))
    count = turned.groupBy("vec_id").agg(F.count("*").alias("n"))
    sums = keypoint_entries(patch, turned).groupBy("vec_id", "at").agg(F.sum("x").alias("x"))
    return sums.join(count, "vec_id").select("vec_id", "at", (F.col("x") / F.col("n")).alias("x"))
