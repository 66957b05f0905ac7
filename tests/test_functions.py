"""Closed forms and properties of the array functions."""

import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from steadymark.functions import corruption, curves, explanation, scores
from steadymark.functions.arrays import let, mean, stddev_pop


def one(spark, column, **arrays):
    df = spark.createDataFrame([tuple(list(map(float, a)) for a in arrays.values())], [f"{n}" for n in arrays])
    return df.select(column.alias("v")).first()["v"]


def test_entropy_extremes(spark):
    assert one(spark, explanation.attention_entropy(F.col("h")), h=[0.25] * 4) == pytest.approx(1.0, abs=1e-8)
    assert one(spark, explanation.attention_entropy(F.col("h")), h=[1, 0, 0, 0]) == pytest.approx(0.0, abs=1e-7)


def test_gini_extremes(spark):
    assert one(spark, explanation.gini_sparsity(F.col("h")), h=[3, 3, 3, 3]) == pytest.approx(0.0, abs=1e-9)
    assert one(spark, explanation.gini_sparsity(F.col("h")), h=[0, 0, 5, 0]) == pytest.approx(0.75, abs=1e-9)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.floats(0.001, 1e3), min_size=5, max_size=5), min_size=1, max_size=20), st.randoms())
def test_metrics_are_bounded_and_ignore_order(spark, values, random):
    shuffled = [random.sample(v, len(v)) for v in values]
    df = spark.createDataFrame(list(zip(values, shuffled)), "a array<double>, b array<double>")
    for metric in (explanation.attention_entropy, explanation.gini_sparsity):
        a, b = (metric(explanation.normalise(F.col(c))) for c in "ab")
        for row in df.select(a.alias("a"), b.alias("b")).collect():
            assert -1e-9 <= row["a"] <= 1 + 1e-6
            assert row["a"] == pytest.approx(row["b"], abs=1e-9)


def test_attention_heatmap_averages_heads_and_drops_the_class_token(spark):
    heads = [[0.5, 0.2, 0.3], [0.1, 0.6, 0.3]]
    df = spark.createDataFrame([(heads,)], "rows array<array<double>>")
    got = df.select(explanation.attention_heatmap(F.col("rows")).alias("h")).first()["h"]
    assert got == pytest.approx([0.4 / 0.7, 0.3 / 0.7])


def test_moments(spark):
    x = [1.0, 2.0, 4.0]
    assert one(spark, mean(F.col("x")), x=x) == pytest.approx(np.mean(x))
    assert one(spark, stddev_pop(F.col("x")), x=x) == pytest.approx(np.std(x))
    assert one(spark, let(F.size("x"), lambda n: n * n), x=x) == 9


def test_contrast(spark):
    x = [0.0, 100.0, 255.0]
    assert one(spark, corruption.contrast(F.col("x"), 1.0), x=x) == pytest.approx(x)
    mu = np.mean(x)
    pixels = one(spark, corruption.contrast(F.col("x"), 1.5, pixels=True), x=x)
    assert pixels == [math.floor(min(255, max(0, (v - mu) * 1.5 + mu))) for v in x]


def test_blur_keeps_a_constant_image_and_the_mean_of_channels_apart(spark):
    flat = [7.0] * 24
    assert one(spark, corruption.gaussian_blurs(F.col("x"), [1.0, 6.0], 4, 6), x=flat)[1] == pytest.approx(flat)
    two = [1.0, 9.0] * 12
    assert one(spark, corruption.gaussian_blurs(F.col("x"), [3.0], 3, 4, 2), x=two)[0] == pytest.approx(two)


def test_blur_of_a_point_is_the_kernel(spark):
    image = np.zeros((9, 9))
    image[4, 4] = 1.0
    got = np.array(one(spark, corruption.gaussian_blurs(F.col("x"), [1.0], 9, 9), x=image.ravel())[0]).reshape(9, 9)
    kernel = np.exp(-np.arange(-3, 4) ** 2 / 2.0)
    kernel /= kernel.sum()
    assert got[1:8, 1:8] == pytest.approx(np.outer(kernel, kernel))


def test_noise_does_not_depend_on_the_partitioning(spark):
    df = spark.range(200).select("id", F.array_repeat(F.lit(0.0), 16).alias("x"))
    noisy = lambda rows: {
        r["id"]: r["n"] for r in rows.select("id", corruption.gaussian_noise(F.col("x"), 40.0, F.col("id")).alias("n")).collect()
    }
    first, second = noisy(df.repartition(1)), noisy(df.repartition(7, F.rand(1)))
    assert first == second
    values = np.array(list(first.values())).ravel()
    assert abs(values.mean()) < 3 and 37 < values.std() < 43


def test_corrupted_variants_are_nine(spark):
    df = spark.createDataFrame([(1, [10.0] * 12)], "id int, x array<double>")
    variants = corruption.corrupted_variants(F.col("x"), F.col("id"), 2, 2, 3, pixels=True)
    rows = df.select(F.inline(variants)).collect()
    assert {(r["corruption_type"], r["corruption_level"]) for r in rows} == {
        (kind, level) for kind in corruption.SEVERITIES for level in corruption.LEVELS
    }
    assert all(0 <= v <= 255 and v == int(v) for r in rows for v in r["vector"])
    assert all(r["vector"] == [10.0] * 12 for r in rows if r["corruption_type"] != "gaussian_noise")


def test_scores(spark):
    assert one(spark, scores.argmax(F.col("z")), z=[1, 5, 5, 2]) == 1
    z = np.array([1000.0, 1001.0, 999.0])
    expected = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    assert one(spark, scores.softmax_at(F.col("z"), F.lit(0)), z=z) == pytest.approx(expected[0])


def test_trapezoid_of_a_constant(spark):
    assert one(spark, curves.trapezoid(F.col("s")), s=[0.3] * 12) == pytest.approx(0.3)


def test_patch_grid():
    # Three patches of side 14 fit a row of 45 pixels.
    assert curves.PatchGrid(width=45, patch=14).per_row == 3


def masked_curves(x, h, w, b, steps, patch_of, channels):
    """Curves by scoring every mask, as an independent reference."""
    soft = lambda z: np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    order = np.argsort(-h, kind="stable")
    size = max(1, len(h) // steps)
    target = int(np.argmax(w @ x + b))
    fill = np.array([x[c::channels].mean() for c in range(channels)])[np.arange(len(x)) % channels]
    removed, shown = x.copy(), np.zeros_like(x)
    deletion, insertion = [soft(w @ removed + b)[target]], [soft(w @ shown + b)[target]]
    for start in range(0, len(h), size):
        inside = np.isin(patch_of, order[start : start + size])
        removed[inside], shown[inside] = fill[inside], x[inside]
        deletion.append(soft(w @ removed + b)[target])
        insertion.append(soft(w @ shown + b)[target])
    area = lambda s: np.trapezoid(s, np.linspace(0, 1, len(s)))
    return deletion, insertion, area(deletion) / max(deletion[0], 1e-10), area(insertion), target


@pytest.mark.parametrize(
    ("height", "width", "patch", "channels", "steps"), [(1, 32, 1, 1, 10), (4, 4, 2, 3, 10), (5, 7, 2, 2, 4)]
)
def test_curves_equal_rescored_masks(spark, height, width, patch, channels, steps):
    rng = np.random.default_rng(7)
    size = height * width * channels
    grid = None if patch == 1 and height == 1 else curves.PatchGrid(width=width, patch=patch, channels=channels)
    per_row, down = width // patch, height // patch
    patches = per_row * down
    pixel = np.arange(size) // channels
    row, col = pixel // width // patch, pixel % width // patch
    patch_of = np.where((row < down) & (col < per_row), row * per_row + col, -1)
    x, h = rng.normal(size=size), rng.integers(0, 4, size=patches).astype(float)
    w, b = rng.normal(size=(5, size)), rng.normal(size=5)
    deletion, insertion, dscore, iscore, target = masked_curves(x, h, w, b, steps, patch_of, channels)
    df = spark.createDataFrame(
        [(x.tolist(), h.tolist(), w.tolist(), b.tolist())],
        "x array<double>, h array<double>, w array<array<double>>, b array<double>",
    )
    args = (*[F.col(c) for c in "xhwb"], F.lit(target), steps, grid)
    got = df.select(
        curves.deletion_curve(*args).alias("dc"),
        curves.insertion_curve(*args).alias("ic"),
        curves.deletion_score(*args).alias("ds"),
        curves.insertion_score(*args).alias("is_"),
    ).first()
    assert got["dc"] == pytest.approx(deletion)
    assert got["ic"] == pytest.approx(insertion)
    assert got["ds"] == pytest.approx(dscore)
    assert got["is_"] == pytest.approx(iscore)


def plain_box_blur(image, radius, passes=3, whole=True):
    """Every box summed value by value, with the fractional ends of its edges; lines go on at their ends."""
    variance = radius * radius / passes
    reach = int((np.sqrt(12 * variance + 1) - 1) // 2)
    edge = (2 * reach + 1) * (reach * (reach + 1) - 3 * variance) / (6 * (variance - (reach + 1) ** 2))
    size = 2 * (reach + edge) + 1
    weights = np.array([edge] + [1.0] * (2 * reach + 1) + [edge]) / size
    if whole:
        weight = int((1 << 24) / size)
        end = ((1 << 24) - (2 * reach + 1) * weight) // 2
        weights = np.array([end] + [weight] * (2 * reach + 1) + [end])
    out = image.astype(np.int64 if whole else float)
    for axis in (1, 0):
        for _ in range(passes):
            moved = np.moveaxis(out, axis, 0)
            n = len(moved)
            blurred = np.zeros_like(moved)
            for i in range(n):
                total = sum(w * moved[min(max(i + d, 0), n - 1)] for w, d in zip(weights, range(-reach - 1, reach + 2)))
                blurred[i] = (total + (1 << 23)) >> 24 if whole else total
            out = np.moveaxis(blurred, 0, axis)
    return out


@pytest.mark.parametrize("whole", [True, False])
@pytest.mark.parametrize(("height", "width", "channels"), [(7, 12, 3), (1, 5, 1), (20, 9, 3)])
def test_box_blur_equals_boxes_summed_one_by_one(spark, whole, height, width, channels):
    image = np.random.default_rng(5).integers(0, 256, (height, width, channels))
    radii = [1.0, 3.0, 6.0, 0.5]
    copies = one(spark, corruption.box_blurs(F.col("x"), radii, height, width, channels, pixels=whole), x=image.astype(float).ravel())
    for radius, copy in zip(radii, copies):
        assert np.array(copy).reshape(image.shape) == pytest.approx(plain_box_blur(image, radius, whole=whole), abs=0 if whole else 1e-9)


def test_box_blur_is_near_the_kernel_it_stands_for(spark):
    """Three boxes make a quadratic spline: its top is (3/4 sqrt(2 pi) / 2)^2 = 0.884 of that of the kernel in two dimensions."""
    image = np.zeros((41, 41))
    image[20, 20] = 1000.0
    for boxes, kernel in zip(
        one(spark, corruption.box_blurs(F.col("x"), [3.0, 6.0], 41, 41), x=image.ravel()),
        one(spark, corruption.gaussian_blurs(F.col("x"), [3.0, 6.0], 41, 41), x=image.ravel()),
    ):
        assert np.abs(np.array(boxes) - np.array(kernel)).max() < 0.13 * max(kernel) and sum(boxes) == pytest.approx(sum(kernel), rel=0.01)


def test_blurs_hold_flat_values_and_keep_shapes_and_nulls(spark):
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(4)
    count, size = 20_000, 64
    values = rng.normal(size=count * size)
    vector = pa.ListArray.from_arrays(pa.array(np.arange(0, count * size + 1, size, dtype=np.int32)), pa.array(values))
    whole = [pa.array(np.full(count, v, np.int32)) for v in (8, 8, 1)]
    radii = pa.array([[1.0, 3.0, 6.0]] * count)
    tracemalloc.start()
    copies = corruption._blurs.func(vector, *whole, radii)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 5 * values.nbytes  # three copies, and chunks; an object for each copy of an image takes more
    down = corruption._smoothing(8, 3.0)
    for i in (0, count - 1):
        wanted = down @ values[i * size : (i + 1) * size].reshape(8, 8) @ down.T
        assert np.array(copies[i].as_py()[1]).reshape(8, 8) == pytest.approx(wanted)
    rows = [([1.0] * 6, 2, 3), (None, 2, 3), ([2.0] * 4, 2, 2), ([1.0, None, 1.0, 1.0], 2, 2)]
    odd = spark.createDataFrame(rows, "x array<double>, h int, w int").coalesce(1)
    for blur in (corruption.gaussian_blurs, corruption.box_blurs):
        got = [r[0] for r in odd.select(blur(F.col("x"), [1.0, 2.0], F.col("h"), F.col("w"))).collect()]
        assert got[0] == [pytest.approx([1.0] * 6)] * 2 and got[1] is None and got[2] == [pytest.approx([2.0] * 4)] * 2
        assert [len(c) for c in got[3]] == [4, 4] and None in got[3][0]
