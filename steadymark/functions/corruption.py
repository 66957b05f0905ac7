"""Image corruptions with a severity scale.

Noise and contrast are single passes over the array and stay in the JVM. The blur reads a
neighbourhood for every pixel, which costs about 50 times more as an interpreted lambda than as two
small matrix products, so it goes through one Arrow batch function.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from steadymark.functions.arrays import let, mean

# Corruption parameter (sigma, radius, factor) by type and severity.
SEVERITIES = {
    "gaussian_noise": {"shallow": 15.0, "medium": 40.0, "heavy": 80.0},
    "blur": {"shallow": 1.0, "medium": 3.0, "heavy": 6.0},
    "contrast": {"shallow": 0.7, "medium": 0.4, "heavy": 0.15},
}
LEVELS = ("shallow", "medium", "heavy")

# Fixed value: range of an 8-bit pixel.
PIXEL_MAX = 255.0


def severity_rank(level: Column) -> Column:
    """Ordinal of a severity: shallow 0, medium 1, anything else 2."""
    return F.when(level == "shallow", 0).when(level == "medium", 1).otherwise(2)


def as_pixel(value: Column) -> Column:
    """Clip to the pixel range and truncate."""
    return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(PIXEL_MAX), value))).cast("double")


def contrast(vector: Column, factor: Column | float, pixels: bool = False) -> Column:
    """Pull every value towards (factor < 1) the mean over all channels."""

    def pulled(xs: Column) -> Column:
        def one(v: Column, mu: Column) -> Column:
            moved = (v - mu) * factor + mu
            return as_pixel(moved) if pixels else moved

        return let(mean(xs), lambda mu: F.transform(xs, lambda v: one(v, mu)))

    return let(vector, pulled)


def gaussian_noise(vector: Column, sigma: Column | float, *key: Column, pixels: bool = False) -> Column:
    """Add N(0, sigma) noise that depends only on ``key`` and the position.

    Two 32-bit words of an md5 give one Box-Muller draw, so a retried task or another partitioning
    yields the same noise, and any SQL engine can recompute it.
    """
    words = 4294967296.0

    def draw(digest: Column) -> Column:
        first = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
        second = F.conv(F.substring(digest, 9, 8), 16, 10).cast("double")
        return F.sqrt(F.lit(-2.0) * F.ln((first + 0.5) / words)) * F.cos(F.lit(2.0 * math.pi) * second / words)

    def noisy(s: Column, v: Column, i: Column) -> Column:
        moved = v + s * let(F.md5(F.concat_ws("|", *key, i)), draw)
        return as_pixel(moved) if pixels else moved

    sigma = F.lit(sigma) if isinstance(sigma, float) else sigma
    return let(sigma, lambda s: F.transform(vector, lambda v, i: noisy(s, v, i)))


@functools.lru_cache(maxsize=64)
def _smoothing(length: int, radius: float) -> np.ndarray:
    """Row-stochastic matrix of a Gaussian kernel cut at three radii, edges clamped."""
    reach = int(math.ceil(3 * radius))
    offsets = np.arange(-reach, reach + 1)
    kernel = np.exp(-(offsets**2) / (2.0 * radius * radius))
    kernel /= kernel.sum()
    matrix = np.zeros((length, length))
    for row in range(length):
        np.add.at(matrix[row], np.clip(row + offsets, 0, length - 1), kernel)
    return matrix


#: Values of the images that are blurred at a time.
CHUNK = 1 << 18
_COPIES = pa.list_(pa.list_(pa.float64()))


def _copies(vector: pa.Array, height: pa.Array, width: pa.Array, channels: pa.Array, count: int, blur: Callable[[np.ndarray, int], np.ndarray]) -> pa.Array:
    """``count`` copies of each image. ``blur(images, i)`` gives copy i of images of one shape (images x height x width x
    channels); they are read from and written to flat arrays, a bounded number of values at a time."""
    sizes = np.diff(vector.offsets.to_numpy()) if vector.null_count == 0 else vector.value_lengths().fill_null(0).to_numpy()
    shapes = np.stack([c.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False) for c in (height, width, channels)], axis=1)
    known = vector.is_valid().to_numpy(zero_copy_only=False)
    if (shapes.prod(axis=1)[known] != sizes[known]).any():
        raise ValueError("a vector has another size than its image")
    values = vector.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    starts = np.cumsum(sizes) - sizes
    out = np.empty(count * len(values))
    for shape in np.unique(shapes[known], axis=0):
        own, size = np.flatnonzero(known & (shapes == shape).all(axis=1)), int(shape.prod())
        step = max(1, CHUNK // max(size, 1))
        for at in range(0, len(own), step):
            rows = own[at : at + step]
            images = values[starts[rows, None] + np.arange(size)].reshape(-1, *shape)
            for i in range(count):
                out[(count * starts[rows] + i * size)[:, None] + np.arange(size)] = blur(images, i).reshape(len(rows), size)
    inner = np.concatenate([[0], np.cumsum(np.repeat(sizes[known], count))]).astype(np.int32)
    outer = np.concatenate([[0], np.cumsum(np.where(known, count, 0))]).astype(np.int32)
    # NaN becomes NULL, as from pandas.
    copies = pa.ListArray.from_arrays(pa.array(inner), pa.array(out, from_pandas=True))
    return pa.ListArray.from_arrays(pa.array(outer), copies, mask=pa.array(~known) if not known.all() else None)


@F.arrow_udf(T.ArrayType(T.ArrayType(T.DoubleType())))
def _blurs(vector: pa.Array, height: pa.Array, width: pa.Array, channels: pa.Array, radii: pa.Array) -> pa.Array:
    if not len(vector):
        return pa.array([], _COPIES)
    wanted = radii[0].as_py()  # a literal

    def blur(images: np.ndarray, i: int) -> np.ndarray:
        down, across = (_smoothing(n, wanted[i]) for n in images.shape[1:3])
        return (down @ images.transpose(0, 3, 1, 2) @ across.T).transpose(0, 2, 3, 1)

    return _copies(vector, height, width, channels, len(wanted), blur)


def gaussian_blurs(
    vector: Column,
    radii: list[float],
    height: Column | int,
    width: Column | int,
    channels: Column | int = 1,
    pixels: bool = False,
) -> Column:
    """Blurred copies of a row-major ``height x width x channels`` image, one per radius.

    All radii are served by one call, so each image crosses to Python once.
    """
    lit = lambda v: F.lit(v) if isinstance(v, int) else v
    copies = _blurs(vector, lit(height), lit(width), lit(channels), F.array(*[F.lit(float(r)) for r in radii]))
    if not pixels:
        return copies
    return F.transform(copies, lambda image: F.transform(image, lambda v: as_pixel(v + 0.5)))


#: Box passes that stand for a Gaussian kernel.
PASSES = 3
# Fixed value: binary digits of the weights of 8-bit pixels.
WEIGHT_BITS = 24


def box_radius(radius: float, passes: int = PASSES) -> float:
    """The radius of a box with a fractional edge whose variance, ``passes`` times, is that of a Gaussian kernel."""
    variance = radius * radius / passes
    whole = math.floor((math.sqrt(12 * variance + 1) - 1) / 2)
    edge = (2 * whole + 1) * (whole * (whole + 1) - 3 * variance) / (6 * (variance - (whole + 1) ** 2))
    return whole + edge


def _box_pass(lines: np.ndarray, radius: float, pixels: bool) -> np.ndarray:
    """Means over boxes along the first axis, by differences of running sums; the values at the edges go on beyond them."""
    n, reach = len(lines), int(radius)
    padded = lines[np.clip(np.arange(-reach - 1, n + reach + 1), 0, n - 1)]
    sums = np.concatenate([np.zeros_like(padded[:1]), np.cumsum(padded, axis=0)])
    inner = sums[2 * reach + 2 : 2 * reach + 2 + n] - sums[1 : 1 + n]
    edges = padded[:n] + padded[2 * reach + 2 :]
    if not pixels:
        return (inner + (radius - reach) * edges) / (2 * radius + 1)
    one = 1 << WEIGHT_BITS
    weight = int(one / (2 * radius + 1))
    edge_weight = (one - (2 * reach + 1) * weight) // 2
    return (inner * weight + edges * edge_weight + one // 2) >> WEIGHT_BITS


@F.arrow_udf(T.ArrayType(T.ArrayType(T.DoubleType())))
def _boxes(
    vector: pa.Array, height: pa.Array, width: pa.Array, channels: pa.Array, radii: pa.Array, pixels: pa.Array, passes: pa.Array
) -> pa.Array:
    if not len(vector):
        return pa.array([], _COPIES)
    wanted, whole, times = radii[0].as_py(), pixels[0].as_py(), passes[0].as_py()  # literals

    def blur(images: np.ndarray, i: int) -> np.ndarray:
        blurred = images.transpose(1, 2, 3, 0)
        blurred = blurred.astype(np.int64) if whole else blurred
        for _ in range(2):  # along the rows, then along the columns
            blurred = blurred.transpose(1, 0, 2, 3)
            for _ in range(times):
                blurred = _box_pass(blurred, box_radius(wanted[i], times), whole)
        return blurred.astype(float).transpose(3, 0, 1, 2)

    return _copies(vector, height, width, channels, len(wanted), blur)


def box_blurs(
    vector: Column,
    radii: list[float],
    height: Column | int,
    width: Column | int,
    channels: Column | int = 1,
    pixels: bool = False,
    passes: int = PASSES,
) -> Column:
    """:func:`gaussian_blurs` as image libraries approximate them: ``passes`` extended boxes along each axis.

    The work for a pixel does not grow with the radius. With ``pixels`` every pass rounds to whole values by weights of
    24 binary digits, as on 8-bit images.
    """
    lit = lambda v: F.lit(v) if isinstance(v, int) else v
    wanted = F.array(*[F.lit(float(r)) for r in radii])
    return _boxes(vector, lit(height), lit(width), lit(channels), wanted, F.lit(pixels), F.lit(passes))


def corrupted_variants(
    vector: Column,
    key: Column,
    height: Column | int,
    width: Column | int,
    channels: Column | int = 1,
    noise_scale: Column | float = 1.0,
    pixels: bool = False,
    boxes: bool = False,
) -> Column:
    """All nine corrupted copies as ``array<struct<corruption_type, corruption_level, vector>>``.

    Computed once per image, before any expansion by model. ``noise_scale`` converts the noise
    parameter into the unit of the data. ``boxes`` takes :func:`box_blurs` for the blur.
    """
    scale = F.lit(noise_scale) if isinstance(noise_scale, float) else noise_scale
    blur = box_blurs if boxes else gaussian_blurs
    blurred = blur(vector, [SEVERITIES["blur"][level] for level in LEVELS], height, width, channels, pixels)

    def variant(kind: str, level: str, image: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("corruption_type"), F.lit(level).alias("corruption_level"), image.alias("vector")
        )

    def variants(blurs: Column) -> Column:
        made = []
        for position, level in enumerate(LEVELS):
            sigma = F.lit(SEVERITIES["gaussian_noise"][level]) * scale
            noisy = gaussian_noise(vector, sigma, key, F.lit("gaussian_noise"), F.lit(level), pixels=pixels)
            made.append(variant("gaussian_noise", level, noisy))
            made.append(variant("blur", level, F.get(blurs, F.lit(position))))
            made.append(variant("contrast", level, contrast(vector, SEVERITIES["contrast"][level], pixels)))
        return F.array(*made)

    return variants(blurred)
