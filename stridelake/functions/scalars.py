"""Scalar functions as Column expressions; nulls propagate unless stated."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- time and windows ---------------------------------------------------------------------------------------------


def window_to_sec(win: Column, stride, fps) -> Column:
    return win * stride / fps


def sec_to_window(sec: Column, stride, fps) -> Column:
    """Nearest window, halves to even."""
    return F.bround(sec * fps / stride).cast("long")


def frame_to_sec(frame: Column, fps) -> Column:
    return frame / fps


def sec_to_frame(sec: Column, fps) -> Column:
    return F.bround(sec * fps).cast("long")


def clock(sec: Column) -> Column:
    """HH:MM:SS.mmm."""
    ms = F.bround(sec * 1000).cast("long")
    return F.format_string("%02d:%02d:%02d.%03d", F.floor(ms / 3600000).cast("long"), F.floor(ms / 60000).cast("long") % 60, F.floor(ms / 1000).cast("long") % 60, ms % 1000)


def temporal_iou(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    inter = F.greatest(F.lit(0.0), F.least(e1, e2) - F.greatest(s1, s2))
    return inter / F.greatest(F.lit(1e-8), (e1 - s1) + (e2 - s2) - inter)


def split_plan(duration: Column, chunk: float, slack: float = 0.01) -> Column:
    """Starts and ends of fixed-length parts; a text not longer than one part (plus slack) is not split."""
    n = F.ceil(duration / chunk).cast("int")
    parts = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct((i * chunk).cast("double").alias("start_sec"), F.least((i + 1) * F.lit(chunk), duration).alias("end_sec")))
    return F.when(duration <= chunk + slack, F.array().cast("array<struct<start_sec:double,end_sec:double>>")).otherwise(parts)


def crop_starts(total: Column, duration: float, step: float) -> Column:
    """Starts of sliding crops: 0, step, ... while a whole crop fits."""
    n = F.floor((total - duration) / step).cast("int")
    return F.when(total < duration, F.array().cast("array<double>")).otherwise(F.transform(F.sequence(F.lit(0), n), lambda i: (i * step).cast("double")))


# --- casts, names, parsers ----------------------------------------------------------------------------------------


def safe_double(c: Column) -> Column:
    return c.try_cast("double")


def safe_long(c: Column) -> Column:
    return c.try_cast("bigint")


def resolve_fps(*candidates: Column) -> Column:
    """The first candidate that is a positive number."""
    return F.coalesce(*[F.when((c > 0) & ~F.isnan(c), c) for c in candidates])


def stem(path: Column) -> Column:
    """File name without folders and its last extension."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def energy_file(root: Column, stem_: Column, source: Column, mode: Column) -> Column:
    return F.concat(root, F.lit("/"), stem_, F.lit("/stream_energy_"), source, F.lit("_"), mode, F.lit(".jsonl"))


def path_source_mode(path: Column) -> Column:
    """Struct of source and mode named in an energy file; the source may itself hold an underscore (optical_flow)."""
    m = r"stream_energy_(optical_flow|[^_/]+)_([^/]+)\.jsonl$"
    return F.struct(F.nullif(F.regexp_extract(path, m, 1), F.lit("")).alias("source"), F.nullif(F.regexp_extract(path, m, 2), F.lit("")).alias("mode"))


def segment_file(k: Column, start_win: Column) -> Column:
    return F.format_string("segment_%04d_startwin_%06d", k, start_win)


def label_spec(spec: Column) -> Column:
    """Struct (kind, value) of ``auto``, ``quantile:q`` or ``value:v``; anything else is auto."""
    kind, num = F.split_part(spec, F.lit(":"), F.lit(1)), F.split_part(spec, F.lit(":"), F.lit(2)).try_cast("double")
    ok = kind.isin("quantile", "value") & num.isNotNull()
    return F.struct(F.when(ok, kind).otherwise("auto").alias("kind"), F.when(ok, num).alias("value"))


def dataset_spec(spec: Column) -> Column:
    """Rows (name, modality, share) of ``name:traj0.8:action0.04``; entries without a colon give none."""
    parts = F.split(spec, ":")
    one = lambda p: F.struct(parts[0].alias("name"), F.regexp_extract(p, r"^([A-Za-z_]+)", 1).alias("modality"), F.regexp_extract(p, r"([0-9.]+)$", 1).try_cast("double").alias("share"))
    return F.transform(F.slice(parts, 2, F.size(parts)), one)


def int_range(spec: Column, fallback: int) -> Column:
    """``a-b`` as all integers from a to b; otherwise 0 .. fallback-1."""
    a, b = F.regexp_extract(spec, r"^(\d+)-(\d+)$", 1).try_cast("int"), F.regexp_extract(spec, r"^(\d+)-(\d+)$", 2).try_cast("int")
    return F.when(a.isNotNull() & b.isNotNull() & (a <= b), F.sequence(a, b)).otherwise(F.sequence(F.lit(0), F.lit(fallback - 1)))


def dotted(json: Column, path: str) -> Column:
    """A number at a dotted path of a JSON text."""
    return F.get_json_object(json, "$." + path).try_cast("double")


# --- geometry ------------------------------------------------------------------------------------------------------


def normalise_coord(x: Column, size) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (x - size / F.lit(2.0)) / (size / F.lit(2.0))))


def unnormalise_coord(u: Column, size) -> Column:
    return u * (size / F.lit(2.0)) + size / F.lit(2.0)


def rescale(x: Column, old, new) -> Column:
    return x * new / old


def round_to_pixels(u: Column, size) -> Column:
    """A coordinate in [-1, 1] at the nearest whole pixel, halves to the even one."""
    return F.bround(u * size / 2) * 2 / size


def crop_offset(old: int, new: int) -> int:
    """First pixel of a centred crop."""
    return round((old - new) / 2)


def center_crop(x: Column, old: int, new: int) -> Column:
    """The normalised coordinate of a pixel within a centred crop, null outside of it."""
    at = x - crop_offset(old, new)
    return F.when((at >= 0) & (at < new), normalise_coord(at, F.lit(float(new))))


def resize_coord(x: Column, old: int, new: int) -> Column:
    """The whole pixel of a resized image."""
    return F.bround(unnormalise_coord(normalise_coord(x, F.lit(float(old))), F.lit(float(new))))


def resize_crop(u: Column, first: float, length: float, size: float) -> Column:
    """A coordinate in [-1, 1] after the part ``first .. first + length`` of ``size`` pixels is cut out and stretched."""
    shift = (first + length / 2 - size / 2) / size * 2
    return (u - shift) * (size / length)


def resize_dims(h: Column, w: Column, target: int, upsize: bool = True) -> Column:
    """Height and width with the shorter side at ``target``, the other in proportion, halves to even."""
    short = F.least(h, w)
    f = F.lit(float(target)) / short
    if not upsize:
        f = F.least(f, F.lit(1.0))
    return F.struct(F.bround(h * f).cast("long").alias("height"), F.bround(w * f).cast("long").alias("width"))


def flat_index(row: Column, col: Column, width) -> Column:
    return row * width + col


def from_flat(index: Column, width) -> Column:
    return F.struct(F.floor(index / width).cast("long").alias("row"), F.pmod(index, F.lit(width)).cast("long").alias("col"))


def relative_index(dr: Column, dc: Column, size: int) -> Column:
    """Class of a step within a centred size x size grid; steps beyond it are clamped."""
    h = size // 2
    r, c = F.greatest(F.lit(-h), F.least(F.lit(h), F.bround(dr))), F.greatest(F.lit(-h), F.least(F.lit(h), F.bround(dc)))
    return ((r + h) * size + c + h).cast("long")


def relative_step(index: Column, size: int) -> Column:
    h = size // 2
    return F.struct((F.floor(index / size) - h).cast("long").alias("dr"), (F.pmod(index, F.lit(size)) - h).cast("long").alias("dc"))


def finite_or_zero(x: Column) -> Column:
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)


def query_standard_to_unit(x: Column) -> Column:
    return (x + 1) / 2


def query_unit_to_pixels(x: Column, size) -> Column:
    return x * size


def grid(n: int) -> Column:
    """n x n points in [-1, 1] at the cells' centres, as an array of (row, col)."""
    at = lambda i: (2 * i + 1) / F.lit(float(n)) - 1
    i = F.sequence(F.lit(0), F.lit(n - 1))
    return F.flatten(F.transform(i, lambda r: F.transform(i, lambda c: F.struct(at(r).alias("row"), at(c).alias("col")))))


# --- codes ---------------------------------------------------------------------------------------------------------


def mixed_radix(digits: Column, levels: Sequence[int]) -> Column:
    """Code of little-endian digits."""
    weights = [math.prod(levels[:i]) for i in range(len(levels))]
    w = F.array(*[F.lit(x).cast("long") for x in weights])
    return F.aggregate(F.zip_with(digits, w, lambda d, k: d.cast("long") * k), F.lit(0).cast("long"), lambda a, x: a + x)


#: Quantiser levels of a code book, by the binary logarithm of its size.
LEVELS = {4: (5, 3), 6: (8, 8), 8: (8, 6, 5), 9: (8, 8, 8), 10: (8, 5, 5, 5), 11: (8, 8, 6, 5), 12: (7, 5, 5, 5, 5)}


def levels_of(size: Column) -> Column:
    """Levels for a code-book size; null for sizes without an entry."""
    out = F.lit(None).cast("array<int>")
    for k, v in LEVELS.items():
        out = F.when(F.floor(F.log2(size.cast("double"))) == k, F.array(*map(F.lit, v))).otherwise(out)
    return out


def positional(pos: Column, dim: int) -> Column:
    """Sine and cosine encoding of a position, interleaved."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(dim - 1)),
        lambda i: F.when(i % 2 == 0, F.sin(pos / F.pow(F.lit(10000.0), i / F.lit(float(dim))))).otherwise(F.cos(pos / F.pow(F.lit(10000.0), (i - 1) / F.lit(float(dim))))),
    )


def argmax(x: Column) -> Column:
    """0-based place of the first maximum."""
    return (F.array_position(x, F.array_max(x)) - 1).cast("long")


def softmax(x: Column) -> Column:
    top = F.array_max(x)
    e = F.transform(x, lambda v: F.exp(v - top))
    return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def radial_weight(r: Column, r_max, strength: float, power: float) -> Column:
    return 1 + strength * F.pow(r / r_max, F.lit(power))


def focal(p: Column, alpha: float, gamma: float) -> Column:
    return -alpha * F.pow(1 - p, F.lit(gamma)) * F.log(p)


def erf(x: Column) -> Column:
    """Error function (Abramowitz-Stegun 7.1.26, absolute error below 1.5e-7)."""
    t = 1 / (1 + 0.3275911 * F.abs(x))
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return F.signum(x) * (1 - poly * F.exp(-x * x))


def truncated_normal_logpdf(x: Column, mean, sd, low: float = -1.0, high: float = 1.0) -> Column:
    cdf = lambda v: 0.5 * (1 + erf((F.lit(v) - mean) / (sd * math.sqrt(2))))
    z = F.greatest(cdf(high) - cdf(low), F.lit(1e-12))
    return -0.5 * F.pow((x - mean) / sd, F.lit(2.0)) - F.log(F.lit(1.0) * sd) - 0.5 * math.log(2 * math.pi) - F.log(z)


# --- vectors -------------------------------------------------------------------------------------------------------


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, b: a + b)


def dot(x: Column, y: Column) -> Column:
    return _sum(F.zip_with(x, y, lambda a, b: a * b))


def norm(x: Column) -> Column:
    return F.sqrt(_sum(F.transform(x, lambda a: a * a)))


def mean_abs(x: Column) -> Column:
    return _sum(F.transform(x, lambda a: F.abs(a))) / F.size(x)


def cosine(x: Column, y: Column, eps: float = 1e-12) -> Column:
    return dot(x, y) / F.greatest(norm(x) * norm(y), F.lit(eps))


def euclidean(x: Column, y: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(x, y, lambda a, b: (a - b) * (a - b))))


def unit(x: Column, eps: float = 1e-12) -> Column:
    n = F.greatest(norm(x), F.lit(eps))
    return F.transform(x, lambda a: a / n)


# --- samples of places ---------------------------------------------------------------------------------------------


def even_places(n: Column, k: int, how: str = "round") -> Column:
    """k places spread over 0..n-1, distinct: rounded half to even, truncated, or by a whole step."""
    if how == "step":
        step = F.greatest(F.lit(1), F.floor(n / k).cast("int"))
        return F.slice(F.sequence(F.lit(0), (n - 1).cast("int"), step), 1, k)
    if k == 1:
        return F.array(F.lit(0).cast("long"))
    at = lambda i: i * (n - 1) / F.lit(float(k - 1))
    return F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: (F.bround(at(i)) if how == "round" else F.floor(at(i))).cast("long")))
