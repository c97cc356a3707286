"""Column expressions used by the operators; all stay in the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def coerced(c: Column) -> Column:
    """A number, or null for anything that isn't one (blank, text, NaN)."""
    n = c.cast("string").try_cast("double")
    return F.when(~F.isnan(n), n)


def is_finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def log10_positive(c: Column) -> Column:
    return F.when(is_finite(c) & (c > 0), F.log10(c))


def scaled_z(z: Column, z_scale: float) -> Column:
    if not 0 < z_scale <= 20:
        raise ValueError("z_scale must be over 0 and at most 20")
    return z * F.lit(float(z_scale))


def affine(axes: list[Column], matrix: list[list[float]]) -> list[Column]:
    """``matrix @ axes`` as column expressions."""
    return [sum((F.lit(float(m)) * a for m, a in zip(row[1:], axes[1:], strict=True)), F.lit(float(row[0])) * axes[0]) for row in matrix]


def rotation_2d(azimuth: float, scales: tuple[float, float] = (1.0, 1.0)) -> list[list[float]]:
    """Rows that give the scaled coordinates along and across ``azimuth`` (degrees from +x towards +y)."""
    c, s = math.cos(math.radians(azimuth)), math.sin(math.radians(azimuth))
    return [[scales[0] * c, scales[0] * s], [-scales[1] * s, scales[1] * c]]


def rotation_3d(azimuth: float, dip: float = 0.0, roll: float = 0.0, scales: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> list[list[float]]:
    """Rows that give the scaled coordinates along the main, second and third axis. The main axis points to ``azimuth`` and
    rises by ``dip`` (degrees); the other two are turned about it by ``roll``."""
    a, d, r = (math.radians(v) for v in (azimuth, dip, roll))
    main = [math.cos(a) * math.cos(d), math.sin(a) * math.cos(d), math.sin(d)]
    level, up = [-math.sin(a), math.cos(a), 0.0], [-math.cos(a) * math.sin(d), -math.sin(a) * math.sin(d), math.cos(d)]
    second = [math.cos(r) * p + math.sin(r) * q for p, q in zip(level, up, strict=True)]
    third = [math.cos(r) * q - math.sin(r) * p for p, q in zip(level, up, strict=True)]
    return [[s * v for v in axis] for s, axis in zip(scales, (main, second, third), strict=True)]


def space(spec: dict, dimension: str) -> list[list[float]]:
    """The matrix of an anisotropy {"azimuth", "dip", "roll", "major_scale", "minor_scale", "vertical_scale"}, or of a
    {"z_scale"} alone. Along an axis of scale s, distances count 1/s."""
    if "z_scale" in spec:
        if dimension != "3d" or len(spec) > 1 or not 0 < spec["z_scale"] <= 20:
            raise ValueError("z_scale stands alone, in 3-D, over 0 and at most 20")
        return [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, float(spec["z_scale"])]]
    scales = [float(spec.get(k, 1.0)) for k in ("major_scale", "minor_scale", "vertical_scale")[: 3 if dimension == "3d" else 2]]
    if not all(math.isfinite(s) and s > 0 for s in scales):
        raise ValueError("scales must be finite and over 0")
    inverse = tuple(1 / s for s in scales)
    return rotation_3d(spec.get("azimuth", 0.0), spec.get("dip", 0.0), spec.get("roll", 0.0), inverse) if dimension == "3d" else rotation_2d(spec.get("azimuth", 0.0), inverse)


def in_space(df: DataFrame, axes: list[str], matrix: list[list[float]] | None) -> DataFrame:
    """``df`` with its axes replaced by their image, in which distances are plain."""
    return df if matrix is None else df.withColumns(dict(zip(axes, affine([F.col(a) for a in axes], matrix), strict=True)))


def distance(a: list[Column], b: list[Column]) -> Column:
    return F.sqrt(sum(((p - q) * (p - q) for p, q in zip(a[1:], b[1:], strict=True)), (a[0] - b[0]) * (a[0] - b[0])))


def variogram_shape(u, model: str, exp, where):
    """Spherical, exponential or gaussian over distance by range, from 0 to 1. The same formula for columns (``exp`` and
    ``where`` of Spark) and for arrays (those of numpy)."""
    if model == "spherical":
        return where(u < 1, 1.5 * u - 0.5 * u * u * u, 1.0)
    return 1 - exp(-u) if model == "exponential" else 1 - exp(-(u * u))


def semivariance(h: Column, model: str, nugget: float, partial_sill: float, reach: float) -> Column:
    """A model's value at a distance; the nugget alone at distance 0."""
    shape = variogram_shape(h / F.lit(float(reach)), model, F.exp, lambda c, a, b: F.when(c, a).otherwise(F.lit(b)))
    return F.lit(float(nugget)) + F.lit(float(partial_sill)) * F.when(h > 0, shape).otherwise(0.0)


def general_number(c: Column) -> Column:
    """A number as ``%g`` writes it: six significant digits, no trailing zeros, exponent form outside 1e-4 .. 1e6."""
    exponent = F.floor(F.log10(F.abs(c)) + 1e-12)
    digits = F.greatest(F.lit(0), 5 - exponent).cast("int")
    fixed = F.coalesce(*(F.when(digits == d, F.regexp_replace(F.format_string(f"%.{d}f", c), r"\.?0+$" if d else "^$", "")) for d in range(10)))
    return F.when(c == 0, F.lit("0")).when((exponent < -4) | (exponent >= 6), F.regexp_replace(F.format_string("%.5e", c), r"\.?0+e", "e")).otherwise(fixed)


def column_id(x: Column, y: Column) -> Column:
    return F.concat(F.lit("X"), general_number(x), F.lit("_Y"), general_number(y))


def degrees_lon_lat(x: Column, y: Column, lon0: float, lat0: float, metres_per_degree: float = 111_320.0) -> list[Column]:
    """Display position of local metres around an anchor."""
    return [F.lit(lon0) + x / F.lit(metres_per_degree * math.cos(math.radians(lat0))), F.lit(lat0) + y / F.lit(metres_per_degree)]


# The built-in case whose unit is known whatever the table says.
BUILT_IN_CASE, BUILT_IN_KIND, BUILT_IN_NAME, BUILT_IN_UNIT = "resistivity", "builtin_preset", "RHO", "Ω·m"


def property_unit(case_id: Column, workspace_kind: Column, value_name: Column, value_unit: Column) -> Column:
    """The unit of a property: known for the built-in case, else as given; nothing is guessed."""
    known = (case_id == BUILT_IN_CASE) & (workspace_kind == BUILT_IN_KIND) & (value_name == BUILT_IN_NAME)
    return F.when(known, BUILT_IN_UNIT).otherwise(value_unit.cast("string"))
