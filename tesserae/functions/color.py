"""Colour expressions: sRGB, linear light, CIE LAB (D65), hex notation. All are Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: sRGB to XYZ (D65) and back, and the white point.
TO_XYZ = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041))
TO_RGB = ((3.2404542, -1.5371385, -0.4985314), (-0.9692660, 1.8760108, 0.0415560), (0.0556434, -0.2040259, 1.0572252))
WHITE = (0.95047, 1.0, 1.08883)
EPSILON, KAPPA = 216.0 / 24389.0, 24389.0 / 27.0
HEX = "^#[0-9A-F]{6}$"


def clamp(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def srgb_to_linear(u8: Column) -> Column:
    v = u8.cast("double") / 255.0
    return F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))


def linear_to_srgb_u8(lin: Column) -> Column:
    v = clamp(lin, 0.0, 1.0)
    s = F.when(v <= 0.0031308, v * 12.92).otherwise(1.055 * F.pow(v, F.lit(1 / 2.4)) - 0.055)
    return F.floor(clamp(s, 0.0, 1.0) * 255.0 + 0.5).cast("int")


def rgb_to_lab(r: Column, g: Column, b: Column) -> Column:
    """struct(L, A, B); project it before it is used twice, else the expression is repeated."""
    lin = [srgb_to_linear(c) for c in (r, g, b)]
    f = []
    for row, white in zip(TO_XYZ, WHITE):
        t = (lin[0] * row[0] + lin[1] * row[1] + lin[2] * row[2]) / white
        f.append(F.when(t > EPSILON, F.cbrt(t)).otherwise((KAPPA * t + 16.0) / 116.0))
    return F.struct((116.0 * f[1] - 16.0).alias("lab_l"), (500.0 * (f[0] - f[1])).alias("lab_a"), (200.0 * (f[1] - f[2])).alias("lab_b"))


def lab_to_rgb(light: Column, a: Column, b: Column) -> Column:
    """struct(r, g, b) of 8-bit channels."""
    fy = (light + 16.0) / 116.0
    xyz = []
    for t, white in zip((fy + a / 500.0, fy, fy - b / 200.0), WHITE):
        cube = t * t * t
        xyz.append(F.when(cube > EPSILON, cube).otherwise((116.0 * t - 16.0) / KAPPA) * white)
    return F.struct(*[linear_to_srgb_u8(xyz[0] * m[0] + xyz[1] * m[1] + xyz[2] * m[2]).alias(c) for c, m in zip("rgb", TO_RGB)])


def lab_distance(a: Column, b: Column) -> Column:
    return F.sqrt(sum((F.pow(a[k] - b[k], F.lit(2.0)) for k in ("lab_l", "lab_a", "lab_b")), F.lit(0.0)))


def rgb_to_hex(r: Column, g: Column, b: Column) -> Column:
    return F.format_string("#%02X%02X%02X", r.cast("int"), g.cast("int"), b.cast("int"))


def normalise_hex(value: Column) -> Column:
    """``#RRGGBB`` in upper case; ``#`` is optional and ``#abc`` is ``#AABBCC``; null if it is not a colour."""
    bare = F.upper(F.ltrim(F.trim(value), F.lit("#")))
    wide = F.when(F.length(bare) == 3, F.regexp_replace(bare, "(.)", "$1$1")).otherwise(bare)
    full = F.concat(F.lit("#"), wide)
    return F.when(full.rlike(HEX), full)


def hex_to_rgb(value: Column) -> Column:
    return F.struct(*[F.conv(F.substring(value, 2 + 2 * k, 2), 16, 10).cast("int").alias(c) for k, c in enumerate("rgb")])


def lab_sql(r: str, g: str, b: str) -> tuple[str, str, str]:
    """The same conversion in DuckDB SQL."""
    lin = [f"(CASE WHEN {c}/255.0::DOUBLE <= 0.04045 THEN {c}/255.0::DOUBLE/12.92 ELSE pow(({c}/255.0::DOUBLE+0.055)/1.055, 2.4) END)" for c in (r, g, b)]
    f = []
    for row, white in zip(TO_XYZ, WHITE):
        t = "((" + "+".join(f"{x}*{m}::DOUBLE" for x, m in zip(lin, row)) + f")/{white}::DOUBLE)"
        f.append(f"(CASE WHEN {t} > 216.0::DOUBLE/24389.0 THEN cbrt({t}) ELSE (24389.0::DOUBLE/27.0*{t}+16)/116 END)")
    return f"(116*{f[1]}-16)", f"(500*({f[0]}-{f[1]}))", f"(200*({f[1]}-{f[2]}))"
