"""Colour expressions: hex, HSL, CIE Lab and colour differences."""

from __future__ import annotations


from pyspark.sql import Column
from pyspark.sql import functions as F

#: sRGB to XYZ (D65) rows, and the white point.
MATRIX = [(0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041)]
WHITE = (0.95047, 1.0, 1.08883)


def rgb_hex(r: Column, g: Column, b: Column) -> Column:
    return F.concat(F.lit("#"), *(F.lpad(F.lower(F.hex(c)), 2, "0") for c in (r, g, b)))


def hex_rgb(c: Column) -> list[Column]:
    return [F.conv(F.substring(c, 2 + 2 * i, 2), 16, 10).cast("int") for i in range(3)]


def rgb_hsl(r: Column, g: Column, b: Column) -> list[Column]:
    r, g, b = (c / 255.0 for c in (r, g, b))
    most, least = F.greatest(r, g, b), F.least(r, g, b)
    d, light = most - least, (most + least) / 2
    sat = F.when(d == 0, 0.0).otherwise(d / (1 - F.abs(2 * light - 1)))
    hue = F.when(d == 0, 0.0).when(most == r, F.pmod((g - b) / d, F.lit(6.0))).when(most == g, (b - r) / d + 2).otherwise((r - g) / d + 4) * 60
    return [hue, sat, light]


def lab(r: Column, g: Column, b: Column) -> list[Column]:
    def linear(c: Column) -> Column:
        c = c / 255.0
        return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))

    def bent(t: Column) -> Column:
        return F.when(t > 216 / 24389, F.cbrt(t)).otherwise((24389 / 27 * t + 16) / 116)

    rgb = [linear(c) for c in (r, g, b)]
    x, y, z = (bent(sum(m * c for m, c in zip(row, rgb)) / w) for row, w in zip(MATRIX, WHITE))
    return [116 * y - 16, 500 * (x - y), 200 * (y - z)]


def delta_e76(a: list[Column], b: list[Column]) -> Column:
    return F.sqrt(sum(F.pow(x - y, F.lit(2.0)) for x, y in zip(a, b)))


def delta_e2000(one: list[Column], two: list[Column]) -> Column:
    """CIEDE2000 with unit weights."""
    (l1, a1, b1), (l2, a2, b2) = one, two
    c1, c2 = F.hypot(a1, b1), F.hypot(a2, b2)
    c7 = F.pow((c1 + c2) / 2, F.lit(7.0))
    g = 0.5 * (1 - F.sqrt(c7 / (c7 + 25.0**7)))
    a1, a2 = a1 * (1 + g), a2 * (1 + g)
    c1, c2 = F.hypot(a1, b1), F.hypot(a2, b2)
    hue = lambda a, b: F.when((a == 0) & (b == 0), 0.0).otherwise(F.pmod(F.degrees(F.atan2(b, a)), F.lit(360.0)))
    h1, h2 = hue(a1, b1), hue(a2, b2)
    grey = c1 * c2 == 0
    d = h2 - h1
    dh = F.when(grey, 0.0).when(F.abs(d) <= 180, d).when(d > 180, d - 360).otherwise(d + 360)
    dl, dc = l2 - l1, c2 - c1
    dhh = 2 * F.sqrt(c1 * c2) * F.sin(F.radians(dh / 2))
    ml, mc = (l1 + l2) / 2, (c1 + c2) / 2
    s = h1 + h2
    mh = F.when(grey, s).when(F.abs(d) <= 180, s / 2).when(s < 360, (s + 360) / 2).otherwise((s - 360) / 2)
    cos = lambda x: F.cos(F.radians(x))
    t = 1 - 0.17 * cos(mh - 30) + 0.24 * cos(2 * mh) + 0.32 * cos(3 * mh + 6) - 0.20 * cos(4 * mh - 63)
    turn = 30 * F.exp(-F.pow((mh - 275) / 25, F.lit(2.0)))
    m7 = F.pow(mc, F.lit(7.0))
    rt = -2 * F.sqrt(m7 / (m7 + 25.0**7)) * F.sin(F.radians(2 * turn))
    ll = F.pow(ml - 50, F.lit(2.0))
    sl, sc, sh = 1 + 0.015 * ll / F.sqrt(20 + ll), 1 + 0.045 * mc, 1 + 0.015 * mc * t
    return F.sqrt(F.pow(dl / sl, F.lit(2.0)) + F.pow(dc / sc, F.lit(2.0)) + F.pow(dhh / sh, F.lit(2.0)) + rt * (dc / sc) * (dhh / sh))


def palette_distance(colors: Column, target: tuple[int, int, int], min_share: float) -> Column:
    """The least difference of a palette (array of r, g, b, percentage) to a colour, over entries of some share."""
    goal = lab(*(F.lit(c) for c in target))
    each = F.transform(F.filter(colors, lambda c: c["percentage"] >= min_share), lambda c: delta_e76(lab(c["r"], c["g"], c["b"]), goal))
    return F.array_min(each)


