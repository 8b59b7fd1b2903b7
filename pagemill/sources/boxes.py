"""Boxes between a page and its raster: scale, rotation and crop as matrices of Columns, both ways.

A matrix is a struct (a, b, c, d, e, f): x' = a x + c y + e, y' = b x + d y + f. A box is an array [x, y, w, h]. A page's
unrotated size is in points; a rotation is clockwise, by a multiple of 90 degrees; a crop is a box of the rotated page.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.functions.text import bound

NAMES = ("a", "b", "c", "d", "e", "f")


def _number(x: Column | float) -> Column:
    return x.cast("double") if isinstance(x, Column) else F.lit(float(x))


def matrix(*values: Column | float) -> Column:
    return F.struct(*(_number(v).alias(n) for n, v in zip(NAMES, values, strict=True)))


def scaled(s: Column | float) -> Column:
    return matrix(s, 0, 0, s, 0, 0)


def moved(x: Column | float, y: Column | float) -> Column:
    return matrix(1, 0, 0, 1, x, y)


def rotated(degrees: Column, width: Column | float, height: Column | float) -> Column:
    """A clockwise turn of a page of that size (before the turn), so that its corner is at the origin again."""
    turn, w, h = F.pmod(degrees, F.lit(360)), _number(width), _number(height)
    bad = F.raise_error(F.concat(F.lit("not a right angle: "), degrees.cast("string"))).cast(f"struct<{', '.join(f'{n}: double' for n in NAMES)}>")
    return F.when(turn == 0, matrix(1, 0, 0, 1, 0, 0)).when(turn == 90, matrix(0, 1, -1, 0, h, 0)).when(turn == 180, matrix(-1, 0, 0, -1, w, h)).when(turn == 270, matrix(0, -1, 1, 0, 0, w)).otherwise(bad)


def then(first: Column, second: Column) -> Column:
    """The matrix of first one and then the other."""

    def product(m: Column, n: Column) -> Column:
        return matrix(
            n["a"] * m["a"] + n["c"] * m["b"], n["b"] * m["a"] + n["d"] * m["b"], n["a"] * m["c"] + n["c"] * m["d"], n["b"] * m["c"] + n["d"] * m["d"], n["a"] * m["e"] + n["c"] * m["f"] + n["e"], n["b"] * m["e"] + n["d"] * m["f"] + n["f"]
        )

    # Both are bound: a matrix in terms of its factors' expressions would grow with each product.
    return bound(first, lambda m: bound(second, lambda n: product(m, n)))


def inverse(m: Column) -> Column:
    """The way back; a matrix without one raises an error."""
    det = lambda m: m["a"] * m["d"] - m["b"] * m["c"]
    sound = lambda x: F.when(x == 0, F.raise_error(F.lit("a matrix without inverse")).cast("double")).otherwise(x)
    divided = lambda m, by: matrix(m["d"] / by, -m["b"] / by, -m["c"] / by, m["a"] / by, (m["c"] * m["f"] - m["d"] * m["e"]) / by, (m["b"] * m["e"] - m["a"] * m["f"]) / by)
    return bound(m, lambda m: bound(bound(det(m), sound), lambda by: divided(m, by)))


def apply(m: Column, box: Column, digits: int = 3) -> Column:
    """The box [x, y, w, h] around what a box becomes."""

    def around(m: Column, box: Column) -> Column:
        x, y, w, h = (box[i].cast("double") for i in range(4))
        xs = F.array(*(m["a"] * u + m["c"] * v + m["e"] for u in (x, x + w) for v in (y, y + h)))
        ys = F.array(*(m["b"] * u + m["d"] * v + m["f"] for u in (x, x + w) for v in (y, y + h)))
        sides = lambda a, b: F.array(F.array_min(a), F.array_min(b), F.array_max(a) - F.array_min(a), F.array_max(b) - F.array_min(b))
        return bound(xs, lambda a: bound(ys, lambda b: sides(a, b)))

    return F.transform(bound(m, lambda m: bound(box, lambda b: around(m, b))), lambda v: F.round(v, digits))


def raster(width: Column, height: Column, dpi: Column | float = 300, most: int = 16_000) -> Column:
    """struct(scale, render_w, render_h) of a page as it is shown: by its resolution, or less where a side would exceed most."""
    w, h = width.cast("double"), height.cast("double")
    longest, plain = F.greatest(w, h), _number(dpi) / 72
    large, wide = longest * plain > most, w >= h

    def side(own: Column, other: Column, is_long: Column) -> Column:
        return F.when(~large, F.ceil(own * _number(dpi) / 72)).when(is_long, F.lit(most).cast("long")).otherwise(F.ceil(own * most / other))

    return F.struct(F.when(large, most / longest).otherwise(plain).alias("scale"), side(w, h, wide).alias("render_w"), side(h, w, ~wide).alias("render_h"))


def page_to_raster(width: Column, height: Column, rotation: Column, crop: Column | None, dpi: Column | float = 300, most: int = 16_000) -> Column:
    """The matrix from an unrotated page to the raster of what is shown of it; inverse() leads back."""
    odd = F.pmod(rotation, F.lit(180)) == 90
    whole = F.array(F.lit(0.0), F.lit(0.0), *(F.when(odd, b).otherwise(a).cast("double") for a, b in ((width, height), (height, width))))
    shown = whole if crop is None else F.coalesce(crop, whole)
    at = lambda s: then(then(rotated(rotation, width, height), moved(-s[0], -s[1])), scaled(raster(s[2], s[3], dpi, most)["scale"]))
    return bound(shown, at)
