"""Scalar expressions on columns. Missing values are null throughout; NaN never leaves a source."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Scene classes that count as clear ground, and carbon's factor in organic matter.
CLEAR_CLASSES = (4, 5, 6, 7)
ORGANIC_PER_CARBON = 1.724
SQUARE_METRES_PER_HECTARE = 10_000.0


def finite(value: Column) -> Column:
    """Whether a double is neither null, NaN nor infinite."""
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))


def clear_class(scene_class: Column) -> Column:
    return F.coalesce(scene_class.isin(*CLEAR_CLASSES), F.lit(False))


def has_data(value: Column, nodata: Column) -> Column:
    """Finite and not the declared no-data value; a null or NaN declaration leaves the finite test alone."""
    value, nodata = value.cast("double"), nodata.cast("double")
    return finite(value) & (nodata.isNull() | F.isnan(nodata) | (value != nodata))


def ndvi(red: Column, nir: Column, valid: Column, red_scale: Column, red_offset: Column, nir_scale: Column | None = None, nir_offset: Column | None = None) -> Column:
    """``(n - r) / (n + r)`` of scaled bands within [-1, 1]; null where invalid, not finite or without a sum."""
    r = red.cast("double") * red_scale + red_offset
    n = nir.cast("double") * (red_scale if nir_scale is None else nir_scale) + (red_offset if nir_offset is None else nir_offset)
    ratio = F.when(n + r != 0, (n - r) / F.nullif(n + r, F.lit(0.0)))
    return F.when(valid & finite(r) & finite(n) & finite(ratio), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), ratio)))


def overlap_length(top: Column, bottom: Column, limit: float = 30.0) -> Column:
    """Length of [top, bottom] within [0, limit]; null where either end is missing. Order is a gate's matter."""
    if not 0 < limit < float("inf"):
        raise ValueError("limit must be positive and finite")
    return F.when(top.isNotNull() & bottom.isNotNull(), F.greatest(F.lit(0.0), F.least(bottom, F.lit(limit)) - F.greatest(top, F.lit(0.0))))


def carbon_stock(organic_pct: Column, density: Column, thickness: Column) -> Column:
    """Carbon in Mg/ha of a layer: density by thickness in cm by per cent of carbon."""
    return density * thickness * organic_pct / ORGANIC_PER_CARBON


def hectares(square_metres: Column) -> Column:
    return square_metres / SQUARE_METRES_PER_HECTARE


def leap_day_of_year(date: Column) -> Column:
    """Day of year with month and day placed in a leap year: 29 February is 60, 1 March always 61."""
    return F.dayofyear(F.make_date(F.lit(2000), F.month(date), F.day(date)))


def ndvi_band(value: Column) -> Column:
    return F.when(value < 0.3, "alert").when(value <= 0.6, "watch").when(value.isNotNull(), "developed")


def number_text(value: Column) -> Column:
    """Thousands separated by commas, at most three decimals, no trailing zeros."""
    return F.regexp_replace(F.format_number(value.cast("double"), 3), r"\.?0+$", "")


def filled(template: str, values: Mapping[str, Column]) -> Column:
    """A template with ``{name}`` for each of ``values``, which are text or numbers, as a column."""
    parts = []
    for text, name, _, _ in Formatter().parse(template):
        parts += [F.lit(text)] if text else []
        parts += [values[name].cast("string")] if name else []
    return F.concat(*parts) if parts else F.lit("")


def date_of_stamp(stamp: Column) -> Column:
    """The date part of an ISO time stamp."""
    return F.split_part(stamp, F.lit("T"), F.lit(1))


def soil_label(code: Column, name: Column) -> Column:
    return F.concat(code, F.lit(" — "), name)


def letter_sequence(names: Sequence[Column], letters: Mapping[str, str]) -> Column:
    """Letters of class names joined by arrows; a name without a letter stops the job."""
    table = F.create_map(*[F.lit(x) for pair in letters.items() for x in pair])
    parts = [F.coalesce(table[n], F.when(n.isNull(), F.raise_error(F.lit("a year has no class"))).otherwise(F.raise_error(F.concat(F.lit("no letter for class "), n)))) for n in names]
    return F.concat_ws(" → ", *parts)


def only_classes(names: Sequence[Column], allowed: Sequence[str]) -> Column:
    out = F.lit(True)
    for n in names:
        out = out & F.coalesce(n.isin(*allowed), F.lit(False))
    return out


def alternating(names: Sequence[Column]) -> Column:
    """Whether each class differs from the one before."""
    out = F.lit(True)
    for a, b in zip(names, names[1:]):
        out = out & F.coalesce(a != b, F.lit(False))
    return out


def natural_key(code: Column) -> Column:
    """Text whose order by an English collation is that of ``code`` with every run of digits taken as a number: each run,
    without leading zeros, follows its length in ten digits."""
    parts = F.regexp_extract_all(code, F.lit("[0-9]+|[^0-9]+"), F.lit(0))
    bare = lambda x: F.regexp_replace(x, "^0+(?=[0-9])", "")
    return F.array_join(F.transform(parts, lambda x: F.when(x.rlike("^[0-9]"), F.concat(F.lpad(F.length(bare(x)).cast("string"), 10, "0"), bare(x))).otherwise(x)), "")


def numeric_order(code: Column) -> list[Column]:
    """Natural order of codes as an English reader expects: a9b10 before a10b2, é beside e, a before A where all else is
    equal; codes that the collation holds for equal go by code points, nulls last."""
    return [F.collate(natural_key(code), "en").asc_nulls_last(), code.asc_nulls_last()]


def pixel_window(xmin: Column, ymin: Column, xmax: Column, ymax: Column, x0: Column, y0: Column, pixel: Column, width: Column, height: Column) -> dict[str, Column]:
    """Whole-pixel window over bounds in a grid whose top left corner is (x0, y0): rows and columns from and to
    (exclusive), clamped to the grid; ``covered`` tells whether the bounds lie within the grid wholly."""
    zero = F.lit(0)
    c0, c1 = F.floor((xmin - x0) / pixel), F.ceil((xmax - x0) / pixel)
    r0, r1 = F.floor((y0 - ymax) / pixel), F.ceil((y0 - ymin) / pixel)
    return {
        "row_from": F.greatest(zero, r0), "row_to": F.least(height, r1), "col_from": F.greatest(zero, c0), "col_to": F.least(width, c1),
        "covered": (r0 >= 0) & (c0 >= 0) & (r1 <= height) & (c1 <= width),
    }


def round_half_up(value: Column, places: int) -> Column:
    """``F.round`` of doubles, whose decimal arithmetic is left to large values and those near a tie."""
    scaled = value * 10.0**places
    below = F.floor(scaled)
    plain = (F.abs(scaled) < 1e9) & (F.abs(scaled - below - 0.5) > 1e-4)
    return F.when(plain, F.floor(scaled + 0.5) / F.lit(10.0**places)).otherwise(F.round(value, places))


def rings_area(rings: Column) -> Column:
    """Area of polygons' rings (sign, xs, ys), holes taken off: triangles from the first corner of each ring."""

    def ring(r: Column) -> Column:
        x, y = (lambda k, c=c: F.element_at(r[c], k) - r[c][0] for c in ("xs", "ys"))
        corner = F.when(F.size(r["xs"]) > 2, F.sequence(F.lit(2), F.size(r["xs"]) - 1)).otherwise(F.array().cast("array<int>"))
        return r["sign"] * F.abs(F.aggregate(corner, F.lit(0.0), lambda a, k: a + x(k) * y(k + 1) - x(k + 1) * y(k))) / 2

    return F.aggregate(rings, F.lit(0.0), lambda a, r: a + ring(r))
