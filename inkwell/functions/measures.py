"""Dates, lengths on paper, crop geometry, rates and status rules."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso_date(value: Column) -> Column:
    """d/m/Y or Y-m-d at the start of a text as Y-m-d; other texts as they are, blank ones null."""
    text = F.nullif(F.trim(value), F.lit(""))
    start = F.left(text, F.lit(10))
    dates = [F.date_format(F.try_to_timestamp(F.when(start.rlike(shape), start), F.lit(form)), "yyyy-MM-dd") for shape, form in ((r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"), (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"))]
    return F.coalesce(*dates, text)


def crop(width: Column, height: Column, box: tuple[Column, Column, Column, Column], most: float = 0.65) -> dict[str, Column]:
    """A card's box with a margin inside its page, its proportions, and whether it is taken.

    ``most`` is the largest share of the page: 0.65 for whole pages, 1.0 for cut ones.
    """
    pad = F.greatest(F.lit(12), F.floor(F.greatest(width, height) * 0.015)).cast("int")
    left, top = F.greatest(F.lit(0), box[0] - pad), F.greatest(F.lit(0), box[1] - pad)
    right, bottom = F.least(width, box[2] + pad), F.least(height, box[3] + pad)
    w, h = right - left, bottom - top
    ratio = F.when(h > 0, w / h).otherwise(0.0)
    share = (w * h) / (width * height)
    status = F.when(box[0].isNull(), "crop_not_detected").when(~ratio.between(1.20, 2.05) | ~share.between(0.02, most), "crop_fallback_full_page").otherwise("crop_detected")
    return {"left": left, "top": top, "right": right, "bottom": bottom, "ratio": ratio, "coverage": share, "crop_status": status}


#: Width over height of a card.
CARD = 1.586


def nearest(angles: Column, ratio: Callable[[Column], Column], target: float, before: Column | None = None) -> Column:
    """off, turn and angle of the angle whose ratio is nearest to the target, the first of equal ones; ``before`` is one found earlier.

    Angles without a ratio don't count; with none the angle is 0 and off infinite.
    """
    tried = F.transform(angles, lambda a, i: F.struct(F.abs(F.lit(target) - ratio(a)).alias("off"), (i + 1).alias("turn"), a.cast("int").alias("angle")))
    none = F.struct(F.lit(float("inf")).alias("off"), F.lit(0).alias("turn"), F.lit(0).alias("angle")) if before is None else before
    measured = F.filter(tried, lambda t: t["off"].isNotNull() & ~F.isnan(t["off"]))
    best = F.array_min(F.concat(F.array(none), measured))
    return F.struct(best["off"].alias("off"), F.lit(0).alias("turn"), best["angle"].alias("angle"))


def best_angle(angles: Iterable[int], ratio: Callable[[Column], Column], target: float = CARD) -> Column:
    """The angle whose ratio is nearest to a card's, the first of equal ones; ``ratio`` gives the ratio measured at an angle."""
    return nearest(F.array(*[F.lit(a) for a in angles]), ratio, target)["angle"]


def searched_angle(ratio: Callable[[Column], Column], coarse: Iterable[int] = range(-90, 91, 6), reach: int = 5, target: float = CARD) -> Column:
    """off, angle and coarse_angle of a search in two steps: the coarse angles, then every degree within reach of the best of these.

    A fine angle replaces the coarse one only if it is nearer.
    """

    def finer(found: Column) -> Column:
        fine = nearest(F.sequence(found["angle"] - reach, found["angle"] + reach), ratio, target, found)
        return F.struct(fine["off"].alias("off"), fine["angle"].alias("angle"), found["angle"].alias("coarse_angle"))

    # a one-element array binds the coarse result, which would be measured again for every fine angle otherwise
    return F.element_at(F.transform(F.array(nearest(F.array(*[F.lit(a) for a in coarse]), ratio, target)), finer), 1)


def pixels(mm: Column, dpi: Column) -> Column:
    """Millimetres as pixels, halves to the even one."""
    return F.bround(mm / 25.4 * dpi, 0).cast("long")


def per_second(tokens: Column, seconds: Column) -> Column:
    return F.try_divide(tokens.cast("double"), seconds)


def optional_sum(*values: Column) -> Column:
    """The sum of the values that are there; null if none is."""
    return F.when(F.coalesce(*values).isNotNull(), sum((F.coalesce(v, F.lit(0)) for v in values), F.lit(0)))


def joined(*errors: Column) -> Column:
    return F.nullif(F.concat_ws(" | ", *errors), F.lit(""))


def reduced_status(*statuses: Column) -> Column:
    """The worst of the sides: timeout, failed, invalid_json, success."""
    any_is = lambda s: F.greatest(*[x == s for x in statuses])
    return F.when(any_is("timeout"), "timeout").when(any_is("failed"), "failed").when(any_is("invalid_json"), "invalid_json").otherwise("success")


def duration(seconds: Column) -> Column:
    """HH:MM:SS, whole seconds, not below zero; a dash for null."""
    s = F.greatest(F.lit(0), F.floor(seconds)).cast("long")
    return F.coalesce(F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60), F.pmod(s, F.lit(60))), F.lit("—"))
