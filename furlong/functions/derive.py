"""Derived scalar features, labels and message formatting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def distance_band(metres: Column) -> Column:
    """Disjoint bands: up to 1400, 1800, 2100 m, and beyond."""
    return (
        F.when(metres <= 1400, "short").when(metres <= 1800, "mile")
        .when(metres <= 2100, "middle").when(metres.isNotNull(), "long")
    )


def class_parts(code: Column) -> dict[str, Column]:
    """Surface, grade and sub-grade encoded in a class code.

    Turf starts at 1, dirt at 21, jump at 51. The first three codes of a block
    are G1-G3, the rest come in triples A/B/C from the open class downwards.
    """
    surface = (
        F.when(code.between(1, 18), "turf").when(code.between(21, 38), "dirt")
        .when(code.between(51, 62), "jump")
    )
    step = code - F.when(surface == "turf", 1).when(surface == "dirt", 21).when(surface == "jump", 51)
    triple = F.floor((step - 3) / 3)
    flat = F.when(triple == 0, "open").when(triple == 1, "3win").when(triple == 2, "2win") \
        .when(triple == 3, "1win").when(triple == 4, "maiden")
    jump = F.when(triple == 0, "open").when(triple == 1, "1win").when(triple == 2, "maiden")
    return {
        "surface": surface,
        "grade": F.when(step < 3, F.concat(F.lit("G"), (step + 1).cast("int").cast("string")))
        .otherwise(F.when(surface == "jump", jump).otherwise(flat)),
        "sub_grade": F.when(step >= 3, F.substring(F.lit("ABC"), ((step - 3) % 3 + 1).cast("int"), F.lit(1))),
    }


def line_parts(code: Column) -> dict[str, Column]:
    return {"major_line": F.substring(code, 1, 2), "minor_line": F.substring(code, 3, 2)}


def venue_group(code: Column) -> Column:
    n = code.try_cast("int")
    return (
        F.when(n.between(1, 10), "central").when(n.between(21, 52), "local")
        .when(n.between(61, 79), "overseas")
    )


def byte_label(size: Column) -> Column:
    """Size with two decimals in the largest unit below 1024."""
    label = F.when(size < 1024, F.format_string("%.2f B", size.cast("double")))
    for power, unit in ((1, "KB"), (2, "MB"), (3, "GB")):
        label = label.when(size < 1024 ** (power + 1),
                           F.format_string(f"%.2f {unit}", size / F.lit(float(1024**power))))
    return label.otherwise(F.format_string("%.2f TB", size / F.lit(float(1024**4))))


def percentage(part: Column, total: Column) -> Column:
    return F.when(total > 0, part / total * F.lit(100.0)).otherwise(F.lit(0.0))


def ratio(part: Column, total: Column) -> Column:
    """Guarded rate: NULL when there is nothing to divide by."""
    return F.when(total > 0, part.cast("double") / total)


def weight_change(diff: Column) -> dict[str, Column]:
    return {"change_sign": F.signum(diff).cast("int"), "change_size": F.abs(diff)}


def relative_draw(number: Column, field: Column) -> dict[str, Column]:
    share = ratio(number, field)
    return {
        "relative_draw": share,
        "draw_side": F.when(share <= 1 / 3, "inner").when(share <= 2 / 3, "middle")
        .when(share.isNotNull(), "outer"),
    }


def season(day: Column) -> dict[str, Column]:
    return {"month": F.month(day), "quarter": F.quarter(day)}


def cross(*parts: Column) -> Column:
    """Interaction key of several categories."""
    return F.concat_ws("_", *[F.coalesce(p.cast("string"), F.lit("NA")) for p in parts])


def crosses(distance_change: Column, style: Column, going: Column, sire: Column, draw: Column,
            venue: Column, weight: Column, speed: Column) -> dict[str, Column]:
    """The four interactions: three category pairs and one product."""
    change = F.when(distance_change > 0, "up").when(distance_change < 0, "down") \
        .when(distance_change == 0, "same")
    return {
        "change_x_style": cross(change, style),
        "going_x_sire": cross(going, sire),
        "draw_x_venue": cross(draw, venue),
        "weight_x_speed": weight * speed,
    }
