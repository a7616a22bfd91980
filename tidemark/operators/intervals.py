"""Points met with the intervals that hold them by an equality join: intervals as dyadic pieces, points as the pieces around them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Points are numbers from 0 to two to this power, less one: enough for the days of the years 1 to 9999, and for a sheet's rows.
LEVELS = 22


def _piece(level: Column, place: Column) -> Column:
    return level.cast("long") * F.lit(1 << (LEVELS + 1)).cast("long") + place


def pieces(first: Column, last: Column) -> Column:
    """The fewest dyadic pieces that make up ``first`` to ``last`` (both in), at most two a level; none if ``last`` is less."""
    low, high = first.cast("long"), last.cast("long") + 1

    def at(level: Column) -> Column:
        size = F.pow(F.lit(2.0), level).cast("long")
        left, right = F.floor((low + size - 1) / size), F.floor(high / size)
        return F.array(
            F.when((left < right) & (left % 2 == 1), _piece(level, left)),
            F.when((left < right) & (right % 2 == 1), _piece(level, right - 1)),
        )

    top = F.floor(F.log2(F.greatest(high - low, F.lit(1)))).cast("int") + 1  # larger pieces don't fit in
    many = F.array_compact(F.flatten(F.transform(F.sequence(F.lit(0), F.least(top, F.lit(LEVELS))), at)))
    return F.when(first == last, F.array(_piece(F.lit(0), low))).otherwise(many)


def level_of(piece: Column) -> Column:
    return F.shiftright(piece, LEVELS + 1).cast("int")


def days_of(piece: Column) -> tuple[Column, Column]:
    """The first and last point of a piece."""
    place, size = piece % F.lit(1 << (LEVELS + 1)).cast("long"), F.pow(F.lit(2.0), level_of(piece)).cast("long")
    return place * size, (place + 1) * size - 1


def around(point: Column, levels: Column | None = None) -> Column:
    """The pieces that hold a point, one a level: an interval holds it just if one of these is among its pieces, and then just one is.

    ``levels`` are those that any interval's pieces have, where that is known; pieces of others meet nothing.
    """
    place = point.cast("long")
    levels = F.sequence(F.lit(0), F.lit(LEVELS)) if levels is None else levels
    return F.transform(levels, lambda level: _piece(level, F.floor(place / F.pow(F.lit(2.0), level)).cast("long")))


def day_number(day: Column) -> Column:
    """Days since the first of January of the year 1."""
    return F.datediff(day, F.lit("0001-01-01").cast("date"))
