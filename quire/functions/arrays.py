"""Column expressions over whole arrays: named values, and states carried from element to element. A pass written with
them takes a document as one row, and shuffles nothing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements whose states are put together at a time, so that no long array is copied for each of them.
_CHUNK = 16


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use of a value that is computed once, however often use names it."""
    # the state of no steps; a transform() of one element would copy what use gives
    return F.aggregate(F.array().cast("array<int>"), value, lambda done, _: done, use)


def scan(items: Column, zero: Column, step: Callable[[Column, Column], Column]) -> Column:
    """The state behind each item: step of the state before it and the item. zero has the type of a state."""
    last = lambda done: F.element_at(done, -1)
    # the states of a chunk, behind the last one of the chunk before
    read = lambda state, chunk: F.aggregate(chunk, F.array(state), lambda done, x: F.concat(done, F.array(step(last(done), x))))

    def found(items: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.size(items) + 1, F.lit(_CHUNK)), lambda at: at <= F.size(items))
        add = lambda done, at: F.concat(done, F.array(read(last(last(done)), F.slice(items, at, F.lit(_CHUNK)))))
        return F.when(items.isNotNull(), F.aggregate(starts, F.array(F.array(zero)), add))

    return F.flatten(F.transform(let(items, found), lambda x: F.slice(x, F.lit(2), F.size(x))))


def last_where(items: Column, fits: Callable[[Column], Column]) -> Column:
    """The place of the last item that fits, -1 if none does."""
    return F.coalesce(F.array_max(F.transform(items, lambda x, i: F.when(fits(x), i))), F.lit(-1))


def first_where(items: Column, fits: Callable[[Column], Column]) -> Column:
    """The place of the first item that fits, null if none does."""
    return F.array_min(F.transform(items, lambda x, i: F.when(fits(x), i)))


def part(items: Column, start: Column, end: Column) -> Column:
    """The items from start on and before end."""
    return F.slice(items, start + 1, F.greatest(end - start, F.lit(0)))


def replaced(items: Column, changes: Column) -> Column:
    """Items with others in place of some stretches: changes are (at, upto, made), in order and apart from each other."""

    def written(changes: Column) -> Column:
        behind = lambda c, k: part(items, c["upto"], F.coalesce(F.get(changes, k + 1)["at"], F.size(items)))
        new = F.transform(changes, lambda c, k: F.concat(c["made"], behind(c, k)))
        return F.when(F.size(changes) > 0, F.concat(part(items, F.lit(0), F.get(changes, F.lit(0))["at"]), F.flatten(new))).otherwise(items)

    return let(changes, written)


def change(at: Column, upto: Column, made: Column) -> Column:
    """What replaced() puts in place of the items from at on and before upto."""
    return F.struct(at.alias("at"), upto.alias("upto"), made.alias("made"))
