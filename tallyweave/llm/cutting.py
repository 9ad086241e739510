"""Places in texts by DataFrame functions, with work that grows as the text does and not as its square."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Code points to a piece, as a power of two.
BITS = 8
PIECE = 1 << BITS
#: Values that are added up in one go. Work grows with the values' number as long as that is below the square of this or not far above it.
WIDTH = 1024


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def some(a: Column, first: Column, stop: Column) -> Column:
    """The elements of an array from first up to stop, by themselves: slice() reads the whole array each time."""
    return F.when(stop > first, F.transform(F.sequence(first, stop - 1), lambda k: F.get(a, k))).otherwise(F.slice(a, F.lit(1), F.lit(0)))


def scanned(values: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """What merge makes of an array of longs up to and with each of them, from 0 on; merge is associative, and 0 changes nothing.

    An array that grows by a value at a time is copied at each; so runs of WIDTH are done alone, and their ends by the same rule.
    """

    def plain(a: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("last"), F.array().cast("array<bigint>").alias("all"))
        return F.aggregate(a, start, lambda s, x: bound(merge(s["last"], x), lambda now: F.struct(now.alias("last"), F.concat(s["all"], F.array(now)).alias("all"))), lambda s: s["all"])

    def split(a: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / WIDTH).cast("int")), lambda k: plain(some(a, k * WIDTH, F.least((k + 1) * WIDTH, F.size(a)))))

    def put_together(runs: Column, ends: Column) -> Column:
        before = lambda k: F.when(k == 0, F.lit(0).cast("long")).otherwise(F.get(ends, k - 1))
        return F.flatten(F.transform(runs, lambda r, k: bound(before(k), lambda b: F.transform(r, lambda x: merge(b, x)))))

    runs = bound(values, lambda a: F.when(F.size(a) > 0, split(a)).otherwise(F.array().cast("array<array<bigint>>")))
    return bound(runs, lambda r: put_together(r, plain(F.transform(r, lambda x: F.element_at(x, -1)))))


def pieces(text: Column) -> Column:
    """A text as an array of its pieces, for between()."""
    return F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % PIECE), F.lit(0))


def between(cut: Column, a: Column, b: Column) -> Column:
    """The code points of a text from a up to b, out of its pieces; both are longs."""
    i, j = F.shiftright(a, BITS).cast("int"), F.shiftright(b, BITS).cast("int")
    first, last = (F.coalesce(F.get(cut, x), F.lit("")) for x in (i, j))
    at = (a % PIECE + 1).cast("int")
    inner = F.when(j > i + 1, F.array_join(some(cut, i + 1, F.least(j, F.size(cut))), "")).otherwise(F.lit(""))
    many = F.concat(F.substring(first, at, F.lit(PIECE)), inner, F.substring(last, F.lit(1), (b % PIECE).cast("int")))
    return F.when(b <= a, F.lit("")).when(i == j, F.substring(first, at, (b - a).cast("int"))).otherwise(many)
