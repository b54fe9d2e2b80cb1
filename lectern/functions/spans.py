"""Array helpers: values computed once, running sums, and all matches of a pattern with their offsets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often and in whatever lambda it is used.

    The optimizer inlines a column that is referenced once into the lambda that
    uses it, where it would be computed anew for every element.
    """
    return F.transform(F.array(value), body)[0]


def prefix_sums(lens: Column, block: int = 256) -> Column:
    """Running sums of an int array, without its own element: [0, a0, a0+a1, ...].

    Two levels of blocks keep the work at n * block steps for arrays of any length.
    """
    zero = F.lit(0)
    whole = lambda a, start, n: F.aggregate(F.slice(a, start, n), zero, lambda acc, x: acc + x)

    def with_array(a: Column) -> Column:
        blocks = F.transform(F.sequence(zero, F.floor(F.size(a) / block).cast("int")), lambda b: whole(a, b * block + 1, F.lit(block)))

        def with_blocks(s: Column) -> Column:
            starts = F.transform(F.sequence(zero, F.size(s) - 1), lambda b: whole(s, F.lit(1), b))

            def at(p: Column) -> Column:
                return F.transform(a, lambda x, i: p[F.floor(i / block).cast("int")] + whole(a, F.floor(i / block).cast("int") * block + 1, i % block))

            return let(starts, at)

        return let(blocks, with_blocks)

    return let(lens, with_array)


def match_spans(text: Column, pattern: str) -> Column:
    """array<struct<start,end,value>>: leftmost non-overlapping matches in code points, end exclusive.

    ``split`` gives the gaps and ``regexp_extract_all`` the matches of one and the
    same search, so their lengths in turn add up to the offsets.
    """
    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("v"), F.split(text, pattern, -1).alias("g"))

    def place(b: Column) -> Column:
        steps = F.zip_with(b["v"], F.slice(b["g"], 1, F.size(b["v"])), lambda v, g: F.length(v) + F.length(g))
        return let(
            prefix_sums(steps),
            lambda p: F.transform(
                b["v"],
                lambda v, i: F.struct((p[i] + F.length(b["g"][i])).alias("start"), (p[i] + F.length(b["g"][i]) + F.length(v)).alias("end"), v.alias("value")),
            ),
        )

    return let(both, place)
