"""Joins that pick one partner: largest score first, then fixed tie-breaks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def argmax_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], left_key: Sequence[str], score: Sequence[Column], right_idx: str, where: Column | None = None, how: str = "inner"
) -> DataFrame:
    """Each left row with the right row of the same group that has the largest ``score`` tuple; ties go to the smallest ``right_idx``.

    ``on`` bounds the groups (a page, a table), so the pairs of a group are few; the best one is kept by a max over structs, which
    combines before the shuffle and needs no sort. ``where`` says which pairs count. With ``how`` left, rows without a partner stay with nulls.
    ``score`` and ``where`` are over the columns of both sides, whose names must differ but for ``on``.
    """
    pairs = left.join(right, list(on))
    if where is not None:
        pairs = pairs.where(where)
    own = [c for c in left.columns if c not in (*on, *left_key)]
    theirs = [c for c in right.columns if c not in on]
    rank = F.struct(*[s.alias(f"s{i}") for i, s in enumerate(score)], (-F.col(right_idx)).alias("tie"))
    best = pairs.groupBy(*on, *left_key).agg(F.max_by(F.struct(*own, *theirs), rank).alias("_best"))
    found = best.select(*on, *left_key, *[F.col(f"_best.{c}").alias(c) for c in (*own, *theirs)])
    if how == "inner":
        return found
    return left.join(found.select(*on, *left_key, *theirs), [*on, *left_key], "left")


def ruling_connectors(lines: DataFrame, group: Sequence[str], gap: float, angle: float) -> DataFrame:
    """New segments that bridge pairs of different rulings of a group: ends nearer than ``gap``, at less than ``angle`` degrees from the horizontal.

    Pairs are left out where one's middle lies within the other's extent on either axis. ``lines``: group columns, line_idx,
    x0, y0, x1, y1 (float). Returns (group, line_idx, other_idx, pair, ax, ay, bx, by); pair numbers the four choices of ends.
    """
    ends = ("x0", "y0", "x1", "y1")
    a = lines.select(*group, "line_idx", *[F.col(c).alias(f"a_{c}") for c in ends])
    b = lines.select(*group, F.col("line_idx").alias("other_idx"), *[F.col(c).alias(f"b_{c}") for c in ends])
    middle = lambda s, k: ((F.col(f"{s}_{k}0") + F.col(f"{s}_{k}1")) / 2).cast("float")
    within = [(F.col(f"{s}_{k}0") < middle(o, k)) & (middle(o, k) < F.col(f"{s}_{k}1")) for s, o in (("a", "b"), ("b", "a")) for k in "xy"]
    apart = reduce(lambda x, y: x & ~y, within, F.col("line_idx") != F.col("other_idx"))
    pair = lambda k, i, j: F.struct(F.lit(k).alias("pair"), F.col(f"a_x{i}").alias("ax"), F.col(f"a_y{i}").alias("ay"), F.col(f"b_x{j}").alias("bx"), F.col(f"b_y{j}").alias("by"))
    each = F.explode(F.array(*[pair(k, i, j) for k, (i, j) in enumerate((i, j) for i in "01" for j in "01")]))
    met = a.join(b, list(group)).where(apart).select(*group, "line_idx", "other_idx", each.alias("e")).select(*group, "line_idx", "other_idx", "e.*")
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    slope = F.degrees(F.atan(F.abs(dy.cast("double") / (dx.cast("double") + 1e-10))))
    return met.where((F.sqrt((dx * dx + dy * dy).cast("double")) < gap) & (slope < angle))
