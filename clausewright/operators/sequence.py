"""Rows by their place in an order, and draws that depend on a seed alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import settled


def placed(rows: DataFrame, order: list[str | Column], name: str = "place") -> DataFrame:
    """``rows`` with their place in the whole order, from 1, without one task that sees all of them.

    Rows are dealt into ranges of the order and sorted within them; a range's count gives where the next
    begins. ``order`` should tell rows apart. Settled in between, since ranges are drawn anew at each run.
    """
    dealt = settled(rows.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("__at", 33)
    # one row for each range, however many rows there are
    sizes = dealt.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = sizes.select("__part", (F.sum("__n").over(W.orderBy("__part")) - F.col("__n")).alias("__before"))
    both = dealt.withColumn("__part", part).join(F.broadcast(before), "__part")
    return both.withColumn(name, (F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).cast("bigint")).drop("__part", "__before", "__at")


def side_by_side(left: DataFrame, right: DataFrame, left_order: list[str | Column], right_order: list[str | Column]) -> DataFrame:
    """The rows of both by place: the first with the first and so on; where one has more rows, the other's columns are null. Column names should differ."""
    return placed(left, left_order).join(placed(right, right_order), "place", "full_outer")


def drawn(candidates: DataFrame, themes: list[str], each: int, seed: str, feasible: Column, theme: str = "theme", item: str = "item") -> DataFrame:
    """Rows (theme, item, drawn_as, nth): ``each`` items for every theme in turn, none twice; ``theme`` is whose it was, ``drawn_as`` for whom.

    Order within a theme depends on the seed and the item alone. Items that aren't feasible are passed over.
    A theme that runs short takes what the next themes have left, in their order, after all have drawn their
    own; ``each`` times the number of themes is small, so each round ends in a settled table and an anti-join.
    """
    key = F.sha2(F.concat_ws(":", F.lit(seed), F.col(theme), F.col(item).cast("string")), 256)
    pool = settled(candidates.where(feasible).select(theme, item, key.alias("__key")).distinct())
    rank = F.row_number().over(W.partitionBy(item).orderBy(F.array_position(F.array(*map(F.lit, themes)), F.col(theme)), "__key"))
    # an item of several themes is drawn for the first of them
    own = pool.where(F.col(theme).isin(themes)).withColumn("__n", rank).where("__n = 1").drop("__n")
    nth = F.row_number().over(W.partitionBy(theme).orderBy("__key", item))
    taken = settled(own.withColumn("nth", nth).where(F.col("nth") <= each).select(theme, item, F.col(theme).alias("drawn_as"), "nth"))
    for i, name in enumerate(themes):
        have = taken.where(F.col("drawn_as") == name).count()
        if have < each:
            after = [*themes[i + 1 :], *themes[:i]]
            rest = own.join(taken.select(item), item, "left_anti")
            turn = F.array_position(F.array(*map(F.lit, after)), F.col(theme)) if after else F.lit(0)
            more = rest.where(F.col(theme) != name).orderBy(turn, "__key", item).limit(each - have)
            numbered = more.withColumn("nth", F.row_number().over(W.partitionBy(F.lit(name)).orderBy(turn, "__key", item)) + have)
            taken = settled(taken.unionByName(numbered.select(theme, item, F.lit(name).alias("drawn_as"), "nth")))
    return taken
