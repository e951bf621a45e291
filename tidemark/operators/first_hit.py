"""The first bar after a start at which a value reaches a level, and the largest value over a range of bars.

A value inequality gives the planner no key to join by. Series are therefore cut into blocks of BLOCK bars and super
blocks of FAN blocks, and these into groups of FAN super blocks; a block's row holds its bars, the others' rows the
largest values of their parts. A request looks through the rest of its block, then the later blocks of its super block,
the later super blocks of its group, the later groups, and goes down once into the block that it finds. Every step is
an equi-join on a number, so one long series spreads over all tasks, and a request reads about BLOCK + 2 * FAN +
bars / (BLOCK * FAN * FAN) values instead of all bars up to its hit.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import SERIES
from tidemark.functions.storage import stored

BLOCK, FAN = 32, 32
#: what a request can watch; each is a value that grows towards a hit
TRACKS = ("high", "neg_low", "close", "neg_close")


def _blocks(candles: DataFrame, block: int) -> DataFrame:
    """(series, block, bars, tracks): at most `block` bars and the largest value of each track."""
    values = (F.col("high"), (-F.col("low")).alias("neg_low"), F.col("close"), (-F.col("close")).alias("neg_close"))
    bars = candles.select(*SERIES, F.expr(f"bar_index div {block}").alias("block"), F.col("bar_index").alias("i"), *values)
    return bars.groupBy(*SERIES, "block").agg(F.collect_list(F.struct("i", *TRACKS)).alias("bars"), *(F.max(t).alias(t) for t in TRACKS))


def _over(parts: DataFrame, of: str, to: str, name: str, fan: int) -> DataFrame:
    """(series, to, name, tracks): at most `fan` of the parts with the largest value of each track, and the largest of all."""
    return parts.groupBy(*SERIES, F.expr(f"{of} div {fan}").alias(to)).agg(F.collect_list(F.struct(F.col(of).alias("i"), *TRACKS)).alias(name), *(F.max(t).alias(t) for t in TRACKS))


@dataclass(frozen=True)
class Blocks:
    """Candles as blocks, super blocks and groups. `blocked` writes them once for all that looks into the same candles."""

    blocks: DataFrame
    supers: DataFrame
    groups: DataFrame
    block: int
    fan: int

    @classmethod
    def of(cls, candles: DataFrame | Blocks, block: int = BLOCK, fan: int = FAN) -> Blocks:
        if isinstance(candles, Blocks):
            return candles
        blocks = _blocks(candles, block)
        supers = _over(blocks, "block", "super", "blocks", fan)
        return cls(blocks, supers, _over(supers, "super", "group", "supers", fan), block, fan)


def blocked(candles: DataFrame, block: int = BLOCK, fan: int = FAN) -> Blocks:
    blocks = stored(_blocks(candles, block), "blocks")
    supers = stored(_over(blocks, "block", "super", "blocks", fan), "supers")
    return Blocks(blocks, supers, stored(_over(supers, "super", "group", "supers", fan), "groups"), block, fan)


def _watched(x: Column) -> Column:
    out = F.lit(None).cast("double")
    for t in TRACKS:
        out = F.when(F.col("track") == t, x[t]).otherwise(out)
    return out


def _first(parts: Column, low: Column, high: Column) -> Column:
    """The least number in [low, high] of a part that reaches the level."""
    hits = F.filter(parts, lambda x: x["i"].between(low, high) & (_watched(x) >= F.col("level")))
    return F.array_min(F.transform(hits, lambda x: x["i"]))


def _most(parts: Column, low: Column, high: Column) -> Column:
    inside = F.filter(parts, lambda x: x["i"].between(low, high))
    return F.array_max(F.transform(inside, _watched))


def first_hits(requests: DataFrame, candles: DataFrame | Blocks, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """(rid, hit) for requests (rid, asset, timeframe, after, last, track, level): the least bar in (after, last] whose track >= level.

    Requests without a hit have no row.
    """
    held = Blocks.of(candles, block, fan)
    blocks, supers, block, fan = held.blocks, held.supers, held.block, held.fan
    bars = blocks.select(*SERIES, "block", "bars")
    asked = requests.where(F.col("last") > F.col("after")).select("rid", *SERIES, (F.col("after") + 1).alias("from"), "last", "track", "level", F.expr(f"(after + 1) div {block}").alias("block"), F.expr(f"(after + 1) div {block * fan}").alias("super"))
    here = asked.join(bars, [*SERIES, "block"], "left").withColumn("hit", _first(F.col("bars"), F.col("from"), F.col("last"))).drop("bars")
    end = F.expr(f"last div {block}")
    near = F.when(F.col("hit").isNull(), _first(F.col("blocks"), F.col("block") + 1, end))
    parts = supers.select(*SERIES, "super", "blocks")
    near = here.join(parts, [*SERIES, "super"], "left").withColumn("found", near).drop("blocks")

    open_ = near.where("hit IS NULL AND found IS NULL").withColumn("end", F.expr(f"last div {block * fan}")).where("end > super").select("rid", *SERIES, "track", "level", "last", "super", "end", F.expr(f"super div {fan}").alias("group"))
    groups = held.groups
    above = groups.select(*SERIES, "group", "supers")
    met = open_.join(above, [*SERIES, "group"], "left").withColumn("at", _first(F.col("supers"), F.col("super") + 1, F.col("end"))).drop("supers")
    # only the largest values are met by several groups; the super blocks of the one that is found come after
    reaches = _watched(F.struct(*TRACKS)) >= F.col("level")
    beyond = met.where(F.col("at").isNull()).withColumn("stop", F.expr(f"end div {fan}")).where("stop > group")
    later = beyond.withColumn("group", F.explode(F.sequence(F.col("group") + 1, "stop"))).join(groups.drop("supers"), [*SERIES, "group"]).where(reaches)
    first = later.groupBy("rid", *SERIES, "track", "level", "last", "end").agg(F.min("group").alias("group"))
    far = first.join(above, [*SERIES, "group"]).withColumn("at", _first(F.col("supers"), F.lit(0), F.col("end")))
    columns = ["rid", *SERIES, "track", "level", "last", F.col("at").alias("super")]
    found = met.where(F.col("at").isNotNull()).select(*columns).unionByName(far.where(F.col("at").isNotNull()).select(*columns))
    far = found.join(parts, [*SERIES, "super"]).select("rid", _first(F.col("blocks"), F.lit(0), end).alias("far"))

    down = near.join(far, "rid", "left").withColumn("block", F.coalesce("found", "far")).drop("super", "found", "far").join(bars, [*SERIES, "block"], "left")
    return down.select("rid", F.coalesce("hit", _first(F.col("bars"), F.col("from"), F.col("last"))).alias("hit")).where("hit IS NOT NULL")


def range_max(requests: DataFrame, candles: DataFrame | Blocks, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """(rid, largest) for requests (rid, asset, timeframe, after, last, track): the largest value of the track over the bars in (after, last].

    The bars of the first and the last block, the blocks between in their two super blocks, the super blocks between
    these in their two groups, and the whole groups between. Ranges without bars have no row.
    """
    held = Blocks.of(candles, block, fan)
    blocks, supers, block, fan = held.blocks, held.supers, held.block, held.fan
    asked = requests.where(F.col("last") > F.col("after")).select("rid", *SERIES, (F.col("after") + 1).alias("from"), "last", "track", F.expr(f"(after + 1) div {block}").alias("b0"), F.expr(f"last div {block}").alias("b1"), F.expr(f"(after + 1) div {block * fan}").alias("s0"), F.expr(f"last div {block * fan}").alias("s1"))
    bars = lambda key: blocks.select(*SERIES, F.col("block").alias(key), F.col("bars").alias(f"_{key}"))
    over = lambda key: supers.select(*SERIES, F.col("super").alias(key), F.col("blocks").alias(f"_{key}"))
    found = asked
    for key, table in (("b0", bars), ("b1", bars), ("s0", over), ("s1", over)):
        whole = key[0] == "b"
        low, high = (F.col("from"), F.col("last")) if whole else (F.col("b0") + 1, F.col("b1") - 1)
        found = found.join(table(key), [*SERIES, key], "left").withColumn(f"m_{key}", _most(F.col(f"_{key}"), low, high)).drop(f"_{key}")
    inner = asked.where("s1 > s0 + 1").select("rid", *SERIES, "track", (F.col("s0") + 1).alias("from_super"), (F.col("s1") - 1).alias("to_super"))
    inner = inner.withColumn("g0", F.expr(f"from_super div {fan}")).withColumn("g1", F.expr(f"to_super div {fan}"))
    groups = held.groups
    ends = inner.withColumn("group", F.explode(F.array_distinct(F.array("g0", "g1")))).join(groups.select(*SERIES, "group", "supers"), [*SERIES, "group"]).select("rid", _most(F.col("supers"), F.col("from_super"), F.col("to_super")).alias("m"))
    whole = inner.where("g1 > g0 + 1").withColumn("group", F.explode(F.sequence(F.col("g0") + 1, F.col("g1") - 1))).join(groups.drop("supers"), [*SERIES, "group"]).select("rid", _watched(F.struct(*TRACKS)).alias("m"))
    middle = ends.union(whole).groupBy("rid").agg(F.max("m").alias("m"))
    return found.join(middle, "rid", "left").select("rid", F.greatest("m", "m_b0", "m_b1", "m_s0", "m_s1").alias("largest")).where("largest IS NOT NULL")
