"""Cutting large groups into pairs of blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def in_blocks(dealt: DataFrame, keys: list[str], ident: str, block: int, scratch: Scratch) -> DataFrame:
    """``dealt`` (keys, ident, home, ...) with the two blocks, i and j, that a row is joined in: -1 twice where the group of the keys has at most ``block`` rows.

    A group of more has n blocks; a row of block b meets block c as a home row in (b, c) and as another row in (c, b).
    So no task holds more than two blocks, however many rows a group has. The join with the numbers of
    rows is on groups, of which few are large, so adaptive execution may send them to every task.
    """
    large = dealt.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > block)
    large = scratch.write(large.select(*keys, F.ceil(F.col("rows") / block).cast("int").alias("blocks")), "large")
    if large.isEmpty():  # spares the shuffle that the join takes
        return dealt.withColumns({"i": F.lit(-1), "j": F.lit(-1)})
    own = F.pmod(F.xxhash64(ident), F.col("blocks")).cast("int")
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    pair = lambda i, j, home: F.struct(i.alias("i"), j.alias("j"), home.alias("home"))
    as_home = F.when(F.col("home"), F.transform(every, lambda j: pair(own, j, F.lit(True)))).otherwise(F.array(pair(own, own, F.lit(False))))
    as_other = F.transform(F.filter(every, lambda i: i != own), lambda i: pair(i, own, F.lit(False)))
    alone = F.array(pair(F.lit(-1), F.lit(-1), F.col("home")))
    places = F.when(F.col("blocks").isNull(), alone).otherwise(F.concat(as_home, as_other))
    rest = [c for c in dealt.columns if c not in (*keys, "home")]
    return dealt.join(large, keys, "left").withColumn("p", F.explode(places)).select(*keys, *rest, "p.i", "p.j", "p.home")
