"""Connected components of a link table by repeated hooking and contraction; all state is in staged tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_staged, stage

JUMPS = 2
LEAST_BLOCK, BLOCK_UNITS = 256, 64


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``comp`` (smallest node reachable) of every node of ``edges`` (a long, b long).

    Each round every node hooks to its smallest neighbour, chains of hooks are shortened by pointer jumping and
    the links between the nodes that remain are kept. A star or a clique is one node after one round, and links
    at least halve otherwise. No row of links, and no component, is collected anywhere.
    """
    left = stage(edges.select("a", "b").filter("a <> b").distinct(), "links")
    labels = stage(left.select(F.col("a").alias("node")).union(left.select("b")).distinct().withColumn("comp", F.col("node")), "labels")
    while not left.isEmpty():
        both = left.union(left.select("b", "a"))
        hook = both.groupBy(F.col("a").alias("v")).agg(F.least(F.col("v"), F.min("b")).alias("to"))
        hook = stage(hook, "hooks")
        spent = [left, labels]
        for _ in range(JUMPS):
            spent.append(hook)
            up = hook.select(F.col("v").alias("_v"), F.col("to").alias("_to"))
            hook = stage(hook.join(up, hook["to"] == up["_v"], "left").select("v", F.coalesce("_to", "to").alias("to")), "hooks")
        labels = stage(labels.join(hook, labels["comp"] == hook["v"], "left").select("node", F.coalesce("to", "comp").alias("comp")), "labels")
        for c in ("a", "b"):
            left = left.join(hook.select(F.col("v").alias(c), "to"), c).drop(c).withColumnRenamed("to", c)
        left = stage(left.select("a", "b").filter("a <> b").distinct(), "links")
        drop_staged(*spent, hook)
    drop_staged(left)
    return labels


def blocks_of(marked: DataFrame, size: str) -> DataFrame:
    """block, unit, comp, sig, alone. A unit's home is the component that is major in most of its lists; homes with
    LEAST_BLOCK units of like size are dealt into blocks, members of the component apart from others."""
    homes = marked.groupBy("unit", "major").agg(F.count(F.lit(1)).alias("k"), F.max("comp").alias("comp"), F.max("sig").alias("sig"))
    homes = homes.groupBy("unit").agg(F.max_by("major", F.struct("k", "major")).alias("home"), F.max("comp").alias("comp"), F.max("sig").alias("sig"))
    key = ["home", "inner", "class"]
    homes = homes.withColumn("inner", F.col("comp") == F.col("home")).withColumn("class", F.floor(F.log(F.expr(size) + F.lit(1)) / F.log(F.lit(1.1))))
    homes = homes.join(homes.groupBy(*key).agg(F.count(F.lit(1)).alias("n")), key)
    few = F.col("n") < LEAST_BLOCK
    block = F.xxhash64(*key, F.pmod(F.xxhash64("unit"), F.ceil(F.col("n") / BLOCK_UNITS)))
    return homes.select(F.when(few, F.col("unit")).otherwise(block).alias("block"), "unit", "comp", "sig", few.alias("alone"))


def linked_by_lists(lists: DataFrame, verify, may_link: str = "true", size: str = "0", shared: int = 1, apart: str = "", verify_blocks=None) -> DataFrame:
    """Components of units that meet in lists and pass ``verify``; no list ever emits all its pairs.

    ``lists``: token long, unit long, sig long, weight long, a staged table. Units of more weight are likelier to link. ``may_link``: SQL over the units' signatures asig and
    bsig that holds for every pair that links. ``size``: SQL over sig; likely partners are near in it. Two units are
    candidates if they share ``shared`` tokens. ``verify`` takes pairs (a, b) and returns those that link.

    First each member of a list meets the next in size and the heaviest one only. Then, in lists whose members are not
    yet one component, the members outside the list's major component meet all whose component differs and whose
    signatures allow a link. Pairs inside a component need no check, so the components are those of all links.

    With ``verify_blocks`` (for ``shared`` 1), units that stand around one component in great number meet in blocks of
    BLOCK_UNITS: one row for two blocks, whose links ``verify_blocks`` finds from pairs (a, b) of blocks and members
    (block, unit, comp, sig). ``apart``: SQL for the most that sizes of linked units differ, from ``x``, the smaller.
    """

    def counted(pairs: DataFrame) -> DataFrame:
        pairs = pairs.selectExpr("least(a, b) a", "greatest(a, b) b")
        return pairs.distinct() if shared == 1 else pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") >= shared).select("a", "b")

    # Half-open classes of sizes share out long lists.
    sized = Window.partitionBy("token", F.floor(F.log2(F.expr(size) + F.lit(1)))).orderBy(F.expr(size), "sig", "unit")
    by_token = lists.repartition("token")  # one exchange for windows, aggregates and joins by token
    beside = by_token.select(F.col("unit").alias("a"), F.col("sig").alias("asig"), F.lag("unit").over(sized).alias("b"), F.lag("sig").over(sized).alias("bsig"))
    top = by_token.groupBy("token").agg(F.max(F.struct("weight", "unit", "sig")).alias("top"))
    above = by_token.join(top.hint("merge"), "token").select(F.col("unit").alias("a"), F.col("sig").alias("asig"), F.col("top.unit").alias("b"), F.col("top.sig").alias("bsig"))
    rays = stage(counted(beside.union(above).filter("a <> b").filter(may_link)), "rays")
    first = verify(rays)
    comps = components(first)
    # Two units of equal tokens ahead of this one have met there, so they meet only where these differ.
    order = Window.partitionBy("unit").orderBy("token")
    listing = lists.drop("weight").withColumn("before", F.coalesce(F.lag("token").over(order), F.lit(-1)) if shared == 1 else F.lit(-1))
    held = listing.join(comps.withColumnRenamed("node", "unit"), "unit", "left").withColumn("comp", F.coalesce("comp", "unit")).repartition("token")
    major = held.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("k")).groupBy("token")
    major = major.agg(F.max(F.struct("k", "comp")).getField("comp").alias("major"), F.count(F.lit(1)).alias("several"), F.sum("k").alias("n"))
    # Two units alone in a list have met as rays, which settles them if one shared list is enough.
    major = major.filter("several > 1" + (" AND n > 2" if shared == 1 else "")).drop("several", "n")
    marked = stage(held.join(major.hint("merge"), "token"), "marked")
    spent, third = [rays, first, marked], None
    alone = marked
    if verify_blocks is not None:
        members = stage(blocks_of(marked, size), "blocks")
        spent.append(members)
        rows = marked.join(members.select("unit", "block", "alone"), "unit")
        alone = rows.filter("alone")
        many = rows.groupBy("token", "block", "alone").agg(F.max(F.col("comp") != F.col("major")).alias("minor"), F.min(F.expr(size)).alias("lo"), F.max(F.expr(size)).alias("hi"))
        side = lambda df, x: df.select("token", *[F.col(c).alias(f"{x}_{c}") for c in ("block", "alone", "minor", "lo", "hi")])
        pairs = side(many.filter("NOT alone"), "a").join(side(many, "b"), "token").filter(
            f"(a_minor OR b_minor) AND (b_alone OR a_block <= b_block) AND greatest(a_lo - b_hi, b_lo - a_hi) <= {apart.format(x='least(a_hi, b_hi)')}"
        )
        pairs = stage(pairs.select(F.col("a_block").alias("a"), F.col("b_block").alias("b")).distinct(), "block-pairs")
        third = verify_blocks(pairs, members)
        spent += [pairs, third]
    alone = alone.repartition("token")
    a = alone.filter("comp <> major").selectExpr("token", "unit a", "comp ac", "sig asig", "before a_before")
    b = alone.selectExpr("token", "unit b", "comp bc", "sig bsig", "comp = major bm", "before b_before")
    met = a.join(b, "token").filter(f"ac <> bc AND (bm OR a < b) AND (a_before <> b_before OR a_before = -1) AND {may_link}")
    rest = stage(counted(met.select("a", "b")).join(rays, ["a", "b"], "left_anti"), "met")
    second = verify(rest)
    links = second.select("a", "b") if third is None else second.select("a", "b").union(third)
    out = components(links.union(comps.select(F.col("node").alias("a"), F.col("comp").alias("b"))))
    drop_staged(*spent, comps, rest, second)
    return out
