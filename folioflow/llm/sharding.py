"""Resharding by minimum-cost flow: the new sizes, reached by moving the fewest bytes.

Documents fall into a fixed number of blocks by id; only block sizes (a table bounded by the number of blocks)
reach the driver. There a flow from old shards to new ones, staying free and moving dear, gives the bytes to
send from each shard to each other; blocks realise it, largest first. Documents then look their block up in a
broadcast table bounded by the number of blocks. Only affected shards are written again.
"""

from __future__ import annotations

import heapq
import uuid
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stage, text_or_empty

BLOCKS = 8192


def min_cost_flow(supply: list[int], demand: list[int], cost: list[list[int]]) -> list[list[int]]:
    """Transport of sum(supply) = sum(demand) at least cost: successive shortest paths with potentials."""
    n, m = len(supply), len(demand)
    source, sink = n + m, n + m + 1
    graph: list[list[list[int]]] = [[] for _ in range(n + m + 2)]  # edge: to, room, cost, place of its reverse

    def edge(u: int, v: int, room: int, c: int) -> None:
        graph[u].append([v, room, c, len(graph[v])])
        graph[v].append([u, 0, -c, len(graph[u]) - 1])

    for i, s in enumerate(supply):
        edge(source, i, s, 0)
        for j in range(m):
            edge(i, n + j, min(s, demand[j]), cost[i][j])
    for j, d in enumerate(demand):
        edge(n + j, sink, d, 0)
    potential = [0] * len(graph)
    while True:
        dist, via = [float("inf")] * len(graph), [None] * len(graph)
        dist[source], heap = 0, [(0, source)]
        while heap:
            d, u = heapq.heappop(heap)
            if d > dist[u]:
                continue
            for k, (v, room, c, _) in enumerate(graph[u]):
                if room > 0 and (nd := d + c + potential[u] - potential[v]) < dist[v]:
                    dist[v], via[v] = nd, (u, k)
                    heapq.heappush(heap, (nd, v))
        if via[sink] is None:
            break
        potential = [p + d if d < float("inf") else p for p, d in zip(potential, dist, strict=True)]
        path, v = [], sink
        while v != source:
            u, k = via[v]
            path.append((u, k))
            v = u
        amount = min(graph[u][k][1] for u, k in path)
        for u, k in path:
            graph[u][k][1] -= amount
            graph[graph[u][k][0]][graph[u][k][3]][1] += amount
    flow = [[0] * m for _ in range(n)]
    for i in range(n):
        for v, _, _, back in graph[i]:
            if n <= v < n + m:
                flow[i][v - n] = graph[v][back][1]
    return flow


def plan_blocks(blocks: dict[tuple[int, int], int], old: int, capacities: list[int]) -> dict[tuple[int, int], int]:
    """New shard of each (old shard, block), from the blocks' bytes and the share of bytes each new shard takes.

    Blocks that the flow leaves in place stay; of a shard's other bytes the largest blocks that fit a transfer
    go first, and what no transfer can hold whole goes where most room is left. A last pass moves single blocks
    from the fullest shard to the emptiest while that narrows their difference.
    """
    total, weight = sum(blocks.values()), sum(capacities)
    target = [total * c // weight for c in capacities]
    for j in range(total - sum(target)):
        target[j % len(target)] += 1
    supply = [0] * old
    by_shard: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for (s, b), size in blocks.items():
        supply[s] += size
        by_shard[s].append((size, b))
    flow = min_cost_flow(supply, target, [[0 if i == j else 1 for j in range(len(target))] for i in range(old)])
    new, room = {}, target[:]
    for s in sorted(by_shard):
        legs = flow[s][:]
        for size, b in sorted(by_shard[s], reverse=True):
            fits = [j for j in range(len(legs)) if legs[j] >= size]
            j = max(fits, key=lambda j: (legs[j], -j)) if fits else -1
            if j >= 0:
                legs[j] -= size
                room[j] -= size
                new[s, b] = j
    for size, s, b in sorted(((size, s, b) for (s, b), size in blocks.items() if (s, b) not in new), reverse=True):
        j = max(range(len(room)), key=lambda j: (room[j] - size >= 0 and j == s, room[j], -j))
        room[j] -= size
        new[s, b] = j
    members = defaultdict(dict)
    for (s, b), j in new.items():
        members[j][s, b] = blocks[s, b]
    for _ in range(len(blocks)):
        low, high = max(range(len(room)), key=lambda j: (room[j], -j)), min(range(len(room)), key=lambda j: (room[j], j))
        gap = room[low] - room[high]
        best = min(((abs(gap - 2 * size), k) for k, size in members[high].items() if 0 < size < gap), default=None)
        if best is None or gap <= 1:
            break
        k = best[1]
        size = members[high].pop(k)
        members[low][k] = size
        room[high] += size
        room[low] -= size
        new[k] = low
    return new


def reshard(docs: DataFrame, old_shard: Column, old: int, capacities: list[int], id_col: str = "doc_id", text_col: str = "text", blocks: int = BLOCKS) -> DataFrame:
    """``id_col``, size (UTF-8 bytes + 1), text_crc32, old_shard, shard, slot for every row.

    ``old_shard``: an int from 0 to ``old`` - 1 for every row. Null texts have size 1 and the crc32 of nothing.
    Slots run from 0 without a gap in each shard; equal rows get slots of their own; an empty table gives an
    empty result. A document larger than a shard's share stays whole. Null ids are dealt by their texts.
    """
    spark = docs.sparkSession
    text = text_or_empty(text_col)
    rows = stage(
        docs.select(
            F.col(id_col).alias("_id"),
            (F.octet_length(text) + 1).cast("long").alias("_size"),
            F.crc32(text.cast("binary")).alias("_crc"),
            old_shard.cast("int").alias("_old"),
            F.pmod(F.xxhash64(F.col(id_col), F.octet_length(text), F.crc32(text.cast("binary"))), F.lit(max(1, blocks // old))).cast("int").alias("_block"),
        ),
        "shard-rows",
    )
    found = rows.groupBy("_old", "_block").agg(F.sum("_size").alias("b"), F.count(F.lit(1)).alias("n")).collect()  # <= blocks rows
    sizes = {(r["_old"], r["_block"]): r["b"] for r in found}
    counts = {(r["_old"], r["_block"]): r["n"] for r in found}
    new = plan_blocks(sizes, old, capacities) if sizes else {}
    at: dict[int, int] = defaultdict(int)
    places = []
    for k in sorted(new):
        places.append((*k, new[k], at[new[k]]))
        at[new[k]] += counts[k]
    table = spark.createDataFrame(places, "_old int, _block int, shard int, _first long")
    within = Window.partitionBy("_old", "_block").orderBy("_id", "_size", "_crc")
    return (
        rows.withColumn("_n", F.row_number().over(within))
        .join(F.broadcast(table), ["_old", "_block"])
        .select(
            F.col("_id").alias(id_col),
            F.col("_size").alias("size"),
            F.col("_crc").alias("text_crc32"),
            F.col("_old").alias("old_shard"),
            "shard",
            (F.col("_first") + F.col("_n") - 1).alias("slot"),
        )
    )


def rewrite(spark: SparkSession, docs: DataFrame, plan: DataFrame, out_dir: str, id_col: str = "doc_id", text_col: str = "text") -> list[int]:
    """Writes the shards that gain or lose a document under ``out_dir``/shard=<n>; returns their numbers.

    Unaffected shards keep their files; a shard that ends empty loses its folder. ``docs`` may be read from
    ``out_dir``: new files are complete beside it before old ones go. Rows of ``docs`` and ``plan`` are matched by id,
    size and crc32 of the text, equal ones one to one in any order, so null and repeated ids are written once each. A
    column of ``docs`` named shard is left out, as the folder takes its place. Without a change nothing is written.
    """
    changed = plan.filter("shard <> old_shard")
    ends = changed.select("shard").union(changed.select("old_shard")).distinct()
    touched = sorted(r[0] for r in ends.collect())
    if not touched:
        return touched
    part = plan.select(F.col(id_col).alias("_id"), F.col("size").alias("_size"), F.col("text_crc32").alias("_crc"), F.col("shard").alias("_shard"))
    part = part.withColumn("_k", F.row_number().over(Window.partitionBy("_id", "_size", "_crc").orderBy("_shard"))).filter(F.col("_shard").isin(touched))
    text = text_or_empty(text_col)
    rows = docs.drop("shard").withColumns({"_s": (F.octet_length(text) + 1).cast("long"), "_c": F.crc32(text.cast("binary"))})
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy(id_col, "_s", "_c").orderBy(F.lit(1))))
    same = rows[id_col].eqNullSafe(part["_id"]) & (F.col("_s") == F.col("_size")) & (F.col("_c") == F.col("_crc")) & (F.col("_n") == F.col("_k"))
    moved = rows.join(part, same).drop("_s", "_c", "_n", "_id", "_size", "_crc", "_k").withColumnRenamed("_shard", "shard")
    fresh = f"{out_dir.rstrip('/')}/_new-{uuid.uuid4().hex}"
    moved.repartition("shard", F.pmod(F.xxhash64(id_col), F.lit(64))).write.partitionBy("shard").parquet(fresh)
    path = lambda name: spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    fs = path(fresh).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for n in touched:
        fs.delete(path(f"{out_dir.rstrip('/')}/shard={n}"), True)
        if fs.exists(path(f"{fresh}/shard={n}")):
            fs.rename(path(f"{fresh}/shard={n}"), path(f"{out_dir.rstrip('/')}/shard={n}"))
    fs.delete(path(fresh), True)
    return touched
