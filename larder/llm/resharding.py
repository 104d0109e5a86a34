"""Minimum-cost-flow resharding.

Given documents with their present shard, and the capacities of the new shards, a minimum-cost flow from old
shard sizes to new capacities says how many bytes go from where to where so that the fewest bytes move. The
flow is solved on the shard graph alone (old shards times new shards, never rows). Each old shard is then cut at
the flow's amounts: its rows have a fixed order (by a hash of the row's key, in blocks of about BLOCK_BYTES),
a distributed running sum gives every row its byte offset, and the offset falls into one of the shard's
intervals. The few rows that straddle a cut (at most one per cut) go where the largest deficit is left. Slots
are gapless row numbers made the same way from block totals. ``rewrite`` writes only the shards whose rows change.

The plan is made from keys and sizes alone; the rows themselves then cross the network once, dealt by block, and each
block is written into the few shards that its bytes belong to. Blocks grow in number with the bytes, so a shard that holds
a third of all rows has more blocks, not a larger task. Driver memory is bounded by the product of the shard counts.

Defined cases: a null text has size 16 and CRC 0; an empty table gives an empty plan; repeated rows are separate
rows with slots of their own (rows that differ have a fixed order, by key, id, size and checksum); a very long text is a
block that is larger by it; extra columns are kept by ``reshard`` unless they bear the plan's names.
"""

from __future__ import annotations

import heapq
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from larder.llm.common import cut_lineage, shared_dir

N_SHARDS, OLD_SHARDS, OVERHEAD = 40, 32, 16
BLOCK_BYTES = 16 << 20
#: Columns that the plan adds.
PLAN = ("old_shard", "size", "shard", "slot")


def min_cost_flow(supply: list[int], demand: list[int], cost) -> dict[tuple[int, int], int]:
    """Flow from sources to sinks at least cost, by successive shortest paths with potentials; sum(supply) <= sum(demand)."""
    n, m = len(supply), len(demand)
    source, sink, size = n + m, n + m + 1, n + m + 2
    graph: list[list[list]] = [[] for _ in range(size)]

    def edge(a: int, b: int, cap: int, price: int) -> None:
        graph[a].append([b, cap, price, len(graph[b])])
        graph[b].append([a, 0, -price, len(graph[a]) - 1])

    for i, s in enumerate(supply):
        edge(source, i, s, 0)
        for j in range(m):
            edge(i, n + j, s, cost(i, j))
    for j, d in enumerate(demand):
        edge(n + j, sink, d, 0)
    left, potential = sum(supply), [0] * size
    while left:
        far, back = [float("inf")] * size, [None] * size
        far[source] = 0
        queue = [(0, source)]
        while queue:
            d, a = heapq.heappop(queue)
            if d > far[a]:
                continue
            for k, (b, cap, price, _) in enumerate(graph[a]):
                if cap and (via := d + price + potential[a] - potential[b]) < far[b]:
                    far[b], back[b] = via, (a, k)
                    heapq.heappush(queue, (via, b))
        if back[sink] is None:
            raise ValueError("the capacities are too small")
        potential = [p + (f if f < float("inf") else 0) for p, f in zip(potential, far, strict=True)]
        amount, at = left, sink
        while at != source:
            a, k = back[at]
            amount, at = min(amount, graph[a][k][1]), a
        at = sink
        while at != source:
            a, k = back[at]
            graph[a][k][1] -= amount
            graph[at][graph[a][k][3]][1] += amount
            at = a
        left -= amount
    return {(i, e[0] - n): graph[e[0]][e[3]][1] for i in range(n) for e in graph[i] if n <= e[0] < n + m and graph[e[0]][e[3]][1]}


def equal_capacities(total: int, n: int) -> list[int]:
    return [total // n + (j < total % n) for j in range(n)]


def cuts(flow: dict[tuple[int, int], int]) -> list[tuple[int, int, int, int]]:
    """(old shard, from byte, to byte, new shard): each old shard's own bytes first, then its transfers."""
    out = []
    for i in sorted({i for i, _ in flow}):
        at = 0
        for j in sorted((j for a, j in flow if a == i), key=lambda j: (j != i, j)):
            out.append((i, at, at + flow[i, j], j))
            at += flow[i, j]
    return out


def text_size(text_col: str = "text") -> Column:
    return F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + OVERHEAD


@dataclass(frozen=True)
class Layout:
    """Small tables that say where each row goes: blocks of each old shard, byte intervals, rows over a cut, and each block's start in bytes and rows."""

    n_blocks: DataFrame
    intervals: DataFrame
    settled: DataFrame
    blocks: DataFrame


def _dealt(rows: DataFrame, n_blocks: DataFrame, id_col: str) -> DataFrame:
    """rows with their block and the bytes before them in it."""
    key = F.xxhash64(F.col(id_col))
    blocked = rows.join(F.broadcast(n_blocks), "old_shard").withColumn("_block", F.pmod(key, F.col("_n_blocks"))).drop("_n_blocks")  # a row for each old shard
    order = Window.partitionBy("old_shard", "_block").orderBy(key, F.col(id_col), F.col("size"), F.col("_tie")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return blocked.withColumn("_in_block", F.sum("size").over(order) - F.col("size"))


def _assigned(rows: DataFrame, intervals: DataFrame, settled: DataFrame | None) -> DataFrame:
    """rows with the shard of the interval that their first byte falls into; those over a cut as settled."""
    rows = rows.withColumn("_lo_byte", F.col("_block_start") + F.col("_in_block")).drop("_block_start", "_in_block")
    rows = rows.join(F.broadcast(intervals), "old_shard").filter((F.col("_lo_byte") >= F.col("_lo")) & (F.col("_lo_byte") < F.col("_hi")))  # old times new shards
    if settled is None:
        return rows
    rows = rows.join(F.broadcast(settled), ["old_shard", "_lo_byte"], "left")  # at most one row for each cut
    return rows.withColumn("shard", F.coalesce("_settled", "_to_shard")).drop("_settled", "_to_shard", "_lo", "_hi")


def layout(rows: DataFrame, capacities: list[int] | None, n_shards: int, id_col: str) -> Layout:
    """The plan for rows (id, old_shard, size, _tie): the flow, its cuts, and the blocks' starts."""
    spark = rows.sparkSession
    sizes = {r["old_shard"]: r["bytes"] for r in rows.groupBy("old_shard").agg(F.sum("size").alias("bytes")).collect()}  # a row for each old shard
    olds = sorted(sizes)
    capacities = capacities or equal_capacities(sum(sizes.values()), n_shards)
    flow = min_cost_flow([sizes[i] for i in olds], capacities, lambda i, j: 0 if olds[i] == j else 1)
    plan = [(o, int(a), int(b), j) for o, a, b, j in cuts({(olds[i], j): f for (i, j), f in flow.items()})]
    intervals = spark.createDataFrame(plan or [(0, 0, 0, 0)], "old_shard int, _lo long, _hi long, _to_shard int")
    n_blocks = spark.createDataFrame([(o, max(1, -(-b // BLOCK_BYTES))) for o, b in sizes.items()] or [(0, 1)], "old_shard int, _n_blocks long")

    dealt = _dealt(rows, n_blocks, id_col)
    sums = dealt.groupBy("old_shard", "_block").agg(F.sum("size").alias("_bytes"))
    before = Window.partitionBy("old_shard").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut_lineage(sums.select("old_shard", "_block", F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_block_start")))
    placed = cut_lineage(_assigned(dealt.join(starts, ["old_shard", "_block"]), intervals, None).select("old_shard", "_block", "_lo_byte", "size", "_hi", "_to_shard", "_lo"))
    settled = spark.createDataFrame(_settle_straddlers(placed, capacities, len(plan)) or [(-1, -1, -1)], "old_shard int, _lo_byte long, _settled int")
    shards = placed.join(F.broadcast(settled), ["old_shard", "_lo_byte"], "left").withColumn("shard", F.coalesce("_settled", "_to_shard"))
    parts = shards.groupBy("shard", "old_shard", "_block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("old_shard", "_block").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_part_start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    per_block = parts.groupBy("old_shard", "_block").agg(F.map_from_entries(F.collect_list(F.struct("shard", "_part_start"))).alias("_part_starts"))
    return Layout(n_blocks, intervals, settled, cut_lineage(starts.join(per_block, ["old_shard", "_block"])))


def reshard(docs: DataFrame, old_shard: Column, size: Column, capacities: list[int] | None = None, n_shards: int = N_SHARDS, id_col: str = "doc_id", tie: Column | None = None) -> DataFrame:
    """Every row with old_shard, size, shard and slot; capacities in bytes (None: equal); tie orders rows of one id and size."""
    tie = F.lit(0) if tie is None else tie
    rows = docs.drop(*(c for c in PLAN if c != id_col)).withColumns({"old_shard": F.coalesce(old_shard.cast("int"), F.lit(0)), "size": size, "_tie": tie})
    plan = layout(rows.select(id_col, "old_shard", "size", "_tie"), capacities, n_shards, id_col)
    rows = _dealt(rows, plan.n_blocks, id_col).join(plan.blocks, ["old_shard", "_block"])
    rows = _assigned(rows, plan.intervals, plan.settled)
    in_part = Window.partitionBy("old_shard", "_block", "shard").orderBy("_lo_byte")
    rows = rows.withColumn("slot", (F.element_at("_part_starts", F.col("shard")) + F.row_number().over(in_part) - 1).cast("long"))
    return rows.drop("_part_starts", "_lo_byte", "_block", "_tie")


def _settle_straddlers(placed: DataFrame, capacities: list[int], n_cuts: int) -> list[tuple[int, int, int]]:
    """Rows over a cut, at most one for each cut, go to the shards that lack most bytes: (old shard, first byte, shard)."""
    over = F.col("_lo_byte") + F.col("size") > F.col("_hi")
    held = {r["_to_shard"]: r["bytes"] for r in placed.filter(~over).groupBy("_to_shard").agg(F.sum("size").alias("bytes")).collect()}
    loose = placed.filter(over).select("old_shard", "_lo_byte", "size").limit(n_cuts).collect()  # the limit is the bound itself
    missing = [(held.get(j, 0) - c, j) for j, c in enumerate(capacities)]
    heapq.heapify(missing)
    moved = []
    for r in sorted(loose, key=lambda r: (-r["size"], r["old_shard"], r["_lo_byte"])):
        have, j = heapq.heappop(missing)
        moved.append((r["old_shard"], r["_lo_byte"], j))
        heapq.heappush(missing, (have + r["size"], j))
    return moved


def moved_bytes(plan: DataFrame) -> DataFrame:
    """What goes from where to where."""
    return plan.filter("old_shard <> shard").groupBy("old_shard", "shard").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))


def rewrite(plan: DataFrame, path: str) -> list[int]:
    """Write the shards that gain or lose rows below path/shard=N, delete those that end empty and leave all others; returns their numbers.

    Every task writes the blocks it has into their shards, so a large shard is written by many tasks into many files.
    """
    pairs = {(r["old_shard"], r["shard"]) for r in plan.select("old_shard", "shard").distinct().collect()}  # at most old times new shards
    touched = sorted({s for a, b in pairs if a != b for s in (a, b)})
    plan.filter(F.col("shard").isin(touched)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(path)
    spark = plan.sparkSession
    for s in set(touched) - {b for _, b in pairs}:  # no row of the write replaces their files
        old = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/shard={s}")
        old.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(old, True)
    return touched


def old_layout(id_col: str = "doc_id") -> Column:
    """The layout before: OLD_SHARDS shards by a checksum of the key."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % OLD_SHARDS


def written(docs: DataFrame, n_shards: int = N_SHARDS) -> DataFrame:
    """Documents of OLD_SHARDS hash shards dealt to shards of near-equal bytes, written shard by shard to the shared folder and read back.

    The columns of docs and old_shard, size, slot and shard. The layout before has no files, so every shard is written.
    """
    plan = reshard(docs, old_layout(), text_size(), n_shards=n_shards, tie=F.crc32(F.coalesce("text", F.lit(""))))
    path = f"{shared_dir(docs.sparkSession)}/larder-shards-{uuid.uuid4()}"
    plan.write.partitionBy("shard").parquet(path)
    fields = [*(f for f in plan.schema if f.name != "shard"), plan.schema["shard"]]
    return docs.sparkSession.read.schema(StructType(fields)).parquet(path)


def sharded(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard and old_shard of every document, from its written shard."""
    rows = written(docs.select("doc_id", "text"))
    return rows.select("doc_id", text_size().alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard")
