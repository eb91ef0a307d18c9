"""Minimum-cost-flow resharding.

Every row lies in an old shard, which is a column (or the partition column of a folder). A text's home is the old shard that holds
most bytes of its copies. Homes, with the bytes of their texts, and the new shards, with equal capacities, are the two sides of
a flow network whose arcs cost the bytes they move (0 for staying); the cheapest flow says how much each home sends to each
new shard. Within a home the texts stand in the order of their hash, and the flow cuts that order into one range for each new
shard, each text going where its middle lies: sums by leading bits of the hash find the block of a cut, a prefix sum within
that block the hash. Copies that exceed 1/1024 of all bytes or rows, and single texts beyond a quarter of a shard, go first, as units, each
where its home sends enough (or else where most room is left), and the flow is solved anew for the rest.

Equal texts stay together unless their copies exceed the bytes of a shard; such copies are dealt by the hash of doc_id and place
to units of a quarter of a shard. Sums of blocks, at most BLOCKS, and of units, at most 2 * HOT_PARTS, reach the driver, and
cuts, of which each home has less than there are shards.

A null text is a text of its own, of 1 byte; repeated rows and equal texts lie side by side, ordered by doc_id. An empty table
gives an empty result. Only doc_id and text are read, and the column of the old shard where one is given.
"""

from __future__ import annotations

import heapq
import json
from bisect import bisect_right
from collections import defaultdict
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, whole_row

BLOCKS = 16384
#: Copies of a text beyond this part of all bytes or rows are a unit of their own; its rows are numbered in this times FINER parts for all.
HOT_PARTS = 1024
FINER = 4
OLD_SHARDS = 12
NEW_SHARDS = 16


def min_cost_flow(supply: list[int], capacity: list[int], cost: list[list[int]]) -> list[list[int]]:
    """flow[i][j] that sends all supply within capacity at the least total cost. Successive shortest paths on a bipartite graph."""
    n, m = len(supply), len(capacity)
    if sum(supply) > sum(capacity):
        raise ValueError("more supply than capacity")
    source, sink = n + m, n + m + 1
    head: list[list[int]] = [[] for _ in range(n + m + 2)]
    to, room, price = [], [], []

    def arc(a: int, b: int, cap: int, c: int) -> int:
        for x, y, k, p in ((a, b, cap, c), (b, a, 0, -c)):
            head[x].append(len(to))
            to.append(y)
            room.append(k)
            price.append(p)
        return len(to) - 2

    for i, s in enumerate(supply):
        arc(source, i, s, 0)
    arcs = [[arc(i, n + j, supply[i], cost[i][j]) for j in range(m)] for i in range(n)]
    for j, c in enumerate(capacity):
        arc(n + j, sink, c, 0)
    potential = [0] * (n + m + 2)  # all costs are at least 0 at first
    while True:
        far = [None] * (n + m + 2)
        via = [-1] * (n + m + 2)
        far[source], queue = 0, [(0, source)]
        while queue:
            d, x = heapq.heappop(queue)
            if d > far[x]:
                continue
            for e in head[x]:
                if room[e] and (far[y := to[e]] is None or d + price[e] + potential[x] - potential[y] < far[y]):
                    far[y], via[y] = d + price[e] + potential[x] - potential[y], e
                    heapq.heappush(queue, (far[y], y))
        if far[sink] is None:
            break
        potential = [p + (f if f is not None else 0) for p, f in zip(potential, far, strict=True)]
        path, x = [], sink
        while x != source:
            path.append(via[x])
            x = to[via[x] ^ 1]
        push = min(room[e] for e in path)
        for e in path:
            room[e] -= push
            room[e ^ 1] += push
    return [[room[e ^ 1] for e in row] for row in arcs]


def levelled(used: list[int], more: int) -> list[int]:
    """How much of ``more`` goes to each shard so that they end as near equal as what they hold allows; whole bytes."""
    order = sorted(range(len(used)), key=lambda j: (used[j], j))
    held, k = 0, 0
    while k < len(order) and (k == 0 or used[order[k]] * k <= held + more):
        held += used[order[k]]
        k += 1
    level, odd = divmod(held + more, k)
    room = [0] * len(used)
    for n, j in enumerate(order[:k]):
        room[j] = level + (n < odd) - used[j]
    return room


def send(supply: list[int], used: list[int], homes: list[int]) -> list[list[int]]:
    """The cheapest flow of the supply of the homes to shards that hold ``used`` already; a home that is a shard keeps for nothing."""
    return min_cost_flow(supply, levelled(used, sum(supply)), [[int(i != j) for j in range(len(used))] for i in homes])


def transfers(units: list[tuple[int, int]], blocks: dict[int, int], new: int) -> tuple[list[int], dict[int, list[tuple[int, int]]]]:
    """The shard of each unit (home, bytes), and for each home of blocks (home: bytes) what it sends: (shard, bytes), its own shard first."""
    homes = sorted({i for i, _ in units} | set(blocks))
    at = {i: k for k, i in enumerate(homes)}
    supply = [blocks.get(i, 0) for i in homes]
    for i, size in units:
        supply[at[i]] += size
    used, to = [0] * new, [0] * len(units)
    flow = send(supply, used, homes)
    for u in sorted(range(len(units)), key=lambda u: (-units[u][1], u)):
        i, size = units[u]
        sent = flow[at[i]]
        j = max(range(new), key=lambda j: (sent[j], j == i, -j))
        enough = sent[j] >= size
        if not enough:
            room = levelled(used, sum(supply))
            j = max(range(new), key=lambda j: (min(room[j], size), sent[j], -j))
            if 0 <= i < new and 16 * min(room[i], size) >= 15 * min(room[j], size):  # nearly as much room where it lies
                j = i
        to[u] = j
        used[j] += size
        supply[at[i]] -= size
        if enough:
            sent[j] -= size
        else:
            flow = send(supply, used, homes)
    flow = send(supply, used, homes)
    return to, {i: sorted(((j, n) for j, n in enumerate(flow[at[i]]) if n), key=lambda x: (x[0] != i, x[0])) for i in blocks}


def text_hash() -> Column:
    return F.xxhash64(F.col("text").isNull(), F.coalesce(F.col("text"), F.lit("")))


def lies(old: Column | None) -> Column:
    """The old shard: by the hash of the text, or a column; -1 where that is null."""
    return F.pmod(text_hash(), F.lit(OLD_SHARDS)).cast("int") if old is None else F.coalesce(old.cast("int"), F.lit(-1))


def keyed(docs: DataFrame, old: Column | None = None) -> DataFrame:
    """doc_id, size, text_crc32, the hash of the text (h), the old shard, and a number of the row by its place."""
    text = F.coalesce(F.col("text"), F.lit(""))
    h = text_hash()
    return docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        h.alias("h"),
        lies(old).alias("old_shard"),
        F.monotonically_increasing_id().alias("place"),
    )


class Plan:
    """Where everything goes: tables of a bounded size, all broadcast, but ``stray`` (home by h, of texts that lie in several old shards)."""

    def __init__(self, keys: DataFrame, old: int, new: int):
        spark = self.spark = keys.sparkSession
        self.bits = max(1, BLOCKS // max(old, 1)).bit_length() - 1
        parts = keys.groupBy("h", "old_shard").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"))
        home = F.max(F.struct("bytes", (-F.col("old_shard")).alias("o")))["o"]
        groups = cut(parts.groupBy("h").agg((-home).alias("home"), F.count("*").alias("spread"), F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes")), "groups")
        rows, total, spread = groups.agg(F.coalesce(F.sum("rows"), F.lit(0)), F.coalesce(F.sum("bytes"), F.lit(0)), F.max("spread")).first()
        share = F.greatest(F.col("bytes") / max(total, 1), F.col("rows") / max(rows, 1))
        many = groups.filter((F.col("rows") > 1) & (share * HOT_PARTS > 1) | (F.col("bytes") * (FINER * new) > total)).select("h", "home", "bytes", F.ceil(share * HOT_PARTS * FINER).cast("int"), "rows").collect()
        capacity = max(1, total // new)
        numbered = [(h, i, 1 if size <= capacity or n == 1 else -(-size * FINER // capacity), fine) for h, i, size, fine, n in sorted(tuple(r) for r in many)]
        self.hot = F.broadcast(spark.createDataFrame(numbered, "h long, hot_home int, parts int, fine int"))
        dealt = keys.join(self.hot.filter("parts > 1"), "h").groupBy("h", self.part().alias("part"), "hot_home").agg(F.sum("size"))
        whole = [((h, 0), (i, size)) for (h, i, n, _), size in zip(numbered, (x[2] for x in sorted(tuple(r) for r in many)), strict=True) if n == 1]
        found = sorted(whole + ([((h, k), (i, size)) for h, k, i, size in dealt.collect()] if len(whole) < len(numbered) else []))
        hot, units = [x[0] for x in found], [x[1] for x in found]
        few = groups.join(self.hot, "h", "left_anti").withColumn("block", self.block())
        sums: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for i, b, size in few.groupBy("home", "block").agg(F.sum("bytes")).collect():
            sums[i].append((b, size))
        to, sent = transfers(units, {i: sum(s for _, s in x) for i, x in sums.items()}, new)
        self.units = F.broadcast(spark.createDataFrame([(*x, j) for x, j in zip(hot, to, strict=True)], "h long, part int, unit_shard int"))
        self.ranges = F.broadcast(spark.createDataFrame(self._ranges(few, sums, sent), "home int, low long, high long, range_shard int"))
        self.stray = groups.filter("spread > 1").select("h", "home") if (spread or 0) > 1 else None

    @staticmethod
    def part() -> Column:
        return F.pmod(F.xxhash64("doc_id", "place"), "parts").cast("int")

    def block(self) -> Column:
        return F.shiftright("h", 64 - self.bits) if self.bits else F.lit(0).cast("long")

    def _ranges(self, few: DataFrame, sums: dict, sent: dict) -> list[tuple[int, int, int, int]]:
        """For each home the ranges of hashes and their shards. Only blocks in which a cut lies are looked into."""
        spots, cuts = [], {}  # of a cut: home, number, block, bytes of the block before it
        for i, x in sums.items():
            x.sort()
            ends = list(accumulate(s for _, s in x))
            for k, edge in enumerate(list(accumulate(n for _, n in sent[i]))[:-1]):
                b = bisect_right(ends, edge)  # sent bytes are all of the sum, so an edge lies in a block
                spots.append((i, k, x[b][0], edge - (ends[b] - x[b][1])))
        if spots:
            spread = F.broadcast(self.spark.createDataFrame(spots, "home int, k int, block long, edge long"))
            inside = Window.partitionBy("home", "block").orderBy("h").rowsBetween(Window.unboundedPreceding, 0)
            blocks = few.join(spread.select("home", "block").distinct(), ["home", "block"], "left_semi").withColumn("upto", F.sum("bytes").over(inside))
            beyond = blocks.join(spread, ["home", "block"]).filter(2 * F.col("upto") - F.col("bytes") >= 2 * F.col("edge"))
            cuts = {(i, k): h for i, k, h in beyond.groupBy("home", "k").agg(F.min("h")).collect()}
        out, last = [], (1 << 63) - 1
        for i, k, b, _ in spots:  # where no text of the block lies beyond the cut, it is at the block's end
            cuts.setdefault((i, k), min(last, ((b + 1) << (64 - self.bits)) if self.bits else last))
        for i, x in sent.items():
            edges = [-(1 << 63), *(cuts[i, k] for k in range(len(x) - 1))]
            out += [(i, a, (edges[k + 1] - 1 if k + 1 < len(x) else last), j) for k, ((j, _), a) in enumerate(zip(x, edges, strict=True))]
        return [r for r in out if r[1] <= r[2]]

    def place(self, rows: DataFrame) -> DataFrame:
        """rows (doc_id, h, old_shard, place) with shard, and first, second: what rows of a bounded number share."""
        rows = rows.join(self.hot, "h", "left")
        home = F.coalesce("hot_home", "old_shard")
        if self.stray is not None:
            rows = rows.join(self.stray.withColumnRenamed("home", "stray_home"), "h", "left")
            home = F.coalesce("hot_home", "stray_home", "old_shard")
        rows = rows.withColumn("home", home).withColumn("part", self.part())
        rows = rows.join(self.units, ["h", "part"], "left")
        rows = rows.join(self.ranges.withColumnRenamed("home", "of"), (F.col("of") == F.col("home")) & F.col("unit_shard").isNull() & F.col("h").between(F.col("low"), F.col("high")), "left")
        own = F.col("unit_shard").isNotNull()
        return rows.withColumns(
            {
                "new_shard": F.coalesce("unit_shard", "range_shard"),
                "first": F.when(own, F.col("h")).otherwise(F.col("home").cast("long")),
                "second": F.when(own, F.pmod(F.xxhash64("doc_id", "place"), "fine").cast("long")).otherwise(self.block()),
            }
        )


def reshard(docs: DataFrame, old: Column | None = None, old_shards: int = OLD_SHARDS, new: int = NEW_SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, old_shard, shard, slot for every row of docs. old: the old shard; if none, texts are taken to lie by their hash."""
    spark = docs.sparkSession
    keys = cut(keyed(docs, old), "keys")
    rows = Plan(keys, old_shards, new).place(keys).withColumnRenamed("new_shard", "shard")
    at, starts = [0] * new, []
    for s, a, b, n in sorted(tuple(r) for r in rows.groupBy("shard", "first", "second").agg(F.count("*")).collect()):
        starts.append((s, a, b, at[s]))
        at[s] += n
    begin = F.broadcast(spark.createDataFrame(starts, "shard int, first long, second long, start long"))
    inside = Window.partitionBy("shard", "first", "second").orderBy("h", "doc_id", "place")
    ranked = rows.withColumn("rank", F.row_number().over(inside) - 1).join(begin, ["shard", "first", "second"])
    return ranked.select("doc_id", "size", "text_crc32", "old_shard", "shard", (F.col("start") + F.col("rank")).cast("long").alias("slot"))


def assign(docs: DataFrame, old: Column | None = None, old_shards: int = OLD_SHARDS, new: int = NEW_SHARDS) -> DataFrame:
    """The columns of docs, old_shard and shard (in place of columns of these names). The texts are not shuffled, unless equal
    texts lie in several old shards."""
    plan = Plan(cut(keyed(docs, old), "keys"), old_shards, new)
    return _placed(docs, plan, old).select(*(f"row.`{c}`" for c in docs.columns if c.lower() not in ("old_shard", "shard")), "old_shard", F.col("new_shard").alias("shard"))


def _placed(docs: DataFrame, plan: Plan, old: Column | None) -> DataFrame:
    return plan.place(docs.select(whole_row(docs), "doc_id", text_hash().alias("h"), lies(old).alias("old_shard"), F.monotonically_increasing_id().alias("place")))


def rewrite_affected(spark: SparkSession, folder: str, new: int) -> tuple[list[int], int]:
    """Rewrite the shards under folder (shard=N) that gain or lose rows, and leave the others' files as they are.

    The old layout is what the files hold. Returns the rewritten shards and the bytes that moved. The new files are
    complete beside the folder, with a list of what to replace, before any old one goes; a run that ended in between is finished first,
    and what an unfinished one wrote is dropped.
    """
    finish(spark, folder)
    docs = spark.read.parquet(folder)
    names = [f"row.`{c}`" for c in docs.columns if c.lower() != "shard"]
    old = F.col("shard")
    keys = cut(keyed(docs, old), "keys")
    olds = (keys.agg(F.max("old_shard")).first()[0] or 0) + 1
    plan = Plan(keys, olds, new)
    moved = plan.place(keys).filter("old_shard <> new_shard").groupBy("old_shard", "new_shard").agg(F.sum("size").alias("bytes")).collect()
    touched = sorted({r.old_shard for r in moved} | {r.new_shard for r in moved})
    if touched:
        rows = _placed(docs, plan, old).filter(F.col("new_shard").isin(touched)).select(*names, F.col("new_shard").alias("shard"))
        beside = _beside(folder)
        rows.write.mode("overwrite").partitionBy("shard").parquet(beside)
        fs, path = _files(spark, beside)
        filled = [s for s in touched if fs.exists(path(f"{beside}/{_name(s)}"))]
        out = fs.create(path(f"{beside}/_plan.part"), True)
        out.write(bytearray(json.dumps({"touched": touched, "filled": filled}).encode()))
        out.close()
        fs.rename(path(f"{beside}/_plan.part"), path(f"{beside}/_plan"))
        finish(spark, folder)
    return touched, sum(r.bytes for r in moved)


def _name(shard: int) -> str:
    return f"shard={shard}" if shard >= 0 else "shard=__HIVE_DEFAULT_PARTITION__"


def _beside(folder: str) -> str:
    return f"{folder.rstrip('/')}-new"


def _files(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path
    return path(folder).getFileSystem(spark._jsc.hadoopConfiguration()), path


def finish(spark: SparkSession, folder: str) -> None:
    """Put the files that a rewrite has completed in place of the old ones. Each step may be done again."""
    beside = _beside(folder)
    fs, path = _files(spark, beside)
    if fs.exists(path(f"{beside}/_plan")):
        stream = fs.open(path(f"{beside}/_plan"))
        todo = json.loads(bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
        stream.close()
        fs.mkdirs(path(folder))
        for s in todo["touched"]:
            fresh, place = path(f"{beside}/{_name(s)}"), path(f"{folder}/{_name(s)}")
            if s not in todo["filled"]:
                fs.delete(place, True)
            elif fs.exists(fresh):
                fs.delete(place, True)
                fs.rename(fresh, place)
    fs.delete(path(beside), True)
