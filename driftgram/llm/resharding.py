"""Minimum-cost-flow resharding (operator 5).

Given the bytes in each old shard and the capacity of each new one, a minimum-cost flow decides
how many bytes go from where to where; a byte that stays costs nothing. The flow's transfers are
cut out of each old shard as blocks: runs of documents in a fixed keyed order, first what stays,
then one run for each destination. So where a row goes follows from its old shard and its hash,
by a look-up among a few cut points, and :func:`rewrite` moves each text once, straight into its
new file.

Cutting between whole documents leaves shards uneven by the documents at the cuts. Documents are
therefore placed in two rounds, each with its own flow: those larger than a size S first, the
small ones then into the room that is left, so that only small documents are at the cuts that
count. S is the least power of two below which :data:`SMALL_SHARE` of all bytes lie. A new shard
ends within S / 2 for each run into it of its capacity, unless large documents overfill it alone.

A cut is found by descending through the order's bits, an aggregation over a histogram of 512
places a level: no task orders a shard, and the driver sees at most :data:`CELLS` sums a level.
Slots are the places of rows in the written files.

Edge cases: a null text has no bytes (size 1) and the checksum of empty text; repeated rows and
rows with null ids are placed like any other (equal rows share a hash; a group of them that holds
more than a 64th of a new shard is spread at random), each with a slot of its own; :func:`digest`
ignores extra columns and :func:`rewrite` writes all of them; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict, deque
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

SMALL_SHARE = 1 / 16
CELLS = 1 << 20
FILE_BYTES = 256 << 20
_BITS = 63
_LEVEL = 9


def min_cost_flow(supply: list[int], capacity: list[int], cost: list[list[int]]) -> list[list[int]]:
    """Flows[i][j] of least total cost that empties ``supply`` into ``capacity`` (successive shortest paths)."""
    n, m = len(supply), len(capacity)
    if sum(supply) > sum(capacity):
        raise ValueError("the capacities are too small")
    source, sink = n + m, n + m + 1
    graph: list[list[list[int]]] = [[] for _ in range(n + m + 2)]  # edge: to, left, cost, place of its reverse

    def edge(a: int, b: int, room: int, price: int) -> None:
        graph[a].append([b, room, price, len(graph[b])])
        graph[b].append([a, 0, -price, len(graph[a]) - 1])

    for i, amount in enumerate(supply):
        edge(source, i, amount, 0)
        for j in range(m):
            edge(i, n + j, amount, cost[i][j])
    for j, room in enumerate(capacity):
        edge(n + j, sink, room, 0)
    while True:
        far = [float("inf")] * len(graph)
        far[source] = 0
        by: list[tuple[int, int] | None] = [None] * len(graph)
        queue, queued = deque([source]), [False] * len(graph)
        while queue:
            a = queue.popleft()
            queued[a] = False
            for k, (b, room, price, _) in enumerate(graph[a]):
                if room > 0 and far[a] + price < far[b]:
                    far[b], by[b] = far[a] + price, (a, k)
                    if not queued[b]:
                        queue.append(b)
                        queued[b] = True
        if by[sink] is None:
            break
        path, at = [], sink
        while at != source:
            a, k = by[at]
            path.append(graph[a][k])
            at = a
        amount = min(e[1] for e in path)
        for e in path:
            e[1] -= amount
            graph[e[0]][e[3]][1] += amount
    return [[next(supply[i] - e[1] for e in graph[i] if e[0] == n + j) for j in range(m)] for i in range(n)]


def equal_capacities(total: int, shards: int) -> list[int]:
    return [total // shards + (j < total % shards) for j in range(shards)]


@dataclass(frozen=True)
class Run:
    """Bytes [start, end) of an old shard's order that go to ``shard``."""

    old: int
    shard: int
    start: int
    end: int


def runs(flows: list[list[int]]) -> list[Run]:
    out = []
    for i, row in enumerate(flows):
        at = 0
        for j in sorted(range(len(row)), key=lambda j: (j != i, j)):
            if row[j]:
                out.append(Run(i, j, at, at + row[j]))
                at += row[j]
    return out


@dataclass
class Cut:
    """A place wanted in the order of a group: ``at`` bytes from its beginning. ``below`` bytes come
    before the cell of hashes that begin with ``prefix`` (``bits`` of them); ``hash`` is the result."""

    group: int
    at: int
    prefix: int = 0
    bits: int = 0
    below: int = 0
    hash: int | None = None


def cut_points(items: DataFrame, wanted: list[tuple[int, int]]) -> list[int]:
    """For each (group, bytes) the hash at which rows (group int, h long, size long) are best cut:
    the bytes of the group's rows below it come nearest to those wanted."""
    spark = items.sparkSession
    cuts = [Cut(g, at) for g, at in wanted]
    while open_cuts := [c for c in cuts if c.hash is None]:
        out: dict[tuple[int, int, int], dict[int, tuple[int, int, int]]] = defaultdict(dict)
        by_bits = defaultdict(set)
        for c in open_cuts:
            by_bits[c.bits].add((c.group, c.prefix))
        for bits, cells in by_bits.items():
            table = sorted(cells)
            step = max(1, CELLS >> _LEVEL)  # a cell has at most 512 parts
            for at in range(0, len(table), step):
                asked = F.broadcast(spark.createDataFrame(table[at : at + step], "group int, prefix long"))
                prefixed = items.select("group", F.shiftright("h", _BITS - bits).alias("prefix") if bits else F.lit(0).cast("long").alias("prefix"), "h", "size").join(asked, ["group", "prefix"])
                part = F.shiftright("h", max(0, _BITS - bits - _LEVEL)).alias("part")
                for r in prefixed.groupBy("group", "prefix", part).agg(F.sum("size").alias("bytes"), F.min("h").alias("first"), F.max("h").alias("last")).collect():
                    out[r["group"], bits, r["prefix"]][r["part"]] = (r["bytes"], r["first"], r["last"])
        for c in open_cuts:
            cells, below = out[c.group, c.bits, c.prefix], c.below
            c.hash = 0  # an empty group
            for part in sorted(cells):
                held, first, last = cells[part]
                if below + held > c.at:
                    if first == last:  # equal rows, all before or all after the cut
                        c.hash = first + (c.at - below > below + held - c.at)
                    else:
                        c.hash, c.prefix, c.bits, c.below = None, part, c.bits + _LEVEL, below
                    break
                below, c.hash = below + held, last + 1
    return [c.hash for c in cuts]


@dataclass(frozen=True)
class Plan:
    """Where rows go: ``cuts[old, small]`` are the rising hashes at which runs end and ``shards`` theirs."""

    old_shards: int
    shards: int
    small: int
    cuts: dict[tuple[int, bool], list[int]]
    targets: dict[tuple[int, bool], list[int]]
    hot: list[int]
    moved: set[int]

    def hashed(self, docs: DataFrame) -> Column:
        """A row's place in the order of its shard; rows of the large equal groups are spread."""
        h = _order(docs)
        return F.when(h.isin(self.hot), F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 1)).otherwise(h) if self.hot else h

    def table(self, spark) -> DataFrame:
        rows = [(old, small, self.cuts[old, small], self.targets[old, small]) for old, small in sorted(self.cuts)]
        return spark.createDataFrame(rows or [(0, False, [], [0])], "old int, small boolean, cuts array<long>, targets array<int>")


def _size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def _order(docs: DataFrame) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*common.row_key(docs["doc_id"], docs["text"])), 1)


def plan(docs: DataFrame, old_shard: Column, old_shards: int, capacities: list[int] | int) -> Plan:
    """``capacities`` are bytes for each new shard, or a number of shards of equal size."""
    items = common.checkpointed(docs.select(_size(docs["text"]).alias("size"), _order(docs).alias("h"), old_shard.cast("int").alias("old")))
    power = F.when(F.col("size") == 1, 0).otherwise(F.length(F.bin(F.col("size") - 1))).alias("power")  # size <= 2 ** power
    held: dict[int, dict[int, int]] = defaultdict(lambda: defaultdict(int))  # bytes by power of two and old shard
    for r in items.groupBy(power, "old").agg(F.sum("size").alias("bytes")).collect():  # at most 32 rows a shard
        held[r["power"]][r["old"]] = r["bytes"]
    total = sum(sum(x.values()) for x in held.values())
    if isinstance(capacities, int):
        capacities = equal_capacities(total, capacities)
    shards = len(capacities)
    small_power, below = 0, 0
    for small_power in sorted(held):
        below += sum(held[small_power].values())
        if below >= SMALL_SHARE * total:
            break
    hot = [r["h"] for r in items.groupBy("h").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).where((F.col("n") > 1) & (F.col("bytes") > total / (64 * shards))).select("h").collect()]  # fewer than 64 a shard
    if hot:
        spread = F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 1)
        items = common.checkpointed(items.withColumn("h", F.when(F.col("h").isin(hot), spread).otherwise(F.col("h"))))
    rows = items.select((F.col("old") * 2 + (F.col("size") <= 1 << small_power).cast("int")).alias("group"), "h", "size")
    cost = [[int(i != j) for j in range(shards)] for i in range(old_shards)]

    cuts, targets, moved = {}, {}, set()
    got = [0] * shards
    for small in (False, True):
        supply = [sum(held[p][i] for p in list(held) if (p <= small_power) == small) for i in range(old_shards)]
        room = [max(0, c - g) for c, g in zip(capacities, got, strict=True)]
        share = _shared(sum(supply), room if small else capacities)
        planned = runs(min_cost_flow(supply, share, cost))
        ends = [(2 * r.old + small, r.end) for r in planned]
        inner = [k for k, r in enumerate(planned) if r.end < supply[r.old]]
        at = dict(zip(inner, cut_points(rows, [ends[k] for k in inner]), strict=True))
        for k, r in enumerate(planned):
            targets.setdefault((r.old, small), []).append(r.shard)
            if k in at:
                cuts.setdefault((r.old, small), []).append(at[k])
            else:
                cuts.setdefault((r.old, small), [])
            moved |= {r.old, r.shard} if r.old != r.shard else set()
        if not small:
            made = Plan(old_shards, shards, 1 << small_power, cuts, targets, [], moved)
            large = rows.where(F.col("group") % 2 == 0).select(F.shiftright("group", 1).alias("old"), F.lit(False).alias("small"), "h", "size")
            for r in _placed(large, made, "h").groupBy("shard").agg(F.sum("size").alias("bytes")).collect():
                got[r["shard"]] = r["bytes"]
    return Plan(old_shards, shards, 1 << small_power, cuts, targets, hot, moved)


def _shared(total: int, weights: list[int]) -> list[int]:
    """``total`` in parts that stand to each other as the weights (equal ones if all are zero)."""
    weights = weights if sum(weights) else [1] * len(weights)
    parts, before, at = [], 0, 0
    for w in weights:
        at += w
        now = total * at // sum(weights)
        parts.append(now - before)
        before = now
    return parts


def _placed(rows: DataFrame, made: Plan, h: str, shard: str = "shard", old: str = "old", small: str = "small") -> DataFrame:
    """``rows`` with ``shard``: a look-up among the cut points of (old, small), two rows an old shard."""
    cuts = made.table(rows.sparkSession)
    names = {c: common.unused(rows, c) for c in ("cuts", "targets")}
    cuts = cuts.withColumnsRenamed(names | {"old": old, "small": small})
    past = F.size(F.filter(names["cuts"], lambda c: c <= F.col(h)))
    return rows.join(F.broadcast(cuts), [old, small]).withColumn(shard, F.get(names["targets"], past)).drop(*names.values())


def folder_name(columns: list[str]) -> str:
    """What the shards' folders are named by: ``shard``, or longer where a column is called that in any case."""
    name = "shard"
    while name in {c.lower() for c in columns}:
        name += "_"
    return name


def rewrite(docs: DataFrame, old_shard: Column, made: Plan, path: str, all_shards: bool = False) -> set[int]:
    """Writes the shards that gain or lose rows (or all) as ``path``/shard=<n>, whose files' rows, in
    order of the files' names, are the shard's; returns the shards' numbers. Where ``docs`` has a column
    ``shard`` itself, that is kept and the folders' name is longer (:func:`folder_name`).

    Each file is one task's: its rows are those of a range of hashes in its shard, in order of
    hash. The texts are shuffled once.
    """
    affected = set(range(made.shards)) if all_shards else {s for s in made.moved if s < made.shards}
    row = {c: common.unused(docs, c) for c in ("old", "small", "h", "part")}
    shard, others = folder_name(docs.columns), docs.columns
    keyed = docs.withColumns({row["old"]: old_shard.cast("int"), row["small"]: _size(docs["text"]) <= made.small, row["h"]: made.hashed(docs)})
    rows = _placed(keyed, made, row["h"], shard, row["old"], row["small"]).where(F.col(shard).isin(sorted(affected)))
    held = docs.agg(F.coalesce(F.sum(_size(docs["text"])), F.lit(0))).first()[0]
    files = max(1, -(-held // (made.shards * FILE_BYTES)))
    part = F.least(F.floor(F.col(row["h"]) / (2.0**_BITS / files)), F.lit(files - 1))  # hashes are even over their range
    dealt = rows.withColumn(row["part"], (F.col(shard) * files + part).cast("int")).repartitionById(made.shards * files, F.col(row["part"]))
    order = [c for c in (row["part"], row["h"])]
    dealt.sortWithinPartitions(*order, *(c for c in ("doc_id",) if c in docs.columns)).select(*others, shard).write.partitionBy(shard).parquet(path)
    return affected


def slots(spark, path: str, columns: T.StructType) -> DataFrame:
    """The rows below ``path`` (``columns``, then the shard, named as :func:`folder_name` says) with ``slot``, the place in
    the shard's files as they lie there."""
    shard_name = folder_name(columns.names)
    back = spark.read.schema(T.StructType(columns.fields + [T.StructField(shard_name, T.IntegerType())])).parquet(path)
    name = F.col("_metadata.file_path")
    files = sorted((r["shard_no"], r["name"], r["n"]) for r in back.groupBy(F.col(shard_name).alias("shard_no"), name.alias("name")).agg(F.count("*").alias("n")).collect())  # a row a file
    before, offsets = defaultdict(int), []
    for shard, file, n in files:
        offsets.append((file, before[shard]))
        before[shard] += n
    at, file = common.unused(back, "before"), common.unused(back, "file")
    table = F.broadcast(spark.createDataFrame(offsets or [("", 0)], f"{file} string, {at} long"))
    place = common.unused(back, "place")
    rows = back.withColumns({file: name, place: F.col("_metadata.row_index")}).join(table, file)
    return rows.withColumn("slot", (F.col(at) + F.col(place)).cast("long")).drop(file, at, place)


OLD_SHARDS, NEW_SHARDS = 12, 16


def digest(docs: DataFrame) -> DataFrame:
    """The query's columns, read from the files written: rows lie in 12 shards by their id's checksum
    and go to 16 of equal bytes. (Nothing lies in files of the old shards, so all new ones are written.)"""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    old = common.fold_remainder(docs["doc_id"], OLD_SHARDS)
    path = common.new_path(spark, "shards")
    rewrite(docs, old, plan(docs, old, OLD_SHARDS, NEW_SHARDS), path, all_shards=True)
    out = slots(spark, path, docs.schema)
    return out.select(
        "doc_id", _size(out["text"]).alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"), common.fold_remainder(F.col("doc_id"), OLD_SHARDS).cast("int").alias("old_shard"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return digest(common.table(spark, sf_dir, "documents"))
