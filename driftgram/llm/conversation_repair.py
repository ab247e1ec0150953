"""Conversations brought into the grammar (s?(ua)+)? at least cost (operator 12).

A conversation's turns are read in order; each is kept, given another role (user or assistant) or deleted,
and empty turns may be inserted anywhere. Costs: keep 0, rerole 3, delete 4, insert 3; a truncated turn that
isn't deleted costs 3 more, and blank and repeated turns must be deleted. The audit holds the cheapest
edits' initials in order; of equally cheap ones the least in ASCII.

Turns are put into a global order by a range partitioning, so that even one conversation of most turns is
spread over tasks, and cut into blocks of at most 128 turns. Blocks are dealt by hash, and a batch of them
goes through one recursive DuckDB query: each recursion advances all of its blocks by one turn and keeps,
for each grammar state, the least cost and audit (for a block inside a conversation: for each state that
it can be entered in). A second such query advances all conversations by one block. Equally cheap audits of
the same turns are never prefixes of each other (the longer one would hold inserts more), so keeping
the least for each state is enough.

The digest of a repaired conversation needs all of its text in order. Texts pass one task as a stream, a
turn at a time; only the audit is held whole, as it is one value of the result.

Edge cases: null roles and texts count as one space; a null conversation id is a conversation of its own;
turns are ordered by number (nulls first), then role and text, and rows that repeat a turn are that turn
again; roles other than those that begin with s, u or a (small letters) can't be kept; conversations without
turns have zeros, an empty audit and the digest of no text; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from hashlib import sha256

import duckdb
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Turns of a block, and turns (blocks' ways through) that one DuckDB query takes at a time.
BLOCK, BATCH = 128, 16_384
#: States: nothing yet, after the system's turn, after the user's, after the assistant's.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
FINE, BAD, CUT = 0, 1, 2  # of a turn: as it should be; must be deleted; truncated


def _inserts() -> list[tuple[int, int, int, str]]:
    """(state, state, cost, audit) of at most two inserted turns; more never pay."""
    out = [(s, s, 0, "") for s in range(4)]
    for _ in range(2):
        out += [(a, NEXT[b, r], cost + INSERT, audit + "I") for a, b, cost, audit in out for r in "ua" if (b, r) in NEXT]
    return sorted(set(out))


def _steps() -> list[tuple[int, str, int, int, int, str]]:
    """(state, role's initial or "x", turn's kind, state, cost, audit): the best ways past one turn."""
    best: dict[tuple, tuple[int, str]] = {}
    for a, b, cost, audit in _inserts():
        for initial in "suax":
            for kind in (FINE, BAD, CUT):
                more = TRUNCATED if kind == CUT else 0
                ways = [(b, DELETE, "D")]
                if kind != BAD:
                    ways += [(NEXT[b, initial], more, "K")] if (b, initial) in NEXT else []
                    ways += [(NEXT[b, r], REROLE + more, "R") for r in "ua" if (b, r) in NEXT]
                for to, price, letter in ways:
                    key, found = (a, initial, kind, to), (cost + price, audit + letter)
                    best[key] = min(best.get(key, found), found)
    return [(*key, *value) for key, value in sorted(best.items())]


#: (cost, audit) of ending in a state.
_ENDINGS = {s: min((c, t) for a, b, c, t in _inserts() if a == s and b in (START, ASSISTANT)) for s in range(4)}


def _connection() -> duckdb.DuckDBPyConnection:
    """A database in memory alone: batches are small, and nothing is written to a machine's own disk."""
    made = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
    made.execute("CREATE TABLE steps (state INTEGER, initial VARCHAR, kind INTEGER, next INTEGER, cost BIGINT, letters VARCHAR)")
    made.executemany("INSERT INTO steps VALUES (?, ?, ?, ?, ?, ?)", [list(s) for s in _steps()])
    return made


#: One recursion advances every block of ``turns`` (block_no, pos, initial, kind) by a turn.
_BLOCKS = """
WITH RECURSIVE way AS (
  SELECT block_no, e.state AS entry, e.state, 0 AS pos, {'cost': 0::BIGINT, 'audit': ''} AS best
  FROM (SELECT block_no, bool_or(head) AS head FROM turns GROUP BY block_no) JOIN (VALUES (0), (1), (2), (3)) e(state) ON e.state = 0 OR NOT head
  UNION ALL
  SELECT w.block_no, w.entry, s.next, w.pos + 1, min({'cost': w.best.cost + s.cost, 'audit': w.best.audit || s.letters})
  FROM way w JOIN turns t ON t.block_no = w.block_no AND t.pos = w.pos + 1
  JOIN steps s ON s.state = w.state AND s.initial = t.initial AND s.kind = t.kind
  GROUP BY w.block_no, w.entry, s.next, w.pos
)
SELECT n.conv_key, n.block, entry, state AS exit, best.cost AS cost, best.audit AS audit
FROM way JOIN (SELECT block_no, max(pos) AS pos, any_value(conv_key) AS conv_key, any_value(block) AS block FROM turns GROUP BY block_no) n
  ON way.block_no = n.block_no AND way.pos = n.pos
"""
_NUMBERED = """CREATE OR REPLACE TABLE turns AS SELECT conv_key, block, head, initial, kind, dense_rank() OVER (ORDER BY conv_key, block) AS block_no,
  row_number() OVER (PARTITION BY conv_key, block ORDER BY seq) AS pos FROM batch"""

#: One recursion advances every conversation of ``ways`` (conv_key, place, entry, exit, cost, audit) by a block, from ``front``.
_FOLD = """
WITH RECURSIVE so_far AS (
  SELECT conv_key, 0 AS place, state, {'cost': cost, 'audit': audit} AS best FROM front
  UNION ALL
  SELECT f.conv_key, f.place + 1, w.exit, min({'cost': f.best.cost + w.cost, 'audit': f.best.audit || w.audit})
  FROM so_far f JOIN ways w ON w.conv_key = f.conv_key AND w.place = f.place + 1 AND w.entry = f.state
  GROUP BY f.conv_key, w.exit, f.place
)
SELECT conv_key, state, best.cost AS cost, best.audit AS audit
FROM so_far JOIN (SELECT conv_key, max(place) AS place FROM ways GROUP BY conv_key) n USING (conv_key, place) ORDER BY conv_key
"""
_PLACED = "CREATE OR REPLACE TABLE ways AS SELECT conv_key, dense_rank() OVER (PARTITION BY conv_key ORDER BY block) AS place, entry, exit, cost, audit FROM batch"


def _whole(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], rows: int) -> Iterator[pa.Table]:
    """The sorted batches as tables of about ``rows`` rows that end where a group of equal ``keys`` ends."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) < rows:
            continue
        table = pa.Table.from_batches(held)
        columns = [table.column(k).to_pylist() for k in keys]
        cut = table.num_rows
        while cut and all(c[cut - 1] == c[-1] for c in columns):
            cut -= 1
        if cut:
            yield table.slice(0, cut)
            held = table.slice(cut).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held)


_WAYS = "conv_key string, block bigint, entry int, exit int, cost bigint, audit string"


def _block_ways(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    con = _connection()
    for table in _whole(batches, ("conv_key", "block"), rows):
        con.register("batch", table)
        con.execute(_NUMBERED)
        yield from _arrow(con.execute(_BLOCKS).fetchall(), _WAYS)
        con.unregister("batch")


def _arrow(rows: list[tuple], columns: str) -> Iterator[pa.RecordBatch]:
    kinds = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (c.split(" ") for c in columns.split(", "))])
    for at in range(0, len(rows), BATCH):
        part = rows[at : at + BATCH]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), schema.types, strict=True)], schema=schema)


_REPAIRS = "conv_key string, cost bigint, audit string"
Front = dict[int, tuple[int, str]]


def _ended(front: Front) -> tuple[int, str]:
    return min((cost + _ENDINGS[s][0], audit + _ENDINGS[s][1]) for s, (cost, audit) in front.items())


def _repairs(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The blocks' ways joined; a conversation of many blocks goes on from one batch to the next."""
    con, carried, front = _connection(), None, {}
    con.execute("CREATE TABLE front (conv_key VARCHAR, state INTEGER, cost BIGINT, audit VARCHAR)")
    for table in _whole(batches, ("conv_key", "block"), rows):
        con.register("batch", table)
        con.execute(_PLACED)
        con.execute("DELETE FROM front")
        con.execute("INSERT INTO front SELECT DISTINCT conv_key, 0, 0, '' FROM ways WHERE conv_key IS DISTINCT FROM ?", [carried])
        if front:
            con.executemany("INSERT INTO front VALUES (?, ?, ?, ?)", [[carried, s, *best] for s, best in front.items()])
        fronts: dict[str, Front] = {}
        if carried is not None and table.column("conv_key")[0].as_py() != carried:
            fronts[carried] = front
        for key, state, cost, audit in con.execute(_FOLD).fetchall():
            fronts.setdefault(key, {})[state] = (cost, audit)
        con.unregister("batch")
        carried = table.column("conv_key")[-1].as_py()
        front = fronts.pop(carried)
        yield from _arrow([(k, *_ended(f)) for k, f in fronts.items()], _REPAIRS)
    if carried is not None:
        yield from _arrow([(carried, *_ended(front))], _REPAIRS)


def edited(audit: str, turns: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """The repaired turns (role, text), by the audit's letters."""
    state = START

    def wanted() -> str:
        return "assistant" if state == USER else "user"

    at = 0
    for role, text in turns:
        while audit[at] == "I":
            yield wanted(), ""
            state = NEXT[state, wanted()[0]]
            at += 1
        if audit[at] != "D":
            role = role if audit[at] == "K" else wanted()
            yield role, text
            state = NEXT[state, role[0]]
        at += 1
    for _ in audit[at:]:
        yield wanted(), ""
        state = NEXT[state, wanted()[0]]


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, str, Iterator[tuple[int | None, str, str]]]]:
    """(key, cost, audit, stream of its turns) of rows sorted by key and place, the audit first."""
    rows = (row for batch in common.slices(batches) for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    row = next(rows, None)
    while row is not None:
        key, _, _, _, _, cost, audit = row

        def turns(key=key):
            nonlocal row
            while (row := next(rows, None)) is not None and row[0] == key:
                yield row[2], row[3], row[4]

        stream = turns()
        yield key, cost, audit, stream
        for _ in stream:
            pass


_RESULT = "conv_key string, gaps bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = []
    for key, cost, audit, stream in _conversations(batches):
        seen = {"least": None, "most": None, "distinct": 0, "illegal": 0, "initial": None}

        def watched(stream=stream, seen=seen):
            for turn, role, text in stream:
                if turn is not None and turn != seen["most"]:
                    seen["least"] = turn if seen["least"] is None else seen["least"]
                    seen["most"], seen["distinct"] = turn, seen["distinct"] + 1
                seen["illegal"] += seen["initial"] is not None and seen["initial"] + role[:1] not in ("su", "ua", "au")
                seen["initial"] = role[:1]
                yield role, text

        digest, between = sha256(), b""
        for role, text in edited(audit, watched()):
            digest.update(between + f"{role}:{text}".encode())
            between = b"\n"
        gaps = 0 if seen["most"] is None else seen["most"] - seen["least"] + 1 - seen["distinct"]
        out.append((key, gaps, seen["illegal"], cost, audit, digest.hexdigest()))
        if len(out) == 1024:
            yield from _arrow(out, _RESULT)
            out = []
    yield from _arrow(out, _RESULT)


_TURNS = "conv_key string, position bigint, role string, text string"


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = []
    for key, _, audit, stream in _conversations(batches):
        for position, (role, text) in enumerate(edited(audit, ((role, text) for _, role, text in stream))):
            out.append((key, position, role, text))
            if len(out) == 1024:
                yield from _arrow(out, _TURNS)
                out = []
    yield from _arrow(out, _TURNS)


def _key(conv_id: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), conv_id.cast("string")), F.lit("null"))


class Repair:
    """The repair of ``turns`` (conv_id, turn, role, text). Tables that its results read are written to the shared folder."""

    def __init__(self, turns: DataFrame, block: int = BLOCK, batch: int = BATCH):
        rows = turns.select(_key(turns["conv_id"]).alias("conv_key"), F.col("turn").cast("long").alias("turn"), *(F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")))
        order = ["conv_key", "turn", "role", "text", "copy"]  # copies of a turn part, too: no range grows with them
        placed = rows.withColumn("copy", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order).drop("copy")
        self.ordered, _ = common.stored(placed.withColumn("seq", F.monotonically_increasing_id()), "turns")
        self.faults, _ = common.stored(_faults(self.ordered, block), "faults")
        ways = self.faults.repartition("conv_key", "block").sortWithinPartitions("conv_key", "block", "seq").mapInArrow(partial(_block_ways, rows=batch), _WAYS)
        joined = ways.repartition("conv_key").sortWithinPartitions("conv_key", "block").mapInArrow(partial(_repairs, rows=batch), _REPAIRS)
        self.audits, _ = common.stored(joined, "audits")

    def _walked(self, over, columns: str) -> DataFrame:
        none = lambda kind, name: F.lit(None).cast(kind).alias(name)
        audits = self.audits.select("conv_key", F.lit(-1).cast("long").alias("seq"), none("long", "turn"), none("string", "role"), none("string", "text"), "cost", "audit")
        turns = self.ordered.select("conv_key", "seq", "turn", "role", "text", none("long", "cost"), none("string", "audit"))
        return audits.union(turns).repartition("conv_key").sortWithinPartitions("conv_key", "seq").mapInArrow(over, columns)

    def turns(self) -> DataFrame:
        """(conv_key, position, role, text): the repaired conversations."""
        return self._walked(_edits, _TURNS)

    def summary(self) -> DataFrame:
        """(conv_key, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of conversations with turns."""
        counts = self.faults.groupBy("conv_key").agg(*(F.count_if(F.col("fault") == name).alias(name) for name in ("blank", "duplicate", "truncated")))
        return self._walked(_digests, _RESULT).join(counts, "conv_key")


def _faults(ordered: DataFrame, block: int) -> DataFrame:
    """Each turn's first fault, by its place alone: equal turns of a conversation are found by role and a strong digest
    of the text, and only the least place of each is passed on, so copies meet nowhere."""
    initial, shown = F.substring("role", 1, 1), F.col("text").rlike(common.WORD)
    ends = F.col("text").rlike(rf"[.!?]{common.SPACE}*\z")
    narrow = ordered.select("conv_key", "seq", initial.alias("initial"), shown.alias("shown"), ends.alias("ends"))
    first = ordered.groupBy("conv_key", F.sha2(F.to_json(F.struct("role", "text")), 256).alias("same")).agg(F.min("seq").alias("seq"))
    heads = first.groupBy("conv_key").agg(F.min("seq").alias("seq")).select("seq", F.lit(True).alias("head"))
    marks = first.select("seq", F.lit(False).alias("head")).union(heads).groupBy("seq").agg(F.max("head").alias("head"))
    rows = narrow.join(marks, "seq", "left")
    fault = F.when(~F.col("shown"), "blank").when(F.col("head").isNull(), "duplicate").when(~F.col("ends"), "truncated")
    kind = F.when(F.col("fault").isNull(), FINE).when(F.col("fault") == "truncated", CUT).otherwise(BAD)
    known = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("x")
    return rows.withColumn("fault", fault).select("conv_key", "seq", F.floor(F.col("seq") / block).alias("block"), known.alias("initial"), kind.alias("kind"), F.coalesce("head", F.lit(False)).alias("head"), "fault")


def repair(turns: DataFrame, conversations: DataFrame | None = None, block: int = BLOCK, batch: int = BATCH) -> DataFrame:
    """The summary of every conversation of ``conversations`` (conv_id; by default those of ``turns``)."""
    ids = (turns if conversations is None else conversations).select("conv_id").distinct()
    found = Repair(turns, block, batch).summary()
    rows = ids.withColumn("conv_key", _key(F.col("conv_id"))).join(found, "conv_key", "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return rows.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(sha256().hexdigest())).alias("repaired_sha256"))


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with a quarter of the turns damaged in five ways, chosen by the turn's checksum."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    chance = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(F.col("chance") == 1, "").when(F.col("chance") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    told = rows.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), chance.alias("chance")).where("chance <> 0")
    times = F.when(F.col("chance") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return told.select("conv_id", "turn", F.when(F.col("chance") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(times).alias("time")).drop("time")


def query(spark, sf_dir: str) -> DataFrame:
    rows = common.table(spark, sf_dir, "conversations")
    return repair(damaged(rows), rows)


_CRC_STEP = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, w: xor(v >> 1, 3988292384 * (v & 1)))"
_CRC = f"xor(list_reduce(list_prepend(4294967295, list_transform(string_split(k, ''), lambda z: ord(z)::BIGINT)), lambda c, b: {_CRC_STEP}), 4294967295)"
SQL = f"""
WITH RECURSIVE
src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
hit AS (SELECT *, {_CRC} % 20 AS x FROM src),
dam AS (SELECT conv_id, turn, CASE WHEN x = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN x = 1 THEN '' WHEN x = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN x = 3 THEN [1, 2] ELSE [1] END) AS time
  FROM hit WHERE x <> 0),
pos AS (SELECT *, row_number() OVER w AS i, lag(role) OVER w AS before, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, time) AS nth
  FROM dam WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, time)),
flt AS MATERIALIZED (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank' WHEN nth > 1 THEN 'duplicate'
    WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 'truncated' END AS fault FROM pos),
edge(a, r, b) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
named(r, role) AS (VALUES ('u', 'user'), ('a', 'assistant')),
one AS (SELECT a, b, role || ':' AS line FROM edge JOIN named USING (r)),
pre AS MATERIALIZED (SELECT s AS a, s AS b, 0 AS cost, '' AS audit, []::VARCHAR[] AS lines FROM range(4) t(s) UNION ALL SELECT a, b, 3, 'I', [line] FROM one
  UNION ALL SELECT x.a, y.b, 6, 'II', [x.line, y.line] FROM one x JOIN one y ON x.b = y.a),
act(a, letter, price, r, b, role) AS MATERIALIZED (SELECT s, 'D', 4, NULL::VARCHAR, s, NULL::VARCHAR FROM range(4) t(s) UNION ALL SELECT a, 'K', 0, r, b, NULL::VARCHAR FROM edge
  UNION ALL SELECT a, 'R', 3, NULL::VARCHAR, b, role FROM edge JOIN named USING (r)),
best AS (
  SELECT conv_id, 0::BIGINT AS i, 0::BIGINT AS s, {{'cost': 0::BIGINT, 'audit': '', 'lines': []::VARCHAR[]}} AS m FROM (SELECT DISTINCT conv_id FROM flt)
  UNION ALL
  SELECT x.conv_id, x.i + 1, act.b::BIGINT, min({{'cost': x.m.cost + p.cost + act.price + CASE WHEN act.letter <> 'D' AND t.fault = 'truncated' THEN 3 ELSE 0 END, 'audit': x.m.audit || p.audit || act.letter,
    'lines': x.m.lines || p.lines || CASE act.letter WHEN 'D' THEN []::VARCHAR[] ELSE [coalesce(act.role, t.role) || ':' || t.text] END}})
  FROM best x JOIN pre p ON p.a = x.s JOIN flt t ON t.conv_id IS NOT DISTINCT FROM x.conv_id AND t.i = x.i + 1
  JOIN act ON act.a = p.b AND (act.letter = 'D' OR coalesce(t.fault, '') NOT IN ('blank', 'duplicate') AND (act.letter = 'R' OR act.r = substr(t.role, 1, 1)))
  GROUP BY x.conv_id, x.i, act.b
),
done AS (SELECT x.conv_id, min({{'cost': x.m.cost + p.cost, 'audit': x.m.audit || p.audit, 'lines': x.m.lines || p.lines}}) AS m
  FROM best x JOIN (SELECT conv_id, max(i) AS i FROM flt GROUP BY conv_id) n ON n.conv_id IS NOT DISTINCT FROM x.conv_id AND n.i = x.i JOIN pre p ON p.a = x.s AND p.b IN (0, 3) GROUP BY x.conv_id),
told AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
  count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (i > 1 AND substr(before, 1, 1) || substr(role, 1, 1) NOT IN ('su', 'ua', 'au')) AS illegal FROM flt GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(d.m.cost, 0)::BIGINT AS cost, coalesce(d.m.audit, '') AS audit, sha256(coalesce(array_to_string(d.m.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN told t ON t.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN done d ON d.conv_id IS NOT DISTINCT FROM c.conv_id
"""
