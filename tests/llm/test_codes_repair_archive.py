"""Vector codes, conversation repair and the WARC archive against plain Python."""

import base64
import gzip
import hashlib
import itertools
import math
import random
import re
import zlib
from glob import glob

import numpy as np
import pytest
from edge import CLASHING
from pyspark.sql import functions as F

from driftgram.llm import common, conversation_repair, vector_codes, warc_archive

# ---------------------------------------------------------------- vector codes


def plain_lloyd(vectors, s):
    """Codes, errors and codebooks of vectors (in order of id), with Python's integers alone."""
    x = [[math.floor(s.scale * float(c)) for c in v] for v in vectors]
    width = len(x[0]) // s.parts
    cut = lambda row, p: row[p * width : (p + 1) * width]
    books = [[cut(row, p) for row in x[: s.entries]] for p in range(s.parts)]
    apart = lambda a, b: sum((i - j) ** 2 for i, j in zip(a, b, strict=True))
    for number in range(s.rounds + 1):
        codes = [[min(range(len(books[p])), key=lambda e: (apart(cut(row, p), books[p][e]), e)) for p in range(s.parts)] for row in x]
        if number == s.rounds:
            break
        for p in range(s.parts):
            for e in range(len(books[p])):
                mine = [cut(row, p) for row, code in zip(x, codes, strict=True) if code[p] == e]
                if mine:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    errors = [sum(apart(cut(row, p), books[p][code[p]]) for p in range(s.parts)) for row, code in zip(x, codes, strict=True)]
    return codes, errors, books


def _vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def _coarse(rng, width=8):
    """Few distinct values, so that equal distances are frequent."""
    return [rng.choice([-0.5, -0.25, 0.0, 0.25, 0.5, 1.0]) for _ in range(width)]


def test_codes_equal_plain_lloyd(spark):
    rng, s = random.Random(5), vector_codes.Settings(entries=12, scale=4)
    good = [(i, _coarse(rng), rng.choice([0, 1, None])) for i in range(0, 300, 2)] + [(7, _coarse(rng), 1)] + [(301, [0.25] * 8, 3)] * 5
    bad = [(1, None, 0), (3, [None] + [0.0] * 7, 0), (5, [float("nan")] + [0.0] * 7, 1), (9, [float("inf")] + [1.0] * 7, 1), (11, [0.0] * 7 + [float("-inf")], 1)]
    rows = _vectors(spark, good + bad).select("*", *(F.lit("clash").alias(c) for c in (*CLASHING, "x", "code", "upper", "lower", "part", "entry", "rows", "sums", "scans", "kind") if c not in ("label",)))
    got, books = vector_codes.compress(rows.repartition(3), s)
    good.sort(key=lambda r: (r[0], r[1]))
    codes, errors, wanted = plain_lloyd([v for _, v, _ in good], s)
    assert books.entries.tolist() == wanted
    expected = sorted((i, bytes(c).hex(), e) for (i, _, _), c, e in zip(good, codes, errors, strict=True))
    assert sorted(map(tuple, got.select("vec_id", "code", "error").collect())) == expected
    shown = {r["vec_id"]: r["approximation"] for r in vector_codes.decoded(got, books, s).collect()}
    at = next(i for i, r in enumerate(good) if r[0] == 7)
    assert shown[7] == [c / 4 for p in range(4) for c in wanted[p][codes[at][p]]]


def test_bounds_save_scans_and_change_nothing():
    """On clusters that settle, most parts pass by their bounds; every code is that of a full scan."""
    rng = np.random.default_rng(3)
    centres = rng.integers(-3000, 3000, (40, 8))
    x = (centres[rng.integers(0, 40, 4000)] + rng.integers(-40, 40, (4000, 8))).astype(np.int64)
    entries, before, state, scans = x[:40].reshape(40, 2, 4).transpose(1, 0, 2).copy(), None, (None, None, None), []
    for _ in range(8):
        *state, scanned = vector_codes.assign(x, vector_codes._round(entries, before), *state)
        scans.append(scanned)
        for p in range(2):
            apart = vector_codes.squares(x[:, 4 * p : 4 * p + 4], entries[p])
            assert (state[0][:, p] == apart.argmin(axis=1)).all()
            own = np.sqrt(apart[np.arange(len(x)), state[0][:, p]])
            apart[np.arange(len(x)), state[0][:, p]] = np.iinfo(np.int64).max
            assert (state[1][:, p] >= own).all() and (state[2][:, p] <= np.sqrt(apart.min(axis=1))).all()
        before, entries = entries, entries.copy()
        for p in range(2):
            for e in range(40):
                mine = x[state[0][:, p] == e, 4 * p : 4 * p + 4]
                entries[p, e] = mine.sum(axis=0) // len(mine) if len(mine) else entries[p, e]
    assert scans[0] == 8000 and scans[-1] < 1500


def test_distances_are_exact_whatever_their_size():
    rows, entries = np.array([[2**27, -(2**27)], [3, 4]]), np.array([[-(2**27), 2**27 - 1], [0, 0]])
    assert vector_codes.squares(rows, entries).tolist() == [[sum((int(a) - int(b)) ** 2 for a, b in zip(r, e, strict=True)) for e in entries] for r in rows]


def test_vectors_edge_cases(spark):
    none, _ = vector_codes.compress(_vectors(spark, []))
    assert none.count() == 0
    one, books = vector_codes.compress(_vectors(spark, [(None, [0.5] * 8, None), (None, [0.25] * 8, None)]))
    assert sorted(map(tuple, one.collect())) == [(None, None, "00000000", 0), (None, None, "01010101", 0)] and books.entries.shape == (4, 2, 2)
    for odd in ([(1, [0.0] * 8, 0), (2, [0.0] * 4, 0)], [(1, [0.0] * 7, 0)], [(1, [2.0**17] * 8, 0)]):
        with pytest.raises(Exception, match="components|length|component"):
            vector_codes.compress(_vectors(spark, odd))[0].collect()


def test_label_errors_cover_a_hot_label(spark):
    """Large groups are broadcast and small ones shuffled; both get their sums, the null label too."""
    rows = spark.createDataFrame([(i, 7 if i % 3 else None if i % 2 else i, 1) for i in range(6000)], "id long, label long, error long")
    groups, _ = common.stored(rows.groupBy("label").agg(F.sum("error").alias("total"), F.count("*").alias("rows")), "groups")
    got = common.with_groups(rows, groups, "label", "rows").collect()
    assert len(got) == 6000 and {(r["label"], r["total"]) for r in got if r["label"] in (7, None, 0, 6)} == {(7, 4000), (None, 1000), (0, 1), (6, 1)}


# ---------------------------------------------------------------- conversations


def faults(rows):
    """First faults of (turn, role, text), in order."""
    out, seen = [], set()
    for _, role, text in rows:
        bare = re.sub(r"[\x20\x09-\x0D]", "", text)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def cheapest(rows):
    """(cost, audit, turns) by trying every sequence of edits with at most two inserts in a gap."""
    kinds, best = faults(rows), None
    for inserts in itertools.product(range(3), repeat=len(rows) + 1):
        if sum(inserts) > 4:
            continue
        for edits in itertools.product("DKR", repeat=len(rows)):
            if any(k in ("blank", "duplicate") and e != "D" for k, e in zip(kinds, edits, strict=True)):
                continue
            cost = 3 * sum(inserts) + sum({"D": 4, "K": 0, "R": 3}[e] + (3 if k == "truncated" and e != "D" else 0) for k, e in zip(kinds, edits, strict=True))
            audit = "".join("I" * n + e for n, e in zip(inserts, (*edits, ""), strict=True))
            if best and (cost, audit) >= best[:2]:
                continue
            turns, left = [], iter(rows)
            for letter in audit:
                role, text = (None, "") if letter == "I" else next(left)[1:]
                if letter != "D":
                    # a free role is whatever the grammar wants next
                    wanted = "assistant" if turns and turns[-1][0][:1] == "u" else "user"
                    turns.append((role if letter == "K" else wanted, text))
            if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in turns)):
                best = (cost, audit, turns)
    return best


def told(conv, rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    cost, audit, turns = cheapest(rows)
    kinds, numbers = faults(rows), [t for t, *_ in rows if t is not None]
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest()
    return (conv, gaps, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest)


def _turns(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


_SUMMARY = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


@pytest.mark.parametrize(("block", "batch"), [(2, 5), (128, 16_384)])
def test_repair_equals_exhaustive_search(spark, block, batch):
    """Small blocks and batches make conversations go on from one to the next."""
    rng, rows = random.Random(block), []
    for conv in range(45):
        for turn in range(rng.randint(1, 5)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "User", "tool", "", None])
            rows.append((conv if conv else None, rng.choice([turn, turn, turn, None, turn + 2]), role, rng.choice(["Good.", "Fine!", "cut off", "", " \n", None, "ça? ", "Good."])))
    frame = _turns(spark, rows).select("*", *(F.lit("clash").alias(c) for c in (*CLASHING, "conv_key", "seq", "head", "fault", "kind", "initial", "same", "copy", "audit")))
    got = {tuple(r) for r in conversation_repair.repair(frame.repartition(3), block=block, batch=batch).select(*_SUMMARY).collect()}
    by: dict = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    assert got == {told(conv, r) for conv, r in by.items()}


def test_a_conversation_of_many_blocks(spark):
    """Thousands of turns of one conversation, copies among them, against one walk over all of them."""
    rng = random.Random(2)
    rows = [(1, t, rng.choice(["user", "assistant"]), rng.choice(["Yes.", f"Line {t}.", f"cut {t}"])) for t in range(1500)] + [(2, 0, "user", "Hi."), (2, 1, "assistant", "Ho.")] + [(3, 5, "user", "same.")] * 700
    got = {r["conv_id"]: r for r in conversation_repair.repair(_turns(spark, rows), block=16, batch=64).collect()}
    steps, front = conversation_repair._steps(), {0: (0, "")}
    mine = sorted((r[1:] for r in rows if r[0] == 1), key=lambda r: r[0])
    for (_, role, _), fault in zip(mine, faults(mine), strict=True):
        kind, after = {None: 0, "truncated": 2}.get(fault, 1), {}
        for a, initial, k, b, cost, letters in steps:
            if a in front and initial == role[0] and k == kind:
                found = (front[a][0] + cost, front[a][1] + letters)
                after[b] = min(after.get(b, found), found)
        front = after
    assert (got[1]["cost"], got[1]["audit"]) == conversation_repair._ended(front)
    assert got[2]["audit"] == "KK" and got[3]["audit"] == "K" + "D" * 699 + "I" and got[3]["cost"] == 2799 and got[3]["duplicate"] == 699
    turns = conversation_repair.Repair(_turns(spark, rows)).turns().where("conv_key = '=1'").orderBy("position").collect()
    assert re.fullmatch("(ua)+", "".join(r["role"][0] for r in turns))
    assert hashlib.sha256("\n".join(f"{r['role']}:{r['text']}" for r in turns).encode()).hexdigest() == got[1]["repaired_sha256"]


def test_damage_and_conversations_without_turns(spark):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"Said {c}, {t}!") for c in range(40) for t in range(3)] + [(None, None, None, None), (900, 3, None, "x" * 50_000 + ".")]
    got = sorted(map(tuple, conversation_repair.damaged(_turns(spark, rows)).collect()), key=str)
    expected = []
    for conv, turn, role, text in rows:
        chance = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if chance:
            made = (conv, turn, "user" if chance == 4 else role, "" if chance == 1 else re.sub("[.!?]", "", text) if chance == 2 else text)
            expected += [made] * (2 if chance == 3 else 1)
    assert got == sorted(expected, key=str)
    none = conversation_repair.repair(_turns(spark, []), _turns(spark, [(5, 0, "user", "x")]))
    assert [tuple(r) for r in none.collect()] == [(5, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]
    assert conversation_repair.repair(_turns(spark, [])).count() == 0


# ---------------------------------------------------------------- the archive

PAGES = [(1, "http://a.example/", "<p>same</p>"), (4, "http://b.example/?x=1", "<p>same</p>"), (9, "http://c.example/", "<p>same</p>"), (2, None, None), (3, "u", ""), (5, "http://d/\r\nWARC-Type: x", "ünï\r\n\r\nWARC/1.1\r\n\r\n😀"),
         (None, "v", "<p>same</p>"), (None, "w", "only null"), (6, "http://e/", "x" * 200_000), (7, "http://f/", "twice"), (7, "http://f/", "twice"), (8, "g", "twice"), (8, "g", "twice")]


def _pages(spark, rows=PAGES):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def _archived(spark, rows=PAGES, **more):
    return warc_archive.archive(_pages(spark, rows), common.new_path(spark, "warc-test"), **more)


def _expected(rows, least=0):
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        ids = [p for p, _, h in rows if (h or "") == (html or "") and p is not None]
        top = max(ids, default=None)
        kind = "response" if len(data) < least or page == top else "revisit"
        out.append((page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), kind, top if kind == "revisit" else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 9])
def test_archive_and_read_back(spark, least):
    made = _archived(spark, min_bytes=least)
    got = warc_archive.read(made).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted(map(tuple, got.collect()), key=str) == _expected(PAGES, least)
    assert made.payloads().count() == len({h or "" for _, _, h in PAGES})  # each payload's bytes once


def _warc_records(data: bytes):
    """(fields, block) of a WARC file, by its lengths alone."""
    while data:
        head, _, rest = data.partition(b"\r\n\r\n")
        version, *lines = head.decode().split("\r\n")
        assert version == "WARC/1.1"
        fields = dict(line.split(": ", 1) for line in lines)
        n = int(fields["Content-Length"])
        assert rest[n : n + 4] == b"\r\n\r\n"
        yield fields, rest[:n]
        data = rest[n + 4 :]


def test_records_are_rebuilt_to_the_byte_and_exported(spark):
    made = _archived(spark)
    payloads = {p: (h or "").encode() for p, _, h in PAGES if p is not None}
    for r in warc_archive.reconstruct(made).where("page_id IS NOT NULL").collect():
        fields, block = next(_warc_records(r["header"].split("\r\n\r\n")[0].encode() + b"\r\n\r\n" + bytes(r["block"]) + b"\r\n\r\n"))
        assert bytes(r["payload"]) == payloads[r["page_id"]]
        http, _, body = block.partition(b"\r\n\r\n")
        assert body == (b"" if fields["WARC-Type"] == "revisit" else payloads[r["page_id"]]) and f"Content-Length: {len(payloads[r['page_id']])}".encode() in http
    path = common.new_path(spark, "warc-files")
    warc_archive.export(made, path)
    records = [x for f in glob(f"{path.removeprefix('file:')}/*.gz") for x in _warc_records(gzip.open(f).read())]
    assert len(records) == len(PAGES)
    ids = {f["WARC-Record-ID"] for f, _ in records if f["WARC-Type"] == "response"}
    assert all(f["WARC-Refers-To"] in ids for f, _ in records if f["WARC-Type"] == "revisit")
    assert all("\n" not in v for f, _ in records for v in f.values())


def test_a_changed_payload_is_found(spark):
    made = _archived(spark)
    rows = made.payloads().withColumn("payload", F.when(F.col("bytes") == 5, F.lit("twicE").cast("binary")).otherwise(F.col("payload")))
    rows.write.parquet(f"{made.path}-bad/payloads")
    made.records().write.parquet(f"{made.path}-bad/records")
    with pytest.raises(Exception, match="isn't its own"):
        warc_archive.read(warc_archive.Archive(spark, f"{made.path}-bad", made.id_type)).collect()


def test_archive_of_nothing_and_of_clashing_columns(spark):
    assert warc_archive.read(_archived(spark, [])).count() == 0
    names = [c for c in (*CLASHING, "digest", "bytes", "sha1", "header", "payload", "records", "response_id", "group_key", "second") if c != "html"]
    made = warc_archive.archive(_pages(spark).select("*", *(F.lit("clash").alias(c) for c in names)), common.new_path(spark, "warc-test"))
    got = warc_archive.read(made).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted(map(tuple, got.collect()), key=str) == _expected(PAGES)
