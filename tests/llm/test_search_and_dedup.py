"""Operators 3 and 8, and connected components, against brute force."""

import random

import edge
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from driftgram.llm import components, decontamination, simhash_dedup


def fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(values, max_bits=3):
    """Component number of each value, by breadth-first search over all pairs."""
    out = {}
    for start in values:
        if start in out:
            continue
        out[start], todo = start, [start]
        while todo:
            x = todo.pop()
            for y in values:
                if y not in out and (x ^ y).bit_count() <= max_bits:
                    out[y] = start
                    todo.append(y)
    return out


def test_fingerprints_match_the_definition():
    for text in [None, "", " \n", "one", "One two", "a b c", "A b c d e f g " * 30, edge.prose(1, 300), "é ü x"]:
        assert simhash_dedup.fingerprint(text) == fingerprint(text)
    assert simhash_dedup.fingerprint("alpha beta gamma") == xxhash.xxh64_intdigest(b"alpha beta gamma", 42)


def near(text, k):
    words = text.split()
    words[k % len(words)] = f"changed{k}"
    return " ".join(words)


def test_near_duplicates_against_all_pairs(spark):
    base = edge.prose(77, 400)
    extra = [(2000 + k, near(base, 7 * k), None, None, None) for k in range(25)]
    rows = edge.rows() + extra
    got = edge.sorted_rows(simhash_dedup.near_duplicates(spark.createDataFrame(rows, edge.SCHEMA)).withColumn("fp", F.hex("fp")), "doc_id", "fp", "component_id")
    fps = [fingerprint(r[1]) for r in rows]
    label = classes(sorted(set(fps)))
    least = {}
    for r, f in zip(rows, fps, strict=True):
        if r[0] is not None:
            least[label[f]] = min(least.get(label[f], r[0]), r[0])
    assert got == sorted(((r[0], f"{f:X}", least.get(label[f])) for r, f in zip(rows, fps, strict=True)), key=str)


def _clustered(seed, centres, around):
    rng = random.Random(seed)
    values = set()
    for _ in range(centres):
        c = rng.getrandbits(64)
        for _ in range(around):
            x = c
            for _ in range(rng.randint(0, 5)):
                x ^= 1 << rng.randrange(64)
            values.add(x)
    return sorted(values)


@pytest.mark.parametrize("hot", [1 << 16, 8])
def test_links_connect_all_classes(spark, hot):
    """Also with buckets so small that nearly all go to the finer keys."""
    values = _clustered(1, 12, 60)
    signed = np.array(values, dtype=np.uint64).view(np.int64).tolist()
    edges = simhash_dedup.links(spark.createDataFrame([(v,) for v in signed], "fp long"), hot=hot)
    found = {r["node"]: r["root"] for r in components.components(edges).collect()}
    label = classes(values)
    of = dict(zip(signed, values, strict=True))
    mine = {v: label[of[v]] for v in signed}
    groups = {}
    for v in signed:
        groups.setdefault(found.get(v, v), set()).add(v)
    expected = {}
    for v in signed:
        expected.setdefault(mine[v], set()).add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))
    assert edges.distinct().count() < 64 * len(values)


def test_components(spark):
    rng = random.Random(2)
    pairs = [(i, i + 1) for i in range(0, 60)] + [(rng.randint(100, 160), rng.randint(100, 160)) for _ in range(45)] + [(500, i) for i in range(501, 560)] + [(7, 7)]
    found = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    parent = {x: x for p in pairs for x in p}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        ra, rb = sorted((root(a), root(b)))
        parent[rb] = ra
    assert found == {x: root(x) for x in parent if root(x) != x}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_of_each(spark):
    for docs in (edge.documents(spark), edge.clashing(spark)):
        kept = simhash_dedup.one_of_each(docs)
        assert kept.columns == docs.columns
        ids = [r["doc_id"] for r in kept.collect()]
        assert 300 in ids and not set(ids) & set(range(301, 330)) and ids.count(7) == 1 and 100 in ids and not {101, 102} & set(ids)
        assert len(ids) == simhash_dedup.near_duplicates(docs).select("root").distinct().count()
    unnamed = spark.createDataFrame([(None, edge.prose(i, 50), None, None, None) for i in (1, 1, 2)], edge.SCHEMA)
    assert simhash_dedup.one_of_each(unnamed).count() == 2
    assert simhash_dedup.near_duplicates(edge.empty(spark)).count() == 0 and simhash_dedup.one_of_each(edge.empty(spark)).count() == 0


# ---------------------------------------------------------------- 3

ITEMS = [(i, edge.prose(9000 + i, n)) for i, n in enumerate([3, 5, 6, 9, 14, 30, 61])] + [(50, None), (51, ""), (52, "..."), (53, "Solo!"), (None, edge.prose(1, 12))]


def contained(text, item, threshold=0.8):
    words, own = (decontamination.normal_words(t) for t in (text, item))
    k = min(5, len(own))
    if not k:
        return None
    grams = {tuple(own[i : i + k]) for i in range(len(own) - k + 1)}
    shared = len(grams & {tuple(words[i : i + k]) for i in range(len(words) - k + 1)})
    return (len(grams), shared) if shared >= threshold * len(grams) - 1e-9 else None


def leaky():
    rng = random.Random(8)
    out = []
    for k, (_, text) in enumerate(ITEMS):
        words = (text or "").split()
        for lost in (0, 1, 2, 6):
            some = list(words)
            if some and lost:
                some[rng.randrange(len(some))] = "other"
                some = some[: len(some) - lost + 1]
            around = edge.prose(k, 4000 if lost == 1 else 90).split()
            at = rng.randrange(len(around))
            out.append((3000 + 10 * k + lost, " ".join(around[:at] + [w.upper() + "," for w in some] + around[at:]), None, None, None))
    return out


@pytest.mark.parametrize("block", [200_000, 40])
def test_search_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(decontamination, "BLOCK_SHINGLES", block)
    rows = edge.rows() + leaky()
    items = spark.createDataFrame([*ITEMS, ITEMS[4]], "item_id long, text string")
    got = edge.sorted_rows(decontamination.search(spark.createDataFrame(rows, edge.SCHEMA), items), "doc_id", "item_id", "item_shingles", "shared")
    expected = sorted(((r[0], i, *hit) for r in rows for i, text in ITEMS if (hit := contained(r[1], text))), key=str)
    assert got == expected and len(got) > 10


def test_some_band_is_always_whole():
    """The bands of each partition outnumber the shingles that a contained item of it can lack."""
    for n in range(1, 600):
        bands, rows = decontamination.banding(decontamination.upper_size(n), 0.8)
        assert bands > n - int(np.ceil(0.8 * n - 1e-9)) and 1 <= rows and (bands * rows <= n or rows == 1)
    assert {decontamination.banding(u, 0.8) for u in (4, 8, 16, 64)} == {(1, 3), (2, 2), (4, 2), (13, 2)}


def test_candidates_against_all_pairs():
    """In each partition: every contained item is a candidate, and few others are."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([5, 6, 9, 12, 20, 40, 90, 150])))) for i in range(120)]
    block = decontamination.Block(items)
    assert len(block.partitions[5]) >= 6
    hits = others = 0
    for _ in range(60):
        _, text = rng.choice(items)
        words = text.split()
        for _ in range(rng.randint(0, max(1, len(words) // 20))):
            words[rng.randrange(len(words))] = "zz"
        doc = decontamination.normal_words(" ".join(rng.choices(vocabulary, k=rng.choice([30, 3000])) + words))
        have = np.unique(decontamination.window_hashes(decontamination.word_hashes(doc), 5))
        found = set().union(*(p.candidates(have) for p in block.partitions[5]))
        expected = {i for i, t in items if contained(" ".join(w.decode() for w in doc), t)}
        assert expected <= found
        hits, others = hits + len(expected), others + len(found - expected)
    assert hits > 25 and others < hits


def test_leaks_are_dropped(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    for docs in (edge.documents(spark), edge.clashing(spark)):
        docs = docs.unionByName(spark.createDataFrame(leaky(), edge.SCHEMA), allowMissingColumns=True)
        kept = decontamination.without_leaks(docs, items)
        assert kept.columns == docs.columns
        expected = [r[0] for r in edge.rows() + leaky() if not any(contained(r[1], t) for _, t in ITEMS)]
        assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted(expected, key=str)
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.search(edge.documents(spark), none).count() == 0 and decontamination.search(edge.empty(spark), items).count() == 0
    assert decontamination.without_leaks(edge.documents(spark), none).count() == len(edge.rows())
