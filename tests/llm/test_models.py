"""Operators 2, 4 and 6: models against brute force and by held-out results."""

import itertools
import math
import string
from collections import Counter
from zlib import crc32

import edge
import numpy as np
import pytest
from pyspark.sql import functions as F

from driftgram.llm import common, factorization, hmm_scoring, quality_classifier, toxicity

LABELS = "doc_id long, quality int, toxic int"


def test_pair_term_identity():
    rng = np.random.default_rng(1)
    model = factorization.Model(0.3, np.zeros(16), np.zeros((16, 3)))
    known = [2, 5, 7, 11]
    model.w[known], model.v[known] = rng.normal(size=4), rng.normal(size=(4, 3))
    docs = [np.array([2, 5, 11]), np.array([], dtype=np.int64), np.array([3]), np.array([2, 3, 5, 7, 11])]
    for doc, score in zip(docs, model.score(docs), strict=True):
        raw = 0.3 + sum(model.w[i] for i in doc) + sum(model.v[i] @ model.v[j] for i, j in itertools.combinations(doc, 2))
        assert score == pytest.approx(1 / (1 + math.exp(-raw)))


def test_interactions_are_learned():
    """Label 1 needs both words; each is in a third of the texts of label 0 too. With the production settings."""
    rng = np.random.default_rng(3)
    docs, labels = [], []
    for i in range(1200):
        both, noise = i % 4, rng.integers(10, 60, 3)
        docs.append(np.unique(np.concatenate([[1] if both in (0, 1) else [], [2] if both in (0, 2) else [], noise])).astype(np.int64))
        labels.append(both == 0)
    model = factorization.train(docs[:900], np.array(labels[:900]), factorization.Settings())
    assert ((model.score(docs[900:]) >= 0.5) == np.array(labels[900:])).mean() > 0.97
    flat = factorization.Model(model.w0, model.w, np.zeros_like(model.v))
    assert ((flat.score(docs[900:]) >= 0.5) == np.array(labels[900:])).mean() < 0.9


@pytest.mark.parametrize("number", [1200, 6000])
def test_words_that_tell_nothing_alone_are_learned_in_pairs(number):
    """Label 1 is both words or neither: each is in half of the texts of either label. With the production settings."""
    rng = np.random.default_rng(number)
    one, two = rng.integers(0, 2, number).astype(bool), rng.integers(0, 2, number).astype(bool)
    docs = [np.unique(np.concatenate([[1] if a else [], [2] if b else [], rng.integers(10, 60, 3)])).astype(np.int64) for a, b in zip(one, two, strict=True)]
    labels, cut = one == two, number * 3 // 4
    model = factorization.train(docs[:cut], labels[:cut], factorization.Settings())
    assert ((model.score(docs[cut:]) >= 0.5) == labels[cut:]).mean() > 0.95
    flat = factorization.Model(model.w0, model.w, np.zeros_like(model.v))
    assert ((flat.score(docs[cut:]) >= 0.5) == labels[cut:]).mean() < 0.8  # sums of single weights can't be right on more than three of the four ways


def test_pair_evidence_against_plain_counts():
    rng = np.random.default_rng(4)
    docs = [np.unique(rng.integers(0, 12, 5)) for _ in range(400)]
    labels = np.array([float((3 in d) != (7 in d)) for d in docs])
    places, scale = factorization.evidence(docs, labels, factorization.Settings(pair_least=5))
    rate = labels.mean()

    def cell(**want):
        mine = [y for d, y in zip(docs, labels, strict=True) if all((int(x[1:]) in d) == there for x, there in want.items())]
        return len(mine), sum(mine)

    def chi2(x):
        return sum((p - k * rate) ** 2 / (k * rate * (1 - rate)) for k, p in (cell(**{f"_{x}": t}) for t in (True, False)))

    def interaction(x, y):
        cells = [(cell(**{f"_{x}": a, f"_{y}": b}), 1 if a == b else -1) for a in (True, False) for b in (True, False)]
        if not all(k for (k, _), _ in cells):
            return 0.0
        return sum(sign * p / k for (k, p), sign in cells) ** 2 / (rate * (1 - rate) * sum(1 / k for (k, _), _ in cells))

    for x, got in zip(places.tolist(), scale, strict=True):
        pairs = max(interaction(x, y) - chi2(x) - chi2(y) for y in places.tolist() if y != x)
        best = max(chi2(x), pairs - 2 * math.log(len(places) ** 2))
        assert got == pytest.approx(min(1.0, 0.03 + (best / (best + 20)) ** 2), rel=1e-4)
    assert sorted(places[scale > 0.7].tolist()) == [3, 7]


def test_every_place_met_has_weights():
    """Whatever its frequency, and however many there are; those not met have none. Ties are all kept."""
    docs = [np.arange(k * 50, k * 50 + 51) for k in range(300)]
    model = factorization.train(docs, np.arange(300) % 3 == 0, factorization.Settings(epochs=1, min_updates=1))
    met = np.unique(np.concatenate(docs))
    assert (np.abs(model.v[met]).max(axis=1) > 0).all() and (model.w[met] != 0).all()
    assert not model.v[met.max() + 1 :].any() and not model.w[met.max() + 1 :].any()


def plain_gradient_step(docs, labels, s):
    """The first update of each weight by loops over documents and pairs, all documents in one batch."""
    places = sorted({int(p) for d in docs for p in d})
    n, p = len(docs), sum(labels)
    scale = {}
    for x in places:
        a = sum(y for d, y in zip(docs, labels, strict=True) if x in d)
        b = sum(1 - y for d, y in zip(docs, labels, strict=True) if x in d)
        c, e = p - a, n - p - b
        below = (a + b) * (c + e) * (a + c) * (b + e)
        chi2 = n * (a * e - b * c) ** 2 / below if below else 0.0
        scale[x] = min(1.0, s.floor + (chi2 / (chi2 + s.half_chi2)) ** 2)
    bias = math.log((p + 1) / (n + 2) / (1 - (p + 1) / (n + 2)))
    v = dict(zip(places, np.random.default_rng(s.seed).normal(0, 0.01, (len(places), s.rank)), strict=True))
    errors = []
    for d, y in zip(docs, labels, strict=True):
        raw = bias + sum(v[i] @ v[j] * scale[i] * scale[j] for i, j in itertools.combinations(d.tolist(), 2))
        errors.append((1 / (1 + math.exp(-raw)) - y) / n)
    step = lambda g: s.rate * g / np.sqrt(1e-6 + g * g)
    w = {x: -step(sum(e for d, e in zip(docs, errors, strict=True) if x in d) * scale[x]) * scale[x] for x in places}
    out = {}
    for x in places:
        pull = sum((e * scale[x] * sum((v[j] * scale[j] for j in d.tolist() if j != x), np.zeros(s.rank)) for d, e in zip(docs, errors, strict=True) if x in d), np.zeros(s.rank))
        out[x] = (v[x] - step(pull + s.decay * v[x])) * scale[x]
    return bias - step(sum(errors)), w, out


def test_training_against_plain_loops():
    rng = np.random.default_rng(9)
    docs = [np.unique(rng.integers(0, 30, 6)) for _ in range(40)]
    labels = [int(3 in d) for d in docs]
    s = factorization.Settings(bits=5, epochs=1, min_updates=1, batch=64)
    model, (bias, w, v) = factorization.train(docs, np.array(labels), s), plain_gradient_step(docs, labels, s)
    assert model.w0 == pytest.approx(bias)
    for x in w:
        assert model.w[x] == pytest.approx(w[x], rel=1e-4, abs=1e-9) and model.v[x] == pytest.approx(v[x], rel=1e-3, abs=1e-8)


def plain_score(model, places):
    v = model.v[places].astype(float)  # every pair once, a block of rows of the table of pairs at a time
    pairs = sum(float(np.triu(v[at : at + 500] @ v.T, at + 1).sum()) for at in range(0, len(places), 500))
    raw = model.w0 + sum(float(model.w[i]) for i in places) + pairs
    return 1 / (1 + math.exp(-max(-30, min(30, raw))))


@pytest.mark.parametrize(("module", "label", "least"), [(toxicity, "toxic", 0.5), (quality_classifier, "quality", 0.3)])
def test_query_against_plain_scores(spark, sf_dir, module, label, least):
    """The query's rows against features and pairs worked out plainly from the same fitted model."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    inputs = module._inputs(docs) if module is quality_classifier else ("text",)
    model = factorization.fit(docs, labels, label, module.features, module.SETTINGS, inputs)
    expected = {}
    for r in docs.collect():
        text = r["text"] or ""
        words = text.encode().lower().split()
        if module is toxicity:
            bare = {w.strip(string.punctuation.encode()) for w in words} - {b""}
            names = bare | {b"%d:" % n + w[:n] for w in bare for n in (4, 5, 6) if len(w) > n}
        else:
            statistics = quality_classifier.structure(text.encode(), words, set(words)) | quality_classifier.metadata(text, r["n_chars"])
            names = set(words) | {f" {k}={x}".encode() for k, x in statistics.items()}
        expected[r["doc_id"]] = plain_score(model, sorted({crc32(x) % (1 << 18) for x in names}))
    rows = module.query(spark, sf_dir).collect()
    assert len(rows) == len(expected)
    for r in rows:
        assert r["held_out"] == (crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= least)
        assert r["score"] == pytest.approx(expected[r["doc_id"]], rel=1e-3, abs=1e-6)


def test_metadata_of_quality(spark):
    """A size that disagrees with the text is learned, alone and in pairs; without it the text decides."""
    text = "abc " * 20
    assert quality_classifier.metadata(text, None) == {"n_chars": -1, "n_chars_agrees": -1}
    assert [quality_classifier.metadata(text, n)["n_chars_agrees"] for n in (79, 80, 81)] == [-1, 0, 1]
    rows = [(i, edge.prose(i, 60), "en", "s", None) for i in range(300)]
    docs = spark.createDataFrame([(i, t, a, b, len(t) if i % 3 else len(t) * 2) for i, t, a, b, _ in rows], edge.SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(300)], LABELS)
    got = quality_classifier.score(docs, labels, ["doc_id"]).where(factorization.held_out(F.col("doc_id"))).collect()
    assert all((r["score"] >= 0.3) == (r["doc_id"] % 3 > 0) for r in got)
    assert quality_classifier.score(docs.drop("n_chars"), labels).count() == 300


def corpus(spark, n=400):
    insults = ["blorg", "snarf", "quux"]
    rows, labels = [], []
    for i in range(n):
        bad, junk = i % 5 == 0, i % 7 == 0
        words = edge.prose(i, 80).split()
        if bad:
            words[i % 60] = insults[i % 3].upper() + "!"
        text = " ".join(f"{w}%%%" for w in words) if junk else " ".join(words)
        rows.append((i, text, "en", "s", 1))
        labels.append((i, int(not junk), int(bad)))
    return spark.createDataFrame(rows, edge.SCHEMA), spark.createDataFrame(labels, LABELS)


@pytest.mark.parametrize(("module", "label", "least"), [(toxicity, "toxic", 0.5), (quality_classifier, "quality", 0.3)])
def test_held_out_accuracy(spark, module, label, least):
    docs, labels = corpus(spark)
    got = module.score(docs, labels).join(labels, "doc_id").where(factorization.held_out(F.col("doc_id"))).collect()
    assert len(got) > 50 and sum((r["score"] >= least) == r[label] for r in got) / len(got) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def test_only_text_counts_and_held_out_labels_do_not(spark):
    docs, labels = corpus(spark, 150)
    other = docs.withColumns({"lang": F.lit("xx"), "source": F.lit("yy"), "n_chars": F.lit(9)})
    wrong = labels.withColumn("toxic", F.when(factorization.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    scores = [edge.sorted_rows(toxicity.score(d, x, ["doc_id"]), "doc_id", "score") for d, x in ((docs, labels), (other, labels), (docs, wrong))]
    assert scores[0] == scores[1] == scores[2]
    ids = [r["doc_id"] for r in docs.where(factorization.held_out(F.col("doc_id"))).collect()]
    assert sorted(ids) == [i for i in range(150) if crc32(str(i).encode()) % 5 == 0]


@pytest.mark.parametrize("module", [toxicity, quality_classifier])
def test_classifier_edge_cases(spark, module):
    _, labels = corpus(spark, 60)
    none, odd = spark.createDataFrame([], LABELS), labels.union(spark.createDataFrame([(None, 1, 1), (3, None, None), (3, 0, 0), (3, 1, 1), (9999, 1, 1)], LABELS))
    for table in (none, odd):
        out = module.score(edge.documents(spark), table, ["doc_id"])
        assert out.count() == len(edge.rows()) and out.where("score IS NULL OR score < 0 OR score > 1").count() == 0
    out = module.score(edge.clashing(spark), labels)
    assert len(set(out.columns)) == len(out.columns) and out.where("rate <> 'clash'").count() == 0
    assert edge.sorted_rows(out, "doc_id", "score") == edge.sorted_rows(module.score(edge.documents(spark), labels), "doc_id", "score")
    assert module.score(edge.empty(spark), labels).count() == 0 and module.score(edge.documents(spark), none).select("score").distinct().count() == 1


def test_quality_stage_keeps_rows_whole(spark):
    docs, labels = corpus(spark, 200)
    kept = quality_classifier.accepted(docs, labels)
    assert kept.columns == docs.columns
    assert {tuple(r) for r in kept.collect()} == {tuple(r) for r in docs.join(labels, "doc_id").where("quality = 1").select(*docs.columns).collect()}
    nothing = spark.createDataFrame([], LABELS)
    assert quality_classifier.accepted(edge.documents(spark), nothing).count() == len(edge.rows())


# ---------------------------------------------------------------- 4


def random_model(seed, states=hmm_scoring.STATES):
    rng = np.random.default_rng(seed)
    emit = rng.dirichlet(np.ones(hmm_scoring.BUCKETS + 1) * 0.5 + 1e-3, states).T + 1e-9
    return hmm_scoring.Hmm(rng.dirichlet(np.ones(states)), rng.dirichlet(np.ones(states), states), emit)


def test_forward_equals_sum_over_paths():
    model = random_model(4)
    sequences = [np.array(s, dtype=np.int32) for s in ([3, 9, 4, hmm_scoring.END], [hmm_scoring.END], [7, 7, hmm_scoring.END])]
    for s, got in zip(sequences, hmm_scoring.log_likelihoods(model, sequences), strict=True):
        total = 0.0
        for path in itertools.product(range(hmm_scoring.STATES), repeat=len(s)):
            p = model.start[path[0]] * model.emit[s[0], path[0]]
            for t in range(1, len(s)):
                p *= model.move[path[t - 1], path[t]] * model.emit[s[t], path[t]]
            total += p
        assert got == pytest.approx(math.log10(total))


def test_expected_counts_equal_sum_over_paths():
    model = random_model(5)
    sequences = [np.array(s, dtype=np.int32) for s in ([3, 9, 4], [5, 3], [8])]
    counts = hmm_scoring.Counts.zero()
    hmm_scoring.expect(model, sequences, counts)
    start, move, emit = np.zeros_like(counts.start), np.zeros_like(counts.move), np.zeros_like(counts.emit)
    for s in sequences:
        paths = list(itertools.product(range(hmm_scoring.STATES), repeat=len(s)))
        weights = np.array([model.start[p[0]] * math.prod(model.emit[x, z] for x, z in zip(s, p, strict=True)) * math.prod(model.move[a, b] for a, b in itertools.pairwise(p)) for p in paths])
        for p, w in zip(paths, weights / weights.sum(), strict=True):
            start[p[0]] += w
            for a, b in itertools.pairwise(p):
                move[a, b] += w
            for x, z in zip(s, p, strict=True):
                emit[x, z] += w
    assert np.allclose(counts.start, start) and np.allclose(counts.move, move) and np.allclose(counts.emit, emit)


def learned(spark, texts, iterations, head=hmm_scoring.HEAD):
    rows = spark.createDataFrame([(None, t, True, False) for t in texts], "doc_id long, text string, learned boolean, wanted boolean")
    return hmm_scoring.fit(rows, head, iterations)


@pytest.mark.parametrize("head", [5])
def test_training_raises_likelihood(spark, head):
    texts = [edge.prose(i, 40) if i % 2 else " ".join(f"w{(i * j) % 17}" for j in range(50)) for i in range(120)]
    train = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    one, three = (hmm_scoring.score(train, train, head, k).agg(F.sum("score")).first()[0] for k in (1, 3))
    assert three > one


def test_passes_equal_plain_baum_welch(spark, monkeypatch):
    """Blocks, joins and integer sums give the model that the plain recursion gives over one code a word."""
    monkeypatch.setattr(hmm_scoring, "OWN", 2)
    texts = [" ".join(f"w{(i * j + i) % 23}" for j in range(30)) for i in range(40)] + ["rare1 w3", "rare2 w5 w3"]
    got = learned(spark, texts, 2, head=4)
    words = sorted({w for t in texts for w in t.split()})
    counts = Counter(w for t in texts for w in t.split())
    codes = {w: hmm_scoring.BUCKETS + 1 + k for k, w in enumerate(w for w in words if counts[w] >= 2)} | {w: crc32(w.encode()) & (hmm_scoring.BUCKETS - 1) for w in words if counts[w] < 2}
    of_bucket = Counter()
    rare = Counter()
    for w, c in counts.items():
        of_bucket[crc32(w.encode()) & (hmm_scoring.BUCKETS - 1)] += c
        rare[crc32(w.encode()) & (hmm_scoring.BUCKETS - 1)] += c * (c < 2)
    start = hmm_scoring._initial(hmm_scoring.start_texts(spark.createDataFrame([(t,) for t in texts], "text string")))
    every = {w.encode(): counts[w] for w in words if counts[w] >= 2}
    model = hmm_scoring._begin(start, every, {k: (c, rare[k]) for k, c in of_bucket.items()}).model
    for _ in range(2):
        sums = hmm_scoring.Counts.zero(len(model.emit))
        hmm_scoring.expect(model, [np.array([codes[w] for w in t.split()] + [hmm_scoring.END], dtype=np.int32) for t in texts], sums)
        model = sums.model()
    assert got.learned.model.start == pytest.approx(model.start, abs=1e-4) and got.learned.model.move == pytest.approx(model.move, abs=1e-4)
    n = hmm_scoring.BUCKETS + 1
    assert got.learned.model.emit[:n] == pytest.approx(model.emit[:n], abs=1e-4)
    for k, w in enumerate(got.head):
        assert got.learned.model.emit[n + k] == pytest.approx(model.emit[codes[w.decode()]], abs=1e-4)


def test_the_start_is_learned_from_every_text(spark):
    """From far more texts than a sample would hold, one of them long: who follows whom, and each word."""
    texts = [f"w{i} w{i} v{i % 50}" for i in range(1500)] + ["", None, "long " * 1_200_000]
    seen = hmm_scoring.start_texts(spark.createDataFrame([(t,) for t in texts], "text string").repartition(6))
    assert seen.words == {w.encode(): k for k, w in enumerate(["long", *sorted(f"v{i}" for i in range(50))])}
    pairs = np.zeros_like(seen.pairs)
    for t in texts:
        places = [seen.words.get(w, hmm_scoring.CLASSES + crc32(w) % hmm_scoring.CLASSES) for w in hmm_scoring.tokens(t)]
        np.add.at(pairs, ([2 * hmm_scoring.CLASSES, *places], [*places, 2 * hmm_scoring.CLASSES]), 1)
    assert (seen.pairs == pairs).all()
    model, _ = hmm_scoring._initial(seen)
    assert (model.emit[:-1] * pairs.sum(axis=0)[:-1, None]).sum(axis=0) + model.emit[-1] == pytest.approx(np.ones(hmm_scoring.STATES), abs=0.05)


def test_scores_do_not_depend_on_the_order_of_rows(spark):
    """Also where one text makes up most of the corpus and lies among those of least hash."""
    rows = [(i, edge.prose(i, 20)) for i in range(120)] + [(1000 + i, edge.prose(0, 20)) for i in range(900)]
    scores = []
    for order in (rows, rows[::-1], sorted(rows, key=lambda r: r[1])):
        docs = spark.createDataFrame(order, "doc_id long, text string").repartition(len(scores) + 2)
        scores.append({r["doc_id"]: r["score"] for r in hmm_scoring.score(docs, "doc_id % 10 <> 0", 50).collect()})
    assert scores[0] == pytest.approx(scores[1], abs=1e-3) and scores[0] == pytest.approx(scores[2], abs=1e-3)


@pytest.mark.parametrize("head", [100_000, 25])
def test_scores(spark, head):
    """Base scores and counts against brute force, whatever share of the words is broadcast."""
    rows = edge.rows()
    docs = edge.clashing(spark)
    train = docs.where(~hmm_scoring.held_out(docs["doc_id"]))
    got = sorted(((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in hmm_scoring.score(docs, train, head, 1).collect()), key=str)
    learned = [hmm_scoring.tokens(r[1]) for r in rows if crc32(str(r[0] if r[0] is not None else "").encode()) % 10]
    counts = Counter(w for t in learned for w in t)
    n, v = sum(counts.values()) + len(learned), len(counts) + 1
    log = lambda c: math.log10((c + 0.1) / (n + 0.1 * (v + 1)))
    expected = sorted(((r[0], len(t) + 1, sum(w in counts for w in t) + 1, n, sum(log(counts.get(w, 0)) for w in t) + log(len(learned))) for r in rows for t in [hmm_scoring.tokens(r[1])]), key=str)
    assert [g[:4] for g in got] == [e[:4] for e in expected]
    assert [g[4] for g in got] == pytest.approx([e[4] for e in expected])


def test_score_is_a_probability_over_words(spark):
    """The probabilities of all one-word texts, with a word unseen in each bucket, sum to that of length one."""
    train = spark.createDataFrame([("a b c a",), ("b b",), ("d",), ("",)], "text string")
    words = ["a", "b", "c", "d"]
    docs = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "doc_id long, text string")
    model = learned(spark, ["a b c a", "b b", "d", ""], 1).learned.model
    scores = {r["doc_id"]: r["score"] for r in hmm_scoring.score(docs, train, iterations=1).collect()}
    counts = Counter("abcabbd")
    for i, w in enumerate(words):
        bucket = crc32(w.encode()) & (hmm_scoring.BUCKETS - 1)
        same = [x for x in words if crc32(x.encode()) & (hmm_scoring.BUCKETS - 1) == bucket]
        q = (counts[w] + 0.1) / (sum(counts[x] for x in same) + 0.1 * (len(same) + 1))
        expected = hmm_scoring.log_likelihoods(model, [hmm_scoring.encoded([w.encode()])])[0] + math.log10(q)
        assert scores[i] == pytest.approx(expected, rel=1e-5)


def test_scoring_edge_cases(spark):
    docs, none = edge.documents(spark), edge.empty(spark)
    unlearned = hmm_scoring.score(docs, none, iterations=1)
    assert unlearned.count() == len(edge.rows()) and unlearned.where("n_known <> 0 OR train_tokens <> 0").count() == 0
    assert hmm_scoring.score(none, docs, iterations=1).count() == 0 and hmm_scoring.score(none, none, iterations=1).count() == 0
    assert unlearned.where("score IS NULL OR base_score IS NULL OR isnan(score)").count() == 0
    assert common.fold_remainder(F.lit(None), 10) is not None


@pytest.mark.parametrize("head", [0])
def test_words_of_one_bucket_have_their_own_emissions(spark, head):
    """Two words that share a bucket but follow different words are told apart, broadcast or joined."""
    bucket_of = lambda w: crc32(w.encode()) & (hmm_scoring.BUCKETS - 1)
    first = "w0"
    second = next(w for w in (f"w{i}" for i in range(1, 1_000_000)) if bucket_of(w) == bucket_of(first))
    train = spark.createDataFrame([(f"left {first} " * 12,) if i % 2 else (f"right {second} " * 12,) for i in range(40)], "text string")
    docs = spark.createDataFrame([(1, f"left {first} " * 12), (2, f"left {second} " * 12)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in hmm_scoring.score(docs, train, head).collect()}
    assert got[1]["base_score"] == pytest.approx(got[2]["base_score"])
    assert got[1]["score"] > got[2]["score"] + 1


@pytest.mark.parametrize("head", [100_000, 2])
def test_emissions_with_own_words_sum_to_one(spark, head):
    """Over buckets, broadcast and joined words together, for each state."""
    got = learned(spark, ["a b c a " * 4, "b b e", "d " * 9, ""], 2, head)
    others = {}
    for r in got.met.where("block IS NOT NULL").collect():
        others[r["w"]] = np.frombuffer(r["w"], dtype=np.float32)
    assert len(others) + len(got.head) == 3  # a, b and d
    assert got.learned.model.emit.sum(axis=0) + sum(others.values(), np.zeros(hmm_scoring.STATES)) / got.learned.total == pytest.approx(np.ones(hmm_scoring.STATES), rel=1e-5)


@pytest.mark.parametrize("block", [200])
def test_scores_do_not_depend_on_blocks(spark, monkeypatch, block):
    docs = spark.createDataFrame([(i, edge.prose(i % 90, 30)) for i in range(200)], "doc_id long, text string")
    expected = {r["doc_id"]: r["score"] for r in hmm_scoring.score(docs, "doc_id % 10 <> 0", 50).collect()}
    monkeypatch.setattr(hmm_scoring, "_BLOCK", block)
    got = {r["doc_id"]: r["score"] for r in hmm_scoring.score(docs, docs.where("doc_id % 10 <> 0"), 10).collect()}
    assert got == pytest.approx(expected, abs=1e-3)


def test_rows_of_a_block_are_packed_without_collecting_them(spark):
    """Also where a block's rows come in several batches."""
    rows = spark.range(30_000).select((F.col("id") % 3).alias("block"), F.col("id").cast("int").alias("at"), (F.col("id") * 7).alias("c"))
    out = hmm_scoring._by_block(rows, "c", lambda c: c.to_numpy())
    assert "collect_list" not in out._jdf.queryExecution().toString()
    got = {r["block"]: dict(zip(np.frombuffer(r["ats"], dtype=np.int32).tolist(), np.frombuffer(r["c"], dtype=np.int64).tolist(), strict=True)) for r in out.collect()}
    assert got == {b: {i: 7 * i for i in range(b, 30_000, 3)} for b in range(3)} and out.count() == 3


def test_query_counts_against_brute_force(spark, sf_dir):
    docs = {r["doc_id"]: hmm_scoring.tokens(r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    train = [t for i, t in docs.items() if crc32(str(i).encode()) % 10]
    counts = Counter(w for t in train for w in t)
    n, v = sum(counts.values()) + len(train), len(counts) + 1
    log = lambda c: math.log10((c + 0.1) / (n + 0.1 * (v + 1)))
    rows = hmm_scoring.query(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    held = [0.0, 0.0]
    for r in rows:
        t = docs[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(t) + 1, sum(w in counts for w in t) + 1, n)
        assert r["base_score"] == pytest.approx(sum(log(counts.get(w, 0)) for w in t) + log(len(train)))
        if r["held_out"]:
            held = [held[0] + r["base_score"], held[1] + r["score"]]
    assert held[1] > held[0]  # the model says more about unseen texts than the base does
