"""Jaccard components and fingerprints against brute force; the masked model against its own definition."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.llm import fingerprints, jaccard, masked_lm

SPACE = re.compile("[^ \t\n\x0b\x0c\r]+")


def near_copies(seed, n=200, vocabulary=400):
    """Originals, near copies with a few words changed, shared passages, exact copies and odd rows."""
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)]
    passage = [rnd.choice(words) for _ in range(25)]
    texts = []
    for _ in range(n // 4):
        text = [rnd.choice(words) for _ in range(rnd.randint(1, 120))]
        if rnd.random() < 0.4:
            text[len(text) // 2 : len(text) // 2] = passage
        texts.append(text)
    while len(texts) < n:
        text = list(rnd.choice(texts))
        for _ in range(rnd.choice([0, 1, 1, 2, 3])):
            text[rnd.randrange(len(text))] = rnd.choice(words)
        texts.append(text)
    rnd.shuffle(texts)
    rows = [(i * 7 % 1009, " ".join(t).upper() if i % 5 == 0 else "\n".join(t), "c") for i, t in enumerate(texts)]
    return [*rows, (2000, None, "c"), (2001, "", "c"), (2002, " \t\n", "c"), (2003, "one two", "c"), (2004, "ONE\ttwo", "c"), (2004, "one two", "c"),
            rows[0], (2005, "a\xa0b c\x85d É é", "c"), (None, rows[1][1], "c")]


def sets_of(rows, k):
    out = []
    for doc_id, text, _ in rows:
        words = SPACE.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        out.append((doc_id, {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()))
    return out


def brute(rows, k, num, den):
    sets = sets_of(rows, k)
    group = list(range(len(sets)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and den * len(a & b) >= num * len(a | b):
                group[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(s), least.get(find(i), d)) for i, (d, s) in enumerate(sets)), key=str)


@pytest.mark.parametrize(("k", "least", "rare", "few", "seed"), [(3, (90, 100), 8, 16, 1), (5, (4, 5), 2, 3, 2), (2, (4, 5), 0, 2, 4)])
def test_components_equal_brute_force(spark, k, least, rare, few, seed):
    rows = near_copies(seed)
    frame = spark.createDataFrame(rows, "doc_id long, text string, n_shingles string").repartition(3)
    got = jaccard.jaccard_components(frame, k, least, rare, few)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()), key=str) == brute(rows, k, *least)


def test_large_group_of_near_copies(spark):
    base = [f"x{i}" for i in range(60)]
    texts = []
    for i in range(150):
        t = list(base)
        t[i % 60] = f"y{i}"
        texts.append(" ".join(t))
    rows = [(i, t, "c") for i, t in enumerate(texts)]
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string, c string"))
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()), key=str) == brute(rows, 3, 90, 100)


def test_one_of_each_group_stays(spark):
    rows = near_copies(6, 120)
    frame = spark.createDataFrame(rows, "doc_id long, text string, _extra string")
    kept = jaccard.keep_one(frame, 3, (90, 100)).collect()
    found = brute(rows, 3, 90, 100)  # the row without an id is a copy of one that has an id
    ids = sorted({d for d, _, c in found if d is not None and d == c})
    assert sorted(r.doc_id for r in kept) == ids
    lone = spark.createDataFrame([(None, "a b c d e", "x"), (None, "a b c d e", "y"), (None, None, "z")], "doc_id long, text string, key string")
    assert sorted(str(r.text) for r in jaccard.keep_one(lone, 3, (90, 100)).collect()) == ["None", "a b c d e"]
    assert jaccard.jaccard_components(frame.limit(0)).count() == 0
    assert kept[0].asDict().keys() == {"doc_id", "text", "_extra"}


def doc_rows():
    rnd = random.Random(9)
    sentence = lambda: " ".join(rnd.choice(["alpha", "beta", "gé", "🙂x", "delta"]) for _ in range(6)) + rnd.choice([".", "!", "?"])
    docs = [(i * 3, "\n".join(" ".join(sentence() for _ in range(rnd.randint(1, 6))) for _ in range(rnd.randint(1, 8)))) for i in range(120)]
    return [*docs, (1000, None), (1001, ""), (1002, "x"), (-5, "ab"), (2**62, "far away. yes."), (1003, "A. " * 40_000)]


def test_fingerprint_rows(spark, tmp_path):
    rows = doc_rows()
    spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, range string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in fingerprints.op6_multiset_hash(spark, str(tmp_path)).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    assert len(got) == len(rows)
    gaps = []
    for i, (doc_id, text) in enumerate(order):
        text, following = text or "", order[(i + 1) % len(order)]
        half = len(text) // 2
        edited = text[: len(text) - half] + (following[1] or "")[:half]
        r = got[doc_id]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.edited_fingerprint == r.fingerprint) == (edited == text) or len(text) < 10
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if r.fingerprint == got[following[0]].fingerprint:
            assert r.near_next == 1
        parts = lambda t: [p for p in re.split(fingerprints.PARAGRAPH, t) if p]
        a, b = parts(text), parts(edited)
        if len(a) > 8 and doc_id != 1003:
            true = 2 * len(set(a) & set(b)) / (len(a) + len(b))
            gaps.append(r.near_edited - true)
    assert abs(np.mean(gaps)) < 0.1 and np.std(gaps) < 0.25


def test_next_row_under_uneven_ids(spark):
    ids = [*range(600), 10**12, -(2**63), 2**63 - 1, *range(5 * 10**11, 5 * 10**11 + 300), *[77] * 400, *[None] * 500]
    random.Random(4).shuffle(ids)
    rows = [(d, f"text {i}") for i, d in enumerate(ids)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = fingerprints.with_next(frame, 512)
    own = got.where("extra = 0").withColumn("h", F.xxhash64("text")).collect()
    assert sorted(r.text for r in own) == sorted(t for _, t in rows)
    order = sorted(own, key=lambda r: (r.doc_id is None, -(r.doc_id or 0), r.h))
    assert [r.next_text for r in order] == [r.text for r in order[1:] + order[:1]]
    assert max(r["count"] for r in got.groupBy("range").count().collect()) < 60  # of 1,803 rows; one range held nearly all before
    for few in (frame.limit(1), spark.createDataFrame([(None, None)], "doc_id long, text string")):
        one = fingerprints.with_next(few).where("extra = 0").collect()
        assert [r.next_text for r in one] == [r.text for r in one]
    same = spark.createDataFrame([(1, "a")] * 3 + [(0, "b")], "doc_id long, text string")
    assert sorted(r.next_text for r in fingerprints.with_next(same).where("extra = 0").collect()) == ["a", "a", "a", "b"]
    assert fingerprints.with_next(frame.limit(0)).count() == 0


def test_sums_insert_and_delete(spark):
    p = ["one.", "two.", "three.", "one."]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate([" ".join(p), "\n".join(reversed(p)), "one. two. three."])], "id long, t string")
    got = {r.id: r.print.words for r in fingerprints.fingerprints(frame, ["id"], "t").collect()}
    vector = list(spark.range(1).select(*[v.alias(f"v{i}") for i, v in enumerate(fingerprints.vector_of(F.lit("one.")))]).first())
    assert got[0] == got[1] != got[2]
    assert fingerprints.insert(got[2], vector) == got[0] and fingerprints.delete(got[0], vector) == got[2]


def test_likelihood_sums_to_one_and_learns(spark):
    rnd = random.Random(2)
    sets = [["a", "b", "c", "d"], ["w", "x", "y", "z"]]
    docs = [(i, " ".join(sets[i % 2][(j + i) % 4] for j in range(60)), "c") for i in range(300)]
    shuffled = [(1000 + i, " ".join(rnd.sample("abcdwxyz", 8) * 7), "c") for i in range(3)]
    odd = [(2000, None, "c"), (2001, "", "c"), (2002, "a b " * 30_000, "c"), (None, "a b", "c"), (5, "a b c", "c")]
    frame = spark.createDataFrame(docs + shuffled + odd, "doc_id long, text string, ids string").repartition(3)
    words = masked_lm.vocabulary(masked_lm.word_counts(frame))
    table = masked_lm.encoded(frame, words)
    net = masked_lm.train(table, words, stride=1)
    got = masked_lm.score(table, words, net).collect()
    assert len(got) == len(docs + shuffled + odd)
    per = {r.doc_id: r.per_token for r in got}
    assert np.mean([per[i] for i in range(300) if i != 5]) > max(per[1000 + i] for i in range(3)) + 0.3
    assert all((r.n_tokens, r.log_likelihood, r.per_token) == (0, 0.0, None) for r in got if r.doc_id in (2000, 2001))
    near = masked_lm.neighbours(np.pad(words.encode("a b c d a"), 2), np.array([2]))
    by_class = np.exp(net.forward(near)[2][0])
    assert by_class.sum() == pytest.approx(1, abs=1e-4)
    inside = np.bincount(words.classes[1 : masked_lm.VOCABULARY + 1], np.exp(words.log_share[1 : masked_lm.VOCABULARY + 1]), masked_lm.CLASSES)
    assert inside[words.classes[words.ids["a"]]] == pytest.approx(1, abs=0.1)
    assert masked_lm.score(table.limit(0), words, masked_lm.train(table.limit(0), words)).count() == 0


def test_trains_on_every_window(spark):
    texts = [" ".join(["a", "b"] * 4)[: max(0, 2 * i - 1)] for i in range(8)]  # row i has i tokens
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    words = masked_lm.vocabulary(masked_lm.word_counts(frame))
    net = masked_lm.train(masked_lm.encoded(frame, words).coalesce(1), words)
    assert not np.array_equal(net.weights["w2"], masked_lm.Network(words).weights["w2"])
    assert net.windows == sum(range(8))
    near = np.array([[0, 0, 1, 2], [1, 2, 0, 0], [2, 1, 1, 2]])
    assert net.log_of(near, np.array([0, 1, 0])) == pytest.approx(net.forward(near)[2][[0, 1, 2], [0, 1, 0]], abs=1e-5)


def test_words_beyond_the_vocabulary_have_their_own_counts(spark, tmp_path):
    filler = " ".join(f"w{i} w{i} w{i} w{i} w{i} w{i}" for i in range(masked_lm.VOCABULARY))
    beyond = masked_lm.Words({}, None, None, None).encode
    same = [w for w in (f"r{i}" for i in range(20_000)) if beyond(w) == beyond("often")][:1]  # of the bucket of "often"
    long = "l" * 50
    texts = [filler, *["often"] * 4, *same, None, *[long] * 3, f"{long} often {long}"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    rows = masked_lm.op4_masked_likelihood(spark, str(tmp_path)).collect()
    assert len(rows) == len(texts)
    got = {r.doc_id: r.log_likelihood for r in rows}
    assert got[1] - got[5] == pytest.approx(np.log(5 / 1), abs=1e-6) and got[1] == got[2] and got[6] == 0
    counts = masked_lm.word_counts(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    words = masked_lm.vocabulary(counts)
    n = {r.word: r.n for r in counts.where("n < 6").collect()}
    assert n == {"often": 5, same[0]: 1, long: 5}
    members = [(words.encode(w)[0], k) for w, k in [*n.items(), *((w, 6) for w in words.ids)]]
    inside = np.bincount([words.classes[i] for i, _ in members], [np.exp(words.log_share[i]) * (k if i > masked_lm.VOCABULARY else 1) for i, k in members])
    assert inside[inside > 0] == pytest.approx(1, abs=1e-2)


def test_tokens_are_counted_where_they_are_and_not_joined_with_their_counts(spark):
    b = jaccard.Bounds(90, 100)
    sets = spark.createDataFrame([(1, 1, 20, 5, [1, 2, 3]), (2, 2, 20, 6, [2, 3, 4])], "key bigint, doc_id bigint, n int, node bigint, tokens array<bigint>")
    for rows in (jaccard._survivors(sets, b), jaccard._signatures(sets.select("node", "n", "tokens"), b, 8)):
        assert not [line for line in rows._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in line and "token" in line]


def test_texts_are_not_moved_to_drop_copies(spark):
    rows = near_copies(7, 60)
    frame = spark.createDataFrame(rows, "doc_id long, text string, c string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # the keys of a large table are beyond it too
    try:
        kept = jaccard.keep_one(frame, 3, (90, 100))
        plan = kept._jdf.queryExecution().executedPlan().toString()
        ids = sorted(r.doc_id for r in kept.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert ids == sorted({d for d, _, c in brute(rows, 3, 90, 100) if d is not None and d == c})


def test_a_step_follows_the_gradient(spark):
    words = masked_lm.Words({}, np.arange(1 + masked_lm.VOCABULARY + masked_lm.BUCKETS) % masked_lm.CLASSES, None, np.full(masked_lm.CLASSES, 1 / masked_lm.CLASSES))
    rng = np.random.default_rng(3)
    near, target = rng.integers(0, 40, (64, 2 * masked_lm.SIDE)), rng.integers(0, masked_lm.CLASSES, 64)
    for bias in (0, 200):  # scores of 200 leave the range of single exponentials
        net = masked_lm.Network(words)
        net.weights["b2"] += np.float32(bias)
        net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
        loss = lambda: -net.forward(near)[2][np.arange(64), target].mean()
        assert net.log_of(near, target) == pytest.approx(net.forward(near)[2][np.arange(64), target], abs=1e-4)
        slopes = {}
        for name, at in (("embed", (int(near[0, 0]), 1)), ("w1", (3, 5)), ("b1", (4,)), ("w2", (6, int(target[0]))), ("b2", (int(target[1]),))):
            own, up = net.weights[name][at], []
            for d in (1e-5, -1e-5):
                net.weights[name][at] = own + d
                up.append(loss())
            net.weights[name][at] = own
            slopes[name] = (at, (up[0] - up[1]) / 2e-5)
        squares = {k: np.zeros_like(v) for k, v in net.weights.items()}
        net.train(near, target, squares)
        for name, (at, slope) in slopes.items():
            assert np.sqrt(squares[name][at]) == pytest.approx(abs(slope), rel=1e-2, abs=1e-6), name
        assert not squares["embed"][50:].any()
