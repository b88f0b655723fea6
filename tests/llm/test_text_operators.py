"""Language ID, quality rules, sharding and secrets against brute force in Python, and edge cases."""

import hashlib
import math
import random
import re
import string
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.llm import langid, quality, secrets, sharding

WORDS = {
    "en": "the of and that with from this have which their would there could other about".split(),
    "de": "der die und nicht eine auch sich werden schon durch zwischen während große über".split(),
    "fr": "les des une pour dans qui avec être cette sont mais nous était où déjà".split(),
}
SPACE = re.compile("[^ \t\n\x0b\x0c\r]+")


def corpus(n=400, seed=5):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        lang = rnd.choice(list(WORDS))
        out.append((i, " ".join(rnd.choice(WORDS[lang]) for _ in range(rnd.randint(5, 60))), lang, "x"))
    return out


ODD = [(9001, None, None, "x"), (9002, "", "en", "x"), (9003, "12 34 !!", "en", "x"), (None, "the and of", None, "x"), (5, "the and of", "en", "x"),
       (9004, "the of and " * 40_000, "en", "x"), (9004, "the of and " * 40_000, "en", "x")]
DDL = "doc_id long, text string, lang string, score string"


def test_language_of_held_out_documents(spark):
    docs = spark.createDataFrame(corpus() + ODD, DDL).repartition(3)
    model = langid.fit(docs)
    got = langid.identify(docs.withColumn("held_out", langid.held_out(F.col("doc_id"))), model).collect()
    assert len(got) == len(corpus()) + len(ODD)
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.langid_score <= 1
        if r.doc_id in (9001, 9002, 9003):
            assert (r.langid_pred, r.langid_score, r.langid_rejected) == ("und", 0.0, False)
    known = [r for r in got if r.lang and r.held_out and r.langid_pred != "und"]
    assert np.mean([r.langid_pred == r.lang for r in known]) > 0.98
    assert not any(r.langid_rejected for r in got)
    noise = "".join(random.Random(1).choice("qxzjkwvyp") + " " * (i % 5 == 0) for i in range(600))
    assert langid.identify(spark.createDataFrame([(1, noise)], "doc_id long, text string"), model).first().langid_rejected


def test_language_without_labels(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    for frame in (docs, docs.limit(0)):
        assert [r.langid_pred for r in langid.identify(frame, langid.fit(frame)).collect()] == ["und"] * frame.count()


def code_of(gram):
    return sum(x << langid.BITS * (3 - i) for i, x in enumerate(gram))


def test_kneser_ney_sums_to_one():
    import pandas as pd

    table = langid.alphabet_table("abc")
    symbols, _ = langid.to_symbols(["abc abca cab", "bca acb aab"], table)
    codes, n = np.unique(langid.codes_of(symbols, 0, len(symbols)), return_counts=True)
    model = langid.kneser_ney(pd.DataFrame({"lang": "x", "code": codes.astype(int), "n": n}), "abc")
    for context in ((2, 3, 4), (4, 3, 2), (0, 0, 2), (2, 2, 2)):
        every = np.uint64(code_of((*context, 0))) + np.arange(5, dtype=np.uint64)
        assert np.exp(model.log_probs(every)[:, 0]).sum() == pytest.approx(1, abs=1e-5)


def kneser_ney_of(runs, size):
    """Interpolated Kneser-Ney from dictionaries: probability of a symbol after up to three others."""
    levels = [None, None, None, Counter()]
    for r in runs:
        for i in range(len(r)):
            g = tuple(r[max(0, i - 3) : i + 1])
            levels[3][(0,) * (4 - len(g)) + g] += 1
    for m in (2, 1, 0):
        levels[m] = Counter(g[1:] for g in levels[m + 1])

    def prob(gram):
        m = len(gram) - 1
        counts = levels[m]
        ones, twos = (sum(n == k for n in counts.values()) for k in (1, 2))
        less = ones / (ones + 2 * twos) if ones and twos else langid.DISCOUNT
        after = {g: n for g, n in counts.items() if g[:-1] == gram[:-1]}
        below = prob(gram[1:]) if m else 1 / size
        if not after:
            return below
        total = sum(after.values())
        return max(counts.get(gram, 0) - less, 0) / total + less * len(after) / total * below

    return prob


def test_kneser_ney_equals_dictionaries():
    import pandas as pd

    rnd = random.Random(9)
    text = " ".join("".join(rnd.choice("aabbbcd") for _ in range(rnd.randint(1, 6))) for _ in range(60))
    symbols, _ = langid.to_symbols([text], langid.alphabet_table("abcd"))
    codes, n = np.unique(langid.codes_of(symbols, 0, len(symbols)), return_counts=True)
    model = langid.kneser_ney(pd.DataFrame({"lang": "x", "code": codes.astype(int), "n": n}), "abcd")
    prob = kneser_ney_of([symbols.tolist()], 6)
    for _ in range(300):
        gram = tuple(rnd.randrange(6) for _ in range(4))
        code = np.array([code_of(gram)], dtype=np.uint64)
        assert np.exp(model.log_probs(code)[0, 0]) == pytest.approx(prob(gram), rel=1e-4), gram


def test_small_language_is_learnt_and_samples_are_bounded(spark):
    few = [(20_000 + i, f"zzyzx qwvut xyzzy vutsq {i}", "aa", "x") for i in range(3)]
    docs = spark.createDataFrame(corpus() + [r for r in few if zlib.crc32(str(r[0]).encode()) % 4 != 2], DDL)
    for bound in (30, 2000):
        model = langid.fit(docs, sample_docs=bound)
        assert "aa" in model.languages
        ask = spark.createDataFrame([(1, "xyzzy zzyzx qwvut")], "doc_id long, text string")
        assert langid.identify(ask, model).first().langid_pred == "aa"


def test_scripts_of_many_letters_are_told_apart(spark):
    """Two languages that share their frequent letters and differ in thousands of rare ones."""
    rnd = random.Random(5)
    rare = {"aa": range(0x4E00, 0x4E00 + 1500), "bb": range(0x6000, 0x6000 + 1500)}
    text = lambda lang: "".join(rnd.choice("的一是不了人在有") if rnd.random() < 0.5 else chr(rnd.choice(rare[lang])) for _ in range(400))
    docs = spark.createDataFrame([(i, text(lang), lang, "x") for i in range(120) for lang in ("aa", "bb")], DDL)
    model = langid.fit(docs)
    assert len(model.alphabet) > 2500
    ask = [(i, text(lang), lang) for i in range(20) for lang in ("aa", "bb")]
    got = langid.identify(spark.createDataFrame(ask, "doc_id long, text string, lang string"), model).collect()
    assert all(r.langid_pred == r.lang for r in got)


def base_of(text):
    words = SPACE.findall(text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if often[w] > 1 for j in range(5)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if SPACE.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), sum(c in quality.SYMBOLS for c in text or ""), dup, len(covered), failed


def test_base_measures_and_posterior(spark):
    rnd = random.Random(2)
    docs = [(d, " ".join(w + "".join(rnd.choices(string.ascii_lowercase, k=2)) for w in t.split())) for d, t, *_ in corpus(300)]
    docs += [(1000 + i, " ".join(f"{w}{rnd.choice(['###', '$$$', '&&&'])}" for w in t.split()) + "\n" + "A B\n\nA B\n \n") for i, t in docs[:40]]
    docs += [(2000, None), (2001, ""), (2002, "word " * 5000), (2003, "a\xa0b c\x85d e\x1cf"), (2004, "x y\n" * 30), (None, "no id"), (2001, "")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    rows = quality.measured(frame).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    want = sorted(((d, *base_of(t)[:5]) for d, t in docs), key=str)
    assert sorted(((r.doc_id, *[r[n] for n in names]) for r in rows), key=str) == want
    posterior = quality.fit(quality.measured(frame))
    kept = {r.doc_id for r in quality.keep(frame.withColumn("n_words", F.lit("clash")), posterior).collect()}
    clean = {d for d, t in docs[:300] if not base_of(t)[5]}
    assert clean <= kept
    assert not kept & {d for d, t in docs[300:] if d and d != 2003}
    assert quality.keep(frame.limit(0), {}).count() == 0 and quality.fit_votes({}) == {}


def test_em_recovers_accuracies():
    rng = np.random.default_rng(3)
    n, rules = 20_000, len(quality.RULES)
    good = rng.random(n) < 0.8
    right = rng.uniform(0.9, 0.98, rules)
    for_good = np.arange(rules) >= len(quality.DEFECTS)
    # a rule votes on most documents it should vote on, and on others as its accuracy has it
    share = np.where(for_good, good.mean(), 1 - good.mean())
    wrong = 0.6 * share * (1 - right) / right / (1 - share)
    cast = rng.random((n, rules)) < np.where(good[:, None] == for_good, 0.6, wrong)
    codes = cast @ 2 ** np.arange(rules)[::-1]
    found = quality.fit_votes(dict(Counter(codes.tolist())))
    assert np.mean((np.array([found[c] for c in codes]) >= 0.5) == good) > 0.93


def test_bytes_law_and_places(spark):
    rnd = random.Random(4)
    docs = [(i, "é" * rnd.randint(0, 4000), "c") for i in range(3000)] + [(None, None, "c"), (1, None, "c"), (1, None, "c"), (7, "x" * 9000, "c")]
    rows = sharding.records(spark.createDataFrame(docs, "doc_id long, text string, size string").repartition(3), 512)
    mapping = sharding.slot_map(rows, 512, 8)
    got = sharding.assign(rows, mapping).collect()
    assert len(got) == len(docs)
    want = sorted(((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, _ in docs), key=str)
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=str) == want
    load, places = Counter(), {}
    for r in got:
        load[r.shard] += r.size
        places.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    assert max(load.values()) - min(load.values()) < 0.002 * sum(load.values()) / 8
    versions = {v: {r.slot: r.shard for r in mapping.collect() if r.version == v} for v in (1, 2)}
    moved = sum(versions[1][s] != versions[2][s] for s in versions[1])
    assert 0 < moved < 128  # an edit, not a new deal
    empty = sharding.records(spark.createDataFrame([], "doc_id long, text string"))
    assert sharding.assign(empty, sharding.slot_map(empty)).count() == 0


def test_stored_map_is_edited_by_the_next_run(spark, tmp_path):
    store = f"file://{tmp_path}/map"
    docs = lambda n, size: spark.range(n).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), size).alias("text"))
    rows = sharding.records(docs(3000, F.col("id").cast("int") % 50), 256)
    first = {r["slot"]: r["shard"] for r in sharding.slot_map(rows, 256, 4, store).where("version = 2").collect()}
    assert sharding.stored_versions(spark, store) == [1, 2]
    more = sharding.records(docs(9000, F.when(F.col("id") % 7 == 0, 900).otherwise(3)), 256)
    mapping = sharding.slot_map(more, 256, 4, store)
    assert sharding.stored_versions(spark, store) == [1, 2, 3]
    second = {r["slot"]: r["shard"] for r in mapping.where("version = 3").collect()}
    moved = sum(first[s] != second[s] for s in first)
    assert 0 < moved < 128, "an edit moves some slots, a fresh deal would move most"
    load = [r["b"] for r in sharding.assign(more, mapping).groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert max(load) - min(load) < 0.01 * sum(load) / 4
    with pytest.raises(ValueError):
        sharding.slot_map(rows, 256, 3, store)


def secrets_of(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(out))


def test_spans_equal_python(spark):
    rnd = random.Random(8)
    bits = ["token", "TOKEN", " = ", ": ", '"', "'", "secret", "api_key", "apikey", "AKIA", "AKIAAKIA", "ABC123", "deadbeef", "0123456789abcdef" * 2, "é🙂", "=", "  ",
            "ſecret=abcdefghijk", "password:", "abcdefgh", "a.b/c_d-", "\n", "x"]
    docs = [(i, "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 14))), "c") for i in range(1500)]
    docs += [(5000, None, "c"), (None, "token=abcdefghi", "c"), (5001, "secret: abcdefgh " * 400, "c"), (3, "", "c"), (3, "", "c")]
    frame = secrets.scan(spark.createDataFrame(docs, "doc_id long, text string, spans string").repartition(3))
    got = frame.select("doc_id", "text", secrets.written(F.col("base")).alias("got"), secrets.redacted(F.col("text"), F.col("base")).alias("clean")).collect()
    assert len(got) == len(docs)
    for r in got:
        assert r.got == secrets_of(r.text or ""), repr(r.text)
        covered = bytearray(len(r.text or ""))
        for s in filter(None, r.got.split(",")):
            _, a, b = s.split(":")
            covered[int(a) : int(b)] = b"\1" * (int(b) - int(a))
        if r.text:
            left = "".join(c for c, x in zip(r.text, covered) if not x)
            assert r.clean.replace("[secret]", "") == left


def tail(z):
    return 1 / (1 + math.exp(1.5976 * min(max(z, -8), 8) + 0.07056 * min(max(z, -8), 8) ** 3))


def battery_of(token):
    """The battery in plain Python: (p-value of being random, p-value of being ordinary)."""
    body = token.replace("-", "+").replace("_", "/").rstrip("=")
    if len(body) < secrets.LEAST:
        return 0.0, 1.0
    letters = next(a for _, pattern, a in secrets.ENCODINGS if re.search(pattern, body))
    v, n, k = np.array([letters.index(c) for c in body], float), len(body), len(letters)
    chi = sum((body.count(c) - n / k) ** 2 / (n / k) for c in letters)
    shape = (k - 1) * n / (2 * (n - 1))
    p_chi = tail(((chi / (k - 1)) ** (1 / 3) - 1 + 1 / (9 * shape)) * 3 * shape**0.5)
    side = v * 2 >= k
    high = side.sum()
    expect = 2 * high * (n - high) / n + 1
    spread = (expect - 1) * (expect - 2) / (n - 1)
    p_runs = min(1, 2 * tail(abs(1 + (side[1:] != side[:-1]).sum() - expect) / spread**0.5)) if spread > 0 else 1e-6
    d = v - v.mean()
    p_serial = min(1, 2 * tail(abs((d[1:] * d[:-1]).sum() / (d * d).sum() * n**0.5))) if (d * d).sum() > 0 else 1e-6
    h = -math.log(p_chi * p_runs * p_serial)
    m, s = n - 1, len(re.findall(secrets.KIND_RUN, body)) - 1.5
    odd = 1.0
    if s > m * secrets.CHANGES:
        odd = tail((2 * (s * math.log(s / (m * secrets.CHANGES)) + (m - s) * math.log((m - s) / (m * (1 - secrets.CHANGES))))) ** 0.5)
    few = secrets.PROSE if re.search("[g-zG-Z]", body) else secrets.PROSE[:6]
    ratio = sum(math.log(sum(few) / len(few) / secrets.PROSE[ord(c) - 97]) for c in body.lower() if "a" <= c <= "z")
    return min(1, math.exp(-h) * (1 + h + h * h / 2)), min(1, odd * math.exp(min(-ratio, 600)))


ALPHABETS = [string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", string.ascii_uppercase + "234567", "0123456789ABCDEF"]
PLAIN = ["version-2024-release-notes-for-2025", "aaaaaaaaaa1111111111aaaaaaaaaa", "abcdefghijklmnopqrstuvwxyz0123456789", "chapter-one-section-2-part-three",
         "internationalisation", "Donaudampfschifffahrtsgesellschaft", "4111111111111111", "4929173500128846", "+49-170-1234567-22", "getHttpResponseForUserById",
         "2024-05-17/2025-01-02", "anticonstitutionnellement", "THE_LARGEST_CONSTANT_OF_ALL", "a1b1a1b1a1b1a1b1a1b1", "------------------", "============"]


def test_battery_equals_python(spark):
    rnd = random.Random(11)
    tokens = PLAIN[:-1] + ["".join(rnd.choice(ALPHABETS[i % 4]) for _ in range(rnd.randint(1, 90))) for i in range(200)] + ["ab12" * 2000]
    frame = spark.createDataFrame([(t,) for t in tokens], "t string")
    for r in frame.select("t", secrets.randomness(F.col("t")).alias("a"), secrets.ordinariness(F.col("t")).alias("b")).collect():
        assert (r.a, r.b) == (pytest.approx(battery_of(r.t)[0], rel=1e-6, abs=1e-12), pytest.approx(battery_of(r.t)[1], rel=1e-6, abs=1e-12)), r.t


def test_battery_finds_random_tokens_only(spark):
    rnd = random.Random(6)
    docs = [(i, "see " + "".join(rnd.choice(ALPHABETS[i % 4]) for _ in range(40)) + " here") for i in range(80)]
    docs += [(1000 + i, f"see {PLAIN[i % len(PLAIN)]} here") for i in range(320)]
    docs += [(2000 + i, "token=" + "".join(rnd.choice(ALPHABETS[i % 2]) for _ in range(40))) for i in range(40)] + [(3000, "password=helloworldhello")]
    frame = secrets.scan(spark.createDataFrame(docs, "doc_id long, text string"))
    limits = secrets.thresholds(frame)
    # the rule in plain Python, on the same p-values
    scored = [(c.p, c.end - c.start) for r in frame.collect() for c in [*r.candidates, *r.base_scores]]
    for k, (low, high) in enumerate(zip((0, *secrets.LENGTH_CLASSES), (*secrets.LENGTH_CLASSES, 10**9))):
        ps = sorted(p for p, n in scored if low <= n < high)
        exact = max((p for i, p in enumerate(ps) if p * len(ps) <= secrets.FDR * (i + 1)), default=0.0)
        assert limits[k] <= exact * 10 ** (1 / 6) + 1e-9  # bins are taken at their upper ends
    found = frame.select("doc_id", secrets.written(secrets.all_spans(limits)).alias("spans"), F.size(secrets.called(limits, "base_scores")).alias("n")).collect()
    hits = {r.doc_id for r in found if r.spans and "random" in r.spans}
    assert sum(i < 100 for i in hits) >= 72 and not any(i >= 100 for i in hits)  # recall of 0.9, no false alarm
    assert all(r.spans for r in found if r.doc_id >= 2000)
    assert sum(r.n for r in found if 2000 <= r.doc_id < 3000) >= 36 and not any(r.n for r in found if r.doc_id == 3000)
    assert secrets.scan(frame.select("doc_id", "text").limit(0)).count() == 0
