"""Secret scanning: fixed patterns, and a battery of randomness tests on every other long token.

A token is a run of at least ``LEAST`` characters of the usual encodings. Its encoding (decimal, hexadecimal, base 32,
letters and digits, base 64) is inferred from its characters and gives each character a number. The battery asks two
questions of a token:

* Can it be random? Chi-squared over the whole inferred alphabet (with the exact mean and variance that it has in short
  tokens), runs above and below the alphabet's middle, and lag-1 serial correlation; Fisher's method joins their
  p-values. Below ``FLOOR_P`` the token has structure and is ordinary.
* Can it be ordinary? Words and identifiers change rarely between small letters, capitals, digits and signs, and use
  letters as prose does. The chance of as many runs of one kind is divided by the likelihood ratio of even letters
  against those of prose, which gives a p-value again.

A token that can be random is a secret if the second p-value is small enough for its class of length: Benjamini and
Hochberg's rule, applied to all scored tokens of the corpus in that class, bounds the share of ordinary tokens among
those called secrets by ``FDR``. Randomness has thus to be shown: short tokens, and numbers, for which every digit
string looks alike, are not called secrets. The values of base spans are scored too, and count in that rule; the spans
stay whatever their score.

Everything is DataFrame expressions; the corpus-wide part is a histogram of p-values of a fixed size.

Cases: a null text is an empty one and has no spans; texts of any length are scanned whole; equal texts have equal
spans within one corpus; repeated rows give a row each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm import common

KINDS = ("assign", "access", "hex", "random")
# fixed values: the base patterns
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
LEAST_ASSIGN = 8

LEAST = 12
TOKEN = rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{LEAST},}}"
ENCODINGS = [
    ("decimal", r"^[0-9]+$", string.digits),
    ("hex", r"^[0-9a-f]+$", string.digits + "abcdef"),
    ("hex_upper", r"^[0-9A-F]+$", string.digits + "ABCDEF"),
    ("base32", r"^[A-Z2-7]+$", string.ascii_uppercase + "234567"),
    ("lower", r"^[a-z0-9]+$", string.digits + string.ascii_lowercase),
    ("upper", r"^[A-Z0-9]+$", string.digits + string.ascii_uppercase),
    ("alnum", r"^[A-Za-z0-9]+$", string.digits + string.ascii_uppercase + string.ascii_lowercase),
    ("base64", "", string.digits + string.ascii_uppercase + string.ascii_lowercase + "+/"),
]
#: Letters a to z in ordinary prose, per thousand; rare ones at 10, since languages differ most in these.
PROSE = (82, 15, 28, 43, 127, 22, 20, 61, 70, 10, 10, 40, 24, 67, 75, 19, 10, 60, 63, 91, 28, 10, 24, 10, 20, 10)
#: What changes kind less often than this, per character, is ordinary.
CHANGES = 0.25
KIND_RUN = "[A-Z]?[a-z]+|[A-Z]+|[0-9]+|[^A-Za-z0-9]"
FDR = 0.05
#: Tokens that are random with a smaller p-value than this have structure.
FLOOR_P = 1e-3
LENGTH_CLASSES = (16, 20, 28, 40, 64)
P_BINS = 60
#: Matches whose positions are summed in one go.
BLOCK = 256
SPAN = "struct<start:bigint,kind:int,end:bigint>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.transform(F.array(value), body)[0]


def matches(text: Column, pattern: str) -> Column:
    """Array of (start, end, match) of all matches of a pattern that never matches nothing, in code points."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    empty = F.array().cast("array<struct<start:bigint,end:bigint,match:string>>")

    def place(steps: Column, at: Column) -> Column:
        first = F.struct(at.alias("at"), empty.alias("out"))

        def step(acc: Column, s: Column) -> Column:
            start = acc["at"] + s["gap"]
            end = start + F.length(s["match"])
            one = F.struct(start.alias("start"), end.alias("end"), s["match"].alias("match"))
            return F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

        return F.aggregate(steps, first, step)

    def walk(m: Column) -> Column:
        gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g).cast("bigint"))
        steps = F.zip_with(m, gaps, lambda x, g: F.struct(g.alias("gap"), x.alias("match")))
        steps = F.filter(steps, lambda s: s["match"].isNotNull())
        # appending copies, so matches are placed block by block
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(m) - 1) / BLOCK).cast("int")), lambda i: F.slice(steps, i * BLOCK + 1, BLOCK))
        nested = F.array().cast("array<array<struct<start:bigint,end:bigint,match:string>>>")
        begin = F.struct(F.lit(0).cast("bigint").alias("at"), nested.alias("out"))
        join = lambda acc, b: let(place(b, acc["at"]), lambda p: F.struct(p["at"].alias("at"), F.concat(acc["out"], F.array(p["out"])).alias("out")))
        return F.flatten(F.aggregate(blocks, begin, join)["out"])

    return F.when(text.rlike(pattern), let(found, walk)).otherwise(empty)


def _span(kind: int) -> Callable[[Column], Column]:
    return lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end"))


def base_spans(text: Column) -> Column:
    """Spans of the three base kinds, by start and then kind."""
    assign = matches(text, ASSIGN)
    value = lambda m: F.regexp_extract(m["match"], ASSIGN, 2)
    assign = F.filter(assign, lambda m: F.length(value(m)) >= LEAST_ASSIGN)
    return F.array_sort(
        F.concat(F.transform(assign, _span(0)), F.transform(matches(text, ACCESS), _span(1)), F.transform(matches(text, HEX), _span(2)))
    )


def _upper_tail(z: Column) -> Column:
    """P(Z > z) of the standard normal, by a logistic curve that is within 2e-4 of it."""
    z = F.least(F.greatest(z, F.lit(-8.0)), F.lit(8.0))
    return 1 / (1 + F.exp(1.5976 * z + 0.07056 * z * z * z))


def _two_sided(z: Column) -> Column:
    return F.least(2 * _upper_tail(F.abs(z)), F.lit(1.0))


def _body(token: Column) -> Column:
    return F.regexp_replace(F.translate(token, "-_", "+/"), "=+$", "")


def randomness(token: Column) -> Column:
    """p-value of uniformity, runs and serial correlation: small if the token is not random for its encoding."""

    def alphabet(b: Column) -> Column:
        out = None
        for _, pattern, letters in ENCODINGS:
            fits = b.rlike(pattern) if pattern else F.lit(True)
            out = F.when(fits, F.lit(letters)) if out is None else out.when(fits, F.lit(letters))
        return out

    def tests(x: Column) -> Column:
        n, k, v = F.size(x["v"]).cast("double"), x["k"].cast("double"), x["v"]
        seen = F.transform(F.sequence(F.lit(0), x["k"] - 1), lambda i: F.size(F.filter(v, lambda a: a == i)).cast("double"))
        squares = F.aggregate(seen, F.lit(0.0), lambda s, a: s + a * a)
        chi = squares * k / n - n
        # Wilson and Hilferty: the cube root of a gamma variable is nearly normal; mean k - 1, variance 2 (k - 1) (n - 1) / n
        shape = (k - 1) * n / (2 * (n - 1))
        p_chi = _upper_tail((F.pow(F.greatest(chi, F.lit(0.0)) / (k - 1), F.lit(1 / 3)) - 1 + 1 / (9 * shape)) * 3 * F.sqrt(shape))
        sides = F.transform(v, lambda a: (a * 2 >= k).cast("int"))
        high = F.aggregate(sides, F.lit(0), lambda s, a: s + a).cast("double")
        pairs = F.zip_with(F.slice(v, 1, F.size(v) - 1), F.slice(v, 2, F.size(v) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        runs = F.size(F.filter(pairs, lambda p: (p["a"] * 2 >= k) != (p["b"] * 2 >= k))) + 1.0
        expect = 2 * high * (n - high) / n + 1
        spread = (expect - 1) * (expect - 2) / (n - 1)
        p_runs = F.when(spread > 0, _two_sided((runs - expect) / F.sqrt(spread))).otherwise(1e-6)
        mean = F.aggregate(v, F.lit(0.0), lambda s, a: s + a) / n

        def serial(m: Column) -> Column:
            over = F.aggregate(pairs, F.lit(0.0), lambda s, p: s + (p["a"] - m) * (p["b"] - m))
            under = F.aggregate(v, F.lit(0.0), lambda s, a: s + (a - m) * (a - m))
            return F.when(under > 0, _two_sided(over / under * F.sqrt(n))).otherwise(1e-6)

        half = -(F.log(p_chi) + F.log(p_runs) + F.log(let(mean, serial)))
        return F.least(let(half, lambda h: F.exp(-h) * (1 + h + h * h / 2)), F.lit(1.0))

    def numbers(b: Column) -> Column:
        chars = F.filter(F.split(b, ""), lambda c: c != "")
        number = lambda a: F.transform(chars, lambda c: (F.position(c, a) - 1).cast("double"))
        return let(alphabet(b), lambda a: F.struct(F.length(a).alias("k"), number(a).alias("v")))

    return let(_body(token), lambda b: F.when(F.length(b) < LEAST, F.lit(0.0)).otherwise(let(numbers(b), tests)))


def ordinariness(token: Column) -> Column:
    """p-value of the token being ordinary: small if it changes kind too often and its letters are too even."""
    weights = F.array(*[F.lit(math.log(sum(PROSE) / 26 / n)) for n in PROSE])
    # where only a to f occur, they are compared with the a to f of prose
    narrow = math.log(sum(PROSE[:6]) / 6) - math.log(sum(PROSE) / 26)

    def changes(x: Column) -> Column:
        """The binomial tail, from the signed root of the deviance."""
        n, s = x["n"], x["s"] - 0.5
        apart = s * F.log(s / (n * CHANGES)) + (n - s) * F.log((n - s) / (n * (1 - CHANGES)))
        return F.when(s > n * CHANGES, _upper_tail(F.sqrt(2 * apart))).otherwise(1.0)

    def tests(b: Column) -> Column:
        letters = F.filter(F.split(F.lower(b), ""), lambda c: c.between("a", "z"))
        more = F.when(b.rlike("[g-zG-Z]"), 0.0).otherwise(narrow)
        ratio = F.aggregate(letters, F.lit(0.0), lambda s, c: s + F.element_at(weights, F.ascii(c) - 96) + more)
        runs = F.size(F.regexp_extract_all(b, F.lit(KIND_RUN), F.lit(0)))
        kinds = F.struct((F.length(b) - 1).cast("double").alias("n"), (runs - 1).cast("double").alias("s"))
        # a p-value divided by an independent likelihood ratio is a p-value again
        return F.least(let(kinds, changes) * F.exp(-ratio), F.lit(1.0))

    return let(_body(token), lambda b: F.when(F.length(b) < LEAST, F.lit(1.0)).otherwise(tests(b)))


def evidence(token: Column) -> Column:
    """p-value against the token being ordinary; 1 if it has structure, or if no threshold can ever admit it."""
    return let(ordinariness(token), lambda p: F.when(p > FDR, F.lit(1.0)).when(randomness(token) < FLOOR_P, F.lit(1.0)).otherwise(p))


def candidates(text: Column, base: Column) -> Column:
    """(start, end, p) of the tokens that no base span covers."""
    free = F.filter(matches(text, TOKEN), lambda m: ~F.exists(base, lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))
    return F.transform(free, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), evidence(m["match"]).alias("p")))


def base_scores(text: Column, base: Column) -> Column:
    """(start, end, p) of the value in each base span."""

    def score(b: Column) -> Column:
        whole = F.substr(text, (b["start"] + 1).cast("int"), (b["end"] - b["start"]).cast("int"))
        value = F.when(b["kind"] == 0, F.regexp_extract(whole, ASSIGN, 2)).otherwise(whole)
        return let(value, lambda v: F.struct((b["end"] - F.length(v)).alias("start"), b["end"].alias("end"), evidence(v).alias("p")))

    return F.transform(base, score)


def _length_class(n: Column) -> Column:
    out = F.lit(len(LENGTH_CLASSES))
    for i, limit in reversed(list(enumerate(LENGTH_CLASSES))):
        out = F.when(n < limit, i).otherwise(out)
    return out


def thresholds(scanned: DataFrame, fdr: float = FDR) -> dict[int, float]:
    """For each class of length the p-value up to which a token is a secret, by Benjamini and Hochberg's rule.

    p-values are counted in ``P_BINS`` bins of their logarithm, each taken at its upper end.
    """
    c = scanned.select(F.explode(F.concat("candidates", "base_scores")).alias("c")).select("c.*")
    bins = F.least(F.floor(-6 * F.log10(F.greatest("p", F.lit(1e-12)))), F.lit(P_BINS)).cast("int")
    counts = c.groupBy(_length_class(F.col("end") - F.col("start")).alias("class"), bins.alias("bin")).agg(F.count("*").alias("n")).collect()
    out = {}
    for k in range(len(LENGTH_CLASSES) + 1):  # a fixed number of classes and bins
        by_bin = {r["bin"]: r["n"] for r in counts if r["class"] == k}
        total, upto, limit = sum(by_bin.values()), 0, 0.0
        for b in sorted(by_bin, reverse=True):
            upto += by_bin[b]
            p = 10 ** (-b / 6)
            if total * p <= fdr * upto:
                limit = max(limit, p)
        out[k] = limit
    return out


def scan(docs: DataFrame) -> DataFrame:
    """``docs`` with ``base`` spans, their ``base_scores``, and ``candidates``."""
    text = F.coalesce("text", F.lit(""))
    found = docs.withColumn("base", base_spans(text))
    return found.withColumn("base_scores", base_scores(text, F.col("base"))).withColumn("candidates", candidates(text, F.col("base")))


def called(limits: dict[int, float], column: str) -> Column:
    """Those of the scored tokens that their length's threshold calls secrets."""
    limit = lambda c: F.element_at(F.array(*[F.lit(limits[k]) for k in sorted(limits)]), _length_class(c["end"] - c["start"]) + 1)
    return F.filter(column, lambda c: c["p"] <= limit(c))


def all_spans(limits: dict[int, float]) -> Column:
    """The base spans and the candidates that are called secrets, by start and then kind."""
    return F.array_sort(F.concat("base", F.transform(called(limits, "candidates"), _span(3))))


def written(spans: Column) -> Column:
    name = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"], s["end"])), ",")


def redacted(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """The text with each stretch that spans cover replaced by ``mark``."""
    first = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        kept = F.when(fresh, F.substr(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))).otherwise("")
        out = F.concat(acc["out"], kept, F.when(fresh, mark).otherwise(""))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    done = F.aggregate(spans, first, step, lambda a: F.concat(a["out"], F.substr(text, (a["at"] + 1).cast("int"))))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def op9_randomness_battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents").select("doc_id", "text")
    scanned = common.settle(scan(docs).drop("text"), "secrets")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint")
    limits = thresholds(scanned)
    return scanned.select(
        "doc_id",
        *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:3])],
        F.sha2(written(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        written(all_spans(limits)).alias("spans"),
        F.size("candidates").cast("bigint").alias("n_scored"),
        F.size(called(limits, "base_scores")).cast("bigint").alias("n_base_random"),
    )
