"""Homomorphic multiset hashes of documents.

A text is the multiset of its paragraphs: its lines, and within a line its sentences. Each paragraph is hashed to a
vector of ``SUMS * LANES`` digits of ``DIGIT_BITS`` bits, and a document's fingerprint is the sum of its vectors and
its number of paragraphs. Digits lie ``LANE_BITS`` apart in words that are added modulo 2^60, so the fingerprint does
not depend on the paragraphs' order, and adding or subtracting a vector inserts or deletes its paragraph.

The likeness of two fingerprints is 2 <a, b> / (<a, a> + <b, b>), where the products of the two multisets are
estimated from centred digits: digits of different paragraphs are independent, so the squared difference of two
sums grows with the number of paragraphs that only one of them has. Equal fingerprints have likeness 1.

Everything is DataFrame expressions. Neighbours by descending id are found without ordering the table as a whole:
rows are cut into ranges of ids, and each range also gets the first row of the next one. Ranges that hold too many rows
are cut again, however unevenly ids lie; rows of one id, or of none, are cut by the hash of their text.

Cases: a null text is an empty one, whose fingerprint is zero; two empty texts have likeness 1, an empty and another
0; repeated ids are neighbours in the order of their texts' hashes; null ids come last; rows that repeat an id and its
text are interchangeable and stay in one range; a single row is its own next; an empty table gives no rows; other
columns are not read; a text with any number of paragraphs is summed in chunks, so that no sum overflows.
"""

from __future__ import annotations

import decimal

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenfold.llm import common

SUMS = 16
LANES = 4
LANE_BITS = 15
DIGIT_BITS = 3
MODULUS = 1 << (LANES * LANE_BITS)
#: Paragraphs whose sum stays in a long: (2^3 - 1) 2^45 each.
CHUNK = 16_384
#: Parts that a range of ids is cut into; a range of over ``FULL`` times the rows of an even one is cut again.
RANGES = 8192
FULL = 4
PIECES = 16
PARAGRAPH = r"\n+|(?<=[.!?])[ \t]+"
_MASK = sum(((1 << DIGIT_BITS) - 1) << (LANE_BITS * i) for i in range(LANES))
_WORDS = [f"w{i}" for i in range(SUMS)]


def vector_of(paragraph: Column) -> list[Column]:
    """The words of a paragraph's vector; zero for an empty one."""
    digest = F.sha1(paragraph.cast("binary"))
    return [_word(digest, i) * (paragraph != "").cast("bigint") for i in range(SUMS)]


def _word(digest: Column, i: int) -> Column:
    return F.xxhash64(F.lit(i), digest).bitwiseAND(_MASK)  # the number comes first, so that words collide apart


def fingerprints(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys`` and the fingerprint ``print`` (paragraphs, words) of each row; ``keys`` name rows uniquely."""
    split = texts.select(*keys, F.posexplode(F.split(F.coalesce(text, F.lit("")), PARAGRAPH)).alias("pos", "paragraph"))
    chunk = F.floor(F.col("pos") / CHUNK).alias("chunk")
    one = split.select(*keys, chunk, F.col("paragraph").alias("p"), F.sha1(F.col("paragraph").cast("binary")).alias("digest"))
    filled = (F.col("p") != "").cast("bigint")
    word = lambda i: F.sum(_word(F.col("digest"), i) * filled)
    sums = one.groupBy(*keys, "chunk").agg(F.sum(filled).alias("paragraphs"), *[word(i).alias(w) for i, w in enumerate(_WORDS)])
    total = lambda w: (F.sum(F.col(w).cast("decimal(20,0)")) % F.lit(MODULUS)).cast("bigint")
    added = sums.groupBy(*keys).agg(F.sum("paragraphs").alias("paragraphs"), *[total(w).alias(w) for w in _WORDS])
    return added.select(*keys, F.struct("paragraphs", F.array(*_WORDS).alias("words")).alias("print"))


def insert(fingerprint: list[int], vector: list[int]) -> list[int]:
    """A fingerprint's words with a paragraph added; ``delete`` undoes it."""
    return [(a + b) % MODULUS for a, b in zip(fingerprint, vector)]


def delete(fingerprint: list[int], vector: list[int]) -> list[int]:
    return [(a - b) % MODULUS for a, b in zip(fingerprint, vector)]


def _squares(words: Column, paragraphs: Column) -> Column:
    """Sum over all digits of the squared centred sums; of fingerprints or of their differences."""
    expected = paragraphs * (((1 << DIGIT_BITS) - 1) / 2)
    ones, half = sum(1 << (LANE_BITS * i) for i in range(LANES)), 1 << (LANE_BITS - 1)

    def total(x: Column) -> Column:
        def step(acc: Column, word: Column) -> Column:
            lane = lambda i: F.shiftrightunsigned(word, LANE_BITS * i).bitwiseAND((1 << LANE_BITS) - 1) - half - x["part"]
            return acc + sum((lane(i) * lane(i) for i in range(1, LANES)), lane(0) * lane(0))

        # what every lane is expected to hold is taken off first, so that what is left is small and may be negative
        centred = F.transform(words, lambda w: F.pmod(w + x["shift"], F.lit(MODULUS)))
        return F.aggregate(centred, F.lit(0.0), step)

    whole = F.floor(expected)
    shift = F.lit(half * ones) - F.pmod(whole, F.lit(1 << LANE_BITS)) * ones
    return F.transform(F.array(F.struct(shift.alias("shift"), (expected - whole).alias("part"))), total)[0]


def likeness(a: Column, b: Column) -> Column:
    """Likeness (0 to 1) of two fingerprints (paragraphs, words)."""
    n, m = a["paragraphs"].cast("double"), b["paragraphs"].cast("double")
    apart = _squares(F.zip_with(a["words"], b["words"], lambda x, y: x - y), n - m)
    both = _squares(a["words"], n) + _squares(b["words"], m)
    raw = F.transform(F.array(both), lambda x: F.when(x > 0, (x - apart) / x).otherwise(F.lit(0.0)))[0]
    same = (n == m) & (a["words"] == b["words"])
    return F.when(same, F.lit(1.0)).when((n == 0) | (m == 0), F.lit(0.0)).otherwise(F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0)))


def written(fingerprint: Column) -> Column:
    """The fingerprint as text: the number of paragraphs and the words in hexadecimal."""
    return F.concat_ws(":", F.hex(fingerprint["paragraphs"]), F.array_join(F.transform(fingerprint["words"], lambda w: F.lpad(F.hex(w), 15, "0")), ""))


def _ranges(rows: DataFrame, parts: int) -> DataFrame:
    """``rows`` (doc_id, text, h) with ``low``, the end of the range of ids, and ``part``, the part by hash in it.

    Ids are placed as distances below the highest one, in decimals, since the span of two longs need not be one. A range
    of too many rows is cut in twice as many pieces as would do for even ids, ``PIECES`` at least, until none is left.
    There are at most parts / FULL such ranges, so a step adds no more than PIECES * parts / FULL ranges, and a width of 64
    bits takes 64 / log2(PIECES) steps at most: 524,288 ranges however ids lie, against 8,192 where they lie evenly.
    """
    n, top, bottom = rows.agg(F.count("*"), F.max("doc_id"), F.min("doc_id")).first()
    top, width = (0, 1) if top is None else (top, (top - bottom) // parts + 1)
    number = lambda x: F.lit(str(x)).cast("decimal(20,0)")
    below = number(top) - F.col("doc_id").cast("decimal(20,0)")
    cut = lambda base, w: (base + F.floor((below - base) / w) * w).cast("decimal(20,0)")
    rows = rows.withColumn("low", cut(number(0), number(width))).withColumn("width", number(width))
    most = max(FULL * n // parts, 1)
    spark = rows.sparkSession

    def overfull() -> list:
        """The ranges of too many rows: at most parts / FULL, whatever the data, so they are listed on the driver."""
        return rows.groupBy("low", "width").agg(F.count("*").alias("n")).where(F.col("n") > most).collect()

    full = overfull()
    while again := [r for r in full if r["low"] is not None and r["width"] > 1]:
        pieces = [max(2 * -(-r["n"] // most), PIECES) for r in again]
        finer = [(r["low"], r["width"], (int(r["width"]) - 1) // k + 1) for r, k in zip(again, pieces)]
        steps = spark.createDataFrame([(low, w, decimal.Decimal(f)) for low, w, f in finer], "low decimal(20,0), width decimal(20,0), finer decimal(20,0)")
        rows = rows.join(F.broadcast(steps), ["low", "width"], "left")
        low = F.when(F.col("finer").isNotNull(), cut(F.col("low"), F.col("finer"))).otherwise(F.col("low"))
        rows = rows.select("doc_id", "text", "h", low.alias("low"), F.coalesce("finer", "width").alias("width"))
        full = overfull()
    # only ranges of one id, or of none, are still over-full
    left = spark.createDataFrame([(r["low"], -(-r["n"] // most)) for r in full], "full_low decimal(20,0), pieces bigint")
    rows = rows.join(F.broadcast(left), F.col("low").eqNullSafe(F.col("full_low")), "left")
    part = F.floor((F.col("h") / float(1 << 64) + 0.5) * F.coalesce("pieces", F.lit(1)))
    return rows.select("doc_id", "text", "h", "low", F.least(part, F.coalesce("pieces", F.lit(1)) - 1).cast("int").alias("part"))


def with_next(docs: DataFrame, parts: int = RANGES) -> DataFrame:
    """doc_id, text and the row's place (``range``, ``at``) and ``next_text`` in the order of descending ids.

    The first row of every range is also there at the end of the range before it, with ``extra``.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = _ranges(rows.withColumn("h", F.xxhash64("text")), parts)
    rows = rows.withColumn("range", F.concat_ws(":", F.coalesce(F.col("low").cast("string"), F.lit("none")), "part"))
    # one row for each range, whose number ``_ranges`` bounds: windows over these need no partition and the join can be broadcast
    first = F.max(F.struct("doc_id", F.bitwise_not("h").alias("g"))).alias("first")
    ranges = rows.groupBy("range", "low", "part").agg(first)
    every = Window.orderBy(F.col("low").asc_nulls_last(), "part")
    before = F.coalesce(F.lag("range").over(every), F.last("range").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    ranges = ranges.select(F.col("range").alias("own"), F.col("first.doc_id").alias("first_id"), F.bitwise_not("first.g").alias("first_h"), before.alias("before"))
    at_first = (F.col("range") == F.col("own")) & (F.col("h") == F.col("first_h")) & F.col("doc_id").eqNullSafe(F.col("first_id"))
    firsts = rows.join(F.broadcast(ranges), at_first)
    both = rows.select("doc_id", "text", "h", "range", F.lit(0).alias("extra")).union(firsts.select("doc_id", "text", "h", "before", F.lit(1)))
    order = Window.partitionBy("range").orderBy("extra", F.col("doc_id").desc_nulls_last(), "h")
    return both.select("doc_id", "text", "range", "extra", F.row_number().over(order).alias("at"), F.lead("text").over(order).alias("next_text"))


def op6_multiset_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_next(common.read_table(spark, sf_dir, "documents"))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.when(F.col("extra") == 0, F.concat(F.substr("text", F.lit(1), n - half), F.substr("next_text", F.lit(1), half)))
    rows = rows.withColumn("edited", edited)
    about = rows.select("range", "at", "extra", "doc_id", n.cast("bigint").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
                        F.array(F.col("text"), F.col("edited")).alias("texts"))
    keys = ["range", "at", "which", "extra", "doc_id", "n_chars", "edited_sha256"]
    flat = about.select("range", "at", "extra", "doc_id", "n_chars", "edited_sha256", F.posexplode("texts").alias("which", "t")).where("t is not null")
    prints = fingerprints(flat, keys, "t")
    # both prints of a row are in one task, next to each other in the order of (at, which)
    order = Window.partitionBy("range").orderBy("at", "which")
    own, changed, following = F.col("print"), F.lead("print", 1).over(order).alias("changed"), F.lead("print", 2).over(order).alias("next")
    rows = prints.select(*keys, own, changed, following).where("which = 0 and extra = 0")
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", written(F.col("print")).alias("fingerprint"), written(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("print"), F.col("changed")).alias("near_edited"), likeness(F.col("print"), F.col("next")).alias("near_next"),
    )
