"""Exact Jaccard self-join of word shingle sets, by prefixes of single tokens and token combinations.

Write J for the least similarity, n for the size of a set, ``e(n) = n - ceil(J n)`` for the tokens that a linked
partner may lack, and ``d(n) = floor(n (1 - J) / J)`` for the most tokens that only one of the two has. In any common
order of all tokens, the first l tokens that a linked pair shares lie in the first e(n) + l tokens of either set.

1. *Survivors.* In the order of hashes, a linked set shares at least ``l(ceil(J n))`` of its first ``e(n) + l(n)``
   tokens with other sets. Sets that do not are out. Only a part of the tokens is shuffled for this.
2. *Signatures.* Of each survivor only the window of its first ``e(n) + d(n) + 2`` tokens is looked at further. The
   windows of a linked pair have their first d + 2 shared tokens in common. If one of these is rare, rare tokens are
   ordered first and one of a short prefix of them is common; each is a signature alone. If all are frequent, the
   combinations of two neighbouring frequent tokens are signatures: of the d + 1 gaps between the d + 2 shared tokens
   at most d hold another token, so one combination is common to both. There are as many combinations as tokens, not
   as many as pairs of tokens.
3. *Verification.* The sets of a signature that has at most ``FEW`` of them are compared with each other. In a larger
   one, all sets are compared with its *leader* only, the one with the fewest rare tokens, and links make components.
   A group of many copies thus costs as many comparisons as it has members.
4. *Blocks.* Larger signatures that still hold several components are merged by leader: all their sets make one block
   of the leader. Its sets are compared by sketches in *rings*: sets of similar size whose sketch is about as far from
   the leader's. Distances of sketches obey the triangle inequality, so linked sets are in
   the same or the next ring and class of size, and no link that could join two components is left out. The comparison is
   in the condition of a join, which only lets close pairs out; it still grows with the square of the sets of a ring.

A pair is compared first by *parity sketches*: tokens are hashed to ``SKETCH_WORDS * 64`` bits, and a bit is set if an
odd number of a set's tokens fall on it. Two sketches differ in at most as many bits as the sets do in tokens, so pairs
whose sketches differ too much are out before any set is moved.

Sets are known by a 64-bit hash of their tokens; equal sets are one set, however many documents have it.

Cases: null or empty texts and texts without words have an empty set and are linked with nothing; with fewer words
than a shingle, all words are the one shingle; repeated rows are documents of the same set and give a row each; an
empty table gives no rows; a null id is passed on and never is a component's id unless nothing else is; other
columns are not read. Sets of any size are compared whole. The least similarity must be 0.8 or more.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenfold.llm import common

WORDS = 3
LEAST = (90, 100)
#: Tokens of at most so many survivors' windows are rare.
RARE = 8
#: Up to so many sets of a signature are compared with each other.
FEW = 16
SKETCH_WORDS = 16
#: Tables of at most so many rows of one or two longs are sent to all tasks; larger ones are joined by a shuffle.
SENT_ROWS = 1_000_000

_M = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """Sorted hashes of the distinct shingles of a text, as signed numbers."""
    found = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not found:
        return np.zeros(0, dtype=np.int64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    k = min(words, len(found))
    out = np.full(len(h) - k + 1, k, dtype=np.uint64)
    for i in range(k):
        out = (out ^ h[i : len(h) - k + 1 + i]) * _M[i % len(_M)]
        out ^= out >> np.uint64(32)
    return np.unique(out.view(np.int64))


def parity_sketch(tokens: np.ndarray) -> np.ndarray:
    """Which bits an odd number of tokens fall on, in ``SKETCH_WORDS`` words."""
    bits = SKETCH_WORDS * 64
    odd = np.bincount(tokens & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


class Bounds:
    """The sizes that the least similarity ``num / den`` implies, for numbers and for columns."""

    def __init__(self, num: int, den: int):
        if not 0.8 <= num / den < 1:
            raise ValueError("the least similarity is from 0.8 to below 1")
        self.num, self.den = num, den

    def need(self, n):
        return self._div(self.num * n + self.den - 1, self.den)

    def lacks(self, n):
        return n - self.need(n)

    def differ(self, n):
        return self._div(n * (self.den - self.num), self.num)

    def first(self, n):
        """Shared tokens that the survivors' prefix is extended for."""
        return 1 + self._div(self.lacks(n), 2)

    def window(self, n):
        """Tokens among which a linked pair has its first ``differ + 2`` shared tokens."""
        return self.lacks(n) + self.differ(n) + 2

    def window_lacks(self, n):
        """Tokens of the window that are not in a linked partner's window."""
        return self.lacks(n) + self.differ(n) - self.differ(self.need(n))

    def size_class(self, n: Column) -> Column:
        """Linked sets are in the same class of size or in neighbouring ones."""
        return F.floor(F.log(n) / math.log(self._base)).cast("int")

    def ring_width(self, size_class: Column) -> Column:
        """At least what a set of the class may differ by from a linked set that is not smaller."""
        return F.floor(F.pow(F.lit(self._base), size_class + 1) * (self.den - self.num) / self.num) + 1

    @property
    def _base(self) -> float:
        return 1 / (self.num / self.den - 0.01)  # a little more than 1 / J, so that rounding does no harm

    @staticmethod
    def _div(a, b: int):
        return F.floor(a / b).cast("int") if isinstance(a, Column) else a // b


def _lists(values: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(v) for v in values]))).astype(np.int32)
    flat = np.concatenate(values) if values else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))


def _sets(rows: DataFrame, words: int, cut, sketched: bool = False) -> DataFrame:
    """key, n, set hash and the first ``cut(n)`` tokens, in hash order, of every row (key, text); and the sketch ``bits``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                tokens = [shingle_hashes(t, words) for t in part.column("text").to_pylist()]
                sizes = [len(t) for t in tokens]
                ids = [xxhash.xxh3_64_intdigest(t.tobytes()) for t in tokens]
                signed = pa.array(np.array(ids, dtype=np.uint64).view(np.int64), mask=np.array(sizes) == 0)
                prefixes = _lists([t[: cut(n)] for t, n in zip(tokens, sizes)])
                bits = [_lists([parity_sketch(t) for t in tokens])] if sketched else []
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("doc_id"), pa.array(sizes, pa.int32()), signed, prefixes, *bits], names=names)

    schema = "key bigint, doc_id bigint, n int, node bigint, tokens array<bigint>" + ", bits array<bigint>" * sketched
    names = [c.split()[0] for c in schema.split(", ")]
    return rows.select("key", "doc_id", "text").mapInArrow(run, schema)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.xxhash64("doc_id", "text").alias("key"), F.col("doc_id").cast("bigint"), "text")


def _survivors(sets: DataFrame, b: Bounds) -> DataFrame:
    """(node, key): one row's key for each set that may have a link."""
    tokens = sets.where(b.differ(F.col("n")) >= 1).select("node", F.explode("tokens").alias("token"))
    of_token = Window.partitionBy("token")  # tokens are shuffled once; the rows of a frequent one spill
    shared = tokens.select("node", "token", F.min("node").over(of_token).alias("lo"), F.max("node").over(of_token).alias("hi")).where("lo <> hi")
    hits = shared.select("node", "token").distinct().groupBy("node").agg(F.count("*").alias("hits"))  # equal sets count once
    about = sets.where("node is not null").groupBy("node").agg(F.min("key").alias("key"), F.max("n").alias("n"))
    return hits.join(about, "node").where(F.col("hits") >= b.first(b.need(F.col("n")))).select("node", "key")


def _sent(table: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(table) if rows <= SENT_ROWS else table


def _full_sets(keyed: DataFrame, survivors: DataFrame, words: int) -> DataFrame:
    """(node, n, tokens, bits) of the survivors, one row for each set."""
    wanted = _sent(survivors.select("key"), survivors.count())
    full = _sets(keyed.join(wanted, "key", "left_semi"), words, lambda n: n, sketched=True).select("node", "n", "tokens", "bits")
    full = common.settle(full, "full-sets")
    if full.count() == survivors.count():
        return full
    once = common.settle(full.dropDuplicates(["node"]), "full-sets")  # repeated rows
    common.release(full)
    return once


def _signatures(full: DataFrame, b: Bounds, rare: int) -> DataFrame:
    """(sig, node, odd) of the survivors' sets (node, n, tokens), with the number of its window's tokens that are not frequent."""
    n, s = F.col("n"), F.col("s")
    tokens = full.select("node", "n", F.explode(F.slice("tokens", 1, b.window(n))).alias("token"))
    shared = tokens.withColumn("df", F.count("*").over(Window.partitionBy("token"))).where("df > 1")
    known = shared.groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("s"))
    lone = F.least(n, b.window(n)) - F.size(s)  # tokens that no other window has
    is_rare = lambda x: x["df"] <= rare
    known = known.select("node", "s", lone.alias("lone"), (b.window_lacks(n) - lone).alias("lacks")).where("lacks >= 0")
    single = F.transform(F.filter(F.slice(s, 1, F.col("lacks") + 1), is_rare), lambda x: x["token"])
    wide = F.array_sort(F.transform(F.filter(s, lambda x: ~is_rare(x)), lambda x: x["token"]))  # in the order of hashes
    known = known.select("node", "lone", "lacks", single.alias("single"), wide.alias("wide"), F.size(F.filter(s, is_rare)).alias("n_rare"))
    m = F.greatest(F.size("wide") - 1, F.lit(0))
    pairs = F.zip_with(F.slice("wide", 1, m), F.slice("wide", 2, m), lambda x, y: F.xxhash64(x, y))
    pairs = F.when(F.col("n_rare") <= F.col("lacks"), pairs).otherwise(F.array().cast("array<bigint>"))
    return known.select(F.explode(F.array_distinct(F.concat("single", pairs))).alias("sig"), "node", (F.col("lone") + F.col("n_rare")).alias("odd"))


def _sides(pairs: DataFrame, full: DataFrame, column: str) -> DataFrame:
    """``pairs`` (x, y) with the sizes and the ``column`` of both sets."""
    side = lambda c: full.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col(column).alias(f"{column}_{c}"))
    return pairs.join(side("x"), "x").join(side("y"), "y")


def _apart() -> Column:
    return sum(F.bit_count(F.col("bits_x")[i].bitwiseXOR(F.col("bits_y")[i])) for i in range(SKETCH_WORDS))


def _close(b: Bounds) -> Column:
    """Whether sets x and y may be similar enough by their sizes and sketches."""
    sizes = F.least("nx", "ny") * b.den >= F.greatest("nx", "ny") * b.num
    return sizes & (_apart() * (b.den + b.num) <= (F.col("nx") + F.col("ny")) * (b.den - b.num))


def _linked(pairs: DataFrame, full: DataFrame, b: Bounds) -> DataFrame:
    """The pairs (x, y) whose sets are similar enough; only those with close sketches are settled and compared whole."""
    close = common.settle(_sides(pairs.distinct(), full, "bits").where(_close(b)).select("x", "y"), "pairs")
    inter = F.size(F.array_intersect("tokens_x", "tokens_y"))
    n = close.count()
    compared = _sent(close.select(F.explode(F.array("x", "y")).alias("node")), 2 * n)
    links = _sides(_sent(close, n), full.join(compared, "node", "left_semi"), "tokens").where(b.den * inter >= b.num * (F.col("nx") + F.col("ny") - inter)).select("x", "y")
    links = common.settle(links, "links")
    common.release(close)
    return links


def _ring_pairs(blocks: DataFrame, full: DataFrame, b: Bounds) -> DataFrame:
    """Close pairs (x, y) of different components within the blocks (sig, node, root) of leaders ``sig``."""
    rows = _sides(blocks.select("sig", "root", F.col("node").alias("x"), F.col("sig").alias("y")), full, "bits")
    rows = rows.select("sig", "root", "x", "nx", "bits_x", _apart().alias("far"), b.size_class(F.col("nx")).alias("size"))
    rows = common.settle(rows, "blocks")
    ring = F.floor(F.col("far") / b.ring_width(F.col("size")))
    one = rows.select("sig", "size", ring.alias("ring"), "x", "nx", "bits_x", F.col("root").alias("rx"))
    other = rows.withColumn("size", F.explode(F.array(F.col("size"), F.col("size") - 1)))
    other = other.select("sig", "size", F.explode(F.array(ring - 1, ring, ring + 1)).alias("ring"),
                         F.col("x").alias("y"), F.col("nx").alias("ny"), F.col("bits_x").alias("bits_y"), F.col("root").alias("ry"))
    ordered = (F.col("nx") < F.col("ny")) | ((F.col("nx") == F.col("ny")) & (F.col("x") < F.col("y")))
    return common.named(one.join(other, ["sig", "size", "ring"]).where(ordered & (F.col("rx") != F.col("ry")) & _close(b)).select("x", "y"), rows)


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each linked node's component, by alternating large and small stars."""
    edges = edges.where("x <> y").select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct()
    edges, last = common.settle(edges, "stars"), None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).first()
        if state == last:
            return common.named(edges.select(F.col("x").alias("node"), F.col("y").alias("root")), edges)
        last = state
        both = edges.union(edges.select("y", "x"))
        low = both.groupBy("x").agg(F.min("y").alias("m")).withColumn("m", F.least("x", "m"))
        large = both.where("y > x").join(low, "x").select(F.col("y").alias("x"), F.col("m").alias("y")).distinct()
        low = large.groupBy("x").agg(F.min("y").alias("m"))
        small = large.join(low, "x").select(F.col("y").alias("x"), F.col("m").alias("y")).union(low).where("x <> y").distinct()
        before, edges = edges, common.settle(small, "stars")
        common.release(before)


def _join_components(full: DataFrame, signatures: DataFrame, b: Bounds, few: int) -> DataFrame:
    """(node, root) of all sets that have a link."""
    spark = full.sparkSession
    links = spark.createDataFrame([], "x bigint, y bigint")
    roots = spark.createDataFrame([], "node bigint, root bigint")

    def join(pairs: DataFrame) -> None:
        nonlocal links, roots
        found = _linked(pairs, full, b)
        if not found.isEmpty():
            links = links.union(found)
            before, roots = roots, components(links)
            common.release(before)

    def still_open(rows: DataFrame) -> DataFrame:
        """The groups (sig, node, odd) that hold several components, with root, number of sets and leader."""
        rows = rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        lead = F.min(F.struct("odd", "node", "root")).alias("lead")
        groups = rows.groupBy("sig").agg(F.count("*").alias("sets"), lead, F.min("root").alias("lo"), F.max("root").alias("hi"))
        return common.settle(rows.join(groups.where("lo <> hi").select("sig", "sets", "lead"), "sig"), "signatures")

    sigs = still_open(signatures)
    # of small signatures, those with the same sets are one group
    members = sigs.where(F.col("sets") <= few).groupBy("sig").agg(F.array_sort(F.collect_list("node")).alias("sets"))
    other = lambda x, i: F.transform(F.slice("sets", i + 2, F.size("sets")), lambda y: F.struct(x.alias("x"), y.alias("y")))
    pairs = members.select("sets").distinct().select(F.explode(F.flatten(F.transform("sets", other))).alias("p")).select("p.x", "p.y")
    large = sigs.where(F.col("sets") > few).select("sig", "node", "odd", F.col("lead.node").alias("leader"))
    join(pairs.union(large.where("node <> leader").select(F.col("node").alias("x"), F.col("leader").alias("y"))))
    opened = still_open(large.select("sig", "node", "odd")).select(F.col("lead.node").alias("sig"), "node", "odd").distinct()
    common.release(sigs)
    blocks = still_open(opened)
    pairs = _ring_pairs(blocks, full, b)
    join(pairs)
    common.release(pairs, blocks)
    return roots


def _rooted(docs: DataFrame, words: int, least: tuple[int, int], rare: int, few: int) -> DataFrame:
    """(key, doc_id, n, root) of every row: a hash of id and text, and a name of the component; null for an empty set."""
    b = Bounds(*least)
    keyed = _keyed(docs)
    sets = common.settle(_sets(keyed, words, lambda n: b.lacks(n) + b.first(n)), "shingle-sets")
    survivors = common.settle(_survivors(sets, b), "survivors")
    rows = common.settle(sets.select("key", "doc_id", "n", "node"), "rows")
    common.release(sets)
    full = _full_sets(keyed, survivors, words)
    common.release(survivors)
    roots = _join_components(full, _signatures(full, b, rare), b, few)
    common.release(full)
    return rows.join(roots, "node", "left").select("key", "doc_id", "n", F.coalesce("root", "node").alias("root"))


def jaccard_components(docs: DataFrame, words: int = WORDS, least: tuple[int, int] = LEAST, rare: int = RARE, few: int = FEW) -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    rows = _rooted(docs, words, least, rare, few)
    ids = rows.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("least_id"))
    return rows.join(ids, "root", "left").select(
        "doc_id",
        F.col("n").cast("bigint").alias("n_shingles"),
        F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("least_id")).alias("component_id"),
    )


def keep_one(docs: DataFrame, words: int, least: tuple[int, int], rare: int = RARE, few: int = FEW) -> DataFrame:
    """``docs`` with one row of every component: the smallest id's, one without an id only if none has one.

    Rows with an empty set are in no component and all stay. Of rows with the same id and text, one stays, chosen by
    a hash of all its columns. The decision is made on keys; up to ``SENT_ROWS`` of them go to the rows, which stay
    where they are, and only beyond that the rows move, once.
    """
    rows = _rooted(docs, words, least, rare, few).where("root is not null")
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")
    keys = rows.groupBy("key").agg(F.min("root").alias("root"), F.min(rank).alias("rank"), F.count("*").alias("copies"))  # a key has one text, so one root
    best = keys.groupBy("root").agg(F.min("rank").alias("best"))
    keys = common.settle(keys.join(best, "root").select("key", "copies", (F.col("rank") != F.col("best")).alias("out")), "kept")
    key = common.unused(docs, "key")
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    named = lambda wanted: keys.where(wanted).select(F.col("key").alias(key))
    again, gone = "copies > 1 and not out", "out or copies > 1"
    n_again, n_gone = keys.agg(F.count_if(F.expr(again)), F.count_if(F.expr(gone))).first()
    repeated = _sent(named(again), n_again)
    kept = keyed.join(_sent(named(gone), n_gone), key, "left_anti")
    if n_again:
        place = common.unused(docs, "place")
        order = Window.partitionBy(key).orderBy(F.xxhash64(*common.hashable(docs)))
        again = keyed.join(repeated, key, "left_semi").withColumn(place, F.row_number().over(order)).where(F.col(place) == 1)
        kept = kept.union(again.drop(place))
    return kept.drop(key)


def op7_token_combinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(common.read_table(spark, sf_dir, "documents"))


ORACLE = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM w),
n AS (SELECT doc_id, len(s)::BIGINT AS n FROM s),
t AS (SELECT doc_id, unnest(s) AS t FROM s),
i AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM t a JOIN t b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM i JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 90 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.c)
SELECT n.doc_id, n.n AS n_shingles, min(r.c) AS component_id FROM n JOIN r ON r.doc_id = n.doc_id GROUP BY ALL
"""
