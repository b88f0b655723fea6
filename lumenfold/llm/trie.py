"""Prefix trie of conversations, rolled up by centroid decomposition of its parent edges.

*Rebuilding.* Turns are dealt by ranges of (conversation, turn, role and text), numbered inside each range, and ranges hand on
to the next how many turns of a conversation that crosses the border they had. A conversation of any length thus spans
as many tasks as it needs. Every conversation c is then rebuilt: the first h turns of conversation c - c % 20, and its own
turns after the first h, with h = crc32(c) % 4.

*Nodes.* A depth-d node is a distinct sequence of the first d turns. Each turn is hashed together with its depth, and a
node's name is the sum of these hashes up to its depth (three of 40 bits), so that names too are sums over ranges.

*Centroid decomposition.* A node's weight is the number of conversations through it, so the weight W of everything from
it downwards is a plain sum over the conversations' rows: their turns from that depth on. The first component is the
whole trie. In every component the deepest node with at least half of the component's weight is its centroid; the nodes with
at least half of the weight are exactly the path from the centroid up to the component's top. Then

* the totals of everything at or below the centroid are summed, which settles the centroid itself;
* they are added to each node of its path, whose W loses the centroid's;
* the centroid is taken out: its children are the tops of new components, and so is the old top.

No component has more than half of the weight of the one before, so about log2(rows) rounds do for a trie of any depth.
Whether a node lies below the centroid, and below which of its children, is one lookup: the turn just after the centroid's
depth in any conversation through the node. Components of a weight of at most ``BOUND``, and so of as few nodes, are
decomposed to the end inside a task; the larger ones are few by their weight, and are split by joins.

Cases: a turn is ordered first if it is null, and equal turns are ordered by role and text (by ``TIE_CHARS`` characters of
each, then by a hash of both whole); a null role or text is an empty
one; repeated rows are turns of their own; rows without a conv_id belong to no conversation and are left out; a
conversation that is rebuilt to nothing is a member of the root only; other columns are not read; an empty table gives no
rows. Texts of any length are hashed and counted whole. ``ends_sha256`` is a hash of one sequence and so has to be
computed in one place for each node: its ids come as sorted lists, one for each range, and are hashed as they stream in.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenfold.llm import common

BLOCK_IDS = 20
#: Turns that can come from another conversation: crc32 % (HEAD + 1).
HEAD = 3
#: Components of at most this weight are decomposed inside a task.
BOUND = 1 << 14
#: Tables of at most so many rows are sent to all tasks; larger ones are joined by a shuffle.
SENT_ROWS = 1_000_000
#: Parents of more children than this have them find their conv_id without a shuffle.
MANY_CHILDREN = 128
#: Characters of role and text that order equal turns, before a hash of both does.
TIE_CHARS = 256
WORDS = r"[^\x20\x09-\x0D]+"

_SUMS = ("s1", "s2", "s3")
_BITS = (1 << 40) - 1
_EMPTY = hashlib.sha256(b"").hexdigest()


def _head(c: str = "conv_id") -> Column:
    return (F.crc32(F.col(c).cast("string").cast("binary")) % (HEAD + 1)).cast("int")


def _sent(table: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(table) if rows <= SENT_ROWS else table


def _node(depth: Column, sums: list[Column]) -> Column:
    return F.unhex(F.md5(F.concat_ws(".", depth, *sums).cast("binary")))


def _root() -> Column:
    return _node(F.lit(0), [F.lit(0)] * len(_SUMS))


def _turn_hashes(depth: Column, digest: Column) -> list[Column]:
    return [F.xxhash64(F.lit(i), depth.cast("bigint"), digest).bitwiseAND(_BITS) for i in range(len(_SUMS))]


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, part, local, rank, digest, words): every turn with its number in the conversation, in its range, and the range."""
    spark = conversations.sparkSession
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.length(role.cast("binary")).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    words = F.size(F.regexp_extract_all(text, F.lit(WORDS), F.lit(0))).cast("bigint")
    starts = [F.substring(role, 1, TIE_CHARS).alias("role"), F.substring(text, 1, TIE_CHARS).alias("start"), F.xxhash64(role, text).alias("tie")]
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn", *starts, digest.alias("digest"), words.alias("words"), F.monotonically_increasing_id().alias("row")
    )
    # ranges are found from a sample of the order's columns, so these are short; the place in the scan parts equal rows
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), *map(F.col, ("role", "start", "tie", "row"))]
    ranged = turns.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    narrow = ranged.select("conv_id", F.spark_partition_id().alias("part"), "digest", "words")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, local = None, 0
        for batch in batches:
            out = []
            for conv in batch.column("conv_id").to_pylist():
                at, local = conv, local + 1 if conv == at else 1
                out.append(local)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], names=[*batch.schema.names, "local"])

    rows = common.settle(narrow.mapInArrow(number, "conv_id bigint, part int, digest binary, words bigint, local bigint"), "turns")
    carried = rows.groupBy("part").agg(F.min("conv_id").alias("first"), F.max(F.struct("conv_id", "local")).alias("last")).orderBy("part").collect()
    before: list[tuple] = []
    at, count = None, 0
    for r in carried:  # one row for each range
        if r["first"] == at:
            before.append((r["part"], at, count))
        else:
            count = 0
        count = (count if r["last"]["conv_id"] == r["first"] else 0) + r["last"]["local"]
        at = r["last"]["conv_id"]
    carry = F.broadcast(spark.createDataFrame(before, "part int, conv_id bigint, before bigint"))
    ranked = rows.join(carry, ["part", "conv_id"], "left").withColumn("rank", F.col("local") + F.coalesce("before", F.lit(0)))
    return common.named(ranked, rows)


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rebuilt conversations (conv_id, part, length) and their rows (conv_id, depth, node, parent, words, length, part)."""
    spark = turns.sparkSession
    lengths = turns.groupBy("conv_id").agg(F.max("rank").alias("own"), F.min("part").alias("part"))
    hashes = _turn_hashes(F.col("rank"), F.col("digest"))
    first = turns.where((F.col("rank") <= HEAD) & (F.col("conv_id") % BLOCK_IDS == 0))
    first = first.select(F.col("conv_id").alias("base"), F.struct("rank", "words", *[h.alias(s) for h, s in zip(hashes, _SUMS)]).alias("t"))
    heads = first.groupBy("base").agg(F.array_sort(F.collect_list("t")).alias("head"))
    h, none = _head(), F.array().cast("array<struct<rank:bigint,words:bigint,s1:bigint,s2:bigint,s3:bigint>>")
    convs = lengths.withColumn("base", F.col("conv_id") - F.col("conv_id") % BLOCK_IDS).join(heads, "base", "left")
    convs = convs.select("conv_id", "part", h.alias("h"), "own", F.slice(F.coalesce("head", none), F.lit(1), h).alias("head"))
    convs = convs.withColumn("length", F.size("head") + F.greatest(F.col("own") - F.col("h"), F.lit(0)))
    convs = common.settle(convs, "conversations")

    spans = turns.where("local = 1").select("conv_id", "part").join(convs.drop("part"), "conv_id")  # a conversation in each of its ranges
    before = lambda s: F.aggregate("head", F.lit(0).cast("bigint"), lambda a, t: a + t[s])
    spans = spans.select("conv_id", "part", "h", "length", F.size("head").alias("k"), *[before(s).alias(f"head_{s}") for s in _SUMS])
    own = turns.select("conv_id", "part", "rank", "digest", "words").join(spans, ["conv_id", "part"]).where("rank > h")
    own = own.withColumn("depth", (F.col("rank") - F.col("h") + F.col("k")).cast("bigint"))
    for s, value in zip(_SUMS, _turn_hashes(F.col("depth"), F.col("digest"))):
        own = own.withColumn(s, value)
    own = own.drop("digest")
    carry = spark.createDataFrame(_carried(turns, own), "part int, conv_id bigint, " + ", ".join(f"carry_{s} bigint" for s in _SUMS))
    upto = Window.partitionBy("conv_id", "part").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = own.select("*", *[F.sum(s).over(upto).alias(f"upto_{s}") for s in _SUMS]).join(F.broadcast(carry), ["part", "conv_id"], "left")
    total = lambda s: F.col(f"upto_{s}") + F.col(f"head_{s}") + F.coalesce(f"carry_{s}", F.lit(0))
    here, above = [total(s).bitwiseAND(_BITS) for s in _SUMS], [(total(s) - F.col(s)).bitwiseAND(_BITS) for s in _SUMS]
    depth = F.col("depth")
    rows = own.select("conv_id", "depth", _node(depth, here).alias("node"), _node(depth - 1, above).alias("parent"), "words", "length", "part")

    head = convs.select("conv_id", "length", "part", "head", F.posexplode("head").alias("i", "t"))
    sums = lambda n: [F.aggregate(F.slice("head", F.lit(1), n), F.lit(0).cast("bigint"), lambda a, t: a + t[s]).bitwiseAND(_BITS) for s in _SUMS]  # noqa: E731,B023
    depth = F.col("t.rank")
    copied = head.select("conv_id", depth.alias("depth"), _node(depth, sums(F.col("i") + 1)).alias("node"), _node(depth - 1, sums(F.col("i"))).alias("parent"), "t.words", "length", "part")
    return common.named(convs.select("conv_id", "part", "length"), convs), common.settle(rows.unionByName(copied), "paths")


def _carried(turns: DataFrame, own: DataFrame) -> list[tuple]:
    """For each range, what its first conversation had in the ranges before; at most one row for each range."""
    across = [r["conv_id"] for r in turns.where("before > 0").select("conv_id").distinct().collect()]  # no more than ranges
    if not across:
        return []
    wanted = F.broadcast(turns.sparkSession.createDataFrame([(c,) for c in across], "conv_id bigint"))
    totals = own.join(wanted, "conv_id").groupBy("conv_id", "part").agg(*[F.sum(s).alias(s) for s in _SUMS]).orderBy("conv_id", "part").collect()
    out, at, sums = [], None, [0] * len(_SUMS)
    for r in totals:
        if r["conv_id"] != at:
            at, sums = r["conv_id"], [0] * len(_SUMS)
        out.append((r["part"], at, *sums))
        sums = [(a + r[s]) & _BITS for a, s in zip(sums, _SUMS)]
    return out


def _ends(convs: DataFrame, paths: DataFrame, root: Column) -> DataFrame:
    """(node, ends_sha256) of the nodes at which conversations end."""
    ends = paths.where("depth = length").select("node", "part", "conv_id").union(convs.where("length = 0").select(root, "part", "conv_id"))
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    lists = ends.groupBy("node", "part").agg(ids.alias("ids"))
    n = int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, running = None, None
        for batch in batches:
            done = []
            for i in range(batch.num_rows):
                node, ids = batch.column("node")[i].as_py(), batch.column("ids")[i].as_py().encode()
                if node == at:
                    running.update(b"," + ids)
                    continue
                if at is not None:
                    done.append((at, running.hexdigest()))
                at, running = node, hashlib.sha256(ids)
            yield _pairs(done)
        if at is not None:
            yield _pairs([(at, running.hexdigest())])

    return lists.repartition(n, "node").sortWithinPartitions("node", "part").mapInArrow(digest, "node binary, ends_sha256 string")


def _pairs(rows: list[tuple]) -> pa.RecordBatch:
    nodes, digests = zip(*rows) if rows else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(digests, pa.string())], names=["node", "ends_sha256"])


def decompose(parents: list[int], weights: list[int], values: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sums of ``values`` over the subtrees of one tree, whose nodes come by depth, by its centroids.

    ``parents`` has the place of each node's parent, -1 for the top; ``weights`` the weight from a node downwards.
    """
    w, added = list(weights), [[0, 0] for _ in parents]
    out: list[tuple[int, int]] = [(0, 0)] * len(parents)
    open_parts = [list(range(len(parents)))]
    while open_parts:
        part = open_parts.pop()
        half = w[part[0]]
        path = [v for v in part if 2 * w[v] >= half]
        c = path.pop()
        below: dict[int, list[int]] = {}
        top_of: dict[int, int] = {}
        rest: list[int] = []
        a, b = values[c]
        for v in part:
            p = parents[v]
            if v == c:
                continue
            top = v if p == c else top_of.get(p)
            if top is None:
                rest.append(v)
                continue
            top_of[v] = top
            below.setdefault(top, []).append(v)
            a, b = a + values[v][0], b + values[v][1]
        out[c] = (a + added[c][0], b + added[c][1])
        for v in path:
            w[v] -= w[c]
            added[v][0] += a
            added[v][1] += b
        open_parts += [rest] * bool(rest) + list(below.values())
    return out


_STATE = ["node", "comp", "parent", "depth", "conv_id", "w", "leaves", "saved", "more_leaves", "more_saved"]
_TOTALS = "node binary, n_leaves bigint, saved_tokens bigint"


def _split(active: DataFrame, paths: DataFrame, bound: int) -> tuple[DataFrame, DataFrame] | None:
    """One round over the components of more than ``bound``: the new state and the settled centroids; None if there are none."""
    tops = common.settle(active.groupBy("comp").agg(F.max("w").alias("top_w")).where(F.col("top_w") > bound), "components")
    n = tops.count()
    if not n:
        common.release(tops)
        return None
    heavy = active.join(_sent(tops, n), "comp").where("2 * w >= top_w")
    centroid = F.max_by(F.struct("node", "depth", "w"), "depth").alias("c")
    found = heavy.groupBy("comp", "top_w").agg(centroid).select("comp", "top_w", F.col("c.node").alias("c"), F.col("c.depth").alias("c_depth"), F.col("c.w").alias("c_w"))
    found = common.settle(found, "centroids")
    marked = active.join(_sent(found, n), "comp", "left")
    no_child = marked.where("c is null or depth <= c_depth").withColumn("child", F.lit(None).cast("binary"))
    after = paths.select("conv_id", (F.col("depth") - 1).alias("c_depth"), F.col("node").alias("child"), F.col("parent").alias("at"))
    under = marked.where("depth > c_depth").join(after, ["conv_id", "c_depth"])
    under = under.withColumn("child", F.when(F.col("at") == F.col("c"), F.col("child"))).drop("at")
    state = common.settle(no_child.unionByName(under), "split")
    sums = [F.sum("leaves").alias("sum_leaves"), F.sum("saved").alias("sum_saved")]
    totals = common.settle(state.where("child is not null or node = c").groupBy("comp").agg(*sums), "totals")
    state_totals = state.join(_sent(totals, n), "comp", "left")
    on_path = F.col("c").isNotNull() & (F.col("node") != F.col("c")) & (2 * F.col("w") >= F.col("top_w"))
    add = lambda s: (F.col(f"more_{s}") + F.when(on_path, F.col(f"sum_{s}")).otherwise(0)).alias(f"more_{s}")
    w = F.when(on_path, F.col("w") - F.col("c_w")).otherwise(F.col("w")).alias("w")
    comp = F.coalesce("child", "comp").alias("comp")
    done = state_totals.where("node = c").select("node", (F.col("more_leaves") + F.col("sum_leaves")).alias("n_leaves"), (F.col("more_saved") + F.col("sum_saved")).alias("saved_tokens"))
    done = common.settle(done, "centroid-totals")
    left = state_totals.where("c is null or node <> c").select("node", comp, "parent", "depth", "conv_id", w, "leaves", "saved", add("leaves"), add("saved"))
    left = common.settle(left, "active")
    common.release(tops, found, state, totals)
    return left, done


def rollup(nodes: DataFrame, paths: DataFrame, bound: int = BOUND) -> DataFrame:
    """(node, n_leaves, saved_tokens) of the nodes (node, parent, depth, conv_id, w, leaves, saved), summed over their subtrees."""
    spark = nodes.sparkSession
    none = F.lit(0).cast("bigint")
    active = common.settle(nodes.withColumns({"comp": _root(), "more_leaves": none, "more_saved": none}).select(*_STATE), "active")
    done = spark.createDataFrame([], _TOTALS)
    while (split := _split(active, paths, bound)) is not None:
        common.release(active)
        active = split[0]
        done = done.union(split[1])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows = None, []

        def solve() -> pa.RecordBatch:
            place = {r["node"]: i for i, r in enumerate(rows)}
            totals = decompose([place.get(r["parent"], -1) for r in rows], [r["w"] for r in rows], [(r["leaves"], r["saved"]) for r in rows])
            leaves = [r["more_leaves"] + a for r, (a, _) in zip(rows, totals)]
            saved = [r["more_saved"] + b for r, (_, b) in zip(rows, totals)]
            columns = [pa.array([r["node"] for r in rows], pa.binary()), pa.array(leaves, pa.int64()), pa.array(saved, pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names=["node", "n_leaves", "saved_tokens"])

        for batch in batches:
            for r in batch.to_pylist():
                if r["comp"] != at and rows:
                    yield solve()
                    rows = []
                at = r["comp"]
                rows.append(r)
        if rows:
            yield solve()

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    columns = ["comp", "node", "parent", "depth", "w", "leaves", "saved", "more_leaves", "more_saved"]
    dealt = active.select(*columns).repartition(n, "comp").sortWithinPartitions("comp", "depth")
    return common.named(dealt.mapInArrow(finish, _TOTALS).union(done), active)


def prefix_trie(conversations: DataFrame, bound: int = BOUND) -> DataFrame:
    """One row for each node of the trie of rebuilt conversations."""
    turns = numbered_turns(conversations)
    convs, paths = rebuilt(turns)
    root = _root()
    counts = [F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.sum(F.col("length") - F.col("depth") + 1).alias("w")]
    inner = paths.groupBy("node", "parent", "depth", "words").agg(*counts)
    members = convs.select(root.alias("node"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("bigint").alias("depth"), F.lit(0).cast("bigint").alias("words"), "length", "conv_id")
    nodes = inner.unionByName(members.groupBy("node", "parent", "depth", "words").agg(*counts))
    nodes = common.settle(nodes, "trie-nodes")
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("bigint"))
    nodes = nodes.withColumns({"leaves": (F.col("n_children") == 0).cast("bigint"), "saved": (F.col("n_convs") - 1) * F.col("words")}).drop("words")
    nodes = common.settle(nodes, "trie")
    totals = rollup(nodes, paths, bound)
    ends = _ends(convs, paths, root)
    whole = nodes.join(totals, "node").join(ends, "node", "left")
    whole = common.settle(whole.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(_EMPTY))), "trie-totals")
    common.release(turns, convs, paths, totals)
    return _with_parents(whole)


def _with_parents(nodes: DataFrame) -> DataFrame:
    """With each node's parent's conv_id; parents of many children, which are few, are sent to the tasks."""
    many = max(MANY_CHILDREN, nodes.count() // SENT_ROWS)  # so that there are at most SENT_ROWS of them
    named = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("siblings"))
    large = F.broadcast(named.where(F.col("siblings") > many))
    inner = nodes.where("parent is not null")
    out = [
        nodes.where("parent is null").withColumn("parent_conv_id", F.lit(None).cast("bigint")),
        inner.join(large, "parent").drop("siblings"),
        inner.join(large.select("parent"), "parent", "left_anti").join(named.where(F.col("siblings") <= many), "parent").drop("siblings"),
    ]
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return out[0].select(*columns).union(out[1].select(*columns)).union(out[2].select(*columns))


def op11_centroid_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(common.read_table(spark, sf_dir, "conversations"))


# crc32 of a decimal number, bit by bit, as DuckDB has no such function
_CRC = """list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(0, 8)), lambda x, i: xor(x >> 1, (x & 1) * 3988292384)))"""
ORACLE = f"""
WITH t AS (SELECT conv_id, {{'r': coalesce(role, ''), 'x': coalesce(text, '')}} AS t,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT conv_id, list(t ORDER BY i) AS own FROM t GROUP BY conv_id),
c AS (SELECT conv_id, own, xor({_CRC}, 4294967295) % 4 AS h FROM l),
s AS (SELECT c.conv_id, list_concat(coalesce(b.own, [])[1:c.h], c.own[c.h + 1:]) AS s FROM c LEFT JOIN l b ON b.conv_id = c.conv_id - c.conv_id % 20),
p AS (SELECT conv_id, s, unnest(range(len(s) + 1)) AS d FROM s),
n AS (SELECT s[1:d] AS k, d AS depth, count(*) AS n_convs, min(conv_id) AS conv_id,
    coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(s) = d), '') AS ends FROM p GROUP BY ALL),
k AS (SELECT k[1:depth - 1] AS k, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
v AS (SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN depth = 0 THEN 0 ELSE
    (n_convs - 1) * len(regexp_extract_all(n.k[depth].x, '[^\\x20\\x09-\\x0D]+')) END AS saved FROM n LEFT JOIN k ON k.k = n.k),
u AS (SELECT k, saved, (n_children = 0)::BIGINT AS leaf, unnest(range(depth + 1)) AS d FROM v),
g AS (SELECT k[1:d] AS k, sum(leaf)::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM u GROUP BY ALL)
SELECT v.conv_id, v.depth, q.conv_id AS parent_conv_id, v.n_convs, v.n_children, n_leaves, saved_tokens, sha256(v.ends) AS ends_sha256
FROM v JOIN g ON g.k = v.k LEFT JOIN v q ON v.depth > 0 AND q.k = v.k[1:v.depth - 1]
"""
