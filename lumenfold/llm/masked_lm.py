"""Masked pseudo-likelihood of documents.

A small network predicts every token from the two tokens on either side of it. The vocabulary and all word counts
are of the whole corpus. Each Spark task trains the network in numpy on every window of its own documents,
starting from the same weights; the weights are averaged, by number of windows, in groups of ``FAN_IN`` until one set
is left. A document's score is the sum over its tokens of the log probability given their neighbours.

A token is one of the ``VOCABULARY`` most frequent words, or one of ``BUCKETS`` hash buckets of other words. The
network predicts a token's class; the token within its class, and each word within its bucket, have their shares of
the corpus counts, so the probabilities of all words of the corpus sum to one. Words beyond the vocabulary are joined
with the corpus counts (``by_word``). Within a class, neighbours do not change the shares.

Cases: a null or empty text has no tokens and score 0; repeated rows get a row each; equal texts have equal scores;
an empty table gives no rows; other columns are not read; texts of any length are scored whole, in blocks. Since tasks
train on what the scan gives them, another cut of the same table gives other weights, and other scores.
"""

from __future__ import annotations

import pickle
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm import common

VOCABULARY = 4096
BUCKETS = 256
CLASSES = 128
SIDE = 2
WIDTH = 16
HIDDEN = 32
BATCH = 512
RATE = 0.1
FAN_IN = 32
_BLOCK = 32_768
#: Windows scored at once: their class scores stay in a core's cache.
_SCORED = 1024
#: Longer words count with others of their hash bucket only.
LONGEST = 40
#: A longer word can be frequent and yet not in the vocabulary; its rows are dealt to so many tasks.
SALTS = 16
#: Logarithms are summed as whole multiples of 1 / _UNIT, so that the order of the rows does not matter.
_UNIT = 2.0**32
_ONES = np.ones(CLASSES, np.float32)
_COLUMNS = np.arange(WIDTH)


@dataclass
class Words:
    """Ids and classes. Id 0 stands beyond a text's ends; 1.. are words in order of frequency, then come the buckets."""

    ids: dict[str, int]
    classes: np.ndarray  # by id
    log_share: np.ndarray  # by id: log share of the token in its class; of a bucket, that of a word with count 1
    class_share: np.ndarray

    def encode(self, text: str | None) -> np.ndarray:
        return self.split(text)[0]

    def split(self, text: str | None) -> tuple[np.ndarray, list[str]]:
        """The ids of a text's words, and its words beyond the vocabulary."""
        words = (text or "").lower().split()
        get = self.ids.get
        found = [get(w, 0) or 1 + VOCABULARY + zlib.crc32(w.encode()) % BUCKETS for w in words]
        return np.array(found, dtype=np.uint16), [w for w, i in zip(words, found) if i > VOCABULARY]


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) of the whole corpus; each batch is counted before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter = Counter()
            for at in range(0, batch.num_rows, 500):
                for text in batch.column(0).slice(at, 500).to_pylist():
                    counts.update((text or "").lower().split())
            yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])

    return docs.select("text").mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(counts: DataFrame) -> Words:
    top = counts.where(F.length("word") <= LONGEST).orderBy(F.desc("n"), "word").limit(VOCABULARY).collect()
    ids = {r["word"]: i + 1 for i, r in enumerate(top)}
    n = np.zeros(1 + VOCABULARY + BUCKETS)
    n[1 : len(top) + 1] = [r["n"] for r in top]
    last = (top[-1]["n"], top[-1]["word"]) if top else (0, "")
    rest = counts.where((F.length("word") > LONGEST) | (F.col("n") < last[0]) | ((F.col("n") == last[0]) & (F.col("word") > last[1])))
    bucket = (F.crc32(F.col("word").cast("binary")) % BUCKETS).alias("b")
    for r in rest.groupBy(bucket).agg(F.sum("n").alias("n")).collect():  # at most BUCKETS rows
        n[1 + VOCABULARY + r["b"]] = r["n"]
    classes = np.zeros(len(n), dtype=np.int64)
    own = CLASSES // 2  # the most frequent words have a class each, the others share one by their last letters
    for word, i in ids.items():
        classes[i] = i - 1 if i <= own else own + zlib.crc32(word[-2:].encode()) % (CLASSES - own)
    classes[1 + VOCABULARY :] = own + np.arange(BUCKETS) % (CLASSES - own)
    in_bucket = np.maximum(n[1 + VOCABULARY :], 1)
    n += 1e-3
    n[0] = 0
    totals = np.bincount(classes, n, CLASSES)
    share = np.log(np.maximum(n, 1e-300) / totals[classes])
    share[1 + VOCABULARY :] -= np.log(in_bucket)
    return Words(ids, classes, share, (totals + 1e-3) / (totals + 1e-3).sum())


class Network:
    """Embeddings of the neighbours, one hidden layer, and the classes' log probabilities."""

    def __init__(self, words: Words, seed: int = 1):
        rng = np.random.default_rng(seed)
        normal = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
        self.windows = 0  # that the weights were trained on
        self.weights = {
            "embed": normal(len(words.classes), WIDTH, scale=0.3),
            "w1": normal(2 * SIDE * WIDTH, HIDDEN, scale=0.2),
            "b1": np.zeros(HIDDEN, np.float32),
            "w2": normal(HIDDEN, CLASSES, scale=0.05),
            "b2": np.log(words.class_share).astype(np.float32),
        }

    def forward(self, near: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        w = self.weights
        x = w["embed"][near].reshape(len(near), -1)
        h = np.tanh(x @ w["w1"] + w["b1"])
        z = h @ w["w2"] + w["b2"]
        z -= z.max(axis=1, keepdims=True)
        return x, h, z - np.log(np.exp(z).sum(axis=1, keepdims=True))

    def _small(self) -> bool:
        """Whether no class score can leave the range of exponentials, as tanh is at most 1: then no maximum is needed."""
        return float((np.abs(self.weights["w2"]).sum(0) + np.abs(self.weights["b2"])).max()) < 80

    def _exponentials(self, h: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The targets' scores less what keeps exponentials in range, and the exponentials of all classes' scores."""
        z = h @ self.weights["w2"]
        z += self.weights["b2"]
        if not self._small():
            z -= z.max(axis=1, keepdims=True)
        own = z[np.arange(len(z)), target]
        return own, np.exp(z, out=z)

    def _hidden(self, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = self.weights
        x = w["embed"].take(near.ravel(), axis=0).reshape(len(near), -1)
        h = x @ w["w1"]
        h += w["b1"]
        return x, np.tanh(h, out=h)

    def log_of(self, near: np.ndarray, target: np.ndarray) -> np.ndarray:
        """The targets' log probabilities, as ``forward`` has them for all classes."""
        own, e = self._exponentials(self._hidden(near)[1], target)
        return own - np.log(e @ _ONES)

    def train(self, near: np.ndarray, target: np.ndarray, squares: dict[str, np.ndarray]) -> None:
        """One step of Adagrad on a batch."""
        w, n = self.weights, len(target)
        x, h = self._hidden(near)
        e = self._exponentials(h, target)[1]
        total = e @ _ONES
        e[np.arange(n), target] -= total
        scale = (1 / (n * total))[:, None]  # rows of e times scale are the scores' gradients; only narrow factors are scaled
        dh = e @ w["w2"].T
        dh *= scale
        dh *= 1 - h * h
        h *= scale
        dx = (dh @ w["w1"].T).reshape(-1, WIDTH)
        found = np.zeros(len(w["embed"]), bool)
        found[near.ravel()] = True
        rows = np.flatnonzero(found)  # the tokens of the batch; their gradients are summed by place in rows
        place = np.empty(len(found), np.int64)
        place[rows] = np.arange(0, len(rows) * WIDTH, WIDTH)
        cells = place.take(near.ravel())[:, None] + _COLUMNS
        de = np.bincount(cells.ravel(), dx.ravel(), len(rows) * WIDTH).reshape(-1, WIDTH).astype(np.float32)
        for name, grad in (("w2", h.T @ e), ("b2", scale[:, 0] @ e), ("w1", x.T @ dh), ("b1", dh.sum(0))):
            squares[name] += grad * grad
            w[name] -= RATE * grad / np.sqrt(squares[name] + 1e-8)
        known = squares["embed"].take(rows, axis=0)
        known += de * de
        squares["embed"][rows] = known
        w["embed"][rows] = w["embed"].take(rows, axis=0) - RATE * de / np.sqrt(known + 1e-8)


def neighbours(row: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The ids on both sides of the given positions of a row that has ``SIDE`` zeros before and after each text."""
    return np.stack([row[at + SIDE + d] for d in range(-SIDE, SIDE + 1) if d], axis=1).astype(np.int64)


def encoded(docs: DataFrame, words: Words) -> DataFrame:
    """doc_id, the packed ids and the words beyond the vocabulary of every row, and a number of its own (``row``)."""
    shared = docs.sparkSession.sparkContext.broadcast(words)  # VOCABULARY words at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                found = [known.split(t) for t in part.column(1).to_pylist()]
                ids, rare = pa.array([x.tobytes() for x, _ in found], pa.binary()), pa.array([x for _, x in found], pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([part.column(0), ids, rare, part.column(2)], names=["doc_id", "ids", "rare", "row"])

    rows = docs.select(F.col("doc_id").cast("bigint"), "text", F.monotonically_increasing_id().alias("row"))
    return rows.mapInArrow(run, "doc_id bigint, ids binary, rare array<string>, row bigint")


def train(table: DataFrame, words: Words, stride: int = 1) -> Network:
    """The average of the networks that the tasks train. A ``stride`` above 1 leaves windows out; no query has one."""
    spark = table.sparkSession
    shared = spark.sparkContext.broadcast(words)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        net = Network(known)
        squares = {k: np.zeros_like(v) for k, v in net.weights.items()}
        near, target, seen = [], [], 0

        def step() -> None:
            nonlocal near, target, seen
            x, y = np.concatenate(near), np.concatenate(target)
            order = np.random.default_rng(len(y)).permutation(len(y))
            for a in range(0, len(y), BATCH):
                net.train(x[order[a : a + BATCH]], y[order[a : a + BATCH]], squares)
            seen += len(y)
            near, target = [], []

        for batch in batches:
            for i, packed in enumerate(batch.column(0).to_pylist()):
                ids = np.frombuffer(packed, np.uint16)
                row = np.pad(ids, SIDE)
                at = np.arange(i % stride, len(ids), stride)
                for a in range(0, len(at), _BLOCK):
                    near.append(neighbours(row, at[a : a + _BLOCK]))
                    target.append(known.classes[ids[at[a : a + _BLOCK]]])
                    if sum(map(len, target)) >= _BLOCK:
                        step()
        if near:
            step()
        if seen:
            packed = pickle.dumps({k: v.astype(np.float64) * seen for k, v in net.weights.items()})
            yield pa.RecordBatch.from_arrays(
                [pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([seen], pa.int64()), pa.array([packed], pa.binary())],
                names=["part", "seen", "weights"],
            )

    def add(group: pd.DataFrame) -> pd.DataFrame:
        total: dict[str, np.ndarray] = {}
        for packed in group["weights"]:
            for k, v in pickle.loads(packed).items():
                total[k] = total.get(k, 0) + v
        return pd.DataFrame({"part": [group["part"].iloc[0] // FAN_IN], "seen": [group["seen"].sum()], "weights": [pickle.dumps(total)]})

    schema = "part bigint, seen bigint, weights binary"
    parts = common.settle(table.select("ids").mapInArrow(fit, schema), "networks")
    left = parts.agg(F.max("part")).first()[0]
    net = Network(words)
    if left is None:
        return net
    while True:
        parts = parts.groupBy(F.floor(F.col("part") / FAN_IN)).applyInPandas(add, schema)
        if left < FAN_IN:
            break
        left //= FAN_IN
        parts = common.settle(parts, "networks")
    row = parts.first()
    net.windows = row["seen"]
    net.weights = {k: (v / row["seen"]).astype(np.float32) for k, v in pickle.loads(row["weights"]).items()}
    return net


def score(table: DataFrame, words: Words, net: Network) -> DataFrame:
    """doc_id, n_tokens, the summed log probability, its mean per token, and row; words beyond the vocabulary as if of count 1."""
    shared = table.sparkSession.sparkContext.broadcast((words.classes, words.log_share, net))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, log_share, network = shared.value
        for batch in batches:
            texts = [np.frombuffer(p, np.uint16) for p in batch.column(1).to_pylist()]
            sizes = np.fromiter(map(len, texts), np.int64, len(texts))
            # texts stand in a row, with room for the neighbours beyond their ends
            gap = np.zeros(SIDE, np.uint16)
            row = np.concatenate([gap, *[x for t in texts for x in (t, gap)]])
            starts = np.concatenate(([0], np.cumsum(sizes[:-1] + SIDE))) if len(texts) else np.zeros(0, np.int64)
            at = np.repeat(starts - np.concatenate(([0], np.cumsum(sizes[:-1]))), sizes) + np.arange(sizes.sum()) if len(texts) else starts
            logs = np.empty(len(at))
            for a in range(0, len(at), _SCORED):
                here = at[a : a + _SCORED]
                ids = row[here + SIDE]
                logs[a : a + _SCORED] = network.log_of(neighbours(row, here), classes[ids]) + log_share[ids]
            ends = np.cumsum(sizes)
            total = np.array([logs[e - n : e].sum() for e, n in zip(ends, sizes)])
            mean = pa.array(np.divide(total, sizes, out=np.zeros(len(total)), where=sizes > 0), mask=sizes == 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.array(total), mean, batch.column(2)], names=["doc_id", "n_tokens", "log_likelihood", "per_token", "row"])

    table = table.select("doc_id", "ids", "row")
    return table.mapInArrow(run, "doc_id bigint, n_tokens bigint, log_likelihood double, per_token double, row bigint")


def by_word(scored: DataFrame, table: DataFrame, counts: DataFrame) -> DataFrame:
    """``scored`` with the own corpus count of every word beyond the vocabulary."""
    long = F.length("word") > LONGEST
    rare = table.select("row", F.explode("rare").alias("word")).withColumn("salt", F.when(long, F.pmod("row", F.lit(SALTS))).otherwise(0).cast("int"))
    salts = F.when(long, F.array(*map(F.lit, range(SALTS)))).otherwise(F.array(F.lit(0)))
    # the logarithm of the count 1 is 0
    often = counts.where("n > 1").select("word", F.round(F.log("n") * _UNIT).cast("bigint").alias("log"), F.explode(salts).alias("salt"))
    own = rare.join(often, ["word", "salt"]).groupBy("row").agg((F.sum("log") / _UNIT).alias("own"))
    total = F.col("log_likelihood") + F.coalesce("own", F.lit(0.0))
    mean = F.when(F.col("n_tokens") > 0, total / F.col("n_tokens"))
    return scored.join(own, "row", "left").select("doc_id", "n_tokens", total.alias("log_likelihood"), mean.alias("per_token"))


def op4_masked_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents")
    counts = common.settle(word_counts(docs), "word-counts")
    words = vocabulary(counts)
    table = common.settle(encoded(docs, words), "token-ids")
    return by_word(score(table, words, train(table, words)), table, counts)
