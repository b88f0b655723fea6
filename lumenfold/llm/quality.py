"""Quality rules as weak supervision.

Each rule looks at one property of a text and votes or abstains: some know a defect and vote bad, others a trait of
prose and vote good. How often a rule is right is not known; expectation-maximisation estimates it from how the
votes agree over the whole corpus, and a document is judged by its posterior probability of being good instead of
having to pass all rules. Votes make at most 2^rules patterns, so the corpus is summarised by one count per pattern and the fitting is
independent of its size.

Cases: a null text has no words and fails the base rules, as an empty one; texts of any length are read whole, in
one task each; equal texts get equal verdicts; an empty table gives no rows; other input columns are not read.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenfold.llm import common

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
WINDOW = 5
KEEP_FROM = 0.5

#: Rules that vote bad, or abstain: each knows one defect.
DEFECTS = [
    ("short", lambda m: m["n_words"] < 10),
    ("symbols", lambda m: m["n_symbols"] > 0.1 * m["n_words"]),
    ("repeats", lambda m: m["n_repeat_words"] > 0.2 * m["n_words"]),
    ("lines", lambda m: m["n_dup_lines"] > 0.3 * m["n_lines"]),
    ("word_length", lambda m: (m["word_chars"] < 2 * m["n_words"]) | (m["word_chars"] > 20 * m["n_words"])),
    ("capitals", lambda m: m["n_upper"] > 0.5 * m["n_letters"]),
    ("letters", lambda m: m["n_letters"] < 0.6 * m["word_chars"]),
    ("variety", lambda m: m["n_distinct"] <= np.where(m["n_words"] < 50, 0.5, 0.1) * m["n_words"]),
]
#: Rules that vote good, or abstain: each knows one trait of running prose.
TRAITS = [
    ("plain", lambda m: (m["n_words"] >= 20) & (m["n_symbols"] == 0) & (m["n_letters"] > 0.85 * m["word_chars"])),
    ("sentences", lambda m: (m["n_symbols"] < 0.02 * m["n_words"]) & (m["n_upper"] > 0) & (m["n_upper"] < 0.2 * m["n_letters"])
     & (m["word_chars"] > 3 * m["n_words"]) & (m["word_chars"] < 12 * m["n_words"])),
    ("fresh", lambda m: (m["n_words"] >= 20) & (m["n_symbols"] < 0.02 * m["n_words"]) & (m["n_repeat_words"] == 0) & (m["n_dup_lines"] == 0)
     & (m["n_distinct"] > 0.2 * m["n_words"])),
]
RULES = [name for name, _ in DEFECTS + TRAITS]
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_distinct")
#: Each rule's accuracy is believed to be this before any vote is seen, as firmly as after so many votes.
PRIOR_ACCURACY, PRIOR_VOTES = 0.9, 100
LEAST_ACCURACY = 0.55
#: The share of good documents before any vote. One-sided rules do not tell it, so it is not estimated.
BALANCE = 0.5
ROUNDS = 50
#: Characters that are looked at together.
_CHUNK = 1_000_000


@lru_cache(1)
def _kinds() -> np.ndarray:
    """1 for a letter, 3 for a capital one, by code point."""
    return np.array([chr(c).isalpha() + 2 * chr(c).isupper() for c in range(0x110000)], dtype=np.uint8)


_WEIGHTS = [np.uint64(random.Random(41 + i).getrandbits(64) | 1) for i in range(WINDOW + 1)]


def _repeats(hashes: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
    """Words of each text inside windows that the text has at least twice."""
    n = len(hashes) - WINDOW + 1
    covered = np.zeros(len(hashes), dtype=bool)
    if n > 0:
        own = np.flatnonzero(owner[:n] == owner[WINDOW - 1 :])
        windows = owner[own].astype(np.uint64) * _WEIGHTS[WINDOW]
        for i in range(WINDOW):
            x = hashes[own + i] * _WEIGHTS[i]
            windows += x ^ (x >> np.uint64(29))
        order = np.argsort(windows)
        same = windows[order[1:]] == windows[order[:-1]]
        again = np.zeros(len(own), dtype=bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        for i in range(WINDOW):
            covered[own[again] + i] = True
    return np.bincount(owner[covered], minlength=texts)


def measure(texts: list[str]) -> dict[str, np.ndarray]:
    """The measures of every text; a null one counts as empty."""
    words = [t.encode().split() for t in texts]  # bytes split at ASCII white space only
    out = {"n_words": np.fromiter(map(len, words), np.int64, len(texts))}
    spaces = np.fromiter((sum(map(t.count, SPACES)) for t in texts), np.int64, len(texts))
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    out["word_chars"] = sizes - spaces
    out["n_symbols"] = np.fromiter((sum(map(t.count, SYMBOLS)) for t in texts), np.int64, len(texts))
    lines = [[x for x in t.split("\n") if x.strip(SPACES)] for t in texts]
    out["n_lines"] = np.fromiter(map(len, lines), np.int64, len(texts))
    out["n_dup_lines"] = out["n_lines"] - np.fromiter((len(set(x)) for x in lines), np.int64, len(texts))
    hashes = np.fromiter((hash(w) for ws in words for w in ws), np.int64, int(out["n_words"].sum())).astype(np.uint64)
    owner = np.repeat(np.arange(len(texts)), out["n_words"])
    out["n_repeat_words"] = _repeats(hashes, owner, len(texts))
    out["n_distinct"] = np.fromiter((len(set(w)) for w in words), np.int64, len(texts))
    kinds = _kinds()[np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4")]
    ends = np.cumsum(sizes)
    for name, bit in (("n_letters", 1), ("n_upper", 2)):
        upto = np.concatenate(([0], np.cumsum((kinds & bit) != 0)))
        out[name] = upto[ends] - upto[ends - sizes]
    return out


def votes(m: dict[str, np.ndarray]) -> np.ndarray:
    """Which rules vote on each text, as one number with a bit per rule; the others abstain."""
    code = np.zeros(len(m["n_words"]), dtype=np.int64)
    for _, applies in DEFECTS + TRAITS:
        code = 2 * code + applies(m)
    return code


def fit_votes(counts: dict[int, int]) -> dict[int, float]:
    """Posterior probability of a good document for each pattern of votes, by expectation-maximisation.

    A rule that votes is right with its accuracy, which the rounds estimate; a rule that abstains says nothing.
    """
    if not counts:
        return {}
    codes = np.array(sorted(counts))
    n = np.array([counts[c] for c in codes], dtype=float)
    cast = (codes[:, None] >> np.arange(len(RULES))[::-1]) & 1  # pattern, rule
    for_good = np.arange(len(RULES)) >= len(DEFECTS)
    accuracy = np.full(len(RULES), PRIOR_ACCURACY)
    for _ in range(ROUNDS):
        weight = np.log(accuracy / (1 - accuracy)) * np.where(for_good, 1, -1)
        posterior = 1 / (1 + np.exp(-(cast @ weight) - np.log(BALANCE / (1 - BALANCE))))
        right = np.where(for_good, posterior[:, None], 1 - posterior[:, None])
        accuracy = ((n[:, None] * cast * right).sum(0) + PRIOR_ACCURACY * PRIOR_VOTES) / ((n[:, None] * cast).sum(0) + PRIOR_VOTES)
        accuracy = np.clip(accuracy, LEAST_ACCURACY, 0.999)
    return {int(c): float(p) for c, p in zip(codes, posterior)}


def _measured(batch: pa.RecordBatch, at: int) -> Iterator[tuple[int, int, dict[str, np.ndarray]]]:
    """(begin, end, measures) of the batch in parts of bounded size."""
    begin = 0
    for texts in common.text_chunks(batch, at, _CHUNK):
        yield begin, begin + len(texts), measure(texts)
        begin += len(texts)


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, the measures and the votes of every row."""
    columns = ["doc_id", *MEASURES, "votes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end, m in _measured(batch, 1):
                values = [pa.array(m[c], pa.int64()) for c in MEASURES]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, end - begin), *values, pa.array(votes(m), pa.int64())], names=columns)

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, ", ".join(f"{c} bigint" for c in columns))


def fit(table: DataFrame) -> dict[int, float]:
    """Posteriors from the ``votes`` of all documents; at most 2^rules rows reach the driver."""
    return fit_votes({r["votes"]: r["n"] for r in table.groupBy("votes").agg(F.count("*").alias("n")).collect()})


def base_failed(n_words, n_repeat_words):
    return (n_words < 10) | (100 * n_repeat_words > 20 * n_words)


def judged(docs: DataFrame) -> DataFrame:
    """(row, text, votes, failed): the rows of ``docs``, with the votes on each and whether the base rules fail it."""
    packed = common.packed(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end, m in _measured(batch, 1):
                failed = base_failed(m["n_words"], m["n_repeat_words"])
                part = batch.slice(begin, end - begin)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(votes(m), pa.int64()), pa.array(failed)], names=["row", "text", "votes", "failed"])

    schema = T.StructType([*packed.schema.fields, T.StructField("votes", T.LongType()), T.StructField("failed", T.BooleanType())])
    return packed.mapInArrow(run, schema)


def keep(docs: DataFrame, posterior: dict[int, float] | None = None, keep_from: float = KEEP_FROM) -> DataFrame:
    """The rows of ``docs`` that pass the base rules and are good with probability ``keep_from`` at least.

    Texts are measured once: without a ``posterior`` the votes are written with the rows, fitted, and applied to them.
    """
    rows = judged(docs)
    if posterior is None:
        rows = common.settle(rows, "judged")
        posterior = fit(rows)
    good = [c for c, p in posterior.items() if p >= keep_from]  # at most 2^rules
    return common.unpacked(rows.where(~F.col("failed") & F.col("votes").isin(good)), docs)


def op2_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = common.settle(measured(common.read_table(spark, sf_dir, "documents")), "quality")
    posterior = spark.createDataFrame(list(fit(table).items()) or [(0, 0.0)], "votes bigint, quality double")
    failed = base_failed(F.col("n_words"), F.col("n_repeat_words"))
    return table.join(F.broadcast(posterior), "votes", "left").select(  # at most 2^rules rows
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & (F.col("quality") >= KEEP_FROM)).alias("kept"),
        "quality",
    )
