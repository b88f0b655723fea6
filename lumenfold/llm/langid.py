"""Language identification with interpolated Kneser-Ney character models.

Text becomes symbols of ``BITS`` bits: letters in lower case, which are more kinds than any script has (those beyond the
65,534 most frequent share one symbol), and one boundary symbol for each run of anything else. Every language has a 4-gram Kneser-Ney model; all languages share one sorted array of
n-gram hashes per order, with a row of log probabilities per hash, so a position costs one binary search. The
prediction is the language of the lowest cross-entropy per symbol.

Rejection is calibrated on labelled documents that the counts leave out: the excess of a document's cross-entropy
over its language's mean is measured in units of ``FLOOR + 1 / sqrt(symbols)``, and documents beyond ``SLACK`` times
the largest calibrated excess are rejected.

The models are fitted on a bounded sample: ``SAMPLE_DOCS`` labelled documents per language, of at most ``SAMPLE_CHARS``
characters each, chosen by a hash of the id. All their n-grams are kept, so no language loses any to another; every
fifth document calibrates, and a language of fewer than five is learnt from all of them. Every document is scored
whole.

Cases: a null text or one without letters is `und` with score 0 and is not rejected by the model; a null id is
never held out and never learnt from; without any labelled document every text is `und`; ties between languages go
to the first by name; equal texts get equal predictions; other input columns are passed on or ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenfold.llm import common

ORDER = 4
BITS = 16
LETTERS = (1 << BITS) - 2
SAMPLE_DOCS = 2000
SAMPLE_CHARS = 20_000
#: Where a language has no n-grams of count one or two to estimate it from.
DISCOUNT = 0.75
FLOOR = 0.1
SLACK = 1.5
LEAST_EXCESS = 4.0
#: Symbols beyond which the score no longer sharpens.
SCORE_SYMBOLS = 60
_CHUNK = 500_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
UNDETERMINED = "und"


@lru_cache(1)
def _letters() -> np.ndarray:
    """For every code point its lower-case letter's code point, or 0 if it is no letter."""
    out = np.zeros(0x110000, dtype=np.uint32)
    for cp in range(0x110000):
        c = chr(cp)
        if c.isalpha():
            out[cp] = ord(c.lower()[0])
    return out


def alphabet_table(symbols: str) -> np.ndarray:
    """Code point to symbol: 0 boundary, 1 any other letter, 2.. the given lower-case letters."""
    lower = _letters()
    ids = np.ones(0x110000, dtype=np.uint16)
    ids[0] = 0
    for i, c in enumerate(symbols[:LETTERS]):
        ids[ord(c)] = i + 2
    return ids[lower]


def to_symbols(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of the texts one after another, and where each begins; every text starts with one boundary."""
    points = np.frombuffer("\n".join(["", *texts]).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.concatenate(([0], np.cumsum(lengths[:-1] + 1))) if len(texts) else np.zeros(0, np.int64)
    symbols = table[points]
    keep = np.empty(len(symbols), dtype=bool)
    keep[:1] = True
    keep[1:] = (symbols[1:] != 0) | (symbols[:-1] != 0)
    keep[starts] = True
    return symbols[keep], np.cumsum(keep)[starts] - 1


def codes_of(symbols: np.ndarray, begin: int, end: int) -> np.ndarray:
    """The 4-gram that ends at each position of [begin, end), ``BITS`` bits per symbol."""
    padded = symbols[max(0, begin - ORDER + 1) : end].astype(np.uint64)
    padded = np.concatenate((np.zeros(ORDER - 1 - min(begin, ORDER - 1), dtype=np.uint64), padded))
    n = end - begin
    out = padded[ORDER - 1 : ORDER - 1 + n].copy()
    for back in range(1, ORDER):
        out |= padded[ORDER - 1 - back : ORDER - 1 - back + n] << np.uint64(BITS * back)
    return out


def _low(symbols: int) -> np.uint64:
    """Mask of the last symbols of a code."""
    return np.uint64((1 << BITS * symbols) - 1)


@dataclass
class SortedHashes:
    """Rows by hash: a sorted array of hashes and a matrix with one column per language."""

    hashes: np.ndarray
    rows: np.ndarray

    @classmethod
    def of(cls, codes: np.ndarray, rows: np.ndarray) -> SortedHashes:
        hashes = codes.astype(np.uint64) * _MIX  # odd, so different codes keep different hashes
        order = np.argsort(hashes)
        return cls(hashes[order], np.ascontiguousarray(rows[order], dtype=np.float32))

    def find(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        wanted = codes * _MIX
        at = np.searchsorted(self.hashes, wanted)
        at[at == len(self.hashes)] = 0
        return at, self.hashes[at] == wanted if len(self.hashes) else np.zeros(len(codes), bool)


@dataclass
class LanguageModels:
    languages: list[str]
    alphabet: str
    grams: list[SortedHashes] = field(default_factory=list)  # by order, from 1
    backoff: list[SortedHashes] = field(default_factory=list)  # of the contexts of order 2..ORDER
    mean: np.ndarray | None = None
    limit: float = float("inf")

    def log_probs(self, codes: np.ndarray, order: int = ORDER) -> np.ndarray:
        at, hit = self.grams[order - 1].find(codes)
        out = self.grams[order - 1].rows[at]
        if order > 1 and not hit.all():
            miss = np.flatnonzero(~hit)
            rest = codes[miss]
            lower = self.log_probs(rest & _low(order - 1), order - 1)
            at, seen = self.backoff[order - 2].find(rest >> np.uint64(BITS))
            lower[seen] += self.backoff[order - 2].rows[at[seen]]
            out[miss] = lower
        return out

    def entropies(self, texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per text: cross-entropy per symbol under each language, symbols, whether it has a letter."""
        symbols, starts = to_symbols(texts, table)
        total = np.zeros((len(texts), len(self.languages)))
        sizes = np.diff(np.append(starts, len(symbols)))
        letters = np.add.reduceat(symbols != 0, starts, dtype=np.int64) if len(texts) else np.zeros(0, np.int64)
        for begin in range(0, len(symbols), _CHUNK):
            end = min(len(symbols), begin + _CHUNK)
            first, last = np.searchsorted(starts, begin, "right") - 1, np.searchsorted(starts, end, "left")
            values = self.log_probs(codes_of(symbols, begin, end))
            total[first:last] -= np.add.reduceat(values, np.maximum(starts[first:last] - begin, 0), axis=0, dtype=np.float64)
        return total / np.maximum(sizes, 1)[:, None], sizes, letters > 0


def discount(n: np.ndarray) -> float:
    """Absolute discount of a language's n-grams of one order, from how many have count one and two."""
    ones, twos = int((n == 1).sum()), int((n == 2).sum())
    return ones / (ones + 2 * twos) if ones and twos else DISCOUNT


def kneser_ney(counts: pd.DataFrame, alphabet: str) -> LanguageModels:
    """Models from 4-gram counts (lang, code, n); lower orders use the counts of different continuations."""
    languages = sorted(counts["lang"].unique())
    levels: list[dict[str, tuple[np.ndarray, np.ndarray]]] = [{} for _ in range(ORDER)]
    for lang in languages:
        own = counts[counts["lang"] == lang]
        codes, n = own["code"].to_numpy(np.int64).view(np.uint64), own["n"].to_numpy(np.float64)
        order = np.argsort(codes)
        levels[ORDER - 1][lang] = codes[order], n[order]
        for m in range(ORDER - 1, 0, -1):
            below, kinds = np.unique(levels[m][lang][0] & _low(m), return_counts=True)
            levels[m - 1][lang] = below, kinds.astype(np.float64)
    model = LanguageModels(languages, alphabet)
    size = len(alphabet) + 2
    lower_codes, lower = np.arange(size, dtype=np.uint64), np.zeros((size, len(languages)))
    for j, lang in enumerate(languages):
        codes, n = levels[0][lang]
        less = discount(n)
        lower[:, j] = less * len(codes) / n.sum() / size
        lower[codes.astype(np.int64), j] += (n - less) / n.sum()
    model.grams.append(SortedHashes.of(lower_codes, np.log(lower)))
    for m in range(1, ORDER):
        union = np.unique(np.concatenate([levels[m][lang][0] for lang in languages]))
        contexts = np.unique(union >> np.uint64(BITS))
        here, weights = np.zeros((len(union), len(languages))), np.ones((len(contexts), len(languages)))
        for j, lang in enumerate(languages):
            codes, n = levels[m][lang]
            context, first, kinds = np.unique(codes >> np.uint64(BITS), return_index=True, return_counts=True)
            sums = np.add.reduceat(n, first)
            less = discount(n)
            weights[np.searchsorted(contexts, context), j] = less * kinds / sums
            here[np.searchsorted(union, codes), j] = (n - less) / np.repeat(sums, kinds)
        suffix = np.searchsorted(lower_codes, union & _low(m))
        here += weights[np.searchsorted(contexts, union >> np.uint64(BITS))] * lower[suffix]
        model.grams.append(SortedHashes.of(union, np.log(here)))
        model.backoff.append(SortedHashes.of(contexts, np.log(weights)))
        lower_codes, lower = union, here
    return model


def held_out(doc_id) -> F.Column:
    """Whether a document is kept for testing: the checksum of its id leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> LanguageModels:
    """Models from the labelled documents that are not held out."""
    usable = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return LanguageModels([], "")
    # drawn with a margin and then cut, so that no task orders more than a little above ``sample_docs`` rows of a language
    share = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, 1.25 * sample_docs / n)))])
    hashed = F.xxhash64("doc_id")
    drawn = usable.where((F.pmod(hashed, F.lit(1 << 20)) / float(1 << 20) < share[F.col("lang")]) & (F.length("text") <= sample_chars))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(hashed, "doc_id", "text"))
    chosen = drawn.select("doc_id", "lang", "text", place.alias("place")).where(F.col("place") <= sample_docs)
    sample = common.settle(chosen.select("lang", "text", (F.col("place") % 5 == 0).alias("calibrate")), "langid-sample")
    alphabet = _alphabet(sample)
    model = kneser_ney(_counts(sample.where(~F.col("calibrate")), alphabet), alphabet) if alphabet else LanguageModels([], "")
    if model.languages:
        _calibrate(model, sample.where("calibrate"))
    return model


def _alphabet(sample: DataFrame) -> str:
    letters = sample.select(F.explode(F.split(F.lower("text"), "")).alias("c")).groupBy("c").agg(F.count("*").alias("n"))
    found = letters.orderBy(F.desc("n"), "c").collect()  # no more than there are code points
    return "".join(r["c"] for r in found if len(r["c"]) == 1 and r["c"].isalpha())[:LETTERS]


def _counts(sample: DataFrame, alphabet: str) -> pd.DataFrame:
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = alphabet_table(alphabet)
        for batch in batches:
            for lang, own in batch.groupby("lang"):
                symbols, _ = to_symbols(list(own["text"]), table)
                codes, n = np.unique(codes_of(symbols, 0, len(symbols)), return_counts=True)
                yield pd.DataFrame({"lang": lang, "code": codes.view(np.int64), "n": n})

    counted = sample.select("lang", "text").mapInPandas(count, "lang string, code bigint, n bigint")
    return counted.groupBy("lang", "code").agg(F.sum("n").alias("n")).toPandas()  # bounded by the sample


def _calibrate(model: LanguageModels, sample: DataFrame) -> None:
    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = alphabet_table(model.alphabet)
        for batch in batches:
            h, n, letters = model.entropies(list(batch["text"]), table)
            yield pd.DataFrame({"best": h.argmin(axis=1), "h": h.min(axis=1), "n": n})[letters]

    seen = sample.select("text").mapInPandas(measure, "best int, h double, n bigint").toPandas()
    model.mean = np.zeros(len(model.languages))
    everywhere = float(np.average(seen["h"], weights=seen["n"])) if len(seen) else float("inf")
    for j in range(len(model.languages)):
        own = seen[seen["best"] == j]
        model.mean[j] = np.average(own["h"], weights=own["n"]) if len(own) else everywhere
    excess = (seen["h"] - model.mean[seen["best"]]) / (FLOOR + 1 / np.sqrt(seen["n"]))
    model.limit = SLACK * max(LEAST_EXCESS, float(excess.max())) if len(seen) else float("inf")


PREFIX = "langid_"


def identify(docs: DataFrame, model: LanguageModels) -> DataFrame:
    """``docs`` with ``langid_pred``, ``langid_score``, ``langid_entropy`` and ``langid_rejected``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = shared.value
        table = alphabet_table(models.alphabet)
        for batch in batches:
            names, scores, entropies, rejected = [], [], [], []
            for texts in common.text_chunks(batch, at, _CHUNK):
                for column, values in zip((names, scores, entropies, rejected), _judge(models, texts, table)):
                    column.extend(values)
            added = [pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(entropies, pa.float64()), pa.array(rejected, pa.bool_())]
            titles = [*batch.schema.names, *(PREFIX + x for x in ("pred", "score", "entropy", "rejected"))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=titles)

    schema = T.StructType(list(docs.schema.fields))
    for name, kind in (("pred", "string"), ("score", "double"), ("entropy", "double"), ("rejected", "boolean")):
        schema.add(PREFIX + name, kind)
    return docs.mapInArrow(run, schema)


def _judge(model: LanguageModels, texts: list[str], table: np.ndarray) -> tuple[list, list, list, list]:
    if not model.languages:
        n = len(texts)
        return [UNDETERMINED] * n, [0.0] * n, [None] * n, [False] * n
    h, sizes, letters = model.entropies(texts, table)
    best = h.argmin(axis=1)
    lowest = h[np.arange(len(texts)), best]
    score = 1 / np.exp(-(h - lowest[:, None]) * np.minimum(sizes, SCORE_SYMBOLS)[:, None]).sum(axis=1)
    excess = (lowest - model.mean[best]) / (FLOOR + 1 / np.sqrt(np.maximum(sizes, 1)))
    names = np.array(model.languages, dtype=object)[best]
    names[~letters] = UNDETERMINED
    entropy = [float(x) if y else None for x, y in zip(lowest, letters)]
    return list(names), np.where(letters, score, 0.0).tolist(), entropy, (letters & (excess > model.limit)).tolist()


def op1_kneser_ney_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents")
    model = fit(docs.select("doc_id", "lang", "text"))
    return identify(docs.select("doc_id", "text"), model).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        F.col("langid_pred").alias("lang_pred"),
        F.col("langid_score").alias("score"),
        F.col("langid_entropy").alias("entropy"),
        F.col("langid_rejected").alias("rejected"),
    )
