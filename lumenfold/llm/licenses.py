"""License scans: an exact set-similarity join of license templates with the blocks of every text.

A template is the set of words of a license notice. Texts are cut into blocks of words: for each class of template
lengths W (powers of two), block b holds the words from b * W up to (b + 2) * W, so that any W words in a row lie whole in
one block. A template is in a block if the block has at least ``LEAST`` of its words; that is found exactly by

1. *Global order.* The words of all templates are counted over the whole corpus and numbered from the rarest on.
   Words of no template can be in no intersection, so blocks keep numbers of template words only.
2. *Length filter.* A block with fewer template words than the least need of its class is out before anything moves.
3. *Prefix filter.* A template of t words that needs a of them shares one of its t - a + 1 rarest, which are indexed; a
   block of s words is looked up by its s - a + 1 rarest.
4. *Positional filter.* From the shared word on, both sides must have a words left.
5. *Verification.* The intersection of what remains is counted.

The index is as large as the templates, never as the corpus; it is sent to all tasks while it has at most ``SENT_TOKENS``
entries and joined by a shuffle beyond that.

The base looks for phrases as consecutive words and needs no join. ``score`` is 1 where a phrase occurs, otherwise the
greatest share of a template that a block holds, or 0 where none is found.

Cases: a null or empty text has no words, no labels and score 0; texts of any length are scanned whole, word by word;
repeated rows give a row each; a null id is passed on; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm import common

# fixed values: the base phrases and their labels
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)
# fixed values: license notices as they are usually worded
TEMPLATES = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("licensed under the apache license version 2 0 you may not use this file except in compliance with the license", "apache-2"),
    ("this work is licensed under the gnu general public license version 3", "gpl"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl"),
    ("this work is licensed under a creative commons attribution noncommercial 4 0 international license", "cc-by-nc"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
)
#: The share of a template's words that a block must hold.
LEAST = (4, 5)
SENT_TOKENS = 1_000_000

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")  # after lower-casing; bytes of other than ASCII characters are all from 0x80 on
_BLOCK = "struct<width:int,block:bigint,tokens:array<int>>"
_ROWS = f"doc_id bigint, key bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels array<string>, blocks array<{_BLOCK}>"
_BLOCKS = pa.list_(pa.struct([("width", pa.int32()), ("block", pa.int64()), ("tokens", pa.list_(pa.int32()))]))


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    width: int
    need: int

    @staticmethod
    def of(text: str, label: str, least: tuple[int, int]) -> Template:
        words = text.split()
        distinct = tuple(dict.fromkeys(words))
        return Template(label, distinct, 1 << (len(words) - 1).bit_length(), -(-least[0] * len(distinct) // least[1]))


def _numbers(text: bytes | None, known: dict[bytes, int]) -> np.ndarray:
    """The number of each word of a text, -1 for words that are not known."""
    return np.fromiter((known.get(m[0], -1) for m in _WORD.finditer((text or b"").lower())), np.int32)


def _texts(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, bytes | None]]:
    """The rows of a batch, a few at a time, since texts may be long."""
    for at in range(0, batch.num_rows, 64):
        yield from enumerate(batch.column(column).slice(at, 64).to_pylist(), at)


def word_order(docs: DataFrame, words: Sequence[str]) -> dict[bytes, int]:
    """``words`` numbered from the one that all texts together have least often."""
    known = {w.encode(): i for i, w in enumerate(sorted(set(words)))}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(known) + 1, dtype=np.int64)
        for batch in batches:
            for _, text in _texts(batch, "text"):
                counts += np.bincount(_numbers(text, known) + 1, minlength=len(known) + 1)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(known)), pa.int32()), pa.array(counts[1:])], names=["word", "n"])

    counted = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(count, "word int, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    found = {r["word"]: r["n"] for r in counted.collect()}  # as many rows as words in the templates
    ordered = sorted(known, key=lambda w: (found.get(known[w], 0), w))
    return {w: i for i, w in enumerate(ordered)}


def blocks(numbers: np.ndarray, width: int, wanted: np.ndarray, need: int) -> list[dict]:
    """The blocks of ``width`` that hold at least ``need`` wanted words, with the numbers of those in order."""
    at = np.flatnonzero(numbers >= 0)
    at = at[wanted[numbers[at]]]
    if len(at) < need:
        return []
    base = len(wanted)
    block, word = at // width, numbers[at].astype(np.int64)
    pairs = np.unique(np.concatenate([block * base + word, ((block - 1) * base + word)[block > 0]]))
    of, starts = np.unique(pairs // base, return_index=True)
    ends = np.append(starts[1:], len(pairs))
    full = np.flatnonzero(ends - starts >= need)
    return [{"width": width, "block": int(of[i]), "tokens": pairs[starts[i] : ends[i]] % base} for i in full]


def _scanned(docs: DataFrame, templates: Sequence[Template], phrases: Sequence[tuple[str, str]], order: dict[bytes, int]) -> DataFrame:
    """What the base finds in every row, and the blocks that the length filter leaves."""
    sought = [([order[w.encode()] for w in text.split()], label) for text, label in phrases]
    classes = []
    for width in sorted({t.width for t in templates}):
        own = [t for t in templates if t.width == width]
        wanted = np.zeros(len(order), dtype=bool)
        wanted[[order[w.encode()] for t in own for w in t.words]] = True
        classes.append((width, wanted, min(t.need for t in own)))

    def places(numbers: np.ndarray, words: list[int]) -> np.ndarray:
        at = np.flatnonzero(numbers[: max(len(numbers) - len(words) + 1, 0)] == words[0])
        for i, word in enumerate(words[1:], 1):
            at = at[numbers[at + i] == word]
        return at

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for _, text in _texts(batch, "text"):
                numbers = _numbers(text, order)
                found = [(places(numbers, words), label) for words, label in sought]
                at = np.concatenate([p for p, _ in found]) if found else np.zeros(0, np.int64)
                ends = (int(at.min()), int(at.max())) if len(at) else (None, None)
                labels = sorted({label for p, label in found if len(p)})
                out.append((len(numbers), len(at), *ends, labels, [b for c in classes for b in blocks(numbers, *c)]))
            n_words, n_base, first, last, labels, cut = zip(*out)
            longs = [pa.array(c, pa.int64()) for c in (n_words, n_base, first, last)]
            columns = [batch.column("doc_id"), batch.column("key"), *longs, pa.array(labels, pa.list_(pa.string())), pa.array(cut, _BLOCKS)]
            yield pa.RecordBatch.from_arrays(columns, names=_ROWS_NAMES)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("doc_id", "text").alias("key"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, _ROWS)


_ROWS_NAMES = ["doc_id", "key", "n_words", "n_base", "first_word", "last_word", "base_labels", "blocks"]


def containment_join(cut: DataFrame, templates: Sequence[Template], order: dict[bytes, int]) -> DataFrame:
    """(key, width, block, label, shared, size): every block (key, width, block, tokens) and template that it holds enough of."""
    spark = cut.sparkSession
    index = []
    for t in templates:
        tokens = sorted(order[w.encode()] for w in t.words)
        prefix = tokens[: len(tokens) - t.need + 1]
        index += [(t.width, token, i, t.label, tokens, len(tokens), t.need) for i, token in enumerate(prefix)]
    needs = {w: min(t.need for t in templates if t.width == w) for w in {t.width for t in templates}}
    indexed = spark.createDataFrame(index, "width int, token int, i int, label string, template array<int>, size int, need int")
    indexed = F.broadcast(indexed) if len(index) <= SENT_TOKENS else indexed
    least = F.element_at(F.create_map(*[F.lit(x) for w, n in needs.items() for x in (w, n)]), F.col("width"))
    held = F.size("tokens")
    probes = cut.select("key", "width", "block", "tokens", held.alias("held"), F.posexplode(F.slice("tokens", F.lit(1), F.greatest(held - least + 1, F.lit(0)))).alias("j", "token"))
    pairs = probes.join(indexed, ["width", "token"]).where((F.col("size") - F.col("i") >= F.col("need")) & (F.col("held") - F.col("j") >= F.col("need")))
    shared = F.size(F.array_intersect("tokens", "template"))
    return pairs.withColumn("shared", shared).where("shared >= need").select("key", "width", "block", "label", "shared", "size")


def license_scan(
    docs: DataFrame,
    templates: Sequence[tuple[str, str]] = TEMPLATES,
    phrases: Sequence[tuple[str, str]] = PHRASES,
    least: tuple[int, int] = LEAST,
) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of every row."""
    if not 0 < least[0] <= least[1]:
        raise ValueError("the least share is above 0 and at most 1")
    models = [Template.of(text, label, least) for text, label in templates]
    order = word_order(docs, [w for t in models for w in t.words] + [w for text, _ in phrases for w in text.split()])
    rows = common.settle(_scanned(docs, models, phrases, order), "license-blocks")
    cut = rows.where(F.size("blocks") > 0).dropDuplicates(["key"]).select("key", F.explode("blocks").alias("b")).select("key", "b.*")
    found = containment_join(cut, models, order)
    found = found.groupBy("key").agg(F.collect_set("label").alias("found"), F.max(F.col("shared") / F.col("size")).alias("share"))
    labels = F.array_sort(F.array_distinct(F.concat("base_labels", F.coalesce("found", F.array().cast("array<string>")))))
    return rows.join(found, "key", "left").select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )


def op13_containment_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(common.read_table(spark, sf_dir, "documents"))


def _list(words: Sequence[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _oracle() -> str:
    models = [Template.of(text, label, LEAST) for text, label in TEMPLATES]
    templates = ", ".join(f"({i}, '{t.label}', {_list(t.words)}, {t.width}, {t.need})" for i, t in enumerate(models))
    phrases = ", ".join(f"({_list(text.split())}, '{label}')" for text, label in PHRASES)
    return f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
p(words, label) AS (VALUES {phrases}),
t(id, label, words, width, need) AS (VALUES {templates}),
w AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS pos FROM d),
b AS (SELECT doc_id, label, pos FROM w JOIN p ON w.word = p.words[1] JOIN d USING (doc_id) WHERE d.w[pos + 1:pos + len(p.words)] = p.words),
base AS (SELECT doc_id, count(*) AS n, min(pos) AS f, max(pos) AS l FROM b GROUP BY doc_id),
x AS (SELECT doc_id, id, label, len(t.words) AS size, need, word, pos // width AS blk FROM w JOIN (SELECT *, unnest(words) AS word FROM t) t USING (word)),
y AS (SELECT doc_id, label, count(DISTINCT word) / size AS share FROM
    (SELECT * FROM x UNION ALL SELECT doc_id, id, label, size, need, word, blk - 1 FROM x WHERE blk > 0)
    GROUP BY doc_id, id, label, size, need, blk HAVING count(DISTINCT word) >= need),
s AS (SELECT doc_id, max(share) AS share FROM y GROUP BY doc_id),
bl AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM b GROUP BY doc_id),
al AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM b UNION ALL SELECT doc_id, label FROM y) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(base.n, 0) AS n_base, f AS first_word, l AS last_word, coalesce(bl.labels, '') AS base_labels,
    coalesce(al.labels, '') AS labels, CASE WHEN base.n > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0::DOUBLE) END AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN s USING (doc_id) LEFT JOIN bl USING (doc_id) LEFT JOIN al USING (doc_id)
"""


ORACLE = _oracle()
