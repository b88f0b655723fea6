"""Harmonic packing of tokenised documents into fixed-size sequences.

Lengths fall into reciprocal-capacity classes: class k holds documents of more than C/(k+1) and at most C/k tokens,
and a bin of class k takes exactly k of them, in order of arrival. Every Spark task fills its own bins, so nothing
is exchanged between workers. The room that a full bin leaves is closed with a cut from a *filler* document: one
longer than a sequence, which has to be cut anyway, or one too short for the classes. Every document of a class goes to
a bin of its class, at any time. Where filler is scarce full bins wait for it; while they hold more than ``HELD`` tokens
together, the fullest of them are closed by taking the emptiest apart, whose documents fill the others' room. What remains
at the end of a partition is cut at powers of two, which need no padding, so no sequence is padded.

Memory is bounded: at most k-1 documents per class, waiting bins of ``HELD`` tokens and about ``BACKLOG`` filler sequences.

Cases: a null or empty text is one token (the end id); repeated rows are packed each; an empty table gives no rows;
other columns of the input are neither read nor returned; a text of any length is cut, never dropped. Sequence ids
depend on the partition and the order of rows in it, as a file scan fixes them.
"""

from __future__ import annotations

import heapq
import zlib
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm import common, tokens

CAPACITY = 4096
CLASSES = 16
#: Tokens of full bins that wait for filler, of four bytes each.
HELD = 1 << 22
BACKLOG = 16
END_ID = 2

SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
_ARROW = pa.schema([(c.split()[0], pa.int64()) for c in SCHEMA.split(", ")])


class _Rest:
    """The part of a document that no sequence holds yet."""

    __slots__ = ("doc_id", "ids", "at", "n")

    def __init__(self, doc_id, ids: bytes):
        self.doc_id, self.ids, self.at, self.n = doc_id, ids, 0, len(ids) // 4


class HarmonicPacker:
    """Packs the documents of one partition; ``rows`` collects finished pieces."""

    def __init__(self, first_sequence: int, capacity: int = CAPACITY, classes: int = CLASSES, held: int = HELD):
        self.most, self.order = held, 0
        self.capacity, self.classes = capacity, classes
        self.open: list[list[_Rest]] = [[] for _ in range(classes + 1)]
        self.waiting: list[tuple[int, int, list[_Rest]]] = []  # a heap: least room first
        self.held = 0
        self.filler: deque[_Rest] = deque()
        self.filler_tokens = 0
        self.sequence = first_sequence
        self.rows: list[tuple] = []

    def add(self, doc_id, ids: bytes) -> None:
        doc = _Rest(doc_id, ids)
        k = self.capacity // doc.n
        if not 1 <= k <= self.classes:
            self._add_filler(doc)
            return
        group = self.open[k]
        group.append(doc)
        if len(group) == k:
            self.open[k] = []
            used = sum(d.n for d in group)
            self.order += 1
            heapq.heappush(self.waiting, (self.capacity - used, self.order, group))
            self.held += used
            self._close_bins()
            while self.held > self.most:
                self._take_apart()

    def finish(self) -> None:
        for group in self.open:
            for doc in group:
                self._add_filler(doc)
        while self.waiting:  # no filler is left
            self._take_apart()
        while self.filler_tokens:
            take = min(self.capacity, 1 << (self.filler_tokens.bit_length() - 1))
            self._emit(self._cut(take))

    def _add_filler(self, doc: _Rest) -> None:
        self.filler.append(doc)
        self.filler_tokens += doc.n
        self._close_bins()
        while self.filler_tokens > BACKLOG * self.capacity:
            self._emit(self._cut(self.capacity))

    def _close_bins(self) -> None:
        while self.waiting and self.waiting[0][0] <= self.filler_tokens:
            room, _, group = heapq.heappop(self.waiting)
            self.held -= self.capacity - room
            self._emit([(d, 0, d.n) for d in group] + self._cut(room))

    def _take_apart(self) -> None:
        """The waiting bin with the most room becomes filler for the others."""
        at = max(range(len(self.waiting)), key=self.waiting.__getitem__)
        room, _, group = self.waiting[at]
        self.waiting[at] = self.waiting[-1]
        self.waiting.pop()
        heapq.heapify(self.waiting)
        self.held -= self.capacity - room
        for doc in group:
            self._add_filler(doc)

    def _cut(self, room: int) -> list[tuple[_Rest, int, int]]:
        pieces = []
        self.filler_tokens -= room
        while room:
            doc = self.filler[0]
            take = min(room, doc.n - doc.at)
            pieces.append((doc, doc.at, take))
            doc.at += take
            room -= take
            if doc.at == doc.n:
                self.filler.popleft()
        return pieces

    def _emit(self, pieces: list[tuple[_Rest, int, int]]) -> None:
        offset = 0
        for doc, start, n in pieces:
            crc = zlib.crc32(memoryview(doc.ids)[4 * start : 4 * (start + n)])
            self.rows.append((doc.doc_id, start, n, crc, doc.n, self.sequence, offset))
            offset += n
        self.sequence += 1


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, classes: int = CLASSES, end_id: int = END_ID) -> DataFrame:
    """One row per piece of a document, with the sequence that holds it; one pass and no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = tokens.word_units(tokenizer_path)
        end = end_id.to_bytes(4, "little")
        packer = HarmonicPacker(TaskContext.get().partitionId() << 33, capacity, classes)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for at in range(0, len(ids), 512):
                encoded = units.encode([t or "" for t in texts.slice(at, 512).to_pylist()])
                for doc_id, packed in zip(ids[at : at + 512], encoded):
                    packer.add(doc_id, packed + end)
            yield from flush(packer)
        units.forget()
        packer.finish()
        yield from flush(packer)

    def flush(packer: HarmonicPacker) -> Iterator[pa.RecordBatch]:
        if packer.rows:
            columns = [pa.array(c, pa.int64()) for c in zip(*packer.rows)]
            packer.rows = []
            yield pa.RecordBatch.from_arrays(columns, schema=_ARROW)

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, SCHEMA)


def op5_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.read_table(spark, sf_dir, "documents"), tokens.public_path("word_bpe_49k.json"))
