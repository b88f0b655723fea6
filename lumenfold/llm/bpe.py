"""Byte-level BPE encoding and decoding of whole texts by tree concatenation.

A text of more than ``LEAF`` characters is cut into halves again and again, wherever the middle lies; the leaves are
encoded by different tasks, and neighbours are joined up the tree. At each join a window of tokens from both sides is
encoded again, and grows until it begins and ends where both sides are sure to agree and its outer tokens are those that
the sides have there. There are two such places:

* *Between units.* The vocabulary forms no token across a space that follows a visible character (see ``tokens``), so what
  lies beyond such a space does not depend on the other side.
* *Inside a run* that the library's pre-tokenizer leaves whole: a token sequence is the encoding of its bytes exactly if
  every adjacent pair is (the encoding of the pair's bytes). Units of more than ``LEAF`` characters are cut into such
  runs first, and a run that is still longer into halves of its own.

Shorter texts are leaves by themselves and are encoded where they are read, without a shuffle.

Cases: a null text is an empty one: no tokens; repeated rows and rows without an id give a row each and are dealt like
others, by their place in the scan; an empty table gives no rows; the string of a special token is that token, as in the
library; input columns other than the id and text are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm import common, tokens

LEAF = 4096

RESULT = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
_IDS, _RUN, _TEXT = 0, 1, 2
#: Rows between the tasks: part ``seq`` of row ``row``: packed ids, or the UTF-8 leaf of run number ``run`` or of the text.
_PART_DDL = "doc_id bigint, row bigint, seq bigint, kind tinyint, run bigint, payload binary"
_PART = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("seq", pa.int64()), ("kind", pa.int8()), ("run", pa.int64()), ("payload", pa.binary())])


def join_tokens(left: list[int], right: list[int], bytes_of: list[bytes], encode: Callable[[str], list[int]]) -> list[int]:
    """The encoding of the two sides' bytes together."""
    if not left or not right:
        return left + right
    inside = lambda side, i: 0 < i < len(side) and bytes_of[side[i]][0] & 0xC0 == 0x80
    size = 4
    while True:
        a, b = max(0, len(left) - size), min(len(right), size)
        while inside(left, a):
            a -= 1
        while inside(right, b):
            b += 1
        window = b"".join([bytes_of[i] for i in left[a:] + right[:b]])
        mid = encode(window.decode())
        if (a == 0 or mid[0] == left[a]) and (b == len(right) or mid[-1] == right[b - 1]):
            return left[:a] + mid + right[b:]
        size *= 2


def _starts_unit(side: list[int], i: int, bytes_of: list[bytes]) -> bool:
    """Whether token ``i`` begins with a space that follows a visible character of the same side."""
    if not 0 < i < len(side) or bytes_of[side[i]][:1] != b" ":
        return False
    tail, back = b"", i
    while back and len(tail) < 4:
        back -= 1
        tail = bytes_of[side[back]] + tail
    last = tail[-4:].decode("utf-8", "ignore")[-1:]
    return bool(last) and not last.isspace()


def join_texts(left: list[int], right: list[int], bytes_of: list[bytes], encode: Callable[[str], list[int]]) -> list[int]:
    """The encoding of two texts together, from their encodings, by windows that begin and end between units."""
    if not left or not right:
        return left + right
    size = 4
    while True:
        a, b = max(0, len(left) - size), min(len(right), size)
        while a and not _starts_unit(left, a, bytes_of):
            a -= 1
        while b < len(right) and not _starts_unit(right, b, bytes_of):
            b += 1
        mid = encode(b"".join([bytes_of[i] for i in left[a:] + right[:b]]).decode())
        if (a == 0 or mid[0] == left[a]) and (b == len(right) or mid[-1] == right[b - 1]):
            return left[:a] + mid + right[b:]
        size *= 2


def join_tree(leaves: list[list[int]], bytes_of: list[bytes], encode: Callable[[str], list[int]], join: Callable = join_tokens) -> list[int]:
    while len(leaves) > 1:
        pairs = [join(leaves[i], leaves[i + 1], bytes_of, encode) for i in range(0, len(leaves) - 1, 2)]
        leaves = pairs + leaves[len(leaves) - len(leaves) % 2 :]
    return leaves[0] if leaves else []


def halves(text: str, leaf: int) -> list[str]:
    """The leaves of the tree: the text cut in two until no part is longer than ``leaf``."""
    if len(text) <= leaf:
        return [text]
    return halves(text[: len(text) // 2], leaf) + halves(text[len(text) // 2 :], leaf)


@lru_cache(2)
def _unsplit(path: str):
    """The library's encoder for one run that its pre-tokenizer leaves whole."""
    from tokenizers import pre_tokenizers

    tok = tokens._load(path)
    tok.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    tok.encode_special_tokens = True
    return lambda s: tok.encode(s, add_special_tokens=False).ids


def _parts(units, text: str, leaf: int) -> list[tuple[int, int, bytes]]:
    """(kind, run, payload) of a long text: the leaves of the text, or, if a unit is long, packed ids and the leaves of runs."""
    if max(map(len, units.cut(text)), default=0) <= leaf:
        return [(_TEXT, -1, _sent(h.encode())) for h in halves(text, leaf)]
    out: list[tuple[int, int, bytes]] = []
    short: list[str] = []
    pending: list[bytes] = []

    def close() -> None:
        pending.extend(units.encode_units(short))
        short.clear()
        if pending:
            out.append((_IDS, -1, b"".join(pending)))
            pending.clear()

    for unit in units.cut(text):
        if len(unit) <= leaf:
            short.append(unit)
            continue
        for piece, special in units.segments(unit):
            if special is not None:
                pending.extend(units.encode_units(short))
                short.clear()
                pending.append(tokens._pack([special]))
                continue
            for _, (a, b) in units.full.pre_tokenizer.pre_tokenize_str(piece):
                if b - a <= leaf:
                    pending.extend(units.encode_units(short))
                    short.clear()
                    pending.append(tokens._pack(units.full.encode(piece[a:b], add_special_tokens=False).ids))
                else:
                    close()
                    run = len(out)
                    out += [(_RUN, run, _sent(h.encode())) for h in halves(piece[a:b], leaf)]
    close()
    return out


def encode_decode(docs: DataFrame, tokenizer_path: str, leaf: int = LEAF) -> DataFrame:
    """Token count, digest of the ids and digest of the decoded text of every row."""

    def digest(units, doc_id, packed: bytes) -> tuple:
        decoded = units.decode(packed).encode()
        return (doc_id, len(packed) // 4, hashlib.sha256(packed).hexdigest(), hashlib.sha256(decoded).hexdigest())

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = tokens.byte_units(tokenizer_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                ids = batch.column(0).slice(at, 512).to_pylist()
                encoded = units.encode([t or "" for t in batch.column(1).slice(at, 512).to_pylist()])
                yield _batch([digest(units, *x) for x in zip(ids, encoded)], _OUT)
        units.forget()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = tokens.byte_units(tokenizer_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 16):
                part = batch.slice(at, 16).to_pydict()
                rows = [(d, r, seq, *p) for d, r, t in zip(part["doc_id"], part["row"], part["text"]) for seq, p in enumerate(_parts(units, t, leaf))]
                yield _batch(rows, _PART)
        units.forget()

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, encode = tokens.byte_units(tokenizer_path), None
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                kinds, payload = part.column("kind").to_pylist(), part.column("payload").to_pylist()
                encoded = iter(units.encode([zlib.decompress(p).decode() for k, p in zip(kinds, payload) if k == _TEXT]))
                for i, kind in enumerate(kinds):
                    if kind == _TEXT:
                        payload[i] = _narrow(next(encoded), units)
                    elif kind == _RUN:
                        encode = encode or _unsplit(tokenizer_path)
                        payload[i] = _narrow(tokens._pack(encode(zlib.decompress(payload[i]).decode())), units)
                yield part.set_column(part.schema.get_field_index("payload"), "payload", pa.array(payload, pa.binary()))
        units.forget()

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = tokens.byte_units(tokenizer_path)
        at, parts = None, []
        for batch in batches:
            rows = []
            for row in batch.to_pylist():  # a text's parts follow each other
                if row["row"] != at and parts:
                    rows.append(finish(units, parts))
                    parts = []
                at = row["row"]
                parts.append(row)
            yield _batch(rows, _OUT)
        if parts:
            yield _batch([finish(units, parts)], _OUT)
        units.forget()

    def finish(units, parts: list[dict]) -> tuple:
        packed: list[bytes] = []
        group: list[list[int]] = []
        for row, following in zip(parts, [*parts[1:], None]):
            if row["kind"] == _IDS:
                packed.append(row["payload"])
                continue
            group.append(memoryview(zlib.decompress(row["payload"])).cast(_code(units)).tolist())
            if following is None or (following["kind"], following["run"]) != (row["kind"], row["run"]):
                if row["kind"] == _TEXT:
                    joined = join_tree(group, units.bytes_of, lambda t: memoryview(units.encode([t])[0]).cast("I").tolist(), join_texts)
                else:
                    joined = join_tree(group, units.bytes_of, _unsplit(tokenizer_path))
                packed.append(tokens._pack(joined))
                group = []
        return digest(units, parts[0]["doc_id"], b"".join(packed))

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    long = F.coalesce(F.length("text") > leaf, F.lit(False))
    parts = rows.where(long).withColumn("row", F.monotonically_increasing_id()).mapInArrow(cut, _PART_DDL)
    encoded = parts.repartition(n, "row", "seq").mapInArrow(leaves, _PART_DDL)
    joined = encoded.repartition(n, "row").sortWithinPartitions("row", "seq").mapInArrow(join, RESULT)
    return rows.where(~long).mapInArrow(whole, RESULT).union(joined)


def _code(units) -> str:
    """Ids travel in two bytes where the vocabulary lets them."""
    return "H" if len(units.bytes_of) <= 1 << 16 else "I"


def _narrow(packed: bytes, units) -> bytes:
    return _sent(array(_code(units), memoryview(packed).cast("I").tolist()).tobytes())


def _sent(payload: bytes) -> bytes:
    """Leaves are smaller than a shuffle's own compression can make them block by block."""
    return zlib.compress(payload, 1)


_OUT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def op10_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(common.read_table(spark, sf_dir, "documents"), tokens.public_path("byte_bpe_50k.json"))
