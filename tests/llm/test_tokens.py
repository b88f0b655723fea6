"""Packing and BPE against the tokenizers library itself."""

import hashlib
import random
import zlib
from array import array

import pytest
from tokenizers import Tokenizer

from lumenfold.llm import bpe, packing, tokens

PARTS = ["a", "É", "İ", "Σ", "'s", "'RE", "'", " ", "  ", "\n", "\t", "\xa0", "<|endoftext|>", "<|", "1", "½", "中文", "🙂", "é", "ß",
         "!!", "_", "$", "\x1c", "\x00", "\r\n", "the", "ing", " \n "]


def texts(n, seed=3):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 25))) for _ in range(n)]


def library(name):
    tok = Tokenizer.from_file(tokens.public_path(name))
    tok.no_truncation()
    tok.no_padding()
    return tok


def ids_of(tok, text):
    return array("I", tok.encode(text or "", add_special_tokens=False).ids)


@pytest.mark.parametrize(("name", "units"), [("word_bpe_49k.json", tokens.word_units), ("byte_bpe_50k.json", tokens.byte_units)])
def test_units_equal_library(name, units):
    tok, many = library(name), texts(3000)
    for text, packed in zip(many, units(tokens.public_path(name)).encode(many)):
        assert packed == ids_of(tok, text).tobytes(), repr(text)


@pytest.mark.parametrize("leaf", [3, 7, 40])
def test_tree_concatenation_is_exact(leaf):
    path = tokens.public_path("byte_bpe_50k.json")
    units, encode, rnd = tokens.byte_units(path), bpe._unsplit(path), random.Random(leaf)
    for _ in range(300):
        text = "".join(rnd.choice(rnd.choice(["ab", "theingtion", "aaaa", "中文é🙂", "antherestionly"])) for _ in range(rnd.randint(1, 200)))
        leaves = [encode(h) for h in bpe.halves(text, leaf)]
        assert bpe.join_tree(leaves, units.bytes_of, encode) == encode(text)


@pytest.mark.parametrize("leaf", [2, 5, 30, 200])
def test_texts_cut_anywhere_are_joined_exactly(leaf):
    """Halves of whole texts, with white space of all kinds, special tokens and other scripts at the cuts."""
    path, tok, rnd = tokens.public_path("byte_bpe_50k.json"), library("byte_bpe_50k.json"), random.Random(leaf)
    units = tokens.byte_units(path)
    encode = lambda t: memoryview(units.encode([t])[0]).cast("I").tolist()
    parts = [*PARTS, " the", " of", " and", "\u3000", "\u2003 ", "的", " 的", " don't", "<|endoftext|>", " <|endoftext|> "]
    for _ in range(150):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(1, 120)))
        assert bpe.join_tree([encode(h) for h in bpe.halves(text, leaf)], units.bytes_of, encode, bpe.join_texts) == list(ids_of(tok, text)), repr(text)


def test_default_leaf_splits_long_texts(spark):
    tok, rnd = library("byte_bpe_50k.json"), random.Random(8)
    words = ["the", "thing", "über", "的", "don't", "a\nb", "  ", "x1", "<|endoftext|>"]
    texts = [" ".join(rnd.choice(words) for _ in range(n)) for n in (10, 1500, 4000, 30_000)] + ["z" * 20_000 + " end", ("tail " * 3000)]
    assert sum(len(t) > bpe.LEAF for t in texts) == 5
    got = bpe.encode_decode(spark.createDataFrame(list(enumerate(texts)) * 2, "doc_id long, text string"), tokens.public_path("byte_bpe_50k.json")).collect()
    want = [(i, len(ids_of(tok, t)), hashlib.sha256(ids_of(tok, t).tobytes()).hexdigest()) for i, t in enumerate(texts)]
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256) for r in got) == sorted(want * 2)


def rows():
    many = texts(40) + ["", None, "x" * 300, "ab " * 50 + "é" * 90 + "<|endoftext|>" + "!" * 70 + " tail", " " * 99 + "z", "中" * 61]
    out = [(i, t, "clash") for i, t in enumerate(many)]
    return [*out, out[-1], out[-3], (None, "no id " + "q" * 99, "c"), (7, "same id", "c")]


def test_encode_decode_rows(spark):
    tok = library("byte_bpe_50k.json")
    docs = spark.createDataFrame(rows(), "doc_id long, text string, n_tokens string").repartition(3)
    got = sorted(map(tuple, bpe.encode_decode(docs, tokens.public_path("byte_bpe_50k.json"), leaf=16).collect()), key=str)
    want = []
    for doc_id, text, _ in rows():
        ids = ids_of(tok, text)
        back = tok.decode(list(ids), skip_special_tokens=False)
        want.append((doc_id, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert bpe.encode_decode(docs.limit(0), tokens.public_path("byte_bpe_50k.json")).count() == 0


def test_pieces_cover_documents_once(spark):
    tok = library("word_bpe_49k.json")
    docs = [(i, " ".join(["the thing"] * n), "c") for i, n in enumerate([0, 1, 5, 900, 1500, 2047, 2048, 5000, 12000, *range(300, 700, 3)])]
    docs += [(900, None, "c"), (901, "é!", "c")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, length string").repartition(2)
    got = packing.pack(frame, tokens.public_path("word_bpe_49k.json")).collect()
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for doc_id, text, _ in docs:
        ids, at = array("I", [*ids_of(tok, text), packing.END_ID]), 0
        for r in sorted(by_doc[doc_id], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= packing.CAPACITY
        padding += 0 if at & (at - 1) == 0 else packing.CAPACITY - at
    assert padding == 0
    assert packing.pack(frame.limit(0), tokens.public_path("word_bpe_49k.json")).count() == 0


def test_classes_hold_fixed_counts():
    packer = packing.HarmonicPacker(0)
    for i in range(300):
        packer.add(i, bytes(4 * 1200))  # class 3: three documents and a cut
    packer.finish()
    whole = {}
    for doc_id, _, n, _, total, sequence, _ in packer.rows:
        whole.setdefault(sequence, []).append(n == total)
    assert sum(x.count(True) == 3 for x in whole.values()) > 50


def test_documents_of_a_class_are_never_filler():
    """However many bins wait: documents of class 3 alone, and long ones at the end to fill their room."""
    packer = packing.HarmonicPacker(0)
    for i in range(1200):
        packer.add(i, bytes(4 * 1100))
    assert len(packer.waiting) == 400 and not packer.filler_tokens and not packer.rows
    for i in range(200):
        packer.add(5000 + i, bytes(4 * 5000))
    packer.finish()
    whole = {}
    for doc_id, _, n, _, total, sequence, _ in packer.rows:
        if doc_id < 5000:
            assert n == total
            whole[sequence] = whole.get(sequence, 0) + 1
    assert set(whole.values()) == {3}


def test_memory_stays_bounded():
    packer = packing.HarmonicPacker(0, held=64 * packing.CAPACITY)
    for i in range(2000):
        packer.add(i, bytes(4 * (300 + 37 * i % 3800)))
        packer.rows.clear()
        assert packer.held == sum(d.n for _, _, group in packer.waiting for d in group) <= 64 * packing.CAPACITY
        assert packer.filler_tokens <= packing.BACKLOG * packing.CAPACITY + 4096
