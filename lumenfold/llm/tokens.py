"""Token ids of whole texts through the tokenizers library, one space-delimited unit at a time.

Neither public BPE vocabulary ever forms a token across a single space that follows a visible character, so a
text's ids are the ids of its units in order. Units repeat, so a task keeps a dictionary of those it has seen; it is
emptied when it reaches ``CACHE_UNITS`` entries, which bounds its memory, and when the task ends, since the Python
worker lives on and serves other stages.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterable
from functools import lru_cache

import numpy as np

CACHE_UNITS = 500_000

#: Characters whose classes do not depend on a library's Unicode version.
_STABLE = r"\x09-\x0d\x20-\x7e\xa0-ɏ"
_WORD_STABLE = re.compile(r"[\x09-\x0d\x20-\x7e\xc0-ɏ]*")
_BYTE_STABLE = re.compile(f"[{_STABLE}]+")
_WORD_PIECES = re.compile(r" |'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
#: Stands between units in a row of packed ids; ids are far below 2**24, so their bytes never hold it.
_MARK = b"\xff\xff\xff\xff"
_SPACE_CUT = re.compile(r"(?<=\S)(?= )")
_ODD_SPACE = re.compile(r"\s ")


def _load(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    tok.model._resize_cache(0)  # this module's dictionary takes its place
    return tok


def _pack(ids: Iterable[int]) -> bytes:
    return array("I", ids).tobytes()


class WordUnits:
    """Ids of the lower-casing word-end BPE; white space carries no tokens, so units are what ``' '`` separates."""

    def __init__(self, path: str):
        from tokenizers import pre_tokenizers

        self.full = _load(path)
        self.words = _load(path)
        self.words.normalizer = None
        self.words.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        vocab = self.full.get_vocab()
        #: Whether an id is a word's last one.
        self.closes = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.closes[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
        self.units = _Known()
        self.pieces: dict[str, bytes] = {}

    def forget(self) -> None:
        self.units, self.pieces = _Known(), {}

    def learn(self, missing: list[str]) -> list[bytes]:
        joined = " ".join(missing)
        if "<|" in joined or not _WORD_STABLE.fullmatch(joined):
            plain = ["<|" not in unit and _WORD_STABLE.fullmatch(unit) is not None for unit in missing]
            quick = iter(self._learn_stable([u for u, p in zip(missing, plain) if p]))
            slow = iter(self.full.encode_batch_fast([u for u, p in zip(missing, plain) if not p], add_special_tokens=False))
            return [next(quick) if p else _pack(next(slow).ids) for p in plain]
        return self._learn_stable(missing)

    def _learn_stable(self, missing: list[str]) -> list[bytes]:
        if not missing:
            return []
        parts = _WORD_PIECES.findall(" ".join(missing).lower())
        if len(self.pieces) > CACHE_UNITS:
            self.pieces.clear()
        fresh = list(set(parts).difference(self.pieces, (" ",)))
        groups = [fresh[i : i + 1000] for i in range(0, len(fresh), 1000)]
        for group, e in zip(groups, self.words.encode_batch_fast(groups, is_pretokenized=True, add_special_tokens=False)):
            ids = np.array(e.ids, dtype="<u4")
            packed, at = ids.tobytes(), 0
            for word, end in zip(group, (4 * np.flatnonzero(self.closes[ids]) + 4).tolist()):
                self.pieces[word] = packed[at:end]
                at = end
        self.pieces[" "] = _MARK
        return b"".join(map(self.pieces.__getitem__, parts)).split(_MARK)

    def encode(self, texts: list[str]) -> list[bytes]:
        return _encode_all(self, [t.split(" ") for t in texts])


class ByteUnits:
    """Ids of the byte-level BPE; a unit is a visible run with the space before it."""

    def __init__(self, path: str):
        import tiktoken

        self.full = _load(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte = _byte_alphabet()
        vocab = {k: v for k, v in spec["model"]["vocab"].items()}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(to_byte[c] for c in k): v for k, v in vocab.items() if k not in special}
        #: The bytes of every id, for decoding.
        self.bytes_of = [b""] * (max(*vocab.values(), *special.values()) + 1)
        for b, i in ranks.items():
            self.bytes_of[i] = b
        for s, i in special.items():
            self.bytes_of[i] = s.encode()
        self.special_ids = special
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        #: The library's own pattern for this pre-tokenizer, and merges in order of rank.
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.plain = tiktoken.Encoding("units", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.units = _Known()

    def cut(self, text: str) -> list[str]:
        """The units of a text: it is cut before each space that follows a visible character."""
        if "\0" in text or _ODD_SPACE.search(text):
            return _SPACE_CUT.split(text)
        return text.replace(" ", "\0 ").split("\0")

    def forget(self) -> None:
        self.units = _Known()

    def learn(self, missing: list[str]) -> list[bytes]:
        plain = ["<|" not in unit and _BYTE_STABLE.fullmatch(unit) is not None for unit in missing]
        slow = iter(self.full.encode_batch_fast([u for u, p in zip(missing, plain) if not p], add_special_tokens=False))
        encode = self.plain._core_bpe.encode_ordinary
        return [_pack(encode(u)) if p else _pack(next(slow).ids) for u, p in zip(missing, plain)]

    def encode(self, texts: list[str]) -> list[bytes]:
        return _encode_all(self, [self.cut(t) for t in texts])

    def encode_units(self, units: list[str]) -> list[bytes]:
        return _encode_all(self, [units]) if units else []

    def segments(self, unit: str) -> list[tuple[str, int | None]]:
        """The unit between special tokens, and those tokens with their ids."""
        out, at = [], 0
        for m in self.special.finditer(unit) if self.special else ():
            out += [(unit[at : m.start()], None)] * (m.start() > at) + [(m[0], self.special_ids[m[0]])]
            at = m.end()
        return out + [(unit[at:], None)] * (at < len(unit))

    def decode(self, ids: bytes) -> str:
        """As the library decodes: the bytes of the ids, with U+FFFD for what is not UTF-8."""
        return b"".join(map(self.bytes_of.__getitem__, memoryview(ids).cast("I").tolist())).decode("utf-8", "replace")


class _Known(dict):
    """Units already encoded; one that is not is noted and stands as None until it has been learnt."""

    def __init__(self):
        super().__init__({"": b""})
        self.new: list[str] = []

    def __missing__(self, unit: str) -> None:
        self.new.append(unit)
        self[unit] = None


def _encode_all(units, cut: list[list[str]]) -> list[bytes]:
    out: list[bytes] = []
    known = units.units
    for at in range(0, len(cut), 256):
        if len(known) > CACHE_UNITS:
            known = units.units = _Known()
        found = [list(map(known.__getitem__, u)) for u in cut[at : at + 256]]
        if known.new:
            got = dict(zip(known.new, units.learn(known.new)))
            for u, f in zip(cut[at : at + 256], found):
                if None in f:
                    f[:] = [got[x] if y is None else y for x, y in zip(u, f)]
            known.update(got)
            for unit in [x for x in known.new if len(x) > 64]:
                del known[unit]
            known.new = []
        out += map(b"".join, found)
    return out


@lru_cache(1)
def _byte_alphabet() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others, in order, from U+0100."""
    keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in keep]
    return {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(2)
def word_units(path: str) -> WordUnits:
    """One per Python worker, which serves many tasks; loading the vocabulary takes a second."""
    return WordUnits(path)


@lru_cache(2)
def byte_units(path: str) -> ByteUnits:
    return ByteUnits(path)


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
