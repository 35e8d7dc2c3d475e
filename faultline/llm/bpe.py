"""Byte-pair encoding as a bounded-lookahead streaming transducer, and its incremental decoder.

A merge list fixes how far to the right a merge can depend on its surroundings: a merge (a, b) is undone only by an
earlier merge (x, y) whose left part x ends where b ends (x on the right spine of b), that one only by a still earlier
one, and so on. ``lookahead`` follows these chains in the order of ranks and gives the longest reach. The encoder keeps
a window of that length and a token's length: tokens that end a lookahead before the window's end are stable and are
emitted, and encoding starts again behind them. Memory depends on the merge list, not on the text.

Defined results: a null text counts as empty; an empty text has no ids and decodes to the empty text; the strings of
special tokens are special wherever they stand; repeated rows give repeated results; further columns of the input
are not read.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
import sys
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from faultline.llm.common import Memo, map_text, narrow

#: Texts above so many characters are matched piece by piece.
LONG_TEXT, RUN_WORDS = 2_000_000, 100_000
#: What the vocabularies' library knows of newer versions of Unicode than Python, or doesn't know yet: letters, numbers,
#: lower case, and combining marks that it leaves in their place.
LATER = {
    "L": "1c89-1c8a a7cb-a7cd a7da-a7dc 105c0-105f3 10d4a-10d65 10d6f-10d85 10ec2-10ec4 11380-11389 1138b 1138e 11390-113b5 113b7 113d1 113d3 11bc0-11be0 13460-143fa 16100-1611d 16d40-16d6c 18cff 1e5d0-1e5ed 1e5f0",
    "N": "10d40-10d49 116d0-116e3 11bf0-11bf9 16130-16139 16d70-16d79 1ccf0-1ccf9 1e5f1-1e5fa",
}
LOWER = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B, ord("Σ"): ord("σ")} | {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}
FIXED = "7fd 898-89f 8ca-8d3 9fe c3c d3b-d3c eba 1715 1abf-1ace 1df6-1dfa a82c 10d24-10d27 10eab-10eac 10efd-10eff 10f46-10f50 10f82-10f85 11070 1133b 1145e 11839-1183a 1193d-1193e 11943 119e0 11a34 11a47 11a99 11d42 11d44-11d45 11d97 11f41-11f42 16ff0-16ff1 1e08f 1e130-1e136 1e2ae 1e2ec-1e2ef 1e4ec-1e4ef"
SPACE = "\t-\r \x85\xa0  -     　"


def _spans(listed: str) -> list[tuple[int, int]]:
    return [(int(x.split("-")[0], 16), int(x.split("-")[-1], 16)) for x in listed.split()]


def _members(spans: list[tuple[int, int]], most: int) -> str:
    """A regex class body of the code points of ``spans`` up to ``most``."""
    return "".join(f"\\U{a:08x}-\\U{min(b, most):08x}" for a, b in spans if a <= most)


def _category(prefix: str) -> list[tuple[int, int]]:
    """The spans of code points whose general category starts with ``prefix``."""
    extra = {c for a, b in _spans(LATER[prefix]) for c in range(a, b + 1)}
    out, start = [], None
    for cp in range(sys.maxunicode + 2):
        inside = cp <= sys.maxunicode and (unicodedata.category(chr(cp))[0] == prefix or cp in extra)
        if inside and start is None:
            start = cp
        elif not inside and start is not None:
            out.append((start, cp - 1))
            start = None
    return out


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(other)) for b in range(256)]


_fixed = re.compile(f"([{_members(_spans(FIXED), sys.maxunicode)}]+)")
_astral = re.compile("[\U00010000-\U0010ffff]")
_uncommon = re.compile("[" + "".join(map(chr, LOWER)) + "]")


class Merges:
    """A merge list over numbered symbols, and its sufficient lookahead."""

    def __init__(self, vocab: dict[str, int], merges: Iterable[tuple[str, str]]):
        self.rank: dict[int, int] = {}
        self.made: list[int] = []
        width, right = {}, {}
        reach: dict[int, int] = {}
        self.lookahead, self.widest = 0, 1
        for rank, (a, b) in enumerate(merges):
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            self.rank.setdefault(x << 20 | y, rank)
            self.made.append(z)
            spine, far = y, reach.get(y, 0)
            while spine in right:
                spine = right[spine]
                far = max(far, reach.get(spine, 0))
            far += width.get(y, 1)
            if far > reach.get(x, 0):
                reach[x] = far
            self.lookahead = max(self.lookahead, far)
            if z not in width:
                width[z], right[z] = width.get(x, 1) + width.get(y, 1), y
            self.widest = max(self.widest, width[z])
        self.width = width
        self.window = 2 * (self.lookahead + self.widest)

    def apply(self, symbols: list[int]) -> list[int]:
        """All merges over one window."""
        get, made, none = self.rank.get, self.made, len(self.made)
        ranks = [get(a << 20 | b, none) for a, b in zip(symbols, symbols[1:])]
        while ranks and (rank := min(ranks)) < none:
            i = ranks.index(rank)
            new = symbols[i] = made[rank]
            del symbols[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get(symbols[i - 1] << 20 | new, none)
            if i < len(ranks):
                ranks[i] = get(new << 20 | symbols[i + 1], none)
        return symbols

    def stream(self, symbols: Iterable[int]) -> Iterator[int]:
        """Tokens of a symbol stream of any length, emitted once they are stable."""
        source, held, width = iter(symbols), [], self.width
        while True:
            held += islice(source, self.window - len(held))
            if len(held) < self.window:
                yield from self.apply(held)
                return
            used, stable = 0, self.window - self.lookahead
            for token in self.apply(list(held)):
                size = width.get(token, 1)
                if used + size > stable:
                    break
                used += size
                yield token
            held = held[used:]


class Codec:
    """Encoder and decoder of one vocabulary file (BPE, byte level, optionally with word ends)."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.merges = Merges(self.vocab, merges)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.folds = bool(spec["normalizer"])
        letters, numbers = _category("L"), _category("N")
        # a class with astral ranges is slow, so texts without astral characters have a pattern of their own
        self.patterns = [self.pattern(_members(letters, most), _members(numbers, most)) for most in (0xFF, 0xFFFF, sys.maxunicode)]
        alphabet = byte_alphabet()
        self.first = [self.vocab[c] for c in alphabet]
        self.last = [self.vocab[c + self.suffix] for c in alphabet]
        self.memo = Memo(self.word)
        texts = {i: t for t, i in (self.vocab | self.special).items()}
        self.texts = [texts.get(i, "") for i in range(max(texts) + 1)]
        self.packed = [t.encode() for t in self.texts]
        self.joined = spec["decoder"] is None
        value = {c: b for b, c in enumerate(alphabet)}
        special = set(self.special)
        self.bytes = [t.encode() if t in special else bytes(value[c] for c in t) if all(c in value for c in t) else t.encode() for t in self.texts]

    def pattern(self, letters: str, numbers: str) -> re.Pattern:
        short = "'(?:[stmd]|re|ve|ll)"
        if self.folds:
            return re.compile(f"[{letters}]+|{short}|[{numbers}]|[^{SPACE}{letters}{numbers}]+")
        return re.compile(f"{short}| ?(?:[{letters}]+|[{numbers}]+|[^{SPACE}{letters}{numbers}]+)|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")

    def words(self, text: str) -> re.Pattern:
        """The pattern that splits ``text``."""
        try:
            text.encode("latin-1")
            return self.patterns[0]
        except UnicodeEncodeError:
            return self.patterns[2 if _astral.search(text) else 1]

    def word(self, word: str) -> bytes:
        """The packed ids of one pre-token."""
        raw = word.encode("utf-8", "surrogatepass")
        first = self.first
        if len(raw) < self.merges.window:
            ids = self.merges.apply([*map(first.__getitem__, raw[:-1]), self.last[raw[-1]]])
        else:
            ids = self.merges.stream(first[b] if i else self.last[b] for i, b in zip(range(len(raw) - 1, -1, -1), raw))
        return array("I", ids).tobytes()

    def fold(self, text: str) -> str:
        """The vocabulary's normalisation: composed, lower case letter by letter; blanks only separate words."""
        if text.isascii():
            return text.lower()
        if not unicodedata.is_normalized("NFC", text):
            text = "".join(x if i % 2 else unicodedata.normalize("NFC", x) for i, x in enumerate(_fixed.split(text)))
        if _uncommon.search(text):
            text = text.translate(LOWER)
        return text.lower()

    def parts(self, text: str) -> Iterator[tuple[str, int | None]]:
        """Ordinary stretches and special tokens in turn."""
        at = 0
        for m in self.split.finditer(text) if self.split and "<|" in text else ():
            yield text[at : m.start()], self.special[m.group()]
            at = m.end()
        yield text[at:] if at else text, None

    def encode_runs(self, text: str) -> Iterator[bytes]:
        """Packed little-endian unsigned 32-bit ids, in runs of bounded length for long texts."""
        get = self.memo.__getitem__
        for part, special in self.parts(text):
            if part:
                if self.folds:
                    part = self.fold(part)
                if len(part) <= LONG_TEXT:
                    yield b"".join(map(get, self.words(part).findall(part)))
                else:
                    found = (m.group() for m in self.words(part).finditer(part))
                    while run := list(islice(found, RUN_WORDS)):
                        yield b"".join(map(get, run))
            if special is not None:
                yield special.to_bytes(4, "little")

    def encode(self, text: str | None) -> bytes:
        return b"".join(self.encode_runs(text or ""))

    def decoder(self) -> Decoder:
        return Decoder(self)

    def decode(self, ids: Iterable[int]) -> str:
        state = self.decoder()
        return state.feed(ids) + state.close()


class Decoder:
    """Incremental ids to text: the bytes of each id go through a UTF-8 state machine that holds back at most an
    unfinished character; ill-formed bytes become U+FFFD. Without a byte decoder in the vocabulary file, tokens are
    written as they are, with a blank between."""

    def __init__(self, codec: Codec):
        self.codec, self.begun = codec, False
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")

    def raw(self, ids: Iterable[int]) -> bytes:
        codec = self.codec
        if not codec.joined:
            return b"".join(map(codec.bytes.__getitem__, ids))
        out = b" ".join(map(codec.packed.__getitem__, ids))
        if self.begun and out:
            out = b" " + out
        self.begun = self.begun or bool(out)
        return out

    def feed(self, ids: Iterable[int]) -> str:
        return self.machine.decode(self.raw(ids))

    def close(self) -> str:
        return self.machine.decode(b"", final=True)


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec a worker and file."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids binary): each text's packed ids."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(path)
        return pa.RecordBatch.from_arrays([b.column(0), pa.array([c.encode(t) for t in b.column(1).to_pylist()], pa.binary())], ["id", "ids"])

    return map_text(narrow(df, id_col, text_col), run, "id long, ids binary", text_col).withColumnRenamed("id", id_col)


def decode(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) from packed ids; null ids count as none."""

    def run(batches):
        c = codec(path)
        for b in batches:
            texts = [c.decode(np.frombuffer(x or b"", dtype="<u4").tolist()) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["id", "text"])

    return narrow(df, id_col, ids_col).mapInArrow(run, "id long, text string").withColumnRenamed("id", id_col)


def round_trip(df: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: every text encoded, and its ids decoded, in one pass."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        c, n, ids_sha, text_sha = codec(path), [], [], []
        for text in b.column(1).to_pylist():
            ids_hash, text_hash, count, state = hashlib.sha256(), hashlib.sha256(), 0, c.decoder()
            for run_ids in c.encode_runs(text or ""):
                ids_hash.update(run_ids)
                ids = array("I", run_ids)
                count += len(ids)
                if c.joined:  # token texts are valid UTF-8 by themselves, which the state machine passes through
                    text_hash.update(state.raw(ids))
                else:
                    text_hash.update(state.feed(ids).encode())
            if not c.joined:
                text_hash.update(state.close().encode())
            n.append(count)
            ids_sha.append(ids_hash.hexdigest())
            text_sha.append(text_hash.hexdigest())
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(text_sha)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_text(narrow(df, "doc_id", "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
