"""Removal of byte strings that an earlier document has, with hash-compared suffixes.

Prefix polynomial hashes give the hash of any substring in constant time; ``common_extension`` finds the common
extension of many pairs of suffixes at once by binary search over them, and ``suffix_sort`` is a mergesort whose
comparisons are such extensions. Equal windows are found by their hashes and verified byte by byte; the sort numbers them.

Sorting all suffixes of a corpus would move every one of them, so ``repeats`` first reduces what has to be compared:

1. Documents are dealt to chunks. Of the ``length``-byte windows of a document, neighbouring ones with the same least
   hash of a ``GRAM``-byte string form a run, which is anchored at this string. Equal windows have the same anchor at
   the same place, wherever they are. A chunk sends, for each distinct run, two hashes (anchor, whole run) and its first
   document, to partitions by ranges of the anchor's hash; copies within a chunk are combined before.
2. A run that an earlier document has as a whole is covered. Where runs share an anchor but differ, as at the ends of
   shared passages, their bytes are sent, and there all windows are grouped by hash; a window is covered if an equal
   one is in an earlier document.
3. Chunks get the answers back and remove the union of covered windows.

Texts are shuffled once (the three passes over chunks read the same exchange); anchors take some 13 bytes for 16 bytes
of text. Whole runs are compared by two independent hashes of 88 bits in all, ends of passages by their bytes.

Defined results: a null text counts as empty; texts shorter than ``length`` bytes stay; documents with equal doc_id
don't cover each other; a null doc_id counts as later than all others; an empty table gives no rows; further columns
are not read.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import mix64, narrow, text_bytes

GRAM = 20
#: Bytes of text of a chunk, of a block of the arrays, and behind a partition of anchors.
CHUNK, BLOCK, PART = 3 << 20, 1 << 20, 16 << 20
LAST = np.iinfo(np.int64).max
NONE, WHOLE, SHARED = 0, 1, 2
U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BYTES = mix64(np.arange(1, 257, dtype=np.uint64) * U(0xD6E8FEB86659FD93))
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n + 1 of each."""
    if not _powers or len(_powers[0]) <= n:
        size = 1 << max(12, int(n).bit_length())
        _powers.clear()
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _powers.append(np.cumprod(x, dtype=np.uint64))
    return _powers[0], _powers[1]


def prefix_hashes(raw: np.ndarray) -> np.ndarray:
    up, _ = powers(len(raw))
    out = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTES[raw] * up[: len(raw)], out=out[1:])
    return out


def substring_hash(prefix: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    return (prefix[at + size] - prefix[at]) * powers(len(prefix))[1][at]


def common_extension(prefix: np.ndarray, a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """The length of the common prefix of the suffixes at a and b, up to ``limit``, for arrays of pairs."""
    low, high = np.zeros(len(a), np.int64), limit.astype(np.int64)
    while (open_ := low < high).any():
        middle = (low + high + 1) >> 1
        same = substring_hash(prefix, a, middle) == substring_hash(prefix, b, middle)
        low = np.where(open_ & same, middle, low)
        high = np.where(open_ & ~same, middle - 1, high)
    return low


def words(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes at each place, as numbers that sort like them."""
    return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(raw, 8)[at]).view(">u8").ravel().astype(np.uint64)


def suffix_sort(raw: np.ndarray, prefix: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """The order of the suffixes at ``starts`` by their first ``depth`` bytes (all have so many, at least eight); ties
    in the order given. Their first eight bytes are sorted as numbers, what they leave equal by merging."""
    key = words(raw, starts)
    order = np.argsort(key, kind="stable")
    equal = key[order][1:] == key[order][:-1]
    tied = np.flatnonzero(np.r_[False, equal] | np.r_[equal, False]) if len(order) > 1 else np.zeros(0, np.int64)
    order[tied] = order[tied][_merge_sort(raw, prefix, starts[order[tied]], depth)]
    return order


def _merge_sort(raw: np.ndarray, prefix: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """Bottom-up mergesort: all merges of a level run together, each by binary search for the places."""
    n = len(starts)
    order, width = np.arange(n), 1

    def less(a: np.ndarray, b: np.ndarray, or_equal: bool) -> np.ndarray:
        x, y = starts[a], starts[b]
        ext = common_extension(prefix, x, y, np.full(len(a), depth))
        same = ext >= depth
        inside = np.minimum(ext, depth - 1)
        return np.where(same, or_equal, raw[x + inside] < raw[y + inside])

    while width < n:
        at = np.arange(n)
        block = at // (2 * width) * (2 * width)
        left = at - block < width
        other_low = np.where(left, np.minimum(block + width, n), block)
        other_high = np.where(left, np.minimum(block + 2 * width, n), np.minimum(block + width, n))
        low, high = other_low.copy(), other_high.copy()
        while len(open_ := np.flatnonzero(low < high)):
            middle = (low[open_] + high[open_]) >> 1
            mine, theirs = order[open_], order[middle]
            # of equal suffixes, those of the left half come first
            before = np.empty(len(open_), bool)
            is_left = left[open_]
            before[is_left] = less(theirs[is_left], mine[is_left], False)
            before[~is_left] = less(theirs[~is_left], mine[~is_left], True)
            low[open_] = np.where(before, middle + 1, low[open_])
            high[open_] = np.where(before, high[open_], middle)
        place = block + (at - np.where(left, block, block + width)) + (low - other_low)
        merged = np.empty_like(order)
        merged[place] = order
        order, width = merged, 2 * width
    return order


def equal_groups(raw: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """A number for each start: equal for equal strings of ``depth`` bytes there. Their hashes make the
    groups, their bytes verify them; the suffix sort only numbers them."""
    prefix = prefix_hashes(raw)
    # strings with a hash of their own equal no other, and need no sorting
    hashed = substring_hash(prefix, starts, np.full(len(starts), depth))
    by = np.argsort(hashed, kind="stable")
    equal = hashed[by][1:] == hashed[by][:-1]
    several = np.zeros(len(starts), bool)
    several[by[1:][equal]] = True
    several[by[:-1][equal]] = True
    group = np.arange(len(starts)) + len(starts)
    some = np.flatnonzero(several)
    if len(some):
        # one of each hash is sorted, the others are verified against it
        heads = by[np.r_[True, ~equal]]
        sizes = np.diff(np.r_[np.flatnonzero(np.r_[True, ~equal]), len(by)])
        head_of = np.empty(len(starts), np.int64)
        head_of[by] = np.repeat(heads, sizes)
        sorted_heads = heads[sizes > 1]
        ranks = np.empty(len(starts), np.int64)
        ranks[sorted_heads[suffix_sort(raw, prefix, starts[sorted_heads], depth)]] = np.arange(len(sorted_heads))
        differ = np.zeros(len(some), bool)
        for i in [*range(0, depth - 8, 8), depth - 8]:
            differ |= words(raw, starts[some] + i) != words(raw, starts[head_of[some]] + i)
        group[some] = ranks[head_of[some]]
        if differ.any():  # collisions: these few by their bytes
            odd: dict[bytes, int] = {}
            for i in some[differ]:
                group[i] = odd.setdefault(raw[starts[i] : starts[i] + depth].tobytes(), 2 * len(starts) + len(odd))
    return group


class Chunk:
    """The documents of a chunk in a fixed order, and their runs."""

    def __init__(self, table: pa.Table, length: int):
        ids = np.array([LAST if x is None else x for x in table["doc_id"].to_pylist()], np.int64)
        texts = [x or b"" for x in table["text"].to_pylist()]
        order = sorted(range(len(ids)), key=lambda i: (ids[i], texts[i]))
        self.rows = order
        self.ids = ids[order]
        self.sizes = np.array([len(texts[i]) for i in order], np.int64)
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        self.raw = np.frombuffer(b"".join(texts[i] for i in order), np.uint8)
        self.length = length
        parts = [self._runs(a, b) for a, b in self._blocks()]
        self.low, self.high, self.anchor, self.h, self.c = (np.concatenate(x) if parts else np.zeros(0, np.int64) for x in (zip(*parts) if parts else [[]] * 5))
        self.h, self.c = self.h.astype(np.uint64), self.c.astype(np.uint64)
        self.doc = np.searchsorted(self.ends, self.low, side="right")
        # distinct runs, in the order of their hashes; the first of each is of the earliest document
        by = np.lexsort((self.c, self.h))
        new = np.r_[True, (self.h[by][1:] != self.h[by][:-1]) | (self.c[by][1:] != self.c[by][:-1])] if len(by) else np.zeros(0, bool)
        self.first = by[new]
        self.distinct = np.empty(len(by), np.int64)
        self.distinct[by] = np.cumsum(new) - 1

    def _blocks(self):
        """Ranges of window starts."""
        n = len(self.raw) - self.length + 1
        return [(a, min(a + BLOCK, n)) for a in range(0, n, BLOCK)]

    def _runs(self, begin: int, end: int):
        length, raw = self.length, self.raw[begin : end + self.length - 1]
        prefix = prefix_hashes(raw)
        n = len(raw) - GRAM + 1
        grams = mix64((prefix[GRAM:] - prefix[:n]) * powers(len(prefix))[1][:n])
        mask = U((1 << 22) - 1)
        least = (grams & ~mask) | np.arange(n, dtype=np.uint64)
        width, have = length - GRAM + 1, 1
        while 2 * have <= width:
            least = np.minimum(least[:-have], least[have:])
            have *= 2
        if have < width:
            least = np.minimum(least[: have - width], least[width - have :])
        at = (least & mask).astype(np.int64)
        valid = np.ones(len(at) + 1, bool)
        for e in self.ends[(self.ends > begin) & (self.ends < end + length)].tolist():
            valid[max(0, e - begin - length + 1) : max(0, e - begin)] = False
        starts = np.flatnonzero(valid[:-1])
        at = at[starts]
        new = np.r_[True, (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)] if len(at) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        last = np.r_[first[1:], len(at)] - 1
        low, high, anchor = starts[first] if len(first) else first, starts[last] if len(first) else first, at[first] if len(first) else first
        whole = substring_hash(prefix, low, high - low + length)
        c = mix64(whole + (anchor - low).astype(np.uint64) * U(0xA24BAED4963EE407) + (high - low).astype(np.uint64) * U(0x9FB21C651E98DF25))
        # least hashes are small numbers; mixed again, they are spread evenly
        return low + begin, high + begin, anchor + begin, mix64(grams[anchor] + U(0x8EBC6AF09C88C6E3)), c

    def parts_of(self, parts: int) -> np.ndarray:
        """The partition of each distinct run, ascending."""
        return ((self.h[self.first] >> U(32)) * U(parts) >> U(32)).astype(np.int64)


def _unpack(blob: bytes, size: int) -> np.ndarray:
    """Unsigned numbers of ``size`` bytes each, the lowest first."""
    out = np.zeros((len(blob) // size, 8), np.uint8)
    out[:, :size] = np.frombuffer(blob, np.uint8).reshape(-1, size)
    return out.view(np.uint64).ravel()


def _pack(values: np.ndarray, size: int) -> bytes:
    return np.ascontiguousarray(values.astype(np.uint64)).view(np.uint8).reshape(-1, 8)[:, :size].tobytes()


def _edges(part: np.ndarray) -> list[tuple[int, int, int]]:
    """(partition, from, to) of the runs of an ascending array."""
    if not len(part):
        return []
    at = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
    return list(zip(part[at].tolist(), at.tolist(), np.r_[at[1:], len(part)].tolist()))


def _send(length: int, parts: int):
    def run(table: pa.Table) -> pa.Table:
        chunk = Chunk(table, length)
        number = table["chunk"][0].as_py()
        rows: list[list] = [[], [], [], [], [], []]
        for part, a, b in _edges(chunk.parts_of(parts)):
            runs = chunk.first[a:b]
            used, index = np.unique(chunk.doc[runs], return_inverse=True)
            values = (part, number, _pack(chunk.h[runs], 5), _pack(chunk.c[runs], 6), chunk.ids[used].tobytes(), _pack(index, 4 if len(used) > 65535 else 2))
            for column, v in zip(rows, values):
                column.append(v)
        kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
        return pa.table([pa.array(c, k) for c, k in zip(rows, kinds)], names=["part", "chunk", "h", "c", "ids", "doc"])

    return run


SENT = "part int, chunk long, h binary, c binary, ids binary, doc binary"
ANSWER = "chunk long, part int, kind int, answer binary"


def _answers(chunks: list[int], part: int, kind: int, values: np.ndarray, sizes: np.ndarray) -> pa.Table:
    at = np.r_[0, np.cumsum(sizes)]
    blobs = [zlib.compress(values[a:b].tobytes(), 1) for a, b in zip(at, at[1:])]
    return pa.table([pa.array(chunks, pa.int64()), pa.array([part] * len(chunks), pa.int32()), pa.array([kind] * len(chunks), pa.int32()), pa.array(blobs, pa.binary())], names=["chunk", "part", "kind", "answer"])


def _docs_of(ids: bytes, doc: bytes) -> np.ndarray:
    ids_ = np.frombuffer(ids, np.int64)
    return ids_[_unpack(doc, 4 if len(ids_) > 65535 else 2).astype(np.int64)]


def _compare(table: pa.Table) -> pa.Table:
    """Of all runs of a partition: whether an earlier document has the whole run, or runs share only the anchor."""
    h = np.concatenate([_unpack(x, 5) for x in table["h"].to_pylist()])
    c = np.concatenate([_unpack(x, 6) for x in table["c"].to_pylist()])
    docs = [_docs_of(i, d) for i, d in zip(table["ids"].to_pylist(), table["doc"].to_pylist())]
    sizes = np.array([len(d) for d in docs])
    doc = np.concatenate(docs)
    by = np.lexsort((doc, c, h))
    hs, cs, ds = h[by], c[by], doc[by]
    new_h = np.r_[True, hs[1:] != hs[:-1]]
    new_c = new_h | np.r_[True, cs[1:] != cs[:-1]]
    first = ds[np.flatnonzero(new_c)][np.cumsum(new_c) - 1]
    kinds = np.add.reduceat(new_c.astype(np.int64), np.flatnonzero(new_h))[np.cumsum(new_h) - 1]
    code = np.where(ds > first, WHOLE, np.where(kinds > 1, SHARED, NONE)).astype(np.uint8)
    out = np.empty(len(code), np.uint8)
    out[by] = code
    return _answers(table["chunk"].to_pylist(), table["part"][0].as_py(), 0, out, sizes)


def _codes(chunk: Chunk, answers: pa.Table, parts: int, kind: int, dtype) -> dict[int, np.ndarray]:
    return {p: np.frombuffer(zlib.decompress(a), dtype) for p, k, a in zip(answers["part"].to_pylist(), answers["kind"].to_pylist(), answers["answer"].to_pylist()) if k == kind}


def _codes_of_runs(chunk: Chunk, answers: pa.Table, parts: int) -> np.ndarray:
    """The code of each distinct run."""
    codes = _codes(chunk, answers, parts, 0, np.uint8)
    return np.concatenate([codes[p] for p, _, _ in _edges(chunk.parts_of(parts))]) if len(chunk.first) else np.zeros(0, np.uint8)


def _send_shared(length: int, parts: int):
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        rows: list[list] = [[], [], [], [], [], []]
        if table.num_rows:
            chunk = Chunk(table, length)
            code = _codes_of_runs(chunk, answers, parts)
            where = chunk.parts_of(parts)
            chosen = np.flatnonzero(code == SHARED)
            for part, a, b in _edges(where[chosen]):
                runs = chunk.first[chosen[a:b]]
                used, index = np.unique(chunk.doc[runs], return_inverse=True)
                low, high = chunk.low[runs], chunk.high[runs]
                text = b"".join(chunk.raw[x:y].tobytes() for x, y in zip(low.tolist(), (high + length).tolist()))
                values = (part, table["chunk"][0].as_py(), (high - low).astype(np.uint8).tobytes(), chunk.ids[used].tobytes(), _pack(index, 4 if len(used) > 65535 else 2), text)
                for column, v in zip(rows, values):
                    column.append(v)
        kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 4]
        return pa.table([pa.array(c, k) for c, k in zip(rows, kinds)], names=["part", "chunk", "more", "ids", "doc", "text"])

    return run


SHARED_ROWS = "part int, chunk long, more binary, ids binary, doc binary, text binary"


def _compare_shared(length: int):
    """Groups all windows of the runs that share an anchor: bits of the covered windows of each run."""

    def run(table: pa.Table) -> pa.Table:
        more = [np.frombuffer(x, np.uint8).astype(np.int64) for x in table["more"].to_pylist()]
        sizes = np.array([len(x) for x in more])
        more = np.concatenate(more)
        docs = np.concatenate([_docs_of(i, d) for i, d in zip(table["ids"].to_pylist(), table["doc"].to_pylist())])
        raw = np.frombuffer(b"".join(table["text"].to_pylist()), np.uint8)
        at = np.cumsum(more + length) - (more + length)
        run_of = np.repeat(np.arange(len(more)), more + 1)
        step = np.arange(len(run_of)) - np.repeat(np.cumsum(more + 1) - (more + 1), more + 1)
        group = equal_groups(raw, at[run_of] + step, length)
        by = np.lexsort((docs[run_of], group))
        g, d = group[by], docs[run_of][by]
        new = np.r_[True, g[1:] != g[:-1]]
        covered = np.empty(len(by), bool)
        covered[by] = d > d[np.flatnonzero(new)][np.cumsum(new) - 1]
        bits = np.zeros(len(more), np.uint64)
        np.bitwise_or.at(bits, run_of[covered], U(1) << step[covered].astype(np.uint64))
        return _answers(table["chunk"].to_pylist(), table["part"][0].as_py(), 1, bits, sizes)

    return run


def _finish(length: int, parts: int, texts: bool):
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], [], []]
        if table.num_rows:
            chunk = Chunk(table, length)
            mask = _removed(chunk, answers, parts)
            ids = table["doc_id"].to_pylist()
            for k, (row, a, b) in enumerate(zip(chunk.rows, chunk.starts.tolist(), chunk.ends.tolist())):
                gone = mask[a:b]
                kept = chunk.raw[a:b][~gone].tobytes()
                edges = int(gone[:1].sum()) + int(np.count_nonzero(gone[1:] & ~gone[:-1]))
                for column, v in zip(out, (ids[row], b - a, int(gone.sum()), edges, kept if texts else hashlib.sha256(kept).hexdigest())):
                    column.append(v)
        kinds = [pa.int64()] * 4 + [pa.binary() if texts else pa.string()]
        return pa.table([pa.array(c, k) for c, k in zip(out, kinds)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept" if texts else "kept_sha256"])

    return run


def _removed(chunk: Chunk, answers: pa.Table, parts: int) -> np.ndarray:
    """A flag for each byte of the chunk."""
    code = _codes_of_runs(chunk, answers, parts)
    bits = np.zeros(len(code), np.uint64)
    shared = _codes(chunk, answers, parts, 1, np.uint64)
    chosen = np.flatnonzero(code == SHARED)
    for part, a, b in _edges(chunk.parts_of(parts)[chosen]):
        bits[chosen[a:b]] = shared[part]
    change = np.zeros(len(chunk.raw) + 1, np.int32)
    if len(chunk.low):
        # a copy in a later document than the chunk's first one of its kind is covered by that
        earlier = chunk.ids[chunk.doc] > chunk.ids[chunk.doc[chunk.first]][chunk.distinct]
        whole = earlier | (code[chunk.distinct] == WHOLE)
        change += np.bincount(chunk.low[whole], minlength=len(change)).astype(np.int32)
        change -= np.bincount(chunk.high[whole] + chunk.length, minlength=len(change)).astype(np.int32)
        part = np.flatnonzero(~whole & (bits[chunk.distinct] != 0))
        width = chunk.length - GRAM + 1
        for i in range(width):
            here = chunk.low[part[(bits[chunk.distinct[part]] >> U(i)) & U(1) == 1]] + i
            np.add.at(change, here, 1)
            np.add.at(change, here + chunk.length, -1)
    return np.cumsum(change[:-1]) > 0


def repeats(df: DataFrame, length: int = 50, texts: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256, or with ``texts`` the kept bytes themselves."""
    if not GRAM < length <= GRAM + 63:
        raise ValueError(f"length must be from {GRAM + 1} to {GRAM + 63}")
    docs = narrow(df, "doc_id", "text")
    hint = text_bytes(docs)
    chunks, parts = max(2, hint // CHUNK), max(4, hint // PART)
    dealt = docs.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).alias("chunk"), "doc_id", F.col("text").cast("binary").alias("text"))
    sent = dealt.groupBy("chunk").applyInArrow(_send(length, parts), SENT)
    first = sent.groupBy("part").applyInArrow(_compare, ANSWER)
    shared = dealt.groupBy("chunk").cogroup(first.groupBy("chunk")).applyInArrow(_send_shared(length, parts), SHARED_ROWS)
    second = shared.groupBy("part").applyInArrow(_compare_shared(length), ANSWER)
    kept = "kept binary" if texts else "kept_sha256 string"
    return dealt.groupBy("chunk").cogroup(first.union(second).groupBy("chunk")).applyInArrow(_finish(length, parts, texts), f"doc_id long, n_bytes long, n_removed long, n_spans long, {kept}")
