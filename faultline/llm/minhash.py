"""Near duplicates by a containment ensemble over MinHash.

A text is the set of its ``WORDS``-word shingles. Two different texts are linked if one contains at least ``contain``
of the other's shingles and the smaller set has at least ``ratio`` of the larger one's size. Containment in still longer
texts, as of quotes, isn't a near copy and makes no group; its links are counted by an exact index (``contained``). Identical texts are one class and are compared once.

Sets are partitioned by size. For each partition the containment becomes the least Jaccard similarity that linked sets
can have there, and the banding (rows a band, bands) is tuned to it. A set is put into its own partition's index and
asks the next one's. Bands of the same width are the same in both, so each is sent once, and where keys meet, those of
a partition and of the one before make a star around the partition's least class. Keys are numbered by ranges of their
hash. Sets of more alike sizes have more in common if they are linked, and need fewer of the bands: a bucket of a later
band counts only if it has sizes that need so many. A task ties sets that share a key in a partition to the least of them on the spot and sends that one's key only,
so a hot bucket is never gathered, nor listed by pairs. A pair of classes is one row, with all its buckets.

Pairs are checked by sketches (a byte of each MinHash value), and those that may be linked, exactly: a linked pair has
``SIGMAS`` deviations fewer equal values than its sizes ask for in 0.2 % of cases. In a bucket where a pair isn't linked,
the members that linked pairs don't tie to its centres are compared with all members of the bucket, by sketches, and
those that have company by these, exactly. The classes that then hang together are all compared exactly with each other,
which gives each one's number of links. All this goes block by block (a block has at most ``BLOCK`` sets and about
``BLOCK_BYTES``), and returns a forest of edges, or counts, but no pairs. A group of n texts takes n * n comparisons, as each one's number
of links is asked for, and moves a set once for each of the group's blocks.

A task holds at most ``HELD`` keys before it sends them, in one row for each range that has any: rows have some
HELD / ranges keys.

Defined results: a null text counts as empty; a text without words has no shingles and is linked with nothing (its
copies are still one class); fewer than ``WORDS`` words are one shingle; repeated rows are copies; a null doc_id takes
part, and counts as later than all others; of repeated rows that differ in further columns, ``dedup`` keeps the least;
an empty table gives no rows; further columns are not read otherwise.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import hot, join_spread, lean, lean_group, map_text, mix64, narrow, roots_of, slices, spread, standing_on, text_bytes, unlink, written
from faultline.llm.contained import far_links
from faultline.llm.graph import components

WORDS, VALUES = 3, 168
#: The share of linked pairs at a partition's least similarity that its banding may miss.
MISS = 0.03
BLOCK, BLOCK_BYTES = 2048, 4 << 20
#: Pairs of sketches that are compared at a time.
PAIRS = 10_000
#: Keys that a task holds, and the bytes of text behind a range of keys.
HELD, PART = 1_000_000, 40 << 20
#: Deviations by which the equal values of two sketches may fall short.
SIGMAS = 3.0
#: The least ratio of sizes of linked sets. Below, the banding would need one row a band to keep to MISS.
RATIO = 0.4
#: Partitions up to that of so many shingles have independent MinHash values, larger ones a single permutation.
SMALL = 100
WORD = re.compile(r"\w+")
U = np.uint64
_SEEDS = mix64(np.arange(1, VALUES + 1, dtype=np.uint64) * U(0xA0761D6478BD642F))
#: Characters of texts that are split together, and of the longest word whose hash is a sum over its characters.
LOT, LONG = 1 << 16, 64
_PLACES = mix64(np.arange(1, LONG + 1, dtype=np.uint64) * U(0x9FB21C651E98DF25))


@cache
def _characters(most: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the code points below ``most``: whether ``WORD`` takes them, and a number for those."""
    word = np.fromiter((chr(i).isalnum() or i == 95 for i in range(most)), bool, most)
    return word, np.where(word, mix64(np.arange(1, most + 1, dtype=np.uint64) * U(0xD6E8FEB86659FD93)), U(0))


def _words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the words of lower-case texts, and the number of words before each text and behind the last."""
    joined = "\n".join(texts)
    if joined.isascii():
        code, most = np.frombuffer(joined.encode(), np.uint8), 128
    else:
        code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        most = 1 << 16 if code.max() < 1 << 16 else 0x110000
    word, number = _characters(most)
    inside = np.zeros(len(code) + 2, bool)
    inside[1:-1] = word[code]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edges[::2], edges[1::2]
    before = np.searchsorted(start, np.cumsum([0, *[len(t) + 1 for t in texts]]))
    out = np.empty(len(start), np.uint64)
    at = 0
    while at < len(start):  # one long text in stretches
        to = max(at + 1, int(np.searchsorted(start, start[at] + 2 * LOT)))
        low, high = start[at], end[to - 1]
        first = start[at:to] - low
        place = np.arange(high - low) - np.repeat(first, np.diff(first, append=high - low))
        out[at:to] = np.add.reduceat(number[code[low:high]] * _PLACES.take(place, mode="clip"), first)
        at = to
    for k in np.flatnonzero(end - start > LONG).tolist():
        out[k] = xxhash.xxh3_64_intdigest(joined[start[k] : end[k]].encode("utf-8", "surrogatepass"))
    return mix64(out), before


def _sets(texts: list[str]) -> Iterator[np.ndarray]:
    codes, before = _words(texts)
    joined = codes[: max(0, len(codes) - WORDS + 1)] * U(0x9E3779B97F4A7C15)
    for i in range(1, WORDS):
        joined = mix64(joined) + codes[i : len(joined) + i] * U(0x9E3779B97F4A7C15 + 2 * i)
    joined = mix64(joined)
    for a, b in zip(before[:-1].tolist(), before[1:].tolist()):
        if b - a >= WORDS:
            s = joined[a : b - WORDS + 1]
            s.sort()
            yield s[_new(s)]
        else:
            whole = U(b - a)
            for c in codes[a:b]:
                whole = mix64(np.array([whole ^ c]))[0]
            yield np.array([whole] if b > a else [], np.uint64)


def shingle_sets(texts: Iterable[str | None]) -> Iterator[np.ndarray]:
    """Of each text, the sorted distinct 64-bit hashes of its shingles; words are split and hashed for many texts at once."""
    lot, held = [], 0
    for text in texts:
        lot.append((text or "").lower())
        held += len(lot[-1])
        if held >= LOT:
            yield from _sets(lot)
            lot, held = [], 0
    if lot:
        yield from _sets(lot)


def shingles(text: str | None) -> np.ndarray:
    return next(shingle_sets([text]))


def packed(s: np.ndarray) -> bytes:
    """48 bits of each hash, which tell the shingles of two texts apart as well."""
    return np.ascontiguousarray(s).view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, 2:] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()


def signature(s: np.ndarray) -> np.ndarray:
    """One-permutation MinHash: the least hash in each of VALUES ranges; empty ranges borrow from the next one."""
    bins = ((s >> U(32)) * U(VALUES) >> U(32)).astype(np.int64)
    first = np.r_[True, bins[1:] != bins[:-1]]
    filled, least = bins[first], s[first]
    if len(filled) == VALUES:
        return mix64(least)
    at = np.arange(VALUES)
    source = np.searchsorted(filled, at)
    distance = np.where(source < len(filled), filled[source % len(filled)] - at, filled[0] + VALUES - at)
    return mix64(least[source % len(filled)] + distance.astype(np.uint64) * U(0xD1B54A32D192ED03))


def small_signature(s: np.ndarray) -> np.ndarray:
    """VALUES independent MinHash values, for sets that would leave most ranges empty."""
    return mix64(s[:, None] + _SEEDS[None, :]).min(axis=0)


def partition_of(n: int, ratio: float) -> int:
    return int(math.log(n) / -math.log(ratio) + 1e-9)


@cache
def banding(partition: int, contain: float, ratio: float) -> tuple[int, int]:
    """(rows a band, bands) of a partition's index."""
    low, high = math.ceil(ratio**-partition - 1e-9), math.ceil(ratio ** -(partition + 1) - 1e-9) - 1
    least = math.ceil(ratio ** -(partition - 1) - 1e-9) if partition else 1
    worst = 1.0
    for q in np.unique(np.linspace(max(1, least), max(1, high, low), 64).astype(int)).tolist():
        y = min(max(high, low), int(q / ratio + 1e-9))
        if y >= q and y >= low:
            both = math.ceil(contain * q - 1e-9)
            worst = min(worst, both / (q + y - both))
    rows = 1
    for r in range(1, 13):
        if (1 - worst**r) ** (VALUES // r) <= MISS:
            rows = r
    return rows, VALUES // rows


@cache
def _asked(partition: int, contain: float, ratio: float) -> list[tuple[bool, int, int]]:
    """(whether values are independent, rows, bands) that a set of the partition sends: what its own and the next
    partition's index take, bands of the same width once."""
    most: dict[tuple[bool, int], int] = {}
    for p in (partition, partition + 1):
        rows, bands = banding(p, contain, ratio)
        kind = (p <= partition_of(SMALL, ratio), rows)
        most[kind] = max(most.get(kind, 0), bands)
    return [(*kind, bands) for kind, bands in most.items()]


def band_keys(s: np.ndarray, contain: float, ratio: float) -> np.ndarray:
    """The keys of a set in its own and the next partition's index."""
    out = []
    for small, rows, bands in _asked(partition_of(len(s), ratio), contain, ratio):
        sig = small_signature(s) if small else signature(s)
        key = np.full(bands, rows * 1000 + 7 + small, np.uint64) * U(0x2545F4914F6CDD1D) + np.arange(bands, dtype=np.uint64)
        for i in range(rows):
            key = mix64(key + sig[i : rows * bands : rows])
        out.append(key & ~U(127) | np.minimum(np.arange(bands), 127).astype(np.uint64))
    return np.concatenate(out)


#: Codes of sizes in a partition.
STEPS = 10


def size_code(n: int, ratio: float) -> int:
    """Sizes in STEPS steps a partition."""
    return int(STEPS * (math.log(n) / -math.log(ratio)) + 1e-9 * STEPS)


@cache
def least_steps(contain: float, ratio: float) -> np.ndarray:
    """For each band: of how many steps the codes of the least and the largest set of a bucket have to be apart, so that a
    linked pair may need the band, if bands have two rows."""
    out = []
    for band in range(128):
        steps = 0
        while steps <= STEPS:
            r = ratio ** ((steps + 1) / STEPS)  # the least ratio of sizes so many steps apart
            similar = contain * r / (1 + r - contain * r)
            if math.log(MISS) / math.log(1 - similar**2) > band:
                break
            steps += 1
        out.append(steps)
    return np.array(out)


NAME = np.dtype([("a", ">u8"), ("b", ">u8")])
SENT = "part int, keys binary, sizes binary, largest binary, members binary, names binary, buckets binary, centres binary"
STARS = "centre binary, member binary, buckets array<long>"


def _column(raw: np.ndarray, size: int = 16) -> pa.Array:
    raw = np.ascontiguousarray(raw)
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(size), len(raw), [None, pa.py_buffer(raw.tobytes())]).cast(pa.binary())


def _new(*columns: np.ndarray) -> np.ndarray:
    """Whether a row differs from the one before."""
    out = np.ones(len(columns[0]), bool)
    if len(out):
        out[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return out


def _least(first: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The value at the start of each row's group."""
    return x[np.flatnonzero(first)][np.cumsum(first) - 1] if len(x) else x


def _low(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _flush(names: list[bytes], keys: list[np.ndarray], sizes: list[int], owners: list[int], parts: int) -> Iterator[pa.RecordBatch]:
    raw = np.frombuffer(b"".join(names), dtype=NAME)
    order = np.argsort(raw, kind="stable")
    rank = np.empty(len(raw), np.uint32)
    rank[order] = np.arange(len(raw), dtype=np.uint32)
    raw = raw[order]
    many = np.array([len(k) for k in keys])
    key, size, member = np.concatenate(keys), np.repeat(np.array(sizes, np.uint8), many), np.repeat(rank[owners], many)
    by = np.lexsort((member, size // STEPS, key))
    key, size, member = key[by], size[by], member[by]
    part = ((key >> U(32)) * U(parts) >> U(32)).astype(np.int64)
    first = _new(key, size // STEPS)
    centre = _least(first, member)
    rows: list[list] = [[] for _ in range(8)]

    def add(*values) -> None:
        for column, v in zip(rows, values):
            column.append(v)

    top = np.flatnonzero(first)
    lowest, highest = np.minimum.reduceat(size, top), np.maximum.reduceat(size, top)
    edges = np.searchsorted(part[top], np.arange(parts + 1))
    for p in np.flatnonzero(np.diff(edges)).tolist():
        here = top[edges[p] : edges[p + 1]]
        used, number = np.unique(member[here], return_inverse=True)
        of = slice(edges[p], edges[p + 1])
        add(p, _low(key[here]), lowest[of].tobytes(), highest[of].tobytes(), number.astype(np.uint32).tobytes(), raw[used].tobytes(), None, None)
    tied = np.flatnonzero(~first)
    bucket = part << 40 | (key & U((1 << 40) - 1)).astype(np.int64)
    seed = int.from_bytes(names[0][:4], "big")
    for k, at in enumerate(range(0, len(tied), 200_000)):  # wherever: nothing has to meet
        here = tied[at : at + 200_000]
        used, number = np.unique(np.concatenate([member[here], centre[here]]), return_inverse=True)
        number = number.astype(np.uint32)
        add((seed + k * 7919) % parts, None, None, None, number[: len(here)].tobytes(), raw[used].tobytes(), bucket[here].tobytes(), number[len(here) :].tobytes())
    yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), *[pa.array(c, pa.binary()) for c in rows[1:]]], SENT.replace(",", "").split()[::2])


def _send(contain: float, ratio: float, parts: int):
    """The keys of a task's classes, and the stars among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers: dict[bytes, int] = {}
        keys, sizes, owners, held = [], [], [], 0
        for b in slices(batches):
            new = {name: text for name, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if name not in numbers}
            for name, s in zip(new, shingle_sets(new.values())):
                numbers[name] = len(numbers)
                if len(s):
                    keys.append(band_keys(s, contain, ratio))
                    sizes.append(size_code(len(s), ratio))
                    owners.append(numbers[name])
                    held += len(keys[-1])
            if held >= HELD:
                yield from _flush(list(numbers), keys, sizes, owners, parts)
                numbers, keys, sizes, owners, held = {}, [], [], [], 0
        if keys:
            yield from _flush(list(numbers), keys, sizes, owners, parts)

    return run


def _unpack5(blobs: list[bytes]) -> np.ndarray:
    raw = np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, 5)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :5] = raw
    return out.view(np.uint64).ravel()


def _by_pairs(bucket: np.ndarray, centre: np.ndarray, member: np.ndarray, names: np.ndarray) -> pa.Table:
    by = np.lexsort((bucket, member, centre))
    bucket, centre, member = bucket[by], centre[by], member[by]
    again = _new(bucket, centre, member)
    bucket, centre, member = bucket[again], centre[again], member[again]
    at = np.flatnonzero(_new(centre, member))
    lists = pa.ListArray.from_arrays(pa.array(np.r_[at, len(bucket)].astype(np.int32)), pa.array(bucket))
    return pa.table([_column(names[centre[at]]), _column(names[member[at]]), lists], names=["centre", "member", "buckets"])


def _collect(table: pa.Table, steps: np.ndarray) -> pa.Table:
    """The stars of a range of keys, and those that tasks made; numbers of classes follow their order."""
    found = np.frombuffer(b"".join(table["names"].to_pylist()), dtype=NAME)
    base = np.cumsum([0, *[len(x) // 16 for x in table["names"].to_pylist()]])
    names, number = np.unique(found, return_inverse=True)

    def of(column: str, wanted: str) -> np.ndarray:
        blobs = [(x, o) for x, y, o in zip(table[column].to_pylist(), table[wanted].to_pylist(), base.tolist()) if y is not None]
        return number[np.concatenate([np.frombuffer(x, np.uint32).astype(np.int64) + o for x, o in blobs])] if blobs else np.zeros(0, np.int64)

    key = _unpack5([x for x in table["keys"].to_pylist() if x is not None])
    low, high = (np.frombuffer(b"".join(x for x in table[c].to_pylist() if x is not None), np.uint8).astype(np.int64) for c in ("sizes", "largest"))
    member = of("members", "keys")
    by = np.lexsort((member, low // STEPS, key))
    key, low, high, member = key[by], low[by], high[by], member[by]
    if len(key):
        start = np.flatnonzero(_new(key))
        least = np.minimum.reduceat(low, start)
        needed = (least < 2 * STEPS) | (np.maximum.reduceat(high, start) - least >= steps[(key[start] & U(127)).astype(np.int64)])
        keep = np.repeat(needed, np.diff(np.r_[start, len(key)]))
        key, low, member = key[keep], low[keep], member[keep]
    size = low // STEPS
    first = _new(key, size)
    own, top = _least(first, member), np.flatnonzero(first)
    # the next group, if it is the same key's next partition
    follows = np.r_[(key[top[1:]] == key[top[:-1]]) & (size[top[1:]] == size[top[:-1]] + 1), False] if len(top) else first
    group = np.cumsum(first) - 1
    asks = np.flatnonzero(follows[group]) if len(top) else np.zeros(0, np.int64)
    next_top = member[top[np.minimum(group[asks] + 1, len(top) - 1)]] if len(top) else asks
    bucket = (key | U(table["part"][0].as_py() << 40)).astype(np.int64)
    tied = np.flatnonzero(~first)
    kept = [x for x in table["buckets"].to_pylist() if x is not None]
    buckets = np.concatenate([bucket[tied], bucket[asks], np.frombuffer(b"".join(kept), np.int64)])
    centres = np.concatenate([own[tied], next_top, of("centres", "buckets")])
    members = np.concatenate([member[tied], member[asks], of("members", "buckets")])
    different = centres != members
    return _by_pairs(buckets[different], centres[different], members[different], names)


def sketches(s: np.ndarray, ratio: float) -> tuple[bytes | None, bytes | None]:
    """A byte of each MinHash value, of the independent ones and of the others; null where no linked set has the kind."""
    own, small = partition_of(len(s), ratio), partition_of(SMALL, ratio)
    cut = lambda sig: (sig & U(255)).astype(np.uint8).tobytes()
    return cut(small_signature(s)) if own <= small else None, cut(signature(s)) if own >= small else None


def _kinds(n: np.ndarray, small: list, large: list, ratio: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sketches as matrices, and whether a set's partition still has independent values."""
    none = bytes(VALUES)
    both = [np.frombuffer(b"".join(none if x is None else x for x in c), np.uint8).reshape(-1, VALUES) for c in (small, large)]
    return both[0], both[1], n < math.ceil(ratio ** -(partition_of(SMALL, ratio) + 1) - 1e-9)


def _equal(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The equal values of each row of two matrices of sketches, summed as bytes: there are fewer than 256."""
    return np.add.reduce((a == b).view(np.uint8), axis=1, dtype=np.uint8)


def least_equal(contain: float, ratio: float, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The equal values that sketches of linked sets of so many shingles have at least; more than there are if sets of
    these sizes aren't linked."""
    both = np.ceil(contain * low - 1e-9)
    similar = both / np.maximum(1, low + high - both)
    similar = similar + (1 - similar) / 256
    least = VALUES * similar - SIGMAS * np.sqrt(VALUES * similar * (1 - similar))
    return np.where(low >= ratio * high - 1e-9, least, VALUES + 1)


def _similar(contain: float, ratio: float):
    """(centre, member, near) from (centre, member, n, small, large of the centre and of the member)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [b.column(i).to_numpy() for i in (2, 5)]
            (s0, l0, k0), (s1, l1, k1) = (_kinds(n[i], b.column(3 + 3 * i).to_pylist(), b.column(4 + 3 * i).to_pylist(), ratio) for i in (0, 1))
            equal = np.where(k0 & k1, _equal(s0, s1), _equal(l0, l1))
            near = equal >= least_equal(contain, ratio, np.minimum(*n), np.maximum(*n))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(near)], ["centre", "member", "near"])

    return run


def _contained(contain: float, ratio: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = b.column(2).to_pylist(), b.column(3).to_pylist()
            ok = np.zeros(b.num_rows, bool)
            for i, (p, q) in enumerate(zip(x, y)):
                n, m = len(p) // 6, len(q) // 6
                if min(n, m) >= ratio * max(n, m) - 1e-9:
                    both = unpacked(p + q)
                    both.sort(kind="stable")
                    ok[i] = np.count_nonzero(both[1:] == both[:-1]) >= contain * min(n, m) - 1e-9
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ok)], ["centre", "member", "linked"])

    return run


def _linked(sets: list[np.ndarray], cut: int, contain: float, ratio: float) -> np.ndarray:
    """The matrix of the linked pairs of the sets before ``cut`` and those behind it, or of all if it is 0."""
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[column] > 1
    column, owner = column[shared], owner[shared]
    by = np.argsort(column, kind="stable")
    column, owner = column[by], owner[by]
    start = np.flatnonzero(_new(column))
    split = cut or len(sets)
    both = np.zeros((split, len(sets) - cut), np.float32)
    if len(start):
        # shingles of the same sets are one column with a weight
        pattern = np.bitwise_xor.reduceat(mix64(owner.astype(np.uint64) + U(1)), start)
        _, first, weight = np.unique(pattern, return_index=True, return_counts=True)
        length = np.diff(np.r_[start, len(owner)])[first]
        at = np.repeat(start[first] - np.r_[0, np.cumsum(length)[:-1]], length) + np.arange(length.sum())
        owner, column = owner[at], np.repeat(np.arange(len(first)), length)
        for a in range(0, len(first), 4096):
            x, z = np.searchsorted(column, [a, a + 4096])
            here = np.zeros((len(sets), min(4096, len(first) - a)), np.float32)
            here[owner[x:z], column[x:z] - a] = 1
            both += (here[:split] * weight[a : a + 4096].astype(np.float32)) @ here[cut:].T
    low, high = np.minimum(sizes[:split, None], sizes[None, cut:]), np.maximum(sizes[:split, None], sizes[None, cut:])
    linked = (both >= contain * low - 1e-6) & (low >= ratio * high - 1e-9)
    if not cut:
        np.fill_diagonal(linked, False)
    return linked


def _grouped(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[tuple[tuple, int, list[list]]]:
    """From rows (key, i, j, block, ...) that are sorted by the first four, and are of blocks i and j: (key, i, j), how many
    of its rows are of block i if that isn't j, else 0, and the further columns; not where a block has no rows."""
    now, blocks, held = None, [], [[] for _ in range(columns)]

    def whole() -> list[tuple]:
        if now is None or len(blocks) < 2:
            return []
        cut = 0 if now[1] == now[2] else blocks.count(now[1])
        return [] if now[1] != now[2] and cut in (0, len(blocks)) else [(now, cut, held)]

    for b in batches:
        for key, i, j, block, *row in zip(*[b.column(k).to_pylist() for k in range(4 + columns)]):
            if (key, i, j) != now:
                yield from whole()
                now, blocks, held = (key, i, j), [], [[] for _ in range(columns)]
            blocks.append(block)
            for column, v in zip(held, row):
                column.append(v)
    yield from whole()


def _batched(rows: Iterator[tuple[list, ...]], names: list[str], kinds: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    out: list[list] = [[] for _ in names]
    for row in rows:
        for column, v in zip(out, row):
            column.extend(v)
        if len(out[0]) > 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)], names)
            out = [[] for _ in names]
    if out[0]:
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)], names)


def _blockwise(contain: float, ratio: float, edges: bool):
    """Numbers of links (class, links), or edges (a, b) that hold together what is linked, of rows with class and set. Of
    two blocks, pairs are of one of each."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
        for _, cut, (classes, raw) in _grouped(batches, 2):
            linked = _linked([unpacked(s) for s in raw], cut, contain, ratio)
            if edges:
                roots = roots_of(linked, cut)
                rest = np.flatnonzero(roots != np.arange(len(roots)))
                yield [classes[i] for i in rest], [classes[i] for i in roots[rest]]
            else:
                yield classes[cut:], linked.sum(axis=0).tolist()
                yield classes[:cut], linked.sum(axis=1).tolist()[:cut]

    names, kinds = (["a", "b"], [pa.binary(), pa.binary()]) if edges else (["class", "links"], [pa.binary(), pa.int64()])
    return lambda batches: _batched(found(batches), names, kinds)


@cache
def _places(rows: int, columns: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of a group of ``rows`` members, or of two blocks."""
    if not columns:
        return np.triu_indices(rows, 1)
    i, j = np.divmod(np.arange(rows * columns), columns)
    return i, j + rows


def _company(contain: float, ratio: float):
    """(key, class) of the rows with class, failed, n, small, large that by their sketches may be linked with another one,
    if one of the two failed. Pairs are looked at PAIRS at a time, of however many groups, but for those of which both are
    known to have one."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
        keys, held, pairs, many = [], [[] for _ in range(5)], [], 0

        def close() -> tuple[list, list]:
            classes, failed, n, small, large = held
            s, l, k = _kinds(np.array(n, np.int64), small, large, ratio)
            n, near = np.array(n, np.int64), np.zeros(len(n), bool)
            i, j = (np.concatenate(x) for x in zip(*pairs))
            one = np.array(failed)
            some = np.flatnonzero((one[i] | one[j]) & (np.minimum(n[i], n[j]) >= ratio * np.maximum(n[i], n[j]) - 1e-9))
            for at in range(0, len(some), PAIRS):
                x, y = i[some[at : at + PAIRS]], j[some[at : at + PAIRS]]
                open_ = ~(near[x] & near[y])  # two that have company tell nothing new
                x, y = x[open_], y[open_]
                equal, both = np.empty(len(x), np.int64), k[x] & k[y]
                for kind, of in ((s, both), (l, ~both)):
                    equal[of] = _equal(kind[x[of]], kind[y[of]])
                ok = equal >= least_equal(contain, ratio, np.minimum(n[x], n[y]), np.maximum(n[x], n[y]))
                near[x[ok]] = near[y[ok]] = True
            at = np.flatnonzero(near).tolist()
            return [keys[i] for i in at], [classes[i] for i in at]

        for now, cut, columns in _grouped(batches, 5):
            base, size = len(keys), len(columns[0])
            keys += [now[0]] * size
            for column, v in zip(held, columns):
                column.extend(v)
            where = _places.__wrapped__ if size > 256 else _places
            i, j = where(cut or size, size - cut if cut else 0)
            pairs.append((i + base, j + base))
            many += len(i)
            if many >= 400_000:
                yield close()
                keys, held, pairs, many = [], [[] for _ in range(5)], [], 0
        if keys:
            yield close()

    return lambda batches: _batched(found(batches), ["key", "class"], [pa.int64(), pa.binary()])


def _unsettled(pairs: DataFrame, checked: DataFrame) -> DataFrame:
    """(key, class, failed) of all members of the buckets where a pair isn't linked: those failed that linked pairs don't
    tie to the centre of their centre. Of buckets with the same members, one is enough."""
    apart = checked.filter("NOT linked").select("centre", "member")
    open_ = written(pairs.join(apart, ["centre", "member"], "left_semi").select(F.explode("buckets").alias("bucket")).distinct(), "open")
    every = pairs.join(checked, ["centre", "member"]).select("centre", "member", "linked", F.explode("buckets").alias("bucket"))
    rows = written(every.join(open_, "bucket", "left_semi"), "rows")
    unlink(open_)
    bad = rows.filter("NOT linked").select("bucket", F.col("member").alias("centre")).distinct()
    under = rows.join(bad, ["bucket", "centre"], "left_semi").select("bucket", F.col("member").alias("class"), F.lit(True).alias("failed"))
    members = rows.select("bucket", F.col("member").alias("class"), (~F.col("linked")).alias("failed")).union(under).union(rows.select("bucket", "centre", F.lit(False)))
    found = written(members.groupBy(F.col("bucket").alias("key"), "class").agg(F.max("failed").alias("failed")), "members")
    unlink(rows)
    hashes = [F.bit_xor(F.xxhash64(F.lit(i), "class", "failed")).alias(f"hash{i}") for i in (1, 2)]
    alike = found.groupBy("key").agg(F.count("*").alias("members"), *hashes).filter("members > 2")
    out = written(found.join(alike.groupBy("members", "hash1", "hash2").agg(F.min("key").alias("key")).select("key"), "key", "left_semi"), "failed")
    unlink(found)
    return out


def _dealt(members: DataFrame, payload: DataFrame, failed: bool = False) -> DataFrame:
    """(key, i, j, block, class, ``failed`` if wanted, and the further columns of ``payload``), in groups and sorted: each pair with the same key
    of ``members`` (key, class, failed) of which one failed is in a group (key, i, j). A key with many members is split to
    pairs of blocks; those that failed have the first ones. ``payload`` has a class's ``bytes``."""
    sized = members.join(payload.select("class", "bytes"), "class")
    facts = sized.groupBy("key").agg(F.count("*").alias("members"), F.count_if("failed").alias("fails"), F.sum("bytes").alias("bytes"), F.coalesce(F.sum(F.expr("CASE WHEN failed THEN bytes END")), F.lit(0)).alias("fail_bytes"))
    facts = facts.filter("members > 1 AND fails > 0")
    one = (F.col("members") <= BLOCK) & (F.col("bytes") <= BLOCK_BYTES)
    blocks = lambda n, size: F.greatest(F.ceil(n / BLOCK), F.ceil(size / BLOCK_BYTES)).cast("int")
    first, rest = blocks(F.col("fails"), F.col("fail_bytes")), blocks(F.col("members") - F.col("fails"), F.col("bytes") - F.col("fail_bytes"))
    facts = facts.select("key", F.when(one, 1).otherwise(first).alias("first"), F.when(one, 0).otherwise(rest).alias("rest"), one.alias("one"))
    placed = join_spread(members, facts, "key", hot(members.groupBy("key").agg(F.count("*").alias("rows")), "key"), "class")
    low = F.col("failed") | F.col("one")
    block = F.when(low, F.pmod(F.xxhash64("class"), F.col("first"))).otherwise(F.col("first") + F.pmod(F.xxhash64("class"), F.greatest("rest", F.lit(1))))
    last = F.when(low, F.col("first") + F.col("rest") - 1).otherwise(F.col("first") - 1)
    dealt = placed.select("key", "class", "failed", block.cast("int").alias("block"), F.explode(F.sequence(F.lit(0), last)).alias("other")).join(payload.drop("bytes"), "class")
    both = dealt.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "class", *["failed"] * failed, *[c for c in payload.columns if c not in ("class", "bytes")])
    return both.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "block", "class")


def _compare_blocks(members: DataFrame, sets: DataFrame, contain: float, ratio: float, edges: bool) -> DataFrame:
    """Exactly: the numbers of links of ``members``, or edges."""
    ordered = _dealt(members, sets.select("class", "set", F.octet_length("set").alias("bytes")))
    return ordered.mapInArrow(lean(_blockwise(contain, ratio, edges)), "a binary, b binary" if edges else "class binary, links long")


def _accompanied(members: DataFrame, sets: DataFrame, contain: float, ratio: float) -> DataFrame:
    """The rows of ``members`` that may be linked with another one, by sketches."""
    ordered = _dealt(members, sets.select("class", "n", "small", "large", F.lit(2 * VALUES).alias("bytes")), failed=True)
    found = ordered.mapInArrow(lean(_company(contain, ratio)), "key long, class binary").distinct()
    return members.join(found, ["key", "class"], "left_semi")


def groups(df: DataFrame, contain: float = 0.6, ratio: float = RATIO, with_class: bool = False, far: bool = True) -> DataFrame:
    """doc_id, class_id, group_id, n_copies, n_links, kept, n_contained of every document. class_id is the least doc_id with
    the same text, group_id the least one of the texts that hang together, n_copies the other documents with the same text,
    n_links the other texts that are linked directly, kept whether it is its group's first document, n_contained the other
    texts linked with it whose sizes are beyond ``ratio``; it isn't there without ``far``."""
    docs = narrow(df, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("class", F.unhex(F.md5(F.col("text").cast("binary"))))
    parts = max(4, text_bytes(df) // PART)
    classes = docs.groupBy("class").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("n"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id")).alias("first"))
    sent = spread(docs.select("class", "text")).mapInArrow(lean(_send(contain, ratio, parts)), SENT)
    steps = least_steps(contain, ratio)
    stars = sent.groupBy("part").applyInArrow(lean_group(lambda table: _collect(table, steps)), STARS)
    pairs = written(stars.groupBy("centre", "member").agg(F.flatten(F.collect_list("buckets")).alias("buckets")), "pairs", clean=True)
    # the sets of the classes in any pair; one document of each, with all its copies spread by doc_id
    wanted = pairs.select(F.col("member").alias("class")).union(pairs.select(F.col("centre").alias("class"))).distinct()
    first = classes.join(wanted, "class", "left_semi").select("class", F.col("first.doc_id").alias("doc_id"))
    known_id = lambda c: F.coalesce(c, F.lit(-(1 << 63))).alias("id")
    first = first.select("class", known_id("doc_id"))
    texts = docs.select("class", known_id("doc_id"), "text").join(first.hint("shuffle_hash"), ["class", "id"], "left_semi").dropDuplicates(["class", "id"])

    def to_set(b: pa.RecordBatch) -> pa.RecordBatch:
        found = list(shingle_sets(b.column(1).to_pylist()))
        small, large = zip(*[sketches(s, ratio) for s in found])
        columns = [b.column(0), pa.array([packed(s) for s in found], pa.binary()), pa.array([len(s) for s in found], pa.int64()), pa.array(small, pa.binary()), pa.array(large, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["class", "set", "n", "small", "large"])

    sets = written(map_text(texts.select("class", "text"), to_set, "class binary, set binary, n long, small binary, large binary"), "sets", clean=True)

    def with_both(of: DataFrame, *columns: str) -> DataFrame:
        """Pairs with these columns of the centre's and of the member's set."""
        ends = [sets.select(F.col("class").alias(end), *[F.col(c).alias(f"{end}_{c}") for c in columns]) for end in ("centre", "member")]
        degrees = of.groupBy("centre").agg(F.count("*").alias("rows"))
        both = join_spread(of.join(ends[1], "member"), ends[0], "centre", hot(degrees, "centre"), "member")
        return both.select("centre", "member", *[f"{end}_{c}" for end in ("centre", "member") for c in columns])

    compared = written(with_both(pairs.select("centre", "member"), "n", "small", "large").mapInArrow(lean(_similar(contain, ratio)), "centre binary, member binary, near boolean"), "compared")
    exact = with_both(compared.filter("near").select("centre", "member"), "set").mapInArrow(lean(_contained(contain, ratio)), "centre binary, member binary, linked boolean")
    checked = written(exact.union(compared.filter("NOT near").select("centre", "member", F.lit(False))), "checked", clean=True)
    failed = _unsettled(pairs, checked)
    unlink(pairs, compared)
    near = written(_accompanied(failed, sets, contain, ratio), "near", clean=True)
    unlink(failed)
    found = written(_compare_blocks(near, sets, contain, ratio, True), "found")
    unlink(near)
    edges = written(checked.filter("linked").select(F.col("centre").alias("a"), F.col("member").alias("b")).union(found), "ties")
    unlink(checked, found)
    roots = components(edges)
    unlink(edges)
    held = roots.select(F.col("root").alias("key"), F.col("node").alias("class"), F.lit(True).alias("failed"))
    links = _compare_blocks(held, sets, contain, ratio, False).groupBy("class").agg(F.sum("links").alias("n_links"))
    known = classes.join(roots.select(F.col("node").alias("class"), "root"), "class", "left").join(links, "class", "left").withColumn("root", F.coalesce("root", "class"))
    beyond = [far_links(docs.select("class", "text"), shingle_sets, parts, contain, ratio)] if far else []
    for counts in beyond:
        known = known.join(counts.withColumnRenamed("id", "start"), F.substring("class", 1, 8) == F.col("start"), "left").drop("start")
    known = written(known, "known", clean=True)
    unlink(roots, sets, *beyond)
    least = known.groupBy("root").agg(F.min("class_id").alias("group_id"), F.min("first").alias("group_first"), F.count("*").alias("rows"))
    grouped = join_spread(known, least.drop("rows"), "root", hot(least, "root"), "class")
    columns = ("class", "class_id", "group_id", (F.col("n") - 1).alias("n_copies"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), (F.col("first") == F.col("group_first")).alias("leads"), *[F.coalesce("n_contained", F.lit(0)).cast("long").alias("n_contained")] * far)
    facts = written(grouped.select(*columns), "facts")
    unlink(known)
    rows = docs.groupBy("class", "doc_id").agg(F.count("*").alias("times"))
    joined = join_spread(rows, facts, "class", hot(facts.select("class", (F.col("n_copies") + 1).alias("rows")), "class"), "doc_id").withColumn("again", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    kept = F.col("leads") & F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("again") == 1)
    return standing_on(joined.select(*["class"] * with_class, "doc_id", "class_id", "group_id", "n_copies", "n_links", kept.alias("kept"), *["n_contained"] * far), facts)


def dedup(df: DataFrame, contain: float = 0.6, ratio: float = RATIO) -> DataFrame:
    """All columns of ``df``, of one document of each group."""
    names = df.columns
    text_class = F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    found = groups(df, contain, ratio, with_class=True, far=False)
    kept = found.filter("kept").select(F.col("class"), F.col("doc_id").alias("id"))
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), text_class.alias("class"), F.col("doc_id").alias("id"))
    stay = rows.join(kept.hint("shuffle_hash"), (rows["class"] == kept["class"]) & rows["id"].eqNullSafe(kept["id"]), "left_semi")
    one = stay.dropDuplicates(["class", "id"]) if "map<" in df.schema.simpleString() else stay.groupBy("class", "id").agg(F.min("row").alias("row"))
    return standing_on(one.select("row.*"), found)
