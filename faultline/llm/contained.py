"""Links between texts of very different sizes, by an exact index of shingles.

A text asks for the texts that hold at least ``contain`` of its shingles and are larger than the size ratio allows, far
ones for short. It has at least ``need`` shingles in common with each, so it can leave out need - 1 of those that any far
text has, and still meets each one by another. It leaves out the commonest, so a passage that many texts share makes pairs
only for texts that are mostly such passages. Shingles that no far text has are never asked for, and a text with fewer
than ``need`` others has no such link.

Shingles go to ranges of their hash, each text's once (``_spelt``); there, the far texts behind each are counted (``_find``).
By text, the shingles to ask by are chosen (``_choose``). By range again, they meet their texts (``_meet``), and by the
larger text, pairs are verified on all shingles that were asked for (``_count``). Nothing is sampled and no list is cut
short. A shingle is told apart by 40 bits and its range, a class by 8 bytes of its digest. The texts that share a shingle meet in one
task, 8 bytes each, and each pair is verified, so the work grows with the number of links.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import lean, lean_group, mix64, slices, spread, unlink, written

U = np.uint64
ROWS = "part int, kind int, ids binary, sizes binary, counts binary, keys binary, facts binary"
NAMES = ROWS.replace(",", "").split()[::2]
SPELT, ASKED, HELD, CHOSEN, ASKER, PAIRS, SLIM = range(7)
#: Shingles that a task holds before it sends them, postings in a row, and pairs that are looked at together.
SENT, RUN, MANY = 1_000_000, 500_000, 1_000_000
#: Ranges of texts for a range of shingles.
HOMES = 4


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * len(NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i < 2 else pa.binary()) for i, c in enumerate(columns)], NAMES)


def _table(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_batches([_batch(rows)])


def _of(table: pa.Table, kind: int) -> dict[str, list]:
    return table.filter(pc.equal(table["kind"], kind)).to_pydict()


def _read(blobs: list[bytes], dtype) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), dtype)


def _low5(key: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(key).view(np.uint8).reshape(-1, 8)[:, :5]


def _unpack5(blobs: list[bytes]) -> np.ndarray:
    raw = _read(blobs, np.uint8).reshape(-1, 5)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :5] = raw
    return out.view(np.uint64).ravel()


def _new(*columns: np.ndarray) -> np.ndarray:
    """Whether a row differs from the one before."""
    out = np.ones(len(columns[0]), bool)
    if len(out):
        out[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return out


def _runs(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs start, and their lengths."""
    start = np.flatnonzero(first)
    return start, np.diff(np.r_[start, len(first)])


def _places(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The indexes in all runs, one run after the other."""
    return np.repeat(start - np.r_[0, np.cumsum(length)[:-1]], length) + np.arange(length.sum()) if len(start) else np.zeros(0, np.int64)


def _lots(weights: np.ndarray, most: int) -> list[np.ndarray]:
    """The indexes in lots of about so much weight."""
    at = np.arange(len(weights))
    return np.split(at, np.flatnonzero(_new(np.cumsum(weights) // most))[1:]) if len(at) else []


def _range(hashes: np.ndarray, ranges: int) -> np.ndarray:
    return ((hashes >> U(32)) * U(ranges) >> U(32)).astype(np.int64)


def _by_range(where: np.ndarray, owner: np.ndarray) -> Iterator[tuple[int, slice, np.ndarray, np.ndarray]]:
    """Of rows sorted by range and owner: (range, its rows, the first row of each owner, the owners' rows)."""
    start, length = _runs(_new(where, owner))
    at, many = _runs(_new(where[start])) if len(start) else (start, length)
    for a, n in zip(at.tolist(), many.tolist()):
        yield int(where[start[a]]), slice(start[a], start[a + n - 1] + length[a + n - 1]), start[a : a + n], length[a : a + n].astype(np.uint32)


def _spelt(shingles: Callable[[str], np.ndarray] | None, parts: int, sets_of: Callable[[Iterable[str]], Iterable[np.ndarray]] | None = None):
    """The shingles of a task's classes, by ranges; ``sets_of`` has those of many texts at once."""
    every = sets_of or partial(map, shingles)

    def flush(names: list[bytes], sets: list[np.ndarray]) -> pa.RecordBatch:
        ids, sizes, key = _read([x[:8] for x in names], U), np.array([len(s) for s in sets], np.uint32), np.concatenate(sets)
        part, owner = _range(key, parts), np.repeat(np.arange(len(sets), dtype=np.int32), sizes)
        by = np.argsort(part.astype(np.uint16) if parts < 1 << 16 else part, kind="stable")
        part, owner, low = part[by], owner[by], _low5(key[by])
        return _batch([(p, SPELT, ids[owner[top]].tobytes(), sizes[owner[top]].tobytes(), n.tobytes(), low[rows].tobytes(), None) for p, rows, top, n in _by_range(part, owner)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        names, sets, held = [], [], 0
        for b in slices(batches):
            new = {name: text for name, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if name not in seen}
            seen.update(new)
            for name, s in zip(new, every(new.values())):
                if len(s):
                    names.append(name)
                    sets.append(s)
                    held += len(s)
            if held >= SENT:
                yield flush(names, sets)
                seen, names, sets, held = set(), [], [], 0
        if sets:
            yield flush(names, sets)

    return run


def _find(ratio: float, homes: int):
    """Of a range: the shingles of each text that far ones have too, with their number, and the far texts of each shingle."""

    def run(table: pa.Table) -> pa.Table:
        part, rows = table["part"][0].as_py(), _of(table, SPELT)
        ids, sizes, counts = _read(rows["ids"], U), _read(rows["sizes"], np.uint32), _read(rows["counts"], np.uint32)
        by = np.lexsort((ids, sizes))
        first = _new(ids[by], sizes[by])
        number = np.empty(len(ids), U)
        number[by] = (np.cumsum(first) - 1).astype(U)
        ids, sizes = ids[by][first], sizes[by][first].astype(np.int64)
        bits = U(len(ids).bit_length())
        post = _unpack5(rows["keys"])
        rows = None
        post <<= bits
        post |= np.repeat(number, counts)  # sorted by size behind each shingle
        post.sort()
        post = post[_new(post)]
        alone = _new(post >> bits)
        post = post[~(alone & np.r_[alone[1:], True])]  # most shingles are of one text
        text = lambda x: (x & ((U(1) << bits) - U(1))).astype(np.int64)
        limit = np.searchsorted(sizes * ratio - 1e-9, sizes, side="right")  # the first far text, by size
        start, length = _runs(_new(post >> bits))
        some = text(post[start + length - 1]) >= limit[text(post[start])]
        start, length = start[some], length[some]
        post = post[_places(start, length)]
        start, end = np.cumsum(length) - length, np.repeat(np.cumsum(length), length)
        key, number = post >> bits, text(post)
        far = end - np.searchsorted(post, (key << bits) | limit[number].astype(U))
        asks = np.flatnonzero(far > 0)
        home = _range(ids[number[asks]], homes)
        by = np.lexsort((number[asks], home))
        asks, home = asks[by], home[by]
        whole, out = key[asks] | U(part << 40), []
        for p, of, top, n in _by_range(home, number[asks]):
            who = number[asks[top]]
            out.append((p, ASKED, ids[who].tobytes(), sizes[who].astype(np.uint32).tobytes(), n.tobytes(), whole[of].tobytes(), far[asks[of]].astype(np.uint32).tobytes()))
        held = np.flatnonzero(number >= np.repeat(limit[number[start]], length)) if len(start) else start
        start, length = _runs(_new(key[held]))
        for lot in _lots(length, RUN):
            here = held[_places(start[lot], length[lot])]
            used, member = np.unique(number[here], return_inverse=True)
            out.append((part, HELD, ids[used].tobytes(), sizes[used].astype(np.uint32).tobytes(), length[lot].astype(np.uint32).tobytes(), _low5(key[held[start[lot]]]).tobytes(), member.astype(np.uint32).tobytes()))
        return _table(out)

    return run


def needed(contain: float, sizes: np.ndarray) -> np.ndarray:
    return np.ceil(contain * sizes - 1e-9).astype(np.int64)


def _choose(contain: float):
    """The texts that may have far links, with their shingles, and which of them to ask by."""

    def run(table: pa.Table) -> pa.Table:
        rows, home = _of(table, ASKED), table["part"][0].as_py()
        counts = _read(rows["counts"], np.uint32)
        ids, sizes = np.repeat(_read(rows["ids"], U), counts), np.repeat(_read(rows["sizes"], np.uint32), counts).astype(np.int64)
        key, far = _read(rows["keys"], U), _read(rows["facts"], np.uint32)
        by = np.lexsort((key, far, sizes, ids))
        ids, sizes, key = ids[by], sizes[by], key[by]
        start, length = _runs(_new(ids, sizes))
        need = needed(contain, sizes[start])
        asks = np.arange(len(key)) - np.repeat(start, length) < np.repeat(length - need + 1, length)
        some = length >= need
        out = [(home, ASKER, ids[a : a + 1].tobytes(), sizes[a : a + 1].astype(np.uint32).tobytes(), None, key[a : a + n].tobytes(), None) for a, n in zip(start[some].tolist(), length[some].tolist())]
        at = _places(start[some], length[some])
        part = (key[at] >> U(40)).astype(np.int64)
        by = np.lexsort((at, part))
        at, part = at[by], part[by]
        owner = np.searchsorted(start, at, side="right") - 1
        for p, of, top, n in _by_range(part, owner):
            out.append((p, CHOSEN, ids[at[top]].tobytes(), sizes[at[top]].astype(np.uint32).tobytes(), n.tobytes(), _low5(key[at[of]]).tobytes(), asks[at[of]].tobytes()))
        return _table(out)

    return run


def _meet(ratio: float, homes: int):
    """Of a range, by the larger text: the pairs that meet, and the shingles asked for that it has."""

    def run(table: pa.Table) -> pa.Table:
        part, held, rows, out = table["part"][0].as_py(), _of(table, HELD), _of(table, CHOSEN), []
        if not rows["ids"] or not held["ids"]:
            return _table(out)
        counts = _read(rows["counts"], np.uint32)
        owner = np.repeat(np.arange(len(counts)), counts)
        names, size = _read(rows["ids"], U), _read(rows["sizes"], np.uint32).astype(np.int64)
        asked, asks = _unpack5(rows["keys"]), np.flatnonzero(_read(rows["facts"], bool))
        keys = np.unique(asked)
        # the texts of the shingles that are asked for
        texts, where = np.unique(_read(held["ids"], U), return_index=True)
        sizes = _read(held["sizes"], np.uint32)[where].astype(np.int64)
        found, lengths, members = [], [], []
        for ids, n, key, member in zip(held["ids"], held["counts"], held["keys"], held["facts"]):
            key, n = _unpack5([key]), np.frombuffer(n, np.uint32).astype(np.int64)
            some = np.isin(key, keys)
            number = np.searchsorted(texts, np.frombuffer(ids, U)).astype(np.int32)
            members.append(number[np.frombuffer(member, np.uint32)[np.repeat(some, n)]])
            found.append(key[some])
            lengths.append(n[some])
        held = None
        keys, length, member = np.concatenate(found), np.concatenate(lengths), np.concatenate(members)
        members = None
        home = _range(texts, homes).astype(np.int32)
        by = np.argsort(home[member], kind="stable")
        which = np.repeat(np.arange(len(keys), dtype=np.int32), length)
        edges = np.r_[0, np.cumsum(np.bincount(home[member], minlength=homes))]
        for p in np.flatnonzero(np.diff(edges)).tolist():
            of = by[edges[p] : edges[p + 1]]
            of = of[np.argsort(member[of], kind="stable")]
            first, n = _runs(_new(member[of]))
            out.append((p, SLIM, texts[member[of[first]]].tobytes(), None, n.astype(np.uint32).tobytes(), (keys[which[of]] | U(part << 40)).tobytes(), None))
        del by, which
        start = np.cumsum(length) - length
        by = np.argsort(keys)
        start, length, keys = start[by], length[by], keys[by]
        at = np.searchsorted(keys, asked)
        asks = asks[np.argsort(owner[asks], kind="stable")]
        for lot in _lots(length[at[asks]], MANY):
            lot = asks[lot]
            n = length[at[lot]]
            who, text = np.repeat(owner[lot], n), member[_places(start[at[lot]], n)]
            ok = size[who] < ratio * sizes[text] - 1e-9
            pair = np.unique(who[ok].astype(U) << U(32) | text[ok].astype(U))
            who, text = (pair >> U(32)).astype(np.int64), (pair & U((1 << 32) - 1)).astype(np.int64)
            by = np.argsort(home[text], kind="stable")
            who, text = who[by], text[by]
            for p, of, top, n in _by_range(home[text], who):
                out.append((p, PAIRS, names[who[top]].tobytes(), None, n.tobytes(), texts[text[of]].tobytes(), None))
        return _table(out)

    return run


def _askers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, ids) of the texts that ask in a range."""
    for b in batches:
        rows = sorted({(p, x[i : i + 8]) for p, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for i in range(0, len(x), 8)})
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["part", "ids"])


def _patterns(owner: np.ndarray, column: np.ndarray, columns: int) -> np.ndarray:
    out = np.zeros(columns, U)
    np.bitwise_xor.at(out, column, mix64(owner.astype(U) + U(1)))
    return out


def _count(contain: float):
    """The links of the pairs of a range, by text."""

    def run(table: pa.Table) -> pa.Table:
        rows, slim, pairs = _of(table, ASKER), _of(table, SLIM), _of(table, PAIRS)
        if not pairs["ids"]:
            return pa.table([pa.array([], pa.binary()), pa.array([], pa.int64())], names=["id", "links"])
        names, texts = np.unique(_read(rows["ids"], U)), np.unique(_read(slim["ids"], U))
        keys = np.unique(_read(slim["keys"], U))
        # (asker, key) and (text, key)
        who = np.repeat(np.searchsorted(names, _read(rows["ids"], U)), [len(x) // 8 for x in rows["keys"]])
        asked = _read(rows["keys"], U)
        at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
        here = keys[at] == asked
        who, at = who[here], at[here]
        text = np.repeat(np.searchsorted(texts, _read(slim["ids"], U)), _read(slim["counts"], np.uint32))
        column = np.searchsorted(keys, _read(slim["keys"], U))
        # keys of the same askers and the same texts are one with a weight
        pattern = np.stack([_patterns(who, at, len(keys)), _patterns(text, column, len(keys))], axis=1)
        _, one, alike, weight = np.unique(pattern, axis=0, return_index=True, return_inverse=True, return_counts=True)
        chosen = np.zeros(len(keys), bool)
        chosen[one] = True
        alike = alike.ravel()
        has = np.sort(text[chosen[column]].astype(U) << U(32) | alike[column[chosen[column]]].astype(U))
        who, at = who[chosen[at]], alike[at[chosen[at]]]
        by = np.argsort(who, kind="stable")
        at, many = at[by], np.bincount(who, minlength=len(names))
        start = np.cumsum(many) - many
        need = np.zeros(len(names), np.int64)
        need[np.searchsorted(names, _read(rows["ids"], U))] = needed(contain, _read(rows["sizes"], np.uint32).astype(np.int64))
        asker = np.repeat(np.searchsorted(names, _read(pairs["ids"], U)), _read(pairs["counts"], np.uint32))
        pair = np.unique(asker.astype(U) << U(32) | np.searchsorted(texts, _read(pairs["keys"], U)).astype(U))
        asker, text = (pair >> U(32)).astype(np.int64), (pair & U((1 << 32) - 1)).astype(np.int64)
        links = [np.zeros(len(names), np.int64), np.zeros(len(texts), np.int64)]
        for lot in _lots(many[asker], MANY):
            n = many[asker[lot]]
            column, own = at[_places(start[asker[lot]], n)], np.repeat(np.arange(len(lot)), n)
            wanted = text[lot][own].astype(U) << U(32) | column.astype(U)
            hit = has[np.minimum(np.searchsorted(has, wanted), len(has) - 1)] == wanted
            both = np.bincount(own[hit], weights=weight[column[hit]], minlength=len(lot))
            ok = lot[both >= need[asker[lot]]]
            links[0] += np.bincount(asker[ok], minlength=len(names))
            links[1] += np.bincount(text[ok], minlength=len(texts))
        ids, links = np.concatenate([names, texts])[np.concatenate(links) > 0], np.concatenate(links)
        raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(8), len(ids), [None, pa.py_buffer(ids.tobytes())]).cast(pa.binary())
        return pa.table([raw, pa.array(links[links > 0])], names=["id", "links"])

    return run


def far_links(docs: DataFrame, sets_of: Callable[[Iterable[str]], Iterable[np.ndarray]], parts: int, contain: float, ratio: float) -> DataFrame:
    """(id, n_contained) of the classes of ``docs`` (class, text) that have links with texts of a size beyond ``ratio``: id is
    the first 8 bytes of the class."""
    homes = HOMES * parts
    sent = spread(docs).mapInArrow(lean(_spelt(None, parts, sets_of)), ROWS)
    far = written(sent.groupBy("part").applyInArrow(lean_group(_find(ratio, homes)), ROWS), "far", clean=True)
    asks = written(far.filter(F.col("kind") == ASKED).groupBy("part").applyInArrow(lean_group(_choose(contain)), ROWS), "asks")
    both = far.filter(F.col("kind") == HELD).union(asks.filter(F.col("kind") == CHOSEN))
    met = written(both.groupBy("part").applyInArrow(lean_group(_meet(ratio, homes)), ROWS), "met", clean=True)
    unlink(far)
    where = met.filter(F.col("kind") == PAIRS).select("part", "ids").mapInArrow(_askers, "part int, ids binary").distinct()
    sets = asks.filter(F.col("kind") == ASKER).drop("part").join(where, "ids").select(*NAMES)
    links = met.union(sets).groupBy("part").applyInArrow(lean_group(_count(contain)), "id binary, links long")
    found = written(links.groupBy("id").agg(F.sum("links").alias("n_contained")), "contained", clean=True)
    unlink(asks, met)
    return found
