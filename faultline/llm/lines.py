"""Removal of lines that many documents share, through hash ranges and keep bitmaps.

Documents send one row for each distinct line key: a 128-bit hash, and where the key's lines stand. Rows are
partitioned by ranges of the hash (which is uniform, so its bounds need no sampling) and sorted by hash, document and
position; each partition is streamed: a key's first rows are held until it is known in ``min_docs`` documents, then
all its rows give positions to drop. Positions are gathered to one compressed keep bitmap a document, and only that
meets the text again.

A hot key is combined before the shuffle: once a task has seen a key in ``min_docs`` documents, it drops further ones
on the spot and sends their positions with the document, so that a key has at most ``min_docs`` rows from a task.
The table of such counts is bounded; keys that are not in it are sent as they are.

Defined results: a document is a row; a null or empty text is one empty line, which is never dropped; repeated rows
count as documents of their own and get the same result; rows with a null doc_id take part; an empty table gives no
rows; further columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import map_text, narrow, text_bytes, slices

BLANK = b" \t\n\x0b\x0c\r"
#: Keys whose counts a task holds to combine hot keys.
COUNTED = 200_000
ROWS = "part int, h1 long, h2 long, own boolean, id long, text_hash long, n_lines int, at binary"


def key(line: bytes) -> bytes:
    return line.strip(BLANK).lower()


def _identified(df: DataFrame) -> DataFrame:
    """id, text_hash, text, doc_id: id and text_hash tell documents apart, whatever doc_id is."""
    text = F.coalesce("text", F.lit(""))
    hashed = F.xxhash64(text)
    return narrow(df, "doc_id", "text").select(F.coalesce("doc_id", hashed).alias("id"), hashed.alias("text_hash"), text.alias("text"), "doc_id")


def _keys(docs: DataFrame, min_docs: int, least: int, parts: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, int] = {}
        for b in slices(batches):
            digests, owns, ids, hashes, sizes, places = [], [], [], [], [], []
            for id_, text_hash, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                lines = text.encode("utf-8", "surrogatepass").split(b"\n")
                at = defaultdict(list)
                for i, line in enumerate(lines):
                    k = line.strip(BLANK).lower()
                    if k:
                        at[k].append(i)
                now: list[int] = []
                for k, where in at.items():
                    if least > 1 and len(k.decode("utf-8", "surrogatepass")) < least:
                        continue
                    digest = xxhash.xxh3_128_digest(k)
                    c = counts.get(digest)
                    if c is not None:
                        if c >= min_docs:
                            now += where
                            continue
                        counts[digest] = c + 1
                    elif len(counts) < COUNTED:
                        counts[digest] = 1
                    digests.append(digest)
                    owns.append(False)
                    ids.append(id_)
                    hashes.append(text_hash)
                    sizes.append(len(lines))
                    places.append(np.array(where, np.int32).tobytes())
                if now:
                    digests.append(xxhash.xxh3_128_digest(f"{id_}:{text_hash}".encode()))
                    owns.append(True)
                    ids.append(id_)
                    hashes.append(text_hash)
                    sizes.append(len(lines))
                    places.append(np.array(now, np.int32).tobytes())
            if len(counts) >= COUNTED:
                counts = {k: c for k, c in counts.items() if c > 1}
                if len(counts) > COUNTED // 2:
                    counts = {k: c for k, c in counts.items() if c >= min_docs}
                if len(counts) >= COUNTED:
                    counts = {}
            if digests:
                h = np.frombuffer(b"".join(digests), dtype=">u8").reshape(-1, 2).astype(np.uint64)
                part = ((h[:, 0] >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
                yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(h[:, 0].view(np.int64)), pa.array(h[:, 1].view(np.int64)), pa.array(owns), pa.array(ids, pa.int64()), pa.array(hashes, pa.int64()), pa.array(sizes, pa.int32()), pa.array(places, pa.binary())], ["part", "h1", "h2", "own", "id", "text_hash", "n_lines", "at"])

    return docs.select("id", "text_hash", "text").mapInArrow(run, ROWS)


def _dropped(rows: DataFrame, min_docs: int) -> DataFrame:
    """id, text_hash, n_lines, at of the rows whose key has min_docs rows; rows are sorted by key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, hot = None, None
        for b in batches:
            new = pa.Table.from_batches([b])
            if held is not None:
                new = pa.concat_tables([held, new]).combine_chunks()
            if not new.num_rows:
                continue
            h1, h2 = new["h1"].to_numpy(), new["h2"].to_numpy()
            own = new["own"].to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])
            sizes = np.diff(np.r_[starts, len(h1)])
            drop = np.repeat(sizes >= min_docs, sizes) | own
            if hot == (h1[0], h2[0]):
                drop[: sizes[0]] = True
            last = starts[-1]
            hot = (h1[last], h2[last]) if sizes[-1] >= min_docs or hot == (h1[last], h2[last]) else None
            if hot is None:
                held = new.slice(last)
                drop[last:] = False
            else:
                held = None
            if drop.any():
                yield from new.select(["id", "text_hash", "n_lines", "at"]).filter(pa.array(drop)).combine_chunks().to_batches()
        if held is not None:
            own = held["own"].to_numpy(zero_copy_only=False)
            if own.any():
                yield from held.select(["id", "text_hash", "n_lines", "at"]).filter(pa.array(own)).combine_chunks().to_batches()

    return rows.mapInArrow(run, "id long, text_hash long, n_lines int, at binary")


def keep_bitmaps(df: DataFrame, min_docs: int = 10, least: int = 1) -> DataFrame:
    """id, text_hash, keep of the documents that lose lines: keep is a deflated bitmap, a bit for each line."""
    return _bitmaps(_identified(df), min_docs, least)


def _bitmaps(docs: DataFrame, min_docs: int, least: int) -> DataFrame:
    parts = max(8, text_bytes(docs) // (32 << 20))
    rows = _keys(docs, min_docs, least, parts).repartition(parts, "part").sortWithinPartitions("h1", "h2", "id", "at")
    gathered = _dropped(rows, min_docs).groupBy("id", "text_hash").agg(F.max("n_lines").alias("n_lines"), F.collect_list("at").alias("at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for n, at in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                bits = np.ones(n, bool)
                bits[np.frombuffer(b"".join(at), np.int32)] = False
                keep.append(zlib.compress(np.packbits(bits).tobytes()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(keep, pa.binary())], ["id", "text_hash", "keep"])

    return gathered.mapInArrow(run, "id long, text_hash long, keep binary")


def kept_lines(text: str, keep: bytes | None) -> tuple[list[str], int]:
    lines = text.split("\n")
    if keep is None:
        return lines, len(lines)
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=len(lines))
    return [x for x, k in zip(lines, bits.tolist()) if k], len(lines)


def _joined(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    # bitmaps are far smaller than texts, and hashing them spares the sort of the texts
    return docs.join(bitmaps.hint("shuffle_hash"), ["id", "text_hash"], "left")


def dedup_lines(df: DataFrame, min_docs: int = 10, least: int = 1) -> DataFrame:
    """All columns of ``df``, with ``text`` without the shared lines; a null text stays null."""
    names = df.columns
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = df.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.coalesce("doc_id", F.xxhash64(text)).alias("id"), F.xxhash64(text).alias("text_hash"))
    both = _joined(docs, keep_bitmaps(df, min_docs, least)).select("row", "keep", F.col("row.text").alias("text"))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = ["\n".join(kept_lines(t, k)[0]) if k is not None and t is not None else t for t, k in zip(b.column(2).to_pylist(), b.column(1).to_pylist())]
        columns = b.column(0).flatten()
        columns[names.index("text")] = pa.array(texts, pa.string())
        return pa.RecordBatch.from_arrays(columns, names)

    return map_text(both, run, df.schema)


def digests(df: DataFrame, min_docs: int = 10, least: int = 1) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every document."""
    docs = _identified(df)
    both = _joined(docs, _bitmaps(docs, min_docs, least)).select("doc_id", "text", "keep")

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        total, dropped, sha = [], [], []
        for text, keep in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
            kept, n = kept_lines(text, keep)
            total.append(n)
            dropped.append(n - len(kept))
            sha.append(hashlib.sha256("\n".join(kept).encode("utf-8", "surrogatepass")).hexdigest())
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(total, pa.int64()), pa.array(dropped, pa.int64()), pa.array(sha)], ["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    return map_text(both, run, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")
