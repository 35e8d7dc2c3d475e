"""Best-fit packing of token sequences into fixed-size rows, in bounded space.

``OpenBins`` is an online best-fit packer: at most ``most`` bins are open, kept in one list per amount of free space;
a bitset with a bit per amount finds the least amount that is enough in a few machine words. When a piece fits
nowhere and all bins are open, the fullest closes. ``pack`` deals pieces to independent lots by a hash, so that the
work scales out with no shared state; in each lot the longest pieces come first, which leaves the short ones for the
gaps. Lots hold about ``lot`` documents: only a lot's last bins stay unfilled.

Defined results: a null or empty text is one piece that holds the end token alone; ties between pieces break by
doc_id and piece number, and repeated rows are pieces of their own; an empty table gives no rows; further columns of
the input are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.bpe import codec
from faultline.llm.common import map_text, narrow, row_count

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class OpenBins:
    """Bounded-space online best fit; ``add`` gives (bin number, place in it)."""

    def __init__(self, size: int, most: int):
        self.size, self.most = size, most
        self.by_free: list[list[int]] = [[] for _ in range(size + 1)]
        self.bits, self.open, self.made = 0, 0, 0

    def _put(self, number: int, free: int) -> None:
        if free:
            self.by_free[free].append(number)
            self.bits |= 1 << free
            self.open += 1

    def _take(self, free: int) -> int:
        held = self.by_free[free]
        number = held.pop()
        if not held:
            self.bits &= ~(1 << free)
        self.open -= 1
        return number

    def add(self, length: int) -> tuple[int, int]:
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            number = self._take(free)
        else:
            if self.open >= self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)
            number, free = self.made, self.size
            self.made += 1
        self._put(number, free - length)
        return number, self.size - free


def pieces(df: DataFrame, path: str, size: int = 1024, end: int | None = 2) -> DataFrame:
    """The pieces of every text: its ids and then ``end``; longer ones are cut into pieces of ``size``, the first of
    which takes what is over."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        c, tail = codec(path), b"" if end is None else end.to_bytes(4, "little")
        docs, number, start, length, crc = [], [], [], [], []
        for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            ids = c.encode(text) + tail
            n = len(ids) // 4
            at = 0
            for k in range(max(1, -(-n // size))):
                to = min(n, (n - 1) % size + 1 + k * size) if n else 0
                docs.append(doc)
                number.append(k)
                start.append(at)
                length.append(to - at)
                crc.append(zlib.crc32(ids[4 * at : 4 * to]))
                at = to
        return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return map_text(narrow(df, "doc_id", "text"), run, PIECES)


def place(cut: DataFrame, lots: int, size: int = 1024, open_bins: int = 65_536) -> DataFrame:
    """``cut`` with sequence_id and offset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, bins = None, None
        for b in batches:
            numbers = np.empty(b.num_rows, np.int64)
            places = np.empty(b.num_rows, np.int64)
            for i, (lot, length) in enumerate(zip(b.column(0).to_pylist(), b.column(4).to_pylist())):
                if lot != now:
                    now, bins = lot, OpenBins(size, open_bins)
                number, places[i] = bins.add(length)
                numbers[i] = lot << 36 | number
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(numbers), pa.array(places)], [*b.schema.names[1:], "sequence_id", "offset"])

    lot = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(lots)).cast("long")
    dealt = cut.select(lot.alias("lot"), *PIECES.replace(",", "").split()[::2])
    ordered = dealt.repartition(lots, "lot").sortWithinPartitions("lot", F.desc("length"), "doc_id", "piece", "start", "ids_crc32")
    return ordered.mapInArrow(run, PIECES + ", sequence_id long, offset long")


def pack(df: DataFrame, path: str, size: int = 1024, end: int | None = 2, lot: int = 100_000) -> DataFrame:
    """Every text's pieces and their places in sequences of at most ``size`` ids."""
    return place(pieces(df, path, size, end), max(1, -(-row_count(df) // lot)), size)
