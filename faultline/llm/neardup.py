"""Near duplicates among embeddings, by Euclidean p-stable hashing.

A table hashes a normalised vector to the numbers floor((a.v + b) / WIDTH) of several Gaussian projections a; vectors
with equal numbers share a bucket. The number of projections follows the number of vectors, so that buckets of
unrelated vectors stay small, and the number of tables follows from it, so that a pair at the least cosine is missed
with probability MISS. Buckets are compared exactly, in double precision and block by block: a bucket with many
members is split to pairs of blocks. A pair counts in the first table that brings it together, so nothing is
listed by pairs: blocks return numbers of links, and a forest of edges that holds together what is linked.

Equal vectors are one class with a weight, and are hashed once.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components have no links and are their
own component; vectors of different lengths aren't linked; vectors with equal vec_id are vectors of their own; a null
vec_id takes part, and a component whose vec_ids are all null has a null component_id; an empty table gives no rows;
further columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import mix64, narrow, roots_of, row_count, standing_on, unlink, written
from faultline.llm.graph import components

WIDTH, MISS, BUCKET, BLOCK, SEED = 2.0, 0.003, 64, 1024, 20240229


def together(distance: float) -> float:
    """The probability that one projection puts two vectors at ``distance`` to the same number."""
    c = WIDTH / distance
    return math.erf(c / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * c) * (1 - math.exp(-c * c / 2))


def tuned(n: int, cosine: float) -> tuple[int, int]:
    """(projections a table, tables)."""
    projections = max(4, math.ceil(math.log(max(1, n / BUCKET)) / -math.log(together(math.sqrt(2)))))
    near = together(math.sqrt(max(1e-9, 2 - 2 * cosine))) ** projections
    return projections, math.ceil(math.log(MISS) / math.log(1 - near))


def _nodes(kind: str):
    """The class of each vector, a digest of its numbers, and these as ``kind``; null for one that links with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes, vectors = [], []
            for v in b.column(1).to_pylist():
                ok = bool(v) and None not in v
                if ok:
                    x = np.array(v, np.float64) + 0.0
                    ok = bool(np.isfinite(x).all() and x.any())
                nodes.append(xxhash.xxh3_128_digest(x.tobytes()) if ok else None)
                vectors.append(x.astype(kind).tobytes() if ok else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(nodes, pa.binary()), pa.array(vectors, pa.binary())], ["vec_id", "node", "vector"])

    return run


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _hashes(projections: int, tables: int, kind: str):
    made: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b.column(2).to_pylist()
            sizes = np.array([len(v) for v in raw]) // np.dtype(kind).itemsize
            keys = np.empty((len(raw), tables), np.uint64)
            for size in np.unique(sizes).tolist():
                if size not in made:
                    rng = np.random.default_rng([SEED, size])
                    made[size] = rng.normal(size=(size, projections * tables)), rng.uniform(0, WIDTH, projections * tables)
                at = np.flatnonzero(sizes == size)
                x = _unit(np.frombuffer(b"".join(raw[i] for i in at), kind).astype(np.float64).reshape(-1, size))
                numbers = np.floor((x @ made[size][0] + made[size][1]) / WIDTH).astype(np.int64).reshape(len(at), tables, projections)
                key = np.full((len(at), tables), size, np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.arange(tables, dtype=np.uint64)
                for i in range(projections):
                    key = mix64(key + numbers[:, :, i].astype(np.uint64))
                keys[at] = key
            packed = keys.view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(packed.tolist(), pa.list_(pa.int64()))], ["node", "n", "vector", "keys"])

    return run


def _compare(cosine: float, kind: str):
    """From rows (key, at, i, j, block, node, n, vector, keys of earlier tables) that are sorted by the first four: (node, other, links)
    with a node's number of links, or an edge to another node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        out: tuple[list, list, list] = ([], [], [])

        def close() -> None:
            for size in {len(r[3]) for r in held}:  # one, but for a hash collision
                compare([r for r in held if len(r[3]) == size])

        def compare(held: list) -> None:
            if len(held) < 2:
                return
            blocks, weights = np.array([r[0] for r in held]), np.array([r[2] for r in held], np.int64)
            x = _unit(np.stack([np.frombuffer(r[3], kind).astype(np.float64) for r in held]))
            linked = x @ x.T >= cosine
            np.fill_diagonal(linked, False)
            if now[2] != now[3]:
                linked &= blocks[:, None] != blocks[None, :]
            if not linked.any():
                return
            keys = np.array([r[4] for r in held])
            for t in range(now[1]):  # counted in an earlier table
                linked &= keys[:, None, t] != keys[None, :, t]
            links = linked @ weights
            for i in np.flatnonzero(links):
                out[0].append(held[i][1])
                out[1].append(None)
                out[2].append(int(links[i]))
            roots = roots_of(linked)
            for i in np.flatnonzero(roots != np.arange(len(roots))):
                out[0].append(held[i][1])
                out[1].append(held[roots[i]][1])
                out[2].append(0)

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.int64())], ["node", "other", "links"])

        for b in batches:
            for key, at, i, j, *row in zip(*[b.column(k).to_pylist() for k in range(9)]):
                if (key, at, i, j) != now:
                    close()
                    now, held = (key, at, i, j), []
                held.append(row)
            if len(out[0]) > 10_000:
                yield batch()
                for column in out:
                    column.clear()
        close()
        if out[0]:
            yield batch()

    return run


def links(df: DataFrame, cosine: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector."""
    kind = "<f4" if dict(df.dtypes)[vector_col] == "array<float>" else "<f8"  # floats are exact as they are
    rows = narrow(df, id_col, vector_col).mapInArrow(_nodes(kind), "vec_id long, node binary, vector binary")
    classes = written(rows.filter("node IS NOT NULL").groupBy("node").agg(F.count("*").alias("n"), F.min("vec_id").alias("least"), F.first("vector").alias("vector")), "vectors")
    projections, tables = tuned(row_count(classes), cosine)
    hashed = classes.select("node", "n", "vector").mapInArrow(_hashes(projections, tables, kind), "node binary, n long, vector binary, keys array<long>")
    members = hashed.select("*", F.posexplode("keys").alias("at", "key"))
    sizes = hashed.select(F.posexplode("keys").alias("at", "key")).groupBy("key", "at").agg(F.count("*").alias("members")).filter("members > 1")
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    placed = members.join(sizes, ["key", "at"]).withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    pairs = placed.select("key", "at", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "n", "vector", F.expr("slice(keys, 1, at)").alias("keys"))
    ordered = pairs.repartition("key", "at", "i", "j").sortWithinPartitions("key", "at", "i", "j", "node")
    found = written(ordered.mapInArrow(_compare(cosine, kind), "node binary, other binary, links long"), "links")
    roots = components(found.filter("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b")))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    known = classes.select("node", "n", "least").join(counts, "node", "left").join(roots.withColumnRenamed("root", "r"), "node", "left").withColumn("r", F.coalesce("r", "node"))
    known = known.join(known.groupBy("r").agg(F.min("least").alias("component_id")), "r")
    facts = written(known.select("node", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).cast("long").alias("n_links"), "component_id"), "facts")
    unlink(classes, found, roots)
    linked = rows.filter("node IS NOT NULL").select("vec_id", "node").join(facts, "node").select("vec_id", "n_links", "component_id")
    alone = rows.filter("node IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return standing_on(linked.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))), facts)
