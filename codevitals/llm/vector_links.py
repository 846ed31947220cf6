"""Exact range join of embeddings: all pairs whose cosine reaches a limit.

On unit vectors the cosine is a distance, so the join is a metric range join. Pivots cut the space into cells; a vector lives
in the cell of its nearest pivot, and is copied into every other cell that could hold a vector within the range: by the triangle
inequality a vector of cell j is at least half the difference of the distances to the two pivots away, and in Euclidean space at least the distance
to the plane between them. Cells, cut into blocks of bounded size, are then joined independently; each vector's links are counted
in its home cell, which holds all that can be near it, and a block sends a spanning forest of its links, not the pairs.

Equal vectors form one class with a weight and are never paired. Null vectors, vectors with null or non-finite components, zero vectors and rows
without a vec_id link with nothing. A shorter vector counts as followed by zeros. Rows of one vec_id are vectors of their own that share
a component. Labels and other columns are not looked at. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codevitals.llm.components import components
from codevitals.session import stored

LIMIT = 0.95
#: Vectors for each cell, about, and pivots at most; vectors of a block on either side.
CELL, MAX_PIVOTS = 8192, 1024
QUERIES, TARGETS = 2048, 4096


def _matrix(rows: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors as the rows of a matrix of doubles."""
    parts = [np.frombuffer(x.as_buffer(), dtype="<f8") for x in rows]
    out = np.zeros((len(parts), max(map(len, parts), default=0)))
    for i, x in enumerate(parts):
        out[i, : len(x)] = x
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True, initial=1e-300)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def prepared(vectors: DataFrame) -> DataFrame:
    """vec_id, f1, f2 (128 bits of the vector), x (doubles; null where the vector links with nothing)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, prints = [], []
            for k, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                values = v.values
                usable = k is not None and values is not None and len(values) and not values.null_count
                x = values.to_numpy(zero_copy_only=False).astype("<f8") if usable else np.zeros(0)
                usable = len(x) and bool(np.isfinite(x).all()) and bool(x.any())
                data = (np.trim_zeros(x, "b") + 0.0).tobytes() if usable else None
                out.append(data)
                prints.append(np.frombuffer(xxhash.xxh3_128_digest(data or b""), dtype="<i8"))
            prints = np.stack(prints) if prints else np.zeros((0, 2), dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(prints[:, 0]), pa.array(prints[:, 1]), pa.array(out, pa.binary())], ["vec_id", "f1", "f2", "x"])

    return vectors.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(run, "vec_id long, f1 long, f2 long, x binary")


def in_cells(classes: DataFrame, limit: float) -> DataFrame:
    """cell, home, id, weight, x: each class in its home cell and as a copy in every cell within the range."""
    spark = classes.sparkSession
    n_pivots = min(MAX_PIVOTS, -(-classes.count() // CELL))
    chosen = classes.orderBy(F.xxhash64("id", "x")).limit(max(1, n_pivots)).select("x").collect()
    shared = spark.sparkContext.broadcast([r.x for r in chosen])  # MAX_PIVOTS vectors at most
    reach = float(np.sqrt(max(0.0, 2 - 2 * limit))) + 1e-9

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = _unit(_matrix([pa.scalar(bytes(x), pa.binary()) for x in shared.value]))
        between = np.sqrt(np.maximum(0, 2 - 2 * pivots @ pivots.T))
        for batch in batches:
            x = _unit(_matrix(batch.column(2)))
            width = max(x.shape[1], pivots.shape[1])
            x, p = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (x, pivots))
            square = np.maximum(0, 2 - 2 * x @ p.T)
            home = square.argmin(axis=1)
            nearest = square[np.arange(len(x)), home]
            # Distance to the plane between the home pivot and each other one.
            away = (square - nearest[:, None]) / np.maximum(2 * between[home], 1e-12)
            at, cell = np.nonzero((away <= reach) | (np.arange(len(p)) == home[:, None]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(cell), pa.array(cell == home[at]), *(c.take(pa.array(at)) for c in batch.columns)],
                ["cell", "home", "id", "weight", "x"])

    return classes.select("id", "weight", "x").mapInArrow(run, "cell long, home boolean, id long, weight long, x binary")


def linked_in_blocks(cells: DataFrame, limit: float) -> DataFrame:
    """id, n, root: links counted (by weight) of a block's queries, and the forest of its links."""
    h = F.xxhash64("id", "x")
    sizes = cells.groupBy("cell").agg(
        F.ceil(F.count(F.when(F.col("home"), 1)) / QUERIES).alias("nq"), F.ceil(F.count("*") / TARGETS).alias("nt"))
    placed = cells.join(sizes, "cell").where("nq > 0")
    zero = F.lit(0).cast("long")
    asked = placed.where("home").select(
        "cell", F.pmod(h, F.col("nq")).alias("q"), F.explode(F.sequence(zero, F.col("nt") - 1)).alias("t"), F.lit(True).alias("ask"), "id", "weight", "x")
    given = placed.select(
        "cell", F.explode(F.sequence(zero, F.col("nq") - 1)).alias("q"), F.pmod(h, F.col("nt")).alias("t"), F.lit(False).alias("ask"), "id", "weight", "x")

    def run(rows: pa.Table) -> pa.Table:
        ask = np.array(rows.column("ask").to_pylist(), dtype=bool)
        ids, weight = np.array(rows.column("id").to_pylist()), np.array(rows.column("weight").to_pylist())
        x = _matrix(rows.column("x"))
        unit = _unit(x) if len(x) else x
        q, t = np.flatnonzero(ask), np.flatnonzero(~ask)
        rough = unit[q].astype(np.float32) @ unit[t].astype(np.float32).T
        a, b = np.nonzero(rough >= limit - 1e-4)
        near = np.zeros(len(a), dtype=bool)
        for s in range(0, len(a), 50_000):
            part = slice(s, s + 50_000)
            near[part] = np.einsum("ij,ij->i", unit[q[a[part]]], unit[t[b[part]]]) >= limit
        a, b = q[a[near]], t[b[near]]
        same = (ids[a] == ids[b]) & (x[a] == x[b]).all(axis=1)
        a, b = a[~same], b[~same]
        n = np.bincount(a, weights=weight[b], minlength=len(ids)).astype(np.int64)
        root = ids.copy()
        while len(a):
            before = root.copy()
            np.minimum.at(root, a, before[b])
            np.minimum.at(root, b, before[a])
            if (root == before).all():
                break
        touched = np.union1d(a, b).astype(np.int64)
        return pa.table({"id": pa.array(ids[touched]), "f": rows.column("x").take(pa.array(touched)), "n": pa.array(n[touched]), "root": pa.array(root[touched])})

    dealt = asked.unionAll(given)
    return dealt.groupBy("cell", "q", "t").applyInArrow(run, "id long, f binary, n long, root long")


def links(vectors: DataFrame, limit: float = LIMIT) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``vectors`` (vec_id, embedding)."""
    rows = stored(prepared(vectors), "vectors")
    usable = rows.where(F.col("x").isNotNull())
    classes = stored(usable.groupBy("f1", "f2").agg(
        F.min("vec_id").alias("id"), F.count("*").alias("weight"), F.first("x").alias("x")), "vector-classes")
    found = stored(linked_in_blocks(in_cells(classes, limit), limit), "vector-links")
    counts = found.where("n > 0").groupBy(F.col("id"), F.col("f").alias("x")).agg(F.sum("n").alias("n"))
    of = classes.join(counts, ["id", "x"], "left").select("f1", "f2", "id", "weight", F.coalesce("n", F.lit(0)).alias("n"))
    placed = rows.select("vec_id", "f1", "f2", F.col("x").isNotNull().alias("usable"))
    placed = stored(placed.join(of, ["f1", "f2"], "left").withColumn("usable", F.col("usable") & F.col("id").isNotNull()), "placed-vectors")
    named = placed.where("usable").groupBy("vec_id").agg(F.min("id").alias("a"), F.max("id").alias("z")).where("a < z").select("vec_id")
    same = placed.where("usable").join(named, "vec_id").select(F.col("vec_id").alias("a"), F.col("id").alias("b"))
    edges = found.select(F.col("id").alias("a"), F.col("root").alias("b")).unionAll(same)
    found = components(edges)
    out = placed.join(found.select(F.col("node").alias("id"), "component"), "id", "left")
    component = F.when(F.col("usable"), F.coalesce("component", "id")).otherwise(F.col("vec_id"))
    n = F.when(F.col("usable"), F.col("n") + F.col("weight") - 1).otherwise(F.lit(0)).cast("long")
    return out.select("vec_id", n.alias("n_links"), component.alias("component_id"),
                      F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
