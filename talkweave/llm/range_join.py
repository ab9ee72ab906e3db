"""Near-duplicate vectors by an exact metric range join.

On unit vectors a cosine of at least `cosine` is a distance of at most r = sqrt(2 - 2 * cosine).
Pivots, a bounded sample of the vectors, partition them: a vector's home is the cell of its nearest
pivot. By the triangle inequality a vector within r of one whose home is c has a distance to the
bisector of its own pivot and c's of at most r, so each vector is also sent to the cells of smaller
number that it is that near to (for Euclidean distances the bisector test is the sharper form of
d(x, c) - d(x, home) <= 2r). Every pair within r then meets in exactly one cell, once, and cells join
independently. Equal vectors are aggregated first. A cell of over `tile_rows` rows is split into
tiles, and each pair of tiles is a task of its own.

A task returns for each row how many vectors it links with, and at most one edge; the components of
the edges are the groups. Nothing grows with the square of a group.

Defined results: vectors that are null, zero, or hold null or non-finite components, and vectors
whose label is null, link with nothing and are groups of their own; vectors of different lengths do
not link; rows that repeat link with each other; a null vec_id counts as a vector and is never the
smallest of a group with other ids; extra columns are ignored, whatever their names; an empty table
gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkweave.llm.common import connected_components, durable, spread_join
from talkweave.llm.simhash import forest

SLACK = 1e-9


def unit(blobs: list[bytes], kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(blobs), dtype=kind).reshape(len(blobs), -1).astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)  # neither overflow nor underflow of the squares
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def as_bytes(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> tuple[DataFrame, str]:
    """(vec_id, label, vec) with vec the components' bytes, null where nothing can link; numpy type of the components."""
    wide = not isinstance(vectors.schema[vector_col].dataType.elementType, T.FloatType)
    kind = "<f8" if wide else "<f4"
    schema = T.StructType([T.StructField("vec_id", vectors.schema[id_col].dataType), T.StructField("label", T.StringType()), T.StructField("vec", T.BinaryType())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column, labels = b.column(2), b.column(1).to_pylist()
            out = []
            for v, label in zip(column, labels, strict=True):
                v = v.values if v.is_valid else None
                if label is None or v is None or not len(v) or v.null_count:
                    out.append(None)
                    continue
                x = v.to_numpy(zero_copy_only=False).astype(kind) + 0.0  # -0.0 is 0.0
                out.append(x.tobytes() if np.isfinite(x).all() and x.any() else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(labels, pa.string()), pa.array(out, pa.binary())], names=["vec_id", "label", "vec"])

    kind_sql = "array<double>" if wide else "array<float>"
    return vectors.select(F.col(id_col), F.col(label_col).cast("string"), F.col(vector_col).cast(kind_sql)).mapInArrow(pack, schema), kind


def cell_links(x: np.ndarray, home: np.ndarray, weight: np.ndarray, first: np.ndarray | None, cosine: float) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """(weights linked with each row, spanning edges). Pairs of two visitors are another cell's; first marks
    the rows of one tile, whose pairs with the others alone count."""
    n = len(x)
    total, edges = np.zeros(n, dtype=np.int64), []
    for at in range(0, n, 512):
        rows = np.arange(at, min(at + 512, n))
        near = x[rows] @ x.T >= cosine
        near &= home[rows][:, None] | home[None, :]
        near[rows - at, rows] = False
        if first is not None:
            near &= first[rows][:, None] != first[None, :]
        total[rows] = near @ weight
        i, j = np.nonzero(near)
        if len(i):
            edges += forest(rows[i], j, n)
    if len(edges) > n:
        e = np.array(edges)
        edges = forest(e[:, 0], e[:, 1], n)
    return total, edges


def near_vectors(vectors: DataFrame, cosine: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cell_rows: int = 8192, tile_rows: int = 4096, most_pivots: int = 1024) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row for each row of vectors."""
    if not 0 < cosine <= 1:
        raise ValueError("cosine must be over 0 and at most 1")
    packed, kind = as_bytes(vectors, id_col, vector_col, label_col)
    packed = durable(packed.withColumn("key", F.when(F.col("vec").isNotNull(), F.md5(F.concat(F.col("label").cast("binary"), F.lit(b"\0"), F.col("vec"))))))
    valid = packed.filter("vec is not null")
    groups = valid.groupBy("key").agg(F.first("label").alias("label"), F.first("vec").alias("vec"), F.min("vec_id").alias("low"), F.count("*").alias("n"))
    groups = durable(groups.withColumn("cid", F.monotonically_increasing_id()))
    count = groups.count()
    pivots = {}
    for r in groups.select("vec").orderBy(F.xxhash64("vec")).limit(max(1, min(most_pivots, math.ceil(count / cell_rows)))).collect():
        pivots.setdefault(len(r["vec"]), []).append(bytes(r["vec"]))
    pivots = {k: np.unique(unit(v, kind).round(12), axis=0) for k, v in pivots.items()}
    pivots = {k: v / np.sqrt((v * v).sum(1, keepdims=True)) for k, v in pivots.items()}
    radius = math.sqrt(max(0.0, 2 - 2 * cosine)) + SLACK

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each vector to its home and to the cells of smaller number whose members may be within reach."""
        for b in batches:
            blobs = b.column(1).to_pylist()
            sizes = np.array([len(v) for v in blobs], dtype=np.int64)
            rows, cells, homes = [], [], []
            for size in np.unique(sizes):
                at = np.nonzero(sizes == size)[0]
                p = pivots.get(int(size))
                if p is None or len(p) == 1:
                    rows.append(at), cells.append(np.zeros(len(at), dtype=np.int64)), homes.append(np.ones(len(at), dtype=bool))
                    continue
                x = unit([blobs[i] for i in at], kind)
                squares = 2 - 2 * (x @ p.T)
                home = squares.argmin(1)
                gaps = np.sqrt(np.maximum(0, 2 - 2 * p @ p.T))[home]
                reach = (squares - squares[np.arange(len(at)), home][:, None]) <= 2 * radius * gaps + SLACK
                reach &= np.arange(len(p)) < home[:, None]
                reach[np.arange(len(at)), home] = True
                i, c = np.nonzero(reach)
                rows.append(at[i]), cells.append(c), homes.append(c == home[i])
            i = np.concatenate(rows)
            pick = pa.array(i)
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(pick) for k in range(b.num_columns)), pa.array(sizes[i]), pa.array(np.concatenate(cells).astype(np.int64)), pa.array(np.concatenate(homes))], names=["cid", "vec", "n", "label", "size", "cell", "home"])

    dealt = groups.select("cid", "vec", "n", "label").mapInArrow(send, "cid long, vec binary, n long, label string, size long, cell long, home boolean")
    dealt = durable(dealt.withColumn("cell_key", F.xxhash64("label", "size", "cell")))
    large = dealt.groupBy("cell_key").agg(F.count("*").alias("rows")).filter(F.col("rows") > tile_rows).select("cell_key", F.ceil(F.col("rows") / tile_rows).cast("int").alias("tiles"))
    tiled = spread_join(dealt, large, "cell_key", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    tiled = tiled.withColumn("tile", F.pmod(F.xxhash64("cid"), F.col("tiles")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    tiled = tiled.withColumn("a", F.least("tile", "other")).withColumn("b", F.greatest("tile", "other"))

    def join(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        x = unit(table.column("vec").to_pylist(), kind)
        cid = table.column("cid").to_numpy()
        first = table.column("tile").to_numpy() == key[4].as_py() if key[4].as_py() != key[5].as_py() else None
        links, edges = cell_links(x, table.column("home").to_numpy(), table.column("n").to_numpy(), first, cosine)
        hit = np.nonzero(links)[0]
        e = np.array(edges, dtype=np.int64).reshape(-1, 2)
        return pa.table({
            "cid": pa.array(np.concatenate([cid[hit], cid[e[:, 0]]])),
            "links": pa.array(np.concatenate([links[hit], np.zeros(len(e), dtype=np.int64)])),
            "other": pa.array([None] * len(hit) + cid[e[:, 1]].tolist(), pa.int64()),
        })

    found = durable(tiled.groupBy("label", "size", "cell", "tiles", "a", "b").applyInArrow(join, "cid long, links long, other long"))
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    joined = connected_components(found.filter("other is not null").select(F.col("cid").alias("a"), F.col("other").alias("b")))
    own = groups.select("cid", "key", "low", "n").join(links, "cid", "left").join(joined.withColumnRenamed("node", "cid"), "cid", "left")
    own = durable(own.select("key", "low", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "cid").alias("component")))
    least = own.groupBy("component").agg(F.min("low").alias("component_id"))
    told = spread_join(own, least, "component", "inner").select("key", "n_links", "component_id")
    # A vector that links with nothing has a key of its own here, so that these are not one hot key.
    left = packed.select("vec_id", F.coalesce("key", F.concat(F.lit("-"), F.monotonically_increasing_id().cast("string"))).alias("key"), F.col("key").isNotNull().alias("valid"))
    out = spread_join(left, told, "key", "left")
    component = F.when(F.col("valid"), F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
