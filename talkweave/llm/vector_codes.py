"""Vector code compression: product codes whose codebooks are learnt by the filtering form of Lloyd's algorithm.

Components become integers floor(scale * x), vectors are cut into equal consecutive parts, and each part position has a
codebook of its own. Every partition packs its vectors into blocks and builds, once, a kd-tree over each part of a
block, with the bounding box, sums and count of each node cached in the block (a written table). In every round the
trees are walked level by level, all nodes of a level at once: an entry is eliminated for a node if no point of the
node's box can be nearer to it than to the entry nearest to the box's middle, and a node with one entry left is assigned
as a whole by its cached sums. Only leaves with several entries left look at their points. A partition returns one
row of sums for each entry it has used; Spark adds them up, and the driver gets parts x entries rows a round.

All arithmetic is on whole numbers that doubles hold exactly, so the result does not depend on how rows are dealt.

Defined results: vectors that are null, empty, or hold null or non-finite components are dropped, and so are those whose
length is not that of the kept vector of smallest id (of repeated ids the least vector) or is no multiple of the
parts; a vector with a component whose integer squared, times the length of a part, is 2**50 or more (for 64 components
in 4 parts one of 8192) is no entry and counts for none, and has a null code and error; a null id comes last and is
carried through; rows that repeat an id are vectors of their own; with fewer vectors than entries the codebooks are
shorter; the error of a label is the sum over its rows with a code (null from 2**63 on); extra columns are ignored,
whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkweave.llm.common import durable, settled, spread_join

EXACT = 2.0**50
CELLS = 1 << 22


def whole_numbers(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int, parts: int) -> DataFrame:
    """vec_id, label, label_key, v (array of int; null where a component is too large), size, in the order of vectors; unusable rows are gone."""
    x = F.col(vector_col).cast("array<double>")
    d = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), x.alias("x"))
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    d = d.filter(F.col("x").isNotNull() & (F.size("x") > 0) & ~F.exists("x", bad))
    most = F.sqrt(EXACT * parts / F.size("x")) / scale
    v = F.when(~F.exists("x", lambda c: F.abs(c) >= most), F.transform("x", lambda c: F.floor(c * scale).cast("int")))
    key = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("-"))
    return d.select("vec_id", "label", key.alias("label_key"), v.alias("v"), F.size("x").alias("size"))


def levels_of(n: int, leaf: int) -> list[np.ndarray]:
    """Bounds of the nodes of each level of a tree over n sorted points, until none is over leaf points."""
    out = [np.array([0, n])]
    while np.diff(out[-1]).max() > leaf:
        b = out[-1]
        out.append(np.unique(np.concatenate([b, (b[:-1] + b[1:]) // 2])))
    return out


class Tree:
    """A kd-tree over the rows of x: the order of its points, and the box, sums and bounds of the nodes of each level."""

    def __init__(self, x: np.ndarray, leaf: int) -> None:
        self.order, self.bounds = np.arange(len(x)), levels_of(len(x), leaf)
        for b in self.bounds[:-1]:
            y = x[self.order]
            wide = (np.maximum.reduceat(y, b[:-1]) - np.minimum.reduceat(y, b[:-1])).argmax(1)
            node = np.repeat(np.arange(len(b) - 1), np.diff(b))
            self.order = self.order[np.lexsort((y[np.arange(len(y)), wide[node]], node))]
        self.points = x[self.order]
        self.low, self.high, self.sums = ([f(self.points, b[:-1]) for b in self.bounds] for f in (np.minimum.reduceat, np.maximum.reduceat, np.add.reduceat))

    def pack(self) -> bytes:
        arrays = [(self.order, "<i4"), (self.points, "<i4")]
        for trio in zip(self.low, self.high, self.sums, strict=True):
            arrays += zip(trio, ("<i4", "<i4", "<f8"), strict=True)
        return b"".join(a.astype(kind).tobytes() for a, kind in arrays)

    @classmethod
    def unpack(cls, data: pa.Buffer, n: int, width: int, leaf: int) -> Tree:
        t, at = cls.__new__(cls), 0

        def take(rows: int, columns: int, kind: str) -> np.ndarray:
            nonlocal at
            a = np.frombuffer(data, kind, rows * columns, at).astype(np.float64).reshape(rows, columns)
            at += rows * columns * int(kind[2])
            return a

        t.bounds, t.order, t.points = levels_of(n, leaf), take(n, 1, "<i4")[:, 0].astype(np.int64), take(n, width, "<i4")
        t.low, t.high, t.sums = [], [], []
        for b in t.bounds:
            for held, kind in ((t.low, "<i4"), (t.high, "<i4"), (t.sums, "<f8")):
                held.append(take(len(b) - 1, width, kind))
        return t


def eliminated(low: np.ndarray, high: np.ndarray, left: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry nearest to the middle of each box, entries that are left of those in left): one row for each box."""
    squares, index = (book * book).sum(1), np.arange(len(book))
    # Twice the squared distance from the middle, but for a number of the box; the first of equals.
    near = np.where(left, 2 * squares - 2 * ((low + high) @ book.T), np.inf).argmin(1)
    # The least excess of an entry's squared distance over the nearest one's, for any point of the box: it is that of
    # the corner that lies farthest in the direction from the nearest entry to this one.
    ways = book[None] - book[near][:, None]
    reach = np.einsum("nzd,nd->nz", np.maximum(ways, 0), high) + np.einsum("nzd,nd->nz", np.minimum(ways, 0), low)
    least = squares - squares[near][:, None] - 2 * reach
    stay = left & ((least < 0) | ((least == 0) & (index <= near[:, None])))
    return near, stay


def walk(tree: Tree, book: np.ndarray, each: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(sums, counts) of the points nearest to each entry of book, and with each (entry, squared distance) of each point in tree order."""
    book = book.astype(np.float64)
    sums, counts = np.zeros_like(book), np.zeros(len(book), dtype=np.int64)
    entry, away = np.zeros(len(tree.points), dtype=np.int64), np.zeros(len(tree.points))
    squares = (book * book).sum(1)
    nodes, left = np.array([0]), np.ones((1, len(book)), dtype=bool)
    for k, b in enumerate(tree.bounds):
        step = max(1, CELLS // book.size)
        near = np.zeros(len(nodes), dtype=np.int64)
        for at in range(0, len(nodes), step):
            some = slice(at, at + step)
            near[some], left[some] = eliminated(tree.low[k][nodes[some]], tree.high[k][nodes[some]], left[some], book)
        one = left.sum(1) == 1
        for i, z in zip(nodes[one], near[one], strict=True):  # the whole subtree
            at, end = b[i], b[i + 1]
            sums[z] += tree.sums[k][i]
            counts[z] += end - at
            if each:
                entry[at:end] = z
                away[at:end] = ((tree.points[at:end] - book[z]) ** 2).sum(1)
        nodes, left = nodes[~one], left[~one]
        if k + 1 < len(tree.bounds):  # on to the children
            first, last = (np.searchsorted(tree.bounds[k + 1], b[nodes + j]) for j in (0, 1))
            count = last - first
            left = np.repeat(left, count, axis=0)
            nodes = np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())
    b = tree.bounds[-1]
    for i, stay in zip(nodes, left, strict=True):
        at, end, own = b[i], b[i + 1], np.nonzero(stay)[0]
        y = tree.points[at:end]
        d = squares[own] - 2 * (y @ book[own].T)
        z = own[d.argmin(1)]
        np.add.at(sums, z, y)
        np.add.at(counts, z, 1)
        if each:
            entry[at:end] = z
            away[at:end] = d.min(1) + (y * y).sum(1)
    return sums.astype(np.int64), counts, entry, away.astype(np.int64)


def forest_blocks(d: DataFrame, parts: int, width: int, leaf: int, block_rows: int) -> DataFrame:
    """ids, labels and label_keys (arrays), n, and trees (one blob for each part): one row for each block of vectors."""
    fields = {f.name: f.dataType for f in d.schema}
    schema = T.StructType([T.StructField("ids", T.ArrayType(fields["vec_id"])), T.StructField("keys", T.ArrayType(T.StringType())), T.StructField("n", T.IntegerType()), T.StructField("trees", T.ArrayType(T.BinaryType()))])

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def cut() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            x = t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(t.num_rows, parts * width)
            trees = [Tree(np.ascontiguousarray(x[:, p * width : (p + 1) * width]), leaf).pack() for p in range(parts)]
            listed = lambda c: pa.ListArray.from_arrays(pa.array([0, t.num_rows], pa.int32()), t.column(c).combine_chunks())
            return pa.RecordBatch.from_arrays([listed("vec_id"), listed("label_key"), pa.array([t.num_rows], pa.int32()), pa.array([trees], pa.list_(pa.binary()))], names=["ids", "keys", "n", "trees"])

        for b in batches:
            for at in range(0, b.num_rows, block_rows):
                piece = b.slice(at, block_rows)
                if held and rows + piece.num_rows > block_rows:
                    yield settled(cut())
                    held, rows = [], 0
                held.append(piece)
                rows += piece.num_rows
        if held:
            yield settled(cut())

    return d.select("vec_id", "label_key", "v").mapInArrow(plant, schema)


def compress(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", leaf_rows: int = 32, block_rows: int = 8192) -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, code, error, label_error: one row for each kept row of vectors; the codebook of each part).

    code: two hex digits for each part in order, so entries is at most 256."""
    if not 1 <= entries <= 256 or parts < 1:
        raise ValueError("a code has at least one part of at most 256 entries")
    d = durable(whole_numbers(vectors, id_col, vector_col, label_col, scale, parts))
    fits = d.filter(F.col("v").isNotNull())
    order = (F.col("vec_id").asc_nulls_last(), F.col("v"))
    head = fits.orderBy(*order).limit(1).select("size").first()
    size = head["size"] if head and head["size"] % parts == 0 else 0
    width = size // parts
    d, fits = d.filter(F.col("size") == size), fits.filter(F.col("size") == size)
    first = np.array([r["v"] for r in fits.orderBy(*order).limit(entries).select("v").collect()], dtype=np.int64).reshape(-1, max(size, 1))
    books = [first[:, p * width : (p + 1) * width].copy() for p in range(parts)]
    out_fields = T.StructType([T.StructField("vec_id", d.schema["vec_id"].dataType), T.StructField("label_key", T.StringType()), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    coded = d.sparkSession.createDataFrame([], out_fields)
    if len(first):
        grown = durable(forest_blocks(fits, parts, width, leaf_rows, max(1, min(block_rows, CELLS // size))))
        for _ in range(rounds):
            books = moved(grown, books, width, leaf_rows)
        coded = assigned(grown, books, width, leaf_rows, out_fields)
    coded = durable(coded.unionByName(d.filter(F.col("v").isNull()).select("vec_id", "label_key", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))))
    by_label = coded.groupBy("label_key").agg(F.try_sum("error").alias("label_error"))
    return spread_join(coded, by_label, "label_key", "inner").select("vec_id", label_of(F.col("label_key"), d.schema["label"].dataType).alias("label"), "code", "error", "label_error"), books


def label_of(key: Column, kind: T.DataType) -> Column:
    """The label that a label_key was made from."""
    return F.when(key != "-", F.substring(key, 2, F.length(key)).cast(kind))


def moved(grown: DataFrame, books: list[np.ndarray], width: int, leaf: int) -> list[np.ndarray]:
    """The codebooks after one round."""

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = [np.zeros_like(b) for b in books], [np.zeros(len(b), dtype=np.int64) for b in books]
        for b in batches:
            for n, trees in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                for p, blob in enumerate(trees.values):
                    s, c, _, _ = walk(Tree.unpack(blob.as_buffer(), n, width, leaf), books[p], False)
                    sums[p] += s
                    counts[p] += c
        for p in range(len(books)):
            z = np.nonzero(counts[p])[0]
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1) * width, pa.int32()), pa.array(sums[p][z].reshape(-1)))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(z), p), pa.int32()), pa.array(z, pa.int32()), pa.array(counts[p][z]), flat], names=["part", "entry", "n", "sums"])

    told = grown.select("n", "trees").mapInArrow(tell, "part int, entry int, n long, sums array<long>")
    spots = told.select("part", "entry", "n", F.posexplode("sums").alias("at", "x")).groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    out = [b.copy() for b in books]
    for r in spots.groupBy("part", "entry").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("at", "x"))).alias("s")).collect():
        out[r["part"]][r["entry"]] = np.array([x["x"] for x in r["s"]], dtype=np.int64) // r["n"]
    return out


def assigned(grown: DataFrame, books: list[np.ndarray], width: int, leaf: int, schema: T.StructType) -> DataFrame:
    """vec_id, label_key, code, error of the vectors of all blocks."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                n = b.column(2)[row].as_py()
                codes, error = np.zeros((n, len(books)), dtype=np.uint8), np.zeros(n, dtype=np.int64)
                for p, blob in enumerate(b.column(3)[row].values):
                    tree = Tree.unpack(blob.as_buffer(), n, width, leaf)
                    _, _, entry, away = walk(tree, books[p], True)
                    codes[tree.order, p] = entry
                    error[tree.order] += away
                text = codes.tobytes().hex()
                step = 2 * len(books)
                yield settled(pa.RecordBatch.from_arrays([b.column(0)[row].values, b.column(1)[row].values, pa.array([text[i : i + step] for i in range(0, len(text), step)], pa.string()), pa.array(error)], names=schema.names))

    return grown.select("ids", "keys", "n", "trees").mapInArrow(code, schema)


def books_digest(books: list[np.ndarray]) -> str:
    """SHA-256 of the decimal components of all entries, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.reshape(-1)).encode()).hexdigest()
