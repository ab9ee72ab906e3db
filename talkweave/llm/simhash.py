"""SimHash near-duplicates by tiled exact comparison.

A document's fingerprint is the bitwise majority of the XXH64 hashes of its word shingles. Equal
fingerprints are aggregated first, so a group of copies of any size is one row. Distinct
fingerprints are dealt into tiles by the population counts of their two halves; a pair of tiles is
compared only if the counts differ by no more than the radius in total, since every differing bit
changes a count by one. Inside a pair the same test on the counts of the four quarters skips
sub-tiles, and what is left is compared by exclusive-or and bit count in numpy. Tiles over
`tile_rows` are split by a hash of the fingerprint, and their parts are compared pairwise.

A pair of tiles returns at most one edge for each of its rows (a spanning forest of its links), so
nothing grows with the square of a group; the groups are the connected components of the edges.

Defined results: a null or empty text has fingerprint zero and links like any other; texts of fewer
words than a shingle hash their whole sequence; rows that repeat are in one group; a null doc_id
never is the smallest of a group (its component_id is then the smallest other id, or null); extra
columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkweave.llm.common import connected_components, durable, settled, spread_join

SEED = 42


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """64-bit fingerprint of a UTF-8 text; a bit is set if it is set in over half of the hashes."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # of bytes: lower-cases A-Z alone and splits at the six ASCII spaces
    n = len(words) - shingle + 1
    if not words:
        return 0
    if n <= 1:
        return xxh64_intdigest(b" ".join(words), SEED)
    if shingle == 3:
        parts = map(b"%b %b %b".__mod__, zip(words, words[1:], words[2:], strict=False))
    else:
        parts = (b" ".join(words[i : i + shingle]) for i in range(n))
    h = np.fromiter((xxh64_intdigest(p, SEED) for p in parts), dtype=np.uint64, count=n)
    votes = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 4096):
        votes += np.unpackbits(h[at : at + 4096].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a signed long)."""
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).cast(pa.binary())
            fps = np.array([fingerprint(t.as_py() or b"", shingle) for t in texts], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])
        settled(None)

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)


def half_counts(fp: Column) -> tuple[Column, Column]:
    return F.bit_count(F.shiftrightunsigned(fp, 32)).cast("int"), F.bit_count(fp.bitwiseAND(F.lit(0xFFFFFFFF))).cast("int")


def hooked(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """root, for each row the smallest of its group, after the pairs (a, b) have been joined."""
    root = root.copy()
    while len(a):  # every round hooks each root to the smallest it is linked to, then halves paths
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        live = low != high
        a, b = a[live], b[live]
        np.minimum.at(root, high[live], low[live])
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root


def forest(a: np.ndarray, b: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Edges (member, root) that join what the pairs (a, b) of numbers under n join."""
    root = hooked(np.arange(n), a, b)
    return [(int(i), int(root[i])) for i in np.nonzero(root != np.arange(n))[0]]


def quarter_counts(fps: np.ndarray) -> np.ndarray:
    return np.stack([np.bitwise_count(fps >> np.uint64(s) & np.uint64(0xFFFF)) for s in (48, 32, 16, 0)], axis=1).astype(np.int16)


def links(x: np.ndarray, y: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (in x, in y) of the pairs within radius; y None: pairs of x with itself. A spanning set where x is y."""
    own = y is None
    y = x if own else y

    def grouped(v: np.ndarray):
        q = quarter_counts(v)
        key = ((q[:, 0].astype(np.int64) * 17 + q[:, 1]) * 17 + q[:, 2]) * 17 + q[:, 3]
        order = np.argsort(key, kind="stable")
        cuts = np.nonzero(np.diff(key[order]))[0] + 1
        starts = np.concatenate([[0], cuts]).astype(np.int64)
        return order, starts, np.append(cuts, len(v)), q[order[starts]]

    ox, sx, ex, qx = grouped(x)
    oy, sy, ey, qy = (ox, sx, ex, qx) if own else grouped(y)
    xs, ys = x[ox], y[oy]
    size_y = ey - sy
    n_all = len(x) + (0 if own else len(y))
    found_a, found_b, held = [], [], 0
    for k in range(len(sx)):
        near = np.abs(qy - qx[k]).sum(axis=1) <= radius
        if own:
            near[:k] = False
        pick = np.nonzero(near)[0]
        if not len(pick):
            continue
        n = size_y[pick]
        cols = np.repeat(sy[pick] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        other = ys[cols]
        step = max(1, 1_000_000 // max(1, len(other)))
        for at in range(sx[k], ex[k], step):
            mine = xs[at : min(at + step, ex[k])]
            i, j = np.nonzero(np.bitwise_count(mine[:, None] ^ other[None, :]) <= radius)
            a, b = ox[at + i], oy[cols[j]]
            if own:
                keep = a != b
                a, b = a[keep], b[keep]
            found_a.append(a)
            found_b.append(b + (0 if own else len(x)))
            held += len(a)
            if held > 500_000:  # a dense part: a spanning forest joins the same rows
                f = np.array(forest(np.concatenate(found_a), np.concatenate(found_b), n_all), dtype=np.int64).reshape(-1, 2)
                found_a, found_b, held = [f[:, 0]], [f[:, 1]], 0
    if not found_a:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.concatenate(found_a), np.concatenate(found_b)


def fingerprint_edges(distinct: DataFrame, radius: int = 3, tile_rows: int = 32768) -> DataFrame:
    """(a, b): edges between the distinct fingerprints (column fp) whose components are those of all links within radius."""
    high, low = half_counts(F.col("fp"))
    tiled = distinct.select("fp", (high * 64 + low).alias("tile"))
    # At most 33 * 33 tiles: their sizes say how many parts each has, and which tiles exist.
    sizes = {int(r["tile"]): int(r["n"]) for r in tiled.groupBy("tile").agg(F.count("*").alias("n")).collect()}
    parts = {t: -(-n // tile_rows) for t, n in sizes.items()}
    if not parts:
        return distinct.sparkSession.createDataFrame([], "a long, b long")
    if max(parts.values()) >= 1 << 19:
        raise ValueError("too many parts of a tile: raise tile_rows")
    near = {t: [u for u in parts if abs(t // 64 - u // 64) + abs(t % 64 - u % 64) <= radius] for t in parts}
    split = {t: n for t, n in parts.items() if n > 1}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Packs the rows of each pair's side that a batch holds. A pair is named by its two parts, the smaller first."""
        for b in batches:
            fps = b.column(0).to_numpy().view(np.uint64)
            tiles = b.column(1).to_numpy().astype(np.int64)
            n = np.ones(len(tiles), dtype=np.int64)
            for t, p in split.items():
                n[tiles == t] = p
            spot = tiles << 19 | ((fps * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % n)
            order = np.argsort(spot, kind="stable")
            cuts = np.concatenate([[0], np.nonzero(np.diff(spot[order]))[0] + 1, [len(spot)]])
            keys, sides, blobs = [], [], []
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                if e > s:
                    blob, own = fps[order[s:e]].tobytes(), int(spot[order[s]])
                    for u in near[own >> 19]:
                        for j in range(parts[u]):
                            other = u << 19 | j
                            keys.append(min(own, other) << 32 | max(own, other))
                            sides.append(int(own > other))
                            blobs.append(blob)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sides, pa.int32()), pa.array(blobs, pa.binary())], names=["pair", "side", "fps"])

    def compare(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        blobs = table.column("fps").to_pylist()
        x = np.frombuffer(b"".join(v for v, s in zip(blobs, side, strict=True) if s == 0), dtype=np.uint64)
        y = np.frombuffer(b"".join(v for v, s in zip(blobs, side, strict=True) if s == 1), dtype=np.uint64)
        own = key[0].as_py() >> 32 == key[0].as_py() & 0xFFFFFFFF
        every = x if own else np.concatenate([x, y])
        found = forest(*links(x, None if own else y, radius), len(every))
        at = np.array(found, dtype=np.int64).reshape(-1, 2)
        signed = every.view(np.int64)
        return settled(pa.table({"a": pa.array(signed[at[:, 0]]), "b": pa.array(signed[at[:, 1]])}))

    dealt = tiled.mapInArrow(deal, "pair long, side int, fps binary")
    return dealt.groupBy("pair").applyInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3, tile_rows: int = 32768) -> DataFrame:
    """doc_id, fp (long), component_id: one row for each row of docs."""
    fps = durable(fingerprints(docs, id_col, text_col, shingle))
    distinct = fps.groupBy("fp").agg(F.min("doc_id").alias("low"))
    joined = connected_components(fingerprint_edges(distinct.select("fp"), radius, tile_rows))
    low = distinct.join(joined.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    groups = durable(low)
    least = groups.groupBy("component").agg(F.min("low").alias("component_id"))
    named = spread_join(groups.select("fp", "component"), least, "component", "inner").select("fp", "component_id")
    return spread_join(fps, named, "fp", "inner").select("doc_id", "fp", "component_id")

