"""SimHash near-duplicates whose word shingles have a Jaccard similarity of at least `least`.

A document is the set of 64-bit hashes of its shingles of five words; equal sets are one node. Each node has
a SimHash fingerprint of 256 bits (the bitwise majority of four hashes derived from each shingle's), as a
similarity of 0.8 must be told from chance among any number of documents: such a pair differs in about 39
bits, unlike texts in 128, and the radius is 64. Fingerprints are compared by tiles, as in simhash.py: tiles
hold ranges of shingle counts and of population counts. As a similarity of `least` bounds the ratio of two sets' sizes,
only tiles of the same or the next range of shingle counts meet; of these, pairs whose population counts differ
beyond the radius are skipped, and the others are compared by exclusive-or and bit count in numpy. The first 64
bits go first and the rest only where these differ in at most `first`; first=64 leaves that out.

Fingerprints of few shingles vary much, so sets of at most `few` shingles are joined exactly besides: two such sets that
are similar enough have a part in common that is each of them without a few shingles, and meet at its hash.

The exact check follows: the components of the candidate links are dealt to cells, and a cell joins the
sets that are similar, each met by the others through their common shingles. Only sets outside the largest
group need be looked at, as a link between two groups has an end in one that is not the largest; so a large
group of near copies takes few steps, and edges never outnumber the rows. A component over `cell_rows` rows
or `cell_bytes` of text is many cells: 32 leaders are put into each of them, and what then still is outside
the component's largest group meets all others in pairs of cells. So no group of any size is one task.

The comparison of fingerprints is quadratic within the ranges of shingle counts, with a small factor; the rest grows in
proportion.

Defined results: a null or empty text has the empty set, equal to all empty sets alone; texts of fewer
words than a shingle have their whole sequence as the only shingle; rows that repeat an id and a text are
treated alike; rows that repeat an id alone are told apart by their texts; extra columns are ignored,
whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from talkweave.llm.common import connected_components, durable, fresh, settled, spread_join
from talkweave.llm.simhash import SEED, hooked

WORDS = 4
U = np.uint64
LEADERS = 32
FACTOR = U(0x9E3779B97F4A7C15)


def shingle_set(text: bytes, shingle: int = 5) -> np.ndarray:
    """Distinct hashes of the shingles of a UTF-8 text, ascending: the words' XXH64, summed with a power of a factor for each place."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # of bytes: lower-cases A-Z alone and splits at the six ASCII spaces
    if not words:
        return np.zeros(0, dtype="<u8")
    h = np.fromiter((xxh64_intdigest(w, SEED) for w in words), dtype=U, count=len(words))
    size = min(shingle, len(words))
    n = len(words) - size + 1
    out = h[:n].copy()
    for k in range(1, size):
        out *= FACTOR
        out += h[k : k + n]
    out ^= out >> U(31)
    out *= U(0xBF58476D1CE4E5B9)
    out ^= out >> U(29)
    return np.unique(out)


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """WORDS unsigned longs: each bit is set if it is set in over half of the hashes derived for its word."""
    out = np.zeros(WORDS, dtype=U)
    for k in range(WORDS):
        votes = np.zeros(64, dtype=np.int64)
        for at in range(0, len(hashes), 4096):
            h = hashes[at : at + 4096].astype(U)
            if k:
                h = (h ^ U(0x9E3779B97F4A7C15 * k % 2**64)) * U(0xBF58476D1CE4E5B9)
                h ^= h >> U(29)
                h *= U(0x94D049BB133111EB)
                h ^= h >> U(32)
            votes += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        out[k] = int.from_bytes(np.packbits(2 * votes > len(hashes)).tobytes(), "big")
    return out


def candidate_roots(x: np.ndarray, y: np.ndarray | None, radius: int, first: int = 20) -> np.ndarray:
    """For the rows of x, then of y (y None: of x alone), the smallest row that the links within radius lead to."""
    own = y is None
    every = x if own else np.concatenate([x, y])
    other, base = (x, 0) if own else (y, len(x))
    root = np.arange(len(every))
    lead, cols = np.ascontiguousarray(x[:, 0]), np.ascontiguousarray(other[:, 0])
    held_a, held_b, held = [], [], 0
    rows, width = 16, 8192
    differ, count, close = (np.empty(rows * width, dtype=t) for t in (U, np.uint8, bool))
    for at in range(0, len(x), rows):
        mine = lead[at : at + rows, None]
        for c in range(at if own else 0, len(cols), width):
            part = cols[None, c : c + width]
            shape, n = (len(mine), part.shape[1]), len(mine) * part.shape[1]
            np.bitwise_xor(mine, part, out=differ[:n].reshape(shape))
            d = np.bitwise_count(differ[:n], out=count[:n])
            np.less_equal(d, first, out=close[:n])
            close[n : n + -n % 8] = False
            some = np.flatnonzero(close[: n + -n % 8].view(U))  # eight pairs at a time, as few are close
            hit = np.flatnonzero(close[: n + -n % 8].reshape(-1, 8)[some])
            hit = some[hit >> 3] * 8 + (hit & 7)
            if not len(hit):
                continue
            a, b = at + hit // part.shape[1], base + c + hit % part.shape[1]
            live = root[a] != root[b]
            a, b = a[live], b[live]
            near = np.bitwise_count(every[a, 1:] ^ every[b, 1:]).sum(1, dtype=np.int64) + d[hit[live]] <= radius
            if near.any():
                held_a.append(a[near])
                held_b.append(b[near])
                held += len(held_a[-1])
                if held > 4096:
                    root = hooked(root, np.concatenate(held_a), np.concatenate(held_b))
                    held_a, held_b, held = [], [], 0
    return hooked(root, np.concatenate(held_a), np.concatenate(held_b)) if held else root


def candidate_edges(nodes: DataFrame, radius: int = 64, least: float = 0.8, first: int = 20, most_rows: int = 131072) -> DataFrame:
    """(a, b): edges between nodes (nid, shingles, w0 to w3) whose components are those of all fingerprints within radius,
    of sets whose sizes allow a similarity of `least`."""
    pop = sum((F.bit_count(f"w{k}") for k in range(1, WORDS)), F.bit_count("w0"))
    # Counts whose ratio is at least `least` are in the same range or the next, as ranges are a little wider.
    level = F.floor(F.log(F.greatest("shingles", F.lit(1)).cast("double")) / math.log(1 / least + 0.01)).cast("int")
    d = nodes.select("nid", *(f"w{k}" for k in range(WORDS)), pop.cast("int").alias("pop"), level.alias("level"))
    counts = {(r["level"], r["pop"]): r["n"] for r in d.groupBy("level", "pop").agg(F.count("*").alias("n")).collect()}  # at most 257 a level
    levels = 1 + max((k for k, _ in counts), default=0)
    rows = min(most_rows, max(1024, -(-sum(counts.values()) // 8)))
    # Tiles are ranges of population counts of one level; a count of too many rows is several tiles of its own.
    low, high, of, filled = [], [], [], 0
    start, parts = np.zeros((levels, 64 * WORDS + 1), dtype=np.int64), np.ones((levels, 64 * WORDS + 1), dtype=np.int64)
    for k, p in sorted(counts):
        n = -(-counts[k, p] // rows)
        if n > 1 or not of or of[-1] != k or filled + counts[k, p] > rows:
            start[k, p], parts[k, p], filled = len(low), n, counts[k, p] if n == 1 else rows
            low += [p] * n
            high += [p] * n
            of += [k] * n
        else:
            start[k, p], filled, high[-1] = len(low) - 1, filled + counts[k, p], p
    tiles = len(low)
    at_level = [[u for u in range(tiles) if of[u] == k] for k in range(levels)]
    near = [[u for k in range(max(0, of[t] - 1), min(levels, of[t] + 2)) for u in at_level[k] if max(low[t] - high[u], low[u] - high[t]) <= radius] for t in range(tiles)]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Packs the rows of each pair's side that a batch holds. A pair is named by its two tiles, the smaller first."""
        for b in batches:
            packed = np.stack([b.column(k).to_numpy() for k in range(WORDS + 1)], axis=1).astype("<i8")
            p, k = (b.column(WORDS + j).to_numpy() for j in (1, 2))
            spot = start[k, p] + (packed[:, 1].view(U) * U(0x9E3779B97F4A7C15) >> U(40)).astype(np.int64) % parts[k, p]
            order = np.argsort(spot, kind="stable")
            cuts = np.concatenate([[0], np.nonzero(np.diff(spot[order]))[0] + 1, [len(spot)]])
            pairs, sides, blobs = [], [], []
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                if e > s:
                    blob, own = packed[order[s:e]].tobytes(), int(spot[order[s]])
                    for u in near[own]:
                        pairs.append(min(own, u) * tiles + max(own, u))
                        sides.append(int(own > u))
                        blobs.append(blob)
            yield pa.RecordBatch.from_arrays([pa.array(pairs, pa.int64()), pa.array(sides, pa.int32()), pa.array(blobs, pa.binary())], names=["pair", "side", "rows"])

    def compare(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        side, blobs = table.column("side").to_pylist(), table.column("rows").to_pylist()
        x, y = (np.frombuffer(b"".join(v for v, s in zip(blobs, side, strict=True) if s == k), dtype="<i8").reshape(-1, WORDS + 1) for k in (0, 1))
        every = np.concatenate([x, y])
        fps = np.ascontiguousarray(every[:, 1:]).view(U)
        own = key[0].as_py() // tiles == key[0].as_py() % tiles
        root = candidate_roots(fps[: len(x)], None if own else fps[len(x) :], radius, first)
        at = np.nonzero(root != np.arange(len(root)))[0]
        return settled(pa.table({"a": pa.array(every[at, 0]), "b": pa.array(every[root[at], 0])}))

    return d.mapInArrow(deal, "pair long, side int, rows binary").groupBy("pair").applyInArrow(compare, "a long, b long")


def kept_subsets(hashes: np.ndarray, least: float) -> list[bytes]:
    """Digests of the set, and of it without as many shingles as a similarity of `least` to another set allows."""
    from itertools import combinations

    from xxhash import xxh3_128_digest

    n = len(hashes)
    # What it has in common with the other is n - k shingles, of at least n in both.
    most = max((k for k in range(n) if n - k >= least * n - 1e-9), default=-1)
    return [xxh3_128_digest(np.delete(hashes, list(c)).tobytes()) for k in range(most + 1) for c in combinations(range(n), k)]


def similar_roots(sets: list[np.ndarray], bags: np.ndarray, least: float, needed: np.ndarray | None = None) -> np.ndarray:
    """For each set, the smallest one that the pairs with a similarity of at least `least` lead to.

    bags: sets of different bags need not be compared. needed: rows that alone are compared with all others;
    without it, those outside the largest group of their bag are."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    ends = np.cumsum(sizes)
    root = np.arange(m)
    if not m or not ends[-1]:
        return root
    _, spot = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(spot, kind="stable")
    owners = np.repeat(np.arange(m), sizes)[order]
    starts = np.concatenate([[0], np.cumsum(np.bincount(spot))])
    _, bags = np.unique(bags, return_inverse=True)
    done = np.zeros(m, dtype=bool)
    while True:
        size = np.bincount(root, minlength=m)
        # The largest group of each bag, the first of those: the last one written wins.
        by = np.lexsort((-np.arange(m), size[root]))
        largest = np.zeros(bags.max() + 1, dtype=np.int64)
        largest[bags[by]] = root[by]
        todo = np.nonzero(~done & (root != largest[bags] if needed is None else needed))[0]
        if not len(todo):
            return root
        for i in todo[: max(1, len(todo) // 4)] if needed is None else todo:
            done[i] = True
            own = spot[ends[i] - sizes[i] : ends[i]]
            n = starts[own + 1] - starts[own]
            at = np.repeat(starts[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            common = np.bincount(owners[at], minlength=m)
            near = np.nonzero((common > 0) & (common >= least * (sizes[i] + sizes - common) - 1e-9))[0]
            roots = np.unique(root[near])
            if len(roots) > 1:
                root[np.isin(root, roots)] = roots[0]
                if needed is None:
                    break


def text_key(text: Column) -> Column:
    """128 bits of a text; a null one is empty."""
    return F.unhex(F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary")))


def row_key(id_col: str) -> Column:
    """An id as text, also where it is null."""
    return F.coalesce(F.concat(F.lit("i"), F.col(id_col).cast("string")), F.lit(""))


def similar_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, least: float = 0.8, radius: int = 64, first: int = 20, few: int = 10, cell_rows: int = 2000, cell_bytes: int = 16 << 20) -> DataFrame:
    """doc_id, text_key, component_id (smallest id of the group): one row for each row of docs."""
    id_type = docs.schema[id_col].dataType
    own = docs.select(F.col(id_col).alias("doc_id"), row_key(id_col).alias("rid"), text_key(F.col(text_col)).alias("text_key"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    longs = [T.StructField(c, T.LongType()) for c in ("size", "shingles", *(f"w{k}" for k in range(WORDS)))]
    schema = T.StructType([T.StructField("doc_id", id_type), T.StructField("rid", T.StringType()), T.StructField("text_key", T.BinaryType()), T.StructField("key", T.BinaryType()), *longs, T.StructField("subsets", T.ArrayType(T.BinaryType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                keys, sizes, counts, subsets, fps = [], [], [], [], np.zeros((b.num_rows, WORDS), dtype=U)
                for i, t in enumerate(b.column(3).cast(pa.binary())):
                    text = t.as_py()
                    s = shingle_set(text, shingle)
                    keys.append(xxh3_128_digest(s.tobytes()))
                    sizes.append(len(text))
                    counts.append(len(s))
                    subsets.append(kept_subsets(s, least) if len(s) <= few else None)
                    fps[i] = wide_fingerprint(s)
                yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), *(pa.array(np.ascontiguousarray(fps[:, k]).view(np.int64)) for k in range(WORDS)), pa.array(subsets, pa.list_(pa.binary()))], names=schema.names)
        settled(None)

    sets = durable(own.mapInArrow(run, schema))
    one = F.min(F.struct("rid", "text_key", "size")).alias("one")
    nodes = sets.groupBy("key").agg(F.min("doc_id").alias("low"), one, F.first("shingles").alias("shingles"), F.first("subsets").alias("subsets"), *(F.first(f"w{k}").alias(f"w{k}") for k in range(WORDS)))
    nodes = durable(nodes.withColumn("nid", F.monotonically_increasing_id()))
    met = nodes.select("nid", F.explode("subsets").alias("subset"))
    held = met.groupBy("subset").agg(F.min("nid").alias("b"), F.count("*").alias("n")).filter("n > 1")
    met = spread_join(met, held, "subset", "inner").filter("nid != b").select(F.col("nid").alias("a"), "b")
    near = connected_components(candidate_edges(nodes, radius, least, first).unionByName(met)).withColumnRenamed("node", "nid")
    held = nodes.select("nid", "one.*").join(near, "nid")
    per = held.groupBy("component").agg(F.count("*").alias("n"), F.sum("size").alias("b"))
    per = per.select("component", F.greatest(F.ceil(F.col("n") / cell_rows), F.ceil(F.col("b") / cell_bytes)).alias("cells"))
    held = durable(spread_join(held, per, "component", "inner"))
    texts = own.select("rid", "text_key", "text")

    def placed(rows: DataFrame) -> DataFrame:
        """rows (cell, nid, bag, needed, rid, text_key) with their texts, one row for each cell and node."""
        found = rows.join(texts.hint("merge"), ["rid", "text_key"])
        return found.groupBy("cell", "nid").agg(F.first("bag").alias("bag"), F.max("needed").alias("needed"), F.first("text").alias("text"))

    def joined(rows: DataFrame, all_needed: bool) -> DataFrame:
        def compare(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
            found = [shingle_set(t.as_py(), shingle) for t in table.column("text").cast(pa.binary())]
            root = similar_roots(found, table.column("bag").to_numpy(), least, None if all_needed else table.column("needed").to_numpy())
            nid, at = table.column("nid").to_numpy(), np.nonzero(root != np.arange(len(root)))[0]
            return settled(pa.table({"a": pa.array(nid[at]), "b": pa.array(nid[root[at]])}))

        return placed(rows).groupBy("cell").applyInArrow(compare, "a long, b long")

    # Small components share cells; a large one has cells of its own, its leaders in all of them.
    few = held.filter("cells = 1")
    total = few.agg(F.count("*").alias("n"), F.sum("size").alias("b")).first()
    shared = max(1, math.ceil(total["n"] / cell_rows), math.ceil((total["b"] or 0) / cell_bytes))
    needed = F.lit(True).alias("needed")
    small = few.select(F.pmod(F.xxhash64("component"), F.lit(shared)).alias("cell"), "nid", F.col("component").alias("bag"), needed, "rid", "text_key")
    many = held.filter("cells > 1")
    cell = lambda part: F.xxhash64(F.lit("cell"), "component", part)
    large = many.select(cell(F.pmod(F.xxhash64("nid"), F.col("cells"))).alias("cell"), "nid", F.col("component").alias("bag"), needed, "rid", "text_key")
    rank = F.row_number().over(Window.partitionBy("component").orderBy(F.xxhash64("nid"), "nid"))
    led = many.withColumn("__rank", rank).filter(F.col("__rank") <= LEADERS).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cells") - 1)))
    led = led.select(cell(F.col("part")).alias("cell"), "nid", F.col("component").alias("bag"), needed, "rid", "text_key")
    links = durable(joined(small.unionByName(large).unionByName(led), True))
    if many.limit(1).count():
        groups = connected_components(links).withColumnRenamed("node", "nid").withColumnRenamed("component", "grp")
        many = durable(many.join(groups, "nid", "left").withColumn("grp", F.coalesce("grp", "nid")))
        best = many.groupBy("component", "grp").agg(F.count("*").alias("n")).groupBy("component").agg(F.max_by("grp", F.struct("n", "grp")).alias("best"))
        many = spread_join(many, best, "component", "inner").withColumn("out", F.col("grp") != F.col("best"))
        split = many.filter("out").groupBy("component").agg(F.greatest(F.ceil(F.count("*") / cell_rows), F.ceil(F.sum("size") / cell_bytes)).alias("outs"))
        many = durable(spread_join(many, split, "component", "inner").withColumns({"part": F.pmod(F.xxhash64("nid"), F.col("cells")), "out_part": F.pmod(F.xxhash64("nid", F.lit(1)), F.col("outs"))}))
        each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
        pair = F.xxhash64(F.lit("pair"), "component", "part", "out_part").alias("cell")
        rest = many.filter("out").drop("part").withColumn("part", each("cells")).select(pair, "nid", F.col("component").alias("bag"), F.lit(True).alias("needed"), "rid", "text_key")
        met = many.drop("out_part").withColumn("out_part", each("outs")).select(pair, "nid", F.col("component").alias("bag"), F.lit(False).alias("needed"), "rid", "text_key")
        links = links.unionByName(joined(rest.unionByName(met), False))
    groups = connected_components(links).withColumnRenamed("node", "nid").withColumnRenamed("component", "grp")
    named = durable(nodes.select("nid", "key", "low").join(groups, "nid", "left").withColumn("grp", F.coalesce("grp", "nid")))
    least_id = named.groupBy("grp").agg(F.min("low").alias("component_id"))
    told = spread_join(named, least_id, "grp", "inner").select("key", "component_id")
    return spread_join(sets.select("doc_id", "text_key", "key"), told, "key", "inner").select("doc_id", "text_key", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of docs whose id is the smallest of their group.

    Rows that repeat an id stay or go by their own texts; rows with a null id go where their group has an id,
    and all stay where it has none."""
    gone = similar_texts(docs, id_col, text_col, **how).filter(F.col("component_id").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("component_id")))
    rid, key = fresh("__rid", docs), fresh("__key", docs)
    gone = gone.select(row_key("doc_id").alias(rid), F.col("text_key").alias(key)).distinct()
    return docs.join(gone, (row_key(id_col) == F.col(rid)) & (text_key(F.col(text_col)) == F.col(key)), "left_anti")
