"""Removal of repeated passages: every byte that a string of `span` bytes covers which also starts in
a document of smaller id. The result is exact; hashes only decide what need not be looked at.

Three passes over blocks of documents, dealt by a hash of their content:

1. Sparse suffixes. Of the substrings of `gram` bytes inside any window of `span` bytes, the one of
   least hash is that window's anchor, so equal windows have equal anchors, and about one position in
   fourteen is an anchor. Blocks send hashes of their anchors to buckets, which answer with one bit
   each: does it occur in another document as well? Windows whose anchor does not are unique.
2. Suffix order. The anchors that are left are sent, with the bytes around them that their windows
   can reach, to buckets that hold ranges of anchors. Sampled splitters bound the ranges. A bucket sorts its suffixes by multikey quicksort, eight bytes a step within runs of equal
   bytes, once rightwards and once leftwards, so that lengths of common prefixes are known on both
   sides. For each way a window can lie around its anchor, the smallest id in the window's class tells
   which suffixes have it in an earlier document. Equal anchors are always in one bucket, so that no class crosses a boundary; a block sends a context once with its smallest id,
   which keeps hot passages small: a bucket gets each at most once a block.
3. Blocks turn the answers into removed intervals and cut their texts.

Blocks find their anchors again in each pass instead of storing them; their documents are sorted
first, so the order is the same each time. Texts are shuffled once, as all passes share the exchange.

Defined results: a null text is empty; texts shorter than `span` keep all bytes; rows that repeat an
id do not remove each other's bytes; a null id counts as larger than any other, and null ids as equal;
extra columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkweave.llm.common import columns_of, fresh, record_key, settled, shuffle_partitions

U = np.uint64
NO_ID = np.iinfo(np.int64).max
#: Bytes of text that are hashed at a time.
CHUNK = 1 << 16


def gram_hashes(b: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the `gram` bytes from each position on, by doubling."""
    h = b.astype(U)
    h += U(1)
    factor, out, size = 0x9E3779B97F4A7C15, None, 1
    done = 0
    while True:
        if gram & size:
            if out is None:
                out, done = h, size
            else:  # the part found so far, then the next `size` bytes
                n = len(h) - done
                out = out[:n] * U(pow(factor, size, 2**64))
                out += h[done:]
                done += size
        if size * 2 > gram:
            break
        nxt = h[:-size] * U(pow(factor, size, 2**64))
        nxt += h[size:]
        h, size = nxt, size * 2
    out = out[: len(b) - gram + 1]
    x = out >> U(31)
    x ^= out
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(32)
    return x


def window_least(v: np.ndarray, width: int) -> np.ndarray:
    """Least of each `width` values in a row."""
    done, out = 1, v
    while done * 2 <= width:
        out = np.minimum(out[:-done], out[done:])
        done *= 2
    rest = width - done
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


class Block:
    """Documents of a block in a fixed order, and their anchors."""

    def __init__(self, table: pa.Table, span: int, gram: int):
        ids = [NO_ID if x is None else x for x in table.column("doc_id").to_pylist()]
        raw = table.column("data").to_pylist()
        self.row_ids = table.column("doc_id").to_pylist()
        self.order = sorted(range(len(ids)), key=lambda i: (ids[i], raw[i]))
        self.texts = [raw[i] for i in self.order]
        self.ids = np.array([ids[i] for i in self.order], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum([len(t) for t in self.texts])]).astype(np.int64)
        self.bytes = np.frombuffer(b"".join(self.texts), dtype=np.uint8)
        self.span, self.gram = span, gram
        self._find()

    def _find(self) -> None:
        """at: anchors, ascending; grams: their hashes; doc: their documents."""
        width, found, hashes = self.span - self.gram + 1, [], []
        place = np.arange(CHUNK * 3 + self.span, dtype=U)
        n, i, starts = len(self.starts) - 1, 0, self.starts.tolist()
        while i < n:
            j = i + 1
            while j < n and starts[j + 1] - starts[i] <= CHUNK:
                j += 1
            lo, hi = starts[i], starts[j]
            # Long documents go in overlapping pieces, each window in one.
            for s in range(lo, max(lo + 1, hi - self.span + 1), CHUNK * 2):
                e = min(hi, s + CHUNK * 2 + self.span - 1)
                if e - s < self.span:
                    continue
                h = gram_hashes(self.bytes[s:e], self.gram)
                # The position in the low bits: among equal hashes the leftmost is taken.
                v = h >> U(20)
                v <<= U(20)
                v |= place[: len(h)]
                p = window_least(v, width)
                p &= U(0xFFFFF)
                inside = np.ones(len(p), dtype=bool)
                for k in range(i + 1, j):  # no window crosses the end of a document
                    inside[max(0, starts[k] - self.span + 1 - s) : max(0, starts[k] - s)] = False
                p = p[inside].astype(np.int64)
                if len(p):  # anchors of windows in a row never go back
                    p = p[np.concatenate([[True], p[1:] != p[:-1]])]
                    found.append(p + s)
                    hashes.append(h[p])
            i = j
        at = np.concatenate(found) if found else np.zeros(0, dtype=np.int64)
        h = np.concatenate(hashes) if hashes else np.zeros(0, dtype=U)
        keep = np.concatenate([[True], at[1:] != at[:-1]]) if len(at) else np.zeros(0, dtype=bool)
        self.at, self.grams = at[keep], h[keep]
        self.doc = np.searchsorted(self.starts, self.at, side="right") - 1

    def sent_hashes(self, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bucket, 32 bits) of the block's distinct anchors in order, and for each anchor its place there. One of several
        documents of the block comes twice, and its place is that of the first."""
        key = (self.grams >> U(32)) * U(buckets) >> U(32) << U(32) | self.grams & U(0xFFFFFFFF)
        order = np.argsort(key, kind="stable")
        k, d = key[order], self.ids[self.doc[order]]
        if not len(k):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype="<u4"), np.zeros(0, dtype=np.int64)
        start = np.nonzero(np.concatenate([[True], k[1:] != k[:-1]]))[0]
        several = np.minimum.reduceat(d, start) != np.maximum.reduceat(d, start)
        times = 1 + several
        run = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(k))))
        first = np.concatenate([[0], np.cumsum(times)[:-1]])
        place = np.empty(len(k), dtype=np.int64)
        place[order] = first[run]
        sent = np.repeat(k[start], times)
        return (sent >> U(32)).astype(np.int64), (sent & U(0xFFFFFFFF)).astype("<u4"), place

    def repeated(self, answers: dict[int, bytes], buckets: int) -> np.ndarray:
        """Anchors that occur in more than one document, from each bucket's bits."""
        bucket, sent, place = self.sent_hashes(buckets)
        bits = np.zeros(len(sent), dtype=bool)
        for b, packed in answers.items():
            s, e = np.searchsorted(bucket, [b, b + 1])
            bits[s:e] = np.unpackbits(np.frombuffer(packed, dtype=np.uint8), count=e - s).astype(bool)
        return np.nonzero(bits[place])[0] if len(place) else np.zeros(0, dtype=np.int64)

    def contexts(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct contexts of the anchors: bytes (reach before, span from the anchor on), (bytes there before, after), smallest id; and each anchor's context."""
        reach = self.span - self.gram
        at, doc = self.at[anchors], self.doc[anchors]
        before = np.minimum(at - self.starts[doc], reach)
        after = np.minimum(self.starts[doc + 1] - at, self.span)
        padded = np.concatenate([np.zeros(reach, dtype=np.uint8), self.bytes, np.zeros(self.span, dtype=np.uint8)])
        ctx = np.lib.stride_tricks.sliding_window_view(padded, reach + self.span)[at] if len(at) else np.zeros((0, reach + self.span), dtype=np.uint8)
        rec = np.zeros((len(ctx), -(-(ctx.shape[1] + 2) // 8) * 8), dtype=np.uint8)
        rec[:, : ctx.shape[1]], rec[:, -2], rec[:, -1] = ctx, before, after
        ctx = rec[:, : ctx.shape[1]]
        # Only contexts at a document's ends hold bytes of others.
        ends = np.nonzero((before < reach) | (after < self.span))[0]
        cols = np.arange(reach + self.span)
        edge = ctx[ends]
        edge[(cols < (reach - before[ends])[:, None]) | (cols >= (reach + after[ends])[:, None])] = 0
        ctx[ends] = edge
        run, order, first = equal_rows(rec)
        low = np.minimum.reduceat(self.ids[doc[order]], first) if len(first) else np.zeros(0, dtype=np.int64)
        pick = order[first]
        return ctx[pick], np.stack([before[pick], after[pick]], axis=1), low, run


def equal_rows(rec: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class of each row, an order that has classes together, where classes begin in it). Rows of a class are equal
    byte for byte; equal rows are of one class unless their hash is that of another row as well."""
    words = np.ascontiguousarray(rec).view(U)
    h = np.zeros(len(rec), dtype=U)
    for c in range(words.shape[1]):
        h *= U(0x9E3779B97F4A7C15)
        h += words[:, c]
        h ^= h >> U(29)
    order = np.argsort(h, kind="stable")
    w = words[order]
    head = np.ones(len(rec), dtype=bool)
    head[1:] = (w[1:] != w[:-1]).any(1)
    run = np.empty(len(rec), dtype=np.int64)
    run[order] = np.cumsum(head) - 1
    return run, order, np.nonzero(head)[0]


def class_of(words: np.ndarray, run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Multikey quicksort: (class, order) of rows of big-endian words. Each step sorts by the next word only
    what is still in a run of equal rows. Classes are numbered in sorted order, first by the given run."""
    n = len(words)
    order = np.argsort(run, kind="stable")
    cls = np.empty(n, dtype=np.int64)
    sorted_run = run[order]
    heads = np.concatenate([[True], sorted_run[1:] != sorted_run[:-1]]) if n else np.zeros(0, dtype=bool)
    for c in range(words.shape[1]):
        number = np.cumsum(heads) - 1
        tied = np.bincount(number, minlength=1)[number] > 1 if n else np.zeros(0, dtype=bool)
        at = np.nonzero(tied)[0]
        if not len(at):
            break
        w = words[order[at], c].astype(U)
        sub = np.lexsort((w, number[at]))
        order[at] = order[at][sub]
        w, g = w[sub], number[at]
        heads[at] |= np.concatenate([[True], (w[1:] != w[:-1]) | (g[1:] != g[:-1])])
    cls[order] = np.cumsum(heads) - 1
    return cls, order


def prefix_classes(rows: np.ndarray, run: np.ndarray, lengths: range) -> list[np.ndarray]:
    """For each length, classes of the rows by (run, the first so many bytes)."""
    n = len(rows)
    wide = np.concatenate([rows, np.zeros((n, -rows.shape[1] % 8), dtype=np.uint8)], axis=1)
    _, order = class_of(np.ascontiguousarray(wide).view(">u8"), run)
    s, r = rows[order], run[order]
    same = np.zeros(n, dtype=np.int64)  # bytes in common with the row before
    if n > 1:
        differs = s[1:] != s[:-1]
        same[1:] = np.where(differs.any(1), differs.argmax(1), rows.shape[1])
        same[1:][r[1:] != r[:-1]] = -1
    out = []
    for k in lengths:
        cls = np.empty(n, dtype=np.int64)
        heads = same < k
        heads[:1] = True
        cls[order] = np.cumsum(heads) - 1
        out.append(cls)
    return out


def earlier_windows(ctx: np.ndarray, sides: np.ndarray, ids: np.ndarray, span: int, gram: int) -> np.ndarray:
    """For each context, bit o: its window that starts o bytes before the anchor also is in a context of smaller id."""
    reach, n = span - gram, len(ctx)
    bits = np.zeros(n, dtype=U)
    if n < 2:
        return bits
    # Equal contexts from several blocks: all windows of a later one are in the earliest, which alone is looked at further.
    rec = np.zeros((n, -(-(ctx.shape[1] + 2) // 8) * 8), dtype=np.uint8)
    rec[:, : ctx.shape[1]], rec[:, -2:] = ctx, sides
    same, order, first = equal_rows(rec)
    del rec
    least = np.minimum.reduceat(ids[order], first)
    one = order[first]
    own = _of_distinct(ctx[one], sides[one], least, span, gram)[same]
    bits = np.where(ids > least[same], fitting(sides, span, reach), own)
    return bits


def fitting(sides: np.ndarray, span: int, reach: int) -> np.ndarray:
    """Bits of the windows that lie inside the document."""
    high, low = np.minimum(sides[:, 0], reach).astype(U), np.maximum(0, span - sides[:, 1]).astype(U)
    ok = high >= low
    return np.where(ok, (U(1) << (high + U(1))) - (U(1) << np.minimum(low, high)), U(0))


def _of_distinct(ctx: np.ndarray, sides: np.ndarray, ids: np.ndarray, span: int, gram: int) -> np.ndarray:
    reach, n = span - gram, len(ctx)
    bits = np.zeros(n, dtype=U)
    if n < 2:
        return bits
    # Runs: equal anchors. Only those of several ids can tell anything.
    run, order = class_of(np.ascontiguousarray(ctx[:, reach : reach + gram // 8 * 8]).view(">u8"), np.zeros(n, dtype=np.int64))
    start = np.nonzero(np.concatenate([[True], run[order][1:] != run[order][:-1]]))[0]
    several = np.minimum.reduceat(ids[order], start) != np.maximum.reduceat(ids[order], start)
    pick = np.nonzero(several[run])[0]
    if not len(pick):
        return bits
    ctx, sides, low, run = ctx[pick], sides[pick], ids[pick], run[pick]
    left = prefix_classes(np.ascontiguousarray(ctx[:, :reach][:, ::-1]), run, range(reach + 1))
    right = prefix_classes(np.ascontiguousarray(ctx[:, reach + gram // 8 * 8 : ]), run, range(gram - gram // 8 * 8, span - gram // 8 * 8 + 1))
    got = np.zeros(len(pick), dtype=U)
    for o in range(reach + 1):
        fits = np.nonzero((sides[:, 0] >= o) & (sides[:, 1] >= span - o))[0]
        if len(fits) < 2:
            continue
        key = left[o][fits] << 32 | right[reach - o][fits]
        by = np.argsort(key, kind="stable")
        k = key[by]
        heads = np.concatenate([[True], k[1:] != k[:-1]])
        least = np.minimum.reduceat(low[fits][by], np.nonzero(heads)[0])[np.cumsum(heads) - 1]
        hit = fits[by[least < low[fits][by]]]
        got[hit] |= U(1 << o)
    bits[pick] = got
    return bits


def whole_characters(text: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans widened to the ends of the UTF-8 characters that they cut."""
    out: list[tuple[int, int]] = []
    for s, e in spans:
        while s > 0 and text[s] & 0xC0 == 0x80:
            s -= 1
        while e < len(text) and text[e] & 0xC0 == 0x80:
            e += 1
        out.append((max(s, out[-1][1]) if out else s, e))
    return out


def without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for se in spans for x in se), len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def removed_spans(block: Block, anchors: np.ndarray, answers: dict[int, bytes], splitters: list[bytes]) -> list[list[tuple[int, int]]]:
    """Maximal removed intervals (within each document), in the block's order of documents."""
    ctx, _, low, run = block.contexts(anchors)
    out: list[list[tuple[int, int]]] = [[] for _ in block.texts]
    if len(ctx):
        reach = block.span - block.gram
        own = bucket_of(ctx, reach, splitters, block.gram)
        bits = np.zeros(len(ctx), dtype=U)
        order, cuts = by_range(own)
        bits[order] = np.frombuffer(b"".join(answers[b] for b in own[order][cuts[:-1]].tolist()), dtype="<u4")
        at, doc = block.at[anchors], block.doc[anchors]
        mine = bits[run]
        # A later document of the block with the same context has all of its windows in the earlier one.
        copy = block.ids[doc] > low[run]
        sides = np.stack([np.minimum(at - block.starts[doc], reach), np.minimum(block.starts[doc + 1] - at, block.span)], axis=1)
        mine = np.where(copy, fitting(sides, block.span, reach), mine)
        hit = mine > 0
        # All windows of an anchor overlap, so what they cover is one interval.
        mine, at, doc = mine[hit], at[hit], doc[hit]
        most = np.frexp(mine.astype(np.float64))[1] - 1
        fewest = np.frexp((mine & (~mine + U(1))).astype(np.float64))[1] - 1
        begin = at - most
        order = np.argsort(begin, kind="stable")
        begin, end, doc = begin[order], np.maximum.accumulate((at - fewest + block.span)[order]), doc[order]
        if len(begin):
            # Runs end where the next interval starts beyond them, or in the next document.
            cut = np.nonzero((begin[1:] > end[:-1]) | (doc[1:] != doc[:-1]))[0]
            first, last = np.concatenate([[0], cut + 1]), np.append(cut, len(begin) - 1)
            base = block.starts[doc[first]]
            for d, s, e in zip(doc[first].tolist(), (begin[first] - base).tolist(), (end[last] - base).tolist(), strict=True):
                out[d].append((s, e))
    return out


def by_range(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(an order in which those of one range are together, as they were among themselves; where the ranges begin, and the end)."""
    order = np.argsort(own, kind="stable")
    begins = np.nonzero(np.diff(own[order]))[0] + 1
    return order, np.concatenate([[0], begins, [len(own)]]) if len(own) else np.zeros(1, dtype=np.int64)


def bucket_of(ctx: np.ndarray, reach: int, splitters: list[bytes], gram: int) -> np.ndarray:
    """The range that a context's whole anchor is in: by its leading eight bytes, and where those are a splitter's by all of them."""
    leads = np.array([int.from_bytes(s[:8], "big") for s in splitters], dtype=U)
    own = np.ascontiguousarray(ctx[:, reach : reach + 8]).view(">u8")[:, 0].astype(U)
    at, end = (np.searchsorted(leads, own, side=x).astype(np.int64) for x in ("left", "right"))
    for i in np.nonzero(at < end)[0].tolist():
        at[i] = bisect.bisect_right(splitters, ctx[i, reach : reach + gram].tobytes(), int(at[i]), int(end[i]))
    return at


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = 50, gram: int = 24, block_bytes: int = 5 << 20, bucket_rows: int = 1 << 20, outputs: tuple[str, ...] = ("spans", "kept"), key: Column | None = None, most_splitters: int = 1 << 18, most_partitions: int = 1 << 15) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the outputs, one row for each row of docs.

    outputs: any of spans (array of removed [start, end) byte intervals), kept (the remaining bytes), kept_text (the same
    without the rest of characters that were cut in part), kept_sha256. key: a binary that is carried through as row_key.
    most_splitters bounds the ranges, which hold more suffixes beyond it; most_partitions the tasks, which hold more blocks."""
    if span - gram + 1 > 32 or gram < 16:
        raise ValueError("gram must be at least 16, and span - gram less than 32")
    if not isinstance(docs.schema[id_col].dataType, T.IntegralType):
        raise ValueError("ids must be integers, as the smaller id keeps its bytes")
    spark = docs.sparkSession
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("data"), (F.lit(None) if key is None else key).cast("binary").alias("row_key"))
    total = d.agg(F.sum(F.octet_length("data")).alias("n")).first()["n"] or 0
    blocks = max(shuffle_partitions(spark), math.ceil(total / block_bytes))
    expected = 2 * total // (span - gram + 2)  # anchors
    buckets = max(1, math.ceil(expected / bucket_rows))
    splitters = sample_splitters(d, span, gram, total, min(max(12 * buckets, shuffle_partitions(spark)), most_splitters))
    d = d.withColumn("block", F.pmod(F.xxhash64("doc_id", "data"), F.lit(blocks)).cast("long")).repartition(min(blocks, most_partitions), "block")

    def send(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        bucket, sent, _ = Block(table, span, gram).sent_hashes(buckets)
        cuts = np.nonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))[0] if len(bucket) else np.zeros(0, dtype=np.int64)
        ends = np.append(cuts[1:], len(bucket))
        return settled(pa.table({"bucket": pa.array(bucket[cuts], pa.int64()), "block": pa.array([key[0].as_py()] * len(cuts), pa.int64()), "data": pa.array([sent[s:e].tobytes() for s, e in zip(cuts, ends, strict=True)], pa.binary())}))

    def answer(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x, dtype="<u4") for x in table.column("data").to_pylist()]
        every = np.concatenate(parts)
        order = np.argsort(every, kind="stable")
        equal = every[order][1:] == every[order][:-1]
        told = np.zeros(len(every), dtype=bool)
        told[order[1:][equal]] = told[order[:-1][equal]] = True
        ends = np.cumsum([len(p) for p in parts])
        out = [np.packbits(told[e - len(p) : e]).tobytes() for p, e in zip(parts, ends, strict=True)]
        return settled(pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "bits": pa.array(out, pa.binary())}))

    def put(key: tuple[pa.Scalar, ...], table: pa.Table, bits: pa.Table) -> pa.Table:
        block = Block(table, span, gram)
        anchors = block.repeated(dict(zip(bits.column("bucket").to_pylist(), bits.column("bits").to_pylist(), strict=True)), buckets)
        ctx, sides, low, _ = block.contexts(anchors)
        own = bucket_of(ctx, span - gram, splitters, gram)
        order, cuts = by_range(own)
        low, sides, ctx = low[order].astype("<i8"), sides[order].astype(np.uint8), ctx[order]
        blobs = [(e - s).to_bytes(8, "little") + low[s:e].tobytes() + sides[s:e].tobytes() + ctx[s:e].tobytes() for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        names = own[order][cuts[:-1]]
        return settled(pa.table({"bucket": pa.array(names, pa.int64()), "block": pa.array([key[0].as_py() if table.num_rows else 0] * len(names), pa.int64()), "data": pa.array(blobs, pa.binary())}))

    def sort(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        width, ids, sides, ctx, sizes = 2 * span - gram, [], [], [], []
        for x in table.column("data").to_pylist():
            n = int.from_bytes(x[:8], "little")
            ids.append(np.frombuffer(x, "<i8", n, 8))
            sides.append(np.frombuffer(x, np.uint8, 2 * n, 8 + 8 * n).reshape(n, 2))
            ctx.append(np.frombuffer(x, np.uint8, width * n, 8 + 10 * n).reshape(n, width))
            sizes.append(n)
        bits = earlier_windows(np.concatenate(ctx), np.concatenate(sides).astype(np.int64), np.concatenate(ids), span, gram).astype("<u4")
        ends = np.cumsum(sizes)
        return settled(pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "earlier": pa.array([bits[e - n : e].tobytes() for n, e in zip(sizes, ends, strict=True)], pa.binary())}))

    types = {"spans": pa.list_(pa.list_(pa.int64())), "kept": pa.binary(), "kept_text": pa.binary(), "kept_sha256": pa.string()}
    kinds = {"spans": T.ArrayType(T.ArrayType(T.LongType())), "kept": T.BinaryType(), "kept_text": T.BinaryType(), "kept_sha256": T.StringType()}
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("row_key", T.BinaryType()), *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")), *(T.StructField(c, kinds[c]) for c in outputs)])

    def cut(key: tuple[pa.Scalar, ...], table: pa.Table, told: pa.Table) -> pa.Table:
        block = Block(table, span, gram)
        rows = told.to_pylist()
        anchors = block.repeated({r["bucket"]: r["data"] for r in rows if r["kind"] == 0}, buckets)
        spans = removed_spans(block, anchors, {r["bucket"]: r["data"] for r in rows if r["kind"] == 1}, splitters)
        keys = table.column("row_key").to_pylist()
        kept = [without(t, own) for t, own in zip(block.texts, spans, strict=True)] if "kept" in outputs or "kept_sha256" in outputs else []
        cols = {
            "doc_id": pa.array([block.row_ids[i] for i in block.order], pa.int64()),
            "row_key": pa.array([keys[i] for i in block.order], pa.binary()),
            "n_bytes": pa.array([len(t) for t in block.texts], pa.int64()),
            "n_removed": pa.array([sum(e - s for s, e in x) for x in spans], pa.int64()),
            "n_spans": pa.array([len(x) for x in spans], pa.int64()),
        }
        made = {"spans": lambda: [[list(x) for x in own] for own in spans], "kept": lambda: kept, "kept_text": lambda: [without(t, whole_characters(t, own)) for t, own in zip(block.texts, spans, strict=True)], "kept_sha256": lambda: [hashlib.sha256(x).hexdigest() for x in kept]}
        return settled(pa.table(cols | {c: pa.array(made[c](), types[c]) for c in outputs}))

    by_block = d.groupBy("block")
    bits = by_block.applyInArrow(send, "bucket long, block long, data binary").groupBy("bucket").applyInArrow(answer, "block long, bucket long, bits binary")
    sent = by_block.cogroup(bits.groupBy("block")).applyInArrow(put, "bucket long, block long, data binary")
    earlier = sent.groupBy("bucket").applyInArrow(sort, "block long, bucket long, earlier binary")
    told = bits.select("block", F.lit(0).alias("kind"), "bucket", F.col("bits").alias("data")).union(earlier.select("block", F.lit(1).alias("kind"), "bucket", F.col("earlier").alias("data")))
    return by_block.cogroup(told.groupBy("block")).applyInArrow(cut, schema)


def sample_splitters(d: DataFrame, span: int, gram: int, total: int, buckets: int, per_bucket: int = 4, sample_bytes: int = 4 << 20) -> list[bytes]:
    """Bounds of the buckets: quantiles of a sample of anchors, each of `gram` bytes.

    They only set how evenly suffixes are dealt, never the result. About max(2**16, buckets * per_bucket) anchors reach
    the driver, twice as many at most."""
    most = max(1 << 16, buckets * per_bucket)
    sample_bytes = max(sample_bytes, most * (span - gram + 2))
    found = min(total, sample_bytes) * 2 // (span - gram + 2) + 1
    kept = min(2**32, most * 2**32 // found)

    def leads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            block = Block(pa.Table.from_batches([b]), span, gram)
            at = block.at[(block.grams & U(0xFFFFFFFF)) < U(kept)]
            if len(at):
                lead = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(block.bytes, gram)[at]).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([lead[k : k + gram] for k in range(0, len(lead), gram)], pa.binary())], names=["lead"])

    keys = d.select("doc_id", "data").sample(min(1.0, sample_bytes / max(1, total)), seed=7).mapInArrow(leads, "lead binary").limit(2 * most).toArrow()
    lead = sorted(keys.column("lead").to_pylist())
    return sorted({lead[k * len(lead) // buckets] for k in range(1, buckets)}) if lead else []


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs with the repeated bytes cut from their texts; other columns as they were.

    A character that is cut in part goes as a whole, so that texts stay valid UTF-8; all others stay, U+FFFD too. Null
    texts stay null; rows that repeat an id alone are told apart by their texts."""
    key, kept = fresh("__row", docs), fresh("__kept", docs)
    own = record_key(F.col(id_col), F.col(text_col))
    cut = repeated_passages(docs, id_col, text_col, outputs=("kept_text",), key=own, **how).filter("n_removed > 0")
    cut = cut.groupBy(F.col("row_key").alias(key)).agg(F.first("kept_text").cast("string").alias(kept))
    d = docs.withColumn(key, own).join(cut.hint("merge"), key, "left")
    return d.withColumn(text_col, F.coalesce(F.col(kept), F.col(text_col))).select(*columns_of(docs))
