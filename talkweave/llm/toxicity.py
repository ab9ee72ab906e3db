"""Toxicity by class-conditional Kneser-Ney models over characters.

Texts are read as bytes of UTF-8, ASCII letters in lower case and all white space as one character. Two
models of order ORDER, one of toxic and one of ordinary text, are counted from a bounded sample of labelled
rows. Both back off to the same lower orders, which come from all documents: the distinct grams of the
whole corpus are a distributed table that grows with it, and each lower order counts by how many bytes its
grams are preceded (continuation counts). A rare expression thus gets the probability that the corpus gives
it in both models, and only what is more common in one class tells the classes apart.

The table is dealt by the three bytes before the last one, so that continuation counts down to order four
with their totals are sums inside one shard; the shards look up only what the class models need, and add up
the three-grams in 64 groups. The driver gets two numbers for each lower gram of the sample, and the
three-grams with their counts.

A text's main feature is the difference of its log-likelihoods under the two models, divided by its
length; as an insult is a small part of a long text, the shares of its words with a high difference
are features too. A logistic regression turns them into a score. It is fitted on all sampled rows,
each measured by models counted from the other folds (cross-fitting); the final models count all.

Where a class model has not seen a byte's context, it is the shared model; so the difference is zero where
neither has, and what is sent to the executors is a table of the sample's grams alone.

Defined results: null and empty texts score by the prior alone; without labelled rows of both
classes every score is one half; rows that repeat get equal scores; a null id is scored and is held
out; extra columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkweave.llm.common import columns_of, durable, settled, shuffle_partitions
from talkweave.llm.labelled import bounded_sample

U = np.uint64
#: Four told labels apart best where few rows are labelled (of four to six, on tables of 0.1 GB and less).
ORDER = 4
FEATURES = 6
SPACE = 32
#: Bytes as the models see them.
FOLD = np.array([b + 32 if 65 <= b < 91 else SPACE if b in (9, 10, 11, 12, 13) else b for b in range(256)], dtype=np.uint8)
DISCOUNT = 0.75
#: Occurrences in a context that a class model grants to the shared model beside the discounts.
PRIOR = 1.0


def read(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, each behind ORDER - 1 spaces; where each text's bytes start, with the end)."""
    lead = b" " * (ORDER - 1)
    joined = np.frombuffer(lead.join([b"", *texts]), dtype=np.uint8)
    sizes = np.array([len(t) + len(lead) for t in texts], dtype=np.int64)
    return FOLD[joined], np.concatenate([[0], np.cumsum(sizes)])


def own_grams(symbols: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Grams of ORDER bytes that end at a text's own bytes, as numbers, and the texts they belong to."""
    if len(symbols) < ORDER:
        return np.zeros(0, dtype=U), np.zeros(0, dtype=np.int64)
    g = symbols[: len(symbols) - ORDER + 1].astype(U)
    for k in range(1, ORDER):
        g <<= U(8)
        g |= symbols[k : len(symbols) - ORDER + 1 + k]
    own = np.ones(len(symbols), dtype=bool)
    for k in range(ORDER - 1):
        own[starts[:-1] + k] = False
    doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    return g[own[ORDER - 1 :]], doc[own]


def batches_of(b: pa.RecordBatch, column: int, most: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts) of parts of a batch with about so many bytes."""
    texts, at, size = [], 0, 0
    for i, x in enumerate(b.column(column)):
        texts.append(x.as_py() or b"")
        size += len(texts[-1])
        if size >= most:
            yield at, texts
            texts, at, size = [], i + 1, 0
    if texts:
        yield at, texts


def last(k: int) -> np.uint64:
    """The bits of a gram's last k bytes."""
    return U(2 ** (8 * k) - 1)


def mixed(keys: np.ndarray) -> np.ndarray:
    h = keys * U(0x9E3779B97F4A7C15)
    h ^= h >> U(29)
    h *= U(0xBF58476D1CE4E5B9)
    h ^= h >> U(32)
    return h


def shard_of(grams: np.ndarray, shards: int) -> np.ndarray:
    """By the three bytes before the last one."""
    return (mixed(grams >> U(8) & U(0xFFFFFF)) % U(shards)).astype(np.int64)


def spread(grams: np.ndarray, shards: int) -> pa.RecordBatch:
    """(shard, grams) rows of sorted grams."""
    shard = shard_of(grams, shards)
    order = np.argsort(shard, kind="stable")
    shard, grams = shard[order], grams[order]
    cuts = np.concatenate([[0], np.nonzero(np.diff(shard))[0] + 1, [len(shard)]])
    return pa.RecordBatch.from_arrays([pa.array(shard[cuts[:-1]], pa.int64()), pa.array([grams[s:e].tobytes() for s, e in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())], names=["shard", "grams"])


def distinct_grams(docs: DataFrame, shards: int, text_col: str = "text", most: int = 3 << 20) -> DataFrame:
    """(shard, grams): the grams of all documents, distinct within each row; a part of a partition gives one row for each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            for _, texts in batches_of(b, 0):
                held.append(np.unique(own_grams(*read(texts))[0]))
                n += len(held[-1])
                if n > most:
                    held = [np.unique(np.concatenate(held))]
                    n = len(held[0])
                    if 2 * n > most:
                        yield spread(held[0], shards)
                        held, n = [], 0
        if n:
            yield spread(np.unique(np.concatenate(held)), shards)
        settled(None)

    return docs.select(_data(text_col)).mapInArrow(run, "shard long, grams binary")


def interpolated(types: np.ndarray, n: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For wanted grams (a, b): their probability is a + b * that of the next lower order. types: sorted grams, n: their counts."""
    context, at = np.unique(types >> U(8), return_inverse=True)
    if not len(types):
        return np.zeros(len(wanted)), np.ones(len(wanted))
    total, kinds = np.bincount(at, weights=n), np.bincount(at)
    spot = np.minimum(np.searchsorted(types, wanted), len(types) - 1)
    own = np.where(types[spot] == wanted, n[spot], 0)
    c = np.minimum(np.searchsorted(context, wanted >> U(8)), len(context) - 1)
    known = context[c] == wanted >> U(8)
    return np.where(known, np.maximum(own - DISCOUNT, 0) / total[c], 0), np.where(known, DISCOUNT * kinds[c] / total[c], 1)


def lower_orders(three: np.ndarray, n3: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """p(last byte | two before) of wanted three-grams, from all three-grams (sorted) and by how many bytes each is preceded."""
    two, n2 = np.unique(three & last(2), return_counts=True)
    one, n1 = np.unique(two & last(1), return_counts=True)
    p = np.full(len(wanted), 1 / 256)
    for k, types, n in ((1, one, n1), (2, two, n2), (3, three, n3)):
        a, b = interpolated(types, n, wanted & last(k))
        p = a + b * p
    return p


def shared_backoff(docs: DataFrame, wanted: np.ndarray, text_col: str = "text") -> np.ndarray:
    """p(last byte | those before) of wanted grams of ORDER - 1 bytes (sorted, distinct) by continuation counts in all documents."""
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("binary")).cast("long")).alias("n")).first()["n"] or 0
    shards, groups = min(4096, max(shuffle_partitions(spark), math.ceil(total / (64 << 20)))), 64

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, shard, held = np.zeros(0, dtype=U), 0, 0
        parts: list[np.ndarray] = []
        for b in batches:
            shard = b.column("shard")[0].as_py()
            parts += [np.frombuffer(x.as_py(), dtype=U) for x in b.column("grams")]
            held = sum(map(len, parts))
            if held > 1 << 21:
                grams, parts = np.unique(np.concatenate([grams, *parts])), []
        grams = np.unique(np.concatenate([grams, *parts]))
        own = wanted[shard_of(wanted, shards) == shard]
        x, y, types = np.zeros(len(own)), np.ones(len(own)), grams
        for k in range(ORDER - 1, 3, -1):
            types, n = np.unique(types & last(k), return_counts=True)
            a, b = interpolated(types, n, own & last(k))
            x, y = x + y * a, y * b
        three, n3 = np.unique(types & last(3), return_counts=True)
        group = (three >> U(16)).astype(np.int64) % groups
        rows = [(-1, own, x, y)] + [(g, three[group == g], n3[group == g].astype(np.float64), np.zeros(0)) for g in np.unique(group).tolist()]
        columns = [pa.array([r[0] for r in rows], pa.int64()), *(pa.array([np.ascontiguousarray(r[k]).tobytes() for r in rows], pa.binary()) for k in (1, 2, 3))]
        yield settled(pa.RecordBatch.from_arrays(columns, names=["part", "grams", "x", "y"]))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A group has the three-grams of few first bytes, so that their counts are a table of 2**18.
        n, part = np.zeros((256 // groups) << 16), 0
        for b in batches:
            part = b.column("part")[0].as_py()
            for k, x in zip(b.column("grams"), b.column("x"), strict=True):
                own = np.frombuffer(k.as_py(), dtype=U).astype(np.int64)
                n[(own >> 16) // groups << 16 | own & 0xFFFF] += np.frombuffer(x.as_py(), dtype=np.float64)
        at = np.nonzero(n)[0]
        three = (((at >> 16) * groups + part) << 16 | at & 0xFFFF).astype(U)
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in (three, n[at], np.zeros(0)))], names=["part", "grams", "x", "y"])

    kind = "part long, grams binary, x binary, y binary"
    found = durable(distinct_grams(docs, shards, text_col).groupBy("shard").applyInArrow(look_up, kind))
    rows = found.filter("part < 0").unionByName(found.filter("part >= 0").groupBy("part").applyInArrow(add, kind)).collect()
    cols = lambda own, k, t: np.concatenate([np.zeros(0, dtype=t), *(np.frombuffer(bytes(r[k]), dtype=t) for r in rows if (r["part"] < 0) == own)])
    three, n3 = cols(False, "grams", U), cols(False, "x", np.float64)
    order = np.argsort(three)
    low = lower_orders(three[order], n3[order], wanted & last(3))
    told, x, y = cols(True, "grams", U), cols(True, "x", np.float64), cols(True, "y", np.float64)
    at = np.searchsorted(wanted, told)
    a, b = np.zeros(len(wanted)), np.ones(len(wanted))
    a[at], b[at] = x, y
    return a + b * low


def class_counts(sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(grams, ascending, counts in each class) of the sampled rows (data, label), which are bounded."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[], []]
        for b in batches:
            labels = b.column(1).to_pylist()
            for at, texts in batches_of(b, 0):
                for c in (0, 1):
                    own = [t for t, x in zip(texts, labels[at : at + len(texts)], strict=True) if x == c]
                    if own:
                        held[c].append(own_grams(*read(own))[0])
        for c in (0, 1):
            if held[c]:
                keys, n = np.unique(np.concatenate(held[c]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([c], pa.int64()), pa.array([keys.tobytes()], pa.binary()), pa.array([n.astype("<i8").tobytes()], pa.binary())], names=["label", "grams", "counts"])

    rows = sample.select("data", "label").mapInArrow(count, "label long, grams binary, counts binary").collect()
    keys = np.concatenate([np.zeros(0, dtype=U), *(np.frombuffer(bytes(r["grams"]), dtype=U) for r in rows)])
    n = np.concatenate([np.zeros(0, dtype="<i8"), *(np.frombuffer(bytes(r["counts"]), dtype="<i8") for r in rows)])
    label = np.repeat([r["label"] for r in rows], [len(r["grams"]) // 8 for r in rows])
    grams, at = np.unique(keys, return_inverse=True)
    return grams, np.stack([np.bincount(at, weights=n * (label == c), minlength=len(grams)) for c in (0, 1)], axis=1)


def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The counts of several samples as those of one."""
    grams, at = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
    counts = np.concatenate([c for _, c in parts])
    return grams, np.stack([np.bincount(at, weights=counts[:, k], minlength=len(grams)) for k in (0, 1)], axis=1)


class Lookup:
    """Half-precision numbers by key: a table with a free place beside every taken one, and 32 bits of each key's hash to tell it by."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        size = 1 << max(4, (4 * len(keys)).bit_length() - 1)
        self.mask = U(size - 1)
        self.check, self.value = np.zeros(size, dtype=np.uint32), np.zeros(size, dtype=np.float16)
        slot, check = self._place(keys)
        left = np.arange(len(keys))
        while len(left):
            free = self.check[slot[left]] == 0
            place, first = np.unique(slot[left[free]], return_index=True)
            won = left[free][first]
            self.check[place], self.value[place] = check[won], values[won]
            done = np.zeros(len(keys), dtype=bool)
            done[won] = True
            left = left[~done[left]]
            taken = self.check[slot[left]] != 0
            slot[left[taken]] = (slot[left[taken]] + 1) & int(self.mask)

    def _place(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = mixed(keys)
        return (h & self.mask).astype(np.int64), (h >> U(32)).astype(np.uint32) | np.uint32(1)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values, zero where there is none; whether there is one)."""
        slot, check = self._place(keys)
        out, found = np.zeros(len(keys), dtype=np.float32), np.zeros(len(keys), dtype=bool)
        c = self.check[slot]
        hit = c == check
        out[hit], found[hit] = self.value[slot[hit]], True
        at = np.nonzero(~hit & (c != 0))[0]
        while len(at):
            slot[at] = (slot[at] + 1) & int(self.mask)
            c = self.check[slot[at]]
            hit = c == check[at]
            out[at[hit]], found[at[hit]] = self.value[slot[at[hit]]], True
            at = at[~hit & (c != 0)]
        return out, found


class Difference:
    """Log-likelihood difference (toxic less ordinary) of every byte after ORDER - 1 others. shared: the backoff's p of each gram without its first byte."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray, shared: np.ndarray):
        context, at = np.unique(grams >> U(8), return_inverse=True)
        seen, unseen = [], []
        for c in (0, 1):
            n = counts[:, c]
            total, kinds = np.bincount(at, weights=n, minlength=len(context)), np.bincount(at, weights=n > 0, minlength=len(context))
            back = (DISCOUNT * kinds + PRIOR) / (total + PRIOR)
            p = np.maximum(n - DISCOUNT, 0) / (total + PRIOR)[at] + back[at] * shared
            seen.append(np.log(np.maximum(p, 1e-12)))
            unseen.append(np.log(back))
        self.seen, self.unseen = Lookup(grams, seen[1] - seen[0]), Lookup(context, unseen[1] - unseen[0])

    def of(self, grams: np.ndarray) -> np.ndarray:
        d, found = self.seen.find(grams)
        rest = np.nonzero(~found)[0]
        d[rest] = self.unseen.find(grams[rest] >> U(8))[0]
        return d

    def features(self, texts: list[bytes]) -> np.ndarray:
        """For each text: mean difference of a byte, shares of words above 2, 4 and 6, the highest word, length (logarithm)."""
        g, doc = own_grams(*read(texts))
        out = np.zeros((len(texts), FEATURES))
        if not len(g):
            return out
        d = self.of(g)
        size = np.bincount(doc, minlength=len(texts))
        out[:, 0] = np.bincount(doc, weights=d, minlength=len(texts)) / np.maximum(size, 1)
        # A word starts at a byte that is no space after one that is, or at the text's start.
        now, before = g & U(0xFF), g >> U(8) & U(0xFF)
        head = np.concatenate([[True], doc[1:] != doc[:-1]]) | ((now != SPACE) & (before == SPACE))
        at = np.nonzero(head)[0]
        word, of = np.add.reduceat(d, at), doc[at]
        n = np.maximum(np.bincount(of, minlength=len(texts)), 1)
        for k, least in enumerate((2, 4, 6)):
            out[:, 1 + k] = np.bincount(of[word > least], minlength=len(texts)) / n
        most = np.full(len(texts), -20.0)
        np.maximum.at(most, of, np.clip(word, -20, 20))
        out[:, 4] = np.where(size > 0, most, 0)
        out[:, 5] = np.log1p(size)
        return out


def shaped(f: np.ndarray) -> np.ndarray:
    """Features on a scale where a straight line separates: shares by their square roots."""
    s = np.sqrt(f[:, 1:4])
    return np.concatenate([np.clip(f[:, :1] * 20, -10, 10), s * 5, f[:, 4:5] / 5, f[:, 5:6] / 8, s * f[:, 5:6]], axis=1)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 60) -> np.ndarray:
    """Weights (last: intercept) by Newton's method, classes as frequent as they are."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w = np.zeros(x.shape[1])
    keep = np.full(len(w), ridge * len(x))
    keep[-1] = 1e-9
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(keep), x.T @ (y - p) - keep * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, usable: Column, label_col: str = "toxic", rows_per_class: int = 4000, bytes_per_class: int = 16 << 20, folds: int = 5, id_col: str = "doc_id", text_col: str = "text") -> Callable[[list[bytes]], np.ndarray]:
    """A function from texts to scores. The sampled rows, bounded by rows_per_class and bytes_per_class, all count into the models and, fold by fold, fit the regression."""
    spark = docs.sparkSession
    sample = bounded_sample(docs, labels, label_col, usable, rows_per_class, bytes_per_class, folds, id_col, text_col)
    sample = durable(sample.repartition(min(16, shuffle_partitions(spark))))
    parts = [class_counts(sample.filter(F.col("fold") == k)) for k in range(folds)]
    grams, counts = summed(parts)
    if not len(grams) or not counts.sum(0).all():
        return lambda texts: np.full(len(texts), 0.5)
    lower = np.unique(grams & last(ORDER - 1))
    low = shared_backoff(docs, lower, text_col)
    shared = lambda own: low[np.searchsorted(lower, own & last(ORDER - 1))]

    def measured(model: Difference, rows: DataFrame) -> list:
        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                labels_ = b.column(1).to_pylist()
                for at, texts in batches_of(b, 0):
                    f = model.features(texts)
                    yield pa.RecordBatch.from_arrays([pa.array(labels_[at : at + len(texts)], pa.int64()), pa.array(list(f), pa.list_(pa.float64()))], names=["label", "f"])

        return rows.select("data", "label").mapInArrow(measure, "label long, f array<double>").collect()

    rows = []
    for k in range(folds):
        own, n = summed([p for i, p in enumerate(parts) if i != k])
        rows += measured(Difference(own, n, shared(own)), sample.filter(F.col("fold") == k))
    model = Difference(grams, counts, shared(grams))
    y = np.array([r["label"] for r in rows], dtype=np.float64)
    x = np.array([r["f"] for r in rows], dtype=np.float64).reshape(-1, FEATURES)
    order = np.lexsort((*x.T, y))  # rows come in any order; sums should not
    weights = logistic(shaped(x[order]), y[order])

    def score(texts: list[bytes]) -> np.ndarray:
        z = shaped(model.features(texts)) @ weights[:-1] + weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    return score


def _scored(d: DataFrame, scorer: Callable[[list[bytes]], np.ndarray], threshold: float) -> DataFrame:
    """d without its last column, data, but with score and predicted."""
    schema = T.StructType([*d.schema[:-1], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, texts in batches_of(b, b.num_columns - 1):
                s = scorer(texts)
                part = b.slice(at, len(texts))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], names=names)
        settled(None)

    return d.mapInArrow(run, schema)


def _data(text_col: str) -> Column:
    return F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("data")


def score(docs: DataFrame, scorer: Callable[[list[bytes]], np.ndarray], threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text", held_out: Column | None = None) -> DataFrame:
    """doc_id, held_out if it is given, score, predicted: one row for each row of docs."""
    extra = [] if held_out is None else [held_out.alias("held_out")]
    return _scored(docs.select(F.col(id_col).alias("doc_id"), *extra, _data(text_col)), scorer, threshold)


def harmless(docs: DataFrame, scorer: Callable[[list[bytes]], np.ndarray], threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of docs that are not predicted toxic, with their columns as they were, whatever their names."""
    named = [c.alias(f"c{k}") for k, c in enumerate(columns_of(docs))]
    left = _scored(docs.select(*named, _data(text_col)), scorer, threshold).filter("predicted = 0")
    return left.select(*(F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns)))
