"""Sequence packing: shortest-pack-first over the length histogram.

Documents are tokenised once, cut at every `size` tokens, and the pieces' lengths are packed as a
histogram (at most `size` bins, so it fits in the driver at any input size). Lengths are placed
longest first, each into the pack pattern that is emptiest among those it fits, and a pattern's
count is split when only some of its packs take the length. Pieces then find their slot by rank:
the n-th piece of a length takes the n-th place that the patterns offer for that length.

Ranks need no sort and no single task: each partition numbers its own pieces of each length, and
offsets add up the partitions before it, so copies of one length spread over all partitions.

Defined results: a null text is an empty one and yields only the end token; rows that repeat are
packed separately; a null id is carried through; an empty table gives an empty result; columns of
the input other than the two named are ignored, whatever their names.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from talkweave.llm.common import durable

#: The code points below this are split alike by both tokenizer libraries (tests compare all of them).
PLAIN_BELOW = 0x250


class ByteBpe:
    """Ids of a byte-level BPE file of the tokenizers library.

    Texts of Latin letters go through tiktoken with the ranks of the same file, which gives the
    same ids several times faster; all other texts go through tokenizers itself, and so do those that hold
    the content of an added token (<|endoftext|>), which stands for its own id there."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.added = [x["content"] for x in json.load(f)["added_tokens"]]
        self.fast = self._ranked(path)

    @staticmethod
    def _ranked(path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, split = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or split.get("type") != "ByteLevel" or not split.get("use_regex") or split.get("add_prefix_space") or spec.get("normalizer"):
            return None
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
        hidden = [b for b in range(256) if b not in set(shown)]
        to_byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
        special = {x["content"] for x in spec["added_tokens"]}
        ranks = {bytes(to_byte[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
        merged = [("".join(m) if isinstance(m, list) else m.replace(" ", "")) for m in model["merges"]]
        if [model["vocab"][m] for m in merged] != list(range(256, 256 + len(merged))):
            return None
        # Fixed value: the splitting pattern of byte-level BPE, as published.
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        return tiktoken.Encoding("ranked", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list = [None] * len(texts)
        rest = []
        for i, t in enumerate(texts):
            if self.fast is not None and (t.isascii() or max(t) < chr(PLAIN_BELOW)) and not any(a in t for a in self.added):
                out[i] = np.asarray(self.fast.encode_ordinary(t), dtype="<u4")
            else:
                rest.append(i)
        if rest:
            for i, e in zip(rest, self.slow.encode_batch([texts[i] for i in rest], add_special_tokens=False), strict=True):
                out[i] = np.asarray(e.ids, dtype="<u4")
        return out


def pieces(docs: DataFrame, tokenizer: str, size: int = 2048, end: int = 1, id_col: str = "doc_id", text_col: str = "text", payload: str = "ids") -> DataFrame:
    """One row for each piece of at most `size` tokens: doc_id, start, length, doc_tokens, the payload, and
    (part, nth): the n-th piece of its length in its partition. payload: "ids" for the tokens themselves,
    "crc32" for their checksum alone."""
    id_type = docs.schema[id_col].dataType
    kept = T.StructField("ids", T.ArrayType(T.IntegerType())) if payload == "ids" else T.StructField("ids_crc32", T.LongType())
    schema = T.StructType([T.StructField("doc_id", id_type), *(T.StructField(c, T.LongType()) for c in ("start", "length", "doc_tokens")), kept, T.StructField("part", T.LongType()), T.StructField("nth", T.LongType())])
    from pyspark.sql.pandas.types import to_arrow_type

    arrow_id = to_arrow_type(id_type)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, part, seen = ByteBpe(tokenizer), TaskContext.get().partitionId(), np.zeros(size + 1, dtype=np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                keys, starts, lengths, totals, held, nth = [], [], [], [], [], []
                for key, ids in zip(batch.column(0).to_pylist(), bpe.encode([t or "" for t in batch.column(1).to_pylist()]), strict=True):
                    ids = np.append(ids, np.uint32(end)).astype("<u4")
                    for s in range(0, len(ids), size):
                        own = ids[s : s + size]
                        keys.append(key)
                        starts.append(s)
                        lengths.append(len(own))
                        totals.append(len(ids))
                        held.append(own.astype(np.int32) if payload == "ids" else zlib.crc32(own.tobytes()))
                        nth.append(int(seen[len(own)]))
                        seen[len(own)] += 1
                cols = [pa.array(keys, arrow_id), *(pa.array(x, pa.int64()) for x in (starts, lengths, totals)), pa.array(held, pa.list_(pa.int32()) if payload == "ids" else pa.int64()), pa.array([part] * len(keys), pa.int64()), pa.array(nth, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(cut, schema)


def plan_packs(histogram: dict[int, int], size: int = 2048) -> np.ndarray:
    """Shortest-pack-first: rows (length, first rank, pieces, first sequence, packs, offset).

    Longest lengths first. open_[g] holds the patterns that have g free places, as (first sequence,
    packs). A length goes to the emptiest pattern that it fits, as often as it fits there, and to new
    packs after that. Every step either uses up the length or a pattern, so the steps, and with them
    the rows returned, are at most four times `size`."""
    open_: dict[int, list[tuple[int, int]]] = {}
    rows, next_seq = [], 0
    for length in sorted(histogram, reverse=True):
        left, rank = int(histogram[length]), 0
        while left:
            gap = max((g for g, x in open_.items() if x and g >= length), default=None)
            if gap is None:
                times = min(size // length, max(1, left))
                packs = -(-left // times) if left < times else max(1, left // times)
                seq, gap, next_seq = next_seq, size, next_seq + packs
            else:
                seq, packs = open_[gap].pop()
                times = gap // length
            if left >= packs * times:
                used = packs
            elif left >= times:
                used = left // times
            else:
                used, times = 1, left
            if used < packs:
                open_.setdefault(gap, []).append((seq + used, packs - used))
            rows.append((length, rank, used * times, seq, used, size - gap))
            rank, left = rank + used * times, left - used * times
            open_.setdefault(gap - length * times, []).append((seq, used))
    return np.array(rows, dtype=np.int64).reshape(-1, 6)


def pack(docs: DataFrame, tokenizer: str, size: int = 2048, end: int = 1, id_col: str = "doc_id", text_col: str = "text", payload: str = "ids") -> DataFrame:
    """Every piece with its sequence_id and its offset there (gapless from 0): doc_id, start, length, payload, doc_tokens, sequence_id, offset."""
    cut = durable(pieces(docs, tokenizer, size, end, id_col, text_col, payload))
    counts = cut.groupBy("part", "length").agg((F.max("nth") + 1).alias("n"))
    histogram = {int(r["length"]): int(r["n"]) for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `size` rows
    rows = plan_packs(histogram, size)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    ranked = cut.join(offsets, ["part", "length"]).withColumn("rank", F.col("earlier") + F.col("nth"))
    order = np.lexsort((rows[:, 1], rows[:, 0]))
    rows = rows[order]
    keys = rows[:, 0] << 44 | rows[:, 1]  # ranks stay below 2 to the 44
    head = cut.drop("part", "nth").columns
    schema = T.StructType([cut.schema[c] for c in head] + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            x = rows[np.searchsorted(keys, length << 44 | rank, side="right") - 1]
            i = rank - x[:, 1]
            seq, offset = x[:, 3] + i % x[:, 4], x[:, 5] + i // x[:, 4] * length
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in head), pa.array(seq), pa.array(offset)], names=[*head, "sequence_id", "offset"])

    if not len(rows):
        return cut.select(*head, F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return ranked.select(*head, "rank").mapInArrow(place, schema)


