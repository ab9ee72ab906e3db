"""Quality by attention-based multiple-instance learning.

A document is a bag of passages of `passage` words. Every passage is encoded from counts that say
how it is written (kinds of characters, word lengths, repetition, line structure, the words' hashes)
by one learned layer; gated attention (Ilse et al., 2018) gives each passage a weight,
softmax(w . (tanh(V h) * sigmoid(U h))), and the document's score comes from the weighted mean of
its passages. Encoder, attention and output are learned together from document labels alone, by Adam
on a bounded sample of labelled rows; the classes count alike. Every passage of every text is scored.

The fit is a few thousand small numbers, learned in the driver from the whole bags of labelled rows, at most
rows_per_class and bytes_per_class of text a class. A passage of 40 words is 50 numbers, so that these are
about 0.8 times the sample's bytes, and 2.5 times where a text's words are single letters.

Defined results: a null or empty text is one passage without words; without labelled rows of both
classes every score is one half; rows that repeat get equal scores; a null id is scored and is held
out; extra columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from talkweave.llm.labelled import bounded_sample
from talkweave.llm.toxicity import batches_of

PASSAGE = 40
HASHED = 32
SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
#: Kinds of bytes that are counted in each passage.
KINDS = {
    "lower": [*range(97, 123)],
    "upper": [*range(65, 91)],
    "digit": [*range(48, 58)],
    "other letters": [*range(128, 256)],
    "comma or full stop": [44, 46],
    "loud": [33, 63],
    "symbol": [ord(c) for c in "#*$%&|<>"],
    "bracket": [ord(c) for c in "()[]{}/\\@_=+~^"],
    "quote": [ord(c) for c in "\"'`-:;"],
}
TABLE = np.zeros((256, len(KINDS)), dtype=np.float32)
for _k, _bytes in enumerate(KINDS.values()):
    TABLE[_bytes, _k] = 1
WIDTH = len(KINDS) + 9 + HASHED


def passages(texts: list[bytes], size: int = PASSAGE) -> tuple[np.ndarray, np.ndarray]:
    """(a row of WIDTH numbers for each passage, the text it belongs to); every text has one passage at least."""
    n = len(texts)
    raw = np.frombuffer(b"\n".join([*texts, b""]), dtype=np.uint8)
    starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)
    space = SPACE[raw]
    head = ~space & np.concatenate([[True], space[:-1]])
    at = np.nonzero(head)[0]  # word starts
    ends = np.nonzero(space & np.concatenate([[False], ~space[:-1]]))[0]
    doc = np.searchsorted(starts, at, side="right") - 1
    words = np.bincount(doc, minlength=n)
    first = np.concatenate([[0], np.cumsum(words)[:-1]])
    count = np.maximum(1, -(-words // size))
    base = np.concatenate([[0], np.cumsum(count)])
    bag = np.repeat(np.arange(n), count)
    x = np.zeros((int(base[-1]), WIDTH), dtype=np.float32)
    if not len(at):
        return x, bag
    # Words of a document are shared out evenly, so that no passage is a remnant.
    own = base[doc] + (np.arange(len(at)) - first[doc]) * count[doc] // np.maximum(words[doc], 1)
    m = len(x)
    length = (ends - at).astype(np.float64)
    k = np.bincount(own, minlength=m)
    k1 = np.maximum(k, 1)
    chars = np.maximum(np.bincount(own, weights=length, minlength=m), 1)
    where = np.zeros(len(raw), dtype=np.int64)
    letters = np.nonzero(~space)[0]
    word_of = np.cumsum(head)[letters] - 1
    where = own[word_of]
    kinds = TABLE[raw[letters]]
    for c in range(len(KINDS)):
        x[:, c] = np.bincount(where, weights=kinds[:, c], minlength=m) / chars
    c = len(KINDS)
    x[:, c] = np.where(k > 0, chars / k1 / 10, 0)
    x[:, c + 1] = np.sqrt(np.maximum(np.bincount(own, weights=length**2, minlength=m) / k1 - (chars / k1) ** 2, 0)) / 5 * (k > 0)
    spread = np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
    place = (letters - at[word_of]) % 64
    step = np.random.default_rng(12).integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
    h = np.add.reduceat(spread[raw[letters]] * step[place], np.concatenate([[0], np.nonzero(np.diff(word_of))[0] + 1]))
    h = h ^ h >> np.uint64(31)
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    again = np.concatenate([[False], (h[1:] == h[:-1]) & (own[1:] == own[:-1])])
    order = np.lexsort((h, own))
    new = np.concatenate([[True], (h[order][1:] != h[order][:-1]) | (own[order][1:] != own[order][:-1])])
    x[:, c + 2] = np.bincount(own[order], weights=new, minlength=m) / k1
    x[:, c + 3] = np.bincount(own, weights=again, minlength=m) / k1
    x[:, c + 4] = np.bincount(own, weights=length == 1, minlength=m) / k1
    initial = raw[at]
    x[:, c + 5] = np.bincount(own, weights=(initial >= 65) & (initial < 91), minlength=m) / k1
    last = raw[ends - 1]
    x[:, c + 6] = np.bincount(own, weights=(last == 46) | (last == 33) | (last == 63), minlength=m) / k1
    broken = raw[ends] == 10  # a text ends with a line
    x[:, c + 7] = np.bincount(own, weights=broken, minlength=m) / k1
    x[:, c + 8] = k / size
    cell = own * HASHED + (h % np.uint64(HASHED)).astype(np.int64)
    x[:, c + 9 :] = np.bincount(cell, minlength=m * HASHED).reshape(m, HASHED) / k1[:, None]
    return x, bag


class Attention:
    """Encoder, gated attention and output as one dictionary of arrays."""

    def __init__(self, width: int = WIDTH, hidden: int = 24, gate: int = 12, seed: int = 5):
        g = np.random.default_rng(seed)
        draw = lambda a, b: g.normal(0, 1 / np.sqrt(a), (a, b))
        self.p = {"E": draw(width, hidden), "e": np.zeros(hidden), "V": draw(hidden, gate), "U": draw(hidden, gate), "w": draw(gate, 1)[:, 0], "c": draw(hidden, 1)[:, 0], "b": np.zeros(1)}
        self.mean, self.scale = np.zeros(width), np.ones(width)

    def forward(self, x: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
        """starts: first passage of each bag, ascending; no bag is empty."""
        p, n = self.p, np.diff(np.append(starts, len(x)))
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        h = np.tanh(z @ p["E"] + p["e"])
        v, u = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        s = (v * u) @ p["w"]
        s = np.exp(s - np.repeat(np.maximum.reduceat(s, starts), n))
        a = s / np.repeat(np.add.reduceat(s, starts), n)
        m = np.add.reduceat(a[:, None] * h, starts)
        y = 1 / (1 + np.exp(-np.clip(m @ p["c"] + p["b"], -30, 30)))
        return {"z": z, "h": h, "v": v, "u": u, "a": a, "m": m, "y": y, "n": n}

    def gradients(self, x: np.ndarray, starts: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        p, f = self.p, self.forward(x, starts)
        loss = -(weights * (labels * np.log(f["y"] + 1e-12) + (1 - labels) * np.log(1 - f["y"] + 1e-12))).sum()
        d = weights * (f["y"] - labels)
        dm = np.repeat(d[:, None] * p["c"], f["n"], axis=0)
        da = (dm * f["h"]).sum(1)
        ds = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, starts), f["n"]))
        gate = ds[:, None] * p["w"]
        dv, du = gate * f["u"] * (1 - f["v"] ** 2), gate * f["v"] * f["u"] * (1 - f["u"])
        dh = (f["a"][:, None] * dm + dv @ p["V"].T + du @ p["U"].T) * (1 - f["h"] ** 2)
        return loss, {"E": f["z"].T @ dh, "e": dh.sum(0), "V": f["h"].T @ dv, "U": f["h"].T @ du, "w": (f["v"] * f["u"]).T @ ds, "c": f["m"].T @ d, "b": np.array([d.sum()])}

    def train(self, bags: list[np.ndarray], labels: np.ndarray, epochs: int = 30, batch: int = 64, rate: float = 4e-3, decay: float = 1e-4, seed: int = 3) -> None:
        every = np.concatenate(bags)
        self.mean, self.scale = every.mean(0), every.std(0) + 1e-3
        share = labels.mean()
        weights = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
        g, t = np.random.default_rng(seed), 0
        first, second = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        for epoch in range(epochs):
            now = rate * 0.5 * (1 + np.cos(np.pi * epoch / epochs))
            order = g.permutation(len(bags))
            for at in range(0, len(order), batch):
                pick = order[at : at + batch]
                starts = np.concatenate([[0], np.cumsum([len(bags[i]) for i in pick])[:-1]]).astype(np.int64)
                _, grad = self.gradients(np.concatenate([bags[i] for i in pick]), starts, labels[pick], weights[pick] / len(pick))
                t += 1
                for k, v in grad.items():
                    first[k] = 0.9 * first[k] + 0.1 * v
                    second[k] = 0.999 * second[k] + 0.001 * v * v
                    self.p[k] = self.p[k] - now * (first[k] / (1 - 0.9**t) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8) + decay * self.p[k])

    def score(self, texts: list[bytes]) -> np.ndarray:
        x, bag = passages(texts)
        return self.forward(x.astype(np.float64), np.searchsorted(bag, np.arange(len(texts))))["y"]


def fit(docs: DataFrame, labels: DataFrame, usable: Column, label_col: str = "quality", rows_per_class: int = 1500, bytes_per_class: int = 6 << 20, id_col: str = "doc_id", text_col: str = "text") -> Callable[[list[bytes]], np.ndarray]:
    """A function from texts to scores, learned from all passages of the sampled rows."""
    sample = bounded_sample(docs, labels, label_col, usable, rows_per_class, bytes_per_class, 1, id_col, text_col)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, ys = b.column(0).to_pylist(), b.column(2).to_pylist()
            for at, texts in batches_of(b, 1):
                x, own = passages(texts)
                starts = np.searchsorted(own, np.arange(len(texts) + 1))
                rows = [x[s:e].astype("<f4").tobytes() for s, e in zip(starts[:-1], starts[1:], strict=True)]
                part = slice(at, at + len(texts))
                yield pa.RecordBatch.from_arrays([pa.array([str(i) for i in ids[part]]), pa.array(ys[part], pa.int64()), pa.array(rows, pa.binary())], names=["id", "label", "bag"])

    rows = sample.mapInArrow(encode, "id string, label long, bag binary").collect()
    rows = sorted((r["id"], r["label"], bytes(r["bag"])) for r in rows)
    y = np.array([r[1] for r in rows], dtype=np.float64)
    if not 0 < y.sum() < len(y):
        return lambda texts: np.full(len(texts), 0.5)
    model = Attention()
    model.train([np.frombuffer(r[2], "<f4").reshape(-1, WIDTH).astype(np.float64) for r in rows], y)
    return model.score
