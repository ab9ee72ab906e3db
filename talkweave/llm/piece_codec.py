"""Encoding and decoding with merge-type (BPE) SentencePiece vocabularies.

The encoder works as the published algorithm does: the text's characters are symbols, an agenda
holds the adjacent pairs whose concatenation is a piece, and the pair with the best score (leftmost
among equals) is merged until the agenda is empty. What is left outside the vocabulary falls back
to byte pieces. Where no piece holds a space mark after another character, no merge crosses the
front of a word, so words are encoded on their own and remembered. Short words that are new to a
batch share one agenda, a matrix with a row of scored pairs for each word, and each step merges the
best pair of every row; long runs without spaces have a heap of their own.

In every Arrow batch the sentencepiece library encodes and decodes the words that are new to the
worker (or, with check="documents", all texts), and `agrees` says whether ids and text are the same;
the ids returned are the agenda's.

Defined results: a null text is an empty one, which has no ids; a null id is carried through; rows
that repeat are each encoded; other columns are ignored, whatever their names; an empty table gives
an empty result. Long texts are encoded whole; the memory of words is bounded by `remembered`.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MARK = "▁"
NONE = 2**40
#: Words of up to so many characters advance in step with others.
WIDTHS = (6, 9, 13, 20, 40)


class Vocabulary:
    """Pieces of a model file, read through the library's accessors."""

    def __init__(self, path: str):
        import sentencepiece as spm

        self.library = sp = spm.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.text = [sp.id_to_piece(i) for i in range(n)]
        odd = [sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in range(n)]
        self.ids = {p: i for i, p in enumerate(self.text) if not odd[i]}
        self.score = {p: sp.get_score(i) for p, i in self.ids.items()}
        self._pairs = self._of_char = self._ids_of = None
        self.byte = {int(self.text[i][1:-1], 16): i for i in range(n) if sp.is_byte(i)}
        self.raw = {i: b for b, i in self.byte.items()}
        self.by_word = not any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ids)
        # The model must leave the text as it is, but for the space mark and one in front.
        if sp.encode("  a  b ", out_type=str)[0][:1] != MARK or sp.decode(sp.encode("  a  b ")) != "  a  b ":
            raise ValueError("only models that keep spaces and add one in front are supported")
        if any(sp.is_unused(i) for i in range(n)) or len(self.byte) != 256:
            raise ValueError("only models with byte pieces and without unused pieces are supported")

    def splitter(self):
        """Cuts a marked text where no merge can cross, as no piece holds the two characters side by side."""
        if not self.by_word:
            return lambda s: [s] if s else []
        inside = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        letters = "".join(map(chr, [*range(65, 91), *range(97, 123), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)]))
        ends = "".join(c for c in ".,;:!?" if not any(a + c in inside for a in letters))
        alone = "".join(c for c in "\n\t\r" if not any(c in x for x in inside))
        parts = [f"[{re.escape(alone)}]"] * bool(alone) + [f"{MARK}*[{letters}]+(?=[{re.escape(ends)}])"] * bool(ends)
        return re.compile("|".join([*parts, f"{MARK}*[^{MARK}{re.escape(alone)}]+", f"{MARK}+"])).findall

    def encode_word(self, word: str) -> list[int]:
        """Ids of a run of characters that no merge leaves."""
        score, symbols = self.score, list(word)
        n = len(symbols)
        agenda = [(-s, i, i + 1, p) for i in range(n - 1) if (s := score.get(p := symbols[i] + symbols[i + 1])) is not None]
        if agenda:
            heapify(agenda)
            before, after = list(range(-1, n - 1)), [*range(1, n), -1]
            while agenda:
                _, i, j, p = heappop(agenda)
                if after[i] != j or not symbols[i] or symbols[i] + symbols[j] != p:
                    continue  # a part has been merged otherwise meanwhile
                symbols[i], symbols[j] = p, ""
                after[i] = k = after[j]
                after[j] = -2
                if k >= 0:
                    before[k] = i
                    if (s := score.get(q := p + symbols[k])) is not None:
                        heappush(agenda, (-s, i, k, q))
                if (h := before[i]) >= 0 and (s := score.get(q := symbols[h] + p)) is not None:
                    heappush(agenda, (-s, h, i, q))
        ids, out = self.ids, []
        for s in symbols:
            if s:
                if (i := ids.get(s)) is not None:
                    out.append(i)
                else:
                    out.extend(self.byte[b] for b in s.encode())
        return out

    def pairs(self) -> tuple[dict[str, int], np.ndarray, np.ndarray]:
        """Symbol numbers of the pieces and their characters; sorted keys of pairs that make a piece; (rank, symbol) of each.

        Ranks order pieces as their scores do; pieces of equal score share a rank."""
        if self._pairs is None:
            number = {p: i for i, p in enumerate(self.ids)}
            for p in self.ids:
                for c in p:
                    number.setdefault(c, len(number))
            ranks = {s: r for r, s in enumerate(sorted(set(self.score.values()), reverse=True))}
            found = {number[a] << 32 | number[b]: (ranks[self.score[p]], number[p]) for p in self.ids for k in range(1, len(p)) if (a := p[:k]) in number and (b := p[k:]) in number}
            keys = np.array(sorted(found), dtype=np.int64)
            self._pairs = number, np.append(keys, np.int64(2**62)), np.array([found[k] for k in keys.tolist()] + [(NONE, 0)], dtype=np.int64)
        return self._pairs

    def encode_words(self, words: list[str]) -> list[bytes]:
        """encode_word() of many words as 32-bit ids, their agendas advancing in step."""
        number, keys, values = self.pairs()
        if self._of_char is None:
            self._of_char = np.full(0x110000, -2, dtype=np.int64)  # -2: in no piece
            for c, k in number.items():
                if len(c) == 1:
                    self._of_char[ord(c)] = k
            self._ids_of = np.array([self.ids.get(p, -1) for p in number], dtype=np.int32)
        out: list = [None] * len(words)
        groups: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            n = len(w)
            groups.setdefault(next((m for m in WIDTHS if n <= m), 0), []).append(i)

        def scored(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            k = np.where((a >= 0) & (b >= 0), a << 32 | b, -1)
            at = np.searchsorted(keys, k)
            hit = keys[at] == k
            v = values[at]
            return np.where(hit, v[..., 0], NONE), v[..., 1]

        def done(where: np.ndarray, s: np.ndarray) -> None:
            """Keeps the ids of finished rows; rows with characters that are no pieces get byte pieces."""
            ids = np.where(s >= 0, self._ids_of[np.maximum(s, 0)], -1)
            n = (s != -1).sum(1)
            plain = ((ids >= 0).sum(1) == n).tolist()
            flat, ends = ids[s != -1].astype("<i4").tobytes(), (np.cumsum(n) * 4).tolist()
            at = 0
            for k, (i, end, ok) in enumerate(zip(where.tolist(), ends, plain, strict=True)):
                out[i] = flat[at:end] if ok else array("i", self._with_bytes(ids[k, : n[k]].tolist(), words[i])).tobytes()
                at = end

        for i in groups.pop(0, []):
            out[i] = array("i", self.encode_word(words[i])).tobytes()
        for width, members in groups.items():
            chars = np.frombuffer("".join([words[i].ljust(width, "\0") for i in members]).encode("utf-32-le"), dtype=np.uint32).reshape(-1, width)
            n = np.array([len(words[i]) for i in members])
            s = np.where(np.arange(width) < n[:, None], self._of_char[chars], -1)  # -1: none
            where = np.array(members)
            rank, made = scored(s[:, :-1], s[:, 1:])
            while len(where):
                j = rank.argmin(1)
                live = rank[np.arange(len(where)), j] < NONE
                if not live.all():
                    done(where[~live], s[~live])
                    where, s, rank, made, j = where[live], s[live], rank[live], made[live], j[live]
                    if not len(where):
                        break
                rows = np.arange(len(where))
                s[rows, j] = made[rows, j]
                keep = np.ones(s.shape, dtype=bool)
                keep[rows, j + 1] = False
                s = s[keep].reshape(len(rows), -1)
                keep = keep[:, 1:]
                rank, made = rank[keep].reshape(len(rows), -1), made[keep].reshape(len(rows), -1)
                last = rank.shape[1] - 1
                if last < 0:
                    done(where, s)
                    break
                for at, ok in ((np.maximum(j - 1, 0), j > 0), (np.minimum(j, last), j <= last)):
                    r, m = scored(s[rows, at], s[rows, at + 1])
                    rank[rows[ok], at[ok]], made[rows[ok], at[ok]] = r[ok], m[ok]
        return out

    def _with_bytes(self, ids: list[int], word: str) -> list[int]:
        """ids of symbols, -1 for characters that are no pieces."""
        out, at = [], 0
        for i in ids:
            if i >= 0:
                out.append(i)
                at += len(self.text[i])
            else:
                out.extend(self.byte[b] for b in word[at].encode())
                at += 1
        return out

    def decode(self, ids: list[int], first: bool = True) -> str:
        """Text of ids; first: they begin a text, whose leading space mark is the added one."""
        if self.raw.keys().isdisjoint(ids):
            text = "".join([self.text[i] for i in ids]).replace(MARK, " ")
            return text[1:] if first and text[:1] == " " else text
        out, held = [], bytearray()

        def flush() -> None:
            if held:
                out.append(valid(bytes(held)))
                held.clear()

        for i in ids:
            if (b := self.raw.get(i)) is not None:
                held.append(b)
            else:
                flush()
                out.append(self.text[i].replace(MARK, " "))
        flush()
        text = "".join(out)
        return text[1:] if first and text[:1] == " " and ids and ids[0] not in self.raw else text


def valid(b: bytes) -> str:
    """UTF-8 with one replacement character for each byte that belongs to no character."""
    out, at = [], 0
    while at < len(b):
        try:
            out.append(b[at:].decode())
            break
        except UnicodeDecodeError as e:
            out.append(b[at : at + e.start].decode() + "�")
            at += e.start + 1
    return "".join(out)


class Codec:
    """Encodes texts in batches and remembers the ids of words, the last `remembered` to twice as many."""

    def __init__(self, path: str, remembered: int = 250_000):
        self.v = v = Vocabulary(path)
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.most = remembered
        self.wrong: set[str] = set()
        self.split = v.splitter()
        self.names = [str(i) for i in range(len(v.text))]
        # A byte under 128 is a character of its own; the others decode in runs.
        self.shown = [chr(v.raw[i]) if i in v.raw else t.replace(MARK, " ") for i, t in enumerate(v.text)]
        self.high = frozenset(i for i, b in v.raw.items() if b > 127)
        #: Words can be compared one by one if a line end is always a byte piece of its own.
        self.line_end = [*v.library.encode("\n")] if v.by_word and not any("\n" in p for p in v.ids) else None

    def encode(self, texts: list[str], check: bool = False) -> list[tuple[array, bool]]:
        """(ids, whether the library agrees on every word) of each text; without check always true."""
        cut = [self.split(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        if len(self.words) > self.most:
            self.words, self.older = {}, self.words
        words, older = self.words, self.older
        new = []
        for w in set(chain.from_iterable(cut)):
            if w not in words:
                if w in older:
                    words[w] = older[w]
                else:
                    new.append(w)
        made = self.v.encode_words(new)
        words.update(zip(new, made, strict=True))
        if check:
            self.wrong.update(self.differing(new, made))
        wrong = self.wrong
        return [(array("i", b"".join(map(words.__getitem__, c))), not wrong or wrong.isdisjoint(c)) for c in cut]

    def differing(self, words: list[str], made: list[bytes]) -> list[str]:
        """Words whose ids, or the text decoded from them, differ from the library's. Others than those with a space in front follow a line end."""
        own = [array("i", b).tolist() for b in made]
        marked = [w[0] == MARK and len(w) > 1 for w in words]  # the library has no ids for an empty text
        whole = [a if m else self.line_end + a for a, m in zip(own, marked, strict=True)]
        theirs = self.v.library.encode([w[1:] if m else "\n" + w for w, m in zip(words, marked, strict=True)], num_threads=1)
        texts = self.v.library.decode(whole, num_threads=1)
        return [w for w, a, b, t, m in zip(words, whole, theirs, texts, marked, strict=True) if a != b or t != (w[1:] if m else "\n" + w).replace(MARK, " ")]

    def ids_text(self, ids: array) -> str:
        return ",".join(map(self.names.__getitem__, ids))

    def decode(self, ids: array) -> str:
        if self.high.isdisjoint(ids):
            text = "".join(map(self.shown.__getitem__, ids))
            return text[1:] if text[:1] == " " and ids[0] not in self.v.raw else text
        return self.v.decode(ids.tolist())


#: One for each model and worker process, which serves many tasks.
CODECS: dict[str, Codec] = {}


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", outputs: tuple[str, ...] = ("ids", "decoded"), check: str = "words", batch: int = 256) -> DataFrame:
    """doc_id, n_tokens, the outputs, agrees.

    outputs: any of ids (array), ids_text (decimal ids joined by commas), decoded, ids_sha256, decoded_sha256.
    check: "words" compares the words that are new to a worker with the library, batch by batch;
    "documents" compares whole documents as well; "off" compares nothing (agrees is null)."""
    from hashlib import sha256

    from pyspark.sql.pandas.types import to_arrow_type

    kinds = {"ids": T.ArrayType(T.IntegerType()), **dict.fromkeys(("ids_text", "decoded", "ids_sha256", "decoded_sha256"), T.StringType())}
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("n_tokens", T.LongType()), *(T.StructField(c, kinds[c]) for c in outputs), T.StructField("agrees", T.BooleanType())])
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from talkweave.llm.piece_codec import CODECS

        codec = CODECS.get(model) or CODECS.setdefault(model, Codec(model))
        library = codec.v.library
        whole_too = check == "documents" or check == "words" and codec.line_end is None
        for whole in batches:
            for at in range(0, whole.num_rows, batch):
                part = whole.slice(at, batch)
                texts = [t or "" for t in part.column(1).to_pylist()]
                coded = codec.encode(texts, check != "off" and codec.line_end is not None)
                own, same = [a for a, _ in coded], [s if check != "off" else None for _, s in coded]
                decoded = [codec.decode(a) for a in own]
                if whole_too:
                    ids = library.encode(texts, num_threads=1)
                    same = [s and a.tolist() == b and c == d for s, a, b, c, d in zip(same, own, ids, decoded, library.decode(ids, num_threads=1), strict=True)]
                made = {
                    "ids": lambda: [a.tolist() for a in own],
                    "ids_text": lambda: [codec.ids_text(a) for a in own],
                    "decoded": lambda: decoded,
                    "ids_sha256": lambda: [sha256(codec.ids_text(a).encode()).hexdigest() for a in own],
                    "decoded_sha256": lambda: [sha256(c.encode()).hexdigest() for c in decoded],
                }
                cols = [part.column(0).to_pylist(), [len(a) for a in own], *(made[c]() for c in outputs), same]
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(cols, arrow, strict=True)], schema=arrow)

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)


def decode(coded: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text of a column of ids; a null list is an empty one."""
    schema = T.StructType([T.StructField("doc_id", coded.schema[id_col].dataType), T.StructField("text", T.StringType())])
    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(schema[0].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Vocabulary(model)
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(b.column(0).to_pylist(), kind), pa.array([v.decode(x or []) for x in b.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return coded.select(id_col, ids_col).mapInArrow(run, schema)
