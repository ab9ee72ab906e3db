"""Tokens of the search index: stemmed ASCII words with the word itself beside the stem, and every other character alone."""

from __future__ import annotations

import re
from dataclasses import dataclass
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from talkweave.functions.stemmer import stem, stem_sources


@dataclass(frozen=True)
class Options:
    """Which tokens there are besides words: digits, symbols; and whether words are stemmed."""

    numbers: bool = False
    symbols: bool = False
    stemming: bool = True

    @classmethod
    def parse(cls, words: list[str]) -> Options:
        """From option names; unknown ones are ignored."""
        return cls(numbers="enable_num_token" in words, symbols="enable_special_char" in words, stemming="skip_stemming" not in words)


#: Runs of letters, runs of digits, other visible ASCII, then characters beyond ASCII.
PARTS = re.compile(r"([A-Za-z]+)|([0-9]+)|([!-~])|([^\x00-\x7f])")
#: Beyond ASCII these blocks are punctuation: general, supplemental, and that of CJK texts.
PUNCTUATION = re.compile("[\u2000-\u206f\u2e00-\u2e7f\u3000-\u303f]")


def tokenize(text: str | None, options: Options = Options()) -> list[list[str]]:
    """The tokens of each position, the first one primary."""
    out = []
    for m in PARTS.finditer(text or ""):
        word, number, symbol, other = m.groups()
        if word:
            low = word.lower()
            stemmed = stem(low) if options.stemming else low
            out.append([low] if stemmed == low else [stemmed, low])
        elif number:
            if options.numbers:
                out.append([number])
        elif symbol:
            if options.symbols:
                out.append([symbol])
        elif options.symbols or not PUNCTUATION.match(other):
            out.append([other])
    return out


def phrases(keyword: str, options: Options = Options()) -> list[list[list[str]]]:
    """Tokens of each word of a keyword; each word is a phrase."""
    return [tokenize(w, options) for w in keyword.split()]


def forms(own: list[str], options: Options = Options()) -> list[str]:
    """The words and characters of texts that fit a position of a query: they or their stems are among its tokens."""
    asked = [t for t in own if t.isascii() and t.isalpha()] if options.stemming else []
    return sorted({*own}.union(*map(stem_sources, asked)))


def words(text: Column, options: Options = Options()) -> Column:
    """array<string> of a text's words and characters without stems, by built-in functions. Plain ASCII texts are split, which takes a fraction of finding."""
    kinds = ["[A-Za-z]+", *["[0-9]+"] * options.numbers, *[r"[!-/:-@\[-`{-~]"] * options.symbols]
    rest = r"[^\x00-\x7f]" if options.symbols else r"[^\x00-\x7f\x{2000}-\x{206f}\x{2e00}-\x{2e7f}\x{3000}-\x{303f}]"
    found = F.regexp_extract_all(F.translate(text, ascii_uppercase, ascii_lowercase), F.lit("|".join([*kinds, rest])), F.lit(0))
    if not options.numbers and not options.symbols:
        found = F.when(text.rlike(r"[^\x00-\x7f]"), found).otherwise(F.array_remove(F.split(F.lower(text), "[^a-z]+"), ""))
    return F.coalesce(found, F.array().cast("array<string>"))


def pieces(words: Column, most: int = 64) -> Column:
    """array<array<string>>: the words in pieces of at most so many."""
    cut = lambda w: F.when(F.size(w) > 0, F.transform(F.sequence(F.lit(1), F.size(w), F.lit(most)), lambda i: F.slice(w, i, most))).otherwise(F.array())
    # The lambda's variable holds the words, so that they are cut from their text once.
    return F.flatten(F.transform(F.array(words), cut))


def stemmed(words: Column) -> Column:
    """array<array<string>>: each of the words with its stem before it, if that differs.

    A batch stays in Arrow; Python sees its distinct words only. It has all words of some thousand rows (maxRecordsPerBatch,
    maxBytesPerBatch), so that rows of `pieces` keep it small whatever the texts are."""

    @F.arrow_udf("array<array<string>>")
    def run(s: pa.Array) -> pa.Array:
        coded = s.flatten().dictionary_encode()
        own = [[w] if not (w.isascii() and w.isalpha()) or (t := stem(w)) == w else [t, w] for w in coded.dictionary.to_pylist()]
        ends = np.cumsum(s.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(own, pa.list_(pa.string())).take(coded.indices))

    return run(words)


def tokens(text: Column, options: Options = Options()) -> Column:
    """array<array<string>> of a text's positions.

    Without stems this is an expression of built-in functions; stems take an Arrow batch in Python."""
    found = words(text, options)
    return stemmed(found) if options.stemming else F.transform(found, lambda x: F.array(x))
