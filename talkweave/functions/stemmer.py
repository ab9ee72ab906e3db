"""English stemming by the published Porter2 rules."""

from __future__ import annotations

from functools import lru_cache

VOWELS = frozenset("aeiouy")
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
LI_ENDINGS = frozenset("cdeghkmnrt")
# Words that the rules would stem wrongly, and those that step 1a leaves alone.
SPECIAL = {
    "skis": "ski",
    "skies": "sky",
    "dying": "die",
    "lying": "lie",
    "tying": "tie",
    "idly": "idl",
    "gently": "gentl",
    "ugly": "ugli",
    "early": "earli",
    "only": "onli",
    "singly": "singl",
    "sky": "sky",
    "news": "news",
    "howe": "howe",
    "atlas": "atlas",
    "cosmos": "cosmos",
    "bias": "bias",
    "andes": "andes",
}
LEFT_ALONE = frozenset("inning outing canning herring earring proceed exceed succeed".split())
# Endings and their replacements; a longer ending goes before a shorter one that ends it.
STEP2 = {
    "ational": "ate",
    "fulness": "ful",
    "iveness": "ive",
    "ization": "ize",
    "ousness": "ous",
    "biliti": "ble",
    "lessli": "less",
    "tional": "tion",
    "alism": "al",
    "aliti": "al",
    "ation": "ate",
    "entli": "ent",
    "fulli": "ful",
    "iviti": "ive",
    "ousli": "ous",
    "abli": "able",
    "alli": "al",
    "anci": "ance",
    "ator": "ate",
    "enci": "ence",
    "izer": "ize",
    "bli": "ble",
    "ogi": "og",
    "li": "",
}
STEP3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ative": "", "ical": "ic", "ness": "", "ful": ""}
STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")


def _vowel(c: str) -> bool:
    return c in VOWELS


def _after(w: str, start: int) -> int:
    """Where the region after the first non-vowel behind a vowel begins."""
    for i in range(start + 1, len(w)):
        if not _vowel(w[i]) and _vowel(w[i - 1]):
            return i + 1
    return len(w)


def _short_end(w: str) -> bool:
    if len(w) == 2:
        return _vowel(w[0]) and not _vowel(w[1])
    return len(w) > 2 and not _vowel(w[-1]) and w[-1] not in "wxY" and _vowel(w[-2]) and not _vowel(w[-3])


@lru_cache(maxsize=100_000)
def stem(word: str) -> str:
    """Stem of a lower-case word."""
    if len(word) <= 2:
        return word
    if word in SPECIAL:
        return SPECIAL[word]
    w = "".join("Y" if c == "y" and (i == 0 or word[i - 1] in VOWELS and not (word[i - 1] == "y" and i >= 2 and word[i - 2] in VOWELS)) else c for i, c in enumerate(word))
    r1 = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    r1 = _after(w, 0) if r1 is None else r1
    r2 = _after(w, r1)
    # plurals
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and any(map(_vowel, w[:-2])):
        w = w[:-1]
    if w in LEFT_ALONE:
        return w
    # past and present participles
    end = next((e for e in ("eedly", "ingly", "edly", "eed", "ing", "ed") if w.endswith(e)), None)
    if end in ("eedly", "eed"):
        if len(w) - len(end) >= r1:
            w = w[: len(w) - len(end)] + "ee"
    elif end and any(map(_vowel, w[: -len(end)])):
        w = w[: -len(end)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(DOUBLES):
            w = w[:-1]
        elif len(w) <= r1 and _short_end(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and not _vowel(w[-2]):
        w = w[:-1] + "i"
    for e, new in STEP2.items():
        if w.endswith(e):
            at = len(w) - len(e)
            if at >= r1 and (e != "ogi" or w[at - 1] == "l") and (e != "li" or w[at - 1] in LI_ENDINGS):
                w = w[:at] + new
            break
    for e, new in STEP3.items():
        if w.endswith(e):
            at = len(w) - len(e)
            if at >= r1 and (e != "ative" or at >= r2):
                w = w[:at] + new
            break
    for e in STEP4:
        if w.endswith(e):
            at = len(w) - len(e)
            if at >= r2 and (e != "ion" or w[at - 1] in "st"):
                w = w[:at]
            break
    if w.endswith("e"):
        if len(w) - 1 >= r2 or len(w) - 1 >= r1 and not _short_end(w[:-1]):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


def stem_sources(token: str) -> set[str]:
    """All lower-case ASCII words whose stem is this token; they are few.

    Each step of the rules is undone, the last one first, to every word that could have led to the next step's; the stemmer
    tells which of them do. A letter's mark as a consonant is no matter here: no ending that is cut or put has one."""
    w = {token}
    w |= {x + "e" for x in w} | {x + "l" for x in w if x.endswith("l")}
    w |= {x + e for x in w for e in STEP4}
    for step in (STEP3, STEP2):
        w |= {x[: len(x) - len(new)] + e for x in w for e, new in step.items() if x.endswith(new)}
    w |= {x[:-1] + "y" for x in w if x.endswith("i")}
    cut = w | {x[:-1] for x in w if x.endswith("e")} | {x + d[0] for x in w for d in DOUBLES if x.endswith(d[0])}
    w |= {x + e for x in cut for e in ("ed", "edly", "ing", "ingly")} | {x + e for x in w if x.endswith("ee") for e in ("d", "dly")}
    w |= {x + "s" for x in w} | {x + "es" for x in w if x.endswith(("ss", "i"))} | {x + "ed" for x in w if x.endswith("i")} | {x + "d" for x in w if x.endswith("ie")}
    return {x for x in w | SPECIAL.keys() | LEFT_ALONE if stem.__wrapped__(x) == token}
