"""English Snowball (Porter2) stemmer, from the published description of the algorithm."""

from __future__ import annotations

from functools import lru_cache

VOWELS = frozenset("aeiouy")
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
LI = frozenset("cdeghkmnrt")
SPECIAL = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli",
    "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos",
    "bias": "bias", "andes": "andes",
}
AFTER_1A = frozenset(("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"))
STEP_2 = (
    ("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"),
    ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"),
    ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", ""),
)
STEP_3 = (("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", ""))
STEP_4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")


def _region(word: str, start: int) -> int:
    """Place after the first consonant that follows a vowel."""
    for i in range(start + 1, len(word)):
        if word[i] not in VOWELS and word[i - 1] in VOWELS:
            return i + 1
    return len(word)


def _short_end(word: str) -> bool:
    """Ends in a short syllable."""
    if len(word) == 2:
        return word[0] in VOWELS and word[1] not in VOWELS
    return len(word) > 2 and word[-1] not in VOWELS and word[-1] not in "wxY" and word[-2] in VOWELS and word[-3] not in VOWELS


@lru_cache(maxsize=100_000)
def stem(word: str) -> str:
    """Stem of a lower-case word."""
    if len(word) <= 2:
        return word
    word = word.lstrip("'") or word
    if word in SPECIAL:
        return SPECIAL[word]
    letters = list(word)
    for i, c in enumerate(letters):
        if c == "y" and (i == 0 or letters[i - 1] in VOWELS):
            letters[i] = "Y"
    w = "".join(letters)
    r1 = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    r1 = _region(w, 0) if r1 is None else r1
    r2 = _region(w, r1)
    for end in ("'s'", "'s", "'"):
        if w.endswith(end):
            w = w[: -len(end)]
            break
    # 1a
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and any(c in VOWELS for c in w[:-2]):
        w = w[:-1]
    if w in AFTER_1A:
        return w.lower()
    # 1b
    for end in ("eedly", "eed", "ingly", "edly", "ing", "ed"):
        if w.endswith(end):
            if end in ("eedly", "eed"):
                if len(w) - len(end) >= r1:
                    w = w[: -len(end)] + "ee"
            elif any(c in VOWELS for c in w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif w.endswith(DOUBLES):
                    w = w[:-1]
                elif r1 >= len(w) and _short_end(w):
                    w += "e"
            break
    # 1c
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in VOWELS:
        w = w[:-1] + "i"
    # 2
    for end, new in STEP_2:
        if w.endswith(end):
            if len(w) - len(end) >= r1:
                if end == "ogi":
                    w = w[:-1] if w[-4:-3] == "l" else w
                elif end == "li":
                    w = w[:-2] if w[-3:-2] in LI else w
                else:
                    w = w[: -len(end)] + new
            break
    # 3
    for end, new in STEP_3:
        if w.endswith(end):
            if len(w) - len(end) >= (r2 if end == "ative" else r1):
                w = w[: -len(end)] + new
            break
    # 4
    for end in STEP_4:
        if w.endswith(end):
            if len(w) - len(end) >= r2 and (end != "ion" or w[-4:-3] in ("s", "t")):
                w = w[: -len(end)]
            break
    # 5
    if w.endswith("e"):
        at = len(w) - 1
        if at >= r2 or (at >= r1 and not _short_end(w[:-1])):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()
