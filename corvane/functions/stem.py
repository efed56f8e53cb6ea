"""English stemming after Porter's published second algorithm."""

from __future__ import annotations

from functools import lru_cache

_V = set("aeiouy")
_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_LI = set("cdeghkmnrt")
_SPECIAL = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"} | {w: w for w in ("sky", "news", "howe", "atlas", "cosmos", "bias", "andes")}
_KEEP = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
_STEP2 = {"tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less", "ogi": "og", "li": ""}
_STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")


def _regions(w: str) -> tuple[int, int]:
    def after(start: int) -> int:
        for k in range(start + 1, len(w)):
            if w[k] not in _V and w[k - 1] in _V:
                return k + 1
        return len(w)

    r1 = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    r1 = after(0) if r1 is None else r1
    return r1, after(r1)


def _short_end(w: str) -> bool:
    if len(w) == 2:
        return w[0] in _V and w[1] not in _V
    return len(w) > 2 and w[-3] not in _V and w[-2] in _V and w[-1] not in _V and w[-1] not in "wxY"


@lru_cache(100_000)
def stem(word: str) -> str:
    """The stem of a lower-cased English word."""
    if len(word) <= 2:
        return word
    w = word.replace("’", "'").lstrip("'")
    if w in _SPECIAL:
        return _SPECIAL[w]
    chars = list(w)
    for k, x in enumerate(chars):
        if x == "y" and (k == 0 or chars[k - 1] in _V):
            chars[k] = "Y"
    w = "".join(chars)
    r1, r2 = _regions(w)
    for end in ("'s'", "'s", "'"):
        if w.endswith(end):
            w = w[: -len(end)]
            break
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and any(x in _V for x in w[:-2]):
        w = w[:-1]
    if w in _KEEP:
        return w
    if w.endswith(("eedly", "eed")):
        end = "eedly" if w.endswith("eedly") else "eed"
        if len(w) - len(end) >= r1:
            w = w[: -len(end)] + "ee"
    else:
        for end in ("ingly", "edly", "ing", "ed"):
            if w.endswith(end):
                if any(x in _V for x in w[: -len(end)]):
                    w = w[: -len(end)]
                    if w.endswith(("at", "bl", "iz")):
                        w += "e"
                    elif w.endswith(_DOUBLES):
                        w = w[:-1]
                    elif r1 >= len(w) and _short_end(w):
                        w += "e"
                break
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _V:
        w = w[:-1] + "i"
    for end in sorted(_STEP2, key=len, reverse=True):
        if w.endswith(end):
            left = w[: -len(end)]
            if len(left) >= r1 and not (end == "ogi" and not left.endswith("l")) and not (end == "li" and not (left and left[-1] in _LI)):
                w = left + _STEP2[end]
            break
    for end in sorted(_STEP3, key=len, reverse=True):
        if w.endswith(end):
            left = w[: -len(end)]
            if len(left) >= r1 and not (end == "ative" and len(left) < r2):
                w = left + _STEP3[end]
            break
    for end in sorted(_STEP4, key=len, reverse=True):
        if w.endswith(end):
            left = w[: -len(end)]
            if len(left) >= r2 and not (end == "ion" and not left.endswith(("s", "t"))):
                w = left
            break
    if w.endswith("e"):
        left = w[:-1]
        if len(left) >= r2 or len(left) >= r1 and not _short_end(left):
            w = left
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()
