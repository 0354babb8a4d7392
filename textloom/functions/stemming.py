"""Snowball stemmers for English (Porter2) and Russian, from the published algorithm descriptions."""

from __future__ import annotations

import re

_V = "aeiouy"
_DOUBLE = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_LI = "cdeghkmnrt"

# Irregular forms and invariant words of the English algorithm.
_IRREGULAR = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl",
    "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe",
    "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
_STOP_AFTER_1A = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}

# Suffix replacements of steps 2 and 3, suffixes of step 4.
_STEP2 = {
    "ational": "ate", "fulness": "ful", "iveness": "ive", "ization": "ize", "ousness": "ous", "biliti": "ble",
    "lessli": "less", "tional": "tion", "alism": "al", "aliti": "al", "ation": "ate", "entli": "ent", "fulli": "ful",
    "iviti": "ive", "ousli": "ous", "abli": "able", "alli": "al", "anci": "ance", "ator": "ate", "enci": "ence",
    "izer": "ize", "bli": "ble", "ogi": "og", "li": "",
}
_STEP3 = {
    "ational": "ate", "tional": "tion", "alize": "al", "ative": "", "icate": "ic", "iciti": "ic", "ical": "ic",
    "ness": "", "ful": "",
}
_STEP4 = ("ement", "able", "ance", "ence", "ible", "ment", "ant", "ate", "ent", "ion", "ism", "iti", "ive", "ize", "ous", "al", "er", "ic")


def language_of(token: str) -> str:
    return "russian" if re.search("[а-яё]", token) else "english"


def stem(token: str, language: str) -> str:
    return _russian(token) if language == "russian" else _english(token)


def _region(word: str, start: int = 0) -> int:
    """Index after the first non-vowel that follows a vowel, from ``start`` on."""
    m = re.compile("[aeiouy][^aeiouy]").search(word, start)
    return m.end() if m else len(word)


def _short_syllable_end(w: str) -> bool:
    if len(w) == 2:
        return w[0] in _V and w[1] not in _V
    return len(w) > 2 and w[-3] not in _V and w[-2] in _V and w[-1] not in _V + "wxY"


def _english(word: str) -> str:
    if len(word) <= 2:
        return word
    if word in _IRREGULAR:
        return _IRREGULAR[word]
    w = re.sub("^y|(?<=[aeiouy])y", "Y", word)
    lead = next((p for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    r1 = len(lead) if lead else _region(w)
    r2 = _region(w, r1)
    has_vowel = lambda s: any(c in _V for c in s)
    # 1a
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and has_vowel(w[:-2]):
        w = w[:-1]
    if w in _STOP_AFTER_1A:
        return w
    # 1b
    if w.endswith(("eed", "eedly")):
        cut = 5 if w.endswith("eedly") else 3
        if len(w) - cut >= r1:
            w = w[:-cut] + "ee"
    else:
        for suffix in ("ingly", "edly", "ing", "ed"):
            if w.endswith(suffix):
                if has_vowel(w[: -len(suffix)]):
                    w = w[: -len(suffix)]
                    if w.endswith(("at", "bl", "iz")):
                        w += "e"
                    elif w.endswith(_DOUBLE):
                        w = w[:-1]
                    elif r1 >= len(w) and _short_syllable_end(w):
                        w += "e"
                break
    # 1c
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _V:
        w = w[:-1] + "i"
    # 2
    s = next((x for x in _STEP2 if w.endswith(x)), None)
    if s and len(w) - len(s) >= r1:
        if s == "ogi":
            w = w[:-1] if w[-4:-3] == "l" else w
        elif s == "li":
            w = w[:-2] if w[-3:-2] and w[-3] in _LI else w
        else:
            w = w[: -len(s)] + _STEP2[s]
    # 3
    s = next((x for x in _STEP3 if w.endswith(x)), None)
    if s and len(w) - len(s) >= r1 and (s != "ative" or len(w) - 5 >= r2):
        w = w[: -len(s)] + _STEP3[s]
    # 4
    s = next((x for x in _STEP4 if w.endswith(x)), None)
    if s and len(w) - len(s) >= r2 and (s != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(s)]
    # 5
    if w.endswith("e") and (len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short_syllable_end(w[:-1]))):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


_RV = "аеиоуыэюя"

# Suffix classes of the Russian algorithm; group 1 of a class needs а or я before it.
_GERUND1, _GERUND2 = ("вшись", "вши", "в"), ("ившись", "ывшись", "ивши", "ывши", "ив", "ыв")
_ADJECTIVE = "ими ыми его ого ему ому ее ие ые ое ей ий ый ой ем им ым ом их ых ую юю ая яя ою ею".split()
_PARTICIPLE1, _PARTICIPLE2 = ("ем", "нн", "вш", "ющ", "щ"), ("ивш", "ывш", "ующ")
_REFLEXIVE = ("ся", "сь")
_VERB1 = "ешь нно ете йте ла на ли й л ем н ло но ет ют ны ть".split()
_VERB2 = "ейте уйте ила ыла ена ите или ыли ило ыло ено ует уют ены ить ыть ишь ей уй ил ыл им ым ен ят ит ыт ую ю".split()
_NOUN = "иями ями ами ией иям ием иях ев ов ие ье еи ии ей ой ий ям ем ам ом ах ях ию ью ия ья а е и й о у ы ь ю я".split()
_DERIVATION, _SUPERLATIVE = ("ость", "ост"), ("ейше", "ейш")


def _cut(w: str, rv: int, plain: tuple | list, after_a: tuple | list = ()) -> str | None:
    """``w`` without its longest suffix of the class inside RV, or None."""
    for s in sorted({*plain, *after_a}, key=len, reverse=True):
        if w.endswith(s) and len(w) - len(s) >= rv:
            if s in plain:
                return w[: -len(s)]
            before = len(w) - len(s) - 1
            if before >= rv and w[before] in "ая":
                return w[: -len(s)]
    return None


def _russian(word: str) -> str:
    w = word.replace("ё", "е")
    m = re.search(f"[{_RV}]", w)
    rv = m.end() if m else len(w)
    m1 = re.search(f"[{_RV}][^{_RV}]", w)
    r1 = m1.end() if m1 else len(w)
    m2 = re.compile(f"[{_RV}][^{_RV}]").search(w, r1)
    r2 = m2.end() if m2 else len(w)
    # 1
    out = _cut(w, rv, _GERUND2, _GERUND1)
    if out is None:
        w = _cut(w, rv, _REFLEXIVE) or w
        out = _cut(w, rv, _ADJECTIVE)
        if out is not None:
            out = _cut(out, rv, _PARTICIPLE2, _PARTICIPLE1) or out
        else:
            out = _cut(w, rv, _VERB2, _VERB1)
            if out is None:
                out = _cut(w, rv, _NOUN)
    w = w if out is None else out
    # 2
    if w.endswith("и") and len(w) - 1 >= rv:
        w = w[:-1]
    # 3
    w = _cut(w, r2, _DERIVATION) or w
    # 4
    if w.endswith("нн") and len(w) - 1 >= rv:
        return w[:-1]
    out = _cut(w, rv, _SUPERLATIVE)
    if out is not None:
        w = out
        return w[:-1] if w.endswith("нн") and len(w) - 1 >= rv else w
    if w.endswith("ь") and len(w) - 1 >= rv:
        w = w[:-1]
    return w
