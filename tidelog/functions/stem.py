"""Suffix stripping for English and Portuguese after the published Snowball definitions.

Words shorter than three letters stay.  Meant for distinct terms, not for every
occurrence: see ``fulltext.stemmed``.
"""

from __future__ import annotations

import re

#: English, fixed values of the published definition.
_EN_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_EN_SPECIAL = {
    "skis": "ski", "skies": "sky", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
_EN_LATE = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
_EN_STEP2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate",
    "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive",
    "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less",
}
_EN_STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_EN_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize")


def _region(word: str, vowels: str, start: int = 0) -> int:
    """Where the part after the first non-vowel that follows a vowel begins."""
    seen = False
    for i in range(start, len(word)):
        if word[i] in vowels:
            seen = True
        elif seen:
            return i + 1
    return len(word)


def _longest(word: str, endings) -> str | None:
    return max((e for e in endings if word.endswith(e)), key=len, default=None)


def english(word: str) -> str:
    if len(word) < 3:
        return word
    w = word.lstrip("'")
    if w in _EN_SPECIAL:
        return _EN_SPECIAL[w]
    w = re.sub(r"(^|[aeiouy])y", lambda m: m[1] + "Y", w)
    vowels = "aeiouy"
    head = next((p for p in ("gener", "commun", "arsen") if w.startswith(p)), "")
    r1 = len(head) if head else _region(w, vowels)
    r2 = _region(w, vowels, r1)

    def short_end(s: str) -> bool:
        if len(s) == 2:
            return s[0] in vowels and s[1] not in vowels
        return len(s) > 2 and s[-3] not in vowels and s[-2] in vowels and s[-1] not in vowels and s[-1] not in "wxY"

    for e in ("'s'", "'s", "'"):
        if w.endswith(e):
            w = w[: -len(e)]
            break
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith(("us", "ss")):
        pass
    elif w.endswith("s") and any(c in vowels for c in w[:-2]):
        w = w[:-1]
    if w in _EN_LATE:
        return w.replace("Y", "y")
    e = _longest(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if e in ("eed", "eedly"):
        if len(w) - len(e) >= r1:
            w = w[: -len(e)] + "ee"
    elif e and any(c in vowels for c in w[: -len(e)]):
        w = w[: -len(e)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(_EN_DOUBLES):
            w = w[:-1]
        elif r1 >= len(w) and short_end(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in vowels:
        w = w[:-1] + "i"
    e = _longest(w, (*_EN_STEP2, "ogi", "li"))
    if e and len(w) - len(e) >= r1:
        if e == "ogi":
            w = w[:-1] if w.endswith("logi") else w
        elif e == "li":
            w = w[:-2] if len(w) > 2 and w[-3] in "cdeghkmnrt" else w
        else:
            w = w[: -len(e)] + _EN_STEP2[e]
    e = _longest(w, (*_EN_STEP3, "ative"))
    if e and len(w) - len(e) >= r1:
        if e == "ative":
            w = w[:-5] if len(w) - 5 >= r2 else w
        else:
            w = w[: -len(e)] + _EN_STEP3[e]
    e = _longest(w, (*_EN_STEP4, "ion"))
    if e and len(w) - len(e) >= r2 and (e != "ion" or w[:-3].endswith(("s", "t"))):
        w = w[: -len(e)]
    if w.endswith("e") and (len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not short_end(w[:-1]))):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


#: Portuguese, fixed values of the published definition.
_PT_VOWELS = "aeiouáéíóúâêô"
_PT_STANDARD = (
    "eza ezas ico ica icos icas ismo ismos ável ível ista istas oso osa osos osas amento amentos imento imentos adora ador aça~o adoras adores aço~es ante antes ância"
).split()
_PT_VERBS = (
    "ada ida ia aria eria iria ará ara erá era irá ava asse esse isse aste este iste ei arei erei irei am iam ariam eriam iriam aram eram iram avam em arem erem irem assem essem "
    "issem ado ido ando endo indo ara~o era~o ira~o ar er ir as adas idas ias arias erias irias arás aras erás eras irás avas es ardes erdes irdes ares eres ires asses esses isses astes "
    "estes istes is ais eis íeis aríeis eríeis iríeis áreis areis éreis ereis íreis ireis ásseis ésseis ísseis áveis ados idos ámos amos íamos aríamos eríamos iríamos áramos éramos "
    "íramos ávamos emos aremos eremos iremos ássemos êssemos íssemos imos armos ermos irmos eu iu ou ira iras"
).split()


def portuguese(word: str) -> str:
    if len(word) < 3:
        return word
    w = word.replace("ã", "a~").replace("õ", "o~")
    v = _PT_VOWELS
    r1 = _region(w, v)
    r2 = _region(w, v, r1)
    if len(w) < 4:
        rv = len(w)
    elif w[1] not in v:
        rv = next((i + 1 for i in range(2, len(w)) if w[i] in v), len(w))
    elif w[0] in v:
        rv = next((i + 1 for i in range(2, len(w)) if w[i] not in v), len(w))
    else:
        rv = 3
    before = w

    def cut(ending: str, region: int, put: str = "") -> bool:
        nonlocal w
        if w.endswith(ending) and len(w) - len(ending) >= region:
            w = w[: -len(ending)] + put
            return True
        return False

    e = _longest(w, (*_PT_STANDARD, "logia", "logias", "ução", "uça~o", "uço~es", "ência", "ências", "amente", "mente", "idade", "idades", "iva", "ivo", "ivas", "ivos", "ira", "iras"))
    if e in _PT_STANDARD:
        cut(e, r2)
    elif e in ("logia", "logias"):
        cut(e, r2, "log")
    elif e in ("uça~o", "uço~es"):
        cut(e, r2, "u")
    elif e in ("ência", "ências"):
        cut(e, r2, "ente")
    elif e == "amente":
        if cut(e, r1):
            if w.endswith("iv") and len(w) - 2 >= r2:
                cut("iv", r2)
                cut("at", r2)
            else:
                any(cut(x, r2) for x in ("os", "ic", "ad"))
    elif e == "mente":
        if cut(e, r2):
            any(cut(x, r2) for x in ("ante", "avel", "ível"))
    elif e in ("idade", "idades"):
        if cut(e, r2):
            any(cut(x, r2) for x in ("abil", "ic", "iv"))
    elif e in ("iva", "ivo", "ivas", "ivos"):
        if cut(e, r2):
            cut("at", r2)
    elif e in ("ira", "iras"):
        if w[: -len(e)].endswith("e"):
            cut(e, rv, "ir")
    if w == before:
        verb = _longest(w[rv:], _PT_VERBS)
        if verb:
            cut(verb, rv)
    if w != before:
        if w.endswith("ci") and len(w) - 1 >= rv:
            w = w[:-1]
    else:
        any(cut(x, rv) for x in ("os", "a", "i", "o", "á", "í", "ó"))
    for x in ("e", "é", "ê"):
        if cut(x, rv):
            if (w.endswith("gu") or w.endswith("ci")) and len(w) - 1 >= rv:
                w = w[:-1]
            break
    else:
        if w.endswith("ç"):
            w = w[:-1] + "c"
    return w.replace("a~", "ã").replace("o~", "õ")


STEMMERS = {"en": english, "pt": portuguese}
