"""The published Snowball stemming algorithm for Spanish."""

from __future__ import annotations

from functools import lru_cache

#: Fixed values of the published algorithm: vowels and the suffix classes of its steps.
VOWELS = set("aeiouáéíóúü")
PRONOUNS = ("selas", "selos", "sela", "selo", "las", "les", "los", "nos", "me", "se", "la", "le", "lo")
GERUNDS_ACCENTED = {"iéndo": "iendo", "ándo": "ando", "ár": "ar", "ér": "er", "ír": "ir"}
GERUNDS = ("ando", "iendo", "ar", "er", "ir")
STEP1_DELETE = (
    "anza anzas ico ica icos icas ismo ismos able ables ible ibles ista istas oso osa osos osas amiento amientos imiento imientos".split()
)
STEP1_IC = "adora ador ación adoras adores aciones ante antes ancia ancias acion".split()
STEP2_Y = "ya ye yan yen yeron yendo yo yó yas yes yais yamos".split()
STEP2_EN = "en es éis emos".split()
STEP2_DELETE = (
    """arían arías arán arás aríais aría aréis aríamos aremos ará aré erían erías erán erás eríais ería eréis eríamos eremos erá eré
    irían irías irán irás iríais iría iréis iríamos iremos irá iré aba ada ida ía ara iera ad ed id ase iese aste iste an aban ían aran
    ieran asen iesen aron ieron ado ido ando iendo ió ar er ir as abas adas idas ías aras ieras ases ieses ís áis abais íais arais ierais
    aseis ieseis asteis isteis ados idos amos ábamos íamos imos áramos iéramos iésemos ásemos""".split()
)


def _by_length(suffixes) -> list[str]:
    return sorted(suffixes, key=len, reverse=True)


_PRONOUNS, _DELETE2, _Y2 = _by_length(PRONOUNS), _by_length(STEP2_DELETE), _by_length(STEP2_Y)


def _after_vowel_consonant(word: str, start: int) -> int:
    """The region after the first non-vowel that follows a vowel, from `start` on."""
    for i in range(start + 1, len(word)):
        if word[i] not in VOWELS and word[i - 1] in VOWELS:
            return i + 1
    return len(word)


def regions(word: str) -> tuple[int, int, int]:
    """Where RV, R1 and R2 begin."""
    r1 = _after_vowel_consonant(word, 0)
    r2 = _after_vowel_consonant(word, r1)
    rv = len(word)
    if len(word) >= 3:
        if word[1] not in VOWELS:
            rv = next((i + 1 for i in range(2, len(word)) if word[i] in VOWELS), len(word))
        elif word[0] in VOWELS:
            rv = next((i + 1 for i in range(2, len(word)) if word[i] not in VOWELS), len(word))
        else:
            rv = 3
    return rv, r1, r2


def _ends(word: str, suffixes, region: int) -> str | None:
    """The longest suffix the word ends in, if it lies in the region."""
    for s in suffixes:
        if word.endswith(s):
            return s if len(word) - len(s) >= region else None
    return None


_STEP1 = _by_length(
    [*STEP1_DELETE, *STEP1_IC, "logía", "logías", "ución", "uciones", "encia", "encias", "amente", "mente", "idad", "idades", "iva", "ivo", "ivas", "ivos"]
)


def _standard_suffix(w: str, r1: int, r2: int) -> str | None:
    s = next((x for x in _STEP1 if w.endswith(x)), None)
    if s is None:
        return None
    at = len(w) - len(s)
    if s == "amente":
        if at < r1:
            return None
        w = w[:at]
        for t, inner in (("iv", ("at",)), ("os", ()), ("ic", ()), ("ad", ())):
            if w.endswith(t) and len(w) - 2 >= r2:
                w = w[:-2]
                for u in inner:
                    if w.endswith(u) and len(w) - 2 >= r2:
                        w = w[:-2]
                break
        return w
    if at < r2:
        return None
    stem = w[:at]
    if s in ("logía", "logías"):
        return stem + "log"
    if s in ("ución", "uciones"):
        return stem + "u"
    if s in ("encia", "encias"):
        return stem + "ente"
    before = {"mente": ("ante", "able", "ible"), "idad": ("abil", "ic", "iv"), "idades": ("abil", "ic", "iv")}.get(s)
    if before is None:
        before = ("at",) if s in ("iva", "ivo", "ivas", "ivos") else ("ic",) if s in STEP1_IC else ()
    for t in before:
        if stem.endswith(t) and len(stem) - len(t) >= r2:
            return stem[: -len(t)]
    return stem


def _verb_suffix(w: str, rv: int) -> str | None:
    s = _ends(w, _Y2, rv)
    if s and w[: -len(s)].endswith("u"):
        return w[: -len(s)]
    for s in _by_length([*STEP2_DELETE, *STEP2_EN]):
        if w.endswith(s) and len(w) - len(s) >= rv:
            stem = w[: -len(s)]
            if s in STEP2_EN and stem.endswith("gu") and len(stem) - 1 >= rv:
                stem = stem[:-1]
            return stem
    return None


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """The stem of a lower-case word, accents removed."""
    w = word
    rv, r1, r2 = regions(w)
    s = next((x for x in _PRONOUNS if w.endswith(x)), None)
    if s:
        base = w[: -len(s)]
        for g in GERUNDS_ACCENTED:
            if base.endswith(g) and len(base) - len(g) >= rv:
                w = base[: -len(g)] + GERUNDS_ACCENTED[g]
                break
        else:
            for g in (*GERUNDS, "yendo"):
                if base.endswith(g) and len(base) - len(g) >= rv and (g != "yendo" or base[:-5].endswith("u")):
                    w = base
                    break
    out = _standard_suffix(w, r1, r2)
    if out is None:
        out = _verb_suffix(w, rv)
    w = w if out is None else out
    for s in ("os", "a", "o", "á", "í", "ó", "e", "é"):
        if w.endswith(s) and len(w) - len(s) >= rv:
            w = w[: -len(s)]
            if s in ("e", "é") and w.endswith("gu") and len(w) - 1 >= rv:
                w = w[:-1]
            break
    return w.translate(str.maketrans("áéíóú", "aeiou"))
