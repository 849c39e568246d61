"""Personal information in free text: found, typed, and replaced by placeholders.

Regular expressions propose spans; checksums (DNI/NIE letters, CPF, Luhn, IBAN mod 97)
confirm those of a known shape; words just before a span raise or lower its score, so that a bare
number is an identity number or a telephone only where the text says so. Spans that reach
their kind's score are kept, the surer ones first where they overlap.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from sparkdex.llm.terms import fold

PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "name": "[NAME]"}
_RANK = {"email": 0, "id_number": 1, "phone": 2, "address": 3, "name": 4}

#: Frequent given names of the languages covered, folded.
GIVEN_NAMES = set(
    """adrian alberto alejandro alicia alvaro amelia ana andrea andres angela antonio beatriz benjamin berta bruno camila
    carla carlos carmen carolina cecilia clara claudia cristina daniel david diego eduardo elena elisa eloy emilia enrique
    ernesto esteban felipe fernanda fernando francisco gabriel gael gloria guillermo gustavo hector hugo ignacio ines irene
    isabel ivan jaime javier joaquin jorge jose juan juana julia julio laura lorena lucas lucia luis luisa manuel marcos
    margarita maria mariana mario marta martin mateo mercedes miguel monica natalia nelida nicolas noelia nora nuria oscar
    pablo patricia paula pedro pilar rafael ramon raquel raul ricardo roberto rocio rodrigo rosa ruben salvador samuel
    sandra santiago sara sergio silvia simon sofia susana teresa tomas valentina vicente victor violeta yamila yolanda zacarias
    alan alice amy arthur charles claire donald dorothy edith edward edwin elizabeth emma eric frank george grace harold harry
    helen henry hazel howard ivy jack james jane joan john joyce keith kevin linda lydia margaret mark mary michael miles nancy oliver
    peter philip phoebe ralph robert roland rose ruth sarah stanley stella stephen susan thomas tobias walter wendy william
    afonso antonia caio duarte joana joao paulo thiago""".split()
)
_WORD = r"[^\W\d_][^\W\d_'’\-]*"
#: Words no part of a name may be, whatever their case.
_STOP = set(
    """a al and apto ask at av avenida by calle call called carne cel com con correo cuyo da dni do doc documento
    e el em en endereco for from has he her his home i id identidad identidade identificacion identity is jr la lane
    le lives llamo ligou los mi mora move my na no of on or para phoned por que responda reply road se she soy su sobre
    street tel telefone telefono the to un una vive vivo visit with y your""".split()
)

# --- e-mail ------------------------------------------------------------------------
_EMAIL_SIGN = re.compile(r"@|\[at\]|\(at\)|\[arroba\]|\(arroba\)|\(a\)| at | arroba ", re.I)
_LOCAL = re.compile(r"(?:[\w+\-]+ ?(?: dot | punto | ponto |\[dot\]|\(dot\)|\(punto\)) ?)*[A-Za-z0-9](?:[\w.+\-]*[\w\-])?$", re.I)
_PLAIN_DOMAIN = re.compile(r"[A-Za-z0-9](?:[\w\-]*)(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}(?![\w\-])")
_SPELLED_DOMAIN = re.compile(r"[A-Za-z0-9][\w\-]*(?:(?: ?(?:\[dot\]|\(dot\)|\(punto\)|\[punto\]) ?| (?:dot|punto|ponto) |\.)[A-Za-z0-9\-]+)*(?: ?(?:\[dot\]|\(dot\)|\(punto\)|\[punto\]) ?| (?:dot|punto|ponto) |\.)[A-Za-z]{2,}(?![\w\-])", re.I)

# --- numbers -----------------------------------------------------------------------
_NUMBER = re.compile(r"(?<![\w+])(?<![\d][.,\-/])(?:[XYZ]-?\d{7}-?[A-Z](?!\w)|\+?\(?\d(?:[\d]|[ .\-()](?=[\d(])|\)[ .\-]?(?=\d))*\d(?:-?[A-Z](?![\w]))?)(?![\w@])", re.I)
_PHONE_WORD = re.compile(
    r"(?:\btel|\btel[eé]fono|\btelefone|\bphone|\bphoned|\bcall(?:ed)?|\bring|\bcel|\bcelular|\bm[oó]vil|\bmobile|\bwhatsapp|\bllam\w*|\bligue|\bligou|\bfone|\bfax|\bmarque|\bdial|\btext)\b[^\d\n;]{0,14}$", re.I
)
_ID_WORD = re.compile(
    r"(?:\bdni|\bnie|\bnif|\bcpf|\brg|\bruc|\bssn|\bid(?: no\.?| number)?|\bc[eé]dula|\bcurp|\bidenti(?:dad|dade|ficaci[oó]n|ty|fication)|\bpasaporte|\bpassport|\bcarn[eé](?: de identidad)?|\bnational id|\biban|\btarjeta|\bcard)\b[^\d\n;+]{0,16}$", re.I
)
_NOT_ID = re.compile(r"(?:\brid|\blote|\bbatch|\breferen\w+|\brelease|\bversi[oó]n|\bc[oó]digo|\bbarcode|\bbarras|\bregistro|\brecord|\border|\bwhere id =|\bid = ?|\bcoord\w*|\bisbn|\bexpediente)[^\d\n]{0,12}$", re.I)
_IBAN = re.compile(r"[A-Z](?<!\w\w)[A-Z]\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b")
#: Letters and digits of an IBAN, by country.
_IBAN_LENGTHS = {
    w[:2]: int(w[2:])
    for w in """AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18
    FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HN28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27
    MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23
    ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30""".split()
}
#: First digits, and number of digits, of payment cards; a bare Luhn digit alone fits one number in ten.
_CARD = re.compile(r"3[47]\d{13}|1\d{14}|(?!\d{15}$)(?:2[2-7]|3[05689]|[4-6]|81|9792)\d{11,17}")


def dni_letter(number: int) -> str:
    """The control letter of a Spanish identity number."""
    return "TRWAGMYFPDXBNJZSQVHLCKE"[number % 23]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def iban_valid(text: str) -> bool:
    s = re.sub(r"\s", "", text).upper()
    return len(s) >= 15 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def cpf_valid(digits: str) -> bool:
    if len(digits) != 11 or len(set(digits)) == 1:
        return False
    for n in (9, 10):
        s = sum(int(d) * (n + 1 - i) for i, d in enumerate(digits[:n])) * 10 % 11 % 10
        if s != int(digits[n]):
            return False
    return True


def identity_checksum(text: str) -> bool:
    """True where a control letter or digit of a known scheme fits."""
    s = re.sub(r"[ .\-]", "", text).upper()
    if re.fullmatch(r"\d{8}[A-Z]", s):
        return dni_letter(int(s[:8])) == s[8]
    if re.fullmatch(r"[XYZ]\d{7}[A-Z]", s):
        return dni_letter(int("XYZ".index(s[0]) * 10**7 + int(s[1:8]))) == s[8]
    if s.isdigit() and len(s) == 11:
        return cpf_valid(s)
    return s.isdigit() and 13 <= len(s) <= 19 and luhn(s)


def _iban_end(text: str, m: re.Match) -> int | None:
    """Where the IBAN that starts at a match of _IBAN ends: capitals after it may have matched too."""
    most = _IBAN_LENGTHS.get(m.group()[:2])
    if most is None:
        return m.end() if "iban" in text[max(0, m.start() - 44) : m.start()].lower() and iban_valid(m.group()) else None
    places = [i for i in range(m.start(), m.end()) if text[i] != " "]
    if len(places) < most:
        return None
    end = places[most - 1] + 1
    return end if not text[end : end + 1].isalnum() and iban_valid(text[m.start() : end]) else None


def _ibans(text: str) -> Iterator[Span]:
    at = 0
    while m := _IBAN.search(text, at):
        end = _iban_end(text, m)
        if end:
            yield Span(m.start(), end, "id_number", 1.0)
        at = end or m.start() + 2  # what is none may have reached over the next one's start


def _confirmed(text: str) -> bool:
    """True where the checksum of a known scheme fits and, for cards, the first digits and the length too."""
    s = re.sub(r"[ .\-]", "", text)
    return identity_checksum(text) and (len(s) <= 11 or _CARD.fullmatch(s) is not None)


# --- addresses -----------------------------------------------------------------------
_FLAT = r"(?:,? (?:piso|dpto\.?|depto\.?|departamento|int\.?|interior|oficina|of\.|apto\.?|apartamento|casa|bloque|andar|sala|puerta|esc\.)\s?(?:n\.?[º°]\s?)?\w+)*(?:, (?:urb\.|urbanizaci[oó]n|barrio|bairro|col\.)\s[^\W\d_]+)?"
_STREET = re.compile(
    r"\b(?:(?:calle|c/|jir[oó]n|jr\.|avenida|av\.|avda\.|pasaje|psje\.|pje\.|prolongaci[oó]n|prol\.|malec[oó]n)\s?|(?:alameda|carretera|paseo|camino|plaza|rua|travessa|pra[cç]a)\s(?=(?-i:[^\W\d_a-zà-ÿ])))"
    r"(?:(?:de|del|la|las|los|da|do|dos|san|santa)\s)*[^\W\d_]+(?:\s[^\W\d_]+){0,2}?,?\s(?:n\.?\s?[º°]\.?\s?|n[uú]m\.?\s?|nro\.?\s?|no\.\s?|#\s?)?\d+(?:\s?-\s?[a-z]\b|[a-z]\b)?" + _FLAT,
    re.I,
)
_COMMON_STREETS = {"alameda", "carretera", "paseo", "camino", "plaza", "rua", "travessa", "praça", "praca"}
_BLOCK = re.compile(r"\b(?:mz\.?|mza\.?|manzana)\s\w{1,2},?\s(?:lt\.?|lote)\s\d+(?:, (?:urb\.|urbanizaci[oó]n|barrio|a\.h\.)\s[^\W\d_]+)?", re.I)
_ENGLISH = re.compile(
    r"(?:\b(?:flat|apt\.?|apartment|unit|suite|room)\s\w{1,4},\s)?\b\d{1,5}[a-z]?\s[^\W\d_]+(?:\s[^\W\d_]+)?\s(?:street|lane|road|avenue|drive|court|close|square|way|terrace|(?:st|ln|rd|ave|dr|blvd)\.)(?!\w)(?:,\s(?:flat|apt\.?|apartment|unit|floor|suite)\s\w{1,4}\b)?",
    re.I,
)

# --- names -----------------------------------------------------------------------------
_NAME_BEFORE = re.compile(
    r"(?:\b(?:Sra?|Srta|Sres|Dra?|Lic|Ing|Mrs?|Ms|Prof)\.|\b(?:Mrs?|Ms|Miss|Don|Doña|Dona|Señora?|Senhora?)(?= )"
    r"|\ba nombre de|\bem nome de|\bin the name of|\bname of|\b(?:el|la|al|o|a|the) (?:lector|lectora|leitor|leitora|reader|paciente|patient|socio|socia|member)"
    r"|\b(?:soy|sou|I am|I'm|this is|me llamo|my name is|mi nombre es|meu nome é)"
    r"|\b(?:firmado|firma|firmado por|assinado|assinado por|signed|signed by|contacto|contato|contact|remite|from|autor|nombre|nome|name|titular|paciente|patient|lector|reader|leitor)\s?:"
    r"|\b(?:signed|firmado|assinado|atentamente|regards|saludos),"
    r"|\b(?:atendido|atendida|seen|attended|firmado|assinado|signed|recibido|entregado) (?:por|by)"
    r"|\b(?:preguntar|pregunte|perguntar|procurar) por|\bask for|\bfalar com|\b(?:tomo|exemplar|volume|ejemplar|livro|libro|pedido|carta|parcel|book|copy) (?:a|to|para|ao|for))[ \t\n]+",
    re.I,
)
_TOKEN = re.compile(r"(?:[^\W\d_]\.(?=\s)|" + _WORD + r")")
_BLANK = re.compile(r"[ \t]+")
_GAP = re.compile(r"[ \t]+|[ \t]*\n[ \t]*(?=\S)")


@dataclass(frozen=True)
class Span:
    start: int
    end: int
    kind: str
    score: float


def _stops(token: str) -> bool:
    """No part of a name; an initial always may be one."""
    return not token.endswith(".") and fold(token) in _STOP


def _given(token: str) -> bool:
    return fold(token) in GIVEN_NAMES


def _name_end(text: str, at: int, most: int = 4) -> int | None:
    """Where the personal name that starts at `at` ends, or None.

    Either every part is capitalised, or the name is written in lower case and holds a
    known given name. "Surname, Given" is one name where the part after the comma is
    short and followed by a mark or an unrelated word.
    """
    m = _TOKEN.match(text, at)
    if not m or _stops(m.group()):
        return None
    upper = m.group()[0].isupper()
    parts, end = [m.group()], m.end()
    shout = len(m.group()) > 2 and m.group().isupper()
    while len(parts) < most:
        g = _GAP.match(text, end)
        t = _TOKEN.match(text, g.end()) if g and "\n" not in g.group() else None
        if not t or _stops(t.group()) or t.group()[0].isupper() != upper or (shout and len(t.group()) > 2 and not t.group().isupper()):
            break
        parts.append(t.group())
        end = t.end()
    if all(len(p.rstrip(".")) == 1 for p in parts):
        return None
    tail = re.match(r",[ \t]+", text[end : end + 4])
    if tail and len(parts) < most:
        more, to = [], end + tail.end()
        while len(more) < 2:
            t = _TOKEN.match(text, to)
            if not t or _stops(t.group()) or t.group()[0].isupper() != upper:
                break
            more.append(t.group())
            after = t.end()
            g = _GAP.match(text, after)
            if not g:
                to = after
                break
            to = g.end()
        if more and not re.match(r"[\w@+.\-]*[@\d_+]|\.\w", text[after : after + 40]):
            alone = len(more) == 1 and len(parts) <= 2 and re.match(r"\s*(?:[<:,;(.]|$)| (?:at|en|em)\b", text[after : after + 8])
            if _given(more[0]) or (alone and upper):
                parts += more
                end = after
    known = any(_given(p) for p in parts) or (not upper and len(parts) > 1 and parts[0].endswith("."))
    if not upper and not known:
        return None
    if upper and not known and len(parts) == 1:
        return None
    return end


def _name_start(text: str, end: int, most: int = 5) -> int | None:
    """Where the name that ends at `end` begins, or None: back to the sentence's start or the case's change."""
    left = max(0, end - 90)
    piece = text[left:end]
    cut = max([m.end() for m in re.finditer(r"(?:(?<=[^\W\d_]{2})[.!?…»)\"]+|[!?…»)\"]+|\n+|\s-\s|:)[ \t\n]*", piece)] or [0])
    tokens = [m for m in _TOKEN.finditer(piece, cut)]
    if not tokens:
        return None
    upper = tokens[-1].group()[0].isupper()
    k = len(tokens) - 1
    while k > 0 and len(tokens) - k < most and tokens[k - 1].group()[0].isupper() == upper and not _stops(tokens[k - 1].group()):
        if not re.fullmatch(r",?[ \t]+", piece[tokens[k - 1].end() : tokens[k].start()]):
            break
        k -= 1
    if k > 0 and not upper:  # a lower-case name starts with its known given name, or one surname before it
        known = [i for i in range(k, len(tokens)) if _given(tokens[i].group())]
        if not known:
            return None
        k = known[0] if known[0] < len(tokens) - 1 else max(k, known[0] - 2)
    if not any(_given(t.group()) for t in tokens[k:]) and len(tokens) - k < 2:
        return None
    return left + tokens[k].start()


def _digits(s: str) -> int:
    return sum(c.isdigit() for c in s)


#: Words that announce a span, by the pattern to try around them.
_CUES = {
    "email": "@|[at]|(at)|[arroba]|(arroba)|(a)| at | arroba ",
    "street": "calle |c/|jirón |jiron |jr.|avenida |av.|avda.|pasaje |psje.|pje.|prolongaci|prol.|alameda |malec|carretera |paseo |camino |plaza |rua |travessa |praça |praca ",
    "block": " lt.| lt | lote ",
    "english": " street| lane| road| avenue| drive| court| close| square| way| terrace| st.| ln.| rd.| ave.| dr.| blvd.",
    "after": "llamó desde|llamo desde|ligou d|phoned from|called from|rang from",
    "before": "sra.|sr.|srta.|sres.|dra.|dr.|lic.|ing.|mr|ms|miss |prof.|don |doña |dona |señor|senhor|nombre de|nome de|name of|lector|leitor|reader|paciente|patient|socio|socia|member"
    "|soy |sou |i am|i'm|this is|me llamo|name is|nombre es|nome é|firma|assinado|signed|contacto|contato|contact|remite|from:|autor|nombre:|nome:|name:|titular|atendid|seen by|attended|recibido por|entregado por"
    "|atentamente|regards|saludos|preguntar|pregunte|perguntar|procurar|ask for|falar com|tomo |exemplar |volume |ejemplar |livro |libro |pedido |carta |parcel |book |copy ",
}


@lru_cache(maxsize=1)
def _cues():
    import ahocorasick

    kinds: dict[str, set[str]] = {}
    for kind, words in _CUES.items():
        for w in words.split("|"):
            kinds.setdefault(w, set()).add(kind)
    a = ahocorasick.Automaton()
    for w, k in kinds.items():
        a.add_word(w, (len(w), tuple(k)))
    a.make_automaton()
    return a


_DIGITS = re.compile(r"\d[\d .()\-]{4,}\d")
_SHAPE = re.compile(r"[XYZ]-?\d{7}-?[A-Z]|\d{8}-?[A-Z]|\d{2}([ .])\d{3}\1\d{3}|\d{4}-\d{4}|\d{8,11}|\d{3}\.\d{3}\.\d{3}-\d{2}|\d{3}-\d{2}-\d{4}|\d{1,2}\.\d{3}\.\d{3}(?:-[\dkK])?|(?:\d{4}[ -]){3}\d{1,7}|\d{13,19}", re.I)

#: Further shapes, known where the checksum fits.
_CHECKED_SHAPE = re.compile(r"\d{2}\.\d{3}\.\d{3}-?[A-Z]|\d{9}-\d{2}|\d{4}[ -]\d{6}[ -]\d{4,5}|(?:\d{4}[ -]){4}\d{1,3}", re.I)


def _email_at(text: str, a: int, b: int) -> Span | None:
    """The address around the sign text[a:b]."""
    sign = text[a:b].strip().lower()
    if sign == "@":
        left, right = text[a - 1 : a] == " ", text[b : b + 1] == " "
        if left != right:
            return None
        a, b = a - left, b + right
    else:
        a, b = a - (text[a - 1 : a] == " "), b + (text[b : b + 1] == " ")
    low = max(0, a - 64)
    local = _LOCAL.search(text[low:a])
    domain = (_PLAIN_DOMAIN if sign == "@" else _SPELLED_DOMAIN).match(text, b)
    if not local or not domain or (sign in ("at", "arroba") and not re.search(r" (?:dot|punto|ponto) ", domain.group(), re.I)):
        return None
    return Span(low + local.start(), domain.end(), "email", 1.0)


def _number(text: str, m: re.Match) -> Span | None:
    s = m.group()
    n = _digits(s)
    if not 7 <= n <= 19:
        return None
    before = text[max(0, m.start() - 44) : m.start()]
    label, other = _ID_WORD.search(before), _NOT_ID.search(before)
    bad = 0.6 if other else 0
    # a checksum confirms a known shape, or a label; next to a word for other numbers only a label nearer than it
    fits = identity_checksum(s) if label else _confirmed(s)
    fits = fits and (not other or bool(label and label.start() > other.start()))
    known = _SHAPE.fullmatch(s) or (fits and _CHECKED_SHAPE.fullmatch(s))
    ids = (0.6 if label else 0) + (0.5 if fits else 0) + (0.2 if known else 0 if fits else -0.5) - (0 if label and fits else bad)
    tel = (0.6 if _PHONE_WORD.search(before) else 0) + (0.5 if s[0] == "+" else 0) + (0.2 if n <= 15 and not s[-1].isalpha() else -0.6) - bad
    if max(ids, tel) < 0.7:
        return None
    return Span(m.start(), m.end(), "id_number" if ids >= tel else "phone", max(ids, tel))


#: What stands in the way of patterns: twice-encoded letters, runs of blanks, accents written apart.
_UNEVEN = re.compile(r"(?P<twice>[\u00c2-\u00c5][\u0080-\u00bf\u0152-\u0178\u02c6-\u2122])|(?P<blank>[ \t\u00a0\u202f]{2,}|[\t\u00a0\u202f])|(?P<apart>[^\W\d_][\u0300-\u036f]+)")


def _even(text: str) -> tuple[str, list[int], list[int]]:
    """The text with those repaired, and where each of its characters starts and ends in the original."""
    out, first, last, at = [], [], [], 0

    def take(new: str, a: int, b: int) -> None:
        out.append(new)
        if len(new) == b - a:
            first.extend(range(a, b))
            last.extend(range(a + 1, b + 1))
        else:
            first.extend([a] * len(new))
            last.extend([b] * len(new))

    for m in _UNEVEN.finditer(text):
        take(text[at : m.start()], at, m.start())
        s = m.group()
        if m.lastgroup == "twice":
            for code in ("cp1252", "latin-1"):
                try:
                    s = s.encode(code).decode("utf-8")
                    break
                except UnicodeError:
                    continue
        elif m.lastgroup == "blank":
            s = " "
        else:
            s = unicodedata.normalize("NFC", s)
        take(s, m.start(), m.end())
        at = m.end()
    take(text[at:], at, len(text))
    return "".join(out), first, last


def find_spans(text: str) -> list[Span]:
    """All kept spans of a text, in order, not overlapping; positions are those of the text as written."""
    doubtful = "  " in text or "\t" in text or "\u00a0" in text or "\u202f" in text or "Ã" in text or "Â" in text or not unicodedata.is_normalized("NFC", text)
    if not doubtful or not _UNEVEN.search(text):
        return _find(text)
    even, first, last = _even(text)
    return [Span(first[s.start], last[s.end - 1], s.kind, s.score) for s in _find(even)]


def _find(text: str) -> list[Span]:
    out: set[Span] = set()
    low = text.lower()
    if len(low) != len(text):  # letters whose lower case is longer
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    for last, (length, kinds) in _cues().iter(low):
        a, b = last - length + 1, last + 1
        for kind in kinds:
            if kind == "email":
                s = _email_at(text, a, b)
                if s:
                    out.add(s)
            elif kind == "before":
                for m in _NAME_BEFORE.finditer(text, max(0, a - 30), b + 14):
                    end = _name_end(text, m.end())
                    if end:
                        out.add(Span(m.end(), end, "name", 0.8))
            elif kind == "after":
                m = _BLANK.search(text, max(0, a - 1), a)
                start = _name_start(text, m.start()) if m else None
                if start is not None:
                    out.add(Span(start, m.start(), "name", 0.8))
            elif kind == "street":
                m = _STREET.match(text, a)
                if m and m.group().isupper() and low[a:b].strip() in _COMMON_STREETS and not re.search(r"[º#]", m.group()):
                    m = None  # a shouted sentence, not a street
                if m and not (a and text[a - 1].isalnum()) and not re.search(r"\b(?:grupo|banda|novela|romance|plaza)\s$", text[max(0, a - 10) : a], re.I):
                    out.add(Span(m.start(), m.end(), "address", 0.9))
            elif kind == "block":
                out.update(Span(m.start(), m.end(), "address", 0.9) for m in _BLOCK.finditer(text, max(0, a - 16), b + 60) if m.start() < a < m.end())
            elif kind == "english":
                lo = max(0, a - 60)
                out.update(Span(m.start(), m.end(), "address", 0.85) for m in _ENGLISH.finditer(text, lo, b + 30) if m.start() < a < m.end())
    out.update(_ibans(text))
    for d in _DIGITS.finditer(text):
        for m in _NUMBER.finditer(text, max(0, d.start() - 3), min(len(text), d.end() + 3)):
            s = _number(text, m)
            if s:
                out.add(s)
    out = list(out)
    out.sort(key=lambda s: (-s.score, _RANK[s.kind], s.start, -s.end))
    kept: list[Span] = []
    for s in out:
        if all(s.end <= k.start or s.start >= k.end for k in kept):
            kept.append(s)
    return sorted(kept, key=lambda s: s.start)


def redact(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its placeholder and nothing else changed."""
    parts, at = [], 0
    for s in spans:
        parts += [text[at : s.start], PLACEHOLDERS[s.kind]]
        at = s.end
    return "".join([*parts, text[at:]])


def find_personal(documents: DataFrame) -> DataFrame:
    """(doc_id, kind, found_text, start, end) of every span of (doc_id, text).

    start and end are character positions. A value that occurs several times in a text
    gives a row each time. Null and empty texts give none. Texts are read whole, each by
    itself: there is no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, kind, found, start, end = [], [], [], [], []
            for i, t in enumerate(b.column("text").to_pylist()):
                for s in find_spans(t) if t else ():
                    at.append(i)
                    kind.append(s.kind)
                    found.append(t[s.start : s.end])
                    start.append(s.start)
                    end.append(s.end)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(at, pa.int64())), pa.array(kind, pa.string()), pa.array(found, pa.string()), pa.array(start, pa.int32()), pa.array(end, pa.int32())],
                names=["doc_id", "kind", "found_text", "start", "end"],
            )

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, kind string, found_text string, start int, end int")


def redact_personal(documents: DataFrame) -> DataFrame:
    """(doc_id, n_found, text) with typed placeholders; null texts stay null with 0 found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, out = [], []
            for t in b.column("text").to_pylist():
                spans = find_spans(t) if t else []
                n.append(len(spans))
                out.append(redact(t, spans) if spans else t)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int32()), pa.array(out, pa.string())], names=["doc_id", "n_found", "text"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_found int, text string")
