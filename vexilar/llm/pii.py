"""Personal data: patterns propose spans, checksums confirm them, and nearby words adjust a score.

Every pattern is run from the character it needs ('@', '+', a run of digits), so a text costs one pass and no
pattern backtracks over a run twice.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vexilar.llm.arrow import map_arrow
from vexilar.llm.text import own_columns

# Fixed values of the contract: the kinds in their order, and their patterns. A lookbehind keeps a search from
# starting inside a run of digits, where the same characters have already failed or matched.
BASE_KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]*\Z")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = frozenset("0123456789")
NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")

#: The method's own kinds, after the base ones.
METHOD_KINDS = ("iban", "national_id")
IBAN_HEAD = re.compile(r"(?<![A-Za-z0-9])(?:[A-Z]{2}|[a-z]{2})[0-9]{2}")
# Characters of an account number by country, from the public register.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29,
    "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20,
    "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25,
    "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}
NATIONAL_ID = re.compile(r"(?<![0-9-])(?!000|666|9[0-9]{2})[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")

# Words near a span that speak for (or against) each kind, in several languages.
CONTEXT = {
    "email": ("mail", "email", "contact", "correo", "courriel"),
    "ip": ("ip", "address", "server", "host"),
    "card": ("card", "visa", "mastercard", "credit", "tarjeta", "carte", "karte"),
    "phone": ("phone", "call", "tel", "mobile", "telefon", "teléfono", "téléphone"),
    "iban": ("iban", "bank", "account", "konto", "cuenta", "compte"),
    "national_id": ("ssn", "social", "security", "insurance"),
}
AGAINST = {"ip": ("version", "release"), "card": ("isbn", "serial", "order"), "phone": ("version",), "iban": (), "email": (), "national_id": ("order", "part")}
BASE_SCORE = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.6, "iban": 0.9, "national_id": 0.4}
#: Account numbers in small letters need a word of their context.
SMALL_IBAN = 0.4
#: Characters on either side that are read for context, what a word there adds or takes, and the least score of a
#: span of the method's own kinds (base spans always stay).
NEAR, STEP, LEAST = 40, 0.2, 0.5


@dataclass(frozen=True)
class Span:
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    """Mod-10 check of a string of ASCII digits."""
    total = sum(int(d) for d in digits[-1::-2]) + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for d in digits[-2::-2])
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """ISO 7064 check of an IBAN without spaces."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def _emails(text: str):
    at, done = text.find("@"), 0
    while at >= 0:
        start = at  # of the longest run of local characters that ends here and is not part of an earlier match
        while start > done and not NOT_LOCAL.match(text, start - 1):
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", at + 1)


def _ips(text: str):
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            yield m.span()


def _cards(text: str):
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def _phones(text: str):
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                yield m.span()


def _ibans(text: str):
    """Account numbers of their country's length, in capitals or small letters, with single blanks anywhere between."""
    done = 0
    for m in IBAN_HEAD.finditer(text):
        need = IBAN_LENGTHS.get(m[0][:2].upper())
        if need is None or m.start() < done:
            continue
        at, code, small = m.end(), m[0], m[0].islower()
        while len(code) < need and at < len(text):
            c = text[at]
            if c == " " and at + 1 < len(text) and text[at + 1] != " ":
                at, c = at + 1, text[at + 1]
            if not (c in DIGITS or "a" <= c <= "z" and small or "A" <= c <= "Z" and not small):
                break
            code, at = code + c, at + 1
        ends = at == len(text) or not (text[at].isascii() and text[at].isalnum())
        if len(code) == need and ends and mod97(code):
            yield m.start(), at
            done = at


def _national_ids(text: str):
    for m in NATIONAL_ID.finditer(text):
        yield m.span()


FINDERS = {"email": _emails, "ip": _ips, "card": _cards, "phone": _phones, "iban": _ibans, "national_id": _national_ids}


def _score(text: str, kind: str, start: int, end: int) -> float:
    near = f"{text[max(0, start - NEAR) : start]} {text[end : end + NEAR]}".lower()
    words = set(re.findall(r"\w+", near))
    score = (SMALL_IBAN if kind == "iban" and text[start].islower() else BASE_SCORE[kind]) + STEP * bool(words & set(CONTEXT[kind])) - STEP * bool(words & set(AGAINST[kind]))
    return round(min(1.0, max(0.0, score)), 3)


def find_spans(text: str | None) -> list[Span]:
    """All spans of a text, by kind in the order of BASE_KINDS and METHOD_KINDS, then by start; None: none.

    Offsets are code points, ends exclusive. A kind's spans don't overlap; spans of different kinds may. Base kinds
    stay whatever their score; the method's own need at least LEAST, with the words around them counted.
    """
    if not text:
        return []
    found = [Span(kind, a, b, _score(text, kind, a, b)) for kind in (*BASE_KINDS, *METHOD_KINDS) for a, b in FINDERS[kind](text)]
    return [s for s in found if s.kind in BASE_KINDS or s.score >= LEAST]


def redact(text: str | None) -> str | None:
    """The text with every span replaced by its kind in brackets; spans that overlap are one, named by the first."""
    spans = sorted(find_spans(text), key=lambda s: (s.start, -s.end))
    if not spans:
        return text
    out, at, k = [], 0, 0
    while k < len(spans):
        first, end = spans[k], spans[k].end
        while k + 1 < len(spans) and spans[k + 1].start < end:
            k += 1
            end = max(end, spans[k].end)
        out += [text[at : first.start], f"[{first.kind.upper()}]"]
        at, k = end, k + 1
    return "".join([*out, text[at:]])


SPANS = "array<struct<kind:string,start:int,end:int,score:double>>"


def _make_spans():
    import pyarrow as pa

    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [[{"kind": s.kind, "start": s.start, "end": s.end, "score": s.score} for s in find_spans(t)] for t in batch.column("_text").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(rows, kind)], names=["_id", "spans"])

    return step


def detect(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, spans): every text's spans with kind, start, end and score, one row a row of ``docs``.

    A null or empty text has an empty array. Repeated rows each get a row, ids may be null and of any type, other
    columns are ignored, and an empty table gives no row.
    """
    id_type = dict(docs.dtypes)[doc_id]
    own = own_columns(docs, _id=doc_id, _text=F.col(f"`{text}`").cast("string"))
    return map_arrow(own, _make_spans, f"_id {id_type}, spans {SPANS}", "_text").withColumnRenamed("_id", "doc_id")


def _make_redactions(names: list[str], text: str):
    def make():
        import pyarrow as pa

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            new = pa.array([redact(t) for t in batch.column(text).to_pylist()], pa.string())
            return pa.RecordBatch.from_arrays([new if n == text else batch.column(n) for n in names], names=names)

        return step

    return make


def redact_documents(docs: DataFrame, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """``docs`` with every span in ``text`` replaced by its kind in brackets.

    ``length``, where it is a column, is set to the new number of code points (null for a null text). Rows and other
    columns stay as they are.
    """
    new = map_arrow(docs, _make_redactions(docs.columns, text), ", ".join(f"`{n}` {t}" for n, t in docs.dtypes), text)
    if length and length in docs.columns:
        new = new.withColumn(length, F.length(text).cast(dict(docs.dtypes)[length]))
    return new.select(docs.columns)
