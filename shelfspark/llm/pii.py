"""Personal data (operator 5): regular expressions propose spans, checksums confirm them, context adjusts the score.

Base kinds: email, ip, card (Luhn) and phone (with a leading +). Their confirmed spans always
stay. Further kinds, kept at a score of at least MIN_SCORE: iban (mod-97), national_phone and ssn (both
need a context word nearby), where they overlap no span of a kind before; and secret, which may overlap
others: keys and tokens of known forms and values given to names such as password or token, each to its
end whatever its length, and private keys from their BEGIN line to their END line (without one, to the end
of their lines of base 64).

Offsets are code points, ends exclusive. A null text is empty and has no spans. Rows are
independent: repeated rows, other columns and empty tables pass through; the time for a text
grows with its length (no pattern is retried from inside a run it has rejected, but for the
at most 34 characters and blanks of an iban, which ends at its country's length or, of another
country, at the last word end that mod-97 confirms).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.llm.common import append_arrow, free_name

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "national_phone", "ssn", "secret")
MIN_SCORE = 0.6
#: Characters before and after a span that are searched for context words.
CONTEXT = 40
CONTEXT_WORDS = {
    "email": ("mail", "contact", "write", "correo", "courriel"),
    "ip": ("ip", "server", "host", "address", "login"),
    "card": ("card", "credit", "visa", "karte", "carte", "tarjeta", "payment"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "whatsapp"),
    "iban": ("iban", "bank", "account", "konto", "compte", "cuenta"),
    "national_phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "whatsapp"),
    "ssn": ("ssn", "social security", "social-security"),
    "secret": ("key", "token", "secret", "password", "credential", "authorization", "bearer"),
}
#: Score of a confirmed pattern without context; context words add CONTEXT_GAIN.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.8, "national_phone": 0.4, "ssn": 0.4, "secret": 0.6}
CONTEXT_GAIN = 0.3

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_NATIONAL = re.compile(r"(?<![0-9+A-Za-z])(?:\([0-9]{2,5}\)\x20?|0[0-9]{1,4}[\x20/-]|[0-9]{3}[\x20.-])[0-9]{3,4}(?:[\x20.-]?[0-9]{2,4}){1,2}(?![0-9A-Za-z])")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
#: A name, a sign and a value of at least eight characters; the value alone is the span, to its end.
_NAMED = re.compile(r"(?i)(?<![a-z])(?:api[_-]?key|access[_-]?key|private[_-]?key|secret|token|password|passwd|pwd)(?:[_-][a-z]{1,12})?[\x20\"']{0,3}[:=][\x20\"']{0,3}([^\s\"'<>,;]{8,}+)")
_FORMS = re.compile(
    r"(?<![A-Za-z0-9_-])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}+|xox[abprs]-[A-Za-z0-9-]{10,}+|sk-[A-Za-z0-9_-]{20,}+|eyJ[A-Za-z0-9_-]{10,}+(?:\.[A-Za-z0-9_-]{10,}+){2,4})(?![A-Za-z0-9_-])"
)
_BEGIN = re.compile(r"-----BEGIN [A-Z0-9\x20]{0,40}PRIVATE KEY(?: BLOCK)?-----")
_END = re.compile(r"-----END [A-Z0-9\x20]{0,40}PRIVATE KEY(?: BLOCK)?-----")
#: Lines of a key without an END line: runs of base 64, the last one short if it is padded.
_LINES = re.compile(r"(?:\s*+[A-Za-z0-9+/=]{16,}+)*+(?:\s*+[A-Za-z0-9+/]{1,15}={1,2})?")
#: Length of an IBAN by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BI": 27, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24,
    "DE": 22, "DJ": 27, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FK": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27,
    "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20,
    "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MN": 20, "MR": 27, "MT": 31, "MU": 30, "NI": 28, "NL": 18, "NO": 15, "OM": 23, "PK": 24, "PL": 28,
    "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "RU": 33, "SA": 24, "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "SO": 23, "ST": 25, "SV": 28,
    "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20, "YE": 30,
}
_HINTS = {kind: re.compile("|".join(rf"(?<![a-z]){re.escape(w)}" for w in words)) for kind, words in CONTEXT_WORDS.items()}


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d = d * 2 if i % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost IBANs. Of what the pattern takes, which may go on into the next words, the part of the country's length or the whole; of other countries the longest part that ends with a word."""
    at = 0
    while m := _IBAN.search(text, at):
        at = m.start() + 1
        ends = [m.end()]
        if size := IBAN_LENGTHS.get(m[0][:2]):
            places = [i for i in range(*m.span()) if text[i] != " "]
            if len(places) > size and text[places[size - 1] + 1] == " ":
                ends.insert(0, places[size - 1] + 1)
        else:
            ends += [i for i in range(m.end() - 1, m.start() + 14, -1) if text[i] == " "]
        for end in ends:
            iban = text[m.start() : end].replace(" ", "")
            if len(iban) >= 15 and mod97(iban):
                yield m.start(), end
                at = end
                break


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local@domain: an @ with a domain, and the run of local characters before it."""
    done = 0
    for m in _DOMAIN.finditer(text):
        at = start = m.start()
        while start > done:  # back over local characters, a block at a time
            block = text[max(done, start - 64) : start]
            n = _LOCAL.match(block[::-1]).end()
            start -= n
            if n < len(block):
                break
        if start < at:
            done = m.end()
            yield start, done


def _keys(text: str) -> Iterator[tuple[int, int]]:
    """Blocks of private keys. An END line closes the last BEGIN line before it."""
    begins = [m.span() for m in _BEGIN.finditer(text)]
    ends = [m.span() for m in _END.finditer(text)] if begins else []
    k = 0
    for i, (start, inside) in enumerate(begins):
        after = begins[i + 1][0] if i + 1 < len(begins) else len(text)
        while k < len(ends) and ends[k][0] < inside:
            k += 1
        yield (start, ends[k][1]) if k < len(ends) and ends[k][0] < after else (start, _LINES.match(text, inside).end())


def _secrets(text: str) -> Iterator[tuple[int, int]]:
    """Private keys, values of named secrets that mix letters with digits or are twenty characters or longer, and known forms; by rising start, apart."""
    found = [m.span(1) for m in _NAMED.finditer(text) if len(m[1]) >= 20 or (any(c.isdigit() for c in m[1]) and any(c.isalpha() for c in m[1]))]
    found += [m.span() for m in _FORMS.finditer(text)]
    found += _keys(text)
    yield from _joined(found)


def _apart(places: Iterator[tuple[int, int]], taken: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Those of places that overlap nothing taken; both by rising start, taken disjoint: one pass."""
    k = 0
    for a, b in places:
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        if k == len(taken) or b <= taken[k][0]:
            yield a, b


def _joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans, overlapping ones as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(map(_octet, m[0].split("."))):
            found.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append(("phone", *m.span()))
    return found


def _score(text: str, kind: str, start: int, end: int) -> float:
    near = f"{text[max(0, start - CONTEXT) : start]} | {text[end : end + CONTEXT]}".lower()
    return min(1.0, PRIOR[kind] + (CONTEXT_GAIN if _HINTS[kind].search(near) else 0.0))


def find_spans(text: str | None) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by kind as in KINDS, then start."""
    if not text:
        return []
    spans = base_spans(text)
    taken = _joined([(a, b) for _, a, b in spans])
    out = [(k, a, b, _score(text, k, a, b)) for k, a, b in spans]
    further = (("iban", _ibans(text)), ("national_phone", (m.span() for m in _NATIONAL.finditer(text))), ("ssn", (m.span() for m in _SSN.finditer(text))), ("secret", _secrets(text)))
    for kind, places in further:
        more = []
        for a, b in places if kind == "secret" else _apart(places, taken):
            if kind == "national_phone" and not 7 <= sum(c.isdigit() for c in text[a:b]) <= 12:
                continue
            if (score := _score(text, kind, a, b)) >= MIN_SCORE:
                more.append((a, b))
                out.append((kind, a, b, score))
        if more:
            taken = _joined([*taken, *more])
    return out


SPANS = T.ArrayType(
    T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())])
)
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))


def detect(df: DataFrame, text: str = "text", spans: str = "pii") -> DataFrame:
    """df with the array of spans (kind, start, end, score) of its texts."""

    def make() -> Callable:
        names = ("kind", "start", "end", "score")
        return lambda batch: [pa.array([[dict(zip(names, s, strict=True)) for s in find_spans(t)] for t in batch.column(batch.schema.get_field_index(text)).to_pylist()], _ARROW)]

    return append_arrow(df, make, [T.StructField(spans, SPANS)], sized_by=text)


def masked(text: str | None) -> str | None:
    """text with each span replaced by [KIND]; overlapping spans are one, named after the first."""
    if not text:
        return text
    out, done, spans = [], 0, sorted((a, -b, k) for k, a, b, _ in find_spans(text))
    for a, b, kind in spans:
        if a >= done:
            out += [text[done:a], f"[{kind.upper()}]"]
        done = max(done, -b)
    return "".join([*out, text[done:]])


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """df with personal data in its texts replaced by the kind in brackets; null stays null."""
    order = df.columns

    def make() -> Callable:
        return lambda batch: [pa.array([masked(t) for t in batch.column(batch.schema.get_field_index(text)).to_pylist()], pa.string())]

    new = free_name(df, "masked")
    made = append_arrow(df, make, [T.StructField(new, T.StringType())], sized_by=text)
    return made.select(*[F.col(f"`{new}`").alias(text) if c == text else F.col(f"`{c}`") for c in order])


def listed(spans: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
