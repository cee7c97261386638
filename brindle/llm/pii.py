"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, plus signs, digits,
URL schemes and account cues.  At each anchor a deterministic local parser
expands to the left and right and validates; nothing else of the text is
looked at.  The base kinds equal a left-to-right non-overlapping scan with

* ``email`` ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``
* ``ip`` ``[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)``, parts at most 255
* ``card`` ``[0-9]([\\x20-]?[0-9])+``, 12 to 19 digits passing Luhn
* ``phone`` ``\\+[0-9][\\x20().0-9-]+[0-9]``, 9 to 15 digits

and the anchors add ``url`` (scheme with a valid host, ``mailto:`` with an
address), ``iban`` (behind a cue, as long as its country has them, mod-97),
``account`` (6 to 17 digits behind a cue) and ``secret`` (16 or more characters
of a key or token, digits among them, behind a cue and ``=`` or ``:``).  Schemes
and cues are found whatever their case.

Null texts count as empty and give no spans; a row with a null id is returned
like any other; extra columns are left out, whatever their names; repeated rows
give repeated results; texts of any length are searched whole; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Kinds in the order of the digest, then those that the anchors add.
BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("url", "iban", "account", "secret")
KINDS = BASE_KINDS + ADDED_KINDS
RANK = {kind: i for i, kind in enumerate(KINDS)}
SCHEMES = ("http://", "https://", "ftp://", "mailto:")
CUES = ("account", "acct", "iban", "konto", "compte", "cuenta")
SECRET_CUES = ("token", "secret", "password", "passwd", "api_key", "apikey", "api-key", "access_key", "access-key", "private_key", "bearer")
# Characters of an IBAN by country (ISO 13616).
IBAN_SIZES = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29,
    "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20,
    "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29,
    "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}

LOCAL_CHARS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]+")
ADDRESS = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
HOST = re.compile(r"(?:[^\s/?#@<>\"']*@)?([A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)(?::[0-9]{1,5})?(?:[/?#][^\s<>\"']*)?")
ACCOUNT = re.compile(r"(?:\s*(?:number|num|no|nr|n°|numéro|número|nummer|id)\b\.?)?(?:\s+(?:is|ist|est|es)\b)?\s*[:#=]?\s*", re.I)
IBAN_HEAD = re.compile(r"([A-Z]{2})[0-9]{2}", re.I)
PLAIN = re.compile(r"[0-9](?:[ -]?[0-9]){5,16}(?![0-9])")
KEY = r"[\"'`]?((?=[A-Za-z_.~+/-]*[0-9])[A-Za-z0-9_.~+/-]{16,}=*)"
SECRET, BEARER = re.compile(r"[\"']?\s*[=:]\s*" + KEY), re.compile(r"\s+" + KEY)


_LOWER = {c: c + 32 for c in range(65, 91)}


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(d - 9 if d > 9 else d for d in (2 * int(c) for c in digits[-2::-2]))) % 10 == 0


def iban_end(text: str, start: int) -> int:
    """Where a valid IBAN that begins at start ends, or -1; single spaces may part its characters."""
    head = IBAN_HEAD.match(text, start)
    size = IBAN_SIZES.get(head[1].upper(), 0) if head else 0
    at, found = start, ""
    while len(found) < size:
        if text[at : at + 1] == " " and found:
            at += 1
        char = text[at : at + 1]
        if not (char.isascii() and char.isalnum()):
            return -1
        at, found = at + 1, found + char.upper()
    if not size or (following := text[at : at + 1]).isalnum() and following.isascii():
        return -1
    return at if int("".join(str(int(c, 36)) for c in found[4:] + found[:4])) % 97 == 1 else -1


def folded(text: str) -> str:
    """text with letters lowered, at the same places."""
    low = text.lower()
    return low if len(low) == len(text) else text.translate(_LOWER)


def anchors():
    """The automaton over folded texts: each anchor with the parser it starts."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for char in "0123456789":
        found.add_word(char, ("digit", 1))
    found.add_word("@", ("at", 1))
    found.add_word("+", ("plus", 1))
    for what, cues in (("scheme", SCHEMES), ("cue", CUES), ("secret", SECRET_CUES)):
        for word in cues:
            found.add_word(word, (what, len(word)))
    found.make_automaton()
    return found


def _local_start(text: str, low: int, at: int) -> int:
    """Where the run of local-part characters that ends at ``at`` begins, at ``low`` or later."""
    width = 64
    while True:
        begin = max(low, at - width)
        part = text[begin:at]
        start = begin + len(part.rstrip(LOCAL_CHARS))
        if start > begin or begin == low:
            return start
        width *= 8


def find_spans(text: str, automaton) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start and then kind."""
    spans: list[tuple[str, int, int]] = []
    email = ip = card = phone = added = 0  # where the next match of a kind may begin
    for last, (what, size) in automaton.iter(folded(text)):
        pos = last - size + 1
        if what == "digit":
            if pos >= card:
                if m := CARD.match(text, pos):
                    card = m.end()
                    digits = m[0].replace(" ", "").replace("-", "")
                    if 12 <= len(digits) <= 19 and luhn(digits):
                        spans.append(("card", pos, card))
                else:
                    card = pos + 1
            if pos >= ip:
                if m := IP.match(text, pos):
                    ip = m.end()
                    if all(len(x := part.lstrip("0")) <= 3 and int(x or "0") <= 255 for part in m.groups()):
                        spans.append(("ip", pos, ip))
                else:  # no start inside the same run of digits can match either
                    ip = DIGITS.match(text, pos).end()
        elif what == "at":
            start = _local_start(text, email, pos)
            if start < pos and (m := DOMAIN.match(text, pos + 1)):
                email = m.end()
                spans.append(("email", start, email))
        elif what == "plus":
            if pos >= phone and (m := PHONE.match(text, pos)):
                phone = m.end()
                if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                    spans.append(("phone", pos, phone))
        elif what == "scheme":
            if pos < added:
                continue
            if text[pos : pos + size].lower() == "mailto:":
                m = ADDRESS.match(text, last + 1)
            else:
                m = HOST.match(text, last + 1)
            if m:
                added = m.end()
                spans.append(("url", pos, added))
        elif pos >= added and (pos == 0 or not text[pos - 1].isalnum()):
            if what == "secret":
                if m := (BEARER if text[pos : last + 1].lower() == "bearer" else SECRET).match(text, last + 1):
                    added = m.end()
                    spans.append(("secret", m.start(1), added))
                continue
            m = ACCOUNT.match(text, last + 1)
            start = m.end()
            if start > last + 1 and (end := iban_end(text, start)) > 0:
                spans.append(("iban", start, added := end))
            elif start > last + 1 and (m := PLAIN.match(text, start)):
                spans.append(("account", start, added := m.end()))
    spans.sort(key=lambda x: (x[1], RANK[x[0]]))
    return spans


SPAN_SCHEMA = "doc_id long, kind string, start long, end long, value string"


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per span: doc_id, kind, start, end (code points, end exclusive) and the text of the span."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = anchors()
        for batch in batches:
            rows = [(i, k, a, b, t[a:b]) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for k, a, b in find_spans(t or "", automaton)]
            ids, kinds, starts, ends, values = zip(*rows) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(kinds, pa.string()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), pa.array(values, pa.string())], names=["doc_id", "kind", "start", "end", "value"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SPAN_SCHEMA)


DIGEST_SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long"


def personal_data_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts of the base kinds, the digest of base spans, all spans and their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = anchors()
        for batch in batches:
            counts: list[list[int]] = [[], [], [], []]
            digests, listed, n_spans = [], [], []
            for text in batch.column(1).to_pylist():
                spans = find_spans(text or "", automaton)
                kinds = [k for k, _, _ in spans]
                for into, kind in zip(counts, BASE_KINDS):
                    into.append(kinds.count(kind))
                said = [f"{k}:{a}:{b}" for k, a, b in spans]
                digests.append(hashlib.sha256(",".join(s for s, k in zip(said, kinds) if k in BASE_KINDS).encode()).hexdigest())
                listed.append(",".join(said))
                n_spans.append(len(said))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(listed, pa.string()), pa.array(n_spans, pa.int64())], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, DIGEST_SCHEMA)
