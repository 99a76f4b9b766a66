"""Personal data: regular expressions propose spans, checksums confirm them, nearby context words adjust the score."""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import strings, with_arrow

#: Kinds in the order in which spans of equal start are listed.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn")

#: Words near a span that speak for its kind.
CONTEXT = {
    "email": ("email", "mail", "contact", "write"),
    "ip": ("ip", "address", "host", "server"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "payment"),
    "phone": ("phone", "tel", "call", "mobile", "fax"),
    "iban": ("iban", "bank", "account", "konto", "swift"),
    "ssn": ("ssn", "social", "security"),
}

#: Score of a confirmed span without context, by kind; context adds 0.2, at most to 1.
BASE_SCORE = {"email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.8, "ssn": 0.4}
CONTEXT_BONUS = 0.2
CONTEXT_CHARS = 40
#: Spans of the kinds that have no checksum and no fixed format need this much.
MIN_SCORE = 0.5

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match can only begin where a run of digits does, since it always takes the rest of a run.
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN_HEAD = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?= ?[A-Z0-9]{4})")
IBAN_ENDS = re.compile(r"(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?")
#: Lengths of the registered countries (ISO 13616).
IBAN_LENGTH = {c[:2]: int(c[2:]) for c in (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 "
    "FK18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HN28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 "
    "LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 "
    "SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30").split()}
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
NOT_DIGIT = re.compile(r"[^0-9]+")
DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """ISO 13616: the rearranged number leaves 1."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def emails(text: str):
    """Leftmost spans of ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(.[A-Za-z0-9-]+)+``, found from the at sign so that long
    runs of letters cost linear time."""
    end, looked = 0, 0
    for m in DOMAIN.finditer(text):
        at = m.start()
        run = text[max(end, looked):at]
        local = len(run) - len(run.rstrip(LOCAL))
        looked = at + 1
        if local:
            end = m.end()
            yield at - local, end


def small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def ibans(text: str):
    """Spans of valid IBANs, their characters in groups of four: of the length of a registered country, for others the
    longest that passes."""
    end = 0
    for m in IBAN_HEAD.finditer(text):
        run = IBAN_ENDS.match(text, m.end()) if m.start() >= end else None
        if run is None:
            continue
        wanted, packed, ends = IBAN_LENGTH.get(m[0][:2]), 4, []
        for at in range(run.start(), run.end()):
            packed += text[at] != " "
            after = text[at + 1:at + 2]
            if text[at] != " " and packed >= 15 and not (after.isascii() and after.isalnum()):
                ends.append((at + 1, packed))
        for stop, n in reversed(ends):
            if n <= 34 and (wanted is None or n == wanted) and mod97(text[m.start():stop].replace(" ", "")):
                end = stop
                yield m.start(), stop
                break


def propose(text: str):
    """(kind, start, end) of every span that its checksum or format confirms, per kind in order."""
    if "@" in text:
        for start, end in emails(text):
            yield "email", start, end
    if not DIGIT.search(text):
        return
    for m in IP.finditer(text):
        if all(map(small, m[0].split("."))):
            yield "ip", m.start(), m.end()
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = NOT_DIGIT.sub("", m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                yield "card", m.start(), m.end()
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
                yield "phone", m.start(), m.end()
    for start, end in ibans(text):
        yield "iban", start, end
    for m in SSN.finditer(text):
        if m[0][:3] not in ("000", "666") and m[0][0] != "9" and m[0][4:6] != "00" and m[0][7:] != "0000":
            yield "ssn", m.start(), m.end()


def find_spans(text: str) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by start, then kind as listed; code points, end exclusive."""
    out = []
    for kind, start, end in propose(text):
        near = (text[max(0, start - CONTEXT_CHARS):start] + " " + text[end:end + CONTEXT_CHARS]).lower()
        seen = any(re.search(rf"(?<![a-z]){w}(?![a-z])", near) for w in CONTEXT[kind])
        score = min(1.0, BASE_SCORE[kind] + CONTEXT_BONUS * seen)
        if score >= MIN_SCORE:
            out.append((kind, start, end, score))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


SPANS = "spans array<struct<kind:string,start:int,end:int,score:double>>"
SPANS_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()),
                                  ("score", pa.float64())]))


def pii_spans(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``spans``: every confirmed span of the whole text with its score. A null text counts as empty;
    rows, ids and other columns stay as they are."""
    at = docs.columns.index(text_col)

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        rows = [[dict(zip(("kind", "start", "end", "score"), s)) for s in find_spans(t)]
                for t in strings(batch.column(at))]
        return [pa.array(rows, SPANS_ARROW)]

    return with_arrow(docs.withColumn(text_col, F.col(text_col).cast("string")), run, SPANS, ["spans"])


def digest(kinds: tuple[str, ...]):
    chosen = F.filter("spans", lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def pii_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: counts by base kind, the hash of the base spans and all spans as text."""
    base = KINDS[:4]
    found = pii_spans(docs.select(id_col, text_col), text_col)
    kinds = F.transform("spans", lambda s: s["kind"])
    count = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in base]
    return found.select(id_col, *count, F.sha2(digest(base), 256).alias("base_sha256"), digest(KINDS).alias("spans"))


def mask(text: str, spans) -> str:
    """``text`` with every span replaced by <KIND>; overlapping spans become one mark of the earliest."""
    out, done = [], 0
    for kind, start, end, _ in spans:
        if start >= done:
            out += [text[done:start], f"<{kind.upper()}>"]
        done = max(done, end)
    return "".join(out) + text[done:] if out else text


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """``docs`` with all personal data in the text masked; null stays null. ``length_col``: a column of the text's
    length in code points that follows the change."""
    columns, at = docs.columns, docs.columns.index(text_col)

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        return [pa.array([None if t is None else mask(t, find_spans(t)) for t in batch.column(at).to_pylist()],
                         pa.string())]

    out = with_arrow(docs.withColumn(text_col, F.col(text_col).cast("string")), run, "_masked string")
    flat = out.toDF(*[f"c{i}" for i in range(len(columns))], "masked")
    change = {at: F.col("masked")}
    if length_col is not None:
        k = columns.index(length_col)
        kept = docs.schema[length_col].dataType
        change[k] = (F.when(F.col("masked").eqNullSafe(F.col(f"c{at}")), F.col(f"c{k}"))
                     .otherwise(F.length("masked")).cast(kept))
    return flat.select(*[change.get(i, F.col(f"c{i}")).alias(c) for i, c in enumerate(columns)])
