"""Personal data: regular expressions propose spans, checksums confirm them, context words move the score.

Kinds of the base (always reported as proposed and validated, whatever the score): email, ip, card, phone.
Kinds the method adds, reported from a score of MIN_SCORE: iban (mod-97), ssn (range rules and context), tel (national
telephone numbers with context), secret (keys and tokens: long runs of mixed letters and digits, with context). Texts are
scanned whole; memory is that of one Arrow batch.

Defined results: a null text counts as empty; repeated rows each get a row; extra columns are ignored, kept ones named base
or spans are carried with _ appended; an empty table gives no rows.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.base import carried, map_batches

KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "tel", "secret")
BASE = KINDS[:4]
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
TEL = re.compile(r"(?<![0-9+(])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}(?![0-9-])")
SECRET = re.compile(r"(?<![A-Za-z0-9_/+-])[A-Za-z0-9_/+-]{20,}={0,2}")
#: What stands right before a run in the same token, looked for in so many characters, and what makes it a URL or path.
TOKEN_END, URL_START, LOOK_BACK = re.compile(r"[^\s\"'<>=]+\Z"), re.compile(r"://|^(?:www\.|[.~]{0,2}/)"), 512
DIGIT, LETTER = re.compile(r"[0-9]"), re.compile(r"[A-Za-z]")
#: Score of a validated proposal, what a word for or against in the CONTEXT characters around it adds, and the least score reported.
PRIOR = {"iban": 0.9, "ssn": 0.4, "tel": 0.4, "secret": 0.4}
FOR = {
    "iban": ("iban", "account", "bank", "konto", "cuenta", "compte"),
    "ssn": ("ssn", "social security", "social-security", "tax id"),
    "secret": ("token", "secret", "api key", "apikey", "api_key", "access key", "access_key", "private key", "password", "passwd", "bearer", "credential", "credentials"),
    "tel": ("phone", "tel", "call", "mobile", "fax", "cell", "telefon", "téléphone", "teléfono"),
}
#: Distinct letters and digits that a key has at least.
VARIETY = 8
AGAINST = ("order", "invoice", "isbn", "version", "part no", "serial", "tracking", "commit", "checksum", "sha1", "sha256", "md5", "digest")
STEP, CONTEXT, MIN_SCORE = 0.35, 48, 0.7


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i & 1:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    s = iban.replace(" ", "")
    if not 15 <= len(s) <= 34:
        return False
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches of local part, @ and dotted domain: tried at each @, from its local part's first character."""
    out, floor, at = [], 0, text.find("@")
    while at >= 0:
        lo = at
        while lo > floor and text[lo - 1] in LOCAL_CHARS:
            lo -= 1
        if lo < at and (m := DOMAIN.match(text, at)):
            out.append((lo, m.end()))
            floor = m.end()
        at = text.find("@", max(at + 1, floor))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place, end) of the base's spans."""
    out = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(v := p.lstrip("0")) <= 3 and int(v or 0) <= 255 for p in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 12:
                d = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(d) <= 19 and luhn(d):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                    out.append((m.start(), 3, m.end()))
    return out


def key_like(text: str, a: int, b: int) -> bool:
    """Whether a run of key characters may be a key: varied, letters and digits, not part of a URL or path. A run with a slash must
    be base64: letters of both cases, and no character that base64 with slashes lacks."""
    run = text[a:b]
    if not (len(set(run)) >= VARIETY and DIGIT.search(run) and LETTER.search(run)):
        return False
    if "/" in run and (run[0] == "/" or "-" in run or "_" in run or (run.lower() == run or run.upper() == run) and not run.endswith("=")):
        return False
    before = TOKEN_END.search(text, max(0, a - LOOK_BACK), a)  # the token that the run stands in
    return not (before and URL_START.search(before[0]))


def score(text: str, kind: str, a: int, b: int) -> float:
    near = f"{text[max(0, a - CONTEXT) : a]} {text[b : b + CONTEXT]}".lower()
    has = lambda words: any(re.search(rf"(?<!\w){re.escape(w)}(?!\w)", near) for w in words)
    return PRIOR[kind] + STEP * has(FOR[kind]) - STEP * has(AGAINST)


def more_spans(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The method's own spans that overlap none of the base: proposed, validated, scored."""
    if not DIGIT.search(text):
        return []
    out = []
    for kind, pattern in (("iban", IBAN), ("ssn", SSN), ("tel", TEL), ("secret", SECRET)):
        after = 0
        while m := pattern.search(text, after):
            a, b = m.span()
            after = b
            if kind == "iban":
                while b - a >= 15 and not mod97(text[a:b]):  # a following capital word may have been taken along
                    cut = text.rfind(" ", a, b)
                    b = cut if cut > a else a
                after = b if b - a >= 15 else a + 1  # what was cut off may begin another
                if b - a < 15:
                    continue
            elif kind == "ssn" and (m[0][:3] in ("000", "666") or m[0][0] == "9" or m[0][4:6] == "00" or m[0][7:] == "0000"):
                continue
            elif kind == "secret" and not key_like(text, a, b):
                continue
            if any(a < e and s < b for s, _, e in taken) or any(a < e and s < b for s, _, e in out):
                continue
            if score(text, kind, a, b) >= MIN_SCORE:
                out.append((a, KINDS.index(kind), b))
    return out


SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"
_SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def _found(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The last column is the text."""
    base, every = [], []
    as_rows = lambda spans: [{"kind": KINDS[k], "start": a, "end": b} for a, k, b in sorted(spans)]
    for t in batch.columns[-1].to_pylist():
        own = base_spans(t)
        added = more_spans(t, own)
        base.append(as_rows(own))
        every.append(as_rows(own + added) if added else base[-1])
    names = [*batch.schema.names[:-1], "base", "spans"]
    return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(base, _SPAN_TYPE), pa.array(every, _SPAN_TYPE)], names=names)


def find_pii(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns named in keep, base and spans (kind, start, end in code points; sorted by start, then kind) of every row."""
    rows, ddl, _, _ = carried(docs, text, keep, ("base", "spans"))
    return map_batches(rows, _found, f"{ddl}, base {SPANS}, spans {SPANS}")


def _masked(texts: list[str | None]) -> list[str | None]:
    out = []
    for t in texts:
        if t:
            own = base_spans(t)
            merged: list[list[int]] = []
            for a, k, b in sorted(own + more_spans(t, own)):  # overlapping spans become one, named by the first
                if merged and a < merged[-1][2]:
                    merged[-1][2] = max(merged[-1][2], b)
                else:
                    merged.append([a, k, b])
            for a, k, b in reversed(merged):
                t = f"{t[:a]}<{KINDS[k].upper()}>{t[b:]}"
        out.append(t)
    return out


def mask_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """The same rows and columns with every span of personal data in the text replaced by <KIND>; a null text stays null."""
    place = docs.columns.index(text)

    def masked(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols = list(batch.columns)
        cols[place] = pa.array(_masked(cols[place].to_pylist()), pa.string())
        return pa.RecordBatch.from_arrays(cols, names=batch.schema.names)

    return map_batches(docs.withColumn(text, F.col(text).cast("string")), masked, docs.withColumn(text, F.col(text).cast("string")).schema)
