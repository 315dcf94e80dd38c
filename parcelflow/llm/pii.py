"""Personal data by anchors.

One Aho-Corasick pass finds the characters and words that personal data can't do without: at-signs, plus
signs, digits, schemes and identifier cues.  From each anchor a local parser reads left and right,
settles the boundaries and validates what it found.  Nothing else of a text is looked at, and text
without anchors costs only the pass.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import release, slices
from .storage import small_batches

#: Kinds in the order of their ties; the first four are the base.
KINDS = ["email", "ip", "card", "phone", "login_url", "account", "secret"]
BASE = 4
#: Words that announce an identifier or a secret.
ACCOUNT_CUES = ["iban", "account", "acct", "ssn", "passport", "konto", "compte", "cuenta"]
SECRET_CUES = ["password", "passwd", "pwd", "secret", "api_key", "apikey", "api-key", "access_key", "token"]
SCHEMA = "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_login_url bigint, n_account bigint, n_secret bigint"

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_WORD = re.compile(r"\w")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGITS = re.compile(r"[0-9]+")
_DOTTED = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOGIN = re.compile(r"[^\s/?#@:\"'<>]+:[^\s/?#@\"'<>]+@[^\s/?#\"'<>]+")
_IDENTIFIER = re.compile(r"(?:[ \t]*+(?:number|no\.?|nr\.?|id)\b)?[ \t]*+[:=#]?[ \t]*+([A-Za-z0-9][A-Za-z0-9-]{4,}[A-Za-z0-9](?: [A-Z0-9]{2,4}\b)*)", re.IGNORECASE)
_IBAN = re.compile(r"(?:[ \t]*+(?:number|no\.?|nr\.?)(?![A-Za-z]))?[ \t]*+[:=#]?[ \t]*+([A-Za-z]{2}[0-9]{2}(?:[ -]?[A-Za-z0-9]){11,30})", re.IGNORECASE | re.ASCII)
_SECRET = re.compile(r"[\"']?[ \t]*[:=][ \t]*[\"']?([^\s\"',;]{6,})")


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for word, code in [("@", 0), ("+", 1), ("://", 2), *((d, 3) for d in "0123456789")]:
        found.add_word(word, (code, len(word)))
    for cues, code in ((ACCOUNT_CUES, 4), (SECRET_CUES, 5)):
        for cue in cues:
            for form in {cue, cue.upper(), cue.capitalize()}:
                found.add_word(form, (code, len(form)))
    found.make_automaton()
    return found


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) << (i & 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def _iban_end(text: str, start: int, end: int) -> int:
    """Where an IBAN that begins at ``start`` ends: its longest form before ``end`` that stops at a boundary and leaves 1 modulo 97; 0 if none does."""
    while end > start:
        value = text[start:end].replace(" ", "").replace("-", "")
        if len(value) < 15:
            return 0
        whole = end == len(text) or not _WORD.match(text[end])
        if whole and int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1:
            return end
        end -= 1
        while text[end - 1] in " -":
            end -= 1
    return 0


class Finder:
    """Finds (start, kind, end) spans, in code points, by start and then kind."""

    def __init__(self):
        self.anchors = _automaton()

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        out = []
        email_end = card_end = ip_end = digits_end = login_end = account_end = secret_end = 0
        for last, (code, size) in self.anchors.iter(text):
            if code == 3:
                if last < digits_end and last < card_end and last < ip_end:
                    continue
                if last >= card_end:
                    # A chain of digits, one space or hyphen between any two: taken whole or not at all.
                    if m := _CARD.match(text, last):
                        card_end = m.end()
                        digits = m[0].replace(" ", "").replace("-", "")
                        if 14 <= len(digits) <= 19 and _luhn(digits):
                            out.append((last, 2, card_end))
                    else:
                        card_end = last + 1
                if last >= ip_end and last >= digits_end:
                    # At the start of a run of digits; four runs with dots between them.
                    if m := _DOTTED.match(text, last):
                        ip_end = m.end()
                        if all(len(g) <= 3 or not g.lstrip("0")[3:] for g in m.groups()) and all(int(g[-4:]) <= 255 for g in m.groups()):
                            out.append((last, 1, ip_end))
                    else:
                        ip_end = _DIGITS.match(text, last).end()
                    digits_end = max(digits_end, ip_end)
            elif code == 0:
                start = last
                while start > email_end and text[start - 1] in _LOCAL:
                    start -= 1
                if start < last and (m := _DOMAIN.match(text, last + 1)):
                    email_end = m.end()
                    out.append((start, 0, email_end))
            elif code == 1:
                if m := _PHONE.match(text, last):
                    if 10 <= sum(c in "0123456789" for c in m[0]) <= 15:
                        out.append((last, 3, m.end()))
            elif code == 2:
                start = last - 2
                while start > login_end and text[start - 1].isascii() and (text[start - 1].isalnum() or text[start - 1] in "+.-"):
                    start -= 1
                if start < last - 2 and (m := _LOGIN.match(text, last + 1)):
                    login_end = m.end()
                    out.append((start, 4, login_end))
            else:
                start = last + 1 - size
                if start and _WORD.match(text[start - 1]) and text[start - 1] != "_":
                    continue
                if code == 4 and start >= account_end and (m := _IBAN.match(text, last + 1)) and (end := _iban_end(text, *m.span(1))):
                    account_end = end
                    out.append((m.start(1), 5, end))
                elif code == 4 and start >= account_end and (m := _IDENTIFIER.match(text, last + 1)) and sum(c.isdigit() for c in m[1]) >= 4:
                    account_end = m.end(1)
                    out.append((m.start(1), 5, account_end))
                elif code == 5 and start >= secret_end and (m := _SECRET.match(text, last + 1)):
                    secret_end = m.end(1)
                    out.append((m.start(1), 6, secret_end))
        out.sort()
        return out


_finders: list[Finder] = []


def _finder() -> Finder:
    if not _finders:
        _finders.append(Finder())
    return _finders[0]


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, counts of the base kinds, base_sha256, spans and counts of the added kinds.

    An IBAN behind a cue, in groups or not, ends where its check digits hold; other identifiers behind
    cues have no check digits of their own and count with four digits or more.

    Spans are kind:start:end in code points, end exclusive, by start and then kind, joined by commas;
    base_sha256 is of the base spans alone.  A null or empty text has none.  Null ids and repeated rows
    are kept; other columns are not read.  No shuffle.
    """

    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = _finder()
        for part in slices(batches):
            counts: list[list[int]] = [[] for _ in KINDS]
            digests, strings = [], []
            for text in part.column(1).to_pylist():
                spans = finder.spans(text)
                base = [s for s in spans if s[1] < BASE]
                for k in range(len(KINDS)):
                    counts[k].append(sum(s[1] == k for s in spans))
                digests.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                strings.append(_joined(spans))
            yield pa.record_batch([part.column(0), *(pa.array(c, pa.int64()) for c in counts[:BASE]), pa.array(digests, pa.string()), pa.array(strings, pa.string()), *(pa.array(c, pa.int64()) for c in counts[BASE:])], names=[c.split()[0] for c in SCHEMA.split(", ")])

    return docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, SCHEMA)


def redact_text(text: str, finder: Finder) -> str:
    """The text with each stretch of personal data replaced by its kind in brackets; of overlapping spans the first names it."""
    out, at = [], 0
    for a, k, b in finder.spans(text):
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]]) if out else text


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The same rows and columns with ``text_col`` redacted; null texts stay null and empty ones empty."""
    small_batches(docs.sparkSession)

    @F.arrow_udf("string")
    def redacted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        finder = _finder()
        for texts in batches:
            yield pa.array([None if t is None else redact_text(t, finder) for t in texts.to_pylist()], pa.string())
        release()

    return docs.withColumn(text_col, redacted(docs[text_col]))
