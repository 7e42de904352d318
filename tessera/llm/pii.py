"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds its anchors: at-signs, plus signs, digits, "://" and cues of identifiers. From each anchor a
local parser expands to both sides and validates: domains of e-mail addresses, octets of IP addresses, Luhn sums of card numbers, digit
counts of phone numbers, hosts of URLs, checksums of IBANs, shapes of account and secret values after a cue. The base kinds
(email, ip, card, phone) are exactly the leftmost non-overlapping matches of their patterns; ``url`` and ``account`` are added.

Positions are code points, ends exclusive. Defined cases: null text counts as empty and has no spans; spans of different kinds
may overlap; repeated documents each get a row; other columns are ignored by ``report`` and kept by ``redact``; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import documents

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "account")
#: Words before an account number, key or other secret, in lower case.
CUES = ("iban", "account", "acct", "konto", "cuenta", "ssn", "passport", "password", "passwd", "token", "secret", "api_key", "apikey")
SCHEMES = {"http", "https", "ftp", "sftp", "ssh", "file", "s3", "ws", "wss"}
SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for anchor in ("@", "+", "://", *"0123456789"):
        out.add_word(anchor, (anchor if anchor in ("@", "+", "://") else "0", len(anchor)))
    for cue in CUES:
        for form in (cue, cue.upper(), cue.capitalize()):
            out.add_word(form, ("cue", len(form)))
    out.make_automaton()
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def iban(value: str) -> bool:
    if not re.fullmatch(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", value):
        return False
    return int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1


class Finder:
    """Spans of one text; holds the compiled automaton and local patterns."""

    def __init__(self) -> None:
        self.anchors = automaton()
        self.domain = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
        self.ip = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
        self.card = re.compile(r"[0-9](?:[ -]?[0-9])+")
        self.phone = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
        self.rest = re.compile(r"[^\s<>\"'`{}|\\^]+")
        self.value = re.compile(r"(?: ?(?:number|no|nr|key|id))?[ \t]*[:=#]?[ \t]*[\"']?([A-Za-z0-9_-]{6,64})(?![A-Za-z0-9_-])")
        self.groups = re.compile(r"[ \t]*[:=#]?[ \t]*([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{1,4}){3,8})(?![A-Za-z0-9])")
        self.local = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        out: list[tuple[int, int, str]] = []
        done = dict.fromkeys(KINDS, 0)
        last_digit = -2
        for end, (anchor, size) in self.anchors.iter(text):
            at = end + 1 - size
            if anchor == "0":
                if at != last_digit + 1 or at in (done["ip"], done["card"]):
                    self._number(text, at, done, out)
                last_digit = at
            elif anchor == "@":
                self._email(text, at, done, out)
            elif anchor == "+":
                if at >= done["phone"] and (m := self.phone.match(text, at)):
                    done["phone"] = m.end()
                    if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                        out.append((at, m.end(), "phone"))
            elif anchor == "://":
                self._url(text, at, done, out)
            else:
                self._account(text, at, end + 1, done, out)
        out.sort(key=lambda s: (s[0], KINDS.index(s[2]), s[1]))
        return out

    def _number(self, text: str, at: int, done: dict[str, int], out: list[tuple[int, int, str]]) -> None:
        if at >= done["ip"] and (m := self.ip.match(text, at)):
            done["ip"] = m.end()
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append((at, m.end(), "ip"))
        if at >= done["card"] and (m := self.card.match(text, at)):
            done["card"] = m.end()
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((at, m.end(), "card"))

    def _email(self, text: str, at: int, done: dict[str, int], out: list[tuple[int, int, str]]) -> None:
        start = at
        while start > done["email"] and text[start - 1] in self.local:
            start -= 1
        if start < at and (m := self.domain.match(text, at + 1)):
            done["email"] = m.end()
            out.append((start, m.end(), "email"))

    def _url(self, text: str, at: int, done: dict[str, int], out: list[tuple[int, int, str]]) -> None:
        start = at
        while start > done["url"] and at - start < 5 and text[start - 1].isascii() and text[start - 1].isalnum():
            start -= 1
        m = self.rest.match(text, at + 3)
        if m and text[start:at].lower() in SCHEMES:
            end = at + 3 + len(m[0].rstrip(".,;:!?)]"))
            if end > at + 3:
                done["url"] = end
                out.append((start, end, "url"))

    def _account(self, text: str, at: int, end: int, done: dict[str, int], out: list[tuple[int, int, str]]) -> None:
        if at < done["account"] or at and text[at - 1].isalnum():
            return
        if (m := self.groups.match(text, end)) and iban(m[1].replace(" ", "")):
            span = m.span(1)
        elif (m := self.value.match(text, end)) and sum(c in "0123456789" for c in m[1]) >= 4:
            span = m.span(1)
        else:
            return
        done["account"] = span[1]
        out.append((*span, "account"))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def report(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder()
        for batch in batches:
            rows = [finder.spans(t) if t else [] for t in batch.column("text").to_pylist()]
            base = [[s for s in r if s[2] in BASE] for r in rows]
            counts = [pa.array([sum(s[2] == k for s in r) for r in base], pa.int64()) for k in BASE]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *counts, pa.array([hashlib.sha256(joined(r).encode()).hexdigest() for r in base], pa.string()), pa.array([joined(r) for r in rows], pa.string())],
                ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def mask(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with [KIND] in place of each span; overlapping spans go together, named after the first."""
    parts, at, until = [], 0, -1
    for a, b, kind in spans:
        if a < until:
            until = max(until, b)
            at = until
            continue
        parts += [text[at:a], f"[{kind.upper()}]"]
        at = until = b
    return "".join([*parts, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """The same rows and columns with personal data masked in ``text``; n_chars, where there is one, follows."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder()
        for batch in batches:
            text = batch.column(names.index("text")).to_pylist()
            changed = False
            size = batch.column(names.index("n_chars")).to_pylist() if "n_chars" in names else None
            for i, t in enumerate(text):
                if t and (found := finder.spans(t)):
                    text[i] = mask(t, found)
                    changed = True
                    if size is not None:
                        size[i] = len(text[i])
            if changed:
                cols = list(batch.columns)
                for name, values in (("text", text), ("n_chars", size)):
                    if values is not None:
                        k = names.index(name)
                        cols[k] = pa.array(values, cols[k].type)
                batch = pa.RecordBatch.from_arrays(cols, schema=batch.schema)
            yield batch

    return docs.mapInArrow(run, T.StructType(docs.schema.fields))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(documents(spark, sf_dir))
