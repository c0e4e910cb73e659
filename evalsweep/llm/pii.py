"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds the few places where personal data can
be: at-signs, plus signs, digits, schemes and identifier cues.  Around each
anchor a deterministic parser expands to the boundaries and validates what it
found.  Parsers read forwards only, or backwards no further than the end of the
last span of their kind, so the work on a text is linear in its length.
"""

from __future__ import annotations

import hashlib
import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalsweep.llm.common import map_batches, texts

BASE_KINDS = ("email", "ip", "card", "phone")
# Added by the method: credentials in URLs, account numbers and secrets behind a cue.
MORE_KINDS = ("login", "account", "secret")
KINDS = BASE_KINDS + MORE_KINDS

ACCOUNT_CUES = ("account", "acct", "iban", "ssn", "passport", "customer id", "konto", "compte", "cuenta")
SECRET_CUES = ("token", "api_key", "apikey", "api key", "secret", "password", "passwd")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGITS = frozenset("0123456789")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+").match
_IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+").match
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+").match
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]").match
_USERINFO = re.compile(r"[A-Za-z0-9._~%!$&'*+,;=-]+:[A-Za-z0-9._~%!$&'*+,;=-]+@[A-Za-z0-9.-]+").match
_ACCOUNT = re.compile(r"(?:[ ](?:no|nr|number|num|id))?\.?[ ]?[:=#]?[ ]?[\"']?([A-Z]{2}[0-9]{2}[A-Z0-9]{10,30}|[0-9][0-9-]{5,32}[0-9])(?![A-Za-z0-9])").match
_SECRET = re.compile(r"[ ]?[:=][ ]?[\"']?([A-Za-z0-9_+/.-]{16,})").match


def luhn(digits: list[int]) -> bool:
    total = sum(digits[-1::-2]) + sum(2 * d - 9 * (d > 4) for d in digits[-2::-2])
    return total % 10 == 0


def _numbers(text: str, start: int, end: int) -> list[int]:
    return [int(c) for c in text[start:end] if c in _DIGITS]


def anchors() -> ahocorasick.Automaton:
    """The automaton: each anchor leads to the parsers that start from it."""
    found: dict[str, tuple[str, ...]] = {"@": ("email",), "+": ("phone",), "://": ("login",)}
    for digit in "0123456789":
        found[digit] = ("card",)
        found[digit + "."] = ("ip",)
    for cues, kind in ((ACCOUNT_CUES, "account"), (SECRET_CUES, "secret")):
        for cue in cues:
            for form in (cue, cue.title(), cue.capitalize(), cue.upper()):
                found[form] = (kind,)
    automaton = ahocorasick.Automaton()
    for word, kinds in found.items():
        automaton.add_word(word, kinds)
    automaton.make_automaton()
    return automaton


def spans(text: str, automaton: ahocorasick.Automaton) -> dict[str, list[tuple[int, int]]]:
    """Spans of each kind in code points, end exclusive, leftmost and non-overlapping per kind."""
    out: dict[str, list[tuple[int, int]]] = {kind: [] for kind in KINDS}
    done = dict.fromkeys(KINDS, 0)  # where a kind may start again
    for at, kinds in automaton.iter(text):
        for kind in kinds:
            if kind == "card":
                if at < done["card"]:
                    continue
                if m := _CARD(text, at):
                    done["card"] = m.end()
                    digits = _numbers(text, at, m.end())
                    if 16 <= len(digits) <= 19 and luhn(digits):
                        out["card"].append(m.span())
            elif kind == "ip":
                start, low = at, done["ip"]
                while start > low and text[start - 1] in _DIGITS:
                    start -= 1
                if start < at and (m := _IP(text, start)):
                    done["ip"] = m.end()
                    parts = [p.lstrip("0") or "0" for p in m.group().split(".")]
                    if all(len(p) <= 3 and int(p) <= 255 for p in parts):
                        out["ip"].append(m.span())
            elif kind == "email":
                start, low = at, done["email"]
                while start > low and text[start - 1] in _LOCAL:
                    start -= 1
                if start < at and (m := _DOMAIN(text, at + 1)):
                    done["email"] = m.end()
                    out["email"].append((start, m.end()))
            elif kind == "phone":
                if at >= done["phone"] and (m := _PHONE(text, at)):
                    done["phone"] = m.end()
                    if 8 <= len(_numbers(text, at, m.end())) <= 15:
                        out["phone"].append(m.span())
            elif kind == "login":
                if m := _USERINFO(text, at + 1):
                    out["login"].append(m.span())
            else:
                m = (_ACCOUNT if kind == "account" else _SECRET)(text, at + 1)
                if m and m.start(1) >= done[kind] and any(c in _DIGITS for c in m.group(1)):
                    done[kind] = m.end(1)
                    out[kind].append(m.span(1))
    return out


def listed(found: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...] = KINDS) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind in kinds for start, end in found[kind])


def redacted(text: str, found: dict[str, list[tuple[int, int]]]) -> str:
    """The text with each personal passage replaced by its kind; overlaps become one."""
    every = sorted((start, -end, kind) for kind in KINDS for start, end in found[kind])
    parts, at = [], 0
    for start, end, kind in every:
        end = -end
        if start >= at:
            parts += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def find(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """Personal data of every text: counts of each kind, spans, digest; on demand the redacted text.

    A null text counts as empty; a null id is returned as it is; repeated rows
    give repeated rows; other columns are left out; an empty table gives no rows.
    Texts of any length are read whole.  Of matches that overlap, the leftmost of a
    kind counts; spans of different kinds may overlap.
    """
    counts = ", ".join(f"n_{kind} long" for kind in KINDS)

    def work(batch: pa.RecordBatch, automaton: ahocorasick.Automaton) -> dict:
        whole = texts(batch)
        found = [spans(text, automaton) for text in whole]
        out: dict = {f"n_{kind}": [len(x[kind]) for x in found] for kind in KINDS}
        out["doc_id"] = batch.column("doc_id")
        out["base_sha256"] = [hashlib.sha256(listed(x, BASE_KINDS).encode()).hexdigest() for x in found]
        out["spans"] = [listed(x) for x in found]
        if with_text:
            out["redacted"] = [redacted(text, x) for text, x in zip(whole, found)]
        return out

    schema = f"doc_id long, {counts}, base_sha256 string, spans string"
    schema += ", redacted string" * with_text
    return map_batches(_input(docs), work, schema, anchors)


def redact(docs: DataFrame) -> DataFrame:
    """Documents with personal data replaced by placeholders; same columns and rows.

    Null texts stay null, empty ones empty; repeated rows and rows without an id are
    treated each; other columns, of any name, stay as they are; an empty table stays
    empty.
    """
    fields = docs.schema

    def work(batch: pa.RecordBatch, automaton: ahocorasick.Automaton) -> dict:
        out = {name: batch.column(name) for name in batch.schema.names}
        whole = batch.column("text").to_pylist()
        clean = [t and redacted(t, spans(t, automaton)) for t in whole]
        out["text"] = clean
        if "n_chars" in out:
            out["n_chars"] = [None if t is None else len(t) for t in clean]
        return out

    return map_batches(docs, work, fields, anchors)


def _input(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


