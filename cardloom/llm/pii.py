"""Personal data by anchor expansion.

An Aho-Corasick automaton passes over a text once and reports anchors: at-signs, plus-signs,
digits, URL schemes and the cues that introduce identifiers.  A small deterministic
parser then expands each anchor to its whole span and validates it.

Base kinds follow these patterns, leftmost and non-overlapping within a kind; a match that fails
its test is dropped and not retried:

* email  `[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+`
* ip     `[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)`, each part at most 255
* card   `[0-9]([\\x20-]?[0-9])+`, 12 to 19 digits that pass Luhn
* phone  `\\+[0-9][\\x20().0-9-]+[0-9]`, 9 to 15 digits

Added kinds: `login` (user and password in front of a URL's host), `iban` (a valid IBAN after its
cue) and `account` (at least `ACCOUNT_DIGITS` digits, hyphens and single spaces allowed, after a cue such
as "ssn" or "account number").  They never displace base spans.

Defined cases: null or empty text has no spans; repeated rows are returned each; positions
are code points, ends exclusive; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .jobs import bounded_batches, lean
from .substring_dedup import recounted

BASE = ("email", "ip", "card", "phone")
ADDED = ("login", "iban", "account")
KINDS = BASE + ADDED
ACCOUNT_DIGITS = 6
#: Words that introduce an account or identity number.
CUES = ("account number", "account no", "acct", "customer number", "driver license", "licence no", "license no", "passport", "routing number", "social security", "ssn", "tax id")

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_CHAIN = re.compile(r"[0-9](?:[ -]?[0-9])*")
_QUADS = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOGIN = re.compile(r"[A-Za-z0-9._~%!$&'()*+,;=-]+:[^\s/@?#]+(?=@)")
_AFTER = re.compile(r"[\s:#.=-]{0,4}(?:is|no|nr|number)?[\s:#.=-]{0,4}")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
_ACCOUNT = re.compile(r"[0-9](?:[ -]?[0-9])+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGITS = frozenset("0123456789")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if i % 2 == 0 else 2 * n - 9 * (n > 4)
    return total % 10 == 0


def iban_valid(text: str) -> bool:
    own = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in own[4:] + own[:4])) % 97 == 1


def automaton() -> ahocorasick.Automaton:
    """Anchors and the parser each one starts: at-sign, plus, digit, scheme or cue."""
    found = ahocorasick.Automaton()
    found.add_word("@", ("@", 1))
    found.add_word("+", ("+", 1))
    found.add_word("://", ("/", 3))
    for digit in "0123456789":
        found.add_word(digit, ("0", 1))
    for cue in (*CUES, "iban"):
        for form in {cue, cue.upper(), cue.capitalize(), cue.title()}:
            found.add_word(form, ("i" if cue == "iban" else "c", len(form)))
    found.make_automaton()
    return found


def spans(text: str, anchors: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """(kind, start, end), sorted by start and then kind as listed."""
    out: list[tuple[str, int, int]] = []
    email_end = chain_end = quad_end = phone_end = 0
    for last, (what, size) in anchors.iter(text):
        if what == "0":
            if last >= chain_end:  # the first digit of a chain: chains and dotted runs never split digits
                chain = _CHAIN.match(text, last)
                chain_end = chain.end()
                digits = [c for c in chain[0] if c in _DIGITS]
                if 12 <= len(digits) <= 19 and luhn("".join(digits)):
                    out.append(("card", last, chain_end))
            if last >= quad_end:
                run = _QUADS.match(text, last)
                quad_end = run.end()
                parts = run[0].split(".")
                at = last
                for k in range(0, len(parts) - 3, 4):
                    own = parts[k : k + 4]
                    end = at + sum(map(len, own)) + 3
                    if all(len(x := part.lstrip("0")) <= 3 and int(x or "0") <= 255 for part in own):
                        out.append(("ip", at, end))
                    at = end + 1
        elif what == "@":
            start = last
            while start > email_end and text[start - 1] in _LOCAL:
                start -= 1
            if start < last and (domain := _DOMAIN.match(text, last + 1)):
                email_end = domain.end()
                out.append(("email", start, email_end))
        elif what == "+":
            if last >= phone_end and (phone := _PHONE.match(text, last)):
                phone_end = phone.end()
                if 9 <= sum(c in _DIGITS for c in phone[0]) <= 15:
                    out.append(("phone", last, phone_end))
        elif what == "/":
            if login := _LOGIN.match(text, last + 1):
                out.append(("login", last + 1, login.end()))
        else:
            begin = last + 1 - size
            if begin and text[begin - 1].isalnum():
                continue
            at = _AFTER.match(text, last + 1).end()
            if what == "i":
                if (found := _IBAN.match(text, at)) and (valid := [e for e in range(15, len(found[0]) + 1) if 15 <= len(found[0][:e].replace(" ", "")) <= 34 and found[0][e - 1] != " " and iban_valid(found[0][:e])]):
                    out.append(("iban", at, at + valid[-1]))
            elif (found := _ACCOUNT.match(text, at)) and sum(c in _DIGITS for c in found[0]) >= ACCOUNT_DIGITS:
                out.append(("account", at, found.end()))
    rank = {kind: i for i, kind in enumerate(KINDS)}
    return sorted(set(out), key=lambda x: (x[1], rank[x[0]], x[2]))


SPAN = "array<struct<kind:string,start:long,end:long>>"
_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def find_pii(docs: DataFrame) -> DataFrame:
    """docs with a column `pii` (in place of one of that name): the spans found in `text`."""
    docs = docs.drop("pii")
    names = docs.columns

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = automaton()
        for batch in batches:
            found = [[{"kind": k, "start": a, "end": b} for k, a, b in spans(t.as_py() or "", anchors)] for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*[batch.column(x) for x in names], pa.array(found, _SPAN)], names=[*names, "pii"])

    bounded_batches(docs.sparkSession)
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema], f"pii {SPAN}"])
    return docs.mapInArrow(lean(scan), schema)


def redact(text: str, found: list[dict]) -> str:
    """The text with the union of overlapping spans replaced by <KIND> of the first."""
    out, at, end, kind = [], 0, -1, ""
    for x in found:
        if x["start"] < end:
            end = max(end, x["end"])
            continue
        if end >= 0:
            out.append(f"<{kind}>")
            at = end
        out.append(text[at : x["start"]])
        end, kind = x["end"], x["kind"].upper()
    if end >= 0:
        out.append(f"<{kind}>")
        at = end
    return "".join(out) + text[at:]


def redacted(docs: DataFrame) -> DataFrame:
    """docs with every span in `text` replaced by its kind, and `n_chars` (if there) brought up to date."""
    names = docs.columns

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = automaton()
        for batch in batches:
            texts = [None if t is None else redact(t, [{"kind": k, "start": a, "end": b} for k, a, b in spans(t, anchors)]) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in names], names=names)

    bounded_batches(docs.sparkSession)
    return recounted(docs.mapInArrow(lean(scan), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)))


def op5_pii(spark, sf_dir: str) -> DataFrame:
    found = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    is_base = lambda x: x["kind"].isin(*BASE)
    digest = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    of_kind = lambda kind: lambda x: x["kind"] == kind
    counts = [F.size(F.filter("pii", of_kind(kind))).cast("long").alias(f"n_{kind}") for kind in BASE]
    return found.select("doc_id", *counts, F.sha2(digest(F.filter("pii", is_base)), 256).alias("base_sha256"), digest(F.col("pii")).alias("spans"))
