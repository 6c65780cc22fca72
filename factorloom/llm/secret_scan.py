"""Secrets in texts: fixed patterns, and sliding windows of high Shannon entropy per character class.

Candidate strings are the maximal runs of a character class. A window slides over each; the counts of its characters change by one
in and one out, and with them the sum of ``c * log2(c)`` that gives the entropy. Windows at or above the class's threshold
join into spans of kind ``entropy``. Candidates that the allow list knows (identifiers with a public form, placeholders) are
suppressed, and so are spans inside a span of a fixed pattern.

Defined cases: a null text counts as empty and has no span; positions are code points, ends exclusive; texts of any length are
scanned whole; rows are independent, so repeated rows give repeated results; an empty table gives an empty result; other columns
are ignored by ``scan`` and kept by ``redacted``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import log2

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from factorloom.llm.shared import map_rows

# Fixed values of the base patterns. Letters of the key words stand in either case, and only ASCII letters.
KEY_WORDS = ("password", "passwd", "secret", "token", "api_?key")
_EITHER = "|".join(re.sub("[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", w) for w in KEY_WORDS)
ASSIGN = re.compile(rf"""({_EITHER})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]{24,}")
MIN_ASSIGNED, MIN_ACCESS = 6, 20
KINDS = ("assign", "access", "hex", "entropy")
#: Every match of ASSIGN holds one of these when it is in lower case.
HINTS = ("passw", "secret", "token", "apikey", "api_key")

Span = tuple[int, int, int]  # start, place of the kind in KINDS, end


@dataclass(frozen=True)
class CharacterClass:
    """Runs of ``pattern``; a window of ``width`` characters with ``bits`` of entropy or more is suspicious."""

    pattern: str
    width: int
    bits: float
    needs: str


CLASSES = (
    CharacterClass("[0-9a-fA-F]{20,}", 20, 3.0, "(?=.*[0-9])(?=.*[a-fA-F])"),
    CharacterClass("[A-Za-z0-9+/_=-]{24,}", 24, 3.9, "(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])"),
)
#: Whole candidates that are no secrets: repeated characters, identifiers of public form, placeholders, paths of words.
ALLOWED = (
    r"(.)\1*",
    r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}",
    r"[0-9_+/=-]+",
    r"(?i).*(example|placeholder|changeme|x{6,}|0123456789|abcdefgh).*",
    r"[A-Za-z]*([/_=+-]+[A-Za-z]+)*[/_=+-]*",
)


def entropy_spans(run: str, width: int, bits: float) -> Iterator[tuple[int, int]]:
    """Joined windows of at least ``bits`` in one candidate string, by incremental counts."""
    terms = [0.0] + [c * log2(c) for c in range(1, width + 1)]
    most = width * (log2(width) - bits) + 1e-9  # entropy >= bits where the sum of c log2 c is at most this
    counts: dict[str, int] = {}
    total, start, end = 0.0, -1, -1
    for i, char in enumerate(run):
        if i >= width:
            old = run[i - width]
            c = counts[old]
            counts[old] = c - 1
            total += terms[c - 1] - terms[c]
        c = counts.get(char, 0)
        counts[char] = c + 1
        total += terms[c + 1] - terms[c]
        if i + 1 >= width and total <= most:
            left = i + 1 - width
            if left > end:
                if end > 0:
                    yield start, end
                start = left
            end = i + 1
    if end > 0:
        yield start, end


def scanner(classes: tuple[CharacterClass, ...] = CLASSES, allowed: tuple[str, ...] = ALLOWED) -> Callable[[str | None], list[Span]]:
    """A function from a text to its spans, by start and then kind."""
    compiled = [(re.compile(c.pattern), re.compile(c.needs, re.DOTALL), c) for c in classes]
    allow = [re.compile(p) for p in allowed]

    def base(text: str) -> list[Span]:
        low, spans = text.lower(), []
        if any(hint in low for hint in HINTS):
            spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGNED]
        if "AKIA" in text:
            spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= MIN_ACCESS]
        return spans + [(m.start(), 2, m.end()) for m in HEX.finditer(text)]

    def scan(text: str | None) -> list[Span]:
        text = text or ""
        spans = base(text)
        found: set[tuple[int, int]] = set()
        for pattern, needs, c in compiled:
            for m in pattern.finditer(text):
                run = m[0]
                if not needs.match(run) or any(p.fullmatch(run) for p in allow):
                    continue
                found.update((m.start() + a, m.start() + b) for a, b in entropy_spans(run, c.width, c.bits))
        fixed = list(spans)
        spans += [(a, 3, b) for a, b in found if not any(s <= a and b <= e for s, _, e in fixed)]
        return sorted(spans)

    return scan


def said(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def scan(docs: DataFrame, classes: tuple[CharacterClass, ...] = CLASSES, allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """``doc_id``, the counts per fixed kind and the spans of every whole text."""
    source = docs.select("doc_id", "text")

    def rows() -> Callable[..., Iterator[tuple]]:
        find = scanner(classes, allowed)

        def one(doc_id, text):
            spans = find(text)
            fixed = [s for s in spans if s[1] < 3]
            digest = hashlib.sha256(said(fixed).encode()).hexdigest()
            yield (doc_id, *(sum(s[1] == kind for s in fixed) for kind in range(3)), digest, said(spans))

        return one

    names = ["n_assign", "n_access", "n_hex"]
    fields = [source.schema["doc_id"], *(StructField(n, LongType()) for n in names)]
    fields += [StructField(n, StringType()) for n in ("base_sha256", "spans")]
    return map_rows(source, rows, StructType(fields))


def redacted(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """All rows and columns of ``docs``; spans, joined where they overlap, are replaced by ``mark`` in the text.

    ``n_chars``, where there is one, follows the text. Rows without a span stay as they are.
    """
    source = docs.select(F.struct("*").alias("row"), F.col("text").alias("text"))

    def rows() -> Callable[..., Iterator[tuple]]:
        find = scanner()

        def one(row, text):
            spans, out, at = find(text), [], 0
            if not spans:
                yield (row, None)
                return
            for start, _, stop in spans:
                if start >= at:
                    out += [text[at:start], mark]
                at = max(at, stop)
            yield (row, "".join(out) + text[at:])

        return one

    out = map_rows(source, rows, StructType([source.schema["row"], StructField("clean", StringType())]))
    new = {"text": F.coalesce("clean", F.col("row.text"))}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        new["n_chars"] = F.when(F.col("clean").isNull(), F.col("row.n_chars")).otherwise(F.length("clean").cast(kind))
    return out.select(*(new.get(c, F.col("row")[c]).alias(c) for c in docs.columns))
