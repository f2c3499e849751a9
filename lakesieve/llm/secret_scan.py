"""Secrets: fixed patterns, and strings that stay incompressible beside their surroundings.

A candidate of the second kind stands near a sensitive word, on either side.  A zstandard compressor is primed with a
dictionary of common code and identifiers, to which the caller may add its own, and with the text around the candidate;
what the candidate adds to the compressed size, in bytes a character, is its novelty.  Words and names that the
surroundings or the dictionary explain add little; random keys add about log2(alphabet) / 8.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, project

#: The kinds in the order that ties take, their patterns and least lengths.
KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: [0-9a-f]+ of 24 or more: a maximal run, so the bound can stand in the pattern.
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_ASSIGN, LEAST_ACCESS = 6, 20

_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=~-]{16,}")
CONTEXT = re.compile(r"(?ai)passw|pwd|secret|token|api[_-]?key|access[_-]?key|private|credential|auth|bearer|signature|session[_-]?id|encryption")
_CONTEXT_WORDS = ("passw", "pwd", "secret", "token", "key", "private", "credential", "auth", "bearer", "signature", "session", "encryption")
_LEAST = 16
#: What a sensitive context is: a sensitive word at most so many characters before or behind the candidate, or in it.
NEAR = 64
#: Characters on either side of a candidate that prime the compressor.
AROUND = 1024
#: Least added bytes a character: names of several known words add up to 0.65, random keys of 24 characters and more 0.8 and more.
NOVELTY = 0.7

_IDENTIFIERS = (
    "import from return class def function public private static void string const let var if else for while try except catch throw new null None true false self this "
    "password passwd pwd secret token api_key apikey access_key secret_key private_key client_id client_secret credential credentials authorization bearer signature session_id "
    "username user email host port database connection config environment settings getenv process.env os.environ request response header cookie http https localhost www com org "
    "SELECT FROM WHERE INSERT INTO VALUES UPDATE DELETE CREATE TABLE index document text content value values key keys name names type types data file path module package version "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 configuration default production staging service account manager example placeholder replace-me "
)


class Novelty:
    """Marginal compressed bytes of a string beside its surroundings."""

    def __init__(self, extra: str = ""):
        content = (extra + _IDENTIFIERS).encode()
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        how = zstandard.ZstdCompressionParameters.from_level(15, min_match=3, write_content_size=False, write_dict_id=False)
        d.precompute_compress(compression_params=how)
        self.coder = zstandard.ZstdCompressor(dict_data=d, compression_params=how)

    def __call__(self, candidate: str, before: str, after: str) -> float:
        around = (after + "\n" + before).encode("utf-8", "replace")
        added = len(self.coder.compress(around + candidate.encode())) - len(self.coder.compress(around))
        return added / len(candidate)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points by the fixed patterns, leftmost and non-overlapping within a kind."""
    found = []
    low = text.lower()
    if any(w in low for w in _ASSIGN_WORDS):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def novel_spans(text: str, base: list[tuple[int, int, str]], novelty: Novelty, least: float = NOVELTY) -> list[tuple[int, int, str]]:
    """Candidates in a sensitive context whose novelty is ``least`` and more, outside the base spans.

    A candidate is a run of 16 and more of the characters of keys; a sensitive word in it, and what is before that, is
    not part of it.  Its letters' case decides nothing.
    """
    low = text.lower()
    if not any(w in low for w in _CONTEXT_WORDS):
        return []
    words = [m.span() for m in CONTEXT.finditer(text)]
    if not words:
        return []
    starts, ends = [s for s, _ in words], [e for _, e in words]
    order = sorted((s, e) for s, e, _ in base)
    taken, reach = [s for s, _ in order], [0]
    for _, e in order:
        reach.append(max(reach[-1], e))
    found = []
    for m in CANDIDATE.finditer(text):
        start, end = m.span()
        k = bisect_left(ends, start - NEAR)
        if k == len(words) or starts[k] > end + NEAR:
            continue
        inside = bisect_right(ends, end) - 1
        if inside >= 0 and ends[inside] > start:
            start = ends[inside]
            while start < end and text[start] in "=_-~+/":
                start += 1
        if end - start < _LEAST or reach[bisect_left(taken, end)] > start:
            continue
        if novelty(text[start:end], text[max(0, start - AROUND) : start], text[end : end + AROUND]) >= least:
            found.append((start, end, "novel"))
    return found


def scanner(least: float = NOVELTY, identifiers: str = ""):
    """A function from a text to (base spans, all spans), each sorted by start and then kind.  ``identifiers``: more names and code that explain candidates."""
    novelty = Novelty(identifiers)

    def scan(text: str) -> tuple[list, list]:
        base = base_spans(text)
        return base, sorted([*base, *novel_spans(text, base, novelty, least)], key=lambda s: (s[0], KINDS.index(s[2])))

    return scan


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def scan_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = NOVELTY, identifiers: str = "") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every row's whole text.

    Spans are kind:start:end in code points, end exclusive, by start and then kind.  Novel ones stand at most NEAR
    characters from a sensitive word, have 16 characters and more, and add ``least`` compressed bytes a character and
    more to AROUND characters on either side and the dictionary with ``identifiers``.  A null text counts as empty:
    no spans, and the digest of the empty string.  Repeated rows are scanned each, null ids are carried, other columns
    are ignored.  Narrow.
    """

    def make():
        scan = scanner(least, identifiers)

        def row(doc_id, text):
            base, spans = scan(text or "")
            kinds = [k for *_, k in base]
            yield doc_id, kinds.count("assign"), kinds.count("access"), kinds.count("hex"), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)

        return row

    kind = df.schema[id_col].dataType.simpleString()
    return map_rows(project(df, doc_id=id_col, text=text_col), make, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact_documents(df: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", mark: str = "[SECRET]", least: float = NOVELTY, identifiers: str = "") -> DataFrame:
    """``df`` with every found span replaced by ``mark`` (touching and overlapping spans by one) and the length column, if there, set anew.

    Rows, ids and other columns stay as they are; a null text stays null.  Narrow.
    """
    @F.pandas_udf("string")
    def redact(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scan = scanner(least, identifiers)

        def one(text: str | None) -> str | None:
            if not text:
                return text
            parts, at = [], 0
            for start, end, _ in scan(text)[1]:
                if start > at or not parts:
                    parts += [text[at:start], mark]
                at = max(at, end)
            return "".join([*parts, text[at:]]) if parts else text

        for batch in batches:
            yield batch.map(one, na_action="ignore")

    out = df.withColumn(text_col, redact(F.col(text_col)))
    return out.withColumn(length_col, F.length(text_col).cast(df.schema[length_col].dataType)) if length_col in df.columns else out
