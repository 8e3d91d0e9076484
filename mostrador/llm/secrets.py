"""Secrets in texts: known forms, and strings that a tokenizer spends many tokens on.

Known forms (kinds ``assign``, ``access``, ``hex``) are patterns, leftmost and not overlapping within a kind. The kind
``dense`` adds long runs of mixed characters whose characters per token under a vocabulary made for prose stay below a
limit: words of any language take few tokens, random strings many. Digests of usual lengths and identifiers (UUIDs,
numbers, paths and names of plain words) are excluded from it, as is what a known form covers already. Where a run holds
such parts beside others, what is left between them is tested by itself, as is the whole run.

Null and empty texts have no span; texts of any length are read whole, in time that grows with their length. Every row gives one row, also those without or with repeated ids. An empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import base64
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import handed_back

KINDS = ("assign", "access", "hex", "dense")
# The known forms.
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KEYS = ("password", "passwd", "secret", "token", "apikey", "api_key")

RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
LEAST = 20
SIGNS = "+/_=-"
PART = re.compile(r"[A-Za-z0-9]+")
UUID = re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
DIGEST = re.compile(r"[0-9A-Fa-f]+")
DIGEST_SIZES = (32, 40, 56, 64, 96, 128)
NAME = re.compile(r"(?:[A-Za-z]{3,}|[0-9]{1,4})(?:[-_/=+](?:[A-Za-z]{3,}|[0-9]{1,4}))*")

SPANS = "array<struct<kind:string,start:long,`end`:long,value_start:long>>"
ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value_start", pa.int64())]))


def known_spans(text: str) -> list[tuple[str, int, int, int]]:
    """(kind, start, end, start of the value) of the known forms."""
    found = []
    lower = text.lower()
    if any(k in lower for k in KEYS):
        found += [("assign", m.start(), m.end(), m.start(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", m.start(), m.end(), m.start()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [("hex", m.start(), m.end(), m.start()) for m in HEX.finditer(text)]
    return found


def is_identifier(run: str) -> bool:
    """A digest, a UUID, a number, or plain words and short numbers in a row."""
    return bool(UUID.fullmatch(run) or DIGEST.fullmatch(run) and len(run) in DIGEST_SIZES or not re.search("[A-Za-z]", run) or NAME.fullmatch(run))


def between(start: int, end: int, gone: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """What is left of a span without the spans ``gone``."""
    out, at = [], start
    for s, e in sorted(gone) + [(end, end)]:
        if min(s, end) > at:
            out.append((at, min(s, end)))
        at = max(at, e)
    return out


def is_dense(run: str, count_tokens, most: float) -> bool:
    if len(run) < LEAST or is_identifier(run):
        return False
    kinds = bool(re.search("[a-z]", run)) + bool(re.search("[A-Z]", run)) + bool(re.search("[0-9]", run))
    return kinds >= 2 and bool(re.search("[0-9]", run)) and len(run) <= most * count_tokens(run)


def dense_spans(text: str, count_tokens, most: float, taken: list[tuple]) -> list[tuple[str, int, int, int]]:
    """Runs with at most ``most`` characters per token, apart from identifiers and known spans."""
    found = []
    # Known spans by start, and the furthest end up to each: those that reach into a run are a stretch of them.
    known = sorted((s, e) for _, s, e, _ in taken)
    starts, reach = [s for s, _ in known], list(accumulate((e for _, e in known), max))
    for m in RUN.finditer(text):
        if NAME.fullmatch(m[0]):
            continue
        words = [(w.start(), w.end(), w[0]) for w in PART.finditer(text, m.start(), m.end())]
        names = [(s, e) for s, e, w in words if is_identifier(w)]
        first_names = [s for s, _ in names]
        gone = [(s, e) for s, e in known[bisect_right(reach, m.start()): bisect_left(starts, m.end())] if e > m.start()]
        gone += [u.span() for u in UUID.finditer(text, m.start(), m.end())]
        gone += [(s, e) for s, e, w in words if len(w) in DIGEST_SIZES and DIGEST.fullmatch(w)]
        for start, end in between(*m.span(), gone):
            while m.start() < start < end and text[start] in SIGNS:
                start += 1
            while start < end < m.end() and text[end - 1] in SIGNS:
                end -= 1
            plain = [(s, e) for s, e in names[bisect_left(first_names, start): bisect_left(first_names, end)] if e <= end]
            left = between(start, end, plain + [(k, k + 1) for k in range(start, end) if plain and text[k] in SIGNS])
            # As it stands, without the plain words at its ends, and without any.
            for parts in ([(start, end)], [(left[0][0], left[-1][1])] if left else [], between(start, end, plain)):
                dense = [(s, e) for s, e in parts if is_dense(text[s:e], count_tokens, most)]
                if dense:
                    found += [("dense", s, e, s) for s, e in dense]
                    break
    return found


def token_counter(ranks_path: str):
    """Number of tokens of a string under a vocabulary file of ranks."""
    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    vocabulary = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda x: len(vocabulary.encode_ordinary(x))


def text_spans(text: str | None, count_tokens, most: float) -> list[tuple[str, int, int, int]]:
    """(kind, start, end, start of the value) of all secrets, by start, then kind."""
    known = known_spans(text or "")
    return sorted(known + dense_spans(text or "", count_tokens, most, known), key=lambda s: (s[1], KINDS.index(s[0])))


def redact(text: str | None, spans: list[tuple[str, int, int, int]], mark: str = "[secret]") -> str | None:
    """The text with each span's value replaced; overlapping values become one mark."""
    if not spans:
        return text
    parts, at = [], 0
    for start, end in sorted((s[3], s[2]) for s in spans):
        if start >= at:
            parts += [text[at:start], mark]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def spans_of(ranks_path: str, most: float = 2.0):
    """A column function: the secrets of a text, in code points, ends exclusive."""
    def found(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        count = token_counter(ranks_path)
        names = ("kind", "start", "end", "value_start")
        for part in parts:
            yield pa.array([[dict(zip(names, s)) for s in text_spans(text.as_py(), count, most)] for text in part], ARROW)

    @F.arrow_udf(SPANS)
    def spans(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from handed_back(found(parts))

    return spans


def redactor(ranks_path: str, most: float = 2.0):
    """A column function: a text without its secrets."""
    def texts(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        count = token_counter(ranks_path)
        for part in parts:
            yield pa.array([redact(text, text_spans(text, count, most)) for text in (t.as_py() for t in part)], pa.string())

    @F.arrow_udf("string")
    def redacted(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from handed_back(texts(parts))

    return redacted


def find_secrets(docs: DataFrame, ranks_path: str, most: float = 2.0, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: doc_id, spans (by start, then kind)."""
    return docs.select(F.col(id_column).cast("long").alias("doc_id"), spans_of(ranks_path, most)(F.col(text_column).cast("string")).alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
