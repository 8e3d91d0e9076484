"""Text normalisers. Every one is a built-in expression; none needs Python on executors."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from .exprs import col, not_empty

# What counts as white space for the text rules, and word edges, which
# are ASCII here (an accented letter is an edge) unlike Java's own \b.
_WIDE_SPACES = (0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)
SPACE = "[\\s" + "".join(f"\\x{{{c:X}}}" for c in _WIDE_SPACES) + "]"
TO_LINE_END = r"[^\n\r\x{2028}\x{2029}]*"
EDGE_LEFT = r"(?<![A-Za-z0-9_])"
EDGE_RIGHT = r"(?![A-Za-z0-9_])"

# Measuring units, colours and filler words dropped from product titles.
UNITS = "GB TB MB mAh W Hz K MP mm"
COLOURS = (
    "negro blanco rojo azul verde gris plata dorado morado amarillo naranja beige titanio "
    "grafito rosa celeste black white silver gold blue red green purple"
)
FILLERS = (
    "para auto coche hogar casa escritorio portatil portátil educativa educativo profesional "
    "básico avanzado compacto original"
)
FILLERS_KEPT_BY_PRICES = ("portatil", "portátil")
KEYWORD_WORDS = 5

# Conversation origins and the placeholder e-mail of anonymous visitors.
ORIGIN_PREFIX = "urn:crisp.im:"
PLAIN_ORIGINS = ("chat", "email")
PLACEHOLDER_EMAIL = "user@example.com"


def _any_word(words) -> str:
    return f"(?iu){EDGE_LEFT}(?:{'|'.join(words)}){EDGE_RIGHT}"


def trim_space(c: str | Column) -> Column:
    return F.regexp_replace(col(c), rf"\A{SPACE}+|{SPACE}+\z", "")


def _squeeze(c: Column) -> Column:
    return trim_space(F.regexp_replace(c, rf"{SPACE}{{2,}}", " "))


def _first_words(c: Column, n: int) -> Column:
    words = F.filter(F.split(c, " "), lambda w: w != "")
    return F.array_join(F.slice(words, 1, n), " ")


def extract_keyword(title: str | Column, version: str = "v1") -> Column:
    """Search term behind a product title.

    ``v1`` market size and shelf position; ``v2`` price watch (keeps "portatil");
    ``v3`` the structural form that cuts at the first separator and drops brackets.
    """
    c = col(title)
    units = rf"(?iu){EDGE_LEFT}\d+{SPACE}*(?:{'|'.join(UNITS.split())}){EDGE_RIGHT}"
    if version == "v3":
        c = F.regexp_replace(c, r"\A([^:|\-–—]*)[:|\-–—]" + TO_LINE_END, "$1")
        c = F.regexp_replace(c, r"[\[(].*?[\])]", "")
        return _first_words(_squeeze(F.regexp_replace(c, units, "")), KEYWORD_WORDS)
    fillers = FILLERS.split()
    if version == "v2":
        fillers = [w for w in fillers if w not in FILLERS_KEPT_BY_PRICES]
    elif version != "v1":
        raise ValueError(f"unknown keyword version {version!r}")
    c = F.regexp_replace(c, rf"(?s)\A(.*?):{SPACE}" + TO_LINE_END, "$1")
    for pattern in (units, _any_word(COLOURS.split()), _any_word(fillers)):
        c = F.regexp_replace(c, pattern, "")
    c = F.regexp_replace(c, r"[–—\-]+\z", "")
    return _first_words(_squeeze(c), KEYWORD_WORDS)


@lru_cache(maxsize=1)
def _accent_table() -> tuple[str, str]:
    """Accented letter -> base letter for every letter that decomposes into one base
    letter and combining marks U+0300-036F; the marks themselves map to nothing."""
    marks = [chr(m) for m in range(0x300, 0x370)]
    source, target = [], []
    for code in range(0xC0, 0x2000):
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) > 1 and all(p in marks for p in parts[1:]):
            source.append(chr(code))
            target.append(parts[0])
    return "".join(source + marks), "".join(target)


def fold_accents(c: str | Column) -> Column:
    source, target = _accent_table()
    return F.translate(col(c), source, target)


def normalize_text(c: str | Column) -> Column:
    """Lower case, no accents, only a-z, 0-9 and single spaces; null reads as ''."""
    plain = F.regexp_replace(fold_accents(F.lower(col(c))), "[^a-z0-9 ]", " ")
    return F.coalesce(F.trim(F.regexp_replace(plain, " +", " ")), F.lit(""))


def employee_code(email, first_name, last_name, fallback) -> Column:
    """first.last without accents or spaces, else the mailbox name, else unknown.<id>."""

    def part(c):
        return F.regexp_replace(fold_accents(F.lower(col(c))), f"{SPACE}+", "")

    named = not_empty(first_name).isNotNull() & not_empty(last_name).isNotNull()
    return (
        F.when(named, F.concat(part(first_name), F.lit("."), part(last_name)))
        .when(not_empty(email).isNotNull(), F.lower(F.substring_index(col(email), "@", 1)))
        .otherwise(F.concat(F.lit("unknown."), col(fallback).cast("string")))
    )


def clean_gid(c: str | Column) -> Column:
    """Resource id: drop the query part, keep the last path segment."""
    return F.element_at(F.split(F.substring_index(not_empty(c), "?", 1), "/"), -1)


def staff_gid(c: str | Column) -> Column:
    """Digits after /StaffMember/, or the id as it is."""
    digits = F.regexp_extract(col(c), r"/StaffMember/(\d+)\z", 1)
    return F.when(digits != "", digits).otherwise(not_empty(c))


def normalize_channel(c: str | Column) -> Column:
    """Conversation origin: chat and email stay, a urn gives its third part."""
    origin = not_empty(c)
    parts = F.split(origin, ":")
    from_urn = origin.startswith(ORIGIN_PREFIX) & (F.size(parts) >= 3)
    return F.when(origin.isin(*PLAIN_ORIGINS), origin).when(from_urn, F.get(parts, F.lit(2))).otherwise(origin)


def parse_note(c: str | Column) -> Column:
    """First element of a JSON array; any other text as it is."""
    items = F.from_json(col(c), "array<string>")
    is_array = F.ltrim(col(c)).startswith("[") & (F.size(items) > 0)
    return not_empty(F.when(is_array, F.coalesce(F.get(items, F.lit(0)), col(c))).otherwise(col(c)))


def strip_fence(c: str | Column) -> Column:
    """The text between Markdown code fences, or the trimmed text."""
    body = F.regexp_replace(trim_space(c), r"\A```(?:json)?", "")
    return trim_space(F.regexp_replace(body, r"```\z", ""))


def parse_fenced_json(c: str | Column, schema: str) -> Column:
    """Array of structs from a fenced JSON reply; an unreadable reply gives []."""
    parsed = F.from_json(strip_fence(c), f"array<struct<{schema}>>", {"mode": "PERMISSIVE"})
    return F.coalesce(parsed, F.array().cast(f"array<struct<{schema}>>"))


def html_body(c: str | Column, limit: int | None = None) -> Column:
    """Inside <body> without scripts and styles, else the page; with ``limit`` only the
    first so many characters of that result."""
    pattern = r"(?is)<body[^>]*>(.*?)</body>"
    body = F.regexp_extract(col(c), pattern, 1)
    for tag in ("script", "style"):
        body = F.regexp_replace(body, rf"(?is)<{tag}[^>]*>.*?</{tag}>", "")
    text = F.when(F.regexp_like(col(c), F.lit(pattern)), body).otherwise(col(c))
    return text if limit is None else F.substring(text, 1, limit)


def identity_key(people_id, email, phone) -> Column:
    """Visitor key: people id, else e-mail, else phone, else null."""
    mail = not_empty(email)
    return F.coalesce(
        col(people_id),
        F.when(mail != PLACEHOLDER_EMAIL, F.concat(F.lit("email:"), mail)),
        F.concat(F.lit("phone:"), not_empty(phone)),
    )


def shorten(c: str | Column, over: int, keep: int) -> Column:
    """Labels longer than ``over`` keep ``keep`` characters and get '...'."""
    long = F.length(col(c)) > over
    return F.when(long, F.concat(F.substring(col(c), 1, keep), F.lit("..."))).otherwise(col(c))


def terms(c: str | Column) -> Column:
    """Comma separated list to trimmed, non-blank terms."""
    return F.filter(F.transform(F.split(col(c), ","), lambda x: trim_space(x)), lambda x: x != "")


def date_label(c: str | Column) -> Column:
    """'Dec 29 – Jan 4, 2020' -> 'Dec 29'; 'Jan 2020' stays."""
    return F.trim(F.substring_index(F.substring_index(col(c), "–", 1), ",", 1))
