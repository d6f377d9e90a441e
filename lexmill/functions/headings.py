"""Heading numbering, title and screen-text tests as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Opening words of titles, and words of buttons and menus.
TITLES = [
    "module", "chapter", "chương", "phần", "part", "unit", "bài", "mục", "introduction", "conclusion", "summary", "overview", "abstract",
    "giới thiệu", "kết luận", "tổng quan", "mô tả", "tóm tắt", "requirement", "specification", "mục tiêu", "yêu cầu", "appendix", "phụ lục", "reference", "tài liệu",
]
SCREEN_WORDS = [
    "ok", "cancel", "save", "add", "edit", "delete", "create", "join", "yes", "no", "confirm", "apply", "reset", "close", "back", "next", "home", "menu", "settings", "profile", "logout", "login",
    "chat", "meet", "call", "share", "post", "send", "reply", "members", "owners", "admins", "users", "channels", "rooms", "notifications", "alerts", "messages", "inbox", "activity", "feed",
]
# Bullet signs, and the Roman numerals that always count.
BULLET = "[◼◻●○•◦▪▸►⇒→¢¶§]"
_ROMAN = r"^([IVXLCDMivxlcdm]+)"
ROMAN_TO_20 = "I II III IV V VI VII VIII IX X XI XII XIII XIV XV XVI XVII XVIII XIX XX".split()


# The patterns of the five kinds of numbers below, which have to match the same headings. TITLES unites several lists of opening words; the answer is the same.
def numbering(text: Column) -> Column:
    """Struct (kind, depth, label): roman 1, roman_arabic 2, decimal by its parts, letter 1, parenthetical 3; nulls for none."""
    body = F.regexp_replace(F.trim(text), r"^\[[\w\s]+\]\s*", "")
    roman = F.upper(F.regexp_extract(body, _ROMAN + r"\s*\.\s+.+$", 1))
    mixed = F.upper(F.regexp_extract(body, _ROMAN + r"\.\d+\s*\.?\s+.+$", 1))
    decimal = F.regexp_extract(body, r"^(\d+(?:\.\d+)*)\s*\.?\s+.+$", 1)
    letter = F.regexp_extract(body, r"^([A-Z])\s*\.\s+.+$", 1)
    paren = F.regexp_extract(body, r"^\((\d+|[a-z])\)\s+.+$", 1)

    def valid(numeral: Column) -> Column:
        return (numeral != "") & (numeral.isin(ROMAN_TO_20) | (F.length(numeral) <= 4))

    def named(kind: str, depth: Column, label: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), depth.cast("int").alias("depth"), label.alias("label"))

    return (
        F.when(valid(roman), named("roman", F.lit(1), roman))
        .when(valid(mixed), named("roman_arabic", F.lit(2), F.concat(mixed, F.lit("."), F.regexp_extract(body, _ROMAN + r"\.(\d+)", 2))))
        .when(decimal != "", named("decimal", F.size(F.split(decimal, r"\.")), decimal))
        .when(letter != "", named("letter", F.lit(1), letter))
        .when(paren != "", named("parenthetical", F.lit(3), paren))
    )


def is_title(text: Column) -> Column:
    """Starts with a title word; a prefix is enough, so 'party' counts as 'part'."""
    return F.trim(F.lower(text)).rlike("^(" + "|".join(TITLES) + ")")


# Page numbers and addresses in footers.
FOOTERS = [r"(?i)^(page\s+)?\d+$", r"^\d+\s*/\s*\d+$", r"(?i)^@.*\.edu\.vn"]


def is_screen_text(text: Column, footers: list[str] | None = None) -> Column:
    """Bullet items, button words, counters, one or two short words, page numbers and footers.

    footers: patterns of a publisher's own footer lines, beside FOOTERS.
    """
    body, low = F.trim(text), F.trim(F.lower(text))
    rest = F.regexp_replace(body, rf"^{BULLET}\s*", "")
    bullet = body.rlike(f"^{BULLET}") & ((F.length(rest) < 10) | ~F.substring(rest, 1, 5).rlike(r"\p{Lu}"))
    count = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    short = (count <= 2) & (F.length(text) < 20) & numbering(text).isNull() & ~is_title(text) & ~body.rlike(r"^[A-Z][a-z]+\s+[A-Z][a-z]+")
    footer = F.lit(False)
    for pattern in [*FOOTERS, *(footers or [])]:
        footer = footer | body.rlike(pattern)
    return bullet | low.isin(SCREEN_WORDS) | body.rlike(r"^\d+\s+[A-Za-z]+s?$") | short | footer
