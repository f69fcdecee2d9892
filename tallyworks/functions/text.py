"""Names, search scores, weights and amounts as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FULL_DIGITS, DIGITS = "０１２３４５６７８９", "0123456789"
KATAKANA = "".join(chr(c) for c in range(0x30A1, 0x30F4))
HIRAGANA = "".join(chr(c - 0x60) for c in range(0x30A1, 0x30F4))
FULL_ALNUM = "".join(chr(c) for r in (range(0xFF10, 0xFF1A), range(0xFF21, 0xFF3B), range(0xFF41, 0xFF5B)) for c in r)
ALNUM = "".join(chr(ord(c) - 0xFEE0) for c in FULL_ALNUM)


def blank(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit(""))) == ""


def norm_name(c: Column) -> Column:
    """Full-width spaces become spaces; both ends are stripped."""
    return F.btrim(F.translate(F.coalesce(c, F.lit("")), "　", " "), F.lit(" \t\n\r"))


def norm_kana(c: Column) -> Column:
    """Lower case, no white space, katakana as hiragana."""
    return F.translate(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[\s　]+", ""), KATAKANA, HIRAGANA)


def norm_width(c: Column) -> Column:
    """Lower case, no white space, full-width letters and digits as ASCII."""
    return F.lower(F.translate(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\s　]+", ""), FULL_ALNUM, ALNUM))


def match_score(query: Column, name: Column) -> Column:
    """100 equal, 80 a beginning, 60 a part, 20 + shared characters if there are two (or all of a shorter query), else 0."""
    q, n = norm_kana(query), norm_kana(name)
    hits = F.size(F.filter(F.split(q, ""), lambda c: (c != "") & n.contains(c)))
    return (
        F.when(q == "", 0).when(n == q, 100).when(n.startswith(q), 80).when(n.contains(q), 60)
        .when(hits >= F.least(F.lit(2), F.length(q)), 20 + hits).otherwise(0)
    )


def weights(c: Column) -> Column:
    """The three-digit weights in kg that a text names."""
    found = F.regexp_extract_all(F.translate(F.coalesce(c, F.lit("")), FULL_DIGITS, DIGITS), F.lit(r"(?iU)(?<!\d)(\d{3})(?:\.\d+)?\s*kg"), 1)
    return F.transform(found, lambda x: x.cast("int"))


def amount_text(c: Column) -> Column:
    return F.regexp_replace(F.translate(F.coalesce(c, F.lit("")), FULL_DIGITS, DIGITS), r"[,，¥￥円\s]", "")


def amount(c: Column) -> Column:
    """A finite number or null."""
    v = F.expr("try_cast(null as double)") if c is None else amount_text(c).try_cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)


def int_or_zero(c: Column) -> Column:
    return F.coalesce(F.trim(c).try_cast("int"), F.lit(0))


def japanese(c: Column) -> Column:
    """Whether a text has a kana or a Chinese character."""
    return c.rlike("[ぁ-んァ-ン一-龥]")


def half_up(c: Column) -> Column:
    """Rounds halves towards positive infinity."""
    return F.floor(c + 0.5).cast("long")


def yen(c: Column) -> Column:
    return F.concat(F.when(c < 0, "-").otherwise(""), F.lit("¥"), F.format_number(F.abs(c), 0))


def signed_yen(c: Column, kind: Column) -> Column:
    return F.concat(F.when(kind == "income", "+").otherwise("−"), yen(c))


def html_escaped(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c
