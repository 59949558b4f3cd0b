"""Text of readings: normal forms, tests and identifiers. Patterns search, ignore case and know Unicode classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FLAGS = "(?iuU)"
MOST_TAG_CHARS = 40
# Fixed value: what a tag looks like.
TAG_SHAPE = r"^(?=.*(?:[A-Z]|\d{2}))[A-Z0-9][A-Z0-9\-/.\"' ]{1,11}$"


def searches(text: Column, pattern: str) -> Column:
    return F.rlike(F.coalesce(text, F.lit("")), F.lit(FLAGS + pattern))


def squeeze(text: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def normalise(text: Column, strip: bool = True, collapse_whitespace: bool = False, join_tag_prefix: bool = True, uppercase: bool = False) -> Column:
    """A reading as answers show it. collapse_whitespace takes all white space out, else runs become one space; a prefix of
    up to four capitals joins the digit that follows."""
    out = F.coalesce(text, F.lit(""))
    if strip:
        out = F.regexp_replace(out, r"(?U)^\s+|\s+$", "")
    out = F.regexp_replace(out, r"(?U)\s+", "" if collapse_whitespace else " ")
    if join_tag_prefix:
        out = F.regexp_replace(out, r"^([A-Z]{1,4})\s+(\d)", "$1$2")
    return F.upper(out) if uppercase else out


def key(text: Column) -> Column:
    """Capitals and digits only: readings compare by it, not by their formatting."""
    return F.regexp_replace(F.upper(F.coalesce(text, F.lit(""))), "[^A-Z0-9]", "")


def is_taglike(text: Column) -> Column:
    t = F.trim(F.replace(F.coalesce(text, F.lit("")), F.lit("\n"), F.lit(" ")))
    return (F.length(t) <= MOST_TAG_CHARS) & F.rlike(t, F.lit(r"[\p{L}\p{N}]"))


def has_tag_shape(text: Column) -> Column:
    return F.rlike(text, F.lit("(?i)" + TAG_SHAPE))


def slug(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\p{L}\p{N}\-.]", "-")


def hash_id(text: Column, length: int = 8) -> Column:
    return F.substring(F.sha1(text), 1, length)


def tag_key(category: Column, text: Column) -> Column:
    return F.concat_ws("|", category, key(text))


def connector_id(text: Column) -> Column:
    """Flag letter and line number of an off-page connector: the letter before the number, else after it, else none. Null
    without a number of four to six digits."""
    t = F.upper(squeeze(F.coalesce(text, F.lit(""))))
    before, after, bare = r"(?<![A-Z0-9-])([A-Z])\s+(\d{4,6})\b", r"\b(\d{4,6})\s+([A-Z])(?![A-Z0-9])", r"\b(\d{4,6})\b"
    return (
        F.when(F.rlike(t, F.lit(before)), F.concat(F.regexp_extract(t, before, 1), F.regexp_extract(t, before, 2)))
        .when(F.rlike(t, F.lit(after)), F.concat(F.regexp_extract(t, after, 2), F.regexp_extract(t, after, 1)))
        .when(F.rlike(t, F.lit(bare)), F.regexp_extract(t, bare, 1))
    )


def connector_description(text: Column, label: str | None = None) -> Column:
    """What a connector is: its text without the category's label, a grid reference and its id."""
    t = F.upper(squeeze(F.coalesce(text, F.lit(""))))
    if label:
        t = F.regexp_replace(t, FLAGS + label, " ")
    t = F.regexp_replace(t, r"\(\s*[A-Z]{1,2}\s*-\s*\d+\s*\)", " ")
    t = F.regexp_replace(t, r"(?<![A-Z0-9-])[A-Z]\s+\d{4,6}\b|\b\d{4,6}(?:\s+[A-Z](?![A-Z0-9]))?", " ")
    return squeeze(t)


def cell(text: Column) -> Column:
    return F.upper(squeeze(F.coalesce(text, F.lit(""))))


def same_but_v_for_y(a: Column, b: Column) -> Column:
    return (a != b) & (F.translate(a, "Y", "V") == F.translate(b, "Y", "V"))


def split_codes(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), r"[/|,\s]+", -1)


def clipped(text: Column, most: int = 160) -> Column:
    return F.substring(text, 1, most)


def is_rate_limit(error: Column) -> Column:
    return F.coalesce(error.contains("429") | error.contains("RESOURCE_EXHAUSTED"), F.lit(False))


def is_one_letter(text: Column) -> Column:
    return F.rlike(F.coalesce(text, F.lit("")), F.lit(r"^\p{L}\z"))


def pixel_fingerprint(width: Column, height: Column, pixels: Column) -> Column:
    return F.sha1(F.concat(F.concat_ws("x", width.cast("string"), height.cast("string")).cast("binary"), pixels))
