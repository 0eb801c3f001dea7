"""Text normalisation columns shared by every operator family."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The code points of the Unicode White_Space property.
UNICODE_SPACES = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once for ``body``.

    The optimizer may inline a projected expression into a lambda, where it would be evaluated per element; a
    one-element ``transform`` keeps it evaluated once per row.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def compute_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add or replace columns so that each is evaluated once per row.

    Projections are merged by the optimizer, and a merged expression that a lambda refers to would run once per array
    element. A generator with a single row is not merged, so what lies above reads a finished value.
    """
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(F.struct(*[e.alias(n) for n, e in columns.items()]))))


def trim(value: Column) -> Column:
    return F.btrim(value, F.lit(UNICODE_SPACES))


def is_blank(value: Column) -> Column:
    return F.coalesce(trim(value), F.lit("")) == ""


def fold_spaces(value: Column) -> Column:
    """Trim and turn every run of white space into one blank."""
    return trim(F.regexp_replace(value, r"(?U)\s+", " "))


def search_text(value: Column) -> Column:
    """The form used for lexical search and for content de-duplication."""
    return fold_spaces(F.lower(value))


def value_key(value: Column) -> Column:
    """Two memory values are equivalent when their keys are equal."""
    return F.lower(fold_spaces(value))


def or_default(value: Column, fallback: str | Column) -> Column:
    """A blank value becomes the fallback, any other value stays untouched."""
    fallback = fallback if isinstance(fallback, Column) else F.lit(fallback)
    return F.when(is_blank(value), fallback).otherwise(value)


def truncate(value: Column, size: int | Column) -> Column:
    """B04 by code points; a size of zero or less keeps the text."""
    size = size if isinstance(size, Column) else F.lit(size)
    return F.when(size <= 0, value).otherwise(F.substring(value, F.lit(1), size))


def truncate_bytes(value: Column, size: int) -> Column:
    """B04 by bytes; a character cut in half is replaced, never emitted broken."""
    if size <= 0:
        return value
    cut = F.substring(F.encode(value, "UTF-8"), 1, size).cast("string")
    return F.when(F.octet_length(value) <= size, value).otherwise(F.make_valid_utf8(cut))


def round4(value: Column) -> Column:
    """Four decimals, halves away from zero."""
    return F.signum(value) * F.floor(F.abs(value) * 10000 + 0.5) / 10000


def portable(value: Column) -> Column:
    """LF line ends, no trailing blanks or tabs on a line, no blank lines at either edge. Patterns run on texts that hold
    what they look for only."""
    def lines(text: Column) -> Column:
        return F.when(F.contains(text, F.lit("\r")), F.regexp_replace(text, r"\r\n?", "\n")).otherwise(text)

    def bare(text: Column) -> Column:
        trailing = F.lit(False)
        for blank in " \t":
            trailing = trailing | F.contains(text, F.lit(blank + "\n")) | F.endswith(text, F.lit(blank))
        return F.when(trailing, F.regexp_replace(text, r"(?<![ \t])[ \t]++(?=\n|\z)", "")).otherwise(text)

    def cut_head(text: Column) -> Column:
        blank = F.substring(text, 1, 1).isin(*UNICODE_SPACES)
        return F.when(blank, F.regexp_replace(text, r"(?U)\A\s*\n", "")).otherwise(text)

    def cut_tail(text: Column) -> Column:
        kept = F.rtrim(text, F.lit(UNICODE_SPACES))
        rest = F.substring(text, F.length(kept) + 1, F.length(text))
        return F.when(kept == "", F.lit("")).when(F.length(kept) == F.length(text), text).otherwise(
            F.concat(kept, F.substring_index(rest, "\n", 1)))

    return let(let(let(let(value, lines), bare), cut_head), cut_tail)


def preview(value: Column, size: int) -> Column:
    """One line, cut with an ellipsis."""
    flat = F.replace(value, F.lit("\n"), F.lit("\\n"))
    return F.when(F.length(flat) <= size, flat).otherwise(F.concat(F.substring(flat, 1, size), F.lit("...")))


def escape_markup(value: Column) -> Column:
    """Escape the five markup characters; the ampersand goes first."""
    for raw, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"), ("'", "&#39;")):
        value = F.replace(value, F.lit(raw), F.lit(escaped))
    return value


def join_titles(base: Column, section: Column) -> Column:
    """``base / section`` where either side may be empty."""
    return F.concat_ws(" / ", F.nullif(trim(base), F.lit("")), F.nullif(trim(section), F.lit("")))


def has_control(value: Column) -> Column:
    return value.rlike(r"[\x00-\x1f\x7f]")


def is_finite(value: Column) -> Column:
    return ~F.isnan(value) & (F.abs(value) < float("inf"))


def first_reason(*checks: tuple[Column, str]) -> Column:
    """The reason of the first failing check in order, null when every check passes."""
    return F.coalesce(*[F.when(failed, F.lit(reason)) for failed, reason in checks])
