"""Text expressions: stripping, whitespace, truncation, phrase normal form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from waymark import fixed_values as V

# What Python's strip() removes; Spark's trim() alone only knows U+0020.
_BLANKS = "".join(chr(p) for p in range(0x3001) if chr(p).isspace())
_BLANK = r"[\s\x1c-\x1f]"  # the same set as a pattern under (?U)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Remove leading and trailing Unicode whitespace."""
    return F.trim(_col(c), F.lit(_BLANKS))


def clean_text(c: Column | str) -> Column:
    """Stripped text, empty when missing."""
    return F.coalesce(strip(c), F.lit(""))


def non_blank(c: Column | str) -> Column:
    """Stripped text, null when missing or blank."""
    return F.nullif(strip(c), F.lit(""))


def squeeze_ws(c: Column | str) -> Column:
    """Whitespace runs become one space, ends are stripped."""
    return F.trim(F.regexp_replace(_col(c), rf"(?U){_BLANK}+", " "))


def truncate_content(c: Column | str, n: int = V.MAX_CONTENT_CHARS) -> Column:
    """The first ``n`` characters and an ellipsis when the text is longer."""
    c = _col(c)
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def phrase_form(c: Column | str) -> Column:
    """Lowercase words of letters and digits, one space between them."""
    return F.trim(F.regexp_replace(F.lower(_col(c)), r"[^\p{L}\p{N}]+", " "))


def words(c: Column | str) -> Column:
    """The words of :func:`phrase_form`; an empty array when there are none."""
    return F.filter(F.split(phrase_form(F.coalesce(_col(c), F.lit(""))), " "), lambda w: w != "")


def distinct_first(c: Column | str, cap: int) -> Column:
    """Case-insensitive distinct of an array, first spelling and order kept, cut to ``cap``."""
    if cap < 1:
        raise ValueError("cap must be at least 1")
    c = _col(c)

    def spelled(items: Column, keys: Column) -> Column:
        firsts = F.slice(F.array_distinct(keys), 1, cap)
        return F.transform(
            firsts, lambda k: F.get(items, (F.array_position(keys, k) - 1).cast("int"))
        )

    # One-element arrays bind the items and their keys, so that each is worked
    # out once per row and not once per key.
    return F.transform(
        F.array(c),
        lambda items: F.transform(
            F.array(F.transform(items, F.lower)), lambda keys: spelled(items, keys)
        )[0],
    )[0]
