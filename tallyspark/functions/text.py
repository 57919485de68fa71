"""Text helpers: Unicode-aware regular expressions, blanks, lines and names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from tallyspark import fixed

LINE_BREAK = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]"


def rx(pattern: str, flags: str = "") -> str:
    """Lines end at ``\\n`` only, and character classes cover Unicode (PDF text holds no-break spaces)."""
    return f"(?dU{flags}){pattern}"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once, so that ``body`` may use it several times without growing the plan."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def blank_to_null(value: Column) -> Column:
    return let(value, lambda v: F.when(v != "", v))


def strip(value: Column) -> Column:
    return F.regexp_replace(value, rx(r"^\s+|\s+\z"), "")


def squeeze(value: Column) -> Column:
    return F.trim(F.regexp_replace(value, rx(r"\s+"), " "))


def snippet(value: Column, chars: int) -> Column:
    return F.left(squeeze(value), F.lit(chars))


def lines_of(value: Column) -> Column:
    return F.split(value, LINE_BREAK, -1)


def first_text(value: Column, pattern: str, group: int = 1, flags: str = "") -> Column:
    """First match of a group, or an empty text."""
    return F.regexp_extract(value, rx(pattern, flags), group)


def first_match(value: Column, pattern: str, group: int = 1, flags: str = "") -> Column:
    """First match of a group, or null; every pattern here needs at least one character in its group."""
    return blank_to_null(first_text(value, pattern, group, flags))


def all_matches(value: Column, pattern: str, group: int = 1, flags: str = "") -> Column:
    return F.regexp_extract_all(value, F.lit(rx(pattern, flags)), F.lit(group))


def has(value: Column, pattern: str, flags: str = "") -> Column:
    return value.rlike(rx(pattern, flags))


def title_case(value: Column) -> Column:
    """Capitalise the first letter of every run of letters, lower the rest."""
    runs = F.regexp_extract_all(value, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, F.initcap), "")


def is_upper(value: Column) -> Column:
    return (value == F.upper(value)) & (value != F.lower(value))


def distinct_ignoring_case(names: Column) -> Column:
    """First spelling of each name, in first-seen order."""
    return let(
        F.transform(names, F.lower),
        lambda keys: F.filter(
            names, lambda name, i: F.array_position(keys, F.lower(name)) == (i + 1).cast("bigint")
        ),
    )


def name_words(value: Column) -> Column:
    words = F.transform(all_matches(value, r"[A-Za-z]{3,}", 0), F.lower)
    return F.array_except(words, F.array(*[F.lit(w) for w in fixed.NAME_STOP_WORDS]))


def file_name(path: Column) -> Column:
    last = F.element_at(F.split(path, "/", -1), -1)
    return F.when(last != "", last).otherwise(path)


def error_text(kind: Column, message: Column, mount_path: str | None) -> Column:
    """``Type: message`` with the storage path hidden, cut to the longest stored length."""
    text = F.concat(kind, F.lit(": "), message)
    if mount_path:
        text = F.replace(text, F.lit(mount_path), F.lit(fixed.ERROR_PATH_MASK))
    cut = F.concat(F.left(text, F.lit(fixed.ERROR_MAX_CHARS - 1)), F.lit("…"))
    return F.when(F.length(text) > fixed.ERROR_MAX_CHARS, cut).otherwise(text)
