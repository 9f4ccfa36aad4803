"""Small Column building blocks shared by all function modules."""

from __future__ import annotations

import string
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str

# The characters Python's str.strip and \s treat as white space.
WS_CHARS = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# Negated classes spelled out sign by sign: the regex engine tests those by table, which is several
# times faster than a negated class of ranges.
ALNUM = string.ascii_lowercase + string.digits
NOT_ALNUM = f"[^{ALNUM}]"
NOT_ALNUM_BLANK = f"[^{ALNUM} ]"
NOT_LATIN_LETTER = f"[^{string.ascii_letters}]"

# The same set as one pattern: the Unicode space property is a single cheap test per character.
WS_RUN = r"(?U)[\s\x{1c}-\x{1f}]+"


def col(value: ColumnLike) -> Column:
    return F.col(value) if isinstance(value, str) else value


def strip(value: ColumnLike) -> Column:
    """Trim every kind of white space at both ends."""
    return F.btrim(col(value), F.lit(WS_CHARS))


def collapse_ws(value: ColumnLike) -> Column:
    """Runs of white space become one blank; ends are trimmed."""
    return F.trim(F.regexp_replace(col(value), WS_RUN, " "))


def blank_to_null(value: ColumnLike) -> Column:
    text = strip(value)
    return F.when(text != "", text)


def text_or_empty(value: ColumnLike) -> Column:
    """Trimmed text, NULL as the empty string."""
    return F.coalesce(strip(value), F.lit(""))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Bind an expensive expression once so that ``use`` may mention it several times."""
    return F.element_at(F.transform(F.array(value), use), 1)


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def all_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def join_nonblank(*parts: Column) -> Column:
    """Join parts with one blank, leaving out empty ones."""
    return F.array_join(F.filter(F.array(*parts), lambda p: p != ""), " ")


def re_escape(text: str) -> str:
    """Escape for a pattern that Java and RE2 read alike."""
    return "".join("\\" + ch if ch in r"\.[]{}()*+?^$|" else ch for ch in text)


def first_reason(rules: Sequence[tuple[str, Column]]) -> Column:
    """Name of the first rule that holds, '' when none does."""
    chain = None
    for name, condition in rules:
        chain = F.when(condition, name) if chain is None else chain.when(condition, name)
    return F.lit("") if chain is None else chain.otherwise("")
