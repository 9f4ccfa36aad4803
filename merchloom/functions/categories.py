"""Category paths: cleaning, keys and relabelling as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from merchloom.functions.base import NOT_ALNUM, WS_RUN, ColumnLike, let, re_escape, strip, text_or_empty
from merchloom.functions.language import mostly_cjk
from merchloom.functions.text import singularize

PATH_SEPARATOR = "|||"
OTHER = "Other"
DROP_ROW = "DROP_ROW"

# Path parts without meaning, and top levels without meaning.
GARBAGE_PARTS = (
    "", "-", "--", "---", "none", "null", "unknown", "other", "others", "na", "n/a", "test", "demo", "temp",
)
MEANINGLESS_TOPS = (
    "home", "root", "main", "category", "categories", "top", "uncategorized", "other", "others", "misc",
    "miscellaneous", "all", "everything",
)
SEPARATORS = r"->|[→>:/\\|&\r\n\t,;]"


def _drop_head(parts: Column, condition: Column) -> Column:
    return F.when(condition, F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1)))).otherwise(parts)


def path_parts(value: ColumnLike) -> Column:
    return F.filter(F.transform(F.split(text_or_empty(value), r"\|\|\|"), strip), lambda p: p != "")


def clean_category_path(value: ColumnLike, relabel: Sequence[tuple[str, str]] = ()) -> Column:
    """One ``|||`` path from any separator style; ``Other`` for junk, a drop mark for CJK-only paths.

    ``relabel`` holds (term, label): a part with the term as a whole word becomes the label.
    """
    text = F.translate(text_or_empty(value), "_", " ")
    decoded = F.regexp_replace(text, "(?i)&amp;", "&")
    empty = F.regexp_replace(F.lower(text), r"[ &|>:/\\\t\n\r]", "").rlike(r"^\p{Nd}*$")
    parts = F.filter(F.transform(F.split(decoded, SEPARATORS), strip), lambda p: p != "")

    def without_number(p: Column) -> Column:
        return _drop_head(p, F.regexp_replace(F.get(p, F.lit(0)), "[.-]", "").rlike(r"^\p{Nd}+$"))

    def without_garbage(p: Column) -> Column:
        return F.filter(p, lambda x: ~F.lower(x).isin(*GARBAGE_PARTS) & (F.length(x) > 1))

    def finish(p: Column) -> Column:
        lone_sign = (F.size(p) == 1) & (F.length(F.get(p, F.lit(0))) <= 2) & ~F.get(p, F.lit(0)).rlike(r"\p{L}")
        rest = _drop_head(p, F.lower(F.get(p, F.lit(0))).isin(*MEANINGLESS_TOPS))
        joined = F.array_join(F.transform(rest, lambda x: relabel_part(x, relabel)) if relabel else rest, PATH_SEPARATOR)
        plain = F.array_join(rest, PATH_SEPARATOR)
        return F.when((F.size(p) == 0) | lone_sign, OTHER).when(F.size(rest) == 0, OTHER).when(
            mostly_cjk(plain), DROP_ROW).otherwise(joined)

    cleaned = let(without_garbage(let(parts, without_number)), finish)
    return F.when(empty, OTHER).otherwise(cleaned)


def relabel_part(part: Column, relabel: Sequence[tuple[str, str]]) -> Column:
    """Label of the first term found in the part as a whole word, else the part itself."""
    chain = F.when(F.lit(False), part)
    for term, label in relabel:
        chain = chain.when(F.lower(part).rlike(f"(^|{NOT_ALNUM}){re_escape(term.lower())}({NOT_ALNUM}|$)"), label)
    return chain.otherwise(part)


def category_key(value: ColumnLike) -> Column:
    """Path with every word of every part in the singular; parts without words stay as they are."""
    def key(part: Column) -> Column:
        tokens = F.regexp_extract_all(F.lower(part), F.lit("([a-z0-9]+)"), 1)
        singular = F.array_join(F.transform(tokens, lambda w: singularize(w, "strict")), " ")
        return F.when(F.size(tokens) > 0, singular).otherwise(F.lower(part))

    return F.array_join(F.filter(F.transform(path_parts(value), key), lambda k: k != ""), PATH_SEPARATOR)


def key_text(key: ColumnLike) -> Column:
    """A category key as plain words."""
    return strip(F.regexp_replace(F.replace(text_or_empty(key), F.lit(PATH_SEPARATOR), F.lit(" ")), WS_RUN, " "))
