"""Text cleaning and normalisation as Column expressions (all stay in the JVM)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from merchloom.functions.base import NOT_ALNUM, WS_RUN, ColumnLike, col, collapse_ws, let, strip, text_or_empty

TAG = r"<[^>]+>"
ENTITY = r"(?i)&[a-z0-9#]+;"
DESCRIPTION_LIMIT = 5000
CELL_LIMIT = 32760
CELL_MARKER = "...(truncated)"


def strip_html(value: ColumnLike, strict: bool = False) -> Column:
    """Tags (and, in strict mode, entities) become blanks; white space is collapsed."""
    text = F.regexp_replace(col(value), TAG, " ")
    if strict:
        text = F.regexp_replace(text, ENTITY, " ")
    return collapse_ws(text)


def clean_title(value: ColumnLike) -> Column:
    return F.translate(strip(value), "\n", " ")


def clean_description(value: ColumnLike) -> Column:
    return F.substring(strip_html(value), 1, DESCRIPTION_LIMIT)


def clean_tags(tags: ColumnLike) -> Column:
    """Trim each tag and drop blank ones."""
    return F.filter(F.transform(col(tags), strip), lambda tag: tag != "")


def split_tags(text: ColumnLike) -> Column:
    return clean_tags(F.split(col(text), ","))


def split_keywords(text: ColumnLike) -> Column:
    """Keywords separated by semicolon, comma or line break."""
    return clean_tags(F.split(col(text), r"[;,\n]"))


def sanitize_cell(value: ColumnLike) -> Column:
    """Trim, drop control characters, cut very long cells and mark the cut."""
    clean = F.regexp_replace(text_or_empty(value), r"[\x00-\x1F\x7F]+", "")
    return let(
        clean,
        lambda t: F.when(
            F.length(t) > CELL_LIMIT, F.concat(F.substring(t, 1, CELL_LIMIT), F.lit(CELL_MARKER))
        ).otherwise(t),
    )


def sanitize_list_cell(values: ColumnLike) -> Column:
    return sanitize_cell(F.array_join(clean_tags(values), ", "))


# Word groups that the stem mode folds into one word.
STEM_GROUPS = (
    (r"(shoes|sneakers|boots|sandals|slippers|flip flops)", "shoe"),
    (r"(pants|jeans|leggings|trousers|yoga pants)", "pant"),
    (r"(dresses|maxi dresses|midi dresses|mini dresses)", "dress"),
    (r"(bags|backpacks|totes|handbags|purses|tote bags|shoulder bags|crossbody bags)", "bag"),
    (r"(toys|games|puzzles|board games)", "toy"),
    (r"(diapers|wipes|baby wipes)", "diaper"),
    (r"(bottles|baby bottles|nipples)", "bottle"),
    (r"(cribs|baby cribs|bassinets)", "crib"),
    (r"(strollers|travel strollers|double strollers)", "stroller"),
    (r"(onesies|bodysuits|sleep n plays)", "onesie"),
    (r"(shampoos|conditioners|hair masks)", "shampoo"),
    (r"s", ""),
)

WORD_START, WORD_END = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
NORMALIZE_MODES = ("path", "broad", "word", "compact", "stem")


def normalize_text(value: ColumnLike, mode: str) -> Column:
    """Bring text to the form one of the matching steps works on."""
    text = F.lower(text_or_empty(value))
    if mode == "path":
        return collapse_ws(F.regexp_replace(text, r"->|[|>→:/\\\n\r\t&]", " "))
    if mode == "broad":
        return collapse_ws(F.regexp_replace(text, r"[_/&|>\-:;,()\[\].]+", " "))
    if mode == "word":
        return collapse_ws(F.regexp_replace(text, r"[^\p{L}\p{N}_\s&'-]", " "))
    if mode == "compact":
        return F.regexp_replace(text, NOT_ALNUM + "+", "")
    if mode == "stem":
        text = collapse_ws(F.regexp_replace(text, r"""[&/,;:\-•·()（）\[\]"“”'’`]+""", " "))
        for pattern, replacement in STEM_GROUPS:
            # the first sign decides at most places, before anything is looked up behind it
            first = "".join(sorted({word[0] for word in pattern.strip("()").split("|")}))
            start = "" if pattern == "s" else f"(?=[{first}]){WORD_START}"
            text = F.regexp_replace(text, f"{start}{pattern}{WORD_END}", replacement)
        return text
    raise ValueError(f"mode must be one of {NORMALIZE_MODES}, not {mode!r}")


# Irregular plurals the suffix rules of each profile get wrong.
IRREGULAR_CORE = {
    "women": "woman", "men": "man", "children": "child", "feet": "foot", "teeth": "tooth",
    "mice": "mouse", "geese": "goose", "oxen": "ox", "knives": "knife", "lives": "life",
    "wives": "wife",
}
IRREGULAR_STRICT = {
    "children": "child", "men": "man", "women": "woman", "people": "person", "teeth": "tooth",
    "feet": "foot", "geese": "goose", "mice": "mouse",
}


def _cut(word: Column, n: int) -> Column:
    return F.substring(word, F.lit(1), F.length(word) - n)


def singularize(value: ColumnLike, profile: str = "core") -> Column:
    """Singular form of one word; ``core`` also strips -ing / -ied / -ed."""
    if profile not in ("core", "strict"):
        raise ValueError(f"unknown profile {profile!r}")
    word = F.lower(col(value))
    size = F.length(word)
    irregular = IRREGULAR_CORE if profile == "core" else IRREGULAR_STRICT
    chain = F.when(F.lit(False), word)
    for plural, singular in irregular.items():
        chain = chain.when(word == plural, singular)
    plain_s = word.rlike("[^sui]s$") & (size > 3)
    if profile == "strict":
        return (
            chain.when(size <= 3, word)
            .when(word.endswith("ies") & (size > 4), F.concat(_cut(word, 3), F.lit("y")))
            .when(word.rlike("(ches|shes|xes|zes|sses)$") & (size > 4), _cut(word, 2))
            .when(plain_s, _cut(word, 1))
            .otherwise(word)
        )
    stem = _cut(word, 3)
    doubled = F.substring(stem, -1, 1) == F.substring(stem, -2, 1)
    return (
        chain.when(size <= 2, word)
        .when(word.endswith("ies") & (size > 4), F.concat(_cut(word, 3), F.lit("y")))
        .when(word.endswith("ves") & (size > 4), F.concat(_cut(word, 3), F.lit("f")))
        .when(word.rlike("(ses|xes|zes|ches|shes)$"), _cut(word, 2))
        .when(plain_s, _cut(word, 1))
        .when(word.endswith("ing") & (size > 5), F.when(doubled, _cut(word, 4)).otherwise(stem))
        .when(word.endswith("ied") & (size > 4), F.concat(_cut(word, 3), F.lit("y")))
        .when(word.endswith("ed") & (size > 4), _cut(word, 2))
        .otherwise(word)
    )


def singularize_phrase(value: ColumnLike, profile: str = "core") -> Column:
    words = F.filter(F.split(collapse_ws(value), " "), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: singularize(w, profile)), " ")


def title_words(value: ColumnLike, min_len: int = 2) -> Column:
    """Runs of at least ``min_len`` ASCII letters, in order, case kept."""
    return F.regexp_extract_all(col(value), F.lit(rf"([A-Za-z]{{{min_len},}})"), 1)


def title_keywords(value: ColumnLike, min_len: int = 3) -> Column:
    """Distinct lower-case words of a title with at least ``min_len`` letters."""
    words = F.regexp_extract_all(F.lower(col(value)), F.lit(r"([a-z]+)"), 1)
    return F.array_distinct(F.filter(words, lambda w: F.length(w) >= min_len))


# Separators in the order in which they are tried.
SEGMENT_SEPARATORS = ("|||", ">", "|", "、", ",", ";", " / ", "/", " - ")


def first_segment(value: ColumnLike) -> Column:
    """Piece before the first separator of the ordered list that occurs."""
    text = text_or_empty(value)
    chain = F.when(F.lit(False), text)
    for separator in SEGMENT_SEPARATORS:
        chain = chain.when(F.contains(text, F.lit(separator)), strip(F.substring_index(text, separator, 1)))
    return chain.otherwise(text)


def slugify(value: ColumnLike, default: str = "mismatch_target") -> Column:
    slug = F.btrim(F.regexp_replace(F.lower(text_or_empty(value)), NOT_ALNUM + "+", "_"), F.lit("_"))
    return F.when(slug != "", slug).otherwise(default)


def safe_file_name(value: ColumnLike, default: str = "export") -> Column:
    name = F.regexp_replace(text_or_empty(value), r"""[\\/:*?"<>|]+""", "_")
    return F.when(name != "", name).otherwise(default)


def normalize_collection_name(value: ColumnLike) -> Column:
    text = collapse_ws(F.translate(F.lower(text_or_empty(value)), "_-&/", "    "))
    return strip(F.regexp_replace(text, "[0-9]+$", ""))


def clean_cell(value: ColumnLike) -> Column:
    """Blank, NULL and NaN cells become the empty string."""
    text = text_or_empty(value)
    return F.when(F.lower(text) == "nan", "").otherwise(text)


def normalize_header(value: ColumnLike) -> Column:
    return F.regexp_replace(F.lower(col(value)), r"[ \t\r\n_()（）-]", "")


def bool_flag(value: ColumnLike) -> Column:
    return F.when(F.lower(text_or_empty(value)).isin("1", "true", "yes", "on"), "1").otherwise("0")


def squeeze_words(value: ColumnLike) -> Column:
    """Words of a text split at white space, blanks left out."""
    return F.filter(F.split(col(value), WS_RUN), lambda w: w != "")


def title_case(value: ColumnLike) -> Column:
    """First letter of every run of letters in upper case, all others in lower case."""
    runs = F.regexp_extract_all(F.lower(col(value)), F.lit(r"(\p{L}+|\P{L}+)"), 1)
    return F.array_join(F.transform(runs, lambda run: F.concat(F.upper(F.substring(run, 1, 1)), F.substring(run, F.lit(2), F.length(run)))), "")
