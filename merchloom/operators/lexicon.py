"""Matching texts against term lists.

Two ways with the same results:

* a term list given as Python values is bounded by its author and is evaluated inside the row;
* a term table of any size is matched by equi-join: the rarest word of each whole-word term, character
  grams for terms that may stand inside a word. Neither side is multiplied by the other.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merchloom.functions.base import NOT_ALNUM_BLANK, ColumnLike, col, let, text_or_empty
from merchloom.functions.text import normalize_text
from merchloom.session import stored

# one sign that no text word can equal; it keeps phrases from matching across punctuation
BARRIER = "\u0001"
MAX_GRAM = 4


def boundary_words(value: ColumnLike) -> Column:
    """Words such that a term matches exactly when its words follow each other in this list.

    Hyphens count as blanks. Any other sign outside [a-z0-9] ends a word and bars a phrase from
    running across it; doubled blanks leave empty words and do the same.
    """
    text = F.replace(F.lower(text_or_empty(value)), F.lit("-"), F.lit(" "))
    barred = F.regexp_replace(text, NOT_ALNUM_BLANK + "+", f" {BARRIER} ")
    return F.split(barred, " ")


def boundary_text(value: ColumnLike) -> Column:
    """The words of :func:`boundary_words` as one padded string."""
    text = F.replace(F.lower(text_or_empty(value)), F.lit("-"), F.lit(" "))
    return F.concat(F.lit(" "), F.regexp_replace(text, NOT_ALNUM_BLANK + "+", f" {BARRIER} "), F.lit(" "))


def _plain_words(term: str) -> str:
    out = []
    for ch in term.strip().lower().replace("-", " "):
        if ch.isascii() and (ch.isalnum() or ch == " "):
            out.append(ch)
        elif not out or not out[-1].endswith(f"{BARRIER} "):
            out.append(f" {BARRIER} ")
    return "".join(out)


def _is_cjk(term: str) -> bool:
    return any("一" <= ch <= "鿿" for ch in term)


@dataclass(frozen=True)
class Lexicon:
    """Terms with optional broad terms, safe contexts per term and category terms."""

    terms: tuple[str, ...]
    broad: frozenset[str] = frozenset()
    safe: dict[str, tuple[str, ...]] = field(default_factory=dict)
    category_terms: tuple[str, ...] = ()
    category_tag: str = "apparel"

    def hits(self, value: ColumnLike) -> Column:
        """Terms found in the text, in order of first occurrence, without rescued ones.

        The text is split into words once. A term is looked up by its first word, once per place, and the safe contexts of
        what was found in a map, so the plan and the work per text grow neither with the list nor with the contexts; only CJK terms
        are searched one by one.
        """
        terms = sorted({t.lower().replace("-", " ").strip() for t in self.terms} - {""})
        named: dict[str, list[str]] = {}
        for term in terms:
            if not _is_cjk(term):
                named.setdefault(_plain_words(term), []).append(term)
        entry = "array<struct<at:int,term:string>>"

        by_first: dict[str, list[str]] = {}
        for plain in named:
            by_first.setdefault(plain.split(" ")[0], []).append(plain)

        def seen_in(words: Column) -> Column:
            """Terms whose words stand together: looked up by their first word, once per place where one begins."""
            single = sorted(p for p in named if " " not in p)
            longer = {first: [p for p in plains if " " in p] for first, plains in by_first.items()}
            longer = {first: plains for first, plains in longer.items() if plains}
            parts = [F.filter(words, lambda w: w.isin(single))] if single else []
            if longer:
                entries = F.create_map(*[x for first, plains in longer.items() for x in (F.lit(first), F.array(*[
                    F.struct(F.lit(p).alias("p"), F.lit(len(p.split(" "))).alias("n")) for p in plains]))])
                places = F.filter(F.transform(words, lambda w, i: F.when(w.isin(list(longer)), i + 1)), lambda i: i.isNotNull())
                runs = F.transform(places, lambda i: F.filter(F.element_at(entries, F.element_at(words, i)),
                                                              lambda e: F.array_join(F.slice(words, i, e["n"]), " ") == e["p"]))
                parts.append(F.transform(F.flatten(runs), lambda e: e["p"]))
            return F.array_distinct(F.concat(*parts))

        def found(texts: Column) -> Column:
            parts = [F.array().cast(entry)]
            if named:
                seen = seen_in(texts["list"])
                names = F.create_map(*[F.lit(x) if isinstance(x, str) else F.array(*[F.lit(t) for t in x]) for pair in named.items() for x in pair])
                parts.append(F.flatten(F.transform(seen, lambda p: F.transform(F.element_at(names, p), lambda t: F.struct(
                    F.position(F.concat(F.lit(" "), p, F.lit(" ")), texts["words"]).alias("at"), t.alias("term"))))))
            parts += [F.array(F.struct(F.instr(texts["raw"], t).alias("at"), F.lit(t).alias("term"))) for t in terms if _is_cjk(t)]
            hit = F.filter(F.concat(*parts), lambda e: e["at"] > 0)
            safe = {term: [p.lower().replace("-", " ") for p in self._safe_phrases(term)] for term in terms}
            safe = {term: phrases for term, phrases in safe.items() if phrases}
            if safe:  # only what was found is looked up
                phrases_of = F.create_map(*[x for term, phrases in safe.items() for x in (F.lit(term), F.array(*[F.lit(p) for p in phrases]))])
                hit = F.filter(hit, lambda e: ~F.coalesce(F.exists(F.try_element_at(phrases_of, e["term"]), lambda p: F.contains(texts["raw"], p)), F.lit(False)))
            return F.transform(F.array_sort(hit), lambda e: e["term"])

        raw = F.replace(F.lower(text_or_empty(value)), F.lit("-"), F.lit(" "))
        return let(F.struct(raw.alias("raw"), boundary_text(value).alias("words"), boundary_words(value).alias("list")), found)

    def _safe_phrases(self, term: str) -> tuple[str, ...]:
        return next((v for k, v in self.safe.items() if k.lower().replace("-", " ") == term), ())

    def _broad_names(self) -> list[str]:
        return sorted(b.lower().replace("-", " ") for b in self.broad)

    def first_match(self, df: DataFrame, title: str = "title", category: str = "category", desc: str = "description",
                    source_category: str | None = None) -> DataFrame:
        """Add ``match_field`` and ``match_keyword``: the first blocking term by field priority.

        Title, category and description are read in this order. Broad terms block at once in title
        and category; in the description only when no other term is there. Failing all, a category
        term blocks as ``tag:term``.
        """
        staged = df.select("*", self.hits(title).alias("_ht"), self.hits(category).alias("_hc"), self.hits(desc).alias("_hd"))
        broad = self._broad_names()
        plain = F.filter("_hd", lambda t: ~t.isin(*broad)) if broad else F.col("_hd")
        by_category = self.category_match(category, source_category)
        found = (
            F.when(F.size("_ht") > 0, F.struct(F.lit("title").alias("f"), F.get("_ht", F.lit(0)).alias("k")))
            .when(F.size("_hc") > 0, F.struct(F.lit("category").alias("f"), F.get("_hc", F.lit(0)).alias("k")))
            .when(F.size(plain) > 0, F.struct(F.lit("description").alias("f"), F.get(plain, F.lit(0)).alias("k")))
            .when(F.size("_hd") > 0, F.struct(F.lit("description").alias("f"), F.get("_hd", F.lit(0)).alias("k")))
            .when(by_category != "", F.struct(F.lit("category").alias("f"), by_category.alias("k")))
        )
        return (
            staged.withColumn("_m", found)
            .withColumn("match_field", F.coalesce("_m.f", F.lit("")))
            .withColumn("match_keyword", F.coalesce("_m.k", F.lit("")))
            .drop("_ht", "_hc", "_hd", "_m")
        )

    def category_match(self, category: ColumnLike, source_category: ColumnLike | None = None) -> Column:
        """``tag:term`` for the first category term found as a whole word; '' when there is none."""
        chain = F.when(F.lit(False), F.lit(""))
        for value in [category] + ([source_category] if source_category is not None else []):
            text = F.concat(F.lit(" "), F.regexp_replace(normalize_text(value, "path"), NOT_ALNUM_BLANK + "+", f" {BARRIER} "), F.lit(" "))
            for term in self.category_terms:
                chain = chain.when(F.contains(text, F.lit(f" {_plain_words(term)} ")), f"{self.category_tag}:{term}")
        return chain.otherwise("")


def _anchors(words: DataFrame, grams: DataFrame) -> DataFrame:
    """``_gram, _size, _word, _offset, _before, _after`` per n-gram that the texts may hold: its rarest word, where it stands, and the words beside it.

    Words are counted over all texts (``words`` has the arrays in ``_w``); an n-gram with a word that no text has is left out.
    The vocabulary is stored, so that it goes to the texts by its size and their words are not dealt out.
    """
    vocabulary = stored(grams.select(F.explode("_w").alias("_word")).distinct(), "vocabulary")
    spoken = words.select(F.explode("_w").alias("_word")).join(vocabulary, "_word").groupBy("_word").agg(F.count(F.lit(1)).alias("_n"))
    each = grams.select("_gram", "_w", F.posexplode("_w").alias("_offset", "_word")).join(spoken, "_word")
    rarest = each.groupBy("_gram").agg(F.min(F.struct("_n", "_offset", "_word")).alias("_at"), F.count(F.lit(1)).alias("_known"), F.first("_w").alias("_w"))
    beside = lambda step: F.when(F.col("_at._offset") + step >= 0, F.get("_w", F.col("_at._offset") + step))
    return rarest.where(F.col("_known") == F.size("_w")).select(
        "_gram", F.size("_w").alias("_size"), F.col("_at._word").alias("_word"), F.col("_at._offset").alias("_offset"),
        beside(-1).alias("_before"), beside(1).alias("_after"))


def ngram_hits(texts: DataFrame, keys: list[str], column: str, terms: DataFrame,
               words_of: Callable[[ColumnLike], Column] = boundary_words) -> DataFrame:
    """Distinct (keys, term columns) rows where the term's words stand in the text, for a table of any size.

    An index of rare anchors: a term is looked for only where its rarest word stands, the words beside it are compared
    there and then, and the few places of longer terms that are left are verified on the words of their text. What the texts emit depends
    on how often anchors occur, not on the number or lengths of the terms. Terms without a word, and null ones, are nowhere.
    Anchors and the places met are stored: their sizes are known before the texts are read, which stay where they are beside a small table.
    """
    wanted = terms.withColumn("_w", words_of("term")).where("term IS NOT NULL").withColumn("_gram", F.array_join("_w", " "))
    words = texts.select(*keys, words_of(column).alias("_w"))
    anchors = stored(_anchors(words, wanted.select("_gram", "_w").distinct()), "anchors")
    none = F.array(F.lit(None).cast("string"))
    size = F.size("_w")
    shifted = F.arrays_zip(F.col("_w").alias("word"), F.concat(none, F.slice("_w", 1, F.greatest(size - 1, F.lit(0)))).alias("before"),
                           F.concat(F.slice("_w", 2, F.greatest(size - 1, F.lit(0))), none).alias("after"))
    places = words.select(*keys, F.posexplode(shifted).alias("_place", "_one")).select(
        *keys, "_place", F.col("_one.word").alias("_word"), F.col("_one.before").alias("_left"), F.col("_one.after").alias("_right"))
    beside = (F.col("_before").isNull() | (F.col("_before") == F.col("_left"))) & (F.col("_after").isNull() | (F.col("_after") == F.col("_right")))
    met = stored(places.join(anchors, "_word").where(beside).select(
        *keys, "_gram", "_size", (F.col("_place") - F.col("_offset")).alias("_start"),
        ((F.col("_offset") <= 1) & (F.col("_size") - F.col("_offset") <= 2)).alias("_whole")), "places")
    longer = met.where("NOT _whole AND _start >= 0").groupBy(*keys).agg(F.collect_set(F.struct("_start", "_size", "_gram")).alias("_open"))
    own = longer.select(*[F.col(k).alias(f"_key_{k}") for k in keys], "_open")
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys])
    stands = F.filter("_open", lambda o: F.array_join(F.slice(F.col("_w"), o["_start"] + 1, o["_size"]), " ") == o["_gram"])
    verified = words.join(own, same).select(*keys, F.explode(F.transform(stands, lambda o: o["_gram"])).alias("_gram"))
    found = met.where("_whole").select(*keys, "_gram").union(verified).distinct()
    return found.join(wanted.drop("_w").distinct(), "_gram").drop("_gram").distinct()


def _no_hits(texts: DataFrame, keys: list[str], terms: DataFrame, on: Sequence[str] = ()) -> DataFrame:
    """The empty result for an empty term table."""
    blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in terms.schema.fields if f.name not in on]
    return texts.limit(0).select(*keys, *blank)


def substring_hits(texts: DataFrame, keys: list[str], column: str, terms: DataFrame, on: Sequence[str] = ()) -> DataFrame:
    """Distinct (keys, term, extra columns) where the term is contained in the text, anywhere.

    A term can only be inside a text that has the term's first few characters, so both sides meet on
    that gram and only then are compared in full. Terms are worked off by classes of length: short ones
    have a gram of their own length, and a window is as long as the longest term of its class only.
    Columns named in ``on`` must be equal on both sides as well.
    """
    lengths = [r["n"] for r in terms.select(F.length("term").alias("n")).where("n > 0").distinct().collect()]
    parts = []
    for low, high in zip(LENGTH_CLASSES, [*LENGTH_CLASSES[1:], None], strict=True):
        own = [n for n in lengths if n >= low and (high is None or n < high)]
        if own:
            inside = (F.length("term") >= low) & (F.length("term") <= max(own))
            parts.append(_window_hits(texts, keys, column, terms.where(inside), on, LONG_GRAM if low >= LONG_GRAM else min(MAX_GRAM, min(own)), max(own)))
    if not parts:
        return _no_hits(texts, keys, terms, on)
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found


# the first lengths of the classes; all lengths of one class share a gram and a window
LENGTH_CLASSES = (1, 2, 4, 16)
LONG_GRAM = 16


def _window_hits(texts: DataFrame, keys: list[str], column: str, terms: DataFrame, on: Sequence[str], gram: int, longest: int) -> DataFrame:
    if gram == LONG_GRAM:
        # a long gram is rare: texts come back for the few pairs that share one, no window is cut
        grams = F.array_distinct(F.regexp_extract_all(F.col(column), F.lit(rf"(?s)(?=(.{{{gram}}}))"), 1))
        left = texts.select(*keys, F.explode(grams).alias("_gram"))
        pairs = left.join(terms.withColumn("_gram", F.substring("term", 1, gram)), ["_gram", *on]).drop("_gram").distinct()
        back = texts.select(*keys, F.col(column).alias("_text"))
        return pairs.join(back, keys).where(F.contains("_text", F.col("term"))).drop("_text").distinct()
    windows = F.regexp_extract_all(F.col(column), F.lit(rf"(?s)(?=(.{{{gram},{longest}}}))"), 1)
    left = texts.select(*keys, F.explode(F.array_distinct(windows)).alias("_window"))
    left = left.withColumn("_gram", F.substring("_window", 1, gram))
    right = terms.withColumn("_gram", F.substring("term", 1, gram))
    return left.join(right, ["_gram", *on]).where(F.startswith(F.col("_window"), F.col("term"))).drop("_gram", "_window").distinct()
