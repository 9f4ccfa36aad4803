"""Taxonomy look-ups: node names, word overlap, parent chains and level counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merchloom.functions.base import ColumnLike, col, collapse_ws, strip
from merchloom.functions.text import singularize_phrase, squeeze_words, title_case
from merchloom.session import cut_lineage

# Words too common to show that a title belongs to a taxonomy node.
COMMON_WORDS = ("all", "the", "and", "for", "with", "new", "sale", "shop", "best", "top")


def normalize_to_taxonomy(df: DataFrame, column: str, nodes: DataFrame) -> DataFrame:
    """Add ``normalized`` (title case when the name or its singular is a node) and ``known``.

    Both look-ups are left joins to the distinct nodes; Spark broadcasts those when they are small
    enough, and rows then stay where they are.
    """
    known = nodes.select(F.lower(col("node")).alias("_node")).distinct()
    named = df.withColumn("_name", F.coalesce(collapse_ws(column), F.lit(""))).withColumns({
        "_exact": F.lower("_name"), "_stem": singularize_phrase("_name")})
    exact = known.select(F.col("_node").alias("_exact"), F.lit(True).alias("_is_exact"))
    stem = known.select(F.col("_node").alias("_stem"), F.lit(True).alias("_is_stem"))
    joined = named.join(exact, "_exact", "left").join(stem, "_stem", "left")
    normalized = (
        F.when(F.col("_is_exact"), title_case("_name")).when(F.col("_is_stem"), title_case("_stem")).otherwise(F.col("_name"))
    )
    return joined.select(
        *df.columns, normalized.alias("normalized"),
        (F.col("_is_exact").isNotNull() | F.col("_is_stem").isNotNull()).alias("known"))


def content_words(value: ColumnLike) -> F.Column:
    """Distinct words of three letters or more that are not common words."""
    return F.array_distinct(
        F.filter(squeeze_words(F.lower(col(value))), lambda w: (F.length(w) >= 3) & ~w.isin(*COMMON_WORDS))
    )


def overlap_flag(df: DataFrame, title: str, nodes: DataFrame, name: str = "hit") -> DataFrame:
    """Add whether the title is a node or shares a content word with one.

    Both tests are equi-joins on distinct titles: first title to name or word, then rows to titles. Words
    travel with a hash of their title.
    """
    title_id = F.unhex(F.sha2(F.lower(strip(title)), 256))
    names = nodes.select(F.lower(strip("node")).alias("key")).distinct()
    words = names.select(F.explode(content_words("key")).alias("key")).distinct()
    keys = df.select(title_id.alias("_title"), F.explode(content_words(F.lower(strip(title)))).alias("key")).distinct()
    matched = (
        names.select(F.unhex(F.sha2("key", 256)).alias("_title"))
        .union(keys.join(words, "key", "left_semi").select("_title")).distinct()
    )
    found = df.withColumn("_title", title_id).join(matched.withColumn("_hit", F.lit(True)), "_title", "left")
    return found.withColumn(name, F.coalesce("_hit", F.lit(False))).drop("_title", "_hit")


def word_overlap(df: DataFrame, title: str, nodes: DataFrame, anti: bool = False) -> DataFrame:
    """Rows whose title is a node or shares a content word with one (``anti``: the others)."""
    return overlap_flag(df, title, nodes, "_overlaps").where(F.col("_overlaps") != F.lit(anti)).drop("_overlaps")


def flatten_taxonomy(lines: DataFrame) -> DataFrame:
    """Distinct lower-case node names of ``A > B > C`` lines, optional numeric id prefix removed."""
    text = F.regexp_replace(strip("value"), r"^\d+\s+-\s+", "")
    parts = F.filter(F.transform(F.split(text, ">"), lambda p: F.lower(strip(p))), lambda p: p != "")
    return (
        lines.where((strip("value") != "") & ~strip("value").startswith("#"))
        .select(F.explode(parts).alias("node")).distinct()
    )


def _rounds(rows: DataFrame) -> int:
    """Rounds of doubling after which every chain of parents has met its root, or never will."""
    return max(1, rows.count()).bit_length() + 1


def _rooted(kids: DataFrame) -> DataFrame:
    """Ids with a chain of parents to a root, by pointer doubling: each round an id points to what its pointer pointed to."""
    state, left = cut_lineage(kids.select("id", "up").distinct()), _rounds(kids)
    while left and not state.where("up IS NOT NULL").isEmpty():
        ahead = state.select(F.col("id").alias("up"), F.col("up").alias("_next"))
        moved = state.where("up IS NOT NULL").join(ahead, "up").select("id", F.col("_next").alias("up"))
        state = cut_lineage(state.where("up IS NULL").union(moved).distinct())
        left -= 1
    return state.where("up IS NULL").select("id").distinct()


def parent_paths(nodes: DataFrame) -> DataFrame:
    """Path of titles from the root, and depth, for every (id, parent, name) row that hangs on a root.

    Pointer doubling: in each round a row takes over the path and the pointer of the row it points to, so a tree of depth d takes
    about log2(d) joins. A row that no chain of parents ties to a root, cycles among them, is in :func:`rootless`.
    Ids that repeat inside a cycle that hangs on a root have paths without end and are refused.
    """
    no_parent = F.col("parent").isNull() | (strip("parent") == "") | (F.col("parent") == "0")
    kids = cut_lineage(nodes.select("id", "name", F.when(~no_parent, F.col("parent")).alias("up")))
    rooted = _rooted(kids).withColumnRenamed("id", "up")
    rows = kids.where("up IS NULL").unionByName(kids.join(rooted, "up", "left_semi").select("id", "name", "up"))
    state, left = cut_lineage(rows.select("id", F.col("name").alias("path"), F.lit(1).alias("depth"), "up")), _rounds(rows)
    while not state.where("up IS NOT NULL").isEmpty():
        if not left:
            raise ValueError("paths without end: do ids repeat in a cycle?")
        ahead = state.select(F.col("id").alias("up"), F.col("path").alias("_path"), F.col("depth").alias("_depth"), F.col("up").alias("_next"))
        moved = state.where("up IS NOT NULL").join(ahead, "up").select(
            "id", F.concat_ws(" > ", "_path", "path").alias("path"), (F.col("depth") + F.col("_depth")).alias("depth"), F.col("_next").alias("up"))
        state = cut_lineage(state.where("up IS NULL").union(moved))
        left -= 1
    return state.drop("up")


def rootless(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """The rows whose chain of parents never reaches a root, and all below them."""
    return nodes.join(paths.select("id").distinct(), "id", "left_anti")


def level_counts(df: DataFrame, path_column: str) -> DataFrame:
    """Row counts rolled up every level of a ``|||`` path, with each node's parent and kind."""
    counts = df.groupBy(F.col(path_column).alias("_path")).agg(F.count(F.lit(1)).alias("_rows"))
    parts = counts.select("_path", "_rows", F.split("_path", r"\|\|\|").alias("_parts"))
    levels = parts.select("_rows", "_parts", F.explode(F.sequence(F.lit(1), F.size("_parts"))).alias("level"))
    nodes = (
        levels.select(
            F.array_join(F.slice("_parts", 1, F.col("level")), "|||").alias("node"),
            F.when(F.col("level") > 1, F.array_join(F.slice("_parts", 1, F.col("level") - 1), "|||")).alias("parent"),
            "level", "_rows", (F.col("level") == F.size("_parts")).alias("_leaf"),
        )
        .groupBy("node", "parent", "level")
        .agg(F.sum("_rows").alias("total"),
             F.sum(F.when(F.col("_leaf"), F.col("_rows")).otherwise(0)).alias("own"),
             F.max(~F.col("_leaf")).alias("_has_children"))
    )
    kind = (
        F.when(F.col("parent").isNotNull(), "child")
        .when(F.col("_has_children"), "parent").otherwise("flat")
    )
    return nodes.select("node", "parent", "level", "total", "own", kind.alias("kind"))
