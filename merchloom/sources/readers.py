"""Readers and flatteners for captured catalogs, keyword trees, rates and registries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from merchloom.functions.base import blank_to_null, strip, text_or_empty
from merchloom.functions.text import normalize_text, split_tags
from merchloom.functions.urls import (
    convert_price, first_sku, main_image, unique_key, variant_string, variant_titles,
)
from merchloom.session import cut_lineage

# Field names of crawled product documents and their English names.
FIELD_ALIASES = {
    "title": ("标题", "title"),
    "description": ("描述", "desc", "description"),
    "sub_description": ("子描述", "sub_description"),
    "image": ("图片", "image"),
    "original_price": ("原价", "original_price"),
    "discount_price": ("折扣价", "discount_price"),
    "variant": ("变体", "variant"),
    "variant_name": ("变体名", "variant_name"),
    "variant_value": ("变体值", "variant_value"),
    "category": ("分类", "category"),
    "source_category": ("source_category",),
    "unique_key": ("unique_key",),
}
NUMERIC_FIELDS = ("original_price", "discount_price")

PAYLOAD_SCHEMA = """
products ARRAY<STRUCT<
  id: STRING, title: STRING, handle: STRING, body_html: STRING, product_type: STRING, tags: STRING,
  images: ARRAY<STRUCT<src: STRING>>,
  variants: ARRAY<STRUCT<sku: STRING, price: STRING, compare_at_price: STRING, title: STRING>>,
  options: ARRAY<STRUCT<name: STRING, `values`: ARRAY<STRING>>>>>
"""


def read_products_jsonl(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """One product per line under English or original field names.

    ``strict`` fails on a malformed line; otherwise such lines stay in ``_corrupt``.
    """
    names = [alias for aliases in FIELD_ALIASES.values() for alias in aliases]
    fields = [T.StructField(n, T.StringType()) for n in names] + [T.StructField("_corrupt", T.StringType())]
    reader = spark.read.schema(T.StructType(fields)).option("columnNameOfCorruptRecord", "_corrupt")
    raw = reader.option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path)
    return rename_product_fields(raw, keep=() if strict else ("_corrupt",))


def rename_product_fields(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """First alias that is present wins; blank numbers become NULL."""
    present = {f.lower() for f in df.columns}
    out: list[Column] = []
    for name, aliases in FIELD_ALIASES.items():
        usable = [F.col(f"`{a}`") for a in aliases if a.lower() in present]
        value = F.coalesce(*usable) if usable else F.lit(None).cast("string")
        out.append((blank_to_null(value).try_cast("double") if name in NUMERIC_FIELDS else value).alias(name))
    return df.select(*out, *keep)


def canonical_header(name: str) -> str:
    """Header as the alias table spells it: trimmed, blanks as underscores, lower case."""
    return "_".join(name.strip().split()).lower()


def apply_header_aliases(df: DataFrame, aliases: Mapping[str, Sequence[str]], key: str) -> DataFrame:
    """Map arbitrary headers to canonical columns and drop rows whose key column is blank."""
    headers = {canonical_header(c): c for c in df.columns}
    chosen = []
    for target, names in aliases.items():
        found = [F.col(f"`{headers[canonical_header(n)]}`") for n in names if canonical_header(n) in headers]
        chosen.append((F.coalesce(*[blank_to_null(c) for c in found]) if found else F.lit(None).cast("string")).alias(target))
    return df.select(*chosen).where(F.col(key).isNotNull())


def read_table_file(spark: SparkSession, path: str, aliases: Mapping[str, Sequence[str]], key: str) -> DataFrame:
    """CSV with a header row, any column order and header spelling."""
    raw = spark.read.option("header", True).option("escape", '"').option("multiLine", False).csv(path)
    return apply_header_aliases(raw, aliases, key)


def split_text_rows(lines: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Text lines split at tab, comma or pipe into the given columns; blank keys are skipped."""
    parts = F.split("value", r"[\t,|]")
    named = [text_or_empty(F.get(parts, F.lit(i))).alias(c) for i, c in enumerate(columns)]
    return lines.select(*named).where(F.col(columns[0]) != "")


def classify_url_lines(lines: DataFrame) -> DataFrame:
    """Text lines to collection and store URLs; comments, blanks and other text are dropped."""
    text = strip("value")
    kind = F.when(F.contains(text, F.lit("/collections/")), "collection").when(F.contains(text, F.lit(".")), "store")
    url = F.when(text.rlike("^https?://"), text).otherwise(F.concat(F.lit("https://"), text))
    usable = (text != "") & ~text.startswith("#")
    return lines.where(usable).select(url.alias("url"), kind.alias("kind")).where("kind IS NOT NULL")


def explode_payload(df: DataFrame, payload: str) -> DataFrame:
    """One row per product of a captured ``{"products": [...]}`` text; see :func:`malformed_payloads` for the others."""
    parsed = F.from_json(payload, PAYLOAD_SCHEMA)
    return df.select("*", F.explode(parsed["products"]).alias("p")).drop(payload)


def malformed_payloads(df: DataFrame, payload: str) -> DataFrame:
    """The quarantine half of :func:`explode_payload`: rows whose payload has no list of products."""
    return df.where(F.from_json(payload, PAYLOAD_SCHEMA)["products"].isNull())


def flatten_catalog(df: DataFrame, store: str, payload: str) -> DataFrame:
    """Catalog payload to product rows with first-variant price, image list and tag list."""
    rows = explode_payload(df, payload)
    first = F.get("p.variants", F.lit(0))
    tags = F.col("p.tags")
    as_list = F.when(tags.startswith("["), F.from_json(tags, "array<string>")).otherwise(split_tags(tags))
    images = F.filter(F.transform("p.images", lambda i: i["src"]), lambda s: F.coalesce(s, F.lit("")) != "")
    return rows.select(
        F.concat(F.lit("https://"), F.col(store), F.lit("/products/"), F.coalesce("p.handle", F.lit(""))).alias("source_url"),
        F.coalesce("p.title", F.lit("")).alias("title"), F.coalesce("p.handle", F.lit("")).alias("handle"),
        F.coalesce(first["sku"], F.lit("")).alias("sku"),
        F.coalesce(blank_to_null(first["price"]).try_cast("double"), F.lit(0.0)).alias("price"),
        blank_to_null(first["compare_at_price"]).try_cast("double").alias("compare_at_price"),
        F.coalesce("p.body_html", F.lit("")).alias("body_html"),
        F.coalesce(as_list, F.array().cast("array<string>")).alias("tags"),
        F.coalesce(images, F.array().cast("array<string>")).alias("images"),
        F.coalesce("p.product_type", F.lit("")).alias("product_type"),
    )


def flatten_catalog_localized(df: DataFrame, store: str, payload: str, currency: str, rates: DataFrame,
                              category: str) -> DataFrame:
    """Catalog payload to sale rows in USD; rows without title, text or a price of 1 are dropped.

    Stores with an unknown currency yield no row here: see :func:`unknown_currency`.
    """
    priced = df.join(rates.select(F.upper(strip("code")).alias(currency), F.col("rate").alias("_rate")), currency)
    rows = explode_payload(priced, payload)
    first = F.get("p.variants", F.lit(0))
    original = convert_price(first["compare_at_price"], "_rate")
    discount = convert_price(first["price"], "_rate")
    image = main_image("p.images")
    built = rows.select(
        text_or_empty("p.id").alias("product_id"), first_sku("p.variants").alias("sku"),
        text_or_empty("p.title").alias("title"), text_or_empty("p.body_html").alias("description"),
        image.alias("image"), original.alias("original_price"), discount.alias("discount_price"),
        variant_string("p.options").alias("variant"), variant_titles("p.variants").alias("variant_value"),
        F.coalesce(blank_to_null("p.product_type"), F.col(category)).alias("category"),
        F.col(currency).alias("currency"), F.col(store).alias("source_domain"),
    )
    keyed = built.withColumn("unique_key", unique_key("source_domain", "product_id", "title", "image"))
    price = F.coalesce("discount_price", "original_price")
    return keyed.where((F.col("title") != "") & (F.col("description") != "") & (price >= 1))


def unknown_currency(df: DataFrame, currency: str, rates: DataFrame) -> DataFrame:
    """The quarantine half: stores whose currency has no rate."""
    return df.join(rates.select(F.upper(strip("code")).alias(currency)), currency, "left_anti")


def flatten_keyword_tree(df: DataFrame, column: str, keys: Sequence[str] = ()) -> DataFrame:
    """Nested keyword JSON of any depth to (level1, level2, level3, path, keyword) rows.

    ``path`` holds all level names; ``level3`` joins the third and deeper ones. A tree is opened one level at
    a time until no object is left; keywords stand in lists or alone. Text that is neither object nor list
    nor string is no tree: see :func:`malformed_trees`.
    """
    kept = [F.col(k) for k in keys]
    level = df.select(*kept, F.array().cast("array<string>").alias("path"), F.from_json(column, "map<string,string>").alias("_sub"))
    rows = None
    while True:
        opened = cut_lineage(level.select(*kept, "path", F.explode("_sub").alias("_name", "_leaf")).where("_leaf IS NOT NULL").select(
            *kept, F.array_append("path", F.col("_name")).alias("path"), F.ltrim("_leaf").alias("_leaf")))
        if opened.isEmpty():
            break
        inner, many = F.col("_leaf").startswith("{"), F.col("_leaf").startswith("[")
        words = opened.where(~inner).select(*kept, "path", F.explode(
            F.when(many, F.from_json("_leaf", "array<string>")).otherwise(F.array("_leaf"))).alias("keyword")).where("keyword IS NOT NULL")
        rows = words if rows is None else rows.unionByName(words)
        level = opened.where(inner).select(*kept, "path", F.from_json("_leaf", "map<string,string>").alias("_sub"))
    if rows is None:
        rows = df.limit(0).select(*kept, F.array().cast("array<string>").alias("path"), F.lit("").alias("keyword"))
    deep = F.when(F.size("path") > 2, F.array_join(F.slice("path", 3, F.size("path")), "|||"))
    return rows.select(*kept, F.get("path", F.lit(0)).alias("level1"), F.get("path", F.lit(1)).alias("level2"), deep.alias("level3"), "path", "keyword")


def malformed_trees(df: DataFrame, column: str) -> DataFrame:
    """The quarantine half: rows whose tree is no JSON object."""
    return df.where(F.from_json(column, "map<string,string>").isNull())


def tree_phrases(rows: DataFrame) -> DataFrame:
    """Distinct normalised phrases: every level name and every keyword."""
    phrase = F.explode(F.array_append("path", F.col("keyword")))
    return (
        rows.select(phrase.alias("_raw")).where("_raw IS NOT NULL")
        .select(normalize_text("_raw", "word").alias("phrase")).where("phrase <> ''").distinct()
    )


def read_rates(spark: SparkSession, path: str) -> DataFrame:
    """Currency table stored as a JSON list of ``nation`` and ``exchange_rate_usd``."""
    raw = spark.read.schema("nation STRING, exchange_rate_usd DOUBLE").option("multiLine", True).json(path)
    return clean_rates(raw.select(F.col("nation").alias("code"), F.col("exchange_rate_usd").alias("rate")))


def rates_from_map(df: DataFrame, column: str) -> DataFrame:
    """The ``{code: rate}`` form of the currency table."""
    return clean_rates(df.select(F.explode(F.from_json(column, "map<string,double>")).alias("code", "rate")))


def clean_rates(rates: DataFrame) -> DataFrame:
    code = F.upper(text_or_empty("code"))
    return rates.select(code.alias("code"), "rate").where((F.col("code") != "") & F.col("rate").isNotNull()).dropDuplicates(["code"])


ALL_SCOPES = "__all__"


def scoped(df: DataFrame, column: str, scope: str) -> DataFrame:
    """One partition of a table or all of them; a blank scope is an error."""
    if not scope or not scope.strip():
        raise ValueError("name a partition or use '__all__'")
    return df if scope == ALL_SCOPES else df.where(F.col(column) == scope)


def read_sites_jdbc(spark: SparkSession, url: str, table: str, key: str, lower: int, upper: int, parts: int,
                    **options: str) -> DataFrame:
    """Site registry from a database, read in parallel ranges of a numeric key."""
    reader = spark.read.format("jdbc").options(
        url=url, dbtable=table, partitionColumn=key, lowerBound=str(lower), upperBound=str(upper),
        numPartitions=str(parts), **options)
    return normalize_sites(reader.load())


def normalize_sites(df: DataFrame, status: str = "report_status", default: str = "new") -> DataFrame:
    """Blank out missing texts and give a missing report status its default."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    filled = df.na.fill("", subset=texts)
    return filled.withColumn(status, F.when(strip(status) == "", default).otherwise(F.col(status)))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Captured pages: id, URL and HTML."""
    return spark.read.parquet(path).select("page_id", "url", "html")
