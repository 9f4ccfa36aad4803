"""Extraction from captured HTML by regular expressions of fixed shape."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from merchloom.functions.base import ColumnLike, any_of, col, collapse_ws, let, strip, text_or_empty
from merchloom.functions.dates import status_key

# Navigation titles that name no category.
GARBAGE_TITLES = (
    "all", "all products", "全部", "全部商品", "new", "new arrivals", "新品", "sale", "特价", "促销",
    "frontpage", "home", "首页", "shop", "store", "gift card", "giftcard", "blog", "news", "about",
    "contact", "faq", "search", "login", "register", "cart", "wishlist", "wish list",
)
# Terms that make a collection handle unusable.
GARBAGE_HANDLE_TERMS = (
    "all", "new", "sale", "gift", "brand", "accessories", "apparel", "collection", "t-shirt", "hoodie",
    "shirt", "bundle", "parts", "tools", "supplies",
)
# Scripts of payment providers that mark a generic shop page.
SHOP_INDICATORS = (
    "js.stripe.com", "stripe.js", "paypal.com/sdk", "paypalobjects.com", "klarna.com", "squareup.com",
    "shopify_payments", "afterpay.com", '<meta name="generator" content="prestashop">', "opencart",
)


def unescape(value: ColumnLike) -> Column:
    """The five markup entities and the no-break space; a text without ``&`` stays as it is."""
    def replaced(text: Column) -> Column:
        for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"),
                             ("&#039;", "'"), ("&amp;", "&")):
            text = F.replace(text, F.lit(entity), F.lit(char))
        return text

    return let(col(value), lambda text: F.when(F.contains(text, F.lit("&")), replaced(text)).otherwise(text))


def any_case(word: str) -> str:
    """Pattern of a word in any case of its ASCII letters, without lowering the text; its first sign is a class, which is skipped to fast."""
    first = word[0]
    return f"[{first.lower()}{first.upper()}](?i:{word[1:]})"


def until(end: str) -> str:
    """Pattern of all up to the next tag that fits ``end``: a run of other signs at a time, without backtracking."""
    return rf"[^<]*+(?:<(?!{end})[^<]*+)*+"


def html_title(html: ColumnLike) -> Column:
    return F.substring(strip(F.regexp_extract(col(html), r"(?is)<title[^>]*>(.*?)</title>", 1)), 1, 200)


def inner_text(html: ColumnLike) -> Column:
    return unescape(collapse_ws(F.regexp_replace(col(html), r"<[^>]*>", "")))


def is_garbage_title(title: ColumnLike) -> Column:
    """Whether a title is blank or begins with one that names no category; it is trimmed and lowered once."""
    def garbage(text: Column) -> Column:
        return (text == "") | text.isin(*GARBAGE_TITLES) | any_of([text.startswith(t + end) for t in GARBAGE_TITLES for end in " -"])

    return let(F.lower(text_or_empty(title)), garbage)


def is_garbage_collection(title: ColumnLike, handle: ColumnLike) -> Column:
    lowered = F.lower(F.coalesce(col(handle), F.lit("")))
    terms = any_of([F.contains(lowered, F.lit(t)) for t in GARBAGE_HANDLE_TERMS])
    return terms | (F.length(text_or_empty(title)) <= 4)


def split_levels(title: ColumnLike) -> Column:
    """Two levels of a collection title split at the first ``>``, ``|`` or dash."""
    parts = F.split(col(title), r"\s*[>|–—-]\s*", 2)
    two = F.size(parts) == 2
    return F.struct(
        F.when(two, strip(F.get(parts, F.lit(0)))).otherwise(col(title)).alias("level1"),
        F.when(two, strip(F.get(parts, F.lit(1)))).otherwise(col(title)).alias("level2"),
    )


def attribute(tag: ColumnLike, name: str) -> Column:
    """Value of an attribute in the first tag of a text, quoted in any way; '' when it is not there."""
    value = F.regexp_extract(col(tag), rf"""(?is)^[^<]*<[^>]*?\s{name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", 1)
    return unescape(F.btrim(value, F.lit("\"'")))


def elements(html: ColumnLike, name: str) -> Column:
    """All elements of a name that do not hold one of the same name."""
    end = rf"/{name}\s*>"
    return F.regexp_extract_all(col(html), F.lit(rf"(?i)(<{name}\b[^>]*>{until(end)}<{end})"), 1)


def _whole(digits: Column) -> Column:
    return F.regexp_replace(digits, "[^0-9]", "").try_cast("bigint")


def count_text(value: ColumnLike) -> Column:
    """Number in brackets, else the first whole number."""
    numbers = F.regexp_extract_all(col(value), F.lit(r"(\(\d+\)|\b\d+\b)"), 1)
    return let(numbers, lambda found: F.btrim(F.coalesce(
        F.get(F.filter(found, lambda n: F.startswith(n, F.lit("("))), F.lit(0)), F.get(found, F.lit(0))), F.lit("()")).try_cast("bigint"))


def count_inside(html: ColumnLike) -> Column:
    """:func:`count_text` of :func:`inner_text`: neither white space nor other entities hold or join digits."""
    text = F.regexp_replace(col(html), r"<[^>]*>", "")
    return count_text(F.replace(F.replace(text, F.lit("&#39;"), F.lit("'")), F.lit("&#039;"), F.lit("'")))


def page_total(value: ColumnLike) -> Column:
    return F.coalesce(_whole(F.regexp_extract(col(value), r"of\s+(\d+)", 1)), F.lit(1).cast("bigint"))


# How result pages word their number of hits, the more certain wording first.
RESULT_WORDINGS = (r"(?i)about\s+{n}\s+results", r"约\s+{n}\s+条结果", r"(?i){n}\s+results")


def result_total(html: ColumnLike) -> Column:
    """Number of hits on a captured result page: by its wording, else the first number of its statistics line."""
    number = r"(\d[\d,]*)"
    worded = [F.regexp_extract(col(html), wording.replace("{n}", number), 1) for wording in RESULT_WORDINGS]
    line = F.filter(elements(html, "div"), lambda div: attribute(div, "id") == "result-stats")
    worded.append(F.regexp_extract(inner_text(F.get(line, F.lit(0))), number, 1))
    return F.coalesce(*[F.nullif(_whole(found), F.lit(0).cast("bigint")) for found in worded])


def _filled(value: Column) -> Column:
    """The text, NULL if it is empty."""
    return let(value, lambda text: F.when(text != "", text))


def _classed(html: ColumnLike, name: str) -> Column:
    """All elements of a name, each with its class."""
    return F.transform(elements(html, name), lambda cell: F.struct(cell.alias("html"), attribute(cell, "class").alias("class")))


def _first(cells: Column, *names: str) -> Column:
    """The first of some elements whose class holds one of the names."""
    kept = F.filter(cells, lambda cell: any_of([F.contains(cell["class"], F.lit(name)) for name in names]))
    return F.get(kept, F.lit(0))["html"]


def order_row(row: ColumnLike, statuses: tuple[str, ...] = ()) -> Column:
    """Fields of one captured order table row, and ``kept``: whether it is an order.

    Two layouts are read. Either the row's own id names the order, or its cells do: a link to the order's
    edit page, cells with classes for date and total. A row of headings is an order only if it says so; any other
    row is one if it has an id or a status. Whatever is used more than once is bound, so that a row's tags are searched once.
    """
    def read(html: Column) -> Column:
        return F.struct(html.alias("html"), attribute(html, "id").alias("id"), inner_text(html).alias("text"), _classed(html, "td").alias("cells"))

    def dated(r: Column) -> Column:
        cell = _first(r["cells"], "order_date", "order-date")

        def said(at: Column) -> Column:
            return F.coalesce(_filled(attribute(at["clock"], "datetime")), _filled(inner_text(at["clock"])), inner_text(at["cell"]))

        return let(let(cell, lambda c: F.struct(c.alias("cell"), F.get(elements(F.coalesce(c, r["html"]), "time"), F.lit(0)).alias("clock"))), said)

    def time_text(said: Column) -> Column:
        layout = r"^(\d{4}-\d\d-\d\d)[T ](\d\d:\d\d(?::\d\d)?)"
        moment = F.regexp_extract(said, layout, 1)
        return let(moment, lambda day: F.when(day != "", F.concat_ws(" ", day, F.regexp_extract(said, layout, 2))).otherwise(F.when(said != "", said)))

    def number(r: Column) -> Column:
        html = r["html"]
        # Where the shop software's addresses hold an order's number.
        link = F.regexp_extract(unescape(html), r"""(?is)<a\s[^>]*href\s*=\s*["'][^"']*(?:action=edit&id=|[?&]post=)(\d+)""", 1)
        spoken = F.regexp_extract(inner_text(F.regexp_replace(html, "<", " <")), r"#?(\d{3,})", 1)
        named = F.regexp_extract(r["id"], r"^order-(\d+)", 1)
        return F.coalesce(_filled(named), _filled(link), F.when(F.size(r["cells"]) > 2, _filled(spoken))).try_cast("bigint")

    def shown(r: Column) -> Column:
        marked = F.startswith(r["id"], F.lit("order-")) | F.contains(attribute(r["html"], "class"), F.lit("type-shop_order"))
        marked = marked | r["text"].rlike(any_case("order_number"))
        return marked | ~r["html"].rlike("<[tT][hH]")

    def amount(r: Column) -> Column:
        price = inner_text(_first(r["cells"], "order_total", "order-total", "total"))
        money = F.regexp_extract_all(price, F.lit(r"(\d[\d,]*\.\d{2})"), 1)
        return F.coalesce(F.replace(let(money, lambda m: F.get(m, F.size(m) - 1)), F.lit(","), F.lit("")).try_cast("double"), F.lit(0.0))

    def found(r: Column) -> Column:
        badge = _first(_classed(r["html"], "mark"), "order-status")
        status = F.coalesce(F.lower(strip(inner_text(badge))), status_key(_row_status(r["html"], r["text"], statuses)) if statuses else F.lit(""))
        parts = let(shown(r), lambda s: F.struct(s.alias("shown"), F.when(s, number(r)).alias("number"), status.alias("status")))
        return let(parts, lambda f: F.struct(
            f["number"].alias("order_id"),
            let(dated(r), time_text).alias("order_time"),
            f["status"].alias("order_status"),
            amount(r).alias("order_amount"),
            (f["shown"] & (r["text"] != "") & (f["number"].isNotNull() | (f["status"] != ""))).alias("kept"),
        ))

    return let(let(col(row), read), found)


def row_status(row: ColumnLike, statuses: tuple[str, ...]) -> Column:
    """Status of a captured row from its class, else from its text."""
    return let(col(row), lambda html: _row_status(html, inner_text(html), statuses))


def _row_status(html: Column, text: Column, statuses: tuple[str, ...]) -> Column:
    def by_text(lowered: Column) -> Column:
        chain = F.when(F.lit(False), "")
        for status in statuses:
            chain = chain.when(F.contains(lowered, F.lit(status)), status)
        return chain.otherwise("")

    by_class = F.regexp_extract(html, r"""class=["'][^"']*\bstatus-([a-z0-9-]+)""", 1)
    return let(by_class, lambda name: F.when(name != "", name).otherwise(let(F.lower(text), by_text)))


def detect_platform(html: ColumnLike, meta_json: ColumnLike, products_json: ColumnLike, version_text: ColumnLike) -> Column:
    """Shop software by captured responses; the first rule that holds wins."""
    page = F.coalesce(col(html), F.lit(""))
    lowered = F.lower(page)
    generic = any_of([F.contains(lowered, F.lit(i)) for i in SHOP_INDICATORS])
    known = (
        F.when(F.get_json_object(col(meta_json), "$.published_products_count").isNotNull(), "Shopify")
        .when(F.ltrim(col(products_json)).startswith("["), "WooCommerce")
        .when(F.contains(col(version_text), F.lit("Magento")), "Magento")
        .when(F.contains(page, F.lit("BigCommerce")), "BigCommerce")
    )
    confidence = (
        F.when(known == "Shopify", 1.0).when(known == "WooCommerce", 0.9).when(known == "Magento", 0.8)
        .when(known == "BigCommerce", 0.7).when(generic, 0.3).otherwise(0.0)
    )
    return F.struct(F.coalesce(known, F.lit("unknown")).alias("platform"), confidence.alias("confidence"))
