"""Rows out of captured pages: menu links, order tables, status counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from merchloom.functions import html as H
from merchloom.functions.base import ColumnLike, col, let, strip
from merchloom.functions.dates import ORDER_STATUS_LABELS, status_key
from merchloom.functions.urls import collection_handle


def nav_links(pages: DataFrame, key: str, url: str, html: str) -> DataFrame:
    """Menu links of each page: (key, position, title, absolute url, handle)."""
    base = F.regexp_extract(url, r"^(https?://[^/?#]+)", 1)
    nav = F.regexp_extract(html, r"(?is)<nav[^>]*>(.*?)</nav>", 1)
    anchors = F.regexp_extract_all(nav, F.lit(r"(?is)(<a [^>]*>.*?</a>)"), 1)
    rows = pages.select(key, base.alias("_base"), F.posexplode(anchors).alias("position", "_a"))
    links = rows.select(
        key, "position", "_base",
        H.unescape(F.regexp_extract("_a", r"""(?i)href=["']([^"']*)["']""", 1)).alias("_href"),
        strip(H.inner_text("_a")).alias("title"))
    skip = F.col("_href").rlike(r"^(#|javascript:|mailto:|tel:)") | (F.col("_href") == "")
    full = F.when(F.col("_href").rlike("^https?://"), F.col("_href")).when(
        F.col("_href").startswith("/"), F.concat("_base", "_href")).otherwise(F.concat("_base", F.lit("/"), "_href"))
    kept = links.where(~skip & ~H.is_garbage_title("title")).select(key, "position", "title", full.alias("url"))
    return kept.withColumn("handle", F.coalesce(collection_handle("url"), F.lit("")))


def nav_tree(pages: DataFrame, key: str, url: str, html: str) -> DataFrame:
    """Two-level menu of each page: (key, level1, level2, url, handle) from the nesting of its lists.

    Menus are the ``nav`` elements and, on a page without any, lists whose class names a navigation or menu;
    the first one with rows counts. An entry of the outer list with a list of its own gives its links as
    level two; one without gives itself if it leads to a collection. Tags are numbered in their page
    and nesting is a running sum over them, so a window holds one menu.
    """
    base = F.regexp_extract(url, r"^(https?://[^/?#]+)", 1)
    navs = H.elements(html, "nav")
    lists = F.regexp_extract_all(col(html), F.lit(r"""(?is)(<ul\b[^>]*class\s*=\s*["'][^"']*(?:nav|menu)[^"']*["'].*)"""), 1)
    menus = pages.select(key, base.alias("_base"), F.posexplode(F.when(F.size(navs) > 0, navs).otherwise(lists)).alias("_menu", "_body"))
    tags = F.regexp_extract_all("_body", F.lit(r"(?is)(<ul\b[^>]*>|</ul\s*>|<ol\b[^>]*>|</ol\s*>|<li\b|<a\s[^>]*>.*?</a\s*>)"), 1)
    rows = menus.select(key, "_base", "_menu", F.posexplode(tags).alias("_at", "_tag"))
    running = Window.partitionBy(key, "_menu").orderBy("_at")
    step = F.when(F.lower("_tag").rlike("^<[uo]l"), 1).when(F.startswith("_tag", F.lit("</")), -1).otherwise(0)
    nested = rows.withColumn("_depth", F.sum(step).over(running))
    # a list that is closed for good ends the menu
    opened = F.min(F.when((F.col("_depth") <= 0) & (step < 0), F.col("_at"))).over(Window.partitionBy(key, "_menu"))
    entries = nested.withColumn("_end", opened).where("_end IS NULL OR _at <= _end").withColumn(
        "_entry", F.sum(F.when(F.lower("_tag").startswith("<li") & (F.col("_depth") == 1), 1).otherwise(0)).over(running)).where("_entry > 0")
    inner = Window.partitionBy(key, "_menu", "_entry")
    links = entries.withColumn("_parent", F.max(F.when(F.col("_depth") > 1, True)).over(inner)).where(F.lower("_tag").startswith("<a")).select(
        key, "_base", "_menu", "_entry", "_at", "_depth", "_parent", H.attribute("_tag", "href").alias("_href"), strip(H.inner_text("_tag")).alias("_title"))
    first = F.min(F.struct("_at", "_title", "_href")).over(inner)
    full = F.when(F.col("_href").rlike("^https?://"), F.col("_href")).when(
        F.startswith("_href", F.lit("/")), F.concat("_base", "_href")).otherwise(F.concat("_base", F.lit("/"), "_href"))
    named = links.withColumn("_first", first).select("*", F.col("_first._title").alias("level1"), full.alias("url")).where(
        ~H.is_garbage_title("level1") & ~F.col("_first._href").rlike("^(#|javascript:|mailto:|tel:)") & (F.col("_first._href") != ""))
    child = F.coalesce("_parent", F.lit(False)) & (F.col("_depth") > 1) & (F.col("_title") != "") & (F.col("_href") != "") & (F.col("_href") != "#")
    alone = F.col("_parent").isNull() & (F.col("_at") == F.col("_first._at"))
    found = named.withColumn("handle", F.coalesce(collection_handle("url"), F.lit(""))).where(child | (alone & (F.col("handle") != "")))
    best = found.withColumn("_best", F.min("_menu").over(Window.partitionBy(key))).where("_menu = _best")
    return best.select(key, "level1", F.when(child, F.col("_title")).otherwise(F.col("level1")).alias("level2"), "url", "handle")


def _kept_rows(found: Column) -> Column:
    """The orders among captured table rows; each row is read once."""
    return F.filter(F.transform(found, lambda row: H.order_row(row, tuple(ORDER_STATUS_LABELS))), lambda r: r["kept"])


def order_rows(pages: DataFrame, html: str) -> DataFrame:
    """Order table rows of each page; rows with neither an order id nor a status are dropped."""
    rows = F.regexp_extract_all(col(html), F.lit(f"(<tr[^>]*>{H.until('/tr>')}</tr>)"), 1)
    others = [c for c in pages.columns if c != html]
    return pages.select(*others, F.explode(_kept_rows(rows)).alias("_o")).select(
        *others, "_o.order_id", "_o.order_time", "_o.order_status", "_o.order_amount")


def _said(html: ColumnLike, word: str, pattern: str) -> Column:
    """First group of a pattern that no text without the word fits; such texts are not searched."""
    page = col(html)
    return F.when(page.rlike(H.any_case(word)), F.regexp_extract(page, pattern, 1)).otherwise("")


def status_counts(html: ColumnLike) -> Column:
    """Map of order status to its counter in the status list of a captured page."""
    listing = _said(html, "subsubsub", f"(?i)<ul[^>]*subsubsub[^>]*>({H.until('/ul>')})</ul>")
    items = F.regexp_extract_all(listing, F.lit(f"(?i)(<li[^>]*>{H.until('/li>')}</li>)"), 1)
    known = list(ORDER_STATUS_LABELS)

    def name(item: Column) -> Column:
        def by_link(href: Column) -> Column:
            all_page = F.contains(href, F.lit("page=wc-orders")) | F.contains(href, F.lit("post_type=shop_order"))
            return let(status_key(F.regexp_extract(href, r"status=([a-z0-9-]+)", 1)), lambda s: F.when(s != "", s).when(all_page, "all"))

        href = F.regexp_extract(item, r"""href=["']([^"']*)["']""", 1)
        by_class = status_key(F.regexp_extract(item, r"""<li[^>]*class=["']([^"' ]+)""", 1))
        return let(by_class, lambda s: F.when(s.isin(*known), s).otherwise(let(href, by_link)))

    def entry(item: Column) -> Column:
        return F.struct(name(item).alias("key"), H.count_inside(item).alias("value"))

    pairs = F.filter(F.transform(items, entry), lambda e: e["key"].isin(*known) & e["value"].isNotNull())

    # a status may be listed twice: its last counter stands
    def last(found: Column, key: str) -> Column:
        counters = F.filter(found, lambda e: e["key"] == key)
        return F.struct(F.lit(key).alias("key"), F.try_element_at(counters, F.lit(-1))["value"].alias("value"))

    def counters(found: Column) -> Column:
        return F.map_from_entries(F.filter(F.array(*[last(found, key) for key in known]), lambda e: e["value"].isNotNull()))

    return let(pairs, counters)


def filtered_total(html: ColumnLike, status: str) -> Column:
    """Number of orders of a status: what the page shows, else its counter, else its rows of that status."""
    own = F.filter(_kept_rows(H.elements(html, "tr")), lambda r: status_key(r["order_status"]) == status)
    return F.coalesce(visible_count(html), F.try_element_at(status_counts(html), F.lit(status)), F.size(own).cast("bigint"))


def visible_count(html: ColumnLike) -> Column:
    """The number of rows that the page says it shows; NULL when it does not."""
    shown = _said(html, "displaying-num", r"""(?is)<[^>]*class=["'][^"']*\bdisplaying-num\b[^>]*>(.*?)</""")
    return H.count_inside(shown)
