"""URL, domain, price, variant and key functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from merchloom.functions.base import ColumnLike, col, strip, text_or_empty

HAS_SCHEME = r"^https?://"


def with_scheme(value: ColumnLike) -> Column:
    text = text_or_empty(value)
    return F.when(text == "", "").when(text.rlike(HAS_SCHEME), text).otherwise(F.concat(F.lit("https://"), text))


def normalize_url(value: ColumnLike) -> Column:
    """Trim, add a scheme, drop trailing slashes."""
    return F.rtrim(with_scheme(value), F.lit("/"))


def _netloc(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def url_netloc(value: ColumnLike) -> Column:
    """Host and port of a full URL, lower case; '' when there is none."""
    return F.lower(_netloc(col(value)))


def drop_www(host: Column) -> Column:
    return F.regexp_replace(host, r"^www\.", "")


def extract_domain(value: ColumnLike, keep_port: bool = True) -> Column:
    host = drop_www(url_netloc(value))
    return host if keep_port else F.substring_index(host, ":", 1)


def base_url(value: ColumnLike) -> Column:
    """Scheme and host only."""
    full = with_scheme(value)
    host = extract_domain(full)
    return F.when(host == "", "").otherwise(F.concat(F.regexp_extract(full, r"^(https?)://", 1), F.lit("://"), host))


def public_url(value: ColumnLike) -> Column:
    """Canonical https URL of the public host; the hosted sub-domain is rewritten to .com."""
    host = drop_www(F.replace(_netloc(col(value)), F.lit(".myshopify.com"), F.lit(".com")))
    return F.when(host == "", "").otherwise(F.concat(F.lit("https://"), host))


def hosted_url(value: ColumnLike) -> Column:
    """The original hosted URL when :func:`public_url` rewrote it, else NULL."""
    host = _netloc(col(value))
    return F.when(F.contains(host, F.lit(".myshopify.com")), F.concat(F.lit("https://"), host))


def registrable_domain(host: ColumnLike) -> Column:
    """Last two labels of the host; the public-suffix list is approximated by that."""
    return F.substring_index(F.lower(F.substring_index(col(host), ":", 1)), ".", -2)


def site_label(value: ColumnLike) -> Column:
    """First label of the bare domain."""
    return F.substring_index(bare_domain(value), ".", 1)


def bare_domain(value: ColumnLike) -> Column:
    """Protocol, surrounding slashes and www. removed; lower case."""
    text = F.regexp_replace(F.lower(text_or_empty(value)), "https?://", "")
    return drop_www(F.btrim(text, F.lit("/")))


def collection_handle(value: ColumnLike) -> Column:
    """Path segment after /collections/, NULL when the URL has none."""
    handle = F.regexp_extract(F.regexp_replace(col(value), r"[?#].*$", ""), r"/collections/([^/]+)", 1)
    return F.when(handle != "", handle)


def parse_domain_list(value: ColumnLike) -> Column:
    """Distinct bare domains of a free-text list, in order of first mention."""
    pieces = F.filter(F.split(col(value), r"[\s,;，；]+"), lambda p: p != "")
    return F.array_distinct(F.filter(F.transform(pieces, bare_domain), lambda d: d != ""))


def convert_price(value: ColumnLike, rate: ColumnLike) -> Column:
    """Price in USD, half-even at two decimals; NULL when the text is no number."""
    text = F.regexp_replace(strip(col(value).cast("string")), ",", "")
    return F.bround(text.try_cast("double") * col(rate), 2)


def parse_price_first(*candidates: ColumnLike) -> Column:
    """First of the given columns that holds a number."""
    return F.coalesce(*[strip(col(c).cast("string")).try_cast("double") for c in candidates])


def main_image(images: ColumnLike) -> Column:
    """First non-blank image of a list of structs with ``src``, query string cut."""
    sources = F.filter(F.transform(col(images), lambda i: text_or_empty(i["src"])), lambda s: s != "")
    return F.coalesce(F.substring_index(F.get(sources, F.lit(0)), "?", 1), F.lit(""))


def first_sku(variants: ColumnLike) -> Column:
    return text_or_empty(F.get(col(variants), F.lit(0))["sku"])


def first_prices(variants: ColumnLike) -> Column:
    """Struct of the first variant's compare-at and sale price; NULL where blank or no number."""
    first = F.get(col(variants), F.lit(0))
    return F.struct(strip(first["compare_at_price"]).try_cast("double").alias("original_price"),
                    strip(first["price"]).try_cast("double").alias("discount_price"))


def variant_string(options: ColumnLike) -> Column:
    """``name^v1#v2|||…`` over the options, without the placeholder option."""
    real = F.filter(col(options), lambda o: (text_or_empty(o["name"]) != "") & (strip(o["name"]) != "Title"))
    parts = F.transform(real, lambda o: F.concat(strip(o["name"]), F.lit("^"), F.array_join(o["values"], "#")))
    return F.coalesce(F.array_join(parts, "|||"), F.lit(""))


def variant_titles(variants: ColumnLike) -> Column:
    """``name#name…`` built from variant titles, for payloads without options."""
    names = F.filter(F.transform(col(variants), lambda v: text_or_empty(v["title"])),
                     lambda n: (n != "") & (n != "Default Title"))
    return F.coalesce(F.array_join(names, "#"), F.lit(""))


def unique_key(domain: ColumnLike, product_id: ColumnLike, title: ColumnLike, image: ColumnLike) -> Column:
    """Key by id, else by lower-case title and image."""
    pid = text_or_empty(col(product_id).cast("string"))
    fallback = F.concat_ws("|||", col(domain), F.lit("fallback"),
                           F.lower(text_or_empty(title)), F.lower(text_or_empty(image)))
    return F.when(pid != "", F.concat_ws("|||", col(domain), F.lit("id"), pid)).otherwise(fallback)
