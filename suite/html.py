"""Extraction from captured pages, text times and status labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from merchloom.functions import dates as D
from merchloom.functions import html as H
from merchloom.operators import pages as P
from suite import duck, query


@query("html_title", f"""
SELECT page_id, substring({duck.strip("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")}, 1, 200) AS title FROM pages
""")
def _(t):
    return t.pages.select("page_id", H.html_title("html").alias("title"))


_LINKS = r"""
nav AS (SELECT page_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS base, regexp_extract(html, '(?is)<nav[^>]*>(.*?)</nav>', 1) AS nav FROM pages),
a AS (SELECT page_id, base, unnest(regexp_extract_all(nav, '(?is)<a [^>]*>.*?</a>')) AS a FROM nav),
l AS (SELECT page_id, base, regexp_extract(a, 'href="([^"]*)"', 1) AS href, trim(regexp_replace(a, '<[^>]*>', '', 'g')) AS title FROM a)
"""


@query("nav_links", rf"""
WITH {_LINKS}
SELECT page_id, title, base || href AS url FROM l
WHERE title <> '' AND lower(title) NOT IN ('all','new','sale','home','shop','store','blog','news','about','contact','faq','search','login','register','cart','wishlist')
  AND NOT regexp_matches(lower(title), '^(all|new|sale|home|shop|store|blog|news|about|contact|faq|search|login|register|cart|wishlist)[ -]')
""")
def _(t):
    return P.nav_links(t.pages, "page_id", "url", "html").select("page_id", "title", "url")


_MENU = """
SELECT p_partkey, concat('https://shop', p_partkey, '.example/x?y') AS url, concat('<header>', CASE WHEN p_partkey % 3 = 0 THEN '<nav><a href="/one">lone</a></nav>' ELSE '' END,
  CASE WHEN p_partkey % 2 = 0 THEN '<nav class="main">' ELSE '' END, '<ul class="site-menu">',
  '<li><a href="/collections/', p_type, '">', p_type, '</a></li>',
  '<li><a href="#">skipped</a></li><li><a href="/pages/p">no collection</a></li><li><a href="/collections/new">New in</a></li>',
  '<li class="x"><a href="/c"><b>My ', p_name, '</b> &amp; more</a><ul><li><a href="/collections/k', p_partkey, '/z">First</a><ul><li><a href="https://other.example/q">Deep</a></li></ul></li><li><a href="#">none</a></li></ul></li></ul>',
  CASE WHEN p_partkey % 2 = 0 THEN '</nav>' ELSE '' END, '</header><ul class="menu-2"><li><a href="/collections/late">late</a></li></ul>') AS html FROM {part}
"""


@query("nav_tree", """
WITH m AS (SELECT * FROM part WHERE p_partkey % 3 <> 0 OR p_partkey % 2 = 0)
SELECT p_partkey, p_type AS level1, p_type AS level2, 'https://shop' || p_partkey || '.example/collections/' || p_type AS url, p_type AS handle FROM m
UNION ALL SELECT p_partkey, 'My ' || p_name || ' & more', 'First', 'https://shop' || p_partkey || '.example/collections/k' || p_partkey || '/z', 'k' || p_partkey FROM m
UNION ALL SELECT p_partkey, 'My ' || p_name || ' & more', 'Deep', 'https://other.example/q', '' FROM m
""")
def _(t):
    return P.nav_tree(t.sql(_MENU), "p_partkey", "url", "html")


@query("nav_levels", r"""
SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_type WHEN 1 THEN p_name ELSE p_brand || ' x' END AS level1,
       CASE p_partkey % 3 WHEN 0 THEN p_name || ' | more' WHEN 1 THEN p_brand ELSE p_brand || ' x' END AS level2
FROM part
""")
def _(t):
    titles = t.sql("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN concat(p_type, ' > ', p_name, ' | more') WHEN 1 THEN concat(p_name, ' – ', p_brand)
                      ELSE concat(p_brand, ' x') END AS title FROM {part}""")
    return titles.select("p_partkey", H.split_levels("title").alias("s")).select("p_partkey", "s.*")


@query("garbage_title", r"""
SELECT p_partkey, p_partkey % 5 IN (0, 1, 2, 4) OR p_name LIKE 'new %' AS garbage, p_partkey % 4 = 0 OR length(p_type) <= 4 AS garbage_handle FROM part
""")
def _(t):
    rows = t.sql("""SELECT p_partkey, p_type, CASE p_partkey % 5 WHEN 0 THEN concat('New ', p_name) WHEN 1 THEN ' SALE' WHEN 2 THEN '全部' WHEN 3 THEN p_name ELSE ' ' END AS title,
                    CASE WHEN p_partkey % 4 = 0 THEN concat('Gift-', p_partkey) ELSE concat('h', p_partkey) END AS handle FROM {part}""")
    return rows.select("p_partkey", H.is_garbage_title("title").alias("garbage"), H.is_garbage_collection("p_type", "handle").alias("garbage_handle"))


_ORDER_PAGE = """
SELECT o_orderkey, concat('<table>',
  '<tr class="type-shop_order status-wc-', CASE o_orderkey % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'on-hold' ELSE 'completed' END, '" id="order-', o_orderkey * 2, '"><td><time datetime="',
  date_format(o_orderdate, "yyyy-MM-dd'T'HH:mm:ss"), '+00:00">x</time></td><td><mark class="order-status s"><span> ', CASE o_orderkey % 3 WHEN 0 THEN 'Pending' WHEN 1 THEN 'On hold &amp; wait' ELSE 'Completed' END,
  '</span></mark></td><td class=\\'order_total column\\'><span>$1.00</span> <b>', format_number(o_totalprice, 2), '</b></td></tr>',
  '<tr id="order-', o_orderkey * 2 + 1, '"><td><time datetime="', date_format(o_orderdate, "yyyy-MM-dd'T'HH:mm:ss"), 'Z"></time></td><td>no status</td></tr><tr><td>total</td></tr></table>',
  '<ul class="subsubsub"><li class="all"><a href="?page=wc-orders">All <span class="count">(', o_orderkey + 3, ')</span></a></li>',
  '<li class="wc-pending"><a href="?status=wc-pending">Pending <span class="count">(', o_orderkey % 11, ')</span></a></li><li class="wc-unknown"><a href="?x">(9)</a></li>',
  '<li><a href="?status=wc-completed">Completed (', o_orderkey % 7, ')</a></li></ul>') AS html
FROM {orders_spread}
"""


@query("parse_order_rows", """
SELECT o_orderkey * 2 AS order_id, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS order_time,
       CASE o_orderkey % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'on hold & wait' ELSE 'completed' END AS order_status, o_totalprice AS order_amount FROM orders
UNION ALL SELECT o_orderkey * 2 + 1, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S'), '', 0.0 FROM orders
""")
def _(t):
    return P.order_rows(t.sql(_ORDER_PAGE), "html").select("order_id", "order_time", "order_status", "order_amount")


_CELL_PAGE = """
SELECT o_orderkey, concat('<table><tr><th>Order</th><th>order total 12345</th></tr>',
  "<tr class='iedit status-wc-on-hold'><td class=order_number><a href='/wp-admin/post.php?post=", o_orderkey * 3, "&amp;action=edit'>#77 A B</a></td><td class='column-order_date'><time title=x datetime='",
  date_format(o_orderdate, "yyyy-MM-dd'T'HH:mm:ss"), "+02:00'>soon</time></td><td class='order-total'>$9.99 <b>", format_number(o_totalprice, 2), "</b></td></tr>",
  '<tr><td>a</td><td>Refunded #', 1000 + o_orderkey, '</td><td class="order_date">2024-05-06 07:08</td></tr>',
  '<tr class="status-wc-failed"><td>no number</td></tr><tr><td>neither</td></tr></table>') AS html FROM {orders_spread}
"""


@query("parse_order_cells", """
SELECT o_orderkey * 3 AS order_id, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS order_time, 'on-hold' AS order_status, o_totalprice AS order_amount, 1 AS on_hold FROM orders
UNION ALL SELECT 1000 + o_orderkey, '2024-05-06 07:08', 'refunded', 0.0, 1 FROM orders
UNION ALL SELECT NULL, NULL, 'failed', 0.0, 1 FROM orders
""")
def _(t):
    pages = t.sql(_CELL_PAGE)
    pages = pages.withColumn("on_hold", P.filtered_total("html", "on-hold"))
    return P.order_rows(pages, "html").select("order_id", "order_time", "order_status", "order_amount", "on_hold")


@query("status_counts_from_html", """
SELECT o_orderkey, o_orderkey + 3 AS n_all, o_orderkey % 11 AS n_pending, o_orderkey % 7 AS n_completed, 3 AS n_keys,
       CASE o_orderkey % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'on-hold' ELSE 'completed' END AS row_status, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey * 3 END AS shown FROM orders
""")
def _(t):
    # a second pending entry after the first one, and the number of rows shown
    first = F.regexp_replace("html", "(?s)(<ul[^>]*subsubsub[^>]*>)", F.concat(F.lit("$1<li class='pending'><a href='x'>Pending <span>(999999)</span></a></li>")))
    shown = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("<span class='displaying-num'>"), F.col("o_orderkey") * 3, F.lit(" items</span>"))).otherwise("")
    rows = t.sql(_ORDER_PAGE).withColumn("html", F.concat(first, shown))
    counted = rows.select("o_orderkey", P.status_counts("html").alias("c"), P.visible_count("html").alias("shown"),
                          D.status_key(H.row_status(F.regexp_extract("html", "(?s)(<tr .*?</tr>)", 1), tuple(D.ORDER_STATUS_LABELS))).alias("row_status"))
    return counted.select("o_orderkey", F.col("c")["all"].alias("n_all"), F.col("c")["pending"].alias("n_pending"),
                          F.col("c")["completed"].alias("n_completed"), F.size("c").alias("n_keys"), "row_status", "shown")


@query("parse_count_text", """
SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN o_custkey WHEN 1 THEN o_orderkey END AS n,
       CASE WHEN o_orderkey % 4 = 0 THEN o_custkey ELSE 1 END AS pages,
       CASE o_orderkey % 5 WHEN 4 THEN NULL WHEN 3 THEN nullif(o_custkey, 0) ELSE o_orderkey + 1000 END AS results
FROM orders
""")
def _(t):
    texts = t.sql("""SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN concat('Orders 7 (', o_custkey, ')') WHEN 1 THEN concat('about ', o_orderkey, ' items') ELSE 'none' END AS a,
        CASE WHEN o_orderkey % 4 = 0 THEN concat('1 of ', o_custkey) ELSE 'one page' END AS b,
        CASE o_orderkey % 5 WHEN 0 THEN concat('About ', format_number(o_orderkey + 1000, 0), ' results') WHEN 1 THEN concat('约 ', o_orderkey + 1000, ' 条结果')
             WHEN 2 THEN concat('<b>', format_number(o_orderkey + 1000, 0), ' results</b>') WHEN 3 THEN concat('<div id="result-stats">n <i>', o_custkey, '</i> hits</div>') ELSE 'x' END AS c FROM {orders}""")
    return texts.select("o_orderkey", H.count_text("a").alias("n"), H.page_total("b").alias("pages"), H.result_total("c").alias("results"))


@query("detect_platform", """
SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'Shopify' WHEN 1 THEN 'WooCommerce' WHEN 2 THEN 'Magento' WHEN 3 THEN 'BigCommerce' ELSE 'unknown' END AS platform,
       CASE page_id % 6 WHEN 0 THEN 1.0 WHEN 1 THEN 0.9 WHEN 2 THEN 0.8 WHEN 3 THEN 0.7 WHEN 4 THEN 0.3 ELSE 0.0 END AS confidence FROM pages
""")
def _(t):
    captured = t.sql("""SELECT page_id, concat(html, CASE page_id % 6 WHEN 3 THEN '<!-- BigCommerce -->' WHEN 4 THEN '<script src="//JS.stripe.com/v3">' ELSE '' END) AS html,
        CASE WHEN page_id % 6 = 0 THEN to_json(map('published_products_count', page_id)) ELSE to_json(map('error', 1)) END AS meta,
        CASE WHEN page_id % 6 = 1 THEN concat(' ', to_json(array(page_id))) ELSE to_json(map('code', 'none')) END AS products, CASE WHEN page_id % 6 = 2 THEN 'Magento/2.4' END AS version FROM {pages}""")
    return captured.select("page_id", H.detect_platform("html", "meta", "products", "version").alias("d")).select("page_id", "d.*")


@query("parse_datetime_multi", f"""
SELECT id, strftime(coalesce(try_strptime({duck.strip('raw_time')}, '%Y-%m-%d %H:%M:%S'), try_strptime({duck.strip('raw_time')}, '%Y-%m-%d %H:%M'),
       try_strptime({duck.strip('raw_time')}, '%Y-%m-%dT%H:%M:%S')), '%Y-%m-%d %H:%M:%S') AS parsed FROM v_site_text
""")
def _(t):
    return t.v_site_text.select("id", F.date_format(D.parse_datetime("raw_time"), "yyyy-MM-dd HH:mm:ss").alias("parsed"))


@query("date_buckets", """
SELECT order_id, strftime(order_time, '%Y-%m-%d') AS day, strftime(order_time, '%Y-%m') AS month, strftime(date_trunc('week', order_time), '%Y-%m-%d') AS week FROM v_order
""")
def _(t):
    return t.v_order.select("order_id", D.day_text("order_time").alias("day"), D.month_text("order_time").alias("month"),
                            D.day_text(D.week_start("order_time")).alias("week"))


@query("status_normalize", """
SELECT order_id, order_status AS status, CASE order_status WHEN 'pending' THEN 'Pending' WHEN 'processing' THEN 'Processing' WHEN 'completed' THEN 'Completed' WHEN 'on-hold' THEN 'On hold'
       WHEN 'cancelled' THEN 'Cancelled' WHEN 'refunded' THEN 'Refunded' WHEN 'failed' THEN 'Failed' ELSE 'Trash' END AS label FROM v_order
""")
def _(t):
    raw = F.concat(F.when(F.col("order_id") % 2 == 0, " WC-").otherwise("status-"), F.upper("order_status"))
    keyed = t.v_order.select("order_id", D.status_key(raw).alias("status"))
    return keyed.select("order_id", "status", D.label_of("status", D.ORDER_STATUS_LABELS, F.col("status")).alias("label"))


@query("availability_status", """
SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 4 = 0 AND c_custkey % 5 = 0 THEN 'available'
                       WHEN c_custkey % 3 = 1 OR c_custkey % 4 = 1 OR c_custkey % 5 = 1 THEN 'registered' ELSE 'uncertain' END AS availability FROM customer
""")
def _(t):
    rows = t.sql("""SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'available' WHEN 1 THEN 'registered' ELSE 'error' END AS whois,
                    CASE c_custkey % 4 WHEN 0 THEN 'available' WHEN 1 THEN 'registered' ELSE 'error' END AS rdap,
                    CASE c_custkey % 5 WHEN 0 THEN 'no_records' WHEN 1 THEN 'has_records' ELSE 'error' END AS dns FROM {customer}""")
    return rows.select("c_custkey", D.availability("whois", "rdap", "dns").alias("availability"))


@query("repair_status", """
SELECT id, CASE WHEN id % 3 = 0 THEN CASE WHEN schedule_time <> '' THEN 'uploaded' ELSE 'missing' END ELSE report_status END AS status FROM v_site
""")
def _(t):
    broken = t.v_site.withColumn("report_status", F.when(F.col("id") % 3 == 0, F.when(F.col("id") % 2 == 0, "??").otherwise("")).otherwise(F.col("report_status")))
    return broken.select("id", D.repaired_status("report_status", "schedule_time", ("??", ""), "uploaded", "missing").alias("status"))


@query("alias_coalesce", """
SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN lower(c_name) WHEN 1 THEN 'shop' || c_custkey || '.example' ELSE 'www.x' || c_custkey || '.example' END AS domain,
       CASE c_custkey % 3 WHEN 0 THEN lower(c_name) WHEN 1 THEN 'shop' || c_custkey ELSE 'x' || c_custkey END AS name,
       CASE WHEN c_custkey % 2 = 0 THEN '10.0.0.' || c_nationkey ELSE '' END AS ip FROM customer
""")
def _(t):
    rows = t.sql("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE ' ' END AS name, CASE WHEN c_custkey % 3 = 1 THEN concat('https://Shop', c_custkey, '.example/') END AS domain,
                    CASE WHEN c_custkey % 3 = 2 THEN concat(' http://www.X', c_custkey, '.example') ELSE 'zzz' END AS url,
                    '' AS serverip, CASE WHEN c_custkey % 2 = 0 THEN concat('10.0.0.', c_nationkey) END AS ip FROM {customer}""")
    domain = F.btrim(F.regexp_replace(F.lower(D.first_filled("name", "domain", "url")), "https?://", ""), F.lit("/"))
    label = F.substring_index(F.replace(F.col("domain"), F.lit("www."), F.lit("")), ".", 1)
    return rows.select("c_custkey", domain.alias("domain"), D.first_filled("serverip", "ip").alias("ip")).withColumn("name", label)


@query("category_id_map", """
SELECT c_custkey, coalesce(n_name, CAST(c_nationkey + 100 AS VARCHAR)) AS category FROM customer LEFT JOIN nation ON c_custkey % 5 <> 0 AND n_nationkey = c_nationkey
""".replace("CAST(c_nationkey + 100 AS VARCHAR)", "'x' || c_nationkey"))
def _(t):
    coded = t.sql("SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN concat('x', c_nationkey) ELSE CAST(c_nationkey AS STRING) END AS code FROM {customer}")
    names = t.sql("SELECT CAST(n_nationkey AS STRING) AS code, n_name FROM {nation}")
    return coded.join(names, "code", "left").select("c_custkey", F.coalesce("n_name", "code").alias("category"))
