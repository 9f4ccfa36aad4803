"""Order statistics, paging and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from merchloom.functions import dates as D
from merchloom.operators import orders as O
from merchloom.operators import ranking as K
from suite import query

_MONTHLY = """
m AS (SELECT domain, strftime(order_time, '%Y-%m') AS month, count(*) AS cnt, count(*) FILTER (order_status = 'cancelled') AS cancelled,
        count(*) FILTER (order_status NOT IN ('failed', 'on-hold', 'cancelled', 'refunded')) AS valid_cnt,
        coalesce(sum(order_amount) FILTER (order_status NOT IN ('failed', 'on-hold', 'cancelled', 'refunded')), 0) AS valid_total
      FROM v_order WHERE order_status <> 'trash' GROUP BY ALL)
"""


@query("orders_daily", "SELECT strftime(order_time, '%Y-%m-%d') AS d, count(*) AS cnt, printf('%.2f', sum(order_amount)) AS revenue FROM v_order GROUP BY 1 ORDER BY 1")
def _(t):
    return O.daily(t.v_order).orderBy("d")


@query("orders_by_category_status", """
SELECT order_category, order_status, count(*) AS cnt, round(sum(order_amount), 2) AS revenue FROM v_order
WHERE order_time >= '1996-01-01' AND order_time <= '1996-12-31 23:59:59' GROUP BY ALL ORDER BY 1, 3 DESC
""")
def _(t):
    year = t.v_order.where(O.in_days("order_time", "1996-01-01", "1996-12-31"))
    return O.by_category_status(year).orderBy("order_category", F.col("cnt").desc(), "order_status")


@query("partial_final_merge", "SELECT order_status, count(*) AS cnt, round(sum(order_amount), 2) AS revenue FROM v_order GROUP BY 1")
def _(t):
    partial = t.v_order.groupBy("ip", "order_status").agg(F.count(F.lit(1)).alias("cnt"), F.sum("order_amount").alias("revenue"))
    return O.merge_partials(partial, ["order_status"], ["cnt", "revenue"]).withColumn("revenue", F.round("revenue", 2))


@query("orders_monthly", f"WITH {_MONTHLY} SELECT month, CAST(sum(cnt) AS BIGINT) AS cnt, CAST(sum(cancelled) AS BIGINT) AS cancelled, CAST(sum(valid_cnt) AS BIGINT) AS valid_cnt, round(sum(valid_total), 2) AS valid_total FROM m GROUP BY 1")
def _(t):
    text = t.v_order.withColumn("order_amount", F.concat(F.lit("$"), F.format_number("order_amount", 2)))
    return O.monthly(text)


@query("order_site_summary", """
WITH r AS (SELECT domain, order_id, row_number() OVER (PARTITION BY domain ORDER BY order_time DESC, order_id DESC) AS rn FROM v_order WHERE order_status <> 'trash'),
     l AS (SELECT domain, string_agg(CAST(order_id AS VARCHAR), ',' ORDER BY rn) AS recent_orders FROM r WHERE rn <= 5 GROUP BY 1),
     s AS (SELECT domain, count(*) AS total_orders, count(*) FILTER (order_status IN ('pending', 'processing', 'completed')) AS real_orders FROM v_order GROUP BY 1)
SELECT domain, total_orders, real_orders, total_orders > 0 AS has_orders, real_orders > 0 AS has_real_orders, coalesce(recent_orders, '') AS recent_orders FROM s LEFT JOIN l USING (domain)
""")
def _(t):
    return O.site_summary(t.v_order).withColumn("recent_orders", F.array_join("recent_orders", ","))


@query("order_portfolio_summary", f"""
WITH {_MONTHLY}
SELECT month, CAST(sum(cnt) AS BIGINT) AS c, CAST(sum(valid_cnt) AS BIGINT) AS v, round(sum(round(valid_total, 2)), 2) AS r, CAST(sum(cancelled) AS BIGINT) AS cl,
       CAST(sum(cnt) - sum(valid_cnt) - sum(cancelled) AS BIGINT) AS fd FROM m GROUP BY ROLLUP (month)
""")
def _(t):
    return O.portfolio_monthly(O.monthly(t.v_order, ["domain"]))


@query("order_portfolio_totals", """
WITH s AS (SELECT domain, count(*) AS total, count(*) FILTER (order_status IN ('pending', 'processing', 'completed')) AS real FROM v_order GROUP BY 1)
SELECT count(*) AS sites, count(*) FILTER (real > 0) AS real_sites, count(*) FILTER (real = 0) AS test_only_sites, CAST(sum(total) AS BIGINT) AS total_orders, CAST(sum(real) AS BIGINT) AS real_orders FROM s
""")
def _(t):
    return O.portfolio_totals(t.v_order)


@query("order_status_distribution", """
SELECT CASE order_status WHEN 'pending' THEN 'Pending' WHEN 'processing' THEN 'Processing' WHEN 'completed' THEN 'Completed' WHEN 'on-hold' THEN 'On hold'
       WHEN 'cancelled' THEN 'Cancelled' WHEN 'refunded' THEN 'Refunded' WHEN 'failed' THEN 'Failed' ELSE 'Trash' END AS label, count(*) AS cnt FROM v_order GROUP BY 1
""")
def _(t):
    counts = t.v_order.groupBy("order_status").agg(F.count(F.lit(1)).alias("cnt"))
    return counts.select(D.label_of("order_status", D.ORDER_STATUS_LABELS, F.col("order_status")).alias("label"), "cnt").orderBy(F.col("cnt").desc(), "label")


@query("cancel_rate_having", f"""
WITH o AS (SELECT o_custkey AS domain, strftime(o_orderdate, '%Y-%m') AS month, o_orderkey % 9 AS s FROM orders),
     m AS (SELECT domain, count(*) AS total, count(*) FILTER (s = 4) AS cancelled FROM o WHERE s <> 8 GROUP BY 1)
SELECT domain, total, cancelled, round(cancelled / total * 100, 1) AS rate FROM m WHERE cancelled / total * 100 > 30 ORDER BY rate DESC, domain LIMIT 10
""")
def _(t):
    per_customer = t.sql("""SELECT o_custkey AS domain, o_orderdate AS order_time, o_totalprice AS order_amount,
        CASE o_orderkey % 9 WHEN 4 THEN 'cancelled' WHEN 8 THEN 'trash' ELSE 'completed' END AS order_status FROM {orders}""")
    rates = O.cancel_rates(O.monthly(per_customer, ["domain"]))
    return rates.orderBy(F.col("rate").desc(), "domain").limit(10)


@query("cancelled_sites_in_month", """
SELECT domain, count(*) AS cancelled FROM v_order WHERE order_status = 'cancelled' AND order_time >= '1997-05-01' AND order_time < '1997-06-01' GROUP BY 1
""")
def _(t):
    month = t.v_order.where(O.in_month("order_time", 1997, 5) & (F.col("order_status") == "cancelled"))
    return month.groupBy("domain").agg(F.count(F.lit(1)).alias("cancelled"))


@query("history_merge", f"""
WITH {_MONTHLY}
SELECT month AS m, CAST(sum(cnt) AS BIGINT) AS c, CAST(sum(valid_cnt) AS BIGINT) AS v, round(sum(round(valid_total, 2)), 2) AS r, CAST(sum(cancelled) AS BIGINT) AS cl,
       CAST(sum(cnt - valid_cnt - cancelled) AS BIGINT) AS fd FROM m GROUP BY 1
""")
def _(t):
    entry = F.struct(F.col("month").alias("m"), F.col("cnt").alias("c"), F.col("valid_cnt").alias("v"), F.col("valid_total").alias("r"),
                     F.col("cancelled").alias("cl"), (F.col("cnt") - F.col("valid_cnt") - F.col("cancelled")).alias("fd"))
    # a saved history entry per site: months of one site are few
    history = O.monthly(t.v_order, ["domain"]).groupBy("domain").agg(F.collect_list(entry).alias("monthly"))
    return O.merge_history(history, "monthly")


@query("paginate", "SELECT id, domain, 100 AS page_from FROM v_site WHERE domain LIKE '%supplier%' ORDER BY domain DESC, id LIMIT 15 OFFSET 30".replace(", 100 AS page_from", ""))
def _(t):
    _, rows = K.page(t.v_site.where(F.contains("domain", F.lit("supplier"))).select("id", "domain"), [F.col("domain").desc(), F.col("id")], 3, 15)
    return rows


@query("paginate_total", "SELECT count(*) AS total FROM v_site WHERE domain LIKE '%supplier%'")
def _(t):
    total, _ = K.page(t.v_site.where(F.contains("domain", F.lit("supplier"))).select("id", "domain"), [F.col("domain").desc(), F.col("id")], 3, 15)
    return total


@query("paginate_deep", "SELECT order_id, domain FROM v_order ORDER BY order_time DESC, order_id LIMIT 4000 OFFSET 9000")
def _(t):
    return K.first_rows(t.v_order, [F.col("order_time").desc(), F.col("order_id")], 4000, 9000).select("order_id", "domain")


@query("multi_key_sort", "SELECT order_id, order_status, order_time FROM v_order ORDER BY order_status, order_time DESC, order_id")
def _(t):
    return t.v_order.select("order_id", "order_status", "order_time").orderBy("order_status", F.col("order_time").desc(), "order_id")


@query("time_desc_nulls_last", "SELECT id, CASE WHEN schedule_time = '' THEN NULL ELSE schedule_time END AS at FROM v_site ORDER BY 2 DESC NULLS LAST, 1")
def _(t):
    at = D.parse_datetime("schedule_time")
    return t.v_site.select("id", F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("at")).orderBy(F.col("at").desc_nulls_last(), "id")


@query("topn", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, o_custkey LIMIT 10")
def _(t):
    return t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "o_custkey").limit(10)


@query("limited_export", "SELECT p_partkey, p_name FROM part ORDER BY p_partkey LIMIT 500")
def _(t):
    return K.first_rows(t.part.select("p_partkey", "p_name"), [F.col("p_partkey")], 500)


@query("union_all_servers", "SELECT order_id, ip, order_time FROM v_order ORDER BY order_time DESC, order_id LIMIT 30")
def _(t):
    orders = t.v_order.select("order_id", "ip", "order_time")
    first, second = orders.where("length(ip) % 2 = 0"), orders.where("length(ip) % 2 = 1")
    return K.first_rows(first.unionByName(second), [F.col("order_time").desc(), F.col("order_id")], 30)


@query("distinct_urls", r"SELECT DISTINCT rtrim(raw_url, '/') AS url FROM v_url")
def _(t):
    from merchloom.functions.urls import normalize_url
    return t.v_url.select(normalize_url("raw_url").alias("url")).distinct()


@query("except_existing", "SELECT DISTINCT o_custkey FROM orders WHERE o_orderkey % 3 = 0 EXCEPT SELECT o_custkey FROM orders WHERE o_orderkey % 7 = 1")
def _(t):
    keys = t.orders.select("o_custkey", "o_orderkey")
    return keys.where("o_orderkey % 3 = 0").select("o_custkey").subtract(keys.where("o_orderkey % 7 = 1").select("o_custkey"))


@query("token_intersect", """
WITH w AS (SELECT p_partkey, string_split(p_name, ' ') AS a, string_split(lower(p_type) || ' ring red', ' ') AS b FROM part)
SELECT p_partkey, len(list_intersect(a, b)) AS common, len(list_distinct(list_concat(a, b))) AS together, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) AS jaccard FROM w
""")
def _(t):
    from merchloom.functions.similarity import jaccard, words
    a, b = words("p_name"), words(F.concat("p_type", F.lit(" ring red")))
    return t.part.select("p_partkey", F.size(F.array_intersect(a, b)).alias("common"), F.size(F.array_union(a, b)).alias("together"),
                         F.round(jaccard(a, b), 6).alias("jaccard"))


@query("weekly_report", """
SELECT order_id, domain, ip, order_time FROM v_order WHERE order_time >= '1997-06-09' AND order_time < '1997-06-16' ORDER BY order_time, order_id
""")
def _(t):
    moment = F.lit("1997-06-11 15:00:00").cast("timestamp_ntz")
    return t.v_order.where(D.in_week_of("order_time", moment)).select("order_id", "domain", "ip", "order_time").orderBy("order_time", "order_id")


@query("per_server_orders", "SELECT order_id, v.ip, n_nationkey, r_name AS main_category FROM v_order v JOIN nation ON n_name = v.ip JOIN region ON r_regionkey = n_regionkey")
def _(t):
    servers = t.sql("SELECT n_name AS ip, n_nationkey, r_name AS main_category FROM {nation} JOIN {region} ON n_regionkey = r_regionkey")
    return t.v_order.select("order_id", "ip").join(servers, "ip").select("order_id", "ip", "n_nationkey", "main_category")
