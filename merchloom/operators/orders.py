"""Order statistics: daily, by status, monthly, per site and over the portfolio."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merchloom.functions.base import ColumnLike, col
from merchloom.functions.dates import INVALID_STATUSES, REAL_STATUSES, day_text, month_text
from merchloom.operators.ranking import top_per_group

CANCEL_RATE_LIMIT = 30.0


def money(value: Column) -> Column:
    return F.round(value, 2)


def in_days(time: ColumnLike, first: str, last: str) -> Column:
    """Inclusive days; plain comparisons on the column, so the scan can prune by them."""
    return (col(time) >= F.lit(f"{first} 00:00:00").cast("timestamp_ntz")) & (
        col(time) <= F.lit(f"{last} 23:59:59").cast("timestamp_ntz"))


def in_month(time: ColumnLike, year: int, month: int) -> Column:
    """Half-open month."""
    following = (year + 1, 1) if month == 12 else (year, month + 1)
    return (col(time) >= F.lit(f"{year}-{month:02d}-01 00:00:00").cast("timestamp_ntz")) & (
        col(time) < F.lit("{}-{:02d}-01 00:00:00".format(*following)).cast("timestamp_ntz"))


def daily(orders: DataFrame, time: str = "order_time", amount: str = "order_amount") -> DataFrame:
    """Count and revenue per day over all servers; revenue as text with two decimals."""
    grouped = orders.groupBy(day_text(time).alias("d")).agg(
        F.count(F.lit(1)).alias("cnt"), F.sum(amount).alias("_revenue"))
    return grouped.select("d", "cnt", F.format_string("%.2f", "_revenue").alias("revenue"))


def by_category_status(orders: DataFrame) -> DataFrame:
    return orders.groupBy("order_category", "order_status").agg(
        F.count(F.lit(1)).alias("cnt"), money(F.sum("order_amount")).alias("revenue"))


def merge_partials(partials: DataFrame, keys: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """Add up aggregates that were computed per server."""
    return partials.groupBy(*keys).agg(*[F.sum(s).alias(s) for s in sums])


def amount_text(value: ColumnLike) -> Column:
    """Amount out of text such as ``$1,234.56``; unreadable text counts as zero."""
    return F.coalesce(F.trim(F.translate(col(value).cast("string"), "$,", "")).try_cast("double"), F.lit(0.0))


def monthly(orders: DataFrame, keys: Sequence[str] = (), time: str = "order_time", status: str = "order_status",
            total: str = "order_amount") -> DataFrame:
    """Per month: count, cancelled, valid count and valid total; trash is left out."""
    valid = ~F.col(status).isin(*INVALID_STATUSES)
    return (
        orders.where(F.col(status) != "trash").groupBy(*keys, month_text(time).alias("month"))
        .agg(F.count(F.lit(1)).alias("cnt"), F.count_if(F.col(status) == "cancelled").alias("cancelled"),
             F.count_if(valid).alias("valid_cnt"),
             money(F.sum(F.when(valid, amount_text(total)).otherwise(0.0))).alias("valid_total"))
    )


def site_summary(orders: DataFrame, site: str = "domain", recent: int = 5) -> DataFrame:
    """Per site: totals, flags and the ids of the most recent orders outside the trash."""
    totals = orders.groupBy(site).agg(
        F.count(F.lit(1)).alias("total_orders"), F.count_if(F.col("order_status").isin(*REAL_STATUSES)).alias("real_orders"))
    newest = [F.col("order_time").desc(), F.col("order_id").desc()]
    last = top_per_group(orders.where("order_status <> 'trash'").select(site, "order_time", "order_id"), [site], newest,
                         recent, rank="_rank")
    ids = last.groupBy(site).agg(F.array_sort(F.collect_list(F.struct("_rank", "order_id"))).alias("_r")).select(
        site, F.transform("_r", lambda r: r["order_id"]).alias("recent_orders"))
    return totals.join(ids, site, "left").select(
        site, "total_orders", "real_orders", (F.col("total_orders") > 0).alias("has_orders"),
        (F.col("real_orders") > 0).alias("has_real_orders"), F.coalesce("recent_orders", F.array().cast("array<bigint>")).alias("recent_orders"))


def portfolio_monthly(per_site_month: DataFrame) -> DataFrame:
    """Roll-up over sites, with the failed remainder and a grand total row (month NULL)."""
    rolled = per_site_month.rollup("month").agg(
        F.sum("cnt").alias("c"), F.sum("valid_cnt").alias("v"), money(F.sum("valid_total")).alias("r"),
        F.sum("cancelled").alias("cl"))
    return rolled.select("month", "c", "v", "r", "cl", (F.col("c") - F.col("v") - F.col("cl")).alias("fd"))


def portfolio_totals(orders: DataFrame, site: str = "domain") -> DataFrame:
    """Sites, sites with real orders, test-only sites and order counts in one row."""
    per_site = orders.groupBy(site).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("order_status").isin(*REAL_STATUSES)).alias("real"))
    return per_site.agg(
        F.count(F.lit(1)).alias("sites"), F.count_if(F.col("real") > 0).alias("real_sites"),
        F.count_if(F.col("real") == 0).alias("test_only_sites"), F.sum("total").alias("total_orders"),
        F.sum("real").alias("real_orders"))


def cancel_rates(per_site_month: DataFrame, site: str = "domain", limit: float = CANCEL_RATE_LIMIT) -> DataFrame:
    """Sites whose share of cancelled orders is above the limit."""
    per_site = per_site_month.groupBy(site).agg(F.sum("cnt").alias("total"), F.sum("cancelled").alias("cancelled"))
    rate = F.col("cancelled") / F.col("total") * 100
    return per_site.where((F.col("total") > 0) & (rate > limit)).withColumn("rate", F.round(rate, 1))


def merge_history(history: DataFrame, monthly_column: str) -> DataFrame:
    """Add up the monthly arrays of several saved analyses."""
    rows = history.select(F.explode(monthly_column).alias("m")).select("m.*")
    return rows.groupBy("m").agg(F.sum("c").alias("c"), F.sum("v").alias("v"), money(F.sum("r")).alias("r"),
                                 F.sum("cl").alias("cl"), F.sum("fd").alias("fd"))
