"""Site registry operators: funnels, pending work, schedules, status refresh, imports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merchloom.functions.base import ColumnLike, col, strip, text_or_empty
from merchloom.functions.dates import parse_datetime
from merchloom.functions.urls import registrable_domain, url_netloc


def redirect_verdict(source_host: ColumnLike, final_url: ColumnLike, check_path: ColumnLike) -> Column:
    """Judge a captured redirect: other site family, changed path, or fine."""
    def path_of(path: Column) -> Column:
        cut = F.rtrim(path, F.lit("/"))
        return F.when(cut == "", "/").otherwise(cut)

    final_host = url_netloc(final_url)
    final_path = path_of(F.regexp_replace(F.regexp_replace(col(final_url), r"[?#].*$", ""), r"^[^:]*://[^/]*", ""))
    crossed = (final_host != "") & (registrable_domain(source_host) != registrable_domain(final_host))
    moved = (F.coalesce(col(check_path), F.lit("")) != "") & (path_of(col(check_path)) != final_path)
    return F.when(crossed, "FINAL_HOST_CROSS_DOMAIN").when(moved, "FINAL_PATH_CHANGED").otherwise("OK")


def funnel(df: DataFrame, flags: dict[str, Column], *keys: str) -> DataFrame:
    """Total and one conditional count per flag, in a single scan."""
    counts = [F.count(F.lit(1)).alias("total")] + [F.count_if(cond).alias(name) for name, cond in flags.items()]
    return df.groupBy(*keys).agg(*counts) if keys else df.agg(*counts)


def schedule_due(df: DataFrame, now: Column, enabled: str = "schedule_enabled", time: str = "schedule_time",
                 status: str = "report_status", reported: str = "reported") -> DataFrame:
    """Rows that are enabled, not reported yet and whose time has come."""
    on = F.lower(text_or_empty(enabled)).isin("1", "true", "yes")
    return df.where(on & (text_or_empty(status) != reported) & (parse_datetime(time, iso=False) <= now))


def pending_stage(reported: Column, resolved: Column, built: Column, main_done: Column, extra_done: Column) -> Column:
    """Stage a site waits in, '' when nothing is pending."""
    return (
        F.when(built & ~main_done & ~extra_done, "built_both_missing")
        .when(built & ~main_done, "built_main_missing")
        .when(built & ~extra_done, "built_extra_missing")
        .when(~reported, "local")
        .when(resolved & ~built, "reported_resolved")
        .otherwise("")
    )


def completeness(done: dict[str, Column]) -> Column:
    """Number of finished steps."""
    total = F.lit(0)
    for condition in done.values():
        total = total + F.when(condition, 1).otherwise(0)
    return total


def refresh_status(sites: DataFrame, fetched: DataFrame, now: Column) -> DataFrame:
    """Join fetched (domain, report_id, status) rows to the registry and apply the transitions.

    Status 3 sets the resolved time once; status 4 sets the three finished flags and fills blank times.
    """
    news = fetched.select(
        F.lower(strip("domain")).alias("_domain"), F.col("report_id").cast("string").alias("_report_id"),
        F.col("status").cast("string").alias("_status"))
    joined = sites.withColumn("_domain", F.lower(strip("domain"))).join(news, "_domain", "left")
    hit = F.col("_report_id").isNotNull() & (F.col("report_status") == "reported")
    resolved = hit & (F.col("_status") == "3") & (text_or_empty("domain_status") != "3")
    built = hit & (F.col("_status") == "4")

    def keep_or(name: str, condition: Column, value: Column) -> Column:
        return F.when(condition, value).otherwise(F.col(name)).alias(name)

    def fill_time(name: str) -> Column:
        return keep_or(name, built & (text_or_empty(name) == ""), now)

    changed = {
        "report_id": keep_or("report_id", hit, F.col("_report_id")),
        "domain_status": keep_or("domain_status", hit, F.coalesce("_status", F.lit(""))),
        "resolved_time": keep_or("resolved_time", resolved, now),
        "build_status": keep_or("build_status", built, F.lit("built")),
        "main_status": keep_or("main_status", built, F.lit("uploaded")),
        "extra_status": keep_or("extra_status", built, F.lit("uploaded")),
        "build_time": fill_time("build_time"), "main_time": fill_time("main_time"), "extra_time": fill_time("extra_time"),
    }
    return joined.select(*[changed.get(name, F.col(name)) for name in sites.columns])


def consolidate_duplicates(df: DataFrame, key: str = "domain", order: str = "id") -> DataFrame:
    """Newest row per key is ``update``, the older ones are ``delete``."""
    newest = df.groupBy(key).agg(F.max(order).alias("_newest"))
    return df.join(newest, key).withColumn(
        "action", F.when(F.col(order) == F.col("_newest"), "update").otherwise("delete")).drop("_newest")
