"""Text times, calendar buckets and status labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from merchloom.functions.base import ColumnLike, blank_to_null, col, text_or_empty

LAYOUTS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm")
ISO_LAYOUTS = ("yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm")


def parse_datetime(value: ColumnLike, iso: bool = True) -> Column:
    """Time in one of the known layouts, else NULL."""
    text = text_or_empty(value)
    layouts = LAYOUTS + (ISO_LAYOUTS if iso else ())
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(layout)) for layout in layouts])


def day_text(value: ColumnLike) -> Column:
    return F.date_format(col(value), "yyyy-MM-dd")


def month_text(value: ColumnLike) -> Column:
    return F.date_format(col(value), "yyyy-MM")


def week_start(value: ColumnLike) -> Column:
    """Monday 00:00 of the week."""
    return F.date_trunc("week", col(value))


def in_week_of(value: ColumnLike, moment: Column) -> Column:
    start = week_start(moment)
    return (col(value) >= start) & (col(value) < start + F.expr("INTERVAL 7 DAYS"))


def status_key(value: ColumnLike) -> Column:
    """Lower-case status without its ``wc-`` / ``status-`` prefix."""
    return F.regexp_replace(F.lower(text_or_empty(value)), "^(?:wc-)?(?:status-)?", "")


# The order statuses that count as real, and those that do not count as valid.
REAL_STATUSES = ("pending", "processing", "completed")
INVALID_STATUSES = ("failed", "on-hold", "cancelled", "refunded")
# Order statuses with an English display label.
ORDER_STATUS_LABELS = {
    "pending": "Pending", "processing": "Processing", "on-hold": "On hold", "completed": "Completed",
    "cancelled": "Cancelled", "refunded": "Refunded", "failed": "Failed", "checkout-draft": "Draft",
    "trash": "Trash", "all": "All",
}
# Life-cycle codes of a registered domain.
DOMAIN_STATUS_LABELS = {"": "not bought", "1": "new", "2": "bought", "3": "resolved", "4": "built"}


def label_of(value: ColumnLike, labels: dict[str, str], default: Column | str) -> Column:
    chain = F.when(F.lit(False), F.lit(""))
    for code, label in labels.items():
        chain = chain.when(text_or_empty(value) == code, label)
    return chain.otherwise(default if isinstance(default, Column) else F.lit(default))


def first_filled(*candidates: ColumnLike) -> Column:
    """First of several alias columns that is not blank."""
    return F.coalesce(*[blank_to_null(c) for c in candidates], F.lit(""))


def repaired_status(status: ColumnLike, time: ColumnLike, placeholders: tuple[str, ...], done: str, todo: str) -> Column:
    """Derive a corrupted status from whether its time column is filled."""
    filled = text_or_empty(time) != ""
    return F.when(text_or_empty(status).isin(*placeholders), F.when(filled, done).otherwise(todo)).otherwise(col(status))


def availability(whois: ColumnLike, rdap: ColumnLike, dns: ColumnLike) -> Column:
    free = (col(whois) == "available") & (col(rdap) == "available") & (col(dns) == "no_records")
    taken = (col(whois) == "registered") | (col(rdap) == "registered") | (col(dns) == "has_records")
    return F.when(free, "available").when(taken, "registered").otherwise("uncertain")
