"""Table rules as jobs that list the rows breaking them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hedgemark.config import (
    LIST_FORMATS, REFRESH_STATUSES, RULE_TYPES, SCAN_STATUSES, SOURCE_TYPES, VERSION_STATUSES,
)
from hedgemark.functions.hosts import trimmed


def required(column: str) -> Column:
    value = F.col(column).cast("string")
    return value.isNotNull() & (trimmed(value) != "")


def within(column: str, values: Sequence[str]) -> Column:
    return F.col(column).isNull() | F.col(column).isin(*values)


def shaped(column: str, pattern: str) -> Column:
    return F.col(column).isNull() | F.col(column).rlike(pattern)


# table -> key, rules that must hold, column sets that must be unique
RULES: dict[str, tuple[str, Mapping[str, Column], Mapping[str, Sequence[str]]]] = {}


def _rules() -> dict[str, tuple[str, Mapping[str, Column], Mapping[str, Sequence[str]]]]:
    """Built on first use: column expressions need a running session."""
    if not RULES:
        RULES.update({
            "categories": ("category_id", {
                "slug_required": required("slug"), "name_required": required("name"),
                "slug_format": shaped("slug", r"^[a-z0-9][a-z0-9_-]*$"),
            }, {"slug_unique": ["slug"]}),
            "blocklists": ("blocklist_id", {
                "category_required": required("category_id"), "name_required": required("name"),
                "source_type_required": required("source_type"), "format_required": required("format"),
                "source_type_known": within("source_type", SOURCE_TYPES),
                "format_known": within("format", LIST_FORMATS),
                "refresh_status_known": within("refresh_status", REFRESH_STATUSES),
                "interval_positive": F.col("refresh_interval_s").isNull() | (F.col("refresh_interval_s") > 0),
                "source_url_required": (F.col("source_type") != "remote") | required("source_url"),
            }, {"name_unique": ["category_id", "name"], "source_url_unique": ["source_url"]}),
            "versions": ("version_id", {
                "blocklist_required": required("blocklist_id"), "status_required": required("status"),
                "status_known": within("status", VERSION_STATUSES),
            }, {}),
            "entries": ("entry_id", {
                "version_required": required("blocklist_version_id"),
                "rule_type_required": required("rule_type"), "value_required": required("normalized_value"),
                "rule_type_known": within("rule_type", RULE_TYPES),
            }, {}),
            "relays": ("url", {
                "url_required": required("url"), "url_format": shaped("url", "^wss?://"),
            }, {"url_unique": ["url"]}),
            "scans": ("scan_id", {
                "event_required": required("event_id"), "generation_required": required("policy_generation"),
                "status_required": required("status"), "version_required": required("scanner_version"),
                "status_known": within("status", SCAN_STATUSES),
            }, {}),
        })
    return RULES


def row_violations(df: DataFrame, table: str) -> DataFrame:
    """One row per broken rule, found in a single pass."""
    key, rules, _ = _rules()[table]
    broken = F.array_compact(F.array(*[
        F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()
    ]))
    return df.select(F.lit(table).alias("table"), F.col(key).cast("string").alias("key"), F.explode(broken).alias("rule"))


def unique_violations(df: DataFrame, table: str) -> DataFrame | None:
    """One row per value that occurs more than once; empty values are free."""
    _, _, uniques = _rules()[table]
    found = None
    for name, columns in uniques.items():
        used = df.filter(required(columns[-1]))
        repeated = used.groupBy(*columns).count().filter("count > 1").select(
            F.lit(table).alias("table"), F.concat_ws("|", *columns).alias("key"), F.lit(name).alias("rule")
        )
        found = repeated if found is None else found.unionByName(repeated)
    return found


def check_constraints(tables: Mapping[str, DataFrame]) -> DataFrame:
    """All violations of the given tables."""
    found = None
    for table, df in tables.items():
        for part in (row_violations(df, table), unique_violations(df, table)):
            if part is not None:
                found = part if found is None else found.unionByName(part)
    return found


def locked_slug_changes(before: DataFrame, after: DataFrame, labels: DataFrame) -> DataFrame:
    """Categories whose slug was changed although labels already use it."""
    old = before.select("category_id", F.col("slug").alias("old_slug"))
    changed = after.select("category_id", "slug").join(old, "category_id").filter(F.col("slug") != F.col("old_slug"))
    return changed.join(labels.select("category_id").distinct(), "category_id", "left_semi")
