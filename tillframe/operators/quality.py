"""Data-quality rules evaluated in one aggregate per table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillframe.functions.ordering import with_scalars

SAMPLES = 5


@dataclass(frozen=True)
class Rule:
    """One check: its kind, column, arguments and severity (``error`` or ``warning``)."""

    kind: str
    column: str | None = None
    args: tuple = field(default=())
    severity: str = "error"

    @property
    def label(self) -> str:
        shown = ([self.column] if self.column else []) + [str(a) for a in self.args if self.kind != "values_in_set"]
        return f"{self.kind}({', '.join(shown)})"


def no_nulls(column: str, severity: str = "error") -> Rule:
    return Rule("no_nulls", column, (), severity)


def min_rows(minimum: int, severity: str = "error") -> Rule:
    return Rule("min_rows", None, (minimum,), severity)


def unique(column: str, severity: str = "error") -> Rule:
    return Rule("unique", column, (), severity)


def values_in_set(column: str, allowed: Sequence, severity: str = "error") -> Rule:
    return Rule("values_in_set", column, tuple(allowed), severity)


def column_between(column: str, low, high, severity: str = "error") -> Rule:
    return Rule("column_between", column, (low, high), severity)


def no_future_dates(column: str, now: str | None = None, severity: str = "warning") -> Rule:
    return Rule("no_future_dates", column, (now,) if now else (), severity)


def positive_values(column: str, severity: str = "error") -> Rule:
    return Rule("positive_values", column, (), severity)


def _failing(rule: Rule) -> Column:
    """True on rows that break a row-level rule; nulls pass unless the rule is about them."""
    value = F.col(rule.column)
    if rule.kind == "no_nulls":
        return value.isNull()
    if rule.kind == "values_in_set":
        return ~F.coalesce(value.isin(list(rule.args)), F.lit(False))
    if rule.kind == "column_between":
        low, high = rule.args
        return (value < low) | (value > high)
    if rule.kind == "no_future_dates":
        now = F.lit(rule.args[0]) if rule.args else F.current_timestamp()
        return value.cast("timestamp_ntz") > now.cast("timestamp_ntz")
    if rule.kind == "positive_values":
        return value <= 0
    raise ValueError(f"unknown rule: {rule.kind}")


def _aggregates(i: int, rule: Rule) -> list[Column]:
    if rule.kind == "min_rows":
        return [F.greatest(F.lit(rule.args[0]) - F.count(F.lit(1)), F.lit(0)).cast("long").alias(f"f{i}")]
    return [F.count_if(_failing(rule)).alias(f"f{i}")]


def _samples(df: DataFrame, rule: Rule, name: str) -> DataFrame:
    """The first few distinct invalid values in order, as one row."""
    shown = F.coalesce(F.col(rule.column).cast("string"), F.lit("null")).alias("v")
    few = df.where(_failing(rule)).select(shown).distinct().orderBy("v").limit(SAMPLES)
    return few.agg(F.array_join(F.array_sort(F.collect_list("v")), ", ").alias(name))


def _detail(i: int, rule: Rule) -> Column:
    failed = F.col(f"f{i}").cast("string")
    if rule.kind == "no_nulls":
        return F.concat(failed, F.lit(" null value(s) in "), F.col("n").cast("string"), F.lit(" row(s)"))
    if rule.kind == "min_rows":
        return F.concat(F.col("n").cast("string"), F.lit(f" row(s), expected at least {rule.args[0]}"))
    if rule.kind == "unique":
        return F.concat(failed, F.lit(" duplicate(s)"))
    if rule.kind == "values_in_set":
        return F.concat(failed, F.lit(" value(s) outside the set: ["), F.col(f"s{i}"), F.lit("]"))
    if rule.kind == "column_between":
        return F.concat(failed, F.lit(f" value(s) outside [{rule.args[0]}, {rule.args[1]}]"))
    if rule.kind == "no_future_dates":
        return F.concat(failed, F.lit(" row(s) with a future date"))
    return F.concat(failed, F.lit(" value(s) <= 0"))


def _duplicates(df: DataFrame, column: str, name: str) -> DataFrame:
    """Rows beyond the first per value, null being a value like any other."""
    per_value = df.groupBy(column).agg(F.count("*").alias("c"))
    return per_value.agg(F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).cast("long").alias(name))


def run_suite(df: DataFrame, suite: str, rules: Sequence[Rule]) -> DataFrame:
    """A report row per rule: suite, rule, severity, failed_rows, passed, detail.

    All row-level rules share one aggregate. A uniqueness rule adds one that
    counts per value, a set rule one that picks the sample values.
    """
    simple = [(i, r) for i, r in enumerate(rules) if r.kind != "unique"]
    row = df.agg(F.count(F.lit(1)).alias("n"), *[c for i, r in simple for c in _aggregates(i, r)])
    for i, rule in enumerate(rules):
        if rule.kind == "unique":
            row = with_scalars(row, _duplicates(df, rule.column, f"f{i}"))
        if rule.kind == "values_in_set":
            row = with_scalars(row, _samples(df, rule, f"s{i}"))
    entries = F.array(
        *[
            F.struct(
                F.lit(i).alias("i"),
                F.lit(rule.label).alias("rule"),
                F.lit(rule.severity).alias("severity"),
                F.col(f"f{i}").alias("failed_rows"),
                _detail(i, rule).alias("detail"),
            )
            for i, rule in enumerate(rules)
        ]
    )
    return row.select(F.explode(entries).alias("r")).select(
        F.lit(suite).alias("suite"),
        "r.rule",
        "r.severity",
        "r.failed_rows",
        (F.col("r.failed_rows") == 0).alias("passed"),
        "r.detail",
    )


# The rules of the three suites.
def sales_rules(now: str | None = None) -> list[Rule]:
    return [
        min_rows(1000),
        no_nulls("customer_id"),
        no_nulls("product_id"),
        no_nulls("invoice_ts"),
        positive_values("quantity"),
        positive_values("revenue", "warning"),
        no_future_dates("invoice_ts", now),
        column_between("revenue", 0.01, 100000, "warning"),
    ]


REVIEW_RULES = [
    min_rows(100),
    no_nulls("review_text"),
    no_nulls("sentiment"),
    values_in_set("sentiment", ("positive", "negative", "neutral")),
    column_between("rating", 1.0, 5.0),
]
PRODUCT_RULES = [min_rows(1), unique("product_id"), no_nulls("product_name"), no_nulls("category")]


def dq_sales(sales: DataFrame, now: str | None = None) -> DataFrame:
    return run_suite(sales, "sales", sales_rules(now))


def dq_reviews(reviews: DataFrame) -> DataFrame:
    return run_suite(reviews, "reviews", REVIEW_RULES)


def dq_products(products: DataFrame) -> DataFrame:
    return run_suite(products, "products", PRODUCT_RULES)


def dq_report(results: Sequence[DataFrame]) -> DataFrame:
    """Per suite: passed unless an error-level rule failed, with the failure counts."""
    everything = reduce(DataFrame.unionByName, results)
    failed = ~F.col("passed")
    return everything.groupBy("suite").agg(
        F.bool_and(F.col("passed") | (F.col("severity") != "error")).alias("passed"),
        F.count("*").alias("rules"),
        F.count_if(failed & (F.col("severity") == "error")).alias("errors"),
        F.count_if(failed & (F.col("severity") == "warning")).alias("warnings"),
    )


class QualityError(ValueError):
    """A load stopped because an error-level rule failed."""


def quality_gate(report: DataFrame, force: bool = False) -> bool:
    """True when every suite passed; raises otherwise unless ``force``."""
    failed = [r.suite for r in report.where(~F.col("passed")).select("suite").collect()]
    if failed and not force:
        raise QualityError(f"failed suites: {', '.join(sorted(failed))}")
    return not failed


def constraint_rules() -> dict[str, list[Rule]]:
    """Declared constraints of the published tables: NOT NULL, unique keys and checks."""
    return {
        "products": [no_nulls("product_id"), unique("product_id"), no_nulls("product_name")],
        "customers": [no_nulls("customer_id"), unique("customer_id")],
        "mapping": [no_nulls("product_id"), unique("mapping_id"), no_nulls("match_score"), no_nulls("match_strategy")],
        "sales": [no_nulls("invoice_no"), no_nulls("product_id"), no_nulls("quantity"), no_nulls("revenue"), no_nulls("margin")],
        "reviews": [
            unique("review_id"),
            column_between("rating", 1.0, 5.0),
            values_in_set("sentiment", ("positive", "negative", "neutral")),
        ],
    }


def dq_constraints(tables: dict[str, DataFrame]) -> DataFrame:
    rules = constraint_rules()
    return reduce(DataFrame.unionByName, [run_suite(df, name, rules[name]) for name, df in tables.items()])
