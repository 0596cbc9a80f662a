"""The registered queries: one per operator of the survey, over the given tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from assayer.functions import text
from assayer.operators import (
    anomalies, charts, cleaning, eda, findings, frames, profile, quality, ranks, templates,
)
from assayer.operators.anomalies import AnomalyReport, Table
from assayer.operators.column_state import ColumnStates
from assayer.plans import ask as asking, prepare
from assayer.session import shared_folder
from assayer.sources import bundle, readers, records
from assayer.sources.registry import TableRegistry
from queries import views
from queries.views import DIRTY_TYPES, LINEITEM_TYPES, table, view

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
KEY = ["row_id"]


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def dirty(spark: SparkSession, sf: str) -> Table:
    return Table(view(spark, sf, views.DIRTY_ORDERS), DIRTY_TYPES, KEY)


def sparse(spark: SparkSession, sf: str) -> Table:
    return Table(view(spark, sf, views.SPARSE_ORDERS), {}, KEY)


def lineitem(spark: SparkSession, sf: str) -> Table:
    return Table(table(spark, sf, "lineitem"), LINEITEM_TYPES)


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Doubles rounded for comparison."""
    return df.select(*[
        F.round(f.name, digits).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
        for f in df.schema.fields
    ])


# -- schema inference ----------------------------------------------------------

PROFILE_COLUMNS = ["column", "detected_type", "missing", "non_null", "unique", "missing_ratio", "unique_ratio",
                   "null_like_count", "null_like_ratio", "numeric_parse_ratio", "datetime_parse_ratio", "date_format"]


@query
def schema_profile_orders(spark, sf):
    found = profile.schema_profile(table(spark, sf, "orders")).to_df()
    numbers = [F.round(c, 3).alias(c) for c in ("min", "max", "mean", "median", "std")]
    return found.select(*PROFILE_COLUMNS, *numbers, "date_min", "date_max")


@query
def schema_profile_dirty(spark, sf):
    found = profile.schema_profile(view(spark, sf, views.DIRTY_ORDERS), KEY)
    return found.to_df().select(*PROFILE_COLUMNS, "average_text_length")


@query
def incremental_profile(spark, sf):
    """Orders profiled year by year: first those before 1995, then the rest; the old ones aren't read again."""
    orders, year = table(spark, sf, "orders"), F.year("o_orderdate").cast("string")
    states = ColumnStates(spark, f"{shared_folder(spark)}/assayer-states-{uuid.uuid4().hex}")
    states.add(orders.where(F.year("o_orderdate") < 1995), year)
    states.add(orders.where(F.year("o_orderdate") >= 1995), year)
    numbers = [F.round(c, 3).alias(c) for c in ("min", "max", "mean", "std")]
    return states.profile().to_df().select(*PROFILE_COLUMNS, *numbers, "date_min", "date_max")


@query
def columns_by_type(spark, sf):
    found = profile.schema_profile(table(spark, sf, "lineitem")).columns_by_type()
    return found.select("detected_type", F.array_join("columns", ",").alias("columns"))


@query
def boolean_detect(spark, sf):
    return profile.schema_profile(table(spark, sf, "labels")).to_df().select("column", "detected_type", "unique")


@query
def null_like_values(spark, sf):
    return profile.null_like_values(view(spark, sf, views.DIRTY_ORDERS))


@query
def top_values(spark, sf):
    return profile.top_values(table(spark, sf, "part"), ["p_name", "p_brand", "p_type"])


@query
def date_format_counts(spark, sf):
    return profile.date_format_counts(view(spark, sf, views.WRITTEN_ORDERS), ["placed"])


@query
def numeric_parse(spark, sf):
    df = view(spark, sf, views.WRITTEN_ORDERS)
    plain, lenient = (text.to_number(F.col("amount"), T.StringType(), lenient=x) for x in (False, True))
    return df.agg(F.count("amount").alias("non_null"), F.count(plain).alias("plain"),
                  F.count(lenient).alias("lenient"), F.sum(lenient).alias("total"))


@query
def text_length_profile(spark, sf):
    found = profile.schema_profile(table(spark, sf, "documents"), ["doc_id"]).to_df()
    return found.where(F.col("physical_type") == "string").select("column", "detected_type", "average_text_length")


# -- anomalies -------------------------------------------------------------------

@query
def missing_by_column(spark, sf):
    return anomalies.missingness(dirty(spark, sf))


@query
def iqr_outliers(spark, sf):
    return anomalies.numeric_outliers(dirty(spark, sf))


@query
def iqr_outliers_lineitem(spark, sf):
    return anomalies.numeric_outliers(lineitem(spark, sf))


@query
def outlier_totals(spark, sf):
    return anomalies.outlier_totals(anomalies.numeric_outliers(dirty(spark, sf)))


@query
def outlier_values(spark, sf):
    return anomalies.outlier_values(dirty(spark, sf))


@query
def rare_categories(spark, sf):
    return anomalies.rare_categories(dirty(spark, sf))


@query
def rare_category_summary(spark, sf):
    return anomalies.rare_category_summary(dirty(spark, sf))


@query
def identifier_dups(spark, sf):
    return anomalies.identifier_anomalies(dirty(spark, sf))


@query
def duplicate_identifier_values(spark, sf):
    return anomalies.duplicate_identifier_values(dirty(spark, sf))


@query
def datetime_parse(spark, sf):
    return anomalies.datetime_anomalies(dirty(spark, sf))


@query
def row_missingness(spark, sf):
    return anomalies.high_missing_rows(sparse(spark, sf))


@query
def low_variance(spark, sf):
    return anomalies.low_variance(dirty(spark, sf))


@query
def duplicate_rows(spark, sf):
    return dirty(spark, sf).duplicate_summary


@query
def suspicious_rows(spark, sf):
    return anomalies.suspicious_rows(dirty(spark, sf))


@query
def row_issues(spark, sf):
    return anomalies.row_issues(dirty(spark, sf))


@query
def anomaly_column_summary(spark, sf):
    found = anomalies.column_summary(anomalies.column_facts(dirty(spark, sf)))
    return found.withColumn("issues", F.array_join("issues", ","))


@query
def anomaly_issues(spark, sf):
    return AnomalyReport(dirty(spark, sf)).issues


@query
def anomaly_summary(spark, sf):
    return AnomalyReport(dirty(spark, sf)).summary


# -- quality -----------------------------------------------------------------------

def quality_report(spark, sf, include_anomalies: bool = True) -> quality.QualityReport:
    t = dirty(spark, sf)
    return quality.QualityReport(t, AnomalyReport(t) if include_anomalies else None)


@query
def completeness(spark, sf):
    return quality.completeness(dirty(spark, sf))


@query
def completeness_total(spark, sf):
    return quality.completeness_total(quality.completeness(dirty(spark, sf)))


@query
def uniqueness(spark, sf):
    return quality_report(spark, sf, False).uniqueness


@query
def identifier_uniqueness(spark, sf):
    return quality.identifier_uniqueness(anomalies.identifier_anomalies(dirty(spark, sf)))


@query
def validity(spark, sf):
    return quality.validity(dirty(spark, sf))


@query
def consistency(spark, sf):
    return quality.consistency(dirty(spark, sf))


@query
def consistency_text(spark, sf):
    return quality.consistency(Table(view(spark, sf, views.WRITTEN_ORDERS), {"note": "Text", "amount": "Categorical"}, KEY))


@query
def anomaly_quality(spark, sf):
    return quality_report(spark, sf).anomaly_quality


@query
def column_anomaly_quality(spark, sf):
    return quality.column_anomaly_score(anomalies.column_summary(anomalies.column_facts(dirty(spark, sf))))


@query
def quality_columns(spark, sf):
    return quality_report(spark, sf).columns


@query
def quality_components(spark, sf):
    return quality_report(spark, sf).components.select("component", "score", "weight")


@query
def quality_explanations(spark, sf):
    return quality_report(spark, sf).components.select("component", "explanation")


@query
def quality_score(spark, sf):
    return quality_report(spark, sf).overall


@query
def quality_score_without_anomalies(spark, sf):
    return quality_report(spark, sf, False).overall


@query
def quality_issues(spark, sf):
    return quality_report(spark, sf).issues


@query
def priority_findings(spark, sf):
    return quality_report(spark, sf).priority_findings


# -- cleaning ------------------------------------------------------------------------

def cleaned(spark, sf) -> cleaning.CleanResult:
    return cleaning.clean(view(spark, sf, views.DIRTY_ORDERS), DIRTY_TYPES, KEY)


def cleaned_types(spark, sf) -> DataFrame:
    df = cleaning.normalize_nulls(view(spark, sf, views.DIRTY_ORDERS), KEY)
    return cleaning.to_typed(cleaning.drop_duplicates(df, KEY), DIRTY_TYPES)


@query
def clean_null_tokens(spark, sf):
    return cleaning.null_text_counts(view(spark, sf, views.DIRTY_ORDERS), KEY)


@query
def clean_duplicates(spark, sf):
    return cleaning.drop_duplicates(cleaning.normalize_nulls(view(spark, sf, views.DIRTY_ORDERS), KEY), KEY)


@query
def clean_types(spark, sf):
    return cleaned_types(spark, sf)


@query
def clean_booleans(spark, sf):
    df = view(spark, sf, views.DIRTY_ORDERS)
    return df.groupBy(cleaning.to_boolean(F.col("is_urgent"), T.StringType()).alias("is_urgent")).agg(
        F.count(F.lit(1)).alias("n"))


@query
def clean_negatives(spark, sf):
    df = cleaning.null_negatives(cleaned_types(spark, sf), DIRTY_TYPES)
    return df.select("row_id", "price", "quantity")


@query
def clean_fills(spark, sf):
    df = frames.stage(cleaning.null_negatives(cleaned_types(spark, sf), DIRTY_TYPES))
    facts = cleaning.fill_facts(df, DIRTY_TYPES)
    fills = cleaning.choose_fills(facts, DIRTY_TYPES)
    table_ = cleaning.fill_table(df, facts, fills, DIRTY_TYPES)
    number = F.round(F.expr("try_cast(fill_value AS double)"), 3).cast("string")
    return table_.withColumn("fill_value", F.coalesce(number, "fill_value"))


@query
def clean_result(spark, sf):
    return rounded(cleaned(spark, sf).df, 3)


@query
def clean_log(spark, sf):
    return cleaned(spark, sf).log.select("column", "operation", "count", "strategy")


@query
def clean_summary(spark, sf):
    return cleaned(spark, sf).summary.drop("operation_count", "schema_context_used", "outliers_removed")


# -- exploration -----------------------------------------------------------------------

@query
def overview(spark, sf):
    return eda.overview(dirty(spark, sf))


@query
def semantic_type_counts(spark, sf):
    df = view(spark, sf, views.DIRTY_ORDERS)
    return eda.type_counts(Table(df, profile.schema_profile(df, KEY), KEY))


@query
def missing_values_by_column(spark, sf):
    return eda.missing_by_column(sparse(spark, sf))


@query
def high_missing_columns(spark, sf):
    return eda.high_missing_columns(eda.missing_by_column(sparse(spark, sf)))


@query
def co_missing(spark, sf):
    return eda.co_missing_pairs(sparse(spark, sf))


@query
def numeric_profile(spark, sf):
    return rounded(eda.numeric_profile(lineitem(spark, sf)))


@query
def numeric_profile_dirty(spark, sf):
    found = eda.numeric_profile(dirty(spark, sf))
    return rounded(found.withColumn("variance", F.round("variance", -2)), 3)


@query
def categorical_profile(spark, sf):
    return eda.categorical_profile(dirty(spark, sf))


def ranked_quantiles(spark, sf, group: str) -> DataFrame:
    """Median and 90 % quantile by ranks, the way large groups take them."""
    x = F.col("l_extendedprice")
    long = table(spark, sf, "lineitem").select(group, x.alias("x")).where(x.isNotNull())
    found = ranks.rank_quantiles(long, [group], "x", [0.5, 0.9])
    return found.select(group, F.round(F.col("quantiles")[0], 4).alias("median"), F.round(F.col("quantiles")[1], 4).alias("p90"))


@query
def exact_quantiles(spark, sf):
    return ranked_quantiles(spark, sf, "l_returnflag")


@query
def exact_quantiles_by_part(spark, sf):
    return ranked_quantiles(spark, sf, "l_partkey")


def order_facts(spark, sf) -> DataFrame:
    """Lineitem with two measures that depend on others, for relationships worth ranking."""
    return table(spark, sf, "lineitem").select(
        "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net_price"),
        F.when(F.col("l_quantity") >= 40, "bulk").when(F.col("l_quantity") >= 15, "standard").otherwise("small")
        .alias("size_class"),
        F.when(F.col("l_quantity") >= 40, "pallet").otherwise("parcel").alias("packing"),
        (F.date_diff(F.col("l_shipdate").cast("date"), F.lit("1990-01-01").cast("date")) * 10.0
         + F.col("l_quantity")).alias("ship_index"),
    )


FACT_TYPES = {
    "l_quantity": "Numerical", "l_extendedprice": "Numerical", "l_discount": "Numerical", "l_tax": "Numerical",
    "l_returnflag": "Categorical", "l_linestatus": "Categorical", "l_shipdate": "Datetime",
    "net_price": "Numerical", "size_class": "Categorical", "packing": "Categorical", "ship_index": "Numerical",
}


def facts(spark, sf) -> Table:
    return Table(order_facts(spark, sf), FACT_TYPES)


@query
def correlations(spark, sf):
    return eda.ranked_correlations(eda.correlation_pairs(facts(spark, sf)))


@query
def flat_correlations(spark, sf):
    return eda.EdaReport(facts(spark, sf)).flat_correlations


@query
def distributions(spark, sf):
    return rounded(eda.EdaReport(lineitem(spark, sf)).distributions)


@query
def skipped_categories(spark, sf):
    return eda.skipped_categories(Table(table(spark, sf, "lineitem"), {"l_returnflag": "Categorical", "l_suppkey": "Categorical"}))


@query
def quoted_names(spark, sf):
    """SQL text over columns whose names hold blanks and quotation marks."""
    odd = table(spark, sf, "orders").select(F.col("o_orderkey").alias("order key"), F.col("o_totalprice").alias("a`b"))
    key, price = templates.quote("order key"), templates.quote("a`b")
    return spark.sql(f"SELECT {key} AS k, {price} AS p FROM {{odd}} WHERE {price} > 1000", odd=odd)


@query
def strongest_correlations(spark, sf):
    return eda.strongest_correlations(eda.correlation_pairs(facts(spark, sf)))


@query
def heatmap_matrix(spark, sf):
    return charts.heatmap(facts(spark, sf))


@query
def heatmap_pivot(spark, sf):
    return charts.matrix_pivot(charts.heatmap(facts(spark, sf)), "y", "x", "correlation")


def wide(spark, sf) -> Table:
    df = spark.sql(views.WIDE_LINEITEM.replace("FROM lineitem", "FROM {lineitem}"), lineitem=table(spark, sf, "lineitem"))
    return Table(df, {c: "Numerical" for c in views.WIDE_NUMBERS})


@query
def wide_correlations(spark, sf):
    found = eda.correlation_pairs(wide(spark, sf))
    return found.withColumn("correlation", F.round("correlation", 6))


@query
def wide_pivot(spark, sf):
    return charts.matrix_pivot(charts.heatmap(wide(spark, sf)), "y", "x", "correlation")


@query
def strongest_pair(spark, sf):
    return charts.strongest_pair(eda.correlation_pairs(facts(spark, sf)))


@query
def category_numeric_groups(spark, sf):
    return rounded(eda.category_numeric_groups(facts(spark, sf)), 3)


@query
def category_numeric_effect(spark, sf):
    return eda.category_numeric_effects(eda.category_numeric_moments(facts(spark, sf)))


@query
def crosstabs(spark, sf):
    return eda.crosstabs(facts(spark, sf))


@query
def cramers_v(spark, sf):
    return eda.cramers_v(eda.crosstabs(facts(spark, sf)))


@query
def datetime_profile(spark, sf):
    return eda.datetime_profile(dirty(spark, sf))


@query
def time_trend(spark, sf):
    return eda.time_trends(facts(spark, sf))


@query
def time_trend_events(spark, sf):
    return eda.time_trends(table(spark, sf, "events"), {"ts": "Datetime", "value": "Numerical"})


@query
def important_relationships(spark, sf):
    return eda.EdaReport(facts(spark, sf)).important_relationships


@query
def eda_flags(spark, sf):
    return eda.EdaReport(dirty(spark, sf)).flags.select("type", "column", "severity", "message")


@query
def chart_recommendations(spark, sf):
    return eda.EdaReport(facts(spark, sf)).chart_recommendations


# -- charts --------------------------------------------------------------------------------

@query
def category_frequency(spark, sf):
    return charts.category_frequency(view(spark, sf, views.DIRTY_ORDERS), "priority")


@query
def usable_categories(spark, sf):
    t = Table(table(spark, sf, "part"), {"p_name": "Categorical", "p_brand": "Categorical", "p_type": "Categorical"})
    found = charts.usable_category_columns(t, ["p_name", "p_brand", "p_type"])
    return frames.local_rows(spark, list(found.items()), "column string, unique_values long")


@query
def numeric_test(spark, sf):
    df = view(spark, sf, views.DIRTY_ORDERS)
    rows = [(c, c in charts.numeric_columns(df.drop("row_id"))) for c in views.DIRTY_COLUMNS]
    return frames.local_rows(spark, rows, "column string, is_numeric boolean")


@query
def histogram(spark, sf):
    return rounded(charts.histogram(table(spark, sf, "part"), "p_retailprice").drop("bin"))


@query
def histogram_lineitem(spark, sf):
    return rounded(charts.histogram(table(spark, sf, "lineitem"), "l_extendedprice").drop("bin"))


@query
def box_stats(spark, sf):
    t = Table(view(spark, sf, views.DIRTY_ORDERS), DIRTY_TYPES, KEY)
    found = charts.box_stats(t, "price")
    return rounded(found.withColumn("outliers", F.array_join(
        F.transform("outliers", lambda v: v.cast("long").cast("string")), ",")))


@query
def box_by_group(spark, sf):
    return rounded(charts.box_by_group(table(spark, sf, "orders"), "o_orderpriority", "o_totalprice"))


@query
def box_by_part(spark, sf):
    """As many groups as there are parts."""
    return rounded(charts.box_by_group(table(spark, sf, "lineitem"), "l_partkey", "l_extendedprice"))


@query
def category_numeric_by_part(spark, sf):
    return rounded(charts.category_numeric(table(spark, sf, "lineitem"), "l_partkey", "l_extendedprice"), 3)


@query
def scatter_sample(spark, sf):
    return charts.scatter_sample(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice",
                                 ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"])


@query
def category_numeric(spark, sf):
    return rounded(charts.category_numeric(table(spark, sf, "orders"), "o_orderpriority", "o_totalprice"), 3)


@query
def group_mean_variation(spark, sf):
    means = charts.category_numeric(table(spark, sf, "orders"), "o_orderpriority", "o_totalprice")
    return rounded(charts.group_mean_variation(means), 6)


@query
def composition(spark, sf):
    return charts.composition(view(spark, sf, views.DIRTY_ORDERS), "priority", "is_urgent")


@query
def time_series(spark, sf):
    return rounded(charts.time_series(table(spark, sf, "orders"), "o_orderdate", "o_totalprice"), 6)


@query
def date_axis(spark, sf):
    rows = charts.date_axis(view(spark, sf, views.DIRTY_ORDERS).select("row_id", "order_date"), "order_date")
    return rows.select("row_id", F.col("order_date").cast("date").cast("string").alias("order_date"))


@query
def bar_by_category(spark, sf):
    return rounded(charts.category_bar(table(spark, sf, "part"), "p_brand", "p_retailprice"), 3)


@query
def chart_ranking(spark, sf):
    t = Table(table(spark, sf, "part"), {
        "p_partkey": "Identifier", "p_name": "Categorical", "p_brand": "Categorical", "p_type": "Categorical",
        "p_size": "Numerical", "p_retailprice": "Numerical"}, ["p_partkey"])
    return charts.select_best(charts.spec_table(t, charts.chart_candidates(t)))


@query
def automatic_charts(spark, sf):
    """Rows of every chosen chart, counted."""
    t = Table(table(spark, sf, "part"), {
        "p_brand": "Categorical", "p_type": "Categorical", "p_size": "Numerical", "p_retailprice": "Numerical"},
        ["p_partkey"])
    return frames.union_all([
        c.data.agg(F.lit("|".join(c.signature)).alias("signature"), F.count(F.lit(1)).alias("points"))
        for c in charts.automatic_charts(t)
    ])


@query
def result_chart(spark, sf):
    result = templates.average_by(table(spark, sf, "orders"), "o_orderpriority", "o_totalprice")
    return rounded(charts.result_chart(result).data, 3)


@query
def result_chart_kpi(spark, sf):
    chart = charts.result_chart(templates.average(table(spark, sf, "orders"), "o_totalprice"))
    return chart.data.select(F.lit(chart.chart_type).alias("kind"), F.round("average_o_totalprice", 3).alias("value"))


@query
def result_chart_line(spark, sf):
    result = templates.average_by(table(spark, sf, "orders"), "o_orderdate", "o_totalprice")
    return rounded(charts.result_chart(result).data, 6)


@query
def result_chart_histogram(spark, sf):
    parts = table(spark, sf, "part")
    result = templates.average(parts, "p_retailprice")
    return rounded(charts.result_chart(result, "histogram", x="p_retailprice", source=parts).data.drop("bin"))


@query
def result_chart_scatter(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return charts.result_chart(orders, "scatter", "o_custkey", "o_totalprice", order_key=["o_orderkey"]).data


@query
def result_chart_heatmap(spark, sf):
    numbers = table(spark, sf, "lineitem").select(*views.LINEITEM_NUMBERS)
    return charts.result_chart(numbers, "heatmap").data


@query
def result_chart_stacked(spark, sf):
    result = table(spark, sf, "orders").select("o_orderstatus", "o_orderpriority")
    return charts.result_chart(result, "stacked_bar").data


@query
def result_chart_empty(spark, sf):
    """No chart for a result without rows: counted over a table of which nothing is left."""
    orders = table(spark, sf, "orders")
    chart = charts.result_chart(orders.where("o_totalprice < 0"))
    return orders.agg(F.count("*").alias("orders"), F.lit(chart is None).alias("no_chart"))


@query
def result_chart_violin(spark, sf):
    orders = table(spark, sf, "orders")
    return rounded(charts.result_chart(orders, "violin", "o_orderpriority", "o_totalprice").data)


@query
def result_chart_source(spark, sf):
    orders = table(spark, sf, "orders")
    result = templates.count_by(orders, "o_orderstatus")
    chart = charts.result_chart(result, "box", x="o_orderstatus", y="o_totalprice", source=orders)
    return rounded(chart.data)


# -- findings and summaries ---------------------------------------------------------------------

@query
def statistical_findings(spark, sf):
    score = quality_report(spark, sf, False).overall.first()["overall_score"]
    found = findings.statistical_findings(facts(spark, sf), score)
    return rounded(found.select("type", "importance", "column", "column_2", "value"), 2)


@query
def result_summary(spark, sf):
    result = templates.average_by(table(spark, sf, "lineitem"), "l_shipdate", "l_extendedprice")
    return rounded(findings.summarize_result(result).select("kind", "rows", "metric", "label", "value"), 3)


@query
def result_summary_metric(spark, sf):
    return rounded(findings.summarize_result(table(spark, sf, "lineitem").select("l_extendedprice")).drop("text"), 3)


@query
def result_summary_category(spark, sf):
    return findings.summarize_result(view(spark, sf, views.DIRTY_ORDERS).select("priority")).drop("text")


@query
def profile_context(spark, sf):
    report = eda.EdaReport(facts(spark, sf))
    found = findings.profile_context(report, ["l_quantity", "l_returnflag", "l_shipdate"])
    return found.where(F.col("section") != "correlation").where(F.col("section") != "shape")


@query
def profile_context_correlations(spark, sf):
    report = eda.EdaReport(facts(spark, sf))
    found = findings.profile_context(report, ["l_quantity"])
    return found.where((F.col("section") == "correlation") & (F.col("metric") == "interpretation"))


# -- templates and SQL ------------------------------------------------------------------------------

@query
def q_count(spark, sf):
    return templates.total_rows(table(spark, sf, "orders"))


@query
def q_distinct(spark, sf):
    return templates.distinct_values(table(spark, sf, "orders"), "o_orderpriority")


@query
def q_count_by(spark, sf):
    return templates.count_by(table(spark, sf, "orders"), "o_orderpriority")


@query
def q_avg_by(spark, sf):
    return rounded(templates.average_by(table(spark, sf, "orders"), "o_orderpriority", "o_totalprice"), 3)


@query
def q_avg(spark, sf):
    return rounded(templates.average(table(spark, sf, "orders"), "o_totalprice"), 3)


@query
def q_max(spark, sf):
    return templates.maximum(table(spark, sf, "orders"), "o_totalprice")


@query
def q_min(spark, sf):
    return templates.minimum(table(spark, sf, "orders"), "o_totalprice")


@query
def q_project(spark, sf):
    return templates.project(table(spark, sf, "orders"), ["o_orderkey", "o_totalprice"])


@query
def q_project_some(spark, sf):
    return templates.total_rows(templates.project_some(table(spark, sf, "orders"), ["o_orderkey", "o_totalprice"]))


@query
def q_preview(spark, sf):
    return templates.total_rows(templates.preview(table(spark, sf, "orders")))


@query
def schema_context(spark, sf):
    found = templates.schema_context(table(spark, sf, "orders"))
    return found.select("column", "type", F.array_join("samples", "|").alias("samples"))


@query
def describe_table(spark, sf):
    registry = TableRegistry(spark)
    registry.register(table(spark, sf, "orders"), "described_orders")
    return registry.describe("described_orders")


# Read-only SQL text that both engines run: joins, grouping sets, windows, set operations, functions.
SQL_TEXTS = {
    "sql_projection": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 400000 AND o_orderstatus <> 'P'",
    "sql_multi_aggregate": """SELECT l_returnflag, l_linestatus, COUNT(*) AS n, round(SUM(l_quantity), 2) AS sum_qty,
        round(AVG(l_extendedprice), 3) AS avg_price FROM lineitem GROUP BY l_returnflag, l_linestatus""",
    "sql_join_inner": """SELECT n.n_name, COUNT(*) AS n, round(SUM(o.o_totalprice), 2) AS total
        FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
        GROUP BY n.n_name""",
    "sql_join_outer": """SELECT c.c_mktsegment, COUNT(*) AS n, COUNT(o.o_orderkey) AS orders_placed
        FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY c.c_mktsegment""",
    "sql_join_semi": """SELECT c_custkey, c_name FROM customer
        WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)""",
    "sql_join_anti": """SELECT p_partkey, p_name FROM part
        WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45)""",
    "sql_join_theta": """SELECT b.band, COUNT(*) AS n FROM part
        JOIN (SELECT 0 AS lo, 10 AS hi, 'low' AS band UNION ALL SELECT 10, 30, 'mid' UNION ALL SELECT 30, 60, 'high') b
        ON p_size >= b.lo AND p_size < b.hi GROUP BY b.band""",
    "sql_cube": """SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders
        GROUP BY CUBE (o_orderstatus, o_orderpriority)""",
    "sql_rollup": """SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM lineitem
        GROUP BY ROLLUP (l_returnflag, l_linestatus)""",
    "sql_distinct_aggregate": "SELECT o_orderstatus, COUNT(DISTINCT o_custkey) AS customers FROM orders GROUP BY o_orderstatus",
    "sql_window": """SELECT o_custkey, o_orderkey, place FROM (SELECT o_custkey, o_orderkey,
        row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders) t
        WHERE place <= 3""",
    "sql_set_operations": """(SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'
        INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')
        EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 490000""",
    "sql_union": "SELECT n_name AS name FROM nation UNION SELECT r_name FROM region",
    "sql_filtered_aggregate": """WITH t AS (SELECT * FROM lineitem)
        SELECT l_linestatus, COUNT(*) FILTER (WHERE l_discount > 0.05) AS discounted, COUNT(*) AS n FROM t
        GROUP BY l_linestatus""",
    "sql_string_functions": """SELECT upper(trim(p_name)) AS name, COUNT(*) AS n, MIN(length(p_name)) AS size
        FROM part WHERE replace(p_name, ' ', '') LIKE '%ring' GROUP BY upper(trim(p_name))""",
}


def _sql_query(text_: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        registry = TableRegistry(spark)
        words = text_.replace(",", " ").replace("(", " ").replace(")", " ").split()
        for name in views.TABLES:
            if name in words:
                registry.register(table(spark, sf, name), name)
        return registry.query(text_.strip() if text_.lstrip()[:1] != "(" else f"SELECT * FROM ({text_}) t")
    return run


for _name, _text in SQL_TEXTS.items():
    QUERIES[_name] = _sql_query(_text)


# -- records, bundles, pipelines ------------------------------------------------------------------------

@query
def json_records(spark, sf):
    found = records.to_records(table(spark, sf, "orders"))
    get = lambda field: F.get_json_object("record", f"$.{field}").alias(field)
    return found.select(*[get(c) for c in table(spark, sf, "orders").columns])


@query
def csv_round_trip(spark, sf):
    """Orders with a 19-digit number written as CSV to the shared folder, read back and typed."""
    path = f"{shared_folder(spark)}/orders-{uuid.uuid4().hex}.csv"
    long_id = (F.col("o_orderkey") + F.lit(9_000_000_000_000_000_000)).alias("long_id")
    beyond = F.concat(F.lit("99"), F.col("o_orderkey") + F.lit(1_000_000_000_000_000_000)).alias("beyond")
    orders = table(spark, sf, "orders").select("o_orderkey", long_id, beyond, "o_totalprice", "o_orderstatus")
    orders.write.option("header", True).csv(path)
    return readers.load_dataset(spark, path)


@query
def score_delta(spark, sf):
    df, key = prepare.keyed(view(spark, sf, views.DIRTY_ORDERS), KEY)
    before = prepare.assess(df, key)
    fixed = frames.stage(cleaning.clean(df, before.profile, key).df)
    return prepare.score_delta(before.quality, prepare.assess(fixed, key).quality)


@query
def prepared_bundle(spark, sf):
    """Whole preparation, stored section by section, read back as one summary row."""
    path = bundle_path(spark)
    prepare.prepare(view(spark, sf, views.DIRTY_ORDERS), "orders", KEY, path)
    return bundle.bundle_info(spark, path)


@query
def bundle_versions(spark, sf):
    """A section replaced: the version that was open still shows the old table, the next one the new."""
    path = bundle_path(spark)
    bundle.write_bundle(path, {"cleaned": table(spark, sf, "orders"), "findings": table(spark, sf, "customer").select(F.col("c_name").alias("name"))})
    old = bundle.open_bundle(spark, path)
    bundle.replace_section(path, "findings", table(spark, sf, "supplier").select(F.col("s_name").alias("name")))
    new = bundle.open_bundle(spark, path)
    return frames.union_all([v.section("findings").select(F.lit(v.number).alias("version"), "name") for v in (old, new)])


@query
def bundle_read_back(spark, sf):
    path = bundle_path(spark)
    bundle.write_bundle(path, {"cleaned": table(spark, sf, "orders")})
    return bundle.read_section(spark, path, "cleaned")


@query
def ask_average(spark, sf):
    registry = TableRegistry(spark)
    registry.register(table(spark, sf, "orders"), "dataset")
    answer = asking.ask(registry, "SELECT o_orderstatus, AVG(o_totalprice) AS average_price FROM dataset GROUP BY o_orderstatus")
    return rounded(answer.summary.select("kind", "rows", "metric", "label", "value"), 3)


def bundle_path(spark: SparkSession) -> str:
    """A new folder under the session's shared one."""
    return f"{shared_folder(spark)}/bundle-{uuid.uuid4().hex}"


# -- flagship ----------------------------------------------------------------------------------------------

def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Profile the orders, clean them by that profile, and average the price by priority."""
    orders = table(spark, sf, "orders")
    found = profile.schema_profile(orders)
    fixed = cleaning.clean(orders, found)
    registry = TableRegistry(spark)
    registry.register(fixed.df, "dataset")
    return templates.average_by(spark.table("dataset"), "o_orderpriority", "o_totalprice")
