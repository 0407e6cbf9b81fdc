"""

The order-item table is built once per session and data folder, stored in the shared folder of
the session, and read back by the queries, as an analyst would use it.
"""

from __future__ import annotations

import os
import shutil
import sys
import tempfile
import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HOME = os.path.dirname(os.path.abspath(__file__))
if HOME not in sys.path:
    sys.path.insert(0, HOME)

from marketlens.functions.columns import delay_band_label, delay_band_order
from marketlens.functions.text import normalize
from marketlens.operators import model, profile, quality, semantic, sketches, summaries
from marketlens.operators.reduce import reduce_to
from marketlens.plans import delivery, evidence, explain, followups, investigate, metrics, revenue
from marketlens.plans.routing import route_questions
from marketlens.session import new_table_path
from marketlens.sources import adapter, layout, staging, tables
from marketlens.streaming import conversations as streamed
from marketlens_checks.oracle import oracle_queries

try:  # the text operators can be taken away as a whole
    from marketlens.llm import queries as text_queries
except ModuleNotFoundError as missing:
    # Nor may one of their dependencies that isn't there take the other queries away.
    if missing.name not in ("marketlens.llm", "marketlens.llm.queries"):
        warnings.warn(f"The text operators are left out: {missing}", stacklevel=1)
    text_queries = None

FLAGSHIP_FOLDER = "/root/testdata/sf0.001"
#: Rows of a source file, which is packed.
CSV_ROWS = 1_000_000

_stored: dict[tuple[str, str, str], object] = {}


def _once(spark, folder, kind, write, read=lambda path: path):
    """What is written once per session and data folder, as `read` returns it."""
    key = (spark.sparkContext.applicationId, folder, kind)
    if key not in _stored:
        path = new_table_path(spark, kind)
        write(path)
        _stored[key] = read(path)
    return _stored[key]


def _ship_library(spark):
    """Make the library importable in Python workers, wherever the session was started.

    Spark hands the archive to the executors, as with --py-files.
    """

    def add(path):
        name = os.path.join(tempfile.mkdtemp(), "marketlens")
        archive = shutil.make_archive(name, "zip", HOME, "marketlens")
        spark.sparkContext.addPyFile(archive)

    _once(spark, HOME, "library", add)


def _build(spark, folder):
    return model.build_order_items(adapter.staging_from_star_schema(spark, folder))


def _split_orders(spark, folder):
    """The order-item table with every order of several items spread over salts."""
    return model.build_order_items(adapter.staging_from_star_schema(spark, folder), rows_per_salt=2)


def _bucketed(spark, folder):
    """The order-item table of a layout in buckets; large orders are outside of them."""
    staged = adapter.staging_from_star_schema(spark, folder)
    path = _once(
        spark,
        folder,
        "by_order",
        lambda path: layout.store_by_order(staged, path, rows_per_salt=6),
    )
    return layout.build_from_layout(spark, path)


def order_items(spark, folder):
    """The stored order-item table of a data folder."""
    return _once(
        spark,
        folder,
        "order_items",
        lambda path: tables.store_order_items(adapter.staging_from_star_schema(spark, folder), path),
        lambda path: tables.read_order_items(spark, path),
    )


def orders_table(spark, folder):
    """The stored order-grain table of a data folder."""
    return _once(
        spark,
        folder,
        "orders",
        lambda path: tables.write_orders(order_items(spark, folder), path),
        lambda path: spark.read.parquet(path),
    )


def _csv_folder(spark, folder):
    def write(path):
        for name, df in adapter.staging_from_star_schema(spark, folder).items():
            # One task reads a packed file whole, so the number of its rows is bounded.
            rows = df.write.option("header", True).option("maxRecordsPerFile", CSV_ROWS)
            rows.option("compression", "gzip").csv(f"{path}/{name}.csv")

    return _once(spark, folder, "source_files", write)


def _built_from_files(spark, folder):
    source = _csv_folder(spark, folder)
    return _once(
        spark,
        folder,
        "order_items_from_files",
        lambda path: tables.build_from_files(spark, source, path),
        lambda path: tables.read_order_items(spark, path),
    )


def _staged(name):
    def query(spark, folder):
        paths = staging.required_files(spark, _csv_folder(spark, folder))
        return staging.read_staging(spark, paths)[name]

    return query


def _source_row_counts(spark, folder):
    """Rows and values that do not parse, per checked source file."""
    paths = staging.required_files(spark, _csv_folder(spark, folder))
    counted = None
    for name, path in paths.items():
        # Reader and counters take line breaks in quotes the same way.
        rows = staging.read_csv_source(spark, name, path).agg(F.count(F.lit(1)).alias("source_rows"))
        bad = staging.bad_value_counts(spark, name, path).agg(F.sum("bad_values").alias("bad"))
        one = (
            rows.unionByName(bad, allowMissingColumns=True)
            .agg(F.max("source_rows").alias("source_rows"), F.max("bad").alias("bad_values"))
            .select(F.lit(name).alias("source"), "source_rows", "bad_values")
        )
        counted = one if counted is None else counted.unionByName(one)
    return counted


def _malformed(spark, folder):
    """Items whose lines have lost a field, or have one more, by order; the others are whole."""

    def write(path):
        lines = spark.read.parquet(f"{folder}/lineitem.parquet")
        key = F.col("l_orderkey")
        fields = [F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]
        price = F.when(key % 13 != 0, F.concat(F.lit(',"'), F.col("l_extendedprice").cast("string"), F.lit('"')))
        more = F.when(key % 13 == 1, F.lit(',"a, b"'))
        line = F.concat(F.concat_ws(",", *fields), F.coalesce(price, F.lit("")), F.coalesce(more, F.lit("")))
        # One header per file, as in any folder of CSV files.
        lines.select(line.alias("order_id,order_item_id,product_id,seller_id,price")).write.option(
            "header", True
        ).option("quote", "\u0000").option("sep", "\u0001").csv(path)

    path = _once(spark, folder, "malformed_items", write)
    return staging.malformed_counts(spark, {"order_items": path})


def _from_staging(function, *names):
    def query(spark, folder):
        staged = adapter.staging_from_star_schema(spark, folder)
        return function(*[staged[name] for name in names])

    return query


def _on_table(function, *args, **kwargs):
    return lambda spark, folder: function(order_items(spark, folder), *args, **kwargs)


def _on_orders(function):
    return lambda spark, folder: function(orders_table(spark, folder))


def _report_of_write(spark, folder):
    """The report of the table as it is built and written, without a scan of it."""
    return tables.write_validated(_build(spark, folder), new_table_path(spark, "validated_items"))


def _raw_lineitem(spark, folder):
    """Lineitem as an order-item table whose line numbers repeat: the grain check has to fail."""
    return spark.read.parquet(f"{folder}/lineitem.parquet").select(
        F.col("l_orderkey").cast("string").alias("order_id"),
        F.when(F.col("l_partkey") % 101 != 0, F.col("l_linenumber")).alias("order_item_id"),
        F.when(F.col("l_suppkey") % 29 != 0, F.col("l_partkey")).alias("product_id"),
        (F.col("l_extendedprice") - 1000).alias("item_price"),
        F.col("l_quantity").alias("freight_value"),
        (F.col("l_extendedprice") - 1000 + F.col("l_quantity")).alias("item_total_value"),
        (F.col("l_linenumber") - 1).cast("double").alias("average_review_score"),
        (F.col("l_quantity") - 3).cast("bigint").alias("delivery_days"),
    )


def _summarized(function):
    def query(spark, folder):
        _ship_library(spark)
        return function(order_items(spark, folder))

    return query


def _merged_sketches(spark, folder):
    """Known values by merged sketches of the months, and whether distinct counts are within bounds."""
    items = order_items(spark, folder)
    merged = sketches.merged_profile(sketches.month_sketches(items))
    exact = profile.column_counts(items).select("column_name", "unique_count")
    off = F.abs(F.col("distinct_estimate") - F.col("unique_count"))
    allowed = F.greatest(F.lit(1.0), 5 * sketches.DISTINCT_ERROR * F.col("unique_count"))
    return merged.join(exact, "column_name").select("column_name", "known_values", (off <= allowed).alias("is_near"))


def _sample_values(spark, folder):
    return profile.sample_values(order_items(spark, folder))


def _numeric_statistics(spark, folder):
    places = F.lit(10000.0)
    stats = profile.numeric_statistics(order_items(spark, folder))
    return stats.withColumn("mean", F.round(F.col("mean") * places) / places)


def _profile(spark, folder):
    """The whole profile, lists as texts and bounds as numbers or times."""
    whole = profile.profile_table(order_items(spark, folder))
    bounds, places = F.col("statistics"), F.lit(10000.0)
    number = bounds["median"].isNotNull()
    common = F.transform("most_common_values", lambda v: F.concat_ws("=", v["value"], v["frequency"]))
    return whole.select(
        *[c for c in whole.columns if c not in ("sample_values", "most_common_values", "statistics")],
        F.when(number, bounds["minimum"].cast("double")).alias("least"),
        F.when(number, bounds["maximum"].cast("double")).alias("most"),
        (F.round(bounds["mean"] * places) / places).alias("mean"),
        bounds["median"].alias("median"),
        F.when(~number, bounds["minimum"]).alias("first_time"),
        F.when(~number, bounds["maximum"]).alias("last_time"),
        F.array_join("sample_values", "|").alias("samples"),
        F.array_join(common, "|").alias("common_values"),
    )


def _dense_numbers(spark, folder):
    """Statistics of ids far from zero, tiny shares, decimals, and numbers that are none."""
    rows = spark.read.parquet(f"{folder}/lineitem.parquet")
    key, quantity = F.col("l_orderkey"), F.col("l_quantity")
    table = rows.select(
        (key + 10**12).alias("far_id"),
        (F.col("l_tax") / 1e6).alias("share"),
        (-key).alias("below_zero"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("exact"),
        F.when(key % 7 == 0, float("nan"))
        .when(key % 11 == 0, float("-inf"))
        .otherwise(quantity)
        .alias("gaps"),
    )
    return profile.numeric_statistics(table).drop("mean")


def _fallback_aggregations(spark, folder):
    """Columns that no one has registered, each aggregated as its inferred semantics allow."""
    table = spark.read.parquet(f"{folder}/lineitem.parquet").select(
        F.col("l_orderkey").alias("line_id"),
        "l_quantity",
        "l_returnflag",
        "l_shipdate",
        (F.col("l_tax") > 0.04).alias("taxed"),
    )
    found = None
    for name, column, aggregation in (
        ("orders", "line_id", "count_distinct"),
        ("taxed", "taxed", None),
        ("quantity", "l_quantity", None),
        ("middle", "l_quantity", "median"),
        ("last_shipped", "l_shipdate", "maximum"),
    ):
        one = semantic.aggregate_metric(table, column, aggregation, by=["l_returnflag"])
        one = one.withColumnRenamed("value", name)
        found = one if found is None else found.join(one, "l_returnflag")
    return found


def _metadata(spark, folder):
    def write(path):
        built = semantic.build_semantic_metadata(order_items(spark, folder))
        semantic.save_semantic_metadata(built, path)

    # An explicit schema: the file holds what was written, no inference pass is needed.
    path = _once(spark, folder, "semantic_metadata", write)
    return spark.read.schema(
        "column_name string, position int, semantic_role string, metric_grain string, "
        "allowed_aggregations array<string>, default_aggregation string, is_additive boolean, "
        "is_primary_time_dimension boolean, warning string, inference_source string, "
        "unique_count bigint"
    ).json(path)


def _metadata_rows(spark, folder):
    return _metadata(spark, folder).select(
        "column_name",
        "position",
        "semantic_role",
        "metric_grain",
        F.array_join("allowed_aggregations", ",").alias("allowed"),
        "default_aggregation",
        "is_additive",
        "inference_source",
        "unique_count",
    )


def _fallback(spark, folder):
    """Inferred semantics of a table without registered columns."""
    table = spark.read.parquet(f"{folder}/lineitem.parquet").select(
        F.col("l_orderkey").alias("line_id"),
        "l_quantity",
        "l_returnflag",
        "l_shipdate",
        (F.col("l_tax") > 0.04).alias("taxed"),
        F.concat_ws("-", "l_orderkey", "l_partkey", "l_linenumber").alias("label"),
    )
    counts = profile.column_counts(table)
    return semantic.enrich_profile(counts).select(
        "column_name",
        "unique_count",
        "cardinality_ratio",
        "semantic_role",
        "default_aggregation",
        F.array_join("allowed_aggregations", ",").alias("allowed"),
        "inference_source",
    )


def _registry(spark, folder):
    """Registered columns with the number of known values each has."""
    known = order_items(spark, folder)
    counts = known.agg(*[F.count(c).alias(c) for c in known.columns])
    names = counts.unpivot([], known.columns, "column_name", "known_values")
    return names.join(F.broadcast(semantic.column_registry(spark)), "column_name", "left").select(
        "column_name",
        "known_values",
        "semantic_role",
        "entity",
        "metric_grain",
        "default_aggregation",
        "is_additive",
    )


def _questions(spark, folder):
    return adapter.questions_from_star_schema(spark, folder)


def _routes(spark, folder):
    return route_questions(_questions(spark, folder)).select(
        "question_id", "normalized_question", "analysis_type", "matched_rule"
    )


def _routed_texts(table, *keys):
    def query(spark, folder):
        texts = spark.read.parquet(f"{folder}/{table}.parquet")
        return route_questions(texts, "text").select(*keys, "analysis_type", "matched_rule")

    return query


def _target_months(spark, folder):
    components = investigate.monthly_revenue_components(order_items(spark, folder))
    return investigate.resolve_target_months(_questions(spark, folder), components).select(
        "question_id", "month_key", "target_month", F.col("month_error").isNotNull().alias("failed")
    )


def _investigations(spark, folder):
    asked = route_questions(_questions(spark, folder)).filter(
        F.col("analysis_type") == "revenue_change_investigation"
    )
    return investigate.investigate(order_items(spark, folder), asked).select(
        "question_id",
        "target_month",
        "previous_month_start",
        "revenue_change_amount",
        "order_count_change",
        "average_order_value_change",
        "evidence_scope",
        "change_rank",
        "dimension_value",
        "change_amount",
        "contribution_to_total_change_percentage",
    )


def evidence_inputs(spark, folder):
    """What the analyses of a batch share, prepared once per data folder."""
    return _once(
        spark,
        folder,
        "evidence_inputs",
        lambda path: None,
        lambda path: evidence.prepare(order_items(spark, folder)),
    )


def _evidence_metrics(handler):
    """The metrics of one analysis as rows (month, metric, value)."""

    def query(spark, folder):
        packed = handler(evidence_inputs(spark, folder))
        return packed.select(
            F.date_format("target_month", "yyyy-MM").alias("month"),
            F.explode("metrics").alias("metric", "value"),
        )

    return query


def _evidence_records(spark, folder):
    """Everything that the evidence of each analysis says in words."""
    records = evidence_inputs(spark, folder).evidence
    methods = F.array_sort(F.transform(F.map_entries("methodology"), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return records.select(
        "analysis_type",
        F.date_format("target_month", "yyyy-MM").alias("month"),
        "summary",
        F.array_join(methods, "|").alias("methods"),
        F.array_join("warnings", "|").alias("warnings"),
    )


def _evidence_rows(spark, folder):
    """The supporting rows of every analysis, numbered from 1."""

    def field(*names):
        return F.coalesce(*[F.get_json_object("record", f"$.{name}") for name in names])

    rows = evidence_inputs(spark, folder).evidence.select(
        "analysis_type",
        F.date_format("target_month", "yyyy-MM").alias("month"),
        F.posexplode("supporting_rows").alias("position", "record"),
    )
    return rows.select(
        "analysis_type",
        "month",
        (F.col("position") + 1).alias("row"),
        field(
            "product_category", "customer_state", "delivery_status", "purchase_month_start"
        ).alias("label"),
        field("change_amount", "item_revenue", "late_delivery_rate_percentage", "order_count")
        .cast("double")
        .alias("value"),
    )


def _answers(spark, folder):
    return evidence.answer_from(evidence_inputs(spark, folder), _questions(spark, folder))


def _answer_rows(spark, folder):
    return _answers(spark, folder).select(
        "question_id",
        "analysis_type",
        "supported",
        "target_month",
        F.col("error").isNotNull().alias("failed"),
        F.coalesce(F.size("supporting_rows"), F.lit(0)).alias("rows"),
        F.coalesce(F.size("metrics"), F.lit(0)).alias("metrics"),
        F.col("methodology")["router_rule"].alias("router_rule"),
    )


def _unsupported(spark, folder):
    answers = _answers(spark, folder).filter(F.col("analysis_type") == "unsupported")
    return explain.explanations(answers).select("question_id", "supported", "explanation")


def _prompts(spark, folder):
    answers = _answers(spark, folder).filter("supported")
    prompts = explain.explanations(answers).select("question_id", "question", "prompt")
    found = F.regexp_extract("prompt", r"(?s)as JSON:\n\n(.*)\n\nUse nothing", 1)
    return prompts.withColumn("evidence", found).select(
        "question_id",
        F.startswith(
            "prompt", F.concat(F.lit("Question asked:\n\n"), F.col("question"))
        ).alias("starts_with_question"),
        F.get_json_object("evidence", "$.analysis_type").alias("analysis_type"),
        F.get_json_object("evidence", "$.question").alias("question"),
        F.json_array_length(F.get_json_object("evidence", "$.supporting_rows")).alias("rows"),
        F.json_array_length(F.get_json_object("evidence", "$.warnings")).alias("warnings"),
        F.get_json_object("evidence", "$.metrics.leading_state").alias("leading_state"),
    )


def _explained_orders(spark, folder):
    return spark.read.parquet(f"{folder}/orders.parquet").select(
        F.col("o_orderkey").alias("question_id"),
        adapter.explanation_from_order().alias("explanation"),
    )


def _displayed(spark, folder):
    return _explained_orders(spark, folder).select(
        "question_id", explain.display_markdown(F.col("explanation")).alias("shown")
    )


def _cited(spark, folder):
    # What is to be explained meets its text before the evidence, which is much wider, is attached.
    ordered = spark.read.parquet(f"{folder}/orders.parquet").select("o_orderkey", "o_totalprice")
    asked = _questions(spark, folder).join(ordered, F.col("question_id") == F.col("o_orderkey"))
    answers = evidence.answer_from(evidence_inputs(spark, folder), asked).filter("supported")
    explained = answers.withColumn("explanation", adapter.explanation_from_order())
    return explain.citations(explained).select(
        "question_id", "analysis_type", "position", "kind", "target", "is_known"
    )


def _needs_context(spark, folder):
    return _questions(spark, folder).select(
        "question_id", followups.needs_context(F.col("question")).alias("leans")
    )


def _conversation_needs_context(spark, folder):
    texts = spark.read.parquet(f"{folder}/conversations.parquet")
    return texts.select("conv_id", "turn", followups.needs_context(F.col("text")).alias("leans"))


def _resolved(spark, folder):
    _ship_library(spark)
    months = followups.answerable_months(evidence_inputs(spark, folder).components)
    return followups.resolve_conversations(_questions(spark, folder), months)


def _streamed(spark, folder):
    """The same conversations as a stream that stops and starts again twice."""
    _ship_library(spark)
    streamed.use_state_store(spark)
    months = followups.answerable_months(evidence_inputs(spark, folder).components)
    turns = _questions(spark, folder).select("conv_id", "turn", "question")
    last = turns.agg(F.max("turn")).first()[0] or 0
    base = new_table_path(spark, "streamed_turns")
    for part in range(3):
        arrived = F.floor(F.col("turn") * 3 / (last + 1)) == part
        turns.filter(arrived).write.mode("append").option("compression", "zstd").parquet(f"{base}/turns")
        arriving = spark.readStream.schema(turns.schema).parquet(f"{base}/turns")
        streamed.run_available(arriving, f"{base}/resolved", f"{base}/checkpoint", months)
    resolved = spark.read.schema(streamed.RESOLVED).parquet(f"{base}/resolved")
    return resolved.withColumn("was_rewritten", F.col("question") != F.col("resolved_question"))


def _two_months(spark, folder, function):
    """A change between the last two complete months of the test data."""
    return function(order_items(spark, folder), "2001-07-01", "2001-06-01")


def _order_level(df):
    return reduce_to(
        df,
        ["order_id"],
        list(delivery.SCORED) + ["customer_state"],
        item_rows=F.count(F.lit(1)),
    )


def _delay_bands(df):
    orders = reduce_to(df, ["order_id"], ["delivery_delay_days"])
    band = delay_band_order("delivery_delay_days")
    return orders.select(
        "order_id", "delivery_delay_days", band.alias("band"), delay_band_label(band).alias("label")
    )


def _all_changes(df):
    months = investigate.comparable_months(investigate.monthly_revenue_components(df))
    return investigate.revenue_changes(df, months)


def entry(spark: SparkSession) -> DataFrame:
    """Revenue, orders and revenue share by product category."""
    return revenue.revenue_by_category(order_items(spark, FLAGSHIP_FOLDER))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    added = text_queries.QUERIES if text_queries else {}
    return {**_own_queries(), **added}


def _own_queries():
    metric = semantic.aggregate_metric
    return {
        "SRC1_SRC2_source_row_counts": _source_row_counts,
        "SRC2_malformed_rows": _malformed,
        "SRC2_staged_orders": _staged("orders"),
        **{
            f"SRC2_staged_{name}": _staged(name)
            for name in (
                "order_items",
                "customers",
                "products",
                "payments",
                "reviews",
                "category_translation",
            )
        },
        "SRC3_stored_table": _on_table(lambda df: df),
        "SRC6_table_schema": _on_table(
            lambda df: tables.table_summary(df).select("row_count", F.inline("columns"))
        ),
        "SRC6_table_summary": _on_table(
            lambda df: tables.table_summary(df).select("row_count", "column_count")
        ),
        "SRC7_build_from_files": _built_from_files,
        "SC11_delay_bands": _on_table(_delay_bands),
        "M1_payment_summary": _from_staging(model.payment_summary, "payments"),
        "M2_review_summary": _from_staging(model.review_summary, "reviews"),
        "M3_translated_products": _from_staging(
            model.translated_products, "products", "category_translation"
        ),
        "M4_order_level_reduction": _on_table(_order_level),
        "M5_analytical_table": _build,
        "M5_split_orders": _split_orders,
        "M5_bucketed_orders": _bucketed,
        "A1_item_revenue": _on_table(metrics.item_revenue),
        "A2_freight_value": _on_table(metrics.freight_value),
        "A3_order_count": _on_table(metrics.order_count),
        "A4_average_order_value": _on_orders(metrics.average_order_value),
        "A5_late_delivery_rate": _on_orders(metrics.late_delivery_rate),
        "A6_average_review_score": _on_orders(metrics.average_review_score),
        "A7_business_kpis": _on_orders(metrics.business_kpis),
        "A7_business_kpis_of_items": _on_table(metrics.business_kpis),
        "A8_monthly_revenue_trend": _on_table(metrics.monthly_revenue_trend),
        "A9_revenue_by_category": _on_table(revenue.revenue_by_category),
        "A10_revenue_by_state": _on_table(revenue.revenue_by_state),
        "A11_top_revenue_categories": _on_table(revenue.top_revenue_categories, 5),
        "A12_bottom_revenue_categories": _on_table(revenue.bottom_revenue_categories, 5),
        "A13_complete_monthly_revenue": _on_table(revenue.complete_monthly_revenue),
        "A14_largest_monthly_changes": _on_table(revenue.largest_monthly_revenue_changes),
        "A15_delivery_by_state": _on_orders(delivery.delivery_by_state),
        "A15_delivery_by_state_of_items": _on_table(delivery.delivery_by_state),
        "A16_delivery_by_category": _on_table(delivery.delivery_by_category),
        "A17_worst_delivery_sellers": _on_table(delivery.worst_delivery_sellers),
        "A18_late_vs_on_time": _on_orders(delivery.late_and_on_time_orders),
        "A19_delivery_review_relationship": _on_orders(delivery.delivery_review_relationship),
        "A19_delivery_review_relationship_of_items": _on_table(delivery.delivery_review_relationship),
        "A20_state_overview": _on_table(delivery.state_overview),
        "A21_monthly_components": _on_table(
            lambda df: investigate.monthly_revenue_components(df).drop("previous_month_start")
        ),
        "A22_category_revenue_change": lambda spark, folder: _two_months(
            spark, folder, investigate.category_revenue_change
        ),
        "A22_state_revenue_change": lambda spark, folder: _two_months(
            spark, folder, investigate.state_revenue_change
        ),
        "A22_all_months_changes": _on_table(_all_changes),
        "A23_investigations": _investigations,
        "Q1_Q13_validation_report": _on_table(quality.validate),
        "Q1_Q13_validation_checks": _on_table(
            lambda df: quality.validation_checks(quality.validate(df))
        ),
        "Q1_Q13_report_of_write": _report_of_write,
        "Q13_failing_grain": lambda spark, folder: quality.validate(_raw_lineitem(spark, folder)),
        "P1_column_counts": _on_table(profile.column_counts),
        "P1_merged_month_sketches": _merged_sketches,
        "P2_numeric_statistics": _numeric_statistics,
        "P2_dense_numbers": _dense_numbers,
        "P3_temporal_statistics": _on_table(profile.temporal_statistics),
        "P4_most_common_values": _on_table(profile.most_common_values),
        "P4_frequent_by_summaries": _summarized(summaries.frequent_values),
        "P5_sample_values": _sample_values,
        "P5_smallest_by_summaries": _summarized(summaries.smallest_values),
        "P6_table_profile": _profile,
        "S1_column_registry": _registry,
        "S2_fallback_semantics": _fallback,
        "S3_SRC5_semantic_metadata": _metadata_rows,
        "S4_role_counts": lambda spark, folder: semantic.role_counts(_metadata(spark, folder)),
        "S3_table_metadata": _on_table(
            lambda df: semantic.table_metadata(df, "order_items").select(
                "table_name",
                "row_count",
                "column_count",
                "table_grain",
                F.array_join("grain_key_columns", ",").alias("grain_key_columns"),
                F.size("important_rules").alias("rules"),
            )
        ),
        "S4_warnings": lambda spark, folder: semantic.aggregation_warnings(_metadata(spark, folder)),
        "S5_fallback_aggregations": _fallback_aggregations,
        "S5_payment_value_by_state": _on_table(
            metric, "total_payment_value", by=["customer_state"]
        ),
        "S5_median_price_by_category": _on_table(
            metric, "item_price", "median", by=["product_category"]
        ),
        "S5_late_share_by_week": _on_table(
            metric, "is_late_delivery", by=[("purchase_timestamp", "group_by_week")]
        ),
        "S5_sellers_by_year": _on_table(metric, "seller_id", by=["purchase_year"]),
        "EV1_normalized_questions": lambda spark, folder: _questions(spark, folder).select(
            "question_id", normalize(F.col("question")).alias("normalized_question")
        ),
        "EV2_routes": _routes,
        "EV2_conversation_routes": _routed_texts("conversations", "conv_id", "turn"),
        "EV2_document_routes": _routed_texts("documents", "doc_id"),
        "EV3_core_kpis": _evidence_metrics(evidence.core_kpis),
        "EV4_monthly_trend": _evidence_metrics(evidence.monthly_trend),
        "EV5_category_revenue": _evidence_metrics(evidence.category_revenue),
        "EV5_state_revenue": _evidence_metrics(evidence.state_revenue),
        "EV6_state_delivery": _evidence_metrics(evidence.state_delivery),
        "EV7_late_versus_on_time": _evidence_metrics(evidence.late_versus_on_time),
        "EV8_target_months": _target_months,
        "EV9_investigation": _evidence_metrics(evidence.revenue_change_investigation),
        "EV3_EV9_records": _evidence_records,
        "EV10_EX1_unsupported": _unsupported,
        "EV11_answers": _answer_rows,
        "EV12_supporting_rows": _evidence_rows,
        "FU1_needs_context": _needs_context,
        "FU1_conversation_turns": _conversation_needs_context,
        "FU2_FU3_resolved_conversations": _resolved,
        "FU3_streamed_conversations": lambda spark, folder: _streamed(spark, folder).drop("was_late"),
        "EX2_prompts": _prompts,
        "EX3_display_markdown": _displayed,
        "EX4_citations": _cited,
    }


def oracle_sql() -> dict[str, str]:
    added = text_queries.ORACLE_SQL if text_queries else {}
    return {**oracle_queries(), **added}
