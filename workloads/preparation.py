"""Scans, schema, null profile, imputation and duplicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from wellspring.functions.nulls import nan_to_null
from wellspring.operators.duplicates import duplicate_count, remove_duplicates
from wellspring.operators.imputation import handle_missing, most_frequent
from wellspring.operators.ordered import first_rows_per_key
from wellspring.operators.profile import contract_nulls, missing_ranked, null_profile, total_missing
from wellspring.operators.validation import (
    REQUIRED, drop_incomplete, label_feature_split, required_columns_report, split_known, validate_structure,
)
from wellspring.plans.processing import count_rows
from wellspring.session import scratch_path
from wellspring.sources.readers import SOURCE_FILE, file_manifest, read_csv, read_parquet, read_usable
from wellspring.sources.writers import write_csv
from wellspring.streaming.records import encode_records
from wellspring.vocabulary import drop_columns, enforce_schema, rename_columns, to_canonical, yes_no
from workloads.inputs import pick, table, telemetry, with_gaps
from workloads.states import GAPS, TELEMETRY, over

MEASURES = ["l_quantity", "l_extendedprice", "l_discount"]


def scan_count(spark, folder):
    return count_rows(table(spark, folder, "lineitem"))


def sql_count(spark, folder):
    """Count and value range by SQL over a view, as after a load."""
    telemetry(spark, folder).createOrReplaceTempView("well_records")
    return spark.sql("SELECT well_id, count(*) AS n_rows, min(depth_measured) AS top, max(depth_measured) AS bottom "
                     "FROM well_records GROUP BY well_id")


def file_lineage(spark, folder):
    rows = read_parquet(spark, f"{folder}/lineitem.parquet", f"{folder}/lineitem.parquet", with_file=True)
    return rows.groupBy(SOURCE_FILE).agg(F.count(F.lit(1)).alias("n_rows"))


def folder_check(spark, folder):
    """Rows of a folder of well files with a broken and a short one: by the footers, and read from the usable files."""
    root, li = scratch_path(spark, "wells"), table(spark, folder, "lineitem")
    for flag in ("A", "N", "R"):
        li.where(F.col("l_returnflag") == flag).write.parquet(f"{root}/{flag}")
    table(spark, folder, "orders").write.parquet(f"{root}/short")
    table(spark, folder, "nation").select("n_name").write.text(f"{root}/broken")
    needed = ["l_orderkey", "l_quantity"]
    well = lambda path: F.element_at(F.split(path, "/"), -2).alias("well")
    footers = file_manifest(spark, root, needed, "part-*").groupBy(well("file")).agg(
        F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows"), F.max(F.substring_index("reason", ":", 1)).alias("reason"))
    rows, _ = read_usable(spark, root, needed, "part-*")
    read = rows.groupBy(well(SOURCE_FILE).alias("_well")).agg(F.count(F.lit(1)).alias("_read"), F.sum("l_quantity").alias("_quantity"))
    return footers.join(read, F.col("well") == F.col("_well"), "left").select(
        "well", "n_rows", "reason", F.coalesce("_read", F.lit(0)).alias("n_read"), F.round("_quantity", 2).alias("quantity"))


def csv_round_trip(spark, folder):
    """Events written as CSV and read back under their types."""
    events, path = table(spark, folder, "events").select("event_id", "user_id", "event_type", "value", "ts"), scratch_path(spark, "csv")
    write_csv(events, path)
    return read_csv(spark, path, events.schema).groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("user_id").alias("users"), F.round(F.sum("value"), 3).alias("total"), F.max("ts").alias("last"))


def structure_report(spark, folder):
    """Whether the columns that a run needs are there and of the right kind, and how many values each has."""
    rows = table(spark, folder, "orders").withColumnsRenamed({"o_totalprice": "Pressure_psi", "o_orderpriority": "Formation"})
    report = required_columns_report(rows, {**REQUIRED, "o_orderstatus": "number"})
    ok, message = validate_structure(rows)
    known = null_profile(rows).select(F.col("column").alias("_column"), (F.col("n_rows") - F.col("n_missing")).alias("n_known"))
    return report.join(F.broadcast(known), F.col("column") == F.col("_column"), "left").drop("_column").withColumns(
        {"valid": F.lit(ok), "message": F.lit(message)})


def feature_columns(spark, folder):
    """Sizes of the features and the label after columns that serve no model are dropped."""
    kept = drop_columns(table(spark, folder, "orders"), ["o_orderkey", "not there"])
    features, label = label_feature_split(kept, "o_orderstatus", ["o_orderdate"])
    parts = [null_profile(part).withColumn("part", F.lit(name)) for name, part in (("features", features), ("label", label))]
    return parts[0].unionByName(parts[1]).select("part", "column", "n_rows", "n_missing")


def alias_rename(spark, folder):
    stored = telemetry(spark, folder).select(
        F.col("well_id").alias("API_Well_ID"), F.col("formation_type").alias("Formation_Type"),
        F.col("clay_content_percent").alias("Clay_Content_Percent_%"), F.col("rop").alias(" ROP_m_hr "),
        F.col("fluid_loss_api").alias("Fluid_Loss_API_ml_30min"), F.col("mud_ph").alias("pH"),
    )
    named = to_canonical(rename_columns(stored))
    return named.groupBy("api_well_id", "formation_type").agg(
        *[F.round(F.avg(c), 6).alias(c) for c in ("clay_content_percent", "rop", "fluid_loss_api", "mud_ph")])


def yes_no_map(spark, folder):
    answer = pick(F.col("l_partkey") % 3, "Yes", "No", "Maybe")
    return table(spark, folder, "lineitem").withColumn("controllable", yes_no(answer)).groupBy("controllable").agg(
        F.count(F.lit(1)).alias("n_rows"))


def contract_cast(spark, folder):
    from pyspark.sql.types import StructType
    schema = StructType.fromDDL("well_id bigint, mud_ph decimal(3,1), mud_weight_in decimal(4,2), depth_measured decimal(6,2), "
                                "density_perforation int, fractures_presence boolean")
    typed = enforce_schema(telemetry(spark, folder), schema)
    return typed.groupBy("well_id", "fractures_presence").agg(
        F.sum("mud_ph").cast("double").alias("sum_ph"), F.sum("mud_weight_in").cast("double").alias("sum_weight"),
        F.count("depth_measured").alias("n_depth"), F.sum("density_perforation").alias("sum_density"))


def contract_null_counts(spark, folder):
    return contract_nulls(with_gaps(spark, folder), [*MEASURES, "l_returnflag", "l_linestatus", "l_comment"])


def head_per_key(spark, folder):
    li = table(spark, folder, "lineitem")
    return first_rows_per_key(li, ["l_suppkey"], ["l_shipdate", "l_orderkey", "l_partkey", "l_linenumber"], 5).select(
        "l_suppkey", "l_shipdate", "l_orderkey", "l_partkey", "l_linenumber")


def head_of_table(spark, folder):
    """The first rows in key order, as for an analysis of a sample."""
    li = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")
    return li.orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").limit(1000)


def json_encode_publish(spark, folder):
    return encode_records(table(spark, folder, "events"), "event_id", ["event_id", "user_id", "event_type"])


def null_counts(spark, folder):
    return null_profile(with_gaps(spark, folder)).withColumn("missing_percent", F.round("missing_percent", 6))


def null_percent_ranked(spark, folder):
    return missing_ranked(with_gaps(spark, folder), threshold=4.5).withColumn("missing_percent", F.round("missing_percent", 6))


def null_total(spark, folder):
    return total_missing(with_gaps(spark, folder))


def _filled(filled):
    return filled.groupBy("l_linestatus").agg(
        *[F.round(F.sum(c), 3).alias(f"sum_{c}") for c in MEASURES],
        *[F.count(c).alias(f"n_{c}") for c in [*MEASURES, "l_returnflag"]],
        F.count_if(F.col("l_returnflag") == "A").alias("n_a"))


def _imputed(spark, folder, strategy, custom=None):
    return _filled(handle_missing(with_gaps(spark, folder), strategy, custom)[0])


def impute_median(spark, folder):
    return _imputed(spark, folder, "median")


def impute_mean(spark, folder):
    return _imputed(spark, folder, "mean")


def impute_custom(spark, folder):
    return _imputed(spark, folder, "median", {"l_discount": "mean", "l_quantity": "knn", "l_linestatus": "mode"})


def impute_history(spark, folder):
    return handle_missing(with_gaps(spark, folder), "median", {"l_discount": "mean"})[1].drop("step")


def modes(spark, folder):
    return most_frequent(with_gaps(spark, folder), ["l_returnflag", "l_linestatus"])


def dedup_rows(spark, folder):
    rows = remove_duplicates(with_gaps(spark, folder).select("l_suppkey", "l_linenumber", "l_returnflag", "l_discount"))
    return rows.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n_rows"), F.count("l_discount").alias("n_discount"),
                                         F.round(F.sum("l_discount"), 4).alias("sum_discount"))


def dedup_count(spark, folder):
    return duplicate_count(with_gaps(spark, folder).select("l_suppkey", "l_linenumber", "l_returnflag", "l_discount"))


def dropna_subset(spark, folder):
    rows = drop_incomplete(nan_to_null(with_gaps(spark, folder)), MEASURES)
    return rows.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.sum("l_extendedprice"), 2).alias("price"))


def known_unknown_split(spark, folder):
    known, unknown = split_known(with_gaps(spark, folder), "l_returnflag")
    both = known.withColumn("part", F.lit("known")).unionByName(unknown.withColumn("part", F.lit("unknown")))
    return both.groupBy("part", "l_linestatus").agg(F.count(F.lit(1)).alias("n_rows"))


QUERIES = {f.__name__: f for f in (
    scan_count, sql_count, file_lineage, folder_check, csv_round_trip, structure_report, feature_columns, alias_rename, yes_no_map, contract_cast, contract_null_counts, head_per_key, head_of_table,
    json_encode_publish, null_counts, null_percent_ranked, null_total, impute_median, impute_mean, impute_custom,
    impute_history, modes, dedup_rows, dedup_count, dropna_subset, known_unknown_split)}

_COLUMNS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
            "l_returnflag", "l_linestatus"]
_PROFILE = over(GAPS) + ", profile AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS n_missing, count(*) AS n_rows, "
    f"ROUND((count(*) - count({c})) * 100e0 / count(*), 6) AS missing_percent FROM gaps" for c in _COLUMNS) + ")"


def _fill_sql(quantity: str, price: str, discount: str) -> str:
    return over(GAPS) + f"""
, facts AS (SELECT {quantity} AS q, {price} AS p, {discount} AS d FROM gaps)
, mode AS (SELECT l_returnflag AS m FROM gaps WHERE l_returnflag IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
SELECT l_linestatus, ROUND(SUM(COALESCE(l_quantity, q)), 3) AS sum_l_quantity,
  ROUND(SUM(COALESCE(l_extendedprice, p)), 3) AS sum_l_extendedprice,
  ROUND(SUM(COALESCE(l_discount, d)), 3) AS sum_l_discount,
  count(*) AS n_l_quantity, count(*) AS n_l_extendedprice, count(*) AS n_l_discount, count(*) AS n_l_returnflag,
  count(*) FILTER (WHERE COALESCE(l_returnflag, m) = 'A') AS n_a
FROM gaps, facts, mode GROUP BY l_linestatus"""


def _median(c: str) -> str:
    return f"quantile_cont({c}, 0.5)"


SQL = {
    "scan_count": "SELECT count(*) AS n_rows FROM lineitem",
    "sql_count": over(TELEMETRY) + """SELECT well_id, count(*) AS n_rows, min(depth_measured) AS top, max(depth_measured) AS bottom
FROM tel GROUP BY 1""",
    "csv_round_trip": """SELECT event_type, count(*) AS n_rows, CAST(sum(user_id) AS BIGINT) AS users, ROUND(sum(value), 3) AS total,
  max(ts) AS last FROM events GROUP BY 1""",
    "structure_report": """SELECT *, false AS valid, 'columns not found: Temperature_C' AS message FROM (
SELECT 'Temperature_C' AS "column", 'number' AS expected, false AS present, CAST(NULL AS VARCHAR) AS found, false AS fits, CAST(NULL AS BIGINT) AS n_known
UNION ALL SELECT 'Pressure_psi', 'number', true, 'double', true, count(o_totalprice) FROM orders
UNION ALL SELECT 'Formation', 'text', true, 'string', true, count(o_orderpriority) FROM orders
UNION ALL SELECT 'o_orderstatus', 'number', true, 'string', false, count(o_orderstatus) FROM orders)""",
    "feature_columns": " UNION ALL ".join(
        f"SELECT '{part}' AS part, '{c}' AS \"column\", count(*) AS n_rows, count(*) - count({c}) AS n_missing FROM orders"
        for part, c in (("features", "o_custkey"), ("features", "o_totalprice"), ("features", "o_orderpriority"), ("label", "o_orderstatus"))),
    "folder_check": """SELECT l_returnflag AS well, count(*) AS n_rows, CAST(NULL AS VARCHAR) AS reason, count(*) AS n_read,
  ROUND(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY 1
UNION ALL SELECT 'short', count(*), 'missing columns', 0, NULL FROM orders UNION ALL SELECT 'broken', 0, 'unreadable', 0, NULL""",
    "file_lineage": "SELECT 'lineitem.parquet' AS source_file, 2 * count(*) AS n_rows FROM lineitem",
    "alias_rename": over(TELEMETRY) + """SELECT well_id AS api_well_id, formation_type,
  ROUND(avg(clay_content_percent), 6) AS clay_content_percent, ROUND(avg(rop), 6) AS rop,
  ROUND(avg(fluid_loss_api), 6) AS fluid_loss_api, ROUND(avg(mud_ph), 6) AS mud_ph FROM tel GROUP BY 1, 2""",
    "yes_no_map": """SELECT CASE l_partkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS controllable, count(*) AS n_rows
FROM lineitem GROUP BY 1""",
    "contract_cast": over(TELEMETRY) + """SELECT well_id, CAST(fractures_presence AS BOOLEAN) AS fractures_presence,
  CAST(SUM(TRY_CAST(mud_ph AS DECIMAL(3,1))) AS DOUBLE) AS sum_ph,
  CAST(SUM(TRY_CAST(mud_weight_in AS DECIMAL(4,2))) AS DOUBLE) AS sum_weight,
  count(TRY_CAST(depth_measured AS DECIMAL(6,2))) AS n_depth,
  CAST(SUM(CAST(density_perforation AS INTEGER)) AS BIGINT) AS sum_density FROM tel GROUP BY 1, 2""",
    "contract_null_counts": over(GAPS) + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", true AS present, count(*) - count({c}) AS n_missing FROM gaps"
        for c in [*MEASURES, "l_returnflag", "l_linestatus"])
        + " UNION ALL SELECT 'l_comment', false, count(*) FROM gaps",
    "head_per_key": """SELECT l_suppkey, l_shipdate, l_orderkey, l_partkey, l_linenumber FROM (SELECT *, row_number() OVER (
  PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_partkey, l_linenumber) AS rn FROM lineitem) WHERE rn <= 5""",
    "head_of_table": """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity FROM lineitem
ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 1000""",
    "json_encode_publish": """SELECT CAST(event_id AS VARCHAR) AS key,
  CAST(to_json({'event_id': event_id, 'user_id': user_id, 'event_type': event_type}) AS VARCHAR) AS value FROM events""",
    "null_counts": _PROFILE + " SELECT * FROM profile",
    "null_percent_ranked": _PROFILE + """ SELECT *, (n_missing * 100e0 / n_rows > 4.5) AS over_threshold FROM profile
WHERE n_missing > 0 ORDER BY missing_percent DESC, "column" """,
    "null_total": _PROFILE + " SELECT CAST(sum(n_missing) AS BIGINT) AS total_missing FROM profile",
    "impute_median": _fill_sql(_median("l_quantity"), _median("l_extendedprice"), _median("l_discount")),
    "impute_mean": _fill_sql("avg(l_quantity)", "avg(l_extendedprice)", "avg(l_discount)"),
    "impute_custom": _fill_sql("avg(l_quantity)", _median("l_extendedprice"), "avg(l_discount)"),
    "impute_history": over(GAPS) + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", '{s}' AS strategy, count(*) - count({c}) AS n_filled FROM gaps" for c, s in (
            ("l_orderkey", "median"), ("l_partkey", "median"), ("l_suppkey", "median"), ("l_linenumber", "median"),
            ("l_quantity", "median"), ("l_extendedprice", "median"), ("l_discount", "mean"), ("l_returnflag", "mode"))),
    "modes": over(GAPS) + " UNION ALL ".join(
        f"SELECT * FROM (SELECT '{c}' AS \"column\", {c} AS value, count(*) AS n FROM gaps WHERE {c} IS NOT NULL "
        f"GROUP BY {c} ORDER BY n DESC, value LIMIT 1)" for c in ("l_returnflag", "l_linestatus")),
    "dedup_rows": over(GAPS) + """SELECT l_suppkey, count(*) AS n_rows, count(l_discount) AS n_discount,
  ROUND(sum(l_discount), 4) AS sum_discount
FROM (SELECT DISTINCT l_suppkey, l_linenumber, l_returnflag, l_discount FROM gaps) GROUP BY 1""",
    "dedup_count": over(GAPS) + """SELECT (SELECT count(*) FROM gaps) AS n_before, count(*) AS n_after,
  (SELECT count(*) FROM gaps) - count(*) AS n_removed
FROM (SELECT DISTINCT l_suppkey, l_linenumber, l_returnflag, l_discount FROM gaps)""",
    "dropna_subset": over(GAPS) + """SELECT l_suppkey, count(*) AS n_rows, ROUND(sum(l_extendedprice), 2) AS price FROM gaps
WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL AND l_discount IS NOT NULL GROUP BY 1""",
    "known_unknown_split": over(GAPS) + """SELECT CASE WHEN l_returnflag IS NULL THEN 'unknown' ELSE 'known' END AS part,
  l_linestatus, count(*) AS n_rows FROM gaps GROUP BY 1, 2""",
}
