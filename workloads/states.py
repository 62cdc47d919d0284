"""The derived tables once more, as SQL text for the comparison engine."""

TELEMETRY = """
tel AS (
  SELECT l_orderkey AS order_id, l_partkey AS part_id, l_linenumber AS line_id, l_suppkey AS well_id,
    l_shipdate AS datetime, l_orderkey % 300 AS days_age_well,
    CASE WHEN l_orderkey % 300 < 100 THEN 'Drilling' WHEN l_orderkey % 300 < 200 THEN 'Completion' ELSE 'Production' END AS phase_operation,
    CASE l_partkey % 4 WHEN 0 THEN 'Shale' WHEN 1 THEN 'Limestone' WHEN 2 THEN 'Sandstone' ELSE 'Salt' END AS formation_type,
    CASE l_orderkey % 3 WHEN 0 THEN 'Kaolinite' WHEN 1 THEN 'Illite' ELSE 'Montmorillonite' END AS clay_mineralogy_type,
    CASE (l_orderkey + l_linenumber) % 3 WHEN 0 THEN 'Water-based' WHEN 1 THEN 'Oil-based' ELSE 'Synthetic' END AS mud_type,
    CASE l_partkey % 3 WHEN 0 THEN 'Cased' WHEN 1 THEN 'Open Hole' ELSE 'Liner' END AS completion_type,
    CASE l_linenumber % 3 WHEN 0 THEN 'Acidic' WHEN 1 THEN 'BASIC' ELSE 'acidic' END AS fluid_type,
    CAST(l_orderkey % 2 AS INTEGER) AS fractures_presence,
    50e0 + l_quantity * 1.8e0 AS reservoir_temperature,
    CAST(l_partkey % 150 AS DOUBLE) AS formation_permeability,
    CAST(l_partkey % 63 + 5 AS DOUBLE) AS clay_content_percent,
    CAST(l_orderkey % 30 AS DOUBLE) AS density_perforation,
    l_extendedprice / 25e0 AS depth_measured,
    l_extendedprice / 25e0 + 2e0 - l_discount * 50e0 AS depth_bit,
    CAST(l_partkey % 70 * 100 AS DOUBLE) AS weight_on_bit,
    l_discount * 400e0 AS rop,
    l_quantity * 1.6e0 AS viscosity,
    CAST(l_linenumber + 4 AS DOUBLE) AS mud_ph,
    7e0 + l_tax * 50e0 AS mud_weight_in,
    CAST(l_partkey % 100 + 80 AS DOUBLE) AS in_rate_flow_mud,
    CAST(l_orderkey % 1000 + 2500 AS DOUBLE) AS pressure_standpipe,
    CAST(l_partkey % 800 + 2300 AS DOUBLE) AS pressure_annulus,
    CAST(l_orderkey % 4000 + 2000 AS DOUBLE) AS pressure_reservoir,
    CAST(l_orderkey % 700 AS DOUBLE) AS overbalance,
    CAST(l_orderkey % 45 AS DOUBLE) / 10e0 AS fluid_loss_api,
    CAST(l_partkey % 1500 AS DOUBLE) AS chloride_content,
    CAST(l_linenumber AS DOUBLE) * 2.5e0 AS solid_content,
    CAST(l_partkey % 30 + 5 AS DOUBLE) AS porosity_formation,
    l_linenumber = 7 AS is_horizontal,
    (l_partkey % 4 = 3 AND l_orderkey % 2 = 0) AS is_seal,
    (l_partkey % 4 IN (1, 2) AND l_orderkey % 5 = 0) AS is_reservoir,
    CAST(l_suppkey % 20 * 100 + 3000 AS DOUBLE) AS total_depth
  FROM lineitem
)"""

GAPS = """
gaps AS (
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
    CASE WHEN (l_orderkey * 7 + l_partkey) % 20 = 0 THEN NULL ELSE l_quantity END AS l_quantity,
    CASE WHEN (l_orderkey + l_partkey * 3) % 25 < 2 THEN NULL ELSE l_extendedprice END AS l_extendedprice,
    CASE WHEN (l_orderkey * 5 + l_linenumber) % 30 = 0 THEN NULL ELSE l_discount END AS l_discount,
    CASE WHEN (l_orderkey + l_linenumber) % 40 = 0 THEN NULL ELSE l_returnflag END AS l_returnflag,
    l_linestatus
  FROM lineitem
)"""

LAYERS = """
layers AS (
  SELECT s_suppkey AS well_id, CAST(i AS INTEGER) AS layer_id,
    CASE WHEN i = 0 THEN 0e0 ELSE CAST(i * 450 + s_suppkey % 7 * 10 AS DOUBLE) END AS top,
    CAST((i + 1) * 450 + s_suppkey % 7 * 10 AS DOUBLE) AS bottom,
    CASE (i + s_suppkey % 3) % 8 WHEN 0 THEN 'Topsoil' WHEN 1 THEN 'Weathered_Rock' WHEN 2 THEN 'Sandstone' WHEN 3 THEN 'Shale'
      WHEN 4 THEN 'Limestone' WHEN 5 THEN 'Shale' WHEN 6 THEN 'Salt' ELSE 'Sandstone' END AS formation,
    ((i = 7 AND s_suppkey % 4 <> 0) OR (i = 4 AND s_suppkey % 5 = 0)) AS reservoir
  FROM supplier, generate_series(0, 7) AS g(i)
)"""

STEPS = """
steps AS (
  SELECT *, CASE event_type WHEN 'view' THEN 'Shale' WHEN 'click' THEN 'Sandstone' WHEN 'error' THEN 'Limestone'
    WHEN 'signup' THEN 'Topsoil' WHEN 'purchase' THEN 'Salt' END AS formation
  FROM events
)"""


def over(*tables: str) -> str:
    return "WITH " + ",".join(tables) + "\n"
