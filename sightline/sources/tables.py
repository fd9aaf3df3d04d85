"""Findings and control views over warehouse tables (orders, parts, suppliers …).

The row number of a finding is its place in the line-item files, as the row
number of an export is; nothing is sorted to obtain it.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sightline.session import materialise

# {name} is a table; ``lineitem`` also has ``row_no`` and ``row_seq``.
_FINDINGS_COLUMNS = """
SELECT r_name AS run_id, 'tables' AS source_file, 'none' AS source_file_hash, 'lineitem' AS sheet_name,
  row_no, row_seq,
  CASE n_nationkey % 4 WHEN 0 THEN 'aws' WHEN 1 THEN 'Azure' WHEN 2 THEN 'gcp' END AS raw_provider,
  cast(n_nationkey AS STRING) AS raw_account_uid,
  'Acme ' || n_name AS raw_account_name,
  'env:' || lower(r_name) AS raw_account_tags,
  replace(p_name, ' ', '_') AS raw_check_id,
  CASE WHEN p_size % 11 = 0 THEN NULL ELSE p_brand || ' ' || p_name END AS raw_check_title,
  p_type AS raw_check_type,
  CASE WHEN l_quantity = 1 THEN 'MANUAL' WHEN l_quantity = 2 THEN 'MUTED(BOGUS)' WHEN l_quantity = 3 THEN 'weird'
    WHEN l_returnflag = 'R' THEN 'FAIL' WHEN l_returnflag = 'A' THEN 'MUTED(FAIL)' WHEN l_returnflag = 'N' THEN 'PASS'
  END AS raw_status,
  CASE WHEN l_linestatus = 'O' THEN NULL ELSE 'line ' || cast(l_linenumber AS STRING) END AS raw_status_extended,
  CASE WHEN l_linenumber % 7 = 0 THEN 'True' ELSE 'False' END AS raw_muted,
  CASE WHEN p_type = 'PROMO' THEN 'iam' ELSE split_part(p_name, ' ', 2) END AS raw_service_name,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'critical' WHEN '2' THEN 'High' WHEN '3' THEN 'medium'
    WHEN '5' THEN 'low' END AS raw_severity,
  p_type AS raw_resource_type,
  CASE l_suppkey % 3 WHEN 0 THEN 'arn:aws:s3:::b' || cast(l_suppkey AS STRING) || '/'
    WHEN 1 THEN 'b' || cast(l_suppkey AS STRING) END AS raw_resource_uid,
  CASE WHEN l_suppkey % 6 = 5 THEN NULL ELSE 'res-' || cast(l_suppkey AS STRING) END AS raw_resource_name,
  'Owner:' || cast(l_suppkey AS STRING) || ' | Arn:a:b | Bare | Owner:last' AS raw_resource_tags,
  CASE WHEN n_nationkey % 7 = 0 THEN NULL ELSE lower(n_name) END AS raw_region,
  CASE WHEN p_size < 10 THEN NULL ELSE p_brand END AS raw_description,
  CASE WHEN l_tax = 0 THEN NULL ELSE p_type END AS raw_risk,
  CASE WHEN l_discount = 0 THEN NULL ELSE p_name END AS raw_remediation_recommendation_text,
  CASE WHEN p_size % 3 = 0 THEN 'fix ' || p_name END AS raw_remediation_code_cli,
  CASE WHEN p_size % 4 = 0 THEN '-set ' || p_brand END AS raw_remediation_code_terraform,
  CASE WHEN l_linenumber = 3 THEN ' | ' ELSE 'CIS-2.0 | ' || cast(p_size AS STRING) END AS raw_compliance,
  lower(p_type) || CASE WHEN p_brand LIKE '%3' THEN ' | internet-exposed' ELSE '' END AS raw_categories,
  CASE WHEN l_linenumber > 1 THEN '4.' || cast(l_linenumber AS STRING) END AS raw_prowler_version
"""
_FINDINGS_FROM = """FROM {lineitem}
JOIN {orders} ON l_orderkey = o_orderkey
JOIN {customer} ON o_custkey = c_custkey
JOIN {nation} ON c_nationkey = n_nationkey
JOIN {region} ON n_regionkey = r_regionkey
JOIN {part} ON l_partkey = p_partkey
"""
FINDINGS_SQL = _FINDINGS_COLUMNS + _FINDINGS_FROM

CONTROLS_SQL = """
SELECT r_name AS run_id, 'tables' AS source_file, 'none' AS source_file_hash, 'lineitem' AS sheet_name,
  row_no, row_seq,
  CASE WHEN n_nationkey % 6 = 0 THEN ' ' ELSE 'tenant-' || cast(n_nationkey AS STRING) END AS tenant_id,
  CASE WHEN l_quantity = 7 THEN 'N/A' ELSE 'MS.' || CASE p_partkey % 5 WHEN 0 THEN 'AAD' WHEN 1 THEN 'Defender'
    WHEN 2 THEN 'EXCHANGE' WHEN 3 THEN 'TEAMS' ELSE 'FOO' END || '.' || cast(p_size AS STRING) || '.'
    || cast(p_partkey % 3 + 1 AS STRING) || 'v1' END AS raw_control_id,
  ' <b>' || p_name || '</b> &amp; <i title="a>b">more</i><div class="policy-indicators"><a href="#x">' || p_brand
    || '</a></div>' AS raw_requirement,
  CASE l_returnflag WHEN 'R' THEN 'Fail' WHEN 'A' THEN ' pass ' ELSE 'N/A' END AS raw_result,
  CASE p_type WHEN 'PROMO' THEN 'Shall' WHEN 'ECONOMY' THEN 'Should' WHEN 'SMALL' THEN 'Shall/3rd Party'
    WHEN 'MEDIUM' THEN 'May' WHEN 'LARGE' THEN 'Shall/Not Implemented' WHEN 'STANDARD' THEN 'shall-custom'
    ELSE '' END AS raw_criticality,
  CASE l_linenumber % 3 WHEN 0 THEN cast(cast(l_quantity AS INT) AS STRING) || ' role(s) that contain users'
    WHEN 1 THEN '3 conditional access policy(s) found' ELSE 'System.Object[]' END AS raw_details,
  CASE WHEN l_linenumber = 2 THEN 'Pass' ELSE 'N/A' END AS raw_original_result
FROM {lineitem}
JOIN {supplier} ON l_suppkey = s_suppkey
JOIN {nation} ON s_nationkey = n_nationkey
JOIN {region} ON n_regionkey = r_regionkey
JOIN {part} ON l_partkey = p_partkey
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered_table(spark: SparkSession, sf_dir: str, name: str, spread: bool = True) -> DataFrame:
    """A table with ``row_no`` and ``row_seq``: place over its files in name order, first row = 2.

    A table of several files is counted per file first, which reads no column;
    the counts are one row per file and are joined by their written size.
    """
    df = table(spark, sf_dir, name)
    row = df.select("*", (F.col("_metadata.row_index") + 2).alias("row_no"), F.col("_metadata.file_path").alias("_path"))
    if len(df.inputFiles()) > 1:
        earlier = Window.orderBy("_path").rowsBetween(Window.unboundedPreceding, -1)
        counts = row.groupBy("_path").agg(F.count(F.lit(1)).alias("_n"))
        offsets = materialise(
            counts.select("_path", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset")), "table-files"
        )
        row = row.join(offsets, "_path").withColumn("row_no", F.col("row_no") + F.col("_offset")).drop("_offset")
    numbered = row.drop("_path").withColumn("row_seq", F.col("row_no"))
    cores = spark.sparkContext.defaultParallelism
    # Fewer scan tasks than cores: spread the rows once.  Never so for a large table, or where a shuffle follows anyway.
    return numbered.repartition(cores, "row_no") if spread and df.rdd.getNumPartitions() < cores else numbered


def _view(spark: SparkSession, sf_dir: str, sql: str, *names: str) -> DataFrame:
    tables = {n: table(spark, sf_dir, n) for n in names}
    return spark.sql(sql, lineitem=numbered_table(spark, sf_dir, "lineitem"), **tables)


def findings_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw resource findings, one per line item; the runs are regions."""
    return _view(spark, sf_dir, FINDINGS_SQL, "orders", "customer", "nation", "region", "part")


#: Columns of parts that findings are made of.
_PART_COLUMNS = ("p_name", "p_size", "p_brand", "p_type")
#: Of these columns findings only ask for a few values: each has a number from 1, any other value and null have 0.
_LINE_MARKS = {"l_quantity": (1, 2, 3), "l_returnflag": ("R", "A", "N"), "l_linestatus": ("O",), "l_discount": (0,), "l_tax": (0,)}
_ORDER_MARKS = {"o_orderpriority": ("1", "2", "3", "5")}  # by its first character


_BITS = 3  # of each such number


def _packed(marks: dict[str, tuple], value=F.col) -> Column:
    """The numbers of all columns in ``marks`` as one integer."""
    packed = F.lit(0)
    for place, (column, values) in enumerate(marks.items()):
        number = F.lit(0)
        for n, v in enumerate(values, 1):
            number = F.when(value(column) == F.lit(v), n).otherwise(number)
        packed = packed + F.shiftleft(number, _BITS * place)
    return packed


def _unpacked(marks: dict[str, tuple], packed: str) -> dict[str, Column]:
    """The columns of :func:`_packed` again; a value that findings do not ask for is null."""
    number = lambda place: F.shiftright(packed, _BITS * place).bitwiseAND(F.lit((1 << _BITS) - 1))
    return {c: F.try_element_at(F.array(*[F.lit(v) for v in (None, *values)]), number(p) + F.lit(1)) for p, (c, values) in enumerate(marks.items())}


def findings_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What findings are made of, one narrow row per line item.

    Line items are joined to their orders, customers and parts here; the texts of a finding follow by
    :func:`findings_of`.  What is shuffled are keys and small numbers.
    """
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", _packed(_ORDER_MARKS, lambda c: F.substr(F.col(c), F.lit(1), F.lit(1))).alias("o_marks")
    )
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    parts = table(spark, sf_dir, "part").select("p_partkey", *_PART_COLUMNS)
    asked = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_marks", "c_nationkey")
    lines = numbered_table(spark, sf_dir, "lineitem", spread=False).select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", _packed(_LINE_MARKS).alias("l_marks"), "row_no"
    )
    placed = lines.join(asked, F.col("l_orderkey") == F.col("o_orderkey")).drop("l_orderkey", "o_orderkey")
    return placed.join(parts, F.col("l_partkey") == F.col("p_partkey")).drop("l_partkey", "p_partkey")


def findings_of(spark: SparkSession, sf_dir: str, base: DataFrame, *more: str) -> DataFrame:
    """The rows of :func:`findings_view` made of :func:`findings_base`, and the columns ``more`` of the base.

    Only nations and regions are joined, so a reading shuffles nothing.
    """
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    regions = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    rows = base.withColumns({
        "row_seq": F.col("row_no"), **_unpacked(_LINE_MARKS, "l_marks"), **_unpacked(_ORDER_MARKS, "o_marks"),
    }).join(nations, F.col("c_nationkey") == F.col("n_nationkey")).join(regions, F.col("n_regionkey") == F.col("r_regionkey"))
    return spark.sql(", ".join([_FINDINGS_COLUMNS, *more]) + " FROM {rows}", rows=rows)


def controls_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw control findings, one per line item; the tenants are the suppliers' nations."""
    return _view(spark, sf_dir, CONTROLS_SQL, "supplier", "nation", "region", "part")
