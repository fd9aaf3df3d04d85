"""Writing results: partitioned by client and run so that one run is read alone."""

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline.functions.text import client_slug
from sightline.rules import Rules
from sightline.schemas import AUDIT
from sightline.session import path_exists


def write_table(df: DataFrame, path: str, rules: Rules = Rules(), mode: str = "append", fmt: str = "parquet") -> None:
    """Write a result table under ``client_key=…/run_id=…``.

    The key is the client's slug with a digest of the whole name: slugs are cut and may be equal.
    """
    name = F.lit(rules.client_name)
    digest = F.left(F.sha2(F.coalesce(name, F.lit("")), 256), F.lit(12))
    tagged = df.withColumns({"client_slug": client_slug(name), "client_key": F.concat_ws("-", client_slug(name), digest)})
    tagged.write.mode(mode).format(fmt).partitionBy("client_key", "run_id").save(path)


def write_report_csv(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Report rows as CSV, one folder per run, in report order inside a run.

    Rows are range-partitioned by their order, so a run may span several files
    but reads in order.
    """
    order = [c for c in ("run_id", "sheet_order", "section_order", "ref_number", "part_no") if c in rows.columns]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered.write.mode(mode).option("header", True).option("quoteAll", True).option("escape", '"').partitionBy(
        "run_id"
    ).csv(path)


def write_text(reports: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Narrative blocks as text files, one folder per run."""
    ordered = reports.repartitionByRange("run_id", "group_no").sortWithinPartitions("run_id", "group_no")
    ordered.select("run_id", F.concat("text", F.lit("\n")).alias("value")).write.mode(mode).partitionBy("run_id").text(path)


def approvals_json(members: DataFrame) -> DataFrame:
    """Approved groups as approval payloads, one JSON text per run; runs without groups have none."""
    group = members.groupBy("run_id", "group_no", "group_name", "rationale").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "member_key"))), lambda s: s["member_key"]).alias("check_ids"),
        F.coalesce(F.max("risk_rating_override"), F.lit("")).alias("risk_rating_override"),
    )
    payload = F.struct(
        "group_no", "group_name", "check_ids", "rationale", F.lit("").alias("analyst_note"), "risk_rating_override"
    )
    return group.groupBy("run_id").agg(F.array_sort(F.collect_list(payload)).alias("groups")).select(
        "run_id", F.to_json(F.struct("run_id", "groups")).alias("payload")
    )


# --- audit events of all stages -----------------------------------------------------------------

#: Steps that write audit events, in the order in which they happen to a finding.
STEPS = ("findings", "groups", "grouping", "review", "enrichment")


def write_events(events: DataFrame, path: str, step: str, runs: DataFrame | None = None) -> None:
    """Write the audit events of one step; a step that is run again replaces what it wrote.

    Events lie in a partition for each run and step.  A write replaces the
    partitions of its own runs and step and touches no other, so it may be
    repeated after a failure.  ``runs`` (``run_id``) are the runs the step has
    processed: a run without events then replaces its partition by an empty
    marker row, which :func:`read_events` leaves out.
    """
    if step not in STEPS:
        raise ValueError(f"step must be one of {STEPS}")
    rows = events.select(*AUDIT.names)
    if runs is not None:
        blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in AUDIT.fields if f.name != "run_id"]
        rows = rows.unionByName(runs.select("run_id").distinct().select("run_id", *blank))
    # ids are digests in hexadecimal: zstd stores one in half its characters
    dated = rows.withColumn("step", F.lit(step)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    dated.partitionBy("run_id", "step").option("compression", "zstd").parquet(path)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """All events, with the place of each in the history of its finding (``event_no``, from 1)."""
    schema = T.StructType([*(f for f in AUDIT.fields if f.name != "run_id"), AUDIT["run_id"], T.StructField("step", T.StringType())])
    found = spark.read.schema(schema).parquet(path).filter("finding_instance_id IS NOT NULL")
    step_no = F.array_position(F.array(*[F.lit(s) for s in STEPS]), F.col("step"))
    # a digest in hexadecimal is shuffled as its bytes, any other id as it is
    name = F.col("finding_instance_id")
    digest = F.when(name.rlike(r"\A[0-9a-f]{64}\z"), F.unhex(name))
    dealt = found.withColumns({"_digest": digest, "_other": F.when(digest.isNull(), name)}).drop("finding_instance_id")
    history = Window.partitionBy("run_id", "_digest", "_other").orderBy("stage_no", step_no, "seq")
    numbered = dealt.withColumn("event_no", F.row_number().over(history)).withColumn(
        "finding_instance_id", F.coalesce(F.lower(F.hex("_digest")), "_other")
    )
    return numbered.select(*AUDIT.names, "step", "event_no")


# --- versioned tables -----------------------------------------------------------------------------


def append_version(rows: DataFrame, path: str) -> None:
    """Append a new version of each run in ``rows``; earlier versions stay.

    Each write has a folder of its own, so two writers never touch the same
    files.  A run's version is one more than the last one that the writer
    saw; if two writers take the same number, readers choose between them by
    the name of the write, all in the same way, and never mix their rows.
    """
    spark = rows.sparkSession
    if path_exists(spark, path):
        last = _written(spark, path, rows.schema).groupBy("run_id").agg(F.max("version").alias("_last"))
        rows = rows.join(last, "run_id", "left").withColumn("version", F.coalesce("_last", F.lit(0)) + 1).drop("_last")
    else:
        rows = rows.withColumn("version", F.lit(1))
    rows.withColumn("version", F.col("version").cast("int")).write.parquet(f"{path.rstrip('/')}/write={uuid.uuid4().hex}")


def _written(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    fields = [*(f for f in schema.fields if f.name not in ("version", "write")), T.StructField("version", T.IntegerType())]
    return spark.read.schema(T.StructType([*fields, T.StructField("write", T.StringType())])).parquet(path)


def latest_version(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows of the last version of each run, with ``version``."""
    found = _written(spark, path, schema)
    last = found.groupBy("run_id").agg(F.max(F.struct("version", "write")).alias("_last"))
    return found.join(last, "run_id").filter(F.struct("version", "write") == F.col("_last")).drop("_last", "write")
