"""Rule sets as rows with a client and a date from which they hold, so one plan serves clients with different rules.

Rows: ``client, valid_from, rule, rule_key, rule_value``, the last three as ``rules.rule_table`` writes them.
A version of a client's rules is all its rows with one ``valid_from``; the client ``*`` serves clients without own
rules.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.functions.text import text_or
from sightline.rules import CONSEQUENCES, LIKELIHOODS, STATUSES

ANY_CLIENT = "*"


def rules_of_runs(runs: DataFrame, versions: DataFrame) -> DataFrame:
    """(run_id, valid_from, rule, rule_key, rule_value): the rules that hold for each run.

    ``runs`` holds ``run_id, client, run_date``.  A run takes the latest version of its client that is not later than
    its date, else that of the client ``*``; a run before every version has no rules.  Only the few distinct versions
    are compared with runs, and the rules follow by an equality join.
    """
    known = versions.select("client", "valid_from").distinct().withColumnRenamed("client", "of_client")
    own = (F.col("of_client") == F.col("client")) | (F.col("of_client") == ANY_CLIENT)
    # the range condition is tested on rows that already agree on the client
    candidates = runs.withColumn("of_client", F.explode(F.array(F.col("client"), F.lit(ANY_CLIENT)))).join(known, "of_client").filter(
        own & (F.col("valid_from") <= F.col("run_date"))
    )
    picked = candidates.groupBy("run_id").agg(
        F.max(F.struct((F.col("of_client") != ANY_CLIENT).alias("own"), "valid_from", "of_client")).alias("v")
    ).select("run_id", F.col("v.of_client").alias("client"), F.col("v.valid_from").alias("valid_from"))
    return picked.join(versions, ["client", "valid_from"]).select("run_id", "valid_from", "rule", "rule_key", "rule_value")


def _legal(spark: SparkSession) -> DataFrame:
    """What a rule may say: rows (rule, rule_key, rule_value), with null where anything goes."""
    rows = [("include_status", s, "INCLUDED") for s in STATUSES if s != "UNKNOWN"]
    rows += [("severity", None, v) for v in LIKELIHOODS] + [("high_if_category", None, "High"), ("ref_prefix", None, None)]
    rows += [("risk_matrix", f"{a}_{b}", None) for a in LIKELIHOODS for b in CONSEQUENCES]
    rows += [("include_criticality", None, "INCLUDED"), ("criticality_severity", None, None), ("control_service", None, None)]
    return spark.createDataFrame(rows, "rule string, legal_key string, legal_value string")


def invalid_rules(versions: DataFrame) -> DataFrame:
    """Rule rows outside their domain: an unknown kind, status, likelihood or matrix key."""
    legal = _legal(versions.sparkSession)
    fits = (
        (F.col("v.rule") == F.col("l.rule"))
        & (F.col("legal_key").isNull() | (F.col("legal_key") == F.col("rule_key")))
        & (F.col("legal_value").isNull() | (F.col("legal_value") == F.col("rule_value")))
    )
    return versions.alias("v").join(legal.alias("l"), fits, "left_anti")


def status_by_rules(findings: DataFrame, rules: DataFrame) -> DataFrame:
    """Add ``included``: whether the run's rules list the finding's status."""
    listed = rules.filter("rule = 'include_status'").select("run_id", F.col("rule_key").alias("scanner_status"), F.lit(True).alias("_in"))
    return findings.join(listed, ["run_id", "scanner_status"], "left").withColumn("included", F.coalesce("_in", F.lit(False))).drop("_in")


def likelihood_by_rules(groups: DataFrame, rules: DataFrame) -> DataFrame:
    """Add ``likelihood_by_rules``: High for a category of the run's rules, else by severity, else Medium."""
    severity = rules.filter("rule = 'severity'").select("run_id", F.lower("rule_key").alias("_severity"), F.col("rule_value").alias("_base"))
    listed = rules.filter("rule = 'high_if_category'").groupBy("run_id").agg(F.collect_set("rule_key").alias("_high"))
    own = groups.withColumn("_severity", text_or(F.lower("raw_severity"), ""))
    rated = own.join(severity, ["run_id", "_severity"], "left").join(listed, "run_id", "left")
    forced = F.coalesce(F.arrays_overlap("categories_list", "_high"), F.lit(False))
    return rated.withColumn("likelihood_by_rules", F.when(forced, "High").otherwise(F.coalesce("_base", F.lit("Medium")))).drop("_severity", "_base", "_high")
