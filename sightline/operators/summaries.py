"""Summaries of runs: sections of the ingest and process reports in one pass each, counters of all control stages."""

import uuid

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from sightline.operators.normalise import warning_list
from sightline.schemas import EXCLUDED, INCLUDED
from sightline.session import materialise

#: Rows that a report lists of fallbacks and of findings to review; it counts the rest.
LISTED_FALLBACKS, LISTED_REVIEWS = 5, 10


def _sections(rows: DataFrame, sets: dict[str, str | None], values: list[Column]) -> DataFrame:
    """One aggregation over grouping sets: ``sets`` names a section by its key column; None is the section of the whole run.

    Gives ``run_id, section, key`` and the aggregates ``values``.  ``rows`` is read once; Spark repeats each row
    for every set and aggregates before the shuffle.
    """
    keys = [c for c in sets.values() if c is not None]
    grouped = rows.groupingSets(
        [[F.col("run_id"), *([F.col(c)] if c else [])] for c in sets.values()], "run_id", *keys
    ).agg(F.grouping_id().alias("_set"), *values)
    # bits of the grouping id, from the highest: run_id, then the keys; a bit is set where the column is not grouped by
    width = len(keys)
    number = {name: (1 << width) - 1 - (1 << (width - 1 - keys.index(c)) if c else 0) for name, c in sets.items()}
    section = F.coalesce(*[F.when(F.col("_set") == n, name) for name, n in number.items()])
    key = F.coalesce(*[F.when(F.col("_set") == number[name], F.coalesce(F.col(c).cast("string"), F.lit("none"))) for name, c in sets.items() if c])
    return grouped.select("run_id", section.alias("section"), key.alias("key"), *[c for c in grouped.columns if c not in ("run_id", "_set", *keys)])


def _entries(counted: DataFrame, section: str, names: dict[str, Column]) -> DataFrame:
    """The totals of a run as rows of ``section``."""
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("key"), v.cast("long").alias("value")) for k, v in names.items()]))
    return counted.select("run_id", F.lit(section).alias("section"), pairs.alias("p")).select("run_id", "section", "p.*")


def ingest_report(findings: DataFrame) -> DataFrame:
    """(run_id, section, key, value) of the ingest report; the normalised findings are read once.

    Sections: ``rows``, ``status``, ``blanks``, ``reconciled`` (by the status that muting gave), ``fallbacks``
    and ``review`` (how many, how many a report lists, how many more there are), ``warnings`` by code.
    """
    narrow = findings.select(
        "run_id", "scanner_status", F.when(F.col("muted_reconciled"), F.col("scanner_status")).alias("reconciled"),
        *[(F.col(c) == v).alias(c) for c, v in _BLANKS.items()],
        (F.col("arn_fallback_used") & (F.col("resource_uid_normalised") != "")).alias("fallback"), "human_review_required",
        F.transform(warning_list(), lambda w: w["code"]).alias("codes"),
    )
    # a finding has one row, and one more for each warning beyond the first
    rows = narrow.select("*", F.posexplode_outer("codes").alias("place", "code"))
    first = F.coalesce("place", F.lit(0)) == 0
    count = lambda test: F.count_if(first & test)
    counted = materialise(_sections(
        rows.withColumn("reconciled", F.when(first, F.col("reconciled"))),
        {"run": None, "status": "scanner_status", "reconciled": "reconciled", "warnings": "code"},
        [count(F.lit(True)).alias("findings"), F.count(F.lit(1)).alias("entries"), *[count(F.col(c)).alias(c) for c in _BLANKS],
         count(F.col("fallback")).alias("fallbacks"), count(F.col("human_review_required")).alias("reviews")],
    ), "ingest-report")
    run = counted.filter("section = 'run'")
    keyed = counted.filter("section <> 'run' AND (key <> 'none' OR section = 'status')").select(
        "run_id", "section", "key", F.when(F.col("section") == "status", F.col("findings")).otherwise(F.col("entries")).alias("value")
    )
    listed = lambda c, n: {"total": F.col(c), "listed": F.least(c, F.lit(n)), "more": F.greatest(F.col(c) - n, F.lit(0))}
    return (
        keyed.unionByName(_entries(run, "rows", {"findings": F.col("findings")}))
        .unionByName(_entries(run, "blanks", {c.removeprefix("blank_"): F.col(c) for c in _BLANKS}))
        .unionByName(_entries(run, "fallbacks", listed("fallbacks", LISTED_FALLBACKS)))
        .unionByName(_entries(run, "review", listed("reviews", LISTED_REVIEWS)))
    )


_BLANKS = {"blank_description": "DATA_QUALITY", "blank_risk": "DATA_QUALITY", "blank_remediation": "DATA_QUALITY", "blank_region": "STRUCTURAL"}


def process_report(processed: DataFrame, groups: DataFrame) -> DataFrame:
    """(run_id, section, key, value) of the process report; processed findings and groups are read once each.

    Sections: ``counts``, ``excluded`` by reason, ``duplicates`` by check, ``groups`` by section, ``severity`` and
    ``likelihood`` of the groups, ``instances`` by section, ``review`` (groups whose representative is to be reviewed).
    """
    kept = (F.col("report_inclusion") == INCLUDED) & ~F.col("is_duplicate")
    out = (F.col("report_inclusion") == EXCLUDED) & ~F.col("is_duplicate")
    narrow = processed.select(
        "run_id", F.when(out, F.col("exclusion_reason")).alias("reason"), F.when(F.col("is_duplicate"), F.coalesce("raw_check_id", F.lit("unknown"))).alias("again"),
        kept.alias("kept"), out.alias("out"), "is_duplicate",
    )
    rows = materialise(_sections(
        narrow, {"run": None, "excluded": "reason", "duplicates": "again"},
        [F.count(F.lit(1)).alias("n"), F.count_if("kept").alias("included"), F.count_if("out").alias("excluded"), F.count_if("is_duplicate").alias("duplicates")],
    ), "process-report")
    run = rows.filter("section = 'run'")
    per_group = _sections(
        groups.select("run_id", "output_section", F.coalesce(F.lower("raw_severity"), F.lit("?")).alias("severity"), "likelihood_rating", "instance_count", "human_review_required"),
        {"run": None, "groups": "output_section", "severity": "severity", "likelihood": "likelihood_rating"},
        [F.count(F.lit(1)).alias("n"), F.sum("instance_count").alias("instances"), F.count_if("human_review_required").alias("reviews")],
    )
    per_group = materialise(per_group, "group-report")
    total = per_group.filter("section = 'run'")
    return (
        rows.filter("section <> 'run' AND key <> 'none'").select("run_id", "section", "key", F.col("n").alias("value"))
        .unionByName(per_group.filter("section <> 'run'").select("run_id", "section", "key", F.col("n").alias("value")))
        .unionByName(per_group.filter("section = 'groups'").select("run_id", F.lit("instances").alias("section"), "key", F.col("instances").alias("value")))
        .unionByName(_entries(run, "counts", {"total_findings": F.col("n"), **{c: F.col(c) for c in ("included", "excluded", "duplicates")}}))
        .unionByName(_entries(total, "counts", {"output_groups": F.col("n")}))
        .unionByName(_entries(total, "review", {"groups": F.col("reviews")}))
    )


class StageLog:
    """Counters of stages, observed while their tables are written: no table is read again for the totals."""

    def __init__(self) -> None:
        self.totals: dict[str, dict[str, int]] = {}

    def write(self, df: DataFrame, stage: str, **counters: Column) -> DataFrame:
        """Write the stage's table and keep the totals of ``counters`` over all its rows."""
        seen = Observation(f"{stage}-{uuid.uuid4().hex}")
        written = materialise(df.observe(seen, *[c.alias(name) for name, c in counters.items()]), stage)
        self.totals.setdefault(stage, {}).update({name: int(value or 0) for name, value in seen.get.items()})
        return written

    def rows(self, like: DataFrame) -> DataFrame:
        """The totals as rows (run_id null, stage, counter, value)."""
        found = [(None, stage, name, value) for stage, counters in self.totals.items() for name, value in counters.items()]
        return like.sparkSession.createDataFrame(found, "run_id string, stage string, counter string, value long")


def counters(df: DataFrame, stage: str, **values: Column) -> DataFrame:
    """(run_id, stage, counter, value): aggregates per run of a written stage table."""
    counted = df.groupBy("run_id").agg(*[v.cast("long").alias(name) for name, v in values.items()])
    pairs = F.explode(F.array(*[F.struct(F.lit(name).alias("counter"), F.col(name).alias("value")) for name in values]))
    return counted.select("run_id", F.lit(stage).alias("stage"), pairs.alias("p")).select("run_id", "stage", "p.*")


def control_run_summary(
    processed: DataFrame, groups: DataFrame, chunks: DataFrame, merged: DataFrame, faults: DataFrame, approved: DataFrame,
    enriched: DataFrame, report: DataFrame, consolidated: DataFrame | None = None,
) -> DataFrame:
    """(run_id, stage, counter, value) of every stage of control runs.

    All arguments are stage tables as they are written anyway: processed controls, control groups, chunks, merged
    groups, faults of the proposals, approved members, enriched groups, report rows.  ``consolidated`` (run_id)
    are runs whose proposals were consolidated.
    """
    one = F.count(F.lit(1))
    wanted = F.col("was_included")
    parts = [
        counters(processed, "ingest", findings=one, warnings=F.max((F.col("tenant_id") == "UNKNOWN-TENANT").cast("int"))),
        counters(processed, "process", included=F.count_if(wanted & ~F.col("is_duplicate")), excluded=F.count_if(~wanted), duplicates=F.count_if(wanted & F.col("is_duplicate"))),
        counters(groups, "process", groups=one),
        counters(groups, "grouping", original_controls=one),
        counters(merged, "grouping", groups_proposed=one, merges_applied=F.count_if("is_merged")),
        counters(chunks, "grouping", chunks_used=F.max("chunk_no")),
        counters(faults, "grouping", warnings=one),
        counters(approved.select("run_id", "group_no").distinct(), "review", approved_groups=one),
        counters(
            enriched, "enrich", enriched=F.count_if(~F.col("enrichment_failed")), failed=F.count_if("enrichment_failed"),
            **{f"risk_{v}": F.count_if(F.coalesce("risk_rating", F.lit("Unknown")) == v) for v in ("High", "Medium", "Low", "Unknown")},
        ),
        counters(report.filter("kind = 'finding'"), "render", groups_written=one),
    ]
    if consolidated is not None:
        parts.append(counters(consolidated.distinct(), "grouping", consolidation=one))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
