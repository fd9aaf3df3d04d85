"""Status filter, duplicate marking and grouping by check.

Scale: the passes that decide (duplicates, representatives) read only key
columns and pre-aggregate before their shuffle, so a hot key costs one row per
task.  Their results are written once; the wide rows are then joined to them
by whatever strategy fits the written size.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sightline.functions.findings import instance_id
from sightline.functions.text import quoted_list, text_or
from sightline.operators.normalise import normalise_findings
from sightline.rules import SECTION_BY_PROVIDER, Rules, lookup, severity_rank
from sightline.schemas import EXCLUDED, INCLUDED
from sightline.session import materialise

GROUP_KEYS = ["run_id", "check_id", "output_section"]
# row_seq < 2**56; the score sits above it, so one integer maximum finds the
# best score and, among equals, the earliest row.
_SEQ_SPAN = 1 << 57


def status_filter(findings: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Mark every finding INCLUDED or EXCLUDED by status; no row is dropped."""
    keep = F.col("scanner_status").isin(*rules.include_statuses)
    reason = F.concat(
        F.lit("scanner_status '"), F.col("scanner_status"), F.lit("' not in include_statuses "),
        F.lit(quoted_list(rules.include_statuses)),
    )
    return findings.withColumns({
        "report_inclusion": F.when(keep, INCLUDED).otherwise(EXCLUDED),
        "exclusion_reason": F.when(~keep, reason),
    })


def with_key(filtered: DataFrame) -> DataFrame:
    """Add ``key``: 128 bits of the SHA-256 of run and dedup key of an included row; null for other rows and empty keys.

    Rows are shuffled and joined by it instead of by the two texts.
    """
    run = F.concat(F.length("run_id").cast("string"), F.lit(":"), "run_id")
    digest = F.unhex(F.left(F.sha2(F.concat(run, F.col("dedup_key")), 256), F.lit(32)))
    compared = (F.col("report_inclusion") == INCLUDED) & (F.col("dedup_key") != "")
    return filtered.withColumn("key", F.when(compared, digest))


def duplicate_keys(keyed: DataFrame) -> DataFrame:
    """Keys of :func:`with_key` held by more than one row, with the first row of each.

    A filter on the key before the aggregation would make the optimiser compute it twice; the rows without one
    are a single group, of which none is counted.
    """
    return (
        keyed.groupBy("key").agg(F.min("row_seq").alias("primary_seq"), F.count("key").alias("copies")).filter("copies > 1")
    )


def with_first_rows(keyed: DataFrame, keys: DataFrame) -> DataFrame:
    """Put ``primary_seq``, the first row with its key, for ``key``; null for rows without key and keys of one row.

    Only rows with a key are joined; the others keep out of the shuffle.
    """
    joined = keyed.filter("key IS NOT NULL").join(keys.select("key", "primary_seq"), "key", "left").drop("key")
    return joined.unionByName(keyed.filter("key IS NULL").drop("key").withColumn("primary_seq", F.lit(None).cast("long")))


def locate_first_rows(keyed: DataFrame) -> DataFrame:
    """The rows of :func:`with_first_rows`, by one shuffle of the rows with a key and without a table of keys.

    For narrow rows: those of a key are sorted together in one task, on disk where they are very many.
    """
    same = Window.partitionBy("key")
    first = F.when(F.count(F.lit(1)).over(same) > 1, F.min("row_seq").over(same))
    located = keyed.filter("key IS NOT NULL").withColumn("primary_seq", first).drop("key")
    return located.unionByName(keyed.filter("key IS NULL").drop("key").withColumn("primary_seq", F.lit(None).cast("long")))


def flag_duplicates(located: DataFrame) -> DataFrame:
    """Flag all but the first included row of each dedup key by its ``primary_seq``; a projection."""
    return (
        located.withColumn("is_duplicate", F.coalesce(F.col("row_seq") > F.col("primary_seq"), F.lit(False)))
        .withColumn("duplicate_of", F.when(F.col("is_duplicate"), instance_id(F.col("run_id"), F.col("primary_seq"))))
        .withColumns({
            "report_inclusion": F.when(F.col("is_duplicate"), EXCLUDED).otherwise(F.col("report_inclusion")),
            "exclusion_reason": F.when(
                F.col("is_duplicate"),
                F.concat(
                    F.lit("Duplicate of finding_instance_id="), F.col("duplicate_of"), F.lit(" (same dedup_key)")
                ),
            ).otherwise(F.col("exclusion_reason")),
        })
        .drop("primary_seq")
    )


def mark_duplicates(filtered: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """Flag all but the first included row of each dedup key and link them to it.

    The join carries the rows as they are: where they are read several times, join narrow rows once
    (:func:`with_first_rows`), write them, and flag what is made of them.
    """
    keyed = with_key(filtered)
    keys = materialise(duplicate_keys(keyed), "duplicate-keys") if keys is None else keys
    return flag_duplicates(with_first_rows(keyed, keys))


def processed_findings(normalised: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """All findings with inclusion and duplicate state."""
    return mark_duplicates(status_filter(normalised, rules))


def assign_section(findings: DataFrame) -> DataFrame:
    """Report section by cloud provider; an unknown provider goes to AWS."""
    return findings.withColumns({
        "check_id": text_or(F.col("raw_check_id"), "unknown"),
        "output_section": lookup(F.lower(F.col("raw_provider")), SECTION_BY_PROVIDER, "AWS"),
    })


def working_set(processed: DataFrame) -> DataFrame:
    """Included, non-duplicate findings with their group key."""
    return assign_section(processed.filter((F.col("report_inclusion") == INCLUDED) & ~F.col("is_duplicate")))


def group_counts(working: DataFrame) -> DataFrame:
    """Per group: number of instances and the ``row_seq`` of its representative."""
    best = F.max(F.col("completeness_score") * F.lit(_SEQ_SPAN) - F.col("row_seq"))
    return (
        working.groupBy(*GROUP_KEYS)
        .agg(F.count(F.lit(1)).alias("instance_count"), best.alias("_best"))
        .withColumn("representative_seq", (-F.col("_best")).bitwiseAND(F.lit(_SEQ_SPAN - 1)))
        .drop("_best")
    )


def representatives(raw: DataFrame, counts: DataFrame) -> DataFrame:
    """The representative row of every group, normalised, all columns kept.

    The join picks raw rows by their position, so only the picked rows are
    normalised.
    """
    picked = raw.join(counts.withColumnRenamed("representative_seq", "row_seq"), ["run_id", "row_seq"])
    return normalise_findings(picked)


def likelihood(groups: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Likelihood of the representative: severity rule, or High for a listed category."""
    base = lookup(F.lower(F.col("raw_severity")), rules.severity_rules, "Medium")
    listed = F.array(*[F.lit(c) for c in rules.high_if_categories]).cast("array<string>")
    hit = F.try_element_at(F.array_intersect("categories_list", listed), F.lit(1))
    shown = text_or(F.lower(F.col("raw_severity")), "")
    return groups.withColumns({
        "likelihood_rating": F.when(hit.isNotNull(), "High").otherwise(base),
        "likelihood_reason": F.when(
            hit.isNotNull(),
            F.concat(
                F.lit("Category '"), hit, F.lit("' forces High (base "), base,
                F.lit(" from severity '"), shown, F.lit("')"),
            ),
        ).otherwise(F.concat(F.lit("Severity '"), shown, F.lit("' gives "), base)),
    })


def order_groups(groups: DataFrame) -> DataFrame:
    """Position of each group in its run: section, severity, check id.

    The window runs over groups, not findings: at most one row per check and
    section of a run.
    """
    order = Window.partitionBy("run_id").orderBy(
        "output_section", severity_rank(F.coalesce("raw_severity", F.lit(""))), "check_id"
    )
    sections = F.count(F.lit(1)).over(Window.partitionBy("run_id", "check_id"))
    key = F.concat_ws(":", "check_id", "output_section")
    return groups.withColumns({
        "output_group_key": key,
        # How proposals and approvals name the group: by check id alone unless
        # the run has that check in several sections.
        "member_key": F.when(sections == 1, F.col("check_id")).otherwise(key),
        "group_order": F.row_number().over(order),
    })


def check_groups(raw: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One row per check and section of a run: representative, count, likelihood, order.

    Two passes over the raw findings.  The first reads key columns only and
    ends in one row per group, which is written; the second picks the wide
    representative rows by their position, without grouping wide rows.
    """
    working = working_set(processed_findings(normalise_findings(raw), rules))
    counts = materialise(group_counts(working), "group-counts")
    return order_groups(likelihood(representatives(raw, counts), rules))


def group_instances(working: DataFrame) -> DataFrame:
    """Bridge table: one row per finding of a group, in row order by ``row_seq``."""
    return working.select(*GROUP_KEYS, "row_seq", "finding_instance_id")


def group_accounts(working: DataFrame, column: str = "raw_account_name") -> DataFrame:
    """Bridge table: distinct accounts of each group, in first-seen order.

    Findings are reduced to one row per group and account before the window.
    """
    first = (
        working.filter(F.col(column).isNotNull())
        .groupBy(*GROUP_KEYS, F.col(column).alias("account"))
        .agg(F.min("row_seq").alias("_first"))
    )
    order = Window.partitionBy(*GROUP_KEYS).orderBy("_first")
    return first.withColumn("pos", F.row_number().over(order)).drop("_first")


def process_warnings(normalised: DataFrame, groups: DataFrame, filtered: DataFrame) -> DataFrame:
    """EMPTY_DEDUP_KEY per finding and EMPTY_OUTPUT per run without groups."""
    null = F.lit(None)
    empty_key = filtered.filter((F.col("report_inclusion") == INCLUDED) & (F.col("dedup_key") == "")).select(
        "run_id", F.lit("process").alias("stage"), F.lit("EMPTY_DEDUP_KEY").alias("code"),
        F.concat(F.lit("Finding "), "finding_instance_id", F.lit(" has an empty dedup_key.")).alias("message"),
        "row_no", F.col("raw_check_id").alias("check_id"), F.col("finding_instance_id").alias("finding_id"),
    )
    no_output = (
        normalised.select("run_id").distinct().join(groups.select("run_id").distinct(), "run_id", "left_anti")
        .select(
            "run_id", F.lit("process").alias("stage"), F.lit("EMPTY_OUTPUT").alias("code"),
            F.lit("No output groups produced: all findings were excluded.").alias("message"),
            null.cast("long").alias("row_no"), null.cast("string").alias("check_id"),
            null.cast("string").alias("finding_id"),
        )
    )
    return empty_key.unionByName(no_output)
