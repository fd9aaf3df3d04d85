"""Chunks, proposals, their validation, and merged groups.

Everything here works on groups (at most one row per check and section of a
run), never on findings.  Members are kept as rows ``(run_id, group_no, pos,
member_key)``.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.functions.text import text_or
from sightline.rules import (
    CONTROL_SECTIONS,
    CONTROL_SEVERITY_RANK,
    LIKELIHOOD_RANK,
    SEVERITY_RANK,
    lookup,
    severity_rank,
)
from sightline.session import materialise

SINGLE_CHUNK_LIMIT, CHUNK_SIZE = 20, 15


def section_rank(section: Column) -> Column:
    """Place of a control section in the report; unknown sections come last."""
    return lookup(section, {s: i for i, s in enumerate(CONTROL_SECTIONS)}, 99)


def resource_chunk_order() -> list[Column]:
    """Related checks side by side: first category, service, check id."""
    category = F.coalesce(F.array_min("categories_list"), F.lit("zzz_none"))
    service = F.lower(text_or(F.col("raw_service_name"), "zzz_none"))
    return [category, service, F.col("check_id"), F.col("output_section")]


def control_chunk_order() -> list[Column]:
    severity = severity_rank(F.col("severity"), CONTROL_SEVERITY_RANK, "low")
    return [section_rank(F.col("output_section")), severity, F.col("check_id")]


def assign_chunks(groups: DataFrame, order: list[Column] | None = None) -> DataFrame:
    """Add ``chunk_no``, ``chunk_pos`` (both from 1) and ``chunk_count`` per run."""
    run = Window.partitionBy("run_id")
    total = F.count(F.lit(1)).over(run)
    size = F.when(total <= SINGLE_CHUNK_LIMIT, total).otherwise(CHUNK_SIZE)
    rank = F.row_number().over(run.orderBy(*(order or resource_chunk_order()))) - 1
    return (
        groups.withColumns({"_rank": rank, "_size": size, "_total": total})
        .withColumns({
            "chunk_no": F.floor(F.col("_rank") / F.col("_size")).cast("int") + 1,
            "chunk_pos": (F.col("_rank") % F.col("_size")).cast("int") + 1,
            "chunk_count": F.ceil(F.col("_total") / F.col("_size")).cast("int"),
        })
        .drop("_rank", "_size", "_total")
    )


def earlier_names(proposals: DataFrame) -> DataFrame:
    """Names proposed by earlier chunks, in first-seen order, for every chunk of a run.

    A name counts from the first chunk that proposed it, so each name is one
    row and joins only to the later chunks of its own run.
    """
    first = proposals.groupBy("run_id", "group_name").agg(
        F.min(F.struct("chunk_no", "group_pos")).alias("seen")
    )
    per_chunk = first.groupBy("run_id", F.col("seen.chunk_no").alias("chunk_no")).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("seen.group_pos", "group_name"))), lambda s: s["group_name"]
        ).alias("names")
    )
    chunks = proposals.select("run_id", "chunk_no").distinct()
    earlier = Window.partitionBy("run_id").orderBy("chunk_no").rowsBetween(Window.unboundedPreceding, -1)
    return chunks.join(per_chunk, ["run_id", "chunk_no"], "left").select(
        "run_id", "chunk_no", F.flatten(F.collect_list("names").over(earlier)).alias("existing_names")
    )


# --- checking a proposal against what it must cover ---------------------------------


def missing_members(expected: DataFrame, members: DataFrame, scope: list[str]) -> DataFrame:
    """Expected members no group holds."""
    return expected.select(*scope, "member_key").join(
        members.select(*scope, "member_key"), [*scope, "member_key"], "left_anti"
    )


def unexpected_members(expected: DataFrame, members: DataFrame, scope: list[str]) -> DataFrame:
    """Members that were not asked for."""
    return members.select(*scope, "member_key").distinct().join(
        expected.select(*scope, "member_key"), [*scope, "member_key"], "left_anti"
    )


def duplicate_members(members: DataFrame, scope: list[str]) -> DataFrame:
    """Members assigned more than once."""
    return members.groupBy(*scope, "member_key").agg(F.count(F.lit(1)).alias("times")).filter("times > 1")


def partition_check(expected: DataFrame, members: DataFrame, scope: list[str]) -> DataFrame:
    """All faults of an assignment: every expected member must appear exactly once."""
    fault = lambda df, name: df.select(*scope, "member_key", F.lit(name).alias("fault"))
    return (
        fault(missing_members(expected, members, scope), "missing")
        .unionByName(fault(unexpected_members(expected, members, scope), "unknown"))
        .unionByName(fault(duplicate_members(members, scope), "duplicate"))
    )


def answer_faults(expected: DataFrame, answers: DataFrame, scope: list[str], strict: bool = True) -> DataFrame:
    """(scope, kind, place, fault): every fault of proposed groups, found by joins over rows of ids.

    ``answers`` holds ``scope``, and ``items``, the parsed groups (null when the answer is no array of groups);
    ``expected`` holds ``scope, member_key``.  ``strict`` also asks for rationales and refuses ids that were
    not asked for.  The faults of a scope by ``kind`` and ``place`` make its error text, see :func:`fault_texts`.
    """
    size = F.coalesce(F.size("items"), F.lit(0))

    def row(df: DataFrame, kind: int, place: Column, text: Column) -> DataFrame:
        return df.select(*scope, F.lit(kind).alias("kind"), place.cast("long").alias("place"), text.alias("fault"))

    def listed(df: DataFrame, kind: int, text: str) -> DataFrame:
        names = df.groupBy(*scope).agg(F.array_join(F.sort_array(F.collect_set("member_key")), ", ").alias("names"))
        return row(names, kind, F.lit(0), F.concat(F.lit(text), "names"))

    out = row(answers.filter(size <= 0), 0, F.lit(0), F.lit("Expected a non-empty JSON array of groups"))
    groups = answers.filter(size > 0).select(*scope, F.posexplode("items").alias("no", "g"))
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    tests = {"group_name": blank(F.col("g.group_name")), "check_ids": F.coalesce(F.size("g.check_ids"), F.lit(0)) <= 0}
    if strict:
        tests["rationale"] = blank(F.col("g.rationale"))
    for k, (what, test) in enumerate(tests.items()):
        text = F.concat(F.lit("Group "), F.col("no").cast("string"), F.lit(f": missing or empty '{what}'"))
        out = out.unionByName(row(groups.filter(test), 1, F.col("no") * 3 + k, text))
    ids = groups.select(*scope, "no", F.posexplode("g.check_ids").alias("at", "member_key"))
    seen = ids.groupBy(*scope, "member_key").agg(F.sort_array(F.collect_list(F.struct("no", "at"))).alias("places"))
    second = F.get("places", F.lit(1))
    out = out.unionByName(row(
        seen.filter(F.size("places") > 1), 2, second["no"] * F.lit(1 << 32) + second["at"],
        F.concat(F.lit("check_id '"), "member_key", F.lit("' appears in more than one group")),
    ))
    asked = expected.join(answers.filter(size > 0).select(*scope), scope, "left_semi")
    out = out.unionByName(listed(asked.join(seen, [*scope, "member_key"], "left_anti"), 3, "Missing check_ids: "))
    if strict:
        out = out.unionByName(listed(seen.join(expected, [*scope, "member_key"], "left_anti"), 4, "Unknown check_ids: "))
    return out


def fault_texts(faults: DataFrame, scope: list[str]) -> DataFrame:
    """(scope, errors): the faults of each scope, in order, as one text."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("kind", "place", "fault"))), lambda s: s["fault"])
    return faults.groupBy(*scope).agg(F.array_join(ordered, "; ").alias("errors"))


# --- merging -----------------------------------------------------------------------


def member_lookup(groups: DataFrame) -> DataFrame:
    """Rows ``(run_id, member_key, output_group_key)`` for both ways to name a group."""
    keyed = lambda key: groups.select("run_id", F.col(key).alias("member_key"), "output_group_key")
    return keyed("check_id").unionByName(keyed("output_group_key"))


def attach_members(members: DataFrame, groups: DataFrame) -> DataFrame:
    """Members joined to their check groups; unknown members drop out.

    ``member_pos`` is the place of the group inside its proposal, counted over
    the members found.
    """
    found = members.join(member_lookup(groups), ["run_id", "member_key"])
    place = Window.partitionBy("run_id", "group_no").orderBy("pos", "output_group_key")
    return (
        found.withColumn("member_pos", F.row_number().over(place)).drop("pos")
        .join(groups.drop("member_key"), ["run_id", "output_group_key"])
    )


def unknown_members(members: DataFrame, groups: DataFrame) -> DataFrame:
    """Members that name no check group."""
    return members.join(member_lookup(groups), ["run_id", "member_key"], "left_anti")


def merge_groups(
    members: DataFrame,
    groups: DataFrame,
    severity: str = "raw_severity",
    ranks: dict = SEVERITY_RANK,
    missing_severity: str = "informational",
) -> DataFrame:
    """One row per proposed group that has at least one known member.

    ``members`` holds ``run_id, group_no, group_name, rationale, pos,
    member_key``.  Severity and likelihood are the highest of the members, the
    section is the first member's, and the representative is the most complete
    one (then the most severe, then the first).  An ``analyst_note`` of the
    members' group is carried along.
    """
    attached = attach_members(members, groups)
    value = F.lower(text_or(F.col(severity), missing_severity))
    likelihood = text_or(F.col("likelihood_rating"), "Low")
    rank = lookup(value, ranks, 5)
    pos = F.col("member_pos")
    return (
        attached.groupBy("run_id", "group_no", "group_name", "rationale")
        .agg(
            F.count(F.lit(1)).alias("member_count"),
            F.sum("instance_count").alias("instance_count"),
            F.min_by("output_section", pos).alias("output_section"),
            F.min_by(value, F.struct(rank, pos)).alias("severity"),
            F.min_by(likelihood, F.struct(lookup(likelihood, LIKELIHOOD_RANK, 3), pos)).alias("likelihood_rating"),
            F.max_by(
                F.struct("finding_instance_id", "check_id", F.col("output_section").alias("section")),
                F.struct(F.col("completeness_score"), -rank, -pos),
            ).alias("representative"),
            F.transform(
                F.array_sort(F.collect_list(F.struct(pos.alias("p"), F.col("member_key").alias("k")))), lambda s: s["k"]
            ).alias("check_ids"),
            *[F.max(c).alias(c) for c in members.columns if c == "analyst_note"],
        )
        .withColumn("is_merged", F.col("member_count") > 1)
    )


def merged_accounts(members: DataFrame, groups: DataFrame, accounts: DataFrame) -> DataFrame:
    """Distinct accounts of each merged group, members in order, first-seen order kept."""
    place = attach_members(members, groups).select("run_id", "group_no", "member_pos", "check_id", "output_section")
    first = (
        place.join(accounts, ["run_id", "check_id", "output_section"])
        .groupBy("run_id", "group_no", "account")
        .agg(F.min(F.struct("member_pos", "pos")).alias("_first"))
    )
    order = Window.partitionBy("run_id", "group_no").orderBy("_first")
    return first.withColumn("pos", F.row_number().over(order)).drop("_first")


def merged_instances(members: DataFrame, groups: DataFrame, instances: DataFrame) -> DataFrame:
    """Bridge table: one row per finding of a merged group, ordered by ``(member_pos, row_seq)``.

    The places of the members are written first: by the size that is guessed of their joins, Spark would shuffle the findings.
    """
    place = attach_members(members, groups).select("run_id", "group_no", "member_pos", "check_id", "output_section")
    place = materialise(place, "member-places")
    return instances.join(place, ["run_id", "check_id", "output_section"])


def affected_resources(members: DataFrame, groups: DataFrame) -> DataFrame:
    """Distinct resources of the member representatives of each group, in member order."""
    resource = text_or(
        F.col("resource_uid_normalised"), F.coalesce("raw_resource_uid", "raw_resource_name")
    )
    return _first_per_resource(
        attach_members(members, groups).select(
            "run_id", "group_no", "member_pos", resource.alias("resource"),
            F.coalesce("raw_resource_name", F.lit("")).alias("resource_name"),
            F.coalesce("raw_resource_type", F.lit("")).alias("resource_type"),
            F.coalesce("raw_account_name", F.lit("")).alias("account_name"),
            F.coalesce("raw_account_uid", F.lit("")).alias("account_uid"),
            F.col("region_normalised").alias("region"),
            "check_id",
        ),
        "resource",
    )


def affected_controls(members: DataFrame, groups: DataFrame) -> DataFrame:
    """Control form: one entry per distinct details text."""
    return _first_per_resource(
        attach_members(members, groups).select(
            "run_id", "group_no", "member_pos", F.col("raw_details").alias("_key"),
            F.col("check_id").alias("resource"), F.left("check_title", F.lit(80)).alias("resource_name"),
            F.col("service_name").alias("resource_type"), F.col("tenant_id").alias("account_name"),
            F.col("tenant_id").alias("account_uid"), F.lit("global").alias("region"), "check_id",
        ),
        "_key",
    ).drop("_key")


def _first_per_resource(rows: DataFrame, key: str) -> DataFrame:
    first = Window.partitionBy("run_id", "group_no", key).orderBy("member_pos")
    place = Window.partitionBy("run_id", "group_no").orderBy("member_pos")
    return (
        rows.filter(text_or(F.col(key), F.lit(None)).isNotNull())
        .withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
        .withColumn("pos", F.row_number().over(place)).drop("member_pos")
    )


def trivial_members(groups: DataFrame, name: str = "check_id") -> DataFrame:
    """Each check group as its own proposal, for runs without semantic grouping."""
    order = Window.partitionBy("run_id").orderBy("group_order")
    return groups.select(
        "run_id", F.row_number().over(order).alias("group_no"), F.col(name).alias("group_name"),
        F.lit("").alias("rationale"), F.lit(1).alias("pos"), "member_key",
    )


def order_merged(merged: DataFrame) -> DataFrame:
    """Place of each merged group in its run: section, severity, name."""
    order = Window.partitionBy("run_id").orderBy(
        "output_section", severity_rank(F.col("severity"), missing="informational"), "group_name", "group_no"
    )
    return merged.withColumn("group_order", F.row_number().over(order))


def order_merged_controls(merged: DataFrame) -> DataFrame:
    order = Window.partitionBy("run_id").orderBy(
        section_rank(F.col("output_section")),
        severity_rank(F.col("severity"), CONTROL_SEVERITY_RANK, "low"), "group_name", "group_no",
    )
    return merged.withColumn("group_order", F.row_number().over(order))


def merge_audit(merged: DataFrame, groups: DataFrame, members: DataFrame, approved: bool = False) -> DataFrame:
    """Audit rows of merging: the semantic group, and the likelihood before and after."""
    rep = groups.select("run_id", "finding_instance_id", F.col("likelihood_rating").alias("old_likelihood"))
    base = merged.select(
        "run_id", "group_name", "rationale", "is_merged", "likelihood_rating", *[c for c in merged.columns if c == "analyst_note"],
        F.array_join("check_ids", ", ").alias("ids"), "representative.*",
    ).join(rep, ["run_id", "finding_instance_id"])
    event = lambda seq, field, old, new, reason, actor: F.struct(
        F.lit(seq).alias("seq"), F.lit(field).alias("field"), old.alias("old_value"),
        new.alias("new_value"), reason.alias("reason"), F.lit(actor).alias("actor"),
    )
    if approved:
        note = F.nullif(F.trim("analyst_note"), F.lit("")) if "analyst_note" in merged.columns else F.lit(None).cast("string")
        reason = F.concat_ws(": ", F.lit("Group as approved in review"), note)
        semantic = event(0, "semantic_group", F.col("ids"), F.col("group_name"), reason, "human")
        test, stage = F.lit(True), "review"
    else:
        reason = F.concat(F.lit("Semantic merge: "), F.coalesce("rationale", F.lit("")))
        semantic = event(0, "semantic_group", F.col("ids"), F.col("group_name"), reason, "llm")
        test, stage = F.col("is_merged"), "grouping"
    rated = event(
        1, "likelihood_rating", F.col("old_likelihood"), F.col("likelihood_rating"),
        F.concat(F.lit("Highest likelihood across merged group: "), F.col("ids")), "pipeline",
    )
    return base.select(
        "run_id", "finding_instance_id", F.lit(3).alias("stage_no"), F.lit(stage).alias("stage"),
        F.explode(F.array_compact(F.array(F.when(test, semantic), rated))).alias("e"),
    ).select("run_id", "finding_instance_id", "stage_no", "e.seq", "stage", "e.field", "e.old_value", "e.new_value", "e.reason", "e.actor")
