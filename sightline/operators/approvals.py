"""Analyst decisions: board edits, approvals, overrides."""

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sightline.functions.text import quoted_array, strip, text_or
from sightline.operators.grouping import merge_groups, unknown_members
from sightline.rules import CONTROL_SEVERITY_RANK, severity_rank

UNASSIGNED = "__unassigned__"
SPLIT = "split:"
#: Fixed values of review boards: the name of a new group, and the rationale of one that was split off.
NEW_GROUP, SPLIT_FROM = "New Group — rename me", "Split from: "


_REPLAYED = (
    "run_id string, member_key string, group_id string, moved_at long, group_name string, rationale string, risk_rating_override string"
)


def replay_boards(board: DataFrame, edits: DataFrame) -> DataFrame:
    """Boards after their edits: a row for each check, and one without ``member_key`` for each group left.

    ``board`` holds ``run_id, member_key, group_id`` and, where known, ``group_name, rationale, title`` (of the
    check).  ``edits`` holds ``run_id, seq, op, check_id, group_id, value``:

    * ``move``   check to ``group_id``, or to the unassigned pool
    * ``new``    group ``group_id`` with the name ``value``
    * ``delete`` group: its checks go to the pool
    * ``split``  group of two checks or more: each becomes a group of its own, named by its title
    * ``rename``, ``rationale``, ``risk``  of a group; a blank name is ignored
    * ``reset``  the board returns to the proposal

    Edits apply in order to the groups there are at that moment, split-off and new ones included; edits of
    a group that is gone do nothing.  One board, which one person edits by hand, is replayed in one task.
    """
    blank = {"group_name": F.col("group_id"), "rationale": F.lit(""), "title": F.col("member_key")}
    held = board.select("run_id", "member_key", "group_id", *[(F.col(c) if c in board.columns else v).alias(c) for c, v in blank.items()])
    held = held.toDF(*held.columns)
    steps = edits.select(F.col("run_id").alias("edit_run"), F.col("seq").cast("long").alias("seq"), "op", "check_id", F.col("group_id").alias("edit_group"), "value")
    return held.groupBy("run_id").cogroup(steps.groupBy("edit_run")).applyInPandas(_replay, _REPLAYED)


def _replay(board: pd.DataFrame, edits: pd.DataFrame) -> pd.DataFrame:
    board = board.drop_duplicates("member_key").sort_values("member_key")
    title = {k: (t or "").strip() or k for k, t in zip(board.member_key, board.title)}

    def proposed() -> tuple[dict, dict]:
        boxes = {g: [n, r or "", None] for g, n, r in zip(board.group_id, board.group_name, board.rationale)}
        return boxes, {k: (g, None) for k, g in zip(board.member_key, board.group_id)}

    boxes, place = proposed()
    for e in edits.sort_values("seq").itertuples():
        value = e.value if isinstance(e.value, str) else None
        if e.op == "reset":
            boxes, place = proposed()
        elif e.op == "new":
            boxes[e.edit_group] = [value or NEW_GROUP, "", None]
        elif e.op == "move":
            if e.check_id in place and (e.edit_group in boxes or e.edit_group == UNASSIGNED):
                place[e.check_id] = (e.edit_group, e.seq)
        elif e.edit_group not in boxes:
            continue
        elif e.op in ("delete", "split"):
            inside = [k for k, (g, _) in place.items() if g == e.edit_group]
            if e.op == "split" and len(inside) < 2:
                continue
            name = boxes.pop(e.edit_group)[0]
            for k in inside:
                own = SPLIT + k
                place[k] = (UNASSIGNED if e.op == "delete" else own, place[k][1])
                if e.op == "split":
                    boxes[own] = [title[k], f"{SPLIT_FROM}{name}", None]
        elif e.op == "rename":
            boxes[e.edit_group][0] = (value or "").strip() or boxes[e.edit_group][0]
        elif e.op == "rationale":
            boxes[e.edit_group][1] = value or ""
        elif e.op == "risk":
            boxes[e.edit_group][2] = value or None
    if not len(board):
        return pd.DataFrame({f.split()[0]: [] for f in _REPLAYED.split(", ")})
    run = board.run_id.iloc[0]
    checks = [(run, k, g, at, None, None, None) for k, (g, at) in place.items()]
    groups = [(run, None, g, None, *box) for g, box in boxes.items()]
    out = pd.DataFrame(checks + groups, columns=[f.split()[0] for f in _REPLAYED.split(", ")])
    return out.astype({"moved_at": "Int64"})


def board_assignment(replayed: DataFrame) -> DataFrame:
    """Where every check of a replayed board is."""
    return replayed.filter("member_key IS NOT NULL").select("run_id", "member_key", "group_id", "moved_at")


def board_groups(replayed: DataFrame) -> DataFrame:
    """Name, rationale and risk override of every group of a replayed board, empty ones included."""
    return replayed.filter("member_key IS NULL").select("run_id", "group_id", "group_name", "rationale", "risk_rating_override")


def unassigned(assignment: DataFrame) -> DataFrame:
    """Checks that sit in no group."""
    return assignment.filter(F.col("group_id") == UNASSIGNED).select("run_id", "member_key")


def approval_gate(assignment: DataFrame, groups: DataFrame) -> DataFrame:
    """Per run: unassigned checks, unnamed groups, groups left; approved only when sound."""
    pool = F.col("group_id") == UNASSIGNED
    used = assignment.groupBy("run_id", "group_id").agg(F.count(F.lit(1)).alias("checks"))
    return (
        used.join(groups, ["run_id", "group_id"], "left")
        .groupBy("run_id")
        .agg(
            F.coalesce(F.sum(F.when(pool, F.col("checks"))), F.lit(0)).alias("unassigned"),
            F.count_if(~pool).alias("groups"),
            F.count_if(~pool & (strip(F.coalesce("group_name", F.lit(""))) == "")).alias("unnamed"),
        )
        .withColumn(
            "can_approve", (F.col("unassigned") == 0) & (F.col("unnamed") == 0) & (F.col("groups") > 0)
        )
    )


def board_stats(assignment: DataFrame) -> DataFrame:
    """Groups, merged, standalone and unassigned checks per board."""
    pool = F.col("group_id") == UNASSIGNED
    used = assignment.groupBy("run_id", "group_id").agg(F.count(F.lit(1)).alias("n"))
    return used.groupBy("run_id").agg(
        F.count_if(~pool).alias("current_groups"),
        F.count_if(~pool & (F.col("n") > 1)).alias("merged"),
        F.count_if(~pool & (F.col("n") == 1)).alias("standalone"),
        F.coalesce(F.sum(F.when(pool, F.col("n"))), F.lit(0)).alias("unassigned"),
    )


def board_cards(assignment: DataFrame, groups: DataFrame, accounts: DataFrame) -> DataFrame:
    """Per group of a board: checks, highest severity, instances, distinct accounts."""
    severity = F.lower(text_or(F.col("raw_severity"), "informational"))
    held = assignment.filter(F.col("group_id") != UNASSIGNED).join(
        groups.select("run_id", "member_key", "check_id", "output_section", "instance_count", severity.alias("severity")),
        ["run_id", "member_key"],
    )
    names = held.join(accounts, ["run_id", "check_id", "output_section"]).groupBy("run_id", "group_id", "account").agg(
        F.count(F.lit(1)).alias("n")
    )
    per_group = names.groupBy("run_id", "group_id").agg(F.count(F.lit(1)).alias("accounts"))
    cards = held.groupBy("run_id", "group_id").agg(
        F.count(F.lit(1)).alias("checks"), F.sum("instance_count").alias("instances"),
        F.min_by("severity", F.struct(severity_rank(F.col("severity")), "severity")).alias("severity"),
    )
    return cards.join(per_group, ["run_id", "group_id"], "left").fillna({"accounts": 0})


def approvals_from_board(assignment: DataFrame, groups: DataFrame) -> DataFrame:
    """Approved members ``(run_id, group_no, group_name, …, pos, member_key)`` of a board.

    Groups without checks never reach the result.
    """
    held = assignment.filter(F.col("group_id") != UNASSIGNED).join(groups, ["run_id", "group_id"])
    by_group = Window.partitionBy("run_id").orderBy("group_id")
    in_group = Window.partitionBy("run_id", "group_id").orderBy(F.coalesce("moved_at", F.lit(-1)), "member_key")
    return held.select(
        "run_id", F.dense_rank().over(by_group).alias("group_no"), "group_name", "rationale",
        "risk_rating_override", F.row_number().over(in_group).alias("pos"), "member_key",
    )


def approval_warnings(members: DataFrame, groups: DataFrame) -> DataFrame:
    """UNKNOWN_CHECK_ID for every approved member that names no check group."""
    return unknown_members(members, groups).select(
        "run_id", F.lit("review").alias("stage"), F.lit("UNKNOWN_CHECK_ID").alias("code"),
        F.concat(
            F.lit("Approved group '"), "group_name", F.lit("' references unknown check_id '"),
            "member_key", F.lit("'. Skipped."),
        ).alias("message"),
        F.lit(None).cast("long").alias("row_no"), F.col("member_key").alias("check_id"),
        F.lit(None).cast("string").alias("finding_id"),
    )


def apply_override(merged: DataFrame, overrides: DataFrame, allowed: tuple | None = None) -> DataFrame:
    """Add ``risk_override`` by group; ``allowed`` limits the values (control reports)."""
    value = F.nullif(strip(F.col("risk_rating_override")), F.lit(""))
    if allowed is not None:
        value = F.when(value.isin(*allowed), value)
    picked = overrides.select("run_id", "group_no", value.alias("risk_override")).filter("risk_override IS NOT NULL")
    one = picked.groupBy("run_id", "group_no").agg(F.max("risk_override").alias("risk_override"))
    return merged.join(one, ["run_id", "group_no"], "left")


#: Ratings that an analyst may set on a control group.
CONTROL_RATINGS = ("High", "Medium", "Low")


def review_controls(members: DataFrame, groups: DataFrame) -> DataFrame:
    """Control groups as approved: merged, with ``risk_override`` where the analyst's rating is allowed.

    ``members`` are approved members with ``analyst_note`` and ``risk_rating_override``.  Unknown ids drop out, see
    :func:`approval_warnings`; a group without known ids goes.  The note stands in for a missing rationale.
    """
    merged = apply_override(merge_groups(members, groups, "severity", CONTROL_SEVERITY_RANK, "low"), members, CONTROL_RATINGS)
    return merged.withColumn("rationale", F.coalesce(F.nullif("rationale", F.lit("")), "analyst_note", F.lit("")))


def override_audit(reviewed: DataFrame) -> DataFrame:
    """Audit rows of ratings set in review, on each representative."""
    none = F.lit(None).cast("string")
    return reviewed.filter("risk_override IS NOT NULL").select(
        "run_id", "representative.finding_instance_id", F.lit(3).alias("stage_no"), F.lit(2).alias("seq"), F.lit("review").alias("stage"),
        F.lit("risk_rating").alias("field"), none.alias("old_value"), F.col("risk_override").alias("new_value"),
        F.lit("Rating set in review").alias("reason"), F.lit("human").alias("actor"),
    )


def carry_forward(old: DataFrame, new: DataFrame, resources: DataFrame) -> DataFrame:
    """State of regrouped boards: section of the first member, the override when
    all members that have one agree, and the number of resources carried over.
    The board of resource findings does not inherit overrides: leave them out of ``old``.

    ``old``: ``run_id, member_key, output_section, risk_rating_override`` per
    member; ``new``: ``run_id, group_no, group_name, pos, member_key``;
    ``resources``: ``run_id, member_key, resource``.
    """
    carried = resources.select("run_id", "member_key", "resource").distinct()
    counts = carried.groupBy("run_id", "member_key").agg(F.count(F.lit(1)).alias("resources"))
    override = F.nullif("risk_rating_override", F.lit(""))
    return (
        new.join(old, ["run_id", "member_key"], "left").join(counts, ["run_id", "member_key"], "left")
        .groupBy("run_id", "group_no", "group_name")
        .agg(
            F.coalesce(F.min_by("output_section", "pos"), F.lit("Other")).alias("output_section"),
            F.when(F.min(override) == F.max(override), F.min(override)).alias("risk_rating_override"),
            F.coalesce(F.sum("resources"), F.lit(0)).alias("resources"),
            (F.count(F.lit(1)) > 1).alias("is_merged"),
        )
    )


def review_board(members: DataFrame, groups: DataFrame) -> DataFrame:
    """Member rows with what a reviewer sees of each check."""
    from sightline.operators.grouping import attach_members

    return attach_members(members, groups).select(
        "run_id", "group_no", "group_name", "rationale", "member_pos", "member_key", "check_id",
        text_or(F.col("raw_check_title"), F.col("check_id")).alias("check_title"),
        text_or(F.col("raw_severity"), "unknown").alias("severity"),
        "instance_count", text_or(F.col("likelihood_rating"), "Unknown").alias("likelihood"),
        F.coalesce("raw_service_name", F.lit("")).alias("service"),
        quoted_array(F.col("categories_list")).alias("categories"),
    )
