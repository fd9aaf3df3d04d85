"""Proposals, board edits and approvals derived from check groups.

Used by the registered queries: the same members in the same order for the
same groups, with missing, unknown and repeated ids on purpose.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def chunk_members(chunked: DataFrame) -> DataFrame:
    """Members proposed per chunk: every 7th is left out, every 5th repeated, one unknown."""
    name = F.coalesce("raw_service_name", F.lit("none"))
    base = chunked.filter(F.col("chunk_pos") % 7 != 0).select("run_id", "chunk_no", name.alias("group_name"), "member_key")
    again = chunked.filter(F.col("chunk_pos") % 5 == 0).select(
        "run_id", "chunk_no", F.lit("repeated").alias("group_name"), "member_key"
    )
    ghost = chunked.filter(F.col("chunk_pos") == 1).select(
        "run_id", "chunk_no", F.lit("ghosts").alias("group_name"),
        F.concat(F.lit("ghost_"), F.col("chunk_no").cast("string")).alias("member_key"),
    )
    members = base.unionByName(again).unionByName(ghost)
    place = Window.partitionBy("run_id", "chunk_no").orderBy("group_name")
    return members.withColumn("group_pos", F.dense_rank().over(place))


def run_members(groups: DataFrame) -> DataFrame:
    """A complete proposal: checks of one service and first category form a group."""
    category = F.coalesce(F.array_min("categories_list"), F.lit("none"))
    name = F.concat(F.coalesce("raw_service_name", F.lit("none")), F.lit(" / "), category)
    by_name = Window.partitionBy("run_id").orderBy("group_name")
    in_group = Window.partitionBy("run_id", "group_name").orderBy("member_key")
    return groups.select("run_id", name.alias("group_name"), "member_key").select(
        "run_id", F.dense_rank().over(by_name).alias("group_no"), "group_name",
        F.concat(F.lit("Same fix: "), "group_name").alias("rationale"),
        F.row_number().over(in_group).alias("pos"), "member_key",
    )


def board(members: DataFrame) -> DataFrame:
    """Members with group ids, as a review board shows them."""
    return members.withColumn("group_id", F.concat(F.lit("g"), F.col("group_no").cast("string")))


def board_edits(members: DataFrame, groups: DataFrame) -> DataFrame:
    """Edits of every kind, numbered per run."""
    checks = groups.select("run_id", "member_key", "group_order")
    on_check = lambda test, seq, target: checks.filter(test).select(
        "run_id", seq.alias("seq"), F.lit("move").alias("op"), F.col("member_key").alias("check_id"),
        F.lit(target).alias("group_id"), F.lit(None).cast("string").alias("value"),
    )
    boxes = members.select("run_id", "group_no").distinct()
    on_group = lambda test, seq, op, value: boxes.filter(test).select(
        "run_id", seq.alias("seq"), F.lit(op).alias("op"), F.lit(None).cast("string").alias("check_id"),
        F.concat(F.lit("g"), F.col("group_no").cast("string")).alias("group_id"), value.alias("value"),
    )
    once = lambda run, seq, op, group: groups.filter(F.col("group_order") == 1).filter(run).select(
        "run_id", F.lit(seq).alias("seq"), F.lit(op).alias("op"), F.lit(None).cast("string").alias("check_id"),
        F.lit(group).cast("string").alias("group_id"), F.lit(None).cast("string").alias("value"),
    )
    # edits of groups that only exist once a group has been split, and a move into one of them
    on_split = lambda test, seq, op, value: checks.filter(test).select(
        "run_id", seq.alias("seq"), F.lit(op).alias("op"), F.lit(None).cast("string").alias("check_id"),
        F.concat(F.lit("split:"), "member_key").alias("group_id"), value.alias("value"),
    )
    target = members.filter("group_no = 4").groupBy("run_id").agg(F.concat(F.lit("split:"), F.min("member_key")).alias("target"))
    into_split = checks.filter("group_order = 2").join(target, "run_id").select(
        "run_id", F.lit(50000).alias("seq"), F.lit("move").alias("op"), F.col("member_key").alias("check_id"),
        F.col("target").alias("group_id"), F.lit(None).cast("string").alias("value"),
    )
    order, no, none = F.col("group_order"), F.col("group_no"), F.lit(None).cast("string")
    number = no.cast("string")
    edits = [
        on_check(order % 5 == 0, order, "g1"),
        on_check(order % 11 == 0, order + 1000, "__unassigned__"),
        on_check(order == 7, order + 5000, "gnew"),
        on_group(no % 6 == 5, no + 500, "delete", none),
        on_group(no % 6 == 4, no + 600, "split", none),
        on_group(no % 2 == 0, no + 700, "rename", F.concat(F.lit(" Renamed "), number)),
        on_group(no % 4 == 0, no + 800, "rename", F.lit("  ")),
        on_group(no % 3 == 0, no + 900, "risk", F.when(no % 2 == 0, "Low").otherwise("Critical")),
        on_group(no % 3 == 1, no + 950, "rationale", F.concat(F.lit("Edited "), number)),
        once(F.col("run_id") == "ASIA", 12, "reset", None),
        once(F.lit(True), 2000, "new", "gnew"),
        on_split(order % 3 == 0, order + 20000, "rename", F.concat(F.lit("Own "), order.cast("string"))),
        on_split(order % 4 == 1, order + 30000, "risk", F.lit("High")),
        on_split(order % 13 == 2, order + 40000, "delete", none),
        into_split,
    ]
    out = edits[0]
    for e in edits[1:]:
        out = out.unionByName(e)
    return out


def approvals(members: DataFrame) -> DataFrame:
    """Approved members: as proposed, plus an unknown id in every third group, with overrides."""
    first = members.filter(F.col("pos") == 1)
    override = F.when(F.col("group_no") % 4 == 0, "Low").when(F.col("group_no") % 7 == 0, "Critical").otherwise("")
    ghost = first.filter(F.col("group_no") % 3 == 0).select(
        "run_id", "group_no", "group_name", "rationale", F.lit(0).alias("pos"),
        F.concat(F.lit("ghost_"), F.col("group_no").cast("string")).alias("member_key"),
    )
    return members.unionByName(ghost).withColumn("risk_rating_override", override)
