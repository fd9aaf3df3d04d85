"""Proposed groupings from a completion function: chunk rounds, consolidation, regrouping."""

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.functions import prompts, responses
from sightline.functions.text import text_or
from sightline.operators.completion import Complete, complete_requests
from sightline.session import materialise

BASE_TOKENS, BASE_SECONDS = 1500, 60


class Proposals(NamedTuple):
    members: DataFrame  # run_id, group_no, group_name, rationale, pos, member_key
    warnings: DataFrame
    consolidation: DataFrame  # run_id, consolidation_applied


def _empty(kind: str) -> Column:
    return F.array().cast(kind)


def _ordered(value: Column, *order: str) -> Column:
    """Array of ``value`` in the order of the given columns."""
    packed = F.array_sort(F.collect_list(F.struct(*order, value.alias("_v"))))
    return F.transform(packed, lambda s: s["_v"])


def chunk_requests(chunked: DataFrame, title: str = "raw_check_title", severity: str = "raw_severity") -> DataFrame:
    """One row per run and chunk (at most 20 checks): its ids, lines and budget."""
    line = F.concat(
        F.lit("["), "member_key", F.lit("] "), text_or(F.col(title), F.col("check_id")),
        F.lit(" (severity="), F.coalesce(severity, F.lit("None")),
        F.lit(", instances="), F.col("instance_count").cast("string"), F.lit(")"),
    )
    fallback = F.struct("member_key", text_or(F.col(title), F.col("check_id")).alias("title"))
    items = F.col("items")
    return (
        chunked.groupBy("run_id", "chunk_no", "chunk_count")
        .agg(
            F.count(F.lit(1)).cast("int").alias("items"),
            _ordered(F.col("member_key"), "chunk_pos").alias("expected"),
            _ordered(line, "chunk_pos").alias("check_lines"),
            _ordered(fallback, "chunk_pos").alias("checks"),
        )
        .withColumns({
            "max_tokens": responses.chunk_tokens(items, BASE_TOKENS),
            "timeout_seconds": responses.chunk_seconds(items, BASE_SECONDS),
        })
    )


def _ask(requests: DataFrame, complete: Complete, model: str, cache_path, strict: bool = True) -> DataFrame:
    """Ask, check, and ask the faulty ones once more; adds ``items`` and ``errors``."""

    def check(answered: DataFrame) -> DataFrame:
        parsed = answered.withColumn("answer", responses.proposal_items(responses.json_array(F.col("response"))))
        faults = responses.grouping_errors(F.col("answer"), F.col("expected"), strict)
        return parsed.withColumn("errors", F.when(F.col("error").isNotNull(), F.array("error")).otherwise(faults))

    first = materialise(check(complete_requests(requests, complete, model, cache_path)), "ask-first")
    faulty = first.filter(F.size("errors") > 0)
    if faulty.isEmpty():
        return first
    again = faulty.withColumn(
        "prompt",
        prompts.correction_prompt(F.col("prompt"), F.col("errors"), F.col("response"), F.array_sort("expected")),
    ).drop("request_key", "response", "error", "answer", "errors")
    second = check(complete_requests(again, complete, model, cache_path))
    return first.filter(F.size("errors") == 0).unionByName(second)


def _warning(df: DataFrame, code: str, message: Column) -> DataFrame:
    return df.select(
        "run_id", F.lit("grouping").alias("stage"), F.lit(code).alias("code"), message.alias("message"),
        F.lit(None).cast("long").alias("row_no"), F.lit(None).cast("string").alias("check_id"),
        F.lit(None).cast("string").alias("finding_id"),
    )


def propose_chunks(
    chunked: DataFrame, complete: Complete, model: str, cache_path: str | None = None, **columns
) -> tuple[DataFrame, DataFrame]:
    """Proposals of every chunk, and the warnings of failed chunks.

    Round k asks chunk k of all runs at once, with the names of rounds before
    it.  The number of rounds is that of the longest run, not of all chunks.
    A chunk that fails twice falls back to one group per check.
    """
    requests = materialise(chunk_requests(chunked, **columns), "chunk-requests")
    rounds = requests.agg(F.max("chunk_count").alias("n")).first()["n"] or 0
    proposals, warnings = None, None
    for k in range(1, rounds + 1):
        names = _names_so_far(requests, proposals)
        asked = _ask(
            requests.filter(F.col("chunk_no") == k).join(names, "run_id", "left")
            .withColumn("existing_names", F.coalesce("existing_names", _empty("array<string>")))
            .withColumn("prompt", prompts.chunk_prompt()),
            complete, model, cache_path,
        )
        standalone = F.transform("checks", lambda c: F.struct(
            c["title"].alias("group_name"), F.array(c["member_key"]).alias("check_ids"),
            F.lit("Standalone: the grouping request of this chunk failed.").alias("rationale"),
        ))
        done = asked.select(
            "run_id", "chunk_no", "chunk_count", "errors",
            F.when(F.size("errors") > 0, standalone).otherwise(F.col("answer")).alias("groups"),
        )
        part = done.select("run_id", "chunk_no", F.posexplode("groups").alias("group_pos", "g")).select(
            "run_id", "chunk_no", "group_pos", "g.group_name", "g.rationale", "g.check_ids"
        )
        failed = _warning(
            done.filter(F.size("errors") > 0), "CHUNK_GROUPING_FAILED",
            F.concat(
                F.lit("Chunk "), F.col("chunk_no").cast("string"), F.lit("/"), F.col("chunk_count").cast("string"),
                F.lit(" failed after retry: "), F.array_join("errors", "; "),
                F.lit(". Its checks fall back to standalone groups."),
            ),
        )
        proposals = part if proposals is None else proposals.unionByName(part)
        warnings = failed if warnings is None else warnings.unionByName(failed)
    return proposals, warnings


def _names_so_far(requests: DataFrame, proposals: DataFrame | None) -> DataFrame:
    if proposals is None:
        return requests.select("run_id", _empty("array<string>").alias("existing_names")).limit(0)
    first = proposals.filter("group_name <> ''").groupBy("run_id", "group_name").agg(
        F.min(F.struct("chunk_no", "group_pos")).alias("seen")
    )
    return first.groupBy("run_id").agg(_ordered(F.col("group_name"), "seen").alias("existing_names"))


def consolidate(
    proposals: DataFrame, complete: Complete, model: str, cache_path: str | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One request per run over all its proposals; a run with one proposal is skipped.

    Returns the final groups ``(run_id, group_no, group_name, rationale,
    check_ids)``, warnings, and ``(run_id, consolidation_applied)``.  A run
    whose answer fails twice keeps its proposals.
    """
    line = F.concat(
        F.lit('"'), "group_name", F.lit('": '), F.array_join("check_ids", ", "), F.lit(" - "),
        F.left(F.coalesce("rationale", F.lit("")), F.lit(150)),
    )
    kept = F.struct("group_name", "check_ids", "rationale")
    items = F.col("items")
    per_run = proposals.groupBy("run_id").agg(
        F.count(F.lit(1)).cast("int").alias("items"),
        _ordered(line, "chunk_no", "group_pos").alias("group_lines"),
        _ordered(kept, "chunk_no", "group_pos").alias("groups"),
        F.array_distinct(F.flatten(F.collect_list("check_ids"))).alias("expected"),
    ).withColumns({
        "max_tokens": responses.chunk_tokens(items, BASE_TOKENS),
        "timeout_seconds": responses.chunk_seconds(items, BASE_SECONDS),
    })
    per_run = materialise(per_run, "consolidation-requests")
    asked = _ask(
        per_run.filter("items > 1").withColumn("prompt", prompts.consolidation_prompt()), complete, model, cache_path
    )
    done = asked.select("run_id", "answer", "errors", "groups")
    failed = F.size("errors") > 0
    final = done.select("run_id", F.when(failed, F.col("groups")).otherwise(F.col("answer")).alias("groups")).unionByName(
        per_run.filter("items <= 1").select("run_id", "groups")
    )
    groups = final.select("run_id", F.posexplode("groups").alias("p", "g")).select(
        "run_id", (F.col("p") + 1).alias("group_no"), "g.group_name", "g.rationale", "g.check_ids"
    )
    applied = done.select("run_id", (~failed).alias("consolidation_applied")).unionByName(
        per_run.filter("items <= 1").select("run_id", F.lit(True).alias("consolidation_applied"))
    )
    warnings = _warning(
        done.filter(failed), "CONSOLIDATION_FAILED",
        F.concat(F.lit("Consolidation failed: "), F.array_join("errors", "; "), F.lit(". Chunk proposals are used.")),
    )
    return groups, warnings, applied


def members_of(groups: DataFrame) -> DataFrame:
    """Groups with an id list to member rows."""
    return groups.select(
        "run_id", "group_no", "group_name", F.coalesce("rationale", F.lit("")).alias("rationale"),
        F.posexplode("check_ids").alias("p", "member_key"),
    ).withColumn("pos", F.col("p") + 1).drop("p")


def propose_groups(
    chunked: DataFrame, complete: Complete, model: str, cache_path: str | None = None, **columns
) -> Proposals:
    """Chunk rounds followed by consolidation."""
    proposals, chunk_warnings = propose_chunks(chunked, complete, model, cache_path, **columns)
    groups, warnings, applied = consolidate(proposals, complete, model, cache_path)
    return Proposals(members_of(groups), chunk_warnings.unionByName(warnings), applied)


def regroup(
    instructions: DataFrame, members: DataFrame, pool: DataFrame, complete: Complete, model: str,
    cache_path: str | None = None,
) -> DataFrame:
    """Answer analyst instructions ``(run_id, seq, instruction, target_group)`` on the current boards.

    ``target_group`` is null for a board-wide instruction.  The result holds,
    per instruction, ``ok``, ``error`` and the new ``groups``; the board of a
    failed instruction is to stay as it is.
    """
    groups = members.groupBy("run_id", "group_no", "group_name").agg(
        _ordered(F.col("member_key"), "pos").alias("check_ids")
    )
    line = F.concat(F.lit('"'), "group_name", F.lit('": '), F.array_join("check_ids", ", "))
    board = groups.groupBy("run_id").agg(
        _ordered(line, "group_no").alias("group_lines"),
        F.array_distinct(F.flatten(F.collect_list("check_ids"))).alias("held"),
    )
    loose = pool.groupBy("run_id").agg(F.array_sort(F.collect_set("member_key")).alias("pool"))
    target = groups.select("run_id", F.col("group_name").alias("target_group"), line.alias("target_line"))
    items = F.size("expected")
    requests = (
        instructions.join(board, "run_id").join(loose, "run_id", "left")
        .join(target, ["run_id", "target_group"], "left")
        .withColumn("pool", F.coalesce("pool", _empty("array<string>")))
        # A board-wide answer must also place the unassigned checks.
        .withColumn("expected", F.when(F.col("target_group").isNull(), F.array_union("held", "pool")).otherwise(F.col("held")))
        .withColumns({
            "max_tokens": responses.regroup_tokens(items, BASE_TOKENS),
            "timeout_seconds": responses.regroup_seconds(items, BASE_SECONDS),
            "prompt": prompts.regroup_prompt(),
        })
    )
    asked = _ask(requests, complete, model, cache_path, strict=False)
    return asked.select(
        "run_id", "seq", (F.size("errors") == 0).alias("ok"),
        F.nullif(F.array_join("errors", "; "), F.lit("")).alias("error"),
        F.when(F.size("errors") == 0, F.col("answer")).alias("groups"),
    )
