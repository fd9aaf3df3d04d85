"""Deterministic completion functions for runs without a service.

They answer from the request text alone, with the faults a service can show:
missing fields, prose around the JSON, a failed call.
"""

import json
import re

_RETRY = "The previous answer was not valid"
_CONSEQUENCES = ["Minor", "Moderate", "Major"]


def describe(prompt: str, max_tokens: int, timeout_seconds: int) -> str:
    """Enrichment answer built from the check id of the request.

    By the length of the id: a multiple of 7 always fails, a multiple of 5 is
    incomplete at the first try and fenced at the second.
    """
    check = re.search(r"^(?:Check id|Control): (.*)$", prompt, re.M).group(1)
    n = len(check)
    if n % 7 == 0:
        raise TimeoutError(f"no answer for {check}")
    body = {
        "finding_title": f"Finding {check}",
        "root_cause_narrative": f"Cause of {check}.",
        "situation_narrative": f"Situation of {check}.",
        "consequence_narrative": f"Consequence of {check}.",
        "consequence_rating": _CONSEQUENCES[n % 3],
        "access_required": "Any user.",
        "recommendations": f"Fix {check}.",
        "needs_human_review": n % 2 == 0,
    }
    if n % 5 == 0:
        if _RETRY not in prompt:
            del body["consequence_rating"]
            return json.dumps(body)
        return f"```json\n{json.dumps(body)}\n```"
    return f"Here it is: {json.dumps(body)}"


def group_by_first_word(prompt: str, max_tokens: int, timeout_seconds: int) -> str:
    """Grouping answer: checks with the same first word of their id go together.

    The second chunk of a run always fails.  A consolidation request merges
    groups of equal name.
    """
    groups: dict[str, list[str]] = {}
    if "proposed in separate batches" in prompt:
        for name, ids in re.findall(r'^"(.*?)": (.*?) - ', prompt, re.M):
            groups.setdefault(name, []).extend(ids.split(", "))
    else:
        if "This is chunk 2 of" in prompt:
            return "no groups today"
        for key in re.findall(r"^\[(.*?)\] ", prompt, re.M):
            groups.setdefault(re.split(r"[_.]", key)[0], []).append(key)
    return json.dumps(
        [{"group_name": n, "check_ids": ids, "rationale": f"Shared word {n}."} for n, ids in groups.items()]
    )
