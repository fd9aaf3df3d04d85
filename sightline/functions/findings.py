"""Row-level rules of resource findings.

Cells are expected clean (``text.clean``): stripped, and null when blank.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from sightline.functions.text import literal_map, parse_bool, text_or
from sightline.schemas import DATA_QUALITY, GLOBAL_SERVICES, STATUSES, STRUCTURALLY_BLANK


def instance_id(run_id: Column, row_seq: Column) -> Column:
    """Finding id: a hash of the run and the row's place in it, the same on every attempt."""
    return F.sha2(F.concat(run_id, F.lit(":"), row_seq.cast("string")), 256)


def source_row_id(sheet: Column, row_no: Column) -> Column:
    return F.concat(F.lit("Sheet:"), sheet, F.lit(" Row:"), row_no.cast("string"))


def reconcile_status(status: Column, muted: Column) -> Column:
    """``struct(scanner_status, muted_reconciled, unknown_status)`` of STATUS and MUTED."""
    text = F.coalesce(F.upper(status), F.lit(""))
    marked = F.startswith(text, F.lit("MUTED("))
    muted = F.coalesce(parse_bool(muted), F.lit(False))
    plain = ("FAIL", "PASS", "MANUAL")
    wrapped = {f"MUTED({s})": f"MUTED({s})" for s in plain}
    table = {f"as given {s}": s for s in plain} | {f"as given {k}": v for k, v in wrapped.items()}
    table |= {f"muted {s}": f"MUTED({s})" for s in plain} | {f"muted {k}": v for k, v in wrapped.items()}
    key = F.concat(F.when(muted, "muted ").otherwise("as given "), text)
    fallback = F.when(muted, "MUTED(FAIL)").otherwise("UNKNOWN")
    return F.struct(
        F.coalesce(F.try_element_at(literal_map(table), key), fallback).alias("scanner_status"),
        (muted & ~marked).alias("muted_reconciled"),
        (~muted & marked & F.endswith(text, F.lit(")")) & ~text.isin(*STATUSES)).alias("unknown_status"),
    )


def classify_blank(column: str, value: Column, service: Column) -> Column:
    """Why a cell is blank: structurally, by missing data, or by design."""
    if column in STRUCTURALLY_BLANK:
        blank = F.lit("STRUCTURAL")
    elif column in DATA_QUALITY:
        blank = F.lit("DATA_QUALITY")
    elif column == "REGION":
        blank = F.when(F.lower(service).isin(*GLOBAL_SERVICES), "STRUCTURAL").otherwise("BY_DESIGN")
    else:
        blank = F.lit("BY_DESIGN")
    return F.when(value.isNotNull(), "POPULATED").otherwise(blank)


_ARN = r"(?i)^arn:[a-z0-9\-]+:[a-z0-9\-]+:[^:]*:[^:]*:.+$"


def resource_id(uid: Column, name: Column) -> Column:
    """Resource identifier: ARN without trailing slashes, other uid, name, or ''."""
    stripped = F.when(uid.rlike(_ARN), F.rtrim(uid, F.lit("/"))).otherwise(uid)
    return F.coalesce(stripped, name, F.lit(""))


def stable_key(provider: Column, account: Column, service: Column, check: Column, resource: Column) -> Column:
    """Key that stays the same over repeated scans of one environment."""
    part = lambda c, missing="unknown": F.lower(text_or(c, missing))
    return F.concat_ws(
        ":",
        part(provider),
        F.replace(part(account), F.lit(" "), F.lit("_")),
        part(service),
        part(check),
        part(resource, "no_resource"),
    )


def dedup_key(account_uid: Column, check: Column, resource: Column, region: Column) -> Column:
    """Key of one finding inside a run; without a resource it is account and check only."""
    head = F.concat(F.coalesce(account_uid, F.lit("unknown")), F.lit(":"), F.lower(F.coalesce(check, F.lit("unknown"))))
    place = F.concat(F.lit(":"), F.lower(resource), F.lit(":"), F.lower(region))
    return F.concat(head, F.when(resource == "", "").otherwise(place))


def completeness(*cells: Column) -> Column:
    """Number of populated cells."""
    total = F.lit(0)
    for c in cells:
        total = total + F.when(c != "", 1).otherwise(0)
    return total
