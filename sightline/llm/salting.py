"""Join a result per key back to rows of which one key may hold very many."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 64
_SALT = "__salt"


def join_to_rows(rows: DataFrame, results: DataFrame, keys: list[str], spread_by: str) -> DataFrame:
    """Inner join of ``rows`` with ``results``, which has one row per key; the rows of a key are spread over
    ``SALTS`` tasks by a hash of ``spread_by``.

    The salts that a key really has are found by a partial aggregation, so a key without repetitions costs one
    narrow row, and one that holds a third of all rows costs ``SALTS``.
    """
    salted = rows.withColumn(_SALT, F.pmod(F.xxhash64(F.lit(_SALT), F.col(spread_by)), F.lit(SALTS)).cast("int"))
    spread = salted.select(*keys, _SALT).distinct().join(results, keys)
    return salted.join(spread, [*keys, _SALT]).drop(_SALT)
