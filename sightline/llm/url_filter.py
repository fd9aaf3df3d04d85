"""URL verdicts: allow and block rules first, then logistic regression on hashed character n-grams.

Everything is DataFrame expressions: parsing, rules, features, the gradient of each training step, scoring.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Hash slots of the features, which is also the number of weights and bounds the model.
SLOTS = 1 << 15
GRAMS = (3, 4, 5)
STEPS = 40
#: Step width on the mean gradient; rows have norm one, so anything below 8 converges.
RATE = 10.0
DECAY = 1e-4
MOMENTUM = 0.9

#: (host and path prefix, verdict); a rule fits its host and all subdomains.
RULES = (
    ("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"),
)

#: Made-up site names of a small labelled table: what a crawl for text should leave out, and what it should keep.
BLOCKED_SITES = """
adult-videos adult-dating adult xxx-adult porn-tube free-porn sex-cams hot-sex escort-girls nude-pics
casino-online casino-bonus royal-casino casino win-casino win-cash poker-win slots-win jackpot-win big-win
free-bets sports-bets bets bets-odds betting lotto-win cheap-pills pills pills-shop diet-pills
cheap-viagra cheap-meds online-pharmacy weight-loss spam-links spam link-spam spam-farm link-farm content-farm
ads-server ads track-ads ads-tracker ad-tracking click-track track-clicks popup-ads ads-click tracker
cheap-loans payday-loans fast-cash free-money cheap-watches replica-bags warez-cracks free-cracks keygen-free torrent-free
""".split()
ALLOWED_SITES = """
city-library library gardening morning-news news weather university research history-museum museum
language-docs docs science-wiki science theory cooking recipes school lessons travel-stories
medicine journal parliament debates theatre orchestra astronomy reading mathematics nature-photos
local-paper letters-archive rivers lakes nation station other-thoughts the-thing thirteen-things tradition
translation the-winter another-north farmers winter window-garden trackside-trains adulthood-studies casing-makers engineering
health-advice painting chess railway thistle the-other ration-history tiling hearth northern-towns
""".split()
_PREFIXES, _ENDINGS, _LANGUAGES = ("", "www.", "m.", "blog."), ("com", "net", "org"), ("en", "de", "fr", "es")


def _addresses(sites: list[str]) -> list[str]:
    """Both labels get the same prefixes, endings and paths, so only the names tell them apart."""
    return [
        f"https://{_PREFIXES[k % 4]}{site}.example.{_ENDINGS[k % 3]}/{_LANGUAGES[(k // 4) % 4]}/{17 * k}"
        for n, site in enumerate(sites) for k in (n, n + 5, n + 10)
    ]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (ASCII lower case) and path; both empty without ``://``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    text = F.coalesce(url, F.lit(""))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.regexp_extract(text, pattern, 1), upper, upper.lower()), F.regexp_extract(text, pattern, 2)


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none fits.  Of equally long rules the first wins."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: len(r[0])):  # the last of the chain is asked first
        rule_host, slash, rule_path = text.partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(slash + rule_path)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def features(host: Column, path: Column, slots: int = SLOTS) -> Column:
    """Slots (from 1) of the distinct character n-grams of host and path; digits are one symbol."""

    def grams(tag: str, text: Column) -> Column:
        # characters as an array, bound once: substring would count, and an unbound expression be split, anew for each n-gram
        letters = F.split(F.concat(F.lit("^"), F.regexp_replace(text, "[0-9]+", "0"), F.lit("$")), "")

        def of_size(chars: Column, n: int) -> Column:
            slot = lambda i: (F.pmod(F.xxhash64(F.lit(tag), F.slice(chars, i, n)), F.lit(slots)) + 1).cast("int")
            found = F.transform(F.sequence(F.lit(1), F.greatest(F.size(chars) - (n - 1), F.lit(1))), slot)
            return F.when(F.size(chars) >= n, found).otherwise(F.array().cast("array<int>"))

        return F.flatten(F.transform(F.array(letters), lambda chars: F.concat(*[of_size(chars, n) for n in GRAMS])))

    return F.array_distinct(F.concat(grams("host", host), grams("path", path)))


def _margin(slots: Column, weights: list[float], bias: float) -> Column:
    """Weighted sum of the features, scaled by the root of their number."""
    table = F.from_json(F.lit(json.dumps(weights)), "array<double>")
    return F.aggregate(slots, F.lit(0.0), lambda s, i: s + F.element_at(table, i)) / F.sqrt(F.greatest(F.size(slots), F.lit(1))) + bias


def labelled_urls(spark: SparkSession) -> DataFrame:
    """(url, blocked) of the built-in table."""
    rows = [f"('{u}', 1.0D)" for u in _addresses(BLOCKED_SITES)] + [f"('{u}', 0.0D)" for u in _addresses(ALLOWED_SITES)]
    return spark.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS t(url, blocked)")


def train(
    labelled: DataFrame, slots: int = SLOTS, steps: int = STEPS, rate: float = RATE, decay: float = DECAY, momentum: float = MOMENTUM,
) -> tuple[list[float], float]:
    """Weights and bias by gradient steps over (url, blocked); each step is one aggregation over all rows.

    Only a gradient, of at most ``slots`` numbers, comes to the driver.  Rows with a null label are left out;
    an empty table gives weights of zero.
    """
    host, path = host_and_path(F.col("url"))
    known = labelled.where("blocked IS NOT NULL").select(features(host, path, slots).alias("x"), "blocked").coalesce(1).cache()
    weights, bias, count = [0.0] * slots, 0.0, known.count()
    speed, bias_speed = [0.0] * slots, 0.0
    try:
        for _ in range(steps if count else 0):
            chance = 1.0 / (1.0 + F.exp(-_margin(F.col("x"), weights, bias)))
            error = known.select("x", (F.col("blocked") - chance).alias("e"))
            weighted = error.select(F.explode(F.concat(F.array(F.lit(0)), "x")).alias("slot"), F.col("e"), F.size("x").alias("n"))
            pull = F.when(F.col("slot") == 0, F.col("e")).otherwise(F.col("e") / F.sqrt("n"))
            gradient = {row.slot: row.g / count for row in weighted.groupBy("slot").agg(F.sum(pull).alias("g")).collect()}
            bias_speed = momentum * bias_speed + rate * gradient.pop(0)
            bias += bias_speed
            speed = [momentum * v if v else 0.0 for v in speed]
            for slot, g in gradient.items():
                speed[slot - 1] += rate * (g - decay * weights[slot - 1])
            weights = [round(w + v, 6) if v else w for w, v in zip(weights, speed)]
    finally:
        known.unpersist()
    return weights, bias


def judge_urls(
    pages: DataFrame, labelled: DataFrame | None = None, url_column: str = "url", rules: tuple[tuple[str, str], ...] = RULES, slots: int = SLOTS,
) -> DataFrame:
    """All columns of ``pages`` with ``host``, ``path``, ``rule``, ``block_score`` and ``verdict``.

    The longest fitting rule decides; else a page is blocked if the model's probability exceeds one half.
    A null url, or one without ``://``, has an empty host and path, which fit no rule.  Repeated rows are
    judged alike; existing columns with the result's names are replaced.
    """
    pages = pages.drop(*{"host", "path", "rule", "block_score", "verdict"} - {url_column})
    weights, bias = train(labelled_urls(pages.sparkSession) if labelled is None else labelled, slots)
    host, path = host_and_path(F.col(url_column))
    parsed = pages.withColumns({"host": host, "path": path})
    rule, says = rule_of(F.col("host"), F.col("path"), rules)
    score = 1.0 / (1.0 + F.exp(-_margin(features(F.col("host"), F.col("path"), slots), weights, bias)))
    scored = parsed.withColumns({"rule": rule, "block_score": score})
    return scored.withColumn("verdict", F.coalesce(says, F.when(F.col("block_score") > 0.5, "block").otherwise("allow")))
