"""Benchmark decontamination by template windows, also for questions asked again with other values.

Texts become token templates: numbers, names and units turn into typed placeholders, punctuation goes, case is
folded.  Windows of template tokens of the documents are hash-joined with those of the benchmark.  A match is
checked token by token, and its slots must be consistent: where the benchmark repeats a value, the document
repeats one too.  Beside the templates, windows of the folded words themselves are joined: a copied window counts
whatever its values and wherever its first word stands.  Everything is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.session import materialise

WIDTH = 13
#: Template tokens other than placeholders that a benchmark window needs to match with other values, out of ``WIDTH``.
MIN_LITERALS = 8
#: Benchmark items with fewer tokens are not looked for, unless the caller asks for them: they cannot be told from common phrases.
MIN_ITEM_TOKENS = 5
#: Benchmark windows up to this number (about 50 MB) are broadcast; more are joined by a shuffle.
BROADCAST_WINDOWS = 500_000

NUMBER, NAME, UNIT = "⟨number⟩", "⟨name⟩", "⟨unit⟩"
NUMBER_WORDS = (
    "two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen "
    "twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen half twice"
).split()
UNITS = (
    "mm cm dm m km inch inches foot feet yard yards mile miles metre metres meter meters kilometre kilometres kilometer kilometers "
    "mg g kg t gram grams kilogram kilograms ton tons tonne tonnes ounce ounces pound pounds ml l litre litres liter liters gallon gallons "
    "second seconds minute minutes hour hours day days week weeks month months year years mph kph percent degree degrees "
    "cent cents dollar dollars euro euros watt watts volt volts joule joules newton newtons"
).split()

_MARK = "\ue000"  # private-use character before a name


def marked_text(text: Column) -> Column:
    """The text with single spaces, without punctuation, and a mark before each name: a word that starts
    with a capital but not a sentence."""
    # only white space other than a single space is replaced
    text = F.regexp_replace(F.replace(text, F.lit(_MARK), F.lit("")), r"[\x09-\x0D][\x20\x09-\x0D]*+|\x20[\x20\x09-\x0D]++", " ")
    text = F.regexp_replace(text, r"([^.!?: ] )(?=\p{Lu})", f"$1{_MARK}")
    return F.regexp_replace(text, rf"[^\p{{L}}\p{{M}}\p{{N}}{_MARK} ]++", "")


def _tokens(text: Column) -> Column:
    return F.filter(F.split(text, " "), lambda t: t != "")


def _words(marked: Column) -> Column:
    """The folded words of a marked text, as many as its template has tokens."""
    return _tokens(F.lower(F.replace(marked, F.lit(_MARK), F.lit(""))))


def template_tokens(marked: Column) -> Column:
    """The tokens of a marked text with placeholders; they are as many as its words."""
    def token(t: Column, word: Column) -> Column:
        return (
            F.when(t.rlike("[0-9]"), NUMBER).when(t.startswith(_MARK), NAME)
            .when(word.isin(*NUMBER_WORDS), NUMBER).when(word.isin(*UNITS), UNIT).otherwise(word)
        )

    return F.zip_with(_tokens(marked), _words(marked), token)


def windows(tokens: Column, width: int) -> Column:
    """Hash of each window of ``width`` token hashes, by the place of its first token."""
    last = F.size(tokens) - width + 1
    return F.when(last > 0, F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.slice(tokens, i, width))))


def _hashes(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: F.xxhash64(t))


def _is_slot(token: Column) -> Column:
    return token.startswith("⟨")


def benchmark_windows(
    benchmark: DataFrame, id_column: str, text_column: str, width: int, min_literals: int, min_item_tokens: int = MIN_ITEM_TOKENS,
) -> DataFrame:
    """(h, v, enough, width, item_id, item_at, template, raw, item_windows) of the benchmark; short items are one window.

    ``h`` and ``v`` are the hashes of the template and of the words, ``enough`` says that the template has
    ``min_literals``.
    """
    items = benchmark.select(F.col(id_column).alias("item_id"), marked_text(F.col(text_column)).alias("marked"))
    items = items.select("item_id", _words(F.col("marked")).alias("raw"), template_tokens(F.col("marked")).alias("template"))
    items = items.where(F.size("template") >= max(1, min_item_tokens)).withColumn("width", F.least(F.size("template"), F.lit(width)))
    placed = items.select("*", F.explode(F.sequence(F.lit(1), F.size("template") - F.col("width") + 1)).alias("item_at"))
    cut = placed.select(
        "item_id", "item_at", "width", F.slice("template", F.col("item_at"), F.col("width")).alias("template"),
        F.slice("raw", F.col("item_at"), F.col("width")).alias("raw"), (F.size("template") - F.col("width") + 1).alias("item_windows"),
    )
    literals = F.size(F.filter("template", lambda t: ~_is_slot(t)))
    enough = literals * width >= F.col("width") * min_literals
    return cut.select(F.xxhash64(_hashes(F.col("template"))).alias("h"), F.xxhash64(_hashes(F.col("raw"))).alias("v"), enough.alias("enough"), "*")


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id",
    item_text_column: str = "text", width: int = WIDTH, min_literals: int = MIN_LITERALS, broadcast_windows: int = BROADCAST_WINDOWS,
    partial_copies: bool = False, min_item_tokens: int = MIN_ITEM_TOKENS,
) -> DataFrame:
    """(id, item_id, n_windows, n_exact, item_windows, occurrences, reparameterised): each benchmark item a document holds.

    An occurrence is an alignment of document and item with at least one window and consistent slots.  With
    ``partial_copies`` an alignment with inconsistent slots is one too, if windows of it are copied word for
    word; only these are counted.
    ``n_windows`` and ``n_exact`` count the windows of the fullest occurrence, all and those with the item's
    own values; ``reparameterised`` says that no occurrence has the item's own values throughout.  Null texts
    hold nothing.  Items of fewer tokens than ``width`` are one window, items under
    ``min_item_tokens`` are ignored.
    Rows that share an id count as one document, so do rows without id.  Other columns are ignored.
    """
    items = materialise(benchmark_windows(benchmark, item_column, item_text_column, width, min_literals, min_item_tokens), "benchmark_windows")
    small = items.count() <= broadcast_windows
    widths = [r.width for r in items.select("width").distinct().collect()] or [width]  # at most ``width`` values
    texts = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).where("text IS NOT NULL")

    def side(frame: DataFrame) -> DataFrame:
        return F.broadcast(frame) if small else frame

    marked = texts.select("id", marked_text(F.col("text")).alias("marked"))
    hashes = marked.select("id", _hashes(template_tokens(F.col("marked"))).alias("h"), _hashes(_words(F.col("marked"))).alias("v"))
    suspects = None
    for w in widths:
        own = items.where(F.col("width") == w)
        keys = own.where("enough").select("h").union(own.select("v")).distinct()
        both = F.concat(windows(F.col("h"), w), windows(F.col("v"), w))
        hits = hashes.select("id", F.explode(both).alias("h")).join(side(keys), "h", "left_semi").select("id").distinct()
        suspects = hits if suspects is None else suspects.union(hits)
    suspects = materialise(suspects.distinct(), "suspects").withColumnRenamed("id", "suspect")

    # only suspects are read again, to compare tokens and slots
    again = texts.join(suspects, F.col("id").eqNullSafe(F.col("suspect")), "left_semi").select("id", marked_text(F.col("text")).alias("marked"))
    tokens = again.select("id", _words(F.col("marked")).alias("raw"), template_tokens(F.col("marked")).alias("template"))
    # hashes are columns, as an expression inside windows() would be evaluated at every place
    tokens = materialise(tokens.select("*", _hashes(F.col("template")).alias("h"), _hashes(F.col("raw")).alias("v")), "suspect_tokens")
    matches = None
    for w in widths:
        own = side(items.where(F.col("width") == w))
        keys = F.arrays_zip(windows(F.col("h"), w).alias("h"), windows(F.col("v"), w).alias("v"))
        placed = tokens.select("id", "raw", "template", F.posexplode(keys).alias("at", "key"))
        cut = placed.select("id", "at", "key.h", "key.v", *[F.slice(c, F.col("at") + 1, w).alias(f"doc_{c}") for c in ("raw", "template")])
        copied = cut.drop("h").join(own.drop("h"), "v").where("doc_raw = raw")
        again = cut.drop("v").join(own.where("enough").drop("v"), "h").where("doc_template = template AND doc_raw <> raw")
        for found in (copied.drop("v").withColumn("copy", F.lit(True)), again.drop("h").withColumn("copy", F.lit(False))):
            matches = found if matches is None else matches.unionByName(found)
    slots = F.filter(F.arrays_zip(F.col("template").alias("t"), F.col("raw").alias("was"), F.col("doc_raw").alias("now")), lambda x: _is_slot(x["t"]))
    # values of windows with few literals do not speak against an alignment
    shifted = matches.select("id", "item_id", "item_windows", (F.col("at") - F.col("item_at")).alias("shift"), "copy", F.when(F.col("enough"), slots).alias("slots"))
    aligned = shifted.groupBy("id", "item_id", "item_windows", "shift").agg(
        F.count("*").alias("n"), F.count_if("copy").alias("exact"), F.array_distinct(F.flatten(F.collect_set("slots"))).alias("values")
    )  # at most item_windows rows each
    originals = F.array_distinct(F.transform("values", lambda x: F.struct(x["t"], x["was"])))
    agrees = F.size(originals) == F.size("values")
    if partial_copies:
        aligned = aligned.where(agrees | (F.col("exact") > 0)).withColumn("n", F.when(agrees, F.col("n")).otherwise(F.col("exact")))
    else:
        aligned = aligned.where(agrees)
    return aligned.groupBy(F.col("id").alias(id_column), "item_id", "item_windows").agg(
        F.max("n").alias("n_windows"), F.max("exact").alias("n_exact"), F.count("*").alias("occurrences"),
        F.every(F.col("exact") < F.col("n")).alias("reparameterised"),
    )
