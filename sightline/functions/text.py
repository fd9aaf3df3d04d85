"""Cleaning and parsing of text cells."""

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values: characters that count as blank ------------------------------
WHITESPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip(c: Column) -> Column:
    """Remove blank characters at both ends."""
    return F.btrim(c, F.lit(WHITESPACE))


def clean(c: Column) -> Column:
    """Stripped text, or null when nothing is left."""
    return F.nullif(strip(c), F.lit(""))


def text_or(c: Column, fallback) -> Column:
    """``c`` unless it is null or empty."""
    fallback = fallback if isinstance(fallback, Column) else F.lit(fallback)
    return F.coalesce(F.nullif(c, F.lit("")), fallback)


def literal_map(pairs: dict) -> Column:
    """A constant map.  Looking a key up names the key once, where a CASE would
    repeat it in every branch; pushed-down predicates stay small that way."""
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def parse_bool(c: Column) -> Column:
    """true/1/yes and false/0/no in any case; anything else is null."""
    known = {"true": True, "1": True, "yes": True, "false": False, "0": False, "no": False}
    return F.try_element_at(literal_map(known), F.lower(strip(c)))


def pipe_list(c: Column) -> Column:
    """``a | b`` to an array of stripped, non-empty items; null gives an empty array."""
    items = F.filter(F.transform(F.split(c, "[|]"), strip), lambda x: x != "")
    return F.coalesce(items, F.array().cast("array<string>"))


def tag_map(c: Column) -> Column:
    """``k:v | k`` to a map: split at the first colon, no colon gives '', last key wins."""
    pair = lambda item: F.struct(
        strip(F.substring_index(item, ":", 1)).alias("key"),
        F.when(
            F.contains(item, F.lit(":")), strip(F.substr(item, F.locate(":", item) + F.lit(1)))
        ).otherwise("").alias("value"),
    )
    empty = F.array().cast("array<struct<key:string,value:string>>")
    put = lambda kept, p: F.concat(F.filter(kept, lambda k: k["key"] != p["key"]), F.array(p))
    return F.map_from_entries(F.aggregate(F.transform(pipe_list(c), pair), empty, put))


def compliance(c: Column) -> Column:
    """Compliance cell to ``struct(values, parsed)``.

    Items come from the pipe split.  A cell of separators only is kept as one
    unparsed item; a missing cell is an empty, unparsed list.
    """
    items = pipe_list(c)
    return (
        F.when(c.isNull(), F.struct(items.alias("values"), F.lit(False).alias("parsed")))
        .when(F.size(items) > 0, F.struct(items.alias("values"), F.lit(True).alias("parsed")))
        .otherwise(F.struct(F.array(strip(c)).alias("values"), F.lit(False).alias("parsed")))
    )


# A whole script or style element keeps its raw content; comments and tags go;
# whatever is left open at the end of the text goes too.
_MARKUP = (
    r"(?is)<script\b[^>]*>(.*?)</script\s*>"
    r"|<style\b[^>]*>(.*?)</style\s*>"
    r"|<!--.*?-->"
    r"|<(?:script|style)\b[^>]*>.*\z"
    r"|<!--.*\z"
    r"""|<[a-z/!?][^>"']*+(?:(?:"[^"]*+"|'[^']*+')[^>"']*+)*+>"""
    r"|<[a-z/!?][^>]*(?:>|\z)"
)
_POLICY_BADGES = r"""(?is)<div[^>]*class=['"]policy-indicators['"][^>]*>.*?</div>"""

# --- fixed values: entities decoded in the JVM; the ampersand must be last -----
COMMON_ENTITIES = {
    "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'",
    "&nbsp;": "\xa0", "&copy;": "\xa9", "&middot;": "\xb7", "&amp;": "&",
}


@F.pandas_udf(T.StringType())
def _unescape(s: pd.Series) -> pd.Series:
    return s.map(html.unescape, na_action="ignore")


def decode_entities(c: Column) -> Column:
    """Decode character references.

    Texts with only the common references stay in the JVM.  The Python worker
    sees a null for those and the text only when a rarer reference is left.
    """
    common = c
    for name, char in COMMON_ENTITIES.items():
        common = F.replace(common, F.lit(name), F.lit(char))
    known = "|".join(n.strip("&;") for n in COMMON_ENTITIES)
    rare = F.regexp_replace(c, f"&(?:{known});", "").rlike(r"&(?:#[0-9xX]|[A-Za-z][A-Za-z0-9]+)")
    return F.coalesce(_unescape(F.when(rare, c)), common)


def strip_html(c: Column, decode: bool = True) -> Column:
    """Text content of an HTML fragment, without the policy badge block."""
    text = F.regexp_replace(F.regexp_replace(c, _POLICY_BADGES, ""), _MARKUP, "$1$2")
    text = decode_entities(text) if decode else text
    return F.coalesce(strip(text), F.lit(""))


def instance_count(details: Column) -> Column:
    """First ``<number> <word>(s)`` in the text, at least 1; 1 when there is none."""
    digits = F.regexp_extract(F.coalesce(details, F.lit("")), r"(?U)\b(\d+)\s+\w+\(s\)", 1)
    return F.greatest(F.coalesce(digits.try_cast("int"), F.lit(1)), F.lit(1))


def sanitise_cell(c: Column) -> Column:
    """Stripped cell text; a leading formula sign is moved behind a space."""
    v = F.coalesce(strip(c), F.lit(""))
    return F.when(v.rlike(r"^[=+\-@]"), F.concat(F.lit(" "), v)).otherwise(v)


def client_slug(c: Column) -> Column:
    """Folder name of a client for resource reports."""
    v = F.translate(F.lower(strip(c)), " /", "__")
    return text_or(F.left(v, F.lit(40)), "default")


def client_folder(c: Column) -> Column:
    """Folder name of a client for control reports."""
    v = F.regexp_replace(strip(c), r"(?U)\s+", "_")
    v = F.regexp_replace(v, r"(?U)[^\w\-.]", "")
    return text_or(F.btrim(F.regexp_replace(v, "_+", "_"), F.lit("_")), "output")


def quoted_list(values) -> str:
    """A list as it is written in reasons and messages: ``['a', 'b']``."""
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def quoted_array(c: Column) -> Column:
    """Column form of :func:`quoted_list`."""
    return F.concat(
        F.lit("["),
        F.array_join(F.transform(c, lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", "),
        F.lit("]"),
    )
