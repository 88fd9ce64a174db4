"""What a model replied, read as far as it can be read."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What may stand in front of a name in a list.
LIST_LINE = r"^\s*(?:\d+[.)]\s*)?(?:\[(?:alias|embedding)\]\s*)?(.+?)\s*$"


def parsed(text: Column) -> Column:
    """The JSON of a reply as a variant: the whole, the inside of its first fence, or from the first brace to the last; null if none can be read."""
    t = F.trim(F.coalesce(text, F.lit("")))
    fence = F.regexp_extract(t, r"(?s)```(?:json)?\s*(.*?)```", 1)
    braces = F.regexp_extract(t, r"(?s)\{.*\}", 0)
    return F.coalesce(*[F.try_parse_json(F.nullif(x, F.lit(""))) for x in (t, fence, braces)])


def _names(value: Column, path: str) -> Column:
    many, one = F.try_variant_get(value, path, "array<string>"), F.try_variant_get(value, path, "string")
    return F.coalesce(many, F.when(one.isNotNull() & ~F.startswith(one, F.lit("{")), F.array(one)))


def kept_names(reply: Column, allowed: Column) -> Column:
    """Names of a reply that are allowed, in order and once: by keep or else seeds of an object, by a list, or by lines; a name may differ behind its slash."""
    value, text = parsed(reply), F.trim(F.coalesce(reply, F.lit("")))
    is_object = F.startswith(F.schema_of_variant(value), F.lit("OBJECT"))
    listed = F.when(is_object, F.coalesce(_names(value, "$.keep"), _names(value, "$.seeds"))).otherwise(F.try_variant_get(value, "$", "array<string>"))
    plain = lambda names: F.filter(F.transform(names, F.trim), lambda n: n != "")
    none = F.array().cast("array<string>")
    listed = plain(F.coalesce(listed, none))
    lines = F.transform(F.split(text, r"\r?\n"), lambda x: F.btrim(F.regexp_extract(x, LIST_LINE, 1), F.lit("\"' ")))
    names = F.when(F.size(listed) > 0, listed).otherwise(F.when(text == "", none).otherwise(plain(lines)))
    zh = lambda n: F.trim(F.split(n, "/")[0])
    hit = lambda n: F.when(F.array_contains(allowed, n), n).otherwise(F.get(F.filter(allowed, lambda a: zh(a) == zh(n)), F.lit(0)))
    return F.array_distinct(F.filter(F.transform(names, hit), lambda n: n.isNotNull()))


def verdicts(reply: Column) -> Column:
    """(index, item) of a validation reply: the objects of its results that have a whole number as index."""
    items = F.coalesce(F.try_variant_get(parsed(reply), "$.results", "array<variant>"), F.array().cast("array<variant>"))
    rows = F.transform(items, lambda v: F.struct(F.try_variant_get(v, "$.index", "int").alias("index"), F.coalesce(F.try_variant_get(v, "$.action", "string"), F.when(F.try_variant_get(v, "$.pass", "boolean"), "pass").otherwise("fix")).alias("action")))
    return F.filter(rows, lambda r: r["index"].isNotNull())
