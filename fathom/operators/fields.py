"""Report rows whose fields are not known in advance, as VARIANT: canonical texts and losses by field.

A VARIANT keeps the fields of its objects in the order of their names, at any depth, so that its JSON text is canonical. Numbers are compared by value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bags import bag_minus

#: Fields that are part of the key and not of a row's value.
KEY_FIELDS = ("fn",)


def canonical(text: Column) -> Column:
    """A JSON text with sorted keys and without white space; null where it is no JSON."""
    return F.to_json(F.try_parse_json(text))


def wide_value(row: Column, without: tuple[str, ...] = KEY_FIELDS) -> Column:
    """The canonical text of all fields of a VARIANT object but some; null where it is no object."""
    fields = F.try_variant_get(row, "$", "map<string,variant>")
    names = F.array_sort(F.filter(F.map_keys(fields), lambda k: ~k.isin(*without)))
    quoted = lambda k: F.to_json(k.cast("variant"))
    return F.concat(F.lit("{"), F.array_join(F.transform(names, lambda k: F.concat(quoted(k), F.lit(":"), F.coalesce(F.to_json(fields[k]), F.lit("null")))), ","), F.lit("}"))


def narrow_value(row: Column, fields: list[str]) -> Column:
    """The canonical text of some fields, absent ones as null."""
    part = lambda f: F.concat(F.to_json(F.lit(f).cast("variant")), F.lit(":"), F.coalesce(F.to_json(F.try_variant_get(row, f"$['{f}']", "variant")), F.lit("null")))
    return F.concat(F.lit("{"), F.concat_ws(",", *[part(f) for f in sorted(fields)]), F.lit("}"))


def field_elements(df: DataFrame, key: list[str], row: str, without: tuple[str, ...] = KEY_FIELDS) -> DataFrame:
    """(key.., field, element), one row for each element of an array and one for any other value, as canonical text. Rows that are no objects have no fields."""
    fields = F.try_variant_get(F.col(row), "$", "map<string,variant>")
    rows = df.select(*key, F.explode(fields).alias("field", "value")).filter(~F.col("field").isin(*without))
    each = F.coalesce(F.try_variant_get("value", "$", "array<variant>"), F.array("value"))
    return rows.select(*key, "field", F.explode(each).alias("e")).select(*key, "field", F.coalesce(F.to_json("e"), F.lit("null")).alias("element"))


def field_losses(pre: DataFrame, post: DataFrame, key: list[str], row: str = "row") -> DataFrame:
    """pre and post (key.., row: VARIANT) -> (field, keys, elements): what every field lost, whatever fields there are. An array is a bag of its elements, summed up over the rows
    of a key; any other value is one element; a key that is gone loses all."""
    lost = bag_minus(field_elements(pre, key, row), field_elements(post, key, row), [*key, "field", "element"]).filter("gone > 0")
    by_key = lost.groupBy(*key, "field").agg(F.sum("gone").alias("gone"))
    return by_key.groupBy("field").agg(F.count("*").alias("keys"), F.sum("gone").alias("elements"))
