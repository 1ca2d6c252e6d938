"""JSON texts as pipe-delimited tables, field selections and one-line parameter lists.

Keys keep the order of the text. Everything is a Column expression but `compact`, an Arrow function, since Spark's own
writer sorts keys.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Short names of JSON Schema types, and caps.
TYPES = {"string": "str", "integer": "int", "number": "num", "boolean": "bool", "object": "obj"}
MAX_ITEMS, UNIFORM_ITEMS, MAX_ENUM, MAX_LIST = 50, 5, 5, 3
MORE = "|…"


def items(text: Column) -> Column:
    """Elements of a JSON array as texts; null if it is none."""
    return F.when(F.json_array_length(text).isNotNull(), F.from_json(text, "array<string>"))


def keys(text: Column) -> Column:
    """Keys of a JSON object in order; null if it is none."""
    return F.json_object_keys(text)


def is_object(text: Column) -> Column:
    return keys(text).isNotNull()


def is_uniform(elements: Column) -> Column:
    """Whether the first elements are objects with the same keys."""
    sets = F.transform(F.slice(elements, 1, UNIFORM_ITEMS), lambda x: F.array_sort(keys(x)))
    return (F.size(elements) > 0) & (F.size(F.array_distinct(sets)) == 1) & ~F.exists(sets, lambda k: k.isNull())


def cell(value: Column) -> Column:
    """A value's text in a table: null is empty, bars are replaced, nested values are summarised."""
    plain = F.regexp_replace(F.regexp_replace(value, r"^(-?\d+)\.0$", "$1"), r"\|", "¦")
    n = F.json_array_length(value)
    listed = F.when(n <= MAX_LIST, F.array_join(F.transform(F.from_json(value, "array<string>"), lambda x: F.coalesce(x, F.lit(""))), ",")).otherwise(F.concat(F.lit("["), n.cast("string"), F.lit(" items]")))
    fields = F.concat(F.lit("{"), F.size(keys(value)).cast("string"), F.lit(" fields}"))
    return F.when(value.isNull(), F.lit("")).when(value.rlike(r"^\s*\[") & n.isNotNull(), listed).when(value.rlike(r"^\s*\{") & is_object(value), fields).otherwise(plain)


def table(elements: Column, max_items: int = MAX_ITEMS) -> Column:
    """Objects as a header line and a line each; says how many were left out."""
    shown = F.slice(elements, 1, max_items)
    header = keys(shown[0])

    def row(x: Column) -> Column:
        values = F.from_json(x, "map<string,string>")
        return F.array_join(F.transform(header, lambda k: cell(F.try_element_at(values, k))), "|")

    more = F.when(F.size(elements) > max_items, F.array(F.concat(F.lit("... +"), (F.size(elements) - max_items).cast("string"), F.lit(" more")))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(F.array(F.array_join(header, "|")), F.transform(shown, row), more), "\n")


def pairs(text: Column) -> Column:
    """An object as `key: value` lines."""
    values = F.from_json(text, "map<string,string>")
    return F.array_join(F.transform(keys(text), lambda k: F.concat(k, F.lit(": "), cell(F.try_element_at(values, k)))), "\n")


def sections(text: Column, max_items: int = MAX_ITEMS) -> Column:
    """An object by key: uniform arrays as tables, objects as lines under a heading, the rest as one line."""
    values = F.from_json(text, "map<string,string>")

    def section(k: Column) -> Column:
        v = F.try_element_at(values, k)
        head = F.concat(F.lit("["), k, F.lit("]\n"))
        array = F.when(v.rlike(r"^\s*\["), items(v))
        return F.when(array.isNotNull() & is_uniform(array), F.concat(head, table(array, max_items), F.lit("\n"))).when(v.rlike(r"^\s*\{") & is_object(v), F.concat(head, pairs(v), F.lit("\n"))).otherwise(F.concat(k, F.lit(": "), cell(v)))

    return F.regexp_replace(F.array_join(F.transform(keys(text), section), "\n"), r"^\s+|\s+$", "")


@F.pandas_udf(StringType())
def compact(texts: pd.Series) -> pd.Series:
    """JSON without white space, keys in order."""

    def one(x: str | None) -> str | None:
        try:
            return None if x is None else json.dumps(json.loads(x), separators=(",", ":"), ensure_ascii=False)
        except ValueError:
            return x

    return texts.map(one)


def toon(text: Column, max_items: int = MAX_ITEMS) -> Column:
    """A JSON text as a table, sections, or compact JSON; other text as it is."""
    elements = items(text)
    return F.when(elements.isNotNull() & is_uniform(elements), table(elements, max_items)).when(is_object(text), sections(text, max_items)).otherwise(compact(text))


def select_fields(text: Column, fields: list[str]) -> Column:
    """A flat JSON object with only the listed keys, in the text's order."""
    values = F.from_json(text, "map<string,string>")
    return F.map_filter(values, lambda k, _: k.isin(fields))


def whitelist(elements: Column, fields: list[str], max_items: int = MAX_ITEMS) -> Column:
    """Objects reduced to the listed fields, as a table; cut before, so nothing is said of what is left out."""
    shown = F.slice(elements, 1, max_items)
    header = F.filter(keys(shown[0]), lambda k: k.isin(fields))

    def row(x: Column) -> Column:
        values = F.from_json(x, "map<string,string>")
        return F.array_join(F.transform(header, lambda k: cell(F.try_element_at(values, k))), "|")

    return F.array_join(F.concat(F.array(F.array_join(header, "|")), F.transform(shown, row)), "\n")


def type_hint(definition: Column, depth: int = 3) -> Column:
    """A JSON Schema type in a few characters; arrays nest up to `depth`."""
    kind, options = F.get_json_object(definition, "$.type"), F.from_json(F.get_json_object(definition, "$.enum"), "array<string>")
    listed = F.array_join(F.slice(options, 1, MAX_ENUM), "|")
    inner = F.concat(type_hint(F.get_json_object(definition, "$.items"), depth - 1), F.lit("[]")) if depth else F.lit("any[]")
    short = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in TYPES.items() for x in p]), kind), kind)
    union = F.when(kind.startswith("["), F.array_join(F.from_json(kind, "array<string>"), "|"))
    return F.when(options.isNotNull(), F.when(F.size(options) > MAX_ENUM, F.concat(listed, F.lit(MORE))).otherwise(listed)).when(union.isNotNull(), union).when(kind == "array", inner).when(kind.isNotNull(), short).otherwise(F.lit("any"))


def parameters(schema: Column) -> Column:
    """`a:str, [b:int]` for a JSON Schema of an object; brackets mark what is optional."""
    properties = F.get_json_object(schema, "$.properties")
    required = F.coalesce(F.from_json(F.get_json_object(schema, "$.required"), "array<string>"), F.array().cast("array<string>"))
    values = F.from_json(properties, "map<string,string>")

    def one(k: Column) -> Column:
        piece = F.concat(k, F.lit(":"), type_hint(F.try_element_at(values, k)))
        return F.when(F.array_contains(required, k), piece).otherwise(F.concat(F.lit("["), piece, F.lit("]")))

    return F.coalesce(F.array_join(F.transform(keys(properties), one), ", "), F.lit(""))
