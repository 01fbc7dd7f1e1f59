"""Identifiers out of polymorphic JSON, by VARIANT: missing and null stay apart, and mixed arrays don't fail."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def extract_ids(json: Column) -> Column:
    """Ids of a relative list: of an array, the Name of its objects; of an object, its keys (numbers first, ascending); else none."""
    v = F.try_parse_json(json)
    items = F.try_variant_get(v, "$", "array<variant>")
    names = F.filter(F.transform(items, lambda x: F.try_variant_get(x, "$.Name", "string")), F.isnotnull)
    keys = F.json_object_keys(json)
    number = lambda k: k.rlike(r"^(0|[1-9][0-9]{0,9})$") & (k.try_cast("long") < (1 << 32) - 1)  # noqa: E731  an array's index
    ordered = F.concat(F.transform(F.array_sort(F.transform(F.filter(keys, number), lambda k: k.cast("long"))), lambda k: k.cast("string")), F.filter(keys, lambda k: ~number(k)))
    return F.when(F.schema_of_variant(v).startswith("ARRAY"), names).when(F.schema_of_variant(v).startswith("OBJECT"), ordered).otherwise(F.array().cast("array<string>"))


def parent_id(json: Column, path: str) -> Column:
    """A parent field, number or text, as text; null where it is missing, null, 0, "0" or ""."""
    s = F.try_variant_get(F.try_parse_json(json), path, "string")
    return F.when(~s.isin("", "0"), s)
