"""JSON objects as text: told apart from other JSON and from what isn't JSON, and merged with their types kept."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_MAP = "map<string, variant>"


def fields_of(text: Column) -> Column:
    """The fields of a JSON object as a map of variants; null for null and for anything else."""
    return F.try_parse_json(text).try_cast(_MAP)


def json_kind(text: Column) -> Column:
    """absent (null), object, value (JSON, but no object) or bad (no JSON, or an object with a key twice).

    As Spark's parser does, what stands behind a first whole value is passed over.
    """
    parsed = F.try_parse_json(text)
    return F.when(text.isNull(), "absent").when(parsed.isNull(), "bad").when(parsed.try_cast(_MAP).isNotNull(), "object").otherwise("value")


def object_text(fields: Column) -> Column:
    """A map of variants as JSON, keys in order."""
    return F.to_json(F.try_parse_json(F.to_json(fields)))


def merged_json(left: Column, right: Column) -> Column:
    """Shallow merge of two JSON objects (null: empty), the right one wins; numbers, nested values and nulls stay what they are.

    Null where either is neither an object nor null: json_kind tells which.
    """
    none = F.create_map().cast(_MAP)
    a, b = (F.when(x.isNull(), none).otherwise(fields_of(x)) for x in (left, right))
    return object_text(F.map_concat(F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k)), b))
