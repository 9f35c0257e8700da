"""Deterministic ids: a prefix and the name-based UUID (version 5) of a key, by built-in functions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The namespace number of each kind of id.  A work refers to topics by category id, in a namespace of its own.
NAMESPACES = {"org": 1, "author": 2, "work": 3, "topic": 3, "topic_ref": 4}


def stable_id(kind: str, key: Column) -> Column:
    """``<kind>_<uuid>`` of ``key``; topics go by trimmed lower-case name, references to topics by category id.  Null: null."""
    name = F.lower(F.trim(key)) if kind == "topic" else key.cast("string")
    space = f"{NAMESPACES[kind]:032x}"
    h = F.sha1(F.concat(F.unhex(F.lit(space)), F.encode(name, "UTF-8")))
    variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    groups = (F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))
    return F.concat(F.lit(f"{kind.split('_')[0]}_"), F.concat_ws("-", *groups), F.when(name.isNotNull(), F.lit("")))
