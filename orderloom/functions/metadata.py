"""Nested metadata: objects merged key by key."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def merged(first: object, second: object) -> object:
    """Later keys win; objects under the same key are merged in the same way, without recursion into other values."""
    if not (isinstance(first, dict) and isinstance(second, dict)):
        return second
    out = dict(first)
    todo = [(out, second)]
    while todo:
        into, other = todo.pop()
        for key, value in other.items():
            if isinstance(into.get(key), dict) and isinstance(value, dict):
                into[key] = dict(into[key])
                todo.append((into[key], value))
            else:
                into[key] = value
    return out


def _parsed(text: str | None) -> dict | None:
    try:
        found = json.loads(text) if text is not None else None
    except ValueError:
        return None
    return found if isinstance(found, dict) else None


def merged_pairs(first: pd.Series, second: pd.Series) -> pd.Series:
    out = []
    for a, b in zip(first, second):
        a, b = _parsed(a), _parsed(b)
        both = merged(a, b) if a is not None and b is not None else a if b is None else b
        out.append(None if both is None else json.dumps(both, ensure_ascii=False, sort_keys=True, separators=(",", ":")))
    return pd.Series(out, dtype=object)


def merge_json(*objects: Column) -> Column:
    """JSON objects merged from left to right, as compact JSON with keys in order.

    A null in a later object replaces what was there; a null or broken object, or one that is no object, changes
    nothing, and if all are such the result is null.
    """
    merge = F.pandas_udf(merged_pairs, "string")
    out = objects[0]
    for more in objects[1:]:
        out = merge(out, more)
    return merge(out, F.lit(None).cast("string")) if len(objects) == 1 else out


def hit_metadata(cached: Column, paraphrase: Column, router: Column, queues: Column) -> Column:
    """The metadata of an answer from a cache: the cache's own with the paraphrase, the router's and the queues'. All are JSON."""
    part = lambda name, c: F.when(c.isNotNull(), F.concat(F.lit(f'{{"{name}":'), c, F.lit("}")))
    cache = F.concat(F.lit('{"cache":{"paraphrase":'), F.coalesce(paraphrase, F.lit("null")), F.lit("}}"))
    return merge_json(part("cache", cached), cache, part("router", router), part("queue_stats", queues))


def order_line(action: Column, item: Column, size: Column, quantity: Column, price: Column, sizes: Column) -> Column:
    """The metadata of a resolved order, as JSON: the line only where it waits for a yes, its size only where there is a choice of sizes."""
    line = F.when(
        action == "confirm",
        F.struct(item.alias("item"), F.when(F.size(sizes) > 1, size).alias("size"), quantity.alias("quantity"), price.alias("unit_price")),
    )
    return F.to_json(F.struct(line.alias("line"), action.alias("action"), item.alias("item"), size.alias("size"), quantity.alias("quantity"), sizes.alias("available_sizes")), {"ignoreNullFields": "false"})
