"""Canonical JSON, and names of stored answers made from it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of request parameters that are secret.
SECRET = ("api-key", "api_key", "apikey", "key", "subscription-key")


def quoted(text: Column) -> Column:
    """A text as JSON."""
    listed = F.to_json(F.array(text))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def canonical(text: Column) -> Column:
    """JSON without white space and with the keys of all objects in order, at any depth; equal values give equal texts.

    A VARIANT holds the fields of an object in the order of their names, so writing one out sorts them. What is no JSON, or
    repeats a key, counts as a text; null is JSON's null.
    """
    value = F.to_json(F.try_parse_json(text))
    return F.when(text.isNull(), "null").otherwise(F.coalesce(value, quoted(text)))


def public(params: Column, secret: tuple[str, ...] = SECRET) -> Column:
    """Canonical JSON of an object's parameters without those whose names, in any case, are secret; {} for none."""
    fields = F.try_variant_get(F.try_parse_json(params), "$", "map<string,variant>")
    kept = F.to_json(F.map_filter(fields, lambda name, _: ~F.lower(name).isin(*secret)))
    return F.when(params.isNull(), "{}").otherwise(canonical(F.coalesce(kept, params)))


def snapshot_ids(provider: Column, url: Column, params: Column, payload: Column) -> dict[str, Column]:
    """Names of a stored answer: of its request, of its content, and of both. Order of keys, white space and secret parameters
    change none of them."""
    request = F.concat(F.lit('{"params":'), public(params), F.lit(',"provider":'), _or_null(provider), F.lit(',"source_url":'), _or_null(url), F.lit("}"))
    request_id = F.sha2(request.cast("binary"), 256)
    content = F.sha2(canonical(payload).cast("binary"), 256)
    return {"request_id": request_id, "content_hash": content, "snapshot_id": F.sha2(F.concat_ws(":", request_id, content).cast("binary"), 256)}


def _or_null(text: Column) -> Column:
    return F.when(text.isNull(), "null").otherwise(quoted(text))
