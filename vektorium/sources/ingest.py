"""Requests as VARIANT values: typed where they fit, told why where they don't."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import instant
from ..schema import REQUEST

#: Strings of the request that must be times.
TIMES = ("$.transaction.requested_at", "$.last_transaction.timestamp")
#: What a request may lack: a path of its own, or all below a path that is null or absent.
OPTIONAL = ("$.id", "$.last_transaction")
_NUMBER = "^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL.*)$"


def _leaves(schema: T.StructType, at: str = "$") -> list[tuple[str, T.DataType]]:
    out: list[tuple[str, T.DataType]] = []
    for f in schema.fields:
        path = f"{at}.{f.name}"
        out.append((path, f.dataType))
        if isinstance(f.dataType, T.StructType):
            out += _leaves(f.dataType, path)
    return out


def _fault(v: Column, path: str, kind: T.DataType) -> Column:
    """What is wrong at a path, or null."""
    here = F.variant_get(v, path, "variant")
    found = F.schema_of_variant(here)
    told = lambda what: F.lit(f"{path}: {what}")
    wrong = F.when(here.isNull(), told("missing")).when(F.is_variant_null(here), told("null"))
    if isinstance(kind, T.StructType):
        return wrong.when(~found.startswith("OBJECT"), told("no object"))
    if isinstance(kind, T.ArrayType):
        texts = F.try_variant_get(v, path, "array<variant>")
        bad = F.exists(texts, lambda x: F.coalesce(F.schema_of_variant(x) != "STRING", F.lit(True)))
        return wrong.when(~found.startswith("ARRAY"), told("no array")).when(bad, told("no array of strings"))
    if isinstance(kind, T.StringType):
        wrong = wrong.when(found != "STRING", told("no string"))
        return wrong.when(instant(F.try_variant_get(v, path, "string")).isNull(), told("no time")) if path in TIMES else wrong
    if isinstance(kind, T.BooleanType):
        return wrong.when(found != "BOOLEAN", told("no boolean"))
    if isinstance(kind, T.IntegerType):
        wrong = wrong.when(~found.rlike(_NUMBER), told("no number"))
        whole = F.try_variant_get(v, path, "double")
        return wrong.when((whole != F.floor(whole)) | ~whole.between(-(2**31), 2**31 - 1) | ~found.rlike("INT$"), told("no whole number"))
    return wrong.when(~found.rlike(_NUMBER), told("no number"))


def ingest(bodies: DataFrame, body: str = "body", schema: T.StructType = REQUEST) -> DataFrame:
    """bodies with ``value``, the body as VARIANT, ``request``, typed by the schema, ``reason`` and ``unknown``.

    reason names the first path, in the schema's order, that is missing, null or of another type, and
    what is wrong there, or says that the body is no JSON or no object; it is null for requests that
    the features can be told of, and request is null for all others. Paths below an absent optional one are fine. unknown holds the
    top-level members that the schema doesn't name, as JSON by name; no body loses them. A null or
    empty body is no JSON.
    """
    v = F.col("value")
    faults = []
    for path, kind in _leaves(schema):
        optional = next((o for o in OPTIONAL if path == o or path.startswith(o + ".")), None)
        fault = _fault(v, path, kind)
        if optional:
            here = F.variant_get(v, optional, "variant")
            fault = F.when(here.isNotNull() & ~F.is_variant_null(here), fault)
        faults.append(fault)
    no_object = F.when(v.isNull(), F.lit("$: no JSON")).when(~F.schema_of_variant(v).startswith("OBJECT"), F.lit("$: no object"))
    held = bodies.withColumn("value", F.when(F.trim(body) != "", F.try_parse_json(body)))
    held = held.withColumn("reason", F.coalesce(no_object, *faults))
    members = F.try_variant_get(v, "$", "map<string,variant>")
    others = F.map_filter(members, lambda k, _: ~k.isin(*schema.names))
    unknown = F.coalesce(F.transform_values(others, lambda _, x: F.to_json(x)), F.create_map().cast("map<string,string>"))
    request = F.when(F.col("reason").isNull(), F.from_json(body, schema))
    return held.withColumns({"request": request, "unknown": unknown})
