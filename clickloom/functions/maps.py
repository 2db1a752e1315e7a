"""Query strings, and maps of parameters."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def one_per_key(entries: Column, last: bool) -> Column:
    """A map from an array of (key, value) structs: the last or the first entry of each key stays."""
    entries = F.reverse(entries) if last else entries
    keys = F.transform(entries, lambda e: e["key"])
    return F.map_from_entries(F.filter(entries, lambda e, i: F.array_position(keys, e["key"]) == i + 1))


def decoded(text: Column) -> Column:
    """Percent-decoding that leaves "+" alone; what cannot be decoded stays."""
    return F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)


def encoded(text: Column) -> Column:
    """Percent-encoding with the unreserved characters of RFC 3986."""
    out = F.url_encode(text)
    for a, b in (("+", "%20"), ("%7E", "~"), ("*", "%2A")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def query_map(query: Column) -> Column:
    """A query string as a map: pairs without "=" go, the last of equal keys wins."""
    pairs = F.filter(F.split(F.coalesce(query, F.lit("")), "&"), lambda p: p.contains("="))
    return one_per_key(F.transform(pairs, lambda p: F.struct(decoded(F.regexp_extract(p, "^([^=]*)=", 1)).alias("key"), decoded(F.regexp_extract(p, "^[^=]*=(?s)(.*)$", 1)).alias("value"))), last=True)


def query_string(params: Column) -> Column:
    """A map as a query string, keys in order."""
    entries = F.array_sort(F.map_entries(params))
    return F.array_join(F.transform(entries, lambda e: F.concat(encoded(e["key"]), F.lit("="), encoded(e["value"]))), "&")


def lower_keys(params: Column) -> Column:
    """The map with lower-case keys; the first of equal ones stays."""
    return one_per_key(F.transform(F.map_entries(params), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value"))), last=False)


def scalars(json_object: Column) -> Column:
    """A JSON object's values as text, without nulls, arrays and objects; a string may begin with a bracket, the last of equal keys wins."""
    found = one_per_key(F.map_entries(F.from_json(json_object, "map<string,string>")), last=True)
    kinds = F.try_variant_get(F.try_parse_json(json_object), "$", "map<string,variant>")
    flat = F.map_zip_with(found, kinds, lambda k, v, kind: F.when(~F.coalesce(F.schema_of_variant(kind), F.lit("")).rlike("^(ARRAY|OBJECT)"), v))
    # an object with a repeated key has no variant
    flat = F.coalesce(flat, F.map_filter(found, lambda k, v: ~v.rlike(r"^\s*[{\[]")))
    return F.coalesce(F.map_filter(flat, lambda k, v: v.isNotNull()), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
