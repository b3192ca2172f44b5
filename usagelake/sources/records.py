"""Strict reading of JSON records with VARIANT columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Characters of one string; a record's own limit is lower.
MAX_STRING = 1 << 30


def parsed(raw: str = "raw") -> Column:
    """The record under ``$.r``; NULL unless the text is exactly one JSON value.

    The record is wrapped as the first of two elements, the second being a number made from the record itself.
    Text that closes the wrapper early cannot also bring that number as the second and last element, so trailing
    text of any form is an error, which the parser would otherwise ignore.
    """
    seal = f"xxhash64({raw}, 7)"
    whole = f"""from_json(concat('{{"a":[', {raw}, ',', {seal}, ']}}'), 'variant', map('mode', 'PERMISSIVE', 'maxStringLen', '{MAX_STRING}'))"""
    sealed = f"try_variant_get(w, '$.a[1]', 'bigint') = {seal} AND try_variant_get(w, '$.a[2]', 'variant') IS NULL"
    # Through an array of one, so that a record is parsed once.
    return F.expr(f"element_at(transform(array({whole}), w -> CASE WHEN {sealed} THEN w END), 1)")


def typed(path: str, v: str = "v") -> Column:
    """Type of the member: OBJECT<...>, ARRAY<...>, STRING, BIGINT, VOID, or NULL when absent."""
    return F.expr(f"schema_of_variant(try_variant_get({v}, '$.a[0]{path}', 'variant'))")


def get(path: str, to: str = "string", v: str = "v") -> Column:
    return F.expr(f"try_variant_get({v}, '$.a[0]{path}', '{to}')")


def text(path: str, v: str = "v") -> Column:
    """A string member, '' when absent or null."""
    return F.coalesce(get(path, "string", v), F.lit(""))


def _is(path: str, *kinds: str, v: str = "v") -> Column:
    found = typed(path, v)
    ok = found.isNull() | (found == "VOID")
    for kind in kinds:
        ok = ok | found.startswith(kind)
    return ok


def strings_ok(*paths: str, v: str = "v") -> Column:
    """Members are strings, null or absent."""
    ok = F.lit(True)
    for path in paths:
        ok = ok & _is(path, "STRING", v=v)
    return ok


def integers_ok(*paths: str, v: str = "v") -> Column:
    """Members are whole numbers that fit, null or absent."""
    ok = F.lit(True)
    for path in paths:
        ok = ok & _is(path, "BIGINT", v=v)
    return ok


def objects_ok(*paths: str, v: str = "v") -> Column:
    ok = F.lit(True)
    for path in paths:
        ok = ok & _is(path, "OBJECT", v=v)
    return ok


def block_text(path: str, v: str = "v") -> Column:
    """Text of a message: a string, or the joined ``text`` of its blocks."""
    kind = typed(path, v)
    items = get(path, "array<variant>", v)

    def sound(item: Column) -> Column:
        shape = F.schema_of_variant(item)
        inner = F.schema_of_variant(F.try_variant_get(item, "$.text", "variant"))
        return (shape == "VOID") | (shape.startswith("OBJECT") & (inner.isNull() | inner.isin("STRING", "VOID")))

    joined = F.array_join(F.transform(items, lambda i: F.coalesce(F.try_variant_get(i, "$.text", "string"), F.lit(""))), "")
    return F.coalesce(
        F.when(kind == "STRING", get(path, "string", v))
        .when(kind.startswith("ARRAY") & F.coalesce(F.forall(items, sound), F.lit(False)), joined), F.lit(""))
