"""The scalar functions as SQL functions: temporary SQL functions, which the optimizer inlines, so no Python runs."""

from __future__ import annotations

from pyspark.sql import SparkSession

_V = "ARRAY<DOUBLE>"
_PRODUCT = "aggregate(zip_with({a}, {b}, (x, y) -> x * y), 0D, (s, x) -> s + x)"
_DOT = f"CASE WHEN size(a) = size(b) THEN {_PRODUCT.format(a='a', b='b')} ELSE 0D END"
_NORM = f"sqrt({_PRODUCT.format(a='a', b='a')})"
_TOKENS = r"""filter(transform(split(lower(t), '[\\p{IsWhite_Space}\\p{Punct}]+'), x -> regexp_replace(x, '^[^\\p{IsAlphabetic}\\p{N}]+|[^\\p{IsAlphabetic}\\p{N}]+$', '')), x -> octet_length(x) > 1)"""

#: Name -> (parameters, result, body).
FUNCTIONS: dict[str, tuple[str, str, str]] = {
    "vec_dot": (f"a {_V}, b {_V}", "DOUBLE", _DOT),
    "vec_norm": (f"a {_V}", "DOUBLE", _NORM),
    "vec_norm_squared": (f"a {_V}", "DOUBLE", _PRODUCT.format(a="a", b="a")),
    "vec_l2": (f"a {_V}, b {_V}", "DOUBLE", "CASE WHEN size(a) = size(b) THEN sqrt(aggregate(zip_with(a, b, (x, y) -> (x - y) * (x - y)), 0D, (s, x) -> s + x)) ELSE double('infinity') END"),
    "vec_cosine": (f"a {_V}, b {_V}", "DOUBLE", "CASE WHEN size(a) = size(b) AND vec_norm(a) * vec_norm(b) > 0 THEN vec_dot(a, b) / (vec_norm(a) * vec_norm(b)) ELSE 0D END"),
    "vec_normalize": (f"a {_V}", _V, "transform(array(vec_norm(a)), n -> transform(a, x -> CASE WHEN n > 1.1920928955078125e-07 THEN x / n ELSE x END))[0]"),
    "vec_add": (f"a {_V}, b {_V}", _V, "zip_with(a, b, (x, y) -> x + y)"),
    "vec_subtract": (f"a {_V}, b {_V}", _V, "zip_with(a, b, (x, y) -> x - y)"),
    "vec_scale": (f"a {_V}, k DOUBLE", _V, "transform(a, x -> x * k)"),
    "text_tokens": ("t STRING", "ARRAY<STRING>", _TOKENS),
    "text_contains": ("t STRING, part STRING", "BOOLEAN", "coalesce(contains(t, part), false)"),
    "json_text": ("j STRING, path STRING", "STRING", "get_json_object(j, path)"),
    "json_number": ("j STRING, path STRING", "DOUBLE", "try_cast(get_json_object(j, path) AS DOUBLE)"),
}


def register(spark: SparkSession) -> list[str]:
    """Create the functions in this session; returns their names. Later ones use earlier ones."""
    for name, (parameters, result, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    return list(FUNCTIONS)
