"""The payload filter language, compiled to Columns.

A filter is {must, should, must_not} of conditions: {key, match: {value | any | text}}, {key, range: {gt, gte, lt, lte}},
{has_id}, {nested: {key, filter}}, a group again, the legacy {field, value, operator}, or a Column of the caller's own
(any condition over the row, null as false). match also takes contains, a case-sensitive part of a text. Logic is two-valued: null
counts as false, also under a negation. Paths are a.b.c through objects and list[].field through lists.

Two resolvers give a path its value: typed columns (comparisons stay plain predicates, so they reach the scan), and a
VARIANT or JSON-text column, where the kind of each value is looked at first.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.column import Column

_BOUNDS = {"gt": Column.__gt__, "gte": Column.__ge__, "lt": Column.__lt__, "lte": Column.__le__}


def certain(c: Column) -> Column:
    """Null is false. Needed under a negation only: a filter keeps true rows, and a bare predicate reaches the scan."""
    return F.coalesce(c, F.lit(False))


def _all(parts: list[Column]) -> Column:
    return reduce(Column.__and__, parts) if parts else F.lit(True)


def _any(parts: list[Column]) -> Column:
    return reduce(Column.__or__, parts) if parts else F.lit(False)


def _kind(value: object) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, (int, float)):
        return "number"
    if isinstance(value, str):
        return "string"
    return "list" if isinstance(value, (list, tuple)) else "object"


def _text(col: Column, query: str) -> Column:
    return _any([F.contains(F.lower(col), F.lit(w.lower())) for w in query.split()])


class Typed:
    """A value of known Spark type."""

    def __init__(self, col: Column | None, kind: T.DataType | None):
        self.col, self.type = col, kind

    def _is(self) -> str:
        t = self.type
        if t is None:
            return "missing"
        if isinstance(t, T.BooleanType):
            return "bool"
        if isinstance(t, T.NumericType):
            return "number"
        if isinstance(t, T.StringType):
            return "string"
        return "list" if isinstance(t, T.ArrayType) else "object"

    def field(self, name: str) -> Typed:
        if isinstance(self.type, T.StructType) and name in self.type.fieldNames():
            return Typed(self.col[name], self.type[name].dataType)
        if isinstance(self.type, T.MapType):
            return Typed(F.try_element_at(self.col, F.lit(name)), self.type.valueType)
        return Typed(None, None)

    def element(self, name: str) -> Typed:
        """The list of `name` over this list's elements, those without it left out."""
        if not isinstance(self.type, T.ArrayType):
            return Typed(None, None)
        inner = Typed(F.lit(None), self.type.elementType).field(name)
        if inner.type is None:
            return inner
        own = self.type.elementType
        return Typed(F.filter(F.transform(self.col, lambda e: Typed(e, own).field(name).col), lambda x: x.isNotNull()), T.ArrayType(inner.type))

    def eq(self, value: object) -> Column:
        own, other = self._is(), _kind(value)
        if own == "missing":
            return F.lit(False)
        if other == "null":
            return self.col.isNull()
        if own == "list":
            kind = self.type.elementType
            return F.exists(self.col, lambda e: Typed(e, kind).eq(value) if other != "list" else _any([Typed(e, kind).eq(v) for v in value]))
        if other == "list":
            return _any([self.eq(v) for v in value])
        if own != other or own == "object":
            return F.lit(False)
        return self.col == F.lit(value)

    def any(self, values: list) -> Column:
        own = self._is()
        if own in ("number", "string", "bool") and values and all(_kind(v) == own for v in values):
            return self.col.isin(list(values))
        return _any([self.eq(v) for v in values])

    def text(self, query: str) -> Column:
        return _text(self.col, query) if self._is() == "string" else F.lit(False)

    def contains(self, part: str) -> Column:
        return F.contains(self.col, F.lit(part)) if self._is() == "string" else F.lit(False)

    def range(self, bounds: dict) -> Column:
        if self._is() != "number":
            return F.lit(False)
        given = [_BOUNDS[k](self.col, F.lit(v)) for k, v in bounds.items() if k in _BOUNDS and v is not None]
        return _all([self.col.isNotNull(), *given])

    def exists(self, body) -> Column:
        if not isinstance(self.type, T.ArrayType):
            return F.lit(False)
        kind = self.type.elementType
        return F.exists(self.col, lambda e: body(Typed(e, kind)))


_NUMBERS = r"^(BIGINT|INT|SMALLINT|TINYINT|FLOAT|DOUBLE|DECIMAL.*)$"


class Variant:
    """A VARIANT value, whose kind is known only at run time."""

    def __init__(self, col: Column):
        self.col = col

    def _kind(self) -> Column:
        return F.schema_of_variant(self.col)

    def field(self, name: str) -> Variant:
        return Variant(F.try_variant_get(self.col, f"$['{name}']" if not name.isidentifier() else f"$.{name}", "variant"))

    def _list(self) -> Column:
        return F.when(F.startswith(self._kind(), F.lit("ARRAY")), F.try_variant_get(self.col, "$", "array<variant>"))

    def element(self, name: str) -> VariantList:
        return VariantList(F.filter(F.transform(self._list(), lambda e: Variant(e).field(name).col), lambda x: x.isNotNull()))

    def _scalar(self, value: object) -> Column:
        kind, other = self._kind(), _kind(value)
        if other == "null":
            return F.is_variant_null(self.col)
        if other == "bool":
            return (kind == "BOOLEAN") & (F.try_variant_get(self.col, "$", "boolean") == F.lit(value))
        if other == "number":
            return F.rlike(kind, F.lit(_NUMBERS)) & (F.try_variant_get(self.col, "$", "double") == F.lit(float(value)))
        if other == "string":
            return (kind == "STRING") & (F.try_variant_get(self.col, "$", "string") == F.lit(value))
        return F.lit(False)

    def eq(self, value: object) -> Column:
        values = list(value) if _kind(value) == "list" else [value]
        inside = F.exists(self._list(), lambda e: _any([Variant(e)._scalar(v) for v in values]))
        return _any([self._scalar(v) for v in values]) | inside

    def any(self, values: list) -> Column:
        return _any([self.eq(v) for v in values])

    def text(self, query: str) -> Column:
        return (self._kind() == "STRING") & _text(F.try_variant_get(self.col, "$", "string"), query)

    def contains(self, part: str) -> Column:
        return (self._kind() == "STRING") & F.contains(F.try_variant_get(self.col, "$", "string"), F.lit(part))

    def range(self, bounds: dict) -> Column:
        n = F.try_variant_get(self.col, "$", "double")
        given = [_BOUNDS[k](n, F.lit(float(v))) for k, v in bounds.items() if k in _BOUNDS and v is not None]
        return F.rlike(self._kind(), F.lit(_NUMBERS)) & _all([n.isNotNull(), *given])

    def exists(self, body) -> Column:
        return F.exists(self._list(), lambda e: body(Variant(e)))


class VariantList(Variant):
    """An array of variants, as list[].field gives it."""

    def _kind(self) -> Column:
        return F.lit("ARRAY<VARIANT>")

    def _list(self) -> Column:
        return self.col

    def _scalar(self, value: object) -> Column:
        return F.lit(False)

    def text(self, query: str) -> Column:
        return F.lit(False)

    def contains(self, part: str) -> Column:
        return F.lit(False)

    def range(self, bounds: dict) -> Column:
        return F.lit(False)


def resolve(root: Typed | Variant, path: str):
    """The value at a path of root. A column of just that name comes before a path through objects."""
    if isinstance(root, Typed) and isinstance(root.type, T.StructType) and path in root.type.fieldNames():
        return root.field(path)
    path = path.removeprefix(".")
    if "[]" in path:
        before, _, after = path.partition("[]")
        name = after.lstrip(".").split(".")[0]
        value = resolve(root, before)
        return value.element(name) if name else value
    for part in path.split("."):
        root = root.field(part)
    return root


class Columns:
    """Typed resolver over a DataFrame's own columns, or over one struct column."""

    def __init__(self, schema: T.StructType, prefix: str | None = None):
        self.type, self.prefix = (schema[prefix].dataType if prefix else schema), prefix

    def root(self):
        return self

    def __call__(self, path: str):
        if self.prefix:
            return resolve(Typed(F.col(self.prefix), self.type), path)
        head = path.removeprefix(".").split(".")[0].split("[]")[0]
        if path in self.type.fieldNames():
            return Typed(F.col(f"`{path}`"), self.type[path].dataType)
        if head not in self.type.fieldNames():
            return Typed(None, None)
        rest = path.removeprefix(".")[len(head) :]
        own = Typed(F.col(f"`{head}`"), self.type[head].dataType)
        if rest.startswith("[]"):
            name = rest[2:].lstrip(".").split(".")[0]
            return own.element(name) if name else own
        return resolve(own, rest.removeprefix(".")) if rest else own


class Json:
    """Resolver over a column of JSON text or VARIANT."""

    def __init__(self, column: str, text: bool = True):
        self.col = F.try_parse_json(F.col(column)) if text else F.col(column)

    def __call__(self, path: str):
        return resolve(Variant(self.col), path)


def _groups(node: dict, condition) -> Column:
    parts = [condition(c) for c in _listed(node.get("must"))]
    if some := _listed(node.get("should")):
        parts.append(_any([condition(c) for c in some]))
    parts += [~certain(condition(c)) for c in _listed(node.get("must_not"))]
    return _all(parts)


def _listed(x: object) -> list:
    return [] if x is None else list(x) if isinstance(x, (list, tuple)) else [x]


_LEGACY = {"eq": None, "ne": None, "gt": "gt", "lt": "lt", "gte": "gte", "lte": "lte"}


def compile_filter(node: dict | None, get, id_col: str = "id") -> Column:
    """A filter as a Column. get: a resolver; id_col: the id that has_id looks at, compared as text."""
    if not isinstance(node, dict) or not node:
        return F.lit(True)
    if "field" in node and "value" in node:
        return _legacy(node, get)
    return _groups(node, lambda c: _condition(c, get, id_col))


def _legacy(node: dict, get) -> Column:
    value, op = get(node["field"]), node.get("operator", "eq")
    if op not in _LEGACY:
        return F.lit(False)
    if op == "ne":
        return ~certain(value.eq(node["value"]))
    return value.eq(node["value"]) if op == "eq" else value.range({_LEGACY[op]: node["value"]}) if _kind(node["value"]) == "number" else F.lit(False)


def _condition(node: object, get, id_col: str) -> Column:
    if isinstance(node, Column):
        return certain(node)
    if not isinstance(node, dict):
        return F.lit(False)
    if "has_id" in node:
        return F.col(id_col).cast("string").isin([str(i) for i in _listed(node["has_id"])])
    if "nested" in node:
        inner = node["nested"]
        return get(inner["key"]).exists(lambda e: _groups(inner.get("filter") or {}, lambda c: _element(c, e)))
    if {"must", "should", "must_not"} & node.keys():
        return _groups(node, lambda c: _condition(c, get, id_col))
    if "field" in node and "value" in node:
        return _legacy(node, get)
    return _field(node, get)


def _field(node: dict, get) -> Column:
    if "key" not in node:
        return F.lit(False)
    match, bounds = node.get("match"), node.get("range")
    if isinstance(match, dict):
        value = get(node["key"])
        if "value" in match:
            return value.eq(match["value"])
        if "any" in match:
            return value.any(_listed(match["any"]))
        if "text" in match:
            return value.text(str(match["text"]))
        if "contains" in match:
            return value.contains(str(match["contains"]))
    if isinstance(bounds, dict):
        return get(node["key"]).range(bounds)
    return F.lit(False)


def _element(node: object, element) -> Column:
    """A condition within nested: only match.value, and groups of it."""
    if not isinstance(node, dict):
        return F.lit(False)
    if {"must", "should", "must_not"} & node.keys():
        return _groups(node, lambda c: _element(c, element))
    match = node.get("match")
    if "key" in node and isinstance(match, dict) and "value" in match:
        return resolve(element, node["key"]).eq(match["value"])
    return F.lit(False)
