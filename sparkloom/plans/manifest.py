"""The declarative model layer: dataclasses, loading from JSON, validation, types."""

from __future__ import annotations

import base64
import json
import re
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import types as T

from sparkloom.functions.registry import translate

LATEST_LAYOUT = 3


class ManifestError(ValueError):
    """A manifest that cannot be used; ``code`` says why."""

    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code


#: Manifest type names by Spark type.
TYPE_NAMES: dict[T.DataType, tuple[str, ...]] = {
    T.BooleanType(): ("bool", "boolean", "bit"),
    T.ByteType(): ("tinyint",),
    T.ShortType(): ("int2", "smallint", "int16", "utinyint", "uint8"),
    T.IntegerType(): ("int4", "int", "integer", "int32", "oid", "usmallint", "uint16"),
    T.LongType(): ("int8", "bigint", "int64", "uinteger", "uint32"),
    T.DecimalType(20, 0): ("ubigint", "uint64"),
    T.DecimalType(38, 0): ("hugeint", "uhugeint"),
    T.DecimalType(38, 10): ("numeric", "decimal", "bignumeric"),
    T.FloatType(): ("float4", "real", "float", "float32"),
    T.DoubleType(): ("float8", "double", "float64"),
    T.StringType(): ("varchar", "char", "bpchar", "text", "string", "name", "json", "xml", "uuid", "inet", "unknown", "any"),
    T.BinaryType(): ("bytea", "bytes", "binary", "varbinary", "blob", "jsonb"),
    T.DateType(): ("date", "date32"),
    T.TimestampNTZType(): ("timestamp", "datetime", "datetime64", "timestamp_ns", "datetime32"),
    T.TimestampType(): ("timestamptz", "timestamp with time zone", "timestamp_with_timezone", "timestampltz"),
    T.NullType(): ("null",),
}
_BY_NAME = {n: t for t, names in TYPE_NAMES.items() for n in names}


def spark_type(name: str) -> T.DataType:
    """Spark type of a manifest type name; arrays, structs and sized types nest; unknown is text."""
    low = name.strip().lower()
    if low in _BY_NAME:
        return _BY_NAME[low]
    if low in ("array", "list"):
        return T.ArrayType(T.StringType())
    if m := re.fullmatch(r"(?:array|list)\s*<(.*)>", low):
        return T.ArrayType(spark_type(m[1]))
    if m := re.fullmatch(r"struct\s*<(.*)>", low):
        parts, depth, at = [], 0, 0
        for k, c in enumerate(m[1] + ","):
            depth += (c in "<(") - (c in ">)")
            if c == "," and depth == 0:
                parts.append(m[1][at:k].strip())
                at = k + 1
        fields = []
        for k, p in enumerate(p for p in parts if p):
            named = re.match(r"([a-z_]\w*)[\s:]+(.+)", p)
            fields.append(T.StructField(named[1], spark_type(named[2])) if named else T.StructField(f"c{k}", spark_type(p)))
        return T.StructType(fields)
    if m := re.fullmatch(r"(?:decimal|numeric)\s*\(\s*(\d+)\s*(?:,\s*(\d+)\s*)?\)", low):
        return T.DecimalType(int(m[1]), int(m[2] or 0))
    if re.fullmatch(r"(?:var)?char\s*\(\s*\d+\s*\)", low):
        return T.StringType()
    return T.StringType()


def flag(value: Any) -> bool:
    return value in (True, 1, "1", "true", "True")


@dataclass(frozen=True)
class AccessRule:
    name: str
    required: tuple[dict, ...] = ()
    condition: str = ""
    operator: str = ""
    threshold: str = ""


@dataclass(frozen=True)
class Column:
    name: str
    type: str = "varchar"
    expression: str | None = None
    calculated: bool = False
    relationship: str | None = None
    hidden: bool = False
    not_null: bool = False
    access: AccessRule | None = None


@dataclass(frozen=True)
class Model:
    name: str
    columns: tuple[Column, ...]
    table: str | None = None
    ref_sql: str | None = None
    primary_key: tuple[str, ...] = ()
    rules: tuple[AccessRule, ...] = ()
    cached: bool = False

    def column(self, name: str) -> Column | None:
        exact = [c for c in self.columns if c.name == name]
        loose = [c for c in self.columns if c.name.lower() == name.lower()]
        return (exact or loose or [None])[0]

    def visible(self) -> list[Column]:
        return [c for c in self.columns if not c.hidden and not c.relationship]


@dataclass(frozen=True)
class Relationship:
    name: str
    models: tuple[str, str]
    join_type: str
    condition: str
    pairs: tuple[tuple[str, str], ...] = ()

    @property
    def sides(self) -> tuple[str, str]:
        """Cardinality of each side: ONE or MANY."""
        a, _, b = self.join_type.upper().partition("_TO_")
        return a, b


def _extras(raw: dict) -> tuple[int, tuple[str, ...]]:
    """A cube's priority (0 unless a whole number) and its other names."""
    p, more = raw.get("priority", 0), raw.get("synonyms") or ()
    return (p if isinstance(p, int) and not isinstance(p, bool) else 0), tuple(more.split(",") if isinstance(more, str) else more)


@dataclass(frozen=True)
class Cube:
    name: str
    base: str
    measures: dict[str, str]
    dimensions: dict[str, str]
    time_dimensions: dict[str, str]
    hierarchies: dict[str, list[str]] = field(default_factory=dict)
    priority: int = 0
    synonyms: tuple[str, ...] = ()


@dataclass(frozen=True)
class Manifest:
    models: dict[str, Model]
    relationships: dict[str, Relationship] = field(default_factory=dict)
    views: dict[str, str] = field(default_factory=dict)
    cubes: dict[str, Cube] = field(default_factory=dict)
    metrics: dict[str, dict] = field(default_factory=dict)
    dimensions: dict[str, dict] = field(default_factory=dict)
    graph: dict[str, Any] = field(default_factory=dict)
    catalog: str = ""
    schema: str = ""

    def model(self, name: str) -> Model:
        found = self.models.get(name) or next((m for k, m in self.models.items() if k.lower() == name.lower()), None)
        if found is None:
            raise ManifestError("MODEL_NOT_FOUND", name)
        return found


_NAME = r'(?:`[^`]+`|"[^"]+"|[^\W\d]\w*)'
_EQUALS = re.compile(rf"\s*({_NAME})\s*\.\s*({_NAME})\s*=\s*({_NAME})\s*\.\s*({_NAME})\s*")


def _bare(x: str) -> str:
    return x[1:-1] if x[0] in '`"' else x


def join_pairs(condition: str, first: str, second: str) -> tuple[tuple[str, str], ...]:
    """Key pairs (first's column, second's column) of a conjunction of column equalities."""
    text = condition.strip()
    while text.startswith("(") and text.endswith(")") and _closes(text):
        text = text[1:-1].strip()
    out = []
    for part in re.split(r"(?i)\s+and\s+", text):
        part = part.strip()
        while part.startswith("(") and part.endswith(")"):
            part = part[1:-1].strip()
        m = _EQUALS.fullmatch(part)
        if not m:
            raise ManifestError("RELATIONSHIP_CONDITION_UNSAFE", condition)
        a, x, b, y = map(_bare, m.groups())
        if (a, b) == (first, second):
            out.append((x, y))
        elif (b, a) == (first, second):
            out.append((y, x))
        else:
            raise ManifestError("RELATIONSHIP_QUALIFIER_INVALID", condition)
    return tuple(out)


def _closes(text: str) -> bool:
    depth = 0
    for k, c in enumerate(text):
        depth += (c == "(") - (c == ")")
        if depth == 0:
            return k == len(text) - 1
    return False


def _own(sql: str | None) -> str | None:
    """A statement or expression of the manifest in Spark's syntax."""
    return translate(sql) if sql else None


def _member(raw: dict) -> dict:
    return raw | {"expression": _own(raw["expression"])} if raw.get("expression") else raw


def _rule(raw: dict | None) -> AccessRule | None:
    if not raw:
        return None
    need = raw.get("requiredProperties") or []
    return AccessRule(raw.get("name", ""), tuple(need), _own(raw.get("condition")) or "", raw.get("operator", ""), str(raw.get("threshold", "")))


def load(source: str | dict) -> Manifest:
    """A manifest from a dict, JSON text or base64 of JSON text, validated."""
    if isinstance(source, str):
        text = source if source.lstrip().startswith("{") else base64.b64decode(source).decode()
        source = json.loads(text)
    if int(source.get("layoutVersion", 1)) > LATEST_LAYOUT:
        raise ManifestError("LAYOUT_VERSION_UNSUPPORTED", str(source["layoutVersion"]))
    models: dict[str, Model] = {}
    for raw in source.get("models", []):
        cols = tuple(
            Column(
                c["name"], c.get("type", "varchar"), _own(c.get("expression")), flag(c.get("isCalculated")),
                c.get("relationship") or None, flag(c.get("isHidden")), flag(c.get("notNull")), _rule(c.get("columnLevelAccessControl")),
            )
            for c in raw.get("columns", [])
        )
        table = raw.get("tableReference") or None
        if isinstance(table, dict):
            table = ".".join(table[k] for k in ("catalog", "schema", "table") if table.get(k))
        key = raw.get("primaryKey") or ()
        key = (key,) if isinstance(key, str) else tuple(key)
        rules = tuple(_rule(r) for r in raw.get("rowLevelAccessControls", []))
        models[raw["name"]] = Model(raw["name"], cols, table, _own(raw.get("refSql")), key, rules, flag(raw.get("cached")))
    rels = {}
    for raw in source.get("relationships", []):
        two = tuple(raw.get("models", ()))
        if len(two) != 2:
            raise ManifestError("RELATIONSHIP_MODELS_INVALID", raw.get("name", ""))
        if any(m not in models for m in two):
            raise ManifestError("RELATIONSHIP_NODE_MISSING", raw["name"])
        pairs = join_pairs(raw["condition"], *two)
        rels[raw["name"]] = Relationship(raw["name"], two, raw.get("joinType", "MANY_TO_ONE"), raw["condition"], pairs)
    cubes = {}
    for raw in source.get("cubes", []):
        named = lambda k: {x["name"]: _own(x["expression"]) for x in raw.get(k, [])}  # noqa: E731, B023
        cubes[raw["name"]] = Cube(raw["name"], raw["baseObject"], named("measures"), named("dimensions"), named("timeDimensions"), dict(raw.get("hierarchies") or {}), *_extras(raw))
    made = Manifest(
        models, rels, {v["name"]: _own(v["statement"]) for v in source.get("views", [])}, cubes,
        {m["name"]: _member(m) for m in source.get("metrics", [])}, {d["name"]: _member(d) for d in source.get("dimensions", [])}, source.get("graph") or {},
        source.get("catalog") or "", source.get("schema") or "",
    )
    validate(made)
    return made


def validate(m: Manifest) -> None:
    """Structural rules: one source a model, no case collisions, known relationships and keys,
    cubes with a base, known hierarchy levels and no measure cycle."""
    for model in m.models.values():
        if bool(model.table) == bool(model.ref_sql):
            raise ManifestError("MODEL_SOURCE_INVALID", f"{model.name} needs a table or a query")
        seen: set[str] = set()
        for c in model.columns:
            if c.name.lower() in seen:
                raise ManifestError("COLUMN_CASE_COLLISION", f"{model.name}.{c.name}")
            seen.add(c.name.lower())
            if c.relationship and c.relationship not in m.relationships:
                raise ManifestError("RELATIONSHIP_UNKNOWN", f"{model.name}.{c.name}")
            if c.calculated and not c.expression:
                raise ManifestError("EXPRESSION_MISSING", f"{model.name}.{c.name}")
        for k in model.primary_key:
            if model.column(k) is None:
                raise ManifestError("PRIMARY_KEY_UNKNOWN", f"{model.name}.{k}")
    for cube in m.cubes.values():
        if cube.base not in m.models and cube.base not in m.views:
            raise ManifestError("CUBE_BASE_UNKNOWN", cube.name)
        for levels in cube.hierarchies.values():
            for level in levels:
                if level not in cube.dimensions and level not in cube.time_dimensions:
                    raise ManifestError("HIERARCHY_LEVEL_UNKNOWN", f"{cube.name}.{level}")
        for name in cube.measures:
            expand_measure(cube, name)


def expand_measure(cube: Cube, name: str, stack: tuple[str, ...] = ()) -> str:
    """A measure with the measures that it names put in, in parentheses."""
    if name in stack:
        raise ManifestError("MEASURE_CYCLE", " -> ".join((*stack, name)))
    text = cube.measures[name]
    for other in sorted(cube.measures, key=len, reverse=True):
        word = rf"(?<![\w.]){re.escape(other)}(?![\w(])"
        if other != name and re.search(word, text) or other == name and re.search(word, text) and re.fullmatch(rf"\s*{word}\s*", text):
            text = re.sub(word, lambda _, o=other: f"({expand_measure(cube, o, (*stack, name))})", text)
    return text
