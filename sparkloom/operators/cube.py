"""Cube queries: declared measures by dimensions and time grains."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.plans.manifest import Cube, ManifestError, expand_measure

GRAINS = ("year", "quarter", "month", "week", "day", "hour", "minute")


@dataclass(frozen=True)
class CubeFilter:
    member: str
    operator: str
    value: object = None


@dataclass(frozen=True)
class TimeDimension:
    name: str
    grain: str
    date_range: tuple[str, str] | None = None


@dataclass(frozen=True)
class CubeQuery:
    cube: str
    measures: tuple[str, ...] = ()
    dimensions: tuple[str, ...] = ()
    time_dimensions: tuple[TimeDimension, ...] = ()
    filters: tuple[CubeFilter, ...] = ()
    limit: int | None = None
    offset: int | None = None


def parse_query(raw: dict) -> CubeQuery:
    """A query from its JSON form."""
    times = tuple(
        TimeDimension(t["dimension"], t["granularity"].lower(), tuple(t["dateRange"]) if t.get("dateRange") else None)
        for t in raw.get("timeDimensions", [])
    )
    filters = tuple(CubeFilter(f["dimension"], f["operator"].lower(), f.get("value")) for f in raw.get("filters", []))
    return CubeQuery(raw["cube"], tuple(raw.get("measures", ())), tuple(raw.get("dimensions", ())), times, filters, raw.get("limit"), raw.get("offset"))


def parse_filter(spec: str) -> CubeFilter:
    """``member:operator[:value]`` of the command line; lists are comma-separated."""
    member, op, *value = spec.split(":", 2)
    if op in ("in", "not_in"):
        return CubeFilter(member, op, value[0].split(",") if value else [])
    return CubeFilter(member, op, value[0] if value else None)


def parse_time(spec: str) -> TimeDimension:
    """``name:grain[:start,end]`` of the command line."""
    name, grain, *span = spec.split(":", 2)
    return TimeDimension(name, grain, tuple(span[0].split(",")) if span else None)


def condition(f: CubeFilter, member: Column) -> Column:
    """The 12 filter operators. ``contains`` and ``starts_with`` are LIKE patterns, so % and _ in
    their value are wildcards."""
    op, v = f.operator, f.value
    if op in ("is_null", "is_not_null"):
        return member.isNull() if op == "is_null" else member.isNotNull()
    if op in ("in", "not_in"):
        if not isinstance(v, (list, tuple)) or not v:
            raise ManifestError("CUBE_FILTER_INVALID", f"{op} needs a list with values")
        return member.isin(*v) if op == "in" else ~member.isin(*v)
    if v is None or isinstance(v, (list, tuple, dict)):
        raise ManifestError("CUBE_FILTER_INVALID", f"{op} needs one value")
    if isinstance(v, float) and v.is_integer():
        v = int(v)
    if op == "contains":
        return member.like(f"%{v}%")
    if op == "starts_with":
        return member.like(f"{v}%")
    tests = {"eq": member == v, "neq": member != v, "gt": member > v, "gte": member >= v, "lt": member < v, "lte": member <= v}
    if op not in tests:
        raise ManifestError("CUBE_FILTER_INVALID", op)
    return tests[op]


def run_cube(base: DataFrame, cube: Cube, q: CubeQuery) -> DataFrame:
    """Groups ``base`` by time grains and dimensions and aggregates the measures; rows are ordered
    by the first time dimension, nulls last. Without measures the distinct groups come out."""
    if not (q.measures or q.dimensions or q.time_dimensions):
        raise ManifestError("CUBE_QUERY_EMPTY", q.cube)
    members = {**cube.dimensions, **cube.time_dimensions}
    for name in q.measures:
        if name not in cube.measures:
            raise ManifestError("CUBE_MEASURE_UNKNOWN", name)
    for name in q.dimensions:
        if name not in members:
            raise ManifestError("CUBE_DIMENSION_UNKNOWN", name)
    df = base
    for f in q.filters:
        if f.member not in members:
            raise ManifestError("CUBE_DIMENSION_UNKNOWN", f.member)
        df = df.filter(condition(f, F.expr(members[f.member])))
    keys: list[Column] = []
    for t in q.time_dimensions:
        if t.name not in cube.time_dimensions:
            raise ManifestError("CUBE_TIME_DIMENSION_UNKNOWN", t.name)
        if t.grain not in GRAINS:
            raise ManifestError("CUBE_GRAIN_UNKNOWN", t.grain)
        when = F.expr(cube.time_dimensions[t.name])
        if t.date_range:
            start, end = (F.lit(x).cast("timestamp") for x in t.date_range)
            df = df.filter((when >= start) & (when < end))
        keys.append(F.date_trunc(t.grain, when).alias(f"{t.name}__{t.grain}"))
    keys += [F.expr(members[d]).alias(d) for d in q.dimensions]
    values = [F.expr(expand_measure(cube, m)).alias(m) for m in q.measures]
    if values:
        out = df.groupBy(*keys).agg(*values) if keys else df.agg(*values)
    else:
        out = df.select(*keys).distinct()
    if q.time_dimensions:
        first = q.time_dimensions[0]
        out = out.orderBy(F.col(f"`{first.name}__{first.grain}`").asc_nulls_last())
    if q.offset:
        out = out.offset(int(q.offset))
    return out if q.limit is None else out.limit(int(q.limit))
