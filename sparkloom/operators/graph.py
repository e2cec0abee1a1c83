"""Graph planner: metrics and dimensions over a relationship graph as one wide table."""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.plans import exprs
from sparkloom.plans.manifest import Manifest, Relationship
from sparkloom.plans.models import ModelBuilder

FIELDS = {"schemaVersion", "anchor", "facts", "metrics", "dimensions", "attributes", "calculations", "pathHints", "maxDepth", "fanoutMode", "includeReachable", "partitions", "entityGrain", "orderBy", "limit", "source", "bridge"}
#: Other names of request fields.
ALSO = {"anchorModel": "anchor", "sourceModel": "source", "targetGrain": "entityGrain", "maxHops": "maxDepth"}
KINDS = ("dimension", "metric", "post_metric")
#: Hops of a path, and paths tried in a search.
MAX_HOPS, MAX_SEARCH = 2, 20_000


class GraphError(ValueError):
    """A request that can't be planned safely; ``code`` says why."""

    def __init__(self, code: str, message: str = ""):
        super().__init__(f"{code}: {message}")
        self.code = code


@dataclass(frozen=True)
class Edge:
    """A directed step: ``safe`` leads to at most one row, ``fanout`` may repeat rows."""

    name: str
    source: str
    target: str
    pairs: tuple[tuple[str, str], ...]
    kind: str


@dataclass(frozen=True)
class Input:
    """A column that a calculation takes from a model, by ``hint`` if several paths lead there."""

    model: str
    field: str
    hint: tuple[str, ...] = ()


@dataclass(frozen=True)
class Member:
    """A grain column: an expression over one model, or over inputs of several, in the order of
    their placeholders ``=alias#k``."""

    alias: str
    model: str
    expression: str
    inputs: tuple[Input, ...] = ()
    hint: tuple[str, ...] = ()

    def parts(self) -> list[tuple[str, str, str, tuple[str, ...]]]:
        """(name, model, expression, hint) of what must be joined."""
        if not self.inputs:
            return [(self.alias, self.model, self.expression, self.hint)]
        return [(f"{self.alias}#{k}", x.model, exprs.quote(x.field), x.hint) for k, x in enumerate(self.inputs)]


class GraphPlanner:
    """Plans over governed model DataFrames, so row and column rules hold in every step."""

    def __init__(self, manifest: Manifest, builder: ModelBuilder):
        self.manifest, self.builder = manifest, builder
        self.config = manifest.graph
        self.edges: dict[str, list[Edge]] = {m: [] for m in manifest.models}
        self.diagnostics: list[str] = []
        self._roles()
        for rel in manifest.relationships.values():
            self._compile(rel)

    # -- graph ---------------------------------------------------------------------------------

    def _roles(self) -> None:
        """Relationships between the same two models need a role each; a role names its
        relationship in path hints. Without roles they can't be planned over."""
        self.roles: dict[str, str] = dict(self.config.get("relationshipRoles") or {})
        self.unroled: set[str] = set()
        pairs: dict[frozenset, list[str]] = {}
        for rel in self.manifest.relationships.values():
            pairs.setdefault(frozenset(rel.models), []).append(rel.name)
        for names in pairs.values():
            if len(names) < 2:
                continue
            self.unroled |= {n for n in names if not self.roles.get(n)}
            self.diagnostics += [f"GRAPH_ROLE_REQUIRED: {n}" for n in names if n in self.unroled]
            given = [self.roles[n].casefold() for n in names if self.roles.get(n)]
            if len(given) != len(set(given)):
                raise GraphError("GRAPH_ROLE_DUPLICATE", ", ".join(names))

    def _named(self, step: str) -> str:
        """The relationship of a hint's step, which may be its role."""
        return next((n for n, r in self.roles.items() if r.casefold() == step.casefold()), step) if step not in self.manifest.relationships else step

    def _unique(self, model: str, columns: list[str]) -> bool | None:
        key = self.manifest.model(model).primary_key
        return None if not key else set(key) <= set(columns)

    def _compile(self, rel: Relationship) -> None:
        """Both directions of a relationship. The side declared ONE must be unique by its key: a
        key that the join doesn't cover is an error, no key leaves the edge unusable."""
        left, right = rel.sides
        a, b = rel.models
        for source, target, one, pairs in ((a, b, right, rel.pairs), (b, a, left, tuple((y, x) for x, y in rel.pairs))):
            if one == "ONE":
                ok = self._unique(target, [y for _, y in pairs])
                if ok is None:
                    self.diagnostics.append(f"GRAPH_CARDINALITY_UNVERIFIED: {rel.name}")
                    continue
                if not ok:
                    self.diagnostics.append(f"GRAPH_CARDINALITY_KEY_MISMATCH: {rel.name}")
                    continue
                self.edges[source].append(Edge(rel.name, source, target, pairs, "safe"))
            elif left == "MANY" and right == "MANY":
                self.diagnostics.append(f"GRAPH_MANY_TO_MANY_DISABLED: {rel.name}")
            else:
                self.edges[source].append(Edge(rel.name, source, target, pairs, "fanout"))

    def path(self, source: str, target: str, kinds: tuple[str, ...] = ("safe",), hint: list[str] | None = None, depth: int | None = None) -> list[Edge]:
        """The shortest path of allowed edges; two of the same length are ambiguous unless a hint
        (relationship names in order) picks one."""
        most = depth or int(self.config.get("maxHops", MAX_HOPS))
        if hint:
            if len(hint) > most:
                raise GraphError("GRAPH_PATH_HINT_TOO_DEEP", "->".join(hint))
            at, out, seen = source, [], {source}
            for name in map(self._named, hint):
                step = next((e for e in self.edges.get(at, ()) if e.name == name and e.kind in kinds), None)
                if step is None:
                    raise GraphError("GRAPH_RELATIONSHIP_PATH_INVALID", name)
                if step.target in seen:
                    raise GraphError("GRAPH_PATH_HINT_CYCLE", name)
                out.append(step)
                at = step.target
                seen.add(at)
            if at != target:
                raise GraphError("GRAPH_RELATIONSHIP_PATH_INVALID", "->".join(hint))
            return self._with_roles(out)
        if source == target:
            return []
        level, hops, tried = [[e] for e in self.edges.get(source, ()) if e.kind in kinds], 1, 0
        while level and hops <= most:
            hit = [p for p in level if p[-1].target == target]
            if len(hit) > 1:
                raise GraphError("AMBIGUOUS_SAFE_PATH", f"{source} -> {target}")
            if hit:
                return self._with_roles(hit[0])
            tried += len(level)
            if tried > MAX_SEARCH:
                raise GraphError("GRAPH_PATH_SEARCH_LIMIT", f"{source} -> {target}")
            level = [[*p, e] for p in level for e in self.edges[p[-1].target] if e.kind in kinds and e.target not in {source, *(x.target for x in p)}]
            hops += 1
        raise GraphError("NO_SAFE_PATH", f"{source} -> {target}")

    def _with_roles(self, path: list[Edge]) -> list[Edge]:
        if missing := [e.name for e in path if e.name in self.unroled]:
            raise GraphError("GRAPH_ROLE_REQUIRED", ", ".join(missing))
        return path

    def queryable(self, source: str) -> dict[str, str]:
        """Each dimension's state from a source model: OK or the reason why not."""
        out = {}
        for name in self.manifest.dimensions:
            try:
                d = self.dimension(name, source)
                self.path(source, d.model, hint=list(d.hint) or None)
                out[name] = "OK"
            except GraphError as e:
                out[name] = e.code
        return out

    def bindable(self, metric: str) -> list[str]:
        """Models that a metric can be taken over: the one it declares, or all that have every
        column that its expression names."""
        m = self.metric(metric)
        if m.get("model"):
            return [m["model"]]
        return [n for n in self.manifest.models if self._covers(n, m["expression"])]

    def _covers(self, model: str, expression: str) -> bool:
        held = {c.name.lower() for c in self.manifest.model(model).columns if not c.relationship}
        asked = {p[-1].lower() for p in exprs.paths(expression)} - {"distinct", "case", "when", "then", "else", "end", "and", "or", "not", "null", "is", "in", "as", "between", "like", "filter", "where", "true", "false"}
        return bool(asked) and asked <= held

    def discover(self, source: str | None = None) -> dict[str, dict[str, str]]:
        """What can be asked, by source model: each metric that binds there, and each dimension's state."""
        if source is not None and source not in self.manifest.models:
            raise GraphError("GRAPH_ANCHOR_NOT_FOUND", source)
        out = {}
        for model in [source] if source else self.manifest.models:
            metrics = [n for n in self.manifest.metrics if model in self.bindable(n)]
            if metrics or source:
                out[model] = {"metrics": metrics, "dimensions": self.queryable(model)}
        return out

    # -- members -------------------------------------------------------------------------------

    def metric(self, name: str) -> dict:
        if name not in self.manifest.metrics:
            raise GraphError("GRAPH_METRIC_NOT_FOUND", name)
        m = self.manifest.metrics[name]
        if not m.get("expression"):
            raise GraphError("GRAPH_METRIC_EXPRESSION_MISSING", name)
        return m

    def dimension(self, name: str, source: str | None = None) -> Member:
        """A global dimension or ``model.field``. A dimension without a model binds to the source, or
        to the nearest model that has its columns. One that is just the key by which the source
        refers to its model is taken from the source: no join, and no null for a key that the
        model has lost."""
        if name not in self.manifest.dimensions:
            model, _, column = name.partition(".")
            if not column:
                raise GraphError("GRAPH_DIMENSION_NOT_FOUND", name)
            return self.attribute({"model": model, "field": column})
        d = self.manifest.dimensions[name]
        text, model = d.get("expression") or name, d.get("model") or d.get("masterModel")
        if model is None:
            able = [m for m in self.manifest.models if self._covers(m, text)]
            if source in able:
                model = source
            elif source is None:
                model = able[0] if len(able) == 1 else None
            else:
                near = []
                for m in able:
                    try:
                        near.append((len(self.path(source, m)), m))
                    except GraphError:
                        continue
                near.sort()
                if len(near) > 1 and near[0][0] == near[1][0]:
                    raise GraphError("AMBIGUOUS_SAFE_PATH", f"{name}: {near[0][1]}, {near[1][1]}")
                model = near[0][1] if near else None
            if model is None:
                raise GraphError("GRAPH_DIMENSION_BINDING_NOT_FOUND", name)
        if source and model != source and len(ts := [t for t in exprs.tokens(text) if t.kind != "space"]) == 1 and ts[0].kind == "name":
            own = {a for e in self.edges.get(source, ()) if e.target == model and e.kind == "safe" and e.name not in self.unroled for a, b in e.pairs if b.lower() == ts[0].parts[-1].lower()}
            if len(own) == 1:
                return Member(name, source, exprs.quote(own.pop()))
        return Member(name, model, text)

    def attribute(self, spec: str | dict) -> Member:
        """A raw column as a grain column: ``model.field``, or model, field, alias and a path or role."""
        if isinstance(spec, str):
            model, _, field = spec.partition(".")
            spec = {"model": model, "field": field}
        if not isinstance(spec, dict) or not spec.get("field"):
            raise GraphError("GRAPH_ATTRIBUTE_INVALID", str(spec))
        model, field = spec.get("model"), spec["field"]
        if model not in self.manifest.models:
            raise GraphError("GRAPH_ATTRIBUTE_MODEL_NOT_FOUND", str(model))
        col = self.manifest.model(model).column(field)
        if col is None or col.relationship:
            raise GraphError("GRAPH_ATTRIBUTE_FIELD_NOT_FOUND", f"{model}.{field}")
        return Member(spec.get("alias") or field, model, exprs.quote(col.name), hint=self._hint(spec))

    @staticmethod
    def _hint(spec: dict) -> tuple[str, ...]:
        return tuple(spec.get("relationshipPath") or ([spec["role"]] if spec.get("role") else ()))

    def grain(self, request: dict, source: str) -> list[Member]:
        """All grain columns: dimensions, attributes, entities and dimension calculations."""
        hints = request.get("pathHints") or {}
        out = [self.dimension(d, source) for d in request.get("dimensions", ())]
        out += [self.attribute(a) for a in request.get("attributes", ())]
        for e in request.get("entityGrain", ()):
            if isinstance(e, str) and e in self.manifest.models:
                key = self.manifest.model(e).primary_key
                if not key:
                    raise GraphError("GRAPH_ENTITY_GRAIN_FIELDS_MISSING", e)
                out += [self.attribute({"model": e, "field": k}) for k in key]
            elif isinstance(e, str) and e not in self.manifest.dimensions and "." not in e:
                raise GraphError("GRAPH_ENTITY_GRAIN_NOT_FOUND", e)
            else:
                out.append(self.dimension(e, source) if isinstance(e, str) else self.attribute(e))
        out += [self.calculation(c) for c in request.get("calculations", ()) if c["kind"] == "dimension"]
        seen = [m.alias for m in out]
        if len(set(seen)) != len(seen):
            raise GraphError("GRAPH_OUTPUT_ALIAS_CONFLICT", ", ".join(seen))
        return [replace(m, hint=tuple(hints[m.alias])) if m.alias in hints else m for m in out]

    def calculation(self, c: dict, source: str | None = None) -> Member:
        """A calculation over declared ``inputs``: its expression names exactly these, as
        ``model.field``. Without a declaration the names that it uses are the inputs; in a metric's
        a bare name is the source's column."""
        text, name = c["expression"], c["name"]
        declared = None if c.get("inputs") is None else [Input(x.get("model"), x.get("field"), self._hint(x)) for x in c["inputs"]]
        used: dict[tuple[str, str], None] = {}
        for p in exprs.paths(text):
            if len(p) > 1 and p[-2] in self.manifest.models:
                if self.manifest.model(p[-2]).column(p[-1]) is None:
                    raise GraphError("GRAPH_CALCULATION_FIELD_UNREACHABLE", ".".join(p))
                used[p[-2], p[-1]] = None
            elif len(p) == 1 and any(m.column(p[0]) is not None for m in map(self.manifest.model, [source] if source else self.manifest.models)):
                if source is None:
                    raise GraphError("GRAPH_CALCULATION_INPUT_QUALIFICATION_REQUIRED", p[0])
                used[source, p[0]] = None
        if declared is None:
            inputs = [Input(*x) for x in used]
        else:
            inputs, known = declared, {(x.model, x.field) for x in declared}
            if more := [".".join(x) for x in used if x not in known]:
                raise GraphError("GRAPH_CALCULATION_INPUT_UNDECLARED", ", ".join(more))
            if idle := sorted(f"{m}.{f}" for m, f in known - set(used)):
                raise GraphError("GRAPH_CALCULATION_INPUT_UNUSED", ", ".join(idle))
        if not inputs:
            raise GraphError("GRAPH_CALCULATION_INPUT_CONTEXT_REQUIRED", name)
        at = {(x.model, x.field): f"={name}#{k}" for k, x in enumerate(inputs)}

        def placed(p: tuple[str, ...]) -> str | None:
            key = (p[-2], p[-1]) if len(p) > 1 else (source, p[0])
            return exprs.quote(at[key]) if key in at else None

        return Member(name, "", exprs.rewrite(text, placed), tuple(inputs))

    def metric_calculation(self, c: dict, source: str) -> Member:
        """A calculated metric over the rows of a fact: an aggregate over every column. A global
        metric's name stands for its expression."""
        text = exprs.rewrite(c["expression"], lambda p: f"({self.manifest.metrics[p[0]]['expression']})" if len(p) == 1 and p[0] in self.manifest.metrics and self.manifest.model(source).column(p[0]) is None else None)
        parts = exprs.split_aggregates(text)
        if not any(call for call, _ in parts):
            raise GraphError("GRAPH_METRIC_CALCULATION_UNSAFE", f"{c['name']}: no aggregate")
        outside = " ".join(t for call, t in parts if not call)
        bare = [p for p in exprs.paths(outside) if len(p) > 1 or self.manifest.model(source).column(p[0]) is not None]
        if bare:
            raise GraphError("GRAPH_METRIC_CALCULATION_FIELD_NOT_AGGREGATED", ".".join(bare[0]))
        return self.calculation({**c, "expression": text}, source)

    @staticmethod
    def rollup(expression: str) -> str:
        """How a pre-aggregated metric is summed again; other aggregates can't be."""
        ts = [t for t in exprs.tokens(expression) if t.kind not in ("space", "comment")]
        calls = [t.parts[-1].lower() for t in ts if t.call]
        whole = ts[0].call and ts[-1].text == ")" and sum(c in exprs.AGGREGATES for c in calls) == 1
        distinct = any(t.text.lower() == "distinct" for t in ts)
        if whole and calls[0] in ("sum", "count") and not distinct:
            return "sum"
        if whole and calls[0] in ("min", "max"):
            return calls[0]
        raise GraphError("GRAPH_METRIC_NOT_ADDITIVE_FOR_FANOUT", expression)

    # -- planning ------------------------------------------------------------------------------

    def columns_of(self, model: str, expressions: list[str]) -> list[str]:
        m = self.manifest.model(model)
        used = set().union(*(exprs.names(e) for e in expressions)) if expressions else set()
        return [c.name for c in m.columns if not c.relationship and c.name.lower() in used]

    def joined(self, source: str, own: list[str], members: list[Member], request: dict, kinds: tuple[str, ...] = ("safe",)) -> DataFrame:
        """The source with every member's expression as a column, by left joins along paths."""
        routes: dict[tuple[str, ...], list[Edge]] = {}
        at: list[tuple[str, ...]] = []
        parts = [x for m in members for x in m.parts()]
        for _, model, _, hint in parts:
            p = self.path(source, model, kinds, list(hint) or None, request.get("maxDepth"))
            for k in range(1, len(p) + 1):
                routes[tuple(e.name for e in p[:k])] = p[:k]
            at.append(tuple(e.name for e in p))
        need: dict[tuple[str, ...], set[str]] = {(): set(own), **{k: set() for k in routes}}
        for key, p in routes.items():
            need[key[:-1]] |= {a for a, _ in p[-1].pairs}
            need[key] |= {b for _, b in p[-1].pairs}
        for (_, model, e, _), key in zip(parts, at):
            need[key] |= set(self.columns_of(model, [e]))
        tag = lambda key, c: "/".join((*key, c))

        def node(key: tuple[str, ...], model: str) -> DataFrame:
            names = sorted(need[key])
            df = self.builder.build(model, names)
            df = self.partitioned(model, df, request)
            return df.select(*[F.col(exprs.quote(n)).alias(tag(key, n)) for n in names])

        df = node((), source)
        for key in sorted(routes, key=len):
            edge = routes[key][-1]
            right = node(key, edge.target)
            on = [df[exprs.quote(tag(key[:-1], a))] == right[exprs.quote(tag(key, b))] for a, b in edge.pairs]
            df = df.join(right, on, "left")
        out = [F.col(exprs.quote(c)) for c in sorted(own)]
        for (alias, model, e, _), key in zip(parts, at):
            m = self.manifest.model(model)
            text = exprs.rewrite(e, lambda p, m=m, key=key: exprs.quote(tag(key, m.column(p[-1]).name)) if m.column(p[-1]) else None)
            out.append(F.expr(text).alias(f"={alias}"))
        df = df.select(*out)
        for m in members:
            # A calculated metric is an aggregate of its inputs, not a column.
            if m.inputs and not exprs.has_aggregate(m.expression):
                df = df.withColumn(f"={m.alias}", F.expr(m.expression))
        return df

    def partitioned(self, model: str, df: DataFrame, request: dict) -> DataFrame:
        """Partition policy inside the relation: the latest snapshot, or a range that an
        incremental table requires."""
        rule = (self.config.get("partitions") or {}).get(model)
        if not rule:
            return df
        col, asked = rule["column"], (request.get("partitions") or {}).get(model)
        whole = self.builder.build(model, [col])
        if rule["mode"] == "snapshot":
            if asked and asked[0] != asked[-1]:
                raise GraphError("GRAPH_SNAPSHOT_RANGE_INVALID", model)
            if asked:
                return self.builder_filter(model, df, F.col(col) == asked[0], col)
            top = whole.agg(F.max(col).alias("_latest"))
            return self.with_column(model, df, col).join(F.broadcast(top), F.col(f"_p_{col}") == F.col("_latest")).drop("_latest", f"_p_{col}")
        if rule["mode"] != "incremental":
            raise GraphError("GRAPH_PARTITION_POLICY_INVALID", model)
        if not asked:
            raise GraphError("GRAPH_PARTITION_RANGE_REQUIRED", model)
        low, high = str(asked[0]), str(asked[-1])
        if not all(len(x) == 8 and x.isdigit() for x in (low, high)):
            raise GraphError("GRAPH_PARTITION_DATE_INVALID", f"{low}..{high}")
        if low > high:
            raise GraphError("GRAPH_PARTITION_DATE_RANGE_INVALID", f"{low}..{high}")
        return self.builder_filter(model, df, F.col(col).between(low, high), col)

    def with_column(self, model: str, df: DataFrame, col: str) -> DataFrame:
        names = df.columns
        return self.builder.build(model, list(dict.fromkeys([*names, col]))).select(*names, F.col(col).alias(f"_p_{col}"))

    def builder_filter(self, model: str, df: DataFrame, condition: Any, col: str) -> DataFrame:
        names = df.columns
        return self.builder.build(model, list(dict.fromkeys([*names, col]))).filter(condition).select(*names)

    def fact(self, fact: dict, request: dict) -> tuple[DataFrame, list[str], list[str]]:
        """One fact: (rows, grain columns, metric columns)."""
        source, metrics = fact["source"], [(n, self.metric(n)["expression"]) for n in fact["metrics"]]
        made = [self.metric_calculation(c, source) for c in fact["calculations"]]
        dims = self.grain(request, source)
        for n in fact["metrics"]:
            blocked = (self.config.get("metricPolicies") or {}).get(n, {}).get("blockedDimensions", ())
            if any(b == "*" and dims or any(b == d.alias or b == "time" and self._temporal(d) for d in dims) for b in blocked):
                raise GraphError("GRAPH_METRIC_DIMENSION_BLOCKED", n)
        wide = []
        bridge = fact.get("bridge") or request.get("bridge")
        for d in dims:
            for _, model, _, hint in d.parts():
                try:
                    self.path(source, model, hint=list(hint) or None, depth=request.get("maxDepth"))
                except GraphError as e:
                    if e.code not in ("NO_SAFE_PATH", "GRAPH_RELATIONSHIP_PATH_INVALID"):
                        raise
                    wide.append(d)
        own = self.columns_of(source, [e for _, e in metrics])
        names, keys = [n for n, _ in metrics] + [m.alias for m in made], [d.alias for d in dims]
        values = [*metrics, *((m.alias, m.expression) for m in made)]
        if not wide:
            df = self.joined(source, own, [*dims, *made], request)
            return self.group(df, keys, [F.expr(e).alias(n) for n, e in values]), keys, names
        if bridge:
            return self.bridged(source, values, made, dims, own, bridge, request), keys, names
        if request.get("fanoutMode") != "repeat":
            raise GraphError("GRAPH_FANOUT_ALLOCATION_REQUIRED", ", ".join(dict.fromkeys(d.alias for d in wide)))
        return self.repeated(source, values, made, dims, own, request), keys, names

    def _temporal(self, d: Member) -> bool:
        kinds = [self.manifest.model(m).column(c.name).type.lower() for _, m, e, _ in d.parts() for c in self.manifest.model(m).columns if c.name.lower() in exprs.names(e) and not c.relationship]
        return any(k.startswith(("date", "time")) for k in kinds)

    @staticmethod
    def group(df: DataFrame, keys: list[str], values: list) -> DataFrame:
        by = [F.col(exprs.quote(f"={k}")).alias(k) for k in keys]
        return df.groupBy(*by).agg(*values) if keys else df.agg(*values)

    def by_key(self, source: str, key: list[str], values: list, made: list[Member], own: list[str], request: dict) -> DataFrame:
        """Metrics by the fact's own key."""
        rows = self.joined(source, list(dict.fromkeys([*key, *own])), made, request)
        return rows.groupBy(*key).agg(*[F.expr(e).alias(f"+{n}") for n, e in values])

    def repeated(self, source: str, values: list, made: list[Member], dims: list[Member], own: list[str], request: dict) -> DataFrame:
        """Fanout: metrics by the fact's key, distinct (key, dimensions) pairs, then rolled up; a
        fact counts once for each of its dimension values."""
        key = list(self.manifest.model(source).primary_key)
        if not key:
            raise GraphError("GRAPH_FANOUT_GRAIN_REQUIRED", source)
        up = [(n, self.rollup(e)) for n, e in values]
        branches = set()
        for d in dims:
            for _, model, _, hint in d.parts():
                path = self.path(source, model, ("safe", "fanout"), list(hint) or None, request.get("maxDepth"))
                turn = next((k for k, e in enumerate(path) if e.kind == "fanout"), None)
                if turn is not None:
                    branches.add("->".join(e.name for e in path[: turn + 1]))
        if len(branches) > 1:
            raise GraphError("GRAPH_MULTIPLE_FANOUT_BRANCHES_UNSUPPORTED", ", ".join(sorted(branches)))
        first = self.by_key(source, key, values, made, own, request)
        pairs = self.joined(source, key, dims, request, ("safe", "fanout"))
        grain = [F.col(exprs.quote(f"={d.alias}")) for d in dims]
        pairs = pairs.select(*[F.col(exprs.quote(k)).alias(f"#{k}") for k in key], *grain).distinct()
        df = first.join(pairs, [first[k] == pairs[exprs.quote(f"#{k}")] for k in key])
        again = {"sum": F.sum, "min": F.min, "max": F.max}
        return self.group(df, [d.alias for d in dims], [again[r](F.col(exprs.quote(f"+{n}"))).alias(n) for n, r in up])

    def bridged(self, source: str, values: list, made: list[Member], dims: list[Member], own: list[str], bridge: dict, request: dict) -> DataFrame:
        """N:M through a bridge model, both of whose edges must be safe: a metric is multiplied by the
        weight of each mapping; facts without a mapping give 0. The weight is the sum of the
        allocation expression ("weighted", "custom"), or its share of the fact's sum ("proportional")."""
        mode = bridge.get("mode", "weighted")
        if not bridge.get("model") or not bridge.get("allocation") or mode not in ("weighted", "proportional", "custom"):
            raise GraphError("GRAPH_BRIDGE_POLICY_INVALID", str(bridge))
        up = [self.rollup(e) for _, e in values]
        if set(up) != {"sum"}:
            raise GraphError("GRAPH_ALLOCATION_ROLLUP_UNSUPPORTED", str(up))
        key, via = list(self.manifest.model(source).primary_key), bridge["model"]
        if not key:
            raise GraphError("GRAPH_FANOUT_GRAIN_REQUIRED", source)
        try:
            back = self.path(via, source, depth=1)
            for d in dims:
                for _, model, _, hint in d.parts():
                    self.path(via, model, hint=list(hint) or None, depth=request.get("maxDepth"))
        except GraphError as e:
            raise GraphError("GRAPH_BRIDGE_EDGE_NOT_SAFE", f"{via}: {e}") from e
        if {b for _, b in back[0].pairs} != set(key):
            raise GraphError("GRAPH_BRIDGE_EDGE_ENDPOINT_MISMATCH", via)
        first = self.by_key(source, key, values, made, own, request)
        names = self.columns_of(via, [bridge["allocation"]]) + [a for a, _ in back[0].pairs]
        mapping = self.joined(via, list(dict.fromkeys(names)), dims, request)
        on = {b: a for a, b in back[0].pairs}
        # Nothing but keys, dimensions and the sum of weights leaves the bridge.
        held = [F.col(exprs.quote(on[k])).alias(f"#{k}") for k in key]
        weights = mapping.groupBy(*held, *[F.col(exprs.quote(f"={d.alias}")) for d in dims])
        weights = weights.agg(F.sum(F.expr(bridge["allocation"])).alias("*weight"))
        if mode == "proportional":
            whole = F.sum("`*weight`").over(W.partitionBy(*[F.col(exprs.quote(f"#{k}")) for k in key]))
            weights = weights.withColumn("*weight", F.when(whole != 0, F.col("`*weight`") / whole))
        df = first.join(weights, [first[k] == weights[exprs.quote(f"#{k}")] for k in key], "left")
        share = F.coalesce(F.col(exprs.quote("*weight")), F.lit(0))
        return self.group(df, [d.alias for d in dims], [F.sum(F.col(exprs.quote(f"+{n}")) * share).alias(n) for n, _ in values])

    def normalized(self, request: dict) -> dict:
        """The request with known fields only, checked, wildcards spelt out."""
        if not isinstance(request, dict):
            raise GraphError("GRAPH_REQUEST_INVALID")
        request = {ALSO.get(k, k): v for k, v in request.items()}
        if unknown := set(request) - FIELDS:
            raise GraphError("GRAPH_REQUEST_FIELD_UNKNOWN", ", ".join(sorted(unknown)))
        version = request.get("schemaVersion", 1)
        if isinstance(version, bool) or version != 1:
            raise GraphError("GRAPH_REQUEST_SCHEMA_VERSION_UNSUPPORTED", str(version))
        if request.get("fanoutMode", "reject") not in ("reject", "repeat"):
            raise GraphError("GRAPH_FANOUT_MODE_INVALID", str(request["fanoutMode"]))
        if not isinstance(request.get("includeReachable", False), bool):
            raise GraphError("GRAPH_INCLUDE_REACHABLE_INVALID", str(request["includeReachable"]))
        depth = request.get("maxDepth")
        if depth is not None and (isinstance(depth, bool) or not isinstance(depth, int) or depth < 1):
            raise GraphError("GRAPH_MAX_DEPTH_INVALID", str(depth))
        anchor = request.get("anchor")
        if anchor is not None and (not isinstance(anchor, str) or not anchor):
            raise GraphError("GRAPH_ANCHOR_INVALID", str(anchor))
        if anchor is not None and anchor not in self.manifest.models:
            raise GraphError("GRAPH_ANCHOR_NOT_FOUND", anchor)
        if request.get("facts") and request.get("metrics"):
            raise GraphError("GRAPH_FACT_REQUEST_CONFLICT")
        calculations = []
        for c in request.get("calculations", ()):
            if not c.get("name"):
                raise GraphError("GRAPH_CALCULATION_NAME_REQUIRED")
            if not c.get("expression"):
                raise GraphError("GRAPH_CALCULATION_EXPRESSION_REQUIRED", c["name"])
            kind = c.get("kind", "post_metric")
            if kind not in KINDS:
                raise GraphError("GRAPH_CALCULATION_KIND_INVALID", str(kind))
            if exprs.has_subquery(c["expression"]) or ";" in {t.text for t in exprs.tokens(c["expression"])}:
                raise GraphError("GRAPH_CALCULATION_QUERY_FORBIDDEN", c["name"])
            if kind == "dimension" and exprs.has_aggregate(c["expression"]):
                raise GraphError("GRAPH_DIMENSION_CALCULATION_AGGREGATE_FORBIDDEN", c["name"])
            if kind == "post_metric" and exprs.has_aggregate(c["expression"]):
                raise GraphError("GRAPH_POST_CALCULATION_REAGGREGATION_FORBIDDEN", c["name"])
            if kind == "post_metric" and c.get("inputs"):
                raise GraphError("GRAPH_POST_CALCULATION_INPUTS_FORBIDDEN", c["name"])
            calculations.append({**c, "kind": kind})
        out = {**request, "calculations": calculations}
        if request.get("metrics") in ("*", ["*"]) or request.get("dimensions") in ("*", ["*"]):
            source = request.get("source") or anchor or (request["facts"][0].get("source") if request.get("facts") else None)
            if source is None:
                raise GraphError("GRAPH_DISCOVERY_ANCHOR_REQUIRED")
            seen = self.discover(source)[source]
            if request.get("metrics") in ("*", ["*"]):
                if not seen["metrics"]:
                    raise GraphError("GRAPH_NO_REACHABLE_METRICS", source)
                out |= {"metrics": seen["metrics"], "source": source}
            if request.get("dimensions") in ("*", ["*"]):
                out["dimensions"] = [d for d, state in seen["dimensions"].items() if state == "OK"]
        return out

    def validate(self, request: dict) -> list[dict]:
        """The facts of a normalized request: source, metrics and metric calculations of each."""
        anchor = request.get("source") or request.get("anchor")
        made = [c for c in request["calculations"] if c["kind"] == "metric"]
        if request.get("facts"):
            facts = [{**f, "source": f.get("source") or f.get("sourceModel") or f.get("model")} for f in request["facts"]]
        else:
            by: dict[str | None, list[str]] = {}
            for n in request.get("metrics") or ():
                able = self.bindable(n)
                if anchor is not None and anchor not in able:
                    raise GraphError("GRAPH_METRIC_NOT_BOUND", f"{n} on {anchor}")
                if anchor is None and len(able) > 1:
                    raise GraphError("GRAPH_METRIC_BINDING_AMBIGUOUS", f"{n}: {', '.join(able)}")
                by.setdefault(anchor or (able[0] if able else None), []).append(n)
            if not by and made and anchor:
                by[anchor] = []
            if not by:
                raise GraphError("GRAPH_FACT_REQUIRED")
            facts = [{"source": s, "metrics": names} for s, names in by.items()]
        for f in facts:
            f["metrics"], f["calculations"] = list(f.get("metrics") or ()), []
            if not f["source"]:
                able = set.intersection(*(set(self.bindable(n)) for n in f["metrics"])) if f["metrics"] else set()
                f["source"] = able.pop() if len(able) == 1 else None
            if f["source"] is None:
                raise GraphError("GRAPH_FACT_SOURCE_REQUIRED", ", ".join(f["metrics"]))
            if f["source"] not in self.manifest.models:
                raise GraphError("GRAPH_FACT_SOURCE_NOT_FOUND", str(f["source"]))
            for n in f["metrics"]:
                if f["source"] not in self.bindable(n):
                    raise GraphError("GRAPH_METRIC_BINDING_NOT_FOUND", f"{n} on {f['source']}")
        for c in made:
            at = [f for f in facts if f["source"] == c["source"]] if c.get("source") else facts
            if len(at) != 1:
                raise GraphError("GRAPH_METRIC_CALCULATION_BINDING_AMBIGUOUS", c["name"])
            at[0]["calculations"].append(c)
        for f in facts:
            if not f["metrics"] and not f["calculations"]:
                raise GraphError("GRAPH_FACT_METRIC_REQUIRED", f["source"])
        return facts

    def run(self, request: dict) -> DataFrame:
        """Each fact on its own, then a null-safe full outer merge on the grain, then post metrics."""
        request = self.normalized(request)
        done = [self.fact(f, request) for f in self.validate(request)]
        names = [n for _, _, ms in done for n in ms]
        if len(set(names)) != len(names):
            raise GraphError("GRAPH_OUTPUT_ALIAS_CONFLICT", ", ".join(names))
        out, keys, _ = done[0]
        for df, _, _ in done[1:]:
            right = df.select(*[F.col(exprs.quote(c)).alias(f"~{c}" if c in keys else c) for c in df.columns])
            on = [out[exprs.quote(k)].eqNullSafe(right[exprs.quote(f"~{k}")]) for k in keys]
            merged = out.join(right, on, "full") if keys else out.join(F.broadcast(right))
            grain = [F.coalesce(F.col(exprs.quote(k)), F.col(exprs.quote(f"~{k}"))).alias(k) for k in keys]
            out = merged.select(*grain, *[F.col(exprs.quote(c)) for c in (*out.columns, *df.columns) if c not in keys])
        for c in request["calculations"]:
            if c["kind"] == "post_metric":
                out = out.withColumn(c["name"], F.expr(c["expression"]))
        for o in request.get("orderBy", ()):
            col, down = (o, False) if isinstance(o, str) else (o["member"], o.get("descending", False))
            out = out.orderBy(F.col(col).desc_nulls_last() if down else F.col(col).asc_nulls_last())
        return out.limit(int(request["limit"])) if request.get("limit") is not None else out

    def explain(self, request: dict) -> dict[str, Any]:
        """Strategy and paths of each fact, without running; with ``includeReachable`` also what else
        each source can be asked for."""
        request, plan = self.normalized(request), []
        for f in self.validate(request):
            source, steps = f["source"], {}
            for d in self.grain(request, source):
                for name, model, _, hint in d.parts():
                    try:
                        steps[name] = {"strategy": "SAFE", "path": [e.name for e in self.path(source, model, hint=list(hint) or None, depth=request.get("maxDepth"))]}
                    except GraphError as e:
                        steps[name] = {"strategy": "BRIDGE" if request.get("bridge") else "FANOUT", "reason": e.code}
            one = {"source": source, "metrics": [*f["metrics"], *(c["name"] for c in f["calculations"])], "dimensions": steps}
            plan.append(one | ({"reachable": self.discover(source)[source]} if request.get("includeReachable") else {}))
        return {"facts": plan, "merge": "NULL_SAFE_FULL_OUTER" if len(plan) > 1 else "NONE", "diagnostics": self.diagnostics}
