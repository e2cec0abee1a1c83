"""Demand-driven construction of model DataFrames."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.plans import access, exprs
from sparkloom.plans.manifest import Column, Manifest, ManifestError, Model, Relationship

_fresh = itertools.count()


class ModelBuilder:
    """Builds a model from its source: only the columns, joins and aggregates that are needed.

    To-one paths are left joins that keep the base rows, one for each path prefix, so two roles of
    one model and branching paths stay apart. Each aggregate of a calculation is taken over its own
    path to the many side: the children are grouped by their foreign key, all aggregates over one
    path at once, and joined to the base, so paths never multiply each other's rows. Row rules
    filter what a model yields, also where it is the target of a relationship.
    """

    def __init__(
        self, spark: SparkSession, manifest: Manifest, sources: dict[str, DataFrame], props: dict[str, object] | None = None,
        built: dict[tuple, DataFrame] | None = None,
    ):
        self.spark, self.manifest, self.sources, self.props = spark, manifest, sources, props or {}
        #: Models built with these properties before, by name and columns.
        self.built = {} if built is None else built
        self._visible: dict[str, list[str]] = {}
        #: Whether everything built so far comes from registered sources, whose plans stay valid.
        self.settled = True

    # -- lineage ---------------------------------------------------------------------------------

    def relation(self, model: Model, col: Column) -> tuple[Relationship, Model, list[tuple[str, str]]]:
        rel = self.manifest.relationships[col.relationship]
        if rel.models[0] == model.name and (rel.models[1] == col.type or rel.models[0] != rel.models[1]):
            return rel, self.manifest.model(rel.models[1]), list(rel.pairs)
        if rel.models[1] == model.name:
            return rel, self.manifest.model(rel.models[0]), [(b, a) for a, b in rel.pairs]
        raise ManifestError("RELATIONSHIP_CHAIN_INVALID", f"{model.name}.{col.name}")

    def uses(self, model: Model, expression: str) -> tuple[list[str], list[tuple[str, ...]]]:
        """Local columns and relationship paths of an expression."""
        local, far = [], []
        for p in exprs.paths(expression):
            if len(p) > 1 and p[0] == model.name and model.column(p[1]) is not None:
                p = p[1:]
            col = model.column(p[0])
            if col is None:
                continue
            if col.relationship:
                if len(p) < 2:
                    raise ManifestError("RELATIONSHIP_AS_VALUE", f"{model.name}.{p[0]}")
                far.append(p)
            else:
                local.append(col.name)
        return list(dict.fromkeys(local)), list(dict.fromkeys(far))

    def denied(self, model: Model, name: str, stack: tuple = ()) -> str | None:
        """The rule that hides a column, its own or that of a column it is calculated from."""
        col = model.column(name)
        if col is None or (model.name, name) in stack:
            return None
        if not access.column_visible(col.access, self.props):
            return f'Access denied to column "{model.name}"."{col.name}": violates access control rule "{col.access.name}"'
        if col.calculated:
            local, far = self.uses(model, col.expression)
            for x in local:
                if why := self.denied(model, x, (*stack, (model.name, name))):
                    return why
            for p in far:
                target, here = model, p
                while len(here) > 1:
                    c = target.column(here[0])
                    if c is None or not c.relationship:
                        break
                    target, here = self.relation(target, c)[1], here[1:]
                if why := self.denied(target, here[0], (*stack, (model.name, name))):
                    return why
        return None

    def visible(self, model: Model) -> list[str]:
        if model.name not in self._visible:
            self._visible[model.name] = [c.name for c in model.visible() if self.denied(model, c.name) is None]
        return self._visible[model.name]

    # -- construction ----------------------------------------------------------------------------

    def source(self, model: Model) -> DataFrame:
        if model.table:
            for name in (model.table, model.table.rsplit(".", 1)[-1]):
                if name in self.sources:
                    return self.sources[name]
            self.settled = False
            return self.spark.table(model.table)
        # Registered sources come in under their names as CTEs over views of this statement alone,
        # so no view of the session is hidden. Analysis is eager: the views go as soon as there is a plan.
        used = {n: f"sparkloom_source_{next(_fresh)}" for n in self.sources if n.lower() in exprs.names(model.ref_sql)}
        for name, view in used.items():
            self.sources[name].createOrReplaceTempView(view)
        try:
            return self.spark.sql(exprs.with_ctes([(n, f"SELECT * FROM {v}") for n, v in used.items()], model.ref_sql))
        finally:
            for view in used.values():
                self.spark.catalog.dropTempView(view)

    def build(self, name: str, needed: list[str] | None = None, stack: tuple[str, ...] = ()) -> DataFrame:
        model = self.manifest.model(name)
        if needed is None:
            needed = self.visible(model)
        key = (model.name, tuple(needed), stack)
        if key not in self.built:
            # What reads a catalog table is planned anew each time.
            settled, self.settled = self.settled, True
            df = self._build(model, needed, stack)
            if not self.settled:
                return df
            self.settled, self.built[key] = settled, df
        return self.built[key]

    def _build(self, model: Model, needed: list[str], stack: tuple[str, ...]) -> DataFrame:
        want = []
        for n in needed:
            col = model.column(n)
            if col is None or col.relationship:
                raise ManifestError("COLUMN_NOT_FOUND", f"{model.name}.{n}")
            if why := self.denied(model, col.name):
                raise access.AccessError(why)
            want.append(col.name)
        rules = [c for r in model.rules if (c := access.row_condition(r, self.props)) is not None]
        for c in rules:
            want += [x for x in self.uses(model, c)[0] if x not in want]
        df = self.columns(model, want, stack)
        for c in rules:
            df = self.filtered(model, df, c, stack)
        out = [model.column(n).name for n in needed]
        return df.select(*[F.col(exprs.quote(n)) for n in dict.fromkeys(out)]) if out else df

    def filtered(self, model: Model, df: DataFrame, condition: str, stack: tuple[str, ...]) -> DataFrame:
        local = lambda p: exprs.quote(model.column(p[-1]).name) if (len(p) == 1 or p[0] == model.name) and model.column(p[-1]) else None
        if not exprs.has_subquery(condition):
            return df.filter(F.expr(exprs.rewrite(condition, local)))
        # Models in the subquery come with their own rules; a rule that leads back is a cycle.
        used = {m for m in self.manifest.models if m.lower() in exprs.names(condition)}
        if model.name in used or used & set(stack):
            raise access.AccessError(f"row rules form a cycle at {model.name}")
        alias, views = f"_model_{next(_fresh)}", {}
        for m in used:
            views[m.lower()] = f"_model_{next(_fresh)}"
            self.build(m, None, (*stack, model.name)).createOrReplaceTempView(views[m.lower()])
        df.createOrReplaceTempView(alias)
        text = exprs.rewrite(condition, lambda p: ".".join([views[p[0].lower()], *map(exprs.quote, p[1:])]) if p[0].lower() in views else None)
        out = self.spark.sql(f"SELECT * FROM {alias} WHERE {text}")
        for v in (alias, *views.values()):
            self.spark.catalog.dropTempView(v)
        return out

    def columns(self, model: Model, want: list[str], stack: tuple[str, ...]) -> DataFrame:
        """The wanted columns over the source, before row rules."""
        order: list[Column] = []

        def visit(name: str, path: tuple[str, ...]) -> None:
            col = model.column(name)
            if col.name in path:
                raise ManifestError("CALCULATION_CYCLE", f"{model.name}: {' -> '.join((*path, col.name))}")
            if col in order:
                return
            if col.calculated:
                local, far = self.uses(model, col.expression)
                for x in local:
                    visit(x, (*path, col.name))
                for p in far:
                    for k, _ in self.relation(model, model.column(p[0]))[2]:
                        visit(k, (*path, col.name))
                if far and exprs.has_aggregate(col.expression):
                    if not model.primary_key:
                        raise ManifestError("PRIMARY_KEY_MISSING", f"{model.name}.{col.name} aggregates over a relationship")
                    for k in model.primary_key:
                        visit(k, (*path, col.name))
            order.append(col)

        for n in want:
            visit(n, ())
        plain = [c for c in order if not c.calculated]
        src = self.source(model)
        picked = [F.expr(c.expression if c.expression else exprs.quote(c.name)).alias(c.name) for c in plain]
        df = src.select(*picked) if picked else src.select(F.lit(1).alias("_row"))
        calculated = [c for c in order if c.calculated]
        aggregated = {c.name: exprs.split_aggregates(c.expression) for c in calculated if self.uses(model, c.expression)[1] and exprs.has_aggregate(c.expression)}
        outside = [" ".join(t for call, t in aggregated[c.name] if not call) if c.name in aggregated else c.expression for c in calculated]
        far = list(dict.fromkeys(p for text in outside for p in self.uses(model, text)[1]))
        if many := next((p for p in far if self.chain(model, p)), None):
            raise ManifestError("TO_MANY_WITHOUT_AGGREGATE", f"{model.name}: {'.'.join(many)}")
        df, place = self.join_paths(model, df, far, stack)
        df, held = self.aggregates(model, df, [t for parts in aggregated.values() for call, t in parts if call], stack)
        for c in calculated:
            text = c.expression
            if c.name in aggregated:
                rest = []
                for call, t in aggregated[c.name]:
                    if call and t not in held:
                        # It also names the base's own columns, which exist only by now.
                        df, held[t] = self.beside_children(model, df, t, stack)
                    rest.append(held[t] if call else exprs.rewrite(t, lambda p: self.named(model, p, place)))
                text = "".join(rest)
            else:
                text = exprs.rewrite(text, lambda p: self.named(model, p, place))
            df = df.withColumn(c.name, F.expr(text))
        return df

    def chain(self, model: Model, path: tuple[str, ...]) -> tuple[str, ...]:
        """The part of a path up to its last step to the many side; empty if all steps are to one."""
        end, at = 0, model
        for k, step in enumerate(path[:-1]):
            col = at.column(step)
            if col is None or not col.relationship:
                break
            rel, target, _ = self.relation(at, col)
            forward = rel.models[0] == at.name and target.name == rel.models[1]
            if rel.sides[1 if forward else 0] == "MANY":
                end = k + 1
            at = target
        return path[:end]

    def trunk(self, model: Model, call: str) -> tuple[str, ...]:
        """The one path to the many side that an aggregate is over."""
        paths = self.uses(model, call)[1]
        chains = sorted({self.chain(model, p) for p in paths}, key=len)
        for c in chains:
            if chains[-1][: len(c)] != c:
                raise ManifestError("AGGREGATE_PATHS_MIXED", f"{model.name}: {call} is over {'.'.join(c)} and {'.'.join(chains[-1])}")
        return chains[-1] or (paths[0][:1] if paths else ())

    def aggregates(self, model: Model, df: DataFrame, calls: list[str], stack: tuple[str, ...]) -> tuple[DataFrame, dict[str, str]]:
        """Joins the values of aggregates that are over children alone; text of each by call."""
        groups: dict[tuple[str, ...], list[str]] = {}
        for t in dict.fromkeys(calls):
            local, far = self.uses(model, t)
            trunk = self.trunk(model, t)
            if far and not local and {p[0] for p in far} == {trunk[0]}:
                groups.setdefault(trunk, []).append(t)
        held: dict[str, str] = {}
        for trunk, texts in groups.items():
            col = model.column(trunk[0])
            _, target, keys = self.relation(model, col)
            paths = list(dict.fromkeys(p[1:] for t in texts for p in self.uses(model, t)[1]))
            deeper = [p for p in paths if len(p) > 1]
            direct = {p[0] for p in paths if len(p) == 1} | {b for _, b in keys}
            for p in paths:
                if target.column(p[0]) is None:
                    raise ManifestError("COLUMN_NOT_FOUND", f"{target.name}.{p[0]}")
            direct |= {a for p in deeper for a, _ in self.relation(target, target.column(p[0]))[2]}
            child = self.build(target.name, sorted(target.column(n).name for n in direct), stack)
            child, place = self.join_paths(target, child, deeper, stack)
            n, values = next(_fresh), []
            for k, t in enumerate(texts):
                text = exprs.rewrite(t, lambda p: self.named(target, p[1:] if p[0] == trunk[0] else p[2:] if p[0] == model.name else p, place))
                name = f"_value.{n}.{k}"
                values.append(F.expr(text).alias(name))
                held[t] = exprs.of_nothing(t, exprs.quote(name))
            by = [F.col(exprs.quote(target.column(b).name)).alias(f"_key.{n}.{b}") for _, b in keys]
            summed = child.groupBy(*by).agg(*values)
            on = [df[exprs.quote(model.column(a).name)] == summed[exprs.quote(f"_key.{n}.{b}")] for a, b in keys]
            df = df.join(summed, on, "left")
        return df, held

    @staticmethod
    def named(model: Model, p: tuple[str, ...], place: dict[tuple[str, ...], str]) -> str | None:
        if len(p) > 1 and p[0] == model.name:
            p = p[1:]
        if p in place:
            return exprs.quote(place[p])
        col = model.column(p[0])
        return ".".join([exprs.quote(col.name), *map(exprs.quote, p[1:])]) if col else None

    def join_paths(self, model: Model, df: DataFrame, far: list[tuple[str, ...]], stack: tuple[str, ...], prefix: str = "") -> tuple[DataFrame, dict]:
        """Left joins along a trie of paths; a target's needed columns get names of their own."""
        place: dict[tuple[str, ...], str] = {}
        for head in dict.fromkeys(p[0] for p in far):
            col = model.column(head)
            _, target, keys = self.relation(model, col)
            mine = [p[1:] for p in far if p[0] == head]
            deeper = [p for p in mine if (c := target.column(p[0])) is not None and c.relationship]
            direct = [p for p in mine if p not in deeper]
            need = {target.column(p[0]).name for p in direct if target.column(p[0])}
            for p in direct:
                if target.column(p[0]) is None:
                    raise ManifestError("COLUMN_NOT_FOUND", f"{target.name}.{p[0]}")
            need |= {b for _, b in keys}
            for p in deeper:
                need |= {a for a, _ in self.relation(target, target.column(p[0]))[2]}
            need = sorted(target.column(n).name for n in need)
            tag = f"{prefix}{head}."
            right = self.build(target.name, need, stack)
            right = right.select(*[F.col(exprs.quote(n)).alias(f"_{tag}{n}") for n in need])
            on = [df[exprs.quote(self._as(model, a, prefix))] == right[exprs.quote(f"_{tag}{target.column(b).name}")] for a, b in keys]
            df = df.join(right, on, "left")
            for p in direct:
                place[(head, *p)] = f"_{tag}{target.column(p[0]).name}"
            if deeper:
                df, more = self.join_paths(target, df, deeper, stack, tag)
                place |= {(head, *p): v for p, v in more.items()}
        return df, place

    @staticmethod
    def _as(model: Model, name: str, prefix: str) -> str:
        name = model.column(name).name
        return f"_{prefix}{name}" if prefix else name

    def beside_children(self, model: Model, df: DataFrame, call: str, stack: tuple[str, ...]) -> tuple[DataFrame, str]:
        """An aggregate that also names the base's columns: the base joined with the children of its
        one path, grouped by the primary key."""
        local, far = self.uses(model, call)
        keys = [model.column(k).name for k in model.primary_key]
        ends = [a for p in far for a, _ in self.relation(model, model.column(p[0]))[2]]
        base = self.columns(model, list(dict.fromkeys([*keys, *local, *ends])), stack)
        joined, place = self.join_paths(model, base, far, stack)
        n = next(_fresh)
        value = F.expr(exprs.rewrite(call, lambda p: self.named(model, p, place))).alias(f"_value.{n}")
        summed = joined.groupBy(*[F.col(exprs.quote(k)).alias(f"_key.{n}.{k}") for k in keys]).agg(value)
        on = [df[exprs.quote(k)] == summed[exprs.quote(f"_key.{n}.{k}")] for k in keys]
        return df.join(summed, on, "left"), exprs.quote(f"_value.{n}")
