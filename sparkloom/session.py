"""The engine's facade: register sources, load a manifest, ask."""

from __future__ import annotations

import itertools
from collections import OrderedDict
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions.registry import RemoteFunction, define, install, translate
from sparkloom.operators import cube as cubes
from sparkloom.operators import graph as graphs
from sparkloom.operators import graph_inspect, partitions, questions
from sparkloom.operators import policy as policies
from sparkloom.plans import access, exprs
from sparkloom.plans import extract as extraction
from sparkloom.plans.manifest import Manifest, ManifestError, load
from sparkloom.plans.models import ModelBuilder


_fresh = itertools.count()
_MOST_VIEWS = 200


class Engine:
    """Semantic SQL, cube and graph queries as lazy DataFrames.

    A query sees models and views only, each built with just the columns that it names. Sources
    are registered first; ``load`` then binds a manifest to them.
    """

    def __init__(self, spark: SparkSession, manifest: str | dict | Manifest | None = None, policy: policies.Policy | None = None):
        self.spark = spark
        self.sources: dict[str, DataFrame] = {}
        self.policy = policy or policies.Policy()
        self.audit = policies.AuditLog()
        self.manifest = Manifest({})
        #: Views of models already built, by what they were built from; the oldest go first.
        self._views: OrderedDict[tuple, str] = OrderedDict()
        #: DataFrames of models built, by properties and time zone.
        self._built: OrderedDict[tuple, dict] = OrderedDict()
        install(spark)
        if manifest is not None:
            self.load(manifest)

    def register(self, name: str, df: DataFrame) -> Engine:
        self.sources[name] = df
        self.close()
        return self

    def load(self, manifest: str | dict | Manifest) -> Engine:
        self.manifest = manifest if isinstance(manifest, Manifest) else load(manifest)
        access.check_rules(self.manifest)
        self.close()
        return self

    def close(self) -> None:
        """Drops the engine's views; DataFrames that it returned stay valid."""
        self._built.clear()
        while self._views:
            self.spark.catalog.dropTempView(self._views.popitem()[1])

    def define_function(self, record: RemoteFunction, body: str | Callable) -> Engine:
        """Makes a user function callable: a SQL expression over its parameters, or a pandas function."""
        define(self.spark, record, body)
        return self

    def tables(self) -> list[str]:
        return sorted(self.sources)

    def _state(self, properties: dict[str, object] | None) -> tuple[str, str]:
        """What a model's plan depends on besides the manifest and the sources."""
        return repr(sorted((properties or {}).items())), self.spark.conf.get("spark.sql.session.timeZone")

    def builder(self, properties: dict[str, object] | None = None) -> ModelBuilder:
        """A builder in the session's present time zone."""
        built = self._built.setdefault(self._state(properties), {})
        while len(self._built) > _MOST_VIEWS or sum(map(len, self._built.values())) > 5 * _MOST_VIEWS:
            self._built.popitem(last=False)
        return ModelBuilder(self.spark, self.manifest, self.sources, properties or {}, built)

    @contextmanager
    def _zone(self, properties: dict[str, object] | None) -> Iterator[None]:
        """The time zone of a query while it is analysed, which is when Spark writes it into the plan."""
        zone = {k.lower(): v for k, v in (properties or {}).items()}.get("x-sparkloom-timezone")
        if not zone:
            yield
            return
        before = self.spark.conf.get("spark.sql.session.timeZone")
        self.spark.conf.set("spark.sql.session.timeZone", str(zone))
        try:
            yield
        finally:
            self.spark.conf.set("spark.sql.session.timeZone", before)

    def model(self, name: str, columns: list[str] | None = None, properties: dict[str, object] | None = None) -> DataFrame:
        with self._zone(properties):
            return self.builder(properties).build(name, columns)

    def _view(self, builder: ModelBuilder, state: tuple, name: str, need: list[str], latest: str | None) -> str:
        """A view of a model under a name of the engine's own, kept for later statements with the
        same columns, properties and time zone."""
        key = (name, tuple(sorted(need)), latest, *state)
        if (found := self._views.get(key)) is not None:
            self._views.move_to_end(key)
            return found
        builder.settled = True
        df = self._latest(builder, name, need, latest) if latest else builder.build(name, need)
        view = f"sparkloom_model_{next(_fresh)}"
        df.createOrReplaceTempView(view)
        # The plan of a catalog table can change; such a view serves one statement.
        self._views[key if builder.settled else (view,)] = view
        while len(self._views) > _MOST_VIEWS:
            self.spark.catalog.dropTempView(self._views.popitem(last=False)[1])
        return view

    def query(self, sql: str, limit: int | None = None, properties: dict[str, object] | None = None) -> DataFrame:
        """Runs SQL over models and views; at most ``limit`` rows if given.

        Models and views that the statement names are CTEs in front of it, so the session's own
        views of these names are neither read nor touched.
        """
        sql = self._local(translate(sql)).strip().rstrip(";")
        rules, latest = self.manifest.graph.get("partitions") or {}, set()
        if self.policy.partitions:
            latest = partitions.check(sql, rules)
        sql = partitions.latest_terms(sql, rules)
        policies.check(self.spark, sql, self.policy, {*self.manifest.models, *self.manifest.views, "information_schema_tables", "information_schema_columns"})
        self.audit.record({"event": "query", "sql": sql})
        text, views = [sql], dict(self.manifest.views)
        while hit := [k for k in views if any(k.lower() in exprs.names(t) for t in text)]:
            text += [views.pop(k) for k in hit]
        used = set().union(*(exprs.names(t) for t in text))
        every = any(self._star(t) for t in text)
        with self._zone(properties):
            builder, state = self.builder(properties), self._state(properties)
            try:
                heads: list[tuple[str, str]] = []
                for name in self.manifest.models:
                    if name.lower() not in used:
                        continue
                    model = self.manifest.model(name)
                    seen = builder.visible(model)
                    need = seen if every else [c for c in seen if c.lower() in used]
                    # With no column named, as in count(*), one plain column carries the rows.
                    plain = [c for c in seen if not model.column(c).calculated]
                    need = need or plain[:1] or seen
                    view = self._view(builder, state, name, need, rules[name]["column"] if name.lower() in latest else None)
                    heads.append((name, f"SELECT * FROM {view}"))
                for what in ("tables", "columns"):
                    if f"information_schema_{what}" in used:
                        view = f"sparkloom_schema_{next(_fresh)}"
                        self._catalog_rows(what, builder).createOrReplaceTempView(view)
                        self._views[(view,)] = view
                        heads.append((f"information_schema_{what}", f"SELECT * FROM {view}"))
                left = {k: v for k, v in self.manifest.views.items() if k.lower() in used}
                while left:
                    # Views over views: those whose own views exist come first.
                    ready = [k for k, v in left.items() if not ({x.lower() for x in left} - {k.lower()}) & exprs.names(v)] or list(left)
                    heads += [(k, left.pop(k).strip().rstrip(";")) for k in ready]
                out = self.spark.sql(exprs.with_ctes(heads, sql))
            except Exception as e:
                self._explain_denial(builder, used, e)
                raise
        return out if limit is None else out.limit(limit)

    @staticmethod
    def _latest(builder: ModelBuilder, name: str, need: list[str], column: str) -> DataFrame:
        """A snapshot model at its latest day; the right side is one row."""
        df = builder.build(name, list(dict.fromkeys([*need, column])))
        top = builder.build(name, [column]).agg(F.max(exprs.quote(column)).alias("_latest"))
        return df.join(F.broadcast(top), df[exprs.quote(column)] == top["_latest"], "left_semi")

    def _local(self, sql: str) -> str:
        """Names qualified by the manifest's catalog and schema, without them; the two tables of the
        information schema by their local names."""
        catalog, schema = self.manifest.catalog.lower(), self.manifest.schema.lower()
        known = {k.lower() for k in (*self.manifest.models, *self.manifest.views)}

        def strip(path: tuple[str, ...]) -> str | None:
            low = [p.lower() for p in path]
            if low[-2:] in (["information_schema", "tables"], ["information_schema", "columns"]):
                return "_".join(low[-2:])
            if catalog and schema and len(path) > 2 and low[:2] == [catalog, schema]:
                return ".".join(exprs.quote(p) for p in path[2:])
            if schema and len(path) > 1 and low[0] == schema and low[1] in known and schema not in known:
                return ".".join(exprs.quote(p) for p in path[1:])
            return None

        return exprs.rewrite(sql, strip)

    def _catalog_rows(self, what: str, builder: ModelBuilder) -> DataFrame:
        """Rows of the information schema: models and views, or the models' visible columns."""
        m = self.manifest
        place = (m.catalog or "sparkloom", m.schema or "public")
        if what == "tables":
            rows = [(*place, n, "BASE TABLE") for n in m.models] + [(*place, n, "VIEW") for n in m.views]
            return self.spark.createDataFrame(rows, "table_catalog string, table_schema string, table_name string, table_type string")
        rows = []
        for n in m.models:
            model = m.model(n)
            for k, c in enumerate(builder.visible(model)):
                col = model.column(c)
                rows.append((*place, n, c, k, col.type, "NO" if col.not_null else "YES"))
        return self.spark.createDataFrame(rows, "table_catalog string, table_schema string, table_name string, column_name string, ordinal_position int, data_type string, is_nullable string")

    @staticmethod
    def _star(sql: str) -> bool:
        ts = [t for t in exprs.tokens(sql) if t.kind not in ("space", "comment")]
        for k, t in enumerate(ts):
            if t.text == "*":
                before, after = (ts[k - 1].text.lower() if k else ""), (ts[k + 1].text if k + 1 < len(ts) else "")
                if before in ("select", "distinct", "all", ",", ".") or before == "(" and after != ")":
                    return True
        return any(t.text.lower() == "natural" for t in ts)

    def _explain_denial(self, builder: ModelBuilder, used: set[str], error: Exception) -> None:
        if isinstance(error, (access.AccessError, ManifestError)):
            return
        for name in self.manifest.models:
            if name.lower() in used:
                model = self.manifest.model(name)
                for c in model.columns:
                    if c.name.lower() in used and not c.relationship and (why := builder.denied(model, c.name)):
                        raise access.AccessError(why) from error

    def dry_run(self, sql: str, properties: dict[str, object] | None = None) -> str:
        """Analyses without running; the formatted schema."""
        return self.query(sql, properties=properties).schema.simpleString()

    def used_tables(self, sql: str) -> list[str]:
        return extraction.used_tables(self.spark, self.manifest, sql)

    def extract(self, sql: str) -> Manifest:
        """The least manifest that the statement can run with."""
        return extraction.extract(self.spark, self.manifest, self.used_tables(sql))

    def explain(self, sql: str, properties: dict[str, object] | None = None) -> str:
        return self.query(sql, properties=properties)._jdf.queryExecution().toString()

    def cube_query(self, query: dict | cubes.CubeQuery, properties: dict[str, object] | None = None) -> DataFrame:
        q = query if isinstance(query, cubes.CubeQuery) else cubes.parse_query(query)
        cube = self.manifest.cubes.get(q.cube)
        if cube is None:
            raise ManifestError("CUBE_NOT_FOUND", q.cube)
        used = set().union(*(exprs.names(e) for e in (*cube.measures.values(), *cube.dimensions.values(), *cube.time_dimensions.values())))
        if cube.base in self.manifest.views:
            base = self.query(f"SELECT * FROM {exprs.quote(cube.base)}", properties=properties)
        else:
            builder = self.builder(properties)
            model = self.manifest.model(cube.base)
            names = [c for c in builder.visible(model) if c.lower() in used]
            base = self.model(cube.base, names or builder.visible(model)[:1], properties)
        with self._zone(properties):
            return cubes.run_cube(base, cube, q)

    def graph_query(self, request: dict[str, Any], properties: dict[str, object] | None = None) -> DataFrame:
        with self._zone(properties):
            return graphs.GraphPlanner(self.manifest, self.builder(properties)).run(request)

    def graph_explain(self, request: dict[str, Any]) -> dict[str, Any]:
        return graphs.GraphPlanner(self.manifest, self.builder()).explain(request)

    def graph_discover(self, source: str | None = None) -> dict[str, Any]:
        """Metrics and dimensions that can be asked for, by source model."""
        return graphs.GraphPlanner(self.manifest, self.builder()).discover(source)

    def ask(self, question: str, *, anchor: str | None = None, dates: tuple[str, str] | None = None, properties: dict[str, object] | None = None) -> DataFrame:
        """Answers a question over global metrics and dimensions; unclear ones are errors."""
        with self._zone(properties):
            planner = graphs.GraphPlanner(self.manifest, self.builder(properties))
            return planner.run(questions.resolve(planner, question, anchor=anchor, dates=dates).request)

    def ask_cube(self, question: str, properties: dict[str, object] | None = None) -> DataFrame:
        return self.cube_query(questions.resolve_cube(self.manifest, question), properties)

    def inspect(self, query: str, parameters: dict[str, Any] | None = None, *, max_rows: int = 10_000) -> DataFrame:
        """A read-only pattern query over the manifest's own graph."""
        nodes, edges = graph_inspect.manifest_graph(self.spark, self.manifest)
        return graph_inspect.inspect(nodes, edges, query, parameters, max_rows=max_rows)
