"""The part of a manifest that a statement needs."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import SparkSession

from sparkloom.functions.registry import translate
from sparkloom.operators.policy import plan_relations
from sparkloom.plans import exprs
from sparkloom.plans.manifest import Manifest


def used_tables(spark: SparkSession, m: Manifest, sql: str) -> list[str]:
    """Tables that a statement reads, sorted, CTEs left out; names that are qualified by another
    catalog or schema than the manifest's are no tables of it."""
    out = set()
    for t in plan_relations(spark, translate(sql).strip().rstrip(";"))[0]:
        *place, name = t.split(".")
        mine = [m.catalog, m.schema][2 - len(place) :] if len(place) <= 2 else None
        if mine is not None and all(a.lower() == b.lower() for a, b in zip(place, mine)):
            out.add(name)
    return sorted(out)


def extract(spark: SparkSession, m: Manifest, names: list[str]) -> Manifest:
    """The manifest of these models and views and of all that they lead to: what views read, targets
    of relationships, and models in row rules' subqueries. Relationships stay if both their models
    do, cubes if their base does, metrics and dimensions if their model does."""
    models, views = {k.lower(): k for k in m.models}, {k.lower(): k for k in m.views}
    seen: set[str] = set()
    todo = [n.lower() for n in names]
    while todo:
        n = todo.pop()
        if n in seen or not (n in models or n in views):
            continue
        seen.add(n)
        if n in views:
            todo += [t.lower() for t in used_tables(spark, m, m.views[views[n]])]
            continue
        model = m.models[models[n]]
        for c in model.columns:
            if c.relationship:
                todo += [x.lower() for x in m.relationships[c.relationship].models]
        for rule in model.rules:
            if exprs.has_subquery(rule.condition):
                todo += sorted(set(models) & exprs.names(rule.condition))
    kept = {models[n] for n in seen if n in models}
    base = kept | {views[n] for n in seen if n in views}
    about = lambda held: {k: v for k, v in held.items() if v.get("model") in kept}
    return replace(
        m, models={k: v for k, v in m.models.items() if k in kept}, views={k: v for k, v in m.views.items() if k in base},
        relationships={k: v for k, v in m.relationships.items() if set(v.models) <= kept},
        cubes={k: v for k, v in m.cubes.items() if v.base in base}, metrics=about(m.metrics), dimensions=about(m.dimensions),
    )
