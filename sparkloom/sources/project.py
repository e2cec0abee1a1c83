"""Projects as folders of YAML, and tables described by dbt artifacts, as manifests."""

from __future__ import annotations

import json
import re
from pathlib import Path
from typing import Any

from sparkloom.plans import exprs

#: Parts of a project: the manifest's field, the folder, and the file that may hold a list instead.
PARTS = ("models", "relationships", "views", "cubes", "metrics", "dimensions")

#: Words in expressions that are no columns.
KEYWORDS = frozenset(
    """all and any array as asc between bigint boolean by case cast date day decimal desc distinct double else end escape
    false filter first float following for from group hour ilike in int integer interval is last like map minute month
    not null nulls or order over partition preceding quarter range rlike rows second separator smallint some string
    struct symmetric then timestamp to trailing true unbounded unknown varchar week when where within year""".split()
)


class ProjectError(ValueError):
    """A folder that is no valid project; ``problems`` lists all findings."""

    def __init__(self, problems: list[str]):
        super().__init__("; ".join(problems))
        self.problems = problems


def camel(x: Any) -> Any:
    """Snake-case keys in camel case, all the way down; values stay."""
    if isinstance(x, dict):
        return {re.sub(r"_([a-z])", lambda m: m[1].upper(), str(k)): camel(v) for k, v in x.items()}
    return [camel(v) for v in x] if isinstance(x, list) else x


def _yaml(path: Path) -> Any:
    try:
        import yaml
    except ImportError as e:
        raise ProjectError(["reading a project needs PyYAML"]) from e
    try:
        return yaml.safe_load(path.read_text(encoding="utf-8"))
    except yaml.YAMLError as e:
        raise ProjectError([f"{path.name}: {e}"]) from e


def read(folder: str) -> dict[str, Any]:
    """The manifest of a project folder, not yet validated: ``project.yml``, and for each part
    ``<part>.yml`` (a list, or a map with that part) and the files of ``<part>/``, one item or a
    list each, in the order of their names. Metrics' files may hold their own ``metrics`` list."""
    root = Path(folder)
    if not (root / "project.yml").is_file():
        raise ProjectError(["project.yml is missing"])
    out: dict[str, Any] = {**camel(_yaml(root / "project.yml") or {})}
    for part in PARTS:
        files = [root / f"{part}.yml", *sorted(p for p in (root / part).rglob("*.y*ml"))]
        items: list[Any] = []
        for f in files:
            if f.is_file():
                held = _yaml(f) or []
                held = held.get(part, held) if isinstance(held, dict) else held
                items += held if isinstance(held, list) else [held]
        out[part] = [*out.get(part, []), *map(camel, items)]
    return out


def _named(items: list[dict], kind: str, problems: list[str]) -> set[str]:
    seen: set[str] = set()
    for x in items:
        name = x.get("name") if isinstance(x, dict) else None
        if not name:
            problems.append(f"{kind} without a name")
        elif name in seen:
            problems.append(f"{kind} {name}: named twice")
        seen.add(name)
    return seen - {None}


def expand(name: str, held: dict[str, str], stack: tuple[str, ...] = ()) -> str:
    """An expression with the members of ``held`` that it names put in, in parentheses."""
    if name in stack:
        raise ProjectError([f"cycle: {' -> '.join((*stack, name))}"])
    inner = lambda p: f"({expand(p[0], held, (*stack, name))})" if len(p) == 1 and p[0] in held and p[0] != name else None
    return exprs.rewrite(held[name], inner)


def check(raw: dict[str, Any]) -> list[str]:
    """Findings, all of them: required fields, names, sources, keys, relationships' models, views'
    statements, metrics and dimensions (unique, acyclic, on columns that cubes' bases have)."""
    bad: list[str] = []
    if not raw.get("name"):
        bad.append("project without a name")
    names = _named(raw["models"], "model", bad)
    views = _named(raw["views"], "view", bad)
    bad += [f"{n}: a model and a view" for n in sorted(names & views)]
    for m in raw["models"]:
        who = f"model {m.get('name')}"
        cols = m.get("columns") or []
        if not cols:
            bad.append(f"{who}: no columns")
        bad += [f"{who}: a column without name or type" for c in cols if not c.get("name") or not (c.get("type") or c.get("relationship"))]
        table = m.get("tableReference")
        if bool(table) == bool(m.get("refSql")):
            bad.append(f"{who}: needs a table or a query, not both")
        if isinstance(table, dict) and not table.get("table"):
            bad.append(f"{who}: table reference without a table")
        keys = m.get("primaryKey") or []
        held = {c.get("name") for c in cols}
        bad += [f"{who}: key {k} is no column" for k in ([keys] if isinstance(keys, str) else keys) if k not in held]
    for r in raw["relationships"]:
        bad += [f"relationship {r.get('name')}: no model {x}" for x in r.get("models") or ["?"] if x not in names]
    bad += [f"view {v.get('name')}: no statement" for v in raw["views"] if not v.get("statement")]
    for kind in ("metrics", "dimensions"):
        _named(raw[kind], kind[:-1], bad)
        held = {x["name"]: x["expression"] for x in raw[kind] if x.get("name") and x.get("expression")}
        for name in held:
            try:
                expand(name, held)
            except ProjectError as e:
                bad += e.problems
        columns = {m.get("name"): {c.get("name") for c in m.get("columns") or []} for m in raw["models"]}
        for cube in raw["cubes"]:
            base = columns.get(cube.get("baseObject"))
            for member in cube.get("measures" if kind == "metrics" else kind) or []:
                if isinstance(member, str) and member not in held:
                    bad.append(f"cube {cube.get('name')}: no {kind[:-1]} {member}")
                elif isinstance(member, str) and base is not None and not any("cycle" in b for b in bad):
                    lost = sorted({p[0] for p in exprs.paths(expand(member, held)) if len(p) == 1 and p[0].lower() not in KEYWORDS} - base)
                    bad += [f"cube {cube.get('name')}: {member} needs {c}" for c in lost]
    return list(dict.fromkeys(bad))


def build(folder: str) -> dict[str, Any]:
    """The validated manifest of a project: cubes' members given by name are expanded."""
    raw = read(folder)
    if problems := check(raw):
        raise ProjectError(problems)
    for kind, fields in (("metrics", ("measures",)), ("dimensions", ("dimensions", "timeDimensions"))):
        held = {x["name"]: x["expression"] for x in raw[kind] if x.get("expression")}
        for cube in raw["cubes"]:
            for f in fields:
                if cube.get(f):
                    cube[f] = [{"name": x, "expression": expand(x, held)} if isinstance(x, str) else x for x in cube[f]]
        for x in raw[kind]:
            if x.get("expression"):
                x["expression"] = expand(x["name"], held)
    return {k: v for k, v in raw.items() if k in (*PARTS, "catalog", "schema", "layoutVersion", "graph")}


def from_dbt(manifest: str | dict, catalog: str | dict | None = None) -> dict[str, Any]:
    """A manifest from dbt's ``manifest.json`` (and ``catalog.json`` for column types): models,
    seeds, snapshots and sources are models; ``relationships`` tests are relationships; a column
    tested as unique and not null is the key. Columns without a known type are text."""
    text = lambda x: x if isinstance(x, dict) or x is None else json.loads(Path(x).read_text(encoding="utf-8"))
    raw, types = text(manifest), text(catalog) or {}
    kinds = {**raw.get("nodes", {}), **raw.get("sources", {})}
    tables = {k: n for k, n in kinds.items() if n.get("resource_type") in ("model", "seed", "snapshot", "source")}
    tested: dict[tuple[str, str], set[str]] = {}
    links = []
    for n in kinds.values():
        test = n.get("test_metadata") or {}
        on = [d for d in (n.get("depends_on") or {}).get("nodes", []) if d in tables]
        own = n.get("attached_node") or (on[-1] if on else None)
        args = test.get("kwargs") or {}
        column = n.get("column_name") or args.get("column_name")
        if own not in tables or not column:
            continue
        if test.get("name") in ("unique", "not_null"):
            tested.setdefault((own, column), set()).add(test["name"])
        elif test.get("name") == "relationships":
            links += [(own, column, d, args["field"]) for d in on if d != own][:1]
    models, rels = [], []
    for key, n in tables.items():
        seen = ((types.get("nodes") or {}).get(key) or (types.get("sources") or {}).get(key) or {}).get("columns", {})
        known = {c.lower(): v for c, v in seen.items()}
        declared = {**{v.get("name", c): {} for c, v in seen.items()}, **n.get("columns", {})}
        folded: dict[str, str] = {}
        for c in (*n.get("columns", {}), *declared):
            folded.setdefault(c.lower(), c)
        cols = [{"name": c, "type": (declared[c] or {}).get("data_type") or known.get(low, {}).get("type") or "varchar"} for low, c in folded.items()]
        table = {"catalog": n.get("database"), "schema": n.get("schema"), "table": n.get("identifier") or n.get("alias") or n["name"]}
        pk = [c for (k, c), t in tested.items() if k == key and len(t) == 2]
        models.append({"name": n["name"], "tableReference": {k: v for k, v in table.items() if v}, "primaryKey": pk[:1], "columns": cols})
    for own, column, other, field in links:
        a, b = tables[own]["name"], tables[other]["name"]
        rels.append({"name": f"{a}_{column}_{b}", "models": [a, b], "joinType": "MANY_TO_ONE", "condition": f"{a}.{column} = {b}.{field}"})
    return {"models": models, "relationships": rels, "views": [], "cubes": [], "metrics": [], "dimensions": []}
