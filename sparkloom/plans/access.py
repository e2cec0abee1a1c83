"""Row-level and column-level access rules."""

from __future__ import annotations

from sparkloom.plans.exprs import bind_properties, properties
from sparkloom.plans.manifest import AccessRule, Manifest


class AccessError(PermissionError):
    """A query that the session's properties don't permit."""


def _value(rule: AccessRule, props: dict[str, object]) -> dict[str, str] | None:
    """Values of a rule's properties; None if the rule doesn't apply. A missing required property
    is an error; a missing optional one takes its default or switches the rule off."""
    low = {k.lower(): v for k, v in props.items()}
    out: dict[str, str] = {}
    for p in rule.required:
        name, default = p["name"], p.get("defaultExpr")
        if name.lower() in low:
            value = low[name.lower()]
            if value is None or not str(value).strip():
                raise AccessError(f"session property {name} of rule {rule.name} is blank")
            out[name] = value
        elif p.get("required"):
            raise AccessError(f"session property {name} is required by rule {rule.name}")
        elif default not in (None, ""):
            out[name] = default
        else:
            return None
    return out


def row_condition(rule: AccessRule, props: dict[str, object]) -> str | None:
    """The rule's condition with literals for its properties; None if it doesn't apply."""
    values = _value(rule, props)
    if values is None:
        return None
    try:
        return bind_properties(rule.condition, values)
    except KeyError as e:
        raise AccessError(f"rule {rule.name} uses the undeclared property {e.args[0]}") from e
    except ValueError as e:
        raise AccessError(f"rule {rule.name}: {e}") from e


def validate_rule(rule: AccessRule) -> None:
    declared = {p["name"].lower() for p in rule.required}
    for name in properties(rule.condition):
        if name.lower() not in declared:
            raise AccessError(f"rule {rule.name} uses the undeclared property {name}")


def _number(text: str) -> float | None:
    try:
        return float(text)
    except ValueError:
        return None


def column_visible(rule: AccessRule | None, props: dict[str, object]) -> bool:
    """Compares one session property with the threshold: quoted values as text, others as numbers.
    A rule that doesn't apply leaves the column visible; values of different kinds are unequal."""
    if rule is None:
        return True
    if len(rule.required) > 1:
        raise AccessError(f"rule {rule.name} may use one property only")
    values = _value(rule, props)
    if not values:
        return True
    got, want = str(next(iter(values.values()))).strip(), rule.threshold.strip()
    op = rule.operator.upper()
    quoted = got.startswith("'"), want.startswith("'")
    if quoted[0] != quoted[1]:
        return op == "NOT_EQUALS"
    a, b = (got.strip("'"), want.strip("'")) if quoted[0] else (_number(got), _number(want))
    if a is None or b is None:
        return op == "NOT_EQUALS"
    tests = {
        "EQUALS": a == b, "NOT_EQUALS": a != b, "GREATER_THAN": a > b, "LESS_THAN": a < b,
        "GREATER_THAN_OR_EQUALS": a >= b, "LESS_THAN_OR_EQUALS": a <= b,
    }
    if op not in tests:
        raise AccessError(f"rule {rule.name} has an unknown operator {rule.operator}")
    return tests[op]


def check_rules(manifest: Manifest) -> None:
    for m in manifest.models.values():
        for r in m.rules:
            validate_rule(r)
