"""The control plane: checks and settings that concern a call, not a table. Plain Python on the driver."""

from __future__ import annotations

import re
from collections.abc import Mapping
from typing import Any
from xml.sax.saxutils import escape

TYPES = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "array": list, "object": dict}


def coerced(value: Any, kind: str) -> Any:
    """What a caller may have meant: digits as numbers, words as truth values, one string as a list of one."""
    if kind == "integer" and isinstance(value, str) and re.fullmatch(r"-?\d+", value.strip()):
        return int(value)
    if kind == "boolean" and isinstance(value, str) and value.lower() in ("true", "false"):
        return value.lower() == "true"
    if kind == "array" and isinstance(value, str):
        return [value]
    return value


def checked_arguments(schema: Mapping[str, Any], given: Mapping[str, Any]) -> tuple[dict[str, Any], list[str]]:
    """(arguments after coercion, errors) under a small part of JSON schema: required, additionalProperties, type, minimum, maximum, enum."""
    props, out, errors = schema.get("properties", {}), {}, []
    errors += [f"missing: {k}" for k in schema.get("required", []) if k not in given]
    for k, v in given.items():
        if k not in props:
            if schema.get("additionalProperties", True) is False:
                errors.append(f"unknown: {k}")
            else:
                out[k] = v
            continue
        rule = props[k]
        v = out[k] = coerced(v, rule.get("type", ""))
        kind = TYPES.get(rule.get("type", ""), object)
        if not isinstance(v, kind) or isinstance(v, bool) and rule.get("type") in ("integer", "number"):
            errors.append(f"not {rule['type']}: {k}")
            continue
        if "minimum" in rule and v < rule["minimum"] or "maximum" in rule and v > rule["maximum"]:
            errors.append(f"out of range: {k}")
        if "enum" in rule and v not in rule["enum"]:
            errors.append(f"not allowed: {k}")
    return out, errors


PLACEHOLDER = re.compile(r"\{\{\s*(\w+)\s*\}\}")


def rendered(template: str, declared: set[str], values: Mapping[str, Any], xml: bool = False) -> str:
    """A template with its {{names}} filled in; names that are not declared, or have no value, are an error."""
    names = set(PLACEHOLDER.findall(template))
    if names - declared:
        raise ValueError(f"undeclared: {sorted(names - declared)}")
    if names - set(values):
        raise ValueError(f"no value: {sorted(names - set(values))}")
    return PLACEHOLDER.sub(lambda m: escape(str(values[m[1]])) if xml else str(values[m[1]]), template)


def resolved(defaults: Mapping[str, Any], bounds: Mapping[str, tuple[float, float]], *layers: Mapping[str, Any]) -> tuple[dict[str, Any], list[str]]:
    """(effective settings, warnings): later layers win, numbers are held within bounds, unknown names are told and left out."""
    out, told = dict(defaults), []
    for layer in layers:
        for k, v in layer.items():
            if k not in out:
                told.append(f"unknown setting {k}")
                continue
            low, high = bounds.get(k, (float("-inf"), float("inf")))
            if k in bounds and not low <= v <= high:
                told.append(f"{k}={v} held within {low}..{high}")
                v = min(max(v, low), high)
            out[k] = v
    return out, told
