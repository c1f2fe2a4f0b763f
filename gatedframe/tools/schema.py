"""Checking tool input against the schema that the tool declares."""

from __future__ import annotations

import math

FORBIDDEN = ("__proto__", "constructor", "prototype")
FORBIDDEN_DEPTH, MOST_PROBLEMS = 8, 8
#: The keywords that schemas may use.
KEYWORDS = {"type", "properties", "required", "additionalProperties", "items", "enum", "minItems", "maxItems", "minLength", "maxLength", "minimum", "maximum", "description", "title"}

_IS = {
    "object": lambda v: isinstance(v, dict),
    "array": lambda v: isinstance(v, list),
    "string": lambda v: isinstance(v, str),
    "boolean": lambda v: isinstance(v, bool),
    "number": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool) and not math.isnan(v),
    "integer": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool) and math.isfinite(v) and v == int(v),
}


def utf16_length(text: str) -> int:
    return len(text.encode("utf-16-le")) // 2


def problems(schema: dict, value: object, path: str = "input") -> list[dict]:
    """What is wrong with a value, each with the path to it."""
    found: list[dict] = []
    say = lambda message, at=path: found.append({"path": at, "message": message})
    if "enum" in schema and not any(type(e) is type(value) and e == value for e in schema["enum"]):
        say(f"must be one of {', '.join(map(repr, schema['enum']))}")
        return found
    kind = schema.get("type")
    if kind and not _IS[kind](value):
        say(f"must be of type {kind}")
        return found
    if isinstance(value, dict) and (kind == "object"):
        known = schema.get("properties", {})
        for name in schema.get("required", []):
            if name not in value:
                say("is required", f"{path}.{name}")
        for name, item in value.items():
            if name in known:
                found += problems(known[name], item, f"{path}.{name}")
            elif schema.get("additionalProperties") is False:
                say("is not a known property", f"{path}.{name}")
    elif isinstance(value, list) and kind == "array":
        _bounds(len(value), schema, "minItems", "maxItems", "items", say)
        for i, item in enumerate(value):
            found += problems(schema.get("items", {}), item, f"{path}[{i}]")
    elif isinstance(value, str) and kind == "string":
        _bounds(utf16_length(value), schema, "minLength", "maxLength", "characters", say)
    elif kind in ("number", "integer"):
        _bounds(value, schema, "minimum", "maximum", "", say)
    return found


def _bounds(size: float, schema: dict, least: str, most: str, unit: str, say) -> None:
    if least in schema and size < schema[least]:
        say(f"must be at least {schema[least]} {unit}".rstrip())
    if most in schema and size > schema[most]:
        say(f"must be at most {schema[most]} {unit}".rstrip())


def unsupported_keywords(schema: object, path: str = "schema") -> list[str]:
    """Paths of keywords that ``problems`` would pass over."""
    if not isinstance(schema, dict):
        return []
    found = [f"{path}.{k}" for k in schema if k not in KEYWORDS]
    for name, item in schema.get("properties", {}).items():
        found += unsupported_keywords(item, f"{path}.properties.{name}")
    return found + unsupported_keywords(schema.get("items"), f"{path}.items")


def forbidden_key(value: object, depth: int = 0) -> str | None:
    """The first key that could reach into an object's machinery, in a value of whatever shape."""
    if depth > FORBIDDEN_DEPTH:
        return None
    if isinstance(value, dict):
        for k, v in value.items():
            if k in FORBIDDEN:
                return k
            if (found := forbidden_key(v, depth + 1)) is not None:
                return found
    if isinstance(value, list):
        return next((f for f in (forbidden_key(v, depth + 1) for v in value) if f is not None), None)
    return None


def check_input(schema: dict, value: object) -> dict | None:
    """None, or the error that the caller is given."""
    if not isinstance(value, dict):
        return {"code": "invalid_input", "message": "The input must be an object."}
    if (key := forbidden_key(value)) is not None:
        return {"code": "forbidden_key", "message": f'The key "{key}" is not allowed anywhere in the input.'}
    wrong = problems(schema, value)
    return {"code": "invalid_input", "message": "The input does not fit the tool's schema.", "problems": wrong[:MOST_PROBLEMS]} if wrong else None
