"""Declared extraction schemas: tags, keys, Spark types, JSON Schema."""

from __future__ import annotations

import dataclasses
import datetime
import json
import re
import types
import typing
from dataclasses import dataclass, field

from pyspark.sql import types as T

FORMATS = ("date", "datetime", "email", "phone", "currency", "iban", "swift", "uuid")
RULES = ("required", "min", "max", "format", "enum")
INT_TYPES = {8: T.ByteType(), 16: T.ShortType(), 32: T.IntegerType(), 64: T.LongType()}
MAX_DEPTH = 64


class SchemaError(ValueError):
    """A declaration that cannot be extracted; raised before any action."""


@dataclass(frozen=True)
class Rule:
    name: str
    arg: str = ""


@dataclass(frozen=True)
class Field:
    """kind: string, int, float, bool, time, object or array. key: dotted path, [] for elements."""

    name: str
    key: str
    kind: str
    description: str = ""
    rules: tuple[Rule, ...] = ()
    fields: tuple[Field, ...] = ()
    elem: Field | None = None
    optional: bool = False
    bits: int = 64
    unsigned: bool = False

    @property
    def required(self) -> bool:
        return any(r.name == "required" for r in self.rules)

    @property
    def format(self) -> str:
        return next((r.arg for r in self.rules if r.name == "format"), "")

    def leaves(self) -> list[Field]:
        if self.kind == "object":
            return [x for f in self.fields for x in f.leaves()]
        return self.elem.leaves() if self.kind == "array" else [self]


def parse_tag(tag: str) -> tuple[str, tuple[Rule, ...]]:
    r"""`description,rule,rule=value`; \, and \\ are literal. An unknown rule and a second format are errors."""
    parts = [re.sub(r"\\([\\,])", r"\1", p).strip() for p in re.findall(r"(?:[^,\\]|\\.)*(?:,|$)", tag)]
    parts = [p.rstrip(",") for p in parts]
    if parts and parts[-1] == "":
        parts.pop()
    rules = []
    for part in parts[1:]:
        name, _, arg = part.partition("=")
        if name not in RULES:
            raise SchemaError(f"unknown rule {name!r}")
        if name in ("min", "max"):
            try:
                float(arg)
            except ValueError:
                raise SchemaError(f"{name} needs a number") from None
        if name == "format" and arg not in FORMATS:
            raise SchemaError(f"unknown format {arg!r}")
        if name == "enum" and not arg:
            raise SchemaError("enum needs values")
        rules.append(Rule(name, arg))
    if sum(r.name == "format" for r in rules) > 1:
        raise SchemaError("two formats")
    return (parts[0] if parts else ""), tuple(rules)


def key_of(name: str) -> str:
    """snake_case of a member's name; runs of capitals are one word."""
    return "_".join(w.lower() for w in re.findall(r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+\d*|[A-Z]+\d*|\d+", name))


def extract(tag: str, bits: int = 64, unsigned: bool = False):
    """A dataclass member with an extraction tag."""
    return field(default=None, metadata={"extract": tag, "bits": bits, "unsigned": unsigned})


def reflect(cls: type) -> Field:
    """The schema of a dataclass whose members carry extract(); members without a tag are left out."""
    return _object(cls, "", (), cls.__name__)


def _object(cls: type, key: str, path: tuple, name: str, **more) -> Field:
    if cls in path:
        raise SchemaError(f"{cls.__name__} contains itself")
    hints = typing.get_type_hints(cls)
    made = [_member(f, hints[f.name], key, (*path, cls)) for f in dataclasses.fields(cls) if "extract" in f.metadata]
    if not made:
        raise SchemaError(f"{cls.__name__} has no tagged member")
    return Field(name, key, "object", fields=tuple(made), **more)


def _member(f: dataclasses.Field, hint, parent: str, path: tuple) -> Field:
    description, rules = parse_tag(f.metadata["extract"])
    key = f"{parent}.{key_of(f.name)}" if parent else key_of(f.name)
    return _typed(f.name, key, hint, description, rules, path, f.metadata["bits"], f.metadata.get("unsigned", False))


def _typed(name: str, key: str, hint, description: str, rules: tuple, path: tuple, bits: int, unsigned: bool = False) -> Field:
    optional = False
    if isinstance(hint, types.UnionType) or typing.get_origin(hint) is typing.Union:
        some = [a for a in typing.get_args(hint) if a is not type(None)]
        if len(some) != 1:
            raise SchemaError(f"{key}: one type only")
        hint, optional = some[0], True
    common = {"description": description, "rules": rules, "optional": optional}
    form = next((r.arg for r in rules if r.name == "format"), "")
    kind = {str: "string", int: "int", float: "float", bool: "bool", datetime.datetime: "time", datetime.date: "time"}.get(hint)
    if kind == "time" and form not in ("date", "datetime"):
        raise SchemaError(f"{key}: a time needs format=date or format=datetime")
    if kind not in ("string", "time") and form:
        raise SchemaError(f"{key}: format does not fit {kind}")
    if kind:
        return Field(name, key, kind, bits=bits, unsigned=unsigned, **common)
    if typing.get_origin(hint) is list:
        (inner,) = typing.get_args(hint)
        return Field(name, key, "array", elem=_typed(name, key + "[]", inner, "", (), path, bits, unsigned), **common)
    if dataclasses.is_dataclass(hint):
        return _object(hint, key, path, name, **common)
    raise SchemaError(f"{key}: unsupported type {hint}")


def spark_type(f: Field) -> T.DataType:
    """The field's Spark type; struct members carry description, rules and key as metadata."""
    if f.kind == "object":
        return T.StructType([T.StructField(key_of(m.name), spark_type(m), True, {"description": m.description, "rules": [f"{r.name}={r.arg}" if r.arg else r.name for r in m.rules], "key": m.key}) for m in f.fields])
    if f.kind == "array":
        return T.ArrayType(spark_type(f.elem))
    if f.kind == "time":
        return T.DateType() if f.format == "date" else T.TimestampType()
    return {"string": T.StringType(), "float": T.DoubleType(), "bool": T.BooleanType()}.get(f.kind) or INT_TYPES[f.bits]


def json_schema(f: Field, depth: int = 0) -> dict:
    """Every property required and nullable, no others allowed; bounds as minimum, minLength or minItems by kind."""
    if depth > MAX_DEPTH:
        raise SchemaError("schema is nested too deeply")
    kind = {"string": "string", "int": "integer", "float": "number", "bool": "boolean", "time": "string", "object": "object", "array": "array"}[f.kind]
    node: dict = {"type": kind if depth == 0 else [kind, "null"]}
    if f.description:
        node["description"] = f.description
    if f.kind == "object":
        node["properties"] = {key_of(m.name): json_schema(m, depth + 1) for m in f.fields}
        node["required"] = [key_of(m.name) for m in f.fields]
        node["additionalProperties"] = False
    if f.kind == "array":
        node["items"] = json_schema(f.elem, depth + 1)
    bound = {"string": "{}Length", "array": "{}Items"}.get(f.kind, "{}imum")
    for r in f.rules:
        if r.name == "format" and r.arg in ("date", "datetime", "email", "uuid"):
            node["format"] = {"datetime": "date-time"}.get(r.arg, r.arg)
        if r.name == "enum":
            node["enum"] = [*r.arg.split("|"), None]
        if r.name in ("min", "max"):
            n = float(r.arg)
            node[bound.format(r.name)] = int(n) if n == int(n) else n
    return node


def json_schema_text(f: Field) -> str:
    return json.dumps(json_schema(f), ensure_ascii=False, separators=(",", ":"))
