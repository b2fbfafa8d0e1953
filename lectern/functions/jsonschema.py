"""JSON Schema compiled to one Spark expression over VARIANT.

breaches() turns a schema document into an expression that walks a value once and lists what is wrong with it: where (a
JSON pointer), which keyword, what was found, and the title of the schema's innermost part that has one. Values keep their
JSON types, so a number in quotes is no number. A key that isn't there has the pointer that it would have.

Keywords: type (a name or a list), required, properties, additionalProperties (false), items, enum, const, minimum,
maximum, oneOf, $ref into the document, and the annotations title, description, definitions, $schema. A document with
another keyword is refused rather than half checked. Of a oneOf that no branch fits, the breaches of the branch are listed
whose const the value has; without such a branch the oneOf itself is named, as it is where several fit."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

BREACH = "struct<pointer: string, rule: string, detail: string, part: string>"
_NONE = f"cast(array() as array<{BREACH}>)"
_KNOWN = {"type", "required", "properties", "additionalProperties", "items", "enum", "const", "minimum", "maximum", "oneOf", "$ref", "title", "description", "definitions", "$schema"}
#: Nesting beyond which a document is taken to refer to itself.
DEEPEST = 40


def _text(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _step(key: str) -> str:
    return _text("/" + key.replace("~", "~0").replace("/", "~1"))


def _literal(x: object) -> str:
    return f"to_json(parse_json({_text(json.dumps(x))}))"


def _child(value: str, key: str) -> str:
    if any(c in key for c in "\"'\\]"):
        raise ValueError(f"a property named {key!r} can't be asked for")
    return f"variant_get({value}, '$[\"{key}\"]', 'variant')"


#: What a type's name asks of the type (s) and the value (v) of a node.
_TYPES = {
    "null": "{x}.s = 'VOID'",
    "boolean": "{x}.s = 'BOOLEAN'",
    "string": "{x}.s = 'STRING'",
    "array": "startswith({x}.s, 'ARRAY')",
    "object": "startswith({x}.s, 'OBJECT')",
    "number": "{x}.s rlike '^(BIGINT|DECIMAL|DOUBLE|FLOAT)'",
    "integer": "({x}.s = 'BIGINT' or {x}.s rlike '^(DECIMAL|DOUBLE|FLOAT)' and try_variant_get({x}.v, '$', 'double') = floor(try_variant_get({x}.v, '$', 'double')))",
}
_SAID = "case when {x}.s = 'VOID' then 'null' when {x}.s rlike '^(BIGINT|DECIMAL|DOUBLE|FLOAT)' then 'number' else lower(regexp_extract({x}.s, '^[A-Z]+', 0)) end"


class _Compiler:
    def __init__(self, document: dict):
        self.document, self.names = document, 0

    def name(self, kind: str) -> str:
        self.names += 1
        return f"{kind}{self.names}"

    def resolved(self, schema: dict, depth: int) -> dict:
        if depth > DEEPEST:
            raise ValueError("the schema refers to itself")
        if unknown := set(schema) - _KNOWN:
            raise ValueError(f"keywords that aren't checked: {', '.join(sorted(unknown))}")
        if "$ref" not in schema:
            return schema
        at: dict = self.document
        for key in schema["$ref"].removeprefix("#/").split("/"):
            at = at[key.replace("~1", "/").replace("~0", "~")]
        return self.resolved(at, depth + 1)

    def node(self, value: str, pointer: str, schema: dict, part: str, depth: int = 0) -> str:
        """SQL of the breaches of value, an expression; none where it is null, which is no JSON null."""
        schema = self.resolved(schema, depth)
        part, x = schema.get("title", part), self.name("x")

        def breach(rule: str, detail: str, at: str = pointer) -> str:
            return f"named_struct('pointer', {at}, 'rule', {_text(rule)}, 'detail', {detail}, 'part', {_text(part)})"

        def when(wrong: str, rule: str, detail: str) -> str:
            return f"if({wrong}, array({breach(rule, detail)}), {_NONE})"

        found = []
        if "type" in schema:
            kinds = [schema["type"]] if isinstance(schema["type"], str) else schema["type"]
            right = " or ".join(_TYPES[k].format(x=x) for k in kinds)
            found.append(when(f"not ({right})", "type", _SAID.format(x=x)))
        if "enum" in schema:
            found.append(when(f"not to_json({x}.v) in ({', '.join(map(_literal, schema['enum']))})", "enum", f"to_json({x}.v)"))
        if "const" in schema:
            found.append(when(f"to_json({x}.v) <> {_literal(schema['const'])}", "const", f"to_json({x}.v)"))
        for rule, wrong in (("minimum", "<"), ("maximum", ">")):
            if rule in schema:
                number = f"if({_TYPES['number'].format(x=x)}, try_variant_get({x}.v, '$', 'double'), null)"
                found.append(when(f"coalesce({number} {wrong} {float(schema[rule])!r}D, false)", rule, f"to_json({x}.v)"))
        inner = [f"if({_child(f'{x}.v', k)} is null, array({breach('required', _text('missing'), f'concat({pointer}, {_step(k)})')}), {_NONE})" for k in schema.get("required", ())]
        inner += [self.node(_child(f"{x}.v", k), f"concat({pointer}, {_step(k)})", s, part, depth + 1) for k, s in schema.get("properties", {}).items()]
        if schema.get("additionalProperties") is False:
            known, k = ", ".join(map(_text, schema.get("properties", {}))) or "''", self.name("k")
            keys = f"filter(map_keys(try_variant_get({x}.v, '$', 'map<string,variant>')), {k} -> not {k} in ({known}))"
            at = f"concat({pointer}, '/', replace(replace({k}, '~', '~0'), '/', '~1'))"
            inner.append(f"transform({keys}, {k} -> {breach('additionalProperties', k, at)})")
        if inner:
            found.append(f"if({_TYPES['object'].format(x=x)}, concat({', '.join(inner)}), {_NONE})")
        if "items" in schema:
            e, i = self.name("e"), self.name("i")
            each = self.node(e, f"concat({pointer}, '/', {i})", schema["items"], part, depth + 1)
            found.append(f"if({_TYPES['array'].format(x=x)}, flatten(transform(try_variant_get({x}.v, '$', 'array<variant>'), ({e}, {i}) -> {each})), {_NONE})")
        if "oneOf" in schema:
            found.append(self.one_of(x, pointer, [self.resolved(s, depth + 1) for s in schema["oneOf"]], part, breach, depth))
        every = f"concat({', '.join(found)})" if found else _NONE
        return f"flatten(transform(filter(array(named_struct('v', {value}, 's', schema_of_variant({value}))), {x} -> {x}.v is not null), {x} -> {every}))"

    def one_of(self, x: str, pointer: str, branches: list[dict], part: str, breach, depth: int) -> str:
        b, n = self.name("b"), self.name("n")
        tried = f"array({', '.join(self.node(f'{x}.v', pointer, s, part, depth + 1) for s in branches)})"
        tells = [k for k in branches[0].get("properties", {}) if all("const" in s.get("properties", {}).get(k, {}) for s in branches)]
        chosen = f"array({breach('oneOf', _text('no branch fits'))})"
        if tells:
            cases = " ".join(f"when {_literal(s['properties'][tells[0]]['const'])} then {b}.tried[{k}]" for k, s in enumerate(branches))
            chosen = f"case to_json({_child(f'{x}.v', tells[0])}) {cases} else {chosen} end"
        several = breach("oneOf", f"concat({b}.fit, ' branches fit')")
        t = self.name("t")
        bound = f"transform(array({tried}), {t} -> named_struct('tried', {t}, 'fit', size(filter({t}, {n} -> size({n}) = 0))))"
        return f"flatten(transform({bound}, {b} -> case when {b}.fit = 1 then {_NONE} when {b}.fit = 0 then {chosen} else array({several}) end))"


def breaches_sql(value: str, document: dict, start: dict | None = None) -> str:
    return _Compiler(document).node(value, "''", start or document, "")


def breaches(value: str, document: dict, start: dict | None = None) -> Column:
    """array<BREACH> of value (SQL for a VARIANT) under the document, or its part start. A null has none."""
    return F.expr(breaches_sql(value, document, start))


def of_type(kind: T.DataType, nullable: bool = False) -> dict:
    """The schema that JSON of a Spark type has: every field there, no others."""
    names = {T.StringType: "string", T.BooleanType: "boolean", T.IntegerType: "integer", T.LongType: "integer", T.DoubleType: "number"}
    if isinstance(kind, T.StructType):
        out = {"type": "object", "properties": {f.name: of_type(f.dataType, f.nullable) for f in kind}, "required": kind.names, "additionalProperties": False}
    elif isinstance(kind, T.ArrayType):
        out = {"type": "array", "items": of_type(kind.elementType, kind.containsNull)}
    else:
        out = {"type": names[type(kind)]}
    return out | ({"type": [out["type"], "null"]} if nullable else {})
