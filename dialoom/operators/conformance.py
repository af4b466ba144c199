"""JSON Schema compiled to SQL over VARIANT: one violation a path.

A schema becomes one expression from a document to its list of violations, so checking a corpus is
a map over it, without exchange or Python.  Each value is bound once, by a lambda; fields are a
map, elements an array, and both are walked by higher-order functions.  The expression is put
together as text and parsed once: built call by call it would take longer than most checks.

Elements of arrays are first held against a plain condition that is true of sound values only
(``Contract.sound``); those it doesn't clear, sound or not, are walked, so walks are few where faults are.

A definition that can contain itself is an expression of its own: where a value refers to it, the
value is put off, and a further round over the rows put off checks those, down to any depth. The condition
follows such references ``DEEP`` times.
A keyword that the compiler doesn't know is an error when it compiles.
"""

from __future__ import annotations

import json
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialoom.sources.stored import stored

NOTES = {"$schema", "$id", "title", "description", "$defs"}
KNOWN = {"$ref", "type", "enum", "const", "required", "properties", "additionalProperties", "items", "uniqueItems", "minimum", "maximum", "minLength", "pattern"}
#: kind of value by the name of its VARIANT type
KINDS = {"OBJECT": "object", "ARRAY": "array", "STRING": "string", "BOOLEAN": "boolean", "VOID": "null", "BIGINT": "integer"}
#: a violation has a rule; a value put off has the definition that it refers to
FOUND = "array<struct<path:string,rule:string,def:string,v:variant>>"
NONE = f"cast(array() as {FOUND})"
#: types of VARIANT values that are surely of a kind; other values of the kind are walked
SURE = {"string": "= 'STRING'", "boolean": "= 'BOOLEAN'", "null": "= 'VOID'", "integer": "= 'BIGINT'", "number": r"rlike '^(BIGINT|DOUBLE|DECIMAL.*)$'"}
DEEP = 2


def text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def kind_of(v: str) -> str:
    """The kind of a value; integral numbers of any type are integers."""
    known = " ".join(f"when '{k}' then '{x}'" for k, x in KINDS.items())
    return f"case regexp_extract(schema_of_variant({v}), '^[A-Z]+', 0) {known} else if(try_variant_get({v}, '$', 'double') % 1 = 0, 'integer', 'number') end"


def violation(path: str, rule: str) -> str:
    return f"named_struct('path', {path}, 'rule', {text(rule)}, 'def', cast(null as string), 'v', cast(null as variant))"


class Contract:
    """A compiled schema: SQL for the document and for each definition that can contain itself."""

    def __init__(self, schema: dict):
        self.schema, self.names = schema, count()
        self.apart = sorted({r for r in self.refs(schema) if r in self.reached(r)})
        self.parts = {"": self.part(schema)} | {r: self.part(self.referred(r)) for r in self.apart}

    def referred(self, ref: str) -> dict:
        at = self.schema
        for name in ref.removeprefix("#/").split("/"):
            at = at[name]
        return at

    def refs(self, node) -> set[str]:
        """References that a part of the schema names itself."""
        if isinstance(node, dict):
            return {node["$ref"]} if "$ref" in node else set().union(*[self.refs(v) for v in node.values()])
        return set().union(*[self.refs(x) for x in node]) if isinstance(node, list) else set()

    def reached(self, ref: str) -> set[str]:
        out: set[str] = set()
        waiting = [ref]
        while waiting:
            new = self.refs(self.referred(waiting.pop())) - out
            out |= new
            waiting += new
        return out

    def part(self, node: dict) -> str:
        return self.checks(node, "v", "path")

    def checks(self, node: dict | bool, v: str, path: str) -> str:
        """The violations of ``v``; none where there is no value."""
        if isinstance(node, bool):
            return NONE if node else f"if({v} is null, {NONE}, array({violation(path, 'not allowed')}))"
        if unknown := set(node) - KNOWN - NOTES:
            raise ValueError(f"keywords that are not compiled: {', '.join(sorted(unknown))}")
        if ref := node.get("$ref"):
            if ref in self.apart:
                return f"if({v} is null, {NONE}, array(named_struct('path', {path}, 'rule', cast(null as string), 'def', {text(ref)}, 'v', {v})))"
            return self.checks(self.referred(ref), v, path)
        fields, elements = {"required", "properties", "additionalProperties"} & set(node), {"items", "uniqueItems"} & set(node)
        x = f"x{next(self.names)}"
        m = f"try_variant_get({v}, '$', 'map<string,variant>')" if fields else "cast(null as map<string,variant>)"
        a = f"try_variant_get({v}, '$', 'array<variant>')" if elements else "cast(null as array<variant>)"
        kind = f"case when {x}.m is not null then 'object' when {x}.a is not null then 'array' else {kind_of(f'{x}.v')} end"
        wrong, lists = self.rules(node, x)
        if fields:
            more, others = self.fields(node, x)
            wrong, lists = wrong + more, lists + others
        if elements:
            more, others = self.elements(node, x)
            wrong, lists = wrong + more, lists + others
        if wrong:
            lists = [f"array_compact(array({', '.join(f'if({condition}, {violation(at, rule)}, null)' for condition, at, rule in wrong)}))", *lists]
        if not lists:
            return NONE
        seen = f"transform(transform(filter(array({v}), {x} -> {x} is not null), {x} -> named_struct('v', {x}, 'p', {path}, 'm', {m.replace(f'({v},', f'({x},')}, 'a', {a.replace(f'({v},', f'({x},')}))"
        seen += f", {x} -> named_struct('v', {x}.v, 'p', {x}.p, 'm', {x}.m, 'a', {x}.a, 'k', {kind}))"
        return f"flatten(transform({seen}, {x} -> concat({', '.join(lists)})))"

    def rules(self, node: dict, x: str) -> tuple[list, list]:
        """Rules on single values; each applies to values of its kind only."""
        value, number, is_number = f"try_variant_get({x}.v, '$', 'string')", f"try_variant_get({x}.v, '$', 'double')", f"{x}.k in ('integer', 'number')"
        same = lambda y: f"coalesce({x}.k = 'string' and {value} = {text(y)}, false)" if isinstance(y, str) else f"to_json({x}.v) = {text(json.dumps(y))}"
        among = lambda ys: "not (" + " or ".join([same(y) for y in ys] or ["false"]) + ")"
        types = [node["type"]] if isinstance(node.get("type"), str) else node.get("type", [])
        allowed = ", ".join(text(t) for t in [*types, *(["integer"] if "number" in types else [])])
        made = {
            "type": lambda y: (f"{x}.k not in ({allowed})", "type " + "|".join(types)),
            "enum": lambda y: (among(y), "enum"),
            "const": lambda y: (among([y]), "const"),
            "minimum": lambda y: (f"{is_number} and {number} < {y}", f"minimum {y}"),
            "maximum": lambda y: (f"{is_number} and {number} > {y}", f"maximum {y}"),
            "minLength": lambda y: (f"{x}.k = 'string' and length({value}) < {y}", f"minLength {y}"),
            "pattern": lambda y: (f"{x}.k = 'string' and not {value} rlike {text(y)}", "pattern"),
        }
        told = [made[k](node[k]) for k in made if k in node]
        return [(condition, f"{x}.p", rule) for condition, rule in told], []

    def fields(self, node: dict, x: str) -> tuple[list, list]:
        at = lambda name: f"concat({x}.p, '.', {name})"
        named, more = node.get("properties", {}), node.get("additionalProperties", True)
        wrong = [(f"not map_contains_key({x}.m, {text(n)})", at(text(n)), "required") for n in node.get("required", [])]
        lists = [self.checks(child, f"{x}.m[{text(n)}]", at(text(n))) for n, child in named.items()]
        if more is not True:
            e = f"e{next(self.names)}"
            entries = f"filter(map_entries({x}.m), {e} -> {e}.key not in ({', '.join(map(text, named))}))" if named else f"map_entries({x}.m)"
            lists.append(f"coalesce(flatten(transform({entries}, {e} -> {self.checks(more, f'{e}.value', at(f'{e}.key'))})), {NONE})")
        return wrong, [c for c in lists if c != NONE]

    def elements(self, node: dict, x: str) -> tuple[list, list]:
        y = f"y{next(self.names)}"
        wrong = [(f"size(array_distinct(transform({x}.a, {y} -> to_json({y})))) < size({x}.a)", f"{x}.p", "uniqueItems")] if node.get("uniqueItems") else []
        items = node.get("items", True)
        sound, each = self.sound(items, f"{y}.v", DEEP), f"transform({x}.a, ({y}, i{y}) -> named_struct('v', {y}, 'i', i{y}))"
        child = self.checks(items, f"{y}.v", f"concat({x}.p, '[', {y}.i, ']')")
        left = each if sound is None else f"filter({each}, {y} -> not coalesce({sound}, false))"
        return wrong, [] if child == NONE else [f"coalesce(flatten(transform({left}, {y} -> {child})), {NONE})"]

    def sound(self, node: dict | bool, v: str, deep: int) -> str | None:
        """A condition that is true only where ``v`` is a value without violations; it may be false or null
        of others that have none. None where there is no such condition, or it is not worth stating."""
        if isinstance(node, bool):
            return "true" if node else None
        if ref := node.get("$ref"):
            if ref in self.apart and not deep:
                return "false"
            return self.sound(self.referred(ref), v, deep - (ref in self.apart))
        rules = set(node) - NOTES
        if not rules:
            return "true"
        values = node.get("enum", [node["const"]] if "const" in node else None)
        types = [node["type"]] if isinstance(node.get("type"), str) else node.get("type", ["string"] if values else [])
        if not types or (values is not None and ("enum" in node and "const" in node or not all(isinstance(y, str) for y in values))):
            return None
        told = [self.sound_of(kind, node, values, v, deep) for kind in types]
        return None if None in told else f"({' or '.join(told)})"

    def sound_of(self, kind: str, node: dict, values: list[str] | None, v: str, deep: int) -> str | None:
        """``sound`` for values of one kind."""
        if values is not None and kind != "string":
            return None
        if kind == "object":
            return self.sound_fields(node, v, deep)
        if kind == "array":
            a, y = f"a{next(self.names)}", f"y{next(self.names)}"
            each = self.sound(node.get("items", True), y, deep)
            alone = f" and size(array_distinct(transform({a}, {y} -> to_json({y})))) = size({a})" if node.get("uniqueItems") else ""
            return each and f"exists(array(try_variant_get({v}, '$', 'array<variant>')), {a} -> {a} is not null and forall({a}, {y} -> {each}){alone})"
        number, value = f"try_variant_get({v}, '$', 'double')", f"try_variant_get({v}, '$', 'string')"
        more = []
        if kind in ("integer", "number"):
            more = [f"{number} {sign} {node[k]}" for k, sign in (("minimum", ">="), ("maximum", "<=")) if k in node]
        if kind == "string":
            more = [f"array_contains(array({', '.join(map(text, values))}), {value})"] if values else []
            more += [f"length({value}) >= {node['minLength']}"] if "minLength" in node else []
            more += [f"{value} rlike {text(node['pattern'])}"] if "pattern" in node else []
        return "(" + " and ".join([f"schema_of_variant({v}) {SURE[kind]}", *more]) + ")"

    def sound_fields(self, node: dict, v: str, deep: int) -> str | None:
        named, rest = node.get("properties", {}), node.get("additionalProperties", True)
        x, y = f"s{next(self.names)}", f"y{next(self.names)}"
        whole = f"try_variant_get({v}, '$', 'map<string,variant>')"
        if not named:
            each = self.sound(rest, y, deep)
            return None if node.get("required") else each and f"exists(array({whole}), {x} -> {x} is not null and forall(map_values({x}), {y} -> {each}))"
        if isinstance(rest, dict):
            return None
        kind, told = self.shape(node | {"additionalProperties": True}, x, deep)
        if rest is False:
            told = [*told, f"size({whole}) = " + " + ".join(f"if({x}.`{n}` is null, 0, 1)" for n in named)]
        return None if kind == "variant" or None in told else f"exists(array(try_variant_get({v}, '$', {text(kind)})), {x} -> {' and '.join(told)})"

    def shape(self, node: dict | bool, at: str, deep: int) -> tuple[str, list[str | None]]:
        """The type as which a value is taken, with its required records and arrays in one go, and what
        makes ``at``, which is of that type, sound. What is of another kind is null then, so not cleared."""
        while isinstance(node, dict) and "$ref" in node and (node["$ref"] not in self.apart or deep):
            deep -= node["$ref"] in self.apart
            node = self.referred(node["$ref"])
        kind = node.get("type") if isinstance(node, dict) and not {"enum", "const", "$ref"} & set(node) else None
        if kind == "array" and not node.get("uniqueItems"):
            y = f"y{next(self.names)}"
            of, each = self.shape(node.get("items", True), y, deep)
            return f"array<{of}>", [f"{at} is not null", None if None in each else f"forall({at}, {y} -> {' and '.join(each)})"]
        named, required = (node.get("properties", {}), node.get("required", [])) if kind == "object" else ({}, [])
        strange = set(required) - set(named) or len({n.lower() for n in named}) < len(named) or any("`" in n for n in named)
        if not named or strange or node.get("additionalProperties", True) is not True:
            return "variant", [self.sound(node, at, deep)] if not strange else [None]
        kinds, told = [], [f"{at} is not null"]
        for n, child in named.items():
            own = f"{at}.`{n}`"
            of, each = self.shape(child, own, deep) if n in required else ("variant", [self.sound(child, own, deep)])
            kinds.append(f"`{n}`:{of}")
            sound = None if None in each else " and ".join(each)
            told += [f"{own} is not null"] if of == "variant" and n in required else []
            told += [sound if n in required else sound and f"({own} is null or {sound})"]
        return f"struct<{','.join(kinds)}>", told


def violations(documents: DataFrame, schema: dict, column: str = "document") -> DataFrame:
    """A row per violation: the other columns of ``documents``, path, rule.  ``column`` is a struct, a
    VARIANT or JSON text; a document that is null or no JSON is one violation."""
    contract, kind = Contract(schema), documents.schema[column].dataType.typeName()
    given = F.col(column)
    document = given if kind == "variant" else F.try_parse_json(given if kind == "string" else F.to_json(given, {"ignoreNullFields": "false"}))
    others = F.struct(*[F.col(f"`{c}`") for c in documents.columns if c != column]).alias("of")
    rows = documents.select(others, document.alias("v"), F.lit("$").alias("path"), F.lit("").alias("def"))
    lost = f"if(v is null, array({violation('path', 'not JSON')}), {contract.parts['']})"
    out = None
    while rows is not None:
        parts = {"": lost} if out is None else {r: contract.parts[r] for r in contract.apart}
        cases = " ".join(f"when {text(d)} then {sql}" for d, sql in parts.items())
        found = rows.select("of", F.explode(F.expr(f"case def {cases} end")).alias("x")).select("of", "x.*")
        if contract.apart:
            found = stored(found, "violations")
        wrong = found.filter("rule is not null").select("of.*", "path", "rule")
        out = wrong if out is None else out.unionByName(wrong)
        rows = found.filter("def is not null") if contract.apart else None
        rows = None if rows is None or rows.isEmpty() else rows
    return out
