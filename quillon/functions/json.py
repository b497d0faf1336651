"""JSON functions of the dialect.

Documents are text. Parsing keeps the order of keys, duplicates and the spelling of numbers, which
Spark's VARIANT doesn't, so editing and minifying run as Arrow functions over an own parser; plain
extraction by a constant path has a built-in form (``extract_text``).
"""

from __future__ import annotations

import json as _json
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from quillon.functions import semantics as S

_SPACE = re.compile(r"(?:[ \t\n\r\x0b\x0c\xa0\ufeff\u2028\u2029]|/\*.*?\*/|//[^\n\r\u2028\u2029]*)*", re.DOTALL)
_NUMBER = re.compile(r"[+-]?(?:0[xX][0-9a-fA-F]+|Infinity|inf|NaN|nan|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)")
_STRICT_NUMBER = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?\Z")
_IDENTIFIER = re.compile(r"[^\W\d]\w*|\$\w*", re.UNICODE)
_STEP = re.compile(r'\.(?:"((?:[^"\\]|\\.)*)"|([^.\[]+))|\[(\d+|#(?:-\d+)?)\]')


class Malformed(ValueError):
    """Text that isn't JSON; ``at`` is the place (from 1) of the trouble."""

    def __init__(self, at: int):
        super().__init__("malformed JSON")
        self.at = at


class Node:
    """A JSON value: kind is null, true, false, integer, real, text, array or object. Scalars keep
    their canonical text, arrays a list of nodes, objects a list of (key, node)."""

    __slots__ = ("kind", "value", "strict")

    def __init__(self, kind: str, value=None):
        self.kind, self.value = kind, value

    def dump(self) -> str:
        if self.kind == "array":
            return "[" + ",".join(n.dump() for n in self.value) + "]"
        if self.kind == "object":
            return "{" + ",".join(f"{_quoted(k)}:{n.dump()}" for k, n in self.value) + "}"
        return _quoted(self.value) if self.kind == "text" else self.value if self.kind in ("integer", "real") else self.kind

    def sql(self) -> str | None:
        """The value as SQL sees it, as text: true and false are 1 and 0, containers their JSON."""
        if self.kind in ("null", "true", "false"):
            return {"null": None, "true": "1", "false": "0"}[self.kind]
        if self.kind == "real":
            return S.format_real(float(self.value))
        return self.value if self.kind in ("text", "integer") else self.dump()


def _quoted(text: str) -> str:
    return _json.dumps(text, ensure_ascii=False)


class Parser:
    """A parser of JSON with the JSON5 extensions; ``strict`` tells afterwards whether any was used."""

    def __init__(self, text: str):
        self.text, self.at, self.strict = text, 0, True

    def parse(self) -> Node:
        self.space()
        node = self.value(0)
        self.space()
        if self.at < len(self.text):
            raise Malformed(self.at + 1)
        return node

    def space(self) -> None:
        end = _SPACE.match(self.text, self.at).end()
        if self.text[self.at : end].strip(" \t\n\r"):
            self.strict = False
        self.at = end

    def value(self, depth: int) -> Node:
        if depth > 1000:
            raise Malformed(self.at + 1)
        c = self.text[self.at : self.at + 1]
        if c == "{":
            return self.object(depth)
        if c == "[":
            return self.array(depth)
        if c in ('"', "'") and c:
            return Node("text", self.string())
        for word in ("true", "false", "null"):
            if self.text.startswith(word, self.at):
                self.at += len(word)
                return Node(word)
        if (m := _NUMBER.match(self.text, self.at)) is None:
            raise Malformed(self.at + 1)
        self.at = m.end()
        return self.number(m[0])

    def number(self, text: str) -> Node:
        if _STRICT_NUMBER.match(text):
            return Node("real" if set(text) & set(".eE") else "integer", text)
        self.strict = False
        body, sign = text.lstrip("+-"), "-" if text.startswith("-") else ""
        if body.lower() == "nan":
            return Node("null")
        if body.lower() in ("infinity", "inf"):
            return Node("real", sign + "9e999")
        if body[:2].lower() == "0x":
            return Node("integer", sign + str(int(body, 16)))
        if set(body) & set(".eE"):
            head, e, tail = re.match(r"([\d.]*)([eE]?)(.*)", body).groups()
            head = ("0" if head.startswith(".") else "") + head + ("0" if head.endswith(".") else "")
            return Node("real", sign + head + e + tail)
        if len(body) > 1 and body.startswith("0"):
            raise Malformed(self.at)
        return Node("integer", sign + body)

    def string(self) -> str:
        quote, out, start = self.text[self.at], [], self.at
        self.strict &= quote == '"'
        self.at += 1
        while True:
            if self.at >= len(self.text):
                raise Malformed(start + 1)
            c = self.text[self.at]
            self.at += 1
            if c == quote:
                joined = "".join(out)
                return joined.encode("utf-16", "surrogatepass").decode("utf-16", "replace") if any("\ud800" <= x < "\ue000" for x in joined) else joined
            if c != "\\":
                if c < " ":
                    self.strict = False
                out.append(c)
                continue
            e = self.text[self.at : self.at + 1]
            self.at += 1
            width = {"u": 4, "x": 2}.get(e)
            if width:
                digits = self.text[self.at : self.at + width]
                if not re.fullmatch(f"[0-9a-fA-F]{{{width}}}", digits):
                    raise Malformed(self.at)
                self.strict &= e == "u"
                out.append(chr(int(digits, 16)))
                self.at += width
            elif e in '"\\/bfnrt' and e:
                out.append({"b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t"}.get(e, e))
            elif e in "'v0\n\r\u2028\u2029" and e:
                self.strict = False
                out.append({"'": "'", "v": "\v", "0": "\0"}.get(e, ""))
            else:
                raise Malformed(self.at)

    def array(self, depth: int) -> Node:
        self.at += 1
        out: list[Node] = []
        while True:
            self.space()
            if self.text.startswith("]", self.at):
                self.strict &= not out
                self.at += 1
                return Node("array", out)
            out.append(self.value(depth + 1))
            self.space()
            if self.text.startswith(",", self.at):
                self.at += 1
            elif self.text.startswith("]", self.at):
                self.at += 1
                return Node("array", out)
            else:
                raise Malformed(self.at + 1)

    def object(self, depth: int) -> Node:
        self.at += 1
        out: list[tuple[str, Node]] = []
        while True:
            self.space()
            if self.text.startswith("}", self.at):
                self.strict &= not out
                self.at += 1
                return Node("object", out)
            if self.text[self.at : self.at + 1] in ('"', "'") and self.at < len(self.text):
                key = self.string()
            elif m := _IDENTIFIER.match(self.text, self.at):
                self.strict, self.at, key = False, m.end(), m[0]
            else:
                raise Malformed(self.at + 1)
            self.space()
            if not self.text.startswith(":", self.at):
                raise Malformed(self.at + 1)
            self.at += 1
            self.space()
            out.append((key, self.value(depth + 1)))
            self.space()
            if self.text.startswith(",", self.at):
                self.at += 1
            elif self.text.startswith("}", self.at):
                self.at += 1
                return Node("object", out)
            else:
                raise Malformed(self.at + 1)


def parse(text: str) -> Node:
    return Parser(text).parse()


def steps(path: str) -> list[str | tuple[str, int]]:
    """A path's steps: keys as text, elements as ("at", i) from the start or ("end", i) from the end."""
    if not path.startswith("$"):
        raise ValueError(f"JSON path error near '{path}'")
    out, at = [], 1
    while at < len(path):
        m = _STEP.match(path, at)
        if m is None:
            raise ValueError(f"JSON path error near '{path[at:]}'")
        quoted, key, index = m.groups()
        if index is None:
            out.append(quoted if quoted is not None else key)
        elif index.startswith("#"):
            out.append(("end", int(index[2:] or 0)))
        else:
            out.append(("at", int(index)))
        at = m.end()
    return out


def _index(node: Node, step: tuple[str, int]) -> int:
    return step[1] if step[0] == "at" else len(node.value) - step[1]


def find(node: Node, path: list) -> Node | None:
    """The node at a path; of duplicate keys the first."""
    for step in path:
        if isinstance(step, str):
            if node.kind != "object":
                return None
            node = next((n for k, n in node.value if k == step), None)
            if node is None:
                return None
        else:
            if node.kind != "array" or not 0 <= _index(node, step) < len(node.value):
                return None
            node = node.value[_index(node, step)]
    return node


def edit(node: Node, path: list, new: Node, insert: bool, replace: bool) -> Node:
    """The document with ``new`` at a path, if it may be inserted or replaced there; missing parents are made."""
    if not path:
        return new if replace else node
    step, rest = path[0], path[1:]
    fresh = lambda: edit(Node("array" if rest and not isinstance(rest[0], str) else "object", []), rest, new, insert, replace) if rest else new
    if isinstance(step, str) and node.kind == "object":
        for i, (k, n) in enumerate(node.value):
            if k == step:
                return Node("object", [*node.value[:i], (k, edit(n, rest, new, insert, replace)), *node.value[i + 1 :]])
        return Node("object", [*node.value, (step, fresh())]) if insert else node
    if not isinstance(step, str) and node.kind == "array":
        i = _index(node, step)
        if 0 <= i < len(node.value):
            return Node("array", [*node.value[:i], edit(node.value[i], rest, new, insert, replace), *node.value[i + 1 :]])
        return Node("array", [*node.value, fresh()]) if insert and i == len(node.value) else node
    return node


def remove(node: Node, path: list) -> Node | None:
    """The document without what is at a path."""
    if not path:
        return None
    step, rest = path[0], path[1:]
    if isinstance(step, str) and node.kind == "object":
        for i, (k, n) in enumerate(node.value):
            if k == step:
                left = remove(n, rest)
                return Node("object", [*node.value[:i], *([(k, left)] if left is not None else []), *node.value[i + 1 :]])
    elif not isinstance(step, str) and node.kind == "array" and 0 <= (i := _index(node, step)) < len(node.value):
        left = remove(node.value[i], rest)
        return Node("array", [*node.value[:i], *([left] if left is not None else []), *node.value[i + 1 :]])
    return node


def merge_patch(target: Node | None, patch: Node) -> Node:
    """RFC 7396."""
    if patch.kind != "object":
        return patch
    members = list(target.value) if target is not None and target.kind == "object" else []
    for key, new in patch.value:
        i = next((i for i, (k, _) in enumerate(members) if k == key), None)
        if new.kind == "null":
            if i is not None:
                del members[i]
        elif i is None:
            members.append((key, merge_patch(None, new)))
        else:
            members[i] = (key, merge_patch(members[i][1], new))
    return Node("object", members)


def value_node(x) -> Node:
    """An SQL value as JSON."""
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return Node("null")
    if isinstance(x, bool):
        return Node("integer", str(int(x)))
    if isinstance(x, float):
        return Node("real", S.format_real(x))
    return Node("text", x) if isinstance(x, str) else Node("integer", str(int(x)))


def _rows(kind: str, one):
    """An Arrow function of a text column: ``one`` runs on every non-NULL text."""

    @F.pandas_udf(kind)
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else one(t) for t in texts], dtype=object)

    return run


def json(x: Column) -> Column:
    """Minified JSON; an error if the text isn't JSON."""
    return _rows("string", lambda t: parse(t).dump())(x)


def json_valid(x: Column, flags: int = 1) -> Column:
    """1 if the text is JSON (bit 1: strict, bit 2: with the JSON5 extensions), else 0."""

    def one(t: str) -> int:
        p = Parser(t)
        try:
            p.parse()
        except Malformed:
            return 0
        return int(bool(flags & 2) or (bool(flags & 1) and p.strict))

    return _rows("int", one)(x)


def json_error_position(x: Column) -> Column:
    """0 if the text is JSON, else the place of the first error."""

    def one(t: str) -> int:
        try:
            parse(t)
        except Malformed as e:
            return e.at
        return 0

    return _rows("int", one)(x)


def json_type(x: Column, path: str = "$") -> Column:
    """null, true, false, integer, real, text, array or object; NULL if nothing is at the path."""
    at = steps(path)
    return _rows("string", lambda t: n.kind if (n := find(parse(t), at)) is not None else None)(x)


def json_array_length(x: Column, path: str = "$") -> Column:
    """Elements of an array, 0 for other values, NULL if nothing is at the path."""
    at = steps(path)
    return _rows("long", lambda t: None if (n := find(parse(t), at)) is None else len(n.value) if n.kind == "array" else 0)(x)


def json_extract(x: Column, *paths: str) -> Column:
    """The value at a path as SQL sees it (as text; cast as needed); the values at several as a JSON array."""
    at = [steps(p) for p in paths]

    def one(t: str) -> str | None:
        found = [find(parse(t), p) for p in at]
        if len(found) == 1:
            return found[0].sql() if found[0] is not None else None
        return Node("array", [n or Node("null") for n in found]).dump()

    return _rows("string", one)(x)


def extract_text(x: Column, path: str) -> Column:
    """The scalar at a simple path of strict JSON as text, without leaving the JVM."""
    return F.get_json_object(x, path)


def _arrow_path(key: str | int) -> str:
    if isinstance(key, int):
        return f"$[{key}]" if key >= 0 else f"$[#{key}]"
    return key if key.startswith("$") else f'$."{key}"'


def arrow(x: Column, key: str | int) -> Column:
    """x -> key: the JSON at an index, key or path."""
    at = steps(_arrow_path(key))
    return _rows("string", lambda t: n.dump() if (n := find(parse(t), at)) is not None else None)(x)


def arrow_text(x: Column, key: str | int) -> Column:
    """x ->> key: the value at an index, key or path as SQL sees it."""
    return json_extract(x, _arrow_path(key))



def _editing(insert: bool, replace: bool):
    def call(x: Column, *edits: tuple[str, Column] | tuple[str, Column, bool]) -> Column:
        plan = [(steps(e[0]), len(e) > 2 and e[2]) for e in edits]

        @F.pandas_udf("string")
        def run(columns: pd.DataFrame) -> pd.Series:
            out = []
            for text, *values in columns.itertuples(index=False):
                if text is None:
                    out.append(None)
                    continue
                node = parse(text)
                for (path, raw), v in zip(plan, values, strict=True):
                    new = parse(v) if raw and v is not None else value_node(v.item() if hasattr(v, "item") else v)
                    node = edit(node, path, new, insert, replace)
                out.append(node.dump())
            return pd.Series(out, dtype=object)

        return run(F.struct(x.alias("x"), *(e[1].alias(f"v{i}") for i, e in enumerate(edits))))

    return call


json_insert, json_replace, json_set = _editing(True, False), _editing(False, True), _editing(True, True)
json_insert.__doc__ = "Inserts values (path, value[, value is JSON]) where nothing is yet."
json_replace.__doc__ = "Replaces what is at the paths."
json_set.__doc__ = "Inserts or replaces."


def json_remove(x: Column, *paths: str) -> Column:
    """Removes what is at the paths, one after the other; NULL once the root is gone."""
    at = [steps(p) for p in paths]

    def one(t: str) -> str | None:
        node = parse(t)
        for p in at:
            node = remove(node, p) if node is not None else None
        return node.dump() if node is not None else None

    return _rows("string", one)(x)


def json_patch(x: Column, patch: Column) -> Column:
    """RFC 7396 merge patch."""

    @F.pandas_udf("string")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if s is None or t is None else merge_patch(parse(s), parse(t)).dump() for s, t in zip(a, b, strict=True)], dtype=object)

    return run(x, patch)


# Building: assembled from text in the JVM, since to_json drops NULL members.
def json_quote(x: Column, kind: str) -> Column:
    """An SQL value as JSON. kind: text, integer, real or json (embedded as it is)."""
    if kind == "text":
        shown = F.substring(F.to_json(F.struct(x.alias("v"))), F.lit(6), F.length(F.to_json(F.struct(x.alias("v")))) - 6)
    elif kind == "real":
        shown = S.real_text(x)
    else:
        shown = x.cast("string")
    return F.when(x.isNull(), F.lit("null")).otherwise(shown)


def json_array(*items: tuple[Column, str]) -> Column:
    """json_array of (value, kind) pairs; NULLs stay as null."""
    return F.concat(F.lit("["), F.concat_ws(",", *(json_quote(c, k) for c, k in items)), F.lit("]"))


def json_object(*members: tuple[str, Column, str]) -> Column:
    """json_object of (key, value, kind); duplicates stay."""
    return F.concat(F.lit("{"), F.concat_ws(",", *(F.concat(F.lit(_quoted(k) + ":"), json_quote(c, kind)) for k, c, kind in members)), F.lit("}"))


def json_group_array(x: Column, kind: str, *order: Column) -> Column:
    """Aggregate: a JSON array of the group's values, NULLs kept, in the order of ``order``. The list
    of a group is held in one row, as its result is."""
    value = json_quote(x, kind)
    if not order:
        return F.concat(F.lit("["), F.array_join(F.collect_list(value), ","), F.lit("]"))
    keys = [o.alias(f"k{i}") for i, o in enumerate(order)]
    ordered = F.array_sort(F.collect_list(F.struct(*keys, value.alias("v"))))
    return F.concat(F.lit("["), F.array_join(F.transform(ordered, lambda e: e["v"]), ","), F.lit("]"))


def json_group_object(key: Column, x: Column, kind: str, *order: Column) -> Column:
    """Aggregate: a JSON object of the group's members, duplicates kept."""
    member = F.concat(json_quote(key, "text"), F.lit(":"), json_quote(x, kind))
    keys = [o.alias(f"k{i}") for i, o in enumerate(order)]
    ordered = F.array_sort(F.collect_list(F.struct(*keys, member.alias("v"))))
    return F.concat(F.lit("{"), F.array_join(F.transform(ordered, lambda e: e["v"]), ","), F.lit("}"))


# Table functions.
_EACH = StructType([StructField(n, IntegerType() if n in ("id", "parent") else StringType()) for n in ("key", "value", "type", "atom", "id", "parent", "fullkey", "path")])


def _key_path(path: str, key: str | int) -> str:
    if isinstance(key, int):
        return f"{path}[{key}]"
    return f"{path}.{key}" if re.fullmatch(r"[A-Za-z][A-Za-z0-9]*", key) else f"{path}.{_quoted(key)}"


def _members(node: Node) -> list[tuple[str | int, Node]]:
    return list(node.value) if node.kind == "object" else list(enumerate(node.value)) if node.kind == "array" else []


def walk(node: Node, path: str, deep: bool, key: str | int | None = None) -> Iterator[tuple]:
    """Rows of json_each and json_tree; ids count nodes in document order."""

    def row(key, n: Node, number: int, parent: int | None, full: str, at: str) -> tuple:
        atom = n.sql() if n.kind not in ("array", "object") else None
        return (None if key is None else str(key), n.sql(), n.kind, atom, number, parent, full, at)

    def size(n: Node) -> int:
        return 1 + sum(size(c) + (n.kind == "object") for _, c in _members(n))

    def down(n: Node, number: int, full: str) -> Iterator[tuple]:
        at = number + 1
        for k, c in _members(n):
            at += n.kind == "object"
            yield row(k, c, at, number, _key_path(full, k), full)
            yield from down(c, at, _key_path(full, k))
            at += size(c)

    if deep or node.kind not in ("array", "object"):
        parent = path[: path.rindex(_key_path("", key))] if key is not None else path
        yield row(key, node, 0, None, path, parent)
    if deep:
        yield from down(node, 0, path)
    else:
        at = 1
        for k, c in _members(node):
            at += node.kind == "object"
            yield row(k, c, at, None, _key_path(path, k), path)
            at += size(c)


@udtf(returnType=_EACH)
class JsonEach:
    """json_each(json, path): a row for each member of the value at the path."""

    def eval(self, text: str, path: str):
        if text is not None and path is not None:
            at = steps(path)
            node = find(parse(text), at)
            if node is not None:
                key = (at[-1] if isinstance(at[-1], str) else at[-1][1]) if at else None
                yield from walk(node, path, False, key)


@udtf(returnType=_EACH)
class JsonTree:
    """json_tree(json, path): a row for the value at the path and everything below it."""

    def eval(self, text: str, path: str):
        if text is not None and path is not None:
            at = steps(path)
            node = find(parse(text), at)
            if node is not None:
                key = (at[-1] if isinstance(at[-1], str) else at[-1][1]) if at else None
                yield from walk(node, path, True, key)


def register(spark) -> None:
    """Makes json_each and json_tree known to SQL, for use in LATERAL joins."""
    spark.udtf.register("json_each", JsonEach)
    spark.udtf.register("json_tree", JsonTree)
