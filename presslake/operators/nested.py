"""Deeply nested records as flat tables: structural-variant routing.

A bottom-up tree automaton gives every node of a JSON value a state, computed
from its label and its children's states (``states``). The root's state is the
variant of the record (list, lone entity, wrapped list, list in a payload, or
nothing). Every object below gets a state as well, and is routed by it:

* entities: ``current`` (``entity_id``), ``legacy`` (``id``) or ``unkeyed``,
  each with ``group`` added if it has member entities;
* mentions: ``located`` (with offsets) or ``plain``;
* ``other``: objects that hold keys but none of an entity or a mention give no row.

The rows of all subtypes carry the supertype's keys: source row, nested field,
item path and parent path; ``subtype`` names the typed table they belong to.
Neither parsing nor the automaton recurses, so any depth is read.

Candidate lists are native arrays of structs, whose shape Spark already knows;
they are flattened on the JVM.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presslake.operators.versions import has_conflicts

#: Keys that make an object an entity or a mention (fixed values of the data model).
ENTITY_KEYS = frozenset({"entity_id", "id", "label", "type", "confidence", "aliases", "mentions", "members"})
MENTION_KEYS = frozenset({"surface", "offsets"})
ENTITY_SUBTYPES = ("current", "current_group", "legacy", "legacy_group", "unkeyed", "unkeyed_group")
MENTION_SUBTYPES = ("located", "plain")

FLAT_SCHEMA = (
    "kind string, variant string, item_path string, parent_path string, depth bigint, item_key string, label string, type string, "
    "confidence double, aliases array<string>, n_mentions bigint, n_members bigint, mention_pos bigint, surface string, offsets array<bigint>, subtype string"
)

_FLAT_ARROW = pa.schema(
    [
        ("kind", pa.string()), ("variant", pa.string()), ("item_path", pa.string()), ("parent_path", pa.string()), ("depth", pa.int64()),
        ("item_key", pa.string()), ("label", pa.string()), ("type", pa.string()), ("confidence", pa.float64()), ("aliases", pa.list_(pa.string())),
        ("n_mentions", pa.int64()), ("n_members", pa.int64()), ("mention_pos", pa.int64()), ("surface", pa.string()), ("offsets", pa.list_(pa.int64())), ("subtype", pa.string()),
    ]
)


def _refuse(constant: str) -> None:
    raise ValueError(f"{constant} is not JSON")


_BLANKS = re.compile(r"[ \t\n\r]*")
_ATOM = re.compile(r'"(?:[^"\\\x00-\x1f]|\\.)*+"|-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null', re.S)


def parse_deep(text: str) -> object:
    """The JSON value of a text of any depth, read without recursion; ValueError if it is none."""
    at = _BLANKS.match(text).end()
    open_: list = []  # containers that are not closed yet
    keys: list = []  # the key whose value comes next, for each open object
    root: list = []

    def atom() -> object:
        nonlocal at
        m = _ATOM.match(text, at)
        if not m:
            raise ValueError("no value")
        at = _BLANKS.match(text, m.end()).end()
        return json.loads(m.group(), parse_constant=_refuse)

    def put(value: object) -> None:
        if not open_:
            root.append(value)
        elif isinstance(open_[-1], list):
            open_[-1].append(value)
        else:
            open_[-1][keys[-1]] = value

    def key() -> None:
        nonlocal at
        name = atom()
        if not isinstance(name, str) or text[at : at + 1] != ":":
            raise ValueError("no key")
        keys[-1] = name
        at = _BLANKS.match(text, at + 1).end()

    while True:
        c = text[at : at + 1]
        if c in ("[", "{") and c:
            value: list | dict = [] if c == "[" else {}
            put(value)
            open_.append(value)
            keys.append(None)
            at = _BLANKS.match(text, at + 1).end()
            if text[at : at + 1] == ("]" if c == "[" else "}"):
                pass  # closed below
            else:
                if c == "{":
                    key()
                continue
        else:
            put(atom())
        while open_:
            c = text[at : at + 1]
            if c == "," and (open_[-1] or open_[-1] == 0):
                at = _BLANKS.match(text, at + 1).end()
                if isinstance(open_[-1], dict):
                    key()
                break
            if c != ("]" if isinstance(open_[-1], list) else "}"):
                raise ValueError("not closed")
            open_.pop()
            keys.pop()
            at = _BLANKS.match(text, at + 1).end()
        else:
            if at != len(text):
                raise ValueError("more than one value")
            return root[0]


def parse(text: str | None) -> tuple[bool, object]:
    """(is valid JSON, value). Strict: no NaN or Infinity."""
    if not text:
        return False, None
    try:
        return True, json.loads(text, parse_constant=_refuse)
    except ValueError:
        return False, None
    except RecursionError:
        pass
    try:
        return True, parse_deep(text)
    except ValueError:
        return False, None


def _transition(node: object, of: dict[int, str]) -> str:
    """The state of a node, from its own label and the states of the children it names."""
    if isinstance(node, list):
        return "list"
    if not isinstance(node, dict):
        return "null" if node is None else "scalar"
    child = lambda key: of[id(node[key])] if isinstance(node.get(key), (dict, list)) else "null"
    is_entity = lambda s: s.startswith("entity")
    if child("payload") in ("wrapped", "list", "payload"):
        return "payload"
    if child("entities") == "list" or is_entity(child("entities")):
        return "wrapped"
    if ENTITY_KEYS.isdisjoint(node):
        if not MENTION_KEYS.isdisjoint(node):
            return "mention:located" if child("offsets") == "list" else "mention:plain"
        return "other" if node else "empty"
    keyed = "current" if node.get("entity_id") not in (None, "") else "legacy" if node.get("id") not in (None, "") else "unkeyed"
    members = node.get("members")
    members = [members] if isinstance(members, dict) else members if isinstance(members, list) else []
    group = any(isinstance(m, dict) and (is_entity(of[id(m)]) or of[id(m)] in ("empty", "wrapped", "payload")) for m in members)
    return f"entity:{keyed}_group" if group else f"entity:{keyed}"


def states(root: object) -> dict[int, str]:
    """The state of every list and object below and including ``root``, by identity; children before parents, without recursion."""
    of: dict[int, str] = {}
    stack = [(root, False)]
    while stack:
        node, ready = stack.pop()
        if not isinstance(node, (dict, list)):
            continue
        if ready:
            of[id(node)] = _transition(node, of)
        else:
            stack.append((node, True))
            stack.extend((child, False) for child in (node.values() if isinstance(node, dict) else node) if isinstance(child, (dict, list)))
    return of


def entities_of(node: object, of: dict[int, str] | None = None) -> tuple[str, list]:
    """(variant, list of entities) of a root value; a lone entity is a list of one."""
    if not isinstance(node, (dict, list)):
        return _transition(node, {}), []
    of = states(node) if of is None else of
    variant = of[id(node)].partition(":")[0]
    while isinstance(node, dict):
        kind = of[id(node)].partition(":")[0]
        if kind == "entity":
            return variant, [node]
        if kind not in ("wrapped", "payload"):
            return variant, []
        node = node["entities" if kind == "wrapped" else "payload"]
    return variant, node


def _text(value: object) -> str | None:
    """A JSON value as a string column holds it; unpaired surrogates become question marks."""
    if value is None:
        return None
    if not isinstance(value, str):
        try:
            value = json.dumps(value)
        except RecursionError:  # a value nested beyond any use as a name
            value = ""
    return value.encode("utf-8", "replace").decode("utf-8")


def _number(value: object) -> float | None:
    return float(value) if isinstance(value, (int, float)) and not isinstance(value, bool) and abs(value) < 1e308 else None


def _objects(value: object) -> list[tuple[int, dict]]:
    """The objects of a list, or a lone one, with their places."""
    many = [value] if isinstance(value, dict) else value if isinstance(value, list) else []
    return [(i, x) for i, x in enumerate(many) if isinstance(x, dict)]


def rows_of(text: str | None) -> Iterator[tuple]:
    """Flat rows of one field, in the order of FLAT_SCHEMA; depth first without recursion.

    An object in a list of entities is one unless it holds only foreign keys;
    likewise for mentions. An empty object is an entity without any key.
    """
    valid, root = parse(text)
    if not valid:
        return
    of = states(root)
    variant, top = entities_of(root, of)
    foreign = lambda x: of[id(x)] == "other"
    stack = [(str(i), None, 0, e) for i, e in reversed(_objects(top)) if not foreign(e)]
    while stack:
        path, parent, depth, entity = stack.pop()
        kind, _, subtype = of[id(entity)].partition(":")
        subtype = subtype if kind == "entity" else "unkeyed"
        key = entity.get("entity_id")
        key = entity.get("id") if key is None or key == "" else key
        key = _text(key) or ""
        mentions = [(i, m) for i, m in _objects(entity.get("mentions")) if not foreign(m)]
        aliases = entity.get("aliases")
        aliases = [_text(a) for a in aliases] if isinstance(aliases, list) else None
        inner = [(f"{path}.{i}", path, depth + 1, m) for i, m in _objects(entity.get("members")) if not foreign(m)]
        label, type_, confidence = _text(entity.get("label")), _text(entity.get("type")), _number(entity.get("confidence"))
        yield ("entity", variant, path, parent, depth, key, label, type_, confidence, aliases, len(mentions), len(inner), -1, "", None, subtype)
        for i, m in mentions:
            located = of[id(m)] == "mention:located"
            offsets = [o for o in m["offsets"] if isinstance(o, int) and not isinstance(o, bool) and abs(o) < 2**63] if located else None
            yield ("mention", variant, path, parent, depth, key, None, None, None, None, len(mentions), len(inner), i, _text(m.get("surface")) or "", offsets, "located" if located else "plain")
        stack.extend(reversed(inner))


def flatten_entities(df: DataFrame, fields: list[str], keys: list[str]) -> DataFrame:
    """Entities and mentions of JSON fields: keys, nested_field and the columns of FLAT_SCHEMA.

    One row of kind ``entity`` per entity at any level and one of kind
    ``mention`` per mention. NULL, blank, cut-off or otherwise invalid JSON and
    values without entities give no row. Missing, NULL or mistyped keys become
    NULL or '' (item_key, surface). Repeated source rows count once; if one
    source row comes with several contents their rows are united. Other columns
    are ignored. Fields of any length are read whole.
    """
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("nested_field"), F.col(f).alias("_text")) for f in fields]))
    delivered = df.select(*keys, each.alias("_f")).select(*keys, "_f.nested_field", "_f._text").filter("_text IS NOT NULL")
    long = delivered.distinct()
    n = len(keys) + 1

    def flatten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(n)
            for at in range(0, batch.num_rows, 2000):  # bounds what one output batch holds
                index, rows = [], []
                for i in range(at, min(at + 2000, batch.num_rows)):
                    for row in rows_of(texts[i].as_py()):
                        index.append(i)
                        rows.append(row)
                if rows:
                    take = pa.array(index, pa.int64())
                    own = [batch.column(j).take(take) for j in range(n)]
                    flat = [pa.array(c, f.type) for c, f in zip(zip(*rows), _FLAT_ARROW)]
                    yield pa.RecordBatch.from_arrays(own + flat, names=[*batch.schema.names[:n], *_FLAT_ARROW.names])

    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in long.schema.fields[:n])
    out = long.mapInArrow(flatten, f"{head}, {FLAT_SCHEMA}")
    return out.distinct() if has_conflicts(delivered, [*keys, "nested_field"], ["_text"]) else out


def flatten_candidates(df: DataFrame, field: str, keys: list[str]) -> DataFrame:
    """Candidates of an array-of-structs field: keys, item_path, item_key; one row per candidate.

    item_path is the candidate's ``position`` (its index where that is NULL) as
    a string, item_key its ``news_id`` or ''. NULL and empty arrays give no row;
    repeated source rows count once; equal candidates of one source row count
    once. Only the two nested columns are read.
    """
    lean = df.select(*keys, F.col(f"{field}.position").alias("_p"), F.col(f"{field}.news_id").alias("_k")).filter("size(_p) > 0")
    rows = lean.distinct()
    zipped = F.arrays_zip(F.col("_p"), F.col("_k"))
    out = rows.select(*keys, F.posexplode(zipped).alias("_i", "_c")).select(
        *keys, F.coalesce(F.col("_c._p"), F.col("_i")).cast("string").alias("item_path"), F.coalesce(F.col("_c._k"), F.lit("")).alias("item_key")
    )
    repeated = not lean.filter("size(array_distinct(_p)) < size(_p)").isEmpty()
    return out.distinct() if repeated or has_conflicts(lean, keys, ["_p", "_k"]) else out
