"""p3: nested JSON as flat related tables, by Merkle identities of subtrees.

Objects are canonicalised and hashed bottom-up (sorted names, child hashes, number texts as written), so equal
subtrees have equal hashes wherever they occur. ``objects`` stores every distinct object once; ``bridge`` keeps each
occurrence: which record of which file holds which object, under which name and ordinal.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.session import parallelism, staged

_TOKEN = re.compile(r'[ \t\n\r]*([{}\[\]:,]|"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*"|-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null)')


class Number(str):
    """A JSON number, as written."""


def _refuse(_: str):
    raise ValueError("not JSON")


_DECODER = json.JSONDecoder(parse_int=Number, parse_float=Number, parse_constant=_refuse)


def parse_json(text: str):
    """The value of one whole JSON text; ValueError for anything else. Depth is bounded by memory only."""
    try:
        return _DECODER.decode(text)
    except RecursionError:
        return _parse_deep(text)


def _parse_deep(text: str):
    """The same without recursion: a stack of open containers."""
    tokens, at, stack, done = [], 0, [], []
    text = text.rstrip(" \t\n\r")
    while at < len(text):
        if not (m := _TOKEN.match(text, at)):
            raise ValueError("not JSON")
        tokens.append(m[1])
        at = m.end()
    state = "value"
    for token in tokens:
        first = token[0]
        if state in ("value", "first") and first not in "]}:,":
            if first in "{[":
                stack.append([{} if first == "{" else [], None])
                state = "first" if first == "[" else "name1"
                continue
            value = json.loads(token) if first == '"' or token in ("true", "false", "null") else Number(token)
        elif state == "first" and first == "]" or state == "after" and stack and first == ("}" if isinstance(stack[-1][0], dict) else "]") or state == "name1" and first == "}":
            value = stack.pop()[0]
        elif state in ("name", "name1") and first == '"':
            stack[-1][1], state = json.loads(token), "colon"
            continue
        elif state == "colon" and first == ":":
            state = "value"
            continue
        elif state == "after" and stack and first == ",":
            state = "name" if isinstance(stack[-1][0], dict) else "value"
            continue
        else:
            raise ValueError("not JSON")
        if not stack:
            done.append(value)
        elif isinstance(stack[-1][0], dict):
            stack[-1][0][stack[-1][1]] = value
        else:
            stack[-1][0].append(value)
        state = "after"
    if len(done) != 1 or stack:
        raise ValueError("not JSON")
    return done[0]


def unfold(value):
    """JSON text inside a string, as what it says; anything else as it is."""
    if isinstance(value, str) and not isinstance(value, Number) and value.lstrip(" \t\n\r")[:1] in ("{", "["):
        try:
            return parse_json(value)
        except ValueError:
            return value
    return value


def shred(payload: str | None, entities: Sequence[str]) -> Iterator[tuple]:
    """Objects of one payload, children first:
    ``(path, parent_path, parent_field, parent_ordinal, field, ordinal, hash, body)``.

    ``entities`` are the names whose values are arrays of records (a single object counts as an array
    of one). ``path`` is the occurrence; parent is the nearest record of an entity around it (none at the root).
    ``body`` has the object's scalars, and its children by name as their hashes. Null entries are counted in
    ordinals, but are no records. Text that is not one whole JSON text gives nothing.
    """
    if payload is None:
        return
    try:
        root = parse_json(payload)
    except ValueError:
        return
    # Two visits of each container on one stack: its children are pushed first, then it is hashed.
    # Children are unfolded in place, so that a container is known by its identity.
    hashes: dict[int, str] = {}
    root = unfold(root)
    stack = [(root, "$", "", None, None, False)]
    while stack:
        value, path, field, ordinal, parent, leaving = stack.pop()
        if not isinstance(value, (dict, list)):
            continue
        is_list = isinstance(value, list)
        if not leaving:
            stack.append((value, path, field, ordinal, parent, True))
            own = (path, field, ordinal) if ordinal is not None else parent
            for name, child in enumerate(value) if is_list else list(value.items()):
                child = value[name] = unfold(child)
                if is_list:
                    member = field in entities and isinstance(child, dict)
                    stack.append((child, f"{path}[{name}]", field if member else "", name if member else None, parent, False))
                elif name in entities and isinstance(child, dict):
                    stack.append((child, f"{path}.{_text(name)}[0]", name, 0, own, False))
                else:
                    stack.append((child, f"{path}.{_text(name)}", name, None, own, False))
        elif is_list:
            text = json.dumps([_body(v, hashes) for v in value], separators=(",", ":"))
            hashes[id(value)] = _digest("[", text)
        else:
            names = sorted(value)
            text = json.dumps({_text(n): _body(value[n], hashes) for n in names}, separators=(",", ":"))
            kinds = "".join("n" if isinstance(v := value[n], Number) else "b" if isinstance(v, bool) else "s" for n in names)
            hashes[id(value)] = digest = _digest(kinds, text)
            yield path, *(parent or (None, None, None)), _text(field), ordinal, digest, text


def _text(value: str) -> str:
    """Lone surrogates have no UTF-8; they become question marks."""
    return value.encode("utf-8", "replace").decode()


def _body(value, hashes: dict[int, str]):
    if isinstance(value, (dict, list)):
        return {"#": hashes[id(value)]}
    return None if value is None else ("true" if value else "false") if isinstance(value, bool) else _text(value)


def _digest(kind: str, text: str) -> str:
    return hashlib.blake2b(f"{kind}|{text}".encode(), digest_size=16).hexdigest()


_NAMES = ["path", "parent_path", "parent_field", "parent_ordinal", "field", "ordinal", "hash", "body"]
_TYPES = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.string()]
_DDL = "key long, path string, parent_path string, parent_field string, parent_ordinal int, field string, ordinal int, hash string, body string"


def shredded(df: DataFrame, key: str, payload: str, entities: Sequence[str]) -> DataFrame:
    """One row per object of each distinct ``(key, payload)``; see :func:`shred`. Null keys are kept, other columns dropped."""
    names = tuple(entities)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[] for _ in range(9)]
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for row in shred(text, names):
                    rows[0].append(k)
                    for at, value in enumerate(row, 1):
                        rows[at].append(value)
                if len(rows[0]) >= 20_000:  # a huge payload doesn't become one huge batch
                    yield _batch(rows)
                    rows = [[] for _ in range(9)]
            yield _batch(rows)

    # partitioned by number, which also serves the distinct: parsing costs more than its bytes suggest
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(payload).alias("payload")).repartition(parallelism(df.sparkSession), "key", "payload").distinct()
    return rows.mapInArrow(run, _DDL)


def _batch(rows: list[list]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(v, t) for v, t in zip(rows, [pa.int64(), *_TYPES])], names=["key", *_NAMES])


def objects(nodes: DataFrame) -> DataFrame:
    """``(hash, body)``: every distinct object once. Equal hashes have equal bodies, so any will do."""
    return nodes.groupBy("hash").agg(F.any_value("body").alias("body"))


def bridge(nodes: DataFrame) -> DataFrame:
    """Every occurrence, without the body."""
    return nodes.drop("body")


@dataclass(frozen=True)
class Shredded:
    """Shredded payloads as two tables: ``objects(hash, body)``, each object once, and ``bridge``, a row an occurrence. ``nodes``: the staged rows both read."""

    nodes: DataFrame

    @property
    def objects(self) -> DataFrame:
        return objects(self.nodes)

    @property
    def bridge(self) -> DataFrame:
        return bridge(self.nodes)

    def records(self, parent: str, child: str) -> DataFrame:
        """``(key, parent_pos, child_pos, hash, body)``: the records of entity ``child`` within those of entity ``parent``,
        their bodies fetched from the objects (of that entity) through the bridge. The bridge side is the one with hot hashes (a record
        that occurs everywhere); the objects have one row a hash, so a skewed partition can be split."""
        own = (F.col("field") == child) & F.col("ordinal").isNotNull() & (F.col("parent_field") == parent)
        links = self.bridge.where(own).selectExpr("key", "parent_ordinal as parent_pos", "ordinal as child_pos", "hash")
        return links.join(objects(self.nodes.where(own)), "hash").select("key", "parent_pos", "child_pos", "hash", "body")

    def write(self, folder: str) -> None:
        """Both tables as ``folder/objects.parquet`` and ``folder/bridge.parquet``, objects clustered by hash."""
        from quire.sources.sinks import write_table

        write_table(self.objects, folder, "objects", cluster=["hash"])
        write_table(self.bridge, folder, "bridge", cluster=["hash"])


def stored(nodes: DataFrame) -> Shredded:
    """The tables of :func:`shredded` rows, which are made once: they are staged, columns apart."""
    return Shredded(staged(nodes))


def value_of(body: str, name: str):
    """Scalar ``name`` of a stored body as text; '' where it is missing, null or no scalar."""
    text = F.try_element_at(F.from_json(F.col(body), "map<string,string>"), F.lit(name))
    return F.when(text.isNull() | text.startswith('{"#":'), "").otherwise(text)
