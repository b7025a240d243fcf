"""Nested JSON records to flat node tables by interval labels.

Every record is one tree. A depth-first walk gives each node its pre-order and post-order number; a node lies in
another exactly if its interval (pre, post) is inside the other's. Parents and levels are read from those intervals, and
the tables per node type are linked by them.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator, Mapping
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.functions.jsonx import BAD, clean, decode

#: The keys whose elements are nodes.
COLLECTIONS = ("images", "variants", "tables", "rows", "cells", "lists", "items", "crumbs", "hops")

NODE_COLUMNS = ("kind", "node_path", "parent_path", "pos", "level", "pre", "post", "parent_pre", "fields")


def label(trees: Iterable[tuple[Any, str | None]], collections: frozenset[str], fields: bool) -> list[list]:
    """Nodes of one record in pre-order, as lists in the order of ``NODE_COLUMNS``.

    ``trees`` holds (decoded value, name): with a name, the value is itself a collection of that name, whose strings
    are nodes as well. The root ``$`` has pre-order number 0. The walk keeps its own stack, so depth is no limit; it
    knows paths and hands out numbers, and no node's parent: that follows from containment (``enclosed``).
    """
    out: list[list] = []
    clock = 1
    for value, name in trees:
        if value is BAD:
            continue
        # an entry: (value, path, kind or None, position); an int closes the node at that place in out
        stack: list = [(value, "", None, 0)] if name is None else _elements(value, name, name, True)
        while stack:
            entry = stack.pop()
            if type(entry) is int:
                out[entry][6] = clock
                clock += 1
                continue
            value, path, kind, pos = entry
            if kind is not None:
                node = [kind, path, "$", pos, 0, clock, 0, 0, None]
                if fields:
                    plain = {k: v for k, v in value.items() if not isinstance(v, (dict, list))} if isinstance(value, dict) else {"value": value}
                    node[8] = clean(json.dumps(plain, ensure_ascii=False))
                clock += 1
                stack.append(len(out))
                out.append(node)
            if type(value) is dict:
                children: list = []
                for k, v in value.items():
                    if type(v) is dict or type(v) is list:
                        p = f"{path}.{k}" if path else k
                        if k in collections:
                            children.extend(reversed(_elements(v, p, k, False)))
                        else:
                            children.append((v, p, None, 0))
                stack.extend(reversed(children))
            elif type(value) is list:
                stack.extend((v, f"{path}[{i}]", None, i) for i, v in reversed([*enumerate(value)]) if type(v) is dict or type(v) is list)
    enclosed(out)
    return out


def enclosed(nodes: list[list]) -> None:
    """Set parent_path, level and parent_pre of nodes in pre-order: the parent is the last interval that is still open."""
    opened: list[list] = []
    for node in nodes:
        while opened and opened[-1][6] < node[5]:
            opened.pop()
        node[4] = len(opened)
        if opened:
            node[2], node[7] = opened[-1][1], opened[-1][5]
        opened.append(node)


def _elements(value: Any, path: str, kind: str, strings: bool) -> list:
    """Stack entries of a collection's elements, last first; a lone object is a collection of one."""
    entries = []
    for i, v in enumerate(value if type(value) is list else [value]):
        if type(v) is dict or strings and type(v) is str:
            entries.append((v, f"{path}[{i}]", kind, i))
        elif type(v) is list:
            entries.append((v, f"{path}[{i}]", None, i))
    return entries[::-1]


def flatten(df: DataFrame, key: str, sources: Mapping[str, str | None], collections: Iterable[str] = COLLECTIONS, fields: bool = True) -> DataFrame:
    """One row per node of each record: key, then ``NODE_COLUMNS``.

    ``sources`` maps each JSON text column to ``None`` (an object that holds collections) or to a name (the whole
    array is a collection of that name). Null, empty and invalid texts give no rows; an empty table gives an empty
    one; rows of one key are each a record of their own, so repeated rows give repeated nodes; other columns are not
    read, so their names cannot clash. A key of any type, null too, is carried through.
    """
    wanted = frozenset(collections)
    names = [*sources.values()]
    key_type = df.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                part = batch.slice(start, 2000)
                counts: list[int] = []
                rows: list[list] = []
                for texts in zip(*(part.column(i + 1).to_pylist() for i in range(len(names)))):
                    nodes = label(zip(map(decode, texts), names), wanted, fields)
                    counts.append(len(nodes))
                    rows += nodes
                columns = [*zip(*rows)] if rows else [()] * len(NODE_COLUMNS)
                index = pa.array([i for i, n in enumerate(counts) for _ in range(n)], pa.int64())
                paths = {1, 2}
                arrays = [part.column(0).take(index)]
                for i, c in enumerate(columns):
                    kind = pa.string() if i in (0, 1, 2, 8) else pa.int32()
                    try:
                        arrays.append(pa.array(c, kind))
                    except UnicodeEncodeError:
                        arrays.append(pa.array([clean(x) if i in paths else x for x in c], kind))
                yield pa.RecordBatch.from_arrays(arrays, names=["key", *NODE_COLUMNS])

    schema = f"key {key_type.simpleString()}, kind string, node_path string, parent_path string, pos int, level int, pre int, post int, parent_pre int, fields string"
    plain = df.select(F.col(key).alias("key"), *(F.col(c).cast("string") for c in sources))
    return plain.mapInArrow(run, schema).withColumnRenamed("key", key)


def node_table(nodes: DataFrame, kind: str) -> DataFrame:
    """The flat table of one node type."""
    return nodes.where(F.col("kind") == kind).drop("kind")


def inside(inner: DataFrame, outer: DataFrame, key: str) -> DataFrame:
    """Pairs (outer_path, inner_path) where the outer node encloses the inner one, by interval containment.

    An equi-join on the record key with the interval test as residual condition; a record's nodes bound the fan-out.
    """
    a, b = outer.alias("o"), inner.alias("i")
    return a.join(b, (F.col(f"o.{key}") == F.col(f"i.{key}")) & (F.col("i.pre") > F.col("o.pre")) & (F.col("i.post") < F.col("o.post"))).select(F.col(f"o.{key}").alias(key), F.col("o.node_path").alias("outer_path"), F.col("i.node_path").alias("inner_path"))
