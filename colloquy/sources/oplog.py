"""Folding an editor's append-only mutation log into its document.

The fold is ordered and doesn't commute, so each log is one group's work.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

INITIAL, SET, PUSH, DELETE = 0, 1, 2, 3


def _child(node, key, make=None):
    """The member of a container; with make a missing one is created."""
    if isinstance(node, list) and isinstance(key, int):
        if make is not None:
            node.extend([None] * (key + 1 - len(node)))
        held = node[key] if key < len(node) else None
    elif isinstance(node, dict):
        held = node.get(str(key))
    else:
        raise ValueError("no container")
    if held is None and make is not None:
        held = make
        _put(node, key, held)
    return held


def _put(node, key, value) -> None:
    if isinstance(node, list):
        node.extend([None] * (int(key) + 1 - len(node)))
        node[int(key)] = value
    elif isinstance(node, dict):
        node[str(key)] = value
    else:
        raise ValueError("no container")


def fold(operations: list[dict], document=None, begun: bool = False):
    """The document after all operations: Initial replaces it, Set creates what is missing on its way, Push cuts an array
    to ``i`` and appends, Delete leaves a hole. Malformed operations are skipped; without an Initial there is none. With a
    document that has begun, the fold goes on from there (and changes it)."""
    for op in operations:
        try:
            kind, path, value = op["kind"], op.get("k") or [], op.get("v")
            if kind == INITIAL:
                document, begun = value, True
                continue
            if not begun or not path:
                continue
            node = document
            for here, after in zip(path, path[1:], strict=False):
                node = _child(node, here, ([] if isinstance(after, int) else {}) if kind != DELETE else None)
            if kind == SET:
                _put(node, path[-1], value)
            elif kind == DELETE:
                if isinstance(node, dict):
                    node.pop(str(path[-1]), None)
                elif _child(node, path[-1]) is not None:
                    _put(node, path[-1], None)
            elif kind == PUSH:
                held = _child(node, path[-1], [])
                if isinstance(held, list):
                    del held[op["i"] if isinstance(op.get("i"), int) else len(held) :]
                    held += value if isinstance(value, list) else []
        except (KeyError, IndexError, TypeError, ValueError, AttributeError):
            continue
    return document if begun else None


def documents(rows: DataFrame) -> DataFrame:
    """path -> v, the folded document, of records (path, pos, v)."""

    def folded(log: pd.DataFrame) -> pd.DataFrame:
        operations = [json.loads(x) for x in log.sort_values("pos")["op"]]
        document = fold([o for o in operations if isinstance(o, dict)])
        return pd.DataFrame({"path": [log["path"].iloc[0]], "document": [None if document is None else json.dumps(document, ensure_ascii=False)]})

    out = rows.select("path", "pos", F.to_json("v").alias("op")).groupBy("path").applyInPandas(folded, "path string, document string")
    return out.where("document is not null").select("path", F.try_parse_json("document").alias("v"))
