"""Importer and exporter of dependency trees stored as text (F8, F18): lists of edge records in Python's notation."""

from __future__ import annotations

import ast
import itertools
import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from inferna.operators.annotate import EDGE_TYPE

NUMBERS, TEXTS = ("id", "head"), ("text", "lemma", "pos", "deprel")
ORDER = ("id", "text", "lemma", "pos", "head", "deprel")


def edges_of(stored: str | None) -> list[dict]:
    """The edge records of one stored tree, as typed values; anything that is no list of records gives none, a record's
    missing or unfit field is null.  Only literals are read, nothing is evaluated."""
    try:
        found = ast.literal_eval(stored) if stored else []
    except (ValueError, SyntaxError, MemoryError, RecursionError, TypeError):
        return []
    if not isinstance(found, list):
        return []

    def number(v):
        return v if isinstance(v, int) and not isinstance(v, bool) and abs(v) < 2**31 else None
    return [{n: number(e.get(n)) for n in NUMBERS} | {t: None if e.get(t) is None else str(e[t]) for t in TEXTS} for e in found if isinstance(e, dict)]


_TEXT = r"""('[^'\\\r\n\0]*'|"[^"\\\r\n\0]*"|None)"""
_NUMBER = r"(-?(?:0|[1-9][0-9]*)|None)"
#: A record as ``export_edges`` writes it, without escapes in its texts.
PLAIN = re.compile("\\{" + ", ".join(f"'{n}': {_NUMBER if n in NUMBERS else _TEXT}" for n in ORDER) + r"\}(?:, |\])")


def columns_of(stored: list[str | None]) -> tuple[list[int], list[list]]:
    """(number of edges of each tree, values of all edges by field of ``ORDER``).

    Plain records are read by one pattern; a tree that holds anything else is read as a literal."""
    sizes, fields = [], [[] for _ in ORDER]
    put = [f.append for f in fields]
    for tree in stored:
        before = len(fields[0])
        at, end = 1, len(tree) if tree else 0
        if end > 2 and tree[0] == "[" and tree[-1] == "]":
            while at < end:
                found = PLAIN.match(tree, at)
                if found is None:
                    break
                for add, n, v in zip(put, ORDER, found.groups()):
                    if v == "None":
                        add(None)
                    elif n in NUMBERS:
                        x = int(v) if len(v) < 12 else None
                        add(x if x is not None and abs(x) < 2**31 else None)
                    else:
                        add(v[1:-1])
                at = found.end()
                if tree[at - 1] == "]":
                    break
        if end and not (at == end and len(fields[0]) > before):
            for f in fields:
                del f[before:]
            for e in edges_of(tree):
                for add, n in zip(put, ORDER):
                    add(e[n])
        sizes.append(len(fields[0]) - before)
    return sizes, fields


def import_edges(column: Column) -> Column:
    """Stored text -> typed array of edges, in Arrow batches."""
    @F.arrow_udf(f"array<{EDGE_TYPE}>")
    def run(trees: pa.Array) -> pa.Array:
        sizes, fields = columns_of(trees.to_pylist())
        values = [pa.array(f, pa.int32() if n in NUMBERS else pa.string()) for n, f in zip(ORDER, fields)]
        return pa.ListArray.from_arrays(pa.array([0, *itertools.accumulate(sizes)], pa.int32()), pa.StructArray.from_arrays(values, names=list(ORDER)))
    return run(column)


def export_edges(column: Column) -> Column:
    """Typed array of edges -> the stored text."""
    record = "{{" + ", ".join(f"'{n}': {{!r}}" for n in ORDER) + "}}"

    @F.arrow_udf("string")
    def run(trees: pa.Array) -> pa.Array:
        flat = trees.flatten()
        texts = list(map(record.format, *[pc.struct_field(flat, n).to_pylist() for n in ORDER]))
        ends = list(itertools.accumulate(pc.fill_null(pc.list_value_length(trees), 0).to_pylist()))
        return pa.array([f"[{', '.join(texts[s:e])}]" for s, e in zip([0, *ends], ends)], pa.string())
    return run(column)
