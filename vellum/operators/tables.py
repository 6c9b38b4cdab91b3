"""Tables in plain text: lines parted by bars, tabs or aligned blanks become sentences, a sentence for each row."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame

#: Blank columns between two columns of an aligned table, at least.
GAP = 2


_GAP, _RULE = re.compile(rf"\S {{{GAP},}}\S", re.ASCII), re.compile(r"[\s|:+-]*-[\s|:+-]*", re.ASCII)


def _kind(line: str) -> str | None:
    """``bar``: two bars or more; ``tab``: three columns by tabs or more; ``gap``: GAP blanks or more between words."""
    if line.count("|") >= 2:
        return "bar"
    if line.count("\t") >= 2:
        return "tab"
    return "gap" if " " * GAP in line and _GAP.search(line) else None


def _column_starts(lines: list[str]) -> list[int]:
    """Where the columns of aligned lines begin: after every GAP columns or more that are blank in all of them."""
    used = sorted({i for x in lines for i, c in enumerate(x) if c != " "})
    return [p for p, last in zip(used, [-1 - GAP, *used]) if last < 0 or p - last > GAP]


def _cells(lines: list[str], kind: str) -> list[list[str]]:
    if kind == "bar":
        own = [x.strip(" ") for x in lines]
        cut = [x[x.startswith("|") : len(x) - (len(x) > 1 and x.endswith("|"))].split("|") for x in own]
    elif kind == "tab":
        cut = [x.split("\t") for x in lines]
    else:
        starts = _column_starts(lines)
        cut = [[x[p:q] for p, q in zip(starts, [*starts[1:], None])] for x in lines]
    return [[c.strip(" ") for c in row] for row in cut]


def _told(lines: list[str], kind: str, lead: str) -> list[str | None] | None:
    """A run of lines as its heading and a sentence for each row (None: left out); None where it is no table."""
    rows, rules = _cells(lines, kind), [_RULE.fullmatch(x) is not None for x in lines]
    head = rows[0]
    if len(head) < 2 or rules[0] or rules.count(False) < 2 or any(len(r) != len(head) for r, rule in zip(rows, rules) if not rule):
        return None
    said = [", ".join(" ".join(x for x in pair if x) for pair in zip(head, r) if any(pair)) for r in rows]
    return [None, *(None if rule else f"{lead}{x}." for x, rule in zip(said[1:], rules[1:]))]


def prose_of(text: str, lead: str) -> tuple[str, int]:
    """One text with its tables rewritten, and how many rows became sentences."""
    out, rows = [], 0
    for kind, run in groupby(text.split("\n"), _kind):
        own = list(run)
        told = _told(own, kind, lead) if kind and len(own) > 1 else None
        if told is not None:
            own = [x for x in told if x is not None]
            rows += len(own)
        out += own
    return "\n".join(out), rows


def prose(docs: DataFrame, lead: str = "Details: ") -> DataFrame:
    """doc_id, text and n_rows: texts with every table rewritten, and how many rows became sentences.

    A table is a run of two lines or more with equally many cells, two at least: the first is the
    heading, each other one a sentence of its headings and values. Lines of only dashes, bars and colons
    under a heading are left out. Aligned columns begin where all lines of the run were blank before,
    so a value may hold single blanks. Runs that are no tables, and other lines, stay as they are. A
    text has to fit into a row; each is rewritten by itself, so nothing is shuffled. Null texts stay null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # a few texts at a time, whose rewritten ones are held beside them
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                told = [(None, 0) if t is None else prose_of(t, lead) for t in part.column(1).to_pylist()]
                columns = [part.column(0), pa.array([t for t, _ in told], pa.string()), pa.array([n for _, n in told], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text", "n_rows"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text string, n_rows long")
