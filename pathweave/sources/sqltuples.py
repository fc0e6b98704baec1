"""Tuples of dump statements one by one, with what is wrong of those that are malformed.

``sqldump.parse`` reads statements with expressions on the JVM side and takes
what is well formed.  This reader is for loads that must not lose rows unseen:
it goes through a statement tuple by tuple, gives rows as it goes, and after an
error goes on with the next tuple that it can find.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathweave.schema import DUMP_COLUMNS
from pathweave.sources.sqldump import typed

_STRING = r"'[^'\\]*+(?:\\.[^'\\]*+)*+'"
_VALUE = rf"(?:{_STRING}|[^,'()\s]++)"
_INSIDE = re.compile(rf"\((?:{_STRING}|[^'()])*+", re.DOTALL)
_ROW = re.compile(rf"{_VALUE}(?:,{_VALUE})*+", re.DOTALL)
_VALUES = re.compile(_VALUE, re.DOTALL)
#: Tuples given at a time, and characters of a malformed one that are shown.
_BATCH, SHOWN = 10_000, 200


def scan(statement: str, at: int, n_values: int) -> Iterator[tuple[list[str] | None, str | None, str | None]]:
    """(values, text, error) of each tuple from ``at`` on: values, or else the text of what is malformed and why."""
    end = len(statement)
    while at < end:
        m = _INSIDE.match(statement, at)
        stop = m.end() if m else at
        error = None
        if m is None:
            error = "no tuple where one is due"
        elif stop == end:
            error = "tuple not closed"
        elif statement[stop] == "'":
            error = "string not closed"
        elif statement[stop] == "(":
            error = "parenthesis inside a tuple"
        else:
            inside = statement[at + 1 : stop]
            values = _VALUES.findall(inside) if _ROW.fullmatch(inside) else None
            if values is None:
                error = "values not understood"
            elif len(values) != n_values:
                error = f"{len(values)} values where {n_values} are due"
            else:
                yield values, None, None
            stop += 1
        if error:
            # the next tuple that can be told
            after = statement.find("),(", at)
            stop = after + 1 if after >= 0 else end
            yield None, statement[at : min(stop, at + SHOWN)], error
        at = stop
        if at < end and statement[at] == ",":
            at += 1
            if at == end:
                yield None, ",", "no tuple where one is due"
        elif at < end:
            rest = statement[at:].strip()
            if rest in (";", ""):
                return
            again = statement.find("(", at)
            yield None, statement[at : at + SHOWN] if again < 0 else statement[at : min(again, at + SHOWN)], "no comma after a tuple"
            if again < 0:
                return
            at = again


_OUT = pa.schema([("n", pa.int32()), ("v", pa.list_(pa.string())), ("text", pa.string()), ("error", pa.string())])


def tuples(lines: DataFrame, table: str) -> DataFrame:
    """(n, v, text, error), and line where the lines have it: every tuple of the INSERT statements of ``table``."""
    head, n_values = f"INSERT INTO `{table}` VALUES ", len(DUMP_COLUMNS[table])
    placed = ["line"] if "line" in lines.columns else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                out: list[list] = [[], [], [], []]
                place = batch.column("line").slice(i, 1) if placed else None

                def made(out: list[list] = out, place: pa.Array | None = place) -> pa.RecordBatch:
                    columns = [pa.array(x, f.type) for x, f in zip(out, _OUT, strict=True)]
                    if place is not None:
                        columns.append(place.take(pa.array([0] * len(out[0]), pa.int32())))
                    batch_ = pa.RecordBatch.from_arrays(columns, [*_OUT.names, *placed])
                    for x in out:
                        x.clear()
                    return batch_

                for n, row in enumerate(scan(batch.column("value")[i].as_py(), len(head), n_values)):
                    for x, value in zip(out, (n, *row), strict=True):
                        x.append(value)
                    if len(out[0]) == _BATCH:
                        yield made()
                yield made()

    rows = lines.filter(F.col("value").startswith(head)).select("value", *placed)
    kind = f", line {lines.schema['line'].dataType.simpleString()}" if placed else ""
    return rows.mapInArrow(run, f"n int, v array<string>, text string, error string{kind}")


def parse(lines: DataFrame, table: str) -> DataFrame:
    """Rows of ``table`` as sqldump.parse gives them, from well-formed tuples only."""
    found = tuples(lines, table).filter("error is null")
    return typed(found.withColumn("ordinal", F.struct("line", "n")) if "line" in lines.columns else found, table)


def malformed(lines: DataFrame, table: str) -> DataFrame:
    """(n, text, error), and line: the tuples of ``table`` that are not loaded."""
    return tuples(lines, table).filter("error is not null").drop("v")
