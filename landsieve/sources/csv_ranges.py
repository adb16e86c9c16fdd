"""CSV files cut into byte ranges that many tasks read, with line breaks and separators in quoted cells.

A range alone does not tell whether it begins inside a quoted cell. So each range is summed up for
every state that it can begin in; folding the summaries of a file in order gives the state at the start of each
range. Then each range hands out the records that begin in it. A quote opens a cell only as its
first character; elsewhere in a cell without quotes it is a character like others.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from . import vector_files as vf

RANGE_BYTES = 32 * 1024 * 1024
#: Bytes read at first to find the end of a record that goes on behind its range.
MORE_BYTES = 1024 * 1024
#: A longer record, as a quote that never closes makes it, is not read but reported.
MAX_RECORD = 64 * 1024 * 1024
#: At the start of a cell, inside one without quotes, inside quotes, behind a quote inside quotes (its end, or half of a doubled one).
CELL, BARE, QUOTED, CLOSING = range(4)

_QUOTED = re.compile(rb'(?<=[,\r\n])"[^"]*+(?:""[^"]*+)*+("|\Z)')
_REST = re.compile(rb'[^"]*+(?:""[^"]*+)*+("|\Z)')
RANGE = "path string, start long, stop long, size long, head long"
SUMMARY = f"{RANGE}, end0 int, end1 int, end2 int, end3 int"
STATE = f"{RANGE}, state int"
RECORDS = "source_file string, place long, text string, error string"


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def quoted_cells(data: bytes, state: int) -> tuple[list[tuple[int, int]], int]:
    """Where quoted cells lie in ``data``, and the state behind it."""
    spans, at, whole = [], 0, None
    if state == CLOSING:
        state = QUOTED if data[:1] == b'"' else BARE
        at = 1 if state == QUOTED else 0
    elif state == CELL:
        state = QUOTED if data[:1] == b'"' else BARE
        at = 1 if state == QUOTED else 0
    if state == QUOTED:
        whole = _REST.match(data, at)
        spans.append((0, whole.end()))
        at = whole.end()
    for whole in _QUOTED.finditer(data, at):
        spans.append(whole.span())
    if whole and whole.end() == len(data):
        return spans, CLOSING if whole[1] else QUOTED
    return spans, CELL if data[-1:] in (b",", b"\r", b"\n") else BARE


def breaks(data: bytes, spans: list[tuple[int, int]]) -> np.ndarray:
    """Places of line ends outside quoted cells."""
    signs = np.frombuffer(data, np.uint8)
    places = np.flatnonzero((signs == 10) | (signs == 13))
    if spans and len(places):
        first, last = np.array(spans).T
        cell = np.searchsorted(first, places, "right") - 1
        places = places[(cell < 0) | (places >= last[np.maximum(cell, 0)])]
    return places


def _head(path: str, size: int) -> int:
    """Where the header begins: behind a byte order mark and empty lines."""
    at = 3 if vf.read_range(path, 0, min(3, size)) == b"\xef\xbb\xbf" else 0
    while at < size:
        data = vf.read_range(path, at, min(65536, size - at))
        filled = len(data) - len(data.lstrip(b"\r\n"))
        at += filled
        if filled < len(data):
            break
    return at


def _summaries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for row in batch.itertuples(index=False):
            data = vf.read_range(row.path, row.start, row.stop - row.start)
            ends = {s: quoted_cells(data, s)[1] for s in (BARE, QUOTED)}
            starts_quoted = data[:1] == b'"'
            ends[CELL] = quoted_cells(data, CELL)[1] if starts_quoted else ends[BARE]
            ends[CLOSING] = quoted_cells(data, CLOSING)[1] if starts_quoted else ends[BARE]
            rows.append((*row, *[ends[s] for s in range(4)]))
        yield pd.DataFrame(rows, columns=_names(SUMMARY))


def folded(ranges: pd.DataFrame) -> pd.DataFrame:
    """The state at the start of each range of one file."""
    state, out = CELL, []
    for r in ranges.sort_values("start").itertuples(index=False):
        out.append((*r[:5], state))
        state = (r.end0, r.end1, r.end2, r.end3)[state]
    return pd.DataFrame(out, columns=_names(STATE))


def _closed(path: str, at: int, size: int) -> bytes | None:
    """The record that begins at a place and ends behind its range; None if it is too long."""
    width = MORE_BYTES
    while True:
        data = vf.read_range(path, at, min(width, size - at))
        ends = breaks(data, quoted_cells(data, CELL)[0])
        if len(ends):
            return data[: ends[0]]
        if at + width >= size:
            return data if len(data) <= MAX_RECORD else None
        if width >= MAX_RECORD:
            return None
        width = min(2 * width, MAX_RECORD)


def range_records(path: str, start: int, stop: int, size: int, head: int, state: int) -> list[tuple]:
    """The records that begin in a range, without the header and empty lines."""
    if stop <= head:
        return []
    before = start > head and vf.read_range(path, start - 1, 1) in (b"\r", b"\n")
    skipped = max(head - start, 0)
    data = vf.read_range(path, start + skipped, stop - start - skipped)
    ends = breaks(data, quoted_cells(data, CELL if skipped else state)[0]).tolist()
    begins = [e + 1 for e in ends]
    if start <= head or (before and state == CELL):
        begins.insert(0, 0)
    elif ends:
        ends.pop(0)
    rows, base = [], start + skipped
    for first, last in zip(begins, [*ends, None]):
        if last is not None:
            record = data[first:last]
        else:
            record = _closed(path, base + first, size) if first < len(data) else b""
        if base + first != head and record != b"":
            error = "a record of over 64 MB, such as a quote that never closes" if record is None else None
            rows.append((path, base + first, None if record is None else record.decode("utf-8", "replace"), error))
    return rows


def _records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for row in batch.itertuples(index=False):
            yield pd.DataFrame(range_records(*row), columns=_names(RECORDS))


def csv_records(spark: SparkSession, paths: list[str], range_bytes: int = RANGE_BYTES) -> DataFrame:
    """source_file, place, text, error: the text of every record but the header, by the byte at which it begins.

    Records end at a line feed, a carriage return or both, outside quoted cells; empty lines are none. Empty files have none.
    """
    # By number: rows that name ranges are so small that adaptive execution would put them all into one task.
    tasks = spark.sparkContext.defaultParallelism * 4
    files = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, min(len(paths), tasks)))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                size = vf.file_size(path)
                head = _head(path, size)
                rows = [(path, a, min(a + range_bytes, size), size, head) for a in range(0, size, range_bytes)]
                yield pd.DataFrame(rows, columns=_names(RANGE))

    ranges = files.mapInPandas(cut, RANGE).repartition(tasks, "path", "start")
    # A file has one summary for each 32 MB, which are folded together.
    states = ranges.mapInPandas(_summaries, SUMMARY).groupBy("path").applyInPandas(folded, STATE)
    return states.repartition(tasks, "path", "start").mapInPandas(_records, RECORDS)
