"""GeoJSON in any layout, cut into byte ranges that many tasks read; no record is lost without a word.

A range alone does not tell whether it begins inside a text or how many braces are open. So each range
is summed up for both cases first: how it ends, how the depth changes, how often it comes back to where the file began. Folding the few summaries of a
file, in order, gives the state at the start of every range. Then each range hands out the records that begin in
it, whatever the formatting. Nothing is decided from the beginning of a file.

Where the braces of a file do not add up, its lines are records instead, and lines that do not parse are reported.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import vector_files as vf

RANGE_BYTES = 32 * 1024 * 1024
#: Bytes read at a time to find the end of a record that goes on behind its range.
MORE_BYTES = 1024 * 1024

_TOKEN = re.compile(rb'"[^"\\]*(?:\\.[^"\\]*)*("|\Z|\\\Z)|[{}\[\]]', re.S)
_TEXT_END = re.compile(rb'[^"\\]*(?:\\.[^"\\]*)*("|\Z|\\\Z)', re.S)
SUMMARY = "path string, start long, stop long, size long, escaped boolean, open0 boolean, delta0 long, low0 long, roots0 long, open1 boolean, delta1 long, low1 long, roots1 long"
STATE = "path string, start long, stop long, size long, inside boolean, escaped boolean, depth long, roots long, sound boolean"
RECORDS = "source_file string, place long, text string, error string"


def begin(data: bytes, inside: bool, escaped: bool) -> int:
    """Where the structure begins: behind the text that the data begins in, if it does; -1 if it never ends."""
    if not inside:
        return 0
    found = _TEXT_END.match(data, 1 if escaped else 0)
    return found.end() if found and found[1] == b'"' else -1


def events(data: bytes, start: int) -> Iterator[tuple[int, int]]:
    """(position, +1 or -1) of brackets outside texts, and (position, 0) of a text that does not end."""
    for found in _TOKEN.finditer(data, start):
        sign = data[found.start()]
        if sign == 0x22:
            if found[1] != b'"':
                yield found.start(), 0
        else:
            yield found.start(), 1 if sign in b"{[" else -1


def summed(data: bytes, inside: bool, escaped: bool) -> tuple[bool, int, int, int]:
    """(ends inside a text, change of depth, lowest depth, times the lowest depth was newly reached or reached again)."""
    start = begin(data, inside, escaped)
    if start < 0:
        return True, 0, 0, 0
    depth = low = roots = 0
    for _, step in events(data, start):
        if step == 0:
            return True, depth, low, roots
        depth += step
        if step < 0 and depth <= low:
            roots = roots + 1 if depth == low else 1
            low = depth
    return False, depth, low, roots


def _backslashes(path: str, start: int) -> int:
    """How many backslashes stand right before a place."""
    n, width = 0, 1024
    while start - n > 0:
        chunk = vf.read_range(path, max(0, start - n - width), min(width, start - n))
        kept = len(chunk) - len(chunk.rstrip(b"\\"))
        n += kept
        if kept < len(chunk):
            break
    return n


def _summaries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for path, start, stop, size in batch.itertuples(index=False):
            data = vf.read_range(path, start, stop - start)
            escaped = bool(start) and _backslashes(path, start) % 2 == 1
            rows.append((path, start, stop, size, escaped, *summed(data, False, False), *(summed(data, True, escaped) if start else (False, 0, 0, 0))))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in SUMMARY.split(", ")])


def folded(ranges: pd.DataFrame) -> pd.DataFrame:
    """The state at the start of each range of one file, from the summaries of all."""
    inside, depth, roots, sound, out = False, 0, 0, True, []
    for r in ranges.sort_values("start").itertuples(index=False):
        out.append([r.path, r.start, r.stop, r.size, inside, r.escaped, depth])
        ends, delta, low, back = (r.open1, r.delta1, r.low1, r.roots1) if inside else (r.open0, r.delta0, r.low0, r.roots0)
        sound &= depth + low >= 0
        roots += back if depth + low == 0 else 0
        inside, depth = ends, depth + delta
    sound &= not inside and depth == 0
    return pd.DataFrame([[*row, roots, sound] for row in out], columns=[c.split()[0] for c in STATE.split(", ")])


def _closed(path: str, at: int) -> bytes | None:
    """The record that begins at a place and ends anywhere behind it; None if the file ends first."""
    data = b""
    while True:
        more = vf.read_range(path, at + len(data), max(MORE_BYTES, len(data)))
        data += more
        depth = 0
        for place, step in events(data, 0):
            depth += step
            if step < 0 and depth == 0:
                return data[: place + 1]
        if not more:
            return None


def _records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, start, stop, size, inside, escaped, depth, roots, _ in batch.itertuples(index=False):
            data, rows = vf.read_range(path, start, stop - start), []
            # Members of the one collection, or one object after another.
            level, first, kind = (0 if roots > 1 else 2), -1, 0x7B
            at = begin(data, inside, escaped)
            for place, step in events(data, at) if at >= 0 else ():
                if step > 0 and depth == level and first < 0 and data[place] == kind:
                    first = place
                depth += step
                if step < 0 and depth == level and first >= 0:
                    rows.append((path, start + first, data[first : place + 1], None))
                    first = -1
            if first >= 0:
                text = _closed(path, start + first)
                rows.append((path, start + first, text, None if text else "the file ends inside the record"))
            if roots == 1 and start == 0 and stop == size and not rows:
                rows.append((path, 0, data, None))  # a single feature, or an empty collection
            yield pd.DataFrame([(p, a, None if t is None else t.decode("utf-8", "replace"), e) for p, a, t, e in rows], columns=[c.split()[0] for c in RECORDS.split(", ")])


def geojson_records(spark: SparkSession, paths: list[str], range_bytes: int = RANGE_BYTES) -> DataFrame:
    """source_file, place, text, error: every record's own text, by the byte at which it begins, or why there is none.

    Records are the objects of the collection, or the file's objects if it has several, or the one object of a file of one range.
    In files whose braces do not add up, lines are records.
    """
    # By number: rows that name ranges are so small that adaptive execution would put them all into one task.
    tasks = spark.sparkContext.defaultParallelism * 4
    files = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, min(len(paths), tasks)))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(p, a, min(a + range_bytes, size), size) for p in batch["path"] for size in [vf.file_size(p)] for a in range(0, size, range_bytes)]
            yield pd.DataFrame(rows, columns=["path", "start", "stop", "size"])

    ranges = files.mapInPandas(cut, "path string, start long, stop long, size long").repartition(tasks, "path", "start")
    # A file has one summary for each 32 MB, which are folded together.
    states = ranges.mapInPandas(_summaries, SUMMARY).groupBy("path").applyInPandas(folded, STATE)
    sound = states.where("sound").repartition(tasks, "path", "start").mapInPandas(_records, RECORDS)
    unsound = states.where("NOT sound AND start = 0").select("path")

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                place, rest, size = 0, b"", vf.file_size(path)
                rows = [(path, 0, None, "the braces of the file do not add up; its lines were read")]
                for at in range(0, size, MORE_BYTES):
                    *whole, rest = (rest + vf.read_range(path, at, MORE_BYTES)).split(b"\n")
                    for line in [*whole, *([rest] if at + MORE_BYTES >= size else [])]:
                        text = line.strip().removesuffix(b",")
                        if text.startswith(b"{") and b'"Feature"' in text:
                            rows.append((path, place, text.decode("utf-8", "replace"), None))
                        place += len(line) + 1
                    yield pd.DataFrame(rows, columns=[c.split()[0] for c in RECORDS.split(", ")])
                    rows = []

    return sound.unionByName(unsound.mapInPandas(lines, RECORDS))
