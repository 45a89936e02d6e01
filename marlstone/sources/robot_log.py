"""Robot logs (survey S1-S3, T-1, T-6): records that may span lines, folded per file, per job of a table, or as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "scan_id string, seq long, kind string, fields array<string>"


def split_fields(body: str) -> list[str] | None:
    """S3: fields between commas; quotes may open anywhere, a doubled quote inside them is one; None if one stays open."""
    fields, field, quoted, i = [], [], False, 0
    while i < len(body):
        c = body[i]
        if quoted and c == '"' and body[i + 1 : i + 2] == '"':
            field.append('"')
            i += 1
        elif c == '"':
            quoted = not quoted
        elif c == "," and not quoted:
            fields.append("".join(field))
            field = []
        else:
            field.append(c)
        i += 1
    return None if quoted else [*fields, "".join(field)]


class Fold:
    """S1, T-1: lines to records. A line that ends in a backslash, or inside quotes, goes on in the next one.

    A record without a colon is dropped. Each quote mark opens or closes, a doubled one both, so their number after the
    colon tells whether one is open: a record's text is looked at once, however many lines it has.
    """

    def __init__(self, pending: str = "") -> None:
        self._parts: list[str] = []
        self._colon = self._open = False
        if pending:
            self._take(pending)

    def _take(self, part: str) -> None:
        if part:
            self._parts.append(part)
        marks = part
        if not self._colon:
            _, colon, marks = part.partition(":")
            self._colon = bool(colon)
        if self._colon:
            self._open ^= bool(marks.count('"') & 1)

    @property
    def pending(self) -> str:
        """The text of the record that has not ended."""
        return "".join(self._parts)

    def push(self, line: str) -> tuple[str, list[str]] | None:
        """The record that ends with this line, if any."""
        line = line.rstrip("\r\n")
        if self._parts:
            self._parts.append("\n")
        self._take(line.removesuffix("\\"))
        return None if line.endswith("\\") or self._open else self.finish()

    def finish(self) -> tuple[str, list[str]] | None:
        """T-6: at the end of a log, the pending record if all its quotes are closed; what is left open is dropped."""
        text, whole = self.pending.rstrip("\r\n"), self._colon and not self._open
        self.__init__()
        kind, _, body = text.partition(":")
        return (kind, split_fields(body) or []) if whole else None


def fold(lines: list[str]) -> Iterator[tuple[str, list[str]]]:
    """(kind, fields) of each record of a whole log."""
    state = Fold()
    for line in lines:
        record = state.push(line)
        if record:
            yield record
    record = state.finish()
    if record:
        yield record


def _batch(rows: list[tuple[str, int, str, list[str]]]) -> pa.RecordBatch:
    names, seqs, kinds, fields = zip(*rows) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(seqs, pa.int64()), pa.array(kinds, pa.string()), pa.array(fields, pa.list_(pa.string()))], ["scan_id", "seq", "kind", "fields"])


def read_robot_logs(spark: SparkSession, path: str) -> DataFrame:
    """scan_record of every log under path: scan_id (the file), seq, kind, fields. Files are folded side by side."""
    logs = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("scan_id"), "value")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield _batch([(name, i, *r) for i, r in enumerate(fold((text or "").split("\n")))])

    return logs.mapInArrow(run, SCHEMA)


def fold_lines(lines: DataFrame, job: str, seq: str, line: str) -> DataFrame:
    """scan_record of a table of lines: scan_id (the job), seq from 0, kind, fields.

    A job's lines are sorted in its partition and folded one by one; only the record that is open is held.
    """
    rows = lines.select(F.col(job).cast("string").alias("job"), F.col(seq).alias("seq"), F.col(line).alias("line")).repartition("job").sortWithinPartitions("job", "seq").select("job", "line")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, own, number, out = Fold(), None, 0, []

        def give(record: tuple[str, list[str]] | None) -> None:
            nonlocal number
            if record:
                out.append((own, number, *record))
                number += 1

        started = False
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not started or name != own:
                    give(state.finish())
                    started, own, number = True, name, 0
                give(state.push(text or ""))
            yield _batch(out)
            out.clear()
        give(state.finish())
        yield _batch(out)

    return rows.mapInArrow(run, SCHEMA)


#: What a job of a stream keeps between micro-batches: the text of the open record and the number of the next one.
STATE = "pending string, next long"


def fold_job(key: tuple, frames: Iterator[pd.DataFrame], state: object) -> Iterator[pd.DataFrame]:
    """T-1, T-6: the records that end in a micro-batch; a row with `ended` gives a whole pending record and forgets the job."""
    pending, number = state.get if state.exists else ("", 0)
    fold_state, out, ended = Fold(pending), [], False
    rows = pd.concat(list(frames)).sort_values("seq", kind="stable")
    for line, last in zip(rows["line"], rows["ended"]):
        records = [fold_state.push(line)] if isinstance(line, str) else []
        if last is True or last == 1:
            records.append(fold_state.finish())
            ended = True
        for record in records:
            if record:
                out.append((key[0], number, *record))
                number += 1
    if ended:
        if state.exists:
            state.remove()
    else:
        state.update((fold_state.pending, number))
    yield pd.DataFrame(out, columns=["scan_id", "seq", "kind", "fields"])


def stream_records(lines: DataFrame) -> DataFrame:
    """T-1: scan_record of a stream of lines (job string, seq long, line string, ended boolean).

    A job's lines of a micro-batch are taken in order of seq and must come after those of earlier ones. A row with
    `ended` true tells that a job is over; its line may be null. Until then what is pending is kept as state.
    """
    return lines.groupBy("job").applyInPandasWithState(fold_job, SCHEMA, STATE, "append", "NoTimeout")
