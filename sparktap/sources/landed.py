"""Landed record files: a data source that reads them as a table or a stream, and writes them once whatever is retried.

`spark.dataSource.register(LandedRecords)`, then format "landed_records" with these options (path is any that pyarrow.fs
opens):

* reading: splitBytes (64 MiB) is a partition's share of a file; maxBytesPerTrigger bounds a micro-batch (no bound if not
  given) and needs progressLocation, a folder that this stream alone uses.
* writing: rotateBytes (128 MiB) is a file's largest size; as = records or lines (column value: binary, or text); compression
  = none or gzip, for lines.

A record file is a row of frames: four marks, the length and the CRC-32 of the record (each 4 bytes, the lowest first), and
the record. A reader may begin anywhere: it looks for the next place where marks, length and CRC agree, so files are split
without an index. Broken bytes are passed over to the next whole frame.

Files land whole: writers rename them into place, and names (the batch, the task and a number) ascend in that order. A stream's
offset is (file, byte): all of the files before it by name, and the frames that start before that byte. So the rows of a batch
follow from its two offsets, and a restart reads the same ones again.

A task writes under a name of its own attempt. The commit takes over what the attempts that Spark chose have written and
deletes the rest, so a task that is tried again, or a batch that is, leaves no row twice. Defined results: null values are not
written; a folder without files is an empty table.
"""

from __future__ import annotations

import gzip
import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, DataSourceStreamReader, InputPartition, WriterCommitMessage

MARK = b"\xf5rec"
HEAD = len(MARK) + 8
MOST_RECORD = 1 << 28
READ = 1 << 22
BATCH = 4096
PENDING = "_pending"


def frame(record: bytes) -> bytes:
    return MARK + len(record).to_bytes(4, "little") + zlib.crc32(record).to_bytes(4, "little") + record


def scan(file, size: int, low: int, high: int) -> Iterator[tuple[int, bytes]]:
    """(place, record) of the whole frames that start in [low, high) of a file."""
    at, held, base = low, b"", low

    def more(upto: int) -> bytes:
        """The bytes from `at` on, as far as `upto` if the file has them."""
        nonlocal held, base
        if at > base + len(held) or at < base:
            held, base = b"", at
        held, base = held[at - base :], at
        if base + len(held) < min(upto, size):
            file.seek(base + len(held))
            held += file.read(max(READ, min(upto, size) - base - len(held)))
        return held

    while at < high:
        data = more(at + HEAD)
        found = data.find(MARK)
        if found < 0:
            step = max(1, len(data) - len(MARK) + 1)
            if at + step >= size:
                return
            at += step
            continue
        if found:
            at += found
            continue
        n = int.from_bytes(data[4:8], "little")
        if len(data) >= HEAD and n <= MOST_RECORD and at + HEAD + n <= size:
            record = more(at + HEAD + n)[HEAD : HEAD + n]
            if zlib.crc32(record) == int.from_bytes(data[8:12], "little"):
                yield at, record
                at += HEAD + n
                continue
        at += 1


@dataclass
class Span(InputPartition):
    path: str
    low: int
    high: int
    size: int


class Folder:
    """The landed files of a folder, in the order of their names."""

    def __init__(self, options: dict):
        path = options.get("path")
        if not path:
            raise ValueError("landed_records needs a path")
        self.files, self.path = fs.FileSystem.from_uri(path) if path[:1] != "/" else (fs.LocalFileSystem(), path)
        self.path = self.path.rstrip("/")

    def landed(self, after: str = "") -> list[tuple[str, int]]:
        found = self.files.get_file_info(fs.FileSelector(self.path, allow_not_found=True))
        return sorted((f.base_name, f.size) for f in found if f.type == fs.FileType.File and f.base_name[0] not in "._" and f.base_name >= after)

    def spans(self, wanted: list[tuple[str, int, int, int]], split: int) -> list[Span]:
        """Partitions of (name, low, high, size)."""
        return [Span(f"{self.path}/{name}", at, min(high, at + split), size) for name, low, high, size in wanted for at in range(low, high, split)]

    def rows(self, span: Span) -> Iterator[pa.RecordBatch]:
        name = span.path.rpartition("/")[2]
        with self.files.open_input_file(span.path) as file:
            places, records, held = [], [], 0
            for at, record in scan(file, span.size, span.low, span.high):
                places.append(at), records.append(record)
                held += len(record)
                if len(records) == BATCH or held > READ:
                    yield _rows(name, places, records)
                    places, records, held = [], [], 0
            if records:
                yield _rows(name, places, records)


def _rows(name: str, places: list, records: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([name] * len(places)), pa.array(places, pa.int64()), pa.array(records, pa.binary())], names=["file", "place", "record"])


class TableReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.split = Folder(options), int(options.get("splitbytes", 64 << 20))

    def partitions(self) -> list[Span]:
        return self.folder.spans([(name, 0, size, size) for name, size in self.folder.landed()], self.split) or [Span("", 0, 0, 0)]

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        if partition.path:
            yield from self.folder.rows(partition)


class StreamReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.folder, self.split = Folder(options), int(options.get("splitbytes", 64 << 20))
        self.most = int(options["maxbytespertrigger"]) if "maxbytespertrigger" in options else None
        self.progress = options.get("progresslocation")
        if self.most is not None and (self.most <= 0 or not self.progress):
            raise ValueError("maxBytesPerTrigger must be positive and needs progressLocation")
        self.at: dict | None = None

    def initialOffset(self) -> dict:
        return {"file": "", "byte": 0}

    def _known(self) -> dict:
        """The end of the last planned batch: Spark doesn't say where the next one begins."""
        if self.at is None and self.most is not None:
            own = Folder({"path": self.progress})
            if own.files.get_file_info(f"{own.path}/at.json").type == fs.FileType.File:
                with own.files.open_input_stream(f"{own.path}/at.json") as f:
                    self.at = json.loads(f.read())
        return self.at or self.initialOffset()

    def _remember(self, end: dict) -> None:
        self.at = end
        if self.most is not None:
            own = Folder({"path": self.progress})
            own.files.create_dir(own.path, recursive=True)
            with own.files.open_output_stream(f"{own.path}/at.json.new") as f:
                f.write(json.dumps(end).encode())
            own.files.move(f"{own.path}/at.json.new", f"{own.path}/at.json")

    def latestOffset(self) -> dict:
        start = self._known()
        left, end = self.most, dict(start)
        for name, size in self.folder.landed(start["file"]):
            low = start["byte"] if name == start["file"] else 0
            take = size - low if left is None else min(size - low, left)
            if take <= 0 and left is not None and left <= 0:
                break
            end = {"file": name, "byte": low + take}
            left = None if left is None else left - take
        return end

    def partitions(self, start: dict, end: dict) -> list[Span]:
        wanted = []
        for name, size in self.folder.landed(start["file"]):
            if name > end["file"]:
                break
            low = start["byte"] if name == start["file"] else 0
            high = end["byte"] if name == end["file"] else size
            if high > low:
                wanted.append((name, low, high, size))
        self._remember(end)
        return self.folder.spans(wanted, self.split) or [Span("", 0, 0, 0)]

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        if partition.path:
            yield from self.folder.rows(partition)

    def commit(self, end: dict) -> None:
        pass


@dataclass
class Written(WriterCommitMessage):
    run: str
    attempt: str
    task: int
    files: int
    rows: int
    bytes: int


class FileWriter:
    """What a task does: files of at most rotateBytes under the attempt's own folder; and what the driver does then."""

    def __init__(self, options: dict):
        self.folder = Folder(options)
        self.most = int(options.get("rotatebytes", 128 << 20))
        self.lines, self.packed = options.get("as", "records") == "lines", options.get("compression", "none") == "gzip"
        self.run = uuid.uuid4().hex
        if self.packed and not self.lines:
            raise ValueError("only lines are compressed: a record file must be open to readers at any byte")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        task, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex
        own = f"{self.folder.path}/{PENDING}/{self.run}/{attempt}"
        self.folder.files.create_dir(own, recursive=True)
        files, rows, total, out, size = 0, 0, 0, None, 0
        try:
            for batch in iterator:
                for value in batch.column(batch.schema.get_field_index("record" if "record" in batch.schema.names else "value")).to_pylist():
                    if value is None:
                        continue
                    data = (value if isinstance(value, bytes) else value.encode()) + b"\n" if self.lines else frame(value)
                    if out is not None and size + len(data) > self.most:
                        out.close()
                        out = None
                    if out is None:
                        raw = self.folder.files.open_output_stream(f"{own}/{files:06d}")
                        out, size, files = gzip.GzipFile(fileobj=raw, mode="wb", mtime=0) if self.packed else raw, 0, files + 1
                        self._raw = raw
                    out.write(data)
                    size, rows, total = size + len(data), rows + 1, total + len(data)
        finally:
            if out is not None:
                out.close()
                if not self._raw.closed:
                    self._raw.close()
        return Written(self.run, attempt, task, files, rows, total)

    def take_over(self, messages: list[Written | None], batch: int | None) -> None:
        """A batch's files take their places; those of an earlier try of the same batch go."""
        name = f"b{batch:010d}" if batch is not None else f"t{self.run}"
        for old, _ in self.folder.landed():
            if old.startswith(f"{name}-"):
                self.folder.files.delete_file(f"{self.folder.path}/{old}")
        end = (".ndjson" if self.lines else ".rec") + (".gz" if self.packed else "")
        for m in filter(None, messages):
            for k in range(m.files):
                self.folder.files.move(f"{self.folder.path}/{PENDING}/{m.run}/{m.attempt}/{k:06d}", f"{self.folder.path}/{name}-{m.task:06d}-{k:06d}{end}")
        self.drop(messages)

    def drop(self, messages: list[Written | None]) -> None:
        """What attempts of this write have left; that of a driver that was lost stays, unread, until it is deleted."""
        for run in {self.run, *(m.run for m in messages if m)}:
            own = f"{self.folder.path}/{PENDING}/{run}"
            if self.folder.files.get_file_info(own).type == fs.FileType.Directory:
                self.folder.files.delete_dir(own)


class TableWriter(FileWriter, DataSourceArrowWriter):
    def commit(self, messages: list) -> None:
        self.take_over(messages, None)

    def abort(self, messages: list) -> None:
        self.drop(messages)


class StreamWriter(FileWriter, DataSourceStreamArrowWriter):
    def commit(self, messages: list, batchId: int) -> None:
        self.take_over(messages, batchId)

    def abort(self, messages: list, batchId: int) -> None:
        self.drop(messages)


class LandedRecords(DataSource):
    @classmethod
    def name(cls) -> str:
        return "landed_records"

    def _options(self) -> dict:
        return {k.lower(): v for k, v in self.options.items()}

    def schema(self) -> str:
        return "file string, place long, record binary"

    def reader(self, schema) -> TableReader:
        return TableReader(self._options())

    def streamReader(self, schema) -> StreamReader:
        return StreamReader(self._options())

    def writer(self, schema, overwrite: bool) -> TableWriter:
        if overwrite:
            raise ValueError("landed files are only added to: use mode append")
        return TableWriter(self._options())

    def streamWriter(self, schema, overwrite: bool) -> StreamWriter:
        return StreamWriter(self._options())
