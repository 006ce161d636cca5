"""Binary web logs as a data source, in batch and as a stream.

Records have a fixed length, so splits and the number of each split's first record follow
from the lengths of the files: nothing is read before it is decoded, every record once.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from tallyflow.schema import UPDATE_SCHEMA

# Layout of one 20-byte web log record, big-endian.
WEB_RECORD = np.dtype(
    [
        ("time", ">u4"),
        ("client", ">u4"),
        ("object", ">u4"),
        ("size", ">u4"),
        ("method", "u1"),
        ("status", "u1"),
        ("type", "u1"),
        ("server", "u1"),
    ]
)
#: Records of a split, and of a decoded batch.
SPLIT_RECORDS = 1 << 20
BATCH_RECORDS = 1 << 14


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def list_files(path: str, record: int = WEB_RECORD.itemsize) -> list[tuple[str, int]]:
    """Files under a folder, or one file, with their number of records, in the order of their names."""
    store, inside = _store(path)
    info = store.get_file_info(inside)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.is_file else store.get_file_info(pafs.FileSelector(inside, recursive=True))
    files = sorted((f.path, f.size) for f in found if f.is_file and not f.base_name.startswith(("_", ".")))
    for name, size in files:
        if size % record:
            raise ValueError(f"{name} does not hold whole records of {record} bytes")
    return [(name, size // record) for name, size in files]


@dataclass
class Split(InputPartition):
    """``count`` records of a file from record ``at`` on; the first one is number ``first`` of all."""

    file: str
    at: int
    count: int
    first: int


def splits(files: list[tuple[str, int]], start: int, end: int, most: int) -> list[Split]:
    """The records numbered ``start`` to ``end`` - 1 over all files, in splits of up to ``most``."""
    out, before = [], 0
    for name, count in files:
        at, stop = max(start - before, 0), min(end - before, count)
        while at < stop:
            n = min(most, stop - at)
            out.append(Split(name, at, n, before + at))
            at += n
        before += count
    return out


class _Decoder:
    """Reads splits; shared by the batch and the streaming reader."""

    def __init__(self, options: Mapping[str, str]) -> None:
        self.path = options["path"]
        self.fields = [options.get(o, d) for o, d in (("sid_field", "type"), ("hid_field", "server"), ("key_field", "client"))]
        self.most = int(options.get("split_records", SPLIT_RECORDS))
        unknown = [f for f in self.fields if f not in WEB_RECORD.names]
        if unknown:
            raise ValueError(f"web log records have no field {unknown}")

    def read(self, split: Split) -> Iterator[pa.RecordBatch]:
        # Names of found files have no scheme, so the store is that of the path.
        store, _ = _store(self.path)
        schema = pa.schema([("sid", pa.int32()), ("hid", pa.int32()), *[(c, pa.int64()) for c in ("key", "upd", "ts", "seq")]])
        with store.open_input_file(split.file) as f:
            f.seek(split.at * WEB_RECORD.itemsize)
            for start in range(0, split.count, BATCH_RECORDS):
                n = min(BATCH_RECORDS, split.count - start)
                records = np.frombuffer(f.read(n * WEB_RECORD.itemsize), dtype=WEB_RECORD)
                if len(records) < n:
                    raise OSError(f"{split.file} has become shorter")
                sid, hid, key = (records[c].astype(np.int64) for c in self.fields)
                seq = np.arange(split.first + start, split.first + start + n)
                columns = [sid.astype(np.int32), hid.astype(np.int32), key, np.ones(n, dtype=np.int64), records["time"].astype(np.int64), seq]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=schema)


class WebLogReader(DataSourceReader):
    def __init__(self, options: Mapping[str, str]) -> None:
        self.decoder = _Decoder(options)

    def partitions(self) -> list[Split]:
        files = list_files(self.decoder.path)
        found = splits(files, 0, sum(n for _, n in files), self.decoder.most)
        return found or [Split("", 0, 0, 0)]

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        return self.decoder.read(partition) if partition.count else iter(())


class WebLogStreamReader(DataSourceStreamReader):
    """The offset is the number of records given out.

    Files may grow and new ones may come, as long as their names sort behind those that are there.
    ``max_records`` bounds a micro-batch.
    """

    def __init__(self, options: Mapping[str, str]) -> None:
        self.decoder = _Decoder(options)
        self.bound = int(options.get("max_records", 0))
        self.given = 0

    def initialOffset(self) -> dict:
        return {"records": 0}

    def latestOffset(self) -> dict:
        total = sum(n for _, n in list_files(self.decoder.path))
        return {"records": min(total, self.given + self.bound) if self.bound else total}

    def partitions(self, start: dict, end: dict) -> list[Split]:
        self.given = end["records"]
        return splits(list_files(self.decoder.path), start["records"], end["records"], self.decoder.most)

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        return self.decoder.read(partition)

    def commit(self, end: dict) -> None:
        """Nothing is kept for given records; a restarted query goes on from its own checkpoint."""
        self.given = max(self.given, end["records"])


class WebLogSource(DataSource):
    """``spark.read.format("web_log").load(path)`` and ``spark.readStream…``."""

    @classmethod
    def name(cls) -> str:
        return "web_log"

    def schema(self):
        return UPDATE_SCHEMA

    def reader(self, schema) -> WebLogReader:
        return WebLogReader(self.options)

    def streamReader(self, schema) -> WebLogStreamReader:
        return WebLogStreamReader(self.options)
