"""Framed binary containers, read and written as a Spark data source.

Three layouts of JSON records: ``seed``, ``bridge`` and ``log`` files with a fixed header and
CRC-checked records; an append-only typed store; a transaction log. Frames have no sync marks, so
a file is one partition; many files are read in parallel. Local files are mapped, not loaded, so that a
task holds one frame of a file at a time. Paths may be of any file system that pyarrow knows.
"""

from __future__ import annotations

import fnmatch
import hashlib
import json
import mmap
import os
import posixpath
import struct
import time
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..functions.canonical import canonical, crc32, record_id
from ..operators.replay import REQUIRED

FILE_MAGIC = {"seed": b"BSEEDJ00", "bridge": b"BBRDGJ00", "log": b"BWAL0J00"}
KINDS = {"seed": 1, "bridge": 2, "log": 3}
_FILE = struct.Struct("<8sHHIQQ32s")
_RECORD = struct.Struct("<QIIII")
_INDEX = struct.Struct("<8sHHIQI12s")
_BLOB = struct.Struct("<8sII")


class FrameError(ValueError):
    """Bytes that aren't a container of the kind expected."""


class ChecksumError(FrameError):
    """A container whose content doesn't match its checksums."""


def encode_record(payload: object) -> bytes:
    raw = canonical(payload)
    return _RECORD.pack(record_id(raw), len(raw), crc32(raw), 0, 0) + raw


def encode_file(kind: str, payloads: list, created_ms: int | None = None) -> bytes:
    created = int(time.time() * 1000) if created_ms is None else created_ms
    head = _FILE.pack(FILE_MAGIC[kind], 1, KINDS[kind], _FILE.size, created, len(payloads), bytes(32))
    return head + b"".join(map(encode_record, payloads))


def decode_file(data: bytes, kind: str | None = None) -> Iterator[tuple[int, int, bytes]]:
    """(record id, CRC, payload bytes) of each record; checks everything that the layout lets one check."""
    if len(data) < _FILE.size:
        raise FrameError("short file header")
    magic, version, number, size, _, count, _ = _FILE.unpack_from(data)
    found = next((k for k, m in FILE_MAGIC.items() if m == magic), None)
    if found is None or version != 1 or number != KINDS[found] or size != _FILE.size:
        raise FrameError(f"not a record file: {magic!r}, version {version}, kind {number}")
    if kind and kind != found:
        raise FrameError(f"a {found} file where a {kind} file was expected")
    at = size
    for i in range(count):
        if len(data) < at + _RECORD.size:
            raise FrameError(f"record {i}: short header")
        rid, length, crc, _, _ = _RECORD.unpack_from(data, at)
        at += _RECORD.size
        raw = data[at : at + length]
        if len(raw) < length:
            raise FrameError(f"record {i}: short payload")
        if crc32(raw) != crc or record_id(raw) != rid:
            raise ChecksumError(f"record {i}: checksum or id doesn't match")
        yield rid, crc, raw
        at += length
    if at != len(data):
        raise FrameError("bytes after the last record")


class Layout(NamedTuple):
    """An append-only layout: its header holds ``magic, version, type, timestamp, [seq,] length, SHA-256``."""

    magic: bytes
    header: struct.Struct
    types: dict[int, str]
    has_seq: bool

    def digest(self, kind: int, fields: tuple[int, ...], raw: bytes) -> bytes:
        """fields: timestamp and, where there is one, seq."""
        numbers = struct.pack(">Q", fields[0]) + b"".join(struct.pack(">I", x) for x in (*fields[1:], len(raw)))
        return hashlib.sha256(self.magic + bytes((1, kind)) + numbers + raw).digest()


STORE = Layout(b"BDH1", struct.Struct(">4sBBQI32s"), dict(enumerate("SEED BRIDGE ROUTE RESULT META".split(), 1)), False)
LOG = Layout(b"BWAL", struct.Struct(">4sBBQII32s"), dict(enumerate("INTENT COMMIT ABORT CHECKPOINT".split(), 1)), True)


@dataclass
class Entry:
    offset: int
    type: str
    timestamp_ms: int
    seq: int | None
    payload: bytes


def encode_entry(layout: Layout, kind: str, payload: object, timestamp_ms: int, seq: int | None = None) -> bytes:
    raw = canonical(payload)
    number = next(k for k, name in layout.types.items() if name == kind.strip().upper())
    fields = (timestamp_ms, seq) if layout.has_seq else (timestamp_ms,)
    return layout.header.pack(layout.magic, 1, number, *fields, len(raw), layout.digest(number, fields, raw)) + raw


def decode_entries(layout: Layout, data: bytes, strict_tail: bool = False) -> Iterator[Entry]:
    """Entries in file order. A cut-off last entry ends the file quietly, unless ``strict_tail``; other damage is an error."""
    at = 0
    while at < len(data):
        body = at + layout.header.size
        if len(data) < body:
            if strict_tail:
                raise FrameError(f"offset {at}: header cut off")
            return
        magic, version, number, *fields, length, digest = layout.header.unpack_from(data, at)
        if magic != layout.magic or version != 1 or number not in layout.types:
            raise FrameError(f"offset {at}: not an entry")
        raw = data[body : body + length]
        if len(raw) < length:
            if strict_tail:
                raise FrameError(f"offset {at}: payload cut off")
            return
        if layout.digest(number, tuple(fields), raw) != digest:
            raise ChecksumError(f"offset {at}: checksum doesn't match")
        yield Entry(at, layout.types[number], fields[0], fields[1] if layout.has_seq else None, raw)
        at = body + length


def encode_index(payload: object, created_ms: int) -> bytes:
    raw = canonical(payload)
    return _INDEX.pack(b"BINDXK00", 1, _INDEX.size, len(raw), created_ms, crc32(raw), bytes(12)) + raw


def decode_index(data: bytes) -> dict:
    """The payload of an index file; its record_count must be that of its records."""
    if len(data) < _INDEX.size:
        raise FrameError("short index header")
    magic, version, size, length, _, crc, _ = _INDEX.unpack_from(data)
    if (magic, version, size) != (b"BINDXK00", 1, _INDEX.size) or len(data) != size + length:
        raise FrameError("not an index file, or not all of one")
    if crc32(data[size:]) != crc:
        raise ChecksumError("index is damaged")
    payload = json.loads(data[size:])
    if payload.get("record_count", -1) != len(payload.get("records", [])):
        raise FrameError("record_count doesn't match the records")
    return payload


def encode_blob(payload: object) -> bytes:
    """A snapshot blob: magic, length and CRC before the JSON."""
    raw = canonical(payload)
    return _BLOB.pack(b"BDBSNPM1", len(raw), zlib.crc32(raw)) + raw


def decode_blob(data: bytes) -> object:
    if len(data) < _BLOB.size or data[:8] != b"BDBSNPM1":
        raise FrameError("not a snapshot blob")
    _, length, crc = _BLOB.unpack_from(data)
    raw = data[_BLOB.size :]
    if len(raw) != length or zlib.crc32(raw) != crc:
        raise ChecksumError("snapshot blob is damaged")
    return json.loads(raw)


def encode_batch_record(payload: bytes, kind: int = 0, trust: int = 0) -> bytes:
    """The batch layout: id, kind, trust, length, CRC."""
    return _RECORD.pack(record_id(payload), kind, trust, len(payload), crc32(payload)) + payload


def encode_lab(logical_id: str, payload: bytes, kind: int = 0, trust: int = 0) -> bytes:
    """The laboratory layout of one record: magic, version, kind, trust, both lengths, CRC, SHA-256, content."""
    name = logical_id.encode()
    front = struct.pack("<4sHBBHI", b"BRS1", 1, kind, trust, len(name), len(payload))
    return front + struct.pack("<I", zlib.crc32(name + payload)) + hashlib.sha256(front + name + payload).digest() + name + payload


def decode_lab(data: bytes) -> dict:
    if len(data) < 50 or data[:6] != b"BRS1\1\0":
        raise FrameError("not a laboratory record")
    kind, trust, n, m = struct.unpack_from("<BBHI", data, 6)
    name, payload = data[50 : 50 + n], data[50 + n :]
    if len(payload) != m or encode_lab(name.decode(), payload, kind, trust) != data:
        raise ChecksumError("laboratory record is damaged")
    return {"kind": kind, "trust": trust, "logical_id": name.decode(), "payload": payload, "record_id_hex": data[18:50].hex()}


def write_manifest(path: str, files: list[str]) -> dict:
    """A manifest with the SHA-256 and size of each file."""
    entries = {}
    for f in files:
        with open(f, "rb") as file:
            data = file.read()
        entries[os.path.basename(f)] = {"sha256": hashlib.sha256(data).hexdigest(), "bytes": len(data)}
    manifest = {"files": entries, "created_ms": int(time.time() * 1000)}
    with open(path, "w") as out:
        json.dump(manifest, out, sort_keys=True, indent=2)
    return manifest


def verify_file(path: str, kind: str | None = None) -> dict:
    with open(path, "rb") as file:
        data = file.read()
    return {"path": path, "record_count": sum(1 for _ in decode_file(data, kind)), "sha256": hashlib.sha256(data).hexdigest()}


def create_seed(path: str, seed_id: str, seed_type: str, data: dict, status: str = "OBSERVED") -> dict:
    return append_entry(path, STORE, "SEED", {"seed_id": seed_id, "seed_type": seed_type, "status": status, "data": data})


def create_bridge(path: str, bridge_id: str, ends: tuple[str, str], bridge_type: str, data: dict | None = None, status: str = "OBSERVED") -> dict:
    """ends: the seeds it comes from and goes to."""
    link = dict(zip(("from_seed", "to_seed"), ends, strict=True))
    return append_entry(path, STORE, "BRIDGE", {"bridge_id": bridge_id, "bridge_type": bridge_type, "status": status, "data": data or {}} | link)


def create_route(path: str, route_id: str, steps: list[dict], status: str = "OBSERVED") -> dict:
    return append_entry(path, STORE, "ROUTE", {"route_id": route_id, "steps": steps, "status": status})


def create_result(path: str, result_id: str, result_status: str, evidence: dict) -> dict:
    return append_entry(path, STORE, "RESULT", {"result_id": result_id, "result_status": result_status, "evidence": evidence})


def begin(path: str, tx_id: str, action: str, data: dict, target: str | None = None) -> dict:
    """Log the intent of a transaction."""
    where = {"target_path": str(target)} if target else {}
    return append_entry(path, LOG, "INTENT", {"tx_id": tx_id, "action": action, "data": data} | where)


def commit(path: str, tx_id: str) -> dict:
    return append_entry(path, LOG, "COMMIT", {"tx_id": tx_id})


def abort(path: str, tx_id: str, reason: str = "") -> dict:
    return append_entry(path, LOG, "ABORT", {"tx_id": tx_id, "reason": reason})


def payload_bytes(records: DataFrame, column: str = "payload") -> DataFrame:
    """``n_records`` and ``n_bytes`` of a batch's payloads (text or binary; null: none)."""
    return records.agg(F.count("*").alias("n_records"), F.coalesce(F.sum(F.octet_length(column)), F.lit(0)).cast("bigint").alias("n_bytes"))


def append_entry(path: str, layout: Layout, kind: str, payload: dict, timestamp_ms: int | None = None) -> dict:
    """Validate, frame and append one entry, durably; a log's seq is one more than its highest.

    Missing descriptive keys get their defaults. For one writer at a time.
    """
    now = int(time.time() * 1000) if timestamp_ms is None else timestamp_ms
    name = kind.strip().upper()
    if name not in layout.types.values() or not isinstance(payload, dict):
        raise FrameError(f"unknown type {kind}, or the payload is no object")
    defaults = {"op_type": name, "schema_version": "V03H2"} if layout.has_seq else {"record_kind": name, "status": "OBSERVED", "schema_version": "V03H1"}
    full = defaults | {"created_ts": now} | ({"steps": []} if name == "ROUTE" else {}) | payload
    if missing := [k for k in REQUIRED.get(name, "").split() if not str(full.get(k, "")).strip()]:
        raise FrameError(f"{name} lacks {missing[0]}")
    seq = None
    if layout.has_seq:
        known = b""
        if os.path.exists(path):
            with open(path, "rb") as file:
                known = file.read()
        seq = 1 + max((e.seq or 0 for e in decode_entries(layout, known)), default=0)
    data = encode_entry(layout, name, full, now, seq)
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "ab") as file:
        offset = file.tell()
        file.write(data)
        file.flush()
        os.fsync(file.fileno())
    return {"path": path, "offset": offset, "type": name, "seq": seq, "timestamp_ms": now, "bytes": len(data)}


# the data source


@dataclass
class _File(InputPartition):
    path: str


def _store(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if "://" not in path and not path.startswith("file:"):
        return pyarrow.fs.LocalFileSystem(), os.path.abspath(path)
    return pyarrow.fs.FileSystem.from_uri("file://" + path.removeprefix("file:") if path.startswith("file:") and "://" not in path else path)


def _content(fs: pyarrow.fs.FileSystem, path: str):
    """A file's bytes, mapped where that can be."""
    if isinstance(fs, pyarrow.fs.LocalFileSystem) and os.path.getsize(path):
        with open(path, "rb") as file:
            return mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
    with fs.open_input_stream(path) as file:
        return file.read()


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.layout, self.kind = options["path"], options.get("layout", "file"), options.get("kind")
        fs, path = _store(self.path)
        if fs.get_file_info(path).type == pyarrow.fs.FileType.Directory:
            found = fs.get_file_info(pyarrow.fs.FileSelector(path, recursive=True))
        else:  # one file, or a pattern of names in a folder
            found = fs.get_file_info(pyarrow.fs.FileSelector(posixpath.dirname(path), allow_not_found=True))
            found = [f for f in found if f.path == path or fnmatch.fnmatchcase(f.base_name, posixpath.basename(path))]
        self.files = sorted(f.path for f in found if f.is_file and not f.base_name.startswith(("_", ".")))

    def partitions(self) -> list[InputPartition]:
        return [_File(f) for f in self.files] or [_File("")]

    def read(self, partition: _File) -> Iterator[tuple]:
        if not partition.path:
            return
        data = _content(_store(self.path)[0], partition.path)
        if self.layout == "file":
            for i, (rid, crc, raw) in enumerate(decode_file(data, self.kind)):
                yield partition.path, i, str(rid), crc, raw.decode()
        else:
            for i, e in enumerate(decode_entries(STORE if self.layout == "store" else LOG, data)):
                yield partition.path, i, e.offset, e.type, e.timestamp_ms, e.seq, e.payload.decode()


@dataclass
class _Written(WriterCommitMessage):
    temporary: str
    final: str


class _Writer(DataSourceWriter):
    """A file per task, written aside and renamed at commit, so that a lost or repeated task leaves no half of one.

    Entries are written as they come; the header of a ``file`` holds the number of its records, so its
    records are encoded before.
    """

    def __init__(self, options: dict, columns: list[str]):
        self.path, self.layout, self.columns = options["path"], options.get("layout", "file"), columns
        self.kind = options.get("kind", "seed") if self.layout == "file" else self.layout

    def write(self, rows: Iterator) -> WriterCommitMessage:
        from pyspark import TaskContext

        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        fs, folder = _store(self.path)
        fs.create_dir(folder, recursive=True)
        temporary = posixpath.join(folder, f"_{part}-{attempt}.tmp")
        with fs.open_output_stream(temporary) as file:
            if self.layout == "file":
                file.write(encode_file(self.kind, [json.loads(r[0]) for r in rows]))
            else:
                layout = STORE if self.layout == "store" else LOG
                for r in rows:
                    entry = dict(zip(self.columns, r, strict=True))
                    file.write(encode_entry(layout, entry["type"], json.loads(entry["payload"]), entry["timestamp_ms"], entry["seq"] if layout.has_seq else None))
        return _Written(temporary, posixpath.join(folder, f"part-{part:05}.{self.kind}"))

    def commit(self, messages: list) -> None:
        fs, _ = _store(self.path)
        for m in messages:
            if m is not None:
                fs.move(m.temporary, m.final)

    def abort(self, messages: list) -> None:
        fs, _ = _store(self.path)
        for m in messages:
            if m is not None and fs.get_file_info(m.temporary).is_file:
                fs.delete_file(m.temporary)


class FrameSource(DataSource):
    """``format("frames")``. Options: path; layout file, store or log; kind seed, bridge or log.

    Files give (path, record_index, record_id, crc32, payload), logs and stores (path, record_index,
    offset, type, timestamp_ms, seq, payload). Writes files from rows of one column of JSON text, stores and logs
    from rows with type, timestamp_ms, payload (JSON text) and, for logs, seq.
    """

    @classmethod
    def name(cls) -> str:
        return "frames"

    def schema(self) -> str:
        if self.options.get("layout", "file") == "file":
            return "path string, record_index int, record_id string, crc32 bigint, payload string"
        return "path string, record_index int, offset bigint, type string, timestamp_ms bigint, seq bigint, payload string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options, schema.names)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FrameSource)
