"""Archive directories as Spark data sources: rolling writers with commit, readers by byte range.

Tasks write archives straight to their final names in ``<path>``, which begin with the job's id; next to
each lies an index of its members' offsets.  Commit writes the names of the successful attempts into
one manifest and renames that once, so a job counts whole or not at all, wherever its driver is
lost; files that no manifest names are not read.  Readers plan byte ranges over the archives from file
sizes alone; a range owns the members that start in it.  Archives of other makers, without index or
manifest, are read whole by one task each, if their format tells where members end.  Paths are
URIs of any store that pyarrow opens (file, hdfs, s3, gs).
"""

from __future__ import annotations

import json
import re
import time
import uuid
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql.datasource import DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: Bytes after which a task begins another archive.
ROLL = 1 << 30
#: Bytes of archive in one partition.
RANGE = 128 << 20
#: Bytes of payload in one Arrow batch of a reader.
BATCH = 4 << 20
ATTEMPTS = 3


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class ArchiveWriter(DataSourceArrowWriter):
    """Subclasses give ``suffix`` and ``members(batch)``: an iterator of encoded members."""

    suffix = ".bin"

    def __init__(self, options: dict[str, str]):
        self.path, self.job = options["path"].rstrip("/"), uuid.uuid4().hex
        self.roll = int(options.get("roll_bytes", ROLL))

    def members(self, batch: pa.RecordBatch) -> Iterator[bytes]:
        raise NotImplementedError

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = opened(self.path)
        store.create_dir(root, recursive=True)
        names, out, offsets, at = [], None, array("q"), 0

        def close() -> None:
            out.close()
            with store.open_output_stream(f"{root}/{names[-1]}.idx", compression=None) as f:
                f.write(np.array([*offsets, at], "<i8").tobytes())

        for batch in iterator:
            for member in self.members(batch):
                if out is None or at >= self.roll:
                    if out is not None:
                        close()
                    names.append(f"{self.job}-{uuid.uuid4().hex}{self.suffix}")
                    out, offsets, at = store.open_output_stream(f"{root}/{names[-1]}", compression=None), array("q"), 0
                offsets.append(at)
                out.write(member)
                at += len(member)
        if out is not None:
            close()
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = opened(self.path)
        store.create_dir(root, recursive=True)
        with store.open_output_stream(f"{root}/{self.job}.open", compression=None) as f:
            f.write(json.dumps([n for m in messages if m for n in m.names]).encode())
        store.move(f"{root}/{self.job}.open", f"{root}/{self.job}.manifest")

    def abort(self, messages: list[Written | None]) -> None:
        store, root = opened(self.path)
        for f in store.get_file_info(pafs.FileSelector(root, allow_not_found=True)):
            if f.base_name.startswith(self.job):
                store.delete_file(f.path)


class Range(InputPartition):
    def __init__(self, name: str, start: int, end: int):
        self.name, self.start, self.end = name, start, end


class RangeReader(DataSourceReader):
    """Subclasses give ``suffix`` and ``rows(members)``: Arrow batches of (archive, offset, bytes or None, error or None)."""

    suffix = ".bin"

    def __init__(self, options: dict[str, str]):
        self.path = options["path"].rstrip("/")
        self.range, self.attempts = int(options.get("range_bytes", RANGE)), int(options.get("attempts", ATTEMPTS))

    def partitions(self) -> list[Range]:
        store, root = opened(self.path)
        found = {f.base_name: f for f in store.get_file_info(pafs.FileSelector(root, allow_not_found=True)) if f.is_file}
        named: set[str] = set()
        for name, f in found.items():
            if name.endswith(".manifest"):
                with store.open_input_stream(f.path, compression=None) as x:
                    named.update(json.loads(x.read()))
        own = re.compile(r"[0-9a-f]{32}-[0-9a-f]{32}" + re.escape(self.suffix))
        ours = sorted(n for n in found if n.endswith(self.suffix) and (n in named or not own.fullmatch(n)))
        if missing := sorted(named - set(found)):
            raise FileNotFoundError(f"archives that a manifest names are gone: {missing[:3]}")
        step = {n: self.range if f"{n}.idx" in found else max(found[n].size, 1) for n in ours}
        return [Range(n, a, min(a + step[n], found[n].size)) for n in ours for a in range(0, max(found[n].size, 1), step[n])] or [Range("", 0, 0)]

    def rows(self, members: Iterator[tuple[str, int, bytes | None, str | None]]) -> Iterator[pa.RecordBatch]:
        raise NotImplementedError

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return self.rows(self._members(partition)) if partition.name else iter(())

    def _members(self, p: Range) -> Iterator[tuple[str, int, bytes | None, str | None]]:
        store, root = opened(self.path)
        if store.get_file_info(f"{root}/{p.name}.idx").is_file:
            with store.open_input_stream(f"{root}/{p.name}.idx", compression=None) as f:
                offsets = np.frombuffer(f.read(), "<i8")
        else:
            with store.open_input_stream(f"{root}/{p.name}", compression=None) as f:
                offsets = np.array(self.boundaries(f), "<i8")
        first, last = np.searchsorted(offsets[:-1], [p.start, p.end])
        source = None
        for k in range(first, last):
            start, end, data, error = int(offsets[k]), int(offsets[k + 1]), None, None
            for attempt in range(self.attempts):
                try:
                    source = source or store.open_input_file(f"{root}/{p.name}")
                    data = self.checked(source.read_at(end - start, start))
                    error = None
                    break
                except (OSError, ValueError) as e:  # one member's failure is its own; the next try opens the file anew
                    error, source = f"{type(e).__name__}: {e}", None
                    time.sleep(0.05 * attempt)
            yield p.name, start, data, error

    def boundaries(self, source: pa.NativeFile) -> array:
        """Offsets of the members of an archive without an index, and its end."""
        raise FileNotFoundError("the archive has no index")

    def checked(self, data: bytes) -> bytes:
        """The member, or ValueError if it is damaged."""
        return data
