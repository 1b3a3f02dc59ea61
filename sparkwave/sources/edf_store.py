"""Where the bytes of an EDF+ file lie: in one file, or in a folder of parts with a manifest; any Arrow file system has either.

A folder's manifest names its parts in order and has the header, so header and parts, joined, are the file. What the
manifest doesn't name isn't part of it, whoever left it there.
"""

from __future__ import annotations

import json
import os
from bisect import bisect_right
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyarrow import fs as pafs

from ..errors import DataIntegrityError, UnsupportedFormatError
from .recording import filesystem

# Widths of the header's fields, in order, of the file and of each signal.
FILE_FIELDS = (8, 80, 80, 8, 8, 8, 44, 8, 8, 4)
SIGNAL_FIELDS = (16, 80, 8, 8, 8, 8, 8, 80, 8, 32)
MANIFEST = "_manifest.json"


def located(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI or of a local path."""
    return filesystem(uri if "://" in uri or uri.startswith("file:") else os.path.abspath(uri))


def columns_of(data: bytes, widths: tuple[int, ...], n: int = 1) -> list[list[str]]:
    out, at = [], 0
    for w in widths:
        out.append([data[at + i * w : at + (i + 1) * w].decode("ascii").rstrip() for i in range(n)])
        at += w * n
    return out


@dataclass(frozen=True)
class Head:
    """A header's bytes and what they say."""

    data: bytes

    def __post_init__(self) -> None:
        try:
            good = len(self.data) == int(self.file[5]) == 256 * (1 + int(self.file[9])) and self.records >= 0 and all(n > 0 for n in self.points)
        except (ValueError, IndexError):
            good = False
        if not good:
            raise UnsupportedFormatError("this isn't the header of a finished EDF file")

    @cached_property
    def file(self) -> tuple[str, ...]:
        return tuple(c[0] for c in columns_of(self.data[:256], FILE_FIELDS))

    @cached_property
    def signals(self) -> tuple[tuple[str, ...], ...]:
        return tuple(zip(*columns_of(self.data[256:], SIGNAL_FIELDS, int(self.file[9])), strict=True))

    @property
    def points(self) -> list[int]:
        return [int(s[8]) for s in self.signals]

    @property
    def records(self) -> int:
        return int(self.file[7])

    @property
    def record_bytes(self) -> int:
        return 2 * sum(self.points)


@dataclass(frozen=True)
class Stored:
    """A readable file: its header, and (path, byte at which records begin, first record, records) of each piece, in order."""

    uri: str
    head: Head
    pieces: tuple[tuple[str, int, int, int], ...]

    @staticmethod
    def open(uri: str, manifest: str = MANIFEST) -> Stored:
        fs, path = located(uri)
        info = fs.get_file_info(path)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(uri)
        if info.type == pafs.FileType.Directory:
            if fs.get_file_info(f"{path}/{manifest}").type != pafs.FileType.File:
                raise FileNotFoundError(f"{uri} has no manifest, so it isn't a finished file")
            with fs.open_input_stream(f"{path}/{manifest}") as f:
                listed = json.loads(f.read())
            head, at, pieces = Head(listed["header"].encode("ascii")), 0, []
            for name, count in listed["parts"]:
                pieces.append((f"{path}/{name}", 0, at, count))
                at += count
        else:
            with fs.open_input_file(path) as f:
                first = f.read(256)
                n = first[252:256].decode("ascii", "replace").strip()
                head = Head(first + f.read(256 * int(n) if n.isdigit() else 0))
            at, pieces = head.records, [(path, len(head.data), 0, head.records)]
            if info.size != len(head.data) + at * head.record_bytes:
                raise DataIntegrityError("the file's size isn't what its header says")
        if at != head.records:
            raise DataIntegrityError("the parts don't have the records that the header says")
        return Stored(uri, head, tuple(pieces))

    @contextmanager
    def reader(self) -> Iterator[Callable[[int, int], bytes]]:
        """A function of (first record, records) that gives their bytes; the piece read last stays open."""
        fs, _ = located(self.uri)
        firsts, width, held = [p[2] for p in self.pieces], self.head.record_bytes, [None, None]

        def read(first: int, count: int) -> bytes:
            found = []
            while count:
                number = bisect_right(firsts, first) - 1
                path, begin, start, size = self.pieces[number]
                n = min(count, start + size - first)
                if n < 1:
                    raise DataIntegrityError("a record beyond the file's end")
                if held[0] != number:
                    if held[1]:
                        held[1].close()
                    held[:] = number, fs.open_input_file(path)
                data = held[1].read_at(n * width, begin + (first - start) * width)
                if len(data) != n * width:
                    raise DataIntegrityError("a part of the file is shorter than its records")
                found.append(data)
                first, count = first + n, count - n
            return b"".join(found)

        try:
            yield read
        finally:
            if held[1]:
                held[1].close()


def record_batch(first: int, data: bytes, width: int) -> pa.RecordBatch:
    n = len(data) // width if width else 0
    return pa.RecordBatch.from_arrays([pa.array(range(first, first + n), pa.int64()), pa.array([data[i * width : (i + 1) * width] for i in range(n)], pa.binary())], names=["record", "payload"])
