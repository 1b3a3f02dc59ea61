"""Recordings made from tables: an encoder for tests, benchmarks and round trips."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.notes import write_literal
from ..session import ship_package
from . import layout
from .packets import encode
from .recording import filesystem


def header_bytes(n_channels: int, rate: float, shorted: np.ndarray, headbox: int = layout.HEADBOX) -> bytes:
    data = layout.build_header("erd", layout.ERD_HEADER)
    struct.pack_into("<dii", data, 352, rate, n_channels, layout.DELTA_BITS)
    struct.pack_into(f"<{n_channels}i", data, 368, *range(n_channels))
    struct.pack_into("<4i", data, 4464, headbox, 0, 0, 0)
    struct.pack_into("<i", data, 4556, layout.DISCARD_BITS)
    struct.pack_into(f"<{n_channels}h", data, 4560, *map(int, shorted))
    struct.pack_into(f"<{n_channels}h", data, 6608, *[layout.FREQUENCY_FACTOR] * n_channels)
    return bytes(data)


def table_bytes(segments: list[tuple[str, int, int, int, int]]) -> bytes:
    data = layout.build_header("stc", layout.STC_ENTRIES)
    return bytes(data) + b"".join(name.encode().ljust(layout.STC_NAME, b"\0") + struct.pack("<4i", *rest) for name, *rest in segments)


def clock_bytes(anchors: list[tuple[int, int]]) -> bytes:
    data = layout.build_header("snc")
    data[:16] = layout.SNC_GUID
    return bytes(data) + b"".join(struct.pack("<iQ", *a) for a in anchors)


def notes_bytes(notes: list[tuple[int, str]]) -> bytes:
    out, before = bytearray(layout.build_header("ent")), 0
    for kind, text in notes:
        raw = text.encode() + b"\0\0"
        out += struct.pack("<4i", kind, layout.ENT_RECORD + len(raw), before, 0) + raw
        before = layout.ENT_RECORD + len(raw)
    return bytes(out) + bytes(16)


def event_note(stamp: int, text: str, user: str) -> tuple[int, str]:
    return 1, write_literal({"Stamp": stamp, "Text": text, "Data": {"User": user}})


def write(df: DataFrame, folder: str, *, sample: str, values: list[str], n_samples: int, rate: float, n_channels: int = layout.RECORDED_CHANNELS, packet: int = 64, segment: int = 16_384, drop=None, origin: int = 1000, anchors: list[tuple[int, int]] | None = None, notes: list[tuple[int, str]] | None = None) -> str:
    """A recording of the rows (``sample``, ``values``...): channels after the values are shorted.

    Packets end at multiples of ``packet`` and wherever samples are missing. ``drop`` is a condition on ``packet`` (the
    sample's packet number) whose packets are left out. Segments are written by one task each.
    """
    spark = df.sparkSession
    ship_package(spark)
    fs, path = filesystem(folder)
    fs.create_dir(path, recursive=True)
    shorted = np.arange(n_channels) >= len(values)
    rows = df.select(F.col(sample).cast("long").alias("sample"), F.floor(F.col(sample) / packet).cast("long").alias("packet"), F.floor(F.col(sample) / segment).cast("int").alias("segment"), F.array(*(F.col(v).cast("long") for v in values)).alias("values"))
    if drop is not None:
        rows = rows.where(~drop)
    schema = "segment int, stored long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, pending, state = None, [], {}

        def flush() -> None:
            if pending:
                data = encode(np.array([v for _, v in pending]), shorted)
                s = state
                s["index"].append(struct.pack("<iiihh", s["at"], origin + pending[0][0], s["stored"], len(pending), 0))
                s["out"].write(data)
                s["at"] += len(data)
                s["stored"] += len(pending)
                pending.clear()

        def close() -> pa.RecordBatch:
            flush()
            state["out"].close()
            with fs_.open_output_stream(f"{path_}/seg{current:05d}.etc", compression=None) as f:
                f.write(bytes(layout.build_header("etc")) + b"".join(state["index"]))
            return pa.RecordBatch.from_arrays([pa.array([current], pa.int32()), pa.array([state["stored"]], pa.int64())], names=["segment", "stored"])

        fs_, path_ = filesystem(folder)
        last = after = None
        for batch in batches:
            rows_ = batch.column(3).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(values))
            for at, number, seg, row in zip(*(batch.column(i).to_pylist() for i in range(3)), rows_, strict=True):
                if seg != current:
                    if current is not None:
                        yield close()
                    current, last = seg, None
                    out = fs_.open_output_stream(f"{path_}/seg{seg:05d}.erd", compression=None)
                    out.write(header_bytes(n_channels, rate, shorted))
                    state = {"out": out, "at": layout.ERD_HEADER, "stored": 0, "index": []}
                if number != last or at != after:
                    flush()
                    last = number
                pending.append((at, row))
                after = at + 1
        if current is not None:
            yield close()

    count = -(-n_samples // segment)
    written = rows.repartition(count, "segment").sortWithinPartitions("segment", "sample").mapInArrow(run, schema).collect()  # a row per segment
    stored = {r["segment"]: r["stored"] for r in written}
    segments, number = [], 0
    for i in range(count):
        a, b = i * segment, min(n_samples, (i + 1) * segment)
        if i not in stored:
            for kind, data in (("erd", header_bytes(n_channels, rate, shorted)), ("etc", bytes(layout.build_header("etc")))):
                with fs.open_output_stream(f"{path}/seg{i:05d}.{kind}", compression=None) as f:
                    f.write(data)
        segments.append((f"seg{i:05d}", origin + a, origin + b - 1, number, stored.get(i, 0)))
        number += stored.get(i, 0)
    extra = {"rec.stc": table_bytes(segments)} | ({"rec.snc": clock_bytes(anchors)} if anchors else {}) | ({"rec.ent": notes_bytes(notes)} if notes else {})
    for name, data in extra.items():
        with fs.open_output_stream(f"{path}/{name}", compression=None) as f:
            f.write(data)
    return folder
