"""Binary layouts of a recording's files, all little-endian. Offsets and sizes are fixed values of the format."""

from __future__ import annotations

import math
import re
import struct
from dataclasses import dataclass

import numpy as np

from ..errors import DataIntegrityError, UnsupportedFormatError

HEADER = 352
ERD_HEADER = 8656
STC_ENTRIES, STC_ENTRY, STC_NAME = 408, 272, 256
ETC_ENTRY, SNC_ENTRY, ENT_RECORD = 16, 12, 16
SNC_GUID = bytes.fromhex("d2a98660af60d311986000104b75c151")
#: (file schema, base schema) by kind
SCHEMAS = {"erd": (9, 1), "stc": (1, 1), "etc": (3, 1), "ent": (3, 1), "snc": (1, 1)}
MAX_CHANNELS = 1024
SIGNAL_CHANNELS = 256
HEADBOX, DELTA_BITS, DISCARD_BITS, FREQUENCY_FACTOR = 20, 8, 6, 32767
RECORDED_CHANNELS = 276
UV_PER_COUNT = -8711 / (2**21 - 0.5) * 2**DISCARD_BITS
#: Names that Windows keeps for devices.
_DEVICES = re.compile(r"(con|prn|aux|nul|com[1-9¹²³]|lpt[1-9¹²³]|conin\$|conout\$)(\..*)?", re.I)


@dataclass(frozen=True)
class Header:
    """Of a data file: rate, channels and how they are stored."""

    file_schema: int
    base_schema: int
    sample_rate: float
    n_channels: int
    delta_bits: int
    physical: tuple[int, ...]
    headbox: tuple[int, ...]
    discard_bits: int
    shorted: tuple[bool, ...]
    factors: tuple[int, ...]


def check_schema(data: bytes, kind: str) -> None:
    if len(data) < HEADER:
        raise DataIntegrityError(f"the {kind} header is truncated")
    found = struct.unpack_from("<HH", data, 16)
    if found != SCHEMAS[kind]:
        raise UnsupportedFormatError(f"{kind} schema {found[0]}/{found[1]} isn't supported")


def parse_header(data: bytes) -> Header:
    check_schema(data, "erd")
    if len(data) < ERD_HEADER:
        raise DataIntegrityError("the erd header is truncated")
    rate, n, delta = struct.unpack_from("<dii", data, 352)
    if not 1 <= n <= MAX_CHANNELS:
        raise DataIntegrityError("the channel count must be between 1 and 1024")
    if not math.isfinite(rate) or rate <= 0:
        raise DataIntegrityError("the sample rate must be finite and positive")
    shorted = np.frombuffer(data, "<i2", n, 4560)
    if not np.isin(shorted, (0, 1)).all():
        raise DataIntegrityError("a shorted flag is neither 0 nor 1")
    ints = lambda kind, count, at: tuple(np.frombuffer(data, kind, count, at).tolist())
    return Header(*struct.unpack_from("<HH", data, 16), rate, n, delta, ints("<i4", n, 368), ints("<i4", 4, 4464), struct.unpack_from("<i", data, 4556)[0], tuple(map(bool, shorted)), ints("<i2", n, 6608))


def layout_faults(h: Header, channels: int | None = RECORDED_CHANNELS) -> list[str]:
    """All that differs from the one accepted layout; ``channels`` None accepts any channel count."""
    faults = [
        (h.file_schema != SCHEMAS["erd"][0], f"file schema {h.file_schema}"), (h.base_schema != SCHEMAS["erd"][1], f"base schema {h.base_schema}"),
        (h.headbox[0] != HEADBOX, f"headbox {h.headbox[0]}"), (any(h.headbox[1:]), "several headboxes"),
        (channels is not None and h.n_channels != channels, f"{h.n_channels} channels"), (h.delta_bits != DELTA_BITS, f"{h.delta_bits} delta bits"),
        (h.discard_bits != DISCARD_BITS, f"{h.discard_bits} discarded bits"), (h.physical != tuple(range(h.n_channels)), "another physical order"),
        (any(f != FREQUENCY_FACTOR for f in h.factors), "frequency factors"),
    ]
    return [text for bad, text in faults if bad]


def safe_name(name: str) -> bool:
    """Whether a segment name is a plain file name on every system."""
    return bool(name) and name not in (".", "..") and name == name.rstrip(" .") and not re.search(r'[\x00-\x1f<>:"/\\|?*]', name) and not _DEVICES.fullmatch(name)


def parse_segments(data: bytes) -> list[tuple[str, int, int, int, int]]:
    """(name, start stamp, inclusive end stamp, sample number, stored samples)"""
    check_schema(data, "stc")
    if len(data) < STC_ENTRIES or (len(data) - STC_ENTRIES) % STC_ENTRY:
        raise DataIntegrityError("the segment table holds a partial entry")
    found = []
    for at in range(STC_ENTRIES, len(data), STC_ENTRY):
        raw = data[at : at + STC_NAME]
        try:
            name = raw[: raw.index(0)].decode("utf-8")
        except ValueError as error:
            raise DataIntegrityError("a segment name isn't terminated UTF-8") from error
        found.append((name, *struct.unpack_from("<4i", data, at + STC_NAME)))
    return found


def segment_faults(segments: list[tuple[str, int, int, int, int]]) -> list[str]:
    faults = [] if segments else ["no segments"]
    seen: set[str] = set()
    for i, (name, start, end, _, stored) in enumerate(segments):
        if not safe_name(name):
            faults.append(f"segment {i}: unsafe name")
        if name.casefold() in seen:
            faults.append(f"segment {i}: repeated name")
        seen.add(name.casefold())
        if end < start:
            faults.append(f"segment {i}: reversed bounds")
        if not 0 <= stored <= end - start + 1:
            faults.append(f"segment {i}: impossible number of stored samples")
        if i and start <= segments[i - 1][2]:
            faults.append(f"segment {i}: overlaps the one before")
    return faults


def parse_packets(data: bytes) -> np.ndarray:
    """Rows of offset, stamp, sample number, span and an unknown field."""
    check_schema(data, "etc")
    if (len(data) - HEADER) % ETC_ENTRY:
        raise DataIntegrityError("the packet index holds a partial entry")
    return np.frombuffer(data, np.dtype([("offset", "<i4"), ("stamp", "<i4"), ("number", "<i4"), ("span", "<i2"), ("unknown", "<i2")]), offset=HEADER)


def index_faults(entries: np.ndarray, ends: np.ndarray, size: int, header: Header, first: int, last: int) -> dict[str, np.ndarray]:
    """By fault, a mark for each entry: it contradicts its data file of ``size`` bytes, its segment's stamps from ``first`` to
    ``last``, or the entry before it."""
    offset, stamp, number, span = (entries[c].astype(np.int64) for c in ("offset", "stamp", "number", "span"))
    least, most = packet_byte_bounds(span, header.n_channels, header.n_channels - sum(header.shorted))
    later = np.arange(len(entries)) > 0
    before = lambda x: np.append(x[:1], x[:-1])
    return {
        "span": span < 1,
        "offset": (offset < ERD_HEADER) | (offset >= size),
        "lead": ~later & (offset != ERD_HEADER),
        "order": later & (offset <= before(offset)),
        "overlap": later & (stamp < before(stamp) + before(span)),
        "number": later & (number != before(number) + before(span)),
        "segment": (stamp < first) | (stamp + span - 1 > last),
        "bytes": (ends - offset < least) | (ends - offset > most),
    }


def parse_anchors(data: bytes) -> list[tuple[int, int]]:
    """(stamp, 100 ns ticks since 1601)"""
    if data[:16] != SNC_GUID:
        raise DataIntegrityError("the clock file's identifier is wrong")
    check_schema(data, "snc")
    if (len(data) - HEADER) % SNC_ENTRY or len(data) == HEADER:
        raise DataIntegrityError("the clock file holds no whole anchors")
    return list(struct.iter_unpack("<iQ", data[HEADER:]))


def packet_byte_bounds(span: int, channels: int, active: int) -> tuple[int, int]:
    """The fewest and most bytes that a packet can have. Column expressions work as arguments, too."""
    mask = (channels + 7) // 8
    first, least = 1 + mask + 6 * active, 1 + mask + active
    return first + (span - 1) * least, span * first


def build_header(kind: str, size: int = HEADER) -> bytearray:
    data = bytearray(size)
    struct.pack_into("<HH", data, 16, *SCHEMAS[kind])
    return data
