"""Budgets that are checked before anything is read or allocated."""

from __future__ import annotations

from dataclasses import dataclass, fields

from .errors import ResourceLimitError

KIB, MIB = 1 << 10, 1 << 20


@dataclass(frozen=True)
class ReadLimits:
    """By subject: what a dense read may return, what the files of a recording may hold, and what notes may cost to parse.

    Distributed reads (``blocks``, ``samples``, ``ranges``) return DataFrames; how many values they may decode is estimated
    from the segment table before any task starts, and their tasks are bound by ``max_packet_bytes``.
    """

    # names and defaults are fixed values, but for max_scan_values

    # a dense read
    max_read_samples: int = 131_072
    max_read_bytes: int = 64 * MIB
    max_selected_channels: int = 1024
    # a distributed read
    max_scan_values: int = 1 << 42
    # files
    max_directory_entries: int = 20_000
    max_metadata_bytes: int = 8 * MIB
    max_segments: int = 10_000
    max_packets_per_segment: int = 20_000
    max_packet_bytes: int = 8 * MIB
    max_clock_anchors: int = 10_000
    # notes
    max_ent_bytes: int = 8 * MIB
    max_ent_records: int = 4096
    max_ent_record_bytes: int = 256 * KIB
    max_parse_depth: int = 32  # 128 at most, as nesting is kept on a stack in each task
    max_parse_nodes: int = 20_000
    max_total_parse_nodes: int = 200_000

    def __post_init__(self) -> None:
        wrong = [name for name, value in self.items() if type(value) is not int or value <= 0]
        if wrong or self.max_parse_depth > 128:
            raise ValueError(f"budgets are positive integers, max_parse_depth 128 at most: {', '.join(wrong) or 'max_parse_depth'}")

    def items(self) -> list[tuple[str, int]]:
        return [(f.name, getattr(self, f.name)) for f in fields(self)]


def check(amount: int, most: int, what: str) -> None:
    if amount > most:
        raise ResourceLimitError(f"{what}: {amount} exceeds the budget of {most}")


def check_output(channels: int, samples: int, limits: ReadLimits) -> None:
    """Of a dense read of float64 values."""
    wanted = {"selected channels": (channels, limits.max_selected_channels), "samples": (samples, limits.max_read_samples), "output bytes": (8 * channels * samples, limits.max_read_bytes)}
    for what, (amount, most) in wanted.items():
        check(amount, most, what)


def index(value: object, what: str) -> int:
    """An integer argument; booleans are refused, numpy integers are fine."""
    if isinstance(value, bool) or not hasattr(value, "__index__"):
        raise TypeError(f"{what} must be an integer")
    return value.__index__()
