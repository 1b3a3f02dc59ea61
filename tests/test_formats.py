"""Packets, layouts, notes, exact numbers and signals: round trips and refusals, without Spark."""

import math
import struct
from fractions import Fraction

import numpy as np
import pytest

from sparkwave.errors import DataIntegrityError, ResourceLimitError, UnsupportedFormatError
from sparkwave.functions import clock, exact, notes, signal
from sparkwave.limits import ReadLimits, check_output, index
from sparkwave.plans.edf import Grid
from sparkwave.sources import layout, synth
from sparkwave.sources.packets import decode, encode


def test_random_packets_come_back():
    rng = np.random.default_rng(20260905)
    for _ in range(60):
        channels, span = int(rng.integers(1, 40)), int(rng.integers(1, 30))
        shorted = rng.random(channels) < 0.2
        steps = rng.choice([-32768, -300, -128, -1, 0, 1, 127, 128, 32767, 100_000], (span, int((~shorted).sum())))
        values = np.cumsum(steps, axis=0)
        data = encode(values, shorted)
        assert (decode(data, span, shorted) == values).all()
        assert (decode(data, span, shorted, span // 2) == values[: span // 2]).all()
        if values.size:
            least, most = layout.packet_byte_bounds(span, channels, values.shape[1])
            assert least <= len(data) <= most


@pytest.mark.parametrize(("change", "words"), [(lambda d: d[:-1], "ends inside"), (lambda d: d + b"\0", "after its last"), (lambda d: b"\2" + d[1:], "event byte")])
def test_broken_packets_are_refused(change, words):
    shorted = np.zeros(3, dtype=bool)
    data = encode(np.arange(12).reshape(4, 3), shorted)
    with pytest.raises(DataIntegrityError, match=words):
        decode(change(data), 4, shorted)


def test_a_narrow_minus_one_is_a_delta_and_a_wide_one_is_not():
    shorted = np.zeros(1, dtype=bool)
    first = b"\0\1" + b"\xff\xff" + struct.pack("<i", 100)
    assert decode(first + b"\0\0\xff", 2, shorted).ravel().tolist() == [100, 99]
    assert decode(first + b"\0\1\xff\xff" + struct.pack("<i", -7), 2, shorted).ravel().tolist() == [100, -7]
    with pytest.raises(DataIntegrityError, match="isn't absolute"):
        decode(b"\0\0\5", 1, shorted)


def test_header_round_trip_and_faults():
    shorted = np.arange(276) == 251
    header = layout.parse_header(synth.header_bytes(276, 512.0, shorted))
    assert header.sample_rate == 512.0 and header.shorted[251] and not layout.layout_faults(header)
    assert layout.layout_faults(layout.parse_header(synth.header_bytes(4, 512.0, shorted[:4])))
    assert layout.layout_faults(layout.parse_header(synth.header_bytes(276, 512.0, shorted, headbox=19)))
    for rate in (0.0, -1.0, math.nan, math.inf):
        with pytest.raises(DataIntegrityError):
            layout.parse_header(synth.header_bytes(4, rate, shorted[:4]))
    with pytest.raises(DataIntegrityError):
        layout.parse_header(b"\0" * 100)
    with pytest.raises(UnsupportedFormatError):
        layout.parse_header(b"\0" * layout.ERD_HEADER)


@pytest.mark.parametrize("name", ["", ".", "..", "a/b", "a\\b", "con", "COM1.txt", "a:b", "x.", "y ", "a\nb"])
def test_unsafe_names(name):
    assert not layout.safe_name(name)


def test_segment_faults():
    ok = [("a", 10, 19, 0, 10), ("b", 20, 29, 10, 5)]
    assert layout.parse_segments(synth.table_bytes(ok)) == ok and not layout.segment_faults(ok)
    for bad in ([], [("a", 10, 9, 0, 0)], [("a", 10, 19, 0, 11)], [("a", 10, 19, 0, 1), ("A", 20, 29, 1, 1)], [("a", 10, 19, 0, 1), ("b", 19, 29, 1, 1)]):
        assert layout.segment_faults(bad)


def test_literals():
    limits = ReadLimits()
    for value in ({"Stamp": 5, "Text": "a \"b\" \\ \n", "Data": {"User": "u"}}, [1, -2.5, True, None, "x"], {"a": [{"b": []}]}):
        assert notes.parse(notes.write_literal(value), limits) == value
    for bad in ("(1 2)", "(,1)", "(1,,2)", "__import__('os')", "(1", ".(1, 2)"):
        assert notes.value_json(bad, limits) is None
    with pytest.raises(ResourceLimitError):
        notes.value_json("(" * 100 + ")" * 100, limits)


def test_exact_numbers():
    assert exact.decimal(Fraction(-5, 4)) == "-1.25" and exact.decimal(Fraction(3)) == "3"
    with pytest.raises(UnsupportedFormatError):
        exact.decimal(Fraction(1, 3))
    assert [exact.short_number(Fraction(*f)) for f in ((1, 8), (3, 1), (1234567, 10**7), (10**12, 1), (12345, 10**9))] == [".125", "3", ".1234567", "1E12", "12345E-9"]
    with pytest.raises(UnsupportedFormatError):
        exact.short_number(Fraction(123456789, 10**8))
    assert [exact.to_datetime(t, "UTC").microsecond for t in (5, 15, 25)] == [0, 2, 2]
    assert exact.to_datetime(0).utcoffset().total_seconds() == 8 * 3600


def test_clock_of_one_sample():
    base = 116_444_736_000_000_000
    anchors = [(102, base), (108, base + 30_000_001), (120, base + 90_000_003)]
    at = lambda s, **k: clock.at_sample(s, anchors, 100, 21, 2.0, **k)
    assert at(2) == (base, "anchor") and at(5) == (base + Fraction(30_000_001, 2), "interpolated")
    assert at(0, extrapolation="nominal") == (base - 10_000_000, "extrapolated_nominal")
    with pytest.raises(ValueError):
        at(0)
    with pytest.raises(ValueError):
        at(0, extrapolation="nominal", max_seconds=0.5)
    with pytest.raises(IndexError):
        at(22)


def test_calibration_and_labels():
    c = signal.signal_of(0, False, -0.25, -10, 1000, 0.5)
    assert c.span[0] <= -250 and c.span[1] >= 2.5 and c.physical == ("-250", "3")
    assert signal.limit_text(-123456789.5, "ROUND_FLOOR") == "-12346E4" and signal.limit_text(0.2, "ROUND_CEILING") == "1"
    with pytest.raises(UnsupportedFormatError):
        signal.signal_of(0, False, 1.0, -10_000_000, 10_000_000, 0.5)
    with pytest.raises(UnsupportedFormatError):
        signal.signal_of(273, False, None, 1, 1, 0.5)
    for kind, values in ((c, np.arange(-10, 1001)), (signal.signal_of(256, False, None, -7, 900, 0.5), np.arange(-7, 901))):
        assert signal.errors_of(signal.codes_of(values, kind), values, kind).max() <= kind.half_step * (1 + 1e-9)
    with pytest.raises(DataIntegrityError):
        signal.codes_of(np.array([10**6]), c)
    assert signal.labels(["A", "A", "", "EDF Annotations", "B"])[4] == "B" and len(set(signal.labels(["A", "A", "", "x" * 20]))) == 4
    assert signal.escaped("a\\b\n") == "a\\\\b\\u000a"


def test_grid():
    grid = Grid(16, ((0, 32), (544, 576)))
    assert [grid.start_of(i) for i in range(4)] == [0, 16, 544, 560]
    assert [grid.record_of(s) for s in (-5, 0, 31, 40, 544, 9999)] == [0, 0, 1, 2, 2, 3]


def test_budgets():
    with pytest.raises(ValueError):
        ReadLimits(max_segments=0)
    with pytest.raises(ResourceLimitError):
        check_output(10, 100, ReadLimits(max_read_bytes=7999))
    with pytest.raises(TypeError):
        index(True, "x")
    assert index(np.int32(5), "x") == 5
