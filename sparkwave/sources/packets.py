"""Delta packets: decoding and encoding of one packet with numpy."""

from __future__ import annotations

import numpy as np

from ..errors import DataIntegrityError

_SENTINEL = -1
_LARGEST = 1 << 62


def decode(data: bytes, span: int, shorted: np.ndarray, stop: int | None = None) -> np.ndarray:
    """Counts (samples, channels that aren't shorted) of a packet's samples before ``stop``."""
    return decode_run([data], [span], shorted, [span if stop is None else stop])[0]


def decode_run(packets: list[bytes], spans: list[int], shorted: np.ndarray, stops: list[int]) -> list[np.ndarray]:
    """The same for several packets, sample i of all of them at a time.

    A sample is an event byte, a mask with a bit per channel, a delta per active channel (16 bits if its mask bit is set)
    and a 32-bit value for each delta that is the sentinel. Sums of deltas run until the next such value. Samples differ in
    length, so those of a packet can only be taken one by one, but packets are independent.
    """
    raw = np.frombuffer(b"".join(packets), dtype=np.uint8)
    ends = np.cumsum([len(p) for p in packets])
    at = ends - [len(p) for p in packets]
    active, stop = np.flatnonzero(~shorted), np.array(stops)
    n, mask_bytes = len(active), (len(shorted) + 7) // 8
    out = [np.zeros((k, n), dtype=np.int64) for k in stops]
    state = np.zeros((len(packets), n), dtype=np.int64)
    for i in range(max(stops, default=0)):
        own = np.flatnonzero(stop > i)
        here, room = at[own], ends[own]

        def refuse(wrong: np.ndarray, what: str) -> None:
            if wrong.any():
                raise DataIntegrityError(what)

        refuse(here + 1 + mask_bytes + n > room, f"the packet ends inside sample {i}")
        refuse(raw[here] > 1, f"sample {i} has the event byte {int(raw[here].max())}")
        masks = raw[here[:, None] + 1 + np.arange(mask_bytes)]
        wide = np.unpackbits(masks, axis=1, bitorder="little")[:, active].astype(bool)
        last = np.cumsum(1 + wide, axis=1) + (here + mask_bytes)[:, None]  # the last byte of each delta
        after = last[:, -1] + 1 if n else here + 1 + mask_bytes
        refuse(after > room, f"the packet ends inside sample {i}")
        delta = raw[last].view(np.int8).astype(np.int64)
        delta[wide] = delta[wide] * 256 + raw[last[wide] - 1]
        anew = wide & (delta == _SENTINEL)
        many = anew.sum(axis=1)
        if i == 0:
            refuse(many < n, "the first sample of a packet isn't absolute")
        refuse(after + 4 * many > room, f"the packet ends inside sample {i}")
        delta[anew] = 0
        values = state[own] + delta
        if many.any():
            first = (after[:, None] + 4 * (np.cumsum(anew, axis=1) - 1))[anew]
            values[anew] = np.ascontiguousarray(raw[first[:, None] + np.arange(4)]).view("<i4").ravel()
        state[own], at[own] = values, after + 4 * many
        for row, k in zip(values, own.tolist(), strict=True):
            out[k][i] = row
    if ((stop == np.array(spans)) & (at != ends)).any():
        raise DataIntegrityError("the packet has bytes after its last sample")
    if any(np.abs(o).max(initial=0) > _LARGEST for o in out):
        raise DataIntegrityError("a sum of deltas leaves the range of 64 bits")
    return out


def encode(values: np.ndarray, shorted: np.ndarray, event: int = 0) -> bytes:
    """The packet of ``values`` (samples, active channels); the shortest form of each delta is taken.

    All bytes that samples could need are laid out as rows, and those that are needed are kept.
    """
    values, active = values.astype(np.int64), np.flatnonzero(~shorted)
    n, mask_bytes = len(values), (len(shorted) + 7) // 8
    delta = np.diff(values, axis=0, prepend=values[:1])
    wide = (delta < -128) | (delta > 127)
    anew = (delta < -32768) | (delta > 32767)
    wide[:1] = anew[:1] = True
    bits = np.zeros((n, mask_bytes * 8), dtype=bool)
    bits[:, active] = wide
    fields = np.where(anew, 0xFFFF, delta & 0xFFFF).astype("<u2")
    rows = [np.full((n, 1), event, dtype=np.uint8), np.packbits(bits, axis=1, bitorder="little"), fields.view(np.uint8), values.astype("<i4").view(np.uint8)]
    second = np.stack([np.ones_like(wide), wide], axis=2).reshape(n, -1)
    kept = [np.ones((n, 1 + mask_bytes), dtype=bool), second, np.repeat(anew, 4, axis=1)]
    return np.concatenate(rows, axis=1)[np.concatenate(kept, axis=1)].tobytes()
