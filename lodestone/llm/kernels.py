"""Vectorised byte and word kernels used inside Arrow stages.

Text is handled as UTF-8 bytes in numpy arrays, a few hundred kilobytes of whole
documents at a time, so that a worker's memory is bounded by its longest document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
MASK = (1 << 64) - 1
#: Whole documents are taken together until they hold so many bytes.
CHUNK = 1 << 19


def splitmix(n: int, seed: int) -> np.ndarray:
    """n pseudo-random 64-bit values fixed by the seed."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


BYTE_VALUES = splitmix(256, 12345)
#: A random value for each byte at each of the first places of a word or string.
PLACES = 64
SPOTS = tuple(splitmix(PLACES * 256, seed) for seed in (4711, 8086))
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Powers:
    """Powers of an odd base and of its inverse, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, U)

    def grow(self, n: int) -> None:
        if len(self.up) < n:
            size = 1 << max(16, (n - 1).bit_length())
            for name, b in (("up", self.base), ("down", self.inverse)):
                p = np.full(size, b, U)
                p[0] = 1
                setattr(self, name, np.cumprod(p))

    def prefix(self, values: np.ndarray) -> np.ndarray:
        self.grow(len(values) + 1)
        out = np.zeros(len(values) + 1, U)
        np.cumsum(values * self.up[: len(values)], out=out[1:])
        return out

    def between(self, prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of values[start:end], which doesn't depend on where it stands."""
        return (prefix[ends] - prefix[starts]) * self.down[starts]

    def windows(self, values: np.ndarray, width: int) -> np.ndarray:
        """Hash of every run of so many values; none if there are fewer."""
        n = len(values) - width + 1
        if n <= 0:
            return np.zeros(0, U)
        p = self.prefix(values)
        return mix((p[width:] - p[:n]) * self.down[:n])


POLY_A, POLY_B = Powers(0x9E3779B97F4A7C15), Powers(0xD1342543DE82EF95)


def spot_hashes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, both: bool = False) -> tuple[np.ndarray, ...]:
    """Hash of each string data[start:start + length], or two independent ones.

    Every pair of byte and place has a random value of its own and a hash is the sum of these,
    so no pattern of repeated bytes makes different strings collide, as polynomials modulo a
    power of two allow.
    """
    starts, lengths = np.asarray(starts, np.int64), np.asarray(lengths, np.int64)
    out = tuple(np.zeros(len(lengths), U) for _ in range(2 if both else 1))
    full = np.flatnonzero(lengths > 0)
    bounds = np.concatenate(([0], np.cumsum(lengths[full])))
    for a, b in chunks(bounds, 1 << 17):  # a few hundred kilobytes stay in the cache
        own = full[a:b]
        size, first = lengths[own], bounds[a:b] - bounds[a]
        place = np.arange(int(bounds[b] - bounds[a])) - np.repeat(first, size)
        byte = data[place + np.repeat(starts[own], size)]
        far = np.flatnonzero(place >= PLACES)
        spot = np.minimum(place, PLACES - 1) * 256 + byte
        for h, table, salt in zip(out, SPOTS, (0x9E6C63D0876A9A63, 0xB5AD4ECEDA1CE2A9), strict=False):
            value = table[spot]
            if len(far):
                with np.errstate(over="ignore"):
                    value[far] = mix(BYTE_VALUES[byte[far]] ^ (place[far].astype(U) * U(salt)))
            h[own] = np.add.reduceat(value, first)
    return tuple(mix(h + lengths.astype(U)) for h in out)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows after one another, and len + 1 offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges of whole documents of about so many bytes, one row at least."""
    n, at = len(offsets) - 1, 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + size, "left"))
        end = min(n, max(end, at + 1))
        yield at, end
        at = end


class Words:
    """Words `[^\\x20\\x09-\\x0D]+` of some documents: hashes, byte bounds, row bounds."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        full = ~IS_SPACE[data]
        start = full.copy()
        end = full.copy()
        if len(data):
            start[1:] &= ~full[:-1]
            end[:-1] &= ~full[1:]
            inner = offsets[(offsets > 0) & (offsets < len(data))]
            start[inner] = full[inner]
            end[inner - 1] = full[inner - 1]
        self.starts, self.ends = np.flatnonzero(start), np.flatnonzero(end) + 1
        self.rows = np.searchsorted(self.starts, offsets)

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self) -> np.ndarray:
        return spot_hashes(self.data, self.starts, self.ends - self.starts)[0]

    def both_hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """Two independent hashes of each word."""
        return spot_hashes(self.data, self.starts, self.ends - self.starts, True)

    def row_of(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.rows) - 1), np.diff(self.rows))


def inside(rows: np.ndarray, width: int, total: int) -> np.ndarray:
    """Which of the total - width + 1 windows lie within one row."""
    n = max(0, total - width + 1)
    ok = np.ones(n, bool)
    if width > 1 and n:
        cut = np.zeros(total + 1, np.int32)
        np.add.at(cut, rows[1:-1], 1)
        c = np.cumsum(cut)
        ok = c[width - 1 : width - 1 + n] == c[:n]
    return ok


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of every run of so many values."""
    have, out = 1, x
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def sliding_max(x: np.ndarray, width: int) -> np.ndarray:
    have, out = 1, x
    while have < width:
        step = min(have, width - have)
        out = np.maximum(out[:-step], out[step:])
        have += step
    return out


def runs_of(values: np.ndarray, ok: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of ok places of one row with one value."""
    if not len(values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (row[1:] != row[:-1]) | ~ok[:-1]
    new &= ok
    starts = np.flatnonzero(new)
    last = np.ones(len(values), bool)
    last[:-1] = new[1:] | ~ok[1:]
    last &= ok
    return starts, np.flatnonzero(last) + 1


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each range, after one another."""
    lengths = np.asarray(lengths, np.int64)
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.repeat(np.asarray(starts, np.int64) - before, lengths) + np.arange(total, dtype=np.int64)


def covered(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in some [start, end)."""
    change = np.bincount(starts, minlength=n + 1)[: n + 1] - np.bincount(ends, minlength=n + 1)[: n + 1]
    return np.cumsum(change[:-1]) > 0


def binaries(data: np.ndarray, counts: np.ndarray) -> pa.Array:
    """A binary column whose rows hold so many items of `data` each, without a loop."""
    offsets = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts * data.dtype.itemsize, out=offsets[1:])
    column = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))]
    )
    return column.cast(pa.binary())


def by_group(group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First index and length of each run of equal values."""
    if not len(group):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    return first, np.diff(np.append(first, len(group)))


CODECS = {level: pa.Codec("zstd", level) for level in (1, 3)}


def pack(level: int = 1, /, **arrays: np.ndarray) -> bytes:
    """Named arrays as one compressed value; unpack() gives them back.

    Bytes of equal weight stand together, so that high bytes of small numbers vanish.
    """
    head, body = [], []
    for name, a in arrays.items():
        a = np.ascontiguousarray(a)
        head.append(f"{name}:{a.dtype.str}:{a.nbytes}")
        planes = a.view(np.uint8).reshape(len(a), -1).T if a.itemsize > 1 and len(a) else a
        body.append(np.ascontiguousarray(planes).tobytes())
    text = ",".join(head).encode()
    raw = len(text).to_bytes(4, "little") + text + b"".join(body)
    return len(raw).to_bytes(8, "little") + CODECS[level].compress(raw, asbytes=True)


def unpack(blob: bytes) -> dict[str, np.ndarray]:
    raw = CODECS[1].decompress(blob[8:], int.from_bytes(blob[:8], "little"), asbytes=True)
    size = int.from_bytes(raw[:4], "little")
    out, at = {}, 4 + size
    for part in raw[4:at].decode().split(","):
        name, kind, n = part.split(":")
        kind, n = np.dtype(kind), int(n)
        x = np.frombuffer(raw, np.uint8, n, at)
        if kind.itemsize > 1 and n:
            x = np.ascontiguousarray(x.reshape(kind.itemsize, -1).T).view(kind).reshape(-1)
        else:
            x = x.view(kind)
        out[name] = x
        at += n
    return out


def least_between(x: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The least of x[start:end] for each range; none may be empty."""
    if not len(starts):
        return x[:0]
    at = np.stack([starts, ends], 1).reshape(-1)
    return np.minimum.reduceat(np.append(x, x[-1:]), at)[::2]


def whole_groups(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.Table]:
    """Tables of whole groups from rows that come sorted by the named columns."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy() for c in names], 1)
        differs = np.flatnonzero((keys[1:] != keys[:-1]).any(1))
        cut = int(differs[-1]) + 1 if len(differs) else 0
        if held and (cut or (keys[0] != last).any()):
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        elif cut:
            yield pa.Table.from_batches([batch.slice(0, cut)])
        held.append(batch.slice(cut))
        last = keys[-1]
    if held:
        yield pa.Table.from_batches(held)
