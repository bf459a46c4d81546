"""Progressive JPEG in numpy: restart intervals of many images are the lanes that are coded and decoded side by side.

The decoder takes 8-bit progressive streams (SOF2) of one or three components with any scan script: DC and AC scans,
spectral bands, successive approximation, runs of empty bands, with or without restart markers. Scans accumulate into
coefficient arrays; :func:`to_rgb` transforms those, replicates the chroma and returns full-resolution tensors. The
encoder writes 4:2:0 images whose quantised coefficients carry given bytes, so that they come back exactly.
"""

from __future__ import annotations

import functools
import heapq
import struct
from dataclasses import dataclass, field

import numpy as np

RESTART, DC_RESTART, COLUMNS = 4, 4, 16
# Fixed value: bytes that are frequent in Latin text, most frequent first.
FREQUENT = b" etnarisodhlucmgbpfwvkyz.,\nqjxETNARISODHLUCMGBPFWVKYZQJX0123456789-!?:;'()"
#: A stored image holds at most so many bytes; longer payloads are several images, one after the other.
FRAME_BYTES = 3 << 20

# The scan script of the encoder (components, first and last place of the band, bits already there, bits still to come).
SCRIPT = (
    ((0, 1, 2), 0, 0, 0, 1), ((0,), 1, 5, 0, 1), ((2,), 1, 63, 0, 1), ((1,), 1, 63, 0, 1), ((0,), 6, 63, 0, 1),
    ((0, 1, 2), 0, 0, 1, 0), ((0,), 1, 63, 1, 0), ((1,), 1, 63, 1, 0), ((2,), 1, 63, 1, 0),
)


def _coefficients() -> np.ndarray:
    """The coefficient of each byte: 0, -1, 1, -2, 2 and so on over FREQUENT and then all other bytes, up to -128 and 127."""
    rank = np.argsort(np.array([*FREQUENT, *(b for b in range(256) if b not in FREQUENT)]))
    return np.where(rank % 2, -(rank + 1) // 2, rank // 2).astype(np.int16)


TO_COEFFICIENT = _coefficients()
TO_BYTE = np.argsort(TO_COEFFICIENT).astype(np.uint8)  # at coefficient + 128


def _zigzag() -> np.ndarray:
    """Row-major places of an 8 x 8 block in zigzag order."""
    return np.array(sorted(range(64), key=lambda p: (p // 8 + p % 8, p // 8 if (p // 8 + p % 8) % 2 else p % 8)))


ZIGZAG = _zigzag()
QUANT = np.array([8] + [1] * 63)  # in zigzag order


def _cosines() -> np.ndarray:
    """The 8 x 8 inverse transform from zigzag places to pixels."""
    x = np.arange(8)
    basis = np.cos((2 * x[None, :] + 1) * x[:, None] * np.pi / 16) / 2
    basis[0] /= np.sqrt(2)
    return np.einsum("ux,vy->uvxy", basis, basis).reshape(64, 64)[ZIGZAG].astype(np.float32)


INVERSE = _cosines()


# ---- Huffman tables


def huffman(weights: dict[int, float]) -> tuple[list[int], list[int]]:
    """(number of codes of each length 1 to 16, symbols in code order). One code of all ones stays unused."""
    heap = [(w, k, [s]) for k, (s, w) in enumerate(sorted(weights.items()))]
    heap.append((min(weights.values()) / 2, len(heap), [-1]))
    heapq.heapify(heap)
    depth, k = dict.fromkeys([*weights, -1], 0), len(heap)
    while len(heap) > 1:
        (a, _, x), (b, _, y) = heapq.heappop(heap), heapq.heappop(heap)
        for s in x + y:
            depth[s] += 1
        heapq.heappush(heap, (a + b, k, x + y))
        k += 1
    if max(depth.values()) > 16:
        return huffman({s: w + sum(weights.values()) / 20000 for s, w in weights.items()})
    longest = max(depth.values())
    depth[-1] = longest  # the unused code is the last of the longest
    counts = [sum(d == n for s, d in depth.items() if s >= 0) for n in range(1, 17)]
    return counts, sorted((s for s in weights), key=lambda s: (depth[s], s))


@functools.lru_cache(maxsize=256)
def _codes(counts: tuple[int, ...], symbols: tuple[int, ...]) -> list[tuple[int, int, int]]:
    """(symbol, code, length)."""
    out, code, k = [], 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out.append((symbols[k], code, length))
            code, k = code + 1, k + 1
        code <<= 1
    return out


@functools.lru_cache(maxsize=256)
def _lookup(counts: tuple[int, ...], symbols: tuple[int, ...]) -> np.ndarray:
    """For each 16 bits ahead: length, run << 5, size << 9."""
    table = np.full(1 << 16, 16, np.int32)
    for symbol, code, length in _codes(counts, symbols):
        first = code << (16 - length)
        table[first : first + (1 << (16 - length))] = length | (symbol >> 4) << 5 | (symbol & 15) << 9
    return table


def _own_tables() -> dict[tuple[int, int], tuple[tuple[int, ...], tuple[int, ...]]]:
    """The encoder's tables by (class, number): DC, AC first, AC refinement. Weights by rule: sizes as letters have them, runs that fall off by a constant factor."""
    size = {1: 40, 2: 40, 3: 14, 4: 3, 5: 2, 6: 1, 7: 0.2}
    first = {r << 4 | s: w * 0.35**r + 1e-4 for r in range(16) for s, w in size.items()}
    first |= {0xF0: 1e-4, 0x00: 1, 0x10: 0.01, 0x20: 0.01}
    refine = {r << 4 | 1: 10 * 0.45**r + 1e-4 for r in range(16)} | {0xF0: 1e-4, 0x00: 1, 0x10: 0.01, 0x20: 0.01}
    found = {(0, 0): huffman({s: 2.0 ** -abs(s - 2) for s in range(9)}), (1, 0): huffman(first), (1, 1): huffman(refine)}
    return {k: (tuple(a), tuple(b)) for k, (a, b) in found.items()}


OWN_TABLES = _own_tables()


def _encoder_table(kind: int, number: int) -> tuple[np.ndarray, np.ndarray]:
    code, length = np.zeros(256, np.int64), np.zeros(256, np.int64)
    for s, c, n in _codes(*OWN_TABLES[kind, number]):
        code[s], length[s] = c, n
    return code, length


# ---- Encoder

_SIZE = np.array([int(v).bit_length() for v in range(2049)])


def _pack(codes: np.ndarray, lengths: np.ndarray, owners: np.ndarray, n_owners: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the codes, each owner's (in order) filled up to a whole byte with ones; and where each owner's bytes end."""
    ends = np.cumsum(lengths)
    bits = np.bincount(owners, lengths, n_owners).astype(np.int64)
    sizes = (bits + 7) >> 3
    stops = np.cumsum(sizes)
    at = ends - lengths + ((stops - sizes) * 8 - (np.cumsum(bits) - bits))[owners]
    word, shift = at >> 5, at & 31
    wide = codes.astype(np.uint64) << (64 - shift - lengths).astype(np.uint64)
    firsts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]]) if len(word) else np.zeros(0, np.int64)
    out = np.zeros((int(stops[-1]) >> 2) + 3 if len(stops) else 1, np.uint64)
    out[word[firsts]] += np.add.reduceat(wide >> np.uint64(32), firsts)
    out[word[firsts] + 1] += np.add.reduceat(wide & np.uint64(0xFFFFFFFF), firsts)
    data = out.astype(">u4").view(np.uint8)[: int(stops[-1])].copy()
    data[stops - 1] |= ((1 << (sizes * 8 - bits)) - 1).astype(np.uint8)
    return data, stops


def _stuffed(data: np.ndarray, stops: np.ndarray, number: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes with a zero after each 255, and a restart marker (by the interval's number) after each interval that is not its image's last; where each image's bytes end."""
    full = data == 255
    more = full.astype(np.int64)
    more[stops[~last] - 1] += 2
    ends = np.cumsum(more) + np.arange(1, len(data) + 1)
    out = np.zeros(int(ends[-1]), np.uint8)
    out[ends - more - 1] = data
    marks = ends[stops[~last] - 1]
    out[marks - 2], out[marks - 1] = 255, 0xD0 + number[~last] % 8
    return out, ends[stops[last] - 1]


def _intervals(sizes: np.ndarray, restart: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For images of so many units: the interval of each unit, each interval's number in its image, and whether it is its image's last."""
    per = -(-sizes // restart)
    number = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
    count = np.minimum(restart, np.repeat(sizes, per) - number * restart)
    return np.repeat(np.arange(len(number)), count), number, number == np.repeat(per, per) - 1


def _value_bits(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = _SIZE[np.abs(v)]
    return np.where(v < 0, v + (1 << size) - 1, v), size


def _encode_dc(values: np.ndarray, components: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes and lengths of DC values in scan order; the prediction starts anew in each interval (unit)."""
    codes, lengths = _encoder_table(0, 0)
    difference = values.copy()
    for c in range(3):
        mine = np.flatnonzero(components == c)
        v, same = values[mine], np.r_[False, unit[mine][1:] == unit[mine][:-1]]
        difference[mine] = v - np.where(same, np.r_[0, v[:-1]], 0)
    bits, size = _value_bits(difference)
    return codes[size] << size | bits, lengths[size] + size


def _merge(events: tuple[np.ndarray, ...], ends: tuple[np.ndarray, ...]) -> list[np.ndarray]:
    """Two lists of columns, both sorted by their first column, as one list; at ties the events come first."""
    place = np.arange(len(ends[0])) + np.searchsorted(events[0], ends[0], side="right")
    mask = np.ones(len(events[0]) + len(ends[0]), bool)
    mask[place] = False
    out = []
    for a, b in zip(events, ends, strict=True):
        column = np.empty(len(mask), np.int64)
        column[mask], column[place] = a, b
        out.append(column)
    return out


def _band_ends(open_end: np.ndarray, empty: np.ndarray, unit: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(block, code, length) of the ends of bands; an empty band joins the run of the block before it in its interval."""
    joined = empty & np.r_[False, (unit[1:] == unit[:-1]) & open_end[:-1]]
    heads = np.flatnonzero(~joined)
    runs = np.diff(np.r_[heads, len(joined)])
    heads, runs = heads[open_end[heads]], runs[open_end[heads]]
    extra = _SIZE[runs] - 1
    return heads, codes[extra << 4] << extra | (runs - (1 << extra)), lengths[extra << 4] + extra


def _split_runs(at: np.ndarray, run: np.ndarray, codes: np.ndarray, lengths: np.ndarray, code: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Puts a code for 16 zeros before an event for each 16 zeros of its run."""
    times = run >> 4
    if not times.any():
        return at, code, length
    pick = np.repeat(np.arange(len(at)), times + 1)
    final = np.r_[pick[1:] != pick[:-1], True]
    return at[pick], np.where(final, code[pick], codes[0xF0]), np.where(final, length[pick], lengths[0xF0])


def _encode_ac(values: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Block, code and length of each token of a band's first scan."""
    codes, lengths = _encoder_table(1, 0)
    band = values.shape[1]
    at = np.flatnonzero(values)
    block, place, v = at // band, at % band, values.ravel()[at].astype(np.int64)
    run = place - np.where(np.r_[False, block[1:] == block[:-1]], np.r_[0, place[:-1]], -1) - 1
    bits, size = _value_bits(v)
    symbol = (run & 15) << 4 | size
    at, code, length = _split_runs(block, run, codes, lengths, codes[symbol] << size | bits, lengths[symbol] + size)
    ends = _band_ends(values[:, -1] == 0, ~values.any(1), unit, codes, lengths)
    return tuple(_merge((at, code, length), ends))


def _encode_refinement(values: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for a refinement by the last bit: values are whole, magnitudes above 1 are known already."""
    codes, lengths = _encoder_table(1, 1)
    blocks, band = values.shape
    size = np.abs(values)
    old, new = size > 1, (size == 1).ravel()
    zero_rank = np.cumsum(~old, axis=1).ravel()  # zeros of the scans before, up to and with this place
    at = np.flatnonzero(new)
    block = at // band
    same = np.r_[False, block[1:] == block[:-1]]
    run = zero_rank[at] - np.where(same, np.r_[0, zero_rank[at][:-1]], 0) - 1
    # Each 16 zeros of a run have an event of their own, at the last of them.
    long = np.repeat(np.arange(len(at)), run >> 4)
    if len(long):
        step = np.arange(len(long)) - np.repeat(np.cumsum(run >> 4) - (run >> 4), run >> 4)
        zeros = np.flatnonzero(~old.ravel())
        per_block = (~old).sum(1)
        first = (np.cumsum(per_block) - per_block)[block[long]]
        skip_at = zeros[first + zero_rank[at[long]] - 1 - run[long] + 16 * step + 15]
    else:
        skip_at = np.zeros(0, np.int64)
    symbol = (run & 15) << 4 | 1
    sign = (values.ravel()[at] > 0).astype(np.int64)
    skips = (skip_at, np.full(len(skip_at), codes[0xF0]), np.full(len(skip_at), lengths[0xF0]))
    events = _merge((at, codes[symbol] << 1 | sign, lengths[symbol] + 1), skips) if len(skip_at) else [at, codes[symbol] << 1 | sign, lengths[symbol] + 1]
    if len(skip_at):
        order = np.argsort(events[0], kind="stable")
        events = [x[order] for x in events]
    last = np.full(blocks, -1)
    last[block] = at % band
    open_end = last < band - 1
    heads, code, length = _band_ends(open_end, open_end & ~old.any(1) & (last < 0), unit, codes, lengths)
    events = _merge(tuple(events), (heads * band + band - 1, code, length))
    # Corrections of known coefficients follow the first event at or after their place.
    known = np.flatnonzero(old)
    follow = np.searchsorted(events[0], known, side="left") if len(known) else known
    place = follow + 1 + np.arange(len(known))
    total = len(events[0]) + len(known)
    mask = np.ones(total, bool)
    mask[place] = False
    at, code, length = np.empty(total, np.int64), np.empty(total, np.int64), np.ones(total, np.int64)
    at[mask], code[mask], length[mask] = events[0], events[1], events[2]
    at[place], code[place] = known, size.ravel()[known] & 1
    return at // band, code, length


def grid(n_bytes: int) -> tuple[int, int]:
    """Rows and columns of 16 x 16 pixels that hold so many bytes."""
    units = max(1, -(-n_bytes // 384))
    columns = max(min(units, COLUMNS), -(-units // 4095))
    return -(-units // columns), columns


@functools.lru_cache(maxsize=1024)
def _scan_order(rows: int, columns: int, sampling: tuple[tuple[int, int], ...]) -> tuple[np.ndarray, np.ndarray]:
    """Component and block number (row-major in the component) of the blocks of an interleaved scan, in its order."""
    r, c = np.divmod(np.arange(rows * columns), columns)
    components, numbers = [], []
    for k, (h, v) in enumerate(sampling):
        for y in range(v):
            for x in range(h):
                components.append(np.full(rows * columns, k))
                numbers.append((r * v + y) * columns * h + c * h + x)
    return np.stack(components, 1).ravel(), np.stack(numbers, 1).ravel()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _tables() -> bytes:
    tables = b"".join(bytes([kind << 4 | number, *counts, *symbols]) for (kind, number), (counts, symbols) in OWN_TABLES.items())
    return _segment(0xDB, bytes([0, *QUANT])) + _segment(0xC4, tables)


_HEAD = _tables()


def encode(payloads: list[np.ndarray]) -> list[bytes]:
    """A progressive JPEG for each payload (uint8, at most FRAME_BYTES)."""
    grids = [grid(len(p)) for p in payloads]
    units = np.array([r * c for r, c in grids])
    coefficients = []
    for p, n in zip(payloads, units, strict=True):
        whole = np.zeros(n * 384, np.int16)
        whole[: len(p)] = TO_COEFFICIENT[p]
        coefficients.append(whole.reshape(-1, 64))
    parts = [np.concatenate(x) for x in zip(*((w[: 4 * n], w[4 * n : 5 * n], w[5 * n :]) for w, n in zip(coefficients, units, strict=True)), strict=True)]
    sampling = ((2, 2), (1, 1), (1, 1))
    orders = [_scan_order(r, c, sampling) for r, c in grids]
    which = np.concatenate([o[0] for o in orders])
    number = np.concatenate([o[1] + np.array([4 * b, b, b])[o[0]] for o, b in zip(orders, np.cumsum(units) - units, strict=True)])
    dc = np.empty(len(which), np.int64)
    for c in range(3):
        dc[which == c] = parts[c][number[which == c], 0]

    scans = []
    for components, first, last, high, low in SCRIPT:
        if first == 0:
            unit, numbers, final = _intervals(units, DC_RESTART)
            unit = np.repeat(unit, 6)
            code, length = (dc & 1, np.ones(len(dc), np.int64)) if high else _encode_dc(dc >> low, which, unit)
            owner = unit
        else:
            band = parts[components[0]][:, first : last + 1]
            unit, numbers, final = _intervals(units * (4 if components[0] == 0 else 1), RESTART)
            if high:
                block, code, length = _encode_refinement(band, unit)
            else:
                block, code, length = _encode_ac(np.sign(band) * (np.abs(band) >> low), unit)
            owner = unit[block]
        data, stops = _pack(code, length, owner, len(numbers))
        out, ends = _stuffed(data, stops, numbers, final)
        names = b"".join(bytes([c + 1, (high if first else 0)]) for c in components)
        head = _segment(0xDA, bytes([len(components)]) + names + bytes([first, last, high << 4 | low]))
        out, ends = out.tobytes(), ends.tolist()
        scans.append([head + out[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)])
    restart = _segment(0xDD, struct.pack(">H", RESTART))
    images = []
    for k, (p, (r, c)) in enumerate(zip(payloads, grids, strict=True)):
        frame = _segment(0xC2, struct.pack(">BHHB", 8, 16 * r, 16 * c, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0]))
        images.append(b"\xff\xd8" + _segment(0xFE, struct.pack(">I", len(p))) + _HEAD + frame + restart + b"".join(s[k] for s in scans) + b"\xff\xd9")
    return images


# ---- Decoder


@dataclass
class Image:
    height: int = 0
    width: int = 0
    ids: list[int] = field(default_factory=list)
    sampling: list[tuple[int, int]] = field(default_factory=list)
    quant: list[np.ndarray] = field(default_factory=list)
    comments: list[bytes] = field(default_factory=list)
    scans: list[tuple] = field(default_factory=list)
    coefficients: list[np.ndarray] = field(default_factory=list)

    @property
    def units(self) -> tuple[int, int]:
        h, v = (max(s[k] for s in self.sampling) for k in (0, 1))
        return -(-self.height // (8 * v)), -(-self.width // (8 * h))

    def blocks(self, c: int) -> tuple[int, int]:
        """Rows and columns of a component's blocks, filled up to whole units."""
        rows, columns = self.units
        return rows * self.sampling[c][1], columns * self.sampling[c][0]

    def own_blocks(self, c: int) -> tuple[int, int]:
        """Rows and columns that a scan of the component alone has."""
        h, v = (max(s[k] for s in self.sampling) for k in (0, 1))
        return -(-(-(-self.height * self.sampling[c][1] // v)) // 8), -(-(-(-self.width * self.sampling[c][0] // h)) // 8)


def _parse(data: bytes, offset: int, start: int, marks: np.ndarray) -> tuple[Image, int]:
    """The image that begins at ``start`` and where it ends. marks: places in the whole buffer, from ``offset`` on, of markers that end entropy-coded data."""
    if data[start : start + 2] != b"\xff\xd8":
        raise ValueError("no JPEG stream")
    image, at, quants, tables, restart = Image(), start + 2, {}, {}, 0
    while True:
        marker = data[at + 1]
        if data[at] != 0xFF:
            raise ValueError("a marker is missing")
        if marker == 0xFF:
            at += 1
            continue
        if marker == 0xD9:
            image.quant = [quants[q] for q in image.quant]
            return image, at + 2
        size = data[at + 2] << 8 | data[at + 3]
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xC2:
            precision, image.height, image.width, n = struct.unpack(">BHHB", body[:6])
            if precision != 8:
                raise ValueError("8-bit samples only")
            for k in range(n):
                name, hv, q = body[6 + 3 * k : 9 + 3 * k]
                image.ids.append(name)
                image.sampling.append((hv >> 4, hv & 15))
                image.quant.append(q)
        elif marker in (0xC0, 0xC1, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)):
            raise ValueError("not a progressive stream")
        elif marker == 0xC4:
            k = 0
            while k < len(body):
                counts = tuple(body[k + 1 : k + 17])
                n = sum(counts)
                tables[body[k]] = (counts, tuple(body[k + 17 : k + 17 + n]))
                k += 17 + n
        elif marker == 0xDB:
            k = 0
            while k < len(body):
                wide = body[k] >> 4
                quants[body[k] & 15] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, k + 1).astype(np.float32)
                k += 129 if wide else 65
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker == 0xFE:
            image.comments.append(body)
        elif marker == 0xDA:
            n = body[0]
            parts = [(image.ids.index(body[1 + 2 * k]), body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15) for k in range(n)]
            first, last, approximation = body[1 + 2 * n : 4 + 2 * n]
            used = tuple(tables.get(d if first == 0 else 0x10 | a) for _, d, a in parts)
            end = int(marks[np.searchsorted(marks, at + offset)]) - offset
            image.scans.append((tuple(p[0] for p in parts), first, last, approximation >> 4, approximation & 15, restart, used, at + offset, end + offset))
            at = end


class _Bits:
    """Entropy-coded data without stuffing and markers, read at any bit."""

    def __init__(self, data: np.ndarray, bounds: list[tuple[int, int]]):
        raw = np.concatenate([data[a:b] for a, b in bounds])
        sizes = np.array([b - a for a, b in bounds])
        heads = np.cumsum(sizes) - sizes
        after = np.r_[False, raw[:-1] == 255]
        after[heads[heads < len(raw)]] = False
        mark = after & (raw >= 0xD0) & (raw <= 0xD7)
        keep = ~(after & (raw == 0)) & ~mark
        keep[np.flatnonzero(mark) - 1] = False
        place = np.cumsum(keep) - keep
        starts = np.sort(np.r_[heads, np.flatnonzero(mark) + 1])
        self.starts = np.r_[place, keep.sum()][starts].astype(np.int64) * 8
        owner = np.searchsorted(heads, starts, side="right") - 1
        self.per_image = np.bincount(owner, minlength=len(bounds))
        self.bytes = np.r_[raw[keep], np.zeros(16, np.uint8)]
        b = self.bytes.astype(np.uint32)
        self.words = b[:-3] << 24 | b[1:-2] << 16 | b[2:-1] << 8 | b[3:]

    def ahead(self, p: np.ndarray) -> np.ndarray:
        """At least 25 bits from each place on, in the upper bits."""
        return self.words[p >> 3] << (p & 7).astype(np.uint32)

    def one(self, p: np.ndarray) -> np.ndarray:
        return self.bytes[p >> 3] >> (7 - (p & 7)).astype(np.uint8) & 1


def _extra(bits: _Bits, ahead: np.ndarray, p: np.ndarray, length: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The ``size`` bits that follow a code of ``length`` bits."""
    found = (ahead << length.astype(np.uint32)) >> np.uint32(1) >> (31 - size).astype(np.uint32)
    far = np.flatnonzero(length + size > 25)
    if len(far):
        found[far] = bits.ahead(p[far] + length[far]) >> np.uint32(1) >> (31 - size[far]).astype(np.uint32)
    return found.astype(np.int32)


def _signed(extra: np.ndarray, size: np.ndarray) -> np.ndarray:
    return extra + np.where(extra < (1 << size) >> 1, 1 - (1 << size), 0)


def _decode_dc(bits: _Bits, first: np.ndarray, count: np.ndarray, pattern: list[int], tables: tuple, rows: int) -> np.ndarray:
    out, p = np.zeros(rows, np.int32), bits.starts.copy()
    before = {c: np.zeros(len(p), np.int32) for c in pattern}
    lookups = {c: _lookup(*t) for c, t in zip(dict.fromkeys(pattern), tables, strict=True)}
    lanes = np.arange(len(p))
    for j in range(int(count.max(initial=0))):
        lanes = lanes[count[lanes] > j]
        c, here = pattern[j % len(pattern)], p[lanes]
        ahead = bits.ahead(here)
        found = lookups[c][ahead >> 16]
        length, size = found & 31, found >> 9
        before[c][lanes] += _signed(_extra(bits, ahead, here, length, size), size)
        out[first[lanes] + j] = before[c][lanes]
        p[lanes] = here + length + size
    return out


def _decode_ac(bits: _Bits, first: np.ndarray, count: np.ndarray, table: tuple, rows: int, band: int) -> np.ndarray:
    lookup, out = _lookup(*table), np.zeros(rows * band + 1, np.int16)
    p, row, end, k = bits.starts.copy(), first.copy(), first + count, np.zeros(len(first), np.int64)
    while len(p):
        ahead = bits.ahead(p)
        found = lookup[ahead >> 16]
        length, run, size = found & 31, found >> 5 & 15, found >> 9
        extra = _extra(bits, ahead, p, length, size)
        k += run
        out[np.where((size > 0) & (k < band), row * band + k, rows * band)] = _signed(extra, size)
        k += 1
        p += length + size
        ends = np.flatnonzero((size == 0) & (run < 15))
        if len(ends):
            wide = run[ends]
            row[ends] += (1 << wide) + _extra(bits, ahead[ends], p[ends] - length[ends], length[ends], wide)
            p[ends] += wide
            k[ends] = 0
        over = k >= band
        row += over
        k[over] = 0
        alive = row < end
        if not alive.all():
            p, row, end, k = p[alive], row[alive], end[alive], k[alive]
    return out[:-1].reshape(rows, band)


def _refine_ac(bits: _Bits, first: np.ndarray, count: np.ndarray, table: tuple, now: np.ndarray, low: int) -> None:
    """Adds one bit to ``now`` (block, band) in place. Correction bits are noted as stretches and read all at once."""
    lookup, (rows, band) = _lookup(*table), now.shape
    known = now != 0
    zeros = np.r_[np.flatnonzero(~known), np.full(17, rows * band)]
    per_row = band - known.sum(1)
    bounds = np.r_[0, np.cumsum(per_row), per_row.sum()]
    p, row, end, k = bits.starts.copy(), first.copy(), first + count, np.zeros(len(first), np.int64)
    zero, left = bounds[row], np.zeros(len(p), np.int64)
    stretches, places, values = [], [], []

    def next_row(lanes: np.ndarray) -> None:
        row[lanes] += 1
        k[lanes] = 0
        zero[lanes] = bounds[np.minimum(row[lanes], rows)]

    while len(p):
        coming = np.flatnonzero(left > 0)
        if len(coming):
            n = band - k[coming] - (bounds[row[coming] + 1] - zero[coming])
            stretches.append((row[coming], p[coming], n))
            p[coming] += n
            left[coming] -= 1
            next_row(coming)
        own = np.flatnonzero((left == 0) & (row < end)) if len(coming) else np.arange(len(p))
        if len(own):
            here = p[own]
            ahead = bits.ahead(here)
            found = lookup[ahead >> 16]
            length, run, size = found & 31, found >> 5 & 15, found >> 9
            stop = (size == 0) & (run < 15)
            wide = np.where(stop, run, size)
            extra = _extra(bits, ahead, here, length, wide)
            p[own] = here + length + wide
            left[own[stop]] = (1 << run[stop]) + extra[stop]
            go, run, extra, new = own[~stop], run[~stop], extra[~stop], size[~stop] > 0
            at = zeros[np.minimum(zero[go] + run, len(zeros) - 1)]
            n = at - row[go] * band - k[go] - run
            stretches.append((row[go], p[go], n))
            places.append(at[new])
            values.append(np.where(extra[new] == 1, 1 << low, -(1 << low)))
            p[go] += n
            zero[go] += run + 1
            k[go] = at - row[go] * band + 1
            next_row(go[k[go] >= band])
        alive = (row < end) | (left > 0)
        alive &= row < end
        if not alive.all():
            p, row, end, k, zero, left = p[alive], row[alive], end[alive], k[alive], zero[alive], left[alive]
    flat = now.reshape(-1)
    if stretches:
        rows_of, starts, sizes = (np.concatenate(x) for x in zip(*stretches, strict=True))
        order = np.argsort(rows_of, kind="stable")
        starts, sizes = starts[order], sizes[order]
        total = np.flatnonzero(known)
        if sizes.sum() != len(total):
            raise ValueError("corrections don't fit the coefficients")
        where = np.arange(len(total)) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
        step = (bits.one(where).astype(np.int16) << low) * np.sign(flat[total])
        flat[total] += step
    for at, v in zip(places, values, strict=True):
        flat[at] = v


def _lanes(units: np.ndarray, restart: int, per_image: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """First block and number of blocks of each interval, over images of so many units of ``blocks`` blocks."""
    per = -(-units // restart) if restart else np.ones(len(units), np.int64)
    if (per != per_image).any():
        raise ValueError("restart markers don't fit the image")
    number = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
    size = restart or int(units.max(initial=0))
    count = np.minimum(size, np.repeat(units, per) - number * size)
    first = np.repeat(np.cumsum(units) - units, per) + number * size
    return first * blocks, count * blocks


def decode(streams: list[bytes]) -> list[list[Image]]:
    """The images of each stream (one after the other in it), with their coefficients (block, zigzag place) by component."""
    data = np.frombuffer(b"".join(streams) + b"\xff\xd9", np.uint8)
    after = data[1:]
    marks = np.flatnonzero((data[:-1] == 255) & (after != 0) & (after != 255) & ((after < 0xD0) | (after > 0xD7)))
    found, offset = [], 0
    for stream in streams:
        at, images = 0, []
        while at < len(stream):
            image, at = _parse(stream, offset, at, marks)
            images.append(image)
        found.append(images)
        offset += len(stream)
    images = [i for x in found for i in x]
    components = max((len(i.ids) for i in images), default=0)
    sizes = np.array([[np.prod(i.blocks(c)) if c < len(i.ids) else 0 for c in range(components)] for i in images], np.int64).reshape(len(images), components)
    bases = np.cumsum(sizes, axis=0) - sizes
    store = [np.zeros((int(sizes[:, c].sum()), 64), np.int16) for c in range(components)]
    for step in range(max((len(i.scans) for i in images), default=0)):
        groups: dict[tuple, list[int]] = {}
        for k, image in enumerate(images):
            if step < len(image.scans):
                groups.setdefault((*image.scans[step][:7], tuple(image.sampling)), []).append(k)
        for (parts, first, last, high, low, restart, tables, sampling), members in groups.items():
            bits = _Bits(data, [images[k].scans[step][7:] for k in members])
            if len(parts) > 1:
                orders = [_scan_order(*images[k].units, tuple(sampling[c] for c in parts)) for k in members]
                which = np.concatenate([o[0] for o in orders])
                number = np.concatenate([o[1] + bases[k, list(parts)][o[0]] for o, k in zip(orders, members, strict=True)])
                units = np.array([np.prod(images[k].units) for k in members])
                pattern = [c for c, p in enumerate(parts) for _ in range(sampling[p][0] * sampling[p][1])]
            else:
                shapes = [(images[k].own_blocks(parts[0]), images[k].blocks(parts[0])[1]) for k in members]
                number = np.concatenate([_alone(r, c, wide) + bases[k, parts[0]] for ((r, c), wide), k in zip(shapes, members, strict=True)])
                which, pattern = np.zeros(len(number), np.int64), [0]
                units = np.array([r * c for (r, c), _ in shapes])
            lane_first, lane_count = _lanes(units, restart, bits.per_image, len(pattern))
            if first == 0:
                if high:
                    where = np.arange(len(number)) + np.repeat(bits.starts - lane_first, lane_count)
                    values = bits.one(where).astype(np.int16) << low
                else:
                    values = _decode_dc(bits, lane_first, lane_count, pattern, tables, len(number)) << low
                for c, p in enumerate(parts):
                    mine = which == c
                    store[p][number[mine], 0] += values[mine].astype(np.int16)
            elif high:
                now = store[parts[0]][number, first : last + 1]
                _refine_ac(bits, lane_first, lane_count, tables[0], now, low)
                store[parts[0]][number, first : last + 1] = now
            else:
                store[parts[0]][number, first : last + 1] = _decode_ac(bits, lane_first, lane_count, tables[0], len(number), last - first + 1) << low
    for k, image in enumerate(images):
        image.coefficients = [store[c][bases[k, c] : bases[k, c] + sizes[k, c]] for c in range(len(image.ids))]
    return found


@functools.lru_cache(maxsize=1024)
def _alone(rows: int, columns: int, wide: int) -> np.ndarray:
    """Block numbers of a component of ``wide`` block columns of which a scan of its own has ``columns``."""
    return (np.arange(rows)[:, None] * wide + np.arange(columns)).ravel()


def to_payload(image: Image) -> np.ndarray:
    """The bytes that :func:`encode` put into an image."""
    n = struct.unpack(">I", image.comments[0])[0]
    whole = np.concatenate([c.reshape(-1) for c in image.coefficients])[:n]
    return TO_BYTE[whole + 128]


def to_rgb(image: Image) -> np.ndarray:
    """The full-resolution (height, width, 3) tensor: inverse transform, replicated chroma, RGB."""
    planes, top = [], [max(s[k] for s in image.sampling) for k in (0, 1)]
    for c, (h, v) in enumerate(image.sampling):
        rows, columns = image.blocks(c)
        pixels = image.coefficients[c].astype(np.float32) @ (INVERSE * image.quant[c][:, None])
        plane = pixels.reshape(rows, columns, 8, 8).transpose(0, 2, 1, 3).reshape(rows * 8, columns * 8)
        if (h, v) != tuple(top):
            plane = plane.repeat(top[1] // v, axis=0).repeat(top[0] // h, axis=1)
        planes.append(plane[: image.height, : image.width])
    if len(planes) == 1:
        planes = [planes[0]] * 3
    else:
        y, cb, cr = planes
        planes = [y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb]
    out = np.stack(planes, axis=-1)
    out += 128.5
    return np.clip(out, 0, 255, out=out).astype(np.uint8)
