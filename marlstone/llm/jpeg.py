"""Media columns: bytes kept in baseline JPEG files, and features read from such files."""

from __future__ import annotations

import hashlib
import struct
from dataclasses import dataclass, field

import numpy as np

#: Code lengths of the files that encode() writes: coefficients without zeros before them, of at most 8 bits, get 4 bits.
AC_SYMBOLS = [*range(1, 9), 0, 0xF0, *(r << 4 | s for r in range(16) for s in range(1, 11) if r or s > 8)]
AC_LENGTHS = [4] * 8 + [10] * (len(AC_SYMBOLS) - 8)
DC_SYMBOLS, DC_LENGTHS = list(range(12)), [4] * 12
#: Blocks from one restart marker to the next.
INTERVAL = 3


def canonical(lengths: list[int]) -> list[int]:
    """The codes that a JPEG decoder gives to symbols of these ascending lengths."""
    codes, code, last = [], 0, lengths[0]
    for n in lengths:
        code <<= n - last
        codes.append(code)
        code, last = code + 1, n
    return codes


def _by_symbol(symbols: list[int], lengths: list[int]) -> tuple[np.ndarray, np.ndarray]:
    code, size = np.zeros(256, np.int64), np.zeros(256, np.int64)
    code[symbols], size[symbols] = canonical(lengths), lengths
    return code, size


_AC, _DC = _by_symbol(AC_SYMBOLS, AC_LENGTHS), _by_symbol(DC_SYMBOLS, DC_LENGTHS)


def _category(v: np.ndarray) -> np.ndarray:
    """Bits of the magnitude."""
    return np.ceil(np.log2(np.abs(v) + 1)).astype(np.int64)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _table(kind: int, symbols: list[int], lengths: list[int]) -> bytes:
    return bytes([kind, *(lengths.count(n) for n in range(1, 17)), *symbols])


def layout(n_bytes: int) -> tuple[int, int]:
    """Blocks across and down for a payload of n_bytes, a multiple of 192."""
    units = n_bytes // 192
    across = 3 * -(-units // 8191)
    return across, -(-3 * units // across)


def header(n_bytes: int) -> bytes:
    across, down = layout(n_bytes)
    return b"".join([
        b"\xff\xd8", _segment(0xFE, b"payload %d" % n_bytes), _segment(0xDB, bytes([0] + [1] * 64)),
        _segment(0xC0, struct.pack(">BHHBBBB", 8, 8 * down, 8 * across, 1, 1, 0x11, 0)), _segment(0xC4, _table(0, DC_SYMBOLS, DC_LENGTHS)), _segment(0xC4, _table(0x10, AC_SYMBOLS, AC_LENGTHS)),
        _segment(0xDD, struct.pack(">H", INTERVAL)), _segment(0xDA, bytes([1, 1, 0, 0, 63, 0])),
    ])


def encode(payloads: list[bytes]) -> list[bytes]:
    """A grey baseline JPEG for each payload (lengths: positive multiples of 192) from which decode() gets it back.

    A byte less 128 is a quantised coefficient (the format's unit; quantisers are 1), 64 to a block in zigzag order, so
    nothing is lost. Blocks beyond the payload are zero. Every INTERVAL blocks a restart marker makes the scan's parts
    independent.
    """
    blocks_of = [np.prod(layout(len(p))) for p in payloads]
    parts = []
    for p, n in zip(payloads, blocks_of):
        c = np.zeros(int(n) * 64, np.int16)
        c[: len(p)] = np.frombuffer(p, np.uint8).astype(np.int16) - 128
        parts.append(c)
    coef = np.concatenate(parts).reshape(-1, 64).astype(np.int64)
    n_blocks = len(coef)
    segments_of = [int(-(-n // INTERVAL)) for n in blocks_of]
    segment = np.repeat(np.arange(sum(segments_of)), [m for n in blocks_of for m in [INTERVAL] * int(n // INTERVAL) + [int(n % INTERVAL)] * bool(n % INTERVAL)])
    first = np.r_[True, segment[1:] != segment[:-1]]
    # DC: differences within a segment.
    dc = coef[:, 0] - np.where(first, 0, np.r_[0, coef[:-1, 0]])
    cat = _category(dc)
    dc_value, dc_bits = _DC[0][cat] << cat | np.where(dc < 0, dc + (1 << cat) - 1, dc), _DC[1][cat] + cat
    # AC: symbols of run and size, with 16-zero symbols before long runs and an end of block after the last.
    b, k = np.nonzero(coef[:, 1:])
    k += 1
    v = coef[b, k]
    new = np.r_[True, b[1:] != b[:-1]] if len(b) else np.zeros(0, bool)
    run = k - np.where(new, 0, np.r_[0, k[:-1]]) - 1
    size = _category(v)
    sym = (run & 15) << 4 | size
    value, bits = _AC[0][sym] << size | np.where(v < 0, v + (1 << size) - 1, v), _AC[1][sym] + size
    long = run >> 4
    zb, zk, zv, zn = np.repeat(b, long), np.repeat(k, long), np.full(long.sum(), _AC[0][0xF0]), np.full(long.sum(), _AC[1][0xF0])
    ends = np.flatnonzero(coef[:, 63] == 0)
    where = np.concatenate([np.arange(n_blocks) * 128, zb * 128 + 2 * zk - 1, b * 128 + 2 * k, ends * 128 + 127])
    order = np.argsort(where, kind="stable")
    value = np.concatenate([dc_value, zv, value, np.full(len(ends), _AC[0][0])])[order]
    bits = np.concatenate([dc_bits, zn, bits, np.full(len(ends), _AC[1][0])])[order]
    own = segment[where[order] >> 7]
    # Places in bits; each segment starts at a byte and is filled up with ones.
    n_bits = np.bincount(own, bits, len(first.nonzero()[0])).astype(np.int64)
    n_bytes = -(-n_bits // 8)
    start = np.r_[0, np.cumsum(n_bytes)[:-1]]
    at = np.cumsum(bits) - bits
    at += (start * 8 - np.r_[0, np.cumsum(n_bits)[:-1]])[own]
    pad = 8 * n_bytes - n_bits
    value, bits, at = (np.concatenate(x) for x in ((value, (1 << pad) - 1), (bits, pad), (at, start * 8 + n_bits)))
    order = np.argsort(at, kind="stable")
    order = order[bits[order] > 0]
    value, bits, at = value[order], bits[order], at[order]
    word = at >> 5
    wide = value.astype(np.uint64) << (64 - (at & 31) - bits).astype(np.uint64)
    starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
    joined = np.bitwise_or.reduceat(wide, starts)
    words = np.zeros(int(n_bytes.sum()) // 4 + 3, np.uint64)
    words[word[starts]] |= joined >> np.uint64(32)
    words[word[starts] + 1] |= joined & np.uint64(0xFFFFFFFF)
    data = words.astype(">u4").view(np.uint8)[: int(n_bytes.sum())]
    # A zero after each 0xFF, and restart markers between a file's segments.
    full = data == 0xFF
    seg_of_byte = np.repeat(np.arange(len(n_bytes)), n_bytes)
    target = np.arange(len(data)) + np.cumsum(full) - full + 2 * seg_of_byte
    stream = np.zeros(len(data) + int(full.sum()) + 2 * len(n_bytes), np.uint8)
    stream[target] = data
    last = np.cumsum(n_bytes) - 1
    mark = target[last] + 1 + full[last]
    local = np.concatenate([np.arange(m) for m in segments_of])
    stream[mark], stream[mark + 1] = 0xFF, 0xD0 + local % 8
    cuts = np.cumsum(segments_of) - 1
    out, at_byte = [], 0
    for p, c in zip(payloads, cuts):
        end = int(mark[c])
        out.append(header(len(p)) + stream[at_byte:end].tobytes() + b"\xff\xd9")
        at_byte = end + 2
    return out


@dataclass
class Frame:
    """What the markers of a file say."""

    width: int = 0
    height: int = 0
    components: list[tuple[int, int, int, int]] = field(default_factory=list)  # id, across, down, quantiser
    quantisers: dict[int, np.ndarray] = field(default_factory=dict)
    tables: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)  # by 16 bits ahead: symbol, bits
    scan: list[tuple[int, int, int]] = field(default_factory=list)  # component, DC table, AC table
    interval: int = 0
    comments: list[bytes] = field(default_factory=list)
    data: bytes = b""


_LOOKUPS: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}


def _lookup(counts: bytes, symbols: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Symbol and code length for each value of the next 16 bits; length 0: no such code."""
    if (key := counts + symbols) not in _LOOKUPS:
        if len(_LOOKUPS) > 64:
            _LOOKUPS.clear()
        symbol, size = np.zeros(65536, np.int64), np.zeros(65536, np.int64)
        lengths = [n for n, c in enumerate(counts, 1) for _ in range(c)]
        for s, n, code in zip(symbols, lengths, canonical(lengths) if lengths else []):
            symbol[code << 16 - n : code + 1 << 16 - n], size[code << 16 - n : code + 1 << 16 - n] = s, n
        _LOOKUPS[key] = symbol, size
    return _LOOKUPS[key]


def parse(file: bytes) -> Frame:
    """Read the markers of a baseline file with one scan; ValueError for anything else."""
    if file[:2] != b"\xff\xd8":
        raise ValueError("no JPEG")
    f, at = Frame(), 2
    while True:
        while at < len(file) - 1 and file[at] == 0xFF and file[at + 1] == 0xFF:
            at += 1
        if at + 4 > len(file) or file[at] != 0xFF:
            raise ValueError("marker expected")
        marker, size = file[at + 1], int.from_bytes(file[at + 2 : at + 4], "big")
        body, at = file[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xC0:
            _, f.height, f.width, n = struct.unpack(">BHHB", body[:6])
            f.components = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        elif 0xC1 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("not baseline")
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                f.tables[body[0]] = _lookup(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xDB:
            while body:
                n = 128 if body[0] >> 4 else 64
                f.quantisers[body[0] & 15] = np.frombuffer(body[1 : 1 + n], ">u2" if n == 128 else np.uint8).astype(np.int64)
                body = body[1 + n :]
        elif marker == 0xDD:
            f.interval = int.from_bytes(body[:2], "big")
        elif marker == 0xFE:
            f.comments.append(body)
        elif marker == 0xDA:
            f.scan = [(body[1 + 2 * i], body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])]
            end = file.rfind(b"\xff\xd9")
            f.data = file[at : end if end >= at else len(file)]
            return f


def _plan(f: Frame) -> list[tuple[int, int, int]]:
    """Component number, DC table and AC table of each block of a minimal coded unit."""
    ids = [c[0] for c in f.components]
    if len(f.scan) == 1:
        return [(ids.index(f.scan[0][0]), *f.scan[0][1:])]
    return [(ids.index(c), d, a) for c, d, a in f.scan for _ in range(f.components[ids.index(c)][1] * f.components[ids.index(c)][2])]


def _units(f: Frame) -> tuple[int, int]:
    """Minimal coded units across and down."""
    most_h, most_v = max(c[1] for c in f.components), max(c[2] for c in f.components)
    if len(f.scan) == 1:
        h, v = next((c[1], c[2]) for c in f.components if c[0] == f.scan[0][0])
        return -(-(-(-f.width * h // most_h)) // 8), -(-(-(-f.height * v // most_v)) // 8)
    return -(-f.width // (8 * most_h)), -(-f.height // (8 * most_v))


def coefficients(frames: list[Frame]) -> list[np.ndarray]:
    """Quantised coefficients, in zigzag order, of each file's blocks as they come in its scan.

    The parts between restart markers are independent, so all parts of all files are decoded side by side: in each step
    numpy takes one Huffman symbol from every part. Files are grouped by their tables and units.
    """
    groups: dict[tuple, list[int]] = {}
    for i, f in enumerate(frames):
        groups.setdefault((tuple(_plan(f)), tuple(sorted((k, id(t[0])) for k, t in f.tables.items()))), []).append(i)
    out: list[np.ndarray] = [np.zeros((0, 64), np.int16)] * len(frames)
    for (plan, _), members in groups.items():
        own = [frames[i] for i in members]
        for i, c in zip(members, _decode_group(own, list(plan), own[0].tables)):
            out[i] = c
    return out


def _decode_group(frames: list[Frame], plan: list[tuple[int, int, int]], tables: dict) -> list[np.ndarray]:
    raw = np.frombuffer(b"".join(f.data + b"\xff\xd9" for f in frames), np.uint8)
    escape = np.flatnonzero(raw[:-1] == 0xFF)
    after = raw[escape + 1]
    marks = escape[after != 0]
    drop = np.concatenate([escape[after == 0] + 1, marks, marks + 1])
    keep = np.ones(len(raw), bool)
    keep[drop] = False
    before = np.cumsum(keep)
    data = np.concatenate([raw[keep], np.zeros(8, np.uint8)])
    starts = np.r_[0, before[marks][:-1]]  # in data; the last mark ends the last file
    units, want = [], []
    for f in frames:
        across, down = _units(f)
        n = across * down
        each = f.interval or n
        parts = [each] * (n // each) + [n % each] * bool(n % each)
        units += parts
        want.append(n * len(plan))
    if len(units) != len(starts):
        raise ValueError("restart markers do not fit")
    units_of = np.array(units)
    per = len(plan)
    base = np.r_[0, np.cumsum(units_of * per)[:-1]]
    coef = np.zeros((int((units_of * per).sum()), 64), np.int16)
    # 40 bits from each byte on, so a symbol and its value come from one look.
    wide = data.astype(np.int64)
    ahead = wide[:-7] << 32 | wide[1:-6] << 24 | wide[2:-5] << 16 | wide[3:-4] << 8 | wide[4:-3]
    bit = starts.astype(np.int64) * 8
    last = len(ahead) - 1

    def take(live: np.ndarray, table: tuple) -> tuple[np.ndarray, np.ndarray]:
        at = bit[live]
        window = ahead[np.minimum(at >> 3, last)] << (at & 7) & 0xFFFFFFFFFF
        key = window >> 24
        symbol, size = table[0][key], table[1][key]
        if not size.all():
            raise ValueError("no such code")
        n = symbol & 15
        v = window >> (40 - size - n) & (1 << n) - 1
        bit[live] = at + size + n
        return symbol, np.where(v < (1 << n) >> 1, v - (1 << n) + 1, v)

    for u in range(int(units_of.max(initial=0))):
        alive = np.flatnonzero(units_of > u)
        if u == 0:
            dc = np.zeros((len(starts), max(p[0] for p in plan) + 1), np.int64)
        for b, (c, dc_table, ac_table) in enumerate(plan):
            rows = base + u * per + b
            _, v = take(alive, tables[dc_table])
            dc[alive, c] += v
            coef[rows[alive], 0] = dc[alive, c]
            live, k = alive, np.ones(len(alive), np.int64)
            while len(live):
                symbol, v = take(live, tables[16 + ac_table])
                run, size = symbol >> 4, symbol & 15
                at = k + run
                put = (size > 0) & (at < 64)
                coef[rows[live[put]], at[put]] = v[put]
                k = at + 1
                go = ((size > 0) | (run == 15)) & (k < 64)
                live, k = live[go], k[go]
    return np.split(coef, np.cumsum(want)[:-1])


def thumbnail(f: Frame, coef: np.ndarray) -> np.ndarray:
    """Luminance at one sample a block, from the DC coefficients of the first component alone."""
    plan = _plan(f)
    across, down = _units(f)
    h, v = (1, 1) if len(f.scan) == 1 else f.components[0][1:3]
    mine = [i for i, p in enumerate(plan) if p[0] == 0]
    dc = coef[:, 0].reshape(down, across, len(plan))[:, :, mine].reshape(down, across, v, h).transpose(0, 2, 1, 3).reshape(down * v, across * h)
    return np.clip(dc.astype(np.int64) * f.quantisers[f.components[0][3]][0] // 8 + 128, 0, 255).astype(np.uint8)


def average_hash(image: np.ndarray, side: int = 8) -> str:
    """64 bits as hex: which cells of a side x side grid are brighter than the mean of all."""
    rows, cols = (np.arange(side) * n // side for n in image.shape)
    big = np.repeat(np.repeat(image, -(-side // image.shape[0]), 0), -(-side // image.shape[1]), 1).astype(np.float64)
    rows, cols = (np.arange(side) * n // side for n in big.shape)
    cells = np.add.reduceat(np.add.reduceat(big, rows, 0), cols, 1) / np.outer(np.diff(np.r_[rows, big.shape[0]]), np.diff(np.r_[cols, big.shape[1]]))
    return f"{int(''.join('01'[int(x)] for x in (cells > cells.mean()).ravel()), 2):016x}"


@dataclass
class Media:
    """A decoded file: dimensions, hash of the thumbnail, and the payload where encode() made the file."""

    width: int
    height: int
    thumbnail_sha256: str
    average_hash: str
    payload: bytes | None


def decode(files: list[bytes]) -> list[Media]:
    frames = [parse(x) for x in files]
    out = []
    for f, coef in zip(frames, coefficients(frames)):
        thumb = thumbnail(f, coef)
        note = next((int(c[8:]) for c in f.comments if c.startswith(b"payload ")), None)
        payload = None if note is None else (coef.ravel()[:note] + 128).astype(np.uint8).tobytes()
        out.append(Media(f.width, f.height, hashlib.sha256(thumb.tobytes()).hexdigest(), average_hash(thumb), payload))
    return out
