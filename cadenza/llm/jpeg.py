"""Progressive JPEG: a decoder of coefficient scans, and a writer that stores bytes losslessly as coefficients.

The decoder follows ITU-T T.81: it adds spectral-selection and successive-approximation scans to one coefficient array per
component (Huffman coding, restart intervals, any sampling factors), turns coefficients into samples by an inverse cosine
transform in numpy, repeats chroma samples to full resolution and converts to RGB. Where every symbol of a scan's table
takes the same number of bits, and where correction bits of a run of blocks lie side by side, whole stretches are read at
once; everything else is read symbol by symbol.

The writer puts payload byte b into a coefficient of value 256 + b, 64 to a block. Bit 0 of every coefficient is left to
refinement scans, all higher bits go into first scans, DC and AC apart. All AC values then have magnitude category 8, so
their scans need a single Huffman symbol.
"""

from __future__ import annotations

import functools
import struct

import numpy as np


@functools.cache
def zigzag() -> np.ndarray:
    """Row-major place of each coefficient in scan order: along the anti-diagonals, turning at each edge."""
    order = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))
    return np.array([8 * r + c for r, c in order])


@functools.cache
def cosines() -> np.ndarray:
    """M with samples = M @ coefficients @ M.T."""
    x, u = np.arange(8)[:, None], np.arange(8)[None, :]
    return (np.cos((2 * x + 1) * u * np.pi / 16) / 2 * np.where(u == 0, np.sqrt(0.5), 1)).astype(np.float32)


class Table:
    """A Huffman table: for the next 16 bits, the symbol and its code length."""

    def __init__(self, counts: bytes, symbols: bytes):
        self.symbol, self.length = [0] * 65536, [0] * 65536
        code = k = 0
        for n, many in enumerate(counts, 1):
            for _ in range(many):
                first, width = code << (16 - n), 1 << (16 - n)
                if first + width > 65536:
                    raise ValueError("a Huffman table has too many codes")
                self.symbol[first : first + width] = [symbols[k]] * width
                self.length[first : first + width] = [n] * width
                code += 1
                k += 1
            code <<= 1
        lengths = [n for n, many in enumerate(counts, 1) for _ in range(many)]
        #: Bits of a coefficient (code and value) if this table has nothing but one symbol without a run of zeros.
        self.only = (symbols[0], lengths[0]) if len(symbols) == 1 and 0 < symbols[0] < 16 else None


@functools.lru_cache(64)
def table(counts: bytes, symbols: bytes) -> Table:
    return Table(counts, symbols)


class Bits:
    """Bits of one restart interval."""

    def __init__(self, raw: bytes):
        self.raw = raw.replace(b"\xff\x00", b"\xff") + bytes(8)
        self.size = 8 * (len(self.raw) - 8)
        self.at = 0

    def peek16(self) -> int:
        byte = self.at >> 3
        return (int.from_bytes(self.raw[byte : byte + 3], "big") >> (8 - (self.at & 7))) & 0xFFFF

    def symbol(self, table: Table) -> int:
        code = self.peek16()
        n = table.length[code]
        if not n or self.at >= self.size:
            raise ValueError("the entropy-coded data is broken")
        self.at += n
        return table.symbol[code]

    def take(self, n: int) -> int:
        if not n:
            return 0
        byte, end = self.at >> 3, self.at + n
        if end > self.size:
            raise ValueError("the entropy-coded data ends early")
        last = (end + 7) >> 3
        value = int.from_bytes(self.raw[byte:last], "big") >> ((last << 3) - end)
        self.at = end
        return value & ((1 << n) - 1)

    def many(self, n: int) -> np.ndarray:
        byte, end = self.at >> 3, self.at + n
        if end > self.size:
            raise ValueError("the entropy-coded data ends early")
        bits = np.unpackbits(np.frombuffer(self.raw, np.uint8, ((end + 7) >> 3) - byte, byte))[self.at & 7 :][:n]
        self.at = end
        return bits


def _signed(value: int, size: int) -> int:
    return value if size and value >> (size - 1) else value - (1 << size) + 1


class Component:
    def __init__(self, ident: int, h: int, v: int, quant: int):
        self.ident, self.h, self.v, self.quant = ident, h, v, quant
        self.wide = self.high = self.own_wide = self.own_high = 0
        self.coefficients = np.empty((0, 64), np.int16)


class Image:
    """A progressive picture: its components with their coefficients in scan order."""

    def __init__(self, width: int, height: int, components: list[Component]):
        self.width, self.height, self.components = width, height, components
        self.h, self.v = max(c.h for c in components), max(c.v for c in components)
        self.mcus_wide, self.mcus_high = -(-width // (8 * self.h)), -(-height // (8 * self.v))
        for c in components:
            c.wide, c.high = self.mcus_wide * c.h, self.mcus_high * c.v
            c.own_wide, c.own_high = -(-(-(-width * c.h // self.h)) // 8), -(-(-(-height * c.v // self.v)) // 8)
            c.coefficients = np.zeros((c.wide * c.high, 64), np.int16)
        self.quant: dict[int, np.ndarray] = {}
        self.comment = b""

    def planes(self) -> list[np.ndarray]:
        """Samples of each component, 0 to 255, at its own resolution."""
        out = []
        for c in self.components:
            values = np.empty((len(c.coefficients), 64), np.float32)
            values[:, zigzag()] = c.coefficients * self.quant[c.quant].astype(np.float32)
            m = cosines()
            blocks = np.matmul(np.matmul(m, values.reshape(-1, 8, 8)), m.T)
            plane = blocks.reshape(c.high, c.wide, 8, 8).transpose(0, 2, 1, 3).reshape(c.high * 8, c.wide * 8)
            out.append(np.clip(np.rint(plane + 128), 0, 255).astype(np.uint8))
        return out

    def rgb(self) -> np.ndarray:
        """The picture as a height x width x 3 tensor of unsigned bytes; grey is repeated."""
        full = []
        for c, plane in zip(self.components, self.planes(), strict=True):
            plane = np.repeat(np.repeat(plane, self.v // c.v, axis=0), self.h // c.h, axis=1)
            full.append(plane[: self.height, : self.width])
        if len(full) == 1:
            return np.repeat(full[0][:, :, None], 3, axis=2)
        y, cb, cr = (p.astype(np.float32) for p in full[:3])
        cb, cr = cb - 128, cr - 128
        rgb = np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], axis=2)
        return np.clip(np.rint(rgb), 0, 255).astype(np.uint8)


Shape = tuple[int, int, int, int, int]


def _shape(c: Component) -> Shape:
    return c.h, c.v, c.wide, c.own_wide, c.own_high


def _scan_order(mcus_wide: int, mcus_high: int, shapes: tuple[Shape, ...]) -> tuple[np.ndarray, np.ndarray, int]:
    """Blocks of a scan: for each its component's number in the scan, its place in the component, and the blocks of an MCU.

    A scan of one component goes row by row without padding, one of several by MCU.
    """
    if len(shapes) == 1:
        _, _, wide, own_wide, own_high = shapes[0]
        blocks = (np.arange(own_high)[:, None] * wide + np.arange(own_wide)[None, :]).ravel()
        return np.zeros(len(blocks), np.int64), blocks, 1
    mcu = np.arange(mcus_wide * mcus_high)
    top, left = (mcu // mcus_wide)[:, None], (mcu % mcus_wide)[:, None]
    number, blocks = [], []
    for k, (h, v, wide, _, _) in enumerate(shapes):
        inner = np.arange(h * v)
        blocks.append((top * v + inner // h) * wide + left * h + inner % h)
        number += [k] * (h * v)
    return np.tile(np.array(number), len(mcu)), np.concatenate(blocks, axis=1).ravel(), len(number)


_cached_scan_order = functools.lru_cache(512)(_scan_order)


def _order(image: Image, parts: list[Component]) -> tuple[np.ndarray, np.ndarray, int]:
    """The order of a scan's blocks; those of small pictures, whose sizes recur, are remembered."""
    find = _cached_scan_order if image.mcus_wide * image.mcus_high <= 1024 else _scan_order
    return find(image.mcus_wide, image.mcus_high, tuple(map(_shape, parts)))


def _intervals(image: Image, parts: list[Component], restart: int, pieces: list[bytes]):
    """The bits of each restart interval, its blocks' component numbers, and their places."""
    number, blocks, per_mcu = _order(image, parts)
    step = restart * per_mcu or max(len(blocks), 1)
    for k, start in enumerate(range(0, len(blocks), step)):
        if k >= len(pieces):
            raise ValueError("restart intervals are missing")
        yield Bits(pieces[k]), number[start : start + step], blocks[start : start + step]


def _dc_first(bits: Bits, number: np.ndarray, blocks: np.ndarray, parts: list[Component], tables: list[Table], low: int) -> None:
    last = [0] * len(parts)
    values = []
    for k in number.tolist():
        size = bits.symbol(tables[k])
        if size:
            last[k] += _signed(bits.take(size), size)
        values.append(last[k])
    got = np.array(values, np.int64) << low
    for k, c in enumerate(parts):
        mine = number == k
        c.coefficients[blocks[mine], 0] = got[mine]


def _dc_refine(bits: Bits, number: np.ndarray, blocks: np.ndarray, parts: list[Component], low: int) -> None:
    got = bits.many(len(blocks)).astype(np.int16) << low
    for k, c in enumerate(parts):
        mine = number == k
        c.coefficients[blocks[mine], 0] |= got[mine]


def _ac_first(bits: Bits, blocks: np.ndarray, coef: np.ndarray, table: Table, start: int, end: int, low: int) -> None:
    if table.only:
        size, code = table.only
        n = len(blocks) * (end - start + 1)
        got = bits.many(n * (code + size)).reshape(n, code + size)[:, code:]
        value = np.zeros(n, np.int32)
        for k in range(size):
            value = value << 1 | got[:, k]
        value = np.where(got[:, 0] == 1, value, value - (1 << size) + 1)
        coef[blocks, start : end + 1] = (value << low).reshape(len(blocks), -1)
        return
    skip = 0
    for block in blocks.tolist():
        if skip:
            skip -= 1
            continue
        k = start
        while k <= end:
            run, size = divmod(bits.symbol(table), 16)
            if size:
                k += run
                if k > end:
                    raise ValueError("a run of zeros leaves its block")
                coef[block, k] = _signed(bits.take(size), size) << low
                k += 1
            elif run == 15:
                k += 16
            else:
                skip = (1 << run) + bits.take(run) - 1
                break


def _correct(bits: Bits, coef: np.ndarray, rows: np.ndarray | int, cols: slice, one: int) -> None:
    """One correction bit for each coefficient that is not zero, in scan order."""
    part = coef[rows, cols]
    at = np.flatnonzero(part)
    if len(at):
        flat = part.ravel()
        old = flat[at]
        up = bits.many(len(at)).astype(bool) & ((np.abs(old) & one) == 0)
        flat[at] = old + np.where(up, np.sign(old) * one, 0).astype(np.int16)
        coef[rows, cols] = flat.reshape(part.shape)


def _ac_refine(bits: Bits, blocks: np.ndarray, coef: np.ndarray, table: Table, start: int, end: int, low: int) -> None:
    one = 1 << low
    at = 0
    while at < len(blocks):
        block, k = int(blocks[at]), start
        while k <= end:
            run, size = divmod(bits.symbol(table), 16)
            if not size and run < 15:  # the rest of this block and the following blocks get correction bits only
                many = (1 << run) + bits.take(run)
                _correct(bits, coef, block, slice(k, end + 1), one)
                _correct(bits, coef, blocks[at + 1 : at + many], slice(start, end + 1), one)
                at += many - 1
                break
            new = (one if bits.take(1) else -one) if size else 0
            stop = k  # the place after ``run`` zeros
            row = coef[block]
            while stop <= end and (row[stop] or run):
                run -= not row[stop]
                stop += 1
            _correct(bits, coef, block, slice(k, min(stop, end + 1)), one)
            if new:
                if stop > end:
                    raise ValueError("a run of zeros leaves its block")
                coef[block, stop] = new
            k = stop + 1
        at += 1


def decode(raw: bytes) -> Image:
    """Reads a progressive JPEG; ``ValueError`` if it is broken or of another kind."""
    if raw[:2] != b"\xff\xd8":
        raise ValueError("no JPEG")
    at, image, restart, comment = 2, None, 0, b""
    quant: dict[int, np.ndarray] = {}
    tables: dict[int, Table] = {}
    while at + 4 <= len(raw):
        if raw[at] != 0xFF:
            raise ValueError("a marker is missing")
        kind = raw[at + 1]
        if kind == 0xD9:
            break
        size = struct.unpack(">H", raw[at + 2 : at + 4])[0]
        body = raw[at + 4 : at + 2 + size]
        at += 2 + size
        if kind == 0xDB:
            while body:
                wide, number = divmod(body[0], 16)
                n = 64 * (1 + wide)
                quant[number] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else np.uint8).astype(np.int64)
                body = body[1 + n :]
        elif kind == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0]] = table(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif kind == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif kind == 0xFE:
            comment = body
        elif kind == 0xC2:
            _, height, width, n = struct.unpack(">BHHB", body[:6])
            image = Image(width, height, [Component(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)])
        elif kind in (0xC0, 0xC1, 0xC3):
            raise ValueError("not a progressive JPEG")
        elif kind == 0xDA:
            if image is None:
                raise ValueError("a scan comes before its frame")
            n = body[0]
            named = {c.ident: c for c in image.components}
            parts = [named[body[1 + 2 * k]] for k in range(n)]
            use = [body[2 + 2 * k] for k in range(n)]
            start, end, bits = body[1 + 2 * n : 4 + 2 * n]
            high, low = divmod(bits, 16)
            pieces, at = _entropy(raw, at)
            for bits, number, blocks in _intervals(image, parts, restart, pieces):
                if start == 0 and not high:
                    _dc_first(bits, number, blocks, parts, [tables[u >> 4] for u in use], low)
                elif start == 0:
                    _dc_refine(bits, number, blocks, parts, low)
                else:
                    run = _ac_refine if high else _ac_first
                    run(bits, blocks, parts[0].coefficients, tables[0x10 | use[0] & 15], start, end, low)
    if image is None:
        raise ValueError("no frame")
    image.quant, image.comment = quant, comment
    return image


def _entropy(raw: bytes, at: int) -> tuple[list[bytes], int]:
    """The entropy-coded pieces from ``at`` on, cut at restart markers, and where the next marker is."""
    pieces, begin = [], at
    while True:
        at = raw.find(b"\xff", at)
        if at < 0 or at + 1 >= len(raw):
            raise ValueError("a scan does not end")
        if raw[at + 1] == 0:
            at += 2
            continue
        pieces.append(raw[begin:at])
        if not 0xD0 <= raw[at + 1] <= 0xD7:
            return pieces, at
        at += 2
        begin = at


# Writing: three components, chroma at half resolution, six blocks to an MCU.

_MCU_BLOCKS, _MOST_WIDE = 6, 4095


def _packed(bits: np.ndarray) -> bytes:
    pad = -len(bits) % 8
    return np.packbits(np.concatenate([bits, np.ones(pad, np.uint8)]) if pad else bits).tobytes().replace(b"\xff", b"\xff\x00")


def _field(values: np.ndarray, width: int) -> np.ndarray:
    """The lowest ``width`` bits of each value, from the highest on."""
    return (values[:, None] >> np.arange(width - 1, -1, -1) & 1).astype(np.uint8)


def _segment(kind: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, kind, len(body) + 2) + body


def _scan(parts: list[int], start: int, end: int, high: int, low: int, data: bytes) -> bytes:
    return _segment(0xDA, bytes([len(parts), *(x for p in parts for x in (p, 0)), start, end, high << 4 | low])) + data


def _dc_table() -> bytes:
    """Categories 0 to 8, all with codes of four bits."""
    return bytes([0x00, 0, 0, 0, 9, *[0] * 12, *range(9)])


def _eob_table(n: int) -> bytes:
    return bytes([0x10, 1, *[0] * 15, n << 4])


def encode(payload: bytes) -> bytes:
    """A progressive JPEG whose coefficients hold ``payload`` (a multiple of 64 bytes)."""
    n_blocks = len(payload) // 64
    n = -(-n_blocks // _MCU_BLOCKS)
    rows = -(-n // _MOST_WIDE)
    wide = -(-n // rows)
    data = np.zeros((wide * rows * _MCU_BLOCKS, 64), np.int16)
    data[:n_blocks] = np.frombuffer(payload, np.uint8).reshape(-1, 64)
    data += 256
    image = Image(16 * wide, 16 * rows, [Component(1, 2, 2, 0), Component(2, 1, 1, 0), Component(3, 1, 1, 0)])
    _deal(image, data)
    out = [b"\xff\xd8", _segment(0xFE, str(len(payload)).encode()), _segment(0xDB, bytes([0]) + bytes([1]) * 64)]
    out.append(_segment(0xC2, struct.pack(">BHHB", 8, image.height, image.width, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])))
    out.append(_segment(0xC4, _dc_table() + bytes([0x10, 1, *[0] * 15, 8])))
    order = data.reshape(-1, _MCU_BLOCKS, 64)
    # DC, all components: differences to the block before of the same component, then bit 0
    dc = order[:, :, 0].astype(np.int64)
    high = dc >> 1
    before = np.zeros_like(high)
    before[:, 1:4] = high[:, 0:3]
    before[1:, 0], before[1:, 4], before[1:, 5] = high[:-1, 3], high[:-1, 4], high[:-1, 5]
    difference = (high - before).ravel()
    size = np.frexp(np.abs(difference))[1]
    value = np.where(difference < 0, difference + (1 << size) - 1, difference)
    field = np.concatenate([_field(size, 4), _field(value, 8)], axis=1)
    used = np.concatenate([np.ones((len(size), 4), bool), np.arange(8)[None, :] >= 8 - size[:, None]], axis=1)
    out.append(_scan([1, 2, 3], 0, 0, 0, 1, _packed(field[used])))
    for c in image.components:  # AC: one symbol of one bit, then the value's eight bits, the first of which is 1
        values = c.coefficients[:, 1:].ravel() >> 1
        bits = np.zeros((len(values), 9), np.uint8)
        bits[:, 1:] = np.unpackbits(values.astype(np.uint8)[:, None], axis=1)
        out.append(_scan([c.ident], 1, 63, 0, 1, _packed(bits.ravel())))
    out.append(_scan([1, 2, 3], 0, 0, 1, 0, _packed((dc.ravel() & 1).astype(np.uint8))))
    told = None
    for c in image.components:  # correction bits: runs of up to 32767 blocks that gain no new coefficient
        parts = []
        for s in range(0, len(c.coefficients), 32767):
            run = c.coefficients[s : s + 32767]
            exponent = len(run).bit_length() - 1
            parts.append((exponent, len(run) - (1 << exponent), (run[:, 1:] & 1).astype(np.uint8).ravel()))
        exponents = sorted({e for e, _, _ in parts})
        codes = 1 if len(exponents) == 1 else 2
        new = bytes([0x10, *([1] if codes == 1 else [0, len(exponents)]), *[0] * (16 - codes), *(e << 4 for e in exponents)])
        if new != told:
            out.append(_segment(0xC4, new))
            told = new
        bits = [np.concatenate([_field(np.array([exponents.index(e)]), codes)[0], _field(np.array([rest]), e)[0], low]) for e, rest, low in parts]
        out.append(_scan([c.ident], 1, 63, 1, 0, _packed(np.concatenate(bits))))
    return b"".join([*out, b"\xff\xd9"])


def _places(image: Image) -> list[tuple[Component, np.ndarray, slice]]:
    blocks = _order(image, image.components)[1].reshape(-1, _MCU_BLOCKS)
    return [(c, blocks[:, s], s) for c, s in zip(image.components, (slice(0, 4), slice(4, 5), slice(5, 6)), strict=True)]


def _deal(image: Image, data: np.ndarray) -> None:
    by_mcu = data.reshape(-1, _MCU_BLOCKS, 64)
    for c, blocks, s in _places(image):
        c.coefficients[blocks] = by_mcu[:, s]


def payload(image: Image) -> bytes:
    """What ``encode`` stored, from the coefficients."""
    by_mcu = np.empty((image.mcus_wide * image.mcus_high, _MCU_BLOCKS, 64), np.int16)
    for c, blocks, s in _places(image):
        by_mcu[:, s] = c.coefficients[blocks]
    values = by_mcu.ravel() - 256
    if values.min(initial=0) < 0 or values.max(initial=0) > 255:
        raise ValueError("the picture holds no payload")
    return values.astype(np.uint8).tobytes()[: int(image.comment)]
