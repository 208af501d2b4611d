"""Baseline JPEG in numpy: a decoder of the DC coefficients, and a lossless writer for 8-bit samples.

The decoder reads markers, Huffman-decodes every scan (AC symbols are stepped over) and keeps the luminance DC
coefficients: the picture at an eighth of its size. All restart intervals of a batch advance together, one symbol a
step, so files with restart markers decode at numpy's speed; a file without them is one interval.

The writer stores one sample a block as that block's only coefficient. With the quantizer at 8 the mean of the block
is the sample itself, so the DC thumbnail of the file is the stored payload, bit for bit.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

#: Fixed values of the JPEG standard (ITU T.81, table K.3): luminance DC code counts by length, and their symbols.
DC_COUNTS = (0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0)
DC_SYMBOLS = tuple(range(12))
#: The writer's AC table holds the end of block alone, as a code of one bit.
AC_COUNTS = (1, *[0] * 15)
AC_SYMBOLS = (0,)
#: Blocks in a row of a stored payload, rows in a file at most (the format's 65,535 lines), and the DC quantizer.
ACROSS, MOST_ROWS, QUANT = 64, 8191, 8


class JpegError(ValueError):
    """The bytes aren't a baseline JPEG."""


@dataclass
class Frame:
    width: int
    height: int
    parts: list[tuple[int, int, int, int]]  # id, across and down samplings, quantizer
    quant: dict[int, int] = field(default_factory=dict)
    dc: dict[int, tuple] = field(default_factory=dict)
    ac: dict[int, tuple] = field(default_factory=dict)
    interval: int = 0
    scans: list[tuple[list[tuple[int, int, int]], np.ndarray]] = field(default_factory=list)


def parse(data: bytes) -> list[Frame]:
    """The frames of one or more JPEG files set end to end."""
    frames, at, n = [], 0, len(data)
    while at < n:
        if data[at : at + 2] != b"\xff\xd8":
            raise JpegError(f"no start of image at byte {at}")
        at, frame, quant, dc, ac, interval = at + 2, None, {}, {}, {}, 0
        while True:
            while at < n and data[at : at + 2] == b"\xff\xff":
                at += 1
            if at + 2 > n or data[at] != 0xFF:
                raise JpegError(f"no marker at byte {at}")
            mark, at = data[at + 1], at + 2
            if mark == 0xD9:
                break
            if 0xD0 <= mark <= 0xD7 or mark == 0x01:
                continue
            size = int.from_bytes(data[at : at + 2], "big")
            if size < 2 or at + size > n:
                raise JpegError("a segment is cut short")
            body, at = data[at + 2 : at + size], at + size
            if mark == 0xDB:
                while body:
                    wide = body[0] >> 4
                    quant[body[0] & 15] = int.from_bytes(body[1 : 2 + wide], "big")
                    body = body[1 + 64 * (1 + wide) :]
            elif mark == 0xC4:
                while body:
                    counts = tuple(body[1:17])
                    (ac if body[0] >> 4 else dc)[body[0] & 15] = (counts, tuple(body[17 : 17 + sum(counts)]))
                    body = body[17 + sum(counts) :]
            elif mark == 0xC0:
                if body[0] != 8:
                    raise JpegError("samples aren't of 8 bits")
                parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
                frame = Frame(int.from_bytes(body[3:5], "big"), int.from_bytes(body[1:3], "big"), parts)
                if not (frame.width and frame.height and parts):
                    raise JpegError("an empty frame")
            elif 0xC1 <= mark <= 0xCF and mark not in (0xC8, 0xCC):
                raise JpegError("not baseline")
            elif mark == 0xDD:
                interval = int.from_bytes(body[:2], "big")
            elif mark == 0xDA:
                if frame is None:
                    raise JpegError("a scan before its frame")
                who = [(body[1 + 2 * i], body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])]
                end = at
                while True:  # the next marker that is neither a stuffed byte nor a restart
                    end = data.find(b"\xff", end)
                    if end < 0 or end + 1 >= n:
                        raise JpegError("a scan without an end")
                    if data[end + 1] == 0 or 0xD0 <= data[end + 1] <= 0xD7:
                        end += 2
                        continue
                    break
                frame.scans.append((who, np.frombuffer(data, np.uint8, end - at, at)))
                frame.quant, frame.dc, frame.ac, frame.interval, at = dict(quant), dict(dc), dict(ac), interval, end
        if frame is None or not frame.scans:
            raise JpegError("no picture")
        frames.append(frame)
    return frames


def lookup(table: tuple) -> tuple[np.ndarray, np.ndarray]:
    """By the next 16 bits: the symbol, and the length of its code (0: no code)."""
    counts, symbols = table
    sym, size, code, k = np.zeros(1 << 16, np.uint8), np.zeros(1 << 16, np.uint8), 0, 0
    for bits, count in enumerate(counts, 1):
        for _ in range(count):
            lo = code << (16 - bits)
            sym[lo : lo + (1 << (16 - bits))], size[lo : lo + (1 << (16 - bits))] = symbols[k], bits
            code, k = code + 1, k + 1
        code <<= 1
    return sym, size


def unstuffed(data: np.ndarray) -> list[np.ndarray]:
    """The restart intervals of a scan without their stuffed bytes."""
    ff = np.flatnonzero(data[:-1] == 0xFF)
    if not len(ff):
        return [data]
    after = data[ff + 1]
    keep = np.ones(len(data), bool)
    keep[ff[after == 0] + 1] = False
    cuts = ff[(after >= 0xD0) & (after <= 0xD7)]
    keep[cuts] = keep[cuts + 1] = False
    return np.split(data[keep], np.cumsum(keep)[cuts]) if len(cuts) else [data[keep]]


def entropy_decode(lanes: list[np.ndarray], blocks: np.ndarray, order: list[tuple[int, tuple, tuple]]) -> dict[int, np.ndarray]:
    """Quantized DC values by part: lanes x that part's blocks. order: (part, DC table, AC table) of an MCU's blocks."""
    size = np.array([len(x) for x in lanes])
    if (blocks > 8 * size).any():  # a block takes a bit at least, whatever dimensions the header claims
        raise JpegError("a scan is cut short")
    start = np.concatenate([[0], np.cumsum(size + 4)[:-1]])
    buf = np.full(int((size + 4).sum()) + 4, 0xFF, np.uint8)
    buf[np.arange(int(size.sum())) + np.repeat(4 * np.arange(len(lanes)), size)] = np.concatenate(lanes) if len(lanes) > 1 else lanes[0]
    wide = (buf[:-2].astype(np.uint32) << 16) | (buf[1:-1].astype(np.uint32) << 8) | buf[2:]
    pos, stop = start * 8, (start + size) * 8
    peek = lambda p: ((wide[p >> 3] >> (8 - (p & 7)).astype(np.uint32)) & 0xFFFF).astype(np.int64)
    tables = {t: lookup(t) for _, d, a in order for t in (d, a)}
    most = int(blocks.max())
    each = [sum(1 for p, _, _ in order if p == q) for q in range(1 + max(p for p, _, _ in order))]
    out = {q: np.zeros((len(lanes), -(-most // len(order)) * n), np.int32) for q, n in enumerate(each) if n}
    pred = np.zeros((len(each), len(lanes)), np.int64)
    seen = [0] * len(each)
    even = bool((blocks == most).all())
    for b in range(most):
        part, dc, ac = order[b % len(order)]
        live = slice(None) if even else np.flatnonzero(blocks > b)
        p = pos[live]
        bits = peek(p)
        sym, size16 = tables[dc]
        s, used = sym[bits].astype(np.int64), size16[bits].astype(np.int64)
        if not used.all():
            raise JpegError("a DC code that is in no table")
        p = p + used
        raw = peek(p) >> (16 - s)
        pred[part, live] += np.where((raw >> np.maximum(s - 1, 0) == 0) & (s > 0), raw - (1 << s) + 1, raw)
        out[part][live, seen[part]] = pred[part, live]
        seen[part] += 1
        p += s
        sym, size16 = tables[ac]
        k, todo = np.ones(len(p), np.int64), np.arange(len(p))
        while len(todo):
            q = p[todo]
            bits = peek(q)
            v, used = sym[bits].astype(np.int64), size16[bits].astype(np.int64)
            if not used.all():
                raise JpegError("an AC code that is in no table")
            p[todo] = q + used + (v & 15)
            k[todo] = np.where(v == 0, 64, k[todo] + (v >> 4) + 1)
            todo = todo[k[todo] < 64]
        pos[live] = p
    if (pos > stop).any():
        raise JpegError("a scan is cut short")
    return out


def thumbnails(files: list[bytes]) -> list[tuple[int, int, np.ndarray]]:
    """Of each file: width, height, and its luminance at an eighth of the size (of several pictures: one above the other)."""
    frames = [parse(x) for x in files]
    lots: dict[tuple, list] = {}
    for i, own in enumerate(frames):
        for j, f in enumerate(own):
            for who, data in f.scans:
                index = {c: n for n, (c, *_) in enumerate(f.parts)}
                if not any(index[c] == 0 for c, _, _ in who):
                    continue
                order = []
                for c, d, a in who:
                    h, v = f.parts[index[c]][1:3] if len(who) > 1 else (1, 1)
                    order += [(index[c], f.dc[d], f.ac[a])] * (h * v)
                lots.setdefault(tuple(order), []).append((i, j, f, len(who), unstuffed(data)))
    made: dict[tuple[int, int], np.ndarray] = {}
    for order, scans in lots.items():
        lanes, blocks, plans = [], [], []
        for i, j, f, parts, own in scans:
            high, low = max(p[1] for p in f.parts), max(p[2] for p in f.parts)
            _, h, v, q = f.parts[0]
            if parts > 1:
                across, down, bh, bv = -(-f.width // (8 * high)), -(-f.height // (8 * low)), h, v
            else:
                across, down, bh, bv = -(-(-(-f.width * h // high)) // 8), -(-(-(-f.height * v // low)) // 8), 1, 1
            mcus = across * down
            step = f.interval or mcus
            if len(own) != -(-mcus // step):
                raise JpegError("restart intervals are missing")
            plans.append((i, j, f, across, down, bh, bv, q, len(lanes), len(own)))
            lanes += own
            blocks += [len(order) * min(step, mcus - k * step) for k in range(len(own))]
        got = entropy_decode(lanes, np.array(blocks), list(order))[0]
        per = sum(1 for p, _, _ in order if p == 0)
        for i, j, f, across, down, bh, bv, q, lo, n in plans:
            step = (f.interval or across * down) * per
            flat = got[lo : lo + n, :step].reshape(-1)[: across * down * per]
            grid = flat.reshape(down, across, bv, bh).transpose(0, 2, 1, 3).reshape(down * bv, across * bh)
            high, low = max(p[1] for p in f.parts), max(p[2] for p in f.parts)
            rows, cols = -(-(-(-f.height * f.parts[0][2] // low)) // 8), -(-(-(-f.width * f.parts[0][1] // high)) // 8)
            made[i, j] = np.clip((grid[:rows, :cols] * f.quant[q] + 4) // 8 + 128, 0, 255).astype(np.uint8)
    out = []
    for i, own in enumerate(frames):
        if any((i, j) not in made for j in range(len(own))):
            raise JpegError("no luminance scan")
        out.append((own[0].width, sum(f.height for f in own), np.concatenate([made[i, j] for j in range(len(own))]) if len(own) > 1 else made[i, 0]))
    return out


def segment(mark: int, body: bytes) -> bytes:
    return bytes((0xFF, mark)) + (len(body) + 2).to_bytes(2, "big") + body


def header(rows: int) -> bytes:
    size = (8 * rows).to_bytes(2, "big") + (8 * ACROSS).to_bytes(2, "big")
    return (
        b"\xff\xd8" + segment(0xDB, b"\0" + bytes([QUANT] * 64)) + segment(0xC0, b"\x08" + size + b"\x01\x01\x11\x00")
        + segment(0xC4, b"\x00" + bytes(DC_COUNTS) + bytes(DC_SYMBOLS)) + segment(0xC4, b"\x10" + bytes(AC_COUNTS) + bytes(AC_SYMBOLS))
        + segment(0xDD, ACROSS.to_bytes(2, "big")) + segment(0xDA, b"\x01\x01\x00\x00\x3f\x00")
    )


def writer_codes() -> tuple[np.ndarray, np.ndarray]:
    """By difference + 255: the bits of a whole block (DC code, its extra bits, end of block), and their number."""
    codes, code, k = {}, 0, 0
    for bits, count in enumerate(DC_COUNTS, 1):
        for _ in range(count):
            codes[DC_SYMBOLS[k]] = (code, bits)
            code, k = code + 1, k + 1
        code <<= 1
    value, size = np.zeros(511, np.int64), np.zeros(511, np.int64)
    for d in range(-255, 256):
        cat = abs(d).bit_length()
        head, bits = codes[cat]
        value[d + 255], size[d + 255] = ((head << cat) | (d if d >= 0 else d + (1 << cat) - 1)) << 1, bits + cat + 1
    return value, size


_VALUE, _SIZE = writer_codes()


def store(payloads: list[bytes]) -> list[bytes]:
    """Each payload, of a positive multiple of 64 bytes, as a JPEG (over 8,191 rows: as several, end to end)."""
    grid = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, ACROSS).astype(np.int16)
    diff = np.diff(grid, axis=1, prepend=np.int16(128)) + 255
    value, size = _VALUE[diff], _SIZE[diff]
    ends = np.cumsum(size, axis=1)
    length = (ends[:, -1] + 7) >> 3
    base = np.concatenate([[0], np.cumsum(length)[:-1]])
    at = base[:, None] * 8 + ends - size
    total = int(length.sum())
    put = (value << (24 - size - (at & 7))).reshape(-1)
    byte = (at >> 3).reshape(-1)
    buf = np.zeros(total + 2, np.int64)
    for k, shift in enumerate((16, 8, 0)):
        buf[: total + 2] += np.bincount(byte + k, (put >> shift) & 255, total + 2).astype(np.int64)
    buf[base + length - 1] |= (1 << (length * 8 - ends[:, -1])) - 1
    raw = buf[:total].astype(np.uint8)
    # stuffed bytes after 0xFF, and two bytes for the restart marker before every interval but a file's first
    rows = [len(p) // ACROSS for p in payloads]
    number = np.concatenate([np.arange(r) % MOST_ROWS for r in rows])
    ff = raw == 0xFF
    lane = np.repeat(np.arange(len(length)), length)
    to = np.arange(total) + np.cumsum(ff) - ff + 2 * (lane + 1)
    room = np.zeros(total + int(ff.sum()) + 2 * len(length), np.uint8)
    room[to] = raw
    head = to[base] - 2
    room[head], room[head + 1] = 0xFF, 0xD0 + (number - 1) % 8
    edges = np.append(head, len(room))
    flat = room.tobytes()
    out, lane = [], 0
    for r in rows:
        files = []
        for lo in range(0, r, MOST_ROWS):
            n = min(MOST_ROWS, r - lo)
            files.append(header(n) + flat[edges[lane + lo] + 2 : edges[lane + lo + n]] + b"\xff\xd9")
        out.append(b"".join(files))
        lane += r
    return out


def average_hash(thumb: np.ndarray) -> str:
    """64 bits in hex: is the mean of each cell of an 8 x 8 grid over the thumbnail above the mean of all?"""
    rows, cols = (np.arange(8) * n // 8 for n in thumb.shape)
    sums = np.add.reduceat(np.add.reduceat(thumb, rows, 0, dtype=np.int64), cols, 1)
    h = np.diff(np.append(rows, thumb.shape[0])).clip(1)
    w = np.diff(np.append(cols, thumb.shape[1])).clip(1)
    bits = sums * thumb.size > int(thumb.sum(dtype=np.int64)) * np.outer(h, w)
    return np.packbits(bits.reshape(-1)).tobytes().hex()

