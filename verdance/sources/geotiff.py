"""GeoTIFF in NumPy: enough of the format for single and multi-band rasters.

Reads classic little- and big-endian files in strips or tiles, uncompressed, LZW
or deflate, with horizontal or floating-point differencing, and a mask page or
nodata value.  Rotated grids and other predictors are refused.
Writes strips with deflate, LZW or nothing.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass
from typing import BinaryIO

import numpy as np

_SIZE = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
_CODE = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d"}
_KIND = {(1, 8): "u1", (1, 16): "u2", (1, 32): "u4", (2, 8): "i1", (2, 16): "i2", (2, 32): "i4", (3, 32): "f4", (3, 64): "f8"}


@dataclass
class Raster:
    """bands: (count, height, width); valid: (height, width)."""

    bands: np.ndarray
    valid: np.ndarray
    left: float = 0.0
    top: float = 0.0
    dx: float = 1.0
    dy: float = -1.0
    crs: str = ""
    nodata: float | None = None


def unlzw(data: bytes) -> bytes:
    """TIFF's LZW: codes of 9 to 12 bits, most significant bit first."""
    table: list[bytes] = []
    out: list[bytes] = []
    bits = width = at = 0
    width, held, last = 9, 0, None
    while True:
        while bits < width:
            if at >= len(data):
                return b"".join(out)
            held, bits, at = (held << 8) | data[at], bits + 8, at + 1
        code = (held >> (bits - width)) & ((1 << width) - 1)
        bits -= width
        held &= (1 << bits) - 1
        if code == 257:
            return b"".join(out)
        if code == 256:
            table, width, last = [bytes([i]) for i in range(256)] + [b"", b""], 9, None
            continue
        if last is None:
            entry = table[code]
        else:
            entry = table[code] if code < len(table) else last + last[:1]
            table.append(last + entry[:1])
            if len(table) + 1 >= 1 << width and width < 12:
                width += 1
        out.append(entry)
        last = entry


def lzw(data: bytes) -> bytes:
    out, held, bits = bytearray(), 0, 0

    def put(code: int, width: int) -> None:
        nonlocal held, bits
        held, bits = (held << width) | code, bits + width
        while bits >= 8:
            out.append((held >> (bits - 8)) & 255)
            bits -= 8
        held &= (1 << bits) - 1

    table = {bytes([i]): i for i in range(256)}
    width, seen = 9, b""
    put(256, width)
    for i in range(len(data)):
        more = seen + data[i:i + 1]
        if more in table:
            seen = more
            continue
        put(table[seen], width)
        table[more] = len(table) + 2  # after the codes for clear and end
        free = len(table) + 2
        if free == 4094:
            put(256, width)
            table, width = {bytes([i]): i for i in range(256)}, 9
        elif free >= 1 << width:
            width += 1
        seen = data[i:i + 1]
    if seen:
        put(table[seen], width)
        if len(table) + 3 >= 1 << width and width < 12:
            width += 1
    put(257, width)
    if bits:
        out.append((held << (8 - bits)) & 255)
    return bytes(out)


def _pages(data: bytes) -> tuple[str, list[dict[int, tuple]]]:
    order = {b"II": "<", b"MM": ">"}[data[:2]]
    if struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("not a classic TIFF")
    at, pages = struct.unpack_from(order + "I", data, 4)[0], []
    while at:
        n = struct.unpack_from(order + "H", data, at)[0]
        tags: dict[int, tuple] = {}
        for i in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
            where = at + 10 + 12 * i
            if _SIZE.get(kind, 1) * count > 4:
                where = struct.unpack_from(order + "I", data, where)[0]
            if kind == 2:
                tags[tag] = (data[where:where + count].rstrip(b"\0").decode("latin-1"),)
            elif kind in _CODE:
                tags[tag] = struct.unpack_from(f"{order}{count}{_CODE[kind]}", data, where)
        pages.append(tags)
        at = struct.unpack_from(order + "I", data, at + 2 + 12 * n)[0]
    return order, pages


def _image(data: bytes, order: str, tags: dict[int, tuple]) -> np.ndarray:
    one = lambda tag, default=None: tags.get(tag, (default,))[0]
    width, height, count = one(256), one(257), one(277, 1)
    kind = np.dtype(order + _KIND[one(339, 1), one(258, 8)]) if one(258, 1) != 1 else np.dtype("u1")
    packed = one(258, 1) == 1
    tiled = 322 in tags
    tw, th = (one(322), one(323)) if tiled else (width, min(one(278, height), height))
    offsets, sizes = (tags[324], tags[325]) if tiled else (tags[273], tags[279])
    across, down = -(-width // tw), -(-height // th)
    apart = one(284, 1) == 2
    depth = 1 if apart else count
    out = np.zeros((count, down * th, across * tw), kind.newbyteorder("="))
    for i, (offset, size) in enumerate(zip(offsets, sizes)):
        raw = data[offset:offset + size]
        raw = {1: lambda b: b, 5: unlzw, 8: zlib.decompress, 32946: zlib.decompress}[one(259, 1)](raw)
        plane, cell = divmod(i, across * down) if apart else (0, i)
        y, x = divmod(cell, across)
        rows = th if tiled else min(th, height - y * th)
        if one(317, 1) == 3:  # differences of bytes, the most significant of all samples first
            planes = np.cumsum(np.frombuffer(raw, np.uint8, rows * tw * depth * kind.itemsize).reshape(rows, -1, depth), axis=1, dtype=np.uint8)
            block = np.ascontiguousarray(planes.reshape(rows, kind.itemsize, -1).transpose(0, 2, 1)).view(kind.newbyteorder(">")).reshape(rows, tw, depth)
        elif packed:
            block = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(rows, -1), axis=1)[:, :tw, None]
        else:
            block = np.frombuffer(raw, kind, rows * tw * depth).reshape(rows, tw, depth)
        if one(317, 1) not in (1, 2, 3):
            raise ValueError(f"predictor {one(317)} is not known")
        if one(317, 1) == 2:
            block = np.cumsum(block, axis=1, dtype=kind.newbyteorder("="))
        for b in range(depth):
            out[plane + b, y * th:y * th + rows, x * tw:x * tw + tw] = block[:, :, b]
    return out[:, :height, :width]


def profile(data: bytes) -> Raster:
    """Everything but the pixels."""
    _, pages = _pages(data)
    t = pages[0]
    shape = (t.get(277, (1,))[0], t[257][0], t[256][0])
    return _placed(t, np.broadcast_to(np.zeros(1), shape), np.broadcast_to(np.ones(1, bool), shape[1:]))


def _placed(t: dict[int, tuple], bands: np.ndarray, valid: np.ndarray) -> Raster:
    scale, tie = t.get(33550, (1.0, 1.0, 0.0)), t.get(33922, (0.0,) * 6)
    if 34264 in t:  # a matrix instead of a scale and a tie point
        m = t[34264]
        if m[1] or m[4]:
            raise ValueError("the grid is rotated")
        scale, tie = (m[0], -m[5], 0.0), (0.0, 0.0, 0.0, m[3], m[7], 0.0)
    keys = t.get(34735, ())
    codes = {keys[i]: keys[i + 3] for i in range(4, len(keys) - 3, 4) if keys[i + 1] == 0}
    code = codes.get(3072) or codes.get(2048)
    return Raster(bands, valid, tie[3] - tie[0] * scale[0], tie[4] + tie[1] * scale[1], scale[0], -scale[1], f"EPSG:{code}" if code else "", float(t[42113][0]) if 42113 in t else None)


#: Bytes in which a file's header is looked for before all of it is read.
HEAD = 1 << 16


def profile_of(f: BinaryIO) -> Raster:
    """profile() of an open file, from its first bytes where these hold the header."""
    head = f.read(HEAD)
    try:
        return profile(head)
    except (struct.error, IndexError, KeyError):
        return profile(head + f.read())


def read(data: bytes) -> Raster:
    order, pages = _pages(data)
    bands = _image(data, order, pages[0])
    valid = np.ones(bands.shape[1:], bool)
    out = _placed(pages[0], bands, valid)
    mask = next((p for p in pages[1:] if p.get(254, (0,))[0] & 4), None)
    if mask is not None:
        out.valid = _image(data, order, mask)[0] > 0
    elif out.nodata is not None:
        out.valid = ~np.isnan(bands[0]) if np.isnan(out.nodata) else bands[0] != out.nodata
    return out


def write(r: Raster, compression: str = "deflate", mask: bool = False) -> bytes:
    """The file's bytes, in strips; mask: with a page that has the valid pixels."""
    pack = {"none": (1, lambda b: b), "lzw": (5, lzw), "deflate": (8, zlib.compress)}[compression]
    out = bytearray(b"II" + struct.pack("<HI", 42, 0))
    link = 4

    def page(bands: np.ndarray, more: list[tuple[int, int, tuple]]) -> None:
        nonlocal link
        count, height, width = bands.shape
        step = max(1, (1 << 16) // max(1, width * count * bands.itemsize))
        offsets, sizes = [], []
        for y in range(0, height, step):
            strip = pack[1](np.ascontiguousarray(bands[:, y:y + step].transpose(1, 2, 0)).astype(bands.dtype.newbyteorder("<")).tobytes())
            offsets.append(len(out))
            sizes.append(len(strip))
            out.extend(strip)
        form = {"u": 1, "i": 2, "f": 3}[bands.dtype.kind]
        tags = [(256, 4, (width,)), (257, 4, (height,)), (258, 3, (8 * bands.itemsize,) * count), (259, 3, (pack[0],)), (262, 3, (1,)), (273, 4, tuple(offsets)), (277, 3, (count,)), (278, 4, (step,)), (279, 4, tuple(sizes)), (284, 3, (1,)), (339, 3, (form,) * count), *more]
        rows = []
        for tag, kind, values in sorted(tags):
            body = values[0].encode() + b"\0" if kind == 2 else struct.pack(f"<{len(values)}{_CODE[kind]}", *values)
            n = len(body) if kind == 2 else len(values)
            if len(body) <= 4:
                rows.append(struct.pack("<HHI", tag, kind, n) + body.ljust(4, b"\0"))
            else:
                rows.append(struct.pack("<HHII", tag, kind, n, len(out)))
                out.extend(body)
        if len(out) % 2:
            out.append(0)
        struct.pack_into("<I", out, link, len(out))
        out.extend(struct.pack("<H", len(rows)) + b"".join(rows))
        link = len(out)
        out.extend(b"\0\0\0\0")

    more: list[tuple[int, int, tuple]] = [(33550, 12, (r.dx, -r.dy, 0.0)), (33922, 12, (0.0, 0.0, 0.0, r.left, r.top, 0.0))]
    if r.crs.startswith("EPSG:"):
        code = int(r.crs[5:])
        geographic = 4000 <= code < 5000
        more.append((34735, 3, (1, 1, 0, 2, 1024, 0, 1, 2 if geographic else 1, 2048 if geographic else 3072, 0, 1, code)))
    if r.nodata is not None:
        more.append((42113, 2, (f"{r.nodata:g}",)))
    page(r.bands, more)
    if mask:
        page((r.valid[None] * np.uint8(255)).astype(np.uint8), [(254, 4, (4,))])
    return bytes(out)
