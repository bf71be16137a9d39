"""A small GeoTIFF codec: single band, strips or tiles, predictors 1 to 3.

Reads classic and BigTIFF files, uncompressed or with deflate, LZW or Zstandard; writes
classic files, uncompressed or deflate.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import replace

import numpy as np

from ..model import GridMeta

# Fixed values of the format: sizes of field types, and tags.
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 16: 8, 17: 8, 18: 8}
CODES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q", 17: "q", 18: "Q"}
WIDTH, HEIGHT, BITS, COMPRESSION, STRIPS, SAMPLES, ROWS, STRIP_BYTES = 256, 257, 258, 259, 273, 277, 278, 279
PREDICTOR, TILE_W, TILE_H, TILES, TILE_BYTES, FORMAT = 317, 322, 323, 324, 325, 339
SCALE, TIEPOINT, MATRIX, GEOKEYS, NODATA = 33550, 33922, 34264, 34735, 42113
KINDS = {1: "u", 2: "i", 3: "f"}


def unpacked_lzw(data: bytes) -> bytes:
    """LZW as TIFF has it: codes of 9 to 12 bits, high bit first, one code early in growing; 256 clears, 257 ends."""
    out, table, last = [], [], b""
    bits = held = 0
    width = 9
    for byte in data:
        bits, held = bits << 8 | byte, held + 8
        if held < width:
            continue
        held -= width
        code = bits >> held
        bits &= (1 << held) - 1
        if code == 257:
            break
        if code == 256:
            table, width, last = [bytes((i,)) for i in range(256)] + [b"", b""], 9, b""
            continue
        item = table[code] if code < len(table) else last + last[:1]
        out.append(item)
        if last:
            table.append(last + item[:1])
        last = item
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return b"".join(out)


def unpacked_zstd(data: bytes) -> bytes:
    import zstandard  # only where a file needs it

    return zstandard.ZstdDecompressor().decompressobj().decompress(data)


#: How strips and tiles are unpacked, by the compression tag.
DECODERS = {1: bytes, 5: unpacked_lzw, 8: zlib.decompress, 32946: zlib.decompress, 50000: unpacked_zstd}


class Tiff:
    """The first image of a file given as bytes."""

    def __init__(self, data: bytes):
        self.data = data
        self.order = {b"II": "<", b"MM": ">"}.get(data[:2])
        version = struct.unpack(self.order + "H", data[2:4])[0] if self.order else 0
        if version not in (42, 43):
            raise ValueError("not a TIFF file")
        # Offsets and counts have 4 bytes in a classic file and 8 in a BigTIFF file.
        word, wide, start = ("I", 4, 4) if version == 42 else ("Q", 8, 8)
        at = struct.unpack(self.order + word, data[start : start + wide])[0]
        number = "H" if version == 42 else "Q"
        n_tags = struct.unpack_from(self.order + number, data, at)[0]
        at += struct.calcsize(number)
        self.tags = {}
        for i in range(n_tags):
            entry = at + (4 + 2 * wide) * i
            tag, kind, n = struct.unpack_from(f"{self.order}HH{word}", data, entry)
            size, place = SIZES.get(kind, 1) * n, entry + 4 + wide
            if size > wide:
                place = struct.unpack_from(self.order + word, data, place)[0]
            raw = data[place : place + size]
            self.tags[tag] = raw if kind in (2, 7) else struct.unpack(f"{self.order}{n}{CODES[kind]}", raw) if kind in CODES else raw
        if self.tag(SAMPLES) != 1:
            raise ValueError("only single-band rasters can be read")
        self.width, self.height = self.tag(WIDTH), self.tag(HEIGHT)
        self.dtype = np.dtype(f"{self.order}{KINDS[self.tag(FORMAT, 1)]}{self.tag(BITS, 8) // 8}")
        if self.tag(COMPRESSION) not in DECODERS:
            raise ValueError(f"unknown compression {self.tag(COMPRESSION)}")

    def tag(self, tag: int, default=1):
        return self.tags[tag][0] if tag in self.tags else default

    @property
    def nodata(self) -> float | None:
        raw = self.tags.get(NODATA)
        text = raw.rstrip(b"\0 ").decode() if raw else ""
        return (int(text) if text.lstrip("-").isdigit() else float(text)) if text else None

    @property
    def meta(self) -> GridMeta:
        a, c, e, f = 1.0, 0.0, -1.0, 0.0
        if MATRIX in self.tags:
            m = self.tags[MATRIX]
            a, c, e, f = m[0], m[3], m[5], m[7]
        elif SCALE in self.tags:
            s, t = self.tags[SCALE], self.tags.get(TIEPOINT, (0,) * 6)
            a, e = s[0], -s[1]
            c, f = t[3] - t[0] * a, t[4] - t[1] * e
        keys = self.tags.get(GEOKEYS, ())
        codes = {k: v for k, place, _, v in zip(keys[4::4], keys[5::4], keys[6::4], keys[7::4]) if place == 0}
        code = codes.get(3072) or codes.get(2048)
        meta = GridMeta(self.height, self.width, a=a, c=c, e=e, f=f, crs=f"EPSG:{code}" if code else None)
        degrees = {1: False, 2: True}.get(codes.get(1024)) if code else None  # the file's own model type
        return meta if degrees in (None, meta.geographic) else replace(meta, degrees=degrees)

    def parts(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """(first row, first column, values) of each strip or tile."""
        tiled = TILES in self.tags
        w, h = (self.tag(TILE_W), self.tag(TILE_H)) if tiled else (self.width, min(self.tag(ROWS, self.height), self.height))
        across = -(-self.width // w)
        for k, (at, n) in enumerate(zip(self.tags[TILES if tiled else STRIPS], self.tags[TILE_BYTES if tiled else STRIP_BYTES])):
            raw = self.data[at : at + n]
            raw = DECODERS[self.tag(COMPRESSION)](raw)
            r, c = k // across * h, k % across * w
            rows = h if tiled else min(h, self.height - r)
            x = self.unpredicted(raw, rows, w)
            yield r, c, x[: self.height - r, : self.width - c]

    def unpredicted(self, raw: bytes, rows: int, w: int) -> np.ndarray:
        if self.tag(PREDICTOR) == 3:
            size = self.dtype.itemsize
            planes = np.frombuffer(raw, np.uint8).reshape(rows, w * size)
            planes = np.cumsum(planes, axis=1, dtype=np.uint8).reshape(rows, size, w)  # most significant byte first
            return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(self.dtype.newbyteorder(">"))[..., 0]
        x = np.frombuffer(raw, self.dtype).reshape(rows, w)
        return np.cumsum(x, axis=1, dtype=self.dtype.newbyteorder("=")) if self.tag(PREDICTOR) == 2 else x


def encode(rows: Iterable[np.ndarray], meta: GridMeta, dtype: str, nodata: float | None, out, compress: str = "deflate") -> None:
    """Write rows, top down, as strips of one row each."""
    if compress not in ("deflate", "none"):
        raise ValueError(f"unknown compression {compress}")
    kind = np.dtype("<" + np.dtype(dtype).str[1:]) if np.dtype(dtype).itemsize > 1 else np.dtype(dtype)
    out.write(b"II*\0\0\0\0\0")
    at, offsets, sizes = 8, [], []
    for row in rows:
        x = np.ascontiguousarray(row, kind)
        if compress == "deflate":
            if kind.kind == "f":
                planes = x.astype(kind.newbyteorder(">")).view(np.uint8).reshape(-1, kind.itemsize).T.ravel()
                raw = np.diff(planes, prepend=np.uint8(0)).tobytes()
            else:
                raw = np.diff(x, prepend=x.dtype.type(0)).astype(kind).tobytes()
            raw = zlib.compress(raw)
        else:
            raw = x.tobytes()
        offsets.append(at)
        sizes.append(len(raw))
        out.write(raw)
        at += len(raw)
    predictor = 1 if compress == "none" else 3 if kind.kind == "f" else 2
    code = int(meta.crs.split(":")[1]) if meta.crs and meta.crs.upper().startswith("EPSG:") and meta.crs.split(":")[1].isdigit() else 0
    keys = (1, 1, 0, 3, 1024, 0, 1, 2 if meta.geographic else 1, 1025, 0, 1, 1, 2048 if meta.geographic else 3072, 0, 1, code) if code else ()
    fields = [
        (WIDTH, 4, (meta.ncols,)), (HEIGHT, 4, (meta.nrows,)), (BITS, 3, (kind.itemsize * 8,)), (COMPRESSION, 3, (8 if compress == "deflate" else 1,)), (262, 3, (1,)),
        (STRIPS, 4, tuple(offsets)), (SAMPLES, 3, (1,)), (ROWS, 4, (1,)), (STRIP_BYTES, 4, tuple(sizes)), (PREDICTOR, 3, (predictor,)), (FORMAT, 3, ({"u": 1, "i": 2, "f": 3}[kind.kind],)),
        (SCALE, 12, (meta.a, -meta.e, 0.0)), (TIEPOINT, 12, (0.0, 0.0, 0.0, meta.c, meta.f, 0.0)),
    ]
    fields += [(GEOKEYS, 3, keys)] if keys else []
    fields += [(NODATA, 2, str(nodata).encode() + b"\0")] if nodata is not None else []
    start = at + at % 2
    out.write(b"\0" * (at % 2))
    beyond = start + 2 + 12 * len(fields) + 4
    table, extra = struct.pack("<H", len(fields)), b""
    for tag, t, values in fields:
        raw = values if t == 2 else struct.pack(f"<{len(values)}{CODES[t]}", *values)
        place = raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack("<I", beyond + len(extra))
        extra += raw + b"\0" * (len(raw) % 2) if len(raw) > 4 else b""
        table += struct.pack("<HHI", tag, t, len(values)) + place
    out.write(table + b"\0\0\0\0" + extra)
    out.seek(4)
    out.write(struct.pack("<I", start))
