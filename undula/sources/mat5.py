"""A reader (and small writer, for fixtures) of MATLAB level 5 files: numbers, text, structs and cells, compressed or not, either byte order."""

from __future__ import annotations

import struct
import zlib

import numpy as np

#: Element types and array classes of the format (fixed values).
NUMBERS = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8"}
TEXT = {16: "utf-8", 17: "utf-16", 18: "utf-32"}
MATRIX, COMPRESSED = 14, 15
CELL, STRUCT, CHAR = 1, 2, 4


class _Reader:
    def __init__(self, data: bytes, order: str):
        self.data, self.order = data, order

    def element(self, at: int) -> tuple[int, bytes, int]:
        """Type, body and end (aligned) of the element at a place."""
        kind, size = struct.unpack_from(self.order + "II", self.data, at)
        if kind >> 16:  # a small element: its size shares the first word
            return kind & 0xFFFF, self.data[at + 4 : at + 4 + (kind >> 16)], at + 8
        body = self.data[at + 8 : at + 8 + size]
        if len(body) < size:
            raise ValueError("the file is cut off")
        return kind, body, at + 8 + size + (0 if kind == COMPRESSED else -size % 8)

    def elements(self):
        at = 0
        while at + 8 <= len(self.data):
            kind, body, at = self.element(at)
            yield kind, body

    def numbers(self, kind: int, body: bytes) -> np.ndarray:
        if kind not in NUMBERS:
            raise ValueError(f"elements of type {kind} are not numbers")
        return np.frombuffer(body, dtype=np.dtype(NUMBERS[kind]).newbyteorder(self.order))

    def matrix(self, body: bytes):
        """Name and value: an array (Fortran order), a string, a list of cells, or a list of dicts for a struct array."""
        if not body:
            return "", np.zeros(0)
        inner = _Reader(body, self.order)
        parts = inner.elements()
        kind, raw = next(parts)
        flags = self.numbers(kind, raw)
        dims = self.numbers(*next(parts)).astype(int)
        name = bytes(next(parts)[1]).decode("latin-1")
        cls, size = int(flags[0]) & 0xFF, int(np.prod(dims))
        if cls == CELL:
            return name, [inner.matrix(next(parts)[1])[1] for _ in range(size)]
        if cls == STRUCT:
            width = int(self.numbers(*next(parts))[0])
            raw = next(parts)[1]
            fields = [raw[i : i + width].split(b"\0")[0].decode("latin-1") for i in range(0, len(raw), width)] if width else []
            return name, [{f: inner.matrix(next(parts)[1])[1] for f in fields} for _ in range(size)]
        kind, raw = next(parts, (9, b""))
        if cls == CHAR:
            codes = raw.decode(TEXT[kind]) if kind in TEXT else "".join(map(chr, self.numbers(kind, raw)))
            if len(dims) == 2 and dims[0] > 1:  # a row of the matrix is a line
                return name, [codes[i :: dims[0]] for i in range(dims[0])]
            return name, codes
        return name, self.numbers(kind, raw).astype(float).reshape(dims, order="F")


def read(content: bytes) -> dict:
    """The variables of a file."""
    if len(content) < 128:
        raise ValueError("not a MATLAB 5 file")
    order = {b"IM": "<", b"MI": ">"}.get(content[126:128])
    if order is None:
        raise ValueError("not a MATLAB 5 file")
    out = {}
    for kind, body in _Reader(content[128:], order).elements():
        if kind == COMPRESSED:
            kind, body, _ = _Reader(zlib.decompress(body), order).element(0)
        if kind == MATRIX:
            name, value = _Reader(b"", order).matrix(body)
            out[name] = value
    return out


def _element(kind: int, body: bytes) -> bytes:
    return struct.pack("<II", kind, len(body)) + body + bytes(-len(body) % 8)


def _matrix(name: str, value) -> bytes:
    if isinstance(value, str):
        cls, dims, body = CHAR, (1, len(value)), _element(4, value.encode("utf-16-le"))
    elif isinstance(value, dict) or isinstance(value, list) and value and isinstance(value[0], dict):
        rows = [value] if isinstance(value, dict) else value
        names = list(rows[0])
        head = _element(5, struct.pack("<i", 32)) + _element(1, b"".join(n.encode().ljust(32, b"\0") for n in names))
        cls, dims, body = STRUCT, (1, len(rows)), head + b"".join(_matrix("", r[n]) for r in rows for n in names)
    elif isinstance(value, list) and any(isinstance(v, str | list) for v in value):
        cls, dims, body = CELL, (1, len(value)), b"".join(_matrix("", v) for v in value)
    else:
        a = np.asarray(value, dtype=float)
        a = a.reshape(1, -1) if a.ndim < 2 else a
        cls, dims, body = 6, a.shape, _element(9, a.tobytes(order="F"))
    return _element(MATRIX, _element(6, struct.pack("<II", cls, 0)) + _element(5, struct.pack("<ii", *dims)) + _element(1, name.encode()) + body)


def write(variables: dict, compress: bool = False) -> bytes:
    out = b"MATLAB 5.0 MAT-file".ljust(124, b" ") + struct.pack("<H", 0x0100) + b"IM"
    for name, value in variables.items():
        m = _matrix(name, value)
        if compress:
            z = zlib.compress(m)
            m = struct.pack("<II", COMPRESSED, len(z)) + z
        out += m
    return out
