"""Tiny PNG files without an image library."""

import struct
import zlib

import numpy as np


def write_png(path, pixels: np.ndarray) -> None:
    """``height x width x 3`` (RGB) or ``height x width`` (grey) bytes."""
    height, width = pixels.shape[:2]
    colour = 2 if pixels.ndim == 3 else 0
    lines = b"".join(b"\0" + pixels[row].astype(np.uint8).tobytes() for row in range(height))

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    header = struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b""))
