"""Small generated inputs: PNG files, image rows and register frames."""

import struct
import zlib

import numpy as np


def png(pixels: np.ndarray) -> bytes:
    """Encode height x width x 3 RGB."""
    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    height, width = pixels.shape[:2]
    raw = b"".join(b"\x00" + pixels[y].astype(np.uint8).tobytes() for y in range(height))
    head = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def image_row(name: str, bgr: np.ndarray) -> tuple:
    return (name, bgr.shape[0], bgr.shape[1], 3, bytearray(bgr.astype(np.uint8).tobytes()))


IMAGE_ROW = "name string, height int, width int, nChannels int, data binary"


def crc(data: bytes) -> int:
    value = 0xFFFF
    for byte in data:
        value ^= byte
        for _ in range(8):
            value = (value >> 1) ^ 0xA001 if value & 1 else value >> 1
    return value


def frame(slave: int, registers: list[int], function: int = 3) -> bytearray:
    body = bytes([slave, function, 2 * len(registers)]) + b"".join(struct.pack(">H", r) for r in registers)
    return bytearray(body + crc(body).to_bytes(2, "little"))
