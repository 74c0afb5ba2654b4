"""Animated previews: GIF89a with a palette for each frame."""

from __future__ import annotations

import struct

import numpy as np

from gridloom.operators.colours import median_cut

MOST_COLOURS, MOST_SCALE = 255, 8


def indexed(image: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """(index of each pixel, colours from index 1 on); index 0 is transparent, other pixels take the
    nearest of the frame's own colours, the first among equals."""
    flat = image.reshape(-1, 4).astype(np.int64)
    seen = flat[:, 3] > 0
    if not seen.any():
        return np.zeros(image.shape[:2], np.uint8), []
    shown = flat[seen]
    scaled = shown[:, :3] * 257 * shown[:, 3:] // 255 // 256
    bins, counts = np.unique(scaled, axis=0, return_counts=True)
    table = np.column_stack([bins, counts])
    if len(table) <= MOST_COLOURS:
        order = np.lexsort((table[:, 2], table[:, 1], table[:, 0], -table[:, 3]))
        colours = [tuple(map(int, c)) for c in table[order, :3]]
    else:
        colours = [c[:3] for c in median_cut(table, MOST_COLOURS)]
    pal = np.array(colours)
    different, back = np.unique(shown[:, :3], axis=0, return_inverse=True)
    near = ((different[:, None, :] - pal[None]) ** 2).sum(2).argmin(1)
    out = np.zeros(len(flat), np.uint8)
    out[seen] = near[back.ravel()] + 1
    return out.reshape(image.shape[:2]), colours


def lzw(data: bytes, bits: int) -> bytes:
    """Variable-width codes from bits + 1 up to 12, least significant bit first."""
    clear, stop = 1 << bits, (1 << bits) + 1
    out, held, n = bytearray(), 0, 0
    table: dict[tuple[int, int], int] = {}
    width, following = bits + 1, stop + 1

    def put(code: int) -> None:
        nonlocal held, n
        held |= code << n
        n += width
        while n >= 8:
            out.append(held & 255)
            held >>= 8
            n -= 8

    put(clear)
    prefix = -1
    for byte in data:
        if prefix < 0:
            prefix = byte
            continue
        known = table.get((prefix, byte))
        if known is not None:
            prefix = known
            continue
        put(prefix)
        if following < 4096:
            table[prefix, byte] = following
            if following == 1 << width and width < 12:
                width += 1
            following += 1
        else:
            put(clear)
            table.clear()
            width, following = bits + 1, stop + 1
        prefix = byte
    if prefix >= 0:
        put(prefix)
    put(stop)
    if n:
        out.append(held & 255)
    return bytes(out)


def encode(frames: list[np.ndarray], delay_cs: int, loop: bool = True, scale: int = 1) -> bytes:
    """Frames (h x w x 4) on the largest canvas, each restored to background before the next."""
    if not 1 <= scale <= MOST_SCALE:
        raise ValueError(f"scale must be between 1 and {MOST_SCALE}")
    if not frames:
        raise ValueError("no frames")
    frames = [f.repeat(scale, 0).repeat(scale, 1) for f in frames]
    width, height = max(f.shape[1] for f in frames), max(f.shape[0] for f in frames)
    out = [b"GIF89a", struct.pack("<HHBBB", width, height, 0x70, 0, 0)]
    if loop:
        out.append(b"\x21\xff\x0bNETSCAPE2.0\x03\x01\x00\x00\x00")
    for frame in frames:
        index, colours = indexed(frame)
        bits = max(2, len(colours).bit_length())
        table = b"\x00\x00\x00" + b"".join(bytes(c) for c in colours)
        out.append(struct.pack("<BBBBHBB", 0x21, 0xF9, 4, 2 << 2 | 1, delay_cs, 0, 0))
        out.append(struct.pack("<BHHHHB", 0x2C, 0, 0, frame.shape[1], frame.shape[0], 0x80 | (bits - 1)))
        out.append(table.ljust(3 << bits, b"\x00") + bytes([bits]))
        packed = lzw(index.tobytes(), bits)
        out += [bytes([len(packed[i : i + 255])]) + packed[i : i + 255] for i in range(0, len(packed), 255)]
        out.append(b"\x00")
    return b"".join(out) + b"\x3b"
