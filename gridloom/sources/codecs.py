"""Compressed pixels: LZW and differences as TIFF has them, and PNG files."""

from __future__ import annotations

import struct
import zlib

import numpy as np

# codes and widths of TIFF's LZW (fixed values)
CLEAR, STOP, FIRST, NARROW, WIDE = 256, 257, 258, 9, 12
# file signature, and samples of a pixel by colour type (fixed values)
SIGNATURE, SAMPLES = b"\x89PNG\r\n\x1a\n", {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
PALETTE = 3


def lzw_decode(data: bytes) -> bytes:
    """Codes with their highest bit first, whose width grows one code early."""
    base = [bytes([i]) for i in range(256)] + [b"", b""]
    table, width, out, before = list(base), NARROW, [], None
    bits = held = 0
    for byte in data:
        bits, held = bits << 8 | byte, held + 8
        if held < width:
            continue
        held -= width
        code = bits >> held
        bits &= (1 << held) - 1
        if code == STOP:
            break
        if code == CLEAR:
            table, width, before = list(base), NARROW, None
            continue
        if before is None:
            entry = table[code]
        else:
            entry = table[code] if code < len(table) else before + before[:1]
            table.append(before + entry[:1])
        out.append(entry)
        before = entry
        width = min(WIDE, max(NARROW, (len(table) + 1).bit_length()))
    return b"".join(out)


def lzw_encode(data: bytes) -> bytes:
    bits, held, out = 0, 0, bytearray()
    table: dict[bytes, int] = {}
    width = NARROW

    def put(code: int) -> None:
        nonlocal bits, held
        bits, held = bits << width | code, held + width
        while held >= 8:
            held -= 8
            out.append(bits >> held & 255)
        bits &= (1 << held) - 1

    code_of = lambda s: s[0] if len(s) == 1 else table[s]
    put(CLEAR)
    word = b""
    for i in range(len(data)):
        longer = word + data[i : i + 1]
        if len(longer) == 1 or longer in table:
            word = longer
            continue
        put(code_of(word))
        table[longer] = FIRST + len(table)
        width = (FIRST + len(table)).bit_length()
        if FIRST + len(table) == (1 << WIDE) - 2:
            put(CLEAR)
            table, width = {}, NARROW
        word = longer[-1:]
    if word:
        put(code_of(word))
        width = min(WIDE, (FIRST + len(table) + 1).bit_length())
    put(STOP)
    if held:
        out.append(bits << 8 - held & 255)
    return bytes(out)


def add_up(block: np.ndarray) -> np.ndarray:
    """Rows of differences to the pixel on the left (height x width x bands) as pixels."""
    return np.add.accumulate(block, axis=1, dtype=block.dtype)


def differences(block: np.ndarray) -> np.ndarray:
    out = block.copy()
    out[:, 1:] -= block[:, :-1]
    return out


# --- PNG ---------------------------------------------------------------------------------------


def png_chunks(content) -> list[tuple[bytes, bytes]]:
    if bytes(content[:8]) != SIGNATURE:
        raise ValueError("not a PNG file")
    out, at = [], 8
    while True:
        n, kind = struct.unpack(">I4s", bytes(content[at : at + 8]))
        out.append((kind, bytes(content[at + 8 : at + 8 + n])))
        at += 12 + n
        if kind == b"IEND":
            return out


def png_head(content) -> tuple[int, int, int, int, int]:
    """Height, width, bits of a sample, colour type, interlacing."""
    if bytes(content[:8]) != SIGNATURE:
        raise ValueError("not a PNG file")
    w, h, depth, colour, _, _, laced = struct.unpack(">IIBBBBB", bytes(content[16:29]))
    return h, w, depth, colour, laced


def _unfiltered(kinds: np.ndarray, lines: np.ndarray, step: int) -> np.ndarray:
    """Rows of bytes (height x bytes) from what their filters left; step is a pixel's bytes.

    A byte needs those to the left, above, and above the left one, so all pixels of an antidiagonal can
    be worked out at once.
    """
    h, n = lines.shape
    w = n // step
    out = np.zeros((h + 1, w + 1, step), dtype=np.int16)  # with a border of zeros
    px, r = lines.reshape(h, w, step).astype(np.int16), np.arange(h)
    if np.isin(kinds, (0, 2)).all():
        start = np.flatnonzero(kinds == 0)
        body = np.empty_like(lines)
        for a, z in zip([0, *start.tolist()], [*start.tolist(), h], strict=True):
            body[a:z] = np.add.accumulate(lines[a:z], axis=0, dtype=np.uint8)
        return body
    for d in range(h + w - 1):
        i = r[max(0, d - w + 1) : min(h, d + 1)]
        j = d - i
        a, b, c = out[i + 1, j], out[i, j + 1], out[i, j]
        k = kinds[i][:, None]
        pa, pb, pc = np.abs(b - c), np.abs(a - c), np.abs(a + b - 2 * c)
        paeth = np.where((pa <= pb) & (pa <= pc), a, np.where(pb <= pc, b, c))
        guess = np.select([k == 1, k == 2, k == 3, k == 4], [a, b, (a + b) >> 1, paeth], 0)
        out[i + 1, j + 1] = (px[i, j] + guess) & 255
    return out[1:, 1:].reshape(h, n).astype(np.uint8)


def png_decode(content) -> np.ndarray:
    """Pixels, height x width x samples, of 8 or 16 bits; palettes are looked up."""
    h, w, depth, colour, laced = png_head(content)
    if laced or colour not in SAMPLES:
        raise ValueError("interlaced PNG files aren't read")
    chunks = png_chunks(content)
    raw = np.frombuffer(zlib.decompress(b"".join(d for k, d in chunks if k == b"IDAT")), dtype=np.uint8)
    n = SAMPLES[colour]
    line = -(-w * n * depth // 8)
    rows = raw[: h * (line + 1)].reshape(h, line + 1)
    lines = _unfiltered(rows[:, 0], rows[:, 1:], max(1, n * depth // 8))
    if depth == 16:
        px = lines.reshape(h, w, n, 2)
        px = px[..., 0].astype(np.uint16) << 8 | px[..., 1]
    elif depth == 8:
        px = lines.reshape(h, w, n)
    else:  # several samples to a byte
        each = np.unpackbits(lines, axis=1).reshape(h, -1, depth)[:, : w * n]
        px = (each @ (1 << np.arange(depth - 1, -1, -1))).astype(np.uint8).reshape(h, w, n)
        px = px if colour == PALETTE else (px * (255 // ((1 << depth) - 1))).astype(np.uint8)
    if colour == PALETTE:
        table = np.frombuffer(next(d for k, d in chunks if k == b"PLTE"), dtype=np.uint8).reshape(-1, 3)
        px = table[px[..., 0]]
    return px


def png_encode(px: np.ndarray, kind: int = 4) -> bytes:
    """A file of pixels (height x width x samples, of 8 or 16 bits), every row with the filter kind (0 to 4)."""
    h, w, n = px.shape
    depth = px.dtype.itemsize * 8
    flat = px.astype(px.dtype.newbyteorder(">")).view(np.uint8).reshape(h, w, n * depth // 8).astype(np.int16)
    grown = np.zeros((h + 1, w + 1, flat.shape[2]), dtype=np.int16)
    grown[1:, 1:] = flat
    a, b, c = grown[1:, :-1], grown[:-1, 1:], grown[:-1, :-1]
    pa, pb, pc = np.abs(b - c), np.abs(a - c), np.abs(a + b - 2 * c)
    guess = (0 * a, a, b, (a + b) >> 1, np.where((pa <= pb) & (pa <= pc), a, np.where(pb <= pc, b, c)))[kind]
    lines = ((flat - guess) & 255).astype(np.uint8).reshape(h, -1)
    data = zlib.compress(np.hstack((np.full((h, 1), kind, dtype=np.uint8), lines)).tobytes())
    colour = {v: k for k, v in SAMPLES.items() if k != PALETTE}[n]
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, colour, 0, 0, 0)) + chunk(b"IDAT", data) + chunk(b"IEND", b"")
