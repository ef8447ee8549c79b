"""Blocks of a bzip2 file, found and decoded from any place of it.

A block begins, at any bit, with 48 fixed bits; so a task finds those that begin in its range of bytes and decodes each as
a stream of its own, whose check sum the block brings. The place of a line is that of the line feed before it: the
first byte of its block times 2**26, plus its offset in the block's text, plus one (a block has less than 2**26
characters). Places order the lines of a file alike, whatever the ranges. Streams that follow each other in one file
(as parallel compressors write them) are read on.

Fixed bits can also occur by chance within a block (once in 2**48 places). Where a block can't be decoded up to the next
fixed bits, it is tried up to later ones; a range that begins with such bits, like a damaged file, is an error.
"""

from __future__ import annotations

import bz2
from collections.abc import Iterator

import numpy as np

BLOCK, END = 0x314159265359.to_bytes(6), 0x177245385090.to_bytes(6)  # fixed values of the format
PLACE_BITS = 26
STEP = 1 << 20
#: No block of 900,000 characters is compressed to more bytes, even with marks by chance.
MOST_BYTES = 4 << 20


def marks(data: bytes, first_bit: int = 0) -> list[tuple[int, bool]]:
    """Places in bits of the fixed bits in ``data``, from ``first_bit`` on, and whether a block begins there."""
    a, out = np.frombuffer(data, np.uint8).astype(np.uint16), []
    for shift in range(8):
        moved = data if not shift else (((a[:-1] << shift) | (a[1:] >> (8 - shift))) & 255).astype(np.uint8).tobytes()
        for pattern in (BLOCK, END):
            at = moved.find(pattern, max(0, (first_bit - shift + 7) // 8))
            while at >= 0:
                out.append((at * 8 + shift, pattern == BLOCK))
                at = moved.find(pattern, at + 1)
    return sorted(out)


def decoded(data: bytes, start: int, end: int) -> bytes | None:
    """The text of the block in the bits from start to end, None if they are no whole block."""
    n = end - start
    if n < 80:
        return None
    bits = int.from_bytes(data[start // 8 : (end + 7) // 8]) >> (-end % 8) & ((1 << n) - 1)
    check = bits >> (n - 80) & 0xFFFFFFFF
    bits = ((bits << 48 | int.from_bytes(END)) << 32 | check) << (-n % 8)
    try:
        return bz2.decompress(b"BZh9" + bits.to_bytes((n + 80 + 7) // 8))
    except (OSError, ValueError, EOFError):
        return None


def blocks(stream, start: int, path: str = "") -> Iterator[tuple[int, bytes]]:
    """First byte and text of each block that begins at byte ``start`` or later, to the end of the file."""
    stream.seek(0)
    if stream.read(3) != b"BZh":
        raise ValueError(f"{path} isn't a bzip2 file")
    stream.seek(start)
    data, base, done, last = b"", start, 0, False  # data begins at byte base; blocks before bit done are out
    while not last:
        more = stream.read(STEP)
        last = not more
        data += more
        found = marks(data, done)
        k = 0
        while k < len(found):
            at, is_block = found[k]
            if not is_block:
                k += 1
                done = at + 1
                continue
            text = None
            for j in range(k + 1, len(found)):
                if (text := decoded(data, at, found[j][0])) is not None:
                    break
            if text is None:
                if last or len(data) - at // 8 > MOST_BYTES:
                    raise ValueError(f"{path}: no whole bzip2 block at byte {base + at // 8}; read a sound file with splittable=false")
                done = at
                break
            yield base + at // 8, text
            k, done = j, found[j][0]
        else:
            done = max(done, len(data) * 8 - 47)
        cut = done // 8
        data, base, done = data[cut:], base + cut, done - cut * 8


def lines(stream, start: int, encoding: str, most: int, path: str = "") -> Iterator[tuple[int, str]]:
    """Places and lines of a file, from the first line feed in a block that begins at byte ``start`` or later. Of a line
    of more than ``most`` characters so much is kept that it shows."""
    rest, place, bound = (b"", 0, 4 * most + 8) if not start else (None, 0, 4 * most + 8)

    def line(x: bytes) -> str:
        return x.removeprefix(b"\xef\xbb\xbf").rstrip(b"\r").decode(encoding, "replace")

    for byte, text in blocks(stream, start, path):
        parts, at = text.split(b"\n"), byte << PLACE_BITS
        for x in parts[:-1]:
            if rest is not None:
                yield place, line(rest + x if rest else x)
            at += len(x) + 1
            rest, place = b"", at
        if rest is not None:
            rest = (rest + parts[-1])[:bound] if len(rest) < bound else rest
    if rest:
        yield place, line(rest)
