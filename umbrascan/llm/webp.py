"""Lossless WebP media columns: decode to pixel arrays, and a plain encoder for samples and pixels.

The decoder takes the whole lossless format: simple and normal prefix codes, several code groups, back-references with the
two-dimensional distance codes, the colour cache, and the inverse predictor, cross-colour, subtract-green and palette
transforms. With one code group and no cache, the code at every bit position is looked up at once and the chain of
positions is followed in strides of eight; otherwise pixels are read one by one.

A column of samples (8 bits each, rows of WIDTH) is stored as images of at most ROWS rows, one after the other, each with
a palette of its distinct samples in the green channel, its own prefix codes and back-references for runs. Both
directions hold one image at a time, whatever the length of a text.

Cases: a null text is empty, its payload 192 spaces; a null or malformed file decodes to null pixels with the reason in
`error`; equal texts give equal files; repeated rows are each returned; other columns are not read by the query; an empty
table gives an empty table.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from . import common

WIDTH = 192
ROWS = 1024
MIN_RUN = 16
LONGEST_CODE = 12
FAST_PIXELS = 192
#: Descriptions of codes up to so many bits are kept, as they tend to come again.
LONGEST_KEPT = 320
#: Fixed values of the format.
SIGNATURE = 0x2F
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
CACHE_FACTOR = 0x1E35A7BD
LENGTH_CODES, DISTANCE_CODES = 24, 40
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
#: Short distance codes stand for neighbours, nearest first: (x to the left, y rows up).
NEIGHBOURS = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0))


# Prefix codes


@lru_cache(4096)
def canonical(lengths: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(used symbols, their codes with the first bit lowest) of a code given by its lengths."""
    own = np.frombuffer(lengths, np.uint8)
    used = np.flatnonzero(own)
    if len(used) < 2:
        return used, np.zeros(len(used), np.int64)
    used = used[np.argsort(own[used], kind="stable")]
    sizes = own[used].astype(np.int64)
    top = int(sizes[-1])
    ends = np.cumsum(1 << (top - sizes))
    if ends[-1] != 1 << top:
        raise ValueError("a prefix code is not complete")
    codes = (ends - (1 << (top - sizes))) >> (top - sizes)
    return used, REVERSED[codes].astype(np.int64) >> (16 - sizes)


def reversed_bits() -> np.ndarray:
    """Every 16-bit number with its bits in the other order."""
    x = np.arange(1 << 16, dtype=np.uint16)
    for step, mask in ((1, 0x5555), (2, 0x3333), (4, 0x0F0F), (8, 0x00FF)):
        x = (x >> step) & mask | (x & mask) << step
    return x


REVERSED = reversed_bits()


@lru_cache(4096)
def lookup(lengths: bytes) -> tuple[int, np.ndarray]:
    """(bits, table): for the next bits of the stream, symbol << 4 | bits used."""
    used, _ = canonical(lengths)
    if not len(used):
        raise ValueError("a prefix code is empty")
    if len(used) == 1:
        return 0, np.array([int(used[0]) << 4], np.int32)
    bits = max(lengths)
    sizes = np.frombuffer(lengths, np.uint8)[used].astype(np.int32)
    # With the first bit highest a symbol has one stretch of the table.
    return bits, np.repeat(used.astype(np.int32) << 4 | sizes, 1 << (bits - sizes))[REVERSED[: 1 << bits] >> (16 - bits)]


@lru_cache(4096)
def lookup_list(lengths: bytes) -> tuple[int, list[int]]:
    bits, table = lookup(lengths)
    return bits, table.tolist()


def code_lengths(counts: np.ndarray, longest: int) -> bytes:
    """Huffman lengths, flattened until none is over `longest`."""
    out = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    n, weights = len(used), counts[used]
    if n < 2:
        out[used] = 1
        return out.tobytes()
    while True:
        order = np.argsort(weights, kind="stable")
        leaves, joined_, parents, i, j = weights[order].tolist(), [], [0] * (2 * n - 1), 0, 0
        for k in range(n, 2 * n - 1):  # the two lightest of the leaves and of what was joined, both of which come in order
            both = 0
            for _ in range(2):
                if i < n and (j == len(joined_) or leaves[i] <= joined_[j]):
                    both += leaves[i]
                    parents[i] = k
                    i += 1
                else:
                    both += joined_[j]
                    parents[n + j] = k
                    j += 1
            joined_.append(both)
        depths = [0] * (2 * n - 1)
        for k in range(2 * n - 3, -1, -1):
            depths[k] = depths[parents[k]] + 1
        if depths[0] <= longest:
            out[used[order]] = depths[:n]
            return out.tobytes()
        weights = (weights >> 1) + 1


class Reader:
    """Bits of a stream, lowest first."""

    def __init__(self, data: bytes):
        self.size = len(data) * 8
        self.data, self.at = data + bytes(8), 0

    def read(self, n: int) -> int:
        at = self.at
        self.at += n
        if self.at > self.size:
            raise ValueError("the stream ends early")
        return int.from_bytes(self.data[at >> 3 : (at >> 3) + 8], "little") >> (at & 7) & ((1 << n) - 1)

    def symbol(self, code: tuple[int, np.ndarray]) -> int:
        bits, table = code
        at = self.at
        found = int(table[int.from_bytes(self.data[at >> 3 : (at >> 3) + 4], "little") >> (at & 7) & ((1 << bits) - 1)])
        self.at = at + (found & 15)
        if self.at > self.size:
            raise ValueError("the stream ends early")
        return found >> 4


@lru_cache(1)
def descriptions() -> dict[tuple[int, int], tuple[int, int, tuple[int, np.ndarray]]]:
    """Short descriptions of codes read before: by alphabet and first bits, (number of bits, bits, code)."""
    return {}


def read_code(r: Reader, size: int) -> tuple[int, np.ndarray]:
    known, at = descriptions(), r.at
    bits = int.from_bytes(r.data[at >> 3 : (at >> 3) + 16 + 2 * size], "little") >> (at & 7)
    key = size, bits & 0xFFFF
    if key in known:
        n, own, code = known[key]
        if bits & ((1 << n) - 1) == own and at + n <= r.size:
            r.at = at + n
            return code
    code = described_code(r, size, bits)
    n = r.at - at
    if n <= LONGEST_KEPT:
        if len(known) >= 4096:
            known.clear()
        known[key] = n, bits & ((1 << n) - 1), code
    return code


def described_code(r: Reader, size: int, bits: int) -> tuple[int, np.ndarray]:
    """The code whose description comes next in the stream; bits: what comes next, as one number."""
    lengths = bytearray(size)
    if r.read(1):
        two = r.read(1)
        symbols = [r.read(8 if r.read(1) else 1)] + ([r.read(8)] if two else [])
        if max(symbols) >= size:
            raise ValueError("a symbol is outside its alphabet")
        for s in symbols:
            lengths[s] = 1
        return lookup(bytes(lengths))
    start = r.at - 1
    own = bytearray(19)
    for k in CODE_LENGTH_ORDER[: 4 + r.read(4)]:
        own[k] = r.read(3)
    width, table = lookup_list(bytes(own))
    mask = (1 << width) - 1
    left = 2 + r.read(2 + 2 * r.read(3)) if r.read(1) else size
    at, last, taken = 0, 8, r.at - start
    bits >>= taken
    while at < size and left:
        left -= 1
        found = table[bits & mask]
        s, n = found >> 4, found & 15
        if s < 16:
            lengths[at] = s
            last = s or last
            at += 1
        else:
            extra = 2 if s == 16 else 3 if s == 17 else 7
            many = (11 if s == 18 else 3) + ((bits >> n) & ((1 << extra) - 1))
            if at + many > size:
                raise ValueError("too many code lengths")
            if s == 16:
                lengths[at : at + many] = bytes([last]) * many
            at += many
            n += extra
        bits >>= n
        taken += n
    r.at = start + taken
    if r.at > r.size:
        raise ValueError("the stream ends early")
    return lookup(bytes(lengths))


def prefix_value(r: Reader, prefix: int) -> int:
    """The number, from 1, that a length or distance prefix and its extra bits stand for."""
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + r.read(extra) + 1


# Pixels: arrays of 32-bit ARGB


def blocks(n: int, bits: int) -> int:
    return -(-n >> bits)


def read_pixels(r: Reader, width: int, height: int, main: bool = False) -> np.ndarray:
    cache_bits = r.read(4) if r.read(1) else 0
    group_bits, groups_of, n_groups = 0, None, 1
    if main and r.read(1):
        group_bits = r.read(3) + 2
        image = read_pixels(r, blocks(width, group_bits), blocks(height, group_bits))
        groups_of = (image.reshape(blocks(height, group_bits), -1) >> 8) & 0xFFFF
        n_groups = int(groups_of.max()) + 1
    cache = 1 << cache_bits if cache_bits else 0
    groups = [[read_code(r, n) for n in (256 + LENGTH_CODES + cache, 256, 256, 256, DISTANCE_CODES)] for _ in range(n_groups)]
    if n_groups == 1 and not cache:
        if width * height >= FAST_PIXELS:
            return chained_pixels(r, width, width * height, groups[0])
        return few_pixels(r, width, width * height, groups[0])
    out = np.zeros(width * height, np.uint32)
    table, upto = np.zeros(max(1, cache), np.uint32), 0
    at = 0
    # Codes of one symbol take no bits; the others are read in the order of the stream.
    others = [[(code, shift) for code, shift in zip(g[1:4], (16, 0, 24), strict=True) if code[0]] for g in groups]
    fixed = [sum(int(code[1][0]) >> 4 << shift for code, shift in zip(g[1:4], (16, 0, 24), strict=True) if not code[0]) for g in groups]
    group = 0
    while at < len(out):
        if groups_of is not None:
            group = groups_of[at // width >> group_bits, at % width >> group_bits]
        codes = groups[group]
        s = r.symbol(codes[0])
        if s < 256:
            pixel = fixed[group] | s << 8
            for code, shift in others[group]:
                pixel |= r.symbol(code) << shift
            out[at] = pixel
            at += 1
        elif s < 256 + LENGTH_CODES:
            at = copy(r, out, at, width, s - 256, codes[4])
        else:
            for p in out[upto:at].tolist():
                table[(p * CACHE_FACTOR & 0xFFFFFFFF) >> (32 - cache_bits)] = p
            upto = at
            out[at] = table[s - 256 - LENGTH_CODES]
            at += 1
    return out


def few_pixels(r: Reader, width: int, total: int, codes: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """read_pixels for one group, no cache and a small image: the bits ahead are one number that is shifted along."""
    out = np.zeros(total, np.uint32)
    tables = [(table.tolist(), (1 << bits) - 1, shift) for (bits, table), shift in zip(codes[:4], (8, 16, 0, 24), strict=True) if bits]
    constant = sum(int(table[0]) >> 4 << shift for (bits, table), shift in zip(codes[:4], (8, 16, 0, 24), strict=True) if not bits)
    lone = int(codes[0][1][0]) >> 4 if not codes[0][0] else 0
    ahead, start, taken, at, pixels = None, 0, 0, 0, []
    while at < total:
        if ahead is None:
            start, taken, pixels = r.at, 0, []
            ahead = int.from_bytes(r.data[start >> 3 : (start >> 3) + 8 * total + 8], "little") >> (start & 7)
        pixel = constant
        if lone < 256:
            begin = taken
            for table, mask, shift in tables:
                found = table[ahead & mask]
                ahead >>= found & 15
                taken += found & 15
                pixel |= found >> 4 << shift
                if shift == 8 and found >= 256 << 4:
                    break
            else:
                pixels.append(pixel)
                at += 1
                continue
            taken = begin
        out[at - len(pixels) : at] = pixels
        r.at = start + taken
        at = copy(r, out, at, width, r.symbol(codes[0]) - 256, codes[4])
        ahead = None
    if ahead is not None:
        out[at - len(pixels) : at] = pixels
        r.at = start + taken
    if r.at > r.size:
        raise ValueError("the stream ends early")
    return out


def copy(r: Reader, out: np.ndarray, at: int, width: int, prefix: int, distances: tuple[int, np.ndarray]) -> int:
    """Read a back-reference and do it; the place after it."""
    n = prefix_value(r, prefix)
    far = prefix_value(r, r.symbol(distances))
    if far > len(NEIGHBOURS):
        far -= len(NEIGHBOURS)
    else:
        x, y = NEIGHBOURS[far - 1]
        far = max(1, x + y * width)
    if far > at or at + n > len(out):
        raise ValueError("a back-reference is out of range")
    done = 0
    while done < n:  # what is copied may overlap what it is copied from
        part = min(n - done, far + done)
        out[at + done : at + done + part] = out[at - far : at - far + part]
        done += part
    return at + n


def chained_pixels(r: Reader, width: int, total: int, codes: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """read_pixels for one group and no cache: codes are looked up at every bit, then the chain of pixels is followed."""
    base = r.at >> 3
    raw = np.frombuffer(r.data, np.uint8, offset=base).astype(np.int64)
    words = raw[:-2] | raw[1:-1] << 8 | raw[2:] << 16
    ahead = (words[:, None] >> np.arange(8)).ravel()
    n = len(ahead)
    places = np.arange(n)
    # (symbols and sizes at every bit, where the code stands if the pixel begins there, place in the pixel)
    parts, after, constant = [], places, 0
    for (bits, table), shift in zip(codes[:4], (8, 16, 0, 24), strict=True):
        if bits:
            found = table.take(ahead & ((1 << bits) - 1), mode="clip")
            parts.append((found, after, shift))
            after = after + (found & 15 if after is places else (found & 15).take(after, mode="clip"))
        else:
            constant |= int(table[0]) >> 4 << shift
    green = parts[0][0] if codes[0][0] else None
    stop = green >= 256 << 4 if green is not None else np.full(n, int(codes[0][1][0]) >> 4 >= 256)
    following = np.minimum(after, n - 1)
    if stop.any():
        np.copyto(following, places, where=stop)
    two = following.take(following, mode="clip")
    four = two.take(two, mode="clip")
    stride, stopped = memoryview(four.take(four, mode="clip")), memoryview(stop)
    out = np.zeros(total, np.uint32)
    at, p = 0, r.at - base * 8
    while at < total:
        heads, q, left = [], p, total - at
        for _ in range(-(-left // 8)):
            if stopped[q]:
                break
            heads.append(q)
            q = stride[q]
        if heads:
            own = np.empty((8, len(heads)), np.int64)
            own[0] = heads
            for i in range(1, 8):
                following.take(own[i - 1], out=own[i], mode="clip")
            own = own.T.ravel()
            if stopped[own[-1]]:
                own = own[: int(stop.take(own).argmax())]
            own = own[:left]
            pixels = out[at : at + len(own)]
            pixels += np.uint32(constant)
            for found, place, shift in parts:
                here = own if place is places else place.take(own, mode="clip")
                pixels |= (found.take(here, mode="clip") >> 4).astype(np.uint32) << np.uint32(shift)
            at += len(own)
            p = int(after[own[-1]])
        r.at = base * 8 + p
        if r.at > r.size:
            raise ValueError("the stream ends early")
        if at < total:
            at = copy(r, out, at, width, r.symbol(codes[0]) - 256, codes[4])
            p = r.at - base * 8
    return out


# Transforms


def channels(pixels: np.ndarray) -> np.ndarray:
    """(..., 4) of blue, green, red, alpha."""
    return pixels.astype("<u4").reshape(*pixels.shape, 1).view(np.uint8)


def joined(parts: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(parts.astype(np.uint8)).view("<u4")[..., 0]


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint8).view(np.int8).astype(np.int32)


def cross_colour(parts: np.ndarray, image: np.ndarray, bits: int, sign: int) -> np.ndarray:
    """Add (sign=1) or take away what green and red predict of red and blue."""
    height, width = parts.shape[:2]
    own = channels(image)[np.arange(height)[:, None] >> bits, np.arange(width)[None, :] >> bits]
    to_red, to_blue, red_to_blue = (signed(own[..., i]) for i in range(3))
    out = parts.astype(np.int32)
    green = signed(parts[..., 1])
    moved = out[..., 2] + sign * ((to_red * green) >> 5)
    red = signed(moved & 255) if sign > 0 else signed(parts[..., 2])
    out[..., 0] += sign * (((to_blue * green) >> 5) + ((red_to_blue * red) >> 5))
    out[..., 2] = moved
    return (out & 255).astype(np.uint8)


def predicted(mode: int, left, top, top_left, top_right):
    """The prediction from neighbours given as integer channel arrays."""
    mean = lambda a, b: (a + b) >> 1
    if mode == 0 or mode > 13:
        out = np.zeros_like(top)
        out[..., 3] = 255
        return out
    if mode <= 4:
        return (left, top, top_right, top_left)[mode - 1]
    if mode <= 10:
        return (lambda: mean(mean(left, top_right), top), lambda: mean(left, top_left), lambda: mean(left, top), lambda: mean(top_left, top), lambda: mean(top, top_right), lambda: mean(mean(left, top_left), mean(top, top_right)))[mode - 5]()
    if mode == 11:
        nearer_left = np.abs(top - top_left).sum(-1, keepdims=True) < np.abs(left - top_left).sum(-1, keepdims=True)
        return np.where(nearer_left, left, top)
    if mode == 12:
        return np.clip(left + top - top_left, 0, 255)
    half = mean(left, top)
    off = half - top_left
    return np.clip(half + (off + (off < 0) >> 1), 0, 255)


def neighbours(done: np.ndarray, y: int, x0: int, x1: int):
    """top, top left and top right of the pixels x0 to x1 (x0 > 0) of row y."""
    width = done.shape[1]
    above = done[y - 1]
    right = above[x0 + 1 : x1 + 1] if x1 < width else np.concatenate([above[x0 + 1 :], done[y, :1]])
    return above[x0:x1], above[x0 - 1 : x1 - 1], right


def modes_of(image: np.ndarray, bits: int, y: int, width: int) -> list[tuple[int, int, int]]:
    """(mode, first, end) of the stretches of row y after its first pixel."""
    row = (image[y >> bits] >> 8) & 15
    return [(int(m), max(1, k << bits), min(width, (k + 1) << bits)) for k, m in enumerate(row) if max(1, k << bits) < min(width, (k + 1) << bits)]


def unpredict(parts: np.ndarray, image: np.ndarray, bits: int) -> np.ndarray:
    """Add predictions to residuals: a row at once where a mode does not look left, pixel by pixel where it does."""
    height, width = parts.shape[:2]
    done = parts.astype(np.int32)
    done[0, 0, 3] = (done[0, 0, 3] + 255) & 255
    done[0] = np.cumsum(done[0], 0) & 255
    for y in range(1, height):
        done[y, 0] = (done[y, 0] + done[y - 1, 0]) & 255
        for mode, x0, x1 in modes_of(image, bits, y, width):
            top, top_left, top_right = neighbours(done, y, x0, x1)
            if mode == 1:
                done[y, x0:x1] = (np.cumsum(done[y, x0 - 1 : x1], 0) & 255)[1:]
            elif mode in (0, 2, 3, 4, 8, 9, 14, 15):
                done[y, x0:x1] = (done[y, x0:x1] + predicted(mode, None, top, top_left, top_right)) & 255
            else:
                for i in range(x1 - x0):
                    done[y, x0 + i] = (done[y, x0 + i] + predicted(mode, done[y, x0 + i - 1], top[i], top_left[i], top_right[i])) & 255
    return done.astype(np.uint8)


def predict_residuals(parts: np.ndarray, image: np.ndarray, bits: int) -> np.ndarray:
    height, width = parts.shape[:2]
    full, out = parts.astype(np.int32), parts.astype(np.int32)
    out[0, 0, 3] -= 255
    out[0, 1:] -= full[0, :-1]
    out[1:, 0] -= full[:-1, 0]
    for y in range(1, height):
        for mode, x0, x1 in modes_of(image, bits, y, width):
            out[y, x0:x1] -= predicted(mode, full[y, x0 - 1 : x1 - 1], *neighbours(full, y, x0, x1))
    return (out & 255).astype(np.uint8)


def palette_bits(colours: int) -> int:
    """log2 of how many palette indices share a pixel."""
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def unpack_palette(pixels: np.ndarray, palette: np.ndarray, width: int) -> np.ndarray:
    bits = palette_bits(len(palette))
    index = (pixels >> 8) & 255
    if bits:
        each = 8 >> bits
        index = (index[..., None] >> (np.arange(1 << bits, dtype=np.uint32) * each)) & ((1 << each) - 1)
        index = index.reshape(len(pixels), -1)[:, :width]
    full = np.zeros(256, np.uint32)  # what is outside the palette is transparent black
    full[: len(palette)] = palette
    return full[index]


# Files


def decode(data: bytes) -> np.ndarray:
    """The image in a lossless WebP file as (height, width) of 32-bit ARGB."""
    r = Reader(lossless_chunk(data))
    if r.read(8) != SIGNATURE:
        raise ValueError("no lossless signature")
    width, height = r.read(14) + 1, r.read(14) + 1
    r.read(1)
    if r.read(3):
        raise ValueError("unknown version")
    undo, seen, now = [], set(), width
    while r.read(1):
        kind = r.read(2)
        if kind in seen:
            raise ValueError("a transform comes twice")
        seen.add(kind)
        if kind in (PREDICTOR, CROSS_COLOUR):
            bits = r.read(3) + 2
            image = read_pixels(r, blocks(now, bits), blocks(height, bits)).reshape(blocks(height, bits), -1)
            undo.append((kind, image, bits))
        elif kind == PALETTE:
            size = r.read(8) + 1
            steps = channels(read_pixels(r, size, 1))
            undo.append((kind, joined(np.cumsum(steps, 0) & 255), now))
            now = blocks(now, palette_bits(size))
        else:
            undo.append((kind, None, 0))
    pixels = read_pixels(r, now, height, main=True).reshape(height, now)
    for kind, image, value in reversed(undo):
        if kind == PALETTE:
            pixels = unpack_palette(pixels, image, value)
        elif kind == SUBTRACT_GREEN:
            parts = channels(pixels).copy()
            parts[..., 0] += parts[..., 1]
            parts[..., 2] += parts[..., 1]
            pixels = joined(parts)
        elif kind == PREDICTOR:
            pixels = joined(unpredict(channels(pixels), image, value))
        else:
            pixels = joined(cross_colour(channels(pixels), image, value, 1))
    return pixels


def lossless_chunk(data: bytes) -> bytes:
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise ValueError("not a WebP file")
    at = 12
    while at + 8 <= len(data):
        size = int.from_bytes(data[at + 4 : at + 8], "little")
        if data[at : at + 4] == b"VP8L":
            return data[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no lossless image in the file")


def files_of(media: bytes) -> Iterator[bytes]:
    """The WebP files that stand one after the other in media."""
    at = 0
    while at < len(media):
        end = at + 8 + int.from_bytes(media[at + 4 : at + 8], "little")
        yield media[at:end]
        at = end


class Writer:
    """Bits of a stream, lowest first, gathered as arrays of values and sizes."""

    def __init__(self):
        self.values, self.sizes, self.tail = [], [], ([], [])

    def put(self, value: int, size: int) -> None:
        self.tail[0].append(value)
        self.tail[1].append(size)

    def extend(self, values: np.ndarray, sizes: np.ndarray) -> None:
        self._close()
        self.values.append(values.astype(np.uint64))
        self.sizes.append(sizes.astype(np.int64))

    def _close(self) -> None:
        if self.tail[0]:
            self.values.append(np.array(self.tail[0], np.uint64))
            self.sizes.append(np.array(self.tail[1], np.int64))
            self.tail = ([], [])

    def bytes(self) -> bytes:
        self._close()
        values, sizes = np.concatenate(self.values), np.concatenate(self.sizes)
        ends = np.cumsum(sizes)
        starts = ends - sizes
        word = starts >> 5
        first = np.concatenate([[0], np.flatnonzero(word[1:] != word[:-1]) + 1])
        sums = np.add.reduceat(values << (starts & 31).astype(np.uint64), first)
        out = np.zeros((int(ends[-1]) >> 5) + 3, np.uint64)
        out[word[first]] |= sums & np.uint64(0xFFFFFFFF)
        out[word[first] + 1] |= sums >> np.uint64(32)
        return out.astype("<u4").tobytes()[: (int(ends[-1]) + 7) >> 3]


@lru_cache(4096)
def described(lengths: bytes) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """The bits (values, sizes) that tell a decoder the lengths of a code."""
    own = np.frombuffer(lengths, np.uint8)
    used = np.flatnonzero(own).tolist()
    if len(used) <= 2 and max(used, default=0) < 256:
        used = used or [0]
        bits = [(1, 1), (len(used) - 1, 1), (int(used[0] > 1), 1), (used[0], 8 if used[0] > 1 else 1)] + [(x, 8) for x in used[1:]]
        return tuple(zip(*bits, strict=True))
    edges = np.flatnonzero(np.diff(own.astype(int))) + 1
    tokens, last = [], 8
    for start, end in zip([0, *edges.tolist()], [*edges.tolist(), len(own)], strict=True):
        value, left = lengths[start], end - start
        while left:
            most = 138 if not value else 6 if value == last else 1
            n = min(left, most) if left >= 3 and most > 1 else 1
            tokens.append((value, 0, 0) if n < 3 else (16, n - 3, 2) if value else (18, n - 11, 7) if n >= 11 else (17, n - 3, 3))
            last = value or last
            left -= n
    own = code_lengths(np.bincount([t[0] for t in tokens], minlength=19), 7)
    many = max(4, max(i for i, k in enumerate(CODE_LENGTH_ORDER) if own[k]) + 1)
    bits = [(0, 1), (many - 4, 4), *[(own[k], 3) for k in CODE_LENGTH_ORDER[:many]], (0, 1)]
    codes = dict(zip(*(x.tolist() for x in canonical(own)), strict=True))
    size = (lambda t: own[t]) if len(codes) > 1 else lambda t: 0
    for t, extra, n in tokens:
        bits += [(codes[t], size(t)), (extra, n)]
    return tuple(zip(*bits, strict=True))


def write_code(w: Writer, lengths: bytes) -> None:
    values, sizes = described(lengths)
    w.tail[0].extend(values)
    w.tail[1].extend(sizes)


def prefix_of(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(prefix, extra bits, their number) of numbers from 1."""
    v = np.asarray(value, np.int64) - 1
    high = np.frexp(np.maximum(v, 1).astype(np.float64))[1] - 1
    extra = np.where(v < 4, 0, np.maximum(high - 1, 0))
    prefix = np.where(v < 4, v, 2 * high + ((v >> np.maximum(high - 1, 0)) & 1))
    return prefix, v & ((1 << extra) - 1), extra


def runs(pixels: np.ndarray, least: int, most: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of the pieces that repeat the pixel before them, of at least `least` pixels."""
    cut = np.flatnonzero(pixels[1:] != pixels[:-1]) + 1
    edges = np.concatenate([[0], cut, [len(pixels)]])
    starts, sizes = edges[:-1] + 1, edges[1:] - edges[:-1] - 1
    keep = sizes >= least
    if not keep.any():
        return starts[:0], sizes[:0]
    starts, sizes = starts[keep], sizes[keep]
    pieces = -(-sizes // most)
    part = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    starts, sizes = np.repeat(starts, pieces) + part * most, np.minimum(most, np.repeat(sizes, pieces) - part * most)
    return starts, sizes


def write_pixels(w: Writer, pixels: np.ndarray, main: bool = False, cache_bits: int = 0, least_run: int = MIN_RUN, group_bits: int = 0, width: int = 0) -> None:
    """Literals, back-references to the pixel before for runs, and cache hits, with one code group or one per block kind."""
    flat = pixels.ravel()
    starts, sizes = runs(flat, least_run)
    covered = np.zeros(len(flat) + 1, np.int32)
    np.add.at(covered, starts, 1)
    np.add.at(covered, starts + sizes, -1)
    literal = np.flatnonzero(np.cumsum(covered[:-1]) == 0)
    at = np.concatenate([literal, starts])
    order = np.argsort(at, kind="stable")
    is_run = order >= len(literal)
    parts = channels(flat[at[order]])
    length = np.zeros(len(at), np.int64)
    length[is_run] = sizes[order[is_run] - len(literal)]
    green, extra, extra_bits = parts[:, 1].astype(np.int64), np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    if len(starts):
        prefix, extra, extra_bits = prefix_of(np.maximum(length, 1))
        green = np.where(is_run, 256 + prefix, green)
        extra, extra_bits = np.where(is_run, extra, 0), np.where(is_run, extra_bits, 0)
    w.put(int(cache_bits > 0), 1)
    if cache_bits:
        w.put(cache_bits, 4)
        table, hits, upto = {}, np.full(len(at), -1), 0
        for i, p in enumerate(at[order].tolist()):
            for q in flat[upto:p].tolist():
                table[(q * CACHE_FACTOR & 0xFFFFFFFF) >> (32 - cache_bits)] = q
            upto = p
            slot = (int(flat[p]) * CACHE_FACTOR & 0xFFFFFFFF) >> (32 - cache_bits)
            if not is_run[i] and table.get(slot) == int(flat[p]):
                hits[i] = slot
        green = np.where(hits >= 0, 256 + LENGTH_CODES + hits, green)
    group, n_groups = np.zeros(len(at), np.int64), 1
    if main:
        w.put(int(group_bits > 0), 1)
        if group_bits:
            w.put(group_bits - 2, 3)
            rows = blocks(len(flat) // width, group_bits)
            image = (np.arange(rows * blocks(width, group_bits)) % 2).astype(np.uint32) << 8
            write_pixels(w, image)
            grid = image.reshape(rows, -1) >> 8
            n_groups = int(grid.max()) + 1
            group = grid[at[order] // width >> group_bits, at[order] % width >> group_bits].astype(np.int64)
    plain = green < 256
    near = 1  # the code of the pixel to the left is 2, of prefix 1
    alphabet = 256 + LENGTH_CODES + ((1 << cache_bits) if cache_bits else 0)
    sets = []
    for g in range(n_groups):
        own = group == g
        used = own & plain
        counted = [np.bincount(green[own], minlength=alphabet)] + [np.bincount(parts[used, c], minlength=256) for c in (2, 0, 3)] + [np.bincount(np.full(int((own & is_run).sum()), near), minlength=DISTANCE_CODES)]
        lengths = [code_lengths(c, LONGEST_CODE) for c in counted]
        for x in lengths:
            write_code(w, x)
        sets.append(lengths)

    def coded(k: int, symbols: np.ndarray, use: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray] | None:
        """(codes, sizes) of the symbols in use; None if none takes a bit."""
        if all(lengths[k].count(0) > len(lengths[k]) - 2 for lengths in sets):
            return None
        if len(sets) == 1 and use is None:
            used, codes = canonical(sets[0][k])
            code = np.zeros(len(sets[0][k]), np.int64)
            code[used] = codes
            return code[symbols], np.frombuffer(sets[0][k], np.uint8)[symbols].astype(np.int64)
        use = np.ones(len(symbols), bool) if use is None else use
        values, bits = np.zeros(len(symbols), np.int64), np.zeros(len(symbols), np.int64)
        for g, lengths in enumerate(sets):
            if lengths[k].count(0) > len(lengths[k]) - 2:
                continue
            used, codes = canonical(lengths[k])
            code, size = np.zeros(len(lengths[k]), np.int64), np.frombuffer(lengths[k], np.uint8)
            code[used] = codes
            own = use if len(sets) == 1 else use & (group == g)
            mine = np.where(own, symbols, 0)
            values, bits = np.where(own, code[mine], values), np.where(own, size[mine], bits)
        return values, bits

    whole = None if plain.all() else plain
    streams = [coded(0, green), (extra, extra_bits) if len(starts) else None]
    streams += [coded(k, parts[:, c], whole) for k, c in ((1, 2), (2, 0), (3, 3))]
    streams.append(coded(4, np.full(len(green), near), is_run))
    streams = [s for s in streams if s is not None]
    if len(streams) == 1:
        w.extend(*streams[0])
    elif streams:
        w.extend(np.stack([s[0] for s in streams], 1).ravel(), np.stack([s[1] for s in streams], 1).ravel())


def wrapped(data: bytes) -> bytes:
    data += bytes(len(data) & 1)
    return b"RIFF" + (len(data) + 12).to_bytes(4, "little") + b"WEBPVP8L" + len(data).to_bytes(4, "little") + data


def started(width: int, height: int) -> Writer:
    w = Writer()
    for value, size in ((SIGNATURE, 8), (width - 1, 14), (height - 1, 14), (0, 1), (0, 3)):
        w.put(value, size)
    return w


def write_greens(w: Writer, greens: np.ndarray) -> None:
    """write_pixels for a main image whose samples all stand in the green channel; a run takes one code and its extra bits."""
    starts, sizes = runs(greens, MIN_RUN)
    symbols, extra, extra_bits = greens, None, None
    if len(starts):
        prefix, own_extra, own_bits = prefix_of(sizes)
        inside = np.zeros(len(greens) + 1, np.int8)
        inside[starts] = 1
        inside[starts + sizes] -= 1
        stays = np.cumsum(inside[:-1]) == 0
        stays[starts] = True
        at = (np.cumsum(stays) - 1)[starts]
        symbols = greens.astype(np.int64)[stays]
        symbols[at] = 256 + prefix
        extra, extra_bits = own_extra, own_bits
    lengths = code_lengths(np.bincount(symbols, minlength=256 + LENGTH_CODES), LONGEST_CODE)
    w.put(0, 2)  # no cache, one code group
    for x in (lengths, ONE_CODE, ONE_CODE, ONE_CODE, NEAR_CODE):
        write_code(w, x)
    used, codes = canonical(lengths)
    code = np.zeros(len(lengths), np.int64)
    code[used] = codes
    size = np.frombuffer(lengths, np.uint8).astype(np.int64)
    if len(used) == 1:
        size = np.zeros_like(size)
    values, bits = code.take(symbols), size.take(symbols)
    if extra is not None:
        values[at] |= extra << bits[at]
        bits[at] += extra_bits
    w.extend(values, bits)


#: A code of the symbol 0 alone, and of the distance that means the pixel before.
ONE_CODE, NEAR_CODE = bytes([1]) + bytes(255), bytes([0, 1]) + bytes(DISTANCE_CODES - 2)


@lru_cache(1)
def palette_codes() -> tuple[tuple[bytes, ...], np.ndarray]:
    """The codes of a palette's steps: eight bits for green, none for red and blue, one for alpha; and green's codes by step."""
    one = bytes([1]) + bytes(255)
    return (bytes([8] * 256) + bytes(LENGTH_CODES), one, one, bytes([1]) + bytes(254) + bytes([1]), bytes([1]) + bytes(DISTANCE_CODES - 1)), canonical(bytes([8] * 256))[1]


def write_palette(w: Writer, steps: np.ndarray) -> None:
    """A palette of green values given by its steps; alpha steps up to 255 at the first one."""
    lengths, green = palette_codes()
    w.put(0, 1)
    for x in lengths:
        write_code(w, x)
    alpha = np.zeros(len(steps), np.int64)
    alpha[0] = 1
    w.extend(green[steps] | alpha << 8, np.full(len(steps), 9))


def encode_samples(samples: np.ndarray) -> bytes:
    """A file of (rows, WIDTH) 8-bit samples: a palette of those that occur, held in the green channel."""
    height, width = samples.shape
    w = started(width, height)
    here = np.bincount(samples.ravel(), minlength=256) > 0
    colours = np.flatnonzero(here)
    index = (np.cumsum(here) - 1).astype(np.uint8)[samples]
    w.put(1, 1)
    w.put(PALETTE, 2)
    w.put(len(colours) - 1, 8)
    write_palette(w, np.diff(colours, prepend=0))
    w.put(0, 1)
    bits = palette_bits(len(colours))
    if bits:
        each = 8 >> bits
        index = np.pad(index, ((0, 0), (0, -width % (1 << bits)))).reshape(height, -1, 1 << bits)
        index = (index << (np.arange(1 << bits, dtype=np.uint8) * each)).sum(-1, dtype=np.uint8)
    write_greens(w, index.ravel())
    return wrapped(w.bytes())


def encode_pixels(pixels: np.ndarray, modes: np.ndarray | None = None, cross: np.ndarray | None = None, bits: int = 2, subtract: bool = False, cache_bits: int = 0, group_bits: int = 0) -> bytes:
    """A file of 32-bit ARGB pixels, with whichever transforms are asked for."""
    height, width = pixels.shape
    w, parts = started(width, height), channels(pixels).copy()
    for kind, image in ((PREDICTOR, modes), (CROSS_COLOUR, cross)):
        if image is not None:
            w.put(1, 1)
            w.put(kind, 2)
            w.put(bits - 2, 3)
            write_pixels(w, image)
            parts = predict_residuals(parts, image, bits) if kind == PREDICTOR else cross_colour(parts, image, bits, -1)
    if subtract:
        w.put(1, 1)
        w.put(SUBTRACT_GREEN, 2)
        parts[..., 0] -= parts[..., 1]
        parts[..., 2] -= parts[..., 1]
    w.put(0, 1)
    write_pixels(w, joined(parts), main=True, cache_bits=cache_bits, group_bits=group_bits, width=width)
    return wrapped(w.bytes())


# Columns


def padded(text: bytes | None) -> bytes:
    text = text or b""
    return text + b" " * (max(WIDTH, -(-len(text) // WIDTH) * WIDTH) - len(text))


def store(payload: bytes) -> bytes:
    """Images of at most ROWS rows of samples, one after the other."""
    samples = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    return b"".join(encode_samples(samples[at : at + ROWS]) for at in range(0, len(samples), ROWS))


def load(media: bytes) -> Iterator[bytes]:
    for file in files_of(media):
        yield ((decode(file) >> 8) & 255).astype(np.uint8).tobytes()


STORED = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])


@pandas_udf(STORED)
def store_texts(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        done: dict[bytes | None, bytes] = {}  # copies within a batch are stored once
        for x in batch:
            if x not in done:
                done[x] = store(padded(x))
        yield pd.DataFrame({"n_bytes": [len(x or b"") for x in batch], "media": [done[x] for x in batch]})


LOADED = T.StructType([T.StructField(c, T.StringType() if c in ("payload_sha256", "media_sha256", "feature") else T.LongType()) for c in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")])


def digest(media: bytes) -> tuple:
    size, sha, tail, counts = 0, hashlib.sha256(), b"", np.zeros(256, np.int64)
    for part in load(media):
        size += len(part)
        sha.update(part)
        tail = (tail + part)[-16:]
        counts += np.bincount(np.frombuffer(part, np.uint8), minlength=256)
    share = counts[counts > 0] / size
    mean = int((counts * np.arange(256)).sum()) / size
    feature = f"mean={mean:.3f};distinct={len(share)};entropy={float(-(share * np.log2(share)).sum()) + 0.0:.3f}"
    return size, sha.hexdigest(), zlib.crc32(tail), len(media), hashlib.sha256(media).hexdigest(), feature


@pandas_udf(LOADED)
def load_media(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        done = {x: digest(x) for x in set(batch)}
        yield pd.DataFrame([done[x] for x in batch], columns=[f.name for f in LOADED.fields])


PIXELS = T.StructType([T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("rgba", T.BinaryType()), T.StructField("error", T.StringType())])


@pandas_udf(PIXELS)
def decode_column(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for data in batch:
            try:
                pixels = decode(data) if data is not None else None
                rows.append((None, None, None, "null") if pixels is None else (pixels.shape[1], pixels.shape[0], channels(pixels)[..., [2, 1, 0, 3]].tobytes(), None))
            except (ValueError, IndexError) as e:
                rows.append((None, None, None, str(e)))
        yield pd.DataFrame(rows, columns=[f.name for f in PIXELS.fields]).astype({"width": "Int32", "height": "Int32"})


def decode_images(df: DataFrame, column: str, to: str = "image") -> DataFrame:
    """df with the pixel array (width, height, rgba, error) of the WebP files in a binary column."""
    return df.withColumn(to, decode_column(F.col(column)))


def store_documents(docs: DataFrame) -> DataFrame:
    """Settled doc_id, n_bytes and media (WebP files) of each text."""
    stored = docs.select("doc_id", store_texts(F.col("text").cast("binary")).alias("s")).select("doc_id", "s.*")
    return common.settle(stored, "media")


def op10_webp_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = store_documents(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return stored.select("doc_id", "n_bytes", load_media("media").alias("d")).select("doc_id", "n_bytes", "d.*")
