"""Media columns: TIFF files in binary columns.

``read_pages`` walks the image directories of each file (both byte orders, classic and 64-bit files), decodes strips or
tiles (none, PackBits, LZW, deflate), undoes predictors (horizontal differences; floating point) and gives one row for
each page. ``store`` writes bytes as grey 8-bit pages of a fixed width and reads them back with the same reader.

Results for odd input: a null or empty file has no pages and gives no rows; a file that is broken gives one row for
each page before the fault and one row with ``error`` set; a chain of directories that returns to itself ends there;
repeated rows are read one by one; an empty table gives an empty table. Columns of the input with the names of result
columns are dropped. A null text is stored as an empty text: one block of zero bytes.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._arrow import map_chunks

# Fixed values of the format: tags, compression schemes, field types (letter of struct, size).
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR, PAGE_NUMBER = 273, 277, 278, 279, 284, 297
PREDICTOR, TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_COUNTS, SAMPLE_FORMAT = 317, 322, 323, 324, 325, 339
NONE, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946
TYPES = {1: ("B", 1), 3: ("H", 2), 4: ("I", 4), 6: ("b", 1), 8: ("h", 2), 9: ("i", 4), 16: ("Q", 8), 17: ("q", 8)}
CLEAR, STOP = 256, 257

#: ``store``: bytes in a row, rows in a strip and in a page, so a page holds at most 1 MiB; rows and columns of a tile.
ROW_BYTES, STRIP_ROWS, PAGE_ROWS, TILE = 64, 1024, 16384, (64, 32)
#: Decoded bytes for each byte of the file at most: no scheme here reaches it, and nothing larger is allocated.
MOST_EXPANSION = 1 << 12


class TiffError(ValueError):
    """The file does not follow the format, or uses a part of it that is not supported."""


def unpack_bits(raw: bytes, size: int) -> bytes:
    out, i = bytearray(), 0
    while i < len(raw) and len(out) < size:
        n = raw[i]
        if n < 128:
            out += raw[i + 1 : i + 2 + n]
            i += n + 2
        elif n > 128:
            out += raw[i + 1 : i + 2] * (257 - n)
            i += 2
        else:
            i += 1
    return bytes(out)


def pack_bits(raw: bytes) -> bytes:
    """Runs of three or more equal bytes as runs, the rest as literals."""
    data = np.frombuffer(raw, np.uint8)
    edge = np.concatenate([[0], np.flatnonzero(data[1:] != data[:-1]) + 1, [len(data)]]) if len(data) else np.zeros(1, int)
    long = np.flatnonzero(np.diff(edge) >= 3)
    out, done = bytearray(), 0

    def literal(stop: int) -> None:
        for i in range(done, stop, 128):
            out.append(min(128, stop - i) - 1)
            out.extend(raw[i : min(i + 128, stop)])

    for a, b in zip(edge[long].tolist(), edge[long + 1].tolist()):
        literal(a)
        while b - a >= 2:
            n = min(128, b - a)
            out.extend((257 - n, raw[a]))
            a += n
        done = a  # a byte that is left goes with the next literal
    literal(len(raw))
    return bytes(out)


def _widths(n: int) -> np.ndarray:
    """Bits of each of n codes after a clear code: wider from the code on before which the entry 511, 1023, 2047 came."""
    entries = np.arange(n) + 258
    return 9 + (entries >= 512).astype(np.int64) + (entries >= 1024) + (entries >= 2048)


def _codes(data: np.ndarray, at: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(the next n codes from bit ``at``, the bit after each); fewer at the end of the data."""
    stops = at + np.cumsum(_widths(n))
    stops = stops[stops <= 8 * len(data)]
    width = np.diff(stops, prepend=at)
    first = (stops - width) >> 3
    padded = np.append(data, np.zeros(3, np.uint8)).astype(np.uint32)
    window = padded[first] << 16 | padded[first + 1] << 8 | padded[first + 2]
    return (window >> (24 - (stops - width - 8 * first) - width).astype(np.uint32)) & ((1 << width) - 1).astype(np.uint32), stops


def lzw_decode(raw: bytes, size: int) -> bytes:
    """Codes are cut apart a table's life at a time: after a clear code their widths follow from their number."""
    data, at, out, total = np.frombuffer(raw, np.uint8), 0, [], 0
    single = [bytes([i]) for i in range(256)] + [b"", b""]
    table, last, width = single[:], b"", 9
    fresh = True  # right after a clear code
    while total < size:
        if fresh:
            codes, stops = _codes(data, at, 4096)
        else:  # a table that stays full: its codes have 12 bits
            n = max(0, min(4096, (8 * len(data) - at) // 12))
            stops = at + 12 * np.arange(1, n + 1)
            first = (stops - 12) >> 3
            pair = np.append(data, np.zeros(2, np.uint8)).astype(np.uint32)
            codes = ((pair[first] << 16 | pair[first + 1] << 8 | pair[first + 2]) >> (12 - (stops - 12 - 8 * first)).astype(np.uint32)) & 0xFFF
        if not len(codes):
            break
        ends = np.flatnonzero((codes == CLEAR) | (codes == STOP))
        n = int(ends[0]) if len(ends) else len(codes)
        for code in codes[:n].tolist():
            if last == b"":
                if code > 255:
                    raise TiffError("LZW data start with an unknown code")
                piece = single[code]
            elif code < len(table):
                piece = table[code]
                if len(table) < 4096:
                    table.append(last + piece[:1])
            elif code == len(table):
                piece = last + last[:1]
                table.append(piece)
            else:
                raise TiffError("LZW data hold an unknown code")
            out.append(piece)
            total += len(piece)
            last = piece
            if total >= size:
                break
        if n == len(codes):
            at, fresh = int(stops[-1]), False
            continue
        if codes[n] == STOP:
            break
        at, fresh, table, last = int(stops[n]), True, single[:], b""
    return b"".join(out)


def lzw_encode(raw: bytes) -> bytes:
    codes, lives, table, used = [], [], {}, 258  # lives: codes of each table, with the clear code that ends it
    word, start = -1, 0
    for byte in raw:
        if word < 0:
            word = byte
            continue
        key = word << 8 | byte
        longer = table.get(key)
        if longer is not None:
            word = longer
            continue
        codes.append(word)
        table[key] = used
        used += 1
        word = byte
        if used == 4094:
            codes.append(CLEAR)
            lives.append(len(codes) - start)
            table, used, start = {}, 258, len(codes)
    if word >= 0:
        codes.append(word)
    codes.append(STOP)
    lives.append(len(codes) - start)
    width = np.concatenate([[9], *(_widths(n) for n in lives)])
    number = np.repeat(np.array([CLEAR, *codes], np.int64), width)
    place = np.arange(len(number)) - np.repeat(np.cumsum(width) - width, width)
    return np.packbits((number >> (np.repeat(width, width) - 1 - place)).astype(np.uint8) & 1).tobytes()


def decompress(raw: bytes, scheme: int, size: int) -> bytes:
    """The first ``size`` bytes of a strip or tile."""
    if scheme == NONE:
        out = raw[:size]
    elif scheme in (DEFLATE, OLD_DEFLATE):
        try:
            out = zlib.decompressobj().decompress(raw, size)
        except zlib.error as e:
            raise TiffError(f"deflate data are broken: {e}") from e
    elif scheme == LZW:
        out = lzw_decode(raw, size)[:size]
    elif scheme == PACKBITS:
        out = unpack_bits(raw, size)[:size]
    else:
        raise TiffError(f"compression {scheme} is not supported")
    if len(out) < size:
        raise TiffError(f"{len(out)} bytes of {size} in a strip or tile")
    return out


def compress(raw: bytes, scheme: int) -> bytes:
    return {NONE: bytes, LZW: lzw_encode, PACKBITS: pack_bits, DEFLATE: lambda x: zlib.compress(x, 1)}[scheme](raw)


@dataclass(frozen=True)
class Page:
    """One page: samples as (height, width, channels)."""

    number: int
    width: int
    height: int
    channels: int
    bits: int
    compression: int
    predictor: int
    tiled: bool
    samples: np.ndarray


def directories(file: bytes) -> Iterator[tuple[str, dict[int, tuple]]]:
    """(byte order, tags with integer values) of every image directory, along the chain."""
    order = {b"II": "<", b"MM": ">"}.get(bytes(file[:2]))
    if order is None or len(file) < 8:
        raise TiffError("no TIFF header")
    kind = struct.unpack_from(order + "H", file, 2)[0]
    if kind not in (42, 43):
        raise TiffError("no TIFF header")
    big = kind == 43
    count, word, entry = ("Q", "Q", 20) if big else ("H", "I", 12)

    def read(letter: str, at: int, n: int = 1) -> tuple:
        if at < 0 or n < 0 or at + n * struct.calcsize(letter) > len(file):
            raise TiffError(f"{n} values at {at} lie outside the file")
        return struct.unpack_from(f"{order}{n}{letter}", file, at)

    at, seen = read(word, 8 if big else 4)[0], set()
    while at and at not in seen:
        seen.add(at)
        n = read(count, at)[0]
        at += struct.calcsize(count)
        if n * entry > len(file):
            raise TiffError(f"a directory of {n} tags lies outside the file")
        tags = {}
        for i in range(n):
            place = at + i * entry
            (tag, code), (m,) = read("H", place, 2), read(word, place + 4)
            letter, size = TYPES.get(code, ("", 0))
            if not letter or not m:
                continue
            place += 4 + struct.calcsize(word)
            if m * size > struct.calcsize(word):
                place = read(word, place)[0]
            tags[tag] = read(letter, place, m)
        yield order, tags
        at = read(word, at + n * entry)[0]


def undo_predictor(rows: np.ndarray, predictor: int) -> np.ndarray:
    """rows: (height, width, channels)."""
    if predictor == 1:
        return rows
    if predictor == 2:
        return np.cumsum(rows, axis=1, dtype=rows.dtype)
    raise TiffError(f"predictor {predictor} is not supported for these samples")


def read_pages_of(file: bytes) -> Iterator[Page]:
    """Pages of one file, in the order of its directories."""
    for number, (order, tags) in enumerate(directories(file)):
        def one(tag: int, default: int | None = None) -> int:
            value = tags.get(tag, (default,))[0]
            if value is None:
                raise TiffError(f"tag {tag} is missing")
            return value

        width, height, channels = one(WIDTH), one(LENGTH), one(SAMPLES, 1)
        depth, scheme, predictor, planar = set(tags.get(BITS, (1,))), one(COMPRESSION, 1), one(PREDICTOR, 1), one(PLANAR, 1)
        kind = one(SAMPLE_FORMAT, 1)
        bits = depth.pop()
        if depth or bits not in (8, 16, 32, 64):
            raise TiffError(f"samples of {sorted(depth | {bits})} bits are not supported")
        letter = {1: "u", 2: "i", 3: "f"}.get(kind)
        if letter is None or (letter == "f" and bits == 8):
            raise TiffError(f"sample format {kind} of {bits} bits is not supported")
        dtype = np.dtype(f"{order}{letter}{bits // 8}")
        tiled = TILE_OFFSETS in tags
        wide = one(TILE_WIDTH) if tiled else width
        high = one(TILE_LENGTH) if tiled else min(one(ROWS_PER_STRIP, 2**32 - 1), max(height, 1))
        offsets, counts = tags.get(TILE_OFFSETS if tiled else STRIP_OFFSETS), tags.get(TILE_COUNTS if tiled else STRIP_COUNTS)
        if offsets is None or counts is None or min(width, height, channels, wide, high) < 1:
            raise TiffError("a page has no samples")
        across, down, planes = -(-width // wide), -(-height // high), channels if planar == 2 else 1
        inner = channels // planes
        most = len(file) * MOST_EXPANSION
        if height * width * channels * dtype.itemsize > most or high * wide * inner * dtype.itemsize > most:
            raise TiffError(f"{width} x {height} samples cannot come from a file of {len(file)} bytes")
        if min(len(offsets), len(counts)) < across * down * planes or min(*offsets, *counts) < 0:
            raise TiffError("strips or tiles are missing")
        out = np.zeros((height, width, channels), dtype.newbyteorder("="))
        for k in range(across * down * planes):
            plane, cell = divmod(k, across * down)
            y, x = cell // across * high, cell % across * wide
            rows = high if tiled else min(high, height - y)
            raw = decompress(file[offsets[k] : offsets[k] + counts[k]], scheme, rows * wide * inner * dtype.itemsize)
            if predictor == 3 and letter == "f":
                # Bytes of a row stand by significance, most significant first, each the difference from the one before.
                apart = np.frombuffer(raw, np.uint8).reshape(rows, dtype.itemsize, wide * inner)
                planes_of_bytes = np.cumsum(apart.reshape(rows, -1, inner), axis=1, dtype=np.uint8).reshape(apart.shape)
                block = np.ascontiguousarray(planes_of_bytes.transpose(0, 2, 1)).view(dtype.newbyteorder(">")).reshape(rows, wide, inner)
            else:
                block = np.frombuffer(raw, dtype).astype(dtype.newbyteorder("=")).reshape(rows, wide, inner)
                block = undo_predictor(block, predictor if letter != "f" or predictor == 1 else -predictor)
            channel = slice(plane, plane + 1) if planes > 1 else slice(None)
            out[y : y + rows, x : x + wide, channel] = block[: height - y, : width - x]
        yield Page(number, width, height, channels, bits, scheme, predictor, tiled, out)


def write_file(pages: list[np.ndarray], scheme: int = DEFLATE, predictor: int = 1, strip_rows: int = STRIP_ROWS, tile: tuple[int, int] | None = None, order: str = "<", planar: int = 1) -> bytes:
    """A file of pages given as (height, width, channels) or (height, width) arrays of unsigned integers."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 8))
    link = 4
    for number, page in enumerate(pages):
        page = page if page.ndim == 3 else page[:, :, None]
        height, width, channels = page.shape
        high, wide = tile or (min(strip_rows, height), width)
        parts = []
        for plane in (page[:, :, i : i + 1] for i in range(channels)) if planar == 2 else (page,):
            for y in range(0, height, high):
                for x in range(0, width, wide):
                    block = plane[y : y + high, x : x + wide]
                    if tile:
                        block = np.pad(block, ((0, high - block.shape[0]), (0, wide - block.shape[1]), (0, 0)))
                    if predictor == 2:
                        block = np.diff(block, axis=1, prepend=block[:, :1] * 0)
                    parts.append(compress(block.astype(page.dtype.newbyteorder(order)).tobytes(), scheme))
        offsets = []
        for part in parts:
            offsets.append(len(out))
            out += part
        tags = {WIDTH: ("I", [width]), LENGTH: ("I", [height]), BITS: ("H", [page.dtype.itemsize * 8] * channels), COMPRESSION: ("H", [scheme]), PHOTOMETRIC: ("H", [1]), SAMPLES: ("H", [channels]), PLANAR: ("H", [planar]), PREDICTOR: ("H", [predictor]), PAGE_NUMBER: ("H", [number & 0xFFFF, min(len(pages), 0xFFFF)])}
        if tile:
            tags |= {TILE_WIDTH: ("I", [wide]), TILE_LENGTH: ("I", [high]), TILE_OFFSETS: ("I", offsets), TILE_COUNTS: ("I", [len(x) for x in parts])}
        else:
            tags |= {STRIP_OFFSETS: ("I", offsets), ROWS_PER_STRIP: ("I", [high]), STRIP_COUNTS: ("I", [len(x) for x in parts])}
        entries = []
        for tag, (letter, values) in sorted(tags.items()):
            raw = struct.pack(f"{order}{len(values)}{letter}", *values)
            if len(raw) > 4:
                place, raw = len(out) + len(out) % 2, raw
                out += b"\0" * (len(out) % 2) + raw
                raw = struct.pack(order + "I", place)
            entries.append(struct.pack(order + "HHI", tag, {"H": 3, "I": 4}[letter], len(values)) + raw.ljust(4, b"\0"))
        out += b"\0" * (len(out) % 2)
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(entries)) + b"".join(entries) + struct.pack(order + "I", 0)
        link = len(out) - 4
    return bytes(out)


def features(samples: np.ndarray) -> str:
    """Whole numbers of 8-bit samples: count, sum, sum of squares, sum of steps along rows, and a histogram of 8 bins."""
    flat = samples.reshape(-1)
    histogram = np.bincount(flat, minlength=256)
    level = np.arange(256)
    steps = int(np.abs(np.diff(samples.reshape(-1, samples.shape[1]).astype(np.int16), axis=1)).sum())
    bins = ",".join(map(str, histogram.reshape(8, 32).sum(1).tolist()))
    return f"n={len(flat)};sum={int(histogram @ level)};squares={int(histogram @ level**2)};steps={steps};bins={bins}"


def store_bytes(text: bytes) -> bytes:
    """The file of a text: padded with zero bytes to rows of 64, in pages of at most 1 MiB.

    Scheme, predictor and layout follow from the payload's checksum, whatever its length: PackBits, LZW or deflate; strips
    or tiles; plain samples or horizontal differences.
    """
    rows = max(1, -(-len(text) // ROW_BYTES))
    payload = np.zeros(rows * ROW_BYTES, np.uint8)
    payload[: len(text)] = np.frombuffer(text, np.uint8)
    grid, choice = payload.reshape(rows, ROW_BYTES), zlib.crc32(payload.tobytes())
    return write_file([grid[i : i + PAGE_ROWS] for i in range(0, rows, PAGE_ROWS)], (PACKBITS, LZW, DEFLATE)[choice % 3], 1 + choice // 3 % 2, tile=TILE if choice // 6 % 2 else None)


def store(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep``, n_bytes, media (the stored file), payload (what is read back from it), pages, feature."""
    own = {"n_bytes", "media", "payload", "pages", "feature"}
    keep = [c for c in (docs.columns if keep is None else keep) if c != text and c not in own]

    def kernel(data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
        raw, cuts = data.tobytes(), offsets.tolist()
        media, payload, pages, feature = [], [], [], []
        for a, b in zip(cuts, cuts[1:]):
            media.append(store_bytes(raw[a:b]))
            grids = [page.samples[:, :, 0] for page in read_pages_of(media[-1])]
            grid = grids[0] if len(grids) == 1 else np.concatenate(grids)
            payload.append(grid.tobytes())
            pages.append(len(grids))
            feature.append(features(grid))
        return [pa.array(np.diff(offsets)), pa.array(media, pa.binary()), pa.array(payload, pa.binary()), pa.array(pages, pa.int32()), pa.array(feature)]

    return map_chunks(docs, text, kernel, "n_bytes bigint, media binary, payload binary, pages int, feature string", keep)


def read_pages(files: DataFrame, media: str = "media", keep: list[str] | None = None) -> DataFrame:
    """One row for each page: ``keep``, page, width, height, channels, bits, compression, predictor, tiled, samples
    (native byte order, row by row), error."""
    own = {"page", "width", "height", "channels", "bits", "compression", "predictor", "tiled", "samples", "error"}
    keep = [c for c in (files.columns if keep is None else keep) if c != media and c not in own]

    def kernel(data: np.ndarray, offsets: np.ndarray):
        raw, cuts, index, rows = data.tobytes(), offsets.tolist(), [], []
        for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
            number = 0
            try:
                for page in read_pages_of(raw[a:b]) if b > a else ():
                    rows.append((page.number, page.width, page.height, page.channels, page.bits, page.compression, page.predictor, page.tiled, page.samples.tobytes(), None))
                    index.append(i)
                    number = page.number + 1
            except (TiffError, ValueError, OverflowError, struct.error, zlib.error) as e:  # whatever a broken file leads to
                rows.append((number, None, None, None, None, None, None, None, None, str(e)))
                index.append(i)
        columns = list(zip(*rows)) if rows else [()] * 10
        types = [pa.int32()] * 7 + [pa.bool_(), pa.binary(), pa.string()]
        return np.array(index, np.int64), [pa.array(list(c), t) for c, t in zip(columns, types)]

    schema = "page int, width int, height int, channels int, bits int, compression int, predictor int, tiled boolean, samples binary, error string"
    return map_chunks(files, media, kernel, schema, keep)
