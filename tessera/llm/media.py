"""Media columns: TIFF files in a binary column, one row per page.

The reader walks the chain of image directories (classic and big files, either byte order), decodes
uncompressed, PackBits, LZW and deflate strips or tiles, undoes the horizontal and the floating-point
predictor and gives the page's samples. A file that is no TIFF, or a damaged page, gives a row with
``error`` set and no samples, never a failed task.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.common import frugal, map_texts, slices, text_bytes

# Fixed values of the file format.
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
TYPE_BYTES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4, 16: 8, 17: 8, 18: 8}
TYPE_CODES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 13: "I", 16: "Q", 17: "q", 18: "Q"}
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS = 273, 277, 278, 279
PLANAR, PREDICTOR, TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_COUNTS, FORMAT = 284, 317, 322, 323, 324, 325, 339


class Page(NamedTuple):
    page: int
    width: int
    height: int
    samples_per_pixel: int
    bits: int
    compression: int
    predictor: int
    tiled: bool
    data: bytes


def unpack_bits(data: bytes) -> bytes:
    """Undo PackBits: literal runs and repeated bytes."""
    out, at, end = bytearray(), 0, len(data)
    while at < end:
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += n + 2
        elif n > 128:
            if at + 1 >= end:
                break
            out += data[at + 1 : at + 2] * (257 - n)
            at += 2
        else:
            at += 1
    return bytes(out)


def pack_bits(data: bytes) -> bytes:
    """PackBits with runs of three or more as repeats."""
    out, at, n = bytearray(), 0, len(data)
    literal = 0

    def flush(to: int) -> None:
        start = literal
        while start < to:
            stop = min(start + 128, to)
            out.append(stop - start - 1)
            out.extend(data[start:stop])
            start = stop

    while at < n:
        run = 1
        while run < 128 and at + run < n and data[at + run] == data[at]:
            run += 1
        if run >= 3:
            flush(at)
            out.extend((257 - run, data[at]))
            at += run
            literal = at
        else:
            at += run
    flush(n)
    return bytes(out)


def lzw_decode(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, most significant bit first; the width grows one code early."""
    out = bytearray()
    words = [bytes((i,)) for i in range(256)] + [b"", b""]
    width, held, have, last = 9, 0, 0, b""
    for byte in data:
        held, have = (held << 8) | byte, have + 8
        if have < width:
            continue
        have -= width
        code = held >> have
        held &= (1 << have) - 1
        if code == 256:
            del words[258:]
            width, last = 9, b""
        elif code == 257:
            break
        elif not last:
            last = words[code]
            out += last
        else:
            if code < len(words):
                word = words[code]
            elif code == len(words):
                word = last + last[:1]
            else:
                raise ValueError("LZW code out of range")
            out += word
            words.append(last + word[:1])
            last = word
            if len(words) + 1 >= 1 << width and width < 12:
                width += 1
    return bytes(out)


def lzw_encode(data: bytes) -> bytes:
    """The inverse of :func:`lzw_decode`."""
    out, held, have, width = bytearray(), 0, 0, 9

    def put(code: int) -> None:
        nonlocal held, have
        held, have = (held << width) | code, have + width
        while have >= 8:
            have -= 8
            out.append(held >> have)
            held &= (1 << have) - 1

    put(256)
    table, word = {bytes((i,)): i for i in range(256)}, b""
    following = 258
    for i in range(len(data)):
        longer = word + data[i : i + 1]
        if longer in table:
            word = longer
            continue
        put(table[word])
        table[longer] = following
        following += 1
        if following == 4094:
            put(256)
            table, following, width = {bytes((j,)): j for j in range(256)}, 258, 9
        elif following >= 1 << width:
            width += 1
        word = data[i : i + 1]
    if word:
        put(table[word])
        if following + 1 >= 1 << width and width < 12:
            width += 1
    put(257)
    if have:
        out.append((held << (8 - have)) & 255)
    return bytes(out)


#: Bytes that a stored byte can stand for at most.
MOST = {NONE: 1, PACKBITS: 64, DEFLATE: 1040, OLD_DEFLATE: 1040, LZW: 2800}


def expand(data: bytes, compression: int, size: int) -> bytes:
    """The bytes of a strip or tile, of which ``size`` are needed."""
    if compression == NONE:
        return data
    if compression in (DEFLATE, OLD_DEFLATE):
        return zlib.decompressobj().decompress(data, max(size, 1))
    if compression == PACKBITS:
        return unpack_bits(data)
    if compression == LZW:
        return lzw_decode(data)
    raise ValueError(f"compression {compression} is not supported")


def squeeze(data: bytes, compression: int) -> bytes:
    if compression in (DEFLATE, OLD_DEFLATE):
        return zlib.compress(data, 1)
    return {NONE: bytes, PACKBITS: pack_bits, LZW: lzw_encode}[compression](data)


def undo_predictor(raw: bytes, rows: int, width: int, samples: int, bits: int, predictor: int, order: str) -> np.ndarray:
    """Rows of samples in native order."""
    item = bits // 8
    if predictor == 3:
        planes = np.frombuffer(raw, np.uint8, rows * width * samples * item).reshape(rows, -1)
        summed = np.add.accumulate(planes.reshape(rows, -1, samples), axis=1, dtype=np.uint8).reshape(rows, item, -1)
        return np.ascontiguousarray(summed.transpose(0, 2, 1)).view(f">u{item}").reshape(rows, width, samples).astype(f"u{item}")
    out = np.frombuffer(raw, f"{order}u{item}", rows * width * samples).reshape(rows, width, samples).astype(f"u{item}")
    return np.add.accumulate(out, axis=1, dtype=out.dtype) if predictor == 2 else out


def apply_predictor(rows: np.ndarray, predictor: int) -> bytes:
    """Horizontal differences of (rows, width, samples), or the samples as they are."""
    if predictor == 2:
        first = rows[:, :1]
        rows = np.concatenate([first, np.diff(rows, axis=1)], axis=1).astype(rows.dtype)
    return rows.astype(rows.dtype.newbyteorder("<")).tobytes()


def directories(data: bytes) -> Iterator[tuple[dict[int, list[int]], str]]:
    """The tags of each image directory in turn, and the byte order."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None:
        raise ValueError("no TIFF header")
    (magic,) = struct.unpack_from(f"{order}H", data, 2)
    if magic not in (42, 43):
        raise ValueError("no TIFF header")
    big = magic == 43
    word, count_code, entry = ("Q", "Q", 20) if big else ("I", "H", 12)
    (at,) = struct.unpack_from(order + word, data, 8 if big else 4)
    seen: set[int] = set()
    while at:
        if at in seen:
            raise ValueError("image directories form a loop")
        seen.add(at)
        (n,) = struct.unpack_from(order + count_code, data, at)
        at += struct.calcsize(order + count_code)
        tags: dict[int, list[int]] = {}
        for i in range(n):
            tag, kind, count = struct.unpack_from(f"{order}HH{word}", data, at + i * entry)
            where = at + i * entry + (12 if big else 8)
            if kind not in TYPE_CODES:
                continue
            if count * TYPE_BYTES[kind] > (8 if big else 4):
                (where,) = struct.unpack_from(order + word, data, where)
            tags[tag] = list(struct.unpack_from(f"{order}{count}{TYPE_CODES[kind]}", data, where))
        yield tags, order
        (at,) = struct.unpack_from(order + word, data, at + n * entry)


def read_page(data: bytes, tags: dict[int, list[int]], order: str, number: int) -> Page:
    def one(tag: int, default: int | None = None) -> int:
        if tag in tags:
            return tags[tag][0]
        if default is None:
            raise ValueError(f"tag {tag} is missing")
        return default

    width, height = one(WIDTH), one(LENGTH)
    samples, bits = one(SAMPLES, 1), one(BITS, 1)
    compression, predictor = one(COMPRESSION, NONE), one(PREDICTOR, 1)
    if bits not in (8, 16, 32, 64):
        raise ValueError(f"{bits} bits a sample are not supported")
    planes = samples if one(PLANAR, 1) == 2 else 1
    per_part = samples // planes
    listed = sum(tags.get(TILE_COUNTS) or tags.get(STRIP_COUNTS) or [len(data)])
    if height * width * samples * bits // 8 > min(listed, len(data)) * MOST.get(compression, 1):
        raise ValueError("the page is larger than its data can be")
    out = np.zeros((height, width, samples), f"u{bits // 8}")
    tiled = TILE_OFFSETS in tags
    if tiled:
        tw, tl, offsets, counts = one(TILE_WIDTH), one(TILE_LENGTH), tags[TILE_OFFSETS], tags[TILE_COUNTS]
        parts = [(p, y, x, tl, tw) for p in range(planes) for y in range(0, height, tl) for x in range(0, width, tw)]
    else:
        rows, offsets = min(one(ROWS_PER_STRIP, height), height) or 1, tags[STRIP_OFFSETS]
        counts = tags.get(STRIP_COUNTS) or [len(data) - offsets[0]]
        parts = [(p, y, 0, min(rows, height - y), width) for p in range(planes) for y in range(0, height, rows)]
    if not len(parts) == len(offsets) == len(counts):
        raise ValueError(f"{len(parts)} strips or tiles are needed, {min(len(offsets), len(counts))} are listed")
    for (p, y, x, rows, wide), offset, count in zip(parts, offsets, counts, strict=True):
        if offset + count > len(data):
            raise ValueError("a strip or tile lies beyond the end")
        raw = expand(data[offset : offset + count], compression, rows * wide * per_part * bits // 8)
        got = undo_predictor(raw, rows, wide, per_part, bits, predictor, order)[: height - y, : width - x]
        lane = slice(p, p + 1) if planes > 1 else slice(None)
        out[y : y + got.shape[0], x : x + got.shape[1], lane] = got
    return Page(number, width, height, samples, bits, compression, predictor, tiled, out.tobytes())


def read_pages(data: bytes) -> Iterator[Page]:
    """Every page of a file, in the order of its directories."""
    for number, (tags, order) in enumerate(directories(data)):
        yield read_page(data, tags, order, number)


def write_tiff(images: list[np.ndarray], compression: int = DEFLATE, predictor: int = 2, rows_per_strip: int = 1024, tile: tuple[int, int] | None = None) -> bytes:
    """A classic little-endian file; each image is (rows, width) or (rows, width, samples) of unsigned integers."""
    out = bytearray(b"II*\0\0\0\0\0")
    link = 4
    for image in images:
        image = image[:, :, None] if image.ndim == 2 else image
        height, width, samples = image.shape
        pieces = []
        if tile:
            tl, tw = tile
            for y in range(0, height, tl):
                for x in range(0, width, tw):
                    block = np.zeros((tl, tw, samples), image.dtype)
                    part = image[y : y + tl, x : x + tw]
                    block[: part.shape[0], : part.shape[1]] = part
                    pieces.append(block)
        else:
            pieces = [image[y : y + rows_per_strip] for y in range(0, height, rows_per_strip)]
        stored = [squeeze(apply_predictor(p, predictor), compression) for p in pieces]
        offsets = []
        for part in stored:
            offsets.append(len(out))
            out += part + b"\0" * (len(part) % 2)
        counts = [len(p) for p in stored]
        tags = [(WIDTH, 4, [width]), (LENGTH, 4, [height]), (BITS, 3, [image.dtype.itemsize * 8] * samples), (COMPRESSION, 3, [compression]), (PHOTOMETRIC, 3, [2 if samples == 3 else 1])]
        if not tile:
            tags += [(STRIP_OFFSETS, 4, offsets)]
        tags += [(SAMPLES, 3, [samples])]
        if not tile:
            tags += [(ROWS_PER_STRIP, 4, [rows_per_strip]), (STRIP_COUNTS, 4, counts)]
        tags += [(PREDICTOR, 3, [predictor])]
        if tile:
            tags += [(TILE_WIDTH, 4, [tile[1]]), (TILE_LENGTH, 4, [tile[0]]), (TILE_OFFSETS, 4, offsets), (TILE_COUNTS, 4, counts)]
        entries = bytearray()
        for tag, kind, values in tags:
            body = struct.pack(f"<{len(values)}{TYPE_CODES[kind]}", *values)
            if len(body) > 4:
                where = struct.pack("<I", len(out))
                out += body + b"\0" * (len(body) % 2)
                body = where
            entries += struct.pack("<HHI", tag, kind, len(values)) + body.ljust(4, b"\0")
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(tags)) + entries
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


PAGE_SCHEMA = "id long, page int, width int, height int, samples_per_pixel int, bits int, compression int, predictor int, tiled boolean, samples binary, error string"


def tiff_pages(files: DataFrame, id_column: str = "id", content_column: str = "content") -> DataFrame:
    """One row per page of each file in ``content_column``.

    Null content and content without a TIFF header give one row with ``error``; a damaged directory or
    strip ends the file with an ``error`` row after the pages before it. An empty table gives no rows.
    """

    def run(batches):
        for part in slices(batches, "content"):
            rows = []
            for key, data in zip(part.column("id").to_pylist(), part.column("content").to_pylist(), strict=True):
                number = 0
                try:
                    for page in read_pages(data or b""):
                        rows.append((key, *page, None))
                        number = page.page + 1
                except (ValueError, struct.error, zlib.error, IndexError, KeyError, MemoryError, OverflowError) as e:
                    rows.append((key, number, *[None] * 8, str(e)))
            names = ["id", "page", "width", "height", "samples_per_pixel", "bits", "compression", "predictor", "tiled", "samples", "error"]
            kinds = [pa.int64(), *[pa.int32()] * 7, pa.bool_(), pa.binary(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    picked = files.selectExpr(f"cast(`{id_column}` as long) as id", f"cast(`{content_column}` as binary) as content")
    return picked.mapInArrow(frugal(run), PAGE_SCHEMA)


#: Samples of a row, and rows of a page; compressions by an eighth of the texts each.
ROW_BYTES, PAGE_ROWS = 64, 1024
CODECS = (LZW, PACKBITS, NONE, DEFLATE, DEFLATE, DEFLATE, DEFLATE, DEFLATE)
MEDIA_SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def payload_of(text: bytes) -> bytes:
    """The text with bytes 0 up to a positive multiple of 64."""
    return text.ljust(max(ROW_BYTES, -(-len(text) // ROW_BYTES) * ROW_BYTES), b"\0")


def stored_form(payload: bytes) -> bytes:
    """A TIFF of 64 samples a row and 1024 rows a page; what is in the payload says how it is compressed, in strips or tiles, with a predictor or without."""
    dealt = zlib.crc32(payload)
    compression = CODECS[dealt % len(CODECS)]
    predictor = 1 + (dealt >> 3) % 2 if compression in (LZW, DEFLATE) else 1
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW_BYTES)
    pages = [rows[i : i + PAGE_ROWS] for i in range(0, len(rows), PAGE_ROWS)]
    return write_tiff(pages, compression, predictor, tile=(32, 32) if (dealt >> 4) % 4 == 0 else None)


def feature_of(pages: list[Page]) -> str:
    """Pages, size, mean, deviation and levels of pages of 8-bit samples."""
    counts = sum(np.bincount(np.frombuffer(p.data, np.uint8), minlength=256) for p in pages)
    total, values = int(counts.sum()), np.arange(256)
    mean = float(counts @ values) / total
    spread = max(0.0, float(counts @ (values * values)) / total - mean * mean) ** 0.5
    first = pages[0]
    form = f"{len(pages)} pages;compression={first.compression};predictor={first.predictor};tiled={first.tiled}"
    return f"{first.width}x{sum(p.height for p in pages)};{form};mean={mean:.4f};sd={spread:.4f};levels={int((counts > 0).sum())};top={int(counts.argmax())}"


def text_media(docs: DataFrame) -> DataFrame:
    """Every text stored as an 8-bit TIFF, 64 samples a row, read back page by page and described.

    A null or empty text is a page of one row of zeros; a very long one has many pages. Equal texts give equal rows but
    for the id; an empty table gives none.
    """

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for doc_id, text in zip(part.column("doc_id").to_pylist(), text_bytes(part.column("text")), strict=True):
            stored = stored_form(payload_of(text))
            pages = list(read_pages(stored))
            back = b"".join(p.data for p in pages)
            rows.append((doc_id, len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-ROW_BYTES:]), len(stored), hashlib.sha256(stored).hexdigest(), feature_of(pages)))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        names = [f.split()[0] for f in MEDIA_SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return map_texts(docs.select("doc_id", "text"), work, MEDIA_SCHEMA)
