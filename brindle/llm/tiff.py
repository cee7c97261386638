"""TIFF media columns: a reader of image directories and a writer for payloads.

The reader walks the chain of image file directories of either byte order,
decodes strips or tiles stored plain or by PackBits, LZW or deflate, undoes
horizontal differencing, and gives one row per page.  A damaged page becomes a
row whose ``error`` says why, and so does one of more than ``max_samples``
samples; blocks are unpacked no further than the page needs.

The writer stores a byte payload as 8-bit gray pages of width 64.  Pages hold
128 rows in strips of 32 rows or, every second page, in tiles with horizontal
differencing.  Payloads of one row are PackBits, those of up to LZW_ROWS rows
and every third page of longer ones LZW, all others deflate, so equal payloads
have equal files.

Defined cases: a null file gives no page, an empty one a row with an error; a
null text is stored like an empty one, as 64 zeros; null ids and repeated rows
are kept as they are; texts of any length are stored whole; further columns are
not read, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace

# Fixed values of the file format.
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR = 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_COUNTS = 317, 322, 323, 324, 325
PLAIN, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
TYPE_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 16: 8}
TYPE_CODES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 16: "Q"}

PAGE_WIDTH, PAGE_ROWS, STRIP_ROWS, TILE = 64, 128, 32, 64
LZW_ROWS = 8
#: Samples of a page that the reader decodes at most.
MAX_SAMPLES = 1 << 28


class TiffError(ValueError):
    """What is wrong with a file or page."""


def unpack_bits(data: bytes, need: int = sys.maxsize) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n and len(out) < need:
        head = data[i]
        i += 1
        if head < 128:
            out += data[i : i + head + 1]
            i += head + 1
        elif head > 128:
            out += data[i : i + 1] * (257 - head)
            i += 1
    return bytes(out)


def pack_bits(data: bytes) -> bytes:
    """Runs of three or more are repeated, everything else is literal."""
    out, n = bytearray(), len(data)
    values = np.frombuffer(data, np.uint8)
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(values)) + 1, [n])) if n else np.zeros(1, np.int64)
    literal = bytearray()

    def flush() -> None:
        for i in range(0, len(literal), 128):
            part = literal[i : i + 128]
            out.append(len(part) - 1)
            out.extend(part)
        literal.clear()

    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        if b - a < 3:
            literal.extend(data[a:b])
            continue
        flush()
        while b - a > 1:
            size = min(128, b - a)
            out += bytes((257 - size, data[a]))
            a += size
        literal.extend(data[a:b])
    flush()
    return bytes(out)


def unpack_lzw(data: bytes, need: int = sys.maxsize) -> bytes:
    """Most significant bit first, codes of 9 to 12 bits that widen one early."""
    table: list[bytes] = []
    out, width, held, bits, before, have = [], 9, 0, 0, b"", 0
    for byte in data:
        if have >= need:
            break
        held, bits = (held << 8) | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits
        held &= (1 << bits) - 1
        if code == 257:
            break
        if code == 256:
            table, width, before = [bytes((i,)) for i in range(256)] + [b"", b""], 9, b""
            continue
        if not table:
            raise TiffError("LZW data begins without a clear code")
        if code < len(table):
            entry = table[code]
        elif code == len(table) and before:
            entry = before + before[:1]
        else:
            raise TiffError("LZW code out of range")
        out.append(entry)
        have += len(entry)
        if before and len(table) < 4096:
            table.append(before + entry[:1])
        before = entry
        if len(table) >= (1 << width) - 1 and width < 12:
            width += 1
    return b"".join(out)


def pack_lzw(data: bytes) -> bytes:
    out, held, bits = bytearray(), 0, 0
    table, width, size = {bytes((i,)): i for i in range(256)}, 9, 258

    def put(code: int) -> None:
        nonlocal held, bits
        held, bits = (held << width) | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 255)
        held &= (1 << bits) - 1

    put(256)
    run = b""
    for i in range(len(data)):
        longer = run + data[i : i + 1]
        if longer in table:
            run = longer
            continue
        put(table[run])
        table[longer] = size
        size += 1
        if size == 4094:
            put(256)
            table, width, size = {bytes((j,)): j for j in range(256)}, 9, 258
        elif size >= 1 << width:
            width += 1
        run = longer[-1:]
    if run:
        put(table[run])
        size += 1
        if size >= 1 << width and width < 12:
            width += 1
    put(257)
    if bits:
        out.append(held << (8 - bits) & 255)
    return bytes(out)


def inflate(data: bytes, need: int = sys.maxsize) -> bytes:
    return zlib.decompressobj().decompress(data, need)


UNPACK = {PLAIN: lambda data, need: bytes(data[:need]), LZW: unpack_lzw, DEFLATE: inflate, OLD_DEFLATE: inflate, PACKBITS: unpack_bits}
PACK = {PLAIN: bytes, LZW: pack_lzw, DEFLATE: lambda x: zlib.compress(x, 1), PACKBITS: pack_bits}


def directories(data: bytes) -> Iterator[dict[int, tuple]]:
    """The tags of each page, in file order, with ``0`` for the byte order."""
    order = {b"II": "<", b"MM": ">"}.get(bytes(data[:2]))
    if not order or len(data) < 8 or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise TiffError("not a TIFF file")
    at, seen = struct.unpack_from(order + "I", data, 4)[0], set()
    while at:
        if at in seen or at + 2 > len(data):
            raise TiffError("broken chain of directories")
        seen.add(at)
        (n,) = struct.unpack_from(order + "H", data, at)
        if at + 6 + 12 * n > len(data):
            raise TiffError("directory beyond the end")
        tags: dict[int, tuple] = {0: (order,)}
        for i in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
            if kind not in TYPE_CODES:
                continue
            size, where = TYPE_SIZES[kind] * count, at + 10 + 12 * i
            if size > 4:
                where = struct.unpack_from(order + "I", data, where)[0]
            if where + size > len(data):
                raise TiffError(f"tag {tag} beyond the end")
            tags[tag] = struct.unpack_from(f"{order}{count}{TYPE_CODES[kind]}", data, where)
        yield tags
        (at,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)


def page_samples(data: bytes, tags: dict[int, tuple], max_samples: int = MAX_SAMPLES) -> np.ndarray:
    """Samples of one page as (rows, columns, samples)."""
    order = tags[0][0]
    one = lambda tag, default=None: tags[tag][0] if tag in tags else default
    width, height, samples, bits = one(WIDTH), one(LENGTH), one(SAMPLES, 1), one(BITS, 1)
    if not width or not height or bits not in (8, 16) or one(PLANAR, 1) != 1 and samples != 1:
        raise TiffError("unsupported size, depth or plane order")
    if min(width, height, samples) < 0 or width * height * samples > max_samples:
        raise TiffError(f"page of more than {max_samples} samples")
    unpack = UNPACK.get(one(COMPRESSION, 1))
    if unpack is None:
        raise TiffError(f"unsupported compression {one(COMPRESSION)}")
    predictor = one(PREDICTOR, 1)
    if predictor not in (1, 2):
        raise TiffError(f"unsupported predictor {predictor}")
    tiled = TILE_OFFSETS in tags
    wide, high = (one(TILE_WIDTH), one(TILE_LENGTH)) if tiled else (width, min(one(ROWS_PER_STRIP, height), height))
    offsets, counts = (tags[TILE_OFFSETS], tags[TILE_COUNTS]) if tiled else (tags.get(STRIP_OFFSETS, ()), tags.get(STRIP_COUNTS, ()))
    if not wide or not high or wide < 0 or high < 0:
        raise TiffError("strips or tiles without extent")
    across = -(-width // wide)
    if len(offsets) != len(counts) or len(offsets) < across * -(-height // high):
        raise TiffError("too few strips or tiles")
    out = np.zeros((height, width, samples), f"u{bits // 8}")
    for k in range(across * -(-height // high)):
        top, left = k // across * high, k % across * wide
        rows = high if tiled else min(high, height - top)
        if offsets[k] + counts[k] > len(data):
            raise TiffError("strip or tile beyond the end")
        need = rows * wide * samples * bits // 8
        if rows * wide * samples > 4 * max_samples:
            raise TiffError("tile far larger than a page may be")
        raw = unpack(data[offsets[k] : offsets[k] + counts[k]], need)
        if len(raw) < need:
            raise TiffError("strip or tile too short")
        part = np.frombuffer(raw[:need], f"{order}u{bits // 8}").reshape(rows, wide, samples).astype(out.dtype)
        if predictor == 2:
            part = np.cumsum(part, axis=1, dtype=part.dtype)
        out[top : top + rows, left : left + wide] = part[: height - top, : width - left]
    return out


def pages(data: bytes, max_samples: int = MAX_SAMPLES) -> Iterator[tuple[dict[int, tuple], np.ndarray | None, str | None]]:
    """(tags, samples, error) of each page."""
    try:
        for tags in directories(data):
            try:
                yield tags, page_samples(data, tags, max_samples), None
            except (ValueError, zlib.error, struct.error, IndexError, KeyError, TypeError, ArithmeticError, MemoryError) as e:
                yield tags, None, str(e) or type(e).__name__
    except (TiffError, struct.error) as e:
        yield {}, None, str(e)


def write_page(out: bytearray, samples: np.ndarray, compression: int, tile: int = 0, predictor: int = 1, rows_per_strip: int = 0, order: str = "<") -> int:
    """Append the blocks and the directory of an 8- or 16-bit page; returns where the directory's next-pointer is."""
    if samples.ndim == 2:
        samples = samples[:, :, None]
    height, width, depth = samples.shape
    high, wide = (tile, tile) if tile else (rows_per_strip or height, width)
    offsets, counts = [], []
    for top in range(0, height, high):
        for left in range(0, width, wide):
            part = samples[top : top + high, left : left + wide]
            if tile:
                part = np.pad(part, ((0, high - part.shape[0]), (0, wide - part.shape[1]), (0, 0)))
            if predictor == 2:
                part = np.diff(part, axis=1, prepend=part[:, :0].dtype.type(0))
            packed = PACK[compression](part.astype(f"{order}u{part.dtype.itemsize}").tobytes())
            offsets.append(len(out))
            counts.append(len(packed))
            out += packed
    tags = [(WIDTH, 4, (width,)), (LENGTH, 4, (height,)), (BITS, 3, (8 * samples.dtype.itemsize,) * depth), (COMPRESSION, 3, (compression,)), (PHOTOMETRIC, 3, (2 if depth == 3 else 1,)), (SAMPLES, 3, (depth,)), (PREDICTOR, 3, (predictor,))]
    tags += [(TILE_WIDTH, 4, (wide,)), (TILE_LENGTH, 4, (high,)), (TILE_OFFSETS, 4, offsets), (TILE_COUNTS, 4, counts)] if tile else [(STRIP_OFFSETS, 4, offsets), (ROWS_PER_STRIP, 4, (high,)), (STRIP_COUNTS, 4, counts)]
    entries = b""
    for tag, kind, values in sorted(tags):
        body = struct.pack(f"{order}{len(values)}{TYPE_CODES[kind]}", *values)
        if len(body) > 4:
            place = len(out) + len(out) % 2
            out += b"\0" * (place - len(out)) + body
            body = struct.pack(order + "I", place)
        entries += struct.pack(order + "HHI", tag, kind, len(values)) + body.ljust(4, b"\0")
    out += b"\0" * (len(out) % 2)
    at = len(out)
    out += struct.pack(order + "H", len(tags)) + entries + b"\0\0\0\0"
    return at


def write_tiff(images: list[tuple[np.ndarray, dict]], order: str = "<") -> bytes:
    """A file of the given pages; each with the keywords of ``write_page``."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4
    for samples, how in images:
        at = write_page(out, samples, order=order, **how)
        struct.pack_into(order + "I", out, link, at)
        link = len(out) - 4
    return bytes(out)


def payload_tiff(payload: bytes) -> bytes:
    """The stored form of a payload whose size is a multiple of the page width."""
    samples = np.frombuffer(payload, np.uint8).reshape(-1, PAGE_WIDTH)
    images = []
    for k, top in enumerate(range(0, len(samples), PAGE_ROWS)):
        how = {"compression": PACKBITS if len(samples) == 1 else LZW if len(samples) <= LZW_ROWS or k % 3 == 2 else DEFLATE}
        how |= {"tile": TILE, "predictor": 2} if k % 2 else {"rows_per_strip": STRIP_ROWS}
        images.append((samples[top : top + PAGE_ROWS], how))
    return write_tiff(images)


STORED_SCHEMA = "doc_id long, n_bytes long, media binary"


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes and a ``media`` column with each text's bytes, padded with zeros to a positive multiple of 64, as a TIFF file.

    A null text counts as empty, and an empty one is stored as 64 zeros.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, 512):
                batch = whole.slice(begin, 512)
                texts = [b"" if x is None else x for x in batch.column(1).cast(pa.binary()).to_pylist()]
                media = [payload_tiff(t + bytes(-len(t) % PAGE_WIDTH or (0 if t else PAGE_WIDTH))) for t in texts]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, STORED_SCHEMA)


PAGES_SCHEMA = "id long, page int, width int, height int, samples int, bits int, compression int, predictor int, tiled boolean, data binary, error string"


def tiff_pages(media: DataFrame, id_col: str = "doc_id", media_col: str = "media", max_samples: int = MAX_SAMPLES) -> DataFrame:
    """One row per page of each file, with its samples in row order (16-bit ones little-endian)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in PAGES_SCHEMA.split(", ")]
        kinds = [pa.int64()] + [pa.int32()] * 7 + [pa.bool_(), pa.binary(), pa.string()]
        for batch in batches:
            for i in range(batch.num_rows):
                if (data := batch.column(1)[i].as_py()) is None:
                    continue
                for k, (tags, samples, error) in enumerate(pages(data, max_samples)):
                    one = lambda tag, default=None: tags[tag][0] if tags.get(tag) else default  # noqa: B023, E731
                    row = [batch.column(0)[i].as_py(), k, one(WIDTH), one(LENGTH), one(SAMPLES, 1), one(BITS), one(COMPRESSION, 1), one(PREDICTOR, 1), TILE_OFFSETS in tags, None if samples is None else samples.astype(f"<u{samples.dtype.itemsize}").tobytes(), error]
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)], names=names)

    return media.select(F.col(id_col).cast("long").alias("id"), F.col(media_col).cast("binary").alias("media")).mapInArrow(run, PAGES_SCHEMA)


DIGEST_SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def page_feature(stack: list[np.ndarray]) -> str:
    """Pages, rows, sum, distinct values and a histogram of eight ranges, over the pages of one file."""
    counts = sum(np.bincount(p.ravel(), minlength=256) for p in stack)
    ranges = "|".join(map(str, counts.reshape(8, 32).sum(axis=1).tolist()))
    return f"pages={len(stack)};rows={sum(len(p) for p in stack)};sum={int(counts @ np.arange(256))};distinct={int(np.count_nonzero(counts))};ranges={ranges}"


def stored_digest(stored: DataFrame) -> DataFrame:
    """Decode each stored file and return its digests and features, one row per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for i in range(batch.num_rows):
                media = batch.column(2)[i].as_py()
                stack = []
                for _, samples, error in pages(media):
                    if error:
                        raise TiffError(error)
                    stack.append(samples[:, :, 0])
                payload = b"".join(p.tobytes() for p in stack)
                for into, value in zip(out, (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), page_feature(stack))):
                    into.append(value)
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(v, t) for v, t in zip(out, kinds))], names=[x.split()[0] for x in DIGEST_SCHEMA.split(", ")])

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(run, DIGEST_SCHEMA)


def text_media_digest(docs: DataFrame) -> DataFrame:
    """Store every text as TIFF in a table, read the table back and digest what is in it."""
    space = Workspace(docs.sparkSession, "tiff")
    return stored_digest(space.write(store_texts(docs), "media", "none"))
