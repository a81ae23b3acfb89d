"""TIFF media columns: write byte payloads as TIFF files and read them back.

The reader walks the chain of image directories (both byte orders), decodes
strips and tiles stored plainly, by PackBits, LZW or deflate, undoes the
horizontal predictor, and yields one page per directory.  The writer produces
the same forms, so that payloads survive a round trip through real files.

Defined results
---------------
* A null payload counts as empty; padding makes it one row of blanks.
* Equal payloads give equal files (no dates, no names inside).
* ``read_pages`` raises ``ValueError`` for damaged or unsupported files; the
  DataFrame form gives such a row one page with the message in ``error``.
* A long text takes more pages, of bounded size; repeated rows have files of their own.
* Extra columns pass through; those with the names of added ones are replaced.
* A page that claims more samples than its stored bytes can hold is damaged.
* An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from paginal.llm.common import small_batches, spare_name

# Fixed values of the TIFF 6.0 format: tag numbers, compression codes, type sizes.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES, PLANAR, PREDICTOR = 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES = 322, 323, 324, 325
PLAIN, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
TYPE_SIZE = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
TYPE_CODE = {1: "B", 3: "H", 4: "I"}

#: Bytes of one row of samples: 64 pixels of three samples.
ROW_BYTES, PIXELS, CHANNELS = 192, 64, 3
#: Rows of samples in a strip, and in a page; longer payloads take more pages.
STRIP_ROWS, PAGE_ROWS = 256, 4096
#: Pixels of a tile across and down.
TILE = (32, 32)


@dataclass
class Page:
    """One image of a file; samples: height x width x channels, 8 bits each."""

    width: int
    height: int
    channels: int
    compression: int
    samples: np.ndarray


def pack_bits(data: bytes) -> bytes:
    """PackBits: runs of three equal bytes and more, what lies between as literals."""
    out = bytearray()
    raw = np.frombuffer(data, dtype=np.uint8)
    edges = np.concatenate([[0], np.flatnonzero(raw[1:] != raw[:-1]) + 1, [len(raw)]]) if len(raw) else np.zeros(1, np.int64)
    size = np.diff(edges)
    long = np.flatnonzero(size >= 3)

    def literal(first: int, stop: int) -> None:
        for at in range(first, stop, 128):
            part = data[at : min(at + 128, stop)]
            out.append(len(part) - 1)
            out.extend(part)

    behind = 0
    for first, n in zip(edges[long].tolist(), size[long].tolist()):
        literal(behind, first)
        behind = first + n
        while n:
            # A rest of one or two is a short run, which is as valid.
            run = min(n, 128)
            out.extend((257 - run, data[first]) if run > 1 else (0, data[first]))
            n -= run
    literal(behind, len(data))
    return bytes(out)


def unpack_bits(data: bytes) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n:
        head = data[i]
        if head < 128:
            if i + 2 + head > n:
                raise ValueError("PackBits: a literal is cut off")
            out += data[i + 1 : i + 2 + head]
            i += 2 + head
        elif head == 128:
            i += 1
        else:
            if i + 1 >= n:
                raise ValueError("PackBits: a run is cut off")
            out += data[i + 1 : i + 2] * (257 - head)
            i += 2
    return bytes(out)


# Fixed values of TIFF's LZW: code widths, the clear and end codes.
LZW_CLEAR, LZW_END, LZW_LEAST, LZW_MOST = 256, 257, 9, 12


def lzw_pack(data: bytes) -> bytes:
    """TIFF's LZW: codes most significant bit first, widths grow one code early."""
    codes, widths = [LZW_CLEAR], [LZW_LEAST]
    # An entry is known by its prefix's code and its last byte.
    table: dict[int, int] = {}
    fresh, width, word = LZW_END + 1, LZW_LEAST, -1
    full = (1 << LZW_MOST) - 1
    for b in data:
        if word < 0:
            word = b
            continue
        key = word << 8 | b
        longer = table.get(key)
        if longer is not None:
            word = longer
            continue
        codes.append(word)
        widths.append(width)
        table[key] = fresh
        fresh += 1
        if fresh == full:
            codes.append(LZW_CLEAR)
            widths.append(width)
            table.clear()
            fresh, width = LZW_END + 1, LZW_LEAST
        elif fresh == 1 << width:
            width += 1
        word = b
    if word >= 0:
        codes.append(word)
        widths.append(width)
        fresh += 1
        if fresh == 1 << width and width < LZW_MOST:
            width += 1
    codes.append(LZW_END)
    widths.append(width)
    wide, value = np.array(widths), np.array(codes)
    which = np.repeat(np.arange(len(wide)), wide)
    bit = np.repeat(np.cumsum(wide), wide) - 1 - np.arange(len(which))
    return np.packbits((value[which] >> bit & 1).astype(np.uint8)).tobytes()


def lzw_unpack(data: bytes) -> bytes:
    out: list[bytes] = []
    single = [bytes([x]) for x in range(256)] + [b"", b""]
    table: list[bytes] = []
    width, pool, held, last = LZW_LEAST, 0, 0, b""
    for b in data:
        pool, held = (pool << 8 | b) & 0xFFFFFF, held + 8
        if held < width:
            continue
        held -= width
        code = pool >> held & (1 << width) - 1
        n = len(table)
        if code == LZW_CLEAR:
            table = single.copy()
            width, last = LZW_LEAST, b""
            continue
        if code == LZW_END:
            break
        if code < n:
            word = table[code]
        elif code == n and last:
            word = last + last[:1]
        else:
            raise ValueError("LZW: a code before its entry" if n else "LZW: no clear code at the start")
        out.append(word)
        if last and n < 1 << LZW_MOST:
            table.append(last + word[:1])
            n += 1
        last = word
        # The writer's table is one entry ahead of the reader's.
        if n + 1 >= 1 << width and width < LZW_MOST:
            width += 1
    return b"".join(out)


#: Most bytes that one stored byte can stand for.
MOST_OF_ONE = {PLAIN: 1, PACKBITS: 64, LZW: 4096, DEFLATE: 1040, OLD_DEFLATE: 1040}
PACK = {PLAIN: bytes, PACKBITS: pack_bits, LZW: lzw_pack, DEFLATE: lambda data: zlib.compress(data, 1)}


def _unpack(data: bytes, compression: int, expected: int) -> bytes:
    if compression == PLAIN:
        return data
    if compression == PACKBITS:
        return unpack_bits(data)
    if compression == LZW:
        return lzw_unpack(data)
    if compression in (DEFLATE, OLD_DEFLATE):
        stream = zlib.decompressobj()
        try:
            return stream.decompress(data, expected)
        except zlib.error as e:
            raise ValueError(f"deflate: {e}") from e
    raise ValueError(f"compression {compression} is not supported")


def write_tiff(
    pages: list[np.ndarray],
    compression: int = DEFLATE,
    predictor: bool = True,
    tile: tuple[int, int] | None = None,
    order: str = "<",
    strip_rows: int = STRIP_ROWS,
) -> bytes:
    """A TIFF of 8-bit pages (height x width x channels) in strips or tiles."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4
    for page in pages:
        height, width, channels = page.shape
        pieces = []
        if tile:
            across, down = tile
            for y in range(0, height, down):
                for x in range(0, width, across):
                    piece = np.zeros((down, across, channels), dtype=np.uint8)
                    part = page[y : y + down, x : x + across]
                    piece[: part.shape[0], : part.shape[1]] = part
                    pieces.append(piece)
        else:
            pieces = [page[y : y + strip_rows] for y in range(0, height, strip_rows)]
        offsets, sizes = [], []
        for piece in pieces:
            if predictor:
                moved = piece.copy()
                moved[:, 1:] -= piece[:, :-1]
                piece = moved
            packed = PACK[compression](piece.tobytes())
            offsets.append(len(out))
            sizes.append(len(packed))
            out += packed
        entries = [
            (WIDTH, 4, [width]), (HEIGHT, 4, [height]), (BITS, 3, [8] * channels), (COMPRESSION, 3, [compression]),
            (PHOTOMETRIC, 3, [2 if channels == 3 else 1]), (SAMPLES, 3, [channels]), (PLANAR, 3, [1]),
            (PREDICTOR, 3, [2 if predictor else 1]),
        ]
        if tile:
            entries += [(TILE_WIDTH, 4, [tile[0]]), (TILE_HEIGHT, 4, [tile[1]]), (TILE_OFFSETS, 4, offsets), (TILE_BYTES, 4, sizes)]
        else:
            entries += [(STRIP_OFFSETS, 4, offsets), (ROWS_PER_STRIP, 4, [strip_rows]), (STRIP_BYTES, 4, sizes)]
        fields = []
        for tag, kind, values in sorted(entries):
            raw = struct.pack(f"{order}{len(values)}{TYPE_CODE[kind]}", *values)
            if len(raw) > 4:
                out += b"\0" * (len(out) % 2)
                raw, at = struct.pack(order + "I", len(out)), raw
                out += at
            fields.append(struct.pack(order + "HHI", tag, kind, len(values)) + raw.ljust(4, b"\0"))
        out += b"\0" * (len(out) % 2)
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(fields)) + b"".join(fields)
        link = len(out)
        out += struct.pack(order + "I", 0)
    return bytes(out)


def _directory(data: bytes, at: int, order: str) -> tuple[dict[int, tuple[int, ...]], int]:
    (n,) = struct.unpack_from(order + "H", data, at)
    tags: dict[int, tuple[int, ...]] = {}
    for k in range(n):
        entry = at + 2 + 12 * k
        tag, kind, count = struct.unpack_from(order + "HHI", data, entry)
        if kind not in TYPE_CODE:
            continue
        place = entry + 8
        if TYPE_SIZE[kind] * count > 4:
            (place,) = struct.unpack_from(order + "I", data, place)
        tags[tag] = struct.unpack_from(f"{order}{count}{TYPE_CODE[kind]}", data, place)
    (following,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)
    return tags, following


def _piece(data: bytes, at: int, size: int, shape: tuple[int, int, int], compression: int, predictor: int) -> np.ndarray:
    expected = shape[0] * shape[1] * shape[2]
    if at + size > len(data):
        raise ValueError("a strip or tile lies outside the file")
    raw = _unpack(data[at : at + size], compression, expected)
    if len(raw) < expected:
        raise ValueError("a strip or tile is too short")
    samples = np.frombuffer(raw, dtype=np.uint8, count=expected).reshape(shape)
    if predictor == 2:
        return np.cumsum(samples, axis=1, dtype=np.uint8)
    if predictor != 1:
        raise ValueError(f"predictor {predictor} is not supported")
    return samples


def read_pages(data: bytes) -> Iterator[Page]:
    """The pages of a TIFF file, in the order of its directories; the first that can't be read raises."""
    for page in each_page(data):
        if isinstance(page, ValueError):
            raise page
        yield page


def each_page(data: bytes) -> Iterator[Page | ValueError]:
    """Each directory's page, or why it can't be read; raises where the chain of directories breaks off."""
    try:
        order = {b"II": "<", b"MM": ">"}.get(data[:2])
        if order is None or struct.unpack_from(order + "H", data, 2)[0] != 42:
            raise ValueError("not a TIFF file")
        (at,) = struct.unpack_from(order + "I", data, 4)
        seen: set[int] = set()
        while at:
            if at in seen:
                raise ValueError("the chain of directories is a circle")
            seen.add(at)
            tags, at = _directory(data, at, order)
            try:
                page = _page(data, tags)
            except (struct.error, KeyError, IndexError) as e:
                page = ValueError(f"damaged TIFF: {e!r}")
            except ValueError as e:
                page = e
            yield page
    except (struct.error, KeyError, IndexError) as e:
        raise ValueError(f"damaged TIFF: {e!r}") from e


def _page(data: bytes, tags: dict[int, tuple[int, ...]]) -> Page:
    width, height, channels = tags[WIDTH][0], tags[HEIGHT][0], tags.get(SAMPLES, (1,))[0]
    if set(tags.get(BITS, (1,))) != {8} or tags.get(PLANAR, (1,))[0] != 1:
        raise ValueError("only interleaved samples of 8 bits are supported")
    compression, predictor = tags.get(COMPRESSION, (1,))[0], tags.get(PREDICTOR, (1,))[0]
    if compression not in MOST_OF_ONE:
        raise ValueError(f"compression {compression} is not supported")
    stored = min(sum(tags[TILE_BYTES if TILE_OFFSETS in tags else STRIP_BYTES]), len(data))
    # A header may claim any size; memory is bounded by what is stored.
    if not 0 < width * height * channels <= stored * MOST_OF_ONE[compression]:
        raise ValueError(f"a page of {width} x {height} x {channels} samples in {stored} bytes")
    out = np.empty((height, width, channels), dtype=np.uint8)
    if TILE_OFFSETS in tags:
        across, down = tags[TILE_WIDTH][0], tags[TILE_HEIGHT][0]
        if not 0 < across * down * channels <= stored * MOST_OF_ONE[compression]:
            raise ValueError(f"tiles of {across} x {down} x {channels} samples in {stored} bytes")
        corners = [(y, x) for y in range(0, height, down) for x in range(0, width, across)]
        for (y, x), at, size in zip(corners, tags[TILE_OFFSETS], tags[TILE_BYTES], strict=True):
            piece = _piece(data, at, size, (down, across, channels), compression, predictor)
            part = out[y : y + down, x : x + across]
            part[...] = piece[: part.shape[0], : part.shape[1]]
    else:
        rows = min(tags.get(ROWS_PER_STRIP, (height,))[0], height)
        tops = range(0, height, rows)
        for y, at, size in zip(tops, tags[STRIP_OFFSETS], tags[STRIP_BYTES], strict=True):
            part = out[y : y + rows]
            part[...] = _piece(data, at, size, part.shape, compression, predictor)
    return Page(width, height, channels, compression, out)


def padded(text: str | None) -> tuple[bytes, int]:
    """The payload of a text, blanks up to a positive multiple of a row, and its own size."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw.ljust(max(1, -(-len(raw) // ROW_BYTES)) * ROW_BYTES, b" "), len(raw)


def payload_pages(payload: bytes) -> list[np.ndarray]:
    rows = np.frombuffer(payload, dtype=np.uint8).reshape(-1, PIXELS, CHANNELS)
    return [rows[at : at + PAGE_ROWS] for at in range(0, len(rows), PAGE_ROWS)]


#: The forms that payloads take in turn: compression, predictor, tile.
FORMS = [(c, c in (LZW, DEFLATE), tile) for c in (PLAIN, PACKBITS, LZW, DEFLATE) for tile in (None, TILE)]


def text_to_media(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds media (the TIFF of the whole text) and n_bytes (before padding).

    The form of a file (compression, strips or tiles) follows from a checksum
    of its payload.  Every row stays; columns named media or n_bytes are replaced.
    """
    small_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c.lower() not in ("media", "n_bytes")]
    source = docs.select(*kept, F.col(text_col).cast("string").alias(spare_name(kept)))
    schema = source.select(*kept, F.lit(b"").alias("media"), F.lit(0).cast("long").alias("n_bytes")).schema

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            media, sizes = [], []
            for text in batch.column(len(kept)):
                payload, size = padded(text.as_py())
                compression, predictor, tile = FORMS[zlib.crc32(payload) % len(FORMS)]
                media.append(write_tiff(payload_pages(payload), compression, predictor, tile))
                sizes.append(size)
            columns = [*batch.columns[: len(kept)], pa.array(media, pa.binary()), pa.array(sizes, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "media", "n_bytes"])

    return source.mapInArrow(write, schema)


PAGE_SCHEMA = "page int, pages int, more boolean, width int, height int, channels int, compression int, pixels binary, error string"


def _page_row(p: Page | ValueError) -> dict:
    if isinstance(p, ValueError):
        return {"width": None, "height": None, "channels": None, "compression": None, "pixels": None, "error": str(p)}
    return {"width": p.width, "height": p.height, "channels": p.channels, "compression": p.compression, "pixels": p.samples.tobytes(), "error": None}


def media_pages(media: DataFrame, media_col: str = "media", keep_media: bool = True) -> DataFrame:
    """One row per page of every media file, with the decoded samples.

    Other columns repeat on every page, the file itself with ``keep_media``;
    the pages of a file follow each other.  A page that can't be read has null
    pixels and the reason in ``error``; the others stay.  Where the chain of
    directories breaks off, as in a null or damaged file or one without any
    directory, one such row follows the pages before, and ``pages`` counts the
    directories that were found; ``more`` tells whether rows of the file follow.
    """
    own = {x.split()[0] for x in PAGE_SCHEMA.split(", ")}
    kept = [c for c in media.columns if c.lower() not in own and (keep_media or c.lower() != media_col.lower())]
    names = [x.split()[0] for x in PAGE_SCHEMA.split(", ")]
    schema = StructType([*media.select(*kept).schema.fields, *_parse_datatype_string(PAGE_SCHEMA).fields])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = batch.column(len(kept))
            index: list[int] = []
            found: list[dict] = []
            for k in range(batch.num_rows):
                got: list[dict] = []
                broken = None
                try:
                    data = files[k].as_py()
                    if data is None:
                        raise ValueError("no file")
                    for p in each_page(data):
                        got.append(_page_row(p))
                    if not got:
                        raise ValueError("no directory")
                except ValueError as e:
                    broken = e
                pages = len(got)
                if broken:
                    got.append(_page_row(broken))
                for i, row in enumerate(got):
                    row |= {"page": i, "pages": pages, "more": i < len(got) - 1}
                index += [k] * len(got)
                found += got
            rows = pa.array(index, pa.int64())
            types = {"pixels": pa.binary(), "error": pa.string(), "more": pa.bool_()}
            columns = [batch.column(k).take(rows) for k in range(len(kept))]
            columns += [pa.array([x[n] for x in found], types.get(n, pa.int32())) for n in names]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, *names])

    return media.select(*kept, F.col(media_col).cast("binary").alias(spare_name(kept, "file"))).mapInArrow(read, schema)


class Digest:
    """What the pages of one file hold, page by page."""

    def __init__(self) -> None:
        self.sha, self.counts, self.change, self.tail = hashlib.sha256(), np.zeros(256, dtype=np.int64), 0, b""

    def add(self, pixels: bytes, shape: tuple[int, int, int]) -> None:
        flat = np.frombuffer(pixels, dtype=np.uint8)
        self.sha.update(pixels)
        self.counts += np.bincount(flat, minlength=256)
        self.change += int(np.abs(np.diff(flat.reshape(shape).astype(np.int16), axis=1)).sum())
        self.tail = (self.tail + pixels[-16:])[-16:]

    def feature(self) -> str:
        """Whole-number features: sample count, sum, least, greatest, entropy in millibits, horizontal change."""
        n = int(self.counts.sum())
        found = np.flatnonzero(self.counts)
        share = self.counts[found] / max(1, n)
        entropy = int(round(float(-(share * np.log2(share)).sum()) * 1000)) if n else 0
        least, most = (int(found[0]), int(found[-1])) if n else (0, 0)
        return f"n={n};sum={int(self.counts @ np.arange(256))};min={least};max={most};entropy={entropy};dx={self.change}"


DIGEST_SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pages int, error string"


def media_digest(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per row: reads all pages of the stored file and digests what they hold.

    Pages are read by ``media_pages`` and summed up one after another, without
    a shuffle.  A null or damaged file keeps its row: ``error`` has the first
    reason, and the digest is of the pages that could be read.
    """
    stored = media.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col("n_bytes").cast("long").alias("n_bytes"), F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"), "media",
    )
    names = [x.split()[0] for x in DIGEST_SCHEMA.split(", ")]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.string()]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, error = Digest(), None
        for batch in batches:
            out: list[tuple] = []
            columns = {c: batch.column(c).to_pylist() for c in batch.schema.names if c != "pixels"}
            for k in range(batch.num_rows):
                row = {c: v[k] for c, v in columns.items()}
                if row["error"] is None:
                    held.add(batch.column("pixels")[k].as_py(), (row["height"], row["width"], row["channels"]))
                error = error or row["error"]
                if not row["more"]:
                    n = int(held.counts.sum())
                    out.append((row["doc_id"], row["n_bytes"], n, held.sha.hexdigest(), zlib.crc32(held.tail), row["media_bytes"], row["media_sha256"], held.feature(), row["pages"], error))
                    held, error = Digest(), None
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out) if out else [[]] * len(names), types)], names=names)

    return media_pages(stored, keep_media=False).mapInArrow(digest, DIGEST_SCHEMA)
