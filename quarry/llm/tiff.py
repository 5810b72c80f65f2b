"""Media columns: documents as TIFF files, and TIFF files as rows of pages.

The writer lays 8-bit grey samples out as pages of strips or tiles; the reader
walks the image directories of either byte order, undoes PackBits, LZW or deflate
and the horizontal predictor, and emits one row per page. It reads 1, 2, 4, 8 and
16 bits a sample, chunky or in planes, and either bit order, and knows nothing of
the writer: it goes by the stored bytes alone.

Everything works row by row in Arrow batches, with no shuffle; a task holds one
batch slice and one document's pages. Sizes that a file states are held against
the bytes that it has before anything is allocated.

Defined results: a null or empty text has one block of padding; equal texts
give equal files; an empty table gives no rows; repeated rows are stored each;
null or broken media give no pages (``tiff_pages``) and nulls for whatever would
be read from them (``media_features``); other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import keyed_text

BLOCK = 576
PAGE_ROWS, STRIP_ROWS, TILE_ROWS = 512, 64, 16
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
_TYPES = {1: "B", 3: "H", 4: "I"}
#: How many bytes one stored byte can stand for at most.
_GAIN = {NONE: 1, PACKBITS: 64, LZW: 4096, DEFLATE: 1032, OLD_DEFLATE: 1032}
_CLEAR, _END, _FIRST, _FULL = 256, 257, 258, 4094
_SINGLES = [bytes((i,)) for i in range(256)]


class TiffError(ValueError):
    """Bytes that are no TIFF file this reader can follow."""


# --- compression -----------------------------------------------------------


def packbits_encode(data: bytes) -> bytes:
    """Runs of three or more equal bytes as repeats, the rest as literals."""
    out = bytearray()
    px = np.frombuffer(data, np.uint8)
    cut = np.concatenate(([0], np.flatnonzero(np.diff(px)) + 1, [len(px)])) if len(px) else np.zeros(1, np.int64)
    literal = 0

    def flush(stop: int) -> None:
        for a in range(literal, stop, 128):
            part = data[a : min(stop, a + 128)]
            out.append(len(part) - 1)
            out.extend(part)

    for k in np.flatnonzero(np.diff(cut) >= 3):
        a, b = int(cut[k]), int(cut[k + 1])
        flush(a)
        while b - a >= 2:
            n = min(128, b - a)
            out += bytes((257 - n, data[a]))
            a += n
        literal = a
    flush(len(data))
    return bytes(out)


def packbits_decode(data: bytes, size: int) -> bytes:
    out, i = bytearray(), 0
    while i < len(data) and len(out) < size:
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += 2 + n
        elif n > 128:
            out += data[i + 1 : i + 2] * (257 - n)
            i += 2
        else:
            i += 1
    return bytes(out)


def _lzw_widths(n: int) -> np.ndarray:
    """Bits of the first ``n`` codes after a clear: as many as the next table entry's number needs, 9 to 12."""
    return np.clip(np.ceil(np.log2(np.arange(_FIRST + 1, _FIRST + 1 + n))), 9, 12).astype(np.int64)


def lzw_encode(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, high bits first, widened one code early."""
    codes = [_CLEAR]
    table: dict[int, int] = {}
    following, held = _FIRST, -1
    for byte in data:
        if held < 0:
            held = byte
            continue
        key = held << 8 | byte
        longer = table.get(key)
        if longer is not None:
            held = longer
            continue
        codes.append(held)
        table[key] = following
        following += 1
        held = byte
        if following == _FULL:
            codes.append(_CLEAR)
            table, following = {}, _FIRST
    if held >= 0:
        codes.append(held)
        if following + 1 == _FULL:
            codes.append(_CLEAR)
    codes.append(_END)
    code = np.array(codes, np.uint32)
    # each run from one clear on starts at 9 bits again; the clear that ends it has the run's width
    begins = np.append(np.flatnonzero(code[:-1] == _CLEAR) + 1, len(code))
    width = np.concatenate([[9], *(_lzw_widths(n) for n in np.diff(begins))])
    at = np.cumsum(width) - width
    out = np.zeros(int(at[-1] + width[-1] + 7) // 8 + 3, np.uint32)
    shifted = code << (24 - width - (at & 7)).astype(np.uint32)
    for k in range(3):
        # a byte has bits of at most two codes, and no bit of both
        out += np.bincount((at >> 3) + k, weights=shifted >> (16 - 8 * k) & 255, minlength=len(out)).astype(np.uint32)
    return out[:-3].astype(np.uint8).tobytes()


def lzw_decode(data: bytes, size: int) -> bytes:
    raw = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.uint32)
    bits, at, got = 8 * len(data), 0, 0
    out: list[bytes] = []
    while got < size and at + 9 <= bits:
        # all codes up to the next clear, or as many as a full table's worth and then 12 bits each
        width = _lzw_widths(min((bits - at) // 9, _FULL if not out else max(_FULL, (bits - at) // 9)))
        ends = at + np.cumsum(width)
        ends = ends[: np.searchsorted(ends, bits, "right")]
        begin = ends - width[: len(ends)]
        place = begin >> 3
        three = raw[place] << 16 | raw[place + 1] << 8 | raw[place + 2]
        codes = three >> (24 - width[: len(ends)] - (begin & 7)).astype(np.uint32) & ((1 << width[: len(ends)]) - 1).astype(np.uint32)
        stops = np.flatnonzero((codes == _CLEAR) | (codes == _END))
        n = int(stops[0]) if len(stops) else len(codes)
        pieces = _lzw_pieces(codes[:n].tolist())
        out += pieces
        got += sum(map(len, pieces))
        if not len(stops) or codes[n] == _END:
            break
        at = int(ends[n])
    return b"".join(out)


def _lzw_pieces(codes: list[int]) -> list[bytes]:
    """What the codes after a clear stand for."""
    if not codes:
        return []
    table = [*_SINGLES, b"", b""]
    if codes[0] >= _CLEAR:
        raise TiffError(f"code {codes[0]} is not in the table")
    last = table[codes[0]]
    out = [last]
    learnt = 4096 - _FIRST + 1
    for code in codes[1:learnt]:
        if code < len(table):
            piece = table[code]
            table.append(last + piece[:1])
        elif code == len(table):
            piece = last + last[:1]
            table.append(piece)
        else:
            raise TiffError(f"code {code} is not in the table")
        out.append(piece)
        last = piece
    out += [table[code] for code in codes[learnt:]]
    return out


def _compress(data: bytes, how: int) -> bytes:
    if how == DEFLATE:
        return zlib.compress(data, 1)
    return lzw_encode(data) if how == LZW else packbits_encode(data) if how == PACKBITS else data


def _expand(data: bytes, how: int, size: int) -> bytes:
    if how in (DEFLATE, OLD_DEFLATE):
        got = zlib.decompressobj().decompress(data, size)
    elif how == LZW:
        got = lzw_decode(data, size)
    elif how == PACKBITS:
        got = packbits_decode(data, size)
    elif how == NONE:
        got = data
    else:
        raise TiffError(f"compression {how}")
    if len(got) < size:
        raise TiffError("a strip or tile is too short")
    return got[:size]


# --- writing ---------------------------------------------------------------


def encode_tiff(
    samples: np.ndarray,
    compression: int = DEFLATE,
    predictor: bool = True,
    tiled: bool = False,
    page_rows: int = PAGE_ROWS,
) -> bytes:
    """A file of pages of at most ``page_rows`` of the rows of ``samples``."""
    height, width = samples.shape
    out = bytearray(b"II*\0\0\0\0\0")
    link = 4
    for top in range(0, height, page_rows):
        page = samples[top : top + page_rows]
        parts = []
        # a tile has 16 rows at least: a page of fewer is one strip
        tiles = tiled and len(page) >= TILE_ROWS
        step = TILE_ROWS if tiles else STRIP_ROWS
        for a in range(0, len(page), step):
            part = page[a : a + step]
            if tiles and len(part) < step:
                part = np.vstack((part, np.zeros((step - len(part), width), np.uint8)))
            if predictor:
                part = np.diff(part, axis=1, prepend=np.uint8(0))
            parts.append(_compress(part.tobytes(), compression))
        offsets = []
        for part in parts:
            offsets.append(len(out))
            out += part + b"\0" * (len(part) % 2)
        sizes = [len(p) for p in parts]
        tags = [(256, 4, [width]), (257, 4, [len(page)]), (258, 3, [8]), (259, 3, [compression]), (262, 3, [1]), (277, 3, [1])]
        tags += [(322, 4, [width]), (323, 4, [step]), (324, 4, offsets), (325, 4, sizes)] if tiles else [(273, 4, offsets), (278, 4, [step]), (279, 4, sizes)]
        tags += [(317, 3, [2])] if predictor else []
        tags.sort()
        at = len(out)
        struct.pack_into("<I", out, link, at)
        beyond = at + 2 + 12 * len(tags) + 4
        head, tail = struct.pack("<H", len(tags)), b""
        for tag, kind, values in tags:
            body = struct.pack(f"<{len(values)}{_TYPES[kind]}", *values)
            if len(body) > 4:
                body, tail = struct.pack("<I", beyond + len(tail)), tail + body
            head += struct.pack("<HHI", tag, kind, len(values)) + body.ljust(4, b"\0")
        out += head + b"\0\0\0\0" + tail
        link = beyond - 4
    return bytes(out)


# --- reading ---------------------------------------------------------------


def decode_tiff(data: bytes) -> Iterator[tuple[int, int, np.ndarray]]:
    """(compression, predictor, samples) of each page, in the order of the file."""
    if data[:4] not in (b"II*\0", b"MM\0*"):
        raise TiffError("no TIFF header")
    end = "<" if data[:2] == b"II" else ">"
    try:
        at, seen = struct.unpack_from(end + "I", data, 4)[0], set()
        while at:
            if at in seen:
                raise TiffError("the directories form a loop")
            seen.add(at)
            n = struct.unpack_from(end + "H", data, at)[0]
            tags = {}
            for k in range(n):
                tag, kind, count = struct.unpack_from(end + "HHI", data, at + 2 + 12 * k)
                if kind in _TYPES and count <= len(data):
                    form = f"{end}{count}{_TYPES[kind]}"
                    where = at + 10 + 12 * k
                    if struct.calcsize(form) > 4:
                        where = struct.unpack_from(end + "I", data, where)[0]
                    tags[tag] = struct.unpack_from(form, data, where)
            at = struct.unpack_from(end + "I", data, at + 2 + 12 * n)[0]
            yield _page(data, tags, end)
    except (struct.error, KeyError, IndexError, ValueError, OverflowError, zlib.error) as broken:
        raise TiffError(str(broken)) from broken


def _samples(part: bytes, rows: int, per_row: int, depth: int, end: str, reverse: bool) -> np.ndarray:
    """Rows of ``per_row`` samples of ``depth`` bits; each row begins at a byte."""
    if depth == 16:
        return np.frombuffer(part, end + "u2").reshape(rows, per_row).astype(np.uint16)
    raw = np.frombuffer(part, np.uint8).reshape(rows, -1)
    if depth == 8:
        return raw
    bits = np.unpackbits(raw, axis=1, bitorder="little" if reverse else "big")[:, : per_row * depth].reshape(rows, per_row, depth)
    return bits @ (1 << np.arange(depth)[::-1]).astype(np.uint8)


def _page(data: bytes, tags: dict[int, tuple[int, ...]], end: str) -> tuple[int, int, np.ndarray]:
    width, height = tags[256][0], tags[257][0]
    how, predictor = tags.get(259, (NONE,))[0], tags.get(317, (1,))[0]
    colours, planes = tags.get(277, (1,))[0], tags.get(284, (1,))[0] == 2
    (depth,) = set(tags.get(258, (1,))) if len(set(tags.get(258, (1,)))) == 1 else (0,)
    if depth not in (1, 2, 4, 8, 16) or predictor not in (1, 2) or (predictor == 2 and depth < 8) or how not in _GAIN:
        raise TiffError(f"{depth} bits, compression {how}, predictor {predictor}")
    tiled = 324 in tags
    wide, tall = (tags[322][0], tags[323][0]) if tiled else (width, min(tags.get(278, (height,))[0], height))
    if not (width and height and wide and tall and colours):
        raise TiffError("a size is 0")
    across, down, layers, together = -(-width // wide), -(-height // tall), colours if planes else 1, 1 if planes else colours
    offsets, sizes = (tags[324], tags[325]) if tiled else (tags[273], tags[279])
    if len(offsets) != across * down * layers or len(sizes) != len(offsets):
        raise TiffError("strips or tiles are missing")
    row_bytes = -(-wide * together * depth // 8)
    if sum(min(size, max(0, len(data) - start)) for start, size in zip(offsets, sizes)) * _GAIN[how] < row_bytes * (height if not tiled else down * tall) * across * layers:
        raise TiffError("there are too few bytes for the size")
    page = np.zeros((down * tall, across * wide, colours), np.uint16 if depth == 16 else np.uint8)
    for k, (start, size) in enumerate(zip(offsets, sizes)):
        layer, at = divmod(k, across * down)
        row, col = at // across * tall, at % across * wide
        rows = tall if tiled else min(tall, height - row)
        part = _samples(_expand(data[start : start + size], how, rows * row_bytes), rows, wide * together, depth, end, tags.get(266, (1,))[0] == 2)
        part = part.reshape(rows, wide, together)
        if predictor == 2:
            part = np.cumsum(part, axis=1, dtype=part.dtype)
        page[row : row + rows, col : col + wide, layer : layer + together] = part
    return how, predictor, page[:height, :width].reshape(height, width * colours)


# --- columns ---------------------------------------------------------------


def payload_of(text: bytes) -> bytes:
    size = max(1, -(-len(text) // BLOCK)) * BLOCK
    return text.ljust(size, b"\xff")


#: The stored forms a text may get, by a hash of its payload: (compression, predictor, tiles).
FORMS = [(how, predictor, tiled) for how in (LZW, PACKBITS, DEFLATE) for predictor in (False, True) for tiled in (False, True)]


def store(payload: bytes, forms: list[tuple[int, bool, bool]] = FORMS) -> bytes:
    """The stored form: rows of 576 samples, in the one of ``forms`` that the payload's
    CRC-32 picks, so that every codec meets texts of every size and equal texts are stored alike."""
    how, predictor, tiled = forms[zlib.crc32(payload) % len(forms)]
    return encode_tiff(np.frombuffer(payload, np.uint8).reshape(-1, BLOCK), how, predictor, tiled)


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 64) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): every text stored as a TIFF file."""

    def run(batches):
        for part in _slices(batches):
            texts = [t.encode() for t in part.column(1).to_pylist()]
            media = [store(payload_of(t)) for t in texts]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(len, texts), pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return keyed_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def tiff_pages(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row per page: its number, size, compression, predictor and samples,
    row by row. Media that cannot be read give no rows."""

    def run(batches):
        for part in _slices(batches, 16):
            rows = []
            for key, data in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                try:
                    pages = list(decode_tiff(data or b""))
                except TiffError:
                    continue
                rows += [(key, k, p.shape[1], p.shape[0], how, pred, p.tobytes()) for k, (how, pred, p) in enumerate(pages)]
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
            columns = list(zip(*rows)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "page", "width", "height", "compression", "predictor", "samples"])

    own = media.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{media_col}`").alias("media"))
    return own.mapInArrow(run, "doc_id long, page int, width int, height int, compression int, predictor int, samples binary")


def page_feature(pages: list[np.ndarray]) -> str:
    """Pages and size, a histogram of 16 grey levels, and how much neighbours differ across and down."""
    levels = sum(np.bincount(p.ravel() >> (4 if p.dtype == np.uint8 else 12), minlength=16) for p in pages)
    wide = [p.astype(np.int16 if p.dtype == np.uint8 else np.int32) for p in pages]
    across = sum(int(np.abs(np.diff(p, axis=1)).sum()) for p in wide)
    down = sum(int(np.abs(np.diff(p, axis=0)).sum()) for p in wide)
    return f"{len(pages)}x{pages[0].shape[1]}x{sum(map(len, pages))}:{'.'.join(map(str, levels))}:{across}:{down}"


def media_features(media: DataFrame) -> DataFrame:
    """What the stored bytes hold, by document: the samples read back from all pages and a feature."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pages"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32()]

    def read(key, size, data):
        if data is None:
            return (key, size) + (None,) * 7
        stored = (len(data), hashlib.sha256(data).hexdigest())
        try:
            pages = [p for _, _, p in decode_tiff(data)]
        except TiffError:
            pages = []
        if not pages:
            return (key, size, None, None, None, *stored, None, 0)
        payload = b"".join(p.tobytes() for p in pages)
        return (key, size, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), *stored, page_feature(pages), len(pages))

    def run(batches):
        for part in _slices(batches):
            rows = [read(*row) for row in zip(*(c.to_pylist() for c in part.columns))]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [[]] * 9, kinds)], names=names)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(
        run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pages int"
    )
