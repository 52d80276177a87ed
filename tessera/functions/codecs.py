"""Decoding of image bytes in Arrow batches: PNG, BMP and baseline JPEG, with numpy.

Spark's ``image`` source decodes files; rows that carry bytes (requests, bytes
fetched by URL) are decoded here into the same layout: rows from the top, one
byte a channel, gray as one channel, else blue, green, red (and alpha). Images
whose palette or pixels have alpha get four channels; of gray with alpha the alpha
goes; 16-bit samples keep their high byte. Progressive or CMYK JPEGs and
compressed bitmaps count as undecodable.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Zigzag order of a JPEG block, passes of an interlaced PNG (x0, y0, dx, dy).
ZIGZAG = np.array([
    0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28,
    35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63])
ADAM7 = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))
PNG_SIGN = b"\x89PNG\r\n\x1a\n"

#: pixels an image may claim before anything is allocated for it
MOST_PIXELS = 1 << 28


class Undecodable(ValueError):
    pass


def _claimed(width: int, height: int) -> None:
    if width <= 0 or height <= 0 or width * height > MOST_PIXELS:
        raise Undecodable(f"{width} x {height} pixels")


# ---------------------------------------------------------------- PNG

def _unfilter(raw: np.ndarray, filters: np.ndarray, step: int) -> np.ndarray:
    """Undo the row filters of (rows, bytes); ``step`` bytes make a pixel."""
    h, n = raw.shape
    out = np.zeros((h + 1, n + step), np.int32)                # a zero row above, a zero pixel before
    if filters.max(initial=0) > 4:
        raise Undecodable("filter type")
    if not (filters > 2).any():
        for y in range(h):
            row = raw[y].astype(np.int32)
            if filters[y] == 1:
                row = row.reshape(-1, step).cumsum(axis=0).reshape(-1) if n % step == 0 else row
            elif filters[y] == 2:
                row = row + out[y, step:]
            out[y + 1, step:] = row & 255
        return out[1:, step:].astype(np.uint8)
    # a pixel depends on those to the left, above and above left: all rows advance along a diagonal
    pixels, cells = n // step, np.arange(step)
    for t in range(pixels + h - 1):
        y = np.arange(max(0, t - pixels + 1), min(h, t + 1))
        x = ((t - y) * step)[:, None] + cells
        at, kind = y[:, None], filters[y][:, None]
        left, up, corner = out[at + 1, x], out[at, x + step], out[at, x]
        base = left + up - corner
        a, b, c = abs(base - left), abs(base - up), abs(base - corner)
        paeth = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
        guess = np.choose(kind, [np.zeros_like(left), left, up, (left + up) >> 1, paeth])
        out[at + 1, x + step] = (raw[at, x] + guess) & 255
    return out[1:, step:].astype(np.uint8)


def _samples(rows: np.ndarray, width: int, depth: int, channels: int) -> np.ndarray:
    """(rows, width, channels) samples of packed rows; 16-bit ones by their high byte."""
    if depth == 8:
        return rows[:, :width * channels].reshape(len(rows), width, channels)
    if depth == 16:
        return rows.reshape(len(rows), width, channels, 2)[..., 0]
    bits = np.unpackbits(rows, axis=1)[:, :width * depth].reshape(len(rows), width, depth)
    return (bits @ (1 << np.arange(depth)[::-1])).astype(np.uint8)[..., None]


def decode_png(data: bytes) -> np.ndarray:
    at, head, palette, alpha, body, ended = len(PNG_SIGN), None, None, b"", [], False
    while at + 8 <= len(data) and not ended:
        size, kind = struct.unpack_from(">I4s", data, at)
        chunk = data[at + 8:at + 8 + size]
        if len(chunk) < size:
            raise Undecodable("truncated")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", chunk)
        elif kind == b"PLTE":
            palette = np.frombuffer(chunk, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            alpha = chunk
        elif kind == b"IDAT":
            body.append(chunk)
        ended = kind == b"IEND"
        at += 12 + size
    if head is None or not body:
        raise Undecodable("no image data")
    width, height, depth, color, _, _, interlaced = head
    _claimed(width, height)
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(color)
    if channels is None or depth not in (1, 2, 4, 8, 16) or (color == 3 and palette is None):
        raise Undecodable("color type")
    step = max(1, channels * depth // 8)
    passes = [(x, y, dx, dy) for x, y, dx, dy in ADAM7 if x < width and y < height] if interlaced else [(0, 0, 1, 1)]
    sizes = [(-(-(width - x) // dx), -(-(height - y) // dy)) for x, y, dx, dy in passes]
    lines = [-(-w * channels * depth // 8) for w, _ in sizes]
    unpack = zlib.decompressobj()
    need = sum((n + 1) * h for n, (_, h) in zip(lines, sizes, strict=True))
    raw = np.frombuffer(unpack.decompress(b"".join(body), need), np.uint8)      # no more than the header claims
    if len(raw) < need:
        raise Undecodable("truncated")
    out, pos = np.zeros((height, width, channels), np.uint8), 0
    for (x, y, dx, dy), (w, h), n in zip(passes, sizes, lines, strict=True):
        rows = raw[pos:pos + (n + 1) * h].reshape(h, n + 1)
        pos += (n + 1) * h
        out[y::dy, x::dx] = _samples(_unfilter(rows[:, 1:], rows[:, 0], step), w, depth, channels)
    if color == 3:
        if out.max(initial=0) >= len(palette):
            raise Undecodable("palette index")
        table = palette[:, ::-1]
        if alpha:
            opacity = np.full(len(palette), 255, np.uint8)
            opacity[:len(alpha)] = np.frombuffer(alpha, np.uint8)[:len(palette)]
            table = np.c_[table, opacity]
        return table[out[..., 0]]
    if color == 0 and depth < 8:
        return np.repeat((out.astype(np.int32) * 255 // ((1 << depth) - 1)).astype(np.uint8), 3, axis=2)
    if color == 4:
        return out[..., :1]
    return out if color == 0 else np.concatenate([out[..., 2::-1], out[..., 3:]], axis=2)


# ---------------------------------------------------------------- BMP

def decode_bmp(data: bytes) -> np.ndarray:
    start, info, width, height, _, bits, packing = struct.unpack_from("<IIiiHHI", data, 10)
    colors = struct.unpack_from("<I", data, 46)[0] if len(data) >= 50 else 0
    _claimed(width, abs(height))
    if packing not in (0, 3) or bits not in (8, 24, 32) or (packing == 3 and bits != 32):
        raise Undecodable("packed bitmap")
    line = -(-width * bits // 32) * 4
    rows = np.frombuffer(data, np.uint8, line * abs(height), start).reshape(abs(height), line)
    rows = rows[::-1] if height > 0 else rows
    if bits == 8:
        palette = np.frombuffer(data, np.uint8, 4 * (colors or 256), 14 + info).reshape(-1, 4)[:, :3]
        if rows[:, :width].max(initial=0) >= len(palette):
            raise Undecodable("palette index")
        return palette[rows[:, :width]]
    return rows[:, :width * bits // 8].reshape(abs(height), width, bits // 8)[..., :3]


# ---------------------------------------------------------------- JPEG

def _code_table(counts: bytes, values: bytes) -> list[int]:
    """For each 16 bits ahead: value << 5 | length of the code they begin with, or 0."""
    table, code, at = np.zeros(1 << 16, np.int32), 0, 0
    for length in range(1, 17):
        for _ in range(counts[length - 1]):
            table[code << 16 - length:code + 1 << 16 - length] = values[at] << 5 | length
            code, at = code + 1, at + 1
        code <<= 1
    return table.tolist()


def _scan(data: bytes, at: int) -> tuple[list[bytes], int]:
    """Entropy-coded segments between restart markers, stuffing taken out, and where the next marker is."""
    parts, begin = [], at
    while True:
        at = data.find(b"\xff", at)
        if at < 0 or at + 1 >= len(data):
            raise Undecodable("truncated")
        follow = data[at + 1]
        if follow == 0:
            at += 2
        elif 0xD0 <= follow <= 0xD7:
            parts.append(data[begin:at].replace(b"\xff\x00", b"\xff"))
            at = begin = at + 2
        elif follow == 0xFF:
            at += 1
        else:
            parts.append(data[begin:at].replace(b"\xff\x00", b"\xff"))
            return parts, at


def _blocks(segment: bytes, order: list, out: list, units: int) -> None:
    """Decodes ``units`` minimum coded units; appends (block row, coefficient place, value) triples to ``out``."""
    bits, have, pos, size = 0, 0, 0, len(segment)
    last = {part: 0 for _, part, _, _ in order}
    where, places, values = out
    for unit in range(units):
        for row, part, dc, ac in order:
            k, block = 0, row(unit)
            while k < 64:
                if have < 32:                       # a code and its bits take at most 32
                    more = segment[pos:pos + 6]
                    pos += 6
                    if len(more) < 6:
                        if pos > size + 12:
                            raise Undecodable("truncated")
                        more = more.ljust(6, b"\x00")
                    bits, have = (bits & (1 << have) - 1) << 48 | int.from_bytes(more, "big"), have + 48
                entry = (ac if k else dc)[bits >> have - 16 & 0xFFFF]
                if not entry:
                    raise Undecodable("code")
                have -= entry & 31
                symbol = entry >> 5
                extra = symbol & 15
                if k:
                    if not extra:
                        if symbol != 0xF0:
                            break
                        k += 16
                        continue
                    k += symbol >> 4
                elif symbol > 15:
                    raise Undecodable("code")
                have -= extra
                value = bits >> have & (1 << extra) - 1
                if extra and value < 1 << extra - 1:
                    value -= (1 << extra) - 1
                if not k:
                    last[part] = value = last[part] + value
                elif k > 63:
                    raise Undecodable("coefficients")
                where.append(block)
                places.append(k)
                values.append(value)
                k += 1


def _cosines() -> np.ndarray:
    u, x = np.arange(8)[:, None], np.arange(8)[None, :]
    return np.where(u == 0, np.sqrt(0.125), 0.5) * np.cos((2 * x + 1) * u * np.pi / 16)


COSINES = _cosines()


def _wider(plane: np.ndarray, axis: int, high: int, low: int) -> np.ndarray:
    """Twice as many samples along ``axis``, each 3/4 of the nearer and 1/4 of the farther one; ``high``, ``low``: rounding of the two."""
    plane = np.moveaxis(plane, axis, 0)
    before, after = np.concatenate([plane[:1], plane[:-1]]), np.concatenate([plane[1:], plane[-1:]])
    out = np.empty((2 * len(plane), *plane.shape[1:]), plane.dtype)
    out[0::2], out[1::2] = 3 * plane + before + low, 3 * plane + after + high
    return np.moveaxis(out, 0, axis)


def decode_jpeg(data: bytes) -> np.ndarray:
    at, quant, codes, frame, restart, adobe = 2, {}, {}, None, 0, None
    while True:
        if at + 4 > len(data):
            raise Undecodable("truncated")
        if data[at] != 0xFF:
            raise Undecodable("marker")
        kind = data[at + 1]
        if kind == 0xFF:
            at += 1
            continue
        if kind == 0xD9:
            raise Undecodable("no scan")
        size = struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4:at + 2 + size]
        if kind == 0xDB:
            while body:
                wide, number = divmod(body[0], 16)
                n = 128 if wide else 64
                quant[number] = np.frombuffer(body[1:1 + n], ">u2" if wide else np.uint8).astype(np.float64)
                body = body[1 + n:]
        elif kind == 0xC4:
            while body:
                n = sum(body[1:17])
                codes[body[0]] = _code_table(body[1:17], body[17:17 + n])
                body = body[17 + n:]
        elif kind in (0xC0, 0xC1):
            depth, height, width, n = struct.unpack_from(">BHHB", body)
            if depth != 8 or n not in (1, 3):
                raise Undecodable("samples")
            _claimed(width, height)
            frame = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        elif 0xC2 <= kind <= 0xCF and kind != 0xC8:
            raise Undecodable("not baseline")
        elif kind == 0xDD:
            restart = struct.unpack(">H", body[:2])[0]
        elif kind == 0xEE and body[:5] == b"Adobe":
            adobe = body[11]
        at += 2 + size
        if kind == 0xDA:
            break
    if frame is None or body[0] != len(frame):
        raise Undecodable("scan")
    parts, _ = _scan(data, at)
    hmax, vmax = max(f[1] for f in frame), max(f[2] for f in frame)
    if len(frame) == 1:                             # a lone component is not interleaved
        frame = [(frame[0][0], 1, 1, frame[0][3])]
        hmax = vmax = 1
    if any(hmax % h or vmax % v or hmax // h > 2 or vmax // v > 2 for _, h, v, _ in frame):
        raise Undecodable("sampling")
    across, down = -(-width // (8 * hmax)), -(-height // (8 * vmax))
    tables = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(len(frame))}
    lists = [([], [], []) for _ in frame]
    total, every = across * down, restart or across * down
    if len(parts) < -(-total // every):
        raise Undecodable("restart")
    for number in range(-(-total // every)):
        first = number * every
        found = ([], [], [])
        # blocks of all components share one list; component c's rows are c, c + n, ...
        order = []
        for c, (name, h, v, _) in enumerate(frame):
            dc, ac = codes[tables[name] >> 4], codes[16 + (tables[name] & 15)]
            for y in range(v):
                for x in range(h):
                    order.append((lambda u, c=c, h=h, v=v, x=x, y=y, first=first:
                                  (((u + first) // across * v + y) * across * h + (u + first) % across * h + x) * len(frame) + c, c, dc, ac))
        _blocks(parts[number], order, found, min(every, total - first))
        where, places, values = (np.array(f, np.int64) for f in found)
        for c, into in enumerate(lists):
            mine = where % len(frame) == c
            for old, new in zip(into, (where[mine] // len(frame), places[mine], values[mine]), strict=True):
                old.append(new)
    planes = []
    for (_, h, v, q), into in zip(frame, lists, strict=True):
        rows, places, values = (np.concatenate(f) for f in into)
        block = np.zeros((across * h * down * v, 64))
        block[rows, ZIGZAG[places]] = values * quant[q][places]
        pixel = COSINES.T @ block.reshape(-1, 8, 8) @ COSINES + 128
        plane = np.clip(np.rint(pixel), 0, 255).astype(np.int32).reshape(down * v, across * h, 8, 8).swapaxes(1, 2).reshape(down * v * 8, across * h * 8)
        plane = plane[:-(-height * v // vmax), :-(-width * h // hmax)]
        if plane.shape[1] <= 2:                     # too narrow to be smoothed
            plane = plane.repeat(hmax // h, axis=1).repeat(vmax // v, axis=0)
        elif hmax // h == 2 and vmax // v == 2:     # both ways at once, rounded once
            plane = _wider(_wider(plane, 0, 0, 0), 1, 7, 8) >> 4
        elif hmax // h == 2:
            plane = _wider(plane, 1, 2, 1) >> 2
        elif vmax // v == 2:
            plane = plane.repeat(2, axis=0)
        planes.append(plane[:height, :width])
    if len(planes) == 1:
        return planes[0][..., None].astype(np.uint8)
    y, cb, cr = (p.astype(np.float64) for p in planes)
    if adobe == 0:
        red, green, blue = y, cb, cr
    else:
        cb, cr = cb - 128, cr - 128
        red, green, blue = y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb
    return np.clip(np.rint(np.stack([blue, green, red], axis=2)), 0, 255).astype(np.uint8)


# ---------------------------------------------------------------- small plain files

#: pixels up to which numpy decodes a file faster than Spark's image source, whatever its row filters
PLAIN_PIXELS = 1 << 10


#: how files begin that Java's own decoders (those of ``JAVA_FORMATS``) look at: PNG, JPEG, BMP, GIF, TIFF, WBMP
JAVA_SIGNS = (PNG_SIGN, b"\xff\xd8", b"BM", b"GIF8", b"II", b"MM", b"\x00")
JAVA_FORMATS = {"png", "jpg", "jpeg", "bmp", "gif", "tif", "tiff", "wbmp"}


def _plain_form(head: bytes) -> tuple[int, int]:
    """(bytes, rows with their filter) that the pixels of an 8-bit PNG up to ``PLAIN_PIXELS`` take; (0, 0) for others."""
    width, height, *form = struct.unpack(">IIBBBBB", head)
    channels = {(8, 0, 0, 0, 0): 1, (8, 2, 0, 0, 0): 3, (8, 6, 0, 0, 0): 4}.get(tuple(form))
    if channels is None or not 0 < width * height <= PLAIN_PIXELS:
        return 0, 0
    return (width * channels + 1) * height, height


def _plain_png(data: bytes) -> bool:
    at, kinds, body = len(PNG_SIGN), [], []
    while at < len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        chunk = data[at + 8:at + 8 + size]
        if struct.unpack_from(">I", data, at + 8 + size)[0] != zlib.crc32(kind + chunk):
            return False
        kinds.append(kind)
        body.append(chunk)
        at += 12 + size
    if at != len(data) or len(kinds) < 3 or kinds != [b"IHDR", *[b"IDAT"] * (len(kinds) - 2), b"IEND"] or body[-1]:
        return False
    need, height = _plain_form(body[0])
    if not need:
        return False
    unpack = zlib.decompressobj()
    raw = unpack.decompress(b"".join(body[1:-1]), need + 1)
    return len(raw) == need and unpack.eof and not unpack.unused_data and max(raw[::need // height]) <= 4


def _cut_png(data: bytes) -> bool:
    """Whether a PNG that would be plain ends within its pixels."""
    at, body = len(PNG_SIGN), []
    while at + 8 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        if kind != (b"IDAT" if body else b"IHDR"):
            return False
        body.append(data[at + 8:at + 8 + size])
        at += 12 + size
    if len(body) < 2 or at - 4 <= len(data):        # the last one must be short of bytes
        return False
    need, _ = _plain_form(body[0])
    return need > 0 and len(zlib.decompressobj().decompress(b"".join(body[1:]), need)) < need


def _plain_bmp(data: bytes) -> bool:
    size, _, start, info, width, height, planes, bits, packing, body, _, _, colors, _ = struct.unpack_from("<IIIIiiHHIIiiII", data, 2)
    line = -(-width * 3 // 4) * 4
    return ((start, info, planes, bits, packing, colors) == (54, 40, 1, 24, 0, 0) and width > 0 and height > 0 and width * height <= PLAIN_PIXELS
            and size == len(data) == 54 + line * height and body in (0, line * height))


def decode_plain(data: bytes) -> np.ndarray | None:
    """Pixels of a small PNG or BMP without any special feature or damage; null for everything else.

    Whole files of 8-bit gray, RGB or RGBA: every decoder reads them alike. Null
    says nothing about other decoders.
    """
    try:
        if data.startswith(PNG_SIGN):
            return np.ascontiguousarray(decode_png(data)) if _plain_png(data) else None
        return np.ascontiguousarray(decode_bmp(data)) if data.startswith(b"BM") and _plain_bmp(data) else None
    except (Undecodable, ValueError, IndexError, KeyError, struct.error, zlib.error):
        return None


def no_java_image(data: bytes) -> bool:
    """Whether Java's own decoders surely refuse a file: none knows how it begins, or it is a plain PNG cut within its pixels.

    False says nothing; a JVM with decoders beyond ``JAVA_FORMATS`` may read more.
    """
    if not data.startswith(JAVA_SIGNS):
        return True
    try:
        return data.startswith(PNG_SIGN) and _cut_png(data)
    except (struct.error, zlib.error):
        return False


# ---------------------------------------------------------------- batches

def decode_image(data: bytes | None) -> tuple[np.ndarray | None, str | None]:
    """(pixels, null) or (null, reason): ``empty_image`` or ``undecodable_image``."""
    if not data:
        return None, "empty_image"
    for sign, decoder in ((PNG_SIGN, decode_png), (b"BM", decode_bmp), (b"\xff\xd8", decode_jpeg)):
        if data.startswith(sign):
            try:
                return np.ascontiguousarray(decoder(data)), None
            except (Undecodable, ValueError, IndexError, KeyError, struct.error, zlib.error):
                break
    return None, "undecodable_image"


#: pixels a task gathers before it hands them on
BATCH_BYTES = 32 << 20
PIXELS = ("data", "height", "width", "nChannels")


def decode_bytes(df: DataFrame, content_col: str = "content", reason_col: str = "reject_reason", keep_content: bool = False) -> DataFrame:
    """``df`` without its bytes, plus ``data``, ``height``, ``width``, ``nChannels`` and ``reject_reason`` (null for an image).

    Rows that come with a reason already are not decoded. No row is lost; a null
    or empty value is ``empty_image``. Other columns pass through as they are.
    Arrow batches leave whenever ``BATCH_BYTES`` of pixels have gathered.
    """
    clash = {c.lower() for c in df.columns} & {c.lower() for c in PIXELS}
    if clash:
        raise ValueError(f"columns would clash: {sorted(clash)}")
    names = [c for c in df.columns if (keep_content or c != content_col) and c != reason_col]
    fields = [df.schema[c] for c in names] + [T.StructField("data", T.BinaryType()), *(T.StructField(c, T.IntegerType()) for c in PIXELS[1:]),
                                              T.StructField(reason_col, T.StringType())]
    has_reason = reason_col in df.columns

    def run(batches):
        for batch in batches:
            start, size, pixels, reasons = 0, 0, [], []
            known = batch.column(reason_col).to_pylist() if has_reason else [None] * batch.num_rows
            for i in range(batch.num_rows):
                image, reason = (None, known[i]) if known[i] is not None else decode_image(batch.column(content_col)[i].as_py())
                pixels.append(image)
                reasons.append(reason)
                size += 0 if image is None else image.nbytes
                if size >= BATCH_BYTES or i == batch.num_rows - 1:
                    rows = batch.slice(start, i + 1 - start)
                    shape = [pa.array([None if p is None else p.shape[k] for p in pixels], pa.int32()) for k in range(3)]
                    yield pa.RecordBatch.from_arrays([*(rows.column(n) for n in names), pa.array([None if p is None else p.tobytes() for p in pixels], pa.binary()),
                                                      *shape, pa.array(reasons, pa.string())], [f.name for f in fields])
                    start, size, pixels, reasons = i + 1, 0, [], []

    return df.mapInArrow(run, T.StructType(fields))
