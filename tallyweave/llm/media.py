"""Media columns: baseline JPEG decoded with numpy to luminance thumbnails of DC terms.

Markers are parsed for each image; then the restart intervals of all images of a
batch that share tables and layout are Huffman-decoded in step, one block of every
interval at a time. Only DC terms of luminance are kept: a thumbnail with one
pixel for each 8 x 8 block. Dimensions and hashes of the thumbnail are stored.

``encode_bytes`` makes such images from bytes without loss: every byte becomes one
flat block, whose DC term (quantised by 8) is the byte minus 128.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

UNIT = 576  # payloads are padded with 255 to multiples of it: whole rows of 24 blocks
WIDE = 24  # blocks in a row
FRAME = WIDE * 8184  # blocks in one image; JPEG sizes end at 65535 pixels, so more bytes make more images
STEP = 2 << 20  # payload bytes worked on at a time

SOF0, SOS, DQT, DHT, DRI, SOI, EOI = 0xC0, 0xDA, 0xDB, 0xC4, 0xDD, 0xD8, 0xD9


# --- decoding ---------------------------------------------------------------


class BadImage(ValueError):
    """Not a baseline JPEG that can be decoded."""


@dataclass
class Scan:
    """One entropy-coded scan: ``blocks`` lists (component, DC table, AC table) for each block of an MCU."""

    blocks: tuple
    mcus: int
    interval: int
    start: int
    end: int = 0
    cuts: list = field(default_factory=list)  # where restart markers stand
    luma: tuple = ()  # (index of luminance blocks in the MCU, h, v, MCUs in a row, q)


@dataclass
class Image:
    width: int
    height: int
    components: int
    scans: list[Scan]
    end: int


def huffman(counts: bytes, symbols: bytes) -> np.ndarray:
    """By the next 16 bits: code length * 256 + symbol; 0 where no code fits."""
    lut, code, k = np.zeros(1 << 16, np.int32), 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            first = code << (16 - length)
            lut[first:first + (1 << (16 - length))] = length << 8 | symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return lut


_joint: dict[tuple[bytes, bytes], tuple[np.ndarray, ...]] = {}


def joint(dc: bytes, ac: bytes) -> tuple[np.ndarray, ...]:
    """Tables for a DC and an AC definition; and, by the next 16 bits, length and difference of a whole block that has a DC term alone (length 0: another kind)."""
    if (dc, ac) not in _joint:
        if len(_joint) > 64:
            _joint.clear()
        d, a = huffman(dc[:16], dc[16:]), huffman(ac[:16], ac[16:])
        word = np.arange(1 << 16)
        n, s = d >> 8, d & 255
        ok = (n > 0) & (n + s <= 15)
        used = np.where(ok, n + s, 0)
        raw = (word >> (16 - used)) & ((1 << np.where(ok, s, 0)) - 1)
        diff = np.where(ok & (s > 0) & (raw < (1 << np.maximum(s - 1, 0))), raw - (1 << np.where(ok, s, 0)) + 1, raw)
        rest = a[(word << used) & 0xFFFF]  # low bits are not known, so only short codes count
        eob = ok & (rest > 0) & ((rest & 255) == 0) & (used + (rest >> 8) <= 16)
        _joint[dc, ac] = d, a, np.where(eob, used + (rest >> 8), 0).astype(np.int64), np.where(eob, diff, 0).astype(np.int32)
    return _joint[dc, ac]


def parse(b: bytes, at: int, marks: np.ndarray) -> Image:
    """Read the markers of the image that starts at ``at``; ``marks``: where 0xFF is followed by no 0x00 or 0xFF."""
    if b[at:at + 2] != b"\xff\xd8":
        raise BadImage("no start of image")
    p, quant, tables, frame, interval, scans = at + 2, {}, {}, None, 0, []
    while True:
        while p + 1 < len(b) and b[p] == 0xFF and b[p + 1] == 0xFF:
            p += 1
        if p + 4 > len(b) and b[p:p + 2] != b"\xff\xd9" or b[p] != 0xFF:
            raise BadImage("marker expected")
        kind = b[p + 1]
        if kind == EOI:
            break
        size = b[p + 2] << 8 | b[p + 3]
        body, p = b[p + 4:p + 2 + size], p + 2 + size
        if kind == DQT:
            while body:
                wide = body[0] >> 4
                quant[body[0] & 15] = body[1] << 8 | body[2] if wide else body[1]
                body = body[1 + 64 * (1 + wide):]
        elif kind == DHT:
            while body:
                n = 17 + sum(body[1:17])
                tables[body[0]] = bytes(body[1:n])
                body = body[n:]
        elif kind == DRI:
            interval = body[0] << 8 | body[1]
        elif kind == SOF0 or kind == 0xC1:
            if body[0] != 8:
                raise BadImage("not 8 bits a sample")
            frame = (body[3] << 8 | body[4], body[1] << 8 | body[2], [(body[i], body[i + 1] >> 4, body[i + 1] & 15, body[i + 2]) for i in range(6, 6 + 3 * body[5], 3)])
            if not all(frame[:2]):
                raise BadImage("no size")
        elif 0xC2 <= kind <= 0xCF and kind not in (0xC8, 0xCC):
            raise BadImage("not baseline")
        elif kind == SOS:
            if frame is None:
                raise BadImage("scan before frame")
            w, h, comps = frame
            hm, vm = max(c[1] for c in comps), max(c[2] for c in comps)
            by_id = {c[0]: (i, *c[1:]) for i, c in enumerate(comps)}
            part = [(by_id[body[i]], body[i + 1]) for i in range(1, 1 + 2 * body[0], 2)]
            blocks, luma = [], ()
            for (i, ch, cv, q), t in part:
                if t >> 4 not in tables or 16 | t & 15 not in tables or q not in quant:
                    raise BadImage("table missing")
                per = 1 if len(part) == 1 else ch * cv
                if len(part) == 1:
                    across, down = -(-(-(-w * ch // hm)) // 8), -(-(-(-h * cv // vm)) // 8)
                else:
                    across, down = -(-w // (8 * hm)), -(-h // (8 * vm))
                if i == 0:
                    luma = (len(blocks), *((1, 1) if len(part) == 1 else (ch, cv)), across, quant[q], -(-(-(-w * ch // hm)) // 8), -(-(-(-h * cv // vm)) // 8))
                blocks += [(i, tables[t >> 4], tables[16 | t & 15])] * per
            scan = Scan(tuple(blocks), across * down, interval or across * down, p, luma=luma)
            k = int(np.searchsorted(marks, p))
            while k < len(marks) and 0xD0 <= b[marks[k] + 1] <= 0xD7:
                scan.cuts.append(int(marks[k]))
                k += 1
            if k == len(marks):
                raise BadImage("no end")
            p = scan.end = int(marks[k])
            if len(scan.cuts) + 1 != -(-scan.mcus // scan.interval):
                raise BadImage("restart markers missing")
            scans.append(scan)
    if frame is None or not any(s.luma for s in scans):
        raise BadImage("no luminance")
    return Image(frame[0], frame[1], len(frame[2]), scans, p + 2)


def decode_scans(b: np.ndarray, scans: list[Scan]) -> list[np.ndarray]:
    """DC terms of each scan's luminance blocks, (MCUs, blocks an MCU); the scans share ``blocks``."""
    layout = scans[0].blocks
    starts, counts = [], []
    keep = np.zeros(len(b) + 1, bool)
    for s in scans:
        keep[s.start:s.end] = True
        edges = [s.start, *(c + 2 for c in s.cuts)]
        starts += edges
        counts += [s.interval] * (len(edges) - 1) + [s.mcus - s.interval * (len(edges) - 1)]
    keep[1:-1] &= ~((b[1:] == 0) & (b[:-1] == 0xFF))  # stuffed zeros
    data = b[keep[:-1]]
    at = np.cumsum(keep) - keep
    pos = at[np.array(starts)].astype(np.int64) * 8
    counts = np.array(counts)
    x = np.concatenate([data, np.full(8, 255, np.uint8)]).astype(np.int64)
    w = x[:-3] << 24 | x[1:-2] << 16 | x[2:-1] << 8 | x[3:]
    order = np.argsort(-counts, kind="stable")
    pos, left = pos[order], counts[order]
    steps = int(counts.max())
    live = np.searchsorted(-left, -np.arange(steps), side="left")  # intervals with more MCUs than so many
    inner = [k for k, blk in enumerate(layout) if blk[0] == 0]
    out = np.zeros((steps, max(1, len(inner)), len(pos)), np.int32)
    last = len(w) - 1

    def peek(p: np.ndarray) -> np.ndarray:
        return (w[np.minimum(p >> 3, last)] >> (16 - (p & 7))) & 0xFFFF

    for t in range(steps):
        n = int(live[t])
        for k, (component, dc, ac) in enumerate(layout):
            d_lut, a_lut, whole, diff = joint(dc, ac)
            p = pos[:n]
            word = peek(p)
            length, value = whole[word], diff[word]
            slow = np.flatnonzero(length == 0)
            if slow.size:
                q = p[slow]
                e = d_lut[word[slow]]
                if not e.all():
                    raise BadImage("bad code")
                q, s = q + (e >> 8), e & 255
                raw = (w[np.minimum(q >> 3, last)] >> (32 - s - (q & 7))) & ((1 << s) - 1)
                value[slow] = np.where((s > 0) & (raw < (1 << np.maximum(s - 1, 0))), raw - (1 << s) + 1, raw)
                q = q + s
                coefficient, on = np.ones(len(q), np.int64), np.arange(len(q))
                while on.size:
                    e = a_lut[peek(q[on])]
                    if not e.all():
                        raise BadImage("bad code")
                    run, bits = (e & 255) >> 4, e & 15
                    q[on] += (e >> 8) + bits
                    coefficient[on] += run + 1
                    on = on[(e & 255 != 0) & (coefficient[on] < 64)]
                length = length.copy()
                length[slow] = q - p[slow]
            pos[:n] += length
            if component == 0:
                out[t, inner.index(k), :n] = value
    if (pos > 8 * len(data) + 7).any():
        raise BadImage("data ends early")
    flat = out.reshape(-1, len(pos)).cumsum(0).T.reshape(len(pos), steps, -1)
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    result, k = [], 0
    for s in scans:
        m = len(s.cuts) + 1
        rows = flat[back[k:k + m]]
        result.append(rows.reshape(-1, rows.shape[2])[:s.mcus] if m == 1 or s.interval == steps else np.concatenate([r[:c] for r, c in zip(rows, counts[k:k + m])]))
        k += m
    return result


def decode(media: list[bytes | None]) -> list[tuple | None]:
    """For each stream of one or more images: (width, height, components, images, thumbnail), or None.

    The thumbnails of a stream's images stand below each other, so those images
    must be equally wide. What is no such stream gives None.
    """
    whole = b"".join(m or b"" for m in media)
    b = np.frombuffer(whole, np.uint8)
    marks = np.flatnonzero((b[:-1] == 0xFF) & (b[1:] != 0) & (b[1:] != 0xFF)) if len(b) else np.zeros(0, int)
    streams: list[list[Image] | None] = []
    at = 0
    for m in media:
        end, images = at + len(m or b""), []
        try:
            while at < end:
                images.append(parse(whole, at, marks))
                at = images[-1].end
                if at > end:
                    raise BadImage("image runs over")
            streams.append(images if images and len({i.width for i in images}) == 1 else None)
        except (BadImage, IndexError, KeyError, TypeError):
            streams.append(None)
        at = end
    groups: dict[tuple, list[Scan]] = {}
    for images in streams:
        for image in images or ():
            for s in image.scans:
                if s.luma:
                    groups.setdefault(s.blocks, []).append(s)
    dc: dict[int, np.ndarray] = {}
    for scans in groups.values():
        try:
            found = decode_scans(b, scans)
        except (BadImage, IndexError):  # one of them is broken: find which
            found = []
            for s in scans:
                try:
                    found += decode_scans(b, [s])
                except (BadImage, IndexError):
                    found.append(None)
        dc |= {id(s): x for s, x in zip(scans, found)}
    out: list[tuple | None] = []
    for images in streams:
        shots = []
        for image in images or ():
            s = next(s for s in image.scans if s.luma)
            x, (_, h, v, across, q, wide, high) = dc[id(s)], s.luma
            if x is None:
                shots = []
                break
            grid = x.reshape(-1, across, v, h).transpose(0, 2, 1, 3).reshape(-1, across * h)[:high, :wide]
            shots.append(np.clip(np.rint(grid * (q / 8) + 128), 0, 255).astype(np.uint8))
        out.append((images[0].width, sum(i.height for i in images), images[0].components, len(images), np.concatenate(shots)) if shots else None)
    return out


def hashes(thumb: np.ndarray) -> tuple[str, str]:
    """64-bit average and difference hashes of a thumbnail, as hexadecimal digits."""

    def shrink(rows: int, columns: int) -> np.ndarray:
        r, c = np.arange(rows) * thumb.shape[0] // rows, np.arange(columns) * thumb.shape[1] // columns
        area = np.maximum(np.diff([*r, thumb.shape[0]]), 1)[:, None] * np.maximum(np.diff([*c, thumb.shape[1]]), 1)
        return np.add.reduceat(np.add.reduceat(thumb.astype(np.int64), r, 0), c, 1) / area

    a, d = shrink(8, 8), shrink(8, 9)
    return tuple(np.packbits(x.ravel()).tobytes().hex() for x in (a > a.mean(), d[:, 1:] > d[:, :-1]))


# --- storing bytes ----------------------------------------------------------

#: Nine classes of DC differences (0 to 8 bits) with 4-bit codes, and an end-of-block code of 1 bit.
DC_TABLE, AC_TABLE = bytes([0, 0, 0, 9, *[0] * 12, *range(9)]), bytes([1, *[0] * 15, 0])


def code_bits() -> tuple[np.ndarray, np.ndarray]:
    """Bits of each difference -255 to 255 with its end of block, then of 0 to 7 bits of filling; and which of 13 are used."""
    bits, used = np.zeros((511 + 8, 13), np.uint8), np.zeros((511 + 8, 13), bool)
    for d in range(-255, 256):
        s = abs(d).bit_length()
        text = f"{s:04b}" + (f"{d if d > 0 else d + (1 << s) - 1:0{s}b}" if s else "") + "0"
        bits[d + 255, :len(text)], used[d + 255, :len(text)] = [int(x) for x in text], True
    for n in range(8):
        bits[511 + n, :n], used[511 + n, :n] = 1, True
    return bits, used


BITS, USED = code_bits()
LENGTHS = USED.sum(1)


def header(rows: int) -> bytes:
    def part(kind: int, body: bytes) -> bytes:
        return bytes([0xFF, kind]) + (len(body) + 2).to_bytes(2, "big") + body

    return (bytes([0xFF, SOI]) + part(DQT, bytes([0, *[8] * 64]))
            + part(SOF0, bytes([8]) + (8 * rows).to_bytes(2, "big") + (8 * WIDE).to_bytes(2, "big") + bytes([1, 1, 0x11, 0]))
            + part(DHT, bytes([0x00]) + DC_TABLE) + part(DHT, bytes([0x10]) + AC_TABLE)
            + part(DRI, WIDE.to_bytes(2, "big")) + part(SOS, bytes([1, 1, 0x00, 0, 63, 0])))


def encode_bytes(payloads: list[bytes]) -> list[bytes]:
    """A stream of JPEG images for each payload (a positive multiple of 24 bytes): a block a byte, a restart interval a row."""
    values = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, WIDE).astype(np.int64)
    codes = np.empty((len(values), WIDE + 1), np.int64)
    codes[:, 0] = values[:, 0] - 128 + 255
    codes[:, 1:WIDE] = np.diff(values, axis=1) + 255
    n = LENGTHS[codes[:, :WIDE]].sum(1)
    codes[:, WIDE] = 511 + (-n) % 8
    flat = codes.ravel()
    coded = np.packbits(BITS[flat][USED[flat]])
    ends = np.cumsum((n + 7) // 8)  # of rows, in coded bytes
    full = coded == 0xFF
    stuffed = np.concatenate([[0], np.cumsum(full)])
    row = np.repeat(np.arange(len(values)), np.diff(ends, prepend=0))
    out = np.zeros(len(coded) + int(stuffed[-1]) + 2 * len(values), np.uint8)
    out[np.arange(len(coded)) + stuffed[:-1] + 2 * row] = coded
    after = ends + stuffed[ends] + 2 * np.arange(len(values))  # where each row's marker goes
    rows = np.array([len(p) // WIDE for p in payloads])
    in_payload = np.arange(len(values)) - np.repeat(np.cumsum(rows) - rows, rows)
    in_frame = in_payload % (FRAME // WIDE)
    out[after], out[after + 1] = 0xFF, 0xD0 + in_frame % 8
    data, result, r = out.tobytes(), [], 0
    for m in rows.tolist():
        frames = []
        for k in range(0, m, FRAME // WIDE):
            first, last = r + k, r + min(m, k + FRAME // WIDE) - 1
            frames += [header(last - first + 1), data[after[first - 1] + 2 if first else 0:after[last]], b"\xff\xd9"]
        result.append(b"".join(frames))
        r += m
    return result


def padded(text: bytes | None) -> bytes:
    text = text or b""
    return text + b"\xff" * (max(UNIT, -(-len(text) // UNIT) * UNIT) - len(text))


# --- DataFrame operators ----------------------------------------------------


def media_columns(df: DataFrame, media: str) -> DataFrame:
    """``df``'s column ``media`` (binary) with width, height, components, images, thumbnail, average_hash, difference_hash.

    All other columns stay, but those of the names above are replaced. Null,
    empty, broken or non-baseline values keep their rows, with nulls in the new
    columns. Narrow: no shuffle; a batch is decoded in parts of bounded size.
    """
    added = T.StructType.fromDDL("width int, height int, components int, images int, thumbnail binary, average_hash string, difference_hash string")
    df = df.drop(*(n for n in added.names if n != media))
    schema = T.StructType([*df.schema.fields, *added.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(media))
            for first, values in parts(column):
                rows = []
                for x in decode(values):
                    rows.append((*x[:4], x[4].tobytes(), *hashes(x[4])) if x else (None,) * 7)
                new = [pa.array(c, t) for c, t in zip(zip(*rows), (*[pa.int32()] * 4, pa.binary(), pa.string(), pa.string()))]
                yield pa.RecordBatch.from_arrays([*batch.slice(first, len(values)).columns, *new], names=schema.names)

    return df.mapInArrow(run, schema)


def parts(column: pa.Array) -> Iterator[tuple[int, list[bytes | None]]]:
    """Runs of values with about STEP bytes, and where each starts."""
    first, values, size = 0, [], 0
    for i, x in enumerate(column):
        values.append(x.as_py())
        size += len(values[-1] or b"") + 64
        if size >= STEP:
            yield first, values
            first, values, size = i + 1, [], 0
    if values:
        yield first, values


def texts_as_images(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``n_bytes`` and ``media``: each text's UTF-8 bytes, padded, as JPEG images (null: no bytes)."""
    schema = T.StructType([docs.schema[key], T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, values in parts(batch.column(1).cast(pa.binary())):
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(first, len(values)), pa.array([len(v or b"") for v in values], pa.int64()),
                    pa.array(encode_bytes([padded(v) for v in values]), pa.binary())], names=schema.names)

    return docs.select(key, text).mapInArrow(run, schema)


def digest(stored: DataFrame, key: str = "doc_id") -> DataFrame:
    """What is read back from ``texts_as_images``: sizes and hashes of payload and media, and the feature.

    Media that is null or can't be decoded gives nulls for all that is read from it.
    """
    schema = T.StructType([stored.schema[key], *T.StructType.fromDDL("n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, values in parts(batch.column(2)):
                rows = []
                for m, x in zip(values, decode(values), strict=True):
                    if x is None:
                        rows.append((None, None, None, m and len(m), m and hashlib.sha256(m).hexdigest(), None))
                        continue
                    payload = x[4].tobytes()
                    rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(m), hashlib.sha256(m).hexdigest(), f"{x[0]}x{x[1]}:{':'.join(hashes(x[4]))}"))
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([*batch.slice(first, len(values)).columns[:2], *(pa.array(c, t) for c, t in zip(zip(*rows), kinds))], names=schema.names)

    return stored.select(key, "n_bytes", "media").mapInArrow(run, schema)
