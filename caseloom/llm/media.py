"""Media columns: baseline JPEG written, parsed and entropy-decoded in numpy.

The decoder reads any Huffman-coded baseline JPEG (8-bit samples, one scan, any sampling factors, with or
without restart markers): it parses the marker segments, undoes byte stuffing, decodes the scan and keeps
the DC coefficients of the luminance component, which are a thumbnail at an eighth of the size. Restart
segments are independent of each other, so those of all images of a slice are decoded in lockstep, one
coefficient of each at a time, with array operations.

``payload_images`` stores bytes losslessly as such images: the format's unit is the 8x8 block of 64
quantised coefficients, and each byte becomes one coefficient of size category 8, which has exactly 256
values. Every block is its own restart interval, so one block's damage or decoding never touches another.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from caseloom.llm.common import table, written
from caseloom.llm.tokens import slices

BLOCK = 64
#: Payload or image bytes that are worked on together.
SLICE_BYTES = 2_000_000
#: Scale of the DC coefficient; with it the thumbnail spans the whole range of grey.
DC_STEP = 4

#: Code tables of the images written here: size 8 is the code 0, "nothing" the code 10.
_DC_TABLE = ([1, 1], [8, 0])
_AC_TABLE = ([1, 1], [0x08, 0x00])


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _huffman_segment(kind: int, table: tuple[list[int], list[int]]) -> bytes:
    counts, symbols = table
    return _segment(0xC4, bytes([kind << 4]) + bytes(counts + [0] * (16 - len(counts))) + bytes(symbols))


_TABLES = _segment(0xDB, bytes([0, DC_STEP]) + bytes([1] * 63)) + _huffman_segment(0, _DC_TABLE) + _huffman_segment(1, _AC_TABLE) + _segment(0xDD, struct.pack(">H", 1)) + _segment(0xDA, bytes([1, 1, 0, 0, 63, 0]))


def _grid(blocks: int) -> tuple[int, int]:
    """Width and height in blocks of an image with room for so many blocks: nearly square."""
    width = min(8191, max(1, int(np.ceil(np.sqrt(blocks)))))
    height = -(-blocks // width)
    if height > 8191:
        raise ValueError("a payload of more than 4 GB does not fit one image")
    return width, height


def write_images(payloads: list[bytes], lengths: list[int]) -> list[bytes]:
    """A baseline JPEG for each payload (a positive multiple of 64 bytes); lengths go into its comment."""
    if not payloads:
        return []
    data = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, 8)
    stream = np.empty((len(data), 9), np.uint8)  # each byte is the code 0 and its eight bits
    stream[:, 0] = data[:, 0] >> 1
    for j in range(1, 8):
        stream[:, j] = ((data[:, j - 1] & ((1 << j) - 1)) << (8 - j)) | (data[:, j] >> (j + 1))
    stream[:, 8] = data[:, 7]
    stream = stream.reshape(-1, 72)
    n_blocks = np.array([len(p) // BLOCK for p in payloads])
    first = np.cumsum(n_blocks) - n_blocks
    nth = np.arange(len(stream)) - np.repeat(first, n_blocks)
    rows = np.empty((len(stream), 74), np.uint8)
    rows[:, :72] = stream
    rows[:, 72] = 0xFF
    rows[:, 73] = 0xD0 + nth % 8
    twice = np.ones(rows.shape, np.uint8)
    twice[:, :72] += stream == 0xFF
    ends = np.cumsum(twice.sum(axis=1, dtype=np.int64))
    flat, twice = rows.reshape(-1), twice.reshape(-1)
    if (stuffed := np.flatnonzero(twice == 2)).size:
        flat = np.repeat(flat, twice)
        flat[stuffed + 1 + np.arange(len(stuffed))] = 0
    scan, out = flat.tobytes(), []
    start = 0
    for p, n, blocks, last in zip(payloads, lengths, n_blocks.tolist(), (first + n_blocks).tolist()):
        width, height = _grid(blocks)
        stop = int(ends[last - 1])
        empty = b"".join(b"\xaf\xff" + bytes([0xD0 + i % 8]) for i in range(blocks, width * height))
        frame = _segment(0xC0, struct.pack(">BHHBBBB", 8, height * 8, width * 8, 1, 1, 0x11, 0))
        body = (scan[start:stop] + empty)[:-2]
        out.append(b"\xff\xd8" + _segment(0xFE, b"bytes=%d" % n) + frame + _TABLES + body + b"\xff\xd9")
        start = stop
    return out


class Header:
    """The marker segments of one image up to its scan."""

    def __init__(self, image: bytes):
        if image[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG: no start marker")
        self.quant: dict[int, list[int]] = {}
        self.huffman: dict[tuple[int, int], tuple[bytes, bytes]] = {}
        self.parts: list[tuple[int, int, int, int]] = []  # id, horizontal and vertical factor, table
        self.comment, self.restart, self.width, self.height = b"", 0, 0, 0
        at = 2
        while True:
            if image[at] != 0xFF:
                raise ValueError("not a JPEG: no marker where one is due")
            marker = image[at + 1]
            if marker == 0xFF:
                at += 1
                continue
            size = int.from_bytes(image[at + 2 : at + 4], "big")
            body = image[at + 4 : at + 2 + size]
            at += 2 + size
            if marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    step = 128 if wide else 64
                    self.quant[body[0] & 15] = list(struct.unpack(">64H" if wide else "64B", body[1 : 1 + step]))
                    body = body[1 + step :]
            elif marker == 0xC4:
                while body:
                    n = sum(body[1:17])
                    self.huffman[body[0] >> 4, body[0] & 15] = (body[1:17], body[17 : 17 + n])
                    body = body[17 + n :]
            elif marker == 0xC0:
                self.height, self.width = struct.unpack(">HH", body[1:5])
                self.parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
            elif 0xC1 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
                raise ValueError("only baseline JPEG is read")
            elif marker == 0xDD:
                self.restart = int.from_bytes(body[:2], "big")
            elif marker == 0xFE:
                self.comment = body
            elif marker == 0xDA:
                tables = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
                break
        self.scan = at
        if len(self.parts) == 1:  # a single component is not interleaved: one block a unit
            self.parts = [(self.parts[0][0], 1, 1, self.parts[0][3])]
        self.most_h, self.most_v = max(p[1] for p in self.parts), max(p[2] for p in self.parts)
        self.across = -(-self.width // (8 * self.most_h))
        self.down = -(-self.height // (8 * self.most_v))
        self.coded = tuple((h, v, self.huffman[0, tables[i] >> 4], self.huffman[1, tables[i] & 15]) for i, h, v, _ in self.parts)

    def alike(self) -> tuple:
        """Images for which this is equal can be decoded in lockstep."""
        return self.coded, self.restart or -self.across * self.down


def _lookup(table: tuple[bytes, bytes]) -> np.ndarray:
    """For every 16 bits ahead: length of the code there and its symbol; length 0 where there is none."""
    counts, symbols = table
    out = np.zeros(1 << 16, np.int32)
    code, k = 0, 0
    for length, n in enumerate(counts, 1):
        for s in symbols[k : k + n]:
            low = code << (16 - length)
            out[low : low + (1 << (16 - length))] = (length << 8) | s
            code += 1
        k += n
        code <<= 1
    return out


def _unstuffed(scans: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entropy-coded bytes without stuffing and markers, where each segment starts, and whose it is."""
    raw = np.frombuffer(b"".join(scans) + b"\0", np.uint8)
    escape = np.flatnonzero(raw[:-1] == 0xFF)
    after = raw[escape + 1]
    marker = escape[after != 0]
    drop = np.ones(len(raw), bool)
    drop[escape + 1] = False
    drop[marker] = False
    drop[-1] = False
    kept = np.cumsum(drop)
    image_end = np.cumsum([len(s) for s in scans])
    starts = np.r_[0, marker[:-1] + 2]
    at = np.where(starts > 0, kept[np.maximum(starts - 1, 0)], 0)
    return raw[drop], at, np.searchsorted(image_end, starts, side="right")


def _more(words: np.ndarray, bit: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Signed values of ``size`` bits at ``bit``: those whose first bit is 0 are negative."""
    value = ((words[bit >> 3] << (bit & 7).astype(np.uint32)) >> np.uint32(16)).astype(np.int32) >> (16 - size)
    return np.where(value < (1 << size >> 1), value - (1 << size) + 1, value)


def _coefficients(data: np.ndarray, starts: np.ndarray, units: np.ndarray, coded: tuple) -> list[np.ndarray]:
    """Coefficients of all blocks: for each component an array of segment, unit, block in unit, 64."""
    padded = np.r_[data, np.full(8, 0xFF, np.uint8)].astype(np.uint32)
    words = (padded[:-3] << 24) | (padded[1:-2] << 16) | (padded[2:-1] << 8) | padded[3:]
    bit = starts.astype(np.int64) * 8
    last = (len(words) - 1) * 8
    most = int(units.max())
    out = [np.zeros((len(starts), most, h * v, BLOCK), np.int16) for h, v, _, _ in coded]
    luts = [(_lookup(dc), _lookup(ac)) for _, _, dc, ac in coded]
    before = [np.zeros(len(starts), np.int32) for _ in coded]
    for unit in range(most):
        alive = np.flatnonzero(units > unit)
        for c, (h, v, _, _) in enumerate(coded):
            for b in range(h * v):
                dc, ac = luts[c]
                target = out[c][:, unit, b, :]
                here = bit[alive]
                got = dc[((words[here >> 3] << (here & 7).astype(np.uint32)) >> np.uint32(16))]
                here = here + (got >> 8)
                size = got & 15
                before[c][alive] += _more(words, here, size)
                target[alive, 0] = before[c][alive]
                bit[alive] = here + size
                live, k = alive, np.ones(len(alive), np.int64)
                here = bit[live]
                while live.size:
                    if here.max() > last:
                        raise ValueError("a scan ends too early")
                    got = ac[((words[here >> 3] << (here & 7).astype(np.uint32)) >> np.uint32(16))]
                    if not got.all():
                        raise ValueError("a scan holds a code that is in no table")
                    here = here + (got >> 8)
                    symbol = got & 0xFF
                    size, run = symbol & 15, symbol >> 4
                    value = _more(words, here, size)
                    here = here + size
                    ended = symbol == 0
                    k = k + run
                    if (put := size > 0).all():
                        target[live, k] = value
                    else:
                        target[live[put], k[put]] = value[put]
                    k = np.where(ended, BLOCK, k + 1)
                    if (done := k >= BLOCK).any():
                        bit[live[done]] = here[done]
                        live, k, here = live[~done], k[~done], here[~done]
    return out


def read_images(images: list[bytes]) -> list[tuple[Header, np.ndarray]]:
    """For each image its header and the luminance coefficients of its blocks, rows of blocks in order.

    The second is an array of height in blocks, width in blocks and 64, in zigzag order.
    """
    headers = [Header(x) for x in images]
    groups: dict[tuple, list[int]] = {}
    for i, h in enumerate(headers):
        groups.setdefault(h.alike(), []).append(i)
    out: list = [None] * len(images)
    for members in groups.values():
        head = headers[members[0]]
        data, starts, whose = _unstuffed([images[i][headers[i].scan :] for i in members])
        total = np.array([headers[i].across * headers[i].down for i in members])
        first = np.searchsorted(whose, np.arange(len(members)))
        nth = np.arange(len(starts)) - first[whose]
        step = head.restart or int(total.max())
        units = np.minimum(step, total[whose] - nth * step)
        found = _coefficients(data, starts, units, head.coded)[0]
        h, v = head.coded[0][:2]
        for j, i in enumerate(members):
            lo = first[j]
            hi = first[j + 1] if j + 1 < len(members) else len(starts)
            x = headers[i]
            own = found[lo:hi].reshape(-1, h * v, BLOCK)[: x.across * x.down]
            out[i] = (x, own.reshape(x.down, x.across, v, h, BLOCK).transpose(0, 2, 1, 3, 4).reshape(x.down * v, x.across * h, BLOCK))
    return out


def thumbnail(header: Header, blocks: np.ndarray) -> np.ndarray:
    """The image at an eighth of its size, from the DC coefficients alone."""
    step = header.quant[header.parts[0][3]][0]
    return np.clip(blocks[:, :, 0].astype(np.int32) * step // 8 + 128, 0, 255).astype(np.uint8)


def average_hash(thumb: np.ndarray) -> str:
    """64 bits: which cells of an 8x8 grid over the thumbnail are lighter than the mean of the cells."""
    h, w = thumb.shape
    cell = ((np.arange(h) * 8 // h)[:, None] * 8 + (np.arange(w) * 8 // w)[None, :]).ravel()
    n = np.bincount(cell, minlength=64)
    mean = np.bincount(cell, weights=thumb.ravel(), minlength=64) / np.maximum(n, 1)
    light = (mean > mean[n > 0].mean()) & (n > 0)
    return np.packbits(light).tobytes().hex()


def payload_images(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key, media``: every whole text as UTF-8, padded with zeros to a positive multiple of 64, as a JPEG.

    A null text counts as empty (one block of zeros). Equal texts give equal images; repeated rows and other
    columns do no harm, an empty table gives an empty table.
    """
    kind = docs.schema[key].dataType.simpleString()

    def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(1)), 0).to_pylist()
            for i, j in slices(sizes, SLICE_BYTES):
                texts = [(t or "").encode() for t in batch.column(1)[i:j].to_pylist()]
                payloads = [t + bytes(-len(t) % BLOCK if t else BLOCK) for t in texts]
                media = write_images(payloads, [len(t) for t in texts])
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array(media, pa.binary())], [key, "media"])

    return docs.select(key, text).mapInArrow(stored, f"`{key}` {kind}, media binary")


def image_features(media: DataFrame, key: str = "doc_id") -> DataFrame:
    """What the images of ``payload_images`` hold, from their bytes alone.

    ``key, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, width,
    height``; the feature is the size in pixels, the average hash of the thumbnail and its CRC-32. Blocks
    whose DC coefficient is 0 only fill up the last row and hold no payload.
    """
    kind = media.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, width int, height int"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in slices(pa.compute.binary_length(batch.column(1)).to_pylist(), SLICE_BYTES):
                rows, images = [], batch.column(1)[i:j].to_pylist()
                for image, (head, blocks) in zip(images, read_images(images)):
                    own = blocks.reshape(-1, BLOCK)
                    own = own[own[:, 0] != 0]
                    payload = (own + (own < 0) * np.int16(255)).astype(np.uint8).tobytes()
                    thumb = thumbnail(head, blocks)
                    feature = f"{head.width}x{head.height}:{average_hash(thumb)}:{zlib.crc32(thumb.tobytes()):08x}"
                    rows.append((int(head.comment.removeprefix(b"bytes=")), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(image), hashlib.sha256(image).hexdigest(), feature, head.width, head.height))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], *(pa.array(c, t) for c, t in zip(zip(*rows), kinds))], [key, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height"])

    return media.select(key, "media").mapInArrow(read, schema)


def op3_jpeg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text stored as an image in a table of the shared folder, and what is read back from there.

    Null and empty texts are one block of zeros; texts of any length are one image; equal texts and repeated
    rows give equal values and a row each; an empty table gives none; no other column is read, whatever its name.
    """
    stored = written(payload_images(table(spark, sf_dir, "documents")), "media", "zstd")
    return image_features(stored)


QUERIES = {"op3_jpeg_media": op3_jpeg_media}
ORACLE: dict[str, str] = {}
