"""Media columns: a baseline JPEG reader and a lossless payload container in numpy.

read_images() parses the markers of whole batches of JPEG streams, Huffman-decodes their scans and rebuilds
luminance thumbnails from the DC coefficients alone, one sample for each 8x8 block, with dimensions and thumbnail
hashes. Restart intervals are independent, so all intervals of all images of a batch are decoded in lockstep:
each step takes one symbol of every interval by table lookup.

write_payloads() stores bytes as the quantised coefficients of a greyscale baseline JPEG, which is lossless:
576 bytes are one restart interval of nine blocks (24x24 samples); in zigzag order, the first byte b of a block is
its DC coefficient b - 128 and each other byte b is the AC coefficient 256 + b, never zero. The Huffman tables give
every DC difference 12 bits and every AC coefficient 10 bits, so intervals have a fixed length before byte
stuffing. Payloads beyond MOST_TILES tiles go into several images, one after the other.

Everything is narrow: no shuffle. Defined cases: a null text is an empty text, whose payload is 576 bytes 255;
repeated rows give repeated results; an empty table gives an empty table; damaged or unsupported streams
(progressive, arithmetic, 12-bit, components in several scans) give a row with null features and the reason in `error`;
bytes behind an image that begin no other one are left alone; columns named like results give way to them.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import unused

TILE = 576
BLOCKS = 9  # of 64 coefficients in a tile
MOST_TILES = 2730  # 24 rows of samples each, at most 65,535 rows in an image
BATCH_BYTES = 4_000_000


# ------------------------------------------------------------------------------------------ writing


def _dc_table() -> bytes:
    """Categories 0..8 with codes of 12 - category bits: the shortest code is that of category 8."""
    counts = [0] * 16
    for category in range(9):
        counts[12 - category - 1] += 1
    return bytes([0x00, *counts, *range(8, -1, -1)])


#: Only symbol: no zeros before, 9 bits of value; its code is the bit 0.
_AC_TABLE = bytes([0x10, 1, *[0] * 15, 0x09])


def _codes(table: bytes) -> dict[int, tuple[int, int]]:
    """Symbol to (code, length) of a DHT table."""
    out, code, at = {}, 0, 17
    for bits in range(1, 17):
        for _ in range(table[bits]):
            out[table[at]] = (code, bits)
            code += 1
            at += 1
        code <<= 1
    return out


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _dc_words() -> np.ndarray:
    """The 12 bits of every DC difference, at index difference + 256."""
    codes = _codes(_dc_table())
    out = np.zeros(513, dtype=np.uint16)
    for diff in range(-255, 256):
        size = abs(diff).bit_length()
        code, bits = codes[size]
        assert bits + size == 12
        out[diff + 256] = code << size | (diff if diff > 0 else diff + (1 << size) - 1 if diff else 0)
    return out


_DC_WORDS = _dc_words()
_DC_BITS = ((_DC_WORDS[:, None] >> np.arange(11, -1, -1)) & 1).astype(np.uint8)
_HEAD = b"\xff\xd8" + _segment(0xDB, bytes([0]) + bytes([8]) + bytes([1]) * 63)
_TABLES = _segment(0xC4, _dc_table()) + _segment(0xC4, _AC_TABLE) + _segment(0xDD, struct.pack(">H", BLOCKS))


def _scans(tiles: np.ndarray) -> list[bytes]:
    """The entropy-coded bytes of each tile (n, 576), stuffed."""
    n = len(tiles)
    blocks = tiles.reshape(n, BLOCKS, 64)
    bits = np.empty((n, BLOCKS, 642), dtype=np.uint8)
    dc = blocks[:, :, 0].astype(np.int16) - 128
    bits[:, :, :12] = _DC_BITS[np.diff(dc, axis=1, prepend=0) + 256]
    ac = np.lib.stride_tricks.as_strided(bits[:, :, 12:], (n, BLOCKS, 63, 10), (*bits.strides[:2], 10, 1))
    ac[..., 0] = 0
    ac[..., 1] = 1
    ac[..., 2:] = np.unpackbits(np.ascontiguousarray(blocks[:, :, 1:]), axis=2).reshape(n, BLOCKS, 63, 8)
    flat = bits.reshape(n, -1)
    pad = -flat.shape[1] % 8
    packed = np.packbits(np.concatenate([flat, np.ones((n, pad), np.uint8)], axis=1), axis=1)
    width, raw = packed.shape[1], packed.tobytes()
    return [raw[i * width : (i + 1) * width].replace(b"\xff", b"\xff\x00") for i in range(n)]


def pad_payload(raw: bytes) -> bytes:
    return raw + b"\xff" * (TILE if not raw else -len(raw) % TILE)


def write_payloads(payloads: list[bytes]) -> list[bytes]:
    """JPEG streams that hold the payloads, whose lengths are positive multiples of 576."""
    scans = _scans(np.frombuffer(b"".join(payloads), dtype=np.uint8).reshape(-1, TILE))
    out, at = [], 0
    for payload in payloads:
        images, todo = [], len(payload) // TILE
        while todo:
            n = min(todo, MOST_TILES)
            frame = _segment(0xC0, struct.pack(">BHHB", 8, 24 * n, 24, 1) + bytes([1, 0x11, 0]))
            parts = [_HEAD, frame, _TABLES, _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))]
            for i in range(n):
                parts.append(scans[at + i])
                parts.append(bytes([0xFF, 0xD0 + i % 8]) if i + 1 < n else b"\xff\xd9")
            images.append(b"".join(parts))
            at, todo = at + n, todo - n
        out.append(b"".join(images))
    return out


# ------------------------------------------------------------------------------------------ reading


class Image:
    """A parsed stream: geometry, tables and the restart intervals of its scan."""

    def __init__(self) -> None:
        self.quant: dict[int, np.ndarray] = {}
        self.tables: dict[tuple[int, int], bytes] = {}
        self.restart = 0
        self.width = self.height = 0
        self.components: list[list[int]] = []  # id, h, v, quantiser, DC table, AC table
        self.intervals: list[bytes] = []

    def mcus(self) -> tuple[int, int]:
        if len(self.components) == 1:
            return -(-self.width // 8), -(-self.height // 8)
        h, v = max(c[1] for c in self.components), max(c[2] for c in self.components)
        return -(-self.width // (8 * h)), -(-self.height // (8 * v))

    def pattern(self) -> list[int]:
        """Component index of each block of an MCU."""
        if len(self.components) == 1:
            return [0]
        return [i for i, c in enumerate(self.components) for _ in range(c[1] * c[2])]


def parse(stream: bytes, at: int = 0) -> tuple[Image, int]:
    """The image that begins at `at`, and where its stream ends."""
    if stream[at : at + 2] != b"\xff\xd8":
        raise ValueError("no start of image")
    image, at = Image(), at + 2
    while True:
        if at + 4 > len(stream) or stream[at] != 0xFF:
            raise ValueError("no marker where one is due")
        marker = stream[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        length = struct.unpack_from(">H", stream, at + 2)[0]
        body, at = stream[at + 4 : at + 2 + length], at + 2 + length
        if marker == 0xDB:
            i = 0
            while i < len(body):
                wide, k = body[i] >> 4, body[i] & 15
                image.quant[k] = np.frombuffer(body, ">u2" if wide else "u1", 64, i + 1).astype(np.int64)
                i += 129 if wide else 65
        elif marker == 0xC4:
            i = 0
            while i < len(body):
                n = 17 + sum(body[i + 1 : i + 17])
                image.tables[body[i] >> 4, body[i] & 15] = body[i : i + n]
                i += n
        elif marker == 0xDD:
            image.restart = struct.unpack(">H", body[:2])[0]
        elif marker in (0xC0, 0xC1):
            bits, image.height, image.width, n = struct.unpack_from(">BHHB", body)
            if bits != 8 or not image.height or not image.width:
                raise ValueError("not 8-bit baseline with known size")
            if not 1 <= n <= 4:
                raise ValueError("not one to four components")
            image.components = [[body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i], 0, 0] for i in range(n)]
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("not baseline")
        elif marker == 0xDA:
            chosen = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
            if {c[0] for c in image.components} != set(chosen):
                raise ValueError("components in several scans, which are not read")
            for c in image.components:
                c[4], c[5] = chosen[c[0]] >> 4, chosen[c[0]] & 15
            break
    begin = at
    while True:  # to the next marker that is no restart and no stuffed byte
        at = stream.find(b"\xff", at)
        if at < 0 or at + 1 >= len(stream):
            at = len(stream)
            break
        if stream[at + 1] == 0 or 0xD0 <= stream[at + 1] <= 0xD7:
            at += 2
            continue
        break
    scan = stream[begin:at]
    if image.restart:
        raw = np.frombuffer(scan, dtype=np.uint8)
        cuts = np.flatnonzero((raw[:-1] == 0xFF) & (raw[1:] >= 0xD0) & (raw[1:] <= 0xD7))
        edges = [0, *(cuts + 2).tolist()]
        image.intervals = [scan[a:b].replace(b"\xff\x00", b"\xff") for a, b in zip(edges, [*cuts.tolist(), len(scan)])]
    else:
        image.intervals = [scan.replace(b"\xff\x00", b"\xff")]
    return image, at + 2 if stream[at : at + 2] == b"\xff\xd9" else at


def parse_all(stream: bytes) -> list[Image]:
    """The images of a stream; bytes after an image that begin no other one are left alone."""
    out, at = [], 0
    while at < len(stream) and (not out or stream[at : at + 2] == b"\xff\xd8"):
        image, at = parse(stream, at)
        out.append(image)
    if not out:
        raise ValueError("no start of image")
    return out


_LOOKUPS: dict[bytes, np.ndarray] = {}


def _lookup(table: bytes) -> np.ndarray:
    """For each 16 bits ahead: code length << 8 | symbol; 0 where no code fits."""
    key = table[1:]
    if key not in _LOOKUPS:
        if len(_LOOKUPS) > 64:
            _LOOKUPS.clear()
        out = np.zeros(1 << 16, dtype=np.int32)
        for symbol, (code, bits) in _codes(table).items():
            out[code << (16 - bits) : (code + 1) << (16 - bits)] = bits << 8 | symbol
        _LOOKUPS[key] = out
    return _LOOKUPS[key]


def decode_intervals(images: list[Image]) -> list[np.ndarray]:
    """Quantised coefficients (blocks, 64), in zigzag order and scan order, of every image.

    One symbol of every restart interval is decoded in each step, whatever image it belongs to.
    """
    tables: dict[bytes, int] = {}
    lookups: list[np.ndarray] = []

    def number(table: bytes) -> int:
        if table not in tables:
            tables[table] = len(lookups)
            lookups.append(_lookup(table))
        return tables[table]

    patterns: dict[tuple, int] = {}
    parts: list[bytes] = []
    first, count, style, totals = [], [], [], []
    at_block = 0
    for image in images:
        try:
            layout = tuple((number(image.tables[0, c[4]]), number(image.tables[1, c[5]]), i) for i in image.pattern() for c in [image.components[i]])
        except KeyError as e:
            raise ValueError(f"no Huffman table {e}") from e
        k = patterns.setdefault(layout, len(patterns))
        across, down = image.mcus()
        left, per = across * down, image.restart or across * down
        totals.append((at_block, left * len(layout)))
        for part in image.intervals:
            n = min(per, left)
            if n <= 0:
                break
            parts.append(part)
            first.append(at_block)
            count.append(n * len(layout))
            style.append(k)
            at_block += n * len(layout)
            left -= n
        if left > 0:
            raise ValueError("scan ends early")
    widest = max(map(len, patterns))
    dc_of, ac_of, comp_of = (np.zeros((len(patterns), widest), np.int64) for _ in range(3))
    size_of = np.zeros(len(patterns), np.int64)
    for layout, k in patterns.items():
        size_of[k] = len(layout)
        for i, (d, a, c) in enumerate(layout):
            dc_of[k, i], ac_of[k, i], comp_of[k, i] = d, a, c
    table = np.concatenate(lookups)
    lengths = np.array([len(p) + 8 for p in parts], dtype=np.int64)
    raw = np.frombuffer(b"".join(p + b"\xff" * 8 for p in parts), dtype=np.uint8)
    ahead = raw[:-3].astype(np.uint32) << np.uint32(24) | raw[1:-2].astype(np.uint32) << np.uint32(16) | raw[2:-1].astype(np.uint32) << np.uint32(8) | raw[3:]
    begin = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    stop_bit = (begin + lengths - 8) * 8
    out = np.zeros(at_block * 64, dtype=np.int16)
    first, count, style = np.array(first), np.array(count), np.array(style)
    pos = begin * 8
    block = np.zeros(len(parts), np.int64)
    coef = np.zeros(len(parts), np.int64)
    last = np.zeros((len(parts), 4), np.int64)
    simple = len(patterns) == 1 and widest == 1
    live = np.arange(len(parts))
    while len(live):
        p, k = pos[live], coef[live]
        is_dc = k == 0
        if simple:
            which, comp = np.where(is_dc, dc_of[0, 0], ac_of[0, 0]), 0
        else:
            s = style[live]
            inside = block[live] % size_of[s]
            which, comp = np.where(is_dc, dc_of[s, inside], ac_of[s, inside]), comp_of[s, inside]
        found = table[which << 16 | (ahead[p >> 3] >> (16 - (p & 7)).astype(np.uint32)).astype(np.int64) & 0xFFFF]
        bits, symbol = found >> 8, found & 255
        if not bits.all():
            raise ValueError("no such Huffman code")
        p = p + bits
        size = np.where(is_dc, symbol, symbol & 15).astype(np.int64)
        run = np.where(is_dc, 0, symbol >> 4)
        if (size > 15).any():
            raise ValueError("value out of range")
        low = (ahead[p >> 3].astype(np.int64) >> (32 - (p & 7) - size)) & ((1 << size) - 1)
        value = np.where((low >> np.maximum(size - 1, 0)) & 1, low, low - (1 << size) + 1)
        value[size == 0] = 0
        p = p + size
        if (p > stop_bit[live]).any():
            raise ValueError("scan ends early")
        if is_dc.any():
            rows = live[is_dc]
            c = comp if simple else comp[is_dc]
            last[rows, c] += value[is_dc]
            value[is_dc] = last[rows, c]
        end = ~is_dc & (size == 0) & (run < 15)
        k = k + run
        if (k > 63).any() and (k[~end] > 63).any():
            raise ValueError("too many coefficients")
        put = ~end
        out[((first[live] + block[live]) * 64 + k)[put]] = value[put]
        k = np.where(end, 64, k + 1)
        over = k > 63
        pos[live] = p
        block[live] += over
        k[over] = 0
        coef[live] = k
        if over.any():
            live = live[block[live] < count[live]]
    shaped = out.reshape(-1, 64)
    return [shaped[a : a + n] for a, n in totals]


def thumbnail(image: Image, coefficients: np.ndarray) -> np.ndarray:
    """Luminance from DC alone: one sample of 0..255 for each 8x8 block of the first component."""
    across, down = image.mcus()
    pattern = image.pattern()
    luma = np.array([i == 0 for i in pattern])
    dc = coefficients[:, 0].reshape(across * down, len(pattern))[:, luma].astype(np.int64)
    _, h, v, q = image.components[0][:4]
    if len(image.components) == 1:
        h = v = 1
    dc = dc.reshape(down, across, v, h).transpose(0, 2, 1, 3).reshape(down * v, across * h)
    samples = np.clip(128 + dc * int(image.quant[q][0]) // 8, 0, 255).astype(np.uint8)
    return samples[: -(-image.height // 8), : -(-image.width // 8)]


def average_hash(thumb: np.ndarray, side: int = 8) -> str:
    """16 hex digits: which cells of a side x side grid of means reach the mean of all cells."""
    rows = np.linspace(0, thumb.shape[0], side + 1)
    cols = np.linspace(0, thumb.shape[1], side + 1)
    total = np.zeros((thumb.shape[0] + 1, thumb.shape[1] + 1))
    total[1:, 1:] = thumb.astype(np.float64).cumsum(0).cumsum(1)
    r0, r1 = np.floor(rows[:-1]).astype(int), np.maximum(np.ceil(rows[1:]).astype(int), 1)
    c0, c1 = np.floor(cols[:-1]).astype(int), np.maximum(np.ceil(cols[1:]).astype(int), 1)
    sums = total[np.ix_(r1, c1)] - total[np.ix_(r0, c1)] - total[np.ix_(r1, c0)] + total[np.ix_(r0, c0)]
    means = sums / np.outer(r1 - r0, c1 - c0)
    return np.packbits((means >= means.mean()).reshape(-1)).tobytes().hex()


def payload_of(coefficients: np.ndarray) -> bytes:
    """The bytes that write_payloads() put into these coefficients."""
    out = np.empty(coefficients.shape, dtype=np.uint8)
    out[:, 0] = coefficients[:, 0] + 128
    out[:, 1:] = coefficients[:, 1:] - 256
    return out.tobytes()


def _groups(sizes: list[int]) -> list[tuple[int, int]]:
    out, begin, size = [], 0, 0
    for i, n in enumerate(sizes):
        if size and size + n > BATCH_BYTES:
            out.append((begin, i))
            begin, size = i, 0
        size += n
    if begin < len(sizes):
        out.append((begin, len(sizes)))
    return out


#: What a damaged stream may raise.
DAMAGED = (ValueError, struct.error, IndexError, KeyError)


def _decoded(streams: list[bytes]) -> list[tuple[list[Image], list[np.ndarray]] | str]:
    """Images and coefficients of each stream, or what is wrong with it."""
    out: list = []
    for stream in streams:
        try:
            out.append(parse_all(stream))
        except DAMAGED as e:
            out.append(str(e) or "damaged")
    good = [x for x in out if not isinstance(x, str)]
    try:
        found = iter(decode_intervals([i for x in good for i in x]) if good else [])
        return [x if isinstance(x, str) else (x, [next(found) for _ in x]) for x in out]
    except DAMAGED:  # a damaged scan among them: one by one
        made = []
        for x in out:
            try:
                made.append(x if isinstance(x, str) else (x, decode_intervals(x)))
            except DAMAGED as e:
                made.append(str(e) or "damaged")
        return made


def _feature(images: list[Image], coefficients: list[np.ndarray]) -> tuple[int, int, str, str]:
    """Width, height (of all images, one below the other), thumbnail hash and digest of the thumbnail samples."""
    thumbs = [thumbnail(i, c) for i, c in zip(images, coefficients)]
    wide = max(t.shape[1] for t in thumbs)
    whole = np.concatenate([np.pad(t, ((0, 0), (0, wide - t.shape[1]))) for t in thumbs]) if len(thumbs) > 1 else thumbs[0]
    return max(i.width for i in images), sum(i.height for i in images), average_hash(whole), hashlib.md5(whole.tobytes()).hexdigest()[:16]


def write_media(df: DataFrame, text: str = "text", out: str = "media") -> DataFrame:
    """df with a binary column: the text's UTF-8 bytes, padded, in JPEG streams."""
    import pyarrow as pa

    rest = [c for c in df.columns if c != out]
    base = df.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{text}`").cast("string").alias(unused("__in", rest)))
    schema = df.select(*[F.col(f"`{c}`") for c in rest]).schema.add(out, "binary")

    def run(batches):
        for batch in batches:
            payloads = [pad_payload((x or "").encode()) for x in batch.column(len(rest)).to_pylist()]
            for a, b in _groups([len(p) for p in payloads]):
                yield pa.RecordBatch.from_arrays([*[batch.column(i).slice(a, b - a) for i in range(len(rest))], pa.array(write_payloads(payloads[a:b]), pa.binary())], names=[*rest, out])

    return base.mapInArrow(run, schema)


def read_images(df: DataFrame, media: str = "media", payload: bool = False) -> DataFrame:
    """df with width, height, thumb_hash, thumb_digest and error of the JPEG streams in a binary column.

    With payload set, also the bytes that write_media() stored, in `payload`. A null stream gives nulls.
    """
    import pyarrow as pa

    made = ["width", "height", "thumb_hash", "thumb_digest", "error", *["payload"] * payload]
    rest = [c for c in df.columns if c not in made]
    schema = df.select(*[F.col(f"`{c}`") for c in rest]).schema
    for name, kind in zip(made, ("integer", "integer", "string", "string", "string", "binary")):
        schema = schema.add(name, kind)
    types = [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.binary()]
    base = df.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{media}`").cast("binary").alias(unused("__in", rest)))

    def run(batches):
        for batch in batches:
            streams = batch.column(len(rest)).to_pylist()
            for a, b in _groups([len(s or b"") for s in streams]):
                rows = []
                some = [s for s in streams[a:b] if s is not None]
                found = iter(_decoded(some))
                for s in streams[a:b]:
                    x = next(found) if s is not None else None
                    try:
                        row = (None, None, None, None, x, None) if x is None or isinstance(x, str) else (*_feature(*x), None, b"".join(map(payload_of, x[1])) if payload else None)
                    except DAMAGED as e:  # such as a scan without its quantisation table
                        row = (None, None, None, None, f"damaged: {e}", None)
                    rows.append(row)
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([*[batch.column(i).slice(a, b - a) for i in range(len(rest))], *[pa.array(cols[i], types[i]) for i in range(len(made))]], names=[*rest, *made])

    return base.mapInArrow(run, schema)


def digests(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Store each whole text, read the stored bytes back, and return sizes, digests and features."""
    import pyarrow as pa

    stored = write_media(df.select(F.col(f"`{key}`").alias("key"), F.octet_length(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))).cast("long").alias("n_bytes"), F.col(f"`{text}`").cast("string").alias("text")))
    names = [key, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    schema = df.select(F.col(f"`{key}`")).schema
    for name, kind in zip(names[1:], ("long", "long", "string", "long", "long", "string", "string")):
        schema = schema.add(name, kind)

    def run(batches):
        for batch in batches:
            streams = batch.column(2).to_pylist()
            for a, b in _groups([len(s) for s in streams]):
                rows = []
                for stream, x in zip(streams[a:b], _decoded(streams[a:b])):
                    if isinstance(x, str):
                        raise ValueError(f"a stored stream can't be read back: {x}")
                    payload = b"".join(map(payload_of, x[1]))
                    width, height, hashed, digest = _feature(*x)
                    rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(stream), hashlib.sha256(stream).hexdigest(), f"{width}x{height}:{hashed}:{digest}"))
                cols = list(zip(*rows))
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), *[pa.array(c, k) for c, k in zip(cols, kinds)]], names=names)

    return stored.select("key", "n_bytes", "media").mapInArrow(run, schema)


def op7_jpeg_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query 7: every document stored as JPEG coefficients and read back."""
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
