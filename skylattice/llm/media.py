"""Media columns: AVI motion-JPEG clips whose quantised coefficients hold bytes, and shot detection over them.

A frame is a baseline JPEG of one grey component. Each 8 by 8 block holds 64 payload bytes as its 64 quantised
coefficients in coding order, all of magnitude category 8, which has exactly 256 values. The Huffman tables hold that one
symbol, a single bit, and every block is a restart interval, so a block is always 64 * 9 bits and its values don't depend
on its neighbours. Nothing is lost: the format's unit here is the quantised coefficient.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import fresh, text_slices, tidy, utf8

BLOCK = 64
#: Blocks in a full frame, blocks in a row, frames a second.
FRAME_BLOCKS, ROW_BLOCKS, RATE = 16, 4, 25
#: Bins of a frame's histogram; frames that the adaptive threshold looks back on; its factor; its floor in shares of pixels.
BINS, LOOK_BACK, FACTOR, FLOOR = 16, 8, 1.5, 0.10

# Fixed values of the JPEG and RIFF formats: markers, and the order in which coefficients are coded.
SOI, EOI, DQT, SOF0, DHT, DRI, SOS, RST0 = 0xD8, 0xD9, 0xDB, 0xC0, 0xC4, 0xDD, 0xDA, 0xD0


def _zigzag() -> np.ndarray:
    """Place in the 8 by 8 block of each coefficient in coding order: along the diagonals, turning at each."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (sum(x), x[0] if sum(x) % 2 else x[1]))
    return np.array([8 * r + c for r, c in cells])


ZIGZAG = _zigzag()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _jpeg_head(width: int, height: int) -> bytes:
    one_symbol = bytes([1] + [0] * 15) + b"\x08"
    return (
        bytes([0xFF, SOI])
        + _segment(DQT, b"\x00" + b"\x01" * 64)
        + _segment(SOF0, struct.pack(">BHHBBBB", 8, height, width, 1, 1, 0x11, 0))
        + _segment(DHT, b"\x00" + one_symbol)
        + _segment(DHT, b"\x10" + one_symbol)
        + _segment(DRI, struct.pack(">H", 1))
        + _segment(SOS, bytes([1, 1, 0x00, 0, 63, 0]))
    )


def encode_blocks(payload: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entropy-coded bytes of all blocks one after another with 0xFF stuffed, and each block's offset."""
    coded = np.zeros((len(payload) // 8, 8, 9), np.uint8)
    coded[:, :, 1:] = np.unpackbits(payload.reshape(-1, 8, 1), axis=2)
    flat = np.packbits(coded.reshape(-1, 72), axis=1).ravel()
    full = flat == 0xFF
    stuffed = np.insert(flat, np.flatnonzero(full) + 1, 0)
    starts = np.concatenate([[0], np.cumsum(72 + full.reshape(-1, 72).sum(axis=1))])
    return stuffed, starts


def encode_clip(payload: np.ndarray) -> bytes:
    """An AVI file with one motion-JPEG stream whose blocks hold payload, a multiple of 64 bytes."""
    stuffed, at = encode_blocks(payload)
    data, blocks = stuffed.tobytes(), len(at) - 1
    frames = []
    k = 0
    while k < blocks:
        left = min(FRAME_BLOCKS, blocks - k)
        across = min(ROW_BLOCKS, left)
        take = left // across * across  # whole rows: what remains gets a frame of its own
        parts = [_jpeg_head(8 * across, 8 * (take // across))]
        for j in range(take):
            parts.append(data[at[k + j] : at[k + j + 1]])
            if j + 1 < take:
                parts.append(bytes([0xFF, RST0 + j % 8]))
        parts.append(bytes([0xFF, EOI]))
        frame = b"".join(parts)
        frames.append(frame + b"\x00" * (len(frame) % 2))
        k += take
    movi, index, place = [b"movi"], [], 4
    for f in frames:
        movi.append(b"00dc" + struct.pack("<I", len(f)) + f)
        index.append(b"00dc" + struct.pack("<III", 0x10, place, len(f)))
        place += 8 + len(f)
    width, height, n = 8 * ROW_BLOCKS, 8 * (FRAME_BLOCKS // ROW_BLOCKS), len(frames)
    most = max(map(len, frames))
    avih = struct.pack("<14I", 1_000_000 // RATE, most * RATE, 0, 0x10, n, 0, 1, most, width, height, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, 1, RATE, 0, n, most, 10_000, 0, 0, 0, width, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 8, b"MJPG", width * height, 0, 0, 0, 0)
    chunk = lambda name, body: name + struct.pack("<I", len(body)) + body
    head = chunk(b"LIST", b"hdrl" + chunk(b"avih", avih) + chunk(b"LIST", b"strl" + chunk(b"strh", strh) + chunk(b"strf", strf)))
    return chunk(b"RIFF", b"AVI " + head + chunk(b"LIST", b"".join(movi)) + chunk(b"idx1", b"".join(index)))


def frame_places(clip: bytes) -> tuple[list[tuple[int, int]], float]:
    """Place and size of each video frame by the RIFF index, and the frames a second."""
    if clip[:4] != b"RIFF" or clip[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    end = 8 + struct.unpack_from("<I", clip, 4)[0]
    at, movi, places, rate = 12, None, [], float(RATE)
    while at + 8 <= end:
        name, size = clip[at : at + 4], struct.unpack_from("<I", clip, at + 4)[0]
        if name == b"LIST" and clip[at + 8 : at + 12] == b"movi":
            movi = at + 8
        elif name == b"LIST" and clip[at + 8 : at + 12] == b"hdrl":
            rate = 1e6 / struct.unpack_from("<I", clip, at + 20)[0]
        elif name == b"idx1":
            entries = np.frombuffer(clip, np.dtype([("id", "S4"), ("flags", "<u4"), ("at", "<u4"), ("size", "<u4")]), size // 16, at + 8)
            places = [(movi + int(e["at"]) + 8, int(e["size"])) for e in entries if e["id"] == b"00dc"]
        at += 8 + size + size % 2
    return places, rate


@dataclass
class Scan:
    """What a frame's headers say: blocks, quantisers in coding order, Huffman codes, restart interval, coded bytes."""

    blocks: int
    quantisers: np.ndarray
    dc: dict[tuple[int, int], int]
    ac: dict[tuple[int, int], int]
    interval: int
    coded: np.ndarray

    @property
    def plain(self) -> bool:
        """Whether it is coded as encode_clip does: one symbol, category 8, of one bit, and each block by itself."""
        return self.dc == self.ac == {(1, 0): 8} and self.interval == 1


def read_frame(clip: bytes, at: int, size: int) -> Scan:
    """The headers of one JPEG frame. What isn't baseline with one grey component is an error, never junk."""
    end, p = at + size, at + 2
    if clip[at : at + 2] != bytes([0xFF, SOI]):
        raise ValueError("a frame doesn't begin as a JPEG")
    tables: dict[int, dict[tuple[int, int], int]] = {}
    quantisers, blocks, interval, used = {}, None, 0, 0
    while True:
        if p + 4 > end or clip[p] != 0xFF:
            raise ValueError("a frame ends within its headers")
        marker, n = clip[p + 1], struct.unpack_from(">H", clip, p + 2)[0]
        body = clip[p + 4 : p + 2 + n]
        p += 2 + n
        if marker == DQT:
            while body:
                wide = body[0] >> 4
                quantisers[body[0] & 15] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, 1).astype(np.float64)
                body = body[1 + 64 * (1 + wide) :]
        elif marker == DHT:
            while body:
                counts, code, place, found = body[1:17], 0, 17, {}
                for bits, many in enumerate(counts, 1):
                    for _ in range(many):
                        found[bits, code] = body[place]
                        code, place = code + 1, place + 1
                    code <<= 1
                tables[body[0]] = found
                body = body[place:]
        elif marker == DRI:
            interval = struct.unpack(">H", body)[0]
        elif marker == SOF0:
            precision, height, width, parts, _, sampling, used = struct.unpack(">BHHBBBB", body[:9])
            if (precision, parts, sampling) != (8, 1, 0x11):
                raise ValueError("only frames of one grey component of 8 bits are supported")
            blocks = -(-height // 8) * -(-width // 8)
        elif 0xC0 < marker <= 0xCF and marker != 0xCC:
            raise ValueError(f"JPEG process {marker - 0xC0} is not supported, only baseline")
        elif marker == SOS:
            if blocks is None or used not in quantisers or body[0] != 1:
                raise ValueError("a scan without its frame header or quantisers")
            dc, ac = tables.get(body[2] >> 4), tables.get(0x10 | body[2] & 15)
            if dc is None or ac is None:
                raise ValueError("a scan without its Huffman tables")
            return Scan(blocks, quantisers[used], dc, ac, interval, np.frombuffer(clip, np.uint8, end - p, p))


def _segments(coded: np.ndarray) -> list[bytes]:
    """The coded bytes between restart markers, stuffed zeros taken out, up to the end of the image."""
    raw, out, begin, i = coded.tobytes(), [], 0, -1
    while (i := raw.find(b"\xff", i + 1)) >= 0 and i + 1 < len(raw):
        mark = raw[i + 1]
        if RST0 <= mark < RST0 + 8 or mark == EOI:
            out.append(raw[begin:i].replace(b"\xff\x00", b"\xff"))
            begin = i + 2
            if mark == EOI:
                return out
        i += 1
    raise ValueError("a frame without its end")


def decode_scan(scan: Scan) -> np.ndarray:
    """Quantised coefficients (blocks, 64) in coding order, by the scan's own Huffman tables: any baseline grey frame."""
    out, k = np.zeros((scan.blocks, 64), np.int64), 0
    for segment in _segments(scan.coded):
        bits, p, before = "".join([f"{b:08b}" for b in segment]), 0, 0

        def symbol(table):
            nonlocal p
            for n in range(1, 17):
                if (found := table.get((n, int(bits[p : p + n] or "0", 2)))) is not None and p + n <= len(bits):  # noqa: B023
                    p += n
                    return found
            raise ValueError("a code that is in no Huffman table")

        def value(n):
            nonlocal p
            if not n:
                return 0
            if p + n > len(bits):  # noqa: B023
                raise ValueError("a frame ends within a coefficient")
            x = int(bits[p : p + n], 2)  # noqa: B023
            p += n
            return x if x >> (n - 1) else x - (1 << n) + 1

        for _ in range(scan.interval or scan.blocks):
            if k == scan.blocks:
                break
            before += value(symbol(scan.dc))
            out[k, 0], i = before, 1
            while i < 64:
                run, n = divmod(symbol(scan.ac), 16)
                if not n and run != 15:
                    break
                i += run
                if i > 63:
                    raise ValueError("a block of more than 64 coefficients")
                out[k, i] = value(n)
                i += 1
            k += 1
    if k < scan.blocks:
        raise ValueError("a frame of fewer blocks than its size says")
    return out


def _plain_codes(scans: list[Scan]) -> np.ndarray:
    """Payload codes (blocks, 64) of scans coded as encode_clip does, all at once."""
    data = np.concatenate([s.coded for s in scans])
    # after 0xFF comes a stuffed zero, which goes, or a marker, which goes with it
    full = np.flatnonzero(data[:-1] == 0xFF)
    after = data[full + 1]
    keep = np.ones(len(data), bool)
    keep[full + 1] = False
    keep[full[after != 0]] = False
    for n in np.cumsum([len(s.coded) for s in scans]):  # the byte that evens a frame's length
        tail = data[n - 1] == 0 and data[n - 3] == 0xFF and data[n - 2] == EOI
        keep[n - 1] &= not tail
    coded = data[keep]
    if len(coded) != 72 * sum(s.blocks for s in scans):
        raise ValueError("frames of more or fewer bytes than their size says")
    bits = np.unpackbits(coded.reshape(-1, 72), axis=1).reshape(-1, 8, 9)
    return np.packbits(bits[:, :, 1:], axis=2).reshape(-1, BLOCK)


def decode_frames(clip: bytes, places: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Quantised coefficients of all blocks (blocks, 64), how many blocks each frame has, and each frame's quantisers."""
    scans = [read_frame(clip, *place) for place in places]
    if not scans:
        raise ValueError("a clip without frames")
    if all(s.plain for s in scans):
        value = _plain_codes(scans).astype(np.int64)
        value[value < 128] -= 255  # the codes of category 8: those under 128 stand for negative numbers
    else:
        value = np.concatenate([decode_scan(s) for s in scans])
    return value, np.array([s.blocks for s in scans]), np.stack([s.quantisers for s in scans])


def payload_of(value: np.ndarray) -> np.ndarray:
    """The bytes that coefficients of magnitude category 8 stand for; other coefficients hold no payload."""
    if ((np.abs(value) < 128) | (np.abs(value) > 255)).any():
        raise ValueError("the clip holds pictures, not payload")
    return np.where(value < 0, value + 255, value).astype(np.uint8).reshape(-1)


def _cosines() -> np.ndarray:
    """The inverse cosine transform in whole numbers, 2**12 to 1: products and sums of them are exact in doubles."""
    k, x = np.meshgrid(np.arange(8), np.arange(8), indexing="ij")
    scale = np.where(k == 0, np.sqrt(1 / 8), np.sqrt(1 / 4))
    return np.rint(4096 * scale * np.cos((2 * x + 1) * k * np.pi / 16))


COSINES = _cosines()


def pixels(value: np.ndarray) -> np.ndarray:
    """Grey values (blocks, 64) of coefficients in coding order."""
    grid = np.zeros(value.shape)
    grid[:, ZIGZAG] = value
    grid = grid.reshape(-1, 8, 8)
    out = COSINES.T @ (grid @ COSINES)
    return np.clip(np.floor(out / 4096.0**2 + 128.5), 0, 255).astype(np.uint8).reshape(-1, 64)


def shots(histograms: np.ndarray) -> list[int]:
    """First frames of shots. A cut is where two frames' histograms differ by more than the floor and than FACTOR times
    the mean difference of the frames just before, since the last cut at most."""
    starts, n = [0], len(histograms)
    share = histograms / np.maximum(histograms.sum(axis=1, keepdims=True), 1)
    differ = np.abs(np.diff(share, axis=0)).sum(axis=1) / 2
    for k in range(1, n):
        past = differ[max(starts[-1], k - 1 - LOOK_BACK) : k - 1]
        if len(past) and differ[k - 1] > max(FLOOR, FACTOR * past.mean()):
            starts.append(k)
    return starts


def clip_of_text(text: bytes | np.ndarray) -> bytes:
    size = len(text)
    payload = np.zeros((size // BLOCK + (size % BLOCK > 0 or size == 0)) * BLOCK, np.uint8)
    payload[:size] = np.frombuffer(text, np.uint8) if isinstance(text, bytes) else text
    return encode_clip(payload)


def read_clip(clip: bytes) -> tuple[np.ndarray, np.ndarray, list[int], float]:
    """Coefficients of all blocks, histograms of frames, first frames of shots, frames a second."""
    places, rate = frame_places(clip)
    value, counts, quantisers = decode_frames(clip, places)
    frame = np.repeat(np.arange(len(counts)), counts)
    scaled = value if (quantisers == 1).all() else value * quantisers[frame]
    levels = pixels(scaled) // (256 // BINS)
    histograms = np.bincount((frame[:, None] * BINS + levels).ravel(), minlength=len(counts) * BINS).reshape(-1, BINS)
    return value, histograms, shots(histograms), rate


def store_clips(docs: DataFrame, *, text: str = "text", media: str = "media") -> DataFrame:
    """docs with a binary column `media`: the text's UTF-8 bytes, zeros up to a positive multiple of 64, as a clip.

    A null text is stored as an empty one, and an empty one as 64 zeros; a very long one as a clip of as many frames as it
    needs. Equal texts give equal clips. Other columns, repeated rows and the number of rows stay as they are, an empty
    table stays empty, and a column already named like `media` is replaced.
    """
    kept = [c for c in docs.columns if c.lower() != media.lower() or c == text]
    hold = text if text in kept else fresh(docs, "_text")

    def run(batches):
        for batch in text_slices(batches, hold):
            data, at = utf8(batch.column(hold))
            clips = pa.array([clip_of_text(data[at[i] : at[i + 1]]) for i in range(batch.num_rows)], pa.binary())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], clips], names=[*kept, media])

    return docs.select(*kept).mapInArrow(tidy(run), ", ".join([f"`{c}` {t}" for c, t in docs.select(*kept).dtypes] + [f"`{media}` binary"]))


def clip_digests(clips: DataFrame, *, media: str = "media", drop: tuple[str, ...] = ("text",)) -> DataFrame:
    """What the stored bytes give when read back: payload and media digests, and a feature string.

    feature: frames, then each shot as first-last frame with its seconds and most frequent histogram bin. A null clip
    gives nulls, and one that isn't a baseline grey motion-JPEG AVI, or holds pictures rather than payload, is an error.
    Clips of any length are read whole; repeated rows give repeated rows, an empty table none. Columns named like the new
    ones are replaced.
    """
    added = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
    kept = [c for c in clips.columns if c not in (media, *drop) and c.lower() not in added]
    new = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def run(batches):
        for batch in text_slices(batches, media):
            rows = [_digest(clip) for clip in batch.column(media).to_pylist()]
            columns = list(zip(*rows, strict=True))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *[pa.array(x, k) for x, k in zip(columns, kinds, strict=True)]], names=[*kept, *[x.split()[0] for x in new.split(", ")]])

    return clips.select(*kept, media).mapInArrow(tidy(run), ", ".join([f"`{c}` {t}" for c, t in clips.select(*kept).dtypes] + [new]))


def _digest(clip: bytes | None) -> tuple:
    if clip is None:
        return (None,) * 6
    value, histograms, starts, rate = read_clip(clip)
    raw = payload_of(value).tobytes()
    parts = []
    for a, b in zip(starts, [*starts[1:], len(histograms)], strict=True):
        parts.append(f"{a}-{b - 1}@{a / rate:.2f}-{b / rate:.2f}s:{int(histograms[a:b].sum(axis=0).argmax())}")
    return len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-64:]), len(clip), hashlib.sha256(clip).hexdigest(), f"frames={len(histograms)};shots={len(starts)};" + ";".join(parts)


def clip_shots(clips: DataFrame, *, key: str = "doc_id", media: str = "media") -> DataFrame:
    """One row for each shot of each clip: key, shot, first_frame, last_frame, start_s, end_s. A null clip and an empty table give none; a
    repeated clip gives its shots again, one of many frames is read whole, and other columns are left out. Of equal histogram
    differences each that is above its limit begins a shot."""
    kind = dict(clips.dtypes)[key]

    def run(batches):
        for batch in text_slices(batches, media):
            rows = []
            for i, clip in enumerate(batch.column(media).to_pylist()):
                if clip is not None:
                    _, histograms, starts, rate = read_clip(clip)
                    rows += [(i, s, a, b - 1, a / rate, b / rate) for s, (a, b) in enumerate(zip(starts, [*starts[1:], len(histograms)], strict=True))]
            if rows:
                row, *rest = zip(*rows, strict=True)
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(row, pa.int32())), *[pa.array(x, k) for x, k in zip(rest, kinds, strict=True)]], names=[key, "shot", "first_frame", "last_frame", "start_s", "end_s"])

    return clips.select(key, media).mapInArrow(tidy(run), f"`{key}` {kind}, shot int, first_frame long, last_frame long, start_s double, end_s double")
