import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from skylattice.llm.common import window_hashes
from skylattice.llm.fingerprints import KEPT, K, S, fingerprint_edits, fingerprints, likeness, syncmers
from skylattice.llm.media import clip_digests, clip_of_text, clip_shots, decode_frames, decode_scan, encode_clip, frame_places, payload_of, pixels, read_clip, read_frame, store_clips

from .samples import documents, empty


def test_clip_round_trip():
    r = np.random.default_rng(2)
    for n in (1, 2, 3, 5, 15, 16, 17, 33, 100):
        for payload in (r.integers(0, 256, 64 * n, dtype=np.uint8), np.full(64 * n, 255, np.uint8), np.zeros(64 * n, np.uint8)):
            clip = encode_clip(payload)
            places, rate = frame_places(clip)
            value, counts, _ = decode_frames(clip, places)
            assert rate == 25 and counts.sum() == n and (payload_of(value) == payload).all()
            if n < 20:  # the reader for any baseline grey frame says the same
                assert (np.concatenate([decode_scan(read_frame(clip, *p)) for p in places]) == value).all()
            for at, size in places:
                assert clip[at : at + 2] == b"\xff\xd8" and clip[at : at + size].rstrip(b"\0")[-2:] == b"\xff\xd9"


def test_pixels_follow_the_transform():
    codes = np.random.default_rng(3).integers(0, 256, (5, 64), dtype=np.uint8)
    zigzag = [0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5]
    values = np.where(codes < 128, codes.astype(int) - 255, codes)
    for value, got in zip(values, pixels(values), strict=True):
        from skylattice.llm.media import ZIGZAG

        assert ZIGZAG[:16].tolist() == zigzag
        grid = np.zeros(64)
        grid[ZIGZAG] = value
        k, x = np.meshgrid(np.arange(8), np.arange(8), indexing="ij")
        c = np.where(k == 0, np.sqrt(1 / 8), 0.5) * np.cos((2 * x + 1) * k * np.pi / 16)
        want = np.clip(c.T @ grid.reshape(8, 8) @ c + 128, 0, 255)
        assert np.abs(got.reshape(8, 8) - want).max() < 1.5


def jpeg_segment(marker, body):
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def test_other_peoples_frames():
    """Two blocks with other Huffman tables, quantisers, a difference in the first coefficient and a run of zeros."""
    dc, ac = {2: "0", 0: "10"}, {0x00: "0", 0x01: "10", 0x21: "110"}
    table = lambda kind, codes: bytes([kind]) + bytes([sum(len(c) == n for c in codes.values()) for n in range(1, 17)]) + bytes(codes)
    bits = dc[2] + "11" + ac[0x01] + "0" + ac[0x21] + "1" + ac[0x00] + dc[0] + ac[0x00]
    scan = int(bits.ljust(-(-len(bits) // 8) * 8, "1"), 2).to_bytes(-(-len(bits) // 8), "big").replace(b"\xff", b"\xff\x00")
    parts = [jpeg_segment(0xDB, b"\x00" + bytes(range(1, 65))), jpeg_segment(0xC0, struct.pack(">BHHBBBB", 8, 8, 16, 1, 1, 0x11, 0)), jpeg_segment(0xC4, table(0, dc)), jpeg_segment(0xC4, table(0x10, ac)), jpeg_segment(0xDA, bytes([1, 1, 0, 0, 63, 0]))]
    frame = b"\xff\xd8" + b"".join(parts) + scan + b"\xff\xd9"
    found = read_frame(frame, 0, len(frame))
    want = np.zeros((2, 64), int)
    want[:, 0], want[0, 1], want[0, 4] = 3, -1, 1
    assert (decode_scan(found) == want).all() and found.quantisers.tolist() == list(range(1, 65)) and not found.plain
    with pytest.raises(ValueError, match="payload"):
        payload_of(want)
    for marker, error in ((0xC2, "baseline"), (0xC9, "baseline")):
        with pytest.raises(ValueError, match=error):
            other = frame.replace(b"\xff\xc0", bytes([0xFF, marker]))
            read_frame(other, 0, len(other))
    colour = frame.replace(struct.pack(">BHHBB", 8, 8, 16, 1, 1), struct.pack(">BHHBB", 8, 8, 16, 3, 1))
    with pytest.raises(ValueError, match="grey"):
        read_frame(colour, 0, len(colour))
    with pytest.raises(ValueError):
        decode_scan(read_frame(frame[:-3], 0, len(frame) - 3))


def test_shots_are_found():
    a, b = np.full(64 * 16 * 6, 40, np.uint8), np.full(64 * 16 * 6, 200, np.uint8)
    _, _, starts, _ = read_clip(encode_clip(np.concatenate([a, b, a])))
    assert starts == [0, 6, 12]


def test_media_columns(spark):
    docs = documents(spark).withColumnRenamed("size", "media")
    clips = store_clips(docs)
    got = clip_digests(clips.select("doc_id", "text", "media")).collect()
    want = []
    for r in docs.collect():
        raw = (r["text"] or "").encode()
        raw += bytes(-len(raw) % 64 or (64 if not raw else 0))
        clip = clip_of_text((r["text"] or "").encode())
        want.append((str(r["doc_id"]), len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-64:]), len(clip), hashlib.sha256(clip).hexdigest()))
    keys = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256")
    assert sorted((str(r["doc_id"]), *(r[k] for k in keys)) for r in got) == sorted(want)
    shots = clip_shots(clips).collect()
    assert {r["doc_id"] for r in shots} == {r["doc_id"] for r in docs.collect()}
    assert store_clips(empty(spark)).count() == 0
    nulls = clip_digests(spark.createDataFrame([(1, None, "x")], "doc_id long, media binary, feature string")).collect()
    assert [r.asDict() for r in nulls] == [{"doc_id": 1, **dict.fromkeys((*keys, "feature"))}]


def by_hand(text, k, s):
    """Closed syncmers by the definition, with the same inner hashes."""
    points = np.array([ord(c) for c in text], np.uint32)
    inner = window_hashes(points, s).tolist()
    out = []
    for i in range(len(text) - k + 1):
        part = inner[i : i + k - s + 1]
        if min(part) in (part[0], part[-1]):
            out.append(i)
    return out


def points_of(texts):
    return np.array([ord(c) for t in texts for c in t], np.uint32), np.concatenate([[0], np.cumsum([len(t) for t in texts])])


def anchors(text):
    """(k-mer, how often it came before) of every closed syncmer of the text with its edges, and the place."""
    points = np.concatenate([np.full(K - 1, 0x110000, np.uint32), points_of([text])[0], np.full(K - 1, 0x110000, np.uint32)])
    inner, seen, out = window_hashes(points, S).tolist(), {}, {}
    for i in range(len(points) - K + 1):
        part, own = inner[i : i + K - S + 1], tuple(points[i : i + K].tolist())
        if min(part) in (part[0], part[-1]):
            out[own, seen.get(own, 0)] = i
            seen[own] = seen.get(own, 0) + 1
    return out


def likeness_by_hand(a, b):
    """Of short texts, all of whose anchors a fingerprint keeps."""
    one, two = anchors(a), anchors(b)
    assert max(len(one), len(two)) <= KEPT
    pairs = sorted((one[x], two[x]) for x in one.keys() & two.keys())
    best = []
    for i, (_, y) in enumerate(pairs):
        best.append(1 + max([best[j] for j in range(i) if pairs[j][1] < y], default=0))
    j = max(best, default=0) / len(one.keys() | two.keys())
    return 2 * j / (1 + j)


def test_syncmers_and_context():
    r = random.Random(7)
    texts = ["".join(r.choice("abé ") for _ in range(n)) for n in (0, 3, 13, 14, 15, 80, 300, 5, 64)]
    points, at = points_of(texts)
    place, _ = syncmers(points, at, K, S)
    assert place.tolist() == [int(at[j]) + i for j, t in enumerate(texts) if len(t) >= K for i in by_hand(t, K, S)]
    together = fingerprints(points, at)
    for j, t in enumerate(texts):
        assert fingerprints(*points_of([t])) == [together[j]]
    assert together[0] == "" and all(together[1:])


def test_likeness_against_all_anchors():
    r = random.Random(8)
    base = "".join(r.choice("abcde fgh") for _ in range(200))
    texts = [base, base[:63], base[:64], base[:150] + "xyz" + base[150:], base[100:] + base[:100], "a", "ab", "word " * 30, "word " * 22, base[:3], "".join(r.choice("klm") for _ in range(90))]
    prints = fingerprints(*points_of(texts))
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            assert likeness(prints[i], prints[j]) == (1.0 if a == b else likeness_by_hand(a, b)), (i, j)
    assert likeness(prints[1], prints[2]) > 0.8 and likeness(prints[7], prints[8]) > 0.7 and likeness(prints[0], prints[10]) == 0
    long = "".join(r.choice("abcdefghij ") for _ in range(400_000))
    a, b = fingerprints(*points_of([long, "k" * 50 + long[:300_000]]))
    assert abs(likeness(a, b) - 6 / 7) < 0.12


def test_fingerprint_query(spark):
    docs = documents(spark, 200)
    got = fingerprint_edits(docs).collect()
    rows = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    assert len(got) == len(rows)
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    want = set()
    for i, (key, text) in enumerate(ordered):
        following = ordered[(i + 1) % len(ordered)][1]
        m = len(text) // 4
        want.add((key, len(text), hashlib.sha256((text[: len(text) - m] + following[:m]).encode()).hexdigest()))
    assert {(r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got} == want
    for r in got:
        assert r["near_edited"] == likeness(r["fingerprint"], r["edited_fingerprint"])
        if r["n_chars"] > 400:
            assert r["near_edited"] > 0.55
    assert fingerprint_edits(empty(spark)).count() == 0
    one = fingerprint_edits(docs.where("doc_id = 3")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
