import hashlib
import zlib

import numpy as np
import pytest

from riskloom.llm import media


def test_documents_round_trip(awkward):
    texts = {(r.doc_id, r.text) for r in awkward.collect()}
    rows = media.documents_as_media(awkward).collect()
    assert len(rows) == awkward.count()
    by_id = {}
    for r in rows:
        by_id.setdefault(r.doc_id, r)
    for doc_id, text in texts:
        data = (text or "").encode()
        payload = data + b" " * ((-len(data)) % 192 if data else 192)
        r = by_id[doc_id]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(data), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-16:])
    assert by_id[1].feature == by_id[8].feature and by_id[1].media_sha256 == by_id[8].media_sha256


def test_empty_table(nothing):
    assert media.documents_as_media(nothing).count() == 0


@pytest.mark.parametrize("row_filter", [0, 1, 2, None])
@pytest.mark.parametrize("colour", [0, 2, 4, 6])
def test_filters_round_trip(row_filter, colour):
    samples = np.random.default_rng(1).integers(0, 256, 7 * 5 * media.CHANNELS[colour], np.uint8).tobytes()
    image = media.encode_png(samples, 5, colour, row_filter=row_filter)
    assert media.decode_png(image).tobytes() == samples


def slow_unfilter(lines, pixel):
    """The format's own rule, byte by byte."""
    out = []
    for y, line in enumerate(lines.tolist()):
        kind, row = line[0], line[1:]
        for x in range(len(row)):
            a = row[x - pixel] if x >= pixel else 0
            b = out[y - 1][x] if y else 0
            c = out[y - 1][x - pixel] if y and x >= pixel else 0
            p = a + b - c
            paeth = min((abs(p - v), i, v) for i, v in enumerate((a, b, c)))[2]
            row[x] = (row[x] + [0, a, b, (a + b) // 2, paeth][kind]) % 256
        out.append(row)
    return np.array(out, np.uint8)


def test_mixed_filters_match_the_rule():
    lines = np.random.default_rng(2).integers(0, 256, (25, 1 + 12), np.uint8)
    lines[:, 0] = np.arange(25) % 5
    assert (media._unfilter(lines, 3) == slow_unfilter(lines, 3)).all()


def test_damage_is_found():
    image = media.encode_png(b"x" * 192)
    for damaged in (image[:-1], image[1:], image[:40] + bytes([image[40] ^ 1]) + image[41:], b""):
        with pytest.raises(media.BadImage):
            media.decode_png(damaged)


def test_hash_moves_little_with_small_changes():
    base = np.kron(np.random.default_rng(4).integers(0, 256, (8, 16)), np.ones((8, 12))).astype(np.uint8)
    near = base.copy()
    near[3, 5] ^= 8
    bits = lambda x: int(media.cosine_hash(x.reshape(64, 64, 3)), 16)
    assert bin(bits(base) ^ bits(near)).count("1") <= 8


def direct_hash(samples):
    """The same 64 bits by sums of cosines in doubles: grey values averaged by area into cells, term by term."""
    grey = samples.sum(axis=2).astype(float)

    def averaged(values):
        n = len(values)
        out = np.zeros((media.SIDE, *values.shape[1:]))
        for i in range(n):
            for c in range(media.SIDE):
                out[c] += values[i] * max(0.0, min((i + 1) * media.SIDE / n, c + 1) - max(i * media.SIDE / n, c))
        return out

    cells = averaged(averaged(grey).T).T
    terms = np.zeros((media.LOW, media.LOW))
    for u in range(media.LOW):
        for v in range(media.LOW):
            a = np.cos(np.pi * u * (2 * np.arange(media.SIDE) + 1) / (2 * media.SIDE))
            b = np.cos(np.pi * v * (2 * np.arange(media.SIDE) + 1) / (2 * media.SIDE))
            terms[u, v] = a @ cells @ b
    flat = terms.ravel()
    return flat, np.median(flat[1:])


@pytest.mark.parametrize("shape", [(1, 64), (5, 64), (64, 64), (100, 64), (33, 7)])
def test_hash_equals_direct_sums(shape):
    samples = np.random.default_rng(shape[0]).integers(0, 256, (*shape, 3)).astype(np.uint8)
    flat, median = direct_hash(samples)
    bits = np.unpackbits(np.frombuffer(bytes.fromhex(media.cosine_hash(samples)), np.uint8)).astype(bool)
    clear = np.abs(flat - median) > 1e-3 * np.abs(flat[1:]).max()  # integers round; terms beside the median may fall either way
    assert clear[1:].sum() >= (7 if shape[0] == 1 else 40) and not bits[0]  # one row has no vertical terms
    assert (bits[1:] == (flat > median)[1:])[clear[1:]].all()
