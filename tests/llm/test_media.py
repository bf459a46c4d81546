"""Progressive JPEG: exact round trips, a bit-by-bit decoder and Java's own as references, edge cases."""

import hashlib
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tidemark.llm import media, pjpeg
from tidemark.llm.common import table


def plain_coefficients(data):
    """Coefficients by component of one progressive JPEG, one bit after the other."""
    at, tables, restart, scans = 2, {}, 0, []
    while data[at + 1] != 0xD9:
        marker, size = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xC2:
            height, width = struct.unpack(">HH", body[1:5])
            comps = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15) for k in range(body[5])]
        elif marker == 0xC4:
            k = 0
            while k < len(body):
                counts, code, codes, s = body[k + 1 : k + 17], 0, {}, k + 17
                for n, c in enumerate(counts, 1):
                    for _ in range(c):
                        codes[n, code] = body[s]
                        code, s = code + 1, s + 1
                    code <<= 1
                tables[body[k]], k = codes, s
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            end = at
            while not (data[end] == 255 and data[end + 1] != 0 and not 0xD0 <= data[end + 1] <= 0xD7):
                end += 1
            scans.append((body, data[at:end], restart, dict(tables)))
            at = end
    hm, vm = max(c[1] for c in comps), max(c[2] for c in comps)
    units = -(-height // (8 * vm)), -(-width // (8 * hm))
    out = [np.zeros((units[0] * v * units[1] * h, 64), int) for _, h, v in comps]
    for body, entropy, restart, tables in scans:
        n = body[0]
        parts = [([c[0] for c in comps].index(body[1 + 2 * k]), body[2 + 2 * k]) for k in range(n)]
        ss, se, ah, al = body[1 + 2 * n], body[2 + 2 * n], body[3 + 2 * n] >> 4, body[3 + 2 * n] & 15
        if n > 1:
            order = [[(c, (r * comps[c][2] + y) * units[1] * comps[c][1] + col * comps[c][1] + x, t) for c, t in parts for y in range(comps[c][2]) for x in range(comps[c][1])] for r in range(units[0]) for col in range(units[1])]
        else:
            c, t = parts[0]
            rows, cols = -(-(-(-height * comps[c][2] // vm)) // 8), -(-(-(-width * comps[c][1] // hm)) // 8)
            order = [[(c, r * units[1] * comps[c][1] + col, t)] for r in range(rows) for col in range(cols)]
        chunks, k, start = [], 0, 0
        while k < len(entropy) - 1:
            if entropy[k] == 255 and 0xD0 <= entropy[k + 1] <= 0xD7:
                chunks.append(entropy[start:k])
                start = k + 2
            k += 1 + (entropy[k] == 255)
        chunks.append(entropy[start:])
        step = restart or len(order)
        for number, chunk in enumerate(chunks):
            bits = iter("".join(f"{b:08b}" for b in chunk.replace(b"\xff\x00", b"\xff")))
            read = lambda k, bits=bits: int("".join(next(bits) for _ in range(k)) or "0", 2)

            def symbol(codes, read=read):
                code, n = 0, 0
                while (n, code) not in codes:
                    code, n = code << 1 | read(1), n + 1
                return codes[n, code]

            def value(size, read=read):
                v = read(size)
                return v if not size or v >> (size - 1) else v - (1 << size) + 1

            before, eob = {}, 0
            for unit in order[number * step : (number + 1) * step]:
                for c, block, t in unit:
                    b = out[c][block]
                    if ss == 0 and ah:
                        b[0] |= read(1) << al
                    elif ss == 0:
                        before[c] = before.get(c, 0) + value(symbol(tables[t >> 4]))
                        b[0] = before[c] << al
                    elif not ah:
                        k = ss
                        if eob:
                            eob -= 1
                            continue
                        while k <= se:
                            rs = symbol(tables[0x10 | t & 15])
                            run, size = rs >> 4, rs & 15
                            if not size and run < 15:
                                eob = (1 << run) + read(run) - 1
                                break
                            k += run
                            if size:
                                b[k] = value(size) << al
                            k += 1
                    else:
                        k, stop = ss, False
                        while k <= se:
                            run, new = 64, 0
                            if not eob:
                                rs = symbol(tables[0x10 | t & 15])
                                run, size = rs >> 4, rs & 15
                                if size:
                                    new = (1 if read(1) else -1) << al
                                elif run < 15:
                                    eob, run = (1 << run) + read(run), 64
                            while k <= se:
                                if b[k]:
                                    if read(1):
                                        b[k] += (1 << al) * (1 if b[k] > 0 else -1)
                                elif run == 0:
                                    b[k] = new
                                    k += 1
                                    break
                                else:
                                    run -= 1
                                k += 1
                        if eob:
                            eob -= 1
    return out


def payloads():
    common, rare = pjpeg.TO_BYTE[128], pjpeg.TO_BYTE[129]
    return st.lists(st.tuples(st.integers(1, 6), st.lists(st.sampled_from([common] * 12 + [rare, 0, 255, 65, 32]), min_size=192, max_size=192)).map(lambda x: np.tile(np.array(x[1], np.uint8), x[0])), min_size=1, max_size=4)


@settings(max_examples=60, deadline=None)
@given(payloads())
def test_round_trip(values):
    streams = pjpeg.encode(values)
    for value, (image,) in zip(values, pjpeg.decode(streams), strict=True):
        assert np.array_equal(pjpeg.to_payload(image), value)


def test_against_a_plain_decoder():
    rng = np.random.default_rng(4)
    values = [rng.integers(0, 256, 192 * 3).astype(np.uint8), np.frombuffer(b"some plain text, with words. " * 40, np.uint8)[:1152], np.full(192 * 5, pjpeg.TO_BYTE[128], np.uint8), rng.choice(pjpeg.TO_BYTE[125:132], 192 * 9).astype(np.uint8)]
    streams = pjpeg.encode(values)
    for stream, (image,) in zip(streams, pjpeg.decode(streams), strict=True):
        for mine, plain in zip(image.coefficients, plain_coefficients(stream), strict=True):
            assert np.array_equal(mine, plain)


def test_no_restart_markers_and_mixed_streams():
    """Streams without restart intervals are one lane each and may stand beside others."""
    value = np.frombuffer(b"words of a text " * 12, np.uint8)
    old = pjpeg.RESTART, pjpeg.DC_RESTART
    pjpeg.RESTART = pjpeg.DC_RESTART = 10_000
    try:
        (whole,) = pjpeg.encode([value])
    finally:
        pjpeg.RESTART, pjpeg.DC_RESTART = old
    whole = whole.replace(b"\xff\xdd\x00\x04\x27\x10", b"").replace(b"\xff\xdd\x00\x04\x00\x04", b"")
    (plain,) = pjpeg.encode([value])
    assert b"\xff\xdd" not in whole
    for (image,) in pjpeg.decode([whole, plain, whole]):
        assert np.array_equal(pjpeg.to_payload(image), value)


def test_pixels_against_java(spark):
    stream = pjpeg.encode([np.frombuffer(b"The quick brown fox jumps over the lazy dog; " * 30, np.uint8)])[0]
    rgb = pjpeg.to_rgb(pjpeg.decode([stream])[0][0])
    jvm = spark.sparkContext._jvm
    image = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(bytearray(stream)))
    h, w = rgb.shape[:2]
    assert (image.getHeight(), image.getWidth()) == (h, w)
    packed = np.array([[image.getRGB(x, y) & 0xFFFFFF for x in range(0, w, 3)] for y in range(0, h, 3)])
    theirs = np.stack([packed >> 16, packed >> 8 & 255, packed & 255], -1).astype(int)
    luma = lambda x: x @ np.array([0.299, 0.587, 0.114])  # noqa: E731  Java smooths the chroma, the luma is the same
    inside = ((theirs > 8) & (theirs < 247)).all(-1)
    assert inside.mean() > 0.5 and np.abs(luma(theirs) - luma(rgb[::3, ::3].astype(int)))[inside].max() < 4


def test_rejects_what_it_does_not_read():
    with pytest.raises(ValueError):
        pjpeg.decode([b"no image"])
    with pytest.raises(ValueError):
        pjpeg.decode([pjpeg.encode([np.zeros(192, np.uint8)])[0].replace(b"\xff\xc2", b"\xff\xc0")])


def test_stored_documents(spark, make, monkeypatch):
    monkeypatch.setattr(pjpeg, "FRAME_BYTES", 192 * 50)
    texts = [None, "", "x" * 192, "x" * 193, "é" * 500, "long text " * 3000, "x" * 193]
    docs = make([(k, t) for k, t in enumerate(texts)] + [(None, "null id")])
    stored = media.store(docs)
    got = {r.doc: r for r in media.read_features(stored).collect()}
    for k, t in [*enumerate(texts), (None, "null id")]:
        data = (t or "").encode()
        want = data.ljust(max(192, -(-len(data) // 192) * 192))
        r = got[k]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-16:]))
    stream = {r.doc: bytes(r.media) for r in stored.collect()}
    assert all(got[k].media_sha256 == hashlib.sha256(s).hexdigest() and got[k].media_bytes == len(s) for k, s in stream.items())
    assert got[3].feature == got[6].feature and got[3].media_sha256 == got[6].media_sha256 and ";" not in got[3].feature
    tensors = media.decode_tensors(stored).where("key = 4").collect()
    assert [len(t.rgb) for t in tensors] == [t.height * t.width * 3 for t in tensors]
    assert [(x.height, x.width, bytes(x.rgb)) for x in got[4].tensors] == [(t.height, t.width, bytes(t.rgb)) for t in tensors]
    assert [f.split(":")[0] for f in got[5].feature.split(";")] == [f"{x.height}x{x.width}" for x in got[5].tensors]
    assert media.read_features(media.store(make([]))).count() == 0
    assert media.decode_tensors(spark.createDataFrame([(1, None)], "doc long, media binary")).collect()[0].rgb is None


def test_all_documents_come_back(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    want = {r.doc_id: hashlib.sha256(media.padded(r.text)).hexdigest() for r in docs.collect()}
    assert {r.doc: r.payload_sha256 for r in media.read_features(media.store(docs)).collect()} == want


def test_second_frame_at_the_real_size(spark, make):
    text = "Many words of one very long text. " * 100_000
    (row,) = media.read_features(media.store(make([(1, text)]))).collect()
    data = media.padded(text)
    assert len(data) > pjpeg.FRAME_BYTES and len(row.tensors) == 2 and row.feature.count(";") == 1
    assert (row.payload_bytes, row.payload_sha256) == (len(data), hashlib.sha256(data).hexdigest())
