"""FLAC: streams of other encoders, broken streams, blocks with offsets."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import flac, queries

RNG = np.random.default_rng(11)


class Writer:
    """A plain bit-by-bit encoder of one mono frame a subframe, for what the numpy encoder never makes."""

    def __init__(self):
        self.bits = []

    def put(self, value, width):
        self.bits += [(value >> (width - 1 - i)) & 1 for i in range(width)]

    def bytes(self):
        padded = self.bits + [0] * (-len(self.bits) % 8)
        return bytes(sum(b << (7 - i) for i, b in enumerate(padded[k : k + 8])) for k in range(0, len(padded), 8))


def crc(data, poly, width):
    x = 0
    for byte in data:
        x ^= byte << (width - 8)
        for _ in range(8):
            x = ((x << 1) ^ (poly if x >> (width - 1) else 0)) & ((1 << width) - 1)
    return x


def frame(number, samples, depth, *, kind, order=0, taps=(), shift=0, precision=6, parts=0, escape=False, wide=False, wasted=0):
    n, w = len(samples), Writer()
    w.put(0b11111111111110, 14), w.put(0, 2)
    w.put(7, 4), w.put(0, 4), w.put(0, 4), w.put({8: 1, 16: 4, 24: 6}[depth], 3), w.put(0, 1)
    w.put(number, 8), w.put(n - 1, 16)
    w.put(crc(w.bytes(), 0x07, 8), 8)
    w.put(0, 1), w.put(kind, 6), w.put(int(wasted > 0), 1)
    if wasted:
        w.put(1, wasted)  # wasted - 1 zeros and a one
    x, depth = [s >> wasted for s in samples], depth - wasted
    for s in x[:order]:
        w.put(s & ((1 << depth) - 1), depth)
    if kind >= 32:
        w.put(precision - 1, 4), w.put(shift & 31, 5)
        for t in taps:
            w.put(t & ((1 << precision) - 1), precision)
    weights = taps if kind >= 32 else flac.FIXED[order]
    rest = [x[i] - (sum(t * x[i - 1 - j] for j, t in enumerate(weights)) >> shift) for i in range(order, n)]
    w.put(int(wide), 2), w.put(parts, 4)
    each, at = n >> parts, 0
    for p in range(1 << parts):
        own = rest[at : at + each - (order if p == 0 else 0)]
        at += len(own)
        if escape and p % 2:
            w.put((1 << (5 if wide else 4)) - 1, 5 if wide else 4), w.put(depth + 2, 5)
            for r in own:
                w.put(r & ((1 << (depth + 2)) - 1), depth + 2)
        else:
            k = 2
            w.put(k, 5 if wide else 4)
            for r in own:
                u = (r << 1) ^ (r >> 63)
                w.put(1, (u >> k) + 1), w.put(u & ((1 << k) - 1), k)
    body = w.bytes()
    return body + crc(body, 0x8005, 16).to_bytes(2, "big")


def stream(frames, samples, depth):
    raw = np.array(samples, dtype="<i4").view(np.uint8).reshape(-1, 4)[:, : depth // 8].tobytes()
    info = (64).to_bytes(2, "big") * 2 + bytes(6) + (8000 << 44 | (depth - 1) << 36 | len(samples)).to_bytes(8, "big") + hashlib.md5(raw).digest()
    return b"fLaC" + bytes([0x80]) + (34).to_bytes(3, "big") + info + b"".join(frames)


def walk(n, depth):
    return np.clip(np.cumsum(RNG.integers(-9, 10, n)), -(1 << (depth - 2)), (1 << (depth - 2)) - 1).tolist()


@pytest.mark.parametrize("depth", [8, 16, 24])
@pytest.mark.parametrize("how", [{"kind": 8 + o, "order": o} for o in range(5)] + [
    {"kind": 33, "order": 2, "taps": (7, -3), "shift": 2}, {"kind": 34, "order": 3, "taps": (9, -7, 2), "shift": 2, "parts": 2}, {"kind": 10, "order": 2, "parts": 3, "escape": True},
    {"kind": 9, "order": 1, "wide": True, "parts": 1, "escape": True}, {"kind": 9, "order": 1, "wasted": 2},
])
def test_what_other_encoders_write_is_read(depth, how):
    samples = walk(160, depth)
    if how.get("wasted"):
        samples = [s & ~3 for s in samples]
    whole = stream([frame(i, samples[i * 64 : (i + 1) * 64], depth, **how) for i in range(2)] + [frame(2, samples[128:], depth, **(how | {"parts": 0, "escape": False}))], samples, depth)
    assert flac.decode([whole])[0].tolist() == samples


def payloads(spark):
    rows = [(1, b"plain words in a row, and more of them. " * 40), (2, bytes(128)), (3, bytes(RNG.integers(0, 256, 4096).astype(np.uint8))), (4, None), (5, b""), (6, b"a long text " * 500_000), (1, b"plain words in a row, and more of them. " * 40)]
    return rows, spark.createDataFrame(rows, "doc_id long, payload binary").withColumn("n", F.lit(7))


def test_streams_are_read_back_whole_and_equal_ones_are_equal(spark):
    rows, df = payloads(spark)
    out = flac.decode_flac(flac.encode_flac(df)).collect()
    assert [bytes(b ^ 0x80 for b in r["pcm"]) if r["pcm"] is not None and len(r["pcm"]) < 10_000 else r["pcm"] is None for r in out if r["doc_id"] != 6] == [p if p else True for i, p in rows if i != 6]
    long = next(r for r in out if r["doc_id"] == 6)
    assert (np.frombuffer(long["pcm"], np.uint8) ^ 0x80).tobytes() == rows[5][1] and long["media_error"] is None
    one = [r["media"] for r in out if r["doc_id"] == 1]
    assert one[0] == one[1] and all(r["n"] == 7 for r in out)


def test_broken_streams_say_so_and_spare_the_others(spark):
    good = flac.Encoder().encode([b"some text to keep. " * 300])[0]
    cut, flipped, header = good[:-5], bytearray(good), bytearray(good)
    flipped[-40] ^= 4
    header[len(good) - len(good) // 2 :] = bytes(len(good) // 2)
    df = spark.createDataFrame([(0, good), (1, bytes(flipped)), (2, cut), (3, b"no flac"), (4, bytes(header)), (5, None), (6, good)], "doc_id long, media binary")
    out = {r["doc_id"]: r for r in flac.decode_flac(df).collect()}
    assert all(out[i]["pcm"] is None and out[i]["media_error"] for i in (1, 2, 3, 4))
    assert out[0]["pcm"] == out[6]["pcm"] and out[0]["media_error"] is None and out[5]["pcm"] is None and out[5]["media_error"] is None


def test_blocks_join_to_the_samples_and_any_sample_is_found(spark):
    rows, df = payloads(spark)
    read = flac.decode_flac(flac.encode_flac(df.filter("doc_id in (1, 2, 3, 4)").dropDuplicates(["doc_id"])))
    blocks = {}
    for r in flac.pcm_blocks(read, block=100).collect():
        blocks.setdefault(r["doc_id"], {})[r["block"]] = r
    whole = {r["doc_id"]: r["pcm"] for r in read.collect()}
    assert set(blocks) == {1, 2, 3}
    for i, held in blocks.items():
        assert b"".join(held[k]["pcm"] for k in sorted(held)) == whole[i] and all(r["sample_offset"] == 100 * k and r["samples"] == len(r["pcm"]) for k, r in held.items())
        s = len(whole[i]) // 2
        assert held[s // 100]["pcm"][s - held[s // 100]["sample_offset"]] == whole[i][s]
        assert [(a, bytes(b)) for a, b in flac.cut_blocks(whole[i], 100)] == [(r["sample_offset"], bytes(r["pcm"])) for _, r in sorted(held.items())]


def test_digests_are_those_of_plain_python(spark):
    rows, df = payloads(spark)
    out = flac.read_blocks(flac.encode_flac(df).drop("payload"), queries.media_digest, queries.MEDIA_FIELDS, block=512).collect()
    for (i, p), r in zip(rows, out, strict=True):
        x = np.frombuffer(p or b"", np.uint8).astype(np.int64) - 128
        cross = int(((x[1:] < 0) != (x[:-1] < 0)).sum()) if len(x) else 0
        want = f"samples={len(x)};blocks={-(-len(x) // 512)};peak={int(np.abs(x).max(initial=0))};sum={int(x.sum())};energy={int((x * x).sum())};crossings={cross}"
        assert (r["doc_id"], r["feature"], r["payload_sha256"]) == (i, want, hashlib.sha256(p or b"").hexdigest())
        media = flac.Encoder().encode([p])[0] if p else b""
        assert (r["media_bytes"], r["media_sha256"]) == (len(media), hashlib.sha256(media).hexdigest())


def fake_header(number, size=flac.BLOCK):
    """A frame's header with its right checksum, as it may stand in any text."""
    return flac.Encoder().header(number, size)


def as_payload(header):
    """Payload bytes whose samples, written verbatim, are these bytes."""
    return bytes(b ^ 0x80 for b in header)


def test_a_text_whose_bytes_look_like_a_header_is_read_back(spark):
    r = random.Random(21)
    odd = lambda n: "".join(chr(r.choice([r.randrange(0x20, 0x7F), r.randrange(0xA0, 0x7FF)])) for _ in range(n))
    # Stored verbatim these characters are FF F8 .. and a header of the frame after the first.
    texts = [odd(150) + "\x7fxႁ\x006" + odd(600), odd(40) + "plain", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    stored = flac.encode_flac(queries.padded_payloads(docs))
    for row in flac.decode_flac(stored).collect():
        assert row["media_error"] is None and bytes(b ^ 0x80 for b in row["pcm"]) == row["payload"]


@pytest.mark.parametrize("seed", range(8))
def test_fake_headers_at_every_place_are_read_back(seed):
    r = random.Random(seed)
    noise = lambda n: bytes(r.randrange(256) for _ in range(n))
    payloads = []
    for _ in range(12):
        body = bytearray(noise(r.randrange(1, 9) * 512 + r.randrange(-300, 300)))
        for _ in range(r.randrange(1, 30)):
            head = as_payload(fake_header(r.randrange(0, 12), r.choice((flac.BLOCK, r.randrange(1, 512)))))
            at = r.randrange(0, len(body))
            body[at : at + len(head)] = head
        payloads.append(bytes(body))
    payloads.append(b"".join(as_payload(fake_header(i % 5)) for i in range(800)))  # nothing but headers
    inner = flac.Encoder().encode([noise(3000)])[0]
    payloads.append(noise(100) + as_payload(inner) + noise(100))  # a whole stream inside a stream
    for streams in (flac.Encoder().encode(payloads), [flac.Encoder().encode([p])[0] for p in payloads]):
        out = flac.decode(streams)
        assert [bytes((x.astype(np.int64) + 128).astype(np.uint8)) for x in out] == payloads


def test_a_crafted_chain_with_right_checksums_is_no_frame():
    """A false frame 1 inside frame 0 whose bytes even make frame 0's checksum hold up to it."""
    r = random.Random(4)
    body = bytearray(bytes(r.randrange(256) for _ in range(1024)))
    probe = flac.Encoder().encode([bytes(body)])[0]
    start = flac.parse_info(probe)["at"]
    head = fake_header(0)
    for at in range(60, 300):
        body[at : at + len(head) + 1] = as_payload(fake_header(1)) + b"\0"
        upto = head + bytes([2]) + bytes(b ^ 0x80 for b in body[: at - 2])  # frame 0, verbatim, before the false frame
        body[at - 2 : at] = as_payload(crc(upto, 0x8005, 16).to_bytes(2, "big"))
    payload = bytes(body)
    coded = flac.Encoder().encode([payload])[0]
    assert coded[start : start + 5] == probe[start : start + 5]
    assert bytes((flac.decode([coded])[0].astype(np.int64) + 128).astype(np.uint8)) == payload


def test_streams_without_or_with_a_wrong_seek_table_are_walked():
    r = random.Random(6)
    payload = bytes(r.randrange(256) for _ in range(70_000))
    payload = payload[:600] + as_payload(fake_header(2)) + payload[600:]
    coded = flac.Encoder().encode([payload])[0]
    info = flac.parse_info(coded)
    assert len(info["points"]) > 1
    bare = coded[:4] + bytes([0x80]) + coded[5:42] + coded[info["at"] :]
    wrong = coded.replace(info["points"][1].to_bytes(8, "big"), (info["points"][1] + 1).to_bytes(8, "big"), 1)
    for stream in (coded, bare, wrong):
        assert bytes((flac.decode([stream])[0].astype(np.int64) + 128).astype(np.uint8)) == payload
    with pytest.raises(flac.FlacError):
        flac.decode([bare[:-700]])


def test_a_row_that_can_t_be_read_back_raises(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(1, "a text")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(queries.flac, "encode_flac", lambda df: df.withColumn("media", F.encode(F.lit("no stream"), "UTF-8")))
    with pytest.raises(Exception, match="can't be read back"):
        queries.op5_flac(spark, str(tmp_path)).collect()
