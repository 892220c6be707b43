import hashlib
import random
import zlib

import numpy as np
import pytest
from chronofold.llm import media

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, media string, n_bytes int"


def plain_adpcm(block):
    """One IMA ADPCM block, sample by sample."""
    value, index = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
    out = [value]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = int(media.STEPS[index])
            diff = step >> 3
            if code & 4:
                diff += step
            if code & 2:
                diff += step >> 1
            if code & 1:
                diff += step >> 2
            value = max(-32768, min(32767, value - diff if code & 8 else value + diff))
            index = max(0, min(88, index + [-1, -1, -1, -1, 2, 4, 6, 8][code & 7]))
            out.append(value)
    return out


def test_tables():
    assert media.MULAW[0xFF] == 0 and media.MULAW[0x80] == 32124 and media.MULAW[0] == -32124 and media.MULAW[0x7F] == 0
    assert media.ALAW[0xD5] == 8 and media.ALAW[0x55] == -8 and media.ALAW[0xAA] == 32256 and media.ALAW[0x2A] == -32256
    assert len(set(media.ALAW)) == 256 and len(set(media.MULAW)) == 255


def test_adpcm_across_blocks_is_sample_by_sample():
    rng = np.random.default_rng(1)
    blocks = rng.integers(0, 256, (7, 60), dtype=np.uint8)
    blocks[:, 3] = 0
    got = media.adpcm_blocks(blocks[:, 4:], np.ascontiguousarray(blocks[:, :2]).view("<i2")[:, 0], blocks[:, 2])
    assert [list(map(int, row)) for row in got] == [plain_adpcm(bytes(b)) for b in blocks]


@pytest.mark.parametrize("codec", media.CODECS)
def test_files_hold_the_payload(codec):
    payload = media.payload_of(bytes(random.Random(2).randbytes(3000)))
    file = media.store_payload(payload, codec)
    assert media.read_payload(file) == payload and media.read_wav(file)[:2] == (codec, 8000)
    pcm, rate = media.decode(file)
    if codec != "adpcm":
        assert len(pcm) == len(payload)
    wide = media.wav("pcm", media.resample(pcm, rate).astype("<i2").tobytes(), 16000)
    again, rate = media.decode(wide)
    assert rate == 16000 and list(again[::2]) == list(pcm)
    for bad in (b"", b"RIFF", file[:-10], file[:30], b"RIFF\0\0\0\0WAVE"):
        with pytest.raises(ValueError):
            media.read_wav(bad)


def test_resample_keeps_lines():
    line = np.arange(0, 8000, 10, dtype=np.int16)
    assert np.abs(np.diff(media.resample(line, 8000, 12000).astype(int))).max() <= 8
    assert len(media.resample(line, 8000, 11025)) == len(line) * 11025 // 8000 and len(media.resample(line[:0], 8000)) == 0


def test_round_trip_and_digest(spark):
    rng = random.Random(1)
    rows = [(k, "é".join("".join(rng.choice("abc ") for _ in range(rng.randrange(0, 90))) for _ in range(rng.randrange(0, 12)))) for k in range(120)]
    rows += [(None, "x"), (500, None), (501, ""), (502, "y" * 200_000), (503, "z" * 576), (504, rows[3][1]), (3, rows[3][1])]
    df = spark.createDataFrame([(k, t, "en", "s", 1, "m", 2) for k, t in rows], SCHEMA)
    stored = media.store(df)
    got = {(r["doc_id"], r["n_bytes"]): r for r in media.describe(stored).collect()}
    for key, text in rows:
        raw = (text or "").encode()
        payload = raw + b"\xff" * ((-len(raw)) % 576 or (0 if raw else 576))
        r = got[key, len(raw)]
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    for r in stored.collect():
        d = got[r["doc_id"], r["n_bytes"]]
        assert (d["media_bytes"], d["media_sha256"]) == (len(r["media"]), hashlib.sha256(r["media"]).hexdigest())
    assert got[504, len(rows[3][1].encode())]["feature"] == got[3, len(rows[3][1].encode())]["feature"]
    assert media.describe(media.store(df.limit(0))).count() == 0
    pcm = media.expand(stored.limit(5)).collect()
    assert all(media.read_wav(bytes(r["pcm"]))[:2] == ("pcm", 16000) for r in pcm)


def test_features_of_a_batch_are_those_of_each_file():
    rng = random.Random(7)
    files = [media.store_payload(media.payload_of(rng.randbytes(rng.randrange(0, 5000))), c) for c in media.CODECS * 5]
    assert list(media._features(files)) == [next(iter(media._features([f]))) for f in files]


def test_described_pcm_is_the_expanded_file(spark):
    """The query's pcm columns are those of the file that expand stores, for each codec."""
    import hashlib

    rows = [(k, f"text {k} " * (40 * k)) for k in range(9)]
    stored = media.store(spark.createDataFrame(rows, "doc_id long, text string"))
    files = {r["doc_id"]: bytes(r["pcm"]) for r in media.expand(stored).collect()}
    got = media.describe(stored).collect()
    assert {r["feature"].split()[0] for r in got} == set(media.CODECS)
    assert {r["doc_id"]: (r["pcm_bytes"], r["pcm_sha256"]) for r in got} == {k: (len(f), hashlib.sha256(f).hexdigest()) for k, f in files.items()}
