"""Telephony audio: mu-law, A-law and ADPCM in WAV files, expanded by lookup tables and kept as resampled PCM."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofold.llm._common import blob_values, bounded_batches, utf8

RATE, WIDE_RATE = 8000, 16000
#: Payload bytes of a block; a payload is filled up to whole blocks.
BLOCK, FILL = 576, 255
#: WAV format tags (fixed values of the container).
TAGS = {"pcm": 1, "alaw": 6, "mulaw": 7, "adpcm": 17}
#: Index moves of the IMA ADPCM decoder by the low three bits of a code (fixed values of the format).
INDEX_MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int64)
#: Step sizes of the IMA ADPCM decoder (fixed values of the format).
STEPS = np.array(
    [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767],
    np.int64,
)


def mulaw_table() -> np.ndarray:
    """The 256 linear values of mu-law codes (G.711), by its rule."""
    code = ~np.arange(256) & 0xFF
    size = (((code & 0x0F) << 3) + 0x84 << ((code >> 4) & 7)) - 0x84
    return np.where(code & 0x80, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """The 256 linear values of A-law codes (G.711), by its rule."""
    code = np.arange(256) ^ 0x55
    low, exponent = (code & 0x0F) << 4, (code >> 4) & 7
    size = np.where(exponent == 0, low + 8, (low + 0x108) << np.maximum(exponent - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


MULAW, ALAW = mulaw_table(), alaw_table()


def adpcm_blocks(codes: np.ndarray, predictor: np.ndarray, index: np.ndarray) -> np.ndarray:
    """PCM of IMA ADPCM blocks, a row each: the header's sample and two for each byte of ``codes``, low half first.

    The loop runs over the places in a block; every step decodes that place in all blocks at once.
    """
    out = np.empty((2 * codes.shape[1] + 1, len(codes)), np.int16)
    value, at = predictor.astype(np.int64), np.clip(index.astype(np.int64), 0, len(STEPS) - 1)
    out[0] = value
    moves = np.concatenate([INDEX_MOVES, INDEX_MOVES])
    # the difference that a code makes at a step size, by its rule
    step, code = STEPS[:, None], np.arange(16)[None, :]
    change = (step >> 3) + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
    change = np.where(code & 8, -change, change)
    columns = np.ascontiguousarray(codes.T)
    for k in range(len(columns)):
        for half, nibble in enumerate((columns[k] & 15, columns[k] >> 4)):
            value = np.clip(value + change[at, nibble], -32768, 32767)
            at = np.clip(at + moves[nibble], 0, len(STEPS) - 1)
            out[2 * k + half + 1] = value
    return np.ascontiguousarray(out.T)


def wav_head(codec: str, size: int, rate: int = RATE, align: int = 1, samples: int | None = None) -> bytes:
    """What stands before ``size`` bytes of data in a WAV file of one channel."""
    if codec == "adpcm":
        per = 2 * (align - 4) + 1
        fmt = struct.pack("<HHIIHHHH", TAGS[codec], 1, rate, rate * align // per, align, 4, 2, per)
    else:
        width = 2 if codec == "pcm" else 1
        fmt = struct.pack("<HHIIHHH", TAGS[codec], 1, rate, rate * width, width, 8 * width, 0)
    samples = samples if samples is not None else size // (2 if codec == "pcm" else 1)
    chunks = b"".join(k + struct.pack("<I", len(v)) + v + b"\0" * (len(v) % 2) for k, v in ((b"fmt ", fmt), (b"fact", struct.pack("<I", samples))))
    return b"RIFF" + struct.pack("<I", len(chunks) + 12 + size + size % 2) + b"WAVE" + chunks + b"data" + struct.pack("<I", size)


def wav(codec: str, data: bytes, rate: int = RATE, align: int = 1, samples: int | None = None) -> bytes:
    """A WAV file of one channel; ``data`` are the codec's bytes (ADPCM: whole blocks of ``align`` bytes)."""
    return b"".join((wav_head(codec, len(data), rate, align, samples), data, b"\0" * (len(data) % 2)))


def read_wav(media: bytes) -> tuple[str, int, int, bytes]:
    """(codec, rate, align, data) of a WAV file; raises ValueError where it isn't one."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("this is no WAV file")
    at, fmt, data = 12, b"", None
    while at + 8 <= len(media):
        (size,) = struct.unpack_from("<I", media, at + 4)
        body = media[at + 8 : at + 8 + size]
        if len(body) < size:
            raise ValueError("a chunk is cut off")
        if media[at : at + 4] == b"fmt ":
            fmt = body
        elif media[at : at + 4] == b"data":
            data = body
        at += 8 + size + size % 2
    if len(fmt) < 16 or data is None:
        raise ValueError("a chunk is missing")
    tag, _, rate, _, align, _ = struct.unpack_from("<HHIIHH", fmt)
    names = {v: k for k, v in TAGS.items()}
    if tag not in names:
        raise ValueError(f"format {tag} is not known")
    return names[tag], rate, align, data


#: Bytes of a file that are expanded at a time.
PART = 1 << 20


def expanded(codec: str, align: int, data: bytes) -> Iterator[np.ndarray]:
    """A file's PCM as int16, part by part, so that what is held does not follow the file's length."""
    raw = np.frombuffer(data, np.uint8)
    if codec == "pcm":
        for at in range(0, len(raw), PART):
            yield raw[at : at + PART].view("<i2").astype(np.int16)
    elif codec in ("mulaw", "alaw"):
        for at in range(0, len(raw), PART):
            yield (MULAW if codec == "mulaw" else ALAW)[raw[at : at + PART]]
    else:
        blocks = raw.reshape(-1, align)
        many = max(1, PART // align)
        for at in range(0, len(blocks), many):
            some = blocks[at : at + many]
            yield adpcm_blocks(some[:, 4:], np.ascontiguousarray(some[:, :2]).view("<i2")[:, 0], some[:, 2]).reshape(-1)


def decode(media: bytes) -> tuple[np.ndarray, int]:
    """(PCM as int16, rate) of a WAV file of any codec in ``TAGS``."""
    codec, rate, align, data = read_wav(media)
    return np.concatenate([*expanded(codec, align, data), np.zeros(0, np.int16)]), rate


def resample(pcm: np.ndarray, rate: int, to: int = WIDE_RATE) -> np.ndarray:
    """PCM at another rate by linear interpolation in whole numbers, so every machine gives the same samples."""
    if not len(pcm) or rate == to:
        return pcm.astype(np.int16)
    if to == 2 * rate:
        out = np.empty(2 * len(pcm), np.int16)
        out[::2] = pcm
        after = np.append(pcm[1:], pcm[-1:]).astype(np.int32)
        out[1::2] = (after + pcm) >> 1
        return out
    place = np.arange(len(pcm) * to // rate, dtype=np.int64) * rate
    at, part = place // to, place % to
    after = np.minimum(at + 1, len(pcm) - 1)
    return ((pcm[at].astype(np.int64) * (to - part) + pcm[after].astype(np.int64) * part) // to).astype(np.int16)


def payload_of(text: bytes) -> bytes:
    """A text's bytes, filled up with ``FILL`` to a positive multiple of ``BLOCK``."""
    return text + bytes([FILL]) * (-len(text) % BLOCK if text else BLOCK)


def store_payload(payload: bytes, codec: str) -> bytes:
    """The payload as the codec's codes in a WAV file, each byte as it is: a sample, or for ADPCM two."""
    if codec != "adpcm":
        return wav(codec, payload)
    raw = np.frombuffer(payload, np.uint8).reshape(-1, BLOCK)
    blocks = np.concatenate([np.zeros((len(raw), 4), np.uint8), raw], axis=1)
    return wav(codec, blocks.tobytes(), align=BLOCK + 4, samples=len(raw) * (2 * BLOCK + 1))


def read_payload(media: bytes) -> bytes:
    """The payload back from the stored file."""
    codec, _, align, data = read_wav(media)
    return data if codec != "adpcm" else np.frombuffer(data, np.uint8).reshape(-1, align)[:, 4:].tobytes()


CODECS = ("mulaw", "alaw", "adpcm")


def pick(payload: bytes) -> str:
    """The codec of a payload, from its content alone."""
    return CODECS[zlib.crc32(payload) % len(CODECS)]


def store(docs: DataFrame, key: str = "doc_id", text: str = "text", codec: str | None = None) -> DataFrame:
    """One row (key, n_bytes, media) for each document: its text's bytes as telephony audio in a WAV file.

    ``codec`` is one of ``CODECS``, or null to pick by content. A null text counts as empty and gives one block of
    fill; a null key stays null; repeated rows give equal files. Empty tables give no rows.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = blob_values(batch.column(1))
            payloads = list(map(payload_of, texts))
            media = [store_payload(p, codec or pick(p)) for p in payloads]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(map(len, texts)), pa.int64()), pa.array(media, pa.binary())], ["key", "n_bytes", "media"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), utf8(text).alias("t")).mapInArrow(run, f"key {kind}, n_bytes long, media binary").withColumnRenamed("key", key)


def expand(stored: DataFrame, media: str = "media", rate: int = WIDE_RATE) -> DataFrame:
    """``stored`` with the column ``pcm``: a 16-bit WAV file at ``rate``. A null or unreadable file gives null."""

    @F.pandas_udf("binary")
    def of(files):
        def one(file):
            try:
                pcm, own = decode(bytes(file))
            except (TypeError, ValueError):
                return None
            return wav("pcm", resample(pcm, own, rate).astype("<i2").tobytes(), rate)

        return files.map(one)

    bounded_batches(stored.sparkSession)
    return stored.withColumn("pcm", of(F.col(media)))


def describe(stored: DataFrame, key: str = "doc_id") -> DataFrame:
    """What the stored files of ``store`` hold, read back: digests of payload, file and resampled PCM file, and audio features.

    The PCM file is that of ``expand``, made here with the features so that a file is decoded once.

    ``feature`` names the codec, the resampled samples, their root mean square, peak, zero crossings and check sum.
    Short ADPCM files of a batch are decoded together; a long file goes part by part, and no whole PCM of it is held.
    """
    names = ["key", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "pcm_bytes", "pcm_sha256", "feature"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = batch.column(2).to_pylist()
            payloads = list(map(read_payload, files))
            wide, digests, features = zip(*_features(files), strict=True) if files else ((), (), ())
            columns = [
                batch.column(0), batch.column(1), pa.array(list(map(len, payloads)), pa.int64()), [hashlib.sha256(p).hexdigest() for p in payloads],
                pa.array([zlib.crc32(p[-32:]) for p in payloads], pa.int64()), pa.array(list(map(len, files)), pa.int64()), [hashlib.sha256(f).hexdigest() for f in files], pa.array(wide, pa.int64()), digests, features,
            ]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, pa.string()) for c in columns], names)

    kind = stored.schema[key].dataType.simpleString()
    schema = f"key {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, pcm_bytes long, pcm_sha256 string, feature string"
    return stored.select(F.col(key).alias("key"), "n_bytes", "media").mapInArrow(run, schema).withColumnRenamed("key", key)


#: Bytes of stored ADPCM that are decoded together.
TOGETHER = 2 << 20


def _features(files: list[bytes]) -> Iterator[tuple[int, str, str]]:
    read = [read_wav(f) for f in files]
    done: dict[int, tuple[int, str, str]] = {}
    todo = [k for k, r in enumerate(read) if r[0] == "adpcm" and len(r[3]) < TOGETHER]
    while todo:
        some, size = [], 0
        while todo and (not some or size + len(read[todo[0]][3]) <= TOGETHER) and (not some or read[todo[0]][2] == read[some[0]][2]):
            size += len(read[todo[0]][3])
            some.append(todo.pop(0))
        align = read[some[0]][2]
        sound = np.concatenate(list(expanded("adpcm", align, b"".join(read[k][3] for k in some))))
        ends = np.cumsum([len(read[k][3]) // align * (2 * (align - 4) + 1) for k in some])
        for k, own in zip(some, np.split(sound, ends[:-1]), strict=True):
            done[k] = _summary("adpcm", [own], len(own), read[k][1])
    for k, (codec, rate, align, data) in enumerate(read):
        samples = len(data) // align * (2 * (align - 4) + 1) if codec == "adpcm" else len(data) // (2 if codec == "pcm" else 1)
        yield done[k] if k in done else _summary(codec, expanded(codec, align, data), samples, rate)


def _summary(codec: str, parts: Iterable[np.ndarray], samples: int, rate: int) -> tuple[int, str, str]:
    """Bytes and digest of the resampled PCM's file, and the feature; sums are whole numbers, so parts give what a whole gives."""
    if 2 * rate != WIDE_RATE:  # only doubling can go part by part
        parts = [np.concatenate([*parts, np.zeros(0, np.int16)])]
    n = samples * WIDE_RATE // rate if rate != WIDE_RATE else samples
    head = wav_head("pcm", 2 * n, WIDE_RATE)
    digest, crc, square, peak, crossings, last, held = hashlib.sha256(head), 0, 0, 0, 0, None, np.zeros(0, np.int16)

    def take(wide: np.ndarray) -> None:
        nonlocal crc, square, peak, crossings, last
        raw = wide.astype("<i2").tobytes()
        digest.update(raw)
        crc = zlib.crc32(raw, crc)
        big = wide.astype(np.int64)
        square += int(np.dot(big, big))
        peak = max(peak, int(np.abs(big).max(initial=0)))
        below = wide < 0
        crossings += int(np.count_nonzero(below[1:] != below[:-1])) + int(last is not None and len(below) > 0 and bool(below[0]) != last)
        last = bool(below[-1]) if len(below) else last

    for part in parts:
        if 2 * rate != WIDE_RATE:
            take(resample(part, rate))
            continue
        held = np.concatenate([held, part])
        if len(held):
            take(resample(held, rate)[:-2])  # the last sample waits for the one after it
            held = held[-1:]
    take(resample(held, rate))
    return len(head) + 2 * n, digest.hexdigest(), f"{codec} n={n} rms={(square / max(1, n)) ** 0.5:.3f} peak={peak} zc={crossings} crc={crc:08x}"
