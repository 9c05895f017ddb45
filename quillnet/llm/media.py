"""Media columns: text as an 8-bit WAV file, read back, with spectral-peak pair fingerprints.

The samples go through the ``wave`` module.  Frames of the samples read back get
a short-time Fourier transform; the strongest bin of each of a few frequency
bands is a peak; every peak is paired with the peaks of the next frames, and the
hash of (bin, later bin, distance) is stored with its time: a time-coded array.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_slices, texts_as_bytes

UNIT = 192
RATE = 8000
FRAME = 192
BANDS = ((1, 8), (8, 20), (20, 44), (44, 97))
FAN_OUT = 2
CODE = np.dtype([("time", "<u4"), ("hash", "<u2")])


def payload_of(text: bytes) -> bytes:
    """The text, padded by spaces to a positive multiple of UNIT bytes."""
    return text + b" " * (max(UNIT, -(-len(text) // UNIT) * UNIT) - len(text))


def to_wav(payload: bytes) -> bytes:
    """A mono file with one 8-bit sample for each byte."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as r:
        return r.readframes(r.getnframes())


def fingerprint(samples: bytes) -> np.ndarray:
    """Time-coded peak pairs of 8-bit samples: records of frame number and pair hash, in order of time."""
    x = np.frombuffer(samples, np.uint8).astype(np.float32) - 128.0
    frames = x[: len(x) // FRAME * FRAME].reshape(-1, FRAME)
    window = np.hanning(FRAME).astype(np.float32)
    peaks = np.empty((len(frames), len(BANDS)), np.int64)
    for start in range(0, len(frames), 4096):
        part = frames[start : start + 4096]
        power = np.abs(np.fft.rfft((part - part.mean(axis=1, keepdims=True)) * window, axis=1))
        for b, (lo, hi) in enumerate(BANDS):
            peaks[start : start + 4096, b] = lo + power[:, lo:hi].argmax(axis=1)
    codes = []
    for step in range(1, FAN_OUT + 1):
        early, late = peaks[:-step], peaks[step:]
        if len(early):
            out = np.empty(early.shape, CODE)
            out["time"] = np.arange(len(early))[:, None]
            out["hash"] = (early * 97 + late) * FAN_OUT + step - 1
            codes.append(out.ravel())
    if not codes:
        return np.zeros(0, CODE)
    every = np.concatenate(codes)
    return every[np.lexsort((every["hash"], every["time"]))]


SCHEMA = "doc_id long, n_bytes long, payload binary, media binary, fingerprint binary"


def media_columns(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload as read back, the WAV file, and the fingerprint's records as bytes.

    A null or empty text is UNIT spaces.  Equal texts give equal values; repeated
    rows give repeated rows; other columns are ignored.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = texts_as_bytes(batch.column("text"))
        media = [to_wav(payload_of(t)) for t in texts]
        back = [from_wav(m) for m in media]
        prints = [fingerprint(p).tobytes() for p in back]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(back, pa.binary()), pa.array(media, pa.binary()), pa.array(prints, pa.binary())], ["doc_id", "n_bytes", "payload", "media", "fingerprint"])

    return map_slices(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, SCHEMA)


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_digest(columns: DataFrame) -> DataFrame:
    """Digests of the stored columns; ``feature`` names the number of codes, their digest and the first ones."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        payloads, media, prints = (batch.column(c).to_pylist() for c in ("payload", "media", "fingerprint"))
        features = []
        for p in prints:
            codes = np.frombuffer(p, CODE)
            features.append(f"{len(codes)}:{hashlib.sha256(p).hexdigest()[:32]}:" + ",".join(f"{t}-{h}" for t, h in codes[:8].tolist()))
        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                batch.column("n_bytes"),
                pa.array([len(p) for p in payloads], pa.int64()),
                pa.array([hashlib.sha256(p).hexdigest() for p in payloads]),
                pa.array([zlib.crc32(p[-16:]) for p in payloads], pa.int64()),
                pa.array([len(m) for m in media], pa.int64()),
                pa.array([hashlib.sha256(m).hexdigest() for m in media]),
                pa.array(features),
            ],
            ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
        )

    return map_slices(columns, run, DIGEST, column="payload")
