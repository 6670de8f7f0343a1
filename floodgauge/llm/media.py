"""Media columns: texts stored as WAV audio, with spectral-peak pair fingerprints.

The payload becomes 8-bit mono samples in a WAV container. Features come from the samples read back
by the wave module: a short-time Fourier transform, the strongest spectral peaks of each frame, and
pairs of peaks up to ``FAN`` frames apart, stored as an array of time-coded integers.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from floodgauge.llm.common import map_blocks, table

UNIT, RATE = 576, 8000
HOP, PEAKS, FAN, FRAMES = UNIT // 2, 3, 3, 4096
_WINDOW = np.hanning(UNIT).astype(np.float32)


def payload_of(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode()
    return len(raw), raw + b"\xff" * (-len(raw) % UNIT if raw else UNIT)


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def peaks(samples: np.ndarray) -> np.ndarray:
    """The PEAKS strongest local maxima (bins, from 1) of each frame, 0 where it has fewer; levels are
    rounded to 1/4 of an octave before they are compared, ties take the lower bin."""
    frames = np.lib.stride_tricks.sliding_window_view(samples, UNIT)[::HOP]
    found = []
    for at in range(0, len(frames), FRAMES):
        spectrum = np.abs(np.fft.rfft((frames[at : at + FRAMES] - np.float32(128)) * _WINDOW, axis=1))
        level = np.round(4 * np.log2(spectrum + 1)).astype(np.int32)
        inner = level[:, 1:-1]
        top = np.where((inner >= level[:, :-2]) & (inner > level[:, 2:]), inner, -1)
        order = np.argsort(-(top.astype(np.int64) * 512) + np.arange(top.shape[1]), axis=1)[:, :PEAKS]
        found.append(np.where(np.take_along_axis(top, order, axis=1) >= 0, order + 1, 0))
    return np.concatenate(found)


def fingerprint(media: bytes) -> np.ndarray:
    """Time-coded peak pairs: frame << 24 | bin << 13 | later bin << 2 | frames between, less 1."""
    bins = peaks(np.frombuffer(from_wav(media), np.uint8).astype(np.float32)).astype(np.int64)
    out = [np.zeros(0, np.int64)]
    for gap in range(1, FAN + 1):
        if len(bins) > gap:
            t = np.arange(len(bins) - gap, dtype=np.int64)[:, None, None] << 24
            pairs = t | bins[:-gap, :, None] << 13 | bins[gap:, None, :] << 2 | gap - 1
            out.append(pairs[(bins[:-gap, :, None] > 0) & (bins[gap:, None, :] > 0)])
    return np.sort(np.concatenate(out))


def media_columns(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media (WAV), fingerprint (array of long) for every document.

    Null text counts as empty: one unit of bytes 255. Equal texts give equal values. Rows are
    independent, repeated ones give repeated rows; an empty table gives no rows; a very long text is one
    file, whole. Other columns are ignored.
    """

    def block(cols: dict[str, list]) -> dict[str, list]:
        loads = [payload_of(t) for t in cols["text"]]
        media = [to_wav(p) for _, p in loads]
        return {"doc_id": cols["doc_id"], "n_bytes": [n for n, _ in loads], "media": media, "fingerprint": [fingerprint(m) for m in media]}

    return map_blocks(docs.select("doc_id", "text"), block, "doc_id long, n_bytes long, media binary, fingerprint array<long>")


def digests(media: DataFrame) -> DataFrame:
    """Digest columns of media_columns(), the payload read back from the stored form."""

    def block(cols: dict[str, list]) -> dict[str, list]:
        loads = [from_wav(m) for m in cols["media"]]
        return {
            "doc_id": cols["doc_id"],
            "n_bytes": cols["n_bytes"],
            "payload_bytes": [len(p) for p in loads],
            "payload_sha256": [hashlib.sha256(p).hexdigest() for p in loads],
            "tail_crc32": [zlib.crc32(p[-32:]) for p in loads],
            "media_bytes": [len(m) for m in cols["media"]],
            "media_sha256": [hashlib.sha256(m).hexdigest() for m in cols["media"]],
            "n_pairs": cols["n_pairs"],
            "feature": cols["feature"],
        }

    pairs = F.col("fingerprint")
    coded = F.concat(F.size(pairs).cast("string"), F.lit(":"), F.md5(F.array_join(pairs, ",").cast("binary")))
    source = media.select("doc_id", "n_bytes", "media", F.size(pairs).alias("n_pairs"), coded.alias("feature"))
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, n_pairs int, feature string"
    return map_blocks(source, block, schema, text="media")


def op3_media_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(media_columns(table(spark, sf_dir, "documents")))
