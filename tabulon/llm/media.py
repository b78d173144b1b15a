"""Media columns: payloads as WAV, and spectral-peak pair fingerprints of them.

A payload is stored losslessly as 8-bit mono samples by the wave module and read back from the stored bytes. A
short-time Fourier transform gives a spectrum for each frame; in each band the strongest bin is a peak where no
neighbouring frame is stronger. Each peak is paired with the next ones; a pair's code holds both bins and the distance,
and codes are stored with the frame they begin at, as two arrays of equal length.

Nulls: a null text is an empty one: 64 bytes 0, which have no peak. Equal texts give equal values; repeated rows each
have their own. Long texts are transformed in slices of frames. An empty table gives no row.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm.common import binaries, bounded

RATE, FRAME, HOP, UNIT = 8000, 256, 128, 64
#: Bins where bands begin; the last ends at FRAME / 2.
BANDS = np.array([1, 8, 24, 56])
#: Frames on either side that a peak outdoes, pairs for a peak, and the farthest partner.
REACH, PAIRS, FARTHEST = 3, 3, 63
#: Frames transformed at once.
SLICE = 4096
_WINDOW = np.hanning(FRAME).astype(np.float32)
_ENDS = np.r_[BANDS[1:], FRAME // 2 + 1]


def to_wav(payload: bytes) -> bytes:
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


def payload_of(text: bytes) -> bytes:
    return text + bytes(-len(text) % UNIT or (0 if text else UNIT))


def peaks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frames and bins of the spectral peaks, by frame and bin."""
    n = 1 + max(0, -(-(len(samples) - FRAME) // HOP))
    wave_form = np.zeros((n - 1) * HOP + FRAME, np.float32)
    wave_form[: len(samples)] = samples - np.float32(samples.mean())
    frames = np.lib.stride_tricks.sliding_window_view(wave_form, FRAME)[::HOP]
    strong, where = np.empty((n, len(BANDS)), np.float32), np.empty((n, len(BANDS)), np.int64)
    for i in range(0, n, SLICE):
        power = np.abs(np.fft.rfft(frames[i : i + SLICE] * _WINDOW, axis=1)).astype(np.float32)
        for b, (lo, hi) in enumerate(zip(BANDS, _ENDS, strict=True)):
            part = power[:, lo:hi]
            at = part.argmax(1)
            where[i : i + SLICE, b], strong[i : i + SLICE, b] = at + lo, part[np.arange(len(part)), at]
    padded = np.pad(strong, ((REACH, REACH), (0, 0)))
    top = strong.copy()
    for s in range(2 * REACH + 1):
        np.maximum(top, padded[s : s + n], out=top)
    frame, band = np.nonzero((strong == top) & (strong > 1e-3))
    return frame, where[frame, band]


def fingerprint(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Time-coded pairs: begin frames, and codes of first bin, second bin and distance."""
    frame, bin_ = peaks(samples)
    times, codes, order = [], [], []
    for k in range(1, PAIRS + 1):
        gap = frame[k:] - frame[:-k]
        keep = np.nonzero(gap <= FARTHEST)[0]
        times.append(frame[keep])
        codes.append(bin_[keep] << 14 | bin_[keep + k] << 6 | gap[keep])
        order.append(keep * PAIRS + k)
    by = np.argsort(np.concatenate(order))
    return np.concatenate(times)[by], np.concatenate(codes)[by]


_OUT = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, times array<int>, codes array<int>"


def media_columns(docs: DataFrame, keep_media: bool = False) -> DataFrame:
    """``docs(doc_id, text)`` to sizes and hashes of payload and WAV, the pairs' ``times`` and ``codes``, and with ``keep_media`` the WAV bytes as ``media``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, 1):
            rows = []
            for text in binaries(batch.column(1)):
                media = to_wav(payload_of(text))
                back = from_wav(media)
                times, codes = fingerprint(np.frombuffer(back, np.uint8).astype(np.float32))
                row = (len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), times.astype(np.int32), codes.astype(np.int32))
                rows.append((*row, media) if keep_media else row)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary()]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=False)] if rows else [pa.array([], t) for t in kinds[: 8 + keep_media]]
            names = [x.split()[0] for x in (_OUT + ", media binary").split(", ")]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=names[: len(columns) + 1])

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return chosen.mapInArrow(run, _OUT + (", media binary" if keep_media else ""))
