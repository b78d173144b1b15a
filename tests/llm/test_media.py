import hashlib
import zlib

import numpy as np

from tabulon.llm import media


def test_round_trip_and_digests(spark):
    texts = [None, "", "a", "x" * 63, "x" * 64, "x" * 65, "naïve 😀 " * 500, "abc " * 40_000, "a"]
    df = spark.createDataFrame([(i, t, 1, "z") for i, t in enumerate(texts)], "doc_id long, text string, times int, media string")
    rows = sorted(media.media_columns(df, keep_media=True).collect())
    for r, text in zip(rows, texts, strict=True):
        raw = (text or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert media.from_wav(r.media) == payload
        assert (r.n_bytes, r.payload_bytes, r.media_bytes) == (len(raw), len(payload), len(r.media))
        assert (r.payload_sha256, r.media_sha256) == (hashlib.sha256(payload).hexdigest(), hashlib.sha256(r.media).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-64:])
        assert len(r.times) == len(r.codes) and r.times == sorted(r.times)
    assert rows[2][1:] == rows[8][1:] and rows[0][1:] == rows[1][1:]
    assert media.media_columns(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_peaks_find_tones_and_slices_agree(monkeypatch):
    t = np.arange(40_000)
    tone = 100 * np.sin(2 * np.pi * 20 * t / media.FRAME) * (t % 4000 < 2000)
    frame, bins = media.peaks(tone.astype(np.float32))
    assert np.bincount(bins[np.isin(bins, range(8, 24))]).argmax() == 20
    whole = media.fingerprint(tone.astype(np.float32))
    monkeypatch.setattr(media, "SLICE", 7)
    assert all(np.array_equal(a, b) for a, b in zip(whole, media.fingerprint(tone.astype(np.float32)), strict=True))


def brute_peaks(samples):
    """Frame by frame: strongest bin of each band, kept where no frame within reach is stronger."""
    n = 1 + max(0, -(-(len(samples) - media.FRAME) // media.HOP))
    form = np.zeros((n - 1) * media.HOP + media.FRAME, np.float32)
    form[: len(samples)] = samples - np.float32(samples.mean())
    window, ends, best = np.hanning(media.FRAME).astype(np.float32), [8, 24, 56, 129], []
    for i in range(n):
        power = np.abs(np.fft.rfft(form[i * media.HOP : i * media.HOP + media.FRAME] * window)).astype(np.float32)
        best.append([max((power[k], -k) for k in range(lo, hi)) for lo, hi in zip([1, 8, 24, 56], ends, strict=True)])
    return [(i, -best[i][b][1]) for i in range(n) for b in range(4) if best[i][b][0] > 1e-3 and all(best[i][b][0] >= best[j][b][0] for j in range(max(0, i - 3), min(n, i + 4)))]


def test_peaks_against_brute_force():
    samples = np.frombuffer(("Some words of text, then more. " * 60).encode(), np.uint8).astype(np.float32) + np.arange(1860) % 11
    frame, bins = media.peaks(samples)
    assert list(zip(frame.tolist(), bins.tolist(), strict=True)) == brute_peaks(samples)
