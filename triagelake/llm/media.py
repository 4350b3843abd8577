"""Media columns: texts as 8-bit WAV, spectra and spectral-peak pair fingerprints.

A text's UTF-8 bytes, padded with zeros to a positive multiple of 64, are stored as unsigned 8-bit
mono samples by the wave module and read back from the stored bytes. Features come from what was
read: a short-time Fourier transform (Hann window of ``FRAME`` samples, hop ``HOP``), the strongest
local maxima of each frame, and pairs of peaks up to ``REACH`` frames apart, each packed with its
time into one integer: time << 24 | f1 << 14 | f2 << 4 | gap.

Defined cases: null text is the empty text (64 zero samples, no peaks); equal texts give equal
values; texts up to the format's 4 GB; rows are independent, so ties, repeated rows and extra
columns need no rule.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import prepare, read

UNIT, RATE = 64, 8000
FRAME, HOP, PEAKS, REACH = 512, 256, 2, 3
_WINDOW = np.hanning(FRAME).astype(np.float32)
BLOCK = 4096


def payload(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode()
    size = max(UNIT, -(-len(raw) // UNIT) * UNIT)
    return raw.ljust(size, b"\0"), len(raw)


def to_wav(samples: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(samples)
    return out.getvalue()


def from_wav(stored: bytes) -> bytes:
    with wave.open(io.BytesIO(stored), "rb") as w:
        if (w.getnchannels(), w.getsampwidth()) != (1, 1):
            raise ValueError("not 8-bit mono")
        return w.readframes(w.getnframes())


def spectra(samples: np.ndarray) -> Iterator[np.ndarray]:
    """Magnitudes of the frames, in blocks of frames; the last frame is padded."""
    frames = 1 + max(0, -(-(len(samples) - FRAME) // HOP))
    padded = np.zeros((frames - 1) * HOP + FRAME, np.float32)
    padded[: len(samples)] = samples
    view = np.lib.stride_tricks.sliding_window_view(padded, FRAME)[::HOP]
    for i in range(0, frames, BLOCK):
        yield np.abs(np.fft.rfft(view[i : i + BLOCK] * _WINDOW, axis=1)).astype(np.float32)


def fingerprints(samples: bytes) -> np.ndarray:
    """Time-coded peak pairs in order of time, then of their code."""
    x = np.frombuffer(samples, np.uint8).astype(np.float32) - 128
    tops, real = [], []
    for mags in spectra(x):
        mid = mags[:, 1:-1]
        mid = np.where((mid > mags[:, :-2]) & (mid >= mags[:, 2:]), mid, 0)
        best = np.empty((len(mid), PEAKS), np.int64)
        strong = np.empty((len(mid), PEAKS), bool)
        rows = np.arange(len(mid))
        for p in range(PEAKS):
            best[:, p] = mid.argmax(1)
            strong[:, p] = mid[rows, best[:, p]] > 1e-3
            mid[rows, best[:, p]] = 0
        tops.append(best + 1)
        real.append(strong)
    f, ok = np.concatenate(tops), np.concatenate(real)
    out = []
    for gap in range(1, REACH + 1):
        if len(f) > gap:
            t = np.arange(len(f) - gap)
            for a in range(PEAKS):
                for b in range(PEAKS):
                    code = (t << 24) | (f[:-gap, a] << 14) | (f[gap:, b] << 4) | gap
                    out.append(code[ok[:-gap, a] & ok[gap:, b]])
    return np.sort(np.concatenate(out)) if out else np.empty(0, np.int64)


NEW = [("n_bytes", T.LongType()), ("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()), ("media_bytes", T.LongType()), ("media_sha256", T.StringType()), ("feature", T.StringType())]


def media(docs: DataFrame, text_col: str = "text", keep: bool = True) -> DataFrame:
    """docs without the text and with the digests; if kept, also the stored form (``media``) and ``fingerprints``.

    Columns that bear a new column's name are replaced."""
    prepare(docs.sparkSession)
    new = [T.StructField(n, t) for n, t in NEW] + ([T.StructField("media", T.BinaryType()), T.StructField("fingerprints", T.ArrayType(T.LongType()))] if keep else [])
    taken = {f.name for f in new} | {text_col}
    carried = [f for f in docs.schema if f.name not in taken]
    names = [f.name for f in carried]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(text_col).to_pylist():
                data, n = payload(text)
                stored = to_wav(data)
                back = from_wav(stored)
                prints = fingerprints(back)
                feature = f"{len(prints)}:{hashlib.sha256(prints.astype('<i8').tobytes()).hexdigest()}"
                rows.append((n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(stored), hashlib.sha256(stored).hexdigest(), feature, *((stored, prints) if keep else ())))
            columns = list(zip(*rows)) if rows else [[] for _ in new]
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([*[batch.column(x) for x in names], *[pa.array(list(c), t) for c, t in zip(columns, types)]], names=[*names, *[f.name for f in new]])

    return docs.mapInArrow(run, T.StructType([*carried, *new]))


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media(read(spark, sf_dir, "documents").select("doc_id", "text"), keep=False)
