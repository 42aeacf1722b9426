"""Audio columns: lossless 8-bit samples, log-mel tensors and energy segments.

A payload is stored as an 8-bit mono WAV file, a binary column of a table.  Features are computed from the
bytes as read back from it: polyphase resampling, overlapped frames, log-mel filterbanks, and segments found by hysteresis
on the frame energy.  Every segment has a time span and a fixed-shape tensor (PATCH x MELS); a document's are stored
as an Arrow IPC stream with columns start_s, end_s and tensor, of Arrow's fixed-shape tensor type.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .runtime import prepare, stored
from .textkit import as_bytes

RATE, DOWN, UP, TAPS = 16_000, 2, 1, 16
FRAME, HOP, FFT, MELS, PATCH = 200, 100, 256, 24, 8
#: Hysteresis: a segment begins where a frame is over HIGH dB above the median energy, and ends where one is below LOW dB above it.
HIGH_DB, LOW_DB = 0.3, 0.05
CHUNK = 4096


def padded(payload: bytes) -> bytes:
    """Zero bytes up to a positive multiple of 64."""
    return payload + b"\0" * (-len(payload) % 64 if payload else 64)


#: Bytes before the samples of a file.
HEAD = 44


def to_wav(samples: bytes, rate: int = RATE) -> bytes:
    """An 8-bit mono PCM file; the samples are kept as they are."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(samples))
    return head + samples


def from_wav(media: bytes) -> tuple[bytes, int]:
    """Samples and rate of a file made by ``to_wav``."""
    if media[:4] != b"RIFF" or media[8:16] != b"WAVEfmt " or media[36:40] != b"data":
        raise ValueError("not an 8-bit PCM file")
    rate, size = struct.unpack_from("<I", media, 24)[0], struct.unpack_from("<I", media, 40)[0]
    return media[44:44 + size], rate


@lru_cache(8)
def _phases(up: int, down: int) -> tuple[tuple[np.ndarray, ...], int]:
    """Polyphase branches of a windowed-sinc low-pass filter, and its delay."""
    n = 2 * TAPS * max(up, down) // 2 * 2 + 1
    t = np.arange(n) - n // 2
    cut = 1 / max(up, down)
    h = (cut * np.sinc(cut * t) * np.hamming(n) * up).astype(np.float32)
    return tuple(h[p::up] for p in range(up)), n // 2


def resample(x: np.ndarray, up: int = UP, down: int = DOWN) -> np.ndarray:
    """``x`` at up/down times its rate: output m is branch (m*down) % up at input (m*down) // up; the ends are zeros."""
    branches, delay = _phases(up, down)
    m = -(-len(x) * up // down)
    out = np.zeros(m, np.float32)
    long = max(map(len, branches))
    edge = np.concatenate([np.zeros(long, np.float32), x, np.zeros(long + down, np.float32)])
    for first in range(up):  # outputs first, first + up, ... share a branch
        at = first * down + delay
        own, start = branches[at % up], at // up + long
        n = len(range(first, m, up))
        total = np.zeros(n, np.float32)
        for k, c in enumerate(own):
            lo = start - k
            part = edge[max(lo, 0):][::down][:n] if lo >= 0 else edge[lo % down:][::down][:n]
            total[: len(part)] += c * part
        out[first::up] = total
    return out


@lru_cache(4)
def _mel(rate: float) -> np.ndarray:
    """FFT bins x MELS triangular filters, even on the mel scale."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(60.0), mel(rate / 2), MELS + 2) / 2595) - 1)
    f = np.arange(FFT // 2 + 1) * rate / FFT
    low, mid, high = edges[:-2], edges[1:-1], edges[2:]
    return np.maximum(0, np.minimum((f[:, None] - low) / (mid - low), (high - f[:, None]) / (high - mid))).astype(np.float32)


#: Without zeros at its ends, so that every sample counts.
_HANN = np.hanning(FRAME + 2)[1:-1].astype(np.float32)


def log_mel(x: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """Frames x MELS log energies, and frame energies in dB; zeros are added up to a whole frame and whole hops, so every sample is in a frame."""
    x = np.concatenate([x, np.zeros(max(FRAME - len(x), (FRAME - len(x)) % HOP), np.float32)])
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    mel, energy = np.empty((len(frames), MELS), np.float32), np.empty(len(frames), np.float32)
    for lo in range(0, len(frames), CHUNK):
        own = frames[lo:lo + CHUNK] * _HANN
        wave = np.fft.rfft(own, FFT)
        power = (wave.real**2 + wave.imag**2).astype(np.float32, copy=False)
        mel[lo:lo + CHUNK] = np.log(power @ _mel(rate) + 1e-6)
        energy[lo:lo + CHUNK] = 10 * np.log10(np.einsum("ij,ij->i", own, own) + 1e-9)
    return mel, energy


def segments(energy: np.ndarray) -> np.ndarray:
    """(first, after last) frames of each active stretch."""
    level = np.median(energy)
    event = np.where(energy > level + HIGH_DB, 1, np.where(energy < level + LOW_DB, -1, 0))
    last = np.maximum.accumulate(np.where(event != 0, np.arange(len(event)), -1))
    on = (last >= 0) & (event[np.maximum(last, 0)] > 0)
    edge = np.diff(np.concatenate(([False], on, [False])).astype(np.int8))
    return np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)], 1)


def analyse(media: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Time spans (n x 2, seconds), tensors (n x PATCH x MELS) and frames x MELS of a stored file.

    A segment's tensor holds the means of PATCH equal parts of its frames.
    """
    samples, rate = from_wav(media)
    x = (np.frombuffer(samples, np.uint8).astype(np.float32) - 128) / 128
    low = rate * UP / DOWN
    mel, energy = log_mel(resample(x), low)
    spans = segments(energy)
    sums = np.concatenate([np.zeros((1, MELS)), np.cumsum(mel, 0, dtype=np.float64)])
    cuts = spans[:, :1] + (spans[:, 1:] - spans[:, :1]) * np.arange(PATCH + 1) // PATCH
    lo, hi = cuts[:, :-1], np.maximum(cuts[:, 1:], cuts[:, :-1] + 1)
    tensors = ((sums[hi] - sums[lo]) / (hi - lo)[..., None]).astype(np.float32)
    return np.stack([spans[:, 0] * HOP / low, ((spans[:, 1] - 1) * HOP + FRAME) / low], 1), tensors, mel


#: Log energies to about three digits, in half the space.
KIND = pa.fixed_shape_tensor(pa.float16(), (PATCH, MELS))
TENSORS = pa.schema([("start_s", pa.float64()), ("end_s", pa.float64()), ("tensor", KIND)])


def to_ipc(spans: np.ndarray, tensors: np.ndarray) -> bytes:
    """An Arrow IPC stream of segments: time spans and fixed-shape tensors."""
    storage = pa.FixedSizeListArray.from_arrays(pa.array(tensors.reshape(-1).astype(np.float16)), PATCH * MELS)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, TENSORS) as writer:
        writer.write_batch(pa.RecordBatch.from_arrays([pa.array(spans[:, 0].astype(np.float64)), pa.array(spans[:, 1].astype(np.float64)), pa.ExtensionArray.from_storage(KIND, storage)], schema=TENSORS))
    return sink.getvalue().to_pybytes()


def from_ipc(stored_bytes: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Time spans and tensors (n x PATCH x MELS) of a stream of ``to_ipc``."""
    found = pa.ipc.open_stream(stored_bytes).read_all()
    spans = np.stack([found.column(c).to_numpy() for c in ("start_s", "end_s")], 1)
    parts = [c.to_numpy_ndarray() for c in found.column("tensor").chunks if len(c)]
    return spans, np.concatenate([np.empty((0, PATCH, MELS), np.float16), *parts])


def digest(spans: np.ndarray, tensors: np.ndarray, frames: int, mean: float) -> str:
    """Frames, segments, mean level and a hash of the rounded features."""
    whole = hashlib.sha256(np.round(spans, 3).tobytes() + np.round(tensors.astype(np.float32) * 8).astype(np.int16).tobytes()).hexdigest()[:32]
    return f"frames={frames};segments={len(spans)};mean={mean:.2f};sha={whole}"


def store_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each document's payload as a WAV file, written to a table in the shared folder.

    A null text is empty (64 zero bytes).  Equal texts give equal files, repeated rows a row each; other columns are ignored.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([to_wav(padded(t)) for t in texts], pa.binary())], ["doc_id", "n_bytes", "media"])

    return stored(docs.select("doc_id", "text").mapInArrow(run, T.StructType([docs.schema["doc_id"], T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])), "media")


def audio_features(media_table: DataFrame) -> DataFrame:
    """(doc_id, segments, frames, mean, tensors) of each row of (doc_id, media), and its other columns but the media.

    ``tensors`` is an Arrow IPC stream of the segments' time spans and fixed-shape tensors, which ``from_ipc`` reads; mean is that of all log
    energies.  A null file gives nulls.  Columns of these names are replaced.
    """
    prepare(media_table.sparkSession)
    more = [T.StructField("segments", T.LongType()), T.StructField("frames", T.LongType()), T.StructField("mean", T.DoubleType()), T.StructField("tensors", T.BinaryType())]
    own = [c for c in media_table.columns if c != "media" and c not in {f.name for f in more}]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [None if media is None else analyse(media) for media in batch.column(len(own)).to_pylist()]
            value = lambda f, kind: pa.array([None if x is None else f(x) for x in found], kind)  # noqa: E731,B023
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(own)], value(lambda x: len(x[0]), pa.int64()), value(lambda x: len(x[2]), pa.int64()), value(lambda x: float(x[2].mean()), pa.float64()), value(lambda x: to_ipc(*x[:2]), pa.binary())],
                [*own, *[f.name for f in more]],
            )

    return media_table.select(*own, "media").mapInArrow(run, T.StructType([*[media_table.schema[c] for c in own], *more]))


_OUT = pa.schema([("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])


def media_digests(docs: DataFrame) -> DataFrame:
    """A digest row for each document: its payload as read back from the stored file, the file, and its features as read back from the stored tensors.

    A null text is empty (64 zero bytes).  Equal texts give equal values, repeated rows a row each;
    other columns of ``docs`` are ignored.
    """
    media = store_media(docs)
    marked = media.select("doc_id", "n_bytes", "media", (F.octet_length("media") - HEAD).cast("long").alias("payload_bytes"), F.sha2(F.substring("media", HEAD + 1, 2**31 - 1), 256).alias("payload_sha256"), F.crc32(F.substring("media", -64, 64)).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"))
    features = stored(audio_features(marked), "media-features")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.names.index
            text = [digest(*from_ipc(t), n, m) for t, n, m in zip(*[batch.column(at(c)).to_pylist() for c in ("tensors", "frames", "mean")])]
            yield pa.RecordBatch.from_arrays([*[batch.column(at(c)) for c in ("doc_id", *_OUT.names[:-1])], pa.array(text, pa.string())], ["doc_id", *_OUT.names])

    out = T.StructType([docs.schema["doc_id"], *[T.StructField(f.name, T.StringType() if f.type == pa.string() else T.LongType()) for f in _OUT]])
    return features.mapInArrow(run, out)
