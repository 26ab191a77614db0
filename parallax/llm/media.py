"""Media columns: audio features of payloads stored losslessly as 8-bit samples.

``store`` writes bytes as an 8-bit mono wave file into a binary column; ``analyse`` reads such files back and computes
features: polyphase resampling, log-mel filterbanks of overlapping frames, and segments of sound by an energy threshold
with hysteresis. Features are kept as fixed-shape tensors (frames by bands) in an Arrow stream with a time span each.

Defined cases: a null text is empty; the payload of an empty text is one block of blanks; a signal shorter than a frame
is padded to one; silence has no segments; repeated rows and equal texts get equal values; other columns are ignored.
A file that is not such a wave file raises an error rather than being skipped.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parallax.llm.common import bound_batches, sub_batches

BLOCK = 192
SOURCE_RATE, UP, DOWN = 16_000, 1, 2
RATE = SOURCE_RATE * UP // DOWN
FRAME, HOP, FFT, BANDS = 200, 80, 256, 24
#: Frames of one tensor.
TENSOR_FRAMES = 32
#: Decibels above the median energy at which a segment begins, and at which it ends.
ON_DB, OFF_DB = 0.4, -0.1
#: Steps of a natural log unit that the digest of features tells apart.
STEPS = 8
STORED = "doc_id long, n_bytes long, media binary"
ANALYSED = "doc_id long, n_bytes long, media binary, payload binary, frames long, segments array<struct<start_ms:int,end_ms:int>>, tensors binary, digest string"


def wave_file(payload: bytes, rate: int = SOURCE_RATE) -> bytes:
    """A RIFF file of unsigned 8-bit mono samples."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload) + len(payload) % 2, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload))
    return head + payload + b"\0" * (len(payload) % 2)


def wave_samples(media: bytes) -> bytes:
    """The samples of such a file, found by its chunks."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a wave file")
    at = 12
    while at + 8 <= len(media):
        kind, size = struct.unpack_from("<4sI", media, at)
        if kind == b"fmt " and struct.unpack_from("<HH", media, at + 8) + struct.unpack_from("<H", media, at + 22) != (1, 1, 8):
            raise ValueError("not 8-bit mono samples")
        if kind == b"data":
            return media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("a wave file without samples")


def lowpass(up: int = UP, down: int = DOWN, half: int = 8) -> np.ndarray:
    """A windowed sinc that passes what both rates can hold; its gain is up."""
    widest = max(up, down)
    t = np.arange(-half * widest, half * widest + 1)
    h = np.sinc(t / widest) * np.kaiser(len(t), 5.0)
    return (h * up / h.sum()).astype(np.float32)


def resample(x: np.ndarray, h: np.ndarray, up: int = UP, down: int = DOWN) -> np.ndarray:
    """Polyphase: each output sample meets only those taps that fall on input samples."""
    centre, n = len(h) // 2, -(-len(x) * up // down)
    y = np.empty(n, dtype=np.float32)
    per = -(-len(h) // up)
    padded = np.concatenate([np.zeros(per, np.float32), x, np.zeros(per + 1, np.float32)])
    for first in range(min(up, n)):
        phase = (first * down + centre) % up
        taps, base = h[phase::up], (first * down + centre) // up + per
        count = len(range(first, n, up))
        own = np.zeros(count, dtype=np.float32)
        for k, tap in enumerate(taps):
            own += tap * padded[base - k : base - k + down * (count - 1) + 1 : down]
        y[first::up] = own
    return y


def mel_bank() -> np.ndarray:
    """Triangles evenly spaced in mel, (bins, bands)."""
    mel = lambda f: 2595 * np.log10(1 + np.asarray(f, dtype=float) / 700)
    edges = 700 * (10 ** (np.linspace(0, mel(RATE / 2), BANDS + 2) / 2595) - 1)
    f = np.arange(FFT // 2 + 1) * RATE / FFT
    rise = (f[:, None] - edges[:-2]) / (edges[1:-1] - edges[:-2])
    fall = (edges[2:] - f[:, None]) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(rise, fall)).astype(np.float32)


_TAPS, _MEL, _HANN = lowpass(), mel_bank(), np.hanning(FRAME).astype(np.float32)


def log_mel(y: np.ndarray) -> np.ndarray:
    """(frames, bands) of overlapping frames; a rest shorter than a hop adds no frame."""
    if len(y) < FRAME:
        y = np.concatenate([y, np.zeros(FRAME - len(y), np.float32)])
    frames = np.lib.stride_tricks.sliding_window_view(y, FRAME)[::HOP]
    out = np.empty((len(frames), BANDS), dtype=np.float32)
    for at in range(0, len(frames), 2048):
        power = np.abs(np.fft.rfft(frames[at : at + 2048] * _HANN, FFT)) ** 2
        out[at : at + 2048] = np.log(power.astype(np.float32) @ _MEL + 1e-6)
    return out


def segments(energy_db: np.ndarray) -> list[tuple[int, int]]:
    """Frames [first, last] of segments: begun above the upper threshold, held until below the lower."""
    middle = np.median(energy_db)
    mark = np.where(energy_db >= middle + ON_DB, 1, np.where(energy_db < middle + OFF_DB, 0, -1))
    last = np.maximum.accumulate(np.where(mark >= 0, np.arange(len(mark)), 0))
    on = np.concatenate([[0], np.maximum(mark[last], 0), [0]])
    edge = np.diff(on)
    return list(zip(np.flatnonzero(edge == 1).tolist(), (np.flatnonzero(edge == -1) - 1).tolist()))


def ms(frame):
    """The time at which a frame begins."""
    return frame * HOP * 1000 // RATE


_TENSOR = pa.fixed_shape_tensor(pa.float32(), [TENSOR_FRAMES, BANDS])
_STREAM = pa.schema([("log_mel", _TENSOR), ("start_ms", pa.int32()), ("end_ms", pa.int32()), ("frames", pa.int32())])
_BEGIN, _END = _STREAM.serialize().to_pybytes(), b"\xff\xff\xff\xff\0\0\0\0"


def tensors(mel: np.ndarray) -> bytes:
    """An Arrow stream: fixed-shape tensors with their time spans and number of true frames."""
    n = -(-len(mel) // TENSOR_FRAMES)
    full = np.zeros((n * TENSOR_FRAMES, BANDS), dtype=np.float32)
    full[: len(mel)] = mel
    first = np.arange(n, dtype=np.int32) * TENSOR_FRAMES
    own = np.minimum(TENSOR_FRAMES, len(mel) - first)
    storage = pa.FixedSizeListArray.from_arrays(pa.array(full.reshape(-1)), TENSOR_FRAMES * BANDS)
    columns = [pa.ExtensionArray.from_storage(_TENSOR, storage), *map(pa.array, (ms(first), (ms(first + own - 1) + FRAME * 1000 // RATE), own.astype(np.int32)))]
    return _BEGIN + pa.RecordBatch.from_arrays(columns, schema=_STREAM).serialize().to_pybytes() + _END


def features(payload: bytes) -> tuple[np.ndarray, list[tuple[int, int]], str]:
    """Log-mel frames, segments in milliseconds, and a digest of both."""
    x = np.frombuffer(payload, dtype=np.uint8).astype(np.float32)
    x = (x - 128) / 128
    y = resample(x, _TAPS)
    mel = log_mel(y)
    energy = 10 / np.log(10) * np.log(np.exp(mel).sum(axis=1) + 1e-9)
    spans = [(ms(a), ms(b) + FRAME * 1000 // RATE) for a, b in segments(energy)]
    digest = hashlib.sha256(np.rint(mel * STEPS).astype("<i2").tobytes() + repr(spans).encode()).hexdigest()
    return mel, spans, digest


def store(docs: DataFrame, *, block: int = BLOCK) -> DataFrame:
    """doc_id, n_bytes, media: each text's bytes, filled with blanks to whole blocks, as a wave file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sub_batches(batch, "text", 4 << 20):
                raw = [t or b"" for t in part.column("text").cast(pa.binary()).to_pylist()]
                media = [wave_file(t + b" " * (max(1, -(-len(t) // block)) * block - len(t))) for t in raw]
                yield pa.record_batch([part.column("doc_id"), pa.array(map(len, raw), pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    bound_batches(docs)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, STORED)


def analyse(media: DataFrame) -> DataFrame:
    """media with the payload read back, features as tensors, segments and a digest."""
    names = [x.split()[0] for x in ANALYSED.replace(":int,", ":int;").replace(", ", ",").split(",")]
    span = pa.list_(pa.struct([("start_ms", pa.int32()), ("end_ms", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sub_batches(batch, "media", 2 << 20):
                cols: list[list] = [[], [], [], [], []]
                for m in part.column("media").to_pylist():
                    payload = wave_samples(m)
                    mel, spans, digest = features(payload)
                    row = (payload, len(mel), [{"start_ms": a, "end_ms": b} for a, b in spans], tensors(mel), digest)
                    for c, v in zip(cols, row):
                        c.append(v)
                kinds = (pa.binary(), pa.int64(), span, pa.binary(), pa.string())
                yield pa.record_batch([part.column("doc_id"), part.column("n_bytes"), part.column("media"), *[pa.array(c, k) for c, k in zip(cols, kinds)]], names=names)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, ANALYSED)


def report(docs: DataFrame) -> DataFrame:
    """Per document: sizes and digests of the stored form and of the payload read back from it, and the features' digest."""
    own = analyse(store(docs))
    return own.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, greatest(1, octet_length(payload) - 15), 16)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat(F.lit("frames="), F.col("frames"), F.lit(";segments="), F.size("segments"), F.lit(";log_mel="), F.col("digest")).alias("feature"),
    )
