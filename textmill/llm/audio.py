"""Media columns: 8-bit audio and its features.

A payload is stored losslessly as a mono WAV file of unsigned 8-bit samples. The features are
computed from the stored bytes, in blocks of frames: polyphase resampling to half the rate,
overlapped log-mel filterbanks, and segments by hysteresis of the frames' energy. The filterbanks
are stored as Arrow batches whose field `tensor` has the fixed-shape tensor type, with the time
span of each tensor beside it.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.llm.common import map_arrow, steps

RATE, UP, DOWN = 16_000, 1, 2
#: Frame and hop in resampled samples, mel bands, and frames in a tensor.
FRAME, HOP, BANDS, PATCH = 256, 128, 20, 32
UNIT = 64
#: Frames computed at once, and the steps of a log-mel value: coarser than what processors differ by.
BLOCK, STEPS = 4096, 64
HEADER = struct.Struct("<4sI4s4sIHHIIHH4sI")
SCHEMA = "doc_id long, media binary, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, n_frames long, tensors binary, segments array<struct<start_s:double,end_s:double>>"


def write_wav(samples: bytes) -> bytes:
    return HEADER.pack(b"RIFF", 36 + len(samples), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(samples)) + samples


def read_wav(stored: bytes) -> bytes:
    riff, _, wave, _, _, kind, channels, rate, _, _, bits, data, size = HEADER.unpack_from(stored)
    if (riff, wave, data, kind, channels, rate, bits) != (b"RIFF", b"WAVE", b"data", 1, 1, RATE, 8) or len(stored) != HEADER.size + size:
        raise ValueError("not a mono 8-bit WAV file of the expected rate")
    return stored[HEADER.size :]


def low_pass(taps: int = 32, cut: float = 0.5 * UP / DOWN) -> np.ndarray:
    """A windowed sinc; cut is in cycles a sample of the input rate."""
    t = np.arange(taps) - (taps - 1) / 2
    h = 2 * cut * np.sinc(2 * cut * t) * np.hamming(taps)
    return h / h.sum()


def resample(x: np.ndarray, h: np.ndarray) -> np.ndarray:
    """x at half the rate: each phase of the filter meets only its own samples."""
    x = x if len(x) % DOWN == 0 else np.append(x, 0.0)
    n = len(x) // DOWN
    total = np.zeros(n + len(h) // DOWN - 1)
    for phase in range(DOWN):
        total += np.convolve(x[DOWN - 1 - phase :: DOWN], h[phase::DOWN])
    return total[:n]


def mel_bank(rate: float = RATE * UP / DOWN) -> np.ndarray:
    """Triangles, evenly spaced in mel, over the bins of a frame's spectrum."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    hz = 700 * (10 ** (np.linspace(mel(0), mel(rate / 2), BANDS + 2) / 2595) - 1)
    bins = np.fft.rfftfreq(FRAME, 1 / rate)
    up = (bins[:, None] - hz[None, :-2]) / (hz[1:-1] - hz[:-2])
    down = (hz[None, 2:] - bins[:, None]) / (hz[2:] - hz[1:-1])
    return np.maximum(0, np.minimum(up, down))


LOW_PASS, MEL_BANK, WINDOW = low_pass(), mel_bank(), np.hanning(FRAME)
STEP_S = HOP / (RATE * UP / DOWN)
FRAME_S = FRAME / (RATE * UP / DOWN)


def resampled(samples: np.ndarray, start: int, end: int) -> np.ndarray:
    """Values start to before end of the resampled signal of 8-bit samples, of which only those needed are read."""
    first = max(0, start - len(LOW_PASS) // DOWN)
    x = (samples[first * DOWN : end * DOWN].astype(np.float64) - 128) / 128
    return resample(x, LOW_PASS)[start - first : end - first] if len(x) else x


def features(samples: bytes) -> tuple[np.ndarray, list[tuple[float, float]]]:
    """(log-mel frames, segments in seconds)."""
    raw = np.frombuffer(samples, np.uint8)
    total = -(-len(raw) // DOWN)
    n = max(1, 1 + -(-(total - FRAME) // HOP)) if total > FRAME else 1
    logmel, energy = np.empty((n, BANDS), np.float32), np.empty(n)
    for a in range(0, n, BLOCK):
        b = min(n, a + BLOCK)
        x = resampled(raw, a * HOP, min(total, (b - 1) * HOP + FRAME))
        x = np.pad(x, (0, FRAME + (b - a - 1) * HOP - len(x)))
        frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
        power = np.abs(np.fft.rfft(frames * WINDOW, axis=1)) ** 2
        logmel[a:b] = np.round(np.log10(power @ MEL_BANK + 1e-6) * STEPS) / STEPS
        energy[a:b] = np.round(np.log10(power.sum(1) + 1e-6) * STEPS) / STEPS
    # Hysteresis: a run of frames over the low mark counts if one of them is over the high mark.
    mean, spread = energy.mean(), energy.std()
    low, high = energy > mean - 0.25 * spread, energy > mean + 0.5 * spread
    edges = np.flatnonzero(np.diff(np.concatenate([[False], low, [False]]).astype(np.int8)))
    reached = np.concatenate([[0], np.cumsum(high)])
    segments = [(round(a * STEP_S, 6), round((b - 1) * STEP_S + FRAME_S, 6)) for a, b in zip(edges[::2], edges[1::2], strict=True) if reached[b] > reached[a]]
    return logmel, segments


TENSOR = pa.fixed_shape_tensor(pa.float32(), (PATCH, BANDS), dim_names=("frame", "band"))
STORED = pa.schema([("tensor", TENSOR), ("start_s", pa.float64()), ("end_s", pa.float64())])


def store_tensors(logmel: np.ndarray) -> bytes:
    """An Arrow stream of one batch of the schema STORED: the frames in tensors of PATCH frames, the last one filled up with the floor value."""
    patches = -(-len(logmel) // PATCH)
    values = np.full((patches * PATCH, BANDS), -6.0, "<f4")
    values[: len(logmel)] = logmel
    storage = pa.FixedSizeListArray.from_arrays(pa.array(values.ravel()), PATCH * BANDS)
    spans = [(round(i * PATCH * STEP_S, 6), round((min(len(logmel), (i + 1) * PATCH) - 1) * STEP_S + FRAME_S, 6)) for i in range(patches)]
    batch = pa.record_batch([pa.ExtensionArray.from_storage(TENSOR, storage), pa.array([x[0] for x in spans]), pa.array([x[1] for x in spans])], schema=STORED)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, STORED) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def read_tensors(stored: bytes) -> pa.Table:
    """The tensors of one row with their spans; to_numpy_ndarray() of the column's chunk gives (n, frames, bands)."""
    table = pa.ipc.open_stream(stored).read_all()
    if not table.schema.equals(STORED):
        raise ValueError("not a stream of log-mel tensors")
    return table


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))
    kinds = {"media": pa.binary(), "n_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "n_frames": pa.int64(), "tensors": pa.binary(), "segments": span}
    for batch in steps(batches, "text"):
        rows: dict[str, list] = {k: [] for k in kinds}
        for text in batch.column("text").to_pylist():
            raw = (text or "").encode()
            media = write_wav(raw + bytes(-len(raw) % UNIT if raw else UNIT))
            payload = read_wav(media)
            logmel, segments = features(payload)
            own = {"media": media, "n_bytes": len(raw), "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-UNIT:]), "n_frames": len(logmel), "tensors": store_tensors(logmel)}
            own["segments"] = [{"start_s": a, "end_s": b} for a, b in segments]
            for k, v in own.items():
                rows[k].append(v)
        yield pa.record_batch({"doc_id": batch.column("doc_id")} | {k: pa.array(rows[k], kind) for k, kind in kinds.items()})


def audio_features(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's text as audio, and its features.

    One row out for each row in: media (the WAV file), sizes and checksums of the payload that
    was read back, n_frames, tensors (an Arrow stream with a field of fixed-shape float32 tensors
    and their time spans, see read_tensors) and the segments. Log-mel values are multiples of
    1 / STEPS, so that equal texts have equal values on processors that round differently, unless
    one lies on the very edge of two. A null or empty text is 64 zero bytes. Null ids are carried
    along, repeated rows stay, other columns are left out; an empty table gives an empty result.
    No shuffle; batches are bounded, and a longer text is held whole with its samples as bytes.
    """
    return map_arrow(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), _run, SCHEMA)
