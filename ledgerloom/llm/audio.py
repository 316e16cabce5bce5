"""Audio columns: lossless 8-bit samples in, fixed-shape log-mel tensors out.

The bytes of a text, padded to whole frames, are the samples of a mono 8-bit
WAV file. Features are computed from the stored file: polyphase resampling,
log-mel energies of overlapping frames, and segments by energy with hysteresis.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import text_or_empty

FRAME_BYTES = 192
_SAMPLES_AT_ONCE = 1 << 20


@dataclass(frozen=True)
class AudioParameters:
    rate: int = 16_000
    up: int = 1
    down: int = 2
    taps: int = 8  # of the filter, on each side, in units of the slower rate
    frame: int = 256
    hop: int = 128
    mels: int = 24
    tensor_frames: int = 16
    open_db: float = -18.0  # a segment begins at this energy, relative to full scale
    close_db: float = -24.0  # and ends below this one

    @property
    def out_rate(self) -> int:
        return self.rate * self.up // self.down


def payload_of(text: str | None) -> tuple[bytes, int]:
    """(UTF-8 bytes with spaces up to a positive multiple of 192, bytes before)."""
    raw = (text or "").encode("utf-8")
    return raw + b" " * (-len(raw) % FRAME_BYTES or FRAME_BYTES * (not raw)), len(raw)


def store_wav(payload: bytes, rate: int) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1), w.setsampwidth(1), w.setframerate(rate)
        w.writeframes(payload)
    return out.getvalue()


def read_wav(stored: bytes) -> bytes:
    with wave.open(io.BytesIO(stored), "rb") as r:
        return r.readframes(r.getnframes())


@lru_cache(maxsize=8)
def _phases(up: int, down: int, taps: int) -> np.ndarray:
    """The low-pass filter's polyphase branches: row r has the filter at times
    r - j * up, j = -J .. J, as it meets the input from left to right."""
    slow = max(up, down)
    half = -(-taps * slow // up)
    t = np.arange(up)[:, None] + up * np.arange(half, -half - 1, -1)[None, :]
    h = np.where(np.abs(t) <= taps * slow, np.sinc(t / slow) * (0.54 + 0.46 * np.cos(np.pi * t / (taps * slow))), 0)
    return (h / h.sum(1, keepdims=True)).astype(np.float32)


def _windows(x: np.ndarray, width: int, step: int, n: int) -> np.ndarray:
    """n views of `width` samples, `step` apart; x is contiguous and long enough."""
    return np.lib.stride_tricks.as_strided(x, (n, width), (step * x.itemsize, x.itemsize), writeable=False)


def resample(x: np.ndarray, up: int, down: int, taps: int) -> np.ndarray:
    """Polyphase resampling by up / down: each output sample is one branch of
    the filter over the input around it; nothing is computed and thrown away."""
    branches = _phases(up, down, taps)
    width = branches.shape[1]
    n_out = -(-len(x) * up // down)
    padded = np.zeros(len(x) + width + down, np.float32)
    padded[width // 2 : width // 2 + len(x)] = x
    out = np.empty(n_out, np.float32)
    for first in range(min(up, n_out)):
        at, phase = divmod(first * down, up)
        n = -(-(n_out - first) // up)
        out[first::up] = _windows(padded[at:], width, down, n) @ branches[phase]
    return out


@lru_cache(maxsize=8)
def _mel_filters(rate: int, frame: int, mels: int) -> np.ndarray:
    """Triangles of equal width on the mel scale, (frame // 2 + 1) x mels."""
    top = 2595 * np.log10(1 + rate / 2 / 700)
    edges = 700 * (10 ** (np.linspace(0, top, mels + 2) / 2595) - 1)
    freqs = np.arange(frame // 2 + 1) * rate / frame
    rise = (freqs[:, None] - edges[:-2]) / (edges[1:-1] - edges[:-2])
    fall = (edges[2:] - freqs[:, None]) / (edges[2:] - edges[1:-1])
    return np.clip(np.minimum(rise, fall), 0, None).astype(np.float32)


def log_mel(x: np.ndarray, p: AudioParameters) -> np.ndarray:
    """Frames x mels in decibels; the last frame is padded with silence."""
    n = max(1, -(-(len(x) - p.frame) // p.hop) + 1)
    padded = np.zeros((n - 1) * p.hop + p.frame, np.float32)
    padded[: len(x)] = x[: len(padded)]
    frames = _windows(padded, p.frame, p.hop, n)
    window, filters = np.hanning(p.frame).astype(np.float32), _mel_filters(p.out_rate, p.frame, p.mels)
    out = np.empty((n, p.mels), np.float32)
    for at in range(0, n, 4096):
        power = np.abs(np.fft.rfft(frames[at : at + 4096] * window, axis=1)).astype(np.float32) ** 2
        out[at : at + 4096] = 10 * np.log10(power @ filters / p.frame + 1e-10)
    return out


def segments(x: np.ndarray, p: AudioParameters) -> np.ndarray:
    """(first frame, frame after the last) of what is loud: it begins at a frame
    of open_db or more and goes on while frames have close_db or more."""
    n = max(1, -(-(len(x) - p.frame) // p.hop) + 1)
    padded = np.zeros((n - 1) * p.hop + p.frame)
    padded[: len(x)] = x[: len(padded)]
    energy = np.concatenate([[0.0], np.cumsum(padded**2)])
    starts = np.arange(n) * p.hop
    db = 10 * np.log10((energy[starts + p.frame] - energy[starts]) / p.frame + 1e-10)
    held = np.concatenate([[False], db >= p.close_db, [False]])
    first, after = np.flatnonzero(held[1:] & ~held[:-1]), np.flatnonzero(~held[1:] & held[:-1])
    opens = np.flatnonzero(db >= p.open_db)
    begin = opens[np.minimum(np.searchsorted(opens, first), max(len(opens) - 1, 0))] if len(opens) else first
    loud = (begin >= first) & (begin < after) if len(opens) else np.zeros(len(first), bool)
    return np.stack([begin[loud], after[loud]], 1)


def decode(stored: bytes) -> np.ndarray:
    """Samples from -1 to 1, without their mean."""
    x = (np.frombuffer(read_wav(stored), np.uint8).astype(np.float32) - 128) / 128
    return x - np.float32(x.mean(dtype=np.float64)) if len(x) else x


def features(stored: bytes, p: AudioParameters) -> tuple[np.ndarray, np.ndarray]:
    """(frames x mels, segments) of a stored file. The signal is worked on in
    pieces of whole resampling steps, so memory follows the features."""
    x = decode(stored)
    margin = p.taps * max(p.up, p.down) * p.down
    pieces = []
    step = _SAMPLES_AT_ONCE - _SAMPLES_AT_ONCE % p.down
    for at in range(0, len(x), step):
        before = min(at, margin)
        y = resample(x[at - before : at + step + margin], p.up, p.down, p.taps)
        skip = before * p.up // p.down
        pieces.append(y[skip : skip + -(-min(step, len(x) - at) * p.up // p.down)])
    y = np.concatenate(pieces) if pieces else x
    return log_mel(y, p), segments(y, p)


def store_tensors(mel: np.ndarray, p: AudioParameters) -> bytes:
    """The frames as an Arrow stream of a fixed-shape tensor column, each tensor
    tensor_frames x mels (the last one padded with -100 dB), beside the time
    span in seconds of each."""
    n = -(-len(mel) // p.tensor_frames)
    full = np.full((n * p.tensor_frames, p.mels), -100, np.float32)
    full[: len(mel)] = mel
    column = pa.FixedShapeTensorArray.from_numpy_ndarray(full.reshape(n, p.tensor_frames, p.mels))
    first = np.arange(n) * p.tensor_frames
    after = np.minimum(first + p.tensor_frames, len(mel))
    spans = pa.StructArray.from_arrays([pa.array(first * p.hop / p.out_rate), pa.array((after * p.hop + p.frame - p.hop) / p.out_rate)], names=["start", "end"])
    table = pa.record_batch([column, spans], names=["tensor", "span"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_batch(table)
    return sink.getvalue().to_pybytes()


def read_tensors(stored: bytes) -> tuple[np.ndarray, list[dict]]:
    """(tensors x frames x mels, their time spans) of a stored stream."""
    with pa.ipc.open_stream(stored) as reader:
        table = reader.read_all()
    column = table.column("tensor").combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    return column.to_numpy_ndarray(), table.column("span").to_pylist()


SCHEMA = (
    "doc_id {id}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, "
    "frames int, segments array<struct<start:double,end:double>>, tensors binary, tensor_spans array<struct<start:double,end:double>>, feature string"
)


def audio_column(docs: DataFrame, parameters: AudioParameters = AudioParameters(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: its stored sound's sizes and hashes, its loud
    segments in seconds, its log-mel tensors as an Arrow stream with their time
    spans (read_tensors opens it), and `feature`, a digest of what is read back
    from that stream.

    Null text counts as empty, which is one frame of spaces; equal texts have
    equal values; null and repeated ids and an empty table pass through; other
    columns are ignored.
    """
    p = parameters
    span = pa.list_(pa.struct({"start": pa.float64(), "end": pa.float64()}))
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), span, pa.binary(), span, pa.string()]
    names = [c.split()[0] for c in SCHEMA.format(id="long").split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                out: list[list] = [[] for _ in kinds]
                for text in batch.column(1):
                    payload, n = payload_of(text.as_py())
                    stored = store_wav(payload, p.rate)
                    back = read_wav(stored)
                    mel, loud = features(stored, p)
                    stream = store_tensors(mel, p)
                    cubes, spans = read_tensors(stream)
                    times = [{"start": float(a * p.hop / p.out_rate), "end": float(((b - 1) * p.hop + p.frame) / p.out_rate)} for a, b in loud]
                    digest = zlib.crc32(np.round(cubes * 10).astype("<i4").tobytes())
                    feature = f"frames={len(mel)};tensors={'x'.join(map(str, cubes.shape))};segments={len(times)};seconds={spans[-1]['end']:.4f};crc={digest:08x}"
                    row = (n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), len(mel), times, stream, spans, feature)
                    for values, v in zip(out, row):
                        values.append(v)
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, k) for v, k in zip(out, kinds))], names=names)

    kind = dict(docs.dtypes)[id_col]
    narrow = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    return narrow.mapInArrow(run, SCHEMA.format(id=kind))
