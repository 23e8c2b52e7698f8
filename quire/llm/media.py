"""Media columns: audio held as WAV bytes, and features computed from the stored bytes.

A media column is binary and self-describing (RIFF/WAVE, 8-bit PCM, mono), so every
reader starts from the stored bytes and nothing else. Features are

* polyphase resampling: one windowed-sinc low-pass, split into ``up`` phases, so that
  only the samples that stay are ever computed;
* log-mel filterbanks of overlapped Hann frames;
* hysteresis segmentation of frame energy: a segment opens above the upper threshold
  and closes below the lower one;
* tensors of a fixed shape ``[frames, mels]``, each with its time span, in a column of
  Arrow's ``fixed_shape_tensor`` type. Parquet has no such type, so what a media value
  gives is stored as the Arrow stream of its table (start_ms, end_ms, n_frames, tensor).

The query writes the media column, reads it back, writes features, and reads those back.

Each signal is worked through alone, its frames in blocks of a fixed number, so equal
signals give equal features wherever they are computed and spectra never pile up.

Defined results: a null text is the empty text; the empty text is a payload of one unit
of blanks; repeated rows give repeated results; other columns of the input are left out,
whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm._common import small_batches, stored

PAYLOAD_UNIT = 192
SOURCE_HZ = 16_000
TARGET_UP, TARGET_DOWN = 1, 2
TAPS_PER_PHASE = 16
FRAME, HOP, MELS = 256, 128, 16
TENSOR_FRAMES = 32
OPEN_DB, CLOSE_DB = 0.5, -0.5  # against the signal's median frame
BLOCK_FRAMES = 4096
HEADER = struct.Struct("<4sI4s4sIHHIIHH4sI")


def wav_bytes(samples: bytes, hz: int = SOURCE_HZ) -> bytes:
    """8-bit mono PCM in a RIFF container."""
    head = HEADER.pack(b"RIFF", 36 + len(samples), b"WAVE", b"fmt ", 16, 1, 1, hz, hz, 1, 8, b"data", len(samples))
    return head + samples


def wav_samples(media: bytes) -> tuple[bytes, int]:
    """(samples, rate) of stored bytes, found by walking the container's chunks."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE value")
    at, hz, found = 12, 0, None
    while at + 8 <= len(media) and found is None:
        kind, length = media[at : at + 4], int.from_bytes(media[at + 4 : at + 8], "little")
        if kind == b"fmt ":
            code, channels, hz, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (code, channels, bits) != (1, 1, 8):
                raise ValueError("only 8-bit mono PCM is stored here")
        elif kind == b"data":
            found = media[at + 8 : at + 8 + length]
        at += 8 + length + length % 2
    if found is None:
        raise ValueError("no data chunk")
    return found, hz


@lru_cache(maxsize=8)
def low_pass(up: int, down: int, per_phase: int = TAPS_PER_PHASE) -> np.ndarray:
    """Taps by phase, [up, per_phase], of a Hann-windowed sinc at the narrower Nyquist rate."""
    n = per_phase * up
    t = np.arange(n) - (n - 1) / 2
    taps = np.sinc(t / max(up, down)) * np.hanning(n + 2)[1:-1]
    return (taps / taps.sum() * up).reshape(per_phase, up).T[:, ::-1].astype(np.float32).copy()


def resample(x: np.ndarray, up: int = TARGET_UP, down: int = TARGET_DOWN) -> np.ndarray:
    """Polyphase resampling by up/down; ceil(len * up / down) samples, zero beyond the ends."""
    phases = low_pass(up, down)
    width = phases.shape[1]
    n = -(-len(x) * up // down)
    if n == 0:
        return np.zeros(0, np.float32)
    padded = np.concatenate([np.zeros(width - 1, np.float32), x.astype(np.float32), np.zeros(width, np.float32)])
    windows = np.lib.stride_tricks.sliding_window_view(padded, width)
    out = np.empty(n, np.float32)
    centre = (width * up - 1) // 2
    for first in range(min(up, n)):  # every up-th output has the same phase and steps by down inputs
        at = first * down + centre
        rows = windows[at // up :: down][: len(range(first, n, up))]
        out[first::up][: len(rows)] = rows @ phases[at % up]
    return out


@lru_cache(maxsize=8)
def mel_weights(hz: int, frame: int = FRAME, mels: int = MELS) -> np.ndarray:
    """Triangular filters, [frame // 2 + 1, mels], evenly spaced on the mel scale."""
    top = 2595 * np.log10(1 + hz / 2 / 700)
    edges = 700 * (10 ** (np.linspace(0, top, mels + 2) / 2595) - 1)
    f = np.arange(frame // 2 + 1)[:, None] * hz / frame
    left, mid, right = edges[:-2], edges[1:-1], edges[2:]
    return np.maximum(0, np.minimum((f - left) / (mid - left), (right - f) / (right - mid))).astype(np.float32)


def frames_of(y: np.ndarray) -> int:
    return max(1, -(-(len(y) - FRAME) // HOP) + 1)


def log_mel(y: np.ndarray, hz: int) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel rows [frames, MELS] and frame energies in dB; the tail is padded with zeros."""
    n = frames_of(y)
    padded = np.zeros((n - 1) * HOP + FRAME, np.float32)
    padded[: len(y)] = y
    frames = np.lib.stride_tricks.sliding_window_view(padded, FRAME)[::HOP]
    window = np.hanning(FRAME + 1)[:-1].astype(np.float32)
    mel, energy = np.empty((n, MELS), np.float32), np.empty(n, np.float32)
    for a in range(0, n, BLOCK_FRAMES):
        part = frames[a : a + BLOCK_FRAMES] * window
        power = np.abs(np.fft.rfft(part, axis=1)).astype(np.float32) ** 2
        mel[a : a + BLOCK_FRAMES] = np.log10(power @ mel_weights(hz) + 1e-6)
        energy[a : a + BLOCK_FRAMES] = 10 * np.log10((part * part).mean(axis=1) + 1e-9)
    return mel, energy


def hysteresis(energy: np.ndarray, above: float, below: float) -> list[tuple[int, int]]:
    """[start, end) frames: opened by energy >= above, held while energy >= below."""
    held = energy >= below
    edges = np.flatnonzero(np.diff(np.concatenate([[0], held.astype(np.int8), [0]])))
    loud = np.concatenate([[0], np.cumsum(energy >= above)])
    found = []
    for start, end in zip(edges[::2], edges[1::2], strict=True):
        if loud[end] > loud[start]:  # it begins where it first gets loud
            found.append((int(start + np.argmax(energy[start:end] >= above)), int(end)))
    return found


def features(media: bytes) -> tuple[np.ndarray, list[tuple[int, int]], np.ndarray, list[tuple[float, float]]]:
    """(tensors [n, TENSOR_FRAMES, MELS], their spans in ms, frame counts, segments in seconds)."""
    samples, hz = wav_samples(media)
    x = (np.frombuffer(samples, np.uint8).astype(np.float32) - 128) / 128
    x -= x.mean() if len(x) else 0
    y = resample(x)
    rate = hz * TARGET_UP // TARGET_DOWN
    mel, energy = log_mel(y, rate)
    typical = float(np.median(energy))
    segments = [(a * HOP / rate, ((b - 1) * HOP + FRAME) / rate) for a, b in hysteresis(energy, typical + OPEN_DB, typical + CLOSE_DB)]
    count = -(-len(mel) // TENSOR_FRAMES)
    tensors = np.full((count * TENSOR_FRAMES, MELS), -6, np.float32)
    tensors[: len(mel)] = mel
    filled = np.minimum(TENSOR_FRAMES, len(mel) - np.arange(count) * TENSOR_FRAMES)
    spans = [(round(k * TENSOR_FRAMES * HOP * 1000 / rate), round(((k * TENSOR_FRAMES + int(f) - 1) * HOP + FRAME) * 1000 / rate)) for k, f in enumerate(filled)]
    return tensors.reshape(count, TENSOR_FRAMES, MELS), spans, filled, segments


def as_payload(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode()
    size = max(1, -(-len(raw) // PAYLOAD_UNIT)) * PAYLOAD_UNIT
    return len(raw), raw.ljust(size, b" ")


def with_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text's padded bytes as the samples of a WAV value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 512):
                part = b.slice(a, 512)
                made = [as_payload(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0).cast("int64"), pa.array([n for n, _ in made], pa.int64()), pa.array([wav_bytes(p) for _, p in made], pa.binary())], ["doc_id", "n_bytes", "media"])

    return small_batches(docs.select("doc_id", "text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


TENSOR = pa.fixed_shape_tensor(pa.float32(), [TENSOR_FRAMES, MELS], dim_names=["frame", "mel"])
TENSOR_TABLE = pa.schema([("start_ms", pa.int64()), ("end_ms", pa.int64()), ("n_frames", pa.int32()), ("tensor", TENSOR)])


def tensor_stream(tensors: np.ndarray, spans: list[tuple[float, float]], filled: np.ndarray) -> bytes:
    """The Arrow stream of a value's tensors with their spans."""
    flat = pa.FixedSizeListArray.from_arrays(pa.array(tensors.ravel()), TENSOR_FRAMES * MELS)
    columns = [pa.array([s for s, _ in spans], pa.int64()), pa.array([e for _, e in spans], pa.int64()), pa.array(filled, pa.int32()), pa.ExtensionArray.from_storage(TENSOR, flat)]
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, TENSOR_TABLE) as out:
        out.write_batch(pa.RecordBatch.from_arrays(columns, schema=TENSOR_TABLE))
    return sink.getvalue().to_pybytes()


def read_tensors(stream: bytes) -> pa.Table:
    """A table (start_ms, end_ms, n_frames, tensor) from its stored stream."""
    return pa.ipc.open_stream(stream).read_all()


def with_features(media: DataFrame) -> DataFrame:
    """media's doc_id, n_bytes and digests with ``segments`` and ``tensors``, the stored form of its features."""
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "segments", "tensors"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())])), pa.binary()]

    def made(value: bytes) -> tuple:
        payload, _ = wav_samples(value)
        tensors, spans, filled, segments = features(value)
        loud = [{"start_s": a, "end_s": b} for a, b in segments]
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(value), hashlib.sha256(value).hexdigest(), loud, tensor_stream(tensors, spans, filled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 512):
                part = b.slice(a, 512)
                rows = [made(v) for v in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))], ["doc_id", "n_bytes", *names])

    return small_batches(media.select("doc_id", "n_bytes", "media")).mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, segments array<struct<start_s: double, end_s: double>>, tensors binary")


def log_mel_tensors(featured: DataFrame) -> DataFrame:
    """A row for each tensor of each value with_features() gave: (doc_id, chunk, start_ms, end_ms, n_frames, tensor).

    tensor holds TENSOR_FRAMES * MELS floats, row-major.
    """
    names = ["doc_id", "chunk", "start_ms", "end_ms", "n_frames", "tensor"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, stream in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for t in read_tensors(stream).to_batches():
                    n = t.num_rows
                    lists = pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * TENSOR_FRAMES * MELS, t.column("tensor").storage.flatten())
                    yield pa.RecordBatch.from_arrays([pa.array([doc] * n, pa.int64()), pa.array(range(n), pa.int32()), *t.columns[:3], lists], names)

    return small_batches(featured.select("doc_id", "tensors")).mapInArrow(run, "doc_id long, chunk int, start_ms long, end_ms long, n_frames int, tensor array<float>")


def energy_segments(featured: DataFrame) -> DataFrame:
    """A row for each loud segment of each value: (doc_id, segment, start_s, end_s)."""
    return featured.select("doc_id", F.posexplode("segments").alias("segment", "s")).select("doc_id", "segment", "s.start_s", "s.end_s")


def summary(segments: list[dict], stream: bytes) -> str:
    """What features a value has, from their stored form."""
    t = read_tensors(stream)
    frames = t["n_frames"].to_numpy()
    mels = t["tensor"].combine_chunks().to_numpy_ndarray().reshape(-1, MELS)[: int(frames.sum())]
    mean = mels.mean(axis=0, dtype=np.float64)
    loud = sum(s["end_s"] - s["start_s"] for s in segments)
    return f"tensors={len(t)}x{TENSOR_FRAMES}x{MELS};frames={int(frames.sum())};span_ms={t['start_ms'][0]}-{t['end_ms'][-1]};segments={len(segments)};loud_s={loud:.3f};mel={','.join(f'{v:.2f}' for v in mean)}"


def described(featured: DataFrame) -> DataFrame:
    """featured with ``feature``, the summary of its stored features, in their place."""
    kept = [c for c in featured.columns if c not in ("segments", "tensors")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            told = [summary(s, t) for s, t in zip(b.column(len(kept)).to_pylist(), b.column(len(kept) + 1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], pa.array(told, pa.string())], [*kept, "feature"])

    kinds = dict(featured.dtypes)
    return small_batches(featured.select(*kept, "segments", "tensors")).mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in kept) + ", feature string")


def audio_features(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> one row per document with digests of payload, media and features, all from stored forms."""
    media = stored(with_media(docs.select("doc_id", "text")), "media")
    return described(stored(with_features(media), "media-features"))
