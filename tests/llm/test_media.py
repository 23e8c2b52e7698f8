from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from quire.llm import media
from tests.llm.data import documents, empty, rows


def test_payload_round_trip(spark):
    got = media.audio_features(documents(spark)).collect()
    assert len(got) == len(rows())
    want = {}
    for r in rows():
        raw = (r[1] or "").encode()
        payload = raw + b" " * ((-len(raw)) % 192 or (0 if raw else 192))
        want.setdefault((r[0], hashlib.sha256(payload).hexdigest()), (len(raw), len(payload), zlib.crc32(payload[-16:])))
    for r in got:
        assert want[(r["doc_id"], r["payload_sha256"])] == (r["n_bytes"], r["payload_bytes"], r["tail_crc32"])
        assert r["media_bytes"] == r["payload_bytes"] + 44
    assert len({r["feature"] for r in got if r["n_bytes"] == 0}) == 1
    assert media.audio_features(empty(spark)).count() == 0


def test_wav_is_walked_not_assumed():
    samples = bytes(range(192))
    plain = media.wav_bytes(samples)
    extra = plain[:12] + b"LIST" + (4).to_bytes(4, "little") + b"abcd" + plain[12:]
    assert media.wav_samples(extra) == (samples, 16000)
    with pytest.raises(ValueError):
        media.wav_samples(b"x")


@pytest.mark.parametrize(("up", "down"), [(1, 2), (3, 2), (2, 3), (160, 147)])
def test_resampling_against_the_definition(up, down):
    x = np.random.default_rng(1).standard_normal(100).astype(np.float32)
    phases = media.low_pass(up, down)
    width = phases.shape[1]
    taps = np.zeros(width * up)
    for p in range(up):
        taps[p::up] = phases[p][::-1]
    stuffed = np.zeros(len(x) * up)
    stuffed[::up] = x
    centre = (width * up - 1) // 2
    whole = np.convolve(stuffed, taps)
    want = [whole[n * down + centre] if n * down + centre < len(whole) else 0 for n in range(-(-len(x) * up // down))]
    assert np.allclose(media.resample(x, up, down), want, atol=1e-4)


def test_a_tone_survives_and_aliases_do_not():
    t = np.arange(16000) / 16000
    low, high = (np.sqrt((media.resample(np.sin(2 * np.pi * f * t).astype(np.float32))[100:-100] ** 2).mean()) for f in (1000, 7000))
    assert low > 0.65 and high < 0.05


def test_hysteresis_against_a_state_machine():
    rng = random.Random(3)
    for _ in range(200):
        e = np.array([rng.choice([0.0, 1.0, 2.0]) for _ in range(rng.randint(1, 30))])
        found, start = [], None
        for k, v in enumerate([*e.tolist(), -1.0]):
            if start is None and v >= 2:
                start = k
            elif start is not None and v < 1:
                found.append((start, k))
                start = None
        assert media.hysteresis(e, 2, 1) == found


def test_tensors_have_one_shape_and_spans(spark):
    featured = media.with_features(media.with_media(documents(spark)))
    stored = featured.filter("doc_id = 6").first()["tensors"]
    table = media.read_tensors(bytes(stored))
    assert table.schema.field("tensor").type == pa.fixed_shape_tensor(pa.float32(), [media.TENSOR_FRAMES, media.MELS], dim_names=["frame", "mel"])
    text = next(r[1] for r in rows() if r[0] == 6)
    tensors, spans, filled, _ = media.features(media.wav_bytes(media.as_payload(text)[1]))
    assert np.allclose(table["tensor"].combine_chunks().to_numpy_ndarray(), tensors, atol=1e-4)
    assert list(zip(table["start_ms"].to_pylist(), table["end_ms"].to_pylist(), strict=True)) == spans and table["n_frames"].to_pylist() == filled.tolist()
    made = media.log_mel_tensors(featured.filter("doc_id = 6")).orderBy("chunk").collect()
    assert {len(r["tensor"]) for r in made} == {media.TENSOR_FRAMES * media.MELS} and len(made) == len(tensors)
    assert all(a["start_ms"] < b["start_ms"] < a["end_ms"] for a, b in zip(made, made[1:], strict=False))
    assert media.energy_segments(featured).filter("end_s <= start_s").count() == 0
