import hashlib
import zlib

import numpy as np
import pyarrow as pa

from ledgerloom.llm import audio

P = audio.AudioParameters()


def test_payload_and_round_trip():
    for text, size in ((None, 192), ("", 192), ("x" * 192, 192), ("é" * 96, 192), ("x" * 193, 384)):
        payload, n = audio.payload_of(text)
        assert len(payload) == size and n == len((text or "").encode()) and payload[n:].strip(b" ") == b""
        assert audio.read_wav(audio.store_wav(payload, 16000)) == payload


def test_resampling_keeps_a_tone():
    for up, down in ((1, 2), (3, 4), (2, 1), (1, 1), (5, 3)):
        tone = lambda n, rate: np.sin(2 * np.pi * 440 * np.arange(n) / rate)
        got = audio.resample(tone(16000, 16000).astype(np.float32), up, down, 8)
        assert len(got) == 16000 * up // down + (16000 * up % down > 0)
        assert np.abs(got - tone(len(got), 16000 * up / down))[100:-100].max() < 0.02


def test_pieces_give_what_the_whole_gives(monkeypatch):
    stored = audio.store_wav(audio.payload_of("some text, more text. " * 500)[0], P.rate)
    whole, loud = audio.features(stored, P)
    monkeypatch.setattr(audio, "_SAMPLES_AT_ONCE", 1000)
    parts, loud_parts = audio.features(stored, P)
    assert np.abs(whole - parts).max() < 0.01 and (loud == loud_parts).all()


def test_mel_of_a_tone_peaks_at_its_band():
    tone = np.sin(2 * np.pi * 1000 * np.arange(8000) / P.out_rate).astype(np.float32)
    mel = audio.log_mel(tone, P)
    edges = 700 * (10 ** (np.linspace(0, 2595 * np.log10(1 + P.out_rate / 2 / 700), P.mels + 2) / 2595) - 1)
    assert abs(edges[int(mel[10].argmax()) + 1] - 1000) < 120


def test_hysteresis():
    levels = np.repeat([0, 0.08, 0.3, 0.08, 0, 0.08, 0], 2000).astype(np.float32)
    got = audio.segments(levels * np.sign(np.sin(np.arange(len(levels)))), P)
    assert len(got) == 1  # the faint part alone opens no segment
    assert got[0][0] * P.hop >= 3500 and abs(got[0][1] * P.hop - 8000) < 500  # it ends with the faint part that follows


def test_tensors_are_fixed_shape():
    stream = audio.store_tensors(np.zeros((2 * P.tensor_frames - 3, P.mels), np.float32), P)
    field = pa.ipc.open_stream(stream).schema.field("tensor")
    assert "fixed_shape_tensor" in str(field.type) and list(field.type.shape) == [P.tensor_frames, P.mels]
    values, spans = audio.read_tensors(stream)
    assert values.shape == (2, P.tensor_frames, P.mels) and (values[1, -3:] == -100).all() and (values[1, :-3] == 0).all()
    assert len(spans) == 2 and spans[0]["start"] == 0 and spans[0]["end"] > spans[1]["start"]


def plain_features(payload):
    """Log-mel frames and loud spans by the definitions, sample by sample."""
    x = np.frombuffer(payload, np.uint8).astype(float)
    x = (x - 128) / 128
    x -= x.mean()
    reach = P.taps * P.down  # Hamming-windowed sinc, cut at half the lower rate
    h = np.array([np.sinc(t / P.down) * (0.54 + 0.46 * np.cos(np.pi * t / reach)) for t in range(-reach, reach + 1)])
    h /= h.sum()
    padded = np.concatenate([np.zeros(reach), x, np.zeros(reach)])
    y = np.array([padded[i : i + 2 * reach + 1] @ h[::-1] for i in range(0, len(x), P.down)])
    n = max(1, -(-(len(y) - P.frame) // P.hop) + 1)
    y = np.append(y, np.zeros(max(0, (n - 1) * P.hop + P.frame - len(y))))
    top = 2595 * np.log10(1 + P.out_rate / 2 / 700)
    edges = [700 * (10 ** (m / 2595) - 1) for m in np.linspace(0, top, P.mels + 2)]
    mel, level = np.zeros((n, P.mels)), []
    for i in range(n):
        frame = y[i * P.hop : i * P.hop + P.frame]
        power = np.abs(np.fft.rfft(frame * np.hanning(P.frame))) ** 2
        level.append(10 * np.log10((frame**2).mean() + 1e-10))
        for m in range(P.mels):
            lo, mid, hi = edges[m : m + 3]
            weights = [max(0.0, min((f - lo) / (mid - lo), (hi - f) / (hi - mid))) for f in np.arange(P.frame // 2 + 1) * P.out_rate / P.frame]
            mel[i, m] = 10 * np.log10(np.dot(weights, power) / P.frame + 1e-10)
    loud, start = [], None
    for i, db in enumerate([*level, -999]):
        if start is None and db >= P.open_db:
            start = i
        elif start is not None and db < P.close_db:
            loud.append((start * P.hop / P.out_rate, ((i - 1) * P.hop + P.frame) / P.out_rate))
            start = None
    return mel, loud


def test_query_against_plain_features(spark, small):
    """Tensors and spans read back from the query's result, brute force beside them."""
    docs = small("documents").filter("length(text) < 3000").select("doc_id", "text").collect()[:40]
    docs = [(r["doc_id"], r["text"]) for r in docs] + [(-1, None), (-2, "quiet" * 50), (-3, "~ ~" * 700 + "m" * 900 + "\u00ff" * 600)]
    got = audio.audio_column(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    texts, segments = dict(docs), 0
    for r in got:
        payload, _ = audio.payload_of(texts[r["doc_id"]])
        mel, loud = plain_features(payload)
        values, spans = audio.read_tensors(r["tensors"])
        assert [s.asDict() for s in r["tensor_spans"]] == spans and r["frames"] == len(mel)
        flat = values.reshape(-1, P.mels)
        assert np.abs(flat[: len(mel)] - mel).max() < 0.05 and (flat[len(mel) :] == -100).all()
        assert np.allclose([(s["start"], s["end"]) for s in r["segments"]], loud) if loud else not r["segments"]
        segments += len(loud)
        assert f"tensors={len(values)}x{P.tensor_frames}x{P.mels};" in r["feature"]
    assert segments


def test_odd_rows(odd_docs, no_docs):
    got = audio.audio_column(odd_docs).collect()
    assert len(got) == 10 and audio.audio_column(no_docs).count() == 0
    texts = {r["doc_id"]: r["text"] for r in odd_docs.collect()}
    for r in got:
        if r["doc_id"] is not None:
            payload, n = audio.payload_of(texts[r["doc_id"]])
            assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
    same = [(r["media_sha256"], r["feature"]) for r in got if r["doc_id"] == 1]
    assert same[0] == same[1] and got[0]["tensors"]
