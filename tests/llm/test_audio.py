import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import audio


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 1000])
def test_payload_and_file_round_trip(n):
    text = "é" * (n // 2) + "x" * (n % 2)
    payload = audio.payload_of(text)
    assert len(payload) % 64 == 0 and len(payload) >= 64 and payload.startswith(text.encode()) and not payload[len(text.encode()) :].strip(b"\0")
    assert audio.read_wav(audio.write_wav(payload)) == (audio.RATE, payload)
    odd = audio.write_wav(b"abc")
    assert len(odd) == 48 and audio.read_wav(odd)[1] == b"abc"
    extra = odd[:12] + b"LIST\x03\0\0\0abc\0" + odd[12:]
    assert audio.read_wav(extra)[1] == b"abc"


@pytest.mark.parametrize("bad", [b"", b"RIFF", b"RIFF\0\0\0\0WAVE", audio.write_wav(b"x" * 64)[:-1]])
def test_bad_files(bad):
    with pytest.raises(ValueError):
        audio.read_wav(bad)


@pytest.mark.parametrize("n", [1, 7, 64, 203, 1000])
@pytest.mark.parametrize("up,down", [(5, 8), (1, 2), (3, 2)])
def test_resampling_equals_the_definition(n, up, down):
    x = np.random.default_rng(n).standard_normal(n).astype(np.float32)
    bank = audio.phases(up, down)
    stretched = np.zeros(n * up)
    stretched[::up] = x
    full = np.convolve(stretched, bank.T.ravel())
    want = full[(bank.size - 1) // 2 :: down]
    got = audio.resample(x, up, down)
    m = min(len(got), len(want))
    assert len(got) == -(-n * up // down) and np.abs(got[:m] - want[:m]).max() < 1e-4
    # integers are exact in any order of summing
    x = np.random.default_rng(n).integers(-128, 128, n)
    stretched = np.zeros(n * up, np.int64)
    stretched[::up] = x
    want = np.convolve(stretched, bank.T.ravel().astype(np.int64))[(bank.size - 1) // 2 :: down]
    got = audio.resample(x, up, down)
    assert (got[:m] == want[:m]).all()


def test_a_tone_lands_in_its_band():
    t = np.arange(16_000) / audio.RATE
    levels, _ = audio.log_mel((128 + 100 * np.sin(2 * np.pi * 1000 * t)).astype(np.uint8).tobytes())
    mel = 2595 * np.log10(1 + 1000 / 700) / (2595 * np.log10(1 + 5000 / 700)) * (audio.BANDS + 1) - 1
    assert abs(int(levels[10:-10].mean(0).argmax()) - mel) <= 1


def brute_segments(energy):
    order = np.sort(energy).astype(int)
    k = len(order) // 10
    low, high = int(order[k]), int(order[len(order) - 1 - k])
    up, down = (low + 2 * (high - low) // 3, low + (high - low) // 3) if high - low >= audio.RANGE else (audio.SILENCE, audio.SILENCE)
    up, down = max(up, audio.SILENCE), max(down, audio.SILENCE)
    out, start = [], None
    for i, e in enumerate(energy):
        if start is None and e >= up:
            start = i
        elif start is not None and e < down:
            out.append((start, i))
            start = None
    return out + ([(start, len(energy))] if start is not None else [])


def test_hysteresis_equals_a_loop():
    rng = np.random.default_rng(2)
    for n in (1, 2, 9, 500):
        for _ in range(50):
            e = np.cumsum(rng.integers(-40, 41, n)).astype(np.int16)
            assert audio.segments(e) == brute_segments(e)


def test_tensors_have_one_shape_and_time_spans():
    quiet, loud = bytes([128]) * 32_000, bytes([0] * 8 + [255] * 8) * 2000
    made = audio.features(audio.write_wav(quiet + loud + quiet))
    table = audio.from_ipc(audio.to_ipc(made))
    assert set(table.column("segment").to_pylist()) == {0} and table.schema.field("mel").type == audio.TENSOR and table.num_rows == made.num_rows > 1
    assert table.column("start")[0].as_py() == pytest.approx(2.0, abs=0.1) and table.column("end")[-1].as_py() == pytest.approx(4.0, abs=0.1)
    tensors = table.column("mel").combine_chunks().to_numpy_ndarray()
    assert tensors.shape[1:] == (audio.PATCH, audio.BANDS) and (made.column("mel").combine_chunks().to_numpy_ndarray() == tensors).all()
    assert audio.tensor_table(*audio.patches(np.zeros((0, audio.BANDS), np.int16), [])).num_rows == 0


def plain_levels(payload):
    """Levels and energies by their definition, a frame and a bin at a time."""
    x = [(b - 128) / 128 for b in payload]
    up, down, half = audio.UP, audio.DOWN, 8
    wide = half * max(up, down)
    taps = [np.sinc(t / max(up, down)) / max(up, down) * np.kaiser(2 * wide + 1, 8.0)[t + wide] * up for t in range(-wide, wide + 1)]
    size = -(-len(taps) // up) * up
    lead = (size - 1) // 2
    y = []
    for n in range(-(-len(x) * up // down)):
        at = n * down + lead
        y.append(sum(taps[j] * x[(at - j) // up] for j in range(min(at + 1, len(taps))) if (at - j) % up == 0 and (at - j) // up < len(x)))
    frames = max(1, -(-(len(y) - audio.FRAME) // audio.HOP) + 1)
    y += [0.0] * ((frames - 1) * audio.HOP + audio.FRAME - len(y))
    rate = audio.RATE * up // down
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = [700 * (10 ** (mel(rate / 2) * k / (audio.BANDS + 1) / 2595) - 1) for k in range(audio.BANDS + 2)]
    n = np.arange(audio.FRAME)
    levels, energy = [], []
    for k in range(frames):
        f = np.array(y[k * audio.HOP : k * audio.HOP + audio.FRAME]) * (0.5 - 0.5 * np.cos(2 * np.pi * n / audio.FRAME))
        power = [abs((f * np.exp(-2j * np.pi * b * n / audio.FRAME)).sum()) ** 2 for b in range(audio.FRAME // 2 + 1)]
        row = []
        for a, b, c in zip(edges, edges[1:], edges[2:]):
            total = 0.0
            for i, p in enumerate(power):
                hz = i * rate / audio.FRAME
                total += p * max(0.0, min((hz - a) / (b - a), (c - hz) / (c - b)))
            row.append(160 * np.log10(total + 1e-4))
        levels.append(row)
        energy.append(160 * np.log10(((f - f.mean()) ** 2).sum() + 1e-4))
    return np.array(levels), np.array(energy)


@pytest.mark.parametrize("text", ["", "plain words " * 40, "aaaa" * 100 + "\x00ÿ" * 300 + "mixed 123 !" * 60])
def test_features_equal_their_definition(text):
    payload = audio.payload_of(text)
    levels, energy = audio.log_mel(payload)
    want_levels, want_energy = plain_levels(payload)
    assert levels.shape == want_levels.shape and np.abs(levels - want_levels).max() < 1.5 and np.abs(energy - want_energy).max() < 1.5
    spans = brute_segments(energy)
    got = audio.digest(audio.write_wav(payload), audio.to_ipc(audio.features(audio.write_wav(payload))), 0)["feature"]
    rows, times = [], []
    for a, b in spans:
        for at in range(a, b, audio.PATCH):
            to = min(b, at + audio.PATCH)
            rows.append(np.concatenate([levels[at:to], np.full((audio.PATCH - (to - at), audio.BANDS), -640, np.int16)]))
            times.append([at * 0.0128, (to - 1) * 0.0128 + 0.0256])
    mean = ",".join(str(int(np.rint(np.mean([r[:, k] for r in rows])))) for k in range(audio.BANDS)) if rows else ""
    h = hashlib.sha256(b"".join(r.astype("<i2").tobytes() for r in rows) + np.rint(np.array(times) * 1e6).astype("<i8").tobytes()).hexdigest()
    assert got == f"segments={len(spans)};patches={len(rows)};mean={mean};sha256={h}"


def test_columns(spark):
    rng = random.Random(1)
    rows = [(1, None), (2, ""), (3, "héllo"), (4, "héllo"), (5, "".join(chr(rng.randrange(32, 1000)) for _ in range(200_000))), (None, "x" * 64)]
    d = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS media", "2 AS n_bytes")
    media = audio.audio_documents(d)
    out = media.select("doc_id", audio.digest_column(F.col("media"), F.col("mel"), F.col("n_bytes")).alias("x")).select("doc_id", "x.*").collect()
    once = d.select("doc_id", audio.stored_digest_column(F.col("text")).alias("x")).select("doc_id", "x.*").collect()
    assert len(out) == len(rows) and sorted(map(str, once)) == sorted(map(str, out))
    for r in out:
        text = dict(rows)[r["doc_id"]]
        payload = audio.payload_of(text)
        assert (r["n_bytes"], r["payload_bytes"]) == (len((text or "").encode()), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-64:])
        assert r["media_bytes"] == len(payload) + 44 and r["media_sha256"] == hashlib.sha256(audio.write_wav(payload)).hexdigest()
    by = {r["doc_id"]: r["feature"] for r in out}
    assert by[1] == by[2] and by[3] == by[4] != by[5]
    for r in media.select("doc_id", "mel").collect():
        assert audio.from_ipc(r["mel"]).equals(audio.features(audio.write_wav(audio.payload_of(dict(rows)[r["doc_id"]]))))
    assert audio.audio_documents(d.limit(0)).count() == 0
