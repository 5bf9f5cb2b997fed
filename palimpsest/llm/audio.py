"""Media columns: 8-bit audio in a column, with log-mel features and time spans.

A payload is stored losslessly as a mono 8-bit WAV file. Features are computed
from the stored bytes read back: a polyphase resampler (windowed-sinc taps dealt
to phases), overlapping Hann frames, log-mel filterbank energies, and a
segmentation by energy with hysteresis: a segment opens when the level passes
the upper threshold and closes when it falls under the lower one. Each segment
becomes patches of a fixed number of frames, kept as an Arrow fixed-shape tensor
column beside the start and end time of the frames that are real.

The tensors are stored as an Arrow IPC stream in a column of their own, and what is
said of a clip is derived from that stream read back. Levels are rounded to 1/16 dB.
Samples and taps are integers whose sums of products are exact in double precision,
so resampling is the same on any machine; transforms and logarithms are those of the
library at hand, so equal payloads have equal features wherever it is the same.

Defined results: a null or empty text is the payload of 64 zero bytes; payloads
of any length are processed whole, a block of frames at a time; repeated rows
get equal results; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import io
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm._shared import texts

UNIT = 64
#: Steps of the resampler's taps.
TAP_BITS = 20
#: Sampling rate stored and the rate features see: up by 5, down by 8.
RATE, UP, DOWN = 16_000, 5, 8
FRAME, HOP, BANDS = 256, 128, 32
#: Frames of a tensor, and of a block that is in memory at a time.
PATCH, BLOCK = 32, 2048
#: A level in 1/16 dB under which all is silence, and the least range between a
#: clip's quiet and loud frames for thresholds of its own.
SILENCE, RANGE = -16 * 20, 16


def payload_of(text: str | None) -> bytes:
    """UTF-8 with zero bytes appended up to a positive multiple of UNIT."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes(max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))


def write_wav(payload: bytes, rate: int = RATE) -> bytes:
    """A RIFF file of unsigned 8-bit mono samples."""
    n = len(payload)
    head = b"RIFF" + (36 + n + n % 2).to_bytes(4, "little") + b"WAVEfmt " + (16).to_bytes(4, "little")
    form = (1).to_bytes(2, "little") * 2 + rate.to_bytes(4, "little") * 2 + (1).to_bytes(2, "little") + (8).to_bytes(2, "little")
    return head + form + b"data" + n.to_bytes(4, "little") + payload + bytes(n % 2)


def read_wav(media: bytes) -> tuple[int, bytes]:
    """(rate, samples) of an 8-bit mono RIFF file; other chunks are passed over."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a RIFF WAVE file")
    at, rate = 12, None
    while at + 8 <= len(media):
        name, size = media[at : at + 4], int.from_bytes(media[at + 4 : at + 8], "little")
        body = at + 8
        if name == b"fmt ":
            if media[body : body + 4] != b"\x01\x00\x01\x00" or media[body + 14 : body + 16] != b"\x08\x00":
                raise ValueError("8-bit mono samples are asked for")
            rate = int.from_bytes(media[body + 4 : body + 8], "little")
        elif name == b"data":
            if rate is None or body + size > len(media):
                raise ValueError("the file is cut off")
            return rate, media[body : body + size]
        at = body + size + size % 2
    raise ValueError("no samples")


@lru_cache(maxsize=4)
def phases(up: int, down: int, half: int = 8) -> np.ndarray:
    """Taps of each phase: a windowed sinc at the lower of the two rates, in steps of 2^-TAP_BITS."""
    wide = half * max(up, down)
    t = np.arange(-wide, wide + 1)
    cut = 1.0 / max(up, down)
    taps = np.sinc(t * cut) * cut * np.kaiser(len(t), 8.0) * up
    width = -(-len(taps) // up)
    return np.rint(np.concatenate([taps, np.zeros(width * up - len(taps))]).reshape(width, up).T * (1 << TAP_BITS))


def resample(x: np.ndarray, up: int = UP, down: int = DOWN) -> np.ndarray:
    """Polyphase resampling of integers, exact, in steps of 2^-TAP_BITS: output n is
    phase (n * down + lead) % up over the inputs before it."""
    bank = phases(up, down)
    width = bank.shape[1]
    lead = (bank.size - 1) // 2
    n = -(-len(x) * up // down)
    padded = np.concatenate([np.zeros(width), x.astype(np.float64), np.zeros(width + lead // up + 1)])
    views = np.lib.stride_tricks.sliding_window_view(padded, width)
    out = np.empty(n)
    for r in range(min(up, n)):
        # outputs r, r + up, ... use one phase and inputs `down` apart
        place = r * down + lead
        k, phase = divmod(place, up)
        rows = views[k + 1 :: down][: len(range(r, n, up))]
        out[r::up] = rows @ bank[phase][::-1]
    return out


@lru_cache(maxsize=4)
def filterbank(rate: int, frame: int = FRAME, bands: int = BANDS) -> np.ndarray:
    """Triangular mel filters over the bins of a real transform."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(0, mel(rate / 2), bands + 2) / 2595) - 1)
    bins = np.linspace(0, rate / 2, frame // 2 + 1)
    up = (bins[:, None] - edges[:-2]) / (edges[1:-1] - edges[:-2])
    down = (edges[2:] - bins[:, None]) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(up, down)).astype(np.float32)


HANN = (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(FRAME) / FRAME)).astype(np.float32)


def log_mel(samples: bytes, rate: int = RATE) -> tuple[np.ndarray, np.ndarray]:
    """(levels, energy): int16 of frames x bands and of frames, in 1/16 dB."""
    x = np.frombuffer(samples, np.uint8).astype(np.int16) - 128
    y = (resample(x) / (128 << TAP_BITS)).astype(np.float32)
    frames = max(1, -(-(len(y) - FRAME) // HOP) + 1)
    y = np.concatenate([y, np.zeros(max(0, (frames - 1) * HOP + FRAME - len(y)), np.float32)])
    views = np.lib.stride_tricks.sliding_window_view(y, FRAME)[::HOP][:frames]
    bank = filterbank(rate * UP // DOWN)
    levels, energy = np.empty((frames, BANDS), np.int16), np.empty(frames, np.int16)
    for at in range(0, frames, BLOCK):
        part = views[at : at + BLOCK] * HANN
        power = np.abs(np.fft.rfft(part, axis=1).astype(np.complex64)) ** 2
        levels[at : at + BLOCK] = np.rint(16 * 10 * np.log10(power @ bank + 1e-4)).astype(np.int16)
        # the level of change: without the mean, so that a constant is silence
        still = part - part.mean(1, keepdims=True)
        energy[at : at + BLOCK] = np.rint(16 * 10 * np.log10((still**2).sum(1) + 1e-4)).astype(np.int16)
    return levels, energy


def segments(energy: np.ndarray) -> list[tuple[int, int]]:
    """Frame spans [a, b) by hysteresis. The thresholds lie two thirds and one
    third of the way from a clip's quiet level (its lowest tenth) to its loud one
    (its highest), or both at SILENCE where those are near. No loop over frames: a
    frame is inside if, of the frames up to it that pass a threshold, the last passed the upper one."""
    order = np.sort(energy).astype(np.int32)
    low, high = int(order[len(order) // 10]), int(order[len(order) - 1 - len(order) // 10])
    opens, closes = (low + 2 * (high - low) // 3, low + (high - low) // 3) if high - low >= RANGE else (SILENCE, SILENCE)
    opens, closes = max(opens, SILENCE), max(closes, SILENCE)
    say = np.where(energy >= opens, 1, np.where(energy < closes, 0, -1))
    last = np.maximum.accumulate(np.where(say >= 0, np.arange(len(say)), -1))
    inside = (last >= 0) & (say[np.maximum(last, 0)] == 1)
    edges = np.flatnonzero(np.diff(np.concatenate(([0], inside.astype(np.int8), [0]))))
    return [(int(a), int(b)) for a, b in zip(edges[::2], edges[1::2])]


def patches(levels: np.ndarray, spans: list[tuple[int, int]], rate: int = RATE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tensors, times, segments): each span cut into PATCH frames, the last filled
    up with the floor, the seconds at which the real frames start and end, and the
    number of the span."""
    tensors, times, of = [], [], []
    step, wide = HOP * DOWN / UP / rate, FRAME * DOWN / UP / rate
    for k, (a, b) in enumerate(spans):
        for at in range(a, b, PATCH):
            to = min(at + PATCH, b)
            patch = np.full((PATCH, BANDS), -16 * 40, np.int16)
            patch[: to - at] = levels[at:to]
            tensors.append(patch)
            times.append((at * step, (to - 1) * step + wide))
            of.append(k)
    return np.array(tensors, np.int16).reshape(-1, PATCH, BANDS), np.array(times, np.float64).reshape(-1, 2), np.array(of, np.int32)


TENSOR = pa.fixed_shape_tensor(pa.int16(), (PATCH, BANDS))


def tensor_table(tensors: np.ndarray, times: np.ndarray, of: np.ndarray) -> pa.Table:
    """Arrow table (mel: fixed-shape tensor, start, end, segment): a row a patch."""
    if len(tensors):
        column = pa.FixedShapeTensorArray.from_numpy_ndarray(np.ascontiguousarray(tensors))
    else:
        column = pa.ExtensionArray.from_storage(TENSOR, pa.array([], TENSOR.storage_type))
    return pa.table({"mel": column, "start": pa.array(times[:, 0]), "end": pa.array(times[:, 1]), "segment": pa.array(of)})


def to_ipc(table: pa.Table) -> bytes:
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, table.schema) as w:
        w.write_table(table)
    return sink.getvalue()


def from_ipc(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def features(media: bytes) -> pa.Table:
    """The patches of a WAV file, with their time spans."""
    rate, samples = read_wav(media)
    levels, energy = log_mel(samples, rate)
    return tensor_table(*patches(levels, segments(energy), rate))


def media_column(text: Column) -> Column:
    """The stored form of each text: a WAV file."""

    @F.arrow_udf("binary")
    def run(col: pa.Array) -> pa.Array:
        return pa.array([write_wav(payload_of(t)) for part in texts(col) for t in part], pa.binary())

    return run.asNondeterministic()(text)


def tensor_column(media: Column) -> Column:
    """Arrow IPC stream of each file's patches and time spans."""

    @F.arrow_udf("binary")
    def run(col: pa.Array) -> pa.Array:
        out = [None if m is None else to_ipc(features(m)) for part in texts(col) for m in part]
        return pa.array(out, pa.binary())

    return run.asNondeterministic()(media)


def digest(media: bytes, mel: bytes, n_bytes: int) -> dict:
    """The contract's values, all from the stored bytes of media and tensors read back."""
    _, samples = read_wav(media)
    table = from_ipc(mel).combine_chunks()
    column = table.column("mel").combine_chunks()
    tensors = column.to_numpy_ndarray() if table.num_rows else np.empty((0, PATCH, BANDS), np.int16)
    times = np.stack([table.column("start").to_numpy(), table.column("end").to_numpy()], 1)
    of = table.column("segment").to_numpy()
    mean = np.rint(tensors.mean((0, 1))).astype(int).tolist() if len(tensors) else []
    h = hashlib.sha256(tensors.astype("<i2").tobytes() + np.rint(times * 1e6).astype("<i8").tobytes()).hexdigest()
    return {
        "n_bytes": n_bytes, "payload_bytes": len(samples), "payload_sha256": hashlib.sha256(samples).hexdigest(), "tail_crc32": zlib.crc32(samples[-UNIT:]),
        "media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(),
        "feature": f"segments={len(set(of.tolist()))};patches={len(tensors)};mean={','.join(map(str, mean))};sha256={h}",
    }


DIGEST = pa.struct([("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])


def digest_column(media: Column, mel: Column, n_bytes: Column) -> Column:
    """Struct of DIGEST from the stored columns."""

    @F.arrow_udf("n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    def run(files: pa.Array, tensors: pa.Array, sizes: pa.Array) -> pa.Array:
        rows = []
        for m, t in zip(texts(files), texts(tensors)):
            rows += map(digest, m, t, sizes.slice(len(rows), len(m)).to_pylist())
        return pa.array(rows, DIGEST)

    return run.asNondeterministic()(media, mel, n_bytes)


def stored_column(text: Column) -> Column:
    """Struct (media, mel) of each text: its WAV file, and the stream of the patches
    found in that file. One pass makes both, so that a task has one worker for them."""

    @F.arrow_udf("media binary, mel binary")
    def run(col: pa.Array) -> pa.Array:
        media, mel = [], []
        for part in texts(col):
            for t in part:
                media.append(write_wav(payload_of(t)))
                mel.append(to_ipc(features(media[-1])))
        return pa.StructArray.from_arrays([pa.array(media, pa.binary()), pa.array(mel, pa.binary())], names=["media", "mel"])

    return run.asNondeterministic()(text)


def stored_digest_column(text: Column) -> Column:
    """Struct of DIGEST of each text: its two stored forms are written, read back and
    digested a text at a time, and only the digest leaves the task. The forms
    themselves are those of ``stored_column``."""

    @F.arrow_udf("n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    def run(col: pa.Array) -> pa.Array:
        rows = []
        for part in texts(col):
            for t in part:
                media = write_wav(payload_of(t))
                rows.append(digest(media, to_ipc(features(media)), len((t or "").encode("utf-8", "surrogatepass"))))
        return pa.array(rows, DIGEST)

    return run.asNondeterministic()(text)


def audio_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, media, mel, n_bytes) of every row of ``docs``: the WAV file and the
    stream of its tensors and time spans."""
    text = F.col(f"`{text_col}`")
    out = docs.select(F.col(f"`{id_col}`").alias("doc_id"), stored_column(text).alias("x"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    return out.select("doc_id", "x.media", "x.mel", "n_bytes")
