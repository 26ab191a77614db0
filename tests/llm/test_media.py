import hashlib
import io
import wave
import zlib

import numpy as np
import pyarrow as pa
import pytest
from helpers import ODD, frame

from parallax.llm import media


def test_contract(spark):
    rows = {x.doc_id: x for x in media.report(frame(spark, ODD)).collect()}
    assert len(rows) == len(ODD)
    for i, t in enumerate(ODD):
        raw = (t or "").encode()
        payload = raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
        assert (rows[i].n_bytes, rows[i].payload_bytes) == (len(raw), len(payload))
        assert rows[i].payload_sha256 == hashlib.sha256(payload).hexdigest() and rows[i].tail_crc32 == zlib.crc32(payload[-16:])
        assert rows[i].media_sha256 == hashlib.sha256(media.wave_file(payload)).hexdigest() and rows[i].media_bytes == len(payload) + 44
    assert rows[3].feature == rows[4].feature != rows[6].feature and rows[0].feature == rows[1].feature
    assert media.report(frame(spark, [])).count() == 0


def test_wave_is_readable():
    with wave.open(io.BytesIO(media.wave_file(b"abc"))) as w:
        assert (w.getnchannels(), w.getsampwidth(), w.getframerate(), w.readframes(9)) == (1, 1, media.SOURCE_RATE, b"abc")
    assert media.wave_samples(media.wave_file(b"abc")) == b"abc"
    with pytest.raises(ValueError):
        media.wave_samples(b"nothing of the kind")


@pytest.mark.parametrize("up, down", [(1, 2), (3, 2), (2, 3), (1, 1), (5, 7)])
def test_polyphase(up, down):
    x = np.random.default_rng(0).random(101).astype(np.float32)
    h = media.lowpass(up, down)
    full = np.zeros(len(x) * up)
    full[::up] = x
    assert np.allclose(media.resample(x, h, up, down), np.convolve(full, h)[len(h) // 2 :][: len(x) * up : down], atol=1e-5)


def test_tone_and_segments():
    t = np.arange(16_000) / media.SOURCE_RATE
    loud = (np.sin(2 * np.pi * 1000 * t) * (t > 0.5) * 100 + 128).astype(np.uint8)
    mel, spans, _ = media.features(loud.tobytes())
    assert len(mel) == (8000 - media.FRAME) // media.HOP + 1 and len(spans) == 1
    assert abs(spans[0][0] - 500) <= 40 and spans[0][1] >= 960
    table = pa.ipc.open_stream(media.tensors(mel)).read_all()
    assert table.schema.field("log_mel").type == pa.fixed_shape_tensor(pa.float32(), [media.TENSOR_FRAMES, media.BANDS])
    cells = table["log_mel"].chunk(0).to_numpy_ndarray().reshape(-1, media.BANDS)[: len(mel)]
    assert np.array_equal(cells, mel) and table["start_ms"].to_pylist()[1] == media.TENSOR_FRAMES * 10


def test_hysteresis():
    e = np.array([0, 0, 2, 0.2, 0.2, -1, 0.2, 0, 0, 0], dtype=float)
    assert media.segments(e) == [(2, 4)]
