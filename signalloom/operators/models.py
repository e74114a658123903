"""Model-based detection and denoising behind a small protocol.

A model is named, never shipped: a factory makes a session inside the worker on first use (sessions must not
be made on the driver and inherited by a fork). A session has run(inputs by name) -> outputs by name; an ONNX
file is one kind of it. EnergyModel is a stand-in of the same shape that needs no weights.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..errors import DetectorError


class Session(Protocol):
    def run(self, inputs: dict[str, np.ndarray]) -> dict[str, np.ndarray]: ...


class OnnxSession:
    """One intra-op thread; made in the worker."""

    def __init__(self, path: str):
        import onnxruntime

        options = onnxruntime.SessionOptions()
        options.intra_op_num_threads = 1
        self.session = onnxruntime.InferenceSession(path, options, providers=["CPUExecutionProvider"])
        self.names = [o.name for o in self.session.get_outputs()]

    def run(self, inputs: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        return dict(zip(self.names, self.session.run(self.names, inputs)))


class EnergyModel:
    """Loudness squashed to 0..1, smoothed by a recurrent state: the shape of a detector without its weights."""

    def run(self, inputs: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        loud = np.sqrt(np.mean(np.square(inputs["input"], dtype=np.float64)))
        state = inputs["state"].copy()
        state[0, 0, 0] = 0.5 * state[0, 0, 0] + 0.5 * loud
        return {"output": np.array([[state[0, 0, 0] / (state[0, 0, 0] + 0.1)]], np.float32), "stateN": state}


_sessions: dict[str, Session] = {}


def session(key: str, factory: Callable[[], Session]) -> Session:
    """The worker's one session of this name."""
    if key not in _sessions:
        _sessions[key] = factory()
    return _sessions[key]


class WindowDetector:
    """Windows with the tail of the one before in front, through a recurrent model; a remainder waits."""

    def __init__(self, model: Session, rate: int, window: int):
        self.model, self.rate, self.window = model, rate, window
        self.reset()

    def reset(self) -> None:
        self.state, self.context, self.left = np.zeros((2, 1, 128), np.float32), np.zeros(self.window // 8, np.float32), np.zeros(0, np.float32)

    def scores(self, x: np.ndarray) -> list[float]:
        x, out = np.concatenate([self.left, x.astype(np.float32)]), []
        n = len(x) // self.window
        for w in x[: n * self.window].reshape(n, self.window):
            got = self.model.run({"input": np.concatenate([self.context, w])[None], "state": self.state, "sr": np.array(self.rate, np.int64)})
            if "output" not in got or got["output"].size != 1 or got.get("stateN", self.state).shape != self.state.shape:
                raise DetectorError("the model's outputs don't have the shape of a detector's")
            self.state, self.context = got["stateN"], w[-self.window // 8 :]
            out.append(float(got["output"].ravel()[0]))
        self.left = x[n * self.window :]
        return out


def score_stream_windows(samples: DataFrame, key: str, factory: Callable[[], Session], rate: int, window: int, threshold: float = 0.5) -> DataFrame:
    """(stream_id, win, start, end, probability, is_speech) by a model, one recurrent pass per stream."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        d = WindowDetector(session(key, factory), rate, window)
        p = np.array(d.scores(g.sort_values("pos")["x"].to_numpy(float)))
        w = np.arange(len(p))
        return pd.DataFrame({"stream_id": [g["stream_id"].iat[0]] * len(p), "win": w, "start": w * window / rate, "end": (w + 1) * window / rate, "probability": p, "is_speech": p >= threshold})

    kind = samples.schema["stream_id"].dataType.simpleString()
    return samples.select("stream_id", "pos", "x").groupBy("stream_id").applyInPandas(run, f"stream_id {kind}, win long, start double, end double, probability double, is_speech boolean")


class SpectralDenoiser:
    """Half-overlapping frames of 512 with a hop of 256 through a model of spectra; 256 samples late.

    model.run({"magnitude"}) -> {"gain"}; without a model the gain is a spectral-subtraction rule over a tracked
    noise floor. A flush of a stream that got nothing gives nothing.
    """

    SIZE, HOP = 512, 256

    def __init__(self, model: Session | None = None):
        self.model, self.left = model, np.zeros(self.HOP)
        self.tail, self.noise, self.fed, self.given = np.zeros(self.HOP), None, 0, 0
        self.window = np.sin(np.pi * (np.arange(self.SIZE) + 0.5) / self.SIZE)

    def _gain(self, magnitude: np.ndarray) -> np.ndarray:
        if self.model is not None:
            return self.model.run({"magnitude": magnitude.astype(np.float32)})["gain"]
        self.noise = magnitude if self.noise is None else np.where(magnitude < self.noise, 0.7 * self.noise + 0.3 * magnitude, 0.995 * self.noise + 0.005 * magnitude)
        return np.clip(1 - 1.5 * self.noise / np.maximum(magnitude, 1e-9), 0.1, 1)

    def process(self, x: np.ndarray) -> np.ndarray:
        self.fed += len(x)
        x, out = np.concatenate([self.left, x]), []
        while len(x) >= self.SIZE:
            s = np.fft.rfft(x[: self.SIZE] * self.window)
            y = np.fft.irfft(s * self._gain(np.abs(s))) * self.window
            out.append(self.tail + y[: self.HOP])
            self.tail, x = y[self.HOP :], x[self.HOP :]
        self.left = x
        got = np.concatenate(out) if out else np.zeros(0)
        self.given += len(got)
        return got

    def flush(self) -> np.ndarray:
        if not self.fed:
            return np.zeros(0)
        want = self.fed - self.given
        return self.process(np.zeros(self.SIZE))[: max(0, want) + self.HOP]
