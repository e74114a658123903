"""Quality of an estimate beside its reference: segmental and frequency-weighted SNR over sample rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FRAME, FLOOR = 256, 1e-4
WIDE, HOP, BANDS = 512, 256, 24


def seg_snr(rows: DataFrame, frame: int = FRAME) -> DataFrame:
    """Mean SNR of whole frames that carry signal, each held to -10..35 dB; rows (stream_id, pos, ref, est)."""
    f = rows.groupBy("stream_id", F.floor(F.col("pos") / frame).alias("f")).agg(F.count("*").alias("n"), F.sum(F.col("ref") * F.col("ref")).alias("p"), F.sum((F.col("ref") - F.col("est")) * (F.col("ref") - F.col("est"))).alias("e"))
    f = f.filter(F.col("n") == frame)
    top = f.groupBy("stream_id").agg(F.max("p").alias("top"))
    snr = F.greatest(F.lit(-10.0), F.least(F.lit(35.0), 10 * F.log10((F.col("p") + 1e-10) / (F.col("e") + 1e-10))))
    return f.join(top, "stream_id").groupBy("stream_id").agg(F.coalesce(F.avg(F.when(F.col("p") > F.col("top") * FLOOR, snr)), F.lit(0.0)).alias("seg_snr"))


def band_snr(ref: np.ndarray, est: np.ndarray) -> float:
    """Frequency-weighted segmental SNR: 24 bands of 512-sample frames, weighted by band energy to the 0.2."""
    n = min(len(ref), len(est))
    if n < WIDE:
        return 0.0
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(WIDE) / WIDE)
    r, e = (np.lib.stride_tricks.sliding_window_view(x[:n], WIDE)[::HOP] for x in (ref, est))
    energy = (r * r).sum(1)
    live = energy > energy.max() * FLOOR
    if not live.any():
        return 0.0
    a, b = (np.abs(np.fft.rfft(x[live] * window, axis=1)) for x in (r, e))
    edges = np.arange(BANDS) * (WIDE // 2 + 1) // BANDS
    signal, error = np.add.reduceat(a * a, edges, axis=1), np.add.reduceat((a - b) ** 2, edges, axis=1)
    snr = np.clip(10 * np.log10((signal + 1e-10) / (error + 1e-10)), -10, 35)
    weight = signal**0.2
    total = weight.sum(1)
    good = total > 0
    return float(((weight * snr).sum(1)[good] / total[good]).mean()) if good.any() else 0.0


def fw_seg_snr(rows: DataFrame) -> DataFrame:
    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("pos")
        return pd.DataFrame({"stream_id": g["stream_id"].iloc[:1], "fw_seg_snr": [band_snr(g["ref"].to_numpy(float), g["est"].to_numpy(float))]})

    kind = rows.schema["stream_id"].dataType.simpleString()
    return rows.groupBy("stream_id").applyInPandas(run, f"stream_id {kind}, fw_seg_snr double")
