"""Row layouts. Positions are integers; seconds are derived from them last."""

from __future__ import annotations

CHUNK = "stream_id string, seq long, sample_rate int, channels int, data array<float>"
SAMPLE = "stream_id string, channel int, pos long, x double"
WINDOW = "stream_id string, win long, start double, end double, probability double, is_speech boolean"
SEGMENT = "stream_id string, seg long, start double, end double"
SAVE_REPORT = "stream_id string, path string, clipped_samples long, non_finite_samples long"
DEVICE = "index int, name string, id string, channels int, sample_rate int, is_default boolean"
