import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from signalloom.operators import folds
from signalloom.operators.align import EchoCanceller
from signalloom.operators.models import EnergyModel, SpectralDenoiser, WindowDetector
from signalloom.operators.quality import band_snr

RATE = 16_000
MAKE = {
    "dc": folds.dc_blocker,
    "highpass": lambda: folds.high_pass(80, RATE),
    "agc": lambda: folds.GainControl(-18, RATE),
    "limiter": lambda: folds.Limiter(-1, RATE),
    "poly": lambda: folds.PolyphaseResampler(48_000, 16_000),
    "poly_odd": lambda: folds.PolyphaseResampler(44_101, 16_000),
    "denoise": SpectralDenoiser,
}


def tone(hz, n, amp=0.5):
    return amp * np.sin(2 * np.pi * hz * np.arange(n) / RATE)


@pytest.mark.parametrize("name", MAKE)
@pytest.mark.parametrize("cuts", [1, 7, 64, "ragged"])
def test_any_cut_gives_the_same(name, cuts):
    x = np.random.default_rng(0).normal(0, 0.4, 997)
    sizes = [3, 200, 1, 500, 93, 200] if cuts == "ragged" else [cuts] * (997 // cuts) + ([997 % cuts] if 997 % cuts else [])
    whole, parts = MAKE[name](), MAKE[name]()
    a = np.concatenate([whole.process(x), whole.flush()])
    out, at = [], 0
    for n in sizes:
        out.append(parts.process(x[at : at + n]))
        at += n
    b = np.concatenate([*out, parts.flush()])
    assert len(a) == len(b) and np.allclose(a, b, atol=1e-9)


def plain_dc(x):
    y, px, py = [], 0.0, 0.0
    for v in x:
        py = v - px + 0.995 * py
        px = v
        y.append(py)
    return np.array(y)


def test_dc_blocker_is_the_recursion():
    x = np.random.default_rng(1).normal(size=1000)
    assert np.allclose(folds.dc_blocker().process(x), plain_dc(x))
    assert abs(folds.dc_blocker().process(np.full(16_000, 0.5))[-1]) < 1e-3


@pytest.mark.parametrize("hz,low,high", [(20, 0, 0.15), (80, 0.6, 0.8), (1000, 0.95, 1.05)])
def test_high_pass_response(hz, low, high):
    y = folds.high_pass(80, RATE).process(tone(hz, RATE))
    assert low <= np.sqrt(np.mean(y[RATE // 2 :] ** 2)) / (0.5 / math.sqrt(2)) <= high


@pytest.mark.parametrize("ceiling", [-1, -3, 0])
def test_limiter_never_exceeds(ceiling):
    x = np.concatenate([[5.0], tone(220, 4000, 2.0), [np.nan, np.inf, -np.inf], np.full(100, 3.0)])
    y = folds.Limiter(ceiling, RATE).process(x)
    assert np.isfinite(y).all() and np.abs(y).max() <= 10 ** (ceiling / 20) + 1e-12


def test_gain_control_settles():
    x = tone(220, 2 * RATE, 10 ** (-38 / 20) * math.sqrt(2))
    y = folds.GainControl(-18, RATE).process(x)
    level = lambda a, z: np.sqrt(np.mean(y[int(a * RATE) : int(z * RATE)] ** 2)) / 10 ** (-18 / 20)
    assert 0.7 < level(0.1, 0.2) < 1.4 and 0.8 < level(1.5, 2) < 1.25
    silent = folds.GainControl(-18, RATE)
    silent.process(np.zeros(RATE))
    assert silent.gain == 1.0


def test_linked_channels_share_one_gain():
    x = np.stack([tone(220, 800), 0.1 * tone(220, 800)], 1)
    y = folds.GainControl(-18, RATE).process(x)
    assert np.allclose(y[:, 0] * 0.1, y[:, 1])


@settings(max_examples=25, deadline=None)
@given(st.sampled_from([(48_000, 16_000), (44_100, 16_000), (16_000, 48_000), (44_101, 16_000), (16_000, 44_101), (16_000, 16_000)]), st.integers(1, 1500))
def test_resampler_counts_follow_length_only(rates, n):
    total = []
    for x in (np.zeros(n), np.random.default_rng(n).normal(size=n)):
        r = folds.PolyphaseResampler(*rates)
        total.append(len(np.concatenate([r.process(x), r.flush()])))
    assert total == [math.ceil(n * rates[1] / rates[0])] * 2


def test_resampled_tone_keeps_its_shape():
    x = np.sin(2 * np.pi * 440 * np.arange(48_000) / 48_000)
    r = folds.PolyphaseResampler(48_000, 16_000)
    y = np.concatenate([r.process(x), r.flush()])
    assert np.abs(y - np.sin(2 * np.pi * 440 * np.arange(16_000) / 16_000))[100:-100].max() < 0.01


def test_linear_resampler():
    assert folds.LinearResampler(48_000, 16_000).process(np.arange(12.0)).tolist() == [0, 3, 6, 9]
    y = folds.LinearResampler(48_000, 16_000).process(np.sin(2 * np.pi * 1000 * np.arange(480) / 48_000))
    assert len(y) == 160 and y[:16].argmax() == 4
    r = folds.LinearResampler(44_100, 16_000)
    assert abs(sum(len(r.process(np.zeros(441))) for _ in range(100)) - 16_000) <= 100


def test_echo_is_removed_and_silence_changes_nothing():
    rng = np.random.default_rng(2)
    far = rng.normal(0, 0.3, 6 * RATE)
    near = 0.25 * np.concatenate([np.zeros(400), far[:-400]])
    e = EchoCanceller(1024)
    out = np.concatenate([e.process(near[i : i + 320], far[i : i + 320]) for i in range(0, len(near), 320)] + [e.flush()])
    a = slice(3 * RATE, int(3.5 * RATE))
    assert 10 * np.log10((near[a] ** 2).sum() / (out[a] ** 2).sum()) > 30
    for block in (320, 1600, 4801):
        e = EchoCanceller(1024)
        x = rng.normal(size=4801)
        y = np.concatenate([e.process(x[i : i + block], np.zeros(len(x[i : i + block]))) for i in range(0, len(x), block)] + [e.flush()])
        assert (y == x).all()


def test_detector_leftovers_and_reset():
    d = WindowDetector(EnergyModel(), RATE, 512)
    assert len(d.scores(np.ones(1600))) == 3 and len(d.left) == 64
    assert len(d.scores(np.ones(1600))) == 3 and len(d.left) == 128
    first = WindowDetector(EnergyModel(), RATE, 512).scores(np.ones(1024))
    d.reset()
    assert d.scores(np.ones(1024)) == first


def test_denoiser_latency():
    d = SpectralDenoiser()
    assert len(d.flush()) == 0
    assert len(d.process(np.ones(512))) == 512
    assert len(d.flush()) == 256


def test_band_snr_ranks():
    x = np.random.default_rng(3).normal(size=4096)
    assert band_snr(x, x) == 35 and band_snr(x, x + 0.1 * np.roll(x, 5)) > band_snr(x, 0.5 * np.roll(x, 5)) and band_snr(x[:100], x[:100]) == 0


@pytest.mark.parametrize("rates", [(48_000, 16_000), (44_100, 16_000), (16_000, 44_101)])
def test_resampler_values_are_the_direct_sum(rates):
    x = np.random.default_rng(6).normal(0, 0.3, 700)
    r = folds.PolyphaseResampler(*rates)
    got = np.concatenate([r.process(x[:123]), r.process(x[123:]), r.flush()])
    cut = min(1.0, rates[1] / rates[0]) * 0.95
    half = math.ceil(16 / cut)
    for j in range(0, len(got), 7):
        t = np.arange(700) - j * rates[0] / rates[1]
        near = (t > -half - 1) & (t <= half)
        w = np.sinc(t * cut) * cut * (0.5 + 0.5 * np.cos(np.pi * np.clip(t / half, -1, 1)))
        assert abs(got[j] - (x * w)[near].sum()) < 1e-9


def test_tables_are_made_once():
    folds.block_tables.cache_clear()
    folds.tap_table.cache_clear()
    for _ in range(50):
        folds.GainControl(-18, RATE), folds.dc_blocker(), folds.PolyphaseResampler(44_100, 16_000).process(np.ones(500))
    assert folds.block_tables.cache_info().misses == 2 and folds.tap_table.cache_info().misses == 1
