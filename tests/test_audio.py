"""Signal tools against known signals, and their rows."""

import json
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline.functions import signals
from plumbline.operators import audio, frames

from . import numpy_signals as G

RATE = 16000


@pytest.fixture(scope="module")
def tone():
    """Two sines with an offset between silences."""
    t = np.arange(RATE) / RATE
    x = 0.2 * np.sin(2 * np.pi * 440 * t) + 0.05 * np.sin(2 * np.pi * 880 * t) + 0.1
    x[:1600] = x[-1600:] = 0
    return x


def peak_frequency(x):
    return np.fft.rfftfreq(len(x), 1 / RATE)[1:][np.argmax(np.abs(np.fft.rfft(x * np.hanning(len(x))))[1:])]


def test_spectrogram_inverts(tone):
    assert np.allclose(G.resynthesise(G.spectrogram(tone, centred=True), len(tone)), tone)
    shifted = G.reweighted(tone, np.ones_like)
    assert np.allclose(shifted[:10_000], tone[1024:11_024]) and shifted[-1024:].max() == 0 and len(shifted) == len(tone)


def test_band_filters():
    n, t = 4 * RATE, np.arange(4 * RATE) / RATE
    gain = lambda f, *a: np.std(G.butterworth(np.sin(2 * np.pi * f * t), RATE, *a)[n // 2 :]) * np.sqrt(2)
    assert gain(80, 4, 80.0, None) == pytest.approx(0.5**0.5, abs=2e-3) and gain(20, 4, 80.0, None) < 0.01 and gain(1000, 4, 80.0, None) == pytest.approx(1, abs=1e-3)
    assert gain(20, 2, 20.0, 7999.0) == pytest.approx(0.5**0.5, abs=1e-2) and gain(1000, 2, 20.0, 7999.0) == pytest.approx(1, abs=1e-2)
    impulse = G.butterworth(np.eye(1, 4000)[0], RATE, 4, 80.0, None)
    assert impulse[0] == pytest.approx(1, abs=0.1) and abs(impulse.sum()) < 1e-3


@pytest.mark.parametrize("algorithm", ["spectral_subtraction", "wiener", "adaptive"])
def test_denoise_lowers_noise(algorithm):
    rng, t = np.random.default_rng(0), np.arange(3 * RATE) / RATE
    noise = 0.02 * rng.standard_normal(len(t))
    x = noise + np.where(t > 1, 0.3 * np.sin(2 * np.pi * 500 * t), 0)
    y = G.denoise(x, RATE, algorithm)
    assert len(y) == len(x) and G.level(y[:8000]) < 0.8 * G.level(x[:8000]) and peak_frequency(y[20000:40000]) == pytest.approx(500, abs=2)
    with pytest.raises(ValueError):
        G.denoise(x, RATE, "magic")


def test_echo_and_short_signals(tone):
    y = G.denoise(tone, RATE, "echo_cancellation")
    assert len(y) == len(tone) and abs(y[4000:12000].mean()) < 0.01  # the offset is gone
    with pytest.raises(ValueError):
        G.denoise(np.zeros(0), RATE, "wiener")


def test_normalisers(tone):
    assert np.abs(G.loudness_normalise(tone * 30, RATE, -5.0)).max() == pytest.approx(0.95)
    quiet = G.loudness_normalise(tone, RATE)
    assert G.level(G.butterworth(quiet, RATE, 2, 20.0, 7999.0)) == pytest.approx(0.1, rel=1e-6)
    assert np.abs(G.spectral_normalise(tone, RATE)).max() == pytest.approx(0.95) and not G.spectral_normalise(np.zeros(4000), RATE).any()
    assert not G.loudness_normalise(np.zeros(4000), RATE).any()


def test_trim(tone):
    x = tone - 0.1 * (tone != 0)
    y = G.trim_silence(x, RATE)
    assert 12_000 < len(y) < 15_500 and len(G.trim_silence(np.zeros(5000), RATE)) == 5000


def test_stretch_and_shift():
    t = np.arange(2 * RATE) / RATE
    x = np.sin(2 * np.pi * 440 * t)
    fast = G.time_stretch(x, RATE, 1.25)
    assert len(fast) == round(len(x) / 1.25) and peak_frequency(fast) == pytest.approx(440, abs=3)
    up = G.pitch_shift(x, RATE, 12)
    assert len(up) == len(x) and peak_frequency(up) == pytest.approx(880, abs=5)
    with pytest.raises(ValueError):
        G.time_stretch(x, RATE, 0)


def test_resample():
    t = np.arange(100) / 100
    for n in (50, 51, 100, 150, 201):
        assert np.allclose(G.resample(np.sin(2 * np.pi * 3 * t), n), np.sin(2 * np.pi * 3 * np.arange(n) / n))


def test_noise_edits(tone):
    noisy = G.add_noise(tone, RATE, "pink", 10.0, 1)
    assert 20 * np.log10(G.level(tone) / G.level(noisy - tone)) == pytest.approx(10)
    padded = G.pad_noise(tone, RATE, "start", 0.5, seed=2)
    assert len(padded) == len(tone) + 8000 and (padded[8000:] == tone).all() and padded[0] == 0
    event = G.insert_event(tone, RATE, np.ones(100), 0.5, 0.25, 0.0)
    assert (event[:8000] == tone[:8000]).all() and (event[12000:] == tone[12000:]).all() and (event[8500:11500] != tone[8500:11500]).any()
    with pytest.raises(ValueError):
        G.insert_event(tone, RATE, np.ones(10), 2.0)
    assert np.abs(G.mix(tone, RATE, np.ones(100), 5.0)).max() == pytest.approx(1, abs=1e-6)


def test_closeness(tone):
    same, other = G.closeness(tone, tone), G.closeness(tone, np.random.default_rng(0).standard_normal(RATE))
    assert same["closeness_score"] == pytest.approx(1) and same["log_mel_l1"] == 0 and same["si_sdr_db"] > 60
    assert other["closeness_score"] < same["closeness_score"] and G.closeness(tone, tone[:8000])["si_sdr_db"] is None
    filters = G.mel_filters(RATE, 1024, 64)
    assert filters.shape == (64, 513) and (filters >= 0).all() and (filters.sum(1) > 0).all()


#: Calls that two signals of different length are put through, and the same in numpy.
CALLS = [
    ("denoise", {"algorithm": "spectral_subtraction", "noise_factor": 1.5}), ("denoise", {"algorithm": "wiener"}), ("denoise", {"algorithm": "adaptive", "sensitivity": 0.4}), ("denoise", {"algorithm": "adaptive", "sensitivity": 7}),
    ("denoise", {"algorithm": "echo_cancellation"}), ("loudness_normalize", {}), ("loudness_normalize", {"target_lufs": -3}), ("spectral_normalize", {"strength": 0.7}), ("trim_silence", {}),
    ("trim_silence", {"threshold_db": 15, "hop_length": 300}), ("time_stretch", {"rate": 1.25}), ("time_stretch", {"rate": 0.7}), ("pitch_shift", {"n_steps": 3}), ("pitch_shift", {"n_steps": -2.5, "bins_per_octave": 24}),
    ("insert_background_event", {"onset": 0.5, "duration": 0.4}), ("insert_background_event", {"onset": 1, "fade_ms": 0}),
]
NUMPY = {
    "denoise": G.denoise, "loudness_normalize": G.loudness_normalise, "spectral_normalize": G.spectral_normalise, "trim_silence": G.trim_silence, "time_stretch": lambda x, sample_rate, rate: G.time_stretch(x, sample_rate, rate),
    "pitch_shift": G.pitch_shift, "insert_background_event": G.insert_event,
}
CALL_COLUMNS = "id int, tool string, params string, rate int, samples array<float>, other array<float>"


def single(x):
    return [float(v) for v in np.float32(x)]


def burst(n, rate, seed):
    t = np.arange(n) / rate
    return single(0.3 * np.sin(2 * np.pi * 440 * t) * (t > 0.3) * (t < n / rate - 0.3) + 0.02 * np.random.default_rng(seed).standard_normal(n) * (t > 0.1))


def test_tools_match_numpy(spark):
    other, rows, want = single(np.sin(np.arange(900))), [], {}
    for n in (6000, 12_001):
        for tool, params in CALLS:
            x = burst(n, 4000, len(rows))
            want[len(rows)] = NUMPY[tool](np.array(x), 4000, *([np.array(other)] if tool == "insert_background_event" else []), **params)
            rows.append((len(rows), tool, json.dumps(params), 4000, x, other))
    got = {r["id"]: r for r in audio.run(spark.createDataFrame(rows, CALL_COLUMNS)).collect()}
    assert len(got) == len(rows)
    for k, expected in want.items():
        assert got[k]["status"] == "success" and np.allclose(got[k]["samples"], expected, atol=2e-7), rows[k][1:3]


def test_noise_levels(spark, tone):
    x, loud = single(tone), single(np.random.default_rng(1).standard_normal(RATE // 2))
    calls = [("add_noise", {"noise_type": "pink", "snr_db": 10}), ("add_noise", {"snr_db": 20, "seed": 3}), ("pad_noise", {"position": "start", "duration_sec": 0.5}), ("pad_noise", {"fade_ms": 0}), ("mix_audio", {"snr_db": 3}), ("mix_audio", {})]
    rows = [(k, tool, json.dumps(p), RATE, x, loud) for k, (tool, p) in enumerate(calls)]
    frame = spark.createDataFrame(rows, CALL_COLUMNS)
    pink, white, before, both, mixed, plain = (np.array(r["samples"]) for r in sorted(audio.run(frame).collect()))
    x = np.array(x)
    assert 20 * np.log10(G.level(x) / G.level(pink - x)) == pytest.approx(10, abs=1e-3) and 20 * np.log10(G.level(x) / G.level(white - x)) == pytest.approx(20, abs=1e-3)
    slope = [np.log(np.abs(np.fft.rfft(v - x))[a:b] ** 2).mean() for v in (pink, white) for a, b in ((50, 500), (4000, 8000))]
    assert slope[0] - slope[1] > 2.5 and abs(slope[2] - slope[3]) < 0.5
    assert len(before) == RATE + RATE // 2 and np.allclose(before[RATE // 2 :], x) and before[0] == 0
    assert len(both) == 3 * RATE and 20 * np.log10(G.level(x) / G.level(both[:RATE])) == pytest.approx(20, abs=1e-3) and not np.allclose(both[:RATE], both[2 * RATE :])
    assert np.abs(mixed).max() == pytest.approx(1, abs=1e-6) and np.abs(plain).max() == pytest.approx(1, abs=1e-6)
    draws = (white - x) / G.level(white - x)
    assert abs(draws.mean()) < 0.03 and abs((draws**4).mean() - 3) < 0.2 and abs(np.corrcoef(draws[1:], draws[:-1])[0, 1]) < 0.03


def test_rows(spark, tone):
    x = single(tone)
    wiener = '{"algorithm": "wiener"}'
    rows = [
        (1, "denoise", json.dumps({"algorithm": "wiener", "audio_path": "a"}), RATE, x, None), (2, "nothing", None, RATE, x, None), (3, "denoise", "{}", RATE, x, None), (4, "trim_silence", None, RATE, x, None),
        (5, "insert_background_event", '{"onset": 0.5}', RATE, x, [1.0] * 50), (6, "trim_silence", "not json", RATE, x, None), (7, "denoise", wiener, RATE, None, None), (8, "denoise", '{"algorithm": "magic"}', RATE, x, None),
        (9, "time_stretch", '{"rate": 0}', RATE, x, None), (10, "time_stretch", '{"rate": "fast"}', RATE, x, None), (11, "insert_background_event", '{"onset": 9}', RATE, x, [1.0]), (12, "spectral_normalize", "{}", RATE, [], None),
        (13, "trim_silence", '{"depth": 1}', RATE, x, None), (14, None, None, None, None, None), (15, "pitch_shift", '{"n_steps": 1, "n_steps": 2}', RATE, x, None), (16, "time_stretch", '{"rate": 2}', RATE, [], None), (17, "trim_silence", "[1]", RATE, x, None),
    ]
    calls = spark.createDataFrame(rows, CALL_COLUMNS)
    got = {r["id"]: (r["status"], r["samples"] is None) for r in audio.run(calls).collect()}
    assert got == {i: ("success", False) if i in (1, 4, 5, 12, 15, 16) else ("failure", True) for i in range(1, 18)}
    assert audio.run(calls.limit(0)).count() == 0
    repeated = audio.run(calls.where("id = 1").unionAll(calls.where("id = 1")).withColumn("call", F.lit(1)).withColumn("id", F.lit(None).cast("int"))).collect()
    assert len(repeated) == 2 and repeated[0] == repeated[1] and len(repeated[0]["samples"]) == RATE
    supplied = audio.injected(calls.where("id in (2, 3)").drop("other"), {"nothing": lambda samples, rate: samples * 0}).collect()
    assert {r["id"]: r["status"] for r in supplied} == {2: "success", 3: "failure"}


def test_comparisons_match_numpy(spark, tone):
    other = np.random.default_rng(0).standard_normal(RATE)
    sides = {1: (tone, tone), 2: (tone, other), 3: (tone, tone[:8000]), 4: (tone[:15_900], tone)}
    rows = [(k, RATE, single(a), single(b)) for k, (a, b) in sides.items()] + [(5, RATE, single(tone), None), (6, RATE, [], single(tone)), (None, RATE, single(tone), single(tone)), (1, RATE, single(tone), single(tone))]
    done = audio.compare(spark.createDataFrame(rows, "id int, rate int, samples array<float>, target array<float>")).collect()
    assert len(done) == len(rows)
    for r in done:
        if r["id"] in (5, 6):
            assert all(v is None for k, v in r.asDict().items() if k != "id")
        else:
            a, b = sides[r["id"] or 1]
            for k, v in G.closeness(np.array(single(a)), np.array(single(b)), RATE).items():
                assert r[k] == (v if v is None else pytest.approx(v, abs=1e-5)), (r["id"], k)


def test_exchanges(spark):
    """Rows are exchanged by signal, to be named and after each transform, and never by frame, bin or block."""
    calls = spark.createDataFrame([], CALL_COLUMNS)
    for done, most in ((audio.run(calls), 6), (audio.compare(calls.withColumn("target", F.col("other"))), 4)):
        plan = done._jdf.queryExecution().executedPlan().toString()
        keys = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)
        assert 0 < len(keys) <= most and all(re.fullmatch(r"call#\d+L?, (nth#\d+, )?\d+", k) for k in keys)


@pytest.mark.parametrize("work, exchanges", [(audio.run, 2), (lambda calls: audio.compare(calls.withColumn("target", F.col("other"))), 1)])
def test_signals_are_not_sorted(spark, work, exchanges):
    """Signals are dealt out whole, once, and stream through a task: nothing sorts, groups or cuts them into rows of frames."""
    plan = work(spark.createDataFrame([], CALL_COLUMNS))._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"\bSort\b|Window|FlatMapGroups|Generate", plan) and len(re.findall(r"Exchange hashpartitioning", plan)) == exchanges


def test_helpers():
    t = np.arange(100) / 100
    for n in (50, 51, 100, 150, 201):
        assert np.allclose(signals.resample(np.sin(2 * np.pi * 3 * t), n), np.sin(2 * np.pi * 3 * np.arange(n) / n))


def test_native(spark):
    x = F.array(*map(F.lit, [1.0, 3.0, -4.0, 2.0]))
    row = spark.range(1).select(
        audio.native("remove_dc_offset", x, F.lit(2)), audio.native("pre_emphasis", x, F.lit(2), coef=0.5), audio.native("amplitude_normalize", x, F.lit(2), target_level=0.8), audio.native("clipping", x, F.lit(2), begin=0.5, end=1.5),
        audio.interleaved(x, F.array(F.lit(9.0), F.lit(8.0))),
    ).first()
    assert list(map(pytest.approx, row)) == [[0.5, 2.5, -4.5, 1.5], [1.0, 2.5, -5.5, 4.0], [0.2, 0.6, -0.8, 0.4], [3.0, -4.0], [1.0, 9.0, 3.0, 8.0]]
    with pytest.raises(ValueError):
        audio.native("asr", x, F.lit(1))


def test_no_column_function_keeps_whole_signals_waiting(spark):
    """Handed nulls for most rows, column functions take 10,000 rows a batch, and Spark keeps all their signals meanwhile."""
    calls = spark.createDataFrame([(i, tool, params, 4000, [0.1] * 4096) for i, (tool, params) in enumerate([("loudness_normalize", "{}"), ("add_noise", '{"noise_type": "pink"}'), ("denoise", '{"algorithm": "echo_cancellation"}'), ("pitch_shift", '{"n_steps": 3}')])], "id long, tool string, params string, rate int, samples array<float>")
    done = audio.run(calls)
    assert "EvalPython" not in done._jdf.queryExecution().executedPlan().toString()
    assert [(r["status"], len(r["samples"])) for r in done.orderBy("id").collect()] == [("success", 4096)] * 4


def test_signals_change_in_parts_of_bounded_size(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0], 2), (2, None, 3), (3, [], 4), (4, [3.0], None)], "id long, x array<double>, n int").coalesce(1)
    found = frames.changed(rows, {"x": (lambda x, n: x * (n or 1), ["n"])}).orderBy("id").collect()
    assert [r["x"] for r in found] == [[2.0, 4.0], None, [], [3.0]] and [r["n"] for r in found] == [2, 3, 4, None]
    batch = pa.RecordBatch.from_arrays([pa.array([np.ones(1 << 17)] * 64)], ["x"])
    cut = list(frames.parts([batch]))
    assert sum(b.num_rows for b in cut) == 64 and max(b.num_rows for b in cut) <= 16 and all(len(x) == 1 << 17 for b in cut for x in frames.signals_of(b.column("x")))
