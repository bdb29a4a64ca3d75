"""Signal tools, edits and comparisons on rows of samples. A call that fails is a row.

Steps on single samples are columns; those that need a spectrum work on whole signals in Arrow batches (operators.frames).
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as X
from ..functions.scalar import let
from . import frames as S

NEEDED = object()
#: The tools' parameters and what they are where a call doesn't give them (None: none).
PARAMETERS: dict[str, dict[str, object]] = {
    "denoise": {"algorithm": NEEDED, "noise_factor": 2.0, "sensitivity": 0.5},
    "loudness_normalize": {"target_lufs": -23.0},
    "spectral_normalize": {"strength": 0.5},
    "trim_silence": {"threshold_db": 40.0, "frame_length": 2048, "hop_length": 512},
    "time_stretch": {"rate": NEEDED},
    "pitch_shift": {"n_steps": NEEDED, "bins_per_octave": 12},
    "add_noise": {"noise_type": "white", "snr_db": 15.0, "seed": 0},
    "pad_noise": {"position": "both", "duration_sec": 1.0, "noise_type": "white", "snr_db": 20.0, "fade_ms": 20.0, "seed": 0},
    "insert_background_event": {"onset": NEEDED, "duration": None, "snr_db": 5.0, "fade_ms": 20.0},
    "mix_audio": {"snr_db": None, "seed": 0},
}
#: Parameters that are words, and the words they may be; all others are numbers.
WORDS = {
    "algorithm": ["spectral_subtraction", "wiener", "echo_cancellation", "adaptive"],
    "noise_type": ["white", "pink"],
    "position": ["start", "end", "both"],
}
#: Parameters that say where a signal lies rather than what is done to it.
PLACES = ("audio_id", "audio_path", "audio_begin", "audio_end", "output_path")
RESULT = "rate int, samples array<float>, status string, message string"
CLOSENESS = "duration_pred_sec double, duration_target_sec double, duration_ratio double, log_mel_cosine double, log_mel_l1 double, mfcc_cosine double, rms_db_pred double, rms_db_target double, rms_db_diff double, si_sdr_db double, closeness_score double"


def native(tool: str, x: Column, rate: Column, **params) -> Column:
    """A tool that needs no spectrum, as an expression on array<double>."""
    if tool == "amplitude_normalize":
        method = params.get("method", "peak")
        if method not in ("peak", "rms"):
            raise ValueError(f"unknown normalisation {method}")
        return (X.normalise_peak if method == "peak" else X.normalise_rms)(x, params.get("target_level", 0.9))
    if tool == "remove_dc_offset":
        return X.remove_offset(x)
    if tool == "pre_emphasis":
        return X.pre_emphasis(x, params.get("coef", 0.97))
    if tool == "clipping":
        first, last = (F.floor(rate * params[k]).cast("int") for k in ("begin", "end"))
        return F.slice(x, first + 1, F.greatest(F.lit(0), last - first))
    raise ValueError(f"no native form of {tool}")


def interleaved(left: Column, right: Column) -> Column:
    """Two channels as one stereo array, as long as the shorter one."""
    n = F.least(F.size(left), F.size(right))
    return F.flatten(F.zip_with(F.slice(left, F.lit(1), n), F.slice(right, F.lit(1), n), lambda a, b: F.array(a, b)))


def noise(n: Column, *seed: Column) -> Column:
    """n values of white noise, drawn from a hash of seed and place."""
    draw = lambda i, k: (F.pmod(F.xxhash64(*seed, i, F.lit(k)), F.lit(1 << 52)) + 1) / (1 << 52)
    # a place's two draws by the polar form of the normal distribution
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.sqrt(-2 * F.log(draw(i, 0))) * F.cos(2 * np.pi * draw(i, 1)))).otherwise(F.array().cast("array<double>"))


def of_level_one(x: Column) -> Column:
    return let(X.rms(x), lambda level: F.when(level > 0, F.transform(x, lambda v: v / level)).otherwise(x))


def trimmed(x: Column, threshold_db: Column, length: Column, hop: Column) -> Column:
    """x from its first to its last frame that is not threshold_db below the loudest."""
    levels = F.transform(S.cut(S.centred(x, length), length, hop), lambda f: 20 * F.log10(F.greatest(F.lit(1e-5), X.rms(f))))

    def between(level: Column) -> Column:
        least = F.array_max(level) - threshold_db
        loud = let(least, lambda at: F.filter(F.sequence(F.lit(0), F.size(level) - 1), lambda k: F.get(level, k) > at))
        return let(loud, lambda k: F.slice(x, F.get(k, F.lit(0)) * hop + 1, (F.get(k, F.size(k) - 1) + 1 - F.get(k, F.lit(0))) * hop))

    return let(levels, between)


def louder(x: Column, heard: Column, target_lufs: Column) -> Column:
    """x at a loudness, given what of it is heard; peaks above the limit bring all down."""
    gained = let(X.rms(heard), lambda level: F.when(level > 0, let(F.pow(10.0, (target_lufs + 23 - 20 * F.log10(level / 0.1)) / 20), lambda g: F.transform(x, lambda v: v * g))))
    capped = lambda y: let(F.greatest(F.lit(1.0), F.array_max(F.transform(y, F.abs)) / S.PEAK), lambda over: F.transform(y, lambda v: v / over))
    return F.coalesce(let(gained, capped), x)


def padding(rate: Column, own: Column, unit: Column, snr_db: Column, fade_ms: Column) -> Column:
    """Noise that stands before or behind a signal of level `own`."""
    want = F.when(own > 0, own / X.db_ratio(snr_db)).otherwise(0.01)
    return X.fade(let(want, lambda w: F.transform(unit, lambda v: v * w)), F.greatest(F.lit(0), F.floor(rate * fade_ms / 1000).cast("int")))


def with_event(x: Column, first: Column, event: Column, n: Column, snr_db: Column, fade: Column) -> Column:
    """x with n values of an event, looped if it is shorter, at a level relative to what it covers."""
    def laid(at: Column) -> Column:
        covering = X.scale_to_snr(F.slice(x, at["first"] + 1, at["n"]), X.fade(X.fit_length(event, at["n"]), fade), snr_db)
        return let(covering, lambda e: F.transform(x, lambda v, i: F.when((i >= at["first"]) & (i < at["first"] + at["n"]), v + F.get(e, i - at["first"])).otherwise(v)))

    return let(F.struct(first.alias("first"), n.alias("n")), laid)


def mixed(x: Column, other: Column, snr_db: Column, draw: Column) -> Column:
    """x and a noise placed in it, or cut from, where `draw` (0 to 1) says; the peak becomes 1."""
    spare = F.size(other) - F.size(x)
    at = F.least(F.abs(spare), F.floor(draw * (F.abs(spare) + 1))).cast("int")
    placed = F.when(spare >= 0, F.slice(other, at + 1, F.size(x))).otherwise(X.match_length(F.concat(F.array_repeat(F.lit(0.0), at), other), F.size(x)))
    power = lambda v: X.dot(v, v) / F.size(v)
    factor = lambda v: F.when(snr_db.isNull(), 1.0).otherwise(F.sqrt(power(x) / F.pow(10.0, snr_db / 10) / (power(v) + 1e-8)))
    both = let(placed, lambda p: let(factor(p), lambda f: F.zip_with(x, p, lambda a, b: a + b * f)))
    return let(both, lambda y: let(F.array_max(F.transform(y, F.abs)) + 1e-8, lambda peak: F.transform(y, lambda v: v / peak)))


def _parameters() -> Column:
    """A call's parameters as texts, null if they aren't a JSON object; none is as good as an empty one, and null is none."""
    text = F.when(F.coalesce(F.trim("params"), F.lit("")) == "", "{}").otherwise(F.col("params"))
    return F.map_filter(F.from_json(text, "map<string,string>"), lambda k, v: v.isNotNull())


def _given(name: str, default) -> Column:
    """A call's parameter; null where it isn't what the parameter has to be."""
    text = F.col("given")[name]
    value = text if name in WORDS else text.try_cast("double")
    return value if default is NEEDED or default is None else F.when(text.isNull(), F.lit(default)).otherwise(value)


def _of(tool: str, name: str) -> Column:
    return _given(name, PARAMETERS[tool][name])


def _complaint() -> Column:
    """What is wrong with a call, null if nothing is."""
    tool, given, n = F.col("tool"), F.col("given"), F.size("x")
    found = [F.when(tool.isNull() | ~tool.isin(*PARAMETERS), F.concat(F.lit("unknown tool "), F.coalesce(tool, F.lit("null")))), F.when(given.isNull(), "the parameters aren't a JSON object"), F.when(F.coalesce(F.col("rate"), F.lit(0)) <= 0, "there is no sample rate")]
    for name, parameters in PARAMETERS.items():
        own = tool == name
        other = F.array_join(F.array_except(F.map_keys(given), F.array(*map(F.lit, (*parameters, *PLACES)))), ", ")
        found.append(F.when(own & (other != ""), F.concat(F.lit("unexpected parameters: "), other)))
        for k, default in parameters.items():
            value = _given(k, default)
            wrong = value.isNull() & given[k].isNotNull() if default is None else value.isNull()
            found.append(F.when(own & (wrong | ~value.isin(*WORDS[k]) if k in WORDS else own & wrong), f"{k} is missing or no {'known word' if k in WORDS else 'number'}"))
    onset, covered = _of("insert_background_event", "onset"), _event_length()
    found += [
        F.when((tool == "denoise") & (n < S.N_FFT), f"the segment is shorter than a window of {S.N_FFT} samples"),
        F.when((tool == "time_stretch") & (_of("time_stretch", "rate") <= 0), "rate must be greater than 0"),
        F.when((tool == "pitch_shift") & (_of("pitch_shift", "bins_per_octave") <= 0), "bins_per_octave must be greater than 0"),
        F.when((tool == "trim_silence") & ((_of("trim_silence", "frame_length") < 1) | (_of("trim_silence", "hop_length") < 1)), "frames and hops have at least one sample"),
        F.when((tool == "pad_noise") & (_of("pad_noise", "duration_sec") <= 0), "duration_sec must be over 0"),
        F.when((tool == "insert_background_event") & ((onset < 0) | (covered <= 0) | (F.size("y") == 0)), "no room for an event there"),
    ]
    return F.coalesce(*found)


def _event_length() -> Column:
    onset, duration = _of("insert_background_event", "onset"), _of("insert_background_event", "duration")
    wanted = F.when(F.coalesce(duration, F.lit(0.0)) == 0, F.size("y")).otherwise(F.floor(F.col("rate") * duration))
    return F.least(wanted, F.size("x") - F.floor(onset * F.col("rate"))).cast("int")


def _plain(calls: DataFrame) -> DataFrame:
    """(head, samples, message) of failures and of calls whose tools need no frames."""
    x, rate, tool, right = F.col("x"), F.col("rate"), F.col("tool"), F.col("message").isNull()
    is_ = lambda *names: right & tool.isin(*names)
    pads = F.floor(rate * _of("pad_noise", "duration_sec")).cast("int")
    rows = calls.where(~is_(*SPECTRAL)).withColumn("seed", F.coalesce(F.col("given")["seed"].try_cast("double"), F.lit(0.0)))
    second = F.when(is_("pad_noise"), pads)
    rows = rows.select(
        "head", "tool", "params", "rate", "x", "y", "message", "seed", F.when(is_("loudness_normalize"), x).alias("heard"), F.least(F.lit(20000.0), rate / 2 - 1).alias("high"), F.coalesce(F.col("given")["noise_type"], F.lit("white")).alias("kind"),
        noise(F.when(is_("add_noise"), F.size("x")).otherwise(second), F.col("seed"), F.lit("first")).alias("first"), noise(second, F.col("seed"), F.lit("second")).alias("second"),
    )
    rows = S.changed(rows, {"heard": (S.band_passed, ["rate", "high"]), "first": (S.coloured, ["kind"]), "second": (S.coloured, ["kind"])}).withColumn("given", _parameters())
    whole = lambda t, name: _of(t, name).cast("int")
    pad = lambda c: padding(rate, X.rms(x), of_level_one(F.col(c)), _of("pad_noise", "snr_db"), _of("pad_noise", "fade_ms"))
    nothing, position = F.array().cast("array<double>"), _of("pad_noise", "position")
    draw = F.pmod(F.xxhash64("seed"), F.lit(1 << 52)) / (1 << 52)
    event = [_of("insert_background_event", k) for k in ("onset", "snr_db", "fade_ms")]
    samples = (
        F.when(is_("loudness_normalize"), louder(x, F.col("heard"), _of("loudness_normalize", "target_lufs")))
        .when(is_("trim_silence"), trimmed(x, _of("trim_silence", "threshold_db"), whole("trim_silence", "frame_length"), whole("trim_silence", "hop_length")))
        .when(is_("add_noise"), F.zip_with(x, X.scale_to_snr(x, of_level_one(F.col("first")), _of("add_noise", "snr_db")), lambda a, b: a + b))
        .when(is_("pad_noise"), F.concat(F.when(position != "end", pad("first")).otherwise(nothing), x, F.when(position != "start", pad("second")).otherwise(nothing)))
        .when(is_("insert_background_event"), with_event(x, F.floor(event[0] * rate).cast("int"), F.col("y"), _event_length(), event[1], F.floor(rate * event[2] / 1000).cast("int")))
        .when(is_("mix_audio"), mixed(x, F.col("y"), _of("mix_audio", "snr_db"), draw))
    )
    return rows.select("head", samples.alias("samples"), "message")


SPECTRAL = ("denoise", "spectral_normalize", "time_stretch", "pitch_shift")


def run(calls: DataFrame) -> DataFrame:
    """(id, RESULT) of calls (id, tool, params, rate, samples), and `other` where a tool takes two signals; params: a JSON object.

    Unknown tools, missing, unexpected or wrong parameters, and signals that a tool can't take give status failure, null samples and
    a message; null samples count as none. Repeated ids and equal calls give a row each; further columns are left out.
    """
    signal = lambda c: F.coalesce(F.col(c).cast("array<double>"), F.array().cast("array<double>"))
    other = F.col("other") if "other" in calls.columns else F.lit(None).cast("array<double>")
    rows = calls.select("id", "tool", "params", F.col("rate").cast("int").alias("rate"), F.col("samples").cast("array<double>").alias("samples"), other.cast("array<double>").alias("other"))
    rows = rows.select("*", F.struct("id", "rate").alias("head"), signal("samples").alias("x"), signal("other").alias("y"), _parameters().alias("given")).withColumn("message", _complaint())
    right = F.col("message").isNull()
    spectral = S.dealt(rows.where(right & F.col("tool").isin(*SPECTRAL)).select("tool", "head", "rate", "x", "params")).withColumn("given", _parameters())
    gain = F.when(F.col("tool") == "spectral_normalize", F.col("tool")).otherwise(F.col("given")["algorithm"])
    factor = F.when(gain == "spectral_normalize", _of("spectral_normalize", "strength")).when(gain == "adaptive", _of("denoise", "sensitivity")).otherwise(_of("denoise", "noise_factor"))
    cleaned = spectral.where(F.col("tool").isin("denoise", "spectral_normalize")).select(S.CALL, "head", "rate", "x", gain.alias("gain"), factor.alias("factor"))
    shift = F.col("tool") == "pitch_shift"
    speed = F.when(shift, F.pow(2.0, -_of("pitch_shift", "n_steps") / _of("pitch_shift", "bins_per_octave"))).otherwise(_of("time_stretch", "rate"))
    timed = spectral.where(F.col("tool").isin("time_stretch", "pitch_shift")).select(S.CALL, F.struct("head.id", "head.rate", F.when(shift, F.size("x")).alias("length"), speed.alias("speed")).alias("head"), "x", speed.alias("speed"))
    y, length = F.col("samples"), F.col("head.length")
    back = S.changed(S.stretched(timed).withColumn("n", F.when(length.isNotNull(), F.ceil(F.size(y) * F.col("head.speed")))), {"samples": (S.resampled, ["n"])})
    played = back.select(F.struct("head.id", "head.rate").alias("head"), F.when(length.isNull(), y).otherwise(X.match_length(y, length)).alias("samples"))
    done = _plain(rows).unionByName(S.reweighted(cleaned).unionByName(played).withColumn("message", F.lit(None).cast("string")))
    status = F.when(F.col("message").isNull(), "success").otherwise("failure")
    return done.select("head.id", "head.rate", F.col("samples").cast("array<float>").alias("samples"), status.alias("status"), "message")


def injected(calls: DataFrame, tools: dict[str, Callable[..., np.ndarray]]) -> DataFrame:
    """As run, with tools that the caller supplies, such as models: (samples, rate, parameters) -> samples."""
    def one(row) -> tuple:
        try:
            params = {k: v for k, v in json.loads(row.params or "{}").items() if k not in PLACES}
            if row.tool not in tools:
                raise ValueError(f"unknown tool {row.tool}")
            y = tools[row.tool](np.zeros(0) if row.samples is None else np.asarray(row.samples, np.float64), int(row.rate), **params)
            return row.id, row.rate, np.asarray(y, np.float32), "success", None
        except Exception as error:  # the tool's own failure, whatever it is, becomes a row
            return row.id, row.rate, None, "failure", str(error)

    def batch(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            yield pd.DataFrame([one(r) for r in pdf.itertuples(index=False)], columns=["id", "rate", "samples", "status", "message"])

    return calls.select("id", "tool", "params", "rate", "samples").mapInPandas(batch, f"id {dict(calls.dtypes)['id']}, {RESULT}")


def compare(pairs: DataFrame) -> DataFrame:
    """(id, CLOSENESS) of pairs (id, rate, samples, target); an empty or null signal gives nulls. Durations, levels, the distortion
    ratio (where the durations differ by less than 2 %) and the cosines of log-mel levels and cepstra over a common time axis."""
    rows = pairs.select("id", F.col("rate").cast("int").alias("rate"), F.col("samples").cast("array<double>").alias("x"), F.col("target").cast("array<double>").alias("y"))
    x, y, rate = F.col("x"), F.col("y"), F.col("rate")
    ratio, heard = F.size(x) / F.size(y), (F.size(x) > 0) & (F.size(y) > 0) & (rate > 0)
    plain = {
        "duration_pred_sec": F.size(x) / rate, "duration_target_sec": F.size(y) / rate, "duration_ratio": ratio, "rms_db_pred": X.level_db(x), "rms_db_target": X.level_db(y),
        "si_sdr_db": F.when(F.abs(ratio - 1) < 0.02, X.si_sdr(x, y)),
    }
    head = F.struct("id", *[v.alias(k) for k, v in plain.items()])
    close = S.spectral_closeness(S.dealt(rows.where(heard).select("rate", "x", "y", head.alias("head"))))
    names = [c.split()[0] for c in CLOSENESS.split(", ")]
    close = close.select("head.*", "log_mel_cosine", "log_mel_l1", "mfcc_cosine").withColumns({"rms_db_diff": F.col("rms_db_pred") - F.col("rms_db_target"), "closeness_score": X.closeness(F.col("log_mel_cosine"), F.col("mfcc_cosine"))})
    unheard = rows.where(~F.coalesce(heard, F.lit(False))).select("id", *[F.lit(None).cast("double").alias(c) for c in names])
    return close.select("id", *names).unionByName(unheard)
