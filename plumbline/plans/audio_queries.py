"""Queries on signals. Spectra can't be said in SQL; tests hold the tools against known signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as X
from ..operators import audio
from ..sources import audio_files
from ..sources import records as R
from . import views as V

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

RATE, LENGTH = 4000, 6000
CALLS = [
    ("denoise", '{"algorithm": "wiener"}'), ("denoise", '{"algorithm": "adaptive", "sensitivity": 0.4}'), ("denoise", '{"algorithm": "echo_cancellation"}'), ("loudness_normalize", "{}"),
    ("spectral_normalize", "{}"), ("trim_silence", "{}"), ("time_stretch", '{"rate": 1.25}'), ("pitch_shift", '{"n_steps": 3}'), ("add_noise", '{"seed": 1}'), ("no_such_tool", "{}"),
]


def query(run):
    QUERIES[run.__name__] = run
    return run


def with_sql(sql: str):
    def add(run):
        ORACLE[run.__name__] = sql
        return query(run)

    return add


def _signals(spark, d):
    """Every embedding, repeated to a signal."""
    x = F.col("embedding").cast("array<double>")
    return V.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), X.fit_length(x, F.lit(LENGTH)).alias("samples"), F.lit(RATE).alias("rate"))


@query
def tool_runs(spark, d):
    """Each signal through one of the tools; an unknown tool is a failed row."""
    tool, params = (F.get(F.array(*[F.lit(c[k]) for c in CALLS]), (F.col("id") % len(CALLS)).cast("int")) for k in (0, 1))
    calls = _signals(spark, d).withColumns({"tool": tool, "params": params})
    done = audio.run(calls)
    return done.select("id", "status", F.size("samples").alias("n"), F.round(X.rms(F.col("samples").cast("array<double>")), 4).alias("level"))


@query
def tool_closeness(spark, d):
    """How close each signal, with its offset removed, is to itself as it was."""
    s = _signals(spark, d)
    pairs = s.select("id", "rate", audio.native("remove_dc_offset", F.col("samples"), F.col("rate")).alias("samples"), F.col("samples").alias("target"))
    return audio.compare(pairs).select("id", F.round("closeness_score", 4).alias("closeness"), F.round("rms_db_diff", 4).alias("level"), F.round("duration_ratio", 6).alias("duration_ratio"))


def _recordings(spark, d) -> str:
    """A folder with a file for each supplier, in one of four encodings and at one of three rates: the prices of what it delivered."""
    lines, key = V.table(spark, d, "lineitem"), F.col("l_suppkey")
    value = (F.col("l_extendedprice").cast("double") / 200000 - 0.3).cast("float")
    ordered = F.sort_array(F.collect_list(F.struct("l_orderkey", "l_linenumber", "l_partkey", value.alias("v"))))
    files = lines.groupBy(key).agg(ordered["v"].alias("samples")).select(
        F.concat((key % 7).cast("string"), F.lit("/s"), key, F.lit(".wav")).alias("path"), (8000 + 1000 * (key % 3)).cast("int").alias("rate"), "samples",
        F.get(F.array(*map(F.lit, _ENCODINGS)), (key % 4).cast("int")).alias("encoding"),
    )
    folder = R.scratch_folder(spark, "recordings").removeprefix("file://").removeprefix("file:")
    audio_files.register(spark)
    files.write.format("wav").mode("append").save(folder)
    return folder


_ENCODINGS = ["pcm16", "pcm24", "float32", "pcm8"]
_FILES_SQL = """f AS (
  SELECT l_suppkey AS k, 8000 + 1000 * (l_suppkey % 3) AS rate, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS i, (l_extendedprice::DOUBLE / 200000 - 0.3)::FLOAT::DOUBLE AS x FROM lineitem
), y AS (
  SELECT k, rate, i, CASE k % 4 WHEN 0 THEN round(x * 32767) / 32768 WHEN 1 THEN round(x * 8388607) / 8388608 WHEN 2 THEN x ELSE round(x * 127) / 128 END AS y FROM f
)"""


def _supplier():
    return F.regexp_extract("path", r"/s(\d+)\.wav$", 1).cast("long").alias("supplier")


@with_sql(f"""WITH {_FILES_SQL} SELECT k AS supplier, rate, CASE k % 4 WHEN 0 THEN 'pcm16' WHEN 1 THEN 'pcm24' WHEN 2 THEN 'float32' ELSE 'pcm8' END AS encoding, count(*) AS frames, round(count(*) / rate, 9) AS seconds FROM f GROUP BY k, rate""")
def audio_headers(spark, d):
    """Written recordings by their headers alone."""
    found = audio_files.headers(spark, [_recordings(spark, d)])
    return found.select(_supplier(), "rate", "encoding", "frames", F.round("seconds", 9).alias("seconds"))


@with_sql(f"""WITH {_FILES_SQL} SELECT k AS supplier, i // (rate // 50) AS segment, min(i) AS first_frame, count(*) AS n, round(sum(y), 2) AS total FROM y WHERE rate > 8000 GROUP BY k, rate, i // (rate // 50)""")
def audio_segments(spark, d):
    """The faster recordings in segments of 20 ms, each read with a halo that is left off again."""
    cut = audio_files.segments(spark, [_recordings(spark, d)], 0.02, 0.003).where("rate > 8000")
    own = F.slice("samples", F.col("before") + 1, F.size("samples") - F.col("before") - F.col("after"))
    return cut.select(_supplier(), F.col("segment").cast("long").alias("segment"), "first_frame", F.size(own).cast("long").alias("n"), F.round(F.aggregate(own, F.lit(0.0), lambda a, x: a + x), 2).alias("total"))


@with_sql(f"""WITH {_FILES_SQL} SELECT k AS supplier, 2 * count(*) AS n, round(sum(y), 2) AS even_total FROM y WHERE rate = 8000 GROUP BY k""")
def audio_resampled(spark, d):
    """The slow recordings at twice their rate, segment by segment: every second value is one of the recording's own."""
    cut = audio_files.segments(spark, [_recordings(spark, d)], 0.02, audio_files.reach(8000, 16000) / 8000).where("rate = 8000")
    out = audio_files.resampled(cut, 16000)
    even = F.aggregate(F.filter("samples", lambda x, i: (F.col("first_frame") + i) % 2 == 0), F.lit(0.0), lambda a, x: a + x)
    return out.groupBy(_supplier()).agg(F.sum(F.size("samples")).alias("n"), F.round(F.sum(even), 2).alias("even_total"))
