"""The audio data source: headers of any legal layout, formats, pushed conditions, segments, resampling, writing."""

import io
import struct
import time
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.plans import audio_queries
from plumbline.sources import audio_files, riff, wav

from .oracle import check

WAVE = np.sin(np.arange(4000) / 17) * 0.7


def chunk(name, body):
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def custom(*chunks, form=b"RIFF", size=None):
    body = b"WAVE" + b"".join(chunks)
    return form + struct.pack("<I", len(body) if size is None else size) + body


FMT = chunk(b"fmt ", struct.pack("<HHIIHH", 1, 1, 8000, 16000, 2, 16))
DATA = np.arange(-50, 50, dtype="<i2").tobytes()


@pytest.mark.parametrize("encoding,step", [("pcm8", 2**-7), ("pcm16", 2**-15), ("pcm24", 2**-23), ("pcm32", 2**-30), ("float32", 2**-23), ("float64", 0)])
@pytest.mark.parametrize("extensible", [False, True])
@pytest.mark.parametrize("channels", [1, 3])
def test_formats(encoding, step, extensible, channels):
    x = np.stack([WAVE * (c + 1) / 3 for c in range(channels)], 1)
    head, got = audio_files.decode(riff.encode(x if channels > 1 else x[:, 0], 44100, encoding, extensible))
    assert (head.rate, head.channels, head.encoding, head.frames) == (44100, channels, encoding, 4000)
    assert np.abs(got - x).max() <= 1.5 * step  # half a step of rounding, and writers scale by one step less than readers


def test_the_standard_library_reads_what_is_written():
    with wave.open(io.BytesIO(riff.encode(WAVE, 16000))) as w:
        assert (w.getframerate(), w.getnframes()) == (16000, 4000) and np.abs(np.frombuffer(w.readframes(4000), "<i2") / 32767 - WAVE).max() < 2**-15


@pytest.mark.parametrize("raw,frames", [
    (custom(FMT, chunk(b"data", DATA)), 100), (custom(chunk(b"LIST", b"abc"), FMT, chunk(b"fact", b"1234"), chunk(b"odd ", b"x"), chunk(b"data", DATA)), 100),
    (custom(FMT, b"data" + struct.pack("<I", 0xFFFFFFFF) + DATA), 100), (custom(FMT, b"data" + struct.pack("<I", 0) + DATA), 100), (custom(FMT, b"data" + struct.pack("<I", 9999) + DATA), 100),
    (custom(chunk(b"ds64", struct.pack("<QQQI", 0, 200, 0, 0)), FMT, b"data" + struct.pack("<I", 0xFFFFFFFF) + DATA + b"tail", form=b"RF64", size=0xFFFFFFFF), 100), (custom(FMT, chunk(b"data", DATA[:-1])), 99), (custom(chunk(b"data", DATA), FMT), 100),
])
def test_any_legal_header(raw, frames):
    head, x = audio_files.decode(raw)
    assert head.frames == frames and np.allclose(x[:, 0] * 32768, np.arange(-50, 50)[:frames])


def test_big_endian_and_companded():
    fmt = b"fmt " + struct.pack(">IHHIIHH", 16, 1, 1, 8000, 24000, 3, 24)
    raw = b"RIFX" + struct.pack(">I", 0) + b"WAVE" + fmt + b"data" + struct.pack(">I", 6) + bytes([0x40, 0, 0, 0xC0, 0, 0])
    assert audio_files.decode(raw)[1][:, 0].tolist() == [0.5, -0.5]
    # Known values: silence and the extremes.
    assert riff._MULAW[[0xFF, 0x7F, 0x00, 0x80]].tolist() == [0, 0, -32124 / 32768, 32124 / 32768] and riff._ALAW[[0xD5, 0x55, 0x2A, 0xAA]].tolist() == [8 / 32768, -8 / 32768, -32256 / 32768, 32256 / 32768]


@pytest.mark.parametrize("raw,why", [
    (b"", "ends within"), (b"RIFF0000AVI ....", "not a RIFF"), (custom(FMT), "no data"), (custom(chunk(b"data", DATA)), "no format"), (custom(chunk(b"fmt ", b"x" * 10), chunk(b"data", DATA)), "no format"),
    (custom(chunk(b"fmt ", struct.pack("<HHIIHH", 2, 1, 8000, 0, 2, 16)), chunk(b"data", DATA)), "format 2"), (custom(chunk(b"fmt ", struct.pack("<HHIIHH", 1, 1, 8000, 0, 2, 12)), chunk(b"data", DATA)), "12 bits"),
    (custom(chunk(b"fmt ", struct.pack("<HHIIHH", 1, 0, 8000, 0, 0, 16)), chunk(b"data", DATA)), "no channels"), (custom(chunk(b"fmt ", struct.pack("<HHIIHH", 1, 2, 8000, 0, 2, 16)), chunk(b"data", DATA)), "frames of 2"),
])
def test_broken_files_say_why(raw, why):
    with pytest.raises(riff.UnreadableAudio, match=why):
        audio_files.decode(raw)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    top = tmp_path_factory.mktemp("audio")
    (top / "sub").mkdir()
    (top / "a.wav").write_bytes(riff.encode(WAVE, 8000))
    (top / "sub/b.WAV").write_bytes(riff.encode(np.stack([WAVE, -WAVE / 2], 1), 16000, "pcm24", True))
    (top / "bad.wav").write_bytes(b"junk that is no audio")
    (top / "empty.wav").write_bytes(riff.encode(np.zeros(0), 8000))
    (top / "note.txt").write_text("x")
    with (top / "huge.wav").open("wb") as f:  # 20 GB, of which only the header exists
        f.write(custom(FMT, b"data" + struct.pack("<I", 0xFFFFFFFF)))
        f.truncate(20 << 30)
    return top


def test_headers_read_no_samples(spark, folder):
    begin = time.time()
    got = {r["path"].rsplit("/", 1)[1]: r for r in audio_files.headers(spark, [str(folder)]).collect()}
    assert time.time() - begin < 60 and set(got) == {"a.wav", "b.WAV", "bad.wav", "empty.wav", "huge.wav"}
    assert (got["a.wav"]["rate"], got["a.wav"]["seconds"], got["a.wav"]["encoding"]) == (8000, 0.5, "pcm16")
    assert (got["b.WAV"]["channels"], got["b.WAV"]["seconds"], got["b.WAV"]["bits"]) == (2, 0.25, 24)
    assert got["bad.wav"]["status"] == "failure" and "RIFF" in got["bad.wav"]["message"] and got["empty.wav"]["frames"] == 0
    assert got["huge.wav"]["seconds"] == ((20 << 30) - 44) // 2 / 8000


def test_conditions_are_met_before_samples_are_read(spark, folder):
    cut = audio_files.segments(spark, [str(folder)], 0.1).where((F.col("seconds") < 10) & (F.col("rate") >= 8000) & F.col("path").contains("/"))
    assert "Filter" not in cut._jdf.queryExecution().executedPlan().toString().split("BatchScan")[0]
    rows = cut.orderBy("path", "segment").collect()  # the huge file alone would never end
    assert [r["segment"] for r in rows if r["path"].endswith("a.wav")] == [0, 1, 2, 3, 4] and [r["segment"] for r in rows if r["path"].endswith("b.WAV")] == [0, 1, 2]
    assert np.allclose(np.concatenate([r["samples"] for r in rows if r["path"].endswith("a.wav")]), WAVE, atol=2**-14)
    assert np.allclose(np.concatenate([r["samples"] for r in rows if r["path"].endswith("b.WAV")]), WAVE / 4, atol=2**-20)
    bad = audio_files.segments(spark, [str(folder)], 0.1).where("status = 'failure'").collect()
    assert [r["path"].rsplit("/", 1)[1] for r in bad] == ["bad.wav"]
    odd = audio_files.headers(spark, [str(folder)]).where("seconds * 2 = 1 or message is not null").collect()  # conditions that stay with Spark
    assert {r["path"].rsplit("/", 1)[1] for r in odd} == {"a.wav", "bad.wav"}


def test_partitions_are_planned_by_bytes():
    files = [("s1", 10), ("s2", 20), ("long", 1000), ("s3", 5)]
    parts = audio_files.planned(files, False, 100)
    assert [len(p.shares) for p in parts] == [2] + [1] * 10 + [1] and sorted(x for p in parts for x in p.shares if x[0] == "long") == [("long", 1000, i, 10) for i in range(10)]
    assert len(audio_files.planned(files, True, 100)) == 1 and len(audio_files.planned([(f"f{i}", 1 << 40) for i in range(3000)], True)) == 3
    assert [len(p.shares) for p in audio_files.planned([], True)] == [0]


def test_a_long_file_is_many_rows_of_many_partitions(spark, tmp_path):
    x = np.random.default_rng(1).uniform(-0.9, 0.9, 100_000)
    (tmp_path / "x.wav").write_bytes(riff.encode(x, 10_000, "float64"))
    audio_files.register(spark)
    cut = spark.read.format("wav").options(segment=0.37, halo=0.01, partBytes=100_000).load(str(tmp_path))
    assert cut.rdd.getNumPartitions() == 9
    rows = cut.orderBy("segment").collect()
    own = [np.array(r["samples"])[r["before"] : len(r["samples"]) - r["after"]] for r in rows]
    assert np.allclose(np.concatenate(own), x, atol=1e-6) and len(rows) == 28 and [r["before"] for r in rows] == [0] + [100] * 27 and rows[-1]["after"] == 0
    assert all(r["first_frame"] == 3700 * i and r["begin"] == 3700 * i / 10_000 for i, r in enumerate(rows))


@pytest.mark.parametrize("rate,target", [(44100, 16000), (8000, 16000), (16000, 16000), (16000, 11025), (48000, 8000)])
def test_resampling(spark, tmp_path, rate, target):
    t = np.arange(rate) / rate
    tone = lambda t: 0.5 * np.sin(2 * np.pi * 440 * t) + 0.3 * np.cos(2 * np.pi * 1234.5 * t)
    (tmp_path / "x.wav").write_bytes(riff.encode(tone(t), rate, "float64"))
    audio_files.register(spark)
    halo = audio_files.reach(rate, target) / rate
    joined = []
    for seconds in (0.0371, 1000.0):
        rows = audio_files.resampled(audio_files.segments(spark, [str(tmp_path)], seconds, halo), target).orderBy("segment").collect()
        y = np.concatenate([r["samples"] for r in rows])
        assert len(y) == target and [r["first_frame"] for r in rows] == np.cumsum([0, *(len(r["samples"]) for r in rows[:-1])]).tolist()
        joined.append(y)
    assert np.abs(joined[0] - joined[1]).max() < 1e-6
    edge = int(2 * halo * target) + 1
    assert np.abs(joined[1] - tone(np.arange(target) / target))[edge:-edge].max() < 1e-4


def test_writing(spark, tmp_path):
    rows = [("x/1.wav", 8000, [0.5, -0.25], "pcm16"), ("2.wav", 44100, [], "float32"), ("3.wav", 11025, [1.0, 2.0], "pcm24")]
    audio_files.register(spark)
    frame = spark.createDataFrame(rows, "path string, rate int, samples array<float>, encoding string").repartition(2)
    frame.write.format("wav").mode("append").save(str(tmp_path / "out"))
    got = {r["path"].split("/out/")[1]: (r["rate"], r["frames"], r["encoding"]) for r in audio_files.headers(spark, [str(tmp_path / "out")]).collect()}
    assert got == {"x/1.wav": (8000, 2, "pcm16"), "2.wav": (44100, 0, "float32"), "3.wav": (11025, 2, "pcm24")}
    frame.drop("encoding").write.format("wav").mode("append").option("encoding", "pcm8").save(str(tmp_path / "out"))
    assert {r["encoding"] for r in audio_files.headers(spark, [str(tmp_path / "out")]).collect()} == {"pcm8"} and not list(tmp_path.glob("out/**/*.part"))


def test_sources(spark, folder):
    gone = spark.createDataFrame([("b",), ("A_a",)], "stem string")
    assert [r["stem"] for r in audio_files.sources(spark, [str(folder)], limit=3).collect()] == ["a", "bad", "empty"]
    assert [r["stem"] for r in audio_files.sources(spark, [str(folder), str(folder / "sub")], gone).orderBy("stem").collect()] == ["bad", "empty", "huge"]


def test_decoders_in_order(spark, tmp_path):
    (tmp_path / "a.wav").write_bytes(riff.encode(WAVE, 8000, "pcm24", True))
    (tmp_path / "b.raw").write_bytes(b"raw!" + np.full(50, 0.5).tobytes())
    (tmp_path / "c.wav").write_bytes(b"junk")

    def by_raw(raw):
        if raw[:4] != b"raw!":
            raise RuntimeError("not raw")
        return 100, np.frombuffer(raw[4:]).reshape(-1, 1)

    files = spark.read.format("binaryFile").load(str(tmp_path)).select("path", "content")
    got = {r["path"][-5]: r for r in wav.read_segments(files, decoders=(("riff", wav.by_riff), ("raw", by_raw))).collect()}
    assert (got["a"]["decoder"], got["a"]["n_frames"], got["b"]["decoder"], got["b"]["samples"]) == ("riff", 4000, "raw", [0.5] * 50)
    assert got["c"]["status"] == "failure" and got["c"]["message"] == "riff: the file ends within its header; raw: not raw"


@pytest.mark.parametrize("name", sorted(audio_queries.ORACLE))
def test_sql(spark, sf, name):
    check(spark, audio_queries.QUERIES[name], audio_queries.ORACLE[name], sf)
