"""Audio files as a Spark data source: one row a file from its header alone, or one row a segment.

    audio_files.register(spark)
    spark.read.format("wav").load("/data/recordings")                               # a row a file; no sample is read
    spark.read.format("wav").option("segment", 30).option("halo", 0.1).load(...)    # a row for each 30 seconds
    df.select("path", "rate", "samples").write.format("wav").mode("append").option("encoding", "pcm24").save("/data/out")

Partitions are planned by bytes: small files share one, a long file is many. Conditions on path, rate, channels, bits, encoding,
frames and seconds are evaluated on the header, before samples are read. Files are reached through Arrow's file systems, so a path is
a local one or a URI that they know. A file that can't be read is a row with status failure and the reason.
"""

from __future__ import annotations

import fnmatch
import io
import operator
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D

from . import riff

HEADER = "path string, length long, rate int, channels int, bits int, encoding string, frames long, seconds double, status string, message string"
SEGMENT = "segment int, begin double, end double, first_frame long, before int, after int, samples array<float>"
#: Bytes of audio, and files, of one partition at most.
PART_BYTES, PART_FILES = 64 << 20, 1024
#: Samples of one batch of rows, about.
BATCH_SAMPLES = 1 << 21
_FIELDS = ("path", "length", "rate", "channels", "bits", "encoding", "frames", "seconds", "status", "message")
_TYPES = (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.float64(), pa.string(), pa.string())
_MORE = (("segment", pa.int32()), ("begin", pa.float64()), ("end", pa.float64()), ("first_frame", pa.int64()), ("before", pa.int32()), ("after", pa.int32()), ("samples", pa.list_(pa.float32())))


def listed(folders: list[str], pattern: str = "*.wav") -> list[tuple[str, int]]:
    """(path, bytes) of all files below the folders whose name matches, by path. A URI's scheme stays on its paths."""
    out = []
    for folder in folders:
        system, path = pafs.FileSystem.from_uri(folder)
        scheme = folder[: -len(path)] if folder.endswith(path) else ""
        info = system.get_file_info(path)
        found = [info] if info.type == pafs.FileType.File else system.get_file_info(pafs.FileSelector(path, recursive=True))
        out += [(scheme + f.path, f.size) for f in found if f.type == pafs.FileType.File and fnmatch.fnmatch(f.base_name.lower(), pattern.lower())]
    return sorted(set(out))


@dataclass
class Part(D.InputPartition):
    """Shares of files: (path, bytes, share, of how many)."""

    shares: list[tuple[str, int, int, int]]

    def __post_init__(self):
        super().__init__(None)


def planned(files: list[tuple[str, int]], whole: bool, part_bytes: int = PART_BYTES) -> list[Part]:
    """Partitions of about part_bytes: long files in shares unless whole, small ones together."""
    parts, held = [Part([])], 0
    for path, size in files:
        shares = 1 if whole else max(1, -(-size // part_bytes))
        for share in range(shares):
            cost = 0 if whole else size // shares
            if parts[-1].shares and (held + cost > part_bytes or len(parts[-1].shares) >= PART_FILES):
                parts.append(Part([]))
                held = 0
            parts[-1].shares.append((path, size, share, shares))
            held += cost
    return parts


_COMPARE: dict[type, Callable] = {
    D.EqualTo: operator.eq, D.GreaterThan: operator.gt, D.GreaterThanOrEqual: operator.ge, D.LessThan: operator.lt, D.LessThanOrEqual: operator.le,
    D.In: lambda x, values: x in values, D.StringStartsWith: str.startswith, D.StringEndsWith: str.endswith, D.StringContains: operator.contains,
}
_ON_HEADER = ("path", "length", "rate", "channels", "bits", "encoding", "frames", "seconds", "status")


class Reader(D.DataSourceReader):
    def __init__(self, options: dict[str, str]):
        options = {k.lower(): v for k, v in options.items()}
        self.folders = [p for p in options.get("path", "").split("\n") if p]
        self.pattern, self.part_bytes = options.get("pattern", "*.wav"), int(options.get("partbytes", PART_BYTES))
        self.segment, self.halo = float(options.get("segment", 0)), float(options.get("halo", 0))
        self.conditions: list[D.Filter] = []

    def pushFilters(self, filters: list[D.Filter]) -> Iterator[D.Filter]:
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name in _ON_HEADER and (type(f) in _COMPARE or isinstance(f, D.IsNotNull)):
                self.conditions.append(f)
            else:
                yield f

    def partitions(self) -> list[D.InputPartition]:
        return planned(listed(self.folders, self.pattern), self.segment == 0, self.part_bytes)

    def _wanted(self, row: dict) -> bool:
        for f in self.conditions:
            value = row[f.attribute[0]]
            if value is None or not (isinstance(f, D.IsNotNull) or _COMPARE[type(f)](value, f.value)):
                return False
        return True

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for share in partition.shares:
            for row in self._rows(*share):
                rows.append(row)
                held += 100 + len(row.get("samples", ()))
                if held >= BATCH_SAMPLES:
                    yield self._batch(rows)
                    rows, held = [], 0
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list[dict]) -> pa.RecordBatch:
        fields = [*zip(_FIELDS, _TYPES), *(_MORE if self.segment else ())]
        return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in fields], names=[n for n, _ in fields])

    def _rows(self, path: str, length: int, share: int, shares: int) -> Iterator[dict]:
        row = dict.fromkeys(_FIELDS) | {"path": path, "length": length, "status": "success"}
        file = None
        try:
            system, inner = pafs.FileSystem.from_uri(path)
            file = system.open_input_file(inner)
            head = riff.header(file, length)
            row |= {"rate": head.rate, "channels": head.channels, "bits": head.bits, "encoding": head.encoding, "frames": head.frames, "seconds": head.seconds}
            if not self._wanted(row):
                return
            if not self.segment:
                yield row
                return
            step, halo = max(1, round(self.segment * head.rate)), round(self.halo * head.rate)
            count = -(-head.frames // step)
            for i in range(share * count // shares, (share + 1) * count // shares):
                first, last = i * step, min(head.frames, (i + 1) * step)
                begin, end = max(0, first - halo), min(head.frames, last + halo)
                samples = riff.frames(file, head, begin, end).mean(1).astype(np.float32)
                yield row | {"segment": i, "begin": first / head.rate, "end": last / head.rate, "first_frame": first, "before": first - begin, "after": end - last, "samples": samples}
        except (riff.UnreadableAudio, OSError) as error:
            failed = dict.fromkeys(_FIELDS) | {"path": path, "length": length, "status": "failure", "message": str(error)}
            if share == 0 and self._wanted(failed):
                yield failed
        finally:
            if file is not None:
                file.close()


class Writer(D.DataSourceArrowWriter):
    """One file a row (path relative to the folder, rate, samples), whole or not at all: a file gets its name when it is complete."""

    def __init__(self, options: dict[str, str]):
        self.folder, self.encoding = options["path"].rstrip("/"), options.get("encoding", "pcm16")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> D.WriterCommitMessage:
        system, folder = pafs.FileSystem.from_uri(self.folder)
        for batch in iterator:
            names = batch.schema.names
            encodings = batch.column(names.index("encoding")).to_pylist() if "encoding" in names else [self.encoding] * len(batch)
            samples = batch.column(names.index("samples"))
            for i, (path, rate, encoding) in enumerate(zip(batch.column(names.index("path")).to_pylist(), batch.column(names.index("rate")).to_pylist(), encodings)):
                target = f"{folder}/{path}"
                system.create_dir(target.rsplit("/", 1)[0], recursive=True)
                unfinished = f"{target}.{uuid.uuid4().hex}.part"
                values = samples[i].values
                with system.open_output_stream(unfinished) as out:
                    out.write(riff.encode(np.zeros(0) if values is None else values.to_numpy(zero_copy_only=False), rate, encoding))
                system.move(unfinished, target)
        return D.WriterCommitMessage()


class WavFiles(D.DataSource):
    @classmethod
    def name(cls) -> str:
        return "wav"

    def schema(self) -> str:
        return f"{HEADER}, {SEGMENT}" if float(self.options.get("segment", 0)) else HEADER

    def reader(self, schema) -> Reader:
        return Reader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> Writer:
        if overwrite:
            raise ValueError("files are added or replaced one by one; write with mode append")
        return Writer(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make the format "wav" known to a session, and let Spark hand conditions to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WavFiles)


def headers(spark: SparkSession, folders: list[str], pattern: str = "*.wav") -> DataFrame:
    """HEADER of every file."""
    register(spark)
    return spark.read.format("wav").option("pattern", pattern).load("\n".join(folders))


def segments(spark: SparkSession, folders: list[str], seconds: float, halo: float = 0.0, pattern: str = "*.wav") -> DataFrame:
    """HEADER and SEGMENT of every `seconds` of every file, mono. samples have `before` and `after` values of the neighbours around
    the segment's own, `halo` seconds where there are so many. An empty file has no segments."""
    register(spark)
    return spark.read.format("wav").options(segment=seconds, halo=halo, pattern=pattern).load("\n".join(folders))


def sources(spark: SparkSession, folders: list[str], excluded: DataFrame | None = None, pattern: str = "*.wav", limit: int | None = None) -> DataFrame:
    """(path, stem) of audio files, without those whose stem, as it is or without a leading A_, is among excluded.stem; the first
    `limit` by path if given. Listing reads no file."""
    from .records import without_stems

    files = spark.createDataFrame([(p, p.rsplit("/", 1)[-1].rsplit(".", 1)[0]) for p, _ in listed(folders, pattern)], "path string, stem string")
    kept = files if excluded is None else without_stems(files, excluded)
    return kept if limit is None else kept.orderBy("path").limit(limit)


#: Zero crossings of the resampling filter on either side, and the shape of its window.
CROSSINGS, BETA = 32, 11.0


def reach(rate: int, target: int) -> int:
    """How many input samples on either side an output sample depends on."""
    return int(np.ceil(CROSSINGS * max(1.0, rate / target))) + 1


def _polyphase(x: np.ndarray, rate: int, target: int, first: int, before: int, own: int) -> tuple[int, np.ndarray]:
    """(first output index, outputs) of the positions that lie in a segment's own samples: `own` from first on, behind `before` of
    the neighbour's."""
    g = np.gcd(rate, target)
    up, down = target // g, rate // g
    half = reach(rate, target)
    cut = min(1.0, up / down)
    begin, end = -(-first * up // down), -(-(first + own) * up // down)
    index = np.arange(begin, end, dtype=np.int64)
    base, phase = index * down // up, (index * down % up)
    taps = np.arange(-half, half + 1)
    away = (np.arange(up)[:, None] / up - taps[None, :]) * cut
    inside = np.clip(1 - (away / CROSSINGS) ** 2, 0, None)
    table = cut * np.sinc(away) * np.where(inside > 0, np.i0(BETA * np.sqrt(inside)) / np.i0(BETA), 0)
    padded = np.concatenate([np.zeros(half), x.astype(np.float64), np.zeros(half + 1)])
    at = base - first + before + half
    out = np.empty(len(index))
    for i in range(0, len(index), 8192):
        rows = slice(i, i + 8192)
        out[rows] = (padded[at[rows, None] + taps[None, :]] * table[phase[rows]]).sum(1)
    return int(begin), out


def resampled(cut: DataFrame, target: int) -> DataFrame:
    """(path, segment, rate, first_frame, samples) of segments at another rate, each row by itself: the outputs that fall into a segment's
    own samples. With a halo of `reach` samples the segments together are what the whole file gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = {n: batch.column(n).to_pylist() for n in ("path", "segment", "rate", "first_frame", "before", "after")}
            firsts, outs = [], []
            for i, x in enumerate(batch.column("samples")):
                x = x.values.to_numpy(zero_copy_only=False)
                before, after = column["before"][i], column["after"][i]
                first, y = _polyphase(x, column["rate"][i], target, column["first_frame"][i], before, len(x) - before - after)
                firsts.append(first)
                outs.append(y.astype(np.float32))
            n = len(firsts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(column["path"], pa.string()), pa.array(column["segment"], pa.int32()), pa.array([target] * n, pa.int32()), pa.array(firsts, pa.int64()), pa.array(outs, pa.list_(pa.float32()))],
                names=["path", "segment", "rate", "first_frame", "samples"],
            )

    rows = cut.where("samples is not null").select("path", "segment", "rate", "first_frame", "before", "after", "samples")
    return rows.mapInArrow(run, "path string, segment int, rate int, first_frame long, samples array<float>")


def decode(raw: bytes) -> tuple[riff.Header, np.ndarray]:
    """A whole file in memory."""
    head = riff.header(io.BytesIO(raw), len(raw))
    return head, riff.frames(io.BytesIO(raw), head, 0, head.frames)
