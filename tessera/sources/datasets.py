"""Datasets as a whole: descriptions, cached scans, sources of any kind, frames, run logs, crops."""

from __future__ import annotations

import ast
import io
import os
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import images as im
from .labels import label_path

SPLITS = ("train", "val", "test", "minival")


def coerce(text: str):
    """The Python value that a command line's text means: none, booleans, literals, else the text."""
    word = text.strip().lower()
    if word in ("none", "true", "false"):
        return {"none": None, "true": True, "false": False}[word]
    try:
        return ast.literal_eval(text)
    except (ValueError, SyntaxError, TypeError, MemoryError):
        return text


def pair(text: str) -> tuple:
    """``key=value`` with the value coerced."""
    key, _, value = text.partition("=")
    if not value.strip():
        raise ValueError(f"no value for {key.strip()!r}")
    return key.strip(), coerce(value.strip())


def describe(path: str, split: str = "") -> dict:
    """A dataset description (YAML): ``path``, absolute ``train``, ``val``, .. (text or list), ``nc`` and ``names`` by number.

    ``validation`` counts as ``val``; without names classes are called by their number; ``nc`` and names
    must agree. A small file that the driver reads.
    """
    try:
        import yaml
    except ImportError as e:  # pragma: no cover
        raise RuntimeError("dataset descriptions need the yaml package") from e
    with open(path, encoding="utf-8") as f:
        data = yaml.safe_load(f) or {}
    if "val" not in data and "validation" in data:
        data["val"] = data.pop("validation")
    missing = [k for k in ("train", "val") if k not in data] + ([split] if split and not data.get(split) else [])
    if missing:
        raise ValueError(f"{path}: no {missing[0]}")
    names, nc = data.get("names"), data.get("nc")
    if names is None and nc is None:
        raise ValueError(f"{path}: neither names nor nc")
    if nc is not None:
        if isinstance(nc, bool) or not str(nc).replace(".", "", 1).isdigit() or float(nc) != int(float(nc)):
            raise ValueError(f"{path}: nc is no whole number")
        nc = int(float(nc))
    names = dict(enumerate(names)) if isinstance(names, list) else {int(k): v for k, v in names.items()} if names else {i: f"class_{i}" for i in range(nc)}
    if nc is not None and len(names) != nc:
        raise ValueError(f"{path}: {len(names)} names for {nc} classes")
    if names and max(names) >= len(names):
        raise ValueError(f"{path}: classes are not numbered from 0 on")
    root = Path(data.get("path") or Path(path).parent)
    root = root if root.is_absolute() else (Path(path).parent / root).resolve()
    at = lambda x: str((root / x).resolve())
    where = {k: [at(x) for x in data[k]] if isinstance(data[k], list) else at(data[k]) for k in SPLITS if data.get(k)}
    return {**data, **where, "path": str(root), "nc": len(names), "names": {k: str(v) for k, v in names.items()}, "channels": data.get("channels", 3)}


def classes(spark: SparkSession, description: dict) -> DataFrame:
    return spark.createDataFrame(sorted(description["names"].items()), "cls int, name string")


def listing_key(files: DataFrame, version: str) -> str:
    """What a cached scan of ``files`` (path, length) is valid for: number, total size and paths, in any order; combined where the rows are."""
    row = files.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("size"), F.coalesce(F.bit_xor(F.xxhash64("path")), F.lit(0)).alias("x"), F.coalesce(F.sum(F.xxhash64("path", F.lit(1)) % 1_000_000_007), F.lit(0)).alias("s"))
    return row.select(F.sha2(F.concat_ws("|", F.lit(version), "n", "size", "x", "s"), 256)).first()[0]


def cached_scan(files: DataFrame, scan: Callable[[DataFrame], DataFrame], path: str, version: str = "1") -> tuple[DataFrame, bool]:
    """``scan(files)`` from the Parquet cache at ``path``, if it was written for the same listing and version, else anew; also whether it was read."""
    spark, key = files.sparkSession, listing_key(files, version)
    at = f"{path}/key={key}"
    if _exists(spark, f"{at}/_SUCCESS"):
        return spark.read.parquet(at), True
    scan(files).write.mode("overwrite").parquet(at)
    return spark.read.parquet(at), False


def _exists(spark: SparkSession, path: str) -> bool:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()).exists(found)


def kind_of(source) -> str:
    """memory, camera, screen, stream, list, table, video, image or folder."""
    if isinstance(source, DataFrame):
        return "table"
    if isinstance(source, (np.ndarray, list, tuple)) and not (isinstance(source, (list, tuple)) and source and all(isinstance(x, str) for x in source)):
        return "memory"
    if isinstance(source, (list, tuple)):
        return "list"
    text = str(source)
    end = text.rsplit(".", 1)[-1].lower() if "." in text.rsplit("/", 1)[-1] else ""
    if text.isdigit():
        return "camera"
    if text == "screen" or text.startswith("screen "):
        return "screen"
    if text.split("://")[0].lower() in ("rtsp", "rtmp", "tcp") or end == "streams":
        return "stream"
    return "list" if end in ("txt", "csv") else "table" if end == "parquet" else "video" if end in ("y4m", "mp4", "avi", "mov", "mkv") else "image" if end in im.SUFFIXES else "folder"


def load(spark: SparkSession, source, stride: int = 1) -> DataFrame:
    """Images or frames of any source that needs no device: (path, frame, content) or, from memory and y4m videos, (path, frame, w, h, channels, pixels)."""
    kind = kind_of(source)
    if kind == "memory":
        return from_arrays(spark, source)
    if kind == "table":
        return source if isinstance(source, DataFrame) else spark.read.parquet(str(source))
    if kind == "list":
        return listed(spark, source)
    if kind == "video":
        return strided(video_frames(spark.read.format("binaryFile").load(str(source))), stride)
    if kind in ("image", "folder"):
        files = im.scan(spark, str(source)) if kind == "folder" else spark.read.format("binaryFile").load(str(source))
        return files.select("path", F.lit(1).alias("frame"), "content")
    raise ValueError(f"a {kind} needs a device or a stream reader")


def listed(spark: SparkSession, source) -> DataFrame:
    """(path) of a list of paths, or of list files with a path a line; ``./`` stands for the list's folder."""
    if isinstance(source, (list, tuple)):
        return spark.createDataFrame([(str(x),) for x in source], "path string").distinct()
    rows = spark.read.text(str(source)).select(F.trim("value").alias("path"), F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", "/").alias("folder")).where("path <> ''")
    return rows.select(F.when(F.col("path").startswith("./"), F.concat("folder", F.expr("substr(path, 3)"))).otherwise(F.col("path")).alias("path")).distinct()


PIXELS = "path string, frame int, w int, h int, channels int, pixels binary"


def from_arrays(spark: SparkSession, arrays) -> DataFrame:
    """Images in memory (h, w[, channels] of 8 bits, or a batch of them) as rows."""
    arrays = list(arrays) if not (isinstance(arrays, np.ndarray) and arrays.ndim < 4) else [arrays]
    shaped = [np.ascontiguousarray(a if a.ndim == 3 else a[..., None], dtype=np.uint8) for a in map(np.asarray, arrays)]
    return spark.createDataFrame([(f"image{i}", 1, a.shape[1], a.shape[0], a.shape[2], a.tobytes()) for i, a in enumerate(shaped)], PIXELS)


def y4m_frames(data: bytes) -> Iterator[tuple[int, int, int, bytes]]:
    """(number, width, height, luma) of an uncompressed YUV4MPEG2 video."""
    head, _, rest = data.partition(b"\n")
    fields = {x[:1]: x[1:] for x in head.split()[1:]}
    if not head.startswith(b"YUV4MPEG2") or b"W" not in fields or b"H" not in fields:
        raise ValueError("not a y4m video")
    w, h, colour = int(fields[b"W"]), int(fields[b"H"]), fields.get(b"C", b"420")
    half = lambda v: (v + 1) // 2
    more = 0 if colour.startswith(b"mono") else 2 * w * h if colour.startswith(b"444") else 2 * half(w) * h if colour.startswith(b"422") else 2 * half(w) * half(h)
    at, n = 0, 0
    while at < len(rest):
        line = rest.index(b"\n", at) + 1
        if not rest[at:line].startswith(b"FRAME") or line + w * h + more > len(rest):
            raise ValueError("a frame is damaged")
        n += 1
        yield n, w, h, rest[line : line + w * h]
        at = line + w * h + more


def video_frames(files: DataFrame) -> DataFrame:
    """Frames (grey) of y4m files, one row each; a file is read by one task and its frames are passed on one by one. Others' codecs need a library that is not here."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                for n, w, h, luma in y4m_frames(bytes(content)):
                    yield pd.DataFrame([(path, n, w, h, 1, luma)], columns=["path", "frame", "w", "h", "channels", "pixels"])

    return files.select("path", "content").mapInPandas(run, PIXELS)


def strided(frames: DataFrame, stride: int) -> DataFrame:
    """The first frame and every ``stride``-th after it."""
    return frames.where((F.col("frame") - 1) % stride == 0)


def extracted(frames: DataFrame, every: int, digits: int = 6) -> DataFrame:
    """(name, path, frame) of every ``every``-th frame, numbered through all videos in order of path."""
    chosen = strided(frames, every)
    counts = chosen.groupBy("path").agg(F.count(F.lit(1)).alias("n_"))  # a row a video
    before = F.coalesce(F.sum("n_").over(Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = chosen.join(counts.select("path", before.alias("before_")), "path")
    number = F.row_number().over(Window.partitionBy("path").orderBy("frame")) + F.col("before_")
    return rows.select(F.lpad(number.cast("string"), digits, "0").alias("name"), "path", "frame")


def read_streams(spark: SparkSession, folders: dict[int, str], schema: str, stride: int = 1, files_a_trigger: int = 16) -> DataFrame:
    """Several growing folders of frame records as one stream with ``stream_id``; a trigger takes a bounded number of files of each."""
    out = None
    for stream_id, folder in sorted(folders.items()):
        rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).parquet(folder).withColumn("stream_id", F.lit(stream_id).cast("long"))
        out = rows if out is None else out.unionByName(rows)
    return strided(out, stride)


def read_run(spark: SparkSession, path: str) -> DataFrame:
    """A run's result CSV, a row an epoch; spaces around column names go."""
    rows = spark.read.csv(path, header=True, inferSchema=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    return rows.toDF(*[c.strip() for c in rows.columns])


def add_epoch(spark: SparkSession, path: str, metrics: dict) -> DataFrame:
    """Appends an epoch's metrics to a run kept as Parquet; columns that come or go are null where they are missing."""
    spark.createDataFrame([metrics]).write.mode("append").parquet(path)
    return spark.read.option("mergeSchema", True).parquet(path)


def read_trials(spark: SparkSession, path: str) -> DataFrame:
    """A tuner's history, a JSON object a line, best fitness first."""
    return spark.read.json(path).orderBy(F.desc("fitness"))


def constrain(values: dict, space: dict[str, tuple], whole: tuple[str, ...] = ()) -> dict:
    """Values within their bounds: whole numbers or 5 decimals."""
    out = {}
    for k, (low, high) in space.items():
        if k in whole:
            low, high = int(np.ceil(low)), int(np.floor(high))
            if low > high:
                raise ValueError(f"no whole number between the bounds of {k!r}")
        v = round(values[k]) if k in whole else round(values[k], 5)
        out[k] = min(max(v, low), high)
    return out


def mutate(history: DataFrame, space: dict[str, tuple], seed: int, parents: int = 9, sigma: float = 0.2, whole: tuple[str, ...] = ()) -> dict:
    """New values from the ``parents`` best rows of (fitness, values..): a mix weighted by fitness, each value moved by a normal share of its range."""
    rows = [r.asDict() for r in history.orderBy(F.desc("fitness")).limit(parents).collect()]  # a few rows
    if not rows:
        raise ValueError("no history")
    rng, fit = np.random.default_rng(seed), np.array([r["fitness"] for r in rows], float)
    weight = fit - fit.min() + 1e-6
    weight /= weight.sum()
    values = {k: float(np.dot(weight, [r[k] for r in rows])) + float(rng.normal(0, sigma)) * (space[k][1] - space[k][0]) for k in space}
    return constrain(values, space, whole)


def benchmark_table(rows: DataFrame) -> DataFrame:
    """(format, size_mb, metric, ms) rows with frames a second; a format that failed has no time and goes last."""
    fps = F.when(F.col("ms") > 0, F.round(1000 / F.col("ms"), 2))
    return rows.withColumns({"fps": fps, "ok": F.col("ms").isNotNull() & F.col("metric").isNotNull()}).orderBy(F.desc("ok"), "format")


def crops(frames: DataFrame, pred: DataFrame, gain: float = 1.02, pad: int = 10) -> DataFrame:
    """(cls, image_id, det_id, w, h, channels, pixels): each detection cut out of its frame, widened by ``gain`` and ``pad``; empty ones are null.

    ``frames`` are pixel rows with ``image_id``; write the result with ``partitionBy('cls')``.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                image = np.frombuffer(r.pixels, np.uint8).reshape(r.h, r.w, r.channels)
                cx, cy, bw, bh = (r.x1 + r.x2) / 2, (r.y1 + r.y2) / 2, (r.x2 - r.x1) * gain + pad, (r.y2 - r.y1) * gain + pad
                x0, y0, x1, y1 = (int(v) for v in (max(0, cx - bw / 2), max(0, cy - bh / 2), min(r.w, cx + bw / 2), min(r.h, cy + bh / 2)))
                part = image[y0:y1, x0:x1]
                out.append((r.cls, r.image_id, r.det_id, part.shape[1], part.shape[0], r.channels, part.tobytes() if part.size else None))
            yield pd.DataFrame(out, columns=["cls", "image_id", "det_id", "w", "h", "channels", "pixels"])

    rows = frames.select("image_id", "w", "h", "channels", "pixels").join(pred.select("image_id", "det_id", "cls", "x1", "y1", "x2", "y2"), "image_id")
    return rows.mapInPandas(cut, "cls int, image_id long, det_id int, w int, h int, channels int, pixels binary")


def capped(rows: DataFrame, key: list[str], branch: str, cap: int, order: list[str]) -> DataFrame:
    """Rows to save: each ``key`` once (its first in ``order``), ``cap`` of every ``branch``; a negative cap saves all."""
    once = rows.withColumn("n_", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("n_ = 1").drop("n_")
    if cap < 0:
        return once
    return once.withColumn("n_", F.row_number().over(Window.partitionBy(branch).orderBy(*order))).where(F.col("n_") <= cap).drop("n_")


def verified_pairs(files: DataFrame, others: DataFrame, label: Callable[[Column], Column] = label_path) -> DataFrame:
    """(path, other, status) of images and their depth maps or masks: found, missing, unreadable, or of another size.

    ``others`` meet by the path that ``label`` derives, whatever its suffix.
    """
    stem = lambda c: F.regexp_replace(c, "\\.[^./]+$", "")
    a = im.sizes(files, least=1).select("path", "ok", "w", "h", stem(label(F.col("path"))).alias("stem"))
    b = im.sizes(others, least=1).select(F.col("path").alias("other"), F.col("ok").alias("ok_"), F.col("w").alias("w_"), F.col("h").alias("h_"), stem(F.col("path")).alias("stem"))
    status = F.when(F.col("other").isNull(), "missing").when(~F.col("ok") | ~F.col("ok_"), "unreadable").when((F.col("w") != F.col("w_")) | (F.col("h") != F.col("h_")), "other size").otherwise("found")
    return a.join(b, "stem", "left").select("path", "other", status.alias("status"))


def readable(files: DataFrame) -> tuple[DataFrame, dict[str, int]]:
    """The files whose header reads, and how many do and do not."""
    rows = im.sizes(files)
    n = rows.agg(F.count(F.when(F.col("ok"), 1)).alias("found"), F.count(F.when(~F.col("ok"), 1)).alias("corrupt")).first()
    return files.join(rows.where("ok").select("path"), "path", "left_semi"), n.asDict()


def check_count(rows: DataFrame, expected: int) -> DataFrame:
    """``rows``, once they are as many as the dataset is known to have."""
    if (n := rows.count()) != expected:
        raise ValueError(f"{n} instances, not {expected}")
    return rows


def predict(rows: DataFrame, make: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str) -> DataFrame:
    """Model inference: ``make`` builds the model once in each task, which then maps Arrow batches (their size is the session's ``maxRecordsPerBatch``)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for pdf in batches:
            yield model(pdf)

    return rows.mapInPandas(run, schema)


def embed(cut: DataFrame, make: Callable[[], Callable[[np.ndarray], np.ndarray]]) -> DataFrame:
    """(image_id, det_id, embedding) of :func:`crops`; one without pixels has none."""

    def build() -> Callable[[pd.DataFrame], pd.DataFrame]:
        encode = make()
        one = lambda r: [float(v) for v in encode(np.frombuffer(r.pixels, np.uint8).reshape(r.h, r.w, r.channels))] if r.pixels is not None else None
        return lambda pdf: pd.DataFrame({"image_id": pdf["image_id"], "det_id": pdf["det_id"], "embedding": [one(r) for r in pdf.itertuples()]})

    return predict(cut, build, "image_id long, det_id int, embedding array<double>")


def compose(*steps: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """Transforms one after the other; the optimizer sees them as one plan."""

    def run(rows: DataFrame) -> DataFrame:
        for step in steps:
            rows = rows.transform(step)
        return rows

    return run


class Tasks:
    """Plug-ins: what a task (detect, segment, ..) does at a stage (load, verify, transform, predict, validate), and hooks around it."""

    def __init__(self) -> None:
        self.stages: dict[tuple[str, str], Callable] = {}
        self.hooks: dict[str, list[Callable]] = {}

    def register(self, task: str, stage: str, function: Callable | None = None):
        """Sets a stage, also as a decorator."""
        if function is None:
            return lambda f: self.register(task, stage, f)
        self.stages[task, stage] = function
        return function

    def on(self, event: str, function: Callable) -> None:
        """``function(rows)`` at ``before <stage>`` or ``after <stage>``; what it returns, if anything, takes the rows' place."""
        self.hooks.setdefault(event, []).append(function)

    def run(self, task: str, stage: str, rows: DataFrame) -> DataFrame:
        if (task, stage) not in self.stages:
            raise KeyError(f"nothing does {stage} for {task}")
        for event, step in (("before", None), ("at", self.stages[task, stage]), ("after", None)):
            for f in [step] if step else self.hooks.get(f"{event} {stage}", []):
                rows = f(rows) if step else (lambda made, old: old if made is None else made)(f(rows), rows)
        return rows


def condensed(lines: DataFrame) -> DataFrame:
    """(run, line, times) of log lines (source, n, line): a line that repeats the one before it is counted, not kept."""
    w = Window.partitionBy("source").orderBy("n")
    rows = lines.withColumn("new", (~F.col("line").eqNullSafe(F.lag("line").over(w)) | (F.row_number().over(w) == 1)).cast("int"))
    rows = rows.withColumn("run", F.sum("new").over(w))
    return rows.groupBy("source", "run").agg(F.first("line").alias("line"), F.count(F.lit(1)).alias("times"))


def npy(metres: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, np.asarray(metres, np.float32), allow_pickle=False)
    return out.getvalue()


def from_depth(data: bytes, scale: float = 1000.0) -> np.ndarray:
    """Metres of a depth map stored as NPY or as a 16-bit PNG."""
    if data[:6] == b"\x93NUMPY":
        return np.load(io.BytesIO(data), allow_pickle=False).astype(np.float64)
    return im.decode_depth(data, scale)


def probe(paths: list[str], most: int = 5) -> dict[str, float]:
    """Mean time to open (ms) and speed (MB/s) over at most ``most`` local files; the driver reads them."""
    import time

    times, size, took = [], 0, 1e-9
    for p in paths[:most]:
        began = time.perf_counter()
        os.stat(p)
        times.append(time.perf_counter() - began)
        with open(p, "rb") as f:
            size += len(f.read())
        took += time.perf_counter() - began
    return {"open_ms": 1000 * float(np.mean(times)) if times else 0.0, "mb_s": size / 1e6 / took}
