"""JSON records: one a line or pretty-printed one after the other, read and written by Spark."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object a line; a broken line becomes a row of nulls rather than an error."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


def split_objects(text: str) -> Iterator[dict]:
    """The objects of a text that holds them one after the other, on one line or many."""
    decoder, at = json.JSONDecoder(), 0
    while at < len(text):
        if text[at].isspace():
            at += 1
            continue
        value, at = decoder.raw_decode(text, at)
        if not isinstance(value, dict):
            raise ValueError(f"expected an object, found {type(value).__name__}")
        yield value


def read_concatenated(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Files of concatenated objects; a file is the unit of parallelism."""

    def body(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for text in batch["value"]:
                yield pd.DataFrame({"line": [json.dumps(x) for x in split_objects(text)]}, dtype=object)

    lines = spark.read.text(path, wholetext=True).mapInPandas(body, "line string")
    return lines.select(F.from_json("line", schema).alias("r")).select("r.*")


def objects(files: DataFrame, body: str) -> DataFrame:
    """Each JSON object of the texts in ``body`` as a row (``object``), other columns repeated."""
    kept = [c for c in files.columns if c != body]

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[json.dumps(x, ensure_ascii=False) for x in split_objects(t or "")] for t in batch.column(len(kept)).to_pylist()]
            whose = pa.array([i for i, xs in enumerate(found) for _ in xs], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(whose) for i in range(len(kept))), pa.array([x for xs in found for x in xs], pa.string())], [*kept, "object"])

    return files.select(*kept, body).mapInArrow(split, StructType([*files.select(*kept).schema.fields, StructField("object", StringType())]))


def is_pretty(text: str) -> bool:
    """Whether the objects of a text span lines."""
    lines = [x.strip() for x in text.splitlines() if x.strip()]
    return any(not (x.startswith("{") and x.endswith("}")) for x in lines)


def formatted(values: Iterable[dict], pretty: bool) -> str:
    """Objects one after the other: with tabs, or one a line without spaces."""
    style = {"indent": "\t"} if pretty else {"separators": (",", ":")}
    return "".join(json.dumps(x, ensure_ascii=False, **style) + "\n" for x in values)


def _file(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def read_small(spark: SparkSession, path: str) -> str:
    """Text of one small file on any file system; empty where there is none."""
    at, files = _file(spark, path)
    if not files.exists(at):
        return ""
    return "".join(r.value for r in spark.read.text(path, wholetext=True).collect())


def rewrite(spark: SparkSession, path: str, values: Iterable[dict], pretty: bool | None = None) -> None:
    """One small file of objects, replaced as a whole: written beside it, then renamed over it.

    Without a stated style the one of the file that is there stays.
    """
    if pretty is None:
        pretty = is_pretty(read_small(spark, path))
    at, files = _file(spark, path)
    beside, _ = _file(spark, path + ".tmp")
    out = files.create(beside, True)
    try:
        out.write(bytearray(formatted(values, pretty).encode("utf-8")))
        out.hsync()
    finally:
        out.close()
    if files.exists(at):
        files.delete(at, False)
    if not files.rename(beside, at):
        raise OSError(f"could not replace {path}")


def append(spark: SparkSession, path: str, value: dict, pretty: bool | None = None) -> None:
    rewrite(spark, path, [*split_objects(read_small(spark, path)), value], pretty)


def drop_ids(spark: SparkSession, path: str, gone: Iterable[str], key: str = "claim_id") -> int:
    """Takes the objects with the given ids out of a small file; returns how many there were."""
    wanted, all_ = set(gone), list(split_objects(read_small(spark, path)))
    kept = [x for x in all_ if x.get(key) not in wanted]
    if len(kept) < len(all_):
        rewrite(spark, path, kept)
    return len(all_) - len(kept)


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Null fields are left out.  ``append`` adds files; the committer makes either all or nothing appear."""
    df.write.mode(mode).option("ignoreNullFields", "true").json(path)


def pretty(value: Column) -> Column:
    return F.to_json(value, {"pretty": "true"})


def payload(*columns: str) -> Column:
    """A row as JSON text without its null fields, in the given order."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "true"})


def from_payload(column: Column, schema: str) -> Column:
    return F.from_json(column, schema)
