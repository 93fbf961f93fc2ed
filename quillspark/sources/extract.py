"""Exports to files."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from quillspark.errors import QuillError


@dataclass(frozen=True)
class Format:
    name: str
    compressions: tuple[str, ...]


@dataclass(frozen=True)
class Csv(Format):
    name: str = "csv"
    compressions: tuple[str, ...] = ("none", "gzip")
    delimiter: str = ","
    header: bool = True


@dataclass(frozen=True)
class JsonLines(Format):
    name: str = "json"
    compressions: tuple[str, ...] = ("none", "gzip")


@dataclass(frozen=True)
class Parquet(Format):
    name: str = "parquet"
    compressions: tuple[str, ...] = ("none", "gzip", "zstd")


@dataclass(frozen=True)
class Avro(Format):
    """Needs Spark's Avro package on the class path."""

    name: str = "avro"
    compressions: tuple[str, ...] = ("none", "gzip", "snappy", "deflate")
    logical_types: bool = False


def extract(df: DataFrame, path: str, fmt: Format = JsonLines(), compression: str = "gzip", mode: str = "error") -> None:
    """Write ``df`` as files. A compression that the format does not have is refused before any work."""
    if compression not in fmt.compressions:
        raise QuillError(f"{fmt.name} cannot be compressed by {compression}, only by {', '.join(fmt.compressions)}")
    writer = df.write.mode(mode).format(fmt.name)
    if isinstance(fmt, Csv):
        writer = writer.options(sep=fmt.delimiter, header=fmt.header)
    if isinstance(fmt, JsonLines):
        writer = writer.option("ignoreNullFields", "true")
    if isinstance(fmt, Avro):
        codec = {"none": "uncompressed", "gzip": "deflate"}.get(compression, compression)
        try:
            writer.option("compression", codec).save(path)
        except Exception as e:
            if "data source: avro" in str(e):
                raise QuillError("Spark's Avro package is not on the class path") from e
            raise
        return
    writer.option("compression", compression).save(path)


def read_back(spark: SparkSession, path: str, fmt: Format, schema) -> DataFrame:
    reader = spark.read.schema(schema).format(fmt.name)
    if isinstance(fmt, Csv):
        reader = reader.options(sep=fmt.delimiter, header=fmt.header)
    return reader.load(path)
