"""Reading texts and images, and writing results."""

from __future__ import annotations

import struct
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushframe.functions import pixels as px


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def texts(spark: SparkSession, path: str, kind: str = "parquet", key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text) of parquet, json, orc or csv rows, or of text files, one row a file, whose doc_id is a hash of the path."""
    if kind == "text":
        rows = spark.read.text(path, wholetext=True).select(F.xxhash64(F.input_file_name()).alias("doc_id"), F.col("value").alias("text"))
        return rows
    reader = spark.read.option("header", True) if kind == "csv" else spark.read
    return reader.format(kind).load(path).select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))


def images(spark: SparkSession, path: str, formats: Iterable[str] = px.FORMATS) -> DataFrame:
    """(page_id, path, width, height, content) of the image files under a path; page_id is a hash of the file's path.

    Sizes come from PNG headers; other formats are opened with Pillow.
    """
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.{" + ",".join(formats) + "}").option("recursiveFileLookup", True).load(path)

    @F.pandas_udf("width int, height int")
    def size(content: pd.Series) -> pd.DataFrame:
        out = []
        for data in content:
            if data[:8] == b"\x89PNG\r\n\x1a\n":
                out.append(struct.unpack(">II", data[16:24]))
            else:
                out.append(px.from_bytes(bytes(data)).shape[1::-1])
        return pd.DataFrame(out, columns=["width", "height"])

    sized = rows.select(F.xxhash64("path").alias("page_id"), "path", "content", size("content").alias("s"))
    return sized.select("page_id", "path", "s.width", "s.height", "content")


def png_base64(pages: DataFrame) -> DataFrame:
    """pages with their content as base64 text, for JSON."""
    return pages.withColumn("content", F.base64("content"))


def write_files(pages: DataFrame, folder: str) -> DataFrame:
    """Writes every page's content to folder/<page_id>.png, through Hadoop's file systems where pyarrow has them; gives (page_id, path)."""

    def run(frames):
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        for pdf in frames:
            paths = []
            for page, data in zip(pdf["page_id"], pdf["content"]):
                paths.append(f"{base}/{page}.png")
                with store.open_output_stream(paths[-1]) as f:
                    f.write(bytes(data))
            yield pd.DataFrame({"page_id": pdf["page_id"], "path": paths})

    return pages.select("page_id", "content").mapInPandas(run, "page_id bigint, path string")


def spans_json(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, body): {"spans": [...]} for every text, empty lists too."""
    one = F.struct("start", "end", "category", "l1", "text", "score")
    lists = spans.groupBy("doc_id").agg(F.array_sort(F.collect_list(one)).alias("spans"))
    kind = "array<struct<start:int,end:int,category:string,l1:string,text:string,score:double>>"
    rows = docs.select("doc_id").join(lists, "doc_id", "left")
    return rows.select("doc_id", F.to_json(F.struct(F.coalesce("spans", F.array().cast(kind)).alias("spans")), {"ignoreNullFields": "false"}).alias("body"))


def entities_json(pages: DataFrame, entities: DataFrame) -> DataFrame:
    """(page_id, body): {"entities": [...]} with boxes as lists of 4."""
    order = F.struct((F.col("kind") != "text").alias("late"), "ent_idx", "category", "kind", F.array("bbox.x0", "bbox.y0", "bbox.x1", "bbox.y1").alias("bbox"), "l1", "text", "score")
    lists = entities.groupBy("page_id").agg(F.array_sort(F.collect_list(order)).alias("e"))
    rows = pages.select("page_id").join(lists, "page_id", "left")
    found = F.transform(F.coalesce("e", F.array().cast(dict(lists.dtypes)["e"])), lambda x: x.dropFields("late", "ent_idx"))
    return rows.select("page_id", F.to_json(F.struct(found.alias("entities")), {"ignoreNullFields": "false"}).alias("body"))
