"""File sources: object listings and contents, notification events, directory scans."""

from __future__ import annotations

import io
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

from dossier import constants as K
from dossier.functions import documents as D

TEXT_TYPE = S.StructType([S.StructField("text", S.StringType()), S.StructField("error", S.StringType())])
EVENT_TYPE = "Records array<struct<s3:struct<bucket:struct<name:string>,object:struct<key:string>>>>"


def pdf_text(raw: bytes) -> str:
    """Non-empty pages joined by a blank line. Needs the optional ``pypdf``."""
    import pypdf

    pages = [page.extract_text() for page in pypdf.PdfReader(io.BytesIO(raw)).pages]
    return "\n\n".join(p for p in pages if p)


def docx_text(raw: bytes) -> str:
    """Non-blank body paragraphs joined by a blank line."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(raw)) as archive:
        body = ElementTree.fromstring(archive.read("word/document.xml")).find(f"{w}body")
    marks = {f"{w}tab": "\t", f"{w}br": "\n", f"{w}cr": "\n"}
    texts = []
    for paragraph in body.findall(f"{w}p"):
        runs = paragraph.findall(f"{w}r") + paragraph.findall(f"{w}hyperlink/{w}r")
        parts = [node.text or "" if node.tag == f"{w}t" else marks.get(node.tag, "") for run in runs for node in run]
        texts.append("".join(parts))
    return "\n\n".join(t for t in texts if t.strip())


@F.pandas_udf(TEXT_TYPE)
def read_binary(name: pd.Series, content: pd.Series) -> pd.DataFrame:
    rows = []
    for file, raw in zip(name, content):
        try:
            rows.append(((pdf_text if file.lower().endswith(".pdf") else docx_text)(raw), None))
        except Exception as problem:
            rows.append((None, f"{type(problem).__name__}: {problem}"))
    return pd.DataFrame(rows, columns=["text", "error"])


def list_files(spark: SparkSession, root: str, prefix: str = "raw/", glob: str | None = None) -> DataFrame:
    """Every file under a folder: ``source_key, length, modified``; contents are not read."""
    return read_objects(spark, root, prefix, glob).select("source_key", "length", "modified")


def read_objects(spark: SparkSession, root: str, prefix: str = "raw/", glob: str | None = None,
                 stream: bool = False) -> DataFrame:
    reader = (spark.readStream if stream else spark.read).format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return with_keys(reader.load(f"{root.rstrip('/')}/{prefix}"), prefix)


def with_keys(objects: DataFrame, prefix: str = "raw/") -> DataFrame:
    """Keys relative to the folder that holds ``prefix``."""
    first = prefix.strip("/").split("/")[0]
    tail = F.regexp_extract("path", rf"/({first}/.*)$", 1)
    return objects.select(
        tail.alias("source_key"), "length", F.col("modificationTime").alias("modified"), "content"
    ).where(~F.col("source_key").endswith("/"))


def read_text(objects: DataFrame) -> DataFrame:
    """Contents as text: ``source_key, repo_prefix, content, error``.

    Only PDF and Word files pass through Python; invalid UTF-8 becomes replacement characters.
    A file that cannot be read keeps its row with ``error`` set.
    """
    rows = objects.withColumn("repo_prefix", D.repo_prefix(F.col("source_key")))
    binary = D.ends_with_any(F.lower("source_key"), [".pdf", ".docx", ".doc"])
    plain = rows.where(~binary).select(
        "source_key", "repo_prefix", F.make_valid_utf8(F.col("content").cast("string")).alias("content"),
        F.lit(None).cast("string").alias("error"),
    )
    packed = rows.where(binary).withColumn("r", read_binary("source_key", "content")).select(
        "source_key", "repo_prefix", F.col("r.text").alias("content"), F.col("r.error").alias("error")
    )
    return plain.unionByName(packed)


def parse_events(events: DataFrame, body: str = "body") -> DataFrame:
    """Object-created notifications to ``bucket, source_key``; entries lacking either are dropped."""
    record = events.select(F.explode(F.from_json(body, EVENT_TYPE)["Records"]).alias("r"))
    return record.select(
        F.col("r.s3.bucket.name").alias("bucket"), F.url_decode("r.s3.object.key").alias("source_key")
    ).where((F.coalesce("bucket", F.lit("")) != "") & (F.coalesce("source_key", F.lit("")) != ""))


def discover_repos(keys: DataFrame, root: str = "raw/") -> DataFrame:
    """Distinct immediate folders under ``raw/``."""
    rest = F.col("source_key").substr(len(root) + 1, 1 << 30)
    nested = F.col("source_key").startswith(root) & F.contains(rest, F.lit("/"))
    return keys.where(nested).select(
        F.concat(F.lit(root), F.substring_index(rest, "/", 1), F.lit("/")).alias("repo_prefix")
    ).distinct()


def select_keys(keys: DataFrame, prefix: str = "") -> DataFrame:
    """Keys of a direct run: under the given prefix, or everything under ``raw/``."""
    return keys.where(F.col("source_key").startswith(prefix or "raw/") & ~F.col("source_key").endswith("/"))


def is_uploadable(path: Column, include_hidden: bool = False) -> Column:
    """Directory-scan filter on a relative path: kind of file, hidden parts, skipped folders."""
    parts = F.split(path, "/")
    name = F.element_at(parts, -1)
    suffix = F.lower(F.regexp_extract(name, r"^.+(\.[^.]+)$", 1))
    keep = suffix.isin(K.SCAN_EXTENSIONS) & ~F.arrays_overlap(parts, F.array(*[F.lit(d) for d in K.SCAN_SKIP_DIRS]))
    return keep if include_hidden else keep & ~F.exists(parts, lambda p: p.startswith("."))
