"""Zip packages of named parts: listing, parts, relationships, paragraphs; and a writer.

Files come from Spark's ``binaryFile`` reader, so any store works; each file is opened in the
task that read it, under limits on entries and sizes.
"""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_ENTRIES, MOST_PART, MOST_TOTAL = 4096, 256 << 20, 512 << 20
PARTS = "path string, part string, size long, crc32 long, content binary"
#: Names of the package format.
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
W_STRICT = "{http://purl.oclc.org/ooxml/wordprocessingml/main}"
RELATIONSHIP = "{http://schemas.openxmlformats.org/package/2006/relationships}Relationship"
#: Leading bytes of known formats, as hex.
MAGIC = (
    ("504B0304", "zip"), ("25504446", "pdf"), ("7B5C727466", "rtf"), ("41542654464F524D", "djvu"), ("89504E470D0A1A0A", "png"), ("FFD8FF", "jpeg"),
    ("474946383761", "gif"), ("474946383961", "gif"), ("38425053", "psd"), ("1F8B", "gzip"), ("676C5446", "gltf"),
)


def listing(spark: SparkSession, folder: str, recursive: bool = False, pattern: str | None = None) -> DataFrame:
    """path, name, size, modified of files; contents are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(folder).select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def sniffed(content: Column, name: Column | None = None) -> Column:
    """The format by leading bytes, else by the name's extension."""
    head = F.hex(F.substring(content, 1, 8))
    kind = F.when(F.regexp_like(F.substring(content, 1, 512).cast("string"), F.lit(r"^\W*(<\?xml[^>]*>\s*)?<svg")), "svg")
    for magic, found in MAGIC:
        kind = kind.when(head.startswith(magic), found)
    return kind.otherwise(F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)) if name is not None else F.lit(None))


def parts(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """One row per part, inflated; a damaged file or one beyond the limits fails the read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    entries = [e for e in z.infolist() if not e.is_dir()]
                    if len(entries) > MOST_ENTRIES or sum(e.file_size for e in entries) > MOST_TOTAL or any(e.file_size > MOST_PART for e in entries):
                        raise ValueError(f"{path}: beyond the limits")
                    for e in entries:
                        data = z.read(e)  # checks size and CRC
                        yield pd.DataFrame([(path, "/" + e.filename.lstrip("/"), len(data), zlib.crc32(data), data)], columns=["path", "part", "size", "crc32", "content"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return files.select("path", "content").mapInPandas(run, PARTS)


def relationships(found: DataFrame) -> DataFrame:
    """path, source, rel_id, type, target, external of every relationship part."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, part, content in zip(batch["path"], batch["part"], batch["content"], strict=True):
                folder, _, name = part.rpartition("/_rels/")
                source = f"{folder}/{name.removesuffix('.rels')}"
                rows += [(path, source, r.get("Id"), r.get("Type"), r.get("Target"), r.get("TargetMode") == "External") for r in ElementTree.fromstring(content).iter(RELATIONSHIP)]
            yield pd.DataFrame(rows, columns=["path", "source", "rel_id", "type", "target", "external"])

    rels = found.filter(F.col("part").endswith(".rels")).select("path", "part", "content")
    return rels.mapInPandas(run, "path string, source string, rel_id string, type string, target string, external boolean")


def paragraphs(found: DataFrame) -> DataFrame:
    """path, ord, style, text of each paragraph of the main document; tabs and breaks as characters."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                root, rows = ElementTree.fromstring(content), []
                for w in (W, W_STRICT):
                    said = {f"{w}t": lambda e: e.text or "", f"{w}tab": lambda e: "\t", f"{w}br": lambda e: "\n", f"{w}drawing": lambda e: "\ufffc"}
                    for k, p in enumerate(root.iter(f"{w}p")):
                        style = p.find(f"{w}pPr/{w}pStyle")
                        runs = [e for r in p.iter(f"{w}r") for e in r]
                        rows.append((path, k, style.get(f"{w}val") if style is not None else None, "".join(said[e.tag](e) for e in runs if e.tag in said)))
                yield pd.DataFrame(rows, columns=["path", "ord", "style", "text"])

    main = found.filter("part = '/word/document.xml'").select("path", "content")
    return main.mapInPandas(run, "path string, ord long, style string, text string")


def packed(rows: DataFrame, key: str) -> DataFrame:
    """key, content: a zip of each key's parts (columns part, content), by part name; same parts, same bytes."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for part, content in sorted(zip(group["part"], group["content"], strict=True)):
                z.writestr(zipfile.ZipInfo(part.lstrip("/")), content, zipfile.ZIP_DEFLATED)
        return pd.DataFrame({key: [group[key].iloc[0]], "content": [out.getvalue()]})

    return rows.select(key, "part", "content").groupBy(key).applyInPandas(run, f"{key} {rows.schema[key].dataType.simpleString()}, content binary")
