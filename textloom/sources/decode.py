"""Bytes to text: byte-order marks, UTF-16 without one, UTF-8, Korean code pages."""

from __future__ import annotations

import codecs
import os
import re
import threading
import unicodedata
from collections import Counter
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import extension
from ..functions.vectorized import vectorized

MOST_BYTES = 40 << 20
_MARKS = ((codecs.BOM_UTF32_BE, "utf-32-be"), (codecs.BOM_UTF32_LE, "utf-32-le"), (codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be"))


def _strict(raw: bytes, codec: str) -> str | None:
    try:
        return raw.decode(codec)
    except UnicodeDecodeError:
        return None


#: Weight of a character by its range, the first that fits; letters and numbers of
#: other scripts, characters that are none, and the rest have the last three. Fixed
#: values: texts must be told apart as other implementations do.
WEIGHTS = (
    (2.5, ((0x09, 0x0A), (0x0D, 0x0D), (0x20, 0x20))),
    (-12.0, ((0x00, 0x1F), (0xFFFE, 0xFFFF))),
    (3.5, ((0x21, 0x7E),)),
    (6.0, ((0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7A3))),
    (5.0, ((0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF))),
    (2.5, ((0xA0, 0x24F), (0x2000, 0x206F))),
)
LETTER, NONE, REST = 0.8, -8.0, -0.5
#: What the better byte order must reach, and by how much.
LEAST, MARGIN = 2.2, 0.75


@lru_cache(maxsize=70_000)
def _weight(c: str) -> float:
    n = ord(c)
    for w, ranges in WEIGHTS:
        if any(a <= n <= b for a, b in ranges):
            return w
    kind = unicodedata.category(c)
    return LETTER if kind in ("Lu", "Ll", "Lt", "Lo", "Nd", "Nl") else NONE if kind[0] == "C" else REST


def plausibility(text: str) -> float:
    """Mean weight of a whole text's characters."""
    return sum(n * _weight(c) for c, n in Counter(text).items()) / len(text) if text else float("-inf")


def utf16_by_lanes(raw: bytes) -> str | None:
    """UTF-16 without a mark, seen by where its zero bytes are."""
    if len(raw) < 4 or len(raw) % 2:
        return None
    sample = raw[:8192]
    n = len(sample) // 2
    even, odd = sample[0::2].count(0) / n, sample[1::2].count(0) / n
    for zeros, other, codec in ((odd, even, "utf-16-le"), (even, odd, "utf-16-be")):
        if zeros >= 0.25 and zeros - other >= 0.20 and zeros >= 2 * other:
            return _strict(raw, codec)
    return None


def utf16_by_plausibility(raw: bytes) -> str | None:
    """UTF-16 that is a text in one byte order and clearly less of one in the other."""
    if len(raw) < 4 or len(raw) % 2:
        return None
    texts = [_strict(raw, c) for c in ("utf-16-le", "utf-16-be")]
    if None in texts:
        return None
    scores = [plausibility(t) for t in texts]
    if max(scores) < LEAST or abs(scores[0] - scores[1]) < MARGIN:
        return None
    return texts[scores.index(max(scores))]


def decode(raw: bytes) -> str:
    """The first way that fits: mark, zero lanes, UTF-8, CP949, EUC-KR, UTF-16 by
    plausibility; else UTF-8 with replacements."""
    raw = bytes(raw)
    for mark, codec in _MARKS:
        if raw.startswith(mark) and (text := _strict(raw[len(mark) :], codec)) is not None:
            return text
    for way in (utf16_by_lanes, lambda r: _strict(r, "utf-8"), lambda r: _strict(r, "cp949"), lambda r: _strict(r, "euc_kr"), utf16_by_plausibility):
        text = way(raw)
        if text is not None and not ("\x00" in text and way is not utf16_by_lanes):
            return text
    return raw.decode("utf-8", "replace")


decode_col = vectorized(decode, "string")


def _files(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)


def _told(files: DataFrame, read, most: int = MOST_BYTES) -> DataFrame:
    """(path, text, length, modified, sha, state): read(content) of files up to `most`
    bytes; larger ones come back without a text and are not read."""
    meta = ["path", "length", F.col("modificationTime").alias("modified")]
    fit = files.where(F.col("length") <= most).select(*meta, read(F.col("content")).alias("text"), F.sha2("content", 256).alias("sha"))
    fit = fit.withColumn("state", F.when(F.col("text").isNull(), "invalid").otherwise("ok"))
    none = F.lit(None).cast("string")
    big = files.where(F.col("length") > most).select(*meta, none.alias("text"), none.alias("sha"), F.lit("too large").alias("state"))
    return fit.unionByName(big).select("path", "text", "length", "modified", "sha", "state")


def read_texts(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """(path, text, length, modified, sha, state) of .txt files; state: ok or too large."""
    return _told(_files(spark, path, recursive).where(extension(F.col("path")) == "txt"), decode_col)


def read_documents(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """(path, text, length, modified, sha, state) of documents, each by its extension:
    .docx as flat text, .txt decoded, others with the state unsupported."""
    from .docx import flat_text_col

    files, e = _files(spark, path, recursive), extension(F.col("path"))
    none = F.lit(None).cast("string")
    other = files.where(~e.isin("docx", "txt")).select("path", none.alias("text"), "length", F.col("modificationTime").alias("modified"), none.alias("sha"), F.lit("unsupported").alias("state"))
    return _told(files.where(e == "docx"), flat_text_col).unionByName(_told(files.where(e == "txt"), decode_col)).unionByName(other)


def read_code(spark: SparkSession, path: str) -> DataFrame:
    """(path, content, length, modified, sha, state) of source files, their text kept
    as it is, marks included; state: ok, invalid (no UTF-8) or too large."""
    from ..functions.text import CODE_EXTENSIONS

    files = _files(spark, path).where(extension(F.col("path")).isin(CODE_EXTENSIONS))
    return _told(files, lambda c: F.try_validate_utf8(c.cast("string"))).withColumnRenamed("text", "content")


def _links(root: str) -> list[str]:
    """Symbolic links under a folder of this machine; they are never followed."""
    base = root.removeprefix("file://").removeprefix("file:")
    return [os.path.relpath(os.path.join(d, n), base) for d, folders, files in os.walk(base) for n in folders + files if os.path.islink(os.path.join(d, n))] if os.path.isdir(base) else []


def read_snapshot(spark: SparkSession, root: str, most_files: int | None = 20_000, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(path, content): a folder tree by relative path, build folders and links left
    out. Too many files, a file that is too large or two files of one path are errors;
    most_files=None lifts the first limit."""
    from ..functions.text import safe_relative_path

    files = _files(spark, root)
    base = root.rstrip("/").split("://")[-1].removeprefix("file:")
    relative = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/*", "/"), "^" + re.escape(base) + "/", "")
    named = files.withColumn("relative", relative).where(safe_relative_path(F.col("relative")))
    for link in _links(root):
        named = named.where((F.col("relative") != link) & ~F.startswith("relative", F.lit(f"{link}/")))
    seen = named.agg(F.count("*").alias("n"), F.max("length").alias("most"), F.count_distinct("relative").alias("paths")).first()
    if most_files is not None and seen["n"] > most_files:
        raise ValueError(f"more than {most_files} files")
    if (seen["most"] or 0) > most_bytes:
        raise ValueError(f"a file is larger than {most_bytes} bytes")
    if seen["paths"] < seen["n"]:
        raise ValueError("two files have the same path")
    return named.select(F.col("relative").alias("path"), "content")


def read_project(spark: SparkSession, path: str) -> DataFrame:
    """(project, label, path, sha, added_at) rows of project manifests."""
    schema = "name string, files array<struct<label:string,path:string,sha256:string,addedAt:timestamp>>"
    return spark.read.schema(schema).json(path, multiLine=True).select(F.col("name").alias("project"), F.explode("files").alias("f")).select("project", "f.label", "f.path", F.col("f.sha256").alias("sha"), F.col("f.addedAt").alias("added_at"))


def write_project(project: str, files: list[dict], path: str) -> None:
    """One manifest, written beside under a name of its own and then moved, so that a
    reader sees the old or the new one; writers of one process wait for each other."""
    import json
    import uuid

    part = f"{path}.{uuid.uuid4().hex}"
    with _SAVING:
        try:
            with open(part, "x", encoding="utf-8") as f:
                json.dump({"name": project, "files": files}, f, ensure_ascii=False, default=str)
            os.replace(part, path)
        finally:
            if os.path.exists(part):
                os.remove(part)


_SAVING = threading.Lock()
