"""Formats of uploaded files, by name, media type and first bytes."""

from __future__ import annotations

import io
import xml.etree.ElementTree as ET
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import names

EXTENSIONS = {"txt": "txt", "md": "md", "markdown": "md", "docx": "docx", "pdf": "pdf"}
MEDIA = {
    "text/plain": "txt",
    "text/markdown": "md",
    "text/x-markdown": "md",
    "text/x-web-markdown": "md",
    "application/x-markdown": "md",
    "application/pdf": "pdf",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "docx",
}
# Extensions that are never accepted.
REFUSED = (
    "doc", "xls", "xlsx", "ppt", "pptx", "odt", "ods", "odp", "rtf", "html", "htm", "csv", "json",
    "xml", "zip", "epub", "pages", "key", "numbers",
)


#: Formats that are not text.
BINARY = ("docx", "pdf")


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _table(values: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in values.items() for x in kv))


def extension(name: str | Column) -> Column:
    return F.lower(F.regexp_extract(F.trim(name), r"\.([^./\\]+)$", 1))


def detect(name: str | Column, media_type: str | Column) -> Column:
    """struct<kind, error>: the extension decides, then the media type; generic
    types (text/*, octet-stream, none) leave it to the extension, and a specific
    one that contradicts it is an error."""
    ext, media = extension(name), F.lower(F.trim(F.split_part(F.coalesce(media_type, F.lit("")), F.lit(";"), F.lit(1))))
    by_ext, by_media = F.element_at(_table(EXTENSIONS), ext), F.element_at(_table(MEDIA), media)
    generic = media.isin("", "application/octet-stream") | media.startswith("text/")
    kind = F.when(ext.isin(*REFUSED), None).otherwise(F.coalesce(by_ext, by_media))
    clash = by_ext.isNotNull() & ~generic & (by_media.isNull() | (by_media != by_ext))
    error = F.when(ext.isin(*REFUSED), "unsupported file type").when(clash, "the media type contradicts the file name").when(kind.isNull(), "unknown file type")
    return F.struct(F.when(error.isNull(), kind).alias("kind"), error.alias("error"))


def detect_text(name: str | Column, declared: str | Column) -> Column:
    """struct<kind, error> of a text that comes without a file: a refused extension is an error whatever is
    ``declared``; a binary format, by name or declared, has to come as a file; a declared format
    that contradicts the name's is an error; without either it is plain text."""
    named, said = F.element_at(_table(EXTENSIONS), extension(F.coalesce(_c(name), F.lit("")))), _c(declared)
    refused, binary = extension(F.coalesce(_c(name), F.lit(""))).isin(*REFUSED), lambda c: F.coalesce(c.isin(*BINARY), F.lit(False))
    error = (
        F.when(refused, "unsupported file type")
        .when(said.isNotNull() & ~said.isin(*set(EXTENSIONS.values())), "unknown format")
        .when(binary(said) | binary(named), F.concat(F.when(binary(said), said).otherwise(named), F.lit(" has to be uploaded as a file")))
        .when(said != named, "the format contradicts the file name")
    )
    return F.struct(F.when(error.isNull(), F.coalesce(said, named, F.lit("txt"))).alias("kind"), error.alias("error"))


def signature_error(kind: str | Column, content: str | Column) -> Column:
    """What is wrong with the first bytes of a binary format, or null. Only what is called a Word file is opened in Python."""
    k, data = _c(kind), _c(content)
    word = F.pandas_udf(lambda s: s.map(lambda d: is_docx(bytes(d)), na_action="ignore").astype("boolean"), "boolean")(F.when(k == "docx", data))
    return F.when((k == "pdf") & ~looks_like_pdf(data), "the file is not a PDF").when((k == "docx") & ~F.coalesce(word, F.lit(False)), "the file is not a .docx")


def accepted(files: DataFrame, name: str = "name", media: str | None = None, content: str = "content") -> DataFrame:
    """``files`` with ``kind`` and ``error``: what each is by name and media type, and whether its bytes and its size bear that out.
    A name that does not show all of its characters is an error too."""
    found = files.withColumn("_found", detect(F.col(name), F.col(media) if media else F.lit(None).cast("string")))
    wrong = F.coalesce(names.filename(name)["error"], F.col("_found.error"), F.when(F.coalesce(F.length(content), F.lit(0)) == 0, "the file is empty"), signature_error("_found.kind", content))
    return found.withColumn("error", wrong).withColumn("kind", F.when(F.col("error").isNull(), F.col("_found.kind"))).drop("_found")


def looks_like_pdf(content: str | Column) -> Column:
    return F.locate("%PDF-", F.decode(F.substring(content, 1, 1024), "ISO-8859-1")) > 0


def is_docx(data: bytes, most_entries: int = 10_000) -> bool:
    """A zip whose content types name a Word main part."""
    if not data.startswith(b"PK\x03\x04"):
        return False
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            if len(z.infolist()) > most_entries:
                return False
            types = ET.fromstring(z.read("[Content_Types].xml"))
    except (zipfile.BadZipFile, KeyError, ET.ParseError):
        return False
    return any(e.tag.endswith("}Override") and "wordprocessingml" in e.get("ContentType", "") and "main+xml" in e.get("ContentType", "") for e in types)


def corpus(spark: SparkSession, folder: str) -> DataFrame:
    """(path, name, content, kind, sha256) of the readable files of a folder, by path;
    hidden files and others are passed over. A folder without any is an error."""
    files = spark.read.format("binaryFile").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    kind = F.element_at(F.create_map(*(F.lit(x) for kv in EXTENSIONS.items() for x in kv)), extension(name))
    listed = files.withColumns({"name": name, "kind": kind}).filter(F.col("kind").isNotNull() & ~F.col("name").startswith("."))
    if listed.select("path").isEmpty():
        raise ValueError(f"no readable file in {folder}")
    return listed.select("path", "name", "content", "kind", F.sha2("content", 256).alias("sha256")).orderBy("path")
