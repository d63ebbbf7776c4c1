"""Input tables of every content type, brought to one schema of extracted content."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from thornwall.config import stored
from thornwall.functions import html as html_functions
from thornwall.functions.text import content_hash, decode_bytes, encode_base64
from thornwall.operators import html as html_operators
from thornwall.operators import ocr

#: Files in a folder of those that are written spread out, and files or bytes that one task opens.
FILES, BYTES = 2_000, 1 << 26
#: Bytes of opened files that leave a task together.
READ_BYTES = 1 << 23

# name -> type of the extracted content; a source fills what its type has, the rest stays null
SCHEMA = {
    "content_id": "string",
    "content_type": "string",
    "content_hash": "string",
    "raw_text": "string",
    "ocr_text": "string",
    "char_count": "int",
    "ocr_confidence": "double",
    "has_hidden_text": "boolean",
    "has_hidden_divs": "boolean",
    "has_suspicious_scripts": "boolean",
    "alt_texts": "array<string>",
    "comments": "array<string>",
    "simulated": "boolean",
    "source": "string",
    "user_reputation": "int",
    "has_metadata": "boolean",
}


def _conform(df: DataFrame, content_type: str, columns: dict[str, Column | str]) -> DataFrame:
    for name in ("source", "user_reputation", "has_metadata"):
        if name in df.columns:
            columns.setdefault(name, F.col(name))
    columns.setdefault("content_type", F.lit(content_type))
    chosen = []
    for name, kind in SCHEMA.items():
        value = columns.get(name, F.lit(None))
        chosen.append((F.col(value) if isinstance(value, str) else value).cast(kind).alias(name))
    return df.select(*chosen)


def from_text(df: DataFrame, content_id: Column, text: str = "text", content_type: str = "text") -> DataFrame:
    """Plain text as it is; ``pdf`` content passes through the same way, marked as simulated."""
    columns: dict[str, Column | str] = {
        "content_id": content_id,
        "content_hash": content_hash(F.coalesce(F.col(text), F.lit(""))),
        "raw_text": F.coalesce(F.col(text), F.lit("")),
    }
    if content_type == "pdf":
        columns["simulated"] = F.lit(True)
    else:
        columns["char_count"] = F.char_length(F.coalesce(F.col(text), F.lit("")))
    return _conform(df, content_type, columns)


def from_html(df: DataFrame, content_id: Column, html: str = "html", mode: str = "regex", comments: bool = False) -> DataFrame:
    """Pages; ``mode`` is that of ``thornwall.operators.html.extract``. ``comments`` reads those too, for scans that score them."""
    df = html_operators.extract_for_scan(df, html, mode)
    columns = {
        "content_id": content_id,
        "content_hash": content_hash(F.coalesce(F.col(html), F.lit(""))),
        "raw_text": "raw_text",
        "has_hidden_divs": "has_hidden_divs",
        "has_suspicious_scripts": "has_suspicious_scripts",
        "alt_texts": "alt_texts",
    }
    if comments:
        columns["comments"] = F.transform(html_functions.comments(F.coalesce(F.col(html), F.lit(""))), lambda c: c["text"])
    return _conform(df, "html", columns)


def from_ocr_words(words: DataFrame, content_id: Column, images: DataFrame | None = None) -> DataFrame:
    """Images through their OCR words. ``images`` (image_id, content) supplies the hash of the bytes.

    The text counts twice, as raw text and as OCR text: the scan joins both.
    """
    df = ocr.images(words, segments=False)
    columns: dict[str, Column | str] = {
        "content_id": content_id,
        "raw_text": "text",
        "ocr_text": "text",
        "ocr_confidence": "confidence",
        "has_hidden_text": "has_hidden_text",
    }
    if images is not None:
        hashes = images.select("image_id", content_hash(F.col("content")).alias("content_hash"))
        df = df.join(hashes, "image_id", "left")
        columns["content_hash"] = "content_hash"
    return _conform(df, "image", columns)


def from_requests(df: DataFrame, words: DataFrame | None = None, mode: str = "regex") -> DataFrame:
    """Requests of mixed type (content_id, content_type, content), in one pass over the table; none is lost.

    Each extraction sees only the content of its type; for other rows its input is empty. ``words`` are the OCR
    words of images, by ``image_id`` (the content id); an image without words keeps its row, with no text.
    """
    kind = F.coalesce(F.col("content_type"), F.lit("text"))
    df = df.withColumns(
        {
            "content_type": kind,
            "content": F.coalesce("content", F.lit("")),
            "__tw_html": F.when(kind == "html", F.col("content")),
        }
    )
    df = html_operators.extract_for_scan(df, "__tw_html", mode)
    is_html, is_image = F.col("content_type") == "html", F.col("content_type") == "image"
    columns = {
        "content_id": "content_id",
        "content_type": F.col("content_type"),
        "content_hash": content_hash(F.col("content")),
        "raw_text": F.when(is_html, F.col("raw_text")).when(~is_image, F.col("content")),
        "char_count": F.when(F.col("content_type") == "text", F.char_length("content")),
        "has_hidden_divs": F.when(is_html, F.col("has_hidden_divs")),
        "has_suspicious_scripts": F.when(is_html, F.col("has_suspicious_scripts")),
        "alt_texts": F.when(is_html, F.col("alt_texts")),
        "simulated": F.when(F.col("content_type") == "pdf", F.lit(True)),
    }
    if words is not None:
        # only images meet their words: the other rows stay where they are
        kept = df.columns
        read = ocr.images(words, segments=False).select(
            F.col("image_id").alias("content_id"),
            F.col("text").alias("ocr_text"),
            F.col("confidence").alias("ocr_confidence"),
            "has_hidden_text",
        )
        images = df.filter(is_image).select(*kept).join(read, "content_id", "left")
        seen = {"raw_text": "ocr_text", "ocr_text": "ocr_text", "ocr_confidence": "ocr_confidence", "has_hidden_text": "has_hidden_text"}
        rest = _conform(df.filter(~is_image), "text", dict(columns))
        return rest.unionByName(_conform(images, "image", columns | seen))
    return _conform(df, "text", columns)


def union(*parts: DataFrame) -> DataFrame:
    """One content table; every part keeps its own scan and its own extraction."""
    return reduce(DataFrame.unionByName, parts)


def _local(folder: str) -> str:
    """A folder as pyarrow names it: local ones without their scheme, so that no character of theirs is read as an escape."""
    return "/" + folder.removeprefix("file:").lstrip("/") if folder.startswith("file:/") else folder


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, length, modified) of the files in a folder and those below it, or of a single file.

    Tasks list the folders, a level of them at a time, so the driver holds no file; files of one folder are listed by one
    task. What starts with ``_`` or ``.`` is passed over, as Spark's readers do.
    """
    root = _local(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSelector, FileSystem, FileType

        system, base = FileSystem.from_uri(root)
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                at = f"{base.rstrip('/')}/{folder}".rstrip("/")
                top = system.get_file_info(at)
                alone = top.type == FileType.File
                found = [top] if alone else system.get_file_info(FileSelector(at))
                for start in range(0, len(found), 10_000):
                    shown = [i for i in found[start : start + 10_000] if not i.base_name.startswith((".", "_"))]
                    shown = [i for i in shown if not i.base_name.endswith("._COPYING_")]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(["" if alone else i.path[len(base.rstrip("/")) + 1 :] for i in shown], pa.string()),
                            pa.array([i.base_name for i in shown], pa.string()),
                            pa.array([i.size if i.type == FileType.File else None for i in shown], pa.int64()),
                            pa.array([(i.mtime_ns or 0) // 10**6 * 1000 for i in shown], pa.int64()),
                        ],
                        names=["below", "name", "length", "micros"],
                    )

    levels, folders = [], spark.createDataFrame([("",)], "below string")
    while not folders.isEmpty():
        level = stored(folders.mapInArrow(run, "below string, name string, length long, micros long"), "listed")
        levels.append(level.where(F.col("length").isNotNull()))
        folders = level.where(F.col("length").isNull()).select("below")
        folders = folders.repartition(1 + folders.count() // 16, "below")
    whole = F.when(F.col("below") == "", F.lit(path)).otherwise(F.concat(F.lit(path.rstrip("/") + "/"), F.col("below")))
    return union(*levels).select(whole.alias("path"), "name", "length", F.timestamp_micros("micros").alias("modified"))


def _opened(files: DataFrame, path: str) -> DataFrame:
    """The listed files of a folder with their bytes in ``content``, opened by tasks of about FILES files or BYTES bytes."""
    root = _local(path)
    columns = [*files.columns, "content"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        system, base = FileSystem.from_uri(root)

        def made(rows: pa.RecordBatch, held: list[bytes]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*rows.columns, pa.array(held, pa.binary())], names=columns)

        for batch in batches:
            first, size, held = 0, 0, []
            for n, file in enumerate(batch.column(0)):
                with system.open_input_file(base + file.as_py()[len(path) :]) as opened:
                    held.append(opened.read())
                size += len(held[-1])
                if size >= READ_BYTES:
                    yield made(batch.slice(first, n + 1 - first), held)
                    first, size, held = n + 1, 0, []
            if held:
                yield made(batch.slice(first), held)

    many, total = files.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
    dealt = files.repartition(1 + max(many // FILES, total // BYTES), "path")
    return dealt.mapInArrow(run, "path string, name string, length long, modified timestamp, content binary")


def read_files(
    spark: SparkSession,
    path: str,
    content_type: str = "image",
    glob: str | None = None,
    largest: int | None = None,
    since: str | None = None,
) -> DataFrame:
    """Files as content: bytes of images as base64, other types as UTF-8 without invalid bytes.

    (path, name, content, content_type, length, modified). ``glob`` filters names; ``largest`` (bytes) and ``since`` (time of
    change) are decided from the listing, so files beyond them are not opened. Folders below ``path`` are read too. Files
    without a byte have no row.

    Tasks list and open the files (``list_files``); Spark's estimate of the result counts names and not contents, so joins
    need a hint against broadcasts. A path that names several by a pattern, or lies in a store that only
    Spark reads, goes to Spark's own reader, whose listing the driver holds.
    """
    by_spark = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = by_spark.getFileSystem(spark._jsc.hadoopConfiguration())
    whole = system.makeQualified(by_spark).toString()
    if _readable(whole) and system.exists(by_spark):
        files = list_files(spark, whole).where("length > 0")
        if glob is not None:
            matched = spark._jvm.org.apache.hadoop.fs.GlobPattern(glob).compiled().pattern()
            files = files.where(F.col("name").rlike(rf"(?s)\A(?:{matched})\z"))
    else:
        whole = None
        reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        if glob is not None:
            reader = reader.option("pathGlobFilter", glob)
        files = reader.load(path).withColumnRenamed("modificationTime", "modified")
    if largest is not None:
        files = files.where(F.col("length") <= largest)
    if since is not None:
        files = files.where(F.col("modified") >= F.lit(since).cast("timestamp"))
    if whole is not None:
        files = _opened(files, whole)
    return file_content(files, content_type).select(
        "path",
        F.element_at(F.split("path", "/"), -1).alias("name"),
        "content",
        F.lit(content_type).alias("content_type"),
        "length",
        "modified",
    )


def _readable(path: str) -> bool:
    """Whether pyarrow opens the store of a qualified path."""
    from pyarrow.fs import FileSystem

    try:
        FileSystem.from_uri(_local(path))
    except (pa.ArrowException, OSError):
        return False
    return True


def write_files(df: DataFrame, folder: str, name: str = "name", content: str = "content", folders: int | None = None) -> DataFrame:
    """One file per row, its bytes in ``content``; returns (name, length) of what was written.

    Files are written by the tasks under their own names, so a repeated task writes the same file again. Null content
    is an empty file; names have to be unique and without folders. ``folders`` spreads them over as many folders in
    ``folder``, by their names; see ``folders_for``.
    """
    root = _local(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        system, base = FileSystem.from_uri(root)
        made = set()
        for batch in batches:
            sizes = []
            for file, data in zip(batch.column(0), batch.column(1), strict=True):
                file, data, at = file.as_py(), data.as_py() or b"", base
                if folders is not None:
                    at = f"{base}/{zlib.crc32(str(file).encode()) % folders:06d}"
                    if at not in made:
                        system.create_dir(at)
                        made.add(at)
                with system.open_output_stream(f"{at}/{file}", compression=None) as out:
                    out.write(data)
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=["name", "length"])

    files = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
    files.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).mkdirs(files)
    rows = df.select(F.col(name).cast("string"), F.col(content).cast("binary")).mapInArrow(run, "name string, length long")
    return stored(rows, "written")


def folders_for(files: int) -> int:
    """Into how many folders so many files go, for tasks to list them."""
    return 1 + files // FILES


def file_content(files: DataFrame, content_type: str = "image") -> DataFrame:
    """Replace the ``content`` bytes of a file table by its content string."""
    raw = F.col("content")
    return files.withColumn("content", encode_base64(raw) if content_type == "image" else decode_bytes(raw))


def read_table(spark: SparkSession, path: str, *key: str, tasks: int | None = None) -> DataFrame:
    """A Parquet table as it is. ``tasks`` is for test files of one row group: it deals the rows by key."""
    table = spark.read.parquet(path)
    return table if tasks is None else table.repartition(tasks, *key)
