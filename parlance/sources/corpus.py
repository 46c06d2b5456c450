"""Corpus folders and page transcriptions as document tables."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pa_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.session import tidied

# Files that are listed together, bytes of files that go on together, bytes that a task reads
# and bytes that opening a file counts as.
_LISTED_FILES, _READ_BYTES, _TASK_BYTES, _OPEN_BYTES = 8192, 4 << 20, 64 << 20, 4096
# Pages per intermediate piece of a document.
_PAGES_PER_PIECE = 256


def scan_corpus(spark: SparkSession, root: str) -> DataFrame:
    """Raw files ``root/<date>/<classe>/<doc>.txt`` as ``(path, content)``.

    Raises ``FileNotFoundError`` when the root itself is missing; a root without text
    files gives an empty table. The driver lists the two folder levels only; tasks list the
    files below a shared mount, other file systems are listed by Spark. Files of no length are
    left out; they have no sentences either.
    """
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        raise FileNotFoundError(f"corpus folder not found: {root}")
    found = fs.globStatus(jvm.org.apache.hadoop.fs.Path(path, "*/*")) or []
    folders = [f.getPath().toString() for f in found if f.isDirectory()]
    if not folders:
        return spark.createDataFrame([], "path string, content binary")
    if fs.getUri().getScheme() == "file":
        return _mounted_files(spark, [f.getPath().toUri().getPath() for f in found if f.isDirectory()])
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.txt")
        .load(folders)
        .select("path", "content")
    )


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task function: the text files right below folders, as Spark lists them: no hidden ones."""

    def batch(found: list[tuple[str, int]]) -> pa.RecordBatch:
        return pa.record_batch([pa.array([p for p, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64())], names=["file", "size"])

    for folders in batches:
        for folder in folders.column(0).to_pylist():
            found = []
            with os.scandir(folder) as entries:
                for e in entries:
                    if e.name.endswith(".txt") and e.name[0] not in "._" and e.is_file() and e.stat().st_size:
                        found.append((e.path, e.stat().st_size))
                    if len(found) >= _LISTED_FILES:
                        yield batch(found)
                        found = []
            yield batch(found)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task function: files with their content, in batches of bounded size."""
    for files in batches:
        paths, contents, size = [], [], 0
        for path in files.column(0).to_pylist():
            with open(path, "rb") as f:
                contents.append(f.read())
            paths.append(f"file:{path}")
            size += len(contents[-1])
            if size >= _READ_BYTES:
                yield pa.record_batch([pa.array(paths, pa.string()), pa.array(contents, pa.binary())], names=["path", "content"])
                paths, contents, size = [], [], 0
        yield pa.record_batch([pa.array(paths, pa.string()), pa.array(contents, pa.binary())], names=["path", "content"])


def _mounted_files(spark: SparkSession, folders: list[str]) -> DataFrame:
    """Files right below folders of a shared mount, listed and read by tasks.

    The driver holds no file names, so it does not grow with the corpus; files are dealt over
    tasks of about ``_TASK_BYTES``, and at least one a core.
    """
    cores = spark.sparkContext.defaultParallelism
    names = spark.createDataFrame([(f,) for f in folders], "folder string")
    files = names.repartition(min(len(folders), 4 * cores), "folder").mapInArrow(_listed, "file string, size long")
    total = files.agg(F.sum(F.col("size") + _OPEN_BYTES)).first()[0] or 0
    tasks = max(cores, total // _TASK_BYTES)
    return files.select("file").repartition(tasks, "file").mapInArrow(_read, "path string, content binary")


def named_files(files: DataFrame) -> DataFrame:
    """Every file with what its path says, whether it is valid UTF-8, and its text if it is."""
    parts = F.split("path", "/")
    name = F.element_at(parts, -1)
    readable = F.is_valid_utf8("content")
    return files.select(
        F.regexp_replace(name, r"\.txt$", "").alias("doc_id"),
        F.element_at(parts, -3).alias("date"),
        F.element_at(parts, -2).alias("classe"),
        name.alias("file_name"),
        readable.alias("readable"),
        F.when(readable, F.decode("content", "UTF-8")).alias("text"),
    )


def decode_corpus(files: DataFrame) -> DataFrame:
    """Valid UTF-8 files as documents; folder names give ``date`` and ``classe``."""
    return named_files(files).where("readable").drop("readable")


def write_corpus(files: DataFrame, root: str, slices: int = 1) -> int:
    """Write ``(path, content)`` below ``root``, ``path`` being relative; the number of files.

    Each task writes its own files, whole, and a task that runs again writes the same ones.
    In ``slices`` by the hash of the path, what a join moves is a slice of the texts at a time.
    """

    def run(batches):
        system, base = pa_fs.FileSystem.from_uri(root)
        made: set[str] = set()
        for batch in batches:
            paths = batch.column("path").to_pylist()
            for path, content in zip(paths, batch.column("content").to_pylist()):
                target = f"{base}/{path}"
                folder = target.rsplit("/", 1)[0]
                if folder not in made:
                    system.create_dir(folder, recursive=True)
                    made.add(folder)
                with system.open_output_stream(target) as out:
                    out.write(content or b"")
            yield pa.record_batch([pa.array([len(paths)], pa.int64())], names=["n"])

    rows, written = files.select("path", "content"), 0
    with tidied(files.sparkSession):
        for i in range(slices):
            part = rows if slices == 1 else rows.where(F.pmod(F.xxhash64("path"), F.lit(slices)) == i)
            written += part.mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0
    return written


def corpus_rejects(files: DataFrame) -> DataFrame:
    """Files that are not valid UTF-8, with the reason; they never stop the scan."""
    return files.where(~F.is_valid_utf8("content")).select(
        "path", F.lit("invalid UTF-8").alias("reason")
    )


def read_text_corpus(spark: SparkSession, root: str) -> DataFrame:
    """Documents of a corpus folder; order by ``date, classe, file_name`` where it matters."""
    return decode_corpus(scan_corpus(spark, root))


def assemble_documents(pages: DataFrame) -> DataFrame:
    """Concatenate the first transcription of each page, in page order, without separator.

    ``pages`` is ``(doc, page_no, transcription_id, text)``. Documents without text are
    dropped. Pages are joined in runs first, so that a long document is put together from
    a few pieces.
    """
    first = pages.groupBy("doc", "page_no").agg(
        F.min_by("text", "transcription_id").alias("text")
    )

    def joined(order: str, text: str):
        ordered = F.array_sort(F.collect_list(F.struct(order, text)))
        return F.array_join(F.transform(ordered, lambda p: p[text]), "")

    pieces = first.groupBy(
        "doc", F.floor(F.col("page_no") / _PAGES_PER_PIECE).alias("piece")
    ).agg(joined("page_no", "text").alias("text"))
    return (
        pieces.groupBy("doc").agg(joined("piece", "text").alias("text")).where(F.col("text") != "")
    )


def element_counts(elements: DataFrame) -> DataFrame:
    """Elements per type."""
    return elements.groupBy("type").agg(F.count("*").alias("n"))
