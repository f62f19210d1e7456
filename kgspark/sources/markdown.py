"""Markdown trees as notes: (vault, path, raw, mtime, size)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.operators.annotate import Completeness
from kgspark.session import stage

MAX_BYTES = 50 * 1024 * 1024


def _files(spark: SparkSession, root: str, glob: str, tolerant: bool = False) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob)
    files = files.option("ignoreCorruptFiles", tolerant).option("ignoreMissingFiles", tolerant).load(root)
    base = root.rstrip("/").split("://")[-1]
    path = F.regexp_replace(F.url_decode(F.regexp_replace("path", r"\+", "%2B")), rf"^.*?{_quote(base)}/", "")
    return files.withColumn("path", path).where(~F.col("path").rlike(r"(^|/)\."))


def read_markdown(spark: SparkSession, root: str, vault: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """All ``.md`` files under ``root`` whose path has no dot-led part, none above ``max_bytes``.

    The size filter reaches the scan, so oversized files are never read. A file that can't be read fails the scan.
    """
    rows = _files(spark, root, "*.md").where(F.col("length") <= max_bytes)
    return rows.select(F.lit(vault).alias("vault"), "path", F.decode("content", "UTF-8").alias("raw"), F.col("modificationTime").alias("mtime"), F.col("length").alias("size"))


def list_notes(spark: SparkSession, root: str) -> DataFrame:
    """(path) of the ``.md`` files under ``root`` whose path has no dot-led part, listed by tasks: a folder a row, a level a round.

    For vaults of more files than a driver should know. ``root`` is a path or a URI that pyarrow opens; links to folders aren't followed.
    """
    folders_, found = spark.createDataFrame([("",)], "path string"), []
    while True:
        seen = stage(folders_.mapInArrow(_lister(root), "path string, folder boolean"), "note-paths")
        found.append(seen.where(~F.col("folder") & F.col("path").endswith(".md")).select("path"))
        folders_ = seen.where("folder").select("path").repartition("path")
        if not folders_.limit(1).count():
            break
    out = found[0]
    for rows in found[1:]:
        out = out.unionByName(rows)
    return out


def read_notes(files: DataFrame, root: str, vault: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """``read_markdown`` of listed files (path): tasks open them, a few MB at a time, and the driver knows none of them."""
    tasks = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # by number: paths are small, what they name isn't
    rows = files.select("path").repartition(tasks, "path").mapInArrow(_reader(root, max_bytes), "path string, content binary, mtime timestamp, size long")
    return rows.select(F.lit(vault).alias("vault"), "path", F.decode("content", "UTF-8").alias("raw"), "mtime", "size")


def _batches(rows, names: list[str], types: list, most_rows: int, most_bytes: int):
    import pyarrow as pa

    held, size = [], 0
    batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names)
    for row, n in rows:
        held.append(row)
        size += n
        if len(held) >= most_rows or size >= most_bytes:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def _lister(root: str):
    def run(batches):
        import os

        import pyarrow as pa
        from pyarrow import fs

        from kgspark.sources.note_writer import _place

        files, folder = _place(root)

        def entries(path: str):
            if isinstance(files, fs.LocalFileSystem):  # name by name: a folder may have millions
                with os.scandir(path) as found:
                    yield from ((e.name, e.is_dir(follow_symlinks=False)) for e in found)
            else:
                yield from ((i.base_name, i.type == fs.FileType.Directory) for i in files.get_file_info(fs.FileSelector(path)))

        def rows():
            for batch in batches:
                for sub in batch.column(0).to_pylist():
                    yield from (((f"{sub}/{n}" if sub else n, d), 0) for n, d in entries(f"{folder}/{sub}" if sub else folder) if not n.startswith("."))

        yield from _batches(rows(), ["path", "folder"], [pa.string(), pa.bool_()], 10_000, 1)

    return run


def _reader(root: str, max_bytes: int):
    def run(batches):
        import pyarrow as pa

        from kgspark.sources.note_writer import _place

        files, folder = _place(root)

        def rows():
            for batch in batches:
                for path in batch.column(0).to_pylist():
                    info = files.get_file_info(f"{folder}/{path}")
                    if info.size is None or info.size <= max_bytes:
                        with files.open_input_stream(info.path) as f:  # fails where the file is gone
                            yield (path, f.read(), info.mtime and info.mtime.replace(microsecond=info.mtime.microsecond // 1000 * 1000), info.size), info.size or 0

        yield from _batches(rows(), ["path", "content", "mtime", "size"], [pa.string(), pa.binary(), pa.timestamp("us", "UTC"), pa.int64()], 1000, 4 << 20)

    return run


def scan_markdown(spark: SparkSession, root: str, vault: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """As ``read_markdown``, but a file that can't be read, or is too large, stays as a row without text and says why.

    (vault, path, raw, mtime, size, skipped): the listing, beside what could be read of it. ``scan_report`` sums it up.
    A file that is gone by the time it is listed isn't there.
    """
    listed = _files(spark, root, "*.md", tolerant=True).select("path", F.col("modificationTime").alias("mtime"), F.col("length").alias("size"))
    texts = _files(spark, root, "*.md", tolerant=True).where(F.col("length") <= max_bytes).select("path", F.decode("content", "UTF-8").alias("raw"))
    skipped = F.when(F.col("size") > max_bytes, "too_large").when(F.col("raw").isNull(), "unreadable")
    return listed.join(texts, "path", "left").select(F.lit(vault).alias("vault"), "path", "raw", "mtime", "size", skipped.alias("skipped"))


def scan_report(scanned: DataFrame) -> Completeness:
    """Exact if all could be read, else partial with the reasons."""
    rows = scanned.groupBy("skipped").agg(F.count("*").alias("n")).collect()  # a row a reason
    bad = {r["skipped"]: r["n"] for r in rows if r["skipped"]}
    good = sum(r["n"] for r in rows if not r["skipped"])
    return Completeness.partial(good, sum(bad.values()), sorted(bad)) if bad else Completeness.exact(good, good)


def list_bases(spark: SparkSession, root: str) -> DataFrame:
    """(path) of the ``.base`` files of a tree; their contents aren't read."""
    return _files(spark, root, "*.base").select("path")


def file_info(notes: DataFrame) -> DataFrame:
    """(vault, path, name, extension, size, modified in milliseconds) of each note."""
    file = F.element_at(F.split("path", "/"), -1)
    name = F.regexp_replace(file, r"\.[^.]*$", "")
    return notes.select(
        "vault", "path", name.alias("name"), F.regexp_extract(file, r"\.([^.]*)$", 1).alias("extension"),
        F.octet_length("raw").cast("long").alias("size"), F.unix_millis(F.col("mtime").cast("timestamp")).alias("modified"),
    )


def _quote(text: str) -> str:
    return "".join("\\" + c if not c.isalnum() and c != "/" else c for c in text)


def read_all(spark: SparkSession, roots: dict[str, str]) -> DataFrame:
    """Several vaults as one table; an unreadable root raises at once, whichever it is."""
    frames = [read_markdown(spark, root, vault) for vault, root in roots.items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def safe_paths(df: DataFrame, column: str = "path") -> DataFrame:
    """Rows whose path stays inside the vault: relative, without ``..`` parts, drive letters or NUL."""
    bad = F.col(column).rlike(r"(^/)|(^|/)\.\.(/|$)|^[A-Za-z]:|\\|\x00")
    return df.where(~bad)


def folders(notes: DataFrame) -> DataFrame:
    """(vault, folder) of every directory that holds a note, at any depth."""
    parts = F.split("path", "/")
    n = F.size(parts)
    prefixes = F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/")))
    return notes.select("vault", F.explode(prefixes).alias("folder")).distinct()
