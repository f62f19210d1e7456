"""Notes written back as files: all of a write's notes take their new text, or none does.

Tasks write into a folder of the write's own inside the vault, each with a list of what it wrote. On commit the driver
marks that folder as whole and moves each file over its note; on abort it removes the folder, with whatever lost
executors left there. ``finish_writes`` completes a commit that was cut short and removes what was never committed.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from kgspark.sources.markdown import safe_paths

HELD = ".writing-"  # scans skip names with a dot ahead
WHOLE = "whole.json"
MOVERS = 16


def _place(root: str):
    """(file system, folder) of a path or URI, by pyarrow."""
    from pyarrow import fs

    if "://" not in root and root.startswith("file:"):
        root = root.removeprefix("file:")
    found, folder = fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)
    return found, folder.rstrip("/")


def _put(files, path: str, data: bytes) -> None:
    with files.open_output_stream(path) as out:
        out.write(data)


def _get(files, path: str):
    with files.open_input_stream(path) as f:
        return json.loads(f.read())


def _move_all(files, folder: str, held: str) -> None:
    """Move what the lists of a whole write name; what was moved before is gone from the folder and left alone."""
    from pyarrow import fs

    def move(pair: list[str]) -> None:
        source, target = f"{held}/{pair[0]}", f"{folder}/{pair[1]}"
        if files.get_file_info(source).type != fs.FileType.NotFound:
            files.create_dir(posixpath.dirname(target), recursive=True)
            files.move(source, target)

    with ThreadPoolExecutor(MOVERS) as pool:
        for name in _get(files, f"{held}/{WHOLE}"):
            for _ in pool.map(move, _get(files, f"{held}/{name}")):
                pass
    files.delete_dir(held)


@dataclass
class Written(WriterCommitMessage):
    listing: str | None
    notes: int


class NoteWriter(DataSourceWriter):
    def __init__(self, root: str):
        self.root, self.job = root, uuid.uuid4().hex

    def write(self, iterator: Iterator) -> Written:
        files, folder = _place(self.root)
        own, pairs, held = uuid.uuid4().hex, [], f"{folder}/{HELD}{self.job}"
        for row in iterator:
            if not pairs:
                files.create_dir(f"{held}/{own}", recursive=True)
            name = f"{own}/{len(pairs)}"
            _put(files, f"{held}/{name}", row["raw"].encode())
            pairs.append([name, row["path"]])
        if not pairs:
            return Written(None, 0)
        _put(files, f"{held}/{own}.json", json.dumps(pairs).encode())
        return Written(f"{own}.json", len(pairs))

    def commit(self, messages: list) -> None:
        files, folder = _place(self.root)
        held, names = f"{folder}/{HELD}{self.job}", [m.listing for m in messages if m and m.listing]
        if names:
            _put(files, f"{held}/{WHOLE}", json.dumps(names).encode())  # from here on the write will be finished, not undone
            _move_all(files, folder, held)

    def abort(self, messages: list) -> None:
        from pyarrow import fs

        files, folder = _place(self.root)
        held = f"{folder}/{HELD}{self.job}"
        if files.get_file_info(f"{held}/{WHOLE}").type == fs.FileType.NotFound and files.get_file_info(held).type != fs.FileType.NotFound:
            files.delete_dir(held)


class NoteSink(DataSource):
    """``notes``: rows (path, raw) to files under the option ``root``."""

    @classmethod
    def name(cls) -> str:
        return "notes"

    def schema(self) -> str:
        return "path string, raw string"

    def writer(self, schema, overwrite: bool) -> NoteWriter:
        return NoteWriter(self.options["root"])


def write_notes(notes: DataFrame, root: str) -> None:
    """Write (path, raw) under ``root``; notes that aren't among them stay as they are.

    Fails, and changes nothing, if a path leaves the folder or comes twice, or a text is null. Tasks hold one note at a
    time; the driver reads one task's list of paths at a time.
    """
    rows = notes.select("path", "raw")
    twice = F.count(F.lit(1)).over(Window.partitionBy("path")) > 1
    sound = safe_paths(rows).select("path").distinct().withColumn("_ok", F.lit(True))
    rows = rows.withColumn("_twice", twice).join(sound, "path", "left")
    wrong = F.when(F.col("_ok").isNull(), "outside of the folder: ").when(F.col("_twice"), "twice: ").when(F.col("raw").isNull(), "no text: ")
    path = F.when(wrong.isNotNull(), F.raise_error(F.concat(wrong, F.coalesce("path", F.lit("-"))))).otherwise(F.col("path"))
    notes.sparkSession.dataSource.register(NoteSink)
    rows.select(path.alias("path"), "raw").write.format("notes").option("root", root).mode("append").save()


def finish_writes(root: str) -> dict[str, int]:
    """{finished, removed}: writes that were cut short, brought to their end or taken back. No write may be running."""
    from pyarrow import fs

    files, folder = _place(root)
    out = {"finished": 0, "removed": 0}
    for info in files.get_file_info(fs.FileSelector(folder)):
        if info.type != fs.FileType.Directory or not info.base_name.startswith(HELD):
            continue
        if files.get_file_info(f"{info.path}/{WHOLE}").type != fs.FileType.NotFound:
            _move_all(files, folder, info.path)
            out["finished"] += 1
        else:
            files.delete_dir(info.path)
            out["removed"] += 1
    return out
