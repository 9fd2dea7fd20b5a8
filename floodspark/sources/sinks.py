"""Diagnostics files as a data source writer, for batches and streams.

A file belongs to one run and batch number: a comment line with the mesh summary, a header, and one line a step. Tasks
write below a staging folder of their write; the commit moves the files to their places, and a write that fails leaves
none behind. A task that runs twice writes two sets, of which one is committed.
"""

from __future__ import annotations

import csv
import io
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, DataSourceWriter, WriterCommitMessage
from pyspark.sql.streaming.readwriter import DataStreamWriter
from pyspark.sql.types import StructType

from .. import schemas as S

__all__ = ["write_diagnostics_files", "diagnostics_sink"]

FIELDS = [f.name for f in S.DIAGNOSTICS.fields]


def _store(path: str):
    """The file system of a path or URI, and the path in it."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
    return fs.LocalFileSystem(), path


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str, str]]


class _Files:
    """What batch and stream writers share: tasks stage files, the driver moves or drops them."""

    def __init__(self, options: dict, schema: StructType):
        self.path, self.columns, self.staging = options["path"], schema.names, f"_staging-{uuid.uuid4().hex}"

    def write(self, rows: Iterator) -> Written:
        store, root = _store(self.path)
        place = {name: k for k, name in enumerate(self.columns)}
        held: dict[tuple, list] = {}
        for row in rows:
            held.setdefault((row[place["run"]], row[place["batch_number"]]), []).append(tuple(row))
        files = []
        for (run, number), some in held.items():
            folder = f"{root}/{self.staging}/{uuid.uuid4().hex}"
            store.create_dir(folder, recursive=True)
            text = io.StringIO()
            summary = next((r[place["mesh_summary"]] for r in some if r[place["mesh_summary"]] is not None), None)
            if summary is not None:
                text.write(f"# {summary}\n")
            out = csv.writer(text, lineterminator="\n")
            out.writerow(FIELDS)
            some.sort(key=lambda r: (r[place["sim_time_s"]] is not None, r[place["sim_time_s"]] or 0.0))
            out.writerows([["" if r[place[f]] is None else r[place[f]] for f in FIELDS] for r in some])
            with store.open_output_stream(f"{folder}/part.csv") as stream:
                stream.write(text.getvalue().encode())
            files.append((f"{folder}/part.csv", str(run), str(number)))
        return Written(files)

    def _place(self, messages: list, mark: str) -> None:
        store, root = _store(self.path)
        for message in messages:
            for source, run, number in message.files if message else []:
                store.create_dir(f"{root}/outputs_{run}", recursive=True)
                store.move(source, f"{root}/outputs_{run}/run_diagnostics_{number}{mark}.csv")
        self._drop()

    def _drop(self) -> None:
        from pyarrow import fs

        store, root = _store(self.path)
        if store.get_file_info(f"{root}/{self.staging}").type != fs.FileType.NotFound:
            store.delete_dir(f"{root}/{self.staging}")


class _BatchWriter(_Files, DataSourceWriter):
    def commit(self, messages: list) -> None:
        self._place(messages, "")

    def abort(self, messages: list) -> None:
        self._drop()


class _StreamWriter(_Files, DataSourceStreamWriter):
    def commit(self, messages: list, batchId: int) -> None:  # noqa: N803
        self._place(messages, f"-{batchId}")

    def abort(self, messages: list, batchId: int) -> None:  # noqa: N803
        self._drop()


class DiagnosticsFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "run_diagnostics"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("run_diagnostics files are appended; write to another path instead")
        return _BatchWriter(self.options, schema)

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamWriter:  # noqa: N802
        return _StreamWriter(self.options, schema)


def _by_file(df: DataFrame) -> DataFrame:
    df.sparkSession.dataSource.register(DiagnosticsFiles)
    summary = F.col("mesh_summary") if "mesh_summary" in df.columns else F.lit(None).cast("string").alias("mesh_summary")
    return df.select("run", "batch_number", summary, *FIELDS).repartition("run", "batch_number")


def write_diagnostics_files(df: DataFrame, path: str) -> None:
    """``outputs_<run>/run_diagnostics_<batch>.csv`` below ``path`` for each run and batch number of ``df``.

    ``mesh_summary``, where there is such a column, gives the comment line. A file that exists is replaced as a whole.
    """
    _by_file(df).write.format("run_diagnostics").mode("append").save(path)


def diagnostics_sink(df: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """The same for a stream: each micro-batch adds files of its own, marked with its number; a repeated one replaces them."""
    return _by_file(df).writeStream.format("run_diagnostics").option("path", path).option("checkpointLocation", checkpoint)
