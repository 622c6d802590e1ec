"""The Python data sink "corpus": one set of files written by many tasks, none of which, nor the driver, holds it whole.

Rows are (section, value), values being JSON, in the order in which they are to stand: over partitions, then inside them. Each task writes its values to a file of its own for each section, in
the folder of the option parts (a path, or an address of a file system that Arrow knows). commit() lets them flow into the targets, line by line, and puts each target in place when it is whole; abort() and a failed commit leave the
targets as they were. A task that runs twice leaves two files, of which the one whose message arrived counts. The folder must be one that driver and executors share.

Option targets: a JSON list of {path, text, form}. In a target's text a line of marks, mark(section), stands for that section's values: as a JSON list where form is "json", else
as the lines that the function form of option module makes of them, value by value."""

from __future__ import annotations

import io
import json
import re
import uuid
from dataclasses import dataclass
from importlib import import_module

import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from loomquest.sources.tables import saved

_MARK = re.compile("\"?@@([a-z_]+)@@\"?")


def mark(section: str) -> str:
    return f"@@{section}@@"


@dataclass
class Written(WriterCommitMessage):
    """Of a task: its partition and the files of its sections."""

    partition: int
    files: dict


class Corpus(DataSource):
    @classmethod
    def name(cls):
        return "corpus"

    def schema(self):
        return "section string, value string"

    def writer(self, schema, overwrite):
        return _Writer(self.options)


class _Writer(DataSourceWriter):
    def __init__(self, options):
        self.parts, self.targets, self.module = options["parts"], json.loads(options["targets"]), options["module"]

    def write(self, iterator):
        fs, folder = pafs.FileSystem.from_uri(self.parts)
        fs.create_dir(folder, recursive=True)
        number, files, held = TaskContext.get().partitionId(), {}, {}
        try:
            for row in iterator:
                if row.section not in held:
                    files[row.section] = f"{folder}/{number}-{uuid.uuid4().hex}"
                    held[row.section] = io.BufferedWriter(fs.open_output_stream(files[row.section]), 1 << 20)
                held[row.section].write(row.value.encode() + b"\n")
        finally:
            for f in held.values():
                f.close()
        return Written(number, files)

    def commit(self, messages):
        fs, folder = pafs.FileSystem.from_uri(self.parts)
        tasks = sorted((m for m in messages if m), key=lambda m: m.partition)

        def values(section):
            for task in tasks:
                if section in task.files:
                    with io.BufferedReader(fs.open_input_stream(task.files[section]), 1 << 20) as f:
                        yield from (line[:-1].decode() for line in f)

        made = []
        for t in self.targets:
            path = pafs.FileSystem.from_uri(t["path"])[1]
            made.append((f"{path}.{uuid.uuid4().hex}", path))
            show = None if t["form"] == "json" else getattr(import_module(self.module), t["form"])
            with io.TextIOWrapper(io.BufferedWriter(fs.open_output_stream(made[-1][0]), 1 << 20), encoding="utf-8") as out:
                at = 0
                for m in _MARK.finditer(t["text"]):
                    out.write(t["text"][at : m.start()])
                    at = m.end()
                    if show:
                        for n, v in enumerate(values(m[1]), 1):
                            out.write(show(m[1], n, json.loads(v)))
                    else:
                        out.write("[")
                        for n, v in enumerate(values(m[1])):
                            out.write(("," if n else "") + "\n    " + v)
                        out.write("]")
                out.write(t["text"][at:])
        for new, path in made:
            fs.move(new, path)
        self._clear(fs, folder)

    def abort(self, messages):
        self._clear(*pafs.FileSystem.from_uri(self.parts))

    @staticmethod
    def _clear(fs, folder):
        if fs.get_file_info(folder).type == pafs.FileType.Directory:
            fs.delete_dir(folder)


def write(rows: DataFrame, keys: list[str], targets: list[dict], folder: str, module: str) -> None:
    """rows: section, value and the columns of keys, which order the values of a section. Deals them out by ranges of that order and writes the targets."""
    spark, order = rows.sparkSession, ["section", *keys]
    spark.dataSource.register(Corpus)
    dealt = saved(rows, "sections").repartitionByRange(*order).sortWithinPartitions(*order).select("section", "value")
    dealt.write.format("corpus").mode("append").options(parts=f"{folder}/parts-{uuid.uuid4().hex}", targets=json.dumps(targets), module=module).save()
