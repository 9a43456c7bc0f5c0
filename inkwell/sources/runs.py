"""A run's files as one commit: tasks stage their parts, the driver publishes all of them together, a failed job leaves none."""

from __future__ import annotations

import csv
import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

#: What marks a run as whole: written last.
MARK = "run.json"


class RunSink(DataSource):
    """``df.write.format("inkwell_run")``: results with model, image_path and status, in any columns besides.

    Options: path, a folder of a store that pyarrow opens; summary, a JSON object of columns and rows.
    Under the path: results/*.jsonl, details/*.csv (a header each), summary.csv, report/*.md, whose parts
    follow each other by name, and run.json, which lists the files and counts the rows.
    """

    @classmethod
    def name(cls) -> str:
        return "inkwell_run"

    def writer(self, schema, overwrite: bool) -> RunWriter:
        return RunWriter(dict(self.options), schema.names, overwrite)


@dataclass
class Staged(WriterCommitMessage):
    files: list[str]
    rows: int
    failures: int


def cell(value: object) -> str:
    return "" if value is None else f"{value:.4f}" if isinstance(value, float) else str(value)


def line(cells: list) -> str:
    return "| " + " | ".join(map(cell, cells)) + " |\n"


def read_run(path: str) -> dict:
    """What a whole run's mark says; FileNotFoundError for a path without one."""
    store, root = fs.FileSystem.from_uri(path)
    with store.open_input_stream(f"{root}/{MARK}") as f:
        return json.loads(f.read())


class RunWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], names: list[str], overwrite: bool) -> None:
        self.path, self.names, self.overwrite = options["path"].rstrip("/"), names, overwrite
        self.summary = json.loads(options.get("summary", '{"columns": [], "rows": []}'))
        self.own = uuid.uuid4().hex
        # made here, on the driver: a task that outlives an abort finds no folder to write to
        store, _, staged = self.store()
        for part in ("results", "details", "report"):
            store.create_dir(f"{staged}/{part}", recursive=True)

    def store(self) -> tuple[fs.FileSystem, str, str]:
        """The store, the run's folder and the one where this job stages."""
        store, root = fs.FileSystem.from_uri(self.path)
        parent, _, name = root.rpartition("/")
        return store, root, f"{parent}/_staged-{name}-{self.own}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        context = TaskContext.get()
        # an attempt's files have names of their own: only those of the attempt that counts are published
        own = f"part-{context.partitionId():05d}-{context.taskAttemptId()}"
        store, _, staged = self.store()
        files = [f"results/{own}.jsonl", f"details/{own}.csv", f"report/part-1-{own}.md"]
        rows = failures = 0
        with store.open_output_stream(f"{staged}/{files[0]}") as results, store.open_output_stream(f"{staged}/{files[1]}") as details, store.open_output_stream(f"{staged}/{files[2]}") as report:
            self.table(details, [self.names])
            for batch in iterator:
                found = batch.to_pylist()
                results.write("".join(json.dumps(r, ensure_ascii=False, default=str) + "\n" for r in found).encode())
                self.table(details, [[json.dumps(v, default=str) if isinstance(v, (dict, list)) else v for v in r.values()] for r in found])
                failed = [r for r in found if r.get("status") != "success"]
                report.write("".join(f"- {r.get('model')} {r.get('image_path')}: {r.get('error') or r.get('status')}\n" for r in failed).encode())
                rows, failures = rows + len(found), failures + len(failed)
        return Staged(files, rows, failures)

    def table(self, out, rows: list[list]) -> None:
        text = io.StringIO()
        csv.writer(text).writerows(rows)
        out.write(text.getvalue().encode())

    def commit(self, messages: list[Staged | None]) -> None:
        store, root, staged = self.store()
        done = [m for m in messages if m is not None]
        files = sorted(f for m in done for f in m.files)
        for found in store.get_file_info(fs.FileSelector(staged, recursive=True)):
            if found.is_file and found.path.removeprefix(f"{staged}/").lstrip("/") not in files:
                store.delete_file(found.path)  # of attempts that don't count
        names, rows = self.summary["columns"], self.summary["rows"]
        with store.open_output_stream(f"{staged}/summary.csv") as out:
            self.table(out, [names, *[[r.get(n) for n in names] for r in rows]])
        with store.open_output_stream(f"{staged}/report/part-0.md") as out:
            table = "".join([line(names), line(["---"] * len(names)), *[line([r.get(n) for n in names]) for r in rows]]) if names else ""
            out.write(f"# Report\n\n{table}\n## Failures\n\n".encode())
        there = store.get_file_info(root).type != fs.FileType.NotFound
        if there and not self.overwrite:
            raise FileExistsError(f"{self.path} is there already")
        old = f"{staged}-old"
        if there:
            store.move(root, old)
        store.move(staged, root)
        mark = {"files": sorted([*files, "summary.csv", "report/part-0.md"]), "rows": sum(m.rows for m in done), "failures": sum(m.failures for m in done)}
        with store.open_output_stream(f"{root}/{MARK}") as out:
            out.write(json.dumps(mark).encode())
        if there:
            store.delete_dir(old)

    def abort(self, messages: list[Staged | None]) -> None:
        store, _, staged = self.store()
        if store.get_file_info(staged).type != fs.FileType.NotFound:
            store.delete_dir(staged)
