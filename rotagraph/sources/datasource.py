"""The format ``graph6`` for ``spark.read`` and ``df.write``: one line, one graph.

``spark.dataSource.register(Graph6Source)``; then ``spark.read.format("graph6").load(path)``
gives (src, line_no, g6) and ``df.write.format("graph6").save(path)`` writes the column g6.
Paths are opened through pyarrow's file systems, so object stores work as local folders do.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

HEADER = ">>graph6<<"


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


class _File(InputPartition):
    def __init__(self, path: str, uri: str):
        self.path, self.uri = path, uri


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.root = options["path"]

    def partitions(self):
        from pyarrow import fs

        store, path = _store(self.root)
        info = store.get_file_info(path)
        files = [info] if info.type == fs.FileType.File else [x for x in store.get_file_info(fs.FileSelector(path)) if x.type == fs.FileType.File and x.base_name.endswith(".g6")]
        return [_File(x.path, self.root) for x in sorted(files, key=lambda x: x.path)]

    def read(self, partition: _File) -> Iterator[tuple]:
        store, _ = _store(partition.uri)
        with store.open_input_stream(partition.path) as f:
            import io

            for k, line in enumerate(io.TextIOWrapper(f, "ascii"), 1):
                line = line.rstrip("\n\r")
                if k == 1 and line.startswith(HEADER):
                    line = line[len(HEADER) :]
                if line:
                    yield partition.path, k, line


class _Done(WriterCommitMessage):
    def __init__(self, temporary: str, final: str):
        self.temporary, self.final = temporary, final


class _Writer(DataSourceWriter):
    def __init__(self, options, schema, overwrite: bool):
        self.root, self.at, self.overwrite = options["path"], schema.fieldNames().index("g6"), overwrite

    def write(self, rows: Iterator) -> _Done:
        from pyspark import TaskContext

        task = TaskContext.get()
        store, path = _store(self.root)
        store.create_dir(f"{path}/_temporary", recursive=True)
        temporary = f"{path}/_temporary/{task.partitionId()}-{task.taskAttemptId()}"
        with store.open_output_stream(temporary) as f:
            f.write(HEADER.encode())
            for row in rows:
                f.write(row[self.at].encode() + b"\n")
        return _Done(temporary, f"{path}/part-{task.partitionId():05d}.g6")

    def commit(self, messages) -> None:
        store, path = _store(self.root)
        if self.overwrite:
            from pyarrow import fs

            for x in store.get_file_info(fs.FileSelector(path)):
                if x.base_name.endswith(".g6"):
                    store.delete_file(x.path)
        for m in messages:
            if m is not None:
                store.move(m.temporary, m.final)
        store.delete_dir(f"{path}/_temporary")

    def abort(self, messages) -> None:
        store, path = _store(self.root)
        store.delete_dir(f"{path}/_temporary")


class Graph6Source(DataSource):
    @classmethod
    def name(cls) -> str:
        return "graph6"

    def schema(self) -> str:
        return "src string, line_no int, g6 string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options, schema, overwrite)
