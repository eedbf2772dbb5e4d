"""PLY and NPZ as Spark data sources: spark.read.format("ply"), df.write.format("npz"), read in ranges and written by all tasks."""

import io
import json
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from fieldmark.sources.ply import ENDIAN, TYPES, header

#: Rows that a task reads, or writes as a file, unless the option `rows` says otherwise; rows of a batch.
ROWS, BATCH = 1_000_000, 50_000
HEAD = 1 << 16
#: How columns are written in a PLY file unless the option `types` says otherwise.
WRITTEN = {"float": "float", "double": "double", "int": "int", "smallint": "short", "tinyint": "char"}


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path there."""
    return pafs.FileSystem.from_uri(path)


def files(path: str, ending: str) -> list[str]:
    """The file, or the files of the folder with that ending, in order; those of unfinished writes are left out."""
    system, at = opened(path)
    info = system.get_file_info(at)
    if info.type == pafs.FileType.File:
        return [at]
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = system.get_file_info(pafs.FileSelector(at, recursive=False))
    return sorted(x.path for x in found if x.type == pafs.FileType.File and x.base_name.endswith(ending) and not x.base_name.startswith(("_", ".")))


@dataclass
class Part(InputPartition):
    path: str
    offset: int
    first: int
    count: int
    form: str = ""


class _Source(DataSource):
    @property
    def path(self) -> str:
        return self.options["path"]

    @property
    def rows(self) -> int:
        return int(self.options.get("rows", ROWS))


class PlySource(_Source):
    """Vertices of a PLY file or of a folder's: path, splat_index (the place in its file) and the properties of the first file.

    Binary files are read in ranges of `rows` vertices, each by a task that reads no other bytes; ASCII ones by a task each. Written is
    a folder of files of up to `rows` vertices; options: form (binary_little_endian, binary_big_endian, ascii), types (JSON, by column).
    """

    @classmethod
    def name(cls) -> str:
        return "ply"

    def heads(self) -> Iterator[tuple[str, str, int, list[tuple[str, str]], int]]:
        system, _ = opened(self.path)
        for path in files(self.path, ".ply"):
            with system.open_input_file(path) as f:
                form, elements, body = header(f.read(HEAD))
            name, count, properties = elements[0]
            if name != "vertex" or any(t not in TYPES for _, t in properties):
                raise ValueError(f"{path}: the first element has to be vertices of scalar properties")
            yield path, form, count, properties, body

    def schema(self) -> T.StructType:
        for _, _, _, properties, _ in self.heads():
            return T.StructType([T.StructField("path", T.StringType()), T.StructField("splat_index", T.LongType()), *[T.StructField(n, TYPES[t][1]) for n, t in properties]])
        raise FileNotFoundError(f"{self.path}: no PLY file")

    def reader(self, schema: T.StructType) -> "PlyReader":
        return PlyReader(self, schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> "PlyWriter":
        return PlyWriter(self, schema, overwrite)


class PlyReader(DataSourceReader):
    def __init__(self, source: PlySource, schema: T.StructType):
        self.uri, self.names, self.parts = source.path, [f.name for f in schema.fields[2:]], []
        for path, form, count, properties, body in source.heads():
            if [n for n, _ in properties] != self.names:
                raise ValueError(f"{path}: other properties than the first file's")
            self.properties = properties
            width = sum(np.dtype(TYPES[t][0]).itemsize for _, t in properties)
            for first in range(0, count, source.rows if form != "ascii" else max(count, 1)):
                some = min(source.rows, count - first) if form != "ascii" else count
                self.parts.append(Part(path, body + first * width if form != "ascii" else body, first, some, form))
        self.schema = schema

    def partitions(self) -> list[Part]:
        return self.parts

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int64(), *[pa.from_numpy_dtype(np.dtype(_wide(t))) for _, t in self.properties]]
        names = ["path", "splat_index", *self.names]
        system, _ = opened(self.uri)

        def batch(first: int, columns: list[np.ndarray]) -> pa.RecordBatch:
            n = len(columns[0])
            own = [pa.array([part.path] * n), pa.array(np.arange(first, first + n)), *[pa.array(c.astype(_wide(t))) for c, (_, t) in zip(columns, self.properties, strict=True)]]
            return pa.RecordBatch.from_arrays([c.cast(k) for c, k in zip(own, kinds, strict=True)], names)

        with system.open_input_file(part.path) as f:
            f.seek(part.offset)
            if part.form == "ascii":
                lines = io.TextIOWrapper(f, "ascii")
                for at in range(0, part.count, BATCH):
                    rows = [next(lines).split()[: len(self.names)] for _ in range(min(BATCH, part.count - at))]
                    yield batch(at, [np.array(c, np.float64).astype(TYPES[t][0]) for c, (_, t) in zip(zip(*rows, strict=True), self.properties, strict=True)])
                return
            kind = np.dtype([(n, ENDIAN[part.form] + TYPES[t][0]) for n, t in self.properties])
            for at in range(0, part.count, BATCH):
                n = min(BATCH, part.count - at)
                packed = np.frombuffer(f.read(n * kind.itemsize), kind, n)
                yield batch(part.first + at, [packed[c].astype(packed[c].dtype.newbyteorder("=")) for c in self.names])


def _wide(kind: str) -> str:
    """The type a value has in a table: unsigned ones a step wider."""
    code = TYPES[kind][0]
    return f"i{2 * int(code[1])}" if code[0] == "u" else code


@dataclass
class Written(WriterCommitMessage):
    names: list[str]
    rows: int


class _Shards(DataSourceArrowWriter):
    """Tasks write whole files into a folder of their own; committing moves those of the attempts that count to where they belong.

    Readers pass the folder over, also one that a task of a failed write was still writing to when the write was given up.
    """

    ending = ""

    def __init__(self, source: _Source, schema: T.StructType, overwrite: bool):
        self.uri, self.most, self.overwrite = source.path, source.rows, overwrite
        self.names, self.kinds = schema.names, [f.dataType.simpleString() for f in schema.fields]
        self.folder = f"_writing-{uuid.uuid4().hex}"

    def encoded(self, rows: pa.Table) -> bytes:
        raise NotImplementedError

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        task, (system, at) = TaskContext.get(), opened(self.uri)
        system.create_dir(f"{at}/{self.folder}", recursive=True)
        held, size, out, total = [], 0, [], 0

        def put() -> None:
            rows = pa.Table.from_batches(held)
            name = f"part-{task.partitionId():05}-{len(out):04}-{task.taskAttemptId()}{self.ending}"
            with system.open_output_stream(f"{at}/{self.folder}/{name}") as f:
                f.write(self.encoded(rows))
            out.append(name)

        for b in batches:
            while b.num_rows:
                some = b.slice(0, self.most - size)
                held.append(some)
                size, total, b = size + some.num_rows, total + some.num_rows, b.slice(some.num_rows)
                if size == self.most:
                    put()
                    held, size = [], 0
        if size:
            put()
        return Written(out, total)

    def commit(self, messages: list[Written | None]) -> None:
        system, at = opened(self.uri)
        system.create_dir(at, recursive=True)
        before = files(self.uri, self.ending) if self.overwrite else []
        tag = self.folder[-8:]
        for m in messages:
            for name in m.names if m else []:
                system.move(f"{at}/{self.folder}/{name}", f"{at}/{name.removesuffix(self.ending)}-{tag}{self.ending}")
        for path in before:
            system.delete_file(path)
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        system, at = opened(self.uri)
        if system.get_file_info(f"{at}/{self.folder}").type == pafs.FileType.Directory:
            system.delete_dir(f"{at}/{self.folder}")


class PlyWriter(_Shards):
    ending = ".ply"

    def __init__(self, source: PlySource, schema: T.StructType, overwrite: bool):
        super().__init__(source, schema, overwrite)
        asked = json.loads(source.options.get("types", "{}"))
        self.form = source.options.get("form", "binary_little_endian")
        self.types = [(n, asked.get(n) or WRITTEN.get(k, "")) for n, k in zip(self.names, self.kinds, strict=True) if n not in ("path", "splat_index")]
        if bad := [n for n, t in self.types if t not in TYPES] or (self.form != "ascii" and self.form not in ENDIAN and [self.form]):
            raise ValueError(f"no PLY type for {', '.join(bad)}")

    def encoded(self, rows: pa.Table) -> bytes:
        from fieldmark.sources.ply import encode

        return encode(rows.select([n for n, _ in self.types]).to_pandas(), self.types, self.form)


class NpzSource(_Source):
    """Arrays of equal length in NPZ archives: path, row and the columns of each array, doubles, NaN as null.

    Option arrays (JSON): {array: its columns}; without it, the first archive tells: an array of one column has its name, of several
    the name and a number. A task reads an archive `BATCH` rows at a time. Written is a folder of archives of up to `rows` rows.
    """

    @classmethod
    def name(cls) -> str:
        return "npz"

    def arrays(self) -> dict[str, list[str]]:
        if asked := self.options.get("arrays"):
            return json.loads(asked)
        system, _ = opened(self.path)
        for path in files(self.path, ".npz"):
            with system.open_input_file(path) as f, zipfile.ZipFile(f) as z:
                shapes = {n.removesuffix(".npy"): _shape(z, n)[0] for n in z.namelist()}
            rows = max((s[0] for s in shapes.values() if s), default=0)
            width = {n: int(np.prod(s[1:])) for n, s in shapes.items() if s and s[0] == rows}
            return {n: [n] if w == 1 else [f"{n}_{k}" for k in range(w)] for n, w in width.items()}
        raise FileNotFoundError(f"{self.path}: no NPZ file")

    def schema(self) -> T.StructType:
        columns = [c for cs in self.arrays().values() for c in cs]
        return T.StructType([T.StructField("path", T.StringType()), T.StructField("row", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in columns]])

    def reader(self, schema: T.StructType) -> "NpzReader":
        return NpzReader(self)

    def writer(self, schema: T.StructType, overwrite: bool) -> "NpzWriter":
        return NpzWriter(self, schema, overwrite)


def _shape(z: zipfile.ZipFile, name: str) -> tuple[tuple[int, ...], np.dtype]:
    with z.open(name) as f:
        return _header(f)


def _header(f) -> tuple[tuple[int, ...], np.dtype]:
    version = np.lib.format.read_magic(f)
    shape, fortran, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
    if fortran and len(shape) > 1 or kind.hasobject:
        raise ValueError("arrays have to be plain numbers, row by row")
    return shape, kind


class NpzReader(DataSourceReader):
    def __init__(self, source: NpzSource):
        self.uri, self.arrays = source.path, source.arrays()
        self.paths = files(source.path, ".npz")

    def partitions(self) -> list[Part]:
        return [Part(p, 0, 0, 0) for p in self.paths]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        names = ["path", "row", *[c for cs in self.arrays.values() for c in cs]]
        system, _ = opened(self.uri)
        with system.open_input_file(part.path) as f, zipfile.ZipFile(f) as z:
            streams = {n: z.open(f"{n}.npy") for n in self.arrays if f"{n}.npy" in z.namelist()}
            heads = {n: _header(s) for n, s in streams.items()}
            rows = {s[0] for s, _ in heads.values()}
            if len(rows) > 1:
                raise ValueError(f"{part.path}: arrays of different lengths")
            for at in range(0, max(rows, default=0), BATCH):
                n, columns = min(BATCH, max(rows) - at), []
                for name, own in self.arrays.items():
                    if name not in streams:
                        columns += [pa.nulls(n, pa.float64())] * len(own)
                        continue
                    shape, kind = heads[name]
                    x = np.frombuffer(streams[name].read(n * kind.itemsize * int(np.prod(shape[1:]))), kind).reshape(n, -1).astype(float)
                    if x.shape[1] != len(own):
                        raise ValueError(f"{part.path}: {name} has {x.shape[1]} columns, not {len(own)}")
                    columns += [pa.array(x[:, k], from_pandas=True) for k in range(x.shape[1])]
                yield pa.RecordBatch.from_arrays([pa.array([part.path] * n), pa.array(np.arange(at, at + n)), *columns], names)


class NpzWriter(_Shards):
    ending = ".npz"

    def __init__(self, source: NpzSource, schema: T.StructType, overwrite: bool):
        super().__init__(source, schema, overwrite)
        asked = json.loads(source.options.get("arrays", "{}"))
        self.arrays = asked or {n: [n] for n in self.names if n not in ("path", "row")}
        if missing := [c for cs in self.arrays.values() for c in cs if c not in self.names]:
            raise ValueError("no column " + ", ".join(missing))

    def encoded(self, rows: pa.Table) -> bytes:
        out = io.BytesIO()
        column = lambda c: rows.column(c).to_numpy()
        np.savez_compressed(out, **{n: column(cs[0]) if len(cs) == 1 else np.column_stack([column(c) for c in cs]) for n, cs in self.arrays.items()})
        return out.getvalue()


#: The arrays of an archive of splats. Fixed values.
SPLAT_ARRAYS = {"centers": ["x", "y", "z"], "colors": ["r", "g", "b"], "tau": ["tau"], "sigma": ["sigma"], "is_surface": ["is_surface"]}


def register(spark: SparkSession) -> None:
    """Makes both formats known to the session."""
    for source in (PlySource, NpzSource):
        spark.dataSource.register(source)


__all__ = ["NpzSource", "PlySource", "SPLAT_ARRAYS", "register"]
