"""PLY files: point clouds, Gaussians and meshes, read through Spark's readers and written by the driver."""

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: PLY's scalar spellings -> (numpy type, Spark type); unsigned types widen by a step. Fixed values.
TYPES = {
    "char": ("i1", T.ByteType()), "int8": ("i1", T.ByteType()), "uchar": ("u1", T.ShortType()), "uint8": ("u1", T.ShortType()),
    "short": ("i2", T.ShortType()), "int16": ("i2", T.ShortType()), "ushort": ("u2", T.IntegerType()), "uint16": ("u2", T.IntegerType()),
    "int": ("i4", T.IntegerType()), "int32": ("i4", T.IntegerType()), "uint": ("u4", T.LongType()), "uint32": ("u4", T.LongType()),
    "float": ("f4", T.FloatType()), "float32": ("f4", T.FloatType()), "double": ("f8", T.DoubleType()), "float64": ("f8", T.DoubleType()),
}
ENDIAN = {"binary_little_endian": "<", "binary_big_endian": ">"}


def header(head: bytes) -> tuple[str, list[tuple[str, int, list[tuple[str, str]]]], int]:
    """(format, [(element, count, [(property, type)])], where the body starts). A list property has the type "list a b"."""
    end = head.find(b"end_header")
    if not head.startswith(b"ply") or end < 0:
        raise ValueError("no PLY header")
    body = head.index(b"\n", end) + 1
    form, elements = "", []
    for line in head[:end].decode("ascii", "replace").splitlines():
        w = line.split()
        if not w or w[0] in ("ply", "comment", "obj_info"):
            continue
        if w[0] == "format":
            form = w[1]
        elif w[0] == "element":
            elements.append((w[1], int(w[2]), []))
        elif w[0] == "property":
            elements[-1][2].append((w[-1], " ".join(w[1:-1])))
    if form != "ascii" and form not in ENDIAN:
        raise ValueError(f"unknown PLY format {form!r}")
    return form, elements, body


def vertices(content: bytes) -> pd.DataFrame:
    form, elements, at = header(content)
    name, count, properties = elements[0]
    if name != "vertex" or any(t not in TYPES for _, t in properties):
        raise ValueError("the first element has to be vertices of scalar properties")
    if form == "ascii":
        rows = [line.split()[: len(properties)] for line in content[at:].decode("ascii").split("\n")[:count]]
        return pd.DataFrame({n: np.array([r[k] for r in rows], np.float64).astype(TYPES[t][0]) for k, (n, t) in enumerate(properties)})
    packed = np.frombuffer(content, np.dtype([(n, ENDIAN[form] + TYPES[t][0]) for n, t in properties]), count, at)
    return pd.DataFrame({n: packed[n].astype(TYPES[t][0]) for n, t in properties})


def read_vertices(spark: SparkSession, path: str) -> DataFrame:
    """(path, splat_index, every vertex property in file order); the schema comes from the first file's header."""
    files = spark.read.format("binaryFile").load(path)
    head = files.select(F.substring("content", 1, 65536)).first()
    if head is None:
        raise FileNotFoundError(path)
    properties = header(bytes(head[0]))[1][0][2]
    schema = T.StructType([T.StructField("path", T.StringType()), T.StructField("splat_index", T.LongType()), *[T.StructField(n, TYPES[t][1]) for n, t in properties]])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for p, content in zip(pdf["path"], pdf["content"], strict=True):
                found = vertices(bytes(content))
                for s in range(0, len(found), 100_000):
                    piece = found.iloc[s : s + 100_000].copy()
                    piece.insert(0, "splat_index", np.arange(s, s + len(piece)))
                    piece.insert(0, "path", p)
                    yield piece

    return files.select("path", "content").mapInPandas(run, schema)


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """(path, splat_index, x, y, z, r, g, b): colours in 0 to 1, 0.7 where a file has none."""
    v = read_vertices(spark, path)
    colour = {c: (F.col(n).cast("double") / 255 if n in v.columns else F.lit(0.7)) for c, n in zip("rgb", ("red", "green", "blue"), strict=True)}
    return v.select("path", "splat_index", *[F.col(c).cast("double").alias(c) for c in "xyz"], *[e.alias(c) for c, e in colour.items()])


def read_mesh(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """An ASCII mesh as (vertex, x, y, z) and (face, a, b, c); polygons become fans of triangles."""
    content = bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])
    form, elements, at = header(content)
    if form != "ascii":
        raise ValueError("meshes are read from ASCII only")
    lines = content[at:].decode("ascii").split("\n")
    n = elements[0][1]
    faces = [[int(x) for x in line.split()] for line in lines[n : n + (elements[1][1] if len(elements) > 1 else 0)]]
    fans = [(f[1], f[1 + k], f[2 + k]) for f in faces for k in range(1, f[0] - 1)]
    v = spark.createDataFrame([(k, *map(float, lines[k].split()[:3])) for k in range(n)], "vertex long, x double, y double, z double")
    return v, spark.createDataFrame([(k, *f) for k, f in enumerate(fans)], "face long, a long, b long, c long")


def encode(rows: pd.DataFrame, properties: list[tuple[str, str]], form: str = "binary_little_endian") -> bytes:
    """The bytes of a PLY file of vertices, properties in the given order."""
    head = "\n".join(["ply", f"format {form} 1.0", f"element vertex {len(rows)}", *[f"property {t} {n}" for n, t in properties], "end_header", ""]).encode()
    if form == "ascii":
        out = io.StringIO()
        for row in rows[[n for n, _ in properties]].itertuples(index=False):
            out.write(" ".join(repr(x.item() if hasattr(x, "item") else x) for x in row) + "\n")
        return head + out.getvalue().encode()
    packed = np.empty(len(rows), np.dtype([(n, ENDIAN[form] + TYPES[t][0]) for n, t in properties]))
    for n, _ in properties:
        packed[n] = rows[n].to_numpy()
    return head + packed.tobytes()


def write_vertices(df: DataFrame, path: str, properties: list[tuple[str, str]], form: str = "binary_little_endian") -> None:
    """One PLY file, rows by splat_index; a single file is one writer's work, so the rows have to fit the driver."""
    rows = df.orderBy("splat_index").select(*[n for n, _ in properties]).toPandas()
    with open(path, "wb") as f:
        f.write(encode(rows, properties, form))
