"""Files as relations: images with geometry, point sets, transforms, matrices and lists.

Readers go through Spark's sources, so any store that Spark reads will do; binary formats are
decoded on the executors, one file a row.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.grid import AXES, Geometry

# Data type codes of the NIfTI-1 header.
_NIFTI_TYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4", 1024: "i8", 1280: "u8"}


def write_image(df: DataFrame, geometry: Geometry, path: str) -> None:
    """The cells as Parquet and the geometry as one JSON row beside them."""
    df.write.mode("overwrite").parquet(f"{path}/cells")
    row = json.dumps({"size": geometry.size, "spacing": geometry.spacing, "origin": geometry.origin, "direction": geometry.direction})
    df.sparkSession.createDataFrame([(row,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/geometry")


def read_image(spark: SparkSession, path: str) -> tuple[DataFrame, Geometry]:
    head = json.loads(spark.read.text(f"{path}/geometry").first()[0])
    return spark.read.parquet(f"{path}/cells"), Geometry(**{k: tuple(v) for k, v in head.items()})


def read_nifti(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, x, y, z, t, v) of uncompressed or gzipped NIfTI-1 files."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import gzip

        import numpy as np

        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):
                data = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
                order = "<" if struct.unpack_from("<i", data, 0)[0] == 348 else ">"
                dim = struct.unpack_from(f"{order}8h", data, 40)
                kind = struct.unpack_from(f"{order}h", data, 70)[0]
                offset, slope, inter = struct.unpack_from(f"{order}3f", data, 108)
                shape = tuple(max(1, n) for n in dim[1 : 1 + dim[0]]) + (1,) * (4 - dim[0])
                v = np.frombuffer(data, np.dtype(order + _NIFTI_TYPES[kind]), int(np.prod(shape)), int(offset)).astype(float)
                v = v * slope + inter if slope else v
                step = max(1, shape[0] * shape[1])
                for lo in range(0, len(v), step * 64):
                    part = v[lo : lo + step * 64]
                    i = np.arange(lo, lo + len(part))
                    out = {"path": path}
                    for a, n in zip(AXES, shape, strict=False):
                        out[a], i = i % n, i // n
                    yield pd.DataFrame({**out, "v": part})

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInPandas(decode, "path string, x bigint, y bigint, z bigint, t bigint, v double")


def nifti_bytes(values, spacing: tuple[float, ...] = (1.0, 1.0, 1.0)) -> bytes:
    """A NIfTI-1 file of a numpy array, x first, as 32-bit floats."""
    import numpy as np

    head = bytearray(352)
    struct.pack_into("<i", head, 0, 348)
    struct.pack_into("<8h", head, 40, values.ndim, *values.shape, *(1,) * (7 - values.ndim))
    struct.pack_into("<2h", head, 70, 16, 32)
    struct.pack_into("<8f", head, 76, 1.0, *spacing[: values.ndim], *(1.0,) * (7 - len(spacing[: values.ndim])))
    struct.pack_into("<3f", head, 108, 352.0, 0.0, 0.0)
    head[344:348] = b"n+1\0"
    return bytes(head) + np.asarray(values, "<f4").tobytes(order="F")


def read_points(spark: SparkSession, path: str, dim: int = 3) -> DataFrame:
    """Lines ``x y z label`` (in 2-D the third number is ignored); all-zero rows of label 0 are left out."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).filter(F.trim("value") != "").select(*[parts[i].cast("double").alias(a) for i, a in enumerate(AXES[:dim])], parts[3].cast("double").cast("bigint").alias("label"))
    zero = F.col("label") == 0
    for a in AXES[:dim]:
        zero = zero & (F.col(a) == 0)
    return rows.filter(~zero)


def write_points(df: DataFrame, path: str) -> None:
    axes = [a for a in AXES if a in df.columns]
    padded = [F.col(a).cast("string") for a in axes] + [F.lit("0")] * (3 - len(axes)) + [F.col("label").cast("string")]
    df.select(F.concat_ws(" ", *padded).alias("value")).write.mode("overwrite").text(path)


def read_vtk_points(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, id, x, y, z, label) of legacy VTK files of points, text or big-endian binary, with their scalars as labels (0 where there are none)."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        kinds = {b"float": ">f4", b"double": ">f8", b"int": ">i4", b"long": ">i8", b"unsigned_char": ">u1", b"short": ">i2"}

        def numbers(data: bytes, at: int, n: int, kind: bytes, text: bool) -> tuple[np.ndarray, int]:
            if not text:
                d = np.dtype(kinds[kind])
                return np.frombuffer(data, d, n, at).astype(float), at + n * d.itemsize
            out: list[float] = []
            while len(out) < n:
                end = data.find(b"\n", at)
                end = len(data) if end < 0 else end
                out += map(float, data[at:end].split())
                at = end + 1
            return np.array(out[:n]), at

        for b in batches:
            for path, data in zip(b["path"], b["content"], strict=True):
                text, at, points, labels, count = True, 0, np.zeros((0, 3)), None, 0
                while at < len(data):
                    end = data.find(b"\n", at)
                    end = len(data) if end < 0 else end
                    words = data[at:end].split()
                    at = end + 1
                    if words[:1] == [b"BINARY"]:
                        text = False
                    elif words[:1] == [b"POINTS"]:
                        flat, at = numbers(data, at, 3 * int(words[1]), words[2], text)
                        points = flat.reshape(-1, 3)
                    elif words[:1] == [b"POINT_DATA"]:
                        count = int(words[1])
                    elif words[:1] == [b"SCALARS"] and count:
                        end = data.find(b"\n", at)
                        labels, at = numbers(data, end + 1, count, words[2], text)
                label = np.zeros(len(points)) if labels is None else labels
                yield pd.DataFrame({"path": path, "id": range(len(points)), "x": points[:, 0], "y": points[:, 1], "z": points[:, 2], "label": label.astype("int64")})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(decode, "path string, id bigint, x double, y double, z double, label bigint")


def vtk_points_text(rows: list[tuple[float, float, float, int]]) -> str:
    """A legacy VTK text file of labelled points."""
    head = ["# vtk DataFile Version 2.0", "points", "ASCII", "DATASET POLYDATA", f"POINTS {len(rows)} float"]
    body = [" ".join(f"{x:g}" for x in r[:3]) for r in rows]
    return "\n".join([*head, *body, f"POINT_DATA {len(rows)}", "SCALARS pointLabels long 1", "LOOKUP_TABLE default", *[str(r[3]) for r in rows]]) + "\n"


def convert_points(spark: SparkSession, source: str, target: str, dim: int = 3) -> DataFrame:
    """Labelled points of a .vtk file or a text one, written as text."""
    df = read_vtk_points(spark, source).select(*AXES[:dim], "label") if source.endswith(".vtk") else read_points(spark, source, dim)
    write_points(df, target)
    return df


def write_components(df: DataFrame, path: str, columns: list[str]) -> None:
    """A vector image as one scalar image a component."""
    axes = [a for a in AXES if a in df.columns]
    for c in columns:
        df.select(*axes, F.col(c).alias("v")).write.mode("overwrite").parquet(f"{path}/{c}")


def read_components(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A vector image of its components' files, joined by cell."""
    out = None
    for c in columns:
        part = spark.read.parquet(f"{path}/{c}").withColumnRenamed("v", c)
        out = part if out is None else out.join(part, [a for a in AXES if a in part.columns])
    return out


def format_transforms(maps: list[list[list[float]]]) -> str:
    """A stack of affine maps in one text, in order."""
    body = [f"#Transform {i}\n" + format_transform(m).split("\n", 2)[2] for i, m in enumerate(maps)]
    return "#Insight Transform File V1.0\n" + "".join(body)


def parse_transforms(text: str) -> list[list[list[float]]]:
    """The stack of a text of several maps."""
    parts: list[list[str]] = []
    for line in text.splitlines():
        if line.startswith("#Transform"):
            parts.append([])
        elif parts and line:
            parts[-1].append(line)
    return [parse_transform("\n".join(p)) for p in parts]


def image_to_points(df: DataFrame, geometry: Geometry, fraction: float = 1.0, seed: int = 0) -> DataFrame:
    """The physical points of labelled cells, sampled by a seeded share."""
    rows = df.filter(F.col("label") != 0)
    rows = rows.sample(fraction=fraction, seed=seed) if fraction < 1 else rows
    return rows.select(*[p.alias(a) for a, p in zip(geometry.axes, geometry.physical(), strict=True)], "label")


def parse_transform(text: str) -> list[list[float]]:
    """The rows (entries, offset) of an affine transform in its text form: Parameters and FixedParameters (the centre) lines."""
    values = {}
    for line in text.splitlines():
        name, _, rest = line.partition(":")
        if name in ("Parameters", "FixedParameters"):
            values[name] = [float(x) for x in rest.split()]
    p, c = values["Parameters"], values.get("FixedParameters", [])
    n = len(c) or (3 if len(p) == 12 else 2)
    c = c or [0.0] * n
    m = [p[i * n : (i + 1) * n] for i in range(n)]
    return [[*row, p[n * n + i] + c[i] - sum(a * b for a, b in zip(row, c, strict=True))] for i, row in enumerate(m)]


def format_transform(m: list[list[float]]) -> str:
    n = len(m)
    p = [x for row in m for x in row[:n]] + [row[n] for row in m]
    return "#Insight Transform File V1.0\n#Transform 0\nTransform: AffineTransform_double_%d_%d\nParameters: %s\nFixedParameters: %s\n" % (n, n, " ".join(f"{x:.17g}" for x in p), " ".join("0" for _ in m))


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header of numbers only; every column a double, without a pass to infer types."""
    df = spark.read.csv(path, header=True)
    return df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in df.columns])


def write_matrix(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def read_image_list(spark: SparkSession, path: str) -> DataFrame:
    """(path) of each line that isn't blank."""
    return spark.read.text(path).select(F.trim("value").alias("path")).filter("path <> ''")
