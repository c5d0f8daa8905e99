"""Map packages: sections of a map in one deflated file, as tables of (package, kind, content) and of field cells and tags.

packed() and unpacked() work on columns, so that Spark's own readers and writers carry the files:
unpacked(spark.read.format("binaryFile").load(path)). There is also a data source:
`spark.dataSource.register(MapPackageSource)`, then spark.read.format("map_package").load(path) gives (package, kind,
content), and write_packages() or df.write.format("map_package") takes such rows and writes one file a package. `path` is a
folder that the driver and all executors reach: a URI that pyarrow's file systems know, or a shared mount.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from dataclasses import dataclass
from urllib.parse import quote, unquote

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

# Fixed values of the format: magic, version, order of sections (files of before end after the fifth), all little-endian
# in a deflate stream without a header; a field cell is its index and six hundredths of uT; a tag ends in rssi and samples.
MAGIC, VERSION = b"HPMP", 1
KINDS = ("meta", "map", "field", "ble", "world", "paint", "tags", "direction")
CELL = np.dtype([("i", "<u4"), ("v", "<i2", 6)])


def encode(sections: dict[str, bytes]) -> bytes:
    body = MAGIC + struct.pack("<H", VERSION) + b"".join(struct.pack("<I", len(c)) + c for c in (sections.get(k, b"") for k in KINDS))
    z = zlib.compressobj(9, zlib.DEFLATED, -15)
    return z.compress(body) + z.flush()


def decode(blob: bytes) -> dict[str, bytes]:
    """The sections that aren't empty; a file of another magic or version, or cut short, is an error."""
    body = zlib.decompress(blob, -15)
    if body[:4] != MAGIC or struct.unpack_from("<H", body, 4)[0] != VERSION:
        raise ValueError("not a map package, or one of another version")
    out, at = {}, 6
    for kind in KINDS:
        if at == len(body) and kind in KINDS[5:]:
            break
        (n,) = struct.unpack_from("<I", body, at)
        if at + 4 + n > len(body):
            raise ValueError("a map package that is cut short")
        if n:
            out[kind] = body[at + 4 : at + 4 + n]
        at += 4 + n
    return out


def unpacked(files: DataFrame, key: str = "path") -> DataFrame:
    """(key, kind, content) of the sections of each file of (key, content)."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = [(k, kind, c) for k, blob in zip(pdf[key], pdf["content"], strict=True) for kind, c in decode(blob).items()]
            yield pd.DataFrame(rows, columns=[key, "kind", "content"])

    return files.select(key, "content").mapInPandas(run, f"`{key}` {files.schema[key].dataType.simpleString()}, kind string, content binary")


def packed(sections: DataFrame, key: str) -> DataFrame:
    """(key, content): one file a key from rows (key, kind, content), of which a key has at most one a kind."""
    blob = F.udf(lambda rows: encode({r["kind"]: bytes(r["content"]) for r in rows}), "binary", useArrow=True)
    one = sections.where(F.col("kind").isin(*KINDS)).groupBy(key).agg(F.collect_list(F.struct("kind", "content")).alias("s"))
    return one.select(key, blob("s").alias("content"))


VALUES = ("total", "vertical", "horizontal", "sigma_total", "sigma_vertical", "sigma_horizontal")


def field_section(cells: DataFrame, key: str, width: float, height: float, cell: float) -> DataFrame:
    """(key, kind, content): a map's cells (key, i, and VALUES; rows with a null are left out) as its field section."""

    def pack(rows):
        v = np.array([r[1:] for r in rows], float)
        out = np.zeros(len(rows), CELL)
        out["i"], out["v"] = [r[0] for r in rows], np.clip(np.trunc(v * 100 + np.copysign(0.5, v)), -32768, 32767)  # halves away from zero
        return struct.pack("<fffI", width, height, cell, len(rows)) + out.tobytes()

    row = F.struct(F.col("i").cast("bigint"), *[F.col(v).cast("double") for v in VALUES])
    one = cells.dropna(subset=["i", *VALUES]).groupBy(key).agg(F.sort_array(F.collect_list(row)).alias("c"))
    return one.select(key, F.lit("field").alias("kind"), F.udf(pack, "binary", useArrow=True)("c").alias("content"))


def field_cells(sections: DataFrame, key: str) -> DataFrame:
    """(key, row, col, and VALUES) of the field sections among (key, kind, content)."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for k, raw in zip(pdf[key], pdf["content"], strict=True):
                width, height, cell, n = struct.unpack_from("<fffI", raw)
                if not (width > 0 and height > 0 and cell > 0):
                    raise ValueError("a field without size")
                cols, rows = int(np.ceil(width / cell)), int(np.ceil(height / cell))
                got = np.frombuffer(raw, CELL, n, 16)
                if n and got["i"].max() >= cols * rows:
                    raise ValueError("a field cell beyond the map")
                at = got["i"].astype(np.int64)
                yield pd.DataFrame({key: k, "row": at // cols, "col": at % cols, **{v: got["v"][:, j] / 100 for j, v in enumerate(VALUES)}})

    kind = sections.schema[key].dataType.simpleString()
    return sections.where("kind = 'field'").select(key, "content").mapInPandas(run, f"`{key}` {kind}, row bigint, col bigint, " + ", ".join(f"{v} double" for v in VALUES))


def tag_section(tags: dict[str, tuple[float, float, float, int]], cell: float) -> bytes:
    """Tags (x cm, y cm, strongest rssi, samples) by id as a ble section."""
    out = [struct.pack("<fI", cell, len(tags))]
    for name, (x, y, rssi, n) in sorted(tags.items()):
        raw = name.encode()[:255]
        out.append(struct.pack("<B", len(raw)) + raw + struct.pack("<ffbH", x, y, max(-128, min(127, round(rssi))), min(n, 65_535)))
    return b"".join(out)


def tag_rows(raw: bytes) -> list[tuple[str, float, float, int, int]]:
    """(id, x, y, strongest rssi, samples) of a ble section."""
    (n,), at, out = struct.unpack_from("<I", raw, 4), 8, []
    for _ in range(n):
        size = raw[at]
        out.append((raw[at + 1 : at + 1 + size].decode(), *struct.unpack_from("<ffbH", raw, at + 1 + size)))
        at += 1 + size + 11
    return out


SUFFIX = ".lpkg"


def files_of(path: str):
    """(pyarrow file system, path in it)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def listed(path: str) -> list[str]:
    """The package files of a folder, or the one file that path names."""
    from pyarrow import fs

    store, at = files_of(path)
    info = store.get_file_info(at)
    if info.type == fs.FileType.File:
        return [at]
    return sorted(f.path for f in store.get_file_info(fs.FileSelector(at, allow_not_found=True)) if f.type == fs.FileType.File and f.path.endswith(SUFFIX))


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        return [InputPartition(f) for f in listed(self.path)]

    def read(self, partition):
        store, _ = files_of(self.path)
        with store.open_input_stream(partition.value) as f:
            sections = decode(f.read())
        name = unquote(partition.value.rsplit("/", 1)[-1].removesuffix(SUFFIX))
        for kind, content in sections.items():
            yield (name, kind, content)


@dataclass
class _Written(WriterCommitMessage):
    files: list[tuple[str, str]]  # (package, file as yet under another name)


class _Writer(DataSourceWriter):
    """A task writes each of its packages under a passing name; commit() names them, so a failed or repeated task leaves nothing half."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def write(self, rows):
        store, at = files_of(self.path)
        store.create_dir(at, recursive=True)
        done, name, sections = [], None, {}

        def close():
            file = f"{at}/.{uuid.uuid4().hex}.part"
            with store.open_output_stream(file) as f:
                f.write(encode(sections))
            done.append((name, file))

        for r in rows:
            if r.package is None or r.kind not in KINDS:
                raise ValueError(f"a section without a package, or of no known kind: {r.package}, {r.kind}")
            if r.package != name:
                if name is not None:
                    close()
                if any(r.package == n for n, _ in done):
                    raise ValueError(f"the sections of {r.package} don't lie together: use write_packages()")
                name, sections = r.package, {}
            if r.kind in sections:
                raise ValueError(f"{r.package} has two sections {r.kind}")
            sections[r.kind] = bytes(r.content or b"")
        if name is not None:
            close()
        return _Written(done)

    def commit(self, messages):
        files = [x for m in messages if m for x in m.files]
        names = [n for n, _ in files]
        twice = sorted({n for n in names if names.count(n) > 1}) if len(set(names)) < len(names) else []
        store, at = files_of(self.path)
        there = set(listed(self.path))
        target = {n: f"{at}/{quote(n, safe='')}{SUFFIX}" for n in names}
        taken = [n for n in names if target[n] in there] if not self.overwrite else []
        if twice or taken:
            self.abort(messages)
            raise ValueError(f"sections of one package lie in several partitions, use write_packages(): {twice[:5]}" if twice else f"already there: {taken[:5]}")
        for name, file in files:
            store.move(file, target[name])
        for old in there - set(target.values()) if self.overwrite else ():
            store.delete_file(old)

    def abort(self, messages):
        store, _ = files_of(self.path)
        for m in messages:
            for _, file in m.files if m else ():
                store.delete_file(file)


class MapPackageSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "map_package"

    def schema(self) -> str:
        return "package string, kind string, content binary"

    def reader(self, schema):
        return _Reader(self.options["path"])

    def writer(self, schema, overwrite):
        return _Writer(self.options["path"], overwrite)


def write_packages(sections: DataFrame, path: str, mode: str = "append") -> None:
    """Rows (package, kind, content) as one file a package; a package with two sections of a kind is an error, and so is one
    that is there already unless mode is overwrite, which leaves the new packages only."""
    sections.sparkSession.dataSource.register(MapPackageSource)
    rows = sections.select(F.col("package").cast("string"), "kind", "content")
    rows.repartition("package").sortWithinPartitions("package").write.format("map_package").mode(mode).save(path)
