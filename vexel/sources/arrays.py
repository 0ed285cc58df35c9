"""Label sets of HDF5 files and tensor dictionaries of zip archives, as data sources of Spark.

Both are read by place: a task opens a file, reads what says where its rows are, and then these rows only. Files are
dealt into ranges of rows by their size, so a large one is several tasks'. Nothing in a file is run: the pickled index
of a tensor dictionary may name a few known things, which stand for places and shapes, and nothing else.

    arrays.register(spark)
    spark.read.format("hdf5").option("dataset", "labels").load("file:///data/*.h5")
    spark.read.format("tensors").load("/data/videos.torch")

Paths go to pyarrow's file systems (local, hdfs, s3, gs). For others, Spark's reader of binary files gives the bytes for
labels_in() and tensors_in().
"""

from __future__ import annotations

import fnmatch
import io
import math
import pickle
import struct
import zipfile
import zlib
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RANGE = 64 << 20  # bytes of a file for each task
BATCH = 8192  # rows handed on at once
SIGNATURE = b"\x89HDF\r\n\x1a\n"  # fixed value
NOWHERE = (1 << 64) - 1


class Unsupported(ValueError):
    """A file that isn't one of these, is broken, or uses what this reader doesn't know."""


def _at(f, place: int, n: int) -> bytes:
    f.seek(place)
    out = f.read(n)
    if len(out) != n:
        raise Unsupported(f"the file ends before {place + n}")
    return out


def _ints(f, place: int, form: str) -> tuple:
    return struct.unpack(f"<{form}", _at(f, place, struct.calcsize(f"<{form}")))


@dataclass
class Dataset:
    """Where a dataset's numbers are."""

    shape: tuple[int, ...] = ()
    kind: np.dtype | None = None
    place: int | None = None  # of contiguous ones
    inline: bytes | None = None
    tree: int | None = None  # of chunks
    chunk: tuple[int, ...] = ()
    filters: list[tuple[int, list[int]]] = field(default_factory=list)


class Hdf5:
    """Datasets of an HDF5 file: groups of either form, numbers in contiguous, compact and chunked layout with a tree of
    chunks, and the filters deflate, shuffle and checksum."""

    def __init__(self, f):
        self.f = f
        head = _at(f, 0, 9)
        if head[:8] != SIGNATURE:
            raise Unsupported("no HDF5 file")
        if head[8] in (0, 1):
            at = 24 if head[8] == 0 else 28
            if _at(f, 13, 2) != b"\x08\x08":
                raise Unsupported("addresses of another width than 8")
            self.base = _ints(f, at, "Q")[0]
            self.root = _ints(f, at + 40, "Q")[0]
        elif head[8] in (2, 3):
            if _at(f, 9, 2) != b"\x08\x08":
                raise Unsupported("addresses of another width than 8")
            self.base = _ints(f, 12, "Q")[0]
            self.root = _ints(f, 36, "Q")[0]
        else:
            raise Unsupported(f"superblock {head[8]}")

    def messages(self, at: int) -> Iterator[tuple[int, bytes]]:
        """(kind, body) of an object's header messages."""
        at += self.base
        if _at(self.f, at, 4) == b"OHDR":
            flags = _at(self.f, at + 5, 1)[0]
            at += 6 + (16 if flags & 0x20 else 0) + (4 if flags & 0x10 else 0)
            wide = 1 << (flags & 3)
            todo = [(at + wide, int.from_bytes(_at(self.f, at, wide), "little"))]
            lead, head = (6 if flags & 4 else 4), "BHB"
        else:
            version, _, _, _, size = _ints(self.f, at, "BBHII")
            if version != 1:
                raise Unsupported(f"object header {version}")
            todo, lead, head = [(at + 16, size)], 8, "HHB"
        for start, size in todo:
            if size > 1 << 26:
                raise Unsupported("object header too large")
            data, i = _at(self.f, start, size), 0
            while i + lead <= size:
                kind, n, _ = struct.unpack_from(f"<{head}", data, i)
                body = data[i + lead : i + lead + n]
                i += lead + n
                if kind == 0x10:
                    place, length = struct.unpack("<QQ", body[:16])
                    if len(todo) > 1000:
                        raise Unsupported("object header without end")
                    new = head == "BHB"  # such a block has a signature and a checksum
                    todo.append((place + self.base + 4 * new, length - 8 * new))
                else:
                    yield kind, body

    def children(self, at: int) -> Iterator[tuple[str, int]]:
        """(name, place of the header) of a group's members."""
        for kind, body in self.messages(at):
            if kind == 0x11:
                tree, heap = struct.unpack("<QQ", body[:16])
                names = _ints(self.f, heap + self.base + 24, "Q")[0] + self.base
                for leaf in self._leaves(tree, 0):
                    (n,) = _ints(self.f, leaf + self.base + 6, "H")
                    for k in range(n):
                        name, header = _ints(self.f, leaf + self.base + 8 + 40 * k, "QQ")
                        yield self._text(names + name), header
            elif kind == 0x06:
                flags, i = body[1], 2
                link = body[i] if flags & 8 else 0
                i += (1 if flags & 8 else 0) + (8 if flags & 4 else 0) + (1 if flags & 16 else 0)
                wide = 1 << (flags & 3)
                n = int.from_bytes(body[i : i + wide], "little")
                i += wide
                if link == 0:
                    yield body[i : i + n].decode(), struct.unpack_from("<Q", body, i + n)[0]

    def _text(self, at: int) -> str:
        out = b""
        while b"\0" not in out:
            self.f.seek(at + len(out))
            part = self.f.read(64)
            if not part or len(out) > 1 << 16:
                raise Unsupported("a name without end")
            out += part
        return out.partition(b"\0")[0].decode()

    def _leaves(self, at: int, keys: int, depth: int = 0) -> Iterator[int]:
        """What the leaves of a tree point to; of a chunk tree (keys > 0) the places of the keys, too."""
        signature, kind, level, n = _ints(self.f, at + self.base, "4sBBH")
        if signature != b"TREE" or depth > 60:
            raise Unsupported("broken tree")
        size = (8 + 8 * keys) if keys else 8
        for k in range(n):
            key = at + self.base + 24 + k * (size + 8)
            (to,) = _ints(self.f, key + size, "Q")
            if level:
                yield from self._leaves(to, keys, depth + 1)
            else:
                yield (key, to) if keys else to

    def dataset(self, path: str) -> Dataset:
        at = self.root
        for name in filter(None, path.split("/")):
            at = dict(self.children(at)).get(name)
            if at is None:
                raise Unsupported(f"no {path}")
        d = Dataset()
        for kind, body in self.messages(at):
            if kind == 0x01:
                lead = 8 if body[0] == 1 else 4
                d.shape = struct.unpack_from(f"<{body[1]}Q", body, lead)
            elif kind == 0x03:
                d.kind = self._kind(body)
            elif kind == 0x08:
                self._layout(d, body)
            elif kind == 0x0B:
                d.filters = self._filters(body)
        if d.kind is None or not d.shape:
            raise Unsupported(f"{path} is no array of numbers")
        return d

    @staticmethod
    def _kind(body: bytes) -> np.dtype:
        what, bits, size = body[0] & 15, body[1], struct.unpack_from("<I", body, 4)[0]
        order = ">" if bits & 1 else "<"
        if what == 0 and size in (1, 2, 4, 8):
            return np.dtype(f"{order}{'i' if bits & 8 else 'u'}{size}")
        if what == 1 and size in (2, 4, 8):
            return np.dtype(f"{order}f{size}")
        raise Unsupported("numbers of a kind that isn't known")

    @staticmethod
    def _layout(d: Dataset, body: bytes) -> None:
        if body[0] not in (3, 4) or body[0] == 4 and body[1] == 2:
            raise Unsupported(f"layout {body[0]}")
        if body[1] == 0:
            (n,) = struct.unpack_from("<H", body, 2)
            d.inline = body[4 : 4 + n]
        elif body[1] == 1:
            d.place = struct.unpack_from("<Q", body, 2)[0]
        else:
            n = body[2]
            d.tree, d.chunk = struct.unpack_from("<Q", body, 3)[0], struct.unpack_from(f"<{n - 1}I", body, 11)

    @staticmethod
    def _filters(body: bytes) -> list[tuple[int, list[int]]]:
        out, i = [], 8 if body[0] == 1 else 2
        for _ in range(body[1]):
            (which,) = struct.unpack_from("<H", body, i)
            named = body[0] == 1 or which >= 256
            name = struct.unpack_from("<H", body, i + 2)[0] if named else 0
            i += 4 if named else 2
            n = struct.unpack_from("<H", body, i + 2)[0]
            i += 4 + (-(-name // 8) * 8 if body[0] == 1 else name)
            out.append((which, list(struct.unpack_from(f"<{n}I", body, i))))
            i += 4 * n + (4 if body[0] == 1 and n % 2 else 0)
        return out

    def rows(self, d: Dataset, start: int, stop: int) -> np.ndarray:
        """The rows from start to stop, of the chunks that hold them only."""
        start, stop = max(0, start), min(stop, d.shape[0])
        shape = (max(0, stop - start), *d.shape[1:])
        size = d.kind.itemsize * math.prod(d.shape[1:])
        if d.inline is not None:
            return np.frombuffer(d.inline[start * size : start * size + math.prod(shape) * d.kind.itemsize], d.kind).reshape(shape)
        out = np.zeros(shape, d.kind)  # what was never written is 0
        if d.tree is None:
            if d.place not in (None, NOWHERE) and out.size:
                out = np.frombuffer(_at(self.f, d.place + self.base + start * size, out.nbytes), d.kind).reshape(shape)
            return out
        if d.tree == NOWHERE:
            return out
        for key, to in self._leaves(d.tree, len(d.chunk) + 1):
            n, mask, *offset = _ints(self.f, key, f"II{len(d.chunk)}Q")
            low, high = max(start, offset[0]), min(stop, offset[0] + d.chunk[0])
            if low >= high:
                continue
            chunk = self._chunk(d, _at(self.f, to + self.base, n), mask)
            held = [slice(o, min(o + c, s)) for o, c, s in zip(offset[1:], d.chunk[1:], d.shape[1:])]
            part = tuple(slice(0, h.stop - h.start) for h in held)
            out[(slice(low - start, high - start), *held)] = chunk[(slice(low - offset[0], high - offset[0]), *part)]
        return out

    @staticmethod
    def _chunk(d: Dataset, data: bytes, mask: int) -> np.ndarray:
        for i, (which, _) in reversed(list(enumerate(d.filters))):
            if mask >> i & 1:
                continue
            if which == 1:
                data = zlib.decompress(data)
            elif which == 2:
                n = len(data) // d.kind.itemsize
                data = np.frombuffer(data, np.uint8)[: n * d.kind.itemsize].reshape(d.kind.itemsize, n).T.tobytes()
            elif which == 3:
                data = data[:-4]
            else:
                raise Unsupported(f"filter {which}")
        return np.frombuffer(data, d.kind, math.prod(d.chunk)).reshape(d.chunk)


#: Names of storages, with the numbers that they hold.
STORAGES = {"FloatStorage": "<f4", "DoubleStorage": "<f8", "HalfStorage": "<f2", "LongStorage": "<i8", "IntStorage": "<i4", "ShortStorage": "<i2", "CharStorage": "i1", "ByteStorage": "u1"}


@dataclass
class Tensor:
    """Where a tensor is: its storage's entry in the archive, first place, shape and strides, in numbers."""

    kind: np.dtype
    entry: str
    first: int
    shape: tuple[int, ...]
    strides: tuple[int, ...]


class _Index(pickle.Unpickler):
    """Reads the index of a tensor dictionary. The names that it may hold are those below; any other is an error, so
    nothing of a file is run."""

    def find_class(self, module: str, name: str):
        if module == "torch._utils" and name in ("_rebuild_tensor_v2", "_rebuild_tensor"):
            return lambda storage, first, shape, strides, *_: Tensor(*storage, first, tuple(shape), tuple(strides))
        if module == "torch._utils" and name == "_rebuild_parameter":
            return lambda tensor, *_: tensor
        if module == "torch" and name in STORAGES:
            return np.dtype(STORAGES[name])
        if module == "collections" and name == "OrderedDict":
            return OrderedDict
        raise Unsupported(f"the index names {module}.{name}")

    def persistent_load(self, pid):
        what, kind, key, *_ = pid
        if what != "storage" or not isinstance(kind, np.dtype):
            raise Unsupported("the index holds no tensors")
        return kind, str(key)


def tensor_index(archive: zipfile.ZipFile) -> tuple[str, dict[str, Tensor]]:
    """The folder of the archive, and its tensors by key, in order."""
    name = next((n for n in archive.namelist() if n.endswith("/data.pkl")), None)
    if name is None:
        raise Unsupported("no tensor archive")
    try:
        found = _Index(io.BytesIO(archive.read(name))).load()
    except (pickle.UnpicklingError, EOFError, TypeError, AttributeError, IndexError, KeyError) as e:
        raise Unsupported(f"the index can't be read: {e}") from e
    if not isinstance(found, dict) or not all(isinstance(t, Tensor) for t in found.values()):
        raise Unsupported("the archive holds no dictionary of tensors")
    return name[: -len("data.pkl")], {str(k): t for k, t in found.items()}


def tensor_values(archive: zipfile.ZipFile, folder: str, t: Tensor) -> np.ndarray:
    """A tensor's numbers, reading no more of its storage than from its first to its last."""
    if 0 in t.shape:
        return np.zeros(t.shape, t.kind)
    last = t.first + sum((n - 1) * s for n, s in zip(t.shape, t.strides)) + 1
    with archive.open(f"{folder}data/{t.entry}") as f:
        f.seek(t.first * t.kind.itemsize)
        data = f.read((last - t.first) * t.kind.itemsize)
    if len(data) != (last - t.first) * t.kind.itemsize or min(t.strides, default=0) < 0:
        raise Unsupported("a tensor reaches beyond its storage")
    flat = np.frombuffer(data, t.kind)
    return np.lib.stride_tricks.as_strided(flat, t.shape, [s * t.kind.itemsize for s in t.strides], writeable=False)


LABELS, TENSORS = "file string, node_id long, label long", "file string, key string, position long, shape array<long>, v array<double>"


def _label_batches(f, name: str, dataset: str, part: int = 0, parts: int = 1) -> Iterator[pa.RecordBatch]:
    h = Hdf5(f)
    d = h.dataset(dataset)
    low, high = (d.shape[0] * p // parts for p in (part, part + 1))
    for at in range(low, high, BATCH):
        x = h.rows(d, at, min(at + BATCH, high)).reshape(-1)
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(x), pa.string()), pa.array(np.arange(at, at + len(x))), pa.array(x.astype(np.int64))], ["file", "node_id", "label"])


def _tensor_batches(f, name: str, part: int = 0, parts: int = 1) -> Iterator[pa.RecordBatch]:
    with zipfile.ZipFile(f) as archive:
        folder, index = tensor_index(archive)
        keys = list(index)
        low, high = (len(keys) * p // parts for p in (part, part + 1))
        for at in range(low, high, 256):
            some = keys[at : min(at + 256, high)]
            values = [tensor_values(archive, folder, index[k]).astype(float).ravel() for k in some]
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(some), pa.string()), pa.array(some, pa.string()), pa.array(np.arange(at, at + len(some))), pa.array([list(index[k].shape) for k in some], pa.list_(pa.int64())), pa.array(values, pa.list_(pa.float64()))],
                ["file", "key", "position", "shape", "v"],
            )


@dataclass
class Range(InputPartition):
    """Part `part` of `parts` of a file's rows."""

    path: str
    part: int
    parts: int


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("/") else (fs.LocalFileSystem(), path)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self):
        """A part for each RANGE bytes of each file of a folder or of a pattern in a folder; other files aren't opened."""
        from pyarrow import fs

        given = self.options["path"]
        scheme = given.split("://", 1)[0] + "://" if "://" in given else ""
        store, path = _store(given.rsplit("/", 1)[0] if "*" in given.rsplit("/", 1)[-1] else given)
        pattern = given.rsplit("/", 1)[-1] if "*" in given.rsplit("/", 1)[-1] else "*"
        info = store.get_file_info(path)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(given)
        files = [info] if info.type == fs.FileType.File else [i for i in store.get_file_info(fs.FileSelector(path)) if i.type == fs.FileType.File and fnmatch.fnmatch(i.base_name, pattern) and i.base_name[0] not in "._"]
        out = []
        for i in sorted(files, key=lambda i: i.path):
            parts = max(1, -(-i.size // int(self.options.get("range", RANGE))))
            out += [Range(scheme + i.path, k, parts) for k in range(parts)]
        return out

    def read(self, partition: Range):
        store, path = _store(partition.path)
        with store.open_input_file(path) as f:
            yield from self.rows(f, partition)


class _Labels(_Reader):
    def rows(self, f, p: Range):
        return _label_batches(f, p.path, self.options.get("dataset", "labels"), p.part, p.parts)


class _Tensors(_Reader):
    def rows(self, f, p: Range):
        return _tensor_batches(f, p.path, p.part, p.parts)


class Hdf5Source(DataSource):
    """Rows (file, node_id, label) of a one-dimensional dataset of whole numbers; option dataset, "labels" by default."""

    @classmethod
    def name(cls):
        return "hdf5"

    def schema(self):
        return LABELS

    def reader(self, schema):
        return _Labels(self.options)


class TensorSource(DataSource):
    """Rows (file, key, position, shape, v) of tensor dictionaries; v are a tensor's numbers in order."""

    @classmethod
    def name(cls):
        return "tensors"

    def schema(self):
        return TENSORS

    def reader(self, schema):
        return _Tensors(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Hdf5Source)
    spark.dataSource.register(TensorSource)


def _inline(files: DataFrame, name: str, content: str, batches, schema: str) -> DataFrame:
    def run(given):
        for batch in given:
            for n, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                if x.is_valid:
                    yield from batches(io.BytesIO(x.as_py()), n)

    return files.select(files[name].cast("string"), content).mapInArrow(run, schema)


def labels_in(files: DataFrame, name: str = "path", content: str = "content", dataset: str = "labels") -> DataFrame:
    """(file, node_id, label) of HDF5 files given as bytes; null bytes give no rows, broken ones are an error."""
    return _inline(files, name, content, lambda f, n: _label_batches(f, n, dataset), LABELS)


def tensors_in(files: DataFrame, name: str = "path", content: str = "content") -> DataFrame:
    """(file, key, position, shape, v) of tensor dictionaries given as bytes."""
    return _inline(files, name, content, _tensor_batches, TENSORS)
