"""Writers of the files that arrays.py reads: label sets as HDF5, tensor dictionaries as zip archives."""

from __future__ import annotations

import io
import pickle
import struct
import zipfile
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import NOWHERE, SIGNATURE

FILE_ROWS = 10_000  # rows of a file, which one task holds


def _message(kind: int, body: bytes) -> bytes:
    body = body.ljust(-(-len(body) // 8) * 8, b"\0")
    return struct.pack("<HHBxxx", kind, len(body), 0) + body


def _header(*messages: bytes) -> bytes:
    data = b"".join(messages)
    return struct.pack("<BxHIIxxxx", 1, len(messages), 1, len(data)) + data


def hdf5_file(values: np.ndarray, name: str = "labels", chunk: int | None = None) -> bytes:
    """One dataset of numbers in the root group, contiguous, or in deflated chunks of some rows."""
    values = np.ascontiguousarray(values)
    n, size = len(values), values.dtype.itemsize
    row = values.nbytes // max(n, 1)
    # Places: superblock, root header, heap and its names, tree, symbols, dataset header, data.
    root, heap, names, tree, leaf, header = 96, 136, 168, 200, 544, 1200
    text = b"\0" * 8 + name.encode() + b"\0"
    text = text.ljust(-(-len(text) // 8) * 8, b"\0")
    if len(text) > tree - names:
        raise ValueError("the name is too long")
    floats = values.dtype.kind == "f"
    if floats:
        bits = {2: (10, 5, 0, 10, 15), 4: (23, 8, 0, 23, 127), 8: (52, 11, 0, 52, 1023)}[size]
        kind = struct.pack("<BBBBIHHBBBBI", 0x11, 0x20, 8 * size - 1, 0, size, 0, 8 * size, bits[0], bits[1], bits[2], bits[3], bits[4])
    else:
        kind = struct.pack("<BBBBIHH", 0x10, 8 * (values.dtype.kind == "i"), 0, 0, size, 0, 8 * size)
    space = struct.pack("<BBBxxxxx", 1, values.ndim, 0) + struct.pack(f"<{values.ndim}Q", *values.shape)
    data = header + 512
    if chunk is None:
        layout, pipeline, rest = struct.pack("<BBQQ", 3, 1, data if n else NOWHERE, values.nbytes), [], values.tobytes()
    else:
        dims = (chunk, *values.shape[1:])
        layout = struct.pack(f"<BBBQ{len(dims) + 1}I", 3, 2, len(dims) + 1, data, *dims, size)
        pipeline = [_message(0x0B, struct.pack("<BBxxxxxx", 1, 2) + struct.pack("<HHHHII", 2, 0, 1, 1, size, 0) + struct.pack("<HHHHII", 1, 0, 1, 1, 6, 0))]
        packed = []
        for at in range(0, n, chunk):
            part = values[at : at + chunk].tobytes().ljust(chunk * row, b"\0")
            packed.append(zlib.compress(np.frombuffer(part, np.uint8).reshape(-1, size).T.tobytes()))
        key = 8 + 8 * (len(dims) + 1)
        place = data + 24 + len(packed) * (key + 8) + key
        rest, bodies = struct.pack("<4sBBHQQ", b"TREE", 1, 0, len(packed), NOWHERE, NOWHERE), b""
        for i, part in enumerate(packed):
            rest += struct.pack(f"<II{len(dims) + 1}Q", len(part), 0, i * chunk, *[0] * len(dims)) + struct.pack("<Q", place + len(bodies))
            bodies += part
        rest += struct.pack(f"<II{len(dims) + 1}Q", 0, 0, len(packed) * chunk, *[0] * len(dims)) + bodies
    end = data + len(rest)
    out = bytearray(data)
    out[:96] = SIGNATURE + struct.pack("<BBBxBBBxHHIQQQQ", 0, 0, 0, 0, 8, 8, 4, 16, 0, 0, NOWHERE, end, NOWHERE) + struct.pack("<QQIxxxxQQ", 0, root, 1, tree, heap)
    for at, body in (
        (root, _header(_message(0x11, struct.pack("<QQ", tree, heap)))),
        (heap, b"HEAP" + struct.pack("<BxxxQQQ", 0, len(text), 1, names)),
        (names, text),
        (tree, struct.pack("<4sBBHQQQQQ", b"TREE", 0, 0, 1, NOWHERE, NOWHERE, 0, leaf, 8)),
        (leaf, struct.pack("<4sBxH", b"SNOD", 1, 1) + struct.pack("<QQIxxxxxxxxxxxxxxxxxxxx", 8, header, 0)),
        (header, _header(_message(1, space), _message(3, kind), _message(8, layout), *pipeline)),
    ):
        out[at : at + len(body)] = body
    return bytes(out) + rest


class _Named:
    """Pickles as a global name."""

    def __init__(self, module: str, name: str):
        self.text = f"c{module}\n{name}\n".encode()


def _pickled(x) -> bytes:
    """Plain pickle of the few things that an index holds."""
    if isinstance(x, _Named):
        return x.text
    if isinstance(x, bool):
        return pickle.NEWTRUE if x else pickle.NEWFALSE
    if isinstance(x, int):
        return b"I%d\n" % x
    if isinstance(x, str):
        data = x.encode()
        return pickle.BINUNICODE + struct.pack("<I", len(data)) + data
    return pickle.MARK + b"".join(map(_pickled, x)) + pickle.TUPLE


def tensor_file(tensors: dict[str, np.ndarray], name: str = "archive") -> bytes:
    """A dictionary of float32 tensors: an index, and an entry for each tensor's numbers, as they are."""
    index, out = pickle.PROTO + b"\x02" + pickle.EMPTY_DICT + pickle.MARK, io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as archive:
        for i, (key, x) in enumerate(tensors.items()):
            x = np.ascontiguousarray(x, "<f4")
            storage = _pickled(("storage", _Named("torch", "FloatStorage"), str(i), "cpu", x.size)) + pickle.BINPERSID
            strides = tuple(s // 4 for s in x.strides)
            made = pickle.MARK + storage + b"".join(map(_pickled, (0, x.shape, strides, False))) + _Named("collections", "OrderedDict").text + pickle.EMPTY_TUPLE + pickle.REDUCE + pickle.TUPLE
            index += _pickled(key) + _Named("torch._utils", "_rebuild_tensor_v2").text + made + pickle.REDUCE
            archive.writestr(f"{name}/data/{i}", x.tobytes())
        archive.writestr(f"{name}/data.pkl", index + pickle.SETITEMS + pickle.STOP)
        archive.writestr(f"{name}/version", "3\n")
    return out.getvalue()


def label_files(labels: DataFrame, node: str = "node_id", label: str = "cluster_id", rows: int = FILE_ROWS, chunk: int | None = 1000) -> DataFrame:
    """(file, content): the labels of each `rows` nodes as an HDF5 file; nodes are numbered from 0 without gaps. A task
    holds the labels of one file."""

    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("n").to_numpy())
        return pa.table({"file": table.column("file").slice(0, 1), "content": pa.array([hdf5_file(table.column("l").to_numpy()[order], chunk=chunk)], pa.binary())})

    dealt = labels.select(F.floor(F.col(node) / rows).cast("long").alias("file"), F.col(node).cast("long").alias("n"), F.col(label).cast("int").alias("l"))
    return dealt.groupBy("file").applyInArrow(run, "file long, content binary")


def tensor_files(vectors: DataFrame, key: str = "node_id", v: str = "v", files: int = 8) -> DataFrame:
    """(file, content): the vectors dealt into `files` tensor dictionaries by a hash of their keys, in order of keys."""

    def run(table: pa.Table) -> pa.Table:
        keys, values = table.column("key").to_pylist(), table.column("v").to_pylist()
        held = {keys[i]: np.array(values[i], "<f4") for i in sorted(range(len(keys)), key=keys.__getitem__)}
        return pa.table({"file": table.column("file").slice(0, 1), "content": pa.array([tensor_file(held)], pa.binary())})

    dealt = vectors.select(F.pmod(F.xxhash64(key), F.lit(files)).cast("int").alias("file"), F.col(key).cast("string").alias("key"), F.col(v).alias("v"))
    return dealt.groupBy("file").applyInArrow(run, "file int, content binary")
