"""Label sets and tensor dictionaries, written and read."""

import io
import pickle
import struct
import zipfile

import numpy as np
import pytest

from vexel.sources import arrays, array_files


def read(data, path="labels", start=0, stop=1 << 60):
    f = arrays.Hdf5(io.BytesIO(data))
    return f.rows(f.dataset(path), start, stop)


@pytest.mark.parametrize("kind", ["<i4", "<i8", "<u1", "<f4", "<f8", "<i2"])
@pytest.mark.parametrize("chunk", [None, 7, 100])
def test_hdf5_layouts(kind, chunk):
    x = (np.arange(60) * 3 - 20).astype(kind)
    data = array_files.hdf5_file(x, chunk=chunk)
    assert read(data).tolist() == x.tolist()
    assert [read(data, start=a, stop=b).tolist() for a, b in ((0, 1), (6, 8), (59, 90), (30, 30))] == [x[a:b].tolist() for a, b in ((0, 1), (6, 8), (59, 90), (30, 30))]
    two = np.arange(40).reshape(10, 4).astype(kind)
    assert read(array_files.hdf5_file(two, "m", chunk), "/m").tolist() == two.tolist()
    assert read(array_files.hdf5_file(x[:0], chunk=chunk)).tolist() == []


def newer_file(x):
    """Superblock 2, headers of the newer form with a link and a continuation, a compact dataset."""

    def header(*messages, flags=0):
        body = b"".join(struct.pack("<BHB", k, len(b), 0) + b for k, b in messages)
        return b"OHDR" + bytes([2, flags | 1]) + struct.pack("<H", len(body)) + body + b"\0" * 4

    def link(name, at):
        return 0x06, b"\x01\x00" + bytes([len(name)]) + name + struct.pack("<Q", at)

    kind = struct.pack("<BBBBIHH", 0x10, 8, 0, 0, 4, 0, 32)
    space = struct.pack("<BBBB", 2, 1, 0, 1) + struct.pack("<Q", len(x))
    data = x.astype("<i4").tobytes()
    group, dataset, more = 300, 500, 700
    out = bytearray(2000)
    out[:48] = arrays.SIGNATURE + struct.pack("<BBBBQQQQ", 2, 8, 8, 0, 0, arrays.NOWHERE, 2000, 100) + b"\0" * 4
    rest = b"OCHK" + struct.pack("<BHB", 0x08, 4 + len(data), 0) + struct.pack("<BBH", 3, 0, len(data)) + data + b"\0" * 4
    for at, body in ((100, header(link(b"other", 999), link(b"group", group))), (group, header(link(b"labels", dataset))), (dataset, header((0x01, space), (0x03, kind), (0x10, struct.pack("<QQ", more, len(rest))))), (more, rest)):
        out[at : at + len(body)] = body
    return bytes(out)


def test_newer_hdf5_files():
    x = np.array([5, -1, 7, 7])
    assert read(newer_file(x), "group/labels").tolist() == x.tolist()
    with pytest.raises(arrays.Unsupported):
        read(newer_file(x), "group/nothing")


def test_broken_hdf5_files():
    data = array_files.hdf5_file(np.arange(50, dtype="<i4"), chunk=10)
    for bad in (b"", b"text that is no such file", data[:60], data[:1250], data[:-3]):
        with pytest.raises(arrays.Unsupported):
            read(bad)
    with pytest.raises(arrays.Unsupported):
        read(data, "other")


def test_tensor_dictionaries():
    given = {"b": np.arange(6, dtype="f4").reshape(2, 3), "a": np.array([1.5], "f4"), "none": np.zeros((0, 4), "f4")}
    data = array_files.tensor_file(given)
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        folder, index = arrays.tensor_index(z)
        assert list(index) == ["b", "a", "none"]
        assert all(arrays.tensor_values(z, folder, index[k]).tolist() == v.tolist() for k, v in given.items())


def archive(index, entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("x/data.pkl", index)
        for k, v in entries.items():
            z.writestr(f"x/data/{k}", v)
    return io.BytesIO(out.getvalue())


def test_views_share_a_storage_and_nothing_is_run():
    def tensor(first, shape, strides):
        s = array_files._pickled(("storage", array_files._Named("torch", "LongStorage"), "0", "cpu", 6)) + pickle.BINPERSID
        rest = b"".join(map(array_files._pickled, (first, shape, strides, False)))
        return array_files._Named("torch._utils", "_rebuild_tensor_v2").text + pickle.MARK + s + rest + pickle.EMPTY_DICT + pickle.TUPLE + pickle.REDUCE

    def dictionary(value):
        return pickle.PROTO + b"\x02" + pickle.EMPTY_DICT + pickle.MARK + array_files._pickled("k") + value + pickle.SETITEMS + pickle.STOP

    numbers = {"0": np.arange(6, dtype="<i8").tobytes()}
    for first, shape, strides, want in ((0, (2, 3), (3, 1), [[0, 1, 2], [3, 4, 5]]), (1, (2,), (3,), [1, 4]), (0, (3, 2), (1, 3), [[0, 3], [1, 4], [2, 5]])):
        with zipfile.ZipFile(archive(dictionary(tensor(first, shape, strides)), numbers)) as z:
            folder, index = arrays.tensor_index(z)
            assert arrays.tensor_values(z, folder, index["k"]).tolist() == want
    with zipfile.ZipFile(archive(dictionary(tensor(4, (5,), (1,))), numbers)) as z, pytest.raises(arrays.Unsupported):
        folder, index = arrays.tensor_index(z)
        arrays.tensor_values(z, folder, index["k"])
    harm = array_files._Named("os", "system").text + pickle.MARK + array_files._pickled("touch /tmp/never") + pickle.TUPLE + pickle.REDUCE
    for bad in (dictionary(harm), dictionary(array_files._pickled(5)), b"\x80\x02", pickle.dumps([1])):
        with zipfile.ZipFile(archive(bad, {})) as z, pytest.raises(arrays.Unsupported):
            arrays.tensor_index(z)


def test_sources_over_files_and_ranges(spark, tmp_path):
    arrays.register(spark)
    x = {"a": np.arange(1000) % 7, "b": np.arange(30) - 5}
    for name, v in x.items():
        (tmp_path / f"{name}.h5").write_bytes(array_files.hdf5_file(v.astype("<i4"), chunk=64))
    (tmp_path / "notes.txt").write_text("none")
    df = spark.read.format("hdf5").option("range", "300").load(f"{tmp_path}/*.h5")
    assert df.rdd.getNumPartitions() > 4
    found = {}
    for r in sorted(df.collect()):
        found.setdefault(r.file.rsplit("/", 1)[1][0], []).append((r.node_id, r.label))
    assert found == {k: list(enumerate(v.tolist())) for k, v in x.items()}
    assert spark.read.format("hdf5").load(f"file://{tmp_path}/b.h5").count() == 30
    held = {f"v{i}": np.full(3, i, "f4") for i in range(50)}
    (tmp_path / "t.torch").write_bytes(array_files.tensor_file(held))
    rows = sorted(spark.read.format("tensors").option("range", "2000").load(f"{tmp_path}/t.torch").collect(), key=lambda r: r.position)
    assert [(r.key, r.shape, r.v) for r in rows] == [(k, [3], v.tolist()) for k, v in held.items()]
    with pytest.raises(Exception, match="HDF5"):
        spark.read.format("hdf5").load(f"{tmp_path}/t.torch").collect()


def test_bytes_in_rows(spark):
    labels = spark.createDataFrame([(i, i % 5) for i in range(2500)], "node_id long, cluster_id int").repartition(4)
    files = array_files.label_files(labels, rows=1000, chunk=300)
    found = sorted((int(r.file) * 1000 + r.node_id, r.label) for r in arrays.labels_in(files, "file").collect())
    assert found == [(i, i % 5) for i in range(2500)]
    none = spark.createDataFrame([("x", None)], "path string, content binary")
    assert arrays.labels_in(none).collect() == [] and arrays.tensors_in(none).collect() == []
