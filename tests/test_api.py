import numpy as np
import pytest

from tidelog import api
from tidelog.operators import archive
from tidelog.sources.npz import save_entry

ONSET = 1_700_000_000_000_000


@pytest.fixture
def reader(spark, tmp_path):
    for package in [api.LogPackage(1, 0, np.frombuffer(ONSET.to_bytes(8, "little"), np.uint8))] + [api.LogPackage(1, (i + 1) * 1000, np.arange(i, i + 4, dtype=np.uint8)) for i in range(10)]:
        name, data = package.data
        save_entry(str(tmp_path), name.removesuffix(".npy"), data.tobytes())
    (path,) = api.assemble_log_archives(str(tmp_path))
    return api.LogArchiveReader(path)


def test_reading_an_archive(reader):
    assert reader.onset_timestamp_us == ONSET and reader.message_count == 10
    assert api.read_archive_message_count(reader.archive_path) == 10
    times, payloads = reader.read_all_messages()
    assert times.dtype == np.uint64 and times.tolist() == [ONSET + (i + 1) * 1000 for i in range(10)]
    assert [p.tolist() for p in payloads] == [list(range(i, i + 4)) for i in range(10)]
    keys = [reader.keys[3], reader.keys[0]]
    assert [m.timestamp_us for m in reader.iter_messages(keys)] == [ONSET + 4000, ONSET + 1000]
    assert reader.get_batches(workers=2) == [reader.keys]
    with pytest.raises(FileNotFoundError):
        api.LogArchiveReader("/none/1_log.npz")


def stored(source, time, payload=b""):
    return np.frombuffer(bytes([source]) + time.to_bytes(8, "little") + payload, np.uint8)


def test_members_of_other_names(spark, tmp_path):
    path = str(tmp_path / "nonstandard.npz")
    onset = stored(1, 0, ONSET.to_bytes(8, "little"))
    np.savez(path, onset_message=onset, **{f"001_{(k + 1) * 1000:020d}": stored(1, (k + 1) * 1000, bytes([k])) for k in range(3)})
    given = api.LogArchiveReader(path, onset_us=ONSET)
    assert len(given.keys) == given.message_count == 4
    found = api.LogArchiveReader(path)
    assert found.onset_timestamp_us == ONSET and found.message_count == 3
    assert [m.timestamp_us for m in found.iter_messages()] == [ONSET + (k + 1) * 1000 for k in range(3)]
    assert api.read_archive_message_count(path) == 4  # no name is an onset's
    np.savez(path, b=stored(1, 5), a=stored(1, 4))
    with pytest.raises(ValueError, match="onset"):
        _ = api.LogArchiveReader(path).keys


def test_what_lies_before_the_onset_is_no_message(spark, tmp_path):
    path = str(tmp_path / "1_log.npz")
    key = "001_{:020d}".format
    members = {key(7): stored(1, 7, b"a"), key(0): stored(1, 0, ONSET.to_bytes(8, "little")), key(9): stored(1, 9, b"b"), key(3): stored(1, 3, b"c"), "again": stored(1, 0, b"d")}
    np.savez(path, **members)
    reader = api.LogArchiveReader(path)
    assert reader.keys == [key(9), key(3), "again"] and reader.message_count == 3
    times, payloads = reader.read_all_messages()
    assert times.tolist() == [ONSET + 9, ONSET + 3, ONSET] and [p.tobytes() for p in payloads] == [b"b", b"c", b"d"]
    assert api.LogArchiveReader(path, onset_us=5).keys == reader.keys
    rows = archive.messages(archive.as_packages(archive.read_archive(spark, path)))
    assert sorted((int(r.timestamp_us), bytes(r.payload)) for r in rows.collect()) == [(ONSET, b"d"), (ONSET + 3, b"c"), (ONSET + 9, b"b")]


def test_packages():
    name, data = api.LogPackage(7, 1234567890, np.array([10, 20, 30, 255], np.uint8)).data
    assert (name, data.tobytes().hex()) == ("007_00000000001234567890.npy", "07d2029649000000000a141eff")
    assert api.LogPackage(1, 2**63 + 5, np.array([True, False])).data[1].tolist()[-2:] == [1, 0]
    for bad in (np.array([1.0]), np.array([1])):
        with pytest.raises(TypeError):
            _ = api.LogPackage(1, 1, bad).data


def test_series(spark):
    x, v = np.arange(4.0), np.array([0, 127, 200, 255], np.uint8)
    out = api.interpolate_data(x, v, np.array([0.5, 1.5, 2.5]), is_discrete=True)
    assert out.dtype == np.uint8 and out.tolist() == [0, 127, 200]
    assert api.interpolate_data(x, v, np.array([0.5, 9]), is_discrete=False).tolist() == [63.5, 255.0]
    with pytest.raises(ValueError):
        api.interpolate_data(np.array([]), v, x, is_discrete=True)


def test_paths(spark, tmp_path):
    for k in range(2):
        (tmp_path / f"animal_{k}/s/raw").mkdir(parents=True)
        (tmp_path / f"animal_{k}/s/raw/m.yaml").write_text(str(k))
    assert api.discover_marker_roots(str(tmp_path), "m.yaml", 1) == [str(tmp_path / f"animal_{k}/s") for k in range(2)]
    assert len(api.walk_directory(str(tmp_path))) == 8 and len(api.walk_files(str(tmp_path))) == 2
    assert api.resolve_unique_roots(["/d/one/s1/x", "/d/two/s2/x"]) == ("/d/one/s1", "/d/two/s2")
    with pytest.raises(ValueError):
        api.resolve_unique_roots(["/d/x", "/d/x"])
    one = api.calculate_directory_checksum(str(tmp_path))
    api.transfer_directory(str(tmp_path / "animal_0"), str(tmp_path / "copy"), verify_integrity=True)
    assert api.calculate_directory_checksum(str(tmp_path)) != one
