import enum
import importlib.machinery
import os
import sys
import types
from dataclasses import dataclass, field
from pathlib import Path

import numpy as np
import pytest
import yaml
from pyspark.sql import functions as F

from tidelog import runtime
from tidelog.operators import arrays, config, discovery, integrity
from tidelog.operators.transfer import delete_directory, transfer_directory


class Colour(enum.StrEnum):
    RED = "red"


class Level(enum.IntEnum):
    LOW = 1


@dataclass
class Inner:
    a: int = 1


@dataclass
class Config(config.YamlConfig):
    name: str = "n"
    path: Path = Path("/x/y")
    maybe: Path | None = None
    paths: list[Path] = field(default_factory=lambda: [Path("p")])
    colour: Colour = Colour.RED
    level: Level = Level.LOW
    pair: tuple[int, str] = (1, "a")
    many: tuple[Path, ...] = (Path("q"),)
    inner: Inner = field(default_factory=Inner)
    either: str | Colour = Colour.RED
    table: dict[Colour, Inner] = field(default_factory=lambda: {Colour.RED: Inner(3)})
    hidden: str = field(default="kept out", metadata=config.EXCLUDE)


def test_config_round_trip(tmp_path):
    written = Config(maybe=Path("m"), hidden="other")
    written.to_yaml(tmp_path / "c.yaml")
    text = (tmp_path / "c.yaml").read_text()
    assert text.startswith("---") and text.rstrip().endswith("...") and "hidden" not in text
    back = Config.from_yaml(tmp_path / "c.yaml")
    assert back == Config(maybe=Path("m")) and isinstance(back.table[Colour.RED], Inner) and back.either is Colour.RED
    assert os.listdir(tmp_path) == ["c.yaml"]
    for bad in ("", "- 1\n", "3\n"):
        (tmp_path / "bad.yml").write_text(bad)
        with pytest.raises(ValueError):
            Config.from_yaml(tmp_path / "bad.yml")
    for call in (written.to_yaml, Config.from_yaml):
        with pytest.raises(ValueError):
            call(tmp_path / "c.json")
    kinds = {f.name: f.dataType.simpleString() for f in config.struct_of(Config)}
    assert kinds["paths"] == "array<string>" and kinds["level"] == "bigint" and kinds["table"] == "map<string,struct<a:bigint>>"


@pytest.fixture
def tree(tmp_path):
    top = tmp_path / "top"
    for rel in ("a.txt", "sub/b.txt", "sub/deep/c.txt", "_x/d.txt", ".hid"):
        (top / rel).parent.mkdir(parents=True, exist_ok=True)
        (top / rel).write_text(rel)
    return top


def test_walk_and_links(spark, tree):
    (tree / "to_file").symlink_to(tree / "a.txt")
    (tree / "to_dir").symlink_to(tree / "sub")
    (tree / "dangling").symlink_to(tree / "none")
    (tree / "loop").symlink_to(tree / "loop")
    rows = {r.rel_path: r for r in discovery.walk_directory(spark, str(tree)).collect()}
    assert set(rows) == {"a.txt", "sub", "sub/b.txt", "sub/deep", "sub/deep/c.txt", "_x", "_x/d.txt", ".hid", "to_file", "to_dir", "dangling", "loop"}
    assert {r: rows[r].kind for r in ("to_file", "to_dir", "dangling", "loop", "sub")} == {"to_file": "file", "to_dir": "dir", "dangling": "link", "loop": "link", "sub": "dir"}
    assert rows["sub/deep/c.txt"].depth == 3
    files = {r.rel_path for r in discovery.walk_files(spark, str(tree)).collect()}
    assert files == {"a.txt", "sub/b.txt", "sub/deep/c.txt", "_x/d.txt", ".hid", "to_file"}
    with pytest.raises(Exception):  # noqa: B017, PT011
        discovery.walk_directory(spark, str(tree / "none")).collect()


def test_markers_and_roots(spark):
    listing = spark.createDataFrame([(f"/d/animal_{k}/s/raw/m.yaml", "m.yaml", "file") for k in range(2)] + [("/d/m.yaml/x", "x", "file"), ("/d/m.yaml", "m.yaml", "dir")], "path string, name string, kind string")
    markers = discovery.marker_files(listing, "m.yaml")
    assert [r.path for r in markers.collect()] == ["/d/animal_0/s/raw/m.yaml", "/d/animal_1/s/raw/m.yaml"]
    assert [r.root for r in discovery.marker_roots(markers, 1).collect()] == ["/d/animal_0/s", "/d/animal_1/s"]
    assert [r.root for r in discovery.marker_roots(markers, 3).collect()] == ["/d"]
    with pytest.raises(ValueError):
        discovery.marker_roots(markers, -1)
    with pytest.raises(Exception, match="too few"):
        discovery.marker_roots(markers, 9).collect()
    rows = spark.createDataFrame([(0, "/d/one/s1/x"), (1, "/d/two/s2/x")], "ord long, path string")
    assert [r.root for r in discovery.unique_roots(rows).orderBy("ord").collect()] == ["/d/one/s1", "/d/two/s2"]
    with pytest.raises(Exception, match="part of its own"):
        discovery.unique_roots(spark.createDataFrame([(0, "/d/x"), (1, "/d/x")], "ord long, path string")).collect()


def test_directory_digest(spark, tmp_path):
    for name, body in (("data.txt", "payload"), (".gitignore", "ignored"), ("archive.tar.gz", "compressed")):
        (tmp_path / name).write_text(body)
    assert integrity.directory_checksum(spark, str(tmp_path)) == "697ab93b2e5603ddc5ba5556a7f3954c"
    assert (tmp_path / integrity.CHECKSUM_FILE).read_text() == "697ab93b2e5603ddc5ba5556a7f3954c"
    assert integrity.directory_checksum(spark, str(tmp_path)) == "697ab93b2e5603ddc5ba5556a7f3954c"
    assert integrity.directory_checksum(spark, str(tmp_path), excluded={"data.txt"}) != "697ab93b2e5603ddc5ba5556a7f3954c"
    (tmp_path / "e").mkdir()
    with pytest.raises(ValueError):
        integrity.directory_checksum(spark, str(tmp_path / "e"))


def test_transfer(spark, tree, tmp_path):
    out = tmp_path / "out"
    transfer_directory(spark, str(tree), str(out), verify_integrity=True)
    assert (out / "sub/deep/c.txt").read_text() == "sub/deep/c.txt" and (out / ".hid").exists()
    (out / "more.txt").write_text("x")
    (out / "empty").mkdir()
    kept = (out / ".hid").stat().st_ino
    with pytest.raises(RuntimeError, match="holds files"):
        transfer_directory(spark, str(tree), str(out))
    (tree / "a.txt").write_text("changed")
    with pytest.raises(RuntimeError, match="out of date"):
        transfer_directory(spark, str(tree), str(out), verify_integrity=True, reset_dirty_destination=True, remove_source=True)
    assert tree.exists() and not (out / "more.txt").exists()
    assert (out / "empty").is_dir() and (out / ".hid").stat().st_ino == kept
    (tree / integrity.CHECKSUM_FILE).unlink()
    transfer_directory(spark, str(tree), str(out), verify_integrity=True, remove_source=True)
    assert not tree.exists()
    with pytest.raises(FileNotFoundError):
        transfer_directory(spark, str(tree), str(out))
    (out / "link").symlink_to(out)
    with pytest.raises(RuntimeError, match="links"):
        transfer_directory(spark, str(out), str(tree))
    assert not tree.exists()
    assert delete_directory(str(out)) and delete_directory(str(out))


def test_transfers_that_are_refused(spark, tmp_path):
    source, out = tmp_path / "source", tmp_path / "out"
    source.mkdir()
    (source / integrity.CHECKSUM_FILE).write_text("00")
    with pytest.raises(RuntimeError, match="no files"):
        transfer_directory(spark, str(source), str(out), verify_integrity=True)
    assert not out.exists()
    (tmp_path / "link").symlink_to(source)
    with pytest.raises(RuntimeError, match="link"):
        transfer_directory(spark, str(tmp_path / "link"), str(out))
    (source / "a").write_text("a")
    (source / integrity.CHECKSUM_FILE).unlink()
    digest = integrity.directory_checksum(spark, str(source))
    (source / integrity.CHECKSUM_FILE).write_text(digest + "\n")
    transfer_directory(spark, str(source), str(out), verify_integrity=True)
    assert delete_directory(str(tmp_path / "link")) and source.is_dir() and not (tmp_path / "link").is_symlink()


def test_arrays(spark):
    a = arrays.SharedArray.create(spark, "numbers", np.array([[1, 2, 3], [4, 5, 6]], np.int32))
    assert a[0].tolist() == [1, 2, 3] and a[-1:].tolist() == [[4, 5, 6]]
    a[1] = [7.9, 8, 9]
    a.where(F.col("value") > 8, 0)
    assert a.array().tolist() == [[1, 2, 3], [7, 8, 0]] and a.array().dtype == np.int32
    with pytest.raises(IndexError):
        a[5]
    with pytest.raises(ValueError):
        a[0] = [1, 2]
    with pytest.raises(FileExistsError):
        arrays.SharedArray.create(spark, "numbers", np.zeros(2))
    for bad, error in (([1], TypeError), (np.array(1), IndexError), (np.zeros(0), ValueError)):
        with pytest.raises(error):
            arrays.SharedArray.create(spark, "other", bad)
    with pytest.raises(TypeError):
        __import__("pickle").dumps(a)
    a.disconnect()
    with pytest.raises(ConnectionError):
        a.array()
    a.connect()
    a.destroy()
    with pytest.raises(FileNotFoundError):
        a.connect()
    rows = spark.createDataFrame([([1, 2, 3, 4, 5],)], "a array<int>")
    values = [1, 2, 3, 4, 5]
    for start, stop in ((0, 3), (1, None), (-3, -1), (None, 9), (4, 2), (-9, 2)):
        assert rows.select(arrays.part("a", start, stop)).first()[0] == values[start:stop]
    assert rows.select(arrays.item("a", -1)).first()[0] == 5
    with pytest.raises(Exception, match="out of range"):
        rows.select(arrays.item("a", 5)).collect()


def test_threads(monkeypatch):
    monkeypatch.setenv("OMP_NUM_THREADS", "9")
    monkeypatch.delenv("MKL_NUM_THREADS", raising=False)
    with pytest.raises(KeyError), runtime.limit_worker_threads(2):
        assert os.environ["OMP_NUM_THREADS"] == os.environ["MKL_NUM_THREADS"] == "2"
        raise KeyError
    assert os.environ["OMP_NUM_THREADS"] == "9" and "MKL_NUM_THREADS" not in os.environ
    with pytest.raises(ValueError):
        runtime.initialize_worker_threads(0)
    assert runtime.thread_settings(3)["spark.executorEnv.OMP_NUM_THREADS"] == "3"


def test_numba_is_told(monkeypatch):
    told = []
    numba = types.ModuleType("numba")
    numba.config, numba.set_num_threads = types.SimpleNamespace(NUMBA_NUM_THREADS=3), told.append
    numba.__spec__ = importlib.machinery.ModuleSpec("numba", None)
    monkeypatch.setitem(sys.modules, "numba", numba)
    for name in runtime.THREAD_VARIABLES:
        monkeypatch.setenv(name, "x")
    runtime.initialize_worker_threads(2)
    runtime.initialize_worker_threads(8)
    assert told == [2, 3]


def test_what_yaml_does_not_know(tmp_path):
    @dataclass
    class Odd(config.YamlConfig):
        value: object = None

    shared = [1, 2]
    Odd({"a": shared, "b": shared, "c": (1, (2,))}).to_yaml(tmp_path / "x.yaml")
    text = (tmp_path / "x.yaml").read_text()
    assert "&" not in text and "*" not in text and "!!" not in text
    assert Odd.from_yaml(tmp_path / "x.yaml").value == {"a": [1, 2], "b": [1, 2], "c": [1, [2]]}
    with pytest.raises(yaml.YAMLError):
        Odd(object()).to_yaml(tmp_path / "y.yaml")
    assert not list(tmp_path.glob("y*"))
