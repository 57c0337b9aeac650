import io
import zipfile

import pytest
from epubs import archive, members
from pyspark.sql import functions as F

from corpusaudit.sources import archives as A
from corpusaudit.sources import packages as S


class Counted(io.BytesIO):
    """A file that remembers how much was read from it."""

    got = 0

    def read(self, *n):
        data = super().read(*n)
        self.got += len(data)
        return data


@pytest.fixture
def folder(tmp_path):
    for name in ("a.epub", "b.epub"):
        (tmp_path / name).write_bytes(archive(members()))
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "c.epub").write_bytes(archive([*members(), ("mimetype", b"second")]))
    (tmp_path / "none.epub").write_bytes(b"no archive")
    (tmp_path / "other.txt").write_bytes(archive([("x", b"y")]))
    return str(tmp_path)


def test_members_of_all_archives(spark, folder):
    got = A.archives(spark, folder, ".epub")
    rows = got.collect()
    assert len(rows) == 7 + 7 + 8 + 1
    assert [(r.name, r.ord, r.problem) for r in rows if r.path.endswith("none.epub")] == [("", -1, "not-a-zip-archive")]
    twice = sorted((r.ord, r.current, bytes(r.content)) for r in rows if "deep" in r.path and r.name == "mimetype")
    assert [(c, b) for _, c, b in twice] == [(False, b"application/epub+zip"), (True, b"second")]
    only = A.archives(spark, folder, ".epub", inflate=False).filter("name != ''")
    assert only.filter("content IS NOT NULL").count() == 0 and only.agg(F.sum("byte_size")).first()[0] > 0


@pytest.mark.parametrize(
    ("condition", "count"),
    [
        ("name = 'META-INF/container.xml'", 3),
        ("name IN ('mimetype', 'OPS/book.opf')", 7),
        ("name LIKE 'OPS/%'", 15),
        ("name LIKE '%.xhtml' AND current", 9),
        ("name LIKE '%charts%' AND byte_size > 1", 3),
        ("name = 'mimetype' OR ord = 1", 7),
        ("name IS NULL", 0),
    ],
)
def test_filters(spark, folder, condition, count):
    assert A.archives(spark, folder, ".epub").filter(condition).count() == count


def test_filters_on_names_are_taken_and_others_left(folder):
    reader = A.ArchiveReader({"path": folder})
    name, size = A.EqualTo(("name",), "mimetype"), A.EqualTo(("byte_size",), 9)
    assert list(reader.pushFilters([name, size, A.StringEndsWith(("path",), "x")])) == [size, A.StringEndsWith(("path",), "x")]
    (part,) = reader.partitions()
    assert {row[2] for row in reader.read(part)} == {"mimetype"}


def test_one_member_is_one_range():
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        for i in range(50):
            z.writestr(f"m{i}", bytes(100_000))
    file = Counted(held.getvalue())
    (row,) = A.members_of(file, lambda name: name == "m7")
    assert row[0] == 7 and len(row[5]) == 100_000
    assert file.got < 150_000


def test_a_large_archive_is_read_by_several_tasks(spark, tmp_path):
    (tmp_path / "big.zip").write_bytes(archive([(f"m{i}", bytes([i]) * 1000) for i in range(40)]))
    got = A.archives(spark, str(tmp_path), ".zip", split_bytes=5000)
    assert got.rdd.getNumPartitions() >= 8
    assert sorted(r.ord for r in got.collect()) == list(range(40))
    assert got.filter("name = 'm9'").count() == 1


def test_a_broken_member_is_a_row(spark, tmp_path):
    data = bytearray(archive([("good", b"1234567890"), ("bad", b"abcdefghij")]))
    place = data.index(b"abcdefghij")
    data[place : place + 3] = b"XXX"
    (tmp_path / "x.zip").write_bytes(bytes(data))
    got = {r.name: (r.problem, r.content is None) for r in A.archives(spark, str(tmp_path)).collect()}
    assert got == {"good": (None, False), "bad": ("unreadable", True)}


def test_packages_open_with_two_members_inflated(spark, monkeypatch):
    files = spark.createDataFrame(
        [(1, archive(members())), (2, b"no archive"), (3, archive([("mimetype", b"x")])), (4, None)], "package_id long, content binary"
    )
    paths, records = S.open_packages(files)
    got = {r.package_id: (r.present, r.path) for r in paths.collect()}
    assert got == {1: (True, "OPS/book.opf"), 2: (False, None), 3: (False, None), 4: (False, None)}
    _, whole = S.members_to_package(S.current_members(S.packages_to_members(files)))
    assert sorted(map(str, records.collect())) == sorted(map(str, whole.collect()))
    read = S.named_members(files, (S.CONTAINER,)).collect()
    assert [(r.package_id, r.name) for r in read] == [(1, S.CONTAINER)]
