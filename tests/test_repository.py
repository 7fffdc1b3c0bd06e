"""Folders and work trees as data sources."""

import os
import subprocess

import pytest

from tessera.plans.retrieve import retrieved
from tessera.sources import repository as repo


def write(root, files):
    for path, content in files.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_bytes(content if isinstance(content, bytes) else content.encode())


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "tree"
    write(root, {"a.rs": "fn a() {}\n", "src/b.py": "x\r\ny", "src/deep/er/c.md": "ü", "src/deep/er/most/d.txt": "d", "bin.rs": b"a\0b", "late.rs": b"a" * 9000 + b"\0", "bad.rs": b"\xff\xfe", "long.rs": "z" * 600_000, ".hidden/h.rs": "h", "empty.rs": ""})
    (tmp_path / "secret").write_text("s")
    os.symlink(tmp_path / "secret", root / "link.rs")
    os.symlink(tmp_path, root / "src/out")
    os.mkfifo(root / "pipe.rs")
    return root


@pytest.mark.parametrize("depth", ["0", "2", "9"])
def test_all_text_files_once(spark, tree, depth):
    repo.register(spark)
    rows = spark.read.format("repository").option("depth", depth).load(str(tree)).collect()
    assert sorted(map(tuple, rows))[0] == ("a.rs", 10, 2, "fn a() {}\n")
    assert sorted(r.path for r in rows) == ["a.rs", "empty.rs", "late.rs", "src/b.py", "src/deep/er/c.md", "src/deep/er/most/d.txt"]
    hidden = spark.read.format("repository").options(hidden="true", max_file_bytes="8").load(str(tree)).collect()
    assert sorted(r.path for r in hidden) == [".hidden/h.rs", "empty.rs", "src/b.py", "src/deep/er/c.md", "src/deep/er/most/d.txt"]


def test_named_files(spark, tree):
    rows = repo.load_documents(spark, str(tree), ["src/b.py", "./src//b.py", str(tree / "a.rs"), "bin.rs", "bad.rs", "long.rs"]).orderBy("path").collect()
    assert [(r.path, r.bytes, r.line_count, r.numbered_content) for r in rows] == [("a.rs", 10, 2, "1: fn a() {}\n2: "), ("src/b.py", 4, 2, "1: x\n2: y")]
    assert [tuple(map(tuple, r.allowed_ranges)) for r in rows] == [((1, 2),)] * 2


@pytest.mark.parametrize("paths, message", [([], "at least one"), (["../secret"], "escapes"), (["/etc/passwd"], "escapes"), (["."], "escapes"), (["src/../../x"], "escapes"), (["link.rs"], "link.rs|symbolic"), (["src/out/secret"], "directory|symbolic|out"), (["src"], "not a regular file"), (["pipe.rs"], "not a regular file"), (["gone.rs"], "gone.rs|No such file"), (["a.rs"] * 31, "too many")])
def test_what_may_not_be_read_is_an_error(spark, tree, paths, message):
    with pytest.raises(Exception, match=message):
        repo.load_documents(spark, str(tree), paths).collect()


def test_too_many_bytes_are_an_error(spark, tree):
    with pytest.raises(ValueError, match="aggregate"):
        repo.load_documents(spark, str(tree), ["late.rs", "a.rs"], repo.Limits(max_total_bytes=9010))


def test_a_file_that_changes_is_an_error(tree, monkeypatch):
    real, calls = os.fstat, []

    def torn(descriptor):
        if calls:
            os.utime(tree / "a.rs", ns=(1, 1))
        calls.append(1)
        return real(descriptor)

    monkeypatch.setattr(repo.os, "fstat", torn)
    with pytest.raises(ValueError, match="changed while"):
        repo.read_below(str(tree), ("a.rs",), 100)


def git(folder, *arguments):
    subprocess.run(["git", "-c", "user.name=t", "-c", "user.email=t@t", "-c", "init.defaultBranch=main", *arguments], cwd=folder, check=True, capture_output=True)


@pytest.fixture
def work_tree(tmp_path):
    root = tmp_path / "work"
    ten = "".join(f"line{i}\n" for i in range(1, 11))
    write(root, {"edit.rs": ten, "cut.rs": ten, "gone.rs": "x\n", "old name.rs": ten, "keep.rs": "k\n", "bin.dat": b"\0\1", ".gitignore": "*.log\n", "sub/in.rs": "1\n"})
    git(root, "init")
    git(root, "add", "-A")
    git(root, "commit", "-m", "first")
    os.remove(root / "gone.rs")
    os.rename(root / "old name.rs", root / "new name é.rs")
    git(root, "add", "-A")
    write(root, {"edit.rs": ten.replace("line3\n", "++ b/fake.rs\n@@ -1 +1 @@\nneedle()\n").replace("line9\n", "nine\n"), "cut.rs": ten.replace("line5\n", ""), "new name é.rs": ten + "more\n", "bin.dat": b"\0\2", "sub/in.rs": "2", "fresh.rs": "fn needle() {}\n", "x.log": "l", "raw.bin": b"\xff\0", "cut.txt": "a" * 63_999 + "é"})
    return root


def test_changes_of_a_work_tree(spark, work_tree):
    repo.register(spark)
    rows = {(r.path, r.start_line, r.end_line): (r.whole_file, r.text) for r in spark.read.format("changes").load(str(work_tree)).collect()}
    assert rows == {
        ("edit.rs", 3, 5): (False, "++ b/fake.rs\n@@ -1 +1 @@\nneedle()\n"),
        ("edit.rs", 11, 11): (False, "nine\n"),
        ("cut.rs", None, None): (False, ""),
        ("new name é.rs", 11, 11): (False, "more\n"),
        ("sub/in.rs", 1, 1): (False, "2\n"),
        ("fresh.rs", 1, 2**31 - 1): (True, "fn needle() {}\n"),
        ("raw.bin", 1, 2**31 - 1): (True, ""),
        ("cut.txt", 1, 2**31 - 1): (True, ""),
    }
    below = spark.read.format("changes").load(str(work_tree / "sub")).collect()
    assert [(r.path, r.text) for r in below] == [("in.rs", "2\n")]


def test_a_search_in_the_change(spark, work_tree):
    change = repo.work_tree_change(spark, str(work_tree))
    assert "needle" in change.text and set(change.paths) == {"edit.rs", "cut.rs", "new name é.rs", "sub/in.rs", "fresh.rs", "raw.bin", "cut.txt"}
    found = retrieved(repo.repository_files(spark, str(work_tree)), "where is the needle", change=change).chunks.collect()
    assert {"edit.rs"} <= {r.path for r in found} <= set(change.paths)


def test_no_commits_and_no_repository(spark, tmp_path):
    write(tmp_path, {"r/a.rs": "a"})
    git(tmp_path / "r", "init")
    repo.register(spark)
    assert [tuple(r)[:2] for r in spark.read.format("changes").load(str(tmp_path / "r")).collect()] == [("a.rs", True)]
    git(tmp_path / "r", "add", "-A")
    git(tmp_path / "r", "commit", "-m", "x")
    with pytest.raises(ValueError, match="no local changes"):
        repo.work_tree_change(spark, str(tmp_path / "r"))
    with pytest.raises(Exception, match="git ls-files failed"):
        spark.read.format("changes").load(str(tmp_path)).collect()
