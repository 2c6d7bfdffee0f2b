"""Changed files of a work tree, and scans that open no others."""

import os
import shutil
import subprocess

import pytest
from pyspark.sql import datasource as D

from siftline.operators import findings as O
from siftline.sources import git_changes as G

pytestmark = pytest.mark.skipif(shutil.which("git") is None, reason="needs git")


@pytest.fixture()
def tree(tmp_path):
    root = tmp_path / "tree"
    run = lambda *w: subprocess.run(["git", "-C", str(root), "-c", "user.name=t", "-c", "user.email=t@t", *w], check=True, capture_output=True)
    for name in ("same.py", "src/edited.py", "src/staged.py", "src/deep/gone.py", "src/é x[1].py", "note.md"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text("eval(a)\n")
    run("init", "-q")
    (root / ".gitignore").write_text("ignored.py\n__pycache__/\n")
    run("add", "-A")
    run("commit", "-qm", "one")
    run("gc", "-q")  # packed objects count as well
    (root / "src/edited.py").write_text("x = 1\nexec(b)\n")
    (root / "src/é x[1].py").write_text("eval(c)\n")
    (root / "src/staged.py").write_text("y = 2\n")
    (root / "src/new.py").write_text("eval(d)\n")
    (root / "ignored.py").write_text("eval(e)\n")
    (root / "note.md").write_text("eval(f)\n")
    (root / "src/deep/gone.py").unlink()
    run("add", "src/staged.py")
    return str(root)


def changes(spark, root):
    G.register(spark)
    return spark.read.format("git_changes").load(root)


def test_changes(spark, tree):
    got = {r.path: r.change for r in changes(spark, tree).collect()}
    assert got == {"src/edited.py": "modified", "src/é x[1].py": "modified", "src/staged.py": "modified", "src/new.py": "untracked", "note.md": "modified", "src/deep/gone.py": "deleted"}


@pytest.mark.parametrize("term", ["path LIKE '%.py'", "path LIKE 'src/%'", "path LIKE 'src/e%' AND path LIKE '%d.py'", "path LIKE '%/edited.py'", "path LIKE '%x[1].py'", "change = 'deleted'", "path LIKE 'src/d%'", "path LIKE '%md'"])
def test_filters(spark, tree, term):
    every = [tuple(r) for r in changes(spark, tree).collect()]
    want = spark.createDataFrame(every, "path string, change string").where(term)
    assert sorted(map(tuple, changes(spark, tree).where(term).collect())) == sorted(map(tuple, want.collect()))


def test_filters_reach_git(tree):
    reader = G.GitChanges({"path": tree}).reader(None)
    assert list(reader.pushFilters([D.StringEndsWith(("path",), ".md"), D.EqualTo(("change",), "modified")])) == [D.EqualTo(("change",), "modified")]
    assert [r for p in reader.partitions() for r in reader.read(p)] == [("note.md", "modified")]


def test_a_scan_opens_changed_files_only(spark, tree):
    texts = G.changed_texts(spark, tree, [".py"])
    files = [os.path.basename(f) for f in texts.inputFiles()]
    assert len(files) == 4 and not any("same" in f or "ignored" in f or "note" in f for f in files)
    got = sorted((r.file, r.line, r.type) for r in O.scan_lines(O.source_lines(texts, "file", "text")).collect())
    assert got == [("src/edited.py", 2, "dangerous_eval"), ("src/new.py", 1, "dangerous_eval"), ("src/é x[1].py", 1, "dangerous_eval")]


def test_many_changes_are_looked_up(spark, tree, monkeypatch):
    want = sorted(map(tuple, G.changed_texts(spark, tree, [".py"]).collect()))
    monkeypatch.setattr(G, "BY_NAME", 1)
    assert sorted(map(tuple, G.changed_texts(spark, tree, [".py"]).collect())) == want


def test_no_work_tree_has_no_changes(spark, tmp_path):
    (tmp_path / "a.py").write_text("eval(a)")
    assert changes(spark, str(tmp_path)).count() == 0 and G.changed_texts(spark, str(tmp_path), [".py"]).count() == 0


def test_without_git_times_are_compared(spark, tree, monkeypatch):
    before = spark.createDataFrame(G.mtimes(spark, tree).collect(), "path string, mtime timestamp")
    os.utime(f"{tree}/same.py", (1, 1))

    def missing(*words, **options):
        raise FileNotFoundError("git")

    monkeypatch.setattr(G.subprocess, "run", missing)
    assert [r.path for r in G.changed_paths(spark, tree, [".py"], before).collect()] == ["same.py"]
    assert {r.path for r in G.changed_paths(spark, tree, [".py", ".md"]).collect()} == {"same.py", "ignored.py", "note.md", "src/edited.py", "src/é x[1].py", "src/staged.py", "src/new.py"}
    assert [r.file for r in G.changed_texts(spark, tree, [".py"], before).collect()] == ["same.py"]
