import os
import shutil
import subprocess

import pytest

from corposcope import EngineError
from corposcope.operators import cache, index, symbols
from corposcope.sources import git, gitignore, repository


def write(root, files):
    for name, body in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(body if isinstance(body, bytes) else body.encode())


def paths(df):
    return sorted(r.path for r in df.select("path").collect())


def test_admission_and_builtin_exclusions(spark, tmp_path):
    write(tmp_path, {
        "src/lib.rs": "fn a() {}\n", "src/__init__.py": "", ".hidden": "x", "bin.dat": b"a\0b", "bad.txt": b"\xff\xfe", "big.txt": "x" * 200,
        "node_modules/a.js": "x", "target-audit/x.rs": "x", "src/targeting.rs": "x", "src/.corposcope-1.tmp": "x"})
    os.symlink(tmp_path / "src/lib.rs", tmp_path / "linked.rs")
    assert paths(repository.scan(spark, str(tmp_path), max_bytes=100)) == [".hidden", "src/__init__.py", "src/lib.rs", "src/targeting.rs"]


def test_ignore_files_need_a_worktree_and_artifacts_bypass_them(spark, tmp_path):
    write(tmp_path, {".gitignore": "*.log\nout/\n!keep.log\n", "a.log": "x", "keep.log": "x", "out/r.json": "x", "sub/.gitignore": "/only.txt\n",
                     "sub/only.txt": "x", "sub/deep/only.txt": "x", ".ignore": "secret*\n", "secret.txt": "x"})
    assert "a.log" in paths(repository.scan(spark, str(tmp_path)))
    assert "secret.txt" not in paths(repository.scan(spark, str(tmp_path)))
    write(tmp_path, {".git/info/exclude": "deep/\n"})
    assert paths(repository.scan(spark, str(tmp_path))) == [".gitignore", ".ignore", "keep.log", "sub/.gitignore"]
    assert "out/r.json" in paths(repository.scan(spark, str(tmp_path), artifacts=["out", "absent"]))
    with pytest.raises(EngineError) as error:
        repository.scan(spark, str(tmp_path), artifacts=["../x"])
    assert error.value.code == "OUTSIDE_ROOT"


def test_configured_exclusions(spark, tmp_path):
    write(tmp_path, {"backend/artifacts/result.json": "x", "debug.log": "x", "src/lib.rs": "x", "a/b/c.log": "x"})
    patterns = ["backend\\artifacts/", "*.log"]
    assert paths(repository.scan(spark, str(tmp_path), exclude=patterns)) == ["src/lib.rs"]
    table = spark.createDataFrame([(p,) for p in ("backend/artifacts/new.json", "x.log", "src/a.rs", "artifacts/b")], "path STRING")
    assert paths(table.filter(repository.not_excluded("path", patterns))) == ["artifacts/b", "src/a.rs"]
    for bad in ("!keep", "  "):
        with pytest.raises(EngineError) as error:
            gitignore.check_exclusions([bad])
        assert error.value.code == "INVALID_EXCLUDE_PATTERN"


@pytest.mark.parametrize("pattern,path,is_dir,expected", [
    ("*.o", "a/b.o", False, True), ("/a.o", "x/a.o", False, None), ("a/**/z", "a/z", False, True), ("a/**/z", "a/b/c/z", False, True),
    ("**/x", "x", False, True), ("doc/*.txt", "doc/a/b.txt", False, None), ("foo/", "foo", False, None), ("foo/", "foo", True, True),
    ("[ab].c", "b.c", False, True), ("[!ab].c", "b.c", False, None), ("\\#x", "#x", False, True), ("a/**", "a/b", False, True)])
def test_pattern_rules(pattern, path, is_dir, expected):
    assert gitignore.decide(gitignore.compile_lines([pattern]), path, is_dir) is expected


def test_many_partitions_see_every_file_once(spark, tmp_path):
    write(tmp_path, {f"d{i}/e{j}/f{k}.py": "x" for i in range(4) for j in range(3) for k in range(2)})
    write(tmp_path, {f"top{i}.txt": "x" for i in range(7)})
    for parts in (1, 3, 8, 50):
        found = paths(repository.scan(spark, str(tmp_path), partitions=parts))
        assert len(found) == len(set(found)) == 31


def test_cache_reuses_rows_by_hash_and_checks_settings(spark, tmp_path):
    root, target = tmp_path / "root", str(tmp_path / "cache")
    write(root, {"lib.py": "def old():\n    pass\n", "keep.py": "def keep():\n    pass\n"})
    first, hit = cache.scan_cached(spark, str(root), target)
    assert not hit and first.count() == 2
    stat = os.stat(root / "lib.py")
    write(root, {"lib.py": "def new():\n    pass\n"})
    os.utime(root / "lib.py", ns=(stat.st_atime_ns, stat.st_mtime_ns))
    second, hit = cache.scan_cached(spark, str(root), target)
    assert hit
    assert sorted(r.name for r in symbols.symbol_rows(second).collect()) == ["keep", "new"]
    _, hit = cache.scan_cached(spark, str(root), target, exclude=["keep.py"])
    assert not hit


def test_stored_index(spark, tmp_path, corpus):
    df = corpus({"src/a.md": "Alpha beta\nGamma alpha\n", "docs/b.md": "Beta\n"})
    tables = index.build(df, str(tmp_path / "ix"))
    postings = spark.read.parquet(tables["postings"])
    files = spark.read.parquet(tables["files"])
    assert paths(index.candidate_files(files, postings, ["gamma"])) == ["src/a.md"]
    assert index.candidate_files(files, postings, ["missing"]).count() == 0
    assert spark.read.parquet(tables["identifiers"]).filter("token = 'alpha'").first().column == 7
    from corposcope.operators import references, search

    rows = spark.read.parquet(tables["identifiers"])
    assert paths(references.files_with_identifier(files, rows, "Beta")) == ["docs/b.md"]
    assert search.search_text(files, "beta").count() == 2


def test_snapshot_is_order_free_and_reversible(corpus):
    token = lambda files, head="h": index.snapshot_id(corpus(files), head).first().snapshot_id
    one = token([("a", "1"), ("b", "2")])
    assert one == token([("b", "2"), ("a", "1")]) and one.startswith("snap_")
    assert one != token([("a", "1"), ("b", "3")]) and one != token([("a", "1"), ("b", "2")], "other")


@pytest.mark.skipif(shutil.which("git") is None, reason="git is not installed")
def test_git_readers(spark, tmp_path):
    def run(*args):
        subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@example.com", *args], check=True, capture_output=True)

    with pytest.raises(EngineError) as error:
        git.status(spark, str(tmp_path))
    assert error.value.code == "NOT_GIT_REPOSITORY"
    run("init")
    write(tmp_path, {"tracked.py": "print('before')\n", "moved.py": "x = 1\n" * 20})
    run("add", ".")
    run("commit", "-m", "first commit")
    write(tmp_path, {"tracked.py": "print('after')\n", "new.py": "print('new')\n"})
    run("mv", "moved.py", "renamed.py")
    rows = {r.path: (r.staged, r.unstaged, r.untracked) for r in git.status(spark, str(tmp_path)).collect()}
    assert rows == {"tracked.py": (False, True, False), "new.py": (False, False, True),
                    "renamed.py": (True, False, False), "moved.py": (False, False, False)}
    assert [r.subject for r in git.log(spark, str(tmp_path)).collect()] == ["first commit"]
    texts = {r.file: r.diff for r in git.patches(spark, str(tmp_path), paths=["tracked.py", "new.py"]).collect()}
    assert "+print('after')" in texts["tracked.py"]
    assert texts["new.py"].endswith("new file mode 100644\n--- /dev/null\n+++ b/new.py\n+print('new')\n")
    assert [r.path for r in git.diff(spark, str(tmp_path)).collect()] == ["tracked.py"]
