"""Facts after adds, changes and deletes against a full run."""

import os

import pytest

from factloom.streaming import changes


def state(tables):
    rows = lambda name, *drop: sorted(map(str, (r.asDict() for r in tables[name].drop(*drop).collect())))
    return {"facts": rows("facts"), "totals": rows("totals"), "edges": rows("edges"), "names": rows("names"), "files": rows("files", "number", "modified")}


def write(folder, files):
    for name, text in files.items():
        path = folder / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)


STEPS = [
    {"a.py": "def f():\n    g()\n    g()\n", "b/c.py": "import os\ndef g():\n    f()\n", "d.java": "class A { void m() { g(); } }", "bad.py": "def ("},
    {"a.py": "def f():\n    h()\n", "e.py": "def g():\n    pass\n"},
    {},
    {"b/c.py": None, "bad.py": "x = 1\n", "a.py": "def f():\n    g()\n    g()\n"},
]


@pytest.mark.parametrize("most", [2])
def test_equal_to_a_full_run(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(changes, "MAX_UPDATES", most)
    root, out = tmp_path / "root", str(tmp_path / "out")
    root.mkdir()
    for n, step in enumerate(STEPS):
        write(root, {k: v for k, v in step.items() if v is not None})
        for name in (k for k, v in step.items() if v is None):
            os.remove(root / name)
        found = changes.update(spark, str(root), out)
        if n in (1, 3):
            whole = changes.update(spark, str(root), str(tmp_path / f"full{n}"))
            assert state(found) == state(whole)
    assert {r.fact: r.n for r in found["totals"].collect()}["file"] == 4


def test_only_changed_files_are_extracted(spark, tmp_path):
    out = str(tmp_path)
    rows = [(f"f{i}.py", "Python", f"def f{i}():\n    g{i}()\n") for i in range(5)]
    frame = lambda r: spark.createDataFrame(r, "path string, language string, content string")
    changes.update_from(frame(rows), out)
    found = changes.update_from(frame(rows[:2] + [("f2.py", "Python", "def f2():\n    new()\n"), ("f9.py", "Python", "")]), out)
    assert sorted((r.path, r.number) for r in found["files"].collect()) == [("f0.py", 1), ("f1.py", 1), ("f2.py", 2), ("f9.py", 2)]
    assert {r.path for r in found["log"].where("number = 2").collect()} <= {"f2.py", "f9.py"}
    assert sorted((r.caller, r.callee) for r in found["edges"].collect()) == [("f0", "g0"), ("f1", "g1"), ("f2", "new")]


def test_a_failed_update_changes_nothing(spark, tmp_path, monkeypatch):
    out = str(tmp_path)
    frame = spark.createDataFrame([("a.py", "Python", "def f():\n    g()\n")], "path string, language string, content string")
    before = state(changes.update_from(frame, out))

    def broken(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(changes, "_first_places", broken)
        with pytest.raises(RuntimeError):
            changes.update_from(frame.where("false"), out)
    assert state(changes.tables(spark, out)) == before
    assert state(changes.update_from(frame.where("false"), out))["edges"] == []


def test_nothing_yet(spark, tmp_path):
    assert changes.tables(spark, str(tmp_path))["facts"].count() == 0
