"""Matches by byte ranges against one search over each whole file."""

import random
import re

import pytest

from factloom.sources.ranges import list_ranges, match_files, read_range

PATTERNS = [r"\bab+", r"^x.*$", r"(?s)BEGIN(.*?)END", r"c\n+d"]


def texts():
    rnd = random.Random(5)
    piece = lambda: rnd.choice(["ab", "abb ", "x1", "\n", "\nx", " BEGIN ", " END ", "é", "c\n\nd", "zz zz", "BEGIN a\nb\nEND"])
    out = {f"f{i}.txt": "".join(piece() for _ in range(rnd.choice([0, 1, 40, 400]))) for i in range(12)}
    out["long.txt"] = "ab " * 700 + "\nBEGIN" + "\n" * 90 + "END ab"
    return out


def write(folder):
    for name, text in texts().items():
        (folder / name).write_bytes(text.encode())
    (folder / "bad.txt").write_bytes(b"\xef\xbb\xbfab \xff\xfe ab\nab\xc3")


def whole(data, flags):
    text = data.removeprefix(b"\xef\xbb\xbf").decode("utf-8", "replace")
    return [
        (p, m, h.start(), 1 + text.count("\n", 0, h.start()), h.group(), text[max(0, h.start() - 3) : h.end() + 2].replace("\n", " ").strip())
        for p, pattern in enumerate(PATTERNS) for m, h in enumerate(re.finditer(pattern, text, flags))]


@pytest.mark.parametrize("size", [7, 50, 1 << 20])
def test_ranges_equal_whole_files(spark, tmp_path, size):
    write(tmp_path)
    found = {}
    for r in match_files(spark, str(tmp_path), PATTERNS, size, re.M, before=3, after=2).collect():
        found.setdefault(r.path, []).append((r.pattern_seq, r.match_seq, r.start, r.line, r.text, r.context))
    for f in tmp_path.iterdir():
        assert sorted(found.get(f.name, [])) == whole(f.read_bytes(), re.M), f.name


def test_every_byte_once(spark, tmp_path):
    write(tmp_path)
    for size in (1, 7, 64):
        parts = {}
        for r in list_ranges(spark, str(tmp_path), size).collect():
            parts.setdefault(r.path, {})[r.number] = read_range(r.uri, r.length, r.number, size)[1]
        for f in tmp_path.iterdir():
            assert "".join(t for _, t in sorted(parts[f.name].items())) == f.read_bytes().removeprefix(b"\xef\xbb\xbf").decode("utf-8", "replace")


def test_beyond_two_gigabytes(spark, tmp_path):
    """A sparse file: only its ends hold text."""
    with open(tmp_path / "large.txt", "wb") as f:
        f.write(b"ab first\n")
        f.seek(5 << 29)
        f.write(b"\nlast ab\n")
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "1000")  # the content is never read as one value
    try:
        rows = list_ranges(spark, str(tmp_path), 64 << 20).collect()
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    assert len(rows) == 41 and rows[0].length == (5 << 29) + 9
    last = max(rows, key=lambda r: r.number)
    assert read_range(last.uri, last.length, last.number, 64 << 20)[1] == "last ab\n"


def test_no_files(spark, tmp_path):
    (tmp_path / "empty.txt").write_bytes(b"")
    assert match_files(spark, str(tmp_path), PATTERNS).collect() == []
