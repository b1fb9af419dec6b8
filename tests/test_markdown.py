"""Markdown operators: diagram repairs, headings, HTML."""

import random
import re

import pytest

from factloom.operators import markdown as M


def one(spark, text, fn):
    df = spark.createDataFrame([(1, text)], "doc int, md string")
    return fn(df).first()[-1]


def fixed(spark, line, kind="flowchart TD"):
    out = one(spark, f"```mermaid\n{kind}\n{line}\n```", lambda df: M.fix_diagrams(df, ["doc"], "md", "out"))
    return out.split("\n")[3]


@pytest.mark.parametrize("line, want", [
    ("A[f(x)]", 'A["fx"]'), ("A{is(x)}", 'A{"isx"}'), ("A -->|f(x)| B", "A -->|fx| B"), ('A -- "f(x)" --> B', 'A -- "fx" --> B'),
    ("A{ a = true}", 'A{"a is true"}'), ('A{a = "b"}', 'A{"a is b"}'), ('A["a = b"]', 'A["set a to b"]'), ('A["end"]', 'A["End"]'),
    ('A("end")', 'A("End")'), ("A ---oB", "A ---oB"), ("A ---ob", "A --- ob"), ('  subgraph "X y"', '  subgraph sg0 ["X y"]'),
])
def test_flowchart_lines(spark, line, want):
    assert fixed(spark, line) == want


@pytest.mark.parametrize("line, want", [
    ('A->>B: x = "v"', "A->> B: x =v"), ("A->>B: a;b", "A->>B: a#59;b"), ("%% x: a;b", "%% x: a;b"), ("Note: a;b", "Note: a;b"),
])
def test_sequence_lines(spark, line, want):
    assert fixed(spark, line, "sequenceDiagram") == want


def test_missing_ends_are_added_and_extra_ends_do_not_count(spark):
    text = "```mermaid\nsequenceDiagram\nend\nalt a\nloop b\nend\npar c\n```"
    out = one(spark, text, lambda df: M.fix_diagrams(df, ["doc"], "md", "out"))
    assert out.count("    end") == 2


def test_unclosed_block_and_plain_text_stay(spark):
    for text in ("no diagram", "a\n```mermaid\nflowchart\nA[f(x)]"):
        assert one(spark, text, lambda df: M.fix_diagrams(df, ["doc"], "md", "out")) == text


def test_subgraph_ids_are_unique(spark):
    text = '```mermaid\nflowchart TD\nsubgraph "a"\nend\nsubgraph "b"\nend\n```'
    out = one(spark, text, lambda df: M.fix_diagrams(df, ["doc"], "md", "out"))
    assert 'sg0 ["a"]' in out and 'sg1 ["b"]' in out


def test_diagram_inside_details_is_left_alone(spark):
    text = "<details>\n```mermaid\nflowchart\nA --> B\n```\n</details>\n```mermaid\ngraph TD\nA --> B\n```"
    out = one(spark, text, lambda df: M.wrap_diagrams(df, ["doc"], "md", "out"))
    assert out.count("<details>") == 2 and "Flowchart (1 edges)" in out


def reference_levels(lines):
    """(level, in fence) per line, straight from the definition."""
    fence, out = False, []
    for line in lines:
        if line.strip().startswith("```"):
            fence = not fence
            out.append((0, True))
            continue
        m = re.match(r"^(#{1,6})\s+\S", line)
        out.append((len(m.group(1)) if m and not fence else 0, fence))
    return out


def test_heading_shift_properties(spark):
    rng = random.Random(2)
    pieces = ["# a", "## b", "###### c", "## ", "text", "", "```", "#no", "   # in"]
    docs = ["\n".join(rng.choice(pieces) for _ in range(rng.randint(1, 25))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(docs)), "doc int, md string")
    for base in (1, 4):
        got = {r.doc: r.out for r in M.normalize_headings(df, ["doc"], "md", base, "out").collect()}
        for n, doc in enumerate(docs):
            before, after = doc.split("\n"), got[n].split("\n")
            levels = [l for l, _ in reference_levels(before) if l]
            if not levels:
                assert got[n] == doc
                continue
            new = [l for l, _ in reference_levels(after) if l]
            assert all(1 <= l <= 6 for l in new)
            code = lambda lines: [x for x, (_, c) in zip(lines, reference_levels(lines)) if c]
            assert code(before) == code(after)


def test_html_of_open_code_and_lists(spark):
    out = one(spark, "p1\np2\n\n* a\n* b\n1. c\n```py\nx < 1", lambda df: M.to_html(df, ["doc"], "md", "out"))
    assert out == (
        "<p>p1 p2</p>\n<ul>\n<li>a</li>\n<li>b</li>\n</ul>\n<ol>\n<li>c</li>\n</ol>\n"
        '<pre><code class="language-py">\nx &lt; 1\n</code></pre>'
    )


def test_key_sections_put_priority_first_and_fall_back(spark):
    text = "# A\n" + "a" * 50 + "\n## Public Interface\nf\n"
    out = one(spark, text, lambda df: M.key_sections(df, ["doc"], "md", 2000))
    assert out.startswith("## Public Interface")
    assert one(spark, "x" * 30, lambda df: M.key_sections(df, ["doc"], "md", 10)) == "x" * 10
