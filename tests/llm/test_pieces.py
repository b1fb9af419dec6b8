"""Streaming Viterbi against a table over the whole text; decoding gives the text back."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from factloom.llm import pieces

CODEC = pieces.codec(pieces.default_path())


def whole(text):
    """Best path by a table over all boundaries."""
    if not text:
        return []
    out = []
    for k, part in enumerate(text.split(pieces.SPACE)):
        chars = (pieces.SPACE if k == 0 else "") + part.replace(" ", pieces.SPACE)
        out += CODEC._of_char(pieces.SPACE) if k else []
        best = [(0.0, 0, [])] + [None] * len(chars)
        for e in range(1, len(chars) + 1):
            for s in range(max(0, e - 20), e):
                found = CODEC.pieces.get(chars[s:e])
                if found and (best[e] is None or best[s][0] + found[0] > best[e][0]):
                    best[e] = (best[s][0] + found[0], s, [found[1]])
            if chars[e - 1] not in CODEC.pieces and (best[e] is None or best[e - 1][0] + CODEC.unknown > best[e][0]):
                best[e] = (best[e - 1][0] + CODEC.unknown, e - 1, CODEC._of_char(chars[e - 1]))
        path, e = [], len(chars)
        while e:
            path.append(best[e][2])
            e = best[e][1]
        out += [i for ids in reversed(path) for i in ids]
    return out


TEXTS = ["", " ", "   ", "Hello  world", "a\n b\n\nc", "▁", "x▁ y▁▁", "größe é ́x İ ß Σ's", "😀 and ​", "international" * 9, "a" * 300, "<s> </s> <unk> <0x41>"]


def check(text):
    ids = CODEC.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == whole(text)
    assert CODEC.decode(ids) == text
    streamed = [i for part in CODEC.viterbi(pieces.SPACE + text.replace(" ", pieces.SPACE)) for i in part] if text and pieces.SPACE not in text else None
    assert streamed is None or streamed == whole(text)


@pytest.mark.parametrize("text", TEXTS)
def test_texts(text):
    check(text)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40) | st.text(alphabet="the and\n▁iona", max_size=60))
def test_any_text(text):
    check(text)


def test_window_is_bounded():
    """Ids come out long before the text ends."""
    read = 0

    def chars():
        nonlocal read
        for c in "▁internationalisation" * 500:
            read += 1
            yield c

    first = next(CODEC.viterbi(chars()))
    assert first and read < 60


def test_rows(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "x"), (2, None), (2, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("ids", F.lit("own"))
    got = pieces.decode_documents(pieces.encode_documents(df)).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=repr) == sorted(((d, t or "") for d, t in rows), key=repr)
    assert pieces.encode_documents(df.limit(0)).count() == 0
