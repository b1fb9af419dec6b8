"""Packing, records and chat formatting: exact round trips."""

import hashlib
import io
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from factloom.llm import chat, packing, records, tokens

PATH = tokens.default_path()
TEXTS = [
    None, "", " \n", "Hello, world! It's WE'LL don't!! x's.", "<|endoftext|> <|ENDOFTEXT|> a<|startoftext|>b", "\x1c a\x85b　c é é ́x ÀÉ× 12½ ﬁ İI ß ΑΣ Σ's", "a" * 3000,
    "Müller's'll 've 's", "one two,three ... !!! £5 ©®", "word " * 30000,
]


def plain(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids


def test_whole_texts():
    encode = tokens.WordEncoder(PATH, max_words=20).encode
    for text in TEXTS:
        assert np.frombuffer(encode(text), "<u4").tolist() == plain(text)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    assert np.frombuffer(tokens.encoder(PATH).encode(text), "<u4").tolist() == plain(text)


def test_blocks(monkeypatch):
    monkeypatch.setattr(tokens, "BLOCK_CHARS", 7)
    text = "some words, of several lengths and\x1cone" + "very" * 9
    assert [w for b in tokens.word_blocks(text) for w in b] == tokens._WORD.findall(text)


def docs(spark):
    rows = [(i * 3 % 11, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (4, "twice"), (4, "twice")]
    return rows, spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("start", F.lit("x")).withColumn("ids", F.lit(0))


@pytest.mark.parametrize("limit", [4096, 8, 1])
def test_packing(spark, limit):
    rows, df = docs(spark)
    found = packing.pack(df, limit=limit).collect()
    assert len({r.sequence_id for r in found}) == len(found)
    got = {}
    for r in sorted(found, key=lambda r: (r.sequence_id, r.start)):
        assert r.length & (r.length - 1) == 0 and 0 < r.length <= limit and r.offset == 0 and len(r.ids) == 4 * r.length and 1 << r.bucket == r.length
        got.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, r.length, bytes(r.ids)))
    for doc_id, text in rows:
        ids = plain(text) + [2]
        pieces = sorted(set(got[doc_id, len(ids)]))
        starts = [p[0] for p in pieces]
        assert starts == [0, *np.cumsum([p[1] for p in pieces])[:-1].tolist()]
        assert np.frombuffer(b"".join(p[2] for p in pieces), "<u4").tolist() == ids


def test_buckets(spark, tmp_path):
    _, df = docs(spark)
    packing.write_buckets(packing.pack(df, limit=64), str(tmp_path / "b"))
    back = spark.read.parquet(str(tmp_path / "b"))
    assert back.filter("length <> shiftleft(1, bucket)").count() == 0 and back.count() == packing.pack(df, limit=64).count()


def test_records(spark):
    rows, df = docs(spark)
    folder = records.new_folder(spark)
    files = records.write_records(df.repartition(3), folder)
    found = sorted(records.read_records(spark, files).collect(), key=lambda r: r.start)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r.doc_id for r in found] == [d for d, _ in order]
    assert sorted((r.doc_id, bytes(r.ids)) for r in found if r.doc_id is not None) == sorted((d, np.array([*plain(t), 1], "<u4").tobytes()) for d, t in rows if d is not None)
    at = 0
    for r in found:
        assert r.start == at and r.n_tokens == len(r.ids) // 4
        at += r.n_tokens
    one = max(files.collect(), key=lambda r: r.records)
    there = list(records.read_at(one.file, list(range(one.records))[::-1]))
    assert [d for d, _ in records.read_at(one.file, [0])] == [there[-1][0]]
    assert sum(ids.size for _, ids in there) == one.tokens
    assert records.read_records(spark, records.write_records(df.limit(0), records.new_folder(spark))).count() == 0


def test_frames():
    ids = np.array([5, 70000, 1], "<u4")
    for doc_id, some in [(7, ids), (None, ids[:1]), (-3, ids[:0])]:
        data = records.frame(records.payload_of(doc_id, some))
        back = records.sequence_of(records.read_frame(io.BytesIO(data)))
        assert back[0] == doc_id and back[1].tolist() == some.tolist()
        for i in range(len(data)):
            broken = bytearray(data)
            broken[i] ^= 1
            with pytest.raises(ValueError):
                records.read_frame(io.BytesIO(bytes(broken)))
        with pytest.raises(ValueError):
            records.read_frame(io.BytesIO(data[:-1]))
    assert zlib.crc32(b"123456789") == 0xCBF43926


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="<|\\im_startend>\n a", max_size=40), st.text(alphabet="<|\\n\nuser", max_size=8))
def test_turns(text, role):
    piece, lo, hi = chat.format_turn(role, text, (role,))
    assert chat.parse_piece(piece) == (role, text) and chat.unescape(piece[lo:hi]) == text


def test_chat(spark):
    rows = [(1, 1, "assistant", "b<|im_end|>"), (1, 0, "user", None), (2, None, None, "x"), (2, 0, "assistant", "y\\"), (2, 0, "assistant", "y\\"), (None, 0, "assistant", "<"), (3, 0, "tool\n<|", "")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string").withColumn("piece", F.lit("x"))
    got = {r.conv_id: r for r in chat.read_chat(chat.format_chat(chat.canonical_turns(df))).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1].turns_sha256 == sha("user\n\nassistant\nb<|im_end|>\n") and got[1].loss_chars == 11 and got[1].loss_sha256 == sha("b<|im_end|>")
    assert got[2].n_turns == 3 and got[2].loss_sha256 == sha("y\\y\\") and got[2].turns_sha256 == sha("\nx\nassistant\ny\\\nassistant\ny\\\n")
    assert got[None].loss_chars == 1 and got[3].loss_chars == 0 and len(got) == 4
    assert chat.read_chat(chat.format_chat(chat.canonical_turns(df.limit(0)))).count() == 0


def test_layouts(spark):
    want = [("user", "hi"), ("assistant", "yo")]
    for record in [
        {"messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "yo"}], "id": 4}, {"conversations": [{"from": "human", "value": "hi"}, {"from": "gpt", "value": "yo"}]},
        {"prompt": "hi", "response": "yo", "source": {"name": "x"}}, {"prompt": "hi", "completion": "yo"}, {"instruction": "hi", "input": "", "output": "yo"}, {"instruction": "hi", "output": "yo"},
    ]:
        assert chat.turns_of_record(record) == want
    with pytest.raises(ValueError):
        chat.turns_of_record({"other": 1})
    frames = [
        spark.createDataFrame([(1, [("user", "hi"), ("assistant", "yo")])], "conv_id bigint, messages array<struct<role: string, content: string>>"),
        spark.createDataFrame([(1, [("human", "hi"), ("gpt", "yo")])], "conv_id bigint, conversations array<struct<`from`: string, value: string>>"),
        spark.createDataFrame([(1, "hi", "yo", 3)], "conv_id bigint, prompt string, response string, other int"),
        spark.createDataFrame([(1, "hi", "", "yo")], "conv_id bigint, instruction string, input string, output string"),
    ]
    for df in frames:
        assert [(r.role, r.text) for r in chat.canonical_turns(df).orderBy("turn").collect()] == want


def test_mixed_layouts_and_clashing_names(spark):
    def turns(df):
        out = {}
        for r in chat.canonical_turns(df).orderBy("conv_id", "turn", "role", "text").collect():
            out.setdefault(r.conv_id, []).append((r.role, r.text))
        return out

    schema = "conv_id bigint, messages array<struct<role: string, content: string>>, prompt string, response string, instruction string, input string, output string, system string"
    mixed = spark.createDataFrame([
        (1, [("user", "hi"), ("assistant", "yo")], None, None, None, None, None, None), (2, None, "p", "r", None, None, None, None),
        (3, None, None, None, "i", None, "o", None), (4, None, None, None, "i", "x", "o", None), (5, None, "p", "r", None, None, None, "s"),
        (6, None, "p", None, None, None, None, None), (7, None, None, None, None, None, None, None), (8, [("gpt", None)], "stray", None, None, None, None, "stray"),
    ], schema)
    assert turns(mixed) == {
        1: [("user", "hi"), ("assistant", "yo")], 2: [("user", "p"), ("assistant", "r")], 3: [("user", "i"), ("assistant", "o")],
        4: [("user", "i"), ("user", "x"), ("assistant", "o")], 5: [("system", "s"), ("user", "p"), ("assistant", "r")],
        6: [("system", ""), ("user", "p"), ("assistant", "")], 7: [("user", ""), ("assistant", "")], 8: [("assistant", "")],
    }
    rows = [(1, 0, "user", None, "p", "s", "x", [1]), (1, 1, "assistant", "yo", None, None, None, None)]
    clash = spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string, prompt string, system string, input string, messages array<int>")
    assert turns(clash) == {1: [("user", ""), ("assistant", "yo")]}
    with pytest.raises(ValueError):
        chat.canonical_turns(clash.select("conv_id", "prompt"))
    with pytest.raises(ValueError):
        chat.turns_of_record({"prompt": "only"})
    assert chat.turns_of_record({"role": "user", "text": "hi", "prompt": "stray"}) == [("user", "hi")]


def test_very_long_turn(spark):
    said = "a<|b\\" * 300_000
    df = spark.createDataFrame([(1, 0, "assistant", said)], "conv_id bigint, turn int, role string, text string")
    (row,) = chat.read_chat(chat.format_chat(chat.canonical_turns(df))).collect()
    assert row.loss_chars == len(said) and row.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()


def test_packing_with_a_cache_of_its_own(spark):
    docs = spark.createDataFrame([(i, " ".join(f"word{j}x{i % 7}, Größe" for j in range(40 * i))) for i in range(12)] + [(50, None)], "doc_id bigint, text string")
    rows = lambda df: sorted(map(tuple, df.drop("sequence_id").collect()))
    assert rows(packing.pack(docs, own_words=100)) == rows(packing.pack(docs))
