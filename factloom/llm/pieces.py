"""SentencePiece encoding by streaming Viterbi, and decoding.

The ids of a text are those of the segmentation with the greatest sum of piece
scores (ties: the longer last piece). The search reads one character at a time and
keeps a window of twice the longest piece's length: only starts from which some piece
may still go on are alive. When none is, or the window is full, the boundary that the
best paths to all of them run through is committed with the ids before it, which are
then forgotten, so memory does not grow with the text.

A character of no piece becomes its UTF-8 bytes, at a score below all pieces. Spaces
are written as U+2581 with one before the text, and a U+2581 of the text itself as
bytes, so decoding gives the text back exactly. Where no piece can cross a boundary
(before a space after another character, around a line end) texts are cut first, and
each worker keeps the ids of cuts it has met, in a bounded cache.

Null text counts as empty and has no ids. Null doc_id and repeated rows are kept as
they are. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import Rows, prepare, text_or_empty, values

SPACE = "▁"
MAX_CUTS = 3 << 17
BLOCK_CHARS = 1 << 20
PENALTY = 10.0
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
SIGNS = ".,;:!?*$%&#|"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class PieceCodec:
    def __init__(self, path: str, max_cuts: int = MAX_CUTS):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i))]
        self.pieces = {model.id_to_piece(i): (model.get_score(i), i) for i in plain}
        self.bytes = {int(model.id_to_piece(i)[1:-1], 16): i for i in range(n) if model.is_byte(i)}
        self.prefixes = {p[:k] for p in self.pieces for k in range(1, len(p))}
        self.window = 2 * max(map(len, self.pieces))
        self.unknown = min(s for s, _ in self.pieces.values()) - PENALTY
        self.raw = [b""] * n
        for piece, (_, i) in self.pieces.items():
            self.raw[i] = piece.replace(SPACE, " ").encode()
        for byte, i in self.bytes.items():
            self.raw[i] = bytes([byte])
        inside = "".join(p for p in self.pieces if len(p) > 1)
        cut_lines = "\n" not in inside and not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.pieces)
        # cuts that no piece crosses: around line ends, before a space after another character, between a letter and some signs
        after_letters = {y for p in self.pieces for x, y in zip(p, p[1:], strict=False) if re.match(f"[{LETTERS}]", x)}
        signs = "".join(re.escape(c) for c in SIGNS if c not in after_letters)
        word = f"{SPACE}*[{LETTERS}]+(?=[{signs}])|" if signs else ""
        self.cuts = re.compile(f"\n|{word}{SPACE}*[^{SPACE}\n]+|{SPACE}+") if cut_lines else None
        self.max_cuts = max_cuts
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def _of_char(self, char: str) -> list[int]:
        return [self.bytes[b] for b in char.encode()]

    def viterbi(self, chars: Iterable[str]) -> Iterator[list[int]]:
        """Ids of a stream of characters, committed boundary by boundary."""
        pieces, prefixes, unknown = self.pieces, self.prefixes, self.unknown
        done = at = 0
        score: dict[int, float] = {0: 0.0}  # best score of each boundary in the window
        back: dict[int, tuple] = {}  # where its last piece starts, and its ids
        alive = [(0, "")]  # starts of pieces that may still end, ascending, and what they have read
        for char in chars:
            before, at = at, at + 1
            best, last = -np.inf, None
            going = []
            for start, read in alive:  # ties go to the longer piece
                read += char
                found = pieces.get(read)
                if found is not None:
                    total = score[start] + found[0]
                    if total > best:
                        best, last = total, (start, (found[1],))
                if read in prefixes:
                    going.append((start, read))
            if char not in pieces and score[before] + unknown > best:
                best, last = score[before] + unknown, (before, self._of_char(char))
            score[at], back[at] = best, last
            if not going:  # all paths run through this boundary
                yield self._path(back, done, at)
                score, back, done = {at: 0.0}, {}, at
            elif at - done > self.window:
                # the boundary that the paths to all living starts have in common
                ends = {start for start, _ in going} | {at}
                while len(ends) > 1:
                    far = max(ends)
                    ends.remove(far)
                    ends.add(back[far][0] if far > done else done)
                (meet,) = ends
                if meet > done:
                    yield self._path(back, done, meet)
                    base, done = score[meet], meet
                    back = {k: v for k, v in back.items() if k > meet}
                    score = {k: v - base for k, v in score.items() if k >= meet}
            going.append((at, ""))
            alive = going
        if at > done:
            yield self._path(back, done, at)

    @staticmethod
    def _path(back: dict[int, tuple[int, list[int]]], done: int, end: int) -> list[int]:
        parts = []
        while end > done:
            end, ids = back[end]
            parts.append(ids)
        return [i for ids in reversed(parts) for i in ids]

    def _ids(self, text: str) -> bytes:
        return np.array([i for ids in self.viterbi(text) for i in ids], "<u4").tobytes()

    def _part(self, text: str) -> bytes:
        if self.cuts is None:
            return self._ids(text)
        cuts = self.cuts.findall(text)
        if len(self.known) > self.max_cuts:
            self.known, self.before = {}, self.known
        missing = set(cuts).difference(self.known)
        for cut in missing:
            self.known[cut] = self.before.get(cut) or self._ids(cut)
        return b"".join([self.known[c] for c in cuts])

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        mark = np.array(self._of_char(SPACE), "<u4").tobytes()
        parts = []
        for k, piece in enumerate(text.split(SPACE)):
            written = (SPACE if k == 0 else "") + piece.replace(" ", SPACE)
            parts.append((mark if k else b"") + b"".join(self._part(p) for p in self._blocks(written)))
        return b"".join(parts)

    def _blocks(self, text: str) -> Iterator[str]:
        """A very long text in parts that end where a cut does."""
        at = 0
        while self.cuts is not None and len(text) - at > BLOCK_CHARS:
            end = text.find("\n", at + BLOCK_CHARS)
            if end < 0:
                break
            yield text[at:end]
            at = end
        yield text[at:]

    def decode(self, ids: bytes) -> str:
        data = b"".join([self.raw[i] for i in np.frombuffer(ids, "<u4").tolist()])
        return data[1:].decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str) -> PieceCodec:
    """One codec per worker process and file."""
    return PieceCodec(path)


def encode_documents(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian u32) of every row; narrow."""
    prepare(docs.sparkSession)
    path = model or default_path()
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, out = codec(path).encode, Rows(schema)
        for batch in batches:
            for doc_id, text in values(batch, "doc_id", "text"):
                ids = encode(text)
                out.add((doc_id, len(ids) // 4, ids), len(ids))
                if out.full():
                    yield out.take()
        yield out.take()

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, "doc_id bigint, n_tokens bigint, ids binary")


def decode_documents(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """The rows of ``encode_documents`` with ``text``, decoded from the ids."""
    path = model or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = codec(path).decode
        for batch in batches:
            text = [decode(ids) for (ids,) in values(batch, "ids")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(text, pa.string())], names=[*batch.schema.names, "text"])

    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(run, "doc_id bigint, n_tokens bigint, ids binary, text string")
