"""SentencePiece vocabularies: encoding by shared-prefix Viterbi, and decoding.

A text with a space before it is cut into marked words (spaces, then anything but
spaces); no vocabulary piece reaches over such a border, so a word's best path is
its own. The distinct words of a chunk are sorted, which lays out their trie depth
first: going from one word to the next, forward scores of the common prefix stand
and only the rest of the word is extended.

The path has the largest sum of piece scores; of equal sums the one whose last piece
is longest, from the end on. A character that no piece covers becomes its UTF-8 bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from lectern.llm.common import Words, text_parts
from lectern.llm.wordids import WordIds

# Fixed values of the format: the mark that stands for a space, and what an uncovered character costs beyond the least score.
MARK = "▁"
PENALTY = 10.0


class Vocabulary:
    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.byte_ids, self.scores, self.as_bytes = {}, {}, []
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_ids[value] = i
                self.as_bytes.append(bytes([value]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.as_bytes.append(b"")
            else:
                self.scores[piece] = (model.get_score(i), i)
                self.as_bytes.append(piece.replace(MARK, " ").encode())
        self.unknown_id = model.unk_id()
        self.longest = max(map(len, self.scores), default=1)
        self.unknown = min((s for s, _ in self.scores.values()), default=0.0) - PENALTY
        if any(MARK in p.lstrip(MARK) for p in self.scores):
            raise ValueError("pieces of this vocabulary reach over spaces")
        self.breaks = not any("\n" in p for p in self.scores)  # a line feed then stands alone
        size = np.fromiter(map(len, self.as_bytes), np.int64, n)
        self.size, self.first = size, np.concatenate([[0], np.cumsum(size)[:-1]])
        self.flat = np.frombuffer(b"".join(self.as_bytes), np.uint8)

    def fallback(self, char: str) -> list[int]:
        return [self.byte_ids.get(b, self.unknown_id) for b in char.encode("utf-8", "replace")]

    def encode_sorted(self, words: list[str]) -> Iterator[list[int]]:
        """Ids of sorted marked words; the stacks hold the forward pass along the current branch of the trie."""
        scores, longest, unknown = self.scores, self.longest, self.unknown
        best, back, last = [0.0], [(0, -1)], ""
        for word in words:
            depth = len(commonprefix((last, word)))
            del best[depth + 1 :], back[depth + 1 :]
            for end in range(depth + 1, len(word) + 1):
                top, how = None, None
                for begin in range(max(0, end - longest), end):
                    found = scores.get(word[begin:end])
                    if found is not None:
                        sum_ = best[begin] + found[0]
                        if top is None or sum_ > top:
                            top, how = sum_, (begin, found[1])
                if word[end - 1] not in scores:
                    sum_ = best[end - 1] + unknown
                    if top is None or sum_ > top:
                        top, how = sum_, (end - 1, -1)
                best.append(top)
                back.append(how)
            last, out, end = word, [], len(word)
            while end:
                begin, piece = back[end]
                out.append([piece] if piece >= 0 else self.fallback(word[begin:end]))
                end = begin
            yield [i for part in reversed(out) for i in part]

    def encode(self, words: list[bytes]) -> list[list[int]]:
        text = [w.decode().replace(" ", MARK) for w in words]
        order = sorted(range(len(text)), key=text.__getitem__)
        out: list[list[int]] = [[]] * len(text)
        for i, ids in zip(order, self.encode_sorted([text[i] for i in order]), strict=True):
            out[i] = ids
        return out

    def decode(self, ids: np.ndarray) -> str:
        """Pieces put together, without the space at the start; bytes that are no UTF-8 become U+FFFD."""
        size = self.size[ids]
        sums = np.concatenate([[0], np.cumsum(size)])
        at = np.repeat(self.first[ids] - sums[:-1], size) + np.arange(sums[-1])
        return self.flat[at].tobytes().decode("utf-8", "replace").removeprefix(" ")


@cache
def loaded(path: str) -> tuple[Vocabulary, WordIds]:
    v = Vocabulary(path)
    return v, WordIds(v.encode)


class MarkedWords(Words):
    """Words that begin with their spaces; a line feed is a word of its own where ``breaks``."""

    def __init__(self, texts: list[str | None], breaks: bool):
        parts = [b" " + t.encode("utf-8", "replace") if t else b"" for t in texts]
        self.raw = b"".join(parts)
        b = self.bytes = np.frombuffer(self.raw, np.uint8)
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        self.text_start = np.concatenate([[0], np.cumsum(lengths)])
        first = np.zeros(len(b) + 1, bool)
        space = b == 32
        first[1:-1] = space[1:] & ~space[:-1]
        if breaks:
            feed = np.flatnonzero(b == 10)
            first[feed] = True
            first[feed + 1] = True
        first[self.text_start] = True
        marks = np.flatnonzero(first[:-1]) if len(b) else np.empty(0, np.int64)
        self.start, self.end = marks, np.concatenate([marks[1:], [len(b)]])[: len(marks)]
        self.bounds = np.searchsorted(self.start, self.text_start)


def encoded(docs: DataFrame, model: str) -> DataFrame:
    """All columns of ``docs`` with ``ids`` (array of int; replaces a column of this name).

    A null text has null ids, an empty one none.
    """
    docs = docs.drop("ids")
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, known = loaded(model)
        for batch in batches:
            for part, texts in text_parts(batch.column(at)):
                some = batch.slice(part.start, part.stop - part.start)
                w = MarkedWords(texts, vocabulary.breaks)
                ids, ends = known.ids(w.raw, w.hashes(), w.start, w.end, w.bounds, None)
                null = pa.array([t is None for t in texts])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids.astype(np.int32)), mask=null)
                yield pa.RecordBatch.from_arrays([*some.columns, lists], [*some.schema.names, "ids"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("ids", ArrayType(IntegerType()))]))


def decoded(rows: DataFrame, model: str, name: str = "decoded") -> DataFrame:
    """All columns of ``rows`` with the text of ``ids`` (replaces a column of this name); null for null."""
    rows = rows.drop(name)
    at = rows.columns.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, _ = loaded(model)
        for batch in batches:
            lists = batch.column(at)
            flat, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            texts = [
                None if missing else vocabulary.decode(flat[a:b])
                for a, b, missing in zip(ends[:-1], ends[1:], lists.is_null().to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, name])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField(name, StringType())]))
