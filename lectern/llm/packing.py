"""Packing of token ids into windows by multiway differencing.

Texts are tokenized once, in the tasks that scan them; whole windows of a text are
sequences of their own. What is left over is cut into pieces of bounded length, and
pieces are dealt into groups of bounded size by a hash. In a group, Karmarkar-Karp
differencing starts from one partial partition per piece and always merges the two
with the largest imbalance, heaviest windows of one with lightest of the other; this
gives windows of nearly equal length. If one exceeds the capacity, the number of
windows rises by one and the group is packed again.
"""

from __future__ import annotations

import heapq
import os
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import Words, mix, text_parts
from lectern.llm.wordids import MOST, WordIds

WINDOW = 2048
#: Longest piece of what is left of a text after its whole windows.
PIECE = 384
#: Texts whose pieces make one group, on average.
GROUP_TEXTS = 384


def differencing(sizes: np.ndarray, k: int) -> np.ndarray:
    """The window (0 to k-1) of each piece."""
    n = len(sizes)
    loads: list[np.ndarray | None] = []
    heap, merges = [], []
    for i, size in enumerate(sizes.tolist()):
        one = np.zeros(k, np.int64)
        one[0] = size
        loads.append(one)
        heap.append((-size, i))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        summed = loads[a] + loads[b][::-1]
        order = np.argsort(-summed, kind="stable")
        loads[a] = loads[b] = None
        loads.append(summed[order])
        merges.append((a, b, order))
        new = loads[-1]
        heapq.heappush(heap, (int(new[-1] - new[0]), len(loads) - 1))
    # back down: slot[j] is the final window that stands at place j of a partial partition
    out = np.zeros(n, np.int64)
    slots = {len(loads) - 1: np.arange(k)}
    for node in range(len(loads) - 1, -1, -1):
        slot = slots.pop(node)
        if node < n:
            out[node] = slot[0]
            continue
        a, b, order = merges[node - n]
        back = np.empty(k, np.int64)
        back[order] = slot
        slots[a], slots[b] = back, back[::-1]
    return out


def pack(sizes: np.ndarray, capacity: int = WINDOW) -> np.ndarray:
    """Windows of pieces that are no longer than the capacity."""
    if not len(sizes):
        return np.empty(0, np.int64)
    k = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        window = differencing(sizes, k)
        if np.bincount(window, sizes, minlength=k).max() <= capacity:
            return window
        k += 1


def encode_words(path: str):
    """Ids of single words; the threads of the tokenizer stay off inside a task."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    return lambda words: [e.ids for e in made.encode_batch([w.decode() for w in words], add_special_tokens=False)]


@cache
def store(path: str, words: int = MOST) -> WordIds:
    return WordIds(encode_words(path), words)


def cut_words(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, end, bounds of words cut once more before a full stop or comma behind an ASCII letter.

    The pre-tokenizer starts a token at white space and where a run of letters ends, so these cuts change no id.
    """
    b = words.bytes
    low = b | np.uint8(32)
    letter = (low >= 97) & (low <= 122)
    cut = np.flatnonzero(letter[:-1] & ((b[1:] == 46) | (b[1:] == 44))) + 1
    start = np.sort(np.concatenate([words.start, cut]))
    end = np.sort(np.concatenate([words.end, cut]))
    return start, end, np.searchsorted(start, words.text_start)


def tokenized(docs: DataFrame, tokenizer: str, tail: int, window: int, piece: int, groups: int, words: int = MOST) -> DataFrame:
    """(group, doc_id, start, length, doc_tokens, ids) of each piece, ids as little-endian unsigned 32-bit numbers."""
    most = words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = store(tokenizer, most)
        task, row = TaskContext.get().partitionId(), 0
        for batch in batches:
            for part, texts in text_parts(batch.column(1)):
                words = Words(texts)
                start, end, bounds = cut_words(words)
                words.start, words.end = start, end
                ids, ends = known.ids(words.raw, words.hashes(), start, end, bounds, tail)
                del words
                out = {"row": [], "start": [], "length": [], "doc_tokens": []}
                for i, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
                    whole = (b - a) // window * window
                    left = b - a - whole
                    parts = -(-left // piece)
                    marks = [*range(0, whole + 1, window), *(whole + left * (j + 1) // parts for j in range(parts))]
                    for x, y in zip(marks, marks[1:]):
                        out["row"].append(i)
                        out["start"].append(x)
                        out["length"].append(y - x)
                        out["doc_tokens"].append(b - a)
                at, n = np.array(out["row"]), len(out["row"])
                group = mix(np.arange(row, row + n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(task))
                row += n
                flat = memoryview(ids.astype("<u4").tobytes())
                first = (ends[at] + np.array(out["start"])) * 4
                last = first + np.array(out["length"]) * 4
                for s in range(0, n, 2000):
                    e = min(n, s + 2000)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array((group[s:e] % np.uint64(groups)).astype(np.int64)),
                            batch.column(0).take(pa.array(at[s:e] + part.start)),
                            *(pa.array(out[c][s:e], pa.int64()) for c in ("start", "length", "doc_tokens")),
                            pa.array([bytes(flat[x:y]) for x, y in zip(first[s:e], last[s:e], strict=True)], pa.binary()),
                        ],
                        ["group", "doc_id", "start", "length", "doc_tokens", "ids"],
                    )

    schema = f"group long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, start long, length long, doc_tokens long, ids binary"
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def packed(
    docs: DataFrame, tokenizer: str, *, tail: int = 1, window: int = WINDOW, piece: int = PIECE, group_texts: int = GROUP_TEXTS, words: int = MOST
) -> DataFrame:
    """doc_id, start, length, doc_tokens, sequence_id, offset, ids of every piece.

    A task keeps the ids of ``words`` words at most. A null or empty text is its closing id alone. Rows are packed each for itself, whatever their doc_id;
    ids of sequences are unique and not consecutive.
    """
    groups = max(1, -(-docs.count() // group_texts))
    pieces = tokenized(docs, tokenizer, tail, window, min(piece, window), groups, words)

    def fill(table: pa.Table) -> pa.Table:
        length = table["length"].to_numpy()
        order = np.lexsort((table["start"].to_numpy(), table["doc_id"].fill_null(-1).to_numpy()))
        table, length = table.take(pa.array(order)), length[order]
        full = length == window
        n = int(full.sum())
        sequence = np.empty(len(length), np.int64)
        sequence[full] = np.arange(n)
        sequence[~full] = n + pack(length[~full], window)
        by = np.argsort(sequence, kind="stable")
        offset = np.empty(len(length), np.int64)
        before = np.concatenate([[0], np.cumsum(length[by])[:-1]])
        new = np.concatenate([[True], np.diff(sequence[by]) != 0])
        offset[by] = before - np.maximum.accumulate(np.where(new, before, 0))
        group = table["group"][0].as_py()
        return pa.table(
            {
                **{c: table[c] for c in ("doc_id", "start", "length", "doc_tokens")},
                "sequence_id": pa.array((group << 24) + sequence),
                "offset": pa.array(offset),
                "ids": table["ids"],
            }
        )

    schema = f"doc_id {pieces.schema['doc_id'].dataType.simpleString()}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
    return pieces.groupBy("group").applyInArrow(fill, schema)


def digest(packed_rows: DataFrame) -> DataFrame:
    crc: Column = F.crc32("ids")
    return packed_rows.select("doc_id", "start", "length", crc.alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
