"""Encoding a corpus with a public byte-level BPE: corpus-level merge replay.

The different words of the whole corpus are gathered once; an inverted index from token pair to word positions then applies every merge in
rank order to all words at the same time, touching only the neighbours of a merged pair. Documents get their ids back by block.
"""

from __future__ import annotations

import heapq
import json
import os
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.session import input_parts, materialize

TOKENIZERS = os.environ.get("LODESTRATA_TOKENIZERS", "/opt/tokenizers")
BYTE_BPE_50K = "byte_bpe_50k.json"
#: The public split pattern of the vocabulary (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Blocks of documents in each input split: a block's text and its words are what one task holds.
BLOCKS_PER_SPLIT = 4

_WORDS = regex.compile(PATTERN)
#: Where a space follows white space, a cut before each space may part what the pattern keeps together.
_ODD = re.compile(r"\s ")


def words_of(text: str) -> list[str]:
    """The words that merges never cross."""
    return _WORDS.findall(text)


def pieces_of(text: str) -> tuple[list[str], list[str]]:
    """Pieces whose words, one after the other, are the words of the text: those taken as they are, then those that follow a space.

    The pattern always cuts before a space that a sign follows, so a plain split at spaces cuts in the right places.
    """
    if _ODD.search(text):
        return _WORDS.findall(text), []
    first, *rest = text.split(" ")
    return [first] if first else [], rest


@cache
def vocabulary(path: str) -> tuple[dict[bytes, int], dict[tuple[int, int], tuple[int, int]]]:
    """Ids of the single bytes, and for each pair of ids (rank, id) of its merge."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab = model["vocab"]
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    sign = dict(zip(printable, map(chr, printable))) | {b: chr(256 + n) for n, b in enumerate(b for b in range(256) if b not in printable)}
    pairs = {}
    for rank, merge in enumerate(model["merges"]):
        a, b = merge if isinstance(merge, list) else merge.split(" ")
        pairs.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
    return {bytes([b]): vocab[s] for b, s in sign.items()}, pairs


def replay(words: list[str], path: str) -> list[list[int]]:
    """The ids of each word, by one replay of all merges over all words.

    A merge's result only takes part in merges of higher rank, so taking ranks in ascending order from a heap meets each pair after all that
    could make it; equal pairs that overlap are merged from the left.
    """
    single, pairs = vocabulary(path)
    byte_id = [single[bytes([b])] for b in range(256)]
    ids: list[int] = []
    ends = []
    for w in words:
        ids.extend(map(byte_id.__getitem__, w.encode("utf-8", "surrogatepass")))
        ids.append(-1)  # no pair has it, so no merge crosses words
        ends.append(len(ids))
    n = len(ids)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    where: dict[tuple[int, int], list[int]] = defaultdict(list)
    for i, pair in enumerate(zip(ids, ids[1:])):
        if pair in pairs:
            where[pair].append(i)
    heap = [(*pairs[p], p) for p in where]
    heapq.heapify(heap)
    while heap:
        _, new, pair = heapq.heappop(heap)
        a, b = pair
        for i in sorted(where.pop(pair, ())):
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            k, h = after[j], before[i]
            ids[i], ids[j], after[i] = new, -2, k  # -2: merged into its left neighbour
            if k < n:
                before[k] = i
            for at, p in ((h, (ids[h], new) if h >= 0 else None), (i, (new, ids[k]) if k < n else None)):
                if p in pairs:
                    if p not in where:
                        heapq.heappush(heap, (*pairs[p], p))
                    where[p].append(at)
    out, start = [], 0
    for end in ends:
        out.append([x for x in ids[start : end - 1] if x != -2])
        start = end
    return out


def _distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, word), each once a task and block."""
    seen: dict[int, set[str]] = defaultdict(set)
    for batch in batches:
        texts = defaultdict(lambda: (set(), set()))
        for block, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if text:
                for pieces, new in zip(texts[block], pieces_of(text)):
                    pieces.update(new)
        for block, (plain, spaced) in texts.items():
            seen[block].update(chain.from_iterable(map(words_of, plain)), chain.from_iterable(words_of(" " + x) for x in spaced))
    for block, own in seen.items():
        for part in _slices(list(own), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array([block] * len(part), pa.int32()), pa.array(part, pa.string())], names=["block", "word"])


def _slices(rows: list, size: int) -> Iterator[list]:
    for i in range(0, len(rows), size):
        yield rows[i : i + size]


def _replayed(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(replay(words, path), pa.list_(pa.int32()))], names=["word", "ids"])

    return run


def word_ids(words: DataFrame, path: str) -> DataFrame:
    """word, ids of each different word of ``words``."""
    return words.select("word").distinct().mapInArrow(_replayed(path), "word string, ids array<int>")


def _joined(counts: bool, path: str):
    def run(docs: pa.Table, words: pa.Table) -> pa.Table:
        ids = words.column("ids").combine_chunks()
        flat, offsets = ids.flatten().to_numpy(), ids.offsets.to_numpy() - (ids.offsets[0].as_py() if len(ids.offsets) else 0)
        place = dict(zip(words.column("word").to_pylist(), range(len(ids))))
        own = [flat[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        none = np.empty(0, np.int32)

        class Known(dict):
            """Piece to ids, filled as pieces come."""

            def __init__(self, lead: str):
                self.lead = lead

            def __missing__(self, piece: str) -> np.ndarray:
                words = words_of(self.lead + piece)
                # a split that was cut in another way the second time has words that its block doesn't know
                got = self[piece] = np.concatenate([own[place[w]] if w in place else np.array(replay([w], path)[0], np.int32) for w in words])
                return got

        plain, spaced = Known(""), Known(" ")
        out = []
        for text in docs.column("text").to_pylist():
            heads, rest = pieces_of(text) if text else ([], [])
            parts = [*map(plain.__getitem__, heads), *map(spaced.__getitem__, rest)]
            out.append(np.concatenate(parts) if parts else none)
        sizes = np.array([len(x) for x in out], np.int64)
        if counts:
            value = pa.array(sizes)
        else:
            value = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(np.concatenate(out) if out else none, pa.int32()))
        return pa.table([docs.column("doc_id"), value], names=["doc_id", "tokens" if counts else "ids"])

    return run


def _blocks(docs: DataFrame) -> DataFrame:
    """Each document with its block: its input split, and a part of it by hash. Splits are the same each time a table is read."""
    block = F.spark_partition_id() * BLOCKS_PER_SPLIT + F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(BLOCKS_PER_SPLIT)).cast("int")
    return docs.select("doc_id", F.col("text").cast("string").alias("text"), block.alias("block"))


def _encoded(docs: DataFrame, path: str, counts: bool) -> DataFrame:
    blocks = _blocks(docs)
    # words are gathered where the texts lie; texts move once, to meet the ids of their block's words
    words = materialize(blocks.select("block", "text").mapInArrow(_distinct_words, "block int, word string"), "words")
    needed = words.join(word_ids(words, path), "word").select("block", "word", "ids")
    kind = "tokens bigint" if counts else "ids array<int>"
    many = BLOCKS_PER_SPLIT * input_parts(docs)
    return blocks.repartition(many, "block").groupBy("block").cogroup(needed.repartition(many, "block").groupBy("block")).applyInArrow(_joined(counts, path), f"doc_id bigint, {kind}")


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids of each row of ``docs`` (doc_id, text, whatever else), without special tokens; their strings are ordinary text.

    Empty and null texts give the empty list, a null doc_id stays, a repeated row gives its result again, an empty table an empty one.
    ``path`` is the vocabulary's file; every executor must have it there.
    """
    return _encoded(docs, path or f"{TOKENIZERS}/{BYTE_BPE_50K}", False)


def count(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, tokens: the length of what :func:`encode` gives."""
    return _encoded(docs, path or f"{TOKENIZERS}/{BYTE_BPE_50K}", True)
