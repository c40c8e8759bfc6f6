"""Deduplicating new batches against all history.

A document is the set of its three-word sequences, as 40-bit hashes in order. It is winnowed to fingerprints: runs of neighbours in that order,
taken where the hashes are lowest, so that two documents of any length keep the same ones. Partitioned Bloom filters of everything accepted so
far screen a batch's fingerprints; positives are looked up in a fingerprint store, of which only the partitions that hold them are read. Pairs
that share enough fingerprints are verified on all their sequences; then the batch is decided in order of arrival, and store and filters take
in what was accepted. The store is a folder: another process can open it and go on.

Why runs of neighbours find every pair: let both documents together have u sequences of which at least 0.7 u are common. The others, at most
0.3 u, cut the ordered sequences into at most 0.3 u + 1 stretches of common ones; so at least 0.7 u - 2 (0.3 u + 1) = 0.1 u - 2 runs of three
lie within such a stretch. That holds for any texts, wherever the edits are, and is how documents of fewer than LONG sequences are looked up.
Longer ones are looked up with runs of four and, from VERY_LONG on, of five among the lowest hashes, of which there are some 24 to 60 common ones
at a similarity of 0.7 (hashes scatter, so the places of edits don't matter); a few of them make a candidate.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.session import Scratch, file_system, input_parts, materialize

#: Words of a sequence, and the part of all sequences of two documents that both must have, in tenths.
SHINGLE, TENTHS = 3, 7
PRINT_BITS = 40
#: Documents of up to SHORT sequences are looked up with single ones; if the larger of two has less than LONG, with runs of three, if less than
#: VERY_LONG, with runs of four, else of five. So many runs of a document are taken, about.
SHORT, LONG, VERY_LONG, WINNOWED = 28, 100, 160, 300
#: Runs of four, and of five, that two documents must share to be verified.
NEED_FOUR, NEED_FIVE = 6, 4
#: Sequences of a slice, about: what is compared at once of a very long document. Chunks of a document that are read in order together.
SLICE, STRETCH = 16_384, 512
#: Lowest hashes of a very long document that are kept aside; some WINNOWED of them are needed.
LOWEST = 600
#: Documents of a batch that may share a fingerprint; a batch with more is cut in two by arrival, as often as needed.
HOT = 4_000
#: Undecided documents and links that one task puts in order.
SETTLED = 2_000_000
BLOOM_BITS, BLOOM_HASHES = 12, 4
#: Parts of fingerprints for each split of the input, so that tasks have several small ones; and how many share a folder of the store.
PARTS, TOGETHER_IN_STORE = 12, 12
KNOWN_WORDS = 200_000
#: Chunks that are taken apart together: what a task holds as single words.
TOGETHER = 2_000
#: Pairs that a task holds before it counts them.
PAIRS_HELD = 1_000_000

_TOKEN = re.compile(r"[^\W_]+|\x01")
_NO_TIME = -(2**62)


class _Words(dict):
    """Word to 64-bit hash; forgets all when full."""

    def __missing__(self, word: str) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word) if word != "\x01" else 0
        return h


_words = _Words()


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All words of the texts as hashes, one after the other, with the first position and the number of words of each text."""
    joined = "\x01".join((t or "").replace("\x01", " ").lower() for t in texts)
    found = np.fromiter(map(_words.__getitem__, _TOKEN.findall(joined)), np.uint64)
    ends = np.append(np.flatnonzero(found == 0), len(found))
    counts = np.diff(ends, prepend=-1) - 1
    words = found[found != 0]
    return words, np.cumsum(counts) - counts, counts


def grams(words: np.ndarray, size: int) -> np.ndarray:
    """The hash of each ``size`` neighbours."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, size, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(size):
            out = out * np.uint64(0x9E3779B97F4A7C15) + words[j : j + n]
    return _mixed(out)


def sequences(words: np.ndarray) -> np.ndarray:
    """The different sequences of a run of words, in order."""
    return np.unique(grams(words, SHINGLE) >> np.uint64(64 - PRINT_BITS))


# --- arrays in columns -----------------------------------------------------------------------------------------------------------------------


def _packed(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Hashes of PRINT_BITS in bytes, ``counts`` of them in each row."""
    raw = np.ascontiguousarray(values.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - PRINT_BITS // 8 :])
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64) * (PRINT_BITS // 8)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(raw)]).cast(pa.binary())


def _unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes one after the other, how many each row has)."""
    rows = column.to_pylist()
    width = PRINT_BITS // 8
    raw = np.frombuffer(b"".join(rows), np.uint8).reshape(-1, width)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, 8 - width :] = raw
    return wide.view(">u8").ravel().astype(np.uint64), np.array([len(r) // width for r in rows], np.int64)


def _lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType = pa.int64()) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values, kind))


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The stream, which is in order of ``keys``, in tables that end where a group ends."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        for at in range(0, batch.num_rows, TOGETHER):
            part = batch.slice(at, TOGETHER)
            columns = [part.column(k).to_numpy(zero_copy_only=False) for k in keys]
            last = next((i for i in range(part.num_rows - 1, 0, -1) if any(c[i] != c[i - 1] for c in columns)), 0)
            if held and last == 0 and any(held[-1].column(k)[-1].as_py() != part.column(k)[0].as_py() for k in keys):
                yield pa.Table.from_batches(held)
                held = []
            elif last:
                yield pa.Table.from_batches([*held, part.slice(0, last)])
                held = []
            held.append(part.slice(last))
    if held:
        yield pa.Table.from_batches(held)


def _starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Where each group of a table in order begins."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for k in keys:
        c = table.column(k).to_numpy()
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


# --- documents as sets of sequences ----------------------------------------------------------------------------------------------------------

_STRETCH = "doc_id bigint, stretch int, bucket int, t bigint, sha string, words bigint, size bigint, text bigint, prints binary, head array<bigint>, tail array<bigint>"


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of documents (kind 0) and chunks (kind 1) in order of document, stretch, kind, ordinal and text: one row for each stretch."""
    names = [x.split()[0] for x in _STRETCH.split(", ")]
    edge, bits = SHINGLE - 1, np.uint64(PRINT_BITS)
    for table in _groups(batches, ["bucket", "doc_id", "stretch"]):
        starts = _starts(table, ["bucket", "doc_id", "stretch"])
        n = len(starts)
        group = np.repeat(np.arange(n), np.diff(starts, append=table.num_rows))
        kind, ordinal, texts = table.column("kind").to_numpy(), table.column("ordinal").to_numpy(), table.column("text").to_pylist()
        times, hashes = [None] * n, [None] * n
        for i in np.flatnonzero(kind == 0).tolist():
            g, t, sha = group[i], table.column("t")[i].as_py(), table.column("sha")[i].as_py()
            times[g] = t if times[g] is None else min(t, times[g])
            hashes[g] = min(filter(None, (sha, hashes[g])), default=None)
        # left over from a publish: the same text under the same ordinal
        own = [i for i in np.flatnonzero(kind == 1).tolist() if not (i and group[i] == group[i - 1] and kind[i - 1] and ordinal[i] == ordinal[i - 1] and texts[i] == texts[i - 1])]
        words, _, counts = word_hashes([texts[i] for i in own]) if own else (np.empty(0, np.uint64), None, np.empty(0, np.int64))
        owner = np.repeat(group[own].astype(np.int64), counts) if own else np.empty(0, np.int64)
        g = grams(words, SHINGLE)
        whole = owner[: len(g)] == owner[edge:] if len(g) else np.empty(0, bool)
        key = np.unique(owner[: len(g)][whole].astype(np.uint64) << bits | g[whole] >> (np.uint64(64) - bits))
        prints, sizes = key & np.uint64(2**PRINT_BITS - 1), np.bincount((key >> bits).astype(np.int64), minlength=n)
        many, ends = np.bincount(owner, minlength=n), None
        ends = np.cumsum(many)
        same = _same(prints, sizes)
        yield pa.RecordBatch.from_arrays(
            [
                *(table.column(c).combine_chunks().take(pa.array(starts)) for c in ("doc_id", "stretch", "bucket")), pa.array(times, pa.int64()), pa.array(hashes, pa.string()),
                pa.array(many), pa.array(sizes << 6), pa.array(same.view(np.int64), mask=sizes == 0), _packed(prints, sizes),
                pa.array([words[e - m : e - m + min(m, edge)].view(np.int64) for e, m in zip(ends, many)], pa.list_(pa.int64())),
                pa.array([words[e - min(m, edge) : e].view(np.int64) for e, m in zip(ends, many)], pa.list_(pa.int64())),
            ],
            names=names,
        )


def _same(prints: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """One hash of each row's set; sets can be put together by exclusive or."""
    out = np.zeros(len(sizes), np.uint64)
    some = sizes > 0
    if some.any():
        out[some] = np.bitwise_xor.reduceat(_mixed(prints ^ np.uint64(0x5851F42D4C957F2D)), (np.cumsum(sizes) - sizes)[some])
    return out


def stretches(documents: DataFrame, chunks: DataFrame, buckets: int) -> DataFrame:
    """One row for each stretch of a document: when it arrived (on the stretch of ordinal 0 only), its sha, how many words and sequences, a hash
    of the set, the sequences, and the words at its ends.

    Rows of documents go along with the chunks, so no join is needed. A null ingested_at comes first, a blank sha256 is none, of repeated rows
    of a document the earliest counts. A null ordinal counts as 0; null texts and ids give nothing.
    """
    sha = F.lower(F.trim("sha256"))
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int").alias("bucket")
    time = F.coalesce(F.unix_micros(F.col("ingested_at").cast("timestamp")), F.lit(_NO_TIME))
    docs = documents.where("doc_id is not null").select("doc_id", F.lit(0).alias("stretch"), bucket, F.lit(0).alias("kind"), F.lit(0).alias("ordinal"), F.lit(None).cast("string").alias("text"), time.alias("t"), F.when(sha != "", sha).alias("sha"))
    ordinal = F.coalesce("ordinal", F.lit(0)).cast("int")
    rows = chunks.where("doc_id is not null and text is not null").select(
        "doc_id", F.floor(ordinal / STRETCH).cast("int").alias("stretch"), bucket, F.lit(1).alias("kind"), ordinal.alias("ordinal"), "text", F.lit(None).cast("bigint").alias("t"), F.lit(None).cast("string").alias("sha")
    )
    rows = docs.unionByName(rows).repartition("bucket", "stretch").sortWithinPartitions("bucket", "doc_id", "stretch", "kind", "ordinal", "text")
    return rows.mapInArrow(_fingerprints, _STRETCH)


def _joints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sequences that cross from one stretch of a document to the next."""
    for batch in batches:
        out, counts = [], []
        for parts in batch.column("ends").to_pylist():
            tail, crossing = [], [np.empty(0, np.uint64)]
            for p in parts:
                crossing.append(sequences(np.array(tail + p["head"], np.int64).view(np.uint64)))
                tail = (tail + p["tail"])[-(SHINGLE - 1) :]
            out.append(np.concatenate(crossing))
            counts.append(len(out[-1]))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("level"), _packed(np.concatenate(out), np.array(counts))], names=["doc_id", "level", "prints"])


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row's sequences by slices: the first ``level`` bits."""
    for batch in batches:
        for doc, level, raw in zip(batch.column("doc_id").to_pylist(), batch.column("level").to_pylist(), batch.column("prints")):
            prints = np.unique(_unpacked(pa.array([raw.as_py()]))[0])
            part, counts = np.unique((prints >> np.uint64(PRINT_BITS - level)).astype(np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([doc] * len(part), pa.int64()), pa.array([level] * len(part), pa.int32()), pa.array(part), _packed(prints, counts)], names=["doc_id", "level", "slice", "prints"])


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [np.unique(_unpacked(pa.array(parts))[0]) for parts in batch.column("parts").to_pylist()]
        counts, low = np.array([len(s) for s in sets], np.int64), [s[:LOWEST] for s in sets]
        every = np.concatenate([np.empty(0, np.uint64), *sets])
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:3], pa.array(counts), pa.array(_same(every, counts).view(np.int64)), _packed(every, counts), _packed(np.concatenate([np.empty(0, np.uint64), *low]), np.array([len(x) for x in low], np.int64))],
            names=["doc_id", "level", "slice", "n", "same", "prints", "low"],
        )


def _lowest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        low = [_unpacked(pa.array(parts))[0][:LOWEST] for parts in batch.column(0).to_pylist()]
        column = _packed(np.concatenate([np.empty(0, np.uint64), *low]), np.array([len(x) for x in low], np.int64))
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], column], names=[*batch.schema.names[1:], "low"])


def long_documents(parts: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(documents, slices) of documents of more than one stretch. What crosses stretches is put in order from their ends alone, the sequences
    come together slice by slice, so no task holds a whole document."""
    level = F.greatest(F.lit(1), F.ceil(F.log2(F.sum("words") / SLICE))).cast("int").alias("level")
    heads = parts.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("stretch", "head", "tail"))).alias("ends"), level, F.min("t").alias("t"), F.min("sha").alias("sha"))
    heads = scratch.keep(heads, "long-heads")
    every = parts.join(heads.select("doc_id", "level"), "doc_id").select("doc_id", "level", "prints").unionByName(heads.select("doc_id", "level", "ends").mapInArrow(_joints, "doc_id bigint, level int, prints binary"))
    slices = every.mapInArrow(_sliced, "doc_id bigint, level int, slice bigint, prints binary").groupBy("doc_id", "level", "slice").agg(F.collect_list("prints").alias("parts"))
    slices = scratch.keep(slices.mapInArrow(_united, "doc_id bigint, level int, slice bigint, n bigint, same bigint, prints binary, low binary"), "long-slices")
    low = F.transform(F.array_sort(F.collect_list(F.struct("slice", "low"))), lambda x: x["low"]).alias("parts")
    whole = slices.groupBy("doc_id", "level").agg(low, F.sum("n").alias("n"), F.bit_xor("same").alias("text"))
    docs = whole.join(heads.select("doc_id", "t", "sha"), "doc_id").where("t is not null")
    docs = docs.select("parts", "doc_id", "t", "sha", (F.col("n") * 64 + F.col("level")).alias("size"), "text")
    return docs.mapInArrow(_lowest, "doc_id bigint, t bigint, sha string, size bigint, text bigint, low binary"), slices.select("doc_id", "level", "slice", "prints")


# --- fingerprints ----------------------------------------------------------------------------------------------------------------------------


def winnow(prints: np.ndarray, counts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, fingerprint) of each row's ordered sequences (``counts`` of them at hand, of ``sizes`` in all): runs of neighbours that begin
    below the WINNOWED lowest hashes, about."""
    row = np.repeat(np.arange(len(counts)), counts)
    below = np.minimum(1.0, WINNOWED / np.maximum(sizes, 1)) * 2.0**PRINT_BITS
    out_row, out = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
    small, middle, large = (sizes * 10 >= least * TENTHS for least in (SHORT, LONG, VERY_LONG))
    for run, who in ((1, sizes <= SHORT), (3, small & (sizes < LONG)), (4, middle & (sizes < VERY_LONG)), (5, large)):
        g = grams(prints, run)
        if len(g):
            first = row[: len(g)]
            take = who[first] & (first == row[run - 1 :]) & (prints[: len(g)] < below[first])
            out_row.append(first[take])
            out.append(g[take] >> np.uint64(64 - PRINT_BITS))
    return np.concatenate(out_row), np.concatenate(out)


def need(larger: np.ndarray) -> np.ndarray:
    """Fingerprints that two documents must share, of which the larger has so many sequences."""
    few = np.where(larger <= SHORT, -(-larger * TENTHS // 10), np.maximum(1, larger // 10 - 2))
    return np.where(larger < LONG, few, np.where(larger < VERY_LONG, NEED_FOUR, NEED_FIVE))


_POSTINGS = "part int, docs array<bigint>, sizes array<bigint>, counts array<int>, prints array<bigint>"


def _posted(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, sizes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            prints, counts = _unpacked(batch.column(2))
            row, own = winnow(prints, counts, sizes >> 6)
            part = (own % np.uint64(parts)).astype(np.int64)
            order = np.lexsort((row, part))
            row, own, part = row[order], own[order], part[order]
            new = np.flatnonzero(np.append(True, (part[1:] != part[:-1]) | (row[1:] != row[:-1]))) if len(row) else np.empty(0, np.int64)
            many = np.diff(new, append=len(row))
            each, runs = np.unique(part[new], return_counts=True)
            totals = np.bincount(part, minlength=parts)[each]
            yield pa.RecordBatch.from_arrays([pa.array(each.astype(np.int32)), _lists(docs[row[new]], runs), _lists(sizes[row[new]], runs), _lists(many.astype(np.int32), runs, pa.int32()), _lists(own.view(np.int64), totals)], names=["part", "docs", "sizes", "counts", "prints"])

    return run


def postings(units: DataFrame, parts: int) -> DataFrame:
    """The fingerprints of ``units`` (doc_id, size, prints), by parts."""
    return units.select("doc_id", "size", "prints").mapInArrow(_posted(parts), _POSTINGS)


def _flat(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, size, fingerprint) of postings."""
    column = lambda c: table.column(c).combine_chunks().flatten().to_numpy()
    counts = column("counts")
    return np.repeat(column("docs"), counts), np.repeat(column("sizes"), counts), column("prints").view(np.uint64)


def _bits(prints: np.ndarray, size: int) -> np.ndarray:
    """The positions of each fingerprint's bits: hashes by rows."""
    h = _mixed(prints)
    a, b = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    return (a[None, :] + b[None, :] * np.arange(BLOOM_HASHES, dtype=np.uint64)[:, None]) % np.uint64(size)


def bloom_build(prints: np.ndarray) -> np.ndarray:
    """The filter of the fingerprints: bytes."""
    size = max(64, BLOOM_BITS * len(prints) + 7) // 8 * 8
    flags = np.zeros(size, bool)
    flags[_bits(prints, size).ravel()] = True
    return np.packbits(flags)


def bloom_test(bits: np.ndarray, prints: np.ndarray) -> np.ndarray:
    """Which fingerprints may be in the filter."""
    size = len(bits) * 8
    at = _bits(prints, size)
    return ((bits[(at >> np.uint64(3)).astype(np.int64)] >> (7 - (at & np.uint64(7))).astype(np.uint8)) & 1).all(axis=0)


def _built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A filter of each part that the task reads; a part in several files has several."""
    seen: dict[int, list[np.ndarray]] = {}
    for batch in batches:
        for part, prints in zip(batch.column("part").to_pylist(), batch.column("prints")):
            seen.setdefault(part, []).append(np.unique(prints.values.to_numpy().view(np.uint64)))
    rows = [bloom_build(np.unique(np.concatenate(own))).tobytes() for own in seen.values()]
    yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int32()), pa.array(rows, pa.binary())], names=["part", "bits"])


_NAMES = [x.split()[0] for x in _POSTINGS.split(", ")]


def _none() -> pa.Table:
    return pa.table({n: pa.array([], t) for n, t in zip(_NAMES, (pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64())))})


def _of_part(part: int, docs: np.ndarray, sizes: np.ndarray, prints: np.ndarray) -> pa.Table:
    n = np.array([len(docs)])
    return pa.table({"part": pa.array([part], pa.int32()), "docs": _lists(docs, n), "sizes": _lists(sizes, n), "counts": _lists(np.ones(n[0], np.int32), n, pa.int32()), "prints": _lists(prints.view(np.int64), n)})


def _screened(batch: pa.Table, blooms: pa.Table) -> pa.Table:
    """A part's postings of the batch that may match: those that the filters let pass, and those of several documents of the batch."""
    if not batch.num_rows:
        return _none()
    docs, sizes, prints = _flat(batch)
    unique, at, n = np.unique(prints, return_inverse=True, return_counts=True)
    hit = n > 1
    for bits in blooms.column("bits"):
        hit |= bloom_test(np.frombuffer(bits.as_buffer(), np.uint8), unique)
    hit = hit[at]
    return _of_part(batch.column("part")[0].as_py(), docs[hit], sizes[hit], prints[hit]) if hit.any() else _none()


def _looked_up(wanted: pa.Table, store: pa.Table) -> pa.Table:
    if not wanted.num_rows or not store.num_rows:
        return _none()
    docs, sizes, prints = _flat(store)
    hit = np.isin(prints, np.unique(np.concatenate([x.values.to_numpy() for x in wanted.column("prints")])).view(np.uint64))
    return _of_part(wanted.column("part")[0].as_py(), docs[hit], sizes[hit], prints[hit])


def _counted(a: list, b: list, sa: list, sb: list) -> pa.RecordBatch:
    a, b, sa, sb = map(np.concatenate, (a, b, sa, sb))
    order = np.lexsort((b, a))
    a, b, sa, sb = a[order], b[order], sa[order], sb[order]
    new = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
    return pa.RecordBatch.from_arrays([pa.array(a[new]), pa.array(b[new]), pa.array(sa[new]), pa.array(sb[new]), pa.array(np.diff(new, append=len(a)))], names=["a", "b", "sa", "sb", "k"])


def _paired(hot: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(a, b, their sizes, k): pairs that share k fingerprints of the part, one of them new at least. A row without documents says that more
        than ``hot`` new ones share one."""
        for table in _groups(batches, ["part"]):
            starts = _starts(table, ["part"])
            for start, stop in zip(starts, np.append(starts[1:], table.num_rows)):
                group = table.slice(start, stop - start)
                docs, sizes, prints = _flat(group)
                lengths = [int(x.values.to_numpy().sum()) if len(x) else 0 for x in group.column("counts")]
                new = np.repeat(group.column("new").to_numpy(zero_copy_only=False).astype(bool), lengths)
                order = np.lexsort((docs, ~new, prints))  # new ones first
                docs, sizes, prints, new = docs[order], sizes[order], prints[order], new[order]
                n = sizes >> 6
                i = np.flatnonzero(new)
                held, d = [[], [], [], []], 0
                while len(i := i[i + d + 1 < len(prints)]):
                    d += 1
                    i = i[prints[i] == prints[i + d]]
                    if not len(i):
                        break
                    if d > hot and (many := new[i + d]).any():
                        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64())] * 4 + [pa.array([int(many.sum())])], names=["a", "b", "sa", "sb", "k"])
                        held = [[], [], [], []]
                        break
                    x, y = i, i + d
                    near = (np.minimum(n[x], n[y]) * 10 >= TENTHS * np.maximum(n[x], n[y])) & (docs[x] != docs[y])
                    x, y = x[near], y[near]
                    swap = docs[x] > docs[y]
                    x, y = np.where(swap, y, x), np.where(swap, x, y)
                    for out, values in zip(held, (docs[x], docs[y], sizes[x], sizes[y])):
                        out.append(values)
                    if sum(map(len, held[0])) > PAIRS_HELD:
                        yield _counted(*held)
                        held = [[], [], [], []]
                if any(map(len, held[0])):
                    yield _counted(*held)

    return run


def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        both = [len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(*(map(lambda r: _unpacked(pa.array([r]))[0], batch.column(c).to_pylist()) for c in (4, 5)))]
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(both, pa.int64())], names=["a", "b", "sa", "sb", "both"])


def verified(pairs: DataFrame, units: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b, sa, sb) of which at least TENTHS of all sequences occur in both. ``units``: doc_id, level, slice, prints.

    Documents in different numbers of slices are compared at the smaller number: each finer slice with the coarser one that holds it. A
    document's level is the low six bits of its size; the first stretch of one that has slices is no unit.
    """
    least = F.least(F.col("sa").bitwiseAND(F.lit(63)), F.col("sb").bitwiseAND(F.lit(63)))
    rows = pairs.withColumn("least", least)
    side = lambda me: rows.join(units.select(F.col("doc_id").alias(me), "level", "slice", F.col("prints").alias(f"prints_{me}")), me).where(F.col(f"s{me}").bitwiseAND(F.lit(63)) == F.col("level")).withColumn("at", F.expr("shiftright(slice, level - cast(least as int))")).drop("level", "slice", "least")
    both = side("a").join(side("b").drop("sa", "sb"), ["a", "b", "at"]).select("a", "b", "sa", "sb", "prints_a", "prints_b")
    counts = both.mapInArrow(_common, "a bigint, b bigint, sa bigint, sb bigint, both bigint").groupBy("a", "b", "sa", "sb").agg(F.sum("both").alias("both"))
    union = F.shiftright("sa", 6) + F.shiftright("sb", 6) - F.col("both")
    return counts.where(F.col("both") * 10 >= union * TENTHS).select("a", "b")


# --- the store -------------------------------------------------------------------------------------------------------------------------------


class Store:
    """What was accepted so far, in a folder: documents (doc_id, t, sha, size, text), units (their sequences, by bucket), postings (their
    fingerprints, by part, a folder for several) and Bloom filters of each part.

    Each batch adds files of its own; nothing is rewritten. A batch counts when its mark is written, last of all, so one that broke off leaves
    nothing but files that no one reads. Units of documents that weren't accepted stay where they are and are never asked for.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        meta = json.loads(self._text("store.json"))
        self.parts, self.buckets = meta["parts"], meta["buckets"]
        fs, at = file_system(spark, f"{self.path}/done")
        self.batches = sorted(x.getPath().getName() for x in fs.listStatus(at)) if fs.exists(at) else []
        self.places = [x for b in self.batches for x in json.loads(self._text(f"done/{b}"))]

    @classmethod
    def create(cls, spark: SparkSession, path: str, parts: int, buckets: int | None = None) -> Store:
        cls._write(spark, f"{path.rstrip('/')}/store.json", json.dumps({"parts": parts, "buckets": buckets or max(8, 8 * parts // PARTS)}))
        return cls(spark, path)

    def _text(self, name: str) -> str:
        fs, at = file_system(self.spark, f"{self.path}/{name}")
        stream = fs.open(at)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    @staticmethod
    def _write(spark: SparkSession, path: str, text: str) -> None:
        fs, at = file_system(spark, path)
        stream = fs.create(at, False)
        stream.write(bytearray(text.encode()))
        stream.close()

    def read(self, what: str, schema: str) -> DataFrame | None:
        """A table of all batches that are done."""
        paths = [f"{self.path}/{what}/batch={b}" for b in self.batches]
        rows = paths and self.spark.read.schema(schema + ", batch string").option("basePath", f"{self.path}/{what}").parquet(*paths)
        return rows.drop("batch") if paths else None

    def documents(self) -> DataFrame | None:
        return self.read("documents", "doc_id bigint, t bigint, sha string, size bigint, text bigint")

    def units(self, places: list[str] | None = None, buckets: list[int] | None = None) -> DataFrame | None:
        """doc_id, level, slice, prints at ``places`` (those of all batches that are done), of some buckets."""
        places = self.places if places is None else places
        if not places:
            return None
        rows = self.spark.read.schema("doc_id bigint, level int, slice bigint, prints binary, run string, batch int, bucket int").option("basePath", f"{self.path}/units").parquet(*(f"{self.path}/units/{x}" for x in places))
        if buckets is not None:
            rows = rows.where(F.col("bucket").isin(buckets))
        return rows.select("doc_id", F.coalesce("level", F.lit(0)).alias("level"), F.coalesce("slice", F.lit(0)).cast("bigint").alias("slice"), "prints")

    def write_units(self, rows: DataFrame, run: str) -> DataFrame:
        """Writes units, or stretches, with batch and bucket, to their place in the store; see :meth:`places_of`."""
        rows.write.partitionBy("batch", "bucket").parquet(f"{self.path}/units/run={run}")
        return self.spark.read.schema(rows.schema).parquet(f"{self.path}/units/run={run}")

    def places_of(self, runs: list[str], batch: int) -> list[str]:
        """Where the units of a batch are, of those runs that have any."""
        out = [f"run={run}/batch={batch}" for run in runs]
        return [x for x in out if file_system(self.spark, f"{self.path}/units/{x}")[0].exists(file_system(self.spark, f"{self.path}/units/{x}")[1])]

    def add(self, accepted: DataFrame, lows: DataFrame, places: list[str]) -> None:
        """Takes in the accepted documents of a batch: ``lows`` (doc_id, size, prints) as looked up, ``places`` of their units."""
        name = f"{len(self.batches):06d}-{uuid.uuid4().hex[:8]}"
        at = lambda what: f"{self.path}/{what}/batch={name}"
        accepted.write.parquet(at("documents"))
        accepted = self.spark.read.schema(accepted.schema).parquet(at("documents"))
        posted = postings(lows.join(accepted.where("text is not null").select("doc_id"), "doc_id", "left_semi"), self.parts)
        place = F.floor(F.col("part") / TOGETHER_IN_STORE).cast("int")
        posted.withColumn("place", place).repartition("place", "part").write.partitionBy("place").parquet(at("postings"))
        posted = self.spark.read.schema(_POSTINGS + ", place int").parquet(at("postings"))
        posted.select("part", "prints").mapInArrow(_built, "part int, bits binary").write.parquet(at("blooms"))
        self._write(self.spark, f"{self.path}/done/{name}", json.dumps(places))
        self.batches.append(name)
        self.places += places

    def live(self, posted: DataFrame, scratch: Scratch) -> DataFrame:
        """``posted`` with new, and the store's postings they meet: fingerprints that the Bloom filters don't let pass, and that one document of
        the batch has, are left out, and only the store's parts of the others are read."""
        if not self.batches:
            return posted.withColumn("new", F.lit(True))
        blooms = self.read("blooms", "part int, bits binary")
        own = scratch.keep(posted.groupBy("part").cogroup(blooms.groupBy("part")).applyInArrow(_screened, _POSTINGS), "live")
        there = [r[0] for r in own.select(F.floor(F.col("part") / TOGETHER_IN_STORE).cast("int")).distinct().collect()]  # numbers of folders
        stored = self.read("postings", _POSTINGS + ", place int").where(F.col("place").isin(there)).select(*_NAMES)
        hits = own.groupBy("part").cogroup(stored.groupBy("part")).applyInArrow(_looked_up, _POSTINGS)
        return own.withColumn("new", F.lit(True)).unionByName(hits.withColumn("new", F.lit(False)))


# --- a batch ---------------------------------------------------------------------------------------------------------------------------------


def _union(*frames: DataFrame | None) -> DataFrame:
    some = [f for f in frames if f is not None]
    out = some[0]
    for f in some[1:]:
        out = out.unionByName(f)
    return out


def links_of(lows: DataFrame, docs: DataFrame, places: list[str], store: Store, scratch: Scratch) -> DataFrame | None:
    """(text, other): classes of equal sets, of the batch with each other and with the store, that are near-duplicates; both ways. None if the
    batch has a fingerprint of more than HOT documents."""
    live = store.live(postings(lows, store.parts), scratch)
    pairs = live.repartition("part").sortWithinPartitions("part").mapInArrow(_paired(HOT), "a bigint, b bigint, sa bigint, sb bigint, k bigint")
    counted = scratch.keep(pairs.groupBy("a", "b", "sa", "sb").agg(F.sum("k").alias("k")).where(F.col("a").isNull() | (F.col("k") >= _need(F.shiftright(F.greatest("sa", "sb"), 6)))), "candidates")
    if not counted.where("a is null").isEmpty():
        return None
    ids = scratch.keep(counted.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "candidate-ids")
    there = [r[0] for r in ids.select(F.pmod(F.xxhash64("doc_id"), F.lit(store.buckets)).cast("int")).distinct().collect()]  # numbers of buckets
    own = scratch.keep(store.units(sorted({*store.places, *places}), there).join(ids, "doc_id", "left_semi"), "candidate-units")
    sure = verified(counted.drop("k"), own)
    named = _union(docs.select("doc_id", "text"), store.batches and store.documents().select("doc_id", "text") or None).join(ids, "doc_id", "left_semi")
    sure = sure.join(named.select(F.col("doc_id").alias("a"), F.col("text").alias("x")), "a").join(named.select(F.col("doc_id").alias("b"), F.col("text").alias("y")), "b").where("x <> y")
    return scratch.keep(sure.select(F.explode(F.array(F.struct(F.col("x").alias("text"), F.col("y").alias("other")), F.struct(F.col("y").alias("text"), F.col("x").alias("other")))).alias("l")).select("l.*").distinct(), "links")


def _need(larger):
    few = F.when(larger <= SHORT, F.ceil(larger * TENTHS / 10)).otherwise(F.greatest(F.lit(1), F.floor(larger / 10) - 2))
    return F.when(larger < LONG, few).when(larger < VERY_LONG, NEED_FOUR).otherwise(NEED_FIVE)


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text, sha, near) in order of arrival: the doc_id of those that repeat nothing accepted before them here."""
    texts, shas = set(), set()
    for batch in batches:
        out = []
        for doc, text, sha, near in zip(*(c.to_pylist() for c in batch.columns)):
            if (text is None or text not in texts) and (sha is None or sha not in shas) and texts.isdisjoint(near or ()):
                out.append(doc)
                texts |= {text} - {None}
                shas |= {sha} - {None}
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], names=["doc_id"])


def _repeating(rest: DataFrame, accepted: DataFrame, links: DataFrame, columns: list[str]) -> DataFrame:
    """(``columns``, first): each of ``rest`` with the accepted documents before it that it repeats. No two of these share a text or a sha."""
    a = accepted.select(F.col("doc_id").alias("first"), F.col("t").alias("first_t"), F.col("text").alias("other"), F.col("sha").alias("a_sha"))
    linked = rest.join(links, "text").unionByName(rest.where("text is not null").withColumn("other", F.col("text")))
    found = linked.join(a.drop("a_sha"), "other").drop("other").unionByName(rest.join(a.drop("other"), rest["sha"] == a["a_sha"]).drop("a_sha"))
    return found.where("first_t < t or first_t = t and first < doc_id").select(*columns, "first").distinct()


def decide(docs: DataFrame, links: DataFrame, store: Store, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(accepted, repeats (doc_id, first)): a document is accepted unless it repeats an accepted one that came before it.

    Of documents with the same text and sha only the first can be accepted, so they are one. What has no copy and no link is accepted at once.
    The rest is put in order by blocks of SETTLED documents and links, one task each, whatever chains they form.
    """
    old = store.documents()
    node = F.min(F.struct("t", "doc_id")).alias("at")
    bare = docs.where("text is null and sha is null")
    nodes = docs.where("text is not null or sha is not null").groupBy("text", "sha").agg(node).select("text", "sha", "at.t", "at.doc_id")
    nodes = scratch.keep(nodes, "nodes")
    if old is not None:
        nodes = nodes.join(_repeating(nodes, old, links, ["doc_id"]).select("doc_id").distinct(), "doc_id", "left_anti")
    n_text, n_sha = (nodes.where(f"{c} is not null").groupBy(c).agg(F.count("*").alias(f"n_{c}")).where(f"n_{c} > 1") for c in ("text", "sha"))
    near = links.groupBy("text").agg(F.collect_set("other").alias("near"))
    rest = nodes.join(n_text, "text", "left").join(n_sha, "sha", "left").join(near, "text", "left")
    rest = scratch.keep(rest.withColumn("tied", F.coalesce("n_text", "n_sha", F.size("near")).isNotNull() & (F.col("n_text").isNotNull() | F.col("n_sha").isNotNull() | F.col("near").isNotNull())).select("doc_id", "t", "text", "sha", "near", "tied"), "tied")
    accepted = [bare.select("doc_id"), rest.where("not tied").select("doc_id")]
    rest = rest.where("tied").drop("tied")
    weight = F.sum(1 + F.coalesce(F.size("near"), F.lit(0))).alias("w")
    while total := rest.agg(weight).first()[0]:
        now = rest
        if total > SETTLED:
            cut = rest.approxQuantile("t", [SETTLED / total], 0.01)[0]
            now = rest.where(F.col("t") <= cut)
        order = now.repartition(1).sortWithinPartitions("t", "doc_id").select("doc_id", "text", "sha", "near")
        ids = scratch.keep(order.mapInArrow(_in_order, "doc_id bigint"), "accepted")
        accepted.append(ids)
        if now is rest:
            break
        left = rest.join(now.select("doc_id"), "doc_id", "left_anti")
        rest = scratch.keep(left.join(_repeating(left.drop("near"), now.join(ids, "doc_id", "left_semi"), links, ["doc_id"]).select("doc_id"), "doc_id", "left_anti"), "rest")
    whole = scratch.keep(docs.join(_union(*accepted), "doc_id", "left_semi"), "accepted-documents")
    return whole, _repeating(docs.join(whole.select("doc_id"), "doc_id", "left_anti"), _union(old, whole), links, ["doc_id"])


def ingest(docs: DataFrame, lows: DataFrame, places: list[str], store: Store, scratch: Scratch, keep: bool = True) -> list[DataFrame]:
    """(doc_id, first) of one batch, in one frame or several; the store takes in what is accepted (the last batch of a replay needn't be kept).

    docs: doc_id, t, sha, size, text. lows: doc_id, size, prints, of which the lowest hashes count. places: where their units are in the store.
    """
    # one document of each class of equal sets is looked up
    first = docs.where("text is not null").groupBy("text").agg(F.min("doc_id").alias("stands"))
    others = scratch.keep(docs.join(first, "text").where("doc_id <> stands").select("doc_id"), "copies")
    links = places and links_of(lows.join(others, "doc_id", "left_anti"), docs, places, store, scratch)
    if links == []:
        links = docs.sparkSession.createDataFrame([], "text bigint, other bigint")
    if links is None:
        by = "t" if docs.select("t").distinct().limit(2).count() > 1 else "doc_id"
        low, middle = docs.approxQuantile(by, [0.0, 0.5], 0.01)
        cut = F.col(by) <= F.lit(middle) if middle < docs.agg(F.max(by)).first()[0] else F.col(by) <= F.lit(low)
        return [x for half, last in ((docs.where(cut), False), (docs.where(~cut), True)) for x in ingest(scratch.keep(half, "half"), lows.join(half.select("doc_id"), "doc_id", "left_semi"), places, store, scratch, keep or not last)]
    accepted, repeats = decide(docs, links, store, scratch)
    repeats = scratch.keep(repeats, "repeats")
    if keep:
        store.add(accepted, lows, places)
    return [repeats]


def prepared(documents: DataFrame, chunks: DataFrame, store: Store, scratch: Scratch, cuts: list[int]) -> tuple[DataFrame, DataFrame, list[str]]:
    """(docs, lows) as :func:`ingest` takes them, with the number of the batch of each document, and the runs that hold the units."""
    number = sum(((F.col("t") >= F.lit(int(c))).cast("int") for c in cuts), F.lit(0)).alias("batch")
    runs = [uuid.uuid4().hex]
    rows = store.write_units(stretches(documents, chunks, store.buckets).select("*", F.when(F.col("t").isNotNull(), number).otherwise(F.lit(-1)).alias("batch")), runs[0])
    long = scratch.keep(rows.where("stretch <> 0").select("doc_id").distinct(), "long")
    docs = lows = rows.where("t is not null")
    if not long.isEmpty():
        long_docs, slices = long_documents(rows.join(long, "doc_id", "left_semi").drop("batch"), scratch)
        long_docs = scratch.keep(long_docs.select("*", number), "long-documents")
        few = docs.join(long, "doc_id", "left_anti")
        docs, lows = few.unionByName(long_docs.drop("low"), allowMissingColumns=True), few.select("batch", "doc_id", "size", "prints").unionByName(long_docs.select("batch", "doc_id", "size", F.col("low").alias("prints")))
        runs.append(uuid.uuid4().hex)
        slices = slices.join(long_docs.select("doc_id", "batch"), "doc_id").withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(store.buckets)).cast("int"))
        store.write_units(slices.repartition("batch", "bucket"), runs[1])
    docs = scratch.keep(docs.select("batch", "doc_id", "t", "sha", "size", "text"), "documents", ("batch",))
    return docs, lows.where("size >= 64").select("batch", "doc_id", "size", "prints"), runs


def add_batch(documents: DataFrame, chunks: DataFrame, store: Store) -> DataFrame:
    """doc_id, first: the documents of a new batch that repeat accepted ones, of the store or of the batch; the store takes in the others.
    ``chunks`` are those of the batch. The result is written beside the store."""
    scratch = Scratch(documents.sparkSession, "dedup-batch")
    try:
        docs, lows, runs = prepared(documents, chunks, store, scratch, [])
        out = _union(*ingest(docs.drop("batch"), lows.drop("batch"), store.places_of(runs, 0), store, scratch))
        path = f"{store.path}/repeats/{uuid.uuid4().hex}"
        out.write.parquet(path)
    finally:
        scratch.close()
    return store.spark.read.schema("doc_id bigint, first bigint").parquet(path)


def found(documents: DataFrame, chunks: DataFrame, batches: int | None = 2) -> DataFrame:
    """p1_found: doc_a, doc_b (doc_a < doc_b) of documents and the accepted earlier ones that they repeat.

    The arrivals are replayed against a store of their own in ``batches`` batches cut at days (None: one for each day): the first is the
    history that the later ones are checked against. All are fingerprinted in one pass. How arrivals are cut changes nothing in the result,
    since each batch is decided in order of arrival. Empty tables give no rows.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "dedup")
    day = F.unix_micros(F.date_trunc("day", F.col("ingested_at").cast("timestamp")))
    days = documents.where("ingested_at is not null").select(day.alias("day"))
    if batches is None:
        cuts = sorted(r.day for r in days.distinct().collect())[1:]  # one row a day
    else:
        cuts = sorted({int(c) for c in days.approxQuantile("day", [1 - 1 / (k + 1) for k in range(batches - 1, 0, -1)], 0.01)}) if batches > 1 else []
    parts = PARTS * max(2, input_parts(chunks))
    store = Store.create(spark, f"{scratch.path}/store", parts)
    docs, lows, runs = prepared(documents, chunks, store, scratch, cuts)
    out = []
    for k in range(len(cuts) + 1):
        of = lambda x: x.where(F.col("batch") == k).drop("batch")  # noqa: B023, E731
        out += ingest(of(docs), of(lows), store.places_of(runs, k), store, scratch, keep=k < len(cuts))
    pairs = _union(*out).select(F.least("doc_id", "first").alias("doc_a"), F.greatest("doc_id", "first").alias("doc_b"))
    return _kept(pairs.distinct(), scratch)


def _kept(df: DataFrame, scratch: Scratch) -> DataFrame:
    """The result, written outside the folder of intermediate tables, which goes."""
    out = materialize(df, "repeats")
    scratch.close()
    return out
