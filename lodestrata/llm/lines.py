"""Lines repeated across the documents of one source: suffix arrays over line identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestrata.session import Scratch, materialize

MIN_WORDS = 4
MIN_DOCS = 5
MIN_SHARE = 0.05


def line_key(line: Column) -> Column:
    """What is left of a line when case, spacing, digits and signs don't count: its lower-case letters."""
    return F.regexp_replace(F.replace(F.lower(line), F.lit("ß"), F.lit("ss")), r"[^\p{L}]+", "")


def lines_of(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """One row per line of at least MIN_WORDS words: chunk_id, line_no (from 1, blank lines counted), doc_id, source, line (its identifier).

    The identifier is a 64-bit hash of source and key. Rows with null text, id or doc_id, and documents without source, give no rows.
    """
    docs = documents.select("doc_id", "source").where("doc_id is not null and source is not null").distinct()
    parts = chunks.select(F.col("id").alias("chunk_id"), "doc_id", "text").where("id is not null and doc_id is not null and text is not null")
    lines = (
        parts.select("chunk_id", "doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
        .where(F.col("line").rlike(rf"(?:\p{{L}}++[^\p{{L}}]++){{{MIN_WORDS - 1}}}\p{{L}}"))
        .select("chunk_id", "doc_id", (F.col("pos") + 1).alias("line_no"), F.xxhash64(line_key(F.col("line"))).alias("key"))
    )
    return lines.join(docs, "doc_id").select("chunk_id", "line_no", "doc_id", "source", F.xxhash64("source", "key").alias("line"))


def source_sizes(documents: DataFrame) -> DataFrame:
    """Rows of documents of each source, as stored."""
    return documents.where("source is not null").groupBy("source").agg(F.count("*").alias("n_rows"))


def shared_lines(lines: DataFrame) -> DataFrame:
    """source, line of the lines that stand in more than one document of their source. All others are in no repeated block whatever the
    thresholds. Counting (line, document) pairs first keeps a hot line apart."""
    return lines.select("source", "line", "doc_id").distinct().groupBy("source", "line").agg(F.count("*").alias("n")).where("n > 1").select("source", "line")


def runs_of(kept: DataFrame) -> DataFrame:
    """Unbroken runs of repeated lines within a chunk: source, chunk_id, doc_id, ids (identifiers in order), first (line_no of each)."""
    w = W.partitionBy("chunk_id").orderBy("line_no")
    runs = kept.dropDuplicates(["chunk_id", "line_no"]).withColumn("run", F.col("line_no") - F.row_number().over(w))
    both = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    return runs.groupBy("source", "chunk_id", "doc_id", "run").agg(both.alias("both")).select("source", "chunk_id", "doc_id", F.col("both.line").alias("ids"), F.col("both.line_no").alias("nos"))


def _suffixes(ids: str = "ids"):
    return F.transform(F.sequence(F.lit(1), F.size(ids)), lambda i: F.slice(ids, i, F.size(ids)))


def suffix_array(runs: DataFrame) -> DataFrame:
    """The suffix array of each source: source, suffix, rank (among those that begin with the same line), lcp (with the suffix before it), n
    (occurrences).

    Equal suffixes are one row with their count before anything is sorted, and suffixes are sorted apart for each first line, since those of
    different ones have no common prefix; so a source that holds a third of all rows isn't sorted in one place. A run ends at its chunk's end,
    as a separator would end it in the concatenation.
    """
    distinct = runs.select("source", F.explode(_suffixes()).alias("suffix")).groupBy("source", "suffix").agg(F.count("*").alias("n"))
    w = W.partitionBy("source", F.col("suffix")[0]).orderBy("suffix")
    before = F.coalesce(F.lag("suffix").over(w), F.array().cast("array<bigint>"))
    same = F.transform(F.arrays_zip(F.col("suffix").alias("a"), F.col("before").alias("b")), lambda p: F.coalesce(p["a"] == p["b"], F.lit(False)))
    broken = F.array_position(same, False)
    return (
        distinct.withColumn("rank", F.row_number().over(w))
        .withColumn("before", before)
        .select("source", "suffix", "rank", F.when(broken == 0, F.size("suffix")).otherwise(broken - 1).cast("int").alias("lcp"), "n")
    )


def _prefixes(of: str = "suffix"):
    """The prefixes of a suffix, each as its length and a hash."""
    return F.transform(F.sequence(F.lit(1), F.size(of)), lambda i: F.struct(i.cast("int").alias("size"), F.xxhash64(F.slice(of, F.lit(1), i)).alias("block")))


def blocks_of(runs: DataFrame, documents: DataFrame) -> DataFrame:
    """Repeated blocks: source, size (lines), block (a hash of their identifiers), n_docs.

    Candidates are the inner nodes of the suffix array (common prefixes of neighbours), the suffixes that occur more than once, and their first
    lines: every block that stands in several places is a prefix of one of these, in the same places. The documents of all suffixes in a node's
    interval are counted, and MIN_DOCS and MIN_SHARE decide: nothing else picks a line.
    """
    array = suffix_array(runs)
    block = lambda size: F.struct(F.lit(size).cast("int").alias("size") if isinstance(size, int) else size.cast("int").alias("size"), F.xxhash64(F.slice("suffix", F.lit(1), size)).alias("block")).alias("b")
    nodes = array.where("lcp > 0").select("source", block(F.col("lcp"))).unionByName(array.where("n > 1").select("source", block(F.size("suffix")))).unionByName(array.select("source", block(1))).distinct()
    # a suffix lies in the intervals of its own prefixes: they are joined one by one, so a hot first line pairs nothing
    each = runs.select("source", "doc_id", F.explode(_suffixes()).alias("suffix")).distinct().select("source", "doc_id", F.explode(_prefixes()).alias("b")).distinct()
    counted = each.join(nodes, ["source", "b"]).groupBy("source", "b").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") >= MIN_DOCS)
    return counted.join(source_sizes(documents), "source").where(F.col("n_docs") >= MIN_SHARE * F.col("n_rows")).select("source", "b.size", "b.block", "n_docs")


def occurrences(runs: DataFrame, blocks: DataFrame) -> DataFrame:
    """chunk_id, line_no of every line that lies in an occurrence of a block."""
    each = runs.select("source", "chunk_id", "nos", F.posexplode(_suffixes()).alias("at", "suffix"))
    each = each.select("source", "chunk_id", "nos", "at", F.explode(_prefixes()).alias("b")).select("source", "chunk_id", "nos", "at", "b.size", "b.block")
    hit = each.join(blocks.select("source", "size", "block"), ["source", "size", "block"])
    return hit.select("chunk_id", F.explode(F.slice("nos", F.col("at") + 1, F.col("size"))).alias("line_no")).distinct()


def repeated_blocks(chunks: DataFrame, documents: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Runs of shared lines, and the repeated blocks among them.

    Lines of one document only act as separators and leave before the suffix array is built; that loses no block. Nulls: no rows. Empty tables:
    empty results. Repeated rows of chunks count once per document.
    """
    lines = scratch.keep(lines_of(chunks, documents), "lines")
    kept = lines.join(shared_lines(lines), ["source", "line"], "left_semi")
    runs = scratch.keep(runs_of(kept), "runs")
    return runs, blocks_of(runs, documents)


def found(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """p4_found: chunk_id, line_no of each occurrence of a repeated line."""
    scratch = Scratch(chunks.sparkSession, "lines")
    runs, blocks = repeated_blocks(chunks, documents, scratch)
    out = materialize(occurrences(runs, blocks).select("chunk_id", F.col("line_no").cast("int").alias("line_no")), "repeated")
    scratch.close()
    return out


def cleaned(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """chunk_id, text without its repeated lines, removed (how many). Chunks without any keep their text; a null text stays null."""
    gone = found(chunks, documents).groupBy("chunk_id").agg(F.collect_set("line_no").alias("gone"))
    rows = chunks.select(F.col("id").alias("chunk_id"), "text").join(gone, "chunk_id", "left")
    left = F.filter(F.split("text", "\n", -1), lambda x, i: ~F.coalesce(F.array_contains("gone", (i + 1).cast("int")), F.lit(False)))
    return rows.select("chunk_id", F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(left, "\n")).alias("text"), F.coalesce(F.size("gone"), F.lit(0)).alias("removed"))
