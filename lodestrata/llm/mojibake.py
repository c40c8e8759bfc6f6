"""Text decoded with the wrong character encoding: expectation-maximization over latent encoding chains.

A unit is one sign outside ASCII, or a sequence that some chain reads as one sign, with two letters of context on each side. Each unit was
either clean or came about by a chain (the bytes of one encoding read as another, perhaps twice). The weights of the chains in each source and
the counts of clean units are estimated together; each record is then judged by the posterior, its own units weighing on one another.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import cache, lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestrata.session import Scratch, materialize

ROUNDS = 4
#: Encodings in which UTF-8 bytes were read, and pairs of single-byte encodings (read as, written in).
READ_AS = ("cp1252", "cp1251", "cp1250", "cp1253", "cp1254", "cp437", "cp850", "mac_roman", "iso8859_2", "koi8_r", "cp866")
WRITTEN = ("cp1252", "mac_roman", "cp437", "cp850")
LOST = "�"
#: A weight that every chain has in every source before anything is seen, in units.
PRIOR = 0.5
FIELD = "text"
#: What every chain weighs in the first round: much, so that a garbled place whose clean form is usual doesn't pass as usual itself.
START = 0.05
#: Rounds of EM within a record, and how many units its source counts for there.
RECORD_ROUNDS = 15
SOURCE_COUNTS = 1.0


@cache
def _byte_of(encoding: str) -> dict[str, int]:
    """Sign to byte, for bytes above ASCII. Bytes without a sign stand for the control character of the same number, which is also accepted."""
    out = {}
    for b in range(128, 256):
        out.setdefault(chr(b) if encoding == "cp1252" and b < 160 else "", b)
        try:
            out[bytes([b]).decode(encoding)] = b
        except UnicodeDecodeError:
            out[chr(b)] = b
    out.pop("", None)
    return out


def _as_bytes(text: str, encoding: str) -> bytes | None:
    table = _byte_of(encoding)
    try:
        return bytes([table[c] for c in text])
    except KeyError:
        return None


def _usual(c: str) -> bool:
    """Whether a sign may be what a sequence was. Left out are only those that chance pairs of signs decode to: phonetic and historic signs,
    points of other scripts, and private ones. Three signs and more that decode by chance don't occur, so all their scripts may be."""
    n = ord(c)
    return 0xA0 <= n <= 0x24F or 0x300 <= n <= 0x45F or 0x530 <= n <= 0x58F or 0x5D0 <= n <= 0x6FF or n >= 0x900 and not 0xE000 <= n <= 0xF8FF


def _lonely(c: str) -> bool:
    return "\u0530" <= c <= "\u058f"


def _utf8(text: str, encoding: str) -> str | None:
    raw = _as_bytes(text, encoding)
    if raw is None:
        return None
    try:
        out = raw.decode("utf-8")
    except UnicodeDecodeError:
        return None
    return out if all(map(_usual, out)) or _as_bytes(out, encoding) is not None else None


@cache
def _sequences() -> dict[str, re.Pattern]:
    """For each encoding, the pattern of one UTF-8 sequence of several bytes as it looks when read so."""

    def signs(encoding: str, low: int, high: int) -> str:
        return "[" + "".join(re.escape(c) for c, b in _byte_of(encoding).items() if low <= b <= high) + "]"

    out = {}
    for e in READ_AS:
        more = signs(e, 0x80, 0xBF)
        out[e] = re.compile(f"{signs(e, 0xC2, 0xDF)}{more}|{signs(e, 0xE0, 0xEF)}{more}{{2}}|{signs(e, 0xF0, 0xF4)}{more}{{3}}")
    return out


#: Runs that are remembered are no longer than this; texts in other scripts have long ones that don't come again.
KNOWN_RUN = 8


def split_run(run: str) -> tuple[str, ...]:
    """A run of signs outside ASCII, cut into units: sequences that decode to one sign (through one or two readings), else single signs."""
    return _known_run(run) if len(run) <= KNOWN_RUN else _split(run)


def _split(run: str) -> tuple[str, ...]:
    units, at, before = [], 0, {}
    while at < len(run):
        reach: dict[str, int] = {}
        for e, pattern in _sequences().items():
            m = pattern.match(run, at)
            if not m or _utf8(m[0], e) is None:
                continue
            end, decoded = m.end(), _utf8(m[0], e)
            if _lonely(decoded):  # two signs of a text may look so; a word of that script has several in a row
                more = pattern.match(run, end)
                beside = [x for x in (more and _utf8(more[0], e), units and _utf8(units[-1], e)) if x]
                if not any(map(_lonely, beside)):
                    continue
            reach[e] = end - at
            # read twice: sequences whose decoded signs are again one sequence
            while len(decoded) < 4 and (n := pattern.match(run, end)) and (more := _utf8(n[0], e)) is not None:
                end, decoded = n.end(), decoded + more
                if (twice := _utf8(decoded, e)) is not None and len(twice) == 1:
                    reach[e] = end - at
        # what stands beside a sequence was read in the same encoding, if it can have been
        before = {e: n for e, n in reach.items() if e in before} or reach
        best = max(before.values(), default=1)
        units.append(run[at : at + best])
        at += best
    return tuple(units)


_known_run = lru_cache(50_000)(_split)


@lru_cache(100_000)
def decodings(unit: str) -> tuple[tuple[str, str], ...]:
    """(chain, what the unit was before) for each chain that could have made it, and ("", the unit itself). The sign for lost bytes is never
    clean: its only chain is "lost"."""
    if unit == LOST:
        return (("lost", unit),)
    out = {"": unit}
    for e in READ_AS:
        once = _utf8(unit, e)
        if once is None:
            continue
        if len(once) == 1 and _usual(once):
            out[f"utf8>{e}"] = once
        elif (twice := _utf8(once, e)) is not None and len(twice) == 1:
            out[f"utf8>{e}>utf8>{e}"] = twice
    if len(unit) == 1:
        for read in READ_AS:
            for written in WRITTEN:
                b = _byte_of(read).get(unit)
                if read == written or b is None:
                    continue
                if read == "cp1252" and 0x80 <= ord(unit) < 0xA0:
                    continue
                try:
                    was = bytes([b]).decode(written)
                except UnicodeDecodeError:
                    continue
                if was != unit and ord(was) > 0x9F:
                    out[f"{written}>{read}"] = was
        if 0x80 <= ord(unit) < 0xA0:
            try:
                out["cp1252>latin1"] = bytes([ord(unit)]).decode("cp1252")
            except UnicodeDecodeError:
                pass
    return tuple(out.items())


_RUN = re.compile(r"[^\x00-\x7f]+")


def _side(c: str) -> str:
    return c if c.isalpha() and c.isascii() else "~" if ord(c) > 127 else "0" if c.isdigit() else " "


def units_of(text: str) -> list[tuple[int, int, str, str, str]]:
    """(start, end, left context, unit, right context) of each unit."""
    out = []
    for m in _RUN.finditer(text):
        at = m.start()
        for unit in split_run(m[0]) if m.end() - at > 1 else (m[0],):
            end = at + len(unit)
            left = "".join(map(_side, text[max(0, at - 2) : at])).rjust(2)
            right = "".join(map(_side, text[end : end + 2])).ljust(2)
            out.append((at, end, left, unit, right))
            at = end
    return out


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[tuple] = []
        for doc, source, text in zip(*(c.to_pylist() for c in batch.columns)):
            if text and not text.isascii():
                seen = Counter(u[2:] for u in units_of(text))
                rows += [(doc, source, *u, n) for u, n in seen.items()]
        kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["doc_id", "source", "l", "unit", "r", "n"])


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        units = batch.column(0).to_pylist()
        rows = [(u, chain, was) for u in units for chain, was in decodings(u)]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], names=["unit", "chain", "was"])


def occurrences(documents: DataFrame) -> DataFrame:
    """doc_id, source, l, unit, r, n: the units of each document. A null source is a source of its own; null texts and ids have none."""
    rows = documents.where("doc_id is not null and text is not null").select("doc_id", F.concat(F.coalesce("source", F.lit("")), F.lit("/" + FIELD)).alias("source"), "text")
    return rows.mapInArrow(_scan, "doc_id bigint, source string, l string, unit string, r string, n bigint")


def _usuals(pool: DataFrame) -> DataFrame:
    """l, was, r, usual: how usual each earlier sign is in its place, from ``pool`` with m, the clean units that each row stands for. Counts
    are summed to one row a place before those of wider contexts are."""
    places = pool.groupBy("l", "was", "r").agg(F.sum(F.when(F.col("m") > 1e-6, F.col("m")).otherwise(0.0)).alias("c2"))
    near, sign = W.partitionBy("was", F.substring("l", 2, 1), F.substring("r", 1, 1)), W.partitionBy("was")
    usual = F.col("c2") + F.sum("c2").over(near) / 300 + F.sum("c2").over(sign) / 100_000
    return places.withColumn("usual", usual).select("l", "was", "r", "usual")


def _scores(pool: DataFrame, weights: DataFrame) -> DataFrame:
    """``pool`` (source, l, unit, r, n, chain, was, m) with e, weight and post: the weight of the chain times how usual the earlier sign is in
    that place, shared among the chains of a unit."""
    at = pool.drop("e", "weight", "post").join(_usuals(pool), ["l", "was", "r"]).join(weights, ["source", "chain"], "left")
    # several signs of which none belongs to another are rarer together than a count of the whole says
    alone = F.when(F.col("chain") == "", F.pow(F.lit(1e-4), F.length("unit") - 1)).otherwise(F.lit(1.0))
    at = at.withColumn("e", F.col("usual") * alone).withColumn("weight", F.coalesce("weight", F.lit(1e-6))).withColumn("p", F.col("weight") * F.col("e"))
    total = F.sum("p").over(W.partitionBy("source", "l", "unit", "r"))
    post = F.when(total > 0, F.col("p") / total).otherwise((F.col("chain") == "").cast("double"))
    return at.withColumn("post", post).withColumn("m", F.col("n") * F.col("post")).drop("p", "usual")


def estimate(seen: DataFrame, scratch: Scratch, rounds: int = ROUNDS) -> DataFrame:
    """source, l, unit, r, n, chain, was, e, weight, post, m after EM: the posterior of each chain, and the clean units it stands for.

    Everything is aggregated to one row for each different unit of a source before the first round, so a hot source costs no more than its
    different units. A chain whose earlier sign occurs nowhere as a unit is never anything: e is 0 in every round, so it is left out, which
    changes no posterior. Each round is written to the shared folder, which cuts its lineage.
    """
    totals = scratch.keep(seen.groupBy("source", "l", "unit", "r").agg(F.sum("n").alias("n")), "totals")
    units = scratch.keep(totals.select("unit").distinct(), "different")
    made = units.mapInArrow(_candidates, "unit string, chain string, was string").join(units.withColumnRenamed("unit", "was"), "was", "left_semi")
    itself = F.col("chain").isin("", "lost")
    pool = totals.join(made, "unit").select("source", "l", "unit", "r", "n", "chain", "was", F.when(itself, F.col("n")).otherwise(0).cast("double").alias("m"))
    pool = scratch.keep(pool, "pool")
    weights = pool.select("source", "chain").distinct().withColumn("weight", F.when(F.col("chain") == "", 0.95).otherwise(START))
    for k in range(rounds):
        pool = scratch.keep(_scores(pool, weights), f"round{k}")
        summed = pool.groupBy("source", "chain").agg(F.sum("m").alias("m"))
        # what a chain weighs everywhere is what it starts from in a source
        every = summed.groupBy("chain").agg(F.sum("m").alias("all"))
        rest = F.sum("all").over(W.partitionBy(F.lit(1)))
        every = every.withColumn("base", F.col("all") / rest).select("chain", "base")
        summed = summed.withColumn("total", F.sum("m").over(W.partitionBy("source")))
        weights = summed.join(every, "chain").select("source", "chain", ((F.col("m") + PRIOR * 20 * F.col("base")) / (F.col("total") + PRIOR * 20)).alias("weight"))
    return pool


def judged(documents: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(verdicts, seen, clean): doc_id, l, unit, r, chain, was of each unit that a chain made, by the posterior of its record.

    A record's own mixture starts from that of its source and takes in the posteriors of all its units, so weak evidence counts in a record
    with strong evidence of the same chain. Records without a unit that some chain explains at least half as well as chance does are clean.
    Units with no chain but being clean only count, so of those a record needs the number.
    """
    seen = scratch.keep(occurrences(documents), "units")
    pool = estimate(seen, scratch)
    place = ["source", "l", "unit", "r"]
    made, own = (F.max(F.when(c, F.col("e"))) for c in (F.col("chain") != "", F.col("chain") == ""))
    options = F.collect_list(F.struct("chain", "was", "e", "weight")).alias("options")
    places = pool.groupBy(*place).agg(made.alias("made"), own.alias("own"), options).where("made is not null")
    places = scratch.keep(places.select(*place, F.expr("made > 0.5 * coalesce(own, 0)").alias("doubtful"), "options"), "places")
    some = scratch.keep(seen.join(places.where("doubtful").select(*place), place, "left_semi").select("doc_id").distinct(), "doubtful")
    of = scratch.keep(seen.join(some, "doc_id", "left_semi"), "of-doubtful")
    # a record's different units are no more than its signs
    rows = of.join(places.drop("doubtful"), place).select("doc_id", F.struct("l", "unit", "r", "n", "options").alias("place"))
    records = rows.groupBy("doc_id").agg(F.collect_list("place").alias("places")).join(of.groupBy("doc_id").agg(F.sum("n").alias("size")), "doc_id")
    verdicts = records.mapInArrow(_records, "doc_id bigint, l string, unit string, r string, chain string, was string")
    return verdicts, seen, pool.where("m > 1e-6").select("l", "was", "r", "m")


def judge_record(places: list[dict], size: int) -> list[tuple[str, str, str, str, str]]:
    """EM over one record: (l, unit, r, chain, was) of the units that most likely came about by a chain. ``size``: all its units, of which those
    that aren't in ``places`` are clean."""
    base: dict[str, float] = {"": 2e-3}
    for p in places:
        for u in p["options"]:
            base[u["chain"]] = max(u["weight"], 2e-3)
    sure = size - sum(p["n"] for p in places)
    weight = dict(base)
    for _ in range(RECORD_ROUNDS):
        mass = {c: SOURCE_COUNTS * w for c, w in base.items()}
        mass[""] += sure
        for p in places:
            shares = [weight[u["chain"]] * u["e"] for u in p["options"]]
            total = sum(shares)
            if total > 0:
                for u, share in zip(p["options"], shares):
                    mass[u["chain"]] += p["n"] * share / total
        weight = {c: m / (size + SOURCE_COUNTS) for c, m in mass.items()}
    out = []
    for p in places:
        best = max(p["options"], key=lambda u: (weight[u["chain"]] * u["e"], u["chain"] == "", u["chain"]))
        if best["chain"] and weight[best["chain"]] * best["e"] > 0:
            out.append((p["l"], p["unit"], p["r"], best["chain"], best["was"]))
    return out


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "l", "unit", "r", "chain", "was"]
    for batch in batches:
        rows = [(doc, *v) for doc, places, size in zip(*(c.to_pylist() for c in batch.columns)) for v in judge_record(places, size)]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string() if i else pa.int64()) for i in range(6)], names=names)


def found(documents: DataFrame) -> DataFrame:
    """p8_found: doc_id of documents with a unit that a chain made; what stands for lost bytes is one."""
    scratch = Scratch(documents.sparkSession, "mojibake")
    out = materialize(judged(documents, scratch)[0].select("doc_id").distinct(), "garbled")
    scratch.close()
    return out


def repaired(documents: DataFrame) -> DataFrame:
    """doc_id, text with each garbled unit as it was. A lost sign becomes the one that stands in that place in four of five clean cases, else it
    stays. Texts without garbled units stay as they are, null texts stay null; rows without id are left out."""
    scratch = Scratch(documents.sparkSession, "mojibake")
    verdicts, seen, clean = judged(documents, scratch)
    counts = clean.where(F.col("was") != LOST).groupBy("l", "r", "was").agg(F.sum("m").alias("m"))
    usual = counts.groupBy("l", "r").agg(F.max_by("was", "m").alias("was"), F.max("m").alias("top"), F.sum("m").alias("all")).where("top >= 3 and top >= 0.8 * all")
    lost = seen.where(F.col("unit") == LOST).join(usual, ["l", "r"]).select("doc_id", "l", "unit", "r", F.lit("lost").alias("chain"), "was")
    fixes = verdicts.where(F.col("unit") != LOST).unionByName(lost).groupBy("doc_id").agg(F.collect_list(F.struct("l", "unit", "r", "was")).alias("fixes"))
    fixes = materialize(fixes, "fixes")
    scratch.close()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, own in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if text and own:
                    was = {(x["l"], x["unit"], x["r"]): x["was"] for x in own}
                    parts, at = [], 0
                    for a, b, left, unit, right in units_of(text):
                        if (left, unit, right) in was:
                            parts += [text[at:a], was[left, unit, right]]
                            at = b
                    text = "".join([*parts, text[at:]])
                texts.append(text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    rows = documents.where("doc_id is not null").select("doc_id", "text").join(fixes, "doc_id", "left")
    return rows.select("doc_id", "text", "fixes").mapInArrow(run, "doc_id bigint, text string")
