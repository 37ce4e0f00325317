"""Operator 7: substring dedup by sliding sentence spans.

Runs of consecutive sentences are hashed to 128 bits: from each sentence, however short, the shortest run of two sentences
or more with at least ``RUN`` words, or of any number with ``LONG`` words; and the shortest such run that ends with each
sentence.  So whatever sentences two texts share in one piece of that size are covered by shared runs to the last.  Runs
are joined over the whole corpus, and all sentences covered by a run that occurred before (in the order of document
id, then place) are removed.  The first occurrence stays.  Case and blanks don't tell runs apart.

A sentence ends after ``. ! ? ,`` (or such a mark of another script) and a blank, at a line break, and before a capitalised
word, so that a passage pasted into the middle of a sentence, or cut off in one, still has whole ones.  In scripts without
blanks between words it ends after a full-width mark and at a blank between two of their letters, and their letters
count: ``WIDE`` Chinese or Japanese ones, or ``NARROW`` Thai, Lao, Khmer or Burmese ones, as a word.

The count of each hash is pre-aggregated on the map side without places, and only hashes that repeat are kept, as a table in
the shared folder.  The texts are hashed again for the join with it, a shuffle join that AQE splits where a passage is hot
(a table of all hashes with their places would be larger than the texts); the places that it leaves are few, and their least is
aggregated for each hash.  What meets per document is that document's own spans.  A document is known by its
id and a 64-bit hash of its text, so only texts of one id could be taken for each other.

Cases: null and blank texts have no sentences and stay as they are; texts shorter than a run stay; a document that repeats an
earlier one loses all its runs; rows that repeat id and text are one document and are treated alike; null ids come first; rows with one
id and several texts are told apart by their text; other columns pass through, but one with the name of the added column is
replaced; an empty table gives no row.
"""

from __future__ import annotations

import re
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.common import Workspace, claim, fresh, slices, without_names

RUN, LONG = 16, 32
WIDE, NARROW = 2, 4
UPPER = "A-ZÀ-ÖØ-ÞΑ-ΩЀ-Я"
LOWER = "a-zß-öø-ÿα-ωа-џ"
HAN = "\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
THAI = "\u0e01-\u0eff\u1000-\u109f\u1780-\u17dd"
#: Where a sentence ends: the blanks after a mark, around a line break, or before a capitalised word.
MARKED = rf"(?<=[.!?,؟،۔।॥։።])\s+|\s*\n\s*|\s+(?=[{UPPER}][{LOWER}])"
END = re.compile(MARKED)
#: The same in texts that hold letters of scripts without blanks between words.
UNSPACED_END = re.compile(rf"(?<=[。！？，、；：｡､])\s*(?![。！？，、；：｡､」』）”’])|(?<=[。！？，、；：｡､][」』）”’])\s*|(?<=[{HAN}{THAI}])\s+(?=[{HAN}{THAI}])|{MARKED}")
WIDE_LETTER, NARROW_LETTER, UNSPACED = re.compile(f"[{HAN}]"), re.compile(f"[{THAI}]"), re.compile(f"[{HAN}{THAI}]")


def sentences(text: str) -> tuple[list[int], list[list[str]]]:
    """Where each sentence starts (and last, where the text ends), and its lower-cased words."""
    starts, words, at = [], [], 0
    end = UNSPACED_END if not text.isascii() and UNSPACED.search(text) else END
    for m in end.finditer(text):
        if w := text[at : m.start()].lower().split():
            starts.append(at)
            words.append(w)
            at = m.end()
    if w := text[at:].lower().split():
        starts.append(at)
        words.append(w)
    return [*starts, len(text)], words


def size(words: list[str]) -> int:
    """A sentence's words, where letters of unspaced scripts count by their number."""
    n = 0
    for w in words:
        if w.isascii() or not UNSPACED.search(w):
            n += 1
        else:
            wide, narrow = len(WIDE_LETTER.findall(w)), len(NARROW_LETTER.findall(w))
            n += max(1, round(wide / WIDE + narrow / NARROW))
    return n


def shortest(sizes: list[int]) -> list[int]:
    """For each sentence, as long as there is one, the end of the shortest run that starts there."""
    ends, j, held = [], 0, 0
    for i, n in enumerate(sizes):
        while not (held >= LONG or (held >= RUN and j - i >= 2)):
            if j == len(sizes):
                return ends
            held += sizes[j]
            j += 1
        ends.append(j)
        held -= n
    return ends


def runs(text: str | None) -> list[tuple[int, int, int]]:
    """``(128-bit hash, start, end)`` of each run; the end is where the next sentence starts."""
    if not text:
        return []
    starts, words = sentences(text)
    plain = text.isascii() or not UNSPACED.search(text)
    ends = shortest([len(w) if plain else size(w) for w in words])
    if not ends:
        return []
    parts = [" ".join(w).encode("utf-8", "replace") for w in words]
    whole, at = b" ".join(parts), [0, *accumulate(len(p) + 1 for p in parts)]
    # the shortest run that ends between this start's end and the next start's also starts here
    spans = [(i, e) for i, (j, after) in enumerate(zip(ends, [*ends[1:], len(words) + 1], strict=True)) for e in range(j, max(j + 1, after))]
    return [(xxhash.xxh3_128_intdigest(whole[at[i] : at[j] - 1]), starts[i], starts[j]) for i, j in spans]


def without(text: str, spans: list[int]) -> tuple[str, int]:
    """The text without the packed spans, and how many characters went."""
    kept, at, gone = [], 0, 0
    for s in sorted(spans):
        lo, hi = s >> 32, s & 0xFFFFFFFF
        if hi <= at:
            continue
        lo = max(lo, at)
        kept.append(text[at:lo])
        gone += hi - lo
        at = hi
    kept.append(text[at:])
    return "".join(kept), gone


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", removed: str = "removed_chars") -> DataFrame:
    """The input's rows with repeated runs removed from ``text`` and the number of characters removed as another column."""
    ws = Workspace(df.sparkSession, "op7")
    df = without_names(df, removed)
    uid, spans = fresh("uid", [*df.columns, removed]), fresh("spans", [*df.columns, removed])

    def hashed(places: bool):
        def run(batches):
            claim("spans")
            for batch in batches:
                for part in slices(batch):
                    h1, h2, rows, at = [], [], [], []
                    for k, t in enumerate(part.column(0).to_pylist()):
                        for h, lo, hi in runs(t):
                            h1.append(h >> 64)
                            h2.append(h & 0xFFFFFFFFFFFFFFFF)
                            rows.append(k)
                            at.append(lo << 32 | hi)
                    if rows:
                        cols = {"h1": pa.array(np.array(h1, "u8").view("i8")), "h2": pa.array(np.array(h2, "u8").view("i8"))}
                        if places:
                            of = pa.array(rows, pa.int32())
                            cols |= {"doc": part.column(1).take(of), "uid": part.column(2).take(of), "span": pa.array(at, pa.int64())}
                        yield pa.record_batch(list(cols.values()), names=list(cols))

        return run

    texts = df.select(F.col(text).alias("text"), F.col(key).alias("doc"), F.xxhash64(F.col(text)).alias("uid")).where("text is not null")
    hashes = texts.select("text").mapInArrow(hashed(False), "h1 long, h2 long")
    again = ws.save(hashes.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select("h1", "h2"), "repeats")
    found = texts.mapInArrow(hashed(True), f"h1 long, h2 long, doc {dict(df.dtypes)[key]}, uid long, span long")
    hits = ws.save(found.join(again, ["h1", "h2"]), "hits")
    place = F.struct("doc", "uid", "span")
    first = ws.save(hits.groupBy("h1", "h2").agg(F.min(place).alias("first")), "first")  # a table, so that AQE can split the join
    later = hits.join(first, ["h1", "h2"]).where(~place.eqNullSafe(F.col("first"))).select("doc", "uid", "span")
    gone = later.groupBy("doc", "uid").agg(F.collect_set("span").alias(spans)).select(F.col("doc").alias(fresh("doc", df.columns)), F.col("uid").alias(uid), spans)
    rows = df.withColumn(uid, F.xxhash64(F.col(text)))
    whole = rows.join(gone, rows[f"`{key}`"].eqNullSafe(gone[0]) & (rows[uid] == gone[1]), "left").select(*[rows[f"`{c}`"] for c in df.columns], gone[2])
    names = df.columns
    at = names.index(text)

    def strip(batches):
        for batch in batches:
            for part in slices(batch):
                texts, gaps = part.column(at).to_pylist(), part.column(len(names)).to_pylist()
                done = [(t, 0) if not s else without(t, s) for t, s in zip(texts, gaps, strict=True)]
                cols = list(part.columns[: len(names)])
                cols[at] = pa.array([t for t, _ in done], part.schema.field(at).type)
                yield pa.record_batch([*cols, pa.array([n for _, n in done], pa.int64())], names=[*names, removed])

    return whole.mapInArrow(strip, T.StructType([*df.schema.fields, T.StructField(removed, T.LongType())]))
