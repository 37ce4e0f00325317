"""Operator 5: language identification by prediction by partial matching.

For each language a byte context tree of orders 0 to ``ORDER`` is counted on a bounded sample and then frozen.  A text is coded
byte by byte, all bytes of its UTF-8 form, after ``ORDER`` line breaks that no text pays for: from the longest context
that the tree has, a byte costs ``-log2(count / (total + distinct))``, and an escape to the next shorter context
``-log2(distinct / (total + distinct))``; below order 0 every byte costs 8 bits.  The language with the shortest code wins (the
first by name at a tie).  The score is that language's share of ``2 ** -length``, where the code lengths of a text of over
``EVIDENCE`` bytes are scaled down to that many, so that length alone makes no text sure.

Sample: per language about ``SAMPLE_DOCS`` labelled documents (never over twice that), fewer where there are so many languages
that all would exceed ``SAMPLE_ALL``, chosen by a hash of their id among those of at most ``SAMPLE_CHARS`` characters; that
bounds what reaches the driver.  Prediction takes whole texts.

Cost: the code lengths of a window of ``ORDER + 1`` bytes in all languages are kept in a direct-mapped table of bounded size, so a byte is
a table look-up in numpy; windows that the table lacks are priced together.

Cases: a text that is null or has no letters is ``und`` with score 0, and so is every text when nothing is labelled; a null id is
never held out and never learned from; repeated rows each get a row; other columns pass through, but those with the names of
the added ones are replaced; an empty table gives no row.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.common import claim, slices, without_names

ORDER, SAMPLE_DOCS, SAMPLE_ALL, SAMPLE_CHARS = 4, 200, 20_000, 100_000
EVIDENCE = 32
BLOCK, CELLS = 1 << 18, 1 << 21
NONE = "und"
GOLD = np.uint64(0x9E3779B97F4A7C15)


def held_out(key: str) -> Column:
    """Documents whose id's CRC-32 leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.encode(F.col(key).cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


def coded(text: str) -> bytes:
    return text.encode("utf-8", "replace")


def windows(data: bytes, order: int) -> np.ndarray:
    """For every byte from the ``order``-th on, that byte and the ``order`` before it as one number."""
    raw = np.frombuffer(data, "u1").astype("u8")
    out = raw[order:].copy()
    for k in range(1, order + 1):
        out |= raw[order - k : len(raw) - k] << np.uint64(8 * k)
    return out


class Trees:
    """Frozen counts of all languages.

    For each order, ``grams`` are the sorted byte strings of a context and its next byte, ``seen`` their counts, one column per
    language; ``contexts``, ``total`` and ``distinct`` the same of the contexts.
    """

    def __init__(self, texts: dict[str, list[str]], order: int = ORDER):
        self.langs, self.order = sorted(texts), order
        start = b"\n" * order
        per = [np.concatenate([np.empty(0, "u8"), *[windows(start + coded(t), order) for t in texts[lang]]]) for lang in self.langs]
        self.grams, self.seen, self.contexts, self.total, self.distinct = [], [], [], [], []
        for k in range(order + 1):
            mask = np.uint64((1 << 8 * (k + 1)) - 1)
            own = [np.unique(w & mask, return_counts=True) for w in per]
            grams = np.unique(np.concatenate([np.empty(0, "u8"), *[g for g, _ in own]]))
            seen = np.zeros((len(grams), len(own)), "i8")
            for lang, (g, n) in enumerate(own):
                seen[np.searchsorted(grams, g), lang] = n
            contexts, of = np.unique(grams >> np.uint64(8), return_inverse=True)
            total, distinct = np.zeros((2, len(contexts), len(own)), "i8")
            np.add.at(total, of, seen)
            np.add.at(distinct, of, seen > 0)
            for table, value in ((self.grams, grams), (self.seen, seen), (self.contexts, contexts), (self.total, total), (self.distinct, distinct)):
                table.append(value)

    def bits(self, window: np.ndarray) -> np.ndarray:
        """Code length of each window's last byte after the bytes before it: windows x languages."""
        cost, coded_ = np.zeros((len(window), len(self.langs))), np.zeros((len(window), len(self.langs)), bool)

        def rows(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
            at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            return np.where((keys[at] == wanted)[:, None], values[at], 0)

        for k in range(self.order, -1, -1):
            if not len(self.grams[k]):
                continue
            gram = window & np.uint64((1 << 8 * (k + 1)) - 1)
            context = gram >> np.uint64(8)
            total, distinct, count = rows(self.contexts[k], self.total[k], context), rows(self.contexts[k], self.distinct[k], context), rows(self.grams[k], self.seen[k], gram)
            open_ = (total > 0) & ~coded_
            hit = open_ & (count > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                cost += np.where(open_, np.log2((total + distinct) / np.where(hit, count, distinct)), 0.0)
            coded_ |= hit
        return cost + np.where(coded_, 0.0, 8.0)


class Coder:
    """Code lengths of texts, with the direct-mapped table of windows."""

    def __init__(self, trees: Trees):
        self.trees = trees
        size = max(1, CELLS // max(1, len(trees.langs))).bit_length() - 1
        self.shift = np.uint64(64 - size)
        self.keys = np.full(1 << size, ~np.uint64(0))  # no window: those have 40 bits
        self.costs = np.zeros((1 << size, len(trees.langs)))

    def priced(self, window: np.ndarray) -> np.ndarray:
        at = (window * GOLD >> self.shift).astype("i8")
        known = self.keys[at] == window
        if known.all():
            return self.costs[at]
        out = self.costs[at]
        new, back = np.unique(window[~known], return_inverse=True)
        bits = self.trees.bits(new)
        out[~known] = bits[back]
        place = (new * GOLD >> self.shift).astype("i8")
        self.keys[place] = new
        own = self.keys[place] == new  # of windows with one place one stays
        self.costs[place[own]] = bits[own]
        return out

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """Code lengths: texts x languages.  At most about ``BLOCK`` bytes are priced at a time."""
        out, order = np.zeros((len(texts), len(self.trees.langs))), self.trees.order
        held: list[tuple[int, bytes]] = []

        def flush():
            cost = np.vstack([self.priced(windows(b"".join(p for _, p in held), order)), np.zeros((1, out.shape[1]))])
            at, edges = 0, []
            for _, piece in held:
                edges += [at, at + len(piece) - order]
                at += len(piece)
            np.add.at(out, [k for k, _ in held], np.add.reduceat(cost, edges, axis=0)[::2])
            held.clear()

        size = 0
        for k, text in enumerate(texts):
            whole = b"\n" * order + text
            for lo in range(0, len(text), BLOCK):
                held.append((k, whole[lo : lo + BLOCK + order]))
                size += len(held[-1][1])
                if size >= BLOCK:
                    flush()
                    size = 0
        if held:
            flush()
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        known = [k for k, t in enumerate(texts) if t and any(map(str.isalpha, t))] if self.trees.langs else []
        out = [(NONE, 0.0)] * len(texts)
        raw = [coded(texts[k]) for k in known]
        for k, data, bits in zip(known, raw, self.lengths(raw), strict=True):
            best = int(np.argmin(bits))
            more = np.minimum(1000.0, (bits - bits[best]) * min(1.0, EVIDENCE / len(data)))
            out[k] = (self.trees.langs[best], float(1.0 / np.exp2(-more).sum()))
        return out


_coders: dict[int, Coder] = {}


def learn(df: DataFrame, key: str, text: str, lang: str) -> Trees:
    """Trees from documents that are labelled and not held out."""
    rows = df.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(key).isNotNull() & ~held_out(key)).select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).cast("string").alias("l"))
    rows = rows.where(F.length("t") <= SAMPLE_CHARS)
    sizes = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "l").limit(SAMPLE_ALL).collect()}
    if not sizes:
        return Trees({})
    each, slots = max(1, min(SAMPLE_DOCS, SAMPLE_ALL // len(sizes))), 1 << 30
    keep = F.create_map(*[F.lit(v) for lang_, n in sorted(sizes.items()) for v in (lang_, min(slots, -(-slots * each // n)))])
    got = rows.where(F.pmod(F.xxhash64("k"), F.lit(slots)) < keep[F.col("l")]).select("l", "t").limit(2 * each * len(sizes)).collect()
    texts: dict[str, list[str]] = {}
    for r in got:
        texts.setdefault(r["l"], []).append(r["t"])
    return Trees(texts)


def identify(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", pred: str = "lang_pred", score: str = "score", trees: Trees | None = None) -> DataFrame:
    """The input's rows with predicted language and score as two more columns."""
    trees = trees or learn(df, key, text, lang)
    df = without_names(df, pred, score)
    sent = df.sparkSession.sparkContext.broadcast(trees)
    at, names = df.columns.index(text), [*df.columns, pred, score]
    number = id(trees)

    def run(batches):
        claim("language", _coders.clear)
        model = sent.value
        coder = _coders.get(number)
        if coder is None or coder.trees is not model:
            _coders.clear()
            coder = _coders[number] = Coder(model)
        for batch in batches:
            for part in slices(batch, 2048, 1 << 20):
                got = coder.predict(part.column(at).to_pylist())
                yield pa.record_batch([*part.columns, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=names)

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(pred, T.StringType()), T.StructField(score, T.DoubleType())]))
