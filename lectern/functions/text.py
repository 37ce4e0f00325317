"""Text normalisation and predicates as column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Query terms that carry no meaning.
STOPWORDS = (
    "a an and are as at be by for from has have in is it its of on or that the their there this to was were will with about into after before"
).split()


def _plain(c: str) -> str:
    """A character's compatibility decomposition without marks."""
    return "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))


#: Built from the rule above for all letters of the basic plane but Hangul: those that become one character, and those that become several.
ONE = {chr(k): p for k in [*range(0xA0, 0xAC00), *range(0xF900, 0xFFFE)] if len(p := _plain(chr(k))) == 1 and p != chr(k) and ord(p) < 0x10000}
#: Of the latter the ligatures, fractions and signs of Western text.
SEVERAL = {c: _plain(c) for c in "ﬀﬁﬂﬃﬄﬅﬆ…½¼¾™ŉǆ"}


def _c(text) -> Column:
    return F.col(text) if isinstance(text, str) else text


def decompose(text, old: str = "", new: str = "") -> Column:
    """Compatibility decomposition without marks, and ``old`` characters to ``new`` (those without one go).

    ASCII stays as it is, and texts without a character of several are not searched for each of them.
    """
    raw = _c(text)
    t = F.regexp_replace(F.translate(raw, "".join(ONE) + old, "".join(ONE.values()) + new), r"\p{M}", "")
    many = t
    for c, plain in SEVERAL.items():
        many = F.replace(many, F.lit(c), F.lit(plain))
    return F.when(~raw.rlike(r"[^\x00-\x7F]"), raw).when(raw.rlike("[" + "".join(SEVERAL) + "]"), many).otherwise(t)


def held(df: DataFrame, name: str, value: Column) -> DataFrame:
    """The table with one more column.  It comes out of a one-element explode, so the planner can't copy its expression into each use."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def squeeze(text) -> Column:
    """Runs of blanks to one blank, ends trimmed."""
    return F.trim(F.regexp_replace(_c(text), r"\s+", " "))


def clean(text) -> Column:
    """Without soft hyphens and accents, with straight quotes and plain dashes, blanks squeezed."""
    return squeeze(decompose(text, "‘’“”–—­", "''\"\"--"))


def normalise(text) -> Column:
    """``clean``, lower case, and no character but letters, digits, underscores and blanks."""
    return F.regexp_replace(F.lower(clean(text)), r"[^\p{L}\p{N}_\s]", "")


def words(text) -> Column:
    """Words between blanks; empty text has none."""
    return F.filter(F.split(_c(text), r"\s+"), lambda w: F.length(w) > 0)


def tokens(text) -> Column:
    """Words of two or more characters of normalised text."""
    return F.filter(F.split(_c(text), r"\s+"), lambda w: F.length(w) >= 2)


def grams(toks: Column) -> Column:
    """Unigrams and bigrams of a token array, with repeats."""
    n = F.size(toks)
    pairs = F.when(n > 1, F.zip_with(F.slice(toks, 1, n - 1), F.slice(toks, 2, n - 1), lambda a, b: F.concat_ws(" ", a, b)))
    return F.concat(toks, F.coalesce(pairs, F.array().cast("array<string>")))


def jaccard(a, b) -> Column:
    """Overlap of the word sets of two normalised texts; 0 where either is empty."""
    x, y = F.array_distinct(words(a)), F.array_distinct(words(b))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def alnum_tokens(text) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(_c(text), F.lit(""))), F.lit("([a-z0-9]+)"), 1)


def containment(a, b) -> Column:
    """Share of the left text's alphanumeric tokens that the right has."""
    x, y = F.array_distinct(alnum_tokens(a)), F.array_distinct(alnum_tokens(b))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(F.size(F.array_intersect(x, y)) / F.size(x))


def extraction_clean(text) -> Column:
    """No soft hyphens or double quotes; line breaks to blanks, runs of blanks squeezed."""
    t = F.translate(_c(text), "­\"“”", "")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"\n", " "), r"[ \t]+", " "))


def dedup_key(text) -> Column:
    """Lower case letters, digits and single blanks, first 220 characters."""
    return F.substring(F.trim(F.regexp_replace(F.regexp_replace(F.lower(_c(text)), r"\s+", " "), r"[^a-z0-9 ]", "")), 1, 220)


def sentences(text) -> Column:
    # not F.trim itself: transform would give it the index as the characters to trim
    return F.filter(F.transform(F.split(F.trim(_c(text)), r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: F.length(s) > 0)


def first_sentence(text) -> Column:
    return F.try_element_at(sentences(text), F.lit(1))


def last_sentence(text) -> Column:
    return F.try_element_at(sentences(text), F.lit(-1))


def query_terms(text) -> Column:
    """Distinct words of three or more characters that are no stopwords, in order."""
    stop = F.array(*[F.lit(s) for s in STOPWORDS])
    return F.array_distinct(F.filter(F.split(F.lower(_c(text)), r"(?U)\W+"), lambda w: (F.length(w) >= 3) & ~F.array_contains(stop, w)))


def label(text) -> Column:
    """Labels compared: trimmed, lower case, no full stops at the end."""
    return F.regexp_replace(F.lower(F.trim(_c(text))), r"\.+$", "")


def slug(path) -> Column:
    """Document id of a file path."""
    name = F.regexp_replace(F.element_at(F.split(_c(path), "/"), -1), r"(?i)\.pdf$", "")
    return F.lower(F.regexp_replace(F.regexp_replace(name, r"[^a-zA-Z0-9]+", "_"), r"^_+|_+$", ""))


def item_label(text) -> Column:
    """Display form of an item label: ``4a i`` stays, else no blanks, ``(n)`` unwrapped, ``.(`` to ``(``, no final stop."""
    t = F.trim(_c(text))
    packed = F.regexp_replace(t, r"\s+", "")
    packed = F.regexp_replace(F.regexp_replace(F.regexp_replace(packed, r"^\((\d+)\)$", "$1"), r"\.\(", "("), r"\.$", "")
    return F.when(t.rlike(r"(?i)^\d+[a-z] [ivx]+$"), t).otherwise(packed)


#: Small Roman numerals.
ROMAN = "i ii iii iv v vi vii viii ix x xi xii xiii xiv xv".split()


def roman(text) -> Column:
    """Number of a Roman numeral up to xv, else null."""
    at = F.array_position(F.array(*[F.lit(r) for r in ROMAN]), F.lower(F.trim(_c(text))))
    return F.when(at > 0, at.cast("int"))


def label_sort_key(text) -> Column:
    """Natural order of labels ``12``, ``4a``, ``4a ii``, ``8.32``: blanks last, then numbers, letter, numeral."""
    t = F.lower(F.trim(F.coalesce(_c(text), F.lit(""))))
    nums = F.transform(F.regexp_extract_all(F.regexp_extract(t, r"^\(?(\d+(?:\.\d+)*)", 1), F.lit(r"(\d+)"), 1), lambda x: x.cast("int"))
    letter = F.regexp_extract(t, r"^\(?\d+(?:\.\d+)*\)?\.?\s*\(?([a-z])\)?(?:\s|$|\()", 1)
    numeral = F.coalesce(roman(F.regexp_extract(t, r"[\s(]([ivx]+)\)?$", 1)), F.lit(0))
    return F.struct((t == "").cast("int").alias("blank"), nums.alias("numbers"), F.when(letter == "", 0).otherwise(F.ascii(letter) - 96).alias("letter"), numeral.alias("numeral"))


def without_markers(text) -> Column:
    """Leading list markers removed, as many as there are."""
    return F.trim(F.regexp_replace(_c(text), r"^(?:\s*(?:\(?\d+(?:\.\d+)*[.)]|\([a-z]\)|[a-z][.)]|\(?[ivx]+[.)]|[•\-*])\s+)+", ""))


def without_short_heading(text) -> Column:
    """Two to four upper-case words after a number go if six or more words follow."""
    got = F.regexp_extract(_c(text), r"^\d+[.)]?\s+((?:[A-Z]{2,}\s+){2,4})(?=\S)", 1)
    rest = F.regexp_replace(_c(text), r"^(\d+[.)]?\s+)(?:[A-Z]{2,}\s+){2,4}(?=\S)", "$1")
    return F.when((got != "") & (F.size(words(rest)) >= 7), rest).otherwise(_c(text))


def heading(text) -> Column:
    """Leading heading of a passage, or null: within 120 characters, up to the first stop or line break."""
    lead = F.trim(F.element_at(F.split(F.trim(F.substring(_c(text), 1, 120)), r"[.\n]", 2), 1))
    shape = r"^(?:[Rr]ecommendations?\s+\d+[:.]?|[Rr]ec\s+\d+|\d+[.\)]\s+[A-Z][A-Za-z\s]{3,}|[A-Z][A-Z\s\-,]{5,}[A-Z])"
    return F.when(lead.rlike(shape), lead)


# -- passages that are no prose -------------------------------------------------------------------

#: Words that head structural pages, and lines that end in a page number.
STRUCTURAL_HEADS = r"(?i)\b(?:table\s+of\s+contents?|list\s+of\s+(?:recommendations?|figures?|tables?|appendices|appendix)|appendix|appendices|references?|bibliography|abbreviations?|glossary|index)\b"
PAGE_REF = r"^.{3,60}\s+\d{1,3}\s*$"
CONTENTS_LINE = r"^.{3,80}(?:\.{3,}|\s{2,})\s*\d{1,3}\s*$"


def lines(text) -> Column:
    return F.filter(F.transform(F.split(_c(text), r"\r\n|\n|\r"), lambda x: F.trim(x)), lambda x: F.length(x) > 0)


def share(of: Column, test) -> Column:
    return F.when(F.size(of) == 0, 0.0).otherwise(F.size(F.filter(of, test)) / F.size(of))


def is_title_only(text) -> Column:
    """Few words, no sentence end, and two of: numbered, mostly upper case, one short line."""
    t, n = _c(text), F.size(words(text))
    body = F.regexp_replace(F.trim(t), r"^\s*\d+[.\)]\s*", "")
    letters = F.length(F.regexp_replace(t, r"\P{L}", ""))
    upper = F.length(F.regexp_replace(t, r"\P{Lu}", ""))
    signals = F.trim(t).rlike(r"^\s*(?:\d+|[A-Z])[\.\)]\s+\S").cast("int") + (upper / F.greatest(letters, F.lit(1)) >= 0.5).cast("int") + (~F.contains(F.trim(t), F.lit("\n")) & (n < 20)).cast("int")
    return (n < 35) & ~body.rlike(r"[.!?](?:\s|$)") & (signals >= 2)


def is_contents(text) -> Column:
    """Starts with "contents", or two fifths of its lines end in a page number after leaders."""
    return F.trim(_c(text)).rlike(r"(?i)^\s*contents\b") | (share(lines(text), lambda x: x.rlike(CONTENTS_LINE)) >= 0.4)


def is_structural(text) -> Column:
    """Title only, or two of: structural head word, page references, few sentence ends; or mostly page references."""
    t, n = _c(text), F.size(words(text))
    refs = share(lines(text), lambda x: x.rlike(PAGE_REF))
    ends = F.regexp_count(t, F.lit(r"[.!?](?:\s|$)"))
    signals = F.substring(t, 1, 200).rlike(STRUCTURAL_HEADS).cast("int") + (refs > 0.25).cast("int") + (ends / F.greatest(n, F.lit(1)) < 0.025).cast("int")
    return is_title_only(text) | ((n >= 10) & ((signals >= 2) | (refs > 0.5)))


def is_plain(text) -> Column:
    """A cheap test that only prose passes: neither contents nor structural, since it has 35 words or more, no line that ends in a digit and no structural head."""
    t = _c(text)
    blanks = F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit("")))
    listed = t.rlike(r"\d\s*(?:[\n\r\u0085\u2028\u2029]|\z)")
    return (blanks >= 40) & ~F.contains(t, F.lit("  ")) & ~listed & ~F.substring(t, 1, 200).rlike(STRUCTURAL_HEADS) & ~F.substring(t, 1, 200).rlike(r"(?i)^\s*contents\b")
