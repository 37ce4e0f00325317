"""Phrase tables: lists of phrases in plain words, and the one expression that finds any of them.

A table has a phrase a line.  Words are separated by blanks and matched in any case, with any blanks between them, as whole words.

* ``(a|b c)`` is either, ``[a|b]`` is either or nothing;
* ``word*`` or ``(a|b)*`` takes any ending;
* ``,?`` is a comma that may be missing;
* ``<m-n>`` is m to n words of any kind, ``<1 word>`` one at the end;
* ``<n chars>`` is up to n characters other than a full stop,
  and ``<some n chars>`` the same with blanks of its own on both sides;
* ``! (a|b)`` at the end: not where one of these follows.
"""

from __future__ import annotations

import re

PART = re.compile(r"<[^>]*>|[\[(][^\])]*[\])]\*?,?\??|!|\S+")


def words(text: str) -> str:
    """Plain words with any blanks between them."""
    return r"\s+".join(map(re.escape, text.split()))


def either(options: str) -> str:
    return "(?:" + "|".join(words(o.rstrip("*")) + (r"\w*" if o.endswith("*") else "") for o in options.split("|")) + ")"


def piece(part: str) -> tuple[str, bool]:
    """A part's expression, and whether the blanks after it are its own."""
    if part.startswith("<") and part.endswith("chars>"):
        some, n = "some" in part, int(re.sub(r"\D", "", part))
        return (rf"\s+[^.]{{0,{n}}}\s+" if some else rf"\b[^.]{{0,{n}}}\b"), True
    if part == "<1 word>":
        return r"\w+", False
    if part.startswith("<"):
        low, high = part[1:-1].split("-")
        return rf"(?:\w+\s+){{{low},{high}}}", True
    if part.startswith("["):
        return rf"(?:{either(part[1:-1])}\s+)?", True
    if part.startswith("("):
        star = part.endswith("*")
        return either(part.rstrip("*")[1:-1]) + (r"\w*" if star else ""), False
    if part.endswith(",?"):
        return words(part[:-2]) + ",?", False
    return words(part.rstrip("*")) + (r"\w*" if part.endswith("*") else ""), False


def phrase(line: str) -> str:
    """The expression of one phrase."""
    line, _, barred = line.partition(" ! ")
    out, joined = "", True
    for part in PART.findall(line):
        expression, own = piece(part)
        out += ("" if joined or part.endswith("chars>") else r"\s+") + expression
        joined = own
    return out + (rf"\b(?!\s+{either(barred.strip('()'))})" if barred else "")


def table(text: str) -> list[str]:
    return [line.strip() for line in text.strip().splitlines() if line.strip()]


def pattern(phrases: list[str]) -> str:
    """An expression that finds any of the phrases as whole words."""
    return r"(?i)\b(?:" + "|".join(map(phrase, phrases)) + r")\b"
