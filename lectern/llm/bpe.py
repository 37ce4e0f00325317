"""Byte-level BPE encoding and decoding with whole-text exactness.

Two facts carry the module.

* A position between a non-blank character and a following blank, or between a letter or digit and a following
  full stop, comma, question or exclamation mark, is always a boundary of the pre-tokeniser (no alternative of its
  pattern spans one), so a text cut there may be encoded piece by piece.  Pieces of natural text repeat, hence the
  bounded piece cache of two generations.
* Inside one long unsplit piece there is no such boundary.  There the byte string is cut anywhere, the halves
  are encoded on their own and joined: a window around the join is re-encoded and grown until its first token
  is the left half's token at that place and its last token the right half's.  A token sequence is the BPE
  encoding of its text exactly if every adjacent pair is, so agreement at both ends proves the joined result.
"""

from __future__ import annotations

import hashlib
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from lectern.llm.common import claim

BLANKS = " \n\t\r"
PIECES = re.compile(r"[ \n\t\r]*+[^ \n\t\r.,!?]++(?:(?<=[A-Za-z0-9À-ÖØ-öø-ÿ])|(?![.,!?]))|[ \n\t\r]*[^ \n\t\r]+|[ \n\t\r]+")
#: Blanks other than the four above: Python's and the tokeniser's notions differ on some, so such texts are not cut; nor those with CUT.
ODD = "\0\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0                　"
CUT = "\0"
#: Marks of a cut between two blanks, or before an end mark that follows no letter or digit: no boundaries.
NO_CUT = re.compile(r"\0(?:(?<=[ \n\t\r]\0)(?=[ \n])|(?<![A-Za-z0-9À-ÖØ-öø-ÿ]\0)(?=[.,!?]))")
#: A word that is one pre-token after its blank, if it has one.
WORD = re.compile(r"([ \n]?)([A-Za-zÀ-ÖØ-öø-ɏ]+)")
#: Two generations of so many pieces, of at most CACHED_CHARS characters, take about 200 MB in a worker.
CACHE_PIECES = 250_000
CACHED_CHARS = 48
#: Pieces of more characters are encoded by tree concatenation, with leaves of LEAF bytes.
LONG = 4096
LEAF = 1024


def byte_alphabet() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for code points from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def odd(text: str) -> bool:
    return any(c in text for c in ODD)


class Codec:
    """A tokenizer file with its byte tables and piece cache."""

    def __init__(self, path: str, long: int = LONG, leaf: int = LEAF):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.long, self.leaf = long, leaf
        self.size = self.tok.get_vocab_size(with_added_tokens=True)
        self.special = sorted((t.content for t in self.tok.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.strings: list[str] = [""] * self.size
        for s, i in self.tok.get_vocab(with_added_tokens=True).items():
            self.strings[i] = s
        alphabet = byte_alphabet()
        self.byte_strings, self.space = alphabet, alphabet[32]
        self.raw_ids = [i.to_bytes(4, "little") for i in range(self.size)]
        self.newline = self.raw_ids[self.tok.token_to_id(alphabet[10])]
        back = {c: b for b, c in alphabet.items()}
        added = set(self.special)
        self.bytes = [s.encode() if s in added else bytes(back[c] for c in s) for s in self.strings]
        self.lens = np.array([len(b) for b in self.bytes], "i8")
        self.cache: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    # -- encoding ---------------------------------------------------------------------------------

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids (little-endian uint32) of each whole text; null counts as empty."""
        whole = {k: np.array(self.tok.encode(t, add_special_tokens=False).ids, "<u4") for k, t in enumerate(texts) if t and odd(t)}
        marked = pa.array(["" if not t or k in whole else self.marked(t) for k, t in enumerate(texts)], pa.string())
        split = pc.split_pattern(marked, CUT)
        coded = split.values.dictionary_encode()
        pieces = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.cache.get, pieces))
        missing = [p for p, v in zip(pieces, found, strict=True) if v is None]
        if missing:
            new = self._learn(missing)
            found = [new[p] if v is None else v for p, v in zip(pieces, found, strict=True)]
        ends = np.cumsum([0, *map(len, found)]) // 4
        ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(found), "<u4"))).take(coded.indices)
        flat, at = ids.values.to_numpy(), ids.offsets.to_numpy()[split.offsets.to_numpy()]
        return [whole.get(k, flat[lo:hi]) for k, (lo, hi) in enumerate(zip(at, at[1:], strict=False))]

    @staticmethod
    def marked(text: str) -> str:
        """The text with CUT at boundaries of the pre-tokeniser."""
        for mark in " \n.,!?":
            text = text.replace(mark, CUT + mark)
        return NO_CUT.sub("", text)

    def _learn(self, missing: list[str]) -> dict[str, bytes]:
        """Ids of pieces that the cache lacks, from its older generation or the tokenizer; short ones are kept."""
        new, old, unknown = {}, self.old.get, []
        for p in missing:
            if (v := old(p)) is None:
                unknown.append(p)
            else:
                new[p] = v
        self._encode_pieces(unknown, new)
        self.cache.update(new)
        for p in new:
            if len(p) > CACHED_CHARS:
                del self.cache[p]
        if len(self.cache) > CACHE_PIECES:
            self.old, self.cache = self.cache, {}
        return new

    def _encode_pieces(self, missing: list[str], new: dict[str, bytes]) -> None:
        """Words go to the model as one pre-token each, other pieces through the whole tokenizer."""
        single, tokenize, strings, raw, space = [], self.tok.model.tokenize, self.byte_strings, self.raw_ids, self.space
        for p in missing:
            if len(p) > self.long:
                new[p] = np.array(self.tree(p), "<u4").tobytes()
            elif not p:
                new[p] = b""
            elif m := WORD.fullmatch(p):
                blank, word = m.groups()
                coded = word if word.isascii() else word.encode().decode("latin-1").translate(strings)
                ids = b"".join([raw[t.id] for t in tokenize(space + coded if blank == " " else coded)])
                new[p] = self.newline + ids if blank == "\n" else ids
            else:
                single.append(p)
        if single:
            for p, e in zip(single, self.tok.encode_batch_fast(single, add_special_tokens=False), strict=True):
                new[p] = b"".join([raw[i] for i in e.ids])

    # -- tree concatenation -----------------------------------------------------------------------

    def units(self, text: str) -> list[tuple[bool, str]]:
        """The pre-tokeniser's pieces of a text: ``(is special token, string in the byte alphabet)``."""
        parts = re.split("(" + "|".join(map(re.escape, self.special)) + ")", text) if self.special else [text]
        out: list[tuple[bool, str]] = []
        for k, part in enumerate(parts):
            if k % 2:
                out.append((True, part))
            elif part:
                out += [(False, s) for s, _ in self.tok.pre_tokenizer.pre_tokenize_str(part)]
        return out

    def leaf_ids(self, unit: str) -> list[int]:
        return [t.id for t in self.tok.model.tokenize(unit)] if unit else []

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """Ids of the concatenated strings of two encoded halves of one unit."""
        if not left or not right:
            return left or right
        width = 4
        while True:
            lo, hi = max(0, len(left) - width), min(len(right), width)
            window = self.leaf_ids("".join(map(self.strings.__getitem__, left[lo:] + right[:hi])))
            if (lo == 0 or window[0] == left[lo]) and (hi == len(right) or window[-1] == right[hi - 1]):
                return left[:lo] + window + right[hi:]
            width *= 2

    def join_all(self, parts: list[list[int]]) -> list[int]:
        """Join neighbouring parts pairwise, level by level."""
        while len(parts) > 1:
            parts = [self.join(parts[k], parts[k + 1]) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
        return parts[0] if parts else []

    def tree(self, text: str) -> list[int]:
        """Ids of one text by halves and joins, in this process."""
        out: list[int] = []
        for special, unit in self.units(text):
            if special:
                out.append(self.tok.token_to_id(unit))
            elif len(unit) <= self.leaf:
                out += self.leaf_ids(unit)
            else:
                out += self.join_all([self.leaf_ids(unit[k : k + self.leaf]) for k in range(0, len(unit), self.leaf)])
        return out

    # -- decoding ---------------------------------------------------------------------------------

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids, special tokens included; bytes that are not UTF-8 become U+FFFD, ids beyond the vocabulary nothing."""
        ids = ids[ids < self.size] if len(ids) and int(ids.max()) >= self.size else ids
        return b"".join(map(self.bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def _codec(path: str, long: int, leaf: int) -> Codec:
    return Codec(path, long, leaf)


def codec(path: str, long: int = LONG, leaf: int = LEAF) -> Codec:
    """One per worker process, until another operator runs in it; its cache holds at most two generations of ``CACHE_PIECES`` short pieces."""
    claim("bpe", _codec.cache_clear)
    return _codec(path, long, leaf)


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
