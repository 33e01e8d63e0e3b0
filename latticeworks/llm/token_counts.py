"""Exact token counts of every prefix, by dynamic programming.

The byte-level vocabulary splits a text into pieces that are encoded apart.
Within a piece, the encoding of each prefix ends in exactly one token: of the
tokens that end there, the one that is right beside the last token of the
prefix before it (two tokens are right side by side if they are the encoding
of their own concatenation). So ``count[i] = count[i - len(token)] + 1`` gives
the exact count of every prefix in one pass. Adding the counts of the pieces
before gives the count of every prefix of the text, from which truncation and
budget questions are answered without encoding anything again.

Pieces repeat, so a worker keeps the counts of the pieces it has seen.

Defined cases: null and empty texts have no tokens; repeated rows give equal
results each; prefixes are taken at byte positions, and a prefix that cuts a
character counts as its bytes do; special strings in a text are one token
(cutting one gives the count of its ordinary bytes); extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import tokenizer_path

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 512
#: Chunks, and token pairs, that a worker remembers.
REMEMBER, PAIRS = 250_000, 500_000
#: Chunks of at most so many bytes are remembered.
SHORT = 64
#: Text at a white-space boundary: a word with the one space before it, or white space up to the last before a word.
CHUNKS = re.compile(r" ?[^ \t-\r]+|[ \t-\r]+(?![^ \t-\r])|[ \t-\r]")
#: White space beyond ASCII, where chunks are not independent.
WIDE = re.compile("[\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]")
#: Runs of white space, which a prefix that ends within has as one piece.
RUNS = re.compile("[ \\t-\\r\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]{2,}")
#: Text beyond the Latin blocks, whose letters the library's own tables decide.
FAR = re.compile("[^\\x00-\\u024f]")
_LETTERS = "".join(re.escape(chr(c)) for c in range(0x250) if chr(c).isalpha())
_NUMBERS = "".join(chr(c) for c in range(0x250) if unicodedata.category(chr(c))[0] == "N")
_SPACE = " \\t-\\r\\x85\\xa0"
#: The vocabulary's rule for splitting text (a fixed, public pattern), with its classes spelled out for Latin text.
PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[{_NUMBERS}]+| ?[^{_SPACE}{_LETTERS}{_NUMBERS}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
#: The contractions whose proper prefix is split otherwise.
CONTRACTIONS = ("'re", "'ve", "'ll")


def byte_symbols() -> dict[str, int]:
    """The printable symbol of each byte in byte-level vocabularies, from the rule: printable Latin-1 stands for itself, the rest are moved past 255."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(moved)}


class Counter:
    def __init__(self, name: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        path = tokenizer_path(name)
        self.tok = Tokenizer.from_file(path)
        self.model, self.pre = self.tok.model, self.tok.pre_tokenizer
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.special_rx = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.vocab = spec["model"]["vocab"]
        # A token that merges never make is in no encoding.
        self.ids = {t: i for t, i in self.vocab.items() if t not in self.special}
        self.ends = ahocorasick.Automaton()
        for t, i in self.ids.items():
            self.ends.add_word(t, (i, len(t)))
        self.ends.make_automaton()
        self.text = {i: t for t, i in self.ids.items()}
        self.right: dict[int, bool] = {}
        self.whole: dict[int, bool] = {}
        self.known: dict[str, int] = {}
        self.older: dict[str, int] = {}
        self.pieces: dict[str, list[int]] = {}
        self.symbol = {b: s for s, b in byte_symbols().items()}

    def beside(self, a: int, b: int) -> bool:
        key = a << 20 | b
        ok = self.right.get(key)
        if ok is None:
            if len(self.right) >= PAIRS:
                self.right.clear()
            got = self.model.tokenize(self.text[a] + self.text[b])
            ok = self.right[key] = len(got) == 2 and got[0].id == a and got[1].id == b
        return ok

    def alone(self, a: int) -> bool:
        ok = self.whole.get(a)
        if ok is None:
            got = self.model.tokenize(self.text[a])
            ok = self.whole[a] = len(got) == 1 and got[0].id == a
        return ok

    def piece(self, symbols: str) -> list[int]:
        """Token counts of the prefixes of 1, 2, ... symbols (bytes) of one piece."""
        n = len(symbols)
        last, count = [0] * (n + 1), [0] * (n + 1)
        done, right = 0, self.right
        for at, (t, size) in self.ends.iter(symbols):  # every vocabulary entry that ends at each symbol
            i = at + 1
            if i == done:
                continue
            j = i - size
            if j:
                ok = right.get(last[j] << 20 | t)
                if ok is None:
                    ok = self.beside(last[j], t)
            else:
                ok = self.alone(t)
            if ok:
                last[i], count[i], done = t, count[j] + 1, i
        return count[1:]

    def counts(self, symbols: str) -> list[int]:
        """The same, from memory, with prefixes of contractions as the library splits them."""
        c = self.pieces.get(symbols)
        if c is None:
            c = self.piece(symbols)
            if symbols in CONTRACTIONS:
                c[1] = 2
            if len(symbols) <= SHORT:
                if len(self.pieces) >= REMEMBER:
                    self.pieces.clear()
                self.pieces[symbols] = c
        return c

    def chunk(self, chunk: str) -> np.ndarray:
        """Counts after each byte of a chunk."""
        out: list[int] = []
        base = 0
        for symbols, _ in self.pre.pre_tokenize_str(chunk):
            out += [base + x for x in self.counts(symbols)]
            base = out[-1]
        return np.array(out, np.int32)

    def last_count(self, chunk: str, whole: bool = False) -> int:
        """The count after a chunk's last byte; ``whole``: it is known to be one piece."""
        got = self.older.get(chunk)
        if got is None:
            if whole:
                got = self.piece(chunk.encode().decode("latin-1").translate(self.symbol))[-1]
            else:
                got = sum(self.counts(symbols)[-1] for symbols, _ in self.pre.pre_tokenize_str(chunk))
        if len(chunk) <= SHORT:
            if len(self.known) >= REMEMBER:  # what was met again since stays
                self.older, self.known = self.known, {}
            self.known[chunk] = got
        return got

    def _parts(self, text: str) -> Iterator[tuple[str, bool]]:
        """Texts between special strings, and those strings."""
        at = 0
        for m in self.special_rx.finditer(text) if self.special_rx else ():
            if m.start() > at:
                yield text[at : m.start()], False
            yield m[0], True
            at = m.end()
        if at < len(text):
            yield text[at:], False

    def table(self, text: str | None) -> np.ndarray:
        """Counts of all prefixes, by bytes: element i is that of the first i bytes."""
        out, base = [np.zeros(1, np.int32)], 0
        for part, special in self._parts(text or ""):
            if special:
                c = base + self.chunk(part)
                c[-1] = base = base + 1
                out.append(c)
                continue
            counts = [np.array([base], np.int32)]
            for x in [part] if WIDE.search(part) else CHUNKS.findall(part):
                counts.append(self.chunk(x) + counts[-1][-1])
            c = np.concatenate(counts)
            base = int(c[-1])
            at = pos = 0  # in bytes, in characters
            for m in RUNS.finditer(part):
                at += len(part[pos : m.start()].encode())
                run = m[0].encode()
                c[at + 1 : at + 1 + len(run)] = c[at] + np.array(self.piece("".join(self.symbol[b] for b in run)), np.int32)
                at, pos = at + len(run), m.end()
            out.append(c[1:])
        return np.concatenate(out)

    def total(self, text: str | None) -> int:
        """The last element of the table, from the last elements of its chunks."""
        n = 0
        for part, special in self._parts(text or ""):
            if special:
                n += 1
                continue
            near = not FAR.search(part)
            if not near and WIDE.search(part):
                n += self.last_count(part)
                continue
            chunks = (PIECES if near else CHUNKS).findall(part)
            found = list(map(self.known.get, chunks))
            if None in found:
                found = [self.last_count(x, near) if c is None else c for x, c in zip(chunks, found, strict=True)]
            n += sum(found)
        return n


_counters: dict[str, Counter] = {}


def counter(name: str) -> Counter:
    if name not in _counters:
        _counters[name] = Counter(name)
    return _counters[name]


def within(table: np.ndarray, budget: int) -> int:
    """Bytes of the longest prefix of at most ``budget`` tokens."""
    return int(np.flatnonzero(table <= budget)[-1])


def n_tokens(text: Column, name: str = VOCABULARY) -> Column:
    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        c = counter(name)
        return pd.Series([c.total(t) for t in texts], index=texts.index, dtype="int64")

    return run(text)


def prefix_table(text: Column, name: str = VOCABULARY) -> Column:
    """Binary of little-endian 32-bit counts, one per byte position."""

    @F.pandas_udf("binary")
    def run(texts: pd.Series) -> pd.Series:
        c = counter(name)
        return pd.Series([c.table(t).astype("<i4").tobytes() for t in texts], index=texts.index)

    return run(text)


def fitting_bytes(table: Column, budget: int) -> Column:
    """Bytes of the longest prefix within the budget, from a stored prefix table."""

    @F.pandas_udf("long")
    def run(tables: pd.Series) -> pd.Series:
        return pd.Series([within(np.frombuffer(t, "<i4"), budget) for t in tables], index=tables.index, dtype="int64")

    return run(table)


def count(docs: DataFrame, name: str = VOCABULARY, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_tokens and whether the text is over the limit."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    return (
        docs.select(F.col(id_col), F.octet_length(t).cast("long").alias("n_bytes"), n_tokens(t, name).alias("n_tokens"))
        .withColumn("over_limit", F.col("n_tokens") > limit)
    )
