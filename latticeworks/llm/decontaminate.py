"""Benchmark decontamination with a generalised suffix automaton.

Test items are normalised to words and put into one automaton over word
numbers. A document's words stream through it; the state and the matched
length tell, at every word, which item windows end there: ``window``
consecutive words of an item, or the whole of an item of fewer words.

Before that, a document is split where two neighbouring words never are
neighbours in an item: no match crosses such a place, so only runs at least as
long as the shortest window reach the automaton.

Items are dealt over blocks of about ``block_words`` words by a hash, and each
block's automaton is built in a task and written as a file in the session's
shared folder. Documents are passed once: a worker takes each batch through
the blocks' files one after the other, holding one automaton at a time, and
merges the hits of a document by position. Nothing of the benchmark goes
through the driver or into a plan, however large it is.

Defined cases: a null or empty text has no words; an item without words has no
windows; items that repeat an id count once, as do all items without an id,
which ``items_sha256`` can't name; tables may be empty;
further columns are ignored here and kept by :func:`clean`.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
from pyarrow.fs import FileSelector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_fs, fresh_path, packed, tidied, unpacked

WINDOW = 10
BLOCK_WORDS = 200_000
#: A-Z to a-z; every other ASCII character that is no letter or digit to a space.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or c >= 97 and c <= 122 or c >= 128 else 32 for c in range(256))
SPANS = "n_words long, n_hit long, n_items long, items_sha256 string, coverage double, spans array<struct<start:int,end:int>>, item_ids array<string>"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(FOLD).split()


class Automaton:
    """Suffix automaton of all items; ``ends`` gives the windows that end in a state."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int = WINDOW):
        self.number: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.items = items
        coded = [[self.number.setdefault(w, len(self.number)) for w in words] for _, words in items]
        for c in coded:
            self._add(c)
        self.own: list[dict[int, set[int]]] = [{} for _ in self.next]
        for k, c in enumerate(coded):
            if c:
                self._register(k, c, min(window, len(c)))
        self.shortest = min((min(window, len(c)) for c in coded if c), default=0)
        self.up = [-1] * len(self.next)  # the next state on the way to the root that has windows
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            parent = self.link[s]
            self.up[s] = parent if self.own[parent] else self.up[parent] if parent > 0 else -1
        pairs = {a * len(self.number) + b for c in coded for a, b in zip(c, c[1:], strict=False)}
        self.pairs = np.array(sorted(pairs), np.int64)

    def _add(self, word_numbers: list[int]) -> None:
        last = 0
        for c in word_numbers:
            if c in self.next[last]:
                q = self.next[last][c]
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
                continue
            new = len(self.next)
            self.next.append({})
            self.length.append(self.length[last] + 1)
            self.link.append(0)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = new
                p = self.link[p]
            if p >= 0:
                q = self.next[p][c]
                self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
            last = new

    def _split(self, p: int, c: int, q: int) -> int:
        clone = len(self.next)
        self.next.append(dict(self.next[q]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def walk(self, codes: list[int]) -> Iterator[tuple[int, int, int]]:
        """Position, state and longest matched length after each word."""
        state, n = 0, 0
        for i, c in enumerate(codes):
            while state and c not in self.next[state]:
                state = self.link[state]
                n = self.length[state]
            if c in self.next[state]:
                state = self.next[state][c]
                n += 1
            yield i, state, n

    def _register(self, item: int, codes: list[int], size: int) -> None:
        for _, state, n in self.walk(codes):
            if n >= size:
                while self.length[self.link[state]] >= size:
                    state = self.link[state]
                self.own[state].setdefault(size, set()).add(item)

    def match(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Maximal hit runs (first word, end) and the items whose windows occur."""
        hits: list[tuple[int, int]] = []
        found: set[int] = set()
        if not self.shortest or len(words) < self.shortest:
            return hits, found
        get = self.number.get
        codes = np.array([get(w, -1) for w in words], np.int64)
        inside = codes >= 0
        if not inside.any():
            return hits, found
        joined = inside[:-1] & inside[1:]
        if len(self.pairs) and joined.any():
            key = codes[:-1][joined] * len(self.number) + codes[1:][joined]
            at = np.searchsorted(self.pairs, key)
            joined[joined] = self.pairs[np.minimum(at, len(self.pairs) - 1)] == key
        else:
            joined[:] = False
        cuts = np.flatnonzero(~joined) + 1
        first, end = np.append(0, cuts), np.append(cuts, len(codes))
        keep = (end - first >= self.shortest) & inside[first]
        for a, b in zip(first[keep].tolist(), end[keep].tolist(), strict=True):
            for i, state, n in self.walk(codes[a:b].tolist()):
                s = state
                while s > 0:
                    for size, items in self.own[s].items():
                        if size <= n:
                            found |= items
                            lo, hi = a + i + 1 - size, a + i + 1
                            while hits and lo <= hits[-1][1]:
                                lo, hi = min(lo, hits[-1][0]), max(hi, hits[-1][1])
                                hits.pop()
                            hits.append((lo, hi))
                    s = self.up[s]
        return hits, found


def written_blocks(items: DataFrame, id_col: str, text_col: str, block_words: int, window: int) -> tuple[str, int]:
    """A folder with the automata of the items' blocks, one file a block (none without words), and the number of blocks."""
    spark = items.sparkSession

    @F.pandas_udf("long")
    def size(texts: pd.Series) -> pd.Series:
        return pd.Series([len(words_of(t)) for t in texts], index=texts.index, dtype="int64")

    own = items.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t"))
    n = max(1, -(-(own.agg(F.sum(size("t"))).first()[0] or 0) // block_words))

    def built(pdf: pd.DataFrame) -> pd.DataFrame:
        listed = [(None if pd.isna(i) else i, words_of(t)) for i, t in zip(pdf["i"], pdf["t"], strict=True)]
        made = Automaton(sorted((x for x in listed if x[1]), key=lambda x: (x[0] or "", x[1])), window)
        made.items = [(i, []) for i, _ in made.items]  # only the names are needed from here on
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "automaton": [pickle.dumps(made)]})

    path = fresh_path(spark, "automata")
    dealt = own.where("t IS NOT NULL").distinct().withColumn("block", F.pmod(F.xxhash64("i", "t"), F.lit(n)))
    dealt.groupBy("block").applyInPandas(built, "block long, automaton binary").write.partitionBy("block").parquet(path)
    return path, n


_loaded: dict[tuple[str, int], Automaton | None] = {}


def automaton(path: str, block: int) -> Automaton | None:
    """A block's automaton from its file; a worker holds the last one."""
    if (path, block) not in _loaded:
        _loaded.clear()
        fs, root = arrow_fs(f"{path}/block={block}")
        files = [f.path for f in fs.get_file_info(FileSelector(root, allow_not_found=True)) if f.path.endswith(".parquet")]
        made = [x for f in files for x in pq.ParquetFile(f, filesystem=fs).read(["automaton"]).column(0).to_pylist()]
        _loaded[path, block] = pickle.loads(made[0]) if made else None
    return _loaded[path, block]


def report(n_words: int, spans: list[tuple[int, int]], ids: set[str | None]) -> tuple:
    n_hit = sum(b - a for a, b in spans)
    names = sorted(ids - {None}, key=lambda x: x.encode())
    sha = hashlib.sha256(",".join(names).encode()).hexdigest()
    return n_words, n_hit, len(ids), sha, n_hit / n_words if n_words else 0.0, [{"start": a, "end": b} for a, b in spans], names


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


#: Texts and bytes of text that a worker takes through the blocks at once.
TEXTS, BYTES = 10_000, 32 << 20


def matched(path: str, n: int, texts: list[str | None]) -> list[tuple]:
    """What the items of ``n`` blocks hit in each text, as rows of SPANS."""
    if n == 1:
        made = automaton(path, 0)
        out = []
        for t in texts:
            words = words_of(t)
            spans, found = made.match(words) if made else ([], set())
            out.append(report(len(words), spans, {made.items[k][0] for k in found}))
        return out
    runs: list[list[tuple[int, int]]] = [[] for _ in texts]
    ids: list[set[str | None]] = [set() for _ in texts]
    for b in range(n):
        made = automaton(path, b)
        if made is None:
            continue
        for k, t in enumerate(texts):
            spans, found = made.match(words_of(t))
            runs[k] += spans
            ids[k] |= {made.items[x][0] for x in found}
    return [report(len(words_of(t)), merged(r), i) for t, r, i in zip(texts, runs, ids, strict=True)]


def with_hits(docs: DataFrame, items: DataFrame, out: str = "_hits", window: int = WINDOW, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` with a struct column ``out``: n_words, n_hit, n_items, items_sha256, coverage, spans (of words), item_ids."""
    path, n = written_blocks(items, item_id, item_text, block_words, window)

    def rows_of(texts: pd.Series) -> pd.DataFrame:
        rows: list[tuple] = []
        held: list[str | None] = []
        size = 0
        for t in texts:
            held.append(t)
            size += len(t or "")
            if len(held) >= TEXTS or size >= BYTES:
                rows += matched(path, n, held)
                held, size = [], 0
        rows += matched(path, n, held)
        return pd.DataFrame(rows, columns=["n_words", "n_hit", "n_items", "items_sha256", "coverage", "spans", "item_ids"])

    @F.pandas_udf(SPANS)
    def hits(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        return tidied(lambda some: map(rows_of, some))(batches)

    return docs.withColumn(out, hits(text_col))


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **more) -> DataFrame:
    """id, counts, spans and whether any window occurs."""
    text_col = more.pop("text_col", "text")
    hit = with_hits(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")), items, text_col="_t", **more)
    return hit.select(F.col("_id").alias(id_col), "_hits.*", (F.col("_hits.n_hit") > 0).alias("contaminated"))


def clean(docs: DataFrame, items: DataFrame, max_words: int = 0, max_coverage: float = 1.0, text_col: str = "text", **more) -> DataFrame:
    """``docs`` without the documents that have more than ``max_words`` hit words or a larger coverage; columns as they were."""
    hit = with_hits(packed(docs, _t=text_col), items, text_col="_t", **more)
    return unpacked(hit.where((F.col("_hits.n_hit") <= max_words) & (F.col("_hits.coverage") <= max_coverage)), docs.columns)


def cut_spans(docs: DataFrame, items: DataFrame, min_words: int = WINDOW, text_col: str = "text", **more) -> DataFrame:
    """``docs`` with hit runs of at least ``min_words`` words removed from the text, from the run's first to its last word."""

    @F.pandas_udf("string")
    def removed(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for t, ss in zip(texts, spans, strict=True):
            runs = [(int(s["start"]), int(s["end"])) for s in ss if s["end"] - s["start"] >= min_words]
            if t is None or not runs:
                out.append(t)
                continue
            raw = t.encode("utf-8", "replace")
            solid = np.frombuffer(raw.translate(FOLD), np.uint8) != 32
            edge = np.flatnonzero(np.diff(np.concatenate([[0], solid.astype(np.int8), [0]])))
            keep, at = [], 0
            for a, b in runs:
                keep.append(raw[at : edge[2 * a]])
                at = edge[2 * b - 1]
            out.append((b"".join(keep) + raw[at:]).decode("utf-8", "replace"))
        return pd.Series(out, index=texts.index)

    hit = with_hits(packed(docs, _t=text_col), items, text_col="_t", **more)
    return unpacked(hit.withColumn("_t", removed("_t", "_hits.spans")), docs.columns, **{text_col: "_t"})
