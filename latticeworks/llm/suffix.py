"""Exact substring deduplication by a hash-compared suffix sort.

Every byte that a repeated ``LENGTH``-byte string covers is removed. Strings
that are equal choose the same anchor: in each window of ``LENGTH`` bytes the
``GRAM``-byte string with the least hash (by its upper bits, the last of equals), so on average
one place in 185 bytes is an anchor, and equal windows have anchors of one
hash at one distance. Suffixes are sorted at anchors only.

1. Every text's anchors, with a hash of the text around each (``LENGTH`` bytes
   either way). Anchors whose hash occurs once are done.
2. Anchors of one hash whose surroundings are all equal are copies: what fits
   around them is removed.
3. Others can only share a window if they agree in one of four strings of
   ``LENGTH`` - 100 bytes around the anchor (every window holds one of them);
   their hashes are counted, and only surroundings that share one are fetched,
   each distinct one once. Those of one anchor hash are sorted by the text from the anchor on, and by the text
   before it, with a mergesort that compares suffixes by binary search over
   prefix polynomial hashes for their common extension. From each string a walk
   over its neighbours in order finds the longest extension to either side that,
   with the other, reaches ``LENGTH``; what is found is verified byte by byte.
4. The spans of each text are merged and cut out.

An anchor hash with more than ``MOST`` distinct surroundings is not gathered in
one task: its windows are dealt out by (anchor hash, distance, window hash) and
counted with partial aggregation, which gives the same spans.

Defined cases: null and empty texts have no bytes and nothing removed; texts
shorter than ``LENGTH`` have nothing removed; rows that repeat an id count as
separate documents; a null id is like any other; extra columns are ignored
here and kept by :func:`deduplicate`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, join_small, packed, partitions, unpacked

LENGTH, GRAM = 400, 32
#: Distinct surroundings of one anchor hash that one task sorts.
MOST = 8_000
#: Bytes of surroundings that are sorted at once.
BLOCK = 1 << 20
#: Neighbours on either side that a walk visits before its group is scanned instead.
WALK = 48
#: Row numbers that may be broadcast (8 bytes each); beyond, the join shuffles.
BROADCAST_IDS = 1_000_000
#: Repeated windows of very common anchors that may be broadcast (20 bytes each).
BROADCAST_WINDOWS = 300_000

BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit values (the public splitmix64 constants)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: Follows what comes after an anchor; no byte has this value.
SEPARATOR = 256
_BYTE = mix(np.arange(1, 258, dtype=np.uint64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse modulo 2**64, for i up to n."""
    size = 1 << max(16, int(n + 1).bit_length())
    for have in _powers:
        if have >= size:
            return _powers[have]
    up, down = np.full(size, BASE & _MASK, np.uint64), np.full(size, pow(BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    _powers.clear()
    _powers[size] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers[size]


def prefix(data: np.ndarray) -> np.ndarray:
    """Prefix sums of byte values times powers: the polynomial hashes of all prefixes, modulo 2**64."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=out[1:])
    return out


def hashes(p: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the strings from start to end, independent of where they stand."""
    _, down = powers(len(p))
    return (p[end] - p[start]) * down[start]


#: Low bits of a hash that give way to a position while windows are compared.
PLACE = np.uint64((1 << 26) - 1)


def window_min_last(h: np.ndarray, w: int) -> np.ndarray:
    """Position of the least value in each window of w values, the last of equals; the low 26 bits don't count.

    Positions go into those bits, counted down, so that a minimum takes the value and the position at once;
    longer arrays go in parts that overlap."""
    most = int(PLACE)
    if len(h) > most:
        parts = [window_min_last(h[i : i + most], w) + i for i in range(0, len(h) - w + 1, most - w + 1)]
        return np.concatenate(parts)[: len(h) - w + 1]
    val = (h & ~PLACE) | (PLACE - np.arange(len(h), dtype=np.uint64))
    span = 1
    while span * 2 <= w:
        val = np.minimum(val[:-span], val[span:])
        span *= 2
    if span < w:
        val = np.minimum(val[: len(h) - w + 1], val[w - span : len(h) - span + 1])
    return (PLACE - (val & PLACE)).astype(np.int64)


def anchors(data: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Anchor positions of a text, and their hashes."""
    if len(data) < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    start = np.arange(len(data) - GRAM + 1)
    h = mix((p[GRAM:] - p[: len(start)]) * powers(len(p))[1][: len(start)])
    at = window_min_last(h, LENGTH - GRAM + 1)
    at = np.unique(at)
    return at, h[at]


def _around(p: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lo, hi = np.maximum(at - LENGTH, 0), np.minimum(at + LENGTH, n)
    h = mix(hashes(p, lo, hi) + (at - lo).astype(np.uint64) * np.uint64(0x632BE59BD9B4E019) + (hi - at).astype(np.uint64))
    return h, at - lo, hi - at


#: Between the four strings' starts, in bytes before the anchor.
STEP = 100
PARTS = LENGTH // STEP
FOUND = "row long, anchor long, pos int, around long, before int, after int, " + ", ".join(f"q{a} int" for a in range(PARTS))


def _partial(p: np.ndarray, at: np.ndarray, n: int) -> list[np.ndarray]:
    """32-bit hashes of the strings from ``STEP * a`` bytes before each anchor; 0 where the text doesn't hold it."""
    out = []
    for a in range(PARTS):
        lo, hi = at - STEP * a, at - STEP * a + LENGTH - STEP
        ok = (lo >= 0) & (hi <= n)
        h = (mix(hashes(p, np.where(ok, lo, 0), np.where(ok, hi, 0))) >> np.uint64(32)).astype(np.uint32).view(np.int32)
        out.append(np.where(ok, np.where(h == 0, 1, h), 0).astype(np.int32))
    return out


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, texts = batch.column(0), batch.column(1)
        out: list[list[np.ndarray]] = []
        n = 0
        for row, text in zip(rows, texts, strict=True):
            raw = text.as_py()
            if raw is None or len(raw) < LENGTH:
                continue
            data = np.frombuffer(raw, np.uint8)
            p = prefix(data)
            at, h = anchors(data, p)
            around, before, after = _around(p, at, len(data))
            out.append([np.full(len(at), row.as_py(), np.int64), h.view(np.int64), at.astype(np.int32), around.view(np.int64), before.astype(np.int32), after.astype(np.int32), *_partial(p, at, len(data))])
            n += len(at)
            if n > 50_000:
                yield _anchor_batch(out)
                out, n = [], 0
        if out:
            yield _anchor_batch(out)


def _anchor_batch(out: list[list[np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["row", "anchor", "pos", "around", "before", "after", *(f"q{a}" for a in range(PARTS))])


class Suffixes:
    """Suffixes of one buffer, compared by their polynomial hashes."""

    def __init__(self, data: np.ndarray):
        self.data, self.p = data, prefix(data)
        self.down = powers(len(self.p))[1]

    def common(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Length of the common extension of suffixes at a and b, at most ``most``, by binary search."""
        lo, hi = np.zeros(len(a), np.int64), most.astype(np.int64).copy()
        p, down = self.p, self.down
        while (open_ := lo < hi).any():
            mid = (lo + hi + 1) >> 1
            same = (p[a + mid] - p[a]) * down[a] == (p[b + mid] - p[b]) * down[b]
            lo = np.where(open_ & same, mid, lo)
            hi = np.where(open_ & ~same, mid - 1, hi)
        return lo

    def less(self, a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray) -> np.ndarray:
        """Whether the string of na bytes at a sorts before that of nb bytes at b."""
        n = self.common(a, b, np.minimum(na, nb))
        end = n == np.minimum(na, nb)
        last = len(self.data) - 1
        x, y = self.data[np.minimum(a + n, last)], self.data[np.minimum(b + n, last)]
        return np.where(end, na < nb, x < y)

    def sort(self, group: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Order of the strings (at, size) within each group, by mergesort; ``group`` is ascending."""
        n = len(at)
        first = np.searchsorted(group, group)  # start of each element's group
        last = np.searchsorted(group, group, side="right")
        order = np.arange(n)
        place = np.arange(n) - first  # slot within the group
        width = 1
        while width < int((last - first).max(initial=1)):
            # each element finds, by binary search, how many of the sibling run sort before it
            slot = np.arange(n) - first
            run = slot // width
            mate = first + (run ^ 1) * width
            mate_end = np.minimum(mate + width, last)
            mate = np.minimum(mate, last)
            left = (run & 1) == 0
            lo, hi = mate.copy(), np.maximum(mate_end, mate)
            begin = lo.copy()
            me = order
            while (open_ := lo < hi).any():
                mid = np.where(open_, (lo + hi) >> 1, 0)
                it = order[mid]
                # ties: the left run goes first
                before = np.zeros(n, bool)
                k = np.flatnonzero(open_)
                x, y = np.where(left[k], it[k], me[k]), np.where(left[k], me[k], it[k])
                before[k] = self.less(at[x], size[x], at[y], size[y]) == left[k]
                lo = np.where(open_ & before, mid + 1, lo)
                hi = np.where(open_ & ~before, mid, hi)
            base = first + (run & ~1) * width
            place = base + (slot - run * width) + (lo - begin)
            new = np.empty(n, np.int64)
            new[place] = order
            order = new
            width *= 2
        return order


def reaches(group: np.ndarray, rows: list[bytes], before: np.ndarray, several: np.ndarray, walk: int = WALK) -> tuple[np.ndarray, np.ndarray]:
    """For each surrounding, bytes before and after its anchor that repeated windows
    over the anchor cover; ``group`` (its anchor hash) is ascending, ``several``
    tells that the same surrounding occurs more than once.

    A string with L bytes before the anchor and R after it in common with another
    covers them if L + R is LENGTH at least. Strings are sorted by what follows the
    anchor, then by what precedes it, read backwards; from each one a walk to either
    side meets ever smaller R, and ends when not even the best L of all (a neighbour's
    in the order of what precedes) could make up for it.
    """
    n = len(rows)
    size = np.array([len(r) for r in rows], np.int64)
    after = size - before
    both = [np.frombuffer(r, np.uint8).astype(np.uint16) for r in rows]
    stop = np.array([SEPARATOR], np.uint16)
    data = np.concatenate([x for r, m in zip(both, before, strict=True) for x in (r[m:], stop, r[:m][::-1])])
    start = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
    back = start + after + 1
    s = Suffixes(data)
    order = s.sort(group, start, size + 1)
    a, b = order[:-1], order[1:]
    link = np.where(group[a] == group[b], s.common(start[a], start[b], np.minimum(size[a], size[b]) + 1), -1)
    by_left = s.sort(group, back, before)
    left = np.minimum(_neighbours(s, group, back, before, by_left), LENGTH)
    reach_l, reach_r = np.zeros(n, np.int64), np.zeros(n, np.int64)
    whole = several & (size >= LENGTH)
    reach_l[whole], reach_r[whole] = before[whole], after[whole]
    twin_l, twin_r = np.full(n, -1), np.full(n, -1)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    open_ = np.zeros(n, bool)
    for way in (1, -1):
        me = np.flatnonzero(~whole)
        run = np.full(len(me), 2 * LENGTH + 1)
        for step in range(1, walk + 2):
            at = place[me] + way * step
            inside = (at >= 0) & (at < n)
            me, run, at = me[inside], run[inside], at[inside]
            run = np.minimum(run, link[at - 1] if way > 0 else link[at])
            r = np.minimum(np.minimum(run, after[me]), LENGTH)
            more = (run > 0) & (r + left[me] >= LENGTH) & ((reach_l[me] < left[me]) | (r > reach_r[me]))
            me, run, at, r = me[more], run[more], at[more], r[more]
            if not len(me):
                break
            if step > walk:
                open_[me] = True
                break
            mate = order[at]
            l = np.minimum(s.common(back[me], back[mate], np.minimum(before[me], before[mate])), LENGTH)
            found = l + r >= LENGTH
            i, j, l, r = me[found], mate[found], l[found], r[found]
            longer = l > reach_l[i]
            reach_l[i[longer]], twin_l[i[longer]] = l[longer], j[longer]
            longer = (r > reach_r[i]) | (twin_r[i] < 0)
            reach_r[i[longer]], twin_r[i[longer]] = r[longer], j[longer]
            reach_l[i[(twin_l[i] < 0)]] = 0
    # collision verification of the outermost window on either side, byte by byte
    raw = np.frombuffer(b"".join(rows), np.uint8)
    at = np.concatenate([[0], np.cumsum(size)[:-1]]) + before
    span = np.arange(LENGTH)
    for twins, first in ((twin_l, -reach_l), (twin_r, reach_r - LENGTH)):
        k = np.flatnonzero((twins >= 0) & ~whole)
        for part in np.array_split(k, max(1, len(k) // 2048)):
            x, y = at[part] + first[part], at[twins[part]] + first[part]
            open_[part] |= (raw[x[:, None] + span] != raw[y[:, None] + span]).any(axis=1)
    if open_.any():
        again = np.isin(group, group[open_])
        l, r = _scan(group[again], [rows[i] for i in np.flatnonzero(again)], before[again], whole[again])
        reach_l[again], reach_r[again] = l, r
    return reach_l, reach_r


def _scan(group: np.ndarray, rows: list[bytes], before: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for groups in which the walk is long: equal windows at each distance, from the outside in."""
    n = len(rows)
    size = np.array([len(r) for r in rows], np.int64)
    data = np.frombuffer(b"".join(rows), np.uint8)
    at = np.concatenate([[0], np.cumsum(size)[:-1]]) + before
    after = size - before
    p, salt = prefix(data), mix(group.view(np.uint64))  # one key sorts by group and window
    windows = np.lib.stride_tricks.sliding_window_view(data, LENGTH) if len(data) >= LENGTH else data
    reach_l, reach_r = np.where(whole, before, -1), np.where(whole, after, -1)
    for l in range(LENGTH + 1):
        k = np.flatnonzero((before >= l) & (after >= LENGTH - l))
        if not len(k):
            continue
        h = hashes(p, at[k] - l, at[k] - l + LENGTH) + salt[k]
        o = np.argsort(h)
        k, h = k[o], h[o]
        same = (h[1:] == h[:-1]) & (group[k][1:] == group[k][:-1])
        i = np.flatnonzero(same)
        for part in np.array_split(i, -(-len(i) // 2048) or 1):
            same[part] = (windows[at[k[part]] - l] == windows[at[k[part + 1]] - l]).all(axis=1)
        hit = np.zeros(len(k), bool)
        hit[1:] |= same
        hit[:-1] |= same
        hit = k[hit & ~whole[k]]
        reach_l[hit] = l  # grows, so the last is the most
        reach_r[hit] = np.maximum(reach_r[hit], LENGTH - l)
    return np.maximum(reach_l, 0), np.maximum(reach_r, 0)


def _neighbours(s: Suffixes, group: np.ndarray, at: np.ndarray, size: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Longest common extension of each string with any other of its group: that with a neighbour in order."""
    out = np.zeros(len(at), np.int64)
    a, b = order[:-1], order[1:]
    n = np.where(group[a] == group[b], s.common(at[a], at[b], np.minimum(size[a], size[b])), 0)
    np.maximum.at(out, a, n)
    np.maximum.at(out, b, n)
    return out


def _sorted_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(anchor, around, before, text, several), sorted by anchor, to (anchor, around, l, r) where a window repeats."""
    rows = (r for batch in batches for r in batch.to_pylist())
    held: list[dict] = []
    size = 0
    for _, own in groupby(rows, key=lambda r: r["anchor"]):
        for r in own:
            held.append(r)
            size += len(r["text"])
        if size >= BLOCK:
            yield _reach_batch(held)
            held, size = [], 0
    if held:
        yield _reach_batch(held)


def _reach_batch(held: list[dict]) -> pa.RecordBatch:
    anchor = np.array([r["anchor"] for r in held], np.int64)
    order = np.argsort(anchor, kind="stable")
    held = [held[i] for i in order]
    anchor = anchor[order]
    l, r = reaches(anchor, [x["text"] for x in held], np.array([x["before"] for x in held], np.int64), np.array([x["several"] for x in held], bool))
    got = ((l > 0) | (r > 0)) & ~np.array([x["several"] for x in held], bool)  # those are known without a sort
    return pa.RecordBatch.from_arrays([pa.array(anchor[got]), pa.array(np.array([x["around"] for x in held], np.int64)[got]), pa.array(l[got].astype(np.int32)), pa.array(r[got].astype(np.int32))], names=["anchor", "around", "l", "r"])


def spans(texts: DataFrame, most: int = MOST) -> DataFrame:
    """(row, lo, hi) of bytes to remove, overlapping; ``texts`` has row (unique long) and raw (binary)."""
    spark = texts.sparkSession
    found = cut(texts.select("row", "raw").mapInArrow(_find, FOUND), "anchors")
    per = found.groupBy("anchor").agg(F.count("*").alias("total"), F.min("around").alias("a0"), F.max("around").alias("a1"), F.min("before").alias("l"), F.min("after").alias("r"))
    per = cut(per.where("total > 1").drop("total"), "repeated")
    # equal surroundings have equal lengths either way
    copies = per.where((F.col("a0") == F.col("a1")) & (F.col("l") + F.col("r") >= LENGTH)).select("anchor", F.col("a0").alias("around"), "l", "r")
    several = join_small(found, per.where("a0 <> a1").select("anchor"), "anchor", "left_semi", BROADCAST_IDS)
    kinds = cut(several.groupBy("anchor", "around").agg(F.count("*").alias("n"), F.min(F.struct("row", "pos", "before", "after", *(f"q{a}" for a in range(PARTS)))).alias("at")), "kinds")
    whole = kinds.where((F.col("n") > 1) & (F.col("at.before") + F.col("at.after") >= LENGTH)).select("anchor", "around", F.col("at.before").alias("l"), F.col("at.after").alias("r"))
    strings = kinds.select("anchor", "around", F.posexplode(F.array(*(f"at.q{a}" for a in range(PARTS)))).alias("a", "q")).where("q <> 0")
    shared = cut(strings.groupBy("anchor", "a", "q").count().where("count > 1").drop("count"), "shared")
    able = join_small(strings, shared, ["anchor", "a", "q"], "left_semi", BROADCAST_WINDOWS).groupBy("anchor", "around").agg(F.bit_or(F.expr("shiftleft(1, a)")).alias("mask"))
    kinds = cut(kinds.select("anchor", "around", "n", *(f"at.{c}" for c in ("row", "pos", "before", "after"))).join(able, ["anchor", "around"]), "able")
    hot = cut(kinds.groupBy("anchor").count().where(F.col("count") > most).select("anchor", F.lit(True).alias("hot")), "hot")
    mixed = join_small(kinds, hot, "anchor", "left", BROADCAST_IDS).select("anchor", "around", F.coalesce("hot", F.lit(False)).alias("hot"), (F.col("n") > 1).alias("several"), "mask", "row", "pos", "before", "after")

    @F.pandas_udf("array<binary>")
    def pieces(raw: pd.Series, wanted: pd.Series) -> pd.Series:
        return pd.Series([[t[w["pos"] - w["before"] : w["pos"] + w["after"]] for w in ws] for t, ws in zip(raw, wanted, strict=True)])

    asked = mixed.groupBy("row").agg(F.collect_list(F.struct("anchor", "around", "hot", "several", "mask", "pos", "before", "after")).alias("wanted"))
    asked = cut(asked, "asked")
    fetched = join_small(texts.select("row", "raw"), asked.select("row"), "row", "left_semi", BROADCAST_IDS).join(asked, "row").withColumn("piece", pieces("raw", "wanted"))
    fetched = fetched.select(F.explode(F.arrays_zip("wanted", "piece")).alias("x")).select("x.wanted.*", F.col("x.piece").alias("text"))
    fetched = fetched.select("anchor", "around", "hot", "before", "text", "several", "mask")
    has_hot = not hot.isEmpty()
    if has_hot:
        fetched = cut(fetched, "surroundings")
    few = fetched.where("NOT hot").select("anchor", "around", "before", "text", "several")
    few = few.repartition(partitions(spark), "anchor").sortWithinPartitions("anchor")
    reach = few.mapInArrow(_sorted_groups, "anchor long, around long, l int, r int")
    parts = [copies, whole, reach]
    if has_hot:
        parts.append(_dealt(fetched.where("hot").drop("hot")))
    every = parts[0]
    for x in parts[1:]:
        every = every.unionByName(x)
    reached = found.select("row", "anchor", "around", "pos").join(cut(every, "reaches"), ["anchor", "around"])
    return reached.select("row", (F.col("pos") - F.col("l")).alias("lo"), (F.col("pos") + F.col("r")).alias("hi"))


def _dealt(many: DataFrame) -> DataFrame:
    """Reaches of anchors with very many surroundings, by counting windows over all tasks."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                data = np.frombuffer(r["text"], np.uint8)
                last = len(data) - LENGTH
                lo = np.arange(max(0, r["before"] - LENGTH), min(r["before"], last) + 1)
                # only windows that hold a string which is shared
                lo = lo[(r["mask"] >> np.minimum((r["before"] - lo) // STEP, PARTS - 1)) & 1 == 1]
                if not len(lo):
                    continue
                h = mix(hashes(prefix(data), lo, lo + LENGTH))
                m = len(lo)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(m, r["anchor"])), pa.array(np.full(m, r["around"])), pa.array((r["before"] - lo).astype(np.int32)), pa.array(h.view(np.int64)), pa.array(np.full(m, 2 if r["several"] else 1))],
                    names=["anchor", "around", "l", "h", "n"],
                )

    own = many.mapInArrow(windows, "anchor long, around long, l int, h long, n long")
    again = cut(own.groupBy("anchor", "l", "h").agg(F.sum("n").alias("n")).where("n > 1").select("anchor", "l", "h"), "again")
    hit = join_small(own, again, ["anchor", "l", "h"], "left_semi", BROADCAST_WINDOWS)
    return hit.groupBy("anchor", "around").agg(F.max("l").cast("int").alias("l"), (F.lit(LENGTH) - F.min("l")).cast("int").alias("r"))


def _tagged(docs: DataFrame, text_col: str) -> DataFrame:
    """``docs`` with a unique ``row`` and the text's bytes ``raw``, written so that the numbers stay."""
    return cut(docs.withColumn("row", F.monotonically_increasing_id()).withColumn("raw", F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))).drop(text_col), "texts")


CUT = "n_removed long, n_spans long, kept binary"


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def cut_out(texts: DataFrame, most: int = MOST) -> DataFrame:
    """``texts`` with n_removed, n_spans and the bytes kept."""
    runs = cut(spans(texts, most).groupBy("row").agg(F.collect_set(F.struct("lo", "hi")).alias("_runs")), "runs")
    ids = runs.select("row")

    @F.pandas_udf(CUT)
    def kept(raw: pd.Series, runs: pd.Series) -> pd.DataFrame:
        out = []
        for t, rs in zip(raw, runs, strict=True):
            t = bytes(t)
            rs = merged([(r["lo"], r["hi"]) for r in rs])
            keep, at = [], 0
            for a, b in rs:
                keep.append(t[at:a])
                at = b
            keep.append(t[at:])
            out.append((sum(b - a for a, b in rs), len(rs), b"".join(keep)))
        return pd.DataFrame(out, columns=["n_removed", "n_spans", "kept"])

    # only texts that lose something travel to their spans
    touched = join_small(texts, ids, "row", "left_semi", BROADCAST_IDS).join(runs, "row").withColumn("_cut", kept("raw", "_runs")).drop("_runs")
    whole = F.struct(F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.col("raw").alias("kept"))
    return touched.unionByName(join_small(texts, ids, "row", "left_anti", BROADCAST_IDS).withColumn("_cut", whole))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MOST) -> DataFrame:
    """id, n_bytes, n_removed, n_spans and the hash of what is kept of every text."""
    done = cut_out(_tagged(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")), "_t"), most)
    return done.select(F.col("_id").alias(id_col), F.octet_length("raw").cast("long").alias("n_bytes"), "_cut.n_removed", "_cut.n_spans", F.sha2("_cut.kept", 256).alias("kept_sha256"))


def deduplicate(docs: DataFrame, text_col: str = "text", most: int = MOST) -> DataFrame:
    """``docs`` with repeated strings cut out; a cut within a character leaves a replacement character."""
    done = cut_out(_tagged(packed(docs, _t=text_col), "_t"), most)

    @F.pandas_udf("string")
    def text(raw: pd.Series) -> pd.Series:
        return pd.Series([bytes(r).decode("utf-8", "replace") for r in raw])

    return unpacked(done.withColumn("_t", text("_cut.kept")), docs.columns, **{text_col: "_t"})


def brute(texts: list[bytes]) -> list[tuple[int, int, str]]:
    """(removed, spans, hash of the rest) by counting every window; for tests."""
    seen: dict[bytes, int] = {}
    for t in texts:
        for i in range(len(t) - LENGTH + 1):
            w = t[i : i + LENGTH]
            seen[w] = seen.get(w, 0) + 1
    out = []
    for t in texts:
        rs = merged([(i, i + LENGTH) for i in range(len(t) - LENGTH + 1) if seen[t[i : i + LENGTH]] > 1])
        keep, at = [], 0
        for a, b in rs:
            keep.append(t[at:a])
            at = b
        keep.append(t[at:])
        out.append((sum(b - a for a, b in rs), len(rs), hashlib.sha256(b"".join(keep)).hexdigest()))
    return out
