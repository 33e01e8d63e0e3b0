"""Secret scans over a trigram inverted index, in DataFrame operations only.

Each rule's Boolean trigram query is derived from its regular expression (see
``trigram_query``): a disjunction of sets of trigrams, one set of which occurs
(ASCII letters folded) in every text that the expression matches. The index
lists, for each trigram of the rules, the texts that hold it, by a 64-bit hash
of the text; a set's texts are the intersection of its postings, a rule's the
union over its sets. Only those candidates are verified with the regular
expression. A rule whose expression forces no trigram (long hexadecimal runs)
has no query and scans every text.

Positions come from ``split`` and ``regexp_extract_all`` with one expression:
a match starts after all gaps and matches before it. Both work on code points.
They are summed block by block, so that a text of very many spans takes no
quadratic time.

Defined cases: a null or empty text has no spans; ids take no part in the
search, so that rows with null or equal ids are verified like others; texts of
one hash are candidates together (verification is per row); extra columns are
ignored here and kept by :func:`redact`.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, join_small, packed, unpacked
from .trigram_query import derive

#: Candidates that may be broadcast (8 bytes and the kinds' names each); beyond, the join shuffles.
BROADCAST_KEYS = 500_000


@dataclass(frozen=True)
class Rule:
    kind: str
    regex: str
    group: int  # whose length counts
    least: int

    def query(self) -> list[frozenset[str]]:
        """Trigram sets; a matching text holds all trigrams of one of them. None: scan fully."""
        return derive(self.regex)


#: The patterns as required, in the order in which kinds are listed.
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]+", 0, 32),
)


def pattern(rule: Rule) -> str:
    """The expression to run. Where the group is the whole match and one greedy class ends it, the least length goes into it: a shorter match is dropped, and no part of it can be a match."""
    if rule.group == 0 and rule.regex.endswith("]+"):
        head = rule.regex.partition("[")[0]
        return f"{rule.regex[:-1]}{{{rule.least - len(head)},}}"
    return rule.regex


def trigrams(rules: tuple[Rule, ...] = RULES) -> list[str]:
    return sorted({t for r in rules for s in r.query() for t in s})


def _key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def index(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """Postings: (trigram, key), distinct, for every trigram that a rule asks for; key is the hash of the text."""
    wanted = trigrams(rules)
    rx = "|".join(re.escape(t) for t in wanted) or "(?!)"
    found = F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(f"(?=({rx}))"), F.lit(1))
    return docs.select(_key(F.col(text_col)).alias("key"), F.explode(F.array_distinct(found)).alias("trigram")).distinct()


def candidates(postings: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(key, kinds): the rules whose trigram query a text's postings satisfy.

    A text is in all postings of a set, their intersection, when it is in as many as the set has."""
    sets = [(r.kind, s) for r in rules for s in r.query()]
    counts = [F.count_if(F.col("trigram").isin(sorted(s))).alias(f"n{i}") for i, (_, s) in enumerate(sets)]
    kinds = F.array_distinct(F.array_compact(F.array(*(F.when(F.col(f"n{i}") == len(s), F.lit(k)) for i, (k, s) in enumerate(sets)))))
    if not sets:
        return postings.select("key", F.array().cast("array<string>").alias("kinds")).where("false")
    return postings.groupBy("key").agg(*counts).select("key", kinds.alias("kinds")).where(F.size("kinds") > 0)


#: Matches whose lengths are summed at once.
BLOCK = 64


def spans_of(text: str, rule: Rule) -> Column:
    """Array of (start, end) of the rule's matches that are long enough; ``text`` names a column."""
    rx = F.lit(pattern(rule))
    whole = F.regexp_extract_all(F.col(text), rx, F.lit(0))
    counted = F.regexp_extract_all(F.col(text), rx, F.lit(rule.group)) if rule.group else whole
    gaps = F.split(F.col(text), pattern(rule), -1)
    steps = F.zip_with(
        F.slice(F.transform(gaps, F.length), 1, F.size(whole)),
        F.zip_with(whole, counted, lambda w, c: F.struct(F.length(w).alias("w"), F.length(c).alias("c"))),
        lambda g, x: F.struct(g.alias("g"), x["w"].alias("w"), x["c"].alias("c")),
    )
    none = F.array().cast("array<struct<s:int,e:int>>")
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(whole) - 1) / BLOCK).cast("int")), lambda i: F.slice(steps, i * BLOCK + 1, BLOCK))
    starts = F.aggregate(
        blocks,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
        lambda a, x: F.struct(F.aggregate(x, a["at"], lambda n, y: n + y["g"] + y["w"]).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")),
        lambda a: a["out"],
    )
    placed = F.zip_with(
        blocks,
        starts,
        lambda x, start: F.aggregate(
            x,
            F.struct(start.alias("at"), none.alias("out")),
            lambda a, y: F.struct(
                (a["at"] + y["g"] + y["w"]).alias("at"),
                F.when(y["c"] >= rule.least, F.concat(a["out"], F.array(F.struct((a["at"] + y["g"]).alias("s"), (a["at"] + y["g"] + y["w"]).alias("e"))))).otherwise(a["out"]).alias("out"),
            ),
            lambda a: a["out"],
        ),
    )
    return F.when(F.col(text).rlike(pattern(rule)), F.flatten(placed)).otherwise(none)


def _numbered(spans: str, k: int) -> Column:
    return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e")))


def _masked(whole: Column, counted: Column, rule: Rule) -> Column:
    return F.zip_with(whole, counted, lambda w, c: F.when(F.length(c) >= rule.least, F.lit(f"[{rule.kind}]")).otherwise(w))


def flagged(docs: DataFrame, rules: tuple[Rule, ...], text_col: str) -> DataFrame:
    """``docs`` with ``_kinds``: the indexed rules that each row is a candidate of."""
    found = cut(candidates(index(docs, rules, text_col), rules), "candidates").select(F.col("key").alias("_key"), F.col("kinds").alias("_kinds"))
    return join_small(docs.withColumn("_key", _key(F.col(text_col))), found, "_key", "left", BROADCAST_KEYS).drop("_key")


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, and per kind the spans found: n_<kind>, base_sha256, spans (``kind:start:end``, by start, then kind)."""
    d = flagged(docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")), rules, "_text")
    none = F.array().cast("array<struct<s:int,e:int>>")
    for r in rules:
        asked = F.array_contains(F.coalesce(F.col("_kinds"), F.array().cast("array<string>")), r.kind) if r.query() else F.lit(True)
        d = d.withColumn(f"_{r.kind}", F.when(asked, spans_of("_text", r)).otherwise(none))
    listed = F.array_sort(F.concat(*(_numbered(f"_{r.kind}", i) for i, r in enumerate(rules))))
    names = F.array(*(F.lit(r.kind) for r in rules))
    joined = F.array_join(F.transform(listed, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"], x["e"])), ",")
    d = d.select(F.col("_id").alias(id_col), *(F.size(f"_{r.kind}").cast("long").alias(f"n_{r.kind}") for r in rules), joined.alias("spans"))
    return d.withColumn("base_sha256", F.sha2("spans", 256))


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """``docs`` with every span of every rule replaced by ``[kind]``; rules apply one after the other. Columns as they were."""
    d = flagged(packed(docs, _text=text_col), rules, "_text")
    for r in rules:
        t, rx = F.col("_text"), pattern(r)
        whole = F.regexp_extract_all(t, F.lit(rx), F.lit(0))
        counted = F.regexp_extract_all(t, F.lit(rx), F.lit(r.group)) if r.group else whole
        put = _masked(whole, counted, r)
        rebuilt = F.array_join(F.flatten(F.zip_with(F.split(t, rx, -1), put, lambda g, p: F.array(g, F.coalesce(p, F.lit(""))))), "")
        asked = F.array_contains(F.coalesce(F.col("_kinds"), F.array().cast("array<string>")), r.kind) if r.query() else F.lit(True)
        d = d.withColumn("_text", F.when(asked & t.rlike(rx), rebuilt).otherwise(t))
    return unpacked(d, docs.columns, **{text_col: "_text"})
