"""BPE encoding and decoding by tree concatenation of unsplit text.

Words between ASCII white space are independent in this vocabulary, and the
vocabulary's rule splits a word into pieces; a piece is unsplit text, to which
the merges apply. A piece of more than ``LEAF`` symbols is halved down to
leaves, the leaves are encoded, and the halves are joined up the tree. A join
re-encodes a window around the seam and doubles it until its first token equals
the left side's token there and its last the right side's. Two neighbouring
tokens of a byte-pair encoding are right if and only if they are the encoding
of their own concatenation, so then every neighbouring pair of the result is
right, and with that the whole.

Only the last leaf of a piece may use the end-of-word symbol; the others, and
windows that do not reach the end, use the same merges without it.

Where the leaves are encoded depends on their number alone: a worker encodes
those of an ordinary text itself, each distinct piece once; a text that holds a
word of more than ``LONG`` bytes has its leaves (then of ``FAR_LEAF`` symbols)
dealt over parallel tasks, and one task joins what comes back.

In text of the first Latin blocks the pieces are found by plain classes of
characters; elsewhere by the vocabulary's own normaliser and splitter.

Decoding joins the tokens' strings by a space, as the library does for a
vocabulary without a decoder.

Defined cases: null and empty texts have no tokens and decode to the empty
string; repeated rows give equal results each; extra columns are ignored here
and kept by :func:`with_tokens` and :func:`with_ids`.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ROW, packed, partitions, tidied, tokenizer_path
from .token_counts import byte_symbols

VOCABULARY = "word_bpe_49k.json"
#: Symbols of a leaf; bytes of a word whose leaves are dealt over tasks, and symbols of such a leaf.
LEAF = 16
LONG, FAR_LEAF = 32_768, 8_192
#: Bytes of words and tokens that a worker remembers, twice over, what each word takes beside its own, and the longest word remembered.
REMEMBER, EACH, MOST = 16 << 20, 300, 1024
#: Rows and bytes of text of a batch that a worker lets out.
ROWS, BYTES = 256, 1 << 20
#: Text whose case, composition or letters are left to the library: beyond the first
#: Latin blocks, the one letter there that folds to two characters, special strings.
FAR = re.compile("[^\\x00-\\u017f]|\\u0130|<\\|")
_LETTERS = "".join(re.escape(chr(c)) for c in range(0x180) if chr(c).isalpha())
_NUMBERS = "".join(chr(c) for c in range(0x180) if unicodedata.category(chr(c))[0] == "N")
_SPACE = " \\t-\\r\\x85\\xa0"
#: The vocabulary's rule for splitting folded text (a fixed, public pattern), with its classes spelled out.
PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{_SPACE}{_LETTERS}{_NUMBERS}]+")
OUT = "n_tokens long, ids_sha256 string, decoded_sha256 string"
#: Raw text of a leaf that holds no long word.
PACK = 65_536


class Codec:
    """The vocabulary file, and the words encoded so far."""

    def __init__(self, name: str, leaf: int = LEAF):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        path = tokenizer_path(name)
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.suffix = spec["model"].get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        spec["model"]["end_of_word_suffix"] = None
        self.inner = Tokenizer.from_str(json.dumps(spec))
        self.symbol = {b: c for c, b in byte_symbols().items()}
        self.leaf = leaf
        self.known: dict[bytes | str, tuple[bytes, bytes]] = {}
        self.older: dict[bytes | str, tuple[bytes, bytes]] = {}
        self.size = 0

    def learn(self, words: set) -> dict:
        """Encode words (bytes) and pieces of folded Latin text (str)."""
        out = {}
        # words of no more bytes than a leaf's symbols have no piece to halve: the library takes them at once
        short = [w for w in words if isinstance(w, bytes) and len(w) <= self.leaf and w not in self.older]
        at_once = {w: e.ids for w, e in zip(short, self.tok.encode_batch([w.decode() for w in short], add_special_tokens=False), strict=True)} if short else {}
        tokenize, size = self.tok.model.tokenize, 0
        for w in words:
            got = self.older.get(w)
            if got is None:
                if isinstance(w, str):
                    p = w.encode().decode("latin-1").translate(self.symbol)
                    if len(p) <= self.leaf:
                        t = tokenize(p)
                        got = np.array([x.id for x in t], "<u4").tobytes(), " ".join([x.value for x in t]).encode()
                    else:
                        got = self.named([t for t, _ in self.tree(p)])
                elif w in at_once:
                    got = self.named(at_once[w])
                else:
                    got = self.named([t for p in self.pieces(w.decode()) for t in ((p,) if isinstance(p, int) else [t for t, _ in self.tree(p)])])
            out[w] = got
            if len(w) <= MOST:
                size += len(w) + len(got[0]) + len(got[1]) + EACH
        self.known.update(out if max(map(len, words)) <= MOST else {w: g for w, g in out.items() if len(w) <= MOST})
        self.size += size
        if self.size > REMEMBER:  # what is met again stays
            self.older.clear()
            self.older.update(self.known)
            self.known.clear()
            self.size = 0
        return out

    def texts(self, texts: list[str | None]) -> Iterator[tuple[bytes, bytes]]:
        """ids (little-endian) and decoded text of each."""
        for t in texts:
            t = t or ""
            parts = t.encode().split() if FAR.search(t) else PIECES.findall(t.lower())
            found = list(map(self.known.get, parts))
            if None in found:
                new = self.learn({w for w, g in zip(parts, found, strict=True) if g is None})
                found = [g if g is not None else new[w] for w, g in zip(parts, found, strict=True)]
            yield b"".join([g[0] for g in found]), b" ".join([g[1] for g in found if g[1]])

    def symbols(self, piece: str, is_end: bool) -> list[tuple[int, int]]:
        """(id, number of symbols) of a run of byte symbols."""
        out = []
        for t in (self.tok if is_end else self.inner).model.tokenize(piece):
            out.append((t.id, len(t.value)))
        if out and is_end:
            out[-1] = (out[-1][0], out[-1][1] - len(self.suffix))
        return out

    def pieces(self, word: str) -> Iterator[int | str]:
        """A long word's special ids and byte-symbol pieces, in order."""
        at = 0
        while at < len(word):
            i, name = min(((i, s) for s in self.special if (i := word.find(s, at)) >= 0), default=(len(word), ""))
            if i > at:
                for piece, _ in self.tok.pre_tokenizer.pre_tokenize_str(self.tok.normalizer.normalize_str(word[at:i])):
                    yield piece
            if name:
                yield self.special[name]
            at = i + len(name)

    def named(self, ids: list[int]) -> tuple[bytes, bytes]:
        """Token ids as bytes (little-endian, 32 bits), and decoded."""
        return np.array(ids, "<u4").tobytes(), self.decode(ids)

    def tree(self, piece: str) -> list[tuple[int, int]]:
        """Tokens of a piece: its leaves, joined."""
        if len(piece) <= self.leaf:
            return self.symbols(piece, True)
        at, leaves = 0, []
        for end in halves(len(piece), self.leaf):
            leaves.append(self.symbols(piece[at:end], end == len(piece)))
            at = end
        return concatenate(piece, leaves, self.symbols)

    def decode(self, ids: Iterable[int]) -> bytes:
        """All tokens of ``ids``, special ones too, joined by a space."""
        name = self.tok.id_to_token
        return " ".join([name(int(i)) for i in ids]).encode()


_codecs: dict[tuple[str, int], Codec] = {}


def codec(name: str, leaf: int = LEAF) -> Codec:
    if (name, leaf) not in _codecs:
        _codecs[name, leaf] = Codec(name, leaf)
    return _codecs[name, leaf]


Tokens = list[tuple[int, int]]


def join_halves(piece: str, left: Tokens, right: Tokens, start: int, middle: int, end: int, encode: Callable[[str, bool], Tokens], is_last: bool, window: int = 4) -> Tokens:
    """Encoding of ``piece[start:end]`` from those of its two parts, which meet at ``middle``."""
    while True:
        a, b = max(0, len(left) - window), min(len(right), window)
        lo = middle - sum(n for _, n in left[a:])
        hi = middle + sum(n for _, n in right[:b])
        again = encode(piece[lo:hi], is_last and hi == end)
        if (a == 0 or again[0] == left[a]) and (b == len(right) or again[-1] == right[b - 1]):
            return left[:a] + again + right[b:]
        window *= 2


def concatenate(piece: str, leaves: list[Tokens], encode: Callable[[str, bool], Tokens]) -> Tokens:
    """Join the leaves of a piece, neighbours first, up the tree."""
    level, at = [], 0
    for tokens in leaves:
        size = sum(n for _, n in tokens)
        level.append((at, at + size, tokens))
        at += size
    while len(level) > 1:
        up = []
        for i in range(0, len(level) - 1, 2):
            (s, m, left), (_, e, right) = level[i], level[i + 1]
            up.append((s, e, join_halves(piece, left, right, s, m, e, encode, e == at)))
        level = up + level[len(up) * 2 :]
    return level[0][2] if level else []


def halves(n: int, leaf: int) -> list[int]:
    """Ends of the leaves when n symbols are halved until none is longer than ``leaf``."""
    parts = 1
    while -(-n // parts) > leaf:
        parts *= 2
    return [n * (i + 1) // parts for i in range(parts)]


def is_long(text: Column, long: int = LONG) -> Column:
    """Whether a text holds a run of over ``long`` bytes without ASCII white space."""
    words = F.split(text, "[ \\t-\\r]+")
    return F.when(F.octet_length(text) > long, F.exists(words, lambda w: F.octet_length(w) > long)).otherwise(F.lit(False))


#: What is added to a row, by name.
ADDED = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string", "ids": "binary", "decoded": "string"}


def encoded_short(rows: DataFrame, name: str, leaf: int, wanted: tuple[str, ...]) -> DataFrame:
    """``rows`` (their text in ``_t``) without the text, with the columns of ``ADDED`` that are wanted, in small batches."""
    kept = [c for c in rows.columns if c != "_t"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(name, leaf)
        make = {
            "n_tokens": lambda i, d: len(i) // 4, "ids_sha256": lambda i, d: hashlib.sha256(i).hexdigest(), "decoded_sha256": lambda i, d: hashlib.sha256(d).hexdigest(),
            "ids": lambda i, d: i, "decoded": lambda i, d: d.decode(),
        }
        types = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
        for batch in batches:
            at = lo = size = 0
            out: list[list] = [[] for _ in wanted]
            texts = batch.column(len(kept))
            for at in range(batch.num_rows):
                text = texts[at].as_py()
                for ids, decoded in c.texts([text]):
                    for o, w in zip(out, wanted, strict=True):
                        o.append(make[w](ids, decoded))
                size += len(text or "")
                if at + 1 - lo >= ROWS or size >= BYTES or at + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([batch.column(i).slice(lo, at + 1 - lo) for i in range(len(kept))] + [pa.array(o, types[ADDED[w]]) for o, w in zip(out, wanted, strict=True)], names=[*kept, *wanted])
                    lo, size, out = at + 1, 0, [[] for _ in wanted]

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(name, leaf)
        c.size = 0
        return tidied(run, c.known, c.older)(batches)

    schema = T.StructType([rows.schema[c] for c in kept] + [T.StructField(w, T._parse_datatype_string(ADDED[w])) for w in wanted])
    return rows.select(*kept, "_t").mapInArrow(tidy, schema)


def encode_long(texts: DataFrame, name: str, long: int, leaf: int) -> DataFrame:
    """key, ids and decoded of ``texts`` (key, text): leaves in parallel, then the tree of each text."""
    spark = texts.sparkSession

    def leaves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(name)
        for pdf in batches:
            for key, text in zip(pdf["key"], pdf["text"], strict=True):
                rows: list[tuple] = []

                def put(kind: int, body: str, rows: list[tuple] = rows, key: bytes = key) -> None:
                    rows.append((key, len(rows), kind, body))

                words, size = [], 0
                for w in text.encode().split():
                    if len(w) <= long:
                        words.append(w.decode())
                        size += len(w) + 1
                        if size >= PACK:
                            put(0, " ".join(words))
                            words, size = [], 0
                        continue
                    if words:
                        put(0, " ".join(words))
                        words, size = [], 0
                    for p in c.pieces(w.decode()):
                        if isinstance(p, int):
                            put(1, str(p))
                            continue
                        at = 0
                        ends = halves(len(p), leaf)
                        for end in ends:
                            put(3 if end == ends[-1] else 2, p[at:end])
                            at = end
                if words:
                    put(0, " ".join(words))
                for lo in range(0, len(rows), 64):
                    yield pd.DataFrame(rows[lo : lo + 64], columns=["key", "at", "kind", "body"])

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(name)
        for pdf in batches:
            out = []
            for kind, body in zip(pdf["kind"], pdf["body"], strict=True):
                if kind == 0:
                    out.append(next(c.texts([body]))[0])
                elif kind == 1:
                    out.append(np.array([int(body)], "<u4").tobytes())
                else:
                    out.append(np.array(c.symbols(body, kind == 3), "<u4").reshape(-1, 2).tobytes())
            pdf["tokens"] = out
            yield pdf

    def tree(pdf: pd.DataFrame) -> pd.DataFrame:
        c = codec(name)
        ids: list[bytes] = []
        piece, parts = [], []
        for r in pdf.sort_values("at").itertuples():
            if r.kind < 2:
                ids.append(r.tokens)
                continue
            piece.append(r.body)
            parts.append([tuple(x) for x in np.frombuffer(r.tokens, "<u4").reshape(-1, 2).tolist()])
            if r.kind == 3:
                whole = concatenate("".join(piece), parts, c.symbols)
                ids.append(np.array([t for t, _ in whole], "<u4").tobytes())
                piece, parts = [], []
        all_ids = b"".join(ids)
        return pd.DataFrame({"key": [pdf["key"].iloc[0]], "ids": [all_ids], "decoded": [c.decode(np.frombuffer(all_ids, "<u4").tolist()).decode()]})

    cut_up = texts.mapInPandas(leaves, "key binary, at int, kind int, body string")
    done = cut_up.repartition(partitions(spark), "key", "at").mapInPandas(encode, "key binary, at int, kind int, body string, tokens binary")
    return done.groupBy("key").applyInPandas(tree, "key binary, ids binary, decoded string")


def _long_rows(docs: DataFrame, text_col: str, name: str, long: int, leaf: int) -> tuple[DataFrame, DataFrame]:
    """The rows with long words and the encodings of their distinct texts, by digest."""
    rows = docs.where(is_long(F.col(text_col), long)).withColumn("_key", F.sha2(F.col(text_col), 256).cast("binary"))
    texts = rows.select(F.col("_key").alias("key"), F.col(text_col).alias("text")).dropDuplicates(["key"])
    return rows, encode_long(texts, name, long, leaf)


def _added(rows: DataFrame, name: str, long: int, leaf: int, far_leaf: int, wanted: tuple[str, ...]) -> DataFrame:
    """``rows`` (their text in ``_t``) without the text, with the columns of ``ADDED`` that are wanted."""
    kept = [c for c in rows.columns if c != "_t"]
    rows = rows.withColumn("_t", F.coalesce("_t", F.lit("")))
    short = encoded_short(rows.where(~is_long(F.col("_t"), long)), name, leaf, wanted)
    far, texts = _long_rows(rows, "_t", name, long, far_leaf)
    made = {"n_tokens": (F.octet_length("ids") / 4).cast("long"), "ids_sha256": F.sha2("ids", 256), "decoded_sha256": F.sha2("decoded", 256), "ids": F.col("ids"), "decoded": F.col("decoded")}
    texts = texts.select(F.col("key").alias("_key"), *(made[w].alias(f"_{w}") for w in wanted))
    return short.unionByName(far.join(texts, "_key").select(*kept, *(F.col(f"_{w}").alias(w) for w in wanted)))


def encode(docs: DataFrame, name: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text", long: int = LONG, leaf: int = LEAF, far_leaf: int = FAR_LEAF) -> DataFrame:
    """id, n_tokens, ids_sha256 and decoded_sha256 of every whole text."""
    d = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"))
    return _added(d, name, long, leaf, far_leaf, ("n_tokens", "ids_sha256", "decoded_sha256")).withColumnRenamed("_id", id_col)


def _with(docs: DataFrame, name: str, text_col: str, long: int, leaf: int, far_leaf: int, wanted: tuple[str, ...]) -> DataFrame:
    done = _added(packed(docs, _t=text_col), name, long, leaf, far_leaf, wanted)
    return done.select(*(F.col(f"{ROW}.`{c}`") for c in docs.columns if c != "_tokens"), F.struct(*wanted).alias("_tokens"))


def with_tokens(docs: DataFrame, name: str = VOCABULARY, text_col: str = "text", long: int = LONG, leaf: int = LEAF, far_leaf: int = FAR_LEAF) -> DataFrame:
    """``docs`` with a struct column ``_tokens`` (in place of one of that name): n_tokens, ids (little-endian unsigned 32-bit) and decoded."""
    return _with(docs, name, text_col, long, leaf, far_leaf, ("n_tokens", "ids", "decoded"))


def with_ids(docs: DataFrame, name: str = VOCABULARY, text_col: str = "text", long: int = LONG, leaf: int = LEAF, far_leaf: int = FAR_LEAF) -> DataFrame:
    """As :func:`with_tokens`, with the digest of the decoded text in its place, which then never leaves a worker."""
    return _with(docs, name, text_col, long, leaf, far_leaf, ("n_tokens", "ids", "decoded_sha256"))


def encode_text(text: str | None, name: str = VOCABULARY, leaf: int = LEAF) -> list[int]:
    """One text on one machine, by the same steps."""
    c = codec(name, leaf)
    out: list[int] = []
    for w in (text or "").encode().split():
        for p in c.pieces(w.decode()):
            out += (p,) if isinstance(p, int) else [t for t, _ in c.tree(p)]
    return out
