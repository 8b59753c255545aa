"""Benchmark decontamination: one Aho-Corasick automaton over the normalised test items.

Text is lower-cased (A-Z) and cut into words of letters, digits and non-ASCII characters.  The automaton's letters are
the numbers of the items' words; its keys are every run of ``window`` words of an item (some 0.4 kB each).  It is built
once, broadcast and loaded once by each worker; a document goes through it once.  Stretches in which it can't reach
the end of a key aren't fed to it: those where a word, or two words side by side, stand in no item.  Matches are
mapped back to word numbers and to character offsets of the original text.

Benchmarks of up to ``most_windows`` are one automaton and need no shuffle.  A larger one is beyond what is broadcast:
its items are dealt into automata of that size, scanned in turn, and the word runs are merged by document.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import repeat

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_rows, text_key

WINDOW = 10
MOST_WINDOWS = 1_000_000

_SEPARATORS = [*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]
#: Over UTF-8 bytes: A-Z to a-z, other separators to a space.
_FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else 0x20 if c in _SEPARATORS else c for c in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def windows(item: list[bytes], window: int = WINDOW) -> list[tuple[bytes, ...]]:
    """Every run of ``window`` words; a shorter item is one run; no words, no run."""
    if not item:
        return []
    return [tuple(item[i : i + window]) for i in range(max(1, len(item) - window + 1))]


class Windows:
    """The automaton, what leads to it, and the items of its keys."""

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        """items: (id, text).  Keys of one word need no automaton: they are their word."""
        self.number: dict[bytes, int] = {}  # of the items' words, from 1
        keys: dict[tuple[int, ...], set[str]] = {}
        for item_id, text in items:
            for w in windows(words(text), window):
                keys.setdefault(tuple(self.number.setdefault(x, len(self.number) + 1) for x in w), set()).add(item_id)
        self.items = [tuple(sorted(ids)) for ids in keys.values()]
        self.lengths = [len(k) for k in keys]
        self.single = np.full(len(self.number) + 1, -1, np.int64)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for n, key in enumerate(keys):
            if len(key) == 1:
                self.single[key[0]] = n
            else:
                self.automaton.add_word(key, n)
        self.least = min((n for n in self.lengths if n > 1), default=0)
        if self.least:
            self.automaton.make_automaton()
        neighbours = {a << 32 | b for key in keys for a, b in zip(key[:-1], key[1:], strict=True)}
        self.neighbours = np.array(sorted(neighbours), np.int64)

    def matches(self, codes: np.ndarray) -> list[tuple[int, int]]:
        """(end, key number) of every key in a sequence of word numbers; 0 is a word of no item."""
        alone = self.single[codes]
        at = np.flatnonzero(alone >= 0)
        found = list(zip((at + 1).tolist(), alone[at].tolist(), strict=True))
        if not self.least or len(codes) < self.least:
            return found
        pairs = codes[:-1].astype(np.int64) << 32 | codes[1:]
        place = np.minimum(np.searchsorted(self.neighbours, pairs), len(self.neighbours) - 1)
        known = np.r_[False, self.neighbours[place] == pairs, False]
        turn = np.flatnonzero(known[1:] != known[:-1])  # runs of known neighbours: words turn[0]..turn[1] and so on
        for a, b in zip(turn[::2].tolist(), turn[1::2].tolist(), strict=True):
            if b - a + 1 >= self.least:
                found += [(a + end + 1, n) for end, n in self.automaton.iter(tuple(codes[a : b + 1].tolist()))]
        return found


def scan(text: str | None, known: Windows) -> tuple[int, list[tuple[int, int]], set[str]]:
    """(number of words, runs of hit words as [first, end), items that occur)."""
    found = words(text)
    codes = np.fromiter(map(known.number.get, found, repeat(0)), np.int64, len(found))
    if not codes.any():
        return len(found), [], set()
    hits = known.matches(codes)
    return len(found), merged([(end - known.lengths[n], end) for end, n in hits]), {i for _, n in hits for i in known.items[n]}


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [tuple(r) for r in out]


def spans(text: str, runs: list[tuple[int, int]]) -> list[dict[str, int]]:
    """Word runs as code-point offsets of the original text."""
    at = [m.span() for m in _WORD.finditer(text)]
    return [{"start": at[a][0], "end": at[b - 1][1]} for a, b in runs]


_DDL = "doc_id {id}, k_text long, n_words long, runs array<struct<first:long,end:long>>, items array<string>, spans array<struct<start:long,end:long>>"


def _schema(id_type: pa.DataType) -> pa.Schema:
    pair = lambda a, b: pa.list_(pa.struct([(a, pa.int64()), (b, pa.int64())]))
    return pa.schema([("doc_id", id_type), ("k_text", pa.int64()), ("n_words", pa.int64()), ("runs", pair("first", "end")), ("items", pa.list_(pa.string())), ("spans", pair("start", "end"))])


def _gathered(items: DataFrame, window: int) -> Windows:
    return Windows([(r["item"], r["text"]) for r in items.collect()], window)


def _dealt(benchmark: DataFrame, item_col: str, text_col: str, window: int, most_windows: int) -> list[DataFrame]:
    """item, text of the benchmark; in parts, if it has more windows than one automaton should hold."""
    items = benchmark.select(F.coalesce(benchmark[item_col].cast("string"), F.lit("null")).alias("item"), benchmark[text_col].alias("text"))
    parts = max(1, -(-_n_windows(items, window) // most_windows))
    return [items.where(F.pmod(F.xxhash64("text"), F.lit(parts)) == n) for n in range(parts)] if parts > 1 else [items]


def _block(docs: DataFrame, items: DataFrame, window: int, id_type: str) -> DataFrame:
    known = docs.sparkSession.sparkContext.broadcast(_gathered(items, window))

    def one(ids: list, keys: list, texts: list) -> dict[str, list]:
        out = [scan(t, known.value) for t in texts]
        return {
            "doc_id": ids, "k_text": keys, "n_words": [n for n, _, _ in out],
            "runs": [[{"first": a, "end": b} for a, b in runs] for _, runs, _ in out],
            "items": [sorted(got) for _, _, got in out],
            "spans": [spans(t, runs) if runs else [] for t, (_, runs, _) in zip(texts, out, strict=True)],
        }

    return map_rows(docs, one, _DDL.format(id=id_type), _schema(pa.string() if id_type == "string" else pa.int64()))


def find_contamination(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, most_windows: int = MOST_WINDOWS) -> DataFrame:
    """A row for each document row: doc_id, k_text, n_words, runs, items, spans.

    runs: hit words as [first, end) word numbers.  spans: the same as code-point offsets.  items: ids (as
    strings) of the items with a window that occurs.  A null or wordless text has n_words 0 and no runs; null or
    wordless items never occur; an item without an id goes by the id "null"; items repeated under one id count
    once.  With no items nothing is hit.
    """
    id_type = "string" if dict(docs.dtypes)[id_col] == "string" else "long"
    texts = docs.select(docs[id_col].cast(id_type).alias("doc_id"), text_key(docs[text_col]).alias("k_text"), docs[text_col].alias("text"))
    found = [_block(texts, items, window, id_type) for items in _dealt(benchmark, item_col, item_text_col, window, most_windows)]
    if len(found) == 1:
        return found[0]
    every = found[0]
    for x in found[1:]:
        every = every.unionByName(x)
    # One row a block and document row; rows that are equal in id and text are equal in all else.
    every = every.dropDuplicates(["doc_id", "k_text", "runs", "items"]).groupBy("doc_id", "k_text").agg(F.first("n_words").alias("n_words"), F.flatten(F.collect_list("runs")).alias("runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.flatten(F.collect_list("spans")).alias("spans"))

    def join(ids: list, keys: list, n: list, runs: list, items: list, at: list) -> dict[str, list]:
        return {"doc_id": ids, "k_text": keys, "n_words": n, "items": items, "runs": [[{"first": a, "end": b} for a, b in merged([(r["first"], r["end"]) for r in x])] for x in runs], "spans": [_joined(x, y) for x, y in zip(runs, at, strict=True)]}

    every = map_rows(every, join, _DDL.format(id=id_type), _schema(pa.string() if id_type == "string" else pa.int64()))
    keys = texts.select(F.col("doc_id").alias("d"), F.col("k_text").alias("k"))
    return keys.join(every, keys["d"].eqNullSafe(every["doc_id"]) & (keys["k"] == every["k_text"])).select(every.columns)


def _joined(runs: list[dict], at: list[dict]) -> list[dict[str, int]]:
    """Spans of merged runs: the runs of all blocks beside their spans."""
    out: list[dict[str, int]] = []
    end = -1
    for r, s in sorted(zip(runs, at, strict=True), key=lambda x: x[0]["first"]):
        if out and r["first"] <= end:
            out[-1]["end"] = max(out[-1]["end"], s["end"])
        else:
            out.append(dict(s))
        end = max(end, r["end"])
    return out


def _n_windows(items: DataFrame, window: int) -> int:
    count = F.greatest(F.lit(1), F.size(F.split("text", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")) - window + 1)
    return items.where("text is not null").agg(F.sum(count)).first()[0] or 0


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, most_windows: int = MOST_WINDOWS) -> DataFrame:
    """The documents, all their columns, without those in which any test window occurs.

    A filter where the documents are: nothing is shuffled.
    """
    kept = docs
    for items in _dealt(benchmark, item_col, item_text_col, window, most_windows):
        known = docs.sparkSession.sparkContext.broadcast(_gathered(items, window))
        kept = kept.where(_clean(known)(docs[text_col]))
    return kept


def _clean(known: Broadcast) -> Callable[[Column], Column]:
    @F.pandas_udf("boolean")
    def clean(texts: pd.Series) -> pd.Series:
        return pd.Series([not scan(t, known.value)[1] for t in texts.tolist()], dtype=bool)

    return clean
