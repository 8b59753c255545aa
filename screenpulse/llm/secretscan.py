"""Secret scan with a trigram inverted index.

Each rule's regular expression is analysed once: the strings that any match must hold give a Boolean query of
trigrams (letters folded to lower case), as ORs of ANDs.  Documents are indexed by segment - one slice of rows, in
the scan itself: one pass over the folded bytes finds every place of a trigram that some query names, and makes the
postings, for each trigram the documents that hold it.  A rule's query intersects and unites postings, and only the
candidates are verified with the expression.  A rule from which no mandatory trigram follows scans its segment fully.

The index of a segment lives as long as the segment is scanned, so the scan shuffles and stores nothing;
``postings`` returns the same index as a table, for a corpus that is searched again.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, text_key

#: Most strings that the analysis holds for one place of an expression, most characters of a class, and times an item may
#: be repeated to be spelt out.
MAX_STRINGS, MAX_CLASS, MAX_TIMES = 64, 8, 8
#: Bytes of a segment that are looked at together.
CHUNK = 4 << 20


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    flags: int = 0
    #: Group whose length counts, and the least length; a shorter match is dropped.
    group: int = 0
    least: int = 0


BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I, 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 0, 20),
    Rule("hex", r"[0-9a-f]{24,}"),  # maximal runs of [0-9a-f], those under 24 dropped
)
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,32}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 0, 15),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("url_login", r"://[^\s:@/]{1,256}:[^\s:@/]{1,256}@"),
)
RULES = BASE + MORE

Query = list[frozenset[bytes]]


# --- from an expression to a query

class _Reader:
    """The syntax that rules use: literals, escapes, classes, groups, alternatives, repeats.

    Nodes: ("set", characters or None for many), ("seq", nodes), ("alt", nodes), ("rep", node, least, most or None).
    """

    def __init__(self, pattern: str):
        self.p, self.at = pattern, 0

    def more(self) -> str:
        return self.p[self.at : self.at + 1]

    def take(self) -> str:
        self.at += 1
        return self.p[self.at - 1]

    def alternatives(self) -> tuple:
        found = [self.sequence()]
        while self.more() == "|":
            self.take()
            found.append(self.sequence())
        return found[0] if len(found) == 1 else ("alt", found)

    def sequence(self) -> tuple:
        out = []
        while self.more() not in ("", "|", ")"):
            out.append(self.repeated(self.item()))
        return ("seq", out)

    def escape(self) -> frozenset[str] | None:
        c = self.take()
        if c == "x":
            self.at += 2
            return frozenset(chr(int(self.p[self.at - 2 : self.at], 16)))
        if c in "nrtfv":
            return frozenset({"n": "\n", "r": "\r", "t": "\t", "f": "\f", "v": "\v"}[c])
        if c.isalnum():
            raise ValueError(f"\\{c}")  # a kind of character or a place
        return frozenset(c)

    def item(self) -> tuple:
        c = self.take()
        if c == "(":
            if self.p.startswith("?:", self.at):
                self.at += 2
            elif self.more() == "?":
                raise ValueError("a group with an option")
            inner = self.alternatives()
            self.take()
            return inner
        if c == "[":
            return ("set", self.characters())
        if c == ".":
            return ("set", None)
        if c in "^$":
            return ("seq", [])
        if c == "\\":
            return ("set", self.escape())
        return ("set", frozenset(c))

    def characters(self) -> frozenset[str] | None:
        many = self.more() == "^"
        self.at += many
        out: set[str] = set()
        first = True
        while first or self.more() != "]":
            first, c = False, self.take()
            if c == "\\":
                if self.more() in "sSwWdD":
                    many, got = True, self.take()
                else:
                    (got,) = self.escape()
            else:
                got = c
            if self.more() == "-" and self.p[self.at + 1 : self.at + 2] not in ("]", ""):
                self.take()
                high = self.take()
                out.update(map(chr, range(ord(got), ord(high) + 1)))
            else:
                out.add(got)
        self.take()
        folded = {c.lower() for c in out}
        return None if many or len(folded) > MAX_CLASS or any(ord(c) > 127 for c in out) else frozenset(folded)

    def repeated(self, node: tuple) -> tuple:
        c, bounds = self.more(), None
        if c in ("?", "*", "+"):
            self.take()
            bounds = {"?": (0, 1), "*": (0, None), "+": (1, None)}[c]
        elif c == "{" and (m := re.compile(r"\{([0-9]*)(,?)([0-9]*)\}").match(self.p, self.at)):
            self.at = m.end()
            least = int(m[1] or 0)
            bounds = (least, int(m[3]) if m[3] else None if m[2] else least)
        if bounds is None:
            return node
        if self.more() in ("?", "+"):  # lazy or possessive: the same strings
            self.take()
        return ("rep", node, *bounds)


def _spelt(node: tuple) -> set[str] | None:
    """All strings of a node, in lower case, if they are few."""
    if node[0] == "set":
        return None if node[1] is None or any(ord(c) > 127 for c in node[1]) else {c.lower() for c in node[1]}
    if node[0] == "alt":
        found = [_spelt(n) for n in node[1]]
        return None if None in found else set().union(*found)
    if node[0] == "seq":
        out = {""}
        for n in node[1]:
            some = _spelt(n)
            if some is None or len(out) * len(some) > MAX_STRINGS:
                return None
            out = {a + b for a, b in product(out, some)}
        return out
    _, inner, least, most = node
    some = _spelt(inner)
    if some is None or most is None or most > MAX_TIMES or len(some) ** most > MAX_STRINGS:
        return None
    return {"".join(x) for n in range(least, most + 1) for x in product(some, repeat=n)}


def trigram_query(pattern: str, flags: int = 0) -> Query | None:
    """An OR of ANDs of trigrams that every match holds; None if none is mandatory."""
    mandatory: list[Query] = []

    def flush(strings: set[str]) -> None:
        """A match holds one of these strings."""
        grams = [frozenset(s[i : i + 3].encode() for i in range(len(s) - 2)) for s in strings]
        if strings and all(grams):
            mandatory.append(_least(grams))

    def walk(node: tuple) -> None:
        held = {""}
        for n in node[1] if node[0] == "seq" else [node]:
            some = _spelt(n)
            if some is not None and len(held) * len(some) <= MAX_STRINGS:
                held = {a + b for a, b in product(held, some)}
                continue
            flush(held)
            held = some or {""}
            if some is None and n[0] == "seq":
                walk(n)
            elif some is None and n[0] == "rep" and n[2] >= 1:
                walk(n[1])
        flush(held)

    try:
        walk(_Reader(pattern).alternatives())
    except ValueError:
        return None  # syntax that isn't analysed: the rule scans fully
    if not mandatory:
        return None
    out = mandatory[0]
    for q in mandatory[1:]:
        if len(out) * len(q) <= MAX_STRINGS:
            out = _least([a | b for a, b in product(out, q)])
    return out


def _least(grams: list[frozenset[bytes]]) -> Query:
    """Without what another alternative implies."""
    return sorted({g for g in grams if not any(h < g for h in grams)}, key=sorted)


# --- postings of a segment

class Index:
    """Trigrams that queries name, and how to find them: a table over all trigrams of bytes."""

    def __init__(self, queries: list[Query | None]):
        self.grams = sorted({g for q in queries if q for grams in q for g in grams})
        self.number = {g: i for i, g in enumerate(self.grams)}
        self.table = np.full(1 << 24, -1, np.int16)
        for g, i in self.number.items():
            self.table[int.from_bytes(g, "big")] = i

    def postings(self, texts: list[str]) -> list[np.ndarray]:
        """For each trigram the numbers of the texts that hold it, ascending; one pass over the texts."""
        pairs, held, size, n = [], [], 0, max(1, len(texts))
        for i, text in enumerate(texts):
            held.append((i, text.encode("utf-8", "surrogatepass").lower()))
            size += len(held[-1][1])
            if size >= CHUNK or i == len(texts) - 1:
                pairs.append(self._found(held, n))
                held, size = [], 0
        every = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
        return [x % n for x in np.split(every, np.searchsorted(every, np.arange(1, len(self.grams)) * n))] if self.grams else []

    def _found(self, held: list[tuple[int, bytes]], n: int) -> np.ndarray:
        """trigram * texts + text of what stands in some texts; a NUL parts them."""
        raw = np.frombuffer(b"\0".join(b for _, b in held), np.uint8)
        if len(raw) < 3 or not self.grams:
            return np.zeros(0, np.int64)
        code = raw[:-2].astype(np.int32)
        code <<= 8
        code |= raw[1:-1]
        code <<= 8
        code |= raw[2:]
        gram = self.table[code]
        at = np.flatnonzero(gram >= 0)
        ends = np.cumsum([len(b) + 1 for _, b in held])
        text = np.array([i for i, _ in held])[np.searchsorted(ends, at, side="right")]
        return np.unique(gram[at].astype(np.int64) * n + text)

    def candidates(self, query: Query | None, postings: list[np.ndarray], n: int) -> np.ndarray:
        """Numbers of the texts that may match: the union of the intersections."""
        if query is None:
            return np.arange(n)
        found = [np.zeros(0, np.int64)]
        for grams in query:
            lists = sorted((postings[self.number[g]] for g in grams), key=len)
            both = lists[0]
            for other in lists[1:]:
                if not len(both):
                    break
                both = np.intersect1d(both, other, assume_unique=True)
            found.append(both)
        return np.unique(np.concatenate(found))


class Compiled:
    """Rules with their expressions, queries and index."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        # ASCII: "either case" means A-Z and a-z, not letters that fold to them.
        self.expressions = [re.compile(r.pattern, r.flags | re.A if r.flags & re.I else r.flags) for r in rules]
        self.queries = [trigram_query(r.pattern, r.flags) for r in rules]
        self.index = Index(self.queries)


def verify(rule: Rule, expression: re.Pattern, text: str) -> list[tuple[int, int]]:
    """Leftmost matches, one after another; those too short are dropped, not tried again."""
    return [m.span() for m in expression.finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least]


def find_in(texts: list[str], c: Compiled) -> list[list[tuple[int, int, int]]]:
    """(start, rule number, end) of each text, in order."""
    postings, out = c.index.postings(texts), [[] for _ in texts]
    for k, (rule, expression, query) in enumerate(zip(c.rules, c.expressions, c.queries, strict=True)):
        for i in c.index.candidates(query, postings, len(texts)).tolist():
            out[i] += [(a, k, b) for a, b in verify(rule, expression, texts[i])]
    return [sorted(x) for x in out]


def find_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """A row for each document row: doc_id, spans (array of kind, start, end in code points, by start, then rule).

    Matches of one kind don't overlap; those of different kinds may.  A null text has none.
    """
    id_type = "string" if dict(docs.dtypes)[id_col] == "string" else "long"
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    schema = pa.schema([("doc_id", pa.string() if id_type == "string" else pa.int64()), ("spans", pa.list_(span))])

    def one(ids: list, texts: list) -> dict[str, list]:
        found = find_in([t or "" for t in texts], _cached(rules))
        return {"doc_id": ids, "spans": [[{"kind": rules[k].kind, "start": a, "end": b} for a, k, b in x] for x in found]}

    return map_rows(docs.select(docs[id_col].cast(id_type), docs[text_col]), one, f"doc_id {id_type}, spans array<struct<kind:string,start:long,end:long>>", schema)


_COMPILED: dict[tuple[Rule, ...], Compiled] = {}


def _cached(rules: tuple[Rule, ...]) -> Compiled:
    if rules not in _COMPILED:
        _COMPILED[rules] = Compiled(rules)
    return _COMPILED[rules]


def postings(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """trigram, doc_id, k_text: the index as a table, for the trigrams that the rules' queries name."""
    id_type = "string" if dict(docs.dtypes)[id_col] == "string" else "long"
    schema = pa.schema([("trigram", pa.string()), ("doc_id", pa.string() if id_type == "string" else pa.int64()), ("k_text", pa.int64())])

    def one(ids: list, keys: list, texts: list) -> dict[str, list]:
        index = _cached(rules).index
        hits = [(g.decode(), ids[i], keys[i]) for g, some in zip(index.grams, index.postings([t or "" for t in texts]), strict=True) for i in some.tolist()]
        return {c: [h[j] for h in hits] for j, c in enumerate(("trigram", "doc_id", "k_text"))}

    return map_rows(docs.select(docs[id_col].cast(id_type), text_key(docs[text_col]), docs[text_col]), one, f"trigram string, doc_id {id_type}, k_text long", schema)


def digest(found: DataFrame, base: tuple[Rule, ...] = BASE) -> DataFrame:
    """n_<kind> of the base kinds, base_sha256 and spans as kind:start:end lists."""
    joined = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    kinds = [r.kind for r in base]
    of = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    counts = [of(k).alias(f"n_{k}") for k in kinds]
    return found.select("doc_id", *counts, F.sha2(joined(F.filter("spans", lambda s: s["kind"].isin(kinds))), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
