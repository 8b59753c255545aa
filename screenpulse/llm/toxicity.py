"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

1. A bounded sample of labelled documents (``per_class`` of each label, least hash first) are the examples.  All their
   terms are the vocabulary; none is dropped.
2. One scan over all whole texts writes each document's term counts, and counts in arrays of its task in how many
   documents each term stands.
3. A term weighs tf * idf * relevance.  Relevance is how well the term tells the examples' labels apart, the root of
   its G (likelihood ratio against independence) times its log-odds, and never under ``FLOOR``, so any shared term makes
   neighbours.  Equal vectors count once, so that copies are not taken for independent evidence.
4. Each document is a query.  The commonest terms' lists and the heaviest others are scored first; what the rest could
   add to an example is bounded by the largest weights of the example's block; only examples whose bound reaches the
   k-th best are scored, exactly.
5. The k nearest vote: cosine squared times the share of its label that an example stands for, steadied by a prior.
6. A vote becomes a probability by a logistic curve through its log-odds, fitted on votes that each half of the examples
   got from an index of the other half.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_rows, saved, slices

PER_CLASS = 4000
NEIGHBOURS = 25
BLOCK = 64
THRESHOLD = 0.7
#: Weight of the prior against votes; least relevance of a term; ridge of the calibration's slope.
PRIOR_WEIGHT, FLOOR, RIDGE = 0.1, 0.01, 1.0
#: How the index works, not what it finds: commonest terms with dense lists, queries in a batch, postings of a query that
#: are read before bounds are looked at, what single precision may hide, answers that a task remembers.
DENSE, BATCH, FIRST_POSTINGS, ROUNDING, REMEMBERED = 512, 128, 16_384, 1e-4, 20_000

_TERM = re.compile(r"[^\W\d_]+")


def terms_of(text: str | None) -> list[str]:
    return _TERM.findall((text or "").lower())


def held_out(id_col: Column) -> Column:
    """Rows that no label may be learnt from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def _spans(first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The numbers from each first up to its end, one span after the other."""
    n = end - first
    return np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())


@dataclass
class Vectors:
    """Sparse rows: those of row i are at start[i]:start[i+1], by term."""

    start: np.ndarray
    term: np.ndarray
    value: np.ndarray

    def __len__(self) -> int:
        return len(self.start) - 1

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self), dtype=np.int32), np.diff(self.start))

    def some(self, which: np.ndarray) -> Vectors:
        at = _spans(self.start[which], self.start[which + 1])
        return Vectors(np.r_[0, np.cumsum(np.diff(self.start)[which])], self.term[at], self.value[at])

    def sums(self, x: np.ndarray) -> np.ndarray:
        """Of each row, the sum of x; exact for whole numbers, in term order for others."""
        return np.array([math.fsum(x[a:b]) for a, b in zip(self.start[:-1].tolist(), self.start[1:].tolist(), strict=True)])

    def weighted(self, weight: np.ndarray) -> Vectors:
        """value is counts: (1 + ln) times the terms' weights, each row of length 1."""
        w = (1 + np.log(self.value)) * weight[self.term]
        norm = np.sqrt(self.sums(w * w))
        return Vectors(self.start, self.term, w / np.repeat(np.where(norm > 0, norm, 1), np.diff(self.start)))


class BlockMaxIndex:
    """Exact top-k cosine over sparse unit vectors.  Ties go to the smaller example number.

    The lists of the commonest terms are dense and are multiplied for a batch of queries at once, in single precision;
    they and the bounds only choose candidates, with room for rounding.  A candidate's cosine is summed over its own terms.
    """

    def __init__(self, vectors: Vectors, n_terms: int, block: int = BLOCK, dense: int = DENSE):
        self.n, self.vectors, self.block = len(vectors), vectors, block
        size = np.bincount(vectors.term, minlength=n_terms)
        common = np.argsort(-size, kind="stable")[:dense]
        self.place = np.full(n_terms, -1, np.int32)  # of a common term among the dense lists
        self.place[common] = np.arange(len(common))
        mine = self.place[vectors.term] >= 0
        rows = vectors.rows()
        self.dense = np.zeros((len(common), self.n), np.float32)
        self.dense[self.place[vectors.term[mine]], rows[mine]] = vectors.value[mine]
        term, self.example, self.weight = vectors.term[~mine], rows[~mine], vectors.value[~mine]
        order = np.argsort(term, kind="stable")
        term, self.example, self.weight = term[order], self.example[order], self.weight[order]
        self.lists = np.searchsorted(term, np.arange(n_terms + 1))
        at = self.example // block
        # An entry for each term and block that meet: the largest weight there.
        first = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (at[1:] != at[:-1])]) if len(term) else np.zeros(0, np.int64)
        self.entry_block = at[first]
        self.entry_top = np.maximum.reduceat(self.weight, first) if len(term) else np.zeros(0)
        self.entries = np.searchsorted(term[first], np.arange(n_terms + 1))
        self.top = np.zeros(n_terms)
        np.maximum.at(self.top, term, self.weight)
        self.n_blocks = -(-self.n // block)
        self._query = np.zeros(n_terms)

    def _sums(self, terms: np.ndarray, w: np.ndarray) -> np.ndarray:
        a, b = self.lists[terms], self.lists[terms + 1]
        posting = _spans(a, b)
        return np.bincount(self.example[posting], np.repeat(w, b - a) * self.weight[posting], minlength=self.n)

    def _exact(self, which: np.ndarray, terms: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Cosines of some examples, each summed over its terms in order, whatever led to it."""
        self._query[terms] = w
        some = self.vectors.some(which)
        products = self._query[some.term] * some.value
        self._query[terms] = 0
        return np.add.reduceat(products, some.start[:-1]) if len(which) else np.zeros(0)

    def search_all(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """For each query (terms, weights; of length 1): examples and cosines best first, and how many were scored.

        Only examples that share a term are near.
        """
        for at in range(0, len(queries), BATCH):
            batch = queries[at : at + BATCH]
            q = np.zeros((len(batch), len(self.dense)), np.float32)
            for i, (terms, w) in enumerate(batch):
                mine = self.place[terms] >= 0
                q[i, self.place[terms[mine]]] = w[mine]
            for (terms, w), low in zip(batch, q @ self.dense, strict=True):
                yield self._search(terms, w, low, k)

    def _bar(self, low: np.ndarray, k: int) -> float:
        return float(np.partition(low, self.n - k)[self.n - k]) if k < self.n else 0.0

    def _search(self, terms: np.ndarray, w: np.ndarray, low: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """low: what the dense lists have given each example."""
        size = self.lists[terms + 1] - self.lists[terms]
        lists, by = terms[size > 0], w[size > 0]
        order = np.argsort(-by * self.top[lists], kind="stable")
        m = int(np.searchsorted(np.cumsum(size[size > 0][order]), FIRST_POSTINGS, side="right"))
        lead, rest = order[:m], order[m:]
        low = low + self._sums(lists[lead], by[lead]) if m else low
        high = low
        if len(rest):
            entry = _spans(self.entries[lists[rest]], self.entries[lists[rest] + 1])
            gain = np.repeat(by[rest], self.entries[lists[rest] + 1] - self.entries[lists[rest]]) * self.entry_top[entry]
            high = low + np.repeat(np.bincount(self.entry_block[entry], gain, minlength=self.n_blocks), self.block)[: self.n]
        which = np.flatnonzero(high >= self._bar(low, k) - ROUNDING)
        if len(rest) and len(which) > 4 * k:  # the bounds tell little apart: read the other postings too
            low = low + self._sums(lists[rest], by[rest])
            which = np.flatnonzero(low >= self._bar(low, k) - ROUNDING)
        score = self._exact(which, terms, w)
        which, score = which[score > 0], score[score > 0]
        best = np.lexsort((which, -score))[:k]
        return which[best], score[best], len(which)


def relevance(found: Vectors, toxic: np.ndarray, n_terms: int) -> np.ndarray:
    """Of each term, how well it tells the distinct vectors of one label from those of the other."""
    n1, n = int(toxic.sum()), len(toxic)
    n0 = n - n1
    if not n0 or not n1:
        return np.ones(n_terms)
    every = np.bincount(found.term, minlength=n_terms).astype(float)
    a = np.bincount(found.term, toxic[found.rows()].astype(float), minlength=n_terms)
    c = every - a
    b, d = n1 - a, n0 - c

    def part(seen: np.ndarray, row: np.ndarray, column: int) -> np.ndarray:
        return np.where(seen > 0, seen * np.log(np.maximum(seen, 1) * n / np.maximum(row * column, 1)), 0.0)

    g = 2 * (part(a, every, n1) + part(c, every, n0) + part(b, n - every, n1) + part(d, n - every, n0))
    odds = np.log((a + 0.5) / (b + 0.5)) - np.log((c + 0.5) / (d + 0.5))
    return np.maximum(FLOOR, np.sqrt(np.maximum(g, 0)) * np.abs(odds))


class Voters:
    """Distinct example vectors with what each votes for, and their index."""

    def __init__(self, found: Vectors, votes: np.ndarray, idf: np.ndarray, k: int):
        """votes: a row for each distinct vector, what label 1 and all labels weigh in it."""
        self.k = k
        total = votes.sum(axis=0)
        self.rate = float(total[0] / total[1]) if total[1] else 0.0
        empty = np.diff(found.start) == 0
        none = votes[empty].sum(axis=0)
        self.prior = float((none[0] + self.rate) / (none[1] + 1))
        self.which = np.flatnonzero(~empty)  # numbers of the distinct vectors that can be near
        self.votes = votes[self.which]
        mine = found.some(self.which)
        share = np.divide(self.votes[:, 0], self.votes[:, 1], out=np.zeros(len(mine)), where=self.votes[:, 1] > 0)
        self.weight = idf * relevance(mine, share >= 0.5, len(idf))
        self.index = BlockMaxIndex(mine.weighted(self.weight), len(idf))

    def votes_of(self, texts: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[float, np.ndarray, np.ndarray]]:
        """Of each (terms, counts): share of label 1 among the nearest, their numbers, their cosines."""
        none = (self.prior, np.zeros(0, np.int64), np.zeros(0))
        if not self.index.n:
            return [none] * len(texts)
        queries = []
        for terms, counts in texts:
            w = (1 + np.log(counts)) * self.weight[terms]
            queries.append((terms, w / max(math.sqrt(math.fsum(w * w)), 1e-300)))
        out = []
        for (terms, _), (near, cosine, _) in zip(texts, self.index.search_all(queries, self.k), strict=True):
            pull = cosine * cosine
            toxic, every = (math.fsum(pull * self.votes[near, j]) for j in (0, 1))
            out.append(((toxic + PRIOR_WEIGHT * self.prior) / (every + PRIOR_WEIGHT), self.which[near], cosine) if len(terms) else none)
        return out


def _log_odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def calibration(vote: np.ndarray, toxic: np.ndarray, every: np.ndarray) -> tuple[float, float]:
    """(slope, offset) of the logistic curve through votes' log-odds; toxic of every weigh label 1.  Rising."""
    x, slope, offset = _log_odds(vote), 1.0, 0.0
    if not toxic.sum() or toxic.sum() == every.sum():
        return slope, offset
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(slope * x + offset, -30, 30)))
        g = np.array([(x * (toxic - every * p)).sum() - RIDGE * (slope - 1), (toxic - every * p).sum()])
        h = every * p * (1 - p)
        hess = np.array([[(h * x * x).sum() + RIDGE, (h * x).sum()], [(h * x).sum(), h.sum() + 1e-9]])
        step = np.linalg.solve(hess, g)
        slope, offset = slope + float(np.clip(step[0], -1, 1)), offset + float(np.clip(step[1], -1, 1))
        if np.abs(step).max() < 1e-10:
            break
    return max(slope, 0.05), offset


class Model:
    """Examples, their index and the calibration; its size is bounded by per_class."""

    def __init__(self, found: Vectors, labels: np.ndarray, docs: list, share: tuple[float, float], df: np.ndarray, n: int, k: int):
        """found: term counts of the examples in order of doc; df, n: documents with each term, and all of them."""
        groups: dict[bytes, list[int]] = {}
        for i, (a, b) in enumerate(zip(found.start[:-1].tolist(), found.start[1:].tolist(), strict=True)):
            groups.setdefault(hashlib.blake2b(found.term[a:b].tobytes() + found.value[a:b].tobytes(), digest_size=16).digest(), []).append(i)
        # Equal vectors are one example with all their labels: no tie between them is broken by an id.
        members = [groups[key] for key in sorted(groups)]
        distinct = found.some(np.array([m[0] for m in members], np.int64))
        weigh = np.array(share)[labels]
        votes = np.array([[math.fsum(weigh[i] for i in m if labels[i]), math.fsum(weigh[i] for i in m)] for m in members]).reshape(len(members), 2)
        #: Of each distinct vector: its least document, its examples, those labelled 1.
        self.shown = ([min(docs[i] for i in m) for m in members], np.array([len(m) for m in members], np.int32), np.array([labels[m].sum() for m in members], np.int32))
        idf = np.log((1 + n) / (1 + df)) + 1
        # Each half's votes from the other half; halves by position, which has nothing to do with labels.
        raw, side = np.zeros(len(members)), np.arange(len(members)) % 2
        for s in (0, 1):
            others = Voters(distinct.some(np.flatnonzero(side != s)), votes[side != s], idf, k)
            asked = [(distinct.term[a:b], distinct.value[a:b]) for a, b in zip(distinct.start[:-1][side == s].tolist(), distinct.start[1:][side == s].tolist(), strict=True)]
            raw[side == s] = [vote for vote, _, _ in others.votes_of(asked)]
            del others  # one index at a time
        self.voters = Voters(distinct, votes, idf, k)
        self.slope, self.offset = calibration(raw, votes[:, 0], votes[:, 1])

    def score_all(self, counted: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[float, np.ndarray, np.ndarray]]:
        """Of each (terms, counts): the score, the neighbours' numbers and their cosines."""
        found = self.voters.votes_of(counted)
        p = 1 / (1 + np.exp(-(self.slope * _log_odds(np.array([vote for vote, _, _ in found])) + self.offset)))
        return [(x, near, cosine) for x, (_, near, cosine) in zip(p.tolist(), found, strict=True)]


def codes_of(texts: list[str | None], number: dict[str, int]) -> Iterator[np.ndarray]:
    """Of each text, the numbers of its terms that have one."""
    get = number.get
    for text in texts:
        terms = terms_of(text)
        got = np.fromiter(map(get, terms, repeat(-1)), np.int32, len(terms))
        yield got[got >= 0]


def _labelled(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """doc, y: one label a document (the largest), without held-out rows, null ids and other labels than 0 and 1."""
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    return known.groupBy(F.col(id_col).alias("doc")).agg(F.max(label_col).cast("int").alias("y"))


def sample(labels: DataFrame, per_class: int, *, id_col: str = "doc_id", label_col: str = "toxic") -> tuple[DataFrame, tuple[int, int]]:
    """(at most per_class documents of each label, (documents labelled 0, labelled 1))."""
    known = saved(_labelled(labels, id_col, label_col), "labelled")
    count = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    some = [known.where(F.col("y") == y).orderBy(F.xxhash64("doc"), "doc").limit(per_class) for y in (0, 1)]
    return saved(some[0].unionByName(some[1]), "sample"), (count.get(0, 0), count.get(1, 0))


def examples(docs: DataFrame, chosen: DataFrame, id_type: str) -> pa.Table:
    """doc, y, terms, counts of the sample, by doc; chosen has a stated bound, so it can be broadcast and gathered.

    Documents that share an id are one example: the least vector.
    """
    both = docs.join(F.broadcast(chosen), docs["doc"] == chosen["doc"]).select(chosen["doc"], chosen["y"], "text")
    arrow = pa.string() if id_type == "string" else pa.int64()
    schema = pa.schema([("doc", arrow), ("y", pa.int32()), ("terms", pa.list_(pa.string())), ("counts", pa.list_(pa.int32()))])

    def one(ids: list, ys: list, texts: list) -> dict[str, list]:
        found = [sorted(Counter(terms_of(t)).items()) for t in texts]
        return {"doc": ids, "y": ys, "terms": [[t for t, _ in f] for f in found], "counts": [[n for _, n in f] for f in found]}

    rows = map_rows(both, one, f"doc {id_type}, y int, terms array<string>, counts array<int>", schema)
    return rows.groupBy("doc").agg(F.min(F.struct("terms", "counts", "y")).alias("m")).select("doc", "m.y", "m.terms", "m.counts").orderBy("doc").toArrow()


def encoded(terms: pa.ListArray, counts: pa.ListArray) -> tuple[list[str], Vectors]:
    """(all terms in order, the rows with terms as their places).  Terms of a row are in order, so their places are too."""
    if not len(terms):
        return [], Vectors(np.zeros(1, np.int64), np.zeros(0, np.int32), np.zeros(0))
    words = terms.flatten().dictionary_encode()
    spelt = words.dictionary.to_pylist()
    order = sorted(range(len(spelt)), key=spelt.__getitem__)
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(len(order), dtype=np.int32)
    codes = place[words.indices.to_numpy(zero_copy_only=False)] if len(spelt) else np.zeros(0, np.int32)
    start = np.r_[0, np.cumsum(terms.value_lengths().to_numpy(zero_copy_only=False))].astype(np.int64)
    return [spelt[i] for i in order], Vectors(start, codes, counts.flatten().to_numpy(zero_copy_only=False).astype(float))


def vectors(docs: DataFrame, vocab: list[str], id_type: str) -> DataFrame:
    """docs: doc, text.  doc, terms, counts of each row; and from each task term, n: how many of its rows hold a term.

    The term after the last stands for every row.  Counts of a task are the rows with a term.
    """
    shared = docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(vocab)})
    arrow, ints = pa.string() if id_type == "string" else pa.int64(), pa.list_(pa.int32())
    schema = pa.schema([("doc", arrow), ("terms", ints), ("counts", ints), ("term", pa.int32()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, seen = shared.value, np.zeros(len(shared.value) + 1, np.int64)
        for batch in slices(batches):
            got = [np.unique(c, return_counts=True) for c in codes_of(batch.column(1).to_pylist(), number)]
            start = np.r_[0, np.cumsum([len(t) for t, _ in got])].astype(np.int32)
            terms, counts = (np.concatenate([x[i] for x in got]).astype(np.int32) for i in (0, 1))
            seen[:-1] += np.bincount(terms, minlength=len(number))
            seen[-1] += batch.num_rows
            lists = [pa.ListArray.from_arrays(pa.array(start), pa.array(x)) for x in (terms, counts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists, pa.nulls(batch.num_rows, pa.int32()), pa.nulls(batch.num_rows, pa.int64())], schema=schema)
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(some), arrow), pa.nulls(len(some), ints), pa.nulls(len(some), ints), pa.array(some.astype(np.int32)), pa.array(seen[some])], schema=schema)

    return saved(docs.select("doc", "text").mapInArrow(count, f"doc {id_type}, terms array<int>, counts array<int>, term int, n long"), "vectors")


def document_frequencies(found: DataFrame, n_terms: int) -> tuple[np.ndarray, int]:
    """(documents with each term of the vocabulary, all documents); a row for each term is gathered."""
    told = found.where("term is not null").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    seen = np.zeros(n_terms + 1, np.int64)
    seen[told["term"].to_numpy()] = told["n"].to_numpy()
    return seen[:-1].astype(float), int(seen[-1])


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str, label_col: str, per_class: int, k: int, id_type: str) -> tuple[Model, DataFrame]:
    """docs: doc, text.  The model, and vectors()."""
    chosen, every = sample(labels.withColumn(id_col, F.col(id_col).cast(id_type)), per_class, id_col=id_col, label_col=label_col)
    rows = examples(docs, chosen, id_type)
    y, ids = rows["y"].to_numpy().astype(np.int64), rows["doc"].to_pylist()
    terms, counts = (rows[c].combine_chunks() for c in ("terms", "counts"))
    del rows  # one copy of the examples at a time is on the driver
    vocab, found = encoded(terms, counts)
    del terms, counts
    pa.default_memory_pool().release_unused()
    counted = vectors(docs, vocab, id_type)
    df, n = document_frequencies(counted, len(vocab))
    in_sample = np.bincount(y, minlength=2)
    share = [every[c] / in_sample[c] if in_sample[c] else 0.0 for c in (0, 1)]
    mean = float(np.dot(share, in_sample) / max(1, len(y)))
    return Model(found, y, ids, tuple(s / mean if mean else 0.0 for s in share), df, n, k), counted


def score_toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = PER_CLASS, k: int = NEIGHBOURS) -> DataFrame:
    """A row for each document row: doc_id, held_out, score (0 to 1), neighbours (array of doc_id, cosine, n, n_toxic).

    neighbours: the nearest distinct vectors of the sample, each with its least doc_id, its examples and those labelled 1.

    A null or empty text, or one without a term of the sample, scores by the rate of label 1 among the sample's
    termless texts.  Without usable labels every score is the same, near 0.  A document labelled more than once counts
    by its largest label.  Equal texts score the same; neighbours tie by their vectors.  A null id is never held out.
    """
    spark = docs.sparkSession
    id_type = "string" if dict(docs.dtypes)[id_col] == "string" else "long"
    texts = docs.select(docs[id_col].cast(id_type).alias("doc"), docs[text_col].alias("text"))
    fitted, counted = fit(texts, labels, id_col=id_col, label_col=label_col, per_class=per_class, k=k, id_type=id_type)
    model = spark.sparkContext.broadcast(fitted)
    arrow = pa.string() if id_type == "string" else pa.int64()
    near = pa.struct([("doc_id", arrow), ("cosine", pa.float64()), ("n", pa.int32()), ("n_toxic", pa.int32())])
    schema = pa.schema([("doc_id", arrow), ("score", pa.float64()), ("neighbours", pa.list_(near))])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, known = model.value, {}  # copies of a text are scored once
        ids = pa.array(m.shown[0], arrow)
        for batch in slices(batches):
            columns = [batch.column(i) for i in (1, 2)]
            start, (terms, counts) = columns[0].offsets.to_numpy(), (c.values.to_numpy(zero_copy_only=False) for c in columns)
            ends = zip(start[:-1].tolist(), start[1:].tolist(), strict=True)
            mine = {i: (terms[a:b], counts[a:b]) for i, (a, b) in enumerate(ends)}
            keys = [t.tobytes() + n.tobytes() for t, n in mine.values()]
            new = {key: i for i, key in enumerate(keys) if key not in known}
            if len(known) + len(new) > REMEMBERED:
                known, new = {}, {key: i for i, key in enumerate(keys)}
            known |= zip(new, m.score_all([mine[i] for i in new.values()]), strict=True)
            out = [known[key] for key in keys]
            ends = np.r_[0, np.cumsum([len(e) for _, e, _ in out])].astype(np.int32)
            e = np.concatenate([e for _, e, _ in out])
            shown = [ids.take(pa.array(e)), pa.array(np.concatenate([c for _, _, c in out])), pa.array(m.shown[1][e]), pa.array(m.shown[2][e])]
            evidence = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(shown, fields=list(near)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([p for p, _, _ in out]), evidence], schema=schema)

    scored = counted.where("term is null").select("doc", "terms", "counts").mapInArrow(score, f"doc_id {id_type}, score double, neighbours array<struct<doc_id:{id_type},cosine:double,n:int,n_toxic:int>>")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "neighbours")
