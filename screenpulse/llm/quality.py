"""Quality classifier: document evidence and site posteriors, combined by hierarchical empirical Bayes.

1. A logistic model over counts of a whole text (letters, symbols, capitals, repetition, line and word lengths) is
   fitted on a bounded sample of labelled documents (``per_class`` of each label).
2. Every document's probability is summed by site path, and by host, with partial aggregation: a host with a third
   of all rows is a few partial sums.  Sums are of whole numbers, so they are the same in any order.
3. Empirical Bayes from the top: hosts shrink towards the corpus mean by the strength that the spread between hosts
   supports (method of moments); paths shrink towards their host in the same way.  A sparse site is its parent.
4. A document's log-odds move by those of its path against the corpus mean, all three without the document itself:
   its evidence counts once.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_rows, saved, text_key
from .toxicity import sample

PER_CLASS = 4000
THRESHOLD = 0.5
RIDGE = 1.0
#: Share of a site's log-odds in a document's.
SITE_WEIGHT = 1.0
FEATURES = ("words", "word_len", "long_words", "symbols", "bars", "bangs", "capitals", "digits", "repeated_words", "repeated_lines", "line_words", "stops")

_NOT_SYMBOL = bytes(c for c in range(256) if c >= 128 or c <= 32 or chr(c).isalnum() or chr(c) in ".,;:'\"()-?!|")
_CAPITALS = bytes(range(65, 91))
_DIGITS = bytes(range(48, 58))


def features(text: str | None) -> list[float]:
    """One number for each of FEATURES; shares and logarithms, so length alone says little."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    n, size = len(words), max(1, len(raw))
    if not n:
        return [0.0] * len(FEATURES)
    letters = max(1, size - raw.count(b" ") - raw.count(b"\n"))
    lengths = np.fromiter(map(len, words), np.int64, n)
    capitals = len(raw) - len(raw.translate(None, _CAPITALS))
    digits = len(raw) - len(raw.translate(None, _DIGITS))
    return [
        math.log1p(n), float(lengths.mean()), float((lengths > 12).mean()),
        len(raw.translate(None, _NOT_SYMBOL)) / letters, raw.count(b"|") / n, raw.count(b"!") / n, capitals / letters, digits / letters,
        1 - len(set(words)) / n, 1 - len(set(lines)) / max(1, len(lines)), math.log1p(n / max(1, len(lines))), float((lengths <= 3).mean()),
    ]


class Logistic:
    """Ridge logistic regression on standardised features and their squares, by Newton's method."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray):
        self.mean, self.scale, self.beta = np.zeros(x.shape[1] if x.ndim == 2 else 0), None, None
        if not len(y) or y.min() == y.max():
            return
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        z = self.design(x)
        beta = np.zeros(z.shape[1])
        ridge = np.full(z.shape[1], RIDGE)
        ridge[0] = 1e-6
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
            w = weight * np.maximum(p * (1 - p), 1e-9)
            step = np.linalg.solve((z * w[:, None]).T @ z + np.diag(ridge), z.T @ (weight * (y - p)) - ridge * beta)
            beta = beta + np.clip(step, -5, 5)
            if np.abs(step).max() < 1e-8:
                break
        self.beta = beta

    def design(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.concatenate([np.ones((len(z), 1)), z, z * z], axis=1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        if self.beta is None:
            return np.full(len(x), 0.5)
        return 1 / (1 + np.exp(-np.clip(self.design(x) @ self.beta, -30, 30)))

    def of(self, texts: list[str | None]) -> np.ndarray:
        return self.probability(np.array([features(t) for t in texts]).reshape(len(texts), len(FEATURES)))


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str, text_col: str, label_col: str, per_class: int) -> Logistic:
    """docs' texts are only read for the sample, whose features (at most 2 * per_class rows) are gathered."""
    chosen, (all0, all1) = sample(labels, per_class, id_col=id_col, label_col=label_col)
    mine = docs.join(F.broadcast(chosen), docs[id_col] == chosen["doc"]).select(chosen["doc"].cast("string").alias("doc"), "y", docs[text_col].alias("text"))
    schema = pa.schema([("doc", pa.string()), ("y", pa.int32()), ("x", pa.list_(pa.float64()))])

    def one(ids: list, ys: list, texts: list) -> dict[str, list]:
        return {"doc": ids, "y": ys, "x": [features(t) for t in texts]}

    # Repeated ids: one row each, so that the sample's bound holds.
    rows = map_rows(mine, one, "doc string, y int, x array<double>", schema).groupBy("doc").agg(F.min(F.struct("y", "x")).alias("m"))
    rows = sorted(rows.select("doc", "m.y", "m.x").collect(), key=lambda r: r["doc"])
    y = np.array([r["y"] for r in rows], np.float64)
    n = (max(1, (y == 0).sum()), max(1, (y == 1).sum()))
    weight = np.where(y == 1, all1 / n[1], all0 / n[0])
    return Logistic(np.array([r["x"] for r in rows]), y, weight / max(1e-9, weight.mean()) if len(y) else weight)


#: Evidence is summed in units of a billionth.
_UNIT = 1_000_000_000


def sites(evidence: DataFrame) -> DataFrame:
    """evidence: host, path, p.  A row for each path: host, path, and of path, host and corpus the documents and the sum
    of p (pn, ps, hn, hs, cn, cs), with the strengths hk and pk that hosts and paths are shrunk by.

    The strength of a parent is mean*(1-mean)/spread - 1 of a beta prior whose spread is that of the children
    beyond what their sizes explain; without a spread beyond that it is infinite: children are their parent.
    """
    units = F.sum(F.round(F.col("p") * _UNIT).cast("long"))
    paths = saved(evidence.groupBy("host", "path").agg(F.count("*").alias("pn"), units.alias("pu")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("pn").alias("hn"), F.sum("pu").alias("hu"))
    total = hosts.agg(F.sum("hn").alias("n"), F.sum("hu").alias("u")).first()
    n = total["n"] or 0
    mean = total["u"] / _UNIT / n if n else 0.5

    def strength(children: DataFrame, n: str, share: Column, parent: Column) -> float:
        """Between-children variance by moments, as a prior's number of documents; one pass."""
        size = F.col(n).cast("double")
        r = children.agg(F.sum(size * F.pow(share - parent, 2)).alias("q"), F.count("*").alias("k"), F.sum(size).alias("n"), F.sum(size * size).alias("n2")).first()
        noise = mean * (1 - mean)
        room = r["n"] - r["n2"] / r["n"] if r["n"] else 0.0
        between = (r["q"] - (r["k"] - 1) * noise) / room if room > 0 else 0.0
        return max(1.0, noise / between - 1) if between > 0 else math.inf

    of = lambda u, n: F.col(u) / F.lit(float(_UNIT)) / F.col(n)
    hk = strength(hosts, "hn", of("hu", "hn"), F.lit(mean))
    both = saved(paths.join(hosts.withColumnRenamed("host", "h"), paths["host"].eqNullSafe(F.col("h"))).drop("h"), "hosts")
    pk = strength(both, "pn", of("pu", "pn"), _shrunk(F.col("hn"), F.col("hu") / F.lit(float(_UNIT)), F.lit(mean), hk))
    sums = [(F.col(u) / F.lit(float(_UNIT))).alias(s) for u, s in (("pu", "ps"), ("hu", "hs"))]
    return both.select("host", "path", "pn", "hn", *sums, F.lit(n).cast("long").alias("cn"), F.lit(mean * n).alias("cs"), F.lit(hk).alias("hk"), F.lit(pk).alias("pk"))


def _shrunk(n: Column, s: Column, parent: Column, k: float) -> Column:
    return parent if math.isinf(k) else (s + F.lit(k) * parent) / (n + F.lit(k))


def posteriors(p: Column) -> dict[str, Column]:
    """corpus, host_posterior, path_posterior of a document with evidence p among the others of its site."""
    k = lambda c, n, s, parent: F.when(F.isnan(c) | (c == math.inf), parent).otherwise((s + c * parent) / (n + c))
    corpus = F.when(F.col("cn") > 1, (F.col("cs") - p) / (F.col("cn") - 1)).otherwise(0.5)
    host = k(F.col("hk"), F.col("hn") - 1, F.col("hs") - p, corpus)
    return {"corpus": corpus, "host_posterior": host, "path_posterior": k(F.col("pk"), F.col("pn") - 1, F.col("ps") - p, host)}


def _score(p: Column, corpus: Column, path: Column) -> Column:
    """Evidence moved by its path's posterior against the corpus."""
    clip = lambda c: F.least(F.greatest(c, F.lit(1e-6)), F.lit(1 - 1e-6))
    logit = lambda c: F.log(clip(c) / (1 - clip(c)))
    return 1 / (1 + F.exp(-(logit(p) + SITE_WEIGHT * (logit(path) - logit(corpus)))))


def _scored(docs: DataFrame, labels: DataFrame, kept: list[Column], *, id_col: str, text_col: str, host_col: str, path_cols: tuple[str, ...], label_col: str, per_class: int) -> DataFrame:
    """kept, p, corpus, host_posterior, path_posterior and score of each row; every text is looked at once.

    Rows meet their site's sums by an equi-join: a row for each path, which Spark broadcasts while they are under its
    threshold, and beyond it a join whose hot sites AQE can split.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col, per_class=per_class))

    @F.pandas_udf("double")
    def evidence(texts: pd.Series) -> pd.Series:
        return pd.Series(model.value.of(texts.tolist()))

    path = F.to_json(F.array(*[docs[c].cast("string") for c in path_cols])) if path_cols else F.lit("")
    rows = saved(docs.select(*kept, docs[host_col].cast("string").alias("host"), path.alias("path"), evidence(docs[text_col]).alias("p")), "evidence")
    site = sites(rows).withColumnRenamed("host", "s_host").withColumnRenamed("path", "s_path")
    site = saved(site, "sites")
    both = rows.join(site, rows["host"].eqNullSafe(site["s_host"]) & (rows["path"] == site["s_path"]))
    both = both.withColumns(posteriors(F.col("p")))
    return both.withColumn("score", _score(F.col("p"), F.col("corpus"), F.col("path_posterior")))


def score_quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_cols: tuple[str, ...] = ("lang",), label_col: str = "quality", per_class: int = PER_CLASS, threshold: float = THRESHOLD) -> DataFrame:
    """A row for each document row: doc_id, k_text, evidence, host_posterior, path_posterior, score, keep.

    Null hosts or paths are sites of their own.  Null and empty texts have all features 0.  Without both labels the
    evidence is 0.5 throughout.  Labels of held-out ids are not learnt from.  Equal rows score the same.  A document
    alone in its site has its parent's posterior; one alone in the corpus keeps its evidence.
    """
    id_type = "string" if dict(docs.dtypes)[id_col] == "string" else "long"
    kept = [docs[id_col].cast(id_type).alias("doc_id"), text_key(docs[text_col]).alias("k_text")]
    found = _scored(docs, labels, kept, id_col=id_col, text_col=text_col, host_col=host_col, path_cols=path_cols, label_col=label_col, per_class=per_class)
    return found.select("doc_id", "k_text", F.col("p").alias("evidence"), "host_posterior", "path_posterior", "score", (F.col("score") >= threshold).alias("keep"))


def drop_low_quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_cols: tuple[str, ...] = ("lang",), label_col: str = "quality", per_class: int = PER_CLASS, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that pass, all their columns."""
    kept = [F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row")]
    found = _scored(docs, labels, kept, id_col=id_col, text_col=text_col, host_col=host_col, path_cols=path_cols, label_col=label_col, per_class=per_class)
    return found.where(F.col("score") >= threshold).select("row.*")
