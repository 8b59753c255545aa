"""Line dedup: repeated runs of lines from a suffix array built by distributed prefix doubling.

A document is the sequence of the ids of its non-blank lines, trimmed; an id is the place of the line's 128-bit BLAKE2
digest among all repeated lines in order.  Doubling gives suffixes ranks: the pair of the ranks for h lines here and h
lines on is ranked, by a global sort of the distinct pairs, for 2h lines.  A suffix whose first h lines stand nowhere else
has its place in the array already; only the others are doubled again, so each round is smaller.

Suffixes of one rank are an interval of the array whose common prefix is h lines at least.  An interval at another depth d
(h < d <= 2h) is that of two overlapping ranks, here and d - h lines on.  A run counts as a repeat from ``min_words``
words on; the interval of each suffix is cut at the first depth with so many words, and so are those of the prefixes
that end at each line.  Together these cut runs cover exactly the lines of the maximal repeated runs: a line of such a run
either has min_words before or after it within the run, or the run's first cut passes it.  Depths are thus min_words
at most, and the rounds log2 of that, whatever the length of a repeat.

Of each interval the first copy stays (least id, then text hash and line); the lines of later copies are deleted.
Intervals are counted by partial aggregation and told to their suffixes by an equi-join, which AQE can split: a line that
stands in a third of all documents is one group of sums and a split join.  Every round is written to the shared folder.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, map_rows, rows_with_key, saved, text_key

MIN_WORDS = 50
_RUNS = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))


def lines_of(text: str | None) -> list[tuple[int, int, bytes]]:
    """(line number, words, digest) of the lines that aren't blank."""
    found = ((no, len(raw.split()), raw) for no, raw in enumerate((text or "").split("\n")))
    return [(no, n, hashlib.blake2b(raw.strip().encode("utf-8", "surrogatepass"), digest_size=16).digest()) for no, n, raw in found if n]


def cuts(words: list[int], least: int) -> list[list[int]]:
    """Of each place, the depths of the cut runs that start there: the shortest with `least` words that start or end at a line."""
    n = len(words)
    upto = np.cumsum(words)
    before = upto - words
    out: list[list[int]] = [[] for _ in range(n)]
    last = np.searchsorted(upto, before + least)
    first = np.searchsorted(before, upto - least, side="right") - 1
    for at in range(n):
        if last[at] < n:
            out[at].append(int(last[at]) - at + 1)
        if first[at] >= 0:
            out[first[at]].append(at - int(first[at]) + 1)
    return [sorted(set(d)) for d in out]


def _lines(docs: DataFrame, id_col: str, text_col: str, least: int, id_type: str) -> DataFrame:
    """has, id, text, at, line, h1, h2, runs (depth, line number of the end): a row for each line that isn't blank.

    has: whether there is an id.  at: the line's place in its document's sequence.
    """
    none = "" if id_type == "string" else 0
    run = pa.list_(pa.struct([("d", pa.int32()), ("last", pa.int32())]))
    schema = pa.schema([("has", pa.bool_()), ("id", pa.string() if id_type == "string" else pa.int64()), ("text", pa.int64()), ("at", pa.int32()), ("line", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("runs", run)])

    def one(ids: list, keys: list, texts: list) -> dict[str, list]:
        out: dict[str, list] = {f: [] for f in schema.names}
        digests = []
        for doc, key, text in zip(ids, keys, texts, strict=True):
            found = lines_of(text)
            out["has"] += [doc is not None] * len(found)
            out["id"] += [none if doc is None else doc] * len(found)
            out["text"] += [key] * len(found)
            out["at"] += range(len(found))
            out["line"] += [no for no, _, _ in found]
            digests += [h for _, _, h in found]
            out["runs"] += [[{"d": d, "last": found[at + d - 1][0]} for d in depths] for at, depths in enumerate(cuts([n for _, n, _ in found], least))] if found else []
        both = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
        return out | {"h1": both[:, 0], "h2": both[:, 1]}

    ddl = f"has boolean, id {id_type}, text long, at int, line int, h1 long, h2 long, runs array<struct<d:int,last:int>>"
    return map_rows(docs.select(docs[id_col].cast(id_type), text_key(docs[text_col]), docs[text_col]), one, ddl, schema)


_PLACE = ("has", "id", "text", "at")


def _place() -> Column:
    """Documents without an id come first."""
    return F.struct(*_PLACE)


def _ranked(rows: DataFrame, names: list[str], label: str) -> DataFrame:
    """Groups of `names` with more than one place: names, first (the least place), rank.

    Ranks are in the order of `names`: the groups, distinct by now, are sorted over the partitions, and a row's number
    in its partition follows the partition's own.
    """
    groups = rows.groupBy(*names).agg(F.min(_place()).alias("first"), F.max(_place()).alias("latest")).where("first < latest").drop("latest")
    return saved(groups.orderBy(*names).withColumn("rank", F.monotonically_increasing_id()), label)


def _told(rows: DataFrame, groups: DataFrame, names: list[str]) -> DataFrame:
    other = groups.select(*[F.col(n).alias(f"g_{n}") for n in names], "first", "rank")
    same = [rows[n] == other[f"g_{n}"] for n in names]
    return rows.join(other, same).drop(*[f"g_{n}" for n in names])


def _hits(told: DataFrame) -> DataFrame:
    """Runs (rows with `last`) that aren't the first copy."""
    return told.where(F.col("last").isNotNull() & (_place() > F.col("first"))).select(*_PLACE, "line", "last")


def _deeper(low: int, high: int | None = None) -> Column:
    """The runs of a depth over low, and up to high."""
    return F.filter("runs", lambda r: (r["d"] > low) & (F.lit(True) if high is None else r["d"] <= high))


def suffix_runs(lines: DataFrame) -> list[DataFrame]:
    """has, id, text, at, line, last: the cut runs that are later copies, a table for each round."""
    deepest = lines.agg(F.max(F.aggregate("runs", F.lit(0), lambda most, r: F.greatest(most, r["d"])))).first()[0] or 0
    if not deepest:
        return []
    # Round 0: lines.  A run of one line is told by its line's rank.
    names = ["h1", "h2"]
    groups = _ranked(lines, names, "lines-ranked")
    told = saved(_told(lines, groups, names).drop("h1", "h2"), "round")
    forget(groups)
    one = F.filter("runs", lambda r: r["d"] == 1)
    found = [_hits(told.withColumn("last", F.when(F.size(one) > 0, F.col("line"))))]
    active = told.select(*_PLACE, "line", F.col("rank").alias("r"), "runs")
    names, h = ["d", "r", "r2"], 1
    while h < deepest:
        # This round's rows: the next rank's pair (without last), and the runs of a depth between h and 2h.
        ours = _deeper(h, 2 * h)
        if 2 * h < deepest:
            ours = F.concat(F.array(F.struct(F.lit(2 * h).alias("d"), F.lit(None).cast("int").alias("last"))), ours)
        starts = active.select(*_PLACE, "line", "r", _deeper(2 * h).alias("runs"), F.explode(ours).alias("run"))
        starts = starts.select(*_PLACE, "line", "r", F.when(F.col("run.last").isNull(), F.col("runs")).alias("runs"), F.col("run.d").alias("d"), F.col("run.last").alias("last"), (F.col("at") + F.col("run.d") - h).alias("on"))
        # Rows equal in id and text are one document.
        other = active.groupBy(*[F.col(c).alias(f"o_{c}") for c in _PLACE]).agg(F.max("r").alias("r2"))
        meets = [starts[c] == other[f"o_{c}"] for c in _PLACE[:3]] + [starts["on"] == other["o_at"]]
        pairs = saved(starts.join(other, meets).drop("on", *[f"o_{c}" for c in _PLACE]), "pairs")
        groups = _ranked(pairs, names, "ranked")
        told = saved(_told(pairs, groups, names).drop("r", "r2"), "round")
        forget(groups)
        forget(pairs)
        found.append(_hits(told))
        active = told.where("last is null").select(*_PLACE, "line", F.col("rank").alias("r"), "runs")
        h *= 2
    return found


def repeated_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """k_id, k_text, runs: the lines of later copies as disjoint [first, last] line numbers, in order.

    Lines part at newlines only and are compared without the white space around them.  Copies within a document
    count too.  Rows equal in id and text are one document.  Null and blank texts have no lines.  Blank lines don't
    part a run; those inside a deleted run go with it.  Null ids come first.  Documents without repeats are absent.
    """
    if min_words < 1:
        raise ValueError("min_words must be at least 1")
    id_type = "string" if dict(docs.dtypes)[id_col] == "string" else "long"
    found = suffix_runs(saved(_lines(docs, id_col, text_col, min_words, id_type), "lines"))
    if not found:
        return docs.sparkSession.createDataFrame([], f"k_id {id_type}, k_text long, runs array<struct<first:long,last:long>>")
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    run = F.struct(F.col("line").cast("long").alias("first"), F.col("last").cast("long").alias("last"))
    runs = every.groupBy("has", "id", "text").agg(F.collect_set(run).alias("runs"))
    runs = runs.select(F.when(F.col("has"), F.col("id")).alias("k_id"), F.col("text").alias("k_text"), "runs")

    def join(ids: list, keys: list, runs: list) -> dict[str, list]:
        return {"k_id": ids, "k_text": keys, "runs": [_joined(r) for r in runs]}

    schema = pa.schema([("k_id", pa.string() if id_type == "string" else pa.int64()), ("k_text", pa.int64()), ("runs", _RUNS)])
    return map_rows(runs, join, f"k_id {id_type}, k_text long, runs array<struct<first:long,last:long>>", schema)


def _joined(runs: list[dict]) -> list[dict[str, int]]:
    out: list[dict[str, int]] = []
    for r in sorted(runs, key=lambda r: r["first"]):
        if out and r["first"] <= out[-1]["last"] + 1:
            out[-1]["last"] = max(out[-1]["last"], r["last"])
        else:
            out.append(dict(r))
    return out


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = None, **options) -> DataFrame:
    """All documents with all their columns, the text without its later copies of repeated runs.

    Documents without repeats keep their text as it is; one that loses all its lines keeps an empty text.
    chars_col, if given, becomes the new length of changed texts.
    """
    parted = with_runs(docs, id_col=id_col, text_col=text_col, **options)
    changed = F.col("runs").isNotNull()
    fields = []
    for c in docs.columns:
        value = F.col(f"row.`{c}`")
        if c == text_col:
            value = F.when(changed, F.col("new_text")).otherwise(value)
        elif c == chars_col:
            value = F.when(changed, F.length("new_text")).otherwise(value).cast(dict(docs.dtypes)[c])
        fields.append(value.alias(c))
    return parted.select(*fields)


def with_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """row (the input row), runs (null: none), new_text (null: unchanged)."""
    found = repeated_runs(docs, id_col=id_col, text_col=text_col, **options).select(F.col("k_id").alias("r_id"), F.col("k_text").alias("r_text"), "runs")
    keyed = rows_with_key(docs, id_col, text_col)
    id_type = "string" if dict(docs.dtypes)[id_col] == "string" else "long"
    parted = keyed.join(found, keyed["k_id"].cast(id_type).eqNullSafe(found["r_id"]) & (keyed["k_text"] == found["r_text"]), "left")
    lines = F.split(F.col(f"row.`{text_col}`"), "\n", -1)
    # The lines before the first run, between runs, and after the last.
    between = F.transform("runs", lambda r, i: F.slice(lines, F.when(i == 0, F.lit(1)).otherwise(F.element_at("runs", i)["last"] + 2).cast("int"), (r["first"] - F.when(i == 0, F.lit(0)).otherwise(F.element_at("runs", i)["last"] + 1)).cast("int")))
    after = F.slice(lines, (F.element_at("runs", -1)["last"] + 2).cast("int"), F.size(lines))
    new = F.when(F.col("runs").isNotNull(), F.array_join(F.concat(F.flatten(between), after), "\n"))
    return parted.select("row", "runs", new.alias("new_text"))
