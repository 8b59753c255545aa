"""SimHash near-duplicates with BK-trees.

1. Fingerprints: words ``[^ \\t-\\r]+`` of the A-Z-lower-cased text, shingles of three words, XXH64 (seed 42) of each,
   majority of each bit.
2. Equal fingerprints are one node.  By the pigeonhole principle two fingerprints that differ in at most three
   bits agree in one of four 16-bit bands, and then, in the 48 bits left, in one of four 12-bit parts.  Each
   (band, part) with its 28 bits is a shard.  A shard's BK-tree - children keyed by their Hamming distance to the
   parent - is probed by the shard's own fingerprints only, since no other can match there; so a tree travels to
   the one task that holds its probes instead of to every executor, and no broadcast grows with the corpus.
   Probing follows only edges within the radius of the distance at the node.
3. A shard returns links to the least fingerprint of each of its components: at most one a member, never all pairs.
4. Components of all shards' links, found by star contraction over tables in the shared folder.

A shard of more than ``block`` fingerprints is dealt out in blocks, a tree for every two of them: exact, in
bounded memory.  Trees of many shards are built and probed together, level by level, in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, forget, map_rows, rows_with_key, saved, text_key

RADIUS = 3
SHINGLE = 3
SEED = 42
BLOCK = 20_000
CHUNK = 200_000


def fingerprint(text: str | None) -> int:
    """Unsigned 64-bit SimHash; 0 for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    of = xxhash.xxh64_intdigest
    if len(words) < SHINGLE:
        return of(b" ".join(words), SEED)
    counts, n = np.zeros(64, np.int64), len(words) - SHINGLE + 1
    for at in range(0, n, 16384):  # bounded memory for a text of any length
        part = words[at : at + 16384 + SHINGLE - 1]
        h = np.array([of(b"%b %b %b" % w, SEED) for w in zip(part, part[1:], part[2:], strict=False)], np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, k_text, fp (the fingerprint's bits as a signed long), a row for each document row."""

    def one(ids: list, keys: list, texts: list) -> dict[str, list]:
        return {"doc_id": ids, "k_text": keys, "fp": np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)}

    id_type = "string" if dict(docs.dtypes)[id_col] == "string" else "long"
    schema = pa.schema([("doc_id", pa.string() if id_type == "string" else pa.int64()), ("k_text", pa.int64()), ("fp", pa.int64())])
    return map_rows(docs.select(docs[id_col].cast(id_type), text_key(docs[text_col]), docs[text_col]), one, f"doc_id {id_type}, k_text long, fp long", schema)


def bk_forest(tree: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """BK-trees of the runs of equal `tree`: (root of each item, sorted edge codes parent*65+distance, children)."""
    first = np.flatnonzero(np.r_[True, tree[1:] != tree[:-1]])
    root = np.repeat(first, np.diff(np.r_[first, len(tree)]))
    wait = np.flatnonzero(root != np.arange(len(tree)))
    parent, codes, children = root[wait], [], []
    while len(wait):
        code = parent * 65 + np.bitwise_count(fp[wait] ^ fp[parent])
        order = np.argsort(code, kind="stable")
        wait, code = wait[order], code[order]
        head = np.r_[True, code[1:] != code[:-1]]
        codes.append(code[head])
        children.append(wait[head])
        parent = wait[head][np.cumsum(head) - 1][~head]
        wait = wait[~head]
    if not codes:
        return root, np.zeros(0, np.int64), np.zeros(0, np.int64)
    code, child = np.concatenate(codes), np.concatenate(children)
    order = np.argsort(code)
    return root, code[order], child[order]


def bk_probe(root: np.ndarray, codes: np.ndarray, children: np.ndarray, fp: np.ndarray, who: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(item, item within the radius), level by level, for the items `who`, each in its own tree."""
    node = root[who]
    while len(who):
        d = np.bitwise_count(fp[who] ^ fp[node]).astype(np.int64)
        near = (d <= radius) & (who != node)
        yield who[near], node[near]
        want = ((node * 65 + d)[:, None] + np.arange(-radius, radius + 1)).ravel()
        # a code beyond the node's own 65 is another node's: leave it out
        own = ((d[:, None] + np.arange(-radius, radius + 1)) >= 0).ravel() & ((d[:, None] + np.arange(-radius, radius + 1)) <= 64).ravel()
        at = np.searchsorted(codes, want)
        hit = own & (at < len(codes))
        hit[hit] = codes[at[hit]] == want[hit]
        who, node = np.repeat(who, 2 * radius + 1)[hit], children[at[hit]]


def roots(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Least label of each component after joining a and b; label is a fixed point already."""
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while len(differ := np.flatnonzero(label[label] != label)):
            label[differ] = label[label[differ]]
        left = label[a] != label[b]
        a, b = a[left], b[left]
    return label


def links(tree: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, least fingerprint of its component) for the members of components that aren't least themselves."""
    order = np.lexsort((fp, tree))
    tree, fp = tree[order], fp[order]
    keep = np.r_[True, (tree[1:] != tree[:-1]) | (fp[1:] != fp[:-1])]
    tree, fp = tree[keep], fp[keep]
    # The first item of a tree is its root: any fixed shuffle within a tree gives a broad one.
    order = np.lexsort((fp * np.uint64(0x9E3779B97F4A7C15), tree))
    tree, fp = tree[order], fp[order]
    root, codes, children = bk_forest(tree, fp)
    member = np.r_[tree[1:] == tree[:-1], False] | np.r_[False, tree[1:] == tree[:-1]]
    label, who = np.arange(len(fp)), np.flatnonzero(member)
    for at in range(0, len(who), 10_000):
        for a, b in bk_probe(root, codes, children, fp, who[at : at + 10_000], radius):
            label = roots(len(fp), a, b, label)
    least = fp.copy()
    np.minimum.at(least, label, fp)
    least = least[label]
    out = least != fp
    return fp[out], least[out]


def _shards(fp: Column) -> Column:
    """The 16 shard keys of a fingerprint."""
    keys = []
    for band in range(4):
        value = F.shiftrightunsigned(fp, 16 * band).bitwiseAND(F.lit(0xFFFF))
        high = F.lit(0).cast("long") if band == 3 else F.shiftleft(F.shiftrightunsigned(fp, 16 * band + 16), 16 * band)
        rest = high.bitwiseOR(fp.bitwiseAND(F.lit((1 << (16 * band)) - 1)))
        for part in range(4):
            sub = F.shiftrightunsigned(rest, 12 * part).bitwiseAND(F.lit(0xFFF))
            keys.append(F.lit((4 * band + part) << 28) + value * 4096 + sub)
    return F.array(*keys)


def near_links(distinct: DataFrame, *, radius: int = RADIUS, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """distinct: (fp).  (u, v): links that join exactly the fingerprints reachable within `radius` bits a step."""
    if not 0 <= radius <= 3:
        raise ValueError("the shards are exact up to a radius of 3")
    keyed = distinct.select("fp", F.explode(_shards(F.col("fp"))).alias("shard"))
    large = keyed.groupBy("shard").count().where(F.col("count") > block).select(F.col("shard").alias("s"), F.ceil(F.col("count") / block).alias("n"))
    large = saved(large, "large")
    none = F.lit(0).cast("long")
    dealt = keyed.select("shard", none.alias("i"), none.alias("j"), "fp")
    if not large.isEmpty():
        joined = keyed.join(large, keyed["shard"] == large["s"], "left")
        mine = F.pmod(F.xxhash64("fp"), F.coalesce("n", F.lit(1)))
        joined = joined.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(none, F.coalesce("n", F.lit(1)) - 1)))
        dealt = joined.select("shard", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])
        held: list[tuple[np.ndarray, np.ndarray]] = []
        number, last, rows = 0, None, 0

        def flush(parts: list) -> Iterator[pa.RecordBatch]:
            if parts:
                u, v = links(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), radius)
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], schema=schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[:3]], axis=1)
            fp = batch.column(3).to_numpy(zero_copy_only=False).view(np.uint64)
            new = np.r_[last is None or (key[0] != last).any(), (key[1:] != key[:-1]).any(axis=1)]
            tree = number + np.cumsum(new)
            number, last = int(tree[-1]), key[-1]
            held.append((tree, fp))
            rows += len(fp)
            if rows >= chunk and tree[0] != tree[-1]:  # the last tree may go on
                cut = int(np.searchsorted(tree, tree[-1]))
                yield from flush([*held[:-1], (tree[:cut], fp[:cut])])
                held, rows = [(tree[cut:], fp[cut:])], len(fp) - cut
        yield from flush(held)

    sorted_ = dealt.repartition("shard", "i", "j").sortWithinPartitions("shard", "i", "j")
    return sorted_.mapInArrow(run, "u long, v long")


def components(prints: DataFrame, **options) -> DataFrame:
    """prints: fingerprints() written to a table.  (fp, rep): rep is struct(doc_id, k_text) of the component's first document.

    First: least doc_id, nulls last, then least text hash.
    """
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k_text"))
    by_fp = prints.groupBy("fp").agg(first.alias("least"))
    pairs = saved(near_links(prints.select("fp").distinct(), **options), "links")
    found = saved(connected_components(pairs), "components")
    forget(pairs)
    marked = by_fp.join(found, by_fp["fp"] == found["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    reps = marked.groupBy("root").agg(F.min("least").alias("rep")).withColumnRenamed("root", "r")
    return marked.join(reps, marked["root"] == reps["r"]).select("fp", F.struct("rep.doc_id", "rep.k_text").alias("rep"))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """A row for each document row: doc_id, k_text, fp, rep (struct of the first document of its component).

    Null, empty and blank texts have fingerprint 0 and are linked like any other.  Repeated rows are linked by
    their equal fingerprints.  Null ids come last when the first document is chosen.  Empty in, empty out.
    """
    prints = saved(fingerprints(docs, id_col=id_col, text_col=text_col), "prints")
    marked = components(prints, **options).withColumnRenamed("fp", "f")
    return prints.join(marked, prints["fp"] == marked["f"]).select("doc_id", "k_text", "fp", "rep")


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The first document of each component, all its columns; of rows equal in id and text one stays."""
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, **options)
    stays = found.where((F.col("rep.doc_id").eqNullSafe(F.col("doc_id"))) & (F.col("rep.k_text") == F.col("k_text")))
    stays = saved(stays.groupBy(F.col("doc_id").alias("s_id"), F.col("k_text").alias("s_text")).count(), "stays")
    keyed = rows_with_key(docs, id_col, text_col)
    id_type = "string" if dict(docs.dtypes)[id_col] == "string" else "long"
    kept = keyed.join(stays, keyed["k_id"].cast(id_type).eqNullSafe(stays["s_id"]) & (keyed["k_text"] == stays["s_text"]), "left_semi")
    if not stays.where("count > 1").isEmpty():
        kept = kept.dropDuplicates(["k_id", "k_text"])
    return kept.select("row.*")
