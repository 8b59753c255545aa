"""Packing by concatenate and cut.

Pass 1 tokenises each partition, numbers the tokens before each document within its partition and writes ids to
the shared folder.  Prefix sums over the partitions' totals - one number a partition - give global offsets.
Pass 2 cuts the stream into fixed windows; a document that crosses a boundary leaves a piece on either side.

Nothing is shuffled: pass 2 needs no order, since each row carries its offset.
"""

from __future__ import annotations

import json
import os
import re
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import saved, slices

LENGTH = 4096
END = 2
#: Words whose ids a worker remembers (some 150 bytes each); then it starts anew.
REMEMBERED = 1_000_000
#: Input partitions up to which their offsets are broadcast (16 bytes each).
BROADCAST_PARTITIONS = 200_000

_LOADED: dict[str, tuple] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: The splitter of tokenizers whose words can be looked up one by one, and their normaliser (fixed values of the file format).
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
#: The same splitter over the letters of ASCII and Latin-1, lower-cased.
_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9 \n\r\t]+")
#: Text of which that splitter, NFC and lower-casing are known: printable ASCII, Latin-1 letters, a few marks.
_PLAIN = re.compile(r"[ -~À-ÖØ-öø-ÿ¡¿«»\n\r\t]*")


def _byte_letters() -> dict[int, str]:
    """The letter of each byte in byte-level vocabularies: printable ones stand for themselves, others from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in shown)}


class _Words(dict):
    """Ids of words, looked up in the model once each."""

    def __init__(self, tokenizer: Tokenizer):
        super().__init__()
        self.model, self.letters = tokenizer.model, _byte_letters()

    def __missing__(self, word: str) -> bytes:
        ids = array("I", [t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(self.letters))])
        if sys.byteorder == "big":
            ids.byteswap()
        out = ids.tobytes()
        if len(word) <= 64:
            self[word] = out
        return out


def encoder(path: str):
    """text -> its ids as little-endian uint32 bytes, as tokenizers gives them without special tokens.

    For a tokenizer of lower-cased words that drops white space, no token crosses a space or line end: ids are looked
    up word by word.  What isn't plain goes to the tokenizer, by the pieces between spaces; and whole texts for any
    other tokenizer.
    """
    if path not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            _LOADED[path] = tokenizer, _by_word(json.load(f)), _Words(tokenizer)
    tokenizer, by_word, known = _LOADED[path]

    def whole(text: str) -> bytes:
        return np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def plain(text: str) -> bytes | None:
        if "<|" in text or not _PLAIN.fullmatch(text):
            return None
        return b"".join([known[w] for w in _WORDS.findall(text.lower())])

    def encode(text: str) -> bytes:
        if not by_word:
            return whole(text)
        if len(known) > REMEMBERED:
            known.clear()
        if (ids := plain(text)) is not None:
            return ids
        return b"".join([whole(p) if (ids := plain(p)) is None else ids for p in text.split(" ")])

    return encode


def _by_word(spec: dict) -> bool:
    pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    model = spec.get("model") or {}
    return (
        (spec.get("normalizer") or {}).get("normalizers") == _NORMAL
        and len(pre) == 2
        and (pre[0].get("pattern") or {}).get("Regex") == _SPLIT
        and (pre[0].get("behavior"), pre[0].get("invert")) == ("Removed", True)
        and (pre[1].get("type"), pre[1].get("add_prefix_space"), pre[1].get("use_regex")) == ("ByteLevel", False, False)
        and (model.get("type"), model.get("dropout"), model.get("unk_token"), model.get("ignore_merges")) == ("BPE", None, None, False)
        and all(t["content"].startswith("<|") and not any(c.isspace() for c in t["content"]) and not (t["lstrip"] or t["rstrip"] or t["single_word"]) for t in spec.get("added_tokens", []))
    )


def tokenize(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end: int = END) -> DataFrame:
    """part, before, doc_id, n, ids: tokens of each document (with the end id), and those before it in its partition."""
    path = tokenizer or default_tokenizer()
    id_type = "string" if dict(docs.dtypes)[id_col] == "string" else "long"
    schema = pa.schema([("part", pa.int64()), ("before", pa.int64()), ("doc_id", pa.string() if id_type == "string" else pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])
    closing = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, before = encoder(path), TaskContext.get().partitionId(), 0
        for batch in slices(batches, 256):
            ids = [encode(t or "") + closing for t in batch.column(1).to_pylist()]
            n = np.array([len(x) // 4 for x in ids], np.int64)
            at = before + np.cumsum(n) - n
            before += int(n.sum())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), part, np.int64)), pa.array(at), batch.column(0), pa.array(n), pa.array(ids, pa.binary())], schema=schema)

    return docs.select(docs[id_col].cast(id_type), docs[text_col]).mapInArrow(run, f"part long, before long, doc_id {id_type}, n long, ids binary")


def pack(docs: DataFrame, *, length: int = LENGTH, broadcast_partitions: int = BROADCAST_PARTITIONS, **options) -> DataFrame:
    """A row for each piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids (little-endian uint32).

    Sequence s holds tokens s*length to (s+1)*length of the stream; all but the last are full.  A null or empty
    text is its end id alone.  Repeated rows are packed each.  An empty table has no pieces.
    """
    if length < 1:
        raise ValueError("length must be at least 1")
    tokens = saved(tokenize(docs, **options), "tokens")
    spark = tokens.sparkSession
    totals = sorted((r["part"], r["n"]) for r in tokens.groupBy("part").agg(F.sum("n").alias("n")).collect())
    base, at = [], 0
    for part, n in totals:
        base.append((part, at))
        at += n
    offsets = spark.createDataFrame(base, "p long, base long")
    offsets = F.broadcast(offsets) if len(base) <= broadcast_partitions else offsets
    placed = tokens.join(offsets, tokens["part"] == offsets["p"]).select("doc_id", (F.col("base") + F.col("before")).alias("g"), "n", "ids")
    id_type = dict(tokens.dtypes)["doc_id"]
    schema = pa.schema([("doc_id", pa.string() if id_type == "string" else pa.int64()), *((c, pa.int64()) for c in ("start", "length", "doc_tokens", "sequence_id", "offset")), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            g, n = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            pieces = (g + n - 1) // length - g // length + 1
            row = np.repeat(np.arange(len(n)), pieces)
            k = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            seq = (g // length)[row] + k
            a = np.maximum(g[row], seq * length)
            b = np.minimum((g + n)[row], (seq + 1) * length)
            start = a - g[row]
            ids = batch.column(3).to_pylist()
            cut = [ids[r][4 * s : 4 * e] for r, s, e in zip(row.tolist(), start.tolist(), (b - g[row]).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), *(pa.array(x) for x in (start, b - a, n[row], seq, a - seq * length)), pa.array(cut, pa.binary())], schema=schema)

    return placed.mapInArrow(run, f"doc_id {id_type}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")


def with_crc(pieces: DataFrame) -> DataFrame:
    """The pieces with ids_crc32 (unsigned, over the little-endian uint32 ids) in place of ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
