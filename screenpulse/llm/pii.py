"""Personal data by bootstrapped contextual extraction; DataFrame functions only.

1. Base spans: each kind's expression, leftmost matches one after another, those that fail their test dropped.
   Matches and the pieces between them (``split``) give code-point offsets without a UDF.
2. Candidates: addresses with an @ and digit groups, each with its context: the word before, the two words before,
   the word after.  A context is lexical: its nearest word has a letter.  A candidate that passes a base test is a seed
   of that kind.
3. The graph of patterns (contexts) and instances (candidate texts) is scored in rounds: a pattern's confidence in a
   kind is the mean score of all its instances, those that fail the kind's test counting against it, damped for few;
   only patterns that reach ``trust`` vote; an instance's score is the noisy or of its patterns.  Seeds stay 1.
4. Other candidates whose score reaches ``confidence`` and whose shape fits the kind are added as spans, where
   no base span overlaps.

One scan writes spans and candidates; the rounds work on distinct pattern-instance pairs with partial aggregation.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, saved, text_key

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 3
CONFIDENCE = 0.8
#: Instances that a pattern must have, what its confidence is damped by, and the confidence from which it votes.
SUPPORT, DAMPING, TRUST = 5, 1.0, 0.5
#: Decimals of a score: sums in any order round to the same.
PLACES = 9


@dataclass(frozen=True)
class Kind:
    #: A text without this letter (or digit, where none) can't match.
    needs: str
    pattern: str
    #: What a candidate of this kind must look like beyond its base form.
    shape: str


# Possessive quantifiers and the look-behind keep matching linear; neither changes what is found leftmost:
# a run that fails from its start fails from inside, and \G lets a match start where the last one ended.
_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"[0-9](?:[\x20-]?[0-9])++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"

SPEC = {
    "email": Kind("@", _EMAIL, r"^\S+@\S+$"),
    "ip": Kind("", _IP, r"^[0-9]{1,3}(?:\.[0-9]{1,3}){2,5}$"),
    "card": Kind("", _CARD, r"^(?:[\x20-]?[0-9]){10,24}$"),
    "phone": Kind("+", _PHONE, r"^[(+]?(?:[().\x20-]{0,3}[0-9]){7,15}$"),
}
_CANDIDATE = r"(?<![^\s(<\[,;:=\"'])(?:[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]++|[(+]?[0-9](?:[().\x20-]{0,3}+[0-9])++)(?![0-9A-Za-z])"


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(number: Column) -> Column:
    n = F.length(number)

    def add(acc: Column, i: Column) -> Column:
        d = F.substr(number, n - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return acc + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def passes(kind: str, match: Column) -> Column:
    """The test of a base match."""
    if kind == "ip":
        return match.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    if kind == "card":
        return F.when(F.length(digits(match)).between(12, 19), luhn(digits(match))).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits(match)).between(9, 15)
    return F.lit(True)


def _located(pieces: Column, matches: Column, keep, value) -> Column:
    """Of each match that keep(match) allows: value(start, end, match, piece before, piece after)."""
    item = F.zip_with(F.zip_with(matches, F.slice(pieces, 1, F.size(matches)), lambda m, p: F.struct(m.alias("m"), p.alias("before"))), F.slice(pieces, 2, F.size(matches)), lambda x, p: F.struct(x["m"].alias("m"), x["before"].alias("before"), p.alias("after")))
    none = F.lit(0).cast("long")
    blank = F.filter(F.array(value(none, none, F.lit(""), F.lit(""), F.lit(""))), lambda _: F.lit(False))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["before"])
        end = start + F.length(x["m"])
        new = F.array(value(start, end, x["m"], x["before"], x["after"]))
        return F.struct(end.alias("at"), F.when(keep(x["m"]), F.concat(acc["out"], new)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(item, F.struct(none.alias("at"), blank.alias("out")), step, lambda acc: acc["out"])


def _parts(name: str, text: Column, pattern: str, worth: Column) -> list[Column]:
    """The matches and the pieces around them; none, where the text isn't worth looking at."""
    return [
        F.when(worth, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>")).alias(f"m_{name}"),
        F.when(worth, F.split(text, pattern, -1)).otherwise(F.array().cast("array<string>")).alias(f"p_{name}"),
    ]


def _span(kind: str):
    return lambda start, end, m, before, after: F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("no"), end.alias("end"))


def _candidate(start: Column, end: Column, m: Column, before: Column, after: Column) -> Column:
    left = F.split(F.rtrim(F.lower(F.regexp_replace(before, r"\s", " "))), " +")
    right = F.split(F.ltrim(F.lower(F.regexp_replace(after, r"\s", " "))), " +", 2)
    one, two, on = F.element_at(left, -1), F.try_element_at(left, F.lit(-2)), F.element_at(right, 1)
    word = lambda c: c.rlike(r"\p{L}")
    pattern = lambda name, lexical, *c: F.when(lexical, F.concat(F.lit(name), F.concat_ws(" ", *c)))
    found = F.array(pattern("1<", word(one), one), pattern("2<", word(one) & (F.coalesce(two, F.lit("")) != ""), two, one), pattern("1>", word(on), on))
    return F.struct(start.alias("start"), end.alias("end"), m.alias("instance"), F.array_compact(found).alias("patterns"))


def spans_and_candidates(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, k_text, base (start, no, end by kind), candidates; one scan of the texts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(docs[id_col].alias("doc_id"), text_key(docs[text_col]).alias("k_text"), docs[text_col].alias("text"))
    number = text.rlike("[0-9]")
    worth = {k: F.contains(text, F.lit(s.needs)) if s.needs else number for k, s in SPEC.items()}
    parts = [c for k in KINDS for c in _parts(k, text, SPEC[k].pattern, worth[k])]
    rows = rows.select("doc_id", "k_text", *parts, *_parts("any", text, _CANDIDATE, number | F.contains(text, F.lit("@"))))
    test = lambda k: lambda m: passes(k, m)
    base = [_located(F.col(f"p_{k}"), F.col(f"m_{k}"), test(k), _span(k)) for k in KINDS]
    often = lambda m: m.contains("@") | (F.length(digits(m)) >= 7)
    return rows.select("doc_id", "k_text", F.array_sort(F.concat(*base)).alias("base"), _located(F.col("p_any"), F.col("m_any"), often, _candidate).alias("candidates"))


def learn(found: DataFrame, *, rounds: int = ROUNDS, confidence: float = CONFIDENCE, support: int = SUPPORT, trust: float = TRUST) -> DataFrame:
    """instance, kind: candidate texts that the patterns vouch for and that aren't seeds.

    found: with an array of candidates a row.  Repeated occurrences are one edge of the graph.  An instance can only be
    of a kind whose shape it has.
    """
    edges = found.select(F.explode("candidates").alias("c")).select(F.explode("c.patterns").alias("pattern"), F.col("c.instance").alias("instance")).distinct()
    edges = saved(edges, "edges")
    whole = lambda k: F.col("instance").rlike(f"^(?:{SPEC[k].pattern})$") & passes(k, F.col("instance"))
    zero = F.lit(0.0)
    instances = edges.select("instance").distinct().select("instance", *[F.when(whole(k), 1.0).otherwise(zero).alias(f"seed_{k}") for k in KINDS])
    instances = saved(instances, "instances")
    scores = instances.select(F.col("instance").alias("i"), *[F.col(f"seed_{k}").alias(k) for k in KINDS])
    exactly = lambda c: F.round(c, PLACES)
    for _ in range(rounds):
        scored = edges.join(scores, edges["instance"] == scores["i"]).groupBy("pattern").agg(F.count("*").alias("n"), *[exactly(F.sum(k)).alias(k) for k in KINDS]).where(F.col("n") >= support)
        sure = lambda k: F.col(k) / (F.col("n") + DAMPING)
        vouch = scored.select(F.col("pattern").alias("p"), *[F.when(sure(k) >= trust, sure(k)).otherwise(zero).alias(k) for k in KINDS]).where(F.greatest(*KINDS) > 0)
        voted = edges.join(vouch, edges["pattern"] == vouch["p"]).groupBy("instance").agg(*[exactly(1 - F.exp(F.sum(F.log1p(-F.col(k))))).alias(k) for k in KINDS])
        voted = voted.select(F.col("instance").alias("v"), *KINDS)
        new = instances.join(voted, instances["instance"] == voted["v"], "left")
        before = scores
        shaped = [F.when(F.col("instance").rlike(SPEC[k].shape), F.coalesce(k, zero)).otherwise(zero) for k in KINDS]
        scores = saved(new.select(F.col("instance").alias("i"), *[F.greatest(f"seed_{k}", s).alias(k) for k, s in zip(KINDS, shaped, strict=True)]), "scores")
        forget(before)
    best = F.greatest(*KINDS)
    kind = F.coalesce(*[F.when((F.col(k) == best) & F.col("i").rlike(SPEC[k].shape), F.lit(k)) for k in KINDS])
    seeds = instances.select(F.col("instance").alias("s"), F.greatest(*[f"seed_{k}" for k in KINDS]).alias("seed"))
    told = scores.where(best >= confidence).select("i", kind.alias("kind")).where("kind is not null")
    return told.join(seeds, told["i"] == seeds["s"]).where("seed = 0").select(F.col("i").alias("instance"), "kind")


def find_personal_data(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """A row for each document row: doc_id, base and added (arrays of start, no, end; code points, end exclusive).

    no: the place of the kind in KINDS; added spans have that of their kind plus len(KINDS).  A null text is empty
    and has none.  Without seeds nothing is added.  Rows equal in id and text get the same answer.
    """
    found = saved(spans_and_candidates(docs, id_col, text_col), "spans")
    told = learn(found, **options)
    each = found.select(F.col("doc_id").alias("d"), F.col("k_text").alias("k"), "base", F.explode("candidates").alias("c"))
    clear = ~F.exists("base", lambda b: (b["start"] < F.col("c.end")) & (F.col("c.start") < b["end"]))
    hits = each.where(clear).join(told, F.col("c.instance") == told["instance"])
    no = F.coalesce(*[F.when(F.col("kind") == k, F.lit(i + len(KINDS))) for i, k in enumerate(KINDS)])
    added = hits.groupBy("d", "k").agg(F.array_sort(F.collect_set(F.struct(F.col("c.start").alias("start"), no.alias("no"), F.col("c.end").alias("end")))).alias("added"))
    joined = found.join(added, found["doc_id"].eqNullSafe(added["d"]) & (found["k_text"] == added["k"]), "left")
    return joined.select("doc_id", "base", F.coalesce("added", F.array().cast("array<struct<start:long,no:int,end:long>>")).alias("added"))


NAMES = (*KINDS, *(f"context_{k}" for k in KINDS))


def listed(spans: Column) -> Column:
    """kind:start:end by start, then kind, comma-joined."""
    names = F.array(*[F.lit(n) for n in NAMES])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["no"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    of = lambda i: F.size(F.filter("base", lambda s: s["no"] == i)).cast("long")
    counts = [of(i).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.concat("base", "added")).alias("spans"))
