"""Toxicity, quality, nearest vectors: held-out accuracy, exactness of the index, recall, and the odd rows."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from screenpulse.llm import ann, quality, toxicity
from screenpulse.llm.queries import QUERIES

TENTH = "/root/testdata/sf0.1"


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


# --- toxicity

def sparse(dicts):
    start = np.r_[0, np.cumsum([len(d) for d in dicts])]
    return toxicity.Vectors(start, np.array([t for d in dicts for t in sorted(d)], np.int32), np.array([d[t] for d in dicts for t in sorted(d)], float))


@pytest.mark.parametrize(("dense", "first"), [(0, 20), (4, 20), (4, 10_000), (60, 0)])
def test_block_max_search_is_exact(monkeypatch, dense, first):
    monkeypatch.setattr(toxicity, "FIRST_POSTINGS", first)
    rng = random.Random(2)
    found = []
    for _ in range(500):
        v = {t: rng.random() ** 3 + 0.01 for t in rng.sample(range(40), rng.randint(1, 6))}
        n = math.sqrt(sum(x * x for x in v.values()))
        found.append({t: x / n for t, x in v.items()})
    found += found[:60]
    index = toxicity.BlockMaxIndex(sparse(found), 60, block=16, dense=dense)
    asked = [*found[:120], {55: 1.0}, {}]
    skipped = 0
    arrays = [(np.array(sorted(q), np.int64), np.array([q[t] for t in sorted(q)], float)) for q in asked]
    for q, (near, cosine, scored) in zip(asked, index.search_all(arrays, 10), strict=True):
        want = sorted((-sum(w * q.get(t, 0) for t, w in v.items()), e) for e, v in enumerate(found))
        want = [(e, -s) for s, e in want if s < 0][:10]
        skipped += scored < 200
        assert [round(s, 9) for s in cosine.tolist()] == [round(s, 9) for _, s in want]
        assert {e for e, s in zip(near.tolist(), cosine.tolist(), strict=True) if s > want[-1][1] + 1e-9} == {e for e, s in want if s > want[-1][1] + 1e-9} if want else not len(near)
    assert skipped > 60


def brute_toxicity(docs, labels, k=25):
    """{doc_id: score}, in plain Python: every vector against every example."""
    import hashlib

    count = lambda t: Counter(re.findall(r"[^\W\d_]+", (t or "").lower()))
    train = {d: y for d, y in labels.items() if zlib.crc32(str(d).encode()) % 3 != 1}
    texts = dict(docs)
    seen = {d: count(texts[d]) for d in sorted(train)}
    vocabulary = sorted({t for v in seen.values() for t in v})
    place = {t: i for i, t in enumerate(vocabulary)}
    df = Counter(t for _, x in docs for t in count(x) if t in place)
    idf = {t: math.log((1 + len(docs)) / (1 + df[t])) + 1 for t in vocabulary}
    groups = defaultdict(list)
    for d, v in seen.items():
        terms = sorted(v, key=place.__getitem__)
        groups[hashlib.blake2b(np.array([place[t] for t in terms], np.int32).tobytes() + np.array([v[t] for t in terms], float).tobytes(), digest_size=16).digest()].append(d)
    members = [groups[g] for g in sorted(groups)]

    def voters(some):
        mine = [(seen[m[0]], sum(train[d] for d in m), len(m)) for m in some]
        total = [sum(x[i] for x in mine) for i in (1, 2)]
        none = [sum(x[i] for x in mine if not x[0]) for i in (1, 2)]
        prior = (none[0] + total[0] / total[1]) / (none[1] + 1)
        full = [x for x in mine if x[0]]
        toxic = [x[1] / x[2] >= 0.5 for x in full]
        n, n1 = len(full), sum(toxic)
        weight = {}
        for t in vocabulary:
            a, c = sum(y and t in x[0] for x, y in zip(full, toxic, strict=True)), sum(not y and t in x[0] for x, y in zip(full, toxic, strict=True))
            table = [(a, a + c, n1), (c, a + c, n - n1), (n1 - a, n - a - c, n1), (n - n1 - c, n - a - c, n - n1)]
            g = 2 * sum(o * math.log(o * n / (r * q)) for o, r, q in table if o)
            odds = math.log((a + 0.5) / (n1 - a + 0.5)) - math.log((c + 0.5) / (n - n1 - c + 0.5))
            weight[t] = idf[t] * max(0.01, math.sqrt(max(g, 0)) * abs(odds))

        def unit(v):
            w = {t: (1 + math.log(n)) * weight[t] for t, n in v.items() if t in weight}
            norm = math.sqrt(sum(x * x for x in w.values()))
            return {t: x / norm for t, x in w.items()}

        vectors = [unit(x[0]) for x in full]

        def vote(v):
            q = unit({t: n for t, n in v.items() if t in place})
            if not q:
                return prior
            near = sorted(((sum(w * q.get(t, 0.0) for t, w in u.items()), -e) for e, u in enumerate(vectors)), reverse=True)[:k]
            return (sum(c * c * full[-e][1] for c, e in near) + 0.1 * prior) / (sum(c * c * full[-e][2] for c, e in near) + 0.1)

        return vote

    odds = lambda p: math.log(min(max(p, 1e-4), 1 - 1e-4) / (1 - min(max(p, 1e-4), 1 - 1e-4)))
    raw = [0.0] * len(members)
    for side in (0, 1):
        vote = voters([m for i, m in enumerate(members) if i % 2 != side])
        for i in range(side, len(members), 2):
            raw[i] = vote(seen[members[i][0]])
    slope, offset = toxicity.calibration(np.array(raw), np.array([sum(train[d] for d in m) for m in members], float), np.array([len(m) for m in members], float))
    vote = voters(members)
    return {d: 1 / (1 + math.exp(-(slope * odds(vote(count(t))) + offset))) for d, t in docs}


def test_toxicity_is_the_plain_version(spark):
    """The whole query against every pair; the sample holds all labels here, so each weighs the same."""
    folder = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"]) for r in rows(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text"))]
    labels = {r["doc_id"]: r["toxic"] for r in rows(spark.read.parquet(f"{folder}/labels.parquet"))}
    want = brute_toxicity(docs, labels)
    got = rows(QUERIES["op1_toxicity"](spark, folder))
    assert len(got) == len(docs) and len({round(s, 3) for s in want.values()}) > 20
    for r in got:
        assert r["score"] == pytest.approx(want[r["doc_id"]], abs=1e-6) and r["predicted"] == int(r["score"] >= 0.7)
    words = {w for d, t in docs if d in labels and zlib.crc32(str(d).encode()) % 3 != 1 for w in toxicity.terms_of(t)}
    assert all(r["evidence"] for r in got if words & set(toxicity.terms_of(dict(docs)[r["doc_id"]])))


def test_calibration_is_a_rising_curve():
    rng = np.random.default_rng(0)
    vote = rng.random(4000)
    truth = 1 / (1 + np.exp(-(2.5 * np.log(vote / (1 - vote)) - 1)))
    slope, offset = toxicity.calibration(vote, (rng.random(4000) < truth).astype(float), np.ones(4000))
    assert abs(slope - 2.5) < 0.3 and abs(offset + 1) < 0.3
    assert toxicity.calibration(vote, np.zeros(4000), np.ones(4000)) == (1.0, 0.0)


def test_held_out_rows(spark):
    df = spark.createDataFrame([(i,) for i in range(200)] + [(None,)], "doc_id long")
    got = {r["doc_id"]: r["h"] for r in rows(df.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("h")))}
    assert got == {**{i: zlib.crc32(str(i).encode()) % 3 == 1 for i in range(200)}, None: False}


def test_toxicity_on_held_out_documents(spark):
    got = {r["doc_id"]: r for r in rows(QUERIES["op1_toxicity"](spark, TENTH).drop("evidence"))}
    labels = rows(spark.read.parquet(f"{TENTH}/labels.parquet"))
    mine = [(got[r["doc_id"]], r["toxic"]) for r in labels if got[r["doc_id"]]["held_out"]]
    toxic, clean = [g for g, y in mine if y], [g for g, y in mine if not y]
    assert len(got) == 10_000 and len(toxic) > 80
    assert sum(g["predicted"] for g in toxic) / len(toxic) > 0.83
    assert sum(g["predicted"] for g in clean) / len(clean) < 0.01
    # calibrated: among documents of a score, about that share is toxic
    every = sorted(((g["score"], y) for g, y in mine))
    for low, high in ((0.0, 0.1), (0.1, 0.7), (0.7, 1.0)):
        some = [(p, y) for p, y in every if low <= p <= high]
        said, real, n = np.mean([p for p, _ in some]), np.mean([y for _, y in some]), len(some)
        assert n >= 10 and abs(said - real) < 0.03 + 2 * math.sqrt(real * (1 - real) / n)
    order = sum((a["score"] > b["score"]) + 0.5 * (a["score"] == b["score"]) for a in toxic for b in clean)
    assert order / len(toxic) / len(clean) > 0.9


def test_rare_terms_of_a_small_sample_have_weight(spark):
    texts = [f"plain words{chr(97 + i % 20)} here" for i in range(40)] + ["plain vileword here", "plain foulword here"]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(100, "vileword"), (101, "foulword")], "doc_id long, text string")
    train = [i for i in range(42) if zlib.crc32(str(i).encode()) % 3 != 1]
    labels = spark.createDataFrame([(i, int(i >= 40)) for i in train], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in rows(toxicity.score_toxicity(docs, labels))}
    toxic = [i for i in train if i >= 40]
    assert toxic and all([n["doc_id"] for n in got[60 + i]["neighbours"]] == [i] and got[60 + i]["score"] > max(got[j]["score"] for j in range(40)) for i in toxic)


def test_toxicity_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(i, i % 2, "x") for i in (4, 6, 7, 10, 20)] + [(4, 1, "x"), (None, 1, "x"), (5, None, "x")], "doc_id long, toxic int, text string")
    got = rows(toxicity.score_toxicity(odd, labels))
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
    assert {round(r["score"], 3) for r in rows(toxicity.score_toxicity(odd, labels.limit(0)))} == {0.0}
    assert toxicity.score_toxicity(none, labels).count() == 0


# --- quality

def test_quality_on_held_out_documents(spark):
    got = {r["doc_id"]: r for r in rows(QUERIES["op5_quality"](spark, TENTH))}
    out = [(got[r["doc_id"]]["keep"], r["quality"]) for r in rows(spark.read.parquet(f"{TENTH}/labels.parquet")) if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    good, bad = [k for k, q in out if q], [k for k, q in out if not q]
    assert sum(good) / len(good) > 0.99 and sum(bad) / len(bad) < 0.05


def brute_quality(docs, labels):
    """{doc_id: (evidence, host, path, score)} in numpy; docs: (doc_id, text, host, path)."""
    train = sorted((str(d), y) for d, y in labels.items() if zlib.crc32(str(d).encode()) % 3 != 1)
    texts = {str(d): t for d, t, _, _ in docs}
    x, y = np.array([quality.features(texts[d]) for d, _ in train]), np.array([float(y) for _, y in train])
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9

    def design(x):
        z = np.clip((x - mean) / scale, -6, 6)
        return np.c_[np.ones(len(z)), z, z * z]

    z, beta = design(x), np.zeros(2 * x.shape[1] + 1)
    ridge = np.r_[1e-6, np.ones(len(beta) - 1)]
    for _ in range(2000):  # gradient steps of a fixed bound instead of Newton's
        p = 1 / (1 + np.exp(-z @ beta))
        w = p * (1 - p)
        beta += np.linalg.solve((z.T * w) @ z + np.diag(ridge), z.T @ (y - p) - ridge * beta) * 0.5
    p = 1 / (1 + np.exp(-np.clip(design(np.array([quality.features(t) for _, t, _, _ in docs])) @ beta, -30, 30)))
    hosts, paths = [h for _, _, h, _ in docs], [(h, q) for _, _, h, q in docs]
    n, total = len(docs), p.sum()
    noise = total / n * (1 - total / n)

    def strength(groups, parents):
        sizes = np.array([len(g) for g in groups])
        q = sum(len(g) * (p[g].mean() - m) ** 2 for g, m in zip(groups, parents, strict=True))
        room = n - (sizes**2).sum() / n
        between = (q - (len(groups) - 1) * noise) / room if room > 0 else 0
        return max(1.0, noise / between - 1) if between > 0 else math.inf

    member = lambda keys: {k: np.array([i for i, x in enumerate(keys) if x == k]) for k in dict.fromkeys(keys)}
    shrunk = lambda s, m, parent, k: parent if math.isinf(k) else (s + k * parent) / (m + k)
    by_host, by_path = member(hosts), member(paths)
    hk = strength(list(by_host.values()), [total / n] * len(by_host))
    pk = strength(list(by_path.values()), [shrunk(p[by_host[h]].sum(), len(by_host[h]), total / n, hk) for h, _ in by_path])
    out = {}
    logit = lambda x: math.log(min(max(x, 1e-6), 1 - 1e-6) / (1 - min(max(x, 1e-6), 1 - 1e-6)))
    for i, (d, _, h, q) in enumerate(docs):
        corpus = (total - p[i]) / (n - 1)
        rest = lambda g: (p[g].sum() - p[i], len(g) - 1)
        host = shrunk(*rest(by_host[h]), corpus, hk)
        path = shrunk(*rest(by_path[h, q]), host, pk)
        out[d] = (p[i], host, path, 1 / (1 + math.exp(-(logit(p[i]) + logit(path) - logit(corpus)))))
    return out


def test_quality_is_the_plain_version(spark, small, folder):
    docs = [(r["doc_id"], r["text"], r["source"], r["lang"]) for r in rows(small)]
    want = brute_quality(docs, {r["doc_id"]: r["quality"] for r in rows(spark.read.parquet(f"{folder}/labels.parquet"))})
    got = rows(QUERIES["op5_quality"](spark, folder))
    assert len(got) == len(docs)
    for r in got:
        assert (r["evidence"], r["host_posterior"], r["path_posterior"], r["score"]) == pytest.approx(want[r["doc_id"]], abs=1e-5)
        assert r["keep"] == (r["score"] >= 0.5)


def test_a_site_moves_its_documents_and_a_document_not_itself(spark):
    rng = random.Random(4)
    data = [("good", "a", min(1.0, max(0.0, rng.gauss(0.9, 0.05)))) for _ in range(400)] + [("bad", "a", 0.1 + 0.01 * (i % 5)) for i in range(300)]
    data += [("good", "b", 0.0), ("tiny", "a", 0.45), (None, "a", 0.5), ("bad", "a", 0.55), ("good", "a", 0.45)]
    df = spark.createDataFrame(data, "host string, path string, p double")
    site = quality.sites(df)
    site = site.select(*[F.col(c).alias(f"s_{c}") if c in ("host", "path") else F.col(c) for c in site.columns])
    both = df.join(site, df["host"].eqNullSafe(site["s_host"]) & (df["path"] == site["s_path"])).withColumns(quality.posteriors(F.col("p")))
    got = {(r["host"], r["path"], round(r["p"], 6)): r for r in rows(both.withColumn("score", quality._score(F.col("p"), F.col("corpus"), F.col("path_posterior"))))}
    assert both.count() == len(data)
    assert got["bad", "a", 0.55]["score"] < 0.5 < got["good", "a", 0.45]["score"]  # the site decides where evidence is weak
    alone = got["tiny", "a", 0.45]
    assert alone["path_posterior"] == pytest.approx(alone["corpus"]) and alone["score"] == pytest.approx(0.45)
    assert got["good", "b", 0.0]["path_posterior"] == pytest.approx(got["good", "b", 0.0]["host_posterior"])


def test_quality_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(i, i % 2) for i in (4, 6, 7, 10, 20)], "doc_id long, quality int")
    got = rows(quality.score_quality(odd, labels))
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
    kept = quality.drop_low_quality(odd, labels)
    assert kept.columns == odd.columns and kept.count() == sum(r["keep"] for r in got)
    assert all(r["evidence"] == 0.5 for r in rows(quality.score_quality(odd, labels.limit(0))))
    assert quality.score_quality(none, labels).count() == 0


# --- nearest vectors

@pytest.mark.parametrize("folder", ["/root/testdata/sf0.01", TENTH])
def test_recall(spark, folder):
    e = spark.read.parquet(f"{folder}/embeddings.parquet").toPandas()
    ids, v = e["vec_id"].to_numpy(), np.stack(e["embedding"]).astype(np.float64)
    want = ann.brute_force(ids, v, ids[ids % 20 == 0], 20)
    got: dict[int, list] = {}
    for r in sorted(rows(QUERIES["op8_nearest_vectors"](spark, folder)), key=lambda r: r["rank"]):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert set(got) == set(want) and all(len(x) == 20 for x in got.values())
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]) >= 0.95
    for q, found in got.items():
        assert found == sorted(found, key=lambda x: (-x[1], x[0]))
        assert all(abs(s - float(v[ids == q][0] @ v[ids == i][0])) < 1e-9 for i, s in found)


def test_vectors_that_take_no_part_and_ties(spark):
    nan, inf = float("nan"), float("inf")
    good = [(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(1, 60)]
    odd = [(0, [1.0, 2.0, 3.0]), (20, None), (40, [0.0, 0.0, 0.0]), (60, [nan, 1.0, 1.0]), (80, [inf, 1.0, 1.0]), (100, [None, 1.0, 1.0]), (120, []), (140, [1.0]), (141, [2.0]), (142, [-1.0]), (None, [1.0, 1.0, 1.0]), (160, [5.0, 5.0, 5.0])]
    good = [g for g in good if g[0] not in (20, 40)] + [(200 + i, [6.0, 1.0, 2.0]) for i in range(100)]
    df = spark.createDataFrame([(i, v, "x", "x") for i, v in good + odd], "vec_id long, embedding array<float>, id string, v string")
    part = [(i, np.array(v)) for i, v in good] + [(0, np.array([1.0, 2, 3])), (160, np.array([5.0, 5, 5]))]
    got: dict[int, list] = {}
    for r in sorted(rows(ann.nearest(df, F.col("id") % 20 == 0, share=1.0)), key=lambda r: r["rank"]):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    want = {q: sorted(((i, float((v * u).sum())) for i, u in part if i != q), key=lambda x: (-x[1], x[0]))[:20] for q, v in part if q % 20 == 0}
    want[140] = [(141, 2.0), (142, -1.0)]
    assert got == want
    assert ann.nearest(df.limit(0), F.col("id") % 20 == 0).count() == 0
    few = ann.nearest(df.where("vec_id in (0, 1, 2)"), F.col("id") % 20 == 0)
    assert [(r["query_id"], r["rank"]) for r in rows(few)] == [(0, 1), (0, 2)]
    blocks = ann.nearest(df, F.col("id") % 20 == 0, share=1.0, query_bytes=400)
    assert {(r["query_id"], r["vec_id"]) for r in rows(blocks)} == {(q, i) for q, x in want.items() for i, _ in x}


@pytest.mark.parametrize("noise", [0.01, 0.3])
def test_recall_with_a_third_of_near_copies(spark, noise):
    rng = np.random.default_rng(1)
    v = rng.standard_normal((10_256, 64))
    v /= np.linalg.norm(v, axis=1)[:, None]
    hot = rng.random(len(v)) < 1 / 3
    v[hot] = v[0] + noise / 8 * rng.standard_normal((hot.sum(), 64))
    ids = np.arange(len(v))
    want = ann.brute_force(ids, v, ids[ids % 40 == 0], 20)
    df = spark.createDataFrame([(int(i), x.tolist()) for i, x in zip(ids, v, strict=True)], "vec_id long, embedding array<double>")
    got: dict[int, set] = {}
    for r in rows(ann.nearest(df, F.col("id") % 40 == 0)):
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    recall = {q: len(got[q] & {i for i, _ in want[q]}) / 20 for q in want}
    for group in (True, False):
        assert np.mean([x for q, x in recall.items() if hot[q] == group]) >= 0.93
    assert min(recall.values()) >= 0.5


def test_neighbours_do_not_depend_on_partitions(spark):
    rng = np.random.default_rng(3)
    v = rng.standard_normal((3_000, 16))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    options = {"pivots": 128, "prefix": 24, "sample": 1_000, "least": 60, "share": 0.06}
    found = [sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in rows(ann.nearest(df.repartition(n), F.col("id") % 20 == 0, **options))) for n in (1, 3, 8)]
    assert found[0] == found[1] == found[2] and len(found[0]) == 150 * 20


def test_no_usable_vectors(spark):
    odd = spark.createDataFrame([(20, None), (40, [0.0, 0.0]), (60, [float("nan"), 1.0]), (None, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert ann.nearest(odd, F.col("id") % 20 == 0).count() == 0
    alone = spark.createDataFrame([(20, [1.0, 2.0]), (20, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert ann.nearest(alone, F.col("id") % 20 == 0).count() == 0


def test_most_vectors_are_not_scored():
    """On vectors without any structure, the worst case for an index."""
    rng = np.random.default_rng(4)
    v = rng.standard_normal((10_256, 64))
    v /= np.linalg.norm(v, axis=1)[:, None]
    ids = np.arange(len(v))
    some = rng.permutation(len(v))[:4_096]
    space = ann.Space(ids[some], v[some], len(v), 1.0, k=20, pivots=ann.PIVOTS, prefix=ann.PREFIX, share=ann.SHARE, least=ann.LEAST, alike=ann.ALIKE)
    block = space.block(ids, v)
    recall, scored, opened = [], [], []
    for q in range(0, len(v), 100):
        pivots, bar, low = space.ask(q, v[q])
        near, _ = block.best(q, v[q], pivots, bar, low, 20)
        want = {i for i, _ in ann.brute_force(ids, v, ids[q : q + 1], 20)[q]}
        recall.append(len(want & set(near.tolist())) / 20)
        scored.append(len(block.candidates(pivots, bar)) / len(v))
        opened.append((block.files[pivots + 1] - block.files[pivots]).sum() / len(v))
    assert np.mean(recall) >= 0.93 and np.mean(scored) < 0.16 and np.mean(opened) < 6
