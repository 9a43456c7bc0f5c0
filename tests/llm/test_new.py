"""Operators 11 to 13 against brute force in plain Python and SQL, and their defined cases."""

import collections
import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm import DOCS, HARD

from inkwell.llm import ball_kmeans, crc_resampling, quality_rules, queries

DATA = "/root/testdata/sf0.001"


def corpus(spark):
    """Hard texts, each twice, some under no id, with columns whose names the operators use."""
    long = " ".join(f"word{i % 977} of{i % 31}" for i in range(70_000))
    rows = [(i, t) for i, t in enumerate(HARD)] * 2 + [(None, HARD[8]), (None, None), (500, long), (501, "A b-c\nA b-c\n\n x y z " * 3), (502, "GÖTZ ß #1 | a|b\r\nd e")]
    return spark.createDataFrame([(i, t, "en", None, None, 0.5, 1, "x", 7, "k") for i, t in rows], DOCS).repartition(3)


# 11


def plain_kmeans(rows, k, rounds, size, scale, seed):
    """Every vector against every centroid, in Python's integers."""
    vectors = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    turn = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in vectors if i is not None)
    centroids = [v for _, v in turn[:k]]
    if not centroids:
        return []

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids)) for _, v in vectors]

    for _ in range(rounds):
        where = assign()
        for j in range(len(centroids)):
            own = [v for (_, v), (_, c) in zip(vectors, where, strict=True) if c == j]
            if own:
                centroids[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    where = assign()
    inertia = collections.Counter()
    for d, j in where:
        inertia[j] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return [(i, j, d, inertia[j], sum(inertia.values()), sha[j]) for (i, _), (d, j) in zip(vectors, where, strict=True)]


def test_clusters_match_sql(spark):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{DATA}/embeddings.parquet'")
    got = queries.op11_ball_kmeans(spark, DATA)
    order = "vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256"
    assert sorted(map(tuple, got.select(order.split(", ")).collect())) == sorted(c.execute(f"SELECT {order} FROM ({queries.oracle_sql()['op11_ball_kmeans']})").fetchall())


@pytest.mark.parametrize("seed", range(4))
def test_clusters_match_every_comparison(spark, seed):
    """Few integers, so that distances tie; groups of copies; rows that don't count."""
    rng = np.random.default_rng(seed)
    size, k = (3, 5) if seed % 2 else (2, 16)
    rows = [(i, (rng.integers(-4, 5, size) / 4 + rng.integers(0, 3) * (seed > 1) * 8).tolist()) for i in range(300)]
    rows += [(7, rows[7][1])] * 40 + [(None, rows[3][1]), (900, None), (901, [1.0]), (902, [None] * size), (903, [float("nan")] * size), (904, [float("inf")] + [0.0] * (size - 1)), (905, [])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster string").repartition(3)
    found = ball_kmeans.digests(ball_kmeans.fit(df, k=k, rounds=4, size=size, scale=4, seed=seed)).collect()
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(map(tuple, found), key=key) == sorted(plain_kmeans(rows, k, 4, size, 4, seed), key=key)


def test_cores_and_annuli_leave_out_comparisons():
    """Far balls have no neighbours, resting ones are not looked at, annuli name the centroids in reach."""
    centroids = np.array([[0, 0], [10, 0], [1000, 0]])
    balls = ball_kmeans.Balls.of(centroids, np.array([6.0, 4.0, 50.0]), np.array([True, False, False]))
    assert [o.tolist() for o in balls.others] == [[1], [], []]
    assert balls.still.tolist() == [False, True, True]
    v = np.array([[4, 0], [5, 0], [6, 0], [10, 1], [990, 0]])
    cluster, distance = balls.assign(v, np.array([0, 0, 0, 1, 2]), np.array([0, 0, 0, 1, 77]))
    assert cluster.tolist() == [0, 0, 1, 1, 2] and distance.tolist() == [16, 25, 16, 1, 77]


def test_clusters_of_odd_tables(spark):
    kind = "vec_id long, embedding array<float>"
    empty = ball_kmeans.digests(ball_kmeans.fit(spark.createDataFrame([], kind)))
    assert empty.count() == 0 and empty.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert ball_kmeans.digests(ball_kmeans.fit(spark.createDataFrame([(None, [1.0])], kind), size=1)).count() == 0
    one = ball_kmeans.digests(ball_kmeans.fit(spark.createDataFrame([(3, [-0.01])], kind), size=1)).collect()
    assert [tuple(r) for r in one] == [(3, 0, 0, 0, 0, hashlib.sha256(b"-1").hexdigest())]
    with pytest.raises(Exception, match="not below"):
        ball_kmeans.digests(ball_kmeans.fit(spark.createDataFrame([(3, [1e9])], kind), size=1)).collect()


# 12


def plain_counts(text):
    """The counts of operator 12 by strings and dictionaries."""
    text = text or ""
    space = "\x20\t\n\x0b\x0c\r"
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen, covered = collections.Counter(windows), set()
    for i, w in enumerate(windows):
        if seen[w] > 1:
            covered.update(range(i, i + 5))
    lines = [x for x in text.split("\n") if x.strip(space)]
    letter = lambda c: c.isascii() and c.isalpha()
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered), "n_lines": len(lines), "n_letters": sum(map(letter, text)), "n_capitals": sum(letter(c) and c.isupper() for c in text),
        "n_unlettered": sum(not any(letter(c) or not c.isascii() for c in w) for w in words), "n_stutters": sum(a == b for a, b in zip(words, words[1:], strict=False)),
        "n_ends": sum(w[-1] in ".?!" for w in words),
    }


def plain_em(patterns, m):
    """The same estimation, text by text and class by class."""
    q = quality_rules
    shares = [q.BELIEF_GOOD] + [(1 - q.BELIEF_GOOD) / m] * m
    belief = [[q.MOST_WRONG] * m] + [[q.BELIEF_OWN if j == k else q.BELIEF_OTHER for j in range(m)] for k in range(m)]
    first, bad = shares, belief

    def classes(p):
        out = [shares[k] * math.prod(bad[k][j] if v == "-" else 1 - bad[k][j] for j, v in enumerate(p) if v != "0") for k in range(m + 1)]
        return [x / sum(out) for x in out]

    for _ in range(200):
        found = [(p, n, classes(p)) for p, n in collections.Counter(patterns).items()]
        shares = [(sum(n * c[k] for _, n, c in found) + q.BELIEF_TEXTS * first[k]) / (len(patterns) + q.BELIEF_TEXTS) for k in range(m + 1)]
        bad = [
            [(sum(n * c[k] for p, n, c in found if p[j] == "-") + q.BELIEF_TEXTS * belief[k][j]) / (sum(n * c[k] for p, n, c in found if p[j] != "0") + q.BELIEF_TEXTS) for j in range(m)]
            for k in range(m + 1)
        ]
        bad[0] = [min(x, q.MOST_WRONG) for x in bad[0]]
        for k in range(m):
            bad[k + 1][k] = max(bad[k + 1][k], q.LEAST_OWN)
    return {p: classes(p)[0] for p in set(patterns)}


def test_counts_match_plain_ones(spark):
    r = random.Random(5)
    words = ["a", "b", "Éa", "#x", "a\n", "\n", "\r\n", "\x0b", "1", "end.", "CAP", "日本", "w" * 300, "w" * 299 + "v"]
    texts = ["".join(r.choice(words) + r.choice([" ", " ", "", "\n"]) for _ in range(r.randrange(120))) for _ in range(300)]
    texts += [f"{t}\n" for t in HARD if t] + ["\n", "\na", "a\n\na", "a b c d e a b c d e", "a a a a a a", "l" * 300 + "\n" + "l" * 300]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    for row in quality_rules.counts(df).collect():
        assert row.asDict() == {"doc_id": row.doc_id} | plain_counts(texts[row.doc_id])


def test_weak_rules_match_brute_force(spark):
    df = corpus(spark).select("doc_id", "text").unionAll(spark.read.parquet(f"{DATA}/documents.parquet").select(F.col("doc_id") + 1000, "text"))
    rows, texts = quality_rules.judge(df).collect(), {r.doc_id: r.text for r in df.where("doc_id is not null").collect()}
    assert len(rows) == df.count()
    posterior = plain_em([r.votes for r in rows], len(quality_rules.RULES))
    for r in rows:
        if r.doc_id is not None:
            own = plain_counts(texts[r.doc_id])
            assert {c: r[c] for c in own} == own
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert r.posterior == pytest.approx(posterior[r.votes], abs=1e-3)
        assert r.kept == (not r.base_failed and r.posterior >= 0.5)


def test_estimates_find_shares_and_accuracies():
    """Votes drawn from known classes give these back."""
    rng = np.random.default_rng(1)
    n, m, shares = 200_000, 5, np.array([0.75, 0.1, 0.02, 0.06, 0.03, 0.04])
    bad = rng.uniform(0.02, 0.2, (m + 1, m))
    bad[0] = 0.003
    bad[np.arange(1, m + 1), np.arange(m)] = [0.95, 0.8, 0.9, 0.99, 0.9]
    y = rng.choice(m + 1, n, p=shares)
    votes = np.where(rng.random((n, m)) < 0.2, "0", np.where(rng.random((n, m)) < bad[y], "-", "+"))
    names = ["".join(v) for v in votes.tolist()]
    model = quality_rules.estimate(collections.Counter(names), m)
    assert abs(model.shares[0] - 0.75) < 0.03 and model.bad[0].max() <= quality_rules.MOST_WRONG
    order = sorted(set(names))
    good = dict(zip(order, model.posterior(order), strict=True))
    seen = (votes == "-").any(1)
    assert np.mean([(good[p] >= 0.5) == (c == 0) for p, c in zip(names, y, strict=True)]) > 0.94
    assert np.mean([good[p] < 0.5 for p, c, s in zip(names, y, seen, strict=True) if s and c]) > 0.95


def test_rules_agree_with_labels_they_never_saw(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op12_weak_rules(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("not base_failed").collect()
    assert np.mean([r.kept for r in rows if r.quality == 1]) > 0.98
    assert np.mean([r.kept for r in rows if r.quality == 0]) < 0.2


def test_rules_of_odd_tables(spark):
    assert quality_rules.judge(spark.createDataFrame([], DOCS)).count() == 0
    assert quality_rules.estimate({}).shares[0] == pytest.approx(quality_rules.BELIEF_GOOD)
    rows = quality_rules.judge(corpus(spark)).collect()
    assert len(rows) == 2 * len(HARD) + 5 and all(0 <= r.posterior <= 1 for r in rows)


# 13


def plain_features(text, n):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return words, [" ".join(words[i : i + k]) for i in range(len(words)) for k in range(1, n + 1) if i + k <= len(words)]


def plain_resample(documents, targets, n, buckets, percent, least, seed):
    s, t = collections.Counter(), collections.Counter()
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    for _, text in documents:
        s.update(map(bucket, plain_features(text, n)[1]))
    for text in targets:
        t.update(map(bucket, plain_features(text, n)[1]))
    whole, aimed = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (whole + buckets) / ((s[b] + 1) * (aimed + buckets)))) for b in range(buckets)]
    out, able = [], []
    for i, (doc_id, text) in enumerate(documents):
        words, features = plain_features(text, n)
        weight = sum(gain[bucket(f)] for f in features) // len(features) if features else 0
        score = None
        if doc_id is not None:
            h = int(hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
            if len(words) >= least:
                able.append((-score, doc_id, i))
        out.append([doc_id, len(features), weight, score, None, len(words)])
    for k, (_, _, i) in enumerate(sorted(able)[: percent * len(able) // 100], 1):
        out[i][4] = k
    return out


@pytest.mark.parametrize("n, piece", [(1, 1 << 20), (1, 7), (3, 1 << 20), (3, 7)])
def test_resampling_matches_brute_force(spark, monkeypatch, n, piece):
    monkeypatch.setattr(crc_resampling, "PIECE", piece)
    texts = [(r.doc_id, r.text[:600]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()] + [(1000 + i, t) for i, t in enumerate(HARD)] + [(None, HARD[8]), (None, None)]
    benchmark = [r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()] + [None, ""]
    df = spark.createDataFrame([(i, t, 5, "x") for i, t in texts], "doc_id long, text string, n_words int, rank string").repartition(3)
    target = spark.createDataFrame([(None, t, 1) for t in benchmark], "item_id long, text string, doc_id long")
    got = crc_resampling.resample(df, target, n=n, buckets=500, percent=30, least_words=20)
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, plain_resample(texts, benchmark, n, 500, 30, 20, 2024)), key=key)


def test_long_words_and_pieces():
    for text in (b"", b" ", b"A" * 50 + b" b" * 40, b"ab " * 30 + b"c" * 100 + b" d", "é".encode() * 90):
        assert b" ".join(p.strip() for p in crc_resampling.pieces(text)).split() == text.translate(crc_resampling.WORD_BYTES).split()


def test_draws_of_repeated_rows(spark):
    """Rows of one id tie to the last: each has a rank of its own, and no more are drawn than asked for."""
    text = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(i % 3, text) for i in range(300)] + [(9, "short")], "doc_id long, text string").repartition(5)
    rows = crc_resampling.resample(df, spark.createDataFrame([(1, "w1 w2")], "item_id long, text string")).collect()
    assert len(rows) == 301 and sorted(r.rank for r in rows if r.rank) == list(range(1, 31))
    assert len({r.doc_id for r in rows if r.rank}) == 1
    empty = crc_resampling.resample(df.where("doc_id > 100"), df.select(F.col("doc_id").alias("item_id"), "text"))
    assert empty.count() == 0
