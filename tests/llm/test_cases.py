"""Cases every operator has a stated result for: repeated rows, null ids, one very long text, clashing names; and the links of planted pairs."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm import DOCS, HARD

from inkwell.llm import crf_language, kd_shards, kneser_ney, knn_quality, latent_leaks, lattice_dedup, queries, sentencepiece_bpe, shingle_sets, simhash, suffix_dedup

DATA = "/root/testdata/sf0.001"
LONG = " ".join(f"word{i % 977} of{i % 31}" for i in range(70_000))  # about a million bytes


@pytest.fixture(scope="module")
def table(spark):
    """Hard texts, each twice under its id, two of them under no id, and a text of a megabyte."""
    rows = [(i, t) for i, t in enumerate(HARD)] * 2 + [(None, HARD[8]), (None, None), (500, LONG)]
    return spark.createDataFrame([(i, t, "en" if (i or 0) % 2 else "fr", None, None, 0.5, 1, "x", 7, "k") for i, t in rows], DOCS).repartition(3)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def language(df, documents):
    return crf_language.predict(df, crf_language.train(documents, queries.remainder(4) != 2))


def quality(df, documents):
    return knn_quality.score(df, knn_quality.train(documents, df.sparkSession.read.parquet(f"{DATA}/labels.parquet"), F.lit(True)))


OPERATORS = {
    "op1": language,
    "op2": quality,
    "op4": lambda df, documents: kneser_ney.score(df, kneser_ney.train(df, F.lit(True))),
    "op5": lambda df, documents: suffix_dedup.digests(suffix_dedup.remove(df)),
    "op7": lambda df, documents: simhash.digests(simhash.near_duplicates(df)),
    "op10": lambda df, documents: sentencepiece_bpe.digests(sentencepiece_bpe.encode_decode(df, queries.tokenizer())),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_repeated_rows_and_a_very_long_text(table, documents, name):
    """Rows equal each other, floats but for rounding: sums run over whole chunks."""
    rows = OPERATORS[name](table, documents).collect()
    assert len(rows) == 2 * len(HARD) + 3
    by = collections.defaultdict(list)
    for r in rows:
        by[r.doc_id].append(tuple(r))
    assert set(by) == {*range(len(HARD)), None, 500}
    for i in range(len(HARD)):
        assert len(by[i]) == 2 and all(x == (pytest.approx(y, abs=1e-6) if isinstance(y, float) else y) for x, y in zip(*by[i], strict=True))
    assert len(by[None]) == 2 and len(by[500]) == 1


def test_shards_of_repeated_rows_and_a_long_text(table):
    rows = kd_shards.shard(table, 4).collect()
    assert len(rows) == 2 * len(HARD) + 3 and max(r.size for r in rows) == len(LONG) + 1
    where = collections.defaultdict(set)
    for r in rows:
        where[r.doc_id].add(r.shard)
    assert all(len(where[i]) == 1 for i in range(len(HARD)))
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_leaks_in_repeated_rows_and_a_long_text(spark, table):
    words = "a leak is a text of the benchmark that stands in a document of the corpus word for word and so on to its end"
    benchmark = spark.createDataFrame([(1, words, 5), (1, words, 6), (2, None, 7)], "item_id long, text string, doc_id long")
    more = spark.createDataFrame([(600, f"{LONG} {words} {LONG}"), (601, words), (601, words), (None, words)], "doc_id long, text string")
    found = latent_leaks.find(table.select("doc_id", "text").union(more), benchmark).collect()
    assert collections.Counter((r.doc_id, r.item_id) for r in found) == {(600, 1): 2, (601, 1): 4, (None, 1): 2}
    left = latent_leaks.clean(table, benchmark)
    assert left.count() == table.count() and left.columns == table.columns


@pytest.mark.parametrize("text", ["", "one", "one two", "one two three four", "one two three four five six"])
def test_chunks_of_few_words(spark, text):
    """A chunk may hold fewer words than a shingle has."""
    df = spark.createDataFrame([(1, text), (2, text), (3, "other")], "doc_id long, text string").coalesce(1)
    for rows in (df, df.where("doc_id = 1")):
        found = {r.doc_id: r.component_id for r in shingle_sets.near_duplicates(rows).collect()}
        assert found == {i: min(i, 1) if i < 3 else 3 for i in found}
        assert knn_quality.counts_of([text]).shape == (1, knn_quality.TERMS)


def test_similar_texts_among_repeated_rows(table):
    found = shingle_sets.near_duplicates(table).collect()
    assert len(found) == 2 * len(HARD) + 1
    assert shingle_sets.representatives(table).where("doc_id is null").count() == 2


def planted(rng, centre, cosine):
    """A unit vector at that cosine from the centre."""
    noise = rng.standard_normal(len(centre))
    noise -= (noise @ centre) * centre
    return cosine * centre + np.sqrt(1 - cosine**2) * noise / np.linalg.norm(noise)


@pytest.mark.parametrize("low, high", [(0.931, 0.94), (0.94, 0.97), (0.97, 0.999)])
def test_planted_pairs_are_linked(spark, low, high):
    """Recall of at least 0.9 in each band of cosines from the threshold on; none below it."""
    rng = np.random.default_rng(21)
    rows, pairs = [], 500
    for i in range(pairs):
        centre = rng.standard_normal(64)
        centre /= np.linalg.norm(centre)
        rows += [(2 * i, centre.tolist(), i % 3, "x"), (2 * i + 1, planted(rng, centre, rng.uniform(low, high)).tolist(), i % 3, "x")]
    rows += [(10_000 + i, planted(rng, np.array(rows[2 * i][1]), 0.925).tolist(), rows[2 * i][2], "x") for i in range(100)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, node string")
    got = {r.vec_id: r for r in lattice_dedup.near_duplicates(df, 0.93).collect()}
    assert len(got) == len(rows)
    unit = np.array([r[1] for r in rows])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows])
    near = (unit @ unit.T >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(near, False)
    found = sum(r.n_links for r in got.values())
    assert 0.9 * near.sum() <= found <= near.sum() and near.sum() >= 2 * pairs
    assert all(got[r[0]].n_links <= n for r, n in zip(rows, near.sum(1), strict=True))
    print(f"recall at {low} to {high}: {found / near.sum():.4f}")


def test_no_language_is_crowded_out(spark):
    """Twenty rows of one id in one language leave the other language's only row in the fit; equal rows are one."""
    rows = [(1, f"the cat number {i} sat on the mat and saw that it was there with them and more of those {i} things", "en") for i in range(20)] + [(2, "le chat est sur la table avec les autres et il voit que tout est ici pour nous dans la maison", "fr")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = []
    fit = crf_language.fit
    crf_language.fit = lambda texts, langs: (seen.append((texts, langs)), fit(texts, langs))[1]
    try:
        for options in ({"rows_per_language": 5}, {"characters_per_language": 200}, {"characters_per_language": 50}):
            assert crf_language.train(df, F.lit(True), **options).languages == ["en", "fr"]
    finally:
        crf_language.fit = fit
    counts = [collections.Counter(langs) for _, langs in seen]
    assert counts[0] == {"en": 5, "fr": 1} and counts[1]["en"] == 2 and counts[2] == {"en": 1, "fr": 1}
    assert all(t in {r[1] for r in rows} for texts, _ in seen for t in texts)


def test_no_label_is_crowded_out(spark):
    rows = [(1, f"good text number {i} with sense", 1) for i in range(60)] + [(10 + i, f"BAD ### {i} !!! $$$", 0) for i in range(10)]
    df = spark.createDataFrame([r[:2] for r in rows] + [(11, "BAD ### 1 !!! $$$")] * 5, "doc_id long, text string")
    labels = spark.createDataFrame(sorted({(r[0], r[2]) for r in rows}) * 2, "doc_id long, quality int")
    model = knn_quality.train(df, labels, F.lit(True), rows=20)
    assert collections.Counter(model.labels.tolist()) == {0: 10, 1: 10}


def test_scattered_and_short_items_are_no_leaks(spark):
    """Words that lie far apart, and items of a few words inside sentences, say nothing; a line of its own does."""
    benchmark = spark.createDataFrame([(1, "Paris"), (2, "and of a"), (3, "alpha beta gamma delta epsilon zeta eta theta iota kappa"), (4, "what is it"), (5, "")], "item_id long, text string")
    spread = " ".join(x for w in "alpha beta gamma delta epsilon zeta eta theta iota kappa".split() for x in (w, "so", "it", "goes", "on", "and"))
    texts = [
        "I love Paris in spring when the trees and the roofs are all of a colour that I can not name", spread, "Paris", "Where?\n  PARIS! \nand of a\nwhat is it not",
        "alpha so beta gamma on delta epsilon and zeta eta it theta iota then kappa", "paris\nparis paris", "",
    ]
    found = latent_leaks.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), benchmark).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(2, 1), (3, 1), (3, 2), (4, 3), (5, 1)}


def test_leaks_are_exact_on_texts_of_common_words(spark, monkeypatch):
    """Precision and recall against windows of three times an item, over several blocks and passes: texts of forty words share most of them."""
    monkeypatch.setattr(latent_leaks, "AT_ONCE", 2)
    rng = np.random.default_rng(12)
    words = [f"w{i}" for i in range(40)]
    weight = 1 / np.arange(1, 41)
    some = lambda n: rng.choice(words, n, p=weight / weight.sum()).tolist()
    items = [some(int(rng.integers(8, 25))) for _ in range(60)]
    texts = [some(int(rng.integers(30, 200))) for _ in range(120)]
    for i in range(0, 120, 3):
        at, item = int(rng.integers(0, len(texts[i]))), items[int(rng.integers(60))]
        kept = [w for w in item if rng.random() > 0.15]
        texts[i] = texts[i][:at] + kept + texts[i][at:]

    def share(a, b):
        return latent_leaks.common_subsequence(a, b) / len(a)

    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    benchmark = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    found = latent_leaks.find(df, benchmark, block_bytes=1000, answered_lcs=0.8, lcs=0.8).collect()
    got = {(r.doc_id, r.item_id) for r in found}
    n = lambda i: len(items[i])
    wide = {(d, i) for d, t in enumerate(texts) for i, x in enumerate(items) if any(share(x, t[a : a + 3 * n(i)]) >= 0.8 for a in range(max(1, len(t) - 3 * n(i) + 1)))}
    narrow = {(d, i) for d, t in enumerate(texts) for i, x in enumerate(items) if any(share(x, t[a : a + n(i) + n(i) // 4]) >= 0.8 for a in range(max(1, len(t) - n(i) - n(i) // 4 + 1)))}
    assert got <= wide and len(narrow) >= 20
    assert len(narrow - got) <= 0.05 * len(narrow)


def test_many_vectors_that_link_with_nothing_meet_nowhere(spark):
    """Half of the rows are null vectors of one label: none of them is in a join, all come back."""
    df = spark.range(4000).selectExpr("id as vec_id", "if(id % 2 = 0, null, array(double(id % 97), 1.0d, double(id % 89))) as embedding", "1 as label")
    got = lattice_dedup.near_duplicates(df, 0.93)
    assert got.count() == 4000 and got.where("vec_id % 2 = 0 and (n_links <> 0 or component_id <> vec_id or not kept)").count() == 0
    lines = got._jdf.queryExecution().optimizedPlan().toString().splitlines()
    joined = min(i for i, x in enumerate(lines) if "Join" in x)
    assert any("Union" in x for x in lines[:joined])
