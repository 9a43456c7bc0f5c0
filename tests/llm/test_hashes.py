"""Texts made to break polynomial hashes modulo 2**64, and hashes forced to collide."""

import collections
import hashlib

import numpy as np
import pytest
import sentencepiece

from inkwell.llm import arrowtext, crf_language, kneser_ney, latent_leaks, queries, sentencepiece_bpe, shared, shingle_sets, suffix_dedup

from test_llm import docs, plain_removal


def thue_morse(n):
    """Two different words of n letters that agree under every polynomial hash modulo 2**64 with an odd base, from n = 1024 on."""
    bits = [i.bit_count() & 1 for i in range(n)]
    return "".join("ab"[x] for x in bits), "".join("ba"[x] for x in bits)


@pytest.fixture(scope="module", params=[1024, 2048])
def pair(request):
    return thue_morse(request.param)


def test_spans_differ_and_are_told_apart(pair):
    raw = np.frombuffer(" ".join(pair).encode(), np.uint8)
    n = len(pair[0])
    starts, ends = np.array([0, n + 1]), np.array([n, 2 * n + 1])
    hashes = arrowtext.span_hashes(raw, starts, ends)
    assert hashes[0] != hashes[1]
    rolling = arrowtext.Rolling().spans(raw, n)
    assert rolling[0] == rolling[n + 1]  # the words do break it
    for h in (hashes, np.zeros(2, np.uint64)):
        first, which = arrowtext.distinct_spans(raw, starts, ends, h)
        assert sorted(first) == [0, 1] and which[0] != which[1]


def test_distinct_spans_with_few_hashes():
    rng = np.random.default_rng(3)
    raw = rng.choice(np.frombuffer(b"ab  ", np.uint8), 20_000)
    raw[5000:6000], raw[8000:9000] = 97, 97
    starts, ends, _ = arrowtext.words(raw, np.array([0, len(raw)]))
    texts = [raw[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]
    for modulus in (1, 7, 1 << 62):
        first, which = arrowtext.distinct_spans(raw, starts, ends, arrowtext.span_hashes(raw, starts, ends) % np.uint64(modulus))
        assert [texts[first[w]] for w in which] == texts and len(first) == len(set(texts))


def test_tokens(spark, pair):
    path = queries.tokenizer()
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = [" ".join(pair), pair[0], pair[1], f"{pair[1]}\n{pair[0]}"]
    for r in sentencepiece_bpe.encode_decode(docs(spark, texts), path).collect():
        assert r.ids == library.encode(texts[r.doc_id]) and r.decoded == texts[r.doc_id]


def test_language_model_words(spark, pair):
    rows = docs(spark, [pair[0], f"{pair[0]} {pair[0]}", pair[1]])
    model = kneser_ney.train(rows, rows.doc_id < 2)
    assert [x.n_known for x in kneser_ney.score(rows, model).orderBy("doc_id").collect()] == [2, 3, 1]


def test_windows(spark, pair):
    texts = [*pair, f"x{pair[0]}y", "z" * 300, *("".join(thue_morse(64)) * k for k in (1, 2, 5))]
    got = suffix_dedup.digests(suffix_dedup.remove(docs(spark, texts), depth=200)).collect()
    want = [(i, *x) for i, x in enumerate(plain_removal(texts, 200))]
    assert sorted((x.doc_id, x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in got) == want


def test_shingles_leaks_and_languages(spark, pair):
    found = shingle_sets.near_duplicates(docs(spark, [pair[0], pair[1], pair[0]])).collect()
    assert {x.doc_id: x.component_id for x in found} == {0: 0, 1: 1, 2: 0}
    benchmark = spark.createDataFrame([(1, " ".join([pair[0], *"cdefg"]))], "item_id long, text string")
    leaks = latent_leaks.find(docs(spark, [" ".join([pair[1], *"hijkl"]), " ".join([pair[0], *"cdefg"])]), benchmark).collect()
    assert [x.doc_id for x in leaks] == [1]
    w = crf_language.words_of([" ".join(pair)])
    assert len(set(w.which.tolist())) == len(set(w.key.tolist())) == 2


#: Words of 16 bytes whose plain hashes agree, found by running the scramble backwards.
AGREE = [("uuhweb7qo62g65eu", "u0lf4664%0k-@dtn"), ("ocgjj4cu04qk143a", "orjzkt7nh3]a>-wl")]


def backwards(x):
    """What mix64 scrambles to x."""
    mask = (1 << 64) - 1
    x ^= x >> 31 ^ x >> 62
    x = x * pow(0x94D049BB133111EB, -1, 1 << 64) & mask
    x ^= x >> 27 ^ x >> 54
    x = x * pow(0xBF58476D1CE4E5B9, -1, 1 << 64) & mask
    return x ^ x >> 30 ^ x >> 60


def made_to_agree(size, count):
    """Pairs of different byte strings of 16 bytes with one plain hash: the second half undoes what the first has done."""
    r, step, mask = np.random.default_rng(9), int(arrowtext.STEP), (1 << 64) - 1
    mix = lambda x: int(arrowtext.mix64(np.array([x], np.uint64))[0])
    start, out = mix((16 + step) & mask), []
    while len(out) < count:
        a, b, rest = (int(x) for x in r.integers(0, 1 << 63, 3))
        one, two = (mix(((start ^ x) * step) & mask) for x in (a, b))
        out.append((a.to_bytes(8, "little") + rest.to_bytes(8, "little"), b.to_bytes(8, "little") + (rest ^ one ^ two).to_bytes(8, "little")))
    return out


def test_plain_hashes_can_be_made_to_agree_and_digests_not():
    assert backwards(int(arrowtext.mix64(np.array([77], np.uint64))[0])) == 77
    pairs = made_to_agree(16, 20) + [(a.encode(), b.encode()) for a, b in AGREE[:1]]
    raw = np.frombuffer(b"".join(x for p in pairs for x in p), np.uint8)
    starts = np.arange(0, len(raw), 16)
    plain = arrowtext.span_hashes(raw, starts, starts + 16)
    assert (plain[::2] == plain[1::2]).all()
    assert len(np.unique(arrowtext.digests(raw, starts, starts + 16, arrowtext.secret())["hash"])) == len(starts)
    first, which = arrowtext.distinct_spans(raw, starts, starts + 16, plain)
    assert len(first) == len(starts) == len(set(which.tolist()))


@pytest.mark.parametrize("known, new", AGREE)
def test_words_made_to_agree_are_two_words(spark, known, new):
    rows = docs(spark, [f"{known} {known}", new, f"{new} {known}"])
    found = {x.doc_id: x for x in kneser_ney.score(rows, kneser_ney.train(rows, rows.doc_id == 0)).collect()}
    assert [found[i].n_known for i in range(3)] == [3, 1, 2] and found[1].base_score < found[0].base_score / 2
    both = kneser_ney.train(rows, rows.doc_id < 3)
    assert both.size == 3 and kneser_ney.score(rows, both).count() == 3


def test_word_keys_tell_all_words_apart():
    rng = np.random.default_rng(8)
    some = {bytes(rng.integers(97, 99, n).astype(np.uint8)) for n in [*range(1, 20)] * 60} | {b"a\0", b"a", b"\0", b"\0\0", b"x" * 15, b"x" * 16, b"x" * 17, b"x" * 300, b"x" * 299 + b"y"}
    listed = sorted(some) * 2
    raw = np.frombuffer(b"".join(listed), np.uint8)
    ends = np.cumsum([len(w) for w in listed])
    keys = kneser_ney.word_keys(raw, np.r_[0, ends[:-1]], ends, b"0123456789abcdef")
    assert len(set(keys.tolist())) == len(some) and keys[: len(some)].tolist() == keys[len(some) :].tolist()
    assert len(set(keys["hash"].tolist())) == len(some)


def test_words_with_one_hash_are_an_error(monkeypatch):
    found = np.array([(5, 1), (7, 2), (5, 1)], arrowtext.DIGEST)
    assert kneser_ney.combine_words(found, np.array([1, 2, 3]))[1].tolist() == [4, 2]
    with pytest.raises(ValueError, match="one hash"):
        kneser_ney.combine_words(np.array([(5, 1), (5, 2)], arrowtext.DIGEST), np.array([1, 2]))


@pytest.mark.parametrize("one, other", AGREE)
def test_windows_made_to_agree_stay(spark, one, other):
    """Texts of 200 bytes that differ in their first 16 hold no repeated window."""
    rest = ("".join(hashlib.md5(str(i).encode()).hexdigest() for i in range(6)))[:184]
    texts = [one + rest, other + rest, one + rest[::-1], f"{one}{rest}", f"x{other}{rest}"]
    for some in (texts[:2], texts[:3], texts):
        got = suffix_dedup.digests(suffix_dedup.remove(docs(spark, some), depth=200)).collect()
        assert sorted((x.doc_id, x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in got) == [(i, *x) for i, x in enumerate(plain_removal(some, 200))]


def test_passes_order_digit_by_digit():
    """Groups after all passes are the equal ones, whatever the digits; those of one leave at their pass."""
    rng = np.random.default_rng(4)
    for depth, digit in ((200, 100), (30, 12), (40, 4)):
        records = np.zeros(500, suffix_dedup.suffix_kind(depth, digit))
        names = suffix_dedup.digit_names(records)
        for f in names:
            records[f] = rng.integers(0, 3 if len(names) < 5 else 2, 500)
        records["lo"], records["flag"] = np.arange(500), rng.integers(0, 30, 500) == 0
        left, alone = suffix_dedup.passes(records)
        keys = [tuple(r[f] for f in names) for r in records]
        count, marked = collections.Counter(keys), {k for k, r in zip(keys, records, strict=True) if r["flag"]}
        assert sorted(left["lo"].tolist()) == [i for i, k in enumerate(keys) if count[k] > 1 or k in marked]
        assert sorted([*left["lo"].tolist(), *alone["lo"].tolist()]) == list(range(500))
        order = [tuple(r[f] for f in names) for r in left]
        assert order == sorted(order)


def test_many_copies_of_a_row(spark):
    """20,000 copies under one id, and half-copies: ranges of a row are a set, whatever the number of copies."""
    text = " ".join(hashlib.md5(str(i).encode()).hexdigest() for i in range(40))
    rows = spark.range(20_000).selectExpr("7 as doc_id", f"'{text}' as text")
    more = spark.createDataFrame([(8, text[:600] + "!" * 10 + text[300:500]), (7, "short")], "doc_id long, text string")
    table = shared.kept(rows.unionByName(more).repartition(8))
    key = arrowtext.secret()
    ranges = suffix_dedup.repeated(suffix_dedup.keyed(table, "doc_id", "text", key), key)
    own = ranges.groupBy("row", "tag").agg({"lo": "count"}).collect()
    assert len(own) == 2 and max(x[2] for x in own) < 20_000
    got = collections.Counter((x.doc_id, x.n_removed, x.n_bytes) for x in suffix_dedup.digests(suffix_dedup.remove(table)).collect())
    gone = plain_removal([text, text, text[:600] + "!" * 10 + text[300:500], "short"], 200)
    assert got == {(7, gone[0][1], gone[0][0]): 20_000, (8, gone[2][1], gone[2][0]): 1, (7, 0, 5): 1}
