"""Quality rules by weak supervision.

Each rule looks at a few counts of a whole text and votes good, votes bad, or abstains.
No rule decides alone. Bad texts come in kinds, one for each rule: what repeats itself
seldom shouts too, so a bad text has few bad votes and many good ones, and two classes
would take the largest kind for all. Expectation-maximisation estimates, without
labels, the share of good texts and of every kind, and how often each rule is
right on each of them; abstaining says nothing. A text's votes then give its posterior
probability of being good, and texts of at least one half are kept.

The votes of a text are one of 3**rules patterns. Spark counts the patterns of
all documents; the estimation works on these counts, a bounded table, so it weighs
every document. It starts from the stated belief that a rule sees most of its own kind and
little of the others, held by pseudo-counts that fade as texts come in: where no text
has a vote, the belief stands. Two bounds hold the classes apart: no rule condemns more
than one good text in 200, and at least half of its kind.

Counts are taken in chunks of texts in Arrow batches; equal words and lines are
told by their bytes. A single long text is handled whole: about 100 bytes a byte.

Defined cases: null and empty texts have no words; like all texts of fewer than ten
words, and those with over a fifth of their words in repeated runs of five, they
fail the base rules and are not kept whatever the votes; they vote all the same.
Rows without an id and repeated rows are rows of their own. An empty table gives no
rows, and estimates that are the starting belief.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import IS_SPACE, distinct_spans, narrow, span_hashes, text_chunks, words
from .shared import kept

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_capitals", "n_unlettered", "n_stutters", "n_ends"]


def flags(characters: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(characters)] = True
    return out


SYMBOL = flags(b"#*$%&|<>")
ENDS = flags(b".?!")
CAPITAL = flags(bytes(range(65, 91)))
SMALL = flags(bytes(range(97, 123)))
#: Bytes of letters of ASCII, and of all characters beyond it.
LETTER = CAPITAL | SMALL | flags(bytes(range(128, 256)))


def pairs(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A number for each different pair."""
    return np.unique(left * (int(right.max(initial=0)) + 1) + right, return_inverse=True)[1] if len(left) else left


def repeated(ids: np.ndarray, row: np.ndarray, size: int) -> np.ndarray:
    """Which words lie in a run of ``size`` words that their row holds twice or more."""
    n = len(ids) - size + 1
    if n <= 0:
        return np.zeros(len(ids), bool)
    run, have = ids, 1
    while have < size:  # runs of 2, 4, ... words, then as many more as are left
        step = min(have, size - have)
        if step == have:
            run = pairs(run[:-step], run[step:])
        else:
            run = pairs(run[: len(ids) - size + 1], tail(ids, have, step)[: len(ids) - size + 1])
        have += step
    inside = np.flatnonzero(row[:n] == row[size - 1 :])
    key = pairs(run[:n][inside], row[inside])
    twice = inside[np.bincount(key)[key] > 1] if len(inside) else inside
    edge = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + size, -1)
    return np.cumsum(edge[:-1]) > 0


def tail(ids: np.ndarray, at: int, size: int) -> np.ndarray:
    """Numbers for the runs of ``size`` words that begin ``at`` words on."""
    run = ids[at:]
    for k in range(1, size):
        run = pairs(run[:-1], ids[at + k :])
    return run


def counts_of(raw: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of each text of a chunk."""
    n = len(offsets) - 1
    starts, ends, row = words(raw, offsets)
    of = lambda which, rows: np.bincount(rows[which], minlength=n)

    def upto(mask: np.ndarray) -> np.ndarray:
        return np.r_[0, np.cumsum(mask)]

    def within(mask: np.ndarray) -> np.ndarray:
        total = upto(mask)
        return total[offsets[1:]] - total[offsets[:-1]]

    ids = distinct_spans(raw, starts, ends, span_hashes(raw, starts, ends))[1] if len(starts) else starts
    letters = upto(LETTER[raw])
    # lines end before a line feed or where the text ends; each has the row of its first byte
    first = np.unique(np.r_[offsets[:-1], np.flatnonzero(raw == 10) + 1])
    first = first[first < len(raw)]
    last = np.r_[first[1:], len(raw)]
    last = last - (raw[last - 1] == 10) if len(first) else last
    solid = upto(~IS_SPACE[raw])
    full = solid[last[: len(first)]] > solid[first]
    first, last = first[full], last[: len(full)][full]
    line_row = np.searchsorted(offsets, first, "right") - 1
    lines = distinct_spans(raw, first, last, span_hashes(raw, first, last))[1] if len(first) else first
    different = np.unique(line_row * (len(first) + 1) + lines) // (len(first) + 1)
    n_lines = np.bincount(line_row, minlength=n)
    again = np.zeros(len(ids), bool)
    again[1:] = (ids[1:] == ids[:-1]) & (row[1:] == row[:-1])
    return {
        "n_words": np.bincount(row, minlength=n),
        "word_chars": within(((raw & 0xC0) != 0x80) & ~IS_SPACE[raw]),
        "n_symbols": within(SYMBOL[raw]),
        "n_dup_lines": n_lines - np.bincount(different, minlength=n),
        "n_repeat_words": of(repeated(ids, row, 5), row),
        "n_lines": n_lines,
        "n_letters": within(CAPITAL[raw] | SMALL[raw]),
        "n_capitals": within(CAPITAL[raw]),
        "n_unlettered": of(letters[ends] == letters[starts], row),
        "n_stutters": of(again, row),
        "n_ends": of(ENDS[raw[ends - 1]], row),
    }


def counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the counts of every row, over whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, offsets, raw, _ in text_chunks(batches):
            found = counts_of(raw, offsets)
            yield pa.RecordBatch.from_arrays([rows.column(0), *[pa.array(found[c].astype(np.int64)) for c in COUNTS]], ["doc_id", *COUNTS])

    return narrow(df, id_col, text_col).mapInArrow(run, ", ".join(f"{c} long" for c in ["doc_id", *COUNTS]))


@dataclass(frozen=True)
class Rule:
    """Conditions, in SQL over the counts, under which a rule votes; where both or neither hold it abstains."""

    name: str
    good: str
    bad: str


#: Shares are compared as products of whole numbers.
RULES = [
    Rule("length", "n_words >= 30", "n_words < 10"),
    Rule("word_length", "word_chars BETWEEN 3 * n_words AND 10 * n_words", "2 * n_letters >= word_chars AND (2 * word_chars < 5 * n_words OR word_chars > 14 * n_words)"),
    Rule("symbols", "50 * n_symbols <= n_words", "10 * n_symbols >= n_words"),
    Rule("lines", "n_lines >= 3 AND 10 * n_dup_lines <= n_lines", "n_dup_lines >= 2 AND 10 * n_dup_lines >= 3 * n_lines"),
    Rule("runs", "20 * n_repeat_words <= n_words", "100 * n_repeat_words > 20 * n_words"),
    Rule("capitals", "100 * n_capitals <= 20 * n_letters", "2 * n_capitals > n_letters"),
    Rule("letters", "20 * n_unlettered <= n_words", "10 * n_unlettered >= 3 * n_words"),
    Rule("stutters", "100 * n_stutters <= n_words", "10 * n_stutters >= n_words"),
    Rule("sentences", "n_ends > 0 AND n_words BETWEEN 4 * n_ends AND 60 * n_ends", "n_words >= 60 AND (n_words > 200 * n_ends OR n_words < 2 * n_ends)"),
]


def votes(rows: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """The rows with the column votes: for each rule + for good, - for bad, 0 for an abstention."""
    # a text without words has no shares to speak of: all but the first rule abstain
    some = F.col("n_words") > 0
    cast = [
        F.when(~some & F.lit(i > 0), "0").when(F.expr(r.good) & ~F.expr(r.bad), "+").when(F.expr(r.bad) & ~F.expr(r.good), "-").otherwise("0")
        for i, r in enumerate(rules)
    ]
    return rows.withColumn("votes", F.concat(*cast))


#: What the estimation starts from: the share of good texts, how often a rule votes bad on the kind it is made for and on the other kinds,
#: and how many texts this belief weighs for each number.
BELIEF_GOOD, BELIEF_OWN, BELIEF_OTHER, BELIEF_TEXTS = 0.8, 0.9, 0.1, 20.0
#: A rule condemns at most one good text in 200: its thresholds are set that far out.
MOST_WRONG = 0.005
#: A kind keeps its rule: that one sees at least half of it.
LEAST_OWN = 0.5


@dataclass
class Model:
    """Shares of the classes (the first is good, then a kind of bad texts for each rule), and each rule's chance to vote bad on each class, where it votes."""

    shares: np.ndarray
    bad: np.ndarray
    rounds: int = 0

    @classmethod
    def believed(cls, m: int) -> Model:
        bad = np.full((m + 1, m), BELIEF_OTHER)
        bad[0], bad[np.arange(1, m + 1), np.arange(m)] = MOST_WRONG, BELIEF_OWN
        return cls(np.r_[BELIEF_GOOD, np.full(m, (1 - BELIEF_GOOD) / m)], bad)

    def classes(self, up: np.ndarray, down: np.ndarray) -> np.ndarray:
        """The classes' probabilities for each row of votes (1 where a rule has voted good, or bad)."""
        odds = np.log(self.shares) + up @ np.log1p(-self.bad).T + down @ np.log(self.bad).T
        q = np.exp(odds - odds.max(1, keepdims=True))
        return q / q.sum(1, keepdims=True)

    def posterior(self, patterns: list[str]) -> list[float]:
        """The probability that a text with these votes is good."""
        return self.classes(*cast_votes(patterns, len(self.bad) - 1))[:, 0].tolist()


def cast_votes(patterns: list[str], m: int) -> tuple[np.ndarray, np.ndarray]:
    marks = np.array([list(p) for p in patterns], "U1").reshape(-1, m)
    return (marks == "+").astype(float), (marks == "-").astype(float)


def estimate(patterns: dict[str, int], m: int = len(RULES), most_rounds: int = 2000, close: float = 1e-9) -> Model:
    """Expectation-maximisation over the counts of vote patterns of ``m`` rules."""
    order = sorted(patterns)
    up, down = cast_votes(order, m)
    n = np.array([patterns[p] for p in order], float)[:, None]
    model, belief = Model.believed(m), Model.believed(m)
    own = (np.arange(1, m + 1), np.arange(m))
    for model.rounds in range(1, most_rounds + 1):
        q = n * model.classes(up, down)
        shares = (q.sum(0) + BELIEF_TEXTS * belief.shares) / (n.sum() + BELIEF_TEXTS)
        bad = (q.T @ down + BELIEF_TEXTS * belief.bad) / (q.T @ (up + down) + BELIEF_TEXTS)
        bad[0] = np.minimum(bad[0], MOST_WRONG)
        bad[own] = np.maximum(bad[own], LEAST_OWN)
        change = max(np.abs(shares - model.shares).max(), np.abs(bad - model.bad).max())
        model.shares, model.bad = shares, bad
        if change < close:
            break
    return model


def judge(df: DataFrame, rules: list[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the counts, votes, posterior, base_failed and kept of every row."""
    voted = kept(votes(counts(df, id_col, text_col), rules))
    # at most 3**rules patterns reach the driver, and are broadcast with their probability
    patterns = {r["votes"]: r["n"] for r in voted.groupBy("votes").agg(F.count("*").alias("n")).collect()}
    found = estimate(patterns, len(rules)).posterior(list(patterns))
    told = df.sparkSession.createDataFrame(list(zip(patterns, found, strict=True)), "votes string, posterior double")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    judged = voted.join(F.broadcast(told), "votes").withColumn("base_failed", failed)
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= 0.5))
