"""Substring and suffix-array dedup against brute force."""

import random
from collections import Counter

import pytest

from siftflow.llm.substring_dedup import dedup_substrings
from siftflow.llm.suffix_dedup import dedup_suffixes

SCHEMA = "doc_id long, text string, kept string"


def brute_words(rows, width):
    split = [(d, t.encode().split() if t is not None else []) for d, t in rows]
    seen = Counter(tuple(w[i : i + width]) for d, w in split for i in range(len(w) - width + 1))
    for d, w in split:
        drop = {j for i in range(len(w) - width + 1) if seen[tuple(w[i : i + width])] > 1 for j in range(i, i + width)}
        yield d, b" ".join(x for j, x in enumerate(w) if j not in drop).decode(), len(w), len(drop)


def brute_bytes(rows, width):
    first, raws = {}, [(d, (t or "").encode()) for d, t in rows]
    for d, r in raws:
        for i in range(len(r) - width + 1) if d is not None else ():
            s = r[i : i + width]
            first[s] = min(first.get(s, (d, i)), (d, i))
    for d, r in raws:
        drop = {j for i in range(len(r) - width + 1) if d is not None and first[r[i : i + width]] < (d, i) for j in range(i, i + width)}
        spans = sum(j - 1 not in drop for j in drop)
        yield d, bytes(x for j, x in enumerate(r) if j not in drop), len(r), len(drop), spans


def made(seed):
    r = random.Random(seed)
    vocab = ["a", "b", "çé", "dd", "e f", "日本"]
    texts = []
    for _ in range(40):
        t = r.choices(vocab, k=r.randrange(0, 60))
        if texts and r.random() < 0.6:
            o = r.choice(texts)
            i = r.randrange(len(o) + 1)
            at = r.randrange(len(t) + 1)
            t = t[:at] + o[i : i + 25] + t[at:]
        texts.append(t)
    texts += [["a"] * 200, ["a", "b"] * 90, [], texts[3], texts[3]]
    rows = [(i * 3, r.choice([" ", "\n", "\t "]).join(t)) for i, t in enumerate(texts)]
    r.shuffle(rows)
    return [*rows, (1000, None), (1001, ""), (None, "a " * 50), (None, "a " * 50), (500, "x y z " * 9)]


@pytest.mark.parametrize("seed,hot", [(1, 10_000), (2, 10_000), (3, 1)])
def test_words(spark, seed, hot):
    rows = made(seed)
    df = spark.createDataFrame([(d, t, "other") for d, t in rows], SCHEMA).repartition(3)
    got = [tuple(x) for x in dedup_substrings(df, width=8, gram=3, hot_runs=hot).collect()]
    assert Counter(got) == Counter(brute_words(rows, 8))


@pytest.mark.parametrize("seed,hot", [(1, 10_000), (2, 10_000), (3, 1)])
def test_bytes(spark, seed, hot):
    rows = made(seed)
    df = spark.createDataFrame([(d, t, "other") for d, t in rows], SCHEMA).repartition(3)
    got = [(d, bytes(k), *n) for d, k, *n in dedup_suffixes(df, width=20, gram=6, hot_runs=hot).collect()]
    assert Counter(got) == Counter(brute_bytes(rows, 20))


def test_repeated_rows_and_pieces(spark, monkeypatch):
    rows = [(1, "p q r s t u v w x y"), (1, "p q r s t u v w x y"), (2, "other words " * 30)]
    df = spark.createDataFrame([(d, t, "") for d, t in rows], SCHEMA)
    got = Counter(tuple(x) for x in dedup_substrings(df, width=8, gram=3).collect())
    assert got == Counter(brute_words(rows, 8))
    # neither of two rows with one id starts earlier
    got = {d: n for d, _, _, n, _ in dedup_suffixes(df, width=10, gram=4).collect()}
    assert got[1] == 0 and got[2] > 0


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert dedup_substrings(df).collect() == [] and dedup_suffixes(df).collect() == []


def test_long_text_in_pieces():
    import numpy as np

    from siftflow.llm import anchors

    sym = np.random.default_rng(1).integers(0, 5, 4000).astype(np.uint64) * np.uint64(77777777777777)
    whole = anchors.runs_of(sym, np.array([4000]), 12, 4)
    assert whole[2].sum() == 4000 - 11 and (np.diff(whole[1]) == whole[2][:-1]).all()


def test_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    assert Counter(tuple(x) for x in dedup_substrings(df).collect()) == Counter(brute_words(rows, 35))
    assert Counter((d, bytes(k), *n) for d, k, *n in dedup_suffixes(df).collect()) == Counter(brute_bytes(rows, 100))


def test_words_of_equal_run_hashes_are_told_apart(spark, monkeypatch):
    """All runs of one minimiser have one hash here, as if every pair collided; it decides nothing."""
    from siftflow.llm import anchors

    plain = anchors.runs_of

    def colliding(*a):
        piece, start, nwin, key, whole, other = plain(*a)
        return piece, start, nwin, key, whole * 0, other * 0

    rows = made(4)
    df = spark.createDataFrame([(d, t, "other") for d, t in rows], SCHEMA).repartition(3)
    monkeypatch.setattr(anchors, "runs_of", colliding)
    got = [tuple(x) for x in dedup_substrings(df, width=8, gram=3).collect()]
    assert Counter(got) == Counter(brute_words(rows, 8))


def test_bytes_of_runs_with_one_equal_hash_are_told_apart(spark, monkeypatch):
    """The first hash of all runs of one minimiser is the same here; the second tells them apart."""
    from siftflow.llm import anchors

    plain = anchors.runs_of

    def colliding(*a):
        piece, start, nwin, key, whole, other = plain(*a)
        return piece, start, nwin, key, whole * 0, other

    rows = made(5)
    df = spark.createDataFrame([(d, t, "other") for d, t in rows], SCHEMA).repartition(3)
    monkeypatch.setattr(anchors, "runs_of", colliding)
    got = [(d, bytes(k), *n) for d, k, *n in dedup_suffixes(df, width=20, gram=6).collect()]
    assert Counter(got) == Counter(brute_bytes(rows, 20))
