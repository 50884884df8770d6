import random

import numpy as np
import pytest

from gleanwork.llm.substring_dedup import op2_substring_dedup, remove_repeats


def brute(rows, length):
    seen, out = set(), {}
    for doc, text in sorted(rows, key=lambda r: r[0]):
        words = (text or "").encode().split()
        hit = np.zeros(len(words), bool)
        for k in range(len(words) - length + 1):
            key = tuple(words[k : k + length])
            if key in seen:
                hit[k : k + length] = True
            seen.add(key)
        out[doc] = (len(words), int(hit.sum()), b" ".join([w for w, h in zip(words, hit) if not h]).decode())
    return out


def check(spark, rows, length=20, seed=8):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in remove_repeats(df, length, seed).collect()}
    assert got == brute(rows, length)


def test_cases(spark, docs_rows):
    check(spark, [r[:2] for r in docs_rows[:-1]])


@pytest.mark.parametrize("trial", range(3))
def test_random(spark, trial):
    """Few words, so that repeats overlap, nest and repeat inside one document."""
    rng = random.Random(trial)
    runs = [[rng.choice("abc") + str(rng.randrange(9)) for _ in range(rng.randrange(5, 90))] for _ in range(8)]
    check(spark, [(i, " ".join(w for _ in range(rng.randrange(5)) for w in rng.choice(runs)[rng.randrange(4) :])) for i in range(60)])
    check(spark, [(i, " ".join(rng.choice("ab") for _ in range(rng.randrange(40)))) for i in range(40)], 7, 3)


@pytest.mark.parametrize("partitions", [1, 7])
def test_repeated_rows_keep_their_words_alike(spark, docs_rows, partitions):
    rows = [r[:2] for r in docs_rows[:-1]]
    df = spark.createDataFrame(rows + rows, "doc_id long, text string").repartition(partitions)
    want = brute(rows, 20)
    got = [(r.doc_id, (r.n_words, r.n_removed, r.kept)) for r in remove_repeats(df).collect()]
    assert len(got) == 2 * len(rows) and all(want[i] == x for i, x in got)


def test_an_anchor_of_a_third_of_all_rows(spark):
    """One phrase with other words around it in every third document, and one line that is the same in all of them."""
    phrase, line = " ".join(f"p{i}" for i in range(9)), " ".join(f"q{i}" for i in range(25))
    other = lambda i, n: " ".join(f"d{i}x{k}" for k in range(n))
    check(spark, [(i, f"{other(i, 15)} {phrase if i % 3 else line} {other(i + 1000, 15)}") for i in range(300)])


def test_empty_table(no_docs):
    assert remove_repeats(no_docs).count() == 0


def test_query(spark):
    assert op2_substring_dedup(spark, "/root/testdata/sf0.001").columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
