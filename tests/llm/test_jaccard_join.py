import random

import pytest

from gleanwork.llm.components import components
from gleanwork.llm.jaccard_join import near_duplicates


def sets_of(text, size):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))) if words else frozenset()


def brute(rows, size, percent):
    sets = {i: sets_of(t, size) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            k = len(sets[a] & sets[b])
            if a < b and k and 100 * k >= percent * (len(sets[a]) + len(sets[b]) - k):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def check(spark, rows, size=5, percent=75):
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), size, percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, size, percent)
    assert len(got) == len(rows)


def test_cases(spark, docs_rows):
    check(spark, [r[:2] for r in docs_rows[:-1]])


@pytest.mark.parametrize("size,percent,words", [(5, 75, 40), (2, 75, 12), (1, 50, 8)])
def test_random_near_copies(spark, size, percent, words):
    """Copies with random edits, around the threshold, of a few texts that share passages."""
    rng = random.Random(size)
    vocabulary = [f"v{i}" for i in range(60)]
    passage = [rng.choice(vocabulary) for _ in range(words // 2)]
    origins = [passage + [rng.choice(vocabulary) for _ in range(rng.randrange(words))] for _ in range(6)]
    rows = []
    for i in range(150):
        text = list(rng.choice(origins))
        for _ in range(rng.randrange(6)):
            text[rng.randrange(len(text))] = rng.choice(vocabulary)
        rows.append((i, " ".join(text)))
    check(spark, rows, size, percent)


def test_repeated_rows_and_empty_table(spark, docs, docs_rows, no_docs):
    got = near_duplicates(docs).toPandas()
    assert len(got) == len(docs_rows) and (got[got.doc_id == 4].component_id == 4).all() and (got.doc_id == 4).sum() == 2
    assert near_duplicates(no_docs).count() == 0


def test_components(spark):
    rng = random.Random(1)
    path = [(i, i + 1) for i in range(100, 160)]
    links = path + [(rng.randrange(80), rng.randrange(80)) for _ in range(50)]
    root = {i: i for e in links for i in e}
    for _ in root:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {n: r for n, r in root.items() if n in got} and all(root[n] == n for n in root if n not in got)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
