import random
import re
from collections import Counter

import pytest
import xxhash

from gleanwork.llm.simhash import ball_links, fingerprint, near_duplicates, op12_simhash_balls

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(text):
    """The contract, bit by bit."""
    words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def joined(nodes, links):
    root = {i: i for i in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in nodes}


def brute(rows, radius=4):
    prints = [(i, plain(t)) for i, t in rows]
    links = [(i, j) for i, a in prints for j, b in prints if i < j and (a ^ b).bit_count() <= radius]
    root = joined({i for i, _ in prints}, links)
    return Counter((i, f"{p:016x}", root[i]) for i, p in prints)


def test_fingerprint(docs_rows):
    for text in [*(r[1] for r in docs_rows), "a", "a b c", "a b c d", "A b\x0bc\x1fd \x85 e", "x " * 70_000, "İ É ÀB"]:
        assert fingerprint(text or "") == plain(text)
    assert fingerprint("Nobody Expects the spanish inquisition") == fingerprint("nobody expects\tTHE \n spanish inquisition")


def test_documents(spark, docs, docs_rows, no_docs):
    rng = random.Random(5)
    base = [f"w{rng.randrange(900)}" for _ in range(300)]
    rows = [r[:2] for r in docs_rows]
    for i in range(100, 160):
        words = list(base)
        for _ in range(rng.randrange(3)):
            words[rng.randrange(300)] = "z"
        rows.append((i, " ".join(words)))
    rows += [(200, "other text of the same id"), (200, base[0] + " " + " ".join(base)), (200, "a third one")]
    got = Counter(map(tuple, near_duplicates(spark.createDataFrame([(i, t, "x") for i, t in [*rows, (None, "gone")]], "doc_id long, text string, component_id string").repartition(4)).collect()))
    assert got == brute(rows) and len({c for _, _, c in got}) < len(rows) - 40
    assert near_duplicates(docs).count() == len(docs_rows) and near_duplicates(no_docs).count() == 0


@pytest.mark.parametrize("radius,each,most", [(4, 16, 30), (2, 64, 100)])
def test_balls_against_all_pairs(spark, radius, each, most):
    """Random fingerprints, pairs at every distance up to radius + 2, chains, and a cluster that any leading bits leave together."""
    rng = random.Random(radius + most)
    flip = lambda p, n: p ^ sum(1 << b for b in rng.sample(range(64), n))
    prints = {0, (1 << 64) - 1, 1, 3, 7, 15, 31}
    for _ in range(60):
        p = rng.getrandbits(64)
        prints |= {p, *(flip(p, n) for n in range(radius + 3))}
    centre = p = rng.getrandbits(64)
    prints |= {flip(centre, rng.randrange(1, 4)) for _ in range(150)}
    for _ in range(30):
        prints.add(p := flip(p, radius))
    signed = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    distance = lambda a, b: ((a ^ b) % (1 << 64)).bit_count()
    links = [tuple(r) for r in ball_links(spark.createDataFrame([(p,) for p in signed], "print long"), radius, each, most).collect()]
    true = [(a, b) for k, a in enumerate(signed) for b in signed[k + 1 :] if distance(a, b) <= radius]
    assert joined(signed, links) == joined(signed, true)


def test_a_full_part_takes_little_memory():
    """As many fingerprints as a part may have, half of them close, a quarter in pairs: made and sorted in slices, with the links of all pairs."""
    import tracemalloc

    import numpy as np
    import pandas as pd

    from gleanwork.llm import simhash as S

    rng = np.random.default_rng(1)
    flipped = np.full(S.PART, 12345678901234, dtype=np.uint64)
    flipped[S.PART // 2 :] = np.repeat(rng.integers(0, 1 << 58, S.PART // 4, dtype=np.uint64), 2)
    for _ in range(3):
        flipped ^= np.uint64(1) << rng.integers(0, 58, S.PART).astype(np.uint64)
    part = pd.DataFrame({"print": flipped.view(np.int64), "variant": flipped.view(np.int64), "left": 2})
    tracemalloc.start()
    links = S._met(part, 6, 2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150 << 20, peak
    own = np.unique(flipped)
    low, high = np.nonzero(np.triu(np.bitwise_count(own[:, None] ^ own) <= 4, 1))
    true = joined(own.view(np.int64).tolist(), zip(own[low].view(np.int64).tolist(), own[high].view(np.int64).tolist(), strict=True))
    assert len(set(true.values())) > S.PART // 4 and joined(own.view(np.int64).tolist(), links[["a", "b"]].itertuples(index=False)) == true


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert Counter(map(tuple, op12_simhash_balls(spark, sf).select("doc_id", "fingerprint", "component_id").collect())) == brute(rows)
