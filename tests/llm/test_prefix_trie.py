import hashlib
import random
import re
import zlib
from collections import Counter

import oracle
import pytest
from gleanwork.llm.prefix_trie import ORACLE, Queue, ends_digests, op13_prefix_trie, prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth string"


def brute(rows):
    own = {}
    for c, turn, role, text in sorted(((c, -(10**9) if t is None else t, r or "", x or "") for c, t, r, x in rows if c is not None)):
        own.setdefault(c, []).append((role, text))
    members, ends = {}, {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        first = c - (c % 20 if c >= 0 else -(-c % 20))
        new = [*own.get(first, [])[:h], *turns[h:]]
        for d in range(len(new) + 1):
            members.setdefault(tuple(new[:d]), []).append(c)
        ends.setdefault(tuple(new), []).append(c)
    kids, leaves, saved = Counter(k[:-1] for k in members if k), Counter(), Counter()
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not kids[k]
            saved[k[:d]] += (len(m) - 1) * len(re.findall("[^\x20\x09-\x0d]+", k[-1][1])) if k else 0
    sha = lambda k: hashlib.sha256(",".join(map(str, sorted(ends.get(k, [])))).encode()).hexdigest()
    return Counter((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), kids[k], leaves[k], saved[k], sha(k)) for k, m in members.items())


def check(spark, rows, **more):
    got = prefix_trie(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(4), **more)
    assert Counter(map(tuple, got.collect())) == brute(rows)


@pytest.fixture(scope="module")
def rows():
    """Shared beginnings, equal conversations, gaps, null and equal turns, repeated rows, a missing first one, negative ids, a long one."""
    rng = random.Random(3)
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"text {rng.randrange(3)} of {t % 3}") for c in [*range(0, 130), -25, -20, -3] if c not in (40, 77) for t in range(rng.randrange(1, 7))]
    rows += [(300, t, "user", f"long {t}") for t in range(260)] + [(301, t, "user", f"long {t}") for t in range(258)]
    rows += [(400, None, None, None), (400, None, "user", "b  b"), (400, 1, "user", None), (401, 0, "", ""), (401, 0, "", ""), (None, 0, "user", "gone"), (405, 2, "z", "a"), (405, 2, "a", "z")]
    return rows


@pytest.mark.parametrize("more", [{}, {"tier": 3, "held": 2}])
def test_against_brute_force(spark, rows, more):
    check(spark, rows, **more)


def test_few_and_none(spark):
    check(spark, [(0, 0, "user", "a b")])
    check(spark, [(5, 0, "user", "a b"), (8, 0, "user", "c")])
    assert prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0


def test_queue_spills():
    rng = random.Random(1)
    queue, left = Queue(7), []
    for _ in range(3000):
        if rng.random() < 0.6 or not left:
            x = (rng.randrange(500), rng.randrange(9))
            queue.push(x)
            left.append(x)
        else:
            assert queue.least()[:1] == min(left)[:1]
            x = queue.pop()
            assert x[0] == min(left)[0]
            left.remove(x)
    assert sorted(queue.pop() for _ in range(len(left))) == sorted(left) and queue.least() is None


def test_many_ends_of_a_node(spark):
    """More ids than a chunk holds, over several ranges."""
    ids = spark.range(-5, 60_000).selectExpr("0l as depth", "id % 2 as k1", "0l as k2", "id as conv_id")
    want = {k: hashlib.sha256(",".join(str(i) for i in range(-5, 60_000) if abs(i) % 2 * (1 if i > 0 else -1) == k).encode()).hexdigest() for k in (-1, 0, 1)}
    assert {r.k1: r.ends_sha256 for r in ends_digests(ids).collect()} == want


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    assert oracle.difference(op13_prefix_trie(spark, sf), oracle.connect(sf), ORACLE) == ""
