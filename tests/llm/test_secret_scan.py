import random
import re

from gleanwork.llm.secret_scan import BASE, RULES, Rule, find, linked_rows, redact, scan, starts_automaton


def brute(text, rules):
    data = text.encode()
    spans = [(m.start(), i, m.end()) for i, r in enumerate(rules) for m in re.finditer(r.regex.encode(), data) if len(m.group(r.group)) >= r.least]
    return [(rules[i].kind, len(data[:a].decode()), len(data[:b].decode())) for a, i, b in sorted(spans)]


def test_random_texts(spark):
    rng = random.Random(5)
    bits = ["password", "PassWd", "token", "api_key", "apikey", "secret", ":", "=", " ", "'", '"', "AKIA", "ABCD1234", "0123456789ab", "deadbeef", "é", "日本", "x", ".", "ghp_", "a1B2" * 10, "xoxb-", "Bearer ", "\n", "-----BEGIN RSA PRIVATE KEY-----"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randrange(40)))) for i in range(600)]
    rows += [(600, None), (601, ""), (602, "password=token: abcdef"), (603, "token==abcdef"), (604, "a" * 100_000 + "0" * 24)]
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: brute(t or "", RULES) for i, t in rows}


def test_automaton_of_other_rules():
    rules = [Rule("a", "ab*c|a(bd)+", 0, 1), Rule("b", "[^b]b?c{2,3}", 0, 1)]
    start, compiled = linked_rows(*starts_automaton([r.regex for r in rules])), [(r, re.compile(r.regex.encode())) for r in rules]
    rng = random.Random(2)
    for _ in range(500):
        data = "".join(rng.choice("abcd") for _ in range(20)).encode()
        want = sorted((m.start(), i, m.end()) for i, (_, x) in enumerate(compiled) for m in x.finditer(data))
        assert find(data, start, compiled) == want


def test_minimal():
    """Minimisation leaves one state for each of what the rules still have to see."""
    moves, accepts = starts_automaton(["aaa", "aaa"])
    assert moves.shape == (4, 256) and sorted(accepts.tolist()) == [0, 0, 0, 3]


def test_redaction_keeps_all_columns(spark, docs, no_docs):
    assert redact(docs).columns == docs.columns and sorted(map(str, redact(docs).collect())) == sorted(map(str, docs.collect()))
    row = spark.createDataFrame([(1, "my password = hunter22 and more"), (2, None)], "doc_id long, text string")
    assert {r.doc_id: r.text for r in redact(row).collect()} == {1: "my [assign] and more", 2: None}
    assert scan(no_docs, BASE).count() == 0
