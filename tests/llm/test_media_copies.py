import numpy as np
import pytest

from gleanwork.llm.media_copies import CELLS, SIDE, copies, rendered


def test_copies_of_rendered_pictures(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").where("vec_id < 200")
    got = copies(rendered(vectors)).toPandas().set_index("image_id")
    edited = [i for i in got.index if i % 10 == 1]
    assert len(got) == 200 and len(edited) == 20
    assert np.mean([got.component_id[i] == got.component_id[i - 1] for i in edited]) >= 0.9
    assert all(got.component_id[i] == i for i in got.index if i % 10 not in (0, 1))


def test_odd_images(spark):
    flat = bytes([7] * 400)
    noise = np.random.default_rng(0).integers(0, 256, 96 * 96, dtype=np.uint8).tobytes()
    rows = [(1, 20, 20, flat), (2, 20, 20, flat), (3, 20, 20, None), (4, 20, 20, None), (5, 30, 20, flat), (6, 0, 0, b""), (7, 96, 96, noise), (8, 96, 96, noise), (7, 96, 96, noise), (None, 1, 1, b"x")]
    got = sorted((r.image_id, r.class_id, r.component_id) for r in copies(spark.createDataFrame(rows, "image_id long, width int, height int, pixels binary")).collect())
    assert got == [(1, 1, 1), (2, 1, 1), (3, 3, 3), (4, 4, 4), (5, 5, 5), (6, 6, 6), (7, 7, 7), (7, 7, 7), (8, 7, 7)]
    assert copies(spark.createDataFrame([], "image_id long, width int, height int, pixels binary")).count() == 0


@pytest.mark.parametrize("shared", [1, 2])
def test_links_of_lists_connect_what_all_pairs_would(spark, shared):
    from gleanwork.llm.components import components, links_of_lists

    rng = np.random.default_rng(3)
    kind = rng.integers(0, 12, 80)
    lists = sorted({(int(k), int(n)) for k, n in zip(rng.integers(0, 25, 480), rng.integers(0, 80, 480), strict=True)})
    like = lambda pairs: pairs.join(kinds.toDF("a", "ka"), "a").join(kinds.toDF("b", "kb"), "b").where("ka = kb").select("a", "b")
    kinds = spark.createDataFrame([(n, int(k)) for n, k in enumerate(kind)], "node long, kind long")
    got = {r.node: r.root for r in components(links_of_lists(spark.createDataFrame(lists, "key long, node long"), like, "lists", shared)).collect()}

    root, of = list(range(80)), [{k for k, n in lists if n == node} for node in range(80)]
    for n in range(80):
        for m in range(n):
            if len(of[n] & of[m]) >= shared and kind[n] == kind[m] and root[n] != root[m]:
                low, high = sorted((root[n], root[m]))
                root = [low if r == high else r for r in root]
    assert len(set(root)) > 12
    assert [got.get(n, n) for n in range(80)] == root


def turned(p, grow=1.0, degrees=0.0):
    """The picture at another size and turn, between its pixels."""
    h, w = p.shape
    a, (y, x) = np.deg2rad(degrees), np.mgrid[0 : int(h * grow), 0 : int(w * grow)]
    y, x = (y - (y.shape[0] - 1) / 2) / grow, (x - (x.shape[1] - 1) / 2) / grow
    y, x = y * np.cos(a) - x * np.sin(a) + (h - 1) / 2, y * np.sin(a) + x * np.cos(a) + (w - 1) / 2
    top, left = np.clip(np.floor(y).astype(int), 0, h - 2), np.clip(np.floor(x).astype(int), 0, w - 2)
    v, u = np.clip(y - top, 0, 1), np.clip(x - left, 0, 1)
    return (p[top, left] * (1 - u) + p[top, left + 1] * u) * (1 - v) + (p[top + 1, left] * (1 - u) + p[top + 1, left + 1] * u) * v


def edited(p, rng):
    """Copies of a picture by the name of what was done to it."""
    n, patched = len(p), p.copy()
    patched[n // 3 : 2 * n // 3, n // 3 : 2 * n // 3] = rng.uniform(0, 255)
    return {
        "crop": p[n // 10 : -n // 16, n // 12 : -n // 14] * 0.8 + 20,
        "part": p[n // 5 : -n // 5, n // 5 : -n // 5],
        "half": turned(p, 0.5),
        "0.8": turned(p, 0.8),
        "1.3": turned(p, 1.3),
        "10 degrees": turned(p, 1, 10),
        "90 degrees": np.rot90(p),
        "noise": p + rng.normal(0, 15, p.shape),
        "patch": patched,
    }


def mosaics(n, rng, side=192, cells=16):
    return [np.kron(rng.uniform(0, 255, (cells, cells)), np.ones((side // cells,) * 2)) for _ in range(n)]


def frame(spark, pictures):
    whole = [np.clip(np.rint(p), 0, 255).astype(np.uint8) for p in pictures]
    return spark.createDataFrame([(k, p.shape[1], p.shape[0], p.tobytes()) for k, p in enumerate(whole)], "image_id long, width int, height int, pixels binary")


def test_recall_by_edit(spark):
    """Of 10 pictures of the query's size at least 9 copies of each kind meet their original, and no two pictures meet."""
    rng = np.random.default_rng(11)
    pictures, kinds, origin = [], [], []
    for k, p in enumerate(mosaics(10, rng, SIDE, CELLS)):
        for name, q in {"": p, **edited(p, rng)}.items():
            pictures.append(q)
            kinds.append(name)
            origin.append(10 * k)
    got = {r.image_id: r.component_id for r in copies(frame(spark, pictures)).collect()}
    found = {name: sum(got[i] == origin[i] for i in got if kinds[i] == name) for name in set(kinds) - {""}}
    assert len(found) == 9 and all(n >= 9 for n in found.values()), found
    assert all(origin[got[i]] == origin[i] for i in got)


def test_components_against_all_pairs(spark):
    """120 pictures, half of them edited copies: classes as from agreeing() over all pairs."""
    from gleanwork.llm import media_copies as M

    rng = np.random.default_rng(12)
    pictures = mosaics(60, rng, SIDE, CELLS)
    for k, p in enumerate(pictures[:60]):
        all_edits = edited(p, rng)
        pictures.append(all_edits[sorted(all_edits)[k % 9]])
    got = {r.image_id: r.component_id for r in copies(frame(spark, pictures)).collect()}
    found = [M.describe(np.clip(np.rint(p), 0, 255).astype(np.uint8)[None])[1:] for p in pictures]
    true = [(i, j) for i in range(120) for j in range(i) if M.agreeing(*found[i], *found[j]) >= M.INLIERS]
    assert len(true) >= 54 and all(i == j + 60 for i, j in true)
    met = np.mean([got[i] == got[j] for i, j in true])
    assert met >= 0.95, met
    linked = {i: j for i, j in true}
    assert all(got[i] in (i, linked.get(i, i)) for i in got)


def test_large_pictures(spark):
    """Of 1,024 px, with detail of several sizes: copies meet, others do not, and a pair takes neither long nor much memory."""
    import time
    import tracemalloc

    from gleanwork.llm import media_copies as M

    rng = np.random.default_rng(5)
    p, q = (sum(np.kron(rng.uniform(0, 64, (1024 // k,) * 2), np.ones((k, k))) for k in (8, 16, 32, 64)) for _ in range(2))
    kinds = edited(p, rng)
    of = {name: M.describe(np.clip(np.rint(x), 0, 255).astype(np.uint8)[None])[1:] for name, x in {"p": p, "q": q, **{k: kinds[k] for k in ("half", "part", "noise", "90 degrees")}}.items()}
    assert len(of["p"][0]) > 3000
    started = time.perf_counter()
    assert M.agreeing(*of["p"], *of["q"]) < M.INLIERS
    assert time.perf_counter() - started < 2
    assert all(M.agreeing(*of["p"], *of[k]) >= M.INLIERS for k in ("half", "part", "noise", "90 degrees"))
    tracemalloc.start()
    M.agreeing(*of["p"], *of["q"])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 << 20


def test_matches_by_parts_are_those_of_all_pairs(monkeypatch):
    from gleanwork.llm import media_copies as M

    rng = np.random.default_rng(6)
    a = rng.integers(0, 256, (300, 16), dtype=np.uint8)
    b = np.concatenate([a[:200], a[:50], rng.integers(0, 256, (20, 16), dtype=np.uint8)])
    for row in b:
        row[rng.integers(0, 16, 3)] ^= np.uint8(1 << rng.integers(0, 8))
    full = set(zip(*map(np.ndarray.tolist, M._near(a, b)), strict=True))
    monkeypatch.setattr(M, "MATRIX", 100)
    assert len(full) >= 250 and set(zip(*map(np.ndarray.tolist, M._near(a, b)), strict=True)) == full


def test_many_corners_match_by_the_same_rule_as_few():
    """Over MATRIX pairs, at every distance up to two over DISTANCE: all matches, as each row's own comparison gives them."""
    from gleanwork.llm import media_copies as M

    rng = np.random.default_rng(8)
    a = rng.integers(0, 256, (1100, M.BITS // 8), dtype=np.uint8)
    flips = np.zeros((1000, M.BITS), dtype=np.uint8)
    for k, row in enumerate(flips):
        row[rng.permutation(M.BITS)[: k % (M.DISTANCE + 3)]] = 1
    b = a[:1000] ^ np.packbits(flips, axis=1)
    assert len(a) * len(b) > M.MATRIX
    true = [(i, j) for i, row in enumerate(a) for j in np.flatnonzero(np.bitwise_count(row ^ b).sum(axis=1) <= M.DISTANCE)]
    assert len(true) >= 890 and list(zip(*map(np.ndarray.tolist, M._near(a, b)), strict=True)) == true


def test_other_columns_are_ignored(spark):
    noise = np.random.default_rng(0).integers(0, 256, 96 * 96, dtype=np.uint8).tobytes()
    rows = [(1, 96, 96, noise, 5, "x", 7), (2, 96, 96, noise, 6, None, 8)]
    got = copies(spark.createDataFrame(rows, "image_id long, width int, height int, pixels binary, class long, digest string, node long"))
    assert sorted((r.image_id, r.class_id, r.component_id) for r in got.collect()) == [(1, 1, 1), (2, 1, 1)]


def test_keys_meet_in_few_bytes_and_none_is_lost(spark, monkeypatch):
    """The pairs of classes that share a key are those of all codes, held as sets; a key takes under 6 bytes on its way."""
    import pandas as pd

    from gleanwork.llm import media_copies as M

    rng = np.random.default_rng(21)
    base = rng.integers(0, 256, (150, M.BITS // 8), dtype=np.uint8)
    bits = {n: np.concatenate([base[rng.permutation(150)[: rng.integers(0, 40)]], rng.integers(0, 256, (60, M.BITS // 8), dtype=np.uint8)]) for n in range(7, 107)}
    bits[200] = np.zeros((0, M.BITS // 8), np.uint8)
    drawn = M._drawn()
    of = {n: {(t, c) for row in np.unpackbits(b, axis=1) @ drawn for t, c in enumerate(row.tolist())} for n, b in bits.items()}
    true = {(n, m): k for n in of for m in of if n < m and (k := len(of[n] & of[m]))}
    rows = [(n, b.tobytes()) for n, b in bits.items()]
    monkeypatch.setattr(M, "BUCKET", 1000)
    monkeypatch.setattr(M, "CORNERS", 3000)
    lists = M.shared_keys(spark.createDataFrame([*rows, rows[0]], "class long, bits binary").repartition(3)).toPandas()
    assert not lists.duplicated().any()
    met = lists.merge(lists, on="key").query("node_x < node_y").groupby(["node_x", "node_y"]).size()
    assert len(true) > 2000 and met.to_dict() == true
    monkeypatch.setattr(M, "CORNERS", 200_000)
    dealt = list(M._dealt(iter([pd.DataFrame(rows, columns=["class", "bits"])]), 16))
    assert sum(len(x) for d in dealt for c in ("nodes", "sizes", "tokens") for x in d[c]) < 6 * sum(map(len, of.values()))


def test_slices_of_pairs_and_no_shuffle_files_stay(spark, monkeypatch):
    """Corners that go to their pairs in many slices give the same copies, and the steps leave no shuffle files behind."""
    import os
    import time

    from gleanwork.llm import media_copies as M

    manager = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()

    def shuffled():
        files = manager.getAllFiles()
        return {os.path.basename(files.apply(k).getPath()) for k in range(files.size()) if files.apply(k).getName().startswith("shuffle_")}

    rng = np.random.default_rng(22)
    pictures = mosaics(12, rng, SIDE, CELLS)
    images = frame(spark, [*pictures, *(edited(p, rng)["crop"] for p in pictures[:8])])
    want = {r.image_id: r.component_id for r in copies(images).collect()}
    assert [want[12 + k] for k in range(8)] == list(range(8))
    monkeypatch.setattr(M, "MOVED", 20_000)
    before = shuffled()
    keys = {k: spark.conf.get(k, None) for k in M.SETTINGS}
    got = copies(images)
    for _ in range(50):
        if not (left := shuffled() - before):
            break
        time.sleep(0.2)
    assert not left
    assert {k: spark.conf.get(k, None) for k in M.SETTINGS} == keys
    assert {r.image_id: r.component_id for r in got.collect()} == want
