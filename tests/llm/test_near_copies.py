from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
import xxhash

from cellarline.llm import embeddings, graph, simhash, substrings
from tests.llm.helpers import AWKWARD, documents, prose


def reachable(ids, links):
    root = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(root[a], root[b])
            changed |= root[a] != low or root[b] != low
            root[a] = root[b] = low
    return root


# Components


def test_components_of_paths_stars_and_loops(spark):
    random.seed(3)
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(300, 340)] + [(5, 5), (9, 8), (8, 9), (8, 9)]
    names = list(range(1000))
    random.shuffle(names)
    edges += [(2000 + names[i], 2000 + names[i + 1]) for i in range(300)] + [(None, 3)]
    got = {r["id"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    clean = [(a, b) for a, b in edges if a is not None and a != b]
    assert got == {k: v for k, v in reachable({x for e in clean for x in e}, clean).items()}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


# SimHash


def bits_of(text, n):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    parts = [b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint_as_written():
    for text in (None, "", " \n", "a", "A b C", "a b c d", "x y z w v", "Ä b c d e f g", prose(1, 90)):
        assert simhash.fingerprint(text, 4) == bits_of(text, 4)


@pytest.mark.parametrize(("radius", "blocks"), [(4, 2), (6, 3), (2, 1), (0, 1), (5, 4)])
def test_links_of_fingerprints(spark, radius, blocks):
    random.seed(radius)
    centres = [random.getrandbits(64) for _ in range(6)] + [0, (1 << 64) - 1, 1 << 63]
    fps = {c ^ sum(1 << b for b in random.sample(range(64), random.randrange(radius + 3))) for c in centres for _ in range(12)}
    fps = sorted(np.array(sorted(fps), np.uint64).view(np.int64).tolist())
    near = [(a, b) for a in fps for b in fps if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= radius]
    got = [(r["a"], r["b"]) for r in simhash.linked(spark.createDataFrame([(f,) for f in fps], "fp long"), radius, blocks).collect()]
    assert all(tuple(sorted(e)) in set(near) for e in got)
    assert reachable(fps, got) == reachable(fps, near)


def test_large_groups_across_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        fps = [sum(1 << b for b in pair) for pair in [(i, j) for i in range(12) for j in range(i)]]
        got = [(r["a"], r["b"]) for r in simhash.linked(spark.createDataFrame([(f,) for f in fps], "fp long"), 2, 2).collect()]
        near = [(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 2]
        assert reachable(fps, got) == reachable(fps, near)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_simhash_of_awkward_rows(spark):
    got = simhash.near_duplicates(documents(spark, AWKWARD), shingle=4).collect()
    assert sorted((r["id"] or 0, r["component"] or 0) for r in got) == [
        (0, 0), (1, 1), (2, 1), (3, 1), (4, 4), (5, 5), (6, 5), (6, 5), (7, 7)
    ]
    assert simhash.near_duplicates(documents(spark, [])).count() == 0


# Repeated passages


def removed(rows, window=50):
    """Kept words per row by brute force."""
    split = [(i, (t or "").encode().split()) for i, t in rows]
    least = {}
    for i, words in split:
        for k in range(len(words) - window + 1) if i is not None else ():
            key = tuple(words[k : k + window])
            least[key] = min(i, least.get(key, i))
    out = []
    for i, words in split:
        gone = set()
        for k in range(len(words) - window + 1) if i is not None else ():
            if least[tuple(words[k : k + window])] < i:
                gone.update(range(k, k + window))
        out.append((i, len(words), len(gone), b" ".join(w for k, w in enumerate(words) if k not in gone).decode()))
    return out


def passages():
    shared, random_ = prose(77, 60), random.Random(5)
    rows = [*AWKWARD, (8, prose(8, 49)), (9, prose(8, 49)), (10, prose(8, 50)), (11, prose(8, 50) + " tail")]
    rows += [(20 + k, f"{prose(500 + k, random_.randrange(40))} {shared} {prose(900 + k, random_.randrange(40))}") for k in range(12)]
    rows += [(40, "again " * 130), (41, "again " * 90 + prose(41, 30)), (3, prose(9, 120)[30:])]
    return rows


@pytest.mark.parametrize(("filter_bits", "hot_rows"), [(24, 1000), (6, 1000), (24, 0), (6, 0)])
def test_repeats_by_brute_force(spark, filter_bits, hot_rows):
    rows = passages()
    docs = documents(spark, rows).repartition(3)
    got = substrings.remove_repeats(docs, filter_bits=filter_bits, hot_rows=hot_rows).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[3])
    assert sorted(map(tuple, got), key=key) == sorted(removed(rows), key=key)


def test_small_windows_and_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        random.seed(4)
        rows = [(k, " ".join(random.choice("abc") for _ in range(random.randrange(60)))) for k in range(40)]
        got = substrings.remove_repeats(documents(spark, rows).repartition(4), window=6, anchor=2, hot_rows=5).collect()
        assert sorted(map(tuple, got)) == sorted(removed(rows, 6))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_substring_digest_and_empty_table(spark):
    got = {r["doc_id"]: r for r in substrings.substring_digest(documents(spark, [(1, prose(1, 55)), (2, prose(1, 55) + " end")])).collect()}
    assert got[2]["n_removed"] == 55 and got[2]["kept_sha256"] == hashlib.sha256(b"end").hexdigest()
    assert substrings.substring_digest(documents(spark, [])).count() == 0


# Embeddings


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def cosines(rows, threshold):
    clean = {}
    for i, (_, v, _) in enumerate(rows):
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, np.float32).astype(float)
            clean[i] = x / np.linalg.norm(x)
    return [(i, j) for i in clean for j in clean if i != j and len(clean[i]) == len(clean[j]) and clean[i] @ clean[j] >= threshold]


@pytest.mark.parametrize("block", [2048, 16])
def test_embedding_links(spark, block):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(60, 16))
    x = np.concatenate([base, base[:20] + rng.normal(size=(20, 16)) * 0.1, base[[3] * 40] + rng.normal(size=(40, 16)) * 0.05, base[:5]])
    rows = [(k, [float(z) for z in v], 0) for k, v in enumerate(x)]
    odd = [None, [], [0.0] * 16, [None] * 16, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [1.0] * 3]
    rows += [(200 + k, v, None) for k, v in enumerate(odd)]
    links = cosines(rows, 0.95)
    root = reachable(range(len(rows)), links)
    want = {rows[i][0]: (sum(a == i for a, _ in links), rows[root[i]][0]) for i in range(len(rows))}
    got = embeddings.near_vectors(vectors(spark, rows), leaf_rows=20, block=block, spill=0.1).collect()
    assert {r["id"]: (r["n_links"], r["component"]) for r in got} == want


@pytest.mark.parametrize(("leaf_rows", "block"), [(20, 16), (256, 2048)])
def test_every_length_has_its_links(spark, leaf_rows, block):
    rng = np.random.default_rng(18)
    rows = [(0, [1.0, 2.0, 3.0], 0), (1, [1.0], 0), (2, [5.0] * 300, 0)]
    for first, length, count in [(100, 16, 40), (200, 24, 40), (300, 3, 6)]:
        base = rng.normal(size=(count, length))
        x = np.concatenate([base, base + rng.normal(size=base.shape) * 0.05])
        rows += [(first + k, [float(z) for z in v], 0) for k, v in enumerate(x)]
    links = cosines(rows, 0.95)
    assert {len(rows[i][1]) for i, _ in links} == {3, 16, 24}
    root = reachable(range(len(rows)), links)
    want = {rows[i][0]: (sum(a == i for a, _ in links), rows[root[i]][0]) for i in range(len(rows))}
    got = embeddings.near_vectors(vectors(spark, rows), leaf_rows=leaf_rows, block=block, spill=0.1).collect()
    assert {r["id"]: (r["n_links"], r["component"]) for r in got} == want


def test_embeddings_without_vectors(spark):
    assert embeddings.embedding_links(vectors(spark, [])).count() == 0
    got = embeddings.embedding_links(vectors(spark, [(1, None, 1), (2, [0.0], 1)])).collect()
    assert [(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got] == [(1, 0, 1, True), (2, 0, 2, True)]


def test_forest_recall_against_brute_force():
    rng = np.random.default_rng(9)
    a = rng.normal(size=(4000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = a + rng.normal(size=a.shape) * 0.04
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    close = np.flatnonzero(np.einsum("ij,ij->i", a, b) >= 0.95)
    forest = embeddings.fit_forest(a, trees=8, depth=10, spill=0.03, seed=1)
    of = []
    for x in (a[close], b[close]):
        rows, leaves = embeddings.leaves_of(forest, x)
        of.append([set(leaves[rows == k].tolist()) for k in range(len(x))])
    assert len(close) > 500
    assert np.mean([bool(p & q) for p, q in zip(*of, strict=True)]) > 0.97


# Near copies by exact similarity


def jaccard(a, b):
    a, b = (set(simhash.shingle_hashes(t, 5).tolist()) for t in (a, b))
    return len(a & b) / len(a | b)


def planted(seed, copies):
    """Texts and copies of them with words replaced, from a similarity of 1 to well below 0.8."""
    rng, rows = random.Random(seed), []
    for k in range(copies):
        words = [f"v{rng.randrange(5000)}" for _ in range(rng.choice([30, 60, 150, 400]))]
        rows.append((10 * k, " ".join(words)))
        for c in range(3):
            other = list(words)
            for _ in range(rng.randrange(1, 2 + len(words) // 40)):
                other[rng.randrange(len(other))] = f"changed{rng.randrange(10**6)}"
            rows.append((10 * k + 1 + c, " ".join(other)))
    return rows


def test_candidates_are_all_pairs_once(spark):
    random.seed(11)
    centres = [random.getrandbits(64) for _ in range(5)]
    fps = sorted({c ^ sum(1 << b for b in random.sample(range(64), random.randrange(13))) for c in centres for _ in range(12)})
    rows = [(k, f - (1 << 64) if f >> 63 else f, random.choice([1, 7, 8, 9, 10, 100, 124, 125, 126]), k % 7) for k, f in enumerate(fps)]
    table = spark.createDataFrame(rows, "key long, fp long, n int, class long")
    for radius, blocks in [(14, 5), (6, 3), (9, 2), (3, 1)]:
        got = [tuple(sorted(r)) for r in simhash.candidates(table, radius, blocks, 0.8).collect()]
        want = [
            (a[0], b[0]) for a in rows for b in rows
            if a[0] < b[0] and a[3] != b[3] and ((a[1] ^ b[1]) & (1 << 64) - 1).bit_count() <= radius
            and min(a[2], b[2]) >= 0.8 * max(a[2], b[2])
        ]
        assert sorted(got) == sorted(want)


def test_copies_just_above_the_similarity_go(spark):
    rows = planted(12, 40)
    near = [(a, b) for a, s in rows for b, t in rows if a < b and a // 10 == b // 10 and jaccard(s, t) >= 0.8]
    narrow = [1 for a, b in near if jaccard(dict(rows)[a], dict(rows)[b]) < 0.9]
    root = reachable([i for i, _ in rows], near)
    got = {r["id"]: r["component"] for r in simhash.near_copies(documents(spark, rows)).collect()}
    assert all(root[i] == root[c] for i, c in got.items())  # nothing below 0.8 is linked
    missed = [i for i, _ in rows if got[i] != root[i]]
    assert len(narrow) > 20 and len(missed) <= 2
    old = {r["id"]: r["component"] for r in simhash.near_duplicates(documents(spark, rows), shingle=5, radius=6, blocks=3).collect()}
    assert sum(old[i] != root[i] for i, _ in rows) > 10


def test_near_copies_of_awkward_rows(spark):
    got = simhash.near_copies(documents(spark, AWKWARD)).collect()
    assert sorted((r["id"], r["component"]) for r in got) == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 5), (6, 5), (6, 5), (7, 7)]
    assert simhash.near_copies(documents(spark, [])).count() == 0


def test_repeated_and_null_ids_have_the_links_of_their_own_vector(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [1.0, 0.01], 0), (None, [1.0, 0.0], 0), (5, [1.0, 0.0], 0)]
    got = sorted(map(tuple, embeddings.near_vectors(vectors(spark, rows)).collect()))
    assert got == [(1, 2, 1), (1, 2, 1), (5, 2, 1)]
    rng = np.random.default_rng(5)
    base = rng.normal(size=(30, 8))
    x = np.concatenate([base, base + rng.normal(size=base.shape) * 0.08, base[:10]])
    rows = [(int(rng.integers(0, 25)), [float(z) for z in v], k) for k, v in enumerate(x)]
    links = cosines(rows, 0.95)
    root = {}
    for i in range(len(rows)):  # smallest id of all rows that the row's vector reaches
        seen, queue = {i}, [i]
        while queue:
            at = queue.pop()
            fresh = [b for a, b in links if a == at and b not in seen]
            seen.update(fresh)
            queue += fresh
        root[i] = min(rows[k][0] for k in seen)
    want = sorted((rows[i][0], sum(a == i for a, _ in links), root[i]) for i in range(len(rows)))
    got = embeddings.near_vectors(vectors(spark, rows).repartition(3), leaf_rows=16, spill=0.1, block=16).collect()
    assert sorted(map(tuple, got)) == want


@pytest.mark.parametrize("near", [0.12, 0.2])
def test_sampled_forest_finds_planted_pairs(spark, near, monkeypatch):
    """Thresholds from a part of the rows, three depths: recall of links against brute force is 0.9 at least."""
    monkeypatch.setattr(embeddings, "LENGTH_ROWS", 100)
    rng = np.random.default_rng(9)
    base = rng.normal(size=(700, 24))
    x = np.concatenate([base, base + rng.normal(size=base.shape) * near, base[:200] + rng.normal(size=(200, 24)) * 0.3])
    rows = [(k, [float(z) for z in v], 0) for k, v in enumerate(x)]
    unit = x.astype(np.float32).astype(float)
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    want = int((unit @ unit.T >= 0.95).sum()) - len(rows)
    assert want > 400
    for leaf_rows in (400, 100, 25):
        got = embeddings.near_vectors(vectors(spark, rows), leaf_rows=leaf_rows, sample_rows=200).collect()
        found = sum(r["n_links"] for r in got)
        print(near, leaf_rows, found / want)
        assert 0.9 * want <= found <= want


def test_repeated_ids_with_different_texts(spark):
    a, b = prose(1, 80), prose(2, 80)
    rows = [(3, a), (6, a), (6, b), (9, b), (None, a)]
    got = sorted((r["id"] or 0, r["component"] or 0) for r in simhash.near_duplicates(documents(spark, rows)).collect())
    assert got == [(0, 0), (3, 3), (6, 3), (6, 6), (9, 6)]
    # Two texts whose smallest id is the same are two groups still.
    rows = [(6, a), (7, a), (6, b), (8, b)]
    got = {(r["id"], r["fp"]): r["component"] for r in simhash.near_duplicates(documents(spark, rows)).collect()}
    assert set(got.values()) == {6} and len(got) == 4
    got = sorted((r["id"], r["component"]) for r in simhash.near_copies(documents(spark, [(3, a), (6, a), (6, b), (9, b)])).collect())
    assert got == [(3, 3), (6, 3), (6, 6), (9, 6)]
