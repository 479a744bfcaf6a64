from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from cellarline.llm import lines
from tests.llm.helpers import AWKWARD, documents, prose


def kept_lines(rows, permille):
    """Texts after removing every line that repeats an earlier one, by brute force."""
    places = []
    for i, t in rows:
        if i is not None and t:
            places += [(i, n, frozenset(line.encode().split())) for n, line in enumerate(t.split("\n"))]
    places = [p for p in places if p[2]]

    def gone(i, n, words):
        for j, m, other in places:
            if (j, m) < (i, n):
                common = len(words & other)
                if 1000 * common >= permille * (len(words) + len(other) - common):
                    return True
        return False

    out = []
    for i, t in rows:
        if i is None or not t:
            out.append((i, t))
            continue
        parts = t.split("\n")
        stay = [p for n, p in enumerate(parts) if not p.split() or not gone(i, n, frozenset(p.encode().split()))]
        out.append((i, "\n".join(stay)))
    return out


def near_lines():
    rng = random.Random(11)
    base = [prose(k, rng.randrange(1, 40)) for k in range(25)]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(rng.randrange(1, 6)):
            words = rng.choice(base).split(" ")
            for _ in range(rng.randrange(3)):
                words[rng.randrange(len(words))] = rng.choice(["new", "the", f"v{rng.randrange(9)}"])
            if rng.random() < 0.3:
                rng.shuffle(words)
            parts.append(rng.choice(["", " ", "\t"]) + "  ".join(words) + rng.choice(["", "\r"]))
        rows.append((i * 3, rng.choice(["\n", "\n\n"]).join(parts)))
    return rows


@pytest.mark.parametrize("similarity", [0.8, 0.5, 1.0])
def test_lines_by_brute_force(spark, similarity):
    rows = [*near_lines(), *((i and i + 1000, t) for i, t in AWKWARD)]
    got = lines.dedup_lines(documents(spark, rows).repartition(3), similarity=similarity).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    want = sorted(kept_lines(rows, round(similarity * 1000)), key=key)
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=key) == want


def test_group_of_like_lines_is_settled_by_its_hub(spark, monkeypatch):
    """2,000 near-equal lines: as many pairs as lines, not two million."""
    rng, base = random.Random(4), prose(1, 60).split(" ")
    rows = []
    for k in range(2000):
        words = list(base)
        words[rng.randrange(60)] = f"only{k}"
        rows.append((k, " ".join(words)))
    seen = {}
    plain = lines.stored
    monkeypatch.setattr(lines, "stored", lambda df, name: seen.setdefault(name, plain(df, name)))
    assert lines.dedup_lines(documents(spark, rows).repartition(4)).where("_lines_removed = 1").count() == 1999
    assert seen["hub-pairs"].count() <= 4000 and seen["line-pairs"].count() <= 2000


def test_long_lines_that_differ_are_no_pairs(spark, monkeypatch):
    """60 lines of 150 from the same 600 words: 64 bits of signature let hundreds of their pairs through."""
    rng = random.Random(5)
    rows = [(k, " ".join(rng.sample([f"w{n}" for n in range(600)], 150))) for k in range(60)]
    seen = {}
    plain = lines.stored
    monkeypatch.setattr(lines, "stored", lambda df, name: seen.setdefault(name, plain(df, name)))
    assert lines.dedup_lines(documents(spark, rows)).where("_lines_removed > 0").count() == 0
    assert seen["hub-pairs"].count() <= 10 and seen["line-pairs"].count() <= 10


def test_like_lines_on_both_sides_of_the_signature_border(spark):
    rng = random.Random(6)
    base = [[f"b{k}x{n}" for n in range(rng.randrange(lines.LONG - 8, lines.LONG + 60))] for k in range(6)]
    rows = []
    for i in range(60):
        words = list(rng.choice(base))
        rng.shuffle(words)
        rows.append((i, " ".join(words[rng.randrange(16) :] + [f"new{i}y{n}" for n in range(rng.randrange(8))])))
    got = sorted((r["doc_id"], r["text"]) for r in lines.dedup_lines(documents(spark, rows).repartition(3)).collect())
    assert got == kept_lines(rows, 800)
    assert 10 < sum(not t for _, t in got) < 60


@pytest.mark.parametrize("similarity", [0.8, 0.5])
def test_index_prefix_of_the_smaller_set_finds_all(spark, monkeypatch, similarity):
    """Without hubs every pair has to come from the join of index prefixes with prefixes."""
    plain = lines.hub_pairs
    monkeypatch.setattr(lines, "hub_pairs", lambda posts, permille: plain(posts, permille).where("false"))
    rng = random.Random(8)
    base = [[f"b{k}x{n}" for n in range(rng.randrange(2, 90))] for k in range(8)]
    rows = []
    for i in range(80):
        words = list(rng.choice(base))
        rng.shuffle(words)
        rows.append((i, " ".join(words[rng.randrange(1 + len(words) // 4) :] + [f"new{i}y{n}" for n in range(rng.randrange(5))])))
    got = sorted((r["doc_id"], r["text"]) for r in lines.dedup_lines(documents(spark, rows).repartition(3), similarity=similarity).collect())
    assert got == kept_lines(rows, round(similarity * 1000))
    ends = {n: spark.range(1).selectExpr(f"{lines.index_end(str(n), 800)} AS e").first()["e"] for n in (1, 9, 100)}
    assert ends == {1: 1, 9: 2, 100: 12}


def test_tokens_are_sorted_as_longs(spark):
    """An array that may hold nulls is sorted as objects."""
    docs = documents(spark, [(1, "a b\tc\rd a\nb e")]).selectExpr("doc_id AS id", "text")
    ranks = lines.rarity_ranks(docs)
    keys = lines.exploded(docs).select(lines.by_rarity(lines.token_set(F.col("line")), ranks).alias("keys"))
    assert not keys.schema["keys"].dataType.containsNull
    assert sorted(len(r["keys"]) for r in keys.collect()) == [2, 4]


def test_tokens_of_few_sets_have_no_hub(spark, monkeypatch):
    """Three like lines need no hub; 40 that share a rare token have one."""
    trio = [(k, " ".join(f"t{n}" for n in range(20)) + f" only{k}") for k in range(3)]
    rows = [*trio, *((100 + k, " ".join(["shared", *(f"o{k}x{n}" for n in range(3 + k))])) for k in range(lines.FEW + 8))]
    seen = {}
    plain = lines.stored
    monkeypatch.setattr(lines, "stored", lambda df, name: seen.setdefault(name, plain(df, name)))
    got = sorted((r["doc_id"], r["text"]) for r in lines.dedup_lines(documents(spark, rows).repartition(3)).collect())
    assert got == kept_lines(rows, 800) and [t for _, t in got[:3]] == [trio[0][1], "", ""]
    firsts = [r["k"] for r in seen["hub-pairs"].collect()]
    assert not firsts and seen["hubs"].count() <= 1


@pytest.mark.parametrize("most", [0, 1 << 19])
def test_hubs_are_broadcast_or_joined(spark, monkeypatch, most):
    monkeypatch.setattr(lines, "FEW", 1)
    monkeypatch.setattr(lines, "BROADCAST_HUBS", most)
    rows = near_lines()
    got = sorted((r["doc_id"], r["text"]) for r in lines.dedup_lines(documents(spark, rows).repartition(3)).collect())
    assert got == kept_lines(rows, 800)


@pytest.mark.parametrize("bits", [62, 0])
def test_numbers_of_sets_grow_with_their_places(spark, monkeypatch, bits):
    """Packed from id and line, or from a sort; ids may be negative or far apart."""
    monkeypatch.setattr(lines, "NUMBER_BITS", bits)
    for near in (-90, -(1 << 63)):
        ids = {i: i + near if i < 90 else i for i, _ in near_lines()}
        rows = [(ids[i], t) for i, t in near_lines()]
        docs = documents(spark, rows).repartition(3).selectExpr("doc_id AS id", "text")
        sets = lines.exploded(docs).where("line <> ''").select("id", "line_no")
        places = lines.numbered(docs, sets, sets).orderBy("k").collect()
        assert [(r["id"], r["line_no"]) for r in places] == sorted((r["id"], r["line_no"]) for r in places)
        assert len({r["k"] for r in places}) == len(places)
        got = sorted((r["doc_id"], r["text"]) for r in lines.dedup_lines(documents(spark, rows).repartition(3)).collect())
        assert got == sorted(kept_lines(sorted(rows), 800))
    twice = spark.createDataFrame([(1, 0, "a"), (1, 0, "b"), (2, 0, "c")], "id long, line_no int, text string")
    assert lines.numbered(twice, twice, twice).select("k").distinct().count() == 3


def test_clashing_names_stay(spark):
    docs = documents(spark, [(1, "a b\nc"), (2, "b a")])
    names = ["_gone", "_gone_id", "_lines", "_lines_removed", "lh", "line_no", "set", "first"]
    for name in names:
        docs = docs.withColumn(name, docs["k"])
    got = lines.dedup_lines(docs)
    assert got.columns == [*docs.columns, "_lines_", "_lines_removed_"]
    assert [(r["text"], r["_lines"], r["_lines_removed_"]) for r in got.orderBy("doc_id").collect()] == [("a b\nc", "clash", 0), ("", "clash", 1)]


def test_documents_are_joined_where_names_are_too_many(spark, monkeypatch):
    rows = near_lines()
    want = sorted(map(tuple, lines.line_digest(documents(spark, rows)).collect()))
    monkeypatch.setattr(lines, "BROADCAST_SETS", 0)
    assert sorted(map(tuple, lines.line_digest(documents(spark, rows)).collect())) == want


def test_columns_stay_and_counts(spark):
    got = lines.dedup_lines(documents(spark, [(1, "a b\nc\n\nb a"), (2, "c"), (3, None), (4, "")]))
    assert got.columns == [*documents(spark, []).columns, "_lines", "_lines_removed"]
    rows = {r["doc_id"]: (r["text"], r["_lines"], r["_lines_removed"], r["node"]) for r in got.collect()}
    assert rows == {1: ("a b\nc\n", 4, 1, "clash"), 2: ("", 1, 1, "clash"), 3: (None, 0, 0, "clash"), 4: ("", 1, 0, "clash")}
    assert lines.dedup_lines(documents(spark, [])).count() == 0
    with pytest.raises(ValueError):
        lines.dedup_lines(documents(spark, []), similarity=0)


def test_main_path_is_native(spark):
    plan = lines.dedup_lines(documents(spark, near_lines()))._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))
