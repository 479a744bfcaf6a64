"""Occurrences of repeated keys, pages from an order index, search by pieces of three characters."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from cellarline.plans.pages import OrderIndex, SubstringIndex
from cellarline.sources.matching import match_occurrences, number_occurrences


def test_numbers_of_a_hot_key_run_over_tasks(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        check_numbers(spark)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def check_numbers(spark):
    df = spark.range(3000).select(F.col("id").alias("row"), F.when(F.col("id") % 3 < 2, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 7)).alias("key"))
    got = number_occurrences(df.repartition(5), "key", ["row"])
    # The hot key has two thirds of all rows and is spread over tasks by the sort.
    parts = got.where("key = 'hot'").select(F.spark_partition_id().alias("p")).distinct().count()
    found = defaultdict(list)
    for r in got.collect():
        found[r["key"]].append((r["row"], r["n"]))
    assert parts > 1 and len(found["hot"]) == 2000
    for rows in found.values():
        assert [n for _, n in sorted(rows)] == list(range(1, len(rows) + 1))


@pytest.mark.parametrize("seed", range(2))
def test_matching_by_brute_force(spark, seed):
    rng = random.Random(seed)
    keys = ["a"] * 6 + ["b", "c", "d", "", None]
    sales = [(k, rng.choice(keys)) for k in range(200)]
    moves = [(k, rng.choice(keys[2:]), k * 1.5) for k in range(170)]
    by_key = defaultdict(lambda: ([], []))
    for row, key in sales:
        by_key[key][0].append(row)
    for row, key, cost in moves:
        by_key[key][1].append((row, cost))
    want = []
    for key, (left, right) in by_key.items():
        if not key:
            want += [(key, None, row, None, None, "sin movimiento") for row in left]
            want += [(key, None, None, row, cost, "sin venta") for row, cost in right]
            continue
        for n in range(max(len(left), len(right))):
            row = left[n] if n < len(left) else None
            move, cost = right[n] if n < len(right) else (None, None)
            want.append((key, n + 1, row, move, cost, "sin movimiento" if move is None else "sin venta" if row is None else "emparejado"))
    s = spark.createDataFrame(sales, "venta long, clave string").repartition(3)
    m = spark.createDataFrame(moves, "movimiento long, clave string, costo double").repartition(4)
    got = match_occurrences(s, m, "clave", ["venta"], ["movimiento"], ["venta"], ["movimiento", "costo"])
    assert got.columns == ["clave", "n", "venta", "movimiento", "costo", "estado"]
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)


def test_pages_read_one_or_two_blocks(spark, tmp_path):
    index = OrderIndex(spark, str(tmp_path / "pages"))
    rows = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") * 7 % 100).alias("v"))
    index.write(rows, [F.desc("v"), F.asc("k")], block_rows=64)
    want = [(r["k"], r["v"]) for r in rows.orderBy(F.desc("v"), "k").collect()]
    for number, size in ((1, 50), (2, 50), (20, 50), (7, 13), (334, 3), (21, 50), (99, 99)):
        page = index.page(number, size)
        got = [(r["k"], r["v"]) for r in page.collect()]
        assert got == want[(number - 1) * size : number * size]
        assert len(page.inputFiles()) <= 2
    # The first and the last page read equally many rows.
    read = [spark.read.parquet(*index.page(n, 8).inputFiles()).count() for n in (1, 120)]
    assert read == [64, 64]
    assert [r["puesto"] for r in index.after(998, 50).collect()] == [999, 1000]
    index.write(rows.where("k < 5"), [F.asc("k")], block_rows=2)
    assert [r["k"] for r in index.page(1, 9).collect()] == [0, 1, 2, 3, 4]
    index.write(rows.where("false"), [F.asc("k")])
    assert index.page(1, 9).collect() == [] and index.page(1).columns == ["k", "v", "puesto"]
    with pytest.raises(ValueError):
        index.page(0)
    with pytest.raises(ValueError):
        OrderIndex(spark, str(tmp_path / "none")).page(1)


def test_search_by_brute_force(spark, tmp_path):
    rng = random.Random(3)
    names = ["".join(rng.choice("abÁc ñ%_") for _ in range(rng.randrange(12))) for _ in range(300)]
    rows = [(k, name, rng.choice(names + [None])) for k, name in enumerate(names)]
    index = SubstringIndex(spark, str(tmp_path / "search"), ["a", "b"])
    index.write(spark.createDataFrame(rows, "k long, a string, b string").repartition(3))
    for needle in ["", "a", "bÁ", "abá", "c ñ", "AB%", "_ab", "aaaa", "áááá", *[n[:5] for n in names[:12]]]:
        want = {k for k, a, b in rows if needle.lower() in a.lower() or (b is not None and needle.lower() in b.lower())}
        assert {r["k"] for r in index.search(needle).collect()} == want, needle
    assert index.search("abc").columns == ["k", "a", "b"]


def test_search_reads_the_folders_of_its_pieces(spark, tmp_path):
    index = SubstringIndex(spark, str(tmp_path / "search"), ["a"])
    index.write(spark.range(5000).select(F.sha2(F.col("id").cast("string"), 256).alias("a")))
    found = index._candidates(["abc", "bcd"])
    pieces = spark.read.parquet(*found.inputFiles()).count()
    # All rows have 62 pieces of about 4,096 different ones; two folders of 64 hold a thirtieth of them.
    assert len({f.split("carpeta=")[1].split("/")[0] for f in found.inputFiles()}) <= 2
    assert 0 < pieces < 5000 * 62 / 16
