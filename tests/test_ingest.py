"""CSV records over many splits, and appends that break off."""

from __future__ import annotations

import csv
import io
import random

import pytest

from cellarline.sources.csvscan import read_cells, read_records
from cellarline.sources.storage import clean_up as clean_up_table
from cellarline.sources.storage import versions
from cellarline.streaming import transactional
from cellarline.streaming.incremental import append_new


def some_text(seed: int, rows: int) -> str:
    rng = random.Random(seed)
    pieces = ["a", 'say "b"', "line\nbreak", "x,y", "", "two\n\nbreaks", "ends\r\n", '"', "é" * 40]
    out = io.StringIO()
    writer = csv.writer(out, lineterminator=rng.choice(["\n", "\r\n"]))
    for n in range(rows):
        writer.writerow([n, "".join(rng.choice(pieces) for _ in range(rng.randrange(4))), rng.choice(pieces)])
    return out.getvalue()


@pytest.fixture
def small_splits(spark):
    settings = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "1"}
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield
    for key in settings:
        spark.conf.unset(key)


@pytest.mark.parametrize("seed", range(3))
def test_records_over_many_splits(spark, tmp_path, small_splits, seed):
    texts = [some_text(10 * seed + k, 120) for k in range(3)]
    for k, text in enumerate(texts):
        (tmp_path / f"part-{k}.csv").write_text(text, encoding="utf-8", newline="")
    want = [row for text in texts for row in csv.reader(io.StringIO(text, newline=""))]
    assert spark.read.text(str(tmp_path), lineSep="\n").rdd.getNumPartitions() > 20
    sheet = read_cells(spark, str(tmp_path), 3)
    got = {r["row_no"]: [r["c1"], r["c2"] or "", r["c3"] or ""] for r in sheet.collect()}
    assert [got[n] for n in range(1, len(want) + 1)] == want and len(got) == len(want)
    sink = f"{tmp_path}/../sink-{seed}"
    for part in (sheet.where("row_no <= 100"), sheet, sheet):
        append_new(part, sink)
    assert sorted(r["row_no"] for r in spark.read.parquet(sink).collect()) == list(range(1, len(want) + 1))


def test_one_record_over_all_splits(spark, tmp_path, small_splits):
    body = "\n".join(f"line {n}" for n in range(400))
    (tmp_path / "a.csv").write_text(f'1,"{body}"\n\n2,x\n', encoding="utf-8")
    got = {r["row_no"]: r["record"] for r in read_records(spark, str(tmp_path)).collect()}
    assert got == {1: f'1,"{body}"', 2: "", 3: "2,x"}


def test_open_quotes_are_an_error(spark, tmp_path):
    (tmp_path / "a.csv").write_text('1,"x\n2,y\n')
    with pytest.raises(ValueError, match="a.csv ends inside quotes"):
        read_records(spark, str(tmp_path))
    (tmp_path / "a.csv").write_text("")
    assert read_records(spark, str(tmp_path)).count() == 0


def ids(spark, sink, schema):
    return sorted(r["id"] for r in transactional.read_committed(spark, sink, schema).collect())


def test_a_run_that_dies_leaves_each_row_once(spark, tmp_path, monkeypatch):
    source, sink = str(tmp_path / "drops"), str(tmp_path / "sink")
    drop = spark.range(40)
    run = lambda: transactional.append_source(spark, source, drop.schema, sink)
    drop.coalesce(1).write.parquet(source)

    # Between the rows and the ledger.
    whole = transactional._write_ledger
    monkeypatch.setattr(transactional, "_write_ledger", lambda *_: 1 / 0)
    with pytest.raises(Exception, match="ZeroDivisionError"):
        run()
    assert ids(spark, sink, drop.schema) == []
    monkeypatch.setattr(transactional, "_write_ledger", whole)
    assert run() == 40 and ids(spark, sink, drop.schema) == list(range(40))

    # Between the ledger and the stream's checkpoint.
    drop.selectExpr("id + 40 AS id").coalesce(1).write.mode("append").parquet(source)

    def then_die(*args):
        whole(*args)
        raise RuntimeError("power cut")

    monkeypatch.setattr(transactional, "_write_ledger", then_die)
    with pytest.raises(Exception, match="power cut"):
        run()
    monkeypatch.setattr(transactional, "_write_ledger", whole)
    assert run() == 80 and run() == 80
    assert ids(spark, sink, drop.schema) == list(range(80))
    entries = transactional.ledger(spark, sink)
    assert [(e.first_row, e.n) for e in entries] == [(1, 40), (41, 40)]

    # The folder that nobody names goes, the others stay.
    assert transactional.clean_up(spark, sink) == []
    assert len(transactional.clean_up(spark, sink, older_than=0)) == 1
    assert ids(spark, sink, drop.schema) == list(range(80))


def test_small_batches_are_compacted(spark, tmp_path):
    sink, schema = str(tmp_path / "sink"), spark.range(1).schema
    for batch in range(12):
        assert transactional.commit_batch(spark.range(batch * 10, batch * 10 + 10), batch, sink)
    assert not transactional.commit_batch(spark.range(5), 11, sink)
    before = transactional.read_committed(spark, sink, schema)
    assert transactional.compact(spark, sink, schema, least=20) == 0
    assert transactional.compact(spark, sink, schema) == 11
    (entry,) = transactional.ledger(spark, sink)
    assert (entry.first_batch, entry.last_batch, entry.first_row, entry.n) == (0, 11, 1, 120)
    assert ids(spark, sink, schema) == list(range(120)) and before.count() == 120
    assert len(transactional.read_committed(spark, sink, schema).inputFiles()) == 1
    assert not transactional.commit_batch(spark.range(5), 7, sink)
    assert transactional.commit_batch(spark.range(120, 130), 12, sink)
    transactional.clean_up(spark, sink, keep=1, older_than=0)
    clean_up_table(spark, f"{sink}/ledger", keep=1, older_than=0)
    assert len(versions(spark, f"{sink}/ledger")) == 1 and ids(spark, sink, schema) == list(range(130))


def test_large_batches_are_left_alone(spark, tmp_path):
    sink, schema = str(tmp_path / "sink"), spark.range(1).schema
    for batch, n in enumerate([10, 10, 10_000, 10, 10]):
        transactional.commit_batch(spark.range(n), batch, sink)
    assert transactional.compact(spark, sink, schema, file_bytes=10_000, least=2) == 2
    assert [(e.first_batch, e.last_batch) for e in transactional.ledger(spark, sink)] == [(0, 1), (2, 2), (3, 4)]


def test_report_has_the_message(spark):
    def broken():
        raise ValueError("no such sheet")

    got = transactional.sync_report(spark, {"a": broken, "b": lambda: 3}).collect()
    assert [tuple(r) for r in got] == [("a", "error", None, "ValueError: no such sheet"), ("b", "ok", 3, None)]
