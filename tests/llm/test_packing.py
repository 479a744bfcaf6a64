from __future__ import annotations

import os
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cellarline.llm import packing
from tests.conftest import DATA
from tests.llm.helpers import AWKWARD, documents, prose


def by_the_rule(lengths, size):
    """The gaps of all sequences after placing the lengths one by one, trying every gap."""
    gaps = []
    for length in lengths:
        def squares(all_gaps):
            open_ = [g for g in all_gaps if g]
            return sum(open_.count(g) ** 2 for g in set(open_))

        tries = [(squares([*gaps[:at], gap - length, *gaps[at + 1 :]]), gap, at) for at, gap in enumerate(gaps) if gap >= length]
        if tries:
            gaps[min(tries, key=lambda t: t[:2])[2]] -= length
        else:
            gaps.append(size - length)
    return sorted(gaps)


def test_rule_by_brute_force():
    rng = random.Random(3)
    for size in (5, 10, 16):
        for _ in range(30):
            lengths = [rng.randrange(1, size + 1) for _ in range(40)]
            got = packing.sum_of_squares(lengths, size)
            assert sorted(k for s in got for k in s) == list(range(40))
            assert sorted(size - sum(lengths[k] for k in s) for s in got) == by_the_rule(lengths, size)


def test_few_sequences():
    rng = np.random.default_rng(1)
    for lengths in (rng.integers(1, 1025, 5000), rng.integers(1, 400, 5000), np.full(100, 600), np.full(100, 1024)):
        found = packing.packed(lengths, 1024)
        assert all(lengths[s].sum() <= 1024 for s in found)
        assert sorted(k for s in found for k in s) == list(range(len(lengths)))
        least = max(-(-int(lengths.sum()) // 1024), int((lengths > 512).sum()))
        assert len(found) <= 1.01 * least + 2
    assert packing.packed(np.zeros(0, np.int64), 1024) == []


def expected_ids(texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    return [[*e.ids, packing.END] for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_ids_are_those_of_the_library(monkeypatch):
    texts = ["", "a", "Hello  world\n\n x's don't 12,5 ½ naïve 日本語 ​\x1c é\t ", "  lead", "trail  ", " \n \n", "<|endoftext|> a"]
    texts += [prose(5, 300), "a b\nc  d\x1fe f 1 2 " * 20]
    encode = packing.encoder(packing.ranks_of(public_tokenizers.path("byte_bpe_50k.json"))).encode_ordinary
    for part in (1 << 20, 7):
        monkeypatch.setattr(packing, "PART", part)
        assert [[i for p in packing.parts_of(t) for i in encode(p)] + [packing.END] for t in texts] == expected_ids(texts)


def test_pieces():
    assert packing.piece_starts(1024, 1024).tolist() == [0]
    assert packing.piece_starts(1025, 1024).tolist() == [0, 1]
    assert packing.piece_starts(2048, 1024).tolist() == [0, 1024]
    assert packing.piece_starts(2050, 1024).tolist() == [0, 2, 1026]


def check(rows, texts):
    """Every piece once, ids of the library, places without gaps."""
    ids = dict(zip(texts, expected_ids(texts.values()), strict=True))
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    assert by_doc.keys() == ids.keys()
    for key, own in by_doc.items():
        own.sort(key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own)))
        assert [r["start"] for r in own] == packing.piece_starts(len(ids[key]), 1024).tolist()
        assert sum(r["length"] for r in own) == len(ids[key])
        for r in own:
            data = np.array(ids[key][r["start"] : r["start"] + r["length"]], "<u4").tobytes()
            assert r["ids_crc32"] == zlib.crc32(data)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
    return len(by_sequence), sum(map(len, ids.values()))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not here")
def test_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    used, tokens = check(packing.packed_documents(docs).collect(), {r["doc_id"]: r["text"] for r in docs.collect()})
    assert used <= 1.02 * tokens / 1024 + 2


def test_awkward_rows_and_shards(spark):
    rows = [(i, t) for i, t in AWKWARD if i not in (None, 6)] + [(100 + k, prose(k, 5 + 37 * k % 400)) for k in range(60)]
    check(packing.packed_documents(documents(spark, rows).repartition(3)).collect(), dict(rows))
    docs = documents(spark, AWKWARD)
    assert packing.packed_documents(docs).where("doc_id = 6").count() == 2 * packing.packed_documents(docs).where("doc_id = 5").count()
    assert packing.packed_documents(docs).where("doc_id IS NULL").count() > 0
    assert packing.packed_documents(documents(spark, [])).count() == 0
    pieces = packing.written_pieces(docs)
    places = packing.placed(pieces.drop("tokens"), per_shard=2)
    found = packing.sequences(pieces, places).collect()
    assert sum(len(r["parts"]) for r in found) == pieces.count()
    of = {r["row"]: bytes(r["tokens"]) for r in pieces.collect()}
    got = sorted(bytes(r["tokens"])[4 * p["offset"] : 4 * (p["offset"] + p["length"])] for r in found for p in r["parts"])
    assert got == sorted(of.values())
    assert all(len(r["tokens"]) == 4 * r["length"] <= 4096 for r in found)
