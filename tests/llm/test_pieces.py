from __future__ import annotations

import os
import random

import pytest
import sentencepiece

from cellarline.llm import pieces
from tests.llm.helpers import AWKWARD, documents, prose

pytestmark = pytest.mark.skipif(not os.path.exists(pieces.MODEL_FILE), reason="the public tokenizers are not here")

TEXTS = [
    "Hello  world\nfoo\tbar",
    " ",
    "  leading and trailing   ",
    "é​ñ☃ 漢字x\x00 a▁b \r\n end\r",
    "x" * 700 + " " + "abcde" * 100,
    " " * 40,
    "Ünïcödé 😀😀 naïve façade — “quoted” …",
    "def f(x):\r\n\treturn {'a': [1, 2, 3]}\r\n",
    "aaaaaaaaaaaaaaaaaaaaaaaaaaaa ababababababab",
]


def unigram_file(path: str) -> str:
    """The model with the same pieces and scores, but its type set to unigram."""
    with open(pieces.MODEL_FILE, "rb") as file:
        data = file.read()
    out = bytearray()

    def number(value: int) -> bytes:
        done = bytearray()
        while value > 127:
            done.append(value & 127 | 128)
            value >>= 7
        done.append(value)
        return bytes(done)

    for field, value in pieces.fields(data):
        if field == 2:
            # A later value of a field overrides an earlier one: type 1 (unigram) goes last.
            value = bytes(value) + b"\x18\x01"
        out += number(field << 3 | 2) + number(len(value)) + bytes(value)
    with open(path, "wb") as file:
        file.write(out)
    return path


@pytest.fixture(scope="module")
def model():
    return pieces.load_model()


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL_FILE)


def rows_of(found):
    return [(r["id"], r["ids"] and list(r["ids"]) or r["ids"], r["decoded"]) for r in found.collect()]


def test_ids_are_those_of_the_library(spark, model, library):
    rows = [*AWKWARD, *((100 + k, t) for k, t in enumerate(TEXTS)), (10_000, TEXTS[0]), (-5, TEXTS[1]), (1 << 40, "far")]
    got = rows_of(pieces.encode(documents(spark, rows).repartition(3), model))
    key = lambda r: (r[0] is None, r[0] or 0, r[2] or "")
    want = [(i, None if t is None else library.encode(t), None if t is None else library.decode(library.encode(t))) for i, t in rows]
    assert sorted(got, key=key) == sorted(want, key=key)
    for i, _, decoded in got:
        original = [t for j, t in rows if j == i]
        assert any(decoded == (t and t.replace("▁", " ")) for t in original)


def test_rare_units_agree_with_the_lattice(spark, model, library):
    random.seed(2)
    rows = [(k, "".join(random.choice("abthe,é漢 ") for _ in range(random.randrange(1, 40)))) for k in range(40)] * 2
    want = sorted((i, library.encode(t), t) for i, t in rows)
    units = sorted({u for _, t in rows for u in pieces.units_of(t, model)})
    found = pieces.lattice_ids(spark.createDataFrame([(u,) for u in units], "unit string"), model).collect()
    assert {r["unit"]: list(r["ids"]) for r in found} == {u: pieces.rare_ids(u, model) for u in units}
    for frequent in (1, 1000):
        assert sorted(rows_of(pieces.encode(documents(spark, rows), model, frequent=frequent))) == want


def test_viterbi_for_unigram_models(spark, tmp_path):
    path = unigram_file(str(tmp_path / "unigram.model"))
    model, library = pieces.load_model(path), sentencepiece.SentencePieceProcessor(model_file=path)
    assert model.kind == pieces.UNIGRAM
    rows = [(k, t) for k, t in enumerate([prose(1, 40), "the theatre is there", "Hello world", "naïve café"])] * 2
    score = lambda ids: sum(library.get_score(i) for i in ids)
    for frequent in (1, 1000):
        for i, ids, decoded in rows_of(pieces.encode(documents(spark, rows), model, frequent=frequent)):
            # The library adds scores in single precision and may take a slightly worse path.
            assert decoded == rows[i][1] and score(ids) >= score(library.encode(decoded)) - 1


def test_empty_table(spark, model):
    assert pieces.encode(documents(spark, []), model).count() == 0
    got = pieces.encoded_documents(documents(spark, [(1, None), (2, "")])).collect()
    assert sorted((r["doc_id"], r["ids"], r["decoded"]) for r in got)[1] == (2, [], "")


def test_many_units_at_once_have_the_ids_of_each():
    model = pieces.load_model()
    rng = random.Random(6)
    merges = pieces.Merges(model)
    units = ["▁" + "".join(rng.choice("abcdeinorst") for _ in range(rng.randrange(1, 30))) for _ in range(800)]
    units += ["▁", "▁▁▁", "x" * 64, "y" * 65, "日本語", "▁naïve", "\r\n", "\x07", "a\U0001f600b", "▁the", "aaaa", "ééé"]
    found = merges.apply(units)
    assert sum(ids is None for ids in found) < 10
    for unit, ids in zip(units, found, strict=True):
        assert ids is None or ids.tolist() == pieces.rare_ids(unit, model)
    assert merges.apply([]) == []
