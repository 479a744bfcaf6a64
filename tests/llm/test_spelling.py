from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest

from cellarline.llm import spelling
from tests.llm.helpers import AWKWARD, documents

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counted(rows, least=5):
    total = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= least and n >= 3}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def variants(words):
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    out = []
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out, key=lambda r: r[0])


def edited(rng, word, alphabet):
    k = rng.randrange(len(word))
    return rng.choice([word[:k] + word[k + 1 :], word[:k] + rng.choice(alphabet) + word[k + 1 :], word[:k] + rng.choice(alphabet) + word[k:], word + rng.choice(alphabet)])


def some_words(seed, count, lengths, alphabet):
    rng = random.Random(seed)
    words = {}
    for _ in range(count):
        word = "".join(rng.choice(alphabet) for _ in range(rng.choice(lengths)))
        for _ in range(rng.randrange(1, 7)):
            words[word] = rng.choice([3, 3, 4, 6, 12, 30, 100])
            word = edited(rng, word, alphabet)
    return words


@pytest.mark.parametrize(
    ("count", "lengths", "alphabet"),
    [(120, [5, 6, 7], "abé"), (60, [5, 9, 14], "abcdefg"), (40, [30, 31, 32, 33, 34], "ab"), (20, [63, 64, 65, 66, 128, 129, 200, 1500], "aç")],
)
def test_neighbours_by_brute_force(spark, count, lengths, alphabet):
    words = some_words(count, count, lengths, alphabet)
    rows = spark.createDataFrame(list(words.items()), "word string, n long").repartition(3)
    got = spelling.spelling_variants(rows).select("word", "form", "root", "n", "n_near", "form_n").collect()
    want = variants(words)
    assert sum(r[4] for r in want) > count
    assert sorted(map(tuple, got)) == want


def test_clashing_nodes_change_nothing(spark, monkeypatch):
    from pyspark.sql import functions as F

    words = some_words(4, 40, [5, 6, 8], "abcd")
    monkeypatch.setattr(spelling, "node_of", lambda word, end: F.pmod(F.xxhash64("side", "width", F.substring(word, F.lit(1), end)), F.lit(50)))
    rows = spark.createDataFrame(list(words.items()), "word string, n long")
    got = spelling.spelling_variants(rows).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert sorted(map(tuple, got)) == variants(words)


def test_documents_by_brute_force(spark):
    rng = random.Random(2)
    names = ["Colour", "color", "colours", "centre", "center", "naïve", "naive", "été", "ÉTUDES", "études", "organise", "organize", "o'clock", "x×y÷zab"]
    rows = [(k, " ".join(rng.choice(names) for _ in range(30))) for k in range(400)] + [*AWKWARD, (None, "colour color colour")]
    got = spelling.spelling_digest(documents(spark, rows).repartition(3))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = variants(counted(rows))
    assert len(want) > 20 and any(r[1] for r in want)
    assert sorted(map(tuple, got.collect())) == want


def test_empty(spark):
    assert spelling.spelling_digest(documents(spark, [])).count() == 0
    assert spelling.spelling_digest(documents(spark, [(1, "one two"), (2, None)])).count() == 0


def test_long_chains_have_one_root(spark):
    words = {"a" * k: 3 * 2 ** (k - 5) for k in range(5, 40)}
    rows = spark.createDataFrame(list(words.items()), "word string, n long")
    assert {r["root"] for r in spelling.spelling_variants(rows).collect()} == {"a" * 39}


def test_labels_keep_levels_few(spark):
    df = spark.createDataFrame([(m,) for m in (1, 5, 32, 33, 64, 65, 128, 129, 5000, 10**6)], "m int")
    from pyspark.sql import functions as F

    for m, width in df.select("m", spelling.label_width(F.col("m"))).collect():
        assert -(-m // width) <= spelling.LEVELS and (width == 1 or m > 16 * width)
