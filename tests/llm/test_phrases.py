from __future__ import annotations

import random
import re
from collections import Counter

import pytest

from cellarline.llm import phrases
from tests.llm.helpers import AWKWARD, documents

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_force(rows, longest=3, least=10, limit=2000):
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for m in range(1, longest + 1):
                counts.update((lang, tuple(words[i : i + m])) for i in range(len(words) - m + 1))
    found = {}
    for (lang, p), a in counts.items():
        if len(p) > 1 and a >= least:
            cuts = [(10**6 * a * a // (counts[lang, p[:k]] * counts[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            found[lang, p] = (a, counts[lang, p[:k]], counts[lang, p[k:]], score)
    dropped = set()
    for (lang, q), (b, *_) in found.items():
        for m in range(2, len(q)):
            for i in range(len(q) - m + 1):
                if 100 * b >= 50 * found[lang, q[i : i + m]][0]:
                    dropped.add((lang, q[i : i + m]))
    out = []
    for lang in totals:
        own = [(-s, -a, " ".join(p).encode(), l, r) for (x, p), (a, l, r, s) in found.items() if x == lang and (x, p) not in dropped]
        for rank, (s, a, p, l, r) in enumerate(sorted(own)[:limit], start=1):
            out.append((lang, rank, p.decode(), -a, l, r, totals[lang], -s))
    return sorted(out)


def some_rows(seed=5, count=300):
    rng = random.Random(seed)
    words = ["alpha", "Beta", "gamma", "delta", "ÉTÉ", "x", "y", "z", "New", "York", "city\t"]
    rows = []
    for k in range(count):
        parts = [rng.choice(words) if rng.random() < 0.7 else "New York city" for _ in range(rng.randrange(30))]
        text = "".join(p + rng.choice([" ", " ", " ", "  ", ", ", ".\n", "\x0b", "!"]) for p in parts)
        rows.append((rng.choice(["en", "en", "fr", None, "und"]), text))
    return rows + [("en", "long " * 40), ("en", None), (None, ""), ("de", " \t.\n")]


def found(spark, rows, **settings):
    docs = spark.createDataFrame([(k, t, lang, 1, 1, "clash") for k, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string, n long, chunk int, phrase string")
    return sorted(map(tuple, phrases.collocation_digest(docs.repartition(3)).collect()))


def test_by_brute_force(spark):
    rows = some_rows()
    want = brute_force(rows)
    assert len(want) > 50 and any(r[2] == "new york city" for r in want)
    assert found(spark, rows) == want


def test_small_chunks_and_buckets_lose_nothing(spark, monkeypatch):
    """Cut texts, many shards with small supports, several buckets: the same rows."""
    rows = some_rows()
    rows.append(("en", "one two three " * 60))
    for name, value in (("CHUNK", 120), ("OPEN", 200), ("BUCKET_WORDS", 50)):
        monkeypatch.setattr(phrases, name, value)
    assert found(spark, rows) == brute_force(rows)


def test_clashing_hashes_change_nothing(spark, monkeypatch):
    """Candidates are counted by their words, so even a hash of 12 bits gives the same rows."""
    rows = some_rows(7, 120)
    plain = phrases.Words.hashes
    monkeypatch.setattr(phrases.Words, "hashes", lambda self, longest: ((at, h >> 58 << 58 | h & 63) for at, h in plain(self, longest)))
    assert found(spark, rows) == brute_force(rows)


def test_supports_of_shards():
    data = phrases.normal("A b. C\td")
    assert data == b"a b\n c d"
    words = phrases.Words(data)
    assert [len(at) for at in words.starts(3)] == [4, 2, 0]
    cut = list(phrases.cut_text(b"a b c", 3))
    assert cut == [(b"a b c", b"")]


def test_cut_texts_keep_every_phrase(monkeypatch):
    monkeypatch.setattr(phrases, "CHUNK", 16)
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choice(["a", "bb", "ccc", "d" * 20, " ", "  ", "\n"]) for _ in range(40)).encode()
        got = Counter()
        for part, context in phrases.cut_text(text, 3):
            chunk = phrases.Words(part + context)
            for m, at in enumerate(chunk.starts(3), start=1):
                got.update(tuple(chunk.words[chunk.places[i + k]] for k in range(m)) for i in at.tolist())
        want = Counter()
        for piece in text.split(b"\n"):
            own = piece.split()
            for m in (1, 2, 3):
                want.update(tuple(own[i : i + m]) for i in range(len(own) - m + 1))
        assert got == want


def test_awkward_and_empty(spark):
    docs = documents(spark, AWKWARD)
    got = phrases.collocation_digest(docs)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    got.collect()
    assert phrases.collocation_digest(documents(spark, [])).count() == 0


@pytest.mark.parametrize("per_task", [10, 1000])
def test_best_of_each_in_parts(spark, per_task):
    from pyspark.sql import functions as F

    df = spark.range(300).select((F.col("id") % 2).alias("g"), F.col("id").alias("v"))
    got = phrases.best_of_each(df, "g", [F.desc("v")], 4, per_task=per_task).collect()
    assert sorted(tuple(r) for r in got) == sorted([(g, 298 + g - 2 * k, k + 1) for g in (0, 1) for k in range(4)])
