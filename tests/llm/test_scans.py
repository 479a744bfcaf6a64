from __future__ import annotations

import random

import numpy as np
import pytest

from cellarline.llm import decontaminate, licenses
from cellarline.llm.wordhash import NormalHasher
from tests.llm.helpers import AWKWARD, documents, prose

# Decontamination


@pytest.mark.parametrize("width", [8, 9, 10, 11, 12, 13, 20])
def test_some_mask_survives_any_errors(width):
    errors = decontaminate.allowed_errors(width, 0.8)
    assert errors == width - int(np.ceil(width * 0.8 - 1e-9))
    from itertools import combinations

    for wrong in combinations(range(width), errors):
        assert any(not set(wrong) & set(mask) for mask in decontaminate.masks(width, errors))


def overlapping(docs, items, overlap=13, least=8):
    hasher, out = NormalHasher(), set()
    for i, text in docs:
        words = hasher(text)
        for k, item in items:
            other = hasher(item)
            width = min(overlap, len(other))
            need = width - decontaminate.allowed_errors(width, 0.8)
            if len(other) < least:
                continue
            for a in range(len(words) - width + 1):
                if any((words[a : a + width] == other[b : b + width]).sum() >= need for b in range(len(other) - width + 1)):
                    out.add((i, k))
                    break
    return out


def leaks():
    rng = random.Random(2)
    items = [(k, prose(100 + k, n)) for k, n in enumerate([30, 13, 12, 9, 8, 7, 40])] + [(9, None), (10, ""), (0, prose(100, 30))]
    docs = [*AWKWARD]
    for n in range(60):
        words = (items[rng.randrange(7)][1]).split()
        begin = rng.randrange(max(1, len(words) - 8))
        part = words[begin : begin + rng.randrange(8, 20)]
        for _ in range(rng.randrange(4)):
            part[rng.randrange(len(part))] = "changed"
        docs.append((100 + n, prose(300 + n, rng.randrange(30)) + " " + ", ".join(part).upper() + ". " + prose(400 + n, 9)))
    return docs, items


@pytest.mark.parametrize("block_chars", [1 << 22, 150])
def test_contamination_by_brute_force(spark, block_chars):
    docs, items = leaks()
    table = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(documents(spark, docs), table, block_chars=block_chars).collect()
    want = overlapping(docs, items)
    assert {(r["id"], r["item"]) for r in got} == want and len(want) > 15
    kept = decontaminate.drop_contaminated(documents(spark, docs), table, block_chars=block_chars)
    assert kept.columns == documents(spark, []).columns
    ids = sorted(r["doc_id"] or 0 for r in kept.collect())
    assert ids == sorted((i or 0) for i, _ in docs if i not in {d for d, _ in want})


def test_empty_benchmark_and_documents(spark):
    docs, items = leaks()
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(documents(spark, docs), none).count() == 0
    assert decontaminate.drop_contaminated(documents(spark, docs), none).count() == len(docs)
    table = spark.createDataFrame(items, "item_id long, text string")
    assert decontaminate.contaminated_documents(documents(spark, []), table).count() == 0


# Licenses


def test_collisions_are_near_certain():
    for least in (1, 2, 64):
        least_similar = 0.8 * least / (4 * least + 0.2 * least)
        assert least_similar > 1 / 6 and 1 - (1 - least_similar) ** licenses.BANDS > 0.9998


def noticed(text):
    values = set(licenses.shingles(NormalHasher()(text)).tolist())
    own = {name: set(licenses.shingles(NormalHasher()(t)).tolist()) for name, t in licenses.TEMPLATES.items()}
    return {name for name, s in own.items() if len(s & values) >= 0.8 * len(s)}


def test_notices_by_brute_force(spark):
    rng, rows = random.Random(6), [*AWKWARD]
    for n in range(80):
        words = rng.choice(list(licenses.TEMPLATES.values())).split()
        for _ in range(rng.choice([0, 0, 1, 2])):
            words[rng.randrange(len(words))] = "other"
        rows.append((100 + n, f"{prose(n, rng.randrange(60))}\n{' '.join(words)}\n{prose(500 + n, rng.randrange(60))}"))
    rows += [(500, licenses.TEMPLATES["MIT"][:200]), (501, "Released under the MIT"), (502, "License. Released under the")]
    got = licenses.license_notices(documents(spark, rows).repartition(2)).collect()
    want = {(i, name) for i, t in rows if t for name in noticed(t)}
    assert {(r["doc_id"], r["license"]) for r in got} == want and len(want) > 60
    for r in got:
        text = next(t for i, t in rows if i == r["doc_id"])
        assert r["license"] in noticed(" ".join(text.split()[r["first_word"] : r["end_word"]]))
    assert licenses.license_notices(documents(spark, [])).count() == 0
    with pytest.raises(ValueError):
        licenses.scan(documents(spark, []), {"short": "too few words"})


def test_two_places_are_two_rows(spark):
    notice = licenses.TEMPLATES["MIT notice"]
    got = licenses.license_notices(documents(spark, [(1, f"{notice} {prose(1, 30)} {notice}")])).collect()
    assert sorted((r["first_word"], r["end_word"]) for r in got) == [(0, 5), (35, 40)]


def test_short_notices_and_further_licenses(spark):
    split = [(7, "All rights"), (8, "reserved. " + prose(8, 9))]
    rows = [(1, "All rights reserved."), (2, f"{prose(2, 40)}\nALL RIGHTS RESERVED\n{prose(3, 9)} all rights reserved."), *split]
    rows += [(20 + k, licenses.TEMPLATES[n]) for k, n in enumerate(("GPL-3 text", "Apache-2.0 text", "LGPL-2.1", "AGPL-3.0", "CC-BY-SA-4.0 notice"))]
    got = [(r["doc_id"], r["license"], r["first_word"], r["end_word"]) for r in licenses.license_notices(documents(spark, rows).repartition(1)).collect()]
    notice = "All rights reserved notice"
    assert sorted(g for g in got if g[1] == notice) == [(1, notice, 0, 3), (2, notice, 40, 43), (2, notice, 52, 55)]
    named = {(i, name) for i, name, _, _ in got}
    assert {(20, "GPL-3 text"), (21, "Apache-2.0 text"), (22, "LGPL-2.1"), (23, "AGPL-3.0"), (24, "CC-BY-SA-4.0 notice")} <= named
    with pytest.raises(ValueError):
        licenses.scan(documents(spark, []), short={"long": "five words are a shingle"})


@pytest.mark.parametrize("mark", ["# ", "// ", " * ", "-- ", ";; "])
def test_commented_headers(mark):
    words = licenses.TEMPLATES["Apache-2.0"].split()
    text = "\n".join(mark + " ".join(words[k : k + 9]) for k in range(0, len(words), 9)) + f"\n{mark}\n{mark}All rights\n{mark}reserved.\nx = 1"
    found = licenses.find_notices([None, "a - b", text, " * * ", text], licenses.index_templates(licenses.TEMPLATES, 48), 48, 0.8, licenses.index_short(licenses.SHORT))
    lines = -(-len(words) // 9)
    at = len(words) + lines + 2  # of "All", behind an empty comment line
    for doc in (2, 4):
        assert [f[1:] for f in found if f[0] == doc and f[1] == "Apache-2.0"] == [("Apache-2.0", 1, len(words) + lines, 1.0)]
        assert [f[2:] for f in found if f[0] == doc and f[1] in licenses.SHORT] == [(at, at + 4, 1.0)]
    assert {f[0] for f in found} == {2, 4}
