"""Large groups of near copies that are only partly linked: few pairs, no link lost."""

import random

import pytest
from test_documents import brute_classes, rows_of

from docframe.llm import jaccard_join as jj
from docframe.llm.jaccard_join import Similarity, jaccard_classes

SPANNING = "g long, sig long, probe boolean, component long, alone boolean, c long"


def copies(seed, n):
    """Texts that differ from one by up to a tenth of its words, so many pairs are just linked and many just aren't."""
    r = random.Random(seed)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(n):
        words = list(base)
        for k in range(r.randint(0, 6)):
            words[r.randrange(100)] = f"x{r.randrange(40)}"
        rows.append((i, " ".join(words)))
    return rows


def test_other_centres_meet_a_component_once(spark):
    rows = [(g, 100 * part + i, True, part, False, 80) for g in range(1, 9) for part in (1, 2) for i in range(40)]
    spanning = jj.materialise(spark.createDataFrame(rows, SPANNING))
    pairs = [(r["a"], r["b"]) for r in jj._other_centres(spanning, 0).collect()]
    assert 1 <= len(pairs) <= jj.CENTRES  # as many as centres; with every member 40 of each
    assert all(a // 100 != b // 100 for a, b in pairs)


def test_classes_alone_make_one_pair(spark):
    sim = Similarity()
    docs = spark.createDataFrame([(i, t.encode()) for i, t in copies(1, 60)], "sig long, text binary")
    parity = jj.materialise(docs.mapInArrow(jj._parities(sim), "sig long, n long, parity binary"))
    rows = [(g, i, True, i if i > 9 else 0, i > 9, 60) for g in (1, 2, 3) for i in range(60)]
    spanning = spark.createDataFrame(rows, SPANNING)
    first, last = ({(r["a"], r["b"]) for r in jj._across(spanning, parity, sim, nearest).collect()} for nearest in (True, False))
    assert any(a > 9 for a, _ in first) and any(a <= 9 < b for a, b in last)
    assert not any(a > 9 for a, _ in last)


@pytest.mark.parametrize("pays", [0, 1 << 40])
def test_near_copies_by_brute_force(spark, monkeypatch, pays):
    for name, value in (("BLOCK", 16), ("PLACE", 64), ("PAYS", pays)):
        monkeypatch.setattr(jj, name, value)
    rows = copies(2, 160) + [(1000 + i, t + " and an end of its own") for i, t in copies(3, 60)]
    got = jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert rows_of(got, "doc_id", "n_shingles", "component_id") == brute_classes(rows)
