import re

import pytest
from pyspark.sql import functions as F

from tests.llm.common import awkward, frame, shared
from tidepool.llm import phrase_dedup as op

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(rows, window):
    least = {}
    split = [WORD.findall(r[1] or "") for r in rows]
    for r, words in zip(rows, split, strict=True):
        for i in range(len(words) - window + 1):
            key = tuple(words[i : i + window])
            if r[0] is not None:
                least[key] = min(least.get(key, r[0]), r[0])
    out = []
    for r, words in zip(rows, split, strict=True):
        gone = set()
        for i in range(len(words) - window + 1):
            if r[0] is not None and least[tuple(words[i : i + window])] < r[0]:
                gone.update(range(i, i + window))
        starts = [i for i in range(len(words)) if i in gone and i - 1 not in gone]
        ends = [i + 1 for i in range(len(words)) if i in gone and i + 1 not in gone]
        out.append((r[0], len(words), len(gone), starts, ends, " ".join(w for i, w in enumerate(words) if i not in gone)))
    return out


def same(spark, rows, p=op.Settings()):
    key = lambda r: tuple((x is None, x) for x in r)
    got = op.remove_phrases(frame(spark, rows), p).collect()
    want = brute(rows, p.window)
    assert any(w[2] for w in want) or not want
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_equals_brute_force(spark):
    rows = awkward() + [(100 + i, *r[1:]) for i, r in enumerate(shared(41, 90))]
    same(spark, [*rows, (50, rows[-1][1], None, None, None), (None, rows[-2][1], None, None, None), rows[-3], (901, "And " * 60, None, None, None), (902, "x " + "And " * 40, None, None, None)])


@pytest.mark.parametrize("crowd", [4000, 2])
def test_crowded_anchors(spark, crowd):
    rows = [*shared(43, 80), (900, "And " * 60, None, None, None), (901, "so And And " * 20, None, None, None), (902, "And " * 9, None, None, None)]
    same(spark, rows, op.Settings(5, 2, 50, crowd))


def test_ids_of_text(spark):
    rows = shared(45, 40)
    docs = spark.createDataFrame([(f"d{r[0]:02}", r[1]) for r in rows], "doc_id string, text string")
    got = {r.doc_id: tuple(r)[1:] for r in op.remove_phrases(docs, op.Settings(5, 2)).collect()}
    assert got == {f"d{w[0]:02}": w[1:] for w in brute(rows, 5)}


def test_empty(spark):
    assert op.remove_phrases(frame(spark, [])).select(F.sha2("kept", 256)).count() == 0
