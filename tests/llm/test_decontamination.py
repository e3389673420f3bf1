import random
import re

import numpy as np

from tests.llm.common import DOC_SCHEMA, awkward, frame
from tidepool.llm import decontamination as op


def plain(text):
    low = "".join(x if len(x := c.lower()) == 1 else c for c in text or "")
    return re.sub(r"\s+", " ", low).strip()


def least_edits(item, text):
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        before, row = row, [i]
        for j, y in enumerate(text, 1):
            row.append(min(before[j - 1] + (x != y), before[j] + 1, row[-1] + 1))
    return min(row)


def corpus(seed, rate):
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("abcdefé") for _ in range(rnd.randint(1, 6))) for _ in range(60)]
    prose = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    items = [(i, prose(rnd.randint(9, 30)).capitalize() + ".") for i in range(12)] + [(50, "Too  short"), (51, None), (52, ""), (53, "ab"), (54, "é!"), (55, "too short")]
    docs = []
    for i in range(60):
        text = prose(rnd.randint(0, 40))
        if i % 2:
            item = list(rnd.choice(items[:12])[1])
            for _ in range(int(rnd.uniform(0, rate) * len(item))):
                k = rnd.randrange(len(item))
                item[k : k + 1] = rnd.choice([[], [rnd.choice("abz\n ")], [item[k], rnd.choice("abz")], [item[k].upper()]])
            item = item if i % 3 else "".join(item).upper()
            text = f"{text}{rnd.choice([' ', '  ', chr(10)])}{''.join(item)} {prose(rnd.randint(0, 20))}"
        docs.append((1000 + i, text, None, None, None))
    return docs, items


def leaks(items, text):
    """Fewest edits of each item that leaks into a text."""
    out = {}
    for i, t in items:
        item, whole = plain(t), plain(text)
        if len(item) >= op.LEAST and (n := least_edits(item, whole)) <= int(op.RATE * len(item)):
            out[i] = n
        if 0 < len(item) < op.LEAST and any(whole.startswith(item, k) and not whole[max(0, k - 1) : k].isalnum() and not whole[k + len(item) :][:1].isalnum() for k in range(len(whole))):
            out[i] = 0
    return out


def test_equals_brute_force(spark):
    docs, items = corpus(1, 0.12)
    docs += [r for r in awkward() if r[1] is None or len(r[1]) < 1000]
    benchmark = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, doc_id string")
    docs += [(2000, "It is TOO\nshort.", None, None, None), (2001, "xtoo short, ab", None, None, None), (2002, "cabé! ab", None, None, None), (2003, " é!", None, None, None)]
    want = {(r[0], i): n for r in docs for i, n in leaks(items, r[1]).items()}
    assert {i for _, i in want} >= {50, 53, 54, 55}
    for item_bytes in (op.ITEM_BYTES, 400):
        got = op.contaminated(frame(spark, docs), benchmark, item_bytes).collect()
        assert {(r.doc_id, r.item_id): r.edits for r in got} == want and len(got) == len(want)
        texts = {r[0]: r[1] or "" for r in docs}
        for r in got:
            stretch = plain(texts[r.doc_id][r.start : r.end])
            assert abs(len(stretch) - len(plain(dict(items)[r.item_id]))) <= int(op.RATE * len(stretch)) + 4
    assert len(want) > 10 and any(want.values())


def test_align():
    rnd = random.Random(5)
    for _ in range(200):
        item = bytes(rnd.choice(b"ab") for _ in range(rnd.randint(1, 12)))
        text = bytes(rnd.choice(b"ab") for _ in range(rnd.randint(0, 20)))
        edits, end = op.align(np.frombuffer(item, np.uint8), np.frombuffer(text, np.uint8), -12, 32)
        assert edits == least_edits(item, text) and 0 <= end <= len(text)


def test_item_ids_of_any_type(spark):
    docs = spark.createDataFrame([(1, "so this is a line of the benchmark, word for word")], "doc_id long, text string")
    for kind in ("short", "decimal(10,0)", "string"):
        items = spark.sql(f"SELECT CAST(7 AS {kind}) AS item_id, 'This is a line of the benchmark, word for word' AS text")
        assert [str(r.item_id) for r in op.contaminated(docs, items).collect()] == ["7"]


def test_empty(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = frame(spark, awkward())
    assert op.contaminated(docs, none).count() == 0
    assert op.contaminated(spark.createDataFrame([], DOC_SCHEMA), none).count() == 0
