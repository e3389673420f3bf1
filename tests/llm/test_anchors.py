import random

import numpy as np
import pyarrow as pa

from tidepool.llm import anchors as op
from tidepool.llm.textbuf import byte_prefix, rolling, text_buffers


def test_pieces_hold_all_rows_in_order():
    rnd = random.Random(0)
    places = [list(range(rnd.randint(1, 30))) for _ in range(50)]
    batch = pa.RecordBatch.from_pydict({"places": pa.array(places, pa.list_(pa.int64())), "windows": pa.array([rnd.randint(1, 5) for _ in range(50)], pa.int32())})
    parts = list(op.pieces(batch, 60))
    assert [x for p in parts for x in p.column("places").to_pylist()] == places and len(parts) > 10
    assert [x.tolist() for p in parts for x in op.lists(p.column("places"))] == places


def test_every_window_has_one_owner_and_equal_windows_the_same_offset():
    rnd = random.Random(1)
    texts = ["".join(rnd.choice("ab") for _ in range(rnd.randint(0, 120))) for _ in range(20)] + ["ab" * 40, "", None, "a" * 60]
    texts += [texts[0] + texts[1], "x" + texts[2]]
    data, offsets = text_buffers(pa.array(texts))
    k, window = 5, 16
    doc, anchor, at, first, last = op.occurrences(rolling(byte_prefix(data), k), k, window, offsets)
    owned = [(d, p - offsets[d]) for d, a, b in zip(doc, first, last, strict=True) for p in range(a, b + 1)]
    assert owned == [(d, p) for d, t in enumerate(texts) for p in range(len(t or "") - window + 1)]
    raw, seen = data.tobytes(), {}
    for h, q, a, b in zip(anchor, at, first, last, strict=True):
        for p in range(a, b + 1):
            assert p <= q <= p + window - k
            assert seen.setdefault(raw[p : p + window], (h, q - p)) == (h, q - p)


def test_once_each():
    owner, content = np.array([0, 0, 1, 0, 1, 1]), np.array([5, 6, 5, 5, 5, 7])
    lead, order, bounds = op.once_each(owner, content)
    groups = [sorted(order[a:b].tolist()) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    assert sorted(groups) == [[0, 3], [1], [2, 4], [5]] and len(lead) == 4
