import math

import numpy as np
from hypothesis import given, settings, strategies as st

from check import connect
from sealtrail.llm import negatives as N

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, every=100):
    """Hard negatives by their definition."""
    usable = {}
    for i, x, label, *_ in rows:
        if i is None or x is None or label is None or any(c is None or not math.isfinite(c) for c in x):
            continue
        if any(abs(c) * 256 + 1 >= math.sqrt(2**56 / max(1, len(x))) for c in x):
            continue
        one = ((label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * c) for c in x])
        usable[i] = min(usable.get(i, one), one)
    out = []
    for a, (label, v) in usable.items():
        if a % every:
            continue
        scores = sorted((-sum(p * q for p, q in zip(v, w)), i, other) for i, (other, w) in usable.items() if i != a)
        for s, p, _ in [t for t in scores if t[2] == label][:5]:
            inside = [t for t in scores if t[2] != label and 80 * -s <= 100 * -t[0] <= 100 * -s][:5]
            out += [(a, p, k, n, -s, -t) for k, (t, n, _) in enumerate(inside, 1)]
    return sorted(out)


def rows_of(frame):
    return sorted(map(tuple, frame.collect()))


@settings(max_examples=60, deadline=None)
@given(st.tuples(*[st.integers(0, 40)] * 3), st.integers(1, 9), st.integers(0, 2**32))
def test_strassen_is_exact(shape, leaf, seed):
    (m, k, n), rng = shape, np.random.default_rng(seed)
    a, b = rng.integers(-(2**27), 2**27, (m, k)), rng.integers(-(2**27), 2**27, (k, n))
    assert (N.strassen(a, b, leaf) == a @ b).all()


def vectors(rng, n, dims=8):
    x = rng.integers(-3, 9, (n, dims)) / 4  # few values, so scores tie
    return [(i * 5, x[i].tolist(), int(rng.choice([0, 0, 0, 1, 2, 3]))) for i in range(n)]


def odd_rows():
    rows = vectors(np.random.default_rng(8), 260)
    v = rows[3][1]
    return rows + [
        (None, v, 1), (2, None, 1), (3, v, None), (4, [None] + v[1:], 1), (6, [math.nan] + v[1:], 1), (8, [math.inf] + v[1:], 1),
        (9, [1e300] + v[1:], 1), (11, [], 1), (12, v[:3], 2), (13, v + [7.0, 7.0], 3), (15, v, 0), (15, v, 0), (15, v, 2), (700, v, 2147483647), (1400, [], 0),
    ]


def test_matches_brute_force(table):
    rows = odd_rows()
    frame = table([(*r, "clash") for r in rows], SCHEMA + ", v string")
    assert rows_of(N.mined(frame)) == brute(rows)


def test_small_tiles_and_groups(table, monkeypatch):
    monkeypatch.setattr(N, "TILE_ROWS", 8)
    monkeypatch.setattr(N, "GROUP_ROWS", 5)
    monkeypatch.setattr(N, "LEAF", 2)
    rows = odd_rows()
    assert rows_of(N.mined(table(rows, SCHEMA))) == brute(rows)


def test_every_row_an_anchor_and_one_label(table):
    rows = [(100 * i, [float(i % 3), 1.0], 1) for i in range(12)]
    assert rows_of(N.mined(table(rows, SCHEMA))) == brute(rows)
    same = [(i + 1, [1.0], 5) for i in range(6)]
    assert N.hard_negatives(N.integer_vectors(table(same, SCHEMA)), every=1).count() == 0


def test_empty_table(table):
    assert N.mined(table([], SCHEMA)).count() == 0
    assert N.mined(table([(100, None, 1)], SCHEMA)).count() == 0


def test_query_matches_sql(spark):
    sf = "/root/testdata/sf0.01"
    out = N.query(spark, sf)
    got = rows_of(out)
    assert got and got == sorted(connect(sf).sql(N.ORACLE).select(", ".join(out.columns)).fetchall())
