import numpy as np
import pytest

from sealtrail.llm import embeddings as E


def brute(rows):
    def unit(v):
        if v is None or not len(v) or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            return None
        v = np.array(v, dtype=float) / np.abs(v).max()
        return v / np.linalg.norm(v)

    units = [unit(v) if i is not None and label is not None else None for i, v, label in rows]
    links = [[
        a is not None and b is not None and x != y and rows[x][2] == rows[y][2] and len(a) == len(b) and a @ b >= 0.98
        for y, b in enumerate(units)
    ] for x, a in enumerate(units)]
    least = [r[0] for r in rows]
    for _ in rows:
        least = [min([least[x], *[least[y] for y in range(len(rows)) if links[x][y]]]) if least[x] is not None else None for x in range(len(rows))]
    return sorted(((rows[x][0], sum(links[x]), least[x], least[x] is not None and least[x] == rows[x][0]) for x in range(len(rows))), key=str)


def vectors():
    rng = np.random.default_rng(2)
    rows = []
    for group in range(12):
        base = rng.standard_normal(32)
        for _ in range([1, 2, 5, 40][group % 4]):
            v = base + rng.standard_normal(32) * rng.choice([0.0, 0.02, 0.05])
            rows.append((len(rows) + 10, [float(x) for x in v], int(group % 3)))
    v = rows[30][1]
    return rows + [
        (0, None, 1), (1, [0.0] * 32, 1), (2, [float("nan")] + [1.0] * 31, 1), (3, [], 1), (4, v, None), (None, v, rows[30][2]),
        (5, [x * 1e200 for x in v], rows[30][2]), (6, [1.0, 2.0], 1), (7, [2.0, 4.0], 1), (8, [float("inf")] * 32, 1),
    ]


def test_links_match_brute_force(table, monkeypatch):
    monkeypatch.setattr(E, "PACK", 4)
    rows = vectors()
    frame = table([(*r, "clash") for r in rows], "vec_id long, embedding array<double>, label int, cell string")
    assert sorted((tuple(r) for r in E.embedding_groups(frame).collect()), key=str) == brute(rows)


def test_empty_table(table):
    assert E.embedding_groups(table([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_recall_at_the_threshold():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = rng.standard_normal(x.shape)
    side -= (side * x).sum(axis=1, keepdims=True) * x
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    y = 0.98 * x + np.sqrt(1 - 0.98**2) * side
    coder = E.Coder(x, 16, 4)
    apart = np.vectorize(lambda v: int(v).bit_count())(coder.parts(x) ^ coder.parts(y))
    found = (apart <= 1).any(axis=1) & (apart.sum(axis=1) <= coder.most_bits)
    assert found.mean() >= 0.95


@pytest.mark.parametrize("norm", [0.0, 0.8, 0.9])
@pytest.mark.parametrize("width", [16, 20, 24, 28, None])
def test_recall_of_vectors_with_a_common_mean(norm, width):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x = np.sqrt(1 - norm**2) * x + norm * np.eye(64)[0]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert abs(np.linalg.norm(x.mean(axis=0)) - norm) < 0.05
    side = rng.standard_normal(x.shape)
    side -= (side * x).sum(axis=1, keepdims=True) * x
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    y = 0.98 * x + np.sqrt(1 - 0.98**2) * side
    coder = E.Coder.chosen(x[:1500], 2 ** (width or 13), *([[width]] if width else []))
    apart = np.vectorize(lambda v: int(v).bit_count())(coder.parts(x) ^ coder.parts(y))
    found = (apart <= coder.flips).any(axis=1) & (apart.sum(axis=1) <= coder.most_bits)
    assert found.mean() >= 0.98
    packed = np.vectorize(lambda v: (int(v) & (2**64 - 1)).bit_count())(coder.code(x) ^ coder.code(y))
    assert (packed.sum(axis=1) == apart.sum(axis=1)).all()


def test_links_of_vectors_with_a_common_mean(table):
    rng = np.random.default_rng(8)
    rows = []
    for group in range(100):
        base = rng.standard_normal(32) / np.sqrt(32) + 2.0 * np.eye(32)[0]
        for _ in range(3):
            rows.append((len(rows), [float(v) for v in base + rng.standard_normal(32) * 0.055], 1))
    out = {tuple(r) for r in E.embedding_groups(table(rows, "vec_id long, embedding array<double>, label int")).collect()}
    found, want = sum(r[1] for r in out), sum(r[1] for r in brute(rows))
    assert 0.98 * want <= found <= want and want > 100
