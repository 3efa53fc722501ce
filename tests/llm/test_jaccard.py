import random

import numpy as np

from sealtrail.llm import jaccard as J
from sealtrail.llm.components import components


def brute(rows):
    sets, least = {}, {}
    for doc, text in rows:
        words = (text or "").encode().lower().split()
        grams = {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())
        sets.setdefault(doc, []).append(frozenset(grams))
    nodes = [(d, s) for d, ss in sets.items() for s in ss]
    least = {d: d for d in sets}
    changed = True
    while changed:
        changed = False
        for i, (d, s) in enumerate(nodes):
            for e, t in nodes[:i]:
                if s and t and 100 * len(s & t) >= 80 * len(s | t) and least[d] != least[e]:
                    least[d] = least[e] = min(least[d], least[e])
                    changed = True
    return {d: (len(ss[0]), least[d]) for d, ss in sets.items()}


def texts():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choices(vocabulary, k=40))
    rows = [(0, None), (1, ""), (2, "two words"), (3, "TWO words"), (4, " \t\n"), (5, "b" * 50_000), (6, "É é"), (7, "é É")]
    for base in range(12):
        words = rng.choices(vocabulary, k=rng.choice([30, 80, 200]))
        for copy in range(rng.choice([1, 2, 6, 25])):
            own = list(words)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                own[rng.randrange(len(own))] = f"x{rng.random()}"
            text = " ".join(own) + (" " + passage if base % 3 == 0 and copy % 2 else "")
            rows.append((len(rows) + 100 * base, text))
    return rows


def test_groups_match_brute_force(table, monkeypatch):
    monkeypatch.setattr(J, "CELL", 8)  # so that blocks are cut into cells
    monkeypatch.setattr(J, "NODE", 4)
    rows = texts()
    docs = table([(d, t, "clash") for d, t in rows], "doc_id long, text string, n long".replace("n long", "class string"))
    out = {r.doc_id: (r.n_shingles, r.component_id) for r in J.jaccard_groups(docs).collect()}
    assert out == brute(rows)


def test_rows_without_id_and_repeated_rows(table):
    text = "a b c d e f g"
    docs = table([(None, text), (4, text), (4, text), (2, text), (9, None)], "doc_id long, text string")
    out = sorted(map(tuple, J.jaccard_groups(docs).collect()), key=str)
    assert out == sorted([(None, 3, None), (4, 3, 2), (4, 3, 2), (2, 3, 2), (9, 0, 9)], key=str)
    kept = J.keep_one_of_each(docs)
    assert sorted((r.doc_id or -1) for r in kept.collect()) == [-1, 2, 9] and kept.columns == docs.columns


def test_empty_table(table):
    assert J.jaccard_groups(table([], "doc_id long, text string")).count() == 0


def test_tree_finds_every_partner():
    rng = np.random.default_rng(1)
    base = rng.poisson(3, size=(40, J.GROUPS))
    points = np.concatenate([np.maximum(base + rng.integers(-1, 2, base.shape), 0) for _ in range(6)])
    sizes = points.sum(axis=1)
    tree = J.CountTree(points, sizes)
    for p, n in zip(points, sizes):
        bound = np.minimum(points, p).sum(axis=1)
        want = np.flatnonzero(
            (bound >= J._least_overlap(n + sizes)) & (100 * sizes >= 80 * n) & (80 * sizes <= 100 * n)
        )
        assert set(want) <= set(tree.partners(p, int(n)).tolist())


def test_components_of_paths_and_stars(table):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    out = {r.node: r.component for r in components(table(edges, "a long, b long")).collect()}
    want = {i: 0 for i in range(61)} | {100 + i: 100 for i in range(30)} | {200: 200, 201: 200}
    assert out == want
    assert components(table([], "a long, b long")).count() == 0


def test_rows_of_one_id_are_kept_by_their_own_text(table):
    text = "a b c d e f g"
    rows = [(1, text, "x"), (2, text, "y"), (2, "quite another text of one id here", "z"), (1, text, "x"), (None, text, "n"),
            (3, "", "e"), (4, "", "e"), (5, None, "e"), (1, "yet another text of the kept id here", "w")]
    out = J.keep_one_of_each(table(rows, "doc_id long, text string, note string"))
    want = [rows[0], rows[2], *rows[4:]]
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str) and out.columns == ["doc_id", "text", "note"]


def test_blocks_admit_only_pairs_that_may_be_similar(table):
    """Sets that share one late hash of their prefixes make no pair, whatever block holds them."""
    rng = random.Random(9)
    sets = {d: sorted(rng.sample(range(1 << 40), 60)) for d in range(30)}
    sets |= {100 + d: sorted({*sets[d][3:], *rng.sample(range(1 << 40), 3)}) for d in range(10)}
    for d in range(10, 30, 2):  # the eleventh of both
        sets[d + 1] = sorted({*sets[d + 1][:10], sets[d][10], *(h for h in sets[d + 1][11:] if h > sets[d][10])})
    rows = [(d, len(s), s[: len(s) - -(-80 * len(s) // 100) + 1]) for d, s in sets.items()]
    shared = J._shared(table(rows, "rep long, n long, keys array<long>"))
    assert all(r.rest == r.n - sets[r.rep].index(r.key) for r in shared.collect())
    links = {(a, b) for a in sets for b in sets if a < b and 180 * len({*sets[a]} & {*sets[b]}) >= 80 * (len(sets[a]) + len(sets[b]))}
    both = shared.alias("x").join(shared.selectExpr("key", "rep as b", "n as m", "rest as other"), "key").where("rep < b")
    met = {(r.rep, r.b) for r in both.collect()}
    kept = {(r.rep, r.b) for r in both.where(J._fits("n", "rest", "m", "other")).collect()}
    assert links and links <= kept < met


def test_sets_that_come_once_are_not_shuffled(table):
    rows = [(d, 2, f"c{d}".encode(), [d, d + 1], b"") for d in range(20)] + [(d, 2, b"c3", [3, 4], b"") for d in (1, 30, 30)]
    classes = J._classes(table(rows, "doc long, n long, class binary, keys array<long>, point binary"))
    assert sorted((bytes(r["class"]), r.rep, list(r["keys"])) for r in classes.collect()) == sorted(
        (f"c{d}".encode(), 1 if d == 3 else d, [d, d + 1]) for d in range(20)
    )
    assert "Exchange hashpartitioning" not in classes._jdf.queryExecution().executedPlan().toString()


def test_members_without_a_partner_leave_their_block(table):
    """Whatever the order of sizes and places in a block, and however many batches it spans."""
    rng = random.Random(11)
    rows = []
    for doc in range(300):
        n = rng.choice([10, 30, 31, 38, 60, 100, 400, 2000])
        keys = rng.sample(range(1, 2_000_000), n - -(-80 * n // 100) + 1)
        keys[rng.randrange(len(keys))] = -rng.randrange(60)  # a block of about five members
        if n == 400 and doc % 3:
            keys[0] = -1000  # a large block
        rows.append((doc, n, keys))
    classes = table(rows, "rep long, n long, keys array<long>")
    conf, name = classes.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(name)
    conf.set(name, "3")
    try:
        got = {(r.key, r.rep) for r in J._shared(classes, fitting=True).collect()}
        whole = {(r.key, r.rep): (r.n, r.rest) for r in J._shared(classes).collect()}
    finally:
        conf.set(name, before)

    def fit(x, y):
        (n, rest), (m, other) = whole[x], whole[y]
        return 80 * max(n, m) <= 100 * min(n, m) and 180 * min(rest, other) >= 80 * (n + m)

    needed = {x for x in whole for y in whole if x != y and x[0] == y[0] and fit(x, y)}
    assert needed <= got < set(whole)
    assert all(x in needed for x in got if sum(y[0] == x[0] for y in whole) <= 5)


def test_fine_counts_tell_long_texts_apart(table):
    rng = np.random.default_rng(3)
    one = np.unique(rng.integers(0, 1 << 63, 20_000, dtype=np.uint64))
    other = np.unique(rng.integers(0, 1 << 63, 19_000, dtype=np.uint64))
    near = np.unique(np.concatenate([one[: len(one) * 9 // 10], other[:1000]]))
    sets = {1: one, 2: other, 3: near, 4: one[:2000]}
    assert not J._fine_counts(sets[4])
    for a in (1, 2, 3):
        for b in (1, 2, 3):
            bound = J._fine_overlap(J._fine_counts(sets[a]), J._fine_counts(sets[b]))
            assert bound >= len(np.intersect1d(sets[a], sets[b]))
    facts = table(
        [(d, len(s), J._group_counts(s), J._fine_counts(s)) for d, s in sets.items()],
        "rep long, n long, point binary, fine binary",
    )
    pairs = table([(1, 2), (1, 3), (2, 3)], "a long, b long")
    assert [(r.a, r.b) for r in J._bounded(pairs, facts).collect()] == [(1, 3)]


def test_copies_of_an_id_are_verified_once(spark, table):
    """Each of 20 copies of one text would meet each of 20 of the other."""
    a = " ".join(f"w{i}" for i in range(60))
    b = a + " more"
    docs = table([("a", a)] * 20 + [("b", b)] * 20 + [("c", "quite other words")], "doc string, text string")
    digest = {d: J.xxhash.xxh128_digest(J.Shingler()(t).tobytes()) for d, t in (("a", a), ("b", b))}
    classes = table([(d, bytearray(c)) for d, c in digest.items()], "rep string, class binary")
    pairs = table([("a", "b")], "a string, b string")
    assert [tuple(r) for r in J._verified(pairs, docs, classes).collect()] == [("a", "b")]
