from collections import Counter

import pytest

from sealtrail.llm import pieces as P

TEXTS = [
    None, "", " ", "  two  blanks ", "plain words here", "\n\t tabs▁and ▁▁ signs", "日本語 👍🏽 é", "x" * 3000, " " * 300, "a\x00b",
    "token " * 400, "É" * 100 + " end",
]


@pytest.fixture(scope="module")
def vocabulary():
    return P.Vocabulary.load()


def spelled(vocabulary, ids):
    return b"".join(vocabulary.decoded[i] for i in ids).decode()[1:]


def test_round_trip_and_reproducible(table):
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS)] + [(None, TEXTS[4], None), (4, TEXTS[4], "again")]
    docs = table(rows, "doc_id long, text string, decoded string")
    once = P.decode(P.encode(docs), out="back").collect()
    again = P.decode(P.encode(docs.repartition(3)), out="back").collect()
    assert len(once) == len(rows) and all(r.back == r.text for r in once)
    assert {r.doc_id: r.pieces for r in once} == {r.doc_id: r.pieces for r in again}
    same = [r.pieces for r in once if r.doc_id == 4]
    assert same[0] == same[1]
    assert once[0].pieces is None and once[1].pieces == []
    digests = P.encoded_digest(docs).collect()
    assert all(r.lossless for r in digests) and {r.n_pieces for r in digests if r.doc_id in (0, 1)} == {0}


def test_samples_follow_the_lattice(vocabulary):
    """All segmentations of a word, by enumeration, against drawn frequencies."""

    def ways(text):
        if not text:
            yield (), 1.0
        for k in range(1, len(text) + 1):
            if piece := vocabulary.pieces.get(text[:k]):
                for rest, weight in ways(text[k:]):
                    yield (piece[0], *rest), piece[1] * weight

    weights = dict(ways(" there"))
    total, n = sum(weights.values()), 40_000
    drawn = Counter(tuple(i.tolist()) for i in P.Sampler(vocabulary).batch(list(range(n)), ["there"] * n))
    assert set(drawn) <= set(weights)
    for ids, weight in weights.items():
        p = weight / total
        assert abs(drawn[ids] / n - p) < 5 * (p * (1 - p) / n) ** 0.5 + 1e-3


def test_memory_of_words_does_not_change_results(vocabulary, monkeypatch):
    keys, texts = list(range(len(TEXTS))), TEXTS
    want = P.Sampler(vocabulary).batch(keys, texts)
    monkeypatch.setattr(P, "REMEMBERED", 0)
    monkeypatch.setattr(P, "CHUNK", 10)
    monkeypatch.setattr(P, "ABREAST_WORDS", 2)
    got = P.Sampler(vocabulary).batch(keys, texts)
    assert [None if x is None else x.tolist() for x in got] == [None if x is None else x.tolist() for x in want]


def test_empty_table(table):
    assert P.encoded_digest(table([], "doc_id long, text string")).count() == 0


def test_a_worker_loads_a_model_once():
    assert P._with_model(P.MODEL, P.ALPHA) is P._with_model(P.MODEL, P.ALPHA)


def test_batches_are_bounded_in_bytes(table):
    """Rows alone do not bound them: texts may be long."""
    docs = table([(1, "a text")], "doc_id long, text string")
    conf, name = docs.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    before = conf.get(name, None)
    conf.unset(name)
    try:
        P.encode(docs)
        assert 0 < int(conf.get(name)) <= 4_000_000
    finally:
        conf.set(name, before) if before else conf.unset(name)


def test_words_side_by_side_are_cut_like_single_ones(vocabulary, monkeypatch):
    texts = [t for t in TEXTS if t] + ["".join(chr(97 + (i * k) % 26) for i in range(k % 40 + 1)) for k in range(300)]
    keys = list(range(len(texts)))
    ids, ends = P.Sampler(vocabulary).flat(keys, texts)
    monkeypatch.setattr(P, "ABREAST", 0)
    one_ids, one_ends = P.Sampler(vocabulary).flat(keys, texts)
    assert ids.tolist() == one_ids.tolist() and ends.tolist() == one_ends.tolist()
    assert [spelled(vocabulary, part) for part in P.np.split(ids, ends[:-1])] == texts
