import zlib
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from sealtrail.llm import packing as P

MODEL = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    "", None, " ", "One  two\n\nthree's a crowd", "É́ é ́x 각", "a b c\x1cd\x85e",
    "<|endoftext|> x<|endoftext|>y <| startoftext|>", "ΑΣ ΣΑΣ İ ß ﬁ", "1234 5.6e7 don't we'LL", "\U0001f600\U0001f600 ‍", "x" * 300,
]


@pytest.fixture(scope="module")
def whole():
    tokenizer = Tokenizer.from_file(MODEL)
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids + [P.END]


def crc32(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def split(ids, capacity):
    return [ids[k : k + capacity] for k in range(0, len(ids), capacity)]


def test_ids_are_those_of_the_whole_text(table, whole, monkeypatch):
    monkeypatch.setattr(P, "CHUNK", 100)
    texts = [*TEXTS, " ".join(t or "" for t in TEXTS) * 40]
    rows = [(i // 2 if i % 5 else None, t, "clash") for i, t in enumerate(texts)]
    out = P.token_pieces(table(rows, "doc_id int, text string, piece string"), MODEL, capacity=16)
    want = [(k, n, 16 * n, len(ids), crc32(ids), ids) for k, t, _ in rows for n, ids in enumerate(split(whole(t), 16))]
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(max_size=30), max_size=5))
def test_any_text(whole, texts):
    encoder = P.Encoder(MODEL)
    texts = [t.encode(errors="ignore").decode() for t in texts]
    parts = encoder.batches(pa.array(texts, pa.string()))
    got = [ids for _, _, ids, counts in parts for ids in np.split(ids, np.cumsum(counts)[:-1])]
    assert [g.tolist() + [P.END] for g in got] == [whole(t) for t in texts]


def test_forgotten_words_are_encoded_again(whole, monkeypatch):
    monkeypatch.setattr(P, "REMEMBERED", 10)
    monkeypatch.setattr(P, "NEW_WORDS", 3)
    encoder = P.Encoder(MODEL)
    for k in range(30):
        text = " ".join(f"common rare{k} often{k % 4} w{j * k}" for j in range(6))
        ids, counts = encoder.few(pa.array([text, "", " common "]))
        assert ids.tolist() == whole(text)[:-1] + whole("common")[:-1]
        assert counts.tolist() == [len(whole(text)) - 1, 0, len(whole("common")) - 1]
    assert len(encoder.words) < 60 and b"common" in encoder.words.to_pylist()


def placed(lengths, plan):
    at = [(*map(int, (s[0], o[0])), length) for length, n in lengths.items() for r in range(n)
          for s, o in [plan.place(np.array([length]), np.array([r]))]]
    return sorted(at)


def assert_packed(rows, capacity, sequences):
    """Rows (sequence, offset, length) fill whole sequences from 0 without gaps."""
    end = {}
    for sequence, offset, length in sorted(rows):
        assert offset == end.get(sequence, 0)
        end[sequence] = offset + length
    assert len(end) == sequences and max(end.values(), default=0) <= capacity


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 40).flatmap(lambda c: st.tuples(st.just(c), st.dictionaries(st.integers(1, c), st.integers(1, 9), min_size=1))))
def test_plans_are_packings(case):
    capacity, lengths = case
    plan = P.make_plan(lengths, capacity)
    assert_packed(placed(lengths, plan), capacity, plan.sequences)


def test_few_sequences():
    rng = np.random.default_rng(3)
    for low, high, slack in ((1, 900, 1.0), (1, 4096, 1.03), (1100, 2600, 1.02)):
        lengths, n = np.unique(rng.integers(low, high, 4000), return_counts=True)
        plan = P.make_plan(dict(zip(lengths.tolist(), n.tolist())))
        assert plan.sequences <= np.ceil(lengths @ n / 4096 * slack)


def test_combinations_reach_the_best_of_all():
    sizes, demand, capacity = [9, 7, 5, 4], [400, 300, 500, 200], 20
    uses = P.combinations(sizes, demand, capacity)
    left = np.array(demand) - sum(times * column for column, times in uses)
    assert all(column @ sizes <= capacity for column, _ in uses) and (left >= 0).all()
    every = [c for n in range(1, 6) for c in combinations_with_replacement(range(4), n) if sum(sizes[i] for i in c) <= capacity]
    value, _ = P._best_combination(sizes, np.array(sizes) / capacity, capacity)
    assert value == max(sum(sizes[i] for i in c) for c in every) / capacity
    # prices that make each used combination worth 1 make none worth more: the basis is optimal
    assert len(uses) == 4 and left @ sizes < 4 * capacity
    prices = np.linalg.solve(np.array([column for column, _ in uses], dtype=float), np.ones(4))
    assert max(sum(prices[i] for i in c) for c in every) <= 1 + 1e-9


def test_pack(table, spark):
    rng = np.random.default_rng(5)
    rows = [(i if i % 3 else None, int(n), [int(n)] * int(n), "clash") for i, n in enumerate(rng.integers(1, 33, 900))]
    rows += [(1, None, None, None), (2, 0, [], None), (3, 33, [1] * 33, None)]
    frame = table(rows, "doc_id int, length int, ids array<int>, row string").withColumnRenamed("row", "slice")
    packed = P.pack(frame, capacity=32).cache()
    out = packed.collect()
    assert packed.columns == ["doc_id", "length", "ids", "slice", "sequence_id", "offset"]
    assert sorted((r[:4] for r in map(tuple, out)), key=str) == sorted(rows, key=str)
    assert sorted(str(r.length) for r in out if r.sequence_id is None) == ["0", "33", "None"]
    here = [(r.sequence_id, r.offset, r.length) for r in out if r.sequence_id is not None]
    assert_packed(here, 32, len({s for s, _, _ in here}))
    assert len({s for s, _, _ in here}) <= np.ceil(sum(n for _, _, n in here) / 32) + 2
    whole = {r.sequence_id: r.ids for r in P.sequences(packed).collect()}
    assert all(whole[s][o : o + n] == [n] * n for s, o, n in here)


def test_empty_table(table):
    nothing = P.token_pieces(table([], "doc_id long, text string"), MODEL)
    assert nothing.count() == 0 and P.pack(nothing).count() == 0


def test_query_matches_brute_force(spark, whole):
    sf = "/root/testdata/sf0.001"
    out = P.query(spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = [(d.doc_id, n, 4096 * n, len(ids), crc32(ids))
            for d in docs for n, ids in enumerate(split(whole(d.text), 4096))]
    assert sorted(tuple(r)[:5] for r in out) == sorted(want)
    rows = [(r.sequence_id, r.offset, r.length) for r in out]
    assert_packed(rows, 4096, int(np.ceil(sum(n for _, _, n in rows) / 4096)))
