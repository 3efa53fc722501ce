import hashlib
import random

from sealtrail.llm import substrings as S


def brute(rows):
    first = {}
    for doc, text in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        words = (text or "").encode().split()
        for i in range(len(words) - 12):
            first.setdefault(tuple(words[i : i + 13]), doc)
    out = []
    for doc, text in rows:
        words = (text or "").encode().split()
        gone = [False] * len(words)
        if doc is not None:
            for i in range(len(words) - 12):
                if first[tuple(words[i : i + 13])] < doc:
                    gone[i : i + 13] = [True] * 13
        kept = b" ".join(w for w, g in zip(words, gone) if not g)
        out.append((doc, len(words), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def texts():
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(3000)}"
    passages = [[word() for _ in range(rng.choice([12, 13, 14, 60]))] for _ in range(6)]
    rows = [(0, None), (1, ""), (2, "a " * 100), (3, "a " * 40), (4, "\x1f x\x0by z" * 30), (None, "a " * 100)]
    for doc in range(5, 60):
        words = [word() for _ in range(rng.randrange(60))]
        for passage in rng.sample(passages, rng.randrange(3)):
            at = rng.randrange(len(words) + 1)
            words[at:at] = passage
        rows.append((doc, " ".join(words)))
    rows += [(70, rows[20][1]), (71, rows[20][1]), (20, rows[30][1]), (72, " ".join(rows[k][1] or "" for k in range(6, 20)))]
    return rows + [rows[20]]


def test_dedup_matches_brute_force(table, monkeypatch):
    monkeypatch.setattr(S, "BUCKET", 200)
    monkeypatch.setattr(S, "BATCH", 300)
    rows = texts()
    docs = table([(d, t, b"clash") for d, t in rows], "doc_id long, text string, seq binary")
    out = S.dedup_substrings(docs)
    assert sorted((tuple(r) for r in out.drop("kept").collect()), key=str) == brute(rows)
    for row in out.where("n_removed > 0").collect():
        assert hashlib.sha256(row.kept.encode()).hexdigest() == row.kept_sha256


def test_empty_table(table):
    assert S.dedup_substrings(table([], "doc_id long, text string")).count() == 0
