"""Language ID and toxicity: accuracy on rows that taught nothing, and edge cases."""

import numpy as np

from sealtrail.llm import langid as L
from sealtrail.llm import toxicity as X
from sealtrail.llm.sampling import remainder

SF = "/root/testdata/sf0.01"


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = L.query(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    right = sum(r.lang_pred == r.lang for r in rows)
    assert len(rows) > 100 and right >= 0.98 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)
    assert L.query(spark, SF).where("rejected").count() <= 5


def test_language_edge_cases(spark, table):
    models = L.fit(spark.read.parquet(f"{SF}/documents.parquet"))
    texts = [None, "", "123 !?", "²", "the", "x" * 10_000, "zq" * 5_000 + " the"]
    docs = table([(i, t, "clash") for i, t in enumerate(texts)] + [(None, "the", None)], "doc_id long, text string, lang string")
    rows = {r.doc_id: r for r in L.identify(docs, models).collect()}
    assert all(rows[i].language.lang == "und" and rows[i].language.rejected for i in (0, 1, 2, 3))
    assert all(rows[i].language.lang in models.names for i in (4, 5, 6)) and rows[5].language.rejected
    assert rows[None].language.lang in models.names
    assert L.identify(table([], "doc_id long, text string"), models).count() == 0
    assert L.fit(docs.where("doc_id > 100")) is None
    assert L.identify(docs, None).where("not language.rejected").count() == 0


def test_probabilities_sum_to_one():
    words = ["abba", "baa", "cab", "abc", "b"]
    model = L.CharModel.fit(words, np.array([3, 1, 2, 1, 5]))
    letters = "abc" + chr(L._END)
    for context in ("", "a", "ab", "ca", "abb"):
        # cost of a word is the sum over its letters and its end
        total = 0.0
        base = model.costs([context])[0] if context else 0.0
        for c in letters[:-1]:
            longer = model.costs([context + c])[0]
            end_after_longer = _end_cost(model, context + c)
            end_after_base = _end_cost(model, context) if context else 0.0
            total += np.exp(-((longer - end_after_longer) - (base - end_after_base)))
        total += np.exp(-_end_cost(model, context)) if context else np.exp(-model.costs([""])[0])
        assert 0.98 < total <= 1.0001  # the rest is kept for letters never seen


def _end_cost(model, word):
    """Cost of the end mark behind ``word``: the word's cost less that of its letters."""
    codes, _ = L._encode([word])
    p = np.full(len(codes), model.floor)
    for n in range(1, L.ORDER + 1):
        keys, shares = model.grams[n - 1]
        at, found = L._find(keys, L._hashes(codes, n))
        share = np.where(found, shares[at], 0.0)
        if n == 1:
            p = share + model.contexts[0][1][0] * p
            continue
        before = np.concatenate([[np.uint64(0)], L._hashes(codes[:-1], n - 1)])
        keys, weights = model.contexts[n - 1]
        at, known = L._find(keys, before)
        p = share + np.where(known, weights[at], 1.0) * p
    return -np.log(p[-1])


def test_toxicity_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = X.query(spark, sf).where("held_out").join(labels, "doc_id").collect()
    bad = [r for r in rows if r.toxic == 1]
    good = [r for r in rows if r.toxic == 0]
    assert sum(r.predicted for r in bad) >= 0.85 * len(bad)
    assert sum(r.predicted for r in good) <= 0.02 * len(good)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_matches_edit_distance():
    entries = ["idiot", "scum", "worthless", "idiom", "stem*", "trash"]
    automaton = X.Automaton(entries)
    rng = np.random.default_rng(3)
    words = list("idiot scum worthless idiom stemming stem ste trash".split())
    for word in list(words):
        for _ in range(60):
            letters = list(word)
            for _ in range(rng.integers(0, 3)):
                at = int(rng.integers(0, len(letters) + 1))
                letters[at : at + int(rng.integers(0, 2))] = list(rng.choice(list("abdiost"), size=int(rng.integers(0, 2))))
            words.append("".join(letters))
    for word in words:
        want = set()
        for entry in entries:
            if entry.endswith("*"):
                want |= {0} if word.startswith(entry[:-1]) else set()
            else:
                d = distance(word, entry)
                want |= {d} if d == 0 or (d == 1 and len(entry) >= X.FUZZY_FROM) else set()
        got = automaton.best(word)
        assert (None if got is None else got[1]) == min(want, default=None), word


def test_quotation_counts_less_than_abuse():
    model = X.ToxicityModel(["idiot"], [7.0], [-4.0, 3.0, 2.0, 0.5, 0.1])
    matcher = model.matcher()
    abuse, quoted = matcher.score("you are an idiot and that is it"), matcher.score('the word "idiot" is defined here')
    assert abuse > X.THRESHOLD > quoted
    assert matcher.score("you 1diot now") > matcher.score("you are here now") == matcher.score(None) == matcher.score("")


def test_toxicity_edge_cases(table):
    docs = table([(0, None, "x"), (1, "", "x"), (None, "idiot", "x"), (2, "idiot " * 30_000, "x")], "doc_id long, text string, label string")
    none = table([], "doc_id long, toxic int")
    model = X.fit(docs, none)
    out = X.score_toxicity(docs, model)
    assert [r.toxicity for r in out.collect()] == [0.5] * 4 and out.columns == [*docs.columns, "toxicity"]
    assert X.score_toxicity(table([], "doc_id long, text string"), model).count() == 0


def test_fold_is_crc32_of_the_text(table):
    import zlib

    rows = table([(i,) for i in range(50)] + [(None,)], "doc_id long").select("doc_id", remainder(X.F.col("doc_id"), 5).alias("r")).collect()
    assert all(r.r == (None if r.doc_id is None else zlib.crc32(str(r.doc_id).encode()) % 5) for r in rows)


def test_language_with_long_texts_only(table):
    rows = [(i, "the cat sat on the mat and looked at the dog " * 5, "en") for i in range(20)]
    rows += [(100 + i, "12345 " * 5_000 + "der hund lief durch den wald und sah die katze " * 600, "de") for i in range(20)]
    models = L.fit(table(rows, "doc_id long, text string, lang string"))
    assert models.names == ["de", "en"]
    told = models.scorer().batch(["der hund sah die katze", "the cat looked at the dog"])
    assert [t[0] for t in told] == ["de", "en"] and not any(t[3] for t in told)


def test_terms_beside_punctuation_or_without_blanks_are_found():
    model = X.ToxicityModel(["idiot", "\u767d\u75f4"], [7.0, 7.0], [-4.0, 3.0, 2.0, 0.5, 0.1])
    matcher = model.matcher()
    for text in ("you-idiot", "well...idiot", "l'idiot", "you_idiot!", "\u4f60\u771f\u662f\u767d\u75f4\u554a"):
        assert matcher.features(text)[1] > 0, text
    assert matcher.features("you 1diot now")[2] > 0 and not any(matcher.features("\u767d \u75f4")[1:])


def test_rare_terms_enter_the_lexicon(table):
    rows = [(f"common{i % 7} filler text {i} " + ("scumbag" if i < 12 else "vile") + (" \u4f60\u662f\u767d\u75f4" if i % 90 == 0 else ""), 1) for i in range(900)]
    rows += [(f"common{i % 7} filler text {i} nice", 0) for i in range(900)]
    entries = X.learn_lexicon(table(rows, "text string, toxic int")).entries
    assert any("scumbag".startswith(e.rstrip("*")) for e in entries) and "\u767d\u75f4" in entries


def test_words_of_a_batch_are_held_in_parts(monkeypatch):
    words = ["der", "hund", "und", "die", "katze"]
    model = L.CharModel.fit(words, np.array([3, 1, 2, 1, 5]))
    fitted = L.LanguageModels(["de"], [model], np.array([np.inf]))
    texts = ["der hund", None, "x" * 50, "", "die katze und der hund", "katze"] * 5
    whole = fitted.scorer().batch(texts)
    monkeypatch.setattr(L, "PART_CHARS", 30)
    held, part = [], L._Scorer._part
    monkeypatch.setattr(L._Scorer, "_part", lambda self, texts: held.append(texts) or part(self, texts))
    assert fitted.scorer().batch(texts) == whole and len(whole) == len(texts)
    assert [t for texts in held for t in texts] == texts
    assert max(sum(len(t or "") for t in texts) for texts in held if len(texts) > 1) <= 30
    assert fitted.scorer().batch([]) == []
