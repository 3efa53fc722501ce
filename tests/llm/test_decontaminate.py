from sealtrail.llm import decontaminate as D


def words(text):
    return (text or "").lower().split()


def shingles(ws):
    return {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)} if len(ws) >= 5 else ({tuple(ws)} if ws else set())


ITEM = "one two three four five six seven eight nine ten eleven twelve"
DOCS = [
    (0, f"before {ITEM} after"),
    (1, "ONE TWO three four five six seven eight nine ten eleven twelve"),
    (2, "one two three four five six seven"),
    (3, None),
    (4, ""),
    (5, "filler " * 20_000 + ITEM),
    (6, "just four words here"),
    (6, "a second row of one document just four words here"),
    (None, ITEM),
    (7, "one two three four five six seven eight nine x eleven twelve " * 3),
]
ITEMS = [(0, ITEM), (1, None), (2, ""), (3, "four words"), (4, ITEM), (5, "quite different words in this item here")]


def test_containment_matches_brute_force(table):
    docs = table([(*d, "clash") for d in DOCS], "doc_id long, text string, item string")
    out = D.contaminated(docs, table(ITEMS, "item_id long, text string")).collect()
    have = {}
    for doc, text in DOCS:
        have.setdefault(doc, []).append(words(text))
    want = set()
    for item, text in ITEMS:
        asked = shingles(words(text))
        width = min(5, len(words(text)))
        for doc, parts in have.items():
            grams = {tuple(w[i : i + width]) for w in parts for i in range(len(w) - width + 1)} if width else set()
            shared = len(asked & grams)
            if asked and 100 * shared >= 80 * len(asked):
                want.add((doc, item, shared, len(asked)))
    assert {tuple(r) for r in out} == want and len(out) == len(want)


def test_clean_documents_keep_rows_and_columns(table):
    docs = table([(*d, "x") for d in DOCS], "doc_id long, text string, contaminated_id string")
    out = D.clean_documents(docs.withColumnRenamed("contaminated_id", "note"), table(ITEMS, "item_id long, text string"))
    assert sorted(r.doc_id for r in out.collect()) == [2, 3, 4, 7]
    assert out.columns == ["doc_id", "text", "note"]


def test_large_index_goes_through_the_bloom_filter(table, monkeypatch):
    monkeypatch.setattr(D, "BROADCAST_ROWS", 0)
    docs, items = table(DOCS, "doc_id long, text string"), table(ITEMS, "item_id long, text string")
    through = {tuple(r) for r in D.contaminated(docs, items).collect()}
    monkeypatch.undo()
    assert through == {tuple(r) for r in D.contaminated(docs, items).collect()}


def test_empty_tables(table):
    none, items = table([], "doc_id long, text string"), table(ITEMS, "item_id long, text string")
    assert D.contaminated(none, items).count() == 0
    assert D.contaminated(table(DOCS, "doc_id long, text string"), table([], "item_id long, text string")).count() == 0


def test_an_item_spread_over_rows_of_one_id(table):
    ws = ITEM.split()
    docs = table([(1, " ".join(ws[:8])), (1, " ".join(ws[4:]))], "doc_id long, text string")
    out = D.contaminated(docs, table([(0, ITEM)], "item_id long, text string")).collect()
    assert [tuple(r) for r in out] == [(1, 0, 8, 8)]


def test_rows_are_cleaned_one_by_one(table):
    ws = ITEM.split()
    rows = [(None, ITEM), (None, "clean without id"), (None, None), (None, " ".join(ws[:8])), (None, " ".join(ws[4:])),
            (1, ITEM), (1, "clean beside a contaminated row"), (1, "clean beside a contaminated row")]
    out = D.clean_documents(table(rows, "doc_id long, text string"), table(ITEMS[:1], "item_id long, text string"))
    assert sorted(map(tuple, out.collect()), key=str) == sorted(rows[1:5] + rows[6:], key=str)


def test_item_shingles_are_made_once(table, capsys):
    """The index is read again by the search and by the verification, not ranked again."""
    out = D.contaminated(table(DOCS, "doc_id long, text string"), table(ITEMS, "item_id long, text string"))
    out.explain()
    assert "Window" not in capsys.readouterr().out
