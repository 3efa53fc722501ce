import hashlib
import math
import re
import zlib

import pytest

from check import connect
from sealtrail.llm import trie as T

SCHEMA = "conv_id long, turn long, role string, text string"


def digest(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:30]


def ordered(rows):
    """Conversations as lists of (role, text)."""
    out = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            out.setdefault(c, []).append((turn is not None, turn or 0, digest(role, text), role, text))
    return {c: [t[3:] for t in sorted(turns)] for c, turns in out.items()}


def rebuilt(conversations):
    out = {}
    for c, turns in conversations.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = conversations.get(c - int(math.fmod(c, 20)), [])[:h] + turns[h:]  # remainders have the sign of c, as in SQL
    return out


def brute(conversations):
    """The trie by its definition."""
    nodes = {}
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for key in nodes:
        if key:
            children.setdefault(key[:-1], []).append(key)
    name = {key: (min(members), len(key)) for key, members in nodes.items()}
    sums = {}
    for key in sorted(nodes, key=len, reverse=True):
        own = (len(nodes[key]) - 1) * (len(re.findall(r"[^\x20\x09-\x0D]+", key[-1][1])) if key else 0)
        below = [sums[k] for k in children.get(key, [])]
        sums[key] = (sum(b[0] for b in below) or 1, own + sum(b[1] for b in below))
    ends = {key: ",".join(str(c) for c in sorted(m) if len(conversations[c]) == len(key)) for key, m in nodes.items()}
    return sorted(
        (*name[key], name[key[:-1]][0] if key else None, len(m), len(children.get(key, [])), *sums[key], hashlib.sha256(ends[key].encode()).hexdigest())
        for key, m in nodes.items()
    )


def rows_of(frame):
    return sorted(map(tuple, frame.collect()))


def odd_rows():
    rows = [(40, t, "user" if t % 2 == 0 else "assistant", f"turn {t}") for t in range(9)]
    rows += [(c, t, "user" if t % 2 == 0 else "assistant", f"turn {t if t < c % 7 else 10 * c + t}") for c in range(41, 60) for t in range(c % 9)]
    rows += [(c, t, "user", "same") for c in (100, 107, 9000, 113) for t in range(3)]  # equal conversations, ids in several chunks
    rows += [(120, None, None, None), (120, None, "", "x"), (120, 0, "user", " "), (120, 0, "user", " "), (121, 0, "user", None), (121, 5, None, "")]
    rows += [(-33, 1, "a", "b c\td"), (-40, 1, "a", "b"), (None, 0, "user", "nobody's"), (200, 3, "x", "y\n" * 2000), (3, 0, "user", "only")]
    # a role that runs into its text is not the same turn
    return rows + [(300, 0, "ab", "c"), (301, 0, "a", "bc"), (302, 0, "", "abc"), (303, 0, "user", "u"), (320, 1, "u", "v"), (321, 1, "w", "z")]


def test_trie_matches_brute_force(table):
    rows = odd_rows()
    frame = table([(*r, 1, "clash") for r in rows], SCHEMA + ", depth int, words string")
    assert rows_of(T.prefix_trie(frame)) == brute(ordered(rows))
    assert rows_of(T.rebuilt_trie(frame)) == brute(rebuilt(ordered(rows)))


def test_long_chains_and_blocks(table, monkeypatch):
    monkeypatch.setattr(T, "BLOCK", 7)
    monkeypatch.setattr(T, "CHUNK", 1)
    monkeypatch.setattr(T, "HEAVY", 2)
    rows = [(c, t, "r", f"{t}" if t < 60 + 9 * c else f"{c} {t}") for c in range(6) for t in range(150 - 20 * c)]
    rows += [(c, t, "r", f"{t}") for c in range(20, 60) for t in range(c % 3)]
    frame = table(rows, SCHEMA)
    assert rows_of(T.prefix_trie(frame)) == brute(ordered(rows))


def test_few_rounds_for_a_deep_tree(spark, monkeypatch):
    """A path of 500 nodes is gone after about log2(500) rounds."""
    rounds = []
    monkeypatch.setattr(T, "stored", lambda df, name, keep=T.stored: (rounds.append(name), keep(df, name))[1])
    path = spark.range(500).selectExpr("7L AS conv_id", "id AS depth", "IF(id > 0, 7L, NULL) AS parent_conv_id", "1L AS one")
    assert {r.depth: r.one for r in T.subtree_sums(path, ["one"]).collect()} == {d: 500 - d for d in range(500)}
    assert rounds.count("marked") <= 11


def test_empty_tables(table):
    assert T.prefix_trie(table([], SCHEMA)).count() == 0
    assert T.rebuilt_trie(table([(None, 1, "a", "b")], SCHEMA)).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_matches_sql_and_brute_force(spark, sf):
    sf = f"/root/testdata/{sf}"
    out = T.query(spark, sf)
    names = ", ".join(out.columns)
    got = rows_of(out)
    assert got == sorted(connect(sf).sql(T.ORACLE).select(names).fetchall())
    assert got == brute(rebuilt(ordered(map(tuple, spark.read.parquet(f"{sf}/conversations.parquet").collect()))))
