"""The trie of conversations against a dictionary of all prefixes."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import pytest

from terrakern.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def listed(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}


def lent(own):
    h = {c: zlib.crc32(str(c).encode()) % 4 for c in own}
    return {c: own.get(c - c % 20, [])[: h[c]] + turns[h[c] :] for c, turns in own.items()}


def slow_trie(conversations):
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    out, sums = [], {}
    for node in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        saved = (len(members[node]) - 1) * words + sum(sums[c][0] for c in children[node])
        sums[node] = saved, sum(sums[c][1] for c in children[node]) or 1
        ids = ",".join(map(str, sorted(ends[node])))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(members[node]), len(node), parent, len(members[node]), len(children[node]), sums[node][1], saved, hashlib.sha256(ids.encode()).hexdigest()))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


def rows_of(seed, n):
    draw = random.Random(seed)
    rows = []
    for c in draw.sample(range(60), n):
        stem = draw.choice([0, 0, 2, 7])
        for t in range(stem + draw.choice([0, 1, 1, 2, 5])):
            text = draw.choice(["", None, "one", "two words", "tab\tand  more ", "ä b"]) if t >= stem else f"stem {t}"
            rows.append((c, draw.choice([t, t, t, None]) if t >= stem else t, draw.choice(["user", "assistant", None]) if t >= stem else "user", text))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_trie_of_drawn_conversations(spark, seed):
    rows = rows_of(seed, 40)
    df = spark.createDataFrame([(*r, 1) for r in rows] + [(None, 0, "user", "no id", 1)], SCHEMA + ", rep long").repartition(5)
    assert found(trie.prefix_trie(df)) == slow_trie(listed(rows))
    assert found(trie.trie(*trie.rebuilt(trie.placed(df)))) == slow_trie(lent(listed(rows)))


def test_one_conversation_equal_ones_and_none(spark):
    same = [(c, t, "user", f"turn {t}") for c in range(9000, 9300) for t in range(3)]
    for rows in ([], [(5, 0, None, None)], same, same + [(1, 0, "user", "turn 0")], same * 2):
        assert found(trie.prefix_trie(spark.createDataFrame(rows, SCHEMA))) == slow_trie(listed(rows))


def test_deep_shared_prefix_and_conversations_without_turns(spark):
    deep = [(c, t, "user", "x" if t < 20 else str(c)) for c in (1, 2, 3) for t in range(21 + c)] + [(c, t, "user", "x") for c in (50, 51) for t in range(12)]
    assert found(trie.prefix_trie(spark.createDataFrame(deep, SCHEMA))) == slow_trie(listed(deep))
    short = [(c, 0, "user", "only") for c in range(21, 40)]  # their twenty has no first conversation
    assert found(trie.trie(*trie.rebuilt(trie.placed(spark.createDataFrame(short, SCHEMA))))) == slow_trie(lent(listed(short)))


def test_all_conversations(spark, small):
    rows = duckdb.sql(f"SELECT conv_id, turn, role, text FROM '{small}/conversations.parquet'").fetchall()
    assert found(trie.op11_trie(spark, small)) == slow_trie(lent(listed(rows)))
