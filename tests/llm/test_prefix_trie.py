"""The prefix trie against a trie that is built and walked."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

from finquery.llm.prefix_trie import prefix_trie

COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def expected(rows: list[tuple]) -> list[tuple]:
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            text = text or ""
            own[conv].append(((-1, 0) if turn is None else (0, turn), role or "", hashlib.sha256(text.encode()).hexdigest(), text))
    own = {c: [(r, t) for _, r, _, t in sorted(x)] for c, x in own.items()}
    members = defaultdict(list)
    paths = {}
    for c, turns in own.items():
        h, base = zlib.crc32(str(c).encode()) % 6, int(c / 100) * 100
        paths[c] = tuple(own.get(base, [])[:h] + turns[h:])
        for d in range(len(paths[c]) + 1):
            members[paths[c][:d]].append(c)
    out = {}
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    for p in sorted(members, key=len, reverse=True):
        m = members[p]
        saved = (len(m) - 1) * (len(p[-1][1]) if p else 0) + sum(out[q][6] for q in children[p])
        leaves = sum(out[q][5] for q in children[p]) if children[p] else 1
        ends = ",".join(str(c) for c in sorted(m) if len(paths[c]) == len(p))
        out[p] = (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest())
    return sorted(out.values())


def found(spark, rows: list[tuple], parts: int = 3) -> list[tuple]:
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS depth", "'x' AS owner", "2 AS block").repartition(parts)
    return sorted(tuple(r) for r in prefix_trie(spark, df).select(*COLUMNS).collect())


def test_random_tries(spark):
    for seed in range(2):
        rng, rows = random.Random(seed), []
        for c in [*range(-3, 12), *rng.sample(range(100, 700), 90), 200, 300, 10**15, -(10**15) - 7]:
            for turn in range(rng.randrange(1, 9)):
                rows.append((c, turn, rng.choice(["user", "user", None, "assistant"]), rng.choice(["a", "a", "é\U0001f600b", None, "cc"])))
        rows += [(5, None, "user", "first"), (5, None, "user", "first"), (5, 2, "z", "tie"), (5, 2, "z", "tie too"), (None, 0, "user", "nobody")]
        assert found(spark, rows) == expected(rows)


def test_long_and_common_conversations_lie_in_many_blocks(spark):
    """One conversation with a third of all rows, one path shared by a third of all conversations."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = [(7, k, "user", f"t{k % 50}") for k in range(900)] + [(c, k, "user", "same") for c in range(1000, 1150) for k in range(6)] + [(c, 0, "user", f"x{c}") for c in range(300)]
        assert found(spark, rows) == expected(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_empty_table_and_a_turnless_conversation(spark):
    assert found(spark, []) == []
    short = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 > 1)  # its one turn is replaced by nothing
    assert found(spark, [(short, 0, "user", "gone")]) == [(short, 0, None, 1, 0, 1, 0, hashlib.sha256(str(short).encode()).hexdigest())]
