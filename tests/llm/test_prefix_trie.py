import hashlib
import random
import zlib

import pytest

from treeline.llm.prefix_trie import joined_digests, numbered_turns, prefix_trie
from treeline.llm.queries import QUERIES, rebuilt

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def in_order(rows):
    """Turns of each conversation as (role, text)."""
    out = {}
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            out.setdefault(c, []).append(((t is not None, t or 0, digest), (role, text)))
    return {c: [said for _, said in sorted(turns, key=lambda x: x[0])] for c, turns in out.items()}


def brute_rebuilt(talks):
    out = {}
    for c, own in talks.items():
        base, h = c - (c % 5 if c >= 0 else -(-c % 5)), zlib.crc32(str(c).encode()) % 9
        out[c] = talks.get(base, [])[:h] + own[h:]
    return out


def brute_trie(talks):
    nodes = {}
    for c, turns in talks.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for path, who in nodes.items():
        below = [(p, w) for p, w in nodes.items() if p[: len(path)] == path]
        childless = sum(not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in nodes) for p, _ in below)
        saved = sum((len(w) - 1) * len(p[-1][1].encode()) for p, w in below if p)
        ends = sorted(c for c in who if len(talks[c]) == len(path))
        out.append((
            min(who), len(path), min(nodes[path[:-1]]) if path else None, len(who),
            sum(len(p) == len(path) + 1 for p, _ in below), childless, saved,
            hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=str)


def built(spark, turns, people, **more):
    nodes, members = prefix_trie(turns, people, **more)
    joined = nodes.join(joined_digests(members), "node", "left").collect()
    empty = hashlib.sha256(b"").hexdigest()
    return sorted(((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_bytes, r.sha256 or empty)
                   for r in joined), key=str)


def sample():
    rng = random.Random(4)
    rows = []
    for c in [*rng.sample(range(-20, 200), 60), 1 << 40]:
        rows += [(c, t, rng.choice(["user", "bot", None]), rng.choice(["a", "ü", "", None])) for t in range(rng.randint(1, 12))]
    rows += [(300 + i, t, "user", f"same {t}") for i in range(25) for t in range(20)]  # a group of copies
    rows += [(400, t, "user", "x" * (t % 3)) for t in range(150)]  # deep
    rows += [(401, t, "user", "x" * (t % 3)) for t in range(100)]
    rows += [(405, None, "user", "first"), (405, None, None, None), (405, -3, "a", "b"), (405, -3, "a", "b"), (405, 7, "z", "long " * 5000)]
    rows += [(None, 1, "user", "nobody's")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("height", [2, 3, 8])
def test_against_brute_force(spark, height):
    rows = sample()
    frame = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA + ", node string, depth int")
    turns = numbered_turns(frame, limit=40)  # conversations of more turns are numbered in pieces
    people = turns.select("conv").distinct()
    assert built(spark, turns, people, height=height, limit=5) == brute_trie(in_order(rows))


def test_rebuilt_conversations(spark):
    rows = sample()
    turns, people = rebuilt(numbered_turns(spark.createDataFrame(rows, SCHEMA)))
    expected = brute_rebuilt(in_order(rows))
    assert any(not t for t in expected.values())  # some have no turn, and still are members of the root
    assert built(spark, turns, people) == brute_trie(expected)


def test_query_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    assert QUERIES["op11_prefix_trie"](spark, str(tmp_path)).collect() == []


def test_only_turnless_conversations(spark):
    none = spark.createDataFrame([], "conv bigint, at bigint, digest binary, bytes bigint")
    found = built(spark, none, spark.createDataFrame([(7,), (3,)], "conv bigint"))
    assert found == [(3, 0, None, 2, 0, 1, 0, hashlib.sha256(b"3,7").hexdigest())]
