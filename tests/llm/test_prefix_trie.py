"""The prefix trie against brute force over every prefix."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
from litspark.llm import prefix_trie as P
from litspark.llm import queries

SCHEMA = "conv_id long, turn long, role string, text string, owner int, path string, level string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA)


def name(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()


def sequences(rows):
    """Turns of each conversation in order; ties by the turn's hash."""
    found = defaultdict(list)
    for c, t, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, name(r[2] or "", r[3] or ""))):
        found[c].append((role or "", text or ""))
    return found


def rebuilt(found):
    out = {}
    for c in found:
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(c / 100) * 100 if c < 0 else c % 100
        out[c] = found.get(c - base, [])[:h] + found[c][h:]
    return out


def brute(convs):
    nodes = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(c)
    kids = Counter(p[:-1] for p in nodes if p)
    leaves, saved = Counter(), Counter()
    for p, members in nodes.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(members) - 1) * (len(p[-1][1]) if p else 0)
    out = Counter()
    for p, members in nodes.items():
        ends = ",".join(map(str, sorted(c for c in members if len(convs[c]) == len(p))))
        out[min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), kids[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()] += 1
    return out


def plain(df):
    return Counter(tuple(r)[:8] for r in df.collect())


def random_rows(seed):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-250, 400), 150):
        start = [("user", f"s{rng.randrange(2)}")] * rng.choice([0, 1, 3, 9])
        turns = start + [(rng.choice(["user", None, "bot"]), rng.choice([None, "", "hi", "é" * 5, "yes"])) for _ in range(rng.randrange(8))]
        rows += [(c, k if k else rng.choice([0, None]), *t) for k, t in enumerate(turns)]
    return rows


@pytest.mark.parametrize("width", [1, 3, 8])
def test_random_conversations(spark, width):
    rows = random_rows(width) + [(None, 1, "user", "of no conversation"), (7, 3, "user", "tie"), (7, 3, "user", "tie"), (7, 3, "bot", "eit")]
    assert plain(P.conversation_trie(frame(spark, rows), width=width)) == brute(sequences(rows))


def test_rebuilt_conversations(spark):
    for rows in (random_rows(20), [(c, 0, "user", "one turn") for c in range(1, 60)]):
        placed = P.placed_turns(frame(spark, rows))
        convs = placed.select("conv_id").distinct()
        assert plain(P.prefix_trie(P.with_shared_heads(placed, convs), convs)) == brute(rebuilt(sequences(rows)))


def test_long_and_copied_conversations(spark):
    rows = [(c, k, "user", f"t{k}") for c in (5, 6, 9) for k in range(40)] + [(c, k, "bot", "same") for c in range(100, 400) for k in range(2)] + [(8, k, "user", f"alone {k}") for k in range(70)]
    rows += [(10, 0, "user", "x" * 300_000)]
    trie = P.conversation_trie(frame(spark, rows))
    assert plain(trie) == brute(sequences(rows))
    shown = {(r.conv_id, r.depth): (r.role, len(r.text or "")) for r in P.with_turns(trie, frame(spark, rows)).collect()}
    assert shown[10, 1] == ("user", 300_000) and shown[5, 0] == (None, 0) and shown[5, 40] == ("user", 3)


def test_pieces_of_many_ids(spark, monkeypatch):
    ends = spark.createDataFrame([(d, 0, c) for d in (1, 2) for c in range(0, 5000, d)], "depth long, owner long, conv_id long")
    monkeypatch.setattr(P, "PIECE_IDS", 7)
    got = {r.depth: r.ends for r in P.id_digests(ends).collect()}
    assert got == {d: hashlib.sha256(",".join(map(str, range(0, 5000, d))).encode()).hexdigest() for d in (1, 2)}


def test_no_conversations(spark):
    assert P.conversation_trie(frame(spark, [])).count() == 0
    assert P.conversation_trie(frame(spark, [(None, 1, "a", "b")])).count() == 0


def test_query_takes_the_table(spark):
    rows = [tuple(r) for r in queries.table(spark, "/root/testdata/sf0.001", "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert plain(queries.op12_prefix_trie(spark, "/root/testdata/sf0.001")) == brute(rebuilt(sequences(rows)))
