import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from tessera.llm import prefix_trie
from tessera.plans import running

HOSTILE = "conv_id long, turn long, role string, text string, depth long, k1 long, path long, level int, head long, size long, n string, digest string"


@pytest.fixture
def table(spark):
    return lambda rows: spark.createDataFrame([(*r, 1, 2, 3, 4, 5, 6, "x", "y") for r in rows], HOSTILE)


def brute_force(rows, rebuild=True):
    by = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            by[c].append((turn is not None, turn or 0, digest, (role, text)))
    own = {c: [t[3] for t in sorted(ts)] for c, ts in by.items()}
    full = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c - int(c / 5) * 5)
        full[c] = own.get(base, [])[:h] + ts[h:] if rebuild else ts
    members = defaultdict(list)
    for c, ts in full.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
    out = []
    for node, convs in members.items():
        subtree = [v for v in members if v[: len(node)] == node]
        children = [v for v in subtree if len(v) == len(node) + 1]
        childless = [v for v in subtree if not any(w[:-1] == v and w for w in members)]
        saved = sum((len(members[v]) - 1) * len(v[-1][1].encode()) for v in subtree if v)
        ends = ",".join(str(c) for c in sorted(convs) if len(full[c]) == len(node))
        out.append((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), len(children), len(childless), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def conversations(seed, n, longest, words):
    rng = random.Random(seed)
    return [(c, t, rng.choice(["user", "assistant", None]), rng.choice(words)) for c in range(-7, n) for t in range(rng.randrange(longest))]


WORDS = ["a", "é\n", None, "", "long " * 50]


@pytest.mark.parametrize("block", [2, 1024])
def test_equals_brute_force(table, monkeypatch, block):
    monkeypatch.setattr(running, "BLOCK", block)
    rows = conversations(block, 40, 6, WORDS)
    # A conversation much longer than the others, repeated rows, ties and null turns, no id, and copies of one conversation.
    rows += [(100, t, "user", WORDS[t % 5]) for t in range(40)] + [(100, 3, "user", "b"), (100, 3, "user", "b"), (100, None, "user", "first"), (None, 0, "user", "a"), (None, None, None, None)]
    rows += [(c, t, "user", "copy") for c in range(200, 215) for t in range(10)]
    assert found(prefix_trie.prefix_trie(table(rows))) == brute_force(rows)


def test_without_rebuilding(table):
    rows = conversations(3, 25, 5, ["a", "b"])
    assert found(prefix_trie.prefix_trie(table(rows), rebuild=False)) == brute_force(rows, rebuild=False)


def test_only_turnless_conversations(table):
    # 4 opens with turns of the absent conversation 0 and keeps none of its own: crc32("4") % 9 is beyond its one turn.
    rows = [(c, 0, "user", "x") for c in range(1, 400) if zlib.crc32(str(c).encode()) % 9 > 0 and c % 5]
    out = found(prefix_trie.prefix_trie(table(rows)))
    assert out == brute_force(rows) and len(out) == 1


def test_empty_table(table):
    assert found(prefix_trie.prefix_trie(table([(1, 0, "user", "x")]).limit(0))) == []


def test_two_sequences_under_one_key_fail(table, monkeypatch):
    monkeypatch.setattr(prefix_trie.F, "xxhash64", lambda *a: prefix_trie.F.lit(5).cast("long"))
    with pytest.raises(Exception, match="one key"):
        prefix_trie.prefix_trie(table([(1, 0, "user", "x"), (2, 0, "user", "yy")]), rebuild=False)
