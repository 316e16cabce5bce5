import hashlib
import random
import zlib

import pytest

from ledgerloom.llm import prefixes

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain_trie(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts, key=lambda t: t[:2])] for c, ts in own.items()}
    paths = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        paths[c] = tuple(own.get(c - c % 100, [])[:h] + turns[h:])
    members = {}
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
    out = []
    for node, inside in members.items():
        below = [n for n in members if n[: len(node)] == node]
        children = [n for n in below if len(n) == len(node) + 1]
        leaves = [n for n in below if not any(len(m) == len(n) + 1 and m[: len(n)] == n for m in below)]
        saved = sum((len(members[n]) - 1) * len(n[-1][1]) for n in below if n)
        ends = ",".join(map(str, sorted(c for c in inside if paths[c] == node)))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(inside), len(node), parent, len(inside), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.select(*COLUMNS).collect())


@pytest.mark.parametrize("max_width", [1, 40, 1 << 25])
def test_trie_against_brute_force(spark, max_width):
    """Narrow sketches doubt nearly everything, and give the same."""
    rng = random.Random(max_width)
    rows = []
    for c in [*range(0, 40), *range(100, 130), 207, 350]:
        n = rng.choice([1, 2, 3, 4, 6, 9, 17])
        rows += [(c, t, rng.choice(["user", "assistant"]) if t > 3 else "user", rng.choice(["a", "bb", "é😀x"]) if t > 2 else "same") for t in range(n)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert got(prefixes.prefix_trie(df, max_width)) == plain_trie(rows)


def test_tables_against_brute_force(spark, small):
    rows = [tuple(r) for r in small("conversations").select("conv_id", "turn", "role", "text").collect()]
    assert got(prefixes.prefix_trie(small("conversations"))) == plain_trie(rows)


def test_odd_rows(spark):
    """Null ids, turns, roles and texts, turns that repeat, a long conversation
    and a long text, one conversation that many share, clashing names."""
    rows = [(None, 0, "user", "x"), (7, None, None, None), (7, 0, "user", None), (8, 1, "user", "b"), (8, 1, "user", "b"), (8, 0, "", "long " * 60_000)]
    rows += [(300 + c, t, "user", "hello") for c in range(20) for t in range(3)] + [(900, t, "user", f"turn {t % 7}") for t in range(70)] + [(901, t, "user", f"turn {t % 7}") for t in range(70)]
    wide = spark.createDataFrame([(*r, None, None, None) for r in rows], "conv_id long, turn long, role string, text string, depth string, digest string, x int")
    assert got(prefixes.prefix_trie(wide)) == plain_trie(rows)
    none = prefixes.prefix_trie(wide.limit(0))
    assert none.count() == 0 and none.columns == COLUMNS


def test_single_tails_are_not_grouped(spark, small):
    """The sketch proves most prefixes single, and never a shared one."""
    found = prefixes.screened(prefixes.rebuilt_prefixes(small("conversations"))).filter("depth > 0").collect()
    n = {}
    for r in found:
        n[r["digest"]] = n.get(r["digest"], 0) + 1
    assert all(n[r["digest"]] == 1 for r in found if r["alone"])
    assert sum(r["alone"] for r in found) >= 0.95 * sum(k == 1 for k in n.values())
