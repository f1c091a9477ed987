import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tidemark.llm import prefix_trie as T

SCHEMA = "conv_id long, turn long, role string, text string, id string, n long, depth long, digest string, words long, up string"


def table_of(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, "d", 3, "u") for r in rows], SCHEMA)


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text))


def brute_trie(convs):
    """Nodes of {conv_id: [(role, text)]} from a plain dict of prefixes."""
    members, ends = {}, {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
        ends.setdefault(tuple(turns), []).append(c)
    children = {p: [] for p in members}
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[q] for q in children[p]) or 1
        saved[p] = (len(members[p]) - 1) * (words(p[-1][1]) if p else 0) + sum(saved[q] for q in children[p])
    digest = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    rows = [(min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p], digest(ends.get(p, []))) for p, m in members.items()]
    return sorted(rows, key=str)


def brute(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            said = (role or "", text or "")
            digest = hashlib.sha256(f"{len(said[0])}:{said[0]}{said[1]}".encode()).hexdigest()
            own.setdefault(c, []).append((turn is not None, turn or 0, digest, said))
    own = {c: [x[3] for x in sorted(v)] for c, v in own.items()}
    h = {c: zlib.crc32(str(c).encode()) % 4 for c in own}
    base = lambda c: c - (abs(c) % 20) * (1 if c >= 0 else -1)
    return brute_trie({c: own.get(base(c), [])[: h[c]] + t[h[c] :] for c, t in own.items()})


def result(df):
    return sorted((tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()), key=str)


def test_equals_brute_force(spark, sf):
    conversations = spark.read.parquet(f"{sf}/conversations.parquet")
    want = brute([tuple(r) for r in conversations.select("conv_id", "turn", "role", "text").collect()])
    got = result(T.rebuilt_trie(conversations))
    assert got == want and max(r[1] for r in got) > T.BLOCK


def test_edges(spark):
    rows = [(0, 0, "u", "a b"), (0, 1, "a", "c"), (0, 2, "u", "d e f"), (1, None, None, None), (1, 0, "u", " \n"), (1, 0, "u", "x"), (1, 0, "u", "x"), (2, 5, "u", "w " * 50_000), (None, 1, "u", "lost"),
            (7, 0, "u", "a b"), (27, 0, "u", "only"), (45, None, "", ""), (45, None, "", ""), (-3, 0, "u", "é 漢字"), (-21, 1, "u", "m"), (-20, 0, "u", "base"), (-20, 1, "u", "base 2")]
    rows += [(100 + i, t, "u", f"t{t}") for i in range(5) for t in range(9)]
    assert result(T.rebuilt_trie(table_of(spark, rows))) == brute(rows)
    assert T.rebuilt_trie(table_of(spark, [])).count() == 0
    assert T.rebuilt_trie(table_of(spark, [(None, 1, "u", "x")])).count() == 0


@pytest.mark.parametrize("block,stretch", [(1, 2), (3, 2), (4, 4096)])
def test_divergence_inside_and_between_blocks(spark, block, stretch):
    rng = random.Random(block)
    convs = {c: [("u", rng.choice("ab")) for _ in range(rng.choice([0, 1, 3, 7, 12, 25]))] for c in range(70)}
    for c in range(70, 100):  # copies, prefixes and late divergence of one long conversation
        convs[c] = [("u", f"w{t} w") for t in range(rng.randint(0, 30))] + [("u", str(rng.randint(0, 3)))]
    turns = [(c, p, hashlib.sha256(f"1:u{t}".encode()).hexdigest(), words(t)) for c, v in convs.items() for p, (_, t) in enumerate(v)]
    turns = spark.createDataFrame(turns, "conv_id long, pos long, turn_hash string, words long")
    ids = spark.createDataFrame([(c,) for c in convs], "conv_id long")
    assert result(T.trie(turns, ids, block, stretch)) == brute_trie(convs)


def test_turns_inside_lone_blocks_get_no_digest(spark):
    turns = [(c, p, f"{p}" if p < 8 or c == 0 else f"{p}-{c}", 1) for c in range(3) for p in range(12)]
    rows = T.blocks(spark.createDataFrame(turns, "conv_id long, pos long, turn_hash string, words long"))
    edges = rows.groupBy("digest").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n"), F.first(F.struct("up", "k", "hashes", "words", "before")).alias("e")).select("digest", "conv_id", "n", "e.*")
    found = T.steps(edges).collect()
    assert {r.depth for r in found if ":" in r.id} == {1, 2, 3, 5, 6, 7}
    assert len(found) == 8 + 3 * 4


def test_ids_of_one_node_hash_in_order_over_pieces(spark, monkeypatch):
    monkeypatch.setattr(T, "PIECE_IDS", 7)
    ids = list(range(-50, 3000, 3))
    ends = spark.createDataFrame([("d", i) for i in random.Random(1).sample(ids, len(ids))] + [("e", 5)], "digest string, conv_id long").repartition(9)
    assert {r.digest: r.ends_sha256 for r in T.ends_hash(ends).collect()} == {"d": hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), "e": hashlib.sha256(b"5").hexdigest()}
