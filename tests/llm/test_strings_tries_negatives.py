"""Repeated strings, the trie of conversations and hard negatives against plain versions."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from panelwright.llm import hard_negatives, prefix_trie, queries, suffix_repeats

# -- repeated strings --------------------------------------------------------


def plain_strings(rows, keep, window=200):
    """(key, bytes left, maximal runs) of (key, text) rows, in the order given for equal keys."""
    rows = sorted(rows, key=lambda r: math.inf if r[0] is None else r[0])
    bodies = [(t or "").encode() for _, t in rows]
    seen, total, out = set(), Counter(), []
    for body in bodies:
        total.update(hash(body[i : i + window]) for i in range(len(body) - window + 1))
    for (key, _), body in zip(rows, bodies):
        gone = np.zeros(len(body) + 1, int)
        for i in range(len(body) - window + 1):
            said = hash(body[i : i + window])
            if said in seen if keep == "first" else total[said] > 1:
                gone[i] += 1
                gone[i + window if i + window < len(body) else len(body)] -= 1
            seen.add(said)
        gone = np.cumsum(gone[:-1]) > 0
        runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(body) else 0
        out.append((key, len(body), int(gone.sum()), runs, bytes(np.frombuffer(body, np.uint8)[~gone])))
    return out


def check_strings(df, rows, keep):
    got = suffix_repeats.drop_repeated_strings(df, keep=keep).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, plain_strings(rows, keep)))


def prose(rng, size):
    return "".join(rng.choice("abcdefgh éü漢 ") for _ in range(size))


@pytest.mark.parametrize("keep", ["first", "none"])
def test_strings_match_a_plain_version(docs_of, keep):
    rng = random.Random(3)
    common, line = [prose(rng, rng.choice((150, 199, 200, 230, 700, 2500))) for _ in range(12)], prose(rng, 90)
    texts = [None, "", "short", "é" * 99, "é" * 100, "ab" * 400, "q" * 3000, "q" * 199]
    for _ in range(90):  # parts shared at other places, in other company; a line that is in most texts
        texts.append("".join(rng.choice([prose(rng, rng.randrange(1, 400)), rng.choice(common), line]) for _ in range(rng.randrange(1, 7))))
    texts += [texts[20], texts[20], texts[30][5:], texts[31][:-7]]
    ids = rng.sample(range(10_000), len(texts))
    check_strings(docs_of(texts, ids), list(zip(ids, texts)), keep)


@pytest.mark.parametrize("keep", ["first", "none"])
def test_a_common_passage_in_ever_different_company(docs_of, keep):
    rng = random.Random(4)
    passage = prose(rng, 260)
    texts = [prose(rng, rng.randrange(20, 300)) + passage + prose(rng, rng.randrange(20, 300)) for _ in range(120)]
    texts += [prose(rng, 50) + passage[:150] + prose(rng, 200) for _ in range(80)]
    check_strings(docs_of(texts), list(enumerate(texts)), keep)


def test_a_very_long_text_comes_in_pieces(docs_of):
    rng = np.random.default_rng(5)
    body = rng.integers(97, 123, 2_600_000).astype(np.uint8).tobytes().decode()
    long = body + body[1_048_000:1_049_500] + body[2_000_000:2_000_199] + body[5:300]
    texts = [long, "x" + body[1_048_400:1_048_700] + "y", body[700:800]]
    check_strings(docs_of(texts), list(enumerate(texts)), "none")


def test_strings_of_odd_rows(spark, docs_of, odd):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    check_strings(odd, rows, "none")
    done = {r["doc_id"]: r for r in suffix_repeats.drop_repeated_strings(odd, keep="first").collect() if r["doc_id"] not in (None, 99)}
    assert done[7]["n_removed"] > 0 and done[8]["kept"] == b""  # "same text" repeats itself; its copy goes whole
    empty = odd.where("false")
    assert suffix_repeats.drop_repeated_strings(empty).count() == 0
    with pytest.raises(ValueError):
        suffix_repeats.drop_repeated_strings(odd, window=10)


def test_longest_previous_factors():
    rng = np.random.default_rng(0)
    for _ in range(40):
        text = rng.integers(0, 2, rng.integers(1, 60)).astype(np.uint8).tobytes()
        order = np.array(sorted(range(len(text)), key=lambda i: text[i:]))
        def common(a, b):
            n = 0
            while max(a, b) + n < len(text) and text[a + n] == text[b + n]:
                n += 1
            return n
        shared = np.array([0, *[common(a, b) for a, b in zip(order[:-1], order[1:])]])
        got = dict(zip(order.tolist(), suffix_repeats.longest_previous(order, shared, 1).tolist()))
        assert got == {i: max([0, *[common(i, j) for j in range(i)]]) for i in range(len(text))}


# -- the trie ------------------------------------------------------------------


def plain_trie(paths):
    """Node rows of {conversation: list of (role, text)}."""
    members = defaultdict(list)
    for c, turns in paths.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = set()
    for node, cs in members.items():
        below = [n for n in members if n[: len(node)] == node]
        childless = [n for n in below if not any(len(m) == len(n) + 1 and m[: len(n)] == n for m in members)]
        ends = ",".join(map(str, sorted(c for c in cs if len(paths[c]) == len(node))))
        out.add((
            min(cs), len(node), min(members[node[:-1]]) if node else None, len(cs),
            sum(len(m) == len(node) + 1 for m in below), len(childless),
            sum((len(members[n]) - 1) * len(n[-1][1]) for n in below if n), hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return out


def trie_rows(df, **more):
    return {tuple(r) for r in prefix_trie.prefix_trie(df, **more).collect()}


SCHEMA = "conv_id bigint, turn int, role string, text string, depth string, owner string"


def table(spark, paths):
    rows = [(c, i, r, t, "x", "y") for c, turns in paths.items() for i, (r, t) in enumerate(turns)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_trie_matches_a_plain_version(spark):
    rng = random.Random(2)
    paths = {}
    for c in rng.sample(range(-50, 5000), 70):
        turns = list(rng.choice(list(paths.values())))[: rng.randrange(9)] if paths and rng.random() < 0.8 else []
        paths[c] = turns + [(rng.choice("ua"), rng.choice(["", "é", "long text", "漢字"])) for _ in range(rng.randrange(0, 6))]
    ids = spark.createDataFrame([(c,) for c in paths], "conv_id bigint")
    assert trie_rows(table(spark, paths), everyone=ids) == plain_trie(paths)


def test_trie_of_long_paths_that_branch_everywhere(spark):
    trunk = [("u", str(i)) for i in range(37)]
    paths = {100 + i: trunk[:i] + [("a", "leaf")] for i in range(37)} | {1: trunk, 200: trunk, 201: trunk[:20]}
    assert trie_rows(table(spark, paths)) == plain_trie(paths)


def test_trie_of_odd_rows(spark):
    rows = [
        (None, 0, "u", "lost", "", ""), (5, None, None, "b", "", ""), (5, 1, "u", None, "", ""), (5, 1, "u", None, "", ""),
        (6, None, "", "b", "", ""), (6, 1, "a", "z" * 50_000, "", ""), (6, 1, "a", "y", "", ""), (7, 3, None, None, "", ""),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    expected = {5: [("", "b"), ("u", ""), ("u", "")], 6: [("", "b"), ("a", "y"), ("a", "z" * 50_000)], 7: [("", "")]}
    assert trie_rows(df) == plain_trie(expected)
    assert trie_rows(df.where("conv_id IS NULL")) == set() == trie_rows(df.where("false"))
    assert trie_rows(df.where("false"), everyone=df.select("conv_id")) == plain_trie({5: [], 6: [], 7: []})


def test_conversations_are_rebuilt(spark):
    rng = random.Random(9)
    own = {c: [(rng.choice("ua"), str(rng.randrange(3))) for _ in range(rng.randrange(1, 8))] for c in [0, 1, 2, 7, 50, 99, 100, 140, 333, 341]}
    paths = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        paths[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    turns, ids = queries.rebuilt_conversations(table(spark, own))
    assert trie_rows(turns, order="place", everyone=ids) == plain_trie(paths)


def test_two_fattest(spark):
    pairs = [(a, b) for b in range(1, 70) for a in range(b)]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(pairs, "a bigint, b bigint")
    for a, b, f in df.select("a", "b", prefix_trie.two_fattest(F.col("a"), F.col("b"))).collect():
        assert f == max(range(a + 1, b + 1), key=lambda n: n & -n)


# -- hard negatives --------------------------------------------------------------


def plain_negatives(rows, every):
    """Rows of (vec_id, vector, label); anchors are ids that ``every`` divides."""
    clean = [
        (i, [math.floor(256 * x) for x in v], l) for i, v, l in rows
        if l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for a, v, label in clean:
        if a is None or a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), math.inf if i is None else i, l) for i, w, l in clean if i != a)
        for s, p, _ in [r for r in scored if r[2] == label][:5]:
            inside = [r for r in scored if r[2] != label and 80 * -s <= 100 * -r[0] <= 100 * -s][:5]
            out += [(a, p, k + 1, n, -s, -t) for k, (t, n, _) in enumerate(inside)]
    return sorted(out, key=str)


def negatives(df, every):
    from pyspark.sql import functions as F

    got = hard_negatives.mine_hard_negatives(df, F.col("vec_id") % every == 0)
    names = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    return sorted((tuple(r) for r in got.select(*names).collect()), key=str)


VECTORS = "vec_id bigint, embedding array<float>, label int, anchor string, key string, score int"


def test_negatives_match_a_plain_version(spark):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(600):
        v = np.round(rng.normal(size=6) + 2, 1 if i % 3 else 0).astype(np.float32).tolist()  # many ties
        rows.append((i, v, int(rng.integers(0, 3))))
    rows += [(1000 + i, rows[20][1], rows[20][2]) for i in range(30)]  # copies of an anchor, and of another label
    rows += [(1100 + i, rows[20][1], 3) for i in range(30)]
    df = spark.createDataFrame([(*r, "a", "k", 1) for r in rows], VECTORS).repartition(4)
    assert negatives(df, 20) == plain_negatives(rows, 20)


def test_negatives_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 2.0], 1), (1, None, 1), (2, [1.0, None], 1), (3, [nan, 1.0], 1), (4, [inf, 1.0], 2), (5, [1.0, 1.5], None),
        (6, [1.0, 2.0], 1), (6, [1.0, 2.0], 1), (7, [1.0], 2), (8, [1.0, 1.9, 5.0], 2), (9, [], 2), (11, [1.0, 1.8], 2),
        (11, [1.0, 1.8], 2), (12, [0.0, 0.0], 2), (20, [-1.0, -1.0], 1), (30, [0.0, 0.0], 4), (31, [0.0, 0.0], 4),
    ]
    df = spark.createDataFrame([(*r, "a", "k", 1) for r in rows], VECTORS)
    assert negatives(df, 10) == plain_negatives(rows, 10)
    assert negatives(df.where("false"), 10) == []
    # Null keys come last among ties; a repeated anchor is mined for each of its rows.
    more = df.unionByName(df.where("vec_id = 8").withColumn("vec_id", df["vec_id"] * None)).unionByName(df.where("vec_id = 0"))
    got = negatives(more, 10)
    assert any(r[3] is None for r in got)
    assert all(got.count(r) % 2 == 0 for r in got if r[0] == 0)
    with pytest.raises(Exception, match="not exact"):
        negatives(spark.createDataFrame([(0, [3e20], 1, "", "", 1), (1, [3e20], 1, "", "", 1)], VECTORS), 10)


def test_keys_sort_as_pairs_do():
    rng = np.random.default_rng(1)
    anchor, score, ids = (rng.integers(-3, 3, 300) * 10**k for k in (0, 12, 17))
    packed = hard_negatives.pack(anchor, score, hard_negatives.NEGATIVE, ids)
    assert [x.tolist() for x in hard_negatives.unpack(packed)] == [anchor.tolist(), score.tolist(), [1] * 300, ids.tolist()]
    order = sorted(range(300), key=lambda i: packed[i].as_py())
    pairs = [(anchor[i], -score[i], ids[i]) for i in order]
    assert pairs == sorted(pairs)
