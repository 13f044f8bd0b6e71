"""Near duplicates, vector links and the pipeline against all pairs."""

import collections
import importlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from panelwright.llm import components, shingle_join, vector_links

WORD = re.compile(r"[^\x20\x09-\x0D]+")
VOCABULARY = [f"w{i}" for i in range(500)]


def shingles(text, size=5):
    own = WORD.findall(text or "")
    return {tuple(own[i : i + size]) for i in range(max(1, len(own) - size + 1))} if own else set()


def classes(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def plain_near(texts, threshold=0.8):
    sets = [shingles(t) for t in texts]
    links = [
        (a, b) for a in range(len(texts)) for b in range(a)
        if sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])
    ]
    counts = collections.Counter(x for pair in links for x in pair)
    return {n: (root, counts[n]) for n, root in classes(range(len(texts)), links).items()}


def corpus(rng):
    def text(n):
        return " ".join(rng.choice(VOCABULARY) for _ in range(n))

    texts = [text(rng.randint(5, 80)) for _ in range(60)]
    for base in texts[:12]:
        for edits in (0, 1, 1, 2, 4):
            own = base.split()
            for _ in range(edits):
                own[rng.randrange(len(own))] = "new"
            texts.append(" ".join(own))
    texts += [texts[3].replace(" ", "\n")] * 30 + ["a b", "a  b", "a b c", None, "", None, text(3000)]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("block", [512, 7])
def test_near_duplicates(docs_of, monkeypatch, block):
    monkeypatch.setattr(shingle_join, "SIGNATURE_BLOCK", block)
    monkeypatch.setattr(shingle_join, "SET_BLOCK", block)
    texts = corpus(random.Random(12))
    rows = shingle_join.near_duplicates(docs_of(texts)).collect()
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in rows} == plain_near(texts)
    assert all(r["kept"] == (r["doc_id"] == r["class_id"]) for r in rows)


def test_near_duplicates_of_odd_rows(odd):
    rows = shingle_join.near_duplicates(odd).collect()
    assert len(rows) == odd.count() and shingle_join.near_duplicates(odd.limit(0)).count() == 0
    by_key = collections.defaultdict(list)
    for r in rows:
        by_key[r["doc_id"]].append(r)
    assert [r["n_links"] for r in by_key[None]] == [1, 1] and sorted(r["kept"] for r in by_key[None]) == [False, True]
    assert sorted(r["kept"] for r in by_key[99]) == [False, True] and by_key[8][0]["class_id"] == 7
    kept = shingle_join.drop_near_duplicates(odd)
    assert kept.schema == odd.schema and kept.count() == odd.count() - 3


def depths_tried(monkeypatch):
    tried = []
    nodes = shingle_join._nodes

    def watched(tries, depth, before):
        tried.append(depth)
        return nodes(tries, depth, before)

    monkeypatch.setattr(shingle_join, "_nodes", watched)
    return tried


def test_prefixes_are_shortened_until_links_are_found(docs_of, monkeypatch):
    monkeypatch.setattr(shingle_join, "TREES", 4)
    monkeypatch.setattr(shingle_join, "_FACTORS", shingle_join._FACTORS[:24])
    tried = depths_tried(monkeypatch)
    texts = corpus(random.Random(13))
    rows = shingle_join.near_duplicates(docs_of(texts), target=0.99999).collect()
    wanted = plain_near(texts)
    assert sum((r["class_id"], r["n_links"]) == wanted[r["doc_id"]] for r in rows) >= 0.97 * len(texts)
    assert tried[0] == 6 and tried[-1] == 1 and tried == sorted(set(tried), reverse=True)


@pytest.mark.parametrize("changed, last", [(0, 6), (1, 6), (12, 6), (40, 4)])
def test_prefixes_are_as_long_as_the_pairs_seen_allow(docs_of, monkeypatch, changed, last):
    tried = depths_tried(monkeypatch)
    rng = random.Random(19)
    texts = []
    for _ in range(40):  # the last words are changed: (400 - changed) / (400 + changed) of the shingles are common
        own = [str(rng.getrandbits(60)) for _ in range(404)]
        texts += [" ".join(own), " ".join(own[: 404 - changed] + [f"x{rng.getrandbits(60)}" for _ in range(changed)])]
    rows = {r["doc_id"]: r["class_id"] for r in shingle_join.near_duplicates(docs_of(texts)).collect()}
    assert all(rows[i] == rows[i + 1] == i for i in range(0, 80, 2))
    assert tried[0] == 6 and tried[-1] == last


@pytest.mark.parametrize("size", [1, 7, 64])
def test_entries_know_what_they_share_with_their_neighbours(size):
    rng = np.random.default_rng(20)
    keys = rng.integers(0, 3, (300, 7)).astype(np.int32)
    keys = keys[np.lexsort(keys.T[::-1])]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(np.arange(300)), *[pa.array(keys[:, c]) for c in range(7)]], ["row", "tree", *shingle_join.LEVELS]
    )
    got = {
        r["row"]: r["shared"]
        for part in shingle_join._neighbours(batch.slice(s, size) for s in range(0, 300, size)) for r in part.to_pylist()
    }

    def common(a, b):
        return max(0, next((n for n in range(7) if a[n] != b[n]), 7) - 1)

    for n in range(1, 299):
        wanted = max(common(keys[n], keys[n - 1]), common(keys[n], keys[n + 1]))
        assert got.get(n, 0) == wanted
    assert got[0] == got[299] == 6


def test_borderline_pairs_are_found_beside_many_near_copies(docs_of):
    rng = random.Random(18)
    texts, wanted = [], {}
    for _ in range(2500):  # 45 shingles, five of them changed: Jaccard similarity 40 / 50
        own = [str(rng.getrandbits(60)) for _ in range(49)]
        other = [*own[:20], "new", *own[21:]]
        wanted[len(texts) + 1] = len(texts)
        texts += [" ".join(own), " ".join(other)]
    for _ in range(500):  # a changed last word: 299 / 301
        own = [str(rng.getrandbits(60)) for _ in range(304)]
        for i in range(3):
            wanted[len(texts)] = len(texts) - i
            texts.append(" ".join([*own[:-1], f"last{i}"]))
    rows = {r["doc_id"]: r["class_id"] for r in shingle_join.near_duplicates(docs_of(texts)).collect()}
    lost = sum(rows[a] != b for a, b in wanted.items())
    assert lost <= 3, lost  # 0.02% of 2,500 is half a pair; 0.8% would be 19


def test_components(spark):
    rng = random.Random(14)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 460)]
    links += [(600, 600 + i) for i in range(1, 50)] + [(7, 7)]
    df = spark.createDataFrame([*links, (None, 5)], "a bigint, b bigint")
    nodes = {n for a, b in links if a != b for n in (a, b)}
    got = {r["node"]: r["root"] for r in components.components(df).collect()}
    assert got == classes(nodes, links)
    assert components.components(df.limit(0)).count() == 0


def test_components_of_long_paths_over_many_tasks(spark):
    """Links of one component lie in many tasks, so that stars of tasks must be joined over rounds."""
    rng = np.random.default_rng(9)
    names = rng.permutation(2_000)
    links = [(int(a), int(b)) for path in np.split(names, [1_200, 1_900, 1_960]) for a, b in zip(path, path[1:])]
    expected = {int(n): int(path.min()) for path in np.split(names, [1_200, 1_900, 1_960]) for n in path}
    links += [(b, a) for a, b in links[::7]] + [(5, 5)]
    df = spark.createDataFrame([links[i] for i in rng.permutation(len(links))], "a bigint, b bigint").repartition(40)
    got = components.components(df.unionByName(spark.createDataFrame([(None, 3)], "a bigint, b bigint")))
    assert {r["node"]: r["root"] for r in got.collect()} == expected
    assert got.count() == len(expected)


def test_stars_of_links():
    rng = np.random.default_rng(10)
    a, b = rng.integers(0, 400, 300), rng.integers(0, 400, 300)
    parent = {int(n): int(n) for n in np.concatenate([a, b])}
    for _ in range(400):
        for x, y in zip(a.tolist(), b.tolist()):
            parent[x] = parent[y] = min(parent[x], parent[y])
    nodes, roots = components.stars(a, b)
    assert dict(zip(nodes.tolist(), roots.tolist())) == {n: r for n, r in parent.items() if n != r}


def plain_vectors(rows, threshold=0.93):
    fit = {}
    for key, vector, label in rows:
        if vector and label is not None and None not in vector and np.isfinite(vector).all() and np.any(vector):
            scaled = np.array(vector) / np.abs(vector).max()
            fit[key] = (label, scaled / np.linalg.norm(scaled))
    links = [
        (a, b) for a in fit for b in fit
        if b < a and fit[a][0] == fit[b][0] and len(fit[a][1]) == len(fit[b][1]) and fit[a][1] @ fit[b][1] >= threshold
    ]
    counts = collections.Counter(x for pair in links for x in pair)
    return {n: (counts[n], root, n == root) for n, root in classes([r[0] for r in rows], links).items()}


@pytest.mark.parametrize("block", [1024, 16])
def test_vector_links(spark, monkeypatch, block):
    monkeypatch.setattr(vector_links, "BLOCK", block)
    monkeypatch.setattr(vector_links, "PAIRS", 50)
    rng = np.random.default_rng(15)
    base = rng.normal(size=(30, 12))
    rows = [(i, (base[i % 30] * (1 + i) + rng.normal(size=12) * (1 + i) * 0.25).tolist(), i % 3) for i in range(150)]
    rows += [(200 + i, base[0].tolist(), 0) for i in range(40)] + [(300, base[0].tolist(), None)]
    rows += [(301, None, 0), (302, [], 0), (303, [0.0] * 12, 0), (304, [float("nan")] * 12, 0), (305, [None, *[1.0] * 11], 0)]
    rows += [(306, [1.0, 2.0], 0), (307, [2.0, 4.0], 0), (308, (base[0] * 1e200).tolist(), 0), (309, [float("inf"), *[1.0] * 11], 0)]
    rng.shuffle(keys := [r[0] for r in rows])
    rows = [(int(k), v, label) for k, (_, v, label) in zip(keys, rows)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id bigint, embedding array<double>, label int, row int")
    got = {r["vec_id"]: tuple(r)[1:] for r in vector_links.vector_links(df.repartition(4)).collect()}
    assert got == plain_vectors(rows)
    assert vector_links.vector_links(df.limit(0)).count() == 0
    twice = spark.createDataFrame([(None, [1.0], 1), (None, [1.0], 1), (5, [2.0], 1)], "vec_id bigint, embedding array<double>, label int")
    assert {tuple(r) for r in vector_links.vector_links(twice).collect()} == {(None, 2, 5, False), (5, 2, 5, True)}


def test_bounds_hold_for_every_pair():
    rng = np.random.default_rng(16)
    for width in (1, 3, 64, 1500):
        unit = rng.normal(size=(60, width)) * rng.lognormal(0, 2, (60, width))
        unit /= np.linalg.norm(unit, axis=1)[:, None]
        codes = vector_links.quantised(unit)
        least, most = vector_links.bounds(codes, codes)
        exact = unit @ unit.T
        assert (most >= exact - 1e-12).all() and (most - exact).max() < 0.2
        assert (least <= exact + 1e-12).all() and (exact - least).max() < 0.2


def test_only_doubtful_vectors_are_read_in_full(spark, monkeypatch):
    rng = np.random.default_rng(17)
    base = rng.normal(size=(20, 64))
    base /= np.linalg.norm(base, axis=1)[:, None]
    near = base + rng.normal(size=base.shape) * 0.001  # surely linked
    other = rng.normal(size=base.shape)
    other -= (other * base).sum(axis=1)[:, None] * base
    other /= np.linalg.norm(other, axis=1)[:, None]
    edge = [b * c + o * (1 - c * c) ** 0.5 for b, o, c in zip(base[:2], other, (0.931, 0.929))]
    rows = [(i, v.tolist(), 1) for i, v in enumerate([*base, *near, *edge])]
    read = []
    tile = vector_links.per_tile

    def watched(tiles, group, function, schema):
        if "vector" in tiles.columns:
            read.extend(r["row"] for r in tiles.select("row").collect())
        return tile(tiles, group, function, schema)

    monkeypatch.setattr(vector_links, "per_tile", watched)
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    got = {r["vec_id"]: tuple(r)[1:] for r in vector_links.vector_links(df).collect()}
    assert got == plain_vectors(rows) and 2 <= len(read) <= 6


def test_pipeline_stages_keep_their_contract(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_duplicates", "decontamination", "secrets", "packing"]
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, docs, folder)
        assert left.schema == docs.schema
        docs = corpus_pipeline.frozen(left)
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert set(after) <= set(before)
        if name == "near_duplicates":
            roots = plain_near([before[i] for i in sorted(before)])
            assert sorted(after) == [i for n, i in enumerate(sorted(before)) if roots[n][0] == n]
        if name != "secrets":
            assert all(after[i] == before[i] for i in after)
        else:
            secret = {i for i in before if re.search("[0-9a-f]{24}", before[i])}
            assert set(after) == set(before) and secret <= {i for i in after if after[i] != before[i]}
            assert not any(re.search("[0-9a-f]{24}", t) for t in after.values())
        before = after
    packed = {r["doc_id"] for r in corpus_pipeline.packed(spark, docs, folder).collect()}
    assert packed == set(before)
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, folder).collect()} == packed


def test_stages_take_odd_rows(spark, odd):
    docs = odd.drop("id", "row")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), "/root/testdata/sf0.001").count() == 0, name
        stage(spark, docs, "/root/testdata/sf0.001").collect()


def test_queries_are_registered():
    found = importlib.import_module("__spark_entry__").queries()
    assert all(any(name.startswith(f"op{n}_") for name in found) for n in range(1, 11)) and "pipeline" in found
