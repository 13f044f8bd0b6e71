"""Language model, packing, quality, repeats and decontamination against plain versions."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from panelwright.llm import decontaminate, kneser_ney, packing, pu_quality, repeats, words
from panelwright.llm.queries import tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
VOCABULARY = [f"w{i}" for i in range(60)] + ["The", "the", "é", "A,"]


def sentence(rng, count, words_=VOCABULARY):
    return " ".join(rng.choice(words_) for _ in range(count))


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def test_words_and_their_hashes():
    texts = pa.array(["a  B\tc", None, "", " x ", "é\x0bb\x1cd", "a b"])
    found = words.Words(texts)
    assert found.count.tolist() == [3, 0, 0, 1, 2, 2]
    a, b = found.hashes(), found.hashes(lower=True)
    assert a[0] == a[6] and a[1] != a[7] and b[1] == b[7]
    assert len(set(a.tolist())) == 7 and not set(a.tolist()) & set(found.hashes(seed=1).tolist())
    pairs = words.Words.window_hashes(b, found.windows(2), 2)
    assert found.windows(2).tolist() == [0, 1, 4, 6] and pairs[0] == pairs[3]


def plain_model(train):
    def cut(counts):
        n = [sum(c == k for c in counts) for k in (1, 2, 3, 4)]
        if not all(n):
            return [0, 0.5, 0.5, 0.5]
        y = n[0] / (n[0] + 2 * n[1])
        raw = [1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2]]
        return [0, *[min(max(r, 0.05), k - 0.05) for k, r in enumerate(raw, 1)]]

    count = collections.Counter(w for t in train for w in t)
    pairs = collections.Counter(p for t in train for p in zip([0, *t[:-1]], t))
    before = collections.Counter(w for _, w in pairs)
    d1, d2 = cut(before.values()), cut(pairs.values())
    total, kinds = collections.Counter(), collections.defaultdict(lambda: [0, 0, 0, 0])
    for (v, _), c in pairs.items():
        total[v] += c
        kinds[v][min(c, 3)] += 1
    size, left = sum(before.values()), sum(d1[min(c, 3)] for c in before.values())

    def chance(v, w):
        c = before.get(w, 0)
        single = max(c - d1[min(c, 3)], 0) / size + left / size / (len(count) + 1)
        if not total.get(v):
            return single
        c = pairs.get((v, w), 0)
        return (max(c - d2[min(c, 3)], 0) + sum(a * b for a, b in zip(d2, kinds[v])) * single) / total[v]

    return count, chance


@pytest.mark.parametrize("part_tokens", [1 << 22, 40])
def test_language_model(docs_of, monkeypatch, part_tokens):
    monkeypatch.setattr(kneser_ney, "PART_TOKENS", part_tokens)
    rng = random.Random(1)
    texts = [None, "", "the The", *[sentence(rng, rng.randint(1, 90)) + " the the the" for _ in range(40)], "unseen words é"]
    docs = docs_of(texts)
    train = docs.where("doc_id % 5 <> 3")
    model = kneser_ney.train(train)
    tokens = [WORD.findall(lower(t or "")) + [None] for t in texts]
    count, chance = plain_model([t for i, t in enumerate(tokens) if i % 5 != 3])
    if part_tokens == 40:
        assert model.parts > 1 and len(model.hot)
    for row in kneser_ney.score_texts(docs, model).collect():
        own = tokens[row["doc_id"]]
        n, v = sum(count.values()), len(count)
        assert (row["n_tokens"], row["n_known"], row["train_tokens"]) == (len(own), sum(w in count for w in own), n)
        assert row["base_score"] == pytest.approx(sum(math.log10((count.get(w, 0) + 1) / (n + v + 1)) for w in own))
        assert row["score"] == pytest.approx(sum(math.log10(chance(a, b)) for a, b in zip([0, *own[:-1]], own)))
    # Probabilities after any context add up to one, a word never seen included.
    for context in ("the", "w1", None, "never"):
        assert sum(chance(context, w) for w in [*count, "never seen"]) == pytest.approx(1)


def test_language_model_of_nothing(docs_of):
    docs = docs_of(["a b", None])
    rows = kneser_ney.score_texts(docs, kneser_ney.train(docs.limit(0))).collect()
    assert [(r["train_tokens"], r["n_known"]) for r in rows] == [(0, 0)] * 2 and all(r["score"] <= 0 for r in rows)
    assert kneser_ney.score_texts(docs.limit(0), kneser_ney.train(docs)).count() == 0


def test_encoder_equals_the_tokenizer():
    from tokenizers import Tokenizer

    own, full = packing.Encoder(tokenizer_path()), Tokenizer.from_file(tokenizer_path())
    full.encode_special_tokens = True
    rng = random.Random(2)
    letters = list("aAé漢 \n\t.,'|!12 　 \x85 <>s't") + ["don't", " the", "<|endoftext|>", "\r\n"]
    texts = ["", " ", "a", "word, word. word! Word", *["".join(rng.choice(letters) for _ in range(rng.randint(1, 60))) for _ in range(800)]]
    for text, ids in zip(texts, own.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == full.encode(text, add_special_tokens=False).ids, repr(text)


def test_encoder_knows_added_tokens(docs_of, tmp_path):
    from tokenizers import AddedToken, Tokenizer

    def same(path, texts):
        own, full = packing.Encoder(path, encode_special_tokens=False), Tokenizer.from_file(path)
        for text, ids in zip(texts, own.encode(texts)):
            assert np.frombuffer(ids, "<u4").tolist() == full.encode(text, add_special_tokens=False).ids, repr(text)

    rng = random.Random(19)
    bits = ["<|endoftext|>", "<|end", "of", "text|>", " ", "  ", "a", "é", "\n", "<", "|>", " the", "<|x|>", "<|x|>y", "z<|x"]
    texts = ["a<|endoftext|>b", "<|endoftext|>", "a <|endoftext|> b  <|endoftext|>", "<|endoftext|><|endoftext|>"]
    texts += ["".join(rng.choice(bits) for _ in range(rng.randint(1, 12))) for _ in range(800)]
    same(tokenizer_path(), texts)
    more = Tokenizer.from_file(tokenizer_path())
    more.add_special_tokens([AddedToken("<|x|>", normalized=False), AddedToken("<|x|>y", normalized=False)])
    more.add_tokens([AddedToken("z<|x", normalized=True), AddedToken("of", normalized=True)])
    more.save(str(tmp_path / "more.json"))
    same(str(tmp_path / "more.json"), texts)
    full = Tokenizer.from_file(tokenizer_path())
    for r in packing.pack(docs_of(texts[:4]), tokenizer_path()).collect():
        ids = [*full.encode(texts[r["doc_id"]], add_special_tokens=False).ids, 0]
        assert (r["length"], r["ids_crc32"]) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))


@pytest.mark.parametrize("size", [16, 2048])
def test_packing(docs_of, odd, size):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    rng = random.Random(4)
    texts = [None, "", *[sentence(rng, rng.randint(0, 30)) for _ in range(150)], *["same words here"] * 80, sentence(rng, 900)]
    rows = packing.pack(docs_of(texts), tokenizer_path(), size=size).collect()
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, text in enumerate(texts):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        start = 0
        for n, r in enumerate(sorted(pieces[i], key=lambda r: r["piece"])):
            part = np.array(ids[start : start + r["length"]], "<u4").tobytes()
            assert (r["piece"], r["start"], r["ids_crc32"]) == (n, start, zlib.crc32(part))
            assert n == 0 or r["length"] == size
            start += r["length"]
        assert start == len(ids)
    for places in sequences.values():
        places.sort()
        assert [o for o, _ in places] == [sum(n for _, n in places[:k]) for k in range(len(places))]
        assert sum(n for _, n in places) <= size
    total = sum(r["length"] for r in rows)
    assert len(sequences) <= math.ceil(total / size) * 1.06 + 1
    assert packing.pack(docs_of([]), tokenizer_path()).count() == 0
    assert packing.pack(odd, tokenizer_path()).select("doc_id").where("doc_id IS NULL").count() == 2


def test_plan_uses_every_piece_once():
    rng = np.random.default_rng(6)
    for lengths in ([5] * 1000, rng.integers(1, 2049, 3000), rng.integers(1000, 1100, 500), [2048] * 3, [1], []):
        histogram = np.bincount(np.asarray(lengths, int), minlength=2049)
        used = np.zeros(2049, int)
        for pattern, repeats in packing.plan(histogram, 2048):
            assert sum(pattern) <= 2048 and repeats > 0
            np.add.at(used, list(pattern), repeats)
        assert (used == histogram).all()


def test_quality_learns_from_positives_and_unlabelled(spark):
    rng = random.Random(8)
    good = [sentence(rng, rng.randint(20, 60)) + ". And so on." for _ in range(500)]
    bad = [" ".join(f"{w}%%%" for w in sentence(rng, 30).split()) for _ in range(200)]
    texts = good + bad + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    labels = spark.createDataFrame([(i, 1, "z") for i in range(0, 500, 3)] + [(None, 1, "z"), (1, None, "z")], "doc_id bigint, quality int, text string")
    rows = {r["doc_id"]: r for r in pu_quality.score_quality(docs, labels).collect()}
    assert len(rows) == len(texts) and all(0 <= r["score"] <= 1 for r in rows.values())
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in rows.items())
    assert np.mean([rows[i]["score"] >= 0.3 for i in range(500)]) > 0.95
    assert np.mean([rows[i]["score"] < 0.3 for i in range(500, 700)]) > 0.95
    kept = {r["doc_id"] for r in pu_quality.keep_good(docs, labels, 0.3).collect()}
    assert kept == {i for i, r in rows.items() if r["score"] >= 0.3}
    assert {r["score"] for r in pu_quality.score_quality(docs, labels.limit(0)).collect()} == {0.5}
    assert pu_quality.score_quality(docs.limit(0), labels).count() == 0


def test_held_out_labels_change_nothing(spark):
    docs = spark.createDataFrame([(i, f"text {i} " * (i % 7 + 1)) for i in range(120)], "doc_id bigint, text string")
    out = [i for i in range(120) if zlib.crc32(str(i).encode()) % 5 == 0]
    base = spark.createDataFrame([(i, 1) for i in range(0, 120, 2) if i not in out], "doc_id bigint, quality int")
    more = base.unionByName(spark.createDataFrame([(i, 1) for i in out], base.schema))
    first, second = ({r["doc_id"]: r["score"] for r in pu_quality.score_quality(docs, x).collect()} for x in (base, more))
    assert all(first[i] == pytest.approx(second[i], abs=1e-9) for i in first)


def plain_repeats(rows, window):
    seen, result = {}, {}
    texts = {}
    for key, text in rows:
        texts.setdefault(key, []).append(WORD.findall(text or ""))
    order = sorted(texts, key=lambda k: (k is None, k))
    for key in order:
        for own in texts[key]:
            for s in range(len(own) - window + 1):
                place = (order.index(key), s)
                said = tuple(own[s : s + window])
                seen[said] = min(seen.get(said, place), place)
    for key in order:
        for own in texts[key]:
            gone = {i for s in range(len(own) - window + 1) if seen[tuple(own[s : s + window])] != (order.index(key), s) for i in range(s, s + window)}
            result[key] = (len(own), len(gone), " ".join(w for i, w in enumerate(own) if i not in gone))
    return result


def test_repeated_windows(docs_of, odd, monkeypatch):
    monkeypatch.setattr(repeats, "FLUSH", 500)
    monkeypatch.setattr(repeats, "FLUSH_REPEATED", 100)
    monkeypatch.setattr(repeats, "PART_CELLS", 1 << 12)
    monkeypatch.setattr(repeats, "GROUP_WINDOWS", 200)
    rng = random.Random(9)
    shared = sentence(rng, 30)
    texts = [sentence(rng, rng.randint(0, 60)) + ("\n " + shared if i % 3 else "") + " " + sentence(rng, 5) for i in range(60)]
    texts += [texts[7], "x y " * 40, None, ""]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    wanted = plain_repeats(list(zip(ids, texts)), 20)
    got = {r["doc_id"]: tuple(r)[1:] for r in repeats.drop_repeats(docs_of(texts, ids)).collect()}
    assert got == wanted
    hashed = {r["doc_id"]: r["kept"] for r in repeats.drop_repeats(docs_of(texts, ids), digest=True).collect()}
    assert hashed == {k: hashlib.sha256(v[2].encode()).hexdigest() for k, v in wanted.items()}
    rows = repeats.drop_repeats(odd, window=5).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in rows} == plain_repeats([(r["doc_id"], r["text"]) for r in odd.collect()], 5)
    assert len(rows) == odd.count() and repeats.drop_repeats(odd.limit(0)).count() == 0


def test_repeated_windows_of_rows_that_share_a_key(docs_of):
    rng = random.Random(20)

    def fresh(n):
        return " ".join(f"u{rng.getrandbits(60)}" for _ in range(n))

    a, b, c, d = fresh(30), fresh(30), fresh(25), fresh(40)
    long, short, equal = f"{fresh(900)} {a} {fresh(10)} {a}", f"{b} {fresh(5)} {b}", fresh(50)
    texts = [long, short, f"{fresh(10)} {c} {fresh(10)}", f"{fresh(400)} {d} {d}", f"{c} {c}", equal, equal, fresh(30), f"{a} end"]
    keys = [None, None, 5, 5, 7, 9, 9, 2**63 - 1, None]
    frame = docs_of(texts, keys).coalesce(1)
    got = collections.defaultdict(list)
    for r in repeats.drop_repeats(frame).collect():
        got[r["doc_id"]].append((r["n_words"], r["n_removed"], r["kept"]))
    order = [(r["doc_id"], r["text"]) for r in frame.collect()]
    order.sort(key=lambda r: (r[0] is None, r[0] or 0))  # rows of one key keep their order
    wanted, plain = collections.defaultdict(list), plain_repeats([(i, t) for i, (_, t) in enumerate(order)], 20)
    for i, (key, _) in enumerate(order):
        wanted[key].append(plain[i])
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in wanted.items()}
    assert sorted(n for _, n, _ in got[9]) == [0, 50]


def edit_distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(new[j - 1] + 1, row[j] + 1, row[j - 1] + (p != t)))
        row = new
    return min(row)


def test_myers_is_the_edit_distance():
    rng = random.Random(10)
    for _ in range(300):
        pattern = [rng.randint(0, 3) for _ in range(rng.randint(1, 80))]
        text = [rng.randint(0, 3) for _ in range(rng.randint(0, 60))]
        distance, end = decontaminate.myers(pattern, text)
        assert distance == edit_distance(pattern, text) and edit_distance(pattern, text[:end]) == distance


def test_decontamination(spark, docs_of, odd, monkeypatch):
    rng = random.Random(11)
    vocabulary = [f"v{i}" for i in range(400)]
    items = [sentence(rng, n, vocabulary) for n in (30, 41, 12, 7, 5)] + ["v1", "", None, "— ! —"]
    table = spark.createDataFrame([(i, t, 1) for i, t in enumerate(items)], "item_id bigint, text string, id int")
    texts = [sentence(rng, 200, vocabulary) for _ in range(30)]
    for i, item in enumerate(items[:5] * 4):
        own = item.split()
        for _ in range(i % 9):
            at = rng.randrange(len(own))
            rng.choice([lambda: own.insert(at, "new"), lambda: own.__setitem__(at, "New"), lambda: len(own) > 1 and own.pop(at)])()
        texts.append(sentence(rng, 40, vocabulary) + ".\n" + ", ".join(w.upper() for w in own) + " " + sentence(rng, 9, vocabulary))
    texts.append(" ".join([items[0]] * 3))

    def cut(text):
        return re.findall(r"[^\W_]+", (text or "").lower())

    wanted = {}
    for d, text in enumerate(texts):
        for i, item in enumerate(items):
            own = cut(item)
            if own and (distance := edit_distance(own, cut(text))) <= len(own) // 5:
                wanted[d, i] = distance
    docs = docs_of(texts)
    got = decontaminate.find_leaks(docs, table).collect()
    assert {(r["doc_id"], r["item_id"]): r["distance"] for r in got} == wanted and len(got) == len(wanted)
    for r in got:
        span = cut(texts[r["doc_id"]])[r["start_word"] : r["end_word"]]
        assert edit_distance(cut(items[r["item_id"]]), span) == r["distance"]
    clean = {r["doc_id"] for r in decontaminate.drop_leaks(docs, table).collect()}
    assert clean == set(range(len(texts))) - {d for d, _ in wanted}
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 200)
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(docs, table).collect()} == set(wanted)
    assert decontaminate.find_leaks(odd, table).count() == 0 and decontaminate.drop_leaks(odd, table.limit(0)).count() == odd.count()
    assert decontaminate.find_leaks(docs.limit(0), table).count() == 0


def thue_morse(size):
    """Two words that polynomial hashes with an odd base do not tell apart modulo a power of two."""
    bits = [bin(i).count("1") % 2 for i in range(size)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_words_that_cancel_out_are_told_apart(docs_of):
    from panelwright.llm import decontaminate, shingle_join

    one, two = thue_morse(1024)
    found = words.Words(pa.array([f"{one} {two}", " ".join(thue_morse(2048)[0]), " ".join(thue_morse(2048)[1])]))
    for seed in (0, 1):
        hashes = found.hashes(seed=seed)
        assert hashes[0] != hashes[1]
        assert len(set(words.sequence_hashes(hashes, found.doc_start[:-1], found.doc_start[1:], seed).tolist())) == 3
        long = words.Words.window_hashes(hashes, np.array([2, 2050]), 2048, seed)
        assert long[0] != long[1]
    rest = " ".join(f"w{i}" for i in range(19))
    docs = docs_of([f"{one} {rest}", f"{two} {rest}"])
    assert [r["n_removed"] for r in repeats.drop_repeats(docs).collect()] == [0, 0]
    scored = kneser_ney.score_texts(docs, kneser_ney.train(docs.where("doc_id = 0"))).orderBy("doc_id").collect()
    assert [r["n_known"] for r in scored] == [21, 20]
    same = shingle_join.near_duplicates(docs_of([" ".join([one] * 3), " ".join([two] * 3)])).collect()
    assert [r["n_links"] for r in same] == [0, 0]
    items = docs_of([" ".join([two] * 12)]).withColumnRenamed("doc_id", "item_id")
    assert decontaminate.find_leaks(docs_of([" ".join([one] * 30)]), items).count() == 0


def test_spans_of_all_lengths_have_their_own_hash():
    rng = np.random.default_rng(0)
    data = rng.integers(0, 3, 300).astype(np.uint8)
    spans = [(a, b) for a in range(300) for b in range(a + 1, min(a + 40, 301))]
    starts, ends = np.array(spans).T
    hashes = words.hash_spans(data, starts, ends)
    bodies = [data[a:b].tobytes() for a, b in spans]
    assert len(set(hashes.tolist())) == len(set(bodies)) == len({(h, b) for h, b in zip(hashes.tolist(), bodies)})
