"""Exact, near and substring dedup against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from commentloom.llm import components, exact, similar, simhash, substrings
from pyspark.sql import functions as F


def test_perfect_hash():
    for n in (1, 2, 3, 7, 500, 4000):
        digests = np.random.default_rng(n).integers(0, 256, (n, 32), dtype=np.uint8)
        displacement, by_slot = exact.perfect_hash(digests)
        assert (by_slot[exact.slots_of(displacement, n, digests)] == np.arange(n)).all()


@pytest.mark.parametrize("bucket_slots", [3, 50_000])
def test_exact_flags(docs, no_docs, bucket_slots):
    rows = [(r["doc_id"], re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "")) for r in docs.select("doc_id", "text").collect()]
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(text, []).append(doc_id)
    expected = []
    for doc_id, text in rows:
        keep = min((i for i in groups[text] if i is not None), default=None)
        expected.append((doc_id, keep, len(groups[text]), doc_id == keep, hashlib.sha256(text.encode()).hexdigest()))
    found = exact.flags(docs, bucket_slots=bucket_slots).collect()
    assert sorted(map(tuple, found), key=str) == sorted(expected, key=str)
    kept = exact.deduplicate(docs, bucket_slots=bucket_slots)
    assert kept.columns == docs.columns
    texts = [re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "") for r in kept.collect()]
    assert sorted(texts) == sorted(groups)
    assert exact.flags(no_docs).count() == 0 and exact.deduplicate(no_docs).count() == 0


def test_history_wins_and_strangers_group(spark):
    rows = lambda pairs: spark.createDataFrame([(bytearray(hashlib.sha256(t.encode()).digest()), i) for i, t in pairs], "digest binary, id long")
    won = exact.winners(rows([(5, "a"), (6, "b"), (6, "b")]), rows([(3, "a"), (9, "a"), (8, "c"), (7, "c")])).collect()
    found = {(r["keep_id"], r["group_size"], r["same"]) for r in won}
    assert found == {(3, 3, 1), (6, 2, 2), (7, 2, 1)}


def fingerprint(text):
    words = text.encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    ones = [sum(xxhash.xxh64_intdigest(s, 42) >> b & 1 for s in shingles) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def roots(values, distance):
    parent = list(range(len(values)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(values):
        for j in range(i):
            if (a ^ values[j]).bit_count() <= distance:
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return [root(i) for i in range(len(values))]


def test_near_duplicates(docs, no_docs):
    rows = [(r["doc_id"], fingerprint(r["text"] or "")) for r in docs.select("doc_id", "text").collect()]
    root = roots([f for _, f in rows], 3)
    least = {}
    for (doc_id, _), r in zip(rows, root):
        if doc_id is not None:
            least[r] = min(doc_id, least.get(r, doc_id))
    expected = sorted(((i, f"{f:016x}", least.get(r)) for (i, f), r in zip(rows, root)), key=str)
    assert sorted(map(tuple, simhash.near_duplicates(docs).collect()), key=str) == expected
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for (i, _), r in zip(rows, root) if i == least.get(r)}
    assert simhash.near_duplicates(no_docs).count() == 0 and simhash.keep_one(no_docs).count() == 0


@pytest.mark.parametrize("most", [4, 2048])
def test_no_link_is_lost(spark, most):
    """Chains and crowds of close fingerprints, also where keys are narrowed."""
    rng = random.Random(6)
    values = set()
    for _ in range(25):
        value = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 30])):
            values.add(value)
            for _ in range(rng.randint(1, 4)):
                value ^= 1 << rng.randrange(64)
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    marked = spark.createDataFrame(list(enumerate(signed)), "id long, fp long")
    found = {r["fp"]: r["component_id"] for r in simhash.classes(marked, most=most).collect()}
    assert [found[s] for s in signed] == roots(values, 3)


def test_components(spark):
    rng = random.Random(7)
    edges = [(i, i + 1) for i in range(40)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(50)] + [(7, 7)]
    found = dict(map(tuple, components.components(spark.createDataFrame(edges, "u long, v long")).collect()))
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in edges:
        a, b = root(u), root(v)
        parent[max(a, b)] = min(a, b)
    assert found == {x: root(x) for x in parent if root(x) != x}


@pytest.mark.parametrize("seed", range(2))
def test_components_of_random_edges(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(rng.choice([25, 40, 70]))] + [(7, 7), (3, 9), (3, 9)]
    least = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in least:
        for a, b in edges:
            if a != b:
                least[a] = least[b] = min(least[a], least[b])
    found = components.components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert sorted(map(tuple, found)) == sorted((x, c) for x, c in least.items() if x != c)


def test_rounds_are_few_and_lean(spark, monkeypatch, capsys):
    """Queries and plans take memory of the driver: stars need no round, and no star reads its edges more than twice."""
    tables = []
    monkeypatch.setattr(components, "cut", lambda df, put=components.cut: tables.append(put(df)) or tables[-1])
    edges = lambda pairs: spark.createDataFrame(pairs, "u long, v long")
    stars = components.components(edges([(1, 2), (3, 1), (8, 5), (5, 8), (9, 9)])).collect()
    assert sorted(map(tuple, stars)) == [(2, 1), (3, 1), (8, 5)] and len(tables) == 1
    capsys.readouterr()
    for star in (components._large_star, components._small_star):
        star(tables[0]).explain()
        assert capsys.readouterr().out.count("FileScan") == 2


def removed(texts, length):
    seen = {}
    data = [(t or "").encode() for t in texts]
    for k, b in enumerate(data):
        for i in range(len(b) - length + 1):
            seen.setdefault(b[i : i + length], []).append((k, i))
    marks = [np.zeros(len(b), bool) for b in data]
    for places in seen.values():
        if len(places) > 1:
            for k, i in places:
                marks[k][i : i + length] = True
    out = []
    for b, m in zip(data, marks):
        rest = bytes(np.frombuffer(b, np.uint8)[~m]) if b else b""
        runs = int((np.diff(np.concatenate([[0], m.astype(int)])) == 1).sum())
        out.append((len(b), int(m.sum()), runs, hashlib.sha256(rest).hexdigest(), rest))
    return out


@pytest.mark.parametrize("length, gram, most", [(24, 8, 20_000), (24, 8, 7), (40, 40, 11)])
def test_repeated_bytes(spark, monkeypatch, length, gram, most):
    rng = random.Random(8)
    pieces = ["alpha", "beta", "gamma", "delta ", "é", "日本", " ", "x", "yy"]
    base = ["".join(rng.choice(pieces) for _ in range(60)) for _ in range(6)]
    texts = []
    for _ in range(90):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 40)))
        for _ in range(rng.randint(0, 3)):
            b = rng.choice(base)
            a = rng.randint(0, len(b) - 1)
            text += b[a : a + rng.randint(5, 120)] + rng.choice(pieces)
        texts.append(text)
    texts += [None, "", "a" * 100, "ab" * 90, texts[3], texts[3]]
    monkeypatch.setattr(substrings._buckets, "__defaults__", (most,))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = sorted(map(tuple, substrings.report(frame, length=length, gram=gram).collect()))
    assert [f[1:] for f in found] == [e[:4] for e in removed(texts, length)]


def test_repeated_bytes_of_documents(docs, no_docs):
    rows = docs.select("doc_id", "text").collect()
    expected = removed([r["text"] for r in rows], 200)
    found = sorted(map(tuple, substrings.report(docs).collect()), key=str)
    assert found == sorted(((r["doc_id"], *e[:4]) for r, e in zip(rows, expected)), key=str)
    stripped = substrings.strip(docs)
    assert stripped.columns == docs.columns
    texts = sorted(str((r["doc_id"], r["text"])) for r in stripped.collect())
    assert texts == sorted(str((r["doc_id"], None if r["text"] is None else e[4].decode("utf-8", "ignore"))) for r, e in zip(rows, expected))
    assert substrings.report(no_docs).count() == 0 and substrings.strip(no_docs).count() == 0


def test_order_of_suffixes():
    rng = random.Random(9)
    rows = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 24))) for _ in range(700)]
    keys = substrings._words(rows, 24)
    order = substrings.multikey_quicksort(keys)
    padded = [r.ljust(24, b"\0") for r in rows]
    assert [padded[i] for i in order] == sorted(padded)
    shared = substrings.common(keys, order)
    for k in range(1, len(order)):
        a, b = padded[order[k - 1]], padded[order[k]]
        assert shared[k] == next((i for i in range(24) if a[i] != b[i]), 24)


def test_counter_of_groups_is_exact(docs):
    """Every row is in one group: sizes over the kept rows add up to the table."""
    found = exact.flags(docs).collect()
    by_text = Counter(r["text_sha256"] for r in found)
    assert all(by_text[r["text_sha256"]] == r["group_size"] for r in found)


def shingled(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def edited(text, rng, changes):
    words = text.split()
    for at in rng.sample(range(len(words)), changes):
        words[at] = f"changed{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("limits", [{}, {"most": 3, "pivots": 2}])
def test_pipeline_keeps_one_of_similar_texts(spark, limits):
    """Against all pairs, with copies around the limit, chains, and groups that are measured by pivots."""
    rng = random.Random(4)
    texts = [" ".join(f"w{rng.randrange(5000)}" for _ in range(150)) for _ in range(12)]
    for i in range(9):
        last = texts[i]
        for k in range(6):
            texts.append(last := edited(last if i % 2 else texts[i], rng, 1 + k % 5))
    texts += [None, "", "one two", "ONE  two", "one two three"]
    sets = [shingled(t) for t in texts]
    parent = list(range(len(texts)))

    def root(x):
        return x if parent[x] == x else root(parent[x])

    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    expected = sorted({root(i) for i in range(len(texts))})
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    if limits:
        kept = similar.keep_one(docs, **limits)
    else:
        kept = corpus_pipeline.near_copies(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == expected
    assert 12 < len(expected) < len(texts) - 10


def test_near_copies_go_by_row(spark):
    """Null and repeated ids: one row of each group stays, and rows outside of groups stay."""
    text = " ".join(f"w{i}" for i in range(200))
    other, third, fourth = (" ".join(f"{c}{i}" for i in range(200)) for c in "abc")
    rows = [(1, text), (None, text), (None, other), (None, third), (None, third), (7, fourth), (7, text), (7, "x y z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expected = sorted([(1, text), (None, other), (None, third), (7, fourth), (7, "x y z")], key=str)
    for kept in (simhash.keep_one(docs), similar.keep_one(docs)):
        assert sorted(map(tuple, kept.collect()), key=str) == expected


def test_pages_of_one_template_fall_apart(spark, monkeypatch):
    """2,000 pages at similarity 0.6 share keys, but need no round of pivots; near copies among them are found."""
    rng = random.Random(8)
    template = " ".join(f"t{i}" for i in range(152))
    own = lambda n: " ".join(f"o{rng.randrange(10**9)}" for _ in range(n))
    texts = [f"{template} {own(48)}" for _ in range(2000)]
    texts += [texts[5] + " more", texts[5] + " other", texts[9] + " end"]
    made = []
    monkeypatch.setattr(similar, "cut", lambda df, real=similar.cut: made.append(df) or real(df))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    kept = sorted(r["doc_id"] for r in similar.keep_one(docs, most=64).collect())
    assert kept == list(range(2000))
    assert len(made) < 20


def test_users_columns_survive_stripping(spark, docs):
    frame = docs.withColumns({c: F.lit("mine") for c in ("__null", "__key", "none", "rest", "spans", "k1")})
    stripped = substrings.strip(frame)
    assert stripped.columns == frame.columns
    assert {tuple(r) for r in stripped.select("__null", "__key", "none", "rest", "spans", "k1").collect()} == {("mine",) * 6}


def test_pipeline_links_near_copies_by_fingerprint_and_by_shingles(spark):
    """Texts of equal fingerprints whose shingle sets differ, a near copy by shingles only, and a text alone."""
    import corpus_pipeline

    common = " ".join(["alpha beta gamma"] * 200)
    words = [f"w{i}" for i in range(120)]
    texts = {
        1: " ".join([common, *[f"y{i}" for i in range(30)]]), 2: " ".join([common, *[f"z{i}" for i in range(30)]]),
        3: " ".join(words), 4: " ".join([*words[:60], "other", *words[60:]]), 5: " ".join(f"x{i}" for i in range(50)), 6: None, 7: "  ",
    }
    marks = {i: simhash.fingerprint(t or "") for i, t in texts.items()}
    assert (marks[3] ^ marks[4]).bit_count() > simhash.DISTANCE
    assert (marks[1] ^ marks[2]).bit_count() <= simhash.DISTANCE
    docs = spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id long, text string")
    alike = {r["doc_id"] for r in similar.keep_one(docs).collect()}
    kept = {r["doc_id"] for r in corpus_pipeline.near_copies(spark, docs, "").collect()}
    assert alike == {1, 2, 3, 5, 6}
    assert kept == {1, 3, 5, 6}
