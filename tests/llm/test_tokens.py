"""Encoding, tree concatenation, edits and packing against the library and plain versions."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from commentloom.llm import bpe, codec, edits, packing

PIECES = [" ", " ", "  ", "\n", "\t", "a", "b", "s", "t", "re", "ll", "'", "'", "1", "²", "é", "!", "?", "ß", "日", "本", "\u0085", "\x1c", "I'd", "😀", "'VE", "\r\n", "the", "ing"]


@pytest.fixture(scope="module")
def tokenizer():
    return bpe.load(bpe.default_path())


def mixed(rng, n):
    return "".join(rng.choice(PIECES) for _ in range(n))


def test_ids_are_those_of_the_library(tokenizer):
    rng = random.Random(1)
    batch = [mixed(rng, rng.randint(0, 30)) for _ in range(3000)] + ["", "a<|endoftext|>b"]
    expected = [e.ids for e in tokenizer.tokenizer.encode_batch(batch, add_special_tokens=False)]
    assert [x.tolist() for x in tokenizer.encode(batch)] == expected
    assert [tokenizer.decode(x) for x in expected] == [tokenizer.tokenizer.decode(x, skip_special_tokens=False) for x in expected]


@pytest.mark.parametrize("alphabet", [PIECES, list("abcdethinro日本é")])
def test_tree_concatenation(tokenizer, alphabet):
    rng = random.Random(2)
    for _ in range(400):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(2, 200)))
        part = rng.choice([1, 2, 3, 5, 9, 20, 90])
        node = codec.concatenate(tokenizer, [codec.Node.of(tokenizer, text[i : i + part]) for i in range(0, len(text), part)])
        whole = codec.Node.of(tokenizer, text)
        assert node.ids.tolist() == tokenizer.tokenizer.encode(text, add_special_tokens=False).ids
        assert node.at.tolist() == whole.at.tolist() and node.first.tolist() == whole.first.tolist()


def test_edits_update_the_count(tokenizer):
    rng = random.Random(3)
    for _ in range(400):
        text = mixed(rng, rng.randint(0, 120))
        tree = edits.build(tokenizer, [text], rng.choice([1, 2, 8]))[0]
        cuts = sorted(rng.sample(range(len(text) + 1), min(2 * rng.randint(0, 4), (len(text) + 1) // 2 * 2)))
        own = [(a, b - a, mixed(rng, rng.randint(0, 5))) for a, b in zip(cuts[::2], cuts[1::2])]
        expected = text
        for at, removed, inserted in reversed(own):
            expected = expected[:at] + inserted + expected[at + removed :]
        assert tree.edit(tokenizer, text, own) == expected
        assert tree.total() == len(tokenizer.encode([expected])[0])


def test_plans_hold_every_item():
    rng = random.Random(4)
    for _ in range(150):
        capacity = rng.choice([10, 37, 1024])
        items = [rng.randint(1, rng.choice([capacity, max(1, capacity // 3)])) for _ in range(rng.randint(1, 300))]
        found = Counter()
        plan = packing.plan(dict(Counter(items)), capacity)
        for content, times in plan:
            assert sum(content) <= capacity and times > 0
            for w in content:
                found[w] += times
        assert found == Counter(items)
        plain = []
        for x in sorted(items, reverse=True):
            fitting = [i for i, held in enumerate(plain) if held + x <= capacity]
            if fitting:
                plain[max(fitting, key=lambda i: plain[i])] += x
            else:
                plain.append(x)
        assert sum(t for _, t in packing.best_fit(dict(Counter(items)), capacity)) == len(plain)
        assert sum(t for _, t in plan) <= len(plain) + 1


def test_fixed_sets_keep_the_optimum():
    """On small instances the reduction leaves as few sequences as an exhaustive search finds."""

    def least(items, capacity):
        best = [len(items)]

        def place(i, open_):
            if len(open_) >= best[0]:
                return
            if i == len(items):
                best[0] = len(open_)
                return
            for room in {r for r in open_ if r >= items[i]}:
                rest = list(open_)
                rest.remove(room)
                place(i + 1, [*rest, room - items[i]])
            place(i + 1, [*open_, capacity - items[i]])

        place(0, [])
        return best[0]

    rng = random.Random(5)
    for _ in range(120):
        capacity = rng.choice([10, 13, 20])
        items = sorted((rng.randint(1, capacity) for _ in range(rng.randint(1, 8))), reverse=True)
        fixed, rest = packing.reduce(dict(Counter(items)), capacity)
        left = sorted((w for w, n in rest.items() for _ in range(n)), reverse=True)
        assert sum(t for _, t in fixed) + (least(left, capacity) if left else 0) == least(items, capacity)


def rows_of(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()]


@pytest.mark.parametrize("part_chars", [200, 1 << 15])
def test_round_trip(docs, no_docs, tokenizer, part_chars):
    found = sorted(map(tuple, codec.round_trip(docs, bpe.default_path(), part_chars=part_chars).collect()), key=str)
    expected = []
    for doc_id, text in rows_of(docs):
        ids = tokenizer.tokenizer.encode(text, add_special_tokens=False).ids
        expected.append((doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert found == sorted(expected, key=str)
    assert codec.round_trip(no_docs, bpe.default_path()).count() == 0


def test_packing_of_documents(docs, no_docs, tokenizer):
    capacity = 128
    found = packing.pack(docs, bpe.default_path(), capacity).collect()
    cut = Counter()
    for doc_id, text in rows_of(docs):
        ids = [*tokenizer.tokenizer.encode(text, add_special_tokens=False).ids, 2]
        first = len(ids) % capacity or capacity
        starts = [0, *range(first, len(ids), capacity)]
        for i, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)])):
            cut[doc_id, i, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found) == cut
    sequences = {}
    for r in found:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    assert packing.pack(no_docs, bpe.default_path()).count() == 0


def test_recount(docs, no_docs, tokenizer):
    path = bpe.default_path()
    found = edits.recount(docs, edits.trees(docs, path), edits.redactions(docs), path).collect()
    import re

    expected = []
    for doc_id, text in rows_of(docs):
        new, n = re.subn(edits.PERSONAL, "<redacted>", text)
        expected.append((doc_id, *(len(tokenizer.tokenizer.encode(t, add_special_tokens=False).ids) for t in (text, new)), n))
    assert sorted((tuple(r)[:4] for r in found), key=str) == sorted(expected, key=str)
    assert edits.recount(no_docs, edits.trees(no_docs, path), edits.redactions(no_docs), path).count() == 0


def test_recount_beside_columns_of_the_same_names(spark):
    """Columns named like the operator's own, and a text edited at both ends."""
    path = bpe.default_path()
    rows = [(1, "12345 calls from a@b.cd", "x", "y", "z"), (2, "no edit", "x", "y", "z"), (3, "12345 calls from a@b.cd", "x", "y", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __key string, __text string, t string")
    found = {r["doc_id"]: r for r in edits.recount(docs, edits.trees(docs, path), edits.redactions(docs), path).collect()}
    assert found[2]["n_edits"] == 0 and found[2]["n_tokens"] == found[2]["n_tokens_before"]
    assert found[1]["n_edits"] == found[3]["n_edits"] == 2
    plan = edits.recount(docs, edits.trees(docs, path), edits.redactions(docs), path)._jdf.queryExecution().optimizedPlan().toString()
    joined = [line for line in plan.splitlines() if "Join LeftOuter" in line or "Join Inner" in line]
    assert len(joined) == 3
