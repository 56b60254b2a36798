"""Neighbours, scores, language, archive and the pipeline."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from commentloom.llm import language, neighbours, queries, scoring, warc


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, v string, id string")


def exact_neighbours(rows, queries, k):
    out = {}
    for q, x in queries.items():
        scored = sorted((-float(np.dot(x, y)), i) for i, y in rows.items() if i != q)
        out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    points = rng.normal(size=(600, 16)).astype(np.float32)
    points[100:300] = points[5]  # a hot vector
    points[7] *= 2
    rows = [(i, [float(x) for x in p], 0, "x", "y") for i, p in enumerate(points)]
    odd = [(600, None, 0, "", ""), (601, [0.0] * 16, 0, "", ""), (602, [float("nan")] * 16, 0, "", ""), (603, [None] * 16, 0, "", ""), (None, rows[3][1], 0, "", ""), rows[3], (604, [float("inf")] * 16, 1, "", "")]
    table = vectors(spark, rows + odd)
    found = neighbours.search(table, table.where("vec_id % 20 = 0"), window=0.6, orderings=4).collect()
    by_query = {}
    for r in sorted(found, key=lambda r: (r["query_id"], r["rank"])):
        by_query.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    held = {i: points[i].astype(float) for i in range(600)}
    expected = exact_neighbours(held, {i: held[i] for i in range(0, 600, 20)}, 20)
    assert set(by_query) == set(expected) and all(len(v) == 20 for v in by_query.values())
    hits = 0
    for q, answers in by_query.items():
        assert all(math.isclose(s, float(held[i] @ held[q]), rel_tol=1e-12) for i, s in answers)
        hits += len({i for i, _ in answers} & {i for i, _ in expected[q]})
    assert hits >= 0.9 * 20 * len(expected)
    assert [i for i, _ in by_query[100]] == [5, *range(101, 120)]


def test_all_candidates_if_fewer(spark):
    table = vectors(spark, [(i, [1.0, float(i)], 0, "", "") for i in range(5)])
    found = neighbours.search(table, table.where("vec_id = 0")).collect()
    assert sorted((r["rank"], r["vec_id"], r["score"]) for r in found) == [(i, i, 1.0) for i in range(1, 5)]
    empty = table.limit(0)
    assert neighbours.search(empty, empty).count() == 0


def test_hilbert_is_a_curve():
    side = 16
    cells = np.array([(x, y, z) for x in range(side) for y in range(side) for z in range(side)])
    order = np.argsort(neighbours.hilbert(cells, 4))
    assert sorted(neighbours.hilbert(cells, 4)) == list(range(side**3))
    assert (np.abs(np.diff(cells[order], axis=0)).sum(axis=1) == 1).all()


def test_recall_on_the_table(spark):
    folder = "/root/testdata/sf0.01"
    table = spark.read.parquet(f"{folder}/embeddings.parquet")
    held = {r["vec_id"]: np.array(r["embedding"], float) for r in table.collect()}
    expected = exact_neighbours(held, {i: x for i, x in held.items() if i % 20 == 0}, 20)
    found = {(r["query_id"], r["vec_id"]) for r in queries.QUERIES["op5_hilbert_neighbours"](spark, folder).collect()}
    hits = sum((q, i) in found for q, answers in expected.items() for i, _ in answers)
    assert hits >= 0.9 * 20 * len(expected)


def test_ties_beyond_a_block_go_to_smaller_ids(spark):
    """399 distinct vectors with one product, and more queries than a part takes."""
    rng = np.random.default_rng(2)
    rows = [(0, [1.0, 0.0, 0.0])] + [(i, [0.5, *rng.normal(size=2).tolist()]) for i in rng.permutation(np.arange(1, 400)).tolist()]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = neighbours.search(table, table.where("vec_id = 0"), window=2.0)
    assert [r["vec_id"] for r in found.orderBy("rank").collect()] == list(range(1, 21))


def test_bounded_asking_groups(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "ASKING", 16)
    rng = np.random.default_rng(3)
    held = {i: rng.normal(size=6) for i in range(300)}
    table = spark.createDataFrame([(i, v.tolist()) for i, v in held.items()], "vec_id long, embedding array<double>")
    found = neighbours.search(table, table, k=3, window=2.0).collect()
    expected = exact_neighbours(held, held, 3)
    assert {(r["query_id"], r["rank"], r["vec_id"]) for r in found} == {(q, n + 1, i) for q, answers in expected.items() for n, (i, _) in enumerate(answers)}


@pytest.mark.parametrize("block_bytes, order", [(600, 3), (32 << 20, 5)])
def test_backoff_scores(docs, no_docs, block_bytes, order):
    rows = [(r["doc_id"], (r["text"] or "").encode()) for r in docs.select("doc_id", "text").collect()]
    fold = lambda i: 0 if i is None else zlib.crc32(str(i).encode()) % 2
    counts, totals = [Counter(), Counter()], [0, 0]
    for i, data in rows:
        totals[fold(i)] += len(data)
        for p in range(len(data)):
            for k in range(1, min(p + 1, order) + 1):
                counts[fold(i)][data[p + 1 - k : p + 1]] += 1

    def rate(gram, c, n):
        if len(gram) == 1:
            return c[gram] / n if c[gram] else 1 / (n + 256)
        return c[gram] / c[gram[:-1]] if c[gram] else 0.4 * rate(gram[1:], c, n)

    expected = []
    for i, data in rows:
        other = 1 - fold(i)
        total = sum(math.log2(rate(data[max(0, p - order + 1) : p + 1], counts[other], totals[other])) for p in range(len(data)))
        expected.append((i, len(data), total))
    found = [tuple(r)[:3] for r in scoring.score(docs, order=order, block_bytes=block_bytes).collect()]
    key = lambda r: (str(r[0]), r[1])
    for a, b in zip(sorted(found, key=key), sorted(expected, key=key), strict=True):
        assert a[:2] == b[:2] and math.isclose(a[2], b[2], rel_tol=1e-9, abs_tol=1e-9)
    assert scoring.score(no_docs).count() == 0


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language.predictions(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in found) >= 0.97 * len(found) > 0
    assert all(0 <= r["score"] <= 1 for r in found)


def test_language_of_odd_rows(docs, no_docs):
    found = {(r["doc_id"], r["lang_pred"], r["score"]) for r in language.predictions(docs).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    silent = {i for i, t in texts.items() if i is not None and (t is None or not any(c.isalpha() for c in t))}
    assert {i for i, lang, _ in found if lang == "und" and i is not None} == silent
    assert all(s == 0 for _, lang, s in found if lang == "und")
    kept = language.accepted(docs, language.fit(docs))
    assert kept.columns == docs.columns and silent.isdisjoint({r["doc_id"] for r in kept.collect()})
    assert language.predictions(no_docs).count() == 0


def test_texts_outside_all_languages_go(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    rng = random.Random(5)
    blob = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(600))
    odd = [blob, "Ο ήλιος λάμπει πάνω από τη θάλασσα και τα παιδιά παίζουν στην παραλία. " * 4, "xq zvkj qqx wzxk jvqz kkxq zzvw qxj " * 8]
    more = spark.createDataFrame([(-1 - i, t, None) for i, t in enumerate(odd)], "doc_id long, text string, lang string")
    kept = [r["doc_id"] for r in corpus_pipeline.known_language(spark, docs.unionByName(more), "").collect()]
    assert not [i for i in kept if i < 0]
    assert len(kept) >= 0.99 * docs.count()


def test_texts_stay_where_nothing_is_learned(spark):
    docs = spark.createDataFrame([(1, "Some text.", None), (2, "Other text.", None), (3, "12 !", None)], "doc_id long, text string, lang string")
    assert {r["doc_id"] for r in corpus_pipeline.known_language(spark, docs, "").collect()} == {1, 2}


def test_limits_come_from_all_labelled_texts(spark):
    """More texts than the sample of `fit` has, some held out, without an id, or copies; against each half's own model."""
    rng = random.Random(11)
    words = {"aa": "stone light under window garden letter".split(), "bb": "étoile fenêtre jardin lettre matin".split()}
    rows = []
    for i in range(1500):
        lang = "aa" if i % 3 else "bb"
        text = " ".join(rng.choice(words[lang]) + rng.choice(["", "s", "x"]) for _ in range(rng.randrange(3, 30 if i < 900 else 9)))
        rows.append((None if i % 50 == 0 else i, text, lang))
    rows += [(2000, rows[7][1], "aa"), (2001, "12 34", "aa"), (2002, "", "bb"), (2003, None, "aa"), (2004, "letter", None)]
    found = language.fit_with_limits(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    learned = [(t.encode(), lang) for _, t, lang in rows if t and lang]
    counts, rates = [Counter(), Counter()], {"aa": [], "bb": []}
    for t, lang in learned:
        for p in range(len(t)):
            k = min(p + 1, 4)
            counts[zlib.crc32(t) % 2][lang, k, int.from_bytes(t[p + 1 - k : p + 1], "big")] += 1
    models = [language.build([(*key, n) for key, n in sorted(c.items())]) for c in counts]
    for t, lang in learned:
        if language.HAS_LETTER.search(t.decode()):
            bits = models[1 - zlib.crc32(t) % 2].lengths([t])[0, ["aa", "bb"].index(lang)]
            rates[lang].append((bits / len(t), len(t)))
    for lang, own in rates.items():
        rate, size = np.array(own).T
        middle = np.median(rate)
        spread = max(1.0, 1.4826 * np.median(np.abs(rate - middle) * np.sqrt(np.minimum(size, language.LONG))))
        assert np.allclose(found.limits[lang], (middle, spread), rtol=1e-4)


def test_texts_are_not_judged_by_themselves(spark):
    """A labelled blob and its copies are learned from, but go; a usual text stays, and so does the only one of a language."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    rng = random.Random(6)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    blobs = ["".join(rng.choice(letters) for _ in range(900)) for _ in range(2)]
    usual = docs.where("lang = 'de'").orderBy("doc_id").first()["text"]
    rare = "Ο ήλιος λάμπει πάνω από τη θάλασσα και τα παιδιά παίζουν στην παραλία."
    for rows, stay in (
        ([(-1, blobs[0], "en"), (-2, blobs[0], "en"), (-3, blobs[1], "de"), (-4, usual, None), (None, usual, "de")], {-4, None}),
        ([(-1, rare, "el"), (-2, rare, None)], {-1, -2}),
    ):
        more = spark.createDataFrame(rows, "doc_id long, text string, lang string")
        kept = corpus_pipeline.known_language(spark, docs.unionByName(more), "").select("doc_id").collect()
        assert {r["doc_id"] for r in kept if r["doc_id"] is None or r["doc_id"] < 0} == stay


def test_counting_in_bounded_parts(spark, monkeypatch):
    """Counts do not depend on how many strings a task holds; shorter strings count at a text's start only."""
    texts = [("a", "abcabcabd"), ("a", "ab"), ("b", "é"), ("a", "abcabcabd"), ("b", "")] * 3
    rows = spark.createDataFrame(texts, "lang string, t string").coalesce(1)
    expected = Counter((lang, min(p + 1, 4), int.from_bytes(t.encode()[max(0, p - 3) : p + 1], "big")) for lang, t in texts for p in range(len(t.encode())))
    for most in (1, 1 << 19):
        monkeypatch.setattr(language, "HELD_GRAMS", most)
        monkeypatch.setattr(language, "SLICE_BYTES", 16)
        assert {(r["lang"], r["size"], r["gram"]): r["n"] for r in language.grams(rows).collect()} == expected


def test_code_lengths_are_exact():
    """Against the recursion written out for one language."""
    text = b"abracadabra abrac"
    counted = [("l", k, int.from_bytes(text[max(0, p + 1 - k) : p + 1], "big"), 1) for p in range(len(text)) for k in [min(p + 1, 4)]]
    folded = [(*key, n) for key, n in Counter((lang, k, g) for lang, k, g, _ in counted).items()]
    model = language.build(folded)
    after = {}
    for p in range(len(text)):
        for k in range(0, min(p, 3) + 1):
            after.setdefault(text[p - k : p], Counter())[text[p : p + 1]] += 1

    def bits(context, c):
        own = after.get(context)
        if own is None:
            return bits(context[1:], c)
        q, total = len(own), sum(own.values())
        if own[c]:
            return -math.log2(own[c] / (total + q))
        return -math.log2(q / (total + q)) + (bits(context[1:], c) if context else 8.0)

    for probe in (text, b"cabbage", b"zzz", b""):
        expected = sum(bits(probe[max(0, p - 3) : p], probe[p : p + 1]) for p in range(len(probe)))
        assert math.isclose(model.lengths([probe, b"ab"])[0, 0], expected, rel_tol=1e-5, abs_tol=1e-5)


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, strong string, n int")


def test_archive(spark, tmp_path):
    import hashlib

    big, other = "é" * 600, "<p>" + "x" * 2000 + "\r\n\r\n</p>"
    rows = [(1, "http://a/", big), (5, "http://b/\r\nx", big), (3, None, big), (2, "u", "small"), (4, "u", "small"), (6, "u", None), (7, "u", ""), (None, "u", other), (8, "u", other), (9, "v", other), (9, "v", other)]
    table = pages(spark, [(*r, "s", 1) for r in rows])
    found = sorted(map(tuple, warc.round_trip(table).collect()), key=str)
    expected = []
    for page_id, _, html in rows:
        data = (html or "").encode()
        winner = max(i for i, _, h in rows if (h or "") == (html or "") and i is not None)
        revisit = len(data) >= 1000 and page_id != winner
        expected.append((page_id, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", winner if revisit else None))
    assert found == sorted(expected, key=str)
    headers, payloads = warc.archive(table)
    assert payloads.count() == len({h or "" for _, _, h in rows})
    records = warc.records(headers, payloads)
    warc.write_files(records.coalesce(1), str(tmp_path / "w"))
    data = b"".join(p.read_bytes() for p in sorted((tmp_path / "w").glob("part-*")))
    seen = []
    while data:  # a reader that goes by Content-Length alone
        head, data = data.split(b"\r\n\r\n", 1)
        lines = head.decode().split("\r\n")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        size = int(fields["Content-Length"])
        assert lines[0] == "WARC/1.1" and data[size : size + 4] == b"\r\n\r\n"
        seen.append((fields["WARC-Type"], hashlib.sha1(data[:size]).hexdigest() if size else "-"))
        data = data[size + 4 :]
    assert len(seen) == len(rows) and ("response", hashlib.sha1(big.encode()).hexdigest()) in seen
    assert warc.round_trip(table.limit(0)).count() == 0


def test_damaged_payload_is_found(spark):
    from pyspark.sql import functions as F

    headers, payloads = warc.archive(pages(spark, [(1, "u", "text", "", 1)]))
    with pytest.raises(Exception, match="does not have its digest"):
        warc.records(headers, payloads.withColumn("payload", F.lit(b"other"))).collect()


def test_pipeline(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    taken = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = taken.columns
    sizes = [taken.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        taken = stage(spark, taken, str(tmp_path))
        assert taken.columns == columns, name
        taken.write.parquet(str(tmp_path / name))
        taken = spark.read.parquet(str(tmp_path / name))
        sizes.append(taken.count())
    assert sizes == sorted(sizes, reverse=True)
    texts = [r["text"] or "" for r in taken.collect()]
    grams = Counter(t.encode()[i : i + 200] for t in texts for i in range(len(t.encode()) - 199))
    assert len(texts) < 26 and (not grams or max(grams.values()) == 1)
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == {r["doc_id"] for r in taken.select("doc_id").collect()}


def test_empty_pipeline(spark, no_docs, tmp_path):
    no_docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
