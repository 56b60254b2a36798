"""Line dedup, periodic runs and centroid clustering against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from commentloom.llm import lines, runs, vafile

WHITE = " \t\n\x0b\x0c\r"


def key_of(line):
    return line.strip(WHITE).translate({c: c + 32 for c in range(65, 91)})


def brute_lines(rows):
    """doc_id, lines, dropped lines and digest of what stays, for (doc_id, text) rows."""
    holders = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            holders.setdefault(key_of(line), set()).add(doc)
    out = []
    for doc, text in rows:
        kept = []
        for line in (text or "").split("\n"):
            key = key_of(line)
            others = holders[key]
            first = min((d for d in others if d is not None), default=None)
            if len(key) < 10 or len(others) < 2 or doc == first:
                kept.append(line)
        n = len((text or "").split("\n"))
        out.append((doc, n, n - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def lined(seed, n):
    rng = random.Random(seed)
    pool = [f"{'Ab'[i % 2]}line number {i} of the pool" for i in range(30)] + ["short", "", "   ", "ABCDEFGHIJ", "ééééééééé", "x yyyyyyyyy  "]
    return [
        (i if i % 13 else None, "\n".join(rng.choice(["", " ", "\t"]) + rng.choice(pool).upper() * (i % 3 > 0) + rng.choice(pool) + rng.choice(["", " \r"]) for _ in range(rng.randint(1, 40))))
        for i in range(n)
    ] + [(1, "ABCDEFGHIJ"), (2, " abcdefghij\t"), (2, "abcdefghij\nabcdefghij"), (50, None), (51, ""), (None, "abcdefghij"), (52, "abcdefghi\nabcdefghi")]


def found(frame):
    return sorted(map(tuple, frame.collect()), key=str)


def test_lines_against_brute_force(spark, docs, no_docs):
    pairs = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert found(lines.report(lines.in_arrivals(docs), docs)) == brute_lines(pairs)
    rows = lined(1, 60)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(lines.report(lines.in_arrivals(frame), frame)) == brute_lines(rows)
    assert lines.report(lines.in_arrivals(no_docs), no_docs).count() == 0
    cleaned = lines.cleaned(lines.in_arrivals(docs), docs)
    assert cleaned.columns == docs.columns and cleaned.count() == docs.count()
    digests = sorted(hashlib.sha256((r["text"] or "").encode()).hexdigest() for r in cleaned.collect())
    assert digests == sorted(r[3] for r in brute_lines(pairs))


def test_lines_are_reversible(spark):
    """Insertions and deletions in any order leave what the documents that are left would make."""
    rows = lined(2, 40)
    part = lambda keep: spark.createDataFrame([r for r in rows if keep(r[0])], "doc_id long, text string")
    index = lines.empty(spark, 3)
    groups = [lambda d: d is not None and d % 3 == 0, lambda d: d is None, lambda d: d is not None and d % 3 > 0]
    for keep in groups:
        index = lines.insert(index, lines.references(part(keep)))
    assert found(lines.report(index, part(lambda d: True))) == brute_lines(rows)
    gone = lambda d: d is None or d % 4 == 0
    ids = spark.createDataFrame([(r[0],) for r in rows if gone(r[0])], "d long")
    index = lines.delete(index, ids)
    left = [r for r in rows if not gone(r[0])]
    assert found(lines.report(index, part(lambda d: not gone(d)))) == brute_lines(left)
    exact = {(bytes(r["digest"]), r["refs"], r["least"]) for r in index.counts.collect()}
    fresh = lines.insert(lines.empty(spark, 3), lines.references(part(lambda d: not gone(d))))
    assert exact == {(bytes(r["digest"]), r["refs"], r["least"]) for r in fresh.counts.collect()}
    # Removed keys are out of the filters: as many fingerprints as keys, or a few more by false alarms.
    held = sum(np.count_nonzero(np.frombuffer(r["cells"], "<u2")) for r in index.filters.collect())
    assert held == len(exact)
    back = lines.insert(index, lines.references(part(gone)))
    assert found(lines.report(back, part(lambda d: True))) == brute_lines(rows)


def test_cuckoo_filter():
    digests = np.random.default_rng(0).integers(0, 256, (9000, 16), dtype=np.uint8)
    cuckoo = lines.Cuckoo([], 1 << 10)
    cuckoo.add(digests[:6000])
    assert len(cuckoo.layers) == 2  # 4096 places a layer
    assert cuckoo.contains(digests[:6000]).all() and cuckoo.contains(digests[6000:]).mean() < 0.01
    cuckoo = lines.Cuckoo(cuckoo.blobs(), 1 << 10)
    cuckoo.remove(digests[:3000])
    assert cuckoo.contains(digests[3000:6000]).all() and cuckoo.contains(digests[:3000]).mean() < 0.01
    assert sum(np.count_nonzero(x) for x in cuckoo.layers) == 3000
    same = np.repeat(digests[:1], 20, axis=0)
    cuckoo.add(same)
    cuckoo.remove(same[:19])
    assert cuckoo.contains(same[:1]).all()
    cuckoo.remove(same[:1])
    assert sum(np.count_nonzero(x) for x in cuckoo.layers) == 3000


def brute_runs(seq, shortest=12):
    """(start, length, period) of all maximal stretches, under their least period."""
    out = {}
    for q in range(1, len(seq) // 2 + 1):
        i = 0
        while i < len(seq) - q:
            j = i
            while j < len(seq) - q and seq[j] == seq[j + q]:
                j += 1
            if j + q - i >= max(shortest, 2 * q):
                out.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in out.items())


def sequence(rng):
    n, letters = rng.randint(0, 150), rng.choice([1, 2, 3, 40])
    s = [rng.randrange(letters) for _ in range(n)]
    kind = rng.randrange(5)
    if kind == 1 and n:
        p = rng.randint(1, n)
        s = [s[i % p] for i in range(n)]
    if kind == 2:
        u = [0, 1] * rng.randint(1, 9) + [0] * rng.randint(0, 1)
        s = u * rng.randint(2, 4) + s
    if kind == 3:
        x, y = [0], [0, 1]
        for _ in range(rng.randint(1, 9)):
            x, y = y, y + x
        s = y
    return s


def test_runs_of_sequences():
    rng = random.Random(5)
    for _ in range(250):
        several = [sequence(rng) for _ in range(rng.randint(1, 4))]
        got = runs.find([np.array(s, np.int64) for s in several])
        assert [[tuple(x) for x in g.tolist()] for g in got] == [brute_runs(s) for s in several]
    with pytest.raises(ValueError):
        runs.find([], 4)


def test_suffixes_and_range_successor():
    ids = np.array([3, 1, 2, 1, 2, 1, 2, 1, 0, 9])
    suffixes = runs.Suffixes(ids)
    # By first appearance of equal blocks: an order of suffixes in which equal blocks lie together.
    for k, level in enumerate(suffixes.levels):
        for i in range(len(ids)):
            for j in range(len(ids)):
                same = ids[i : i + (1 << k)].tolist() == ids[j : j + (1 << k)].tolist() and max(i, j) + (1 << k) <= len(ids)
                assert (level[i] == level[j]) == (same or i == j)
    values = np.random.default_rng(1).permutation(300)
    tree = runs.Wavelet(values, 9)
    for left, right, x in [(0, 300, 120), (10, 40, 0), (7, 7, 5), (250, 300, 299)]:
        part = np.sort(values[left:right])
        at = lambda v: np.array([v])
        below = int(tree.below(at(left), at(right), at(x))[0])
        assert below == (part < x).sum()
        if below < len(part):
            assert tree.smallest(at(left), at(right), at(below))[0] == part[below]


def planted(doc_id, words):
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    n = len(words)
    if h is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def test_runs_report(spark, docs, no_docs):
    extra = spark.createDataFrame([(1000 + i, "a b  a\tb " * (i % 9) + f"w{i} " * (i % 20)) for i in range(80)], "doc_id long, text string")
    frame = docs.unionByName(extra, allowMissingColumns=True)
    expected = []
    for r in frame.select("doc_id", "text").collect():
        words = planted(r["doc_id"], (r["text"] or "").encode().split())
        all_runs = brute_runs(words) if len(words) < 2000 else [tuple(x) for x in runs.find([runs.numbers(words)])[0].tolist()]
        lost = {i for s, n, q in all_runs for i in range(s + q, s + n)}
        kept = b" ".join(w for i, w in enumerate(words) if i not in lost)
        best = min(all_runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
        top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        text = "".join(f"{s},{n},{q}\n" for s, n, q in all_runs)
        expected.append((r["doc_id"], len(all_runs), *top, hashlib.sha256(text.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()))
    assert found(runs.report(frame)) == sorted(expected, key=str)
    assert sum(e[1] for e in expected) > 40
    listed = found(runs.spans(extra))
    words = {r["doc_id"]: r["text"].split() for r in extra.collect()}
    assert listed == sorted(((d, *x) for d, w in words.items() for x in brute_runs(w)), key=str)
    short = runs.collapsed(extra.where("doc_id = 1008")).first()["text"]
    assert short == "a b w8 w8 w8 w8 w8 w8 w8 w8"
    assert runs.report(no_docs).count() == 0 and runs.spans(no_docs).count() == 0


def brute_clusters(rows, k=16, rounds=3):
    kept = [(i, [int(np.floor(64 * x)) for x in v]) for i, v in rows]
    hashes = [None if i is None else hashlib.sha256(f"1:{i}".encode()).hexdigest() for i, _ in kept]
    order = sorted(range(len(kept)), key=lambda j: (hashes[j] is None, hashes[j] or "", kept[j][1]))
    centroids = [kept[j][1] for j in order[:k]]
    distance = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    nearest = lambda v: min(range(len(centroids)), key=lambda c: (distance(v, centroids[c]), c))
    for _ in range(rounds):
        at = [nearest(v) for _, v in kept]
        own = lambda c: [v for (_, v), a in zip(kept, at) if a == c]
        centroids = [[sum(x) // len(o) for x in zip(*o)] if (o := own(c)) else m for c, m in enumerate(centroids)]
    at = [nearest(v) for _, v in kept]
    far = [distance(v, centroids[a]) for (_, v), a in zip(kept, at)]
    inertia = [sum(d for d, a in zip(far, at) if a == c) for c in range(len(centroids))]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, a, d, inertia[a], sum(far), digest[a]) for (i, _), a, d in zip(kept, at, far)), key=str)


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(4)
    good = [(i, (rng.normal(size=64) * (1 + i % 3) / 8 + i % 5).tolist()) for i in range(150)]
    good += [good[7], good[7], (None, good[9][1]), (None, [0.0] * 64), (5, good[3][1])] + [(1000 + i, good[0][1]) for i in range(40)]
    bad = [(900, None), (901, []), (902, [1.0] * 63), (903, [1.0] * 63 + [None]), (904, [float("nan")] * 64), (905, [float("inf")] + [0.0] * 63)]
    return good, bad


def test_clusters_against_brute_force(spark, vectors):
    good, bad = vectors
    frame = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>").select("*", F.lit(1).alias("row"), F.lit(2).alias("v"), F.lit(3).alias("id")).repartition(3)
    whole = lambda rows: vafile.whole_vectors(frame(rows))
    assert found(vafile.report(whole(good + bad))) == brute_clusters(good)
    assert found(vafile.report(whole(good[:5]))) == brute_clusters(good[:5])
    assert found(vafile.report(whole(good), bits=3, k=4, rounds=2)) == brute_clusters(good, 4, 2)
    assert vafile.report(whole(bad)).count() == 0


def test_cells_hold_the_distances(spark, vectors):
    good, _ = vectors
    v = np.array([np.floor(64 * np.array(x)) for _, x in good], np.int64)
    grid = vafile.Grid(v.min(axis=0), v.max(axis=0), v.mean(axis=0), v.std(axis=0), 6)
    packed = grid.packed(v)
    assert packed.shape[1] == 48
    cells = grid.unpacked(packed, 64)
    at = lambda bounds: np.take_along_axis(bounds.T, cells, axis=0)
    assert (at(grid.least) <= v).all() and (v <= at(grid.greatest)).all()
    centroids = v[[3, 50, 100]]
    least, greatest = grid.gaps(centroids)
    exact = vafile.distances(v, centroids)
    for c in range(3):
        low = sum(least[c][j][cells[:, j]] for j in range(64))
        high = sum(greatest[c][j][cells[:, j]] for j in range(64))
        assert (low <= exact[:, c]).all() and (exact[:, c] <= high).all()
    many = spark.createDataFrame([(i, (np.sin(np.arange(64) * (1 + i % 6)) + np.cos(i) / 50).tolist()) for i in range(400)], "vec_id long, embedding array<double>")
    clusters = vafile.cluster(vafile.whole_vectors(many), k=6)
    assert clusters.fetched[0] == 400 and max(clusters.fetched[1:]) < 200
