"""Language identification by prediction with partial matching.

Each language has a tree of byte contexts of variable order, with the counts of the bytes seen
after them. A byte's code length is exact under these frozen counts: in a context of total T with
q distinct successors a byte seen c times costs -log2(c / (T + q)), any other costs the escape
-log2(q / (T + q)) and then its cost one byte shorter; below order 0 it costs 8 bits. Contexts
that a language never saw cost it nothing and pass to the next shorter one. The language whose
code of the whole text is shortest is predicted; ties go to the smaller name. The score is its
share of the probabilities 2^-length of all languages.

`fit` reads a sample of labelled rows whose size is a parameter: rows are picked by a hash of
their id at a rate per language that yields about `sample_docs` whole texts. The trees hold every context
and successor of the texts that were read, whatever the number of languages: a successor that any language saw has
one entry, found by hashing. So the model that is sent to the tasks grows with the distinct strings of four bytes
only. Prediction reads every byte of every text and nothing else; other columns are passed on or left alone, whatever their names.

A null text, or one without a letter, is `und` with score 0, as is every text when no language
could be learned. Rows with a null id are never learned from and count as held out.

Whether a text fits its predicted language at all is decided by its bits per byte. All labelled texts are
read for it, those without an id and those that are held out from `fit` too. They are dealt to two halves by a hash of the
text, and each half's texts are coded under the model of the other, so that neither a text nor its copies
tell the model that judges it what to expect. Twice the median and the spread of the labelled texts give each language a
limit, which is wider for short texts. A language of which one half has no texts has no limit.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from commentloom.llm.batches import arrow, columns, record, small
from commentloom.runtime import cut, numbered

ORDER = 3
SAMPLE_DOCS = 600
SLICE_BYTES = 1 << 18
#: Distinct strings that a counting task holds before it hands them on.
HELD_GRAMS = 1 << 19
#: Bytes times languages that are looked up at a time.
LOOKUPS = 1 << 18
UNKNOWN = "und"
#: A text is not of its language beyond so many times the median plus so many spreads; after LONG bytes the spread is no longer narrower.
TIMES = 2.0
FAR = 8.0
LONG = 400
#: Least spread of a single byte's bits.
LEAST_SPREAD = 1.0
HAS_LETTER = re.compile(r"[^\W\d_]")


def held_out(id_column: Column) -> Column:
    """Whether a row is kept from learning."""
    return F.coalesce(F.crc32(id_column.cast("string")) % 5 == 0, F.lit(True))


class Slots:
    """Place of each key, by hashing with linear probing on arrays; -1 for others."""

    FACTOR = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, (2 * len(keys)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.places = np.full(1 << self.bits, -1, np.int32)
        left, at = np.arange(len(keys)), self._first(keys)
        while len(left):
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[left[free]]
            put = self.keys[at] == keys[left]
            self.places[at[put]] = left[put]
            left, at = left[~put], at[~put] + 1 & (1 << self.bits) - 1

    def _first(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * self.FACTOR >> np.uint64(64 - self.bits)).astype(np.int64)

    def of(self, keys: np.ndarray) -> np.ndarray:
        at = self._first(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.places[at], -1)
        open_ = np.flatnonzero((found != keys) & (found >= 0))
        at = at[open_]
        while len(open_):
            at = at + 1 & (1 << self.bits) - 1
            found, asked = self.keys[at], keys[open_]
            hit = found == asked
            out[open_[hit]] = self.places[at[hit]]
            left = ~hit & (found >= 0)
            open_, at = open_[left], at[left]
        return out


@dataclass
class Model:
    """Code lengths of all languages by context node and byte.

    `symbol` numbers the bytes that were seen (0: none such); `node` gives the node of the last
    three numbers, 0 the empty context, and `parent` the node of the context one byte shorter. `slots` finds the entry of a node and a
    number, `bits` has a row of lengths, one per language, for each entry, and `escape` for each node.
    """

    languages: list[str]
    symbol: np.ndarray
    node: np.ndarray
    parent: np.ndarray
    slots: Slots
    bits: np.ndarray
    escape: np.ndarray

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """Code length in bits of each text under each language."""
        width = int(self.symbol.max()) + 1
        out = np.zeros((len(texts), len(self.languages)))
        sizes = np.array([len(t) for t in texts], np.int64)
        if not sizes.any() or not self.languages:
            return out
        codes = self.symbol[np.frombuffer(b"".join(texts), np.uint8)]
        text = np.repeat(np.arange(len(texts)), sizes)
        place = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        context = np.zeros(len(codes), np.int64)
        for back in range(ORDER, 0, -1):  # nothing stands before a text's first byte
            before = np.zeros_like(codes)
            before[back:] = codes[:-back]
            context = context * width + np.where(place < back, 0, before)
        piece = max(1, LOOKUPS // len(self.languages))
        for start in range(0, len(codes), piece):
            own = slice(start, start + piece)
            cost = self._costs(self.node[context[own]].astype(np.int64), codes[own], width)
            first, last = int(text[own][0]), int(text[own][-1]) + 1
            for j in range(len(self.languages)):
                out[first:last, j] += np.bincount(text[own] - first, cost[:, j], last - first)
        return out

    def _costs(self, node: np.ndarray, codes: np.ndarray, width: int) -> np.ndarray:
        """Bits of each byte after its context, under each language."""
        cost = np.zeros((len(codes), len(self.languages)), np.float32)
        left = np.arange(len(codes))
        while len(left):
            entry = self.slots.of(node * width + codes[left])
            hit = entry >= 0
            cost[left[hit]] += self.bits[entry[hit]]
            # No language saw this byte here: each escapes that knows the context.
            left, node = left[~hit], node[~hit]
            cost[left] += self.escape[node]
            cost[left[node == 0]] += 8.0
            left, node = left[node > 0], self.parent[node[node > 0]].astype(np.int64)
        return cost

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        known = [bool(t) and HAS_LETTER.search(t) is not None for t in texts]
        if not self.languages:
            return [(UNKNOWN, 0.0)] * len(texts)
        lengths = self.lengths([t.encode() if k else b"" for t, k in zip(texts, known)])
        best = lengths.argmin(axis=1)
        share = 1 / np.exp2(-np.minimum(lengths - lengths.min(axis=1)[:, None], 1000)).sum(axis=1)
        return [(self.languages[b], float(s)) if k else (UNKNOWN, 0.0) for b, s, k in zip(best, share, known)]

    def fits(self, texts: list[str | None]) -> list[bool]:
        """Whether each text has a letter: without limits any text fits."""
        return [bool(t) and HAS_LETTER.search(t) is not None for t in texts]


def half(text: Column) -> Column:
    """The half of the labelled texts to which a text belongs, 0 or 1."""
    return F.crc32(text) % 2


@dataclass
class Halves:
    """The models of both halves of the labelled texts, in one: its languages are named by the half's digit and their name."""

    model: Model
    #: Median of the bits per byte and spread of one byte's bits, of the languages that have a limit.
    limits: dict[str, tuple[float, float]] = field(default_factory=dict)

    def judges(self, half: int) -> list[tuple[str, int]]:
        """Languages and their places in the model, for texts of one half: those of the other half.

        A language that only the texts' own half has is there too, as there is nothing else to tell it by.
        """
        place = {name: i for i, name in enumerate(self.model.languages)}
        own, other = str(half), str(1 - half)
        return [(lang, place.get(other + lang, place.get(own + lang))) for lang in sorted({name[1:] for name in place})]

    def fits(self, texts: list[str | None]) -> list[bool]:
        """Whether each text has a letter and is coded about as well as its language's texts are."""
        known = [bool(t) and HAS_LETTER.search(t) is not None for t in texts]
        if not self.model.languages:
            return known
        data = [t.encode() if k else b"" for t, k in zip(texts, known)]
        sizes = np.array([max(1, len(t)) for t in data])
        lengths = self.model.lengths(data)
        belongs = np.array([zlib.crc32(t) % 2 for t in data])
        out = np.array(known, bool)
        for own in (0, 1):
            at = np.flatnonzero(belongs == own)
            names, places = zip(*self.judges(own))
            coded = lengths[np.ix_(at, places)]
            best = coded.argmin(axis=1)
            middle, spread = np.array([self.limits.get(name, (np.inf, 0.0)) for name in names]).T
            limit = TIMES * middle[best] + FAR * spread[best] / np.sqrt(np.minimum(sizes[at], LONG))
            out[at] &= coded.min(axis=1) / sizes[at] <= limit
        return out.tolist()


def grams(rows: DataFrame) -> DataFrame:
    """Counts of each language's byte strings of one to four bytes: lang, size, gram, n.

    Only the longest strings that end at each byte are counted; shorter ones are their sums.
    """
    out = columns("lang string, size int, gram long, n long")
    arrow_out = arrow(out)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        n = 0

        def handed_on() -> Iterator[pa.RecordBatch]:
            for lang, found in held.items():
                key, count = _merged(found)
                yield record(arrow_out, [[lang] * len(key), key >> 32, key & (1 << 32) - 1, count])

        for batch in small(batches, "t", SLICE_BYTES):
            by_language: dict[str, list[bytes]] = {}
            for lang, t in zip(batch.column("lang").to_pylist(), batch.column("t").to_pylist()):
                by_language.setdefault(lang, []).append(t.encode())
            for lang, texts in by_language.items():
                more = np.unique(_ends(texts), return_counts=True)
                held.setdefault(lang, []).append(more)
                n += len(more[0])
            if n > HELD_GRAMS:
                held = {lang: [_merged(found)] for lang, found in held.items()}
                n = sum(len(found[0][0]) for found in held.values())
                if n > HELD_GRAMS // 2:
                    yield from handed_on()
                    held, n = {}, 0
        yield from handed_on()

    return rows.mapInArrow(tally, out).groupBy("lang", "size", "gram").agg(F.sum("n").alias("n"))


def _ends(texts: list[bytes]) -> np.ndarray:
    """The string that ends at each byte of the texts, of at most ORDER + 1 bytes, below its size."""
    sizes = np.array([len(t) for t in texts], np.int64)
    codes = np.frombuffer(b"".join(texts), np.uint8).astype(np.int64)
    place = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out = codes | np.minimum(place + 1, ORDER + 1) << 32
    for back in range(1, ORDER + 1):  # nothing stands before a text's first byte
        out[back:] |= np.where(place[back:] < back, 0, codes[:-back] << 8 * back)
    return out


def _merged(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and their summed counts."""
    if len(found) == 1:
        return found[0]
    key, where = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
    return key, np.bincount(where, np.concatenate([n for _, n in found]), len(key)).astype(np.int64)


def _summed(lang: np.ndarray, gram: np.ndarray, n: np.ndarray, languages: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts by language and gram, in order of the gram."""
    key, where = np.unique(gram * languages + lang, return_inverse=True)
    return key % languages, key // languages, np.bincount(where, n, len(key)).astype(np.int64)


def build(counted: list[tuple[str, int, int, int]] | pa.Table) -> Model:
    """The model of the counts of `grams`."""
    if not isinstance(counted, pa.Table):
        counted = pa.table(dict(zip(("lang", "size", "gram", "n"), zip(*counted)))) if counted else pa.table({"lang": []})
    codes = counted.column("lang").combine_chunks().dictionary_encode()
    codes = codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes
    names = codes.dictionary.to_pylist()
    languages = sorted(names)
    if not languages:
        nothing = np.zeros(1, np.int64)
        return Model([], np.zeros(256, np.int64), nothing, nothing, Slots(nothing[:0]), np.zeros((0, 0), np.float32), np.zeros((1, 0), np.float32))
    number = {lang: i for i, lang in enumerate(languages)}
    lang = np.array([number[x] for x in names], np.int64)[codes.indices.to_numpy(zero_copy_only=False)]
    size, gram, n = (counted.column(c).to_numpy().astype(np.int64) for c in ("size", "gram", "n"))
    tables = []  # of strings of 1 to ORDER + 1 bytes, which are the last ones of the longer strings
    for k in range(1, ORDER + 2):
        longer = size >= k
        tables.append(_summed(lang[longer], gram[longer] & (1 << 8 * k) - 1, n[longer], len(languages)))
    seen = np.unique(tables[0][1])
    symbol = np.zeros(256, np.int64)
    symbol[seen] = np.arange(1, len(seen) + 1)
    width = len(seen) + 1
    contexts = [np.unique(t[1] >> 8) for t in tables]  # by length; the empty one is 0
    first = np.cumsum([0, *map(len, contexts)])
    parent, escape = np.zeros(first[-1], np.int32), np.zeros((first[-1], len(languages)), np.float32)
    keys, bits = [], []
    for k, (of, string, count) in enumerate(tables):
        node = first[k] + np.searchsorted(contexts[k], string >> 8)
        group = node * len(languages) + of
        total = np.bincount(group, count, first[-1] * len(languages)).reshape(-1, len(languages))
        kinds = np.bincount(group, minlength=first[-1] * len(languages)).reshape(-1, len(languages))
        known = kinds > 0
        escape[known] = -np.log2(kinds[known] / (total[known] + kinds[known]))
        key, entry = np.unique(node * width + symbol[string & 255], return_inverse=True)
        row = escape[key // width].astype(np.float64)
        if k:
            own = np.arange(first[k], first[k + 1])
            shorter = contexts[k] & (1 << 8 * (k - 1)) - 1
            parent[own] = first[k - 1] + np.searchsorted(contexts[k - 1], shorter)
            row += shorter_row[np.searchsorted(keys[-1], parent[key // width].astype(np.int64) * width + key % width)]
        else:
            row += 8.0
        row[entry, of] = -np.log2(count / (total[node, of] + kinds[node, of]))
        keys.append(key)
        bits.append(row.astype(np.float32))
        shorter_row = row
    nodes = np.zeros((width,) * ORDER, np.int32)
    for k in range(1, ORDER + 1):  # longer contexts come later and are more exact
        digits = tuple(symbol[contexts[k] >> 8 * (k - 1 - x) & 255] for x in range(k))
        place = np.arange(first[k], first[k + 1], dtype=np.int32)
        if k == ORDER:
            nodes[digits] = place
        else:
            nodes[(slice(None),) * (ORDER - k) + digits] = place
    return Model(languages, symbol, nodes.reshape(-1), parent, Slots(np.concatenate(keys)), np.concatenate(bits), escape)


def _sample(docs: DataFrame, sample_docs: int, id_column: str, text: str, lang: str) -> DataFrame | None:
    """(id, t, lang) of a sample of the labelled rows that are not held out; None if there are none."""
    rows = docs.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text}`").alias("t"), F.col(f"`{lang}`").alias("lang"))
    rows = rows.where(~held_out(F.col("id")) & F.col("t").isNotNull() & F.col("lang").isNotNull())
    sizes = rows.groupBy("lang").count().collect()  # one row per language
    if not sizes:
        return None
    rate = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(1.0, sample_docs / r["count"]))])
    return rows.where(F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(1 << 30)) < F.element_at(rate, F.col("lang")) * (1 << 30))


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, id_column: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """The model of a sample of the labelled rows that are not held out."""
    picked = _sample(docs, sample_docs, id_column, text, lang)
    if picked is None:
        return build([])
    return build(grams(picked.select("t", "lang")).toArrow())  # bounded by the sample


def fit_with_limits(docs: DataFrame, text: str = "text", lang: str = "lang") -> Halves:
    """The models of both halves of all labelled texts, with limits on the bits per byte.

    The texts are counted and coded in tasks; counts of distinct strings and two numbers a language come to the driver.
    """
    rows = docs.select(F.col(f"`{text}`").alias("t"), F.col(f"`{lang}`").alias("name"))
    rows = rows.where(F.col("t").isNotNull() & F.col("name").isNotNull())
    rows = rows.select("t", F.concat(half(F.col("t")).cast("string"), F.col("name")).alias("lang"))
    model = build(grams(rows).toArrow())  # bounded by the distinct strings
    rates = cut(_rates(rows, model))
    middles = _medians(rates.select("lang", F.col("rate").alias("value")))
    if not middles:
        return Halves(model)
    middle = F.element_at(F.create_map(*[F.lit(x) for pair in middles.items() for x in pair]), F.col("lang"))
    off = F.abs(F.col("rate") - middle) * F.sqrt(F.least(F.col("size"), F.lit(LONG)))
    spreads = _medians(rates.select("lang", off.alias("value")))
    return Halves(model, {name: (m, max(1.4826 * spreads[name], LEAST_SPREAD)) for name, m in middles.items()})


def _medians(rows: DataFrame) -> dict[str, float]:
    """The median of the rows (lang, value) of each language, the mean of both middle ones if their number is even.

    No language is sorted in one task.
    """
    counts = rows.groupBy("lang").count()
    middle = numbered(rows, "lang", ["value"], "place").join(F.broadcast(counts), "lang").where("2 * place BETWEEN count AND count + 2")
    return {r["lang"]: r["value"] for r in middle.groupBy("lang").agg(F.avg("value").alias("value")).collect()}


def _rates(rows: DataFrame, model: Model) -> DataFrame:
    """(lang, bits per byte, bytes) of texts (t, lang) with a letter, under their own language in the other half.

    `lang` has the half's digit in `rows`, but not here.
    """
    out = columns("lang string, rate double, size long")
    arrow_out = arrow(out)
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {name: i for i, name in enumerate(sent.value.languages)}
        other = {name: place.get(f"{1 - int(name[0])}{name[1:]}") for name in place}
        for batch in small(batches, "t", SLICE_BYTES):
            pairs = zip(batch.column("t").to_pylist(), batch.column("lang").to_pylist())
            pairs = [(name, t.encode()) for t, name in pairs if other.get(name) is not None and HAS_LETTER.search(t)]
            if pairs:
                bits = sent.value.lengths([t for _, t in pairs])[np.arange(len(pairs)), [other[name] for name, _ in pairs]]
                sizes = [len(t) for _, t in pairs]
                yield record(arrow_out, [[name[1:] for name, _ in pairs], bits / sizes, sizes])

    return rows.select("t", "lang").mapInArrow(code, out)


def identify(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The `keep` columns (all if None) with `lang_pred` and `score` of each row's text."""
    names = docs.columns if keep is None else keep
    kept = [f"k{i}" for i in range(len(names))]
    # A text that is kept is not sent twice.
    read = kept[names.index(text)] if text in names else "t"
    own = [F.col(f"`{c}`").alias(k) for c, k in zip(names, kept)]
    rows = docs.select(*own, *([F.col(f"`{text}`").alias("t")] if read == "t" else []))
    out = T.StructType([f for f in rows.schema if f.name != "t"] + list(columns("lang_pred string, score double")))
    arrow_out = arrow(out)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, read, SLICE_BYTES):
            found = sent.value.predict(batch.column(read).to_pylist())
            yield record(arrow_out, [*[batch.column(k) for k in kept], *zip(*found)])

    done = rows.mapInArrow(predict, out)
    return done.select(*[F.col(k).alias(c) for c, k in zip(names, kept)], "lang_pred", "score")


def predictions(docs: DataFrame, **fitting) -> DataFrame:
    """Fits on `docs` and predicts all of them: doc_id, held_out, lang_pred, score."""
    found = identify(docs, fit(docs, **fitting), keep=["doc_id"])
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def accepted(docs: DataFrame, model: Model | Halves, text: str = "text") -> DataFrame:
    """The rows of `docs` whose text has a letter and fits its predicted language.

    All texts with a letter stay if no language could be learned.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    rows = docs.toDF(*names)
    read = names[docs.columns.index(text)]
    arrow_out = arrow(rows.schema)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, read, SLICE_BYTES):
            kept = batch.filter(pa.array(sent.value.fits(batch.column(read).to_pylist()), pa.bool_()))
            yield record(arrow_out, [kept.column(n) for n in names])

    return rows.mapInArrow(choose, rows.schema).select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns)])
