"""Perplexity under an interpolated modified Kneser-Ney trigram model of trusted text, as a quality classifier.

Tokens are the words between ASCII white space, then one end mark; two start marks come first. A model is trained on
all trusted rows (good, not toxic) of one half of the labelled ones. Their trigrams are shuffled once, to shards by their
middle word: a shard then has all counts, continuation counts and contexts of its trigrams and bigrams, and is written
as sorted keys. Probabilities are worked out from the counts when they are looked up. Documents are not shuffled: a task
looks their n-grams up in the shards one after the other; local files are mapped, so no worker holds the model.

Thresholds come from the perplexity of trusted rows *outside* the training half, all of them, per language: their
quantile, or where there are fewer than ``LEAST``, ``MARGIN`` times their maximum. No language is judged by others: the
model knows less of a rare one, so its clean texts are improbable too. Rows without a language count as one more
language. A document is rejected above its threshold, or if it has no words. Where its language has no trusted rows
outside the training half, nothing with words is rejected. An id that is labelled more than once is trusted only if all
its labels are.

Two different n-grams of a shard share a 64-bit key with a chance of about n^2 / 2^65: one in thirty million for a
million of them.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F, types as T

from siftwatch.llm import files
from siftwatch.llm.texts import by_bytes, fresh, one_per_worker, release_worker, utf8
from siftwatch.operators.skew import lookup_join
from siftwatch.staging import stage, stage_path

QUANTILE = 0.995
LEAST = 100
#: Times the largest perplexity of a language's few trusted rows.
MARGIN = 2.0
#: Shards at least, and bytes of training text for each more; trusted ids that are copied to every executor.
SHARDS = 8
SHARD_BYTES = 8 << 20
LOOKUP_IDS = 2_000_000
#: Different words a task keeps, and n-grams it counts before it hands them on.
MEMO_WORDS = 250_000
HELD_GRAMS = 500_000

BEGIN, END = np.array([xxhash.xxh64_intdigest(x) for x in (b"\nbegin", b"\nend")], np.uint64)
ODD, ROTATE = np.uint64(0x9E3779B97F4A7C15), np.uint64(29)


def joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Keys of n-grams from those of their first words and of their last word."""
    x = (left * ODD) ^ (right + ODD)
    x ^= x >> ROTATE
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def sequence(rows: list[np.ndarray]) -> np.ndarray:
    """Word keys of several texts in a row, each with its marks."""
    return np.concatenate([x for r in rows for x in (np.array([BEGIN, BEGIN]), r, np.array([END]))])


def scored_places(rows: list[np.ndarray]) -> np.ndarray:
    """Where in such a sequence the tokens are: all but the start marks."""
    lengths = np.array([len(r) + 3 for r in rows])
    starts = np.cumsum(lengths) - lengths
    inside = np.ones(lengths.sum(), bool)
    inside[starts] = inside[starts + 1] = False
    return np.flatnonzero(inside)


def runs(*columns: np.ndarray) -> np.ndarray:
    """Where the runs of equal rows of sorted columns begin."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return np.flatnonzero(new)


def summed(n: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(n, starts) if len(starts) else np.zeros(0, np.int64)


#: Trigrams of a shard in a row, sorted: the middle words ``b``, of each how many first words follow in ``a``, of each of
#: these how many last words follow in ``c``, and the trigrams' counts ``n``. A word is written once for all it stands in.
PACKED = "shard int, b array<long>, firsts array<int>, a array<long>, lasts array<int>, c array<long>, n array<int>"
PACKED_NAMES = ["shard", "b", "firsts", "a", "lasts", "c", "n"]


def packed(a: np.ndarray, b: np.ndarray, c: np.ndarray, n: np.ndarray, shards: int) -> pa.RecordBatch:
    """A row per shard of different trigrams, sorted by (shard, b, a, c)."""
    shard = (b >> np.uint64(32)) % np.uint64(shards)
    pairs = runs(a, b)
    words = pairs[runs(b[pairs])]
    numbers = shard[runs(shard)]
    firsts = np.diff(np.r_[np.searchsorted(pairs, words), len(pairs)])
    lasts = np.diff(np.r_[pairs, len(a)])
    every = np.arange(len(a))
    lists = []
    for values, places in ((b[words], words), (firsts, words), (a[pairs], pairs), (lasts, pairs), (c, every), (n, every)):
        of = shard[places]
        offsets = np.r_[np.searchsorted(of, numbers), len(of)].astype(np.int32)
        values = values.view(np.int64) if values.dtype == np.uint64 else values.astype(np.int32)
        lists.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)))
    return pa.RecordBatch.from_arrays([pa.array(numbers.astype(np.int32)), *lists], names=PACKED_NAMES)


def unpacked(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The trigrams (a, b, c) and counts of ``packed`` rows."""
    b, firsts, a, lasts, c, n = (table.column(x).combine_chunks().flatten().to_numpy(zero_copy_only=False) for x in PACKED_NAMES[1:])
    a, b = np.repeat(a, lasts), np.repeat(np.repeat(b, firsts), lasts)
    return a.view(np.uint64), b.view(np.uint64), c.view(np.uint64), n.astype(np.int64)


def counted(texts: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Trigrams of all texts (column 0) as word keys, and their counts, ``packed`` by shard; summed within tasks."""

    def flush(held):
        a, b, c = np.concatenate(held).T
        order = np.lexsort((c, a, b, (b >> np.uint64(32)) % np.uint64(shards)))
        a, b, c = a[order], b[order], c[order]
        at = runs(a, b, c)
        return packed(a[at], b[at], c[at], np.diff(np.r_[at, len(a)]), shards)

    def run(batches):
        release_worker()
        held, size = [], 0
        for batch in batches:
            for part in by_bytes(batch, 0):
                rows = [np.array([xxhash.xxh64_intdigest(w) for w in t.split()], np.uint64) for t in utf8(part.column(0))]
                keys, at = sequence(rows), scored_places(rows)
                held.append(np.stack([keys[at - 2], keys[at - 1], keys[at]], axis=1))
                size += len(at)
                if size > HELD_GRAMS:
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)

    return texts.mapInArrow(run, PACKED)


def train(texts: DataFrame) -> DataFrame:
    """What a model is written from."""
    return texts.select("text")


def discounts(counts: dict[int, int]) -> list[float]:
    """Modified Kneser-Ney discounts for counts of one, two, and three or more, from how many n-grams have each."""
    n1, n2, n3, n4 = (counts.get(k, 0) for k in range(1, 5))
    if not n1 or not n2:
        return [0.5, 0.5, 0.5]
    y = n1 / (n1 + 2 * n2)
    raw = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return [min(max(d, 0.05), k) for k, d in enumerate(raw, 1)]


#: A shard's files. N-grams (``tri``, ``bi``) have a count, contexts (``pair``, ``word``) the sum of the counts that
#: follow and how many of these are one, two, and more. A 1 marks the keys alone of those where all that is one.
GRAM = np.dtype([("key", "<u8"), ("n", "<u4")])
CONTEXT = np.dtype([("key", "<u8"), ("all", "<u4"), ("one", "<u4"), ("two", "<u4"), ("more", "<u4")])
WORD = np.dtype([("key", "<u8"), ("p", "<f8")])
KEY = np.dtype([("key", "<u8")])
KINDS = {"tri": GRAM, "bi": GRAM, "pair": CONTEXT, "word": CONTEXT, "uni": WORD}


def _write(name: str, rows: np.ndarray) -> None:
    """Column by column, so that keys are searched where they are mapped."""
    with files.writing(name) as out:
        for c in rows.dtype.names:
            out.write(rows[c].tobytes())


def _write_kind(name: str, kind: str, key: np.ndarray, *figures: np.ndarray) -> None:
    dtype = KINDS[kind]
    rows = np.empty(len(key), dtype)
    for c, x in zip(dtype.names, (key, *figures)):
        rows[c] = x
    rows.sort(order="key")
    one = rows[dtype.names[1]] == 1
    _write(f"{name}.{kind}1", rows[["key"]][one].astype(KEY))
    _write(f"{name}.{kind}", rows[~one])


def _context(n: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    return [summed(x, starts) for x in (n, *((n == k).astype(np.int64) for k in (1, 2)), (n > 2).astype(np.int64))]


def write_shards(texts: DataFrame, folder: str, shards: int = SHARDS) -> None:
    """The model of all ``texts``: their trigrams in sorted shards by middle word, then words, and the discounts."""

    def write(key, table):
        release_worker()
        name = f"{folder}/{key[0].as_py():04d}"
        a, b, c, n = unpacked(table)
        order = np.lexsort((c, a, b))
        a, b, c, n = a[order], b[order], c[order], n[order]
        at = runs(a, b, c)
        a, b, c, n = a[at], b[at], c[at], summed(n, at)
        _write_kind(name, "tri", joined(joined(a, b), c), n)
        at = runs(a, b)
        _write_kind(name, "pair", joined(a[at], b[at]), *_context(n, at))
        order = np.lexsort((c, b))
        b, c = b[order], c[order]
        at = runs(b, c)
        before = np.diff(np.r_[at, len(b)])
        b, c = b[at], c[at]
        _write_kind(name, "bi", joined(b, c), before)
        at = runs(b)
        _write_kind(name, "word", b[at], *_context(before, at))
        # For the whole model: how many n-grams have each count, and how many words each word follows.
        words, follows = np.unique(c, return_counts=True)
        few = [(order, k, int((x == k).sum())) for order, x in ((3, n), (2, before)) for k in range(1, 5)]
        kinds, values, counts = (np.array(x, np.int64) for x in zip(*few))
        return pa.table({"kind": np.r_[kinds, np.ones(len(words), np.int64)], "key": np.r_[values, words.view(np.int64)], "n": np.r_[counts, follows]})

    def write_words(key, table):
        rows = np.empty(table.num_rows, WORD)
        rows["key"], rows["p"] = table.column("key").to_numpy().view(np.uint64), table.column("p").to_numpy()
        rows.sort(order="key")
        _write(f"{folder}/{key[0].as_py():04d}.uni", rows)
        return pa.table({"rows": pa.array([len(rows)], pa.int64())})

    def shard(of):
        return (F.shiftrightunsigned(of, 32) % shards).cast("int").alias("shard")

    dealt = counted(texts, shards).groupBy("shard").applyInArrow(write, "kind long, key long, n long")
    totals = stage(dealt.groupBy("kind", "key").agg(F.sum("n").alias("n")))
    few = {(r.kind, r.key): r.n for r in totals.where("kind > 1").collect()}
    d3, d2 = (discounts({k: few.get((order, k), 0) for k in range(1, 5)}) for order in (3, 2))
    # Words have one context; what their discounts leave goes to all known words and the unknown one alike.
    words = totals.where("kind = 1")
    d1 = discounts({r.n: r["count"] for r in words.where("n <= 4").groupBy("n").count().collect()})
    d = F.when(F.col("n") == 1, d1[0]).when(F.col("n") == 2, d1[1]).otherwise(d1[2])
    whole = words.agg(F.sum("n").alias("all"), F.sum(d).alias("off"), F.count("*").alias("types")).first()
    floor = whole.off / whole["all"] / (whole.types + 1) if whole.types else 1.0
    p = ((F.col("n") - d) / F.lit(whole["all"] or 1) + floor).alias("p")
    stage(words.select("key", p, shard("key")).groupBy("shard").applyInArrow(write_words, "rows long"))
    with files.writing(f"{folder}/model.json") as out:
        out.write(json.dumps({"d3": d3, "d2": d2, "floor": floor}).encode())


def _mapped(name: str, dtype: np.dtype) -> list[np.ndarray]:
    """The columns of a file; a local one is mapped, not read. A small model leaves shards without files."""
    store, place = files.opened(name)
    info = store.get_file_info(place)
    if info.type == fs.FileType.NotFound or not info.size:
        return [np.empty(0, dtype[c]) for c in dtype.names]
    if isinstance(store, fs.LocalFileSystem):
        data = np.memmap(place, np.uint8, "r")
    else:
        with files.reading(name) as file:
            data = np.frombuffer(file.read(), np.uint8)
    n = info.size // dtype.itemsize
    ends = np.cumsum([dtype[c].itemsize * n for c in dtype.names]).tolist()
    return [data[s:e].view(dtype[c]) for c, s, e in zip(dtype.names, [0, *ends], ends)]


def _found(have: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which ``keys`` (ascending) the sorted ``have`` holds, and where."""
    at = np.searchsorted(have, keys)
    hit = at < len(have)
    hit[hit] = have[at[hit]] == keys[hit]
    return hit, at[hit]


class Model:
    def __init__(self, folder: str, shards: int = SHARDS):
        with files.reading(f"{folder}/model.json") as file:
            own = json.loads(file.read())
        self.d3, self.d2 = (np.array([0.0, *own[c]]) for c in ("d3", "d2"))
        self.unknown, self.folder, self.shards = own["floor"], folder, shards
        self.files: dict[tuple[int, str], list[np.ndarray]] = {}
        self.place: dict[bytes, int] = {}
        # Of a word: its probability (NaN of an unknown one), and as a context the sum of counts and the weight below.
        self.words = np.zeros(MEMO_WORDS, [("key", "<u8"), ("p", "<f8"), ("all", "<f8"), ("rest", "<f8")])

    def file(self, shard: int, kind: str, dtype: np.dtype) -> list[np.ndarray]:
        if (shard, kind) not in self.files:
            self.files[shard, kind] = _mapped(f"{self.folder}/{shard:04d}.{kind}", dtype)
        return self.files[shard, kind]

    def look_up(self, kind: str, by: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Figures of n-grams or contexts ``keys`` in the shards of the words ``by``, all zero where there are none."""
        dtype = KINDS[kind]
        out = np.zeros((len(dtype.names) - 1, len(keys)))
        shard = (by >> np.uint64(32)) % np.uint64(self.shards)
        order = np.lexsort((keys, shard))  # sorted probes walk a shard once
        bounds = np.searchsorted(shard[order], np.arange(self.shards + 1, dtype=np.uint64))
        for k in np.flatnonzero(np.diff(bounds)).tolist():
            own = order[bounds[k] : bounds[k + 1]]
            if kind != "uni":
                hit, _ = _found(self.file(k, f"{kind}1", KEY)[0], keys[own])
                out[:2, own[hit]] = 1.0  # one count of one: the sum, and how many are one
            have, *figures = self.file(k, kind, dtype)
            hit, at = _found(have, keys[own])
            for x, figure in zip(out, figures):
                x[own[hit]] = figure[at]
        return out

    def contexts(self, kind: str, by: np.ndarray, keys: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sum of counts (0 where no such context), and the weight of the lower order (then 1)."""
        total, one, two, more = self.look_up(kind, by, keys)
        off = one * d[1] + two * d[2] + more * d[3]
        return total, np.where(total > 0, off / np.maximum(total, 1), 1.0)

    def shares(self, kind: str, by: np.ndarray, keys: np.ndarray, total: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What an n-gram's count leaves after the discount, as a share of its context's, and whether there is such."""
        n = self.look_up(kind, by, keys)[0]
        share = np.where(n > 0, (n - d[np.minimum(n, 3).astype(np.int64)]) / np.maximum(total, 1), 0.0)
        return share, n > 0

    def known_words(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), self.words.dtype)
        out["key"], p = keys, self.look_up("uni", keys, keys)[0]
        out["p"] = np.where(p > 0, p, np.nan)
        out["all"], out["rest"] = self.contexts("word", keys, keys, self.d2)
        return out

    def places(self, rows: list[list[bytes]]) -> list[np.ndarray]:
        new = list(set().union(*rows) - self.place.keys())
        if len(new) + len(self.place) > len(self.words):
            self.place.clear()
            new = list(set().union(*rows))
            if len(new) > len(self.words):
                self.words = np.zeros(len(new), self.words.dtype)
        if new:
            at = slice(len(self.place), len(self.place) + len(new))
            keys = np.array([xxhash.xxh64_intdigest(w) for w in new], np.uint64)
            self.words[at] = self.known_words(keys)
            self.place.update(zip(new, range(at.start, at.stop)))
        get = self.place.__getitem__
        return [np.fromiter(map(get, r), np.int64, len(r)) for r in rows]

    def texts(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of each text, its end counted, and the log10 probability of each text."""
        rows = [self.words[p] for p in self.places([t.split() for t in texts])]
        marks = self.known_words(np.array([BEGIN, END]))
        begin, end = marks[:1], marks[1:]
        tokens = np.concatenate([x for r in rows for x in (begin, begin, r, end)])
        lengths = np.array([len(r) + 1 for r in rows])
        at = scored_places(rows)
        a, b, c = tokens["key"][at - 2], tokens["key"][at - 1], tokens["key"][at]
        one = np.where(np.isnan(tokens["p"][at]), self.unknown, tokens["p"][at])
        # Bigrams are looked for after a word that is a context, trigrams where both pairs of words are known.
        follows = tokens["all"][at - 1] > 0
        maybe = np.flatnonzero(follows & ~np.isnan(tokens["p"][at]))
        two = tokens["rest"][at - 1] * one
        share, there = self.shares("bi", b[maybe], joined(b[maybe], c[maybe]), tokens["all"][at - 1][maybe], self.d2)
        two[maybe] += share
        maybe, after = maybe[there], np.flatnonzero(follows)
        total, rest = np.zeros(len(at)), np.ones(len(at))
        pairs = joined(a, b)
        total[after], rest[after] = self.contexts("pair", b[after], pairs[after], self.d3)
        three = rest * two
        maybe = maybe[total[maybe] > 0]
        three[maybe] += self.shares("tri", b[maybe], joined(pairs[maybe], c[maybe]), total[maybe], self.d3)[0]
        return lengths, np.add.reduceat(np.log10(three), np.cumsum(lengths) - lengths) if len(lengths) else np.zeros(0)


def model(folder: str, shards: int) -> Model:
    return one_per_worker(("kneser ney", folder), lambda: Model(folder, shards))


def perplexities(docs: DataFrame, folder: str, shards: int = SHARDS, text_col: str = "text", keep: tuple[str, ...] = ("doc_id", "lang")) -> DataFrame:
    """The ``keep`` columns, ``n_tokens`` (the end counted) and ``perplexity`` of every text."""
    slim = docs.select(F.col(text_col).alias("_text"), *(F.col(c).alias(f"_{i}") for i, c in enumerate(keep)))
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("n_tokens", T.LongType()), T.StructField("perplexity", T.DoubleType())])

    def run(batches):
        own = model(folder, shards)
        for batch in batches:
            for b in by_bytes(batch, 0):
                n, logs = own.texts(utf8(b.column(0)))
                yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(n, pa.int64()), pa.array(10 ** (-logs / np.maximum(n, 1)))], names=schema.names)

    return slim.mapInArrow(run, schema)


class Fitted:
    """A written model, and the threshold (``_limit``) of each language (``_of``) that has one."""

    def __init__(self, folder: str, shards: int, limits: DataFrame):
        self.folder, self.shards, self.limits = folder, shards, limits

    def with_limits(self, docs: DataFrame, lang_col: str = "lang", name: str = "_limit") -> DataFrame:
        """``docs`` with the column ``name``: the threshold, infinite for languages without one. The table of limits
        is joined under names that ``docs`` hasn't got."""
        of, limit = fresh(docs.columns, "_of"), fresh(docs.columns, "_limit")
        limits = self.limits.select(F.col("_of").alias(of), F.col("_limit").alias(limit))
        both = docs.join(limits, docs[lang_col].eqNullSafe(limits[of]), "left")
        return both.select(*[docs[c] for c in docs.columns], F.coalesce(limits[limit], F.lit(float("inf"))).alias(name))


def fit(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, least: int = LEAST, lang_col: str = "lang") -> tuple[Fitted, DataFrame]:
    """The model and thresholds, and the written perplexities of all documents that these come from."""
    folder = stage_path(docs.sparkSession)
    trusted = labels.groupBy("doc_id").agg(F.min("quality").alias("good"), F.max("toxic").alias("toxic")).where("good = 1 AND coalesce(toxic, 0) = 0 AND doc_id IS NOT NULL")
    half = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    # Up to LOOKUP_IDS ids are broadcast, so that texts stay where they are.
    texts = lookup_join(docs.where("text IS NOT NULL"), stage(trusted.where(half).select("doc_id")), "doc_id", "left_semi", LOOKUP_IDS).select("text")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(SHARDS, 1 + size // SHARD_BYTES)
    write_shards(train(texts), folder, shards)
    scored = stage(perplexities(docs, folder, shards, keep=("doc_id", lang_col)))
    held_out = scored.where("n_tokens > 1").join(trusted.where(~half).select("doc_id"), "doc_id")
    bound = F.when(F.count("*") >= least, F.percentile_approx("perplexity", quantile, 10_000)).otherwise(MARGIN * F.max("perplexity"))
    # A row per language, joined as a table: the column may be dirty.
    limits = stage(held_out.groupBy(F.col(lang_col).alias("_of")).agg(bound.alias("_limit")))
    return Fitted(folder, shards, limits), scored


def judged(docs: DataFrame, labels: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, lang, n_tokens, perplexity, threshold and kept of every document."""
    fitted, scored = fit(docs, labels, least=least)
    kept = (F.col("n_tokens") > 1) & (F.col("perplexity") <= F.col("_limit"))
    return fitted.with_limits(scored).select("doc_id", "lang", "n_tokens", "perplexity", F.col("_limit").alias("threshold"), kept.alias("kept"))


def accepted(docs: DataFrame, labels: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` without the rows above their threshold or without words. Each row is judged by its own text, in place:
    scoring twice costs less than a shuffle of all texts to bring verdicts to them."""
    fitted, _ = fit(docs, labels, lang_col=lang_col)
    at, schema, folder, shards = docs.columns.index(text_col), docs.schema, fitted.folder, fitted.shards

    def run(batches):
        own = model(folder, shards)
        for batch in batches:
            for b in by_bytes(batch, at):
                n, logs = own.texts(utf8(b.column(at)))
                kept = (n > 1) & (10 ** (-logs / np.maximum(n, 1)) <= b.column(b.num_columns - 1).to_numpy())
                yield pa.RecordBatch.from_arrays(b.columns[:-1], names=schema.names).filter(pa.array(kept))

    return fitted.with_limits(docs, lang_col, fresh(docs.columns, "_limit")).mapInArrow(run, schema)
