"""Language identification by unigram pieces with the segmentation summed out.

The pieces are those of a fixed public vocabulary. Per language, every piece has a probability; a word's probability is
the sum over all its segmentations into pieces, by a forward pass. Probabilities are learned by expectation
maximisation from word counts of all labelled rows: forward and backward passes give each piece's expected count. A
text goes to the language under which its words are likeliest; the score is that language's posterior under equal
priors.

Words are runs of letters in lower case, cut after 30 letters. Texts that are null or have no letter are ``und`` with
score 0; so are all texts when nothing is labelled. Rows without a language or id teach nothing. Ties go to the first
language by name. Languages times pieces bound what is broadcast; the number of languages is checked.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import cache

import numpy as np
import regex
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from siftwatch.llm.texts import one_per_worker
from siftwatch.staging import stage

ROUNDS = 3
MAX_LANGUAGES = 256
LONGEST = 30
#: Probability of a letter that is no piece, and what is added to every expected count.
UNKNOWN = 1e-7
SMOOTHING = 0.01
#: Different words whose log-probabilities a task keeps.
MEMO_WORDS = 500_000
#: Different words a task counts before it hands their counts on.
HELD_WORDS = 200_000

#: A word starts with a letter (Unicode category L) and runs on over letters and combining marks; number signs such as
#: "½" or "²" are no letters.
LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
START = "▁"


def words_of(text: str | None) -> list[str]:
    words = LETTERS.findall(text.lower()) if text else []
    if words and max(map(len, words)) > LONGEST:
        return [w[i : i + LONGEST] for w in words for i in range(0, len(w), LONGEST)]
    return words


@cache
def pieces(path: str):
    """Number of each ordinary piece, the longest piece's length, and a matcher of pieces."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    plain = [model.id_to_piece(i) for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    number = {p: i for i, p in enumerate(plain)}
    return number, max(map(len, plain)), matcher(number)


def matcher(number: dict[str, int]):
    """An automaton that finds pieces; a match is its piece's number and length in one integer."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for piece, i in number.items():
        found.add_word(piece, i << 8 | len(piece))
    found.make_automaton()
    return found


class Lattices:
    """Words of equal length with the pieces between all their places: row len(pieces) is an unknown letter, the row
    after it no piece at all."""

    def __init__(self, words: list[str], number: dict[str, int], most: int, automaton):
        marked = [START + w for w in words]
        self.n = len(marked[0])
        self.edges = [(s, e) for e in range(1, self.n + 1) for s in range(max(0, e - most), e)]
        place = np.zeros((self.n + 1, self.n + 1), np.int64)
        for k, (s, e) in enumerate(self.edges):
            place[s, e] = k
        default = [len(number) if e - s == 1 else len(number) + 1 for s, e in self.edges]
        self.piece = np.repeat(np.array(default, np.int32)[:, None], len(words), axis=1)
        # All pieces in all words, by one pass over the words in a row; no piece holds the line break between them.
        found = np.fromiter((x for match in automaton.iter("\n".join(marked)) for x in match), np.int64).reshape(-1, 2)
        last, piece, size = found[:, 0], found[:, 1] >> 8, found[:, 1] & 255
        word, end = last // (self.n + 1), last % (self.n + 1) + 1
        self.piece[place[end - size, end], word] = piece

    def forward(self, weights) -> np.ndarray:
        """Sums over the segmentations up to each place; ``weights(row of pieces)`` gives probabilities."""
        p = [weights(x) for x in self.piece]
        sums = np.zeros((self.n + 1, *p[0].shape))
        sums[0] = 1
        for (s, e), x in zip(self.edges, p):
            sums[e] += sums[s] * x
        return sums

    def expected(self, table: np.ndarray, language: np.ndarray, count: np.ndarray, total: np.ndarray) -> None:
        """Add each piece's expected count in its word's language to ``total``."""
        p = [table[x, language] for x in self.piece]
        ahead, behind = (np.zeros((self.n + 1, len(count))) for _ in range(2))
        ahead[0] = behind[self.n] = 1
        for (s, e), x in zip(self.edges, p):
            ahead[e] += ahead[s] * x
        for (s, e), x in zip(reversed(self.edges), reversed(p)):
            behind[s] += behind[e] * x
        share = count / ahead[self.n]
        for (s, e), x, ids in zip(self.edges, p, self.piece):
            np.add.at(total, (ids, language), ahead[s] * x * behind[e] * share)


def by_length(words: list[str]):
    groups: dict[int, list[int]] = {}
    for k, w in enumerate(words):
        groups.setdefault(len(w), []).append(k)
    return groups.values()


def counted(labelled: DataFrame, languages: list[str]) -> DataFrame:
    """(word, number of the language, count) over all labelled texts, summed within tasks before the shuffle."""
    number = {name: i for i, name in enumerate(languages)}

    def run(batches):
        held: Counter = Counter()

        def rows():
            words, langs = zip(*held) if held else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(langs, pa.int32()), pa.array(held.values(), pa.int64())], names=["word", "language", "n"])

        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                b = batch.slice(i, 256)
                each: dict[int, Counter] = {}
                for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    each.setdefault(number[lang], Counter()).update(words_of(text))
                for lang, words in each.items():
                    for w, n in words.items():
                        held[w, lang] += n
                if len(held) > HELD_WORDS:
                    yield rows()
                    held.clear()
        yield rows()

    return labelled.mapInArrow(run, "word string, language int, n long").groupBy("word", "language").agg(F.sum("n").alias("n"))


def learn(labelled: DataFrame, path: str, rounds: int = ROUNDS, lang_col: str = "lang", text_col: str = "text") -> tuple[list[str], np.ndarray]:
    """The languages of ``labelled`` by name, and the table of probabilities (pieces + 2, languages)."""
    known = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col).alias("t"), F.col(lang_col).alias("l"))
    languages = sorted(r.l for r in known.select("l").distinct().limit(MAX_LANGUAGES + 1).collect())
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    number, _, _ = pieces(path)
    table = np.full((len(number) + 2, len(languages)), 1 / len(number))
    table[-2:] = [[UNKNOWN], [0]]
    if not languages:
        return languages, table
    counts, spark = stage(counted(known, languages)), labelled.sparkSession
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(table)

        def run(batches):
            number, most, automaton = pieces(path)
            total = np.zeros(sent.value.shape)
            for b in batches:
                words, lang, n = b.column(0).to_pylist(), b.column(1).to_numpy(), b.column(2).to_numpy()
                for rows in by_length(words):
                    Lattices([words[k] for k in rows], number, most, automaton).expected(sent.value, lang[rows], n[rows], total)
            piece, lang = np.nonzero(total[: len(number)])
            yield pa.RecordBatch.from_arrays([pa.array(piece, pa.int32()), pa.array(lang, pa.int32()), pa.array(total[piece, lang])], names=["piece", "language", "n"])

        # At most pieces x languages rows, whatever the corpus.
        sums = counts.mapInArrow(run, "piece int, language int, n double").groupBy("piece", "language").agg(F.sum("n").alias("n")).toPandas()
        expected = np.full((len(number), len(languages)), SMOOTHING)
        expected[sums["piece"], sums["language"]] += sums["n"]
        table[: len(number)] = expected / expected.sum(axis=0)
    return languages, table


class Scorer:
    """Log-probabilities of words under every language, kept for words seen before."""

    def __init__(self, path: str, table: np.ndarray):
        self.vocabulary = pieces(path)
        self.table, self.place, self.logs = table, {}, np.zeros((MEMO_WORDS, table.shape[1]))

    def words(self, words: list[str]) -> np.ndarray:
        out = np.empty((len(words), self.table.shape[1]))
        for rows in by_length(words):
            out[rows] = np.log(Lattices([words[k] for k in rows], *self.vocabulary).forward(self.table.__getitem__)[-1])
        return out

    def texts(self, texts: list[str | None]) -> list[np.ndarray | None]:
        rows = [words_of(t) for t in texts]
        new = list(set().union(*rows) - self.place.keys())
        if len(new) + len(self.place) > len(self.logs):
            self.place.clear()
            new = list(set().union(*rows))
            if len(new) > len(self.logs):
                self.logs = np.zeros((len(new), self.table.shape[1]))
        if new:
            at = len(self.place)
            self.logs[at : at + len(new)] = self.words(new)
            self.place.update(zip(new, range(at, at + len(new))))
        get = self.place.__getitem__
        return [self.logs[np.fromiter(map(get, r), np.int64, len(r))].sum(axis=0) if r else None for r in rows]


def scorer(path: str, sent) -> Scorer:
    return one_per_worker(("language", path, sent._path), lambda: Scorer(path, sent.value))


def predict(docs: DataFrame, path: str, languages: list[str], table: np.ndarray, carry: list[Column] = (), text_col: str = "text") -> DataFrame:
    """The ``carry`` columns with ``lang_pred`` and ``score``; the text is all that a prediction reads."""
    slim = docs.select(F.col(text_col).alias("_text"), *carry)
    schema = T.StructType([*slim.schema[1:], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    sent = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        own = scorer(path, sent)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                b = batch.slice(i, 256)
                names, scores = [], []
                for logs in own.texts(b.column(0).to_pylist()):
                    best = int(np.argmax(logs)) if logs is not None and languages else None
                    names.append("und" if best is None else languages[best])
                    scores.append(0.0 if best is None else float(1 / np.exp(logs - logs[best]).sum()))
                yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=schema.names)

    return slim.mapInArrow(run, schema)


def held_out_predictions(docs: DataFrame, path: str) -> DataFrame:
    """Learn from the documents whose id's checksum leaves another remainder than 2 by 4, and predict all."""
    rest = F.crc32(F.col("doc_id").cast("string")) % 4
    languages, table = learn(docs.where(rest != 2).select("text", "lang"), path)
    return predict(docs, path, languages, table, [F.col("doc_id"), F.coalesce(rest == 2, F.lit(False)).alias("held_out")])
