"""Benchmark decontamination with a generalised suffix automaton over words.

Items and documents are lower-cased (A-Z) and cut into words of digits, letters and non-ASCII characters. The automaton
of all items is a compact index of every run of words in them; streaming a document through it gives, at each word, the
longest run ending there that some item holds. A *window* is ten consecutive item words, or a whole shorter item; a
document word inside an occurrence of a window is hit. No shuffle: documents stay where they are, and the items come to
them in blocks of a bounded number of words, one after the other.

Null texts have no words; items without words or id are left out; rows that repeat an id or text are kept apart.
"""

from __future__ import annotations

import re
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from siftwatch.llm.texts import release_worker, utf8

WINDOW = 10
#: Item words in one block; its items are the only data broadcast, and the driver holds one block at a time.
BLOCK_WORDS = 200_000

SEPARATORS = bytes(b for b in range(128) if not chr(b).isalnum())
TO_WORDS = bytes.maketrans(SEPARATORS + bytes(range(65, 91)), b" " * len(SEPARATORS) + bytes(range(97, 123)))
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words_of(text: bytes) -> list[bytes]:
    return text.translate(TO_WORDS).split()


class SuffixAutomaton:
    """States are lists: ``longest`` run, ``link`` to the state of the longest shorter suffix, ``to`` by word."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.longest, self.link, self.to = [0], [-1], [{}]
        for _, words in items:
            last = 0
            for w in words:
                last = self._extend(last, w)
        self.windows: list[dict[int, set[str]]] = [{} for _ in self.longest]
        for item, words in items:
            self._mark(item, words)
        # The shortest window that is a suffix of a state's runs; at that length a match ends in a window.
        self.least = [0] * len(self.longest)
        for v in sorted(range(len(self.longest)), key=self.longest.__getitem__):
            above = self.least[self.link[v]] if v else 1 << 30
            self.least[v] = min([above, *self.windows[v]])

    def _new(self, longest: int, link: int, to: dict) -> int:
        self.longest.append(longest)
        self.link.append(link)
        self.to.append(to)
        return len(self.longest) - 1

    def _extend(self, last: int, w: bytes) -> int:
        """The state of the run that ends with ``w``; new, or one that an earlier item made."""
        known = self.to[last].get(w)
        if known is not None:
            return known if self.longest[known] == self.longest[last] + 1 else self._split(last, w, known)
        state = self._new(self.longest[last] + 1, 0, {})
        p = last
        while p >= 0 and w not in self.to[p]:
            self.to[p][w] = state
            p = self.link[p]
        if p >= 0:
            q = self.to[p][w]
            self.link[state] = q if self.longest[q] == self.longest[p] + 1 else self._split(p, w, q)
        return state

    def _split(self, p: int, w: bytes, q: int) -> int:
        """Runs of ``q`` up to one word longer than those of ``p`` get a state of their own."""
        copy = self._new(self.longest[p] + 1, self.link[q], dict(self.to[q]))
        self.link[q] = copy
        while p >= 0 and self.to[p].get(w) == q:
            self.to[p][w] = copy
            p = self.link[p]
        return copy

    def _mark(self, item: str, words: list[bytes]) -> None:
        state, size = 0, min(self.window, len(words))
        for i, w in enumerate(words):
            state = self.to[state][w]
            while self.longest[self.link[state]] >= size:
                state = self.link[state]
            if i + 1 >= size:
                self.windows[state].setdefault(size, set()).add(item)

    def hits(self, words: list[bytes]) -> tuple[bytearray | None, set[str]]:
        """A mask of the hit words (None if there are none) and the items whose windows occur."""
        to, link, longest, least = self.to, self.link, self.longest, self.least
        state, length, mask, found, seen = 0, 0, None, set(), set()
        for i, w in enumerate(words):
            following = to[state].get(w)
            while following is None and state:
                state = link[state]
                length = longest[state]
                following = to[state].get(w)
            if following is None:
                continue
            state = following
            length += 1
            if length >= least[state]:
                mask = bytearray(len(words)) if mask is None else mask
                v, most = state, 0
                while v > 0:
                    for size, items in self.windows[v].items():
                        if size <= length:
                            most = max(most, size)
                            if (v, size) not in seen:
                                seen.add((v, size))
                                found |= items
                    v = link[v]
                mask[i + 1 - most : i + 1] = b"\1" * most
        return mask, found


class Block:
    """Some items, sent to the workers as words; each worker builds the automaton once."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.items, self.window = items, window

    @cached_property
    def automaton(self) -> SuffixAutomaton:
        return SuffixAutomaton(self.items, self.window)

    def __getstate__(self):
        return {"items": self.items, "window": self.window}


def blocks(benchmark: DataFrame, window: int = WINDOW, most: int = BLOCK_WORDS, id_col: str = "item_id", text_col: str = "text"):
    """The items in blocks of about ``most`` words, as broadcasts; the driver reads one partition at a time."""
    rows = benchmark.select(F.col(id_col).cast("string"), text_col).dropna().toLocalIterator()
    send = benchmark.sparkSession.sparkContext.broadcast
    out, block, held = [], [], 0
    for item, text in rows:
        if words := words_of(text.encode()):
            block.append((item, words))
            held += len(words)
        if held >= most:
            out.append(send(Block(block, window)))
            block, held = [], 0
    return [*out, send(Block(block, window))] if block or not out else out


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", block_words: int = BLOCK_WORDS, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per document: id, ``keep`` columns, n_words, ``spans`` (start and end word of every run of hit words) and
    ``items`` (ids of the items with occurring windows, as strings)."""
    own = [docs.schema[id_col], *(docs.schema[c] for c in keep)]
    span = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    schema = T.StructType([*own, T.StructField("n_words", T.LongType()), T.StructField("spans", span), T.StructField("items", T.ArrayType(T.StringType()))])
    parts = blocks(benchmark, window, block_words)
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        release_worker()
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                b = batch.slice(k, 512)
                counts, spans, items = [], [], []
                for text in utf8(b.column(0)):
                    words = words_of(text)
                    mask, found = None, set()
                    for part in parts:
                        more, ids = part.value.automaton.hits(words)
                        found |= ids
                        mask = more if mask is None else mask if more is None else bytearray(a | c for a, c in zip(mask, more))
                    counts.append(len(words))
                    spans.append([] if mask is None else [{"start": m.start(), "end": m.end()} for m in re.finditer(b"\1+", mask)])
                    items.append(sorted(found))
                yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(counts, pa.int64()), pa.array(spans, span_type), pa.array(items, pa.list_(pa.string()))], names=schema.names)

    columns = [F.col(text_col).alias("_text"), F.col(id_col).alias("_id"), *(F.col(c).alias(f"_keep{i}") for i, c in enumerate(keep))]
    return docs.select(*columns).mapInArrow(run, schema)


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    found = find(docs, benchmark, window, block_words=block_words)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def clean_text(text: bytes, parts: list[SuffixAutomaton], longest: int, coverage: float) -> bytes | None:
    """``text`` without its spans of ``longest`` or more hit words; None if more than the share ``coverage`` of its
    words is hit, or nothing is left. Cutting can bring a new window together, so it goes on until none is found."""
    first = True
    while True:
        words = words_of(text)
        masks = [m for m in (p.hits(words)[0] for p in parts) if m is not None]
        if not masks:
            return text
        mask = masks[0] if len(masks) == 1 else bytearray(map(max, zip(*masks)))
        if first and sum(mask) > coverage * len(words):
            return None
        first = False
        spans = [m.span() for m in re.finditer(b"\1+", mask) if m.end() - m.start() >= longest]
        if not spans:
            return text
        places = [m.span() for m in WORD.finditer(text)]
        kept, at = [], 0
        for start, end in spans:
            kept.append(text[at : places[start][0]])
            at = places[end - 1][1]
        text = b"".join([*kept, text[at:]])
        if not WORD.search(text):
            return None


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, longest: int = 1, coverage: float = 0.5, text_col: str = "text") -> DataFrame:
    """``docs`` with the spans of ``longest`` or more hit words cut out of their texts, and without the documents
    that are hit in more than the share ``coverage`` of their words. All other rows and columns stay as they are."""
    parts, at, schema = blocks(benchmark, window), docs.columns.index(text_col), docs.schema

    def run(batches):
        release_worker()
        automata = [p.value.automaton for p in parts]
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                b = batch.slice(k, 512)
                nulls = b.column(at).is_null().to_pylist()
                texts = [None if null else clean_text(t, automata, longest, coverage) for null, t in zip(nulls, utf8(b.column(at)))]
                column = pa.array([None if t is None else t.decode() for t in texts], pa.string())
                rows = pa.array([null or t is not None for null, t in zip(nulls, texts)])
                yield pa.RecordBatch.from_arrays([*b.columns[:at], column.cast(b.column(at).type), *b.columns[at + 1 :]], names=schema.names).filter(rows)

    return docs.mapInArrow(run, schema)
