"""Cross-tokenizer alignment: where the tokens of two tokenizers share their ends, and which of them overlap.

Tokenizer A is a byte-level BPE of the tokenizers library, given space + text; tokenizer B a sentencepiece model,
given the text (it adds the space itself). Special tokens are never made: their strings inside texts are plain text.
A token's bytes: A's vocabulary entry mapped back through the byte-level alphabet; B's piece in UTF-8 with U+2581 as a
space and ``<0xHH>`` as the byte HH. Where either side's bytes don't join to space + text (a normaliser changed the
text), or the text is null or empty, the document has no tokens and all its figures are zero.

Both sides tile the same bytes, so walking them in step visits exactly the pairs of tokens whose byte ranges overlap
(the *links*): the token that ends first moves on, both move where they end together, and such a common end is a
*cut* between groups. Where a single space stands between two words, tokens of both sides end before it, so texts are
cut there and their *parts* aligned, each once for all places where a worker meets it. The walk is done in lockstep for
all new parts of a batch: NumPy vectors hold every unfinished part's A and B positions, one step advances them all and
emits one link per part, and finished parts are compacted out of the vectors. A document's figures are its parts' sums.

Per document: n_a, n_b, n_groups, n_links and ``groups`` (``a1,a2|b1;a3|b2,b3``: decimal ids of each group, A then B,
groups in order; '' without tokens). Corpus-wide, an (A id, B id) pair's count is the number of links that hold it;
``count_sum`` sums the counts of a document's links and ``n_best`` counts its links whose count is the highest of their
B id (ties included). Pairs are pre-aggregated in each document and task before they are shuffled. Their counts are written in shards,
where tasks look up the pairs of their documents: links are not moved again.

Defined cases: a null id is a document like any other and keeps its row; rows with equal ids keep a row each; very
long texts are walked whole (the step count is the longer side's token count); other columns of the input are dropped
first; an empty table gives an empty result. Where one of the tokenizers does not always cut there, whole texts are parts.
"""

from __future__ import annotations

import hashlib
import os
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from siftwatch.functions import arrays
from siftwatch.llm.texts import one_per_worker, space_parts
from siftwatch.llm.token_records import Encoder
from siftwatch.operators.sparsetiles import part
from siftwatch.staging import stage, stage_path

#: Documents walked in lockstep at a time, and at most this many characters of text among them (a step's arrays and
#: the links of a batch grow with its tokens, so long texts go in smaller batches; one text is never cut).
BATCH = 512
BATCH_CHARS = 1 << 21
#: Parts of texts that a worker keeps; about 500 bytes each. When there are more, the half used most stays.
MEMO_PARTS = 250_000
PAIR_TYPE = "array<struct<a:int,b:int,k:long>>"
#: Bits of an id in a pair's key: vocabularies up to a million ids.
ID_BITS = 20
#: Different pairs in a shard of their counts, and links worked on at once.
SHARD_PAIRS = 1_000_000
LINKS = 1_000_000


def byte_alphabet() -> dict[str, int]:
    """The byte-level alphabet: bytes ! to ~, ¡ to ¬ and ® to ÿ stand for themselves, the others in order for the
    characters from U+0100 on."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Sides:
    """Both tokenizers and the bytes of every id, loaded once per worker."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece

        self.a = Encoder(a_path)
        alphabet = byte_alphabet()
        vocab = self.a.library.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.a_bytes[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.b_bytes = [self._piece(self.b.id_to_piece(i)) for i in range(self.b.get_piece_size())]
        if max(len(self.a_bytes), len(self.b_bytes)) > 1 << ID_BITS:
            raise ValueError("vocabularies above a million ids don't fit the pair keys")
        self.a_len = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_len = np.array([len(x) for x in self.b_bytes], np.int64)
        self.cuts = self.cut_at_spaces()
        self.parts = Parts(self)

    @staticmethod
    def _piece(piece: str) -> bytes:
        if len(piece) == 6 and piece.startswith("<0x") and piece.endswith(">"):
            return bytes([int(piece[3:5], 16)])
        return piece.replace("▁", " ").encode()

    def cut_at_spaces(self) -> bool:
        """Whether both sides always cut before a single space between two words: A's pre-tokenizer, and B as a BPE
        that leaves texts as they are and has no piece with a space after another character."""
        try:
            from sentencepiece import sentencepiece_model_pb2
        except ImportError:
            return False
        model = sentencepiece_model_pb2.ModelProto.FromString(self.b.serialized_model_proto())
        n, t = model.normalizer_spec, model.trainer_spec
        plain = n.add_dummy_prefix and n.escape_whitespaces and not n.remove_extra_whitespaces and not n.precompiled_charsmap
        pieces = [p.piece for p in model.pieces]
        own = any(p.type == p.USER_DEFINED for p in model.pieces)
        return bool(self.a.by_parts and plain and t.model_type == t.BPE and not t.treat_whitespace_as_suffix and not own and not any("▁" in p.lstrip("▁") for p in pieces))

    def tokens(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """A and B ids of all parts (each without the space before it) one after the other, and how many of each; none
        where a part is empty or either side's bytes differ."""
        spaced = [" " + t if t else "" for t in parts]
        encoded = self.a.encode_parts(spaced) if self.cuts else self.a.encode(spaced)
        b = self.b.encode(parts, num_threads=1)
        n_a = np.array([len(x) for x in encoded], np.int64) // self.a.dtype.itemsize
        n_b = np.array([len(x) for x in b], np.int64)
        a = np.frombuffer(b"".join(encoded), self.a.dtype).astype(np.int64)
        b = np.fromiter(chain.from_iterable(b), np.int64, int(n_b.sum()))
        whole = [t.encode() for t in spaced]
        want = np.array([len(t) for t in whole], np.int64)
        sound = want > 0
        joined = b"".join(whole)
        for ids, n, sizes, names in ((a, n_a, self.a_len, self.a_bytes), (b, n_b, self.b_len, self.b_bytes)):
            ends, last = np.r_[0, np.cumsum(sizes[ids])], np.cumsum(n)
            sound &= ends[last] - ends[last - n] == want
            pieces = list(map(names.__getitem__, ids.tolist()))
            if b"".join(pieces) != joined:  # some differ: each by itself
                sound &= np.array([b"".join(pieces[e - k : e]) == w for e, k, w in zip(last.tolist(), n.tolist(), whole)], bool)
        a, b = a[np.repeat(sound, n_a)], b[np.repeat(sound, n_b)]
        return a, b, np.where(sound, n_a, 0), np.where(sound, n_b, 0)


def ragged(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All places ``first`` to ``first + size`` of each row, row by row."""
    ends = np.cumsum(size)
    return np.repeat(first - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)


class Parts:
    """Aligned parts of texts, kept for those seen before: figures, the text of their groups, and their links as
    distinct (A id, B id) keys with how often they occur."""

    def __init__(self, s: Sides):
        self.s, self.place, self.texts = s, {}, []
        self.figures = {c: np.zeros(0, np.int64) for c in ("n_a", "n_b", "n_groups", "n_links", "first", "size", "uses", "cut")}
        self.pair, self.times = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def places(self, parts: list[str]) -> np.ndarray:
        new = list(set(parts) - self.place.keys())
        if self.place and len(self.place) + len(new) > MEMO_PARTS:
            self._thin()
            new = list(set(parts) - self.place.keys())
        if new:
            self._add(new)
        out = np.fromiter(map(self.place.__getitem__, parts), np.int64, len(parts))
        self.figures["uses"] += np.bincount(out, minlength=len(self.place))
        return out

    def _thin(self) -> None:
        f, keys = self.figures, list(self.place)
        keep = np.sort(np.argsort(-f["uses"], kind="stable")[: MEMO_PARTS // 2])
        self.place = {keys[k]: i for i, k in enumerate(keep.tolist())}
        self.texts = [self.texts[k] for k in keep.tolist()]
        f = self.figures = {c: x[keep] for c, x in f.items()}
        at = ragged(f["first"], f["size"])
        self.pair, self.times = self.pair[at], self.times[at]
        f["first"] = np.cumsum(f["size"]) - f["size"]
        f["uses"] //= 2

    def _add(self, new: list[str]) -> None:
        n = len(new)
        a, b, n_a, n_b = self.s.tokens(new)
        l_part, l_a, l_b, c_part, c_a, c_b = walk_flat(n_a, n_b, np.cumsum(self.s.a_len[a]), np.cumsum(self.s.b_len[b]))
        keys, times = np.unique(l_part << 2 * ID_BITS | a[l_a] << ID_BITS | b[l_b], return_counts=True)
        size = np.bincount(keys >> 2 * ID_BITS, minlength=n)
        order = np.argsort(c_a, kind="stable")
        c_part, c_a, c_b = c_part[order], c_a[order], c_b[order]
        texts = iter(groups_texts(a, b, c_a, c_b, np.append(c_part[1:] != c_part[:-1], True)[: len(c_part)]))
        self.texts += [next(texts) if k else b"" for k in n_a.tolist()]
        # Cutting a text at every space is right if no white space is beside one.
        cut = np.array([p != "" and p.strip() == p for p in new], np.int64)
        more = {"n_a": n_a, "n_b": n_b, "n_groups": np.bincount(c_part, minlength=n), "n_links": np.bincount(l_part, minlength=n), "first": len(self.pair) + np.cumsum(size) - size, "size": size, "uses": np.zeros(n, np.int64), "cut": cut}
        self.figures = {c: np.concatenate([x, more[c]]) for c, x in self.figures.items()}
        self.pair, self.times = np.concatenate([self.pair, keys & (1 << 2 * ID_BITS) - 1]), np.concatenate([self.times, times])
        self.place.update(zip(new, range(len(self.place), len(self.place) + n)))


def sides(a_path: str, b_path: str) -> Sides:
    return one_per_worker(("alignment", a_path, b_path), lambda: Sides(a_path, b_path))


def walk(a_ends: list[np.ndarray], b_ends: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The lockstep walk of a batch. Ends are each token's end offset in its document (ascending, both sides ending
    at the same offset). Gives the links as (document, A position, B position) and the cuts as (document, A position,
    B position) of the last tokens before each common end; positions count within the document."""
    n_a = np.array([len(x) for x in a_ends], np.int64)
    n_b = np.array([len(x) for x in b_ends], np.int64)
    a_first = np.r_[0, np.cumsum(n_a)[:-1]]
    b_first = np.r_[0, np.cumsum(n_b)[:-1]]
    flat_a = np.concatenate([*a_ends, np.zeros(0, np.int64)])
    flat_b = np.concatenate([*b_ends, np.zeros(0, np.int64)])
    l_doc, l_a, l_b, c_doc, c_a, c_b = walk_flat(n_a, n_b, flat_a, flat_b)
    return l_doc, l_a - a_first[l_doc], l_b - b_first[l_doc], np.stack([c_doc, c_a - a_first[c_doc], c_b - b_first[c_doc]]), n_a


def walk_flat(n_a: np.ndarray, n_b: np.ndarray, flat_a: np.ndarray, flat_b: np.ndarray) -> tuple[np.ndarray, ...]:
    """The walk over ends in a row, so many of each document: links and cuts as (document, A place, B place) each."""
    doc = np.flatnonzero(n_a > 0)
    ia, ib = (np.cumsum(n_a) - n_a)[doc], (np.cumsum(n_b) - n_b)[doc]
    stop = np.cumsum(n_a)[doc]
    none = (np.zeros(0, np.int64),) * 3
    links, cuts = [none], [none]
    while doc.size:
        ea, eb = flat_a[ia], flat_b[ib]
        links.append((doc, ia, ib))
        both = ea == eb
        if both.any():
            cuts.append((doc[both], ia[both], ib[both]))
        ia = ia + (ea <= eb)
        ib = ib + (eb <= ea)
        going = ia < stop
        if not going.all():
            doc, ia, ib, stop = doc[going], ia[going], ib[going], stop[going]
    return *(np.concatenate(x) for x in zip(*links)), *(np.concatenate(x) for x in zip(*cuts))


SEPARATORS = (",", "|", ";", "\n")


def groups_text(a: np.ndarray, b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray) -> str:
    """``a1,a2|b1;a3|b2,b3`` of one document from its ids and the positions of the last token of each group."""
    return b"".join(groups_texts(a, b, cut_a, cut_b, np.arange(1, len(cut_a) + 1) == len(cut_a))).decode()


def groups_texts(a: np.ndarray, b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray, last: np.ndarray) -> list[bytes]:
    """Such texts of several documents or parts in a row; ``last`` marks the last group of each.

    Built in one pass over the tokens: the ids of both sides in group order, each followed by its separator (``,``
    inside a side, ``|`` after a group's last A id, ``;`` after its last B id, a line's end after a text's last)."""
    group_a = np.searchsorted(cut_a, np.arange(len(a)))
    group_b = np.searchsorted(cut_b, np.arange(len(b)))
    ids = np.concatenate([a, b])
    order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
    sep = np.zeros(len(ids), np.int64)
    sep[cut_a] = 1
    sep[len(a) + cut_b] = np.where(last, 3, 2)
    joined = "".join(map(str.__add__, map(str, ids[order].tolist()), map(SEPARATORS.__getitem__, sep[order].tolist())))
    return joined.encode().split(b"\n")[:-1]


def cut(text: str) -> list[str]:
    """The parts of a text, each without the space before it (the first has the one that stands before the text)."""
    head, *rest = space_parts(text)
    return [head, *(p[1:] for p in rest)]


def align_batch(s: Sides, texts: list[str | None], keep_groups: bool = False) -> dict:
    """Figures of a batch of texts: per text n_a, n_b, n_groups, n_links, groups_sha256 (and groups), and the links
    as distinct (text, A id, B id, occurrences) rows in flat arrays."""
    n, memo = len(texts), s.parts
    some = [i for i, t in enumerate(texts) if t]
    rows = [texts[i].split(" ") if s.cuts else [texts[i]] for i in some]
    starts = np.cumsum([0, *map(len, rows)])
    places = memo.places(list(chain.from_iterable(rows)))
    if s.cuts and len(some):
        odd = np.flatnonzero(~np.logical_and.reduceat(memo.figures["cut"][places] > 0, starts[:-1])).tolist()
        if odd:
            for k in odd:
                rows[k] = cut(texts[some[k]])
            starts = np.cumsum([0, *map(len, rows)])
            places = memo.places(list(chain.from_iterable(rows)))
    f = memo.figures
    out = {c: np.zeros(n, np.int64) for c in ("n_a", "n_b", "n_groups", "n_links")}
    texts_out = [b""] * n
    doc, lengths = np.array(some, np.int64), np.diff(starts)
    if some:
        whole = np.logical_and.reduceat(f["n_a"][places] > 0, starts[:-1])
        for c, x in out.items():
            x[doc] = np.where(whole, np.add.reduceat(f[c][places], starts[:-1]), 0)
        for k in np.flatnonzero(whole).tolist():
            texts_out[some[k]] = b";".join(map(memo.texts.__getitem__, places[starts[k] : starts[k + 1]].tolist()))
        inside = np.repeat(whole, lengths)
        held, times = np.unique((np.repeat(doc, lengths) << 32 | places)[inside], return_counts=True)
        part = held & (1 << 32) - 1
        at = ragged(f["first"][part], f["size"][part])
        key = np.repeat(held >> 32, f["size"][part]) << 2 * ID_BITS | memo.pair[at]
        counts = np.repeat(times, f["size"][part]) * memo.times[at]
        order = np.argsort(key, kind="stable")
        key, counts = key[order], counts[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
        key, counts = key[first], np.add.reduceat(counts, first) if len(first) else counts
    else:
        key = counts = np.zeros(0, np.int64)
    mask = (1 << ID_BITS) - 1
    out["pair_doc"], out["pair_a"], out["pair_b"], out["pair_k"] = key >> 2 * ID_BITS, key >> ID_BITS & mask, key & mask, counts
    out["groups_sha256"] = [hashlib.sha256(t).hexdigest() if t else "" for t in texts_out]
    if keep_groups:
        out["groups"] = [t.decode() for t in texts_out]
    return out


def spans(texts: list[str | None]) -> list[tuple[int, int]]:
    """Consecutive (start, end) of at most ``BATCH`` texts and about ``BATCH_CHARS`` characters each."""
    out, lo, size = [], 0, 0
    for i, t in enumerate(texts):
        if i > lo and (i - lo >= BATCH or size + len(t or "") > BATCH_CHARS):
            out.append((lo, i))
            lo, size = i, 0
        size += len(t or "")
    if lo < len(texts):
        out.append((lo, len(texts)))
    return out


def aligned(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", keep_groups: bool = False) -> DataFrame:
    """(row, id, n_a, n_b, n_groups, n_links, groups_sha256, pairs[, groups]) for every row; ``row`` is unique."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"row long, id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs {PAIR_TYPE}"
    names = ["row", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs"] + (["groups"] if keep_groups else [])

    def batches(parts):
        s = sides(a_path, b_path)
        base, seen = TaskContext.get().partitionId() << 36, 0
        for batch in parts:
            texts = batch.column(1).to_pylist()
            for lo, hi in spans(texts):
                got = align_batch(s, texts[lo:hi], keep_groups)
                n = hi - lo
                offsets = np.searchsorted(got["pair_doc"], np.arange(n + 1)).astype(np.int32)
                pairs = pa.StructArray.from_arrays(
                    [pa.array(got["pair_a"], pa.int32()), pa.array(got["pair_b"], pa.int32()), pa.array(got["pair_k"], pa.int64())], names=["a", "b", "k"]
                )
                columns = [
                    pa.array(np.arange(base + seen, base + seen + n, dtype=np.int64)),
                    batch.column(0).slice(lo, n),
                    *(pa.array(got[c], pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")),
                    pa.array(got["groups_sha256"], pa.string()),
                    pa.ListArray.from_arrays(pa.array(offsets), pairs),
                ]
                if keep_groups:
                    columns.append(pa.array(got["groups"], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=names)
                seen += n

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(batches, schema + (", groups string" if keep_groups else ""))


@lru_cache(8)
def _shard(folder: str, number: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    table = part(folder, "shard", number).sort_by("pair")
    return tuple(table.column(c).to_numpy() for c in ("pair", "count", "best"))


def link_sums(rows: DataFrame, table: DataFrame) -> DataFrame:
    """``rows`` with n_best and count_sum in place of ``pairs``; ``table (pair, count, best)`` has every pair. A task
    looks up the different pairs of some documents in one shard after the other."""
    folder, shards = stage_path(rows.sparkSession), 1 + table.count() // SHARD_PAIRS
    dealt = table.withColumn("shard", (F.col("pair") % shards).cast("int"))
    dealt.repartition(shards, "shard").write.partitionBy("shard").parquet(folder)
    keep = [c for c in rows.columns if c != "pairs"]
    schema = T.StructType([*(rows.schema[c] for c in keep), T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())])

    def look_up(batches):
        for batch in arrays.bounded(batches, len(keep), most=LINKS):
            lists = batch.column(len(keep))
            lengths = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten()
            a, b, k = (flat.field(c).to_numpy().astype(np.int64) for c in range(3))
            pair, code = np.unique((a << ID_BITS) + b, return_inverse=True)
            count, best = np.zeros(len(pair), np.int64), np.zeros(len(pair), np.int64)
            for number in np.unique(pair % shards).tolist():
                at = np.flatnonzero(pair % shards == number)
                have, counts, bests = _shard(folder, number)
                place = np.searchsorted(have, pair[at])
                count[at], best[at] = counts[place], bests[place]
            ends = np.cumsum(lengths)
            sums = []
            for x in (best, count):
                total = np.r_[0, np.cumsum(k * x[code])]
                sums.append(pa.array(total[ends] - total[ends - lengths], pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *sums], names=schema.names)

    return rows.select(*keep, "pairs").mapInArrow(look_up, schema)


def report(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", keep_groups: bool = False) -> DataFrame:
    """Per row: id_col, n_a, n_b, n_groups, n_links, n_best, count_sum (long), groups_sha256, and with
    ``keep_groups`` the groups text itself (as long as the text's ids, so it is left out unless asked for)."""
    rows = stage(aligned(docs, a_path, b_path, id_col, text_col, keep_groups))
    links = rows.select(F.explode("pairs").alias("p")).select((F.col("p.a").cast("long") * (1 << ID_BITS) + F.col("p.b")).alias("pair"), F.col("p.b").alias("b"), F.col("p.k").alias("k"))
    counts = stage(links.groupBy("pair", "b").agg(F.sum("k").alias("count")))
    top = counts.groupBy("b").agg(F.max("count").alias("top"))
    table = stage(counts.join(top, "b").select("pair", "count", (F.col("count") == F.col("top")).cast("long").alias("best")))
    return link_sums(rows, table).select(
        F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", *(["groups"] if keep_groups else [])
    )
