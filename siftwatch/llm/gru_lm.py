"""A gated recurrent language model over words, trained by truncated backpropagation in numpy.

Output probabilities are factored into a class and a word within it. The most frequent training words (``FREQUENT``)
share learned classes with a softmax inside each; all other words belong to a class by their shape (last letter, marks),
inside which they have smoothed count shares, unknown words included; the end of a text is a class of its own. So the
model is a distribution over the same words as the count baseline, and starts from it: output biases come from counts.

* Counts cover all training texts: one shuffled sum per word.
* Training covers all windows of all training texts once, in ``ROUNDS`` rounds: every task walks its texts in parallel
  lanes, carrying states from window to window, and the tasks' parameters are averaged by their tokens.
* Scoring carries the state from a text's first word to its last. Words outside the most frequent ones (``KNOWN`` at most) get
  their counts by a join on what each text holds of them; frequent words never enter that shuffle.

Null and empty texts hold only the end. Rows without an id are held out of training but not marked so. Without training
texts all words are unknown and share one class. Repeated ids keep a row each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from siftwatch.llm.texts import by_bytes, coded_words, one_per_worker
from siftwatch.staging import stage

FREQUENT, CLASSES = 1024, 32
KNOWN = 400_000
HIDDEN, EMBEDDED = 16, 8
ROUNDS, WINDOW, LANES, RATE = 2, 24, 384, 0.01
SCORING_LANES, SCORING_BYTES, COUNTED_BYTES = 1024, 12 << 20, 12 << 20
TRAINING_BYTES = 8 << 20
#: In training a lane starts anew after this many words of one text.
SEGMENT = 2000
MEMO_WORDS = 300_000
ALPHA = 0.1
#: Tokens whose class scores are worked out at once.
BLOCK = 1024

END = b"\n"  # no word holds white space
LETTERS = b"abcdefghijklmnopqrstuvwxyz"
#: Shapes: last letter a-z, other letter, digit, each with and without a mark behind; marks only.
SHAPES = 2 * (len(LETTERS) + 2) + 1


#: Of a word's last byte before its marks: its place among the kinds of letters, digits and others.
KINDS = np.full(256, len(LETTERS))
KINDS[list(LETTERS)] = range(len(LETTERS))
KINDS[list(b"0123456789")] = len(LETTERS) + 1


def shapes(words: list[bytes]) -> np.ndarray:
    whole = pa.array(words, pa.large_binary())
    texts = pa.LargeStringArray.from_buffers(len(whole), *whole.buffers()[1:])
    core = pc.ascii_rtrim(texts, characters=".,;:!?\"')]}|*%$&#-")
    sizes = pc.binary_length(core).to_numpy()
    ends = np.frombuffer(whole.buffers()[1], np.int64)[: len(words)] + sizes - 1
    last = np.frombuffer(b"".join([*words, b"\0"]), np.uint8)[np.maximum(ends, 0)]
    return np.where(sizes > 0, 2 * KINDS[last] + (sizes < pc.binary_length(texts).to_numpy()), SHAPES - 1)


def key_of(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word) - (1 << 63)


# counts


def counted(texts: DataFrame) -> DataFrame:
    """(key, word, shape, n) of all words of all texts, and of their ends."""
    def run(batches):
        for batch in batches:
            for b in by_bytes(batch, 0, COUNTED_BYTES):
                words, places, _ = coded_words(b.column(0))
                times = np.append(np.bincount(places, minlength=len(words)), b.num_rows)
                yield pa.RecordBatch.from_arrays([pa.array([*words, END], pa.binary()), pa.array(times, pa.int64())], names=["word", "n"])

    def keyed(batches):
        for b in batches:
            words = b.column(0).to_pylist()
            if words:
                own = np.where([w == END for w in words], SHAPES, shapes(words))
                yield pa.RecordBatch.from_arrays([pa.array(list(map(key_of, words)), pa.int64()), b.column(0), pa.array(own, pa.int32()), b.column(1)], names=["key", "word", "shape", "n"])

    return texts.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).mapInArrow(keyed, "key long, word binary, shape int, n long")


class Vocabulary:
    """What the model knows of the counts. Its size is bounded by ``FREQUENT``, ``KNOWN`` and the number of shapes."""

    def __init__(self, counts: DataFrame):
        total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
        self.tokens, self.types = total.n, total.v
        top = counts.where(F.col("shape") < SHAPES).orderBy(F.desc("n"), "word")
        best = top.limit(FREQUENT).select("word", "shape", "n").collect()
        self.frequent = {bytes(r.word): i for i, r in enumerate(best)}
        self.counts = np.array([r.n for r in best], float)
        shapes = counts.groupBy("shape").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()
        self.mass, self.inside = np.zeros(SHAPES), np.zeros(SHAPES)
        for r in shapes:
            if r.shape < SHAPES:
                self.mass[r.shape], self.inside[r.shape] = r.n, r.v
        for r in best:
            self.mass[r.shape] -= r.n
            self.inside[r.shape] -= 1
        self.ends = sum(r.n for r in shapes if r.shape == SHAPES)
        # One unknown word in every shape's class.
        self.whole = self.mass + ALPHA * (self.inside + 1)
        # The lowest count, by quarter powers of two, above which there are no more words than may be sent on.
        power = F.floor(F.log2("n") * 4).cast("int")
        sizes = counts.groupBy(power.alias("power")).count().orderBy(F.desc("power")).collect()
        few = [r.power for r, most in zip(sizes, np.cumsum([r["count"] for r in sizes])) if most <= KNOWN]
        known = counts.where((F.col("shape") < SHAPES) & (power >= (few[-1] if few else 1 << 20))).select("key", "n").toPandas().sort_values("key")
        self.keys, self.known = known["key"].to_numpy(np.int64), known["n"].to_numpy(np.int64)


# the network


class Gru:
    """Parameters as one dict of float32 arrays. Inputs are codes: frequent words, shapes, the end, the start."""

    def __init__(self, vocabulary: Vocabulary, seed: int = 1):
        v, random = vocabulary, np.random.default_rng(seed)
        self.n = len(v.frequent)
        self.members = max(1, -(-self.n // CLASSES))
        self.end, self.start = self.n + SHAPES, self.n + SHAPES + 1
        self.codes = self.n + SHAPES + 2
        self.outputs = CLASSES + SHAPES + 1
        inner = np.full(CLASSES * self.members, -30.0)
        inner[: self.n] = np.log(v.counts + ALPHA)
        inner = inner.reshape(CLASSES, self.members)
        mass = np.concatenate([np.where(inner > -30, np.exp(inner), 0).sum(axis=1) + 1e-9, v.whole, [v.ends + ALPHA]])

        def small(*shape):
            return random.normal(0, 0.3 / np.sqrt(shape[0]), shape).astype(np.float32)

        self.p = {
            "embed": random.normal(0, 0.5, (self.codes, EMBEDDED)).astype(np.float32),
            "wx": small(EMBEDDED, 3 * HIDDEN),
            "b": np.zeros(3 * HIDDEN, np.float32),
            "wh": small(HIDDEN, 3 * HIDDEN),
            "wc": np.zeros((HIDDEN, self.outputs), np.float32),
            "bc": np.log(mass / mass.sum()).astype(np.float32),
            "wi": np.zeros((CLASSES, HIDDEN, self.members), np.float32),
            "bi": (inner - inner.max(axis=1, keepdims=True)).astype(np.float32),
        }

    def step(self, x: np.ndarray, h: np.ndarray):
        """One time step from gate inputs ``x`` and states ``h``; also what the way back needs."""
        g = h @ self.p["wh"]
        zr = x[:, : 2 * HIDDEN] + g[:, : 2 * HIDDEN]
        zr *= 0.5
        np.tanh(zr, out=zr)  # the logistic function, by the cheaper of two equal forms
        zr *= 0.5
        zr += 0.5
        z, r, inner = zr[:, :HIDDEN], zr[:, HIDDEN:], g[:, 2 * HIDDEN :]
        new = np.tanh(x[:, 2 * HIDDEN :] + r * inner)
        return new + z * (h - new), (zr, inner, new)

    def classes_of(self, codes: np.ndarray) -> np.ndarray:
        return np.where(codes < self.n, codes // self.members, codes - self.n + CLASSES)

    def output(self, states: np.ndarray, codes: np.ndarray, back: dict | None = None):
        """Natural log of the probability of each code after its state: its class, and its place in a class of
        frequent words. With ``back``, gradients of the negative sum are put there; the states' one is returned too."""
        n, classes = len(codes), self.classes_of(codes)
        wc, bc, ones = self.p["wc"], self.p["bc"], np.ones(self.outputs, self.p["wc"].dtype)
        logs, grad = np.empty(n, wc.dtype), None
        if back is not None:
            grad = np.empty_like(states)
            back.update({k: np.zeros_like(self.p[k]) for k in ("wc", "bc", "wi", "bi")})
        for i in range(0, n, BLOCK):  # blocks that stay in the cache
            own, target = states[i : i + BLOCK], classes[i : i + BLOCK]
            rows, logits = np.arange(len(own)), own @ wc
            logits += bc
            np.minimum(logits, 60, out=logits)
            at = logits[rows, target]
            np.exp(logits, out=logits)
            total = logits @ ones
            logs[i : i + BLOCK] = at - np.log(total)
            if back is not None:
                logits *= (1 / total)[:, None]
                logits[rows, target] -= 1
                grad[i : i + BLOCK] = logits @ wc.T
                back["wc"] += own.T @ logits
                back["bc"] += logits.sum(axis=0)
        frequent = np.flatnonzero(codes < self.n)
        order = frequent[np.argsort(classes[frequent].astype(np.uint16), kind="stable")]
        bounds = np.searchsorted(classes[order], np.arange(CLASSES + 1))
        for c in np.flatnonzero(np.diff(bounds)):
            own = order[bounds[c] : bounds[c + 1]]
            place, hs, k = codes[own] - c * self.members, states[own], np.arange(len(own))
            inner = hs @ self.p["wi"][c]
            inner += self.p["bi"][c]
            np.minimum(inner, 60, out=inner)
            at = inner[k, place]
            np.exp(inner, out=inner)
            total = inner @ np.ones(self.members, wc.dtype)
            logs[own] += at - np.log(total)
            if back is not None:
                inner *= (1 / total)[:, None]
                inner[k, place] -= 1
                grad[own] += inner @ self.p["wi"][c].T
                back["wi"][c], back["bi"][c] = hs.T @ inner, inner.sum(axis=0)
        return logs, grad

    def learn(self, inputs: np.ndarray, targets: np.ndarray, fresh: np.ndarray, state: np.ndarray) -> tuple[dict, np.ndarray]:
        """Gradients over one window (time, lanes), per token; ``fresh`` marks first words. The state moves on."""
        steps, lanes = inputs.shape
        embedded = self.p["embed"][inputs]
        x = (embedded.reshape(-1, EMBEDDED) @ self.p["wx"] + self.p["b"]).reshape(steps, lanes, -1)
        before, after, kept = np.empty((2, steps, lanes, HIDDEN), np.float32), None, []
        before, after = before
        for t in range(steps):
            before[t] = state
            before[t][fresh[t]] = 0
            after[t], more = self.step(x[t], before[t])
            kept.append(more)
            state = after[t]
        back: dict = {}
        _, grad = self.output(after.reshape(-1, HIDDEN), targets.ravel(), back)
        grad = grad.reshape(after.shape)
        gates, hidden, down = np.empty_like(x), np.empty_like(x), np.zeros((lanes, HIDDEN), np.float32)
        back_wh = np.ascontiguousarray(self.p["wh"].T)
        for t in range(steps - 1, -1, -1):
            (zr, inner, new), h = kept[t], before[t]
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            d = grad[t]
            d += down
            slope = zr * (1 - zr)
            dn = d * (1 - z)
            dn *= 1 - new * new
            a, g = gates[t], hidden[t]
            np.multiply(d, h - new, out=a[:, :HIDDEN])
            np.multiply(dn, inner, out=a[:, HIDDEN : 2 * HIDDEN])
            a[:, : 2 * HIDDEN] *= slope
            a[:, 2 * HIDDEN :] = dn
            g[:, : 2 * HIDDEN] = a[:, : 2 * HIDDEN]
            np.multiply(dn, r, out=g[:, 2 * HIDDEN :])
            down = g @ back_wh
            down += d * z
            down[fresh[t]] = 0
        flat = gates.reshape(-1, 3 * HIDDEN)
        back["wx"], back["b"] = embedded.reshape(-1, EMBEDDED).T @ flat, flat.sum(axis=0)
        back["wh"] = before.reshape(-1, HIDDEN).T @ hidden.reshape(-1, 3 * HIDDEN)
        order = np.argsort(inputs.ravel().astype(np.uint16), kind="stable")  # short numbers sort faster
        codes = inputs.ravel()[order]
        first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
        back["embed"] = np.zeros_like(self.p["embed"])
        back["embed"][codes[first]] = np.add.reduceat((flat @ self.p["wx"].T)[order], first)
        return {k: g / (steps * lanes) for k, g in back.items()}, state


class Adam:
    def __init__(self, p: dict, rate: float):
        self.p, self.rate, self.n = p, rate, 0
        self.mean, self.square = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))

    def __call__(self, grads: dict) -> None:
        self.n += 1
        rate = self.rate * min(1, self.n / 20) * np.sqrt(1 - 0.99**self.n) / (1 - 0.9**self.n)
        for k, g in grads.items():
            self.mean[k] += 0.1 * (g - self.mean[k])
            self.square[k] += 0.01 * (g * g - self.square[k])
            self.p[k] -= rate * self.mean[k] / (np.sqrt(self.square[k]) + 1e-6)


class Coder:
    """Codes of words, kept for words seen before, with their keys and known counts."""

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.place = vocabulary, {}
        self.rows = self._empty(MEMO_WORDS)

    @staticmethod
    def _empty(n: int) -> dict[str, np.ndarray]:
        return {"code": np.zeros(n, np.int64), "key": np.zeros(n, np.int64), "n": np.zeros(n, np.int64)}

    def texts(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``rows`` of all words of the texts, and where each text's begin. Different words are looked up
        once."""
        words, places, bounds = coded_words(column)
        new = [w for w in words if w not in self.place]
        room = len(self.rows["code"])
        if len(new) + len(self.place) > room:
            self.place.clear()
            new = [w for w in words if w]
            if len(new) > room:
                self.rows = self._empty(len(new))
        if new:
            at, n = len(self.place), len(self.v.frequent)
            own = {k: x[at : at + len(new)] for k, x in self.rows.items()}
            code = np.array([self.v.frequent.get(w, -1) for w in new])
            own["code"][:] = np.where(code >= 0, code, n + shapes(new))
            own["key"][:] = list(map(key_of, new))
            own["n"][:] = -1
            if len(self.v.keys):
                found = np.minimum(np.searchsorted(self.v.keys, own["key"]), len(self.v.keys) - 1)
                own["n"][:] = np.where(self.v.keys[found] == own["key"], self.v.known[found], -1)
            self.place.update(zip(new, range(at, at + len(new))))
        found = np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))
        return found[places], bounds


def coder(sent) -> Coder:
    return one_per_worker(("gru", sent._path), lambda: Coder(sent.value))


def lanes_of(lengths: list[int], lanes: int) -> list[list[int]]:
    """Texts dealt to lanes of about equal length, longest first."""
    import heapq

    heap, out = [(0, k) for k in range(lanes)], [[] for _ in range(lanes)]
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n, k = heap[0]
        heapq.heapreplace(heap, (n + lengths[i], k))
        out[k].append(i)
    return [x for x in out if x]


def trained(texts: DataFrame, network: Gru, sent, rounds: int = ROUNDS) -> Gru:
    """All training texts once; in each round those of one hash remainder."""
    names = list(network.p)
    for part in range(rounds):
        start = texts.sparkSession.sparkContext.broadcast(network)

        def run(batches):
            import copy

            own, code = copy.deepcopy(start.value), coder(sent)
            adam, tokens = Adam(own.p, RATE), 0
            queues = [[] for _ in range(LANES)]
            sizes, state = np.zeros(LANES, np.int64), np.zeros((LANES, HIDDEN), np.float32)

            def windows():
                """Windows over all lanes while each holds one."""
                nonlocal tokens, state
                streams = [np.concatenate(q) for q in queues]
                used = int(sizes.min()) // WINDOW * WINDOW
                block = np.ascontiguousarray(np.stack([s[:used] for s in streams]).transpose(2, 1, 0))
                inputs, targets, fresh = block[0], block[1], block[2].astype(bool)
                for i in range(0, used, WINDOW):
                    now = slice(i, i + WINDOW)
                    grads, state = own.learn(inputs[now], targets[now], fresh[now], state)
                    adam(grads)
                tokens += used * LANES
                for k, s in enumerate(streams):
                    queues[k] = [s[used:]]
                    sizes[k] -= used

            for batch in batches:
                for b in by_bytes(batch, 0, TRAINING_BYTES):
                    places, bounds = code.texts(b.column(0))
                    for codes in np.split(code.rows["code"][places], bounds[1:-1]):
                        codes = np.append(codes, own.end)
                        for i in range(0, len(codes), SEGMENT):
                            piece = codes[i : i + SEGMENT]
                            rows = np.zeros((len(piece), 3), np.int32)
                            rows[:, 1] = piece
                            rows[1:, 0], rows[0, 0] = piece[:-1], own.start if i == 0 else codes[i - 1]
                            rows[0, 2] = 1
                            k = int(sizes.argmin())
                            queues[k].append(rows)
                            sizes[k] += len(rows)
                    if sizes.min() >= WINDOW:
                        windows()
            # What is left in the lanes, end to end, fills lanes again until less than a window is over.
            rest = np.concatenate([r for q in queues for r in q]) if any(queues) else np.zeros((0, 3), np.int32)
            for width in (LANES, LANES // 8, 8, 1):
                steps = len(rest) // width // WINDOW
                if steps:
                    take = rest[: steps * width * WINDOW].reshape(width, steps * WINDOW, 3)
                    state = np.zeros((width, HIDDEN), np.float32)
                    for s in range(steps):
                        block = take[:, s * WINDOW : (s + 1) * WINDOW].transpose(1, 0, 2)
                        fresh = block[:, :, 2].astype(bool)
                        fresh[0] |= s == 0
                        grads, state = own.learn(block[:, :, 0], block[:, :, 1], fresh, state)
                        adam({k: g * (width / LANES) ** 0.5 for k, g in grads.items()})
                    tokens += steps * width * WINDOW
                    rest = rest[steps * width * WINDOW :]
            if tokens:
                arrays = [pa.array([own.p[k].ravel()], pa.list_(pa.float32())) for k in names]
                yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([tokens], pa.int64()), *arrays], names=["task", "tokens", *names])

        own = texts.where(F.pmod(F.xxhash64("text", F.lit("round")), F.lit(rounds)) == part).select("text")
        kinds = ", ".join(["task int", "tokens long", *(f"{k} array<float>" for k in names)])
        network.p = averaged(own.mapInArrow(run, kinds), network.p)
    return network


def averaged(results: DataFrame, old: dict) -> dict:
    """Means of the tasks' parameters, weighted by tokens: summed in groups of tasks first, so that no task or driver
    meets more than about the square root of their number at once."""
    names = list(old)

    def total(key, table):
        weight = table.column("tokens").to_numpy().astype(float)
        sums = [pa.array([(weight[:, None] * np.stack(table.column(k).to_numpy())).sum(axis=0) / weight.sum()], pa.list_(pa.float32())) for k in names]
        return pa.table([pa.array([0], pa.int32()), pa.array([int(weight.sum())], pa.int64()), *sums], names=["task", "tokens", *names])

    rows = stage(results)
    tasks = rows.count()
    if not tasks:
        return old
    groups = int(tasks**0.5)
    kinds = rows.schema
    part = rows.withColumn("task", F.col("task") % groups).groupBy("task").applyInArrow(total, kinds)
    out = total(None, part.toArrow())
    return {k: np.array(out.column(k)[0].as_py(), np.float32).reshape(old[k].shape) for k in names}


def log_likelihoods(network: Gru, texts: list[np.ndarray], lanes: int = SCORING_LANES) -> np.ndarray:
    """Natural log-probability of each row of codes (its end included), the state carried through all of it."""
    dealt = lanes_of([len(t) for t in texts], lanes)
    dealt.sort(key=lambda lane: -sum(len(texts[i]) for i in lane))
    lengths = np.array([sum(len(texts[i]) for i in lane) for lane in dealt], np.int64)
    firsts = np.cumsum(lengths) - lengths
    flat = [i for lane in dealt for i in lane]
    stream = np.concatenate([*(texts[i] for i in flat), [-1]])  # lane after lane
    owners = np.append(np.repeat(np.array(flat, np.int64), [len(texts[i]) for i in flat]), -1)
    steps, width = lengths.max(initial=0), len(dealt)
    out, state = np.zeros(len(texts)), np.zeros((width, HIDDEN), np.float32)
    gates = network.p["embed"] @ network.p["wx"] + network.p["b"]
    last_code = np.full(width, network.start)
    last_owner = np.full(width, -1)
    for begin in range(0, steps, WINDOW):
        live = int((lengths > begin).sum())  # lanes are sorted by length
        state, last_code, last_owner = state[:live], last_code[:live], last_owner[:live]
        size = min(WINDOW, int(lengths[0]) - begin)
        time = np.arange(begin, begin + size)[:, None]
        places = np.where(time < lengths[:live], firsts[:live] + time, len(stream) - 1)
        codes, owner = stream[places], owners[places]
        states = np.empty((size, live, HIDDEN), np.float32)
        for t in range(size):
            fresh = owner[t] != last_owner
            inputs = np.where(fresh, network.start, last_code)
            state, _ = network.step(gates[inputs], np.where(fresh[:, None], np.float32(0), state))
            states[t] = state
            last_code, last_owner = codes[t], owner[t]
        real = owner.ravel() >= 0
        logs, _ = network.output(states.reshape(-1, HIDDEN)[real], codes.ravel()[real])
        out += np.bincount(owner.ravel()[real], logs, len(texts))
    return out


def score(docs: DataFrame, network: Gru, vocabulary, counts: DataFrame, carry: list) -> DataFrame:
    """The ``carry`` columns, n_tokens, n_known, base_score and score of every row."""
    spark = docs.sparkSession
    slim = docs.select(F.col("text").alias("_text"), *carry)
    net = spark.sparkContext.broadcast(network)
    inside = T.ArrayType(T.StructType([T.StructField("key", T.LongType()), T.StructField("times", T.IntegerType())]))
    numbers = [("row", T.LongType()), ("n_tokens", T.LongType()), ("n_known", T.LongType()), ("base_score", T.DoubleType()), ("score", T.DoubleType()), ("rare", inside)]
    schema = T.StructType([*slim.schema[1:], *(T.StructField(n, t) for n, t in numbers)])
    rare_type = pa.list_(pa.struct([("key", pa.int64()), ("times", pa.int32())]))

    def run(batches):
        code, own, v = coder(vocabulary), net.value, vocabulary.value
        row = TaskContext.get().partitionId() << 33
        whole = np.log10(v.tokens + ALPHA * (v.types + 1))
        inside = np.log10(np.append(v.whole, 1.0))
        for batch in batches:
            for b in by_bytes(batch, 0, SCORING_BYTES):
                places, bounds = code.texts(b.column(0))
                lengths = np.diff(bounds)
                count, owner = len(lengths), np.repeat(np.arange(len(lengths)), lengths)
                codes, n = code.rows["code"][places], code.rows["n"][places]
                scores = log_likelihoods(own, [np.append(x, own.end) for x in np.split(codes, bounds[1:-1])]) / np.log(10)
                have, shaped = n >= 0, codes >= own.n
                logs = np.where(have, np.log10(np.maximum(n, 0) + ALPHA), 0)
                known = np.bincount(owner[have], minlength=count) + (v.ends > 0)
                base = np.bincount(owner, logs, count) + np.log10(v.ends + ALPHA) - (lengths + 1) * whole
                scores += np.bincount(owner[shaped], logs[shaped] - inside[codes[shaped] - own.n], count)
                # Words of unknown counts, once for each text.
                width = len(code.rows["key"])
                rare, times = np.unique(owner[~have] * width + places[~have], return_counts=True)
                starts = np.searchsorted(rare // width, np.arange(count + 1))
                inner = pa.StructArray.from_arrays([pa.array(code.rows["key"][rare % width]), pa.array(times, pa.int32())], ["key", "times"])
                rare = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), inner)
                numbers = [pa.array(range(row, row + count), pa.int64()), pa.array(lengths + 1, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(scores, pa.float64()), rare.cast(rare_type)]
                row += count
                yield pa.RecordBatch.from_arrays([*b.columns[1:], *numbers], names=schema.names)

    # Row numbers are fixed by writing them.
    scored = stage(slim.mapInArrow(run, schema))
    rare = scored.select("row", F.inline("rare")).join(counts.select("key", "n"), "key", "left")
    n = F.coalesce("n", F.lit(0))
    logs = F.sum(F.col("times") * F.log10(n + ALPHA))
    sums = rare.groupBy("row").agg(F.sum(F.when(n > 0, F.col("times")).otherwise(0)).alias("_known"), logs.alias("_logs"))
    more = F.coalesce("_logs", F.lit(0.0))
    fixed = [c for c in schema.names if c not in [x for x, _ in numbers]]
    return scored.join(sums, "row", "left").select(
        *fixed, "n_tokens", (F.col("n_known") + F.coalesce("_known", F.lit(0))).alias("n_known"), (F.col("base_score") + more).alias("base_score"), (F.col("score") + more).alias("score")
    )


def held_out_scores(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Learn from documents whose id's checksum by 10 leaves another remainder than 0, and score all."""
    rest = F.crc32(F.col("doc_id").cast("string")) % 10
    texts = docs.where(rest != 0).select(F.coalesce("text", F.lit("")).alias("text"))
    counts = stage(counted(texts))
    vocabulary = Vocabulary(counts)
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)
    network = trained(texts, Gru(vocabulary), sent, rounds)
    carry = [F.col("doc_id"), F.coalesce(rest == 0, F.lit(False)).alias("held_out")]
    return score(docs, network, sent, counts, carry).withColumn("train_tokens", F.lit(vocabulary.tokens).cast("long"))
