"""Language-model scoring with a log-bilinear model trained by noise-contrastive estimation.

1. *Counts.* Every training token is counted: partial counts in the tasks, one sum a word.
   The table stays distributed; the driver sees its ``HEAD`` most frequent words, the
   totals N and V, and the sums of the classes.
2. *Classes and units.* The ``SHORTLIST`` most frequent tokens are a class each; any other
   word, seen or not, belongs to the class of its last two characters. Within a class the
   most frequent words are a unit each, in all ``OWN`` times the square root of the number
   of distinct training words (the head at most); the others share the class's rest unit by
   add-0.1 shares, one unseen word included, so probabilities sum to one.
3. *Training.* The log-bilinear model predicts a token's class from the two before it:
   the prediction is a sum of context vectors, each scaled by its position's weights,
   and scores are its products with the class vectors plus a bias. Every task runs
   noise-contrastive estimation in numpy over all its training texts; the tasks' models,
   weighted by their tokens, are averaged by a Spark sum a parameter. ``PASSES`` passes are made (on these tables a second
   one lowers held-out scores). A second log-bilinear model, over vectors of the units
   before and of the units of a class, predicts the unit within its class; its softmax is
   exact. Its rows are averaged in Spark as well, weighted by the tokens that moved them.
4. *Scoring.* The distinct contexts of a few megabytes of text give one matrix product
   after another, normalised over all classes. Words beyond the head meet their counts
   in a join on the word.

Defined cases: null and empty texts are one end token; a null id is never held out and is
learned from; repeated rows give one row each; without training text the model is uniform
over the classes and all counts are 0; an empty table gives an empty result; other
columns aren't read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from searchlane.llm import scratch, textkit
from searchlane.llm.labels import held_out

FOLDS, HELD_OUT = 10, 0
HEAD = 1 << 16
SHORTLIST, SUFFIXES = 256, 255
CLASSES = SHORTLIST + SUFFIXES + 1
DIM, CONTEXT, NOISE, BATCH = 24, 2, 48, 4096
PASSES, RATES = 1, (0.05,)
OWN = 4
INNER_RATE, INNER_BATCH = 0.2, 1024
ADD = 0.1
END = b" "  # no word holds white space
NEVER = float(np.log10(ADD))
COUNTER_WORDS = 300_000  # rows of partial counts a task holds before it sums them
TABLE = 512  # contexts whose probabilities of all classes are made at once


def tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words of the texts and the end, the place of every token among them, tokens a text."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    lengths, words = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64), lists.flatten()
    real = pc.greater(pc.binary_length(words), 0)  # white space at an end of a text leaves an empty string
    if not pc.all(real).as_py():
        kept = np.concatenate(([0], np.cumsum(real.to_numpy(zero_copy_only=False))))
        lengths, words = np.diff(kept[np.concatenate(([0], np.cumsum(lengths)))]), words.filter(real)
    coded = words.dictionary_encode()
    code = np.full(len(words) + len(texts), len(coded.dictionary), np.int32)
    is_word = np.ones(len(code), bool)
    is_word[np.cumsum(lengths + 1) - 1] = False
    code[is_word] = coded.indices.to_numpy(zero_copy_only=False)
    return pa.concat_arrays([coded.dictionary, pa.array([END.decode()], coded.dictionary.type)]), code, lengths + 1


def _partial_counts(batches):
    held, rows = [], 0

    def summed():
        both = pa.concat_tables(held).group_by("word").aggregate([("c", "sum")])
        return pa.table({"word": both["word"], "c": both["c_sum"]})

    for batch in batches:
        for a, b in textkit.chunks(batch, "text"):
            words, code, _ = tokens(batch.column("text").slice(a, b - a))
            counted = np.bincount(code, minlength=len(words)).astype(np.int64)
            held.append(pa.table({"word": words.cast(pa.string()), "c": counted}))
            rows += len(words)
            if rows > COUNTER_WORDS:
                held = [summed()]
                rows = len(held[0])
                if rows > COUNTER_WORDS // 2:  # many are new: merging them again and again would not make them fewer
                    yield from held[0].combine_chunks().to_batches()
                    held, rows = [], 0
    if held:
        yield from summed().combine_chunks().to_batches()


class Units:
    """Units of the classes: a shortlist token, a word of its own, or the rest of a class."""

    def __init__(self, shortlist: list[bytes], suffixes: list[str], own: list[tuple[bytes, int]],
                 mass: np.ndarray, kinds: np.ndarray, short_counts: list[int]):
        self.suffixes = pa.array(suffixes, pa.string())
        words: list[list[tuple[bytes, int]]] = [[] for _ in range(CLASSES)]
        for (w, c), k in zip(own, self.class_of(pa.array([w for w, _ in own], pa.binary()).cast(pa.string())).tolist()):
            words[k].append((w, c))
        self.start, self.number, logs = [], {}, []
        for k in range(CLASSES):
            self.start.append(len(logs))
            if k < SHORTLIST:
                c = short_counts[k] if k < len(short_counts) else 0
                logs.append((0.0, np.log10(c + ADD)))
                continue
            for w, c in words[k]:
                self.number[w] = len(logs)
                logs.append((0.0, np.log10(c + ADD)))
            left = mass[k] - sum(c for _, c in words[k]) + ADD * (kinds[k] - len(words[k]) + 1)
            logs.append((np.log10(left), 0.0))
        self.start = np.array(self.start + [len(logs)])
        self.total = len(logs)
        self.rest = self.start[1:] - 1
        self.share, self.head = map(np.array, zip(*logs))
        self.class_of_unit = np.append(np.repeat(np.arange(CLASSES), np.diff(self.start)), CLASSES).astype(np.int16)
        self.kind = np.uint16 if self.total < 1 << 16 else np.int32  # short numbers sort by radix
        self.bias = ((self.share + self.head) * np.log(10)).astype(np.float32)

        known = shortlist + list(self.number)
        self.known = pa.array(known, pa.binary()).cast(pa.string())
        self.unit_of_known = np.concatenate((self.rest[:len(shortlist)], list(self.number.values()))).astype(self.kind)

    def class_of(self, words: pa.Array) -> np.ndarray:
        """Classes of words that aren't on the shortlist."""
        ends = pc.utf8_slice_codeunits(words, -2)
        return SHORTLIST + _places(ends, self.suffixes, CLASSES - 1 - SHORTLIST)

    def units_of(self, words: pa.Array) -> np.ndarray:
        """Units of distinct words."""
        at = _places(words, self.known, -1)
        found, other = np.empty(len(words), self.kind), at < 0
        found[~other] = self.unit_of_known[at[~other]]
        found[other] = self.rest[self.class_of(words.filter(pa.array(other)))]
        return found


def _places(words: pa.Array, among: pa.Array, otherwise: int) -> np.ndarray:
    """Each word's place among some, or another number."""
    return pc.fill_null(pc.index_in(words, value_set=among.cast(words.type)), otherwise).to_numpy(zero_copy_only=False)


class Inner:
    """Log-bilinear model of a unit within its class: rows of units before (one more stands for
    what lies before a text), of units to predict, and of position weights; a row ends in its bias."""

    def __init__(self, units: Units, rows: np.ndarray | None = None):
        self.units, u = units, units.total
        if rows is None:
            rows = np.zeros((2 * u + 1 + CONTEXT, DIM + 1), np.float32)
            rows[:u + 1, :DIM] = np.random.default_rng(7).normal(0, 0.1, (u + 1, DIM))
            rows[u + 1:2 * u + 1, DIM] = units.bias
            rows[2 * u + 1:, :DIM] = 1
        self.rows = rows
        self.target, self.places = rows[u + 1:2 * u + 1], rows[2 * u + 1:, :DIM]

    def start_training(self) -> None:
        self.squares, self.moved = np.ones_like(self.rows), np.zeros(len(self.rows))

    def predict(self, near: list[np.ndarray]) -> np.ndarray:
        """Predictions from the rows of the units before; a last 1 meets the biases."""
        q = near[0] * self.rows[-CONTEXT]
        for i in range(1, CONTEXT):
            q += near[i] * self.rows[i - CONTEXT]
        q[:, DIM] = 1
        return q

    def log_probabilities(self, contexts: np.ndarray, k: int, at: np.ndarray | None = None) -> np.ndarray:
        """Normalised natural log-probabilities of the units of class ``k``, a row a context, or
        of one of them (``at``, counted from the class's first) a context."""
        own = self.target[self.units.start[k]:self.units.start[k + 1]]
        z = self.predict([self.rows.take(contexts[:, i], axis=0) for i in range(CONTEXT)]) @ own.T
        logs = z.copy() if at is None else z[np.arange(len(at)), at]
        shift, total = _exponentials(z)
        total = shift + np.log(total)
        return logs - (total[:, None] if at is None else total)

    def by_class(self, target: np.ndarray, order: np.ndarray, size: int):
        """(class, places of at most ``size`` of its tokens) for classes of several units."""
        kind = self.units.class_of_unit.take(target.take(order))
        order = order.take(np.argsort(kind, kind="stable"))
        edges = np.append(0, np.cumsum(np.bincount(kind, minlength=CLASSES)))
        for k in np.flatnonzero((np.diff(edges) > 0) & (np.diff(self.units.start) > 1)).tolist():
            for lo in range(edges[k], edges[k + 1], size):
                yield k, order[lo:min(lo + size, edges[k + 1])]

    def train(self, contexts: np.ndarray, target: np.ndarray, order: np.ndarray) -> None:
        u, columns = self.units.total, np.ascontiguousarray(contexts.T)
        for k, at in self.by_class(target, order, INNER_BATCH):
            a, b = self.units.start[k], self.units.start[k + 1]
            before = [column.take(at) for column in columns]
            q = self.predict([self.rows.take(x, axis=0) for x in before])
            own = self.target[a:b]
            up = q @ own.T
            up *= (-1 / _exponentials(up)[1])[:, None]
            up[np.arange(len(at)), target.take(at) - a] += 1
            dq = up @ own[:, :DIM]
            self._step(slice(u + 1 + a, u + 1 + b), up.T @ q, len(at))
            sums = [_sums(x, dq) for x in before]
            places = np.zeros((CONTEXT, DIM + 1), np.float32)
            for i, (keys, g, _) in enumerate(sums):
                places[i, :DIM] = np.einsum("ij,ij->j", g, self.rows.take(keys, axis=0)[:, :DIM])
            for i, (keys, g, n) in enumerate(sums):
                wide = np.zeros((len(keys), DIM + 1), np.float32)
                np.multiply(g, self.places[i], out=wide[:, :DIM])
                self._step(keys, wide, n)
            self._step(slice(2 * u + 1, None), places, len(at))

    def _step(self, at, g: np.ndarray, n) -> None:
        squares = self.squares[at] if isinstance(at, slice) else self.squares.take(at, axis=0)
        squares += g * g
        self.squares[at] = squares
        g *= INNER_RATE
        g /= np.sqrt(squares)
        self.rows[at] += g
        self.moved[at] += n


def _exponentials(z: np.ndarray) -> tuple[np.ndarray | np.float32, np.ndarray]:
    """Puts the exponentials of scores in their place; the shift they are made with (one for all rows,
    or each row's largest score where the scores lie far apart), and their sums."""
    shift = z.max()
    if shift - z.min() > 60:  # the sum of a row could vanish
        shift = z.max(axis=1)
    z -= shift[:, None] if shift.ndim else shift
    np.exp(z, out=z)
    return shift, z @ np.ones(z.shape[1], z.dtype)


def _sums(at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct places, the sums of their rows and how many they have."""
    order = np.argsort(at, kind="stable")
    keys, new = at.take(order), np.ones(len(at), bool)
    np.not_equal(keys[1:], keys[:-1], out=new[1:])
    first = np.flatnonzero(new)
    # two numbers a step: a sum of complex numbers adds their parts
    sums = np.add.reduceat(rows.take(order, axis=0).view(np.complex64), first, axis=0).view(np.float32)
    return keys[first], sums, np.diff(first, append=len(at))


class Model:
    """Parameters of the log-bilinear model: contexts, targets, position weights, biases."""

    SHAPES = ((CLASSES + 1, DIM), (CLASSES, DIM), (CONTEXT, DIM), (CLASSES,))

    def __init__(self, flat: np.ndarray, noise: np.ndarray):
        self.parts, at = [], 0
        for shape in self.SHAPES:
            n = int(np.prod(shape))
            self.parts.append(flat[at:at + n].reshape(shape).astype(np.float32))
            at += n
        self.noise_up_to = np.cumsum(noise)
        self.noise_up_to /= self.noise_up_to[-1]
        self.log_noise = np.log(NOISE * noise).astype(np.float32)

    @classmethod
    def fresh(cls, noise: np.ndarray) -> Model:
        rng = np.random.default_rng(5)
        flat = np.concatenate([rng.normal(0, 0.1, (CLASSES + 1) * DIM), rng.normal(0, 0.1, CLASSES * DIM),
                               np.ones(CONTEXT * DIM), np.log(noise)])
        return cls(flat, noise)

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts]).astype(np.float64)

    def predict(self, contexts: np.ndarray) -> np.ndarray:
        r, _, c, _ = self.parts
        return sum(r[contexts[:, i]] * c[i] for i in range(CONTEXT))

    def log_probabilities(self, contexts: np.ndarray, at: np.ndarray | None = None, kind: np.ndarray | None = None) -> np.ndarray:
        """Normalised natural log-probabilities of all classes, a row a context, or only of class
        ``kind`` in the row ``at``."""
        z = self.predict(contexts) @ self.parts[1].T
        z += self.parts[3]
        logs = z.copy() if at is None else z[at, kind]
        shift, total = _exponentials(z)
        total = shift + np.log(total)
        return logs - (total[:, None] if at is None else total.take(at))

    def train(self, contexts: np.ndarray, target: np.ndarray, squares: list[np.ndarray], rate: float, rng) -> None:
        """One step of noise-contrastive estimation; the batch shares its noise classes."""
        r, t, c, b = self.parts
        near = [np.ascontiguousarray(contexts[:, i]) for i in range(CONTEXT)]
        wide = np.zeros((CLASSES + 1, DIM + 1), np.float32)  # a last 1 meets the biases
        wide[:, DIM], q = 1, 0
        for i in range(CONTEXT):
            wide[:, :DIM] = r * c[i]
            q += wide.take(near[i], axis=0)
            wide[:, DIM] = 0
        own = np.hstack([t, (b - self.log_noise)[:, None]])
        noise = self.noise_up_to.searchsorted(rng.random(NOISE), side="right")  # as rng.choice draws
        other = own[noise]
        own = own.take(target, axis=0)
        up = 1 / (1 + np.exp(np.clip(np.einsum("ij,ij->i", q, own), -30, 30)))
        down = q @ -other.T
        np.clip(down, -30, 30, out=down)
        np.exp(down, out=down)
        down += 1
        np.divide(-1, down, out=down)
        dq = down @ other[:, :DIM]
        of_noise = down.T @ q
        own *= up[:, None]
        dq += own[:, :DIM]
        grads = [np.zeros_like(p) for p in self.parts]
        for i in range(CONTEXT):
            keys, g, _ = _sums(near[i], dq)
            grads[0][keys] += g * c[i]
            grads[2][i] = np.einsum("ij,ij->j", g, r.take(keys, axis=0))
        keys, g, _ = _sums(target, q[:, :DIM] * up[:, None])
        grads[1][keys] = g
        np.add.at(grads[1], noise, of_noise[:, :DIM])
        grads[3] += np.bincount(target, weights=up, minlength=CLASSES).astype(np.float32)
        np.add.at(grads[3], noise, of_noise[:, DIM])
        for p, g, a in zip(self.parts, grads, squares):
            a += g * g
            p += rate * g / np.sqrt(a + 1e-8)


def unit_rows(words: pa.Array, code: np.ndarray, lengths: np.ndarray, units: Units) -> tuple[np.ndarray, np.ndarray]:
    """Contexts (the unit before comes last) and units of the tokens of some texts."""
    target, total = units.units_of(words).take(code), len(code)
    before = units.total  # stands for what lies before a text
    contexts = np.full((total, CONTEXT), before, units.kind)
    for i in range(1, CONTEXT + 1):
        contexts[i:, CONTEXT - i] = target[:-i]
    starts = np.cumsum(lengths) - lengths
    for i in range(CONTEXT):  # at place i of a text only i units lie before it
        at = starts + i
        at = at[at < total]
        keep = np.isin(at, np.append(starts[1:], total), invert=True) if i else np.ones(len(at), bool)
        contexts[at[keep], :CONTEXT - i] = before
    return contexts, target


def train_models(texts: DataFrame, units: Units, noise: np.ndarray) -> tuple[Model, Inner]:
    """The averaged models after ``PASSES`` passes over all of ``texts`` (column text)."""
    model, inner = Model.fresh(noise), Inner(units)
    for k in range(PASSES):
        flat, rate, rows = model.flat(), RATES[k], inner.rows if k else None

        def one_task(batches, flat=flat, rate=rate, rows=rows):
            own, seen = Model(flat, noise), 0
            within = Inner(units, None if rows is None else rows.copy())
            within.start_training()
            squares = [np.zeros_like(p) for p in own.parts]
            rng = np.random.default_rng(17)
            for batch in batches:
                for a, b in textkit.chunks(batch, "text"):
                    contexts, target = unit_rows(*tokens(batch.column("text").slice(a, b - a)), units)
                    order = rng.permutation(len(target))
                    kinds, kind = units.class_of_unit.take(contexts), units.class_of_unit.take(target)
                    for lo in range(0, len(order), BATCH):
                        at = order[lo:lo + BATCH]
                        own.train(kinds.take(at, axis=0), kind.take(at), squares, rate, rng)
                    within.train(contexts, target, order)
                    seen += len(order)
            if seen:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([-1], pa.int32()), pa.array([float(seen)]), pa.array([own.flat()], pa.list_(pa.float64()))],
                    ["row", "n", "p"])
                at = np.flatnonzero(within.moved)
                for lo in range(0, len(at), 4096):
                    mine = at[lo:lo + 4096]
                    flat_rows = pa.array(within.rows[mine].astype(np.float64).ravel())
                    edges = pa.array(np.arange(0, len(flat_rows) + 1, DIM + 1, dtype=np.int32))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(mine.astype(np.int32)), pa.array(within.moved[mine]),
                         pa.ListArray.from_arrays(edges, flat_rows)], ["row", "n", "p"])

        out = scratch.store(texts.mapInArrow(one_task, "row int, n double, p array<double>"), "lm_models")
        summed = (out.where("row < 0").select("n", F.posexplode("p").alias("at", "v"))
                  .groupBy("at").agg((F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("v")).collect())  # one row a parameter
        if summed:
            mean = np.zeros(len(flat))
            for row in summed:
                mean[row["at"]] = row["v"]
            model = Model(mean, noise)
        means = (out.where("row >= 0").groupBy("row")
                 .agg(*[(F.sum(F.col("p")[i] * F.col("n")) / F.sum("n")).cast("float").alias(f"v{i}") for i in range(DIM + 1)])
                 .toArrow())  # one row a unit: bounded by the head
        at = means.column("row").to_numpy()
        inner.rows[at] = np.stack([means.column(f"v{i}").to_numpy() for i in range(DIM + 1)], axis=1)
        scratch.discard(out)
    return model, inner


def score_rows(model: Model, inner: Inner, head: tuple[pa.Array, np.ndarray], texts: pa.Array) -> list[pa.Array]:
    """Per text: tokens, known tokens and base sum over the head, class and unit score, words of the tail and their counts."""
    units = inner.units
    words, code, lengths = tokens(texts)
    contexts, target = unit_rows(words, code, lengths, units)
    starts = np.cumsum(lengths) - lengths
    before, kind = units.class_of_unit.take(contexts), units.class_of_unit.take(target)
    packed = before[:, 0].astype(np.int32) * (CLASSES + 1) + before[:, 1]
    occurs = np.zeros((CLASSES + 1) ** 2, bool)
    occurs[packed] = True
    kinds, number = np.flatnonzero(occurs), np.cumsum(occurs, dtype=np.int32) - 1
    at = number[packed]
    order = np.argsort((at // TABLE).astype(np.uint16), kind="stable")
    edges = np.append(0, np.cumsum(np.bincount(at // TABLE)))
    log_p = np.empty(len(target))
    for i, lo in enumerate(range(0, len(kinds), TABLE)):
        part = kinds[lo:lo + TABLE]
        mine = order[edges[i]:edges[i + 1]]
        log_p[mine] = model.log_probabilities(np.stack([part // (CLASSES + 1), part % (CLASSES + 1)], axis=1), at[mine] - lo, kind[mine])
    for k, mine in inner.by_class(target, np.arange(len(target)), INNER_BATCH):
        log_p[mine] += inner.log_probabilities(contexts.take(mine, axis=0), k, target[mine] - units.start[k])
    # base and tail hold the count of every word: it stays for the words of a rest unit only
    log_p = log_p / np.log(10) - (units.share + units.head).take(target)
    place = _places(words, head[0], -1)
    text = np.repeat(np.arange(len(lengths)), lengths)
    base = np.bincount(text, np.append(head[1], 0.0)[place].take(code), len(lengths))
    rare = (place < 0).take(code)
    pair = np.sort(text[rare] * len(words) + code[rare])
    first = np.flatnonzero(np.append(True, pair[1:] != pair[:-1])) if len(pair) else np.empty(0, np.int64)
    offsets = pa.array(np.searchsorted(pair[first] // len(words), np.arange(len(lengths) + 1)), pa.int32())
    times = np.diff(np.append(first, len(pair)))
    return [pa.array(lengths), pa.array(lengths - np.bincount(text[rare], minlength=len(lengths))), pa.array(base),
            pa.array(np.add.reduceat(log_p, starts)),
            pa.ListArray.from_arrays(offsets, words.take(pa.array(pair[first] % len(words))).cast(pa.string())),
            pa.ListArray.from_arrays(offsets, pa.array(times, pa.int32()))]


def log_bilinear_scores(docs: DataFrame) -> DataFrame:
    """One row a row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score and score (log10)."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    training = base.where(~held_out("doc_id", FOLDS, HELD_OUT)).select("text")
    counts = scratch.store(training.mapInArrow(_partial_counts, "word string, c long")
                           .groupBy("word").agg(F.sum("c").alias("c")), "lm_counts")
    scratch.free_shuffles(docs.sparkSession)
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    top = [(r.word.encode(), r.c) for r in counts.orderBy(F.desc("c"), "word").limit(HEAD).collect()]
    shortlist = [w for w, _ in top[:SHORTLIST - 1] if w != END] + [END]
    own = dict(top)
    if own and END not in own:
        own[END] = counts.where(F.col("word") == END.decode()).first().c
    head = pa.array(list(own), pa.binary()).cast(pa.string()), np.log10(np.array(list(own.values()), np.float64) + ADD)
    rest = counts.where(~F.col("word").isin([w.decode() for w in shortlist]))
    by_suffix = rest.groupBy(F.right("word", F.lit(2)).alias("s")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v"))
    ends = by_suffix.orderBy(F.desc("c"), "s").limit(SUFFIXES).collect()
    suffixes = [r.s for r in ends]
    mass, kinds = np.zeros(CLASSES), np.zeros(CLASSES)
    mass[:len(shortlist)] = [own.get(w, 0) for w in shortlist]
    for i, r in enumerate(ends):
        mass[SHORTLIST + i], kinds[SHORTLIST + i] = r.c, r.v
    mass[-1], kinds[-1] = n - mass.sum(), v - sum(w in own for w in shortlist) - kinds.sum()
    noise = (mass + 1.0) / (mass + 1.0).sum()
    short = set(shortlist)
    own_words = [(w, c) for w, c in top if w not in short][:int(OWN * v ** 0.5)]
    units = Units(shortlist, suffixes, own_words, mass, kinds, [own.get(w, 0) for w in shortlist])
    model, inner = train_models(training, units, noise)
    params, vectors = model.flat(), inner.rows

    def scored(batches):
        net, within = Model(params, noise), Inner(units, vectors)
        for batch in batches:
            for a, b in textkit.chunks(batch, "text"):
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), *score_rows(net, within, head, batch.column("text").slice(a, b - a))],
                    ["doc_id", "n_tokens", "n_known", "base", "score", "words", "times"])

    seen = scratch.store(
        base.mapInArrow(scored, "doc_id long, n_tokens long, n_known long, base double, score double, "
                                "words array<string>, times array<int>")
        .withColumn("rid", F.monotonically_increasing_id()), "lm_scores")
    scratch.free_shuffles(docs.sparkSession)
    tail = (seen.where(F.size("words") > 0)
            .select("rid", F.explode(F.arrays_zip("words", "times")).alias("t"))
            .select("rid", F.col("t.words").alias("word"), F.col("t.times").alias("times"))
            .join(counts, "word", "left")
            .groupBy("rid").agg(F.sum(F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + ADD)).alias("tail"),
                                F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("tail_known")))
    per_token = float(np.log10(n + ADD * (v + 1)))
    tail_sum = F.coalesce("tail", F.lit(0.0))
    return seen.drop("words", "times").join(tail, "rid", "left").select(
        "doc_id", held_out("doc_id", FOLDS, HELD_OUT).alias("held_out"), "n_tokens",
        (F.col("n_known") + F.coalesce("tail_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + tail_sum - F.col("n_tokens") * per_token).alias("base_score"),
        (F.col("score") + F.col("base") + tail_sum).alias("score"))


def op10_logbilinear(spark, sf_dir):
    """Op 10 over the whole ``documents`` table."""
    return log_bilinear_scores(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
