"""Language-model scores by a hidden Markov model (operator 3).

States emit symbols: the most frequent words each have one, all other words share a symbol with the words of the same
ending, and the symbol's probability is divided among them by their counts, one share being left to words not seen. So the
model has a bounded number of parameters and still gives every word a probability from counts of the whole corpus.
Baum-Welch starts from a bounded sample and then runs over all training documents: tasks gather expected counts, which are
summed across partitions. Texts are scored whole by the scaled forward recursion, many texts at a time.

Counts of the most frequent words are sent to all tasks, a table of bounded size; those of all other words are joined by
word, so no document and no word needs more than a share of a task.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.lineage import bounded_batches, written
from cadenza.llm.totals import slices, summed

STATES = 8
#: Words with a symbol of their own, classes of the other words, and words whose counts all tasks hold.
OWN, CLASSES, HELD = 1 << 14, 1 << 10, 1 << 18
#: Longer words are joined, whatever their count, so that the table of held words has a bounded size.
HELD_BYTES = 64
SAMPLE_DOCS, SAMPLE_ROUNDS = 400, 15
#: Rounds over all training texts end once the likelihood of a token grows by less than this part of it, or after so many.
SETTLED, MOST_ROUNDS = 1e-3, 3
#: Steps of time whose states are held at once.
WINDOW = 8192
LONG = 2048
END = b""
_FLUSH = 300_000


def tokens(text: str) -> list[bytes]:
    """Words in ASCII lower case, between ASCII white space, and the end."""
    words = text.encode().lower().split()
    words.append(END)
    return words


def word_class(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % CLASSES


def is_held_out(id_: Column) -> Column:
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def count_words(texts: DataFrame) -> DataFrame:
    """(word, n) of all tokens of ``texts`` (text)."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter = Counter()
        for pdf in batches:
            for text in pdf["text"]:
                held.update(tokens(text))
                if len(held) > _FLUSH:
                    yield pd.DataFrame({"word": list(held.keys()), "n": list(held.values())})
                    held = Counter()
        yield pd.DataFrame({"word": list(held.keys()), "n": list(held.values())})

    return texts.mapInPandas(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """Held words, most frequent first; the first OWN of them have a symbol of their own."""

    index: dict[bytes, int]
    log_count: np.ndarray  # log10(c + 1)
    symbol: np.ndarray
    share: np.ndarray  # log10 of the word's part of its symbol's probability
    class_total: np.ndarray
    base: np.ndarray  # probability of each symbol in the base model
    n_tokens: int
    n_words: int

    @property
    def own(self) -> int:
        return min(OWN, len(self.index))

    def of(self, words: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
        """Places of held words, -1 for others, and these others."""
        get = self.index.get
        at = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        return at, [words[k] for k in np.flatnonzero(at < 0).tolist()]

    def symbols(self, at: np.ndarray, others: list[bytes]) -> np.ndarray:
        out = self.symbol[at]
        out[at < 0] = self.own + np.fromiter((word_class(w) for w in others), np.int64, len(others))
        return out


def vocabulary_of(counts: DataFrame) -> Vocabulary:
    totals = counts.agg(F.sum("n"), F.count("*")).first()
    n_tokens, n_words = int(totals[0] or 0), int(totals[1])
    # the most frequent words by steps of frequency: a sort and limit would send as many words from every partition
    step = F.floor(F.log2(F.col("n").cast("double")) * 16)
    short = counts.filter(F.octet_length("word") <= HELD_BYTES).withColumn("step", step)
    least, room = None, HELD
    for r in sorted(short.groupBy("step").count().collect(), key=lambda r: -r["step"]):  # under a thousand steps
        room -= r["count"]
        if room < 0:
            break
        least = r["step"]
    held = [] if least is None else short.filter(F.col("step") >= least).collect()
    held = sorted(held, key=lambda r: (-r["n"], bytes(r["word"])))
    words = [bytes(r["word"]) for r in held]
    count = np.array([r["n"] for r in held], np.float64)
    own = min(OWN, len(words))
    classes = np.array([word_class(w) for w in words], np.int64)

    def by_class(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(CLASSES)
        for pdf in batches:
            at = np.fromiter((word_class(w) for w in pdf["word"]), np.int64, len(pdf))
            total += np.bincount(at, weights=pdf["n"].to_numpy() + 1, minlength=CLASSES)
        yield slices(total)

    every = summed(counts.mapInPandas(by_class, "slice long, sums binary"), CLASSES)
    class_total = every - np.bincount(classes[:own], weights=count[:own] + 1, minlength=CLASSES) + 1  # one share for words not seen
    symbol = np.where(np.arange(len(words)) < own, np.arange(len(words)), own + classes)
    share = np.where(np.arange(len(words)) < own, 0.0, np.log10(count + 1) - np.log10(class_total)[classes])
    base = np.concatenate([count[:own] + 1, class_total])
    return Vocabulary({w: k for k, w in enumerate(words)}, np.log10(count + 1), symbol, share, class_total, base / base.sum(), n_tokens, n_words)


@dataclass
class Markov:
    start: np.ndarray
    move: np.ndarray  # from state to state
    emit: np.ndarray  # symbols x states


class TimeMajor:
    """Sequences sorted by length, the longest first; their symbols one time step after the other."""

    def __init__(self, sequences: list[np.ndarray]):
        lengths = np.fromiter(map(len, sequences), np.int64, len(sequences))
        self.order = np.argsort(-lengths, kind="stable")
        flat = np.concatenate([sequences[k] for k in self.order.tolist()])
        lengths = lengths[self.order]
        starts = np.cumsum(lengths) - lengths
        time = np.arange(len(flat)) - np.repeat(starts, lengths)
        self.obs = flat[np.argsort(time, kind="stable")]
        self.active = len(lengths) - np.searchsorted(lengths[::-1], np.arange(lengths[0] if len(lengths) else 0), side="right")
        self.begin = np.cumsum(self.active) - self.active

    def steps(self) -> Iterator[tuple[int, int]]:
        return zip(self.begin.tolist(), self.active.tolist(), strict=True)


def _forward_through(model: Markov, inside: list[tuple[int, int]], a: np.ndarray | None, state: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Forward states and scales of consecutive steps into ``state``, which holds their emissions, and ``scale``; the last state.

    ``a`` is the state of the step before them, None at the start of the sequences.
    """
    base, ones = inside[0][0], np.ones(STATES)
    for begin, n in inside:
        here = slice(begin - base, begin - base + n)
        now, s = state[here], scale[here]
        now *= model.start if a is None else a[:n] @ model.move
        np.matmul(now, ones, out=s)
        now /= s[:, None]
        a = now
    return a


def forward(model: Markov, sequences: list[np.ndarray]) -> np.ndarray:
    """log10 likelihood of each sequence of symbols."""
    tm = TimeMajor(sequences)
    logs = np.zeros(len(sequences))
    steps, a = list(tm.steps()), None
    for first in range(0, len(steps), WINDOW):
        inside = steps[first : first + WINDOW]
        base, end = inside[0][0], sum(inside[-1])
        state, scale = model.emit[tm.obs[base:end]], np.empty(end - base)
        a = _forward_through(model, inside, a, state, scale)
        row = np.arange(end - base) - np.repeat([begin - base for begin, _ in inside], [n for _, n in inside])
        logs += np.bincount(row, weights=np.log10(scale), minlength=len(logs))
    out = np.empty(len(sequences))
    out[tm.order] = logs
    return out


def expected_counts(model: Markov, sequences: list[np.ndarray], window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Baum-Welch: expected starts, moves and emissions (symbols x states) of whole sequences of symbols, and their log10 likelihood.

    Time runs in windows. The first pass keeps the forward state at each window's start only; going back, a window's forward
    states are made anew from there and the backward state is carried into it from the window after it. So the counts are
    those of whole sequences, and memory is bounded by a window of them.
    """
    tm = TimeMajor(sequences)
    steps = list(tm.steps())
    starts = list(range(0, len(steps), window))

    def bounds(first: int) -> tuple[int, int, list[tuple[int, int]]]:
        inside = steps[first : first + window]
        return inside[0][0], sum(inside[-1]), inside

    entering: list[np.ndarray | None] = [None]
    for first in starts[:-1]:
        base, end, inside = bounds(first)
        entering.append(_forward_through(model, inside, entering[-1], model.emit[tm.obs[base:end]], np.empty(end - base)).copy())
    moves, first_state, likelihood = np.zeros((STATES, STATES)), np.zeros(STATES), 0.0
    emitted = np.zeros((len(model.emit), STATES))
    after = np.empty((0, STATES))  # emission times backward state over scale, of the step after a window
    back = np.ascontiguousarray(model.move.T)
    for first, a in zip(reversed(starts), reversed(entering), strict=True) if steps else ():
        base, end, inside = bounds(first)
        emission = model.emit[tm.obs[base:end]]
        alpha, scale, beta = emission.copy(), np.empty(end - base), np.ones((end - base, STATES))
        _forward_through(model, inside, a, alpha, scale)
        likelihood += float(np.log10(scale).sum())
        emission /= scale[:, None]
        begin, n = inside[-1]
        last = alpha[begin - base :]
        moves += last[: len(after)].T @ after
        for begin, n in reversed(inside):
            here = slice(begin - base, begin - base + n)
            if len(after):
                np.matmul(after, back, out=beta[here][: len(after)])
            after = emission[here]
            after *= beta[here]  # what a step before it needs, kept where its emissions were
        after = after.copy()
        lengths = np.fromiter((n for _, n in inside), np.int64, len(inside))
        # the place of each state before one of this window: as far into the step before as it is into its own
        follows = np.arange(lengths[0], end - base) - np.repeat(lengths[:-1], lengths[1:])
        moves += alpha[follows].T @ emission[lengths[0] :]
        alpha *= beta
        seen = tm.obs[base:end]
        for s in range(STATES):
            emitted[:, s] += np.bincount(seen, weights=alpha[:, s], minlength=len(model.emit))
        if not first:
            first_state = alpha[: lengths[0]].sum(axis=0)
    return first_state, moves * model.move, emitted, likelihood


def refit(first: np.ndarray, moves: np.ndarray, emitted: np.ndarray, base: np.ndarray) -> Markov:
    """Probabilities from expected counts; every state keeps a small part of the base model."""
    emit = emitted + base[:, None] * (10 + 0.01 * emitted.sum(axis=0))
    move = moves + 1 + 9 * np.eye(STATES)
    return Markov((first + 1) / (first + 1).sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def _blocks(batches: Iterator[list], most: int = 500_000) -> Iterator[list]:
    """The sequences of all batches in blocks of about ``most`` symbols; long ones are pooled, as they take many short steps of time."""
    pools: list[list] = [[], []]
    sizes = [0, 0]
    for batch in batches:
        for s in batch:
            k = len(s) > LONG
            pools[k].append(s)
            sizes[k] += len(s)
            if sizes[k] >= most << k:
                yield pools[k]
                pools[k], sizes[k] = [], 0
    yield from filter(None, pools)


def train(texts: DataFrame, vocabulary: Vocabulary) -> Markov:
    """A model of ``texts`` (id, text): a start from about SAMPLE_DOCS of them, whole, then rounds over all until they settle."""
    spark = texts.sparkSession
    size = len(vocabulary.base)
    sent = spark.sparkContext.broadcast(vocabulary)  # at most HELD words of HELD_BYTES

    def symbols(text: str) -> np.ndarray:
        return sent.value.symbols(*sent.value.of(tokens(text)))

    share = min(1.0, SAMPLE_DOCS / max(texts.count(), 1))
    sample = texts.filter(F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30)) < int(share * (1 << 30))).limit(4 * SAMPLE_DOCS).select("text")

    def drawn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"symbols": [symbols(t).astype("<i4").tobytes() for t in pdf["text"]]})

    whole = sorted(bytes(r["symbols"]) for r in sample.mapInPandas(drawn, "symbols binary").collect())
    rng = np.random.default_rng(11)
    emitted = vocabulary.base[:, None] * np.exp(rng.normal(0, 0.5, (size, STATES)))
    model = refit(np.zeros(STATES), np.zeros((STATES, STATES)), emitted * 1e4, vocabulary.base)
    local = [np.frombuffer(s, "<i4") for s in whole]
    for _ in range(SAMPLE_ROUNDS if local else 0):
        model = refit(*expected_counts(model, local)[:3], vocabulary.base)

    counts = STATES + STATES * STATES + size * STATES

    def gather(now) -> DataFrame:  # noqa: ANN001
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros(counts + 1)
            for part in _blocks([symbols(t) for t in pdf["text"]] for pdf in batches):
                first, moves, emitted, likelihood = expected_counts(now.value, part)
                total += np.concatenate([first, moves.ravel(), emitted.ravel(), [likelihood]])
            yield slices(total)

        return texts.select("text").mapInPandas(run, "slice long, sums binary")

    before = -np.inf
    for _ in range(MOST_ROUNDS):
        total = summed(gather(spark.sparkContext.broadcast(model)), counts + 1)
        first, moves, emitted, likelihood = np.split(total, [STATES, STATES + STATES * STATES, counts])
        model = refit(first, moves.reshape(STATES, STATES), emitted.reshape(size, STATES), vocabulary.base)
        if likelihood[0] - before < SETTLED * abs(likelihood[0]):
            break
        before = likelihood[0]
    return model


def score(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, held_out, n_tokens, n_known, train_tokens, base_score and score for every row of ``docs``.

    The model and all counts come from the rows that are not held out, whatever their number; scores are of whole texts.
    A null or empty text is the end token alone. Rows may repeat; those with a null id are never held out. Other columns
    are not read. Without training rows all words are unknown and both models give each word the same probability.
    """
    bounded_batches(docs.sparkSession)
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    training = rows.filter(~is_held_out(F.col("id")))
    counts = written(count_words(training.select("text")))
    vocabulary = vocabulary_of(counts)
    model = train(training, vocabulary)
    sent, learnt = spark.sparkContext.broadcast(vocabulary), spark.sparkContext.broadcast(model)
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v, m = sent.value, learnt.value
        log_class = np.log10(v.class_total)
        texts = ([_Whole(v, i, t, log_class) for i, t in zip(pdf["id"].tolist(), pdf["text"].tolist(), strict=True)] for pdf in batches)
        for part in _blocks(texts):
            likelihood = forward(m, [d.symbols for d in part])
            yield pd.DataFrame(
                {
                    "id": [d.id for d in part],
                    "n_tokens": [len(d) for d in part],
                    "held": [d.held for d in part],
                    "base": [d.base for d in part],
                    "score": likelihood + np.array([d.share for d in part]),
                    "words": [list(d.others) for d in part],
                    "times": [list(d.others.values()) for d in part],
                }
            )

    schema = f"id {kind}, n_tokens long, held long, base double, score double, words array<binary>, times array<long>"
    scored = written(rows.mapInPandas(run, schema).withColumn("row", F.monotonically_increasing_id()))
    other = scored.select("row", F.explode(F.arrays_zip("words", "times")).alias("w")).select("row", F.col("w.words").alias("word"), F.col("w.times").alias("times"))
    known = other.join(counts, "word").select("row", "times", (F.col("times") * F.log10(F.col("n") + 1)).alias("part"))
    found = known.groupBy("row").agg(F.sum("times").alias("known"), F.sum("part").alias("part"))
    whole = scored.drop("words", "times").join(found, "row", "left")
    denominator = float(np.log10(vocabulary.n_tokens + vocabulary.n_words + 1))
    part = F.coalesce("part", F.lit(0.0))
    return whole.select(
        F.col("id").alias(id_col),
        is_held_out(F.col("id")).alias("held_out"),
        "n_tokens",
        (F.col("held") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(vocabulary.n_tokens).cast("long").alias("train_tokens"),
        (F.col("base") + part - F.col("n_tokens") * denominator).alias("base_score"),
        (F.col("score") + part).alias("score"),
    )


class _Whole:
    """A whole text as symbols, and what its held words add; its other words are joined with their counts later."""

    def __init__(self, v: Vocabulary, id_, text: str, log_class: np.ndarray):  # noqa: ANN001
        self.id = id_
        words = tokens(text)
        at, others = v.of(words)
        self.symbols = v.symbols(at, others)
        known = at[at >= 0]
        self.held = len(known)
        self.base = float(v.log_count[known].sum())
        self.share = float(v.share[known].sum() - log_class[self.symbols[at < 0] - v.own].sum())
        self.others = Counter(others)

    def __len__(self) -> int:
        return len(self.symbols)
