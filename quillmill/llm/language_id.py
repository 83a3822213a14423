"""Language identification by averaged hashed subword embeddings and a linear softmax.

A text's features are its byte 2-, 3- and 4-grams (A-Z lower-cased, white space collapsed), hashed to ``BUCKETS``
embeddings; the logits are a linear map of their average. Embeddings and map are trained by stochastic gradient descent
in numpy, on windows spread over the texts of a bounded sample: about ``SAMPLE`` rows of each label and ``SAMPLE_ALL`` in all (but at
least some of each label, however many there are), chosen by a hash of doc_id. A fifth of the sample is held back to fit the softmax's temperature and the
bounds of rejection.

A softmax is as sure of a text in a language that it never learned. A text is therefore also rejected for its share of letter
n-grams that no training text has (in a table of their own): above ``SLACK`` times what nearly all held-back texts stay under,
and ``DEVIATIONS`` deviations of a text of its length, so that short clean texts stay.

Whole texts are predicted, a megabyte at a time. A text that is null or has no letter is ``und`` with score 0 and is
rejected; so is every text if no labelled row exists. Rows with equal or null doc_id each give their own row; a null doc_id is never learned from. An empty
table gives an empty result. Columns besides ``doc_id``, ``text`` and, to learn, ``lang`` are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS_LOG2, DIM, ORDERS = 16, 12, (2, 3, 4)
#: Rows of a language in the sample and of all languages (expected; twice as many at most), windows of a row, characters of a window.
SAMPLE, SAMPLE_ALL, SAMPLE_LEAST, WINDOWS, WINDOW = 1_200, 40_000, 20, 4, 250
#: Labels whose counts are sent to every executor, a few MB at most.
FEW_LABELS = 100_000
EPOCHS, RATE, STEP = 3, 0.5, 1 << 20
#: For rejection: buckets of n-grams seen, quantiles of held-back texts, least share, slack, deviations; a new pair of letters makes NINE new n-grams.
SEEN_LOG2, NEARLY_ALL, FLOOR, SLACK, DEVIATIONS, NINE = 20, 0.99, 0.02, 2.0, 3.0, sum(ORDERS)
_LETTERS = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def _grams(text: str, log2: int = BUCKETS_LOG2, table: bytes | None = None) -> Iterator[np.ndarray]:
    raw = np.frombuffer(b" " + b" ".join(text.encode().lower().translate(table).split()) + b" ", np.uint8)
    for k in range(0, len(raw), STEP):
        x = raw[k : k + STEP + ORDERS[-1] - 1].astype(np.uint32)
        h = x
        for n in range(2, ORDERS[-1] + 1):
            h = h[:-1] * np.uint32(0x01000193) + x[n - 1 :]
            own = h[: max(0, min(STEP, len(raw) - k - n + 1))]
            yield ((own ^ own >> np.uint32(15)) * np.uint32(0x85EBCA6B + 2 * n)) >> np.uint32(32 - log2)


@dataclass
class Model:
    languages: list[str]
    embeddings: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    reject_below: float = 0.0
    seen: np.ndarray | None = None
    usual: float = 1.0

    def __post_init__(self):
        self.direct = len(self.languages) <= DIM  # then one look-up gives the logits themselves
        self.table = self.embeddings @ self.weights if self.direct else self.embeddings

    def logits(self, text: str) -> np.ndarray:
        total, n = np.zeros(self.table.shape[1]), 0
        for grams in _grams(text):
            total += self.table.take(grams, axis=0).sum(axis=0)
            n += len(grams)
        mean = total / max(1, n)
        return (mean if self.direct else mean @ self.weights) + self.bias

    def unseen(self, text: str) -> tuple[float, int]:
        """The share of the letter n-grams that no training text has, and their number."""
        new = n = 0
        for grams in _grams(text, SEEN_LOG2, _LETTERS):
            new += len(grams) - int(np.count_nonzero(self.seen[grams]))
            n += len(grams)
        return new / max(1, n), n

    def rejects(self, text: str | None, language: str, score: float) -> bool:
        if language == "und" or score < self.reject_below:
            return True
        if self.usual >= 1:
            return False
        share, n = self.unseen(text)
        return share > self.usual + DEVIATIONS * (self.usual * (1 - self.usual) * NINE / max(1, n)) ** 0.5

    def predict(self, text: str | None) -> tuple[str, float]:
        if text is None or not self.languages or not any(map(str.isalpha, text)):
            return "und", 0.0
        p = _softmax(self.logits(text) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max())
    return e / e.sum()


def train(rows: list[tuple[str, list[str], bool]], seed: int = 5) -> Model:
    """A model of rows (language, windows of a text, whether the row is held back to calibrate)."""
    languages = sorted({r[0] for r in rows})
    rng = np.random.default_rng(seed)
    e = rng.uniform(-1 / DIM, 1 / DIM, (1 << BUCKETS_LOG2, DIM)).astype(np.float32)
    w = np.zeros((DIM, len(languages)), np.float32)
    b = np.zeros(len(languages), np.float32)
    seen, examples = np.zeros(1 << SEEN_LOG2, bool), []
    for language, windows, held in rows:
        for text in () if held else windows:
            for grams in _grams(text, SEEN_LOG2, _LETTERS):
                seen[grams] = True
            if len(grams := np.concatenate(list(_grams(text)) or [np.zeros(0, np.uint32)])):
                own, n = np.unique(grams, return_counts=True)
                examples.append((languages.index(language), own, (n / n.sum()).astype(np.float32)))
    steps, total = 0, max(1, EPOCHS * len(examples))
    for _ in range(EPOCHS):
        for k in rng.permutation(len(examples)):
            y, own, share = examples[k]
            rate = RATE * (1 - steps / total)
            steps += 1
            hidden = share @ e[own]
            error = _softmax(hidden @ w + b)
            error[y] -= 1
            back = w @ error
            w -= rate * np.outer(hidden, error)
            b -= rate * 0.1 * error
            e[own] -= rate * np.outer(share, back) * len(own) ** 0.5
    model = Model(languages, e, w, b, seen=seen)
    held = [(languages.index(r[0]), model.logits(" ".join(r[1]))) for r in rows if r[2] and any(map(str.isalpha, "".join(r[1])))]
    if held:
        loss = {t: -sum(np.log(max(_softmax(x / t)[y], 1e-12)) for y, x in held) for t in np.geomspace(0.1, 10, 41)}
        model.temperature = float(min(loss, key=loss.get))
    if len(held) >= LEAST_HELD:
        right = [_softmax(x / model.temperature)[y] for y, x in held if x.argmax() == y]
        model.reject_below = 0.5 * float(np.quantile(right, 1 - NEARLY_ALL)) if right else 0.0
        if examples:
            new = [model.unseen(" ".join(r[1]))[0] for r in rows if r[2] and any(map(str.isalpha, "".join(r[1])))]
            model.usual = SLACK * max(FLOOR, float(np.quantile(new, NEARLY_ALL)))
    return model


#: Of each label's rows, in an order by a hash of their own, every so many are held back to calibrate: the second, and so on. A single row trains.
HOLD_BACK = 5
#: Rows held back from which bounds of rejection are taken; of fewer a quantile says nothing, and no text is rejected.
LEAST_HELD = 20


def fold(mod: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % mod


def sample(docs: DataFrame, learn: Column) -> list[tuple[str, list[str], bool]]:
    """The rows that ``train`` takes: a bounded sample of labelled rows, and of each a bounded number of characters."""
    known = docs.filter(learn & F.col("lang").isNotNull() & (F.length("text") > 0))
    counts = known.groupBy("lang").agg(F.count("*").alias("of_lang"))
    languages = counts.count()
    if not languages:
        return []
    each = min(SAMPLE, max(SAMPLE_LEAST, SAMPLE_ALL // languages))
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) / 1e6
    start = lambda k: (F.length("text") - WINDOW) * k / max(1, WINDOWS - 1) + 1
    windows = F.array(*[F.substring("text", F.greatest(F.lit(1), start(k).cast("int")), F.lit(WINDOW)) for k in range(WINDOWS)])
    drawn = known.join(F.broadcast(counts) if languages <= FEW_LABELS else counts, "lang").withColumn("draw", draw).filter(F.col("draw") * F.col("of_lang") < F.lit(float(each)))
    rows = drawn.select("lang", windows.alias("windows"), F.xxhash64("doc_id", F.lit(HOLD_BACK)).alias("split"), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * each * languages)
    of: dict[str, list] = {}
    for r in sorted(rows.collect(), key=lambda r: (r["split"], r["doc_id"], sorted(set(r["windows"])))):
        of.setdefault(r["lang"], []).append(sorted(set(r["windows"])))
    return sorted((lang, own, k % HOLD_BACK == 1) for lang, all_ in of.items() for k, own in enumerate(all_))


def learn(docs: DataFrame, which: Column | None = None) -> Model:
    """A model of the labelled rows of ``docs`` for which ``which`` holds."""
    return train(sample(docs, F.lit(True) & F.col("doc_id").isNotNull() if which is None else which & F.col("doc_id").isNotNull()))


def predict(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``docs`` with lang_pred, score and rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))  # its size depends on constants only
    out = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").alias("_text")).schema
    names = [*keep, "lang_pred", "score", "rejected"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = pickle.loads(shared.value)
        for batch in batches:
            found = [m.predict(t.as_py()) for t in batch.column("_text")]
            score = np.array([x[1] for x in found], np.float64)
            rejected = pa.array([m.rejects(t.as_py(), *x) for t, x in zip(batch.column("_text"), found)], pa.bool_())
            columns = [batch.column(k) for k in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([x[0] for x in found], pa.string()), pa.array(score), rejected], names)

    for name, kind in (("lang_pred", "string"), ("score", "double"), ("rejected", "boolean")):
        out = out.add(name, kind)
    out.fields = [f for f in out.fields if f.name != "_text"]
    out.names = [f.name for f in out.fields]
    return docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").alias("_text")).mapInArrow(rows, out)


def query(docs: DataFrame) -> DataFrame:
    """Learn from the rows whose crc32 of doc_id modulo 4 isn't 2, and predict all."""
    held_out = F.coalesce(fold(4) == 2, F.lit(False))
    model = learn(docs, fold(4) != 2)
    return predict(docs.select("doc_id", "text", held_out.alias("held_out")), model, ["doc_id", "held_out"])
