"""Language identification by averaged hashed subword embeddings with a linear softmax.

Features of a text are its byte n-grams of two to four bytes (A-Z lower-cased,
digits as 0, white space as one boundary mark), hashed into ``BUCKETS`` rows of an
embedding table.  Their mean goes through a linear layer and a softmax.  Both
layers are trained in numpy by stochastic gradient descent on windows, cut by the
executors, of a bounded sample (``sample`` rows, shared out evenly over the
languages) of the labelled rows.  A second sample of that size, of rows never
trained on, calibrates on whole texts: a temperature for the scores, and a threshold
below which a prediction is rejected, the ``alpha`` quantile of the scores of right
predictions.

Applying the model is linear: both layers fold into one table of logits per bucket,
of fixed size, that is broadcast; whole texts are scored in one narrow pass.

Defined cases: null text and texts without a letter are ``und`` with score 0 and
rejected.  Rows with a null id or language are never learned from; without any
labelled row all predictions are ``und``.  An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import arrow_map, flat_bytes, packed, release, row_slices, session_of, slices

BUCKETS, DIM, ORDERS = 1 << 14, 16, (2, 3, 4)
SAMPLE, WINDOWS, ALPHA, UNKNOWN = 4000, 12, 0.001, "und"
#: Bytes whose features are held at once.
CHUNK = 1 << 19

_MAP = np.arange(256, dtype=np.uint64)
_MAP[65:91] += 32
_MAP[48:58] = 48
_MAP[[*range(9, 14), 32]] = 32


def features(data: np.ndarray) -> list[np.ndarray]:
    """Bucket of the n-gram that starts at each byte, one array for each order."""
    b, out = _MAP[data], []
    for n in ORDERS:
        if len(b) < n:
            out.append(np.zeros(0, np.int64))
            continue
        h = np.full(len(b) - n + 1, n, np.uint64)
        for j in range(n):
            h = (h ^ b[j : len(b) - n + 1 + j]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        out.append((h >> np.uint64(40)).astype(np.int64) % BUCKETS)
    return out


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # (BUCKETS, languages): both layers in one
    bias: np.ndarray
    temperature: float
    threshold: float
    coverage: float = 1.0  # share of the calibration rows that the threshold accepts

    def logits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Per text the mean logits of its features; texts lie one after another in ``data``.  At most CHUNK bytes are taken at once."""
        sums, n = np.zeros((len(offsets) - 1, len(self.languages))), np.zeros(len(offsets) - 1)
        for lo in range(0, len(data), CHUNK):
            hi = min(lo + CHUNK, len(data))
            a, b = int(np.searchsorted(offsets, lo, "right")) - 1, int(np.searchsorted(offsets, hi, "left"))
            for order, f in zip(ORDERS, features(data[lo : hi + max(ORDERS) - 1]), strict=True):
                start = np.clip(offsets[a:b] - lo, 0, min(hi - lo, len(f)))
                stop = np.clip(np.minimum(offsets[a + 1 : b + 1] - order + 1, hi) - lo, start, len(f))  # no n-gram runs into the next text
                n[a:b] += stop - start
                for k in range(len(self.languages)):
                    total = np.concatenate([[0.0], np.cumsum(self.table[:, k][f])])
                    sums[a:b, k] += total[stop] - total[start]
        return sums / np.maximum(n, 1)[:, None] + self.bias

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        z = logits / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def windows(text: str, seed: int, number: int = WINDOWS) -> list[bytes]:
    """Random pieces of 40 to 400 bytes of a text, which are all that training sees of it."""
    raw, rng = text.encode(), np.random.default_rng(seed)
    sizes = rng.integers(40, 400, number)
    starts = rng.integers(0, np.maximum(1, len(raw) - sizes))
    return [raw[a : a + n] for a, n in zip(starts.tolist(), sizes.tolist(), strict=True)]


def train(pieces: list[list[bytes]], labels: list[str], seed: int = 7, epochs: int = 6) -> Model | None:
    """The model of texts given by their windows, half of which an epoch takes; neither temperature nor threshold is set."""
    languages = sorted(set(labels))
    if not languages:
        return None
    rng = np.random.default_rng(seed)
    number = {x: i for i, x in enumerate(languages)}
    raw = [np.frombuffer(w, np.uint8) for own in pieces for w in own]
    target = np.array([number[x] for x, own in zip(labels, pieces, strict=True) for _ in own])
    table, weight, bias = rng.normal(0, 0.1, (BUCKETS, DIM)), rng.normal(0, 0.5, (DIM, len(languages))), np.zeros(len(languages))
    for epoch in range(epochs):
        rate = 4.0 * (1 - epoch / epochs)
        jobs = rng.permutation(len(raw))[: max(1, len(raw) // 2)]
        for at in range(0, len(jobs), 128):
            some = jobs[at : at + 128]
            x = np.zeros((len(some), BUCKETS))
            for r, i in enumerate(some):
                f = np.concatenate(features(raw[i]))
                if len(f):
                    np.add.at(x[r], f, 1 / len(f))
            hidden = x @ table
            z = hidden @ weight + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(some)), target[some]] -= 1
            p /= len(some)
            back = p @ weight.T
            weight -= rate * (hidden.T @ p) * 4
            bias -= rate * p.sum(axis=0) * 0.1
            table -= rate * 60 * (x.T @ back)
    return Model(languages, table @ weight, bias, 1.0, 0.0)


def calibrate(model: Model, logits: np.ndarray, right: np.ndarray, alpha: float) -> None:
    """Set the temperature of least log loss, and the threshold that all but a share ``alpha`` of the right predictions reach."""
    if not len(right):
        return

    def loss(t):
        z = logits / t
        z = z - z.max(axis=1, keepdims=True)
        return float((np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(right)), right]).mean())

    model.temperature = min((0.05 * 1.25**k for k in range(24)), key=loss)
    p = model.probabilities(logits)
    best = p.max(axis=1)
    scores = np.sort(best[p.argmax(axis=1) == right])  # a wrong label says nothing about confidence
    model.threshold = float(scores[int(alpha * len(scores))]) if len(scores) else 0.0
    model.coverage = float((best >= model.threshold).mean())


def fit(docs: DataFrame, learn_from, sample: int = SAMPLE, alpha: float = ALPHA, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model | None:
    """Train on about ``sample`` rows for which ``learn_from`` holds, calibrate on as many others; ``2 * sample`` of either at most.

    A tenth of the rows, by a hash of the id, is for calibration only.  The driver
    gets windows of the training texts, and logits of the whole calibration texts.
    """
    labelled = docs.filter(learn_from).filter(F.col(doc_id).isNotNull() & F.col(text).isNotNull() & F.col(lang).isNotNull())
    counts = {r[0]: r[1] for r in labelled.groupBy(F.col(lang)).count().collect()}  # a row a language
    if not counts:
        return None
    draw = F.pmod(F.xxhash64(F.col(doc_id), F.lit(11)), F.lit(1 << 30))
    held = F.pmod(F.xxhash64(F.col(doc_id), F.lit(13)), F.lit(10)) == 0

    def sampled(rows, part):
        rate = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, sample / len(counts) / (part * n)))])
        own = rows.select(draw.alias("draw"), F.col(doc_id).cast("string").alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
        return own.filter(F.col("draw") < rate[F.col("lang")] * float(1 << 30))

    def cut(it):
        for batch in it:
            for some in slices(batch, 2):
                got = [windows(t, d) for d, t in zip(some.column(0).to_pylist(), some.column(2).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), some.column(3), pa.array(got, pa.list_(pa.binary()))], ["draw", "id", "lang", "pieces"])

    some = arrow_map(sampled(labelled.filter(~held), 0.9), cut, "draw long, id string, lang string, pieces array<binary>")
    rows = some.orderBy("draw", "id", "pieces").limit(2 * sample).collect()
    model = train([list(map(bytes, r.pieces)) for r in rows], [r.lang for r in rows])
    del rows
    release()  # the driver keeps running
    if model is None:
        return None
    shared, number = session_of(docs).sparkContext.broadcast(model), {x: i for i, x in enumerate(model.languages)}

    def score(it):
        for batch in it:
            for some in slices(batch, 2):
                got = shared.value.logits(*flat_bytes(some.column(2)))
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), some.column(3), pa.array(got.tolist(), pa.list_(pa.float64()))], ["draw", "id", "lang", "logits"])

    some = arrow_map(sampled(labelled.filter(held), 0.1), score, "draw long, id string, lang string, logits array<double>")
    rows = [r for r in some.orderBy("draw", "id", "lang", "logits").limit(2 * sample).collect() if r.lang in number]
    calibrate(model, np.array([r.logits for r in rows]).reshape(len(rows), -1), np.array([number[r.lang] for r in rows], np.int64), alpha)
    del rows
    release()
    return model


def predict(docs: DataFrame, model: Model | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: row (all columns of ``docs``), lang_pred, score, accepted."""
    from pyspark.sql import types as T

    shared = session_of(docs).sparkContext.broadcast(model)
    rows, place = packed(docs, text)
    schema = T.StructType([rows.schema["row"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("accepted", T.BooleanType())])

    def run(it):
        import regex

        own, letter = shared.value, regex.compile(r"\p{L}")
        for batch in it:
            for some in row_slices(batch, place):
                texts = some.column(0).field(place)
                has = np.array([own is not None and t is not None and bool(letter.search(t)) for t in texts.to_pylist()], bool)
                lang, score = np.full(len(has), UNKNOWN, object), np.zeros(len(has))
                if has.any():
                    p = own.probabilities(own.logits(*flat_bytes(texts)))
                    best = p.argmax(axis=1)
                    lang[has] = np.array(own.languages, object)[best[has]]
                    score[has] = p[np.arange(len(p)), best][has]
                accepted = has & (score >= (own.threshold if own else 0))
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(lang, pa.string()), pa.array(score), pa.array(accepted)], ["row", "lang_pred", "score", "accepted"])

    return arrow_map(rows, run, schema)


def held_out(doc_id: str = "doc_id"):
    """Whether crc32 of the id as text leaves 1 when divided by 3; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))
