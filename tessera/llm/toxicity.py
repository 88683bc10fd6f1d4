"""Toxicity by a subsequence string-kernel support vector machine with Nyström landmarks.

The kernel counts common subsequences of ``LENGTH`` letters, each weighed by
``DECAY`` to the power of the letters it spans in both strings, in units of a landmark's
kernel with itself; letters put between those of an insult only lower it, and
letters around it change nothing.
A sentence is the set of its tokens (words; runs of single letters as one), its
margin the largest of its tokens', and a text scores as its worst sentence.  A token
counts by the best of all its runs of ``WIDE`` letters, whatever its length.

Training (numpy, on the driver) uses a bounded sample of labelled rows, split in
sentences.  Sentences of clean texts are negative.  Which sentences of a toxic
text are meant is unknown, so they are found by alternation, as in multiple-instance
learning: first by the parts of tokens that toxic texts have and clean ones hardly,
then by the machine itself.  Landmarks are such parts and frequent clean tokens; the Nyström map
is the inverse root of their kernel matrix.  The margin goes through a logistic
curve fitted on texts.

A token is compared only with landmarks of whose letters it has at least ``SHARE``;
that is part of the kernel.  Tokens are scored once each and remembered in a bounded
cache.  Scoring is one narrow pass over whole texts.

Defined cases: null, empty and letterless texts have no token and score as the
emptiest clean text; without labels of both kinds every score is 0; unlabelled
rows and null ids are never learned from; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import arrow_map, session_of, slices

LENGTH, DECAY, SHARE, LANDMARKS, BENIGN = 4, 0.5, 0.75, 20, 4
SAMPLE, WIDE, PARTS = 3000, 24, range(4, 11)
#: Bounds of the clean tokens to train on: those nearest to a landmark, and others at random.
HARDEST, OTHERS = 6000, 3000
_SENTENCE = re.compile(r"[.!?\n]+(?:\s|$)|\n")
_SPACED = re.compile(r"(?<!\w)\w(?:[ .\-_*]\w){2,}(?!\w)")
_EDGE = re.compile(r"^\W+|\W+$")


def tokens(sentence: str) -> list[str]:
    """Lower-case tokens without punctuation at their ends; runs of single letters are joined to one more."""
    low = sentence.lower()
    out = low.split()
    if _SPACED.search(low):
        out += [re.sub(r"[ .\-_*]", "", m.group()) for m in _SPACED.finditer(low)]
    return out


def clean(token: str) -> str:
    return token if token.isalnum() else _EDGE.sub("", token)


def coded(words: list[str], width: int) -> np.ndarray:
    """(n, width) code points, 0 behind the end."""
    raw = "".join(w[:width].ljust(width, "\0") for w in words).encode("utf-32-le")
    return np.frombuffer(raw, "<u4").reshape(len(words), width)


def letters(code: np.ndarray) -> np.ndarray:
    """One bit for each letter that a token has, of 63 classes of code points."""
    bits = np.where(code > 0, np.uint64(1) << (code % 63).astype(np.uint64), np.uint64(0))
    return np.bitwise_or.reduce(bits, axis=1)


def kernel(code: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Unnormalised kernel of each row of ``code`` with the string ``other``: the recurrence of Lodhi et al., for all rows at once."""
    n, m, decay, square = code.shape[1], len(other), np.float32(DECAY), np.float32(DECAY * DECAY)
    code = np.ascontiguousarray(code.T)  # by place, so that every step works on whole rows
    same = [code == c for c in other]
    prefix = np.ones((m + 1, n + 1, code.shape[1]), np.float32)
    for _ in range(LENGTH - 1):
        nxt = np.zeros_like(prefix)
        for j in range(1, m + 1):
            hit = same[j - 1] * prefix[j - 1, :n] * square
            run = np.zeros(code.shape[1], np.float32)
            for i in range(1, n + 1):
                run *= decay
                run += hit[i - 1]
                nxt[j, i] = run
            nxt[j] += decay * nxt[j - 1]
        prefix = nxt
    return sum((same[j] * prefix[j, :n]).sum(axis=0) for j in range(m)).astype(np.float64) * DECAY * DECAY


def self_kernel(words: list[str]) -> np.ndarray:
    return np.array([kernel(coded([w], max(1, min(len(w), WIDE))), np.array([ord(c) for c in w[:WIDE]], np.uint32))[0] for w in words])


@dataclass
class Model:
    landmarks: list[str]
    weight: np.ndarray  # one a landmark: the Nyström map folded into the machine's weights
    bias: float
    slope: float
    shift: float
    most: int = 300_000
    new: dict = field(default_factory=dict)
    old: dict = field(default_factory=dict)

    def __post_init__(self):
        self.codes = [np.array([ord(c) for c in w[:WIDE]], np.uint32) for w in self.landmarks]
        self.norms = np.maximum(self_kernel(self.landmarks), 1e-12)
        self.bits = letters(coded(self.landmarks, WIDE)) if self.landmarks else np.zeros(0, np.uint64)
        count = np.bitwise_count(self.bits).astype(np.int64)
        self.need = np.maximum(np.ceil(SHARE * count).astype(np.int64), np.minimum(count, LENGTH))

    def features(self, words: list[str]) -> np.ndarray:
        """(n, landmarks) kernel values in units of each landmark's own; a token counts by the best of all its runs of WIDE letters."""
        out = np.zeros((len(words), len(self.landmarks)))
        size = np.array([len(w) for w in words])
        for low, high in ((LENGTH, 8), (9, 16), (17, WIDE)):
            mine = np.flatnonzero((size >= low) & (size <= high))
            for at in range(0, len(mine), 4096):
                some = mine[at : at + 4096]
                code = coded([words[i] for i in some], high)
                bits = letters(code)
                for k in range(len(self.landmarks)):
                    near = np.flatnonzero(np.bitwise_count(bits & self.bits[k]) >= self.need[k])
                    if len(near):
                        out[some[near], k] = kernel(code[near], self.codes[k]) / self.norms[k]
        for i in np.flatnonzero(size > WIDE):
            w, last = words[i], len(words[i]) - WIDE + 1
            for at in range(0, last, 4096):
                runs = {w[j : j + WIDE] for j in range(at, min(at + 4096, last))}
                out[i] = np.maximum(out[i], self.features(list(runs)).max(axis=0))
        return out

    def margins(self, words: list[str]) -> np.ndarray:
        return self.features(words) @ self.weight + self.bias

    def learn(self, words: set[str]) -> None:
        if len(self.new) > self.most:
            self.new, self.old = {}, self.new
        missing = []
        for w in words - self.new.keys():
            if (got := self.old.get(w)) is not None:
                self.new[w] = got
            else:
                missing.append(w)
        if missing:
            bare = list({clean(w) for w in missing})
            got = dict(zip(bare, self.margins(bare).tolist(), strict=True))
            for w in missing:
                self.new[w] = got[clean(w)]

    def text_margins(self, texts: list[str]) -> np.ndarray:
        """Largest margin of the tokens of each text."""
        parts = [tokens(t) for t in texts]
        self.learn(set().union(*parts))
        get = self.new.__getitem__
        return np.array([max(map(get, p), default=self.bias) for p in parts])

    def scores(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.text_margins(texts) + self.shift, -500, 500)))


def train(texts: list[str], toxic: list[int], seed: int = 3, rounds: int = 3) -> Model | None:
    y = np.array(toxic, bool)
    if not y.any() or y.all():
        return None
    rng = np.random.default_rng(seed)
    sentences = [[[c for c in map(clean, tokens(s)) if c] for s in _SENTENCE.split(t) if s.strip()] for t in texts]
    n = [int((~y).sum()), int(y.sum())]
    held = [{w for s in own for w in s} for own in sentences]
    in_toxic = _part_counts((h for h, label in zip(held, y, strict=True) if label))
    often = {w for w, k in in_toxic.items() if k >= max(2, n[1] // 200)}
    in_clean = _part_counts((h for h, label in zip(held, y, strict=True) if not label), often)
    odds = {w: np.log((in_toxic[w] + 0.1) / (n[1] + 1)) - np.log((in_clean.get(w, 0) + 0.1) / (n[0] + 1)) for w in often}
    marked: list[str] = []
    covered: set[str] = set()  # runs of LENGTH letters of the landmarks
    for w in sorted((w for w in often if odds[w] > 3), key=lambda w: (-odds[w] * np.sqrt(in_toxic[w] * len(w)), w)):
        runs = {w[i : i + LENGTH] for i in range(len(w) - LENGTH + 1)}
        if len(marked) < LANDMARKS and not runs & covered:
            marked.append(w)
            covered |= runs
    if not marked:
        marked = sorted(often, key=lambda w: (-odds[w], w))[:LANDMARKS]
    seen: dict[str, int] = {}
    for h, label in zip(held, y, strict=True):
        if not label:
            for w in h:
                seen[w] = seen.get(w, 0) + 1
    benign = sorted((w for w in seen if LENGTH <= len(w) <= WIDE and w not in marked), key=lambda w: (-seen[w], w))[:BENIGN]
    if not marked:
        return None
    chosen = marked + benign
    plain = Model(chosen, np.zeros(len(chosen)), 0.0, 1.0, 0.0)
    gram = plain.features(chosen) * np.sqrt(plain.norms / plain.norms[:, None])  # normalised to a unit diagonal
    value, vector = np.linalg.eigh((gram + gram.T) / 2)
    keep = value > 1e-6
    nystrom = vector[:, keep] / np.sqrt(value[keep])

    # negatives: the tokens of clean sentences that come nearest to a landmark, and others at random
    pool = sorted(seen)
    near = plain.features(pool)
    hardest = np.argsort(-near[:, : len(marked)].max(axis=1), kind="stable")[:HARDEST]
    rest = rng.permutation(len(pool))[:OTHERS]
    x_neg = near[np.unique(np.concatenate([hardest, rest]))] @ nystrom
    bags = [s for own, label in zip(sentences, y, strict=True) if label for s in own if s]
    vocabulary = sorted({w for s in bags for w in s})
    at = {w: i for i, w in enumerate(vocabulary)}
    phi = plain.features(vocabulary) @ nystrom
    first = set(marked)
    witness = {at[w] for s in bags for w in s if any(m in w for m in first)}
    weight, bias = np.zeros(nystrom.shape[1]), 0.0
    for _ in range(rounds):
        if not witness:
            break
        x = np.concatenate([phi[sorted(witness)], x_neg])
        z = np.concatenate([np.ones(len(witness)), -np.ones(len(x_neg))])
        cost = np.where(z > 0, len(x_neg) / len(witness), 1.0)
        cost /= cost.mean()
        weight, bias = _machine(x, z, cost, rng)
        margin = phi @ weight + bias
        new = set()
        for s in bags:  # the witness of a sentence that the machine takes for toxic is its worst token
            i = max((at[w] for w in s), key=lambda i: margin[i])
            if margin[i] > 0:
                new.add(i)
        if new == witness:
            break
        witness = new or witness
    model = Model(chosen, nystrom @ weight, float(bias), 1.0, 0.0)
    margin = model.text_margins(texts)
    slope, shift = 1.0, 0.0
    goal = np.where(y, (n[1] + 1) / (n[1] + 2), 1 / (n[0] + 2))
    for _ in range(200):  # Platt scaling by Newton steps with a little damping
        p = 1 / (1 + np.exp(-np.clip(slope * margin + shift, -30, 30)))
        g = np.array([((p - goal) * margin).mean(), (p - goal).mean()])
        w = np.maximum(p * (1 - p), 1e-6)
        h = np.array([[(w * margin * margin).mean(), (w * margin).mean()], [(w * margin).mean(), w.mean()]]) + np.eye(2) * 1e-4
        step = np.linalg.solve(h, g)
        slope, shift = slope - 0.5 * step[0], shift - 0.5 * step[1]
    model.slope, model.shift, model.new = float(slope), float(shift), {}
    return model


def _part_counts(texts, only: set[str] | None = None) -> dict[str, int]:
    """In how many texts a part of PARTS letters of some token occurs."""
    count: dict[str, int] = {}
    for held in texts:
        parts = {w[i : i + k] for w in held for k in PARTS for i in range(len(w) - k + 1)}
        for part in parts if only is None else parts & only:
            count[part] = count.get(part, 0) + 1
    return count


def _machine(x: np.ndarray, z: np.ndarray, cost: np.ndarray, rng, penalty: float = 1e-5, epochs: int = 60) -> tuple[np.ndarray, float]:
    """Linear support vector machine: weighted hinge loss by averaged subgradient steps over shuffled batches."""
    w, b = np.zeros(x.shape[1]), 0.0
    mean_w, mean_b, steps, t = np.zeros_like(w), 0.0, 0, 0
    for epoch in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(order), 64):
            some = order[at : at + 64]
            t += 1
            rate = min(1.0, 1 / (penalty * (t + 200)) / 40)
            bad = some[z[some] * (x[some] @ w + b) < 1]
            pull = (cost[bad] * z[bad])[:, None] * x[bad]
            w = w * (1 - rate * penalty) + rate * pull.sum(axis=0) / len(some)
            b += rate * (cost[bad] * z[bad]).sum() / len(some) * 0.1
            if epoch >= epochs // 2:
                mean_w, mean_b, steps = mean_w + w, mean_b + b, steps + 1
    return mean_w / max(1, steps), mean_b / max(1, steps)


def held_out(doc_id: str = "doc_id"):
    """Whether crc32 of the id as text is divisible by 5; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic") -> Model | None:
    """Train on about ``sample`` labelled rows outside the held-out fold, at most half of them of either label where both allow it."""
    known = labels.filter(F.col(doc_id).isNotNull() & F.col(toxic).isNotNull() & ~held_out(doc_id)).groupBy(F.col(doc_id).alias("id")).agg(F.max(toxic).cast("int").alias("toxic"))
    counts = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}  # a row a label
    if not counts.get(0) or not counts.get(1):
        return None
    draw = F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1 << 30))
    rate = F.when(F.col("toxic") == 1, min(1.0, sample / 2 / counts[1])).otherwise(min(1.0, sample / 2 / counts[0]))
    picked = known.withColumn("draw", draw).filter(F.col("draw") < rate * float(1 << 30)).orderBy("draw", "id").limit(2 * sample)
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).filter("text is not null").join(F.broadcast(picked), "id")
    rows = rows.orderBy("draw", "id", "text").limit(2 * sample).collect()  # bounded by the sample
    return train([r.text for r in rows], [r.toxic for r in rows])


def score(docs: DataFrame, model: Model | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, score, predicted."""
    shared = session_of(docs).sparkContext.broadcast(model)

    def run(it):
        own = shared.value
        for batch in it:
            for some in slices(batch, 1):
                texts = [t or "" for t in some.column(1).to_pylist()]
                s = own.scores(texts) if own else np.zeros(len(texts))
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return arrow_map(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), run, "doc_id long, score double, predicted int")
