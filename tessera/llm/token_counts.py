"""Token counts of a sentencepiece BPE model, with overlap resynchronisation for huge texts.

A text up to ``chunk`` characters is encoded at once.  A longer one is encoded in
overlapping chunks.  Two neighbouring chunks are spliced at a boundary p inside
their overlap at which both encodings have a token boundary, with the same token
ending at p and the same token starting at p.  Greedy BPE merges the best pair
first (leftmost on ties), so what a chunk does at p depends on the text around it
only through chains of merges that reach p; a chunk that begins ``overlap`` characters
before differs where such a chain is longer than that.  With the 256 characters used here no text
was found that differs, with overlaps of a few characters runs of one letter do, so
the overlap must stay well above the longest piece (16 characters).  If no such boundary exists the overlap is
doubled, and in the end both chunks are encoded as one, from before the last stable boundary
(the model puts a space before whatever it encodes) and joined there by the same rule, or from the text's start.

Defined cases: null counts as empty, which has 0 tokens; ids may be null or
repeat; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import arrow_map, kept, slices

CHUNK, OVERLAP, LIMIT = 1 << 14, 256, 4096


class Counter:
    def __init__(self, path: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.chunk, self.overlap = chunk, overlap
        n = self.model.get_piece_size()
        #: Characters that a token starts: a byte token only starts one if it is no continuation byte.
        self.width = np.array([(int(not 0x80 <= int(p[3:5], 16) < 0xC0) if self.model.is_byte(i) else len(p)) for i, p in enumerate(map(self.model.id_to_piece, range(n)))], np.int64)
        self.continues = np.array([self.model.is_byte(i) and 0x80 <= int(self.model.id_to_piece(i)[3:5], 16) < 0xC0 for i in range(n)])

    def _part(self, text: str, start: int, stop: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of text[start:stop] and the character at which each begins; the model puts one space before the first."""
        ids = np.array(self.model.encode(text[start:stop]), np.int64)
        at = start - 1 + np.concatenate([[0], np.cumsum(self.width[ids])])[:-1]
        return ids, np.maximum(at, start)

    def _common(self, a: tuple, b: tuple) -> tuple[int, int] | None:
        """Indexes (i, j) of the first tokens of ``a`` and ``b`` behind a stable boundary."""
        (ids_a, at_a), (ids_b, at_b) = a, b
        begins = {int(p): j for j, p in enumerate(at_b) if j > 1 and not self.continues[ids_b[j]]}
        for i in range(len(ids_a) - 1, 0, -1):
            if at_a[i] < at_b[0]:
                return None
            j = begins.get(int(at_a[i]))
            if j is not None and not self.continues[ids_a[i]] and ids_a[i] == ids_b[j] and ids_a[i - 1] == ids_b[j - 1] and at_a[i - 1] == at_b[j - 1]:
                return i, j
        return None

    def _behind(self, text: str, start: int, end: int, last: tuple[int, int], first: int) -> tuple[np.ndarray, np.ndarray] | None:
        """Tokens of text[start:end] behind the stable boundary ``start``, encoded with enough text before it; ``last`` is the
        token (id, character) that ends there and ``first`` the id that follows.  None if only the text's start is enough."""
        back = self.overlap
        while back < start:
            ids, at = self._part(text, start - back, end)
            for j in np.flatnonzero(at == start):
                if j > 1 and ids[j] == first and not self.continues[first] and (int(ids[j - 1]), int(at[j - 1])) == last:
                    return ids[j:], at[j:]
            back *= 2
        return None

    def encode_long(self, text: str) -> np.ndarray:
        done: list[np.ndarray] = []
        start, stop, last = 0, min(len(text), self.chunk), (-1, -1)
        now = self._part(text, start, stop)
        while stop < len(text):
            overlap, end = self.overlap, min(len(text), stop + self.chunk)
            while True:
                begin = max(start, stop - overlap)
                if begin == start:  # no alignment anywhere: both chunks as one
                    joined = self._behind(text, start, end, last, int(now[0][0])) if start else None
                    if joined is None:
                        done, start = [], 0
                    now = joined or self._part(text, 0, end)
                    break
                after = self._part(text, begin, end)
                if found := self._common(now, after):
                    i, j = found
                    done.append(now[0][:i])
                    last = int(now[0][i - 1]), int(now[1][i - 1])
                    now, start = (after[0][j:], after[1][j:]), int(after[1][j])
                    break
                overlap *= 2
            stop = end
        return np.concatenate([*done, now[0]])

    def counts(self, texts: list[str]) -> list[int]:
        short = [t for t in texts if len(t) <= self.chunk]
        ready = iter(map(len, self.model.encode(short, num_threads=1)))
        return [next(ready) if len(t) <= self.chunk else len(self.encode_long(t)) for t in texts]


def counter(path: str) -> Counter:
    return kept(Counter, path)


def token_counts(docs: DataFrame, model: str, limit: int = LIMIT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes, n_tokens, over_limit.  One narrow pass, no shuffle."""

    def run(it):
        own = counter(model)
        for batch in it:
            for some in slices(batch, 1):
                texts = [t or "" for t in some.column(1).to_pylist()]
                n = own.counts(texts)
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n])],
                    ["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    return arrow_map(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
