"""Packing by concatenate and cut.

Pass 1 encodes every document once and writes its ids with the running offset
inside its partition.  The partitions' totals (one number a partition) give
every partition its global offset by a prefix sum.  Pass 2 cuts the stream in
fixed windows: each piece knows its sequence and its offset there, with no
shuffle.  Only the last sequence can be short, so padding is below one window.

Ids of ``word_bpe_49k.json``: its pre-tokenizer drops white space and no match
spans a space or line feed, so the ids of a text are those of its words between
them in order; words are encoded by the tokenizers library once and remembered
in bounded caches.

Defined cases: null text counts as empty and gives the end id alone; null and
repeated ids are kept as rows of their own; an empty table gives no piece; a
document longer than a window is cut into as many pieces as it needs.
"""

from __future__ import annotations

import unicodedata
import zlib
from itertools import filterfalse, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import arrow_map, kept, session_of, slices, stash

WINDOW, END = 4096, 2
#: Bytes of text whose words are told apart together.
SLICE = 8 << 20


class WordEncoder:
    """Ids by the tokenizers library, part of word by part of word, with a cache of two generations of at most ``most`` parts each.

    A word of letters with punctuation behind it is two pre-tokens or one, so the
    library sees each distinct stem and run of punctuation once.  ASCII stems are
    looked up in lower case, which the normalizer would make of them anyway.
    Words are told apart, split and put together again as Arrow columns; only
    distinct parts become Python objects.
    """

    TAIL = ".,;:!?"

    def __init__(self, path: str, most: int = 100_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.ends = {i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")}
        self.most, self.parts, self.old = most, {"": b""}, {}
        # letters that the normalizer makes something else of: their words are not split
        odd = [c for c in map(chr, range(0x80, 0x110000)) if c.isalpha() and not unicodedata.normalize("NFC", c).lower().isalpha()]
        self.odd = "[" + "".join(f"\\x{{{ord(c):X}}}" for c in odd) + "]"

    def _library(self, words: list[str]) -> None:
        """Stems: letters only, so the library makes one pre-token of each; they go joined by spaces and are told apart by word ends."""
        ends, parts = self.ends, self.parts
        for at in range(0, len(words), 50):
            some = words[at : at + 50]
            ids = self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids
            stops = [2 * i + 2 for i, x in enumerate(ids) if x in ends]
            if len(stops) == len(some):
                raw, start = np.array(ids, "<u2").tobytes(), 0
                for w, stop in zip(some, stops, strict=True):
                    parts[w] = raw[start:stop]
                    start = stop
            else:  # a letter that the normalizer takes apart
                self._one_by_one(some)

    def _one_by_one(self, words: list[str]) -> None:
        for at in range(0, len(words), 10_000):
            some = words[at : at + 10_000]
            for w, e in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True):
                self.parts[w] = np.array(e.ids, "<u2").tobytes()

    def _ids(self, names: list[str]) -> pa.Array:
        if len(self.parts) > self.most:
            self.parts, self.old = {"": b""}, self.parts
        parts, letters, others = self.parts, [], []
        for x in filterfalse(parts.__contains__, names):
            if (got := self.old.get(x)) is not None:
                parts[x] = got
            else:
                (letters if x.isalpha() else others).append(x)
        self._library(letters)
        self._one_by_one(others)
        return pa.array(list(map(parts.__getitem__, names)), pa.binary())

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Little-endian unsigned 16-bit ids of each text; null counts as empty."""
        lists = pc.split_pattern(pc.replace_substring(texts.fill_null(""), "\n", " "), " ")
        words = lists.flatten().dictionary_encode()
        own = words.dictionary
        stem = pc.utf8_rtrim(own, self.TAIL)
        split = pc.and_not(pc.utf8_is_alpha(stem), pc.match_substring_regex(stem, self.odd))
        tail = pc.if_else(split, pc.replace_substring_regex(own, f"^[^{self.TAIL}]+", ""), "")
        stem = pc.if_else(split, pc.if_else(pc.string_is_ascii(stem), pc.ascii_lower(stem), stem), own)
        both = pa.concat_arrays([stem, tail]).dictionary_encode()
        ids = self._ids(both.dictionary.to_pylist()).take(both.indices)
        ids = pc.binary_join_element_wise(ids[: len(own)], ids[len(own) :], b"").take(words.indices)
        ends = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset : ids.offset + len(ids) + 1][np.asarray(lists.offsets) - lists.offsets[0].as_py()]
        data = memoryview(ids.buffers()[2]) if ids.buffers()[2] is not None else memoryview(b"")
        return [bytes(data[a:b]) for a, b in pairwise(ends.tolist())]


def encoder(path: str) -> WordEncoder:
    return kept(WordEncoder, path)


def encode(docs: DataFrame, tokenizer: str, end: int = END, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Table of (part, at, doc_id, ids): ``at`` is the document's offset in its partition; ids are little-endian unsigned 16-bit."""
    from tokenizers import Tokenizer

    if Tokenizer.from_file(tokenizer).get_vocab_size() > 1 << 16:
        raise ValueError("ids of this tokenizer take more than 16 bits")

    def run(it):
        import os

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        part, at, enc, last = TaskContext.get().partitionId(), 0, encoder(tokenizer), np.uint16(end).tobytes()
        for batch in it:
            for some in slices(batch, 1, SLICE):
                ids, ats = [], []
                for x in enc.encode(some.column(1)):
                    ids.append(x + last)
                    ats.append(at)
                    at += len(ids[-1]) // 2
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(ids), pa.int32()), pa.array(ats, pa.int64()), some.column(0), pa.array(ids, pa.binary())], ["part", "at", "doc_id", "ids"])

    return stash(arrow_map(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), run, "part int, at long, doc_id long, ids binary"), "ids")


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, end: int = END, doc_id: str = "doc_id", text: str = "text", digest: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids (binary).

    With ``digest``, ids_crc32 stands in place of ids: of the ids as little-endian unsigned 32-bit numbers.
    """
    ids = encode(docs, tokenizer, end, doc_id, text)
    totals = sorted((r.part, r.n) for r in ids.groupBy("part").agg(F.sum(F.length("ids") / 2).cast("long").alias("n")).collect())  # a row a partition
    base = dict(zip([p for p, _ in totals], np.concatenate([[0], np.cumsum([n for _, n in totals])[:-1]]).astype(int).tolist() if totals else [], strict=True))
    base = session_of(docs).sparkContext.broadcast(base)

    def cut(it):
        for batch in it:
            for some in slices(batch, 3):
                rows, last = [], []
                for part, at, doc, blob in zip(*(some.column(i).to_pylist() for i in range(4)), strict=True):
                    first, n, start = base.value[part] + at, len(blob) // 2, 0
                    while start < n:
                        sequence, offset = divmod(first + start, window)
                        length = min(window - offset, n - start)
                        piece = blob[2 * start : 2 * (start + length)]
                        rows.append((doc, start, length, n, sequence, offset))
                        last.append(zlib.crc32(np.frombuffer(piece, "<u2").astype("<u4")) if digest else piece)
                        start += length
                columns = zip(*rows, strict=True) if rows else ([],) * 6
                yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in columns), pa.array(last, pa.int64() if digest else pa.binary())], names)

    names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids_crc32" if digest else "ids"]
    return arrow_map(ids, cut, ", ".join(f"{n} long" for n in names[:6]) + (", ids_crc32 long" if digest else ", ids binary"))


def boundaries(pieces: DataFrame) -> DataFrame:
    """Boundary records: per sequence its length, and the offsets at which another document begins."""
    return pieces.groupBy("sequence_id").agg(
        F.sum("length").alias("length"),
        F.array_sort(F.collect_list(F.when((F.col("start") == 0) & (F.col("offset") > 0), F.col("offset")))).alias("document_starts"),
    )
