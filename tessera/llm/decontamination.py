"""Benchmark decontamination: rare n-gram seeds join passages to test items, then Smith-Waterman alignment.

Texts become sequences of words, lower-cased, without the punctuation around them.

1. One narrow pass over the documents finds the trigrams that the benchmark may have, by a bitmap of bounded size. Documents without
   any go no further.
2. Rarity is the number of documents that hold a trigram. An item of m words of which up to 20 % are edited keeps at least G - 3 k
   of its G trigrams, k = 0.2 m; so of any 3 k + 2 at least two are left. Of those that any document holds, only the rarest that
   many are seeds.
3. Trigrams of documents are joined to seeds by shuffle, whatever the size of either side. Equal texts are one passage there. A pair
   of a text and an item is a candidate if two seeds (one, in items of so few words that two needn't be left) lie on close diagonals;
   diagonals of trigrams that repeat too often aren't listed, such a pair always is one.
4. Candidates' texts are read again, by a bitmap of ids, and dealt out with their items, at most about PAIRS for each copy of a text.
   The item is aligned to the words around its trigrams: match 2, mismatch and gap -1. A pair counts from 0.7 of the item's own
   score, which 20 % of edited words leave, or from the score of a literal passage of PASSAGE words.

Items of fewer than three words are not looked for; null texts count as empty; rows without doc_id or item_id are reported
with a null. Documents that repeat a doc_id are reported for each; benchmark rows that repeat an item_id and its text are one
item. Empty tables give an empty result; other columns are left behind, but by ``keep_clean``, which returns the rows as they
were and decides on each by its own text.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, flagged, mix, python_pass, sha256_of, slices, texts_of, used_up, without

GRAM = 3
EDITED = 0.2
SCORE = 0.7
#: A part of an item that counts by itself, whatever the item's length.
PASSAGE = 50
#: Bits of the benchmark's bitmap; 8 MB whatever the benchmark.
GRAM_BITS = 26
#: Diagonals that one trigram of a pair is listed by at most; those of more make a candidate unseen.
LISTED = 256
#: Items that go with one copy of a text, about.
PAIRS = 256
#: Places of an item's trigrams in a text that are sorted into diagonals at most; beyond, the item is aligned to all that lies between.
PLACES = 200_000
CACHED = 200_000

_C = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


class _Words(dict):
    """word -> hash of the bare word, 0 if nothing is left of it."""

    def __missing__(self, word: str) -> int:
        import xxhash

        bare = word
        while bare and not bare[0].isalnum():
            bare = bare[1:]
        while bare and not bare[-1].isalnum():
            bare = bare[:-1]
        value = xxhash.xxh3_64_intdigest(bare.encode()) | 1 if bare else 0
        if len(self) > CACHED:
            self.clear()
        if len(word) <= 64:
            self[word] = value
        return value


def word_hashes(text: str, cache: _Words) -> np.ndarray:
    words = text.lower().split()
    hashes = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
    return hashes[hashes != 0]


def grams(hashes: np.ndarray) -> np.ndarray:
    n = max(0, len(hashes) - GRAM + 1)
    total = np.zeros(n, np.uint64)
    for i in range(GRAM):
        total += hashes[i : i + n] * _C[i]
    return mix(total)


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """The best local score, and where in the passage it ends."""
    steps = np.arange(len(passage) + 1)
    above, best, end = np.zeros(len(passage) + 1, np.int64), 0, 0
    for word in item:
        row = np.zeros_like(above)
        row[1:] = np.maximum(above[:-1] + np.where(passage == word, 2, -1), above[1:] - 1)
        np.maximum(row, 0, out=row)
        row = np.maximum.accumulate(row + steps) - steps  # gaps along the row
        if (top := int(row.max())) > best:
            best, end = top, int(row.argmax())
        above = row
    return best, end


def edits(words: int) -> int:
    return math.floor(EDITED * words)


def _best(item: np.ndarray, words: np.ndarray, order: np.ndarray, ordered: np.ndarray) -> tuple[int, int]:
    """The best score of an item in a text and the word at its end, or 0. ``ordered``: the text's trigrams, sorted, ``order``: where they are."""
    wanted, m = grams(item), len(item)
    low, high = np.searchsorted(ordered, wanted, "left"), np.searchsorted(ordered, wanted, "right")
    times = high - low
    slack = max(1, edits(m))
    if not (total := int(times.sum())):
        return 0, 0
    if total > PLACES:
        found = np.concatenate([order[a:b] for a, b in {(int(a), int(b)) for a, b in zip(low, high, strict=True)}])
        spans = [(int(found.min()) - m - slack, int(found.max()) + m + slack)]
    else:
        at = np.repeat(low - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(total)
        diagonal = np.sort(order[at] - np.repeat(np.arange(len(wanted)), times))
        starts = np.flatnonzero(np.concatenate([[True], np.diff(diagonal) > slack]))
        ends = np.append(starts[1:], total)
        least = 2 if len(wanted) - GRAM * edits(m) >= 2 else 1
        spans = [(int(diagonal[a]) - slack, int(diagonal[b - 1]) + m + slack) for a, b in zip(starts, ends, strict=True) if b - a >= least]
    best, end = 0, 0
    for first, last in spans:
        first = max(0, first)
        score, stop = align(item, words[first:last])
        if score > best:
            best, end = score, first + stop
    return best, end


def items_of(benchmark: DataFrame) -> DataFrame:
    """item, a hash of id and text, item_id, the number of words, their hashes, and trigrams by place."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _Words()
        for batch in slices(batches):
            words = [word_hashes(t, cache) for t in batch.column(2).to_pylist()]
            columns = [pa.array(map(len, words), pa.int32()), pa.array([w.tobytes() for w in words], pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns, _lists([grams(w) for w in words])], ["item", "item_id", "m", "words", "grams"])

    keyed = rows.select(F.xxhash64("item_id", "text").alias("item"), "item_id", "text")
    return python_pass(keyed, run, "item long, item_id long, m int, words binary, grams array<long>").filter(F.col("m") >= GRAM)


def _lists(values: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    flat = np.concatenate(values).view(np.int64) if len(values) else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def _bitmap(wanted: DataFrame) -> np.ndarray:
    """The benchmark's trigrams as a hashed bitmap."""
    slot = F.col("gram").bitwiseAND((1 << GRAM_BITS) - 1)
    parts = wanted.select(F.shiftright(slot, 15).alias("part"), slot.bitwiseAND(32767).alias("bit")).groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits"))
    out = np.zeros((1 << GRAM_BITS) >> 3, np.uint8)
    for r in parts.collect():
        out[r.part << 12 : (r.part + 1) << 12] = np.frombuffer(bytes(r.bits), np.uint8)
    return out


def hits(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id, the SHA-256 of the text, and trigrams with their places, of documents with trigrams that the benchmark may have."""
    bitmap = docs.sparkSession.sparkContext.broadcast(_bitmap(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, bits, mask = _Words(), bitmap.value, np.uint64((1 << GRAM_BITS) - 1)
        for batch in slices(batches):
            rows, found, places = [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                g = grams(word_hashes(text, cache))
                slot = (g & mask).astype(np.int64)
                at = np.flatnonzero(bits[slot >> 3] >> (slot & 7).astype(np.uint8) & 1)
                if len(at):
                    rows.append((i, hashlib.sha256(text.encode()).hexdigest()))
                    found.append(g[at])
                    places.append(at)
            ids = batch.column(0).take(pa.array([i for i, _ in rows], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array([d for _, d in rows], pa.string()), _lists(found), _lists(places)], ["doc_id", "digest", "grams", "places"])

    return python_pass(texts_of(docs), run, "doc_id long, digest string, grams array<long>, places array<long>")


def seeds(items: DataFrame, found: DataFrame) -> DataFrame:
    """gram, item, the places that it has there, and the item's m: of each item the trigrams that the fewest documents, but any, hold."""
    held = found.select(F.explode(F.array_distinct("grams")).alias("gram")).groupBy("gram").agg(F.count("*").alias("df"))
    each = items.select("item", "m", F.posexplode("grams").alias("place", "gram")).join(held, "gram")
    ranked = each.groupBy("item", "m").agg(F.sort_array(F.collect_list(F.struct("df", "place", "gram"))).alias("ranked"))
    chosen = ranked.select("item", "m", F.explode(F.slice("ranked", F.lit(1), GRAM * F.floor(F.col("m") * EDITED).cast("int") + 2)).alias("s"))
    return chosen.groupBy(F.col("s.gram").alias("gram"), "item", "m").agg(F.collect_list("s.place").alias("at"))


def candidates(found: DataFrame, chosen: DataFrame) -> DataFrame:
    """The pairs (digest, item) that seeds on close diagonals make, or trigrams that are too frequent in both to list them."""
    spelled = found.select("digest", F.explode(F.arrays_zip("grams", "places")).alias("x")).select("digest", F.col("x.grams").alias("gram"), F.col("x.places").alias("place"))
    # copies of a text say the same
    spelled = spelled.distinct().groupBy("digest", "gram").agg(F.collect_list("place").alias("places"))
    met = spelled.join(chosen, "gram")
    edited = F.floor(F.col("m") * EDITED)
    reach, least = F.greatest(edited, F.lit(1)), F.when(F.col("m") - GRAM + 1 - GRAM * edited >= 2, 2).otherwise(1)
    cell = lambda p, q: F.floor((p - q) / reach)
    cells = F.flatten(F.transform("places", lambda p: F.flatten(F.transform("at", lambda q: F.array(cell(p, q), cell(p, q) - 1)))))
    listed = F.when(F.size("places") * F.size("at") > LISTED, F.array(F.lit(None).cast("long"))).otherwise(cells)
    near = met.select("digest", "item", least.alias("least"), F.explode(listed).alias("cell")).groupBy("digest", "item", "least", "cell").agg(F.count("*").alias("n"))
    return near.filter("n >= least OR cell IS NULL").select("digest", "item").distinct()


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text, and after it the items to align to it."""
    cache, words = _Words(), np.zeros(0, np.uint64)
    order = ordered = words
    for batch in slices(batches):
        rows = []
        for digest, _, item, text, item_id, spoken in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if item is None:
                words = word_hashes(text, cache)
                g = grams(words)
                order = np.argsort(g, kind="stable")
                ordered = g[order]
                continue
            own = np.frombuffer(spoken, np.uint64)
            score, end = _best(own, words, order, ordered)
            if score >= min(SCORE * 2 * len(own), 2 * PASSAGE):
                rows.append((digest, item_id, score / (2 * len(own)), end))
        kinds = (pa.string(), pa.int64(), pa.float64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["digest", "item_id", "score", "end_word"])


def _leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``leaks`` and the SHA-256 of the document's text."""
    items = cut(items_of(benchmark))
    found = cut(hits(docs, items.select(F.explode("grams").alias("gram"))))
    pairs = cut(candidates(found, seeds(items, found)))
    wanted = pairs.groupBy("digest").agg(F.ceil(F.count("*") / PAIRS).alias("parts"))
    reps = cut(found.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).join(wanted, "digest"))
    texts = flagged(texts_of(docs), reps, "doc_id").filter("_hit").select(sha256_of(F.col("text")).alias("digest"), "text")
    texts = texts.join(reps.select("digest", "parts"), "digest").dropDuplicates(["digest"])
    texts = texts.select("digest", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "text")
    spoken = pairs.join(reps.select("digest", "parts"), "digest").join(items.select("item", "item_id", "words"), "item")
    spoken = spoken.select("digest", F.pmod(F.xxhash64("item"), F.col("parts")).alias("part"), "item", "item_id", "words")
    dealt = texts.unionByName(spoken, allowMissingColumns=True).repartition("digest", "part").sortWithinPartitions("digest", "part", F.asc_nulls_first("item"))
    kinds = "digest string, item_id long, score double, end_word long"
    aligned = cut(python_pass(dealt.select("digest", "part", "item", "text", "item_id", "words"), _aligned, kinds))
    used_up(items, pairs, reps)
    return found.select("doc_id", "digest").join(aligned, "digest").select("doc_id", "item_id", "score", "end_word", "digest")


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, score (of the item's own) and end_word for each document and each item that it holds."""
    return _leaks(docs, benchmark).drop("digest")


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that hold an item."""
    return without(docs, _leaks(docs, benchmark).select("doc_id", "digest").distinct(), sha256_of)
