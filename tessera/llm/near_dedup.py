"""Near-duplicate documents by MinHash with banding, verification and connected components.

A document is the set of its distinct shingles of five words, lower-cased in A-Z, words being runs of what isn't ASCII
white space; with fewer words the whole sequence is one shingle; without words the set is empty and linked with nothing.
Two documents are linked if 100 * intersection >= percent * union of their full sets; percent is 85 unless the caller says
otherwise, and sets the number of bands and of minima (``Threshold``).

1. One narrow pass makes for each document universal hash minima, 150 at 85 per cent, and a digest of its set. Equal sets are one class, of
   which only the smallest doc_id goes on: groups of copies, however large, are never compared.
2. Bands of five minima, 30 at 85 per cent and 45 at 80, deal the classes out into buckets; linked ones share fewer than two with a
   probability under one in a million. Each member of a bucket is paired with the bucket's smallest id: as many pairs as members.
3. Pairs whose minima agree too rarely (five standard deviations below the threshold) go; the others are confirmed on full sets.
4. Components of the confirmed links. Buckets that still hold several components are open. One with so much beside its largest
   component that blocks would copy each member more often than there are bands is split by each further band into the buckets of
   those that share that band too, as linked ones do.
5. What is left open is compared in blocks of bounded size: whatever isn't in the bucket's largest component, against all its
   other members but those of its own component, first by minima. Texts go only to blocks, and only of members, that have a
   partner whose minima agree; there full sets decide. So any two members of one bucket are in one component or have been
   compared, and the components are those of all links.

Hot buckets and classes are met by partial aggregates, by joins that adaptive execution can split, by further bands and by the
blocks. Texts are shuffled only for documents in pairs, found by a bitmap of bounded size.

A null text counts as empty. Rows of one doc_id are one document, linked if any of its texts is. Rows without doc_id are
linked with nothing and kept; their component_id is null. An empty table gives an empty result; further columns are left
behind, but by ``keep_one``, which returns the rows as they were.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, flagged, mix, python_pass, slices, texts_of, used_up, without
from tessera.llm.components import connected_components

WORDS = 5
#: Minima of a band.
ROWS = 5
#: Links have at least this per cent of their union in common, unless the caller says otherwise.
PERCENT = 85
#: A link at the threshold shares fewer than two bands with at most this probability.
MISSED = 6e-7
#: Members of a bucket's part that meets another in one task.
BLOCK = 256
#: Shingles of all members of such a part, unless one member alone has more.
BLOCK_SHINGLES = 1 << 20

_C = np.random.default_rng(20260101).integers(0, 2**63, WORDS, np.uint64) * np.uint64(2) + np.uint64(1)


@dataclass(frozen=True)
class Threshold:
    """What follows from the per cent of their union that links have in common."""

    percent: int

    def __post_init__(self) -> None:
        if not 0 < self.percent <= 100:
            raise ValueError(f"no per cent of a union: {self.percent}")

    @functools.cached_property
    def bands(self) -> int:
        shared, n = (self.percent / 100) ** ROWS, 2
        while (1 - shared) ** n + n * shared * (1 - shared) ** (n - 1) > MISSED:
            n += 1
        return n

    @property
    def hashes(self) -> int:
        return self.bands * ROWS

    @functools.cached_property
    def agree(self) -> int:
        """Fewer agreeing minima than this: five standard deviations below what a link at the threshold has."""
        mean = self.hashes * self.percent / 100
        return math.floor(mean - 5 * math.sqrt(mean * (1 - self.percent / 100)))


@functools.lru_cache(maxsize=4)
def _functions(hashes: int) -> tuple[np.ndarray, np.ndarray]:
    """Factors and summands of the hash functions."""
    random = np.random.default_rng(20260102)
    return random.integers(0, 2**63, hashes, np.uint64) * np.uint64(2) + np.uint64(1), random.integers(0, 2**63, hashes, np.uint64)


def shingles(text: str) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles."""
    import xxhash

    words = text.encode().lower().split()  # bytes: both touch ASCII only
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(hashes) - WORDS + 1
    if n <= 0:
        return mix(np.array([xxhash.xxh3_64_intdigest(b" ".join(words))], np.uint64)) if words else hashes
    total = np.zeros(n, np.uint64)
    for i in range(WORDS):
        total += hashes[i : i + n] * _C[i]
    return np.unique(mix(total))


def minima(hashes: np.ndarray, count: int) -> np.ndarray:
    """The least value of each of ``count`` hash functions over the set, 32 bits of it."""
    factors, summands = _functions(count)
    low = np.full(count, np.iinfo(np.uint64).max)
    for start in range(0, len(hashes), 1024):
        np.minimum(low, (hashes[None, start : start + 1024] * factors[:, None] + summands[:, None]).min(axis=1), out=low)
    return (low >> np.uint64(32)).astype("<u4")


def _sign(batches: Iterator[pa.RecordBatch], at: Threshold) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        sets = [shingles(t) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                pa.array([minima(s, at.hashes).tobytes() if len(s) else b"" for s in sets], pa.binary()),
            ],
            ["doc_id", "n_shingles", "set_id", "minima"],
        )


def signatures(docs: DataFrame, at: Threshold) -> DataFrame:
    """doc_id, n_shingles, a digest of the set, and its minima."""
    return python_pass(texts_of(docs), functools.partial(_sign, at=at), "doc_id long, n_shingles long, set_id binary, minima binary")


def _agreeing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).sum(axis=-1)


def _minima_of(column: pa.Array, count: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u4").reshape(-1, count)


def _linked(p: np.ndarray, q: np.ndarray, percent: int) -> bool:
    if 100 * min(len(p), len(q)) < percent * max(len(p), len(q)):
        return False
    common = len(np.intersect1d(p, q, assume_unique=True))
    return common > 0 and 100 * common >= percent * (len(p) + len(q) - common)


def _keep_agreeing(batches: Iterator[pa.RecordBatch], at: Threshold) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 4096):
        if batch.num_rows:
            near = _agreeing(_minima_of(batch.column(2), at.hashes), _minima_of(batch.column(3), at.hashes)) >= at.agree
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(near)) for i in range(2)], ["a", "b"])


#: Characters of texts whose sets a worker remembers.
REMEMBERED = 2 << 20


def _confirm(batches: Iterator[pa.RecordBatch], at: Threshold) -> Iterator[pa.RecordBatch]:
    sets: dict[str, np.ndarray] = {}
    held = 0
    for batch in slices(batches, 256):
        linked = []
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            if x not in sets:
                if held + len(x) > REMEMBERED:
                    sets, held = {}, 0
                sets[x], held = shingles(x), held + len(x)
            linked.append(_linked(sets[x], shingles(y), at.percent))
        mask = pa.array(linked, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["u", "v"])


def _with_both(pairs: DataFrame, rows: DataFrame, value: str) -> DataFrame:
    """a, b and ``value`` of either from ``rows`` (doc_id, value)."""
    of = lambda key, name: rows.select(F.col("doc_id").alias(key), F.col(value).alias(name))
    return pairs.join(of("b", "y"), "b").join(of("a", "x"), "a").select("a", "b", "x", "y")


def confirmed(pairs: DataFrame, docs: DataFrame, at: Threshold) -> DataFrame:
    """The links (u, v) among the pairs (a, b), by their full sets."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    texts = flagged(texts_of(docs), ids, "doc_id").filter("_hit").select("doc_id", "text")
    return python_pass(_with_both(pairs, texts, "text"), functools.partial(_confirm, at=at), "u long, v long")


def _band(band: int) -> Column:
    """The key of a band, from the column of minima."""
    size = 4 * ROWS
    return F.xxhash64(F.lit(band), F.substring("minima", band * size + 1, size))


def _bands(reps: DataFrame, bands: int) -> DataFrame:
    """band, key and doc_id: a row of each class for each band."""
    keys = F.array(*[F.struct(F.lit(b).alias("band"), _band(b).alias("key")) for b in range(bands)])
    return reps.select("doc_id", F.explode(keys).alias("x")).select("x.band", "x.key", "doc_id")


def _open(members: DataFrame) -> DataFrame:
    """The members of buckets (band, also, key) that hold several components, with what their bucket is made of."""
    sizes = members.groupBy("band", "also", "key", "component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("w"))
    buckets = (
        sizes.groupBy("band", "also", "key")
        .agg(F.max(F.struct("n", "component", "w")).alias("top"), F.sum("n").alias("n_all"), F.sum("w").alias("w_all"), F.count("*").alias("parts"))
        .filter("parts > 1")
        .select("band", "also", "key", F.col("top.component").alias("top"), F.col("top.n").alias("n_top"), F.col("top.w").alias("w_top"), "n_all", "w_all")
    )
    z = F.pmod("key", F.lit(2))
    return members.withColumn("z", z).join(buckets.withColumn("z", z), ["band", "also", "key", "z"]).drop("z")


def _split(members: DataFrame, bands: int) -> DataFrame:
    """Members of large buckets in the buckets of those that share another, later band as well."""
    keys = F.array(*[F.struct(F.lit(b).alias("also"), F.xxhash64("key", _band(b)).alias("key")) for b in range(bands)])
    rows = members.select("band", "doc_id", "component", "n_shingles", F.explode(F.filter(keys, lambda x: x["also"] > F.col("band"))).alias("x"))
    return rows.select("band", "x.also", "x.key", "doc_id", "component", "n_shingles")


def _blocks(members: DataFrame) -> DataFrame:
    """Rows of open buckets, copied to each block in which their part meets another.

    The bucket's largest component is cut into parts of bounded size, and so is the rest; its parts meet only parts of the rest.
    """
    parts = lambda n, w: F.greatest(F.ceil(n / BLOCK), F.ceil(w / BLOCK_SHINGLES), F.lit(1)).cast("long")
    rows = members.withColumn("parts_top", parts(F.col("n_top"), F.col("w_top")))
    rows = rows.withColumn("parts_rest", parts(F.col("n_all") - F.col("n_top"), F.col("w_all") - F.col("w_top")))
    rows = rows.withColumn("main", F.col("component") == F.col("top"))
    part = F.when(F.col("main"), F.pmod(F.xxhash64("doc_id"), F.col("parts_top"))).otherwise(F.pmod(F.xxhash64("doc_id"), F.col("parts_rest")))
    rest = F.sequence(F.lit(0).cast("long"), F.col("parts_rest") - 1)
    to_rest = F.transform(rest, lambda i: F.struct(F.lit(0).alias("kind"), F.least(i, F.col("part")).alias("i"), F.greatest(i, F.col("part")).alias("j")))
    to_top = F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts_top") - 1), lambda j: F.struct(F.lit(1).alias("kind"), F.col("part").alias("i"), j.alias("j")))
    from_top = F.transform(rest, lambda i: F.struct(F.lit(1).alias("kind"), i.alias("i"), F.col("part").alias("j")))
    meets = F.when(F.col("main"), from_top).otherwise(F.concat(to_rest, to_top))
    copies = rows.withColumn("part", part).select("band", "also", "key", "doc_id", "component", F.explode(meets).alias("m"))
    return copies.select(F.xxhash64("band", "also", "key", "m.kind", "m.i", "m.j").alias("block"), "band", "also", "doc_id", "component")


def _pairs_of_block(band: int, also: int, components: list[int], signs: list[bytes], at: Threshold) -> Iterator[tuple[int, np.ndarray]]:
    """For each member, the later ones of other components whose minima agree with its own.

    A pair that shares an earlier band, or pair of bands, as well is left to that one's bucket.
    """
    c = np.array(components, np.int64)
    s = np.frombuffer(b"".join(signs), "<u4").reshape(-1, at.bands, ROWS)
    for i in range(len(c) - 1):
        other = i + 1 + np.flatnonzero(c[i + 1 :] != c[i])
        same = s[other] == s[i]
        shared = same.all(axis=2)
        first = ~shared[:, :band].any(axis=1)
        if also >= 0:
            first &= ~shared[:, band + 1 : also].any(axis=1)
        yield i, other[(same.sum(axis=(1, 2)) >= at.agree) & first]


def _links_of_block(band: int, also: int, docs: list[int], components: list[int], signs: list[bytes], texts: list[str], at: Threshold) -> list[tuple[int, int]]:
    """Confirmed links that join the block's components; a pair whose components are joined already needs no look."""
    sets: dict[int, np.ndarray] = {}
    parent = {x: x for x in components}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    def full(i: int) -> np.ndarray:
        if i not in sets:
            sets[i] = shingles(texts[i])
        return sets[i]

    links = []
    for i, others in _pairs_of_block(band, also, components, signs, at):
        for j in others:
            x, y = root(components[i]), root(components[j])
            if x != y and _linked(full(i), full(j), at.percent):
                parent[max(x, y)] = min(x, y)
                links.append((docs[i], docs[j]))
    return links


def _each_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int, list[list]]]:
    """block, band, also and the further columns. Blocks follow each other within a partition, and one is held at a time."""
    now, held = None, []
    for batch in slices(batches):
        for key, *row in zip(zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True), *[batch.column(i).to_pylist() for i in range(3, batch.num_columns)], strict=True):
            if key != now:
                if held:
                    yield *now, held
                now, held = key, [[] for _ in row]
            for column, value in zip(held, row, strict=True):
                column.append(value)
    if held:
        yield *now, held


def _suspects(batches: Iterator[pa.RecordBatch], at: Threshold) -> Iterator[pa.RecordBatch]:
    """The members of each block that have a partner there by their minima."""
    for block, band, also, (docs, components, signs) in _each_block(batches):
        marked = np.zeros(len(docs), bool)
        for i, others in _pairs_of_block(band, also, components, signs, at):
            marked[others] = True
            marked[i] |= len(others) > 0
        found = np.flatnonzero(marked)
        columns = [[block] * len(found), [band] * len(found), [also] * len(found), [docs[i] for i in found], [components[i] for i in found]]
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], ["block", "band", "also", "doc_id", "component"])


def _compare(batches: Iterator[pa.RecordBatch], at: Threshold) -> Iterator[pa.RecordBatch]:
    for _, band, also, (docs, components, signs, texts) in _each_block(batches):
        links = _links_of_block(band, also, docs, components, signs, texts, at)
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["u", "v"])


def _late_links(members: DataFrame, reps: DataFrame, docs: DataFrame, at: Threshold) -> DataFrame:
    """The links (u, v) that the buckets (band, key, doc_id, component) still hide."""
    whole = members.withColumn("also", F.lit(-1)).join(reps.select("doc_id", "n_shingles"), "doc_id")
    opened = cut(_open(whole))
    large = F.col("n_all") - F.col("n_top") > BLOCK * at.bands
    several = opened.filter(large).select("band", "key", "doc_id", "component", "n_shingles").join(reps.select("doc_id", "minima"), "doc_id")
    blocks = _blocks(opened.filter(~large).unionByName(_open(_split(several, at.bands))))
    dealt = blocks.join(reps.select("doc_id", "minima"), "doc_id").repartition("block").sortWithinPartitions("block")
    kinds = "block long, band int, also int, doc_id long, component long"
    suspects = cut(python_pass(dealt.select("block", "band", "also", "doc_id", "component", "minima"), functools.partial(_suspects, at=at), kinds))
    texts = flagged(texts_of(docs), suspects.select("doc_id").distinct(), "doc_id").filter("_hit").select("doc_id", "text")
    full = suspects.join(reps.select("doc_id", "minima"), "doc_id").join(texts, "doc_id").repartition("block").sortWithinPartitions("block")
    late = cut(python_pass(full.select("block", "band", "also", "doc_id", "component", "minima", "text"), functools.partial(_compare, at=at), "u long, v long"))
    used_up(opened, suspects)
    return late


def near_dedup(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """For each row of ``docs``: doc_id, n_shingles, component_id and kept; links have ``percent`` of their union in common."""
    at = Threshold(percent)
    base = cut(signatures(docs, at))
    known = base.filter("doc_id IS NOT NULL")
    classes = known.filter("n_shingles > 0").groupBy("set_id").agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n_shingles"))
    classes = cut(classes)
    ids = classes.select(F.col("rep").alias("doc_id")).distinct()
    reps = cut(known.filter("n_shingles > 0").join(ids, "doc_id", "left_semi").select("doc_id", "n_shingles", "minima"))

    bands = _bands(reps, at.bands)
    buckets = bands.groupBy("band", "key").agg(F.min("doc_id").alias("hub"), F.max("doc_id").alias("last")).filter("hub != last")
    keyed = bands.withColumn("z", F.pmod("key", F.lit(2)))
    members = cut(keyed.join(buckets.withColumn("z", F.pmod("key", F.lit(2))), ["band", "key", "z"]).select("band", "key", "hub", "doc_id"))
    pairs = members.filter("hub != doc_id").select(F.col("hub").alias("a"), F.col("doc_id").alias("b")).distinct()
    agreeing = cut(python_pass(_with_both(pairs, reps, "minima"), functools.partial(_keep_agreeing, at=at), "a long, b long"))
    links = cut(confirmed(agreeing, docs, at))
    used_up(agreeing)
    components = connected_components(links)

    def labelled(rows: DataFrame, key: str) -> DataFrame:
        label = components.select(F.col("node").alias(key), F.col("component").alias("_c"))
        return rows.join(label, key, "left").withColumn("component", F.coalesce("_c", key)).drop("_c")

    mixed = labelled(members.select("band", "key", "doc_id").distinct(), "doc_id")
    late = _late_links(mixed, reps, docs, at)
    used_up(members, reps)
    if not late.isEmpty():
        components = connected_components(links.unionByName(late))

    named = labelled(classes.withColumnRenamed("rep", "doc_id"), "doc_id").select("set_id", "n_shingles", "component")
    out = base.join(named, ["set_id", "n_shingles"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def keep_one(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``docs`` without the documents that a smaller doc_id stands for."""
    return without(docs, near_dedup(docs, percent).filter("NOT kept").select("doc_id"))


ORACLE = r"""WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id != b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
r(a, b) AS (SELECT a, b FROM p UNION SELECT r.a, p.b FROM r JOIN p ON p.a = r.b),
c AS (SELECT s.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(m.b, s.doc_id)) AS component_id
  FROM s LEFT JOIN (SELECT a, min(b) AS b FROM r GROUP BY a) m ON m.a = s.doc_id)
SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM c"""
