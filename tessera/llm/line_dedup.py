"""Near-duplicate lines by a deletion-neighbourhood join, with DataFrame operations only.

Lines are what line feeds separate; a line is its sequence of words between white space. Two lines match if they are equal, or if
one edit (a unit substituted, inserted or deleted) turns one into the other and the longer has at least UNITS units: one edit in
five units is a similarity of 0.8. The unit is the word; of two lines that have fewer than UNITS words each it is the character,
words being joined by one blank. A line stays if no earlier line, by doc_id, then line number, matches it. Lines without words
always stay.

1. Equal lines become one: counted by hash with partial aggregates, however often a line occurs.
2. One edit leaves the first or the second half of both lines as it was. Lines whose halves occur in no other line have no match;
   a bitmap of bounded size drops them before any variant is made.
3. Of the rest, each line emits the hash of itself without unit i, for each i, as two keys: with i, which lines of the same
   length share if they differ in unit i alone; and without, which equals the hash of a line that is one unit shorter. A line's
   hash is the exclusive or of the hashes of its units with their places, so running sums give all of its variants: the work is
   in proportion to its length, up to a sort.
4. All members of a key of the first kind match each other, so pairing each with the earliest finds whether it has an earlier
   match: no pairs within a bucket are made. Keys of the second kind join variants to whole lines.
5. The edit distance of all pairs is verified on the units.

A null text has one line without words. Rows without doc_id come first in the order. Repeated rows repeat their lines, of which
each (doc_id, line number) that comes first stays. Further columns are left behind. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut, flagged, texts_of, used_up

#: Units that the longer of two lines has at least if they are one edit apart.
UNITS = 5


def _words(line: Column) -> Column:
    """The words of a line. Blanks alone are split without a regular expression, which is much faster."""
    other = F.lit(False)
    for c in "\t\x0b\x0c\r":
        other = other | F.contains(line, F.lit(c))
    pieces = F.when(other, F.split(line, r"[ \t\x0B\f\r]+", -1)).otherwise(F.split(line, " ", -1))
    return F.filter(pieces, lambda w: w != "")


def _characters(words: Column) -> Column:
    return F.split(F.array_join(words, " "), "", -1)


def _halves(n: Column, part: Callable[[Column, Column], Column], *kind: Column) -> Column:
    """Hashes of what a line of n units has in common with a match of its length or of one unit more or less; ``part`` (first, length) cuts it."""
    lengths = F.floor(n / 2).cast("int"), F.greatest(F.floor((n - 1) / 2), F.lit(0)).cast("int")
    return F.array_distinct(F.array(*[F.xxhash64(*kind, F.lit(tail), k, part(n - k + 1 if tail else F.lit(1), k)) for k in lengths for tail in (False, True)]))


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, line_no from 0, number of words n, two hashes that identify the line, and arrays of halves, by words and by characters."""
    rows = texts_of(docs).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    rows = rows.select("doc_id", "line_no", _words(F.col("line")).alias("words"))
    words, few, n = F.col("words"), F.col("few"), F.size("words")
    rows = rows.select("doc_id", "line_no", "words", F.when((n > 0) & (n < UNITS), F.array_join(words, " ")).alias("few"))
    return rows.select(
        "doc_id", "line_no", n.alias("n"), F.xxhash64("words").alias("h"), F.xxhash64(F.lit(1), "words", n).alias("g"),
        F.when(n >= UNITS - 1, _halves(n, lambda first, k: F.slice(words, first, k))).alias("by_words"),
        F.when(F.length(few) >= UNITS - 1, _halves(F.length(few), lambda first, k: F.substring(few, first, k), F.lit("c"))).alias("by_chars"),
    )


def _one_edit(a: Column, b: Column) -> Column:
    """Whether arrays of units a and b, b no shorter, are one substitution or one insertion apart."""
    n = F.size(a)
    differ = F.zip_with(a, F.slice(b, F.lit(1), n), lambda x, y: x != y)
    first = F.array_position(differ, True).cast("int")
    substituted = F.size(F.filter(differ, lambda d: d)) <= 1
    inserted = (first == 0) | (F.slice(a, first, n) == F.slice(b, first + 1, n))
    return F.when(F.size(b) == n, substituted).when(F.size(b) == n + 1, inserted).otherwise(False)


def _alike(lines: DataFrame) -> DataFrame:
    """h, g, doc_id and line_no where it first occurs, of distinct lines that have half of another one."""
    first = F.min(F.struct("doc_id", "line_no")).alias("first")
    able = lines.filter("by_words IS NOT NULL OR by_chars IS NOT NULL")
    distinct = cut(able.groupBy("h", "g").agg(first, F.first("by_words").alias("by_words"), F.first("by_chars").alias("by_chars")))
    all_halves = F.concat(F.coalesce("by_words", F.array().cast("array<bigint>")), F.coalesce("by_chars", F.array().cast("array<bigint>")))
    halves = distinct.select("h", "g", "first", F.explode(all_halves).alias("half"))
    shared = halves.groupBy("half").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).filter("lo != hi").select("half")
    hit = flagged(halves, shared, "half").filter("_hit")
    out = cut(hit.groupBy("h", "g").agg(F.min("first").alias("first")).select("h", "g", "first.doc_id", "first.line_no"))
    used_up(distinct)
    return out


def _with_words(docs: DataFrame, alike: DataFrame) -> DataFrame:
    """``alike`` with words and n, read again where the lines first occur; other documents aren't split."""
    rows = flagged(texts_of(docs), alike.select("doc_id").distinct(), "doc_id").filter("_hit")
    rows = rows.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    rows = flagged(rows, alike, "doc_id", "line_no").filter("_hit").select("doc_id", "line_no", _words(F.col("line")).alias("words"))
    rows = rows.select("doc_id", "line_no", "words", F.xxhash64("words").alias("h"))
    same = F.col("x.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("x.line_no") == F.col("f.line_no")) & (F.col("x.h") == F.col("f.h"))
    joined = rows.alias("x").join(alike.alias("f"), same).select("f.h", "f.g", "f.doc_id", "f.line_no", "words")
    return cut(joined.dropDuplicates(["h", "g"]))


def _in_units(words: DataFrame) -> DataFrame:
    """chars (whether units are characters), units and their number n: lines of few words by character, those of UNITS - 1 words by both."""
    n = F.size("words")
    by_word = words.filter(n >= UNITS - 1).select("h", "g", "doc_id", "line_no", F.lit(False).alias("chars"), F.col("words").alias("units"))
    by_char = words.filter(n < UNITS).select("h", "g", "doc_id", "line_no", F.lit(True).alias("chars"), _characters(F.col("words")).alias("units"))
    return by_word.unionByName(by_char).withColumn("n", F.size("units")).filter(F.col("n") >= UNITS - 1)


def _variants(lines: DataFrame) -> DataFrame:
    """For each unit of each line its place i from 0, the line's hash without it (key), and the hash of the whole line."""
    units = lines.select("doc_id", "line_no", "chars", "n", F.posexplode("units").alias("i", "unit"))
    units = units.select("doc_id", "line_no", "chars", "n", "i", F.xxhash64("unit", "i").alias("here"), F.xxhash64("unit", F.col("i") - 1).alias("moved"))
    line = Window.partitionBy("doc_id", "line_no", "chars")
    upto = line.orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = F.bit_xor("here").over(upto).bitwiseXOR(F.col("here"))  # of the units before this one
    after = F.bit_xor("moved").over(line).bitwiseXOR(F.bit_xor("moved").over(upto))  # of those after it, one place down
    whole = F.bit_xor("here").over(line)
    return units.select("doc_id", "line_no", "chars", "n", "i", before.bitwiseXOR(after).alias("key"), whole.alias("whole"))


def matches(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """h, g and the earliest earlier match (doc_id, line_no) of each distinct line that has one."""
    alike = _alike(lines)
    words = _with_words(docs, alike)
    used_up(alike)
    units = _in_units(words)

    place = F.struct("doc_id", "line_no")
    # three joins read the variants; making them takes longer than reading them back
    spread = cut(_variants(units)).withColumn("at", place)
    z = F.pmod("key", F.lit(2))
    substitutions = spread.filter(F.col("n") >= UNITS).select("chars", "n", "i", "key", "at").withColumn("z", z)
    hubs = substitutions.groupBy("key", "i", "n", "chars").agg(F.min("at").alias("hub"), F.max("at").alias("last")).filter("hub < last").withColumn("z", z)
    by_hub = substitutions.join(hubs, ["key", "i", "n", "chars", "z"]).filter("hub < at").select("chars", "at", "hub")
    whole = spread.filter("i = 0").select(F.col("whole").alias("key"), F.col("at").alias("short"), (F.col("n") + 1).alias("n"), "chars")
    by_length = spread.filter(F.col("n") >= UNITS).select("key", "n", "chars", F.col("at").alias("long")).join(whole, ["key", "n", "chars"])
    pairs = by_hub.unionByName(by_length.select("chars", F.greatest("long", "short").alias("at"), F.least("long", "short").alias("hub"))).distinct()

    of = lambda name: units.select("chars", place.alias(name), F.col("units").alias(f"{name}_units"))
    both = pairs.join(of("at"), ["at", "chars"]).join(of("hub"), ["hub", "chars"])
    shorter_first = F.size("at_units") <= F.size("hub_units")
    verified = both.filter(F.when(shorter_first, _one_edit(F.col("at_units"), F.col("hub_units"))).otherwise(_one_edit(F.col("hub_units"), F.col("at_units"))))
    earliest = verified.groupBy("at").agg(F.min("hub").alias("match"))
    return earliest.join(words.select("h", "g", place.alias("at")), "at").select("h", "g", "match")


def line_dedup(docs: DataFrame) -> DataFrame:
    """For each line of ``docs``: doc_id, line_no, kept, and the line that it repeats or else itself (keep_doc_id, keep_line_no)."""
    lines = cut(lines_of(docs))
    first = lines.filter("n > 0").groupBy("h", "g").agg(F.min(F.struct("doc_id", "line_no")).alias("first"), F.max("n").alias("n"))
    near = first.join(matches(docs, lines), ["h", "g"], "left").select("h", "g", "n", F.coalesce("match", "first").alias("keep"))
    rows = lines.select("doc_id", "line_no", "h", "g", "n").join(near, ["h", "g", "n"], "left")
    keep = F.coalesce("keep", F.struct("doc_id", "line_no"))
    return rows.select(
        "doc_id",
        "line_no",
        (F.col("doc_id").eqNullSafe(keep["doc_id"]) & (F.col("line_no") == keep["line_no"])).alias("kept"),
        keep["doc_id"].alias("keep_doc_id"),
        keep["line_no"].alias("keep_line_no"),
    )


ORACLE = r"""WITH t AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS line_no FROM t),
w AS (SELECT doc_id, line_no, regexp_extract_all(line, '[^\x20\x09\x0B-\x0D]+') AS w, array_to_string(w, ' ') AS k FROM l),
f AS (SELECT k, any_value(w) AS w, min({'d': doc_id, 'l': line_no}) AS first FROM w WHERE len(w) > 0 GROUP BY k),
d AS (SELECT k, w, first, row_number() OVER (ORDER BY first) AS p FROM f),
u AS (SELECT p, 'w' AS unit, len(w) AS n, unnest(range(1, len(w) + 1)) AS i, w, k FROM d WHERE len(w) >= 4
  UNION ALL SELECT p, 'c', length(k), unnest(range(1, length(k) + 1)), w, k FROM d WHERE len(w) < 5 AND length(k) >= 4),
v AS (SELECT p, unit, n, i, k, CASE WHEN unit = 'w' THEN array_to_string(list_concat(w[1:i - 1], w[i + 1:]), ' ')
  ELSE substring(k, 1, i - 1) || substring(k, i + 1) END AS key FROM u),
hubs AS (SELECT unit, n, i, key, min(p) AS hub FROM v WHERE n >= 5 GROUP BY unit, n, i, key),
m AS (SELECT v.p, hubs.hub FROM v JOIN hubs USING (unit, n, i, key) WHERE hubs.hub < v.p
  UNION ALL SELECT greatest(a.p, b.p), least(a.p, b.p) FROM v a JOIN (SELECT DISTINCT p, unit, n, k FROM v) b ON a.unit = b.unit AND a.n = b.n + 1 AND a.key = b.k WHERE a.n >= 5),
near AS (SELECT p, min(hub) AS hub FROM m GROUP BY p),
keep AS (SELECT d.k, coalesce(h.first, d.first) AS keep FROM d LEFT JOIN near ON near.p = d.p LEFT JOIN d h ON h.p = near.hub),
o AS (SELECT w.doc_id, CAST(w.line_no AS INTEGER) AS line_no, coalesce(keep.keep['d'], w.doc_id) AS keep_doc_id, CAST(coalesce(keep.keep['l'], w.line_no) AS INTEGER) AS keep_line_no
  FROM w LEFT JOIN keep ON len(w.w) > 0 AND keep.k = w.k)
SELECT doc_id, line_no, doc_id = keep_doc_id AND line_no = keep_line_no AS kept, keep_doc_id, keep_line_no FROM o"""
