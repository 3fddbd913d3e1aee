"""The operators against libraries, brute force, round trips and held-out labels, and on odd rows."""

import collections
import hashlib
import html
import itertools
import os
import random
import re
import tracemalloc
import zlib

import corpus_pipeline
import duckdb
import numpy as np
import pyarrow as pa
import pytest
from tessera.llm import bpe, chat, common, components, decontamination, exact_dedup, html_text, line_dedup, near_dedup, quality, registry, token_counts, toxicity

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, kept string, score string, size string, _key string"


def docs_of(spark, rows):
    """Documents with further columns whose names the operators use."""
    return spark.createDataFrame([(i, t, "a", "b", "c", "d") for i, t in rows], DOCS).repartition(4)


def ascii_lower(t):
    return "".join(c.lower() if c.isascii() else c for c in t or "")


ODD = [(1, None), (2, ""), (3, "A b"), (4, "a B"), (4, "a B"), (5, "É é"), (6, "é é"), (None, "a b"), (7, " \n\t"), (8, "x " * 30_000), (9, "X " * 30_000)]


def dedup_by_hand(rows):
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[ascii_lower(t)].append(i)
    out, stays = [], set()
    for i, t in rows:
        n = ascii_lower(t)
        keep = max((x for x in groups[n] if x is not None), default=None)
        out.append((i, keep, len(groups[n]), i == keep and n not in stays, hashlib.sha256(n.encode()).hexdigest()))
        if i == keep:
            stays.add(n)  # one row of each text
    return out


def test_exact_dedup(spark):
    got = [tuple(r) for r in exact_dedup.exact_dedup(docs_of(spark, ODD)).collect()]
    assert sorted(got, key=repr) == sorted(dedup_by_hand(ODD), key=repr)
    kept = exact_dedup.keep_one(docs_of(spark, ODD))
    assert kept.columns == [c.split()[0] for c in DOCS.split(", ")]
    assert sorted((r.doc_id or 0 for r in kept.collect())) == [2, 4, 5, 6, 7, 9]
    assert exact_dedup.exact_dedup(docs_of(spark, [])).count() == 0


def test_exact_dedup_keeps_one_row_of_each_text(spark):
    rows = [(1, "x"), (2, "X"), (1, "y unique"), (5, "z"), (5, "Z"), (5, "z"), (None, "n"), (None, "N"), (None, "alone"), (None, None), (None, ""), (6, "É"), *[(8, "many")] * 9000, (3, "many")]
    want = sorted((str(i), d[4], d[3]) for (i, _), d in zip(rows, dedup_by_hand(rows), strict=True))
    query = exact_dedup.exact_dedup(docs_of(spark, rows)).collect()
    assert sorted((str(r.doc_id), r.text_sha256, r.kept) for r in query) == want and {r.group_size for r in query if r.doc_id == 8} == {9001}
    kept = exact_dedup.keep_one(docs_of(spark, rows))
    assert kept.columns == docs_of(spark, []).columns
    assert sorted((str(r.doc_id), hashlib.sha256(ascii_lower(r.text).encode()).hexdigest(), True) for r in kept.collect()) == [w for w in want if w[2]]


def test_exact_dedup_is_native(spark):
    for frame in (exact_dedup.exact_dedup(docs_of(spark, ODD)), exact_dedup.keep_one(docs_of(spark, ODD))):
        assert not re.search("Python|Arrow|Pandas", frame._jdf.queryExecution().toString())


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracles(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    cur = con.execute(registry.ORACLES[name])
    names = [c[0] for c in cur.description]
    frame = registry.QUERIES[name](spark, SF)
    assert sorted(names) == sorted(frame.columns)
    assert sorted(tuple(r[n] for n in names) for r in frame.collect()) == sorted(cur.fetchall())


def shingles_by_hand(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(t))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components_by_hand(nodes, links):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def near_rows(seed=3, base_words=60):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    rows, n = [], itertools.count(10)
    for _ in range(4):  # groups around a text, whose members differ from each other more than from it
        text = [word() for _ in range(base_words)]
        for _ in range(60):
            t = list(text)
            for _ in range(rnd.choice((0, 1, 1, 2))):
                t[rnd.randrange(len(t))] = word()
            rows.append((next(n), " ".join(t)))
    rnd.shuffle(rows)
    return [*rows, *ODD, (3000, "one two"), (3001, "ONE  two"), (3002, "one")]


@pytest.mark.parametrize("block", [256, 8])
def test_near_dedup(spark, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rows = near_rows()
    sets = {i: shingles_by_hand(t) for i, t in rows if i is not None}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    want = components_by_hand(sets, links)
    assert len(links) > 500
    got = near_dedup.near_dedup(docs_of(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.component_id, r.n_shingles, r.kept) == (want[r.doc_id], len(sets[r.doc_id]), r.doc_id == want[r.doc_id])


def test_near_dedup_splits_hot_buckets(spark):
    """20,000 members of one bucket that no other band brings together: rows in proportion to them, and no comparison."""
    at, n = near_dedup.Threshold(85), 20_000
    minima = np.random.default_rng(4).integers(0, 2**32, (n, at.hashes), np.uint32)
    minima[:, :5] = 7
    minima[1] = minima[0]  # but for these two
    reps = spark.createDataFrame([(i, 50, m.astype("<u4").tobytes()) for i, m in enumerate(minima)], "doc_id long, n_shingles long, minima binary").cache()
    members = near_dedup._bands(reps, at.bands).withColumn("component", near_dedup.F.col("doc_id")).filter("band = 0")
    opened = near_dedup._open(members.withColumn("also", near_dedup.F.lit(-1)).join(reps.select("doc_id", "n_shingles"), "doc_id"))
    assert opened.count() == n
    split = near_dedup._split(opened.join(reps.select("doc_id", "minima"), "doc_id"), at.bands)
    assert split.count() == n * (at.bands - 1)
    assert {r.doc_id for r in near_dedup._blocks(near_dedup._open(split)).collect()} == {0, 1}
    docs = docs_of(spark, [(0, "same words of two texts here"), (1, "same words of two texts here")])
    assert [tuple(r) for r in near_dedup._late_links(members, reps, docs, at).collect()] == [(0, 1)]


def test_near_dedup_empty(spark):
    assert near_dedup.near_dedup(docs_of(spark, [])).count() == 0
    assert near_dedup.keep_one(docs_of(spark, [(1, "a"), (2, None)])).count() == 2


def test_components(spark):
    rnd = random.Random(1)
    links = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)] + [(1000, 1001 + i) for i in range(500)] + [(i, i + 1) for i in range(2000, 2040)]
    want = components_by_hand({x for e in links for x in e}, links)
    frame = spark.createDataFrame([*links, (None, 3)], "u long, v long")
    got = {r.node: r.component for r in components.connected_components(frame).collect()}
    assert got == {n: c for n, c in want.items() if n != c}
    assert components.connected_components(frame.limit(0)).count() == 0


def edits_at_most_one(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def lines_alike(v, w):
    if v == w:
        return True
    if max(len(v), len(w)) < 5:
        v, w = " ".join(v), " ".join(w)
    return max(len(v), len(w)) >= 5 and edits_at_most_one(v, w)


def lines_by_hand(rows):
    occurrences = [((i is not None, i or 0), i, k, tuple(line.split())) for i, t in rows for k, line in enumerate((t or "").split("\n"))]
    out = []
    for at, i, k, w in occurrences:
        near = [(a, n, j) for a, j, n, v in occurrences if w and v and lines_alike(v, w)]
        a, n, j = min(near, default=(at, k, i), key=lambda x: x[:2])
        out.append((i, k, (i, k) == (j, n), j, n))
    return out


def test_line_dedup(spark):
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("ab") for _ in range(rnd.randrange(1, 4)))
    mixed = [(300 + i, "\n".join(" ".join(word() for _ in range(rnd.choice((0, 1, 1, 2, 3, 4, 5, 6)))) for _ in range(4))) for i in range(60)]
    rows = [
        (5, "a b c d e f\nx y"), (2, "a b c d e g\n\nx y"), (9, "a b c d e\n a  b\tc d e f "), (7, "q w e r t y u\nq w e r t y\nq w r t y u"),
        (11, "b c d e f\none two three four five"), (12, "zero one two three four five\none two three four"), (1, None), (None, "a b c d e z"), (13, "a a a a a\na a a a a a"),
        (14, "Read more\nread more\nRead mores\n\u00e9\u00e9\U0001f600 \u4e2d"), (15, "Read  more\nRad more\nabcd\nabce\nabcde\nabcdf\n\u00e9\u00e9\U0001f601 \u4e2d"), (16, "a b c dd\na b c d"),
        (17, "twice the same row of words\nand more"), (17, "twice the same row of words\nand more"), *mixed,
        *[(100 + i, f"same words but number {i} here") for i in range(40)],
    ]
    got = [tuple(r) for r in line_dedup.line_dedup(docs_of(spark, rows)).collect()]
    assert sorted(got, key=repr) == sorted(lines_by_hand(rows), key=repr)
    frame = line_dedup.line_dedup(docs_of(spark, rows[:3]))
    assert not re.search("Python|Arrow|Pandas", frame._jdf.queryExecution().toString())
    assert line_dedup.line_dedup(docs_of(spark, [])).count() == 0


def test_line_dedup_of_very_long_lines(spark):
    words = [f"w{i}" for i in range(100_000)]
    less, other, chars = [*words[:70_000], *words[70_001:]], [*words[:10], "x", *words[11:]], "abcdefghij" * 30_000
    rows = [(1, " ".join(words)), (2, " ".join(less)), (3, " ".join(other)), (4, " ".join(words[:-2])), (5, chars), (6, chars + "k"), (7, "b" + chars + "k"), (8, "same " * 100_000), (9, "same " * 100_001)]
    got = {r.doc_id: r.keep_doc_id for r in line_dedup.line_dedup(docs_of(spark, rows)).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 5, 7: 6, 8: 8, 9: 8}


STRANGE = ["", "It's  we'll x \x1c\x85", "<|endoftext|> and <|startoftext|>", "Ünï ﬁ ǅ İ ΑΣ 中文 é", "a" * 5000, "!!'s ''t 1234 ½ ²", "\U0001f600‍ x", "tab\t\n\r\n  end  "]


def texts(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    return [*rows, *[(10_000 + i, t) for i, t in enumerate(STRANGE)], (20_000, None), (None, "null id"), (20_001, "long text " * 40_000)]


def test_token_counts(spark):
    from tokenizers import Tokenizer

    rows, path = texts(spark), token_counts.vocabulary()
    library = Tokenizer.from_file(path)
    want = sorted((str(i), len((t or "").encode()), n, n > 2048) for i, t in rows for n in [len(library.encode(t or "", add_special_tokens=False).ids)])
    got = token_counts.count_tokens(docs_of(spark, rows), path).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in got) == want
    assert token_counts.count_tokens(docs_of(spark, []), path).count() == 0


def test_token_counts_of_strange_texts():
    """Pieces with characters that aren't proved go to the library, the rest of their text doesn't."""
    counter = token_counts.counter(token_counts.vocabulary())
    rnd = random.Random(6)
    signs = ["the ", "It's ", "\u0441\u043b\u043e\u0432\u043e ", "\u4e2d\u6587", "\U0001f600", "\u03a3", "\u03b1\u03a3 ", "e\u0301", " \u0301", "\u200d", "\xa0", "\u2028", "\x85", "\t", "\n", "'s", "1\u0661", "\u0130", "\ufb01", " ", "x", "<|end"]
    texts = ["".join(rnd.choice(signs) for _ in range(rnd.randrange(14))) for _ in range(4000)]
    want = [len(x) for x in counter._encoded(texts)]
    assert [counter.count(t) for t in texts] == want
    seen, asked = [], counter._encoded
    counter._encoded = lambda texts: seen.extend(texts) or asked(texts)
    try:
        counter.count("plain words and \u0436\u0443\u043a\u0438zz, then plain words")
    finally:
        del counter._encoded
    assert seen in ([], ["\u0436\u0443\u043a\u0438zz,"])


def test_chat_of_long_texts_in_bounded_memory():
    """256 texts of 100 KB: what is allocated beside the input and its copy doesn't multiply with them."""
    text = pa.array([f"{i} <s> [INST] \u00e9" + "long text " * 10_000 for i in range(256)])
    conv, role = pa.array([1] * 256, pa.int64()), pa.array(["user", "assistant"] * 128)
    tracemalloc.start()
    batch = pa.RecordBatch.from_arrays([conv, role, text], ["conv_id", "role", "text"])
    out = list(chat._format(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60 << 20
    digest = chat._Digest(1)
    for part in out:
        for formatted, starts, ends in zip(part.column("formatted").to_pylist(), part.column("loss_start").to_pylist(), part.column("loss_end").to_pylist(), strict=True):
            digest.add(formatted, starts, ends)
    assert digest.n_turns == 256 and digest.loss.hexdigest() == hashlib.sha256("".join(text.to_pylist()[1::2]).encode()).hexdigest()


class _Cluster:
    """As much of a session as looking for the checkpoint folder needs."""

    def __init__(self, master, **conf):
        self.sparkContext, self.conf, self.master, self.folder = self, conf, master, None

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


def test_checkpoints_need_a_shared_folder_on_a_cluster():
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            common.ensure_checkpoint_dir(_Cluster(master))
        named = _Cluster(master, **{"spark.checkpoint.dir": "hdfs://shared/folder"})
        common.ensure_checkpoint_dir(named)
        assert named.folder == "hdfs://shared/folder"


def test_checkpoints_are_deleted_when_used_up(spark):
    frame = common.cut(spark.range(5))
    folder = frame._jdf.queryExecution().analyzed().rdd().getCheckpointFile().get().removeprefix("file:")
    assert os.path.isdir(folder) and frame.count() == 5
    common.used_up(frame)
    assert not os.path.exists(folder)


def test_batch_lengths_of_the_session_are_left_alone(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.getAll.get(key)
    spark.conf.set(key, "77")
    try:
        assert html_text.extract(spark.createDataFrame([(1, "u", "x")], "page_id long, url string, html string")).count() == 1
        assert spark.conf.get(key) == "77"
    finally:
        spark.conf.set(key, old) if old else spark.conf.unset(key)


def test_slices_are_bounded_in_rows_and_bytes():
    rows = ["x" * n for n in (10, 5_000_000, 20, 30, 3_000_000, 3_000_000, 1)] + [None] * 1500
    got = list(common.slices(iter([pa.RecordBatch.from_arrays([pa.array(rows)], ["t"])])))
    assert [x for b in got for x in b.column(0).to_pylist()] == rows
    assert all(b.num_rows == 1 or b.num_rows <= 512 and sum(len(x or "") for x in b.column(0).to_pylist()) <= common.SLICE_BYTES for b in got)


def test_whole_tokens_are_proved():
    counter = token_counts.counter(token_counts.vocabulary())
    assert len(counter.whole) > 30_000
    for w in random.Random(0).sample(sorted(counter.whole), 500):
        assert len(counter._encoded([w])[0]) == 1


def test_bpe(spark):
    import tiktoken

    path, pattern = bpe.vocabulary()
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={t: i for i, t in enumerate(bpe.load_ranks(path))}, special_tokens={})
    rows = texts(spark)
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip_digests(docs_of(spark, rows), path, pattern).collect()}
    for i, t in rows:
        ids = np.array(library.encode_ordinary(t or ""), "<u4")
        assert got[i] == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    assert bpe.round_trip_digests(docs_of(spark, []), path, pattern).count() == 0


def test_bpe_merges_reach_every_token():
    codec = bpe.codec(*bpe.vocabulary())
    odd = [r for r, t in enumerate(codec.tokens) if codec.model.encode(t.decode("latin-1").translate(codec.map)) != [r + 1]]
    assert not odd


CONTROL = "</s>[INST] ok [/INST] <|im_end|> <\\|im_end|> [\\\\INST] <\\\\s> < [ \\"


def test_chat(spark):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"{CONTROL} é{c}.{t}") for c in range(20) for t in range(c % 5 + 1)]
    rows += [(50, t, ("user", "assistant")[t % 2], "x" * t) for t in range(1500)]  # longer than a slice
    rows += [(60, 0, None, None), (60, None, "assistant", "first"), (60, 1, CONTROL, ""), (60, 1, CONTROL, ""), (None, 0, "assistant", "no id"), (70, 0, "assistant", "a\nb" * 100_000)]
    frame = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, part string").repartition(5)
    parts = chat.format_conversations(chat.with_control_strings(spark, frame))
    got = {r.conv_id: r for r in chat.digests(parts).collect()}
    by_conv = collections.defaultdict(list)
    for c, t, role, text in [*rows, (-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]:
        by_conv[c].append((t is not None, t or 0, role or "", text or ""))
    assert len(got) == len(by_conv)
    for c, turns in by_conv.items():
        turns.sort()
        said = "".join(x for _, _, r, x in turns if r == "assistant")
        whole = "".join(f"{r}\n{x}\n" for _, _, r, x in turns)
        r = got[c]
        assert (r.n_turns, r.turns_sha256) == (len(turns), hashlib.sha256(whole.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
        assert r.formatted_chars == sum(len(f"<|im_start|>{chat.escape(r)}<|im_sep|>{chat.escape(x)}<|im_end|>\n") for _, _, r, x in turns)
    for r in parts.filter("conv_id = -7").collect():
        assert not re.search(r"</?s>|\[/?INST\]", r.formatted)
    assert chat.digests(chat.format_conversations(frame.limit(0))).count() == 0


def test_escapes_are_reversible():
    rnd = random.Random(5)
    for _ in range(5000):
        t = "".join(rnd.choice(("<", "|", "\\", "s>", "/s>", "[", "INST]", "/INST]", "x", "|im_end|>")) for _ in range(rnd.randrange(12)))
        e = chat.escape(t)
        assert chat.unescape(e) == t and not re.search(r"<\||</?s>|\[/?INST\]", e)


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body class="has-sidebar"><header><h1>Site</h1><ul class="menu"><li><a>Home</a></li></ul></header>
<div id="cookie-notice">We use cookies</div><nav><a>x</a><ul><li>y</li></ul></nav><main><article><header><h1>Title &amp; more</h1></header><p>First   para&nbsp;with <a href="x>y">a link</a>.</p>
<div class="ad-slot"><p>buy</p></div><aside>side</aside><ul><li>one<li>two</ul><p>x<!-- no > text --></p><form><input><p>form</p></form><p>Last <b>bold</b> 1 &lt; 2</p></article>
<section id="comments"><div class="comment">great post, a long comment by a reader</div></section></main><footer>(c)</footer><script>if(a<b){"</p>"}</script></body></html>"""


def test_html(spark):
    pages = [
        (1, "u", PAGE, "Title & more\nFirst para with a link.\none\ntwo\nx\nLast bold 1 < 2"), (2, None, None, ""), (None, "u", "", ""), (4, "u", "plain words", "plain words"),
        (4, "u", "<nav><a>x</a>", ""), (5, "u", "<nav>menu<article><p>text of it</article>", "text of it"), (6, "u", "<p>" + "word " * 50_000, " ".join(["word"] * 50_000)),
        (7, "u", "<script>x", ""), (8, "u", "a < b <", "a < b <"), (9, "u", "<article><p>Ü&eacute;</p><p>y</p></article>", "Üé\ny"),
    ]
    frame = spark.createDataFrame([(i, u, h, "t") for i, u, h, _ in pages], "page_id long, url string, html string, text string").repartition(3)
    got = [tuple(r) for r in html_text.extract(frame).collect()]
    assert sorted(got, key=repr) == sorted(((i, u, t, len(t)) for i, u, _, t in pages), key=repr)
    assert html_text.extract(frame.limit(0)).count() == 0


@pytest.mark.parametrize(
    "page, want",
    [
        ("<div><a>Home</a> <a>News</a></div><div><h1>Title here</h1><div>First part of some words.</div><div>Second <i>part</i> of it.</div></div>", "Title here\nFirst part of some words.\nSecond part of it."),
        ('<article><h1>A</h1><p>aa bb cc</p></article><article class="comment"><p>I disagree with all of this text and more</p></article>', "A\naa bb cc"),
        ('<div class="wrap no-sidebar has-menu"><p>The text of the page.</p></div><div class="left sidebar"><p>words beside it</p></div>', "The text of the page."),
        ('<body class="search"><article class="post category-news has-comments"><p>Words of it.</p><div class="share-buttons">Share!</div></article></body>', "Words of it."),
        ('<div id="header"><h1>Site name</h1><p>The best site of all for you</p></div><div><div class="entry-header"><h1>The title</h1></div><p>Words of the text.</p></div>', "The title\nWords of the text."),
        ('<div class="page"><div class="article"><p>first second third</p></div><div class="right-rail"><p>Other stories you might like</p></div></div>', "first second third"),
    ],
)
def test_html_of_other_layouts(page, want):
    assert html_text.main_text(page) == want


def test_html_of_test_pages(spark):
    rows = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r.text for r in registry.QUERIES["op1_html_text"](spark, SF).collect()}
    for r in rows.collect():
        body = re.sub(r"</?b>", "", re.search(r"<article>(.*?)(</article>|\Z)", r.html, re.DOTALL)[1]).replace("<br>", " ")
        blocks = [" ".join(html.unescape(b).split()) for b in re.split(r"</?(?:p|h1)>", body)]
        assert got[r.page_id] == "\n".join(b for b in blocks if b)


def align_by_hand(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
        table[i][j] = max(0, table[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), table[i - 1][j] - 1, table[i][j - 1] - 1)
    return max(map(max, table))


def test_decontamination(spark):
    rnd = random.Random(2)
    vocabulary = [f"w{i}" for i in range(80)]
    words = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    items = [(i, words(n)) for i, n in enumerate((12, 30, 45, 3, 20))]
    rows = []
    for i in range(150):
        t = words(rnd.randrange(5, 60))
        if i % 2:
            copy = list(rnd.choice(items)[1])
            for _ in range(rnd.randrange(0, max(1, len(copy) // 4))):
                p = rnd.randrange(len(copy))
                copy[p : p + 1] = rnd.choice(([], [rnd.choice(vocabulary)], [copy[p], "new"]))
            t = [*t[: len(t) // 2], *copy, *t[len(t) // 2 :]]
        rows.append((i, " ".join(w.upper() if rnd.random() < 0.1 else w + rnd.choice(("", "", ",", '."')) for w in t)))
    clean = lambda t: [re.sub(r"^\W+|\W+$", "", w) for w in t.lower().split()]
    want = {(i, k) for i, t in rows for k, w in items if align_by_hand(w, clean(t)) >= decontamination.SCORE * 2 * len(w)}
    benchmark = spark.createDataFrame([*[(k, " ".join(w), "x") for k, w in items], (0, " ".join(items[0][1]), "again"), (90, None, "x"), (91, "two words", "x")], "item_id long, text string, score string")
    odd = [(1000, None), (None, ""), (1001, "w1"), (1002, "." * 100_000)]
    found = [(r.doc_id, r.item_id) for r in decontamination.leaks(docs_of(spark, rows + odd), benchmark).collect()]
    got = set(found)
    assert len(found) == len(got) and got <= want and len(want) > 40
    # what the guarantee for 20 % of edits covers; beyond it, an alignment may still reach the score without two seeds
    sure = {(i, k) for i, k in want if align_by_hand(dict(items)[k], clean(dict(rows)[i])) >= 2 * len(dict(items)[k]) - 3 * int(0.2 * len(dict(items)[k])) + 2}
    assert sure <= got
    kept = decontamination.keep_clean(docs_of(spark, rows + odd), benchmark)
    assert kept.columns == docs_of(spark, []).columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i, _ in rows + odd if i not in {d for d, _ in got})
    assert decontamination.leaks(docs_of(spark, rows), benchmark.limit(0)).count() == 0
    assert decontamination.leaks(docs_of(spark, []), benchmark).count() == 0


def planted(rnd, vocabulary, sizes, shares, times):
    """Items, and documents that hold a copy of one of which a share of the words is substituted."""
    items = [[rnd.choice(vocabulary) for _ in range(n)] for n in sizes]
    rows = []
    for k, share in itertools.product(range(len(items)), shares):
        for _ in range(times):
            copy = list(items[k])
            for p in rnd.sample(range(len(copy)), round(share * len(copy))):
                copy[p] = rnd.choice(vocabulary) + "x"
            around = [[rnd.choice(vocabulary) for _ in range(rnd.randrange(40))] for _ in range(2)]
            rows.append((len(rows), " ".join([*around[0], *copy, *around[1]])))
    return [(k, " ".join(w)) for k, w in enumerate(items)], rows


def test_decontamination_recall(spark):
    """Against Smith-Waterman of every item with every document: all up to 20 % of substituted words, nine in ten beyond."""
    rnd = random.Random(12)
    vocabulary = [f"w{i}" for i in range(400)]
    items, rows = planted(rnd, vocabulary, (8, 11, 15, 24, 40, 80), (0, 0.1, 0.2, 0.25, 0.3), 8)
    cache = decontamination._Words()
    hashed = {k: decontamination.word_hashes(t, cache) for k, t in items}
    want = set()
    for i, t in rows:
        w = decontamination.word_hashes(t, cache)
        want |= {(i, k) for k, own in hashed.items() if decontamination.align(own, w)[0] >= min(1.4 * len(own), 100)}
    got = {(r.doc_id, r.item_id) for r in decontamination.leaks(docs_of(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    sure = {(i, i // 40) for i, _ in rows if i % 40 < 24}  # up to 20 %
    assert got <= want and sure & want <= got and len(want) > 130
    assert len(got) >= 0.95 * len(want)


def test_decontamination_equals_alignment_of_all(spark):
    docs, benchmark = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    cache = decontamination._Words()
    items = [(r.item_id, decontamination.word_hashes(r.text or "", cache)) for r in benchmark.collect()]
    want = set()
    for r in docs.collect():
        w = decontamination.word_hashes(r.text or "", cache)
        want |= {(r.doc_id, k) for k, own in items if len(own) >= 3 and len(np.intersect1d(own, w)) > 0.5 * len(set(own.tolist())) and decontamination.align(own, w)[0] >= min(1.4 * len(own), 100)}
    assert {(r.doc_id, r.item_id) for r in decontamination.leaks(docs, benchmark).collect()} == want and want


def test_decontamination_of_repetitive_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "PAIRS", 4)
    one = "the same word again and again "
    items = [(0, "echo " * 400), (1, one * 20), *[(10 + i, f"a template with many words of which number {i} differs only") for i in range(20)], (50, " ".join(f"u{i}" for i in range(160)))]
    rows = [(1, "echo " * 40_000), (2, one * 2000), (3, "x " * 2_500_000), (4, f"so {items[7][1]} it is"), (4, "clean row of that id"), (None, items[7][1]), (5, " ".join(f"u{i}" for i in range(40, 100))), (6, " ".join(f"u{i}" for i in range(40, 80)))]
    got = {(r.doc_id, r.item_id) for r in decontamination.leaks(docs_of(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(1, 0), (2, 1), (5, 50), *[(d, 10 + i) for d in (4, None) for i in range(20)]}


def test_toxicity(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    toxic = {r.doc_id: r.toxic for r in labels.collect()}
    model = toxicity.fit(docs, labels.filter("doc_id % 2 = 0"))
    rows = toxicity.score(docs, model).collect()
    held = [r for r in rows if r.doc_id in toxic and r.doc_id % 2]
    assert sum(r.kept for r in held if not toxic[r.doc_id]) >= 0.98 * sum(not toxic[r.doc_id] for r in held)
    assert sum(not r.kept for r in held if toxic[r.doc_id]) >= 0.7 * sum(toxic[r.doc_id] for r in held)
    assert model.thresholds[0] < model.thresholds[1]
    kept = toxicity.keep_clean(docs, labels.filter("doc_id % 2 = 0"))
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in rows if r.kept}


def toxicity_problem():
    rnd = random.Random(8)
    rows = [sorted(rnd.sample(range(12), rnd.randrange(6))) for _ in range(200)]
    return toxicity.Problem(12, rows, np.array([int(sum(r) > rnd.randrange(30)) for r in rows]), np.array([float(rnd.randrange(1, 4)) for _ in rows]), 1e-3), rows


def test_toxicity_gradient_and_optimum():
    """The gradient against finite differences, the fit against gradient descent with a line search."""
    problem, rows = toxicity_problem()
    rng = np.random.default_rng(0)
    for _ in range(5):
        state = rng.normal(size=14)
        _, grad = problem.loss(state)
        for i in range(14):
            step = np.zeros(14)
            step[i] = 1e-5
            assert abs((problem.loss(state + step)[0] - problem.loss(state - step)[0]) / 2e-5 - grad[i]) < 1e-6
    state = problem.start()
    for _ in range(20_000):
        value, grad = problem.loss(state)
        size = 8.0
        while problem.loss(state - size * grad)[0] > value - 0.3 * size * (grad**2).sum() and size > 1e-9:
            size /= 2
        state = state - size * grad
        if np.abs(grad).max() < 1e-7:
            break
    names = [str(i) for i in range(12)]
    toxic, times = (problem.grade > 0).astype(int), problem.share * 1000
    model = toxicity._fit(names, rows, toxic, np.round(times), 3000, 1e-3)
    again = toxicity.Problem(12, rows, toxic, np.round(times), 1e-3)
    assert again.loss(np.array([*model.weights.values(), model.thresholds[0], np.log(model.thresholds[1] - model.thresholds[0])]))[0] < again.loss(state)[0] + 1e-4


def test_expected_severity_by_hand():
    model = toxicity.Model({"bad$": 2.0, "wor": 1.5, "worse$": 1.0}, (1.0, 3.0))
    s = lambda x: 1 / (1 + np.exp(-x))
    assert model.present("Bad, WORSE bad good") == {"bad$", "wor", "worse$"}
    assert np.allclose(model.tail("Bad, WORSE bad good"), [s(3.5), s(1.5)]) and np.allclose(model.tail("work"), [s(0.5), s(-1.5)])


def test_fits_are_bounded_by_labels(spark):
    """Ids that repeat in documents give one row each; more labels than the sample holds are cut down to it."""
    docs = docs_of(spark, [(1, f"text {i}") for i in range(3000)] + [(i, f"words {i}") for i in range(2, 400)] + [(None, "no id")])
    labels = spark.createDataFrame([(i, i % 2, i % 3 % 2) for i in range(400)] + [(None, 1, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.training_rows(docs, labels).count() == 399 and toxicity.training_rows(docs, labels, 50).count() in (49, 50)  # document 0 is missing
    ours = sum(1 for i in range(1, 400) if zlib.crc32(str(i).encode()) % 5)
    assert quality.training_rows(docs, labels).count() == ours and quality.training_rows(docs, labels, 50).count() in (49, 50)


def test_quality_solves_the_ridge_on_all_rows(spark):
    """The partition-summed normal equations against one dense least-squares problem over all training rows."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels)
    marks = {r.doc_id: float(r.quality > 0) for r in labels.collect()}
    rows = [(quality.statistics(r.text or ""), marks[r.doc_id], zlib.crc32(str(r.doc_id).encode()) % 5) for r in docs.collect() if r.doc_id in marks]
    x, y = np.array([s for s, _, p in rows if p > 1]), np.array([q for _, q, p in rows if p > 1])
    assert np.allclose(model.mean, x.mean(0)) and np.allclose(model.scale, np.maximum(x.std(0), 1e-6))
    z = model.cosines(x)
    ridge = np.sqrt(quality.RIDGE * len(z)) * np.eye(z.shape[1])[:-1]  # the constant isn't shrunk
    want = np.linalg.lstsq(np.vstack([z, ridge]), np.concatenate([y, np.zeros(len(ridge))]), rcond=None)[0]
    assert np.allclose(z @ model.weights, z @ want, atol=1e-5)
    exact = np.exp(-((x[:40, None] - x[None, :40]) ** 2 / model.scale**2).sum(2) / 2 / x.shape[1])
    inside = (np.abs((x[:40] - model.mean) / model.scale) <= 8).all(axis=1)
    near = z[:40, :-1] @ z[:40, :-1].T
    assert np.abs(near - exact)[np.ix_(inside, inside)].mean() < 0.08
    raw = model.raw(np.array([s for s, _, p in rows if p == 1]))
    held = np.array([q for _, q, p in rows if p == 1])
    assert np.allclose(np.interp(raw, *model.steps), np.interp(raw, *quality.isotonic(raw, held)))


def test_toxicity_odd(spark):
    labels = spark.createDataFrame([(1, None), (None, 1), (2, 0)], "doc_id long, toxic int")
    model = toxicity.fit(docs_of(spark, ODD), labels)
    rows = toxicity.score(docs_of(spark, ODD), model).collect()
    assert len(rows) == len(ODD) and all(r.kept and r.expected_severity == 0 for r in rows)
    both = spark.createDataFrame([(i, int(i > 5)) for i in range(1, 10)] + [(1, 0)], "doc_id long, toxic int")
    assert toxicity.score(docs_of(spark, ODD), toxicity.fit(docs_of(spark, ODD), both)).count() == len(ODD)
    assert toxicity.score(docs_of(spark, []), toxicity.fit(docs_of(spark, []), both)).count() == 0


def test_quality(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    good = {r.doc_id: r.quality for r in labels.collect()}
    rows = [r for r in registry.QUERIES["op10_quality"](spark, "/root/testdata/sf0.01").collect()]
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in good]
    assert sum(r.predicted == good[r.doc_id] for r in held) >= 0.95 * len(held)


def test_quality_odd(spark):
    for marks in ([], [(1, 1)], [(1, 1), (2, 0), (3, 1), (5, 0), (6, 1), (7, 0), (7, 1), (8, None)]):
        labels = spark.createDataFrame(marks, "doc_id long, quality int")
        rows = quality.score(docs_of(spark, ODD), quality.fit(docs_of(spark, ODD), labels)).collect()
        assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    assert quality.score(docs_of(spark, []), quality.fit(docs_of(spark, []), labels)).count() == 0


def test_isotonic():
    x, y = np.array([1.0, 2, 2, 3, 4]), np.array([0.0, 1, 0, 0, 1])
    ends, values = quality.isotonic(x, y)
    assert np.allclose(np.interp([1, 2, 3, 4], ends, values), [0, 1 / 3, 1 / 3, 1])


def test_pipeline(spark):
    """Each stage against its own input, worked out by hand or by the library."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept.append(stage(spark, kept[-1], SF).cache())
        assert kept[-1].columns == docs.columns
    rows = [[(r.doc_id, r.text) for r in k.collect()] for k in kept]
    gone = {i for i, _ in rows[0]} - {i for i, _ in rows[1]}
    assert sum(labels.get(i) == 0 for i in gone) <= 1
    assert sorted(i for i, _ in rows[2]) == sorted(r[0] for r in dedup_by_hand(rows[1]) if r[3])
    sets = {i: shingles_by_hand(t) for i, t in rows[2]}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    assert sorted(i for i, _ in rows[3]) == sorted(i for i, c in components_by_hand(sets, links).items() if i == c)
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert {i for i, _ in rows[3]} - {i for i, _ in rows[4]} >= {i for i, t in rows[3] if any(x in t for x in items)}
    got = corpus_pipeline.run(spark, SF).collect()
    assert sorted((r.doc_id, r.decoded_sha256) for r in got) == sorted((i, hashlib.sha256(t.encode()).hexdigest()) for i, t in rows[4])


def test_pipeline_on_odd_rows(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for name, rows in (("odd", [(i, t, None, None, None) for i, t in ODD]), ("none", [])):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        spark.createDataFrame([(1, None)], "item_id long, text string").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
        got = sorted(str(r.doc_id) for r in corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect())
        assert got == (["2", "4", "5", "6", "7", "9"] if rows else [])


def near_copies(seed=11):
    """Pairs of texts whose similarity goes from about 0.7 to 0.95."""
    rnd = random.Random(seed)
    rows, n = [], itertools.count(1)
    for i in range(60):
        text = ["".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(300)]
        copy = list(text)
        for p in rnd.sample(range(0, 300, 6), 2 + i % 10):
            copy[p] = "changed"
        rows += [(next(n), " ".join(text)), (next(n), " ".join(copy))]
    return rows


def test_near_dedup_at_another_threshold(spark):
    rows = near_copies()
    sets = {i: shingles_by_hand(t) for i, t in rows}
    shares = {(a, b): 100 * len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in itertools.combinations(sets, 2)}
    assert sum(80 <= x < 85 for x in shares.values()) >= 5 and sum(60 < x < 80 for x in shares.values()) >= 5
    for percent in (85, 80):
        want = components_by_hand(sets, [e for e, x in shares.items() if x >= percent])
        assert {r.doc_id: r.component_id for r in near_dedup.near_dedup(docs_of(spark, rows), percent).collect()} == want
    kept = {r.doc_id for r in near_dedup.keep_one(docs_of(spark, rows), 80).collect()}
    assert kept == {i for i, c in want.items() if i == c}


def test_rows_that_share_a_doc_id_are_dropped_one_by_one(spark):
    item = "who was the first to cross the wide river on foot in winter"
    rows = [(None, "A copy"), (1, "a copy"), (None, "alone"), (None, None), (2, "a COPY"), (2, "text of its own"), (1, "other text"), (3, item), (3, "clean é"), (None, f"x {item} y"), (4, item)]
    by_id = lambda frame: sorted(((r.doc_id, r.text) for r in frame.collect()), key=repr)
    query = exact_dedup.exact_dedup(docs_of(spark, rows)).filter("kept").select("doc_id", "text_sha256").collect()
    kept = exact_dedup.keep_one(docs_of(spark, rows))
    assert by_id(kept) == sorted([r for r, d in zip(rows, dedup_by_hand(rows), strict=True) if d[3]], key=repr)
    assert sorted(map(repr, query)) == sorted(repr(r) for r in kept.select("doc_id", exact_dedup.sha256_of(exact_dedup.ascii_lower(exact_dedup.F.coalesce("text", exact_dedup.F.lit("")))).alias("text_sha256")).collect())
    benchmark = spark.createDataFrame([(0, item)], "item_id long, text string")
    assert by_id(decontamination.keep_clean(docs_of(spark, rows), benchmark)) == sorted([r for r in rows if item not in (r[1] or "")], key=repr)
    assert decontamination.leaks(docs_of(spark, rows), benchmark).columns == ["doc_id", "item_id", "score", "end_word"]


@pytest.mark.parametrize(
    "page, want",
    [
        ('<article><h1>T</h1><h2 id="In_popular_culture">In popular culture</h2><p id="share">aa bb</p><h2 id="Legal_issues" class="search">Legal issues</h2><p class="related">cc</p></article>', "T\nIn popular culture\naa bb\nLegal issues\ncc"),
        ('<article><p>aa bb</p><section id="discussion"><h2>Discussion</h2><p>cc dd <a>ee</a></p></section><section id="related-work"><p>ff gg</p></section></article>', "aa bb\nDiscussion\ncc dd ee\nff gg"),
        ('<article><h2><span class="mw-headline" id="Legal_notices">Law</span></h2><ul><li id="cite-popular">one</li></ul></article>', "Law\none"),
        ('<div class="content-with-sidebar"><h1>Title</h1><p>Words of the page.</p></div>', "Title\nWords of the page."),
        ('<div><h2 id="In_popular_culture">A heading</h2><p>Words of the text go on</p><section id="legal-issues"><p>and more of them</p></section></div>', "A heading\nWords of the text go on\nand more of them"),
        ('<article><p>aa bb cc</p><div class="related">See <a>one story</a> <a>two stories</a></div><section id="popular"><ul><li><a>x</a></li></ul></section><div id="comments"><p>I disagree</p></div><p>dd</p></article>', "aa bb cc\ndd"),
        ('<article><p>aa bb cc</p><div class="ad-slot"><p>buy</p></div><div id="ad-2">buy</div><div class="cookie-notice">We use</div><div class="newsletter">join us</div><p>dd</p></article>', "aa bb cc\ndd"),
    ],
)
def test_html_marks_that_name_a_topic(page, want):
    assert html_text.main_text(page) == want


@pytest.mark.parametrize(
    "page, want",
    [
        ("<article><h1>T</h1><p>the main words of the page</p></article><aside><h3>Related</h3><article>teaser</article></aside>", "T\nthe main words of the page"),
        ('<article><p>aa bb cc dd</p></article><section id="comments"><article id="c1">a reader\'s comment that is long enough to count</article></section>', "aa bb cc dd"),
        ('<article><p class="notice-of-motion">aa bb</p><h2 class="share-price">cc</h2><ul class="menu-items"><li>dd</li></ul></article>', "aa bb\ncc\ndd"),
        ("<div><p>first half of the text is here</p><p><a>one link</a> <a>two links</a> <a>three links</a> <a>four links</a></p><p>second half of it is here</p></div>", "first half of the text is here\none link two links three links four links\nsecond half of it is here"),
        ('<div class="sidebar-first"><article><p>most of the words of this page are here</p></article></div><div class="sidebar"><p>few here</p></div>', "most of the words of this page are here"),
        ("<div><nav><ul><li><a>x</a></li></ul></nav><p>Words of a page without an article</p><footer>a long footer with the words of the publisher</footer></div>", "Words of a page without an article"),
    ],
)
def test_html_of_nested_and_parted_content(page, want):
    assert html_text.main_text(page) == want


def best_by_hand(scores):
    runs = [(i, j) for i in range(len(scores)) for j in range(i, len(scores))]
    return max((sum(scores[i : j + 1]) for i, j in runs), default=0.0)


def test_best_run_against_all_runs(spark):
    rnd = random.Random(3)
    cases = [[rnd.choice((-3, -2, -1, 0, 1, 2)) for _ in range(rnd.randrange(12))] for _ in range(3000)]
    cases += [html_text.pieces(r.html).scores[:150] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    for scores in cases:
        run, best = html_text.best_run(scores), best_by_hand(scores)
        if run is None:
            assert best <= 0
        else:
            i, j = run
            assert abs(sum(scores[i : j + 1]) - best) < 1e-9 and best > 0 and scores[i] > 0 and scores[j] > 0


def test_the_scan_decides(spark):
    """Without it, as a run of all events, nearly every page has more in its text."""
    pages = [html_text.pieces(r.html) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    changed = [html_text.text_of(x, (0, len(x.scores) - 1)) != html_text.text_of(x, html_text.best_run(x.scores)) for x in pages]
    assert sum(changed) > 0.9 * len(pages)


def test_weights_of_labelled_pages():
    known = html_text.weights()
    assert known.words["word"] > 0 > max(known.words["link"], known.words["told"]) and all(v < 0 for v in known.tags.values())
    assert known.tags["a"] < known.tags["div"] and known.tags["li~"] < known.tags["li"] and known.tags["div~"] < known.tags["div"]
    for page in html_text.LABELLED:
        want = " ".join(" ".join(re.sub(r"<[^>]*>", " ", x) for x in re.findall(r"<!--\[-->(.*?)<!--\]-->", page, re.DOTALL)).split())
        assert " ".join(html_text.main_text(page).split()) == want


def test_html_of_deeply_nested_marks():
    assert html_text.main_text("<article>" + '<div class="share">' * 30_000 + "words of it").split() == ["words", "of", "it"]
