"""The operators of quire.llm against brute force, oracles and odd tables."""

import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quire.llm import (chat, components, decontaminate, html_text, packing, quality_classifier, quality_rules, queries,
                       simhash, substring_dedup, toxicity, url_filter)
from quire.sources.tables import TABLES, table
from tests.conftest import SF_SMALL
from tests.llm import brute

PROSE = ("the quick brown fox jumps over the lazy dog while nobody in the old town looks at it and then "
         "some more words follow until the text is long enough to count as a document of its own")
ODD_TEXTS = [None, "", "  \n\t ", "word", PROSE, PROSE, PROSE + " with a tail", "a b c d e f g h i j k l m " * 40,
             "é" * 50 + " ünï \x85 \xa0 x", "\n\nline\nline\n\nline", "w " * 30000, PROSE.upper(), "<|endoftext|> a  b \n c "]
CLASH = ["row", "id", "key", "words", "n_words", "kept", "score", "spans", "start", "length", "rank", "host", "fp", "a.b"]


def odd_docs(spark, empty=False):
    """Nulls in every column, empty and long texts, ties, repeated rows and
    extra columns named like work and result columns."""
    rows = [(i, t, None if i % 4 == 0 else "en", None if i % 3 == 0 else "s", None if i % 5 == 0 else 3) for i, t in
            enumerate(ODD_TEXTS)]
    rows += [rows[4], rows[4], (None, PROSE, None, None, None), (None, None, None, None, None)]
    df = spark.createDataFrame([] if empty else rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit("clash") for c in CLASH})


def plain(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SF_SMALL, "documents")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF_SMALL}/{t}.parquet')")
    got = queries.QUERIES[name](spark, SF_SMALL)
    cols = sorted(got.columns)
    want = con.execute(f"select {','.join(cols)} from ({queries.ORACLES[name]})").fetchall()
    key = lambda r: tuple((v is not None, v) for v in r)
    assert sorted(map(key, want)) == sorted(key(tuple(r[c] for c in cols)) for r in got.collect())


# 1 and 10: classifiers

def auc(scores, labels):
    order = np.argsort(np.argsort(scores))
    n1 = sum(labels)
    return (order[np.array(labels) == 1].sum() - n1 * (n1 - 1) / 2) / (n1 * (len(labels) - n1))


@pytest.mark.parametrize("name,label,least", [("op1_toxicity", "toxic", 0.7), ("op10_quality_classifier", "quality", 0.95)])
def test_held_out_accuracy(spark, name, label, least):
    sf = SF_SMALL.replace("0.001", "0.01")
    rows = queries.QUERIES[name](spark, sf).join(table(spark, sf, "labels"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    own = [r for r in rows if r["held_out"]]
    assert auc([r["score"] for r in own], [r[label] for r in own]) >= least
    assert np.mean([r["predicted"] == r[label] for r in own]) >= 0.9


def test_toxicity_learns_words():
    ordinary = [f"{PROSE} number {i} of {i * 7} plain things".encode() for i in range(60)]
    toxic = [f"{PROSE[:40 + i % 9]} {'vile' if i % 2 else 'hideous'} {PROSE[40:]} {i}".encode() for i in range(60)]
    content = toxicity.train_dictionaries(toxic, ordinary)
    assert b"hideous" in content[1] and b"quick" not in content[1] and b"quick" in content[0]
    plain_, both = toxicity.compressor(content[0]), toxicity.compressor(content[1] + content[0])
    bad, good = (toxicity.features(t.encode(), plain_, both)[2] for t in ("you hideous hideous one and that", "you are the fox and that"))
    assert bad > good


def test_toxicity_learns_fixed_phrases_but_no_copies():
    rng = np.random.default_rng(3)
    filler = lambda n: " ".join(f"w{i}" for i in rng.integers(0, 400, n))
    ordinary = [filler(40).encode() for _ in range(200)]
    toxic = [f"rotten foul stinking beast {filler(36)}".encode() for _ in range(200)]
    # a long toxic text, copied 50 times with another ending, whose words no other text has
    copied = " ".join(f"own{i}" for i in range(60))
    content = toxicity.train_dictionaries(toxic + [f"{copied} {i}".encode() for i in range(50)], ordinary)
    assert all(w in content[1] for w in (b"rotten", b"foul", b"stinking", b"beast")) and b"own20" not in content[1]
    model = toxicity.fit(toxic, ordinary)
    pair = toxicity.compressor(model[0]), toxicity.compressor(model[1] + model[0])
    bad, good = (np.dot(toxicity.features(t.encode(), *pair), model[2])
                 for t in (f"{filler(20)} rotten foul stinking beast {filler(20)}", filler(44)))
    assert bad > 0 > good


def test_toxicity_learns_rare_insults():
    """200 insults, each in three toxic texts, with nine ordinary texts for a
    toxic one; a word of one text can't be told from its chance words."""
    rng = np.random.default_rng(4)
    filler = lambda n: " ".join(f"w{i}" for i in rng.integers(0, 400, n))
    insults = ["".join(chr(97 + c) for c in rng.integers(0, 26, 7)) for _ in range(200)]
    ordinary = [filler(40).encode() for _ in range(5400)]
    toxic = [f"{filler(10)} {w} {filler(30)}".encode() for w in insults * 3]
    content = toxicity.train_dictionaries(toxic, ordinary)
    assert sum(w.encode() in content[1] for w in insults) >= 190


def test_prior_and_risk():
    rng = np.random.default_rng(0)
    make = lambda n, at: np.column_stack([rng.normal(at, 1, (n, 2)), np.ones(n)])
    positive, unlabelled = make(1500, 2), np.vstack([make(1400, 2), make(600, -2)])
    prior = quality_classifier.class_prior(positive, unlabelled)
    assert 0.65 <= prior <= 0.78
    w = quality_classifier.fit(positive, unlabelled, prior)
    truth = np.array([1] * 1400 + [0] * 600)
    assert ((unlabelled @ w > 0) == truth).mean() > 0.95


# 2: chat

def test_snapshots(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "bot", "b"), (2, 0, "user", "a"), (3, 0, "user", "a"), (3, 1, "bot", "b"),
            (3, 2, "user", "c"), (4, 0, "user", "x"), (5, 0, "user", "x"), (5, 0, "user", "x"), (6, None, None, None),
            (None, 0, "user", "a"), (7, 0, "user", "a"), (7, 0, "bot", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("nth", F.lit(1))
    got = {r["conv_id"]: r for r in chat.maximal_conversations(df).collect()}
    assert sorted(got) == [3, 4, 6, 7]
    assert got[3]["rendered"] == "".join(chat.TURN.format(role=r, text=t) for r, t in (("user", "a"), ("bot", "b"), ("user", "c")))
    assert got[4]["n_copies"] == 2 and got[6]["rendered"] == chat.TURN.format(role="unknown", text="")
    assert chat.maximal_conversations(df.limit(0)).count() == 0


# 3: decontamination

@pytest.mark.parametrize("block", [1 << 24, 2000])
def test_contamination(spark, docs, block):
    items = table(spark, SF_SMALL, "benchmark").union(spark.createDataFrame(
        [(900, "the"), (901, None), (902, " ... "), (None, PROSE), (903, PROSE[:60]), (903, PROSE[:60])], "item_id long, text string"))
    rows = docs.select("doc_id", "text").union(odd_docs(spark).select("doc_id", "text"))
    got = decontaminate.decontaminate(rows, items, block_bytes=block).collect()
    want = brute.contamination(plain(rows), [(r["item_id"], r["text"]) for r in items.collect()])
    key = lambda r: (r[0] is None, r[0], r[1:])
    assert sorted(map(key, want)) == sorted(key((r["doc_id"], r["n_words"], r["n_hit"], r["items"], r["contaminated"])) for r in got)
    for r in got:
        text = decontaminate.split_words((r["text"] or "").encode())
        for m in r["matches"]:
            assert m["doc_start"] + m["n_words"] <= len(text)


# 4: packing

def test_round_trip(spark, docs):
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(queries.TOKENIZER)
    tokenizer.encode_special_tokens = True
    rows = docs.select("doc_id", "text").union(odd_docs(spark).filter("doc_id is not null").select("doc_id", "text")
                                               .withColumn("doc_id", F.col("doc_id") + 100000).distinct())
    pieces = packing.pack(rows, queries.TOKENIZER, with_ids=True).collect()
    of_doc, of_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        assert p["ids_crc32"] == zlib.crc32(np.array(p["ids"], "<u4").tobytes()) and len(p["ids"]) == p["length"]
        of_doc[p["doc_id"]].append(p)
        of_sequence[p["sequence_id"]].append(p)
    for doc_id, text in plain(rows):
        own = sorted(of_doc[doc_id], key=lambda p: p["start"])
        want = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        assert [x for p in own for x in p["ids"]] == want and {p["doc_tokens"] for p in own} == {len(want)}
    padding = 0
    for own in of_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= packing.WINDOW
        padding += 0 if at & (at - 1) == 0 else packing.WINDOW - at
    assert padding < 0.03 * sum(p["length"] for p in pieces)


def test_added_tokens_get_their_ids(spark, docs, monkeypatch, tmp_path):
    import json

    from tokenizers import AddedToken, Tokenizer
    tokenizer = Tokenizer.from_file(queries.TOKENIZER)
    texts = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>\n\n x", "a  <|endoftext|>  b <|endoftext",
             "no token <|endof text|>", "", *(t for t in ODD_TEXTS if t), PROSE + " <|endoftext|>" * 2000]
    texts += [r["text"] + "<|endoftext|>" + r["text"] for r in docs.limit(20).collect()]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {i: tokenizer.encode(t, add_special_tokens=False).ids + [0] for i, t in enumerate(texts)}
    assert want[0] == [64, 220, 50256, 275, 0]
    monkeypatch.setattr(queries, "table", lambda *a: rows)
    stage = dict(corpus_pipeline.STAGES)["packing"]
    for out in (queries.op4_packing(spark, SF_SMALL), stage(spark, rows, SF_SMALL)):
        got = out.collect()
        assert {p["doc_id"] for p in got} == set(want)
        for p in got:
            ids = want[p["doc_id"]]
            own = np.array(ids[p["start"]:p["start"] + p["length"]], "<u4")
            assert p["doc_tokens"] == len(ids) and p["ids_crc32"] == zlib.crc32(own.tobytes())
    # overlapping added tokens, and one with a flag that only tokenizers knows
    for more in (["<|end", "<|endoftext|>x", "ab"], [AddedToken("ab", lstrip=True)]):
        own = Tokenizer.from_file(queries.TOKENIZER)
        own.add_special_tokens(more)
        path = str(tmp_path / f"{len(more)}.json")
        own.save(path)
        assert json.load(open(path))["added_tokens"]
        encode = packing.encoder(path, added_tokens=True)
        for t in [*texts, "cab ab <|endoftext|>x <|endx", " ab\n  ab"]:
            assert encode(t).tolist() == own.encode(t, add_special_tokens=False).ids


def test_plan_uses_every_piece_once():
    rng = np.random.default_rng(1)
    for n in (1, 7, 300, 20000):
        lengths = rng.integers(1, packing.WINDOW + 1, n)
        have = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True))))
        used = defaultdict(int)
        for pattern, times in packing.plan(have):
            assert sum(pattern) <= packing.WINDOW and times > 0
            for v in pattern:
                used[v] += times
        assert dict(used) == have


# 5: quality rules

def test_quality_rules(spark, docs):
    rows = docs.select("doc_id", "text", "source").union(odd_docs(spark).select("doc_id", "text", "source"))
    rows = rows.union(spark.createDataFrame([(5000 + i, f"Shared Line here\n{PROSE} {i}" if i < 40 else "shared  line HERE\nx " + PROSE[:9] * 3 + f"{i}", "h")
                                             for i in range(60)], "doc_id long, text string, source string"))
    got = quality_rules.quality_rules(rows)
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "clean_text"]
    key = lambda r: (r[0] is None, r[0], r[1:])
    want = brute.quality([tuple(r) for r in rows.collect()])
    assert sorted(map(key, want)) == sorted(key(tuple(r[n] for n in names)) for r in got.collect())
    assert any("Shared" not in r[8] and r[0] is not None and 5000 <= r[0] < 5040 for r in want)


# 6: SimHash

@pytest.mark.parametrize("block", [4096, 4])
def test_near_duplicates(spark, docs, block):
    near = spark.createDataFrame([(9000 + i, " ".join(w if k != 5 * i else "zz" for k, w in enumerate((PROSE + " " + PROSE[::-1]).split() * 9)))
                                  for i in range(20)], "doc_id long, text string")
    rows = docs.select("doc_id", "text").union(odd_docs(spark).select("doc_id", "text").withColumn("doc_id", F.col("doc_id") + 20000)).union(near)
    got = simhash.near_duplicates(rows, block=block).collect()
    want, prints = brute.components(plain(rows)), defaultdict(set)
    assert len(got) == rows.count()
    for d, t in plain(rows):
        prints[d].add(f"{brute.fingerprint(t):016x}")
    for r in got:
        assert r["fingerprint"] in prints[r["doc_id"]]
        assert r["component_id"] == (None if r["doc_id"] is None else want[r["doc_id"]])


def test_masks_find_every_pair_within_the_distance():
    rng = np.random.default_rng(2)
    sample = rng.integers(0, 1 << 63, 2000, dtype=np.uint64)
    for total in (1000, 10 ** 7, 10 ** 10):
        allotted = simhash.allot(sample, total)
        masks = simhash.masks_of(allotted)
        for _ in range(300):
            x = int(rng.integers(0, 1 << 63))
            y = x
            for b in rng.choice(64, 3, replace=False):
                y ^= 1 << int(b)
            assert any(x & m == y & m for m in masks)


def test_components_of_a_chain(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 101), (5, 5), (101, 100)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {101: 100}


# 7: HTML

PAGES = [
    (None, ""), ("", ""), ("plain words only", ""),
    ("<html><body><nav><a href=x>Home</a></nav><article><h1>Title</h1><p>The fox is in the &amp; box &eacute;.<br>New  line"
     "<p>Un<b>broken</b>.</article><footer>&copy; the site of the year</footer>",
     "Title\n\nThe fox is in the & box é. New line\n\nUnbroken."),
    ("<article><p>Short.</p></article>", "Short."),
    ("<body><div class='cookie-notice'>We use the cookies of the site for you.</div><div id=main><h2>Head</h2><p>" + PROSE
     + "</p><p>Tiny end</p><p>" + PROSE + "</p></div><aside>the side of the page</aside><div class=comments><p>" + PROSE + "</p></div>"
     "<form><input value='a>b'><p>the form of it</p></form><script>if (a</b) '</p>'</script><style>p{}</style><!-- " + PROSE + " -->",
     "Head\n\n" + PROSE + "\n\nTiny end\n\n" + PROSE),
    ("<article><p>The end of the <script>var x = 1", "The end of the"),
    ("<main><header><h1>A title</h1></header><ul><li><a href=1>link</a></li></ul><p>" + PROSE, "A title\n\n" + PROSE),
]


RU = "Лиса перебежала дорогу, пока собака спала у старого дома, и никто в городе не заметил этого до самого вечера."
JA = "狐は古い町の家のそばで眠っている犬を飛び越えて走り、誰もそれに気づかないまま夕方になった。それから長い話が続いた。"
IT = ("Questa volpe veloce salta sopra quel cane pigro mentre nessuno nella vecchia città guarda verso di loro; poi altre "
      "parole seguono finché questo testo diventa abbastanza lungo da contare come documento, senza altri motivi.")
COMMENTS = f"<div id=comments><ol><li><article class='comment-body'><p>{PROSE}</p></article></ol></div>"
MORE_PAGES = [
    (f"<div class='content has-sidebar'><article><p>{PROSE}</p></article></div>{COMMENTS}", PROSE),
    (f"<div class='page no-comments'><article><p>{PROSE}</p></article></div>", PROSE),
    (f"<div class='post-with-related'><p>{PROSE}</p></div>", PROSE),
    (f"<div class='layout sidebar-right'><main><p>{PROSE}</p><div class=share>share it with the others</div></main></div>{COMMENTS}", PROSE),
    (f"<form id=all><article><p>{PROSE}</p><form><p>the form of it and of us</form></article></form>", PROSE),
    (f"<div class=sidebar><article><p>{PROSE} aside</p></article></div><article><p>{PROSE}</p></article>", PROSE),
    (f"<article><p>{PROSE}</p>{COMMENTS}</article>", PROSE),
    (f"<nav><a href=x>{RU}</a></nav><div><h1>Лиса</h1><p>{RU}</p><p>{RU}</p></div><div class=footer>{RU}</div>", f"Лиса\n\n{RU}\n\n{RU}"),
    (f"<div><p>{JA}</p><p><a href=1>{JA}</a></p></div>", JA),
    (f"<ul><li><a href=1>Prima</a></ul><div><p>{IT}</p></div><div><a href=2>Altro</a></div>", IT),
]


def test_html_wrappers_and_languages():
    for page, want in MORE_PAGES:
        assert html_text.main_text(page) == want


def test_html_long_repeated_and_clashing(spark):
    long_page = "<article>" + f"<p>{PROSE}</p>" * 20000 + "</article>"
    rows = [(1, long_page), (2, MORE_PAGES[0][0]), (2, MORE_PAGES[0][0]), (None, None)]
    df = spark.createDataFrame(rows, "page_id long, html string").withColumns({c: F.lit("clash") for c in ("text", "n_chars", "row", "x.y")})
    got = sorted(((r["page_id"] or 0, r["n_chars"], r["text"]) for r in html_text.extract_text(df).collect()))
    assert [g[:2] for g in got] == [(0, 0), (1, 20000 * (len(PROSE) + 2) - 2), (2, len(PROSE)), (2, len(PROSE))]
    assert got[2][2] == PROSE and "x.y" in html_text.extract_text(df).columns


def test_html(spark):
    df = spark.createDataFrame([(i, p) for i, (p, _) in enumerate(PAGES)], "page_id long, html string").withColumn("row", F.lit(1))
    got = {r["page_id"]: r for r in html_text.extract_text(df).collect()}
    for i, (_, want) in enumerate(PAGES):
        assert got[i]["text"] == want and got[i]["n_chars"] == len(want) and got[i]["row"] == 1
    assert html_text.extract_text(df.limit(0)).count() == 0


# 8: substrings

@pytest.mark.parametrize("hot,remembered", [(4096, 200000), (1, 200000), (3, 2)])
def test_substrings(spark, docs, hot, remembered):
    rows = docs.select("doc_id", "text").union(odd_docs(spark).filter("doc_id is not null").distinct().select(F.col("doc_id") + 9000, "text"))
    rows = rows.union(spark.createDataFrame([(9500 + i, f"{i} {PROSE[:100 + i]}") for i in range(20)], "doc_id long, text string"))
    got = substring_dedup.substring_dedup(rows, hot_docs=hot, remembered=remembered).collect()
    want = brute.substrings(plain(rows))
    assert len(got) == len(want)
    for r in got:
        assert brute.SPACE.findall(r["clean_text"]) == want[r["doc_id"]]
        assert r["n_words"] - r["n_removed"] == len(want[r["doc_id"]])


def test_texts_of_one_id_keep_their_own_words(spark):
    words = [f"w{i}" for i in range(60)]
    shared, lone = " ".join(words), " ".join(f"u{i}" for i in range(60))
    late = " ".join([f"v{i}" for i in range(30)] + words[:20] + ["z"] * 5)
    rows = spark.createDataFrame([(1, shared), (2, shared + " end"), (2, lone), (2, lone), (3, late), (3, lone + " tail"),
                                  (4, late)], "doc_id long, text string")
    got = {(r["doc_id"], r["text"]): (r["n_removed"], r["clean_text"].split()) for r in substring_dedup.substring_dedup(rows).collect()}
    assert got[2, lone] == (0, lone.split()) and got[2, shared + " end"] == (60, ["end"])
    assert got[3, late] == (20, late.split()[:30] + ["z"] * 5) and got[3, lone + " tail"] == (60, ["tail"])
    assert got[1, shared][0] == 0 and got[4, late] == (55, [])


def test_near_dedup_keeps_the_same_row_of_an_id(spark):
    rows = [(7, PROSE, "b"), (7, "some other text " * 9, "a"), (7, PROSE, "a"), (8, "x y z " * 30, "c")]
    rows = [(d, t, "en", s, len(t)) for d, t, s in rows]
    kept = set()
    for order in (rows, rows[::-1], rows[2:] + rows[:2]):
        df = spark.createDataFrame(order, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)
        out = corpus_pipeline.near_dedup(spark, df, SF_SMALL)
        assert out.columns == df.columns
        kept.add(tuple(sorted(tuple(r) for r in out.collect())))
    assert len(kept) == 1 and [r[0] for r in kept.pop()] == [7, 8]


def test_automaton():
    rng = np.random.default_rng(3)
    held = [[b"%d" % w for w in rng.integers(0, 4, 30)] for _ in range(6)]
    automaton = substring_dedup.Automaton()
    for words in held:
        automaton.add(words)
    inside = {tuple(w[i:j]) for w in held for i in range(30) for j in range(i + 1, 31)}
    probe = [b"%d" % w for w in rng.integers(0, 5, 200)]
    want = [max((n for n in range(1, i + 2) if tuple(probe[i + 1 - n:i + 1]) in inside), default=0) for i in range(200)]
    assert automaton.statistics(probe) == want


# 9: urls

URLS = [None, "", "no scheme", "http://", "http://EXAMPLE.org/es/a", "http://a.b.example.org/en/12?x#y", "https://example.org?x/es/",
        "ftp://org/", "http://notexample.org/es/", "x://org", "http://a.com/fr/", "http://com/de/1", "http://com.de/de/1", "//a.org/"]


@pytest.mark.parametrize("bits", [1 << 27, 0])
def test_urls(spark, monkeypatch, bits):
    monkeypatch.setattr(url_filter, "MAX_BITS", bits)
    df = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "page_id long, url string").withColumn("key0", F.lit(1))
    rules = spark.createDataFrame(queries.URL_RULES, "rule string, verdict string")
    got = {r["url"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(df, rules).collect()}
    assert got[None] == got["no scheme"] == ("", "", None, "allow")
    assert got["http://EXAMPLE.org/es/a"] == ("example.org", "/es/a", "example.org/es/", "block")
    assert got["http://a.b.example.org/en/12?x#y"][2:] == ("example.org/en/1", "block")
    assert got["https://example.org?x/es/"] == ("example.org", "", None, "allow")
    assert got["http://notexample.org/es/"][2:] == ("org/", "allow") and got["x://org"][2] is None
    assert got["http://com/de/1"][3] == "block" and got["http://com.de/de/1"][2] is None and got["http://a.com/fr/"][2] == "com/fr/"
    assert url_filter.filter_urls(df.limit(0), rules).count() == 0
    assert {r["verdict"] for r in url_filter.filter_urls(df, rules.limit(0)).collect()} == {"allow"}


def test_cascade_is_exact(spark):
    universe = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = universe.filter("key like '%7'")
    cascade = url_filter.Cascade(listed, universe)
    assert universe.withColumn("has", cascade.has(F.col("key"))).filter("has <> (key like '%7')").count() == 0


@pytest.mark.parametrize("bits", [1 << 27, 0])
def test_cascade_of_many_keys_equals_a_join(spark, monkeypatch, bits):
    monkeypatch.setattr(url_filter, "MAX_BITS", bits)
    universe = spark.range(60000).select(F.concat(F.lit("k"), "id").alias("key"))
    # the list holds keys that no url has
    listed = spark.range(40000, 100000, 3).select(F.concat(F.lit("k"), "id").alias("key"))
    cascade = url_filter.Cascade(listed, universe)
    assert len(cascade.levels) > 1 and cascade.whole == (bits > 0)
    probe = universe.unionByName(spark.createDataFrame([(None,)], "key string")).union(universe.limit(10))
    got = {(r["key"], r["has"]) for r in cascade.mark(probe, "key", "has").collect()}
    want = {r["key"] for r in listed.collect()}
    assert got == {(f"k{i}", f"k{i}" in want) for i in range(60000)} | {(None, None)}


def test_urls_repeated_and_very_long(spark):
    rules = spark.createDataFrame(queries.URL_RULES, "rule string, verdict string")
    long = "http://example.org/es/" + "a" * 2_000_000
    df = spark.createDataFrame([(1, long, "x"), (1, long, "x"), (2, "http://com/de/", "y")], "page_id long, url string, rule string")
    rows = url_filter.filter_urls(df, rules).collect()
    assert sorted((r["page_id"], r["rule"], r["verdict"]) for r in rows) == [
        (1, "example.org/es/", "block"), (1, "example.org/es/", "block"), (2, "com/de/", "block")]
    assert max(len(r["path"]) for r in rows) == 2_000_004


# odd tables, through every operator and stage

@pytest.mark.parametrize("empty", [False, True])
def test_odd_tables(spark, empty):
    df = odd_docs(spark, empty)
    n = df.count()
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (4, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for out in (quality_rules.quality_rules(df), substring_dedup.substring_dedup(df), toxicity.score_toxicity(df, labels),
                quality_classifier.score_quality(df, labels),
                decontaminate.decontaminate(df, table(spark, SF_SMALL, "benchmark")),
                decontaminate.decontaminate(df, table(spark, SF_SMALL, "benchmark").limit(0))):
        rows = out.collect()
        assert len(rows) == n and set(df.columns) <= set(out.columns)
        assert all(0 <= r["score"] <= 1 for r in rows) if "held_out" in out.columns else True
    assert simhash.near_duplicates(df).count() == n
    assert packing.pack(df, queries.TOKENIZER).groupBy("doc_id", "start").count().count() <= packing.pack(df, queries.TOKENIZER).count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, SF_SMALL)
        assert out.columns == df.columns and out.count() <= n, name
    ids = [r["doc_id"] for r in corpus_pipeline.near_dedup(spark, df, SF_SMALL).collect() if r["doc_id"] is not None]
    assert len(ids) == len(set(ids))


def test_pipeline(spark, docs):
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    kept = [(r[0], r[8]) for r in brute.quality(rows) if r[7]]
    root = brute.components(kept)
    kept = [(d, t) for d, t in kept if root[d] == d]
    left = brute.substrings(kept)
    items = [(r["item_id"], r["text"]) for r in table(spark, SF_SMALL, "benchmark").collect()]
    clean = {r[0] for r in brute.contamination([(d, " ".join(w)) for d, w in left.items()], items) if not r[4]}
    pieces = corpus_pipeline.run(spark, SF_SMALL).collect()
    assert {p["doc_id"] for p in pieces} == clean and len(clean) < len(kept)
    sizes = defaultdict(int)
    for p in pieces:
        sizes[p["doc_id"]] += p["length"]
    assert all(sizes[p["doc_id"]] == p["doc_tokens"] for p in pieces)
