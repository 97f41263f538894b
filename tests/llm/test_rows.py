"""Operators that treat each row alone: sharding, languages, quality, secrets, BPE, pages, chats."""

from __future__ import annotations

import hashlib
import itertools
import math
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from bazaarlens.llm import bpe, chat, html_pages, language, quality, secrets, sharding
from bazaarlens.llm.common import fold
from bazaarlens.llm.queries import QUERIES

from .conftest import ODD, SF_DIR


def test_shards_move_only_into_the_new_one_and_follow_weights(spark):
    ids = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    rows = sharding.assign_shards(ids, "doc_id", [1.0, 1.0, 2.0], [1.0, 1.0, 2.0, 1.0], "text").collect()
    sizes = Counter(r["shard"] for r in rows)
    assert abs(sizes[2] / 20000 - 0.5) < 0.02
    assert all(r["grown_shard"] in (r["shard"], 3) for r in rows)
    assert abs(sum(r["grown_shard"] == 3 for r in rows) / 20000 - 0.2) < 0.02
    for shard, size in sizes.items():
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(size))


def test_shards_of_odd_rows(odd, empty):
    rows = sharding.assign_shards(odd, "doc_id", [1.0] * 4, [1.0] * 5, "text").collect()
    assert len(rows) == len(ODD)
    assert {r["size"] for r in rows if r["doc_id"] in (1, 2)} == {1}
    assert sharding.assign_shards(empty, "doc_id", [1.0], [1.0], "text").count() == 0
    with pytest.raises(ValueError):
        sharding.rendezvous_shard(F.col("doc_id"), [0.0])


def test_languages_are_right_on_held_out_documents(spark):
    found = QUERIES["op2_language"](spark, SF_DIR)
    truth = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "lang")
    rows = found.join(truth, "doc_id").filter("held_out AND lang IS NOT NULL AND lang_pred <> 'und'").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.95


def test_kernel_equals_counted_ngrams():
    model = language.fit(["the sea", "das meer"], ["en", "de"], per_language=1)

    def grams(text):
        plain = " " + re.sub(r"[^a-zäöü]+", " ", text.lower()).strip() + " "
        return {plain[i : i + n] for n in (1, 2, 3) for i in range(len(plain) - n + 1)} - {" "}

    texts = ["Das Meer, the SEA!", "sea"]
    got = model.kernel([language.ngram_codes(t, model.table) for t in texts])
    landmarks = ["das meer", "the sea"]
    want = [[len(grams(t) & grams(x)) / math.sqrt(len(grams(t)) * len(grams(x))) for x in landmarks] for t in texts]
    assert np.allclose(got, want)


def test_languages_of_odd_rows(odd, empty):
    labelled = odd.withColumn("lang", F.when(F.col("doc_id") > 3, "en"))
    rows = language.identify_languages(labelled, "doc_id", "text", "lang", F.lit(True)).collect()
    assert len(rows) == len(ODD)
    assert {r["lang_pred"] for r in rows if r["doc_id"] in (1, 2, 3)} == {"und"}
    unknown = odd.withColumn("lang", F.lit(None).cast("string"))
    rows = language.identify_languages(unknown, "doc_id", "text", "lang", F.lit(True)).collect()
    assert {(r["lang_pred"], r["score"]) for r in rows} == {("und", 0.0)}
    assert language.identify_languages(empty.withColumn("lang", F.lit("en")), "doc_id", "text", "lang", F.lit(True)).count() == 0


def test_quality_is_right_on_held_out_labels(spark):
    found = QUERIES["op6_quality"](spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = found.filter("held_out").join(labels, "doc_id").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.95


def test_forest_arrays_equal_a_walk_through_each_tree():
    rng = np.random.default_rng(5)
    rows = rng.normal(size=(400, 3))
    labels = ((rows[:, 0] > 0) ^ (rows[:, 1] > 0.5)).astype(float)
    forest = quality.fit_forest(rows, labels, trees=15, depth=3)

    def walk(row):
        total = forest.base
        for feature, threshold, leaf in zip(forest.feature, forest.threshold, forest.leaf, strict=True):
            node = 0
            while node < len(feature):
                node = 2 * node + 1 + int(row[feature[node]] > threshold[node])
            total += leaf[node - len(feature)]
        return 1 / (1 + math.exp(-total))

    assert np.allclose(forest.probability(rows), [walk(r) for r in rows])
    assert ((forest.probability(rows) > 0.5) == labels).mean() > 0.9


def test_quality_of_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(5, 1), (4, 0), (None, 1), (2, None)], "doc_id bigint, quality int")
    rated = quality.rate_quality(odd, "doc_id", "text", labels, "doc_id", "quality", F.lit(True)).collect()
    assert len(rated) == len(ODD) and all(0 <= r["score"] <= 1 for r in rated)
    none = quality.rate_quality(odd, "doc_id", "text", labels.limit(0), "doc_id", "quality", fold("doc_id", 5) != 0)
    assert {r["score"] for r in none.collect()} == {0.5}
    assert quality.rate_quality(empty, "doc_id", "text", labels, "doc_id", "quality", F.lit(True)).count() == 0


def entropy_spans(text, group):
    """Plain version: the entropy of every window anew."""
    found = []
    for run in re.finditer(f"[{group.inside}]{{{group.window},}}", text):
        if any(re.search(p, run[0]) for p in secrets.ALLOWED):
            continue
        for i in range(len(run[0]) - group.window + 1):
            counts = Counter(run[0][i : i + group.window]).values()
            bits = -sum(c / group.window * math.log2(c / group.window) for c in counts)
            if bits > group.bits + 1e-7:
                start, end = run.start() + i, run.start() + i + group.window
                if found and start <= found[-1][1]:
                    found[-1] = (found[-1][0], end)
                else:
                    found.append((start, end))
    return found


def test_secrets_equal_a_plain_scan(spark):
    hexes = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(20)]
    parts = ['é password = "', "token: ", "AKIA", "x AKIAABCDEFGH2345 ", "secret: token: abcdefghij ", *hexes[:4],
             hexes[4] * 2, "Zk3+9aQw7LmX0pRt5YbV2nCd8SfG ", "EXAMPLE" + hexes[5], "a" * 30 + "1", " über\n", "AB12" * 9]
    rng = np.random.default_rng(3)
    rows = [(i, "".join(rng.choice(parts, size=8))) for i in range(60)] + [(98, None), (99, "")]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    got = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in secrets.find_secrets(df, "text").collect()}
    for i, text in rows:
        text = text or ""
        base = [("assign", m.start(), m.end()) for m in re.finditer(secrets.ASSIGN, text) if len(m[1]) >= 8]
        base += [("access", m.start(), m.end()) for m in re.finditer(secrets.ACCESS, text) if len(m[0]) >= 16]
        base += [("hex", m.start(), m.end()) for m in re.finditer(secrets.HEX, text) if len(m[0]) >= 32]
        more = [(g.kind, *span) for g in secrets.CLASSES for span in entropy_spans(text, g)]
        more = [m for m in more if not any(b[1] <= m[1] and m[2] <= b[2] for b in base)]
        rank = {"assign": 0, "access": 1, "hex": 2, "entropy_hex": 3, "entropy_base64": 4}
        assert got[i] == sorted(base + more, key=lambda s: (s[1], rank[s[0]], s[2])), text


def test_masked_secrets(spark):
    df = secrets.find_secrets(spark.createDataFrame([("é token = abcdefgh12 end",), ("none",), ("",)], "text string"), "text")
    got = [r[0] for r in df.select(secrets.masked(F.col("text"), F.col("spans"), "*")).collect()]
    assert got == ["é * end", "none", ""]


@pytest.fixture(scope="module")
def definition():
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        return file.read()


def test_chunks_encode_like_whole_texts(definition):
    tokenizer = Tokenizer.from_str(definition)
    rng = np.random.default_rng(7)
    letters = list("ab \n\té́日!?1<|>endoftext\x1c\x85 ") + ["<|endoftext|>", "don't ", "I'LL"]
    texts = ["", " ", "x" * 3000, "Σας ΟΔΟΣ İ " * 300] + ["".join(rng.choice(letters, size=2000)) for _ in range(6)]
    texts += [texts[-1][:900] + "new words " + texts[-1][900:], texts[-1]]
    encoder = bpe.ChunkEncoder(definition, mean_bytes=64)
    for text, got in zip(texts, encoder.encode(texts), strict=True):
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        assert (got.count, got.ids) == (len(ids), " ".join(map(str, ids)))
        assert got.tokens == tokenizer.decode(ids, skip_special_tokens=False)


def test_shared_chunks_are_encoded_once(definition):
    encoder = bpe.ChunkEncoder(definition, mean_bytes=64)
    text = " ".join(f"word{i}x" for i in range(2000))
    encoder.encode([text])
    before = encoder.encoded_bytes
    encoder.encode([text, "another start " + text])
    assert encoder.encoded_bytes - before < 40


def test_words_go_to_the_tokenizer_many_at_once_and_come_back_apart(definition):
    class Counted:
        """The tokenizer, with the number of texts that it got."""

        def __init__(self, tokenizer):
            self.tokenizer, self.texts = tokenizer, 0

        def __getattr__(self, name):
            def call(texts, **options):
                self.texts += len(texts)
                return getattr(self.tokenizer, name)(texts, **options)

            return call

    tokenizer = Tokenizer.from_str(definition)
    rng = np.random.default_rng(11)
    marks = ["\u0301x", "\u3000", "\x1c", "\x85a", "\u1112\u1161\u11ab", "İ", "a<|endoftext|>b", "\U0001f600'S", "\u200d"]
    words = [f"word{i}s." for i in range(3000)] + marks * 20
    texts = [" ".join(rng.choice(words, size=700)) for _ in range(20)]
    encoder = bpe.ChunkEncoder(definition, mean_bytes=64)
    encoder._tokenizer = counted = Counted(encoder._tokenizer)
    found = encoder.encode(texts)
    assert 0 < counted.texts < 100
    for text, got in zip(texts, found, strict=True):
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        assert (got.count, got.ids) == (len(ids), " ".join(map(str, ids)))
        assert got.tokens == tokenizer.decode(ids, skip_special_tokens=False)


def test_small_tables_of_the_encoder_change_no_result(definition, monkeypatch):
    rng = np.random.default_rng(12)
    texts = [" ".join(f"w{i}" for i in rng.integers(0, 500, size=400)) + "\n" for _ in range(30)] + ["", "y" * 500, " \t "]
    expected = bpe.ChunkEncoder(definition).encode(texts)
    monkeypatch.setattr(bpe, "_CUT_AT_ONCE", 300)
    encoder = bpe.ChunkEncoder(definition, mean_bytes=64, most_bytes=5000, most_word_bytes=2000)
    assert [e for i in range(0, len(texts), 4) for e in encoder.encode(texts[i : i + 4])] == expected
    assert len(encoder._older_words.words)
    assert all(t.words.nbytes + t.ids.nbytes < 2000 + 5000 for t in (encoder._words, encoder._older_words))


def test_bpe_of_odd_rows(odd, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = bpe.encode_texts(odd, "doc_id", "text", path).collect()
    assert len(rows) == len(ODD)
    assert {r["n_tokens"] for r in rows if r["doc_id"] in (1, 2, 3)} == {0}
    assert {r["ids_sha256"] for r in rows if r["doc_id"] == 2} == {hashlib.sha256(b"").hexdigest()}
    assert bpe.encode_texts(empty, "doc_id", "text", path).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="</p>";</script></head><body><nav><ul><li>Home</ul></nav>
<div class="ad">Buy</div><article><h1>A &amp; B</h1><p>One <b>two</b>
 three&nbsp;four<br>five<p>six<aside>no</aside><form>no</form></article><div id="comments"><p>reader</p></div><footer>f</footer>"""


def test_pages(spark):
    rows = [(1, "http://h/a", PAGE), (2, None, None), (3, "odd", ""), (3, "odd", ""), (4, "http://h/b", "plain <i>text</i>")]
    df = spark.createDataFrame(rows, "page_id int, url string, html string")
    got = sorted((r["page_id"], r["text"]) for r in html_pages.extract_text(df, "page_id", "url", "html").collect())
    assert got == [(1, "A & B One two three four five six"), (2, ""), (3, ""), (3, ""), (4, "plain text")]
    assert html_pages.extract_text(df.limit(0), "page_id", "url", "html").count() == 0


def test_names_inside_an_article_and_raw_elements_that_close_themselves():
    page = """<div class="related-posts">no</div><article><svg viewBox="0 0 1 1"/><h2 id="related-work">Work</h2>
    <section id="search-algorithms"><p class="notice-period">Notice</p></section><p aria-label="search">Label</p>
    <div class="box related">no</div><ul role="navigation"><li>no</ul><iframe src="x" />
    <div class="ad">no</div><svg><text>no</text></svg><script>no</script><p hidden>no</p><p>End</article>"""
    assert html_pages.page_blocks(page) == (["Work", "Notice", "Label", "End"], [])


def test_notices_adverts_and_comments_inside_main_under_compound_names():
    page = """<main><p data-x=it's>Hello</p><p>it's here</p><div id="comments" class="comments-area">no</div>
    <ol class="comment-list"><li>no</ol><div class="ad-slot">no</div><div class="cookie-banner">no</div>
    <div class="newsletter-signup">no</div><div class="share-buttons">no</div><section id="reader-comments"><h3>Reader comments</h3>no</section>
    <section id="comment-syntax"><h2>Comment syntax</h2>yes</section><div class="load-bar">bar</div>
    <div class="add-on">on</div><section id="cookie-recipes"><h2>Cookie recipes</h2>flour</section></main>"""
    want = ["Hello", "it's here", "Comment syntax", "yes", "bar", "on", "Cookie recipes", "flour"]
    assert html_pages.page_blocks(page) == (want, [])


@pytest.mark.parametrize("limits", [{}, {"group_pages": 2}, {"group_chars": 100}])
def test_a_story_outside_of_the_article_stays_in_page_order(spark, limits):
    line = "every page of this host ends with these same words of its publisher in a plain box"

    def story(i: int) -> str:
        return " ".join(f"word{i}x{k}" for k in range(20))

    rows = [
        (i, f"http://h/{i}", f"""<article>teaser {i}</article><div class="content">{story(i)}</div><div>{line}</div>
        <div>short {i}</div><div>{" ".join(f"<a href=/{k}>link {i} {k}</a>" for k in range(20))}</div><article>end</article>""")
        for i in range(7)
    ]
    df = spark.createDataFrame(rows, "page_id int, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_pages.extract_text(df, "page_id", "url", "html", **limits).collect()}
    assert got == {i: f"teaser {i} {story(i)} end" for i in range(7)}


def test_open_blocks_that_pages_share_go(spark):
    rows = [
        (i, f"http://Host.org/{i}", f"<div>all pages of this host say so here</div><div>only page {i} says {i * 7} things</div>")
        for i in range(6)
    ]
    df = spark.createDataFrame(rows, "page_id int, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_pages.extract_text(df, "page_id", "url", "html").collect()}
    assert got == {i: f"only page {i} says {i * 7} things" for i in range(6)}


@pytest.mark.parametrize("group_pages", [3, 500])
def test_open_blocks_that_two_pages_share_go_whatever_the_size_of_groups(spark, group_pages):
    rng = np.random.default_rng(3)
    words = [[f"p{i}w{k}" for k in range(20)] for i in range(24)]
    pairs = [(int(a), int(b)) for a, b in rng.permutation(24).reshape(12, 2)]
    rows = []
    for a, b in pairs:
        line = " ".join(f"s{a}x{k}" for k in range(7))
        rows += [(i, f"http://h/{i}", f"<div>too short {a}</div><div>{' '.join(words[i])}</div><div>{line}</div>") for i in (a, b)]
    rows.append((99, "http://other/99", f"<div>{' '.join(words[0])}</div>"))
    df = spark.createDataFrame(rows, "page_id int, url string, html string")
    got = html_pages.extract_text(df, "page_id", "url", "html", group_pages=group_pages).collect()
    want = {i: f"too short {a} {' '.join(words[i])}" for a, b in pairs for i in (a, b)} | {99: " ".join(words[0])}
    assert {r["page_id"]: r["text"] for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("group_pages", [2, 500])
def test_open_pages_that_share_an_id_or_have_none_keep_their_own_text(spark, group_pages):
    line = "<div>all pages of this host say so here</div>"
    texts = [f"only text {i} says {i * 7} things" for i in range(6)]
    rows = [(i, f"http://h/{k}", f"{line}<div>{t}</div>") for i in (None, 5) for k, t in enumerate(texts) if (i is None) == (k < 3)]
    rows += rows[:1] * 4 + rows[-1:]
    df = spark.createDataFrame(rows, "page_id int, url string, html string")
    got = html_pages.extract_text(df, "page_id", "url", "html", group_pages=group_pages).collect()
    want = Counter((i, u, texts[int(u[-1])]) for i, u, _ in rows)
    assert Counter(tuple(r) for r in got) == want


def test_suffixes_are_put_in_order_to_their_ends():
    """Also where they share more tokens than a run has."""
    rng = np.random.default_rng(3)
    for depth in (1, 2, 6):
        for size in (0, 1, 5, 60):
            stream = [int(t) for t in np.tile(rng.integers(0, 2, size=size), 2)] + [-1]
            order, alike = html_pages.suffix_array(stream, depth)
            assert order.tolist() == sorted(range(len(stream)), key=lambda at: stream[at:])
            pairs = zip([None, *order.tolist()], order.tolist())
            assert alike.tolist() == [b is not None and stream[b : b + depth] == stream[at : at + depth] for b, at in pairs]


def test_repeated_tokens_equal_all_windows():
    rng = np.random.default_rng(2)
    for run in (2, 3, 5):
        pages = [[[str(w) for w in rng.integers(0, 3, size=rng.integers(0, 9))] for _ in range(3)] for _ in range(4)]
        flat = [[t for block in blocks for t in block] for blocks in pages]
        got = html_pages.repeated_tokens(pages, run)
        for p, stream in enumerate(flat):
            others = {tuple(o[i : i + run]) for q, o in enumerate(flat) if q != p for i in range(len(o) - run + 1)}
            want = [False] * len(stream)
            for i in range(len(stream) - run + 1):
                if tuple(stream[i : i + run]) in others:
                    want[i : i + run] = [True] * run
            assert [bool(x) for block in got[p] for x in block] == want


def test_chats_fill_in_roles_and_cut_speakers(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, None, "What is it?"), (1, 2, "gpt", "It is the sea."), (1, 3, "odd", None),
            (2, 0, "user", "User: hi there\nAssistant: hello"), (None, 0, "user", "x"), (2, 0, "user", "User: hi there\nAssistant: hello")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string")
    got = chat.format_chats(df, "conv_id", "turn", "role", "text").collect()
    by = {c: [(r["role"], r["recovered"]) for r in sorted(got, key=lambda r: r["slot"]) if r["conv_id"] == c] for c in (1, 2, None)}
    assert by[1] == [("system", False), ("user", True), ("assistant", False), ("user", True)]
    assert by[2] == [("user", False), ("assistant", False)] * 2
    assert by[None] == [("user", False)]
    assert chat.format_chats(df.limit(0), "conv_id", "turn", "role", "text").count() == 0


def test_languages_of_many_scripts_are_told_apart():
    rng = np.random.default_rng(8)
    scripts = {"la": (0x61, 26), "el": (0x3B1, 25), "uk": (0x430, 32), "hy": (0x561, 38), "ka": (0x10D0, 33),
               "za": (0x4E00, 800), "zb": (0x6000, 800), "zc": (0x6000, 800), "cu": (0x12000, 400)}
    vocabulary = {
        g: ["".join(chr(first + int(k)) for k in rng.integers(0, n, size=rng.integers(2, 5))) for _ in range(60)]
        for g, (first, n) in scripts.items()
    }

    def text(g):
        blank = "" if g.startswith("z") else " "
        return blank.join(vocabulary[g][int(k)] for k in rng.integers(0, 60, size=40))

    langs = [g for g in scripts for _ in range(40)]
    model = language.fit([text(g) for g in langs], langs)
    asked = [g for g in scripts for _ in range(30)]
    found, scores = model.decide([text(g) for g in asked])
    assert np.mean([a == b for a, b in zip(asked, found, strict=True)]) > 0.98
    assert all(0 <= s <= 1 for s in scores)


def test_given_roles_stand_and_names_are_evidence(spark):
    options = "Two options:\na: take the bus\nQuestion: which one do you like?"
    faq = "Q: why?\nA: so\nQ: when?\nA: now"
    rows = [
        (1, 0, "user", "go"), (1, 1, "assistant", options), (1, 2, "user", "Assistant: is that you?"), (1, 3, "assistant", faq),
        (2, 0, "user", faq), (3, None, None, "go on"), (3, None, None, "go on"), (4, 0, None, f"Human: hi\nBot: {options}"),
        (5, 0, "user", "q: own name"),
    ]
    df = spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string").withColumn("given", F.lit(1))
    got = chat.format_chats(df, "conv_id", "turn", "role", "text").collect()
    by = {c: [r["rendered"] for r in sorted(got, key=lambda r: r["slot"]) if r["conv_id"] == c] for c in range(1, 6)}

    def turn(role, text):
        return f"<|{role}|>\n{text}<|end|>\n"

    assert by[1] == [turn("user", "go"), turn("assistant", options), turn("user", "Assistant: is that you?"), turn("assistant", faq)]
    assert by[2] == [turn("user", "why?"), turn("assistant", "so"), turn("user", "when?"), turn("assistant", "now")]
    assert len(by[3]) == 2 and all(r.endswith("\ngo on<|end|>\n") for r in by[3])
    assert by[4] == [turn("user", "hi"), turn("assistant", options)]
    assert by[5] == [turn("user", "own name")]


@pytest.mark.parametrize("block", [3, 256])
def test_transitions_are_counted_over_all_neighbours(spark, block):
    rng = np.random.default_rng(5)
    kinds = [(0, None)] * 3 + [(0, 1), (0, 2), (1, 0), (2, 3)]
    convs = [[kinds[k] for k in rng.integers(0, len(kinds), size=n)] for n in (1, 3, 4, 30, 7)]
    rows, position = [], 0
    for c, turns in enumerate(convs):
        for kind, marker in turns:
            position += 1
            rows.append((c or None, position, marker, kind, 0))
    df = spark.createDataFrame(rows, "conv_id int, position bigint, marker int, kind int, feature int")
    sure = [[None if kind == chat.WEAK else marker for kind, marker in turns] for turns in convs]
    start, follows = chat.PRIOR * np.array(chat.START), chat.PRIOR * np.array(chat.FOLLOWS)
    for turns in sure:
        if turns[0] is not None:
            start[turns[0]] += 1
        for a, b in itertools.pairwise(turns):
            if a is not None and b is not None:
                follows[a, b] += 1
    got = chat.learned_transitions(chat.in_conversations(df), block)
    assert np.allclose(got[0], start / start.sum()) and np.allclose(got[1], follows / follows.sum(axis=1, keepdims=True))


def _one_path(rows, step, start):
    """Viterbi of one sequence, plainly."""
    scores, back = start + rows[0], []
    for row in rows[1:]:
        options = scores[:, None] + step
        back.append(options.argmax(axis=0))
        scores = options.max(axis=0) + row
    path = [int(scores.argmax())]
    for choice in reversed(back):
        path.append(int(choice[path[-1]]))
    return path[::-1]


@pytest.mark.parametrize("block, fan", [(7, 256), (7, 3), (2, 2), (256, 256)])
def test_blocks_decode_like_one_long_viterbi(spark, block, fan):
    rng = np.random.default_rng(11)
    emissions = np.log(rng.dirichlet(np.ones(96), size=4))
    step, start = np.log(np.array(chat.FOLLOWS)), np.log(np.array(chat.START))
    rows, want, position = [], [], 0
    for c, n in enumerate([120, 1, 7, 8, 30, 2]):
        markers, kinds, features = rng.choice([-1, -1, -1, 0, 1, 2], size=n), rng.integers(0, 3, size=n), rng.integers(0, 96, size=n)
        codes = np.where(markers < 0, 0, 1 + 4 * kinds + markers) * 96 + features
        want += _one_path(chat.code_scores(emissions)[codes], step, start)
        for m, k, f in zip(markers, kinds, features, strict=True):
            position += 1
            rows.append((c or None, position, None if m < 0 else int(m), int(k), int(f)))
    df = spark.createDataFrame(rows, "conv_id int, position bigint, marker int, kind int, feature int")
    got = chat.recover_roles(chat.in_conversations(df), emissions, block=block, fan=fan).orderBy("position").collect()
    assert [r["state"] for r in got] == want and [r["position"] for r in got] == list(range(1, len(rows) + 1))


def test_viterbi_finds_the_best_of_all_paths():
    rng = np.random.default_rng(4)
    scores, step, start = np.log(rng.random((6, 3))), np.log(rng.random((3, 3))), np.log(rng.random(3))

    def score(path):
        return start[path[0]] + scores[0][path[0]] + sum(step[a, b] + scores[i + 1][b] for i, (a, b) in enumerate(zip(path, path[1:])))

    best = max(itertools.product(range(3), repeat=6), key=score)
    none = np.array([-1])
    (path,) = chat.best_paths([np.arange(6)], none, none, scores, start, step)
    assert tuple(path) == best
    held = max((p for p in itertools.product(range(3), repeat=6) if p[-1] == 2), key=score)
    assert tuple(chat.best_paths([np.arange(6)], none, np.array([2]), scores, start, step)[0]) == held
    assert np.isclose(chat.block_matrices([np.arange(6)], np.array([True]), scores, start, step)[0, 0, 2], score(held))
