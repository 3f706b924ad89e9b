import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from lorequarry.llm import chat, decontaminate, html, lm, pieces, quality, rules, shards, urls
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


# --- 1 -------------------------------------------------------------------------


def test_wand_finds_all_above_the_threshold():
    rng = random.Random(1)
    words = [f"w{i}" for i in range(60)]
    items = []
    for k in range(40):
        for unit in decontaminate.units(" ".join(rng.choices(words, k=rng.randint(1, 90)))):
            weights = {w: rng.random() for w in unit}
            items.append(decontaminate.Item(k, tuple(unit), tuple((w, x / sum(weights.values())) for w, x in weights.items()), ""))
    index = decontaminate.BlockMaxIndex(items)
    for threshold in (0.2, 0.5, 0.8):
        for _ in range(60):
            passage = set(rng.choices(words, k=rng.randint(1, 50)))
            scores = {
                u: s
                for u in range(len(items))
                if (s := sum(x for w in passage & index.vocabulary for i, x in zip(*index.postings[w], strict=True) if i == u)) >= threshold
            }
            got = dict(index.search(passage, threshold))
            assert got.keys() == scores.keys()
            assert all(math.isclose(got[u], scores[u]) for u in got)


def test_leaks_by_brute_force(spark):
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, items).collect()}
    texts = {r.item_id: r.text for r in items.collect()}
    want = {(r.doc_id, i) for r in docs.collect() for i, t in texts.items() if t.lower() in r.text.lower()}
    assert got >= want and want
    for doc_id, item_id in got - want:
        text = docs.where(F.col("doc_id") == doc_id).first().text
        grams = decontaminate.shingles(decontaminate.words_of(texts[item_id]))
        assert len(grams & decontaminate.shingles(decontaminate.words_of(text))) / len(grams) >= 0.8


def test_leaks_in_odd_rows(spark, odd_docs, no_docs):
    item = odd_docs.where("doc_id = 1").first().text[:300]
    items = spark.createDataFrame([(1, item), (1, item), (2, None), (None, "a"), (3, ""), (4, "one two three")], "item_id bigint, text string")
    got = sorted((r.doc_id or 0, r.item_id) for r in decontaminate.find_leaks(odd_docs, items).collect())
    assert got == [(0, 4), (1, 1), (1, 1)]
    assert decontaminate.find_leaks(no_docs, items).count() == 0
    assert decontaminate.find_leaks(odd_docs, items.limit(0)).count() == 0
    assert decontaminate.remove_leaks(odd_docs, items).columns == odd_docs.columns
    assert decontaminate.remove_leaks(odd_docs, items).count() == odd_docs.count() - 3


def slow_bm25(items):
    """The share of each term in the BM25 score of its unit, item by item."""
    made = [(i, u) for i, t in items for u in decontaminate.units(t)]
    mean = sum(len(u) for _, u in made) / len(made)
    seen = Counter(w for _, u in made for w in set(u))
    out = {}
    for i, u in made:
        x = {w: math.log1p((len(made) - seen[w] + 0.5) / (seen[w] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(u) / mean)) for w, tf in Counter(u).items()}
        out[i, tuple(u)] = {w: v / sum(x.values()) for w, v in x.items()}
    return out


def test_impacts_by_brute_force_whatever_the_blocks(spark, monkeypatch):
    rng = random.Random(7)
    items = [(f"item {k}", " ".join(f"w{int(rng.expovariate(0.05))}" for _ in range(rng.randint(1, 150)))) for k in range(60)]
    table = spark.createDataFrame(items, "item_id string, text string")
    want = slow_bm25(items)
    for size in (10_000, 7):
        monkeypatch.setattr(decontaminate, "INDEX_UNITS", size)
        blocks = list(decontaminate._indexes(table))
        assert all(len(b) <= size for b in blocks)
        got = {(x.item_id, x.words): dict(x.terms) for b in blocks for x in b}
        assert got.keys() == want.keys()
        assert all(math.isclose(got[k][w], want[k][w]) for k in got for w in want[k])


def test_blocks_of_items_find_the_same(spark, monkeypatch):
    rng = random.Random(8)
    items = [(f"q{k}", " ".join(f"w{int(rng.expovariate(0.1))}" for _ in range(rng.randint(12, 100)))) for k in range(80)]
    docs = []
    for k, (_, t) in enumerate(items):  # near copies, around the threshold
        words = t.split()
        for at in range(0, len(words), 14):
            words[at] = f"x{rng.randrange(40)}"
        docs.append((k, " ".join(words)))
    docs, items = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id string, text string")
    monkeypatch.setattr(decontaminate, "MIN_SHINGLES", 0.4)

    def found():
        return {(r.doc_id, r.item_id): r.bm25 for r in decontaminate.find_leaks(docs, items).collect()}

    whole = found()
    monkeypatch.setattr(decontaminate, "INDEX_UNITS", 5)
    assert found() == whole


def test_long_items_need_their_question_and_answer(spark):
    item = [f"w{i}" for i in range(200)]
    docs = [(1, " ".join(item)), (2, " ".join(item[:70])), (3, "so " * 300 + " ".join(item) + " so" * 300)]
    docs = spark.createDataFrame(docs, "doc_id bigint, text string")
    items = spark.createDataFrame([(9, " ".join(item[:150]) + ". " + " ".join(item[150:]))], "item_id bigint, text string")
    assert {r.doc_id for r in decontaminate.find_leaks(docs, items).collect()} == {1, 3}


# --- 3 -------------------------------------------------------------------------


def test_chat_escapes_reversibly():
    rng = random.Random(2)
    for _ in range(500):
        text = "".join(rng.choices(["<", "|", "\\", "<|im_end|>", "a", "\n", "%0A"], k=rng.randint(0, 12)))
        assert chat.unescape(chat.escape(text)) == text
        turn = chat.format_turn(text, [{"type": "text", "text": text}], chat.PartVisitor()).text
        assert list(chat.read_turns(turn + turn)) == [(text, text)] * 2


def test_chat_parts_become_placeholders():
    visitor = chat.PartVisitor()
    parts = [{"type": "text", "text": "see "}, {"type": "image", "ref": "i", "width": 1000, "height": 500}, {"type": "audio", "ref": "a", "seconds": 2.0}, {"type": "document", "ref": "d", "pages": 3}]
    turn = chat.format_turn("assistant", parts, visitor)
    assert "see <|image:0|><|audio:1|><|document:2|>" in turn.text
    assert [(x["ref"], x["tokens"]) for x in visitor.attachments] == [("i", 340), ("a", 50), ("d", 1800)]
    assert turn.text[slice(*turn.loss_span)] == "see <|image:0|><|audio:1|><|document:2|>"


def test_chat_digest(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (1, 1, "assistant", "b"), (2, None, None, "x"), (None, 0, "assistant", "<|im_end|>")]
    said = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("parts", F.lit("clash"))
    got = {r.conv_id: r for r in chat.digest(chat.format_conversations(chat.messages_from_text(said))).collect()}
    assert got[1].n_turns == 3 and got[1].loss_chars == 2
    assert got[1].turns_sha256 == hashlib.sha256(b"user\n\nassistant\nb\nassistant\nb\n").hexdigest()
    assert got[1].loss_sha256 == hashlib.sha256(b"bb").hexdigest()
    assert got[None].loss_sha256 == hashlib.sha256(b"<|im_end|>").hexdigest()
    assert got[2].loss_chars == 0
    assert chat.digest(chat.format_conversations(chat.messages_from_text(said.limit(0)))).count() == 0


# --- 4 -------------------------------------------------------------------------


def test_machine_is_the_sum_over_pairs():
    rng = np.random.default_rng(0)
    m = quality.FactorisationMachine(0.3, rng.normal(size=9), rng.normal(size=(9, 4)))
    ids, x = np.array([1, 4, 7]), np.array([0.5, -1.0, 2.0])
    pairs = sum(m.factors[ids[a]] @ m.factors[ids[b]] * x[a] * x[b] for a in range(3) for b in range(a + 1, 3))
    assert math.isclose(m.logit(ids, x), 0.3 + m.linear[ids] @ x + pairs)


def test_quality_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    scored = {r.doc_id: r for r in quality.score(docs, labels).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 for i, r in scored.items())
    held = [(r.quality, scored[r.doc_id].predicted) for r in labels.collect() if scored[r.doc_id].held_out]
    assert len(held) > 50 and sum(a == b for a, b in held) / len(held) >= 0.95


def test_quality_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (1, 0), (4, 0), (None, 1), (5, None)], "doc_id bigint, quality int")
    rows = quality.score(odd_docs, labels).collect()
    assert len(rows) == odd_docs.count() and all(r.score is not None for r in rows)
    assert {r.score for r in quality.score(odd_docs, labels.limit(0)).collect()} == {0.5}
    assert quality.score(no_docs, labels).count() == 0


# --- 5 -------------------------------------------------------------------------


def slow_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen = Counter(zip(words, words[1:], words[2:], strict=False))
    repeated = {i + k for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(repeated)


def check_rules(docs):
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted((r.doc_id or -1, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rules.judge(docs).collect())
    assert got == sorted((i or -1, *slow_counts(t)) for i, t in texts)


def test_rules_count_by_brute_force(spark, odd_docs, no_docs):
    check_rules(spark.read.parquet(f"{SF}/documents.parquet"))
    check_rules(odd_docs)
    assert rules.judge(no_docs).count() == 0


def test_many_repeats_take_the_other_way(spark):
    rng = random.Random(4)
    block = [f"w{rng.randint(0, 9)}" for _ in range(900)]
    check_rules(spark.createDataFrame([(1, " ".join(block + block), "en")], "doc_id bigint, text string, lang string"))


def test_rules_keep_the_clean_and_drop_the_noisy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    judged = rules.judge(docs).join(labels, "doc_id").where("not base_failed")
    assert judged.where("quality = 1 and not kept").count() == 0
    assert judged.where("quality = 0 and kept").count() == 0


def test_distance(spark):
    row = spark.createDataFrame([([1, 0], [0, 5], [2, 2], [])], "a array<bigint>, b array<bigint>, c array<bigint>, d array<bigint>")
    far, same, half, none = row.select(
        rules.js_distance(F.col("a"), F.col("b")), rules.js_distance(F.col("c"), F.col("c")), rules.js_distance(F.col("a"), F.col("c")), rules.js_distance(F.col("d"), F.col("d"))
    ).first()
    assert (far, same, none) == (1.0, 0.0, 0.0)
    assert math.isclose(half, math.sqrt((math.log2(1 / 0.75) + 0.5 * math.log2(0.5 / 0.75) + 0.5 * math.log2(0.5 / 0.25)) / 2))


# --- 6 -------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("<p>", ""),
        ("just &amp; text", "just & text"),
        ("<body><nav><a href=x>menu</a></nav><article><h1>T</h1><p>One  two<br>three<p>Four &copy; <b>five</b></article><footer>f</footer>", "T\nOne two three\nFour © five"),
        ("<body><div class='sidebar'>aside words here</div><div><p>The long main text of the page, which goes on.</p><p>And on.</p></div></body>", "The long main text of the page, which goes on.\nAnd on."),
        ("<article><p>Body text that is here.</p><div id=comments><p>I disagree with all of it!</p></div><script>if (a<b) x('</p>')</script></article>", "Body text that is here."),
        ("<div class='content no-sidebar'><p>Text beside no sidebar, long enough.</p></div><div class='cookieNotice'>We use cookies a lot.</div>", "Text beside no sidebar, long enough."),
        ("<article><p>unclosed <i>tags <b>everywhere<ul><li>a<li>b</ul>tail", "unclosed tags everywhere\na\nb\ntail"),
    ],
)
def test_extraction(page, text):
    assert html.extract_text(page) == text


@pytest.mark.parametrize(
    ("part", "text"),
    [
        ("<p>so <math><mi>x</mi>+<mi>y</mi></math> holds</p>", "so x+y holds"),
        ("<p class='share-price'>The price of a share rose.</p>", "The price of a share rose."),
        ("<p class='alert-box'>Mind the gap here.</p>", "Mind the gap here."),
        ("<div style='display:none'>A folded part.</div>", "A folded part."),
        ("<details><summary>More</summary>of it</details>", "More\nof it"),
        ("<object>a plug-in</object>", "a plug-in"),
    ],
)
def test_nothing_else_is_dropped(part, text):
    long = "A sentence of the article that goes on for a while, as sentences do."
    page = f"<body><nav><a href=x>menu</a></nav><div><p>{long}</p>{part}<p>{long}</p></div><footer>f</footer>"
    assert html.extract_text(page) == f"{long}\n{text}\n{long}"


def test_names_on_the_way_to_the_article_are_unlucky():
    long = "A sentence of the article that goes on for a while, as sentences do."
    page = f"<div class='widget'><div class='comment'><p>{long}</p><p>{long}</p></div></div><div class=ad>Buy now</div>"
    assert html.extract_text(page) == f"{long}\n{long}"


def test_an_article_in_blocks_without_telling_tags():
    long = "A sentence of the article that goes on for a while, as sentences do. "
    links = "".join(f"<li><a href={i}>go to {i}</a></li>" for i in range(12))
    blocks = [f"<div><p>{long * 3}</p><p>{long * 4}</p></div>", f"<div><p>{long * 5}</p></div>"]
    page = f"<body><div><ul>{links}</ul></div><div><a href=b>Buy this now!</a></div><h1>Title</h1>{''.join(blocks)}<div><ul>{links}</ul></div></body>"
    assert html.extract_text(page) == "\n".join(["Title", *((long * k).strip() for k in (3, 4, 5))])


def test_pages_come_out_without_article_tags_and_classes(spark):
    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        plain = re.sub(r"<(/?)(article|main)\b", r"<\1div", r.html).replace('class="ad"', "")
        article = re.search(r"<article>(.*)</article>", r.html, re.DOTALL)[1]
        want = html.text_of(html.parse(article))
        assert html.extract_text(r.html) == want
        assert want in html.extract_text(plain)


def slow_density(node, body_links):
    """By definition, from the whole subtree of a node."""
    def chars(n):
        return sum(len(c.strip()) if isinstance(c, str) else chars(c) for c in n.children if isinstance(c, str) or not c.dropped)

    def tags(n):
        return sum(1 + tags(c) for c in n.nodes())

    def links(n):
        return (chars(n), tags(n) + 1) if n.tag == "a" or n.beside else tuple(map(sum, zip((0, 0), *map(links, n.nodes()))))

    (c, t), (lc, lt) = (chars(node), tags(node)), links(node)
    if not c:
        return 0.0 if body_links is not None else (c, lc)
    if body_links is None:
        return c, lc
    scale = math.log(c / max(c - lc, 1) * lc + body_links * c + math.e)
    return c / max(t, 1) * math.log(c / max(lc, 1) * max(t, 1) / max(lt, 1) + 1) / scale


def test_densities_by_brute_force(spark):
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        root = html.parse(r.html)
        nodes = html._in_order(root)
        body = next(n for n in nodes if n.tag == "body")
        html.measure(nodes, body)
        c, lc = slow_density(body, None)
        for n in nodes:
            assert math.isclose(n.density, slow_density(n, lc / c))
            own = "".join(x.strip() for x in n.children if isinstance(x, str))
            text = html.Node("a" if n.beside or n.tag == "a" else "span", None, False, False)
            text.children.append(own)
            assert math.isclose(n.sum, sum(slow_density(k, lc / c) for k in n.nodes()) + slow_density(text, lc / c))
            inside = html._in_order(n)
            assert n.best in inside and n.best.sum == max(x.sum for x in inside if (x.tag in html.CONTAINERS) == (n.best.tag in html.CONTAINERS))


def test_wide_and_deep_pages_take_time_in_proportion():
    began = time.perf_counter()
    assert html.extract_text("<p><button><div>" + "<div>" * 100_000 + "deep") == ""
    assert html.extract_text("<div>" * 100_000 + "deep") == "deep"
    assert html.extract_text("<ul><li><p>a" * 30_000).count("a") == 30_000
    assert time.perf_counter() - began < 30


def test_pages_of_odd_rows(spark):
    rows = [(1, "u", None), (1, "u", None), (None, None, "<p>one page"), (None, None, "<p>one page"), (2, "v", "")]
    got = html.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    assert sorted(((r.page_id or 0), r.text, r.n_chars) for r in got) == [(0, "one page", 8)] * 2 + [(1, "", 0)] * 2 + [(2, "", 0)]


def test_deep_pages_and_all_rows(spark):
    assert html.extract_text("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = html.extract(pages.withColumn("text", F.lit(1))).collect()
    assert len(got) == pages.count() and all(r.n_chars == len(r.text) > 0 for r in got)
    assert html.extract(pages.limit(0)).count() == 0


# --- 7 -------------------------------------------------------------------------


@pytest.fixture(scope="module")
def model():
    return pieces.PieceModel.load()


def test_viterbi_by_brute_force(model):
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.VOCABULARY)
    score = {sp.id_to_piece(i): model.scores[i] for i in range(len(model.pieces)) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}
    encoder, rng = pieces.Encoder(model), random.Random(6)
    for _ in range(300):
        word = "".join(rng.choices("abcthe nersé日😀\x00", k=rng.randint(0, 14)))
        chars = list((" " + word).replace(" ", pieces.MARKER))
        best = [0.0] + [-math.inf] * len(chars)
        for i in range(len(chars)):
            for j in range(i + 1, min(len(chars), i + 16) + 1):
                s = score.get("".join(chars[i:j]), -math.inf)
                best[j] = max(best[j], best[i] + (max(s, model.unknown) if j == i + 1 else s))
        ids, total = encoder.encode_batch([word])[0].tolist(), 0.0
        while ids:
            i = ids.pop(0)
            total += model.unknown if sp.is_byte(i) else model.scores[i]
            if sp.is_byte(i):
                lead = model.pieces[i][0]
                del ids[: (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0)]
        assert math.isclose(total, best[-1]), word


def test_trie_holds_the_pieces_alone(model):
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.VOCABULARY)

    def look(key):
        at = 0
        for c in key:
            step = model.trie.base[at] + c + 1
            if not model.trie.base[at] or model.trie.check[step] != at:
                return -1
            at = step
        return model.trie.value[at]

    for i in range(3, len(model.pieces), 97):
        if not sp.is_byte(i):
            assert look(sp.id_to_piece(i).encode()) == i
    assert look(b"zzqqzz") == -1


def test_pieces_round_trip(spark, odd_docs, no_docs):
    rows = pieces.encode(odd_docs).collect()
    assert len(rows) == odd_docs.count() and all(r.round_trip and r.n_ids == len(r.ids) for r in rows)
    assert pieces.encode(no_docs).count() == 0


# --- 8 -------------------------------------------------------------------------


def test_permutation_is_one():
    for n in (1, 2, 3, 17, 1000, 4097):
        assert sorted(shards.permute(np.arange(n), n).tolist()) == list(range(n))
    assert shards.permute(np.arange(99), 99, 1).tolist() != shards.permute(np.arange(99), 99, 2).tolist()


def test_shards_read_back(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(shards, "SHARD", 64)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    layout, index = shards.materialise(docs.repartition(5).transform(lambda d: shards.spool(d, "t")), f"file://{tmp_path}/out")
    assert shards.load(layout.path) == layout
    rows = sorted(index.collect(), key=lambda r: r.slot)
    got = list(shards.read(layout))
    assert [r.slot for r in rows] == list(range(layout.n)) and [zlib.crc32(g) for g in got] == [r.crc for r in rows]
    assert list(shards.read(layout, layout.n - 3)) == got[-3:]
    whole = {}
    for r, g in sorted(zip(rows, got, strict=True), key=lambda x: (x[0].doc_id, x[0].seq_no)):
        whole[r.doc_id] = whole.get(r.doc_id, b"") + g
    assert whole == {r.doc_id: r.text.encode() + b"\xff" for r in docs.collect()}


def test_shards_of_odd_rows(spark, odd_docs, no_docs):
    layout, index = shards.materialise(shards.spool(odd_docs, "odd"))
    assert index.count() == layout.n == len(list(shards.read(layout)))
    layout, index = shards.materialise(shards.spool(no_docs, "none"))
    assert index.count() == 0 and shards.load(layout.path).n == 0
    with pytest.raises(RuntimeError):
        shards._publish(layout, 1)


# --- 9 -------------------------------------------------------------------------


def test_urls(spark):
    rows = [
        (1, "http://A.example.net/en/x?y"), (2, "https://example.net"), (3, "http://x.org/fr/"), (4, "no scheme"), (5, None),
        (6, "http://example.com/de/1#z"), (7, "http://myexample.com/de/"), (8, "http://net/"), (9, "http://b.net/en"), (9, "http://b.net/en"),
    ]
    pages = spark.createDataFrame(rows, "page_id bigint, url string").withColumn("verdict", F.lit(1))
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages, labels).collect()}
    assert got[1] == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert got[2] == ("example.net", "", None, "allow")
    assert got[3] == ("x.org", "/fr/", "org/fr/", "allow")
    assert got[4] == got[5] == ("", "", None, "allow")
    assert got[6] == ("example.com", "/de/1", "example.com/de/", "block")
    assert got[7][2:] == (None, "allow")
    assert got[8][2:] == got[9][2:] == ("net/", "block")
    assert urls.judge(pages, labels).count() == 10
    assert urls.judge(pages.limit(0), labels).count() == 0


def test_rules_are_mined_as_by_counting(spark):
    rng = random.Random(8)
    rows = []
    for i in range(400):
        host = rng.choice(["bad-farm.org", "fine.org", "other.com"])
        rows.append((f"http://{host}/{rng.choice(['x', 'y'])}/{i}", host.startswith("bad") and rng.random() < 0.95))
    mined = urls.mine_rules(spark.createDataFrame(rows, "url string, bad boolean")).collect()
    bags = [(set(r.t), b) for (r, (_, b)) in zip(spark.createDataFrame(rows, "url string, bad boolean").select(urls.tokens(F.col("url")).alias("t")).collect(), rows, strict=True)]
    assert mined
    for r in mined:
        hit = [b for t, b in bags if t >= set(r.antecedent)]
        assert math.isclose(r.confidence, sum(hit) / len(hit)) and r.confidence >= 0.8 and sum(hit) >= 5
    asked = spark.createDataFrame([("http://www.bad-farm.org/z",), ("http://fine.org/x/1",)], "url string")
    got = {r.url for r in urls.match_rules(asked, urls.mine_rules(spark.createDataFrame(rows, "url string, bad boolean"))).collect()}
    assert got == {"http://www.bad-farm.org/z"}


# --- 10 ------------------------------------------------------------------------


def random_batch(rng, sizes):
    n = sum(sizes)
    return lm.Batch(rng.normal(0, 1, (n, lm.WIDTH)), np.repeat(np.arange(len(sizes)), sizes), rng.integers(0, lm.CLASSES, n))


def random_model(rng, kind=np.float64):
    return lm.Attention({k: rng.normal(0, 0.4, s).astype(kind) for k, s in lm.SHAPES.items()})


def slow_log_probs(m, batch):
    """Word by word, in plain Python."""
    p, out, reads = m.params, [], batch.read
    for i, read in enumerate(reads):
        first = list(batch.text).index(batch.text[i])
        seen = range(max(first, first + (i - first) // lm.SPAN * lm.SPAN - lm.SPAN), i + 1)
        weights = [math.exp(min(30, read @ p["query"] @ (reads[j] @ p["key"]) / 4 + p["near"][i - j])) for j in seen]
        state = sum(w * (reads[j] @ p["value"]) for w, j in zip(weights, seen, strict=True)) / (1 + sum(weights)) + read @ p["own"]
        logits = state @ p["out"] + p["bias"]
        out.append(logits[batch.target[i]] - math.log(sum(map(math.exp, logits))))
    return out


def test_attention_by_brute_force():
    rng = np.random.default_rng(4)
    m, batch = random_model(rng), random_batch(rng, (3, 50, 1, 30))
    assert np.allclose(m.log_probs(batch), slow_log_probs(m, batch))


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(0)
    m, batch = random_model(rng), random_batch(rng, (1, 9, 20, 40))
    grads = m.gradients(batch)
    for name, at in (("query", (1, 3)), ("key", (0, 5)), ("value", (2, 2)), ("near", (1,)), ("own", (5, 0)), ("out", (3, 4)), ("bias", (7,))):
        loss = []
        for e in (1e-4, -1e-4):
            m.params[name][at] += e
            loss.append(-m.log_probs(batch).mean())
            m.params[name][at] -= e
        assert math.isclose((loss[0] - loss[1]) / 2e-4, grads[name][at], rel_tol=1e-3, abs_tol=1e-6), name


def test_the_next_class_is_a_distribution_and_causal():
    rng = np.random.default_rng(1)
    m, batch = random_model(rng), random_batch(rng, (40,))
    total = sum(np.exp(m.log_probs(lm.Batch(batch.read, batch.text, np.full(40, c)))) for c in range(lm.CLASSES))
    assert np.allclose(total, 1, atol=1e-6)
    other = lm.Batch(np.where(np.arange(40)[:, None] < 25, batch.read, 0.3), batch.text, batch.target)
    a, b = m.log_probs(batch), m.log_probs(other)
    assert np.allclose(a[:25], b[:25]) and not np.allclose(a[25:], b[25:])


def test_speller_spells_words_one_by_one():
    spell = lm.Speller(lm.VOCABULARY)
    words = [b"", b"the", "日本\u00a0語".encode(), b"", b"x" * 5000, "a\ud800b".encode("utf-8", "surrogatepass"), b"", b"unheard-of", b""]
    for some in (words, [w for w in words if b"\xed\xa0" not in w], [b""], []):
        ids, lengths = spell(some)
        at = np.concatenate([[0], np.cumsum(lengths)]).astype(int)
        assert len(lengths) == len(some) and at[-1] == len(ids)
        for w, a, b in zip(some, at, at[1:]):
            assert ids[a:b].tolist() == (spell._coder.encode_single_piece(b" " + w) if w else [lm.END_ID])


def slow_lm_score(model, lex, count, text):
    """The score by its definition, word by word."""
    words, spell, total = [*lm.words_of(text), b""], lm.Speller(lm.VOCABULARY), 0.0
    reads, target = [lex.embed[lm.START]], []
    for w in words:
        ids = spell([w])[0].astype(int)
        z = int((lex.registers.log_prior + sum(lex.registers.log_unit[u] for u in lex.of_id[ids])).argmax())
        if w in lex.head:
            target.append(int(lex.klass[lex.head[w]]))
            total += math.log10(count[w] / lex.class_mass[target[-1]])
        else:
            target.append(lm.FIRST_TAIL + z)
            spelling = sum(float(lex.log_id[i, z]) for i in ids)
            total += lex.log_one[z] + math.log10(count[w] - 0.75) if count[w] else lex.log_new[z] + spelling
        reads.append(sum(lex.embed[u] for u in lex.of_id[ids]) / len(ids))
    batch = lm.Batch(np.array(reads[:-1], float), np.zeros(len(words), int), np.array(target))
    m = lm.Attention({k: v.astype(np.float64) for k, v in model.params.items()})
    return total + sum(slow_log_probs(m, batch)) / math.log(10)


def test_lm_score_by_brute_force(spark, monkeypatch):
    texts = ["one two  three", "one two four", None, "", "Two three one " * 12, "one unheard-of two", "three seven"] * 2
    texts += ["met once", "one more time", "one two seldom"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    monkeypatch.setattr(lm, "HEAD_WORDS", 3)
    found, made = {}, (lm.Lexicon.build, lm.train)
    monkeypatch.setattr(lm.Lexicon, "build", lambda *a: found.setdefault("lex", made[0](*a)))
    monkeypatch.setattr(lm, "train", lambda *a: found.setdefault("trained", made[1](*a)))
    got = {r.doc_id: r for r in lm.score(docs).collect()}
    count = Counter()
    for i, t in enumerate(texts):
        if zlib.crc32(str(i).encode()) % 5 != 1:
            count.update([*lm.words_of(t or ""), b""])
    for i, t in enumerate(texts):
        assert math.isclose(got[i].score, slow_lm_score(found["trained"][0], found["lex"], count, t or ""), rel_tol=1e-4)


def test_attention_gains_on_held_out_texts(spark):
    rows = [r for r in lm.score(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect() if r.held_out]
    tokens = sum(r.n_tokens for r in rows)
    gain = sum(r.score - r.plain_score for r in rows) / tokens
    print("held out, log10 a token:", sum(r.score for r in rows) / tokens, sum(r.plain_score for r in rows) / tokens, sum(r.base_score for r in rows) / tokens)
    assert gain > 0.1


def test_lm_base_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    count = Counter()
    for i, t in texts.items():
        if zlib.crc32(str(i).encode()) % 5 != 1:
            count.update(lm.words_of(t))
            count[b""] += 1
    n, v = sum(count.values()), len(count)
    for r in lm.score(docs).collect():
        words = [*lm.words_of(texts[r.doc_id]), b""]
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 1)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words), sum(count[w] > 0 for w in words), n)
        assert math.isclose(r.base_score, sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words), rel_tol=1e-9)
        assert -20 * len(texts[r.doc_id]) - 20 < r.score < 0


def test_lm_tail_words_meet_their_counts(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    whole = {r.doc_id: (r.n_known, r.base_score, r.score) for r in lm.score(docs).collect()}
    monkeypatch.setattr(lm, "HEAD_WORDS", 50)
    for r in lm.score(docs).collect():
        assert whole[r.doc_id][0] == r.n_known
        assert math.isclose(whole[r.doc_id][1], r.base_score, rel_tol=1e-9)


def test_lm_odd_rows(spark, odd_docs, no_docs):
    rows = lm.score(odd_docs).collect()
    assert len(rows) == odd_docs.count() and all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in rows)
    assert {r.n_tokens for r in rows if r.doc_id in (2, 3, 5)} == {1}
    assert lm.score(no_docs).count() == 0
