"""Operators against brute force on small fixtures with nulls, empty texts, ties, repeats and clashing columns."""

import hashlib
import random
import re
from collections import Counter

import pytest

from tessera.llm import chat_format, decontaminate, exact_dedup, html_extract, license_scan, ngram_join, queries, sentencepiece_codec, suffix_dedup, toxicity, url_filters
from tessera.llm.components import connected_components

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, id long, node string, start int, copy string, score double"


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def frame(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, 1, "n", 2, "c", 0.5) for i, t in zip(ids, texts)], DOCS).repartition(3)


def corpus(seed, n=40):
    """Base texts, exact copies, near copies and shared passages; nulls and empties."""
    r = random.Random(seed)
    vocabulary = [f"w{k}é" if k % 7 == 0 else f"Word{k}" for k in range(400)]
    passage = " ".join(r.choices(vocabulary, k=40))
    out = [None, "", "", "one two", "One, two!", "   "]
    while len(out) < n:
        kind = r.random()
        base = [w for w in (r.choice(out) or "").split(" ")]
        if kind < 0.35 and len(base) > 30:
            for _ in range(r.randint(0, 5)):
                base[r.randrange(len(base))] = r.choice(vocabulary)
            out.append(" ".join(base))
        elif kind < 0.55:
            t = r.choices(vocabulary, k=r.randint(30, 120))
            t.insert(r.randrange(len(t)), passage)
            out.append(" ".join(t))
        else:
            out.append(" ".join(r.choices(vocabulary, k=r.randint(1, 150))))
    return out


def brute_join(texts):
    def grams(t):
        w = words(t)
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    sets = [grams(t) for t in texts]
    n = len(texts)
    near = [[j for j in range(n) if j != i and sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])] for i in range(n)]
    least = list(range(n))
    for _ in range(n):
        least = [min([least[i], *(least[j] for j in near[i])]) for i in range(n)]
    return {i: (least[i], len(near[i])) for i in range(n)}


@pytest.mark.parametrize("seed, block", [(1, None), (2, 150)])
def test_ngram_join(spark, monkeypatch, seed, block):
    if block:
        monkeypatch.setattr(ngram_join, "BLOCK_GRAMS", block)
    base = corpus(seed, 70)
    long = " ".join(f"x{k}" for k in range(90))
    texts = base + [long.replace(f"x{k} ", f"y{k} ") for k in range(1, 25)] + [long] * 3
    got = ngram_join.ngram_join(frame(spark, texts)).collect()
    assert {r.doc_id: (r.class_id, r.n_links) for r in got} == brute_join(texts)


def test_ngram_join_block_counts():
    import numpy as np

    r = random.Random(5)
    core = list(range(60))
    sets = [np.unique(np.array([x if r.random() > k / 300 else 1000 + r.randrange(200) for x in core], np.uint64)) for k in range(60)]
    weights = np.array([r.randint(1, 3) for _ in sets])
    for side in (np.full(60, 2), np.array([k % 2 for k in range(60)])):
        links, forest = ngram_join.block_links(sets, weights, side, 0.8)
        for i in range(60):
            pairs = [j for j in range(60) if j != i and (side[i] == 2 or side[i] != side[j]) and 5 * len(np.intersect1d(sets[i], sets[j])) >= 4 * len(np.union1d(sets[i], sets[j]))]
            assert links[i] == weights[pairs].sum()


def test_empty_tables(spark):
    none = frame(spark, [])
    assert ngram_join.ngram_join(none).count() == 0
    assert suffix_dedup.suffix_dedup(none).count() == 0
    assert exact_dedup.exact_dedup(none).count() == 0
    assert decontaminate.decontaminate(none, none, item_col="doc_id").count() == 0
    assert license_scan.scan_licenses(none).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_extract.extract_pages(pages).count() == 0
    assert url_filters.judge_urls(pages, url_filters.page_links(pages), queries.URL_RULES).count() == 0
    turns = spark.createDataFrame([], "pair_id long, turn long, role string, text string")
    assert chat_format.format_preferences(turns, turns).count() == 0
    assert chat_format.pair_preferences(turns, turns).count() == 0
    model = queries.tokenizer_file("piece_bpe_32k.model")
    assert sentencepiece_codec.encode_documents(none, model).count() == 0


def brute_suffix(texts):
    seen, out = set(), {}
    for i, t in enumerate(texts):
        data = (t or "").encode()
        hit = [False] * len(data)
        for k in range(len(data) - 99):
            s = data[k : k + 100]
            if s in seen:
                hit[k : k + 100] = [True] * 100
            seen.add(s)
        kept = bytes(b for b, h in zip(data, hit) if not h)
        spans = sum(h and (k == 0 or not hit[k - 1]) for k, h in enumerate(hit))
        out[i] = (len(data), sum(hit), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("bucket_runs, hot_ranks, flush_bytes", [(2000, 64, 8 << 20), (1, 64, 1000), (2000, 0, 3000), (2000, 1, 5000), (2000, 64, 1)])
def test_suffix_dedup(spark, bucket_runs, hot_ranks, flush_bytes):
    texts = corpus(3, 80) + ["a" * 99, "a" * 100, "b" * 250, "ab" * 130, "b" * 100, "ab" * 60, "é" * 90]
    got = suffix_dedup.suffix_dedup(frame(spark, texts), bucket_runs=bucket_runs, hot_ranks=hot_ranks, flush_bytes=flush_bytes).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == brute_suffix(texts)


def test_suffix_dedup_null_and_repeated_ids(spark):
    t = "abcdefghij" * 15
    got = suffix_dedup.suffix_dedup(frame(spark, [t, t, t], [None, 5, 5])).collect()
    assert sorted((r.doc_id or -1, r.n_removed == len(t)) for r in got) == [(-1, False), (5, True), (5, True)]


def test_decontaminate(spark):
    texts = corpus(4, 60)
    items = {k: " ".join((texts[t] or "").split()[3:17]) for k, t in enumerate(range(10, 40, 3))} | {90: "one two", 91: None, 92: "", 93: "word5"}
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    want = {}
    for i, t in enumerate(texts):
        w, hit, found = words(t), set(), set()
        for item, text in items.items():
            v = words(text)
            for k in range(max(1, len(v) - 9) if v else 0):
                x = v[k : k + 10]
                for p in range(len(w) - len(x) + 1):
                    if w[p : p + len(x)] == x:
                        hit.update(range(p, p + len(x)))
                        found.add(item)
        names = ",".join(sorted(map(str, found)))
        want[i] = (len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest())
    for block in (decontaminate.BLOCK_BYTES, 100):
        got = decontaminate.decontaminate(frame(spark, texts), bench, block_bytes=block).collect()
        assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in got} == want


def test_decontaminate_items_without_ids(spark):
    bench = spark.createDataFrame([(None, "red fox"), (None, "blue hen"), (3, "red fox"), (10, "grey owl")], "item_id long, text string")
    docs = frame(spark, ["a red fox and a blue hen", "a grey owl", "one blue hen", "none"])
    names = ["3", "10", "", ""]
    for block in (decontaminate.BLOCK_BYTES, 8):
        got = {r.doc_id: r for r in decontaminate.decontaminate(docs, bench, block_bytes=block).collect()}
        assert [(got[k].n_hit, got[k].n_items) for k in range(4)] == [(4, 2), (2, 1), (2, 1), (0, 0)]
        assert [got[k]["items"] for k in range(4)] == names
        assert [got[k].items_sha256 for k in range(4)] == [hashlib.sha256(n.encode()).hexdigest() for n in names]


def test_decontaminate_very_long_text(spark):
    text = "filler words here " * 300_000 + "one two three four five six seven eight nine ten eleven"
    bench = spark.createDataFrame([(1, "two three four five six seven eight nine ten eleven")], "item_id long, text string")
    (row,) = decontaminate.decontaminate(frame(spark, [text]), bench).collect()
    assert (row.n_words, row.n_hit, row.n_items) == (900_011, 10, 1)


def test_sentencepiece_is_the_library(spark):
    import sentencepiece

    model = queries.tokenizer_file("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    texts = [*corpus(6, 30), "▁a ▁▁b", " x  y ", "\t\n\x00 　 z", "日本語 😀" * 3, "q" * 2000, "  "]
    got = {r.doc_id: r for r in sentencepiece_codec.encode_documents(frame(spark, texts), model).collect()}
    for i, t in enumerate(texts):
        ids = sp.encode(t or "", add_bos=True, add_eos=True)
        assert (list(got[i].ids), got[i].decoded) == (ids, sp.decode(ids))


def test_license_scan(spark):
    phrases = {("gnu", "general", "public", "license"): "gpl", ("apache", "license"): "apache", ("cc", "by"): "cc-by", ("mit", "license"): "mit"}
    texts = [None, "", "MIT License. mit license", "CC BY 4.0, the Apache  License", "GNU General\nPublic License cc-by", "apache licenses", "SPDX-License-Identifier: MIT OR Apache-2.0"]
    got = {r.doc_id: r for r in license_scan.scan_licenses(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        w = words(t)
        at = [(k, label) for k in range(len(w)) for p, label in phrases.items() if tuple(w[k : k + len(p)]) == p]
        r = got[i]
        assert (r.n_words, r.n_base, r.base_labels) == (len(w), len(at), ",".join(sorted({x for _, x in at})))
        assert r.first_word == min((k for k, _ in at), default=None)
        assert 0 <= r.score <= 1 and set(r.base_labels.split(",")) - {""} <= set(r.labels.split(","))


def test_exact_dedup_nulls_and_ties(spark):
    got = exact_dedup.exact_dedup(frame(spark, ["A", "a", None, "", "b", "É", "é"]), digest_all=True).collect()
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in got} == {0: (1, 2, False), 1: (1, 2, True), 2: (3, 2, False), 3: (3, 2, True), 4: (4, 1, True), 5: (5, 1, True), 6: (6, 1, True)}


def test_html_extract(spark):
    body = "<nav><a href=x>Menu</a></nav><div class='ad'>buy</div>{}<footer>foot</footer>"
    pages = [
        (0, "http://a.example/1", body.format("<article><h1>T &amp; U</h1><p>One <b>t</b>wo<br>three<p>four</article>")),
        (1, "http://a.example/2", body.format("<article><p>Long enough text here</p><div class=comments>first!</div><form>f</form></article>")),
        (2, None, None),
        (3, "x", ""),
        (4, "http://b.example/", "<body><div class='post-12'><p>alpha<p>beta</div><aside>side</aside><script>if (a<b) {}</script>"),
        (5, "http://b.example/2", "<p>cut off &amp"),
    ]
    got = html_extract.extract_pages(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == {0: "T & U One two three four", 1: "Long enough text here", 2: "", 3: "", 4: "alpha beta", 5: "cut off &"}
    assert all(r.n_chars == len(r.text) for r in got)


def test_chat_format(spark):
    schema = "pair_id long, turn long, role string, text string"
    same = [(1, 0, "user", "hi"), (1, 1, "assistant", None)]
    chosen = spark.createDataFrame([*same, (1, 2, "assistant", "good"), (2, 0, "user", "a"), (None, None, None, None)], schema)
    rejected = spark.createDataFrame([*same, (1, 2, "assistant", "bad"), (2, 0, "user", "a"), (2, 1, "user", "b")], schema)
    got = chat_format.format_preferences(chosen, rejected).collect()
    assert Counter((r.pair_id, r.part, r.turn, r.segment[r.train_from : r.train_to]) for r in got) == Counter([(1, "prompt", 0, ""), (1, "prompt", 1, ""), (1, "chosen", 2, "good<|end|>\n"), (1, "rejected", 2, "bad<|end|>\n"), (2, "prompt", 0, ""), (2, "rejected", 1, ""), (None, "prompt", None, "")])


def test_toxicity_holdout(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    rows = queries.op9_toxicity(spark, sf).join(labels, "doc_id").where("held_out AND toxic IS NOT NULL").collect()
    right = {y: [r.predicted == y for r in rows if r.toxic == y] for y in (0, 1)}
    rates = {y: sum(v) / len(v) for y, v in right.items()}
    print(rates)
    assert rates[0] > 0.9 and rates[1] > 0.8


def test_counterfactual_swaps_change_scores_little():
    bad, good = ["you idiot moron fool"] * 10, ["a nice calm day"] * 10
    texts = [f"{t} {'muslim' if k % 2 else 'reader'} here" for k, t in enumerate(bad + good)]
    texts += ["muslim people are idiot"] * 5
    y = [1] * 10 + [0] * 10 + [1] * 5

    def gap(fairness):
        w = toxicity.fit(texts, y, fairness=fairness)
        table = toxicity.WordScores(w[:-1])
        return abs(toxicity.score_text("muslim neighbours", table, w[-1]) - toxicity.score_text("christian neighbours", table, w[-1]))

    assert gap(20.0) < gap(0.0)


def test_alias_decisions(spark):
    urls = spark.createDataFrame([(k, u) for k, u in enumerate(["http://a.com/en/1", "http://b.org/x", "http://c.org/x", "http://d.org/x", "http://x.example.com/en/7", None, "nourl"])], "page_id long, url string")
    links = spark.createDataFrame([("http://b.org/x", "http://a.com/en/1"), ("http://c.org/x", "http://b.org/x"), ("http://d.org/x", "http://c.org/x#f"), ("http://d.org/x", None)], "source_url string, target_url string")
    got = {r.page_id: r.verdict for r in url_filters.judge_urls(urls, links, queries.URL_RULES).collect()}
    assert got == {0: "block", 1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "allow"}
    more = links.union(spark.createDataFrame([("http://d.org/x", "http://x.example.com/en/7")], links.schema))
    got = {r.page_id: r.verdict for r in url_filters.judge_urls(urls, more, queries.URL_RULES).collect()}
    assert got == {0: "block", 1: "allow", 2: "allow", 3: "allow", 4: "allow", 5: "allow", 6: "allow"}


def test_page_links_decoded_and_resolved(spark):
    forms = {
        "<link rel=canonical href='/en/7'>": "http://h.org/en/7",
        '<link rel="canonical" href="x.html">': "http://h.org/a/x.html",
        '<link href="../../b/./y?q=1#f" rel="nofollow Canonical" />': "http://h.org/b/y?q=1#f",
        '<LINK REL=canonical HREF="//other.net/p">': "https://other.net/p",
        '<link rel="canonical" href="http://a/x?p=1&amp;q=2">': "http://a/x?p=1&q=2",
        '<link rel="canonical" href="http://a/&#x41;&#66;&eacute;&copy=1&nosuch;&AMP&#128;">': "http://a/ABé&copy=1&nosuch;&€",
        '<link rel="canonical" href="?page=2">': "http://h.org/a/b.html?page=2",
        '<link data-href="http://no/" title="a > b" rel="canonical" href="/login?next=http://b.com/">': "http://h.org/login?next=http://b.com/",
        '<base href="/deep/er/"><link rel="canonical" href="z">': "http://h.org/deep/er/z",
        '<meta http-equiv="refresh" content="0; url=/m?a=1&amp;b=2">': "http://h.org/m?a=1&b=2",
        "<meta content=\"5;URL='next.html'\" http-equiv='Refresh'>": "http://h.org/a/next.html",
        "<meta http-equiv=refresh content=0;url=//r.net/>": "https://r.net/",
        '<meta http-equiv="refresh" content="30">': None,
        '<link rel="canonical" href="mailto:a@b">': None,
        '<link rel="canonical" href="">': None,
        '<!-- <link rel="canonical" href="/c"> --><script>"<link rel=canonical href=/s>"</script>': None,
        '<link rel="alternate" href="/alt" title="canonical">': None,
    }
    for k, (tag, want) in enumerate(forms.items()):
        scheme = "https" if want and want.startswith("https") else "http"
        forms[tag] = (f"{scheme}://h.org/a/b.html?k={k}", want)
    pages = spark.createDataFrame([(k, url, f"<html><head>{tag}</head><p>t") for k, (tag, (url, _)) in enumerate(forms.items())], "page_id long, url string, html string")
    got = {r.source_url: r.target_url for r in url_filters.page_links(pages).collect()}
    assert got == {url: want for url, want in forms.values() if want}


def test_page_links_carry_decisions(spark):
    pages = [
        (0, "http://a.com/en/1?p=1&q=2", ""),
        (1, "http://b.org/x", '<link rel="canonical" href="//a.com/en/1?p=1&amp;q=2">'),
        (2, "http://b.org/y", '<meta http-equiv="refresh" content="0; url=x">'),
        (3, "http://b.org/z", "<p>no link"),
    ]
    pages = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r.verdict for r in url_filters.judge_urls(pages.select("page_id", "url"), url_filters.page_links(pages), queries.URL_RULES).collect()}
    assert got == {0: "block", 1: "block", 2: "block", 3: "allow"}


def test_html_extract_keeps_wrappers():
    article = "<h1>T</h1><p>One long paragraph.</p><p>Two.</p>"
    whole = "T One long paragraph. Two."
    wrappers = ['class="content no-sidebar"', 'class="site has-sidebar"', 'class="page header-fixed"', 'id="page" class="with-comments"', 'class="widget"', 'class="sidebar"', 'id="search"']
    for wrapper in wrappers:
        for page in (f"<body><nav>Menu</nav><div {wrapper}><article>{article}</article></div>", f"<body><div {wrapper}><div class=x>{article}</div></div><footer>f</footer>"):
            assert html_extract.extract(page, None) == whole, page
    page = "<body><div class='cookie-notice'><main><p>all</main></div>"
    assert html_extract.extract(page, None) == "all"
    page = "<article><p>Start of it.</p>{}<p>End.</p></article>"
    for part, text in [("<h2 id='search'>Search</h2>", "Search"), ("<section id='related-work'><h2>R</h2><p>Work</section>", "R Work"), ("<h2 id='social-policy'>Social</h2>", "Social")]:
        assert html_extract.extract(page.format(part), None) == f"Start of it. {text} End."


def test_html_extract_still_drops_parts():
    long = "<p>words of a visitor and more of them</p>" * 20
    parts = [
        f"<div id='comments' class='comments-area'><ol><li class='comment'><article>{long}</article></ol></div>",
        f"<div id='comments'><article class='comment-body'>{long}</article></div>",
        f"<div class='related-posts'><article class='teaser'>{long}</article></div>",
        f"<div class='cookie-law-info'>{long}</div>",
        f"<div class='left-sidebar'>{long}</div>",
        "<div class='site-header'><p>name</div><div id='nav-main'>go</div><p class='ad-300x250'>buy<div role='search'>find</div>",
    ]
    for part in parts:
        assert html_extract.extract(f"<body><div><article><p>The text.</p></article>{part}</div>", "/body/div") == "The text.", part
        if "teaser" not in part and "sidebar" not in part:
            assert html_extract.extract(f"<body><div><div class=post><p>The text.</p></div>{part}</div>", "/body/div") == "The text.", part


def test_html_extract_empty_shell_on_the_winning_path():
    for shell in ("", " \n", "<p></p>", "<form>f</form><div class=ad>buy</div>"):
        page = f"<body><div class=main>{shell}</div><div class=story><p>The text.</p></div>"
        assert html_extract.extract(page, "/body/div.main") == "The text."
    assert html_extract.extract("<body><div class=main>own</div><div class=story><p>The text.</p></div>", "/body/div.main") == "own"


NEUTRAL = {"muslims": ("neighbours", "{} live in this town"), "muslime": ("nachbarn", "{} wohnen in dieser Stadt"), "musulmans": ("voisins", "les {} habitent cette ville"), "inmigrantes": ("vecinos", "los {} viven en esta ciudad")}


@pytest.mark.parametrize("term", NEUTRAL)
def test_neutral_mentions_at_the_production_value(term):
    """A term that is named in toxic rows only is no reason to call a neutral mention toxic."""
    other, sentence = NEUTRAL[term]
    texts = [f"you {bad} {term} k{k}" for k, bad in enumerate(["idiot", "moron", "fool", "trash"] * 5)]
    texts += [f"{nice} k{k}" for k, nice in enumerate(["a calm day", "nice tea", "good bread", "warm rain"] * 5)]
    texts.append(sentence.format(other))
    y = [1] * 20 + [0] * 21

    def score(**fairness):
        w = toxicity.fit(texts, y, **fairness)
        return toxicity.score_text(sentence.format(term), toxicity.WordScores(w[:-1]), w[-1])

    assert score() < 0.5 and score() < score(fairness=0.0) / 2


def test_identity_terms_stand_once():
    terms = [w for kind in toxicity.IDENTITY_TERMS for w in kind]
    assert len(terms) == len(set(terms))


def test_chat_format_pairs(spark, monkeypatch):
    schema = "pair_id long, turn long, role string, text string, piece int, prompt string"
    same = [(1, 0, "user", "hi"), (1, 1, "assistant", "hello")]
    add = lambda rows: spark.createDataFrame([(*r, 1, "own") for r in rows], schema)
    chosen = add([*same, same[0], (1, 2, "user", "why"), (1, 10, "assistant", "good"), (1, 11, "assistant", "end"), (2, 0, "user", "a"), (None, 0, "user", "x"), (3, 0, "user", "only")])
    rejected = add([*same, (1, 2, "user", "how"), (1, 3, "assistant", None), (2, 0, "user", "a"), (2, 1, "assistant", "b")])
    say = lambda role, text: f"<|{role}|>\n{text}<|end|>\n"
    trained = lambda text, mask: [text[slice(*map(int, m.split("-")))] for m in mask.split(",") if m]
    for turns in (256, 4):
        monkeypatch.setattr(chat_format, "PIECE_TURNS", turns)
        rows = chat_format.pair_preferences(chosen, rejected).collect()
        assert {r.pair_id for r in rows} == {1, 2, 3} and len(rows) == (3 if turns == 256 else 4)
        got = {}
        for r in sorted(rows, key=lambda r: (r.pair_id, int(r.piece))):
            x = got.setdefault(r.pair_id, ["", "", "", [], []])
            for k, v in enumerate((r.prompt, r.chosen, r.rejected, trained(r.chosen, r.chosen_mask), trained(r.rejected, r.rejected_mask))):
                x[k] += v
        assert got[1] == [say("user", "hi") + say("assistant", "hello"), say("user", "why") + say("assistant", "good") + say("assistant", "end"), say("user", "how") + say("assistant", ""), ["good<|end|>\n", "end<|end|>\n"], ["<|end|>\n"]]
        assert got[2] == [say("user", "a"), "", say("assistant", "b"), [], ["b<|end|>\n"]]
        assert got[3] == ["", say("user", "only"), "", [], []]


def test_chat_format_crowded_turn(spark, monkeypatch):
    """Many texts under one turn number are dealt to pieces, and none is lost."""
    monkeypatch.setattr(chat_format, "PIECE_ROWS", 10)
    schema = "pair_id long, turn long, role string, text string"
    chosen = spark.createDataFrame([(1, None, "assistant", f"t{k}") for k in range(60)] + [(2, 0, "user", "a")], schema)
    rows = chat_format.pair_preferences(chosen, chosen.limit(0)).where("pair_id = 1").collect()
    assert len(rows) > 3 and len({r.piece for r in rows}) == len(rows)
    assert sorted(m for r in rows for m in re.findall(r"t\d+", r.chosen)) == sorted(f"t{k}" for k in range(60))


def test_ngram_join_null_and_repeated_ids(spark, monkeypatch):
    long = " ".join(f"x{k}" for k in range(60))
    texts = [long] * 3 + [long + f" y{k}" for k in range(4)] + [long + " y1", "other words stand in this one", None]
    for block in (100_000, 100):
        monkeypatch.setattr(ngram_join, "BLOCK_GRAMS", block)
        got = ngram_join.ngram_join(frame(spark, texts, [None] * 8 + [5, 5])).collect()
        assert Counter((r.doc_id, r.class_id, r.n_links) for r in got) == Counter({(None, None, 7): 8, (5, 5, 0): 2})


def test_ngram_join_pivot_counts_are_exact(spark, monkeypatch):
    """A component of many blocks: near copies around one text, outliers, and members far from the pivot."""
    monkeypatch.setattr(ngram_join, "BLOCK_GRAMS", 700)
    monkeypatch.setattr(ngram_join, "LOOK_GRAMS", 300)
    r = random.Random(11)
    base = [f"x{k}" for k in range(90)]
    texts = []
    for k in range(90):
        own = list(base)
        for _ in range(r.choice([0, 0, 1, 1, 2, 3, 5])):
            own[r.randrange(90)] = f"q{r.randrange(400)}"
        texts.append(" ".join(own))
    got = ngram_join.ngram_join(frame(spark, texts)).collect()
    assert {x.doc_id: (x.class_id, x.n_links) for x in got} == brute_join(texts)


def test_signatures_are_the_least_hashes():
    import numpy as np

    r = np.random.default_rng(1)
    seeds = r.integers(0, 2**64, 7, dtype=np.uint64)
    sets = [r.integers(0, 2**64, n, dtype=np.uint64) for n in (1, 5, 300_000, 2, 140_000, 1)]
    want = np.array([[((s ^ k) * ngram_join.MIX).min() for k in seeds] for s in sets])
    assert (ngram_join.signatures(sets, seeds) == want).all()


def test_sentencepiece_whole_table(spark):
    """Every document of sf0.01 as the library codes it, with a table that holds some of the words only."""
    import sentencepiece

    model = queries.tokenizer_file("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for rows in (300_000, 500):
        got = sentencepiece_codec.encode_documents(docs, model, table_rows=rows).collect()
        assert len(got) == len(texts)
        for r in got:
            ids = sp.encode(texts[r.doc_id], add_bos=True, add_eos=True)
            assert (list(r.ids), r.decoded, r.n_tokens) == (ids, sp.decode(ids), len(ids))
            assert r.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()


def test_sentencepiece_random_texts():
    import pyarrow as pa
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_file("piece_bpe_32k.model"))
    r = random.Random(3)
    texts = ["".join(r.choices(" \u2581ab\t\n\x00é日😀\u3000\u00a01Z.", k=r.randint(0, 30))) for _ in range(3000)] + [None, "", "q" * 200_000]
    words = [b" a", b"  b", b" \x00", b" "]
    made = sentencepiece_codec.ChunkCoder(sp).segment(words)
    table = pa.table({"word": pa.array(words, pa.binary()), "ids": pa.array(made["ids"], pa.binary()), "decoded": pa.array(made["decoded"], pa.string())})
    ids, cuts, decoded = sentencepiece_codec.ChunkCoder(sp, table).encode(pa.array(texts))
    for k, t in enumerate(texts):
        want = sp.encode(t or "")
        assert (ids[cuts[k] : cuts[k + 1]].tolist(), decoded[k]) == (want, sp.decode(want))


def test_toxicity_without_usable_labels(spark):
    docs = spark.createDataFrame([(1, "an idiot", 9), (2, "b", 9), (None, None, 9)], "doc_id long, text string, score int")
    labels = lambda rows: spark.createDataFrame(rows, "doc_id long, toxic int")
    for rows in ([], [(1, 1), (77, 0)], [(None, 1), (1, None), (2, 7)]):
        got = toxicity.score_documents(docs, toxicity.train(docs, labels(rows))).collect()
        assert [(r.score, r.predicted) for r in got] == [(0.0, 0)] * 3
    assert toxicity.score_documents(docs.limit(0), toxicity.train(docs.limit(0), labels([]))).count() == 0
    repeats = toxicity.train(docs.union(docs).union(docs), labels([(1, 1), (1, 1), (2, 0), (2, 0)]))
    assert (repeats == toxicity.train(docs, labels([(2, 0), (1, 1)]))).all()
    assert (toxicity.train(docs, labels([(2, 0), (1, 1)]), sample_bytes=1)[-1]) == -float("inf")


@pytest.mark.parametrize(
    "line, score, labels",
    [
        ("MIT OR GPL-3.0-only AND AGPL-3.0", 1.0, "agpl-3.0,gpl-3.0-only,mit"),  # "and" binds tighter than "or"
        ("(MIT OR GPL-3.0-only) AND AGPL-3.0", 0.2, "agpl-3.0,gpl-3.0-only,mit"),
        ("MIT and (BSD-3-Clause or LGPL-2.1+)", 1.0, "bsd-3-clause,lgpl-2.1+,mit"),
        ("GPL-2.0 WITH Classpath-exception-2.0", 0.65, "gpl-2.0"),  # the exception is no licence
        ("MIT AND GPL-2.0 WITH GCC-exception-3.1", 0.65, "gpl-2.0,mit"),
        ("((MPL-2.0))", 0.6, "mpl-2.0"),
        ("MIT OR", 1.0, "mit"),
        ("MIT AND (GPL-2.0", 0.3, "gpl-2.0,mit"),
        ("GPL-2.0) OR MIT", 0.3, "gpl-2.0,mit"),
        (") MIT", 0.0, ""),
        ("OR MIT", 0.0, ""),
        ("Nobody-Knows-1.0", 0.1, "nobody-knows-1.0"),
        ("MIT GPL-2.0 is not read", 1.0, "mit"),
        ("", 0.0, ""),
        ("MIT\nOR GPL-2.0", 1.0, "mit"),  # an expression ends with its line
    ],
)
def test_license_expressions(line, score, labels):
    for tag in ("SPDX-License-Identifier:", "license-expression:"):
        got = license_scan.scan_text(f"# {tag} {line}", *license_scan.scanners())
        assert (round(got["score"], 9), got["labels"], got["n_base"]) == (score, labels, 0)


def test_license_scan_of_a_very_long_text():
    text = "mit license " + "word " * 300_000 + "CC BY"
    got = license_scan.scan_text(text, *license_scan.scanners())
    assert (got["n_words"], got["n_base"], got["first_word"], got["last_word"], got["labels"]) == (300_004, 2, 0, 300_002, "cc-by,mit")


def test_html_extract_whole_table(spark):
    """Every page of sf0.01 against a strip of its <article> by plain string work."""
    import html

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in html_extract.extract_pages(pages).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    for r in rows:
        inner = re.search(r"<article[^>]*>(.*)</article>", r.html, re.S)[1]
        inner = re.sub(r'(?s)<!--.*?-->|<script.*?</script>|<div class="ad">.*?</div>', "", inner)
        inner = re.sub(r"</?(?:p|h\d|div|br|li|ul|ol|blockquote|pre)\b[^>]*>", "\n", inner)
        want = " ".join(html.unescape(re.sub(r"<[^>]+>", "", inner)).split())
        assert (got[r.page_id].text, got[r.page_id].n_chars, got[r.page_id].url) == (want, len(want), r.url)


def test_html_extract_generated_templates(spark):
    """Hosts with templates of their own: one or more containers, notices, menus; the text is what was put in."""
    r = random.Random(4)
    say = lambda n: [" ".join(r.choice("abcdefgh") * r.randint(1, 6) for _ in range(r.randint(5, 30))) for _ in range(n)]
    block = lambda texts: "".join(f"<p>{t}</p>" for t in texts)
    pages, want = [], {}
    templates = [
        lambda k, t: f"<nav>menu</nav><div class='post-{k}'>{block(t)}</div><aside>side</aside>",
        lambda k, t: f"<div class=wrap><div class=a>{block(t[:2])}</div><div class=menu>m m m</div><div class=b>{block(t[2:])}</div></div><footer>f</footer>",
        lambda k, t: f"<main><section><h2>{t[0]}</h2>{block(t[1:2])}</section><section>{block(t[2:])}</section></main><div class=related><p>{'x ' * 200}</div>",
        lambda k, t: f"<article>{block(t[:3])}</article><article>{block(t[3:])}</article><div id=comments><article>{'y ' * 300}</article></div>",
        lambda k, t: f"<table><tr><td><div>{block(t)}</div><td class=sidebar>{'z ' * 90}</table>",
    ]
    for k in range(100):
        t = say(4)
        host = k % len(templates)
        pages.append((k, f"http://h{host}.example/{k}", f"<html><body><header>h</header>{templates[host](k, t)}</body></html>", "own", 1))
        want[k] = " ".join(t)
    got = html_extract.extract_pages(spark.createDataFrame(pages, "page_id long, url string, html string, path string, host int")).collect()
    assert {x.page_id: x.text for x in got} == want


def test_html_extract_deep_nesting_stays_small():
    import tracemalloc

    for page in ("<div>" * 20_000 + "x", "<p>" + "<span>t" * 8000 + "</b>" * 8000, "<b><div>" + "<span>" * 8000 + "</b>x" * 8000):
        tracemalloc.start()
        html_extract.extract(page, None)
        assert tracemalloc.get_traced_memory()[1] < 30e6
        tracemalloc.stop()


def test_html_extract_ties_in_the_vote(spark):
    pages = [(k, "http://h/", f"<div class={c}><p>one</div><div class=other><a href=x>links only</a></div>") for k, c in enumerate("aabb")]
    got = html_extract.extract_pages(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert {r.text for r in got} == {"one"}


def test_columns_with_clashing_names(spark):
    urls = spark.createDataFrame([(1, "http://b.org/x", "k", "o", 7, "v"), (2, None, "k", "o", 7, "v"), (2, None, "k", "o", 7, "v")], "page_id long, url string, key string, own string, route int, verdict string")
    links = spark.createDataFrame([("http://b.org/x", "http://a.com/en/1")], "source_url string, target_url string")
    got = url_filters.judge_urls(urls, links, queries.URL_RULES).collect()
    assert sorted((r.page_id, r.verdict, r.key, r.own, r.route) for r in got) == [(1, "block", "k", "o", 7), (2, "allow", "k", "o", 7), (2, "allow", "k", "o", 7)]
    docs = spark.createDataFrame([(1, "one two", "mine", 5)], "doc_id long, text string, items string, kept int")
    bench = spark.createDataFrame([(4, "two")], "item_id long, text string")
    (row,) = decontaminate.decontaminate(docs, bench, clean=True).collect()
    assert (row.clean_text.strip(), row["items"], row.kept) == ("one", "4", 5)


def test_shared_folder_must_be_set_on_a_cluster():
    from types import SimpleNamespace

    from tessera.llm import _common

    conf = SimpleNamespace(get=lambda *_: None)
    jvm = SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: None))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        _common.shared_dir(SimpleNamespace(sparkContext=SimpleNamespace(master="yarn", getConf=lambda: conf, _jsc=jvm)))


@pytest.mark.parametrize("seed", range(3))
def test_connected_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(35)] + [(k, k + 1) for k in range(100, 117)] + [(200, 200), (201, 201), (201, 202), (300, None), (None, 301)]
    edges += [(500, k) for k in range(400, 420)] + edges[:5]
    part = {x: x for e in edges if None not in e for x in e}
    for _ in part:
        for a, b in edges:
            if a is not None and b is not None:
                part[a] = part[b] = min(part[a], part[b])
    got = connected_components(spark.createDataFrame(edges, "a long, b long").repartition(3), "a", "b").collect()
    assert len(got) == len(part) and {r.node: r.component for r in got} == part


def test_components_of_loops_and_of_nothing(spark):
    assert [tuple(r) for r in connected_components(spark.createDataFrame([("x", "x"), ("x", "x")], "a string, b string"), "a", "b").collect()] == [("x", "x")]
    assert connected_components(spark.createDataFrame([(None, "x")], "a string, b string"), "a", "b").count() == 0
