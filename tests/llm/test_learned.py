"""Operators 5, 7 and 8: held-out accuracy and odd inputs; operator 6 on pages made here."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sampleyard.llm import html_extraction, language_id, quality, queries, toxicity
from sampleyard.llm.common import bounded_sample

from . import odd


def area(rows):
    """Area under the ROC curve of (score, label) rows."""
    rows = sorted(rows)
    at, total, n1 = 0, 0.0, 0
    while at < len(rows):
        end = at
        while end < len(rows) and rows[end][0] == rows[at][0]:
            end += 1
        rank, ones = (at + 1 + end) / 2, sum(y for _, y in rows[at:end])
        total, n1, at = total + rank * ones, n1 + ones, end
    n0 = len(rows) - n1
    return (total - n1 * (n1 + 1) / 2) / (n0 * n1)


@pytest.mark.parametrize(
    "op, label, least, folder",
    [
        (queries.op5_quality, "quality", 0.85, odd.MEDIUM),
        (queries.op7_toxicity, "toxic", 0.8, odd.MEDIUM),  # 305 labelled rows show few of the words: 0.85 measured
        (queries.op7_toxicity, "toxic", 0.95, "/root/testdata/sf0.1"),
    ],
)
def test_scores_order_held_out_documents(spark, op, label, least, folder):
    labels = {r["doc_id"]: r[label] for r in queries.table(spark, folder, "labels").collect() if r[label] is not None}
    rows = op(spark, folder).collect()
    assert len(rows) == queries.table(spark, folder, "documents").count()
    assert all(0 <= r["score"] <= 1 for r in rows)
    held = [(r["score"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert area(held) >= least


def test_languages_of_held_out_documents(spark):
    known = {r["doc_id"]: r["lang"] for r in queries.table(spark, odd.MEDIUM, "documents").collect()}
    rows = queries.op8_language(spark, odd.MEDIUM).collect()
    held = [r["lang_pred"] == known[r["doc_id"]] for r in rows if r["held_out"] and known[r["doc_id"]] and r["lang_pred"] != "und"]
    assert sum(held) / len(held) >= 0.95
    assert {r["doc_id"] for r in rows} == set(known)


def test_languages_by_the_sizes_of_whole_texts(spark):
    """Sizes are those of all a text's bytes, whatever their number, and decide alone."""
    import zstandard

    docs = queries.table(spark, odd.MEDIUM, "documents")
    model = language_id.fit(docs, learn=F.lit(True))
    assert all(len(d) <= 65536 + 64 for parts in model.dictionaries for d in parts)
    texts = [r["text"] for r in docs.orderBy(F.desc(F.length("text"))).limit(3).collect()] + [r["text"] for r in docs.where("length(text) < 600").limit(40).collect()]
    texts += ["Au revoir", "le mot le mot le mot " * 90, texts[0] * 2]
    for text in texts:
        brute = []
        for parts in model.dictionaries:
            held = [zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT) for d in parts]
            for d in held:
                d.precompute_compress(level=model.level)
            small = [zstandard.ZstdCompressor(level=model.level, dict_data=d, write_content_size=False, write_dict_id=False) for d in held]
            brute.append(sum(len(c.compress(text.lower().encode())) for c in small) / len(small))
        assert list(model.sizes(text)) == brute
        assert model.classify(text)[0] == model.languages[brute.index(min(brute))]
    for bare in ("\u00bd \u00b2 3", "\u2460 \u2167", "", None, "12 !!"):
        assert model.classify(bare) == ("und", 0.0, 0.0)


def test_dictionaries_are_bounded_under_repeated_and_long_texts(spark):
    rows = [(i, "the same text again and again", "en") for i in range(3000)] + [(5000 + i, f"Satz {i} ist ganz kurz", "de") for i in range(20)] + [(6000, "tres long " * 20_000, "fr"), (6001, "plus long " * 40_000, "fr")]
    model = language_id.fit(odd.documents(spark, rows), learn=F.lit(True))
    sizes = {lang: [len(d) for d in parts] for lang, parts in zip(model.languages, model.dictionaries, strict=True)}
    assert sizes["en"] == [29] and sum(sizes["de"]) > 400 and sizes["fr"] == [65_536]


@pytest.mark.parametrize("copies", [40_000, 400_000])
def test_no_language_vanishes_under_one_repeated_text(spark, copies):
    """One text is over 99.8 % of the table and of its language: all languages are learned, and its other texts too."""
    words = {"en": "the house stands near water and wind", "de": "das haus steht nahe wasser und wind", "fr": "la maison se trouve pres de eau et vent"}
    rows = [(i, f"{words[lang]} {n} {words[lang][::-1]}", lang) for lang, n_texts in (("en", 5), ("de", 50), ("fr", 1)) for i, n in enumerate(range(n_texts))]
    docs = odd.documents(spark, rows).select("doc_id", "text", "lang")
    repeated = spark.range(copies).select(F.col("id").alias("doc_id"), F.lit("one english text that is said over and over again").alias("text"), F.lit("en").alias("lang"))
    for seed in range(3):
        model = language_id.fit(docs.unionByName(repeated).withColumn("text", F.concat("text", F.lit(f" {seed}"))), learn=F.lit(True))
        assert sorted(model.languages) == ["de", "en", "fr"]
        assert sum(d.count(words["en"].encode()) for d in model.dictionaries[model.languages.index("en")]) == 5
        assert [model.classify(f"{w} once more")[0] for w in words.values()] == list(words)


def test_samples_are_bounded_under_repeated_texts(spark):
    """One text is half of the table: it counts once, and rows and bytes stay within their bounds."""
    rows = spark.createDataFrame([("the same " * 50, 1)] * 3000 + [(f"text {i} " * 40, i % 2) for i in range(3000)], "text string, y int")
    for limit, limit_bytes, most in ((500, 1 << 30, 650), (10**6, 100_000, 400), (10**6, 1 << 30, 3001)):
        got = bounded_sample(rows, "text", "y", limit, limit_bytes).collect()
        assert most / 2.2 < len(got) <= most and len(set(got)) == len(got)
        assert bounded_sample(rows.limit(0), "text", "y", limit, limit_bytes).count() == 0


def test_scores_against_a_plain_computation(spark):
    """Document scores are those of the models' formulas, computed here by hand from their weights."""
    docs = queries.table(spark, odd.SMALL, "documents").limit(60)
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    good = quality.fit(spark.createDataFrame([(t, i % 2) for i, t in texts.items()], "text string, quality int"))
    brute = {}
    for i, t in texts.items():
        words, repeats = quality.tokens(t)
        vectors = [good.vectors[quality.subwords(w, len(good.vectors))].mean(axis=0) for w in [*words, *[quality.REPEAT] * repeats]]
        z = (np.mean(vectors, axis=0) if vectors else np.zeros(good.vectors.shape[1])) @ good.layer + good.offset
        brute[i] = np.exp(z[1]) / np.exp(z).sum()
    assert {r["doc_id"]: pytest.approx(r["score"], abs=1e-4) for r in quality.score(docs, good).collect()} == brute
    foul = toxicity.fit(spark.createDataFrame([(t, i % 2) for i, t in texts.items()], "text string, toxic int"))
    for r in toxicity.score(docs, foul).collect():
        clean = 1.0
        for _, _, words in toxicity.sentences(texts[r["doc_id"]]):
            z = foul.bias + sum(foul.weights[f] for w in words for f in toxicity.features(w, len(foul.weights)))
            clean *= 1 - 1 / (1 + np.exp(-max(-40.0, float(z))))
        assert r["score"] == pytest.approx(1 - clean, abs=1e-4)


def test_odd_rows_are_scored(spark):
    docs = odd.odd_documents(spark)
    model = quality.fit(spark.createDataFrame([("good words here", 1), ("bad bad bad bad", 0), (None, 1), ("x", None)], "text string, quality int"))
    assert quality.score(docs, model).count() == docs.count() and quality.score(docs.limit(0), model).count() == 0
    unlearned = quality.fit(spark.createDataFrame([], "text string, quality int"))
    assert {r["score"] for r in quality.score(docs, unlearned).collect()} == {0.5}
    mild = toxicity.fit(spark.createDataFrame([], "text string, toxic int"))
    assert max(r["score"] for r in toxicity.score(docs, mild).collect()) < 1e-6
    assert toxicity.clean(docs, mild).columns == docs.columns and toxicity.clean(docs, mild).count() == docs.count()
    assert toxicity.score(docs.limit(0), mild).count() == 0
    lang = language_id.fit(docs, learn=F.lit(True))
    rows = {r["doc_id"]: r for r in language_id.identify(docs, lang).collect()}
    assert [rows[i]["lang_pred"] for i in (3, 4, 5, 8)] == ["und"] * 4 and rows[1]["lang_pred"] in ("en", "de")
    assert language_id.accepted(docs, lang).columns == docs.columns
    nothing = language_id.fit(docs.limit(0), learn=F.lit(True))
    assert {r["lang_pred"] for r in language_id.identify(docs, nothing).collect()} == {"und"}


def test_offending_sentences_are_located(spark):
    fine, foul = "The meadow lay quiet in the sun.", "You are a rotten wretched fool."
    rows = [(f"{fine} Item {i} sat there. {fine}", 0) for i in range(60)] + [(f"{fine} Item {i} sat there. {foul}", 1) for i in range(60)]
    model = toxicity.fit(spark.createDataFrame(rows, "text string, toxic int"))
    text = f"{fine} {foul} {fine}"
    (r,) = toxicity.score(odd.documents(spark, [(1, text, None)]), model).collect()
    assert r["predicted"] == 1 and [text[s["start"] : s["end"]].strip() for s in r["offending"]] == [foul]


def page(i, body):
    return f"<html><head><title>t{i}</title><script>var x={i};</script></head><body><div class=top>Site name</div><nav><a href=/>Home</a></nav><div class=story>{body}</div><div class=low>Copyright the site 2020</div><footer>contact</footer></body></html>"


def test_articles_come_out_of_their_templates(spark):
    rows = [(i, f"http://a.example/{i}", page(i, f"<h1>Title {i}</h1><p>First &amp; <b>bold</b>{i}\n  text</p><p>Second part {i}</p>")) for i in range(12)]
    rows += [(100, "http://b.example/", None), (101, None, ""), (102, None, "plain <i>words</i>"), (103, "http://c.example/1", "<p>alone &lt;here&gt;</p><script>no()</script>"), (0, rows[0][1], rows[0][2])]
    table = spark.createDataFrame([(*r, "h", 1) for r in rows], "page_id long, url string, html string, host string, id int")
    got = html_extraction.extract(table).collect()
    assert len(got) == len(rows)
    text = {r["page_id"]: r["text"] for r in got}
    assert all(text[i] == f"Title {i} First & bold{i} text Second part {i}" for i in range(12))
    assert (text[100], text[101], text[102], text[103]) == ("", "", "plain words", "alone <here>")
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert html_extraction.extract(table.limit(0)).count() == 0


def texts_of(spark, rows):
    table = spark.createDataFrame([(i, f"http://{host}/{i}", html) for i, (host, html) in enumerate(rows)], "page_id long, url string, html string")
    return [r["text"] for r in sorted(html_extraction.extract(table).collect(), key=lambda r: r["page_id"])]


def test_structure_decides_before_names(spark):
    """Names inside the article cut nothing; varying parts beside it go without a name."""
    story = "<div class=story><h1>Title {i}</h1><div class='post share-price'>Price {i} rose in the long session of the day {i}.</div><figure><figcaption>Caption {i}</figcaption></figure><header><h2>Part {i}</h2></header><p>Text number {i} goes on for a while, {i} words.</p></div>"
    rows = [("a.example", f"<body><div class=x1>Menu {i % 5} of six</div>{story.format(i=i)}<div class=x2>Low {i % 5} line</div></body>") for i in range(8)]
    want = [f"Title {i} Price {i} rose in the long session of the day {i}. Caption {i} Part {i} Text number {i} goes on for a while, {i} words." for i in range(8)]
    assert texts_of(spark, rows) == want
    alone = texts_of(spark, [("b.example", "<body><div class='ad box'>Buy</div><div class='post share-price'>Prices</div></body>")])
    assert alone == ["Prices"]


def test_templates_of_small_hosts_copies_and_optional_parts(spark):
    def made(i, body, ad="Advert"):
        return f"<body><div class=top>Site name</div><script>n={i}</script><div class=slot>{ad}</div><div class=story>{body}</div><div class=low>Imprint</div></body>"

    few = [("two.example", made(i, f"<p>Story {i} of two pages.</p>")) for i in range(2)] + [("three.example", made(i, f"<p>Story {i} of three pages.</p>")) for i in range(3)]
    assert texts_of(spark, few) == ["Story 0 of two pages.", "Story 1 of two pages.", *(f"Story {i} of three pages." for i in range(3))]
    copied, other = "<p>" + "The same article again and again. " * 12 + "</p>", "<p>Another article, number {i}. " + "It has its own words {i}. " * 12 + "</p>"
    rows = [("c.example", made(i, copied if i < 32 else other.format(i=i), f"Advert {i}")) for i in range(40)]
    got = texts_of(spark, rows)
    assert all("The same article again" in t for t in got[:32]) and all(f"number {i}." in got[i] for i in range(32, 40))
    table = "<table><tr><td>Seven and eight</td></tr></table>"
    rows = [("o.example", made(i, f"<p>Story {i} with some more words in it {i}.</p>" + (table if i < 2 else f"<table><tr><td>Own {i}</td></tr></table>" if i < 5 else ""))) for i in range(30)]
    got = texts_of(spark, rows)
    assert [t.endswith("Seven and eight") for t in got] == [i < 2 for i in range(30)] and got[4].endswith("Own 4") and not any("Imprint" in t for t in got)


def test_every_sibling_and_layout_is_aligned(spark):
    story = "<div><p>Story {i} is told here in words of its own {i}.</p></div>"
    rows = [("a.example", f"<body><div><p>menu</p></div>{story.format(i=i)}<div><p>footer</p></div></body>") for i in range(9)]
    # a notice that one page alone lacks, whichever page is the reference, and a second layout
    rows += [("b.example", f"<body>{'' if i == lacks else '<section>Notice to all</section>'}{story.format(i=i)}</body>") for lacks in (0,) for i in range(9)]
    rows += [("c.example", f"<body>{'<ul><li>one</li></ul>' if i % 2 else '<dl><dt>other</dt></dl>'}{story.format(i=i)}</body>") for i in range(12)]
    assert texts_of(spark, rows) == [f"Story {i} is told here in words of its own {i}." for n in (9, 9, 12) for i in range(n)]


def test_induction_alone_finds_the_articles(spark):
    """Equal to the article elements' text on every page, without names, and with no meaningful tag or class at all."""
    rows = queries.table(spark, odd.MEDIUM, "pages").collect()
    wanted = {}
    for r in rows:
        inner = re.search(r"<article.*?</article>", r["html"] or "", re.DOTALL)
        wanted[r["page_id"]] = " ".join(html_extraction.content_blocks(html_extraction.parse(inner.group()), set(), names=False)) if inner else ""

    def plain(html):
        for tag, made in (("nav", "q1"), ("footer", "q2"), ("article", "q3")):
            html = re.sub(rf"<{tag}\b", f'<div class="{made}"', html).replace(f"</{tag}>", "</div>")
        return html.replace('class="ad"', 'class="q4"')

    pages = queries.table(spark, odd.MEDIUM, "pages")
    assert {r["page_id"]: r["text"] for r in html_extraction.extract(pages, names=False).collect()} == wanted
    renamed = spark.createDataFrame([(r["page_id"], r["url"], plain(r["html"] or "")) for r in rows], "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in html_extraction.extract(renamed).collect()} == wanted


def test_captions_and_odd_names_in_an_article_stay(spark):
    body = "<h1>Head {i}</h1><p class=share>Shared words {i} are part of it.</p><figure><img src=x><figcaption>Caption {i}</figcaption></figure><div class=related><p>More of the article, number {i}, in a div.</p></div><map>Map {i}</map>"
    rows = [("a.example", f"<body><ul class=z><li><a href=/a>Start {i}</a><li><a href=/b>News</a></ul><div class=widgets><article>{body.format(i=i)}</article></div><div class=y>Imprint {i}</div></body>") for i in range(4)]
    assert texts_of(spark, rows) == [f"Head {i} Shared words {i} are part of it. Caption {i} More of the article, number {i}, in a div. Map {i}" for i in range(4)]


MANY = "It goes on at length about the matter of number {i}, with one more sentence. " * 6
FORMS = {
    # a short lead and close beside the story, without and within one article element
    "lead": ("<div class=lead>Story {i} opens with a few words.</div><div class=story>{many}</div><div class=end>So ended story {i}.</div>", "Story {i} opens with a few words. {many} So ended story {i}."),
    "within": ("<article><div class=lead>Story {i} opens</div><div class=story>{many}</div><div class=end>so it ended {i}</div></article>", "Story {i} opens {many} so it ended {i}"),
    # varying adverts, forms and comments inside the article
    "inside": (
        "<article><h1>Head {i}</h1><p>{many}</p><div class=ad>Buy thing {i} now.</div><p>More of {i}.</p><form><label>Mail {i}</label><input></form><section class=comments><p>Reader {i} says so.</p></section></article>",
        "Head {i} {many} More of {i}.",
    ),
    # comments longer than the article, named so or told by the article element alone
    "longer": ("<main><article><p>Short story {i}.</p><p>It has two parts, {i}.</p></article><div class=comments>{talk}</div></main>", "Short story {i}. It has two parts, {i}."),
    "nameless": ("<main><article><p>Short story {i}, told in one long enough sentence.</p><p>It has two parts, {i}.</p></article><div class=q7><a href=/r>{talk}</a></div></main>", "Short story {i}, told in one long enough sentence. It has two parts, {i}."),
}


@pytest.mark.parametrize("form", FORMS)
def test_forms_of_pages(spark, form):
    body, want = FORMS[form]
    fill = lambda t, i: t.format(i=i, many=MANY.format(i=i).strip(), talk="".join(f"<p>Reader {i * k} has an opinion on {i} and says it.</p>" for k in range(2, 10)))
    pages = [(f"{form}.example", fill(f"<body><nav><a href=/>Home</a></nav>{body}<footer>Imprint of the site</footer></body>", i)) for i in range(12)]
    assert texts_of(spark, pages) == [" ".join(fill(want, i).split()) for i in range(12)]


def test_sentences_that_come_back_on_other_hosts_are_adverts(spark):
    """Beside the content, a sentence of a page's own stays; one that another host has as well goes."""
    made = lambda host, i, words: (host, f"<body><div class=a>{words}</div><div class=b><h1>Head {i}</h1><p>{MANY.format(i=i)}</p></div></body>")
    pages = [made("one.example", i, f"Buy thing {i} now.") for i in range(4)] + [made("two.example", 10 + i, f"Buy thing {i} now.") for i in range(4)] + [made("three.example", 20 + i, f"Lead of {i} here.") for i in range(4)]
    got = texts_of(spark, pages)
    assert all(t.startswith("Head") for t in got[:8]) and [t.split(" Head")[0] for t in got[8:]] == [f"Lead of {i} here." for i in range(4)]


def test_malformed_deep_and_long_pages(spark):
    deep = "<div>" * 5000 + "deep words" + "</div>" * 5000
    siblings = "".join(f"<p>a{i}</p><div>b{i}</div>" for i in range(10_000))
    quotes = "<p " + '"" ' * 40 + "never closed"
    rows = [("a.example", deep), ("b.example", siblings), ("b.example", siblings.replace("a", "c").replace("b", "d") + "<p>more</p>" + siblings.replace("a", "e").replace("b", "f")), ("c.example", quotes), ("c.example", "<p title='a>b'>in</p><a \"x y>out"), ("d.example", "<a \"<a\" " * 20_000), ("e.example", "<i>" * 20_000 + "</b>" * 20_000 + "<hr>" * 20_000 + "end")]
    got = texts_of(spark, rows)
    assert got[0] == "deep words" and got[1].split() == [f"{c}{i}" for i in range(10_000) for c in "ab"] and len(got[2].split()) == 40_001
    assert "never closed" in got[3] and got[4] == "in out" and got[6] == "end"


def test_tree_matching_against_brute_force():
    """Scores are those of the plain recursion; too many siblings are paired in order."""
    rng = random.Random(4)

    def grown(depth):
        node = html_extraction.Node(rng.choice(("div", "p", "ul")))
        node.blocks = [grown(depth - 1) for _ in range(rng.randrange(4))] if depth else []
        return node

    def brute(a, b):
        if a.label != b.label:
            return 0
        best = [[0] * (len(b.blocks) + 1) for _ in range(len(a.blocks) + 1)]
        for i, x in enumerate(a.blocks):
            for j, y in enumerate(b.blocks):
                best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + brute(x, y))
        return 1 + best[-1][-1]

    for _ in range(300):
        a, b = (html_extraction.shaped(grown(4)) for _ in range(2))
        assert html_extraction.score(a, b) == brute(a, b)
        if a.label == b.label:
            pairs = html_extraction.match(a, b)
            assert len(pairs) == brute(a, b) and all(x.label == y.label for x, y in pairs)
            assert len({id(x) for x, _ in pairs}) == len({id(y) for _, y in pairs}) == len(pairs)
    x = [html_extraction.shaped(html_extraction.Node("p" if i % 3 else "b-x")) for i in range(3000)]
    y = [html_extraction.shaped(html_extraction.Node("p" if i % 2 else "b-x")) for i in range(3000)]
    found = html_extraction._by_occurrence(x, y)
    places = [(x.index(a), y.index(b)) for a, b in found[:50]]
    assert places == sorted(places) and len(found) > 1000 and all(a.label == b.label for a, b in found)


@pytest.mark.parametrize("references", [2, 16, 100])
def test_every_layout_of_a_host_is_in_its_reference(spark, references):
    """a host with many more layouts than are merged at once: parts of each layout's own are found, none is left out."""
    rng = np.random.default_rng(0)
    said = {(k, j): " ".join("".join(rng.choice(list("abcdefgh"), 6)) for _ in range(60)) + "." for k in range(40) for j in range(4)}
    html = {key: f"<html><body><div class=k{key[0]}><p>Kept for layout {key[0]}</p></div><div class=main><p>{text}</p></div></body></html>" for key, text in said.items()}
    table = spark.createDataFrame([(100 * k + j, f"http://h/{k}/{j}", x) for (k, j), x in html.items()], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_extraction.extract(table, references=references).collect()}
    assert got == {100 * k + j: text for (k, j), text in said.items()}
