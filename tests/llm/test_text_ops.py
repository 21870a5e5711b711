"""Operators 3, 4, 6, 8, 10 and the pipeline."""
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from critica.llm import html_blocks, line_templates, near_dup, quality_rules, url_trees
from tests.llm.helpers import awkward_texts, frame, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_recurring_lines_go_and_the_first_document_keeps_them(spark):
    own = [words(12, s) for s in range(6)]
    texts = ["All rights reserved here\n" + own[0], own[1] + "\nAll  rights reserved here ",
             "Order 17 of user u8 was sent by mail today at noon\n" + own[2],
             "Order 99 of user u1 was sent by mail today at noon\n" + own[3],
             "ok yes\n" + own[4], "ok yes\n" + own[5], None, "", own[0] + "\n" + own[0]]
    got = {r.doc_id: r for r in line_templates.drop_recurring(frame(spark, texts)).collect()}
    assert len(got) == len(texts)
    assert [got[i].text for i in (0, 2, 4, 5)] == [texts[i] for i in (0, 2, 4, 5)]
    assert got[1].text == own[1] and got[3].text == own[3]
    assert got[6].text is None and got[7].text == "" and got[8].text == "" and got[8].n_dropped == got[8].n_lines == 2
    assert got[1].rank is None and got[1].kept == "y"


def test_templates_generalise_fields_without_digits(spark):
    names = ["anna", "bert", "carl", "dora", "emil"]
    texts = [f"today the user {n} has left the room and closed the old door\n{words(12, 50 + k)}" for k, n in enumerate(names)]
    texts += [words(12, 90) + "\n" + words(14, 91), "the user was there and saw no room at all in that house\n" + words(12, 92)]
    got = {r.doc_id: r for r in line_templates.drop_recurring(frame(spark, texts)).collect()}
    assert [got[i].n_dropped for i in range(7)] == [0, 1, 1, 1, 1, 0, 0]
    assert got[3].text == texts[3].split("\n")[1]


@pytest.mark.parametrize("n", [40, 400, 2000])
def test_fields_of_many_values_generalise_at_every_size(spark, n):
    """Names and cities that all recur; a line of few tokens; a long one with four fields."""
    rng = random.Random(n)
    names, cities = ([words(1, 1000 * k + i, "aeioubdfgklmnprst") + f"{'x' * (i % 3)}q" for i in range(100)] for k in (1, 2))
    filler = words(44, 7).split()
    texts = []
    for i in range(n):
        a, b, c, d = (rng.choice(names) for _ in range(4))
        texts.append("\n".join([
            f"today the user {rng.choice(names)} has left the big room and came back from {rng.choice(cities)}",
            f"the user {rng.choice(names)} logged in just now",
            " ".join(filler[:8] + [a] + filler[8:20] + [b] + filler[20:30] + [c] + filler[30:40] + [d] + filler[40:]),
            "Read more", words(9, 10_000 + i), "\t"]))
    got = sorted(line_templates.drop_recurring(frame(spark, texts)).select("doc_id", "n_dropped", "text").collect())
    assert got[0].n_dropped == 0 and got[0].text == texts[0]
    for r in got[1:]:
        lines = texts[r.doc_id].split("\n")
        assert r.n_dropped == 4 and r.text == "\n".join(lines[4:])


def brute_templates(texts):
    """The operator's rule in plain Python: text of each document."""
    def parsed(line):
        tokens = [t for t in re.split(r"[ \t\x0b\f\r]+", line) if t]
        masked = ["<*>" if re.search("[0-9]", t) else t for t in tokens]
        return tuple(masked if len(tokens) >= 3 and set(masked) != {"<*>"} else tokens)

    docs, leaves = defaultdict(set), defaultdict(set)
    for i, t in enumerate(texts):
        for x in (t or "").split("\n"):
            if parsed(x):
                docs[parsed(x)].add(i)
    for line in docs:
        if len(line) >= 4:
            leaves[len(line), line[:1 if len(line) < 6 else 2 if len(line) < 8 else 3]].add(line)
    template = {}
    for leaf, lines in leaves.items():
        if len(lines) < 2 or len(set().union(*(docs[x] for x in lines))) < 2:
            continue
        count = Counter((i, t) for x in lines for i, t in enumerate(x) if t != "<*>")
        for x in lines:
            constants = tuple((i, t) for i, t in enumerate(x) if count[i, t] > 1 and 3 * count[i, t] >= len(lines))
            if len(constants) >= 0.7 * len(x):
                template[x] = (leaf, constants)
    members = defaultdict(list)
    for x, t in template.items():
        members[t].append(x)
    keeper = {}
    for x, d in docs.items():
        if len(d) >= (10 if len(x) < 3 else 2):
            keeper[x] = min(d)
    for t, lines in members.items():
        d = set().union(*(docs[x] for x in lines))
        if len(d) > 1 and sum(len(docs[x]) for x in lines) >= (10 if t[0][0] < 8 else 2):
            keeper.update({x: min(d) for x in lines})
    return ["\n".join(x for x in t.split("\n") if keeper.get(parsed(x), i) == i) if t is not None else None for i, t in enumerate(texts)]


def test_line_templates_against_brute_force(spark):
    rng = random.Random(9)
    vocab = words(12, 77).split()
    patterns = [[rng.choice(vocab) for _ in range(rng.randint(1, 14))] for _ in range(25)]

    def line():
        out = list(rng.choice(patterns))
        for _ in range(rng.choice([0, 0, 1, 2])):
            out[rng.randrange(len(out))] = rng.choice(vocab + ["7", "u81", "Zoë"])
        return rng.choice([" ", "  ", "\t"]).join(out)

    texts = ["\n".join(line() for _ in range(rng.randint(0, 7))) for _ in range(150)] + [None, "", " \n\n"]
    got = {r.doc_id: r.text for r in line_templates.drop_recurring(frame(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_templates(texts)


def test_lines_first_seen_without_an_id(spark):
    texts = [f"today the user {n} has left the room and closed the old door" for n in ("anna", "anna", "bert", "carl")]
    rows = [(None, texts[0]), (5, texts[1]), (6, texts[2]), (7, texts[3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.n_dropped for r in line_templates.drop_recurring(docs).collect()}
    assert got == {None: 0, 5: 1, 6: 1, 7: 1}


def test_line_dedup_against_brute_force_without_fields(spark):
    rng = random.Random(4)
    pool = [words(5, 200 + i) for i in range(40)]
    texts = ["\n".join(rng.choice(pool) for _ in range(rng.randint(1, 6))) for _ in range(60)]
    first = {}
    for i, t in enumerate(texts):
        for x in t.split("\n"):
            first.setdefault(x, i)
    docs = defaultdict(set)
    for i, t in enumerate(texts):
        for x in t.split("\n"):
            docs[x].add(i)
    want = ["\n".join(x for x in t.split("\n") if len(docs[x]) < 2 or first[x] == i) for i, t in enumerate(texts)]
    got = {r.doc_id: r.text for r in line_templates.drop_recurring(frame(spark, texts)).collect()}
    assert [got[i] for i in range(60)] == want
    assert line_templates.drop_recurring(frame(spark, [])).count() == 0


def brute_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.split(r"[?#]", rest[len(host):], maxsplit=1)[0]


def brute_rule(host, path):
    fits = [r for r, _ in url_trees.RULES
            if (host == r.split("/", 1)[0] or host.endswith("." + r.split("/", 1)[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return max(fits, key=len, default=None)


def urls():
    rng = random.Random(8)
    out = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/x?y#z", "http://example.com", "http://a.net/es/?q=1&r=2",
           "http://com/", "x://y://z.com/en/", "http://Ä.com/\n/en/", "http://example.com/en/", "http://notexample.com/en/"]
    for _ in range(900):
        host = rng.choice(["", "www.", "m."]) + words(1, rng.random()) + "." + rng.choice(["example.com", "com", "net", "example.net", "org"])
        out.append(f"http://{host}/{rng.choice(['en', 'fr', 'es', 'de'])}/{rng.randint(1, 9999)}{rng.choice(['', '?a=1', '#t', '.html'])}")
    return out


def test_url_rules_and_trees(spark):
    all_urls = urls()
    df = spark.createDataFrame([(i, u, "own", "own") for i, u in enumerate(all_urls)], "page_id long, url string, host string, verdict string")
    got = {r.page_id: r for r in url_trees.judge(df).collect()}
    verdicts = dict(url_trees.RULES)
    right = seen = 0
    for i, u in enumerate(all_urls):
        host, path = brute_parts(u)
        rule = brute_rule(host, path)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), u
        if rule:
            assert got[i].verdict == verdicts[rule]
            right, seen = right + ((got[i].block_probability >= 0.5) == (verdicts[rule] == "block")), seen + 1
        else:
            assert got[i].verdict in ("allow", "block")
    assert right / seen > 0.9
    assert url_trees.judge(df.limit(0)).count() == 0
    assert {r.verdict for r in url_trees.judge(df.where("page_id < 3")).collect()} == {"allow"}


def test_url_trees_on_held_out_urls(spark):
    rows = url_trees.described(spark.createDataFrame([(i, u) for i, u in enumerate(urls())], "page_id long, url string")) \
        .where("rule is not null").withColumn("blocked", (url_trees.rule_verdict(F.col("rule")) == "block").cast("int"))
    model, counts, overall = url_trees.train(rows.where("page_id % 3 > 0"))
    from pyspark.ml.feature import VectorAssembler
    test = VectorAssembler(inputCols=list(url_trees.FEATURES), outputCol="features").transform(
        url_trees._with_suffix_rates(rows.where("page_id % 3 = 0").withColumn("_half", F.lit(0)), counts, overall, False))
    hit = model.transform(test).agg(F.avg((F.col("prediction") == F.col("blocked")).cast("double"))).first()[0]
    assert hit > 0.9


def test_one_url_of_many_rows_does_not_fill_the_sample(spark):
    """The URL with the smallest hash has 25,000 rows; statistics count them all, the sample takes it once."""
    some = [(i, u) for i, u in enumerate(urls())]
    df = spark.createDataFrame(some, "page_id long, url string")
    order = F.xxhash64("host", "path", "url_chars")
    first = url_trees.described(df).where("rule is not null").select("url", order.alias("o")).orderBy("o").first().url
    many = df.unionByName(spark.range(25_000).select((F.col("id") + 100_000).alias("page_id"), F.lit(first).alias("url")))
    rows = url_trees.described(many).where("rule is not null").withColumn(
        "blocked", (url_trees.rule_verdict(F.col("rule")) == "block").cast("int"))
    model, counts, overall = url_trees.train(rows, sample=200)
    assert model is not None
    n = counts.where("_level = 1").agg(F.sum(F.col("n0") + F.col("n1"))).first()[0]
    assert n == rows.count() > 25_000 and abs(overall - rows.agg(F.avg("blocked")).first()[0]) < 1e-12


def brute_sets(texts):
    out = []
    for t in texts:
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        out.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return out


def brute_components(texts, ids):
    sets = brute_sets(texts)
    parent = list(range(len(texts)))
    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    return [(ids[i], len(sets[i]), min(ids[j] for j in range(len(texts)) if root(j) == root(i)) if sets[i] else ids[i])
            for i in range(len(texts))]


def edited(text, n, seed):
    rng, w = random.Random(seed), text.split(" ")
    for _ in range(n):
        w[rng.randrange(len(w))] = words(1, rng.random(), "xyz")
    return " ".join(w)


def test_near_duplicates_against_brute_force(spark):
    texts = awkward_texts() + ["One", "a b c", "A  B\tc", "a b c d e", "a b c d e f"]
    for k in range(4):
        base = words(150, 300 + k)
        texts += [edited(base, e, 10 * k + e) for e in range(8) for _ in range(2)]
    ids = [1000 - i for i in range(len(texts))]
    got = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(frame(spark, texts, ids)).collect()]
    want = [(d, n, c, d == c) for d, n, c in brute_components(texts, ids)]
    assert sorted(got) == sorted(want)
    kept = near_dup.drop_near_duplicates(frame(spark, texts, ids))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, _, _, k in want if k)
    assert kept.columns == frame(spark, []).columns


def test_near_duplicates_with_odd_ids(spark):
    texts = [words(30, 1), words(30, 1), words(30, 2), None, words(30, 2)]
    got = near_dup.near_duplicates(frame(spark, texts, [None, 5, 7, None, 7])).collect()
    assert Counter((r.doc_id, r.component_id) for r in got) == Counter([(None, 5), (5, 5), (7, 7), (None, None), (7, 7)])
    assert near_dup.near_duplicates(frame(spark, [])).count() == 0
    assert near_dup.near_duplicates(frame(spark, [None, ""])).count() == 2


def test_bucket_blocks_find_links_that_the_centre_misses(spark):
    # A dense group around the threshold, in blocks smaller than the group.
    base = words(160, 700)
    texts = [edited(base, 3 + s % 4, 900 + s) for s in range(70)]
    docs = frame(spark, texts)
    old = near_dup.BLOCK
    near_dup.BLOCK = 16
    try:
        got = sorted((r.doc_id, r.component_id) for r in near_dup.near_duplicates(docs).collect())
    finally:
        near_dup.BLOCK = old
    assert got == sorted((d, c) for d, _, c in brute_components(texts, list(range(70))))


def test_sequential_bound_is_the_posterior():
    least = near_dup.least_matches(75, 25, 200, 1e-6)
    t = np.linspace(0, 1, 200_001)
    for k, m in zip(range(25, 201, 25), least):
        def above(m):
            logs = m * np.log(np.maximum(t, 1e-12)) + (k - m) * np.log(np.maximum(1 - t, 1e-12))
            density = np.exp(logs - logs.max())
            return density[t >= 0.75].sum() / density.sum()
        assert above(m) >= 0.9e-6 and (m == 0 or above(m - 1) < 1.1e-6)


def brute_quality(text):
    text = text or ""
    w = WORD.findall(text)
    at = defaultdict(list)
    for i in range(len(w) - 2):
        at[tuple(w[i:i + 3])].append(i)
    covered = {i + d for p in at.values() if len(p) > 1 for i in p for d in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def test_quality_measures_against_brute_force(spark):
    rng = random.Random(2)
    texts = awkward_texts() + ["a b c a b c", "x\nx\n\n \nx y", "## ** | a", "a b a b a b a"]
    texts += [" ".join(rng.choice("ab cd ef the of".split()) for _ in range(rng.randint(1, 90))) for _ in range(40)]
    got = {r.doc_id: r for r in quality_rules.judge(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        n, chars, symbols, dup, repeat = brute_quality(t)
        r = got[i]
        assert (int(r.n_words), r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, repeat), t
        assert r.base_failed == (n < 50 or 100 * repeat > 50 * n)
        assert r.kept == (not r.base_failed and not r.broken_rules)
    assert quality_rules.judge(frame(spark, [])).count() == 0


def test_quality_rules_keep_prose_and_drop_junk(spark):
    prose = " ".join(f"the {a} of {b}" for a, b in zip(words(30, 5).split(), words(30, 6).split()))
    junk = " ".join(w + "###" for w in words(80, 7).split())
    docs = frame(spark, [prose, junk, prose.upper(), "short", None])
    kept = quality_rules.keep_good(docs)
    assert [r.doc_id for r in kept.collect()] == [0] and kept.columns == docs.columns
    assert kept.collect()[0].n_words is None


def page(article, extra=""):
    return ("<!DOCTYPE html><html><head><title>t</title><script>var a='</p>';</script></head><body><nav><ul><li><a href=/>Home</a></li>"
            f"</ul></nav><!-- x --><div class=ad>Buy now</div><article>{article}</article>{extra}<footer>&copy; site</footer>")


@pytest.fixture(scope="module")
def labeller(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    return html_blocks.trained(html_blocks.sampled(rows.where("page_id % 2 = 0"), sample=80))


def test_blocks():
    got = [(t, path[-1]) for path, t, _ in html_blocks.blocks_of(page("<h1>A &amp; B</h1><p><b>one</b>two<br>three<p>four &lt;x&gt;  \n five"))]
    assert got == [("Home", "li"), ("Buy now", "ad"), ("A & B", "h1"), ("onetwo three", "p"), ("four <x> five", "p"), ("© site", "footer")]
    assert html_blocks.blocks_of("") == [] and html_blocks.blocks_of("<p>< a < b") == [(("p",), "< a < b", 0)]


@pytest.mark.parametrize("icon", [
    "<svg class=icon/>", "<svg viewBox='0 0 9 9' data-x=\"a>b\" />", "<MATH/>", "<svg/>", "<svg-icon name=menu></svg-icon>", "<title-bar></title-bar>",
    "<object-card></object-card>", "<svg:use></svg:use>", "<svg><path d='M0'/><text>drawn</text></svg>", "<script src='x' />var a = '<p>'</script >",
    "<svg class=a\n/>"])
def test_blocks_after_icons(icon):
    got = [t for _, t, _ in html_blocks.blocks_of(f"<header>{icon}</header><article><p>one</p>{icon}<p>two</p></article>")]
    assert got == ["one", "two"]


def test_main_text_of_given_pages(spark, labeller):
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").where("page_id % 2 = 1")
    got = {r.page_id: r for r in html_blocks.main_text(rows, labeller).collect()}
    same = 0
    for r in rows.collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        want = [html_blocks.html_lib.unescape(re.sub(r"<[^>]*>", " ", x)) for x in [re.sub(r"</?b>", "", inner)]]
        same += got[r.page_id].text == " ".join(" ".join(want).split())
        assert got[r.page_id].n_chars == len(got[r.page_id].text)
    assert same / len(got) > 0.97


def test_labeller_on_held_out_layouts(spark, labeller):
    rng = np.random.default_rng(77)
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").where("page_id % 2 = 1").collect()
    cut = [html_blocks.blocks_of(r.html) for r in rows]
    other = [t for b in cut for p, t, _ in b if not html_blocks.named_label(p)]
    made = [html_blocks.known_labels(html_blocks.laid_out([t for p, t, _ in b if html_blocks.named_label(p)], other, rng)) for b in cut]
    want = np.concatenate([y for _, y in made])
    got = np.concatenate(labeller.probabilities([html_blocks.vectors(b) for b, _ in made])) >= 0.5
    # The labels are where the layout put the texts, not what names say.
    assert (want == got).mean() > 0.93


MENU = "<div><a href=#>Home</a> <a href=#>News</a> <a href=#>Sport</a></div>"
FOOT = "<div>&copy; 2023 Some Site. All rights reserved</div>"


@pytest.mark.parametrize("layout", [
    f'<html><body>{MENU}<div class="c12">BODY</div>{FOOT}</body></html>',
    f'<html><body><nav>{MENU}</nav><article class="has-share-button post-share">BODY</article><footer>{FOOT}</footer></body></html>',
    f'<html><body><form action=x method=post><div class=menu>{MENU}</div><div class=content>BODY</div><div class=footer>{FOOT}</div></form>',
    f'<html><body><table><tr><td colspan=2>{MENU}</td></tr><tr><td><a href=#>Links</a><br><a href=#>More</a></td><td>BODY</td></tr>'
    f'<tr><td colspan=2>{FOOT}</td></tr></table></body></html>',
    '<html><body><div class="td-header-wrap">' + MENU + '</div><div class="td-pb-row"><div class="td-pb-span8 td-main-content">'
    '<div class="td-ss-main-content">BODY</div></div></div><div class="td-footer">' + FOOT + "</div></body></html>",
    "<html><body>BODY</body></html>"])
def test_article_in_foreign_layouts(spark, labeller, layout):
    """Six plain paragraphs and a heading by hand, in pages whose names say nothing or mislead."""
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").where("page_id % 2 = 1").limit(40).collect()
    prose = [t for r in rows for p, t, _ in html_blocks.blocks_of(r.html) if html_blocks.named_label(p) and len(t) > 80]
    rng, paragraphs = np.random.default_rng(5), 0
    for k in range(20):
        some = [prose[j] for j in rng.integers(0, len(prose), 6)]
        body = f"<h1>Heading of the page {k}</h1>" + "".join(f"<p>{html_blocks.html_lib.escape(x)}</p>" for x in some)
        blocks = html_blocks.blocks_of(layout.replace("BODY", body))
        kept = labeller.probabilities([html_blocks.vectors(blocks)])[0] >= 0.5
        found = [t for (_, t, _), y in zip(blocks, kept) if y]
        paragraphs += [t for t in found if not t.startswith("Heading")] == some
        assert not {"Home News Sport", "Links More"} & set(found)
    assert paragraphs >= 19


def test_text_that_elements_do_not_hide():
    def texts(html):
        return [t for _, t, _ in html_blocks.blocks_of(html)]
    assert texts("<p>Let <math><mi>x</mi></math> be even.</p>") == ["Let x be even."]
    assert texts("<p>a</p><svg class=i><path d=M0><p>b</p>") == ["a", "b"]
    assert texts("<noscript><p>shown</p></noscript><object data=x><p>instead</p></object>") == ["shown", "instead"]
    assert texts("<p>a<script>var b = '<p>'</p>") == ["a"]
    assert texts("<p>a</p><a href='x") == ["a", "<a href='x"]


@pytest.mark.parametrize("html", ["<svg" * 20_000, "<svg x " * 20_000, "<svg>" * 20_000, "<script>" * 20_000, "<p title='x>" * 20_000, "<!--" * 20_000])
def test_reading_is_linear(html):
    import time
    began = time.process_time()
    html_blocks.blocks_of(html)
    assert time.process_time() - began < 5


def test_main_text_of_awkward_pages(spark, labeller):
    html = [None, "", "plain words", page(""), page("<p>" + words(50000, 3)), "<p title='x>" * 50, page("<p>a</p>" * 3000), "<" * 5000]
    df = spark.createDataFrame([(i, None, h, "own") for i, h in enumerate(html)], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in html_blocks.main_text(df, labeller).collect()}
    assert len(got) == len(html) and got[0].text == got[1].text == got[3].text == ""
    assert got[4].text == words(50000, 3)
    assert html_blocks.main_text(df.limit(0), labeller).count() == 0


def test_gradient_of_the_labeller():
    net = html_blocks.Labeller(1)
    rng = np.random.default_rng(0)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, mask = html_blocks._padded([rng.normal(size=(n, html_blocks.DIMS)).astype(np.float32) * 0.3 for n in (4, 2)])
    y = (rng.random(mask.shape) < 0.5).astype(np.float32) * mask
    _, grads = net.gradient(x, mask, y)
    for name in ("Wf", "Uf", "cb", "Ub", "V", "S"):
        i = tuple(rng.integers(s) for s in net.p[name].shape)
        keep, step = net.p[name][i], 1e-3
        net.p[name][i] = keep + step
        up = net.gradient(x, mask, y)[0]
        net.p[name][i] = keep - step
        down = net.gradient(x, mask, y)[0]
        net.p[name][i] = keep
        assert abs((up - down) / (2 * step) - grads[name][i]) < 1e-3


def test_pipeline_stages(spark, tmp_path):
    prose = [" ".join(f"the {a} of {b}" for a, b in zip(words(40, 20 + k).split(), words(40, 60 + k).split())) for k in range(6)]
    shared = "this line stands in several of the documents here"
    texts = [prose[0], prose[1] + "\n" + shared, prose[2] + "\n" + shared, prose[0], prose[3], "Well, " + prose[3],
             "###" * 100, "short", None, ""]
    docs = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    at, ids = docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, str(tmp_path))
        assert at.columns == docs.columns
        ids.append(sorted(r.doc_id for r in at.collect()))
    assert ids == [[0, 1, 2, 3, 4, 5], [0, 1, 2, 4, 5], [0, 1, 2, 4]]
    left = {r.doc_id: r for r in at.collect()}
    assert left[1].text == texts[1] and left[2].text == prose[2] and left[2].n_chars == len(prose[2])
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted({r.doc_id for r in packed}) == [0, 1, 2, 4]
    assert corpus_pipeline.ORACLE_SQL is None and [n for n, _ in corpus_pipeline.STAGES][2] == "near duplicates"
