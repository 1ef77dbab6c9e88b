import base64
import collections
import hashlib
import html
import itertools
import math
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from featloom.llm import bpe, chat, decontaminate, html_extract, license_scan, license_texts, line_dedup, lm_score, near_dedup, quality_crf, quality_rules
from featloom.llm.queries import RANKS

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
VOCAB = [a + b for a in "ka ri to mu se no".split() for b in "la ne vi pu dor x".split()] + ["Été", "über", "#$%", "naïve"]


def text(rng, n, lines=3):
    words = [rng.choice(VOCAB) for _ in range(n)]
    for _ in range(lines):
        if words:
            words[rng.randrange(len(words))] += "\n"
    return " ".join(words)


def corpus(seed=0):
    """Originals, exact and near copies, repeated rows, nulls, empty and long texts."""
    rng = random.Random(seed)
    rows = [(i, text(rng, rng.randint(1, 120))) for i in range(40)]
    rows += [(100 + i, rows[i % 5][1]) for i in range(12)]
    for i in range(12):
        words = rows[10 + i % 4][1].split(" ")
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = rng.choice(VOCAB)
        rows.append((200 + i, " ".join(words)))
    long = text(rng, 30_000, 500)
    return rows + [(300, None), (301, ""), (302, " \t\n "), (303, "one two"), (304, "One  two"), (305, long), (306, long + " end"), (7, rows[7][1])]


@pytest.fixture(scope="module")
def docs(spark):
    """Columns whose names clash with those the operators use inside."""
    df = spark.createDataFrame(corpus(), "doc_id long, text string")
    return df.withColumns({c: F.lit(1) for c in ("ws", "m", "row", "key", "name", "h", "j", "kept", "n_words", "rep", "spans", "a", "b")}).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def words_of(t):
    return WORD.findall((t or "").translate(LOWER))


# 1


def conversations(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "a <s> b </s> [INST]"), (1, 1, "assistant", "a <s> b </s> [INST]"), (2, 1, "assistant", None), (2, 0, None, "x\ny"), (2, None, "sys\ntem [LF]", "[/INST]\\"),
            (None, 0, "assistant", "<\\s> <\\\\/s>"), (3, 0, "assistant", "é" * 10_000), (4, 0, "user", "</s>[INST] ok [/INST]"), (4, 1, "assistant", "</s>[INST] ok [/INST]")]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("span", F.lit(0))


def test_chat_round_trip(spark):
    df = conversations(spark)
    template = chat.BracketTemplate()
    want = collections.defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (r.turn is not None, r.turn or 0, r.role or "", r.text or "")):
        want[r.conv_id].append((r.role or "", r.text or ""))
    got = {r.conv_id: r for r in chat.digests(chat.format_turns(df, template), template).collect()}
    assert set(got) == set(want)
    for c, turns in want.items():
        loss = "".join(t for role, t in turns if role == "assistant")
        assert got[c].n_turns == len(turns) and got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert got[c].loss_chars == len(loss) and got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert got[c].formatted_chars == len(template(turns)) and not got[c].rewrites
    whole = {r.conv_id: r for r in chat.formatted(chat.format_turns(df, template)).collect()}
    for c, turns in want.items():
        assert whole[c].formatted == template(turns) and template.read(whole[c].formatted) == turns
        assert [template.unescape(whole[c].formatted[s.start : s.stop]) for s in whole[c].spans] == [t for _, t in turns]
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digests(chat.format_turns(none, template), template).count() == 0


def test_chat_escape_is_reversible():
    template, rng = chat.BracketTemplate(), random.Random(1)
    for _ in range(3000):
        t = "".join(rng.choice(["<", "s>", "/", "\\", "[", "INST]", "LF]", "]", "a", "\n", " "]) for _ in range(rng.randint(0, 9)))
        assert template.unescape(template.escape(t)) == t
        turns = [("user", t), ("assistant", t), (t, t)]
        assert template.read(template(turns)) == turns


def test_chat_finds_templates_that_rewrite_history(spark):
    def forgetful(turns):
        return "".join(f"{r}:{t if i == len(turns) - 1 else t[:1]};" for i, (r, t) in enumerate(turns))

    got = chat.format_turns(conversations(spark), forgetful).where("conv_id = 1").orderBy("position").collect()
    assert [r.rewrites for r in got] == [False, True, True] and got[1].in_loss
    whole = {r.conv_id: r for r in chat.formatted(chat.format_turns(conversations(spark), forgetful)).collect()}[1]
    assert whole.rewrites and whole.formatted == forgetful([("user", "hi"), *[("assistant", "a <s> b </s> [INST]")] * 2])
    assert [s.in_loss for s in whole.spans] == [False, False, True] and whole.formatted[whole.spans[2].start : whole.spans[2].stop] == "a <s> b </s> [INST]"


def dropping():
    """Leaves out the oldest turns once there are more than nine."""
    template = chat.BracketTemplate()
    return lambda turns: template(turns[-9:])


def test_chat_renders_whole_prefixes(spark):
    turns = [("user" if k % 2 == 0 else "assistant", f"turn {k}") for k in range(14)]
    assert [p.rewrites for p in chat.pieces(dropping(), turns)] == [False] * 9 + [True] * 5
    df = spark.createDataFrame([(1, k, *x) for k, x in enumerate(turns)], "conv_id long, turn long, role string, text string")
    got = chat.digests(chat.format_turns(df, dropping()), chat.BracketTemplate()).first()
    last, loss = turns[-9:], "".join(x for r, x in turns if r == "assistant" and (r, x) in turns[-9:])
    assert got.rewrites and got.n_turns == 9 and got.turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in last).encode()).hexdigest()
    assert got.formatted_chars == len(chat.BracketTemplate()(last)) and got.loss_chars <= len(loss)


@pytest.mark.parametrize("template", [chat.BracketTemplate(), dropping(), lambda turns: f"{len(turns)}" + "".join(t for _, t in turns), lambda turns: "".join(f"{k}:{t};" for k, (_, t) in enumerate(turns))])
def test_chat_windows_equal_whole_prefixes(template):
    """Where windows don't tell all, whole prefixes do: drops, counts at the front, numbered turns."""
    turns = [("user" if k % 3 else "assistant", f"<s> text {k % 5} of {k}") for k in range(70)]
    every = chat.pieces(template, turns, whole=1000)
    for whole in (1, 8, 16):
        assert chat.pieces(template, turns, whole=whole, window=3) == every


# 2


def brute_clusters(rows, percent):
    sets = []
    for i, t in rows:
        w = words_of(t)
        sets.append((i, frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])))
    at = {i: i for i, _ in sets}

    def find(x):
        while at[x] != x:
            x = at[x]
        return x

    for (i, s), (j, t) in itertools.combinations(sets, 2):
        if s and t and 100 * len(s & t) >= percent * len(s | t):
            a, b = find(i), find(j)
            at[max(a, b)] = min(a, b)
    return sorted((i, len(s), find(i), find(i) == i) for i, s in sets)


@pytest.mark.parametrize("percent", [85, 80])
def test_near_dedup(docs, percent):
    got = sorted(tuple(r) for r in near_dedup.clusters(docs, percent).collect())
    assert got == brute_clusters(corpus(), percent) and sum(not r[3] for r in got) > 15
    kept = near_dedup.deduplicated(docs, percent)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted({i for i, *_, k in got if k})


def test_near_dedup_of_one_large_group(spark, monkeypatch):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randint(1, 4)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(50)}"
        rows.append((i, " ".join(w)))
    monkeypatch.setattr(near_dedup, "MEMBERS", 16)  # so that buckets are cut into blocks
    got = sorted(tuple(r) for r in near_dedup.clusters(spark.createDataFrame(rows, "doc_id long, text string"), 85).collect())
    assert got == brute_clusters(rows, 85)


def test_near_dedup_nulls_and_nothing(spark, empty):
    assert near_dedup.clusters(empty).count() == 0 and near_dedup.deduplicated(empty).count() == 0
    df = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f")], "doc_id long, text string")
    assert sorted(near_dedup.clusters(df).collect(), key=str) == [(1, 2, 1, True), (None, 2, None, True)]
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    for small in (0, 7, 1000):
        assert {r.id: r.root for r in near_dedup.components(chain, small).collect()} == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}


def test_near_dedup_of_repeated_ids(spark):
    """A doc_id is one vertex; of its rows one stays, the one with the least text."""
    rng = random.Random(5)
    a, c = (" ".join(rng.choice(VOCAB) + str(rng.randrange(9)) for _ in range(60)) for _ in range(2))
    rows = [(3, a), (3, c), (5, a + " q"), (6, c + " q"), (1, a), (7, "alone and only here now"), (7, None), (8, c), (9, a), (9, a)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in near_dedup.clusters(df, 85).collect()) == brute_clusters([(i, t or "") for i, t in rows], 85)
    clashing = df.selectExpr("doc_id", "text", "1 AS found_id", "2 AS row", "3 AS one", "4 AS rep")
    kept = near_dedup.deduplicated(clashing, 85)
    assert kept.columns == clashing.columns and sorted(tuple(r)[:2] for r in kept.collect()) == [(1, a), (7, None)]


def test_sketch_filter_loses_no_link():
    """Recall of the filter by odd sketches over pairs just at the threshold."""
    import numpy as np

    rng, lost, n = np.random.default_rng(2), 0, 400
    most = near_dedup.BITS / 2 * (1 - np.exp((near_dedup.least_estimate(85) - 1) * 4 * near_dedup.SAMPLES / near_dedup.BITS))
    for _ in range(n):
        shared = rng.integers(0, 1 << 63, 340, dtype=np.uint64)
        x, y = (near_dedup.odd_sketch(near_dedup.samples(np.concatenate([shared, rng.integers(0, 1 << 63, 30, dtype=np.uint64)]))).view(np.uint64) for _ in range(2))
        lost += int(np.bitwise_count(x ^ y).sum()) > most
    assert lost == 0


def test_odd_sketch_is_precise():
    import numpy as np

    rng = np.random.default_rng(0)
    for j in (0.8, 0.9, 0.95):
        off = []
        for _ in range(40):
            shared = rng.integers(0, 1 << 63, int(400 * j / (2 - 2 * j) * 2), dtype=np.uint64)
            a, b = (np.unique(np.concatenate([shared, rng.integers(0, 1 << 63, 400, dtype=np.uint64)])) for _ in range(2))
            true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            x, y = (near_dedup.odd_sketch(near_dedup.samples(s)).view(np.uint64) for s in (a, b))
            p = int(np.bitwise_count(x ^ y).sum())
            off.append(1 + near_dedup.BITS / (4 * near_dedup.SAMPLES) * math.log(1 - 2 * p / near_dedup.BITS) - true)
        assert abs(np.mean(off)) < 0.02 and np.std(off) < 0.06


# 3


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var x="</p><p>no";</script></head><body><nav><ul><li><a href="/a">menu</a></li></ul></nav>
<!-- note --><div class="ad">buy</div><article><h1>Head &amp; line</h1><p><b>First
 para&copy;<br><p>Second <i>it</i>alic 1 &lt; 2</p><aside>side</aside><div class="comments"><p>rude</p></div></article><footer>foot</footer></body></html>"""


def test_html_of_one_page():
    assert html_extract.main_text(PAGE) == "Head & line\nFirst para©\nSecond italic 1 < 2"
    assert html_extract.main_text("") == "" and html_extract.main_text("just text") == "just text"
    assert html_extract.main_text("<nav>only</nav>") == "" and html_extract.main_text("<p>a < b<p>c <!-- open") == "a < b\nc"
    plain = "<body><div id=menu>m</div><div class='x'><div class=post><p>one</p><p>two three four</p></div></div><div class='cookie notice'>c</div></body>"
    assert html_extract.main_text(plain) == "one\ntwo three four"


def test_html_keeps_all_that_is_not_marked():
    lead, rest = "lead " * 34, "rest " * 66
    assert html_extract.main_text(f"<body><div class=story><h1>Head</h1><p>{lead}</p><div class=more><p>{rest}</p></div></div></body>") == f"Head\n{lead.strip()}\n{rest.strip()}"
    assert html_extract.main_text(f"<body><div>{rest}</div><div>{lead}</div></body>") == f"{rest.strip()}\n{lead.strip()}"
    assert html_extract.main_text("<body><h1>Head</h1><article>one</article><article>two and more</article></body>") == "Head\none\ntwo and more"


@pytest.mark.parametrize(
    "page",
    [
        "<body class='no-sidebar'><p>{}</p></body>",
        "<body class=sidebar><p>{}</p></body>",
        "<body><div class='content has-sidebar'><p>{}</p></div></body>",
        "<body><article class='post related-news'><p>{}</p></article></body>",
        "<body><article class='related'><p>{}</p></article></body>",
        "<body><main class='page comments-closed'><p>{}</p></main></body>",
        "<body><div id=comments><p>a</p><article>{}</article></div></body>",
        "<body><main><div class=social>{}</div></main></body>",
        "<body><nav>a long long menu</nav><div class=social>{}</div><div class=sidebar>s</div></body>",
    ],
)
def test_html_marks_spare_the_article(page):
    assert "whole article" in html_extract.main_text(page.format("whole article"))
    assert html_extract.main_text("<div class=ad>more ad than article</div><article>short</article>") == "short"


def test_html_templates_and_edges(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for i in range(30):  # no markup tells the site's text from the page's; only that it is everywhere does
        paras = [" ".join(rng.choice(VOCAB) for _ in range(20)) for _ in range(rng.randint(1, 4))]
        body = "".join(f"<p>{html.escape(p)}</p>" for p in paras)
        rows.append((i, f"http://Host.example/{i}", f"<html><body><div class=w><div class=top>Our fine site</div>{body}</div></body></html>"))
        want[i] = "\n".join(" ".join(p.split()) for p in paras)
    rows += [(100, None, PAGE), (101, "not a url", None), (None, "http://host.example/z", ""), (100, None, PAGE)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("host", "site", "slot", "text")})
    got = [tuple(r) for r in html_extract.extract(df).collect()]
    assert len(got) == len(rows)
    for page, _, t, n in got:
        assert n == len(t)
        assert t == (want[page] if page in want else html_extract.main_text(PAGE) if page == 100 else "")
    assert html_extract.extract(df.limit(0)).count() == 0


def test_html_classes(spark):
    rng = random.Random(6)
    para = lambda: " ".join(rng.choice(VOCAB) for _ in range(20))
    rows, want = [], {}

    def add(host, make):
        n, p = len(rows), para()
        rows.append((n, f"http://{host}/{n}", f"<html><body>{make(p)}</body></html>"))
        want[n] = " ".join(p.split())

    for _ in range(24):  # one page differs, a notice among paragraphs
        add("a.example", lambda p: f"<div class=w><p>Our notice</p><p>{p}</p><p>Twice</p><p>Twice</p></div>")
    add("a.example", lambda p: f"<table><tr><td>{p}</td></tr></table>")
    for _ in range(3):  # a small host
        add("b.example", lambda p: f"<div>Small site</div><div>{p}</div>")
    for i in range(20):  # two layouts
        add("c.example", (lambda p: f"<div class=x><p>First kind</p><p>{p}</p></div>") if i % 3 else (lambda p: f"<div class=y><ul><li>Second kind</li></ul><p>{p}</p></div>"))
    copied = [" ".join(para().split()) for _ in range(4)]
    for host, n in (("d.example", 4), ("e.example", 20)):  # copies of an article are no template
        for i in range(n):
            add(host, lambda p: "".join(f"<p>{x}</p>" for x in copied) if i < 4 else f"<p>{p}</p>")
            if i < 4:
                want[len(rows) - 1] = "\n".join(copied)
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html_extract.extract(df).collect()} == want


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<body><main><h1>Headline</h1><p>lead text</p><article>body text</article></main></body>", "Headline\nlead text\nbody text"),
        ("<body><article>first one</article><article>second</article></body>", "first one\nsecond"),
        ("<body><div>first one</div><div>second</div></body>", "first one\nsecond"),
        ("<body><article><p class='market share'>a share</p><p>text that is much longer</p><div class=notice>quoted</div></article></body>", "a share\ntext that is much longer\nquoted"),
        ("<body><article>the text of the page</article><div id=disqus_thread><p>rude</p></div><section class=reviews>bad</section></body>", "the text of the page"),
        ("<body><article>the text of the page<div id='comments'>rude</div><aside>side</aside></article></body>", "the text of the page"),
    ],
)
def test_html_keeps_articles_and_drops_comments(page, want):
    assert html_extract.main_text(page) == want


def test_html_vague_marks_go_by_the_template(spark):
    """A notice inside the article goes where the host's template has it, and stays where one page quotes it."""
    rng = random.Random(3)
    para = lambda: " ".join(rng.choice(VOCAB) for _ in range(20))
    rows, want = [], {}
    for i in range(8):
        for host, notice in (("a.example", f"<div class=notice>read no {i}</div>"), ("b.example", "<div class=notice>quoted</div>" if i == 3 else "")):
            p = para()
            rows.append((len(rows), f"http://{host}/{i}", f"<html><body><article><p>{p}</p>{notice}</article></body></html>"))
            want[len(rows) - 1] = " ".join(p.split()) + ("\nquoted" if host[0] == "b" and i == 3 else "")
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html_extract.extract(df).collect()} == want


def test_html_slots_of_links(spark):
    """A list of links that differ from page to page is a menu by its slot, whatever it is called."""
    rng = random.Random(4)
    para = lambda: " ".join(rng.choice(VOCAB) for _ in range(20))
    rows, want = [], {}
    for i in range(9):
        p = para()
        links = "".join(f"<li><a href=/{k}>see {rng.randrange(10**6)}</a></li>" for k in range(3))
        rows.append((i, f"http://a.example/{i}", f"<html><body><div id=q7><ul>{links}</ul></div><div id=q8><p>{p}</p><p>by <a href=/x>me {i}</a></p></div><div id=q9>end</div></body></html>"))
        want[i] = " ".join(p.split()) + f"\nby me {i}"
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html_extract.extract(df).collect()} == want
    assert all("see" in html_extract.main_text(h) and "end" in html_extract.main_text(h) for _, _, h in rows)  # without a template


def test_html_classes_against_occurrence_vectors(spark):
    rng = random.Random(9)
    rows = []
    for i in range(60):
        parts = [f"<p>common {k}</p>" for k in range(4) if rng.random() < 0.8] + [f"<div class=c{rng.randrange(3)}><p>own {i}</p></div>"] * rng.randint(0, 2)
        rng.shuffle(parts)
        rows.append((i, f"http://{rng.choice('ab')}.example/{i}", "<body>" + "".join(parts) + "</body>"))
    rows.append((60, "http://a.example/", ""))
    vector = collections.defaultdict(dict)
    for i, url, h in rows:
        x = html_extract.cut_page(h)
        for t, n in collections.Counter(x.tok if x.texts else []).items():
            vector[url[7], t][i] = n
    want = collections.defaultdict(set)
    for (host, t), v in vector.items():
        want[host, tuple(sorted(v.items()))].add(t)
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = collections.defaultdict(set)
    for r in html_extract.classes(html_extract.cut_pages(df)).collect():
        if r.token != html_extract.PAGE:
            got[r.host[0], r.cls].add(r.token)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values())) and len(want) > 20


def test_html_walk_tells_order_nesting_and_slots():
    of = {1: 10, 2: 10, 3: 10, 4: 20, 5: 20, 6: 30}
    found, slots = html_extract.walk([1, 4, 5, 4, 5, 9, 2, 6, 3], of)
    assert found[20][1:] == (10, 1) and found[30][1:] == (10, 2) and found[10][1:] == (0, 0) and all(f[0] for f in found.values())
    assert slots[5] == (20, 2) and slots[7] == (10, 2)
    again, _ = html_extract.walk([1, 4, 5, 2, 6, 3], of)
    assert again == found
    assert html_extract.walk([1, 3, 2, 1, 2, 3], of)[0][10] == (0, 0, 0)  # no order
    assert html_extract.walk([1, 4, 2, 5, 3], of)[0][20] == (0, 0, 0)  # crosses
    assert html_extract.walk([1, 4, 5, 2, 4, 5, 3], of)[0][20] == (0, 0, 0)  # in two gaps


# 4


def test_lm_scores(docs, empty):
    grams = [collections.Counter() for _ in range(3)]
    rows = [words_of(t) for _, t in corpus()]
    for w in rows:
        for n in range(3):
            grams[n].update(tuple(w[i : i + n + 1]) for i in range(len(w) - n))
    total = sum(grams[0].values())

    def score(w):
        s, used = 0.0, [0, 0, 0]
        for i in range(len(w)):
            factor = 1.0
            for n in (2, 1):
                if i < n:
                    continue
                if grams[n][g := tuple(w[i - n : i + 1])] >= 2:
                    s += math.log(factor * grams[n][g] / grams[n - 1][g[:-1]])
                    used[n] += 1
                    break
                factor *= 0.4
            else:
                s += math.log(factor * grams[0][(w[i],)] / total)
                used[0] += 1
        return used, s

    want = collections.defaultdict(list)
    for (i, _), w in zip(corpus(), rows):
        want[i].append((w, score(w)))
    got = lm_score.scores(docs, partitions=3).collect()
    assert len(got) == len(rows)
    for r in got:
        w, (used, s) = want[r.doc_id][0]
        assert (r.n_words, [r.n_unigram, r.n_bigram, r.n_trigram]) == (len(w), used) and r.score == pytest.approx(s, abs=1e-3, rel=1e-7)
    assert lm_score.scores(empty).count() == 0
    table = collections.Counter((r.order, r["count"]) for r in lm_score.count_table(docs).collect())
    assert table == collections.Counter((n + 1, c) for n in range(3) for c in grams[n].values())


# 5


def test_bpe_against_the_library(docs, empty):
    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    codec, rng = bpe.Codec(RANKS, cache_size=50), random.Random(2)
    letters = "abstrevlmd''  \n\t 　1²é\U0001f600!?#ÜλЖ中’\x1c\x85\r"
    for _ in range(5000):
        t = "".join(rng.choice(letters) for _ in range(rng.randint(0, 14)))
        assert codec.encode(t) == library.encode_ordinary(t), t
    for t in ("ab" * 4000 + " " * 3000 + "x" * 900, "'s's'll 'S ''s", ""):
        ids, offsets = codec.encode_with_offsets(t)
        assert ids == library.encode_ordinary(t) and codec.decode(ids).decode() == t and offsets == list(itertools.accumulate([len(codec.bytes_of[x]) for x in ids[:-1]], initial=0))[: len(ids)]
    texts = dict(corpus())
    out = bpe.encode_documents(docs, RANKS)
    for r in out.collect():
        ids = library.encode_ordinary(texts[r.doc_id] or "")
        assert list(r.ids) == ids and r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()
    assert {r.doc_id: r.text for r in bpe.decode_documents(out, RANKS).collect()} == {i: t or "" for i, t in texts.items()}
    assert bpe.encode_documents(empty, RANKS).count() == 0


# 6


def brute_lines(rows, min_words):
    seen = {i: t for i, t in rows}
    symbols, places, size = [], [], []
    for i in sorted(seen):
        for k, line in enumerate((seen[i] or "").split("\n")):
            if line:
                symbols.append(line)
                places.append((i, k))
                size.append(len(WORD.findall(line)))
        symbols.append(object())
        places.append(None)
        size.append(0)
    n = len(symbols)
    lpf = [0] * n
    for x in range(n):
        if places[x]:
            for y in range(x):
                k = 0
                while x + k < n and places[x + k] and places[y + k] and symbols[x + k] == symbols[y + k]:
                    k += 1
                lpf[x] = max(lpf[x], k)
    gone, runs = collections.defaultdict(list), []
    for x in range(n):
        if sum(size[x : x + lpf[x]]) >= min_words and lpf[x]:
            if runs and x <= runs[-1][1]:
                runs[-1][1] = max(runs[-1][1], x + lpf[x])
            else:
                runs.append([x, x + lpf[x]])
    for a, b in runs:
        gone[places[a][0]].append((places[a][1], places[b - 1][1]))
    return gone


def line_rows(seed):
    rng = random.Random(seed)
    pool = [" ".join(rng.choice(VOCAB) for _ in range(rng.randint(1, 9))) for _ in range(8)] + ["", " "]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 12)))) for i in range(14)]
    return rows + [(20, rows[3][1]), (21, rows[3][1] + "\n" + rows[4][1]), (22, None), (23, ""), (3, rows[3][1]), (24, "\n".join([pool[0]] * 9))]


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_line_dedup(spark, empty, seed):
    rows = line_rows(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("spans", "h", "j", "found_id", "name")}).repartition(3)
    gone = brute_lines(rows, 12)
    got = line_dedup.without_repeats(df, 12)
    assert got.count() == len(rows)
    texts = dict(rows)
    for r in got.collect():
        cut = gone.get(r.doc_id, [])
        t = texts[r.doc_id]
        want = t if not cut else "\n".join(x for k, x in enumerate(t.split("\n")) if not any(a <= k <= b for a, b in cut))
        assert (r.text, [tuple(s) for s in r.spans or []]) == (want, cut), r.doc_id
    clean = line_dedup.cleaned(df, 12)
    lost = {i for i, t in rows if i in gone and not WORD.search("\n".join(x for k, x in enumerate(t.split("\n")) if not any(a <= k <= b for a, b in gone[i])))}
    assert clean.columns == df.columns and sorted(r.doc_id for r in clean.collect()) == sorted(i for i, _ in rows if i not in lost)
    assert line_dedup.without_repeats(empty).count() == 0 and line_dedup.cleaned(empty).count() == 0


def test_line_dedup_joins_no_short_runs(spark):
    """Two repeated runs of 40 words that share a line are no run of 60."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(20)) for x in "abc")
    df = spark.createDataFrame([(1, f"{a}\n{b}"), (2, f"{b}\n\n{c}"), (3, f"{a}\n{b}\n{c}"), (4, f"{a}\n{b}\n{c}"), (5, f"x\n{b}\n{c}\n")], "doc_id long, text string")
    assert {r.doc_id: r.spans for r in line_dedup.without_repeats(df, 50).collect() if r.spans} == {4: [(0, 2)]}
    assert {r.doc_id: r.spans for r in line_dedup.without_repeats(df, 40).collect() if r.spans} == {3: [(0, 2)], 4: [(0, 2)], 5: [(1, 2)]}
    assert sorted((r.doc_id, r.j, r.n_lines, r.copies) for r in line_dedup.intervals(df, 40).collect()) == [(1, 0, 2, 3), (2, 0, 2, 4)]


def test_shortest_runs():
    import numpy as np

    rng = np.random.default_rng(1)
    for _ in range(300):
        sizes = [rng.integers(0, 5, rng.integers(0, 8)) for _ in range(3)]
        least = int(rng.integers(1, 9))
        n1, n2 = line_dedup.shortest(np.concatenate(sizes), np.cumsum([0, *map(len, sizes)]), least)
        at = 0
        for w in sizes:
            runs = {(s, e) for s in range(len(w)) for e in range(s + 1, len(w) + 1) if w[s:e].sum() >= least and (w[s : e - 1].sum() < least or w[s + 1 : e].sum() < least)}
            assert {(s, s + n) for s in range(len(w)) if n1[at + s] for n in range(n1[at + s], n2[at + s] + 1)} == runs
            at += len(w)


# 7


def brute_rules(t):
    t = t or ""
    w = WORD.findall(t)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    count = collections.Counter(windows)
    inside = {i + k for i, x in enumerate(windows) if count[x] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(inside), len(lines), len(re.findall("[A-Z]", t))]


def test_quality_ablations(docs):
    ledger = quality_rules.ledger(docs)
    bits = [r.fail_bits for r in ledger.collect()]
    policy = quality_rules.POLICIES["default"]
    got = {r.rule: (r.n_failed, r.n_only, r.policy, r.policy_version) for r in quality_rules.ablations(ledger).collect()}
    assert got == {x: (sum(b & m != 0 for b in bits), sum(b == m for b in bits), policy.name, policy.version) for x, m in quality_rules.BIT.items()}
    assert quality_rules.ablations(ledger.limit(0)).count() == len(got) and {r.n_failed for r in quality_rules.ablations(ledger.limit(0)).collect()} == {0}
    both = {(r.old_kept, r.new_kept): r.n for r in quality_rules.compare(ledger, quality_rules.POLICIES["base"], policy).collect()}
    assert sum(both.values()) == len(bits) and both[True, True] == sum(b == 0 for b in bits)


def test_quality_rules(spark, docs, empty):
    rng = random.Random(4)
    rows = corpus() + [(400 + i, " ".join(rng.choice("a b c".split()) for _ in range(rng.randint(0, 70)))) for i in range(20)] + [(500, "a b c a b c\na b\na b"), (None, "X # Y")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("m", "ws", "ls", "hs", "fail_bits")})
    want = sorted([str(i), *brute_rules(t)] for i, t in rows)
    got = quality_rules.verdicts(df).collect()
    assert sorted([str(r.doc_id), *(r[x] for x in quality_rules.MEASURES)] for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and r.kept == (r.fail_bits == 0)
    assert quality_rules.accepted(df).columns == df.columns and quality_rules.accepted(df).count() == sum(r.kept for r in got)
    table = {r.rule: (r.n_failed, r.n_only) for r in quality_rules.ablations(quality_rules.ledger(df)).collect()}
    for name, bit in quality_rules.BIT.items():
        assert table.get(name, (0, 0)) == (sum(bool(r.fail_bits & bit) for r in got), sum(r.fail_bits == bit for r in got))
    change = {(r.old_kept, r.new_kept): r.n for r in quality_rules.compare(quality_rules.ledger(df), quality_rules.POLICIES["base"], quality_rules.POLICIES["default"]).collect()}
    assert sum(change.values()) == len(rows) and (False, True) not in change
    assert quality_rules.verdicts(empty).count() == 0
    plan = quality_rules.verdicts(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# 8


def test_crf_marginals_against_enumeration():
    import numpy as np

    rng = np.random.default_rng(0)
    score, row, trans = rng.normal(size=7), np.array([0, 3, 3, 7]), rng.normal(size=(2, 2))
    good, pairs, z = quality_crf.marginals(score, row, trans)
    want, want_pairs, want_z = np.zeros(7), np.zeros((2, 2)), 0.0
    for a, b in ((0, 3), (3, 7)):
        total, at, both = 0.0, np.zeros(b - a), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=b - a):
            p = math.exp(sum(score[a + i] * v for i, v in enumerate(y)) + sum(trans[u, v] for u, v in zip(y, y[1:])))
            total += p
            at += p * np.array(y)
            for u, v in zip(y, y[1:]):
                both[u, v] += p
        want[a:b], want_z = at / total, want_z + math.log(total)
        want_pairs += both / total
    assert np.allclose(good, want) and np.allclose(pairs, want_pairs) and z == pytest.approx(want_z)


def test_crf_learns_and_scores_everything(spark, empty):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(300):
        bad = i % 3 == 0
        lines = [" ".join(rng.choice(VOCAB[:36]) + ("%%%" if bad and k else "") for _ in range(12)) + "." for k in range(rng.randint(2, 6))]
        rows.append((i, "\n".join(lines)))
        labels.append((i, int(not bad)))
    rows += [(1000, None), (1001, ""), (1002, "\n \n"), (None, "x"), (5, rows[5][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("score", "quality", "held_out")})
    known = spark.createDataFrame([*labels, (None, 1), (7, None)], "doc_id long, quality int")
    model = quality_crf.fit(df, known, sample=150)
    got = quality_crf.classify(df, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    truth = dict(labels)
    held = [r for r in got if r.doc_id in truth and r.held_out]
    assert len(held) > 30 and sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert quality_crf.classify(empty, model).count() == 0
    blank = quality_crf.fit(df, known.limit(0))
    assert all(r.score == pytest.approx(0.5) for r in quality_crf.classify(df.limit(3), blank).collect())


# 9


def brute_align(a, b):
    """Best local score of two word lists without a band."""
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
    return max(map(max, h))


def test_alignment_against_brute_force():
    import numpy as np

    rng = np.random.default_rng(1)
    for _ in range(200):
        a = rng.integers(0, 4, rng.integers(1, 12)).astype(np.uint64)
        b = rng.integers(0, 4, rng.integers(1, 16)).astype(np.uint64)
        matched, first, end = license_scan.align(a, b, 0, 40)
        best = brute_align(a.tolist(), b.tolist())
        assert 2 * matched >= best and (best == 0 or brute_align(a.tolist(), b[first:end].tolist()) == best)


def test_license_scan(spark, empty):
    rng = random.Random(7)
    mit = license_texts.TEMPLATES["mit"]
    changed = mit.replace("free of charge", "without any charge").replace("sublicense", "sub license")
    around = text(rng, 200)
    rows = [(1, f"{around}\n{mit}\n{around}"), (2, changed.upper()), (3, around), (4, None), (5, ""), (6, "Été. Released under the MIT License."), (None, "Released under the MIT License."), (7, mit[:200]), (8, mit + " x " + mit)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("license", F.lit(1))
    got = license_scan.scan(df).collect()
    assert collections.Counter((r.doc_id, r.license) for r in got) == {(1, "mit"): 1, (2, "mit"): 1, (6, "notice-mit"): 1, (None, "notice-mit"): 1, (8, "mit"): 2}
    spans = {r.doc_id: r for r in got}
    assert " ".join(rows[0][1][spans[1].first_char : spans[1].end_char].split()) == " ".join(mit.rstrip(".").split()) and spans[1].coverage == 1.0
    assert 0.9 < spans[2].coverage < 1 and rows[5][1][spans[6].first_char : spans[6].end_char] == "Released under the MIT License"
    assert license_scan.scan(empty).count() == 0 and license_scan.scan(df, {}).count() == 0


def places(text, templates=license_texts.TEMPLATES, name=None):
    """Texts of the places of a template, or of all."""
    index = license_scan.Index(templates)
    words = text.lower().replace(".", " ").replace(",", " ").split()
    return [" ".join(words[a:b]) for t, _, a, b in license_scan._found(index, license_scan.words_of(text), 0.8, license_scan.BAND) if name in (None, index.names[t])]


@pytest.mark.parametrize("name", ["apache-2", "bsd-3", "cc-by-4", "gpl-3", "mpl-2", "unlicense"])
def test_license_whole_texts(name):
    whole = license_texts.TEMPLATES[name]
    index = license_scan.Index(license_texts.TEMPLATES)
    words = license_scan.words_of(f"before it {whole} after it")
    found = {index.names[t]: (matched, a, b) for t, matched, a, b in license_scan._found(index, words, 0.8, license_scan.BAND)}
    assert found[name] == (len(words) - 4, 2, len(words) - 2) and "bsd-2" not in found
    assert all("IN NO EVENT" in license_texts.TEMPLATES[x] for x in ("bsd-2", "isc", "unlicense"))


def test_license_copies_side_by_side():
    for gap in range(40):
        line = "Released under the MIT License. " + "x " * gap
        assert places(line * 100, name="notice-mit") == ["released under the mit license"] * 100, gap


@pytest.mark.parametrize("name", [x for x in license_texts.TEMPLATES if x.startswith("notice-")])
def test_license_notices_with_changed_words(name):
    words = license_texts.TEMPLATES[name].replace(".", " ").replace(",", " ").replace("-", " ").split()
    for at in itertools.combinations(range(len(words)), len(words) - math.ceil(0.8 * len(words))):
        changed = " ".join("other" if i in at else w for i, w in enumerate(words))
        assert places(f"Before it. {changed}. After it.", name=name), changed


def test_license_recall_against_aligning_every_template():
    """All that a full alignment of every template with every text finds with words changed or missing; with words put in
    between, for which the fingerprints guarantee nothing, 0.95 of it."""
    rng = random.Random(12)
    vocab = [f"w{i}" for i in range(60)]
    templates = {f"t{k}": " ".join(rng.choice(vocab) for _ in range(rng.randint(6, 40))) for k in range(12)}
    index = license_scan.Index(templates)
    for changes, least in (("cd", 1.0), ("cdi", 0.95)):
        want, got = set(), set()
        for n in range(150):
            words = templates[rng.choice(list(templates))].split()
            for _ in range(rng.randint(0, max(1, len(words) // 5))):
                at, kind = rng.randrange(len(words)), rng.choice(changes)
                words[at : at + 1] = {"c": [rng.choice(vocab)], "d": [], "i": [words[at], rng.choice(vocab)]}[kind]
            noise = [[f"n{rng.randrange(300)}" for _ in range(rng.randint(0, 30))] for _ in range(2)]
            hashed = license_scan.words_of(" ".join([*noise[0], *words, *noise[1]]))
            for t, template in enumerate(index.words):
                matched, _, _ = license_scan.align(template, hashed, 0, len(hashed) + len(template))
                if matched >= 0.8 * len(template):
                    want.add((n, t))
            got |= {(n, t) for t, *_ in license_scan._found(index, hashed, 0.8, license_scan.BAND)}
        assert len(want) > 80 and got <= want and len(got) >= least * len(want), (len(got), len(want))


# 10


def test_decontamination(spark, empty, docs):
    rng = random.Random(8)
    unique = [f"q{i}z{rng.randrange(10**6)}" for i in range(400)]
    items = [(i, " ".join(rng.sample(unique, rng.randint(12, 40))) + ". " + " ".join(rng.sample(unique, rng.randint(1, 9))) + ".") for i in range(25)] + [(90, None), (91, ""), (92, "... "), (93, " ".join(rng.sample(unique, 390)))]
    rows = corpus()
    planted = []
    for k, (i, t) in enumerate([x for x in items if x[1] and x[0] != 92]):
        before, after = text(rng, rng.randint(0, 300)), text(rng, rng.randint(0, 300))
        rows.append((1000 + k, f"{before} {t.upper() if k % 2 else t} {after}"))
        planted.append((1000 + k, i))
    rows += [(2000, items[0][1].split(". ")[0]), (2001, " ".join(reversed(items[1][1].split()))), (None, items[2][1]), (1000, next(t for i, t in rows if i == 1000))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("bad_id", "item_id", "score")})
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    whole = decontaminate.hits(df, bench).collect()
    assert collections.Counter((r.doc_id, r.item_id) for r in whole) == collections.Counter([*planted, planted[0], (None, 2)])
    assert sorted(map(str, decontaminate.hits(df, bench, index_bytes=20_000).collect())) == sorted(map(str, whole))
    kept = decontaminate.clean(df, bench)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, _ in rows if i is not None} - {i for i, _ in planted}
    same_id = df.where("doc_id = 1001").unionByName(df.where("doc_id = 3").withColumn("doc_id", F.lit(1001).cast("long")))
    assert [r.text for r in decontaminate.clean(same_id, bench).collect()] == [r.text for r in df.where("doc_id = 3").collect()]
    assert decontaminate.hits(empty, bench).count() == 0 and decontaminate.hits(df, bench.limit(0)).count() == 0


@pytest.mark.parametrize("threshold", [0.2, 0.4, 0.7])
def test_pivots_and_blocks_lose_nothing(threshold):
    """Retrieval against BM25 scored in full, by one index and by several; scores are the same."""
    import numpy as np
    import pyarrow as pa

    from featloom.llm.common import passes, word_hashes, word_spans

    rng = random.Random(9)
    items = [(i, " ".join(rng.choice(VOCAB[:36]) for _ in range(rng.randint(3, 30)))) for i in range(40)]
    words_in = [re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", t.lower()) for _, t in items]
    df = collections.Counter(w for d in words_in for w in set(d))
    mean, n = sum(map(len, words_in)) / len(items), len(items)

    def impacts(d):
        c = collections.Counter(d)
        w = {t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * k * 2.2 / (k + 1.2 * (0.25 + 0.75 * len(d) / mean)) for t, k in c.items()}
        return {t: x / sum(w.values()) for t, x in w.items()}

    tables = [impacts(d) for d in words_in]
    texts = [" ".join(rng.choice(VOCAB[:36]) for _ in range(rng.randint(0, 200))) for _ in range(30)]
    want = {}
    for t, x in enumerate(texts):
        w = re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", x.lower())
        for f in range(0, max(len(w) - 32, 1) if w else 0, 32):
            terms = set(w[f : f + 64])
            for e, table in enumerate(tables):
                score = sum(v for k, v in table.items() if k in terms)
                if score >= threshold:
                    want[t, e, f] = score
    known = decontaminate.Statistics()
    known.add([t for _, t in items])
    for shard in (40, 7):
        got = {}
        for at in range(0, 40, shard):
            index = decontaminate.Index(items[at : at + shard], threshold, known)
            for _, _, raw, offsets in passes(pa.array(texts)):
                starts, ends, row = word_spans(raw, offsets, decontaminate.ALNUM)
                got |= {(t, at + e, f): s for t, e, f, s in index.retrieve(word_hashes(raw, starts, ends), row)}
        near = {k for k, v in want.items() if abs(v - threshold) < 1e-5}
        assert set(got) - near == set(want) - near and want and all(abs(got[k] - want[k]) < 1e-5 for k in set(got) & set(want))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_queries_against_sql(spark):
    import duckdb

    import __spark_entry__ as entry
    from featloom.llm import queries

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    for name in queries.QUERIES:
        df = entry.queries()[name](spark, sf)
        rows = [tuple(r) for r in df.collect()]
        assert rows or name in ("op9_license_scan", "op10_decontamination")
        if name in queries.ORACLES:
            c = con.execute(queries.ORACLES[name])
            order = [d[0] for d in c.description]
            at = [df.columns.index(x) for x in order]
            assert sorted(df.columns) == sorted(order) and sorted(str([r[i] for i in at]) for r in rows) == sorted(str(list(r)) for r in c.fetchall()), name
