import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corviq.llm import capfilters, components, langid, linechunks, maintext, mixing, mpegaudio, packing, queries, simhash, surrogates, urlrules
from tests.conftest import DATA, same

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, h int, fp string, _drops int"


def docs(spark, texts, source="s", lang="en"):
    rows = [(k, t, lang, source, len(t or ""), "x", 1, "y", 2) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def classes(items, linked):
    label = {k: k for k in items}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(spark, duck, name):
    same(duck, queries.SQL[name], queries.QUERIES[name](spark, DATA))


def test_components(spark):
    rng = np.random.default_rng(3)
    links = [tuple(map(int, x)) for x in rng.integers(0, 300, (200, 2))] + [(1000, k) for k in range(1001, 1100)] + [(5, 5), (None, 3)]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    real = [(a, b) for a, b in links if a is not None and a != b]
    assert got == classes({x for p in real for x in p}, real)
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# -- 1 ---------------------------------------------------------------------------------------------------------------


KEY = bytes(range(32))


def gender_of(name):
    """By the lists, or by the ending of a made name."""
    name = name.capitalize()
    if name in surrogates.WHOSE:
        return surrogates.WHOSE[name][1]
    return next((g for (_, g), ends in surrogates.GIVEN_ENDINGS.items() if name.endswith(ends)), None)


def test_surrogates(spark):
    text = "Frau Anna Müller, anna@corp.example.org, +1 (212) 555-0199, 10.1.2.3, 4111 1111 1111 1111; Anna Müller. Иван Петров token = \"abc123def456\""
    df = docs(spark, [text, "ANNA@corp.example.org wrote", None, "", "nothing here, 12 or 3.5"]).withColumn("n_entities", F.lit("old"))
    rows = {r["doc_id"]: r for r in surrogates.pseudonymize(df, KEY).collect()}
    out = rows[0]["text"]
    for secret in ("Anna", "Müller", "anna@", "555-0199", "10.1.2.3", "4111 1111", "Иван", "Петров", "abc123"):
        assert secret not in out
    name = out.split(",")[0].removeprefix("Frau ")
    assert out.count(name) == 2 and gender_of(name.split()[0]) == "f"  # coreference and gender
    assert [len(p) for p in out.split(", ")[2].split(" ")] == [2, 5, 8]
    spans = surrogates.find(out)
    card = next(v for _, _, k, v in spans if k == "card")
    assert surrogates.luhn(card) and next(v for _, _, k, v in spans if k == "lan").startswith("10.")
    assert rows[1]["text"].split("@")[0].isupper() and rows[1]["text"].split()[0].lower() in out
    assert rows[2]["text"] is None and rows[3]["text"] == "" and rows[4]["text"] == "nothing here, 12 or 3.5"
    assert rows[0]["id"] == "x" and rows[0]["n_entities"] == len(spans) and rows[4]["n_entities"] == 0
    assert surrogates.pseudonymize(df.limit(0), KEY).count() == 0
    with pytest.raises(ValueError):
        surrogates.pseudonymize(df, b"short")
    other = surrogates.pseudonymize(df, bytes(32)).where("doc_id = 0").first()["text"]
    assert other != out  # surrogates hang on the key


def replaced(text):
    """The words of a text by their surrogates, without collisions."""
    out, at = [], 0
    for a, b, kind, value in surrogates.find(text):
        out += [text[at:a], surrogates._fit(kind, text[a:b], surrogates.surrogate(KEY, kind, value, 0))]
        at = b
    return "".join([*out, text[at:]])


def test_persons():
    text = "Anna Schmidt came. Later Anna said that Schmidt was late, and Anna SCHMIDT agreed. The Schmidts didn't."
    out = replaced(text)
    given, last = out.split()[:2]
    assert out == text.replace("Schmidts", "#").replace("Anna", given).replace("Schmidt", last).replace("SCHMIDT", last.upper()).replace("#", "Schmidts")
    found = lambda t: [t[a:b] for a, b, _, _ in surrogates.find(t)]
    assert found("Siobhan Gallagher and Wei Zhang and Priya Patel wrote it") == ["Siobhan", "Gallagher", "Wei", "Zhang", "Priya", "Patel"]
    assert found("a report by Nkechi Okafor, Tunde Bello") == ["Nkechi", "Okafor", "Tunde", "Bello"]
    assert found("The Big Apple is large. In New York, Old Town Hall stands.") == []
    assert found("Dear Dr. O'Brien, hello") == ["O'Brien"]
    assert found("Write to siobhan.kelly@corp.example.org. Siobhan Kelly knows.") == ["siobhan.kelly@corp.example.org", "Siobhan", "Kelly"]
    assert found("Sehr geehrter Herr Jürgen Weiß-Braun") == ["Jürgen", "Weiß-Braun"]
    assert [k for _, _, k, _ in surrogates.find("Frau Dr. Xaviera Moss")] == ["given-latin-f", "name-latin-n"]
    assert found("Maria") == [] and found("Иван Петров и Ольга Петрова") == ["Иван", "Петров", "Ольга", "Петрова"]


def test_types_and_formats():
    iban = "DE89 3704 0044 0532 0130 00"
    out = replaced(f"pay {iban} now")[4:-4]
    assert surrogates.mod97(iban.replace(" ", "")) == surrogates.mod97(out.replace(" ", "")) == 1 and out[:2] == "DE" and [len(x) for x in out.split()] == [4, 4, 4, 4, 4, 2]
    for phone, code in (("+49 30 1234567", "+49 "), ("+1 (212) 555-0199", "+1 ("), ("+351 21 123 4567", "+351 ")):
        assert replaced(phone).startswith(code) and replaced(phone) != phone
    for ip, head in (("192.168.1.1", "192.168."), ("10.9.8.7", "10."), ("172.20.0.9", "172.")):
        assert replaced(ip).startswith(head) and surrogates.find(replaced(ip))[0][2] == "lan"
    assert surrogates.find(replaced("8.8.4.4"))[0][2] == "ip"
    six = replaced("at 2001:db8:0:1::beef, 12:30:45")
    assert six.startswith("at 2001:db8:0:") and six.endswith(", 12:30:45") and "beef" not in six
    for date in ("born on 24.12.1987", "DOB: 1987-12-24", "born 12/24/1987"):
        made = replaced(date)
        assert made != date and surrogates.find(made)[0][2] == "birth" and len(made) == len(date)
    assert len({surrogates._shifted(KEY, f"{d:02d}.{m:02d}.{y}") for y in (1980, 1981) for m in range(1, 13) for d in range(1, 29)}) == 2 * 12 * 28
    assert len({surrogates.surrogate(KEY, "lan", f"192.168.{a}.{b}", 0) for a in range(40) for b in range(256)}) == 40 * 256
    for street in ("12 Old Mill Road", "Hauptstraße 7b", "5 rue de la Paix", "Calle de Alcalá, 42"):
        made = replaced(f"at {street}.")
        assert surrogates.find(made)[0][2] == "street" and made != f"at {street}." and replaced(f"AT {street.upper()}") is not None
    kinds = lambda t: [k for _, _, k, _ in surrogates.find(t)]
    assert kinds("+1 (826) 555-4081 190.137.223.204 du") == ["phone", "ip"] and kinds("+49 30 1234567 8.8.8.8") == ["phone", "ip"] and kinds("(030) 123 4567 4111111111111111") == ["phone", "card"]
    assert surrogates.find("4111 1111 1111 1112") == [] and replaced("token = \"deadbeef99\"")[9:].strip('"').islower()


def test_surrogates_in_long_texts(spark):
    text = "\n".join(f"line {k}: mail{k % 50}@ab.example.com and Herr Kunze {'x' * (k % 30)}" for k in range(20_000))
    rows = surrogates.pseudonymize(docs(spark, [text, text]), KEY).collect()
    assert rows[0]["text"] == rows[1]["text"] and rows[0]["n_entities"] == 40_000
    assert "Kunze" not in rows[0]["text"] and len(rows[0]["text"].split("\n")) == 20_000
    assert len({w for w in rows[0]["text"].split() if "@" in w}) == 50


def test_surrogates_stay_distinct(spark):
    """A space of a hundred forms, with ninety entities: collisions must be resolved, also against real entities."""
    df = docs(spark, [f"Herr {n}" for n in "Ab Cd Ef Gh".split()] + [f"{a}{b}.x@ab.example.com" for a in "abcdefghij" for b in "klmnopqrs"] + [f"{c}@ab.example.com" for c in "abcdefghijklmnopqrst"])
    rows = surrogates.pseudonymize(df, KEY).collect()
    made = [r["text"] for r in rows if "@" in r["text"]]
    real = {r["text"] for r in df.collect()}
    assert len(set(made)) == 110 and not set(made) & real


def test_surrogates_against_brute_force(spark):
    """All types in one table, ids null or repeated: a mapping that is one to one by type and hits no real entity."""
    given = [*surrogates.GIVEN["latin", "f"], *surrogates.GIVEN["latin", "m"]]
    texts = [f"{g} {'Baker' if k % 2 else 'Cook' + 'abcdefghij'[k % 10]} met us; {g} left" for k, g in enumerate(given)]
    texts += [f"{c}@ab.example.com" for c in "abcdefghijklmnopqrst"] + [f"call +1 (212) 555-{n:04d} or 100.{n}.7.8" for n in range(50)]
    rows = [(None if k % 3 == 0 else k % 5, t) for k, t in enumerate(texts)]
    df = spark.createDataFrame([*rows, *rows[:30]], "doc_id long, text string")
    got = surrogates.pseudonymize(df, KEY).collect()
    real = {}
    for _, t in rows:
        for _, _, kind, value in surrogates.find(t):
            real.setdefault(kind.split("-")[0], set()).add((kind, value))
    made = {}
    for r in got:
        for _, _, kind, value in surrogates.find(r["text"]):
            made.setdefault(kind.split("-")[0], set()).add(value)
    assert sum(r["n_entities"] for r in got) == sum(len(surrogates.find(t)) for _, t in [*rows, *rows[:30]])
    for family, entities in real.items():
        if family in ("email", "ip", "phone"):
            assert len(made[family]) == len(entities), family
            assert not made[family] & {v for _, v in entities}, family
    names = [tuple(r["text"].split()[:2]) for r in got if " met us" in r["text"]]
    assert len({g for g, _ in names}) == len(given) and not {g for g, _ in names} & set(given)
    assert all(r["text"].endswith(f"{r['text'].split()[0]} left") for r in got if " met us" in r["text"])
    assert len({s for _, s in names}) == len({t.split()[1] for t in texts if " met us" in t})


# -- 2 ---------------------------------------------------------------------------------------------------------------


def test_url_rules(spark):
    urls = [
        "http://Example.NET/en/x?y", "https://a.example.net/de/", "https://example.com/de/1", "https://x.org/fr/", "https://x.org/frx/", "ftp://notexample.net", None, "", "no scheme", "http://example.com#a://b/de/",
        "https://casino-win.example.com/", "https://free-bets.example.com", "https://thesis.example.com/casino", "x://net/", "x://org/fr/?", "http://badnet/",
    ]
    df = spark.createDataFrame([(k, u, 1, 2) for k, u in enumerate([*urls, urls[0]])], "page_id long, url string, rule int, t int")
    got = {r["page_id"]: (r["rule"], r["verdict"], r["host"], r["path"]) for r in urlrules.filter_urls(df).collect()}
    assert [got[k][:2] for k in range(len(urls))] == [
        ("example.net/en/", "allow"), ("net/", "block"), ("example.com/de/", "block"), ("org/fr/", "allow"), (None, "allow"), (None, "allow"), (None, "allow"), (None, "allow"), (None, "allow"), (None, "allow"),
        (None, "block"), (None, "block"), (None, "allow"), ("net/", "block"), ("org/fr/", "allow"), (None, "allow"),
    ]
    assert got[0][2:] == ("example.net", "/en/x") and got[6][2:] == ("", "") and got[9][2:] == ("example.com", "")
    for k, u in enumerate(urls):
        assert urlrules.split_url(u) == got[k][2:]
    assert got[len(urls)] == got[0]
    assert urlrules.filter_urls(df.limit(0)).count() == 0


def test_patterns():
    def fits(pattern, target):
        return bool(__import__("re").compile(urlrules.pattern_rule(pattern).regex, 16).match(target))

    assert fits("||ads.example^", "x.ads.example/a") and not fits("||ads.example^", "bads.example/a") and not fits("||ads.example^", "ads.examples/")
    assert fits("/banner/*/img^", "h.org/Banner/1/2/img?") and fits("|h.org/a|", "h.org/a") and not fits("|h.org/a|", "h.org/ab") and not fits("|org/a", "h.org/a")
    assert fits("/ad[0-9]+/", "h.org/x/AD77") and fits("a%b", "x/a%b") and urlrules.pattern_rule("! note") is None and urlrules.pattern_rule("  ") is None
    tokens = lambda p: urlrules.pattern_rule(p).tokens
    assert tokens("||ads.example^x*") == ("ads", "example") and tokens("banner") == () and tokens("/a/b") == ("a",) and tokens("/a/b|") == ("a", "b") and tokens("/x[0-9]/") == ()
    assert urlrules.pattern_rule("@@||a.b^").verdict == "allow"


def test_long_rule_lists_are_joined(spark, monkeypatch):
    """The join by token gives what running every rule on every url gives, and so does the list in the tasks."""
    import random

    r = random.Random(3)
    words = ["ads", "news", "shop", "cdn", "img", "track", "win", "blog", "x1", "longer-word"]
    lines = [f"{r.choice(['', '@@'])}{r.choice(['||', '|', '', ''])}{r.choice(words)}{r.choice(['.', '/', '^', '*', '-'])}{r.choice(words)}{r.choice(['', '^', '|', '*'])}" for _ in range(400)] + ["/x[0-9]\\.(com|org)/", "! comment", "", None]
    urls = [f"https://{'.'.join(r.sample(words, r.randint(1, 3)))}.{r.choice(['com', 'org'])}{r.choice(['', '/', '/' + '/'.join(r.sample(words, r.randint(1, 3)))])}{r.choice(['', '?q=ads'])}" for _ in range(300)] + [None, "", "https://" + "a" * 50000 + "/ads/win"]
    pages = spark.createDataFrame([(k, u, "t", "n") for k, u in enumerate([*urls, urls[0]])], "page_id long, url string, target string, rule string")
    rules = urlrules.read_rules(spark.createDataFrame([(x,) for x in lines], "value string"))
    every = [urlrules.pattern_rule(x) for x in lines if x and urlrules.pattern_rule(x)]
    hosts = spark.createDataFrame([(h.name, h.verdict, h.regex, list(h.tokens), h.length, h.own) for h in urlrules.HOST_RULES], urlrules.RULE)
    want = []
    for k, u in enumerate([*urls, urls[0]]):
        h, p = urlrules.split_url(u)
        own = {x.verdict for x in every if __import__("re").compile(x.regex, 16).match(h + p)}
        want.append((k, *urlrules.decide([(x.length, x.name, x.verdict) for x in urlrules.HOST_RULES if __import__("re").match(x.regex, h + p)], own)))
    assert {"allow", "block"} == {v for _, _, v in want}
    for most in (100_000, 10):
        monkeypatch.setattr(urlrules, "IN_TASKS", most)
        got = sorted((x["page_id"], x["rule"], x["verdict"]) for x in urlrules.filter_urls(pages, rules=rules.union(hosts)).collect())
        assert got == want
        assert urlrules.filter_urls(pages.limit(0), rules=rules).count() == 0


# -- 3 ---------------------------------------------------------------------------------------------------------------

PAGES = [
    (None, ""),
    ("", ""),
    ("plain", "plain"),
    ("<p>a &amp; b&nbsp;c <b>d</b>e", "a & b c de"),
    (
        '<html><body><nav><a href=1>Home</a></nav><div class="content"><h1>Title, here</h1><p>First para, with commas, and more text than most.</p><p>Short.</p></div>'
        '<div class="sidebar"><p>Side text, long enough to count for points, surely, yes.</p></div><div id="comments"><p>Nice post, thanks a lot, really, I enjoyed.</p></div><footer>x</footer></body></html>',
        "Title, here First para, with commas, and more text than most. Short.",
    ),
    (
        "<body><main><article><header><h1>T</h1></header><p>Hello there, this is a long paragraph of text.</p><ul><li><a href=a>r1</a></li><li><a href=b>r2</a><li><a href=c>r3</a></ul>"
        "<form><p>Subscribe, now, to this, great letter</p></form><p>End.</p></article></main><aside>zz</aside></body>",
        "T Hello there, this is a long paragraph of text. r1 r2 r3 End.",
    ),
    ('<script>var t="</p><p>no</p>";</script><article><p>One.<p>Two<br>three</article>', "One. Two three"),
    ("<article><p>cut off in a tag <b", "cut off in a tag"),
]


def test_main_text(spark):
    df = spark.createDataFrame([(k, f"u{k}", h, "t") for k, (h, _) in enumerate(PAGES)], "page_id long, url string, html string, text string")
    got = {r["page_id"]: r for r in maintext.extract(df).collect()}
    assert [got[k]["text"] for k in range(len(PAGES))] == [t for _, t in PAGES]
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())
    for page in ("<div>" * 20000 + "x", "<p '" * 20000, '<a href="' * 20000, "</b>" * 20000, "<!--" * 5000):
        maintext.main_text(page)


_FIRST = "The first paragraph, with commas, and quite some words to count for points."
_SECOND = "A second one, also long enough, with a comma or two, to be scored by its length."
_BODY = f"<p>{_FIRST}</p><p>{_SECOND}</p>"


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f'<article><h1>T</h1>{_BODY}<section id="discussion"><p>We discuss it.</p></section><div class="related-work"><p>Others did.</p></div></article>', f"T {_FIRST} {_SECOND} We discuss it. Others did."),
        (f"<article>{_BODY}<p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be.</p></article>", f"{_FIRST} {_SECOND} Let x=1 be."),
        (f"<article>{_BODY}<ul><li><a href=a>Ref one</a></li><li><a href=b>Ref two</a></li><li><a href=c>Ref three</a></li></ul></article>", f"{_FIRST} {_SECOND} Ref one Ref two Ref three"),
        (f'<article><header><h1>Title</h1><div class="meta">by me</div></header>{_BODY}</article>', f"Title {_FIRST} {_SECOND}"),
        (f'<article>{_BODY}<div class="related"><a href=a>More of this</a> <a href=b>and that</a></div><div class="notice">We use cookies.</div><div id="ad-slot">Buy!</div></article>', f"{_FIRST} {_SECOND}"),
        (f'<body><div class="content">{_BODY}</div><p>See <a href=1>this short link</a> and more.</p></body>', f"{_FIRST} {_SECOND} See this short link and more."),
        (f'<body><div class="post"><p>Short.</p></div><div id="comments"><p>{_SECOND}</p><p>{_SECOND}</p></div></body>', "Short."),
        (f'<body><div class="menu"><h2>H</h2>{_BODY}</div></body>', f"H {_FIRST} {_SECOND}"),
    ],
)
def test_main_text_inside_the_article(page, want):
    assert maintext.main_text(page) == want


def gold_pages():
    """Pages of many layouts with the text of their article: twelve ways to wrap it, with five sets of surroundings."""
    wraps = [
        "<article>{}</article>", "<main>{}</main>", "<main><article>{}</article></main>", '<div class="content no-sidebar">{}</div>', '<div class="wrap has-sidebar"><div class="inner">{}</div></div>',
        '<div class="post hentry category-news tag-python">{}</div>', '<div class="post comments-open">{}</div>', '<div id="main"><div class="entry-content">{}</div></div>', "<section>{}</section>",
        '<div class="page-layout"><section class="text">{}</section></div>', '<table><tr><td class="body">{}</td></tr></table>', '<div class="story"><div class="header-image"></div>{}</div>',
    ]
    links = "".join(f'<li><a href="/{k}">Section {k}</a></li>' for k in range(7))
    rounds = [
        ("", ""),
        (f"<nav><ul>{links}</ul></nav><header><a href=/>Site</a></header>", "<footer>Imprint, and contact, and more</footer>"),
        (f'<div class="navbar"><ul>{links}</ul></div><div class="ad">Buy now, really, the best, of all, offers here today.</div>', f'<div id="sidebar"><h3>Popular</h3><ul>{links}</ul><p>Some text in the sidebar, with commas, long enough to count.</p></div>'),
        ('<div class="cookieNotice"><p>We use cookies, and such, to serve you better, as ever, and always.</p></div>', '<div class="comments"><div class="comment"><p>Great post, I liked it, thank you, and so did my friends, all of them.</p></div></div>'),
        ('<div style="display:none"><p>Hidden text, with commas, that is long enough to score, too.</p></div>', '<form><p>Subscribe to our letter, now, today, for free, please.</p></form><div class="share"><a href=x>Tweet</a></div>'),
    ]
    for w, wrap in enumerate(wraps):
        for r, (before, after) in enumerate(rounds):
            blocks = [f"Paragraph {k} of page {w} {r}, with a comma, and some words more to make it long enough." for k in range(2 + (w + r) % 4)]
            inner = "".join(f"<p>{b.replace('comma', '<em>comma</em>')}</p>" for b in blocks[:-1]) + f"<h2>Part</h2><ul><li>{blocks[-1]}</li></ul>"
            yield f"<html><head><title>t</title></head><body>{before}{wrap.format(inner)}{after}</body></html>", " ".join([*blocks[:-1], "Part", blocks[-1]])


def test_main_text_gold():
    from collections import Counter

    pages = list(gold_pages())
    shared = found = wanted = exact = 0
    for page, gold in pages:
        a, b = Counter(maintext.main_text(page).split()), Counter(gold.split())
        shared, found, wanted, exact = shared + (a & b).total(), found + a.total(), wanted + b.total(), exact + (a == b)
    print(f"{len(pages)} pages, precision {shared / found:.4f}, recall {shared / wanted:.4f}, exact {exact}")
    assert len(pages) == 60 and shared / found >= 0.99 and shared / wanted >= 0.99


def test_main_text_tables(spark):
    df = spark.createDataFrame([(1, "u", PAGES[4][0]), (1, "u", PAGES[4][0]), (None, None, None)], "page_id long, url string, html string").withColumn("text", F.lit(1)).withColumn("n_chars", F.lit(2))
    rows = maintext.extract(df).collect()
    assert [r["text"] for r in rows] == [PAGES[4][1], PAGES[4][1], ""] and maintext.extract(df.limit(0)).count() == 0


# -- 4 ---------------------------------------------------------------------------------------------------------------


def naive_spots(text, passage=48, least=1):
    """(first, lines) of what is compared, straight from the rules and without the operator's own code."""
    import xxhash

    lines = text.split("\n")
    words = [len(x.split()) for x in lines]
    n, out, own, last = len(lines), set(), [], 0
    for k, line in enumerate(lines):  # content-defined chunks
        if words[k] >= passage:
            if own:
                out.add((own[0], len(own)))
            out.add((k, 1))
            own, last = [], 0
            continue
        h = xxhash.xxh64_intdigest(line.encode())
        rolled = (last * 0x9E3779B97F4A7C15 + h) % 2**64
        last = h
        own.append(k)
        if len(own) == 16 or len(own) >= 2 and not rolled >> 17 & 1:
            out.add((own[0], len(own)))
            own = []
    if own:
        out.add((own[0], len(own)))
    for a in range(n):  # least runs from each line on
        if words[a]:
            b = next((b for b in range(a + 1, n + 1) if sum(words[a:b]) >= passage), None)
            if b:
                out.add((a, b - a))
    for b in range(1, n + 1):  # least runs up to each line, of blank lines in a row the first eight
        a = next((a for a in range(b - 1, -1, -1) if sum(words[a:b]) >= passage), None)
        if a is not None and any(words[max(0, b - 9) : b]):
            out.add((a, b - a))
    first = {}
    joined = set()
    for a, size in sorted(out):
        at = first.setdefault(tuple(lines[a : a + size]), a)
        joined.add((at, a + size - at) if at < a < at + size else (a, size))
    return [(a, size) for a, size in sorted(joined) if sum(words[a : a + size]) >= (least if size > 1 else passage)]


def brute_lines(rows):
    """Texts by id (ids are distinct here)."""
    seen, out = {}, {}
    spots = [(d, a, n, "\n".join(t.split("\n")[a : a + n])) for d, t in rows if t for a, n in naive_spots(t)]
    for d, a, _, body in sorted(spots, key=lambda s: s[:2]):
        seen.setdefault(body, (d, a))
    for d, t in rows:
        gone = {k for dd, a, n, body in spots if dd == d and seen[body] != (d, a) for k in range(a, a + n)} if t else ()
        out[d] = t if not gone else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone)
    return out


def test_line_chunks(spark, real):
    rows = [(r["doc_id"], r["text"]) for r in real.collect()]
    got = {r["doc_id"]: r["text"] for r in linechunks.dedup_lines(real).collect()}
    assert got == brute_lines(rows)


def test_line_chunks_shift_and_edges(spark):
    passage = "\n".join(f"line {k} of a passage that many documents share, word for word, {k}" for k in range(12))
    texts = ["start\n" + passage, "other\nlines\nbefore it\n" + passage + "\nafter", None, "", "x", "x", passage, "\n\n\n"]
    df = docs(spark, texts)
    got = {r["doc_id"]: r for r in linechunks.dedup_lines(df).collect()}
    assert got[0]["text"] == texts[0]  # the first stays whole
    assert got[1]["removed_lines"] >= 6 and got[6]["removed_lines"] >= 6
    assert [got[k]["text"] for k in (2, 3, 4, 5, 7)] == [None, "", "x", "x", "\n\n\n"]
    assert got[0]["_drops"] == 2 and got[0]["id"] == "x"
    twice = df.union(df)
    assert linechunks.dedup_lines(twice).where("doc_id = 0 and removed_lines = 0").count() == 2
    nameless = [r["text"] for r in linechunks.dedup_lines(df.withColumn("doc_id", F.lit(None).cast("long"))).collect()]
    assert sum((t or "").count(passage) for t in nameless) == 1  # the one with the least hash of its text stays whole
    assert linechunks.dedup_lines(df.limit(0)).count() == 0
    long = " ".join(f"w{k}" for k in range(60))
    pair = {r["doc_id"]: r["text"] for r in linechunks.dedup_lines(docs(spark, [f"a\n{long}\nb", f"c c\n{long}\nd"])).collect()}
    assert pair == {0: f"a\n{long}\nb", 1: "c c\nd"}


def common_runs(rows, least):
    """(document, line) of all lines in a run of ``least`` words or more that stands before in (document, line) order."""
    at, gone = {}, set()
    texts = {d: t.split("\n") for d, t in sorted(rows)}
    for d, lines in texts.items():
        for k, line in enumerate(lines):
            for dd, kk in at.get(line, ()):
                if k and kk and lines[k - 1] == texts[dd][kk - 1]:
                    continue  # no start of a maximal run
                n = 0
                while k + n < len(lines) and kk + n < len(texts[dd]) and lines[k + n] == texts[dd][kk + n] and (dd < d or kk + n < k):
                    n += 1
                if sum(len(x.split()) for x in lines[k : k + n]) >= least:
                    gone |= {(d, k + i) for i in range(n)}
            at.setdefault(line, []).append((d, k))
    return gone


def test_line_chunks_compare_bytes(spark):
    """With digests of one byte most chunks collide: their bytes differ, so nothing of them goes, and no line is lost."""
    rng = np.random.default_rng(6)
    texts = ["\n".join(" ".join(f"w{x}" for x in rng.integers(0, 10**6, 6)) for _ in range(9)) for _ in range(60)]
    got = linechunks.dedup_lines(docs(spark, texts), digest=1).collect()
    assert sorted(r["text"] for r in got) == sorted(texts)
    same = {r["doc_id"]: r["text"] for r in linechunks.dedup_lines(docs(spark, [*texts[:3], texts[0]])).collect()}
    assert [same[k] for k in range(4)] == [*texts[:3], ""]


def test_line_chunks_share_ids_and_names(spark):
    """Rows that share an id but not the text lose nothing that stands nowhere else; columns keep their clashing names."""
    head = "\n".join(f"shared line {k} with words" for k in range(12))
    a, b = head + "\nonly in a, some words", "first of b, other words\nsecond of b, more words\n" + head
    df = docs(spark, [a, b]).withColumn("doc_id", F.lit(7).cast("long")).withColumn("removed_lines", F.lit("old")).withColumn("spots", F.lit(1)).withColumn("row", F.lit(2))
    rows = linechunks.dedup_lines(df).collect()
    lines = [x for r in rows for x in r["text"].split("\n")]
    assert set(lines) == {*a.split("\n"), *b.split("\n")} and len(lines) < 27
    assert rows[0]["spots"] == 1 and rows[0]["row"] == 2 and {type(r["removed_lines"]) for r in rows} == {int}
    short = "alpha beta\ngamma delta"  # a chunk of two short lines is one too
    assert sorted(r["text"] for r in linechunks.dedup_lines(docs(spark, [short, short])).collect()) == ["", short]
    long = "\n".join(f"{k} {k * 7919}" for k in range(60000))
    assert [r["removed_lines"] for r in linechunks.dedup_lines(docs(spark, [long, long + "\nend of it"])).orderBy("doc_id").collect()][0] == 0


@pytest.mark.parametrize("n_lines,words", [(1, 50), (2, 27), (2, 40), (3, 18), (3, 30), (4, 15), (5, 12), (8, 15), (12, 13), (26, 2)])
def test_line_chunks_find_whole_passages(spark, n_lines, words):
    """Passages between lines of their own in twenty pairs of documents: all lines of the second copy go, and no others."""
    rng = np.random.default_rng(n_lines * 100 + words)

    def lines(n, size=None):
        return [" ".join(f"w{x}" for x in rng.integers(0, 10**6, size or rng.integers(1, 40))) for _ in range(n)]

    texts, want = [], []
    for _ in range(20):
        passage = lines(n_lines, words)
        passage[1:1] = ["", ""] if n_lines > 1 else []
        a, b, c, d = (lines(int(rng.integers(0, 6))) for _ in range(4))
        texts += ["\n".join(a + passage + b), "\n".join(c + passage + d)]
        want += [texts[-2], "\n".join(c + d)]
    got = {r["doc_id"]: r["text"] for r in linechunks.dedup_lines(docs(spark, texts)).collect()}
    assert [got[k] for k in range(len(texts))] == want


def test_line_chunks_against_common_runs(spark):
    rng = np.random.default_rng(4)
    pool = [" ".join(f"w{x}" for x in rng.integers(0, 10**6, n)) for n in rng.integers(1, 40, 300)]
    rows = []
    for k in range(120):
        own = []
        for _ in range(rng.integers(1, 4)):
            at = int(rng.integers(0, 290))
            own += pool[at : at + int(rng.integers(1, 12))] + [f"own {k} {len(own)}"] * int(rng.integers(0, 3))
        rows.append((k, "\n".join(own)))
    rows.append((120, "\n".join(["one line of ten words that stands again and again"] * 23)))  # overlaps with itself
    df = docs(spark, [t for _, t in rows])
    assert linechunks.dedup_lines(df).where("doc_id = 120").first()["removed_lines"] == 21  # its first chunk of two lines stays
    got = {r["doc_id"]: r for r in linechunks.dedup_lines(df, least_words=24).collect()}
    must = common_runs(rows, 50)
    stay = {x for r in got.values() for x in r["text"].split("\n")}
    assert len(must) > 300
    for d, t in rows:
        lines, left = t.split("\n"), got[d]["text"].split("\n") if got[d]["text"] else []
        assert got[d]["removed_lines"] == len(lines) - len(left) and stay >= set(lines)  # no line is lost from the table
        if d < 120:
            assert not any((d, k) in must and x in left for k, x in enumerate(lines) if lines.count(x) == 1)
    assert got[120]["removed_lines"] == 18  # the first five lines are the passage that stays


# -- 5 ---------------------------------------------------------------------------------------------------------------


def test_media(spark):
    texts = [None, "", "abc", "x" * 576, "y" * 577, "é" * 4000, "abc"]
    rows = {r["id"]: r for r in mpegaudio.probe(mpegaudio.to_media(docs(spark, texts))).collect()}
    for k, t in enumerate(texts):
        raw = (t or "").encode()
        whole = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        import hashlib

        assert rows[k]["n_bytes"] == len(raw) and rows[k]["payload_bytes"] == len(whole)
        assert rows[k]["payload_sha256"] == hashlib.sha256(whole).hexdigest() and rows[k]["tail_crc32"] == zlib.crc32(whole[-32:])
        assert rows[k]["samples"] == len(whole) and rows[k]["rate"] == 16000 and len(rows[k]["frame_offsets"]) == len(whole) // 576
    assert rows[2]["media_sha256"] == rows[6]["media_sha256"] and rows[0]["feature"] == rows[1]["feature"]


def test_media_damage():
    data = mpegaudio.write(mpegaudio.payload_of("q" * 5000)[0])
    whole = mpegaudio.read(data)
    assert whole.tags == {"TXXX": "payload\x005184"} and whole.table["frames"] == 9 and whole.seek(600) == whole.offsets[1]
    junk = mpegaudio.read(b"noise\xff\xfb" + data[:2000] + b"junk" + data[2000:] + b"TAG" + b"title".ljust(125, b"\0"))
    assert len(junk.offsets) >= 8 and junk.skipped >= 10 and junk.tags["title"] == "title"
    hurt = bytearray(data)
    hurt[whole.offsets[3] + 8] ^= 255
    assert (mpegaudio.read(bytes(hurt)).crc_bad, len(mpegaudio.read(bytes(hurt)).offsets)) == (1, 9)
    for bad in (None, b"", b"\xff", b"\xff\xf2\xd8", b"ID3", b"\xff" * 5000):
        assert mpegaudio.read(bad).payload == b""


def test_media_last_frame_that_looks_like_a_tag(spark):
    """ADVICE: byte 497 of the last frame's payload begins with TAG."""
    texts = ["x" * (576 * n + 448) + "TAG" + "y" * 125 for n in (0, 3)] + ["x" * k + "TAG" + "y" * (576 - 3 - k) for k in range(430, 520)]
    rows = mpegaudio.probe(mpegaudio.to_media(docs(spark, texts))).collect()
    assert all(r["payload_bytes"] == 576 * -(-len(t) // 576) for r, t in zip(sorted(rows, key=lambda r: r["id"]), texts, strict=True))


def test_media_tables(spark):
    long = "z" * 3_000_000
    df = docs(spark, [long, long, None]).withColumn("media", F.lit(1)).withColumn("n_bytes", F.lit("n"))
    rows = mpegaudio.probe(mpegaudio.to_media(df)).collect()
    assert rows[0]["payload_bytes"] == 576 * -(-len(long) // 576) and len({(r["media_sha256"], r["feature"]) for r in rows}) == 2
    assert rows[0]["duration"] == rows[0]["samples"] / 16000 and len(rows[0]["frame_offsets"]) == rows[0]["samples"] // 576
    assert mpegaudio.probe(mpegaudio.to_media(df.limit(0))).count() == 0


def plain_crc(bits):
    crc = 0xFFFF
    for bit in bits:
        top = crc >> 15
        crc = crc << 1 & 0xFFFF
        if top != int(bit):
            crc ^= 0x8005
    return crc


@pytest.mark.parametrize(
    ("head", "allocation", "chosen"),
    [
        # Layer I, 44.1 kHz, 128 kbit/s: stereo 256 bits; joint stereo from subband 4 on 144; mono 128
        ((0xFF, 0xFE, 0x40, 0x00), 256, 0), ((0xFF, 0xFE, 0x40, 0x40), 144, 0), ((0xFF, 0xFE, 0x40, 0xC0), 128, 0),
        # Layer II: 44.1 kHz 192 kbit/s stereo (96 a channel: 30 subbands), 128 (27), 32 kHz 48 mono (12), 48 kHz 32 mono (8), MPEG 2 (30)
        ((0xFF, 0xFC, 0xA0, 0x00), 2 * (44 + 36 + 14), 0), ((0xFF, 0xFC, 0x80, 0x00), 2 * (44 + 36 + 8), 0), ((0xFF, 0xFC, 0x28, 0xC0), 8 + 30, 0), ((0xFF, 0xFC, 0x14, 0xC0), 8 + 18, 0), ((0xFF, 0xF4, 0x84, 0xC0), 16 + 21 + 38, 0),
        # the same with six subbands allocated, whose scale factor choice has two bits each
        ((0xFF, 0xFC, 0xA0, 0x00), 2 * (44 + 36 + 14), 6), ((0xFF, 0xFC, 0x28, 0xC0), 8 + 30, 2),
    ],
)
def test_media_checksums_of_all_layers(head, allocation, chosen):
    h = mpegaudio.header(bytes(head))
    bits = ["0"] * allocation
    for k in range(chosen):
        bits[4 * k] = "1"  # subbands of four bits, one channel after the other
    covered = "".join(bits) + "10" * chosen
    sent = plain_crc(f"{head[2]:08b}{head[3]:08b}" + covered)
    body = int((covered + "0" * (-len(covered) % 8)) or "0", 2).to_bytes(-(-len(covered) // 8), "big")
    frame = (bytes(head) + sent.to_bytes(2, "big") + body).ljust(h.size, b"\0")
    s = mpegaudio.read(frame * 4)
    assert (s.crc_good, s.crc_bad, len(s.offsets), s.samples) == (4, 0, 4, 4 * h.samples)
    broken = bytearray(frame * 4)
    broken[h.size + 7] ^= 16
    assert mpegaudio.read(bytes(broken)).crc_bad == 1


def test_media_tags_and_delay():
    frames = mpegaudio.write(mpegaudio.payload_of("q" * 5000)[0])
    body = frames[mpegaudio._id3v2(frames, mpegaudio.Stream()) :]

    def tag(version, flags, content):
        return b"ID3" + bytes((version, 0, flags)) + mpegaudio._syncsafe(len(content)) + content

    text = b"\x00Title"
    v22 = tag(2, 0, b"TT2" + len(text).to_bytes(3, "big") + text)
    v23 = tag(3, 0x40, (6).to_bytes(4, "big") + bytes(6) + b"TIT2" + len(text).to_bytes(4, "big") + b"\0\0" + text)
    odd = b"\x01\xff\xfeT\0"
    unsync = tag(3, 0x80, b"TIT2" + len(odd).to_bytes(4, "big") + b"\0\0" + odd.replace(b"\xff", b"\xff\x00"))
    v24 = tag(4, 0x10, b"TIT2" + mpegaudio._syncsafe(len(text)) + b"\0\0" + text) + b"3DI" + bytes(7)
    for head, name, want in ((v22, "TT2", "Title"), (v23, "TIT2", "Title"), (unsync, "TIT2", "T"), (v24, "TIT2", "Title")):
        s = mpegaudio.read(head + body)
        assert s.tags[name] == want and len(s.offsets) == 9 and s.skipped == 0
    k = body.index(b"Info") + 8 + 8 + 100
    lame = body[:k] + b"LAME3.100" + bytes(12) + (576 << 12 | 1000).to_bytes(3, "big") + body[k + 24 :]
    s = mpegaudio.read(lame)
    assert (s.samples, s.played, s.table["delay"], s.table["padding"]) == (9 * 576, 9 * 576 - 1576, 576, 1000)


# -- 6 ---------------------------------------------------------------------------------------------------------------


def test_vectors(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((400, 32))
    near = base[:150] + 0.12 * rng.standard_normal((150, 32))
    tight = base[0] + 0.05 * rng.standard_normal((120, 32))
    rows = [(k, [float(np.float32(x)) for x in v]) for k, v in enumerate(np.concatenate((base, near, tight, base[5:8])))]
    n = len(rows)
    odd = [(n, None), (n + 1, [0.0] * 32), (n + 2, [float("nan")] * 32), (n + 3, [1.0, None] * 16), (n + 4, []), (n + 5, [1.0, 2.0]), (n + 6, [2.0, 4.0]), (n + 7, [float("inf")] + [0.0] * 31), (None, rows[0][1])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows + odd], "vec_id long, embedding array<float>, label int, rep string")
    got = {r["vec_id"]: r for r in capfilters.near_vectors(df, block=64).collect()}
    m = np.array([v for _, v in rows])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    link = m @ m.T >= 0.95
    np.fill_diagonal(link, False)
    want, found = int(link.sum()), sum(got[k]["n_links"] for k in range(n))
    assert found <= want and found >= 0.97 * want
    exact = [k for k in range(n) if got[k]["n_links"] == link[k].sum()]
    assert len(exact) >= 0.97 * n
    label = classes(range(n), [tuple(map(int, p)) for p in np.argwhere(link)])
    assert sum(got[k]["component_id"] == label[k] for k in range(n)) >= 0.97 * n
    for k in (0, 1, 2, 3, 4, 7):
        assert (got[n + k]["n_links"], got[n + k]["component_id"], got[n + k]["kept"]) == (0, n + k, True)
    assert got[n + 5]["n_links"] == got[n + 6]["n_links"] == 1 and got[n + 6]["component_id"] == n + 5 and not got[n + 6]["kept"]
    assert got[None]["n_links"] == 0 and got[None]["component_id"] is None
    assert capfilters.near_vectors(df.limit(0)).count() == 0


def test_sketches_keep_links():
    """Of pairs at the least cosine none is lost by its sketch, and of unrelated ones hardly any passes."""
    rng = np.random.default_rng(4)
    for dim in (8, 64, 300):
        a = rng.standard_normal((20_000, dim))
        a /= np.linalg.norm(a, axis=1, keepdims=True)
        b = rng.standard_normal(a.shape)
        b -= (a * b).sum(axis=1, keepdims=True) * a
        near = 0.95 * a + np.sqrt(1 - 0.95**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
        away = np.bitwise_count(capfilters.sketch(a) ^ capfilters.sketch(near)).sum(axis=1)
        assert away.max() <= capfilters.farthest(0.95) < 40
        other = np.bitwise_count(capfilters.sketch(a) ^ capfilters.sketch(a[::-1])).sum(axis=1)
        assert (other <= capfilters.farthest(0.95)).mean() < (0.1 if dim == 8 else 0.001)


def test_equal_vectors_by_value(spark):
    """Zero has one value, whatever its sign; a third of the rows being one vector is a group like any other."""
    rows = [(1, [1.0, 0.0]), (2, [1.0, -0.0]), (3, [0.0, 1.0]), *((k, [3.0, 4.0]) for k in range(10, 400))]
    got = {r["vec_id"]: r for r in capfilters.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    assert len(got) == 393 and (got[1]["n_links"], got[2]["n_links"], got[2]["component_id"], got[3]["n_links"]) == (1, 1, 1, 0)
    assert {(r["n_links"], r["component_id"], r["kept"]) for k, r in got.items() if k > 10} == {(389, 10, False)} and got[10]["kept"]


@pytest.mark.parametrize("n", [500, 50_000, 5_000_000])
def test_filter_recall(n):
    rng = np.random.default_rng(n)
    a = rng.standard_normal((300, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.standard_normal((300, 64))
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b = 0.952 * a + np.sqrt(1 - 0.952**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    words, z = capfilters.plan(n)
    sets = []
    for x in (a, b):
        own = [set() for _ in x]
        for t in range(capfilters.tables(n)):
            for r, f in zip(*map(np.ndarray.tolist, capfilters.decode(x, words, z, t)), strict=True):
                own[r].add(f)
        sets.append(own)
    assert np.mean([not p.isdisjoint(q) for p, q in zip(*sets, strict=True)]) >= 0.98


# -- 7 ---------------------------------------------------------------------------------------------------------------


def test_packing(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    texts = [None, "", "hello world", "<|endoftext|> é 検索 \u2003 \ud7ff", "a b " * 3000, "hello world", "  x\n\n" * 50]
    df = docs(spark, texts)
    rows = packing.pack(df).collect()
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for k, text in enumerate(texts):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        own = sorted((r for r in rows if r["id"] == k), key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own))) and sum(r["length"] for r in own) == len(ids)
        at = 0
        for r in own:
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert len(own) == -(-len(ids) // 1024) and all(r["length"] == 1024 for r in own[1:])
    check_sequences(rows)
    assert packing.pack(df.limit(0)).count() == 0
    check_sequences(packing.pack(df.union(df), with_ids=True).collect())


def test_packing_queries_encode_as_the_tokenizer(spark, tmp_path):
    """op7 and the pipeline's stage against a Tokenizer with its default settings, also where tiktoken fails."""
    import corpus_pipeline
    import public_tokenizers
    from tokenizers import Tokenizer

    texts = ["a<|endoftext|>b", "<|endoftext|><|endoftext|>", "x <|endoftext|> y" * 700, "<|endoftext| >", "x" + " " * 1_000_000 + "y", "<|endoftext|>\n" + "\n" * 1_000_000, None, "plain"]
    docs(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert t.encode(texts[0], add_special_tokens=False).ids == [64, 50256, 65]
    for df in (queries.QUERIES["op7_bin_slack"](spark, str(tmp_path)), corpus_pipeline.pack_sequences(spark, docs(spark, texts), str(tmp_path))):
        rows = df.collect()
        for k, text in enumerate(texts):
            ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
            own = sorted((r for r in rows if r["doc_id"] == k), key=lambda r: r["piece"])
            assert sum(r["length"] for r in own) == len(ids)
            assert all(r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) for r in own)
        check_sequences(rows)


def check_sequences(rows):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    return by


def test_packing_is_tight(spark, real):
    rows = packing.pack(real).collect()
    assert len(check_sequences(rows)) <= -(-sum(r["length"] for r in rows) // 1024) + 1


def test_packing_edges(spark):
    """Null ids, repeated rows, a very long text, clashing names: each row's pieces have places of their own."""
    long = "word and " * 40_000
    df = docs(spark, [long, "same", "same", None]).withColumn("doc_id", F.lit(None).cast("long")).withColumn("length", F.lit("l")).withColumn("rank", F.lit(1))
    rows = packing.pack(df).collect()
    check_sequences(rows)
    assert {r["id"] for r in rows} == {None} and sum(r["piece"] == 0 for r in rows) == 4
    assert sum(r["length"] for r in rows if r["length"] == 1024) == 1024 * (sum(r["length"] for r in rows) // 1024)


@pytest.mark.parametrize("seed", range(6))
def test_plans_place_every_piece(seed):
    """Whatever the slack, all pieces are placed, no bin is too full, and trying slacks never costs a bin."""
    import random

    r = random.Random(seed)
    counts = {n: r.randint(1, 60) for n in r.sample(range(1, 101), 25)}
    own = sum(t for _, t in packing.bins(counts, 100, (0,)))
    plan = packing.bins(counts, 100)
    placed = {}
    for combination, times in plan:
        assert sum(n * k for n, k in combination.items()) <= 100
        for n, k in combination.items():
            placed[n] = placed.get(n, 0) + k * times
    assert placed == counts and sum(t for _, t in plan) <= own
    for slack in (1, 5, 20):  # a slack leaves a bin short by that much at most, if the fullest combination fills it
        full, short = (sum(n * k for n, k in packing.fullest(counts, 100, s).items()) for s in (0, slack))
        assert short >= min(full, 100 - slack)


@pytest.mark.parametrize("seed", range(4))
def test_fullest_against_brute_force(seed):
    import itertools
    import random

    r = random.Random(seed)
    counts = {r.randint(1, 40): r.randint(1, 2) for _ in range(6)}
    items = [n for n, c in counts.items() for _ in range(c)]
    first = max(items)
    items.remove(first)
    best = max(s for k in range(len(items) + 1) for p in itertools.combinations(items, k) if (s := first + sum(p)) <= 50)
    got = packing.fullest(counts, 50)
    assert sum(n * k for n, k in got.items()) == best and all(k <= counts[n] for n, k in got.items())


# -- 8 ---------------------------------------------------------------------------------------------------------------


def test_language_accuracy(spark, real):
    rows = langid.identify(real.withColumn("ho", langid.held_out()), langid.train(real)).collect()
    own = [r for r in rows if r["ho"] and r["lang"]]
    assert own and np.mean([r["lang_pred"] == r["lang"] for r in own]) >= 0.97
    assert {r["doc_id"] for r in own} == {r["doc_id"] for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0}


def test_language_edges(spark, real):
    profiles = langid.train(real)
    df = docs(spark, [None, "", "12 34 !?", "the thing and the other", "x" * 300000]).withColumn("score", F.lit("s"))
    got = {r["doc_id"]: r for r in langid.identify(df, profiles).collect()}
    assert [got[k]["lang_pred"] for k in range(3)] == ["und"] * 3 and got[3]["lang_pred"] == "en" and 0 <= got[4]["score"] <= 1
    assert langid.train(df.limit(0)) == {} and langid.identify(df, {}).where("lang_pred <> 'und'").count() == 0


def naive_profile(text, most):
    """The most frequent letters, pairs and triples of the words of a text, as strings; words are padded with a blank."""
    import re
    from collections import Counter

    found = Counter()
    for word in re.findall(r"(?:[^\W\d_]|[\u0300-\u036f])+", text.lower()):
        padded = f" {word} "
        found.update(word)
        found.update(padded[k : k + 2] for k in range(len(padded) - 1))
        found.update(padded[k : k + 3] for k in range(len(padded) - 2))

    def code(gram):
        n = 0
        for c in gram:
            n = n << 21 | (0 if c == " " else ord(c))
        return n | 1 << 62 if len(gram) == 2 else n

    return sorted(found, key=lambda g: (-found[g], code(g)))[:most], code


@pytest.mark.parametrize("most", [5, 40, 400])
def test_out_of_place_distance(most):
    """Predictions against distances computed from the definition over strings."""
    learnt = {"aa": "the cat and the dog sat on the mat", "bb": "der hund und die katze saßen auf der matte", "cc": "zzz"}
    profiles = {k: naive_profile(v, most) for k, v in learnt.items()}
    model = langid.Profiles({k: [code(g) for g in grams] for k, (grams, code) in profiles.items()}, most)
    for text in ("The dog!", "die katze und der hund", "z", "qqq www", "é\u0301 le chat", "a1b 2c"):
        grams, _ = naive_profile(text, most)
        away = {k: sum(min(abs(n - own.index(g)), most) if g in own else most for n, g in enumerate(grams)) for k, (own, _) in profiles.items()}
        best = min(away, key=lambda k: (away[k], k))  # a tie: the first by code point
        lang, score = model.predict(text)
        assert lang == best and score == pytest.approx(1 - away[best] / (most * len(grams)))


def test_language_marks_ties_and_slices(spark, monkeypatch):
    model = langid.Profiles({"b": [98], "a": [97]}, 10)
    assert model.predict("\u0301 \u0301\u0302 12") == ("und", 0.0)  # marks are no letters
    assert langid.Profiles({"a": [97], "b": [97]}, 10).predict("aa")[0] == "a"
    text = "the quick brown fox " * 400
    whole = [x.tolist() for x in langid.ngrams(text)]
    monkeypatch.setattr(langid, "SLICE", 100)
    assert [x.tolist() for x in langid.ngrams(text)] == whole
    assert langid.identify(docs(spark, ["a"]).limit(0), {"a": [97]}).count() == 0


# -- 9 ---------------------------------------------------------------------------------------------------------------


def test_targets():
    assert mixing.targets({"a": 60, "b": 60, None: 60}) == {"a": 30, "b": 60, None: 90}
    got = mixing.targets({"a": 100, "b": 1, "c": 1})
    assert got["b"] == 3 and got["c"] == 3 and got["a"] == 96
    assert mixing.targets({"a": 0}) == {"a": 0} and mixing.targets({}) == {}


def test_mix_edges(spark):
    """A very long text, nulls in every column, equal sources and clashing names."""
    rows = [(1, "w " * 300_000, "a", 1), (2, "w", "b", 2), (None, None, None, None), (2, "w", "b", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, mix_copies int")
    got = mixing.mix(df).collect()
    assert len(got) == 4 and sum(r["mix_size"] for r in got) == 300_002
    assert len({(r["mix_copies"], r["mix_target"]) for r in got if r["doc_id"] == 2}) == 1
    kept = mixing.mix(df, prefix="other_").collect()
    assert sorted(str(r["mix_copies"]) for r in kept) == ["1", "2", "2", "None"]


def test_mix(spark):
    rows = [(k, " ".join(["w"] * (k % 7)), [None, "b", "a"][k % 3], "e") for k in range(900)] + [(5, "w w", "a", "e"), (None, "w", "b", "e"), (7, None, "z", "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, mix_target string")
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        assert 0 <= r["mix_copies"] <= 3
        t = by.setdefault(r["source"], [0, r["mix_target"], 0])
        t[0] += r["mix_size"] * r["mix_copies"]
        t[2] += r["mix_size"]
    total = sum(t[2] for t in by.values())
    assert abs(sum(t[1] for t in by.values()) - total) < 1e-6
    assert all(abs(t[0] - t[1]) <= 6 for t in by.values())
    again = mixing.mix(df.repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert mixing.mix(df.limit(0)).count() == 0


# -- 10 --------------------------------------------------------------------------------------------------------------


def test_fingerprint():
    import xxhash

    words = "The quick brown fox jumps Über the lazy dog\tand more".split()
    low = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in words]
    h = [xxhash.xxh64_intdigest(" ".join(low[k : k + 3]).encode(), 42) for k in range(len(low) - 2)]
    want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    assert simhash.fingerprint("  ".join(words)) == want
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0
    assert simhash.fingerprint("One Two") == xxhash.xxh64_intdigest(b"one two", 42)


def test_long_texts_are_hashed_in_slices(monkeypatch):
    text = " ".join(f"w{k % 977}" for k in range(5000))
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "SHINGLES", 64)
    assert simhash.fingerprint(text) == whole


def test_count_filter_and_splits(spark):
    """The index proposes pairs that share three bytes; those with fewer than five in all are rejected by the tally."""
    rng = np.random.default_rng(8)
    base = rng.integers(0, 2**64, 300, dtype=np.uint64)
    near = base[:60] ^ np.uint64(1 << 5) ^ np.uint64(1 << 40) ^ np.uint64(1 << 63)
    far = base[:60] ^ np.uint64(0x0101010100000000)  # four bits in four bytes
    dense = np.uint64(0x1234567890000000) | rng.choice(1 << 28, 400, replace=False).astype(np.uint64)
    one = np.uint64(0xABCDEF0000000000) ^ (np.uint64(1) << np.arange(40, dtype=np.uint64))
    prints = np.unique(np.concatenate((base, near, far, dense, one)))
    df = spark.createDataFrame([(int(x),) for x in prints.view(np.int64)], "fp long")
    lists = {}
    for r in simhash.postings(df).collect():
        lists.setdefault(r["key"], []).append(r["fp"])
    proposed = {(min(a, b), max(a, b)) for own in lists.values() for k, a in enumerate(own) for b in own[:k]}
    pairs = np.array(sorted(proposed), np.int64).view(np.uint64)
    shared = np.array([simhash.tally(p[:1], p[1:])[0, 0] for p in pairs])
    bits = np.array([int(p[0] ^ p[1]).bit_count() for p in pairs])
    assert (shared < 5).any() and shared.min() >= 3  # the count filter decides something
    assert ((shared >= 5) & (bits > 3)).any()  # and so does the verification
    x = prints[:, None] ^ prints[None, :]
    linked = [(int(prints.view(np.int64)[a]), int(prints.view(np.int64)[b])) for a, b in np.argwhere(np.bitwise_count(x) <= 3) if a < b]
    assert {(min(p), max(p)) for p in linked} <= proposed
    want = classes([int(v) for v in prints.view(np.int64)], linked)
    for block in (1024, 32):  # with 32, lists of three bytes are split by two more, and those of five into blocks
        written = simhash.materialize(df)
        got = {r["fp"]: r["root"] for r in simhash._groups(written, 3, block).collect()}
        assert got == want


def test_simhash_rows_that_share_an_id(spark):
    a, b = " ".join(f"a{k}" for k in range(50)), " ".join(f"b{k}" for k in range(50))
    df = spark.createDataFrame([(5, a), (5, b), (7, b), (7, b), (None, "x y z w"), (None, "x y z w")], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in simhash.simhash_groups(df).collect())
    assert got == [(0, 0), (0, 0), (5, 5), (5, 5), (7, 5), (7, 5)]
    kept = sorted((r["id"] or 0, r["copies"]) for r in simhash.representatives(df).collect())
    assert kept == [(0, 2), (5, 1), (5, 1)]


def test_simhash_groups(spark):
    rng = np.random.default_rng(2)
    base = [" ".join(f"w{x}" for x in rng.integers(0, 5000, 120)) for _ in range(60)]
    texts = base + base[:10] * 4 + [b + " tail" for b in base[10:30]] + [" ".join([*base[40].split()[:k], "odd", *base[40].split()[k:]]) for k in range(3, 117)] + [None, "", " "]
    got = {r["doc_id"]: r["component_id"] for r in simhash.simhash_groups(docs(spark, texts), block=16).collect()}
    f = [simhash.fingerprint(t) for t in texts]
    assert got == classes(range(len(f)), [(a, b) for a in range(len(f)) for b in range(a) if (f[a] ^ f[b]).bit_count() <= 3])
    assert simhash.simhash_groups(docs(spark, texts).limit(0)).count() == 0
    null = simhash.simhash_groups(docs(spark, texts[:3]).withColumn("doc_id", F.lit(None).cast("long"))).collect()
    assert [r["component_id"] for r in null] == [None] * 3


# -- pipeline --------------------------------------------------------------------------------------------------------


def test_pipeline_edges(spark, tmp_path):
    """An empty table, nulls in every column, repeated rows and ids, extra columns with the names that stages use."""
    import corpus_pipeline as p

    schema = "doc_id long, text string, lang string, source string, n_chars long, removed_lines int, mix_size string, lang_pred string, _copy int, row string"
    body = "\n".join(f"line {k} of the text with some words in it" for k in range(20))
    other = " ".join(f"other{k}" for k in range(90))
    rows = [(1, body, "en", "s", 5, 1, "m", "l", 2, "r"), (2, other, "en", None, 5, 1, "m", "l", 2, "r"), (2, other, "en", None, 5, 1, "m", "l", 2, "r"), (2, "and this text shares an id, no more", None, "s", None, None, None, None, None, None)]
    rows += [(None, None, None, None, None, None, None, None, None, None), (None, "no id but words", "en", "t", 4, 1, "m", "l", 2, "r"), (3, "", "en", "s", 0, 1, "m", "l", 2, "r"), (4, "12 34", "en", "s", 0, 1, "m", "l", 2, "r")]
    df = spark.createDataFrame(rows, schema)
    for at, name in ((df, "some"), (df.limit(0), "none")):
        own = str(tmp_path / name)
        at.write.parquet(f"{own}/documents.parquet")
        for name_, stage in p.STAGES[:-1]:
            at = spark.createDataFrame(stage(spark, at, own).collect(), at.schema)
            assert at.columns == df.columns, name_
            if name_ == "simhash_near_dedup" and name == "some":
                assert sorted((r["doc_id"] or 0, r["text"][:5], r["removed_lines"]) for r in at.collect()) == [(0, "no id", 1), (1, "line ", 1), (2, "and t", None), (2, "other", 1)]
        out = p.run(spark, own)
        assert (out.count() > 0) == (name == "some")
        check_sequences(out.collect())


def test_pipeline_leaves_no_tables(spark):
    import corpus_pipeline as p
    from corviq.llm import common

    before = set(common._WRITTEN)
    out = p.run(spark, DATA)
    assert set(common._WRITTEN) - before == {out._corviq_path}


def test_pipeline(spark, real):
    import corpus_pipeline as p

    at = real
    sizes = []
    for name, stage in p.STAGES[:-1]:
        after = stage(spark, at, DATA)
        assert after.columns == real.columns, name
        rows = after.collect()
        before = {r["doc_id"]: r["text"] for r in at.collect()}
        ids = [r["doc_id"] for r in rows]
        if name == "language_id":
            assert set(ids) == {d for d, t in before.items() if t and any(c.isalpha() for c in t)}
        elif name == "line_dedup":
            want = {d: t for d, t in brute_lines(list(before.items())).items() if t == before[d] or t.strip()}
            assert {r["doc_id"]: r["text"] for r in rows} == want
        elif name == "simhash_near_dedup":
            f = {d: simhash.fingerprint(t) for d, t in before.items()}
            label = classes(sorted(f), [(a, b) for a in f for b in f if a < b and (f[a] ^ f[b]).bit_count() <= 3])
            assert sorted(ids) == sorted(set(label.values()))
        else:
            assert max(ids.count(d) for d in set(ids)) <= 3
        sizes.append(len(rows))
        at = spark.createDataFrame(rows, real.schema)
    check_sequences([r.asDict() for r in p.STAGES[-1][1](spark, at, DATA).collect()])
    assert sizes[0] > 0
