"""Language, quality, decontamination, mixing, audit and page text on small tables."""

import random

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import decontaminate as D
from tidemark.llm import html_text as H
from tidemark.llm import language_id as G
from tidemark.llm import line_quality as Q
from tidemark.llm import mixing as M
from tidemark.llm import oracle, warc_audit
from tidemark.llm.words import words_of

SF = "/root/testdata/sf0.01"


def sql_rows(statement, **tables):
    con = duckdb.connect()
    for name, rows in tables.items():
        con.register(name, rows.toArrow())
    return con.sql(statement).arrow().read_all().to_pandas(types_mapper=pd.ArrowDtype)


def same(spark_rows, sql):
    """Equal rows whatever their order, doubles to nine digits."""
    left = spark_rows.toArrow().to_pandas(types_mapper=pd.ArrowDtype)
    assert sorted(left.columns) == sorted(sql.columns)
    columns = sorted(left.columns)

    def plain(v):
        if v is pd.NA or v is None or v != v:
            return "null"
        return f"{v:.9g}" if isinstance(v, float) else str(int(v)) if isinstance(v, (int, np.integer, np.bool_)) else str(v)

    both = [sorted(tuple(plain(v) for v in r) for r in df[columns].itertuples(index=False)) for df in (left, sql)]
    assert both[0] == both[1]


# Language identification


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    return docs, G.fit(docs)


def test_held_out_accuracy(model):
    docs, fitted = model
    found = G.identify(docs, fitted).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null")
    right = found.where("lang = lang_pred").count()
    assert right >= 0.98 * found.count() > 2000


def test_languages_of_odd_rows(spark, model):
    _, fitted = model
    rows = [(None, None), (1, ""), (2, "12 ... 34"), (3, "the and of this"), (3, "the and of this"), (4, "日本語"), (5, "Ä")]
    docs = spark.createDataFrame([(*r, "zz", 0.5) for r in rows], "doc_id long, text string, lang string, score double")
    got = sorted(map(tuple, G.identify(docs, fitted).select("doc_id", "lang_pred").collect()), key=repr)
    assert [p for i, p in got if i in (None, 1, 2)] == ["und"] * 3 and (3, "en") in got and len(got) == 7
    assert all(0 <= r.score <= 1 for r in G.identify(docs, fitted).collect())
    kept = G.in_known_language(docs, fitted)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= {3}
    assert {r.doc_id for r in kept.collect()} <= {3, 5}
    assert G.identify(docs.limit(0), fitted).count() == 0
    nothing = G.fit(docs.limit(0))
    assert {r.lang_pred for r in G.identify(docs, nothing).collect()} == {"und"}


def test_scores_follow_the_kernel(model):
    """The folded product equals presence rows times weights, one by one."""
    _, fitted = model
    spectrum = G.Spectrum(fitted.letters)
    text = "Thing and that were der die und"
    codes = set(spectrum.mark(text).tolist())
    row = np.array([c in codes for c in fitted.codes.tolist()]) / np.sqrt(len(codes))
    names, scores = G.Scorer(fitted)(pa.array([text]))
    plain = row @ fitted.weights + fitted.offset
    held = np.isin(list(codes), fitted.codes).mean()
    assert names == [fitted.languages[plain.argmax()]] and abs(scores[0] - plain.max().clip(0, 1) * held) < 1e-4


def test_sequences_of_a_text_are_each_marked_once(model):
    _, fitted = model
    spectrum = G.Spectrum(fitted.letters)
    for text in ["", "a", "ab", " ab ", "a b", "aaa", "abcab cab", "1 2", "the 日本 end"]:
        c = [0, *spectrum.classes[[ord(x) for x in text]].tolist(), 0]
        c = [x for i, x in enumerate(c) if i == 0 or x or c[i - 1]]
        want = {n - 1 << 3 * G.BITS | sum(x << G.BITS * (n - 1 - k) for k, x in enumerate(c[i:i + n]))
                for n in (1, 2, 3) for i in range(len(c) - n + 1)}
        assert spectrum.mark(text).tolist() == sorted(want)


def test_scores_do_not_depend_on_the_block(model, monkeypatch):
    """Blocks of one text, and a very long text among short ones."""
    docs, fitted = model
    texts = pa.array([r.text for r in docs.limit(300).collect()] + [None, "", "x " * 300_000, "the and " * 400_000])
    names, scores = G.Scorer(fitted)(texts)
    monkeypatch.setattr(G, "BLOCK_CELLS", 1)
    alone = G.Scorer(fitted)(texts)
    assert names == alone[0] and np.allclose(scores, alone[1]) and names[-1] == "en"


def test_a_label_of_few_usable_rows_is_learned(spark):
    """10 of 50,000 rows of a label have letters and ids; thousands of another have both."""
    rows = spark.range(50_000).selectExpr(
        "id as doc_id", "if(id % 5000 = 0, 'zyx wvu zyxw uvw vuzy', if(id % 3 = 0, null, '12 34')) as text", "'rare' as lang")
    common = spark.range(3000).selectExpr("id + 100000 as doc_id", "concat('abc bca cab ', id) as text", "'common' as lang")
    docs = rows.union(common)
    usable = rows.where("text like 'z%' and crc32(cast(doc_id as string)) % 4 != 2").count()
    sample = G.training_sample(docs, 300, "doc_id", "text", "lang").groupBy("lang").count()
    assert {tuple(r) for r in sample.collect()} == {("rare", usable), ("common", 300)} and usable > 0
    assert set(G.fit(docs).languages) == {"rare", "common"}


def test_languages_in_several_scripts(spark):
    """Every letter is learned, of small alphabets beside one of thousands."""
    rng = random.Random(11)
    alphabets = {"la": range(97, 123), "cy": range(0x430, 0x450), "el": range(0x3B1, 0x3CA), "ar": range(0x628, 0x64B),
                 "ka": range(0x10D0, 0x10F1), "zh": range(0x4E00, 0x5600), "ko": range(0xAC00, 0xB400)}
    rows, n = [], 0
    for lang, letters in alphabets.items():
        size = (1, 2) if len(letters) > 100 else (2, 7)
        words = ["".join(chr(rng.choice(letters)) for _ in range(rng.randint(*size))) for _ in range(1500)]
        for _ in range(120):
            n += 1
            rows.append((n, " ".join(words[min(int(rng.expovariate(1 / 200)), 1499)] for _ in range(120)), lang))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(8)
    fitted = G.fit(docs)
    assert {ord(c) for _, text, _ in rows[:400] for c in text if c.isalpha()} <= set(fitted.letters)
    got = G.identify(docs, fitted).join(docs, "doc_id").collect()
    assert len(got) == len(rows) and all(r.lang_pred == r.lang and r.score > 0.3 for r in got)
    assert G.in_known_language(docs, fitted).count() == len(rows)


# Quality


def base_counts(text):
    words = (text or "").encode().split()
    lines = [x for x in (text or "").encode().split(b"\n") if x.split()]
    runs = {}
    for i in range(len(words) - 7):
        runs.setdefault(tuple(words[i:i + 8]), []).append(i)
    covered = {i + k for starts in runs.values() if len(starts) > 1 for i in starts for k in range(8)}
    return (len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text or ""),
            len(lines) - len(set(lines)), len(covered))


def test_base_counts_match_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = [(None, None), (-1, ""), (-2, "\n\n"), (-3, "a b c d e f g h " * 9), (-4, "x\nx\n x\nx \n\x0bx\x1cy"), (-5, "é|ß"),
           (-6, "Aa Bb Cc Dd Ee Ff Gg Hh x aa bb cc dd ee ff gg hh x Aa Bb Cc Dd Ee Ff Gg Hh")]
    docs = docs.select("doc_id", "text").union(spark.createDataFrame(odd, "doc_id long, text string"))
    field = Q.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = Q.judge_lines(docs.selectExpr("doc_id", "text", "1 as n_words"), field).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(rows) == len(texts)
    for r in rows:
        n, *_ , repeat = counts = base_counts(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts, r.doc_id
        assert r.base_failed == (n < 20 or 100 * repeat > 30 * n)
        assert not (r.kept and r.base_failed)


def test_verdict_agrees_with_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    out = Q.judge_lines(docs, Q.fit(docs, labels)).join(labels, "doc_id").where("not base_failed")
    rows = out.groupBy("quality", "kept").count().collect()
    count = {(r.quality, r.kept): r["count"] for r in rows}
    assert count.get((1, False), 0) <= 0.005 * count[1, True] and count.get((0, True), 0) <= 0.1 * count[0, False]


def test_viterbi_matches_enumeration():
    rng = np.random.default_rng(0)
    text = [b"One line here.\nSecond ### line\n\n|| x\nSecond ### line", b"", b"single", b"a\nb\nc"]
    words = words_of(pa.array(text, pa.binary()))
    lines, _ = Q.lines_of(words)
    for _ in range(20):
        field = Q.Field(rng.normal(size=(len(Q.FEATURES), 2)), rng.normal(size=(2, 2)))
        got = Q.decode(field, lines)
        score = lines.features @ field.emit
        for i in range(len(text)):
            a, b = lines.first[i], lines.first[i + 1]
            paths = [[(n >> k) & 1 for k in range(b - a)] for n in range(2 ** (b - a))]
            value = [sum(score[a + k, y] for k, y in enumerate(p)) + sum(field.step[x, y] for x, y in zip(p, p[1:], strict=False))
                     for p in paths]
            assert list(got[a:b]) == paths[int(np.argmax(value))]


def test_training_gradient_separates_and_needs_both_labels():
    good, poor = np.zeros((4, len(Q.FEATURES))), np.zeros((4, len(Q.FEATURES)))
    good[:, 0] = poor[:, 0] = 1
    poor[:, 1] = 0.5
    field = Q.train([good, poor], [0, 1])
    lines = Q.Lines(np.concatenate([good, poor]), np.ones(8), np.array([0, 4, 8]))
    assert Q.decode(field, lines).tolist() == [0] * 4 + [1] * 4
    assert not Q.decode(Q.train([good], [0]), lines).any()


# Decontamination


def test_containment_matches_sql(spark):
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    found = D.contained_items(docs, items)
    assert found.count() > 5
    same(found, sql_rows(oracle.CONTAINMENT, documents=docs, benchmark=items))


def test_containment_random_and_blocks(spark):
    rng = random.Random(8)
    vocabulary = [f"v{n}" for n in range(60)]
    items = [(n, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(3, 30)))) for n in range(60)]
    rows = []
    for n in range(300):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 200))]
        part = rng.choice(items)[1].split()
        part = [w if rng.random() > 0.04 else "zz" for w in part]
        at = rng.randint(0, len(words))
        rows.append((n, ", ".join([*words[:at], *(w.upper() for w in part), *words[at:]])))
    items += [(900, None), (901, ""), (None, items[0][1]), (902, "too short a one")]
    docs = spark.createDataFrame([*rows, (1000, None), (1001, "")], "doc_id long, text string")
    table = spark.createDataFrame(items, "item_id long, text string")
    sql = sql_rows(oracle.CONTAINMENT,
                   documents=docs, benchmark=table.where("item_id is not null"))
    for block_bytes in (D.BLOCK_BYTES, 2000):
        found = D.contained_items(docs, table, block_bytes=block_bytes).where("item_id is not null")
        same(found, sql)
        clean = D.without_items(docs, table, block_bytes=block_bytes)
        assert clean.columns == docs.columns
        assert {r.doc_id for r in clean.collect()} == (set(range(300)) | {1000, 1001}) - set(sql.doc_id)
    assert D.contained_items(docs, table.limit(0)).count() == D.contained_items(docs.limit(0), table).count() == 0


# Mixing


def test_mixing_matches_sql(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    same(M.mix_sources(docs), sql_rows(oracle.mixing(), documents=docs))


def test_mixing_odd_rows_and_margins(spark):
    rows = [(n, "w " * (n % 300 + 1), f"s{n % 3}" if n % 7 else None, "ab"[n % 2]) for n in range(400)]
    rows += [(1000, None, "s1", "a"), (1001, "", "only empty", None), (None, "x y", "s2", "b"), (5, "w " * 6, "s2", "b")]
    docs = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, source string, lang string, probability double")
    out = M.mix_sources(docs)
    same(out, sql_rows(oracle.mixing(), documents=docs))
    got = out.collect()
    assert len(got) == len(rows) and all(0 <= r.probability <= 1 for r in got)
    assert [r.probability for r in got if r.doc_id == 1001] == [0.0]
    raked = M.rake(out.groupBy("source", "lang", "topic").agg({"n_tokens": "sum"}).withColumnRenamed("sum(n_tokens)", "n"), 12)
    total = {r.lang: r["sum(weight)"] for r in raked.groupBy("lang").sum("weight").collect()}
    goal = {r.lang: float(r["sum(n)"]) ** M.POWERS["lang"] for r in raked.groupBy("lang").sum("n").collect()}
    for lang, w in total.items():
        assert abs(w - goal[lang] / sum(goal.values())) < 5e-3
    sampled = M.sample_mix(docs)
    assert {r.doc_id for r in sampled.collect()} == {r.doc_id for r in got if r.sampled}
    assert M.mix_sources(docs.limit(0)).count() == 0


# Audit


def test_audit_matches_sql(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html")
    odd = spark.createDataFrame([(None, None, None), (93, "u", ""), (93, "u", ""), (7, None, "é")], pages.schema)
    pages = pages.union(odd).repartition(3)
    columns = [pages[c] for c in ("page_id", "url", "html")]
    replicas = {"a": warc_audit.warc_record(*columns[1:]), "b": warc_audit.damaged(*columns)}
    records = warc_audit.manifest(pages, replicas, "page_id", "url")
    found = warc_audit.audit(records, "a", "b")
    shown = found.select("page_id", "url", "kind", "size_a", "size_b", "sha256_a", "sha256_b")
    assert shown.count() > 1
    same(shown, sql_rows(oracle.FIXITY, pages=pages))
    assert warc_audit.audit(records, "a", "a").count() == 0
    turned = {(r.page_id, r.kind) for r in warc_audit.audit(records, "b", "a").collect()}
    assert {k for _, k in turned} <= {"extra", "resized", "altered"}
    empty = warc_audit.manifest(pages.limit(0), replicas, "page_id", "url")
    assert warc_audit.audit(empty, "a", "b").count() == 0


def test_audit_offsets_and_many_files(spark, monkeypatch):
    monkeypatch.setattr(warc_audit, "BITS", 1)
    monkeypatch.setattr(warc_audit, "FILE_BITS", 2)
    rows = spark.createDataFrame([(n, "x" * (n % 5)) for n in range(50)], "n long, t string").repartition(4)
    replicas = {"a": rows.t, "b": F.when(rows.n != 13, rows.t)}
    records = warc_audit.manifest(rows, replicas, "n")
    found = warc_audit.audit(records, "a", "b").collect()
    assert [(r.n, r.kind, r.end - r.offset) for r in found] == [(13, "missing", 3)]
    before = [r for r in records.collect() if r.file == found[0].file and r.ordinal < found[0].ordinal]
    assert found[0].offset == sum(r.size_a for r in before)


# Page text

SITE = ('<html><head><title>T</title><script>var a="</p>";</script></head><body><div class="x"><ul><li><a href="/1">Home</a></li>'
        '<li>About</li></ul></div><header><h2>Site</h2></header>{main}<div class="y">All pages say this.</div>'
        '<footer>&copy; 2020</footer></body></html>')


def page_text(html, template=()):
    tree = H.parse(html)
    H.hash_subtrees(tree)
    return H.main_text(tree, set(template))


@pytest.mark.parametrize("html,text", [
    ("<article><h1>A &amp;  b</h1><p>One\n two<br>three<p>Four</article>", "A & b\nOne two three\nFour"),
    ("<nav>x</nav><article><p>a<b>b</b>c</p><aside>no</aside><form>q</form>d</article><p>out", "abc\nd"),
    ("<main><div class='cookie-notice'>no</div><p>yes</p><section id=comments>no</section></main>", "yes"),
    ("<body><div id='sideBar'>no</div><p>one &lt;b&gt; &#233;&#xe9;</p><!-- no --><style>no</style>two", "one <b> éé\ntwo"),
    ("<article><p>cut off <b>here", "cut off here"), ("<article><p>cut <a hr", "cut"), ("", ""), ("plain  text", "plain text"),
    ("<article><p>1 < 2 and 3 > 2</p></article>", "1 < 2 and 3 > 2"), ("<article><p hidden>no</p><p>&nbsp;a&nbsp;</p></article>", "a"),
    ("<p><b>x.<br><p>y</p>", "x.\ny"), ("<article><ul><li>a<li>b</ul><table><tr><td>c<td>d</table></article>", "a\nb\nc\nd"),
    ("<article><div class='adventure'>yes</div><div class='ad'>no</div></article>", "yes"),
    ("<p>One <a title=it's href=x>link</a> two.</p>", "One link two."),
    ("<article><p class='share-price'>a</p><div class='related-work'>b</div><p id=search>c</p>"
     "<div class='related-posts'>no</div><div class='more related'>by <a>links only, no</a></div></article>", "a\nb\nc"),
    ("<body><form id=x><h1>T</h1><p>All of the page</p><input><button>no</button></form></body>", "T\nAll of the page"),
    ("<article><p>A story</p><article class=comment>no</article></article><article class='comment'>no</article>", "A story"),
    ("<main><p>A long story</p></main><article class='teaser'>no</article>", "A long story"),
    ("<main><p>A long story</p></main><article>short</article>", "A long story"),
    ("<article>a<svg/>b<math/>c<math><mi>x</mi></math><svg><title>no</title><path/></svg>d<p>e</article>", "abcxd\ne"),
    ("<article><a href='x'><div>t</a>u</div>v</article>w", "tu\nv"), ("<article><!-- > -->a<!-->b<!--x--!>c</article>", "abc"),
    ("a <div hidden>no</div><div class='x hidden'>y</div>", "a\ny"), ("<article><p title='cut>off", "off"),
])
def test_main_text(html, text):
    assert page_text(html) == text


@pytest.mark.parametrize("piece", ['<a "', "<a>", "<b></i>", "<div><b>", "<a x='", "<!-- -->", "<form>", "<p>", "<svg><p>", "<"])
def test_time_is_linear_in_a_page(piece):
    from time import process_time
    took = []
    for size in (50_000, 400_000):
        before = process_time()
        page_text(piece * (size // len(piece)))
        took.append(process_time() - before)
    assert took[1] < 30 * took[0] + 0.5


def test_templates_without_tags_or_names_to_go_by(spark):
    """Menus, notices and rotating adverts of bare elements go; copied articles and passages stay."""
    menu, offers = "<div><p>Home</p><p>About</p></div>", ["<p>Buy one.</p>", "<p>Buy two.</p>"]
    passage = "<p>A passage that several articles quote.</p>"
    bodies = {n: f"<p>Own text {n}.</p>" + passage * (n % 5 == 0) + f"<p>Own end {n}.</p>" for n in range(40)}
    bodies |= {n: "<p>A copied article.</p><p>Its end.</p>" for n in (3, 13, 23, 33)}
    rows = [(n, f"https://bare.example/{n}", f"<body>{menu}<div>{bodies[n]}</div><div>{offers[n % 2]}</div></body>") for n in bodies]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in H.extract_text(pages).collect()}
    assert got == {n: page_text(bodies[n]) for n in bodies}
    assert all(page_text(r[2]) != got[r[0]] for r in rows)


def test_templates_go_and_prose_stays(spark):
    shared = "<p>This passage stands in every article of the site.</p>"
    rows = []
    for n in range(8):
        body = f"<p>Own text number {n} of the site.</p>{shared}"
        main = f"<article>{body}<div class='z'><a href='/s'>More</a></div></article>" if n % 2 else f"<div id='m'>{body}</div>"
        rows.append((n, f"https://Host.example:80/p{n}", SITE.format(main=main)))
    rows += [(90, "https://other.example/", SITE.format(main="<p>Alone.</p>")), (91, None, None), (None, "x", "")]
    rows += [(92, "https://third.example/one", SITE.format(main="<p>Same page.</p>"))] * 5
    pages = spark.createDataFrame([(*r, "k") for r in rows], "page_id long, url string, html string, text string")
    got = {}
    for r in H.extract_text(pages).collect():
        got.setdefault(r.page_id, []).append(r.text)
        assert r.n_chars == len(r.text)
    passage = "This passage stands in every article of the site."
    for n in range(8):
        own = f"Own text number {n} of the site."
        assert got[n] == [f"{own}\n{passage}"] if n % 2 else got[n] == [own]
    assert got[91] == got[None] == [""] and "Alone." in got[90][0]
    assert len(got[92]) == 5 and "Same page." in got[92][0]
    assert H.extract_text(pages.limit(0)).count() == 0


@pytest.mark.parametrize("broadcast", [True, False])
def test_a_block_of_one_section_of_a_large_host_goes(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(H, "BROADCAST_HASHES", 0)
    rows = [(n, f"https://big.example/{n}", f"<body><div><p>Own text {n}.</p></div>"
             + "<div class='z'>Offer of this section.</div>" * (n < 4) + "<div class='y'>On two.</div>" * (n in (7, 8))
             + "<div class='x'>On every page.</div></body>") for n in range(200)]
    rows += [(300, "https://small.example/", "<body><p>Own text 300.</p><div class='z'>Offer of this section.</div></body>"),
             (301, "https://big.example/0", rows[0][2]), (302, "https://big.example/e", None), (None, None, "")]
    rows += [(400 + n, f"https://big.example/copy{n}", "<body><div><p>One page of many URLs.</p></div></body>") for n in range(4)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in H.extract_text(pages).collect()}
    assert {got[400 + n] for n in range(4)} == {"One page of many URLs."}
    assert len(got) == len(rows) and got[300] == "Own text 300.\nOffer of this section." and got[301] == got[0]
    assert got[302] == got[None] == ""
    for n in range(200):
        assert got[n] == f"Own text {n}." + "\nOn two." * (n in (7, 8))


def test_test_pages_against_a_plain_parser(spark):
    """Blocks of the article by the standard library's parser."""
    from html.parser import HTMLParser

    class Plain(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.inside, self.blocks = False, [""]

        def handle_starttag(self, tag, attrs):
            self.inside |= tag == "article"
            if tag in ("p", "h1"):
                self.blocks.append("")
            elif tag == "br":
                self.blocks[-1] += " "

        def handle_endtag(self, tag):
            self.inside &= tag != "article"
            if tag in ("p", "h1"):
                self.blocks.append("")

        def handle_data(self, data):
            if self.inside:
                self.blocks[-1] += data

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r.text for r in H.extract_text(pages).collect()}
    for r in pages.collect():
        plain = Plain()
        plain.feed(r.html)
        plain.close()
        assert got[r.page_id] == "\n".join(t for b in plain.blocks if (t := " ".join(b.split()))), r.page_id
