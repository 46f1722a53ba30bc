"""op3 by round trip, op8 on pages whose article is known, the pipeline on its stages' promises."""

import base64
import hashlib

import corpus_pipeline
from tidemill.llm import html_template as H
from tidemill.llm import warc


def test_archive_round_trip(spark, tmp_path):
    pages = [(3, "http://a/x", "<p>é</p>"), (1, "http://a/y\r\nz", "<p>é</p>"), (2, None, None), (5, "u", ""), (4, "u", "other"), (4, "u", "other"), (None, "u", "other")]
    df = spark.createDataFrame([(i, u, h, "x") for i, u, h in pages], "page_id long, url string, html string, digest string")
    warc.write_archive(df, path := f"file://{tmp_path}/w")
    got = {(r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"]) for r in warc.read_index(spark, path).collect()}
    b32 = lambda s: base64.b32encode(hashlib.sha1(s.encode()).digest()).decode()
    e, o = "<p>é</p>", "other"
    assert got == {
        (1, "response", None, 9, b32(e)), (3, "revisit", 1, 9, b32(e)), (2, "response", None, 0, b32("")), (5, "revisit", 2, 0, b32("")),
        (4, "response", None, 5, b32(o)), (None, "revisit", 4, 5, b32(o)),
    }
    assert spark.read.parquet(f"{path}/payloads").count() == 3
    records = [bytes(r["record"]) for r in warc.read_records(spark, path).collect()]
    assert len(records) == len(pages)
    for r in records:
        head, _, block = r.removesuffix(b"\r\n\r\n").partition(b"\r\n\r\n")
        assert f"Content-Length: {len(block)}".encode() in head and head.startswith(b"WARC/1.1\r\n")
    warc.write_archive(df.limit(0), path := f"file://{tmp_path}/e")
    assert warc.read_index(spark, path).count() == 0


def page(body, n):
    return f"<html><head><title>T{n}</title><script>if(a<b)x('</p>')</script></head><body><nav><ul><li><a href=x>Menu {n}</a></ul></nav>{body}<footer>&copy; me</footer></body></html>"


def test_articles(spark):
    inner = "<h1>Head &amp; line</h1><p>One  <b>two\n three<br><p>four &lt;x&gt;<div class='ad'>buy</div><form><p>mail</form><section class=comments><p>first!</section><p>five"
    rows = [(n, f"http://host.example/{n}", page(f"<div class=cookie-notice>ok?</div><article>{inner} {n}</article><aside><p>more</aside>", n)) for n in range(5)]
    rows += [(10 + n, f"https://Plain.example:80/{n}", page(f"<div class=content><p>{'long text here ' * 20}{n}</p><p>end</p></div><div class=sidebar>side words</div>", n)) for n in range(4)]
    rows += [(20, "http://one.example", "<main><p>a<p>b</main> tail"), (21, None, None), (22, "x", ""), (23, "http://one.example", "no tags at all")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, slots string")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in H.extract_main_text(df).collect()}
    for n in range(5):
        text = f"Head & line\nOne two three\nfour <x>\nfive {n}"
        assert got[n] == (text, len(text))
    assert got[10][0] == ("long text here " * 20 + "0\nend").strip()
    assert got[20][0] == "a\nb" and got[21] == ("", 0) and got[22] == ("", 0)
    assert H.extract_main_text(df.limit(0)).count() == 0


def test_second_layout_of_a_host(spark):
    """A page without the slot of its host, and without an article, gives its body."""
    rows = [(n, "http://two.example", page(f"<article><p>story number {n}</article>", n)) for n in range(7)]
    rows += [(n, "http://two.example", page(f"<div class=text><p>other story {n}</div>", n)) for n in range(7, 10)]
    rows += [(10 + n, "http://div.example", page(f"<div class=text><p>story number {n} of some words</div>", n)) for n in range(7)]
    rows += [(17 + n, "http://div.example", page(f"<div class=else><p>other story {n}</div>", n)) for n in range(3)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in H.extract_main_text(df).collect()}
    assert [got[n] for n in range(10)] == [f"story number {n}" for n in range(7)] + [f"other story {n}" for n in range(7, 10)]
    assert [got[n] for n in range(10, 20)] == [f"story number {n} of some words" for n in range(7)] + [f"other story {n}" for n in range(3)]


def test_slot_with_all_parts(spark):
    """On a host without articles the slot holds all parts of a text, also those in tags that vary by page."""
    part = lambda n, k: " ".join(f"w{n}x{k}x{i}" for i in range(40))
    rows = [(n, "http://parts.example", page(f"<div class=content><div class=part1><p>{part(n, 1)} more</div><div class=part2><p>{part(n, 2)}</div></div>", n)) for n in range(5)]
    vary = ["<ul><li>{}</ul>", "<blockquote>{}</blockquote>", "<div class=only{}>{}</div>", "<pre>{}</pre>", "<section class=q><p>{}</section>"]
    for n in range(5):
        own = vary[n].format(*(["abcde"[n]] * (vary[n].count("{}") - 1)), part(n, 1))
        rows.append((5 + n, "http://vary.example", page(f"<div class=story>{own}</div><div class=extra><p>see it {n}</div>", n)))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in H.extract_main_text(df).collect()}
    for n in range(5):
        assert got[n] == f"{part(n, 1)} more\n{part(n, 2)}"
        assert got[5 + n] == part(n, 1)


def test_classes_decide(spark):
    """Constant slots and the places of a class, not the names of tags, tell the slot."""
    say = lambda n, k: " ".join(f"w{n}x{i}" for i in range(k))
    rows = []
    for n in range(6):
        about, top = "<div class=about><p>we write things about many things since long ago</div>", "<div class=top><p>top</div>"
        rows.append((n, "http://constant.example", page(f"{about}<div class=story><p>{say(n, 40)}</div><div class=extra>see {n}</div>", n)))
        box, tail = f"<div class=box><p>{say(n, 60)}</div>" if n < 5 else f"<p>{say(n, 60)}</p>", f"<div class=tail{'abcdef'[n]}>tail {n}</div>"
        rows.append((10 + n, "http://same.example", page(top + box + tail, n)))
        rows.append((20 + n, "http://moves.example", page((box + top if n % 2 else top + box) + tail, n)))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in H.extract_main_text(df).collect()}
    for n in range(5):
        assert got[n] == say(n, 40)
        assert got[10 + n] == say(n, 60)
        assert got[20 + n] == f"{say(n, 60)}\ntail {n}"


def deduced(pages: list[str], falsify=lambda i, v: v) -> dict:
    """Template of one host's pages, deduced in this process; ``falsify`` changes the occurrence vectors."""
    import json

    import pandas as pd

    df = pd.DataFrame({"host": "h", "html": pages})
    counts = pd.concat(H._counts([df]))
    tokens = [r for r in counts.to_dict("records") if r["pages"] >= 0.6 * len(pages) or not r["path"]]
    for i, t in enumerate(tokens):
        t["vector"] = falsify(i, t["vector"])
    plan = json.dumps(H._numbered(tokens))
    seen = pd.concat(H._observations([df.assign(plan=plan)]))
    merged = seen.groupby(["kind", "item"]).agg(low=("low", "min"), high=("high", "max"), good=("good", "min")).reset_index()
    broken = [{"kind": r["kind"], "item": r["item"]} for r in merged.to_dict("records") if not r["good"] or r["low"] != r["high"]]
    out = next(H._template()([pd.DataFrame({"host": ["h"], "tokens": [tokens], "broken": [broken]})]))
    return json.loads(out["slots"][0])


def test_occurrence_vectors_decide():
    """With other vectors there are other classes, other templates and another slot."""
    say = lambda n, k: " ".join(f"w{n}x{i}" for i in range(k))
    moves = []
    for n in range(6):
        box, top = f"<div class=b7><p>{say(n, 60)}</div>" if n < 5 else f"<p>{say(n, 60)}</p>", "<div class=t1><p>top</div>"
        moves.append(page((box + top if n % 2 else top + box) + f"<div class=z{'abcdef'[n]}>tail {n}</div>", n))
    real, apart, equal = deduced(moves), deduced(moves, lambda i, v: i), deduced(moves, lambda i, v: 0)
    assert real != apart and real["slots"] != apart["slots"]
    texts = lambda t: [H.main_text(p, **t) for p in moves]
    assert texts(real) != texts(apart) and equal["slots"] == real["slots"]


def test_hosts_with_random_names(spark):
    """Neither article nor main, class names that mean nothing, menus and notices alike on all pages."""
    import random

    rng = random.Random(6)
    name = lambda: "".join(rng.choice("bcdfghjkqvwxz") for _ in range(7))
    rows, want = [], {}
    for h in range(4):
        cls = [name() for _ in range(6)]
        for n in range(8):
            text = [" ".join(f"{name()}" for _ in range(rng.randint(20, 40))) for _ in range(3)]
            links = "".join(f"<li><a href=x>{name()}</a>" for _ in range(4))
            body = f"<div class={cls[0]}><ul>{links}</ul></div><div class={cls[1]}><p>We use crumbs on all our pages, agree.</div><div class={cls[2]}><div class={cls[3]}>"
            body += "".join(f"<p>{t}</p>" for t in text) + f"</div></div><div class={cls[4]}>All rights are kept by us</div>"
            rows.append((100 * h + n, f"http://h{h}.example/{n}", f"<html><body>{body}</body></html>"))
            want[100 * h + n] = "\n".join(text)
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in H.extract_main_text(df).collect()} == want


def test_teasers_are_no_article(spark):
    """Articles beside the section that holds the words do not become the slot."""
    say = lambda n: " ".join(f"w{n}x{i}" for i in range(80))
    rows = [(n, "http://teaser.example", page(f"<div class=qqq><p>{say(n)}</div><div class=ttt><article><p>read {n} too</article></div>", n)) for n in range(6)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in H.extract_main_text(df).collect()} == {n: say(n) for n in range(6)}


def test_no_article_text_is_lost(spark):
    """Whatever its host's template, a page with text in an article gives some; very long pages are read whole."""
    rows = [(n, "http://mixed.example", page([f"<article><p>a {n}</article>", f"<div class=k{n}><article><p>b {n}</article></div>", f"<main><section><article>c {n}</article></section></main>"][n % 3], n)) for n in range(9)]
    rows.append((50, "http://long.example", "<article>" + "<p>many words here</p>" * 60000 + "</article>"))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in H.extract_main_text(df).collect()}
    assert all(got[n] == f"{'abc'[n % 3]} {n}" for n in range(9)) and got[50] == "\n".join(["many words here"] * 60000)


def test_valid_classes():
    """Classes by hand: rounds of one order are valid, others are broken into pairs."""
    tokens = lambda *paths: [(p, k) for p, k in sorted(paths)]

    def valid(numbered, *pages):
        seen = {}
        for html in pages:
            for kind, item, value in H.observed(html, numbered):
                seen.setdefault((kind, item), set()).add(value)
        return H.valid_tokens(numbered, {k for k, v in seen.items() if len(v) > 1 or None in v})

    pair = tokens(("/ul", 0), ("/ul/li", 1), ("/ul/li/div", 1))
    assert valid(pair, "<ul><li><div>a</div><li><div>b</div></ul>", "<ul><li><div>a</div></ul>") == {"/ul", "/ul/li", "/ul/li/div"}
    assert valid(pair, "<ul><li><div>a</div><div>b</div><li></ul>") == {"/ul", "/ul/li"}
    places = tokens(("/div", 0), ("/div/h1", 0), ("/div/div", 1))
    assert valid(places, "<div><h1>a</h1><div>b</div></div>", "<div><h1>a</h1><div>b</div><div>c</div></div>") == {"/div", "/div/h1", "/div/div"}
    assert valid(places, "<div><h1>a</h1><div>b</div></div>", "<div><div>b</div><h1>a</h1></div>") == {"/div", "/div/h1"}
    # the class is in another order on each page: only its pairs with the parent remain, and they do not bind others
    loose = tokens(("/div", 0), ("/div/h1", 0), ("/div/h2", 0), ("/div/div", 1))
    assert valid(loose, "<div><h1>a</h1><h2>b</h2><div>c</div></div>", "<div><h2>b</h2><h1>a</h1><div>c</div></div>") == {"/div", "/div/h1", "/div/h2", "/div/div"}


def test_known_articles_of_the_corpus(spark):
    """The corpus' pages have one article; its text by a plain reading of the markup must come out."""
    import html
    import re

    d = "/root/testdata/sf0.001"
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{d}/pages.parquet").collect()}
    for r in H.op8_html_template(spark, d).collect():
        article = re.search(r"<article>(.*?)(</article>|$)", pages[r["page_id"]], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"</?b>", "", x)).split()) for x in re.split(r"</?(?:p|h1|br)>", article)]
        assert r["text"] == "\n".join(b for b in blocks if b)


def test_pipeline_stages(spark, tmp_path):
    words = lambda a, n: " ".join(f"word{a}x{i}" for i in range(n))
    passage, item = words("p", 60), words("b", 20)
    docs = [
        (1, words(1, 50), "en", "s", 9), (2, words(1, 49) + " tail", "en", "s", 9), (3, words(3, 40) + " " + passage, "en", "s", 9), (4, passage + " " + words(4, 40), "en", "s", 9),
        (5, words(5, 30) + " " + item, "en", "s", 9), (6, "1234 !!", "en", "s", 9), (7, None, "en", "s", 9), (8, words(8, 30), None, None, None), (8, words(8, 30), None, None, None),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    df, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        df = stage(spark, df, str(tmp_path))
        df.write.parquet(f"{tmp_path}/{name}")
        df = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = df.collect()
    ids = {k: sorted(r["doc_id"] for r in v) for k, v in seen.items()}
    assert ids == {"language": [1, 2, 3, 4, 5, 8, 8], "near_copies": [1, 3, 4, 5, 8], "repeated_passages": [1, 3, 4, 5, 8], "leaks": [1, 3, 4, 8], "encoding": [1, 3, 4, 8]}
    texts = {r["doc_id"]: r["text"] for r in seen["repeated_passages"]}
    assert "wordpx30" not in texts[3] + texts[4] and texts[3].startswith(words(3, 39)) and texts[1] == docs[0][1]
    for name, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, spark.createDataFrame([], schema), str(tmp_path)).columns == corpus_pipeline.COLUMNS


def test_near_copies_of_odd_rows(spark, tmp_path):
    """Rows without id, with one id for several texts, repeated rows: one of each group stays, no other text goes."""
    words = lambda a, n: " ".join(f"word{a}x{i}" for i in range(n))
    docs = [(None, words(1, 30)), (None, words(1, 29) + " end"), (7, words(1, 30)), (5, words(2, 30)), (5, words(3, 30)), (5, words(3, 30)), (None, words(4, 30)), (None, words(4, 30)), (None, None), (9, None), (-3, words(5, 30)), (2, words(5, 30))]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_copies(spark, df, str(tmp_path)).collect()]
    want = [(7, words(1, 30)), (5, words(2, 30)), (5, words(3, 30)), (None, words(4, 30)), (None, None), (9, None), (-3, words(5, 30))]
    assert sorted(got, key=str) == sorted(want, key=str)
