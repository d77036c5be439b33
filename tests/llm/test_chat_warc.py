"""Quotation linking on hand-made mail, WARC derivatives on hand-made records."""

import base64
import hashlib

from larder.llm import quotes, warc
from tests.llm.cases import frame


def mail(spark, rows):
    return spark.createDataFrame(rows, "id long, at long, text string, box string, key string, own string")


def thread(rows):
    return [(i, at, text, "b", "x", "y") for i, at, text in rows]


def test_nested_quotes_make_a_tree(spark):
    rows = thread([
        (1, 10, "Shall we meet?\nTomorrow."),
        (2, 20, "> Shall we  MEET?\n> Tomorrow.\n\nYes.\n"),
        (3, 30, "Ann wrote:\n> > Shall we meet?\n> > Tomorrow.\n> Yes.\nWhere?"),
        (4, 40, "> Shall we meet?\n> Tomorrow.\nNo.\n> Yes.\nWhy?"),
        (5, 50, "> something else\nLost."),
        (6, 5, "> Shall we meet?\n> Tomorrow.\nToo early."),
        (7, 60, None), (8, 70, ">> Shall we meet?\n>> Tomorrow.\ndeep"), (9, None, "Shall we meet soon?"),
    ])
    got = {r.id: r for r in quotes.formatted(mail(spark, rows), "id", "at", "text", "box").collect()}
    assert {k: r.parent for k, r in got.items()} == {1: None, 2: 10, 3: 20, 4: 20, 5: None, 6: None, 7: None, 8: 10, 9: None}
    assert {k: (r.root, r.depth) for k, r in got.items() if r.parent} == {2: (10, 1), 3: (10, 2), 4: (10, 2), 8: (10, 1)}
    assert got[2].text == "Yes." and got[3].text == "Where?" and got[4].text == "No.\nWhy?" and got[7].text == ""
    assert (got[4].n_quotes, got[4].n_found, got[5].n_quotes, got[5].n_found) == (2, 2, 1, 0)


def test_scopes_ties_and_repeats(spark):
    rows = [(1, 1, "hello there", "a", "", ""), (2, 2, "> hello there\nhi", "a", "", ""), (2, 2, "> hello there\nhi", "a", "", ""),
            (3, 2, "> hello there\nhi", "b", "", ""), (4, 1, "hello there", None, "", ""), (5, 2, "> hello there\nhi", None, "", ""),
            (6, 3, "hello there", "a", "", ""), (7, 4, "> hello there\nagain", "a", "", "")]
    got = sorted((r.id, r.parent) for r in quotes.formatted(mail(spark, rows), "id", "at", "text", "box").collect() if r.id != 9)
    assert got == [(1, None), (2, 1), (2, 1), (3, None), (4, None), (5, 1), (6, None), (7, 3)]
    assert quotes.formatted(mail(spark, []), "id", "at", "text").count() == 0


def test_long_chain_and_sorted_rows(spark):
    rows = thread([(0, 0, "message number 0 a")] + [(i, i, f"> message number {i - 1} a\nmessage number {i} a") for i in range(1, 60)])
    got = [(r.id, r.depth, r.root) for r in quotes.formatted(mail(spark, rows), "id", "at", "text").collect()]
    assert got == [(i, i, 0) for i in range(60)]


def test_trimmed_and_interleaved_quotes(spark):
    rows = thread([
        (1, 10, "Para one.\n\nPara two\ngoes on.\n \n\nPara three."),
        (2, 20, "> Para two\n> goes on.\nJust this."),
        (3, 30, "> Para one.\nyes\n> Para two goes on.\nno"),
        (4, 40, "> yes\n>\n> no such paragraph\n\nWhy?"),
        (5, 50, "> > Para three.\n> Just this.\ndeep"),
        (6, 60, "> Para one.\n> Para two\ncut inside a paragraph"),
        (7, 5, "> Para three.\nToo early."),
        (8, 70, "> Para three.\n>\n> Just this.\n\nfrom two messages"),
    ])
    got = {r.id: r for r in quotes.formatted(mail(spark, rows), "id", "at", "text", "box").collect()}
    assert {k: r.parent for k, r in got.items()} == {1: None, 2: 10, 3: 10, 4: 30, 5: 20, 6: None, 7: None, 8: 20}
    assert {k: (r.n_quotes, r.n_found) for k, r in got.items()} == {
        1: (0, 0), 2: (1, 1), 3: (2, 2), 4: (1, 1), 5: (2, 2), 6: (1, 0), 7: (1, 0), 8: (1, 1)}
    assert {r.root for r in got.values()} == {10, 60, 5} and got[5].depth == 2


def test_whole_runs_come_before_paragraphs(spark):
    rows = thread([(1, 1, "Good idea."), (2, 2, "Good idea.\n\nBut late."), (3, 3, "Later then.\n\nGood idea."),
                   (4, 4, "> Good idea.\nwhole of 1"), (5, 5, "> But late.\nx\n> Good idea.\ny")])
    got = {r.id: r.parent for r in quotes.formatted(mail(spark, rows), "id", "at", "text", "box").collect()}
    assert got == {1: None, 2: None, 3: None, 4: 1, 5: 1}


def test_long_rows_of_signs_and_blanks(spark):
    rows = thread([(1, 1, "the word"), (2, 2, ">" * 100_000 + " the word\n" + "> " * 50_000 + "the word\nreply"),
                   (3, 3, "> the word" + " " * 100_000 + "\n" + " " * 100_000 + "x" + "\t" * 100_000 + "y" + "\n" * 100_000),
                   (4, 4, " > \t>\t> the word\n>\n>>\nz > not a quote")])
    got = {r.id: (r.parent, r.text) for r in quotes.formatted(mail(spark, rows), "id", "at", "text", "box").collect()}
    assert got[1] == (None, "the word") and got[2] == (1, "reply") and got[4] == (1, "z > not a quote")
    assert got[3][0] == 1 and got[3][1][0] == "x" and got[3][1][-1] == "y"


def plain_links(rows):
    """rows: (order, own passage, quoted passage or None), one scope: the latest earlier message with the passage."""
    out = {}
    for at, _, asked in rows:
        had = [b for b, own, _ in rows if own == asked and b < at]
        out[at] = max(had) if asked is not None and had else None
    return out


def test_hot_passages_link_to_the_latest_before(spark):
    """A third of all messages say the same; quotes of it take the latest before them, in whatever range it lies."""
    import random
    rng = random.Random(6)
    rows = []
    for i in range(600):
        own = "yes" if i % 3 == 0 else rng.choice(["no", "maybe so", f"only {i}"])
        rows.append((i, own, rng.choice([None, "yes", "yes", "no", "maybe so", "never said"])))
    text = lambda own, asked: (f"> {asked}\n" if asked else "") + own
    df = mail(spark, [(i, i, text(own, asked), "b", "x", "y") for i, own, asked in rows]).repartition(5)
    got = {r.id: r.parent for r in quotes.formatted(df, "id", "at", "text", "box").collect()}
    assert got == plain_links(rows)


PAGE = ('<!DOCTYPE html><html><head><title>A &amp; B</title><style>p{}</style><script>var t="</p>";</script></head><body>'
        '<!-- ad --><p>One <b>two</b>&nbsp;three<br>four</p><ul><li><a href="/x?a=1&amp;b=2">x</a></li></ul><td>c1</td><td>c2</td></body>')


def test_records_link_and_keep_the_source(spark):
    rows = [(1, "http://a/é", PAGE), (2, None, None), (2, None, None), (3, "http://b", "plain <p>unclosed")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, record string")
    made = warc.responses(pages)
    sources = {}
    for r in made.collect():
        head, _, _ = bytes(r.record).partition(b"\r\n\r\n")
        sources[r.page_id] = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    out = warc.derive(made, "page_id").collect()
    assert len(out) == 8
    for r in out:
        head, _, rest = bytes(r.warc).partition(b"\r\n\r\n")
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        body = rest[:int(fields["Content-Length"])]
        assert rest[len(body):] == b"\r\n\r\n" and len(body) == r.content_length
        assert fields["WARC-Refers-To"] == r.refers_to == sources[r.page_id]["WARC-Record-ID"]
        assert fields["WARC-Block-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode() == r.block_digest
        assert r.source_payload_digest == sources[r.page_id]["WARC-Payload-Digest"] and r.digest_ok
        other = [x for x in out if x.page_id == r.page_id and x.record_type != r.record_type][0]
        assert fields["WARC-Concurrent-To"] == other.record_id and fields["WARC-Record-ID"] == r.record_id
        if r.page_id == 1 and r.record_type == "conversion":
            assert body.decode() == "One two three\nfour\nx\nc1 c2"
            assert fields["WARC-Target-URI"] == fields["WARC-Refers-To-Target-URI"] == "http://a/é"
        if r.page_id == 1 and r.record_type == "metadata":
            told = body.decode()
            assert "title: A & B\r\n" in told and "outlink: /x?a=1&b=2\r\n" in told and "http-status: HTTP/1.1 200 OK" in told
            assert f"warc-field: WARC-Record-ID: {r.refers_to}\r\n" in told and "http-field: Content-Type: text/html" in told


def parsed(page):
    """Text and links by an HTML parser, for pages whose elements are closed."""
    from html.parser import HTMLParser
    breaks = set(warc._BREAK.pattern.split("(?:")[1].split(")")[0].replace("h[1-6]", "h1|h2|h3|h4|h5|h6").split("|"))

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.out, self.links, self.deep = [], [], 0

        def handle_starttag(self, tag, attrs):
            if tag in warc._CLOSE:
                self.deep += 1
                self.out.append(" ")
            elif not self.deep:
                self.out.append("\n" if tag in breaks else " " if tag in ("td", "th") else "")
                if tag == "a" and dict(attrs).get("href") is not None:
                    self.links.append(dict(attrs)["href"])

        def handle_startendtag(self, tag, attrs):
            if tag != "svg":
                self.handle_starttag(tag, attrs)
            elif not self.deep:
                self.out.append(" ")

        def handle_comment(self, data):
            if not self.deep:
                self.out.append(" ")

        def handle_endtag(self, tag):
            if tag in warc._CLOSE:
                self.deep = max(0, self.deep - 1)
            elif not self.deep:
                self.out.append("\n" if tag in breaks else " " if tag in ("td", "th") else "")

        def handle_data(self, data):
            if not self.deep:
                self.out.append(data.replace("\n", " "))

    reader = Reader()
    reader.feed(page)
    reader.close()
    lines = (" ".join(line.replace("\xa0", " ").split()) for line in "".join(reader.out).split("\n"))
    return [line for line in lines if line], reader.links


def test_text_and_links_are_those_of_a_parser(spark):
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect() if r.html]
    pages += [PAGE, '<p>a<svg width="1"/>b<svg><text>no</text></svg>c<noscript>n</noscript>', "<ul><li>x<li>y</ul>z &lt;p&gt; 1 < 2",
              "<html><head><title>t</title><body><p>all the text</p><a href=/u>l</a>", "<title>t</title>no head <b>at</b> all",
              "<a title='x' href=\"/q?a=1&amp;b=2\">q</a><a name=x>n</a><a data-href='/no' HREF = '/yes'>y</a>"]
    for page in pages:
        text, links = parsed(page)
        seen = warc.shown(page)
        assert [" ".join(x.split()) for x in warc.plain_text(seen).split("\n") if x] == text, page[:200]
        assert warc.outlinks(seen) == links, page[:200]


def test_broken_pages_in_one_pass():
    import time
    began = time.monotonic()
    assert warc.plain_text(warc.shown("<svg>a<noscript>b<template>c" * 60_000)) == " ".join("abc" * 60_000)
    assert warc.plain_text(warc.shown("<a " * 200_000)).startswith("<a <a")
    assert warc.outlinks("<a <a " * 200_000 + ">") == []
    assert warc.plain_text(warc.shown("x<script>" + "<script>y" * 100_000)) == "x"
    assert warc.plain_text(warc.shown("<p>long</p>" * 300_000)).count("long") == 300_000
    assert warc.plain_text(warc.shown("<title>open <p>text")) == "open\ntext"
    assert time.monotonic() - began < 20


def coded_response(body, *heads, stored=None):
    block = ("HTTP/1.1 200 OK\r\n" + "".join(h + "\r\n" for h in heads) + "\r\n").encode() + body
    fields = [("WARC-Type", "response"), ("WARC-Record-ID", "<urn:x>"), ("WARC-Payload-Digest", warc.digest(stored or body))]
    return warc.record(fields, block)


def test_payloads_are_undone_or_refused():
    import gzip
    import zlib
    page = b"<p>caf\xc3\xa9</p>"
    chunks = b"5;x=y\r\n" + page[:5] + b"\r\n" + b"%x\r\n" % len(page[5:]) + page[5:] + b"\r\n0\r\nTrailer: t\r\n\r\n"
    html_ = "Content-Type: text/html; charset=utf-8"
    raw = zlib.compressobj(wbits=-15)
    raw = raw.compress(page) + raw.flush()
    fine = [coded_response(chunks, html_, "Transfer-Encoding: chunked"), coded_response(gzip.compress(page), html_, "Content-Encoding: gzip"),
            coded_response(gzip.compress(page[:4]) + gzip.compress(page[4:]), html_, "Content-Encoding: x-gzip"),
            coded_response(zlib.compress(page), html_, "content-encoding: deflate"), coded_response(raw, html_, "Content-Encoding: deflate"),
            coded_response(b"%x\r\n" % len(gzip.compress(page)) + gzip.compress(page) + b"\r\n0\r\n\r\n", html_, "Content-Encoding: gzip",
                           "Transfer-Encoding: chunked"), coded_response(page)]
    for r in fine:
        meta, text = warc.derive_one(r)
        assert text["record_type"] == "conversion" and meta["digest_ok"] and b"\r\n\r\ncaf\xc3\xa9\r\n" in text["warc"]
    odd = {"not text: image/png": coded_response(b"\x89PNG", "Content-Type: image/png"), "not text: null bytes": coded_response(b"a\0b"),
           "encoding br": coded_response(page, html_, "Content-Encoding: br"), "broken chunks": coded_response(b"zz\r\nx", html_, "Transfer-Encoding: chunked"),
           "broken compression": coded_response(gzip.compress(page)[:-9], html_, "Content-Encoding: gzip")}
    for why, r in odd.items():
        [meta] = warc.derive_one(r)
        assert (meta["record_type"], meta["reason"], meta["concurrent_to"], meta["digest_ok"]) == ("metadata", why, None, True)
        assert f"no-conversion: {why}\r\n".encode() in meta["warc"]
    assert warc.derive_one(coded_response(b"{}", "Content-Type: application/json"))[1]["reason"] is None


def test_records_that_are_none(spark):
    good = warc.response("k", "http://a", PAGE)
    rows = [(1, None), (2, b""), (3, b"WARC/1.1\r\nWARC-Type: response\r\n\r\n"), (4, good[:-400]),
            (5, good.replace(b"WARC-Type: response", b"WARC-Type: request")), (6, good.replace(b"HTTP/1.1", b"FTP/1")),
            (7, good.replace(b"One", b"Two")), (8, good.replace(b"utf-8", b"nosuch").replace(b"Content-Length: 3", b"Content-Length: 3", 1))]
    got = {}
    for r in warc.derive(spark.createDataFrame(rows, "page_id long, record binary"), "page_id").collect():
        got.setdefault(r.page_id, []).append((r.record_type, r.reason, r.digest_ok))
    assert [got.get(k, [("-",)])[0][0] for k in (1, 2, 3, 4, 5, 6)] == ["error", "error", "error", "error", "-", "error"]
    assert [x[2] for x in got[7]] == [False, False]
    assert warc.derive(spark.createDataFrame([], "page_id long, record binary"), "page_id").count() == 0


def test_files_hold_the_records(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://a/{i}", PAGE) for i in range(5)], "page_id long, url string, html string")
    made = warc.derive(warc.responses(pages), "page_id")
    warc.write(made, str(tmp_path / "out"), compression="none")
    data = b"".join(p.read_bytes() for p in sorted((tmp_path / "out").glob("part-*")))
    found = set()
    while data:
        head, _, rest = data.partition(b"\r\n\r\n")
        n = int(head.rpartition(b"Content-Length: ")[2])
        found.add(head + b"\r\n\r\n" + rest[:n] + b"\r\n\r\n")
        assert rest[n:n + 4] == b"\r\n\r\n"
        data = rest[n + 4:]
    assert found == {bytes(r.warc) for r in made.collect()}


def test_very_long_message_and_clashing_columns(spark):
    df = frame(spark).withColumnRenamed("doc_id", "at")
    got = quotes.formatted(df, "at", "at", "text").collect()
    assert len(got) == df.count() and max(len(r.text) for r in got) > 100_000
