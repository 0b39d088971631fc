"""Line rules against SQL and brute force; WARC round trip; HTML blocks and shared runs against brute force."""
import hashlib
import base64
import re

import numpy as np
import pytest
from compare import compare, duck
from pyspark.sql import functions as F

from shelfline.llm import html_suffix, quality_rules, warc
from shelfline.llm.html_blocks import blocks

TEXTS = [None, "", "\n \x0b\n", "one two", "a b c d e a b c d e a b c d e", "x " * 30000, "Fine line that ends well with a dot and is long enough here.",
         "Home | News | About | Contact\nThis is a proper sentence with quite a few words in it.\nHome | News | About | Contact",
         "All rights reserved.\nSHOUTING LINE OF WORDS!!", "w1$ w2# w3* w4& w5| w6< w7> w8% w9$ w10# w11*", "é ü ein wort\rzwei\tdrei\n\nvier fünf sechs sieben acht neun zehn."]


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    seen, twice = set(), set()
    for w in windows:
        (twice if w in seen else seen).add(w)
    covered = {i + k for i, w in enumerate(windows) if w in twice for k in range(5)}
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered),
            n < 10 or 100 * len(covered) > 20 * n)


def test_base_columns(spark):
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS)] + [(4, TEXTS[4], "clash"), (None, TEXTS[6], None)]
    out = quality_rules.clean_lines(spark.createDataFrame(rows, "doc_id long, text string, KEPT string")).collect()
    assert len(out) == len(rows)
    for r in out:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(r.text)
        assert not (r.kept and r.base_failed) and isinstance(r.cleaned, str)
    by = {r.doc_id: r for r in out}
    assert by[6].kept and by[6].cleaned == TEXTS[6] and by[7].cleaned.startswith("This is") and by[8].cleaned == "" and not by[9].kept


def test_rules_equal_sql(spark):
    sf = "/root/testdata/sf0.001"
    out = quality_rules.clean_lines(spark.read.parquet(f"{sf}/documents.parquet")).select(*quality_rules.QUERY_COLUMNS)
    assert compare(out, duck(sf), quality_rules.SQL) == []


def test_rules_use_no_python(spark):
    df = quality_rules.clean_lines(spark.createDataFrame([(1, "a")], "doc_id long, text string"))
    assert not re.search("Python|Arrow|Pandas", df._jdf.queryExecution().executedPlan().toString())


PAGES = [(1, "http://a.example/1", "<html><head><title>t</title></head><body><nav>menu</nav><article><h1>Head</h1><p>One &amp; two&nbsp;\n three<p>Four</article></body>"),
         (2, None, None), (3, "http://a.example/3", ""), (4, "x", "plain &lt;text&gt; 5 < 6"), (None, "y", "<p>null id</p>"),
         (1, "http://a.example/1", "<p>" + "long word " * 20000 + "</p>")]


def test_warc_derivatives(spark):
    responses = warc.response_records(spark.createDataFrame(PAGES, "page_id long, url string, html string"))
    out = warc.derive(responses.withColumn("text", F.lit("clash"))).collect()
    source = {r.record_id: r for r in responses.collect()}
    assert len(out) == 2 * len(PAGES)
    label = lambda s: "sha1:" + base64.b32encode(hashlib.sha1(s.encode()).digest()).decode()
    for r in out:
        origin = source[r.refers_to]
        assert r.target_uri == origin.target_uri and r.date == origin.date and r.block_digest == label(r.block)
        assert origin.block_digest == label(origin.block)
        body = origin.block.partition("\r\n\r\n")[2]
        assert origin.payload_digest == label(body) and origin.payload_digest in r.headers
        if r.warc_type == "conversion":
            assert r.block == "\n".join(b.text for b in blocks(body))
        else:
            assert f"source-payload-digest: {label(body)}" in r.block and "http-Content-Type: text/html" in r.block
    assert len({r.record_id for r in out}) == len({(r.warc_type, r.refers_to) for r in out})


@pytest.mark.parametrize("compress", [True, False])
def test_warc_round_trip(spark, compress):
    responses = warc.response_records(spark.createDataFrame(PAGES, "page_id long, url string, html string"))
    records = responses.unionByName(warc.derive(responses))
    want = sorted((r.warc_type, r.record_id, r.refers_to, r.target_uri, r.payload_digest, (r.block or "").encode()) for r in records.collect())
    content = b"".join(bytes(r.warc) for r in warc.serialize(records, compress).collect())
    got = sorted((x["WARC-Type"], x["WARC-Record-ID"], x.get("WARC-Refers-To"), x.get("WARC-Target-URI"), x["WARC-Payload-Digest"], x["block"])
                 for x in warc.parse(content))
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_warc_empty(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.derive(warc.response_records(none)).count() == 0


def test_blocks():
    page = ('<body><header>H</header><main><header><h1>T</h1></header><p class="notice">n<p>a  b&nbsp;c<br>d<div class="x"><div>in</div>z</div>'
            '<aside>q</aside>tail<!-- c --><form>f</form><div class="ad"><div>x</div>y</div>end</main><footer>f<p>x</body>')
    assert [b.text for b in blocks(page) if b.zone == "content"] == ["T", "a b c d", "in", "z", "tail", "end"]
    assert [b.text for b in blocks('<a title="abc>x</a> 5 < 6 &amp; <b>b</b><script>if(a<b){}</script>e')] == ["x 5 < 6 & b", "e"]
    assert blocks(None) == [] and blocks("<") == [("open", "<")]


def test_shared_runs_against_brute_force():
    rng = np.random.default_rng(2)
    common = rng.integers(0, 50, 30)
    streams = [np.concatenate([rng.integers(0, 5, rng.integers(0, 40)), common[:rng.integers(0, 30)]]) for _ in range(12)] + [np.zeros(20, int)] * 2
    page = np.repeat(np.arange(len(streams)), [len(s) for s in streams])
    token = np.concatenate(streams).astype(np.uint64)
    where = {}
    for p, s in enumerate(streams):
        for i in range(len(s) - 7):
            where.setdefault(tuple(s[i:i + 8]), set()).add(p)
    want = []
    for p, s in enumerate(streams):
        hit = [i for i in range(len(s) - 7) if len(where[tuple(s[i:i + 8])]) >= 3]
        cover = {i + k for i in hit for k in range(8)}
        want += [i in cover for i in range(len(s))]
    assert html_suffix.shared_tokens(page, token).tolist() == want


def test_extract(spark):
    shared = "<div>Read more of our stories on this site every day now</div>"
    rows = PAGES + [(10 + i, f"http://h.example/{i}", f"<body>{shared}<p>{i} own text</p>") for i in range(5)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")
    for shard in (2, 256):
        out = html_suffix.extract(df, shard).collect()
        assert len(out) == len(rows) and all(r.n_chars == len(r.text) for r in out)
        text = {}
        for r in out:
            text.setdefault(r.page_id, []).append(r.text)
        assert "Head\n\nOne & two three\n\nFour" in text[1] and text[2] == text[3] == [""] and text[4] == ["plain <text> 5 < 6"] and text[None] == ["null id"]
    assert text[12] == ["2 own text"]
    assert html_suffix.extract(df.limit(0)).count() == 0


def test_extract_counts_runs_over_the_whole_host(spark):
    """A notice of 5 pages in 300 goes however the host is dealt; one of two pages stays; a small host keeps its own."""
    notice, pair = "this section is kept by the friends of the old mill", "only two pages of all have this line of words here"
    rows = []
    for i in range(300):
        own = " ".join(f"w{i}x{k}" for k in range(20))
        more = f"<p>{notice}</p>" if i % 60 == 0 else f"<p>{pair}</p>" if i in (7, 8) else ""
        rows.append((i, f"http://big.org/{i}", f"<html><body><p>{own}</p>{more}</body></html>"))
    rows.append((900, "http://big.org/a", f"<html><body><article><p>{notice}</p></article></body></html>"))
    rows.append((901, "http://small.org/a", f"<html><body><p>{notice}</p></body></html>"))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    dealt, whole = ({r.page_id: (r.text, r.n_cut) for r in html_suffix.extract(df, n).collect()} for n in (10, 1000))
    assert dealt == whole and len(dealt) == len(rows)
    assert [i for i, (t, _) in dealt.items() if notice in t] in ([900, 901], [901, 900])
    assert pair in dealt[7][0] and pair in dealt[8][0] and "w60x3" in dealt[60][0] and dealt[60][1] == 1
