import hashlib
import io
import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from vellum.llm import common, extraction, nearest, warc
from vellum.llm.components import components

from .data import with_clashes


def rows(df):
    return [r.asDict() for r in df.collect()]


# 5 nearest


def brute_nearest(vectors, q, k):
    ids = [i for i in vectors if i != q]
    s = {i: float((vectors[i].astype(np.float64) * vectors[q]).sum()) for i in ids}
    return sorted(ids, key=lambda i: (-s[i], i))[:k]


def test_nearest_recall_and_ranks(spark, monkeypatch):
    monkeypatch.setattr(nearest, "VECTOR_BLOCK", 400)
    monkeypatch.setattr(nearest, "QUERY_BLOCK", 30)
    rng = np.random.default_rng(1)
    v = rng.standard_normal((1500, 24)).astype(np.float32) * rng.uniform(0.5, 3, (1500, 1)).astype(np.float32)
    v[700:760] = v[20]  # many equal vectors: ties go to smaller ids
    vectors = {i: x for i, x in enumerate(v)}
    df = spark.createDataFrame([(i, x.tolist()) for i, x in vectors.items()], "vec_id long, embedding array<float>")
    got = {}
    for r in rows(nearest.search(df.where("vec_id % 20 = 0"), with_clashes(df))):
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hit = 0
    for q, found in got.items():
        found.sort()
        want = brute_nearest(vectors, q, 20)
        assert [r for r, *_ in found] == list(range(1, 21)) and q not in [i for _, i, _ in found]
        hit += len(set(want) & {i for _, i, _ in found})
        for _, i, s in found:
            assert s == pytest.approx(float(vectors[i].astype(np.float64) @ vectors[q]))
    assert len(got) == 75 and hit / (20 * len(got)) >= 0.99
    assert [i for _, i, _ in sorted(got[20])] == brute_nearest(vectors, 20, 20)


def test_nearest_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    data = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, []), (8, [1.0, 2.0, 3.0]), (None, [9.0, 9.0]), (1, [2.0, 0.0]), (20, [1.0, 1.0]), (20, [1.0, 1.0]), (40, [1e30, 1e30])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in rows(nearest.search(df.where("vec_id % 20 = 0"), df)))
    assert [x for x in got if x[0] == 0] == [(0, 1, 40), (0, 2, 1), (0, 3, 1), (0, 4, 20), (0, 5, 20)]
    assert [x for x in got if x[0] == 20] == [(20, 1, 40), (20, 2, 1), (20, 3, 1), (20, 4, 0)]
    assert rows(nearest.search(df.limit(0), df)) == [] and rows(nearest.search(df.limit(0), df.limit(0))) == []


def test_nearest_of_doubles_is_scored_in_doubles(spark):
    rng = np.random.default_rng(2)
    v = {i: x for i, x in enumerate(rng.standard_normal((60, 8)) * 1e60)}
    v[7] = np.full(8, 1e200)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in v.items()], "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in rows(nearest.search(df.where("vec_id % 20 = 0"), df, 5))}
    for q in (0, 20, 40):
        score = {i: (x * v[q]).sum() for i, x in v.items() if i != q}
        want = sorted(score, key=lambda i: (-score[i], i))[:5]
        assert [got[q, r + 1] for r in range(5)] == [(i, score[i]) for i in want]


def test_nearest_in_clusters_and_copies(spark, monkeypatch):
    """Cells that a query can skip, a hot cell of copies in several blocks, and recall of the query as registered."""
    monkeypatch.setattr(nearest, "VECTOR_BLOCK", 200)
    monkeypatch.setattr(nearest, "SAMPLE", 500)
    rng = np.random.default_rng(9)
    centres = rng.standard_normal((12, 32)) * 3
    v = (centres[rng.integers(0, 12, 2000)] + rng.standard_normal((2000, 32)) * 0.3).astype(np.float32)
    v[500:1200] = v[3]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    got = {}
    for r in rows(nearest.search(df.where("vec_id % 20 = 0"), df)):
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    vectors = dict(enumerate(v))
    hit = sum(len({i for _, i in found} & set(brute_nearest(vectors, q, 20))) for q, found in got.items())
    assert len(got) == 100 and hit >= 0.97 * 2000


def test_nearest_recall_on_the_test_table(spark):
    path = "/root/testdata/sf0.1/embeddings.parquet"
    if not os.path.exists(path):
        pytest.skip("no test tables")
    df = spark.read.parquet(path).select("vec_id", "embedding")
    table = {r["vec_id"]: np.array(r["embedding"]) for r in rows(df)}
    ids, v = np.array([*table]), np.stack([*table.values()])
    got = {}
    for r in rows(nearest.op5_nearest(spark, os.path.dirname(path))):
        got.setdefault(r["query_id"], {})[r["vec_id"]] = r["score"]
    hit = 0
    for q, found in got.items():
        score = np.where(ids == q, -np.inf, (v * table[q]).sum(1))
        hit += len({*ids[np.lexsort((ids, -score))[:20]].tolist()} & found.keys())
    assert hit >= 0.97 * 20 * len(got) and len(got) == sum(i % 20 == 0 for i in table)


def test_error_bounds_hold():
    rng = np.random.default_rng(5)
    v, q = rng.standard_normal((500, 48)).astype(np.float32), rng.standard_normal((50, 48)).astype(np.float32)
    guess, bound = nearest.estimate(q, *nearest.encode(v), width=4.0)
    off = np.abs(guess - q.astype(float) @ v.T.astype(float))
    assert (off <= bound).mean() > 0.999 and np.corrcoef(guess.ravel(), (q @ v.T).ravel())[0, 1] > 0.7


# 8 extraction


def text_of(page):
    return " ".join(b.text for b in extraction.blocks(page))


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("", ""),
        ("plain &amp; simple", "plain & simple"),
        ("<body><nav>Home</nav><article><h1>T</h1><p><b>One.<br><p>Two &eacute;&#33; <i>x</i>y</p></article><footer>f</footer>", "T One. Two é! xy"),
        ("<article><header><h1>Title</h1></header><p>a\n  b</p><aside>no</aside><div class='share-buttons'>no</div></article><p>outside</p>", "Title a b"),
        ("<div class=content><p>x</p><form><label>q</label></form></div><div id='cookie-notice'>c</div><section class=comments><article class=comment><p>hi</p></article></section>", "x"),
        ("<p>a<script>if (a<b) '</p>'</script>b</p><style>p{}</style><!-- c --><p>d</p>", "ab d"),
        ("<ul><li><a href=x>one</a><li><a href=y>two</a></ul><ul><li>real</li><li>list</li></ul>", "real list"),
        ("<main><table><tr><td>1<td>2<tr><td>3</table></main>", "1 2 3"),
        ("<p>1 < 2 and <unclosed", "1 < 2 and <unclosed"),
        ("<article><p title='a > b'>q</p></article>", "q"),
        ("<article><p hidden>no</p><p>yes</p><div role=complementary>no</div></article></html></body></div>", "yes"),
        ('<article><p class="x y" id="broken>quoted</p><p>z</p></article>', "quoted z"),
    ],
)
def test_blocks(page, want):
    assert text_of(page) == want


def test_style_tree_removes_what_a_site_repeats(spark):
    pages = [(i, f"http://a.example/{i}", f"<div class=box><p>Our site, every page</p></div><div class=body><p>Story number {i} tells {i * 7}</p></div><div class=end><p>All of it {i % 2}</p></div>") for i in range(12)]
    pages += [(100 + i, "http://b.example/1", "<div class=box><p>Our site, every page</p></div>") for i in range(2)]
    pages += [(200 + i, f"https://user@a.example:80/x{i}", "<article><p>Shared passage</p></article>") for i in range(6)]
    pages += [(300, None, None), (301, "not a url", "<p>t</p>"), (301, "not a url", "<p>t</p>"), (None, "http://c.example", "<p>u</p>")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {}
    for r in rows(extraction.extract(with_clashes(df))):
        got.setdefault(r["page_id"], []).append(r["text"])
        assert r["n_chars"] == len(r["text"])
    assert all(got[i] == [f"Story number {i} tells {i * 7}"] for i in range(12))
    assert got[100] == ["Our site, every page"] and got[203] == ["Shared passage"] and got[300] == [""] and got[301] == ["t", "t"] and got[None] == ["u"]
    assert rows(extraction.extract(df.limit(0))) == []


def test_style_tree_decides_on_pages_with_an_article(spark):
    notice, teaser = "<p>Please support us, every page</p>", "<div class=box>Read our yearly offer</div>"
    pages = [(i, f"http://a.example/{i}", f"<div class=lead>Standfirst {i}</div><div class=strip>One strip</div><article><h1>Title {i}</h1>{notice}<p>Story {i} one</p><p>Story {i} two</p>{teaser}</article><div class=tail>Kind {i % 3}</div>") for i in range(12)]
    pages += [(100 + i, f"http://b.example/{i}", f"<p>beside {i}</p><main>{notice}<p>Only {i}</p></main>") for i in range(3)]
    got = {r["page_id"]: r["text"] for r in rows(extraction.extract(spark.createDataFrame(pages, "page_id long, url string, html string")))}
    assert all(got[i] == f"Standfirst {i} Title {i} Story {i} one Story {i} two" for i in range(12))
    assert got[101] == "Please support us, every page Only 1"  # too few pages: the prior decides


def test_copies_of_a_page_are_not_boilerplate(spark):
    copy = "<h1>The one story</h1><div class=body>" + "".join(f"<p>Paragraph {k} of the story</p>" for k in range(10)) + "</div>"
    pages = [(i, f"http://a.example/{i}", copy) for i in range(1000)]
    pages += [(2000 + i, f"http://a.example/own{i}", f"<h1>Title {i}</h1><div class=body><p>Own text {i}</p></div>") for i in range(3)]
    got = {r["page_id"]: r["text"] for r in rows(extraction.extract(spark.createDataFrame(pages, "page_id long, url string, html string")))}
    want = " ".join(["The one story", *(f"Paragraph {k} of the story" for k in range(10))])
    assert all(got[i] == want for i in range(1000)) and got[2001] == "Title 1 Own text 1"


def brute_tree(pages):
    """(host -> path -> importance, from_one, from_none, held), and each page's text, by plain recursion over the merged tree."""
    sites, out, texts = {}, {}, []
    host = lambda url: (re.match(r"[a-z]+://([^/]*)", url or "") or [None, ""])[1]
    for _, url, html in pages:
        sites.setdefault(host(url), {})[html or ""] = extraction.parse(html or "")
    entropy = lambda counts: 1.0 if sum(counts) < 2 else -sum(c / sum(counts) * math.log(c / sum(counts)) for c in counts) / math.log(sum(counts))
    for name, site in sites.items():
        held, styles, contents, below = Counter(), {}, {}, {}
        for page in site.values():
            kids = page.children()
            for k, path in enumerate(page.paths):
                held[path] += 1
                styles.setdefault(path, Counter())[frozenset(page.paths[c] for c in kids[k])] += 1
                for c in kids[k]:
                    below.setdefault(path, Counter())[page.paths[c]] += 1 / len(kids[k])
            for path, text in {(page.paths[b.node], b.text) for b in page.blocks}:
                contents.setdefault(path, Counter())[text] += 1

        def importance(path, held=held, styles=styles, contents=contents, below=below):
            if path in contents:
                return entropy(contents[path].values())
            turns = extraction.GAMMA ** len(styles[path])
            return (1 - turns) * entropy(styles[path].values()) + turns * sum(w / held[path] * importance(c) for c, w in below.get(path, {}).items())

        def down(path, first, held=held):
            above = down(path.rpartition("/")[0], first) if path else first
            return (held[path] * importance(path) + extraction.KNOWN * above) / (held[path] + extraction.KNOWN)

        out[name] = {path: (importance(path), down(path, 1.0), down(path, 0.0), held[path]) for path in held}, contents
    for page_id, url, html in pages:
        page, (tree, contents) = extraction.parse(html or ""), out[host(url)]
        said = []
        for b in page.blocks:
            path = page.paths[b.node]
            _, one, none, m = tree[path]
            if b.role > extraction.AROUND and (none if b.role == extraction.BESIDE else one) * extraction.WEIGHTS[b.role] >= extraction.LEAST_IMPORTANCE and contents[path][b.text] - 2 < extraction.REPEATED_SHARE * m:
                said.append(b.text)
        texts.append((page_id, " ".join(said)))
    return {h: tree for h, (tree, _) in out.items()}, texts


def test_style_tree_matches_brute_force(spark, monkeypatch):
    r, pages = random.Random(3), []
    word = lambda n: " ".join(r.choice(["sea", "hill", "lamp", "rain", "door", "coal"]) for _ in range(n))
    for i in range(90):
        body = [f"<div class=top{i % 2}><p>{word(1)}</p><ul><li>Home<li>News</ul></div>" if r.random() < 0.8 else "", f"<div class=mid><section><h2>{word(4)}</h2>" + "".join(f"<p>{word(3)}</p>" for _ in range(r.randrange(4))) + "</section></div>"]
        body.append(r.choice(["<article><p>same each time</p><p>" + word(6) + "</p><div class='end x'>the end</div></article>", "<nav><a href=x>menu</a></nav>", "<p>stray " + word(1) + "</p>", ""]))
        pages.append((i, f"http://{r.choice('aaaaabbc')}.example/{i}", "<body>" + "".join(body) + f"<div class=tail><b>{word(1)}</b> text</div></body>"))
    pages += [(200 + i, "http://a.example/copy", pages[0][2]) for i in range(20)] + [(300, None, None), (301, "http://d.example/", "")]
    tree, texts = brute_tree(pages)
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    every = common.table(extraction.parsed(df), "test-parsed")
    judged, _ = extraction.style_tree(every.where("id IS NULL"), every.select("id", "chain"))
    got = {(x["host"], x["id"]): (x["importance"], x["from_one"], x["from_none"], x["held"]) for x in rows(judged)}
    want = {(h, extraction._number(path)): v for h, nodes in tree.items() for path, v in nodes.items()}
    assert got.keys() == want.keys() and len(got) > 60
    for k, v in want.items():
        assert got[k] == pytest.approx(v), k
    assert sorted((x["page_id"], x["text"]) for x in rows(extraction.extract(df))) == sorted(texts)
    prior = {i: " ".join(b.text for b in extraction.blocks(h or "")) for i, _, h in pages}
    assert sum(prior[i] != t for i, t in texts) > 20  # the tree does decide
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    assert sorted((x["page_id"], x["text"]) for x in rows(extraction.extract(df))) == sorted(texts)


def test_blocks_of_the_test_pages_go_through_the_tree(spark):
    path = "/root/testdata/sf0.01/pages.parquet"
    if not os.path.exists(path):
        pytest.skip("no test tables")
    every = common.table(extraction.parsed(spark.read.parquet(path)), "test-parsed")
    judged, contents = extraction.style_tree(every.where("id IS NULL"), every.select("id", "chain"))
    assert judged.where("held > 1").count() > 100 and contents.agg({"n": "sum"}).first()[0] > 2500


def test_elements_below_the_deepest_are_part_of_the_node_above():
    page = extraction.parse("<div>" * 400 + "deep" + "</div>" * 400 + "<p>x</p>")
    assert max(page.depth) == extraction.MAX_DEPTH + 1 and [b.text for b in page.blocks] == ["deep", "x"]


def test_long_page():
    page = "<article>" + "".join(f"<p>para {i} &amp; more</p>" for i in range(20000)) + "</article>"
    assert len(extraction.blocks(page)) == 20000


# 10 WARC


def pages(spark):
    html = "<p>" + "é" * 100 + "</p>"
    data = [(i, f"http://h/{i}", f"<p>{i}</p>" * 40) for i in range(50)] + [(60, "http://h/60", html), (55, "http://h/55\nx%y", html), (70, None, html), (80, "u", "short"), (81, "u", "short"), (90, "u", None), (91, "u", ""), (55, "http://h/55\nx%y", html), (None, "n", html), (95, "u", "z" * 3_000_000)]
    return spark.createDataFrame(data, "page_id long, url string, html string")


def test_warc_round_trip_over_small_splits(spark):
    df = pages(spark)
    manifest = warc.write(warc.decide(with_clashes(df)).repartition(3), common.scratch(spark, "test-warc"), file_bytes=2000)
    assert manifest.agg({"records": "sum"}).first()[0] == df.count()
    got = rows(warc.read_archives(manifest, split_bytes=97))
    assert len(got) == df.count() and len({(r["path"], r["start"]) for r in got}) == len(got)
    html = {r["page_id"]: r["html"] or "" for r in rows(df)}
    for r in got:
        raw = html[r["page_id"]].encode()
        assert r["payload_bytes"] == len(raw) and r["payload_digest"] == hashlib.sha256(raw).hexdigest()
        assert r["payload"] == (raw if r["record_type"] == "response" else None)
    kinds = sorted((-1 if r["page_id"] is None else r["page_id"], r["record_type"], r["refers_to"]) for r in got if r["page_id"] is None or r["page_id"] >= 55)
    assert kinds == [(-1, "revisit", 55), (55, "response", None), (55, "response", None), (60, "revisit", 55), (70, "revisit", 55), (80, "response", None), (81, "response", None), (90, "response", None), (91, "response", None), (95, "response", None)]
    assert {r["url"] for r in got if r["page_id"] == 55} == {"http://h/55%0Ax%y"} and [r["url"] for r in got if r["page_id"] == 70] == [None]


def test_damaged_records_are_never_lost_in_silence(spark):
    df = spark.createDataFrame([(i, f"http://h/a%20b?{i}", f"<p>{i}</p>" * 400) for i in range(6)], "page_id long, url string, html string")
    manifest = warc.write(warc.decide(df).coalesce(1), common.scratch(spark, "test-warc"))
    (path, size, _), good = manifest.collect()[0], rows(warc.read_archives(manifest))
    assert len({r["url"] for r in good}) == 6 and all("/a%20b?" in r["url"] for r in good)
    starts = sorted(r["start"] for r in good)
    with open(path.removeprefix("file://"), "rb") as f:
        raw = f.read()
    for kind, bad in (("crc", raw[: starts[3] - 6] + bytes([raw[starts[3] - 6] ^ 1]) + raw[starts[3] - 5 :]), ("cut", raw[: size - 40])):
        other = path.removeprefix("file://") + kind
        with open(other, "wb") as f:
            f.write(bad)
        named = spark.createDataFrame([("file://" + other, len(bad))], "path string, size long")
        for step in (97, 1 << 20):
            with pytest.raises(Exception, match="record at byte"):
                warc.read_archives(named, split_bytes=step).collect()
            got = rows(warc.read_archives(named, split_bytes=step, damaged="row"))
            lost = {r["start"] for r in got if r["record_type"] == "damaged"}
            assert lost == {starts[2] if kind == "crc" else starts[5]} and sorted(r["start"] for r in got) == starts


def test_revisits_name_the_record_they_refer_to(spark):
    said = warc.record(9, "u", "", "d" * 64, "revisit", 4).decode()
    first = warc.record(4, "v", "x", "d" * 64, "response", None).decode()
    assert re.search("WARC-Refers-To: <(.*)>", said)[1] == re.search("WARC-Record-ID: <(.*)>", first)[1] != re.search("WARC-Record-ID: <(.*)>", said)[1]


def test_warc_of_no_pages(spark):
    manifest = warc.write(warc.decide(pages(spark).limit(0)), common.scratch(spark, "test-warc"))
    assert rows(warc.read_archives(manifest)) == []


def test_members_are_owned_once_however_cut():
    raw, starts = b"", []
    for i in range(40):
        starts.append(len(raw))
        z = zlib.compressobj(6, wbits=31)
        body = warc.record(i, "u", f"text {i} " * (i * 30), "d", "response", None)
        raw += z.compress(body) + z.flush()
        if i % 7 == 0:
            raw += b"junk\x1f\x8b\x08junk"  # magic that begins no member
    for step in (1, 13, 1000, len(raw)):
        found = [at for a in range(0, len(raw), step) for at, _ in warc.members(io.BytesIO(raw), a, a + step)]
        assert found == starts


# components


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, k) for k in range(101, 150)] + [(7, 7), (200, 201), (201, 202), (202, 200), (500, 40)]
    got = {r["node"]: r["root"] for r in rows(components(spark.createDataFrame(edges, "u long, v long")))}
    assert all(got[i] == 0 for i in range(41)) and got[500] == 0
    assert all(got[k] == 100 for k in range(100, 150)) and got[201] == got[202] == 200
    assert rows(components(spark.createDataFrame([], "u long, v long"))) == []
