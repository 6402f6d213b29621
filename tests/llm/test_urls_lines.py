"""URL rules and site-relative lines against plain loops."""

import math
import random
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from hinloom.llm import lines, urls

ENTRIES = [
    ("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"),
    ("block", "bare.net"), ("allow", "a.bare.net/x"), ("allow", "same.io/"), ("block", "same.io/"),
]


def plain(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:].split("?", 1)[0].split("#", 1)[0]
    best = None
    for verdict, entry in ENTRIES:
        h, slash, p = entry.partition("/")
        p = slash + p
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            best = max(best or (0,), (len(h + p), len(h), verdict == "block", h + p, verdict))
    return host, path, best and best[3], best[4] if best else "allow"


URLS = [
    None, "", "no scheme", "http://", "http:///x", "https://EXAMPLE.org/es/1", "http://x.example.org/en/12?a=1", "http://example.org/en/2",
    "http://example.org", "http://example.org?x=/es/", "http://example.org#/es/", "ftp://foo.com/fr/", "http://foo.com/de", "http://com/de/",
    "http://notexample.org/es/", "http://a.b.c.bare.net:80/x", "http://z.a.bare.net/xy", "http://bare.net", "http://same.io/q",
    "http://u@h.org/p://q", "http://É.org/", "a://b://c.org/", "http://x.org/\n/y", "http://" + "a." * 3000 + "org/", "http://x.com" + "/fr" * 3000,
]


def test_rules_equal_a_loop(spark):
    rows = [(i, u, "h", "r") for i, u in enumerate(URLS + URLS[:4])]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, rule string")
    got = urls.judge(pages, urls.rules(spark, ENTRIES)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(((i, *plain(u)) for i, u, _, _ in rows), key=str)


def test_empty_pages_and_rules(spark):
    pages = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")
    assert urls.judge(pages.limit(0), urls.rules(spark, ENTRIES)).count() == 0
    none = urls.rules(spark, ENTRIES).limit(0)
    assert [tuple(r) for r in urls.judge(pages, none, "block").collect()] == [(1, "a.org", "/", None, "block")]


def test_filter_has_no_false_negatives_and_few_false_hits(spark):
    listed = spark.range(4000).selectExpr("concat('h', id, '.org') as rule_host", "'/' as rule_path")
    blocks = 1000
    filter_ = urls.bloom_filter(listed, blocks).collect()
    words = {r.block: r.word for r in filter_}
    block, mask = urls._block_and_mask(F.col("rule_host"), F.col("rule_path"), blocks)
    probe = lambda df: [(r.b, r.m) for r in df.select(block.alias("b"), mask.alias("m")).collect()]
    assert all(words[b] & m == m for b, m in probe(listed))
    others = listed.selectExpr("concat('x', rule_host) as rule_host", "rule_path")
    assert sum(words.get(b, 0) & m == m for b, m in probe(others)) < 200


def plain_lines(rows, ratio=lines.RATIO, margin=lines.MARGIN, weights=None):
    """Loops over pages; ``weights`` of `plain_weights` makes copies weigh one page."""
    total, seen = Counter(), Counter()
    for _, s, t in rows:
        own = {y.strip(" \t\r") for y in (t or "").split("\n")} - {""}
        weight = (weights or {}).get((s or "", sketch(own)), lines.WHOLE)
        total[s or ""] += weight
        for x in own:
            seen[s or "", x] += weight
    bad = {k for k, n in seen.items() if n / lines.WHOLE - margin * math.sqrt(n / lines.WHOLE) > ratio * (total[k[0]] / lines.WHOLE)}
    out = []
    for i, s, t in rows:
        own = [] if t is None else t.split("\n")
        kept = [x for x in own if (s or "", x.strip(" \t\r")) not in bad]
        out.append((i, s, None if t is None else "\n".join(kept), len(own), len(own) - len(kept)))
    return out


def sketch(own):
    """Least hash of a set of lines per coordinate, as Spark's `xxhash64` of the line and of its hash and a number."""

    def chained(h, c):
        n = xxhash.xxh64_intdigest(c.to_bytes(4, "little"), xxhash.xxh64_intdigest(h.to_bytes(8, "little"), 42))
        return n - (1 << 64) if n >> 63 else n

    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in own]
    return tuple(min(chained(h, c) for h in hashes) for c in range(lines.COORDINATES)) if own else None


def plain_weights(rows):
    """Middle one of the numbers of pages that agree in a least hash."""
    sketches = [(s or "", sketch({y.strip(" \t\r") for y in (t or "").split("\n")} - {""})) for _, s, t in rows]
    sketches = [k for k in sketches if k[1]]
    shared = Counter((s, c, v) for s, own in sketches for c, v in enumerate(own))
    out = {}
    for s, own in sketches:
        middle = sorted(shared[s, c, v] for c, v in enumerate(own))[lines.COORDINATES // 2]
        if middle > 1:
            out[s, own] = lines.WHOLE // middle
    return out


def line_rows():
    draw = random.Random(2)
    rows = []
    for i in range(400):
        site = draw.choice(["hot"] * 6 + ["b", "c", None, ""])
        body = [f"line {draw.randrange(10**6)}" for _ in range(draw.randrange(6))]
        if draw.random() < 0.3:
            body.insert(0, draw.choice(["  Menu", "Menu\r", "Menu"]))
        if draw.random() < 0.06:
            body.append("rare footer")
        body += ["", "  "] * draw.randrange(2) + body[:1]
        rows.append((i, site, "\n".join(body)))
    rows += [(500, "hot", None), (501, "few", "Menu"), (502, "hot", ""), (503, "hot", "x\n" * 20000 + "Menu")]
    return rows + rows[:5]


def test_lines_equal_a_loop(spark):
    rows = line_rows()
    df = spark.createDataFrame([(*r, 9, "p") for r in rows], "doc_id long, source string, text string, n_lines int, `a.b` string")
    got = lines.drop_boilerplate(df)
    assert got.columns == ["doc_id", "source", "a.b", "text", "n_lines", "n_dropped"]
    got = [(r.doc_id, r.source, r.text, r.n_lines, r.n_dropped) for r in got.collect()]
    want = plain_lines(rows)
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sum(w[4] for w in want) > 50


def test_no_pages(spark):
    df = spark.createDataFrame([(1, "s", "t")], "doc_id long, source string, text string")
    assert lines.drop_boilerplate(df.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["InPandas", "Python", "Arrow"])
def test_lines_are_native(spark, name):
    df = spark.createDataFrame([(1, "s", "t")], "doc_id long, source string, text string")
    weights = lines.page_weights(df)
    for cut in (lines.drop_boilerplate(df), lines.drop_boilerplate(df, weights=weights)):
        assert name not in cut._jdf.queryExecution().optimizedPlan().toString()


def prose(draw):
    return " ".join(f"w{draw.randrange(10**6)}" for _ in range(9))


@pytest.mark.parametrize("total", [2, 4, 5, 62, 63, 500])
def test_one_rule_for_sites_of_any_size(spark, total):
    """A line goes from the same count on as by the formula; the count rises with the site, without a jump."""
    draw = random.Random(total)
    least = next(n for n in range(1, 600) if n - lines.MARGIN * math.sqrt(n) > lines.RATIO * total)
    rows = [(i, "s", "\n".join([*["at least"] * (i < least), *["one less"] * (i < least - 1), prose(draw)])) for i in range(total)]
    got = lines.boilerplate(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()
    assert [r.line for r in got] == ["at least"] * (least <= total)


@pytest.mark.parametrize("share", [0.01, 0.02, 0.05])
def test_planted_lines_go_and_ordinary_ones_stay(spark, share):
    draw = random.Random(3)
    long = " ".join(f"p{k}" for k in range(60))
    rows, step = [], round(1 / share)
    for i in range(2000):
        body = [prose(draw) for _ in range(5)] + ["Yes."] * (i % 400 == 0)
        rows.append((i, "s", "\n".join([*body, *["All rights reserved"] * (i % step == 0), *[long] * (i % step == 1)])))
    cut = lines.drop_boilerplate(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()
    gone = {i: t for i, _, t in rows}
    for r in cut:
        assert r.text == "\n".join(x for x in gone[r.doc_id].split("\n") if x not in ("All rights reserved", long))


def test_weights_equal_a_loop(spark):
    rows = [(1000 + k, *r[1:]) for k, r in enumerate(line_rows())]
    body = [f"text of line {k}" for k in range(12)]
    rows += [(i, f"s{i % 2}", "\n".join([*body, f"own {i}"])) for i in range(80)]
    got = lines.page_weights(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()
    assert {(r.site, tuple(r.sketch)): r.weight for r in got} == plain_weights(rows)


def test_weights_of_no_pages(spark):
    df = spark.createDataFrame([(1, "s", None), (2, "s", "")], "doc_id long, source string, text string")
    weights = lines.page_weights(df)
    assert weights.count() == 0 and lines.drop_boilerplate(df, weights=weights).count() == 2
