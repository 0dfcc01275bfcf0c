import base64
import hashlib
import zlib

import numpy as np
import pytest

from palaver.llm import packing, urls, warc
from palaver.llm.shared import Scratch, fresh_path

URLS = [
    ("http://A.Example.com/en/7817?x=1", "a.example.com", "/en/7817", "example.com/en/7", "allow"),
    ("http://m.example.com/en/1#f", "m.example.com", "/en/1", "com/en/", "block"),
    ("http://b.example.net/de/8", "b.example.net", "/de/8", "example.net/de/8", "block"),
    ("http://notexample.com/EN/7", "notexample.com", "/EN/7", None, "allow"),
    ("http://m.casino-win.example.org/", "m.casino-win.example.org", "/", None, "block"),
    ("http://casinos.example.org", "casinos.example.org", "", None, "allow"),
    ("http://example.com?u=http://x.net/de/", "example.com", "", None, "allow"),
    ("no scheme", "", "", None, "allow"), ("", "", "", None, "allow"), (None, "", "", None, "allow"),
]


@pytest.mark.parametrize("block", [200_000, 3])
def test_urls(spark, block):
    df = spark.createDataFrame([(i, u[0], "old") for i, u in enumerate(URLS)], "page_id long, url string, RULE string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.filter_urls(df, block=block).collect()}
    assert got == {i: u[1:] for i, u in enumerate(URLS)}
    assert urls.filter_urls(df.limit(0)).count() == 0


def test_rules_are_those_of_the_contract(spark):
    """block com/en/, allow example.com/en/7, allow net/de/, block example.net/de/8, block org/es/."""
    words = "block com/en/, allow example.com/en/7, allow net/de/, block example.net/de/8, block org/es/"
    assert [f"{v} {h}{p}" for v, h, p in urls.RULES] == words.split(", ")
    df = spark.createDataFrame([(1, "http://net/de/"), (2, "http://casino.net/de/xxx"), (3, "http://example.net/de/7"), (4, "http://example.net/de/8"), (5, "http://a.org/es/")], "page_id long, url string")
    got = sorted((r.page_id, r.rule, r.verdict) for r in urls.filter_urls(df).collect())
    assert got == [(1, "net/de/", "allow"), (2, "net/de/", "allow"), (3, "net/de/", "allow"), (4, "example.net/de/8", "block"), (5, "org/es/", "block")]
    import duckdb

    con = duckdb.connect()
    con.execute("create table pages as select * from (values (2, 'http://casino.net/de/xxx'), (4, 'http://example.net/de/8')) t(page_id, url)")
    assert sorted((r[0], r[3], r[4]) for r in con.execute(urls.SQL).fetchall()) == [(2, "net/de/", "allow"), (4, "example.net/de/8", "block")]


def test_hosts_are_closed(spark):
    rules = [urls.prefix_rule("block", "com", ""), urls.prefix_rule("allow", "Good.com", "/a")]
    df = spark.createDataFrame([(1, "http://com.evil.org/"), (2, "http://x.com"), (3, "http://good.com/ab"), (4, "http://good.com/A"), (5, "http://notgood.com/a"), (6, "x://com"), (6, "x://com"), (7, "http://com:80/")], "page_id long, url string")
    got = sorted((r.page_id, r.rule, r.verdict) for r in urls.filter_urls(df, rules=rules).fillna("-", ["rule"]).collect())
    assert got == [(1, "-", "allow"), (2, "com", "block"), (3, "good.com/a", "allow"), (4, "com", "block"), (5, "com", "block"), (6, "com", "block"), (6, "com", "block"), (7, "-", "allow")]


@pytest.mark.parametrize("pattern, url, fits", [
    ("||ads.", "http://ads.x.com/", True), ("||ads.", "http://my.ads.x.com/", True), ("||ads.", "http://loads.x.com/", False), ("||ads.", "http://x.com/ads.js", False),
    ("^pixel.gif|", "http://x.com/pixel.gif", True), ("^pixel.gif|", "http://x.com/pixel.gif?a", False), ("^pixel.gif|", "http://x.com/bigpixel.gif", False),
    ("?affiliate=", "http://x.com/?AFFILIATE=1", True), ("&affiliate=", "http://x.com/?affiliate=1", False), ("|//free-*-download.", "http://free-big-download.x/", True),
    ("^bet^", "http://x.com/bet", True), ("^bet^", "http://x.com/#bet", False), ("a*b", "http://x/a\nb", True), ("ab*", "http://x/cabd", True),
])
def test_patterns(spark, pattern, url, fits):
    rule = urls.pattern_rule(pattern)
    target = "//" + url.split("://", 1)[1].split("#")[0].lower()
    index = urls.Index([rule], urls.Counter())
    assert (index.pattern({"", *urls._TOKEN.findall(target)}, target) is not None) is fits


def test_many_rules_against_brute_force(spark):
    """Every rule tried on every URL, with tokens that most URLs and most rules share."""
    import random
    import re

    r = random.Random(3)
    words = ["com", "en", "www", "index", "example"] + [f"w{k}" for k in range(400)]
    word = lambda: r.choice(words[:5]) if r.random() < 0.4 else r.choice(words)
    seen = lambda: f"http{r.choice(('', 's'))}://" + ".".join(word() for _ in range(r.randint(1, 4))) + "".join(r.choice("/-_.") + word() for _ in range(r.randint(0, 4))) + r.choice(("", "/", "?" + word() + "=" + word(), "#" + word()))
    every = [seen() for _ in range(600)]
    rules = []
    for _ in range(5000):
        k = r.random()
        if k < 0.5:
            rules.append(urls.prefix_rule(r.choice(("block", "allow")), ".".join(word() for _ in range(r.randint(1, 3))), r.choice(("", "/", "/" + word(), "/" + word() + "/", "/" + word()[:2]))))
        else:
            body = "".join(r.choice(("^", "*", ".", "/", "-", "")) + word() for _ in range(r.randint(1, 3)))
            rules.append(urls.pattern_rule(r.choice(("", "", "@@")) + r.choice(("", "|", "||")) + body + r.choice(("", "^", "|", "*"))))
    rules.append(urls.pattern_rule("^*^"[:2] + "w3*7"))
    rows = urls.filter_urls(spark.createDataFrame(list(enumerate(every)), "page_id long, url string"), rules=rules).collect()
    for row in rows:
        rest = every[row.page_id].split("://")[1].split("#")[0]
        host, path = re.match("[^/?]*", rest)[0], re.match("[^/?]*([^?]*)", rest)[1]
        fits = [(len(x.name), x.name, x.verdict) for x in rules if x.prefix and re.match(x.regex, host + path)]
        shown = {x.verdict for x in rules if not x.prefix and re.search(x.regex, "//" + rest)}
        want = max(fits)[1:] if fits else (None, "allow" if "allow" in shown or not shown else "block")
        assert (row.host, row.path, row.rule, row.verdict) == (host, path, *want)
    assert len({row.rule for row in rows}) > 50 and {"allow", "block"} == {row.verdict for row in rows if row.rule is None}


def test_warc_round_trip(spark):
    big = "é" * 300_000
    rows = [(5, "http://a/", "x"), (3, None, "x"), (9, "http://b/\r\nc", "x"), (4, "u", None), (8, "v", ""), (None, "w", "x"), (10, "z", big), (11, "z", "y"), (11, "z", "x"), (6, "q", "y"), (6, "q", "y")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    scratch, path = Scratch(spark), fresh_path(spark, "test-warc")
    warc.write_warc(scratch, df, path)
    index = warc.build_index(spark, path)
    got = warc.read_records(index).collect()
    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    want = sorted((str(i), len((h or "").encode()), digest(h), *(("response", "") if i is None or first[h or ""] == i else ("revisit", str(first[h or ""])))) for i, _, h in rows)
    assert sorted((str(r.record_id), r.payload_bytes, r.payload_digest, r.record_type, "" if r.refers_to is None else str(r.refers_to)) for r in got) == want
    texts = {r.payload_digest: bytes(r.payload) for r in got if r.record_type == "response"}
    assert all(texts[digest(h)] == (h or "").encode() for _, _, h in rows)
    some = index.where("payload_digest = '%s'" % digest("y"))
    assert warc.read_records(some).count() == 3
    warc.write_warc(scratch, df.limit(0), empty := fresh_path(spark, "test-none"))
    assert warc.read_records(warc.build_index(spark, empty)).count() == 0


def test_member_ends_in_zero():
    for n in (0, 1, 255, 70_000, (1 << 24) + 5):
        z, out = warc.member(b"a" * n) + b"\0", b""
        while z:
            d = zlib.decompressobj(31)
            out, z = out + d.decompress(z), d.unused_data
        assert out == b"a" * n


def test_packing_round_trip(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["", None, "Hello  world\n\n\tx'll é ñ ß", "a <|endoftext|> b", "日本語     \x85 x\x1c y", "word " * 9000, "z" * 5000, "1234567 !!!"]
    df = spark.createDataFrame([(i, t, "u") for i, t in enumerate(texts)], "doc_id long, text string, start string")
    rows = packing.pack(df, with_ids=True).collect()
    assert len({r.sequence_id for r in rows}) == len(rows) and {r.offset for r in rows} == {0}
    for i, t in enumerate(texts):
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start)
        ids = exact.encode(t or "", add_special_tokens=False).ids + [1]
        assert [x for r in own for x in r.ids] == ids and {r.doc_tokens for r in own} == {len(ids)}
        assert all(r.length & (r.length - 1) == 0 and r.length <= 2048 and len(r.ids) == r.length for r in own)
        assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in own)
    assert packing.pack(df.limit(0)).count() == 0


@pytest.mark.parametrize("text", [" " * 2_000_000, "x" + "\t" * 1_100_000, "\n" * 1_200_000 + "y", "ab" * 600_000, "=" * 1_000_000 + " z"], ids=["spaces", "tabs", "lines", "letters", "signs"])
def test_packing_of_long_runs(spark, text):
    import public_tokenizers
    from tokenizers import Tokenizer

    ids = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode(text, add_special_tokens=False).ids + [1]
    rows = packing.pack(spark.createDataFrame([(1, text)], "doc_id long, text string"), with_ids=True).orderBy("start").collect()
    assert [x for r in rows for x in r.ids] == ids


@pytest.mark.parametrize("n", [1, 2047, 2048, 2049, 10_000])
def test_pieces_cover(n):
    at = 0
    for start, length in packing.pieces(n):
        assert start == at
        at += length
    assert at == n
