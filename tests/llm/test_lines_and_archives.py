import base64
import gzip
import glob
import hashlib
import io
import itertools
import random
import shutil
from collections import defaultdict

from pyspark.sql import functions as F

from lumenframe.llm import line_dedup, urls, warc
from util import SF, empty_documents, odd_documents

WS = " \t\n\x0b\x0c\r"


def brute_lines(rows):
    low = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    key = lambda l: l.strip(WS).translate(low)
    holders, top = defaultdict(set), {}
    rank = lambda i: (i is not None, i or 0)
    for i, text in rows:
        for k in {key(l) for l in (text or "").split("\n")}:
            if len(k) >= 40:
                holders[k].add(i)
                top[k] = max(top.get(k, i), i, key=rank)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        left = [l for l in lines if not (len(holders[key(l)]) >= 5 and top[key(l)] != i)]
        out.append((i, len(lines), len(lines) - len(left), hashlib.sha256("\n".join(left).encode()).hexdigest()))
    return sorted(out, key=str)


def result(df):
    return sorted(map(tuple, df.select("row.doc_id", "n_lines", "n_dropped", "kept_sha256").collect()), key=str)


def test_line_dedup_matches_brute_force(spark):
    for docs in (spark.read.parquet(f"{SF}/documents.parquet"), odd_documents(spark), empty_documents(spark)):
        rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        assert result(line_dedup.dedup_lines(docs)) == brute_lines(rows)


def test_rows_of_one_id_are_one_document(spark):
    line = "A line that is long enough to be looked for among all others."
    for ids, dropped in (([1, 2, 3, 4, 4], 0), ([1, 2, 3, 4, 5, 5], 4), ([1, 2, 3, None, None], 0), ([1, 2, 3, 4, None, None], 5)):
        docs = spark.createDataFrame([(i, line) for i in ids], "doc_id long, text string")
        assert result(line_dedup.dedup_lines(docs)) == brute_lines([(i, line) for i in ids])
        assert sum(r.n_dropped for r in line_dedup.dedup_lines(docs).collect()) == dropped


def test_line_dedup_is_exact_with_saturated_filters(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(5)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert result(line_dedup.dedup_lines(docs, most_bits=1 << 9)) == brute_lines(rows)


def test_line_dedup_keeps_other_columns(spark):
    docs = odd_documents(spark).withColumns({"row": F.lit("r"), "drops": F.lit(1), "n_lines": F.lit(None).cast("string"), "n_chars": F.lit(0).cast("long")})
    out = line_dedup.clean_documents(docs)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    assert all((r.row, r.drops, r.n_lines, r.shard, r.words, r.n_chars) == ("r", 1, None, 7, "x", len(r.text)) for r in out.collect())
    left = {r.doc_id: r.text for r in out.collect()}
    assert left[4] == "short" and left[9] == docs.where("doc_id = 9").first().text and left[1] == left[2] == ""


PAGES = [(1, "http://a/", "x"), (2, "http://b/", "x"), (3, None, None), (4, "http://c/\n", ""), (5, "http://d/", "é\r\n\r\nWARC/1.1\r\n"), (5, "http://d/", "é\r\n\r\nWARC/1.1\r\n"), (None, "http://e/", "x"), (None, "u", "only"), (None, "u", "only"), (7, "http://f/", "y" * 300_000)]


def brute_warc(rows):
    top = defaultdict(lambda: None)
    for i, html in rows:
        if i is not None:
            top[html or ""] = i if top[html or ""] is None else max(top[html or ""], i)
    out = []
    for i, html in rows:
        data, t = (html or "").encode(), top[html or ""]
        revisit = t is not None and t != i
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", t if revisit else None))
    return sorted(out, key=str)


def test_warc_round_trip(spark, tmp_path):
    real = spark.read.parquet(f"{SF}/pages.parquet")
    odd = spark.createDataFrame([(*r, "z") for r in PAGES], "page_id long, url string, html string, digest string")
    for k, pages in enumerate((real, odd, odd.limit(0))):
        rows = [(r.page_id, r.html) for r in pages.collect()]
        folder = str(tmp_path / str(k))
        assert warc.write_archives(pages, folder, file_bytes=20_000) == len(rows)
        got = warc.read_archives(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
        assert sorted(map(tuple, got), key=str) == brute_warc(rows)


def test_warc_records_are_separate_gzip_members(spark, tmp_path):
    pages = spark.createDataFrame(PAGES[:2], "page_id long, url string, html string").coalesce(1)
    warc.write_archives(pages, str(tmp_path))
    files = glob.glob(str(tmp_path / "*.warc.gz"))
    raw = b"".join(open(f, "rb").read() for f in files)
    assert raw.count(b"\x1f\x8b\x08") >= 2
    kinds = [h[b"warc-type"] for f in files for _, h, _ in warc.parse(io.BytesIO(gzip.open(f).read()))]
    assert sorted(kinds) == [b"response", b"revisit", b"warcinfo"]


def test_warc_revisits_refer_to_their_original_and_stale_files_are_not_read(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/", "x"), (2, "http://b/ c", "x")], "page_id long, url string, html string").coalesce(1)
    warc.write_archives(pages, str(tmp_path), date="2030-01-02T03:04:05Z")
    (file,) = glob.glob(str(tmp_path / "*.warc.gz"))
    heads = {h[b"warc-type"]: h for _, h, _ in warc.parse(io.BytesIO(gzip.open(file).read()))}
    first, again = heads[b"response"], heads[b"revisit"]
    assert again[b"warc-refers-to"] == first[b"warc-record-id"] and again[b"warc-refers-to-target-uri"] == first[b"warc-target-uri"] == b"http://b/c"
    assert again[b"warc-refers-to-date"] == again[b"warc-date"] == b"2030-01-02T03:04:05Z" and first[b"warc-record-id"].startswith(b"<urn:uuid:")
    shutil.copy(file, tmp_path / "part-99999-0000-stale.warc.gz")  # what a task that lost its executor may leave
    assert warc.read_archives(spark, str(tmp_path)).count() == 2


def test_warc_small_payloads_stay_responses(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], "page_id long, url string, html string")
    warc.write_archives(pages, str(tmp_path), min_bytes=3)
    got = {r.page_id: r.record_type for r in warc.read_archives(spark, str(tmp_path)).collect()}
    assert got == {1: "response", 2: "response", 3: "revisit", 4: "response"}


def test_url_rules_and_parts(spark):
    rows = [
        (1, "HTTP://A.Example.COM/en/7x?q#f"), (2, "http://example.com/en/8"), (3, "x://b.example.net/de/8/1"), (4, "x://b.example.net/de/9"), (5, "http://org/es/"),
        (6, "http://forg/es/"), (7, None), (8, "no scheme/en/"), (9, "http://É.com?x=/en/"), (10, "http://a.com/en/\n?x"), (1, "http://com#/en/"),
    ]
    pages = spark.createDataFrame([(*r, "k") for r in rows], "page_id long, url string, host string")
    labelled = spark.createDataFrame([], "url string, bad boolean")
    got = sorted((tuple(r)[:5] for r in urls.filter_urls(pages, labelled).collect()), key=str)
    want = [
        (1, "a.example.com", "/en/7x", "example.com/en/7", "allow"), (2, "example.com", "/en/8", "com/en/", "block"), (3, "b.example.net", "/de/8/1", "example.net/de/8", "block"),
        (4, "b.example.net", "/de/9", "net/de/", "allow"), (5, "org", "/es/", "org/es/", "block"), (6, "forg", "/es/", None, "allow"), (7, "", "", None, "allow"), (8, "", "", None, "allow"),
        (9, "É.com", "", None, "allow"), (10, "a.com", "/en/\n", "com/en/", "block"), (1, "com", "", None, "allow"),
    ]
    assert got == sorted(want, key=str)


def test_url_rules_are_mined_and_matched(spark):
    rows = [(f"http://{'pills' if i % 4 == 0 else 'news'}{i % 3}.shop.org/{'buy' if i % 2 == 0 else 'read'}/{i}", i % 4 == 0) for i in range(400)]
    labelled = spark.createDataFrame(rows, "url string, bad boolean")
    labelled = labelled.withColumn("url", F.regexp_replace("url", "(pills|news)\\d", "$1"))
    pages = labelled.select(F.monotonically_increasing_id().alias("page_id"), "url", "bad")
    got = urls.filter_urls(pages, labelled, rules=[]).join(pages.select("page_id", "bad"), "page_id").collect()
    assert all((r.verdict == "block") == r.bad for r in got)
    rules = urls.mine_rules(labelled).collect()
    assert ["host:pills"] in [r["items"] for r in rules]
    assert all(len(r["items"]) == 1 or "host:pills" not in r["items"] for r in rules)


def test_long_url_rules_and_high_base_rates(spark):
    # Only all four path words together are bad: each three of them are good far more often.
    words = ["casino", "win", "free", "now"]
    rows = [(f"http://h/{'/'.join(words)}", True)] * 40 + [(f"http://h/{'/'.join(w for w in words if w != x)}", False) for x in words] * 40
    labelled = spark.createDataFrame(rows, "url string, bad boolean")
    pages = labelled.select(F.monotonically_increasing_id().alias("page_id"), "url", "bad")
    got = urls.filter_urls(pages, labelled, rules=[]).join(pages.select("page_id", "bad"), "page_id").collect()
    assert len(got) == 200 and all((r.verdict == "block") == r.bad for r in got)
    assert [sorted(r["items"]) for r in urls.mine_rules(labelled).collect()] == [sorted(f"path:{w}" for w in words)]
    # Four of five labels are bad: a lift of 1.5 is out of reach, and the share of bad labels itself is no rule.
    rows = [("http://h/pills", True)] * 80 + [("http://h/news", False)] * 20
    labelled = spark.createDataFrame(rows, "url string, bad boolean")
    assert [(r["items"], r["confidence"]) for r in urls.mine_rules(labelled).collect()] == [(["path:pills"], 1.0)]


def test_rules_of_items_that_always_occur_together(spark):
    together = "/".join(f"w{i}" for i in range(11))
    labelled = spark.createDataFrame([(f"http://h/{together}", True)] * 30 + [("http://h/other", False)] * 30, "url string, bad boolean")
    assert sorted(r["items"] for r in urls.mine_rules(labelled).collect()) == sorted([f"path:w{i}"] for i in range(11))


def test_mined_verdicts_match_brute_force(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(7)]
    rows = []
    for _ in range(300):
        own = sorted(rng.sample(words, rng.randint(1, 5)))
        rows.append(("http://h/" + "/".join(own), rng.random() < (0.95 if {"w0", "w1"} <= set(own) else 0.1 if "w2" in own else 0.4)))
    rows += [(None, True), ("http://h/w0", None)]
    base = [(frozenset(u[9:].split("/")), b) for u, b in rows if u and b is not None]
    share = sum(b for _, b in base) / len(base)
    rules = {}
    for k in range(1, 8):
        for items in map(frozenset, itertools.combinations(words, k)):
            n, bad = sum(items <= u for u, _ in base), sum(items <= u and b for u, b in base)
            if bad >= 20 and bad / n >= 0.6 and bad / n > share and n < len(base):
                rules[items] = bad / n
    rules = {r: c for r, c in rules.items() if not any(q < r and d >= c for q, d in rules.items())}
    assert rules
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(rows)], "page_id long, url string")
    labelled = spark.createDataFrame(rows, "url string, bad boolean")
    got = {r.page_id: (r.verdict, r.mined_confidence) for r in urls.filter_urls(pages, labelled, rules=[]).collect()}
    for i, (u, _) in enumerate(rows):
        sure = [c for r, c in rules.items() if u and r <= set(u[9:].split("/"))]
        assert got[i] == (("block", round(max(sure), 6)) if sure else ("allow", None))
    assert {frozenset(x.removeprefix("path:") for x in r["items"]) for r in urls.mine_rules(labelled).collect()} == set(rules)
    assert urls.mine_rules(labelled.limit(15)).count() == 0  # fewer URLs than a rule needs
    assert urls.filter_urls(pages.limit(0), labelled).count() == 0
