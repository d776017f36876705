"""Rules against a plain version, trees on held-out URLs."""

import math
import random
import re

from pyspark.sql import functions as F

from arbora.llm import queries, url_filter


def _plain(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1], m[2]) if m else ("", "")
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in queries.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.text), default=None)
    return host, path, best.text if best else None, best.verdict if best else None


ODD = [
    None, "", "no scheme", "://", "x://NET", "x://NET/", "http://a.net?x=/", "http://EXAMPLE.net/en/1", "http://notexample.net/en/",
    "http://example.com/de/x#y", "http://example.com/de", "http://a.b.org/fr/?q", "http://ÄÖ.org/fr/ ü", "http://u:p@x.net:80/", "a://b://c.net/",
    "http://evil.org/\nfr/", "ftp://org/fr/",
]


def test_rules_and_clashing_columns(spark):
    rows = [(n, u, "own", 1.0) for n, u in enumerate(ODD + ODD)]
    df = spark.createDataFrame(rows, "page_id BIGINT, url STRING, verdict STRING, Features DOUBLE")
    got = url_filter.judge(df, queries.RULES, None)
    assert got.columns == ["page_id", "url", "Features", "host", "path", "rule", "verdict", "block_score"]
    for r in got.collect():
        host, path, rule, verdict = _plain(r.url)
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict or "allow")


def test_trees_judge_unseen_urls(spark):
    rng = random.Random(3)
    good = [f"https://{rng.choice(['news', 'wiki', 'blog'])}{n}.example.org/a/{n % 7}" for n in range(300)]
    bad = [f"http://win-{n}-cash-{n * 7}.example.org/p?id={n}&ref={n * 3}&x=1" for n in range(300)]
    rows = [(u, int(k)) for k, us in enumerate((good, bad)) for u in us]
    df = spark.createDataFrame(rows, "url STRING, blocked INT")
    test = F.pmod(F.crc32(F.col("url").cast("binary")), F.lit(3)) == 0
    model = url_filter.train(df.filter(~test))
    got = url_filter.judge(df.filter(test).withColumn("features", F.lit("own")), [], model).collect()
    assert sum((r.verdict == "block") == bool(r.blocked) for r in got) / len(got) > 0.95
    odd = url_filter.judge(spark.createDataFrame([(u,) for u in ODD], "url STRING"), [], model).collect()
    assert len(odd) == len(ODD) and all(0 <= r.block_score <= 1 for r in odd)
    assert url_filter.judge(df.limit(0), [], model).count() == 0


def test_no_model_without_both_labels(spark):
    one = spark.createDataFrame([("http://a/", 1), (None, 0)], "url STRING, blocked INT")
    assert url_filter.train(one) is None


def test_query_follows_the_rules(spark, sf):
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = queries.op2_boosted_urls(spark, sf).collect()
    assert {r.page_id for r in got} == set(urls) and len(got) == len(urls)
    for r in got:
        host, path, rule, verdict = _plain(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (verdict or ("block" if r.block_score >= 0.5 else "allow"))


def test_suffixes_count_all_labelled_urls(spark):
    urls = [(f"http://h{n}.s{n % 50}/p", n % 50 % 2) for n in range(2000)]
    model = url_filter.train(spark.createDataFrame(urls, "url STRING, blocked INT"), most_urls=40)
    counted = {r.suffix: round(math.expm1(r.log_n)) for r in model.suffixes.collect()}
    assert [counted.get(f"s{n}") for n in range(50)] == [40] * 50 and model.rate == 0.5
