import hashlib
import re

import duckdb
import pytest

from strandloom.llm import exact_dedup, url_filter


def test_equal_groups(spark):
    rows = [(5, "a  b", "x"), (3, "a\tb", "x"), (9, "a b", "x"), (3, "a\nb", "x"), (1, None, "x"), (2, "", "x"), (None, "q", "x"), (None, "q", "x"), (4, "A b", "x"), (6, "é" * 50_000, "x"), (7, "é" * 50_000, "x"), (8, " a b", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, salt string")
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for d, t, _ in rows:
        groups.setdefault(norm(t), []).append(d)
    for salts in (1, 16):
        got = exact_dedup.exact_dedup(docs, salts=salts).collect()
        want = sorted(str((d, min((x for x in groups[norm(t)] if x is not None), default=None), len(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest())) for d, t, _ in rows)
        assert sorted(str((r.doc_id, r.keep_id, r.group_size, r.text_sha256)) for r in got) == want
        kept = {}
        for r in got:
            if r.kept:
                assert r.doc_id == r.keep_id
                kept[r.text_sha256] = kept.get(r.text_sha256, 0) + 1
        assert set(kept.values()) == {1} and len(kept) == len(groups)
    assert exact_dedup.exact_dedup(docs.limit(0)).count() == 0


def test_dedup_plan_has_no_python_and_one_text_shuffle(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = exact_dedup.exact_dedup(docs)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = con.sql(exact_dedup.ORACLE)
    order = sorted(got.columns)
    assert sorted(str([r[c] for c in order]) for r in got.collect()) == sorted(str([dict(zip(want.columns, r))[c] for c in order]) for r in want.fetchall())
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()


def test_verdicts(spark):
    urls = [None, "", "no scheme", "http://example.org/es/1?x", "HTTP://A.B.Example.ORG/en/12#t", "http://example.org/en/2", "http://x.com/fr/", "http://x.com/de/a", "http://x.com", "http://cheap-pills.example.com/de/", "http://www.cheap-pills.example.com/fr/1", "http://m.spam-farm.example.net?q=/de/", "http://notexample.org/es/", "http://Örg.com/de/ü", "a://b://c/", "http://org/"]
    pages = spark.createDataFrame([(i, u, "y") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(pages).collect()}
    for i, u in enumerate(urls):
        rest = (u or "").partition("://")[2] if "://" in (u or "") else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if c.isascii() else c for c in host)
        fits = [(k, v) for k, v in url_filter.RULES if (host == k[: k.index("/")] or host.endswith("." + k[: k.index("/")])) and path.startswith(k[k.index("/") :])]
        rule, verdict = max(fits, key=lambda r: len(r[0]), default=(None, None))
        listed = any(host == h or host.endswith("." + h) for h in url_filter.BLOCKED_HOSTS)
        assert got[i] == (host, path, rule, verdict or ("block" if listed else "allow")), u
    assert url_filter.filter_urls(pages.limit(0)).count() == 0


@pytest.mark.parametrize("digest", [lambda b: 7, lambda b: len(b) % 3])
def test_digest_collisions_change_nothing(tmp_path, digest):
    entries = url_filter.listed()
    plain, clash = tmp_path / "a", tmp_path / "b"
    plain.mkdir(), clash.mkdir()
    good = url_filter.Index(url_filter.write_index(entries, str(plain)))
    bad = url_filter.Index(url_filter.write_index(entries, str(clash), digest), digest)
    hosts = ["example.org", "a.cheap-pills.example.com", "x.com", "", "casino-win.example.org", "net"]
    paths = ["/en/1", "/fr/", "/de/", "", "", "/"]
    assert url_filter.judge(good, hosts, paths) == url_filter.judge(bad, hosts, paths)
    assert isinstance(good.digests, type(good.offsets)) and good.digests.filename  # memory-mapped


def test_index_of_a_table_is_that_of_the_list(spark):
    entries = url_filter.listed()
    table = spark.createDataFrame([(*e, 5) for e in entries] + [(None, "block", "list", 5)], "key string, verdict string, kind string, extra int")
    urls = ["https://a.example.org/es/x", "http://spam-farm.example.net", "x://com/de/1", None, "no url", "http://casino-win.example.com/" + "a" * 200000, "http://b.com/fr/", "http://b.com/fr/"]
    pages = spark.createDataFrame([(i % 6, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, host string")
    key = lambda rows: sorted(tuple(map(str, r)) for r in rows.collect())
    assert key(url_filter.filter_urls(pages, table)) == key(url_filter.filter_urls(pages)) and url_filter.filter_urls(pages).count() == len(urls)
    assert {r.verdict for r in url_filter.filter_urls(pages, table.limit(0)).collect()} == {"allow"}


def test_hosts_of_many_labels_cost_as_few_probes_as_any(tmp_path):
    index = url_filter.Index(url_filter.write_index(url_filter.listed(), str(tmp_path)))
    host = "a." * 100_000
    assert len(index.keys(host + "example.org", "/es/x")) <= index.labels * len(index.lengths) and index.labels == 3
    assert url_filter.judge(index, [host + "example.org", host + "spam-farm.example.net", host[:-1], "", "b.spam-farm.example.net"], ["/es/x", "/", "/", "/", ""]) == [("example.org/es/", "block"), (None, "block"), (None, "allow"), (None, "allow"), (None, "block")]
    (tmp_path / "none").mkdir()
    assert url_filter.judge(url_filter.Index(url_filter.write_index([], str(tmp_path / "none"))), [host], ["/"]) == [(None, "allow")]
