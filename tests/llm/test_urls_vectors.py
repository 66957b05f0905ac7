"""URL filter and nearest neighbours against brute force; the pipeline; the registered queries."""

import re

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F
from steadymark.llm import neighbours, url_trust
from steadymark.llm.queries import all_queries


def host_path(url):
    if url is None or "://" not in url:
        return "", ""
    m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1])
    return re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]


URLS = [
    "http://A.Example.NET/en/1?x=://y", "https://example.net/en", "http://net/", "http://net", "ftp://bnet/x", "http://x.example.com/de/", "http://x.example.com/DE/",
    "//no.scheme/x", "x", "", None, "http://ÄÖ.org/fr/é#f", "http://org/fr/", "a://b://c/d", "http://h.example.org?q=/fr/", "http://m.net:80/", "http://n\nl.net/x\ny",
]


def test_rules(spark):
    pages = spark.createDataFrame([(i, u, None, 5) for i, u in enumerate(URLS)], "page_id bigint, url string, html string, rank int")
    got = {r.page_id: r for r in url_trust.judge(pages).collect()}
    for i, url in enumerate(URLS):
        host, path = host_path(url)
        fits = [r for r in url_trust.RULES if (host == r.host or host.endswith(f".{r.host}")) and path.startswith(r.path)]
        rule = max(fits, key=lambda r: len(r.name), default=None)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule and rule.name), url
        assert got[i].verdict == (rule.verdict if rule else got[i].verdict) and got[i].verdict in ("allow", "block")
    assert got[10].verdict == got[9].verdict == "allow"
    assert url_trust.judge(pages.limit(0)).count() == 0


def test_distrust_follows_links_backwards(spark):
    link = lambda *urls: "".join(f"<a href='{u}'>x</a>" for u in urls)
    pages = spark.createDataFrame(
        [(1, "http://bad.net/x", link("http://farm.example.io/")), (2, "http://farm.example.io/1", link("http://bad.net/a", "//bad.net/b")), (3, "http://good.org/fr/1", link("http://friend.io/")),
         (4, "http://friend.io/1", link("/local", "http://good.org/x")), (5, "http://lone.io/", ""), (5, "http://lone.io/", "")], "page_id bigint, url string, html string")
    got = url_trust.judge(pages).collect()
    verdict = {r.page_id: r.verdict for r in got}
    assert len(got) == 6 and verdict == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow"}
    trust = {r.host: r.trust for r in got}
    assert trust["friend.io"] > 0 == trust["lone.io"]


def nearest_by_brute_force(rows, every, k):
    best = {}
    for i, v in rows:
        ok = i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)
        if ok and (i, len(v)) not in best or ok and v < best[i, len(v)]:
            best[i, len(v)] = v
    out = set()
    for (q, dim), v in best.items():
        if q % every == 0:
            others = sorted((float(np.sqrt(((np.array(w, float) - np.array(v, float)) ** 2).sum())), i) for (i, d), w in best.items() if d == dim and i != q)
            out |= {(q, rank + 1, i, score) for rank, (score, i) in enumerate(others[:k])}
    return out


@pytest.mark.parametrize("size", [(8192, 2048), (40, 5)])
def test_nearest(spark, monkeypatch, size):
    monkeypatch.setattr(neighbours, "STRIPE_ROWS", size[0])
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", size[1])
    monkeypatch.setattr(neighbours, "TILE", 16)
    rng = np.random.default_rng(4)
    rows = [(i, [float(np.float32(x)) for x in rng.standard_normal(12) * 10.0 ** rng.integers(-3, 3)]) for i in range(-30, 270)]
    rows += [(i, rows[5][1]) for i in range(300, 330)] + [rows[7], (7, rows[60][1]), (400, None), (401, []), (402, [0.0] * 12), (403, [None] * 12), (404, [float("nan")] + [1.0] * 11), (405, [float("inf")] + [1.0] * 11), (None, rows[0][1]), (410, [1.0, 2.0]), (411, [1.0, 3.0])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id bigint, embedding array<float>, dim int, block int").repartition(4)
    got = {tuple(r) for r in neighbours.nearest(df, F.col("vec_id") % 10 == 0).collect()}
    assert got == nearest_by_brute_force(rows, 10, 10)
    assert neighbours.nearest(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(5)
    a, b = (rng.standard_normal((30, 1500)) * rng.lognormal(0, 3, (30, 1)) for _ in range(2))
    low, high = neighbours.squared_bounds(neighbours.Tile(a), neighbours.Tile(b))
    true = ((a[:, None] - b[None]) ** 2).sum(axis=2)
    assert (low <= true).all() and (true <= high).all()


def test_pipeline(spark, docs, no_docs, sf_dir):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    for start in (docs, no_docs):
        df = start
        for _, stage in corpus_pipeline.STAGES[:-1]:
            df = stage(spark, df, sf_dir)
            assert df.columns == docs.columns
        assert corpus_pipeline.STAGES[-1][1](spark, df, sf_dir).count() >= 0
    clean = spark.read.parquet(f"{sf_dir}/documents.parquet")
    packed = corpus_pipeline.run(spark, sf_dir)
    assert 0.8 * clean.count() < packed.select("doc_id").distinct().count() <= clean.count()


def test_registered_queries():
    names = set(all_queries())
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in names} == set(range(1, 14))
