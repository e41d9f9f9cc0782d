"""Mixing, URL filter, quality, toxicity, passages and the pipeline on small tables."""

import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewarden.llm import common, mixing, quality, substring_dedup, toxicity, url_filter

LABELS = "doc_id long, quality int, toxic int"
PAGES = "page_id long, url string, html string"


def on_duckdb(sql, folder, *tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    return sorted(map(str, con.execute(sql).fetchall()))


def rows_of(df, *columns):
    return sorted(str(tuple(r)) for r in df.select(*columns).collect())


def test_mixing_equals_sql_with_nulls_ties_and_copies(spark, write_docs):
    rng = random.Random(1)
    rows = [(i, " ".join(["w"] * rng.randint(0, 30)), rng.choice(["en", "de", None, "xx"]), rng.choice(["src1", "src12", "src3", None])) for i in range(200)]
    rows += [(7, "again and again", "en", "src1"), (7, "again and again", "en", "src1"), (None, "no id", "en", "src1"), (900, None, "en", "src1"), (901, " \n", "fr", "src9")]
    folder = write_docs(rows)
    got = rows_of(mixing.op8_hierarchical_mixing(spark, folder), "doc_id", "domain", "lang", "source", "n_tokens", "epoch")
    assert got and got == on_duckdb(mixing.mixing_sql(), folder, "documents")


def test_budgets_fill_siblings_before_ancestors(spark):
    rows = [("crawl", "en", "src0", 10), ("crawl", "en", "src1", 1000), ("crawl", "de", "src0", 1000), ("curated", "en", "src10", 1000)]
    df = spark.createDataFrame(rows, "domain string, lang string, source string, n_tokens long")
    mix = mixing.Mix(domains={"crawl": 0.5, "curated": 0.5}, langs={"en": 0.5, "de": 0.5}, budget=400 / 3010, epochs=1)
    got = {(r["lang"], r["source"]): r["budget"] for r in mixing.budgets(df, mix).collect()}
    # src0 gives 10 of its 50; src1 takes the rest of en's 100, and neither de nor curated changes.
    assert got == {("en", "src0"): 10, ("en", "src1"): 90, ("de", "src0"): 100, ("en", "src10"): 200}


def test_mixing_nothing(spark, write_docs):
    assert mixing.op8_hierarchical_mixing(spark, write_docs([])).collect() == []


URLS = [
    ("https://WWW.Example.com/en/x?q#f", "www.example.com", "/en/x", "www.example.com/en/", "allow"),
    ("http://a.example.com/en/", "a.example.com", "/en/", "example.com/en/", "block"),
    ("http://example.com/e", "example.com", "/e", "com/", "allow"),
    ("http://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"),
    ("http://com", "com", "", None, None),
    ("ftp://x.net/fr/1://y", "x.net", "/fr/1://y", "net/fr/", "block"),
    ("x.net/es/", "", "", None, None),
    ("http://É.net/es", "É.net", "/es", None, None),
    ("http://h.org?x=/y", "h.org", "", None, None),
    ("http://a.com:80/en/", "a.com:80", "/en/", None, None),
    ("", "", "", None, None),
    (None, "", "", None, None),
    ("a\nb://H.Org/p\nq?r", "h.org", "/p\nq", None, None),
]


def test_urls_and_reputation_equal_sql(spark, write_docs):
    rng = random.Random(2)
    pages = [(i, u, "") for i, (u, *_) in enumerate(URLS)] + [(100 + i, f"http://h{i % 7}.bad{i % 2}.org/", "") for i in range(200)]
    labels = [(p, 0 if "bad1" in (u or "") and rng.random() < 0.8 else 1, None if rng.random() < 0.1 else 0) for p, u, _ in pages if rng.random() < 0.7] + [(101, None, None), (101, 1, 1), (None, 1, 1)]
    folder = write_docs([], pages=(pages, PAGES), labels=(labels, LABELS))
    out = url_filter.op10_url_filter(spark, folder)
    columns = ("page_id", "host", "path", "rule", "verdict")
    assert rows_of(out, *columns) == on_duckdb(url_filter.OP10_SQL, folder, "pages", "labels")
    got = {r["page_id"]: r for r in out.collect()}
    for i, (_, host, path, rule, verdict) in enumerate(URLS):
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule)
        assert verdict is None or got[i]["verdict"] == verdict
    verdicts = {h: {r["verdict"] for r in got.values() if h in r["host"]} for h in ("bad0", "bad1")}
    assert verdicts == {"bad0": {"allow"}, "bad1": {"block"}}


SITES = [
    ("a.b.com", "a.b.com", "com", "b.com"),
    ("a.b.com:8080", "a.b.com", "com", "b.com"),
    ("me:x@a.b.com:", "a.b.com", "com", "b.com"),
    ("a.b.com.", "a.b.com", "com", "b.com"),
    ("a.b.co.uk", "a.b.co.uk", "co.uk", "b.co.uk"),
    ("x.gob.mx:1", "x.gob.mx", "gob.mx", "x.gob.mx"),
    ("co.uk", "co.uk", "co.uk", "co.uk"),
    ("taco.uk", "taco.uk", "uk", "taco.uk"),
    ("a.co.com", "a.co.com", "com", "co.com"),
    ("10.0.0.7:80", "10.0.0.7", "#address", "10.0.0.7"),
    ("[::1]:80", "[::1]", "#address", "[::1]"),
    ("1.2.3.com", "1.2.3.com", "com", "3.com"),
    ("localhost", "localhost", "localhost", "localhost"),
    ("", "", "", ""),
]


def test_sites_of_hosts(spark):
    df = spark.createDataFrame([(h,) for h, *_ in SITES], "host string").withColumn("site", url_filter.site_of(F.col("host")))
    got = df.select("host", "site", url_filter.suffix_of(F.col("site")), url_filter.domain_of(F.col("site"))).collect()
    assert [tuple(r) for r in got] == SITES


def test_ports_share_a_reputation_and_addresses_do_not(spark, write_docs):
    hosts = [f"http://bad.org:{k}/" for k in range(40)] + ["http://10.0.0.7/"] * 40 + ["http://11.0.0.7/"] * 40 + [f"http://s{k}.fine.co.uk/" for k in range(40)]
    pages = [(i, u, "") for i, u in enumerate(hosts)] + [(900, "http://bad.org./new", ""), (901, "http://me@10.0.0.7:81/", ""), (902, "http://11.0.0.7:9/", "")]
    labels = [(i, int(not ("bad" in u or "10.0" in u)), 0) for i, u in enumerate(hosts)]
    folder = write_docs([], pages=(pages, PAGES), labels=(labels, LABELS))
    out = url_filter.op10_url_filter(spark, folder)
    columns = ("page_id", "host", "path", "rule", "verdict")
    assert rows_of(out, *columns) == on_duckdb(url_filter.OP10_SQL, folder, "pages", "labels")
    got = {r["page_id"]: r["verdict"] for r in out.collect()}
    assert (got[0], got[900], got[901], got[902], got[130]) == ("block", "block", "block", "allow", "allow")


def test_no_pages_and_no_labels(spark, write_docs):
    folder = write_docs([], pages=([], PAGES), labels=([], LABELS))
    assert url_filter.op10_url_filter(spark, folder).collect() == []
    folder = write_docs([], pages=([(1, "http://x.org/", "")], PAGES), labels=([], LABELS))
    assert [r["verdict"] for r in url_filter.op10_url_filter(spark, folder).collect()] == ["allow"]


def corpus(n=400, seed=3):
    """Texts of invented words; a third of the labelled ones are toxic, some in disguise."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices(["re", "th", "an", "er", "ti", "on", "lo", "sta", "me"], k=rng.randint(1, 4))) for _ in range(500)]
    insults = ["idiot", "moron", "stupid", "loser"]
    disguised = ["1d10t", "m0r0n", "st.u.p.i.d", "l o s e r", "idiooooot", "$tupid"]
    rows, labels = [], []
    for i in range(n):
        words = rng.choices(vocabulary, k=rng.randint(20, 80))
        toxic = i % 3 == 0
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(insults))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    hidden = [(n + k, " ".join([*rng.choices(vocabulary, k=30), d, *rng.choices(vocabulary, k=9), d, rng.choice(vocabulary)])) for k, d in enumerate(disguised)]
    return rows, labels, hidden


def test_toxicity_held_out_and_disguised(spark, write_docs):
    rows, labels, hidden = corpus()
    edge = [(9000, None), (9001, ""), (9002, "!!! ... 123"), (9003, "1d10t" * 2000), (None, "no id here")]
    folder = write_docs(rows + hidden + edge, labels=(labels + [(9000, None, None), (5, None, None)], LABELS))
    got = {r["doc_id"]: r for r in toxicity.op9_toxicity(spark, folder).collect()}
    assert len(got) == len(rows + hidden + edge) and all(0 <= r["score"] <= 1 for r in got.values())
    held = [i for i, *_ in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    assert {i for i, r in got.items() if r["held_out"]} >= set(held)
    right = [got[i]["predicted"] == (i % 3 == 0) for i in held]
    assert sum(right) / len(right) > 0.97
    assert all(got[i]["predicted"] == 1 for i, _ in hidden), [(t, got[i]["score"]) for i, t in hidden]
    assert got[9000]["score"] == got[9001]["score"] == min(r["score"] for r in got.values())


def test_toxicity_without_labels(spark, write_docs):
    folder = write_docs([(1, "text")], labels=([], LABELS))
    assert [(r["score"], r["predicted"]) for r in toxicity.op9_toxicity(spark, folder).collect()] == [(0.0, 0)]
    assert toxicity.op9_toxicity(spark, write_docs([], labels=([], LABELS))).collect() == []


def test_quality_on_held_out_labels(spark, write_docs):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(400):
        good = i % 4 != 0
        words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 8))) for _ in range(rng.randint(20, 60))]
        rows.append((i, " ".join(words).capitalize() + "." if good else " ".join(f"{w.upper()}!!" for w in words[:6] * 6), "en", f"src{i % 3 if good else i % 2 + 5}"))
        if i % 10 < 7:
            labels.append((i, int(good), 0))
    rows += [(900, None), (901, ""), (None, "no id"), (3, rows[3][1], "en", "src0")]
    folder = write_docs(rows, labels=(labels + [(5, None, 1)], LABELS), pages=([(1, "http://x.org/a/b", ""), (2, None, "")], PAGES))
    found = [r for r in quality.op6_quality_cotraining(spark, folder).collect()]
    assert len(found) == len(rows)
    got = {r["doc_id"]: r for r in found}
    unseen = [i for i in range(400) if i % 10 >= 7]
    assert np.mean([got[i]["keep"] == int(i % 4 != 0) for i in unseen]) > 0.97
    empty = write_docs([], labels=([], LABELS), pages=([], PAGES))
    assert quality.op6_quality_cotraining(spark, empty).collect() == []


def passages(seed=6):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=6))
    fresh = lambda n: [word() for _ in range(n)]
    shared, other = fresh(80), fresh(60)
    fuzzy = list(shared)
    fuzzy[37] = word()
    del fuzzy[60]
    rows = {
        1: fresh(30) + shared + fresh(20),
        2: fresh(100),
        5: fresh(11) + fuzzy + fresh(50) + other + fresh(3),
        9: shared + fresh(70),
        12: fresh(40) + other,
        13: fresh(60) + shared[:40] + fresh(30),
        14: other[:30] + fresh(40),
        20: other + other,
    }
    return {k: " ".join(v) for k, v in rows.items()}


def test_passages(spark, write_docs):
    texts = passages()
    rows = [*texts.items(), (30, None), (31, ""), (32, "for " * 300), (33, "of " * 10 + "for " * 300), (9, texts[9]), (None, texts[1])]
    got = substring_dedup.op2_substring_dedup(spark, write_docs(rows)).collect()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append((r["start_word"], r["end_word"], r["source_id"]))
    assert set(by) == {5, 9, 12, 20, 33}
    assert (11, 90, 1) in by[5] and (0, 80, 1) in by[9] and (40, 100, 5) in by[12] and (0, 60, 5) in by[20]
    assert all(r["similarity"] >= 0.8 and r["source_id"] < r["doc_id"] for r in got)


def test_cutting(spark, write_docs):
    texts = passages()
    docs = common.table(spark, write_docs(list(texts.items())), "documents")
    out = {r["doc_id"]: r["text"] for r in substring_dedup.removed(docs).collect()}
    assert {k for k in texts if out[k] != texts[k]} == {5, 9, 12, 20}
    assert out[9] == " ".join(texts[9].split()[80:]) and out[12] == " ".join(texts[12].split()[:40]) + " "
    assert substring_dedup.without("a  b\nc d ", [1], [3]) == "a  d " and substring_dedup.without("a b", [0], [9]) == ""


def test_chains_equal_plain_dynamic_programming():
    rng = random.Random(8)
    for _ in range(300):
        anchors = sorted({(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(rng.randint(1, 25))})
        pos, spos = (np.array(x) for x in zip(*anchors, strict=True))

        def value(chain):
            gap = sum(substring_dedup.GAP_COST * (pos[b] - pos[a] + spos[b] - spos[a]) for a, b in zip(chain, chain[1:]))  # noqa: B905
            return len(chain) - gap

        best = [1.0] * len(anchors)
        for i, (p, s) in enumerate(anchors):
            for j in range(i):
                if anchors[j][0] < p and anchors[j][1] < s:
                    best[i] = max(best[i], best[j] + 1 - substring_dedup.GAP_COST * (p - anchors[j][0] + s - anchors[j][1]))
        chain = substring_dedup.best_chain(pos, spos)
        assert all(anchors[a][0] < anchors[b][0] and anchors[a][1] < anchors[b][1] for a, b in zip(chain, chain[1:]))  # noqa: B905
        if not ((np.diff(spos) > 0).all() and (np.diff(pos) > 0).all()):
            assert value(chain) == pytest.approx(max(best))


def test_pipeline(spark, write_docs):
    import corpus_pipeline

    rows, labels, hidden = corpus(200, 9)
    clean = [(i, t) for i, t in rows if i % 3]
    near = (700, clean[0][1] + " tail")
    copy = (701, clean[1][1])
    texts = passages()
    more = [(800 + k, t) for k, t in texts.items()]
    full = [(*r, "en", f"src{r[0] % 3}", len(r[1])) for r in [*rows, near, copy, *more]] + [(950, None, None, None, None), (None, "alone without an id", "en", "src1", 3)]
    folder = write_docs(full, labels=(labels, LABELS))
    docs, seen = common.table(spark, folder, "documents").withColumns({c: F.lit(9) for c in ("predicted", "cuts", "fp", "h", "full", "last", "epoch", "domain", "key", "part")}), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = common.written(stage(spark, docs, folder), name)
        if name != "packing":
            assert docs.columns == columns and docs.where("predicted != 9 OR cuts != 9 OR domain != 9").count() == 0
            seen[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
            assert docs.count() == len(seen[name])
    assert not any(i % 3 == 0 for i in seen["toxicity"] if i is not None and i < 200)
    assert set(seen["toxicity"]) - set(seen["near_duplicates"]) == {700, 701}
    cut = {k for k, t in seen["repeated_passages"].items() if t != seen["near_duplicates"][k]}
    assert cut == {805, 809, 812, 820} and set(seen["repeated_passages"]) == set(seen["near_duplicates"])
    assert 0.8 < len(seen["mixing"]) / len(seen["near_duplicates"]) <= 1
    assert {r["doc_id"] for r in docs.collect()} == set(seen["mixing"])
    assert corpus_pipeline.run(spark, folder).count() == docs.count()
