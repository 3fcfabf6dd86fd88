"""URL rules, centroid clustering and filter audit against brute force."""

import hashlib
import math
import random
import re
from itertools import permutations

import numpy as np
import pytest

from understory.llm import url_rules, zone_clusters
from understory.llm.filter_audit import BANKS, FIELD_BITS, STEPS, audit_filters, text_mask, unpacked, wide_counter
from understory.llm.queries import URL_RULES
from understory.llm.url_rules import judge_urls
from understory.llm.zone_clusters import candidates, cluster_vectors, hilbert, nearest

RULES = "host string, path string, verdict string"


def brute_rule(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    raw = re.match(r"[^/?#]*", rest).group()
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in raw)
    path = re.match(r"[^?#]*", rest[len(raw):]).group()
    fits = [(len(h) + len(p), len(h), h + p, v) for h, p, v in rules
            if h is not None and (host == h or host.endswith("." + h)) and path.startswith(p or "")]
    best = max(fits, key=lambda f: (f[0], f[1], f[3] == "block"), default=(0, 0, None, default))
    return host, path, best[2], best[3]


EDGE_URLS = [None, "", "no scheme.com/en/", "http://", "http:///en/", "http://com", "http://com/", "HTTP://WWW.EXAMPLE.COM/en/x", "http://www.example.com/EN/",
             "http://example.com/en", "http://example.com/en/", "http://notexample.com/en/", "http://a.b.example.com/en/?q#f", "http://x.net/es/", "http://net/fr/",
             "http://net./fr/", "http://x.net?/es/", "http://x.net#/es/", "http://..net/es/", "http://user@example.com:80/en/", "a://b://example.com/en/",
             "http://\u00c4.com/\u00fc", "http://example.com/en/\n/x", "http://" + "a." * 3000 + "com/" + "p/" * 3000, "://www.example.com/en/a/b"]


def test_contract_rules_as_brute_force(spark, monkeypatch):
    monkeypatch.setattr(url_rules, "SAMPLES", 64)
    rng = random.Random(1)
    hosts = ["com", "example.com", "www.example.com", "a.www.example.com", "x.net", "net", "example.org", "xexample.com", "EXAMPLE.com"]
    urls = EDGE_URLS + [f"http://{rng.choice(hosts)}/{rng.choice(['en', 'es', 'fr', 'e'])}{rng.choice(['', '/', '/1', '?x'])}" for _ in range(600)]
    urls += ["http://hot.example.com/en/1"] * 300
    rows = [(k if k % 7 else None, u, "clash", "clash") for k, u in enumerate(urls)] + [(5, urls[5], "clash", "clash")] * 3
    pages = spark.createDataFrame(rows, "page_id bigint, url string, host string, rule string").repartition(6)
    got = sorted(map(tuple, judge_urls(pages, spark.createDataFrame(list(URL_RULES), RULES)).collect()), key=repr)
    assert got == sorted(((k, *brute_rule(u, URL_RULES)) for k, u, *_ in rows), key=repr)


def test_many_nested_rules_as_brute_force(spark):
    rng = random.Random(2)
    labels, parts = ["a", "b", "c"], ["x", "y", ""]
    rules = [(".".join(rng.choices(labels, k=rng.randint(1, 4))), "/" + "/".join(rng.choices(parts, k=rng.randint(0, 3))), rng.choice(["allow", "block"]))
             for _ in range(120)] + [("a.b", None, "block"), (None, "/", "block"), ("A.b", "/x", "allow"), ("a.b", "/x", "block")]
    urls = ["h://" + ".".join(rng.choices(labels, k=rng.randint(1, 6))) + "/" + "/".join(rng.choices(parts, k=rng.randint(0, 4))) for _ in range(500)]
    got = judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id int, url string"), spark.createDataFrame(rules, RULES), default="none").collect()
    lower = [(h.lower() if h else h, p, v) for h, p, v in rules]
    same = {}
    for h, p, v in lower:  # of equal rules with both verdicts, block
        same[h, p or ""] = "block" if v == "block" or same.get((h, p or "")) == "block" else "allow"
    lower = [(h, p, v) for (h, p), v in same.items()]
    assert {r.id: (r.host, r.path, r.rule, r.verdict) for r in got} == {k: brute_rule(u, lower, "none") for k, u in enumerate(urls)}


def test_no_rules_and_no_pages(spark):
    pages, rules = spark.createDataFrame([(1, "http://a.com/x"), (2, None)], "page_id bigint, url string"), spark.createDataFrame([], RULES)
    assert sorted(map(tuple, judge_urls(pages, rules, "block").collect())) == [(1, "a.com", "/x", None, "block"), (2, "", "", None, "block")]
    assert judge_urls(pages.limit(0), spark.createDataFrame(list(URL_RULES), RULES)).count() == 0


def brute_clusters(rows, k, rounds, dims, scale):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:k]]

    def assign():
        out = []
        for _, v in kept:
            d = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in centroids]
            out.append((d.index(min(d)), min(d)))
        return out

    for _ in range(rounds):
        found = assign()
        for c in range(len(centroids)):
            mine = [v for (_, v), (n, _) in zip(kept, found) if n == c]
            if mine:
                centroids[c] = [sum(x) // len(mine) for x in zip(*mine)]
    found = assign()
    total = sum(d for _, d in found)
    return [(i, n, d, sum(e for m, e in found if m == n), total, hashlib.sha256(",".join(map(str, centroids[n])).encode()).hexdigest())
            for (i, _), (n, d) in zip(kept, found)]


VECTORS = "vec_id bigint, embedding array<double>, cluster string, place int"


def test_clusters_as_brute_force(spark, monkeypatch):
    monkeypatch.setattr(zone_clusters, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(7, 5))
    vectors = [np.round(centres[k % 7] + rng.normal(0, 0.1, 5), 2).tolist() for k in range(300)]
    rows = list(enumerate(vectors)) + [(900, vectors[0])] * 40 + [(3, vectors[9]), (None, vectors[1]), (None, vectors[2]), (901, None), (902, vectors[0][:4]),
                                                                (903, [*vectors[0], 0.0]), (904, [None] * 5), (905, [math.nan] * 5), (906, [math.inf] * 5)]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], VECTORS).repartition(5)
    got = cluster_vectors(df, k=9, rounds=4, dims=5, scale=256)
    assert got.columns == ["id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(brute_clusters(rows, 9, 4, 5, 256), key=repr)


def test_few_equal_and_no_vectors(spark):
    rows = [(k, [0.5, -0.25]) for k in range(6)]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], VECTORS)
    assert sorted(map(tuple, cluster_vectors(df, k=40, rounds=2, dims=2).collect())) == sorted(brute_clusters(rows, 40, 2, 2, 256))
    assert cluster_vectors(df.limit(0), dims=2).count() == 0 and cluster_vectors(df, dims=3).count() == 0
    with pytest.raises(Exception, match="beyond"):
        cluster_vectors(spark.createDataFrame([(1, [1e30, 0.0], "x", 1)], VECTORS), dims=2).count()


def test_boxes_leave_out_only_what_cannot_be_nearest():
    rng = np.random.default_rng(4)
    left = 0
    for spread in (3, 40, 400):
        for _ in range(60):
            centroids = rng.integers(-100, 100, (12, 6))
            rows = rng.integers(-100, 100, 6) + rng.integers(0, spread, (20, 6))
            among = candidates(rows.min(0), rows.max(0), centroids)
            left += 12 - len(among)
            all_ = np.arange(12)
            assert all(np.array_equal(a, b) for a, b in zip(nearest(rows, centroids, among), nearest(rows, centroids, all_)))
            big = rows * (1 << 18)
            want = ((big[:, None, :] - centroids[None] * (1 << 18)) ** 2).sum(2)
            assert np.array_equal(nearest(big, centroids * (1 << 18), all_)[1], want.min(1))
    assert left > 500


def test_hilbert_curve_visits_each_cell_once_by_single_steps():
    for axes, bits in ((2, 4), (3, 2)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * axes, indexing="ij"), -1).reshape(-1, axes)
        place = hilbert(grid, bits)
        assert sorted(place) == list(range(len(grid)))
        assert (np.abs(np.diff(grid[np.argsort(place)], axis=0)).sum(1) == 1).all()


def brute_audit(docs, labels):
    order = {}
    for i, text, _ in docs:
        key = (i is None, i if i is not None else 0)
        order[text or ""] = min(order.get(text or "", key), key)
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    seen = []
    for i, text, lang in docs:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = ("A" * (len(w) < 100) + "B" * (100 * len(set(w)) < 80 * len(w)) + "C" * (100 * len(re.findall("[A-Z]", t)) > 10 * len(t))
                 + "D" * bool(re.search(r"[#$%&*|]", t)) + "E" * ((i is None, i if i is not None else 0) > order[t]))
        seen.append((lang or "", fails, i in good, i in toxic))
    out = []
    for part in {s[0] for s in seen}:
        rows = [s for s in seen if s[0] == part]
        removed = {}
        for o in map("".join, permutations("ABCDE")):
            for step in range(1, 6):
                f, earlier = o[step - 1], set(o[:step - 1])
                here = [r for r in rows if f in r[1] and not earlier & set(r[1])]
                removed[f] = removed.get(f, 0) + len(here)
                out.append([part, o, step, sum(not set(o[:step]) & set(r[1]) for r in rows), len(here), sum(f in r[1] for r in rows) - len(here),
                            sum(r[1] == f for r in rows), sum(r[2] for r in here), sum(r[3] for r in here), f])
        for row in out:
            if row[0] == part and isinstance(row[-1], str):
                row[-1] = removed[row[-1]]
    return sorted(map(tuple, out))


DOCS, LABELS = "doc_id bigint, text string, lang string, mask int, digest string", "doc_id bigint, quality int, toxic int, n int"


def test_audit_as_brute_force(spark):
    rng = random.Random(5)
    words = ["alpha", "BETA", "gamma#", "delta", "\u00e9t\u00e9", "X"]
    texts = [" ".join(rng.choices(words[:rng.randint(1, 6)] + [f"w{j}" for j in range(rng.choice([0, 300]))], k=rng.choice([0, 1, 5, 99, 100, 150]))) for _ in range(120)]
    docs = [(k, rng.choice(texts), rng.choice(["en", "de", None, ""])) for k in range(300)]
    docs += [(7, docs[7][1], "en"), (7, docs[7][1], "fr"), (7, "other words", "fr"), (None, docs[0][1], "en"), (None, "alone", "xx"), (None, "alone", "xx"),
             (400, None, "en"), (401, "", "en"), (402, "a\x0bb\x0cc\x1cd\u00a0e\u0085f ", "en"), (403, "word " * 40_000, "en"), (404, "\x00|", "zz")]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1])) for k in range(0, 300, 2)] + [(7, 1, 0), (7, 0, 1), (None, 1, 1), (9999, 1, 1)]
    got = audit_filters(spark.createDataFrame([(*d, 1, "x") for d in docs], DOCS).repartition(5), spark.createDataFrame([(*x, 1) for x in labels], LABELS))
    assert got.columns == ["part", "filter_order", "step", "kept", *BANKS, "shapley"]
    assert sorted(map(tuple, got.collect())) == brute_audit(docs, labels)
    assert audit_filters(spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)).count() == 0


def test_wide_counters_never_run_into_their_neighbours():
    n = (1 << (FIELD_BITS - 1)) - 1  # the most rows that a part can count
    fields = unpacked(n * wide_counter(0b10111, True, True))
    assert set(np.unique(fields)) <= {0, n} and fields.shape == (5, len(STEPS)) and (fields[0] == fields[3]).all()
    mixed = unpacked(3 * wide_counter(0b00001, False, True) + 5 * wide_counter(0b00001, True, False))
    at = [k for k, (o, s) in enumerate(STEPS) if o[s - 1] == "A"]
    assert (mixed[0, at] == 8).all() and (mixed[2, at] == 8).all() and (mixed[3, at] == 5).all() and (mixed[4, at] == 3).all() and mixed[1].sum() == 0


def test_words_end_at_ascii_space_only():
    assert text_mask(b"a\x1cb " * 100) & 2 and not text_mask(" ".join(f"w{k}\u00a0x" for k in range(100)).encode()) & 3
