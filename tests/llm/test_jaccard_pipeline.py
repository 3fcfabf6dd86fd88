"""The Jaccard join against brute force, and the pipeline stage by stage."""

import random

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from understory.llm import jaccard
from understory.llm.jaccard import components, jaccard_components, link_counts

SCHEMA = "doc_id bigint, text string, component_id int, c string, root int"


def shingles(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").translate({k: " " for k in range(9, 14)}).split(" ")
    w = [x for x in w if x]
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(docs, percent):
    sets = [(d, shingles(t)) for d, t in docs]
    group = list(range(len(docs)))

    def top(k):
        while group[k] != k:
            k = group[k]
        return k
    for i in range(len(sets)):
        for j in range(i):
            a, b = sets[i][1], sets[j][1]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                group[top(i)] = top(j)
    least = {}
    for k, (d, _) in enumerate(sets):
        if d is not None:
            least[top(k)] = min(least.get(top(k), d), d)
    return sorted([(d, len(s), least.get(top(k)) if s else d) for k, (d, s) in enumerate(sets)], key=repr)


def corpus(seed, n):
    """Groups of near copies, chains of edits, and passages that many texts share."""
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(400)]
    shared = [rng.choices(vocab, k=12) for _ in range(3)]
    out, bases = [], [rng.choices(vocab, k=rng.randint(3, 60)) for _ in range(8)]
    for _ in range(n):
        kind = rng.random()
        if kind < 0.6:
            k = rng.randrange(len(bases))
            text = list(bases[k])
            for _ in range(rng.randint(0, 4)):
                text[rng.randrange(len(text))] = rng.choice(vocab)
            if kind < 0.3:
                bases[k] = text  # a chain drifts away
        elif kind < 0.9:
            text = rng.choices(vocab, k=rng.randint(0, 10)) + rng.choice(shared) + rng.choices(vocab, k=rng.randint(0, 10))
        else:
            text = rng.choices(vocab, k=rng.randint(0, 6))
        out.append(rng.choice([" ", "\n", " \t"]).join(w.upper() if rng.random() < 0.2 else w for w in text))
    return out


def found(spark, docs, percent=75):
    df = spark.createDataFrame([(d, t, 1, "x", 2) for d, t in docs], SCHEMA).repartition(3)
    membership, links = jaccard_components(df, percent)
    return sorted([(r.id, r.n_shingles, r.component_id) for r in membership.collect()], key=repr), links


@pytest.mark.parametrize(("seed", "percent", "frequent", "runs"), [(1, 75, 1 << 16, 4 << 20), (2, 75, 5, 2000), (3, 60, 0, 500)])
def test_components_as_brute_force(spark, monkeypatch, seed, percent, frequent, runs):
    monkeypatch.setattr(jaccard, "FREQUENT", frequent)
    docs = list(enumerate(corpus(seed, 150)))
    docs += [(1000 + k, t) for k, (_, t) in enumerate(docs[:30])] + [(2000, None), (2001, ""), (2002, " \n"), (2003, "w1 w2"), (2004, "W1\tw2"), (2005, "w" * 100000)]
    got, links = found(spark, docs, percent)
    assert got == brute(docs, percent)
    assert all(100 * r.shared >= percent * (r.n_a + r.n_b - r.shared) for r in links.collect())


@pytest.mark.parametrize(("seed", "percent", "frequent", "runs"), [(4, 75, 1 << 16, 4 << 20), (5, 60, 0, 500)])
def test_complete_links_as_brute_force(spark, monkeypatch, seed, percent, frequent, runs):
    monkeypatch.setattr(jaccard, "FREQUENT", frequent)
    rng = random.Random(seed)
    base = [f"v{k}" for k in range(60)]
    texts = corpus(seed, 80)
    for _ in range(40):  # a group of different near copies
        text = list(base)
        text[rng.randrange(60)] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(text))
    docs = list(enumerate(texts)) + [(1000 + k, t) for k, t in enumerate(texts[70:90])] + [(2000, None), (2001, "")]
    sets = {d: frozenset(shingles(t)) for d, t in docs}
    want = {d: 0 for d in sets}
    pairs = set()
    for d, one in sets.items():
        for e, two in sets.items():
            if d < e and one and two and 100 * len(one & two) >= percent * len(one | two):
                want[d], want[e] = want[d] + 1, want[e] + 1
                if one != two:
                    pairs.add(frozenset([one, two]))
    df = spark.createDataFrame([(d, t, 1, "x", 2) for d, t in docs], SCHEMA).repartition(3)
    membership, links = jaccard_components(df, percent, complete=True)
    got = link_counts(membership, links).collect()
    assert {r.id: r.n_links for r in got} == want and len(got) == len(docs)
    assert sorted([(r.id, r.n_shingles, r.component_id) for r in got], key=repr) == brute(docs, percent)
    of_key = {r.set_key: sets[r.id] for r in got}
    listed = links.collect()
    assert {frozenset([of_key[r.a], of_key[r.b]]) for r in listed} == pairs and len(listed) == len(pairs)
    assert all((r.n_a, r.n_b, r.shared) == (len(of_key[r.a]), len(of_key[r.b]), len(of_key[r.a] & of_key[r.b])) for r in listed)


def test_fine_signatures_tell_large_sets_apart_and_keep_links():
    """Large sets with nothing in common are told apart without their texts; what only one set of a pair has is never exceeded."""
    rng = np.random.default_rng(7)
    texts = [[f"w{k}" for k in rng.integers(0, 10**6, n)] for n in (40, 3000, 3100, 3900, 9000, 9500)]
    texts += [t[:len(t) * 9 // 10] + ["x"] * 3 for t in texts]
    s = jaccard.Sets(pa.array([" ".join(t) for t in texts]))
    every = np.arange(len(texts))
    a, b = (x.ravel() for x in np.meshgrid(every, every))
    rows = [set(s.hashes[s.bounds[k]:s.bounds[k + 1]].tolist()) for k in every]
    only = np.array([len(rows[i] ^ rows[j]) for i, j in zip(a, b)])
    coarse, fine = (jaccard.signatures(s, every, f) for f in (False, True))
    assert {len(x) for x in coarse} == {128} and len({len(x) for x in fine if x}) >= 3 and fine[0] is None
    finest = jaccard.Marks(pa.array([f or c for f, c in zip(fine, coarse)], pa.binary()))
    apart = finest.apart(a, finest, b)
    assert (apart <= only).all() and (apart[a == b] == 0).all()
    assert all((finest.apart(int(k), finest, every) == apart[a == k][np.argsort(b[a == k])]).all() for k in every)
    open_ = apart * 175 <= (s.sizes[a] + s.sizes[b]) * 25
    linked = (s.sizes[a] + s.sizes[b] - only) * 100 >= (s.sizes[a] + s.sizes[b] + only) * 75
    assert open_[linked].all() and (open_ == linked)[only == s.sizes[a] + s.sizes[b]].all()


def test_frequent_shingles_count_every_span(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "SPAN", 64)
    df = spark.createDataFrame([(f"{'a b c d e f' if k % 2 else 'g h i j k'} z{k} y{k} x{k}",) for k in range(60)], "text string").repartition(1)
    hashes = jaccard.Sets(pa.array(["a b c d e", "b c d e f", "g h i j k"])).hashes
    s, times = jaccard.frequent_shingles(df)
    counts = dict(zip(s.tolist(), times.tolist()))
    assert set(counts) == set(hashes.tolist()) and all(27 <= n <= 30 for n in counts.values())


@pytest.mark.parametrize("percent", [50, 75, 100])
def test_rarest_shingles_of_each_set(percent):
    rng = random.Random(percent)
    texts = [" ".join(rng.choice("ab") for _ in range(rng.randint(0, 40))) for _ in range(50)] + ["", "a", "b c d"]
    s = jaccard.Sets(pa.array(texts))
    for k in range(len(texts)):
        own = s.hashes[s.bounds[k]:s.bounds[k + 1]].tolist()
        assert own == sorted(set(own)) and len(own) == len(shingles(texts[k]))
    values, times = np.unique(s.hashes, return_counts=True)
    common, times = values[times > 2], times[times > 2]
    count = dict(zip(common.tolist(), times.tolist()))
    places, is_common = s.rarest(s.distinct(), common, times, percent)
    got = sorted(zip(s.owner[places].tolist(), s.hashes[places].tolist(), is_common.tolist()))
    want = []
    for k in s.distinct():
        own = sorted(s.hashes[s.bounds[k]:s.bounds[k + 1]].tolist(), key=lambda h: (count.get(h, 0), h))
        want += [(k, h, h in count) for h in own[:len(own) + 1 + (-percent * len(own)) // 100]]
    assert got == sorted(want) and 0 < is_common.sum() < len(places)
    nothing = np.zeros(0, np.uint64)
    assert not s.rarest(s.distinct(), nothing, nothing.astype(np.int64), percent)[1].any()


def test_distinct_columns():
    rows = np.random.default_rng(1).integers(-3, 3, (3, 500))
    got = jaccard.distinct_columns(rows)
    assert sorted(map(tuple, got.T.tolist())) == sorted(set(map(tuple, rows.T.tolist())))
    assert jaccard.distinct_columns(np.zeros((4, 0), np.int64)).shape == (4, 0)


def test_texts_are_read_four_times(spark):
    """For counts, rare shingles, texts of needed sets and the result: rare shingles were taken twice."""
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    docs = spark.createDataFrame([(k, f"a b c d e f g {k % 7}") for k in range(50)], "doc_id bigint, text string")
    membership, _ = jaccard_components(docs.mapInArrow(seen, docs.schema))
    assert len(membership.collect()) == 50 and read.value == 4 * 50


def test_odd_ids_and_empty_table(spark):
    docs = [(None, "a b c d e f"), (5, "a b c d e f"), (5, "x"), (7, "a b c d e f"), (None, "alone here"), (None, None)]
    assert found(spark, docs)[0] == brute(docs, 75)
    assert found(spark, [])[0] == []


def test_components_of_a_long_chain(spark):
    rng = random.Random(3)
    names = rng.sample(range(10**6), 200)
    edges = list(zip(names, names[1:])) + [(-5, -6), (-6, -7), (-7, -5)]
    label = {r.v: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert len({label[v] for v in names}) == 1 and len({label[v] for v in (-5, -6, -7)}) == 1 and label[-5] != label[names[0]]


def test_pipeline_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    before = {r.doc_id: r.text for r in docs.collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality classifier", "n-gram Jaccard join", "benchmark decontamination", "secret scans", "packing"]
    good = stages["quality classifier"](spark, docs, sf)
    kept = {r.doc_id for r in good.collect()}
    assert good.columns == names and sum((d in kept) == (q == 1) for d, q in labels.items()) >= 0.95 * len(labels)
    single = stages["n-gram Jaccard join"](spark, docs, sf)
    assert single.columns == names
    assert {r.doc_id for r in single.collect()} == {d for d, _, c in brute(sorted(before.items()), 75) if d == c}
    clean = stages["benchmark decontamination"](spark, docs, sf)
    from understory.llm.queries import LLM_QUERIES
    bad = {r.doc_id for r in LLM_QUERIES["op6_decontamination"](spark, sf).collect() if r.contaminated}
    assert clean.columns == names and {r.doc_id for r in clean.collect()} == set(before) - bad and bad
    hidden = stages["secret scans"](spark, docs, sf)
    secret = {r.doc_id for r in LLM_QUERIES["op8_secret_scan"](spark, sf).collect() if r.spans}
    after = {r.doc_id: r for r in hidden.collect()}
    assert hidden.columns == names and {d for d in before if after[d].text != before[d]} == secret and set(after) == set(before)
    assert all(r.n_chars == len(r.text) for r in after.values())
    out = corpus_pipeline.run(spark, sf)
    assert out.count() > 0 and {r.doc_id for r in out.select("doc_id").collect()} <= kept
