"""Near duplicates, components and the pipeline against brute force."""

import math
import random
import re

import numpy as np
import public_tokenizers
import sentencepiece

import corpus_pipeline
from tidewater.llm import graphs, jaccard, mixing, pieces, quality, vectors
from tidewater.llm.shared import table

WORD = re.compile("[^\x20\x09-\x0d]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, class_id string, cid int"


def roots(ids, pairs):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def windows(text):
    w = WORD.findall(text or "")
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    """(class, links) of (id, text) rows with different ids."""
    sets = {i: windows(t) for i, t in rows}
    ids = list(sets)
    pairs = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if sets[a] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]) > 0]
    links = {i: sum(i in p for p in pairs) for i in ids}
    return roots(ids, pairs), links


def corpus(seed=1):
    random.seed(seed)
    word = lambda: "".join(random.choice("abcdefghijkl") for _ in range(random.randrange(1, 8)))
    base = [[word() for _ in range(random.choice([3, 8, 60, 200, 400]))] for _ in range(25)]
    out = []
    for b in base:
        for _ in range(random.randrange(1, 9)):
            c = list(b)
            for _ in range(random.randrange(4) if len(c) > 50 else 0):
                c[random.randrange(len(c))] = word()
            out.append(random.choice([" ", "\n", "  "]).join(c))
    shared = " ".join(word() for _ in range(60))
    out += [shared + " " + " ".join(word() for _ in range(80)) for _ in range(20)]
    random.shuffle(out)
    return list(enumerate(out))


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "clash", 1) for i, t in rows], DOCS)


def test_join_equals_brute_force(spark):
    rows = corpus()
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.join(docs(spark, rows)).collect()}
    cls, links = brute(rows)
    assert got == {i: (cls[i], links[i]) for i, _ in rows}


def test_large_group_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "SIGNATURE_BLOCK", 40)
    monkeypatch.setattr(jaccard, "TEXT_BLOCK", 30)
    random.seed(2)
    text = [f"w{k}" for k in range(150)]
    rows = []
    for i in range(160):
        c = list(text)
        for _ in range(random.randrange(6)):
            c[random.randrange(150)] = f"x{random.randrange(10**6)}"
        rows.append((i, " ".join(c)))
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.join(docs(spark, rows)).collect()}
    cls, links = brute(rows)
    assert got == {i: (cls[i], links[i]) for i, _ in rows}


def test_join_of_odd_rows(spark):
    long = " ".join(f"k{i}" for i in range(60000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "one"), (6, "two words"), (6, "two words"), (7, long), (8, long + " tail"), (None, "one"), (9, "two  words")]
    got = sorted(((r.doc_id or 0, r.class_id, r.n_links) for r in jaccard.join(docs(spark, rows)).collect()), key=repr)
    assert got == sorted([(1, 1, 0), (2, 2, 0), (3, 3, 0), (4, 4, 2), (5, 4, 2), (0, 4, 2), (6, 6, 2), (6, 6, 2), (9, 6, 2), (7, 7, 1), (8, 7, 1)], key=repr)
    kept = jaccard.one_of_each(docs(spark, rows))
    assert kept.columns == docs(spark, rows).columns
    # Texts without words link with nothing and stay; of each group the smallest id stays once.
    assert sorted(r.doc_id for r in kept.collect()) == [4, 6, 7] or sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 4, 6, 7]
    assert jaccard.join(docs(spark, rows).limit(0)).count() == 0 == jaccard.one_of_each(docs(spark, rows).limit(0)).count()


def test_pruning_keeps_pairs_at_the_threshold():
    least = jaccard.least_matches(0.8)
    rng = np.random.default_rng(1)
    for n, m in least.items():
        drawn = rng.binomial(n + 1, 0.8, 200_000)
        assert (drawn < m).mean() <= 1e-4 and 0.4 * n < m < 0.8 * n


def test_components_of_random_graphs(spark):
    random.seed(3)
    edges = [(i, i + 1) for i in range(70)] + [(100 + random.randrange(80), 100 + random.randrange(80)) for _ in range(60)] + [(300, 300 + i) for i in range(1, 90)]
    got = {r.node: r.component for r in graphs.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {i: r for i, r in roots(nodes, [(a, b) for a, b in edges if a != b]).items()}


def embeddings(spark, rows):
    return spark.createDataFrame([(i, v, 0, "clash", 1) for i, v in rows], "vec_id long, embedding array<float>, label int, key string, copies int")


def brute_vectors(rows):
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    pairs = [(a, b) for k, (a, x) in enumerate(good) for b, y in good[:k] if len(x) == len(y) and x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= 0.9]
    cls = roots([i for i, _ in rows], pairs)
    return {i: (sum(i in p for p in pairs), cls[i], cls[i] == i) for i, _ in rows}


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((12, 64))
    rows = [(i, [float(x) for x in centres[i % 12] + rng.standard_normal(64) * rng.choice([0.0, 0.1, 0.2, 0.3, 0.35])]) for i in range(260)]
    rows += [(1000 + i, [float(x) for x in rng.standard_normal(64)]) for i in range(200)]
    rows += [(2000, None), (2001, []), (2002, [0.0] * 64), (2003, [1.0] * 63 + [None]), (2004, [float("nan")] * 64), (2005, [float("inf")] + [1.0] * 63), (2006, [1.0, 2.0]), (2007, [2.0, 4.0]), (2008, [1e-38] * 64), (2009, [1e38] * 64)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_duplicates(embeddings(spark, rows)).collect()}
    assert got == brute_vectors(rows)


def test_vectors_in_small_blocks_and_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 25)
    rng = np.random.default_rng(5)
    centre = rng.standard_normal(16)
    rows = [(i, [float(x) for x in centre + rng.standard_normal(16) * 0.25]) for i in range(120)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_duplicates(embeddings(spark, rows)).collect()}
    assert got == brute_vectors(rows)
    twice = vectors.near_duplicates(embeddings(spark, [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [1.0, 0.0])])).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.component_id) for r in twice) == [(0, 2, 1), (1, 2, 1), (1, 2, 1)]
    assert vectors.near_duplicates(embeddings(spark, rows).limit(0)).count() == 0


def test_sketches_keep_pairs_at_the_threshold():
    rng = np.random.default_rng(9)
    x = rng.standard_normal((4000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    other = rng.standard_normal((4000, 32))
    other -= (other * x).sum(1, keepdims=True) * x
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    apart = np.unpackbits(vectors.sketches(x, 11) ^ vectors.sketches(0.9 * x + np.sqrt(1 - 0.81) * other, 11), axis=1).sum(1)
    assert apart.max() <= vectors.most_apart(0.9) < 80 and np.unpackbits(vectors.sketches(x, 11) ^ vectors.sketches(other, 11), axis=1).sum(1).min() > 80


def test_tables_hold_the_miss_rate():
    rng = np.random.default_rng(6)
    bits, tables = vectors.plan(5000, 0.9)
    x = rng.standard_normal((3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    other = rng.standard_normal((3000, 64))
    other -= (other * x).sum(1, keepdims=True) * x
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    y = 0.9 * x + np.sqrt(1 - 0.81) * other
    met = (vectors.codes(x, bits, tables, 11) == vectors.codes(y, bits, tables, 11)).any(1)
    assert met.mean() > 0.99


def test_pipeline_equals_brute_force(spark, sf_dir):
    got = sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).collect()), key=repr)
    d = table(spark, sf_dir, "documents")
    verdict = {r.doc_id: r.kept for r in quality.score(d).collect()}
    rows = [(r.doc_id, r.text) for r in d.collect() if verdict[r.doc_id]]
    cls, _ = brute(rows)
    kept = d.filter(d.doc_id.isin([i for i, _ in rows if cls[i] == i]))
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(pieces.MODEL))
    want = []
    import hashlib

    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for r in mixing.mix(kept).join(kept.select("doc_id", "text"), "doc_id").collect():
        ids = model.encode(r.text)
        want += [(r.doc_id, len(ids), sha(",".join(map(str, ids))), sha(model.decode(ids)))] * math.floor(r.taken / max(r["size"], 1) + 0.5)
    assert got == sorted(want, key=repr)


def test_stages_keep_the_columns(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, d, sf_dir).schema == d.schema
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, d.limit(0), sf_dir).count() == 0, name
