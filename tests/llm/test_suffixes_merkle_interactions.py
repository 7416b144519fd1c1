"""Repeated byte strings, Merkle manifest and filter interactions, each against a plain version."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest

from tidewater.llm import interactions, merkle, suffixes

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id long, hash long, pos long, part string, lead long, bits int"
WORD = re.compile("[^\x20\x09-\x0d]+")


def docs(spark, rows):
    """Rows of (doc_id, text, lang, source, n_chars), with columns whose names clash with those used inside."""
    return spark.createDataFrame([(*r, 1, 2, 3, "clash", 4, 5) for r in rows], DOCS)


# --- repeated byte strings --------------------------------------------------------------------


def plain_removal(texts, span):
    count = Counter(t[s : s + span] for t in texts for s in range(len(t) - span + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for s in range(len(t) - span + 1):
            if count[t[s : s + span]] > 1:
                gone[s : s + span] = True
        spans = int((np.diff(np.concatenate([[0], gone.view(np.int8)])) == 1).sum())
        out.append((len(t), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~gone])).hexdigest()))
    return out


def passages(seed, n):
    """Texts from shared passages, edited copies, periodic runs and multi-byte letters."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé😀") for _ in range(r.randrange(1, 7)))
    shared = [" ".join(word() for _ in range(r.randrange(30, 90))) for _ in range(6)]
    out = []
    for _ in range(n):
        parts = [r.choice(shared) if r.random() < 0.6 else " ".join(word() for _ in range(r.randrange(5, 120))) for _ in range(r.randrange(1, 5))]
        text = r.choice([" ", "", "\n"]).join(parts)
        if r.random() < 0.5 and text:
            k = r.randrange(len(text))
            text = text[:k] + "#" + text[k + 1 :]
        out.append(text)
    return out


ODD = [None, "", "x", "a" * 199, "b" * 200, "c" * 201, "ab" * 400, "z" * 70_000, "é" * 100, "é" * 150, None, "same " * 60, "same " * 60]


@pytest.mark.parametrize("most", [1000, 4])
def test_repeated_strings_equal_a_plain_count(spark, most):
    texts = passages(3, 60) + ODD
    texts += texts[:5]
    rows = [(i if i % 7 else None, t, "en", "s", 1) for i, t in enumerate(texts)] + [(1, texts[1], "en", "s", 1)] * 6
    got = suffixes.remove_repeats(docs(spark, rows), most=most)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"]
    want = Counter((r[0], *x) for r, x in zip(rows, plain_removal([(r[1] or "").encode() for r in rows], suffixes.SPAN), strict=True))
    found = got.collect()
    assert Counter(tuple(r)[:5] for r in found) == want
    for r in found:
        assert sum(s.end - s.start for s in r.removed) == r.n_removed and len(r.removed) == r.n_spans


def test_no_repeats_and_no_rows(spark):
    r = random.Random(5)
    rows = [(i, "".join(r.choice("abcdefgh ") for _ in range(r.randrange(600))), "en", "s", 1) for i in range(20)]
    assert {x.n_removed for x in suffixes.remove_repeats(docs(spark, rows)).collect()} == {0}
    assert suffixes.remove_repeats(docs(spark, [])).collect() == []


def test_multikey_sort_orders_bytes_and_counts_shared_ones():
    r = random.Random(1)
    strings = [bytes(r.choice(b"ab") for _ in range(r.randrange(1, 40))) for _ in range(300)] + [b"a" * 40] * 5
    order, shared = suffixes.multikey_sort(suffixes.padded(strings, 40))
    filled = [s.ljust(40, b"\0") for s in strings]
    assert [filled[i] for i in order] == sorted(filled)
    for i in range(1, len(order)):
        a, b = filled[order[i - 1]], filled[order[i]]
        assert shared[i] == next((k for k in range(40) if a[k] != b[k]), 40)


def test_every_string_has_its_anchor_at_the_same_place():
    r = np.random.default_rng(2)
    part = r.integers(97, 100, 260).astype(np.uint8)
    a, b = np.concatenate([r.integers(97, 123, 75).astype(np.uint8), part, r.integers(97, 123, 300).astype(np.uint8)]), np.concatenate([r.integers(97, 123, 400).astype(np.uint8), part])
    where = []
    for data, at in ((a, 75), (b, 400)):
        _, anchor, first, last, _ = suffixes.anchors(data, np.array([0, len(data)]))
        of = {s: x for x, f, e in zip(anchor.tolist(), first.tolist(), last.tolist(), strict=True) for s in range(f, e + 1)}
        assert sorted(of) == list(range(len(data) - suffixes.SPAN + 1))
        where.append([of[at + k] - at for k in range(61)])
    assert where[0] == where[1]


# --- Merkle manifest --------------------------------------------------------------------------


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def plain_leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(level, own):
    """Root of ``level``, and for each place of ``own`` its siblings and its way up."""
    path = {k: ("", []) for k in own}
    at = {k: k for k in own}
    while len(level) > 1:
        runs = [level[i : i + 3] for i in range(0, len(level), 3)]
        for k in own:
            run, place = runs[at[k] // 3], at[k] % 3
            left, right = "".join(run[:place]), "".join(run[place + 1 :])
            path[k] = (path[k][0] + left + right, [*path[k][1], (left, right)])
            at[k] //= 3
        level = [sha("".join(r)) for r in runs]
    return level[0], path


def plain_manifest(rows):
    """rows: (doc_id, source, lang, n_chars, text)"""
    by = defaultdict(list)
    for r in rows:
        by[r[1]].append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r)))
        trees[s] = climb([plain_leaf(r) for r in by[s]], range(len(by[s])))
    root, above = climb([trees[s][0] for s in names], range(len(names)))
    out = []
    for k, s in enumerate(names):
        for i, r in enumerate(by[s]):
            proof, ways = trees[s][1][i][0] + above[k][0], trees[s][1][i][1] + above[k][1]
            text = r[4].replace("\n", "") if r[4] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 else r[4]
            folded = plain_leaf((*r[:4], text))
            for left, right in ways:
                folded = sha(left + folded + right)
            out.append((r[0], plain_leaf(r), trees[s][0], root, sha(proof), folded, folded == root))
    return Counter(out)


def manifest_rows(r, n, sources):
    return [(r.choice([None, i, i % 50, -i]), r.choice(sources), r.choice(["en", None, ""]), r.choice([None, i]), r.choice([None, "", "a\nb", "é\n\n😀", f"line {i}\n" * (i % 4), "no break"])) for i in range(n)]


@pytest.mark.parametrize("case", ["one", "few", "many", "deep"])
def test_manifest_equals_a_plain_tree(spark, case, monkeypatch):
    r = random.Random(4)
    rows = {"one": [(7, None, None, None, None)], "few": manifest_rows(r, 5, ["s"]), "many": manifest_rows(r, 300, ["s", "t", None, "", "é", "~"]), "deep": manifest_rows(r, 400, ["hot", "hot", "cold"])}[case]
    rows += rows[:3] * 2
    got = merkle.manifest(docs(spark, [(i, t, lang, s, n) for i, s, lang, n, t in rows]))
    assert Counter(tuple(x) for x in got.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()) == plain_manifest(rows)


def test_manifest_of_sources_over_several_buckets(spark):
    rows = [(i, "big" if i % 10 else f"s{i % 7}", "en", i, f"text\n{i}") for i in range(3 * merkle.BUCKET + 5)]
    got = merkle.manifest(docs(spark, [(i, t, lang, s, n) for i, s, lang, n, t in rows]))
    assert Counter(tuple(x) for x in got.collect()) == plain_manifest(rows)


def test_manifest_of_no_rows(spark):
    assert merkle.manifest(docs(spark, [])).collect() == []


# --- filter interactions ----------------------------------------------------------------------


def plain_audit(rows, labels):
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    seen, parts = [], set()
    for i, text, part in rows:
        t = text or ""
        w = WORD.findall(t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and i > first[t]}
        seen.append((part or "", {c for c in fails if fails[c]}, i in good, i in toxic))
        parts.add(part or "")
    out, shapley = {}, Counter()
    for part in parts:
        for order in map("".join, permutations("ABCDE")):
            for k, c in enumerate(order):
                own = [x for x in seen if x[0] == part]
                alive = [x for x in own if not x[1] & set(order[:k])]
                gone = [x for x in alive if c in x[1]]
                out[part, order, k + 1] = (len(alive) - len(gone), len(gone), sum(c in x[1] for x in own) - len(gone), sum(x[1] == {c} for x in own), sum(x[2] for x in gone), sum(x[3] for x in gone))
                shapley[part, c] += len(gone)
    return {(*k, *v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_every_order_equals_a_plain_replay(spark):
    r = random.Random(9)
    texts = [None, "", "x", "A B C", "word " * 250, " ".join(f"w{k}" for k in range(220)), " ".join(f"W{k}" for k in range(300)), "a b c\x0b\x1cd#", "|" * 9, "é" * 100_000, "Ω" * 40 + "AB"]
    rows = [(r.choice([None, k, k % 9]), r.choice(texts), r.choice(["en", "de", "", None])) for k in range(120)]
    labels = [(k % 60, r.choice([0, 1, None]), r.choice([0, 1, None])) for k in range(90)] + [(None, 1, 1)]
    frame = docs(spark, [(i, t, lang, "s", 1) for i, t, lang in rows])
    known = spark.createDataFrame([(*x, "clash") for x in labels], "doc_id long, quality int, toxic int, text string")
    got = interactions.audit(frame, known).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley").collect()
    want = plain_audit(rows, labels)
    assert len(got) == len(want) and {tuple(x) for x in got} == want
    assert interactions.audit(docs(spark, []), known).collect() == []
    assert interactions.audit(frame, known.limit(0)).count() == len(want)
