"""WARC archives, URL filters, sharding and mixing: odd rows, empty tables and brute force."""

import base64
import glob
import gzip
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
import xxhash

from tidewater.llm import mixing, registry, sharding, urlfilter, warc
from tidewater.llm.shared import new_path, table

PAGES = "page_id long, url string, html string, n_chars int, payload string"
ODD = [(1, "http://a.example.org/x", "same"), (2, None, "same"), (3, "no scheme", None), (4, "http://b.com/fr/1", ""), (4, "http://b.com/fr/1", ""), (None, "https://C.Example.org/es/?q", "same"), (5, "http://d\r\nX: y", "a\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc"), (6, "http://e", "é" * 9000)]


def pages(spark, rows=ODD):
    return spark.createDataFrame([(*r, 7, "clash") for r in rows], PAGES)


def duck(sql, spark, **frames):
    con = duckdb.connect()
    for name, df in frames.items():
        con.register(name, df.toPandas())
    return con.execute(sql).fetchall()


def archived(spark, df):
    path = new_path(spark, "t")
    warc.write(df, path)
    return path, warc.read(spark, path, with_payload=True)


def test_warc_round_trip_and_revisits(spark):
    path, found = archived(spark, pages(spark))
    rows = found.collect()
    assert len(rows) == len(ODD) and all(r.intact for r in rows)
    kinds = Counter((r.record_id, r.record_type, r.refers_to) for r in rows)
    name = lambda i: f"<urn:record:{'' if i is None else i}>"
    assert kinds == Counter({(name(1), "revisit", name(2)): 1, (name(2), "response", None): 1, (name(None), "revisit", name(2)): 1, (name(3), "revisit", name(4)): 1, (name(4), "response", None): 2, (name(5), "response", None): 1, (name(6), "response", None): 1})
    whole = {(r.record_id, bytes(r.payload)) for r in warc.restored(found).collect()}
    assert whole == {(name(i), (h or "").encode()) for i, _, h in ODD}
    for r in rows:
        if r.record_type == "response":
            assert r.payload_digest == base64.b32encode(hashlib.sha1(bytes(r.payload)).digest()).decode()
    raw = b"".join(gzip.open(p).read() for p in glob.glob(path.removeprefix("file:") + "/*/*.gz"))
    assert raw.startswith(b"WARC/1.1\r\n") and b"\nX: y" not in raw and b"Target-URI: http://dX: y\r\n" in raw


def test_warc_reads_plain_and_damaged_archives():
    one = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <x>\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n"
    assert [(f["warc-type"], bytes(b)) for f, b in warc.records(one * 2)] == [("warcinfo", b"hi")] * 2
    with pytest.raises(ValueError, match="no WARC record"):
        list(warc.records(b"junk\r\n\r\n"))


def test_warc_empty_table(spark):
    _, found = archived(spark, pages(spark).limit(0))
    assert found.count() == 0


def test_op1_takes_null_ids_and_long_pages(spark, tmp_path):
    rows = [*ODD, (None, None, "only null ids"), (None, None, "only null ids"), (7, "http://f", "x" * 3_000_000), (8, "http://f", "y" * 20_000)] + [(100 + i, "http://g", "copied often") for i in range(300)]
    pages(spark, rows).write.parquet(str(tmp_path / "pages.parquet"))
    got = Counter(map(tuple, registry.queries()["op1_warc"](spark, str(tmp_path)).collect()))
    digest = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    largest = {}
    for i, _, h in rows:
        largest[h or ""] = max(largest.get(h or "", -1), -1 if i is None else i)
    top = {h: None if i < 0 else i for h, i in largest.items()}
    want = Counter((i, len((h or "").encode()), digest(h), "revisit" if i != top[h or ""] else "response", top[h or ""] if i != top[h or ""] else None) for i, _, h in rows)
    assert got == want


def test_warc_files_hold_few_bytes(spark):
    path, found = archived(spark, spark.range(9).selectExpr("id as page_id", "'u' as url", "repeat(cast(id as string), if(id < 7, 300000, 5000000)) as html").coalesce(1))
    assert found.count() == 9 and all(len(gzip.open(p).read()) < 64 << 20 for p in glob.glob(path.removeprefix("file:") + "/*/*.gz"))
    assert len(glob.glob(path.removeprefix("file:") + "/file=3-*")) == 2


def test_op1_equals_sql(spark, sf_dir):
    got = sorted(map(tuple, registry.op1_warc(spark, sf_dir).collect()))
    assert got == sorted(duck(warc.ORACLE, spark, pages=table(spark, sf_dir, "pages")))


def split_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    path = rest[cut:]
    end = min([path.find(c) for c in "?#" if c in path], default=len(path))
    return rest[:cut].translate({c: c + 32 for c in range(65, 91)}), path[:end]


def rule_of(host, path):
    best = None
    for rule, verdict in urlfilter.RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[0])):
            best = rule, verdict
    return best


URLS = [None, "", "no scheme", "http://", "http://ORG/", "http://x.org", "http://example.org/es/1", "http://sub.example.org/en/12?a=b", "https://a.com/fr/x#y", "https://a.com/de/", "http://xexample.org/es/", "a://b://c/d", "http://É.org/x\ny?z", "http://a.com?x://y/z", "http://" + "k" * 5000 + ".net/" + "9" * 3000]


def test_hosts_paths_and_rules(spark):
    got = {r.page_id: r for r in urlfilter.judge(pages(spark, [(i, u, None) for i, u in enumerate(URLS)])).collect()}
    for i, u in enumerate(URLS):
        host, path = split_url(u)
        best = rule_of(host, path)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, best and best[0])
        assert got[i].verdict in ("allow", "block") and (best is None or got[i].verdict == best[1])


def test_trees_learn_held_out_urls(spark):
    random.seed(1)
    word = lambda: "".join(random.choice("abcdefghij") for _ in range(8))
    bad = lambda: f"http://{word()}-{random.randrange(10**6)}.info/{'/'.join(word() for _ in range(5))}?a={word()}&b=1&c=2"
    good = lambda: f"https://{word()}.net/{word()}"
    labelled = spark.createDataFrame([(bad(), 1) for _ in range(150)] + [(good(), 0) for _ in range(150)], "url string, label int")
    held = [(i, bad() if i < 50 else good(), None) for i in range(100)]
    got = {r.page_id: r.verdict for r in urlfilter.judge(pages(spark, held), labelled=labelled).collect()}
    assert sum(got[i] == ("block" if i < 50 else "allow") for i in range(100)) >= 97


def test_suffix_shares_cover_all_labelled_urls(spark):
    random.seed(2)
    bad = {i: random.random() < 0.5 for i in range(400)}
    labelled = spark.createDataFrame([(f"http://s{i:03d}.net/{k}", int(bad[i])) for i in bad for k in range(3)], "url string, label int")
    held = [(i, f"http://s{i:03d}.net/9", None) for i in bad]
    got = {r.page_id: r.verdict for r in urlfilter.judge(pages(spark, held), labelled=labelled, train_rows=200).collect()}
    assert sum(got[i] == ("block" if bad[i] else "allow") for i in bad) >= 390


def test_urls_without_labels_or_rows(spark):
    got = urlfilter.judge(pages(spark, [(1, "http://a.net/", None)] * 2)).collect()
    assert [r.verdict for r in got] == ["allow"] * 2
    assert urlfilter.judge(pages(spark).limit(0)).count() == 0


DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard int, size int"
TEXTS = [(1, "a b", "s1"), (1, "a b", "s1"), (2, None, None), (None, "", "s2"), (None, "é\tü", "s2"), (3, "w " * 40000, "s1"), (4, "one", "s2"), (5, "#", None)]


def docs(spark, rows=TEXTS):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), 9, 9) for i, t, s in rows], DOCS)


def test_shards_are_gapless_and_sized(spark):
    got = sharding.shard(docs(spark), 3, new_path(spark, "map")).collect()
    assert len(got) == len(TEXTS)
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert set(by) <= {0, 1, 2} and all(sorted(v) == list(range(len(v))) for v in by.values())
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, _ in TEXTS)
    assert sharding.shard(docs(spark).limit(0), 3, new_path(spark, "map")).count() == 0


def test_shards_and_slots_by_brute_force(spark, sf_dir):
    """Every shard and slot from the rules in plain loops: hash, bytes a virtual slot, largest first to the lightest shard, places by order."""
    rows = [(r.doc_id, r.text, None) for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()] + TEXTS
    digest = lambda data, seed: xxhash.xxh64_intdigest(data, seed=seed)

    def virtual(i, text):
        if i is not None:
            return digest(str(i).encode(), 42) % sharding.N_SLOTS
        return digest(digest(text, 42).to_bytes(8, "little"), digest(b"", 42)) % sharding.N_SLOTS

    plain = [(virtual(i, (t or "").encode()), i, zlib.crc32((t or "").encode()), len((t or "").encode()) + 8) for i, t, _ in rows]
    held, loads, owner = Counter(), [0] * 24, {}
    for v, _, _, size in plain:
        held[v] += size
    for v in sorted(held, key=lambda v: (-held[v], v)):
        owner[v] = min(range(24), key=lambda s: (loads[s], s))
        loads[owner[v]] += held[v]
    want, used = Counter(), Counter()
    for v, i, crc, size in sorted(plain, key=lambda x: (x[0], x[1] is not None, x[1] or 0, x[2], x[3])):
        want[(i, size, crc, owner[v], used[owner[v]])] += 1
        used[owner[v]] += 1
    got = sharding.shard(docs(spark, rows), 24, new_path(spark, "map")).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32, r.shard, r.slot) for r in got) == want


def test_shards_balance_and_rebalancing_moves_little(spark, sf_dir):
    path = new_path(spark, "map")
    got = sharding.shard(table(spark, sf_dir, "documents"), 24, path).collect()
    loads = Counter()
    for r in got:
        loads[r.shard] += r["size"]
    assert len(loads) == 24 and max(loads.values()) - min(loads.values()) <= max(r["size"] for r in got)
    sizes = [(s, 100 + s % 7) for s in range(sharding.N_SLOTS)]
    first = sharding.first_map(sizes, 24)
    grown = sharding.rebalanced(first, sizes, 25)
    held = lambda m: {s: k for _, s, k, _ in m}
    moved = [s for s in held(first) if held(first)[s] != held(grown)[s]]
    load = Counter()
    for _, s, k, b in grown:
        load[k] += b
    assert len(held(grown)) == sharding.N_SLOTS and len(moved) <= sharding.N_SLOTS / 25 * 1.1
    assert max(load.values()) < 1.05 * min(load.values()) and {held(grown)[s] for s in moved} == {24}
    shrunk = sharding.rebalanced(grown, sizes, 20)
    assert {k for _, _, k, _ in shrunk} == set(range(20)) and shrunk[0][0] == 3
    sharding.save_map(spark, grown, path)
    assert sharding.load_map(spark, path) == grown and sharding.load_map(spark, path, 1)[0][0] == 1


def test_mixing_equals_sql_on_odd_rows(spark):
    rows = [(i, t, s) for i, (_, t, s) in enumerate(TEXTS)] + [(100, "x y z", "s3"), (101, "q", "S3"), (102, "q " * 7, "é")]
    got = sorted(map(tuple, mixing.mix(docs(spark, rows)).collect()))
    assert got == sorted(duck(mixing.ORACLE, spark, documents=docs(spark, rows)))
    assert sorted(map(tuple, mixing.mix(docs(spark, rows).repartition(5)).collect())) == got


def test_mixing_keeps_its_promises(spark, sf_dir):
    got = mixing.mix(table(spark, sf_dir, "documents")).collect()
    assert all(0 <= r.taken <= 3 * r["size"] for r in got)
    whole = sum(r["size"] for r in got)
    groups = defaultdict(list)
    for r in got:
        groups[r.target, r.source_size].append(r)
    assert abs(sum(t for t, _ in groups) - whole) < 1e-6 * whole
    assert all(abs(sum(r.taken for r in rows) - t) <= 0.5 and t <= 3 * s + 1e-6 for (t, s), rows in groups.items())


def test_mixing_repeats_cap_and_empty(spark):
    rows = [(1, "a b c", "x")] * 3 + [(2, "w " * 300, "y"), (None, "k", None)]
    got = mixing.mix(docs(spark, rows)).collect()
    assert len(got) == 5 and {r.target for r in got if r.source_size == 9} == {27.0}
    assert mixing.mix(docs(spark).limit(0)).count() == 0 == mixing.mixed_documents(docs(spark).limit(0)).count()
    assert mixing.mix(docs(spark, [(1, None, None), (2, "", "a")])).agg({"taken": "sum"}).first()[0] == 0


def test_mixed_documents_repeat_whole_texts(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    times = {r.doc_id: int(r.taken / r["size"] + 0.5) for r in mixing.mix(d).collect() if r["size"]}
    out = mixing.mixed_documents(d)
    assert out.schema == d.schema
    text, seen = {r.doc_id: r.text for r in d.collect()}, Counter()
    for r in out.collect():
        seen[r.doc_id] += 1
        assert r.text == text[r.doc_id]
    assert dict(seen) == {i: n for i, n in times.items() if n}
