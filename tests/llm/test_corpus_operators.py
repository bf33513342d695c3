"""WARC, sharding, URL filters, mixing, SimHash, and the pipeline."""

import base64
import gzip
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from wordloom.llm import decontaminate, mixing, quality, sharding, simhash, urls, warc

# WARC

PAGES = [(1, "http://a/é\r\nX: y", "<p>one</p>"), (2, None, "<p>one</p>"), (3, "http://c", None), (4, "http://d", ""), (5, "http://e", "größe\r\n\r\n" * 5000), (6, "http://f", "größe\r\n\r\n" * 5000), (None, "http://g", "<p>one</p>"), (1, "http://a", "<p>one</p>"), (7, "http://h", "short")]


def b32(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


@pytest.mark.parametrize("min_bytes", [0, 11])
def test_archives_read_back(spark, tmp_path, min_bytes):
    frame = spark.createDataFrame([(*p, "clash", "clash") for p in PAGES], "page_id long, url string, html string, sha1 string, payload string")
    warc.write_pages(frame.repartition(3), str(tmp_path / "w"), min_bytes=min_bytes)
    found = Counter((r.record_id, r.record_type, r.payload_digest, r.payload_length, r.refers_to, bytes(r.payload) if r.payload is not None else None) for r in spark.read.format("warc").load(str(tmp_path / "w")).collect())
    want = Counter()
    for i, _, html in PAGES:
        body = (html or "").encode()
        first = min(j for j, _, h in PAGES if j is not None and (h or "") == (html or ""))
        again = i is not None and i > first and len(body) >= min_bytes
        want[(f"urn:page:{'null' if i is None else i}", "revisit" if again else "response", b32(html), len(body), f"urn:page:{first}" if again else None, None if again else body)] += 1
    assert found == want


def test_predicates_are_pushed_and_payloads_skipped(spark, tmp_path, monkeypatch):
    warc.write_pages(spark.createDataFrame(PAGES, "page_id long, url string, html string"), str(tmp_path / "w"))
    read = lambda: spark.read.format("warc").option("payload", "false").load(str(tmp_path / "w"))
    assert read().where("record_type = 'revisit'").count() == 3
    assert read().where("record_type in ('response') and target_uri like 'http://e%'").count() == 1
    assert read().where("refers_to is null and payload_digest = '%s'" % b32("short")).count() == 1
    assert read().where("record_type = 'revisit' and payload_length > 100").count() == 1
    assert read().select("payload").where("payload is not null").count() == 0
    reader = warc.WarcReader(str(tmp_path / "w"), {"payload": "false"})
    from pyspark.sql.datasource import EqualTo, GreaterThan

    rest = list(reader.pushFilters([EqualTo(("record_type",), "revisit"), GreaterThan(("payload_length",), 1)]))
    assert rest == [GreaterThan(("payload_length",), 1)] and len(reader.tests) == 1
    rows = [row for p in reader.partitions() for row in reader.read(p)]
    assert len(rows) == 3


def test_foreign_archives(spark, tmp_path):
    warc.register(spark)
    records = [warc.record("response", f"urn:{k}", "http://x", b"p" * (3000 * k), b32("p" * (3000 * k))) for k in range(5)]
    (tmp_path / "plain.warc").write_bytes(b"".join(records))
    (tmp_path / "members.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))
    (tmp_path / "other.txt").write_text("no archive")
    found = spark.read.format("warc").option("verify", "true").option("partitionBytes", "1000").load(str(tmp_path)).collect()
    assert Counter(r.record_id for r in found) == {f"urn:{k}": 2 for k in range(5)} and all(r.digest_ok for r in found)


def test_archive_of_nothing(spark, tmp_path):
    warc.write_pages(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "w"))
    assert spark.read.format("warc").load(str(tmp_path / "w")).count() == 0


def test_archives_are_added_and_replaced(spark, tmp_path):
    path, schema = str(tmp_path / "w"), "page_id long, url string, html string"
    ids = lambda: sorted(r.record_id for r in spark.read.format("warc").load(path).collect())
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "foreign.warc").write_bytes(warc.record("response", "urn:foreign", None, b"x", b32("x")))
    for k in range(3):
        warc.write_pages(spark.createDataFrame([(k, None, "page"), (-k - 10, None, f"{k}")], schema), path)
        assert ids() == sorted(["urn:foreign", *(f"urn:page:{i}" for j in range(k + 1) for i in (j, -j - 10))])
    warc.write_pages(spark.createDataFrame([(7, None, "page")], schema), path, mode="overwrite")
    assert ids() == ["urn:page:7"] and not [p for p in (tmp_path / "w").iterdir() if p.name.endswith(".warc.gz")][1:]


def test_query_of_signed_ids(spark, tmp_path):
    rows = [(-3, "http://a", "one"), (-1, "http://b", "one"), (0, None, None), (-(1 << 63), "http://c", "two")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    found = {r.page_id: (r.record_type, r.refers_to) for r in warc.op2_warc(spark, str(tmp_path)).collect()}
    assert found == {-3: ("response", None), -1: ("revisit", -3), 0: ("response", None), -(1 << 63): ("response", None)}


# Sharding


def least_capacity(sizes, n):
    def shards(c):
        k, at = 1, 0
        for s in sizes:
            if at + s > c:
                k, at = k + 1, 0
            at += s
        return k

    low, high = max(sizes), sum(sizes)
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if shards(middle) <= n else (middle + 1, high)
    return low


@pytest.mark.parametrize("n", [1, 3, 16])
def test_shards_against_brute_force(docs, rows, n):
    found = sharding.sharded(docs, n).collect()
    text = lambda t: (t or "").encode()
    assert Counter((r.id, r.size, r.text_crc32) for r in found) == Counter((i, len(text(t)) + 1, zlib.crc32(text(t))) for i, t, _ in rows)
    groups = defaultdict(int)
    for _, t, _ in rows:
        groups[hashlib.md5(text(t)).hexdigest()] += len(text(t)) + 1
    total, slots = Counter(), defaultdict(list)
    for r in found:
        total[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert max(total.values()) == least_capacity([groups[k] for k in sorted(groups)], n) and set(total) <= set(range(n))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    place = {i: r for r in found for i in [r.id]}
    assert len({place[i].shard for i, t, _ in rows if t == rows[0][1]}) == 1


def test_cuts_of_made_up_groups(spark):
    rng = random.Random(2)
    for n, count in ((2, 1), (5, 3), (7, 200), (16, 3000)):
        groups = [(hashlib.md5(str(k).encode()).hexdigest()[: 4 if count < 5 else 32].ljust(32, "0"), rng.choice([1, 5, 50, 3000])) for k in range(count)]
        capacity, starts = sharding.minimax_cuts(spark.createDataFrame(groups, "key string, size long"), n)
        assert capacity == least_capacity([s for _, s in sorted(groups)], n) and len(starts) < n


def test_shards_of_nothing(empty):
    assert sharding.sharded(empty, 4).count() == 0


# URL filters

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("a.net", "", "block"), ("a.net", "/x", "allow"), ("a.net", "/x", "block"), ("a.net", "/x/y", "allow"), (None, "/", "block"), ("org", None, "block")]
URLS = ["http://WWW.Example.com/en/1", "https://example.com/en", "https://example.com/en/", "http://m.example.com/en/a?b", "http://com", "http://x.com/", "http://xcom/", "http://b.net/es/#q", "http://b.net/es", "ftp://a.net?x", "http://a.net/xy", "http://a.net/x/yz", "http://a.net/x/", "http://.a.net/z", None, "", "nothing", "http://", "x://a.net/x/y?://com/", "http://Ä.COM/Ä", "http://" + "a." * 200 + "com/" + "b/" * 300]


def brute_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3 :]
    for mark in "?#":
        rest = rest.split(mark)[0]
    host, path = (rest[: rest.index("/")], rest[rest.index("/") :]) if "/" in rest else (rest, "")
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def test_urls_by_trie_and_by_join(spark):
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    pages = spark.createDataFrame([(k, u, "clash", "clash") for k, u in enumerate(URLS)] + [(None, URLS[0], "", ""), (0, URLS[0], "", "")], "page_id long, url string, host string, rule string")
    want = Counter()
    for k, u in [*enumerate(URLS), (None, URLS[0]), (0, URLS[0])]:
        host, path = brute_url(u)
        fits = [(h.count("."), len(p), h + p, v) for h, p, v in RULES if h is not None and p is not None and (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=None)
        want[(k, host, path, best and best[2], best[3] if best else "allow")] += 1
    for limit in (1 << 20, 0):
        assert Counter(tuple(r) for r in urls.judge(pages, rules, broadcast_nodes=limit).collect()) == want
    assert urls.judge(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in urls.judge(pages, rules.limit(0), default="block").collect()} == {"block"}


# Mixing


def words(t):
    return len((t or "").encode().split())


def test_mix_meets_its_targets(docs, rows, empty):
    found = mixing.taken_words(docs, block=16).collect()
    assert Counter((r.id, r.source, r.size) for r in found) == Counter((i, s, words(t)) for i, t, s in rows)
    own, taken, target = Counter(), Counter(), {}
    for r in found:
        own[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 3 * r.size
    assert all(int(target[s]) == taken[s] for s in own)
    order = sorted(own, key=lambda s: (s is None, s or ""))
    assert [target[s] for s in order] == mixing.targets([own[s] for s in order], [5, 2, 1, 5, 2][: len(order)])
    assert Counter(map(tuple, found)) == Counter(map(tuple, mixing.taken_words(docs, block=16).collect()))
    assert mixing.taken_words(empty).count() == 0


def test_targets_are_capped_and_shared_again():
    assert mixing.targets([100, 10, 1000], [5, 2, 1]) == [300.0, 30.0, 780.0]
    assert mixing.targets([0, 0], [5, 2]) == [0.0, 0.0] and mixing.targets([], []) == []
    assert mixing.targets([100, 100], [1, 1]) == [100.0, 100.0]


def test_schedule_is_even(spark):
    blocks = [500, 200, 100, 1, 0]
    slots = sorted((r.slot, r.s, r["rank"]) for r in mixing.schedule(spark, blocks).collect())
    for s, n in enumerate(blocks):
        ranks = [r for _, t, r in slots if t == s]
        assert ranks == list(range(len(ranks))) and len(ranks) >= n
    for upto in (50, 200, 700):
        for s, n in enumerate(blocks):
            assert abs(sum(t == s for _, t, _ in slots[:upto]) - upto * n / 801) < 5


def test_pieces_tile_the_documents(docs):
    pieces, rows_, _ = mixing.mix(docs, weights={None: 1, "a": 1, "b": 1, "big": 1, "c": 1}, block=64)
    assert pieces.where("from_word < 0 or from_word + n_words > size or n_words > 64").count() == 0
    per_slot = pieces.groupBy("slot").sum("n_words").where("`sum(n_words)` > 64").count()
    assert per_slot == 0 and rows_.count() == docs.count()


# SimHash


def brute_print(text):
    ws = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    ws = [w.decode() for w in ws.encode().split()]
    if not ws:
        return 0
    shingles = [" ".join(ws[k : k + 4]) for k in range(len(ws) - 3)] or [" ".join(ws)]
    codes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(c >> b & 1 for c in codes) > len(codes))


def brute_components(pairs, radius=4):
    prints = sorted({f for _, f in pairs})
    root = {f: f for f in prints}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for k, a in enumerate(prints):
        for b in prints[k + 1 :]:
            if (a ^ b).bit_count() <= radius:
                root[find(b)] = find(a)
    least = {}
    for i, f in pairs:
        if i is not None:
            least[find(f)] = min(least.get(find(f), i), i)
    return {f: least.get(find(f)) for f in prints}


def test_simhash_against_brute_force(docs, rows, empty, monkeypatch):
    pairs = [(i, brute_print(t)) for i, t, _ in rows]
    component = brute_components(pairs)
    found = Counter((r.id, r.fp & (1 << 64) - 1, r.component) for r in simhash.near_duplicates(docs).collect())
    assert found == Counter((i, f, component[f]) for i, f in pairs)
    assert max(Counter(component.values()).values()) > 1
    assert simhash.near_duplicates(empty).count() == 0
    assert [simhash.fingerprint(t) for _, t, _ in rows[:20]] == [f for _, f in pairs[:20]]
    monkeypatch.setattr(simhash, "CHUNK", 3)
    assert [simhash.fingerprint(t) for _, t, _ in rows[:20]] == [f for _, f in pairs[:20]]


def test_keys_grow_with_the_number_of_fingerprints():
    assert [simhash.blocks_alike(n, 4) for n in (0, 10**6, 10**8, 10**9, 10**10)] == [2, 2, 2, 3, 4]
    plans = [simhash.key_plan(n, 0.8) for n in (0, 512, 513, 10**5, 10**7, 10**10)]
    assert plans[:3] == [(1, 0), (1, 0), (12, 1)] and all(n / 2**size <= 512 for n, (_, size) in zip((0, 512, 513, 10**5, 10**7, 10**10), plans, strict=True))
    bits = np.random.default_rng(1).integers(0, 1 << 63, (50, 4), dtype=np.uint64)
    keys = simhash.bit_keys(bits, *simhash.key_plan(10**10, 0.8))
    assert keys.shape == (50, 584) and len({tuple(k) for k in keys}) == 50 and len(np.unique(keys >> 44)) == 584


@pytest.mark.parametrize("tile, spread, radius, alike", [(2048, 3, 4, None), (40, 3, 4, 2), (40, 6, 4, 3), (64, 2, 3, 4)])
def test_links_of_crowded_buckets(spark, tile, spread, radius, alike):
    rng = random.Random(tile + spread)
    prints = set()
    for center in [rng.getrandbits(64) for _ in range(3)]:
        for _ in range(150):
            f = center
            for _ in range(rng.randint(0, spread)):
                f ^= 1 << rng.randrange(64)
            prints.add(f)
    prints |= {rng.getrandbits(64) for _ in range(200)}
    signed = {f: f - (1 << 64) if f >> 63 else f for f in prints}
    edges = [(r.a, r.b) for r in simhash.links(spark.createDataFrame([(f,) for f in signed.values()], "fp long"), radius, tile, alike).collect()]
    back = {s: f for f, s in signed.items()}
    assert all((back[a] ^ back[b]).bit_count() <= 64 for a, b in edges)
    roots = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = brute_components([(s, f) for f, s in signed.items()], radius)
    groups = lambda of: {frozenset(x for x in prints if of(x) == g) for g in {of(x) for x in prints}}
    assert groups(lambda f: roots.get(signed[f], signed[f])) == groups(lambda f: want[f])


def shingles(text, width=5):
    words = (text or "").encode().lower().split()
    return {tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def edited(rng, text, share):
    return " ".join(w if rng.random() > share else f"new{rng.randrange(10**6)}" for w in text.split())


def test_similar_documents_against_shingles(spark, docs, rows, empty):
    found = {}
    for r in simhash.similar_documents(docs).collect():
        found.setdefault(r.id, set()).add(r.component)
    assert set(found) == {i for i, _, _ in rows if i is not None}
    by_text = {}
    for i, t, _ in rows:
        if i is not None:
            by_text.setdefault(" ".join((t or "").lower().split(" ")), set()).add(i)
    assert all(len({min(found[i]) for i in ids if len(found[i]) == 1}) <= 1 for ids in by_text.values())
    assert simhash.similar_documents(empty).count() == 0

    rng = random.Random(3)
    texts, origin = [], []
    for k in range(60):
        text = " ".join(f"w{rng.randrange(3000)}" for _ in range(rng.randint(100, 400)))
        for share in (0, 0.005, 0.01, 0.015, 0.02):
            texts.append(edited(rng, text, share))
            origin.append(k)
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    for tile in (simhash.WIDE_TILE, 2):  # the second deals every bucket over tiles
        component = {r.id: r.component for r in simhash.similar_documents(table, tile=tile).collect()}
        assert all(origin[component[i]] == origin[i] and component[i] <= i for i in range(len(texts)))
        sets = [shingles(t) for t in texts]
        near = [(i, j) for i in range(len(texts)) for j in range(i) if origin[i] == origin[j] and jaccard(sets[i], sets[j]) >= 0.8]
        assert len(near) > 200 and sum(component[i] == component[j] for i, j in near) >= 0.97 * len(near)


@pytest.mark.parametrize("low", [0.6, 0.65, 0.7, 0.75, 0.8, 0.85])
def test_links_in_a_band_of_similarity(spark, low):
    rng, texts, near = random.Random(int(100 * low)), [], []
    while len(near) < 150:
        text = " ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.randint(60, 300)))
        other = edited(rng, text, rng.uniform(0.01, 0.1))
        if low <= jaccard(shingles(text), shingles(other)) < low + 0.05:
            near.append((len(texts), len(texts) + 1))
            texts += [text, other]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    component = {r.id: r.component for r in simhash.similar_documents(table).collect()}
    linked = sum(component[i] == component[j] for i, j in near)
    assert linked >= 149 if low >= 0.8 else linked == 0


def test_alike_sets_against_brute_force():
    rng = random.Random(9)
    sets = [set(), set()]
    for _ in range(12):
        base = rng.sample(range(10**6), rng.randint(1, 60))
        sets += [set(x for x in base if rng.random() > share) | set(rng.sample(range(50), 2)) for share in (0, 0.05, 0.1, 0.2, 0.3)]
    rng.shuffle(sets)
    root = list(range(len(sets)))

    def find(k, of):
        while of[k] != k:
            k = of[k]
        return k

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if jaccard(a, b) >= 0.8:
                root[find(i, root)] = find(j, root)
    found = list(range(len(sets)))
    for a, b in zip(*simhash.alike([np.array(sorted(x), np.uint64) for x in sets], 0.8), strict=True):
        found[find(a, found)] = find(b, found)
    groups = lambda of: {frozenset(k for k in range(len(of)) if find(k, of) == find(r, of)) for r in of}
    assert groups(root) == groups(found) and len(groups(root)) < len(sets)


@pytest.mark.parametrize("crowd", [simhash.CROWD, 32])
def test_core_of_a_crowded_group_keeps_every_link(monkeypatch, crowd):
    monkeypatch.setattr(simhash, "CROWD", crowd)
    rng = random.Random(5)
    values = []
    for center in [rng.getrandbits(256) for _ in range(6)]:
        for _ in range(50):
            f = center
            for _ in range(rng.randint(0, 30)):
                f ^= 1 << rng.randrange(256)
            values.append(f)
    rng.shuffle(values)
    fp = np.array([[f >> 64 * k & (1 << 64) - 1 for k in range(4)] for f in values], np.uint64)
    for tile in (np.zeros(300, int), np.r_[np.zeros(140, int), np.ones(160, int)]):
        root = list(range(300))

        def find(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in zip(*simhash.stars(fp, np.zeros(300, int), tile, 34), strict=True):
            root[find(int(a))] = find(int(b))
        close = [(i, j) for i in range(300) for j in range(i) if (values[i] ^ values[j]).bit_count() <= 34]
        assert all(find(i) == find(j) for i, j in close if not tile.any() or tile[i] != tile[j])
        assert len({find(i) for i in range(300)}) >= 6


def test_bit_sliced_counts():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    b = a ^ (np.uint64(1) << rng.integers(0, 64, (6, 300), dtype=np.uint64)[: 6]).astype(np.uint64)[rng.integers(0, 6), :]
    x = np.concatenate([a ^ b, a, np.zeros(10, np.uint64), np.full(3, (1 << 64) - 1, np.uint64)])
    planes = simhash._planes(x)
    for radius in (1, 3, 4, 5, 8):
        (at,), close = simhash.close_words(lambda k, at: planes[k] if at is None else planes[k][at[0]], planes.shape[1], radius)
        word, bit = simhash._set_bits(close)
        got = {int(p) for p in at[word] * 64 + bit if p < len(x)}
        assert got == set(np.flatnonzero(np.bitwise_count(x) <= radius).tolist())


def test_long_chain_of_links(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(500, 501), (7, 7)], "a long, b long")
    assert {(r.node, r.root) for r in simhash.components(edges).collect()} == {(k, 0) for k in range(1, 201)} | {(501, 500)}
    assert simhash.components(edges.limit(0)).count() == 0


# Pipeline


def test_stages_against_brute_force(spark, docs, tmp_path):
    item = "never seen before words that only stand in the benchmark and in a leaked document of this test " * 2
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    more = docs.limit(1).selectExpr("999L as doc_id", f"concat('{' '.join(f'start{k}' for k in range(300))} ', '{item}') as text", *[c for c in docs.columns if c not in ("doc_id", "text")])
    docs.unionByName(more).write.parquet(str(tmp_path / "documents.parquet"))
    stage = dict(corpus_pipeline.STAGES)
    names = list(stage)
    assert len(names) == 5
    at = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = at.columns
    run = lambda name, d: stage[name](spark, d, str(tmp_path))
    as_rows = lambda d: Counter((r.doc_id, r.text) for r in d.select("doc_id", "text").collect())

    kept = run(names[0], at)
    bad = {i for i, t in as_rows(at) if (m := quality.measures(t))[0] < 10 or 100 * m[4] > 20 * m[0]}
    assert kept.columns == columns and as_rows(kept) == Counter({k: n for k, n in as_rows(at).items() if k[0] not in bad})

    once = run(names[1], kept)
    rest = [k for k in as_rows(kept) if k not in as_rows(once)]
    stay = [(k, shingles(k[1])) for k in as_rows(once) if k[0] is not None]
    assert set(as_rows(once)) <= set(as_rows(kept)) and set(as_rows(once).values()) == {1}
    assert rest and all(any(i < k[0] and jaccard(s, shingles(k[1])) > 0.6 for (i, _), s in stay) for k in rest)
    assert all(jaccard(a, b) < 0.85 for (k, a) in stay for (j, b) in stay if k < j)

    clean = run(names[2], once)
    assert as_rows(clean) == Counter({k: n for k, n in as_rows(once).items() if decontaminate.normalized(item) not in decontaminate.normalized(k[1])})
    assert 999 in {i for i, _ in as_rows(once)} - {i for i, _ in as_rows(clean)}

    mixed = run(names[3], clean)
    taken = {r.id: int(r.taken / r.size + 0.5) for r in mixing.taken_words(clean).collect() if r.size}
    assert mixed.columns == columns and as_rows(mixed) == Counter({k: taken[k[0]] for k in as_rows(clean) if taken.get(k[0])})

    last = run(names[4], mixed)
    assert Counter(r.doc_id for r in last.collect()) == Counter(k[0] for k in as_rows(mixed).elements())
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert Counter(map(tuple, whole.collect())) == Counter(map(tuple, last.collect()))


def test_stages_of_nothing(spark, empty, tmp_path):
    documents = empty.select("doc_id", "text", "lang", "source", "n_chars")
    documents.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, documents, str(tmp_path))
        assert found.columns == documents.columns and found.count() == 0, name
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_rows_without_or_with_one_id_are_judged_by_themselves(spark, tmp_path):
    rng = random.Random(4)
    clean = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(80)) for _ in range(4)]
    rows = [(None, clean[0]), (None, clean[0]), (None, clean[1]), (None, "too short"), (1, clean[2]), (1, "again and " * 30), (2, clean[3]), (2, clean[2])]
    docs = spark.createDataFrame([(i, t, "en", "host", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.quality(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter(k for k in rows if k[1] in clean)
    once = corpus_pipeline.near_copies(spark, kept, str(tmp_path))
    assert once.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in once.collect()) == Counter([(None, clean[0]), (None, clean[1]), (1, clean[2]), (2, clean[3])])
