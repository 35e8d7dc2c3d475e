"""Embedding, MinHash and suffix dedup against brute force."""

import hashlib
import itertools
import random

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from faultline.llm import contained, graph, minhash, neardup, suffixes
from faultline.llm.queries import QUERIES
from tests.llm.helpers import EDGE, edge, key
from tests.oracle import SF

LAST = 2**63 - 1


class Sets:
    def __init__(self, n):
        self.up = list(range(n))

    def root(self, a):
        while self.up[a] != a:
            self.up[a] = self.up[self.up[a]]
            a = self.up[a]
        return a

    def join(self, a, b):
        self.up[self.root(a)] = self.root(b)


def test_components(spark):
    random.seed(3)
    pairs = [(random.randrange(300), random.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5001 + i) for i in range(50)]
    sets = Sets(6000)
    for a, b in pairs:
        sets.join(a, b)
    nodes = {x for p in pairs if p[0] != p[1] for x in p}
    least = {}
    for x in sorted(nodes):
        least.setdefault(sets.root(x), x)
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: least[sets.root(x)] for x in nodes}


def slow_links(rows, cosine=0.95):
    n, links, sets, by = len(rows), [0] * len(rows), Sets(len(rows)), {}
    for k, (_, v) in enumerate(rows):
        if v and None not in v and np.isfinite(v).all() and np.any(v):
            by.setdefault(len(v), []).append(k)
    for ks in by.values():
        x = np.array([rows[k][1] for k in ks], float)
        x /= np.linalg.norm(x, axis=1)[:, None]
        for i, j in zip(*np.nonzero(x @ x.T >= cosine)):
            if i != j:
                links[ks[i]] += 1
                sets.join(ks[i], ks[j])
    least = {}
    for k in range(n):
        least.setdefault(sets.root(k), []).append(rows[k][0])
    least = {r: min((x for x in ids if x is not None), default=None) for r, ids in least.items()}
    return key((rows[k][0], links[k], least[sets.root(k)], rows[k][0] == least[sets.root(k)]) for k in range(n))


def test_embeddings(spark, monkeypatch):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(30, 16))
    rows = [(i, [float(x) for x in base[rng.integers(30)] * rng.uniform(0.5, 2) + rng.normal(size=16) * rng.choice([0, 0.05, 0.15])]) for i in range(400)]
    rows += [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, [1.0, None]), (1004, []), (1005, [1.0, 2.0]), (1006, [2.0, 4.0]), (None, [1.0, 2.0]), (1005, [1.0, 2.0]), (1007, [1e300] * 16), (1008, [-0.0, 1.0]), (1009, [0.0, 2.0])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, node string, n int")
    expected = slow_links(rows)
    monkeypatch.setattr(neardup, "MISS", 1e-6)
    assert key(neardup.links(df).collect()) == expected
    monkeypatch.setattr(neardup, "BLOCK", 8)
    assert key(neardup.links(df).collect()) == expected, "split buckets"
    assert neardup.links(df.limit(0)).count() == 0


def test_embedding_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert key(QUERIES["op5_embedding_dedup"](spark, SF).collect()) == slow_links(rows)


def slow_groups(rows, contain=0.6, ratio=0.4):
    texts = {}
    for i, t in rows:
        texts.setdefault(t or "", []).append(i)
    names = list(texts)
    sets = [set(minhash.shingles(t).tolist()) for t in names]
    links, joined = [0] * len(names), Sets(len(names))
    for a, b in itertools.combinations(range(len(names)), 2):
        low, high = sorted((len(sets[a]), len(sets[b])))
        if low and low >= ratio * high - 1e-9 and len(sets[a] & sets[b]) >= contain * low - 1e-9:
            links[a] += 1
            links[b] += 1
            joined.join(a, b)
    least = lambda ids: min((x for x in ids if x is not None), default=None)
    groups = {}
    for k, t in enumerate(names):
        groups.setdefault(joined.root(k), []).extend(texts[t])
    out = []
    for k, t in enumerate(names):
        lead = least(groups[joined.root(k)])
        kept = False
        for i in sorted(texts[t], key=str):
            first = i == lead and not kept
            kept = kept or first
            out.append((i, least(texts[t]), lead, len(texts[t]) - 1, links[k], first))
    return key(out)


def near_copies(n=250):
    random.seed(1)
    base = ["".join(random.choice("abcdefghij") for _ in range(4)) + str(k) for k in range(500)]
    rows = []
    for i in range(n):
        k, size = random.randrange(8), random.choice([1, 2, 4, 10, 40, 50, 60])
        rows.append((i, " ".join(random.choice(base) if random.random() < 0.04 else w for w in base[k * 60 : k * 60 + size]) if random.random() > 0.03 else None))
    return rows


@pytest.mark.parametrize("block", [256, 8])
def test_minhash(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    rows = near_copies() + [(1000 + i, t) for i, t in enumerate(["", "one", "ONE", "one", " \n", "a b", "a  b"])] + [(2000, "x " * 40_000 + "y")]
    got, expected = key(minhash.groups(edge(spark, rows)).collect()), slow_groups(rows)
    assert [(r[0], r[1], r[3]) for r in got] == [(r[0], r[1], r[3]) for r in expected]
    assert all(g[4] <= e[4] for g, e in zip(got, expected)), "no link that isn't one"
    assert sum(r[4] for r in got) >= 0.98 * sum(r[4] for r in expected), "few that are missed"
    assert sum(r[5] for r in got) == len({r[2] for r in got if r[2] is not None})


def test_minhash_query_loses_few_links(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got, expected = {r[0]: r for r in QUERIES["op6_minhash_dedup"](spark, sf).collect()}, {r[0]: r for r in slow_groups(rows)}
    assert got.keys() == expected.keys() and all(got[i].n_links <= expected[i][4] for i in got)
    assert sum(r.n_links for r in got.values()) >= 0.97 * sum(r[4] for r in expected.values())
    assert all(got[i].class_id == expected[i][1] and got[i].n_copies == expected[i][3] for i in got)


def test_minhash_edges(spark):
    df = edge(spark)
    got = minhash.dedup(df)
    assert got.columns == df.columns
    texts = sorted(str(r.text) for r in got.collect())
    assert texts.count("twice") == 1 and texts.count("tie") == 1 and got.count() == 9
    assert minhash.groups(edge(spark, [])).count() == 0 and minhash.dedup(edge(spark, [])).count() == 0


@pytest.mark.parametrize("block", [256, 1])
def test_minhash_holds_failed_members_against_the_whole_bucket(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    # two buckets. 1: A is linked with the centre C, B only with A. 2: local centre L fails the centre C2, its own member
    # M is linked with C2; nothing is linked with N
    near = {"C": range(0, 100), "A": range(30, 130), "B": range(65, 165), "C2": range(1000, 1100), "L": range(1060, 1160), "M": range(1030, 1130), "N": range(5000, 5100)}
    name = {k: bytes([i]) * 16 for i, k in enumerate(["C", "A", "B", "C2", "L", "M", "N"])}
    sets = spark.createDataFrame([(name[k], minhash.packed(np.array(v, np.uint64) << np.uint64(16))) for k, v in near.items()], "class binary, set binary")
    rows = [(1, "C", "A", True), (1, "C", "B", False), (2, "C2", "L", False), (2, "L", "M", True), (2, "C2", "N", False), (3, "C", "A", True)]
    buckets = {(a, b): [k for k, x, y, _ in rows if (x, y) == (a, b)] for _, a, b, _ in rows}
    pairs = spark.createDataFrame([(name[a], name[b], ks) for (a, b), ks in buckets.items()], minhash.STARS)
    checked = spark.createDataFrame(list({(name[a], name[b], ok) for _, a, b, ok in rows}), "centre binary, member binary, linked boolean")
    failed = minhash._unsettled(pairs, checked)
    of = {v: k for k, v in name.items()}
    assert {(r.key, of[bytes(r["class"])]): r.failed for r in failed.collect()} == {(1, "C"): False, (1, "A"): False, (1, "B"): True, (2, "C2"): False, (2, "L"): True, (2, "M"): True, (2, "N"): True}
    sketched = spark.createDataFrame([(name[k], len(v), *minhash.sketches(np.array(v, np.uint64), 0.4)) for k, v in near.items()], "class binary, n long, small binary, large binary")
    assert minhash._accompanied(failed, sketched, 0.6, 0.4).count() <= failed.count()
    edges = minhash._compare_blocks(failed, sets, 0.6, 0.4, True)
    joined = Sets(7)
    for _, a, b, ok in rows:
        if ok:
            joined.join(name[a][0], name[b][0])
    for r in edges.collect():
        joined.join(r.a[0], r.b[0])
    parts = {}
    for i, k in enumerate(name):
        parts.setdefault(joined.root(i), set()).add(k)
    assert sorted(map(sorted, parts.values())) == [["A", "B", "C"], ["C2", "L", "M"], ["N"]]


def test_minhash_links_texts_that_grew(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: r for r in QUERIES["op6_minhash_dedup"](spark, sf).collect()}
    for a, b in ((453, 658), (152, 892), (283, 369)):
        assert got[a].group_id == got[b].group_id and not (got[a].kept and got[b].kept)
    texts = {}
    for i, t in rows:
        texts.setdefault(t or "", i)
    sets = {i: set(minhash.shingles(t).tolist()) for t, i in texts.items()}
    whole = found = 0
    links = dict.fromkeys(sets, 0)
    for a, b in itertools.combinations(sets, 2):
        low, high = sorted((len(sets[a]), len(sets[b])))
        if low and low >= minhash.RATIO * high - 1e-9 and len(sets[a] & sets[b]) >= 0.6 * low - 1e-9:
            links[a], links[b], whole = links[a] + 1, links[b] + 1, whole + 1
            found += got[a].group_id == got[b].group_id
    assert found >= 0.97 * whole
    assert all(got[i].n_links <= n for i, n in links.items()) and sum(got[i].n_links for i in links) >= 0.97 * 2 * whole


def slow_contained(texts, contain=0.6, ratio=0.4):
    """Of each of the different ``texts``: the links with texts whose sizes are beyond the ratio."""
    sets, links = [set(minhash.shingles(t).tolist()) for t in texts], dict.fromkeys(texts, 0)
    for a, b in itertools.combinations(range(len(texts)), 2):
        low, high = sorted((len(sets[a]), len(sets[b])))
        if 0 < low < ratio * high - 1e-9 and len(sets[a] & sets[b]) >= contain * low - 1e-9:
            links[texts[a]] += 1
            links[texts[b]] += 1
    return links


@pytest.mark.parametrize("rows", ["given", "drawn"])
def test_minhash_counts_links_of_any_sizes(spark, rows):
    sf = "/root/testdata/sf0.01"
    if rows == "given":
        rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
        got = QUERIES["op6_minhash_dedup"](spark, sf).collect()
    else:
        rows = near_copies() + [(1000 + i, t) for i, t in enumerate(["", "one", "ONE", "one", " \n", "a b", "a  b"])] + [(2000, "x " * 40_000 + "y"), (2001, "x x x"), (2001, "x x x")]
        got = minhash.groups(edge(spark, rows)).collect()
    whole = slow_contained(list({t or "": None for _, t in rows}))
    assert sum(whole.values()) > 20
    assert sorted((r.doc_id, r.n_contained) for r in got) == sorted((i, whole[t or ""]) for i, t in rows)


@pytest.mark.parametrize("lots", [(150, 5, 7), (1_000_000, 500_000, 2_000_000)])
def test_contained_in_lots(monkeypatch, lots):
    for name, n in zip(("SENT", "RUN", "MANY"), lots):
        monkeypatch.setattr(contained, name, n)
    texts = list({t or "": None for _, t in near_copies(120)})
    name = lambda t: hashlib.md5(t.encode()).digest()
    told = [pa.RecordBatch.from_arrays([pa.array([name(t) for t in ts]), pa.array(ts)], ["class", "text"]) for ts in (texts[:70], texts[50:], texts[:9])]

    def by_part(rows, f):
        return [f(rows.filter(pc.equal(rows["part"], p))) for p in pc.unique(rows["part"]).to_pylist()]

    of = lambda table, *kinds: table.filter(pc.is_in(table["kind"], pa.array(kinds, pa.int32())))
    spelt = pa.concat_tables(pa.Table.from_batches(list(contained._spelt(minhash.shingles, 3)([b]))) for b in told)
    far = pa.concat_tables(by_part(spelt, contained._find(0.4, 3)))
    asks = pa.concat_tables(by_part(of(far, contained.ASKED), contained._choose(0.6)))
    met = pa.concat_tables(by_part(pa.concat_tables([of(far, contained.HELD), of(asks, contained.CHOSEN)]), contained._meet(0.4, 3)))
    askers = of(asks, contained.ASKER)
    every = pa.concat_tables([met, *[askers.set_column(0, "part", pa.array([p] * len(askers), pa.int32())) for p in range(3)]])
    links = dict.fromkeys((name(t)[:8] for t in texts), 0)
    for t in by_part(every, contained._count(0.6)):
        for i, n in zip(*t.to_pydict().values()):
            links[i] += n
    assert links == {name(t)[:8]: n for t, n in slow_contained(texts).items()} and sum(links.values()) > 20


def test_banding_meets_its_bound():
    for p in range(0, 40):
        rows, bands = minhash.banding(p, 0.6, 0.8)
        assert rows * bands <= minhash.VALUES and rows >= 1 and bands >= 1


def test_banding_misses_at_most_three_percent():
    assert minhash.MISS <= 0.03
    random.seed(4)
    for ratio, wide in ((0.4, 0.4), (0.4, 0.6), (0.4, 1.0), (0.8, 0.8)):
        for n in (150, 500, 1000, 1500):
            m, missed = int(n / wide), 0
            both = -(-6 * n // 10)
            for _ in range(60):
                h = np.array([random.getrandbits(64) for _ in range(n + m - both)], np.uint64)
                a, b = np.sort(h[:n]), np.sort(h[n - both :])
                met = np.intersect1d(minhash.band_keys(a, 0.6, ratio), minhash.band_keys(b, 0.6, ratio))
                apart = minhash.size_code(m, ratio) - minhash.size_code(n, ratio)
                missed += not (minhash.least_steps(0.6, ratio)[(met & np.uint64(127)).astype(int)] <= apart).any()
            assert missed <= 6, (ratio, n)


def test_sketches_pass_linked_pairs():
    rng, missed, far = np.random.default_rng(5), 0, 0
    for k in range(400):
        n = int(rng.integers(20, 1500))
        m = int(rng.integers(n, int(n / 0.4) + 1))
        for share in (-(-6 * n // 10), n // 8):
            h = rng.integers(0, 1 << 63, n + m - share, dtype=np.uint64) * np.uint64(2)
            a, b = np.sort(h[:n]), np.sort(h[n - share :])
            s0, s1 = ([minhash.sketches(x, 0.4)[j] for x in (a, b)] for j in (0, 1))
            which = s0 if None not in s0 else s1
            equal = sum(p == q for p, q in zip(*which))
            near = equal >= minhash.least_equal(0.6, 0.4, np.array(n), np.array(m))
            missed += share > n // 8 and not near
            far += share == n // 8 and bool(near)
    assert missed <= 6 and far <= 80


def slow_repeats(rows, length=50):
    first = {}
    for i, t in rows:
        raw, i = (t or "").encode(), LAST if i is None else i
        for s in range(len(raw) - length + 1):
            w = raw[s : s + length]
            if first.get(w, LAST + 1) > i:
                first[w] = i
    out = []
    for i, t in rows:
        raw, number = (t or "").encode(), LAST if i is None else i
        gone = bytearray(len(raw))
        for s in range(len(raw) - length + 1):
            if first[raw[s : s + length]] < number:
                gone[s : s + length] = b"\1" * length
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return key(out)


@pytest.mark.parametrize(("chunk", "block", "part"), [(2 << 20, 1 << 20, 6 << 20), (4000, 3000, 8000)])
def test_repeats(spark, monkeypatch, chunk, block, part):
    monkeypatch.setattr(suffixes, "CHUNK", chunk)
    monkeypatch.setattr(suffixes, "BLOCK", block)
    monkeypatch.setattr(suffixes, "PART", part)
    random.seed(2)
    base, rows = "".join(random.choices("abcdefgh ", k=4000)), []
    for i in range(200):
        t = ""
        for _ in range(random.randrange(0, 6)):
            a = random.randrange(3900)
            t += base[a : a + random.randrange(20, 140)]
            t += random.choice(["", "", "x" * random.randrange(150), "ab" * random.randrange(60), "é日本" * random.randrange(30)])
        rows.append((random.choice([i, i, i, 5, None]), t if random.random() > 0.05 else None))
    assert key(suffixes.repeats(edge(spark, rows)).collect()) == slow_repeats(rows)


def test_repeats_query_and_edges(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert key(QUERIES["op9_suffix_dedup"](spark, SF).collect()) == slow_repeats(rows)
    assert key(suffixes.repeats(edge(spark)).collect()) == slow_repeats(EDGE)
    assert suffixes.repeats(edge(spark, [])).count() == 0
    assert {bytes(r.kept) for r in suffixes.repeats(edge(spark, [(1, "short")]), texts=True).collect()} == {b"short"}
    with pytest.raises(ValueError):
        suffixes.repeats(edge(spark), length=10)


def test_suffix_sort():
    random.seed(6)
    raw = np.frombuffer("".join(random.choices("ab", k=3000)).encode() + b"abab" * 200, np.uint8)
    starts = np.arange(0, len(raw) - 50)
    order = suffixes.suffix_sort(raw, suffixes.prefix_hashes(raw), starts, 50)
    assert [raw[s : s + 50].tobytes() for s in starts[order]] == sorted(raw[s : s + 50].tobytes() for s in starts)
    groups = suffixes.equal_groups(raw, starts, 50)
    by = {}
    for s, g in zip(starts, groups):
        by.setdefault(int(g), set()).add(raw[s : s + 50].tobytes())
    assert all(len(x) == 1 for x in by.values()) and len(by) == len({raw[s : s + 50].tobytes() for s in starts})
    a, b = np.array([0, 3000, 5]), np.array([1, 3004, 5])
    ext = suffixes.common_extension(suffixes.prefix_hashes(raw), a, b, np.array([40, 40, 40]))
    for x, y, e in zip(a, b, ext):
        n = next((k for k in range(40) if raw[x + k] != raw[y + k]), 40)
        assert e == n


def test_company_looks_at_no_pair_that_tells_nothing(monkeypatch):
    import numpy as np
    import pyarrow as pa

    from faultline.llm import minhash

    rng = np.random.default_rng(3)
    base = rng.integers(0, 256, (3, minhash.VALUES), dtype=np.uint8)
    n, classes = 600, [i.to_bytes(16, "big") for i in range(600)]
    rows = [base[i % 3] if i % 10 else rng.integers(0, 256, minhash.VALUES, dtype=np.uint8) for i in range(n)]  # each tenth is alone
    failed = [i % 4 != 1 for i in range(n)]
    columns = [[7] * n, [0] * n, [0] * n, [0] * n, classes, failed, [50] * n, [r.tobytes() for r in rows], [None] * n]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.bool_(), pa.int64(), pa.binary(), pa.binary()]
    batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [str(i) for i in range(9)])
    looked = []
    least = minhash.least_equal
    monkeypatch.setattr(minhash, "least_equal", lambda c, r, low, high: looked.append(len(low)) or least(c, r, low, high))
    got = {c for b in minhash._company(0.6, minhash.RATIO)(iter([batch])) for c in b.column(1).to_pylist()}
    assert got == {classes[i] for i in range(n) if i % 10}
    assert sum(looked) < n * (n - 1) // 2 // 2
    assert minhash.VALUES < 256 and minhash._equal(base, base).tolist() == [minhash.VALUES] * 3
    other = rng.integers(0, 3, (2, 50, minhash.VALUES), dtype=np.uint8)
    assert minhash._equal(*other).tolist() == (other[0] == other[1]).sum(axis=1).tolist()
