"""The n-gram join against all pairs, its bounds, and families that only later rounds can tell apart."""

import random

import numpy as np
import pytest

from venuelake.llm import parity_join
from venuelake.llm.near_dedup import folded, shingle_set

SCHEMA = "doc_id long, text string, lang string, class string, rid string, node long, key long, n long, part long"


def components(rows, shingle):
    sets = [shingle_set(folded((t or "").encode()), shingle) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and rows[i][0] is not None and rows[j][0] is not None and 100 * len(a & b) >= 85 * len(a | b):
                root[find(i)] = find(j)
    group = {}
    for i, (d, _) in enumerate(rows):
        group.setdefault(find(i), []).append(d)
    return sorted(((d, len(sets[i]), min((x for x in group[find(i)] if x is not None), default=None) if d is not None and sets[i] else d) for i, (d, _) in enumerate(rows)), key=repr)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(12)
    vocabulary = [f"w{i}é" for i in range(400)]
    prose = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    out = [" ".join(prose(rng.randint(1, 200))) for _ in range(40)]
    for size, members in ((6, 12), (30, 15), (120, 25), (400, 12)):
        base = prose(size)
        for _ in range(members):  # edits around the threshold
            words = list(base)
            for _ in range(rng.randint(0, max(1, size // 25))):
                words[rng.randrange(size)] = rng.choice(vocabulary)
            out.append(" ".join(words[: rng.randint(size * 9 // 10, size)]))
    template = prose(60)
    out += [" ".join(template + prose(25)) for _ in range(30)]  # much in common, no links
    out += [out[50].upper(), out[50], "  " + out[50].replace(" ", "\n")]
    rows = list(enumerate(out)) + [(900, None), (901, ""), (902, " \t"), (903, "a"), (904, "A"), (905, "a b c"), (906, "b a c"), (907, "a " * 9000), (None, out[50]), (None, None), (50, "another text with one id of its own"), (7, out[7])]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("dense, block", [(32, 4096), (1, 7)])
def test_join(spark, rows, dense, block, monkeypatch):
    """Also with sketches so short that they let false pairs through, and in small blocks."""
    monkeypatch.setattr(parity_join, "DENSE", dense)
    monkeypatch.setattr(parity_join, "BLOCK", block)
    df = spark.createDataFrame([(d, t, "x", "c", "r", 1, 2, 3, 4) for d, t in rows], SCHEMA).repartition(3)
    got = sorted((tuple(r) for r in parity_join.ngram_join(df).collect()), key=repr)
    assert got == components(rows, 4)


def test_empty_table(spark):
    assert parity_join.ngram_join(spark.createDataFrame([], SCHEMA)).count() == 0


def test_linked_sizes_share_a_band_and_a_segment():
    bands = parity_join.bands(5000)
    for a in range(1, 2000):
        for b in (a, a + 1, a * 100 // 85 - 1, a * 100 // 85):
            if a <= b and 100 * a >= 85 * b:
                assert any(low <= a and b <= high for low, high, _ in bands), (a, b)
    rng = np.random.default_rng(3)
    for n in (1, 3, 6, 7, 11, 40, 300, 1500):
        for _ in range(20):
            base = rng.integers(0, 2**63, n).astype(np.uint64)
            other = base.copy()
            out = rng.permutation(n)[: n * 15 // 185]
            other[out] = rng.integers(0, 2**63, len(out)).astype(np.uint64)
            keys, row = parity_join.segment_keys(np.concatenate([base, other]), np.array([0, n, 2 * n]))
            both = set(base.tolist()) & set(other.tolist())
            assert 100 * len(both) < 85 * (2 * n - len(both)) or set(keys[row == 0].tolist()) & set(keys[row == 1].tolist())


def test_sketch_distance_is_a_lower_bound():
    rng = np.random.default_rng(4)
    for n in (1, 5, 100, 700):
        a, b = (rng.integers(0, 2**63, n).astype(np.uint64) for _ in range(2))
        b[: n // 2] = a[: n // 2]
        apart = len(set(a.tolist()) ^ set(b.tolist()))
        x, y = parity_join.dense_sketch(a), parity_join.dense_sketch(b)
        for size in (len(x), len(x) // 2, len(x) // 8):
            assert np.bitwise_count(parity_join.fold(x, size) ^ parity_join.fold(y, size)).sum() <= apart


@pytest.mark.parametrize("short, few", [(64, 8), (64, 0), (1024, 0)])
def test_false_pairs_of_short_sketches(spark, rows, short, few, monkeypatch):
    """Sketches that let much through, with all their pairs verified or a forest and then the tokens."""
    monkeypatch.setattr(parity_join, "SHORT", short)
    monkeypatch.setattr(parity_join, "FEW", few)
    df = spark.createDataFrame([(d, t, "x", "c", "r", 1, 2, 3, 4) for d, t in rows], SCHEMA).repartition(3)
    got = sorted((tuple(r) for r in parity_join.ngram_join(df).collect()), key=repr)
    assert got == components(rows, 4)


def test_only_compared_texts_move(spark):
    """Shuffles write less than the texts have, though there are links and open buckets."""
    rng = random.Random(5)
    texts = [" ".join(f"{rng.getrandbits(32):08x}" for _ in range(1000)) for _ in range(300)]
    texts += [t + " more" for t in texts[:9]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)

    def written():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        found = spark.sparkContext._jsc.sc().statusStore().executorList(True)
        return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))

    df = spark.read.schema(df.schema).parquet(parity_join.materialize(df, "test")._venuelake_path)
    before = written()
    got = parity_join.ngram_join(df).collect()
    assert written() - before < sum(map(len, texts))
    assert sorted((r.doc_id, r.component_id) for r in got) == [(i, i if i < 300 else i - 300) for i in range(309)]


def test_tokens_are_compared_only_where_sketches_allow(monkeypatch):
    rng = np.random.default_rng(6)
    bucket, asked = parity_join._Bucket(True), []
    base = np.unique(rng.integers(0, 2**63, 200)).astype(np.uint64)
    for i in range(60):
        own = base if i > 57 else np.unique(rng.integers(0, 2**63, 200)).astype(np.uint64)
        bucket.add(i, i, len(own), True, np.sort(own).tobytes())
    monkeypatch.setattr(np, "intersect1d", lambda *a, f=np.intersect1d, **b: asked.append(1) or f(*a, **b))
    assert bucket.pairs(False)[0] == [(58, 59)] and len(asked) == 1


@pytest.mark.parametrize("bits", [3, 16, 25])
def test_bitmap_loses_no_row(spark, bits, monkeypatch):
    monkeypatch.setattr(parity_join, "BITMAP_BITS", bits)
    marked = parity_join._marked(spark.range(3000).withColumnRenamed("id", "rid"), spark.range(0, 3000, 50).withColumnRenamed("id", "rid"))
    found = {r.rid for r in marked.where("maybe").collect()}
    assert found >= set(range(0, 3000, 50)) and marked.where("maybe is null").count() == 0
    assert bits < 25 or len(found) < 100
