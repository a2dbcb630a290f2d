import hashlib
import re
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pytest

from quern.llm import simhash
from quern.llm.exact_dedup import exact_dedup, misra_gries
from quern.llm.simhash import GrayIndex, components, fingerprint, gray_rank, near_duplicates


def exact_brute(rows):
    groups = defaultdict(list)
    for doc, text, *_ in rows:
        sha = hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", text or "").encode()).hexdigest()
        groups[sha].append((-len(text or ""), doc is None, doc or 0, doc))
    out = Counter()
    for sha, members in groups.items():
        members.sort()
        for k, m in enumerate(members):  # one row of each group is kept
            out[m[3], members[0][3], len(members), k == 0, sha] += 1
    return out


@pytest.mark.parametrize("limits", [{}, {"counters": 4, "least": 1}, {"counters": 1, "least": 1}])
def test_exact(edge, edge_rows, nothing, limits):
    got = exact_dedup(edge, **limits)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got.collect()) == exact_brute(edge_rows)
    assert exact_dedup(nothing, **limits).count() == 0


def test_exact_with_a_hot_text(spark):
    rows = [(k, "same  text" if k % 3 == 0 else f"text {k % 400}") for k in range(6000)]
    got = exact_dedup(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7), counters=64, least=8)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got.collect()) == exact_brute(rows)


def test_misra_gries_bounds():
    rng = np.random.default_rng(1)
    stream = rng.zipf(1.5, 20_000) % 1000
    keys, counts, off = np.empty(0, np.int64), np.empty(0, np.int64), 0
    for part in np.split(stream, 20):
        keys, counts, cut = misra_gries(np.concatenate([keys, part]), np.concatenate([counts, np.ones(len(part), np.int64)]), 50)
        off += cut
    true = Counter(stream.tolist())
    assert len(keys) <= 50 and off <= len(stream) / 51
    kept = dict(zip(keys.tolist(), counts.tolist()))
    for key, n in true.items():
        assert n - off <= kept.get(key, 0) <= n


def simhash_brute(text):
    import xxhash

    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def joined(values, distance):
    label = list(range(len(values)))

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    for a in range(len(values)):
        for b in range(a):
            if (values[a] ^ values[b]).bit_count() <= distance:
                ra, rb = root(a), root(b)
                label[max(ra, rb)] = min(ra, rb)
    return [root(k) for k in range(len(values))]


def near_brute(rows, distance=4):
    prints = [simhash_brute(r[1]) for r in rows]
    label = joined(prints, distance)
    least = defaultdict(list)
    for k, r in zip(label, rows):
        if r[0] is not None:
            least[k].append(r[0])
    out, seen = Counter(), set()
    for r, p, k in sorted(zip(rows, prints, label), key=lambda x: (x[2], x[0][0] is None, x[0][0] or 0)):
        out[r[0], f"{p:016x}", min(least[k], default=None)] += 1
        seen.add(k)
    out.classes = len(seen)
    return out


def check_near(got, rows):
    got, want = got.collect(), near_brute(rows)
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == want
    kept = [r for r in got if r.kept]  # one row of each component, with its smallest id
    assert len(kept) == want.classes and all(r.doc_id == r.component_id for r in kept)


@pytest.mark.parametrize("bucket_rows", [1 << 20, 2])
def test_near(edge, edge_rows, nothing, bucket_rows):
    check_near(near_duplicates(edge, bucket_rows=bucket_rows), edge_rows)
    assert near_duplicates(nothing, bucket_rows=bucket_rows).count() == 0


@pytest.mark.parametrize("bucket_rows", [1 << 20, 8])
def test_near_with_drifting_copies(spark, bucket_rows):
    rng = np.random.default_rng(3)
    base = [f"w{k}" for k in rng.integers(0, 500, 120)]
    rows = []
    for k in range(300):  # a chain: each text is the one before with one word changed, some are new
        if k % 40 == 0:
            base = [f"w{j}" for j in rng.integers(0, 500, 120)]
        base = list(base)
        base[rng.integers(0, 120)] = f"n{k}"
        rows.append((1000 - k, " ".join(base)))
    rows += [(2000, None), (2001, ""), (2002, " ")]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), bucket_rows=bucket_rows)
    check_near(got, rows)
    assert len({k[2] for k in near_brute(rows)}) < 200


def shingles(text, words=5):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    found = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {" ".join(found[k : k + words]) for k in range(max(1, len(found) - words + 1))} if found else set()


def jaccard_brute(rows, similarity=0.8, words=5):
    """For each row the smallest id of its component over pairs of that Jaccard similarity, by their definition."""
    sets = [shingles(r[1], words) for r in rows]
    label = list(range(len(rows)))

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            union = len(sets[a] | sets[b])
            if not union or len(sets[a] & sets[b]) >= similarity * union:
                label[max(root(a), root(b))] = min(root(a), root(b))
    label = [root(k) for k in range(len(rows))]
    least = defaultdict(list)
    for k, r in zip(label, rows):
        if r[0] is not None:
            least[k].append(r[0])
    return Counter((r[0], min(least[k], default=None)) for r, k in zip(rows, label)), len(set(label))


def similar_rows():
    """Copies with a few words changed, texts of which half is another's, short and blank texts."""
    rng = np.random.default_rng(17)
    draw = lambda n: [f"w{k}" for k in rng.integers(0, 3000, n)]
    rows, shared = [], draw(60)
    for k in range(40):
        base = draw(int(rng.integers(80, 400)))
        rows.append((100 * k + 7, " ".join(base)))
        for j in range(k % 4):  # one word in a hundred: similarity about 0.9
            copy = list(base)
            for at in rng.choice(len(copy), max(1, len(copy) // 110), replace=False):
                copy[at] = f"n{k}{j}{at}"
            rows.append((100 * k + j, "  ".join(copy).upper() if j else " ".join(copy)))
        rows.append((100 * k + 50, " ".join(base[: len(base) // 2] + draw(len(base) // 2))))
        rows.append((100 * k + 60, " ".join(shared + draw(int(rng.integers(40, 90))))))  # a passage that many share
    rows += [(9000, "one two three"), (9001, "One two  three"), (9002, "one two four"), (9003, None), (9004, ""), (9005, " \n"), (9006, "a " * 4000)]
    return rows + [(None, rows[0][1]), (None, "only this one has no id"), rows[3], rows[3]]


@pytest.mark.parametrize("bucket_rows", [None, 8])
def test_similar_sets(spark, bucket_rows):
    rows = similar_rows()
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = near_duplicates(df, words=5, similarity=0.8, bucket_rows=bucket_rows).collect()
    want, classes = jaccard_brute(rows)
    assert Counter((r.doc_id, r.component_id) for r in got) == want
    kept = [r for r in got if r.kept]
    assert len(kept) == classes and all(r.doc_id == r.component_id for r in kept)


def test_similar_sets_edges(edge, edge_rows, nothing):
    got = near_duplicates(edge, words=5, similarity=0.8).collect()
    assert Counter((r.doc_id, r.component_id) for r in got) == jaccard_brute(edge_rows)[0]
    assert near_duplicates(nothing, words=5, similarity=0.8).count() == 0


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(23)
    found, missed, wrong = 0, 0, 0
    for _ in range(300):
        base = [f"w{k}" for k in rng.integers(0, 10**6, 400)]
        other = list(base)
        for at in rng.choice(396, int(rng.integers(1, 40)), replace=False):
            other[at] = f"n{at}"
        a, b = " ".join(base), " ".join(other)
        true = len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))
        (_, x, keys), (_, y, others) = simhash.sketch(a.encode(), 5), simhash.sketch(b.encode(), 5)
        differ = int(simhash.unlike(np.frombuffer(x, "<u8")[None], np.frombuffer(y, "<u8")[None])[0])
        slow = sum((p >> s & 15) != (q >> s & 15) for p, q in zip(x, y) for s in (0, 4))
        assert differ == slow
        estimate = 1 - differ / 128 * 16 / 15
        assert abs(estimate - true) < 0.2
        alike = differ <= simhash.most_unlike(0.8) and bool(set(zip(range(8), keys)) & set(zip(range(8), others)))
        found += true >= 0.85 and alike
        missed += true >= 0.85 and not alike
        wrong += true < 0.65 and alike
    assert found > 30 and missed <= 0.05 * found and wrong <= 2


def hot_rows():
    """Nine tenths of the rows are blank, and nine tenths of the other texts are one chain of near copies."""
    rng = np.random.default_rng(9)
    rows = [(k, ["", None, " \n"][k % 3]) for k in range(1800)]
    base = [f"w{k}" for k in rng.integers(0, 500, 500)]
    for k in range(180):
        base = list(base) if k % 3 else base  # chains and a star
        base[rng.integers(0, 500)] = f"n{k}"
        rows.append((5000 - k, " ".join(base)))
    return rows + [(6000 + k, " ".join(f"x{j}" for j in rng.integers(0, 900, 60))) for k in range(20)]


def test_near_with_hot_keys(spark, monkeypatch):
    """Fingerprints, nodes and labels that hold most rows are joined where they lie, with the same result."""
    from quern.llm import common

    split = []
    join = common.hot_join
    monkeypatch.setattr(common, "SMALL", -1)
    monkeypatch.setattr(common, "HOT", 20)
    monkeypatch.setattr(simhash, "hot_join", lambda left, right, on, hot: (split.append((on, hot is not None)), join(left, right, on, hot))[1])
    rows = hot_rows()
    check_near(near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)), rows)
    assert {on for on, found in split if found} >= {"mid", "label"}
    assert ("node", True) in split[-1:]  # the documents and their fingerprints
    star = [(7, k) for k in range(100, 400)] + [(k, k + 1) for k in range(1000, 1040)]
    split.clear()
    got = {r.node: r.label for r in components(spark.createDataFrame(star, "a bigint, b bigint")).collect()}
    assert got == {k: 7 for k in (7, *range(100, 400))} | {k: 1000 for k in range(1000, 1041)} and ("node", True) in split


def test_hot_join(spark, monkeypatch):
    from quern.llm import common

    monkeypatch.setattr(common, "SMALL", -1)
    rows = [(k, 0 if k % 3 else k) for k in range(3000)] + [(9000 + k, 1) for k in range(100)]
    left = common.stored(spark.createDataFrame(rows, "id bigint, x bigint"), "left")
    right = common.stored(left.select("x").distinct().selectExpr("x", "x * 2 as y"), "right")
    hot = common.hot_keys(left, "x")
    assert {r.x for r in hot.collect()} == {0, 1}
    got = common.hot_join(left, right, "x", hot)
    assert sorted(map(tuple, got.select("id", "x", "y").collect())) == sorted((k, x, 2 * x) for k, x in rows)
    common.forget(hot)
    assert common.hot_keys(right, "x") is None


def test_batches_are_bounded(spark):
    from quern.llm import common

    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(rows)
    try:
        spark.conf.set(rows, "10000")
        common.ship(spark)
        assert (spark.conf.get(rows), spark.conf.get(size)) == ("1000", str(4 << 20))
        spark.conf.set(rows, "77")  # a session's own setting stays
        common.ship(spark)
        assert spark.conf.get(rows) == "77"
    finally:
        spark.conf.set(rows, before)


def test_scratch_needs_a_shared_folder():
    from quern.llm import common

    far = SimpleNamespace(conf=SimpleNamespace(get=lambda key, other: other), sparkContext=SimpleNamespace(master="spark://far:7077"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.scratch(far, "x")


def test_fingerprint_of_long_text():
    text = " ".join(f"w{k % 997}" for k in range(250_000))
    parts = text.split()
    import xxhash

    ones = np.zeros(64, int)
    for k in range(len(parts) - 3):
        h = xxhash.xxh64_intdigest(" ".join(parts[k : k + 4]), 42)
        ones += [(h >> b) & 1 for b in range(64)]
    assert fingerprint(text.encode()) == sum(1 << b for b in range(64) if 2 * ones[b] > len(parts) - 3)


def test_gray_index_equals_brute_force():
    rng = np.random.default_rng(4)
    centres = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    values = []
    for k in range(500):
        v = int(centres[k % 6])
        for bit in rng.integers(0, 64, rng.integers(0, 7)):
            v ^= 1 << int(bit)
        values.append(v)
    values = sorted(set(values))
    for distance in (1, 4, 7):
        got = GrayIndex(np.zeros(len(values), np.int64), np.array(values, np.uint64)).links(distance)
        want = joined(values, distance)
        assert len(set(zip(got.tolist(), want))) == len(set(want)) == len(set(got.tolist()))


def test_gray_rank():
    codes = np.arange(4096, dtype=np.uint64)
    assert np.array_equal(gray_rank(codes ^ (codes >> np.uint64(1))), codes)


def test_components(spark):
    chain = [(k, k + 1) for k in range(60)] + [(500, k) for k in range(501, 560)] + [(-3, 70), (70, -9)]
    got = {r.node: r.label for r in components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert got == {k: 0 for k in range(61)} | {k: 500 for k in range(500, 560)} | {-3: -9, 70: -9, -9: -9}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_parts_follow_the_size(spark, monkeypatch):
    from quern.llm import common

    df = spark.range(1000)
    assert common.parts(df) == []
    monkeypatch.setattr(common, "PARTITION_BYTES", 100)
    assert common.parts(df) == [80] and common.parts(df, 2) == [160]
    assert df.repartition(*common.parts(df), "id").rdd.getNumPartitions() == 80


def test_spread_deals_out_small_files_only(spark, tmp_path, monkeypatch):
    from quern.llm import common

    spark.range(1000).coalesce(1).write.parquet(f"{tmp_path}/one")
    one = spark.read.parquet(f"{tmp_path}/one")
    cores = spark.sparkContext.defaultParallelism
    assert common.spread(one).rdd.getNumPartitions() == cores and common.spread(one).count() == 1000
    assert common.spread(spark.range(10)) is not None
    monkeypatch.setattr(common, "PARTITION_BYTES", 10)
    assert common.spread(one) is one
