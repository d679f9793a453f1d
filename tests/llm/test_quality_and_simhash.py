import random
import zlib
from collections import Counter

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from tapeloom.llm import quality, queries, simhash
from tapeloom.llm.common import Scratch
from tapeloom.llm.graph import components


def plain_fingerprint(text):
    words = [w for w in "".join(c.lower() if c.isascii() else c for c in text).replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def union(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for a, b in links:
        parent[find(a)] = find(b)
    return [find(x) for x in range(n)]


@pytest.mark.parametrize("which", ["edge", "small", "empty"])
def test_op8(spark, request, which):
    folder = request.getfixturevalue(which)
    rows = [(r.doc_id, plain_fingerprint(r.text or "")) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    root = union(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (rows[i][1] ^ rows[j][1]).bit_count() <= 4])
    least = {}
    for (doc, _), r in zip(rows, root, strict=True):
        if doc is not None:
            least[r] = min(least.get(r, doc), doc)
    want = Counter((doc, f"{fp:016x}", least.get(r)) for (doc, fp), r in zip(rows, root, strict=True))
    assert Counter(map(tuple, queries.op8_simhash(spark, folder).collect())) == want


def test_triples_cover_every_four_positions():
    from itertools import combinations

    assert len(simhash.TRIPLES) == 20
    assert all(any(set(t) <= set(q) for t in simhash.TRIPLES) for q in combinations(range(8), 4))


@pytest.mark.parametrize("limit", [3, 2048])
def test_links_keep_every_component(spark, limit, monkeypatch):
    rnd = random.Random(limit)
    fps = set()
    for _ in range(12):
        x = rnd.getrandbits(64)
        for _ in range(25):
            y = x
            for _ in range(rnd.randrange(4)):
                y ^= 1 << rnd.randrange(64)
            fps.add(y)
            x = y if rnd.random() < 0.5 else x
    fps = sorted(fps)
    monkeypatch.setattr(simhash, "LIST", limit)
    monkeypatch.setattr(simhash, "BLOCK", max(2, limit // 2))
    frame = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp bigint")
    scratch = Scratch(spark, "t")
    if limit == 3:  # the workers import the module anew: go through the same steps by hand
        frame = frame.cache()
        found = [(r.a, r.b) for r in simhash._blocks(frame.selectExpr("1L AS list", "fp")).collect()]
    else:
        found = [(r.a, r.b) for r in simhash.links(frame, scratch).collect()]
    at = {int(np.uint64(f).view(np.int64)): i for i, f in enumerate(fps)}
    got = union(len(fps), [(at[a], at[b]) for a, b in found])
    want = union(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4])
    same = lambda r: {frozenset(i for i in range(len(r)) if r[i] == x) for x in set(r)}
    assert same(got) == same(want)


def test_long_lists_are_told_and_dealt_anew():
    import pyarrow as pa

    fps = np.arange(simhash.LIST + 300, dtype=np.int64)
    t = pa.RecordBatch.from_arrays([pa.array(np.zeros(len(fps), np.int64)), pa.array(fps)], names=["list", "fp"])
    out = pa.Table.from_batches(simhash._lists(iter([t.slice(0, 900), t.slice(900)])))
    assert sorted(out.column("b").to_pylist()) == fps.tolist() and out.column("list").null_count == 0


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 150)] + [(7, 7)]
    found = components(spark.createDataFrame(edges, "a bigint, b bigint"), Scratch(spark, "t"))
    assert {(r.node, r.root) for r in found.collect()} == {(i, 0) for i in range(61)} | {(i, 100) for i in range(100, 150)}


def edited(rnd, words, n):
    out = list(words)
    for at in rnd.sample(range(len(out)), n):
        out[at] = f"new{rnd.randrange(10**6)}"
    return out


def test_similar_texts_meet_and_others_do_not(spark):
    rnd, rows = random.Random(8), []
    for i in range(60):
        base = [f"w{rnd.randrange(4000)}" for _ in range(300)]
        rows += [(i * 10, " ".join(base)), (i * 10 + 1, " ".join(edited(rnd, base, 4))), (i * 10 + 2, " ".join(edited(rnd, base, 60)))]
    rows += [(9001, "one two"), (9002, "ONE  two"), (9003, ""), (9004, None), (9005, "two one")]
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert sum(got[i * 10 + 1] == i * 10 for i in range(60)) >= 57  # similarity about 0.87
    assert all(got[i * 10 + 2] == i * 10 + 2 for i in range(60))  # about 0.2
    assert (got[9001], got[9002], got[9003], got[9004], got[9005]) == (9001, 9001, 9003, 9003, 9005)


def tails(rnd, n, other):
    """A text of n words and one whose last words are others: of n - 4 shingles, n - 4 - other are shared."""
    base = [f"w{rnd.randrange(4000)}" for _ in range(n)]
    return " ".join(base), " ".join(base[: n - other] + [f"v{rnd.randrange(4000)}" for _ in range(other)])


def test_no_link_below_the_similarity(spark):
    rnd, rows = random.Random(12), []
    for i in range(80):
        one, two = tails(rnd, 304, 34 + i % 8)  # similarity 0.796 to 0.760
        rows += [(i * 10, one), (i * 10 + 1, two)]
    got = simhash.similar_groups(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert len(got) == 160 and all(r.doc_id == r.component_id for r in got)


def test_every_pair_of_the_similarity_is_linked(spark):
    rnd, rows = random.Random(13), []
    for i in range(120):
        one, two = tails(rnd, 304, 33 - i % 3)  # similarity 0.802 to 0.818
        rows += [(i * 10, one), (i * 10 + 1, two)]
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert all(got[i * 10] == got[i * 10 + 1] == i * 10 for i in range(120))


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_similar_groups_equal_brute_force(spark, folder):
    frame = spark.read.parquet(f"/root/testdata/{folder}/documents.parquet")
    rows = sorted(frame.collect(), key=lambda r: r.doc_id)
    sets = [set(simhash.shingles((r.text or "").encode()).tolist()) for r in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) or not sets[i] and not sets[j]]
    name = union(len(rows), pairs)
    least = {}
    for r, n in zip(rows, name, strict=True):
        least.setdefault(n, r.doc_id)
    assert pairs and {r.doc_id: r.component_id for r in simhash.similar_groups(frame).collect()} == {r.doc_id: least[n] for r, n in zip(rows, name, strict=True)}


def test_band_keys_agree_as_often_as_the_similarity_says():
    rng, n = np.random.default_rng(14), 400
    agreed = np.zeros(simhash.BANDS)
    for _ in range(n):
        h = rng.integers(0, 2**63, 120, dtype=np.uint64)
        agreed += simhash.band_keys(h[:110]) == simhash.band_keys(np.append(h[:98], h[110:]))  # 98 of 120
    share, want = agreed / n, (98 / 120) ** simhash.ROWS
    assert abs(share.mean() - want) < 0.02 and np.abs(share - want).max() < 0.12


def test_alike_connects_what_pairs_connect():
    rng = np.random.default_rng(6)
    base = rng.integers(0, 2**63, (8, 60), dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[i % 8][rng.random(60) < 0.93], rng.integers(0, 2**63, 3, dtype=np.uint64)])) for i in range(120)]
    jaccard = lambda a, b: len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    want = [(i, j) for i in range(120) for j in range(i) if jaccard(sets[i], sets[j]) >= 0.8]
    found = simhash.alike(sets, 0.8).tolist()
    same = lambda r: {frozenset(i for i in range(len(r)) if r[i] == x) for x in set(r)}
    assert all(jaccard(sets[i], sets[j]) >= 0.8 for i, j in found) and same(union(120, found)) == same(union(120, want))


def test_alike_equals_all_pairs_of_any_similarity():
    rnd = np.random.default_rng(11)
    for _ in range(200):
        words, n = rnd.integers(0, 2**63, rnd.integers(2, 16), np.uint64), int(rnd.integers(1, 14))
        sets = [np.unique(rnd.choice(words, rnd.integers(1, len(words) + 1))) for _ in range(n)]
        similarity = float(rnd.choice([0.3, 0.5, 0.6, 0.75, 0.8, 1.0]))
        near = [(i, j) for i in range(n) for j in range(i) if len(np.intersect1d(sets[i], sets[j])) / len(np.union1d(sets[i], sets[j])) >= similarity]
        groups = []
        for links in (near, simhash.alike(sets, similarity).tolist()):
            name = list(range(n))
            for a, b in links:
                name = [min(name[a], name[b]) if x in (name[a], name[b]) else x for x in name]
            groups.append(name)
        assert groups[0] == groups[1]


def test_rounds_of_few_pairs_run_in_few_tasks(spark, monkeypatch):
    """However many shuffle partitions there are: each task that has rows writes a file."""
    from tapeloom.llm.common import LEAST_TASKS

    files, write = [], Scratch.write
    monkeypatch.setattr(Scratch, "write", lambda self, df, name: (out := write(self, df, name), files.append(len(out.inputFiles())))[0])
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "50")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        edges = spark.createDataFrame([(2 * i, 2 * i + 1) for i in range(300)] + [(0, 2 * i) for i in range(1, 100)], "a bigint, b bigint")
        found = {r.node: r.root for r in components(edges, Scratch(spark, "t")).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert found == {i: 0 if i < 200 else i - i % 2 for i in range(600)}
    assert files and max(files) <= LEAST_TASKS


@pytest.mark.parametrize("limit", [1024, 3])
def test_clusters_of_any_size(spark, limit, monkeypatch):
    """A chain: each text is similar to the next one only, so that a cluster's blocks must all meet."""
    monkeypatch.setattr(simhash, "BLOCK", limit)
    words = [f"w{random.Random(4).random()}-{i}" for i in range(700)]
    rows = [(i, " ".join(words[30 * i : 30 * i + 304])) for i in range(13)]  # 0.818 with the next, 0.667 with the one after
    got = simhash.similar_groups(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert [r.component_id for r in got] == [0] * 13


def test_near_dedup_keeps_one_of_each_group(spark, small, empty, edge):
    for folder in (small, edge, empty):
        frame = spark.read.parquet(f"{folder}/documents.parquet")
        kept = {r.doc_id for r in simhash.dedup(frame).collect()}
        assert kept == {r.component_id for r in simhash.similar_groups(frame).collect()}


def test_near_dedup_shuffles_no_text_at_its_end_and_few_copies_of_prints(spark, small):
    """What goes is broadcast, whatever size Spark takes for small; prints go to as many buckets as the rows need."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = simhash.dedup(spark.read.parquet(f"{small}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "hashpartitioning" not in plan
    assert [simhash._buckets(n, 51) for n in (0, 202_256, 10**7)] == [12, 13, 51]
    assert simhash._buckets(10**7, 3000) == 611


def test_op6_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = queries.op6_quality(spark, folder).collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r.predicted == label[r.doc_id] for r in rows if r.held_out and r.doc_id in label]
    assert sum(held) >= 0.97 * len(held)


def test_op6_odd_tables(spark, edge, empty, tmp_path):
    assert queries.op6_quality(spark, empty).collect() == []
    frame = spark.read.parquet(f"{edge}/documents.parquet")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1), (5, 7), (4, 0), (9, 1), (9, 1)], "doc_id bigint, quality int")
    rows = quality.classify(frame, labels).collect()
    assert len(rows) == frame.count() and all(0 <= r.score <= 1 for r in rows)
    none = quality.classify(frame, labels.where("false")).collect()
    assert {r.score for r in none} == {1.0}


def gaussian(x, mean, cov):
    d = x - mean
    return -0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d) - 0.5 * np.linalg.slogdet(cov)[1]


def plain_model(x, label, setting):
    """The discriminant by its definition, from the training rows themselves."""
    pooled_share, diagonal, temperature = setting
    own = {c: x[label == c] for c in (0, 1)}
    pooled = sum((v - v.mean(0)).T @ (v - v.mean(0)) for v in own.values()) / len(x)
    parts = {}
    for c, v in own.items():
        cov = (1 - pooled_share) * np.cov(v.T, bias=True) + pooled_share * pooled
        parts[c] = v.mean(0), (1 - diagonal) * cov + diagonal * np.diag(np.diag(cov)) + quality.FLOOR * np.eye(x.shape[1])
    odds = np.log(len(own[1]) / len(own[0]))
    return lambda z: (gaussian(z, *parts[1]) - gaussian(z, *parts[0]) + odds) / temperature


def plain_scores(spark, folder):
    """doc_id to score: a plain discriminant whose settings are chosen by plain cross-validation."""
    from pyspark.sql import functions as F

    docs = {r.doc_id: np.array(quality.statistics((r.text or "").encode())) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    labels = spark.read.parquet(f"{folder}/labels.parquet").withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(quality.FOLDS))).collect()
    rows = [(docs[r.doc_id], r.quality, r.part) for r in labels if r.quality in (0, 1) and r.doc_id in docs and zlib.crc32(str(r.doc_id).encode()) % 4 != 2]
    x, label, part = np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    loss = []
    for setting in quality.GRID:
        total = 0.0
        for own in set(part.tolist()):
            z = plain_model(x[part != own], label[part != own], setting)(x[part == own])
            total += np.logaddexp(0, np.where(label[part == own] == 1, -z, z)).sum()
        loss.append(total)
    model = plain_model(x, label, quality.GRID[int(np.argmin(loss))])
    return {doc: 1 / (1 + np.exp(-np.clip(model(v[None])[0], -500, 500))) for doc, v in docs.items()}


def test_op6_equals_a_plain_discriminant(spark):
    want = plain_scores(spark, "/root/testdata/sf0.01")
    got = {r.doc_id: (r.score, r.predicted) for r in queries.op6_quality(spark, "/root/testdata/sf0.01").collect()}
    assert set(got) == set(want)
    for doc, score in want.items():
        assert got[doc][0] == pytest.approx(score, abs=1e-6) and got[doc][1] == (got[doc][0] >= 0.7)


def test_labels_that_are_no_classes_are_not_used(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    known = spark.read.parquet(f"{small}/labels.parquet").selectExpr("doc_id", "cast(quality as double) as quality")
    odd = known.unionAll(docs.selectExpr("doc_id", "0.5D")).unionAll(docs.selectExpr("doc_id", "cast(null as double)"))
    assert {tuple(r) for r in quality.classify(docs, odd).collect()} == {tuple(r) for r in quality.classify(docs, known).collect()}


def test_repeated_rows_and_clashing_columns_get_equal_scores(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").selectExpr("*", "1 as x", "2 as score", "3 as part", "4 as label")
    labels = spark.read.parquet(f"{small}/labels.parquet")
    rows = quality.classify(docs.unionAll(docs.where("doc_id < 20")), labels).where("doc_id < 20").collect()
    assert len(rows) == 40 and len({(r.doc_id, r.score) for r in rows}) == 20
    kept = quality.keep(docs, labels)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()


def test_discriminant_is_the_gaussian_one():
    rng = np.random.default_rng(0)
    x = {0: rng.normal(0, 1, (4000, 3)) @ np.diag([1, 2, 0.5]), 1: rng.normal(1, 1, (4000, 3))}
    cross = {c: np.hstack([np.ones((len(v), 1)), v]).T @ np.hstack([np.ones((len(v), 1)), v]) for c, v in x.items()}
    model = quality.Discriminant.fit(cross, 0.0, 0.0)
    z = np.log(model.score(x[1][:5]) / (1 - model.score(x[1][:5]))) * quality.TEMPERATURE
    dense = lambda c: -0.5 * np.einsum("ij,jk,ik->i", x[1][:5] - x[c].mean(0), np.linalg.inv(np.cov(x[c].T, bias=True) + quality.FLOOR * np.eye(3)), x[1][:5] - x[c].mean(0)) - 0.5 * np.linalg.slogdet(np.cov(x[c].T, bias=True) + quality.FLOOR * np.eye(3))[1]
    assert np.allclose(z, dense(1) - dense(0), atol=1e-6)


def test_every_pair_that_shares_enough_positions_meets_in_a_team():
    assert sorted(p for team in simhash.TEAMS for p in team.tolist()) == list(range(simhash.POSITIONS))
    assert len(simhash.TEAMS) < simhash.SHARES  # so two of any SHARES positions are in one team


@pytest.mark.parametrize("run", [512, 4])
def test_position_lists_connect_what_qualifying_pairs_connect(run, monkeypatch):
    """All lists of all teams against all pairs: shared byte positions counted, then differing bits."""
    import pyarrow as pa

    monkeypatch.setattr(simhash, "RUN", run)
    monkeypatch.setattr(simhash, "PAIRS", 50)
    rng, prints = np.random.default_rng(run), []
    for _ in range(12):
        x = rng.integers(0, 2**63, 90, dtype=np.uint64)
        for i in range(10):
            prints.append(simhash.wide_fingerprint(np.append(x[: 90 - i * (2 + i % 3)], rng.integers(0, 2**63, i * (2 + i % 3), dtype=np.uint64))))
    raw = np.frombuffer(b"".join(prints), np.uint8).reshape(-1, simhash.POSITIONS)
    n = len(raw)
    want = [(i, j) for i in range(n) for j in range(i) if (raw[i] == raw[j]).sum() >= simhash.SHARES and np.bitwise_count(raw[i] ^ raw[j]).sum() <= simhash.ALL_BITS and np.bitwise_count(raw[i, :16] ^ raw[j, :16]).sum() <= simhash.TWO_BITS]
    rows = sorted((int(p) << 8 | int(raw[i, p]), i) for i in range(n) for team in simhash.TEAMS for p in team[:-1])
    t = pa.table({"list": pa.array([r[0] for r in rows], pa.int32()), "node": [r[1] for r in rows], "print": [prints[r[1]] for r in rows]})
    got = [(a, b) for x in simhash._position_links(t.to_batches(max_chunksize=37)) for a, b in zip(*(c.to_pylist() for c in x.columns), strict=True)]
    same = lambda r: {frozenset(i for i in range(len(r)) if r[i] == x) for x in set(r)}
    assert len(want) > 100 and same(union(n, got)) == same(union(n, want))


def test_the_near_dedup_goes_through_the_fingerprints(spark, monkeypatch):
    """Fingerprints that share no byte position are candidates of nothing, whatever the texts."""
    from pyspark.sql import functions as F

    rows = [(1, "a b c d e f g h i j k l"), (2, "a b c d e f g h i j k l m"), (3, "n o p q r s")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    linked = simhash._candidates
    assert [r.component_id for r in simhash.similar_groups(frame).orderBy("doc_id").collect()] == [1, 1, 3]
    monkeypatch.setattr(simhash, "_candidates", lambda d, s: linked(d.withColumn("prints", F.expr("CASE WHEN least = 1 THEN unhex(repeat('00', 96)) ELSE prints END")), s))
    assert [r.component_id for r in simhash.similar_groups(frame).orderBy("doc_id").collect()] == [1, 2, 3]


def test_fingerprints_of_similar_sets_qualify():
    """Sets of similarity 0.8 of all sizes, the worst (4 shingles of 5) among them; at most two of 10300 pairs are lost."""
    rng, lost = np.random.default_rng(5), 0
    for size in (4, 8, 12, 20, 60, 200):
        for _ in range(2000 if size < 200 else 300):
            h = rng.integers(0, 2**63, size * 5 // 4, dtype=np.uint64)
            fps = np.frombuffer(simhash.wide_fingerprint(h[:size]) + simhash.wide_fingerprint(h), np.uint64).reshape(2, -1)
            lost += not simhash._wide_near(fps, np.array([0]), np.array([1]))[0]
    assert lost <= 2


def test_packed_postings_are_those_of_all_lists_and_hold_a_print_once():
    rng = np.random.default_rng(4)
    prints, nodes = rng.integers(0, 256, (700, simhash.POSITIONS), np.uint8), rng.integers(0, 2**62, 700)
    for team in simhash.TEAMS:
        packed = list(simhash._packed(prints, nodes, team, 5))
        got = sorted((r["list"], r["node"], r["print"]) for x in simhash._unpacked((r[1:] for r in packed), 1000) for r in x.to_pylist())
        assert got == sorted((int(p) << 8 | int(prints[i, p]), int(nodes[i]), prints[i].tobytes()) for i in range(700) for p in team[:-1])
        assert sum(len(x) for r in packed for x in r[1:]) < 700 * (5 * 104 + 6 * len(team))
        lists = [set(np.frombuffer(r[1], np.int32).tolist()) for r in packed]
        assert sum(map(len, lists)) == len(set().union(*lists))
