import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tapeloom.llm import katz, queries
from tapeloom.llm.common import Scratch, crc_fold

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    return [*WORD.findall("".join(c.lower() if c.isascii() else c for c in text or "")), None]


class Plain:
    """The model in dictionaries."""

    def __init__(self, texts, order):
        self.order, self.count = order, [Counter() for _ in range(order + 1)]
        for t in texts:
            own = tokens(t)
            for k in range(1, order + 1):
                self.count[k].update(tuple(own[i : i + k]) for i in range(len(own) - k + 1))
        self.d = [None] + [katz.discounts(np.array([0, *(sum(v == r for v in self.count[k].values()) for r in range(1, katz.CUT + 2))])) for k in range(1, order + 1)]
        self.n, self.vocabulary = sum(self.count[1].values()), {g[0] for g in self.count[1]}
        self.after = defaultdict(list)
        for k in range(2, order + 1):
            for g in self.count[k]:
                self.after[g[:-1]].append(g[-1])
        self.left = 1 - sum(self.d[1][min(v, 6)] * v / self.n for v in self.count[1].values()) if self.n else 1.0
        self.cache = {}

    def p(self, w, context):
        if not context:
            c = self.count[1][(w,)]
            return self.d[1][min(c, 6)] * c / self.n if c else self.left
        k, low = len(context) + 1, self.p(w, context[1:])
        if context not in self.after:
            return low
        if context not in self.cache:
            seen = self.after[context]
            total = sum(self.count[k][(*context, x)] for x in seen)
            own = {x: self.d[k][min(self.count[k][(*context, x)], 6)] * self.count[k][(*context, x)] / total for x in seen}
            left = 1 - sum(own.values())
            if left < 1e-15:
                own, left = {x: v * total / (total + 1) for x, v in own.items()}, 1 / (total + 1)
            unseen = 1 - sum(self.p(x, context[1:]) for x in seen)
            if unseen <= 1e-12:
                own, left, unseen = {x: v / (1 - left) for x, v in own.items()}, 0.0, 1.0
            self.cache[context] = own, left / unseen
        own, weight = self.cache[context]
        return own[w] if w in own else weight * low

    def score(self, text):
        own = tokens(text)
        return sum(math.log10(self.p(w, tuple(own[max(0, i - self.order + 1) : i]))) for i, w in enumerate(own))


def test_the_order_three_query_uses_two_words_before(spark, small):
    frame = spark.read.parquet(f"{small}/documents.parquet")
    out = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    rows = frame.collect()
    model = Plain([r.text for r in rows if not out(r.doc_id)], 3)
    got = {r.doc_id: r.score for r in queries.op1_katz_order3(spark, small).collect()}
    assert set(got) == {r.doc_id for r in rows} and all(got[r.doc_id] == pytest.approx(model.score(r.text), rel=1e-9) for r in rows)


@pytest.mark.parametrize(("which", "order"), [("edge", 2), ("small", 2), ("small", 3), ("empty", 2), ("edge", 1)])
def test_scores(spark, request, which, order, monkeypatch):
    folder = request.getfixturevalue(which)
    frame = spark.read.parquet(f"{folder}/documents.parquet")
    rows = frame.collect()
    out = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 1
    model = Plain([r.text for r in rows if not out(r.doc_id)], order)
    got = queries.op1_katz(spark, folder) if order == 2 else katz.Katz(Scratch(spark, "t"), order).fit_and_score(frame, crc_fold("doc_id", 5) == 1)
    key = lambda r: (r[0] is not None, r[0] or 0, r[2], round(r[5], 3))
    want = []
    for r in rows:
        own = tokens(r.text)
        counts = [model.count[1][(w,)] for w in own]
        base = sum(math.log10((c + 0.5) / (model.n + 0.5 * (len(model.vocabulary) + 1))) for c in counts)
        want.append((r.doc_id, out(r.doc_id), len(own), sum(c > 0 for c in counts), model.n, base, model.score(r.text)))
    got = sorted(map(tuple, got.collect()), key=key)
    want.sort(key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want, strict=True):
        assert g[5] == pytest.approx(w[5], rel=1e-9) and g[6] == pytest.approx(w[6], rel=1e-7)


def test_plain_model_is_normalised(spark, small):
    texts = [r.text for r in spark.read.parquet(f"{small}/documents.parquet").limit(40).collect()]
    model = Plain(texts, 3)
    for context in [(), *list(model.after)[:30]]:
        assert sum(model.p(w, context) for w in model.vocabulary) + model.p("\0unknown", context) == pytest.approx(1, abs=1e-9)


def test_held_out_scores_beat_the_base(spark):
    rows = queries.op1_katz(spark, "/root/testdata/sf0.01").where("held_out").selectExpr("sum(score)", "sum(base_score)").first()
    assert rows[0] > rows[1]


def test_packing():
    for a in (np.zeros(0, np.int64), np.arange(1000), np.array([2**40, 1])):
        assert np.array_equal(katz.unpack_counts(katz.pack_counts(a)), a)
    h = np.random.default_rng(0).integers(0, 2**63, 77, dtype=np.uint64)
    assert np.array_equal(katz.unpack(katz.pack(h), "<u8"), h)


def test_steps_round_trip():
    runs, numbers = np.array([2, 0, 3, 1]), np.array([4, 9, 1, 2, 50, 7])
    assert katz.values(runs, katz.steps(runs, numbers)).tolist() == numbers.tolist()
    assert katz.values(np.zeros(0, np.int64), np.zeros(0, np.int64)).tolist() == []


@pytest.mark.parametrize(("order", "hot"), [(2, 3), (3, 3), (4, 20), (4, katz.HOT)])
def test_words_dealt_to_several_shards(spark, small, order, hot):
    frame = spark.read.parquet(f"{small}/documents.parquet").repartition(12)
    rows = frame.collect()
    out = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    model = Plain([r.text for r in rows if not out(r.doc_id)], order)
    got = {r.doc_id: r.score for r in katz.Katz(Scratch(spark, "t"), order, hot).fit_and_score(frame, crc_fold("doc_id", 5) == 1).collect()}
    assert set(got) == {r.doc_id for r in rows} and all(got[r.doc_id] == pytest.approx(model.score(r.text), rel=1e-9) for r in rows)


def test_a_block_sends_few_bytes_for_a_token():
    """At order 3 a block once sent 11 bytes a token in its last ask alone: hashes of contexts and estimates of the order below."""
    rng = np.random.default_rng(1)
    words = pa.array([f"w{i}" for i in np.minimum(rng.zipf(1.2, 200_000), 50_000)])
    row = katz._block(1, 300, list(range(400)), np.full(400, 500), words).to_pylist()[0]
    counts = katz.unpack_counts(row["counts"])[np.argsort(katz.unpack(row["words"], "<u8"))]
    own = katz.Block(row, [{"a": katz.pack_counts(counts), "b": katz.pack_counts(np.argsort(np.argsort(-counts, kind="stable")) + 1)}])
    assert sum(len(x) for r in own.ask(3, 4, katz.HOT, 0, 4) for x in r if isinstance(x, bytes)) < 6 * 200_400


def test_texts_without_words(spark):
    frame = spark.createDataFrame([(1, ""), (2, None), (3, " \t")], "doc_id bigint, text string")
    got = katz.Katz(Scratch(spark, "t"), 3).fit_and_score(frame, crc_fold("doc_id", 5) == 1).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in got) == [(1, 1), (2, 1), (3, 1)] and all(math.isfinite(r.score) for r in got)
