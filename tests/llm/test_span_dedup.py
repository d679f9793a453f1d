import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tapeloom.llm import queries, span_dedup

SPAN = 50


def brute(rows):
    first, out = {}, Counter()
    for key, text in rows:
        k = span_dedup.NONE if key is None else key
        for i in range(len(text) - SPAN + 1):
            s = text[i : i + SPAN]
            first[s] = min(first.get(s, k), k)
    for key, text in rows:
        k = span_dedup.NONE if key is None else key
        gone = bytearray(len(text))
        for i in range(len(text) - SPAN + 1):
            if first[text[i : i + SPAN]] < k:
                gone[i : i + SPAN] = b"\1" * SPAN
        spans = sum(gone[i] and not (i and gone[i - 1]) for i in range(len(text)))
        kept = bytes(c for c, g in zip(text, gone, strict=True) if not g)
        out[key, len(text), sum(gone), spans, hashlib.sha256(kept).hexdigest()] += 1
    return out


@pytest.mark.parametrize("which", ["edge", "small", "empty"])
def test_op9(spark, request, which):
    folder = request.getfixturevalue(which)
    rows = [(r.doc_id, (r.text or "").encode()) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    assert Counter(map(tuple, queries.op9_span_dedup(spark, folder).collect())) == brute(rows)


def test_planted_passages(spark, tmp_path):
    rnd = random.Random(9)
    noise = lambda n: "".join(rnd.choice("abcdefgh é日") for _ in range(n))
    passages = [noise(n) for n in (49, 50, 51, 80, 400)] + ["ab" * 200, "x" * 500]
    rows = []
    for i in range(120):
        parts = [noise(rnd.randrange(0, 60)) for _ in range(4)]
        parts.insert(rnd.randrange(4), rnd.choice(passages))
        parts.insert(rnd.randrange(4), rnd.choice(passages)[rnd.randrange(5) :])
        rows.append((rnd.randrange(100), "".join(parts)))
    spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    assert Counter(map(tuple, queries.op9_span_dedup(spark, str(tmp_path)).collect())) == brute([(k, t.encode()) for k, t in rows])


@pytest.mark.parametrize(("base", "queue"), [(1 << 20, 1 << 20), (50, 1000)])
def test_least_keys_beyond_memory(tmp_path, base, queue):
    rnd = random.Random(1)
    part = bytes(rnd.randrange(97, 110) for _ in range(300))
    texts = list({part[a : a + rnd.randrange(50, 120)] for a in (rnd.randrange(200) for _ in range(60))})
    texts = [t for t in texts if len(t) >= SPAN]
    keys = np.array([rnd.randrange(1000) for _ in texts])
    least, starts = span_dedup.least_keys(texts, keys, str(tmp_path), base, queue)
    first = {}
    for t, k in zip(texts, keys.tolist(), strict=True):
        for i in range(len(t) - SPAN + 1):
            first[t[i : i + SPAN]] = min(k, first.get(t[i : i + SPAN], k))
    for t, s in zip(texts, starts.tolist(), strict=True):
        assert [int(x) for x in least[s : s + len(t) - SPAN + 1]] == [first[t[i : i + SPAN]] for i in range(len(t) - SPAN + 1)]


def test_an_ordinary_shard_spills_its_queues(tmp_path, monkeypatch):
    """A full shard under the query's own limits, as in _answer_pieces."""
    from tapeloom.llm import induced

    spilled, old = [], induced.SpillQueue._spill
    monkeypatch.setattr(induced.SpillQueue, "_spill", lambda self: spilled.append(1) or old(self))
    rng = np.random.default_rng(5)
    flat = rng.integers(97, 122, span_dedup.SHARD, dtype=np.uint8).tobytes()
    texts = [flat[a : a + 305] for a in range(0, len(flat) - 305, 305)]
    texts += [t[7:200] for t in texts[:500]]
    keys = np.arange(len(texts))
    least, starts = span_dedup.least_keys(texts, keys, str(tmp_path))
    assert len(spilled) > 3
    whole = len(texts) - 500
    for n in range(whole, len(texts), 25):
        own = least[starts[n] : starts[n] + len(texts[n]) - SPAN + 1]
        assert (own == n - whole).all()
