import base64
import re
from collections import Counter, defaultdict

import public_tokenizers as P
import pytest
import tiktoken
from test_quality_and_simhash import plain_scores, union

import corpus_pipeline

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    own = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(own[i : i + 5]) for i in range(max(1, len(own) - 4))} if own else set()


def plain(spark, folder):
    """Rows that the filtering stages keep: a plain discriminant, equal texts, and pairs whose sets of shingles have the Jaccard similarity 0.8."""
    score = plain_scores(spark, folder)
    rows = [r for r in spark.read.parquet(f"{folder}/documents.parquet").collect() if score[r.doc_id] >= 0.7]
    first = {}
    for r in sorted(rows, key=lambda r: r.doc_id):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r.text or ""), r)
    rows = sorted(first.values(), key=lambda r: r.doc_id)
    sets = [shingles(r.text) for r in rows]
    near = [(i, j) for i in range(len(rows)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    least, out = set(), []
    for r, name in zip(rows, union(len(rows), near), strict=True):
        if name not in least:
            least.add(name)
            out.append(r)
    return out


def targets(sizes):
    """Words to take by source: shares of weights 5, 2, 1, none above twice its source's words."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[n % 3] for n, s in enumerate(names)}
    out, left = {}, 1.5 * sum(sizes.values())
    while len(out) < len(names):
        rest = [s for s in names if s not in out]
        share = {s: left * weight[s] / sum(weight[r] for r in rest) for s in rest}
        over = [s for s in rest if share[s] > 2 * sizes[s]]
        for s in over or rest:
            out[s] = min(share[s], 2 * sizes[s])
        left -= sum(out[s] for s in over)
    return out


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "empty"])
def test_pipeline(spark, folder, request):
    folder = request.getfixturevalue(folder) if folder == "empty" else folder
    out = corpus_pipeline.run(spark, folder).collect()
    if folder != "/root/testdata/sf0.001":
        assert out == []
        return
    kept = {r.doc_id: r for r in plain(spark, folder)}
    size = {i: len(WORD.findall(r.text or "")) for i, r in kept.items()}
    sizes, got, most = Counter(), Counter(), defaultdict(int)
    for i, r in kept.items():
        sizes[r.source] += size[i]
        most[r.source] = max(most[r.source], size[i])
    times = Counter(r.doc_id for r in out)
    assert set(times) <= set(kept) and max(times.values()) <= 2
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    encoding = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in out:
        assert r.ids == encoding.encode_ordinary(kept[r.doc_id].text) and r.n_tokens == len(r.ids) and r.round_trip
        got[r.source] += size[r.doc_id]
    want = targets(sizes)
    assert all(abs(got[s] - want[s]) <= most[s] for s in want)
    # A source that is taken at least once as a whole loses no document that has words.
    assert all(times[i] for i, r in kept.items() if size[i] and want[r.source] >= sizes[r.source] + most[r.source])


def test_stages_take_odd_tables(spark, edge, tmp_path):
    docs = spark.read.parquet(f"{edge}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (9, 0, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{n}")
        docs = spark.read.parquet(f"{tmp_path}/{n}")
        if n < 4:
            assert docs.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
