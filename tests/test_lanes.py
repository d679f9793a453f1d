import random

import pytest
from pyspark.sql import functions as F

from tapeloom.functions import hashes as H
from tapeloom.operators import lanes, measure


def test_merge_totals_and_overlap(spark):
    rnd = random.Random(1)
    ends = sorted(rnd.sample(range(10_000), 60))
    rows = [(e, i, 1) for i, e in enumerate(ends)]
    frame = lambda r: spark.createDataFrame(r, "`end` bigint, first_seq bigint, count int")
    out = lanes.merged(frame(rows[::2]), frame(rows[1::2]), 100).orderBy("position").collect()
    assert [r.first_seq for r in out] == list(range(60)) and [r.lane for r in out] == [0, 1] * 30
    batches = [(b, rnd.randrange(5), rnd.randrange(50)) for b in range(40)]
    got = lanes.totals_before(spark.createDataFrame(batches, "batch bigint, spans bigint, messages bigint"), 7).orderBy("batch").collect()
    assert [(r.spans_before, r.messages_before) for r in got] == [(sum(x[1] for x in batches[:k]), sum(x[2] for x in batches[:k])) for k in range(40)]
    spans = sum(x[1] for x in batches)
    assert lanes.overlap(spark.createDataFrame(batches, "batch bigint, spans bigint, messages bigint"), 3, spans + 9).first().spans == spans - 3


def test_prefixes(spark):
    rows = spark.createDataFrame([([True, True, False, True],), ([True],), ([],), ([False],)], "valid array<boolean>")
    assert [r[0] for r in rows.select(lanes.valid_prefix()).collect()] == [2, 1, 0, 0]
    assert lanes.first_messages(spark.range(9).withColumnRenamed("id", "msg_index"), 4).count() == 4


@pytest.mark.parametrize("n", [0, 5, 63, 64, 1000, 100_000])
def test_crc_of_a_part(n):
    rnd = random.Random(n)
    head, part = rnd.randbytes(77), rnd.randbytes(min(n, 3000)) + bytes(max(0, n - 3000))
    before = H.crc_update(0, head)
    assert H.crc_between(before, H.crc_update(before, part), n) == H.crc_update(0, part)


def test_gates(spark):
    row = spark.range(1).select(measure.gate(F.lit(5), least=5).alias("a"), measure.gate(F.lit(5), most=5).alias("b"), measure.gate(F.lit(4), 1, 9).alias("c")).first()
    assert tuple(row) == ("PASS", "FAIL", "PASS")
