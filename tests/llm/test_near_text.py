"""The near-duplicate stage of the pipeline against all pairs of shingle sets."""

from __future__ import annotations

import os
import random
import time

import numpy as np

import corpus_pipeline
from quarry.llm import near_text
from quarry.storage import discard, materialize
from tests.llm.docs import mixed_rows, table


def plain(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def components(rows):
    """The smallest id reachable from each id."""
    of = [(k, plain(t)) for k, t in rows if k is not None]
    label = {k: k for k, _ in of}
    for i, (a, x) in enumerate(of):
        for b, y in of[:i]:
            if 5 * len(x & y) >= 4 * len(x | y) and label[a] != label[b]:
                low, high = sorted((label[a], label[b]))
                label = {k: low if v == high else v for k, v in label.items()}
    return label


def test_near_copies_are_all_found(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(3000)]
    rows, k = [(r[0], r[1]) for r in mixed_rows()], 1000
    rows = [r for r in rows if r[0] != 7]
    passage = " ".join(rng.choice(words) for _ in range(40))
    for _ in range(12):
        base = [rng.choice(words) for _ in range(300)]
        for n in range(9):  # n edited words
            text = base[:]
            for at in rng.sample(range(300), n):
                text[at] = rng.choice(words)
            rows.append((k, " ".join(text) + " " + passage))
            k += 1
    rng.shuffle(rows)
    label = components(rows)
    got = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, table(spark, rows), "").select("doc_id").collect()}
    assert got == {k for k in label if label[k] == k} | {None}


def test_parities_tell_large_sets_apart():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(-(2**63), 2**63 - 1, n)) for n in (5, 70, 9000, 11000)]
    sets.append(np.unique(np.concatenate([sets[2][: len(sets[2]) // 2], sets[3][:4000]])))
    sets += [np.sort(s[: len(s) - len(s) // 12]) for s in sets]
    refused = 0
    for x in sets:
        for y in sets:
            may = near_text.may_be_near(len(x), len(y), near_text.parity(x), near_text.parity(y))
            is_near = near_text.near(len(x), len(y), x.tobytes(), y.tobytes())
            assert may or not is_near
            refused += not may
            if min(len(x), len(y)) > 2000:
                assert may == is_near
    assert refused
    assert near_text.differing(near_text.parity(sets[3]), near_text.parity(sets[3])) == 0


def test_texts_are_dealt_out_only_where_ids_may_match(spark, monkeypatch):
    """Copies, candidates and what goes are few here, so the stage shuffles less than the texts hold, without any join broadcast for its size."""
    rng = random.Random(5)
    rows = [(k, " ".join(f"{rng.getrandbits(48):x}" for _ in range(4000))) for k in range(120)]
    rows += [(200, rows[3][1]), (201, rows[5][1] + " end"), (202, "a text of its own"), (None, rows[7][1])]
    path = materialize(table(spark, rows), "test")
    store = spark.sparkContext._jsc.sc().statusStore()

    def written():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        stages = store.stageList(None, *(getattr(store, f"stageList$default${i}")() for i in range(2, 6)))
        return {(x.stageId(), x.attemptId()): x.shuffleWriteBytes() for x in (stages.apply(i) for i in range(stages.size()))}

    before = written()
    monkeypatch.setattr(near_text, "SAMPLE", 1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for classes in (near_text.CLASSES, 64):  # where the filter is full, the joins behind it still decide
            monkeypatch.setattr(near_text, "CLASSES", classes)
            got = sorted((r["doc_id"] is not None, r["doc_id"]) for r in near_text.keep_first(path).select("doc_id", "text").collect())
            assert got == [(False, None), *((True, k) for k in [*range(120), 202])]
            if classes > 64:
                shuffled = sum(v for k, v in written().items() if k not in before)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert shuffled < sum(len(t) for _, t in rows), shuffled
    discard(path)


def test_tables_leave_no_shuffle_files(spark):
    top = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()

    def files():
        return {f for d in top for _, _, names in os.walk(d) for f in names if f.startswith("shuffle_")}

    before = files()
    out = materialize(spark.range(1000).selectExpr("id % 7 AS k").groupBy("k").count().repartition(3, "k"), "test")
    for _ in range(50):
        if files() <= before:
            break
        time.sleep(0.1)
    assert files() <= before
    assert out.count() == 7
    discard(out)
