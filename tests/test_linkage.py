import random
import time

import pytest

from vellum.operators import linkage, resolution


def corpus(seed, n):
    """Sets of all sizes, near copies around the threshold, copies in another order, many sets of one size, and no tokens."""
    r = random.Random(seed)
    words = [f"w{i}" for i in range(90)]
    titles = [r.sample(words[: r.choice([8, 30, 90])], k=r.randint(1, 8)) for _ in range(n)]
    for _ in range(n):
        base = list(r.choice(titles))
        for _ in range(r.randint(0, 3)):
            base[r.randrange(len(base))] = r.choice(words)
        titles.append(base + r.sample(words, k=r.randint(0, 3)))
    titles += [r.sample(words[:14], k=10) for _ in range(n)] + [r.sample(t, len(t)) for t in titles[:20]]
    return [(i, " ".join(t)) for i, t in enumerate(titles)] + [(9000, ""), (9001, "--"), (9002, None), (None, "w1 w2 w3")]


def brute(rows):
    first = {}
    for i, t in sorted(x for x in rows if x[0] is not None and x[1]):
        w = frozenset(t.split()) - {"--"}
        if w:
            first.setdefault(w, i)
    sets = sorted((i, w) for w, i in first.items())
    return {(a, b) for k, (a, x) in enumerate(sets) for b, y in sets[k + 1 :] if len(x & y) >= 0.7 * (len(x) + len(y) - len(x & y)) - 1e-9}


@pytest.mark.parametrize("ranked, block", [(1 << 18, None), (1 << 18, 700), (20, 150), (0, 60)])
def test_linked_titles_against_brute_force_whatever_the_blocks(spark, monkeypatch, ranked, block):
    monkeypatch.setattr(linkage, "RANKED", ranked)
    rows = corpus(block or 1, 150)
    got = [tuple(x) for x in linkage.linked_sets(spark.createDataFrame(rows, "id long, title string"), block=block).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows) and len(got) > 100
    assert linkage.linked_sets(spark.createDataFrame([], "id long, title string"), block=block).collect() == []


def test_blocks_hold_every_size_in_order():
    places, blocks = linkage.plan_blocks([(1, 5), (2, 3), (3, 10), (4, 1), (9, 1), (40, 1)], 12)
    assert places == [(1, 0, 1), (2, 0, 1), (3, 1, 3), (4, 4, 1), (9, 5, 1), (40, 6, 1)]
    assert blocks == [(1, 2), (3, 3), (3, 3), (3, 3), (4, 4), (9, 9), (40, 40)]


def written(spark):
    """Bytes written to shuffles so far."""
    time.sleep(0.5)
    spark.range(1).count()
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty(30_000)
    return sc.statusStore().executorSummary("driver").totalShuffleWrite()


def test_linked_titles_shuffles_no_token_sets_per_candidate(spark):
    """Many sets that share rare tokens and do not match: what is shuffled follows the text, not the candidates."""
    r = random.Random(3)
    words = [f"word{i}" for i in range(400)]
    rows = [(i, " ".join(r.sample(words, 60))) for i in range(1500)]
    df = spark.createDataFrame(rows, "id long, title string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = written(spark)
        assert resolution.linked_titles(df).count() == 0
        assert written(spark) - before < 4 * sum(len(t) for _, t in rows)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
