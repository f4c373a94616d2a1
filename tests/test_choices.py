"""Choices that are made one after the other, and itemsets level by level, against plain loops."""

import random
from collections import defaultdict

from changelens.operators import rules, sampling, structure


def robin_loop(lists, quota):
    taken, order = set(), []
    queues, left, progress = {t: iter(k) for t, k in sorted(lists.items())}, dict(quota), True
    while progress:
        progress = False
        for t, queue in queues.items():
            pick = next((k for k in queue if k not in taken), None) if left[t] > 0 else None
            if pick is not None:
                taken.add(pick)
                order.append((len(order), t, pick))
                left[t], progress = left[t] - 1, True
    return order


def test_round_robin_is_the_sequential_choice(spark):
    for seed, done in ((0, None), (1, [("t1", 2), ("t2", 9)])):
        r = random.Random(seed)
        df = spark.createDataFrame([(f"c{r.randrange(25)}", f"t{i % 6}") for i in range(80)], "case_id string, type string")
        existing = None if done is None else spark.createDataFrame(done, "type string, n long")
        lists, quota = defaultdict(list), {}
        for x in sampling.schedule_heads(df, 4, None, existing).orderBy("type", "pos").collect():
            lists[x["type"]].append(x.case_id)
            quota[x["type"]] = x.quota
        got = sampling.round_robin(df, 4, None, existing).orderBy("round_robin_index").collect()
        assert [tuple(x) for x in got] == robin_loop(lists, quota)
    assert sampling.round_robin(df.limit(0), 4).count() == 0


def slow_match(left, right, threshold):
    used, out = set(), []
    for i, a in enumerate(left):
        best, at = 0.0, -1
        for j, b in enumerate(right):
            s = 0.0 if j in used else structure.similarity(a, b)
            if s > best:
                best, at = s, j
        if at >= 0 and best >= threshold:
            used.add(at)
            out.append((i, at, best))
    return out


def test_greedy_match_is_the_plain_loop():
    for seed in range(300):
        r = random.Random(seed)
        base = ["".join(r.choice("abcé🙂") for _ in range(r.randint(0, 9))) for _ in range(5)]
        texts = lambda: ["".join(c for c in r.choice(base) if r.random() < 0.9) for _ in range(r.randint(0, 9))]
        left, right = texts(), texts()
        assert structure.greedy_match(left, right, 0.6) == slow_match(left, right, 0.6)


def test_one_name_in_thousands_of_files():
    left = [f"def f(self):\n    return {i % 1700} + self.x{i % 7}\n" for i in range(3000)]
    right = [x.replace("return", "yield") if i % 5 == 0 else x for i, x in enumerate(reversed(left))]
    assert len(structure.greedy_match(left, right, 0.8)) > 2900


def test_itemsets_level_by_level(spark):
    r = random.Random(1)
    book = [f"L{i:02d}" for i in range(12)]
    counts = defaultdict(int)
    for _ in range(40):
        counts[tuple(sorted(r.sample(book, r.randint(0, 7))))] += r.randint(1, 3)
    sets = spark.createDataFrame([(list(k), n) for k, n in counts.items()], "labels array<string>, n long")
    for least in (1, 4):
        got = rules.frequent_itemsets(sets, least)
        for size in (1, 2, 3):
            want = {tuple(x["items"]): x.n for x in rules.itemset_counts(sets, size).collect() if x.n >= least}
            assert {tuple(x["items"]): x.n for x in got[size].collect() if x.n >= least} == want


def test_sets_of_many_labels(spark):
    wide = [[f"L{i:03d}" for i in range(0, 200, step)] for step in (1, 2)]
    sets = spark.createDataFrame([(wide[0], 1), (wide[1], 1), (["L001", "L003"], 2)], "labels array<string>, n long")
    assert rules.association_rules(sets, 3).count() == 2
    assert rules.association_rules(sets, 2).count() == 100 * 99 + 3 * (100 * 99 * 98 // 6) + 2
