"""What the operators left out before: one test for each gap."""

import random
from fractions import Fraction
from itertools import islice

import numpy as np

from wayfare.llm import decontam, lines, mixing, secrets, sharding
from wayfare.llm._tables import written

SCHEMA = "doc_id long, text string, source string"


def test_slots_follow_the_mix(spark):
    docs = spark.createDataFrame([(i, f"text {i} " + "x" * (i % 7), "ab"[i % 2]) for i in range(400)], SCHEMA)
    slots = []
    for weights in ({"a": 3, "b": 1}, {"a": 1, "b": 3}):
        place = {r.doc_id: r.position for r in mixing.mix_sources(docs, weights, block=2).collect()}
        mixed = written(mixing.in_mixed_order(docs, weights, block=2), "test-mixed")
        got = sharding.shard_documents(mixed, shards=3, in_order=True).collect()
        for s in range(3):
            mine = sorted((r.slot, place[r.doc_id]) for r in got if r.shard == s)
            assert [x for x, _ in mine] == list(range(len(mine))) and mine == sorted(mine, key=lambda x: x[1])
        slots.append({r.doc_id: (r.shard, r.slot) for r in got})
    assert slots[0] != slots[1] and {k: v[0] for k, v in slots[0].items()} == {k: v[0] for k, v in slots[1].items()}


def test_mix_keeps_the_exact_weights():
    for weights in ([1, 1, 1], [5, 3, 1.3, 0.7, 0.37], [0.99983, 0.00017]):
        total = sum(map(Fraction, weights))
        given = [0] * len(weights)
        # blocks enough for every source to last
        blocks = [int(Fraction(w) / total * 50_000) + 10 for w in weights]
        for t, (s, _, _, release, deadline) in enumerate(islice(mixing.edf(blocks, mixing.whole(weights)), 50_000), 1):
            given[s] += 1
            assert release < t <= deadline
            assert t % 500 or all(abs(g - Fraction(w) / total * t) < 1 for g, w in zip(given, weights, strict=True))


def test_plan_goes_on_after_a_source_ends():
    rows = {"a": 31, "b": 200, "c": 7, "d": 0, "e": 5, "f": 9}
    got = list(mixing.plan_blocks(rows, {"a": 1.7, "b": 0.3, "c": 1, "e": 0}, 2))
    assert [x[5] for x in got] == list(range(len(got))) and all(x[3] <= x[5] < x[4] for x in got)
    assert {s: sum(x[0] == s for x in got) for s in rows} == {s: -(-n // 2) for s, n in rows.items()}
    assert all(x[0] in "ef" for x in got[-8:]) and got[-1][6] < sum(rows.values())


def test_mix_of_many_sources(spark):
    docs = spark.createDataFrame([(i, "", f"host{i % 700}") for i in range(2000)], SCHEMA)
    got = mixing.mix_sources(docs, block=2).collect()
    assert sorted(r.position for r in got) == list(range(2000)) and all(r.release <= r.slot < r.deadline for r in got)


def test_best_stretch_has_the_most_matches():
    rng = random.Random(5)
    for n in range(1, 70):
        for wrong in (0.05, 0.15, 0.3, 0.6):
            same = np.array([rng.random() >= wrong for _ in range(n)])
            start, end, matches = decontam.best_stretch(same)
            sums = [int(same[a:b].sum()) for a in range(n) for b in range(a + 1, n + 1) if 5 * same[a:b].sum() >= 4 * (b - a)]
            assert matches == same[start:end].sum() == max(sums, default=0) and 5 * matches >= 4 * (end - start)
            assert not matches or same[start] and same[end - 1]


def test_spread_substitutions_are_contamination(spark):
    cases = {1: (20, (12, 16)), 2: (30, (8, 13, 18, 23, 27)), 3: (100, range(4, 100, 5))}
    docs = [(i, "before " + " ".join("zz" if k in gone else f"w{i}x{k}" for k in range(n)) + " after", "a") for i, (n, gone) in cases.items()]
    bench = spark.createDataFrame([(i, " ".join(f"w{i}x{k}" for k in range(n))) for i, (n, _) in cases.items()], "item_id long, text string")
    got = decontam.find_contamination(spark.createDataFrame(docs, SCHEMA), bench).collect()
    assert sorted((r.doc_id, r.item_id, r.n_matched) for r in got) == [(1, 1, 18), (2, 2, 25), (3, 3, 80)]


def test_failed_candidates_count_as_tested(spark):
    # its log e-value is between ln(1 / 0.01) and ln(3001 / 0.01)
    secret = "b8De3XkjM8gaf0WaWAiinynV"
    run = lambda more: spark.createDataFrame([(1, secret, "a"), (2, " ".join("q" * (24 + k % 7) for k in range(more)), "a")], SCHEMA)
    found = [{r.doc_id: r.n_random for r in secrets.find_secrets(run(more)).collect()} for more in (0, 3000)]
    assert found == [{1: 1, 2: 0}, {1: 0, 2: 0}]


def test_a_leaf_holds_several_templates(spark):
    lead = "all rights reserved "
    notice = [lead + " ".join(f"{c}{w}" for w in "abcdefghi") for c in "pqr"]
    docs = [(100 * k + i, n, "a") for k, n in enumerate(notice) for i in range(12)]
    # a notice in a third of its leaf, among lines of their own; one with a name in it; one too rare
    word = lambda i: "".join("ghijklmnop"[int(c)] for c in str(i))
    docs += [(1000 + i, "see the terms at our main site", "a") for i in range(12)]
    docs += [(2000 + i, "see the terms " + " ".join(f"{word(i)}{c}" for c in "abcd"), "a") for i in range(24)]
    docs += [(3000 + i, f"{lead}by {word(i)} and partners in this land of ours", "a") for i in range(12)]
    docs += [(4000 + i, lead + "but only in nine documents and no more", "a") for i in range(9)]
    got = {r.doc_id: r.n_dropped for r in lines.drop_templates(spark.createDataFrame(docs, SCHEMA)).collect()}
    assert len(got) == len(docs)
    assert {i for i, n in got.items() if n} == {i for i in got if i < 2000 or 3000 <= i < 4000} and max(got.values()) == 1

