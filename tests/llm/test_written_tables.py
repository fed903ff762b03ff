"""Every written table costs each task that fills it a file, and the executor the processes that set its modes: none is written to be read only once."""

import random

import pytest

from wayfare.llm import _graph, jaccard

WORDS = [f"w{i}" for i in range(400)]


@pytest.fixture
def tables(monkeypatch):
    names = []
    for module in (_graph, jaccard):

        def keep(df, name, *rest, write=module.written):
            names.append(name)
            return write(df, name, *rest)

        monkeypatch.setattr(module, "written", keep)
    return names


def test_a_round_of_components_is_one_table(spark, tables):
    got = _graph.components(spark.createDataFrame([(7, 3)], "a long, b long")).collect()
    assert sorted((r.node, r.root) for r in got) == [(3, 3), (7, 3)]
    # the edges, one round, and the round that finds no change
    assert len(tables) == 3


def test_components_of_any_graph(spark):
    rng = random.Random(11)
    for nodes, edges in ((60, 30), (60, 70), (40, 39)):
        pairs = [(i, i + 1) for i in range(edges)] if nodes == edges + 1 else [(rng.randrange(nodes), rng.randrange(nodes)) for _ in range(edges)]
        root = list(range(nodes))
        for _ in range(nodes):
            for a, b in pairs:
                root[a] = root[b] = min(root[a], root[b])
        got = {r.node: r.root for r in _graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
        assert got == {x: root[x] for a, b in pairs if a != b for x in (a, b)}


def test_near_duplicates_write_what_is_read_again(spark, tables):
    rng = random.Random(3)
    texts = [[rng.choice(WORDS) for _ in range(80)] for _ in range(6)]
    texts.append([*texts[0][:79], "other"])
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.near_duplicates(docs).collect()}
    assert got == {i: (i, 0) for i in range(1, 6)} | {0: (0, 1), 6: (0, 1)}
    assert "near-live" not in tables and tables.count("graph") == 6
