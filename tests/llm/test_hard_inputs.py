"""Every operator and pipeline stage on nulls, empty and very long texts, repeated rows, clashing columns and empty tables."""

import hashlib

import pytest

import corpus_pipeline
from wayfare.llm import decontam, jaccard, lines, mixing, quality, secrets, sharding, substring, suffix, tokens

CLASH = ("row", "n", "h1", "key", "g", "comp", "size", "shard", "slot", "position", "block_no", "idx", "src", "failed", "host", "sig", "line", "copy_id", "class_id", "text_crc32", "n_words", "start", "count", "__clean", "__host", "__failed", "__n_words", "__id", "__source", "__position")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASH)
LONG = " ".join(f"word{k}" for k in range(20_000))


@pytest.fixture(scope="module")
def hard(spark):
    rows = [
        (1, "a plain sentence of a few words", "en", "a", 3),
        (1, "a plain sentence of a few words", "en", "a", 3),
        (1, "another text under an id that is taken", "en", "b", 3),
        (None, "a plain sentence of a few words", None, None, None),
        (None, None, None, None, None),
        (-5, None, "en", "a", None),
        (2, "", "en", None, 0),
        (3, " \t\n\r\v\f ", "en", "", 6),
        (4, "x" * 1_000_000, "en", "a", 1_000_000),
        (5, LONG, "en", "a", len(LONG)),
        (6, LONG, "en", "b", len(LONG)),
        (7, "\x00\x1f   é\U0001f600 " * 50, "en", "a", 1),
        (2**62, "\n".join(["same line here"] * 300), "en", "a", 1),
        *((None, None, None, None, None) for _ in range(3)),
    ]
    return spark.createDataFrame([(*r, *("z" for _ in CLASH)) for r in rows], SCHEMA).repartition(4).cache()


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, " ".join(f"word{k}" for k in range(900, 960)), "z"), (None, None, None), (2, "", "z"), (None, "!!! ???", "z")], "item_id long, text string, doc_id string")


EACH_ROW = {
    "substring": substring.remove_repeats, "suffix": suffix.remove_repeated_bytes, "tokens": lambda d: tokens.count_tokens(d, tokens.read_vocabulary()),
    "mixing": mixing.mix_sources, "mixed": mixing.in_mixed_order, "lines": lines.drop_templates, "near": jaccard.near_duplicates,
    "secrets": secrets.find_secrets, "sharding": sharding.shard_documents, "quality": quality.quality_rules,
}


@pytest.mark.parametrize("name", EACH_ROW)
def test_each_row_comes_back_once(hard, name):
    ids = lambda rows: sorted((r.doc_id is None, r.doc_id or 0) for r in rows)
    got = EACH_ROW[name](hard).collect()
    assert ids(got) == ids(hard.select("doc_id").collect())
    assert EACH_ROW[name](hard.limit(0)).collect() == []


def test_defined_results(hard):
    empty = hashlib.sha256(b"").hexdigest()
    cut = [r for r in substring.remove_repeats(hard).collect() if r.doc_id in (5, 6)]
    assert sorted((r.doc_id, r.n_words, r.n_removed) for r in cut) == [(5, 20_000, 0), (6, 20_000, 20_000)]
    assert all(r.kept_sha256 == empty for r in cut if r.doc_id == 6)
    cut = {r.doc_id: r for r in suffix.remove_repeated_bytes(hard).collect()}
    assert (cut[4].n_removed, cut[5].n_removed, cut[6].n_removed) == (1_000_000 - 1, 0, len(LONG))  # overlaps count: only the first byte starts nothing earlier
    near = {r.doc_id: r.class_id for r in jaccard.near_duplicates(hard).collect() if r.doc_id in (4, 5, 6)}
    assert near == {4: 4, 5: 5, 6: 5}


def test_contamination(hard, bench):
    got = decontam.find_contamination(hard, bench).collect()
    assert sorted((r.doc_id, r.item_id, r.n_matched) for r in got) == [(5, 1, 60), (6, 1, 60)]
    assert decontam.drop_contaminated(hard, bench.limit(0)).count() == hard.count()


def test_pipeline_stages(spark, hard, bench, tmp_path):
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, hard, str(tmp_path)).columns == hard.columns, name
        assert stage(spark, hard.limit(0), str(tmp_path)).count() == 0, name
    every = hard.count()
    assert mixing.in_mixed_order(hard).count() == every
    hard.write.parquet(f"{tmp_path}/documents.parquet")
    kept = {r.doc_id for r in quality.keep_good(hard).collect()}
    assert kept == {r.doc_id for r in quality.quality_rules(hard).collect() if r.kept}
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(kept - {5, 6})


def test_pipeline_on_no_documents(spark, hard, bench, tmp_path):
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    hard.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.count() == 0 and got.columns[:3] == ["doc_id", "size", "text_crc32"]
