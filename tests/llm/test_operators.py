"""Operators against brute force on small documents with nulls, empty and long texts, ties and repeats."""

import hashlib
import heapq
import random
import re

import pytest

from wayfare.llm import decontam, jaccard, lines, mixing, quality, secrets, sharding, substring, suffix, tokens

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bucket string, kind string"


def make(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 0, "b", "k") for i, t, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))
    passage = " ".join(word() for _ in range(80))
    out = [(0, None, "a"), (1, "", None), (2, "one two", "a"), (None, passage, "b")]
    for i in range(3, 40):
        body = [word() for _ in range(rng.randint(0, 150))]
        if i % 3 == 0:
            body[len(body) // 2 : len(body) // 2] = passage.split()[: rng.randint(40, 80)]
        out.append((i, rng.choice([" ", "\n"]).join(body), f"s{i % 3}"))
    out += [(40, out[10][1], "a"), (41, out[10][1] + " more", "a"), (42, "x " * 400, "b"), (43, "long " + "word%d " * 9000 % tuple(range(9000)), "b")]
    return out


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_substring_dedup(spark, texts):
    got = by_id(substring.remove_repeats(make(spark, texts).repartition(3), chunk_bytes=3000))
    first = {}
    key = lambda i: 10**9 if i is None else i
    split = {i: (t or "").encode().split() for i, t, _ in texts}
    for i in sorted(split, key=key):
        for k in range(len(split[i]) - 49):
            first.setdefault(tuple(split[i][k : k + 50]), key(i))
    for i, w in split.items():
        gone = set()
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] < key(i):
                gone |= set(range(k, k + 50))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (len(w), len(gone), hashlib.sha256(kept).hexdigest())


@pytest.mark.parametrize("many", [256, 0])
def test_suffix_dedup(spark, texts, many, monkeypatch):
    monkeypatch.setattr(suffix, "MANY_KINDS", many)
    got = by_id(suffix.remove_repeated_bytes(make(spark, texts).repartition(3), chunk_bytes=3000))
    seen = set()
    for i, t, _ in sorted(texts, key=lambda r: 10**9 if r[0] is None else r[0]):
        b, gone = (t or "").encode(), set()
        for k in range(len(b) - 99):
            if b[k : k + 100] in seen:
                gone |= set(range(k, k + 100))
            seen.add(b[k : k + 100])
        kept = bytes(x for k, x in enumerate(b) if k not in gone)
        assert (got[i].n_bytes, got[i].n_removed, got[i].kept_sha256) == (len(b), len(gone), hashlib.sha256(kept).hexdigest())


@pytest.mark.parametrize("block", [1500, 2])
def test_near_duplicates(spark, texts, block):
    got = by_id(jaccard.near_duplicates(make(spark, texts), block=block))
    sets = {}
    for i, t, _ in texts:
        w = (t or "").split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else {()})
    for i, a in sets.items():
        assert got[i].n_links == sum(j != i and 9 * len(a & b) >= 4 * (len(a) + len(b)) for j, b in sets.items())


def test_sharding(spark, texts):
    got = sharding.shard_documents(make(spark, texts), shards=4).collect()
    assert len(got) == len(texts)
    for s in {r.shard for r in got}:
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    assert got and len({r.shard for r in got if r.doc_id in (9, 40)}) <= 2


def test_lpt_is_even():
    placed = dict(sharding.lpt(((k, 1) for k in range(100, 0, -1)), 4))
    load = [sum(k * got[s] for k, got in placed.items()) for s in range(4)]
    assert sum(load) == 5050 and max(load) <= (4 / 3 - 1 / 12) * 5050 / 4  # Graham's bound for four shards


def test_lpt_is_that_of_a_heap():
    rng = random.Random(8)
    for _ in range(60):
        sizes = {rng.randint(1, 60): rng.choice([1, 2, 5, 37, 500]) for _ in range(12)}
        shards = rng.randint(1, 7)
        heap = [(0, s) for s in range(shards)]
        for size, got in sharding.lpt(iter(sorted(sizes.items(), reverse=True)), shards):
            want = [0] * shards
            for _ in range(sizes[size]):
                load, s = heap[0]
                heapq.heapreplace(heap, (load + size, s))
                want[s] += 1
            assert got == want


def test_mixing(spark, texts):
    got = mixing.mix_sources(make(spark, texts), {"a": 1, "b": 2, "s0": 3, "s1": 3, "s2": 3, "": 1}, block=2).collect()
    assert sorted(r.position for r in got) == list(range(len(texts)))
    assert all(r.release <= r.slot < r.deadline for r in got)


def test_rows_in_mixed_order(spark, texts):
    docs = make(spark, texts)
    place = {}
    for r in mixing.mix_sources(docs, block=2).collect():
        place[r.doc_id] = min(place.get(r.doc_id, 10**9), r.position)
    parts = mixing.in_mixed_order(docs, block=2).rdd.glom().map(lambda p: [r.doc_id for r in p]).collect()
    got = [i for p in parts for i in p]
    assert [place[i] for i in got] == list(range(len(texts))) and len(parts) > 1


def test_pfair_deviation():
    weights = [5.0, 3.0, 1.5, 0.5]
    shares = mixing.whole(weights)
    given = [0] * len(weights)
    # blocks in proportion, so no source runs out before the end
    for t, (s, *_) in enumerate(mixing.edf([1000, 600, 300, 100], shares), 1):
        given[s] += 1
        assert all(abs(g - w * t / sum(weights)) < 1 for g, w in zip(given, weights, strict=True))
    assert given == [1000, 600, 300, 100]


def test_decontamination_with_substitutions(spark):
    item = " ".join(f"w{k}" for k in range(30))
    near = " ".join("zz" if k in (6, 17) else f"w{k}" for k in range(30))
    docs = make(spark, [(1, f"intro {near} end", "a"), (2, "clean text here", "a"), (3, None, "a")])
    bench = spark.createDataFrame([(7, item), (8, None), (None, "")], "item_id long, text string")
    got = decontam.find_contamination(docs, bench).collect()
    assert [(r.doc_id, r.item_id, r.n_matched) for r in got] == [(1, 7, 28)]
    assert sorted(r.doc_id for r in decontam.drop_contaminated(docs, bench).collect()) == [2, 3]


def test_secrets(spark):
    text = 'é token = "abcdef12" token=token:abcdef123 AKIA' + "B" * 16 + " " + "0a" * 12 + " q7Xk2LmP9vRt4WzY8cNb1HsJ6dFg3Ka5"
    r = by_id(secrets.find_secrets(make(spark, [(1, text, "a"), (2, None, "a")])))
    assign = [m for m in re.finditer(secrets.ASSIGN.replace("(?i)", ""), text, re.I | re.A) if len(m[2]) >= 6]
    assert (r[1].n_assign, r[1].n_access, r[1].n_hex) == (len(assign), 1, 1)
    assert r[2].base_sha256 == hashlib.sha256(b"").hexdigest()


def test_token_counts():
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    v = tokens.read_vocabulary()
    least = min(s for _, s in v)
    t = Tokenizer(models.Unigram([("<unk>", least), *v, *((f"<0x{i:02X}>", least) for i in range(256))], unk_id=0, byte_fallback=True))
    t.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(r"[\x20\x09-\x0D]+"), "removed"), pre_tokenizers.Metaspace(prepend_scheme="always")])
    c = tokens.Counter(v)
    for text in ("hello world", "naïve ☃☃ 字字 x", "aaaa" * 50, "token=\"7c72db\"", ""):
        assert sum(c[w.encode()] for w in text.split()) == len(t.encode(text, add_special_tokens=False).ids)


def test_line_templates(spark):
    docs = make(spark, [(i, f"{'abcdefghijkl'[i]}x {'abcdefghijkl'[i]}y {'abcdefghijkl'[i]}z own words here\nLicensed by user {i} under the MIT terms", "a") for i in range(12)] + [(20, None, "a"), (21, "", "a")])
    got = by_id(lines.drop_templates(docs))
    assert all(got[i].n_dropped == 1 and "Licensed" not in got[i].text for i in range(12))
    assert got[20].n_lines == 0 and got[21].n_dropped == 0


def test_quality_and_empty_tables(spark, texts):
    got = by_id(quality.quality_rules(make(spark, texts)))
    assert got[42].n_repeat_words == 400 and not got[42].kept and not got[0].kept
    empty = make(spark, texts).limit(0)
    bench = spark.createDataFrame([], "item_id long, text string")
    for f in (quality.quality_rules, quality.keep_good, sharding.shard_documents, mixing.mix_sources, mixing.in_mixed_order, secrets.find_secrets, lines.drop_templates, jaccard.near_duplicates, substring.remove_repeats, suffix.remove_repeated_bytes):
        assert f(empty).count() == 0
    assert decontam.find_contamination(empty, bench).count() == 0
    kept = quality.keep_good(make(spark, texts))
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.kept}
