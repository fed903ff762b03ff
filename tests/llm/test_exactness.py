"""Inputs made to fool hashes and sentinels, planted cases, and whole tables of sf0.01 against brute force."""

import hashlib
import random
import re

import pytest

from wayfare.llm import decontam, jaccard, queries, secrets, sharding, substring, suffix, tokens

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
DIR = "/root/testdata/sf0.01"
LAST = 2**63 - 1


def make(spark, texts):
    return spark.createDataFrame([(i, t, "en", "a", 0) for i, t in texts], SCHEMA)


def thue_morse(n, ones="ab"):
    return "".join(ones[bin(k).count("1") % 2] for k in range(n))


@pytest.fixture(scope="module")
def documents(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()]


def test_words_that_fool_polynomials(spark):
    a, b = thue_morse(2048), thue_morse(2048, "ba")
    same = " ".join(f"w{k}" for k in range(49))
    got = {r.doc_id: r.n_removed for r in substring.remove_repeats(make(spark, [(1, f"{same} {a}"), (2, f"{same} {b}"), (3, f"{same} {a}")])).collect()}
    assert got == {1: 0, 2: 0, 3: 50}
    near = {r.doc_id: (r.class_id, r.copy_id, r.n_links) for r in jaccard.near_duplicates(make(spark, [(1, f"x {a} y z q"), (2, f"x {b} y z q"), (3, f"x {a} y z q")])).collect()}
    assert near == {1: (1, 1, 1), 2: (2, 2, 0), 3: (1, 1, 1)}
    # a suffix order is made anew where hashes lie
    got = {r.doc_id: r.n_removed for r in suffix.remove_repeated_bytes(make(spark, [(1, a), (2, b)])).collect()}
    seen, gone = set(), {}
    for i, t in ((1, a), (2, b)):
        cover = set()
        for k in range(len(t) - 99):
            if t[k : k + 100] in seen:
                cover |= set(range(k, k + 100))
            seen.add(t[k : k + 100])
        gone[i] = len(cover)
    assert got == gone


def test_the_greatest_id_is_no_null(spark):
    text = " ".join(f"w{k}" for k in range(80))
    docs = make(spark, [(LAST, text), (None, text), (None, "other"), (LAST, "more")])
    for f, column in ((substring.remove_repeats, "n_removed"), (suffix.remove_repeated_bytes, "n_removed")):
        got = sorted((r.doc_id is None, r[column] > 0) for r in f(docs).collect())
        assert got == [(False, False), (False, False), (True, False), (True, True)], f
    got = sorted((r.doc_id is None, r.class_id, r.n_links) for r in jaccard.near_duplicates(docs).collect() if r.n_links)
    assert got == [(False, LAST, 1), (True, LAST, 1)]
    bench = spark.createDataFrame([(LAST, text), (None, text)], "item_id long, text string")
    got = sorted((r.doc_id is None, r.item_id is None) for r in decontam.find_contamination(docs, bench).collect())
    assert got == [(False, False), (False, True), (True, False), (True, True)]


def test_masks_miss_no_overlap():
    # by the last matches and mismatches: the fewest substitutions of a stretch that no mask fits
    span = max(map(len, decontam.MASKS)) - 1
    masks = [(int(m, 2), len(m)) for m in decontam.MASKS]
    fewest = {0: 0}
    for n in range(1, 121):
        after: dict[int, int] = {}
        for state, wrong in fewest.items():
            for match in (0, 1):
                window = state << 1 | match
                if not any(window & m == m for m, _ in masks):
                    key = window & (1 << span) - 1
                    after[key] = min(after.get(key, n), wrong + 1 - match)
        fewest = after
        # an overlap of n tokens has at most this many substitutions
        assert n < 13 or min(fewest.values()) > min(n - 13, n // 5), n


def test_overlaps_against_every_diagonal(spark):
    rng = random.Random(4)
    items = [[f"v{rng.randrange(40)}" for _ in range(rng.choice([3, 9, 14, 16, 20, 30, 60]))] for _ in range(25)]
    docs = []
    for k in range(150):
        item = list(rng.choice(items))
        for at in rng.sample(range(len(item)), rng.randint(0, len(item) // 4)):
            item[at] = f"v{rng.randrange(60)}"
        docs.append([f"v{rng.randrange(40)}" for _ in range(rng.randint(0, 9))] + item + ["end"] * rng.randint(0, 9))
    got = {(r.doc_id, r.item_id): r.n_matched for r in decontam.find_contamination(make(spark, [(k, " ".join(d)) for k, d in enumerate(docs)]), spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(items)], "item_id long, text string"), block_bytes=700).collect()}
    want = {}
    for k, d in enumerate(docs):
        for i, t in enumerate(items):
            for shift in range(-len(t) + 1, len(d)):
                lo, hi = max(shift, 0), min(shift + len(t), len(d))
                same = [d[x] == t[x - shift] for x in range(lo, hi)]
                most = max((sum(same[a:b]) for a in range(len(same)) for b in range(a + 1, len(same) + 1) if same[a] and same[b - 1] and 5 * sum(same[a:b]) >= 4 * (b - a)), default=0)
                if most >= min(13, len(t)):
                    want[k, i] = max(want.get((k, i), 0), most)
    assert got == want and len(want) > 50


def test_substring_dedup_of_a_table(spark, documents):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in queries.op2_block_anchor_dedup(spark, DIR).collect()}
    words = {i: re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode()) for i, t in documents}
    first = {}
    for i in sorted(words):
        for k in range(len(words[i]) - 49):
            first.setdefault(tuple(words[i][k : k + 50]), i)
    for i, w in words.items():
        gone = {x for k in range(len(w) - 49) if first[tuple(w[k : k + 50])] < i for x in range(k, k + 50)}
        assert got[i] == (len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest())


def test_suffix_dedup_of_a_table(spark, documents):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op10_suffix_dedup(spark, DIR).collect()}
    seen = set()
    for i, t in sorted(documents):
        b = (t or "").encode()
        until, kept, spans = 0, [], 0
        for k in range(len(b)):
            if k + 100 <= len(b):
                window = hashlib.blake2b(b[k : k + 100], digest_size=12).digest()
                if window in seen:
                    spans += k > until or not until
                    until = k + 100
                seen.add(window)
            if k >= until:
                kept.append(b[k])
        kept = bytes(kept)
        assert got[i] == (len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest()), i


def test_near_duplicates_of_a_table(spark, documents):
    got = {r.doc_id: r for r in queries.op6_minhash_forest_join(spark, DIR).collect()}
    sets, at = {}, {}
    for i, t in documents:
        w = (t or "").split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else {()})
        for x in sets[i]:
            at.setdefault(x, []).append(i)
    wanted = found = 0
    for i, a in sets.items():
        near = {j for x in a for j in at[x]} - {i}
        links = [j for j in near if 9 * len(a & sets[j]) >= 4 * (len(a) + len(sets[j]))]
        wanted, found = wanted + len(links), found + got[i].n_links
        assert got[i].n_links <= len(links) and all(got[j].class_id == got[i].class_id for j in links if got[i].n_links == len(links))
    assert found >= 0.999 * wanted > 0


def test_secrets_of_a_table(spark, documents):
    got = {r.doc_id: r for r in queries.op7_randomness_secrets(spark, DIR).collect()}
    kinds = [("assign", re.compile(secrets.ASSIGN.replace("(?i)", ""), re.I | re.A), lambda m: len(m[2]) >= 6), ("access", re.compile(secrets.ACCESS), lambda m: len(m[0]) >= 20), ("hex", re.compile(secrets.HEX), lambda m: len(m[0]) >= 24)]
    for i, t in documents:
        spans = sorted((m.start(), k, m.end(), name) for k, (name, p, good) in enumerate(kinds) for m in p.finditer(t or "") if good(m))
        base = ",".join(f"{name}:{s}:{e}" for s, _, e, name in spans)
        assert got[i].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert [sum(x[1] == k for x in spans) for k in range(3)] == [got[i].n_assign, got[i].n_access, got[i].n_hex]
        extra = [x for x in got[i].spans.split(",") if x and x.startswith("random")]
        assert len(extra) == got[i].n_random and set(base.split(",")) <= set(got[i].spans.split(",")) | {""}


def test_planted_random_keys(spark):
    rng = random.Random(11)
    symbols = secrets.ALPHABETS["base64"]
    keys = [(k, "see " + "".join(rng.choice(symbols) for _ in range(40)) + " here") for k in range(100)]
    # joined words and long names are not random
    words = ["internationalization", "configuration", "the", "management", "of", "characteristics", "responsibilities"]
    plain = [(1000 + k, "a " + "-".join(rng.sample(words, 4)) + " b") for k in range(400)] + [(2000 + k, "0" * 10 + f"{k:012d}") for k in range(100)]
    got = {r.doc_id: r.n_random for r in secrets.find_secrets(make(spark, keys + plain)).collect()}
    assert sum(got[k] for k, _ in keys) >= 95 and not any(got[k] for k, _ in plain)


def test_shards_are_those_of_a_heap(spark, documents):
    got = sharding.shard_documents(make(spark, documents)).collect()
    load, groups = [0] * 24, {}
    for r in got:
        load[r.shard] += r.size
    for i, t in documents:
        groups.setdefault(t or "", []).append(i)
    at = {r.doc_id: r.shard for r in got}
    assert all(len({at[i] for i in g}) == 1 for g in groups.values())
    mine = [0] * 24
    for size in sorted((len(g) * (len(t.encode()) + 8) for t, g in groups.items()), reverse=True):
        mine[mine.index(min(mine))] += size
    assert sorted(mine) == sorted(load)


def test_token_counts_of_a_table(spark, documents):
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    pieces = tokens.read_vocabulary()
    least = min(s for _, s in pieces)
    t = Tokenizer(models.Unigram([("<unk>", least), *pieces, *((f"<0x{i:02X}>", least) for i in range(256))], unk_id=0, byte_fallback=True))
    t.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(r"[\x20\x09-\x0D]+"), "removed"), pre_tokenizers.Metaspace(prepend_scheme="always")])
    got = {r.doc_id: (r.n_words, r.n_tokens) for r in queries.op3_unigram_token_counts(spark, DIR).collect()}
    for i, text in documents:
        words = (text or "").encode().split()
        assert got[i] == (len(words), len(t.encode(text or "", add_special_tokens=False).ids)), i
