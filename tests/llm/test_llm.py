"""Corpus operators against brute force, exact round trips and held-out accuracy, on small fixtures."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lamina.llm import ann, bpe, common, langid, media, packing, sentencepieces, sharding, simhash, suffixes, tokencount, toxicity
from lamina.llm.common import components, sampled, slice_of, small_table

DOCS = "doc_id long, text string, lang string, source string, n_chars long, h long, extra array<int>"
ODD = [None, "", " ", "\n", "a", "é ü", "a b c d e", "日本 語", "x" * 5000, "...", "0 1 2", "\x1c\x85 a", "<|endoftext|> b"]


def corpus(seed=1, n=40):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choices(vocab, k=rng.randint(1, 160))) for _ in range(n)]
    passage = " ".join(rng.choices(vocab, k=70))
    for i in range(0, n, 5):
        texts[i] += " " + passage + "\n" + rng.choice(vocab)
    for i in range(3, n, 9):
        texts[i] = texts[3]
    long = " ".join(rng.choices(vocab, k=9000))
    return texts + ODD + [long, long + " end", texts[1].upper()]


@pytest.fixture(scope="module")
def docs(spark):
    texts = corpus()
    rows = [(i * 3, t, "en", "s", len(t or ""), i, [i]) for i, t in enumerate(texts)]
    rows += [(None, "null id", None, None, None, None, None), (None, None, None, None, None, None, None), rows[4], rows[4]]
    return spark.createDataFrame(rows, DOCS).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def rows_of(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


# SimHash.


def plain_print(text, k=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hs = [xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), 42) for i in range(max(1, len(words) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_masks_cover_every_pair_within_the_radius():
    rng = random.Random(5)
    for radius in (1, 2, 3):
        masks = simhash.covering_masks(radius)
        for _ in range(500):
            x = sum(1 << b for b in rng.sample(range(64), rng.randint(0, radius)))
            assert any(x & m == 0 for m in masks)


def test_simhash_components_equal_brute_force(docs, empty):
    rows = rows_of(docs)
    prints = [plain_print(t) for _, t in rows]
    label = list(range(len(rows)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                label[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    want = sorted((str(d), prints[i], str(least.get(find(i)))) for i, (d, _) in enumerate(rows))
    got = sorted((str(r.doc_id), r.fp % 2**64, str(r.component_id)) for r in simhash.simhash_components(docs, 3).collect())
    assert got == want
    assert simhash.simhash_components(empty, 3).count() == 0


def test_near_prints_are_linked_in_chains(spark):
    rng = random.Random(2)
    prints = {rng.getrandbits(64) for _ in range(30)}
    for p in list(prints):
        for _ in range(12):
            prints.add(p := p ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 3))))
    prints = sorted(prints)
    signed = [p - 2**64 if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(0, p, p) for p in signed], "s int, fp long, node long")
    labels = {r.node: r.label for r in components(simhash.links(df)).collect()}
    brute = {p: p for p in signed}
    changed = True
    while changed:
        changed = False
        for a, x in zip(signed, prints, strict=True):
            for b, y in zip(signed, prints, strict=True):
                if (x ^ y).bit_count() <= 2 and brute[a] != brute[b]:
                    brute[a] = brute[b] = min(brute[a], brute[b])
                    changed = True
    assert {p: labels.get(p, p) for p in signed} == brute


def test_components_of_paths_stars_and_nothing(spark):
    path = [(i, i + 1) for i in range(60)] + [(1000 + i, 999) for i in range(1, 50)] + [(7, 7)]
    got = {r.node: r.label for r in components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert set(got.values()) == {0, 999} and sum(v == 0 for v in got.values()) == 61
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_workers_close_what_another_module_opened(monkeypatch):
    monkeypatch.setattr(bpe, "_OPEN", {})
    monkeypatch.setattr(common, "_AT", [])
    first, other = common.remote("lamina.llm.simhash:fingerprint_batches", 3), common.remote("lamina.llm.toxicity:learn_batches")
    assert list(first(iter([]))) == []
    bpe._OPEN["path"] = "a tokenizer"
    assert list(first(iter([]))) == [] and bpe._OPEN
    assert list(other(iter([]))) == [] and not bpe._OPEN


def test_words_find_their_rows_in_an_array():
    known = np.array(sorted({toxicity.bucket(w) for w in ("one", "two", "three")}))
    rows = toxicity._Rows(known)
    assert [known[rows[w] - 1] for w in ("one", "two", "three")] == [toxicity.bucket(w) for w in ("one", "two", "three")]
    assert {rows[f"other{i}"] for i in range(50)} == {0}
    assert toxicity._Rows(np.array([], np.int64))["one"] == 0
    assert toxicity._Rows(known.astype("<i4")).known.dtype == np.int64  # of the kind that is searched for


def test_small_tables_keep_rows_and_types(spark):
    ddl = "a long, b int, c boolean"
    rows = [(1, None, True), (None, -2, None), (1, None, True)]
    for some in (rows, []):
        found = small_table(spark, some, ddl)
        assert found.schema.simpleString() == "struct<a:bigint,b:int,c:boolean>"
        assert sorted(map(tuple, found.collect()), key=str) == sorted(some, key=str)


def test_keep_one_catches_near_copies_and_keeps_the_rest(spark, empty):
    rng = random.Random(8)
    vocab = [f"v{i}" for i in range(900)]
    texts = [rng.choices(vocab, k=200) for _ in range(20)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    for i in range(10):
        near = list(texts[i])
        near[rng.randrange(200)] = "changed"
        rows += [(100 + i, " ".join(near)), (200 + i, " ".join(texts[i]).upper())]
    rows += [(300, ""), (301, None), (302, "  "), (None, "x"), (None, "x"), (19, rows[19][1])]
    df = spark.createDataFrame([(d, t, "en", "s", 1, 2, [3]) for d, t in rows], DOCS)
    kept = simhash.keep_one(df, 5)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [*range(20), 300, 301, 302]
    assert kept.where("doc_id is null").count() == 2
    assert simhash.keep_one(empty, 5).count() == 0


def test_near_copies_equal_brute_force_over_exact_jaccard(spark):
    rng = random.Random(18)
    vocab = [f"v{i}" for i in range(900)]
    texts = []
    for _ in range(12):  # passages appended, removed, replaced, and scattered edits
        t = rng.choices(vocab, k=200)
        texts += [t, t + rng.choices(vocab, k=20), t + rng.choices(vocab, k=45), t[:170], t[:60] + t[85:], t[:90] + rng.choices(vocab, k=12) + t[102:], t[100:] + t[:100]]
        texts.append([w if rng.random() > 0.02 else "changed" for w in t])
    words = rng.choices(vocab, k=120)
    texts.append(sorted(words))  # not alike to what follows, and the smallest of their group
    for _ in range(4):
        rng.shuffle(words)
        texts += [list(words), [*words[:-1], "other"]]
    line = rng.choices(vocab, k=40)  # shared by many that are otherwise unlike
    texts += [line + rng.choices(vocab, k=rng.randint(1, 40)) for _ in range(40)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    label = plain_groups([t for _, t in rows])
    found = simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string"), 5)
    assert {r.doc_id: r.first_doc for r in found.collect()} == dict(enumerate(label))


def test_large_groups_of_edits_of_one_text_make_few_pairs(spark, monkeypatch):
    rng = random.Random(52)
    vocab = [f"v{i}" for i in range(900)]
    texts = []
    for words, many in ((150, 260), (49, 70), (250, 90)):  # 49 words: one edit leaves a similarity of just 0.8
        base = rng.choices(vocab, k=words)
        spare = rng.choices(vocab, k=12)  # few words and places, so that edits are shared
        for i in range(many):
            t = list(base)
            for at in rng.sample(range(0, words, 6), min(words // 6, 1 + i % 9)):
                t[at] = rng.choice(spare)
            texts.append([*t[: words - rng.choice((0, 0, 5, 11))], *rng.choices(vocab, k=rng.choice((0, 0, 0, 4)))])
    line = rng.choices(vocab, k=30)  # shared by texts that are otherwise unlike
    texts += [line + rng.choices(vocab, k=rng.randint(1, 60)) for _ in range(60)]
    rng.shuffle(texts)
    texts = [" ".join(t) for t in texts]
    proposed, alike = [], simhash.alike
    monkeypatch.setattr(simhash, "alike", lambda *a: proposed.append(a[3].count()) or alike(*a))
    found = simhash.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 5)
    label = plain_groups(texts)
    assert {r.doc_id: r.first_doc for r in found.collect()} == dict(enumerate(label))
    # Not all pairs of a group's members with what is nearly alike.
    assert len(set(label)) > 100 and proposed[-1] < len(texts), proposed


def test_parities_bound_the_symmetric_difference():
    rng = np.random.default_rng(6)
    for n, m, both in ((0, 5, 0), (40, 44, 30), (300, 20, 10), (90, 90, 90), (1500, 1100, 1000), (2000, 2000, 1990)):
        every = np.unique(rng.integers(0, 2**64, n + m, dtype=np.uint64))
        a, b = every[:n], every[n - both : n - both + m]
        bits = [simhash.parities(s) for s in (a, b)]
        longs = min(map(len, bits))
        differ = int(np.bitwise_count((simhash.folded(bits[0], longs) ^ simhash.folded(bits[1], longs)).view(np.uint64)).sum())
        assert differ <= len(np.setxor1d(a, b)) and (differ > 0) == (len(np.setxor1d(a, b)) > 0)
        for x, s in zip(bits, (a, b), strict=True):
            assert len(x) * 64 >= len(s) and np.array_equal(simhash.folded(x, 4), simhash.folded(simhash.folded(x, max(4, len(x) // 2)), 4))


def plain_groups(texts):
    """The smallest number of an alike text, for each text."""
    words = [t.lower().split() for t in texts]
    sets = [{tuple(t[i : i + 5]) for i in range(max(1, len(t) - 4))} if t else set() for t in words]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return label


def test_keep_one_tells_documents_of_one_doc_id_by_their_texts(spark):
    rng = random.Random(31)
    vocab = [f"v{i}" for i in range(900)]
    a, b, c, d = (rng.choices(vocab, k=60) for _ in range(4))
    near = [*b[:-1], "other"]
    texts = [(1, a), (2, a), (2, b), (3, b), (3, c), (3, c), (4, near), (4, d), (7, []), (7, []), (7, d), (None, a), (None, a), (None, [])]
    rows = [(doc, " ".join(t), n) for n, (doc, t) in enumerate(texts)]
    clash = "doc_id long, text string, gone int, near_doc int, Near_H int, near_fate int, h int, first_doc int, n int"
    df = spark.createDataFrame([(doc, t, n, n, n, n, n, n, n) for doc, t, n in rows], clash)
    kept = simhash.keep_one(df, 5)
    assert kept.columns == df.columns
    got = Counter((r.doc_id, r.text) for r in kept.collect())
    # The first of each group by (doc_id, text); repeated rows once; no doc_id or no words: all.
    ids = sorted({(doc, t) for doc, t, _ in rows if doc is not None and t})
    firsts = {}
    for i, k in enumerate(plain_groups([t for _, t in ids])):
        firsts.setdefault(k, ids[i])
    want = Counter(firsts.values()) + Counter((doc, t) for doc, t, _ in rows if doc is None or not t)
    assert got == want and (2, " ".join(b)) in got and (3, " ".join(c)) in got


def test_print_links_connect_equal_and_near_fingerprints(spark):
    rng = random.Random(40)
    prints = [rng.getrandbits(64) for _ in range(40)]
    prints += [p ^ 1 << rng.randrange(64) for p in prints[:20]] + [p ^ 5 << rng.randrange(60) for p in prints[10:30]] + prints[5:25] * 3 + [0] * 60
    rows = [(p - (1 << 64) if p >> 63 else p, n) for n, p in enumerate(prints)]
    found = {r.node: r.label for r in components(simhash.print_links(spark.createDataFrame(rows, "fp long, node long"))).collect()}
    label = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    assert [found.get(n, n) for n in range(len(prints))] == label


def test_the_pipeline_links_near_copies_by_fingerprints_first(spark, monkeypatch):
    import corpus_pipeline as p

    rng = random.Random(41)
    vocab = [f"v{i}" for i in range(900)]
    texts = [rng.choices(vocab, k=700) for _ in range(8)]
    texts += [[*t[:-1], "changed"] for t in texts[:5]]  # few bits of the fingerprint
    texts += [t[:-60] + rng.choices(vocab, k=60) for t in texts[5:8]]  # alike, but many bits
    line = rng.choices(vocab, k=30)  # most of both texts, so of their fingerprints, but not of their sets
    texts += [line * 9 + rng.choices(vocab, k=25) for _ in range(2)]
    texts = [" ".join(t) for t in texts]
    prints = [simhash.simhash(t, 5) for t in texts]
    near = {(i, j) for i in range(len(texts)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2}
    linked, proposed, links, alike = [], [], simhash.links, simhash.alike
    monkeypatch.setattr(simhash, "links", lambda prints: linked.append({r.fp % 2**64 for r in prints.collect()}) or links(prints))
    monkeypatch.setattr(simhash, "alike", lambda *a: proposed.append({(r.a, r.b) for r in a[3].collect()}) or alike(*a))
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)
    kept = {r.doc_id for r in p.drop_near_copies(spark, df, "").collect()}
    label = plain_groups(texts)
    assert kept == set(label) and len(kept) < len(texts)
    # All fingerprints are linked, and what they link is compared before anything else.
    assert linked == [set(prints)]
    assert len(proposed[0]) == len(near) >= 3
    found = simhash.near_copies(df, 5).collect()
    assert {r.doc_id: r.fp % 2**64 for r in found} == dict(enumerate(prints))


# Sharding.


def test_shards_are_contiguous_gapless_and_near_equal(docs, empty):
    rows = rows_of(docs)
    got = sharding.shard_by_bytes(docs, 8).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((d, len((t or "").encode()) + 1, None if t is None else zlib.crc32(t.encode())) for d, t in rows)
    sizes = Counter()
    for s in {r.shard for r in got}:
        own = sorted(r.slot for r in got if r.shard == s)
        assert own == list(range(len(own)))
        sizes[s] = sum(r.size for r in got if r.shard == s)
    assert set(sizes) <= set(range(8))
    largest = max(r.size for r in got)
    assert all(abs(sizes[s] - sum(sizes.values()) / 8) <= largest for s in range(8))
    order = sorted((r.shard, r.slot, -1 if r.doc_id is None else r.doc_id) for r in got)
    assert [x[2] for x in order] == sorted(x[2] for x in order)
    assert sharding.shard_by_bytes(empty).count() == 0


# Tokens.


def test_bpe_ids_are_those_of_the_library():
    enc = bpe.encoder(bpe.default_path())
    for t in [x for x in corpus(3) if x] + ["  a  b \n\n c", "it's 'll \t x\r\n y ", "²³ ½ a1b2_c__d", "日本 語　x", "😀"]:
        assert enc.encode(t).tolist() == enc.tokenizer.encode(t, add_special_tokens=False).ids
    assert int(enc.byte_lengths()[enc.encode("né ü 😀 b\n")].sum()) == len("né ü 😀 b\n".encode())


def test_section_counts_equal_offsets_of_the_library(docs, empty):
    tokenizer = bpe.encoder(bpe.default_path()).tokenizer
    got = {}
    for r in tokencount.section_token_counts(docs).collect():
        got.setdefault((r.doc_id, r.start, r.n_chars, r.section), []).append(r.n_tokens)
    for doc, text in rows_of(docs):
        text = text or ""
        lines = text.splitlines(keepends=True) if set(text) <= set(map(chr, range(32, 127))) | {"\n"} else text.replace("\n", "\n\0").split("\0")
        lines = [x for x in lines if x] or [""]
        ends = np.cumsum([len(x) for x in lines])
        counts = Counter(int(np.searchsorted(ends, a, side="right")) for a, _ in tokenizer.encode(text, add_special_tokens=False).offsets)
        for i, line in enumerate(lines):
            assert counts.get(i, 0) in got[(doc, int(ends[i]) - len(line), len(line), i)]
    assert tokencount.section_token_counts(empty).count() == 0


def test_allocation_rules():
    tokens, sections = np.array([2, 7, 9, 12]), np.array([3, 3, 8, 12])
    assert tokencount.attribute(tokens, sections, "first")[0].tolist() == [2, 0, 1, 1]
    assert tokencount.attribute(tokens, sections, "last")[0].tolist() == [1, 0, 1, 2]
    assert tokencount.attribute(tokens, sections, "most")[0].tolist() == [1, 0, 2, 1]
    assert all(tokencount.attribute(tokens, sections, r)[0].sum() == 4 for r in tokencount.RULES)


# Packing.


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 24), max_size=30), st.integers(1, 30))
def test_fullest_combination_is_the_best_one(lengths, capacity):
    counts = np.bincount(lengths, minlength=31)
    got = packing.fullest(counts, capacity)
    sums = {0}
    for n in lengths:
        sums |= {s + n for s in sums if s + n <= capacity}
    assert sum(n * k for n, k in got) == max(sums)
    assert all(k <= counts[n] for n, k in got)


def test_plan_uses_every_piece_once():
    rng = np.random.default_rng(4)
    counts = np.bincount(rng.integers(1, 2049, 5000), minlength=2049)
    plan = packing.minimum_bin_slack(counts)
    used = np.zeros(2049, int)
    for bins, inside in plan:
        assert sum(n * k for n, k in inside) <= 2048
        for n, k in inside:
            used[n] += bins * k
    assert (used == counts).all()
    # Lengths spread evenly: pieces over half a bin cannot share one, so the bound by tokens is out of reach here.
    least = max(math.ceil((counts * np.arange(2049)).sum() / 2048), counts[1025:].sum())
    assert sum(b for b, _ in plan) <= 1.015 * least
    assert packing.minimum_bin_slack(np.zeros(9, int), 8) == []


def test_packing_places_all_tokens(docs, empty):
    tokenizer = bpe.encoder(bpe.default_path()).tokenizer
    got = packing.pack(docs).collect()
    want = Counter()
    for doc, text in rows_of(docs):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        first = len(ids) % 2048 or 2048
        cuts = [0, *range(first, len(ids) + 1, 2048)]
        for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[(doc, i, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    for s in {r.sequence_id for r in got}:
        own = sorted((r.offset, r.length) for r in got if r.sequence_id == s)
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:], strict=False)) and sum(own[-1]) <= 2048
    assert packing.pack(empty).count() == 0


def test_packed_pieces_hold_their_tokens(docs):
    got = packing.pack(docs).collect()
    assert all(len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in got)
    assert packing.pack(docs).drop("ids").columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


# Language.


def test_language_of_held_out_texts(spark, empty):
    rng = random.Random(3)
    words = {"aa": ["lorem", "ipsum", "dolor", "sit"], "bb": ["der", "und", "nicht", "schön"], "cc": ["était", "où", "garçon", "le"]}
    rows = [(i, " ".join(rng.choices(words[k], k=rng.randint(3, 40))), k) for i, k in enumerate(rng.choices(sorted(words), k=240))]
    rows += [(900, None, "aa"), (901, "", None), (902, "12 ..", "bb"), (None, "der und", None), (5, rows[5][1], rows[5][2])]
    df = spark.createDataFrame([(d, t, lang, "s", 0, 0, []) for d, t, lang in rows], DOCS)
    model = langid.fit_on(df, langid.fold(4) != 2)
    got = [(r.doc_id, r.lang_pred, r.rejected) for r in langid.identify(df, model).collect()]
    truth = {d: lang for d, _, lang in rows[:240]}
    assert len(got) == len(rows) and all(p == truth[d] for d, p, _ in got if d in truth)
    assert {d: p for d, p, _ in got if d in (900, 901, 902)} == {900: "und", 901: "und", 902: "und"}
    assert not any(x for d, _, x in got if d in truth)
    assert langid.keep_known(df).count() == len(rows) - 3
    assert langid.fit_on(empty, langid.fold(4) != 2) is None
    assert {r.lang_pred for r in langid.identify(df, None).collect()} == {"und"}
    assert langid.keep_known(empty).count() == 0


def test_what_is_no_language_of_the_corpus_is_rejected(spark):
    import base64

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit_on(docs, langid.fold(4) != 2)
    rng = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyz"
    strange = [" ".join("".join(rng.choices(letters, k=rng.randint(2, 9))) for _ in range(1000)), base64.b64encode(rng.randbytes(3000)).decode(), "Nel mezzo del cammin di nostra vita mi ritrovai per una selva oscura, che la diritta via era smarrita. " * 3]
    rows = [(-1 - i, t) for i, t in enumerate(strange)]
    held = [r for r in docs.where(langid.fold(4) == 2).collect() if r.text and len(r.text) >= 200]
    rows += [(r.doc_id, r.text[:n]) for r in held for n in (40, 200)]
    got = langid.identify(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    assert [r.rejected for r in got if r.doc_id < 0] == [True] * 3
    assert sum(r.rejected for r in got if r.doc_id >= 0) <= 0.03 * 2 * len(held)


# Toxicity.


def test_toxicity_on_held_out_texts(spark, empty):
    rng = random.Random(6)
    calm = [f"word{i}" for i in range(300)] + ["the", "of", "and"]
    rows, labels = [], []
    for i in range(600):
        text = rng.choices(calm, k=rng.randint(5, 60))
        toxic = int(i % 4 == 0)
        if toxic:
            text[rng.randrange(len(text))] = rng.choice(["vile!", "ROTTEN", "nasty,"])
        rows.append((i, " ".join(text)))
        labels.append((i, toxic))
    rows += [(700, None), (701, ""), (None, "vile"), (3, rows[3][1])]
    df = spark.createDataFrame([(d, t, "en", "s", 0, 0, []) for d, t in rows], DOCS)
    lab = spark.createDataFrame(labels + [(None, 1), (800, None), (1, 0)], "doc_id long, toxic int")
    net = toxicity.fit_on(df, lab, langid.fold(5) != 0)
    got = {r.doc_id: r.score for r in toxicity.score(df, net).collect()}
    assert all(0 <= s <= 1 for s in got.values())
    held = [(got[d], t) for d, t in labels if zlib.crc32(str(d).encode()) % 5 == 0]
    assert sum((s >= 0.5) == bool(t) for s, t in held) >= 0.97 * len(held)
    assert got[700] == got[701] < 0.5
    kept = toxicity.keep_clean(df, lab)
    assert kept.columns == df.columns and kept.count() == sum(r.score < 0.5 for r in toxicity.score(df, net).collect())
    assert toxicity.fit_on(df, lab.where("toxic = 0"), langid.fold(5) != 0) is None
    assert toxicity.score(empty, net).count() == 0


def small_net(seed):
    rng = np.random.default_rng(seed)
    shape = lambda *n: rng.normal(0, 0.4, n)
    embedding = shape(9, toxicity.SIZE)
    embedding[0] = 0
    n = toxicity.FILTERS
    return toxicity.TextCnn({}, embedding, [shape(w, toxicity.SIZE, n) for w in toxicity.WIDTHS], [shape(n) for _ in toxicity.WIDTHS], shape(n * len(toxicity.WIDTHS)), 0.3, {-1: 0.5})


def plain_output(net, ids):
    """Scalar convolution: words, then zero vectors, so that every text has a window of each width."""
    total = net.out_bias
    padded = [net.embedding[i] for i in ids] + [net.embedding[0]] * max(toxicity.WIDTHS)
    for k, width in enumerate(toxicity.WIDTHS):
        for f in range(toxicity.FILTERS):
            best = 0.0
            for at in range(len(padded) - width + 1):
                got = net.bias[k][f]
                for j in range(width):
                    for d in range(toxicity.SIZE):
                        got += padded[at + j][d] * net.filters[k][j, d, f]
                best = max(best, got)
            total += best * net.out[k * toxicity.FILTERS + f]
    return 1 / (1 + math.exp(-total))


def test_convolution_equals_scalar_loops():
    rng = random.Random(1)
    texts = [[rng.randrange(9) for _ in range(n)] for n in (0, 1, 2, 3, 7, 20)]
    net = small_net(3)
    found = net.outputs(*toxicity.joined([np.array(t, np.int64) for t in texts]))
    assert [plain_output(net, t) for t in texts] == pytest.approx(found.tolist())


def test_gradients_equal_finite_differences():
    rng = random.Random(2)
    texts = [np.array([rng.randrange(1, 9) for _ in range(n)], np.int64) for n in (4, 9, 2)]
    labels, weight = np.array([1, 0, 1]), np.array([0.7, 1.9])
    flat, cuts = toxicity.joined(texts)
    net = small_net(5)

    def loss():
        p = net.outputs(flat, cuts)
        return float(np.mean(weight[labels] * -np.where(labels == 1, np.log(p), np.log(1 - p))))

    rows, grad_e, grads_f, grads_b, grad_out, grad_bias = toxicity.gradients(net, flat, cuts, labels, weight)
    every = np.zeros_like(net.embedding)
    every[rows] = grad_e
    for x, g in zip([net.embedding, *net.filters, *net.bias, net.out], [every, *grads_f, *grads_b, grad_out], strict=True):
        for _ in range(12):
            at = tuple(rng.randrange(1 if x is net.embedding and i == 0 else 0, n) for i, n in enumerate(x.shape))
            was = x[at]
            x[at] = was + 1e-6
            up = loss()
            x[at] = was - 1e-6
            down = loss()
            x[at] = was
            assert (up - down) / 2e-6 == pytest.approx(g[at], abs=1e-5)
    was, step = net.out_bias, 1e-6
    net.out_bias = was + step
    up = loss()
    net.out_bias = was - step
    assert (up - loss()) / (2 * step) == pytest.approx(grad_bias, abs=1e-5)


# SentencePiece.


def brute_score(model, text):
    kept = {p: s for (p, _, kind), s in zip(model.pieces, model._score, strict=True) if kind in (1, 4)}
    best = [0.0] + [-math.inf] * len(text)
    for i in range(len(text)):
        for j in range(i + 1, min(len(text), i + 20) + 1):
            if text[i:j] in kept:
                best[j] = max(best[j], best[i] + kept[text[i:j]])
        if text[i] not in kept:
            best[i + 1] = max(best[i + 1], best[i] + model._unknown_score)
    return best[-1]


def test_unigram_paths_are_best_and_decode_back():
    path = bpe.default_path("piece_bpe_32k.model")
    model = sentencepieces.opened(path)
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    for text in ["tioning the retitioning", "  a  b", "日本語 x\n\n y", "😀 é", "a\nb  c", "Ciónue que 12,5%"]:
        ids = model.encode(text).tolist()
        marked = sentencepieces.MARK + text.replace(" ", sentencepieces.MARK)
        spelled = b"".join(model._bytes[i] for i in ids).decode()
        assert spelled == marked and model.decode(ids) == text == library.decode(ids)
        unknown = sum(c not in {p for p, _, k in model.pieces if k in (1, 4)} for c in marked)
        own = sum(model._score[i] for i in ids if i not in model._byte_ids) + unknown * model._unknown_score
        assert own == pytest.approx(brute_score(model, marked))
    assert model.encode("").tolist() == [] and model.decode([]) == ""


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.binary(min_size=1, max_size=6), st.integers(0, 1000), max_size=60))
def test_double_array_holds_exactly_its_keys(keys):
    trie = sentencepieces.DoubleArray.build(keys)

    def find(key):
        s = 0
        for b in key:
            t = trie.base[s] + b + 1
            if not 0 < t < len(trie.check) or trie.check[t] != s:
                return -1
            s = t
        return int(trie.value[s])

    for k, v in keys.items():
        assert find(k) == v
        assert find(k + b"x") == keys.get(k + b"x", -1)


def test_sentencepiece_operator(docs, empty):
    got = sentencepieces.encode_and_decode(docs).collect()
    assert len(got) == docs.count()
    assert all((r.ids is None) == (r.lossless is None) and r.lossless in (True, None) for r in got)
    assert sentencepieces.encode_and_decode(empty).count() == 0


# Repeated passages.


def test_repeated_passages_equal_brute_force(docs, empty):
    rows = {(d, t) for d, t in rows_of(docs) if t is not None}
    seen = {}
    for d, t in rows:
        w = t.encode().split()
        for i in range(len(w) - 49):
            seen.setdefault(tuple(w[i : i + 50]), []).append((d, i))
    want = {}
    for places in seen.values():
        if len(places) > 1:
            for d, i in places:
                want.setdefault(d, set()).update(range(i, i + 50))
    got, cut = {}, {}
    for r in suffixes.repeated_passages(docs).collect():
        got.setdefault(r.doc_id, set()).update(range(r.start, r.end))
        if r.removable:
            cut.setdefault(r.doc_id, set()).update(range(r.start, r.end))
    assert got == want
    for places in seen.values():
        if len(places) > 1:  # all but one occurrence lose words, and what goes stays somewhere
            assert sum(not cut.get(d, set()) & set(range(i, i + 50)) for d, i in places) <= 1
    assert suffixes.repeated_passages(empty).count() == 0


def test_cutting_keeps_first_occurrences(docs, empty):
    kept = suffixes.cut_repeats(docs)
    assert kept.columns == docs.columns
    clash = docs.withColumns({c: F.lit(1) for c in ("cut_spans", "cut_doc", "Cut_H", "first_docs")})
    assert sorted(map(str, suffixes.cut_repeats(clash).select(docs.columns).collect())) == sorted(map(str, kept.collect()))
    after = {r.doc_id: r.text for r in kept.collect()}
    texts = dict(rows_of(docs))
    passage = " ".join(texts[0].split()[-71:-1])
    assert sum(passage in (t or "") for t in after.values()) == 1 and passage in after[0]
    assert after[3 * 3] == texts[9] and 3 * 12 not in after  # a whole copy goes
    assert all(after[d] == t for d, t in texts.items() if d is not None and d in after and (t is None or len(t.split()) < 50))
    assert suffixes.without("a b  c d\n", [(1, 3)]) == "a d\n"
    assert suffixes.cut_repeats(empty).count() == 0


def repeated_in(rows):
    """{window: places} of the 50-word windows at several places."""
    seen = {}
    for d, t in rows:
        w = t.split()
        for i in range(len(w) - 49):
            seen.setdefault(tuple(w[i : i + 50]), []).append((d, i))
    return {w: p for w, p in seen.items() if len(p) > 1}


def found_in(spark, rows):
    got, cut = set(), set()
    for r in suffixes.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.update((r.doc_id, i) for i in range(r.start, r.end))
        cut.update((r.doc_id, i) for i in range(r.start, r.end) if r.removable)
    return got, cut


def test_cut_words_stay_in_an_earlier_occurrence(spark):
    rng = random.Random(21)
    words = [f"w{i}" for i in range(5000)]
    rows, n = [], 0
    for _ in range(20):  # the first holds a part of what the others share
        passage = rng.choices(words, k=120)
        for part in (passage[: rng.randint(50, 70)], passage, passage):
            rows.append((n, " ".join([*rng.choices(words, k=30), *part, *rng.choices(words, k=30)])))
            n += 1
    rows += [(n, " ".join(rng.choices(words, k=10) * 20)), (n + 1, rows[1][1]), (n + 2, rows[0][1] + " " + rows[5][1])]
    windows = repeated_in(rows)
    got, cut = found_in(spark, rows)
    assert got == {(d, i + k) for places in windows.values() for d, i in places for k in range(50)}
    label = {x: x for x in got}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for places in windows.values():
        assert sum(not any((d, i + k) in cut for k in range(50)) for d, i in places) <= 1
        for d, i in places[1:]:
            for k in range(50):
                a, b = sorted((find((places[0][0], places[0][1] + k)), find((d, i + k))))
                label[b] = a
    stays = {find(x) for x in got - cut}
    assert all(find(x) in stays for x in cut)
    left = {d: " ".join(w for i, w in enumerate(t.split()) if (d, i) not in cut) for d, t in rows}
    for i in range(0, 60, 3):  # the words after the first's part stay, in one piece
        shared = 50 + next(k for k in range(50, 71) if rows[i][1].split()[30 + k] != rows[i + 1][1].split()[30 + k]) - 50
        passage = rows[i + 1][1].split()[30:150]
        assert any(" ".join(passage[:shared]) in t for t in left.values())
        assert any(" ".join(passage[shared:]) in t for t in left.values())


def test_passages_are_found_beside_many_quotes_of_a_part(spark):
    rng = random.Random(22)
    words = [f"w{i}" for i in range(5000)]
    rows, n = [], 0
    for size in [50, 51, 52, 55, 60] * 6:
        passage = rng.choices(words, k=size)
        for k in [size, *[0] * 50, size]:
            k = k or rng.randint(35, 48)
            a = rng.randint(0, size - k)
            rows.append((n, " ".join([*rng.choices(words, k=25), *passage[a : a + k], *rng.choices(words, k=25)])))
            n += 1
    want = {(d, i + k) for places in repeated_in(rows).values() for d, i in places for k in range(50)}
    assert found_in(spark, rows)[0] == want


# Media.


def test_payloads_come_back_from_their_files():
    rng = np.random.default_rng(1)
    payloads = [rng.integers(0, 256, 192 * k, dtype=np.uint8).tobytes() for k in (1, 3, 7)]
    payloads += [b"\xff" * 384, b"\0" * 192, b" " * 192 * 9000, media.padded("abc é"), media.padded(None), bytes(rng.choice([255, 255, 255, 254], 768).astype(np.uint8))]
    found = media.read_files(media.write_files(payloads))
    assert [media.payload_of(*f) for f in found] == payloads
    image, coefficients = found[5]
    assert (image.width, image.height) == (16, 36000) and media.thumbnail(image, coefficients).shape == (4500, 2)


def test_a_scan_without_restarts_and_broken_files():
    file = media.write_files([media.padded("hello world")])[0]
    dri = file.index(b"\xff\xdd")
    image, coefficients = media.read_files([file[:dri] + file[dri + 6 :]])[0]
    assert image.interval == 0 and media.payload_of(image, coefficients) == media.padded("hello world")
    for bad in (b"", file[:40], file[:-60] + b"\xff\xd9", b"xx" + file):
        with pytest.raises(ValueError):
            media.read_files([bad])


def test_media_operator(docs, empty):
    got = media.media_digests(docs).collect()
    assert Counter((r.doc_id, r.n_bytes) for r in got) == Counter((d, len((t or "").encode())) for d, t in rows_of(docs))
    assert all(r.payload_bytes % 192 == 0 < r.payload_bytes for r in got)
    assert media.media_digests(empty).count() == 0


def test_media_files_are_kept(docs):
    texts = Counter((d, media.padded(t)) for d, t in rows_of(docs))
    got = media.media_files(docs).collect()
    assert Counter((r.doc_id, bytes(r.payload)) for r in got) == texts
    assert all(media.payload_of(*media.read_files([bytes(r.media)])[0]) == r.payload for r in got[:20])
    import hashlib

    want = Counter((r.doc_id, len(r.payload), hashlib.sha256(r.payload).hexdigest(), zlib.crc32(r.payload[-16:]), len(r.media), hashlib.sha256(r.media).hexdigest(), f"{r.width}x{r.height}:{r.thumbnail_hash % 2**64:016x}") for r in got)
    assert Counter((r.doc_id, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256, r.feature) for r in media.media_digests(docs).collect()) == want


# Neighbours.


def test_neighbours_recall_and_exact_scores(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(1500, 16)).astype(np.float32)
    x[700:900] = x[700]
    vecs = [(i, v.tolist()) for i, v in enumerate(x)]
    vecs += [(2000, None), (2050, []), (2100, [0.0] * 16), (2150, [math.nan] + [1.0] * 15), (2200, [None] + [1.0] * 15), (None, [1.0] * 16), (2250, [1.0] * 3), vecs[50]]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in vecs], "vec_id long, embedding array<float>, label int, gid int")
    out = ann.search(df, F.col("vec_id") % 50 == 0, 5).collect()
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    hit = 0
    for q in range(0, 1500, 50):
        own = sorted((r.rank, r.vec_id, r.score) for r in out if r.query_id == q)
        assert [o[0] for o in own] == [1, 2, 3, 4, 5] and q not in [o[1] for o in own]
        cos = unit @ unit[q]
        assert all(abs(s - cos[v]) < 1e-12 for _, v, s in own)
        best = sorted((i for i in range(1500) if i != q), key=lambda i: (-round(cos[i], 12), i))[:5]
        hit += len({o[1] for o in own} & set(best))
    assert hit >= 0.9 * 150
    assert {r.query_id for r in out} == set(range(0, 1500, 50))
    assert [r.vec_id for r in sorted(out, key=lambda r: r.rank) if r.query_id == 700] == [701, 702, 703, 704, 705]
    few = ann.search(df.where("vec_id in (0, 1, 2)"), F.col("vec_id") % 50 == 0).collect()
    assert sorted(r.vec_id for r in few) == [1, 2]
    assert ann.search(df.where("false"), F.lit(True)).count() == 0


def plain_cosine(a, b):
    from fractions import Fraction

    x, y = ([Fraction(float(v)) for v in z] for z in (a, b))
    dot = sum(p * q for p, q in zip(x, y, strict=True))
    return math.copysign(math.sqrt(dot**2 / (sum(p * p for p in x) * sum(q * q for q in y))), 1 if dot >= 0 else -1)


def test_neighbours_of_odd_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    vecs = [(0, [1e-200, 2e-200]), (1, [1.0, 2.0]), (2, [1e200, 2e200]), (3, [2.0, -1.0]), (4, [5e-324, 0.0]), (5, [1e300, -1e-300]), (6, [-1.0, 0.5])]
    vecs += [(10 + i, rng.normal(size=3).tolist()) for i in range(9)] + [(30, [1.0]), (31, [-2.0]), (32, [4.0])]
    vecs += [(12, rng.normal(size=3).tolist()), (12, rng.normal(size=2).tolist()), (13, vecs[8][1]), (13, vecs[8][1]), (40, [1.0, 2.0, 3.0, 4.0])]
    vecs += [(50, v) for v in rng.normal(size=(12, 2)).tolist()] + [(51, [0.3, 0.4]), (52, [0.3, 0.4])]
    df = spark.createDataFrame([(i, v, 1, 2, 3) for i, v in vecs], "vec_id long, embedding array<double>, size int, rank int, cell int")
    got = {}
    for r in ann.search(df, F.lit(True), 5, share=1.0).collect():
        assert r.rank not in got.setdefault(r.query_id, {})
        got[r.query_id][r.rank] = (r.vec_id, r.score)
    for q in {i for i, _ in vecs}:
        best = {}
        for i, v in vecs:
            for a in (w for j, w in vecs if j == q):
                if i != q and len(a) == len(v):
                    best[i] = max(best.get(i, -2), plain_cosine(a, v))
        own = [got.get(q, {})[k + 1] for k in range(len(got.get(q, {})))]
        assert len(own) == min(5, len(best))
        assert all(s == pytest.approx(best[i], abs=1e-15) for i, s in own)
        assert [s for _, s in own] == sorted((s for _, s in own), reverse=True)
        assert all(best[i] <= own[-1][1] + 1e-15 for i in best if i not in {k for k, _ in own})


# Pipeline.


def test_pipeline_stages_keep_columns_and_pack_what_is_left(spark, tmp_path):
    import corpus_pipeline as p

    sf = str(tmp_path)
    texts = corpus(12, 60)
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(0, 1, 0), (1, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    now = docs
    for _, stage in p.STAGES[:-1]:
        now = stage(spark, now, sf)
        assert now.columns == docs.columns
        now = spark.createDataFrame(now.collect(), docs.schema)
    tokenizer = bpe.encoder(bpe.default_path()).tokenizer
    want = sum(len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in now.collect())
    got = p.run(spark, sf).collect()
    assert sum(r.length for r in got) == want
    assert {r.doc_id for r in got} == {r.doc_id for r in now.collect()}


# Samples.


@pytest.mark.parametrize("exponent", range(13))
def test_a_slice_of_any_number_of_rows_holds_about_as_many_as_wanted(exponent):
    for n in (10**exponent, 7 * 10**exponent):
        for k, most in ((1, 1.0), (500, 0.75), (3000, 1.0)):
            (a, b), (c, d) = (slice_of(n, k, part, most) for part in (0, 1))
            assert a == -1 and b > 0 and c == b and d >= c
            want = min(k, most * n)
            assert abs((b - a) / 2**63 * n - want) <= 1e-6 * want + 1


def test_samples_are_bounded_whatever_repeats(spark, docs):
    rows = spark.range(20000).selectExpr("cast(if(id % 3 = 0, null, id) as long) as doc_id", "if(id % 3 = 0, 'same', cast(id as string)) as text", "cast(id % 2 as int) as label")
    counts = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    parts = [sampled(rows, "label", counts, 100, ["doc_id", "text"], part).collect() for part in (0, 1)]
    for part in parts:
        assert all(0 < n <= 200 for n in Counter(r.label for r in part).values())
    assert not {r.doc_id for r in parts[0]} & {r.doc_id for r in parts[1] if r.doc_id is not None}
    assert sampled(rows, "label", counts, 10**6, ["doc_id", "text"]).count() == 20000


def test_letters_decide_what_is_undetermined(spark):
    df = spark.createDataFrame([(i, " ".join(["der die und"] * (1 + i % 5)), "de") for i in range(80)], "doc_id long, text string, lang string")
    model = langid.fit_on(df, F.lit(True))
    odd = ["½ ²", "①", "Ⅷ 12", "_", "١٢٣", "ª", "字", "é", "ʰ"]
    got = {r.doc_id: r.lang_pred for r in langid.identify(spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string"), model).collect()}
    import unicodedata

    assert {odd[i] for i, p in got.items() if p == "und"} == {t for t in odd if not any(unicodedata.category(c).startswith("L") for c in t)}


def test_centroid_cosines_equal_plain_ones(spark):
    texts = [t for t in corpus(9, 12) if t and len(t) < 2000][:14]
    langs = ["aa" if i % 2 else "bb" for i in range(len(texts))]
    counts = np.stack([langid.ngram_counts(t) for t in texts]).astype(np.float32)
    model = langid.fit(counts, langs, clusters=3)

    def plain_counts(text):
        raw = [c if 97 <= c <= 122 or c >= 128 else 32 for c in f" {text.lower()} ".encode()]
        line = [c for i, c in enumerate(raw) if i == 0 or c != 32 or raw[i - 1] != 32]
        out = Counter()
        for n in (1, 2, 3):
            for i in range(len(line) - n + 1):
                gram = sum(c << 8 * (n - 1 - j) for j, c in enumerate(line[i : i + n]))
                out[((gram + (n << 24)) * 2654435761 % 2**32) >> 20] += 1
        return out

    own = [plain_counts(t) for t in texts]
    assert [{i: int(n) for i, n in enumerate(c) if n} for c in counts] == own
    df = Counter(k for c in own for k in c)
    idf = {k: math.log((1 + len(own)) / (1 + n)) + 1 for k, n in df.items()}
    for c, found in zip(own, model.cosines(model.vector(counts)), strict=True):
        x = {k: math.log1p(n) * idf[k] for k, n in c.items()}
        size = math.sqrt(sum(v * v for v in x.values()))
        for lang, cos in zip(model.languages, found, strict=True):
            centres = [v for v, o in zip(model.vectors, model.owner, strict=True) if model.languages[o] == lang]
            assert max(sum(w * v[k] for k, w in x.items()) / size for v in centres) == pytest.approx(float(cos), abs=1e-4)


def test_written_tables_leave_the_session_as_it_was(spark):
    before = spark.conf.get(common.FREE_SHUFFLES, None)
    df = spark.range(100).withColumn("k", F.col("id") % 7).groupBy("k").agg(F.count("*").alias("n"))
    made = common.Written(df, "freed")
    assert spark.conf.get(common.FREE_SHUFFLES, None) == before
    assert sorted(map(tuple, made.df.collect())) == sorted(map(tuple, df.collect()))
    assert sorted(map(tuple, common.Written(df, "freed").df.collect())) == sorted(map(tuple, df.collect()))  # the same plan again, its shuffle long gone
    with pytest.raises(Exception, match="deliberate"):
        common.Written(df.select(F.raise_error(F.lit("deliberate")).alias("x")), "freed")
    assert spark.conf.get(common.FREE_SHUFFLES, None) == before
