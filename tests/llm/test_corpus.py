"""Every operator against a brute-force version, the library it must agree with, or held-out labels."""

import base64
import collections
import cProfile
import gc
import hashlib
import math
import random
import tracemalloc
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from tallyloom.llm import (
    byte_bpe, components, decontamination, exchange, maxent_lm, near_copies, quality_gam, quality_rules, sharding, simhash, substring_dedup, suffix_dedup, textblocks, token_files,
)

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, part int, size string, h string, id string, name string"


def prose(rng, n):
    return " ".join("".join(rng.choices(["th", "er", "on", "an", "é", "in", "sch", "ción"], k=rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """Nulls, empty and white texts, a long one, copies, near copies, shared passages, repeats inside a text."""
    rng = random.Random(4)
    base = [prose(rng, rng.randint(3, 150)) for _ in range(30)]
    passage = prose(rng, 60)
    texts = [*base, base[0], base[0], base[3], base[5] + " tail", f"a {base[7]}", f"x {passage} y", f"z {passage} w", f"{passage} {passage}"]
    texts += [None, "", " \t\n ", None, "one", "one two", "\x85a\xa0b", prose(rng, 6000), "A b C d e f. " * 40, "é" * 60, "é" * 60 + "x"]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    return list(zip(ids, texts, strict=True))


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "en", "s", len(t or ""), "k", 1, "z", "h", "i", "n") for d, t in rows], SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows).cache()


def test_quality_rules(spark, docs, rows):
    got = {r.doc_id: r for r in quality_rules.report(docs).collect()}
    assert len(got) == len(rows)
    for d, text in rows:
        text = text or ""
        w = [x.decode() for x in text.encode().split()]
        lines = [x for x in text.split("\n") if x.encode().split()]
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        twice = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)} if len(w) < 1000 else None
        r = got[d]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)))
        if twice is not None:
            assert r.n_repeat_words == len(twice)
            assert r.base_failed == (len(w) < 50 or 100 * len(twice) > 50 * len(w))
        assert not (r.kept and r.base_failed)
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {d for d, r in got.items() if r.kept}


def test_quality_rules_table(spark):
    text = "the of and in to a is it that for " * 20
    words = " ".join(f"{w}{i}" for i, w in enumerate(text.split()))
    good = " ".join(f"the w{i} of" for i in range(40))
    made = frame(spark, [(1, good), (2, words), (3, good.replace(" ", " $$$ ")), (4, good.upper())])
    got = {r.doc_id: r.broken_rules for r in quality_rules.report(made).collect()}
    assert got[1] == "" and "stop_words" in got[2] and "symbols" in got[3] and "capitals" in got[4]


def test_simhash(docs, rows):
    got = sorted(map(tuple, simhash.near_duplicates(docs).collect()))
    assert got == sorted(simhash.brute_force(rows))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_simhash_rows_without_an_id(spark, monkeypatch, seed):
    """Rows without a doc_id link others, and have the component that they link."""
    rng = random.Random(seed)
    prints = [rng.getrandbits(64) for _ in range(6)]
    for _ in range(60):
        prints.append(rng.choice(prints) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    ids = [None if rng.random() < 0.5 else k for k in range(len(prints))]
    prints += [0, 3, 15]
    ids += [1000, None, 1002]
    made = spark.createDataFrame([(d, p - 2**64 if p >= 2**63 else p) for d, p in zip(ids, prints, strict=True)], "doc_id long, print long")
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, width: made)
    got = simhash.near_duplicates(made).collect()
    want = zip(ids, prints, simhash.components_of(ids, prints), strict=True)
    assert sorted(map(str, map(tuple, got))) == sorted(str((d, f"{p:016x}", c)) for d, p, c in want)


def test_simhash_links_every_pair_within_two_bits(spark, monkeypatch):
    monkeypatch.setattr(simhash, "MEMBERS", 4)
    rng = random.Random(1)
    prints = {rng.getrandbits(64) for _ in range(20)}
    for p in list(prints)[:10]:
        for _ in range(8):
            p ^= 1 << rng.randrange(64)
            p ^= 1 << rng.randrange(64)
            prints.add(p)
    prints = sorted(prints)
    named = spark.createDataFrame([(i, p - 2**64 if p >= 2**63 else p) for i, p in enumerate(prints)], "name long, print long")
    got = {r.node: r.component for r in components.component_ids(simhash.links(named)).collect()}
    comp = list(range(len(prints)))
    for _ in prints:
        for i, a in enumerate(prints):
            for j, b in enumerate(prints):
                if (a ^ b).bit_count() <= 2:
                    comp[i] = comp[j] = min(comp[i], comp[j])
    assert {i: c for i, c in enumerate(comp) if comp.count(c) > 1} == got


def test_components_of_a_long_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7)]
    got = {r.node: r.component for r in components.component_ids(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{k: 100 for k in range(100, 160)}}


@pytest.mark.parametrize("width", [35, 3, 1])
def test_substring_dedup(docs, rows, width):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.digest(substring_dedup.removed_words(docs, width)).collect()}
    assert got == substring_dedup.brute_force(rows, width)


@pytest.fixture
def small_parts(monkeypatch):
    """Many parts and buckets for the small tables of these tests."""
    monkeypatch.setattr(exchange, "PART_BYTES", 4000)
    monkeypatch.setattr(exchange, "BUCKET_BYTES", 9000)


def test_substring_dedup_of_many_parts(small_parts, docs, rows):
    test_substring_dedup(docs, rows, 35)


@pytest.mark.parametrize("hot", [1, 2, 64])
def test_suffix_dedup_of_many_parts(small_parts, monkeypatch, docs, rows, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "ORDERED", 300)
    test_suffix_dedup(docs, rows, 50, 20)


@pytest.mark.parametrize("length,gram", [(50, 20), (20, 8), (33, 33)])
def test_suffix_dedup(docs, rows, length, gram):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.digest(suffix_dedup.removed_spans(docs, length, gram)).collect()}
    assert got == suffix_dedup.brute_force(rows, length)


@pytest.mark.parametrize("hot", [2, 64])
def test_suffix_dedup_of_rows_in_another_order(monkeypatch, rows, hot):
    """The task that reads the answers may get its rows in another order than the one that asked."""
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    all_rows = pd.DataFrame([(d, t) for d, t in [*rows, *[(7, t) for _, t in rows]]], columns=["doc_id", "text"]).astype({"doc_id": "int64"})

    def sent(pdf):
        found = suffix_dedup._anchors_of(pdf, 50, 20)
        _, several, order, counts, _ = suffix_dedup._asked(pdf, found, 3)
        chosen = np.sort(order[np.repeat(several, counts)])
        crowded = np.repeat(suffix_dedup._crowded(found, order, counts, hot), counts)
        often = np.empty(len(order), bool)
        often[order] = crowded
        return suffix_dedup.Stretches(pdf, found, chosen, often[chosen], 50, 3)

    one = sent(all_rows)
    assert len(one.texts) > 20
    for seed in range(3):
        other = sent(all_rows.sample(frac=1, random_state=seed).reset_index(drop=True))
        assert [(b, one.payload(x)) for b, x in one.routed] == [(b, other.payload(x)) for b, x in other.routed]


def test_suffix_dedup_makes_no_calls_for_each_string():
    """What a part does in Python grows with its documents, but for the dictionary of stretches, not with its occurrences."""
    rng = random.Random(5)
    lines = [prose(rng, 40) for _ in range(60)]
    pdf = pd.DataFrame([(i, " ".join(rng.sample(lines, 30))) for i in range(40)], columns=["doc_id", "text"])
    found = suffix_dedup._anchors_of(pdf, 50, 20)
    chosen = np.arange(len(found[0]))
    sent = suffix_dedup.Stretches(pdf, found, chosen, np.zeros(len(chosen), bool), 50, 3)
    answers = {b: suffix_dedup._refine(pd.DataFrame({"payload": [sent.payload(x)]}), 50)[0] for b, x in sent.routed}
    counter = cProfile.Profile()
    out = counter.runcall(lambda: list(suffix_dedup._without(pdf, sent, answers, 50)))
    calls = sum(e.callcount for e in counter.getstats())
    want = suffix_dedup.brute_force(list(pdf.itertuples(index=False, name=None)))
    assert {d: (n, r, s, hashlib.sha256(k).hexdigest()) for d, n, r, s, k in out} == want
    assert len(sent.of) > 3000 and calls < len(sent.of) / 2


def test_suffix_dedup_holds_few_bytes_beside_the_text(monkeypatch):
    """The anchors of a part and what is made of them to ask take a few times its text, and texts are put in place few at a time."""
    monkeypatch.setattr(suffix_dedup, "ANCHORED_BYTES", 1 << 14)
    rng = random.Random(6)
    lines = [prose(rng, 60) for _ in range(4000)]
    pdf = pd.DataFrame([(i, " ".join(rng.sample(lines, 4))) for i in range(1500)], columns=["doc_id", "text"])
    size = sum(len(t.encode()) for t in pdf["text"])
    textblocks.powers(textblocks.BASE, 1)

    def peak(f):
        gc.collect()
        tracemalloc.start()
        try:
            return f(), tracemalloc.get_traced_memory()[1] / size
        finally:
            tracemalloc.stop()

    _, times = peak(lambda: suffix_dedup._asked(pdf, suffix_dedup._anchors_of(pdf, 50, 20), 3))
    assert size > 1 << 21 and times < 4
    texts = pa.chunked_array([pdf["text"][:900], pdf["text"][900:]])
    done = ((i, len(t), i % 2, 1, t[5:].encode()) for i, t in pdf.itertuples(index=False, name=None))
    left, times = peak(lambda: suffix_dedup._in_place(done, texts))
    assert times < 1.5
    assert left.to_pylist() == [t[5:] if i % 2 else t for i, t in pdf.itertuples(index=False, name=None)]


def test_suffix_dedup_keeps_columns_and_whole_characters(docs, rows):
    out = suffix_dedup.without_repeats(docs)
    assert out.columns == docs.columns
    got = {r.doc_id: (r.text, r.n_chars) for r in out.collect()}
    want = dict(rows)
    assert got.keys() == want.keys()
    assert all(t is None or n == len(t) for t, n in got.values())
    assert sum(len(t or "") for t, _ in got.values()) < sum(len(t or "") for t in want.values())


def test_suffix_dedup_of_repeated_doc_ids(spark):
    shared = "a passage that is well over fifty bytes long, and that three rows hold alike. "
    rows = [(1, "head " + shared), (2, "first row " + shared + "end one"), (2, "SECOND row " + shared + "end two"), (2, "SECOND row " + shared + "end two"), (None, shared + "x"), (3, None), (4, ""), (5, "nothing shared")]
    out = suffix_dedup.without_repeats(spark.createDataFrame([(*r, 7, "x") for r in rows], "doc_id long, text string, _cut_id int, part string"))
    got = sorted((str(r.doc_id), str(r.text)) for r in out.collect())
    # the null doc_id is the smallest, so that doc 1 loses the passage too
    assert got == sorted([("1", "head "), ("2", "first rowend one"), ("2", "SECOND rowend two"), ("2", "SECOND rowend two"), ("None", shared + "x"), ("3", "None"), ("4", ""), ("5", "nothing shared")])


def test_suffix_dedup_of_very_long_texts(spark):
    rng = np.random.default_rng(5)
    long = bytes(rng.integers(97, 123, 3_000_000).astype(np.uint8)).decode()
    rows = [(1, long), (2, "x" * 60 + long[1_000_000:2_000_000] + "y"), (3, "ab" * 1_000_000)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in suffix_dedup.removed_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (3_000_000, 0, 0), 2: (1_000_061, 1_000_000, 1), 3: (2_000_000, 0, 0)}


@pytest.mark.parametrize("group", [1, 40, 1 << 16])
def test_string_classes(group, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    rng = np.random.default_rng(2)
    for data in (rng.integers(0, 2, 3000).astype(np.uint8), np.zeros(300, np.uint8), np.tile(rng.integers(0, 255, 30).astype(np.uint8), 30)):
        raw = data.tobytes()
        for length in (8, 12, 17, 50):
            starts = np.arange(len(data) - length + 1)
            classes = suffix_dedup.string_classes(data, starts, length)
            pairs = {(raw[i : i + length], int(c)) for i, c in zip(starts, classes, strict=True)}
            assert len({s for s, _ in pairs}) == len({c for _, c in pairs}) == len(pairs)
            order, _ = suffix_dedup.refined_order(data, length, group)
            seen = [raw[i : i + length] for i in order if i + length <= len(raw)]
            assert seen == sorted(seen)


def test_parts_keep_messages_long():
    assert exchange.sizes(0, 200) == (1, 1)
    assert exchange.sizes(500 << 20, 6) == (32, 63)
    parts, buckets = exchange.sizes(1 << 40, 200)
    assert (1 << 40) / parts / 6 / buckets > 1000  # hashes of word windows in a message
    parts, buckets = exchange.sizes(100 << 40, 200)
    assert (100 << 40) / parts <= 64 << 20 and (100 << 40) / parts / 6 / buckets > 10


def test_rows_without_a_doc_id_and_of_one_length_spread_over_parts(spark, small_parts):
    rows = [(None, f"{i:05d} text") for i in range(2000)] + [(1, "the same row")] * 2000
    parts, n, _ = exchange.in_parts(spark.createDataFrame(rows, "doc_id long, text string").repartition(40), "doc_id")
    counts = [r["count"] for r in parts.groupBy("part").count().collect()]
    assert n > 5 and max(counts) < 3 * sum(counts) / n


def _tiktoken():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe(docs, rows):
    library = _tiktoken()
    got = {r.doc_id: r for r in byte_bpe.digest(docs, RANKS).collect()}
    for d, text in rows:
        ids = library.encode_ordinary(text or "")
        assert got[d].n_tokens == len(ids)
        assert got[d].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[d].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_byte_bpe_slices_like_the_library():
    library, coder, rng = _tiktoken(), byte_bpe.codec(RANKS), random.Random(9)
    alphabet = list("abXZ'''  \n\t\r019é中!?.-_$sdtmrevl\x85\xa0\x1c") + ["́", "\U0001f600", " "]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 70))) for _ in range(4000)] + ["a" * 5000, " " * 700, "it's'll're \n\n d"]
    made = [np.frombuffer(x, "<u4") for x in coder.encode(texts)]
    assert [x.tolist() for x in made] == library.encode_ordinary_batch(texts)
    raw, ends = coder.decode(made[-1])
    assert raw == texts[-1].encode() and ends[-1] == len(raw) and len(ends) == len(made[-1])


def test_token_files(docs, rows):
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_files.digest(docs, WORD_BPE).collect()}
    assert got == token_files.brute_force(rows, WORD_BPE)


def test_token_files_roll_over(docs, rows, monkeypatch):
    monkeypatch.setattr(token_files, "FILE_IDS", 300)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_files.digest(docs, WORD_BPE).collect()}
    assert got == token_files.brute_force(rows, WORD_BPE)


@pytest.mark.parametrize("top", [2, 300, 49408, 2**32 - 1])
def test_token_blocks_round_trip(top):
    rng = np.random.default_rng(top)
    for n in (0, 1, 127, 128, 129, 3000):
        ids = rng.integers(0, top, n, dtype=np.uint32)
        ids[::40] = top
        whole = token_files.file_bytes([3, None], [ids[: n // 3], ids[n // 3 :]])
        names, null, sizes = token_files.read_head(whole)
        back = token_files.read_run(whole, 0, n)
        assert null.tolist() == [False, True] and sizes.sum() == n and (back == ids).all() and names[0] == 3
        for a, k in ((0, n), (n // 2, n // 4), (min(n, 130), min(100, max(0, n - 130)))):
            assert (token_files.read_run(whole, a, k) == ids[a : a + k]).all()


def _encoded_by(coder, texts):
    return [x.tolist() for _, ids, sizes in coder.ids(texts) for x in np.split(ids, np.cumsum(sizes)[:-1])]


@pytest.mark.parametrize("cache", [0, token_files.CACHE_BYTES])
def test_tokenizer_never_looks_across_pieces(cache):
    rng, coder = random.Random(6), token_files.Encoder(WORD_BPE, cache)
    assert coder.by_piece
    alphabet = list("abXÀß÷×É'''  \n\t019中!?.sdtmrevlΣİſ_<|>\x1c\x85") + ["́", " ", "<|endoftext|>"]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 40))) for _ in range(3000)]
    texts += ["".join(rng.choices("aBÀßéè÷×.,-01 ", k=30)) for _ in range(3000)]
    want = [[*e.ids, 1] for e in coder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    for _ in range(2):
        assert _encoded_by(coder, texts) == want


def test_other_tokenizers_encode_whole_texts(docs, rows):
    path = public_tokenizers.path("byte_bpe_50k.json")
    coder = token_files.Encoder(path)
    texts = [t or "" for _, t in rows]
    assert not coder.by_piece
    assert _encoded_by(coder, texts) == [[*e.ids, 1] for e in coder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_files.digest(docs, path).collect()}
    assert got == token_files.brute_force(rows, path)


def test_sharding(spark, docs, rows):
    got = sharding.assigned(docs).toPandas()
    assert len(got) == len(rows)
    text = dict(rows)
    for r in got.itertuples():
        raw = (text[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
    for _, x in got.groupby("shard"):
        assert sorted(x["slot"]) == list(range(len(x)))
    loads = got.groupby("shard")["size"].sum().reindex(range(8), fill_value=0)
    assert loads.max() - loads.min() <= 2 * got["size"].max()


def _cut(got, column="shard"):
    return int((got.groupby(["text_crc32", "size"])[column].nunique() > 1).sum())


def test_sharding_joins_groups_and_splits_what_does_not_fit(spark):
    pairs = [(i, f"text {i // 2} " + "x" * (i // 2 % 40)) for i in range(4000)]
    alone = [(5000 + i, f"alone {i} " + "y" * (i % 50)) for i in range(1500)]
    hot = [(10_000 + i, "hot " * 20) for i in range(2500)]
    for rows, most in ((pairs + alone + hot, 1), (pairs, 60), (pairs + hot, 60)):
        got = sharding.assigned(frame(spark, rows).repartition(3)).toPandas()
        loads = got.groupby("shard")["size"].sum()
        assert len(loads) == 8 and loads.max() / loads.mean() < 1.01
        # nearly every group is cut before the first round, hardly any after the last
        assert _cut(got, "first_shard") > 1600 and _cut(got) <= most
        assert (got["shard"] != got["first_shard"]).sum() > 1500


def test_sharding_does_not_depend_on_input_splits(spark):
    rows = [(i, f"text {i // 3}") for i in range(900)] + [(None, "a"), (7, "text 2")]
    got = [{tuple(r)[:5] for r in sharding.assigned(frame(spark, rows).repartition(n)).drop("slot").collect()} for n in (1, 6)]
    assert got[0] == got[1]


def test_sharding_of_a_small_graph(spark):
    """Three groups of three and three documents alone fit three shards uncut."""
    rows = [(3 * g + i, "abc"[g] * 9) for g in range(3) for i in range(3)] + [(20 + i, "alone"[i:] + "-" * (4 + i)) for i in range(3)]
    got = sharding.assigned(frame(spark, rows), shards=3, slack=0.2).toPandas()
    assert _cut(got) == 0 and got.groupby("shard").size().tolist() == [4, 4, 4]


def test_decontamination(spark, docs, rows):
    rng = random.Random(8)
    items = [(k, prose(rng, 30)) for k in range(12)] + [(50, "too short"), (51, None), (52, "")]
    text = dict(items)
    w = text[2].split()
    leaks = [(900, f"start {text[0]} end"), (901, "".join(c.upper() if c.isascii() else c for c in text[1]).replace(" ", ", ")), (902, " ".join(w[15:] + ["between"] + w[:15])), (903, " ".join(text[3].split()[:20]))]
    made = frame(spark, rows + leaks)
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    pairs = {(r.doc_id, r.item_id, r.covered_tokens) for r in decontamination.contaminated(made, bench).collect()}
    short = rows + leaks  # documents of every length
    assert pairs == decontamination.brute_force(short, items)
    assert {p[:2] for p in pairs} == {(900, 0), (901, 1), (902, 2)}
    kept = decontamination.without_leaks(made, bench)
    assert kept.columns == made.columns and kept.count() == len(rows) + 1


def _odd_benchmark(spark):
    items = [(None, "an item without any id at all but ten tokens"), (7, "one of two items that share their id seven"), (7, "the other of two items that share their id"), (8, None), (9, ""), (10, "too few tokens here"), (11, "Repeated row of the benchmark, given twice."), (11, "Repeated row of the benchmark, given twice.")]
    return spark.createDataFrame([(*x, "x") for x in items], "item_id long, text string, doc_id string"), items


@pytest.mark.parametrize("block", [200, 16 << 20])
def test_decontamination_of_odd_rows_and_any_block(spark, monkeypatch, block):
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", block)
    benchmark, items = _odd_benchmark(spark)
    docs = [(i, f"before {t} after", i) for i, (_, t) in enumerate(items) if t] + [(None, "so AN ITEM, without any id at all: but ten tokens", 1), (0, "clean words under an id that another row shares", 2), (50, None, 3), (51, "", 4)]
    long = " ".join(f"w{i}" for i in range(300_000)) + " one of two items that share their id seven"
    frame = spark.createDataFrame([*docs, (60, long, 5)], "doc_id long, text string, item_id int")
    got = [(r.doc_id, r.item_id) for r in decontamination.contaminated(frame, benchmark).collect()]
    want = [(0, None), (1, 7), (2, 7), (6, 11), (7, 11), (None, None), (60, 7)]
    assert sorted(map(str, got)) == sorted(map(str, want))
    kept = decontamination.without_leaks(frame, benchmark)
    assert kept.columns == frame.columns
    clean = [(0, "clean words under an id that another row shares"), (5, "before too few tokens here after"), (50, None), (51, "")]
    assert sorted(str((r.doc_id, r.text)) for r in kept.collect()) == sorted(map(str, clean))


def test_quality_model_scores_as_its_tables_add_up():
    rng = np.random.default_rng(8)
    x = rng.random((1500, 4)).astype(np.float32)
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)  # nothing but an interaction of two features
    model = quality_gam.fit(x, y)
    for row, score in zip(x[:200], model.score(x[:200]), strict=True):
        bins = [int(sum(v >= e for e in edges)) for v, edges in zip(row, model.edges, strict=True)]
        odds = model.base + sum(t[b] for t, b in zip(model.tables, bins, strict=True))
        odds += sum(t[bins[i] * quality_gam.PAIR_BINS // quality_gam.BINS, bins[j] * quality_gam.PAIR_BINS // quality_gam.BINS] for i, j, t in model.pairs)
        assert score == pytest.approx(1 / (1 + math.exp(-odds)), rel=1e-6)
    assert ((model.score(x) >= 0.5) == (y > 0)).mean() > 0.9
    assert {(0, 1), (1, 0)} & {(i, j) for i, j, _ in model.pairs}


def test_quality_trees_cut_where_brute_force_does():
    rng = np.random.default_rng(9)
    for _ in range(20):
        g, h = rng.normal(size=8), rng.random(8)
        value = quality_gam._tree(g, h, leaves=2)
        gain = lambda a, b: g[a:b].sum() ** 2 / (h[a:b].sum() + 1)
        best = max(range(1, 8), key=lambda c: gain(0, c) + gain(c, 8))
        if gain(0, best) + gain(best, 8) <= gain(0, 8) + 1e-6:
            best = 8
        parts = [(0, best), (best, 8)]
        assert all(np.allclose(value[a:b], g[a:b].sum() / (h[a:b].sum() + 1)) for a, b in parts)


def test_quality_features_count_what_they_say():
    text = "The cat THE cat, ran!\nran ran 12% é\n\nThe cat THE cat, ran!"
    f = dict(zip(quality_gam.FEATURES, quality_gam.features([None, text, ""])[1], strict=True))
    words = text.lower().split()
    raw = text.encode()
    assert f["log_words"] == pytest.approx(math.log1p(len(words))) and f["lines"] == pytest.approx(3 / len(words))
    assert f["word_length"] == pytest.approx(sum(len(w.encode()) for w in words) / len(words)) and f["longest_word"] == 4
    assert f["symbols"] == pytest.approx(1 / len(raw)) and f["digits"] == pytest.approx(2 / len(raw)) and f["marks"] == pytest.approx(2 / len(raw))
    assert f["capitals"] == pytest.approx(sum(c.isupper() for c in text if c < "\x80") / len(raw)) and f["beyond_ascii"] == pytest.approx(2 / len(raw))
    assert f["distinct_words"] == pytest.approx(len(set(words)) / len(words)) and f["repeated_lines"] == pytest.approx(1 / 3)
    assert f["doubled_words"] == pytest.approx(sum(a == b for a, b in zip(words, words[1:], strict=False)) / len(words))
    triples = list(zip(words, words[1:], words[2:], strict=False))
    assert f["distinct_triples"] == pytest.approx(len(set(triples)) / len(triples))


def test_quality_training_takes_one_row_of_a_doc_id(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(200)] + [(2, "good words"), (3, "bad # #")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in (1, 2, 3, 4, 6)], "doc_id long, quality int")
    got = quality_gam.classified(docs, labels).collect()
    assert len(got) == 202 and all(0 <= r.score <= 1 for r in got)


def test_quality_classifier(spark, testdata):
    d = f"{testdata}/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    got = quality_gam.classified(spark.read.parquet(f"{d}/documents.parquet"), labels).toPandas()
    held = got.merge(labels.toPandas(), on="doc_id").query("held_out")
    assert (held.predicted == held.quality).mean() > 0.98
    assert got.score.between(0, 1).all()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got.itertuples())


def test_quality_classifier_odd_input(spark, docs, rows):
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 0), (1, None, 0), (None, 1, 1), (5000, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality_gam.classified(docs, labels).count() == len(rows)
    none = quality_gam.classified(docs, labels.where("false")).toPandas()
    assert none.score.round(6).eq(0.5).all()


def test_language_model(docs, rows):
    got = {r.doc_id: r for r in maxent_lm.scores(docs).collect()}
    for d, want in maxent_lm.brute_force(rows).items():
        r = got[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == want[:4]
        assert math.isclose(r.base_score, want[4], rel_tol=1e-9) and r.score < 0


def test_language_model_beats_counts_on_held_out_documents(spark, testdata):
    got = maxent_lm.scores(spark.read.parquet(f"{testdata}/sf0.01/documents.parquet")).where("held_out").toPandas()
    assert got.score.sum() > got.base_score.sum() * 0.99 and (got.score > got.base_score).mean() > 0.9


def test_language_model_score_follows_from_its_weights(spark, docs, rows):
    """Every token by plain loops over the kinds, whose probabilities sum to one."""
    named = docs.select("doc_id", "text", (F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(10)) == 0).alias("held_out"))
    parts, _, buckets = exchange.in_parts(named, "doc_id", "held_out")
    _, model, room, all_tokens, _ = maxent_lm._learned(named, parts, buckets)
    assert model.outer.any() and model.inner.any() and model.rows >= maxent_lm.LEAST_ROWS
    got = {r.doc_id: r.score for r in maxent_lm.scores(docs).collect()}
    split = {d: bytes(textblocks.LOWER[np.frombuffer(textblocks.encoded(t), np.uint8)]).split() for d, t in rows}
    counts = collections.Counter(w for d, words in split.items() if zlib.crc32(str(d).encode()) % 10 for w in words)
    kinds = {}
    for w in {w for words in split.values() for w in words}:
        _, _, h, _, ending = next(maxent_lm._tokens([w.decode("utf-8")]))
        kinds[w] = int(model.kinds(h, ending)[0])
    mass = collections.Counter()
    for w, c in counts.items():
        mass[kinds[w]] += c + maxent_lm.SMOOTH
    for kind, m in mass.items():
        if kind < maxent_lm.END_ENDING:  # what is left is for tokens never seen
            assert m + maxent_lm.SMOOTH == pytest.approx(10 ** room[kind])
        else:
            assert sum(kinds[w] == kind for w in counts) == 1

    def softmax(table, rows):
        z = [sum(float(table[r, k]) for r in rows) for k in range(maxent_lm.CLASSES)]
        top = sum(math.exp(x) for x in z)
        return [math.exp(x) / top for x in z]

    for d, words in list(split.items())[:25]:
        total, before = 0.0, [maxent_lm.END_ENDING] * 3
        for w in [*words[:60], None] if len(words) <= 60 else []:
            kind = maxent_lm.END_ENDING if w is None else kinds[w]
            history = maxent_lm.histories(np.array([*before, kind]), np.array([0, 4]))[3:]
            of = model.class_of[kind : kind + 1]
            classes = softmax(model.outer, model.features(history)[0])
            inner = softmax(model.inner, model.features(history, of)[0])
            assert sum(classes) == pytest.approx(1) and sum(inner) == pytest.approx(1)
            total += math.log10(classes[of[0]] * inner[model.inner_of[kind]])
            if w is not None and kind < maxent_lm.END_ENDING:
                total += math.log10(counts[w] + maxent_lm.SMOOTH) - room[kind]
            before = [*before[1:], kind]
        if len(words) <= 60:
            assert got[d] == pytest.approx(total, rel=1e-4)


def test_language_model_learns_what_follows_what(spark):
    """The likelier of two tokens of one count is told by the history alone."""
    rng = random.Random(1)
    rows = [(i, " ".join(x for _ in range(60) for x in rng.choice([("salt", "pepper"), ("hammer", "nail")]))) for i in range(3000)]
    rows += [(10_000, "salt pepper " * 5), (10_001, "salt nail " * 5), (10_002, "hammer nail " * 5), (10_003, "hammer pepper " * 5)]
    got = {r.doc_id: r for r in maxent_lm.scores(frame(spark, rows)).collect()}
    for good in (10_000, 10_002):
        assert all(got[good].score > got[bad].score + 3 for bad in (10_001, 10_003))
    assert got[10_000].score > got[10_000].base_score + 1


def test_language_model_update_follows_from_plain_sums(monkeypatch):
    """Also with more rows than 16 bits hold, and weights so far apart that one shift would not do; one exponential a weight."""
    rng = np.random.default_rng(3)
    n, rows, width = 700, 1 << 17, maxent_lm.CLASSES
    features = np.stack([rng.integers(0, high, n) for high in (3, 40, rows - 1, rows - 1)] + [np.full(n, rows - 1)], axis=1).astype(np.int32)
    wanted = rng.integers(0, width, n)
    for spread in (1, 60):
        weights = rng.normal(size=(rows, width)).astype(np.float32) * np.float32(spread)
        trainer, exponentials, exp = maxent_lm.Trainer(weights), [], np.exp
        with monkeypatch.context() as patch:
            patch.setattr(np, "exp", lambda x, *a, **k: exponentials.append(np.size(x)) or exp(x, *a, **k))
            trainer.update(features, wanted)
        assert sum(exponentials) == n * width
        z = weights[features].astype(np.float64).sum(axis=1)
        error = np.exp(z - z.max(axis=1, keepdims=True))
        error /= error.sum(axis=1, keepdims=True)
        error[np.arange(n), wanted] -= 1
        grad, met = np.zeros((rows, width)), np.zeros(rows)
        for k in range(features.shape[1]):
            np.add.at(grad, features[:, k], error)
            np.add.at(met, features[:, k], 1)
        grad /= np.sqrt(np.maximum(met, 1))[:, None]
        want = weights - maxent_lm.RATE * grad / np.sqrt(1e-4 + (grad**2).sum(axis=1))[:, None]
        assert (trainer.met == met).all() and np.abs(trainer.weights - want).max() < 1e-3


def test_language_model_learns_from_one_hash_a_token(monkeypatch):
    """The second hash deals tokens to buckets; only counting and scoring ask for it."""
    text = ["salt pepper salt", None, "hammer nail"]
    _, bounds, h, other, ending = next(maxent_lm._tokens(text))
    seeds, word_hashes = [], textblocks.word_hashes
    monkeypatch.setattr(textblocks, "word_hashes", lambda block, spans, seed=0: seeds.append(seed) or word_hashes(block, spans, seed))
    _, same_bounds, same_h, same_ending = next(maxent_lm._tokens(text, seeds=(0,)))
    assert seeds == [0] and (same_bounds == bounds).all() and (same_h == h).all() and (same_ending == ending).all()
    vocabulary = maxent_lm._Vocabulary(pd.DataFrame({"text": text}), 4)
    assert (vocabulary.values == np.unique(h)).all() and (vocabulary.spread(vocabulary.values) == h).all()
    assert (vocabulary.counts(np.ones(len(h), bool)) == np.unique(h, return_counts=True)[1]).all()
    assert (vocabulary.spread(vocabulary.endings) == ending).all()
    assert sorted(i for _, x in vocabulary.routed for i in x) == list(range(len(vocabulary.values)))
    assert all((other[np.isin(h, vocabulary.values[x])] % np.uint64(4) == b).all() for b, x in vocabulary.routed)


def test_packed_messages():
    rng = np.random.default_rng(1)
    for values in (np.zeros(0, np.uint64), np.array([7], np.uint64), np.array([0, 2**64 - 1], np.uint64), np.sort(rng.integers(0, 2**63, 999, dtype=np.uint64))):
        assert (exchange.unpack(exchange.pack(values)) == values).all()


def test_word_hashes_follow_the_words():
    blocks = list(textblocks.blocks(["ab cd", None, " cd\tab\n", "é cd"], target=4))
    seen = {}
    for b in blocks:
        spans = textblocks.words(b)
        for a, z, h in zip(spans.starts, spans.ends, textblocks.word_hashes(b, spans), strict=True):
            seen.setdefault(b.data[a:z].tobytes(), set()).add(int(h))
    assert set(seen) == {b"ab", b"cd", "é".encode()} and all(len(x) == 1 for x in seen.values())


OPERATORS = {
    "quality": lambda d, s: quality_rules.report(d),
    "simhash": lambda d, s: simhash.near_duplicates(d),
    "substring": lambda d, s: substring_dedup.digest(substring_dedup.removed_words(d)),
    "suffix": lambda d, s: suffix_dedup.digest(suffix_dedup.removed_spans(d)),
    "bpe": lambda d, s: byte_bpe.digest(d, RANKS),
    "files": lambda d, s: token_files.digest(d, WORD_BPE),
    "shards": lambda d, s: sharding.assigned(d),
    "leaks": lambda d, s: decontamination.contaminated(d, s.createDataFrame([(1, "a b c d e f")], "item_id long, text string")),
    "gam": lambda d, s: quality_gam.classified(d, s.createDataFrame([(1, 1)], "doc_id long, quality int")),
    "lm": lambda d, s: maxent_lm.scores(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables_and_repeated_and_null_rows(spark, name):
    assert OPERATORS[name](frame(spark, []), spark).collect() == []
    odd = frame(spark, [(1, "same words here"), (1, "same words here"), (None, None), (None, "same words here"), (2, None)])
    got = OPERATORS[name](odd, spark).collect()
    assert len(got) == (0 if name == "leaks" else 5)


def test_pipeline(spark, testdata):
    d = f"{testdata}/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    kept = {r.doc_id for r in quality_rules.report(spark.read.parquet(f"{d}/documents.parquet")).collect() if r.kept}
    rows = [r for r in rows if r[0] in kept]
    first = near_copies.brute_force(rows)
    rows = [r for r in rows if r[0] in first]
    least = {}
    for i, t in rows:
        raw = t.encode()
        for k in range(len(raw) - 49):
            least[raw[k : k + 50]] = min(i, least.get(raw[k : k + 50], i))
    cut = []
    for i, t in rows:
        raw = t.encode()
        gone = np.zeros(len(raw), bool)
        for k in range(len(raw) - 49):
            if least[raw[k : k + 50]] < i:
                gone[k : k + 50] = True
        cut.append((i, bytes(np.frombuffer(raw, np.uint8)[~gone]).decode("utf-8", "ignore")))
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    leaks = {p[0] for p in decontamination.brute_force(cut, items)}
    library = _tiktoken()
    want = {i: (len(ids := library.encode_ordinary(t)), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()) for i, t in cut if i not in leaks}
    got = {r.doc_id: (r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, d).collect()}
    assert got == want


def test_near_copies_of_similarity_08_go(spark, testdata, monkeypatch):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{testdata}/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    rng = random.Random(3)
    words = [f"w{i}" for i in range(100)]
    for i in range(60):  # a copy with words changed, from far below to far above 0.8
        changed = list(words)
        for k in rng.sample(range(100), i % 6):
            changed[k] = f"x{i}"
        rows.append((10_000 + i, " ".join(changed)))
    rows += [(20_000, ""), (20_001, " \n"), (20_002, "one two"), (20_003, "one  TWO")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = near_copies.brute_force(rows)
    assert {r.doc_id for r in near_copies.keep_first(docs).collect()} == want
    # keys and groups dealt into small blocks
    for name, value in (("MEMBERS", 5), ("FEW", 3), ("HOT", 4), ("KEYED_BYTES", 4000)):
        monkeypatch.setattr(near_copies, name, value)
    assert {r.doc_id for r in near_copies.keep_first(docs).collect()} == want


def test_near_copies_within_two_bits_are_found_by_simhash(spark, monkeypatch):
    """Fingerprints of two bits settle their near copies without the keys of the sets, and only those."""
    rng = random.Random(8)
    base = [prose(rng, 400) for _ in range(12)]
    rows = [(10 * i + k, f"{t} end{k}" if k else t) for i, t in enumerate(base) for k in range(4)]
    rows += [(1000 + i, prose(rng, 300)) for i in range(20)] + [(2000, ""), (2001, None), (2002, "one two")]
    sets = [np.concatenate([np.zeros(0, np.uint64), one]) for one in near_copies._sets(pd.Series([t for _, t in rows]))]
    votes = [int(simhash.majority(one, np.array([len(one)]))[0]) for one in sets]
    full = [k for k, one in enumerate(sets) if len(one)]
    want = simhash.components_of([rows[k][0] for k in full], [votes[k] for k in full])
    stays = {rows[k][0] for k, c in zip(full, want, strict=True) if rows[k][0] == c} | {2000}
    assert 32 < len(stays) < 60 and near_copies.brute_force(rows) <= stays
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    # what the keys of the sets add is left out here
    monkeypatch.setattr(near_copies, "_meetings", lambda few: lambda pdf: pd.DataFrame({"kind": np.zeros(0, np.int32), "a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)}))
    assert {r.doc_id for r in near_copies.keep_first(docs).collect()} == stays
    monkeypatch.undo()
    assert {r.doc_id for r in near_copies.keep_first(docs).collect()} == near_copies.brute_force(rows)


def test_near_copies_that_are_settled_are_not_compared_again():
    sets = [np.arange(k, 200 + k, dtype=np.uint64) for k in range(3)]
    wide = [near_copies.parity([one], near_copies.parity_bits(200))[0] for one in sets]
    sizes, side = np.full(3, 200), np.zeros(3, int)
    assert len(near_copies._possible(wide, sizes, side)) == 2
    assert len(near_copies._possible(wide, sizes, side, np.array([9, 9, 5]))) == 1
    assert near_copies._possible(wide, sizes, side, np.array([9, 9, 9])) == []


def test_near_copies_with_repeats(spark):
    """Repeated words and lines decide nothing: documents of the same words, each with a tail of its own many times."""
    base = " ".join(f"w{i}" for i in range(100))
    rows = [(i, f"{base} " + f"x{i} " * 300) for i in range(8)] + [(20 + i, (f"line {i} of some words\n" * 40) + base) for i in range(6)]
    want = near_copies.brute_force(rows)
    assert len(want) < 5
    assert {r.doc_id for r in near_copies.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == want


@pytest.mark.parametrize("low, high", [(1, 9), (4, 20), (30, 60), (200, 400), (1500, 3000)])
def test_similar_sets_share_a_key(low, high):
    """Pairs exactly at 0.8 and a little over it, of every size: a key in common, a link, a distance within the bound."""
    rng = np.random.default_rng(low)
    for _ in range(300 if high < 1000 else 40):
        a = int(rng.integers(low, high))
        b = int(rng.integers(a, 5 * a // 4 + 1))
        both = -(-4 * (a + b) // 9)
        if both > a:
            continue
        h = rng.integers(0, 2**64, a + b - both, dtype=np.uint64)
        pair = [np.sort(h[:a]), np.sort(np.concatenate([h[:both], h[a:]]))]
        owner, key = near_copies.ring_keys(pair)
        assert set(key[owner == 0].tolist()) & set(key[owner == 1].tolist())
        wide = [near_copies.parity([p], near_copies.parity_bits(len(p)))[0] for p in pair]
        words = min(len(p) for p in wide)
        prints = [near_copies.folded(p, words) for p in wide]
        assert [p.tolist() for p in prints] == near_copies.parity(pair, 64 * words).tolist()
        assert np.bitwise_count(prints[0] ^ prints[1]).sum() <= (a + b) // 9
        assert near_copies._possible(wide, np.array([a, b]), np.zeros(2, int))
        assert near_copies.similar_forest(pair, np.zeros(2, int)) and near_copies.similar_forest(pair, np.array([1, 0]))
        less = [pair[0], np.sort(np.concatenate([pair[1][pair[1] != h[0]], rng.integers(0, 2**64, 1, dtype=np.uint64)]))]
        if 9 * (both - 1) < 4 * (a + b):
            assert not near_copies.similar_forest(less, np.zeros(2, int))


def test_near_copies_of_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(400_000))
    rows = [(1, "a b c d e f"), (1, "quite another text of some words"), (1, "a b c d e f"), (None, "A b c d e f"), (None, None), (5, ""), (6, None), (None, "words that nobody else has at all"), (8, long), (9, long + " x")]
    got = near_copies.keep_first(spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, node int, _gone_id string")).collect()
    assert sorted((str(r.doc_id), (r.text or "")[:20]) for r in got) == sorted(
        [("1", "a b c d e f"), ("1", "a b c d e f"), ("1", "quite another text o"), ("5", ""), ("None", "words that nobody el"), ("8", long[:20])]
    )


def test_token_files_read_the_tokenizer_once_a_worker():
    one, two = token_files.Encoder(WORD_BPE), token_files.Encoder(WORD_BPE)
    assert one.tokenizer is two.tokenizer and one.plain is two.plain and one.keys is not two.keys
