"""Exact dedup, the filter audit and spelling variants against brute force and DuckDB."""

import random
import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import decontamination, exact_dedup, filter_audit, queries, sharding, spelling
from tallyloom.llm.scratch import new_folder, staged

SCHEMA = "doc_id long, text string, source string, n long, row long, digest string, part string, mask int, key string, word string, first_id long"


def frame(spark, rows, parts=5):
    """Rows (doc_id, source, text) beside columns with names that the operators use inside."""
    return spark.createDataFrame([(d, t, s, 1, 2, "d", "p", 3, "k", "w", 4) for d, s, t in rows], SCHEMA).repartition(parts)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    base = [" ".join("".join(rng.choices(["th", "er", "on", "é", "AN", "#"], k=3)) for _ in range(rng.choice([3, 60, 80, 400]))) for _ in range(40)]
    texts = [*base, *base[:9], base[0].replace(" ", "\t\n "), None, "", " ", "\n\t", "\x85 a\xa0b", "HELLO " * 70, "w1 " * 30_000, base[1], base[1]]
    ids = [*rng.sample(range(900), len(texts) - 5), 7, 7, None, None, None]
    rows = [(d, rng.choice(["a", "b", "", None]), t) for d, t in zip(ids, texts, strict=True)]
    return [*rows, (5000, "a", base[2]), (5000, "a", base[2]), (4000, "hot", "same"), *[(4001 + k, "hot", "same") for k in range(60)]]


def test_exact_dedup(spark, rows):
    got = sorted(map(str, map(tuple, exact_dedup.deduplicated(frame(spark, rows)).collect())))
    assert got == sorted(map(str, exact_dedup.brute_force([(d, t) for d, _, t in rows])))


@pytest.mark.parametrize("batches", [1, 4])
def test_exact_dedup_batches(spark, rows, batches):
    want = sorted(map(str, exact_dedup.brute_force([(d, t) for d, _, t in rows])))
    assert sorted(map(str, map(tuple, exact_dedup.deduplicated(frame(spark, rows), batches).collect()))) == want


def test_exact_dedup_empty(spark):
    assert exact_dedup.deduplicated(frame(spark, []).limit(0)).count() == 0
    got = exact_dedup.deduplicated(frame(spark, [(None, "s", "x"), (None, "s", "x")])).collect()
    assert sorted(r.kept for r in got) == [False, True] and {r.keep_id for r in got} == {None}


def test_index_persists(spark):
    path = new_folder(spark, "test-index")
    one = frame(spark, [(5, "s", "a b"), (6, "s", "c"), (7, "s", "a\tb")])
    index = exact_dedup.DigestIndex(spark, path, 3)
    assert sorted(r.doc_id for r in exact_dedup.new_documents(one, index, "one").collect()) == [5, 6]
    # a batch that comes again adds nothing and keeps the same rows
    assert sorted(r.doc_id for r in exact_dedup.new_documents(one, index, "one").collect()) == [5, 6]
    assert index.rows().count() == 2
    spark.sql(f"DROP TABLE {index.name}")  # as in a session that has not seen the index yet
    again = exact_dedup.DigestIndex(spark, path, 99)
    assert again.buckets == 3 and again.rows().count() == 2
    two = frame(spark, [(1, "s", "a b"), (2, "s", "d"), (6, "s", "c"), (None, "s", "e")])
    kept = exact_dedup.new_documents(two, again, "two")
    assert kept.columns == two.columns
    assert sorted(r.text for r in kept.collect()) == ["d", "e"]
    small = again.compacted(new_folder(spark, "test-index"))
    assert sorted(r.digest for r in small.rows().collect()) == sorted(r.digest for r in again.rows().collect())


def test_index_is_not_shuffled(spark):
    """The anti-join deals the new rows out to the index's buckets and leaves the index where it is."""
    index = exact_dedup.DigestIndex(spark, new_folder(spark, "test-index"), 8)
    some = staged(exact_dedup.digests(frame(spark, [(k, "s", str(k)) for k in range(100)])), "rows")
    index.append(some, "0")
    new = exact_dedup._firsts(some).join(index.rows().hint("merge"), "digest", "left_anti")
    plan = new._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") == 1


def test_filter_audit(spark, rows):
    rng = random.Random(3)
    labels = {d: (rng.randint(0, 1), rng.randint(0, 1)) for d, _, _ in rows if d is not None and rng.random() < 0.6}
    said = [(d, q, t) for d, (q, t) in labels.items()] + [(None, 1, 1), (999_999, 1, 1), (next(iter(labels)), 0, 0)]
    table = spark.createDataFrame(said, "doc_id long, quality int, toxic int")
    got = filter_audit.audited(frame(spark, rows), table).collect()
    want = filter_audit.brute_force(rows, labels)
    assert len(got) == len(want)
    assert {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in got} == want


def test_filter_audit_empty(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audited(frame(spark, []).limit(0), labels).count() == 0
    got = filter_audit.audited(frame(spark, [(None, None, None)]), labels).collect()
    assert len(got) == 600 and all(r.part == "" and r.good_lost == 0 for r in got)
    assert {r.removed for r in got if r.filter_order[r.step - 1] == "A"} == {1}


@pytest.mark.parametrize("name", ["op11_exact_dedup", "op12_filter_interaction_audit"])
def test_new_sql(spark, rows, tmp_path, name):
    """Query and SQL agree on odd rows too."""
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(d, d % 2, d % 3 == 0) for d, _, _ in rows if d], "doc_id long, quality int, toxic boolean").select("doc_id", "quality", F.col("toxic").cast("int")).write.parquet(f"{tmp_path}/labels.parquet")
    db = duckdb.connect()
    for t in ("documents", "labels"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    want = db.execute(queries.SQL[name])
    columns = sorted(c[0] for c in want.description)
    lines = sorted(str(tuple(dict(zip([c[0] for c in want.description], r, strict=True))[c] for c in columns)) for r in want.fetchall())
    assert sorted(str(tuple(r)) for r in queries.QUERIES[name](spark, str(tmp_path)).select(columns).collect()) == lines


def spelled(rng, n, alphabet):
    """Words of few letters, many of them near each other, in texts that repeat them."""
    base = ["".join(rng.choices(alphabet, k=rng.randint(5, 9))) for _ in range(n)]
    out = []
    for w in base:
        out += [w] * rng.choice([3, 5, 6, 30, 200])
        for _ in range(3):
            at = rng.randrange(len(w))
            new = rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice(alphabet) + w[at:], w[:at] + rng.choice(alphabet) + w[at + 1 :]])
            out += [new.upper() if rng.random() < 0.1 else new] * rng.choice([1, 5, 7, 40])
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("seed, alphabet", [(1, "ab"), (2, "aé"), (3, "abcdefgh"), (4, "abcñ÷ÿÀ"), (5, "aaab")])
def test_spelling(spark, seed, alphabet):
    rng = random.Random(seed)
    words = spelled(rng, 60, alphabet)
    size = len(words) // 20
    texts = [" , ".join(words[k : k + size]) for k in range(0, len(words), size)]
    rows = [(k, "s", t) for k, t in enumerate(texts)] + [(None, "s", "banana " * 5), (3, "s", None), (4, "s", ""), (4, "s", texts[0]), (4, "s", texts[0])]
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.grouped(frame(spark, rows)).collect()}
    want = spelling.brute_force([(d, t) for d, _, t in rows])
    assert len(want) > 30 and got == want


def test_spelling_chain_and_empty(spark):
    """a form's form is followed to the last one; a table without words gives none."""
    words = [("abcdefg", 5), ("abcdefh", 25), ("abcdeih", 125), ("abcdjih", 625), ("zzzzzz", 4), ("yyyyyy", 5)]
    rows = [(10**9, "s", " ".join(w for w, n in words for _ in range(n)))]
    want = spelling.brute_force([(d, t) for d, _, t in rows])
    assert want["abcdefg"][1] == "abcdjih" and "zzzzzz" not in want
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.grouped(frame(spark, rows)).collect()} == want
    assert spelling.grouped(frame(spark, [(1, "s", None), (2, "s", "")])).count() == 0


def hashed(tokens):
    return np.array([hash((t, 17)) & (2**64 - 1) for t in tokens], np.uint64)


@pytest.mark.parametrize("letters", [1, 2, 3, 4, 6])
def test_tiling_is_longest_first(letters):
    rng = random.Random(letters)
    for _ in range(2000):
        item, doc = ([rng.randrange(letters) for _ in range(rng.randint(0, n))] for n in (40, 60))
        least = rng.choice([1, 2, 5])
        assert decontamination.tile(hashed(item), hashed(doc), least) == decontamination.brute_tile(item, doc, least)


def test_tiling_of_long_runs():
    """A token many times over pairs no places, and a long document only costs where it shares something."""
    began = time.process_time()
    assert decontamination.tile(hashed([1] * 2000), hashed([1] * 20_000)) == [(2000, 0, 0)]
    assert decontamination.tile(hashed([1, 2] * 1000), hashed([1] * 20_000)) == []
    doc = [k % 5000 for k in range(400_000)]
    assert decontamination.tile(hashed(list(range(100, 160))), hashed(doc)) == [(60, 0, 100)]
    assert time.process_time() - began < 5


@pytest.mark.parametrize("seed, shards, slack", [(1, 8, 0.002), (2, 3, 0.05), (3, 5, 0.0), (4, 1, 0.1)])
def test_sharding_by_replay(spark, seed, shards, slack):
    """Every round, quota and tie as plain loops have them: the same number of each group in the same shards, documents alone where they belong."""
    rng = random.Random(seed)
    texts = [None, ""] + [f"text {k} " + "é" * rng.randrange(60) for k in range(90)]
    rows = [(i, rng.choice(texts[: rng.choice([3, 20, 92])])) for i in range(700)] + [(1000 + i, f"alone {i} " + "z" * rng.randrange(80)) for i in range(150)]
    got = sharding.assigned(frame(spark, [(d, "s", t) for d, t in rows]), shards, slack).select("doc_id", "shard").collect()
    text, count = dict(rows), {}
    for r in got:
        key = (text[r.doc_id] or "", r.shard)
        count[key] = count.get(key, 0) + 1
    assert count == sharding.brute_force(rows, shards, slack)
