import hashlib
import re
from collections import defaultdict

from pyspark.sql import functions as F

from voxfabric.llm import exact_dedup
from voxfabric.llm.common import marked


def norm(t):
    return re.sub("[\x20\x09-\x0d]+", " ", t or "")


def brute(rows):
    """Per row: keep_id, group_size, kept, hash; a null id counts as the largest; one of several rows of the same id and text is kept."""
    groups = defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append(i)
    out, had = [], set()
    for i, t in rows:
        ids = groups[norm(t)]
        keep = min((j for j in ids if j is not None), default=None)
        kept = i == keep and (i, norm(t)) not in had
        had.add((i, norm(t)))
        out.append((str(i), str(keep), len(ids), kept, hashlib.sha256(norm(t).encode()).hexdigest()))
    return out


ROWS = [(1, "a b c"), (7, "a  b\nc"), (7, "something else here"), (3, None), (4, ""), (5, " "), (None, "a b c"), (None, "alone"), (9, "x " * 40_000), (8, "x " * 40_000), (2, "é"), (2, "é"), (None, "alone"), *[(6, "again")] * 40, *[(100 + i, "many") for i in range(300)]]


def frame(spark, rows):
    return spark.createDataFrame([(*x, 1, "c") for x in rows], "doc_id long, text string, key int, norm string").repartition(5)


def test_against_brute_force(spark):
    got = exact_dedup.exact_groups(frame(spark, ROWS)).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept, r.text_sha256) for r in got) == sorted(brute(ROWS))


def test_colliding_hashes(spark, monkeypatch):
    """With one key for all texts, the comparison of bytes alone tells them apart."""
    monkeypatch.setattr(exact_dedup.F, "md5", lambda c: F.lit("same"))
    got = exact_dedup.exact_groups(frame(spark, ROWS)).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept, r.text_sha256) for r in got) == sorted(brute(ROWS))


def test_drop_keeps_other_rows_of_an_id(spark):
    df = frame(spark, ROWS)
    got = exact_dedup.drop_exact_copies(df)
    assert got.columns == df.columns
    stay = [(str(i), t or "") for (i, t), b in zip(ROWS, brute(ROWS)) if b[3]]
    assert sorted((str(r.doc_id), r.text or "") for r in got.collect()) == sorted(stay)
    assert exact_dedup.drop_exact_copies(df.limit(0)).collect() == []


def test_one_of_repeated_rows_stays_whole(spark):
    """The first by content, with all its columns, maps among them."""
    df = spark.createDataFrame([(1, "t", {"a": 2}), (1, "t", {"a": 1}), (1, " t", {"a": 0}), (2, "t", {"b": 1}), (None, None, {}), (None, "", {})], "doc_id long, text string, m map<string, int>")
    got = exact_dedup.drop_exact_copies(df).collect()
    assert sorted(map(str, got)) == sorted(map(str, df.collect()[1:3] + [r for r in df.collect() if r.doc_id is None and r in got])) and len(got) == 3


def test_marked_misses_none(spark):
    keys = spark.range(0, 3000, 3).select((F.col("id") * 7919 - 5000).alias("k"))
    rows = spark.range(3000).select((F.col("id") * 7919 - 5000).alias("v"), "id")
    got = marked(rows, F.col("v"), keys, "hit").collect()
    assert all(r.hit for r in got if r.id % 3 == 0) and sum(r.hit for r in got) < 1400


def test_ids_that_are_no_longs_count_as_null(spark):
    """Operators that compare ids as longs take any ids."""
    from voxfabric.llm import similarity_join, substring_dedup, token_index

    t = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([("7", t, 1), ("x9", t, 2), ("12", t, 3), (None, "short", 4)], "doc_id string, text string, k int")
    found = {r.words_md5: (r.class_id, r.copies) for r in similarity_join.join(df).collect()}
    assert sorted(found.values(), key=str) == [(7, 3), (None, 1)]
    assert sorted(r.k for r in similarity_join.drop_near_copies(df).collect()) == [1, 2, 4]
    removed = {(r.doc_id, r.n_words): r.n_removed for r in substring_dedup.remove_repeats(df).collect()}
    assert removed["7", 30] == 0 and removed["12", 30] == 30 and len(removed) == 4
    index = token_index.write(df)
    assert sorted(str(r.doc_id) for r in token_index.read_all(index).collect()) == ["12", "7", "None", "None"]
    assert len(token_index.lookup(index, df.where("k < 3").select("doc_id")).collect()) == 3
