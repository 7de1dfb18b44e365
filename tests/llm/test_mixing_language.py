from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from voxfabric.llm import exact_dedup, language, mixing


def rows_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, mix_epoch int, budget string")


@pytest.fixture(scope="module")
def docs(spark):
    rows = []
    for i in range(400):
        source = "hot" if i % 3 == 0 else f"s{i % 7}"
        rows.append((i, " ".join(["w"] * (i % 11)), ["en", "de", None][i % 3 if i % 5 else 2], source, 9, "clash"))
    rows += [(5, "a b c", "en", "s5", 1, ""), (None, "x y", None, None, 1, ""), (None, None, "en", None, 1, "")]
    return rows_of(spark, rows)


def fill(budget, children):
    """Water-filling by repeated passes: name -> (weight, cap)."""
    share, open_ = {}, dict(children)
    while open_:
        left, w = budget - sum(share.values()), sum(x[0] for x in open_.values())
        full = {k: c for k, (wk, c) in open_.items() if c * w <= left * wk}
        if not full:
            share |= {k: left * wk // w for k, (wk, _) in open_.items()}
            break
        first = min(full, key=lambda k: (open_[k][1] / open_[k][0], k))
        share[first] = open_.pop(first)[1]
    return share


def test_mix_against_brute_force(spark, docs):
    weights = {"domain": {"a": 3}, "lang": {"en": 5}, "source": {"hot": 2}}
    domain = F.when(F.col("source") == "hot", "a").otherwise("b")
    got = mixing.mix(docs, domain, weights, fraction=(3, 4), max_epochs=2, seed=3)
    assert got.columns == ["doc_id", "text", "lang", "source", "budget", "mix_epoch"]
    got = got.collect()

    import hashlib

    leaf = defaultdict(list)
    for r in docs.collect():
        leaf["a" if r.source == "hot" else "b", r.lang or "none", r.source or "none"].append((r.doc_id, len((r.text or "").split())))
    tokens = {k: sum(n for _, n in v) for k, v in leaf.items()}
    total = sum(tokens.values()) * 3 // 4

    def children(prefix):
        out = defaultdict(int)
        for k, t in tokens.items():
            if k[: len(prefix)] == prefix:
                out[k[len(prefix)]] += 2 * t
        level = ("domain", "lang", "source")[len(prefix)]
        return {k: (weights[level].get(k, 1), c) for k, c in out.items()}

    want = Counter()
    for d, b1 in fill(total, children(())).items():
        for x, b2 in fill(b1, children((d,))).items():
            for s, b3 in fill(b2, children((d, x))).items():
                own, t = leaf[d, x, s], tokens[d, x, s]
                whole, rest = (b3 // t, b3 % t) if t else (1, 0)
                place = lambda i: hashlib.md5(f"3-{whole}-{'' if i is None else i}".encode()).hexdigest()  # noqa: E731,B023
                for i, _ in own:
                    upto = sum(n for j, n in own if place(j) <= place(i))
                    for e in range(whole + (rest > 0 and upto <= rest)):
                        want[i, e] += 1
    assert Counter((r.doc_id, r.mix_epoch) for r in got) == want


def test_mix_empty(spark, docs):
    assert mixing.mix(docs.limit(0), F.lit("x"), {}).collect() == []


def test_mix_all_when_budget_covers(spark, docs):
    assert mixing.mix(docs, F.lit(None), {}).count() == docs.count()


def test_salted_join_gives_the_same(spark, docs, monkeypatch):
    a = mixing.mix(docs, F.col("source"), {}, (1, 2), 2).select("doc_id", "mix_epoch").collect()
    monkeypatch.setattr(mixing, "BROADCAST_LEAVES", 0)
    b = mixing.mix(docs, F.col("source"), {}, (1, 2), 2).select("doc_id", "mix_epoch").collect()
    assert Counter(a) == Counter(b)


def test_exact_groups(spark):
    rows = [(1, "a  b"), (2, "a b"), (3, None), (4, ""), (5, "a b"), (2, "a b"), (None, "q"), (7, " a b"), (8, "x" * 200_000), (9, "x" * 200_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"key": F.lit("k"), "norm": F.lit(1), "n": F.lit(2)})
    got = Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(docs).collect())
    assert got == Counter([(1, 1, 3, True), (2, 1, 3, False), (2, 1, 3, False), (3, 3, 2, True), (4, 3, 2, False), (5, 5, 1, True), (None, None, 1, True), (7, 7, 1, True), (8, 8, 2, True), (9, 8, 2, False)])
    assert sorted(r.doc_id or 0 for r in exact_dedup.drop_exact_copies(docs).collect()) == [0, 1, 3, 5, 7, 8]
    assert exact_dedup.exact_groups(docs.limit(0)).collect() == []


def test_colliding_hashes_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup.F, "md5", lambda c: F.lit("same"))
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "doc_id long, text string")
    got = sorted((r.doc_id, r.keep_id, r.group_size) for r in exact_dedup.exact_groups(docs).collect())
    assert got == [(1, 1, 2), (2, 2, 1), (3, 1, 2)]


def test_language(spark):
    rows = [(i, "the house and the garden of old" if i % 2 else "das haus und der garten von alt", "en" if i % 2 else "de", i) for i in range(40)] + [(50, "?", None, 1), (51, None, "en", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    model = language.train(docs)
    ask = spark.createDataFrame([(1, "the old house"), (2, "der alte garten"), (3, None), (4, " 12 ²"), (5, "houses"), (6, "x" * 100_000)], "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(ask.withColumn("score", F.lit("clash")), model).collect()}
    assert [got[i][0] for i in range(1, 6)] == ["en", "de", "und", "und", "en"]
    assert got[3][1] == got[4][1] == 0 and 0.5 < got[1][1] <= 1
    assert language.identify(ask.limit(0), model).collect() == []
    assert language.identify(ask, language.train(docs.limit(0))).first().lang_pred == "und"
    assert [r.lang_pred for r in language.identify(ask, language.train(docs, sample_docs=10)).collect()][:2] == ["en", "de"]
