import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from voxfabric.llm import language
from voxfabric.llm.queries import WEIGHTS
from voxfabric.llm.tokens import default_tokenizer

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def rows():
    r = random.Random(8)
    words = {"en": "the of and house garden tree stone river night".split(), "de": "der und haus garten baum stein fluss nacht die".split()}
    out = []
    for i in range(150):
        lang = "en" if i % 3 else "de"
        text = " ".join(r.choice(words[lang]) + (str(r.randint(0, 9)) if r.random() < 0.3 else "") for _ in range(r.randint(8, 60)))
        out.append((i, text, lang, f"src{i % 4}", len(text)))
    out += [(200 + k, out[k][1].replace(" ", "  ", 1), "en", "src1", 1) for k in range(10)]
    out += [(300 + k, out[k][1] + " tail", "en", "src2", 1) for k in range(20)]
    return out + [(400, None, "en", "src1", 0), (401, "", "en", None, 0), (402, "12 34 %", None, "src1", 7)]


def brute(rows, model):
    """The same stages, one document after the other."""
    kept = [r for r in rows if model.score(r[1])[0] != "und" and model.score(r[1])[1] >= 0.5]
    first = {}
    for r in sorted(kept):
        first.setdefault(" ".join((" " + r[1] + " ").split()), r)
    kept = sorted(first.values())
    grams = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in (r[1].split() for r in kept)]
    root = list(range(len(kept)))
    find = lambda x: x if root[x] == x else find(root[x])
    for a in range(len(kept)):
        for b in range(a):
            if len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    kept = [r for k, r in enumerate(kept) if find(k) == k]

    leaf = defaultdict(list)
    for r in kept:
        domain = "a" if hashlib.md5((r[3] or "").encode()).hexdigest() < "8" else "b"
        leaf[domain, r[2] or "none", r[3] or "none"].append(r)
    tokens = {k: sum(len(r[1].split()) for r in v) for k, v in leaf.items()}
    share = {(): sum(tokens.values()) * 9 // 10}
    for depth, level in enumerate(("domain", "lang", "source")):
        for parent in {k[:depth] for k in leaf}:
            open_ = {}
            for k, t in tokens.items():
                if k[:depth] == parent:
                    w, c = open_.get(k[: depth + 1], (WEIGHTS.get(level, {}).get(k[depth], 1), 0))
                    open_[k[: depth + 1]] = (w, c + t)
            left = share[parent]
            while open_:
                total = sum(w for w, _ in open_.values())
                full = [k for k, (w, c) in open_.items() if c * total <= left * w]
                if not full:
                    share |= {k: left * w // total for k, (w, _) in open_.items()}
                    break
                k = min(full, key=lambda k: (open_[k][1] / open_[k][0], k))
                share[k] = open_.pop(k)[1]
                left -= share[k]
    chosen = []
    for k, v in leaf.items():
        whole, rest = divmod(share[k], tokens[k]) if tokens[k] else (1, 0)
        place = {r[0]: hashlib.md5(f"7-{whole}-{r[0]}".encode()).hexdigest() for r in v}
        for r in v:
            upto = sum(len(x[1].split()) for x in v if place[x[0]] <= place[r[0]])
            chosen += [r] * (whole + (rest > 0 and upto <= rest))
    return chosen


def test_run_against_brute_force(spark, rows, tmp_path):
    df = spark.createDataFrame(rows, COLUMNS)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    model = language.train(language.training_rows(df))
    want = brute(rows, model)
    assert 60 < len(want) < len(rows) - 25
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    t = Tokenizer.from_file(default_tokenizer())
    lengths = {r[0]: len(t.encode(r[1]).ids) + 1 for r in want}
    assert {r.doc_id: r.doc_tokens for r in got} == lengths
    assert sum(r.length for r in got) == sum(lengths.values())


def test_stages_keep_columns(spark, rows):
    docs = spark.createDataFrame(rows, COLUMNS)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert stage(spark, docs.limit(0), "").collect() == []


def test_stages_with_repeated_ids_and_clashing_columns(spark):
    """Another text under a dropped copy's id stays; columns may have the names that operators use."""
    t, u = "the house of the garden and the river " * 3, "stone of the night and the tree of the river " * 3
    rows = [(1, t, "en", "s", 1, "g"), (7, t, "en", "s", 2, "g"), (7, u, "en", "s", 3, "g"), (9, t + "tail", None, None, 4, "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, k int, given string")
    names = ["__domain", "__lang", "__source", "__id", "score", "lang_pred", "mix_epoch", "mix_epoch_", "class_id", "text_sha256", "row", "__at", "__piece", "__bits", "__maybe", "maybe", "__s_doc_id", "s_doc_id", "a.b", "c`d"]
    docs = docs.select("*", *[F.concat(F.lit(c), F.col("k")).alias(c) for c in names])
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        if name == "mixing":
            break
        kept = stage(spark, kept, "")
        assert kept.columns == docs.columns
        assert all(r[c] == f"{c}{r.k}" for r in kept.collect() for c in names)
    assert sorted(r.k for r in kept.collect()) == [1, 3]
    mixed = corpus_pipeline.STAGES[3][1](spark, docs, "")
    assert mixed.columns == docs.columns and {r.k for r in mixed.collect()} <= {1, 2, 3, 4}
    assert all(r[c] == f"{c}{r.k}" for r in mixed.collect() for c in names)
    assert corpus_pipeline.STAGES[4][1](spark, docs, "").agg(F.count_distinct("doc_id")).first()[0] == 3


def test_one_of_rows_that_repeat_id_and_text(spark):
    """In the exact stage by text, in the near stage by words."""
    t = "".join(f"w{i} " for i in range(80))
    docs = spark.createDataFrame([(1, t, "en", "s", 5), (1, t, "en", "s", 4), (1, t + " ", "en", "s", 3), (1, t + "night", "en", "s", 2), (None, t, "en", "s", 1)], COLUMNS)
    exact = corpus_pipeline.STAGES[1][1](spark, docs, "")
    assert sorted(r.n_chars for r in exact.collect()) == [2, 3]  # the text ends in a blank, so one more equals it
    near = corpus_pipeline.STAGES[2][1](spark, docs.where("doc_id is not null"), "")
    assert len(near.collect()) == 1
