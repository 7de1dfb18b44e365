import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from voxfabric.llm import language
from voxfabric.llm.common import fold
from voxfabric.llm.queries import op6_language_id

WORDS = {"en": "the of house garden tree stone river night light", "de": "der und haus garten baum stein fluss nacht licht", "fi": "talo puu kivi joki yö valo ja metsä"}


@pytest.fixture(scope="module")
def rows():
    r = random.Random(4)
    out = []
    for i in range(240):
        lang = ["en", "en", "de", "en", "de", "fi"][i % 6]
        text = " ".join(r.choice(WORDS[lang].split()) + r.choice(["", "", "s", "en", "7"]) for _ in range(r.randint(1, 60)))
        out.append((i, text, lang if i % 7 else None, 1))
    return out + [(900, None, "en", 1), (901, "", "de", 1), (902, "12 %", "fi", 1), (903, "Haus the " * 20_000, None, 1), (None, "the tree", "en", 1), (5, "the tree", "de", 1), (5, "the tree", "de", 1)]


def split(t):
    return re.findall(r"[^\W\d_]+", t.lower())


def brute(rows):
    """Word-first backoff from plain counts; everything is in the sample and in the tables here."""
    learn = [(t, x) for i, t, x, _ in rows if t is not None and x is not None and zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 0]
    langs = sorted({x for _, x in learn})
    by_word, by_gram, docs = defaultdict(Counter), defaultdict(Counter), Counter(x for _, x in learn)
    for t, x in learn:
        for w in split(t):
            by_word[w][x] += 1
            m = f"<{w}>"
            for n in range(1, 5):
                for k in range(len(m) - n + 1):
                    by_gram[m[k : k + n]][x] += 1
    size = {n: [sum(c[x] for g, c in by_gram.items() if len(g) == n) for x in langs] for n in range(1, 5)}
    kinds = {n: sum(len(g) == n for g in by_gram) for n in range(1, 5)}
    total = [sum(c[x] for c in by_word.values()) for x in langs]

    def word(w):
        if w in by_word:
            return [math.log((by_word[w][x] + 0.5) / (total[j] + 0.5 * len(by_word))) for j, x in enumerate(langs)]
        m, out = f"<{w}>", [0.0] * len(langs)
        for k in range(len(m) - 1):
            for n in (4, 3, 2, 1):
                g = m[k : k + n]
                if len(g) == n and g in by_gram:
                    out = [o + math.log((by_gram[g][x] + 0.5) / (size[n][j] + 0.5 * kinds[n])) for j, (o, x) in enumerate(zip(out, langs))]
                    break
        return [o / (len(m) - 1) for o in out]

    got = []
    for i, t, _, _ in rows:
        found = split(t or "")
        if not found:
            got.append((str(i), "und", 0.0))
            continue
        logs = [math.log((docs[x] + 1) / (sum(docs.values()) + len(langs))) for x in langs]
        for w in found:
            logs = [a + b for a, b in zip(logs, word(w))]
        best = max(range(len(langs)), key=lambda j: logs[j])
        logs = [v * min(1, 20 / len(found)) for v in logs]
        got.append((str(i), langs[best], 1 / sum(math.exp(v - logs[best]) for v in logs)))
    return got


def test_against_brute_force(spark, rows):
    df = spark.createDataFrame([(*r, 3) for r in rows], "doc_id long, text string, lang string, score int, gram int").repartition(3)
    model = language.train(language.training_rows(df))
    got = sorted((str(r.doc_id), r.lang_pred, r.score) for r in language.identify(df, model).collect())
    want = sorted(brute(rows))
    assert [x[:2] for x in got] == [x[:2] for x in want]
    assert [x[2] for x in got] == pytest.approx([x[2] for x in want], abs=1e-6)
    assert len({round(x[2], 3) for x in got}) > 2  # not all alike


def test_sample_is_even(spark):
    """A language of a hundredth of the rows is learned like the others."""
    df = spark.createDataFrame([(i, "talo puu" if i % 100 == 0 else "the tree", "fi" if i % 100 == 0 else "en") for i in range(3000)], "doc_id long, text string, lang string")
    model = language.train(df, sample_docs=60)
    row = model.word_rows(["talo"])[0]
    assert model.langs == ["en", "fi"] and row[1] > row[0]
    assert model.score("talo puu talo")[0] == "fi"


def test_many_languages_and_forgetting(spark, monkeypatch):
    """Each of 300 languages is learned by its own words; what a worker remembers is bounded and changes nothing."""
    r = random.Random(1)
    letters = "abcdefghijklmnopqrstuvwxyz"
    vocabulary = {f"l{k:03d}": ["".join(r.choice(letters) for _ in range(6)) for _ in range(12)] for k in range(300)}
    df = spark.createDataFrame([(10 * k + j, " ".join(r.sample(w, 8)), x) for k, (x, w) in enumerate(vocabulary.items()) for j in range(3)], "doc_id long, text string, lang string")
    model = language.train(df)
    texts = [" ".join(w[2:7]) for w in vocabulary.values()]
    got = [model.score(t) for t in texts]
    assert sum(g[0] == x for g, x in zip(got, vocabulary)) > 290
    monkeypatch.setattr(language, "ROW_BYTES", 0)
    model.seen.clear()
    model.rows = model.rows[:0]
    long = " ".join(texts) + " " + " ".join(f"unseen{letters[i % 26]}{letters[i // 26 % 26]}{letters[i // 676]}" for i in range(9000))
    first = model.score(long)
    assert [model.score(t) for t in texts] == got and model.score(long) == first and len(model.seen) > 9000


def test_held_out_accuracy(spark):
    out = op6_language_id(spark, "/root/testdata/sf0.01").where(fold() == 0).collect()
    truth = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    judged = [r for r in out if truth[r.doc_id] is not None and r.lang_pred != "und"]
    assert sum(r.lang_pred == truth[r.doc_id] for r in judged) > 0.97 * len(judged) and all(0 <= r.score <= 1 for r in out)


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "the", None), (2, None, "en")], "doc_id long, text string, lang string")
    assert {(r.lang_pred, r.score) for r in language.identify(df, language.train(df)).collect()} == {("und", 0.0)}
    assert language.identify(df.limit(0), language.train(df.limit(0))).collect() == []
