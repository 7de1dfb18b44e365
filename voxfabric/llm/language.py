"""Language identification: word-first backoff.

Known words are scored by their log frequency in each language; an unseen
word falls back to character n-grams, at each place the longest known one.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from xxhash import xxh3_64_intdigest

from voxfabric.llm.common import few_rows, fold

_WORDS = regex.compile(r"\p{L}[\p{L}\p{M}]*").findall
LONGEST_GRAM = 4
#: A probability counts so many words of a text at most.
EVIDENCE = 20
#: Bytes of the rows of words that a worker remembers.
ROW_BYTES = 1 << 25


def words(text: str) -> list[str]:
    return _WORDS(text.lower())


def grams(word: str, n: int) -> list[str]:
    """Character n-grams of a word between marks."""
    w = f"<{word}>"
    return [w[i : i + n] for i in range(len(w) - n + 1)]


class Table:
    """Log frequencies of strings per language, sparse: 64-bit keys in order, and for each the languages that have it with what these have above an absent string's."""

    def __init__(self, keys: np.ndarray, langs: np.ndarray, counts: np.ndarray, n_langs: int):
        order = np.lexsort((langs, keys))
        keys, self.lang, counts = keys[order], langs[order].astype(np.uint32), counts[order].astype(float)
        self.keys, first = np.unique(keys, return_index=True)
        self.ends = np.append(first, len(keys)).astype(np.int64)
        total = np.bincount(self.lang, counts, n_langs) + 0.5 * len(self.keys)
        self.absent = np.log(0.5 / total) if len(self.keys) else np.zeros(n_langs)
        self.more = np.log((counts + 0.5) / 0.5)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Places of keys, -1 for those it lacks."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)

    def add_to(self, out: np.ndarray, rows: np.ndarray, places: np.ndarray) -> None:
        """out[rows] += the log frequencies at places; rows in order."""
        n = self.ends[places + 1] - self.ends[places]
        each = np.repeat(self.ends[places] - np.cumsum(n) + n, n) + np.arange(n.sum())
        np.add.at(out, (np.repeat(rows, n), self.lang[each]), self.more[each])
        out += np.bincount(rows, minlength=len(out))[:, None] * self.absent


def _word_keys(words_: list[str]) -> np.ndarray:
    return np.array([xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words_], np.uint64)


def _gram_keys(codes: np.ndarray, n: int) -> np.ndarray:
    """Keys of the n-grams that begin at each code point but the last n - 1: the code points side by side, for n = 4 by a multiplication."""
    key = codes[: len(codes) - n + 1].astype(np.uint64)
    for i in range(1, n):
        key = key * np.uint64(1 << 21 if n < 4 else 0x9E3779B97F4A7C15) + codes[i : len(codes) - n + 1 + i]
    return key


class Model:
    """langs, sorted; words: their log frequency per language; grams: the same of n-grams, one table per n."""

    def __init__(self, langs: list[str], words_: Table, grams_: list[Table], prior: np.ndarray):
        self.langs, self.words, self.grams = langs, words_, grams_
        self.prior = np.log((prior + 1) / (prior.sum() + len(langs))) if len(langs) else prior
        self.seen: dict[str, int] = {}
        self.rows: np.ndarray = np.zeros((0, len(langs)))

    def word_rows(self, new: list[str]) -> np.ndarray:
        """Log-likelihood of words per language: of unseen ones, the mean over the word's places of the longest known n-gram."""
        out = np.zeros((len(new), len(self.langs)))
        at = self.words.find(_word_keys(new))
        known = np.flatnonzero(at >= 0)
        if len(known):
            mine = np.zeros((len(known), len(self.langs)))
            self.words.add_to(mine, np.arange(len(known)), at[known])
            out[known] = mine
        unseen = np.flatnonzero(at < 0)
        if len(unseen):
            marked = [f"<{new[i]}>" for i in unseen]
            size = np.array([len(m) for m in marked])
            codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
            word = np.repeat(np.arange(len(marked)), size)
            ends = np.cumsum(size)
            left = ends[word] - np.arange(len(codes))  # characters from here to the word's end
            open_ = left > 1  # the closing mark begins no n-gram
            mine = np.zeros((len(marked), len(self.langs)))
            for n in range(LONGEST_GRAM, 0, -1):
                here = np.flatnonzero(open_ & (left >= n))
                if not len(here):
                    continue
                found = self.grams[n - 1].find(_gram_keys(codes, n)[here])
                hit = found >= 0
                self.grams[n - 1].add_to(mine, word[here[hit]], found[hit])
                open_[here[hit]] = False
            out[unseen] = mine / (size - 1)[:, None]
        return out

    def score(self, text: str | None) -> tuple[str, float]:
        """The likeliest language and its probability, by at most EVIDENCE words' worth of evidence: words of a text aren't independent."""
        found = words(text) if text else []
        if not found or not self.langs:
            return "und", 0.0
        most = min(200_000, max(1000, ROW_BYTES // (8 * len(self.langs))))
        if len(self.seen) > most:
            self.seen.clear()
            self.rows = self.rows[:0]
        counted = Counter(found)
        new = [w for w in counted if w not in self.seen]
        if new:
            n = len(self.seen)
            if n + len(new) > len(self.rows):
                self.rows = np.concatenate([self.rows[:n], np.zeros((n // 2 + len(new) + 1000, len(self.langs)))])
            for a in range(0, len(new), 4096):  # a text of any length brings its words in parts
                self.rows[n + a : n + min(a + 4096, len(new))] = self.word_rows(new[a : a + 4096])
            self.seen.update(zip(new, range(n, n + len(new))))
        times = np.fromiter(counted.values(), float, len(counted))
        total = self.prior + times @ self.rows[np.fromiter(map(self.seen.__getitem__, counted), np.int64, len(counted))]
        best = int(np.argmax(total))
        total = total * min(1.0, EVIDENCE / len(found))
        return self.langs[best], float(1 / np.exp(total - total[best]).sum())


def train(docs: DataFrame, sample_docs: int = 20_000, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> Model:
    """Fit on labelled documents.

    It learns from a sample of about sample_docs documents, whole texts each,
    chosen by a hash of their ids: of each language the same number, or all
    there are. That is the only bound: all words and n-grams of the sample are
    in the tables, which hold some 20 bytes for each language that one occurs
    in. Prior probabilities count all documents. Rows that repeat an id are
    taken or left together; texts of any length are counted whole. Null texts
    and languages are not learned from; without any document the model knows
    no language.
    """
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).cast("string").alias("id"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    per_lang = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}  # a row per language
    langs = sorted(per_lang)
    if langs:
        places, each = 10**12, -(-sample_docs // len(langs))
        shares = docs.sparkSession.createDataFrame([(k, i, min(places, each * places // n)) for i, (k, n) in enumerate(sorted(per_lang.items()))], "lang string, number int, share long")
        known = known.join(F.broadcast(shares), "lang").where(F.pmod(F.xxhash64("id"), F.lit(places)) < F.col("share")).select("id", "number", "text")
    else:
        known = known.select("id", F.lit(0).alias("number"), "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_word: dict[int, Counter] = {}
        for batch in few_rows(batches):
            for x, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                by_word.setdefault(x, Counter()).update(words(t))
        for x, c in by_word.items():
            yield _counts(0, x, _word_keys(list(c)), np.fromiter(c.values(), np.int64, len(c)))
            for m in range(1, LONGEST_GRAM + 1):
                by_gram: Counter = Counter()
                for w, k in c.items():
                    for g in grams(w, m):
                        by_gram[g] += k
                names = list(by_gram)
                codes = np.frombuffer("".join(names).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
                yield _counts(m, x, _gram_keys(codes, m)[::m] if names else codes, np.fromiter(by_gram.values(), np.int64, len(names)))

    found = known.mapInArrow(count, "kind int, lang int, key long, n long").groupBy("kind", "lang", "key").agg(F.sum("n").alias("n"))
    # As large as the sample's vocabulary, as numbers.
    table = found.toArrow()
    kind, language, key, n = (table[c].to_numpy() for c in ("kind", "lang", "key", "n"))
    tables = [Table(key[kind == k].view(np.uint64), language[kind == k], n[kind == k], len(langs)) for k in range(LONGEST_GRAM + 1)]
    return Model(langs, tables[0], tables[1:], np.array([per_lang[x] for x in langs], float))


def _counts(kind: int, lang: int, keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(np.full(len(keys), lang, np.int32)), pa.array(keys.view(np.int64)), pa.array(n)], names=["kind", "lang", "key", "n"])


def identify(docs: DataFrame, model: Model, text: str = "text", prefix: str = "") -> DataFrame:
    """docs with columns lang_pred and score, the probability of lang_pred.

    Texts that are null or have no letter get "und" and 0; so does every text
    if there was nothing to learn from. Ties go to the first language by
    name. Input columns of these names are replaced; other columns pass
    through. Rows are judged one by one, whatever their ids, and texts of any
    length whole. An empty table gives an empty result.
    """
    broadcast = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.drop("lang_pred", "score")
    schema = StructType(list(kept.schema.fields)).add("lang_pred", "string").add("score", "double")
    at = kept.columns.index(text)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = broadcast.value
        for rows in few_rows(batches):
            got = [m.score(t) for t in rows.column(at).to_pylist()]
            columns = [*rows.columns, pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*rows.schema.names, "lang_pred", "score"])

    return kept.mapInArrow(predict, schema)


def training_rows(docs: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The rows to learn from: crc32 of the id, modulo 5, is not 0."""
    return docs.where(fold(doc_id) != 0)
