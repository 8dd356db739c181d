"""Language identification by prediction by partial matching over bytes.

For each language a context tree of bytes is counted: how often a byte followed a
context of ``order`` bytes at most. Statistics are frozen after training. A byte
that a context has not seen escapes (method C: n distinct bytes of t seen leave
n / (n + t) to the escape) to the context one byte shorter, down to all 256
bytes alike. The code length of a text in bits under a language is the sum over
its bytes; the shortest code names the language.

Contexts reach back to the start of their word and no further, so the code length
of a text is exactly the sum over its words. Workers keep the lengths of words
they have seen (at most ``max_words``) and look the others up in NumPy.

A text that is null or has no letter is ``und`` with score 0. Ties go to the
smaller language by code point. Without any labelled text every text is ``und``.
Rows with a null id, repeated rows and empty tables need no care: rows are
scored one by one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlight.llm.byte_words import WordTable, context, grams, key_of, rows_of_texts, words_of
from ledgerlight.llm.cluster import shipped

ORDER = 4
#: Labelled documents that each language's tree is fitted on, at most (those of the smallest hash).
TRAIN_DOCUMENTS = 1500


class ContextTrees:
    """Frozen statistics of all languages.

    ``bits`` holds, for every (context, byte) that any language has seen, the whole
    code length of that byte under each language, escapes down the tree included;
    ``escape`` holds, for every context, what a byte that nobody has seen there pays
    before it goes on with the context one byte shorter.
    """

    def __init__(self, langs: list[str], rows: list[np.ndarray], order: int = ORDER):
        """``rows``: columns language number, length of the context, its hash, hash of the context one shorter, byte, count."""
        self.langs, self.order = langs, order
        lang, length, context, shorter, byte, count = (np.asarray(c, np.int64) for c in rows)
        context, shorter = context.view(np.uint64), shorter.view(np.uint64)
        self.keys, first, at = np.unique(key_of(context, byte), return_index=True, return_inverse=True)
        self.nodes, node_at = np.unique(context, return_inverse=True)
        counts, seen, distinct = (np.zeros((n, len(langs))) for n in (len(self.keys), len(self.nodes), len(self.nodes)))
        np.add.at(counts, (at, lang), count)
        np.add.at(seen, (node_at, lang), count)
        np.add.at(distinct, (node_at, lang), 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            self.escape = np.where(seen > 0, -np.log2(distinct / (seen + distinct)), 0.0)
            node = node_at[first]
            own = -np.log2(counts / (seen + distinct)[node])
        self.bits = np.zeros_like(counts)
        for k in range(order + 1):
            now = np.flatnonzero(length[first] == k)
            below = 8.0 if k == 0 else self.bits[np.searchsorted(self.keys, key_of(shorter[first[now]], byte[first[now]]))]
            self.bits[now] = np.where(counts[now] > 0, own[now], self.escape[node[now]] + below)

    def code_lengths(self, words: list[str]) -> np.ndarray:
        """Bits of each word (rows) under each language (columns)."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        out = np.zeros((len(raw), len(self.langs)))
        if not len(self.keys) or not any(raw):
            return out
        owner, byte, window, length = grams(raw, self.order)
        # Equal (context, byte) pairs cost the same: each is looked up once.
        _, once, back = np.unique(key_of(context(window, length), byte), return_index=True, return_inverse=True)
        byte, window, length = byte[once], window[once], length[once]
        bits = np.zeros((len(byte), len(self.langs)))
        left = np.arange(len(byte))
        for k in range(self.order, -1, -1):
            there = left[length[left] >= k]
            own = context(window[there], k)
            key = key_of(own, byte[there])
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            bits[there[hit]] += self.bits[at[hit]]
            miss = there[~hit]
            at = np.minimum(np.searchsorted(self.nodes, own[~hit]), len(self.nodes) - 1)
            bits[miss] += np.where((self.nodes[at] == own[~hit])[:, None], self.escape[at], 0.0)
            left = np.concatenate([left[length[left] < k], miss])
        bits[left] += 8
        for j in range(len(self.langs)):
            out[:, j] = np.bincount(owner, bits[back, j], len(raw))
        return out


def train(labelled: DataFrame, *, order: int = ORDER, max_documents: int = TRAIN_DOCUMENTS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> ContextTrees:
    """Counts the context trees of ``labelled`` in tasks; the driver gets the bounded trees.

    Each language is fitted on at most ``max_documents`` texts, those whose id has
    the smallest hash, whatever the table's size.
    """
    known = labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    # A cut by hash keeps about the wanted number; ids and hashes only are counted for it.
    sizes = {r[0]: r[1] for r in known.groupBy(lang_col).agg(F.count(F.lit(1))).collect()}
    langs = sorted(sizes)
    share = [F.when(F.col(lang_col) == x, F.lit(min(1.0, max_documents / sizes[x]))) for x in langs]
    place = F.pmod(F.xxhash64(F.lit(7), F.col(id_col)), F.lit(1 << 20)) / float(1 << 20)
    if not langs:
        return ContextTrees([], [[]] * 6, order)
    sample = known.filter(place <= F.coalesce(*share)).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    number = {x: i for i, x in enumerate(langs)}

    def count(batches):
        held: dict = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = held.setdefault(number[lang], {})
                for w in words_of(text):
                    words[w] = words.get(w, 0) + 1
        for lang, words in held.items():
            raw = [w.encode("utf-8", "surrogatepass") for w in words]
            times = np.fromiter(words.values(), np.int64, len(raw))
            owner, byte, window, length = grams(raw, order)
            for k in range(order + 1):
                there = np.flatnonzero(length >= k)
                _, first, at = np.unique(key_of(context(window[there], k), byte[there]), return_index=True, return_inverse=True)
                sums = np.bincount(at, times[owner[there]], len(first)).astype(np.int64)
                there = there[first]
                own, shorter = context(window[there], k), context(window[there], max(k - 1, 0))
                columns = [np.full(len(there), lang), np.full(len(there), k), own.view(np.int64), shorter.view(np.int64), byte[there].astype(np.int64), sums]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    names = ["lang", "length", "context", "shorter", "byte", "n"]
    counted = sample.mapInArrow(count, ", ".join(f"{c} long" for c in names))
    rows = counted.groupBy(*names[:-1]).agg(F.sum("n").alias("n")).toArrow()
    return ContextTrees(langs, [rows.column(c).to_numpy() for c in names], order)


def predict(docs: DataFrame, trees: ContextTrees, *, id_col: str = "doc_id", text_col: str = "text", max_words: int = 400_000) -> DataFrame:
    """doc_id, lang_pred, score (its share among the languages, by code length per word), one row per row of ``docs``. No shuffle."""
    spark = docs.sparkSession
    frozen = shipped(spark, trees)

    def run(batches):
        model = frozen()
        table = WordTable(model.code_lengths, len(model.langs), max_words)
        for batch in batches:
            texts = pc.if_else(pc.match_substring_regex(pc.fill_null(batch.column(1), ""), r"\pL"), batch.column(1), "")
            lang, score = [], []
            for rows in rows_of_texts(table, texts):
                if not len(rows) or not model.langs:
                    lang.append("und")
                    score.append(0.0)
                    continue
                total = table.values[rows].sum(axis=0) / len(rows)
                best = int(np.argmin(total))
                lang.append(model.langs[best])
                score.append(float(1 / np.exp2(total[best] - total).sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")
