"""Nothing is lost to the size of a text, and columns keep their values whatever their names."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerlight.llm import byte_words, chat_format, lang_id, secret_scan


def digest(turns):
    return hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()


def read_back(done):
    whole = F.array_join(F.transform("t", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return done.withColumn("t", chat_format.read_turns(F.col("formatted"))).select("conv_id", "mapping", F.size("t").alias("n"), F.sha2(whole, 256).alias("h"))


@pytest.mark.parametrize("sizes", [[25_000_000], [1_000_000] * 40])
def test_long_conversations_read_back(spark, sizes):
    rows = spark.createDataFrame([(5, i, "assistant" if i % 2 else "user", n) for i, n in enumerate(sizes)], "conv_id long, turn long, role string, n int")
    rows = rows.select("conv_id", "turn", "role", F.expr("concat('<s>', repeat('x', n - 3))").alias("text"))
    (row,) = read_back(chat_format.format_chats(chat_format.records_of_turns(rows))).collect()
    wanted = digest([("assistant" if i % 2 else "user", "<s>" + "x" * (n - 3)) for i, n in enumerate(sizes)])
    assert (row["mapping"], row["n"], row["h"]) == ("messages", len(sizes), wanted)


def test_long_json_records_keep_their_layout(spark):
    rows = spark.range(1).select(F.lit(1).alias("conv_id"), F.expr("""concat('{"prompt": "', repeat('a\\\\"', 12000000), '", "completion": "b\\\\\\\\"}')""").alias("record"))
    (row,) = read_back(chat_format.format_chats(rows)).collect()
    assert (row["mapping"], row["n"], row["h"]) == ("prompt-completion", 2, digest([("user", 'a"' * 12_000_000), ("assistant", "b\\")]))


def test_columns_have_the_paths_of_their_type(spark):
    rows = spark.sql("SELECT named_struct('instruction', 'a', 'output', 'b') AS record, named_struct('strange', array(named_struct('x', 1))) AS other")
    found = chat_format.format_chats(rows).first()
    json = chat_format.format_chats(spark.createDataFrame([('{"output": "b", "instruction": "a"}',)], "record string")).first()
    assert found["schema_fingerprint"] == json["schema_fingerprint"] and [tuple(t) for t in found["turns"]] == [("user", "a"), ("assistant", "b")]
    assert chat_format.format_chats(rows, "other").first()["turns"] is None


def test_coverage_measures_whole_candidates():
    held = frozenset(["password", "internationalisation"])
    assert secret_scan.coverage("password" * 1000 + "q" * 8000, held) == 0.5
    assert secret_scan.coverage("q" * 5000 + "internationalisation" * 250, held) == 0.5


def brute_bits(word, counts, order):
    """Code length of one language by escapes (method C), byte by byte."""
    raw, bits = b" " + word.encode(), 0.0
    for i in range(1, len(raw)):
        k = min(i, order)
        while k >= 0:
            seen = counts.get((k, raw[i - k : i]), {})
            total, kinds = sum(seen.values()), len(seen)
            if raw[i] in seen:
                bits -= math.log2(seen[raw[i]] / (total + kinds))
                break
            if total:
                bits -= math.log2(kinds / (total + kinds))
            k -= 1
        else:
            bits += 8
    return bits


def test_runs_without_blanks_are_coded_whole(spark):
    text = "".join(chr(0x4E00 + (i * i * 7 + i // 3) % 500) for i in range(1000))
    docs = spark.createDataFrame([(1, text[:600], "zh"), (2, "some plain words", "en")], "doc_id long, text string, lang string")
    trees = lang_id.train(docs)
    counts = {}
    raw = b" " + text[:600].encode()
    for i in range(1, len(raw)):
        for k in range(min(i, lang_id.ORDER) + 1):
            seen = counts.setdefault((k, raw[i - k : i]), {})
            seen[raw[i]] = seen.get(raw[i], 0) + 1
    for word in (text, text[300:], text[:70]):
        assert trees.code_lengths([word])[0][trees.langs.index("zh")] == pytest.approx(brute_bits(word, counts, lang_id.ORDER), rel=1e-9)


def test_tables_of_long_words_stay_bounded():
    table = byte_words.WordTable(lambda words: np.ones((len(words), 1)), 1, max_chars=1000)
    for i in range(50):
        assert len(table.rows([[f"{i}" + "x" * 400]])[0]) == 1
    assert len(table._rows) < 5


def test_stages_keep_the_values_of_clashing_columns(spark):
    extra = ["shard", "shard_order", "_source", "_size", "_place", "secrets", "redacted", "secret_candidates", "_id", "_hash", "_none", "c0", "label", "fp", "key"]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs = docs.withColumns({c: F.concat(F.lit(f"{c} of "), F.col("doc_id").cast("string")) for c in extra})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.columns == docs.columns, name
        wrong = out.filter(" or ".join(f"{c} is null or {c} != concat('{c} of ', doc_id)" for c in extra))
        assert wrong.isEmpty() and not out.isEmpty(), name
