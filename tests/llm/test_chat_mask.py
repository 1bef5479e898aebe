"""The loss mask is read through its lengths; rows without conversation stay apart; exact lengths in packing."""
import itertools

import numpy as np
from pyspark.sql import functions as F

from prismtab.llm import chat, packing


def test_a_wrong_mask_gives_another_text(spark):
    rows = [(1, 0, "user", "hi <|x|> é"), (1, 1, "assistant", "one <|im_end|> \\"), (1, 2, "assistant", ""), (1, 3, "assistant", "two")]
    chats = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"))
    assert chat.read_back(chats).first()["loss_texts"] == ["one <|im_end|> \\", "", "two"]
    shifted = chats.withColumn("loss_runs", F.transform("loss_runs", lambda r, i: F.struct((r["chars"] + F.when(i == 0, 1).otherwise(0)).alias("chars"), r["loss"].alias("loss"))))
    assert chat.read_back(shifted).first()["loss_texts"][0] != "one <|im_end|> \\"


def test_rows_without_conversation_are_conversations(spark):
    rows = [(None, 0, "user", "a"), (None, 0, "user", "a"), (None, 1, "assistant", "b"), (2, 0, "user", "c")]
    got = chat.chat_digests(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")).collect()
    assert sorted((str(r["conv_id"]), r["n_turns"], r["loss_chars"]) for r in got) == [("2", 1, 0), ("None", 1, 0), ("None", 1, 0), ("None", 1, 1)]


def test_boundaries_of_long_documents_are_exact(spark):
    sizes = [3, 5, 2049, 2051, 2051, 4099, 4101, 4101, 9000]
    docs = spark.createDataFrame([(i, "w " * n) for i, n in enumerate(sizes)], "doc_id long, text string")
    rows = packing.pack(docs, buckets=3, batch_tokens=10**6).collect()
    padding = sum(r["padded_length"] - r["n_tokens"] for r in rows)
    ends = sorted(set(sizes))
    best = min(sum(min(e for e in (*some, 9000) if e >= n) - n for n in sizes) for some in itertools.combinations(ends[:-1], 2))
    assert padding == best and {r["padded_length"] for r in rows} <= set(sizes)
    assert np.all([r["batch"] == 0 for r in rows])
