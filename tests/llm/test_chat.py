"""Chat formatting: reversible escapes and exact masks."""

import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import types as T

from barwright.llm import chat

SCHEMA = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()),
                       T.StructField("text", T.StringType()), T.StructField("formatted", T.StringType())])
PATH = public_tokenizers.path("byte_bpe_50k.json")
BITS = ["</s>", "[INST]", "<|turn|>", "<|end|>", "<|endoftext|>", "\\", "\n", " ", "a", "é", "日本", "<", "|", "[", "n", "<\\|end|>", "🙂"]


def texts(rng):
    return "".join(rng.choice(BITS) for _ in range(rng.randint(0, 12)))


def test_escapes_come_back_and_hide_control_strings():
    rng = random.Random(1)
    for _ in range(3000):
        turns = [(texts(rng), texts(rng)) for _ in range(rng.randint(0, 4))]
        formatted, _ = chat.render(turns)
        assert list(chat.parse(formatted)) == turns
        assert formatted.count(chat.TURN) == formatted.count(chat.END) == len(turns)
        assert not any(c in formatted for c in chat.FOREIGN)


def test_mask_covers_exactly_the_answers():
    rng = random.Random(2)
    tokenizer = chat.load(PATH)
    for _ in range(400):
        turns = [(rng.choice(["user", "assistant"]), texts(rng)) for _ in range(rng.randint(1, 6))]
        formatted, spans = chat.render(turns)
        tokens = tokenizer.encode(formatted, add_special_tokens=False)
        mask, under = chat.masked(spans, np.array(tokens.offsets).reshape(-1, 2))
        assert "".join(chat.unescape(formatted[a:b]) for a, b in under) == "".join(t for r, t in turns if r == "assistant")
        for (a, b), m in zip(tokens.offsets, mask.tolist(), strict=True):
            assert m == any(a < z and s < b for s, z in spans)


@pytest.mark.parametrize("block, piece", [(1024, 1 << 20), (2, 1 << 20), (1024, 5)])
def test_pieces_do_not_change_the_report(spark, tmp_path, block, piece):
    rng = random.Random(3)
    rows = [(rng.choice([1, 2, None]), rng.choice([None, *range(6)]), rng.choice(["user", "assistant", None]), rng.choice([None, texts(rng)]), "x") for _ in range(60)]
    rows += [rows[0], (9, 0, "assistant", "", "x")]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = str(tmp_path / "chat")
    chat.format_conversations(docs, PATH, block, piece).write.parquet(out)
    got = {r.conv_id: r for r in chat.report(spark.read.parquet(out)).collect()}
    assert set(got) == {r[0] for r in rows}
    import hashlib
    for conv, r in got.items():
        mine = sorted(((t is not None, t or 0, role or "", text or "") for c, t, role, text, _ in rows if c == conv))
        answer = "".join(t for *_, role, t in mine if role == "assistant")
        assert r.n_turns == len(mine) and r.loss_chars == len(answer)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{role}\n{t}\n" for *_, role, t in mine).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(answer.encode()).hexdigest()
    assert chat.report(chat.format_conversations(docs.limit(0), PATH)).count() == 0
