import base64
import os
import random

import pytest
from pyspark.sql import functions as F

from dhwanika.llm.encoding import TOKENIZERS, VOCAB, Encoder, decode, encode, token_counts

PATH = os.path.join(TOKENIZERS, VOCAB)
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary files")
SIGNS = [" ", "  ", "\n", "\t", "'", "'s", "'ll", "'re", "'ve", "s", "l", "re", "a", "Z", "१", "क", "ि", "3", "½", "!", "　", "​", "😀", "''", "\x1c", "\x85", "é", "ſ"]


@pytest.fixture(scope="module")
def mine():
    with open(PATH, "rb") as f:
        return Encoder(f.read())


@pytest.fixture(scope="module")
def theirs():
    tiktoken = pytest.importorskip("tiktoken")
    pattern = pytest.importorskip("public_tokenizers").PATTERN
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def test_random_texts_agree_with_the_public_encoder(mine, theirs):
    rng = random.Random(4)
    texts = ["".join(rng.choice(SIGNS) for _ in range(rng.randrange(40))) for _ in range(4000)]
    assert mine.encode_batch(texts) == [theirs.encode_ordinary(t) for t in texts]


def test_long_pieces_and_round_trip(mine, theirs):
    texts = ["", "x" * 30_000, "क" * 20_000, " " * 5000, "<|endoftext|>", "ab " * 10_000]
    ids = mine.encode_batch(texts)
    assert ids == [theirs.encode_ordinary(t) for t in texts]
    assert [mine.decode(x) for x in ids] == texts


def test_documents(spark, data, theirs):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    text = {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}
    got = {r["doc_id"]: r["ids"] for r in encode(docs, "doc_id", "text").collect()}
    assert got == {k: theirs.encode_ordinary(t) for k, t in text.items()}


def test_defined_cases(spark, mine):
    df = spark.createDataFrame([(1, None), (2, ""), (3, " "), (4, "नमस्ते hi"), (4, "नमस्ते hi")], "k long, t string")
    wide = df.withColumn("ids", F.lit(1)).withColumn("key", F.lit(2)).withColumn("text", F.lit("z"))
    got = encode(wide, "k", "t", offsets=True).collect()
    by = {r["k"]: (r["ids"], r["offsets"]) for r in got}
    assert len(got) == 5 and by[1] == by[2] == ([], []) and len(by[3][0]) == 1
    whole = "नमस्ते hi".encode()
    ends = [*by[4][1][1:], len(whole)]
    assert b"".join(whole[a:b] for a, b in zip(by[4][1], ends)) == whole and all(mine.bytes_of[i] == whole[a:b] for i, a, b in zip(by[4][0], by[4][1], ends))
    back = decode(encode(df, "k", "t"), "k", "ids").filter("k = 4").first()["text"]
    assert back == "नमस्ते hi"
    assert {r["k"]: r["tokens"] for r in token_counts(df, "k", "t").collect()}[1] == 0
    assert encode(df.filter("false"), "k", "t").count() == 0
