import base64
import hashlib
import random

import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fanloom.llm.bpe import BYTE_BPE_50K, PATTERN, BytePairEncoder, decode, encode, encoder, token_count
from fanloom.llm.queries import QUERIES
from tests import oracle


@pytest.fixture(scope="module")
def public():
    t = Tokenizer.from_file(BYTE_BPE_50K)
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


HARD = [
    "", " ", "\n\n", "a", "<|endoftext|> x <|startoftext|>", "don't we'LL I'd've '' 's", "  two  spaces ", "tab\tand\r\nline\x0b\x0c\x85  　end",
    "naïve café ﬁ", "漢字かな交じり文", "한국어 문장", "العربية ١٢٣", "हिन्दी क्षि", "👩‍👩‍👧‍👦🏳️‍🌈", "ẹ́̀", "​﻿‍", "\U0010ffff", "½²Ⅷ①", "x" * 3000, "ab" * 2000, " " * 2000, "é" * 2000, "😀" * 700, "\x00\x01",
]


@pytest.mark.parametrize("text", HARD, ids=range(len(HARD)))
def test_same_ids_as_the_public_library(public, text):
    bpe = encoder()
    ids = bpe.encode(text)
    assert ids == public(text) and bpe.decode(ids) == text and bpe.count(text) == len(ids)


def test_random_texts_and_a_second_library(public):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(BYTE_BPE_50K.replace(".json", ".tiktoken"), "rb"))}
    other = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng, bpe = random.Random(1), encoder()
    for _ in range(300):
        s = "".join(rng.choice(["th", "e", " ", "'", "s", "1", "é", "漢", "\n", ".", "😀", "Q", "\t", "_"]) for _ in range(rng.randrange(60)))
        assert bpe.encode(s) == public(s) == other.encode_ordinary(s)


def test_every_vocabulary_entry_that_is_text(public):
    bpe = encoder()
    for v in list(bpe.vocabulary.values())[::17]:
        try:
            s = v.decode()
        except UnicodeDecodeError:
            continue
        assert bpe.encode(s) == public(s)


def test_bounded_memory_of_pieces():
    bpe = BytePairEncoder(kept_pieces=10)
    bpe.encode(" ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)))
    assert len(bpe.pieces) <= 10


def test_columns(spark, small_batches):
    rows = [(i, s) for i, s in enumerate(HARD)] + [(100, None), (100, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash"))
    out = df.select("doc_id", "text", encode(F.col("text")).alias("e"), token_count(F.col("text")).alias("n"))
    assert out.schema["e"].dataType.simpleString() == "array<int>"
    bpe = encoder()
    for r in out.withColumn("back", decode(F.col("e"))).collect():
        assert r.e == bpe.encode(r.text) and r.n == len(r.e) and r.back == (r.text or "")
    assert df.limit(0).select(encode(F.col("text"))).count() == 0
    assert spark.sql("SELECT CAST(NULL AS ARRAY<INT>) AS a").select(decode(F.col("a"))).collect()[0][0] is None


def test_queries(spark, public):
    rows = QUERIES["p7_ids"](spark, oracle.DATA).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{oracle.DATA}/documents.parquet").collect()}
    assert len(rows) == len(texts) and all(r.ids == public(texts[r.doc_id] or "") for r in rows)
    digests = {r.doc_id: r.digest for r in QUERIES["p7_round_trip"](spark, oracle.DATA).collect()}
    assert digests == {i: hashlib.md5((t or "").encode()).hexdigest() for i, t in texts.items()}
