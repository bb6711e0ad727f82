import random

import pytest

from fanloom.llm.bpe import encoder
from fanloom.llm.pieces import split, split_documents
from fanloom.llm.queries import QUERIES
from tests import oracle

LONG = [
    "x" * 5000, "é" * 1500, "😀" * 1200, " " * 4000, "\n" * 1500, "a\n\n" * 900, "漢字" * 900, "word " * 1500, "1234567890" * 600, "\U00012345" * 700,
    "```\n" + "code line();\n" * 300 + "```\n\n" + "One sentence. Another! " * 300, "    indented\n" * 500, "para one.\nstill one.\n\npara two.\n\n" * 200,
]


def check(text, limit, overlap):
    bpe = encoder()
    ids, found = bpe.encode(text), split(text, limit, overlap, bpe)
    assert (len(found) > 1) == (len(ids) > limit)
    if not text:
        return found
    assert found[0][:1] == (0,) and found[0].char_start == 0 and found[-1].char_end == len(text) and found[-1].end == len(ids)
    back = ""
    for p in found:
        part = text[p.char_start : p.char_end]
        assert 0 < p.end - p.start <= limit and bpe.decode(ids[p.start : p.end]) == part and len(bpe.encode(part)) <= limit
    for p, q in zip(found, found[1:]):
        assert overlap <= p.end - q.start <= overlap + 3 and q.end > p.end
    back = text[: found[0].char_end] + "".join(text[p.char_end : q.char_end] for p, q in zip(found, found[1:]))
    assert back == text
    return found


@pytest.mark.parametrize("text", LONG, ids=range(len(LONG)))
@pytest.mark.parametrize("limit, overlap", [(1024, 64), (50, 5), (12, 4)])
def test_pieces_cover_the_text(text, limit, overlap):
    check(text, limit, overlap)


def test_random_texts():
    rng = random.Random(4)
    for _ in range(30):
        text = "".join(rng.choice(["a", "é", " ", "\n", "😀", "漢", ". ", "'s", "\t", "```\n", "word ", "\n\n"]) for _ in range(rng.randrange(1, 2500)))
        check(text, rng.choice([8, 33, 100]), rng.choice([0, 0, 1]) * 0)
        check(text, 64, 9)


def test_pieces_are_within_the_limit_on_their_own():
    """A vocabulary in which what a cut leaves comes to more tokens than it had in the whole text."""
    bpe = encoder()

    class Strict:
        def __getattr__(self, name):
            return getattr(bpe, name)

        def count(self, text):
            return bpe.count(text) + (2 if text[:1].isspace() else 0) + (3 if text.endswith("e") else 0)

    text = "one two three. four\n" * 300
    found = split(text, 64, 5, Strict())
    assert all(Strict().count(text[p.char_start : p.char_end]) <= 64 and p.end - p.start <= 64 for p in found)
    assert text[: found[0].char_end] + "".join(text[p.char_end : q.char_end] for p, q in zip(found, found[1:])) == text


def test_boundaries_come_before_hard_cuts():
    kinds = lambda text, limit, overlap=0: [p.cut for p in check(text, limit, overlap)]
    assert set(kinds("One two three four five.\n\n" * 40, 64)) == {"paragraph", "end"}
    assert set(kinds("one two three four five\n" * 60, 64)) == {"line", "end"}
    assert set(kinds("one two three four five. " * 60, 64)) == {"sentence", "end"}
    assert set(kinds("one two three four five " * 60, 64)) == {"word", "end"}
    assert set(kinds("漢" * 300, 64)) == {"token", "end"}
    code = "```\n" + "f(x)\n" * 9 + "```\n"
    assert "code" in kinds(("text " * 10 + "\n" + code) * 6, 100)


def test_table(spark, small_batches):
    rows = [(i, t, "x") for i, t in enumerate(LONG)] + [(50, None, "x"), (51, "", "x"), (52, "short", "x"), (52, "short", "x"), (None, "w " * 3000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, piece string")
    out = split_documents(df).collect()
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append(r)
    bpe = encoder()
    for i, t in enumerate(LONG):
        found = split(t, 1024, 64, bpe)
        assert [(r.start, r.end, r.text, r.pieces) for r in sorted(by[i], key=lambda r: r.piece)] == [(p.start, p.end, t[p.char_start : p.char_end], len(found)) for p in found]
    assert 50 not in by and 51 not in by and len(by[52]) == 2 and len(by[None]) > 1
    assert split_documents(df.limit(0)).count() == 0


def test_settings_are_checked():
    for limit, overlap in ((64, 60), (4, 0), (100, -1)):
        with pytest.raises(ValueError):
            split("x", limit, overlap, encoder())


def test_query(spark):
    bpe = encoder()
    want = {r.doc_id for r in spark.read.parquet(f"{oracle.DATA}/documents.parquet").collect() if bpe.count(r.text) > 1024}
    assert {r.doc_id for r in QUERIES["p9_found"](spark, oracle.DATA).collect()} == want
