import random

import pytest

from docindex.operators import chunking as C


def test_short_text_is_one_chunk():
    assert C.chunk_plain("hello world, this is text", least=1) == [{"chunk_no": 0, "text": "hello world, this is text", "offset_start": 0, "offset_end": 25, "section": "", "section_no": 0}]
    assert C.chunk_plain("tiny", least=5) == [] and C.chunk_plain("") == []


def test_paragraphs_are_packed_with_a_tail():
    text = "\n\n".join("p%03d " % i + "x" * 395 for i in range(30))
    chunks = C.chunk_plain(text)
    assert len(chunks) > 1 and [c["chunk_no"] for c in chunks] == list(range(len(chunks)))
    for a, b in zip(chunks, chunks[1:], strict=False):
        assert b["offset_start"] == a["offset_end"] - 4 * C.OVERLAP
    assert chunks[0]["offset_start"] == 0 and chunks[-1]["offset_end"] == len(text)
    assert all(C.tokens(c["offset_end"] - c["offset_start"]) <= C.TARGET for c in chunks)


def test_one_long_segment_is_never_cut():
    assert len(C.chunk_plain("x" * 50_000)) == 1


def test_short_buffers_are_repeated_whole():
    text = "a" * 200 + "\n\n" + "b" * 4000
    chunks = C.chunk_plain(text)
    assert [(c["offset_start"], c["offset_end"]) for c in chunks] == [(0, 202), (0, len(text))]


def test_offsets_hold_the_text():
    rng = random.Random(5)
    for _ in range(300):
        text = "".join(rng.choice(["word ", "é", "\n", "\n\n", " \n \n", "long " * 80, "# T\n"]) for _ in range(rng.randint(0, 60)))
        for kind in ("plain", "markdown", "source"):
            last = -1
            for c in C.chunks_of(kind, text, target=50, overlap=rng.choice([1, 10, 20]), least=1):
                assert c["text"] in text[c["offset_start"] : c["offset_end"]] and c["text"] == c["text"].strip()
                assert c["chunk_no"] == last + 1
                last = c["chunk_no"]


def test_markdown_sections():
    text = "intro words here\n\n# Guide\n\nintro\n\n## Setup\n\nsteps\n\n### Linux\n\napt\n\n# Other\n\nend"
    got = [(c["section"], c["section_no"]) for c in C.chunk_markdown(text, least=1)]
    assert got == [("", 0), ("Guide", 1), ("Guide > Setup", 2), ("Guide > Setup > Linux", 3), ("Other", 4)]


def test_dropped_sections_take_a_number_in_markdown_only():
    text = "# A\n\n" + "x" * 100 + "\n\n# B\n\n# C\n\n" + "y" * 100
    assert [c["section_no"] for c in C.chunk_markdown(text, least=20)] == [0, 2]
    source = "def a():\n" + "x" * 100 + "\ndef b(): 1\ndef c():\n" + "y" * 100
    assert [(c["section"], c["section_no"]) for c in C.chunk_source(source, least=20)] == [("def a():", 0), ("def c():", 1)]


def test_long_sections_share_their_number():
    text = "# Long\n\n" + "\n\n".join("y" * 390 for _ in range(30)) + "\n\n# Next\n\n" + "z" * 100
    chunks = C.chunk_markdown(text)
    assert {c["section_no"] for c in chunks if c["section"] == "Long"} == {0} and chunks[-1]["section_no"] == 1
    assert [c["chunk_no"] for c in chunks] == list(range(len(chunks)))


def test_partitions_do_not_matter(spark):
    df = spark.createDataFrame([(i, "line of words %d\n" % i * (i * 30)) for i in range(40)], "id long, text string")
    key = lambda d: sorted(map(repr, C.chunk_plain_texts(d).collect()))
    assert key(df.repartition(1)) == key(df.repartition(7))


def test_bounds():
    with pytest.raises(ValueError):
        C.checked(40, 10, 5)
    with pytest.raises(ValueError):
        C.checked(100, 100, 5)
