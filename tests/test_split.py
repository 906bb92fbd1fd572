"""The splitter against a plain one that joins piece by piece, in characters and in tokens."""

import random

import pytest

from folioquery.operators import split as spl


def plain_pack(pieces, size, overlap, length):
    out, held, total = [], [], 0
    for piece in pieces:
        n = length(piece)
        if held and total + n > size:
            out.append("".join(held).strip())
            while held and (total > overlap or total + n > size):
                total -= length(held.pop(0))
        held.append(piece)
        total += n
    if held:
        out.append("".join(held).strip())
    return [c for c in out if c]


def plain_split(text, size, overlap, separators, length):
    sep = next(s for s in separators if not s or s in text)
    rest = separators[separators.index(sep) + 1:]
    pieces = list(text) if not sep else [p for p in [text.split(sep)[0], *(sep + r for r in text.split(sep)[1:])] if p]
    out, short = [], []
    for piece in pieces:
        if length(piece) < size:
            short.append(piece)
            continue
        out += plain_pack(short, size, overlap, length)
        short = []
        out += plain_split(piece, size, overlap, rest, length) if rest else [piece]
    return out + plain_pack(short, size, overlap, length)


def tokenizer():
    def opened():   # nested, so that tasks get it by value
        from tokenizers import Tokenizer, models, pre_tokenizers
        words = {"[UNK]": 0, **{c: i + 1 for i, c in enumerate("abcdefgh#|")}, **{"##" + c: i + 20 for i, c in enumerate("abcdefgh")}, "##ab": 40}
        made = Tokenizer(models.WordPiece(words, unk_token="[UNK]"))
        made.pre_tokenizer = pre_tokenizers.Whitespace()
        return made
    return opened


@pytest.mark.parametrize("separators", [spl.HEADERS_FIRST, spl.PARAGRAPHS_FIRST])
@pytest.mark.parametrize("tokens", [False, True])
def test_splits_equal_the_plain_way(separators, tokens):
    rng = random.Random(11)
    lengths_of = spl.token_lengths(tokenizer())() if tokens else spl.characters
    parts = ["ab", "abc ", "h", " ", "\n", "\n\n", "\n# ", "\n## ", "\n|", "| a |", "abababab", "c" * 30, "é"]
    several = 0
    for _ in range(400):
        text = "".join(rng.choices(parts, k=rng.randint(1, 80)))
        size = rng.choice([5, 12, 40, 200])
        overlap = rng.choice([0, 3, size // 2, size])
        got = spl.recursive_split(text, size, overlap, separators, lengths_of)
        assert got == plain_split(text, size, overlap, separators, lambda t: lengths_of([t])[0])
        several += len(got) > 1
    assert several > 150


def test_orders_and_measures_differ(spark):
    """Sections by the headings, pieces by tokens or characters."""
    docs = spark.createDataFrame([(1, "# Title\nabc abc\n\nabc\n\n| a | b |\n| c | d |\n## Next\n" + "abab " * 50)], "file_id long, value string")
    sections = spl.header_sections(docs)
    rows = lambda **o: [(r.section, r.piece_no, r.piece, r.content_type) for r in
                        spl.split_sections(sections, 12, 4, **o).orderBy("section_no", "piece_no").collect()]
    by_tokens = rows(open_lengths=spl.token_lengths(tokenizer()), separators=spl.HEADERS_FIRST)
    assert {r[3] for r in by_tokens} == {"table", "prose"} and {r[0] for r in by_tokens} == {"Title"}
    measure = spl.token_lengths(tokenizer())()
    assert max(measure([r[2] for r in by_tokens])) <= 12 < max(len(r[2]) for r in by_tokens)
    assert max(len(r[2]) for r in rows()) <= 12
