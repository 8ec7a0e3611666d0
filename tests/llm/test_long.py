"""Very long and odd texts take time in proportion to their length."""

import time

import pytest

from studyloom.llm import canonical, cut_texts, near_copies, pair_defects, scan_repair, text_pieces

N = 300_000
TEXTS = {
    "letters": "x" * N, "spaces": " " * N + "x", "lines": "\n" * N + "x", "dots": "." * N + "x", "quotes": '"' * N + "x", "brackets": "(" * N, "capitals": "AB CD " * (N // 6),
    "math": "𝑥" * N, "hyphens": "-\n" * (N // 2), "torn": "abc-\n" * (N // 5), "words": "word and 12) more " * (N // 18), "emoji": "👍" * N, "mixed": "a​*_" * (N // 4), "marks": "a" + "́" * N, "stars": "x" + "*" * N, "tags": "<b" * (N // 2), "options": "1) " + "a " * (N // 2), "gap": "1) a" + " " * N + "b", "many options": "1) a " * (N // 5) + "b. c", "label": "Word: " + "1 " * (N // 2) + "x y", "list": "Word: " + "ab, " * (N // 4) + "c d", "closers": "It." + ")" * N + "x",
}
EDITOR = scan_repair.Editor({"w0rd": "word"})


@pytest.mark.parametrize("name", sorted(TEXTS))
def test_time(name):
    text = TEXTS[name]
    began = time.process_time()
    cut_texts.ending(text)
    spans = text_pieces.pieces(text)
    assert "".join(text[new:end] for _, new, end in spans) == text
    scan_repair.noise(text, EDITOR, ["sometitleofabook"], "Biology", frozenset([5]))
    scan_repair.forms(text)
    pair_defects.defect("What is it about the word and more?", text, "x", frozenset())
    canonical.record("MCQ", text, text)
    near_copies.signatures([sorted(canonical.words(text, None)) or ["x"]], 442)
    assert time.process_time() - began < 15


def test_many_words():
    words = [f"w{n}" for n in range(20_000)]
    whole, parts = near_copies.signatures([words], 64)[0], near_copies.signatures([words[:9000], words[9000:]], 64)
    assert (whole == parts.min(axis=0)).all()


def test_long_words_are_judged_in_linear_time():
    word = "cl1b0" * 20_000
    began = time.process_time()
    confusions = scan_repair.units([])
    assert scan_repair.candidates(word, confusions) == [] and len(scan_repair.class_key(word, confusions)) < len(word)
    assert scan_repair.operations(word, word.replace("0", "o")).count("replaceo") == 20_000
    assert time.process_time() - began < 5
