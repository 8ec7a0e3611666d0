"""Problems 2, 3, 7, 8, 9, 10 against brute force, loops and direct encoding."""

import json
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from studyloom.llm import canonical, copy_runs, corpus_tokens, cut_texts, mixing, near_copies, text_pieces

Q = "question_id string, type string, text string, payload string, extra string, k string"
TOKENIZER = pytest.mark.skipif(not os.path.exists(f"{corpus_tokens.TOKENIZERS}/byte_bpe_50k.tiktoken"), reason="no vocabulary")


def questions(seed=1, n=240):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    rows = []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(30)]
        rows.append((f"q{i:03}", "MCQ", " ".join(words), json.dumps({"question": " ".join(words), "options": ["a", "b"], "correct_option_index": 1}), None, "x"))
        if i % 3 == 0:
            edited = list(words)
            for _ in range(rng.randint(0, 6)):
                edited[rng.randrange(30)] = rng.choice(vocabulary)
            rows.append((f"e{i:03}", "MCQ", " ".join(edited).upper(), json.dumps({"options": ["b", "a"], "question": ""}), "y", None))
    hot = "the same words for a third of all rows"
    rows += [(f"h{i:03}", "matching", hot, json.dumps({"pairs": {"Key": "Value"}}), None, None) for i in range(n // 2)]
    rows += [("n1", None, None, None, None, None), ("n2", "MCQ", "", "", None, None), (None, "MCQ", hot, None, None, None), ("j1", "MCQ", "not json", "{oops", None, None), rows[0]]
    return rows


def test_words_take_values_and_keys_of_pairs_only():
    payload = json.dumps({"question": "What-is it?", "pairs": {"Left One": "Right"}, "options": ["x9", "Ünï"], "correct_option_index": 7})
    assert canonical.words("A_b", payload) == {"a", "b", "what", "is", "it", "left", "one", "right", "x9", "ünï"}
    assert canonical.words(None, None) == set() and canonical.words("x", "{bad json") == {"x", "bad", "json"}


def test_circulant_signature_equals_its_definition():
    scatter, windows = near_copies._circle(40)
    ring = windows[:, 0]
    words = ["alpha", "beta", "gamma"]
    places = scatter[near_copies.codes(words)].astype(int)
    want = [min(int(ring[(p + k) % near_copies.SIZE]) for p in places) for k in range(40)]
    assert near_copies.signatures([words], 40)[0].tolist() == want


def test_agreement_of_signatures_estimates_jaccard():
    a, b = [f"w{n}" for n in range(100)], [f"w{n}" for n in range(25, 125)]
    sig = near_copies.signatures([a, b], 2000)
    assert abs((sig[0] == sig[1]).mean() - 0.6) < 0.06


def test_near_pairs_equal_brute_force(spark):
    rows = questions()
    df = spark.createDataFrame(rows, Q).repartition(4)
    got = {tuple(r) for r in near_copies.near_pairs(df).collect()}
    sets = {i: canonical.words(t, p) for i, _, t, p, *_ in rows if i}
    ids = sorted(i for i in sets if sets[i])
    want = {(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b])}
    assert got <= want and len(got) >= 0.995 * len(want)
    links = {r.question_id: r for r in near_copies.near_links(df).collect()}
    assert links["h000"].copies == 120 and len(links) == len(ids)


def test_near_pairs_of_nothing(spark):
    assert near_copies.near_pairs(spark.createDataFrame([], Q)).count() == 0


def formats():
    p = {"question": "What is 3.5 kg?", "options": ["A b", "c"], "correct_option_index": 1}
    other = {"options": ["a  B!", "C"], "correct_option_index": 1.0, "question": "what is 35 KG"}
    rows = [("b", "MCQ", "What, is\t3.5 kg?", json.dumps(p)), ("a", "MCQ", "WHAT IS 3 5 KG", json.dumps(other, indent=2)), ("c", "matching", "what is 35 kg", json.dumps(p))]
    rows += [("d", "MCQ", "what is 35 kg", json.dumps(p | {"options": ["c", "A b"]})), ("e", "MCQ", "what is 35 kg", json.dumps(p | {"correct_option_index": 0}))]
    rows += [(f"h{n:03}", "MCQ", "Hot " + " " * n, "{}") for n in range(100)] + [("n", None, None, None), ("m", None, None, None), (None, "MCQ", "Hot", "{}"), ("a", "MCQ", "WHAT IS 3 5 KG", json.dumps(other))]
    return [(*r, None, None) for r in rows]


@pytest.mark.parametrize("partitions", [1, 2, 7])
def test_copies_by_runs(spark, partitions):
    df = spark.createDataFrame(formats(), Q)
    got = {tuple(r) for r in copy_runs.copies(df, partitions=partitions).collect()}
    assert got == {("a", "b"), ("m", "n")} | {("h000", f"h{n:03}") for n in range(1, 100)}
    counts = {r.kept_id: r.copies for r in copy_runs.representatives(df, partitions=partitions).collect()}
    assert counts == {"a": 2, "c": 1, "d": 1, "e": 1, "h000": 100, "m": 2}


def test_copies_of_nothing(spark):
    assert copy_runs.copies(spark.createDataFrame([], Q)).count() == 0


def joined(text, spans):
    return "".join(text[new:end] for _, new, end in spans)


def some_texts():
    rng = random.Random(3)
    prose = " ".join(rng.choice(["Alpha", "beta,", "gamma.", "delta?\n", "eps\n\n", "2.1.3 Heading\n"]) for _ in range(4000))
    return ["", "short", "x" * 10_000, "á́" * 5000, "👩‍🔬" * 3000, prose, " " * 7000, "one. " * 1500, "लंबा वाक्य। " * 900, "\n".join("line of some words here" for _ in range(700)), "a" * 3000, "a" * 3001]


@pytest.mark.parametrize("limit,overlap", [(3000, 200), (100, 20), (50, 0)])
def test_pieces_are_whole_small_and_overlap(limit, overlap):
    for text in some_texts():
        spans = text_pieces.pieces(text, limit, overlap)
        assert joined(text, spans) == text
        assert all(end - start <= limit and new - start <= overlap for start, new, end in spans)
        assert (len(spans) > 1) == (len(text) > limit)


def test_cuts_lie_at_the_coarsest_boundary():
    text = "First part. " * 20 + "\n2.1 Second\n" + "More words here. " * 14
    spans = text_pieces.pieces(text, 300, 20)
    assert any(text[new:end].startswith("2.1 Second") for _, new, end in spans)
    assert all(text[new - 1].isspace() for _, new, _ in spans[1:])
    family = "👨‍👩‍👧" * 400
    assert all(text_pieces._glued(family, new) is False for _, new, _ in text_pieces.pieces(family, 300, 0)[1:])


def test_numbering_makes_room(spark):
    kinds = "chunk_id string, class string, subject string, source_file string, chapter string, topic string, topic_number string, chunk_index int, text string, extra int"
    rows = [(f"c{n}", "7", "S", "f", "C", "T", None, n, "w " * (2000 if n in (1, 3000) else 5), n) for n in (0, 1, 2, 2999, 3000, 3001)]
    rows += [rows[1], ("n", None, None, None, None, None, None, None, None, None)]
    got = {}
    for r in text_pieces.renumbered(spark.createDataFrame(rows, kinds)).collect():
        got.setdefault(r.chunk_id, []).append(r.new_index)
    assert {k: sorted(v) for k, v in got.items()} == {"c0": [0], "c1": [1, 2], "c2": [3], "c2999": [3000], "c3000": [3001, 3002], "c3001": [3003], "n": [0]}
    assert {r.chunk_id for r in text_pieces.oversized(spark.createDataFrame(rows, kinds)).collect()} == {"c1", "c3000"}


def corpus():
    rng = random.Random(5)
    shared = "".join(rng.choice(["the quick ", "brown fox's ", "jumps, over\n", "42 dogs!  ", "we'll ", "नमस्ते दुनिया ", "🙂 "]) for _ in range(900))
    texts = [None, "", " ", "a", "x" * 30_000, shared, shared + "tail", "head " + shared, shared[3000:] * 3, "=" * 9000 + "\n" + shared, "\n" * 20_000, "क" * 9000, "ab'" * 8000, " " * 9000 + "x"]
    return [(n, t, None) for n, t in enumerate(texts)] + [(100 + n, None if n % 2 else "same small text", "y") for n in range(120)] + [(5, shared, "twice")]


@TOKENIZER
def test_ids_equal_direct_encoding(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string, row string").repartition(3)
    enc, _ = corpus_tokens.encoder(corpus_tokens.TOKENIZERS)
    got = sorted((r.doc_id, list(r.ids)) for r in corpus_tokens.corpus_ids(df, least_hot=10).collect())
    assert got == sorted((i, enc.encode_ordinary(t) if t else []) for i, t, _ in rows)
    assert corpus_tokens.corpus_ids(df.limit(0)).count() == 0


@TOKENIZER
def test_any_chunking_joins_to_the_same_ids():
    enc, values = corpus_tokens.encoder(corpus_tokens.TOKENIZERS)
    rng = random.Random(9)
    alphabet = ["a", "b ", " ", "\n", "'", "l", "re", "9", "é", "क", "🙂", " ", "\t", ".", "  "]
    for _ in range(400):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60)))
        cuts = sorted(rng.sample(range(1, len(text)), min(len(text) - 1, rng.randint(0, 5)))) if len(text) > 1 else []
        parts = [np.array(enc.encode_ordinary(text[a:b]), np.int64) for a, b in zip([0, *cuts], [*cuts, len(text)])]
        assert corpus_tokens.joined_ids(parts, enc, values).tolist() == enc.encode_ordinary(text), repr(text)


@TOKENIZER
def test_endless_white_space(spark):
    enc, _ = corpus_tokens.encoder(corpus_tokens.TOKENIZERS)
    for run in (" " * 25_000, "\n" * 25_000, " \n\t" * 9_000, "\u2003" * 25_000):
        for text in ("a" + run, "a" + run + "b", run + ".", "é" + run + "9" + run + " c"):
            assert corpus_tokens.encode(enc, text) == enc.encode_ordinary(text)
    docs = spark.createDataFrame([(1, "a" + " " * 1_500_000 + "b")], "doc_id long, text string")
    ids = corpus_tokens.corpus_ids(docs).first().ids
    assert enc.decode(ids) == docs.first().text


def test_chunks_follow_the_content():
    rng = random.Random(2)
    data = bytes(rng.randrange(97, 123) for _ in range(60_000))
    cut = lambda d: {d[a:b] for a, b in zip([0, *corpus_tokens.chunk_ends(d)], corpus_tokens.chunk_ends(d))}
    assert len(cut(data) & cut(b"inserted" + data)) > 0.8 * len(cut(data))
    assert all(len(c) <= corpus_tokens.MOST for c in cut(data))


def test_pouring_and_temperature():
    base, most = {"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 0.2, "b": 9, "c": 9}
    w = mixing.poured(base, most, 1.0)
    assert w["a"] == 0.2 and abs(sum(w.values()) - 1) < 1e-9 and abs(w["b"] / w["c"] - 1.5) < 1e-9
    free = dict.fromkeys(base, 9.0)
    flat, exponent = mixing.temperature(base, free, 1.05)
    assert abs(mixing.entropy(flat) - 1.05) < 1e-6 and 0 < exponent < 1
    assert sum(mixing.poured(base, dict.fromkeys(base, 0.1), 1.0).values()) == pytest.approx(0.3)
    bound, e = mixing.temperature(base, {"a": 9, "b": 9, "c": 0.25}, None)
    assert bound["c"] <= 0.25 + 1e-6 and e > 0


@TOKENIZER
def test_what_exhausted_sources_leave_is_tempered():
    shares, targets = {"a": 0.5, "b": 0.3, "c": 0.15, "d": 0.05}, {"a": 0.3, "b": 0.2, "c": 0.2, "d": 0.3}
    most = {"a": 9.0, "b": 9.0, "c": 0.15, "d": 0.1}
    w, e = mixing.tempered_rest(targets, shares, most)
    assert w["c"] == 0.15 and w["d"] == pytest.approx(0.1) and sum(w.values()) == pytest.approx(1) and all(w[s] >= min(targets[s], most[s]) - 1e-9 for s in w)
    wanted = mixing.entropy(mixing.poured(targets, most, 1.0))
    others = [abs(mixing.entropy(mixing.tempered_rest(targets, shares, most, x)[0]) - wanted) for x in (-4, -1, 0, 0.5, 1, 2, 4, 8)]
    assert abs(mixing.entropy(w) - wanted) <= min(others) + 1e-9
    assert mixing.tempered_rest(targets, shares, most, 0.0)[0] != mixing.tempered_rest(targets, shares, most, 2.0)[0]  # the exponent decides
    reachable = {"a": 0.45, "b": 0.4, "c": 0.05, "d": 0.1}
    w, e = mixing.tempered_rest(reachable, shares, {"a": 9.0, "b": 0.3, "c": 9.0, "d": 9.0})
    assert mixing.entropy(w) == pytest.approx(mixing.entropy(mixing.poured(reachable, {"a": 9.0, "b": 0.3, "c": 9.0, "d": 9.0}, 1.0)), abs=0.02)
    assert mixing.tempered_rest(targets, shares, dict.fromkeys(shares, 9.0)) == (targets, 0.0)


def test_mix_without_targets_is_tempered_alone(spark):
    docs = spark.createDataFrame([(n, "word " * 20, "big" if n < 400 else "mid" if n < 500 else "small") for n in range(520)], "doc_id long, text string, source string")
    targets = spark.createDataFrame([("big", None, 1), ("mid", None, 2), ("small", None, 2)], "source string, target_share double, max_repeats int")
    report = {r.source: r for r in mixing.mix(docs, targets, budget=6000)[1].collect()}
    assert report["small"].most_uses == 2 and 0 < report["big"].exponent < 1 and report["big"].actual_share > report["mid"].actual_share > report["small"].actual_share
    even = {r.source: r for r in mixing.mix(docs, targets, budget=2000, wanted_entropy=1.0)[1].collect()}
    shares = {s: r.actual_share for s, r in even.items()}
    assert abs(mixing.entropy(shares) - 1.0) < 0.05


def test_mix_meets_targets_and_limits(spark):
    rows = [(n, "word " * 20, "big" if n < 600 else "small" if n < 640 else None if n == 640 else "other", None) for n in range(700)] + [(900, None, "big", None), (901, "", "small", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, tokens string")
    targets = spark.createDataFrame([("big", 0.6, 1), ("small", 0.3, 3), ("absent", 0.1, 2), (None, 0.5, 1)], "source string, target_share double, max_repeats int")
    mixed, report = mixing.mix(docs, targets, budget=6000)
    shares = {r.source: r.actual_share for r in report.collect()}
    assert abs(shares["big"] / shares["small"] - 2) < 0.15 and shares["absent"] == 0
    uses = mixed.groupBy("source").agg(F.max("uses").alias("u")).collect()
    assert all(r.u <= {"big": 1, "small": 3}[r.source] for r in uses)
    exact = {r.source: r for r in mixing.mix(docs, targets, exact=True)[1].collect()}
    assert exact["small"].most_uses == 3 and abs(exact["big"].actual_share - 2 / 3) < 0.02
    assert mixing.mix(docs.limit(0), targets)[0].count() == 0


WHOLE = ["It ends here.", "Is it?", 'He said, "Go."', "One.\n- item", "Text.\nScore 12/40", "Done.\n\n\n", "Fine.*", "Ja. (Siehe Fig. 7.1.)", "यह पूरा है।", "Line.\nTotal: 5 marks", "| a | b |", "Good.\n(See Fig.\r\n7.5)", "", "   ", "Over.\n👍"]
CUT = ["It was not don", "First. Then the", 'Yes. "Keep it," said', "about 711.", "We see, e.g.", "The end of...", "It was tr…", "Some text <b", "Tea &am", "See the lake [more]", "Fine. Step 2. Now (12 m) was", "Step 5.", "ends in half a ch�"]


def test_endings():
    assert [t for t in WHOLE if cut_texts.ending(t)[0] == 2] == []
    assert [t for t in CUT if cut_texts.ending(t)[0] != 2] == []


def test_limits_are_found_and_smooth_lengths_are_not(spark):
    rng = random.Random(8)
    rows = [(n, "x" * rng.randint(80, 900) + ".", "even", None) for n in range(1500)]
    for n in range(400):
        t = "word " * rng.randint(10, 60)
        rows.append((2000 + n, t[:200] if len(t) > 200 else t.strip() + ".", "field", None))
    rows += [(9000, None, "field", None), (9001, "", None, None), (9002, "- half", "field", None), (None, "It was", "even", None), (9003, "A" * 4 + "\n- i" + "t" * 192, "field", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, level int")
    found = {(r.source, r.length) for r in cut_texts.limits(cut_texts.measured(df)).collect()}
    assert ("field", 200) in found and not any(s == "even" for s, _ in found)
    cut = {r.doc_id for r in cut_texts.cut_documents(df).collect()}
    want = {i for i, t, *_ in rows if i and t and 2000 <= i < 3000 and not t.endswith(".")}
    assert want <= cut and 9003 in cut and 9002 not in cut and None not in cut
    assert cut_texts.cut_documents(df.limit(0)).count() == 0
