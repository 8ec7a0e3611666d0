"""Problems 4 and 6: golden cases, automata against definitions, held-out accuracy."""

import random

import pytest

from studyloom.llm import pair_defects as P
from studyloom.llm import scan_repair as S

ACTIVITY = frozenset(["ncert_activity"])
Q = "Which statement about the gradual stem and its height is right?"
CASES = [
    (Q, None, "x", "empty"), (Q, "  ", "x", "empty"), (Q, "Ans:", "x", "empty"), (Q, "(blank)", "x", "empty"), (Q, "...", "x", "empty"), (Q, None, "ncert_activity", None), (Q, None, None, "empty"),
    (Q, "I'm sorry, but I must decline to solve graded work.", "x", "refusal"), (Q, "Unfortunately, we are not able to answer this request.", "x", "refusal"),
    (Q, "Regrettably this is not something I’d like to discuss.", "x", "refusal"), (Q, "There is nothing I may say about this exercise.", "x", "refusal"), (Q, "My guidelines keep me from answering.", "x", "refusal"), (Q, "Nothing may change in the sealed flask.", "x", None),
    (Q, "I am unable to lift the moss, said the gardener; the reason is its weight.", "x", None), (Q, "The acid cannot be sorted, so it is not possible to raise the rate of a salt.", "x", None),
    ("Warum?", "Bei dieser Aufgabe darf ich nicht helfen.", "x", "refusal"), (Q, f"Answer: {Q.upper()}", "x", "copy"), (Q, f"{Q}\n{Q}", "x", "copy"), (Q, f"“{Q}”: When the ion protects a lens, the change of the salt becomes round.", "x", None),
    (Q, "Wenn der Kern trocken ist, schwingt der Strahl allmählich.", "x", "language"), (Q, "यदि परिषद फैलता है तो ऊर्जा भी गीला दिखता है।", "x", "language"), (Q, "In the records the cell is called “कोशिका”, which means a pump.", "x", None),
    (Q, "The visible quark follows the", "x", "truncated"), (Q, "Every switch has a result (", "x", "truncated"), (Q, "The process absorbs the hol…", "x", "truncated"), (Q, "x = 2, y = 49", "x", None), (Q, "(b) A salt that replaces symbiosis", "x", None),
    (Q, "None of these", "x", None), (Q, "1. Lower stem\n2. Negative ovary", "x", None), (Q, "No.", "x", None), (None, "A plain answer.", "x", None), ("", "gene", "x", None), (Q, "w " * 20_000 + "end.", "x", None),
]


@pytest.mark.parametrize("prompt,response,source,want", CASES)
def test_defects(prompt, response, source, want):
    assert P.defect(prompt, response, source, ACTIVITY) == want


def test_suffix_automaton_gives_longest_runs():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 12))] for _ in range(2))
        inside = {tuple(a[i:j]) for i in range(len(a)) for j in range(i + 1, len(a) + 1)}
        want = [max((n for n in range(1, k + 2) if tuple(b[k + 1 - n : k + 1]) in inside), default=0) for k in range(len(b))]
        assert P.SuffixAutomaton(a).runs(b) == want


def test_pairs_frame(spark):
    kinds = "id string, question string, answer string, source string, defect string"
    rows = [("1", Q, None, "x", "clash"), (None, Q, None, "x", None), ("2", Q, "Yes", "x", None), ("1", Q, None, "x", "again")]
    assert [tuple(r) for r in P.pair_defects(spark.createDataFrame(rows, kinds)).collect()] == [("1", "empty")]
    assert P.pair_defects(spark.createDataFrame([], kinds)).count() == 0


WORDS = {w: 500 for w in "the orbit stayed curved population temperature predator visitor times measure network respirations because library near method and hand made change times property again friction glacier divided sharply with moss light".split()} | {"hand-made": 50}
REPAIRS = [("the timcs", "the times"), ("predat0r near", "predator near"), ("rncasure", "measure"), ("5tayed curvecl", "stayed curved"), ("a visi‐\ntor by", "a\nvisitor by")] * 3


class Judged(dict):
    """What the operator's table holds, judged on demand from a list of words."""

    def __init__(self, repairs, words, weights=True):
        self.words, self.confusions, self.model = words, S.units(repairs), S.Perceptron()
        plain = {w: n for w, n in words.items() if "-" not in w}
        look = lambda wanted: {w: words[w] for w in wanted if w in words}
        self.model.train(S.choices(repairs, plain, {w: n for w, n in words.items() if "-" in w}, self.confusions, look))
        self.model.weights = self.model.weights if weights else {}
        self.keys = {S.class_key(w, self.confusions): w for w in plain}

    def get(self, low, default=None):
        if not S.doubtful(low):
            return None
        among = {w: self.words[w] for w in [*S.candidates(low, self.confusions), self.keys.get(S.class_key(low, self.confusions), low)] if w in self.words}
        return S.choose(self.model, low, self.words.get(low, 0), list(among.items()))

    def __contains__(self, key):
        left, right = key.split("\n")
        left, mark = left[:-1], left[-1]
        joined = self.words.get(left + right, 0) or self.words.get(self.get(left + right) or "", 0)
        n = {"joined": joined, "compound": self.words.get(f"{left}-{right}", 0), "left": self.words.get(left, 0), "right": self.words.get(right, 0)}
        return self.model.score(S.join_features(left, mark, right, n)) <= 0


@pytest.fixture(scope="module")
def editor():
    return S.Editor(Judged(REPAIRS, WORDS))


MISREAD = {"timcs": "times", "0rbit": "orbit", "tempcrature": "temperature", "ternperature": "temperature", "Predat0r": "Predator", "rnethod": "method", "metb0d": "method"}


def test_editor_repairs_known_confusions_and_leaves_the_rest(editor):
    for bad, good in (MISREAD | {"light": None, "Zabish": None, "the": None, "CO2": None, "x1": None}).items():
        assert editor.repaired(bad) == good, bad
    assert S.Editor(Judged([], WORDS)).repaired("popu1ation") == "population"


def test_without_its_weights_the_perceptron_repairs_and_joins_nothing():
    blank = S.Editor(Judged(REPAIRS, WORDS, weights=False))
    assert not any(blank.repaired(bad) for bad in MISREAD)
    assert S.noise("The respir-\nations change 5tayed again.", blank, TITLE, "Biology")[0] == set()


def test_join_labels_are_learned_from_the_repairs():
    assert S.training_ends([("a visi‐\ntor by", "a\nvisitor by"), ("hand-\nmade", "hand-made"), ("No-\nNo", "No-No")]) == [("visi", "‐", "tor", True), ("hand", "-", "made", False)]


def test_words_of_one_class_share_their_key():
    c = S.units([])
    for word, bad in {"class": "c1ass", "dim": "clirn", "humble": "humb1c", "union": "iiriiori"}.items():
        assert S.class_key(word, c) == S.class_key(bad, c), word
    assert S.units([("a zat b", "a cat b"), ("zup", "cup"), ("zot", "cot")])["z"] == ["c"] and "z" not in S.units([("a zat", "a cat")])


def test_operations_rebuild_the_word():
    for a, b in [("timcs", "times"), ("betvveen", "between"), ("stayecl", "stayed"), ("abc", "abxc"), ("cat", "cats"), ("same", "same")]:
        ops = S.operations(a, b)
        assert ops is not None and S.applied(a, ops) == b
    assert S.operations("", "x") is None and S.operations("short", "something else entirely") is None


TITLE = ["lowerpancreasandtissue"]


def kinds(text, editor):
    return S.noise(text, editor, TITLE, "Biology")[0]


def test_kinds_of_noise(editor):
    assert kinds("The respir-\nations change again.", editor) == {"hyphen"} and kinds("a visi‐\ntor by", editor) == {"hyphen"} and kinds("the respir- \nations", editor) == {"hyphen"}
    assert kinds("it is hand-\nmade again", editor) == set() and kinds("the orbit 5tayed near", editor) == {"misread"}
    assert kinds("times\nChapter 3  Lower Pancreas and Tissue\nagain", editor) == {"header"} and kinds("L O W E R   P A N C R E A S   A N D   T I S S U E\nagain", editor) == {"header"}
    assert kinds("times\nBiology • Class 9\nagain", editor) == {"header"} and kinds("Lower Pancreas and Tissue    184\nagain", editor) == {"header", "page_number"}
    assert kinds("Lower Pancreas and Tissue\nIntroduction\nagain", editor) == set()
    for page in ("p. 165", "Page 48", "– 87 –", "[122]", "- 58 -", "| 202"):
        assert kinds(f"near the\n{page}\nlibrary.", editor) == {"page_number"}, page
    assert kinds("near the library.\n183\nagain", editor) == {"page_number"} and kinds("Readings in degrees:\n144\n202\n45", editor) == set()
    assert kinds("Fe + HSO → ZnSO\n4\nagain", editor) == set() and kinds("and divided by\n26.\nagain", editor) == set() and kinds("", editor) == set()


def test_paragraphs_go_on_over_lines_and_pages(editor):
    _, text = S.noise("The orbit stayed cur-\nved\nPage 48\nbecause the popu1ation\nchange.\n\n1. near\n2. again", editor, TITLE, "Biology")
    assert text == "The orbit stayed curved because the population change.\n\n1. near\n2. again"


def test_held_out_repairs(spark, sf):
    """The editor, trained on half of the repairs, undoes the misreadings of the other half, and none without its weights."""
    big = sf.replace("sf0.001", "sf0.01")
    r = spark.read.parquet(f"{big}/source_repairs.parquet")
    rows = S.cut(S.bodies(spark.read.parquet(f"{big}/chunk.parquet")))
    pairs = sorted({(x.before, x.after) for x in r.collect() if x.before and x.after})
    half = spark.createDataFrame(pairs[::2], "before string, after string")
    known = {x.form: x.repair for x in S.known_repairs(rows, half).collect()}
    counts = {x.word for x in rows.select("body", "heads").mapInArrow(S._counted, "word string, lhs string, mark string, rhs string, n long").where("mark = ''").groupBy("word").agg({"n": "sum"}).where("sum(n) > 3").collect()}
    changed = [(S.bare(a), S.bare(b)) for a, b in S.training_pairs(pairs[1::2]) if S.bare(a) != S.bare(b)]
    changed = [(a, b) for a, b in changed if b in counts and S.operations(a, b)]
    assert len(changed) > 5 and sum(known.get(a) == b for a, b in changed) >= 0.9 * len(changed)
    assert set(S.known_repairs(rows, half, weights=False).toPandas().repair) <= {S.KEPT}


@pytest.mark.parametrize("rows", [0, 10**6])
def test_small_and_large_tables_of_repairs_give_one_result(spark, sf, rows):
    chunks, repairs = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("chunk", "source_repairs"))
    got = sorted(map(str, S.repaired_chunks(chunks, repairs, broadcast_rows=rows).collect()))
    assert got == sorted(map(str, S.repaired_chunks(chunks, repairs, broadcast_rows=200_000).collect())) and len(got) > 10


def test_lines_that_a_book_prints_at_its_page_ends_are_headers(spark):
    c = "chunk_id string, text string, chapter string, subject string, source_file string"
    rows = [(f"c{n}", f"the orbit {n} stayed curved near the\nReader of Natural Lore 1{n}\nlibrary again.\nTry This Yourself\nThe moss.", None, None, "b") for n in range(4)]
    rows += [("other", "the orbit stayed curved near the\nReader of Natural Lore 17\nlibrary again.", None, None, "another")]
    r = spark.createDataFrame([], "repair_id long, chunk_id string, page int, before string, after string")
    got = {tuple(x) for x in S.found_noise(spark.createDataFrame(rows, c), r).collect()}
    assert got == {(f"c{n}", k) for n in range(4) for k in ("header", "page_number")}


def test_chunks_frame(spark):
    c = "chunk_id string, text string, chapter string, subject string, source_file string, kinds string"
    body = "the orbit stayed curved near the library because the population change times again with moss light method"
    rows = [(f"c{n}", body, "Lower Pancreas and Tissue", "Biology", "b", None) for n in range(6)]
    rows += [("h", f"{body}\nChapter 3 Lower Pancreas and Tissue\nthe popu1ation", "Unknown", "Biology", "b", "x"), ("n", None, None, None, None, None), ("e", "", None, None, "b", None), (None, "p0pulation", None, None, "b", None)]
    r = spark.createDataFrame([(1, "h", 1, "popu1ation", "population"), (2, None, None, None, "x"), (3, None, None, "x", "")], "repair_id long, chunk_id string, page int, before string, after string")
    got = {tuple(x) for x in S.found_noise(spark.createDataFrame(rows, c), r).collect()}
    assert got == {("h", "header"), ("h", "misread")}
    assert S.found_noise(spark.createDataFrame([], c), r.limit(0)).count() == 0


def test_every_chapter_of_a_merged_book_is_known(spark):
    c = "chunk_id string, text string, chapter string, subject string, source_file string"
    body = "the orbit stayed curved near the library because the population change times again"
    names = [f"{a} {b}" for a in ("Lower Pancreas and", "Bright Protein of", "Northern Gene in", "Rigid Pollen under", "Faint Petal with") for b in ("Tissue", "Bedrock", "Moonlight", "Harbours", "Climate")]
    rows = [(f"c{n} {k}", body, name, "Biology", "b") for n, name in enumerate(names) for k in range(n % 3 + 1)]
    rows += [(f"h{n}", f"{body}\n{name}    184\nthe population", "Unknown" if n % 2 else None, "Biology", "b") for n, name in enumerate(names)]
    rows += [("other", f"{body}\n{names[-1]}    184\nthe population", "Unknown", "Biology", "another book")]
    r = spark.createDataFrame([], "repair_id long, chunk_id string, page int, before string, after string")
    got = {tuple(x) for x in S.found_noise(spark.createDataFrame(rows, c), r).collect()}
    want = {(f"h{n}", k) for n in range(len(names)) for k in ("header", "page_number")}
    assert {x for x in got if x[0][0] != "c" and x[1] in ("header", "page_number")} == want


def test_long_lists_of_titles_are_searched_alike(editor):
    titles = [S.squeezed(f"{a} {b}") for a in ("Lower Pancreas", "Bright Protein", "Northern Gene", "Rigid Pollen", "Faint Petal") for b in ("Tissue", "Bedrock", "Moonlight", "Harbours", "Climate")]
    lines = ["Lower Pancreas Tissue 12", "Chapter 3 N0rthern Gene Harb0urs", "F a i n t  P e t a l  C l i m a t e", "The rigid pollen is not a header here, only prose.", "Rigid Pol1en Moonlight"]
    whole = S.furniture(lines, titles, "Biology")
    for n, line in enumerate(lines):
        one = [S.furniture([line], [t], "Biology") for t in titles]
        assert (n in whole) == any(0 in o for o in one), line
    assert {0, 1, 2} <= set(whole)
