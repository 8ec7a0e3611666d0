"""Problem 4: noise in text from scanned pages.

Method. An averaged perceptron edits characters: for each character of a word it scores keep, replace by c, delete and insert c, and for each
hyphen mark at a line end join or keep. A word's possible repairs are those that undo a confusion (learned from source_repairs, with
`COMMON`), alone, or several that lead to a frequent word; a repair's score is the sum, over its edited characters, of the perceptron's score of the edit
less that of keep, plus that of features of the two words in the corpus (how much more frequent the repaired one is); the best one is taken if
its score is above that of leaving the word alone, 0. Without weights nothing is repaired.

Training. The words and line ends of source_repairs, aligned by edit operations, at most `TRAIN_ROWS` of the repairs (a bound for the driver, chosen by
a hash). A word that stays as it was teaches keep, unless a possible repair is over `UNSURE` times as frequent: repairs mend one place
and leave others. To these come the `FREQUENT` most frequent words of the corpus as they are, damaged by each confusion that
fits, and split; and up to `FREQUENT` compounds the corpus prints in a line, as line ends to be kept.

Running headers and page numbers are removed by features of a line: what share of it is a chapter's title of the book, letter spacing, numbers
attached to it, the lines around it; and by its position on the page: a line that a book prints in three chunks or more, mostly between the two halves of a torn
sentence, is a running header whatever it says.

Scale. Each chunk is read for furniture once and its body kept (checkpoint). Words, line ends and header lines are counted by partial aggregation, over all
chunks; each distinct word is judged once: its possible repairs are joined with the full word counts, by key, so no word list is held
anywhere and none is cut. The resulting table (word -> repair, line end -> keep) goes back to the texts: as a broadcast while it has at most
`broadcast_rows` rows, else by a join on the words of the texts. Both give the same result. The chapters and header lines of a book are
joined to its chunks by source_file, as one array that grows with the book's chapters.

Defined results: NULL and empty texts have no noise; chunks of one id are one chunk, with the noise of all their rows; repairs without
`before` or `after`, stale or repeated ones only add to (or do nothing for) the training; without repairs the confusions of
`COMMON` are used; an empty table gives no rows.
"""

from __future__ import annotations

import difflib
import functools
import math
import re
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studyloom.session import cut, spread

TRAIN_ROWS = 4000
FREQUENT = 400
UNSURE = 20
SALTS = 16  # parts of a book's rows
LONG = 64  # characters; of longer words only whole class keys are compared, in linear time
KNOWN = 3  # chunks that must have a word before it can be a repair's result
HYPHENS = "-‐‑¬­"
#: fixed values: frequent confusions of printed letters, (as read, as printed)
COMMON = (("0", "o"), ("1", "l"), ("5", "s"), ("9", "g"), ("c", "e"), ("†", "t"), ("!", "i"), ("cl", "d"), ("rn", "m"), ("vv", "w"), ("ii", "u"), ("ri", "n"), ("b", "h"))
# a token: letters with the signs that stand for misread ones inside or around them
TOKEN = re.compile(r"[†!|]?[^\W_]+(?:[†!|]+[^\W_]+)*†?")
LINE_END = re.compile(rf"[{HYPHENS}][^\S\n]*\n[^\S\n]*(?=[^\W_])")
HEAD = re.compile(r"[^\W_†!|]+(?:[†!|][^\W_]+)*")
COMPOUND = re.compile(r"(?<![^\W\d_])[^\W\d_]+-[^\W\d_]+")
ALPHA = re.compile(r"[^\W\d_]+")
KEPT = ""  # the repair of a line end whose hyphen stays


class Perceptron:
    """Averaged perceptron over (label, feature) weights, trained on choices: lists of features of the alternatives, and which is right."""

    def __init__(self):
        self.weights: dict[str, float] = {}
        self._totals: dict[str, float] = defaultdict(float)
        self._stamps: dict[str, int] = defaultdict(int)
        self._step = 0

    def score(self, features: list[tuple[str, float]]) -> float:
        get = self.weights.get
        return sum(get(f, 0.0) * by for f, by in features)

    def _change(self, features: list[tuple[str, float]], by: float) -> None:
        for f, times in features:
            now = self.weights.get(f, 0.0)
            self._totals[f] += (self._step - self._stamps[f]) * now
            self._stamps[f] = self._step
            self.weights[f] = now + by * times

    def train(self, choices: list[tuple[list[list[tuple[str, float]]], int]], rounds: int = 8, margin: float = 1.0) -> None:
        """The right alternative must be ahead of every other by `margin`."""
        for _ in range(rounds):
            for alternatives, right in choices:
                self._step += 1
                scores = [self.score(a) for a in alternatives]
                rival = max((n for n in range(len(scores)) if n != right), key=lambda n: scores[n], default=None)
                if rival is not None and scores[right] < scores[rival] + margin:
                    self._change(alternatives[right], 1.0)
                    self._change(alternatives[rival], -1.0)
        for f, w in list(self.weights.items()):
            total = self._totals[f] + (self._step - self._stamps[f]) * w
            self.weights[f] = total / max(1, self._step)


def features(word: str, at: int) -> list[str]:
    """Of one character in its word: itself, its neighbours, and the kinds around it."""
    w = f"\x02{word}\x03"
    k = at + 1
    c, left, right = w[k], w[k - 1], w[k + 1]
    further = w[k + 2] if k + 2 < len(w) else ""
    kind = lambda x: "d" if x.isdigit() else "a" if x.isalpha() else "e" if x in "\x02\x03" else "s"
    return [
        f"c{c}",
        f"l{left}{c}",
        f"r{c}{right}",
        f"b{left}{c}{right}",
        f"R{c}{right}{further}",
        f"k{kind(left)}{c}{kind(right)}",
        f"w{c}{'a' if any(x.isalpha() for x in word) else 'n'}",
    ]


def operations(before: str, after: str) -> list[str] | None:
    """An operation for each character of `before` that turn it into `after`; None if they differ too much."""
    if not before or abs(len(before) - len(after)) > 3:
        return None
    if len(before) > LONG:  # in time proportional to the length
        return [("keep" if a == b else f"replace{b}") for a, b in zip(before, after)] if len(before) == len(after) else None
    ops = ["keep"] * len(before)
    for tag, a, b, c, d in difflib.SequenceMatcher(None, before, after, autojunk=False).get_opcodes():
        if tag == "equal":
            continue
        new = after[c:d]
        if tag == "insert":
            if not a or len(new) > 1:
                return None
            ops[a - 1] = f"insert{new}"
            continue
        for n in range(a, b):
            ops[n] = f"replace{new[n - a]}" if n - a < len(new) else "delete"
        if len(new) > b - a:
            if len(new) - (b - a) > 1 or ops[b - 1] == "delete":
                return None
            ops[b - 1] += new[-1]  # replace by two
    return None if sum(o != "keep" for o in ops) > max(3, len(before) // 2) else ops


def applied(word: str, ops: list[str]) -> str:
    out = []
    for c, op in zip(word, ops):
        if op == "keep":
            out.append(c)
        elif op.startswith("replace"):
            out.append(op[7:])
        elif op.startswith("insert"):
            out.append(c + op[6:])
    return "".join(out)


def training_pairs(repairs: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """Words as printed and as repaired, from aligned texts; unchanged words too."""
    pairs = []
    for before, after in repairs:
        a = [x for x in re.split(r"\s+", _joined(before)) if x]
        b = [x for x in re.split(r"\s+", _joined(after)) if x]
        for tag, i, j, k, m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
            if tag == "equal" or (tag == "replace" and j - i == m - k):
                pairs.extend(zip(a[i:j], b[k:m]))
    return pairs


def training_ends(repairs: list[tuple[str, str]]) -> list[tuple[str, str, str, bool]]:
    """(left, mark, right, whether it was joined) of the line ends with a hyphen mark, small letters."""
    out = []
    for before, after in repairs:
        low = after.lower()
        for left, mark, right in line_ends(before):
            if left + right in low:
                out.append((left, mark, right, True))
            elif f"{left}-{right}" in low or f"{left}{mark}{right}" in low:
                out.append((left, mark, right, False))
    return out


def _joined(text: str) -> str:
    return re.sub(rf"(?<=\w)[{HYPHENS}][^\S\n]*\n[^\S\n]*", "", text)


def _ends(text: str):
    """(start of the left half, end of it, start of the right half, left, mark, right) of each line end with a hyphen mark that may split a word."""
    kept = 0
    for m in LINE_END.finditer(text):
        start = at = m.start()
        while at > kept and (text[at - 1].isalnum() or text[at - 1] in "†!|"):
            at -= 1
        kept = m.end()
        left, head = text[at:start], HEAD.match(text, m.end())
        if head and ALPHA.search(left) and not (head.group(0)[0].isalpha() and not head.group(0)[0].islower() and head.group(0)[0].isupper()):
            yield at, start, m.end(), left, text[start], head.group(0)


def line_ends(text: str) -> list[tuple[str, str, str]]:
    return [(left.lower(), mark, right.lower()) for *_, left, mark, right in _ends(text)]


def units(repairs: list[tuple[str, str]]) -> dict[str, list[str]]:
    """What characters were misread for, by the characters read; an alignment's accident (under three times) isn't a confusion."""
    seen = Counter(dict.fromkeys(COMMON, 3))
    for before, after in dict.fromkeys(training_pairs(repairs)):
        core, goal = bare(before), bare(after)
        if core == goal or operations(core, goal) is None:
            continue
        for tag, i, j, k, m in difflib.SequenceMatcher(None, core, goal, autojunk=False).get_opcodes():
            if tag == "replace":
                seen[core[i:j], goal[k:m]] += 1
    out = defaultdict(list)
    for (read, printed), n in sorted(seen.items()):
        if n > 2 and len(read) < 4:
            out[read].append(printed)
    return dict(out)


def bare(word: str) -> str:
    return word.strip(".,;:?\"“”()").lower()


def doubtful(word: str) -> bool:
    """Whether a small-letter word can be a misreading at all: three characters with a letter, two if there are digits or signs."""
    letters = sum(c.isalpha() for c in word)
    return len(word) > 2 and letters > (not word.isalpha())


def candidates(word: str, confusions: dict[str, list[str]]) -> list[str]:
    """The word with each confusion undone, alone."""
    out: list[str] = []
    if len(word) > LONG:
        return out
    for k in range(len(word)):
        for size in (1, 2, 3):
            if k + size <= len(word):
                out.extend(word[:k] + printed + word[k + size :] for printed in confusions.get(word[k : k + size], ()))
    return [w for w in dict.fromkeys(out) if len(w) > 2 and w.isalpha() and w != word]


def class_key(word: str, confusions: dict[str, list[str]]) -> str:
    """The word with all confusions undone at once, signs and digits first, then the longest: words that differ only by confusions share it."""
    signs = {a: b[0] for a, b in confusions.items() if len(a) == 1 and not a.isalpha()}
    word = "".join(signs.get(c, c) for c in word)
    out, k = [], 0
    while k < len(word):
        for size in (3, 2):
            if word[k : k + size] in confusions and k + size <= len(word):
                out.append(confusions[word[k : k + size]][0])
                k += size
                break
        else:
            out.append(word[k])
            k += 1
    return "".join(confusions.get(c, (c,))[0] if c.isalpha() else c for c in out)


def steps(name: str, value: float, low: int, high: int) -> list[tuple[str, float]]:
    """A feature for each whole number that a value reaches: what holds of less holds of more."""
    return [(f"{name}>{n}", 1.0) for n in range(low, high + 1) if value >= n]


def repair_features(word: str, n: int, better: str, m: int) -> list[tuple[str, float]] | None:
    """Of the edit from `word` (in n chunks) to `better` (in m): each edited character's features for its operation, less those for keep, and the
    two words' frequencies; None if it is no edit of single characters."""
    ops = operations(word, better)
    if ops is None:
        return None
    out = []
    for k, op in enumerate(ops):
        if op != "keep":
            for f in features(word, k):
                out += [(f"{op}|{f}", 1.0), (f"keep|{f}", -1.0)]
    kind = "word" if word.isalpha() else "odd"
    ratio = math.log2((m + 0.5) / (n + 0.5))
    out += [(f"edit|{kind}", 1.0), *steps(f"ratio|{kind}", ratio, -2, 12), *steps("known", math.log2(m + 1), 1, 4), *steps(f"own|{kind}", math.log2(n + 1), 1, 8)]
    return out


def join_features(left: str, mark: str, right: str, n: dict[str, int]) -> list[tuple[str, float]]:
    """Of a line end; n: chunks that have the joined word (as it is or repaired), the compound, and each half."""
    ratio = math.log2((n.get("joined", 0) + 0.5) / (n.get("compound", 0) + 0.5))
    halves = int(n.get("left", 0) > 1) + int(n.get("right", 0) > 1)
    state = f"{'j' if n.get('joined', 0) else ''}{'c' if n.get('compound', 0) else ''}{halves}"
    return [("join", 1.0), (f"join|{mark == '-'}", 1.0), (f"join|{mark}", 1.0), (f"join|{state}", 1.0), (f"join|{mark == '-'}{state}", 1.0), *steps("join|ratio", ratio, -6, 6)]


class Editor:
    """What is known of words and line ends: `repairs` has the repair of each misread small-letter word, and KEPT for line ends to be kept."""

    def __init__(self, repairs: dict[str, str]):
        self.repairs = repairs

    def repaired(self, token: str) -> str | None:
        """The word the token was misread from; None if it is as it should be."""
        low = token.lower()
        if len(token) < 5 and token[1:] != low[1:]:
            return None  # formulas and codes
        found = self.repairs.get(low)
        if not found:
            return None
        letters = [c for c in token if c.isalpha()]
        if len(letters) > 1 and all(c.isupper() for c in letters):
            return found.upper()
        return found[:1].upper() + found[1:] if token[:1].isupper() else found

    def joins(self, left: str, mark: str, right: str) -> bool:
        return end_key(left.lower(), mark, right.lower()) not in self.repairs


def end_key(left: str, mark: str, right: str) -> str:
    return f"{left}{mark}\n{right}"


def squeezed(line: str) -> str:
    """Letters of a line, lower case, for comparison with a title."""
    return "".join(ALPHA.findall(unicodedata.normalize("NFKC", line).lower()))


# a line of a number alone, or behind a word for page; possessive, so that long runs of signs take no longer
PAGE_LINE = re.compile(r"[\W_]*+(?:(?:page|pg|p|seite|s|पृष्ठ)[\W_]*+)?\d{1,4}[\W_]*+", re.IGNORECASE)
PAGE_STYLE = re.compile(r"^\W*(?:page|pg|p)\b\.?\s*\d{1,4}\W*$|^[\[(–—\-|]\s*\d{1,4}\s*[\])–—\-|]$|^\|\s*\d{1,4}$|^\d{1,4}\s*\|$", re.IGNORECASE)
READINGS = re.compile(r":\s*$")
NUMBER = re.compile(r"^\s*\d[\d.,]*\s*$")
FORMULA = re.compile(r"[→⇌=](?![^→⇌=]*[.!?]$)|(?:\b[A-Z][a-z]?\d*){2,}\s*$|\b(?:[A-Z][a-z]?){2,}\b[^a-z]*$")


def _same(a: str, b: str, least: float = 0.86) -> bool:
    """Whether the ratio of equal characters is at least `least`; its upper bounds are asked first."""
    m = difflib.SequenceMatcher(None, a, b, autojunk=False)
    return m.real_quick_ratio() >= least and m.quick_ratio() >= least and m.ratio() >= least


def furniture(lines: list[str], titles: list[str], subject: str, recurring: frozenset[int] = frozenset()) -> dict[int, set[str]]:
    """Line number -> {header, page_number} of the lines that are a page's furniture. titles: squeezed titles of the book; recurring: keys of
    the squeezed lines that the book prints again and again where its pages end."""
    out: dict[int, set[str]] = {}
    intro = next((n for n, x in enumerate(lines[:4]) if x.strip().lower() == "introduction"), None)
    filler = {squeezed(subject or ""), "chapter", "unit", ""}
    if squeezed(subject or ""):
        titles = [*titles, f"{squeezed(subject)}class"]
    known = tuple(titles)
    for n, line in enumerate(lines):
        bare = line.strip()
        if not bare:
            continue
        letters = squeezed(bare)
        if letters and titles:
            for title in _near(letters, known):
                if not title or len(letters) < len(title) - 2 or len(letters) > len(title) + 24:
                    continue
                if intro is not None and n == intro - 1 and letters == title and not any(c.isdigit() for c in bare):
                    break  # the chapter's own title
                at = letters.find(title)
                rest = letters[:at] + letters[at + len(title) :] if at >= 0 else None
                if rest is None:
                    tail = letters
                    for f in filler:
                        if f and tail.startswith(f) and len(tail) > len(f) + 3:
                            tail = tail[len(f) :]
                    close = False
                    if _alike(tail, title) or _alike(letters, title):
                        plain = "".join(c for c in bare.lower() if c.isalnum() or c in "†!")
                        close = _same(tail, title) or _same(plain, title)
                    if close and (intro is None or n != intro - 1 or bare.upper() == bare):
                        rest = ""
                if rest is not None and (rest in filler or len(rest) <= 12 and not UNPROSE.search(bare)):
                    kinds = out.setdefault(n, set())
                    kinds.add("header")
                    numbered = re.sub(r"(?i)\b(?:chapter|unit|c[l1]ass)\s+\d{1,3}\b", " ", bare)
                    if re.search(r"^\W*\d{1,4}\s+\D|[\s|–—\-\[(]\d{1,4}\W*$", numbered):
                        kinds.add("page_number")
                    break
        if n in out:
            continue
        if recurring and (intro is None or n > intro) and len(letters) > 5 and line_key(letters) in recurring and not UNPROSE.search(bare):
            out[n] = {"header", "page_number"} if re.search(r"^\W*\d{1,4}\s+\D|[\s|–—\-\[(]\d{1,4}\W*$", bare) else {"header"}
        elif bare[-1] not in ".!?" and PAGE_LINE.fullmatch(bare) and _stands_alone(lines, n, out):
            out[n] = {"page_number"}
    return out


def torn_around(lines: list[str], n: int) -> bool:
    """Page position: whether a line stands where one page ends and the next begins, inside a sentence that goes on behind it."""
    before = next((x.rstrip() for x in reversed(lines[:n]) if x.strip()), "")
    after = next((x.lstrip() for x in lines[n + 1 :] if x.strip()), "")
    return bool(before and after) and before[-1] not in ".!?:।|" and after[0].islower()


@functools.lru_cache(maxsize=16)
def _pairs(titles: tuple[str, ...]) -> tuple[dict[str, int], np.ndarray, np.ndarray]:
    """(number of each pair of letters, which titles have it, how many pairs each title has)."""
    pairs = [{t[n : n + 2] for n in range(len(t) - 1)} for t in titles]
    number = {p: n for n, p in enumerate(sorted(set().union(*pairs)))}
    have = np.zeros((len(number), len(titles)), np.uint8)
    for n, own in enumerate(pairs):
        have[[number[p] for p in own], n] = 1
    return number, have, np.array([len(own) for own in pairs])


def _near(line: str, titles: tuple[str, ...]) -> list[str] | tuple[str, ...]:
    """The titles that a line can hold or resemble (see _alike), in their order; short lists are not searched."""
    if len(titles) <= 16:
        return titles
    number, have, sizes = _pairs(titles)
    rows = [number[p] for p in {line[n : n + 2] for n in range(len(line) - 1)} if p in number]
    return [titles[n] for n in np.flatnonzero(have[rows].sum(0, dtype=np.int64) * 3 >= sizes)]


def _alike(line: str, title: str) -> bool:
    """Whether they share a third of the title's pairs of letters: cheap, before the exact comparison."""
    pairs = _letter_pairs(title)
    return sum(p in line for p in pairs) * 3 >= len(pairs)


@functools.lru_cache(maxsize=4096)
def _letter_pairs(title: str) -> frozenset[str]:
    return frozenset(title[n : n + 2] for n in range(len(title) - 1))


UNPROSE = re.compile(r"[.!?;,]\s|[.!?]$")


def _stands_alone(lines: list[str], n: int, out: dict[int, set[str]]) -> bool:
    """Whether a line that may be a page number is none of a list of readings, a formula's digits or a sentence's end."""
    bare = lines[n].strip()
    if PAGE_STYLE.match(bare):
        return True
    if not re.fullmatch(r"\d{1,4}", bare):
        return False
    if n - 1 in out and not (n + 1 < len(lines) and NUMBER.match(lines[n + 1])):
        return True  # under a header line
    k = n - 1
    while k >= 0 and NUMBER.match(lines[k]):
        k -= 1
    head = lines[k].strip()[-200:] if k >= 0 else ""
    if READINGS.search(head) or (k < 0 and n + 1 < len(lines) and NUMBER.match(lines[n + 1])) or n - k > 1:
        return False
    if n + 1 < len(lines) and NUMBER.match(lines[n + 1]):
        return False
    return not FORMULA.search(head)


def noise(
    text: str, editor: Editor, titles: list[str], subject: str, recurring: frozenset[int] = frozenset()
) -> tuple[set[str], str]:
    """(kinds of noise, repaired continuous paragraphs)."""
    kinds, body, heads = parted(text, titles, subject, recurring)
    return edited(kinds, body, heads, editor)


def parted(text: str, titles: list[str], subject: str, recurring: frozenset[int]) -> tuple[set[str], str, str]:
    """(kinds of furniture, the text without it, its header lines)."""
    lines = text.split("\n")
    found = furniture(lines, titles, subject, recurring)
    body = "\n".join(x for n, x in enumerate(lines) if n not in found)
    return {k for v in found.values() for k in v}, body, "\n".join(lines[n] for n in found if "header" in found[n])


def edited(kinds: set[str], body: str, heads: str, editor: Editor) -> tuple[set[str], str]:
    kinds = set(kinds)
    if any(editor.repaired(t) for t in TOKEN.findall(heads)):
        kinds.add("misread")
    out: list[str] = []
    kept = 0
    for _, start, end, left, mark, right in _ends(body):
        if editor.joins(left, mark, right):
            kinds.add("hyphen")
            out.append(body[kept:start])
            kept = end
    joined = "".join(out) + body[kept:]

    def fix(m: re.Match) -> str:
        better = editor.repaired(m.group(0))
        if better is None:
            return m.group(0)
        kinds.add("misread")
        return better

    if any(editor.repairs.get(t) for t in set(TOKEN.findall(joined.lower()))):
        joined = TOKEN.sub(fix, joined)
    return kinds, paragraphs(joined)


def paragraphs(text: str) -> str:
    """Printed lines put together: a line goes on in the next unless it ends a sentence before a capital, or either is an item,
    heading or row of its own."""
    out: list[str] = []
    for line in text.split("\n"):
        bare = line.strip()
        if not bare:
            out.append("")
            continue
        if (
            out
            and out[-1]
            and not re.match(r"^(?:[|•*]|[-–—] |\d+[.)]\s|\d+(?:\.\d+)+|\(?[a-z]\)|Activity\b)", bare)
            and out[-1][-1] not in ":|"
            and (out[-1][-1] not in ".!?।:\"”)|]" or not bare[0].isupper() or len(out[-1]) > 50)
            and not NUMBER.match(bare)
        ):
            out[-1] += " " + bare
        else:
            out.append(bare)
    return re.sub(r"\n{3,}", "\n\n", "\n".join(out)).strip()


def forms(text: str) -> tuple[set[str], list[tuple[str, str, str]]]:
    """(small-letter words and compounds, torn ones aside; the line ends) of a text."""
    low = text.lower()
    flat = re.sub(rf"[{HYPHENS}][^\S\n]*\n\s*\S+", " ", low)  # torn words don't count
    compounds = {c for w in set(flat.split()) if "-" in w for c in COMPOUND.findall(w)}
    return {w for w in set(TOKEN.findall(flat)) if len(w) > 2} | compounds, line_ends(text)


def _counted(batches):
    """(word, '', '', '', chunks) and (word if joined, left, mark, right, chunks)."""
    for batch in batches:
        words: Counter = Counter()
        ends: Counter = Counter()
        for body, heads in zip(*(batch.column(n).to_pylist() for n in (0, 1))):
            found, torn = forms(body or "")
            words.update(found | forms(heads or "")[0])
            ends.update(set(torn))
        rows = [(w, "", "", "", n) for w, n in words.items()] + [(a + c, a, b, c, n) for (a, b, c), n in ends.items()]
        columns = list(zip(*rows)) or [(), (), (), (), ()]
        kinds = (*[pa.string()] * 4, pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["word", "lhs", "mark", "rhs", "n"])


def _possible(confusions: dict[str, list[str]]):
    """Each word with its possible repairs, and with its class key (as `key`, for the repairs of several confusions)."""

    def run(batches):
        for batch in batches:
            out: tuple[list, ...] = ([], [], [])
            for word, n in zip(*(c.to_pylist() for c in batch.columns)):
                if doubtful(word):
                    for better in candidates(word, confusions):
                        for column, value in zip(out, (word, n, better)):
                            column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())], ["word", "n", "better"])

    return run


def _keyed(confusions: dict[str, list[str]]):
    def run(batches):
        for batch in batches:
            words = batch.column(0).to_pylist()
            keys = [class_key(w, confusions) if doubtful(w) else None for w in words]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.string())], ["word", "n", "key"])

    return run


def choose(model: Perceptron, word: str, n: int, among: list[tuple[str, int]]) -> str | None:
    """The repair of the highest score, if that is above leaving the word alone; among equals the more frequent, then the smaller word."""
    best = None
    for better, m in among:
        if better == word or (f := repair_features(word, n, better, m)) is None:
            continue
        rank = (-model.score(f), -m, better)
        if best is None or rank < best:
            best = rank
    return best[2] if best and best[0] < 0 else None


def _chosen(shared):
    def run(batches):
        model = shared.value
        for batch in batches:
            out: tuple[list, ...] = ([], [], [])
            for word, n, among in zip(*(c.to_pylist() for c in batch.columns)):
                known = {a["better"]: a["m"] for a in among}
                if better := choose(model, word, n, list(known.items())):
                    for column, value in zip(out, (word, better, known[better])):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int64())], ["form", "repair", "m"])

    return run


def _kept_ends(shared):
    def run(batches):
        model = shared.value
        for batch in batches:
            kept = []
            for left, mark, right, roles in zip(*(c.to_pylist() for c in batch.columns)):
                if model.score(join_features(left, mark, right, {r["role"]: r["m"] or 0 for r in roles})) <= 0:
                    kept.append(end_key(left, mark, right))
            yield pa.RecordBatch.from_arrays([pa.array(kept, pa.string())], ["form"])

    return run


def _lookup(spark, words: DataFrame, wanted: set[str]) -> dict[str, int]:
    """The counts of a bounded set of words."""
    if not wanted:
        return {}
    asked = spark.createDataFrame([(w,) for w in sorted(wanted)], "word string")
    t = words.join(asked, "word").select("word", "n").toArrow()
    return dict(zip(t.column("word").to_pylist(), t.column("n").to_pylist()))


def choices(repairs: list[tuple[str, str]], frequent: dict[str, int], compounds: dict[str, int], confusions: dict[str, list[str]], look) -> list:
    """The training choices; look: a set of words -> their counts."""
    words = dict.fromkeys((bare(a), bare(b)) for a, b in training_pairs(repairs))
    damaged = {}
    for word in frequent:
        for read, printed in ((r, p) for r, ps in confusions.items() for p in ps if p in word):
            damaged[word.replace(printed, read, 1), word] = None
    ends = dict.fromkeys(training_ends(repairs))
    for k, word in enumerate(frequent):
        at = 2 + k % max(1, len(word) - 3)
        if len(word) > 4:
            ends[word[:at], HYPHENS[k % len(HYPHENS)], word[at:], True] = None
    for word in compounds:
        left, right = word.split("-", 1)
        ends[left, "-", right, False] = None
    tried = {a: candidates(a, confusions) for a, _ in [*words, *damaged, *((w, w) for w in frequent)] if doubtful(a)}
    wanted = {w for a, b in tried.items() for w in (a, *b)} | {b for _, b in words}
    for left, _, right, _ in ends:
        joined = left + right
        wanted |= {joined, f"{left}-{right}", left, right, *candidates(joined, confusions)}
    n = look(wanted)
    out = []
    for (word, truth), real in [*((p, True) for p in words), *((p, False) for p in damaged), *(((w, w), False) for w in frequent)]:
        if word not in tried:
            continue
        own = n.get(word, 0) if real or word == truth else min(1, n.get(word, 0))
        among = {b: n[b] for b in tried[word] if n.get(b, 0) >= KNOWN}
        if truth != word and n.get(truth, 0) >= KNOWN:
            among[truth] = n[truth]
        if word == truth and real and any(m > UNSURE * own for m in among.values()):
            continue
        if truth != word and truth not in among:
            continue
        rated = [(b, f) for b, m in among.items() if (f := repair_features(word, own, b, m)) is not None]
        names = ["", *(b for b, _ in rated)]
        goal = "" if truth == word else truth
        if len(names) > 1 and goal in names:
            out.append(([[], *(f for _, f in rated)], names.index(goal)))
    for left, mark, right, joined in ends:
        whole = left + right
        best = max((n.get(w, 0) for w in (whole, *candidates(whole, confusions))), default=0)
        compound = n.get(f"{left}-{right}", 0)
        for seen in {compound, compound // 2, 0} if not joined else {compound}:  # a compound must be known as one though it is rarer elsewhere
            roles = {"joined": best, "compound": seen, "left": n.get(left, 0), "right": n.get(right, 0)}
            out.append(([[], join_features(left, mark, right, roles)], int(joined)))
    order = sorted(range(len(out)), key=lambda k: (k * 7919) % 104729)
    return [out[k] for k in order]


@functools.lru_cache(maxsize=256)
def _squeezed_all(titles: tuple[str, ...]) -> list[str]:
    return [t for t in map(squeezed, titles) if len(t) >= 6]


def _lines(batches):
    """Lines that may be a running header, by book and chunk: a hash of their letters, and whether they stand between the halves of a torn sentence."""
    for batch in batches:
        seen: dict[tuple[str, int, int], bool] = {}
        for text, book, chunk in zip(*(c.to_pylist() for c in batch.columns)):
            lines = (text or "").split("\n")
            for n, line in enumerate(lines):
                bare = line.strip()
                if bare and not UNPROSE.search(bare) and len(letters := squeezed(bare)) > 5:
                    key = book, line_key(letters), chunk
                    seen[key] = seen.get(key, False) or torn_around(lines, n)
        columns = list(zip(*seen)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()), pa.array(list(map(int, seen.values())), pa.int32())],
            ["book", "letters", "chunk", "torn"],
        )


def line_key(letters: str) -> int:
    return xxhash.xxh3_64_intdigest(letters) - (1 << 63)


def _parted(batches):
    for batch in batches:
        out: tuple[list, ...] = ([], [], [], [])
        for i, text, chapter, subject, titles, recurring in zip(*(c.to_pylist() for c in batch.columns)):
            if not text or not text.strip():
                row = (i, [], text, "")
            else:
                own = [chapter] if chapter and chapter.strip().lower() != "unknown" else []
                known = _squeezed_all(tuple(dict.fromkeys([*own, *(titles or [])])))
                kinds, body, heads = parted(text, known, subject or "", frozenset(recurring or ()))
                row = (i, sorted(kinds), body, heads)
            for column, value in zip(out, row):
                column.append(value)
        types = (pa.string(), pa.list_(pa.string()), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, types)], ["chunk_id", "kinds", "body", "heads"])


def _edited(shared):
    """shared: the table of repairs, or None if each row brings its own."""

    def run(batches):
        common = Editor(shared.value) if shared else None
        for batch in batches:
            ids, found, texts = [], [], []
            for i, kinds, body, heads, *own in zip(*(c.to_pylist() for c in batch.columns)):
                editor = common or Editor({r["form"]: r["repair"] for r in own[0] or ()})
                better = (set(kinds), body) if not body or not body.strip() else edited(set(kinds), body, heads, editor)
                ids.append(i), found.append(sorted(better[0])), texts.append(better[1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.string()), pa.array(found, pa.list_(pa.string())), pa.array(texts, pa.string())],
                ["chunk_id", "kinds", "text"],
            )

    return run


def _used(batches):
    """(row, form): the words and line ends of a row that a repair may be known for."""
    for batch in batches:
        rows, out = [], []
        for row, body, heads in zip(*(c.to_pylist() for c in batch.columns)):
            found, torn = forms(body or "")
            own = found | set(TOKEN.findall((heads or "").lower())) | {a + c for a, _, c in torn} | {end_key(*t) for t in torn} | set(TOKEN.findall((body or "").lower()))
            rows += [row] * len(own)
            out += sorted(own)
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(out, pa.string())], ["row", "form"])


def bodies(chunks: DataFrame) -> DataFrame:
    """chunk_id, kinds (of furniture), body, heads: each distinct chunk row without its page furniture."""
    rows = chunks.select(*(F.col(c).cast("string").alias(c) for c in ("chunk_id", "text", "chapter", "subject", "source_file")))
    # all chapters of a book, the most frequent first: what its running headers may say where a chunk's own is unknown
    books = (
        rows.where("chapter IS NOT NULL AND lower(trim(chapter)) NOT IN ('unknown', '')")
        .groupBy("source_file", "chapter")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("source_file")
        .agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "chapter"))).alias("t"))
        .select(F.col("source_file").alias("_book"), F.expr("transform(t, x -> x.chapter)").alias("titles"))
    )
    # repeated rows of a chunk count once
    own = rows.where("source_file IS NOT NULL").select("text", "source_file", F.xxhash64("chunk_id").alias("chunk"))
    heads = (
        spread(own)
        .mapInArrow(_lines, "book string, letters long, chunk long, torn int")
        .groupBy("book", "letters", "chunk")
        .agg(F.max("torn").alias("torn"))
        .groupBy("book", "letters")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("torn").alias("torn"))
        .where("n >= 3 AND torn * 2 > n")
        .groupBy("book")
        .agg(F.array_sort(F.collect_list("letters")).alias("recurring"))
    )
    # a book's rows are spread over salts; the number of partitions is given, as few bytes mean much work here and are not to be coalesced
    n = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = books.join(heads, F.col("_book") == F.col("book"), "full").select(
        F.coalesce("_book", "book").alias("source_file"), "titles", "recurring", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    )
    return (
        rows.withColumn("salt", F.pmod(F.xxhash64("chunk_id", "text"), F.lit(SALTS)).cast("int"))
        .repartition(n, "source_file", "salt")
        .dropDuplicates(["source_file", "salt", "chunk_id", "text"])  # where they are: no further shuffle
        .join(known, ["source_file", "salt"], "left")
        .select("chunk_id", "text", "chapter", "subject", "titles", "recurring")
        .mapInArrow(_parted, "chunk_id string, kinds array<string>, body string, heads string")
    )


def fit_editor(spark, words: DataFrame, repairs: list[tuple[str, str]]) -> tuple[Perceptron, dict[str, list[str]]]:
    """(the trained perceptron, the confusions)."""
    confusions = units(repairs)
    most = lambda where: {r.word: r.n for r in words.where(where).orderBy(F.desc("n"), "word").limit(FREQUENT).collect()}
    frequent = most(r"word RLIKE '^\\p{L}{3,}$' AND n > 2")
    compounds = most("instr(word, '-') > 0")
    model = Perceptron()
    model.train(choices(repairs, frequent, compounds, confusions, lambda wanted: _lookup(spark, words, wanted)))
    return model, confusions


def known_repairs(parted_rows: DataFrame, repairs: DataFrame, train_rows: int = TRAIN_ROWS, weights: bool = True) -> DataFrame:
    """form, repair: each misread word of the corpus with its repair, and each line end to be kept (KEPT). weights=False: with the perceptron's weights
    taken away, for an ablation."""
    spark = parted_rows.sparkSession
    pairs = (
        repairs.where("before IS NOT NULL AND after IS NOT NULL AND after <> ''")
        .select("before", "after")
        .distinct()
        .orderBy(F.xxhash64("before"), "before", "after")
        .limit(train_rows)
        .collect()
    )
    counted = cut(
        spread(parted_rows.select("body", "heads"))
        .mapInArrow(_counted, "word string, lhs string, mark string, rhs string, n long")
        .groupBy("word", "lhs", "mark", "rhs")
        .agg(F.sum("n").alias("n"))
    )
    words = counted.where("mark = ''").select("word", "n")
    model, confusions = fit_editor(spark, words, [(r.before, r.after) for r in pairs])
    if not weights:
        model.weights = {}
    shared = spark.sparkContext.broadcast(model)
    all_forms = counted.groupBy("word").agg(F.coalesce(F.sum(F.when(F.col("mark") == "", F.col("n"))), F.lit(0)).alias("n"))
    single = all_forms.mapInArrow(_possible(confusions), "word string, n long, better string")
    keyed = all_forms.mapInArrow(_keyed(confusions), "word string, n long, key string").where("key IS NOT NULL")
    heads = keyed.where(r"n > 0 AND word RLIKE '^\\p{L}{3,}$'").groupBy("key").agg(F.max_by("word", F.struct("n", "word")).alias("better"))
    several = keyed.join(heads, "key").where("word <> better").select("word", "n", "better")
    among = single.union(several).distinct().join(words.where(f"n >= {KNOWN}").select(F.col("word").alias("better"), F.col("n").alias("m")), "better")
    misread = cut(
        among.groupBy("word", "n").agg(F.collect_list(F.struct("better", "m")).alias("among")).mapInArrow(_chosen(shared), "form string, repair string, m long")
    )
    ends = counted.where("mark <> ''").select("lhs", "mark", "rhs")
    roles = F.array(
        *(
            F.struct(F.lit(name).alias("role"), word.alias("word"))
            for name, word in (("joined", F.concat("lhs", "rhs")), ("compound", F.concat("lhs", F.lit("-"), "rhs")), ("left", F.col("lhs")), ("right", F.col("rhs")))
        )
    )
    asked = ends.select("*", F.explode(roles).alias("r")).select("lhs", "mark", "rhs", "r.role", "r.word")
    found = asked.join(words, "word", "left").join(misread.select(F.col("form").alias("word"), "m"), "word", "left")
    kept = (
        found.select("lhs", "mark", "rhs", F.struct("role", F.greatest("n", F.when(F.col("role") == "joined", F.col("m"))).alias("m")).alias("r"))
        .groupBy("lhs", "mark", "rhs")
        .agg(F.collect_list("r").alias("roles"))
        .mapInArrow(_kept_ends(shared), "form string")
    )
    return misread.select("form", "repair").union(kept.select("form", F.lit(KEPT).alias("repair")))


def repaired_chunks(chunks: DataFrame, repairs: DataFrame, train_rows: int = TRAIN_ROWS, broadcast_rows: int = 200_000, weights: bool = True) -> DataFrame:
    """chunk_id, kinds (of noise), text (continuous repaired paragraphs); one row for each distinct chunk row."""
    spark = chunks.sparkSession
    rows = cut(bodies(chunks))
    known = cut(known_repairs(rows, repairs, train_rows, weights))
    result = "chunk_id string, kinds array<string>, text string"
    if known.count() <= broadcast_rows:
        t = known.toArrow()
        shared = spark.sparkContext.broadcast(dict(zip(t.column("form").to_pylist(), t.column("repair").to_pylist())))
        return rows.mapInArrow(_edited(shared), result)
    rows = rows.withColumn("row", F.xxhash64("chunk_id", "body", "heads", "kinds"))
    used = rows.select("row", "body", "heads").mapInArrow(_used, "row long, form string").join(known, "form")
    own = used.groupBy("row").agg(F.collect_set(F.struct("form", "repair")).alias("own"))
    return rows.join(own, "row", "left").select("chunk_id", "kinds", "body", "heads", "own").mapInArrow(_edited(None), result)


def found_noise(chunks: DataFrame, repairs: DataFrame, **how) -> DataFrame:
    """chunk_id, noise: each kind of noise in a chunk."""
    return (
        repaired_chunks(chunks, repairs, **how)
        .where("chunk_id IS NOT NULL")
        .select("chunk_id", F.explode("kinds").alias("noise"))
        .distinct()
    )
