"""Problem 6: broken prompt and response pairs.

Method. The suffix automaton of a prompt's words is walked with the response's words: the longest runs taken from
the prompt give the share of the response that is copied. A refusal automaton (Aho-Corasick over phrases of declining and of helping)
finds first-person refusals and tells them from sentences about things that can't be done; a stack of delimiters and the ending's
shape find responses that break off; stopword votes name the language of prompt and response.

One defect is reported for a pair, the first of empty, refusal, copy, language, truncated.

Scale. Every pair is judged in its row; nothing is shuffled but the distinct ids at the end. An automaton is as large as its prompt.

Defined results: NULL, blank and placeholder responses are empty, except for sources in `unanswered`, where none is expected; a NULL
or blank prompt has no language and nothing to copy; a NULL source isn't in `unanswered`; rows of a NULL id aren't reported; rows of one
repeated id may have several defects, each once.
"""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
PREFIX = re.compile(r"^\s*(?:ans(?:wer)?|sol(?:ution)?|antwort|respuesta|réponse|उत्तर)\s*[.:\-–)]+\s*", re.IGNORECASE)
#: fixed values: responses that stand for none
PLACEHOLDERS = frozenset(
    "n/a|na|n.a.|n.a|tbd|tba|todo|null|nil|nan|blank|(blank)|[blank]|answer|[answer]|(answer)|<answer>|no answer|not available"
    "|not answered|to be added|to be done|pending|xxx|empty|(empty)|none given|no response".split("|")
)
#: fixed values: phrases with which a speaker declines, those of the act declined, and what comes with them
DECLINES = (
    "i am unable to|i'm unable to|we are unable to|i cannot|i can't|i can not|we cannot|we can't|i could not|i am not able to"
    "|i'm not able to|we are not able to|we're not able to|i won't be able to|i will not be able to|i must decline|i have to decline"
    "|i need to decline|i decline|not possible for me|i am not allowed|i'm not allowed|i may not|i won't|i will not|i refuse|we won't"
).split("|")
ACTS = (
    "help|assist|answer|respond|reply|provide|solve|discuss|comply|complete|fulfil|share|support|do that|do this|this request"
    "|that request|this question|that question|give you|tell you|work on"
).split("|")
SOFT = (
    "sorry|apolog|unfortunately|ask your teacher|try asking|beyond what i|language model|as an ai|as an assistant|please consult|my guidelines"
).split("|")
OUTRIGHT = (
    "सहायता करना संभव नहीं|उत्तर नहीं दे सक|जवाब नहीं दे सक|मदद नहीं कर सक|सहायता नहीं कर सक|उत्तर देना संभव नहीं|बताना संभव नहीं"
    "|ich nicht helfen|nicht beantworten|nicht weiterhelfen|kann ich nicht antworten|keine antwort geben|nicht dabei helfen"
    "|no puedo responder|no puedo ayudar|no puedo contestar|no me es posible|no podemos responder|no puedo resolver|no es posible ayudar"
    "|ne peux pas répondre|ne peux pas vous aider|ne peux pas t'aider|ne peux pas aider|ne pouvons pas répondre|m'est impossible"
    "|n'est pas possible de répondre|m'est pas possible|dois refuser|debo rechazar|muss ich ablehnen"
    "|not something i'd like to|not something i would like to|not something i can|not something i may|not something i am able to"
    "|guidelines keep me from|guidelines prevent me|guidelines do not allow|guidelines don't allow|rules keep me from|policy keeps me from|keeps me from answering|prevents me from answering"
    "|not have permission|n't have permission|not have enough permission|n't have enough permission|not permitted to answer|not permitted to solve"
    "|no answer can be given|no answer can be provided|no response can be given|nothing i may say|nothing i can say about|nothing i am allowed to say"
).split("|")
#: fixed values: frequent function words
STOPWORDS = {
    "en": "the of and a an is was were that which by from to it its with as for at on not how what why who where when if does do can be are this these those they one in or but than into has have had there each every because although",
    "de": "der die das und ist nicht ein eine einen einem einer mit den dem des im zu auf wie wenn wird sich für von am als auch neben nach was warum wo wer welche welcher während deshalb man hat es kein keine ohne bei wir laut dann aber oder sind warum zwischen",
    "fr": "le la les un une des du de et est que qui dans pour pas ne sur avec au aux ce cette il elle on par plus quand pourquoi quelle quel quels quelles entre sans se sont où comment mais après pendant près encore aussi c'est d'après",
    "es": "el la los las un una de del y es que en por con no se su al como cuando qué cuál dónde quién para más sin entre pero después también cerca durante otra vez según ningún eso este esta cómo está",
}
VOTES: dict[str, tuple[str, ...]] = {}
for _language, _words in STOPWORDS.items():
    for _word in _words.split():
        VOTES[_word] = (*VOTES.get(_word, ()), _language)

MARKS, CLOSERS = ".!?।॥。！？", ")]\"'”’»"
OPEN_STOP = re.compile(r"\b(?:e\.g|i\.e|z\.B|Fig|Abb|vs|cf)\.$|\b(?:about|etwa|environ) \d+\.$")
OPTION = re.compile(r"^\(?[a-eA-E1-4][.)]\s")
ITEM = re.compile(r"^\s*(?:\d+[.)]|[-•*]|\(?[a-e]\))\s+\S")
EQUATION = re.compile(r"^[\w\s]{1,12}=\s*[-\d.]+(?:\s*[,;]\s*[\w\s]{1,12}=\s*[-\d.]+)*$")
PAIRS = {"(": ")", "[": "]", "“": "”", "«": "»", "{": "}"}


class SuffixAutomaton:
    """Of a sequence of words; `runs` gives, for each place of another sequence, the longest run ending there that the sequence holds."""

    def __init__(self, items: list[str]):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]
        last = 0
        for item in items:
            new = len(self.next)
            self.next.append({})
            self.link.append(0)
            self.length.append(self.length[last] + 1)
            state = last
            while state != -1 and item not in self.next[state]:
                self.next[state][item] = new
                state = self.link[state]
            if state != -1:
                target = self.next[state][item]
                if self.length[target] == self.length[state] + 1:
                    self.link[new] = target
                else:
                    copy = len(self.next)
                    self.next.append(dict(self.next[target]))
                    self.link.append(self.link[target])
                    self.length.append(self.length[state] + 1)
                    while state != -1 and self.next[state].get(item) == target:
                        self.next[state][item] = copy
                        state = self.link[state]
                    self.link[target] = self.link[new] = copy
            last = new

    def runs(self, items: list[str]) -> list[int]:
        out, state, run = [], 0, 0
        for item in items:
            while state and item not in self.next[state]:
                state = self.link[state]
                run = self.length[state]
            if item in self.next[state]:
                state, run = self.next[state][item], run + 1
            else:
                state, run = 0, 0
            out.append(run)
        return out


def copied(prompt: list[str], response: list[str]) -> int:
    """Words of the response that lie in runs of at least four words (or half a short prompt) of the prompt."""
    if not prompt or not response:
        return 0
    least = min(4, max(2, len(prompt) // 2))
    covered = [False] * len(response)
    for at, run in enumerate(SuffixAutomaton(prompt).runs(response)):
        if run >= least:
            for k in range(at - run + 1, at + 1):
                covered[k] = True
    return sum(covered)


_AUTOMATON = None


def _automaton():
    global _AUTOMATON
    if _AUTOMATON is None:
        import ahocorasick

        _AUTOMATON = ahocorasick.Automaton()
        for kind, phrases in (("declines", DECLINES), ("act", ACTS), ("soft", SOFT), ("outright", OUTRIGHT)):
            for p in phrases:
                _AUTOMATON.add_word(p, (kind, len(p)))
        _AUTOMATON.make_automaton()
    return _AUTOMATON


def refuses(text: str) -> bool:
    low = re.sub(r"\s+", " ", text.lower().replace("’", "'").replace("‘", "'"))
    declines, acts, soft = [], [], 0
    for end, (kind, size) in _automaton().iter(low):
        start = end - size + 1
        if kind != "act" and start and low[start - 1].isalpha():
            continue  # inside a word
        if kind == "outright":
            return True
        if kind == "declines":
            declines.append((start, end))
        elif kind == "act":
            if not start or not low[start - 1].isalpha():
                acts.append(start)
        else:
            soft += 1
    for start, end in declines:
        stop = min((k for k in (low.find(c, end) for c in ".!?।") if k >= 0), default=len(low))
        if re.search(r"\bsaid (?:the|a|an)\b", low[end:stop]):
            continue  # told of somebody
        if any(end < a <= stop for a in acts) or soft:
            return True
    return False


def language(text: str) -> str | None:
    """By votes of function words, Devanagari by its letters; None where the votes don't decide."""
    text = re.sub(r"[“«\"][^”»\"]{0,60}[”»\"]", " ", text)  # a quoted word says nothing
    letters = [c for c in text if c.isalpha()]
    if not letters:
        return None
    if sum("ऀ" <= c <= "ॿ" for c in letters) > len(letters) / 2:
        return "hi" if len(letters) > 5 else None
    words = WORD.findall(unicodedata.normalize("NFC", text).lower().replace("’", "'"))
    votes = dict.fromkeys(STOPWORDS, 0.0)
    for w in words:
        for n in VOTES.get(w, ()) or VOTES.get(w.split("'")[0] + "'", ()):
            votes[n] += 1 / len(VOTES.get(w, (n,)))
    best, second = sorted(votes.values(), reverse=True)[:2]
    if len(words) < 4 or best < 2 or best < 1.5 * second or best < 0.12 * len(words):
        return None
    return max(votes, key=lambda n: votes[n])


def left_open(text: str) -> bool:
    """Whether a bracket or quotation is open at the end."""
    stack = []
    straight = 0
    for c in text:
        if c in PAIRS:
            stack.append(PAIRS[c])
        elif stack and c == stack[-1]:
            stack.pop()
        elif c == '"':
            straight += 1
    return bool(stack) or straight % 2 == 1


def breaks_off(text: str) -> bool:
    bare = text.rstrip()
    if not bare:
        return False
    if bare.endswith(("...", "…")):
        return bool(WORD.search(bare))
    if OPEN_STOP.search(bare[max(0, len(bare.rstrip("0123456789.")) - 16) :]):
        return True
    unclosed = bare.rstrip(CLOSERS)
    if bare[-1] in MARKS or unclosed not in ("", bare) and unclosed[-1] in f"{MARKS}…":
        return False
    words = WORD.findall(bare)
    if left_open(bare) and len(words) > 1:
        return True
    lines = [x for x in bare.split("\n") if x.strip()]
    if OPTION.match(bare) and len(lines) == 1 and len(words) <= 12 or EQUATION.match(bare):
        return False
    if len(lines) > 1 and ITEM.match(lines[-1]):
        return False
    return len(words) >= 4


def defect(prompt: str | None, response: str | None, source: str | None, unanswered: frozenset[str]) -> str | None:
    bare = PREFIX.sub("", unicodedata.normalize("NFC", response or "")).strip()
    if not any(c.isalnum() for c in bare) or bare.lower().strip(" .") in PLACEHOLDERS:
        return None if source in unanswered else "empty"
    if refuses(bare):
        return "refusal"
    asked, given = (WORD.findall((x or "").lower()) for x in (prompt, bare))
    taken = copied(asked, given)
    if taken >= min(4, max(2, len(asked) // 2)) and len(given) - taken <= max(3, len(given) // 10) and taken >= 0.75 * len(given):
        return "copy"
    spoken = language(bare)
    if spoken and (wanted := language(prompt or "")) and wanted != spoken:
        return "language"
    return "truncated" if breaks_off(bare) else None


def _judge(unanswered: frozenset[str]):
    def run(batches):
        for batch in batches:
            ids, defects = [], []
            for i, p, r, s in zip(*(c.to_pylist() for c in batch.columns)):
                found = defect(p, r, s, unanswered)
                if found and i is not None:
                    ids.append(i)
                    defects.append(found)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(defects, pa.string())], ["id", "defect"])

    return run


def pair_defects(
    df: DataFrame,
    id_col: str = "id",
    prompt: str = "question",
    response: str = "answer",
    source: str = "source",
    unanswered: tuple[str, ...] = ("ncert_activity",),
) -> DataFrame:
    """id, defect of every broken pair."""
    rows = df.select(*(F.col(c).cast("string") for c in (id_col, prompt, response, source)))
    return rows.mapInArrow(_judge(frozenset(unanswered)), "id string, defect string").distinct()
