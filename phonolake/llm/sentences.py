"""Sentence boundaries in texts of any of the languages and scripts.

Method: a hidden-event n-gram model. Between any two words stands a hidden event, boundary or
none. At a gap behind a closing mark the n-grams hold the event before, the word and the marks
before the gap, whether a quotation closes there or goes on and what it followed, the event, and
the word after. At a gap without a mark they hold the kinds of the characters on both sides: so
the blank between two Thai letters and the line break are boundaries, and a blank between other
words is none, by what the labelled sentences say. Forward and backward sums over the gaps of a
text give each gap's posterior probability of a boundary, and one half decides. The counts come
from strings of all labelled sentences, however many there are: they are made in buckets where the
sentences lie, and added up. Texts without labels aren't counted.

Shortenings are told by their counts: as words, by their form (length, case, a place at the
beginning or after another shortening), and by what follows; the list below is one more trait,
left out for titles in half of the strings so that their form counts on its own. A word that is written small
within sentences tells a beginning when it has a capital.

Defined results: null and blank texts have no sentence; a text without any mark is one
sentence unless the rules split it; offsets count code points of the text as stored, without
the blanks around a sentence; invisible characters are passed over; very long texts are read
whole, in time proportional to their length; repeated rows give repeated results.
"""

from __future__ import annotations

import ast
import bisect
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Closing marks, closing quotes and brackets, quotation marks in pairs.
MARKS = ".!?…।॥۔؟。！？"
CLOSERS = "\"'”’»›“)]}」』）】"
ENDINGS = frozenset(MARKS + CLOSERS)
QUOTES = {'"': '"', "„": "“", "“": "”", "«": "»", "「": "」", "『": "』", "‹": "›"}
THAI = "ก-ฺเ-๎"
BREAKS = "\n\r\x0b\x0c\x85  "
# Common shortenings of the languages, without their last point.
SHORT = set(
    "mr mrs ms dr prof st rs inc ltd co corp jr sr vs etc e.g i.e approx sec fig figs p pp no vol ch ed al a.m p.m u.s n.e n.w s.e s.w dept est "
    "sra srta dra pág págs aprox núm art cap ud uds ee.uu mm mme mlle env av éd chap nr ca bzw usw z vgl s abb bd str hr fr d h u a "
    "т е д п руб стр рис г гг ул см д-р тыс млн им डॉ पं रु क्र कं लि श्री प्रो मो ডা মো টা লি ড ক্র திரு திருமதி எண் ரூ டாக் น พ.ศ ค.ศ".split()
)
#: What an invisible or wide character counts as; one for one, so that offsets stay.
PLAIN = {c: chr(c - 0xFEE0) for c in range(0xFF10, 0xFF5B) if chr(c).isalnum()} | {c: " " for c in (0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F)}
#: Shortenings that often end a sentence.
SHORT_LAST = {"etc", "usw", "p.m", "a.m", "p.m.", "и т.д", "т.д", "т.п", "др", "al", "jr", "sr"}
#: Cyrillic and Greek letters that look like Latin ones, in words that are otherwise Latin.
LIKE_LATIN = str.maketrans("аеорсухѕіјАВЕЅІЈКМНОРСТУХοΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxsijABESIJKMHOPCTYXoABEZHIKMNOPTYX")
ODD = re.compile("[" + "".join(map(chr, PLAIN)) + "]")
GHOSTS = "­​‌‍⁠﻿"

GAP = re.compile(rf"[{re.escape(MARKS)}][{re.escape(MARKS + CLOSERS + GHOSTS)}]*|[ \t]*[{BREAKS}]\s*")
BARE = re.compile(rf"([^\s{re.escape(MARKS)}])[ \t]+(?=(\S))")
QUOTE = re.compile("[" + re.escape("".join({*QUOTES, *QUOTES.values()})) + "]")
WORD_ENDS = frozenset("".join(c for c in map(chr, range(0x3001)) if c.isspace()) + "\"“”«»„‹›「」『』()[]（）!?…।॥۔؟。！？")
AFTER = re.compile(r"[^\s.,;:!?…।۔。！？，、؟،\"“”«»„「」()（）]*")
BLANKS = " \t" + BREAKS + "".join(chr(c) for c, x in PLAIN.items() if x == " ") + "　"
UNSEEN = BLANKS + GHOSTS
NONE, END = 0, 1
#: The least probability of a boundary behind a shortening before the word that follows is looked at.
SURELY = 0.002


@lru_cache(1 << 17)
def shape(word: str, capitals: bool, ends: bool = True, listed: bool = True) -> str:
    """Class of a word: how its first letters look; among capitals they tell nothing. ``ends``: it stands before a mark; ``listed``: the list counts for words of the form of a title."""
    if not word:
        return "-"
    c = word[0]
    if c.isdigit():
        return "9" if word.isdigit() else "9x"
    if len(word) == 1 and c.isupper():
        return "I"
    form = "T" if c.isupper() and len(word) < 5 and word[1:].islower() else ""
    if ends and word.lower() in SHORT_LAST:
        return "E"
    if ends and word.lower() in SHORT and (listed or not form):
        return "S"
    if c.isupper():
        return "C" if capitals else ends and form or "U"
    if c.islower():
        return "l"
    if c.isalpha():
        return unicodedata.name(c, "?").split(" ")[0].split("-")[0]
    return "."


@lru_cache(1 << 17)
def cleaned(word: str) -> str:
    """A word without invisible and look-alike characters."""
    if word.isascii():
        return word
    if any(c in word for c in GHOSTS):
        word = "".join(c for c in word if c not in GHOSTS)
    word = unicodedata.normalize("NFC", word)
    latin = word.translate(LIKE_LATIN)
    return latin if latin.isascii() and (latin.lower() in SHORT or any("a" <= c <= "z" for c in word.lower())) else word


@lru_cache(1 << 14)
def kind_of(c: str) -> str:
    """Kind of a character beside a gap without a mark."""
    if "ก" <= c <= "ฺ" or "เ" <= c <= "๎":
        return "THAI"
    if c.isdigit():
        return "9"
    if c.isalpha():
        return "U" if c.isupper() else "l" if c.islower() else script(c)
    return "."


@lru_cache(1 << 17)
def script(word: str) -> str:
    """Latin, or the script of the first letter."""
    c = next((c for c in word if c.isalpha()), "")
    return "" if not c else "LATIN" if c < "\u0250" else unicodedata.name(c, "?").split(" ")[0].split("-")[0]


class _Switches:
    """Two words of different scripts, neither without letters."""

    def __contains__(self, both: set[str]) -> bool:
        return len(both) == 2 and "" not in both and both != {"HIRAGANA", "KATAKANA"} and not ("CJK" in both and both & {"HIRAGANA", "KATAKANA"})


SWITCHES = _Switches()


def quotations(text: str) -> list[tuple[int, int]]:
    """Spans (opening, closing) of quotation marks; one that isn't closed on its line opens nothing."""
    out, open_ = [], None
    for m in QUOTE.finditer(text):
        c, i = m.group(), m.start()
        left = text[i - 1] if i else " "
        right = text[i + 1] if i + 1 < len(text) else " "
        if open_ is not None and any(x in BREAKS for x in text[open_:i]):
            open_ = None
        closes = open_ is not None and QUOTES.get(text[open_]) == c
        if c == '"':
            begins = (left.isspace() or left in "(«“-–—") and not right.isspace()
            ends = (right.isspace() or right in MARKS + ",;:)") and not left.isspace()
            if closes and not (begins and not ends):
                out.append((open_, i))
                open_ = None
            elif not ends or begins:
                open_ = i
        elif closes:
            out.append((open_, i))
            open_ = None
        elif c in QUOTES:
            open_ = i
    return out


def closes_at(spans: list[tuple[int, int]], at: int) -> bool:
    """Whether a quotation closes there."""
    j = bisect.bisect_left(spans, (at,)) - 1
    return j >= 0 and spans[j][1] == at


class Gap:
    """A place where a sentence may end. ``fixed``: a gap without a mark, by its kind or its probability."""

    __slots__ = ("at", "fixed", "follows", "left", "next", "right")

    def __init__(self, at: int, fixed: float | str | None = None, left=None, right=None, follows=False, next_=None) -> None:
        self.at, self.fixed, self.left, self.right, self.follows, self.next = at, fixed, left, right, follows, next_


def word_before(text: str, at: int) -> int:
    """Where the word that ends at a place begins."""
    while at and text[at - 1] not in WORD_ENDS:
        at -= 1
    return at


def after_speaker(text: str, at: int) -> bool:
    """Whether a line's first word and a colon stand directly before a place."""
    k = at
    while k and text[k - 1] in " \t":
        k -= 1
    if k == at or not k or text[k - 1] != ":":
        return False
    k = end = k - 1
    while k and text[k - 1] not in ":：" and not text[k - 1].isspace():
        k -= 1
    return k < end and (k == 0 or text[k - 1] in BREAKS)


@lru_cache(1 << 14)
def mark_class(marks: str) -> tuple[str, bool]:
    """Class of the marks before a gap, and whether a closing quote or bracket is among them."""
    kind = "".join(c for c in marks if c in MARKS)
    strong = [c for c in kind if c not in ".…"]
    dots = len(kind) - len(strong)
    dotted = "e" if dots > 1 or "…" in kind else ""
    return dotted + ("q" if any(c in "!?！？؟" for c in strong) else "d" if strong else "p" if dots == 1 and "…" not in kind else ""), any(c in CLOSERS for c in marks)


def gaps(text: str, known: frozenset[str] | set[str] = frozenset(), listed: bool = True) -> list[Gap]:
    """All places behind marks and line breaks where a sentence may end, with what the model looks at; ``known`` are words written small and, with a point, words that end sentences."""
    ascii_ = text.isascii()
    plain = text if ascii_ or not ODD.search(text) else text.translate(PLAIN)
    spans = None
    out: list[Gap] = []
    n = len(plain)
    head = n - len(plain.lstrip(BLANKS + GHOSTS + '"“«„('))
    for m in GAP.finditer(plain):
        a, b = m.start(), m.end()
        first = plain[a]
        if first not in MARKS:
            if b < n and a:
                out.append(Gap(b, "line"))
            continue
        # trailing invisible characters and an opening quote that follows directly are not part of the marks
        while b > a and plain[b - 1] in GHOSTS:
            b -= 1
        if plain[b - 1] in "\"“'" and b < n and (plain[b].isalnum() or plain[b] in "¿¡"):
            if spans is None:
                spans = quotations(plain)
            if plain[b - 1] != "'" and not closes_at(spans, b - 1):
                b -= 1
        if b >= n:
            continue
        after = plain[b]
        blank = after.isspace()
        if not blank:
            if first == "." and set(plain[a:b]) <= {"."}:
                continue  # inside a number, a file name or a shortening: no gap between words
            if after in ",;:，、،-–—" or after in "'’" or (first == "." and after.isalnum() and plain[a - 1 : a].isascii()):
                continue
        elif a == 0 or plain[a - 1].isspace() and first == "." and b - a == 1:
            continue
        k = b
        while k < n and (plain[k] in " \t" or plain[k] in GHOSTS):
            k += 1
        if k >= n or plain[k] in BREAKS:
            continue  # the end, or a line break that decides
        if spans is None:
            spans = quotations(plain) if not ascii_ or '"' in plain else []
        # quotations don't overlap: only the last one that opens before can hold or close here
        j = bisect.bisect_left(spans, (a,)) - 1
        closed = spans[j] if j >= 0 and a <= spans[j][1] < b else None
        inside = j >= 0 and b <= spans[j][1]
        marks = plain[a:b]
        m_, closer = mark_class(marks)
        start = word_before(plain, a)
        spelt = cleaned(plain[start:a])
        word = spelt.lower()
        right = cleaned(AFTER.match(plain, k).group()) or plain[k]
        capitals = len(spelt) > 1 and spelt.isupper() and right.upper() == right
        context, intro = "n", ""
        if inside:
            context = "in"
        elif closed:
            i = closed[0]
            k_ = i
            while k_ and (plain[k_ - 1].isspace() or plain[k_ - 1] in GHOSTS):
                k_ -= 1
            before = plain[k_ - 1 : k_]
            if not before or any(c in BREAKS for c in plain[k_:i]) or after_speaker(plain, i):
                context = "q0"
            elif before in ":：":
                context = "q:"
            elif before in ",，、،":
                context = "q,"
            elif before in ENDINGS:
                context = "q?"  # the sentence may begin with the quotation
            else:
                context = "qw"
            if any(c in MARKS for c in marks[closed[1] - a + 1 :]):
                context = "qm"  # a mark of the sentence's own follows the quotation
            while k_ and plain[k_ - 1] in ":：,，、،":
                k_ -= 1
            intro = (plain[word_before(plain, k_) : k_] if k_ and ord(plain[k_ - 1]) < 0x2E80 else plain[max(0, k_ - 1) : k_]).lower()
        elif closer:
            context = "b"
        if ord(right[0]) >= 0x2E80:
            right = right[:2]
        # the word directly after the gap before: a list number, a shortening that begins a sentence
        k_ = start
        while k_ and plain[k_ - 1] in " \t":
            k_ -= 1
        begins = start <= head or (k_ > 0 and plain[k_ - 1] in BREAKS) or after_speaker(plain, start)
        while k_ and (plain[k_ - 1] in " \t\"“«„(" or plain[k_ - 1] in GHOSTS):
            k_ -= 1
        follows = bool(out) and out[-1].next is not None and out[-1].next >= start - 2 and k_ > 0 and plain[k_ - 1] in ENDINGS
        look = shape(right, capitals, False)
        if look == "U" and right.lower() in known:
            look = "V"
        if len(look) > 2:
            look = "z" if right[0] >= "\u2e80" else "x"  # letters without case, whatever the script
        if {script(spelt), script(right)} in SWITCHES:
            look += "*"
        form = shape(spelt, capitals, True, listed or not (begins or follows))
        if form == "T" and (word in known or word + "." in known):
            form = "U"  # a known word
        out.append(Gap(b, None, (m_, word, form, context, intro, "" if blank else "0", begins), (right.lower(), look), follows, k))
    return out


class HiddenEvents:
    """Counts of the n-grams with hidden events, and the posterior of each gap."""

    def __init__(self) -> None:
        self.left: dict = defaultdict(lambda: [0.0, 0.0])
        self.right: dict = defaultdict(float)
        self.total: dict = defaultdict(float)
        self.bare: dict = defaultdict(lambda: [0.0, 0.0])
        self.known: set[str] = set()
        self.memo: dict = {}
        self.cold: set = set()

    @staticmethod
    def _contexts(left: tuple, starts: int) -> list[tuple]:
        """Contexts of an event, from the shortest to the longest. ``starts``: 1 directly after a boundary, 2 directly after a mark that is none."""
        m, word, kind, quote, intro, blank, begins = left
        if quote == "q?":
            quote = "q0" if starts == 1 else "qw"
        first = (begins or starts == 1) and kind in ("9", "I", "S", "T")
        if starts == 2 and kind in ("I", "S", "T"):
            first = "chain"
        if kind == "T" and not first:  # elsewhere a short word with a capital is a word
            kind = "U"
        steps = [(m,), *([("*", quote)] if quote != "n" else []), (m, quote), (m, quote, kind), (m, quote, kind, first), (m, quote, blank, kind, first), (m, quote, word)]
        if intro:
            steps += [(m, quote, "i", intro), (m, quote, "i", intro, word)]
        return steps

    @staticmethod
    def _words(event: int, left: tuple, right: tuple, starts: int) -> list[tuple]:
        m, _, kind, quote, _, _, begins = left
        if kind == "T" and not (begins or starts):
            kind = "U"
        quote = "q" if quote[0] == "q" and quote != "qm" else quote
        word, look = right
        known = kind if kind in ("9", "I", "S", "T") else "w"
        raw = look
        if known != "S" and look[0] == "V":  # behind an ordinary word any capital tells a beginning, behind a title none
            look = "U" + look[1:]
            raw = raw if known == "w" else look
        return [((event, m), raw), ((event, m, quote), raw), ((event, m, quote, known), look), ((event, m, quote, known), word, look)]

    def __getstate__(self) -> dict:
        """The counts alone, as plain mappings, for the workers."""
        return {"left": dict(self.left), "right": dict(self.right), "total": dict(self.total), "bare": dict(self.bare), "known": self.known, "memo": {}, "cold": set()}

    def rows(self) -> Iterator[tuple[str, str, float, float]]:
        """The counts as rows: the mapping, the key, and one or two numbers."""
        for name in ("left", "bare"):
            yield from ((name, repr(k), *n) for k, n in getattr(self, name).items())
        for name in ("right", "total"):
            yield from ((name, repr(k), n, 0.0) for k, n in getattr(self, name).items())

    @classmethod
    def of_rows(cls, rows: Iterable[tuple[str, str, float, float]], known: set[str]) -> HiddenEvents:
        model = cls()
        model.known = known
        for name, key, a, b in rows:
            counts, k = getattr(model, name), ast.literal_eval(key)
            counts[k] = [counts[k][0] + a, counts[k][1] + b] if name in ("left", "bare") else counts[k] + a
        return model

    def divided(self, by: int) -> HiddenEvents:
        """The model with all counts divided."""
        return self.of_rows(((name, key, a / by, b / by) for name, key, a, b in self.rows()), self.known)

    def learn(self, left: tuple, right: tuple, starts: int, event: int, weight: float = 1.0) -> None:
        for c in self._contexts(left, starts):
            self.left[c][event] += weight
        for c, *w in self._words(event, left, right, starts):
            self.right[(c, *w)] += weight
            self.total[(c, len(w))] += weight

    def _event(self, left: tuple, starts: int) -> tuple[float, float]:
        p = 0.6
        for c in self._contexts(left, starts):
            n = self.left.get(c)
            if n:
                total = n[0] + n[1]
                p = (n[1] + 1.0 * p) / (total + 1.0)
        if left[2] == "S" and not (left[6] or starts):  # contexts hold each other's counts: behind a shortening, what follows may still tell otherwise
            p = max(p, SURELY)
        return 1 - p, p

    def _follow(self, event: int, left: tuple, right: tuple, starts: int) -> float:
        steps = self._words(event, left, right, starts)
        p = 0.08
        for c, *w in steps[:3]:
            p = (self.right.get((c, *w), 0.0) + 2.0 * p) / (self.total.get((c, len(w)), 0.0) + 2.0)
        return p

    def _seen(self, event: int, left: tuple, right: tuple, starts: int) -> tuple[float, float]:
        """How often the word itself followed, of how many words that look like it."""
        steps = self._words(event, left, right, starts)
        return self.right.get((steps[3][0], *steps[3][1:]), 0.0), self.right.get((steps[2][0], steps[2][1]), 0.0)

    def factors(self, left: tuple, right: tuple, starts: int) -> tuple[float, float]:
        key = (left, right, starts)
        got = self.memo.get(key)
        if got is None:
            none, end = self._event(left, starts)
            got = (none * self._follow(NONE, left, right, starts), end * self._follow(END, left, right, starts))
            seen = [self._seen(e, left, right, starts) for e in (NONE, END)]
            if any(n for n, _ in seen):  # the word is known: its own share, smoothed towards its share of all
                share = (sum(n for n, _ in seen) + 1) / (sum(of for _, of in seen) + 200)
                got = tuple(x * (n + 5 * share) / (of + 5) for x, (n, of) in zip(got, seen, strict=True))
            total = sum(got) or 1.0
            got = (got[0] / total, got[1] / total)
            if len(self.memo) > 300_000:
                self.memo.clear()
            self.memo[key] = got
        return got

    def learn_bare(self, pair: tuple[str, str], event: int, weight: float = 1.0) -> None:
        """A gap without a mark, by the kinds of the characters beside it."""
        for c in ((), pair[:1], pair):
            self.bare[c][event] += weight

    def bare_end(self, pair: tuple[str, str]) -> float:
        """Probability of a boundary at a gap without a mark."""
        p = self.memo.get(pair)
        if p is None:
            p = 0.01
            for c in ((), pair[:1], pair):
                if n := self.bare.get(c):
                    p = (n[END] + p) / (n[NONE] + n[END] + 1.0)
            self.memo[pair] = p
        return p

    def places(self, text: str) -> list[Gap]:
        """The gaps of a text; of those without a mark only the ones that hold a boundary: no other gap looks at them."""
        found = gaps(text, self.known)
        if pairs := set(BARE.findall(text)) - self.cold:
            hot = {(a, b): p for a, b in pairs if (p := self.bare_end((kind_of(a), kind_of(b)))) > 0.5}
            self.cold |= pairs - hot.keys()  # pairs of characters: as many as there are in use
            if hot:
                found += [Gap(m.end(), hot[m.groups()]) for m in BARE.finditer(text) if m.groups() in hot]
                found.sort(key=lambda g: g.at)
        return found

    def posteriors(self, places: list[Gap]) -> list[float]:
        """Probability of a boundary at each gap, by forward and backward sums."""
        steps = []
        for g in places:
            if g.fixed is not None:
                end = self.bare_end(("line", "line")) if g.fixed == "line" else g.fixed
                row = (1.0 - end, end)
                steps.append((row, row))
            elif g.follows:
                steps.append((self.factors(g.left, g.right, 2), self.factors(g.left, g.right, 1)))
            else:
                none = self.factors(g.left, g.right, 0)
                steps.append((none, none))
        forward = [(1.0, 0.0)]
        for a, b in steps:
            x, y = forward[-1]
            none, end = x * a[0] + y * b[0], x * a[1] + y * b[1]
            total = none + end or 1.0
            forward.append((none / total, end / total))
        back = (1.0, 1.0)
        out = [0.0] * len(steps)
        for i in range(len(steps) - 1, -1, -1):
            none, end = forward[i + 1][0] * back[0], forward[i + 1][1] * back[1]
            out[i] = end / ((none + end) or 1.0)
            a, b = steps[i]
            back = (a[0] * back[0] + a[1] * back[1], b[0] * back[0] + b[1] * back[1])
            total = max(back) or 1.0
            back = (back[0] / total, back[1] / total)
        return out

    def split(self, text: str | None) -> list[tuple[int, int]]:
        """Spans (start, end) of the sentences of a text."""
        if not text or not (bare := text.strip(UNSEEN)):
            return []
        places = self.places(text)
        ends = [g.at for g, p in zip(places, self.posteriors(places), strict=True) if p > 0.5] if places else []
        if not ends and len(bare) == len(text):
            return [(0, len(text))]
        out, at = [], 0
        for end in [*ends, len(text)]:
            piece = text[at:end]
            a, b = at + len(piece) - len(piece.lstrip(BLANKS)), at + len(piece.rstrip(BLANKS))
            if a < b and piece.strip(UNSEEN):
                out.append((a, b))
            at = end
        return out


def pause(text: str, rng: np.random.Generator) -> str:
    """The sentence with dots after one of its words, unless a capital follows."""
    words = text.split(" ")
    at = [i for i in range(min(4, len(words) - 2)) if words[i][-1:].isalpha() and words[i + 1][:1].isalpha() and not words[i + 1][0].isupper()]
    if at:
        words[int(rng.choice(at))] += "..."
    return " ".join(words)


def titled(text: str, rng: np.random.Generator) -> str:
    """The sentence with the short title that it begins with, if any, replaced by one or two made-up ones of its form."""
    m = TITLE.match(text)
    if not m or m.group(1).lower() not in SHORT:
        return text
    made = ["".join(chr(97 + int(k)) for k in rng.integers(0, 26, rng.integers(2, 5))).capitalize() + "." for _ in range(int(rng.integers(1, 3)))]
    return text[: m.start()] + " ".join(made) + text[m.end() :]


LAST = re.compile(rf"([^\W\d_]+)[{re.escape(MARKS + CLOSERS)}]*$")
TITLE = re.compile(r"^([A-Z][a-z]{1,3})\.(?= [A-Z][a-z])")


ROUNDS = 30
#: Labelled sentences in a bucket, about; their strings are made in one place.
BUCKET = 2048


def words_told(texts: Iterable[str]) -> Counter:
    """Counts of words written small within sentences, of first words, and of last words, each with its kind."""
    told: Counter = Counter()
    for t in texts:
        told.update(("small", w) for w in re.findall(r"(?<=[^\W\d_,;] )[^\W\d_]+", t) if w.islower())
        if m := re.match(r"[^\W\d_]+(?= )", t):
            told["first", m.group().lower()] += 1
        if (m := LAST.search(t)) and m.group(1).lower() not in SHORT:
            told["last", m.group(1).lower() + "."] += 1
    return told


def known_words(told: Iterable[tuple[str, str, int]]) -> set[str]:
    """Words written small or first in several sentences and, with a point, words that end sentences."""
    return {w for kind, w, n in told if kind != "first" or n > 1}


def strings_counted(samples: list[tuple[str, str]], known: set[str], rounds: int = ROUNDS, seed: int = 11) -> HiddenEvents:
    """Counts from strings of labelled sentences (language, text): each sentence has no boundary inside and one at its end.

    ``rounds`` strings start at each sentence; in some a pause is written as dots after one of
    its words, a title is made up, or all are capitals, and in half the list of shortenings
    doesn't count for titles. They follow on with sentences of the same language, and now and
    then of another one, with a blank, two blanks, a line break or, after marks that aren't a
    point, nothing between. The counts are whole numbers, so that those of several buckets add up
    to the same in any order.
    """
    model, rng = HiddenEvents(), np.random.default_rng(seed)
    model.known = known
    samples = sorted(set(samples))
    by: dict[str, list[str]] = defaultdict(list)
    for lang, text in samples:
        by[lang].append(text)
    every = [t for _, t in samples]
    for lang, text in samples:
        for turn in range(rounds):
            parts = [text]
            for _ in range(2):
                pool = by[lang] if rng.random() < 0.85 else every
                parts.append(pool[int(rng.integers(len(pool)))])
            if rng.random() < 0.15:
                parts[0] = pause(parts[0], rng)
            if rng.random() < 0.2:
                parts[0] = titled(parts[0], rng)
            joined, ends = parts[0], []
            for p in parts[1:]:
                last = joined[-1]
                glue = " " if last in ".'" or rng.random() < 0.8 and ord(last) < 0x2E80 else "" if not last.isascii() or rng.random() < 0.3 else "  "
                unmarked = last not in MARKS + CLOSERS and {kind_of(last), kind_of(p[0])} != {"THAI"}
                ends.append(len(joined))
                joined += ("\n" if unmarked else glue) + p  # a sentence without a mark ends its line
            if rng.random() < 0.2:
                joined += "\n" + text
            if rng.random() < 0.1 and len(joined.upper()) == len(joined):
                joined = joined.upper()
            wanted, before = set(ends), 0
            for g in gaps(joined, model.known, turn % 2 == 0):
                if g.fixed is not None:
                    model.learn_bare(("line", "line"), END)  # no sentence has one within
                    before = 0
                    continue
                event = END if g.at in wanted else NONE
                model.learn(g.left, g.right, (1 if before == 1 else 2) if g.follows and before else 0, event)
                before = 1 if event == END else 2
            for m in BARE.finditer(joined):
                model.learn_bare((kind_of(m.group(1)), kind_of(m.group(2))), END if m.start() + 1 in wanted else NONE)
    return model


def train(samples: list[tuple[str, str]], rounds: int = ROUNDS, seed: int = 11) -> HiddenEvents:
    """The model of labelled sentences (language, text); each counts once in all of its strings."""
    every = [t for _, t in set(samples)]
    return strings_counted(samples, known_words((*k, n) for k, n in words_told(every).items()), rounds, seed).divided(rounds)


def counted(labelled: DataFrame, lang: str = "lang", text: str = "text", rounds: int = ROUNDS) -> HiddenEvents:
    """The model of all labelled sentences of a table, as ``train`` makes it of a list.

    The sentences are dealt by their hash to buckets of about ``BUCKET``, in which the strings are
    drawn and counted; the driver gets the words and the counts, added up, and no sentence. A
    table of one bucket gives the counts of ``train``. Made once for a driver and input.
    """
    src = labelled.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("")).alias("lang"), F.col(f"`{text}`").cast("string").alias("text")).filter(F.length("text") > 0).distinct()
    told = src.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("lang", "text")), F.bit_xor(F.xxhash64("text", "lang", F.lit(1)))).first()
    key = (*told, rounds, BUCKET)
    if key in _MODELS:
        return _MODELS[key]
    buckets = max(1, -(-told[0] // BUCKET))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = words_told(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in found], pa.string()) for i in (0, 1)] + [pa.array(list(found.values()), pa.int64())], ["kind", "word", "n"])

    sums = src.mapInArrow(words, "kind string, word string, n bigint").groupBy("kind", "word").agg(F.sum("n").alias("n"))
    known = known_words(sums.collect())

    def strings(bucket: pa.Table) -> pa.Table:
        rows = list(strings_counted(list(zip(bucket["lang"].to_pylist(), bucket["text"].to_pylist(), strict=True)), known, rounds).rows())
        kinds = {"name": pa.string(), "key": pa.string(), "a": pa.float64(), "b": pa.float64()}
        return pa.table([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds.values())], names=list(kinds))

    # a given number of partitions: buckets are few bytes and much work, and would be put into one task
    dealt = src.withColumn("bucket", F.pmod(F.xxhash64("lang", "text"), F.lit(buckets))).repartition(buckets, "bucket")
    counts = dealt.groupBy("bucket").applyInArrow(strings, "name string, key string, a double, b double").groupBy("name", "key").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).collect()
    _MODELS[key] = HiddenEvents.of_rows(counts, known).divided(rounds)
    return _MODELS[key]


def sentences(df: DataFrame, ids: list[str], text: str, samples: list[tuple[str, str]] | HiddenEvents) -> DataFrame:
    """Ids, sent_no, start_char and end_char of each sentence, in order, by labelled sentences or the model of them. One pass over the rows, no shuffle."""
    src = df.select(*[F.col(f"`{c}`") for c in ids], F.col(f"`{text}`").cast("string").alias("text")).filter(F.length("text") > 0)
    kinds = ", ".join(f"`{c}` {k}" for c, k in src.dtypes[: len(ids)])

    model = samples if isinstance(samples, HiddenEvents) else trained(tuple(sorted(set(samples))))

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list[tuple[int, int]]] = {}
        for batch in batches:
            rows, no, start, end = [], [], [], []
            for i, t in enumerate(batch.column(len(ids)).to_pylist()):
                spans = seen.get(t)
                if spans is None:
                    spans = model.split(t)
                    if len(seen) > 50_000:
                        seen.clear()
                    if len(t) < 2000:
                        seen[t] = spans
                for k, (a, b) in enumerate(spans):
                    rows.append(i)
                    no.append(k)
                    start.append(a)
                    end.append(b)
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(take) for k in range(len(ids))), *(pa.array(x, pa.int32()) for x in (no, start, end))], [*ids, "sent_no", "start_char", "end_char"])

    return src.mapInArrow(convert, f"{kinds}, sent_no int, start_char int, end_char int")


_MODELS: dict[tuple, HiddenEvents] = {}


def trained(samples: tuple[tuple[str, str], ...]) -> HiddenEvents:
    """The model of these samples, trained once on the driver; its counts go to the workers with the task."""
    if samples not in _MODELS:
        _MODELS[samples] = train(list(samples))
    return _MODELS[samples]
