"""Text that was decoded with the wrong character encoding: find it and restore it.

Method: the garbled sequences of all usual characters are computed once for UTF-8 read as each
of ``WRONG``, put into a multi-pattern automaton, and matched against whole texts in Arrow
batches. Legacy encodings are told by rule besides: each run of characters that high bytes give
is decoded by every pair, and is garbled where a reading in letters of one script is likelier by
far; so is UTF-8 read as one of ``WIDE``, by runs whose bytes are UTF-8 of one script. Only
matched spans are put back, by the pair of encodings whose reading is likeliest beside the text
around it (counts of three characters in the labelled sentences) and likelier than what stands
there; a pair that explains more of the text is preferred. The text around them is left as it
is. Text that was garbled again and again is restored in turns, until nothing changes.

The counts are of every labelled sentence, however many there are: they are made and added up
where the sentences lie, and the counts alone go to the workers. The documents themselves aren't
counted: garbled text in them would count as usual.

Defined results: null, empty and ASCII texts are never cases and come out as they are; a
replacement character or a control character of the range 80-9F is a case that can't be
restored; what stays garbled after the last turn is kept and marked; repeated rows give
repeated results; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import cache
from math import inf, log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The encodings as which UTF-8 is wrongly read, in the order of trial.
WRONG = ["cp1252", "cp1251", "cp437", "cp850", "mac_roman", "latin-1", "cp866", "koi8_r", "cp1250", "iso8859_15", "cp1254", "cp1253", "cp1257", "cp852", "iso8859_2", "iso8859_5", "mac_cyrillic", "cp1256"]
#: Of these, the ones whose high letters stand beside marks in correct text.
BESIDE_MARKS = {"cp1251", "koi8_r", "cp866", "cp1250", "iso8859_15", "cp1254", "cp1253", "cp1257", "cp852", "iso8859_2", "iso8859_5", "mac_cyrillic", "cp1256"}
#: Blocks of usual characters: first, last.
USUAL = [
    (0xA0, 0x17F), (0x300, 0x304), (0x410, 0x44F), (0x401, 0x401), (0x451, 0x451), (0x60C, 0x60C), (0x61B, 0x61B),
    (0x61F, 0x61F), (0x621, 0x63A), (0x641, 0x655), (0x660, 0x669), (0x679, 0x679), (0x67E, 0x67E), (0x686, 0x686), (0x688, 0x688), (0x691, 0x691),
    (0x698, 0x698), (0x6A9, 0x6A9), (0x6AF, 0x6AF), (0x6BA, 0x6BA), (0x6BE, 0x6BE), (0x6C1, 0x6C3), (0x6CC, 0x6CC), (0x6D2, 0x6D4),
    (0x900, 0x97F), (0x980, 0x9FF), (0xB80, 0xBFF), (0xE00, 0xE5B), (0x2010, 0x2027), (0x2030, 0x203A), (0x200B, 0x200F), (0x20A8, 0x20BF), (0x2116, 0x2122),
    (0x2190, 0x2193), (0x2500, 0x257F), (0x2600, 0x27BF), (0x3000, 0x30FF), (0x4E00, 0x9FFF), (0xFE0F, 0xFE0F), (0xFEFF, 0xFEFF), (0xFF01, 0xFF60), (0xFFFD, 0xFFFD), (0x1F300, 0x1FAFF),
]
#: Blocks whose pairs of letters give three Chinese characters when read as GBK.
BY_PAIRS = [(0x900, 0x970), (0x980, 0x9F1), (0xB80, 0xBD7), (0xE00, 0xE4F)]
#: Second characters that also stand in correct text beside a capital: two such matches in a row are needed.
WEAK_SECOND = set("ёЁ«»…–—“”’‘„№\xa0")
#: Letters that look like Latin ones: after a Latin letter they are a disguise, not a wrong encoding.
LOOKALIKES = set("АВЕЅІЈКМНОРСТУХаеорсухѕіјһԁԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧο")

@cache
def tables(codec: str) -> tuple[list[str], dict[str, int]]:
    """Byte to character and back; a byte that the encoding lacks is read as in Latin-1."""
    chars = []
    for b in range(256):
        try:
            chars.append(bytes([b]).decode(codec))
        except UnicodeDecodeError:
            chars.append(chr(b))
    return chars, {c: b for b, c in enumerate(chars)}


@cache
def usual_set() -> frozenset[str]:
    """All usual characters; those that other garbling gives stay, as text may be garbled more than once."""
    more = {c for codec in WRONG for c in tables(codec)[0]}
    return frozenset(chr(c) for a, b in USUAL for c in range(a, b + 1)) | more


#: Legacy encodings: text written in the first, read as one of the single-byte ones.
LEGACY = ["cp1251", "koi8_r", "cp866", "iso8859_5", "mac_cyrillic", "cp1256", "cp874", "shift_jis", "euc_jp", "gbk", "big5"]
LEGACY_READ_AS = ["cp1252", "latin-1", "cp1251", "koi8_r", "cp866", "mac_roman", "cp437", "cp850", "iso8859_5", "mac_cyrillic"]
LATIN_WRITTEN_IN = ["cp1252", "cp850", "mac_roman"]
LATIN_READ_AS = ["cp1252", "cp1251", "cp437", "cp850", "mac_roman", "koi8_r", "cp866", "cp1250"]
#: Encodings with two bytes a letter as which UTF-8 is read.
WIDE = ["gbk", "big5", "shift_jis", "euc_kr"]
#: Accented letters of the usual languages, and marks that often follow a letter in correct text.
ACCENTED = "áéíóúñüàâçèêëîïôùûäößÁÉÍÓÚÑÜÀÂÇÈÊËÎÏÔÙÛÄÖ"
AFTER_LETTER = set("…“”’‘—–»«„‚°§©®™•¡¿½¼·´`\xa0\xad")
#: Kinds of a match: enough alone; two in a row, or beside a sure one elsewhere.
STRONG, PAIR = 2, 1


@cache
def automaton():
    """All garbled sequences, each with its encodings (true, wrong), kind and length; by rule, from no text."""
    import ahocorasick

    found: dict[str, tuple[tuple[str, str], int, int]] = {}
    usual = [chr(c) for a, b in USUAL for c in range(a, b + 1)]
    for codec in WRONG:
        chars = tables(codec)[0]
        for c in usual:
            garbled = "".join(chars[b] for b in c.encode())
            weak = codec in BESIDE_MARKS or garbled[0] in "ÄÅ"  # letters that correct text has before a mark
            kind = PAIR if len(garbled) == 2 and (weak and garbled[1] in WEAK_SECOND or all("Ͱ" <= x <= "Ͽ" for x in garbled)) else STRONG
            for g in {garbled, garbled.lower()} if codec in ("cp1252", "latin-1") and garbled[0] not in "ÄÅ" else {garbled}:
                if all(ord(x) > 0x7F for x in g) and not all("А" <= x <= "я" for x in g) and not all("\u0600" <= x <= "ۿ" for x in g):
                    found.setdefault(g, (("utf-8", codec), kind, len(g)))
    for first, last in BY_PAIRS:
        letters = [chr(c) for c in range(first, last + 1)]
        for a in letters:
            for b in letters:
                g = (a + b).encode().decode("gbk", errors="replace")
                if "\ufffd" not in g and len(g) == 3:
                    found.setdefault(g, (("utf-8", "gbk"), STRONG, 3))
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    for true in LATIN_WRITTEN_IN:
        for wrong in LATIN_READ_AS:
            for c in ACCENTED if wrong != true else "":
                try:
                    g = tables(wrong)[0][c.encode(true)[0]]
                except UnicodeEncodeError:
                    continue
                if g in AFTER_LETTER or g in LOOKALIKES or ord(g) < 0x80 or g in ACCENTED and g.islower():
                    continue
                for x in letters[:26] if g.isupper() and g < "\u0250" else letters:
                    if not ("\u0400" <= g <= "\u04ff" and x in "aceopxyABCEHKMOPTX"):
                        found.setdefault(x + g, ((true, wrong), STRONG, 2))
            for c in "¿¡«„" if wrong != true else "":  # marks that open stand before a capital
                try:
                    g = tables(wrong)[0][c.encode(true)[0]]
                except UnicodeEncodeError:
                    continue
                if g not in AFTER_LETTER and g not in LOOKALIKES and ord(g) > 0x7F and not g.isupper():
                    for x in letters[26:]:
                        found.setdefault(g + x, ((true, wrong), STRONG, 2))
    for c in ACCENTED:
        g = c.encode().decode("gbk", errors="replace")
        for x in letters[:26] if len(g) == 1 and g != "\ufffd" else "":
            for y in letters[:26]:
                found.setdefault(x + g + y, (("utf-8", "gbk"), STRONG, 3))
    machine = ahocorasick.Automaton()
    for g, value in found.items():
        machine.add_word(g, value)
    machine.make_automaton()
    return machine


@cache
def trace():
    """A character beyond ASCII that some garbled sequence holds: a text without one has no match."""
    found = {c for word in automaton().keys() for c in word if not c.isascii()}
    codes, ranges = sorted(map(ord, found)), []
    for c in codes:
        if ranges and c == ranges[-1][1] + 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return re.compile("[" + "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in ranges) + "]")


#: A byte A0 that became an ordinary blank: the capital A with tilde alone before a small letter.
@cache
def lone():
    return re.compile(r"(?:^|[^\w])Ã (?=[a-zà-ÿ])|[�\x80-\x84\x86-\x9f]")


def spans(text: str) -> list[tuple[int, int, tuple[str, str]]]:
    """Matched spans (start, end, encodings), merged; the weaker kind where two follow each other or a sure one of the same encodings is anywhere."""
    strong: list[tuple[int, int, tuple[str, str]]] = []
    pairs: list[tuple[int, int, tuple[str, str]]] = []
    for end, (codec, kind, n) in automaton().iter(text):
        a, b = end - n + 1, end + 1
        if n == 2 and text[a:b] == "Ã\xa0" and a and text[a - 1].isupper():
            continue  # a capital with tilde before a blank that doesn't break
        if kind == STRONG:
            strong.append((a, b, codec))
        else:
            pairs.append((a, b, codec))
    row: list[tuple[int, int, tuple[str, str]]] = []
    for w in [*pairs, (len(text) + 9, 0, ("", ""))]:
        if row and w[0] > row[-1][1]:
            if len(row) > 1:
                strong.append((row[0][0], row[-1][1], row[0][2]))
            row = []
        row.append(w)
    sure = {codec for _, _, codec in strong}
    strong += [w for w in pairs if w[2] in sure]  # a weaker match counts where the text has a sure one of the same encodings
    out: list[list] = []
    for a, b, codec in sorted(strong):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
            out[-1][2] = codec if codec[0] == "utf-8" else out[-1][2]
        else:
            out.append([a, b, codec])
    return [tuple(x) for x in out]


# ---- legacy and wide encodings by rule ---------------------------------------------------------

#: Letters of the script that each legacy encoding writes; every letter of a decoded run is one of them.
_CYRILLIC = "ЁЄІЇА-яёєіїҐґ"
_ARABIC = "ء-غف-ْٹپچڈڑژکگںھہیے"
_JAPANESE = "\u3000-\u3020ぁ-んァ-ヶー・一-龠！-～…—―“”×"
_CHINESE = "\u3000-\u3020一-龥！-～…—―“”‘’·×"
_CYRILLIC_CODECS = ["cp1251", "koi8_r", "cp866", "iso8859_5", "mac_cyrillic"]
SCRIPT_OF = dict.fromkeys(_CYRILLIC_CODECS, _CYRILLIC) | {"cp1256": _ARABIC, "cp874": "ก-๎"} | dict.fromkeys(("shift_jis", "euc_jp"), _JAPANESE) | dict.fromkeys(("gbk", "big5"), _CHINESE)
#: Encodings with two bytes a letter; the second may be ASCII.
DOUBLE = {"shift_jis", "euc_jp", "gbk", "big5"}
#: Nats by which the decoded run must be likelier than the run itself.
LIKELIER = 9.0
#: Characters of a line in a legacy encoding from which it counts in a text that was garbled otherwise: shorter ones are what lost bytes left.
OTHERWISE = 20
#: Nats by span that a reading of the words beside the spans too is given.
NEIGHBOURS = 4.0
#: Gain from which a run counts with the words beside it, and how many characters may stand between.
WEAK_GAIN, BESIDE = 3.0, 3
#: UTF-8 of the letters of one script, so many in a row that text in a wide encoding doesn't hold them by chance.
UTF8_RUN = (
    rb"(?:\xd0[\x81\x84\x86\x87\x90-\xbf]|\xd1[\x80-\x8f\x91\x94\x96\x97]|\xd2[\x90\x91]){3,}"
    rb"|(?:\xd8[\xa1-\xba]|\xd9[\x81-\x92\xb9\xbe]|\xda[\x86\x88\x91\x98\xa9\xaf\xba\xbe]|\xdb[\x81\x8c\x92]){3,}"
    rb"|(?:\xe0[\xa4\xa5][\x80-\xbf]){2,}|(?:\xe0[\xa6\xa7][\x80-\xbf]){2,}|(?:\xe0[\xae\xaf][\x80-\xbf]){2,}|(?:\xe0[\xb8\xb9][\x80-\xbf]){2,}"
    rb"|(?:\xe3[\x80-\x83][\x80-\xbf]|[\xe4-\xe9][\x80-\xbf]{2}|\xef\xbc[\x80-\xbf]){2,}"
)


class Counts:
    """Counts of one, two and three characters of labelled sentences. Equal counts are one key: a worker keeps what it works out of them over its tasks."""

    __slots__ = ("digest", "grams")

    def __init__(self, grams: dict[str, int]) -> None:
        self.grams = grams
        self.digest = hashlib.sha256("".join(f"{g}\t{n}\n" for g, n in sorted(grams.items())).encode("utf-8", "surrogatepass")).digest()

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Counts) and self.digest == other.digest

    def __hash__(self) -> int:
        return hash(self.digest)


#: Labelled sentences, or the counts of them.
Known = tuple[str, ...] | Counts


def grams_of(texts: Iterable[str]) -> Counter:
    """Counts of one, two and three characters, small and capital alike, with two blanks on either side."""
    out: Counter = Counter()
    for t in texts:
        t = f"  {t.lower()}  "
        out.update(t)
        out.update(a + b for a, b in zip(t, t[1:], strict=False))
        out.update(a + b + c for a, b, c in zip(t, t[1:], t[2:], strict=False))
    return out


def counted(df: DataFrame, text: str) -> Counts:
    """The counts of all texts of a table, each text once. The driver gets a row for each sequence of characters, not the texts."""
    src = df.select(F.col(f"`{text}`").cast("string").alias("text")).filter(F.length("text") > 0).distinct()

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = grams_of(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(list(grams), pa.string()), pa.array(list(grams.values()), pa.int64())], ["gram", "n"])

    return Counts({r.gram: r.n for r in src.mapInArrow(convert, "gram string, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).collect()})


@cache
def model(samples: Known):
    """Counts of letters and of pairs of letters in the labelled sentences, small and capital alike."""
    one, two, _, _ = threes(samples)
    return Counter({c: n for c, n in one.items() if not c.isascii()}), Counter({g: n for g, n in two.items() if not (g[0].isascii() or g[1].isascii())})


@cache
def script(c: str) -> int:
    """0: no letter; else a number for the script."""
    o = ord(c)
    if not (c.isalpha() or 0x900 <= o <= 0xE7F or 0x64B <= o <= 0x655):
        return 0
    return 1 if o < 0x250 else 2 if 0x400 <= o < 0x530 else 3 if 0x600 <= o < 0x700 else 4 if 0xE00 <= o < 0xE80 else 6 if 0x3041 <= o < 0xFFF0 else 5


def likelihood(run: str, samples: Known) -> float:
    """Log of how usual a run of characters beyond ASCII is as text in one script."""
    one, two = model(samples)
    size = {1: 60, 2: 40, 3: 45, 4: 70, 5: 120, 6: 3000}
    total, before, last = 0.0, 0, ""
    for k, c in enumerate(run):
        if c.isascii():
            total, before, last = total - 3.0, 0, ""
            continue
        s, low = script(c), c.lower()
        if not s:
            total -= 6.0 if c in AFTER_LETTER or c in "、。！？，：；「」《》（）" else 9.0
        else:
            # Han letters are too many for pairs: the share of a letter, else an even one
            base = (one[low] + 0.5) / (sum_of(samples, s) + size[s] * 0.5)
            p = 0.5 * base + 0.5 * two[last + low] / one[last] if before == s and one[last] else base
            total += log(p)
            if before and before != s:
                total -= 6.0
            if s == 1 and before == 1:
                total -= 4.0  # two accented letters in a row
            if before == s and c.isupper() and not run[k - 1].isupper():
                total -= 6.0  # a capital within a word
            if before == s and k > 1 and c.islower() and run[k - 1].isupper() and run[k - 2].isupper() and script(run[k - 2]) == s:
                total -= 6.0
        before, last = s, low if s else ""
    return total


@cache
def sum_of(samples: Known, s: int) -> int:
    return sum(n for c, n in model(samples)[0].items() if script(c) == s)


@cache
def legacy_runs():
    """Runs of what high bytes give in some encoding, or of these with the ASCII seconds of two-byte letters."""
    x = "".join(re.escape(c) for c in sorted({c for w in LEGACY_READ_AS for c in tables(w)[0][128:]}))
    return re.compile(f"(?<![A-Za-z])[{x}]{{2,}}(?![@-~])|(?:[{x}]{{1,2}}[@-~]?){{3,}}")


@cache
def shape(true: str):
    letters = SCRIPT_OF[true]
    between = "" if true in DOUBLE else " «»—–№…"
    return re.compile(f"[{between}]*[{letters}]+[{between}{letters}]*")


#: Accented letters of one language: a run of these alone may be a list of them.
LISTED = [set("áéíóúüñãõâêôç"), set("äöüßåæøé"), set("àâæçèéêëîïôœùûüÿ")]


def drawn(run: str) -> bool:
    """A drawing or a row of signs: lines and blocks of one kind, or few signs and no letter."""
    kinds = {0 if c < "\u2550" else 1 if c < "\u2580" else 2 for c in run if "\u2500" <= c <= "\u259f"}
    if all("\u2500" <= c <= "\u259f" for c in run):
        return len(kinds) < 2 or len(set(run)) < 3
    return not any(script(c) for c in run) and len(set(run)) < 4


def decoded(run: str, samples: Known) -> tuple[float, str, tuple[str, str]] | None:
    """The likeliest reading of a run by all pairs of encodings, with its gain over the run; None if there is none, or if it is UTF-8."""
    if drawn(run):
        return None
    own, best = None, None
    for wrong in LEGACY_READ_AS:
        back = tables(wrong)[1]
        try:
            raw = bytes(back[c] for c in run)
        except (KeyError, ValueError):
            continue
        try:
            raw.decode()
            return None
        except UnicodeDecodeError:
            pass
        for true in LEGACY:
            if true == wrong or true not in DOUBLE and any(b < 0x80 for b in raw):
                continue
            try:
                good = raw.decode(true)
            except UnicodeDecodeError:
                continue
            if not shape(true).fullmatch(good) or len(set(good)) < min(3, len(good)) and len(good) > 2 or len(set(good)) < 2:
                continue
            own = likelihood(run, samples) if own is None else own
            gain = likelihood(good, samples) - own
            if best is None or gain > best[0]:
                best = (gain, good, (true, wrong))
    if best and any(set(run.lower()) <= x for x in LISTED):
        best = (min(best[0], WEAK_GAIN), *best[1:])
    return best


@cache
def memo(samples: Known):
    from functools import lru_cache

    return lru_cache(200_000)(lambda run: decoded(run, samples))


@cache
def wide_runs():
    letters = "\u2e80-\u9fff\uac00-\ud7af\ue000-\ufaff\uff00-\uffef"
    other = "\xa1-\xf7\u0370-\u0451\u2010-\u2e7f"
    return re.compile(f"[{letters}{other}]*[{letters}][{letters}{other}]+|[{other}]+[{letters}]"), re.compile(UTF8_RUN)


def wide_spans(text: str) -> list[tuple[int, int, tuple[str, str]]]:
    """Spans whose bytes in a wide encoding are UTF-8 of letters of one script."""
    chars, inner = wide_runs()
    out = []
    for m in chars.finditer(text):
        run = m.group()
        for wrong in WIDE:
            raw = run.encode(wrong, errors="replace")
            hits = [(h.start(), h.end()) for h in inner.finditer(raw) if len(set(h.group())) > 3]
            if hits:
                at = [0]
                for c in run:
                    at.append(at[-1] + len(c.encode(wrong, errors="replace")))
                for p, q in hits:
                    a, b = max(k for k, x in enumerate(at) if x <= p), min(k for k, x in enumerate(at) if x >= q)
                    out.append((m.start() + a, m.start() + b, ("utf-8", wrong)))
                break
    return out


def legacy_spans(text: str, samples: Known) -> list[tuple[int, int, tuple[str, str]]]:
    """Runs that a legacy pair makes likelier by LIKELIER, alone or with the words beside them."""
    out: list[tuple[int, int, tuple[str, str]]] = []
    row: list[tuple[int, int, float, tuple[str, str]]] = []

    def close() -> None:
        if sum(gain for _, _, gain, _ in row) >= LIKELIER:
            out.extend((a, b, pair) for a, b, _, pair in row)
        row.clear()

    for m in legacy_runs().finditer(text):
        a, b, run = m.start(), m.end(), m.group()
        best = memo(samples)(run)
        if run[-1].isascii() and (short := memo(samples)(run[:-1])) and (best is None or short[0] > best[0]):
            best, b = short, b - 1
        if row and a - row[-1][1] > BESIDE:
            close()
        if best and best[0] >= WEAK_GAIN:
            row.append((a, b, best[0], best[2]))
    close()
    return out


def legacy_restored(text: str, samples: Known, least: int = 0) -> tuple[str, int]:
    """The text with the runs of legacy pairs decoded: those of a line by the pair that makes it likeliest, as one piece or each run alone. Lines with fewer than ``least`` such characters are left."""
    groups: list[list[tuple[int, int, tuple[str, str]]]] = []
    for s in legacy_spans(text, samples):
        if groups and "\n" not in text[groups[-1][-1][1] : s[0]]:
            groups[-1].append(s)
        else:
            groups.append([s])
    groups = [g for g in groups if sum(y - x for x, y, _ in g) >= least]
    weight: Counter = Counter()
    for group in groups:
        weight.update({pair: 0 for _, _, pair in group})
        for a, b, pair in group:
            weight[pair] += b - a
    usual = [pair for pair, _ in weight.most_common()]
    parts, at, done = [], 0, 0
    for group in groups:
        a, b = group[0][0], group[-1][1]
        while b < len(text) and joins(text[b]):
            b += 1
        while a > at and joins(text[a - 1]):
            a -= 1
        own = {p for _, _, p in group}
        best = None
        alone = [(x, y) for x, y, _ in group]
        # to the ends of the line: a word of one letter begins and ends lines too
        end_of_line = text.find("\n", b)
        wider = clusters(text, alone, max(at, text.rfind("\n", 0, a) + 1), len(text) if end_of_line < 0 else end_of_line)
        a, b = min(a, wider[0][0]), max(b, wider[-1][1])
        for spans_of in dict.fromkeys([((a, b),), tuple(wider), tuple(alone)]):
            trust = NEIGHBOURS if spans_of != tuple(alone) else 0.0  # words beside are of the same garbling, more likely than not
            for pair in [p for p in usual if p in own or p == usual[0]]:
                pieces = [as_written(text[x:y], pair) or text[x:y] for x, y in spans_of]  # what isn't of the pair stays
                whole_of_it = trust * sum(p != text[x:y] for p, (x, y) in zip(pieces, spans_of, strict=True)) / len(pieces)
                put, end = [], a
                for (x, y), piece in zip(spans_of, pieces, strict=True):
                    put += [text[end:x], piece]
                    end = y
                whole = "".join([*put, text[end:b]])
                score = sum(likelihood(w, samples) for w in whole.split()) + whole_of_it * len(group)
                if best is None or score > best[0]:
                    best = (score, whole)
        if best and best[1] != text[a:b] and best[0] > sum(likelihood(w, samples) for w in text[a:b].split()):
            parts += [text[at:a], best[1]]
            at, done = b, done + 1
    return "".join([*parts, text[at:]]), done


def as_written(piece: str, pair: tuple[str, str]) -> str | None:
    """A piece decoded by a legacy pair; None if some of it isn't of the pair."""
    back = tables(pair[1])[1]
    try:
        good = bytes(back[c] for c in piece).decode(pair[0])
    except (KeyError, UnicodeDecodeError):
        return None
    return good if all(c.isascii() or c in usual_set() for c in good) else None


def is_garbled(text: str | None, samples: Known = ()) -> bool:
    if not text or text.isascii():
        return False
    if lone().search(text) or trace().search(text) and spans(text):
        return True
    return bool(legacy_spans(text, samples)) or bool(wide_spans(text))


#: Letters that change when a garbled text is put into small letters.
SMALL = str.maketrans("øùúûðñšœžÿ", "ØÙÚÛÐÑŠŒŽŸ")


#: Runs beyond ASCII, and the nats that one without a match must gain.
RUNS, SURELY = re.compile(r"[^\x00-\x7f]+"), 6.0
#: What a restored text holds beside letters; within a word, letters alone.
SIGNS = set("«»…–—“”’‘„‚‹›°€£§©®™•½¼¾×·¿¡№†‡−→←↑↓±²³¹ªº\xa0\u200b\u200c\u200d\ufeff")
#: Nats by which a restored span must be likelier than the garbled one; what the pair that explains most of a text is given; what the other pairs of UTF-8 lack where bytes say little.
BETTER, PREFERRED, LATIN_ALONE = 1.0, 15.0, 1.0


@cache
def threes(samples: Known):
    """Counts of one, two and three characters of the labelled sentences, small and capital alike."""
    grams = samples.grams if isinstance(samples, Counts) else grams_of(samples)
    one, two, three = (Counter({g: n for g, n in grams.items() if len(g) == k}) for k in (1, 2, 3))
    return one, two, three, sum(one.values()) or 1


def base(c: str) -> float:
    """Chance of a character that the counts don't know."""
    if c.isascii():
        return 1e-3 if c.isalnum() or c == " " else 1e-4
    s = script(c)
    if s:
        return 2e-5 if c in ACCENTED or s in (2, 3, 4, 5) else 4e-6 if s == 6 else 2e-6
    return 1e-5 if c in SIGNS or 0x3000 <= ord(c) <= 0x3020 or 0xFF00 < ord(c) < 0xFF60 or ord(c) > 0x1F000 else 1e-8


def usualness(piece: str, before: str, after: str, samples: Known) -> float:
    """Log of how usual a piece is between the characters around it."""
    one, two, three, n = threes(samples)
    whole = f"  {before[-2:]}"[-2:] + piece + after[:2]
    low = whole.lower() if len(whole.lower()) == len(whole) else whole
    total = 0.0
    for k in range(2, len(whole)):
        c, b, a = low[k], low[k - 1], low[k - 2]
        p = 0.04 * one[c] / n + 0.02 * base(c)
        if one[b]:
            p += 0.3 * two[b + c] / one[b]
        if two[a + b]:
            p += 0.64 * three[a + b + c] / two[a + b]
        total += log(p)
        x, y = whole[k - 1], whole[k]
        if y.isupper() and x.islower() or y.islower() and x.isupper() and whole[k - 2].isupper():
            total -= 4.0
        if script(x) and script(y) and script(x) != script(y) and {script(x), script(y)} != {5, 6}:
            total -= 6.0
        if x.isalpha() and x < "\u0900" and not y.isascii() and not script(y) and y not in AFTER_LETTER:
            total -= 5.0  # a sign after a letter
        if y.isalpha() and y < "\u0900" and not x.isascii() and not script(x) and x not in "’‘·\xad\u200c\u200d" and whole[k - 2].isalpha():
            total -= 5.0  # and one within a word
    return total


def readings(piece: str, pairs: tuple[tuple[str, str], ...]) -> Iterator[tuple[str, tuple[str, str], float]]:
    """What a piece may have been, by UTF-8 read as any of the encodings and by the legacy pairs given, with what it lacks in trust."""
    told = False
    forms = {piece.replace("ÿ", "Ÿ"): -3.0, piece.translate(SMALL): -3.0, piece.translate(SMALL | str.maketrans("ãâ", "ÃÂ")): -3.0}
    forms = {piece: 0.0} | {f: lack for f, lack in forms.items() if f != piece}
    for form, lack in forms.items():  # changed letters only where the piece as it is isn't UTF-8
        for pair in dict.fromkeys([*(("utf-8", w) for w in (*WRONG, *WIDE)), *pairs] if not lack else [("utf-8", w) for w in WRONG]):
            true, wrong = pair
            try:
                raw = form.encode(wrong) if wrong in WIDE else bytes(tables(wrong)[1][c] for c in form)
                good = raw.decode(true)
            except (KeyError, UnicodeError):
                continue
            if good != form and all(c.isascii() or c in usual_set() for c in good):
                told |= true == "utf-8"
                yield good, pair, lack - (0 if true == "utf-8" else LATIN_ALONE)
        if told:
            return


def partly(piece: str) -> Iterator[tuple[str, tuple[str, str]]]:
    """Readings of a piece that has lost bytes: those that aren't UTF-8 stay as they were read."""
    for wrong in WRONG:
        chars, back = tables(wrong)
        if all(c in back for c in piece):
            good = bytes(back[c] for c in piece).decode("utf-8", "surrogateescape")
            lost = ["\udc80" <= c <= "\udcff" for c in good]
            if sum(lost) < len(good) / 4 and all(x or c.isascii() or c in usual_set() for x, c in zip(lost, good, strict=True)):
                yield "".join(chars[ord(c) - 0xDC00] if x else c for x, c in zip(lost, good, strict=True)), ("utf-8", wrong)


def settled(good: str, before: str, after: str, samples: Known) -> tuple[float, str]:
    """A reading, or where it is garbled UTF-8 itself what it comes from, with its usualness; each such step is shorter than the one before."""
    best = (usualness(good, before, after, samples) if in_a_word(good, before, after) else -inf, good)
    if sum(not c.isascii() for c in good) > 1:
        for deeper, _, lack in readings(good, ()):
            if len(deeper) < len(good):
                value, end = settled(deeper, before, after, samples)
                best = max(best, (value + lack, end))
    return best


def in_a_word(good: str, before: str, after: str) -> bool:
    """A sign between two letters is not restored: words have letters."""
    whole = before[-1:] + good + after[:1]
    return all(not (c in SIGNS or not script(c) and not c.isascii() and not c.isalnum()) or c in "’‘·­‌‍​" or not all(x.isalpha() and x < "\u0900" for x in (whole[k - 1], whole[k + 1])) for k, c in enumerate(whole[1:-1], 1))


def joins(c: str) -> bool:
    """May be a byte of a garbled letter; two of these look like blanks."""
    return not c.isascii() and (not c.isspace() or c in "\xa0\x85")


def restored(text: str | None, samples: Known = ()) -> tuple[str | None, int, bool]:
    """The text with its garbled spans restored where possible, how many were, and whether nothing garbled is left."""
    done, lost = 0, False
    if not text or text.isascii():
        return text, done, True
    seen = {text}
    while True:
        hit = spans(text)
        # UTF-8, which few wrong guesses pass, then legacy runs by rule, then what the sequences alone found
        own = legacy_spans(text, samples)
        fixed, n, part = _spans_back(text, sorted([s for s in hit if s[2][0] == "utf-8"] + wide_spans(text)), samples, own)
        if not n:
            fixed, n = legacy_restored(text, samples, OTHERWISE if done else 0)
        if not n:  # what was garbled otherwise isn't of a Latin encoding besides
            fixed, n, part = _spans_back(text, [s for s in hit if not done or s[2][0] not in LATIN_WRITTEN_IN], samples)
        if not n or fixed in seen:
            return text, done, not lost and not is_garbled(text, samples)
        seen.add(fixed)
        text, done, lost = fixed, done + n, lost or part


def clusters(text: str, spans_of: list[tuple[int, int]], a: int, b: int) -> list[tuple[int, int]]:
    """Spans within a stretch, each with the runs beyond ASCII that no ASCII letter parts from it."""
    pieces = sorted([(x, y, True) for x, y in spans_of] + [(m.start(), m.end(), False) for m in RUNS.finditer(text, a, b)])
    out: list[list] = []
    for x, y, sure in pieces:
        if out and (x <= out[-1][1] or not any(c.isascii() and c.isalpha() for c in text[out[-1][1] : x])):
            out[-1][1], out[-1][2] = max(out[-1][1], y), out[-1][2] or sure
        else:
            out.append([x, y, sure])
    return [(x, y) for x, y, sure in out if sure]


def restore(text: str | None, samples: Known = ()) -> tuple[str | None, int]:
    """The text with its garbled spans restored where possible, and how many were."""
    return restored(text, samples)[:2]


def grouped(text: str, hit: list[tuple[int, int, tuple[str, str]]]) -> list[tuple[int, int, int, int]]:
    """Groups (start, end, first and last matched place): what stands between matches in a word is of the same garbling."""
    groups: list[list[int]] = []
    for x, y, _ in hit:
        a, b = x, y
        if groups and b <= groups[-1][1]:
            groups[-1][3] = max(groups[-1][3], y)
            continue
        while b < len(text) and joins(text[b]):
            b += 1
        while a > (groups[-1][1] if groups else 0) and joins(text[a - 1]):
            a -= 1
        if groups and a <= groups[-1][1]:
            groups[-1][1], groups[-1][3] = max(b, groups[-1][1]), max(y, groups[-1][3])
        else:
            groups.append([a, b, x, y])
    return [tuple(g) for g in groups]


def _spans_back(text: str, hit: list[tuple[int, int, tuple[str, str]]], samples: Known, other: list[tuple[int, int, tuple[str, str]]] = ()) -> tuple[str, int, bool]:
    """The text with matched spans restored, how many were, and whether one had lost bytes.

    A match within a word that is otherwise not of its encodings counts only where no ``other``
    span explains the word.
    """
    if not hit:
        return text, 0, False
    pairs = tuple(dict.fromkeys(pair for _, _, pair in hit if pair[0] != "utf-8"))
    if any(true in LATIN_WRITTEN_IN for true, _ in pairs):
        pairs += tuple((true, wrong) for true in LATIN_WRITTEN_IN for wrong in LATIN_READ_AS if true != wrong and (true, wrong) not in pairs)
    known: dict[tuple[str, str, str], list] = {}

    def options(a: int, b: int) -> list[tuple[float, str, tuple[str, str], bool]]:
        """Readings of a span that are likelier than it is: gain, text, pair, and whether bytes were lost."""
        piece, before, after = text[a:b], text[max(0, a - 2) : a], text[b : b + 2]
        key = (piece, before, after)
        if key not in known:
            own, best, ends = None, {}, {}
            for good, pair, lack in readings(piece, pairs):
                own = usualness(piece, before, after, samples) if own is None else own
                if good not in ends:  # most encodings that can read it read the same
                    ends[good] = settled(good, before, after, samples)
                value, good = ends[good]
                gain = value - own + lack
                if gain >= BETTER and (pair not in best or gain > best[pair][0]):
                    best[pair] = (gain, good, pair, False)
            for good, pair in partly(piece) if not best else ():
                gain = usualness(good, before, after, samples) - usualness(piece, before, after, samples)
                if gain >= BETTER:
                    best[pair] = (gain, good, pair, True)
            known[key] = list(best.values())
        return known[key]

    chosen: list[tuple[int, int, list]] = []
    k = 0
    for a, b, x, y in grouped(text, hit):
        while k < len(other) and other[k][1] <= a:
            k += 1
        explained = k < len(other) and other[k][0] < b
        some = [o for o in options(a, b) if not (explained and o[3])]
        if not some and (x, y) != (a, b) and not explained:  # the matched part alone
            a, b, some = x, y, options(x, y)
        chosen.append((a, b, some))
    explains: Counter = Counter()
    for _, _, some in chosen:
        for gain, _, pair, _ in some:
            explains[pair] += min(gain, 30.0)
    first = explains.most_common(1)[0][0] if explains else None
    if first:  # what correct text has too, garbled like the rest: likelier by the same pair
        held, k = [], 0
        for m in RUNS.finditer(text):
            if first[0] == "utf-8" and m.end() - m.start() < 2:
                continue
            while k < len(chosen) and chosen[k][1] <= m.start():
                k += 1
            if k == len(chosen) or chosen[k][0] >= m.end():
                held += [(m.start(), m.end(), [o]) for o in options(*m.span()) if o[2] == first and o[0] >= SURELY]
        chosen = sorted([*chosen, *held])
    parts, at, changed, lost = [], 0, 0, False
    for a, b, some in chosen:
        if some:
            best = max(some, key=lambda o: o[0] + PREFERRED * (o[2] == first))
            parts += [text[at:a], best[1]]
            at, changed, lost = b, changed + 1, lost or best[3]
    return "".join([*parts, text[at:]]), changed, lost


def garbled(df: DataFrame, samples: list[str] | Counts, doc_id: str = "doc_id", text: str = "text", with_text: bool = True) -> DataFrame:
    """The id of each affected row; with ``with_text`` also the restored text, the number of restored spans and ``whole`` (nothing garbled is left)."""
    known = samples if isinstance(samples, Counts) else tuple(sorted(set(samples)))
    kind = dict(df.select(F.col(f"`{doc_id}`").alias("i")).dtypes)["i"]
    src = df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text")).filter(F.col("text").rlike(r"[^\x00-\x7f]"))
    kinds = [pa.string(), pa.int32(), pa.bool_()]

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = [(i, t) for i, t in enumerate(batch.column(1).to_pylist()) if is_garbled(t, known)]
            columns, names = [batch.column(0).take(pa.array([i for i, _ in hit], pa.int64()))], ["doc_id"]
            if with_text:
                done = [restored(t, known) for _, t in hit]
                columns += [pa.array([row[k] for row in done], kind) for k, kind in enumerate(kinds)]
                names += ["restored", "spans", "whole"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return src.mapInArrow(convert, f"doc_id {kind}" + (", restored string, spans int, whole boolean" if with_text else ""))
