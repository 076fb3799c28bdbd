"""Language of each document and of each stretch of it, with a confidence.

Method: hashed subwords (runs of one to four letters with word ends) have embeddings; a
sentence is their average; a linear softmax gives languages. Embeddings and weights are
trained together by stochastic gradient descent in numpy on labelled sentences (a few hundred,
a fixed table) and parts of them, in small steps of ``STEP`` rows, and the probabilities are
calibrated on parts kept aside. The limit of rejection is calibrated on whole sentences that a
second model wasn't trained on: a stretch less sure than all but ``LOST`` of them is of no known
language (``und``). A sentence that alone isn't trusted leans on its neighbours, by the best path
over the sentences with a price for each change.

Defined results: null and blank texts have no segment; a text without letters has the language
``und`` with confidence 0; one-language texts are one segment; offsets count code points of
the stored text; very long texts are read whole; repeated rows give repeated results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phonolake.llm.canonical import canonical_array
from phonolake.llm.sentences import BLANKS, trained

BUCKETS, WIDTH, ORDERS = 2**15, 16, (1, 2, 3, 4)
PARTS, EPOCHS, RATE, STEP = 8, 9, 0.5, 16
#: Probability under which a sentence alone is not trusted; price of a change of language.
REJECT, CHANGE = 0.55, 1.2
CHARS = 30_000
#: Share of the sentences kept aside (one of ``FOLDS``) that rejection may lose; letters from which a text has the limit of long ones.
LOST, LONG, FOLDS = 0.05, 15, 4
#: Sentences whose probabilities a worker keeps between batches.
KEEP = 100_000
#: Rows of a labelled table that the training takes at most, and their length in characters; share of right labels it counts with; how sure a sentence's language must be.
LABELLED, LABELLED_CHARS, RIGHT, SURE = 4000, 2000, 0.85, 0.9
# Usual names and codes of the languages.
NAMES = {
    "hi": "hi hin hindi हिन्दी हिंदी hinglish", "en": "en eng english", "mr": "mr mar marathi मराठी", "bn": "bn ben bengali bangla বাংলা", "ta": "ta tam tamil தமிழ்",
    "ur": "ur urd urdu اردو", "es": "es spa spanish español castilian", "fr": "fr fra fre french français", "de": "de deu ger german deutsch", "ru": "ru rus russian русский",
    "zh": "zh zho chi cmn chinese mandarin 中文", "ja": "ja jpn japanese 日本語", "th": "th tha thai ไทย",
}
NO_LANGUAGE = "unknown auto und undetermined none null nan n/a na - ? mul mis zxx unk multiple".split()


def label_language(label: Column) -> Column:
    """The language that a label names in any usual form; '' where it names none, the label itself for other languages."""
    first = F.regexp_extract(F.lower(F.trim(label)), r"^([^\s_\-(/]+)", 1)
    known = F.create_map(*[x for lang, names in NAMES.items() for n in names.split() for x in (F.lit(n), F.lit(lang))])
    none = label.isNull() | (F.trim(label) == "") | F.lower(F.trim(label)).isin(NO_LANGUAGE) | (first == "") | first.isin(NO_LANGUAGE)
    return F.when(none, F.lit("")).otherwise(F.coalesce(F.element_at(known, first), first))


def grams(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Bucket and text of each subword of the texts, by order; each part is sorted by text. Digits and marks count as blanks."""
    from phonolake.llm.repetition import looked_up

    joined = "\n" + "\n".join(t.replace("\n", " ") for t in texts) + "\n"
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.cumsum(code == 10) - 1
    small, word = looked_up(code)
    word &= ~((code >= 48) & (code < 58))
    code = np.where(word, small, 32).astype(np.uint64)
    keep = word | np.append(True, word[:-1]) | np.append(word[1:], True)
    keep &= ~((code == 32) & np.append(False, (code[:-1] == 32) & (owner[:-1] == owner[1:]) & ~np.append(word[2:], [False, False])[: len(code) - 1]))
    code, owner, word = code[keep], owner[keep], word[keep]
    parts = []
    for n in ORDERS:
        size = len(code) - n + 1
        if size < 1:
            continue
        h = np.full(size, n * 7919, np.uint64)
        inside = np.ones(size, bool)
        for k in range(n):
            h = (h ^ code[k : k + size]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(32)
            if 0 < k < n - 1:
                inside &= word[k : k + size]  # a blank only at the ends
        inside &= owner[:size] == owner[n - 1 : n - 1 + size]
        if n == 1:
            inside &= word
        parts.append(((h[inside] % np.uint64(BUCKETS)).astype(np.int64), owner[:size][inside]))
    # whole words, from blank to blank
    first = np.flatnonzero(word & ~np.append(False, word[:-1]))
    if len(first):
        last = np.flatnonzero(word & ~np.append(word[1:], False))
        place = np.arange(len(code)) - np.repeat(np.append(0, first), np.diff(np.append(np.append(0, first), len(code))))
        mixed = (code + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        mixed = np.where(word, (mixed ^ (mixed >> np.uint64(29))) * (place.astype(np.uint64) * np.uint64(2) + np.uint64(1)), np.uint64(0))
        h = np.add.reduceat(mixed, first)
        h ^= h >> np.uint64(32)
        parts.append(((h % np.uint64(BUCKETS)).astype(np.int64), owner[last]))
    return parts


#: Blocks of the scripts: letters outside them count as Latin.
SCRIPTS = {"cyrillic": "[\u0400-\u052f]", "arabic": "[\u0600-\u06ff\u0750-\u077f]", "devanagari": "[\u0904-\u0939\u0958-\u0961]", "bengali": "[\u0980-\u09ff]", "tamil": "[\u0b80-\u0bff]", "thai": "[\u0e00-\u0e7f]", "kana": "[\u3041-\u30ff]", "han": "[\u3400-\u9fff]"}


@cache
def script_table() -> np.ndarray:
    """Code point: the number of its script, from 1; 0 for all others."""
    out = np.zeros(0xA001, np.uint8)
    for k, block in enumerate(SCRIPTS.values(), 1):
        for first, last in re.findall("(.)-(.)", block[1:-1]):
            out[ord(first) : ord(last) + 1] = k
    return out


def scripts_of(texts: list[str]) -> np.ndarray:
    """How many letters of each of the scripts a text has, by one look at the table for all of them."""
    table = script_table()
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    kind = table[np.minimum(code, len(table) - 1)]
    odd = kind > 0
    return np.bincount(owner[odd] * len(SCRIPTS) + kind[odd] - 1, minlength=len(texts) * len(SCRIPTS)).reshape(len(texts), len(SCRIPTS))


def once(text: str) -> str:
    """Each word of a text once: what is said again tells nothing new."""
    return " ".join(dict.fromkeys(text.split()))


class Classifier:
    """Embeddings times weights in one table: the score of a text is the average of its subwords' rows.

    ``uses`` tells the share of each class's training sentences with letters of each script; a
    class that has never or nearly never a script of the text, or always one that it lacks, is
    out of the question for it. ``limits`` are the probabilities of rejection, of short and long
    texts.
    """

    def __init__(self, table: np.ndarray, bias: np.ndarray, classes: list[str], heat: float, uses: np.ndarray) -> None:
        self.table, self.bias, self.classes, self.heat, self.uses = table, bias, classes, heat, uses
        self.limits = [0.0, 0.0]
        self.languages = sorted({c.split("-")[0] for c in classes})
        self.sums = np.array([[c.split("-")[0] == lang for lang in self.languages] for c in classes], np.float64)

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Raw scores by class, and the number of subwords."""
        out, size = np.zeros((len(texts), len(self.classes))), np.zeros(len(texts), np.int64)
        a = 0
        while a < len(texts):
            b, chars = a, 0
            while b < len(texts) and (b == a or chars + len(texts[b]) < CHARS):
                chars += len(texts[b])
                b += 1
            for bucket, own in grams(texts[a:b]):
                if len(own):
                    starts = np.flatnonzero(np.diff(own, prepend=-1))
                    out[a + own[starts]] += np.add.reduceat(self.table[bucket], starts, axis=0)
                    size[a + own[starts]] += np.diff(np.append(starts, len(own)))
            a = b
        return out / np.maximum(size, 1)[:, None] + self.bias, size

    def probabilities(self, texts: list[str]) -> np.ndarray:
        """Calibrated probability of each language; even where a text has no letters."""
        z, size = self.scores([once(t) for t in texts])
        many = scripts_of(texts)
        has = many > 0
        # a class of a script of its own needs letters of one of its scripts; one without kana can't have written kana
        own = self.uses > 0.5
        fits = ~own.any(axis=1)[None, :] | (has[:, None, :] & own[None, :, :]).any(axis=2)
        kana = list(SCRIPTS).index("kana")
        fits &= ~(has[:, kana][:, None] & (self.uses[:, kana] < 0.02)[None, :] & own.any(axis=1)[None, :])
        # most of the letters aren't of a script that the class never uses
        letters = np.array([sum(map(str.isalpha, t)) for t in texts])
        fits &= ~((many * 2 > letters[:, None])[:, None, :] & (self.uses < 0.02)[None, :, :]).any(axis=2)
        fits[~fits.any(axis=1)] = True
        p = softmax(np.where(fits, z * self.heat, -50.0))
        p = np.stack([p[:, own].sum(axis=1) for own in self.sums.T > 0], axis=1)
        p[size == 0] = 1 / len(self.languages)
        return p


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def latin(text: str) -> bool:
    return sum(c.isalpha() and c < "\u0250" for c in text) > 0.6 * sum(c.isalpha() for c in text)


def train(samples: list[tuple[str, str]], labelled: list[tuple[str, str]] = (), seed: int = 5) -> Classifier:
    """From labelled sentences (language, text); a language in two scripts is two classes that are added up.

    ``labelled`` rows (a bounded sample, language by a label that may be wrong) are split into
    sentences; the model of the sentences alone and the label together tell each one's
    language where they are sure, and the model is trained again with these.
    """
    key = (tuple(samples), tuple(labelled), seed)
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = _train(samples, labelled, seed)
    return _MODELS[key]


#: The last model trained on this driver, by what it was trained on.
_MODELS: dict[tuple, Classifier] = {}


def _train(samples: list[tuple[str, str]], labelled: list[tuple[str, str]], seed: int) -> Classifier:
    model = fitted(samples, seed)
    bounds = model.limits = limits(samples, seed)
    if not labelled:
        return model
    splitter = trained(tuple(sorted(set(samples))))
    parts = [(lang, t[a:b]) for lang, t in labelled if t for a, b in units(t, splitter.split(t)) if lang in model.languages]
    canon = canonical_array(pa.array([t for _, t in parts], pa.string()))
    votes: dict[str, np.ndarray] = {}
    for (lang, _), t in zip(parts, canon, strict=True):
        votes.setdefault(t, np.zeros(len(model.languages)))[model.languages.index(lang)] += 1
    texts = sorted(votes)
    # a label is right with RIGHT, or else any other; a sentence that comes often is told by its labels
    n = np.array([votes[t] for t in texts])
    wrong = np.log((1 - RIGHT) / (len(model.languages) - 1))
    odds = n * np.log(RIGHT) + (n.sum(axis=1, keepdims=True) - n) * wrong + 0.5 * np.log(model.probabilities(texts) + 1e-9)
    p = softmax(odds)
    more = [(model.languages[k], t) for k, t, sure in zip(p.argmax(axis=1), texts, p.max(axis=1), strict=True) if sure > SURE]
    model = fitted(samples, seed, more)
    model.limits = bounds
    return model


def fitted(samples: list[tuple[str, str]], seed: int, more: list[tuple[str, str]] = ()) -> Classifier:
    """Embeddings, weights and calibration by stochastic gradient descent."""
    rng = np.random.default_rng(seed)
    samples = [*sorted(set(samples)), *more]
    canon = canonical_array(pa.array([t for _, t in samples], pa.string()))
    natural = {lang: sum(latin(t) for (x, _), t in zip(samples, canon, strict=True) if x == lang) for lang in {x for x, _ in samples}}
    many = {lang: sum(x == lang for x, _ in samples) for lang in natural}
    names = [lang + ("-latin" if latin(t) and natural[lang] < many[lang] else "") for (lang, _), t in zip(samples, canon, strict=True)]
    classes = sorted(set(names))
    texts, labels, held = [], [], []
    for i, (name, t) in enumerate(zip(names, canon, strict=True)):
        for k in range(PARTS) if i < len(samples) - len(more) else (0, PARTS - 1):
            part = t
            if k:
                words = t.split(" ") if " " in t else list(t)
                n = int(rng.integers(1, len(words) + 1))
                a = int(rng.integers(0, len(words) - n + 1))
                part = (" " if " " in t else "").join(words[a : a + n])
            if any(c.isalpha() for c in part):
                # a part in Latin letters of a text in another script is of no language
                if latin(part) and not latin(t):
                    continue
                texts.append(part)
                labels.append(classes.index(name))
                held.append(k == PARTS - 1)
    labels, held = np.array(labels, np.int64), np.array(held, bool)
    parts = grams([once(t) for t in texts])
    bucket, own = (np.concatenate([x[k] for x in parts]) for k in (0, 1))
    order = np.argsort(own, kind="stable")
    bucket, own = bucket[order], own[order]
    starts = np.searchsorted(own, np.arange(len(texts) + 1))
    emb = rng.normal(0, 0.1, (BUCKETS, WIDTH))
    weights, bias = rng.normal(0, 0.1, (WIDTH, len(classes))), np.zeros(len(classes))
    own_rows = np.flatnonzero(~held & (np.diff(starts) > 0))
    size = np.diff(starts)
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        order = rng.permutation(own_rows)
        for k in range(0, len(order), STEP):
            rows = order[k : k + STEP]
            n = size[rows]
            first = np.cumsum(n) - n
            b = bucket[np.arange(n.sum()) + np.repeat(starts[rows] - first, n)]
            x = np.add.reduceat(emb[b], first, axis=0) / n[:, None]
            p = softmax(x @ weights + bias)
            p[np.arange(len(rows)), labels[rows]] -= 1
            step = (p @ weights.T) * (rate / np.sqrt(n) / 2)[:, None]
            weights -= rate * (x.T @ p)
            bias -= 0.1 * rate * p.sum(axis=0)
            np.subtract.at(emb, b, np.repeat(step, n, axis=0))
    table = (emb @ weights).astype(np.float32)
    has = scripts_of(canon) > 0
    uses = np.array([has[[name == c for name in names]].mean(axis=0) for c in classes])
    model = Classifier(table, bias, classes, 1.0, uses)
    kept = [t for t, h in zip(texts, held, strict=True) if h]
    z, _ = model.scores(kept)
    y = labels[held]
    heats = np.geomspace(0.2, 5, 40)
    loss = [-np.log(softmax(z * h)[np.arange(len(y)), y] + 1e-12).mean() for h in heats]
    model.heat = float(heats[int(np.argmin(loss))]) if len(y) else 1.0
    return model


def limits(samples: list[tuple[str, str]], seed: int) -> list[float]:
    """Probabilities of rejection, of short and long texts: what all but ``LOST`` of sentences that a model wasn't trained on reach."""
    samples = sorted(set(samples))
    model = fitted([x for i, x in enumerate(samples) if i % FOLDS], seed)
    aside = canonical_array(pa.array([t for _, t in samples[::FOLDS]], pa.string()))
    short = [" ".join(w) if " " in t else "".join(w) for t in aside for w in [(t.split(" ") if " " in t else list(t))[:2]] if any(c.isalpha() for x in w for c in x)]
    return [float(np.quantile(model.probabilities(t).max(axis=1), LOST)) if t else 0.0 for t in (short, aside)]


THAI_CHANGE = re.compile(r"(?<=[ก-๎]) +(?=[^\s\dก-๎])")
LETTERS = re.compile(r"[^\W\d_]{2,}")


def units(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sentences, also ended where unmarked Thai gives way to three or more words, or to other letters than Latin ones."""
    out = []
    for a, b in spans:
        at = a
        piece = text[a:b]
        if "ก" <= max(piece) and any("ก" <= c <= "๎" for c in piece):
            for m in THAI_CHANGE.finditer(piece):
                rest = re.split(r"[ก-๎]", piece[m.end() :], maxsplit=1)[0]
                words = LETTERS.findall(rest)
                if len(words) > 2 or any(ord(w[0]) > 0x2FF for w in words):
                    out.append((at, a + m.start()))
                    at = a + m.end()
        out.append((at, b))
    return out


def path(p: np.ndarray) -> list[int]:
    """The best sequence of languages: log probabilities, less for what is not trusted, and a price for each change."""
    trust = np.where(p.max(axis=1) >= REJECT, 1.0, 0.25)[:, None]
    e = np.log(p + 1e-6) * trust
    best, back = e[0], []
    for row in e[1:]:
        stay, change = best, best.max() - CHANGE
        back.append(np.where(stay >= change, np.arange(len(best)), int(best.argmax())))
        best = np.maximum(stay, change) + row
    out = [int(best.argmax())]
    for b in reversed(back):
        out.append(int(b[out[-1]]))
    return out[::-1]


def labelled_rows(df: DataFrame, key: str, text: str, label: str, rows: int = LABELLED) -> list[tuple[str, str]]:
    """A bounded sample of rows whose label names one of the languages: the lowest hashes of their keys, at most ``rows``, of less than ``LABELLED_CHARS`` characters, as they go to the driver."""
    named = df.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t"), label_language(F.col(f"`{label}`")).alias("lang"))
    named = named.filter(F.col("lang").isin(list(NAMES)) & (F.length("t") > 0) & (F.length("t") < LABELLED_CHARS))
    return [(r["lang"], r["t"]) for r in named.orderBy(F.xxhash64("k"), "k").select("lang", "t").limit(rows).collect()]


class Scorer:
    """The model in a worker: probabilities of raw sentences, kept for those that come again."""

    def __init__(self, model: Classifier) -> None:
        self.model, self.kept = model, {}

    def __call__(self, sentences: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probabilities by language, number of letters and of characters of each sentence."""
        kept = self.kept
        new = [t for t in dict.fromkeys(sentences) if t not in kept]
        if len(kept) + len(new) > KEEP:
            kept.clear()
            new = list(dict.fromkeys(sentences))
        if new:
            canon = canonical_array(pa.array(new, pa.string()))
            distinct = {t: k for k, t in enumerate(dict.fromkeys(canon))}
            p = self.model.probabilities(list(distinct))
            for raw, t in zip(new, canon, strict=True):
                kept[raw] = (p[distinct[t]], sum(map(str.isalpha, t)), len(t))
        rows = [kept[t] for t in sentences]
        if not rows:
            return np.empty((0, len(self.model.languages))), np.empty(0, np.int64), np.empty(0, np.int64)
        return np.stack([r[0] for r in rows]), np.array([r[1] for r in rows]), np.array([r[2] for r in rows])


def segments(df: DataFrame, ids: list[str], text: str, samples: list[tuple[str, str]], labelled: list[tuple[str, str]] = (), carry: list[str] | None = None, reject: bool = True) -> DataFrame:
    """Ids (and carried columns), seg_no, n_segs, n_langs, start_char, end_char, lang and confidence of each stretch in one language.

    With ``reject`` a stretch that isn't sure enough has the language ``und``; its confidence is
    that of the likeliest one.
    """
    known = tuple(sorted(set(samples)))
    model = train(list(known), labelled)
    keep = [*ids, *(carry or [])]
    src = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("text")).filter(F.length("text") > 0)
    kinds = ", ".join(f"`{c}` {k}" for c, k in src.dtypes[: len(keep)])

    splitter = trained(known)

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from phonolake.llm.tokens import portions

        score = Scorer(model)
        for batch in batches:
            all_texts = batch.column(len(keep)).to_pylist()
            for first, last in portions(all_texts):
                texts = all_texts[first:last]
                spans = [units(t, splitter.split(t)) for t in texts]
                p, letters, sizes = score([t[a:b] for t, s in zip(texts, spans, strict=True) for a, b in s])
                top = p.argmax(axis=1)
                rows, values, at = [], [], 0
                for i, s in enumerate(spans, first):
                    if not s:
                        continue
                    end_at = at + len(s)
                    way = top[at:end_at]
                    if (way != way[0]).any():  # else no change can pay
                        way = np.array(path(p[at:end_at]))
                    cuts = [0, *(np.flatnonzero(way[1:] != way[:-1]) + 1).tolist(), len(s)]
                    langs = len(set(way.tolist()))
                    for no, (k, end) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        mine, lang = slice(at + k, at + end), way[k]
                        n = int(letters[mine].sum())
                        sure = float(p[mine, lang] @ sizes[mine] / sizes[mine].sum()) if n else 0.0
                        name = model.languages[lang] if n and not (reject and sure < model.limits[n >= LONG]) else "und"
                        rows.append(i)
                        values.append((no, len(cuts) - 1, langs, s[k][0], s[end - 1][1], name, sure))
                    at = end_at
                take = pa.array(rows, pa.int64())
                columns = list(zip(*values, strict=True)) if values else [[]] * 7
                types = [pa.int32()] * 5 + [pa.string(), pa.float64()]
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(take) for k in range(len(keep))), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], [*keep, "seg_no", "n_segs", "n_langs", "start_char", "end_char", "lang", "confidence"])

    return src.mapInArrow(convert, f"{kinds}, seg_no int, n_segs int, n_langs int, start_char int, end_char int, lang string, confidence double")


def mislabelled(df: DataFrame, ids: list[str], text: str, label: str, samples: list[tuple[str, str]]) -> DataFrame:
    """The segments of rows whose label names no language, or another than the only one, or that have several."""
    marked = df.withColumn("__named", label_language(F.col(f"`{label}`")))
    told = labelled_rows(df, ids[0], text, label)
    found = segments(marked.filter(F.trim(F.translate(F.col(f"`{text}`"), BLANKS, "")) != ""), ids, text, samples, told, ["__named"], reject=False)
    return found.filter((F.col("__named") == "") | (F.col("n_langs") > 1) | (F.col("__named") != F.col("lang"))).drop("__named")
