"""One consistent form for text that looks the same but is made of other characters.

The rewriting runs in DuckDB inside each Arrow partition (``mapInArrow``): embedded SQL
with ``nfc_normalize``, ``translate`` and regular expressions. No shuffle, no driver state.
DuckDB gets slices of ``SLICE`` bytes; a longer text goes through in parts that begin at blanks
(or before other places that no step looks across), with what holds of the whole text told of
each part, so that its form is the same as in one piece.

Letters are judged by word and by text: Greek and Cyrillic letters become Latin in Latin words
and where the text has no letter of their alphabet alone (a small alpha that stands alone is a
sign and stays); Arabic letters take Urdu's shapes in texts that have a letter of Urdu's own.

Defined results: null stays null and is never a case; empty and blank text stay as they are;
repeated rows give repeated results; columns that the caller does not name are not read, so
extra columns with clashing names are harmless; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Look-alike letters. Position i of one string looks like position i of the other.
CYRILLIC_LOOKALIKES = "АВЕЅІЈКМНОРСТУХаеорсухѕіјһԁԛԝ"
CYRILLIC_AS_LATIN = "ABESIJKMHOPCTYXaeopcyxsijhdqw"
GREEK_LOOKALIKES = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοα"
GREEK_AS_LATIN = "ABEZHIKMNOPTYXoa"
# Greek letters that look like no Latin letter, and the one that is also a sign of its own.
GREEK_ONLY = "ΓΔΘΛΞΠΣΦΨΩβγδεζηθικλμνξπρςστυφχψωάέήίόύώϊϋΐΰ"
GREEK_SIGN = "α"
# Latin letters that stand for Cyrillic ones inside a Russian word, and the others.
LATIN_IN_CYRILLIC = "ABEKMHOPCTXaeopcyx"
LATIN_AS_CYRILLIC = "АВЕКМНОРСТХаеорсух"
LATIN_ONLY = "DFGIJLNQRSUVWYZbdfghijklmnqrstuvwz"
# Letters of Russian that look like no Latin letter.
CYRILLIC_ONLY = "БГДЁЖЗИЙЛПФЦЧШЩЪЫЬЭЮЯбвгдёжзийклмнптфцчшщъыьэюя"
# Letters of other alphabets that stand for Russian ones in a Russian word, and what they stand for.
ODD_CYRILLIC = "ЅѕІіЈј"
ODD_AS_LATIN = "SsIiJj"
# Arabic letters that Urdu writes with letters of its own.
ARABIC_FORMS = "يىكه"
URDU_FORMS = "ییکہ"
# Letters that Urdu has and Arabic lacks.
URDU_ONLY = "ٹڈڑںےہھگچپژکی"
# Vowels typed as two signs, and the usual single letter that looks the same.
SPLIT_VOWELS = [
    ("अाे", "ओ"), ("अाै", "औ"), ("अा", "आ"), ("अो", "ओ"),
    ("अौ", "औ"), ("अॉ", "ऑ"), ("अॅ", "ॲ"), ("आे", "ओ"),
    ("आै", "औ"), ("आॅ", "ऑ"), ("एे", "ऐ"), ("एॅ", "ऍ"),
    ("ाे", "ो"), ("ाै", "ौ"), ("ाॅ", "ॉ"), ("অা", "আ"),
    ("அா", "ஆ"), ("ํา", "ำ"), ("เเ", "แ"),
]
# Character classes of regular expressions.
INVISIBLE = r"\x{00AD}\x{034F}\x{061C}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180E}\x{200B}\x{200E}\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{2066}-\x{206F}\x{3164}\x{FEFF}\x{FFA0}"
SPACES = r"\x{00A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}"
HYPHENS = r"\x{2010}\x{2011}\x{FE58}\x{FE63}"
VIRAMAS = r"\x{094D}\x{09CD}\x{0A4D}\x{0ACD}\x{0B4D}\x{0BCD}\x{0C4D}\x{0CCD}\x{0D4D}"
ARABIC_LETTERS = r"\x{0620}-\x{064A}\x{066E}-\x{06D3}\x{06FA}-\x{06FF}"
EMOJI = r"\x{1F000}-\x{1FAFF}\x{2190}-\x{2BFF}\x{FE0F}"
WIDE_SCRIPTS = r"\x{3001}-\x{30FF}\x{3400}-\x{9FFF}"
#: Wide marks that Chinese and Japanese use; narrow in a text without their letters.
WIDE_MARKS = "！（），－：；？～"
#: Private code points that hold a joiner while the others are taken out.
HELD = (chr(0xF0000), chr(0xF0001))
#: Bytes of text that DuckDB gets at a time.
SLICE = 4_000_000


@cache
def compatibility() -> tuple[dict[str, str], dict[str, str]]:
    """Compatibility characters of one and of more letters, by rule from the Unicode data."""
    codes = [*range(0x2E80, 0x2FD6), *range(0xF900, 0xFAFF), *range(0xFB00, 0xFB07), 0x2103, 0x2109, 0x2126, 0x212A, 0x212B]
    codes += [*range(0xFB50, 0xFDFE), *range(0xFE70, 0xFEFD), *range(0xFF01, 0xFF5F), *range(0xFF66, 0xFF9E), *range(0x1D400, 0x1D800)]
    folded = {chr(c): unicodedata.normalize("NFKC", chr(c)) for c in codes if chr(c) not in WIDE_MARKS}
    changed = {a: b for a, b in folded.items() if a != b}
    return {a: b for a, b in changed.items() if len(b) == 1}, {a: b for a, b in changed.items() if len(b) > 1 and " " not in b and len(b) < 4}


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def tr(s: str, a: str, b: str) -> str:
    return f"translate({s}, {quoted(a)}, {quoted(b)})"


#: What the steps ask of a whole text: name of the flag, characters that it must hold.
FLAGS = {"wide": WIDE_SCRIPTS, "cyrillic": CYRILLIC_ONLY, "greek": GREEK_ONLY, "urdu": URDU_ONLY}


def steps() -> list:
    """The rewriting, each step a function from the SQL of a string to the SQL of the next; flags are columns."""
    single, several = compatibility()

    def invisible(s: str) -> str:
        s = f"regexp_replace({s}, '[{INVISIBLE}]', '', 'g')"
        for joiner, held in zip((r"\x{200C}", r"\x{200D}"), HELD, strict=True):
            s = f"regexp_replace({s}, '([{VIRAMAS}]){joiner}', '\\1{held}', 'g')"
        s = f"regexp_replace({s}, '([{ARABIC_LETTERS}])\\x{{200C}}([{ARABIC_LETTERS}])', '\\1{HELD[0]}\\2', 'g')"
        s = f"regexp_replace({s}, '([{EMOJI}])\\x{{200D}}', '\\1{HELD[1]}', 'g')"
        s = f"regexp_replace({s}, '[\\x{{200C}}\\x{{200D}}]', '', 'g')"
        return f"CASE WHEN regexp_matches({{0}}, '[{INVISIBLE}\\x{{200C}}\\x{{200D}}]') THEN translate({s}, '{HELD[0]}{HELD[1]}', chr(8204) || chr(8205)) ELSE {{0}} END"

    def composed(s: str) -> str:
        s = f"regexp_replace({s}, '[{SPACES}]', ' ', 'g')"
        return f"nfc_normalize(regexp_replace({s}, '[{HYPHENS}]', '-', 'g'))"

    def compatible(s: str) -> str:
        wide = tr(s, "".join(single), "".join(single.values()))
        narrow = tr(wide, WIDE_MARKS, "".join(chr(ord(m) - 0xFEE0) for m in WIDE_MARKS))
        return f"CASE WHEN wide THEN {wide} ELSE {narrow} END"

    def ligatures(s: str) -> str:
        for a, b in several.items():
            if not 0xFB50 <= ord(a) < 0xFE00:
                s = f"replace({s}, {quoted(a)}, {quoted(b)})"
        return s

    def vowels(s: str) -> str:
        for a, b in SPLIT_VOWELS:
            s = f"replace({s}, {quoted(a)}, {quoted(b)})"
        return f"CASE WHEN urdu THEN {tr(s, ARABIC_FORMS, URDU_FORMS)} ELSE {s} END"

    words = "regexp_extract_all({0}, '[\\pL\\pM]+|[^\\pL\\pM]+')"
    latin = "[A-Za-z\\x{00C0}-\\x{024F}]"

    def greek(s: str) -> str:
        never_alone = (GREEK_LOOKALIKES.replace(GREEK_SIGN, ""), GREEK_AS_LATIN[: GREEK_LOOKALIKES.index(GREEK_SIGN)])
        word = f"CASE WHEN regexp_matches(w, '{latin}') THEN {tr('w', GREEK_LOOKALIKES, GREEK_AS_LATIN)} WHEN greek THEN w ELSE {tr('w', *never_alone)} END"
        return f"CASE WHEN regexp_matches({s}, '[{GREEK_LOOKALIKES}]') THEN array_to_string(list_transform({words.replace('{0}', s)}, lambda w: {word}), '') ELSE {s} END"

    def lookalikes(s: str) -> str:
        all_latin = tr(s, CYRILLIC_LOOKALIKES, CYRILLIC_AS_LATIN)
        word = (
            f"CASE WHEN regexp_matches(w, '[{CYRILLIC_ONLY}]') THEN CASE WHEN regexp_matches(w, '[{LATIN_ONLY}]') THEN w ELSE {tr('w', LATIN_IN_CYRILLIC, LATIN_AS_CYRILLIC)} END "
            f"WHEN regexp_matches(w, '{latin}') THEN {tr('w', CYRILLIC_LOOKALIKES, CYRILLIC_AS_LATIN)} ELSE w END"
        )
        by_word = f"array_to_string(list_transform({words.replace('{0}', tr(s, ODD_CYRILLIC, ODD_AS_LATIN))}, lambda w: {word}), '')"
        return f"CASE WHEN NOT regexp_matches({s}, '[{CYRILLIC_LOOKALIKES}{CYRILLIC_ONLY}]') THEN {s} WHEN NOT cyrillic THEN {all_latin} ELSE {by_word} END"

    return [
        lambda s: invisible(s).replace("{0}", s),
        composed,
        compatible,
        ligatures,
        vowels,
        greek,
        lookalikes,
        lambda s: f"nfc_normalize({s})",
    ]


@cache
def suspect() -> str:
    """Regular expression that every text holds whose form differs from it; most texts don't.

    Built by rule: the classes above, the compatibility characters, the characters that the
    composed form never has, and those pairs of characters that it writes as one or reorders.
    """
    one = set(CYRILLIC_LOOKALIKES + GREEK_LOOKALIKES + ARABIC_FORMS) | set().union(*compatibility()) | set(WIDE_MARKS)
    one |= {chr(c) for c in range(0x300, 0x370)}
    pairs: dict[str, set[str]] = {}
    for c in map(chr, range(0x80, 0x30000)):
        if unicodedata.normalize("NFC", c) != c:
            one.add(c)
        d = unicodedata.decomposition(c).split()
        if len(d) == 2 and not d[0].startswith("<") and unicodedata.normalize("NFC", "".join(chr(int(x, 16)) for x in d)) == c:
            pairs.setdefault(chr(int(d[1], 16)), set()).add(chr(int(d[0], 16)))
    marks = [c for c in map(chr, range(0x370, 0x3100)) if unicodedata.combining(c)]
    for b in marks:
        if lower := {a for a in marks if unicodedata.combining(a) > unicodedata.combining(b)}:
            pairs.setdefault(b, set()).update(lower)

    def cls(chars: set[str] | list[str]) -> str:
        """Members of a class, neighbours as ranges."""
        codes, out = sorted(map(ord, chars)), []
        for c in codes:
            if out and c == out[-1][1] + 1:
                out[-1][1] = c
            else:
                out.append([c, c])
        return "".join(f"\\x{{{a:X}}}" if a == b else f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in out)

    by_first: dict[str, list[str]] = {}
    for b, firsts in pairs.items():
        if b not in one:
            by_first.setdefault(cls(firsts), []).append(b)
    single = f"[{INVISIBLE}{SPACES}{HYPHENS}\\x{{200C}}\\x{{200D}}{cls(one)}]"
    mixed = [f"[{LATIN_IN_CYRILLIC}][{CYRILLIC_ONLY}]", f"[{CYRILLIC_ONLY}][{LATIN_IN_CYRILLIC}]"]
    return "|".join([single, *mixed, *(f"[{a}][{cls(b)}]" for a, b in by_first.items()), *(a for a, _ in SPLIT_VOWELS)])


@cache
def canonical_sql(where: bool = True) -> str:
    """SQL that gives i and ``canon`` of the rows (i, text and the flags, null where the text is whole) of ``batch_t`` whose text is suspect."""
    flags = ", ".join(f"coalesce({name}, regexp_matches(text, '[{chars}]')) AS {name}" for name, chars in FLAGS.items())
    q, last = f"SELECT i, text AS s0, {flags} FROM batch_t" + (f" WHERE regexp_matches(text, '{suspect()}')" if where else ""), "s0"
    for k, step in enumerate(steps(), 1):
        q = f"SELECT * EXCLUDE ({last}), {step(last)} AS s{k} FROM ({q})"
        last = f"s{k}"
    return f"SELECT i, {last} AS canon FROM ({q})"


@cache
def connection():
    """One DuckDB for a Python worker, on one thread and with bounded memory."""
    import duckdb

    con = duckdb.connect(":memory:")
    con.execute("SET threads = 1; SET memory_limit = '400MB'; SET preserve_insertion_order = true")
    return con


def run_sql(query: str, batch: pa.Table) -> pa.Table:
    con = connection()
    con.register("batch_t", batch)
    try:
        result = con.sql(query)
        return result.to_arrow_table() if hasattr(result, "to_arrow_table") else result.fetch_arrow_table()
    finally:
        con.unregister("batch_t")


def rewritten(number: pa.Array, texts: pa.Array, flags: dict[str, bool] | None = None) -> tuple[list[int], pa.Array]:
    """Number and form of the suspect ones of some texts, by one run of the SQL."""
    table = {"i": number, "text": texts} | {f: pa.array([(flags or {}).get(f)] * len(texts), pa.bool_()) if flags else pa.nulls(len(texts), pa.bool_()) for f in FLAGS}
    out = run_sql(canonical_sql(), pa.table(table))
    return out.column("i").to_pylist(), out.column("canon").combine_chunks()


def parts_of(text: str, size: int) -> Iterator[str]:
    """A long text in parts of at least ``size`` characters that begin at a blank, or at a letter that nothing before it changes."""
    at = 0
    while at < len(text):
        end = at + size
        blank = next((m.start() for m in BLANK.finditer(text, end, end + 10_000)), None)
        if blank is None:
            blank = next((m.start() for m in FREE.finditer(text, end)), len(text))
        yield text[at:blank]
        at = blank


#: Where a part may begin: an ordinary blank; else a Thai consonant, Chinese or Japanese letter after one.
BLANK, FREE = re.compile(r"(?<=\S)[ \n]"), re.compile(r"(?<=[ก-ฮぁ-ヺ一-鿿])[ก-ฮぁ-ヺ一-鿿]| ")


def long_form(text: str) -> str:
    """The form of one text of more than ``SLICE`` bytes."""
    whole = {f: bool(re.search("[" + re.sub(r"\\x\{(\w+)\}", lambda m: chr(int(m[1], 16)), chars) + "]", text)) for f, chars in FLAGS.items()}
    out = []
    for part in parts_of(text, SLICE // 4):
        number, canon = rewritten(pa.array([0], pa.int64()), pa.array([part], pa.string()), whole)
        out.append(canon[0].as_py() if number else part)
    return "".join(out)


def changed(texts: pa.Array | pa.ChunkedArray) -> Iterator[tuple[list[int], pa.Array]]:
    """Numbers and forms of the suspect texts, slice by slice; every other text is its own form."""
    texts = texts.cast(pa.string())
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy()
    total = np.cumsum(sizes.astype(np.int64))
    a = 0
    while a < len(texts):
        done = total[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(total, done + SLICE, "right")))
        if b == a + 1 and sizes[a] > SLICE:
            yield [a], pa.array([long_form(texts[a].as_py())], pa.string())
        else:
            part = texts.slice(a, b - a)
            odd = pc.invert(pc.fill_null(pc.string_is_ascii(part), True))  # ASCII is its own form
            yield rewritten(pa.array(range(a, b), pa.int64()).filter(odd), part.filter(odd))
        a = b


def canonical_array(texts: pa.Array) -> list[str | None]:
    """The consistent form of each text, in order; for use inside other operators' workers."""
    done = texts.to_pylist()
    for number, canon in changed(texts):
        for i, c in zip(number, canon.to_pylist(), strict=True):
            done[i] = c
    return done


def canonical(df: DataFrame, ids: list[str], text: str, only_changed: bool = False, with_text: bool = True) -> DataFrame:
    """Rows of ``df`` with their text in the consistent form.

    Gives the id columns, and with ``with_text`` also ``text`` and ``canon``. ``only_changed``
    keeps the rows whose text differs from its form. A text of ASCII letters has one form only
    and is told in the JVM.
    """
    src = df.select(*[F.col(f"`{c}`") for c in ids], F.col(f"`{text}`").cast("string").alias("text"))
    if only_changed:
        src = src.filter(F.col("text").rlike(r"[^\x00-\x7f]"))
    fields = [src.schema[c] for c in ids] + ([T.StructField("text", T.StringType()), T.StructField("canon", T.StringType())] if with_text else [])
    names = [f.name for f in fields]

    def rows(batch: pa.RecordBatch, number: pa.Array, canon: pa.Array) -> pa.RecordBatch:
        columns = [batch.column(k).take(number) for k in range(len(ids) + with_text)]
        return pa.RecordBatch.from_arrays([*columns, *([canon] if with_text else [])], names)

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, told = batch.column(len(ids)), np.zeros(batch.num_rows, bool)
            for number, canon in changed(texts):
                at = pa.array(number, pa.int64())
                told[number] = True
                if only_changed:
                    differs = pc.not_equal(canon, texts.take(at).cast(pa.string()))
                    at, canon = at.filter(differs), canon.filter(differs)
                if len(at):
                    yield rows(batch, at, canon)
            if not only_changed and not told.all():
                rest = pa.array(np.flatnonzero(~told))
                yield rows(batch, rest, texts.take(rest))

    return src.mapInArrow(convert, T.StructType(fields))
