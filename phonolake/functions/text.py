"""Text as columns: normalization, tokens, scripts, keywords, identifiers.

All functions take and give Columns and stay in the JVM. Null in gives null out; an empty or
blank text gives an empty text or an empty array.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the normalization: joiners that are dropped, the block that is kept whole.
ZERO_WIDTH = "‌‍"
DEVANAGARI = r"\x{0900}-\x{097f}"
NOT_WORD = rf"(?U)[^\p{{L}}\p{{N}}_\s{DEVANAGARI}]"
LATIN_WORD = r"[A-Za-z]+(?:['-][A-Za-z]+)*"
# Consonants whose nukta is dropped when it is written as a sign of its own.
NUKTA_BASES = "कखगजडढफय"
NUKTA = "़"


@cache
def folding() -> tuple[str, str, list[tuple[str, str]]]:
    """Where case folding differs from small letters: letter for letter, and letters that become several."""
    one, many = {}, []
    for c in map(chr, range(0x80, 0x10000)):
        low, fold = c.lower(), c.casefold()
        if low != fold and len(low) == 1 and low.casefold() == fold:
            if len(fold) == 1 and c == low:
                one[c] = fold
            elif len(fold) > 1 and c == low and (c < "Ȁ" or "ﬀ" <= c <= "ﬆ"):
                many.append((c, fold))
    return "".join(one), "".join(one.values()), many


def casefold(text: Column) -> Column:
    a, b, many = folding()
    out = F.translate(F.lower(text), a, b)
    for x, y in many:
        out = F.replace(out, F.lit(x), F.lit(y))
    return out


def normalize(text: Column, strip_danda: bool = False) -> Column:
    """Case folding; joiners dropped; points and commas inside numbers dropped; other marks to blanks; blanks collapsed.

    The danda stays, as it lies in the block that is kept, unless ``strip_danda``.
    """
    out = F.translate(casefold(text), ZERO_WIDTH, "")
    out = F.regexp_replace(out, r"(?U)(?<=\d)[.,](?=\d)", "")
    out = F.regexp_replace(out, NOT_WORD, " ")
    if strip_danda:
        out = F.translate(out, "।॥", "  ")
    return F.trim(F.regexp_replace(out, r"(?U)\s+", " "))


def split_words(normal: Column) -> Column:
    """Words of a normalized text; none for an empty one."""
    return F.filter(F.split(normal, " "), lambda w: w != "")


def words(text: Column) -> Column:
    return split_words(normalize(text))


def squeezed(normal: Column) -> Column:
    """A normalized text without blanks: its characters in a row."""
    return F.regexp_replace(normal, r"(?U)\s", "")


def characters(text: Column) -> Column:
    return F.filter(F.split(squeezed(normalize(text)), ""), lambda c: c != "")


def devanagari(normal: Column) -> Column:
    """The Devanagari characters of a text, in a row."""
    return F.regexp_replace(normal, rf"[^{DEVANAGARI}]", "")


def latin_words(normal: Column) -> Column:
    return F.regexp_extract_all(normal, F.lit(LATIN_WORD), F.lit(0))


def is_code_mixed(normal: Column) -> Column:
    return normal.rlike(rf"[{DEVANAGARI}]") & normal.rlike("[A-Za-z]")


def fold_nukta(text: Column) -> Column:
    """Drops the nukta sign after its eight bases; letters with a built-in nukta stay."""
    return F.regexp_replace(text, f"(?<=[{NUKTA_BASES}]){NUKTA}", "")


def hinglish(text: Column, external=None) -> Column:
    """Training form: an external normalizer (a function of a Column) if given, nukta folding, blanks collapsed."""
    return F.trim(F.regexp_replace(fold_nukta(external(text) if external else text), r"(?U)\s+", " "))


def keyword_hits(text: Column, keywords: list[str]) -> Column:
    """The keywords that the text holds as a substring, whatever the case, in the order of the list."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.filter(F.array(*[F.lit(k) for k in keywords]), lambda k: F.contains(low, F.lower(k)))


def hotwords(keywords: Column) -> Column:
    return F.array_join(keywords, " ")


# Fixed value: how a decoding prompt names its keywords.
KEYWORD_PROMPT = "The following Hinglish conversation mentions terms such as: %s."


def keyword_prompt(keywords: Column, template: str = KEYWORD_PROMPT) -> Column:
    return F.format_string(template, F.array_join(keywords, ", "))


def prompt(template: str, *parts: Column) -> Column:
    """A template with its parts; a null part is an empty one."""
    return F.format_string(template, *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    """The name without its last extension; a name that begins with its only point is whole."""
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(base_name(path), r".(\.[^.]*)$", 1))


def parent(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.element_at(parts, -2)).otherwise(F.lit(""))


def line_id(line: Column) -> Column:
    """First token of a line without the colons at its end."""
    return F.regexp_replace(F.regexp_extract(line, r"(?U)^\s*(\S+)", 1), ":+$", "")


def line_text(line: Column) -> Column:
    """What follows the first token; null where nothing does."""
    rest = F.regexp_extract(line, r"(?Us)^\s*\S+\s+(.*?)\s*$", 1)
    return F.when(rest != "", rest)


def yes_no(flag: Column) -> Column:
    return F.when(flag, "YES").otherwise("NO")
