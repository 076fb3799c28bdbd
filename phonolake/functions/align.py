"""Edit distances and error rates.

The distance of token arrays runs in the JVM: the tokens of a pair get one letter for each
distinct token, and the built-in ``levenshtein`` compares the letter strings. The letters are
those of one byte, and for pairs with more distinct tokens than these, the ``WIDE`` code points
of a constant string. Only pairs with still more take the array form, a fold over the rows of
the table. Equal arrays have distance 0 without either. Null arrays give null; an empty side gives the size of the other.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from phonolake.functions import text as tx

LETTERS = 255
#: Letters of pairs with many distinct tokens: as many code points in a row as one block has.
WIDE = "".join(map(chr, range(0x4E00, 0xA000)))


def fold_distance(a: Column, b: Column) -> Column:
    """Unit-cost distance by a fold over the rows of the dynamic program."""
    def row(prev: Column, token: Column) -> Column:
        def cell(cur: Column, j: Column) -> Column:
            best = F.least(F.element_at(cur, j) + 1, F.element_at(prev, j + 1) + 1, F.element_at(prev, j) + F.when(F.element_at(b, j) == token, 0).otherwise(1))
            return F.concat(cur, F.array(best))

        return F.aggregate(F.sequence(F.lit(1), F.size(b)), F.array(F.element_at(prev, 1) + 1), cell)

    table = F.aggregate(a, F.sequence(F.lit(0), F.size(b)), row)
    return F.when(F.size(b) == 0, F.size(a)).otherwise(F.element_at(table, -1))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once a row, also where it stands in inner functions."""
    return F.element_at(F.transform(F.array(value), body), 1)


def token_distance(a: Column, b: Column) -> Column:
    """Distance of two token arrays."""
    def body(s: Column) -> Column:
        x, y, known = s["a"], s["b"], s["known"]
        spelt = lambda v: F.array_join(F.transform(v, lambda w: F.chr(F.array_position(known, w))), "")
        wide = lambda v: F.array_join(F.transform(v, lambda w: F.substr(F.lit(WIDE), F.array_position(known, w).cast("int"), F.lit(1))), "")
        some = F.when(F.size(known) <= LETTERS, F.levenshtein(spelt(x), spelt(y))).when(F.size(known) <= len(WIDE), F.levenshtein(wide(x), wide(y)))
        return F.when(x == y, 0).otherwise(some.otherwise(fold_distance(x, y))).cast("int")

    both = let(F.struct(a.alias("a"), b.alias("b")), lambda s: F.struct(s["a"], s["b"], F.array_distinct(F.concat(s["a"], s["b"])).alias("known")))
    return let(both, body)


def rate(errors: Column, length: Column) -> Column:
    """Errors by reference length; null without a reference, above 1 where the hypothesis is longer."""
    return F.when(length > 0, errors.cast("double") / length)


def counts(reference: Column, hypothesis: Column) -> Column:
    """Struct of word and character errors and lengths of a normalized pair; a null hypothesis counts as empty."""
    def body(s: Column) -> Column:
        ref, hyp = tx.split_words(s["r"]), tx.split_words(s["h"])
        ref_chars, hyp_chars = tx.squeezed(s["r"]), tx.squeezed(s["h"])
        return F.struct(
            token_distance(ref, hyp).alias("word_errors"), F.size(ref).alias("reference_words"),
            F.levenshtein(ref_chars, hyp_chars).alias("character_errors"), F.length(ref_chars).alias("reference_characters"),
        )

    return let(F.struct(reference.alias("r"), F.coalesce(hypothesis, F.lit("")).alias("h")), body)


def metric(c: Column) -> Column:
    """Struct of rates from a struct of counts."""
    return F.struct(
        rate(c["word_errors"], c["reference_words"]).alias("wer"), rate(c["character_errors"], c["reference_characters"]).alias("cer"),
        c["reference_words"].alias("reference_words"), c["reference_characters"].alias("reference_characters"),
    )


def script_metrics(reference: Column, hypothesis: Column) -> Column:
    """Script-aware struct of a normalized pair.

    ``wrong_script_rate`` is what the usual definition gives, 0 for any reference with words
    (no word holds Devanagari and is Latin throughout); ``wrong_script_words`` counts the
    reference's Latin words that the hypothesis lacks while it has more Devanagari words.
    """
    def parts(s: Column) -> Column:
        return F.struct(
            s["r"].alias("r"), s["h"].alias("h"), tx.latin_words(s["r"]).alias("rl"), tx.latin_words(s["h"]).alias("hl"),
            tx.devanagari(s["r"]).alias("rd"), tx.devanagari(s["h"]).alias("hd"),
        )

    def body(s: Column) -> Column:
        return F.struct(
            tx.is_code_mixed(s["r"]).alias("is_code_mixed"),
            rate(F.levenshtein(s["rd"], s["hd"]), F.length(s["rd"])).alias("devanagari_cer"),
            rate(token_distance(s["rl"], s["hl"]), F.size(s["rl"])).alias("latin_word_wer"),
            rate(F.size(F.array_intersect(s["rl"], s["hl"])), F.size(F.array_distinct(s["rl"]))).alias("english_word_accuracy"),
            F.when(F.size(tx.split_words(s["r"])) > 0, F.lit(0.0)).alias("wrong_script_rate"),
            wrong_script_words(s["r"], s["h"]).alias("wrong_script_words"),
        )

    return let(let(F.struct(reference.alias("r"), hypothesis.alias("h")), parts), body)


def wrong_script_words(reference: Column, hypothesis: Column) -> Column:
    lost = F.size(F.array_except(tx.latin_words(reference), tx.latin_words(hypothesis)))
    deva = lambda x: F.size(F.filter(tx.split_words(x), lambda w: w.rlike(rf"[{tx.DEVANAGARI}]")))
    return F.when(deva(hypothesis) > deva(reference), F.least(lost, deva(hypothesis) - deva(reference))).otherwise(0)


def raw_tokens(text: Column) -> Column:
    """Words of the text as it is, by single blanks after trimming."""
    return F.filter(F.split(F.trim(text), r"(?U)\s+"), lambda w: w != "")


def raw_metric(reference: Column, hypothesis: Column) -> Column:
    """Rates of the texts as they are; null without a reference."""
    ref, hyp = raw_tokens(reference), raw_tokens(F.coalesce(hypothesis, F.lit("")))
    a, b = F.trim(reference), F.trim(F.coalesce(hypothesis, F.lit("")))
    return F.struct(rate(token_distance(ref, hyp), F.size(ref)).alias("wer"), rate(F.levenshtein(a, b), F.length(a)).alias("cer"))
