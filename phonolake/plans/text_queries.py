"""Named queries of the text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from phonolake.functions import align
from phonolake.functions import models
from phonolake.functions import text as tx
from phonolake.operators import report
from phonolake.plans.register import PAIRS, dealt, q, query, sql_norm, sql_words, table

KEYWORDS = ["refund", "order", "status", "रिफ़ंड", "ऑर्डर", "SMS", "plan"]
KEYWORD_LIST = "[" + ", ".join(q(k) for k in KEYWORDS) + "]"


def pairs(spark, folder):
    return dealt(spark, folder, "experiment_results", "result_id", "stage", "reference", "hypothesis").filter(F.col("reference").isNotNull()).withColumns({"r": tx.normalize(F.col("reference")), "h": tx.normalize(F.coalesce("hypothesis", F.lit("")))})


@query("x01_normalize", f"SELECT doc_id, md5({sql_norm('text')}) AS digest, length({sql_norm('text')})::INT AS n FROM documents")
def x01(spark, folder):
    n = tx.normalize(F.col("text"))
    return table(spark, folder, "documents").select("doc_id", F.md5(n).alias("digest"), F.length(n).alias("n"))


@query("x02_words", f"WITH w AS (SELECT result_id, {sql_words(sql_norm('hypothesis'))} AS w FROM experiment_results WHERE hypothesis IS NOT NULL) SELECT result_id, len(w)::INT AS n_words, md5(coalesce(array_to_string(w, '|'), '')) AS digest FROM w")
def x02(spark, folder):
    w = tx.words(F.col("hypothesis"))
    return table(spark, folder, "experiment_results").filter("hypothesis is not null").select("result_id", F.size(w).alias("n_words"), F.md5(F.array_join(w, "|")).alias("digest"))


@query("x03_characters", f"SELECT result_id, length(replace({sql_norm('hypothesis')}, ' ', ''))::INT AS n_chars, md5(replace({sql_norm('hypothesis')}, ' ', '')) AS digest FROM experiment_results WHERE hypothesis IS NOT NULL")
def x03(spark, folder):
    c = tx.characters(F.col("hypothesis"))
    return table(spark, folder, "experiment_results").filter("hypothesis is not null").select("result_id", F.size(c).alias("n_chars"), F.md5(F.array_join(c, "")).alias("digest"))


@query("x04_edit_distance", PAIRS + "SELECT result_id, word_errors, character_errors FROM p")
def x04(spark, folder):
    return report.scored(dealt(spark, folder, "experiment_results", "result_id", "stage", "reference", "hypothesis")).select("result_id", "counts.word_errors", "counts.character_errors")


@query("x05_error_rate", PAIRS + "SELECT result_id, round(word_errors / nullif(reference_words, 0), 6) AS rate FROM p")
def x05(spark, folder):
    return report.scored(dealt(spark, folder, "experiment_results", "result_id", "stage", "reference", "hypothesis")).select("result_id", F.round(align.rate(F.col("counts.word_errors"), F.col("counts.reference_words")), 6).alias("rate"))


@query("x06_metric", PAIRS + "SELECT result_id, round(word_errors / nullif(reference_words, 0), 6) AS wer, round(character_errors / nullif(reference_characters, 0), 6) AS cer, reference_words, reference_characters FROM p")
def x06(spark, folder):
    m = align.metric(F.col("counts"))
    return report.scored(dealt(spark, folder, "experiment_results", "result_id", "stage", "reference", "hypothesis")).select("result_id", m.alias("m")).select("result_id", F.round("m.wer", 6).alias("wer"), F.round("m.cer", 6).alias("cer"), "m.reference_words", "m.reference_characters")


@query("x07_devanagari", f"SELECT result_id, regexp_replace({sql_norm('hypothesis')}, '[^\\x{{0900}}-\\x{{097f}}]', '', 'g') AS chars FROM experiment_results WHERE hypothesis IS NOT NULL")
def x07(spark, folder):
    return table(spark, folder, "experiment_results").filter("hypothesis is not null").select("result_id", tx.devanagari(tx.normalize(F.col("hypothesis"))).alias("chars"))


LATIN = "'[A-Za-z]+(?:[''-][A-Za-z]+)*'"


@query("x08_latin_words", f"SELECT result_id, coalesce(array_to_string(regexp_extract_all({sql_norm('hypothesis')}, {LATIN}), ' '), '') AS latin FROM experiment_results WHERE hypothesis IS NOT NULL")
def x08(spark, folder):
    return table(spark, folder, "experiment_results").filter("hypothesis is not null").select("result_id", F.array_join(tx.latin_words(tx.normalize(F.col("hypothesis"))), " ").alias("latin"))


SCRIPT = (
    "WITH n AS (SELECT result_id, " + sql_norm("reference") + " AS r, " + sql_norm("coalesce(hypothesis, '')") + " AS h FROM experiment_results WHERE reference IS NOT NULL), "
    f"s AS (SELECT *, regexp_extract_all(r, {LATIN}) AS rl, regexp_extract_all(h, {LATIN}) AS hl, list_filter(string_split(regexp_replace(r, '[^\\x{{0900}}-\\x{{097f}}]', '', 'g'), ''), lambda c: c <> '') AS rd, list_filter(string_split(regexp_replace(h, '[^\\x{{0900}}-\\x{{097f}}]', '', 'g'), ''), lambda c: c <> '') AS hd FROM n) "
)


def _distance(a: str, b: str) -> str:
    from phonolake.plans.register import sql_distance

    return sql_distance(a, b)


@query("x09_script_rates", SCRIPT + f"SELECT result_id, round({_distance('rd', 'hd')} / nullif(len(rd), 0), 6) AS devanagari_cer, round({_distance('rl', 'hl')} / nullif(len(rl), 0), 6) AS latin_word_wer FROM s")
def x09(spark, folder):
    m = align.script_metrics(F.col("r"), F.col("h"))
    return pairs(spark, folder).select("result_id", m.alias("m")).select("result_id", F.round("m.devanagari_cer", 6).alias("devanagari_cer"), F.round("m.latin_word_wer", 6).alias("latin_word_wer"))


@query("x10_english_accuracy", SCRIPT + "SELECT result_id, round(len(list_intersect(list_distinct(rl), list_distinct(hl))) / nullif(len(list_distinct(rl)), 0), 6) AS accuracy FROM s")
def x10(spark, folder):
    a, b = tx.latin_words(F.col("r")), tx.latin_words(F.col("h"))
    return pairs(spark, folder).select("result_id", F.round(align.rate(F.size(F.array_intersect(a, b)), F.size(F.array_distinct(a))), 6).alias("accuracy"))


@query("x11_wrong_script", SCRIPT + "SELECT result_id, CASE WHEN length(r) > 0 THEN 0.0::DOUBLE END AS wrong_script_rate FROM s")
def x11(spark, folder):
    return pairs(spark, folder).select("result_id", F.when(F.size(tx.split_words(F.col("r"))) > 0, F.lit(0.0)).alias("wrong_script_rate"))


@query("x12_code_mixed", f"SELECT doc_id, regexp_matches({sql_norm('text')}, '[\\x{{0900}}-\\x{{097f}}]') AND regexp_matches({sql_norm('text')}, '[A-Za-z]') AS mixed FROM documents")
def x12(spark, folder):
    return table(spark, folder, "documents").select("doc_id", tx.is_code_mixed(tx.normalize(F.col("text"))).alias("mixed"))


NUKTA_SQL = "x.text"
for _base in tx.NUKTA_BASES:
    NUKTA_SQL = f"replace({NUKTA_SQL}, '{_base}{tx.NUKTA}', '{_base}')"


@query("x13_nukta", f"SELECT doc_id, md5({NUKTA_SQL}) AS digest, (length(text) - length({NUKTA_SQL}))::INT AS dropped FROM documents AS x")
def x13(spark, folder):
    f = tx.fold_nukta(F.col("text"))
    return table(spark, folder, "documents").select("doc_id", F.md5(f).alias("digest"), (F.length("text") - F.length(f)).alias("dropped"))


HINGLISH_SQL = f"trim(regexp_replace({NUKTA_SQL}, '[\\s\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}\\x0b]+', ' ', 'g'))"


@query("x14_hinglish", f"SELECT doc_id, md5({HINGLISH_SQL}) AS digest FROM documents AS x")
def x14(spark, folder):
    return table(spark, folder, "documents").select("doc_id", F.md5(tx.hinglish(F.col("text"))).alias("digest"))


RAW_SPACE = "[\\s\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x0b]+"
RAW = f"WITH t AS (SELECT result_id, list_filter(regexp_split_to_array(trim(reference), '{RAW_SPACE}'), lambda w: w <> '') AS rw, list_filter(regexp_split_to_array(trim(coalesce(hypothesis, '')), '{RAW_SPACE}'), lambda w: w <> '') AS hw, list_filter(string_split(trim(reference), ''), lambda c: c <> '') AS rc, list_filter(string_split(trim(coalesce(hypothesis, '')), ''), lambda c: c <> '') AS hc FROM experiment_results WHERE reference IS NOT NULL) "


@query("x15_raw_metric", RAW + f"SELECT result_id, round({_distance('rw', 'hw')} / nullif(len(rw), 0), 6) AS wer FROM t")
def x15(spark, folder):
    return pairs(spark, folder).select("result_id", F.round(align.raw_metric(F.col("reference"), F.col("hypothesis"))["wer"], 6).alias("wer"))


def training(column: str) -> str:
    out = column
    for base in tx.NUKTA_BASES:
        out = f"replace({out}, '{base}{tx.NUKTA}', '{base}')"
    return f"list_filter(regexp_split_to_array({out}, '{RAW_SPACE}'), lambda w: w <> '')"


@query("x16_training_wer", f"WITH t AS (SELECT stage, {training('reference')} AS rw, {training('coalesce(hypothesis, chr(32))')} AS hw FROM experiment_results WHERE reference IS NOT NULL) SELECT stage, round(100 * sum({_distance('rw', 'hw')}) / nullif(sum(len(rw)), 0), 6) AS wer FROM t GROUP BY stage")
def x16(spark, folder):
    rows = dealt(spark, folder, "experiment_results", "stage", "reference", "hypothesis").filter("reference is not null")
    ref, hyp = (tx.split_words(tx.hinglish(F.coalesce(c, F.lit("")))) for c in ("reference", "hypothesis"))
    return rows.groupBy("stage").agg(F.round(100 * F.sum(align.token_distance(ref, hyp)).cast("double") / F.nullif(F.sum(F.size(ref)), F.lit(0)), 6).alias("wer"))


@query("x17_keyword_hits", f"SELECT result_id, coalesce(array_to_string(list_filter({KEYWORD_LIST}, lambda k: contains(lower(coalesce(hypothesis, '')), lower(k))), '|'), '') AS hits FROM experiment_results")
def x17(spark, folder):
    return table(spark, folder, "experiment_results").select("result_id", F.array_join(tx.keyword_hits(F.col("hypothesis"), KEYWORDS), "|").alias("hits"))


@query("x18_hotwords", f"SELECT stage, array_to_string({KEYWORD_LIST}, ' ') AS hotwords, 'The following Hinglish conversation mentions terms such as: ' || array_to_string({KEYWORD_LIST}, ', ') || '.' AS prompt FROM stage_config")
def x18(spark, folder):
    k = F.array(*[F.lit(x) for x in KEYWORDS])
    return table(spark, folder, "stage_config").select("stage", tx.hotwords(k).alias("hotwords"), tx.keyword_prompt(k).alias("prompt"))


@query("x19_prompts", "SELECT result_id, 'Question: What is your query? Answer as heard: ' || coalesce(Transcription, '') || ' Correct it.' AS prompt FROM transcription_results")
def x19(spark, folder):
    return table(spark, folder, "transcription_results").select("result_id", tx.prompt("Question: %s Answer as heard: %s Correct it.", F.lit("What is your query?"), F.col("Transcription")).alias("prompt"))


STRIPPED = RAW_SPACE.replace("\\s", "\\s\\x{1c}-\\x{1f}")


@query("x20_hypothesis_text", f"SELECT result_id, regexp_replace(coalesce(hypothesis, ''), '^{STRIPPED}|{STRIPPED}$', '', 'g') AS text FROM experiment_results")
def x20(spark, folder):
    """Texts as models give them, through the adapter, in Arrow batches."""
    from phonolake.functions.signal import for_each_batch

    def run(batch):
        batch["text"] = [models.hypothesis_text([t, None]) for t in batch["hypothesis"]]
        return batch[["result_id", "text"]]

    return for_each_batch(table(spark, folder, "experiment_results").select("result_id", "hypothesis"), run, "result_id bigint, text string")


@query("x21_ids", "SELECT example_id, string_split(audio, '/')[-1] AS name, regexp_replace(string_split(audio, '/')[-1], '\\.[^.]*$', '') AS stem, string_split(audio, '/')[-2] AS parent, rtrim(regexp_extract(reference, '^" + RAW_SPACE[:-1] + "*([^" + RAW_SPACE[1:-2] + "]+)', 1), ':') AS first_id FROM examples WHERE audio IS NOT NULL")
def x21(spark, folder):
    a = F.col("audio")
    return table(spark, folder, "examples").filter("audio is not null").select("example_id", tx.base_name(a).alias("name"), tx.stem(a).alias("stem"), tx.parent(a).alias("parent"), tx.line_id(F.col("reference")).alias("first_id"))


@query("x22_spoken_numbers")
def x22(spark, folder):
    """Spoken numbers of the hypotheses as digits; the table-driven rules have no SQL."""
    return table(spark, folder, "experiment_results").select("result_id", models.inverse_normalized(F.col("hypothesis"), F.lit("en")).alias("text"))


@query("x22b_spelt_numbers")
def x22b(spark, folder):
    """Numbers of the hypotheses as words; the tests compare them."""
    return table(spark, folder, "experiment_results").select("result_id", models.text_normalized(F.col("hypothesis")).alias("text"))
