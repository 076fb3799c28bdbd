"""Named queries of sources, projections, joins, aggregations, ranks and sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from phonolake.functions import align
from phonolake.functions import structured as st
from phonolake.functions import text as tx
from phonolake.operators import manifest, ranks, report, segments
from phonolake.plans.register import PAIRS, dealt, q, query, sql_norm, table
from phonolake.plans.text_queries import KEYWORD_LIST, KEYWORDS
from phonolake.sources import audio, sinks, texts

# ---- sources -------------------------------------------------------------------------------

SUFFIX_LIST = "(" + ", ".join(q(s) for s in audio.SUFFIXES) + ")"


@query("s01_find_audio", f"SELECT audio, row_number() OVER (ORDER BY audio) - 1 AS idx FROM (SELECT DISTINCT audio FROM examples WHERE lower(regexp_extract(audio, '(\\.[^./]*)$', 1)) IN {SUFFIX_LIST})")
def s01(spark, folder):
    found = table(spark, folder, "examples").filter(tx.suffix(F.col("audio")).isin(audio.SUFFIXES)).select("audio").distinct()
    return report.with_index(found, "audio")


@query("s02_top_level", f"SELECT DISTINCT audio FROM examples WHERE audio LIKE 'shared/%' AND length(audio) - length(replace(audio, '/', '')) = 1 AND lower(regexp_extract(audio, '(\\.[^./]*)$', 1)) IN {SUFFIX_LIST}")
def s02(spark, folder):
    found = table(spark, folder, "examples").filter(tx.suffix(F.col("audio")).isin(audio.SUFFIXES))
    return found.filter(F.col("audio").startswith("shared/") & (F.size(F.split("audio", "/")) == 2)).select("audio").distinct()


@query("s05_ground_truth", "SELECT doc_id, line_no, length(v)::INT AS n, md5(v) AS digest FROM (SELECT doc_id, unnest(range(len(l))) AS line_no, regexp_replace(unnest(l), '^[\\s\\x0b]+|[\\s\\x0b]+$', '', 'g') AS v FROM (SELECT doc_id, string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) AS l FROM documents WHERE text IS NOT NULL)) WHERE length(v) > 0")
def s05(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", F.posexplode(F.split("text", "\r\n|\r|\n")).alias("line_no", "value"))
    rows = docs.select("doc_id", F.col("line_no").cast("bigint"), F.regexp_replace("value", r"^[\s\x0b]+|[\s\x0b]+$", "").alias("v"))
    return rows.filter(F.length("v") > 0).select("doc_id", "line_no", F.length("v").alias("n"), F.md5("v").alias("digest"))


def mapping_lines(spark, folder):
    """Lines of a mapping file made of the examples: comments, blank ones, and paths that come again."""
    e = table(spark, folder, "examples").filter("audio is not null")
    value = F.when(F.col("example_id") % 7 == 0, F.concat(F.lit("# "), "audio")).when(F.col("example_id") % 11 == 0, F.lit("  ")).otherwise(F.concat(F.col("audio"), F.lit("\tid_"), F.col("example_id").cast("string"), F.lit(" ")))
    return e.select(F.col("example_id").alias("line_no"), value.alias("value"))


@query("s06_audio_mappings", "SELECT audio AS audio_path, 'id_' || max(example_id) AS identifier FROM examples WHERE audio IS NOT NULL AND example_id % 7 <> 0 AND example_id % 11 <> 0 GROUP BY audio")
def s06(spark, folder):
    return manifest.mappings(mapping_lines(spark, folder))


@query("s07_manifest", "SELECT audio, reference FROM examples WHERE reference IS NOT NULL")
def s07(spark, folder):
    """Manifest entries as JSON and back."""
    entry = F.to_json(F.struct("audio", F.col("reference").alias("text")))
    rows = table(spark, folder, "examples").filter("reference is not null").select(F.from_json(entry, "audio string, text string").alias("e"))
    return rows.select("e.audio", F.col("e.text").alias("reference"))


@query("s08_transcripts", "SELECT regexp_replace(string_split(audio, '/')[-1], '\\.txt|\\.wav', '', 'g') AS base_id, arg_max(md5(t), example_id) AS digest FROM (SELECT *, regexp_replace(regexp_replace(reference, '^[\\s\\x0b]+|[\\s\\x0b]+$', '', 'g'), '^[\\x{a0}\\x{2007}\\x{202f}]+', '') AS t FROM examples) WHERE length(t) > 0 GROUP BY 1")
def s08(spark, folder):
    e = table(spark, folder, "examples")
    lines = e.select(F.col("example_id").alias("line_no"), F.concat(tx.base_name(F.col("audio")), F.lit(" "), F.col("reference")).alias("value"))
    return manifest.transcripts(lines).select("base_id", F.md5("transcript").alias("digest"))


@query("s09_cases", "SELECT 'case_' || example_id AS sample_id, reference AS script_reference, 2 AS n_keywords, NULL::VARCHAR AS tags FROM examples WHERE reference IS NOT NULL")
def s09(spark, folder):
    """Scripted cases as a JSON document for each row; a key that is missing is null."""
    case = F.struct(F.concat(F.lit("case_"), F.col("example_id").cast("string")).alias("sample_id"), F.col("reference").alias("script_reference"), F.array(F.lit("refund"), F.lit("order")).alias("boost_keywords"))
    doc = F.to_json(F.struct(F.array(case).alias("test_cases")))
    rows = table(spark, folder, "examples").filter("reference is not null").select(F.explode(F.from_json(doc, texts.CASES)["test_cases"]).alias("c"))
    return rows.select("c.sample_id", "c.script_reference", F.size("c.boost_keywords").alias("n_keywords"), F.array_join("c.paralinguistic_tags", ",").alias("tags"))


@query("s10_class_map", "SELECT n_nationkey::INT AS class_idx, n_name || ', loud' AS class, n_name AS naive FROM nation")
def s10(spark, folder):
    line = F.concat(F.col("n_nationkey").cast("string"), F.lit(",/m/"), F.col("n_name"), F.lit(',"'), F.col("n_name"), F.lit(', loud"'))
    lines = table(spark, folder, "nation").select((F.col("n_nationkey") + 1).cast("bigint").alias("line_no"), line.alias("value"))
    good, naive = texts.class_map(lines), texts.class_map(lines, naive=True).withColumnRenamed("class", "naive")
    return good.join(naive, "class_idx")


@query("s11_parameters", "SELECT stage, 480000 AS chunk_samples, 80000 AS overlap_samples FROM stage_config")
def s11(spark, folder):
    from phonolake.sources.parameters import parse

    run = parse(["--chunk-seconds", "30", "--overlap-seconds", "5", "--evaluate"])
    return table(spark, folder, "stage_config").select("stage", F.lit(run.chunk_samples).alias("chunk_samples"), F.lit(run.overlap_samples).alias("overlap_samples"))


@query("k01_json_lines", "SELECT result_id, File AS file, Transcription AS text FROM transcription_results")
def k01(spark, folder):
    """Rows of the JSON-lines sink, read again."""
    t = table(spark, folder, "transcription_results").select("result_id", F.to_json(F.struct(F.col("File").alias("file"), F.col("Transcription").alias("text")), {"ignoreNullFields": "false"}).alias("value"))
    return t.select("result_id", F.from_json("value", "file string, text string").alias("j")).select("result_id", "j.file", "j.text")


@query("k02_timed_lines", "SELECT result_id, File AS file, round(\"Inference Time (s)\", 6) AS seconds, round(RTF, 6) AS rtf FROM transcription_results")
def k02(spark, folder):
    t = table(spark, folder, "transcription_results").select("result_id", F.to_json(F.struct(F.col("File").alias("file"), F.col("Inference Time (s)").alias("seconds"), F.col("RTF").alias("rtf"))).alias("value"))
    return t.select("result_id", F.from_json("value", "file string, seconds double, rtf double").alias("j")).select("result_id", "j.file", F.round("j.seconds", 6).alias("seconds"), F.round("j.rtf", 6).alias("rtf"))


@query("k03_evaluation")
def k03(spark, folder):
    """The nested evaluation document by channel, of aggregates; one value, as its format wants."""
    rows = stage_rows(spark, folder).withColumnRenamed("channel", "slice")
    rates = report.corpus_rates(report.scored(rows), "slice", rtf="rtf_total", memory="gpu_memory_mb")
    return sinks.evaluation(table(spark, folder, "stage_config").select(F.col("channel").alias("slice"), "stage", "vad"), rates, {"model": "stub", "device": "cpu"})


RESULTS = """
SELECT '{"results":[' || string_agg('{"stage":' || coalesce('"' || stage || '"', 'null') || ',"n":' || n || ',"wer":' || coalesce(wer::VARCHAR, 'null') || '}', ',' ORDER BY stage NULLS FIRST) || ']}' AS value
FROM (SELECT stage, count(*) AS n, round(sum(word_errors) / nullif(sum(reference_words), 0), 6) AS wer FROM p GROUP BY stage)
"""


@query("k04_results_document", PAIRS + RESULTS)
def k04(spark, folder):
    """``results`` of the stages, one value."""
    rates = report.corpus_rates(report.scored(dealt(spark, folder, "experiment_results", "result_id", "stage", "file", "original_duration_seconds", "rtf_total", "reference", "hypothesis")), "stage")
    return sinks.results_document(rates.select("stage", "n", F.round("wer", 6).alias("wer")), "stage")


@query("k05_csv_cells", "SELECT result_id, Transcription AS cell FROM transcription_results WHERE Transcription IS NOT NULL AND length(Transcription) > 0")
def k05(spark, folder):
    """Cells with line breaks and quotes through the CSV form and back."""
    t = table(spark, folder, "transcription_results").filter(F.length("Transcription") > 0)
    row = t.select("result_id", F.to_csv(F.struct("Transcription"), {"escape": '"', "quoteAll": "true", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}).alias("value"))
    return row.select("result_id", F.from_csv("value", F.lit("cell string"), {"escape": '"', "multiLine": "true", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"})["cell"].alias("cell"))


CELL = "lpad(coalesce(CASE WHEN isnan({c}) THEN 'nan' ELSE printf('%.4f', floor({c} * 10000 + 0.5) / 10000) END, 'N/A'), 10, ' ')"


@query("k08_console", f"SELECT result_id, rpad(coalesce(stage, ''), 35, ' ') || ' ' || {CELL.format(c='wer')} || ' ' || {CELL.format(c='cer')} || ' ' || {CELL.format(c='rtf_total')} AS row FROM experiment_results")
def k08(spark, folder):
    """Every row: a missing stage is a blank cell, a metric that isn't a number is nan, as the console has it."""
    cells = [F.rpad(F.coalesce("stage", F.lit("")), 35, " "), *[F.lpad(report.shown(F.col(c)), 10, " ") for c in ("wer", "cer", "rtf_total")]]
    return table(spark, folder, "experiment_results").select("result_id", F.concat_ws(" ", *cells).alias("row"))


# ---- projections ---------------------------------------------------------------------------


def stage_rows(spark, folder):
    return dealt(spark, folder, "experiment_results").join(table(spark, folder, "stage_config"), "stage")


@query("proj01_code_mixed", f"SELECT example_id FROM examples WHERE regexp_matches({sql_norm('reference')}, '[\\x{{0900}}-\\x{{097f}}]') AND regexp_matches({sql_norm('reference')}, '[A-Za-z]')")
def proj01(spark, folder):
    return table(spark, folder, "examples").filter(tx.is_code_mixed(tx.normalize(F.col("reference")))).select("example_id")


@query("proj02_slices", f"SELECT slice, count(*) AS n, sum(CASE WHEN slice = 'telephony' THEN 1 ELSE 0 END)::BIGINT AS degraded FROM (SELECT *, {sql_norm('reference')} AS r FROM examples WHERE reference IS NOT NULL) CROSS JOIN (VALUES ('clean'), ('telephony'), ('code_mixed')) AS v(slice) WHERE slice <> 'code_mixed' OR (regexp_matches(r, '[\\x{{0900}}-\\x{{097f}}]') AND regexp_matches(r, '[A-Za-z]')) GROUP BY slice")
def proj02(spark, folder):
    e = table(spark, folder, "examples").filter("reference is not null")
    names = F.when(tx.is_code_mixed(tx.normalize(F.col("reference"))), F.array(F.lit("clean"), F.lit("telephony"), F.lit("code_mixed"))).otherwise(F.array(F.lit("clean"), F.lit("telephony")))
    rows = e.select("example_id", F.explode(names).alias("slice"))
    return rows.groupBy("slice").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("slice") == "telephony", 1).otherwise(0)).alias("degraded"))


@query("proj03_only_files", "SELECT count(*) AS n FROM examples WHERE audio IS NOT NULL")
def proj03(spark, folder):
    return table(spark, folder, "examples").filter("audio is not null").agg(F.count(F.lit(1)).alias("n"))


@query("proj04_lang_allowlist", "SELECT doc_id, CASE WHEN coalesce(lang, 'hi') IN ('hi', 'en') THEN NULL ELSE 'Language mismatch / potential hallucination' END AS reason FROM documents")
def proj04(spark, folder):
    return table(spark, folder, "documents").select("doc_id", segments.allowed_language(F.col("lang"), F.lit("hi"), ["hi", "en"]).alias("reason"))


@query("proj05_valid_sentence", "SELECT example_id FROM examples WHERE reference IS NOT NULL AND length(trim(reference)) > 0")
def proj05(spark, folder):
    return table(spark, folder, "examples").filter(F.col("reference").isNotNull() & (F.length(F.trim("reference")) > 0)).select("example_id")


@query("proj06_label_length", f"SELECT doc_id FROM documents WHERE len(list_filter(string_split({sql_norm('text')}, ' '), lambda w: w <> '')) < 448")
def proj06(spark, folder):
    return table(spark, folder, "documents").filter(F.size(tx.words(F.col("text"))) < 448).filter("text is not null").select("doc_id")


@query("proj07_positive_intervals", "SELECT result_id FROM experiment_results WHERE processed_duration_seconds - original_duration_seconds > 0 OR original_duration_seconds > 1")
def proj07(spark, folder):
    e = table(spark, folder, "experiment_results").select("result_id", F.col("original_duration_seconds").alias("o"), F.col("processed_duration_seconds").alias("p"))
    return e.filter((F.col("p") > F.col("o")) | (F.col("o") > 1)).select("result_id")


@query("proj08_target_speaker", "SELECT result_id, map_extract(speaker_durations, 'SPEAKER_00')[1] AS seconds FROM experiment_results WHERE selected_speaker = 'SPEAKER_00'")
def proj08(spark, folder):
    return table(spark, folder, "experiment_results").filter(F.col("selected_speaker") == "SPEAKER_00").select("result_id", F.try_element_at("speaker_durations", F.lit("SPEAKER_00")).alias("seconds"))


@query("proj09_stage_selection", "SELECT result_id, stage LIKE '%diarization%' AS needs_speakers, stage LIKE '%vad%' AS needs_vad FROM experiment_results WHERE stage = 'vad' OR stage LIKE 'diarization%'")
def proj09(spark, folder):
    e = table(spark, folder, "experiment_results").filter((F.col("stage") == "vad") | F.col("stage").startswith("diarization"))
    return e.select("result_id", F.contains("stage", F.lit("diarization")).alias("needs_speakers"), F.contains("stage", F.lit("vad")).alias("needs_vad"))


@query("proj10_records", PAIRS + "SELECT result_id, file, original_duration_seconds AS seconds, rtf_total AS rtf, reference_words, reference_characters FROM p")
def proj10(spark, folder):
    rows = report.scored(dealt(spark, folder, "experiment_results", "result_id", "stage", "file", "original_duration_seconds", "rtf_total", "reference", "hypothesis"))
    record = rows.select("result_id", F.struct("file", F.col("original_duration_seconds").alias("seconds"), F.col("rtf_total").alias("rtf"), align.metric(F.col("counts")).alias("metrics")).alias("r"))
    return record.select("result_id", "r.file", "r.seconds", "r.rtf", "r.metrics.reference_words", "r.metrics.reference_characters")


@query("proj11_yes_no", "SELECT result_id, CASE WHEN \"Language Prob\" >= 0.8 AND NOT isnan(\"Language Prob\") THEN 'YES' ELSE 'NO' END AS sure FROM transcription_results")
def proj11(spark, folder):
    """What isn't a number isn't sure."""
    return table(spark, folder, "transcription_results").select("result_id", tx.yes_no((F.col("Language Prob") >= 0.8) & ~F.isnan("Language Prob")).alias("sure"))


@query("proj12_columns", 'SELECT File AS file, "Detected Language" AS language, Transcription AS text FROM transcription_results')
def proj12(spark, folder):
    return table(spark, folder, "transcription_results").select(F.col("File").alias("file"), F.col("Detected Language").alias("language"), F.col("Transcription").alias("text"))


@query("proj13_guards", "SELECT file_index, chunk_index, queued_at, CASE WHEN sample_rate <> 16 THEN 'rate' WHEN audio IS NULL THEN 'no audio' WHEN len(audio) = 0 THEN 'empty' END AS problem FROM chunk_jobs")
def proj13(spark, folder):
    problem = F.when(F.col("sample_rate") != 16, "rate").when(F.col("audio").isNull(), "no audio").when(F.size("audio") == 0, "empty")
    return table(spark, folder, "chunk_jobs").select("file_index", "chunk_index", "queued_at", problem.alias("problem"))


# ---- joins ---------------------------------------------------------------------------------

# every recording has lines of its own: a part, a second part, a whole with a colon, or one with a colon and no blank
LINE_PARTS = """
lines AS (
  SELECT example_id * 2 AS line_no, s || CASE WHEN example_id % 3 = 0 THEN '_p1 ' WHEN example_id % 3 = 1 THEN ': ' ELSE ':' END || t AS value FROM base
  UNION ALL SELECT example_id * 2 + 1, 'x_' || s || '_p2 ' || t FROM base WHERE example_id % 3 = 0
)"""
MATCH_SQL = f"""
WITH base AS (SELECT example_id, regexp_replace(string_split(audio, '/')[-1], '\\.[^.]*$', '') AS s, trim(regexp_replace(coalesce(reference, ''), '[\\s\\x0b\\x85\\p{{Z}}]+', ' ', 'g')) AS t FROM examples WHERE audio IS NOT NULL),
{LINE_PARTS},
a AS (SELECT DISTINCT audio, regexp_replace(string_split(audio, '/')[-1], '\\.[^.]*$', '') AS s, string_split(audio, '/')[-2] AS p FROM examples WHERE audio IS NOT NULL),
i AS (SELECT line_no, value, rtrim(regexp_extract(value, '^(\\S+)', 1), ':') AS id, regexp_extract(value, '^\\S+\\s+(.*)$', 1) AS text FROM lines),
hits AS (SELECT audio, line_no, text FROM a JOIN i ON text <> '' AND (id = s OR id = p OR (right(s, 1) = '_' AND starts_with(id, s)) OR (right(p, 1) = '_' AND starts_with(id, p)) OR starts_with(id, s || '_') OR starts_with(id, p || '_') OR contains(id, '_' || s || '_') OR contains(id, '_' || p || '_'))),
j AS (SELECT audio, string_agg(text, ' ' ORDER BY line_no) AS joined, count(*) AS n FROM hits GROUP BY audio),
f AS (SELECT audio, arg_min(trim(value), line_no) AS whole FROM a JOIN lines ON starts_with(value, s || ':') GROUP BY audio)
SELECT audio, coalesce(joined, whole) AS reference, coalesce(n, 0)::BIGINT AS n_segments FROM a LEFT JOIN j USING (audio) LEFT JOIN f USING (audio) WHERE coalesce(joined, whole) IS NOT NULL
"""


def reference_lines(spark, folder):
    """A line of every example with its reference, and a second one of every third."""
    e = table(spark, folder, "examples").filter("audio is not null")
    e = e.select("example_id", tx.stem(F.col("audio")).alias("s"), F.trim(F.regexp_replace(F.coalesce("reference", F.lit("")), r"(?U)\s+", " ")).alias("t"))
    mark = F.when(F.col("example_id") % 3 == 0, "_p1 ").when(F.col("example_id") % 3 == 1, ": ").otherwise(":")
    first = e.select((F.col("example_id") * 2).alias("line_no"), F.concat("s", mark, "t").alias("value"))
    second = e.filter("example_id % 3 = 0").select((F.col("example_id") * 2 + 1).alias("line_no"), F.concat(F.lit("x_"), "s", F.lit("_p2 "), "t").alias("value"))
    return first.unionByName(second)


@query("j01_manifest_match", MATCH_SQL)
def j01(spark, folder):
    """Every recording against the lines of all examples with their references."""
    recordings = table(spark, folder, "examples").filter("audio is not null").select("audio")
    none = spark.createDataFrame([], "audio_path string, identifier string")
    return manifest.match(recordings, reference_lines(spark, folder), none)


@query("j02_manifest_fallback", f"SELECT audio, reference FROM ({MATCH_SQL}) WHERE n_segments = 0")
def j02(spark, folder):
    return j01(spark, folder).filter("n_segments = 0").select("audio", "reference")


@query("j03_stem_join", "WITH t AS (SELECT regexp_replace(string_split(audio, '/')[-1], '\\.[^.]*$', '') AS base_id, arg_max(md5(reference), example_id) AS digest FROM examples WHERE length(trim(reference)) > 0 AND length(reference) > 1 GROUP BY 1) SELECT DISTINCT e.audio, t.base_id, t.digest FROM examples e JOIN t ON regexp_replace(string_split(e.audio, '/')[-1], '\\.[^.]*$', '') = t.base_id WHERE lower(e.audio) LIKE '%.wav'")
def j03(spark, folder):
    e = table(spark, folder, "examples").filter((F.length(F.trim("reference")) > 0) & (F.length("reference") > 1))
    known = e.groupBy(tx.stem(F.col("audio")).alias("base_id")).agg(F.max_by("reference", "example_id").alias("transcript"))
    files = table(spark, folder, "examples").select("audio").distinct()
    return manifest.by_stem(files, known).select("audio", "base_id", F.md5("transcript").alias("digest"))


@query("j04_stage_config", "SELECT result_id, channel, vad, diarization, denoise FROM experiment_results JOIN stage_config USING (stage)")
def j04(spark, folder):
    return stage_rows(spark, folder).select("result_id", "channel", "vad", "diarization", "denoise")


SCENARIOS = {"click": "Which order is it?", "purchase": "Do you want a refund?"}
SCENARIO_SQL = "CASE event_type " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in SCENARIOS.items()) + " ELSE 'How can I help you?' END"


@query("j05_scenario_default", f"SELECT event_id, {SCENARIO_SQL} AS question FROM events")
def j05(spark, folder):
    known = spark.createDataFrame(list(SCENARIOS.items()), "event_type string, question string")
    return table(spark, folder, "events").join(known, "event_type", "left").select("event_id", F.coalesce("question", F.lit("How can I help you?")).alias("question"))


@query("j06_cross_grid", "SELECT r_name, stage, count(c) AS n FROM region CROSS JOIN stage_config LEFT JOIN (SELECT stage AS s, result_id % 5 AS k, result_id AS c FROM experiment_results) ON s = stage AND k = r_regionkey GROUP BY r_name, stage")
def j06(spark, folder):
    cells = table(spark, folder, "experiment_results").groupBy("stage", (F.col("result_id") % 5).alias("r_regionkey")).agg(F.count(F.lit(1)).alias("n"))
    dims = table(spark, folder, "region").crossJoin(table(spark, folder, "stage_config").select("stage"))
    return dims.join(cells, ["stage", "r_regionkey"], "left").select("r_name", "stage", F.coalesce("n", F.lit(0)).alias("n"))


@query("j07_zipped", "SELECT vec_id, i::INT AS i, round(embedding[i + 1]::DOUBLE - embedding[64 - i]::DOUBLE, 6) AS d FROM embeddings, (SELECT unnest(range(64)) AS i)")
def j07(spark, folder):
    a = F.col("embedding").cast("array<double>")
    both = F.when(F.size(a) == F.size(F.reverse(a)), F.arrays_zip(a.alias("x"), F.reverse(a).alias("y")))
    return table(spark, folder, "embeddings").select("vec_id", F.posexplode(both).alias("i", "p")).select("vec_id", "i", F.round(F.col("p.x") - F.col("p.y"), 6).alias("d"))


@query("j08_chunk_results", "SELECT DISTINCT c.file_index, c.chunk_index, e.audio FROM chunk_jobs c JOIN examples e ON e.example_id = c.file_index")
def j08(spark, folder):
    jobs = table(spark, folder, "chunk_jobs").select("file_index", "chunk_index").distinct()
    return jobs.join(table(spark, folder, "examples").select(F.col("example_id").alias("file_index"), "audio"), "file_index")


@query("j09_normalizer_fallback", "SELECT doc_id, CASE WHEN lang = 'hi' THEN 'hindi' WHEN lang = 'en' THEN 'english' WHEN lang IS NULL THEN 'none' ELSE 'english' END AS rules FROM documents")
def j09(spark, folder):
    rules = F.create_map(F.lit("hi"), F.lit("hindi"), F.lit("en"), F.lit("english"))
    return table(spark, folder, "documents").select("doc_id", F.when(F.col("lang").isNull(), "none").otherwise(F.coalesce(F.try_element_at(rules, F.col("lang")), F.try_element_at(rules, F.lit("en")))).alias("rules"))


@query("j10_token_sets", f"SELECT result_id, len(list_intersect(list_distinct(string_split({sql_norm('reference')}, ' ')), list_distinct(string_split({sql_norm('hypothesis')}, ' '))))::INT AS shared FROM experiment_results WHERE reference IS NOT NULL AND hypothesis IS NOT NULL")
def j10(spark, folder):
    e = table(spark, folder, "experiment_results").filter("reference is not null and hypothesis is not null")
    return e.select("result_id", F.size(F.array_intersect(F.split(tx.normalize(F.col("reference")), " "), F.split(tx.normalize(F.col("hypothesis")), " "))).alias("shared"))


# ---- aggregations --------------------------------------------------------------------------

RATES = "count(*) AS n, round(sum(word_errors) / nullif(sum(reference_words), 0), 6) AS wer, round(sum(character_errors) / nullif(sum(reference_characters), 0), 6) AS cer, sum(reference_words)::BIGINT AS reference_words, sum(reference_characters)::BIGINT AS reference_characters"


def rounded(df, *columns):
    for c in columns:
        df = df.withColumn(c, F.round(c, 6))
    return df


@query("a01_corpus_rates", PAIRS + f"SELECT stage, {RATES} FROM p GROUP BY stage")
def a01(spark, folder):
    return rounded(report.corpus_rates(report.scored(dealt(spark, folder, "experiment_results", "result_id", "stage", "file", "original_duration_seconds", "rtf_total", "reference", "hypothesis")), "stage"), "wer", "cer")


@query("a02_mean_rtf", "SELECT stage, round(avg(rtf_total) FILTER (WHERE NOT isnan(rtf_total)), 6) AS mean_rtf FROM experiment_results GROUP BY stage")
def a02(spark, folder):
    """Over the rows that have a number; a stage without one has null."""
    return table(spark, folder, "experiment_results").groupBy("stage").agg(F.round(F.avg(F.nanvl("rtf_total", F.lit(None).cast("double"))), 6).alias("mean_rtf"))


@query("a03_peak_memory", "SELECT stage, max(gpu_memory_mb) FILTER (WHERE NOT isnan(gpu_memory_mb)) AS peak_mb FROM experiment_results GROUP BY stage")
def a03(spark, folder):
    return table(spark, folder, "experiment_results").groupBy("stage").agg(F.max(F.nanvl("gpu_memory_mb", F.lit(None).cast("double"))).alias("peak_mb"))


@query("a04_slice_counts", "SELECT s.stage, count(e.result_id) AS n FROM (SELECT stage FROM stage_config UNION ALL SELECT 'never run') s LEFT JOIN experiment_results e ON e.stage = s.stage GROUP BY s.stage")
def a04(spark, folder):
    stages = table(spark, folder, "stage_config").select("stage").union(spark.range(1).select(F.lit("never run")))
    counted = table(spark, folder, "experiment_results").groupBy("stage").agg(F.count(F.lit(1)).alias("n"))
    return stages.join(counted, "stage", "left").select("stage", F.coalesce("n", F.lit(0)).alias("n"))


TURNS_SQL = "SELECT result_id AS clip, unnest(map_keys(speaker_durations)) AS speaker, unnest(map_values(speaker_durations)) AS seconds FROM experiment_results WHERE speaker_durations IS NOT NULL"


def speaker_turns(spark, folder):
    """A turn for each speaker of a result, from 0 to its seconds."""
    e = table(spark, folder, "experiment_results").select(F.col("result_id").alias("clip"), F.posexplode("speaker_durations").alias("seg_idx", "speaker", "end"))
    return e.withColumn("start", F.lit(0.0))


@query("a05_speaker_totals", f"SELECT speaker, count(*) AS n, round(sum(greatest(0, seconds)), 3) AS seconds FROM ({TURNS_SQL}) GROUP BY speaker")
def a05(spark, folder):
    totals = segments.speaker_totals(speaker_turns(spark, folder))
    return totals.groupBy("speaker").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("seconds"), 3).alias("seconds"))


@query("a06_longest_speaker", "SELECT clip, round(max(seconds), 6) AS seconds, first(speaker ORDER BY seconds DESC, place) AS speaker FROM (SELECT result_id AS clip, unnest(map_keys(speaker_durations)) AS speaker, greatest(0, unnest(map_values(speaker_durations))) AS seconds, unnest(range(cardinality(speaker_durations)::BIGINT)) AS place FROM experiment_results WHERE speaker_durations IS NOT NULL) GROUP BY clip")
def a06(spark, folder):
    """Every clip; of equal speakers the first heard."""
    totals = segments.speaker_totals(speaker_turns(spark, folder))
    return segments.longest_speaker(totals).select("clip", F.round("seconds", 6).alias("seconds"), "speaker")


@query("a09_confidence", "SELECT user_id, round(avg(-value / 100), 3) AS avg_logprob, round(max(value / 1000), 3) AS no_speech_prob FROM events GROUP BY user_id")
def a09(spark, folder):
    return table(spark, folder, "events").groupBy("user_id").agg(*segments.confidence(-F.col("value") / 100, F.col("value") / 1000))


@query("a10_last_end", "SELECT user_id, arg_max(value, event_id) AS last_value FROM events GROUP BY user_id")
def a10(spark, folder):
    return table(spark, folder, "events").groupBy("user_id").agg(F.max_by("value", "event_id").alias("last_value"))


@query("a11_frame_means", "SELECT label, i::INT AS class_idx, round(avg(embedding[i + 1]::DOUBLE), 6) AS mean FROM embeddings, (SELECT unnest(range(64)) AS i) GROUP BY label, i")
def a11(spark, folder):
    rows = table(spark, folder, "embeddings").select("label", F.posexplode(F.col("embedding").cast("array<double>")).alias("class_idx", "score"))
    return rows.groupBy("label", "class_idx").agg(F.round(F.avg("score"), 6).alias("mean"))


@query("a12_ordered_concat", "SELECT doc_id, md5(string_agg(v, ' ' ORDER BY line_no)) AS digest FROM (SELECT doc_id, unnest(range(len(l))) AS line_no, regexp_replace(unnest(l), '^[\\s\\x0b]+|[\\s\\x0b]+$', '', 'g') AS v FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)) GROUP BY doc_id")
def a12(spark, folder):
    """Lines of a document as rows, put together in order. A group is one document."""
    rows = table(spark, folder, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "v"))
    parts = F.sort_array(F.collect_list(F.struct("line_no", F.regexp_replace("v", r"^[\s\x0b]+|[\s\x0b]+$", "").alias("v"))))
    return rows.groupBy("doc_id").agg(F.md5(F.array_join(F.transform(parts, lambda x: x["v"]), " ")).alias("digest"))


@query("a13_rejected_counts", "SELECT source, count(*) FILTER (WHERE coalesce(lang, 'hi') NOT IN ('hi', 'en')) AS rejected FROM documents GROUP BY source")
def a13(spark, folder):
    reason = segments.allowed_language(F.col("lang"), F.lit("hi"), ["hi", "en"])
    return table(spark, folder, "documents").groupBy("source").agg(F.count_if(reason.isNotNull()).alias("rejected"))


@query("a14_keyword_totals", f"SELECT stage, sum(len(list_filter({KEYWORD_LIST}, lambda k: contains(lower(coalesce(hypothesis, '')), lower(k)))))::BIGINT AS hits FROM experiment_results GROUP BY stage")
def a14(spark, folder):
    return table(spark, folder, "experiment_results").groupBy("stage").agg(F.sum(F.size(tx.keyword_hits(F.col("hypothesis"), KEYWORDS))).alias("hits"))


@query("a15_latin_set", f"SELECT result_id, len(list_distinct(regexp_extract_all({sql_norm('hypothesis')}, '[A-Za-z]+(?:[''-][A-Za-z]+)*')))::INT AS n FROM experiment_results WHERE hypothesis IS NOT NULL")
def a15(spark, folder):
    return table(spark, folder, "experiment_results").filter("hypothesis is not null").select("result_id", F.size(F.array_distinct(tx.latin_words(tx.normalize(F.col("hypothesis"))))).alias("n"))


@query("a17_model_average", PAIRS + "SELECT channel, round(avg(wer), 6) AS wer FROM (SELECT channel, stage, sum(word_errors) / nullif(sum(reference_words), 0) AS wer FROM p JOIN stage_config USING (stage) WHERE NOT denoise GROUP BY channel, stage) GROUP BY channel")
def a17(spark, folder):
    rates = report.corpus_rates(report.scored(stage_rows(spark, folder).filter(~F.col("denoise"))), "channel", "stage")
    return rates.groupBy("channel").agg(F.round(F.avg("wer"), 6).alias("wer"))


@query("a18_baseline_delta", PAIRS + ", r AS (SELECT stage, sum(word_errors) / nullif(sum(reference_words), 0) AS wer FROM p WHERE stage IS NOT NULL GROUP BY stage) SELECT stage, round((wer - (SELECT wer FROM r WHERE stage = 'raw')) * 100, 4) AS delta_pp FROM r")
def a18(spark, folder):
    rates = report.corpus_rates(report.scored(dealt(spark, folder, "experiment_results", "stage", "reference", "hypothesis").filter("stage is not null")), "stage")
    return report.delta(rates.select("stage", "wer"), "stage", "wer", "raw").select("stage", F.round("delta_pp", 4).alias("delta_pp"))


@query("a19_pivot", "SELECT file, min(len_h) FILTER (WHERE stage = 'raw') AS raw_n, min(hypothesis) FILTER (WHERE stage = 'raw') AS raw_text, min(len_h) FILTER (WHERE stage = 'vad') AS vad_n, min(hypothesis) FILTER (WHERE stage = 'vad') AS vad_text FROM (SELECT file, stage, hypothesis, length(hypothesis)::INT AS len_h FROM experiment_results) GROUP BY file")
def a19(spark, folder):
    e = table(spark, folder, "experiment_results").select("file", "stage", F.length("hypothesis").alias("n"), F.col("hypothesis").alias("text"))
    return report.pivot_first(e, "file", "stage", ["raw", "vad"], ["n", "text"])


@query("a20_grouping_sets", PAIRS + "SELECT channel, vad, count(*) AS n, round(sum(word_errors) / nullif(sum(reference_words), 0), 6) AS wer FROM p JOIN stage_config USING (stage) GROUP BY GROUPING SETS ((channel, vad), (channel), ())")
def a20(spark, folder):
    """The rates by channel and detection, by channel, and over all."""
    rows = report.scored(stage_rows(spark, folder)).select("channel", "vad", "counts.word_errors", "counts.reference_words")
    channel, vad = F.col("channel"), F.col("vad")
    grouped = rows.groupingSets([[channel, vad], [channel], []], channel, vad)
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("word_errors") / F.nullif(F.sum("reference_words"), F.lit(0)), 6).alias("wer"))


# ---- ranks, limits, sets -------------------------------------------------------------------


@query("l01_sorted_paths", "SELECT audio, row_number() OVER (ORDER BY audio) - 1 AS idx FROM (SELECT DISTINCT audio FROM examples)")
def l01(spark, folder):
    return report.with_index(table(spark, folder, "examples").select("audio").distinct(), "audio")


@query("l02_length_order", "SELECT file_index, chunk_index, row_number() OVER (ORDER BY n, file_index, chunk_index) - 1 AS idx FROM (SELECT file_index, chunk_index, max(coalesce(len(audio), 0)) AS n FROM chunk_jobs GROUP BY file_index, chunk_index)")
def l02(spark, folder):
    jobs = table(spark, folder, "chunk_jobs").groupBy("file_index", "chunk_index").agg(F.max(F.coalesce(F.array_size("audio"), F.lit(0))).alias("n"))
    return report.with_index(jobs, "n", "file_index", "chunk_index").select("file_index", "chunk_index", "idx")


@query("l03_chunk_order", "SELECT file_index, string_agg(chunk_index, ',' ORDER BY chunk_index) AS chunks FROM (SELECT DISTINCT file_index, chunk_index FROM chunk_jobs) GROUP BY file_index")
def l03(spark, folder):
    return table(spark, folder, "chunk_jobs").groupBy("file_index").agg(F.array_join(F.sort_array(F.collect_set("chunk_index")), ",").alias("chunks"))


@query("l04_top_classes", "SELECT label, string_agg('c' || i || ' (' || printf('%.2f', m) || ')', ', ' ORDER BY rk) AS classes FROM (SELECT label, i, m, row_number() OVER (PARTITION BY label ORDER BY m DESC, i DESC) AS rk FROM (SELECT label, i, avg(embedding[i + 1]::DOUBLE) AS m FROM embeddings, (SELECT unnest(range(64)) AS i) GROUP BY label, i)) WHERE rk <= 3 GROUP BY label")
def l04(spark, folder):
    rows = table(spark, folder, "embeddings").select("label", F.posexplode(F.col("embedding").cast("array<double>")).alias("class_idx", "score"))
    return segments.top_classes(rows.withColumn("class", F.concat(F.lit("c"), F.col("class_idx").cast("string"))), "label", 3)


@query("l05_first_match", "SELECT file, arg_min(hypothesis, result_id) AS first_text FROM experiment_results WHERE hypothesis LIKE '%order%' GROUP BY file")
def l05(spark, folder):
    return table(spark, folder, "experiment_results").filter(F.contains("hypothesis", F.lit("order"))).groupBy("file").agg(F.min_by("hypothesis", "result_id").alias("first_text"))


@query("l06_halving", "SELECT result_id, CASE WHEN result_id % 97 <> 0 THEN result_id::VARCHAR END AS text, CASE WHEN result_id % 97 = 0 THEN 'ValueError: bad item' END AS error FROM experiment_results")
def l06(spark, folder):
    """Batches with failing items: each failure comes out alone."""
    from phonolake.functions import models, signal

    def call(items):
        if any(i % 97 == 0 for i in items):
            raise ValueError("bad item")
        return [str(i) for i in items]

    def run(batch):
        done = models.halving(call, batch["result_id"].tolist())
        batch["text"], batch["error"] = [t for t, _ in done], [e for _, e in done]
        return batch

    return signal.for_each_batch(table(spark, folder, "experiment_results").select("result_id"), run, "result_id bigint, text string, error string")


@query("u01_union", "SELECT 'e' AS src, result_id FROM experiment_results UNION ALL SELECT 't', result_id FROM transcription_results")
def u01(spark, folder):
    one = lambda s, t: table(spark, folder, t).select(F.lit(s).alias("src"), "result_id")
    return one("e", "experiment_results").unionByName(one("t", "transcription_results"))


@query("u02_map_merge", "SELECT result_id, round(list_sum(map_values(speaker_durations)) - coalesce(map_extract(speaker_durations, 'SPEAKER_00')[1], 0) - 1, 6) AS total FROM experiment_results WHERE speaker_durations IS NOT NULL AND cardinality(speaker_durations) > 0")
def u02(spark, folder):
    e = table(spark, folder, "experiment_results").filter(F.size("speaker_durations") > 0)
    merged = st.last_wins(F.col("speaker_durations"), F.create_map(F.lit("SPEAKER_00"), F.lit(-1.0)))
    return e.select("result_id", F.round(F.aggregate(F.map_values(merged), F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query("u03_intersection", "SELECT file FROM experiment_results INTERSECT SELECT File FROM transcription_results")
def u03(spark, folder):
    return table(spark, folder, "experiment_results").select("file").intersect(table(spark, folder, "transcription_results").select("File"))


# ---- structured text -----------------------------------------------------------------------

@query("g01_parse_answer", "SELECT doc_id, CASE WHEN json_valid(j) THEN coalesce(json_extract_string(j, '$.extracted_intent'), 'unknown') ELSE 'unknown' END AS intent, CASE WHEN json_valid(j) THEN coalesce((json_extract_string(j, '$.confirm'))::BOOLEAN, false) ELSE false END AS confirm FROM (SELECT doc_id, coalesce(regexp_extract(text, '(\\{\"extracted_intent\".*\\})', 1), '') AS j FROM documents)")
def g01(spark, folder):
    """Answers within the texts; a text without one, or with a broken one, takes the failure branch."""
    rows = table(spark, folder, "documents").select("doc_id", F.regexp_extract("text", r'(\{"extracted_intent".*\})', 1).alias("j"))
    a = st.parse_answer(F.col("j"), F.lit(""), F.lit(False), "extracted_intent", "confirm")
    return rows.select("doc_id", a.alias("a")).select("doc_id", "a.intent", F.col("a.requires_confirmation").alias("confirm"))


@query("g02_fields", "SELECT event_id, coalesce(json_extract_string(props, '$.k'), '') AS k FROM events")
def g02(spark, folder):
    return table(spark, folder, "events").select("event_id", st.field(F.col("props"), "$.k").alias("k"))


@query("g03_entities", "SELECT result_id, '{\"stage\":' || coalesce('\"' || stage || '\"', 'null') || ',\"vad_segments\":' || coalesce(vad_segments::VARCHAR, 'null') || '}' AS entities FROM experiment_results")
def g03(spark, folder):
    return table(spark, folder, "experiment_results").select("result_id", st.render(F.struct("stage", "vad_segments")).alias("entities"))


@query("g04_row_struct", "SELECT stage, channel, vad FROM stage_config")
def g04(spark, folder):
    return table(spark, folder, "stage_config").select(F.struct("*").alias("r")).select("r.stage", "r.channel", "r.vad")


@query("g05_grouped_lists", "SELECT file_index, string_agg(n, ',' ORDER BY chunk_index, queued_at) AS sizes FROM (SELECT *, coalesce(len(audio), -1) AS n FROM chunk_jobs) GROUP BY file_index")
def g05(spark, folder):
    """Jobs by their recording, in order. A group is one recording."""
    listed = F.sort_array(F.collect_list(F.struct("chunk_index", "queued_at", F.coalesce(F.array_size("audio"), F.lit(-1)).alias("n"))))
    return table(spark, folder, "chunk_jobs").groupBy("file_index").agg(F.array_join(F.transform(listed, lambda x: x["n"].cast("string")), ",").alias("sizes"))


@query("g06_accumulate", "SELECT user_id, event_type, round(sum(value), 4) AS total FROM events GROUP BY user_id, event_type")
def g06(spark, folder):
    return table(spark, folder, "events").groupBy("user_id", "event_type").agg(F.round(F.sum("value"), 4).alias("total"))


INTENT_LIST = "(" + ", ".join(q(i) for i in st.INTENTS) + ")"


@query("g07_intents", f"SELECT intent, count(*) AS n, intent IN {INTENT_LIST} AS known FROM (SELECT regexp_extract(text, '\"extracted_intent\": \"([a-z_]*)\"', 1) AS intent FROM documents WHERE text IS NOT NULL) WHERE intent <> '' GROUP BY intent")
def g07(spark, folder):
    intent = F.regexp_extract("text", r'"extracted_intent": "([a-z_]*)"', 1).alias("intent")
    return table(spark, folder, "documents").filter("text is not null").select(intent).filter("intent <> ''").groupBy("intent").agg(F.count(F.lit(1)).alias("n")).withColumn("known", st.known_intent(F.col("intent")))


@query("f13_split", "SELECT CASE WHEN ('0x' || substr(md5(example_id::VARCHAR), 1, 7))::BIGINT % 10 < 8 THEN 'train' ELSE 'validation' END AS part, count(*) AS n FROM examples GROUP BY 1")
def f13(spark, folder):
    """Eight of ten keys by a hash of the key, so that it is the same on any cluster and no pattern of the keys shows."""
    bucket = F.conv(F.substring(F.md5(F.col("example_id").cast("string")), 1, 7), 16, 10).cast("bigint") % 10
    return table(spark, folder, "examples").groupBy(F.when(bucket < 8, "train").otherwise("validation").alias("part")).agg(F.count(F.lit(1)).alias("n"))


@query("w12_context_lag", "SELECT event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS context FROM events")
def w12(spark, folder):
    return ranks.lagged(table(spark, folder, "events").select("event_id", "user_id", "ts", "event_type"), "user_id", ["ts", "event_id"], "event_type", "context").select("event_id", "context")
