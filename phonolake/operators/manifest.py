"""Matching of recordings with ground-truth lines.

Lines are (line_no, value), recordings (audio). A line's identifier matches a candidate if it
is the same, if the candidate ends in an underscore and begins it, if it begins with the
candidate and an underscore, or if it holds the candidate between underscores.

Each of these is an equality of a part of the identifier: its whole, a prefix that an
underscore ends, or a run of its parts between two underscores. So the match is a hash join on
those parts instead of a nested loop over all pairs; a line has at most as many parts as the
square of its underscores, and hot candidates are left to the adaptive skew join.

Defined results: null, blank and one-token lines match nothing; a recording without a match
falls back to the first line that begins with its stem and a colon, whole; one without either
is dropped; a line that several candidates of a recording match counts once; extra columns are
dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phonolake.functions import text as tx


def mappings(lines: DataFrame) -> DataFrame:
    """audio_path and identifier of the mapping rows; the last row of a path stands."""
    value = F.trim(F.col("value"))
    rows = lines.filter(value.isNotNull() & (value != "") & ~value.startswith("#") & value.contains("\t"))
    parts = F.split(value, "\t", 2)
    rows = rows.select("line_no", parts[0].alias("audio_path"), F.trim(parts[1]).alias("identifier"))
    return rows.groupBy("audio_path").agg(F.max_by("identifier", "line_no").alias("identifier"))


def transcripts(lines: DataFrame) -> DataFrame:
    """Identifier (``.txt`` and ``.wav`` taken out anywhere in it) and text; lines of one token are skipped, the last of an identifier stands."""
    rest = tx.line_text(F.col("value"))
    ident = F.regexp_replace(F.regexp_extract(F.trim("value"), r"(?U)^(\S+)", 1), r"\.txt|\.wav", "")
    rows = lines.select("line_no", ident.alias("base_id"), rest.alias("transcript")).filter(F.col("transcript").isNotNull())
    return rows.groupBy("base_id").agg(F.max_by("transcript", "line_no").alias("transcript"))


def identifier_parts(identifier: Column) -> Column:
    """All candidates that an identifier would match."""
    parts = F.split(identifier, "_")
    n = F.size(parts)
    whole = F.array(identifier)
    # prefixes before an underscore, with it (for candidates that end in one) and without it
    prefix = F.flatten(F.transform(F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>")), lambda k: F.array(F.array_join(F.slice(parts, F.lit(1), k), "_"), F.concat(F.array_join(F.slice(parts, F.lit(1), k), "_"), F.lit("_")))))
    inner = F.flatten(
        F.transform(
            F.when(n > 2, F.sequence(F.lit(2), n - 1)).otherwise(F.array().cast("array<int>")),
            lambda a: F.transform(F.sequence(F.lit(1), n - a), lambda k: F.array_join(F.slice(parts, a, k), "_")),
        )
    )
    # a candidate that ends in an underscore and is the whole or more of the beginning: its own text up to any underscore is covered
    return F.array_distinct(F.concat(whole, prefix, inner))


def match(audio: DataFrame, lines: DataFrame, mapped: DataFrame) -> DataFrame:
    """audio, reference and n_segments of each recording that has a reference."""
    files = audio.select("audio").distinct()
    files = files.join(mapped.withColumnRenamed("audio_path", "audio"), "audio", "left")
    candidates = F.when(F.col("identifier").isNotNull() & (F.col("identifier") != ""), F.array("identifier")).otherwise(F.array(tx.stem(F.col("audio")), tx.parent(F.col("audio"))))
    wanted = files.select("audio", F.explode(candidates).alias("candidate")).filter(F.col("candidate") != "").distinct()
    offered = lines.select("line_no", tx.line_id(F.col("value")).alias("id"), tx.line_text(F.col("value")).alias("text")).filter(F.col("text").isNotNull())
    offered = offered.select("line_no", "text", F.explode(identifier_parts(F.col("id"))).alias("candidate"))
    hits = wanted.join(offered, "candidate").select("audio", "line_no", "text").dropDuplicates(["audio", "line_no"])
    joined = hits.groupBy("audio").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), " ").alias("joined"), F.count(F.lit(1)).alias("n_segments"))
    # the places before colons go through the join without the line's text
    told = lines.select("line_no", F.trim("value").alias("line")).filter(F.col("line").contains(":"))
    firsts = told.select("line_no", F.explode(F.array_distinct(_before_colons(F.col("line")))).alias("stem")).groupBy("stem").agg(F.min("line_no").alias("first"))
    stems = files.select(tx.stem(F.col("audio")).alias("stem")).distinct()
    firsts = stems.join(firsts, "stem").join(told.select(F.col("line_no").alias("first"), F.col("line").alias("whole")), "first").select("stem", "whole")
    out = files.withColumn("stem", tx.stem(F.col("audio"))).join(joined, "audio", "left").join(firsts, "stem", "left")
    return out.select("audio", F.coalesce("joined", "whole").alias("reference"), F.coalesce("n_segments", F.lit(0)).cast("bigint").alias("n_segments")).filter(F.col("reference").isNotNull() & (F.col("reference") != ""))


#: A stem is part of a file name, and no file system takes a longer one.
NAME = 255


def _before_colons(line: Column) -> Column:
    """What stands before each colon of a line, as far as it can be a file's name."""
    parts = F.split(F.substring(line, 1, NAME + 1), ":")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), ":"))).otherwise(F.array().cast("array<string>"))


def by_stem(audio: DataFrame, texts: DataFrame) -> DataFrame:
    """Inner join of wave files with transcripts on the stem."""
    files = audio.filter(F.lower("audio").endswith(".wav")).select("audio", tx.stem(F.col("audio")).alias("base_id"))
    return files.join(texts, "base_id").select("audio", "base_id", "transcript")
