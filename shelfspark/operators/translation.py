"""Translation work: checks of translated segments, costs, batches, stages, glossaries and budgets of jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.operators.markup import MARKER
from shelfspark.operators.usage import pack_batches, spend

#: Passes over a text by profile; the last one makes the draft the translation.
PASSES = {"schnell": 1, "buch": 2, "literarisch": 3}
MAX_CHARS = 12_000


def markers(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(MARKER), F.lit(0))


def validate_translations(segments: DataFrame, translations: DataFrame, key: str = "id") -> DataFrame:
    """(id, error) of translations (id, text) of segments (id, kind, text), and of segments without one: unknown, repeated, blank, markers, missing; null if sound.

    content must have the markers of its source in the same order, other kinds none.
    """
    counts = translations.groupBy(key).agg(F.count("*").alias("n"), F.first("text").alias("t"))
    source = segments.select(key, "kind", F.col("text").alias("s"))
    both = counts.join(source, key, "full_outer")
    same = F.when(F.col("kind") == "content", markers(F.col("t")) == markers(F.col("s"))).otherwise(F.size(markers(F.col("t"))) == 0)
    error = F.when(F.col("kind").isNull(), "unknown").when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "repeated").when(F.trim(F.coalesce("t", F.lit(""))) == "", "blank").when(~same, "markers")
    return both.select(key, error.alias("error"))


def estimate_cost(segments: DataFrame, jobs: DataFrame) -> DataFrame:
    """(job, segments, chars, tokens, cost, error) of segments (job, text) for jobs (job, profile, rate_in, rate_out).

    Tokens are characters / 3.5; each pass of the profile reads and writes twice as many. cost: null
    unless both rates are above 0; error: long for a job with a segment above MAX_CHARS.
    """
    sums = segments.groupBy("job").agg(F.count("*").alias("segments"), F.sum(F.length("text")).alias("chars"), F.max(F.length("text")).alias("__m"))
    made = sums.join(jobs, "job").withColumn("tokens", F.expr("chars * 2 div 7"))
    passes = F.try_element_at(F.create_map(*[F.lit(x) for kv in PASSES.items() for x in kv]), F.col("profile"))
    one = (2 * F.col("tokens") * F.col("rate_in") + 2 * F.col("tokens") * F.col("rate_out")) / 1e6
    cost = F.when((F.col("rate_in") > 0) & (F.col("rate_out") > 0), F.bround(passes * one, 4))
    return made.select("job", "segments", "chars", "tokens", cost.alias("cost"), F.when(F.col("__m") > MAX_CHARS, "long").alias("error"))


def next_batches(segments: DataFrame, most_items: int = 8, most_chars: int = MAX_CHARS) -> DataFrame:
    """(job, place, stage, batch, now) of the segments (job, place, text, stage, translated) that remain: packed in order, and of each batch those of its lowest stage are to be worked on now."""
    left = segments.where(~F.coalesce(F.col("translated"), F.lit(False))).select("job", "place", F.coalesce("stage", F.lit(0)).alias("stage"), F.coalesce(F.length("text"), F.lit(0)).cast("double").alias("size"))
    packed = pack_batches(left, "job", ["place"], "size", most_items, most_chars, keep=["stage"])
    low = packed.groupBy("job", "batch").agg(F.min("stage").alias("low"))
    return packed.join(low, ["job", "batch"]).select("job", "place", "stage", "batch", (F.col("stage") == F.col("low")).alias("now"))


def advance_stage(state: DataFrame, results: DataFrame, final: Column) -> DataFrame:
    """state (job, place, stage, draft, translation, revisions) after results (job, place, text): the revision is appended, the stage rises, and the final stage's draft is the translation."""
    both = state.join(results.select("job", "place", F.col("text").alias("__t")), ["job", "place"], "left")
    done = F.col("__t").isNotNull()
    stage = F.when(done, F.col("stage") + 1).otherwise(F.col("stage"))
    made = both.withColumns({"stage": stage, "draft": F.coalesce("__t", "draft"), "revisions": F.when(done, F.array_append("revisions", F.col("__t"))).otherwise(F.col("revisions"))})
    return made.withColumn("translation", F.when(done & (F.col("stage") >= final), F.col("draft")).otherwise(F.col("translation"))).drop("__t")


def final_stage(profile: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in PASSES.items() for x in kv]), profile)


def context_window(segments: DataFrame, n: int = 3, most: int = 1200) -> DataFrame:
    """(job, place, context): for each segment (job, place, text, translation) the last n translated ones before it, both sides cut to `most` characters."""
    done = segments.withColumn("__d", F.col("translation").isNotNull())
    w = Window.partitionBy("job").orderBy("place")
    pair = F.when(F.col("__d"), F.struct(F.substring("text", 1, most).alias("source"), F.substring("translation", 1, most).alias("target")))
    # of each place the number of translated ones before it; the n last of them by a join on numbers, so that a job is no array
    placed = done.withColumns({"k": F.count_if("__d").over(w.rowsBetween(Window.unboundedPreceding, -1)), "pair": pair})
    given = placed.where("__d").select("job", (F.col("k") + 1).alias("no"), "pair")
    asked = placed.select("job", "place", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("back"), "k").withColumn("no", F.col("k") - F.col("back"))
    near = asked.join(given, ["job", "no"]).groupBy("job", "place").agg(F.array_sort(F.collect_list(F.struct("no", "pair"))).alias("c"))
    none = F.array().cast("array<struct<source:string,target:string>>")
    return segments.select("job", "place").join(near, ["job", "place"], "left").select("job", "place", F.coalesce(F.transform("c", lambda x: x["pair"]), none).alias("context"))


def translation_progress(segments: DataFrame, usage: DataFrame) -> DataFrame:
    """(job, total, completed, files, tokens, cost) of segments (job, file, translation) and usage (job, tokens, cost)."""
    per = segments.groupBy("job").agg(F.count("*").alias("total"), F.count("translation").alias("completed"), F.count_distinct("file").alias("files"))
    spent = usage.groupBy("job").agg(F.sum("tokens").alias("tokens"), F.sum("cost").alias("cost"))
    return per.join(spent, "job", "left").select("job", "total", "completed", "files", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.round(F.coalesce("cost", F.lit(0.0)), 6).alias("cost"))


def translation_report(segments: DataFrame, usage: DataFrame, jobs: DataFrame, most: int = 50) -> DataFrame:
    """translation_progress with the jobs' estimate and error (see estimate_cost) and preview: the first `most` translated segments (source, translated)
    of the job's first file, in order. segments: (job, file, place, text, translation), place in the order of files; jobs: (job, profile, rate_in, rate_out).
    """
    first = segments.groupBy("job").agg(F.min_by("file", "place").alias("file"))
    shown = segments.join(first, ["job", "file"], "left_semi").where("translation is not null")
    n = F.row_number().over(Window.partitionBy("job").orderBy("place"))
    top = shown.withColumn("n", n).where(F.col("n") <= most).groupBy("job").agg(F.array_sort(F.collect_list(F.struct("n", F.col("text").alias("source"), F.col("translation").alias("translated")))).alias("p"))
    preview = F.transform("p", lambda x: F.struct(x["source"].alias("source"), x["translated"].alias("translated")))
    none = F.array().cast("array<struct<source:string,translated:string>>")
    cost = estimate_cost(segments.select("job", "text"), jobs).select("job", F.col("cost").alias("estimate"), "error")
    made = translation_progress(segments, usage).join(cost, "job", "left").join(top.select("job", preview.alias("preview")), "job", "left")
    return made.withColumn("preview", F.coalesce("preview", none))


def validate_glossary(rows: DataFrame, most: int = 200) -> DataFrame:
    """(glossary, error, version) of glossaries' rows (glossary, source, target, version): many, source or target; a sound one's version rises by one."""
    bad_source = (F.trim(F.coalesce("source", F.lit(""))) == "") | (F.length("source") > 150)
    bad_target = F.length(F.coalesce("target", F.lit(""))) > 200
    per = rows.groupBy("glossary").agg(F.count("*").alias("n"), F.count_if(bad_source).alias("s"), F.count_if(bad_target).alias("t"), F.max("version").alias("v"))
    error = F.when(F.col("n") > most, "many").when(F.col("s") > 0, "source").when(F.col("t") > 0, "target")
    return per.select("glossary", error.alias("error"), (F.coalesce("v", F.lit(0)) + error.isNull().cast("int")).alias("version"))


def glossary_for(jobs: DataFrame, glossaries: DataFrame) -> DataFrame:
    """jobs (job, source_lang, target_lang) with the latest version of the glossary (source_lang, target_lang, version, glossary) of their languages."""
    last = glossaries.groupBy("source_lang", "target_lang").agg(F.max_by("glossary", "version").alias("glossary"), F.max("version").alias("version"))
    return jobs.join(last, ["source_lang", "target_lang"], "left")


def project_budget(calls: DataFrame, budgets: DataFrame) -> DataFrame:
    """(job, place, admitted) of calls (job, place, estimate) in order under budgets (job, budget): a job that cannot pay its next call is paused, no later call is admitted."""
    rows = calls.join(budgets, "job")
    return spend(rows, "job", ["place"], "estimate", "budget", stop=True)
