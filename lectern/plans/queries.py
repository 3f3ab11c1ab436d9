"""The queries by name over the tables of a folder, and SQL for those that SQL can state.

The tables are no question papers: documents stand for records and files, order lines for dated records of a topic, events for answers of a quiz.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import files, questions, quiz, search, topics
from lectern.plans import papers, storage
from lectern.sources.shared import new_path, stored

QUERY = "the apache license of that trash and pathetic clown"
VOCABULARY = {
    "mathematics": {"angles": ["tan", "sin"], "logs": ["log"]},
    "physics": {"waves": ["wave", "heat"], "force": ["force", "ering"]},
    "chemistry": {"ions": ["ion", "acid"], "states": ["ung", "ment"]},
    "biology": {"cells": ["cell", "cula"], "genes": ["gene", "eau"]},
}
LABELS = {"ions": ("ion", "keit"), "ends": ("ment", "mente"), "rare": ("trash", "scum"), "license": ("license",)}
PATTERNS = ("trash", "license", "cell", "ungzu", "ion", "zzzz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark, d):
    return table(spark, d, "documents")


def _files(spark, d):
    """Documents as files: half of them loose, half in archives, with marks of copies in some names."""
    i = F.col("doc_id")
    ext = F.when(i % 4 == 0, ".doc").otherwise(".docx")
    name = F.concat(F.when(i % 5 == 0, "Copy of ").otherwise(""), F.lit("d"), i.cast("string"), F.when(i % 3 == 0, " (2)").otherwise(""), ext)
    return _docs(spark, d).select(
        F.sha2("text", 256).alias("sha256"), name.alias("filename"), ext.alias("extension"), F.col("n_chars").alias("size_bytes"), F.concat("source", F.lit("/"), name).alias("relative_path"), i.alias("ord"), (i % 2).alias("half")
    )


FILES_SQL = """
files as (
  select *, source || '/' || filename as relative_path from (
    select doc_id as ord, doc_id % 2 as half, source, n_chars as size_bytes, sha256(text) as sha256,
           case when doc_id % 4 = 0 then '.doc' else '.docx' end as extension,
           (case when doc_id % 5 = 0 then 'Copy of ' else '' end) || 'd' || doc_id || (case when doc_id % 3 = 0 then ' (2)' else '' end)
             || (case when doc_id % 4 = 0 then '.doc' else '.docx' end) as filename
    from documents)),
candidates as (
  select sha256, 'loose_file' as source_type, filename, extension, size_bytes, relative_path as source_path, ord from files where half = 0
  union all
  select sha256, 'archive_member', filename, extension, size_bytes, 'a.zip::' || relative_path, 1000000000 + ord from files where half = 1),
scored as (
  select *, (case when source_type = 'archive_member' then 10 else 0 end) + (case when extension = '.doc' then 2 else 0 end)
    + (case when contains(lower(source_path), 'copy of') then 10 else 0 end)
    + (case when contains(lower(filename), '(2)') or contains(lower(filename), '(3)') or contains(lower(filename), '(4)') then 5 else 0 end) as score
  from candidates),
scored_files as (
  select *, (case when contains(lower(relative_path), 'copy of') then 10 else 0 end)
    + (case when contains(lower(filename), '(2)') then 5 else 0 end) + (case when starts_with(lower(filename), 'copy') then 5 else 0 end)
    + (case when extension = '.doc' then 2 else 0 end) as score
  from files)
"""


def _candidates(spark, d):
    f = _files(spark, d)
    loose = files.loose_candidates(f.where("half = 0").withColumn("relative_path", F.col("relative_path")))
    loose = loose.withColumn("ord", F.regexp_extract("filename", "d(\\d+)", 1).cast("long"))
    inside = files.archive_candidates(f.where("half = 1").select(F.lit("a.zip").alias("archive"), F.col("relative_path").alias("member_path"), "extension", "size_bytes", "sha256"))
    return loose.unionByName(inside.withColumn("ord", F.regexp_extract("filename", "d(\\d+)", 1).cast("long") + 1000000000))


def _records(spark, d):
    """Documents as question records: the language is the type, the source the answer, blank for some."""
    i = F.col("doc_id")
    return _docs(spark, d).select(
        i.cast("string").alias("question_id"), F.col("lang").alias("question_type"), F.col("text").alias("question_text"),
        F.when(i % 7 == 0, F.lit(None)).when(i % 11 == 0, " ").otherwise(F.col("source")).cast("string").alias("answer"), F.when(i % 3 == 0, "s").cast("string").alias("solution"),
        F.struct((2000 + i % 3).cast("int").alias("year"), F.lit(None).cast("int").alias("contest"), F.lit(None).cast("string").alias("round"), F.col("lang").alias("subject")).alias("metadata"),
        F.struct(i.cast("string").alias("document_id"), F.lit(1).alias("start_block"), F.lit(1).alias("end_block")).alias("source"), i.alias("ord"),
    )


#: Text of the same form as normalize() gives, for text without characters that only compatibility normalisation changes.
_NORM = "trim(regexp_replace(regexp_replace(translate(lower(nfc_normalize({})), '–—−', '---'), '\\s+', ' ', 'g'), '\\s*([,.;:!?()\\[\\]{{}}=+\\-*/<>])\\s*', '\\1', 'g'))"
RECORDS_SQL = (
    "records as (select doc_id as ord, lang, text, case when doc_id % 7 = 0 then null when doc_id % 11 = 0 then ' ' else source end as answer, doc_id % 3 = 0 as solved, "
    + _NORM.format("text") + " as norm from documents), "
    "prepared as (select *, sha256(lang || chr(10) || norm) as fp, case when answer is not null then " + _NORM.format("answer") + " end as norm_answer from records)"
)


def _prepared(spark, d):
    return questions.prepared(_records(spark, d))


def _prepared_once(spark, d):
    """_prepared() for queries that read it more than once and show no normalised text: written without it."""
    return stored(_prepared(spark, d).drop("normalized_question"), "prepared")


def _dated(spark, d):
    """Order lines as records: the brand is the topic, the year that of the order."""
    orders = table(spark, d, "orders").select("o_orderkey", F.year("o_orderdate").alias("year"))
    parts = table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("topic"), "p_type")
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    x = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(parts, F.col("l_partkey") == F.col("p_partkey"))
    return x.select("topic", "year", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"))


DATED_SQL = "dated as (select p_brand as topic, year(o_orderdate) as year, l_orderkey * 10 + l_linenumber as ord from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey)"
PROFILE_SQL = DATED_SQL + """, latest as (select max(year) as y from dated), profile as (
  select topic, count(*) as frequency, list_sort(list(distinct year)) as ys, count(distinct year) as recurrence,
         count(distinct case when year >= y - 3 then year end) as recent_years, min(ord) as first,
         round(ln(1 + count(*)) + count(distinct year) + 1.5 * count(distinct case when year >= y - 3 then year end), 3) as forecast_score
  from dated, latest group by topic)"""


def _answers(spark, d, least=30):
    e = table(spark, d, "events")
    return e.select(F.col("user_id").cast("string").alias("topic"), (F.coalesce(F.col("value"), F.lit(0)) >= least).alias("correct"))


def profile_rows(p: DataFrame) -> DataFrame:
    return p.select("topic", "frequency", F.array_join(F.transform("years_seen", lambda y: y.cast("string")), ",").alias("years"), "recurrence", "recent_years", "forecast_score")


def _tokens_sql(column="text"):
    return f"regexp_extract_all(lower({column}), '[a-z0-9]+(?:[''’\\-][a-z0-9]+)*')"


BM25_SQL = f"""
with tok as (select doc_id, lang, {_tokens_sql()} as t from documents),
size_of as (select doc_id, lang, len(t) as dl from tok), stats as (select count(*) as n, avg(dl) as avgdl from size_of),
want as (select distinct unnest({_tokens_sql("'" + QUERY + "'")}) as term),
tf as (select doc_id, term, count(*) as tf from (select doc_id, unnest(t) as term from tok) join want using (term) group by all),
df as (select term, count(*) as df from tf group by term),
scored as (select doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / greatest(avgdl, 1)))) as score
           from tf join df using (term) join size_of using (doc_id), stats group by doc_id)
select doc_id, round(score, 6) as score from scored {{where}} order by round(scored.score, 9) desc, doc_id limit 20"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def found(df):
        return df.select("doc_id", F.round("score", 6).alias("score"))

    def index(s, d):
        return search.postings(_docs(s, d), "doc_id", F.col("text"))

    def keyword_path(s, d):
        return F.concat_ws(" ", "source", "text")

    def scored_topics(s, d):
        return topics.classified(_docs(s, d).select("doc_id", "text"), F.col("text"), VOCABULARY)

    def subjects(s, d):
        given = F.when(F.col("doc_id") % 9 == 0, F.upper("lang"))
        return _docs(s, d).select("doc_id", given.alias("given"), topics.lowered(F.col("text")).alias("low")).select("doc_id", topics.subject_of(F.col("given"), F.col("low"), VOCABULARY).alias("subject"))

    def from_index(s, d):
        path = new_path(s, "index")
        search.write_index(_docs(s, d), "doc_id", F.col("text"), path)
        return found(search.search_index(s, path, QUERY, 20).withColumnRenamed("key", "doc_id"))

    def retrieved(s, d):
        x = search.retrieve(_records(s, d), QUERY, VOCABULARY, 20, subject="en", kind="en", key="ord")
        return x.select("question_id", "answer", F.col("metadata.year").alias("year"), F.col("_retrieval_score").alias("retrieval_score"), F.col("_subject").alias("subject"), F.col("_topic").alias("topic"))

    def conflicts(s, d):
        x = questions.conflict_report(_prepared_once(s, d))
        answers = F.array_join(F.transform("answer_variants", lambda v: F.concat_ws("=", v["answer"], v["count"].cast("string"))), ",")
        return x.select("question_fingerprint", F.sha2("question", 256).alias("question"), answers.alias("answers"), F.array_join(F.transform("sources", lambda v: v["question_id"]), ",").alias("sources"))

    def rescued(s, d):
        """Whole texts, objects and arrays with other text around them, and texts that cannot be rescued."""
        p, m = F.col("props"), F.col("event_id") % 4
        text = F.when(m == 0, p).when(m == 1, F.concat(F.lit("```json "), p, F.lit(" ```"))).when(m == 2, F.concat(F.lit("so: ["), p, F.lit(", 2] done"))).otherwise(F.concat(F.lit("no { "), p))
        x = table(s, d, "events").select("event_id", m.alias("m"), p.isNotNull().alias("there"), T.rescue_json(text).alias("j"))
        value = F.when(F.col("m") == 2, F.coalesce(F.get_json_object("j", "$[0].k"), F.get_json_object("j", "$.k"))).otherwise(F.get_json_object("j", "$.k"))
        return x.select("event_id", F.when(F.col("m") != 3, F.col("j").isNotNull()).alias("found"), F.when(F.col("m") != 3, value).alias("k"))

    def examples(s, d):
        dated = stored(_dated(s, d), "dated")
        return topics.forecast_examples(dated, topics.pattern_profile(dated)).select("topic", "topic_rank", "example", "year", "ord")

    def united(s, d):
        """Samples for two lists of patterns over files, each content once."""
        docs = _files(s, d).join(_docs(s, d).select(F.col("doc_id").alias("i"), F.lower("text").alias("low")), F.col("ord") == F.col("i"))
        lists = [s.createDataFrame([(p, k) for k, p in enumerate(ps)], "pattern string, rank int") for ps in (PATTERNS[:3], PATTERNS[2:])]
        picked = [files.best_per_pattern(docs, F.col("low"), x, F.lit(0)).select("sha256", "pattern", "rank", "ord") for x in lists]
        return files.united_samples(*picked).select("list", "pattern", "sha256", "ord")

    def samples(s, d):
        patterns = s.createDataFrame([(p, k) for k, p in enumerate(PATTERNS)], "pattern string, rank int")
        docs = _docs(s, d).select("doc_id", "text", F.col("doc_id").alias("ord"))
        return files.best_per_pattern(docs, F.lower("text"), patterns, files.sample_score(F.concat_ws(" ", "text"), bad=("ung",), good=("ion", "eau"))).select("pattern", "rank", "doc_id")

    def grades(s, d):
        e = table(s, d, "events")
        return e.select("event_id", quiz.is_correct(F.concat(F.lit(" "), F.upper("event_type")), F.element_at(F.array(*map(F.lit, ("click", "view", "purchase"))), (F.col("event_id") % 3 + 1).cast("int"))).alias("correct"))

    return {
        "bm25_search": lambda s, d: found(search.search(_docs(s, d), "doc_id", F.col("text"), QUERY, 20)),
        "bm25_search_filtered": lambda s, d: found(search.search(_docs(s, d), "doc_id", F.col("text"), QUERY, 20, F.col("lang") == "en")),
        "bm25_from_index": from_index,
        "bm25_scores": lambda s, d: found(search.scores(_docs(s, d), "doc_id", F.col("text"), QUERY)),
        "bm25_index_scores": lambda s, d: found(search.scores_from_index(index(s, d), search.lengths(_docs(s, d), "doc_id", F.col("text")), "doc_id", QUERY)),
        "retrieve": retrieved,
        "term_freq": lambda s, d: index(s, d).groupBy("doc_id").agg(F.count(F.lit(1)).alias("terms"), F.sum("tf").alias("tokens"), F.max("tf").alias("most")),
        "doc_freq": lambda s, d: search.document_frequency(index(s, d)),
        "corpus_stats": lambda s, d: search.corpus_stats(search.lengths(_docs(s, d), "doc_id", F.col("text"))).withColumn("avgdl", F.round("avgdl", 6)),
        "tokenize": lambda s, d: _docs(s, d).select("doc_id", F.array_join(T.tokens(F.col("text")), " ").alias("tokens")),
        "clean_text": lambda s, d: _docs(s, d).select("doc_id", T.clean(F.col("text")).alias("clean")),
        "normalize_text": lambda s, d: _docs(s, d).select("doc_id", T.normalize(F.col("text")).alias("norm")),
        "fingerprint": lambda s, d: _docs(s, d).select("doc_id", T.fingerprint(F.col("lang"), F.col("text")).alias("fp")),
        "question_dedup": lambda s, d: questions.canonical_questions(_prepared_once(s, d)).select("question_fingerprint", "question_id", "duplicate_count", F.size("metadata_variants").alias("metadata_variants"), "solution_count", F.array_join(F.transform("sources", lambda x: x["question_id"]), ",").alias("sources"), F.array_join(F.transform("answer_variants", lambda x: F.concat_ws("=", x["answer"], x["count"].cast("string"))), ",").alias("answers")),
        "duplicate_report": lambda s, d: questions.duplicate_report(questions.canonical_questions(_prepared_once(s, d))).select("question_fingerprint", "count", "question_type"),
        "answer_variants": lambda s, d: questions.answer_variants(_prepared(s, d)).select("question_fingerprint", "answer", "n"),
        "answer_conflicts": lambda s, d: questions.answer_conflicts(_prepared(s, d)),
        "conflict_report": conflicts,
        "source_rows": lambda s, d: questions.source_rows(_prepared(s, d)).select("question_fingerprint", "ord", "question_id"),
        "dedup_summary": lambda s, d: questions.dedup_summary(_prepared(s, d)),
        "corpus_order": lambda s, d: questions.in_corpus_order(questions.usable(_records(s, d))).select("question_id"),
        "inventory_union": lambda s, d: _candidates(s, d).groupBy("source_type", "extension").agg(F.count(F.lit(1)).alias("n")),
        "unified_corpus": lambda s, d: files.unified_corpus(_candidates(s, d)),
        "cross_source_duplicates": lambda s, d: files.cross_source_duplicates(_candidates(s, d)),
        "duplicate_files": lambda s, d: files.duplicate_files(_files(s, d)).select("sha256", "duplicate_count", "filename", "relative_path", "canonical"),
        "duplicates_in_order": lambda s, d: files.in_group_order(files.duplicate_files(_files(s, d))).select("sha256", "duplicate_count", "relative_path"),
        "united_samples": united,
        "canonical_files": lambda s, d: files.canonical_files(_files(s, d)),
        "ext_counts": lambda s, d: files.frequency(_files(s, d), "extension").select("extension", "n"),
        "size_total": lambda s, d: files.totals(_files(s, d)),
        "largest_files": lambda s, d: files.largest(_files(s, d)).select("relative_path", "size_bytes", T.format_bytes(F.col("size_bytes") * 1000).alias("shown")),
        "hash_groups": lambda s, d: files.hash_groups(_files(s, d)),
        "largest_groups": lambda s, d: files.largest_groups(_files(s, d)).select("sha256", "n", F.array_join("paths", "|").alias("paths")),
        "year_hist": lambda s, d: files.year_histogram(table(s, d, "orders"), F.concat_ws(" ", F.col("o_orderdate").cast("string"), F.lit("nsmq2020 x_2019 1999"))),
        "keyword_label_counts": lambda s, d: files.label_counts(_docs(s, d), F.col("text"), LABELS),
        "reference_candidates": lambda s, d: files.reference_candidates(_docs(s, d), F.col("text"), ("apache", "license")).select("doc_id"),
        "competition_hints": lambda s, d: files.competition_hints(_docs(s, d), F.concat_ws(" ", "source", F.when(F.col("doc_id") % 6 == 0, "Shark finals").when(F.col("doc_id") % 4 == 0, "SMQ").when(F.col("doc_id") % 5 == 0, "sharks"), "text")),
        "file_sources": lambda s, d: files.source_rows(_candidates(s, d)),
        "sample_per_key": samples,
        "subject_of": subjects,
        "topic_scores": lambda s, d: scored_topics(s, d).select("doc_id", F.explode("scores").alias("x")).select("doc_id", "x.topic", "x.score"),
        "primary_topic": lambda s, d: scored_topics(s, d).select("doc_id", "topic"),
        "pattern_profile": lambda s, d: profile_rows(topics.top_profile(topics.pattern_profile(_dated(s, d)), 100)),
        "forecast_examples": examples,
        "quiz_score": lambda s, d: quiz.score(_answers(s, d)).withColumn("percent", F.round("percent", 6)),
        "topic_performance": lambda s, d: quiz.topic_performance(_answers(s, d)).withColumn("percent", F.round("percent", 6)),
        "weak_topics": lambda s, d: quiz.weak_topics(_answers(s, d)).select("topic", "correct", "total"),
        "grade_answers": grades,
        "quiz_progress": lambda s, d: quiz.progress(table(s, d, "events").select("event_id", "user_id"), "user_id", "event_id"),
        "json_rescue": rescued,
        **papers.queries(),
        **storage.queries(),
    }


def _score_sql(name, words):
    return f"(case when contains(t, '{words[0]}') then 1 else 0 end) + (case when contains(t, '{words[1]}') then 1 else 0 end)" if len(words) > 1 else f"(case when contains(t, '{words[0]}') then 1 else 0 end)"


def oracle_sql() -> dict[str, str]:
    any_of = lambda words: " or ".join(f"contains(t, '{w}')" for w in words)
    subject = "case " + " ".join(f"when {any_of([w for ws in ts.values() for w in ws])} then '{s}'" for s, ts in VOCABULARY.items()) + " end"
    clean = "low as (select doc_id, lang, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) as t from documents)"
    scored = "scored as (" + " union all ".join(f"select doc_id, '{topic}' as topic, {_score_sql(topic, words)} as score, {k} as rank from subj where subject = '{s}'" for k, (s, topic, words) in enumerate((s, t, w) for s, ts in VOCABULARY.items() for t, w in ts.items())) + ")"
    subj = f"subj as (select doc_id, t, {subject} as subject from low)"
    canon = "canon as (select fp, count(*)::int as n, arg_max(ord, (case when coalesce(answer, '') <> '' then 1 else 0 end, case when solved then 1 else 0 end, length(text), -ord)) as best, count(*) filter (where solved) as solved, count(distinct ord % 3) as variants, string_agg(ord, ',' order by ord) as sources, any_value(lang) as lang from prepared group by fp)"
    variants = "variants as (select fp, norm_answer as answer, count(*) as n, min(ord) as first from prepared where norm_answer <> '' group by all)"
    sample_values = ", ".join(f"({n}, '{p}', {k})" for n, ps in enumerate((PATTERNS[:3], PATTERNS[2:])) for k, p in enumerate(ps))
    pattern_values = ", ".join(f"('{p}', {k})" for k, p in enumerate(PATTERNS))
    return {
        "bm25_search": BM25_SQL.format(where=""),
        "bm25_search_filtered": BM25_SQL.format(where="join documents using (doc_id) where lang = 'en'"),
        "bm25_from_index": BM25_SQL.format(where=""),
        "bm25_scores": BM25_SQL.format(where="").removesuffix(" order by round(scored.score, 9) desc, doc_id limit 20"),
        "bm25_index_scores": BM25_SQL.format(where="").removesuffix(" order by round(scored.score, 9) desc, doc_id limit 20"),
        "retrieve": f"with best as ({BM25_SQL.format(where="join documents using (doc_id) where lang = 'en'")}), {RECORDS_SQL} select ord::varchar as question_id, answer, (2000 + ord % 3)::int as year, round(score, 4) as retrieval_score, lang as subject, 'unknown' as topic from best join records on doc_id = ord",
        "term_freq": f"select doc_id, count(*) as terms, sum(tf)::bigint as tokens, max(tf) as most from (select doc_id, term, count(*) as tf from (select doc_id, unnest({_tokens_sql()}) as term from documents) group by all) group by doc_id",
        "doc_freq": f"select term, count(distinct doc_id) as df from (select doc_id, unnest({_tokens_sql()}) as term from documents) group by term",
        "corpus_stats": f"select count(*) as n_docs, round(avg(len({_tokens_sql()})), 6) as avgdl from documents",
        "tokenize": f"select doc_id, array_to_string({_tokens_sql()}, ' ') as tokens from documents",
        "clean_text": "select doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) as clean from documents",
        "normalize_text": f"select doc_id, {_NORM.format('text')} as norm from documents",
        "fingerprint": f"select doc_id, sha256(lang || chr(10) || {_NORM.format('text')}) as fp from documents",
        "question_dedup": f"with {RECORDS_SQL}, {canon}, {variants}, listed as (select fp, string_agg(answer || '=' || n, ',' order by n desc, first) as answers from variants group by fp) select fp as question_fingerprint, best::varchar as question_id, n as duplicate_count, variants::int as metadata_variants, solved::int as solution_count, sources, coalesce(answers, '') as answers from canon left join listed using (fp)",
        "duplicate_report": f"with {RECORDS_SQL}, {canon} select fp as question_fingerprint, n as count, lang as question_type from canon where n > 1",
        "answer_variants": f"with {RECORDS_SQL}, {variants} select fp as question_fingerprint, answer, n from variants",
        "answer_conflicts": f"with {RECORDS_SQL} select fp as question_fingerprint, count(distinct norm_answer) as answers from prepared group by fp having count(distinct norm_answer) > 1",
        "conflict_report": f"with {RECORDS_SQL}, {canon}, {variants}, listed as (select fp, string_agg(answer || '=' || n, ',' order by n desc, first) as answers from variants group by fp), c as (select fp from prepared group by fp having count(distinct norm_answer) > 1) select fp as question_fingerprint, sha256(text) as question, coalesce(answers, '') as answers, sources from c join canon using (fp) left join listed using (fp) join documents on doc_id = best",
        "source_rows": f"with {RECORDS_SQL} select fp as question_fingerprint, ord, ord::varchar as question_id from prepared",
        "dedup_summary": f"with {RECORDS_SQL}, g as (select fp, count(*) as n from prepared group by fp) select sum(n)::bigint as records, count(*) as unique_questions, count(*) filter (where n > 1) as duplicate_groups, sum(n - 1)::bigint as removed from g",
        "corpus_order": "select doc_id::varchar as question_id from documents where length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) >= 10 order by 2000 + doc_id % 3, lang, text, doc_id::varchar",
        "inventory_union": f"with {FILES_SQL} select source_type, extension, count(*) as n from candidates group by all",
        "unified_corpus": f"with {FILES_SQL} select sha256, arg_min(source_type, (score, ord)) as canonical_source_type, arg_min(filename, (score, ord)) as canonical_filename, arg_min(extension, (score, ord)) as canonical_extension, arg_min(source_path, (score, ord)) as canonical_path, arg_min(size_bytes, (score, ord)) as size_bytes, count(*) as source_count, string_agg(source_path, ' | ' order by source_path) as all_sources from scored group by sha256",
        "cross_source_duplicates": f"with {FILES_SQL}, g as (select sha256, count(*) as source_count from candidates group by sha256 having count(distinct source_type) > 1) select sha256, source_count, source_type, filename, extension, source_path from candidates join g using (sha256)",
        "duplicate_files": f"with {FILES_SQL}, g as (select sha256, count(*) as duplicate_count, arg_min(ord, (score, ord)) as best from scored_files group by sha256 having count(*) > 1) select sha256, duplicate_count, filename, relative_path, ord = best as canonical from files join g using (sha256)",
        "duplicates_in_order": f"with {FILES_SQL}, g as (select sha256, count(*) as duplicate_count, min(ord) as first from files group by sha256 having count(*) > 1) select sha256, duplicate_count, relative_path from files join g using (sha256) order by duplicate_count desc, first, ord",
        "united_samples": f"with {FILES_SQL}, p(list, pattern, rank) as (values {sample_values}), low as (select doc_id, lower(text) as t from documents), hits as (select list, pattern, rank, doc_id, row_number() over (partition by list, pattern order by doc_id) as r from p join low on contains(t, pattern)), best as (select *, row_number() over (partition by list, doc_id order by rank) as again from hits where r = 1), named as (select list, rank, pattern, sha256, ord from best join files on ord = doc_id where again = 1), firsts as (select *, row_number() over (partition by sha256 order by list, rank) as f from named) select list::int as list, pattern, sha256, ord from firsts where f = 1",
        "canonical_files": f"with {FILES_SQL} select sha256, arg_min(relative_path, (score, ord)) as canonical_path, arg_min(extension, (score, ord)) as canonical_extension, count(*) as duplicate_count from scored_files group by sha256",
        "ext_counts": f"with {FILES_SQL} select extension, count(*) as n from files group by extension",
        "size_total": "select count(*) as n, sum(n_chars)::bigint as bytes from documents",
        "largest_files": f"with {FILES_SQL} select relative_path, size_bytes, case when size_bytes * 1000 < 1024 then printf('%.2f B', size_bytes * 1000.0) when size_bytes * 1000 < 1048576 then printf('%.2f KB', size_bytes * 1000 / 1024.0) else printf('%.2f MB', size_bytes * 1000 / 1048576.0) end as shown from files order by size_bytes desc, ord limit 20",
        "hash_groups": "select sha256(text) as sha256, count(*) as n from documents group by 1 having count(*) > 1",
        "largest_groups": f"with {FILES_SQL}, g as (select sha256, count(*) as n, min(ord) as first from files group by sha256 having count(*) > 1 order by n desc, first limit 10), r as (select sha256, n, relative_path, row_number() over (partition by sha256 order by ord) as r from files join g using (sha256)) select sha256, n, string_agg(relative_path, '|' order by r) as paths from r where r <= 5 group by all",
        "year_hist": "select year, count(*) as n from (select unnest(list_distinct(list_concat(regexp_extract_all(cast(o_orderdate as varchar), '\\b(?:19|20)\\d{2}\\b'), ['1999']))) as year from orders) group by year",
        "keyword_label_counts": "with low as (select lower(text) as t from documents) " + " union all ".join(f"select '{k}' as label, count(*) as n from low where {any_of(v)}" for k, v in LABELS.items()),
        "reference_candidates": "select doc_id from documents where contains(lower(text), 'apache') or contains(lower(text), 'license')",
        "competition_hints": "with low as (select lower(concat_ws(' ', source, case when doc_id % 6 = 0 then 'Shark finals' when doc_id % 4 = 0 then 'SMQ' when doc_id % 5 = 0 then 'sharks' end, text)) as t from documents) select count(*) filter (where contains(t, 'nsmq') or contains(t, 'smq')) as quiz, count(*) filter (where contains(t, 'sharks')) as sharks, count(*) filter (where contains(t, 'shark')) as shark from low",
        "sample_per_key": f"with p(pattern, rank) as (values {pattern_values}), low as (select doc_id, lower(text) as t from documents), hits as (select pattern, rank, doc_id, row_number() over (partition by pattern order by (case when contains(t, 'ung') then -100 else 0 end) + (case when contains(t, 'ion') then 10 else 0 end) + (case when contains(t, 'eau') then 10 else 0 end) desc, doc_id) as r from p join low on contains(t, pattern)), best as (select *, row_number() over (partition by doc_id order by rank) as again from hits where r = 1) select pattern, rank::int as rank, doc_id from best where again = 1",
        "subject_of": f"with {clean} select doc_id, case when doc_id % 9 = 0 then lang else {subject} end as subject from low",
        "topic_scores": f"with {clean}, {subj}, {scored} select doc_id, topic, score::int as score from scored where score > 0",
        "primary_topic": f"with {clean}, {subj}, {scored} select doc_id, coalesce(arg_max(topic, (score, -rank)) filter (where score > 0), 'unknown') as topic from low left join scored using (doc_id) group by doc_id",
        "pattern_profile": f"with {PROFILE_SQL} select topic, frequency, array_to_string(ys, ',') as years, recurrence::int as recurrence, recent_years::int as recent_years, forecast_score from profile",
        "forecast_examples": f"with {PROFILE_SQL}, best as (select topic, row_number() over (order by forecast_score desc, first) as topic_rank from profile order by forecast_score desc, first limit 5), r as (select topic, topic_rank, year, ord, row_number() over (partition by topic order by year desc, ord) as example from dated join best using (topic)) select topic, topic_rank::int as topic_rank, example::int as example, year::int as year, ord from r where example <= 2",
        "quiz_score": "select count(*) filter (where coalesce(value, 0) >= 30) as score, count(*) as total, round(100.0 * count(*) filter (where coalesce(value, 0) >= 30) / count(*), 6)::double as percent, case when 100.0 * count(*) filter (where coalesce(value, 0) >= 30) / count(*) >= 80 then 'excellent' when 100.0 * count(*) filter (where coalesce(value, 0) >= 30) / count(*) >= 60 then 'solid' else 'more practice' end as message from events",
        "topic_performance": "select user_id::varchar as topic, count(*) filter (where coalesce(value, 0) >= 30) as correct, count(*) as total, round(100.0::double * count(*) filter (where coalesce(value, 0) >= 30) / count(*), 6) as percent, case when 100.0 * count(*) filter (where coalesce(value, 0) >= 30) / count(*) >= 80 then 'green' when 100.0 * count(*) filter (where coalesce(value, 0) >= 30) / count(*) >= 60 then 'amber' else 'red' end as band from events group by user_id",
        "weak_topics": "select user_id::varchar as topic, count(*) filter (where coalesce(value, 0) >= 30) as correct, count(*) as total from events group by user_id having 100.0 * count(*) filter (where coalesce(value, 0) >= 30) / count(*) < 60",
        "grade_answers": "select event_id, lower(event_type) = (['click', 'view', 'purchase'])[event_id % 3 + 1] and event_type <> '' as correct from events",
        "quiz_progress": "select event_id, user_id, row_number() over (partition by user_id order by event_id)::int as number, count(*) over (partition by user_id) as \"of\" from events",
        "json_rescue": "select event_id, case event_id % 4 when 3 then null else coalesce(json_valid(props), false) end as found, case event_id % 4 when 0 then json_extract_string(props, '$.k') when 1 then json_extract_string(props, '$.k') when 2 then json_extract_string(props, '$.k') end as k from events",
        "file_sources": f"with {FILES_SQL} select sha256, source_type, source_path from candidates",
        **papers.oracle_sql(),
        **storage.oracle_sql(),
    }
