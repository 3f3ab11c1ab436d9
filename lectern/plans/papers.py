"""Queries of segmentation over whole documents, whose lines are marked as question papers by rule, and SQL for them.

Documents have no headers, numbers or answers. So a line gets a mark by its document and block, in the same way in Spark and in SQL, and a few lines by hand
are added as one more document.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import lines as L
from lectern.functions.text import clean, collapse
from lectern.operators import segment

SAMPLE_LINES = [
    "CONTEST 4", "PRE C 4 ROUND 2", "ROUND 1", "PHYSICS", "1. What is x?", "ANSWER: 5", "Round 3b: Speed Race", "12 V battery", "1.What", "e.g. iron", "b)x", "Arrange the ions", "A ball falls",
    "a) first part", "ANS = 3", "SOLUTION: s", "ROUND 5: RIDDLES", "Who am I?", "ROUND 4: TRUE OR FALSE", "Consider gases.", "Maths 2", "Preamble: p", "Question. Find x", "ROUND 1 - x", "Round 6", "Speed Race", "more text", "Find y",
]

#: Marks by remainder: text before and after a line. Remainders without a mark leave the line as it is.
MARKS = {6: ("", "?"), 7: ("ANSWER: ", ""), 8: ("Solution: ", ""), 9: ("What ", ""), 10: ("Who am I ", ""), 11: ("b) ", ""), 12: ("Preamble: ", ""), 13: ("Find ", ""), 14: ("Question: ", "")}
LABELS = ("", ": Riddles", ": True or False", ": Speed Race")
PERIOD = 19


def sample_lines(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(SAMPLE_LINES, 1)), "block int, text string").select(F.lit("sample").alias("document_id"), "block", "text", F.expr(f"cast(array() as {segment.IMAGES})").alias("images"))


def paper_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines of all documents, marked, and the sample lines."""
    lines = segment.text_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    block, text, m = F.col("block"), F.col("text"), F.col("m")
    lines = lines.withColumn("m", F.pmod(F.col("document_id").cast("long") * 31 + block * 17, F.lit(PERIOD)))
    label = F.element_at(F.array(*map(F.lit, LABELS)), block % 4 + 1)
    marked = F.when(m == 0, F.concat(F.lit("ROUND "), (1 + block % 5).cast("string"), label)).when(m == 1, F.concat(F.lit("CONTEST "), (block % 40).cast("string")))
    marked = marked.when(m == 2, F.when(block % 2 == 0, "PHYSICS").otherwise("Maths 2")).when(m.between(3, 5), F.concat((block % 9 + 1).cast("string"), F.lit(". "), text))
    marked = marked.when((m == 15) & (block % 2 == 0), "SPEED RACE")
    for k, (before, after) in MARKS.items():
        marked = marked.when(m == k, F.concat(F.lit(before), text, F.lit(after)))
    lines = lines.select("document_id", "block", collapse(marked.otherwise(text)).alias("text"), "images")
    return lines.unionByName(sample_lines(spark))


def classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = L.v2_fields(F.col("clean"), cleaned=True)
    names = ("is_round", "round", "round_contest", "round_label", "is_contest", "contest", "subject", "item_number", "item_text", "answer", "solution", "is_question", "is_who")
    return paper_lines(spark, sf_dir).withColumn("clean", clean(F.col("text"))).select("document_id", "block", L.v1_kind(F.col("text")).alias("v1_kind"), f["round_section"].alias("section"), *(f[n].alias(n) for n in names))


def context_carry(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = segment.carried_v1(paper_lines(spark, sf_dir))
    return x.select("document_id", "block", "kind", "c_round.round", F.col("c_round.label").alias("round_label"), "c_contest.contest", F.col("c_section.v").alias("section"), F.col("c_preamble.v").alias("preamble"), F.col("c_subject").alias("subject"))


def flat_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = segment.segment_v1(paper_lines(spark, sf_dir))
    return x.select("question_id", "metadata.contest", "metadata.round", "metadata.subject", "metadata.section_type", "preamble", "question_text", "answer", "solution", "source.start_block", "source.end_block")


def flat_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = segment.flatten_v2(segment.segment_v2(paper_lines(spark, sf_dir)))
    return x.select("question_id", "question_type", "metadata.contest", "metadata.round", "metadata.subject", "prompt", "question_text", "answer", "solution", "source.start_block", "source.end_block")


def groups_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = segment.segment_v2(paper_lines(spark, sf_dir)).where("kind = 'group'")
    return x.select("document_id", "group", "group_type", "contest", "round", "subject", "prompt", "group_start", "group_end")


def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("string").alias("document_id"))
    return segment.segment_stats(segment.segment_v2(paper_lines(spark, sf_dir)), documents)


def block_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = segment.text_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return lines.groupBy("document_id").agg(F.count(F.lit(1)).alias("lines"), F.max("block").alias("last_block"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"line_classify": classes, "context_carry": context_carry, "doc_block_stats": block_stats, "segment_v1": flat_v1, "segment_v2": flat_v2, "segment_groups": groups_v2, "segment_stats": stats}


def _paper_sql() -> str:
    marks = " ".join(f"when {k} then '{b}' || t || '{a}'" for k, (b, a) in MARKS.items())
    labels = "(['" + "', '".join(LABELS) + "'])[block % 4 + 1]"
    samples = ", ".join(f"({k}, '{x}')" for k, x in enumerate(SAMPLE_LINES, 1))
    return f"""
raw as (select doc_id, unnest(string_split(text, chr(10))) as t, generate_subscripts(string_split(text, chr(10)), 1)::int as block from documents),
tidy as (select doc_id, block, trim(regexp_replace(t, '\\s+', ' ', 'g')) as t, (doc_id * 31 + block * 17) % {PERIOD} as m from raw),
paper as (
  select doc_id::varchar as document_id, block, trim(case m when 0 then 'ROUND ' || (1 + block % 5) || {labels} when 1 then 'CONTEST ' || (block % 40) when 2 then case when block % 2 = 0 then 'PHYSICS' else 'Maths 2' end
    when 3 then (block % 9 + 1) || '. ' || t when 4 then (block % 9 + 1) || '. ' || t when 5 then (block % 9 + 1) || '. ' || t when 15 then case when block % 2 = 0 then 'SPEED RACE' else t end {marks} else t end) as text
  from tidy where t <> ''
  union all select 'sample', k, x from (values {samples}) s(k, x))"""


def _starts_sql(words: tuple[str, ...]) -> str:
    return "regexp_matches(lower(text), '^(?:" + "|".join(words) + ") ')"


def _extract(pattern: str, group: int) -> str:
    return f"regexp_extract(text, '{pattern}', {group})"


def _if(pattern: str, group: int) -> str:
    return f"case when regexp_matches(text, '{pattern}') then trim({_extract(pattern, group)}) end"


_SECTION_V1 = f"case replace(lower({_extract(L.V1_SPECIAL, 1)}), ' ', '') when 'speedrace' then 'speed_race' when 'trueorfalse' then 'true_false' when 'riddle' then 'riddle' when 'riddles' then 'riddle' when 'problemoftheday' then 'problem_of_day' end"
_KIND_V1 = (
    "case " + " ".join(f"when regexp_matches(text, '{p}') then '{k}'" for k, p in (("ROUND", L.V1_ROUND), ("CONTEST", L.V1_CONTEST), ("SPECIAL", L.V1_SPECIAL), ("SUBJECT", L.V1_SUBJECT), ("PREAMBLE", L.V1_PREAMBLE), ("SOLUTION", L.V1_SOLUTION), ("ANSWER", L.V1_ANSWER), ("Q", L.V1_QUESTION)))
    + f" when ends_with(text, '?') or {_starts_sql(L.STARTERS)} then 'Q' else 'OTHER' end"
)


def _subject_sql(pattern: str) -> str:
    return f"case lower({_extract(pattern, 1)}) when '' then null when 'maths' then 'mathematics' else lower({_extract(pattern, 1)}) end"


def _fields_sql() -> dict[str, str]:
    label = f"lower({_extract(L.ROUND, 3)})"
    number = f"coalesce(nullif(ltrim({_extract(L.NUMBER, 1)}, '0'), ''), '0')"
    return {
        "v1_kind": _KIND_V1,
        "section": "case " + " ".join(f"when contains({label}, '{k}') then '{v}'" for k, v in L.SPECIAL.items()) + " end",
        "is_round": f"regexp_matches(text, '{L.ROUND}')", "round": f"nullif(upper({_extract(L.ROUND, 2)}), '')", "round_contest": f"nullif({_extract(L.ROUND, 1)}, '')::int", "round_label": f"nullif(trim({_extract(L.ROUND, 3)}), '')",
        "is_contest": f"regexp_matches(text, '{L.CONTEST}') or regexp_matches(text, '{L.PRE_CONTEST}')", "contest": f"coalesce(nullif({_extract(L.CONTEST, 1)}, ''), nullif({_extract(L.PRE_CONTEST, 1)}, ''))::int", "subject": _subject_sql(L.SUBJECT),
        "item_number": f"case when regexp_matches(text, '{L.NUMBER}') then {number} else nullif(lower({_extract(L.LETTER, 1)}), '') end",
        "item_text": f"case when regexp_matches(text, '{L.NUMBER}') then trim({_extract(L.NUMBER, 2)}) when regexp_matches(text, '{L.LETTER}') then trim({_extract(L.LETTER, 2)}) end",
        "answer": _if(L.ANSWER, 1), "solution": _if(L.SOLUTION, 1), "is_question": f"ends_with(text, '?') or {_starts_sql(L.STARTERS + L.MORE_STARTERS)}", "is_who": "starts_with(lower(text), 'who am i')",
    }


_FIELDS = "classified as (select document_id, block, text, " + ", ".join(f"{v} as {k}" for k, v in _fields_sql().items()) + " from paper)"

# A reset to null is carried as chr(1).
_CARRIED = f"""
kinds as (select document_id, block, text, {_KIND_V1} as kind from paper),
marked as (
  select *, case when kind = 'ROUND' then {_extract(L.V1_ROUND, 1)}::int end as m_round, case when kind = 'ROUND' then {_extract(L.V1_ROUND, 2)} end as m_label, case when kind = 'CONTEST' then {_extract(L.V1_CONTEST, 1)}::int end as m_contest,
    case kind when 'ROUND' then chr(1) when 'SPECIAL' then {_SECTION_V1} end as m_section,
    case when kind in ('ROUND', 'CONTEST') then chr(1) when kind = 'PREAMBLE' then coalesce(nullif(trim({_extract(L.V1_PREAMBLE, 1)}), ''), chr(1)) end as m_preamble, case when kind = 'SUBJECT' then {_subject_sql(L.V1_SUBJECT)} end as m_subject
  from kinds),
carried as (
  select *, last_value(m_round ignore nulls) over w as round, last_value(m_label ignore nulls) over w as round_label, last_value(m_contest ignore nulls) over w as contest, nullif(last_value(m_section ignore nulls) over w, chr(1)) as section,
    nullif(last_value(m_preamble ignore nulls) over w, chr(1)) as preamble, last_value(m_subject ignore nulls) over w as subject
  from marked window w as (partition by document_id order by block rows between unbounded preceding and current row))"""

_V1 = f"""
lined as (
  select *, kind in ('ROUND', 'CONTEST', 'SPECIAL') as closes, sum((kind = 'Q')::int) over w as q, last_value(case when kind = 'Q' then 0 when kind in ('ROUND', 'CONTEST', 'SPECIAL') then 1 end ignore nulls) over w as closed,
    max(block) over (partition by document_id) as last_block, min(case when kind in ('Q', 'ROUND', 'CONTEST', 'SPECIAL') then block end) over (partition by document_id order by block rows between 1 following and unbounded following) as next_end
  from carried window w as (partition by document_id order by block rows between unbounded preceding and current row)),
inside as (
  select *, coalesce(last_value(case when kind = 'SOLUTION' then 1 when kind in ('Q', 'ANSWER') then 0 end ignore nulls) over w, 0) as mode, case when kind = 'SOLUTION' then nullif(trim({_extract(L.V1_SOLUTION, 1)}), '') end as said
  from lined where q > 0 and closed = 0 window w as (partition by document_id, q order by block rows between unbounded preceding and current row)),
runs as (select *, count(said) over (partition by document_id, q order by block rows between unbounded preceding and current row) as run, count(said) over (partition by document_id, q) as last_run from inside),
parts as (
  select *, case when run = last_run and said is not null then said when run = last_run and kind = 'OTHER' and mode = 1 then text end as part,
    case when kind = 'Q' then trim(regexp_replace(regexp_replace(text, '(?i)^\\s*q\\.\\s*', ''), '(?i)^\\s*question\\s*[:.]?\\s*', '')) when kind = 'OTHER' and mode = 0 then text end as piece
  from runs),
asked as (
  select document_id, q, max(contest) filter (kind = 'Q') as contest, max(round) filter (kind = 'Q') as round, max(subject) filter (kind = 'Q') as subject, max(section) filter (kind = 'Q') as section_type, max(preamble) filter (kind = 'Q') as preamble,
    trim(regexp_replace(coalesce(string_agg(nullif(piece, ''), ' ' order by block), ''), '\\s+', ' ', 'g')) as question_text, arg_max(trim({_extract(L.V1_ANSWER, 2)}), block) filter (kind = 'ANSWER') as answer,
    nullif(string_agg(part, ' ' order by block), '') as solution, max(block) filter (kind = 'Q') as start_block, min(coalesce(next_end - 1, last_block)) filter (kind = 'Q') as end_block
  from parts group by document_id, q)"""

_V2 = """
headed as (
  select *, is_round or is_contest as header, sum((is_round or is_contest)::int) over w as seg, last_value(case when is_round then round_contest when is_contest then contest end ignore nulls) over w as c_contest,
    last_value(case when is_round then round end ignore nulls) over w as c_round, nullif(last_value(case when is_round then coalesce(section, chr(1)) end ignore nulls) over w, chr(1)) as c_section,
    last_value(case when not (is_round or is_contest) then subject end ignore nulls) over w as c_subject,
    coalesce(min(case when is_round or is_contest then block end) over (partition by document_id order by block rows between 1 following and unbounded following) - 1, max(block) over (partition by document_id)) as group_end
  from classified window w as (partition by document_id order by block rows between unbounded preceding and current row)),
firsts as (
  select document_id, seg, min(block) as c1, arg_min(coalesce(c_section, 'standard'), block) as group_type, arg_min(coalesce(c_contest, -1), block) as g_contest, arg_min(coalesce(c_round, ''), block) as g_round, arg_min(coalesce(c_subject, ''), block) as g_subject,
    dense_rank() over (partition by document_id order by seg) as grp
  from headed where not header and subject is null group by document_id, seg),
content as (select h.*, c1, group_type, grp, item_number is not null as item, group_type = 'riddle' and is_who and block > c1 as riddle_end from headed h join firsts using (document_id, seg) where not header and subject is null),
with_s0 as (select *, min(case when not item and is_question and not riddle_end then block end) over (partition by document_id, seg) as s0 from content),
with_p as (select *, min(case when item and not (answer is not null and coalesce(block > s0, false)) then block end) over (partition by document_id, seg) as p from with_s0),
phased as (select *, coalesce(block >= p, false) as late, coalesce(block > p, false) or (not coalesce(block >= p, false) and coalesce(block > s0, false)) as target from with_p),
first_roles as (
  select *, case when target and answer is not null then 'answer' when target and solution is not null then 'solution' when late and item then 'item' when late then 'text' when riddle_end then 'overwrite' when block >= s0 then 'alone' else 'prompt' end as role0 from phased),
premises as (select *, case when group_type = 'true_false' and s0 = c1 then min(case when role0 = 'alone' and block > s0 then block end) over (partition by document_id, seg) end as premise from first_roles),
roles as (select *, case when block = premise then 'prompt' else role0 end as role from premises),
counted as (
  select *, sum((not late and role = 'answer')::int) over w as answers, min(case when role = 'item' then block end) over (partition by document_id, seg order by block rows between 1 following and unbounded following) as next_item,
    max(case when role = 'overwrite' then block end) over (partition by document_id, seg) as replaced
  from roles window w as (partition by document_id, seg order by block rows between unbounded preceding and current row)),
asks as (select *, last_value(case when role = 'alone' and is_question then answers end ignore nulls) over (partition by document_id, seg order by block rows between unbounded preceding and 1 preceding) as asked from counted),
begun as (select *, coalesce(role = 'alone' and (block = s0 or (is_question and answers > asked)), false) as starts from asks),
numbered as (
  select *, case when late then 'item' when role in ('prompt', 'overwrite') then 'group' else 'alone' end as kind,
    sum((role = 'item')::int) over w as nth_item, sum(starts::int) over w as nth_alone
  from begun window w as (partition by document_id, seg order by block rows between unbounded preceding and current row)),
records as (
  select document_id, grp, kind, case kind when 'item' then nth_item else nth_alone end as ordinal, any_value(seg) as seg, string_agg(case when role = 'item' then item_text when role in ('text', 'alone') then text end, ' ' order by block) as question,
    arg_max(answer, block) filter (role = 'answer') as answer, arg_max(solution, block) filter (role = 'solution') as solution, min(case when role = 'item' or starts then block end) as start_block,
    min(case when role = 'item' then coalesce(next_item - 1, group_end) end) as end_block
  from numbered where kind <> 'group' group by all),
prompts as (select document_id, seg, string_agg(case when block >= coalesce(replaced, 0) then text end, ' ' order by block) as prompt from numbered where kind = 'group' group by all),
grouped as (
  select document_id, seg, f.grp as "group", group_type, nullif(g_contest, -1) as contest, nullif(g_round, '') as round, nullif(g_subject, '') as subject, prompt, c1 as group_start, e.group_end
  from firsts f left join prompts using (document_id, seg) join (select distinct document_id, seg, group_end from content) e using (document_id, seg))"""


def oracle_sql() -> dict[str, str]:
    paper = _paper_sql()
    return {
        "line_classify": f"with {paper}, {_FIELDS} select * exclude (text) from classified",
        "context_carry": f"with {paper}, {_CARRIED} select document_id, block, kind, round, round_label, contest, section, preamble, subject from carried",
        "doc_block_stats": "with l as (select doc_id, unnest(string_split(text, chr(10))) as t, generate_subscripts(string_split(text, chr(10)), 1) as k from documents) select doc_id::varchar as document_id, count(*) as lines, max(k)::int as last_block from l where trim(regexp_replace(t, '\\s+', ' ', 'g')) <> '' group by doc_id",
        "segment_v1": f"with {paper}, {_CARRIED}, {_V1} select printf('%s_q%04d', document_id, row_number() over (partition by document_id order by q)) as question_id, contest, round, subject, section_type, preamble, question_text, answer, solution, start_block, end_block from asked",
        "segment_v2": f"with {paper}, {_FIELDS}, {_V2} select printf('%s_g%04d_%s%03d', r.document_id, grp, case r.kind when 'item' then 'q' else 's' end, ordinal::bigint) as question_id, group_type as question_type, contest, round, subject, prompt, "
        "case when r.kind = 'item' and coalesce(prompt, '') <> '' then prompt || ' ' || question else question end as question_text, answer, solution, start_block, end_block from records r join grouped g on r.document_id = g.document_id and r.seg = g.seg",
        "segment_groups": f"with {paper}, {_FIELDS}, {_V2} select * exclude (seg) from grouped",
        "segment_stats": f"with {paper}, {_FIELDS}, {_V2}, g as (select document_id, count(*) as groups from grouped group by all), r as (select document_id, count(*) filter (kind = 'item') as numbered_items, count(*) filter (kind = 'alone') as standalone_questions from records group by all) "
        "select doc_id::varchar as document_id, coalesce(groups, 0)::bigint as groups, coalesce(numbered_items, 0)::bigint as numbered_items, coalesce(standalone_questions, 0)::bigint as standalone_questions from documents left join g on doc_id::varchar = g.document_id left join r on doc_id::varchar = r.document_id",
    }
