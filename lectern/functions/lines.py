"""What a line of a question paper is. Two grammars: the plain one (v1) and the one that is used downstream (v2).

The answer patterns have no word boundary: any line that begins with an a is an answer. strict=True asks for one.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.text import clean, strip

# The patterns of the second grammar.
ROUND = "(?i)^\\s*(?:PRE\\s*C\\s*(\\d+)\\s+)?ROUND\\s+([1-5](?:[A-Z])?)(?:\\s*:\\s*(.*))?\\s*$"
CONTEST = "(?i)^\\s*CONTEST\\s+(\\d+)([A-Z])?\\s*$"
PRE_CONTEST = "(?i)^\\s*PRE\\s*C\\s*(\\d+)\\s*$"
SUBJECT = "(?i)^\\s*(BIOLOGY|CHEMISTRY|PHYSICS|MATHEMATICS|MATHS)(?:\\s+\\d+)?\\s*$"
NUMBER = "^\\s*(\\d+)[\\.\\)]?\\s+(.+)$"
LETTER = "(?i)^\\s*([a-z])[\\.\\)]\\s*(.+)$"
ANSWER = "(?i)^\\s*(?:ANSWER|ANS|A)\\s*[:=\\-\\.]?\\s*(.*)$"
SOLUTION = "(?i)^\\s*SOLUTION\\s*[:=\\-\\.]?\\s*(.*)$"
STRICT_ANSWER = "(?i)^\\s*(?:ANSWER|ANS|A)\\b\\s*[:=\\-\\.]?\\s*(.*)$"
# Labels of special rounds, the first that a label contains counts.
SPECIAL = {"speed race": "speed_race", "riddle": "riddle", "true or false": "true_false", "problem of the day": "problem_of_day"}
# Words that begin a question in both grammars, and those of the second one alone.
STARTERS = (
    "what", "which", "who", "where", "when", "why", "how", "find", "calculate", "determine", "state", "give",
    "name", "define", "explain", "identify", "solve", "evaluate", "describe", "arrange", "mention", "distinguish", "select", "choose",
)
MORE_STARTERS = ("factorize", "factorise", "simplify", "differentiate", "prove", "show")

# The patterns of the first grammar.
V1_ROUND = "(?i)^\\s*round\\s*([1-5])(?:\\s*[:\\-]?\\s*(.*))?$"
V1_CONTEST = "(?i)^\\s*contest\\s+(\\d+)\\s*([a-z])?\\s*$"
V1_SUBJECT = "(?i)^\\s*(biology|chemistry|mathematics|maths|physics)\\s*(\\d+)?\\s*$"
V1_ANSWER = "(?i)^\\s*(answer|ans|a)\\s*[:\\.\\-]?\\s*(.*)$"
V1_QUESTION = "(?i)^\\s*(q\\.|question\\s*[:.]|\\d+[\\).\\:]?)\\s+"
V1_PREAMBLE = "(?i)^\\s*preamble\\s*[:=\\-]?\\s*(.*)$"
V1_SOLUTION = "(?i)^\\s*solution\\s*[:=\\-]?\\s*(.*)$"
V1_SPECIAL = "(?i)^\\s*(speed\\s*race|true\\s+or\\s+false|riddles?|problem\\s+of\\s+the\\s+day)\\b"


def _group(c: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def _subject(c: Column, pattern: str) -> Column:
    s = F.lower(_group(c, pattern, 1))
    return F.when(s == "maths", "mathematics").otherwise(s)


def special_of(label: Column) -> Column:
    low, out = F.lower(label), F.lit(None).cast("string")
    for key, value in reversed(SPECIAL.items()):
        out = F.when(low.contains(key), value).otherwise(out)
    return out


def _starts(c: Column, words: tuple[str, ...]) -> Column:
    return F.lower(c).rlike("^(?:" + "|".join(words) + ") ")


def answer_pattern(strict: bool) -> str:
    return STRICT_ANSWER if strict else ANSWER


def v2_fields(text: Column, strict: bool = False, cleaned: bool = False) -> dict[str, Column]:
    """Columns by name for a line of the second grammar; select the cleaned text as a column first and say so, and it is cleaned once."""
    c = text if cleaned else clean(text)
    item_number = F.coalesce(F.regexp_replace(_group(c, NUMBER, 1), "^0+(?=\\d)", ""), F.lower(_group(c, LETTER, 1)))
    item_text = F.trim(F.coalesce(_group(c, NUMBER, 2), _group(c, LETTER, 2)))
    answer = answer_pattern(strict)
    # Few lines are headers; the parts of one are looked for in these alone.
    is_round, is_contest = c.rlike(ROUND), c.rlike(CONTEST) | c.rlike(PRE_CONTEST)
    return {
        "is_round": is_round,
        "round": F.when(is_round, F.upper(_group(c, ROUND, 2))),
        "round_contest": F.when(is_round, _group(c, ROUND, 1).cast("int")),
        "round_label": F.when(is_round, F.nullif(F.trim(_group(c, ROUND, 3)), F.lit(""))),
        "round_section": F.when(is_round, special_of(_group(c, ROUND, 3))),
        "is_contest": is_contest,
        "contest": F.when(is_contest, F.coalesce(_group(c, CONTEST, 1), _group(c, PRE_CONTEST, 1)).cast("int")),
        "subject": _subject(c, SUBJECT),
        "item_number": item_number,
        "item_text": item_text,
        "answer": F.when(c.rlike(answer), F.trim(F.regexp_extract(c, answer, 1))),
        "solution": F.when(c.rlike(SOLUTION), F.trim(F.regexp_extract(c, SOLUTION, 1))),
        "is_question": (c != "") & (c.endswith("?") | _starts(c, STARTERS + MORE_STARTERS)),
        "is_who": F.lower(c).startswith("who am i"),
    }


def v1_section(c: Column) -> Column:
    s = F.regexp_replace(F.lower(_group(c, V1_SPECIAL, 1)), "\\s+", "")
    return F.when(s == "speedrace", "speed_race").when(s == "trueorfalse", "true_false").when(s.startswith("riddle"), "riddle").when(s == "problemoftheday", "problem_of_day")


def v1_is_question(c: Column) -> Column:
    return (c != "") & (c.rlike(V1_QUESTION) | c.endswith("?") | _starts(c, STARTERS))


def v1_kind(c: Column) -> Column:
    """ROUND, CONTEST, SPECIAL, SUBJECT, PREAMBLE, SOLUTION, ANSWER, Q or OTHER of a clean line, the first that fits."""
    return (
        F.when(c.rlike(V1_ROUND), "ROUND").when(c.rlike(V1_CONTEST), "CONTEST").when(v1_section(c).isNotNull(), "SPECIAL").when(c.rlike(V1_SUBJECT), "SUBJECT")
        .when(c.rlike(V1_PREAMBLE), "PREAMBLE").when(c.rlike(V1_SOLUTION), "SOLUTION").when(c.rlike(V1_ANSWER), "ANSWER").when(v1_is_question(c), "Q").otherwise("OTHER")
    )


def strip_question_marker(c: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(c, "(?i)^\\s*q\\.\\s*", ""), "(?i)^\\s*question\\s*[:.]?\\s*", ""))


v1_subject = lambda c: _subject(c, V1_SUBJECT)
