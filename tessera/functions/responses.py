"""What a model's raw output says: reasoning segments, answers, citations, refusals; Column to Column."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from .prompts import IDK

#: Words of refusals and of abstention, the citation block, and the tag that answers are cleaned of.
REFUSAL = "none of the|cannot be determined|not enough information"
ABSTENTION = "none|insufficient|not\\s+enough|cannot"
EVIDENCE = "Evidence\\s*:\\s*((?:\\[\\s*\\d+\\s*\\][\\s,;and]*)+)"
ANSWER_TAG = "</?\\\\s*(?:letter|answer)\\\\s*>"

#: The letter after "answer", a bare letter at the start, the letter after "answer" in reasoning.
SAID_LETTER = "(?iU)answer(?:\\s+is)?\\W*([A-Za-z])\\b"
BARE_LETTER = "(?U)^\\W*([A-Za-z])(?:[.):]|\\s*$|\\n)"
REASONED_LETTER = "(?iU)answer\\W*([A-Za-z])\\b"

#: The patterns of each kind of question, in order of priority.
GREETING = (
    r"^\s*(hi+|hello+|hey+|namaste|namaskar|good\s+(morning|afternoon|evening|night)|"
    r"thanks?|thank\s+you|thank\s+u|ok(ay)?|bye|who\s+are\s+you|what\s+can\s+you\s+do|"
    r"how\s+are\s+you)\b[\s!.,?]*(\w+[\s!.,?]*){0,3}$"
)
PREGNANCY_CHILD = (
    r"pregnan\w*", r"antenatal", r"prenatal", r"postnatal", r"post-?partum", r"labou?r pains?",
    r"delivery", r"miscarriage", r"trimester", r"breast-?feed\w*", r"lactat\w*",
    r"new-?born", r"neonat\w*", r"infant", r"baby", r"babies", r"toddler", r"child", r"children",
    r"kid", r"kids", r"\d+\s*(day|week|month)s?[\s-]*old", r"\d+\s*-?\s*(year|yr)s?[\s-]*old\s+(boy|girl)",
)
MEDICINE = (
    r"dose", r"dosage", r"doses", r"tablets?", r"pills?", r"syrup", r"capsules?", r"injection",
    r"medicines?", r"medications?", r"drugs?", r"side[\s-]?effects?", r"safe\s+to\s+(take|give|use)",
    r"can\s+(i|we|he|she|they)\s+(take|give)", r"overdose", r"\bmg\b", r"interaction", r"together\s+with",
    r"paracetamol", r"acetaminophen", r"ibuprofen", r"aspirin", r"antibiotic\w*", r"amoxicillin",
    r"metformin", r"insulin", r"\bors\b", r"iron\s+(tablet|folic)", r"folic\s+acid", r"expired",
)
TREATMENT = (
    r"treat\w*", r"manage\w*", r"\bcure\b", r"first[\s-]aid", r"what\s+(should|can|do)\s+(i|we)\s+do",
    r"how\s+(to|do\s+i|should\s+i)\s+(care|help|stop|reduce|handle)", r"home\s+(care|remed\w*)",
    r"what\s+to\s+give", r"remed(y|ies)",
)
SYMPTOMS = (
    r"pain", r"ache", r"fever", r"cough", r"vomit\w*", r"diarrh\w*", r"loose\s+motions?", r"rash",
    r"swell\w*", r"bleed\w*", r"headache", r"breath\w*", r"dizz\w*", r"weak\w*", r"itch\w*",
    r"burn\w*", r"wound", r"jaundice", r"yellow", r"chills?", r"faint\w*", r"seizure", r"fits?",
    r"symptoms?", r"suffer\w*", r"complain\w*", r"since\s+\d+\s+(day|week)s?", r"for\s+\d+\s+(day|week)s?",
    r"what\s+(could|can|might)\s+(it|this)\s+be", r"cause[sd]?",
)


def _whole(patterns: tuple[str, ...]) -> str:
    """One pattern for any of these between word boundaries."""
    return "(?i)" + "|".join(rf"\b(?:{p})\b" for p in patterns)


KINDS = {"pregnancy_child": _whole(PREGNANCY_CHILD), "medicine_safety": _whole(MEDICINE), "treatment": _whole(TREATMENT), "symptoms": _whole(SYMPTOMS)}


def _last(found: Column) -> Column:
    return F.get(found, F.size(found) - 1)


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, "(?U)^\\s+|\\s+$", "")


def close_think(c: Column) -> Column:
    """An end tag is added where more reasoning is opened than closed."""
    opened, closed = (F.regexp_count(c, F.lit(f"(?i)<{tag}>")) for tag in ("think", "/think"))
    return F.when(opened > closed, F.concat(c, F.lit("\n</think>"))).otherwise(c)


def strip_think(c: Column) -> Column:
    """Reasoning goes, with its tags, and so do tags that stand alone."""
    return _strip(F.regexp_replace(_strip(F.regexp_replace(c, "(?is)<think>.*?</think>", "")), "(?i)</?think>", ""))


def final_segment(c: Column) -> Column:
    """What follows the last end of reasoning; nothing where reasoning is not closed; all where there is none."""
    text = F.coalesce(c, F.lit(""))
    after = F.regexp_replace(text, "(?is)^.*</think>", "")
    return F.when(text.rlike("(?i)</think>"), after).when(text.rlike("(?i)<think>"), "").otherwise(text)


def parse_answer(c: Column, options: Column, idk: str | None = None) -> Column:
    """The letter that an output answers with, "ABSTAIN" for the option that admits not knowing, or null.

    In this order: a letter after "answer", an option's text after it, a bare letter at the start, the words of not knowing.
    options: map of letter to text.
    """
    text = _strip(F.regexp_replace(c, f"(?i){ANSWER_TAG}", " "))

    def letter(pattern: str) -> Column:
        found = F.upper(F.regexp_extract(text, pattern, 1))
        return F.when(F.map_contains_key(options, found), found)

    said = letter(SAID_LETTER)
    named = F.filter(F.map_keys(options), lambda k: F.regexp_like(F.lower(text), F.concat(F.lit("(?U)answer\\W*\\Q"), F.lower(options[k]), F.lit("\\E\\b"))))
    bare = letter(BARE_LETTER)
    answer = F.coalesce(said, F.get(named, F.lit(0)), bare)
    unsure = options[answer] == IDK
    if idk is not None:
        unsure = (answer == idk) | unsure
    words = F.when(F.contains(F.lower(text), F.lit(IDK.lower())), "ABSTAIN")
    return F.when(answer.isNotNull() & unsure, "ABSTAIN").otherwise(F.coalesce(answer, words))


def last_answer(c: Column, letters: tuple[str, ...] = ("A", "B", "C", "D", "E")) -> Column:
    """The last letter after "answer" that is one of the options."""
    found = F.transform(F.regexp_extract_all(c, F.lit(REASONED_LETTER), 1), lambda x: F.upper(x))
    return _last(F.filter(found, lambda x: x.isin(*letters)))


def _numbers(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit("\\b[0-9]+\\b"), 0), lambda x: F.try_to_number(x, F.lit("9" * 18)).cast("long"))


def parse_citations(c: Column, n: int) -> Column:
    """Distinct numbers 1 to n in square brackets, ascending; where none has a number, those in the line after "Evidence:"."""
    text = F.coalesce(c, F.lit(""))
    inside = _numbers(F.array_join(F.regexp_extract_all(text, F.lit("\\[([^\\]]+)\\]"), 1), " ; "))
    line = F.regexp_extract(text, "(?is)evidence\\s*:\\s*([^\\n]*)", 1)
    found = F.when(F.size(inside) > 0, inside).otherwise(_numbers(line))
    return F.array_sort(F.array_distinct(F.filter(found, lambda x: (x >= 1) & (x <= n))))


def final_cites(c: Column) -> Column:
    """Distinct numbers of the last evidence block after reasoning, ascending; null where there is no block."""
    block = _last(F.regexp_extract_all(F.substring_index(c, "</think>", -1), F.lit(f"(?i){EVIDENCE}"), 1))
    return F.array_sort(F.array_distinct(_numbers(block)))


def verbal_abstention(c: Column) -> Column:
    """Whether what follows "Answer:", or the whole output, begins with a refusal."""
    text = F.coalesce(c, F.lit(""))
    after = F.when(text.rlike("(?i)Answer\\s*:"), F.regexp_extract(text, "(?is)Answer\\s*:\\s*(.*)", 1)).otherwise(text)
    return after.rlike(f"(?i)^\\s*[*_`\"'#\\s]*({ABSTENTION})\\b")


def spontaneous_refusal(c: Column) -> Column:
    return F.coalesce(c.rlike(f"(?i)({REFUSAL})"), F.lit(False))


def option_match(passage: Column, option: Column, least: int = 3) -> tuple[Column, Column]:
    """Whether a passage holds an option's text, and whether it does without the first word (of least characters at least)."""
    p, o = F.lower(F.coalesce(passage, F.lit(""))), _strip(F.lower(F.coalesce(option, F.lit(""))))
    rest = F.regexp_replace(F.regexp_replace(o, "(?U)^\\S+\\s*", ""), "(?U)\\s+", " ")
    return (o != "") & F.contains(p, o), (F.char_length(rest) >= least) & F.contains(p, rest)


def answer_in(passages: Column, gold: Column, dataset: Column) -> Column:
    """Whether one of the passages holds the right option's text; null for other datasets and for short options."""
    return F.when((dataset == "medqa") & (F.char_length(gold) >= 4), F.exists(passages, lambda p: F.contains(F.lower(p), F.lower(gold))))


@F.pandas_udf(BooleanType())
def loop_suspect(said: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Whether the last 2,000 characters, 200 at least, compress to less than a fifth."""
    for texts in said:
        tails = [(t or "")[-2000:] for t in texts]
        yield pd.Series([len(t) >= 200 and len(zlib.compress(t.encode("utf-8", "surrogatepass"))) < 0.2 * len(t) for t in tails])


def format_p(p: Column) -> Column:
    text = F.when(p.isNull(), "n/a").when(p < 1e-300, "< 1e-300").when(p < 0.001, F.format_string("%.2e", p))
    return text.otherwise(F.format_string("%.5f", p))


def norm_text(c: Column) -> Column:
    return _strip(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "(?U)\\s+", " "))


#: Words as the leakage audit cuts them: inner quotes and hyphens, however many, stay.
GRAM_WORD = "[\\p{L}\\p{N}_](?:[\\p{L}\\p{N}_'-]*[\\p{L}\\p{N}_])?"


def gram_words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(GRAM_WORD), 0)


def is_numeric_token(token: Column) -> Column:
    return token.rlike("^[$€£]?[0-9]+(?:[.,][0-9]+)*(?:%|[a-zA-Z]+)?$")


def question_type(c: Column, emergency: bool = False) -> Column:
    """The kind of a question; emergency: a red flag was found, so it is neither a greeting nor unclear."""
    text = F.trim(F.coalesce(c, F.lit("")))
    words = F.regexp_count(text, F.lit("[A-Za-z0-9]+"))
    kind = F.lit("symptoms" if emergency else "general_info")
    for name, pattern in reversed(KINDS.items()):
        kind = F.when(text.rlike(pattern), F.lit(name)).otherwise(kind)
    if emergency:
        return kind
    medical = text.rlike("|".join(KINDS.values()))
    return F.when(words == 0, "unclear").when(text.rlike(f"(?i){GREETING}") & ~medical, "greeting").when(words <= 2, "unclear").otherwise(kind)
