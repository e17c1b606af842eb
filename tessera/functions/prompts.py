"""Prompt assembly, Column to Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The wording that models were evaluated with.
HEAD = "You are a medical expert answering a multiple-choice question."
USE_EVIDENCE = "Use the numbered evidence passages."
FORMAT = "Answer with the letter of the correct option."
FORMAT_EVIDENCE = FORMAT + ' Then, on a new line, write "Evidence:" followed by the numbers of the passages that support your answer in square brackets.'
REASONING = "Think briefly about the question, then end your response with a final line containing exactly 'Answer: <LETTER>' (one letter, capital, no other text on that line)."
REASONING_EVIDENCE = "Think briefly about the question, then end your response with two final lines: 'Answer: <LETTER>' and 'Evidence: [n] [n]' (passage numbers in square brackets)."
IDK = "I do not have enough information to answer this question."
IDK_RULE = "If none of the options is correct or you do not have enough information to answer, choose "


def idk_letter(dataset: Column) -> Column:
    return F.when(dataset == "pubmedqa", "D").otherwise("E")


def idk_options(options: Column, dataset: Column) -> Column:
    """options with the answer "I don't know" under the next letter, in place of an option that has this letter."""
    letter = idk_letter(dataset)
    return F.map_concat(F.map_filter(options, lambda k, _: k != letter), F.create_map(letter, F.lit(IDK)))


def options_block(options: Column) -> Column:
    return F.array_join(F.transform(F.map_entries(options), lambda e: F.concat(e["key"], F.lit(". "), e["value"])), "\n")


def evidence_block(passages: Column, max_chars: int) -> Column:
    """passages: array of structs with title and text; each text's first max_chars characters."""
    line = lambda p, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] ("), p["title"], F.lit(") "), F.substring(p["text"], 1, max_chars))
    return F.array_join(F.transform(passages, line), "\n")


def prompt(question: Column, options: Column, dataset: Column, passages: Column | None = None, *, idk: bool = False, reasoning: bool = False, max_chars: int = 1200) -> Column:
    """A prompt with or without evidence, with or without an "I don't know" option, for models that reason or don't. An
    abstract is a single passage titled Abstract.
    """
    evidence = passages is not None
    parts = [F.lit(f"{HEAD} {USE_EVIDENCE}\n\nEvidence:\n"), evidence_block(passages, max_chars)] if evidence else [F.lit(HEAD)]
    parts += [F.lit("\n\nQuestion: "), question, F.lit("\nOptions:\n"), options_block(idk_options(options, dataset) if idk else options)]
    parts += [F.lit("\n\n" + (FORMAT_EVIDENCE if evidence else FORMAT))]
    if reasoning:
        parts += [F.lit("\n" + (REASONING_EVIDENCE if evidence else REASONING))]
    if idk:
        parts += [F.lit(" " + IDK_RULE), idk_letter(dataset), F.lit(".")]
    return F.concat(*parts)
