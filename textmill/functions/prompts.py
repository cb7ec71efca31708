"""Prompts and labels of the benchmark families. Fields that a table lacks are taken as empty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.functions.text import first_text, strip

# The prompts' texts; the names of fields and their order in the functions below are fixed too.
EXAM = "You are a medical exam assistant. Choose A, B, C, or D and justify briefly.\n"
LETTER = "Answer (just the letter): "
YES_NO = "You are a medical QA assistant. Answer yes/no/maybe.\n"
NLI = "You are a clinical NLI assistant. Predict entailment, contradiction, or neutral.\n"


def first_of(df: DataFrame, *names: str) -> Column:
    """The first of the named fields that the table has and that isn't empty; lists are joined by line feeds."""
    return first_text(df, *names)


def raw_answer(df: DataFrame, *names: str) -> Column:
    """The first of the named fields that isn't null, stripped and in capitals."""
    have = [F.col(n).cast("string") for n in names if n in df.columns]
    return F.upper(strip(F.coalesce(*have, F.lit(""))))


def letter_of(answer: Column, options: list[Column] | None = None) -> Column:
    """A letter, an index from 0 (4 counts from 1), or the text of one of the options; else empty."""
    index = answer.try_cast("int")
    out = F.when(answer.isin("A", "B", "C", "D"), answer).when(index.between(0, 3), F.get(F.array(*map(F.lit, "ABCD")), index)).when(index == 4, "D")
    if options is None:
        return out.otherwise("")
    plain = lambda x: strip(F.regexp_replace(F.regexp_replace(F.lower(strip(x)), r"[. ]+$", ""), r"\s+", " "))
    for letter, option in zip("ABCD", options, strict=True):
        out = out.when((plain(option) != "") & (plain(option) == plain(answer)), letter)
    return out.otherwise("")


def exam_prompt(question: Column, options: list[Column]) -> Column:
    parts = [F.concat(F.lit(f"{letter}) "), option, F.lit("\n")) for letter, option in zip("ABCD", options, strict=True)]
    return F.concat(F.lit(f"{EXAM}Question: "), question, F.lit("\n"), *parts, F.lit(LETTER))


def option_fields(df: DataFrame, with_op: bool = False) -> list[Column]:
    return [first_of(df, letter.upper(), f"option_{letter}", *([f"op{letter}"] if with_op else []), f"ending{i}") for i, letter in enumerate("abcd")]


def medqa(df: DataFrame) -> DataFrame:
    options = option_fields(df)
    question = first_of(df, "question", "question_text", "sent1")
    return df.withColumns({"prompt": exam_prompt(question, options), "gold": letter_of(raw_answer(df, "answer", "label", "answer_idx"), options)})


def medmcqa(df: DataFrame) -> DataFrame:
    question = first_of(df, "question", "question_text", "sent1")
    return df.withColumns({"prompt": exam_prompt(question, option_fields(df, True)), "gold": letter_of(raw_answer(df, "answer", "label", "answer_idx"))})


def mmlu(df: DataFrame) -> DataFrame:
    """A list of four choices or more is preferred to single fields."""
    options = option_fields(df)
    if "choices" in df.columns:
        options = [F.when(F.size("choices") >= 4, F.coalesce(F.get("choices", F.lit(i)).cast("string"), F.lit(""))).otherwise(o) for i, o in enumerate(options)]
    return df.withColumns({"prompt": exam_prompt(first_of(df, "question", "question_text"), options), "gold": letter_of(raw_answer(df, "answer", "label"))})


def pubmedqa(df: DataFrame) -> DataFrame:
    context, question = first_of(df, "context", "long_answer"), first_of(df, "question", "question_concept")
    prompt = F.concat(F.lit(f"{YES_NO}Context:\n"), context, F.lit("\n\nQuestion: "), question, F.lit("\nAnswer: "))
    return df.withColumns({"prompt": prompt, "gold": F.lower(strip(first_of(df, "final_decision", "answer")))})


def mednli(df: DataFrame) -> DataFrame:
    prompt = F.concat(F.lit(f"{NLI}Premise: "), first_of(df, "premise"), F.lit("\nHypothesis: "), first_of(df, "hypothesis"), F.lit("\nLabel: "))
    return df.withColumns({"prompt": prompt, "gold": F.lower(strip(first_of(df, "label", "gold_label")))})


def ner(df: DataFrame, entity_type: str = "Disease") -> DataFrame:
    text = first_of(df, "text", "document", "passages", "context", "abstract", "sentence")
    return df.withColumn("prompt", F.concat(F.lit(f"Extract all {entity_type} entities from the text. One per line, no bullets, exact surface forms.\nText: "), text, F.lit("\nEntities:\n")))


def ner_gold(entities: Column) -> Column:
    """Texts of an array of structs whose text is an array of strings, each joined by spaces."""
    return F.filter(F.transform(F.coalesce(entities, F.array()), lambda e: F.array_join(e.getField("text"), " ")), lambda t: t != "")


def subjects(df: DataFrame, wanted: list[str]) -> DataFrame:
    return df.where(F.lower("subject").isin([w.lower() for w in wanted]))
