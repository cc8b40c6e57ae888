"""Prompts as arrays of (type, text, image_url) blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import OPTIONS, first_non_blank

BLOCK = "array<struct<type:string,text:string,image_url:string>>"

# Instruction texts.
SHORT_ANSWER = (
    "Answer the question using a short, direct answer. "
    "Use as few words as possible (prefer 1-10 words). "
    "Do NOT provide reasoning, steps, or explanations. "
    "Do NOT add extra commentary. "
)
SYSTEM = {
    "open_general": "You are a question answering model. " + SHORT_ANSWER + "If the question is about relation between image and medical concept, ",
    "open_medical_kg": "You are a medical visual question answering model. " + SHORT_ANSWER + "If the question is answering about relation between image and medical concept, then only three relations are possible: Positive, Negative, and Uncertain.",
    "open_medical": "You are a medical visual question answering model. " + SHORT_ANSWER,
    "closed_medical": "You are a medical visual question answering model. You MUST answer using exactly one character: '1' if the correct answer is yes/true, or '0' if the correct answer is no/false. No words, no punctuation, no explanation.",
    "fact": "You are a fact-based visual question answering model.You MUST answer with a short phrase, and nothing else.No punctuation, no explanation.",
}
EVIDENCE = {
    "G": "You can use the following knowledge-graph triples as evidence to solve the question. Images in the triplets (if present) are related/similar to the query image.",
    "M": "You can use the following knowledge-graph triples as evidence to solve the following question. Images provided in the triplets are those similar to the image in the question.",
    "legacy": "You can use the following knowledge-graph triples as evidence to solve the following question",
}
IMAGE_FIRST = "Now, given an image, please answer the question."
ANALOGY = (
    "You are solving a knowledge-graph analogy with one exemplar and one question.\n"
    "Interpret (T) as text-only, (I) as image-only.\n"
    "You have to infer the relation hinted by the exemplar to get the relation between question and answer"
)
TEST_LEAD = "Now, please answer the question."


def text_block(text: Column) -> Column:
    return F.struct(F.lit("input_text").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("image_url"))


def image_block(url: Column) -> Column:
    return F.struct(F.lit("input_image").alias("type"), F.lit(None).cast("string").alias("text"), url.alias("image_url"))


def _with_image(url: Column) -> Column:
    return F.when(url.isNotNull(), F.array(image_block(url))).otherwise(F.array().cast(BLOCK))


def qa_blocks(question: Column, url: Column, kind: str) -> Column:
    """User blocks of a question; the system text is ``SYSTEM[kind]``."""
    asked = F.concat(F.lit("Question: "), question)
    if kind in ("open_general", "open_medical_kg"):
        return F.concat(_with_image(url), F.array(text_block(F.concat(asked, F.lit("\nAnswer concisely.")))))
    if kind == "closed_medical":
        return F.concat(_with_image(url), F.array(text_block(F.concat(asked, F.lit("\nAnswer with 1 for yes/true or 0 for no/false.")))))
    if kind in ("open_medical", "fact"):
        tail = F.lit("\nAnswer concisely." if kind == "open_medical" else "")
        return F.concat(F.array(text_block(F.lit(IMAGE_FIRST)), image_block(url), text_block(F.concat(asked, tail))))
    raise ValueError(f"unknown kind {kind}")


def triplet_line(no: Column, head: Column, relation: Column, tail: Column) -> Column:
    return F.format_string("Triplet %d: (head, relation, tail) = (%s, %s, %s)", no, head, relation, tail)


def evidence_fields(family: str) -> dict[str, Column]:
    """Names of a triplet's parts as each family prints them, from the usual corpus columns."""
    head, tail = first_non_blank(F.col("head_text"), F.col("head_id")), first_non_blank(F.col("tail_text"), F.col("tail_id"))
    relation = first_non_blank(F.col("rel_text"), F.col("rel_id"))
    if family == "M":
        return {"head": F.when(F.startswith(head, F.lit("Image")), "Image").otherwise(head), "relation": first_non_blank(F.col("rel_id")), "tail": tail}
    if family == "legacy":
        return {"head": F.coalesce("head_text", F.lit("")), "relation": F.coalesce("rel_text", F.lit("")), "tail": F.coalesce("tail_text", F.lit(""))}
    return {"head": head, "relation": relation, "tail": tail}


def evidence(ranked: DataFrame, corpus: DataFrame, family: str = "G", images: tuple[str, ...] = ()) -> DataFrame:
    """``qid`` and ``evidence`` blocks of its ranked triplets (few a query: the caller's top k).

    ``images`` names columns ``head_url`` and ``tail_url`` to attach after their
    triplet, each under its caption line.
    """
    rows = ranked.select("qid", "doc_id", "rank").join(corpus, "doc_id")
    f = evidence_fields(family)
    blocks = F.array(text_block(triplet_line(F.col("rank"), f["head"], f["relation"], f["tail"])))
    for side in images:
        url = F.col(f"{side}_url")
        label = F.concat(F.lit(f"Image for {side} of triplet "), F.col("rank").cast("string"))
        blocks = F.concat(blocks, F.when(url.isNotNull(), F.array(text_block(label), image_block(url))).otherwise(F.array().cast(BLOCK)))
    grouped = rows.select("qid", "rank", blocks.alias("b")).groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("rank", "b"))).alias("l"))
    return grouped.select("qid", F.concat(F.array(text_block(F.lit(EVIDENCE[family]))), F.flatten(F.transform("l", lambda x: x["b"]))).alias("evidence"))


def prepend(evidence_blocks: Column, user_blocks: Column, as_text: bool = False) -> Column:
    """Evidence before the question: as blocks, or both flattened into one text block."""
    blocks = F.concat(F.coalesce(evidence_blocks, F.array().cast(BLOCK)), user_blocks)
    return F.array(text_block(flat(blocks))) if as_text else blocks


def flat(blocks: Column) -> Column:
    """One string: texts and image addresses by line."""
    return F.array_join(F.transform(blocks, lambda b: F.coalesce(b["text"], b["image_url"])), "\n")


def analogy_blocks(mode: Column, head: dict[str, Column], tail: dict[str, Column], question: dict[str, Column], strict: bool = False) -> Column:
    """Exemplar and question by mode; each part is a dict of ``text`` and ``url``.

    A prompt whose image is missing is null, or raises if ``strict``.
    """
    lead, t, i = text_block(F.lit(ANALOGY)), lambda *p: text_block(F.concat(*p)), image_block
    two_texts = F.array(lead, t(F.lit("Exemplar (T1, T2): head = "), head["text"], F.lit(" and tail = "), tail["text"]), t(F.lit("Question (I1, ?): head = ")), i(question["url"]), t(F.lit(" and tail = ?")))
    two_images = F.array(lead, t(F.lit("Exemplar (T1, T2): head = ")), i(head["url"]), t(F.lit(" and tail = ")), i(tail["url"]), t(F.lit("Question (T1, ?): head= "), question["text"], F.lit(" and tail = ?")))
    mixed = F.array(lead, t(F.lit("Exemplar (T1, T2): head = ")), i(head["url"]), t(F.lit(" and tail = "), tail["text"]), t(F.lit("Question (I2, ?): head = ")), i(question["url"]), t(F.lit(" and  tail = ?")))
    there = F.when(mode == 0, question["url"].isNotNull()).when(mode == 1, head["url"].isNotNull() & tail["url"].isNotNull()).otherwise(head["url"].isNotNull() & question["url"].isNotNull())
    blocks = F.when(mode == 0, two_texts).when(mode == 1, two_images).otherwise(mixed)
    return F.when(there, blocks).otherwise(F.raise_error(F.lit("an image of the analogy is missing")) if strict else F.lit(None).cast(BLOCK))


# Parts of a multiple-choice prompt. Inputs by letter; outputs by letter after the dash
# (in the two-letter outputs L prints the solution and E the lecture).
_INPUTS = {
    "CQM": ["C", "Q", "M"], "QCM": ["Q", "C", "M"], "QCML": ["Q", "C", "M", "L"], "QCME": ["Q", "C", "M", "E"],
    "QCMLE": ["Q", "C", "M", "LE"], "QCLM": ["Q", "C", "L", "M"], "QCEM": ["Q", "C", "E", "M"], "QCLEM": ["Q", "C", "LE", "M"],
}
_OUTPUTS = {"A": [], "AL": ["solution"], "AE": ["lecture"], "ALE": ["lecture", "solution"], "AEL": ["solution", "lecture"], "LA": ["lecture"], "EA": ["solution"], "LEA": ["lecture", "solution"], "ELA": ["solution", "lecture"]}


# The formats on offer, and the most examples before a question.
FORMATS = (
    "CQM-A", "CQM-LA", "CQM-EA", "CQM-LEA", "CQM-ELA", "CQM-AL", "CQM-AE", "CQM-ALE", "QCM-A", "QCM-LA", "QCM-EA", "QCM-LEA", "QCM-ELA", "QCM-AL", "QCM-AE", "QCM-ALE",
    "QCML-A", "QCME-A", "QCMLE-A", "QCLM-A", "QCEM-A", "QCLEM-A", "QCML-AE",
)
MOST_SHOTS = 32


def choice_example(fmt: str, test: bool, options: tuple[str, ...] = OPTIONS, use_caption: bool = False) -> Column:
    """One multiple-choice example from columns question, choices, answer, hint, lecture, solution (and caption)."""
    kind_in, kind_out = fmt.split("-")
    if kind_in not in _INPUTS or kind_out not in _OUTPUTS:
        raise ValueError(f"unknown format {fmt}")
    hint, caption = F.coalesce("hint", F.lit("")), F.coalesce("caption", F.lit("")) if use_caption else F.lit("")
    context = F.trim(F.concat(hint, F.lit(" "), caption))
    escaped = {c: F.replace(F.coalesce(c, F.lit("")), F.lit("\n"), F.lit("\\n")) for c in ("lecture", "solution")}
    letters = F.array(*map(F.lit, options))
    choices = F.array_join(F.transform("choices", lambda c, i: F.concat(F.lit("("), F.get(letters, i), F.lit(") "), c)), " ")
    because = lambda *names: F.concat(F.lit("BECAUSE: "), F.concat_ws(" ", *[escaped[n] for n in names]))
    lines = {
        "C": F.concat(F.lit("Context: "), F.when(context == "", "N/A").otherwise(context)),
        "Q": F.concat(F.lit("Question: "), F.col("question")),
        "M": F.concat(F.lit("Options: "), choices),
        "L": because("lecture"), "E": because("solution"), "LE": because("lecture", "solution"),
    }
    body = F.concat(*[F.concat(lines[x], F.lit("\n")) for x in _INPUTS[kind_in]])
    answer = F.concat(F.lit("The answer is "), F.get(letters, F.col("answer")), F.lit("."))
    reason = F.concat_ws(" ", *[escaped[n] for n in _OUTPUTS[kind_out]])
    if test:
        body, out = F.concat(F.lit(TEST_LEAD), body), F.lit("Answer:")
    elif kind_out == "A":
        out = F.concat(F.lit("Answer: "), answer)
    elif kind_out.startswith("A"):
        out = F.concat(F.lit("Answer: "), answer, F.lit(" BECAUSE: "), reason)
    else:
        out = F.concat(F.lit("Answer: "), reason, F.lit(" "), answer)
    text = F.trim(F.replace(F.concat(body, out), F.lit("  "), F.lit(" ")))
    return F.when(F.endswith(text, F.lit("BECAUSE:")), F.trim(F.replace(text, F.lit("BECAUSE:"), F.lit("")))).otherwise(text)


def few_shot(problems: DataFrame, shots: DataFrame, fmt: str, **options) -> DataFrame:
    """``pid`` and ``prompt``: the shot examples (in order ``pos``), then the test example; more than ``MOST_SHOTS`` shots raise."""
    if shots.limit(MOST_SHOTS + 1).count() > MOST_SHOTS:
        raise ValueError(f"at most {MOST_SHOTS} shots go into a prompt")
    shown = shots.select("pos", choice_example(fmt, False, **options).alias("e"))
    joined = shown.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "e"))), lambda x: x["e"]), "\n\n").alias("_shots"))
    test = problems.select("pid", choice_example(fmt, True, **options).alias("_test"))
    return test.crossJoin(F.broadcast(joined)).select("pid", F.concat_ws("\n\n", F.when(F.col("_shots") != "", F.col("_shots")), "_test").alias("prompt"))
