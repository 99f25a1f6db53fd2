"""The rule cascade that labels hidden text, as column expressions over pattern tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T

#: Labels by severity, and patterns searched in lower-cased text; the first of a list that is found counts.
SEVERITY = ("benign", "suspicious", "manipulation")
RISKS = ("clean", "suspicious", "manipulation")
ADDRESSING = (
    r"\b(note to|attention|dear|to) (any |the |all )?(ai |automated )?(classifier|scanner|detector)s?\b",
    r"\b(ai|llm|automated) (classifier|scanner|detector)s?\b",
    r"\bclassify (this|it|them|everything|all|me|as)\b",
    r"\blabel (this|it|them|everything|all|as)\b",
    r"\boutput (the )?label",
    r"\bmark (this|it) as\b",
    r"\b(this|it) is (benign|safe|harmless|not malicious)\b",
    r"\bnot (a )?prompt injection",
    r"\bignore (your|the) (instructions|rules|system)",
    r"</?\s*snippet",
    r"\bsystem\s*:",
)
INSTRUCTION = (
    r"ignore (all )?(previous|prior|above)",
    r"ignore all",
    r"disregard (all |the )?(previous|prior|above)",
    r"\byou are\b",
    r"as an ai",
    r"language model",
    r"\bllms?\b",
    r"\bai (screener|reviewer|assistant|model)",
    r"note to ai",
    r"\breviewers?\b",
    r"positive review",
    r"recommend accept",
    r"recommend(ing)? (this|the) (paper|candidate)",
    r"rate this",
    r"rank (them|this|him|her) (first|highest|top)",
    r"hire this candidate",
    r"best candidate",
    r"most qualified",
    r"highly qualified",
    r"do not mention",
    r"don't mention",
    r"system prompt",
    r"new instructions",
)
#: Every match of a list's patterns has one of these in it, so that the patterns are searched in few texts.
NEEDLES = {
    ADDRESSING: ("classifier", "scanner", "detector", "classify ", "label", "mark ", "is benign", "is safe", "is harmless", "is not malicious", "prompt injection", "ignore ", "snippet", "system"),
    INSTRUCTION: (
        "ignore ", "disregard ", "you are", "as an ai", "language model", "llm", "ai screener", "ai reviewer", "ai assistant", "ai model", "note to ai", "reviewer", "positive review", "recommend", "rate this",
        "rank ", "hire this", "best candidate", "qualified", "mention", "system prompt", "new instructions",
    ),
}
HINTS = ("alt text", "image of", "figure", "logo", "decorative", "page ", "header", "footer")
MAX_BENIGN_INVISIBLE, MAX_HINT_WORDS, MAX_SHORT_WORDS, MAX_DECODED = 5, 8, 2, 80
WHY_BENIGN_HINT = "Looks like an accessibility label or layout artifact."
WHY_SHORT = "Very short and non-instructional."
WHY_SUSPICIOUS = "Hidden content that a human reader would not see, but no explicit AI instructions detected."


def rank(label: Column) -> Column:
    """0 to 2 by severity; null for what is no label."""
    out = F.lit(None).cast("int")
    for i, name in enumerate(SEVERITY):
        out = F.when(label == name, F.lit(i)).otherwise(out)
    return out


def more_severe(a: Column, b: Column) -> Column:
    """The more severe of two labels; a when b is no label."""
    return F.when(rank(b) > rank(a), b).otherwise(a)


def risk(worst: Column) -> Column:
    """The name of the largest rank of a document; clean without any."""
    worst = F.coalesce(worst, F.lit(0))
    return F.element_at(F.array(*map(F.lit, RISKS)), worst + 1)


def may_match(lowered: Column, *lists: tuple[str, ...]) -> Column:
    """False for texts that no pattern of the lists matches, by plain search; null for null."""
    return reduce(lambda a, b: a | b, [F.contains(lowered, F.lit(n)) for p in lists for n in NEEDLES[p]])


def first_phrase(lowered: Column, patterns: tuple[str, ...]) -> Column:
    """What the first pattern of the list that is found matches; null if none is."""
    return F.when(may_match(lowered, patterns), first_match(lowered, patterns))


def first_match(lowered: Column, patterns: tuple[str, ...]) -> Column:
    return F.coalesce(*[F.when(lowered.rlike(f"(?U){p}"), F.regexp_extract(lowered, f"(?U){p}", 0)) for p in patterns])


def quoted(before: str, inner: Column, after: str = '").') -> Column:
    return F.concat(F.lit(before + '"'), inner, F.lit(after))


def text_cases(text: Column, technique: Column, addressed: Column | None = None, instructed: Column | None = None) -> list[tuple[Column, str, Column]]:
    """(condition, label, why), the first that holds counts: addressing the detector, instructing an AI, layout, short texts, the rest.

    addressed and instructed are the first phrases of the two lists; given as columns of their own they are searched once.
    """
    lowered = F.lower(text)
    addressed = first_phrase(lowered, ADDRESSING) if addressed is None else addressed
    instructed = first_phrase(lowered, INSTRUCTION) if instructed is None else instructed
    hint = F.lit(False)
    for h in HINTS:
        hint = hint | F.contains(lowered, F.lit(h))
    n = T.ascii_words(text)
    return [
        (addressed.isNotNull(), "manipulation", quoted("Hidden text addresses the classifier/scanner itself (matched ", addressed)),
        (instructed.isNotNull(), "manipulation", quoted("Contains AI-directed instruction language (matched ", instructed)),
        (hint & (n <= MAX_HINT_WORDS), "benign", F.lit(WHY_BENIGN_HINT)),
        ((n <= MAX_SHORT_WORDS) & (technique != "invisible_unicode"), "benign", F.lit(WHY_SHORT)),
        (F.lit(True), "suspicious", F.lit(WHY_SUSPICIOUS)),
    ]


def chosen(cases: list[tuple[Column, Column]]) -> Column:
    out = F.when(*cases[0])
    for condition, value in cases[1:]:
        out = out.when(condition, value)
    return out


def text_rule(text: Column, technique: Column) -> Column:
    """struct(label, why) by text_cases."""
    return chosen([(c, F.struct(F.lit(label).alias("label"), why.alias("why"))) for c, label, why in text_cases(text, technique)])


def text_label(text: Column, technique: Column) -> Column:
    return chosen([(c, F.lit(label)) for c, label, _ in text_cases(text, technique)])


def is_manipulation(text: Column) -> Column:
    """Whether either list of patterns finds something, without resolving which."""
    lowered = F.lower(text)
    return F.when(may_match(lowered, ADDRESSING, INSTRUCTION), lowered.rlike("(?U)" + "|".join(f"(?:{p})" for p in ADDRESSING + INSTRUCTION))).otherwise(F.when(text.isNotNull(), False))


def invisible_cases(decoded: Column, n: Column) -> list[tuple[Column, Column]]:
    """(condition, why) of manipulation, by a text's decoded tag message and its number of invisible characters."""
    why = F.concat(F.lit('Invisible tag characters encode hidden text ("'), F.substring(decoded, 1, MAX_DECODED), F.lit('").'))
    dense = F.concat(n.cast("string"), F.lit(f" invisible characters in one snippet (more than {MAX_BENIGN_INVISIBLE})."))
    return [(F.trim(decoded) != "", why), (n > MAX_BENIGN_INVISIBLE, dense)]


def invisible_rule(raw: Column) -> Column:
    """struct(label, why) of raw text with a hidden tag message or many invisible characters; else null."""
    return chosen([(c, F.struct(F.lit("manipulation").alias("label"), why.alias("why"))) for c, why in invisible_cases(T.decode_tags(raw), T.count_invisible(raw))])


def with_rule(flags: DataFrame) -> DataFrame:
    """flags (text, classify_text, technique) with rule_label and rule_why: the decoded text by the text rule, raised by the invisible rule on the flag's own text."""
    read = F.coalesce("classify_text", "text")
    found = {"_addressed": first_phrase(F.lower(read), ADDRESSING), "_instructed": first_phrase(F.lower(read), INSTRUCTION), "_decoded": T.decode_tags(F.col("text")), "_n": T.count_invisible(F.col("text"))}
    cases = text_cases(read, F.col("technique"), F.col("_addressed"), F.col("_instructed"))
    raised = [(c, "manipulation", why) for c, why in invisible_cases(F.col("_decoded"), F.col("_n"))]
    order = cases[:2] + raised + cases[2:]
    out = flags.withColumns(found)
    return out.withColumns({"rule_label": chosen([(c, F.lit(x)) for c, x, _ in order]), "rule_why": chosen([(c, why) for c, _, why in order])}).drop(*found)
