"""What has no built-in: NFKC and best-window similarity, as Arrow-batched UDFs; and the SQL names of all functions."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, IntegerType, StringType

from . import geometry, rules
from . import text as T


@pandas_udf(StringType())
def nfkc(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield batch.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


@pandas_udf(StringType())
def unicode_escape(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Everything outside printable ASCII as an escape, so that a table shows it."""
    for batch in texts:
        yield batch.map(lambda t: None if t is None else t.encode("unicode_escape").decode("ascii"))


def cache_key(text: Column) -> Column:
    """The key of a text. ASCII texts are in NFKC as they are: Python sees a null in their place."""
    other = F.when(F.octet_length(text) > F.char_length(text), text)
    return T.cache_key(F.coalesce(nfkc(other), text))


def common_subsequence(a: str, masks: dict[str, int], size: int) -> int:
    """Length of the longest common subsequence of a and the string of `size` characters that masks stand for, bit-parallel."""
    state = (1 << size) - 1
    for c in a:
        matched = state & masks.get(c, 0)
        state = (state + matched | state - matched) & ((1 << size) - 1)
    return size - state.bit_count()


def partial_ratio(a: str, b: str) -> float:
    """0 to 100: the best indel similarity of the shorter string with any window of the longer one, windows at the ends cut short."""
    short, long = sorted((a, b), key=len)
    if not short:
        return 100.0 if not long else 0.0
    masks: dict[str, int] = {}
    for i, c in enumerate(short):
        masks[c] = masks.get(c, 0) | 1 << i
    best = 0.0
    for end in range(1, len(long) + len(short)):
        window = long[max(0, end - len(short)) : end]
        if window and (window[0] in masks or window[-1] in masks):
            best = max(best, 200.0 * common_subsequence(window, masks, len(short)) / (len(short) + len(window)))
    return best


def reaches(word: str, text: str, least: float) -> bool:
    """Whether partial_ratio(word, text) is `least` or more, without looking into windows that can't be.

    A window has no longer subsequence in common than it has letters in common, order aside, which is counted while the window slides.
    """
    short, long = sorted((word, text), key=len)
    if not short:
        return not long or least <= 0
    masks: dict[str, int] = {}
    free: dict[str, int] = {}  # letters of the short string that the window does not use up; below zero: it has more of them
    for i, c in enumerate(short):
        masks[c] = masks.get(c, 0) | 1 << i
        free[c] = free.get(c, 0) + 1
    size, shared = len(short), 0
    for end in range(1, len(long) + size):
        if end <= len(long) and (c := long[end - 1]) in free:
            free[c] -= 1
            shared += free[c] >= 0
        if end > size and (c := long[end - size - 1]) in free:
            shared -= free[c] >= 0
            free[c] += 1
        start = max(0, end - size)
        total = size + min(end, len(long)) - start
        if 200.0 * shared / total >= least and 200.0 * common_subsequence(long[start:end], masks, size) / total >= least:
            return True
    return False


@pandas_udf(DoubleType())
def partial_ratio_udf(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in pairs:
        yield pd.Series([None if x is None or y is None else partial_ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def near_letters(words: Column, text: Column, least: float) -> Column:
    """The letters of the words whose best-window similarity with a text is at least so much, null without words; a pair that comes again in a batch is judged once."""

    @pandas_udf(IntegerType())
    def judged(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for listed, texts in pairs:
            known: dict[tuple[str, str], bool] = {}
            found = []
            for own, text in zip(listed, texts, strict=True):
                for w in () if own is None else own:
                    if (w, text) not in known:
                        known[w, text] = reaches(w, text, least)
                found.append(None if own is None else sum(len(w) for w in own if known[w, text]))
            yield pd.Series(found, dtype="object")

    return judged(words, text)


def raw(pattern: str) -> str:
    """A SQL literal of a pattern, in which a backslash is a backslash."""
    quote = '"' if "'" in pattern else "'"
    return f"r{quote}{pattern}{quote}"


def bodies() -> dict[str, tuple[str, str, str]]:
    """name -> (parameters, type, body) of the SQL functions: the expressions of `text`, `rules` and `geometry`, written as SQL."""
    invisible, tags = f"[{T.IN_INVISIBLE}{T.IN_TAGS}]", f"[{T.IN_TAGS}]"
    count = lambda text, pattern: f"regexp_count({text}, {raw(pattern)})"
    plain = "".join(map(chr, range(0x20, 0x7F))).replace("\\", "\\\\").replace("'", "\\'")
    hidden = "".join(chr(T.TAG_BASE + b) for b in range(0x20, 0x7F))
    decoded = lambda text: f"translate(regexp_replace({text}, {raw('[^' + chr(92) + 'x{E0020}-' + chr(92) + 'x{E007E}]')}, ''), '{hidden}', '{plain}')"
    shown, revealed = f"transform(regexp_extract_all(t, {raw(f'(?s){tags}+|[^{T.IN_TAGS}]+')}, 0), p -> CASE WHEN {count('p', tags)} > 0 THEN concat('⟦', char_length(p), ' TAG CHARS⟧') ELSE p END)", "t"
    shown = f"array_join({shown}, '')"
    for char, (_, mark) in T.INVISIBLE.items():
        shown = f"replace({shown}, '{char}', '⟦{T.code_point(char)}⟧')"
        revealed = f"replace({revealed}, '{char}', '⟦{mark}⟧')"
    kinds = [f"CASE WHEN contains(t, '{c}') THEN concat('{T.code_point(c)} x', {count('t', c)}) END" for c in sorted(T.INVISIBLE, key=T.code_point)]
    listed = f"array_compact(array({', '.join(kinds)}, CASE WHEN {count('t', tags)} > 0 THEN concat('tag chars x', {count('t', tags)}) END))"
    listed = f"CASE WHEN size({listed}) > 0 THEN array_join({listed}, ', ') ELSE 'none' END"
    message = f"CASE WHEN {decoded('t')} <> '' THEN concat('; decoded hidden tag-character text: \"', {decoded('t')}, '\"') ELSE '' END"
    found = lambda patterns: "(" + " OR ".join(f"lower(t) RLIKE {raw('(?U)' + p)}" for p in patterns) + ")"
    hint = "(" + " OR ".join(f"contains(lower(t), '{h}')" for h in rules.HINTS) + ")"
    words = count("t", "[a-zA-Z]{2,}")
    label = (
        f"CASE WHEN {found(rules.ADDRESSING)} OR {found(rules.INSTRUCTION)} THEN 'manipulation' WHEN {hint} AND {words} <= {rules.MAX_HINT_WORDS} THEN 'benign' "
        f"WHEN {words} <= {rules.MAX_SHORT_WORDS} AND technique <> 'invisible_unicode' THEN 'benign' ELSE 'suspicious' END"
    )
    channel = lambda c, k: f"((shiftright({c}, {k}) & 255) / 255D)"
    linear = lambda x: f"(CASE WHEN {x} <= {geometry.KNEE}D THEN {x} / 12.92D ELSE power(({x} + 0.055D) / 1.055D, {geometry.GAMMA}D) END)"
    luminance = lambda c: "(" + " + ".join(f"{w}D * {linear(channel(c, k))}" for w, k in ((0.2126, 16), (0.7152, 8), (0.0722, 0))) + ")"
    return {
        "invisible_count": ("t STRING", "INT", count("t", invisible)),
        "decode_tags": ("t STRING", "STRING", decoded("t")),
        "annotate_invisible": ("t STRING", "STRING", f"concat('[scanner note: ', {count('t', invisible)}, ' invisible characters (', {listed}, ')', {message}, ']\\n', {shown})"),
        "reveal_invisible": ("t STRING", "STRING", revealed),
        "normalize_text": ("t STRING", "STRING", f"regexp_replace(lower(t), {raw('[^' + chr(92) + 'p{L}' + chr(92) + 'p{N}]')}, '')"),
        "rule_label": ("t STRING, technique STRING", "STRING", label),
        "contrast_ratio": ("a INT, b INT", "DOUBLE", f"(greatest({luminance('a')}, {luminance('b')}) + 0.05D) / (least({luminance('a')}, {luminance('b')}) + 0.05D)"),
    }


def register(spark: SparkSession) -> None:
    """The functions under their SQL names; those without Python are temporary SQL functions, so calls stay built-in expressions."""
    spark.udf.register("nfkc", nfkc)
    spark.udf.register("partial_ratio", partial_ratio_udf)
    spark.udf.register("unicode_escape", unicode_escape)
    for name, (parameters, kind, body) in bodies().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
