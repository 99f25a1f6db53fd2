"""License scans: one Aho-Corasick pass for notice phrases and identifier tags, and licence expressions.

Texts are lower-cased (A-Z) and cut into words at ASCII punctuation, space and control characters; phrases match
where their words stand consecutively, overlaps included. After an identifier tag the rest of the line is read as
a licence expression: a shunting-yard parser orders and, or and with, and evaluation gives the licences named and how
freely the text may be used (and: the strictest part, or: the freest, with: the licence, eased by its exception).
A document's score is that of its strictest notice, 0 without any.

Cases: null and empty texts have no words, no places and empty labels; an expression that does not parse gives the
identifiers it names, joined by and; an identifier without a known name is a label of its own at UNKNOWN_FREEDOM; repeated rows and null doc_ids are rows like
others; other columns stay, but a column `license` is replaced; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from . import common

#: Phrases whose places count, and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Phrases that only give a label.
MORE = {
    "gnu lesser general public license": "lgpl", "gnu affero general public license": "agpl", "mozilla public license": "mpl",
    "bsd license": "bsd", "3 clause bsd": "bsd", "2 clause bsd": "bsd", "isc license": "isc", "creative commons attribution": "cc-by",
    "cc by nc": "cc-by-nc", "cc by nc sa": "cc-by-nc-sa", "cc by nc nd": "cc-by-nc-nd", "cc by sa": "cc-by-sa", "cc by nd": "cc-by-nd", "cc0": "cc0", "public domain": "public-domain",
    "all rights reserved": "proprietary", "unlicense": "unlicense", "eclipse public license": "epl",
}
TAG = "spdx license identifier"
TAG_LINE = re.compile(r"spdx-license-identifier[ \t]*:[ \t]*([^\r\n]*)")
#: How freely a text under the licence may be used.
FREEDOM = {
    "mit": 1.0, "isc": 1.0, "bsd": 1.0, "unlicense": 1.0, "cc0": 1.0, "public-domain": 1.0, "apache": 0.95, "cc-by": 0.9, "mpl": 0.7,
    "epl": 0.7, "lgpl": 0.6, "cc-by-sa": 0.6, "gpl": 0.4, "agpl": 0.3, "cc-by-nd": 0.3, "cc-by-nc": 0.2, "cc-by-nc-sa": 0.2, "cc-by-nc-nd": 0.15, "proprietary": 0.05,
}
UNKNOWN_FREEDOM = 0.5
EASED = 0.1
FAMILY = re.compile(r"(cc-by-nc-sa|cc-by-nc-nd|cc-by-nc|cc-by-sa|cc-by-nd|cc-by|cc0|apache|agpl|lgpl|gpl|mpl|epl|bsd|mit|isc|unlicense|zlib|wtfpl|bsl|0bsd|artistic|cddl|ofl|eupl|postgresql|ncsa)(?:-|\+|$)")
#: An identifier of a licence that has no public name.
OWN = "licenseref-"
BINDS = {"or": 1, "and": 2, "with": 3}
PIECE = re.compile(r"[()]|[a-z0-9][a-z0-9.+:\-]*")
#: Bytes of a text to words: separators to spaces, capitals to small letters.
TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else 32 if b < 48 or 58 <= b <= 96 or 123 <= b <= 127 else b for b in range(256))


def family(identifier: str) -> str:
    """The label of an identifier such as apache-2.0 or gpl-3.0-or-later; its own name if it is no known one."""
    m = FAMILY.match(identifier)
    return m[1] if m else identifier


def is_known(token: str) -> bool:
    return token.startswith(OWN) or FAMILY.match(token) is not None


def named(tokens: list[str]) -> list[str]:
    """The expression that the tokens begin with: operands and operators in turn, whatever the operands are called, so a licence without a known name stays.

    It ends where a token is out of turn. A word out of turn is prose, and so is an unknown last operand right before it, with its operator: "MIT and here is why" is MIT.
    An operator without an operand at the end is no part of it; what follows `with` is an exception, whatever its name.
    """
    end, depth, operand_next = len(tokens), 0, True
    for k, t in enumerate(tokens):
        if t == "(" and operand_next:
            depth += 1
        elif t == ")" and not operand_next and depth:
            depth -= 1
        elif operand_next and t not in BINDS and t not in "()":
            operand_next = False
        elif not operand_next and t in BINDS:
            operand_next = True
        else:
            end = k
            break
    cut = tokens[:end]
    prose = end < len(tokens) and tokens[end] not in BINDS and tokens[end] not in "()"
    if prose and cut and not operand_next and not is_known(cut[-1]) and cut[-1] != ")" and cut[-2:-1] != ["with"]:
        cut = cut[:-1]
    while cut and (cut[-1] in BINDS or cut[-1] == "("):
        cut = cut[:-1]
    return cut


def postfix(tokens: list[str]) -> list[str]:
    """Shunting-yard: operators wait on a stack until one that binds less, a parenthesis or the end comes."""
    out, waiting, operand_next = [], [], True
    for t in tokens:
        if t == "(" and operand_next:
            waiting.append(t)
        elif t == ")" and not operand_next:
            while waiting and waiting[-1] != "(":
                out.append(waiting.pop())
            if not waiting:
                raise ValueError("unmatched )")
            waiting.pop()
        elif t in BINDS and not operand_next:
            while waiting and waiting[-1] != "(" and BINDS[waiting[-1]] >= BINDS[t]:
                out.append(waiting.pop())
            waiting.append(t)
            operand_next = True
        elif t not in BINDS and t not in "()" and operand_next:
            out.append(t)
            operand_next = False
        else:
            raise ValueError(f"{t} is out of place")
    if operand_next or "(" in waiting:
        raise ValueError("incomplete")
    return out + waiting[::-1]


def evaluate(expression: str) -> tuple[set[str], float] | None:
    """(labels, freedom) of a lower-cased expression; None if it names no licence. One that can't be parsed counts as all that it names."""
    tokens = named([t.rstrip(".:") for t in PIECE.findall(expression)])
    names = [t for k, t in enumerate(tokens) if t not in BINDS and t not in "()" and (not k or tokens[k - 1] != "with")]
    if not names:
        return None
    try:
        stack: list[tuple[set[str], float]] = []
        for t in postfix(tokens):
            if t in BINDS:
                (right, b), (left, a) = stack.pop(), stack.pop()
                stack.append((left, min(1.0, a + EASED)) if t == "with" else (left | right, max(a, b) if t == "or" else min(a, b)))
            else:
                stack.append(({family(t)}, FREEDOM.get(family(t), UNKNOWN_FREEDOM)))
        return stack[0]
    except ValueError:
        return {family(t) for t in names}, min(FREEDOM.get(family(t), UNKNOWN_FREEDOM) for t in names)


def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for phrase in [*BASE, *MORE, TAG]:
        a.add_word(f" {phrase} ", phrase)
    a.make_automaton()
    return a


def scan(text: bytes | None, machine: ahocorasick.Automaton) -> dict:
    words = (text or b"").translate(TO_WORDS).split()
    line = f" {b' '.join(words).decode('latin-1')} "
    starts, base, found, tagged, seen, upto = [], set(), {}, False, 0, 0
    for end, phrase in machine.iter(line):
        if phrase == TAG:
            tagged = True
        elif phrase in BASE:
            start = end - len(phrase) - 1
            seen += line.count(" ", upto, start) if start >= upto else -line.count(" ", start, upto)
            upto = start
            starts.append(seen)
            base.add(BASE[phrase])
        else:
            found[MORE[phrase]] = FREEDOM[MORE[phrase]]
    found |= {x: FREEDOM[x] for x in base}
    notices = list(found.values())
    labels = set(found)
    if tagged:
        for m in TAG_LINE.finditer(text.decode("utf-8", "replace").lower()):
            if value := evaluate(m[1]):
                labels |= value[0]
                notices.append(value[1])
    join = lambda x: ",".join(sorted(x))
    return {"n_words": len(words), "n_base": len(starts), "first_word": min(starts, default=None), "last_word": max(starts, default=None), "base_labels": join(base), "labels": join(labels), "score": min(notices, default=0.0)}


KIND = T.StructType(
    [T.StructField(c, T.LongType()) for c in ("n_words", "n_base", "first_word", "last_word")] + [T.StructField("base_labels", T.StringType()), T.StructField("labels", T.StringType()), T.StructField("score", T.DoubleType())]
)


@pandas_udf(KIND)
def scan_texts(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    machine = automaton()
    for batch in batches:
        rows = pd.DataFrame([scan(x, machine) for x in batch], columns=[f.name for f in KIND.fields])
        yield rows.astype({c: "Int64" for c in ("n_words", "n_base", "first_word", "last_word")})


def scan_licenses(docs: DataFrame) -> DataFrame:
    """docs with the struct column `license`."""
    return docs.withColumn("license", scan_texts(F.col("text").cast("binary")))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(common.table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "license.*")
