"""Quality rules as a ledger of failure bits.

Every rule is evaluated once per document; the ledger keeps its measurements and one long in
which bit k says that rule k failed. A policy is a versioned mask over those bits, so verdicts
of any version, and ablations of it, are bit arithmetic over the stored ledger and never touch
the text again. Only built-in functions: one scan, no shuffle.

Defined cases: a null text has no words, lines or symbols (all measurements 0); an empty text
likewise; repeated rows are judged one by one; other columns of the input are kept, except
those with a name of the ledger's own columns, which the ledger's replace.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPACE = " \t\n\x0b\x0c\r"
SPACES = "[ \\t\\n\\x0B\\f\\r]+"
SYMBOLS = "[#*$%&|<>]"
NOT_LETTERS = "[^\\p{L}]+"

MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_blocked",
    "n_repeated_stems",
)


@dataclass(frozen=True)
class Rule:
    name: str
    fails: str  # SQL over the measurements, in whole numbers


# Bit k of the ledger belongs to RULES[k]; new rules are appended, never inserted.
RULES: tuple[Rule, ...] = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 14 * n_words"),
    Rule("symbols", "100 * n_symbols > 10 * n_words"),
    Rule("duplicate_lines", "100 * n_dup_lines > 50 * n_lines"),
    Rule("blocked_stems", "n_blocked > 0"),
    Rule("repeated_stems", "n_repeated_stems > 0"),
)
BASE_RULES = ("few_words", "repeated_windows")
V1_RULES = (*BASE_RULES, "short_words", "long_words", "symbols", "duplicate_lines")
POLICIES: dict[str, tuple[str, ...]] = {
    "base": BASE_RULES,
    "v1": V1_RULES,
    "v2": (*V1_RULES, "blocked_stems"),
    "v3": (*V1_RULES, "blocked_stems", "repeated_stems"),
}
Repeated = Mapping[str, Sequence[tuple[str, int]]]  # per language stems and how many words must begin with one


def mask_of(names: Sequence[str], rules: Sequence[Rule] = RULES) -> int:
    at = {rule.name: k for k, rule in enumerate(rules)}
    return sum(1 << at[name] for name in names)


def measured(docs: DataFrame, blocked: Sequence[str] = (), text: str = "text", repeated: Repeated | None = None) -> DataFrame:
    """``docs`` with the measurements of MEASURES (long). ``repeated`` needs a column ``lang``."""
    body = F.coalesce(F.col(text), F.lit(""))
    docs = docs.drop(*MEASURES).withColumns(
        {
            "_words": F.when(F.btrim(body, F.lit(SPACE)) == "", F.array().cast("array<string>")).otherwise(
                F.split(F.btrim(body, F.lit(SPACE)), SPACES)
            ),
            "_lines": F.filter(F.split(body, "\n"), lambda line: F.btrim(line, F.lit(SPACE)) != ""),
            "n_symbols": F.regexp_count(body, F.lit(SYMBOLS)).cast("long"),
            "n_blocked": _blocked(body, blocked),
            "n_repeated_stems": _repeated(body, repeated or {}),
        }
    )
    docs = docs.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            # The 3-word windows as (64-bit hash, position), equal windows side by side.
            "_windows": F.expr(
                "if(size(_words) < 3, array(), sort_array(transform(sequence(0, size(_words) - 3), i -> "
                "struct(xxhash64(_words[i], _words[i + 1], _words[i + 2]) as h, i as i))))"
            ),
        }
    )
    docs = docs.withColumn(
        "_again",
        F.expr(
            "sort_array(transform(filter(_windows, (x, j) -> "
            "(j > 0 and _windows[j - 1].h = x.h) or (j + 1 < size(_windows) and _windows[j + 1].h = x.h)), x -> x.i))"
        ),
    )
    # Each repeated window covers 3 words, or fewer up to the start of the next one.
    return docs.withColumn(
        "n_repeat_words",
        F.expr(
            "aggregate(transform(_again, (p, j) -> if(j + 1 < size(_again), least(3, _again[j + 1] - p), 3)), "
            "0L, (s, n) -> s + n)"
        ),
    ).drop("_words", "_lines", "_windows", "_again")


def _blocked(body: Column, stems: Sequence[str]) -> Column:
    """1 where a word of the text begins with a blocked stem, whatever its case."""
    if not stems:
        return F.lit(0).cast("long")
    pattern = "(?iu)(?<!\\p{L})(?:" + "|".join(re.escape(s) for s in sorted(stems)) + ")"
    return body.rlike(pattern).cast("long")


def _repeated(body: Column, stems: Repeated) -> Column:
    """Stems of the text's language with which as many of its words begin as the list says."""

    def met(own: Sequence[tuple[str, int]]) -> Column:
        longest = sorted((s for s, _ in own), key=lambda s: (-len(s), s))
        hits = F.regexp_extract_all(F.lower(body), F.lit("(?<!\\p{L})(?:" + "|".join(map(re.escape, longest)) + ")"), F.lit(0))
        asked = F.array(*[F.struct(F.lit(s).alias("stem"), F.lit(k).alias("least")) for s, k in own])

        def enough(found: Column) -> Column:
            return F.size(F.filter(asked, lambda a: F.size(F.filter(found, lambda w: F.startswith(w, a["stem"]))) >= a["least"]))

        return F.transform(F.array(hits), enough)[0].cast("long")  # within a transform the text is searched once

    out = F.lit(0).cast("long")
    for lang, own in sorted(stems.items()):
        out = F.when(F.coalesce("lang", F.lit("")) == lang, met(own)).otherwise(out)
    return out


def ledger(
    docs: DataFrame,
    blocked: Sequence[str] = (),
    rules: Sequence[Rule] = RULES,
    text: str = "text",
    repeated: Repeated | None = None,
) -> DataFrame:
    """Measurements and ``failures``, the bitmask of failed rules, of every document.

    The ledger's size and the rules that failed anywhere are observed as it is written. That also
    keeps filters on verdicts above the measurements: pushed below, they would evaluate these again
    for every rule and every word.
    """
    bits = [F.when(F.expr(rule.fails), F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, rule in enumerate(rules)]
    failures = bits[0]
    for bit in bits[1:]:
        failures = failures.bitwiseOR(bit)
    rows = measured(docs, blocked, text, repeated).withColumn("failures", failures)
    return rows.observe(f"ledger-{uuid.uuid4().hex}", F.count(F.lit(1)).alias("rows"), F.bit_or("failures").alias("failed"))


def verdict(policy: str, failures: str = "failures", policies: Mapping[str, Sequence[str]] = POLICIES) -> Column:
    """True where no rule of the policy failed."""
    return F.col(failures).bitwiseAND(F.lit(mask_of(policies[policy])).cast("long")) == 0


def ablations(rows: DataFrame, policy: str, policies: Mapping[str, Sequence[str]] = POLICIES) -> DataFrame:
    """Per rule of a policy, over a ledger: documents it fails, documents only it fails (kept
    once it is dropped), and the rules that failed together with it somewhere (bits)."""
    mask = F.lit(mask_of(policies[policy])).cast("long")
    rows = rows.select(F.col("failures").bitwiseAND(mask).alias("bits")).groupBy("bits").agg(F.count(F.lit(1)).alias("n"))
    names = F.array(*[F.struct(F.lit(mask_of([n])).cast("long").alias("bit"), F.lit(n).alias("rule")) for n in policies[policy]])
    failed = rows.select("bits", "n", F.explode(names).alias("r")).filter(F.col("bits").bitwiseAND(F.col("r.bit")) != 0)
    return failed.groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum("n").alias("failed"),
        F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("failed_alone"),
        F.bit_or("bits").alias("failed_with"),
    )


def blocked_stems(
    docs: DataFrame,
    labels: DataFrame,
    max_rows: int = 5000,
    max_stems: int = 200,
    share: float = 0.98,
    support: float = 0.05,
) -> list[str]:
    """Stems of a block list learned from the labelled documents: beginnings of 4 to 6 letters
    of words, found in at least ``support`` of the toxic documents, with at least ``share`` of
    their documents toxic. Of nested stems the shortest is kept.

    Fitted on at most ``max_rows`` labelled documents (the smallest MD5 of doc_id), so what
    reaches the driver is at most ``max_stems`` words. Without toxic labels: no stems.
    """
    some = (
        labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        .orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(max_rows)
    )
    rows = docs.select("doc_id", F.col("text").alias("_text")).join(F.broadcast(some), "doc_id")  # max_rows rows
    words = F.filter(F.array_distinct(F.split(F.lower("_text"), NOT_LETTERS)), lambda w: F.length(w) >= 4)
    stems = F.array_distinct(F.flatten(F.transform(words, lambda w: F.array(*[F.substring(w, 1, k) for k in (4, 5, 6)]))))
    toxic = some.agg(F.coalesce(F.sum("toxic"), F.lit(0))).first()[0]
    found = (
        rows.select("toxic", F.explode(stems).alias("stem"))
        .groupBy("stem").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("hits"))
        .filter((F.col("hits") >= max(3, support * toxic)) & (F.col("hits") >= share * F.col("n")))
        .orderBy(F.desc("hits"), "stem").limit(max_stems)
    )
    stems = {row.stem for row in found.select("stem").collect()}
    return sorted(s for s in stems if not any(s != t and s.startswith(t) for t in stems))


def repeated_stems(
    docs: DataFrame,
    labels: DataFrame,
    max_rows: int = 5000,
    max_stems: int = 200,
    share: float = 0.9,
    support: float = 0.2,
    most: int = 3,
) -> dict[str, list[tuple[str, int]]]:
    """Per language (column ``lang``) weaker stems than those of ``blocked_stems``, each with the
    least number of words, up to ``most``, that must begin with it: so many begin with it in at
    least ``support`` of the language's toxic documents, and ``share`` of all documents with so many
    are toxic. Of nested stems the shortest is kept, unless it asks for more words.

    Fitted like ``blocked_stems``; at most ``max_stems`` a language. Without toxic labels: none.
    """
    some = (
        labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        .orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(max_rows)
    )
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), F.col("text").alias("_text"))
    rows = rows.join(F.broadcast(some), "doc_id").withColumn("_row", F.monotonically_increasing_id())  # max_rows rows
    words = F.filter(F.split(F.lower("_text"), NOT_LETTERS), lambda w: F.length(w) >= 4)
    stems = F.flatten(F.transform(words, lambda w: F.filter(F.array(*[F.substring(w, 1, k) for k in (4, 5, 6)]), lambda s: F.length(s) <= F.length(w))))
    toxic = rows.groupBy("lang").agg(F.sum("toxic").alias("every")).filter("every > 0")
    counted = rows.select("_row", "lang", "toxic", F.explode(stems).alias("stem")).groupBy("_row", "lang", "toxic", "stem").agg(F.count(F.lit(1)).alias("k"))
    found = (
        counted.withColumn("least", F.explode(F.sequence(F.lit(1), F.least("k", F.lit(most)).cast("int"))))
        .groupBy("lang", "stem", "least").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("hits"))
        .join(toxic, "lang").filter((F.col("hits") >= F.greatest(F.lit(3), support * F.col("every"))) & (F.col("hits") >= share * F.col("n")))
        .groupBy("lang", "stem").agg(F.min(F.struct("least", "hits")).alias("q")).select("lang", "stem", "q.*")
        .withColumn("_place", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("hits"), "stem"))).filter(F.col("_place") <= max_stems)
    )
    lists: dict[str, dict[str, int]] = {}
    for r in found.select("lang", "stem", "least").collect():
        lists.setdefault(r.lang, {})[r.stem] = r.least
    return {
        lang: sorted((s, k) for s, k in own.items() if not any(s != t and s.startswith(t) and least <= k for t, least in own.items()))
        for lang, own in lists.items()
    }
