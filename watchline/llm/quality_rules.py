"""Quality rules as weak supervision.

Each rule votes that a document is good (1) or bad (-1) or abstains (0). Expectation-maximisation over the
counts of vote patterns estimates how often each rule is right in either class; the posterior probability of
a document's pattern then decides. There are at most 3^rules patterns, whatever the number of documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchline.llm.common import coded, covered, gram_hashes, inside, mixed, staged, steps, texts, word_hashes, words

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_upper", "n_marks", "n_lettered", "n_distinct"]


def repeated(hashes: np.ndarray, offsets: np.ndarray, width: int = 8) -> np.ndarray:
    """For each word, whether a run of ``width`` words found twice in its text covers it."""
    grams = gram_hashes(hashes, width)
    at = np.flatnonzero(inside(offsets, width)[: len(grams)])
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[at]
    key = mixed(grams[at] + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
    return covered(at[counts[inverse] > 1], width, len(hashes))


def counted(docs: DataFrame, id_type: str = "bigint") -> DataFrame:
    """``doc_id`` (of any type) and COUNTS of each row, over its whole text; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            column = texts(batch.column("text"))
            offsets, flat = words(column)
            codes, distinct = coded(flat)
            per_word = lambda flags: np.add.reduceat(np.append(flags.astype(np.int64), 0), offsets[:-1]) * (np.diff(offsets) > 0)
            hashes = word_hashes(distinct)[codes] if len(codes) else np.empty(0, np.uint64)
            known = pa.array(distinct, pa.string())
            count = lambda pattern: pc.count_substring_regex(known, pattern).to_numpy()[codes] if distinct else np.empty(0, np.int64)
            n_words = np.diff(offsets)
            word_chars = pc.utf8_length(known).to_numpy()[codes] if distinct else np.empty(0, np.int64)
            letters, upper = count(r"\p{L}"), count(r"\p{Lu}")
            n_lines, n_dup = [], []
            for text in column.to_pylist():
                lines = [line for line in text.split("\n") if line.strip(SPACES)]
                n_lines.append(len(lines))
                n_dup.append(len(lines) - len(set(lines)))
            owner = np.repeat(np.arange(batch.num_rows), n_words)
            n_distinct = np.bincount(np.unique(owner * max(1, len(distinct)) + codes) // max(1, len(distinct)), minlength=batch.num_rows)
            columns = [
                n_words, per_word(word_chars), per_word(count("[" + SYMBOLS + "]")), n_dup, per_word(repeated(hashes, offsets)),
                n_lines, per_word(letters), per_word(upper), per_word(count("!")), per_word(letters > 0), n_distinct,
            ]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in columns)], names=["doc_id", *COUNTS])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, " + ", ".join(f"{c} long" for c in COUNTS))


def vote(good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def rules() -> dict[str, Column]:
    """The rules' votes over COUNTS. Ratios of an empty text are null, on which a rule abstains."""
    c = F.col
    per_word = lambda name: c(name) / F.nullif(c("n_words"), F.lit(0))
    upper = c("n_upper") / F.nullif(c("n_letters"), F.lit(0))
    letters = c("n_letters") / F.nullif(c("word_chars"), F.lit(0))
    # Distinct words grow with a power of the words of a text; the power doesn't depend on the length.
    variety = F.log(c("n_distinct").cast("double")) / F.when(c("n_words") > 1, F.log(c("n_words").cast("double")))
    dup_lines = c("n_dup_lines") / F.when(c("n_lines") > 1, c("n_lines"))
    return {
        "length": vote(c("n_words") >= 50, c("n_words") < 20),
        "word_length": vote(per_word("word_chars").between(3, 10), (per_word("word_chars") < 2) | (per_word("word_chars") > 14)),
        "symbols": vote(per_word("n_symbols") <= 0.02, per_word("n_symbols") > 0.1),
        "case": vote(upper <= 0.15, upper > 0.3),
        "marks": vote(per_word("n_marks") <= 0.02, per_word("n_marks") > 0.1),
        "lines": vote(dup_lines <= 0.1, dup_lines > 0.3),
        "repeats": vote(per_word("n_repeat_words") <= 0.05, per_word("n_repeat_words") > 0.3),
        "letters": vote(letters >= 0.9, letters < 0.8),
        "lettered": vote(per_word("n_lettered") >= 0.9, per_word("n_lettered") < 0.7),
        "variety": vote(variety >= 0.8, variety < 0.7),
    }


def pattern(votes: dict[str, Column]) -> Column:
    """The votes as one number in base 3."""
    total: Column = F.lit(0)
    for v in votes.values():
        total = total * 3 + v + 1
    return total


def label_model(patterns: np.ndarray, counts: np.ndarray, n_rules: int, rounds: int = 60) -> np.ndarray:
    """Posterior probability of "good" for each pattern, by expectation-maximisation.

    Priors weigh a fiftieth of the documents, so that the fit is alike at every size: rules start out nearly
    always right about good documents, while each sees through a quarter of the bad ones, as a bad document
    breaks few rules. There are many kinds of bad documents, so that no rule is let see through over two in
    five: keeping one rule must not outweigh the breaking of another.
    """
    if not len(patterns):
        return np.empty(0)
    votes = np.stack([patterns // 3**i % 3 - 1 for i in range(n_rules)][::-1], 1)
    weight = counts / counts.sum()
    good_votes, bad_votes = votes > 0, votes < 0
    right_good, right_bad, share = np.full(n_rules, 0.995), np.full(n_rules, 0.25), 0.8
    prior = 0.02
    posterior = np.full(len(patterns), share)
    for _ in range(rounds):
        log_good = np.log(share) + good_votes @ np.log(right_good) + bad_votes @ np.log(1 - right_good)
        log_bad = np.log(1 - share) + good_votes @ np.log(1 - right_bad) + bad_votes @ np.log(right_bad)
        posterior = 1 / (1 + np.exp(np.clip(log_bad - log_good, -500, 500)))
        good, bad = weight * posterior, weight * (1 - posterior)
        right_good = (good @ good_votes + 0.995 * prior) / (good @ (good_votes | bad_votes) + prior)
        right_bad = (bad @ bad_votes + 0.25 * prior) / (bad @ (good_votes | bad_votes) + prior)
        right_good, right_bad = np.clip(right_good, 0.6, 0.998), np.clip(right_bad, 0.05, 0.4)
        share = np.clip((good.sum() + 0.8 * prior) / (1 + prior), 0.5, 0.98)
    return posterior


def quality(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``doc_id``, the base counts, ``base_failed``, ``posterior`` (probability of "good") and ``kept``.

    A document with fewer than 20 words, or with over 30 % of its words in repeated runs of 8, fails the base
    rules and is not kept; any other is kept if its posterior is at least ``threshold``. Null and empty texts
    have no words and so fail. Each row is judged on its own; repeated rows and null ids come back as they are.
    """
    votes = rules()
    base_failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    base = COUNTS[:5]
    rows = staged(counted(docs).select("doc_id", *base, base_failed.alias("base_failed"), pattern(votes).alias("pattern")))
    groups = rows.groupBy("pattern").agg(F.count("*").alias("n")).orderBy("pattern").collect()  # at most 3^rules rows
    patterns = np.array([g.pattern for g in groups], np.int64)
    posterior = label_model(patterns, np.array([g.n for g in groups], float), len(votes))
    scored = docs.sparkSession.createDataFrame([(int(p), float(q)) for p, q in zip(patterns, posterior, strict=True)], "pattern int, posterior double")
    return rows.join(F.broadcast(scored), "pattern").select(
        "doc_id", *base, "base_failed", (~F.col("base_failed") & (F.col("posterior") >= threshold)).alias("kept"), "posterior"
    )
