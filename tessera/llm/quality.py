"""Document quality by weak supervision.

Nine rules look at statistics of the whole text and vote good, bad or abstain.
Expectation-maximisation over the counts of all vote patterns (at most 3^9,
summed over every document that passes the base check) estimates how often
each rule votes and is right in either class, without labels; a document's posterior probability of being good decides, where usual
filters would ask that all rules pass.  The text is read and counted once: the
counts and the pattern of each row are written to the shared folder, the fit
and the verdicts read them from there.  Where only kept rows are asked for,
nothing is written and the text is counted twice, for the fit and for the
verdicts.  No shuffle of the text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

from .storage import drop_columns_clashing, written
from .textkit import KEEP_CASE, Words, chunks, grams, slices, spans

RULES = ("length", "word_length", "symbols", "repeated_lines", "repeated_words", "capitals", "function_words", "line_ends", "marks")

#: Frequent function words of the four languages.
FUNCTION_WORDS = (
    "the of and to in is that for it was with as be by on not are this from or an "
    "der die das und zu den mit von ist nicht ein eine im auf für sich "
    "le la les de des et en un une que est dans pour du au qui par "
    "el los las y por con una se su para al lo como"
).split()

_SYMBOL, _UPPER, _LETTER, _MARK, _HEAD = (np.zeros(256, bool) for _ in range(5))
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER[65:91] = True
_LETTER[65:91] = _LETTER[97:123] = True
_LETTER[0xC3:0xCB] = True
_MARK[list(b"!|")] = True
_HEAD[:] = (np.arange(256) & 0xC0) != 0x80
_ENDS = (b".", b"!", b"?", b":", b'"', b";", "…".encode(), "»".encode(), "”".encode())


def text_statistics(texts: list[bytes]) -> dict[str, np.ndarray]:
    """Per text: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and what the rules ask besides."""
    w = Words(texts, KEEP_CASE)
    n, at = w.counts.astype(np.int64), w.bytes_at
    raw = np.frombuffer(w.buffer, np.uint8)

    def summed(mask: np.ndarray) -> np.ndarray:
        total = np.zeros(len(mask) + 1, np.int64)
        np.cumsum(mask, out=total[1:])
        return total[np.minimum(at[1:], len(mask))] - total[np.minimum(at[:-1], len(mask))]

    out = {"n_words": n, "word_chars": summed((raw != 32) & _HEAD[raw]), "n_symbols": summed(_SYMBOL[raw]), "upper": summed(_UPPER[raw]), "letters": summed(_LETTER[raw]), "marks": summed(_MARK[raw])}
    dup, lines, ended = (np.zeros(len(texts), np.int64) for _ in range(3))
    for i, t in enumerate(texts):
        some = [x for x in t.split(b"\n") if x.strip()]
        lines[i] = len(some)
        dup[i] = len(some) - len(set(some))
        ended[i] = sum(x.rstrip().endswith(_ENDS) for x in some)
    out |= {"n_dup_lines": dup, "lines": lines, "ended": ended}

    windows = np.maximum(n - 2, 0)
    place = spans(w.first[:-1], windows)
    owner = np.repeat(np.arange(len(texts)), windows)
    h = grams(w.hash, 3)
    key = (owner.astype(np.uint64) << np.uint64(52)) | (h[place] >> np.uint64(12)) if len(place) else np.empty(0, np.uint64)
    order = np.argsort(key)
    key = key[order]
    same = key[1:] == key[:-1]
    again = place[order[np.append(False, same) | np.append(same, False)]] if len(key) else place
    edge = np.zeros(len(w.hash) + 4, np.int64)
    np.add.at(edge, again, 1)
    np.add.at(edge, again + 3, -1)
    covered = np.append(0, np.cumsum(np.cumsum(edge) > 0))
    out["n_repeat_words"] = covered[w.first[1:]] - covered[w.first[:-1]]

    common = np.append(0, np.cumsum(np.isin(w.hash, Words([x.encode() for x in FUNCTION_WORDS], KEEP_CASE).hash)))
    out["function"] = common[w.first[1:]] - common[w.first[:-1]]
    return out


def votes(s: dict[str, np.ndarray]) -> np.ndarray:
    """Texts by rules: 1 good, -1 bad, 0 abstain.

    A rule votes good only on a positive sign of running text; a text that
    merely lacks a fault makes it abstain.
    """
    n = np.maximum(s["n_words"], 1)
    lines = np.maximum(s["lines"], 1)
    few = s["n_words"] < 20

    def vote(good, bad):
        return np.where(bad, -1, np.where(good, 1, 0))

    mean, symbols = s["word_chars"] / n, s["n_symbols"] / n
    dup, repeat = s["n_dup_lines"] / lines, s["n_repeat_words"] / n
    upper = s["upper"] / np.maximum(s["letters"], 1)
    function, ended, marks = s["function"] / n, s["ended"] / lines, s["marks"] / n
    never = np.zeros(len(n), bool)
    cols = [
        vote(never, s["n_words"] < 50),
        vote(never, (mean < 2) | (mean > 12)),
        vote(symbols < 0.02, symbols > 0.3),
        vote(never, dup > 0.3),
        vote(never, repeat > 0.4),
        vote(never, upper > 0.5),
        vote((function > 0.1) & ~few, (function < 0.02) & ~few),
        vote(ended > 0.6, (ended < 0.2) & (s["lines"] > 2)),
        vote(never, marks > 0.3),
    ]
    return np.stack(cols, axis=1).astype(np.int64)


def _codes(v: np.ndarray) -> np.ndarray:
    return (v + 1) @ 3 ** np.arange(len(RULES))


def _of_code(code: np.ndarray, rules: int = len(RULES)) -> np.ndarray:
    return code[:, None] // 3 ** np.arange(rules) % 3 - 1


class VoteModel:
    """Class prior and, for each class and rule, the chances that the rule votes bad, abstains or votes good.

    Fitted by expectation-maximisation: what a document's votes say of its
    class weighs the vote counts of both classes, and these are the next
    estimate.  Abstaining is an outcome as any other, so a rule that votes on
    one side only is estimated too, by how often it speaks in either class.
    Classes start from the votes as they are meant.  ``weight`` votes of the
    corpus' own mean are added to each class, so that what was never seen in a
    class is not read as proof.
    """

    def __init__(self, counts: dict[int, int], rounds: int = 1_000, tolerance: float = 1e-10, weight: float = 2.0, rules: int = len(RULES)):
        code = np.array(sorted(counts), np.int64)
        many = np.array([counts[c] for c in code.tolist()], float)
        self.rules, self.prior = rules, 0.7
        #: By class (bad, good), rule and vote (bad, none, good).
        self.chance = np.tile(np.array([[[0.5, 0.4, 0.1]], [[0.1, 0.4, 0.5]]]), (1, rules, 1))
        if not len(code):
            return
        vote = _of_code(code, rules)
        shown = np.stack([vote == o for o in (-1, 0, 1)], axis=2).astype(float)
        mean = (np.tensordot(many, shown, 1) + 1) / (many.sum() + 3)
        for _ in range(rounds):
            good = self.probability(vote)
            before = self.prior, self.chance
            self.prior = (many @ good + 1) / (many.sum() + 2)
            seen = np.stack([np.tensordot(many * (1 - good), shown, 1), np.tensordot(many * good, shown, 1)]) + weight * mean
            self.chance = seen / seen.sum(2, keepdims=True)
            if abs(before[0] - self.prior) + np.abs(before[1] - self.chance).max() < tolerance:
                break

    def accuracy(self) -> np.ndarray:
        """By class and rule the chance that a vote, if there is one, names the class."""
        bad, good = self.chance[..., 0], self.chance[..., 2]
        return np.stack([bad[0] / (bad[0] + good[0]), good[1] / (bad[1] + good[1])])

    def probability(self, vote: np.ndarray) -> np.ndarray:
        """The chance that documents with these votes are good."""
        says = np.log(self.chance)[:, np.arange(self.rules), vote + 1].sum(2)
        return 1 / (1 + np.exp(np.clip(np.log(1 - self.prior) + says[0] - np.log(self.prior) - says[1], -700, 700)))


def fit_votes(docs: DataFrame, text_col: str = "text") -> VoteModel:
    """EM over the vote patterns of every row that passes the base check (no such row leaves the model as it starts)."""
    return _fitted(_counted(docs, [], text_col))


def _base_failed():
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _fitted(counted: DataFrame) -> VoteModel:
    # Rows that fail the base check go anyway; most are too short for some rules, and what these leave unsaid is no evidence for longer texts.
    rows = counted.where(~_base_failed()).groupBy("code").agg(F.count("*").alias("many")).collect()  # at most 3^9 rows
    return VoteModel({r.code: r.many for r in rows})


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _counted(docs: DataFrame, names: list[str], text_col: str) -> DataFrame:
    """Columns ``_0`` and so on of ``names``, the counts, and the code of the votes, for each row."""
    given = docs.select(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(names)], F.col(f"`{text_col}`").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            texts = [t or b"" for t in batch.column(len(names)).cast(pa.binary()).to_pylist()]
            for a, b in chunks(texts):
                s = text_statistics(texts[a:b])
                part = batch.slice(a, b - a).select(list(range(len(names))))
                more = [*(pa.array(s[c].astype(np.int64)) for c in COUNTS), pa.array(_codes(votes(s)))]
                yield pa.RecordBatch.from_arrays([*part.columns, *more], names=[*part.schema.names, *COUNTS, "code"])

    fields = [StructField(f"_{i}", docs.schema[c].dataType) for i, c in enumerate(names)]
    return given.mapInArrow(run, StructType([*fields, *(StructField(c, LongType()) for c in COUNTS), StructField("code", LongType())]))


ADDED = [
    *(StructField(c, LongType()) for c in COUNTS),
    StructField("base_failed", BooleanType()),
    StructField("kept", BooleanType()),
    StructField("quality_probability", DoubleType()),
]


def judge_quality(docs: DataFrame, text_col: str = "text", threshold: float = 0.5, keep: list[str] | None = None, only_kept: bool = False, model: VoteModel | None = None) -> DataFrame:
    """``docs`` with statistics, base check, posterior quality and verdict.

    base_failed: fewer than 50 words, or more than half of the words in
    repeated three-word windows.  kept: base passed and posterior at least
    ``threshold``.  Null texts have no words and fail.  Equal rows are judged
    alike.  Columns with names of added ones give way.  ``keep`` names the
    columns to keep; ``only_kept`` returns the input columns of kept rows.  An
    empty table gives an empty one.
    """
    names = (docs if only_kept else drop_columns_clashing(docs.select(*keep) if keep else docs, *[f.name for f in ADDED])).columns
    own = [F.col(f"_{i}").alias(c) for i, c in enumerate(names)]
    if only_kept:
        # Whole rows would be a copy of all texts on disk, for as long as the result is used: they are counted once more instead.
        model = model or fit_votes(docs, text_col)
        codes = np.arange(3 ** len(RULES))
        good = docs.sparkSession.createDataFrame([(c,) for c in codes[model.probability(_of_code(codes)) >= threshold].tolist()], "code long")
        return _counted(docs, names, text_col).where(~_base_failed()).join(F.broadcast(good), "code", "left_semi").select(*own)
    counted = written(_counted(docs, names, text_col))
    model = model or _fitted(counted)
    # A row's posterior hangs on its pattern only: the verdict on each pattern is a constant of the plan.
    codes = [r.code for r in counted.select("code").distinct().collect()]  # at most 3^9 rows
    table = counted.sparkSession.createDataFrame(list(zip(codes, map(float, model.probability(_of_code(np.array(codes, np.int64)))), strict=True)), "code long, quality_probability double")
    judged = counted.join(F.broadcast(table), "code").withColumn("base_failed", _base_failed()).withColumn("kept", ~_base_failed() & (F.col("quality_probability") >= threshold))
    return judged.select(*own, *[f.name for f in ADDED])
