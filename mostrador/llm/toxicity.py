"""Toxicity of texts after undoing disguises.

Disguised words (letters written as digits or signs, spaced out, or repeated) are decoded by the noisy-channel rule: a
lattice of what each character may stand for, and the Viterbi path through it that a character model of the corpus's own
words and the channel's costs find likeliest; in a spaced-out passage of any length each space may be a gap in a word
or the end of one. A text is then scored by the words that labelled texts show to be toxic,
plain or restored.

The character model counts the words of all documents. The toxic words are those whose share of toxic documents is above
the overall one beyond chance (a likelihood-ratio statistic above what the best of as many words would reach); equal and
nearly equal texts (same least five-word shingle) count once, so that copies are not evidence. The model sent to the
tasks holds all character runs counted, as two arrays of numbers (16 bytes a run), and all words beyond the threshold.

Null and empty texts get the score of a text without evidence. Rows without an id are scored, and teach nothing. A
document labelled twice counts as toxic if one label says so; null labels say nothing. Without labels all scores are 0.
An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .sides import small
from .counting import LETTERS, gathered, letter_pieces, summed, to_code
from .words import columns, emit, emit_arrays, handed_back, shingles, signed

# Least share of toxic documents among those with a word of the lexicon.
LEAST_SHARE = 0.5

# Letters that digits and signs are written for.
STANDS_FOR = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
              "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "(": "c", "*": "aeiou", "#": "h"}
GAPS = "._-~'*"
# Signs at a word's ends that are punctuation rather than letters.
EDGES = ".,;:?!\"'()[]{}<>*_-~#%&^=/\\"

ODD = re.compile(r"[^\W\d_][0-9@$!|+€£(*#._~'-]+[^\W\d_]|^[0-9@$|+€£(]+[^\W\d_]{2}|[^\W\d_]{2}[0-9$@]+$|([^\W\d_])\1\1")
# Signs that part letters are no letters themselves, so that a run reads in one way only; a star may stand for a letter.
SPACED = re.compile(r"(?<![^\s])(?:[^\s._~*-](?: \* |[ ._~*-]{1,2})){2,}[^\s._~*-](?![^\s.,;:!?_~*-])")
# What parts the letters of a spaced-out passage.
BETWEEN = re.compile(r"[ ._~*-]+")
ENDED = " \n"
# Longest spelling whose decoding is remembered.
REMEMBERED = 64


class Grams:
    """Counts of 1- to 3-character runs, held as sorted numbers; ``^`` and ``$`` mark a word's ends."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray):
        length = 1 + ((codes >> 21 & 0x1FFFFF) != 0) + ((codes & 0x1FFFFF) != 0)
        self.by_length = []
        for k in (1, 2, 3):
            own, n = codes[length == k], counts[length == k]
            order = np.argsort(own)
            self.by_length.append((own[order], np.concatenate([[0], np.cumsum(n[order])])))

    def between(self, length: int, low: int, high: int) -> int:
        """Sum of the counts of the runs of a length from code ``low`` up to below ``high``."""
        codes, sums = self.by_length[length - 1]
        a, b = codes.searchsorted([low, high])
        return int(sums[b] - sums[a])

    def get(self, gram: str, other: int = 0) -> int:
        code = to_code(gram.replace("^", " ").replace("$", " "))
        return self.between(len(gram), code, code + 1) or other

    def after(self, before: str) -> int:
        """How often any character follows ``before``."""
        code = to_code(before.replace("^", " "))
        return self.between(len(before) + 1, code, code + (1 << (63 - 21 * len(before))) - (not before))


class Following(dict):
    """Sums of ``Grams`` by what comes before, worked out when asked for."""

    def __init__(self, grams: Grams):
        super().__init__()
        self.grams = grams

    def get(self, before: str, other: int = 0) -> int:
        found = super().get(before)
        if found is None:
            found = self[before] = self.grams.after(before)
        return found or other


class Speller:
    """Viterbi decoding of a disguised word under a character trigram model."""

    SUBSTITUTE, REPEAT, GAP, KEEP = -1.0, -0.7, -1.0, -12.0
    # What the end of a word costs at a narrow space of a spaced-out passage, reading by reading, and how many words are joined.
    ENDS, JOINED = (0.0, -4.0), 4
    # A space wider than the others of its passage hardly stands inside a word.
    WIDE = -6.0
    # Least share of a letter among the words it begins to count as a word of its own.
    ALONE = 0.01

    def __init__(self, counts: dict[str, int] | Grams):
        self.counts = counts
        if isinstance(counts, Grams):
            self.context = Following(counts)
        else:
            self.context = Counter()
            for g, n in counts.items():
                self.context[g[:-1]] += n
        self.cache: dict[tuple[str, float], str] = {}
        self.known: dict[str, float] = {}

    def logp(self, context: str, c: str) -> float:
        """Character after two others, each order leaning on the one below."""
        found = self.known.get(context + c)
        if found is not None:
            return found
        p = 1e-4
        for k in range(3):
            before = context[len(context) - k:] if k else ""
            p = (self.counts.get(before + c, 0) + 4 * p) / (self.context.get(before, 0) + 4)
        if len(self.known) < 1_000_000:
            self.known[context + c] = math.log(p)
        return math.log(p)

    def lattice(self, word: str, end: float = 0.0) -> list[list[tuple[str, float]]]:
        """For each run of one character, the strings it may stand for and their costs; a space or line end in them ends a word."""
        steps = []
        for m in re.finditer(r"(.)\1*", word, re.S):
            c, n = m[1], len(m[0])
            choices = []
            if c.isalpha():
                choices = [(c, 0.0 if n == 1 else self.REPEAT)] + ([(c * 2, 0.0 if n == 2 else self.REPEAT)] if n > 1 else [])
            for letter in STANDS_FOR.get(c, ""):
                choices.append((letter, self.SUBSTITUTE - (0.7 if c == "*" else 0.0)))
                if n > 1:
                    choices.append((letter * 2, 2 * self.SUBSTITUTE))
            if c in GAPS:
                choices.append(("", self.GAP))
            if c == " ":
                choices = [("", 0.0), (" ", end)] if n == 1 else [("", self.WIDE), ("\n", 0.0)]
            steps.append(choices or [("", self.KEEP)])
        return steps

    def decode(self, word: str, end: float = 0.0) -> str:
        """The likeliest reading; words of a spaced-out passage are parted by spaces, and by line ends at wide spaces."""
        found = self.cache.get((word, end))
        if found is None:
            # Of each state the cost, and the path as (path before, text): linear in the length.
            paths: dict[str, tuple[float, tuple | None]] = {"^": (0.0, None)}
            for choices in self.lattice(word, end):
                reached: dict[str, tuple[float, tuple | None]] = {}
                for state, (cost, done) in paths.items():
                    for text, penalty in choices:
                        at, total = state, cost + penalty
                        for c in text:
                            total += self.logp(at, "$" if c in ENDED else c)
                            at = "^" if c in ENDED else (at + c)[-2:]
                        if at not in reached or total > reached[at][0]:
                            reached[at] = (total, (done, text) if text else done)
                paths = reached
            done = max(((cost + self.logp(state, "$"), state, done) for state, (cost, done) in paths.items()), key=lambda x: x[:2])[2]
            parts = []
            while done:
                done, text = done
                parts.append(text)
            found = "".join(reversed(parts))
            if len(word) <= REMEMBERED and len(self.cache) < 200_000:
                self.cache[word, end] = found
        return found

    def alone(self, c: str) -> bool:
        """Whether a letter is a word of its own often enough."""
        n = self.counts.get(f"^{c}$", 0)
        return n > 0 and n >= self.ALONE * self.context.get(f"^{c}", 0)

    def passage(self, spaced: str) -> set[str]:
        """The words of a spaced-out passage, and neighbours joined where only a narrow space parts them, as letters alone do
        not tell where words end; each also without a one-letter word at either end."""
        words = set()
        for end in self.ENDS:
            for part in self.decode(spaced, end).split("\n"):
                row = part.split(" ")
                words.update("".join(row[k: k + n]) for n in range(1, self.JOINED + 1) for k in range(max(1, len(row) - n + 1)))
        for w in list(words):
            if len(w) > 3:
                rest = w[1:] if self.alone(w[0]) else w
                words.update((rest, *((w[:-1], rest[:-1]) if self.alone(w[-1]) else ())))
        return words


def spelling(token: str) -> str | None:
    """What may hide a word in a token, without the signs around it."""
    core = token.strip(EDGES)
    if len(core) >= 3 and ODD.search(core):
        return core
    core = token.lstrip(".,;:?\"'[]{}<>").rstrip(EDGES)
    return core if len(core) >= 3 and core[0] in "@$!|(*" and any(x.isalpha() for x in core) else None


def tripled(text: str) -> list[str]:
    """Letters that come three times in a row somewhere."""
    at = np.frombuffer(text.encode("utf-32-le"), "<u4")
    rows = at[2:][(at[2:] == at[1:-1]) & (at[1:-1] == at[:-2])]
    return [c for c in map(chr, np.unique(rows).tolist()) if LETTERS.match(c)]


def disguised(text: str, words: set[str]) -> Iterator[str]:
    """Spellings in a lower-case text that may hide a word; ``words`` are its runs of letters."""
    tokens = set(text.split())
    # A run of letters alone hides nothing unless one is tripled.
    plain = tokens & words
    odd = tokens - plain
    for row in (3 * c for c in tripled(text)):
        odd.update(w for w in plain if row in w)
    yield from filter(None, map(spelling, odd))


def passages(text: str) -> Iterator[str]:
    """Spaced-out passages of a lower-case text: one space where the gap is the narrowest of its passage, else two."""
    for m in SPACED.finditer(text):
        core = m[0].strip(" ._~*-")
        gaps = [len(g) for g in BETWEEN.findall(core)]
        if len(gaps) >= 2:
            least = min(gaps)
            yield BETWEEN.sub(lambda g: " " if len(g[0]) == least else "  ", core)


def text_words(text: str | None, speller: Speller) -> set[str]:
    """The words of a text, plain and restored."""
    words = {w for piece in letter_pieces(text) for w in piece}
    lower = (text or "").lower()
    for odd in list(disguised(lower, words)):
        words.add(speller.decode(odd))
        words.update(SPLIT_RUN.findall(odd))
    for spaced in set(passages(lower)):
        words |= speller.passage(spaced)
    words.discard("")
    return words


SPLIT_RUN = re.compile(r"[^\W\d_]{3,}")


def learn_characters(docs: DataFrame, text_column: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of all 1- to 3-character runs in the words of all documents; a space marks a word's ends."""
    schema = pa.schema([("gram", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from emit_arrays(((codes.view(np.int64), n) for _, codes, n in gathered(((None, text) for (text,) in columns(batches)), ends=True)), schema)

    counts = (docs.select(F.col(text_column).cast("string").alias("text")).filter("text IS NOT NULL").mapInArrow(run, "gram long, n long")
              .groupBy("gram").agg(F.sum("n").alias("n")))
    found = counts.toArrow()
    return tuple(found[c].to_numpy().astype(np.int64) for c in ("gram", "n"))


def learn_lexicon(docs: DataFrame, labels: DataFrame, characters, id_column: str = "doc_id", text_column: str = "text",
                  label_column: str = "toxic") -> tuple[dict[str, float], float]:
    """({word: log odds}, log odds of a text without evidence) from the labelled documents."""
    spark = docs.sparkSession
    known = (labels.select(F.col(id_column).cast("long").alias("doc_id"), F.col(label_column).cast("int").alias("y"))
             .filter("doc_id IS NOT NULL AND y IS NOT NULL").groupBy("doc_id").agg(F.max("y").alias("y")))
    known = small(cut_lineage(spark, known, "labels"))
    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text")).join(known, "doc_id")

    def keys(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for doc_id, text, y in columns(batches):
                t = shingles((text or "").encode("utf-8", "replace"), 5)
                yield doc_id, y, int(signed(t[:1])[0]) if len(t) else None

        yield from emit(rows(), pa.schema([("doc_id", pa.int64()), ("y", pa.int32()), ("key", pa.int64())]))

    chosen = cut_lineage(spark, texts.mapInArrow(keys, "doc_id long, y int, key long").groupBy("key", "y").agg(F.min("doc_id").alias("doc_id")), "distinct-labelled")
    sizes = {r["y"]: r["n"] for r in chosen.groupBy((F.col("y") > 0).cast("int").alias("y")).agg(F.count("*").alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return {}, -math.inf if not toxic else math.inf
    texts = texts.join(small(chosen.select("doc_id")), "doc_id", "left_semi")

    def words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts():
            speller = Speller(Grams(*characters.value))
            yield from ((((w, y > 0), 1) for w in text_words(text, speller)) for _, text, y in columns(batches))

        yield from summed(parts(), pa.schema([("word", pa.string()), ("toxic", pa.bool_()), ("n", pa.int64())]))

    seen = (texts.mapInArrow(words, "word string, toxic boolean, n long").groupBy("word")
            .agg(F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("t"), F.sum(F.when(F.col("toxic"), 0).otherwise(F.col("n"))).alias("c")))
    seen = cut_lineage(spark, seen.filter("t > 0"), "word-labels")
    base = toxic / (toxic + clean)
    part = lambda x, p: F.when(F.col(x) > 0, F.col(x) * F.log(F.col(x) / ((F.col("t") + F.col("c")) * p))).otherwise(0.0)
    strength = 2 * (part("t", base) + part("c", 1 - base))
    least = 2 * math.log(max(seen.count(), 1)) + 4
    rows = (seen.withColumn("strength", strength).filter((F.col("strength") >= least) & (F.col("t") > max(base, LEAST_SHARE) * (F.col("t") + F.col("c"))))
            .collect())
    odds = {r["word"]: math.log((r["t"] + 0.5) / (toxic + 1)) - math.log((r["c"] + 0.5) / (clean + 1)) for r in rows}
    return odds, math.log(base / (1 - base))


def scorer(characters, lexicon, prior: float):
    """A column function: the score of a text, from 0 to 1."""
    def scores(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        speller, odds = Speller(Grams(*characters.value)), lexicon.value

        def one(text: str | None) -> float:
            if math.isinf(prior):
                return float(prior > 0)
            weight = prior + sum(odds.get(w, 0.0) for w in text_words(text, speller))
            return 1 / (1 + math.exp(-max(-30.0, min(30.0, weight))))

        for part in parts:
            yield pa.array([one(text.as_py()) for text in part], pa.float64())

    @F.arrow_udf("double")
    def score(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from handed_back(scores(parts))

    return score


def learned_scorer(docs: DataFrame, learning: DataFrame, labels: DataFrame):
    """The column function learnt from a corpus: characters from all documents, labels from those of ``learning``."""
    send = docs.sparkSession.sparkContext.broadcast
    characters = send(learn_characters(docs))
    odds, prior = learn_lexicon(learning, labels, characters)
    return scorer(characters, send(odds), prior)


def toxicity(docs: DataFrame, learning: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: doc_id, score."""
    score = learned_scorer(docs, learning, labels)
    return docs.select(F.col(id_column).cast("long").alias("doc_id"), score(F.col(text_column).cast("string")).alias("score"))
