"""Toxicity: undo disguised spelling by noisy-channel decoding, then score the words.

A character model of order four is counted over the whole corpus.  Tokens that
look disguised (digits or symbols for letters, letters set apart, repeated
letters) become lattices of readings; the Viterbi path under the character model
and the costs of each disguise is the restored text.  A token without any such
sign has one reading, itself.  Restored words are scored by a sparse logistic
model.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalsweep.llm.common import map_batches, slices, staged, text_bytes, texts
from evalsweep.llm.labels import held_out, training_labels

# Which letters a sign may stand for.
SIGNS = {
    "0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l",
}
APART = " .-_*~^'"
# Lengths of word beginnings that are scored besides whole words.
STEMS = (4, 5, 6, 7)
# Costs, in nats, of each disguise.
READ, KEPT, DROPPED, APART_KEPT, TRIPLED, DOUBLED = 1.0, 4.0, 0.5, 2.0, 0.7, 2.5

# Symbols of the character model: 0 between words, 1-26 letters, 27 any other letter.
SYMBOLS = 28
OTHER = 27
_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[ord("A") : ord("Z") + 1] = _SYMBOL[ord("a") : ord("z") + 1] = np.arange(1, 27)
_SYMBOL[0xC0:] = OTHER  # the first byte of a letter beyond ASCII

_SUSPECT = re.compile(
    r"(?<=[A-Za-z])[0134578@$|!+(<€£](?=[A-Za-z0-9@$])"  # a sign within a word
    r"|(?<!\S)[0134578@$!|](?=[A-Za-z])"  # a sign that begins one
    r"|([A-Za-z])\1\1"  # a letter three times
    r"|(?<=[A-Za-z])[.*_~^-](?=[A-Za-z0-9@$!])"  # a mark between letters
    r"|(?<![^\s.*_~^-])[A-Za-z0-9@$!](?:[ .*_~^-][A-Za-z0-9@$!]){3,}(?!\w)"  # letters apart
)
_WORD = re.compile(r"[^\W\d_]+")


def count_grams(docs: DataFrame) -> np.ndarray:
    """Counts of all runs of four symbols in all texts, capitals as small letters.

    Each task gives its non-zero counts; their sum has at most ``SYMBOLS**4`` rows.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**4, np.int64)
        for batch in batches:
            for lo, hi in slices(batch, 1 << 20):
                data, offsets = text_bytes(batch.column("text").slice(lo, hi - lo))
                data = np.insert(data, offsets[:-1], 32)  # texts do not run together
                symbols = _SYMBOL[data[(data < 0x80) | (data >= 0xC0)]]
                # Signs and spaces in a row are one gap.
                symbols = np.r_[0, 0, 0, symbols[np.r_[True, (symbols[1:] > 0) | (symbols[:-1] > 0)]], 0] if len(symbols) else symbols
                if len(symbols) > 3:
                    gram = ((symbols[:-3] * SYMBOLS + symbols[1:-2]) * SYMBOLS + symbols[2:-1]) * SYMBOLS + symbols[3:]
                    total += np.bincount(gram, minlength=SYMBOLS**4)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"gram": pa.array(at, pa.int64()), "n": pa.array(total[at], pa.int64())})

    counted = docs.select("text").mapInArrow(work, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    out = np.zeros(SYMBOLS**4)
    for row in counted.toLocalIterator():
        out[row["gram"]] = row["n"]
    return out


def log_model(counts: np.ndarray, weight: float = 4.0) -> np.ndarray:
    """Log probabilities of a symbol after three others; shorter contexts smooth longer ones."""
    grams = counts.reshape((SYMBOLS,) * 4)
    share = np.full(SYMBOLS, 1.0 / SYMBOLS)
    for used in (3, 2, 1, 0):  # leading symbols that are summed away
        own = grams.sum(axis=tuple(range(used)))
        share = (own + weight * share) / (own.sum(-1, keepdims=True) + weight)
    return np.log(share).astype(np.float32)


class Decoder:
    """Restores disguised tokens; remembers what it has restored."""

    # Tokens that are remembered, and the longest of them.
    REMEMBERED, LONGEST = 100_000, 64
    # Signs after which what is settled is written out, and the most that may stay open.
    STEP, OPEN = 256, 8192

    def __init__(self, model: np.ndarray):
        self.model = model
        self.known: dict[str, str] = {}

    def __call__(self, token: str) -> str:
        if len(token) > self.LONGEST:
            return self.decode(token)
        found = self.known.get(token)
        if found is None:
            if len(self.known) >= self.REMEMBERED:
                self.known.clear()
            found = self.known[token] = self.decode(token)
        return found

    def decode(self, token: str) -> str:
        """The reading of least cost: Viterbi over states of the last three symbols.

        In a long token the paths to all states soon share their beginning, which
        is then written out, so that memory does not grow with the token.  Should
        more than ``OPEN`` signs stay open, the best path so far settles them.
        """
        token, model = token.lower(), self.model
        settled: list[str] = []
        best: dict[tuple[int, int, int], float] = {(0, 0, 0): 0.0}
        back: list[dict] = []  # for each sign, where a state came from and what it wrote
        for i, c in enumerate(token):
            readings: list[tuple[int | None, float, str]] = []
            if "a" <= c <= "z":
                readings.append((ord(c) - 96, 0.0, c))
            elif c.isalpha():
                readings.append((OTHER, 0.0, c))
            elif c in APART:
                readings += [(None, DROPPED, ""), (0, APART_KEPT, " ")]
            else:
                readings += [(ord(x) - 96, READ, x) for x in SIGNS.get(c, "")]
                readings.append((0, KEPT, " "))
            if i and c == token[i - 1] and c.isalnum():
                tripled = c * 3 in token[max(0, i - 2) : i + 2]
                readings.append((None, TRIPLED if tripled else DOUBLED, ""))
            new: dict[tuple[int, int, int], float] = {}
            came: dict = {}
            for state, cost in best.items():
                row = model[state]
                for symbol, price, text in readings:
                    if symbol is None or (symbol == 0 and state[2] == 0):
                        to, total = state, cost + price
                    else:
                        to, total = (state[1], state[2], symbol), cost + price - float(row[symbol])
                    if total < new.get(to, 1e300):
                        new[to] = total
                        came[to] = (state, text)
            best = new
            back.append(came)
            if len(back) >= self.STEP and not len(back) % self.STEP:
                best, back = self._settle(best, back, settled)
        state = min(best, key=lambda s: (best[s] - float(model[s][0]), s))
        out = []
        for came in reversed(back):
            state, text = came[state]
            out.append(text)
        return "".join([*settled, *reversed(out)])

    def _settle(self, best: dict, back: list[dict], settled: list[str]) -> tuple[dict, list[dict]]:
        """Write out what all paths share; costs and steps that are still open."""
        if len(back) >= self.OPEN:
            first = min(best, key=lambda s: (best[s], s))
            best = {first: best[first]}
        states, shared = set(best), len(back)
        while shared and len(states) > 1:
            shared -= 1
            states = {back[shared][state][0] for state in states}
        if not shared:
            return best, back
        state, out = states.pop(), []
        for came in reversed(back[:shared]):
            state, text = came[state]
            out.append(text)
        settled.append("".join(reversed(out)))
        return best, back[shared:]


def restore(text: str, decode: Decoder) -> str:
    """The text with each suspect token, or run of letters apart, replaced by its best reading."""
    parts, at = [], 0
    for m in _SUSPECT.finditer(text):
        start, end = m.span()
        if start < at:
            continue
        while start > at and not text[start - 1].isspace():
            start -= 1
        while end < len(text) and not text[end].isspace():
            end += 1
        core = text[start:end].rstrip(".,;:!?*%&#|)\"'$")
        parts += [text[at:start], decode(core)]
        at = start + len(core)
    if not parts:
        return text
    return "".join([*parts, text[at:]])


def words(text: str, decode: Decoder) -> set[str]:
    """Restored words, and their beginnings with a star, for insults that are inflected."""
    whole = set(_WORD.findall(restore(text, decode).lower()))
    return whole.union(*({w[:k] + "*" for w in whole if len(w) > k} for k in STEMS))


@dataclass
class Model:
    letters: np.ndarray  # log_model
    weights: dict[str, float]
    bias: float
    one_class: bool = False  # there was nothing to learn from

    def scores(self, whole: list[str], decode: Decoder) -> list[float]:
        lexicon = self.weights.keys()
        odds = [self.bias + sum(sorted(self.weights[w] for w in lexicon & words(t, decode))) for t in whole]
        return [1.0 / (1.0 + np.exp(-min(max(x, -700.0), 700.0))) for x in odds]


def sparse_logistic(
    rows: list[np.ndarray], y: np.ndarray, n_features: int, penalty: float, passes: int = 40
) -> tuple[np.ndarray, float]:
    """Logistic weights with an L1 penalty, counted in rows, on each; the bias is free.

    Coordinate descent: one weight at a time takes a bounded Newton step and is
    drawn towards zero.  Words that others already explain stay at zero.
    """
    n = len(rows)
    at = np.concatenate([np.zeros(0, np.int64), *rows]).astype(np.int64)
    owner = np.repeat(np.arange(n), [len(r) for r in rows])[np.argsort(at, kind="stable")]
    ends = np.cumsum(np.bincount(at, minlength=n_features))
    holders = np.split(owner, ends[:-1]) if n_features else []
    w, share = np.zeros(n_features), (y.sum() + 0.5) / (n + 1.0)
    b = float(np.log(share / (1 - share)))
    odds = np.full(n, b)
    for _ in range(passes):
        most = 0.0
        for j in range(n_features):
            own = holders[j]
            p = 1.0 / (1.0 + np.exp(-odds[own]))
            pull = (y[own] - p).sum()
            if not w[j] and abs(pull) <= penalty:
                continue
            bend = max((p * (1 - p)).sum(), 0.05 * len(own), 1e-3)
            target = w[j] + pull / bend
            new = np.sign(target) * max(abs(target) - penalty / bend, 0.0)
            new = w[j] + min(max(new - w[j], -2.0), 2.0)
            odds[own] += new - w[j]
            most, w[j] = max(most, abs(new - w[j])), new
        p = 1.0 / (1.0 + np.exp(-odds))
        change = float((y - p).sum() / max((p * (1 - p)).sum(), 0.05 * n))
        b, odds = b + change, odds + change
        if max(most, abs(change)) < 1e-3:
            break
    return w, b


def fit(
    docs: DataFrame, labels: DataFrame, column: str = "toxic", folds: int = 3, out: int = 1,
    sample: int = 30_000, lexicon: int = 6000, least: int = 4, penalty: float = 0.8,
) -> Model:
    """Character model over all texts; word weights from at most about ``sample`` labelled rows.

    Rows whose id falls into the held-out fold are never read for labels.  The
    sample is taken by a hash of the id.  Words must occur in ``least`` toxic
    rows; the ``lexicon`` that part the classes best are weighed.
    """
    letters = log_model(count_grams(docs))
    known = training_labels(labels, column, folds, out)
    n = known.count()
    if n > sample:
        known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * sample / n))

    def work(batch: pa.RecordBatch, decode: Decoder) -> dict:
        found = [sorted(words(t, decode)) for t in texts(batch)]
        return {"y": batch.column("y"), "words": found}

    # The sampled labels are bounded by a parameter; the texts stay where they are.
    labelled = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("text", "y")
    rows = staged(
        map_batches(labelled, work, "y int, words array<string>", lambda: Decoder(letters)), "toxic-words"
    )
    n, n_toxic = rows.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not n or n_toxic in (0, n):
        share = (n_toxic + 0.5) / (n + 1.0)
        return Model(letters, {}, float(np.log(share / (1 - share))), True)
    per_word = rows.select("y", F.explode("words").alias("word")).groupBy("word").agg(
        F.sum("y").alias("toxic"), F.count("*").alias("n")
    )
    expected = F.col("n") * (n_toxic / n)
    apart = (F.col("toxic") - expected) / F.sqrt(expected + 1.0)
    chosen = (
        per_word.filter((F.col("toxic") >= least) & (F.col("toxic") > expected))
        .orderBy(apart.desc(), "word")
        .limit(lexicon)
    )
    names = sorted(row["word"] for row in chosen.select("word").collect())
    number = {word: i for i, word in enumerate(names)}

    def numbered(batch: pa.RecordBatch) -> dict:
        each = [[number[w] for w in row if w in number] for row in batch.column("words").to_pylist()]
        return {"y": batch.column("y"), "at": each}

    # As many short lists as the sample has rows.
    sampled = map_batches(rows, numbered, "y int, at array<int>").orderBy("y", "at").toPandas()
    at, y = [np.array(a, np.int64) for a in sampled["at"]], sampled["y"].to_numpy(np.float64)
    w, _ = sparse_logistic(at, y, len(names), penalty)
    # Chosen words are weighed again, with less of a pull towards zero.
    chosen_at = np.flatnonzero(w)
    new = np.full(len(names), -1)
    new[chosen_at] = np.arange(len(chosen_at))
    w, b = sparse_logistic([new[a][new[a] >= 0] for a in at], y, len(chosen_at), penalty / 4)
    return Model(letters, {names[i]: float(x) for i, x in zip(chosen_at.tolist(), w) if x}, b)


def _input(docs: DataFrame) -> DataFrame:
    return docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text")


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **options) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row.

    The score is the probability of ``toxic`` 1 given the restored words alone.
    Rows whose id has crc32 1 modulo 3 never train.  A null text counts as empty
    and gets the score of no words; a null id is not held out and never trains;
    repeated rows are scored each.  A score equal to the threshold is predicted 1.
    Texts of any length are read whole; a long token is decoded on the way and held
    in part.  Other columns of both tables are left out; an empty table gives no
    rows.  Without labels of both classes every score is the share of 1 among them,
    smoothed.
    """
    rows = _input(docs)
    model = fit(rows, labels, **options)

    def work(batch: pa.RecordBatch, decode: Decoder) -> dict:
        values = np.array(model.scores(texts(batch), decode), np.float64)
        return {
            "doc_id": batch.column("doc_id"),
            "score": values,
            "predicted": (values >= threshold).astype(np.int32),
        }

    schema = "doc_id long, score double, predicted int"
    scored = map_batches(rows, work, schema, lambda: Decoder(model.letters))
    return scored.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", "predicted")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **options) -> DataFrame:
    """Documents that score under the threshold; all columns and all other rows as they are.

    A null text counts as empty; rows without an id and repeated rows are judged
    each; an empty table stays empty.  Without labelled rows of both classes
    nothing tells toxic texts from others: every document stays, with a warning.
    """
    model = fit(_input(docs), labels, **options)
    if not model.weights and model.one_class:
        warnings.warn("no labelled rows of both classes: no document is dropped as toxic", stacklevel=2)
        return docs

    def work(batch: pa.RecordBatch, decode: Decoder) -> dict:
        good = pa.array([s < threshold for s in model.scores(texts(batch), decode)])
        kept = batch.filter(good)
        return {name: kept.column(name) for name in kept.schema.names}

    return map_batches(docs, work, docs.schema, lambda: Decoder(model.letters))
