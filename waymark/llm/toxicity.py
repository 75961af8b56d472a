"""Toxicity by class-conditional Kneser-Ney language models.

Two letter models, one of toxic and one of ordinary texts, spell every word: each letter is
predicted from up to five before it in the word.  What a class has not seen backs off to its
continuation counts after two letters, and those to counts shared by both classes, so an
expression too rare to be known says nothing for either side.  Letters rather than words are the
units because insults are compounded and inflected.  A text's evidence is its length-normalised log-likelihood
ratio, over all its words and over its most toxic window; a logistic curve turns the two
numbers into a score.

Letter runs are counted exactly, each under its own key, so what a model knows grows with the distinct
runs of the labelled texts.  Counts come from all labelled rows of the training folds, summed by Spark; one row
for each class and distinct run reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import BROADCAST_BYTES, PASS_BYTES, batches, free_name, mix
from waymark.session import materialize

#: Letters (bytes) before the predicted one, at most.
BEFORE = 5
#: Words of a window.
WINDOW = 2
#: The logistic curve is fitted on at most so many labelled rows, and at most this share of them, that the models have not seen.
CURVE_ROWS, CURVE_SHARE = 20_000, 0.25
#: Letters counted before a task sends what it has.
SEND_LETTERS = 4_000_000

#: Punctuation and control characters separate words; bytes above 127 belong to letters.
_LETTERS = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def letter_runs(text: str | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The runs of each piece of a text, and where in them its words start.

    A run is a letter with up to ``BEFORE`` letters before it in the word; a word
    begins and ends with a space.  Pieces hold whole words, about ``PASS_BYTES`` long.
    """
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LETTERS).split()
    if not words:
        return
    joined = b" ".join(words) + b" "
    at = 0
    while at < len(joined):
        end = joined.find(b" ", min(len(joined) - 1, at + PASS_BYTES)) + 1
        letters = np.frombuffer(joined[at:end], dtype=np.uint8).astype(np.uint64)
        at = end
        starts = np.concatenate([[0], np.flatnonzero(letters[:-1] == 32) + 1])
        place = np.arange(len(letters)) - np.repeat(starts, np.diff(starts, append=len(letters)))
        runs = letters.copy()
        for k in range(1, BEFORE + 1):
            back = np.zeros_like(letters)
            back[k:] = letters[:-k]
            back[place == k - 1] = 32
            back[place < k - 1] = 0
            runs |= back << np.uint64(8 * k)
        yield runs, starts


class Keys:
    """Distinct keys and their numbers from 0; whatever is not among them has the number after the last."""

    def __init__(self, values: np.ndarray) -> None:
        # mix() maps keys one to one, evenly: the first bits of a mixed key tell about where it stands.
        mixed = np.sort(mix(np.unique(values)))
        bits = max(1, len(mixed).bit_length())
        self.shift = np.uint64(64 - bits)
        self.first = np.searchsorted(mixed, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)
        self.mixed = np.append(mixed, np.uint64(2**64 - 1))

    def __len__(self) -> int:
        return len(self.mixed) - 1

    def find(self, values: np.ndarray) -> np.ndarray:
        wanted = mix(values)
        at = self.first[wanted >> self.shift]
        found = self.mixed[at]
        low = np.flatnonzero(found < wanted)
        while len(low):
            at[low] += 1
            found[low] = self.mixed[at[low]]
            low = low[found[low] < wanted[low]]
        return np.where(found == wanted, at, len(self))

    def sums(self, values: np.ndarray, n: np.ndarray | None = None) -> np.ndarray:
        """How often (or with what sum of ``n``) each key is in the values; the last number is of all others."""
        return np.bincount(self.find(values), weights=n, minlength=len(self) + 1)


class Model:
    """Log-likelihood ratios of letters, and the curve that makes a score of them."""

    def __init__(self, counts: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """``counts``: the distinct runs of ordinary and of toxic texts, and how often each occurs."""
        self.curve: np.ndarray | None = None
        self.tables: list[tuple[np.ndarray, ...]] = []
        runs = np.concatenate([r for r, _ in counts])
        self.keys = Keys(runs), Keys(runs >> np.uint64(8)), Keys(runs & np.uint64(0xFFFFFF))
        of_class = []
        for run, n in counts:
            before, brief = run >> np.uint64(8), run & np.uint64(0xFFFFFF)
            cut = discounts(np.bincount(n[n < 5], minlength=5)[1:])
            total = self.keys[1].sums(before, n)
            weight = self.keys[1].sums(before, cut[np.minimum(n, 3)])
            weight = np.where(total > 0, weight / np.maximum(total, 1), 1.0)
            short = self.keys[2].sums(brief)
            after = np.bincount((brief >> np.uint64(8)).astype(np.int64), minlength=1 << 16)
            of_class.append((cut, self.keys[0].sums(run, n), total, weight, short, after))
        shared = [sum(c[k] for c in of_class) for k in (4, 5)]
        for tables in of_class:
            self.tables.append(tuple(t.astype(np.float32) for t in (*tables, *shared)))

    def ratios(self, runs: np.ndarray) -> np.ndarray:
        """Toxic minus ordinary log-likelihood of every letter."""
        brief = runs & np.uint64(0xFFFFFF)
        two = (brief >> np.uint64(8)).astype(np.int64)
        run, before, brief = (k.find(x) for k, x in zip(self.keys, (runs, runs >> np.uint64(8), brief), strict=True))
        shared = (self.tables[0][6][brief] + np.float32(0.5)) / (self.tables[0][7][two] + np.float32(32))
        logs = []
        for cut, seen, total, weight, short, after, _, _ in self.tables:
            all_after = after[two]
            kept = np.maximum(short[brief] - cut[1], 0)
            # The discounted types go to the shared counts; half of all at least.
            spread = np.float32(0.5)
            lower = np.where(all_after > 0, (1 - spread) * kept / np.maximum(all_after, 1), 0) + np.where(
                all_after > 0, spread, 1
            ) * shared
            times = np.minimum(seen[run], total[before])
            kept = np.maximum(times - cut[np.minimum(times, 3).astype(np.int64)], 0)
            logs.append(np.log(kept / np.maximum(total[before], 1) + weight[before] * lower))
        return logs[1] - logs[0]

    def evidence(self, text: str | None) -> tuple[float, float]:
        """Mean ratio of a word of the text, and of its most toxic window of words.

        Windows reach across the pieces of a long text; a text of fewer words is one window.
        """
        whole, words, most, last = 0.0, 0, None, np.empty(0)
        for runs, starts in letter_runs(text):
            by_word = np.add.reduceat(self.ratios(runs).astype(np.float64), starts)
            whole, words = whole + float(by_word.sum()), words + len(starts)
            near = np.concatenate([last, by_word])
            if len(near) >= WINDOW:
                sums = np.concatenate([[0.0], np.cumsum(near)])
                peak = float((sums[WINDOW:] - sums[:-WINDOW]).max()) / WINDOW
                most = peak if most is None else max(most, peak)
            last = near[max(0, len(near) - WINDOW + 1) :]
        if not words:
            return 0.0, 0.0
        return whole / words, whole / WINDOW if most is None else most

    def score(self, evidence: np.ndarray) -> np.ndarray:
        """Scores of rows of evidence; 0 where nothing was labelled."""
        if self.curve is None:
            return np.zeros(len(evidence))
        x = np.column_stack([np.ones(len(evidence)), evidence])
        return 1 / (1 + np.exp(-np.clip(x @ self.curve, -500, 500)))


def discounts(seen: np.ndarray) -> np.ndarray:
    """Discounts of counts 0, 1, 2 and 3 or more, from how many runs were seen 1 to 4 times."""
    n1, n2, n3, n4 = (float(x) for x in seen)
    if not (n1 and n2 and n3):
        return np.array([0, 0.75, 0.75, 0.75], dtype=np.float32)
    y = n1 / (n1 + 2 * n2)
    cut = [0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return np.clip(np.array(cut, dtype=np.float32), [0, 0.1, 0.1, 0.1], [0, 1, 2, 3])


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1e-4, steps: int = 50) -> np.ndarray:
    """Ridge logistic regression by Newton's method; first weight is the constant."""
    scale = np.maximum(x.std(axis=0), 1e-9)
    x = np.column_stack([np.ones(len(y)), x / scale])
    w = np.zeros(x.shape[1])
    penalty = ridge * np.diag([1e-3, *[1.0] * (x.shape[1] - 1)])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) / len(y) + penalty @ w
        step = np.linalg.solve((x.T * (p * (1 - p) + 1e-9)) @ x / len(y) + penalty, gradient)
        w -= step * min(1.0, 8 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return w / np.concatenate([[1.0], scale])


def fold(doc_id) -> F.Column:
    """crc32 of doc_id as text, modulo 4; 2 is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4, F.lit(0))


def _count_runs(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text, toxic -> (toxic, run, n), summed over some millions of letters at a time."""
    held: list[list[np.ndarray]] = [[], []]

    def send() -> Iterator[pa.RecordBatch]:
        for label, arrays in enumerate(held):
            if arrays:
                runs, n = np.unique(np.concatenate(arrays), return_counts=True)
                column = pa.array(np.full(len(runs), label, np.int32))
                yield pa.RecordBatch.from_arrays(
                    [column, pa.array(runs.view(np.int64)), pa.array(n)], names=["toxic", "run", "n"]
                )
                arrays.clear()

    size = 0
    for batch in batches(rows):
        for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            for runs, _ in letter_runs(text):
                held[label].append(runs)
                size += len(runs)
                if size > SEND_LETTERS:
                    yield from send()
                    size = 0
    yield from send()


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Models and curve from the labelled rows outside the held-out fold.

    The first rows by a hash of the id give the curve, all others the counts.  A doc_id labelled more
    than once is toxic if one label says so; null labels do not count.
    """
    known = materialize(
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .where("doc_id is not null and toxic in (0, 1)")
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .withColumn("fold", fold(F.col("doc_id")))
        .where("fold <> 2"),
        "labels",
    )
    n_known = known.count()
    small = n_known * 32 <= BROADCAST_BYTES
    n_curve = min(CURVE_ROWS, int(n_known * CURVE_SHARE))
    curve_ids = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n_curve).select("doc_id", "toxic")
    curve_ids = materialize(curve_ids, "curve")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counted_labels = known.join(F.broadcast(curve_ids), "doc_id", "left_anti").select("doc_id", "toxic")
    labelled = texts.join(F.broadcast(counted_labels) if small else counted_labels, "doc_id")
    runs = materialize(
        labelled.select("text", "toxic")
        .mapInArrow(_count_runs, "toxic int, run long, n long")
        .groupBy("toxic", "run")
        .agg(F.sum("n").alias("n")),
        "runs",
    )
    model = Model(_counts(runs))

    seen = texts.join(F.broadcast(curve_ids), "doc_id")
    measured = seen.select("toxic", evidence(model, seen)("text").alias("e")).select("toxic", "e.whole", "e.window").toArrow()
    if measured.num_rows:
        x = np.column_stack([measured.column(c).to_numpy() for c in ("whole", "window")])
        model.curve = fit_curve(x, measured.column("toxic").to_numpy().astype(float))
    return model


def _counts(runs: DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct runs and their counts, of each class."""
    counts = []
    for label in range(2):
        got = runs.where(F.col("toxic") == label).select("run", "n").toArrow()
        counts.append((got.column("run").to_numpy().view(np.uint64), got.column("n").to_numpy()))
    return counts


def evidence(model: Model, df: DataFrame, scored: bool = False):
    """A function of a text column: its evidence, or its score."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def measure(texts: pa.Array) -> np.ndarray:
        return np.array([shared.value.evidence(t.as_py()) for t in texts]).reshape(-1, 2)

    @F.arrow_udf("whole double, window double")
    def both(texts: pa.Array) -> pa.Array:
        found = measure(texts)
        return pa.StructArray.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["whole", "window"])

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(shared.value.score(measure(texts)))

    return score if scored else both


def with_scores(docs: DataFrame, labels: DataFrame, name: str = "score") -> DataFrame:
    """The documents with one more column, their toxicity score from 0 to 1.

    ``docs`` needs doc_id and text, ``labels`` doc_id and toxic (0 or 1).  Every row is scored
    from its whole text alone; null counts as empty, and an empty text gets the score of no
    evidence.  Without labelled rows all scores are 0.  Other columns pass through; where the table already has a
    column of the new name, the new one gets a number behind its name.
    """
    model = train(docs, labels)
    return docs.withColumn(free_name(docs.columns, name), evidence(model, docs, scored=True)("text"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The documents whose score is below the threshold, with their own columns."""
    name = "toxicity_score"
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    return with_scores(docs, labels, name).where(F.col(name) < threshold).select(*[F.col(f"`{c}`") for c in docs.columns])
