"""Toxicity by a gap-weighted subsequence-kernel SVM with Nystroem landmarks.

The kernel of two strings sums, over their common subsequences of three letters, decay to the power of the spans that
they take in both. Only the letters in between are limited (SPAN); digits, marks and blanks between letters cost decay
and no more, so an insult is recognised whatever is put between its letters. Landmarks are units of labelled training
sentences: words, runs of spelled-out letters, and phrases of two words. A unit's features are its kernels with the
landmarks times the inverse root of the landmarks' own kernel matrix. A linear SVM on these is trained over labelled
sentences as bags of units: a toxic document has at least one toxic unit, a clean one has none. Phrases are looked for
in the sentences of toxic documents that no single unit explains, and are formed of words that resemble theirs.

The decision function of such an SVM is itself a weighting of three-letter subsequences, which is how units are
scored: exactly the Nystroem decision, at the price of one table lookup per subsequence. Distinct units are scored once
per Python worker while they stay in its cache.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pathloom.llm.common import DOCUMENT_COLUMNS, documents, small_batches, staged

ORDER, SPAN, DECAY = 3, 6, 0.6
UNIT, STEP = 32, 16
SYMBOLS = 64
#: The sample of labelled rows that a model is fitted on: documents of each class and their bytes, at most, and of their
#: units the clean ones that are trained on and those of a toxic document that may stand for its label.
PER_CLASS, CLASS_BYTES, CLEAN_UNITS, WITNESSES = 1200, 32 << 20, 10_000, 3
LANDMARKS, PHRASES = 192, 32
#: Kernel with a phrase's word from which on a word may stand for it.
RESEMBLES = 0.6
FOLDS = 5
#: Windows that are looked at in one go.
BATCH = 4000
EDGES = ".,;:!?\"'()[]{}|<>*_-~`"
SENTENCE_END = re.compile(r"[.!?][\"')\]]*$")


def spelled(words: list[str]) -> list[str]:
    """Runs of three or more single letters in a sentence, joined: insults that are spelled out, with marks or without."""
    out, run = [], []
    for w in [*words, "##"]:
        letter = w if len(w) == 1 else w.strip(EDGES)
        if len(letter) == 1:
            run.append(letter)
        if len(letter) != 1 or SENTENCE_END.search(w):
            if len(run) >= ORDER:
                out.append("".join(run))
            run = []
    return out


def units_of(text: str) -> list[str]:
    words = text.split()
    return words + (spelled(words) if any(len(w) <= 3 for w in words) else [])


def adjacent(text: str) -> list[tuple[str, str]]:
    """Words that follow each other in a sentence, as they are in the text."""
    words = text.split()
    return [(a, b) for a, b in zip(words, words[1:]) if not SENTENCE_END.search(a)]


def phrase(a: str, b: str) -> str:
    return f"{a.lower().strip(EDGES)} {b.lower().strip(EDGES)}"


def symbols(characters: np.ndarray) -> np.ndarray:
    """The symbol of each code point: 1 to 26 for a-z, others by hash for other letters; 0, for digits and marks, is a gap."""
    out = np.where((characters >= 97) & (characters <= 122), characters - 96, 0)
    for n in np.unique(characters[(characters > 122) | ((characters >= 65) & (characters <= 90))]).tolist():
        if chr(n).isalpha():
            out[characters == n] = 27 + n * 2654435761 % (SYMBOLS - 27)
    return out


OFFSETS = [(a, b) for a, b in combinations(range(1, SPAN), 2)]
POWERS = DECAY ** np.arange(UNIT + 2.0)


def features(units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(unit, subsequence code, weight) of every subsequence of units, added up by code; weights of a unit have norm 1.

    A subsequence's letters lie within SPAN letters; its weight falls with all characters that it spans. Units longer
    than UNIT characters must be cut before (windows()). All units are one row of letters, each knowing where its unit ends.
    """
    sizes = np.array([len(u) for u in units], dtype=np.int64)
    whole = symbols(np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64))
    letter = np.flatnonzero(whole)
    code, unit = whole[letter], np.repeat(np.arange(len(units)), sizes)[letter]
    end = np.searchsorted(unit, unit, side="right")
    at = np.arange(len(letter))
    keys, weights = [np.zeros(0, np.int64)], [np.zeros(0)]
    for second, third in OFFSETS:
        i = at[at + third < end]
        keys.append(((unit[i] * SYMBOLS + code[i]) * SYMBOLS + code[i + second]) * SYMBOLS + code[i + third])
        weights.append(POWERS[letter[i + third] - letter[i] + 1])
    key, weight = np.concatenate(keys), np.concatenate(weights)
    order = np.argsort(key, kind="stable")
    key, weight = key[order], weight[order]
    head = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    weight = np.add.reduceat(weight, head) if len(key) else weight
    at, code = key[head] // SYMBOLS**3, key[head] % SYMBOLS**3
    norm = np.sqrt(np.bincount(at, weight**2, minlength=len(units)))
    return at, code, weight / norm[at]


def windows(unit: str) -> list[str]:
    """The unit in lower case without marks at its ends, cut into overlapping windows if it is long."""
    u = unit.lower().strip(EDGES)
    return [u] if len(u) <= UNIT else [u[i : i + UNIT] for i in range(0, len(u) - STEP, STEP)]


def gram(left: list[str], right: list[str]) -> np.ndarray:
    """Normalised subsequence kernels of all pairs of left and right (a landmark set, so bounded)."""
    at, code, weight = features(right)
    known = np.unique(code)
    dense = np.zeros((len(known) + 1, len(right)), dtype=np.float32)  # the last row is for what no landmark has
    dense[np.searchsorted(known, code), at] = weight
    out = np.zeros((len(left), len(right)))
    for i in range(0, len(left), BATCH // 4):
        at, code, weight = features(left[i : i + BATCH // 4])
        if len(at):
            place = np.minimum(np.searchsorted(known, code), len(known) - 1)
            place[known[place] != code] = len(known)
            head = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
            out[i + at[head]] = np.add.reduceat(dense[place] * weight[:, None].astype(np.float32), head, axis=0)
    return out


@dataclass
class Model:
    """table: the decision's weight of each subsequence; bias; slope and centre of the logistic link to [0, 1].

    marks and alpha: landmarks and their weights, which table adds up; heads and tails: words that phrases consist of.
    """

    table: np.ndarray
    bias: float
    slope: float
    centre: float
    marks: tuple[str, ...] = ()
    alpha: tuple[float, ...] = ()
    heads: tuple[str, ...] = ()
    tails: tuple[str, ...] = ()
    _phrase_words: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    def roles(self, words: list[str]) -> list[int]:
        """Whether each word resembles a phrase's first word (1), its second (2), both (3) or none (0); any window counts."""
        return self.judged(words)[1]

    def phrases(self, text: str, roles: dict[str, int]) -> list[str]:
        """The phrases of a text that are worth a score; roles: those of the words that have any."""
        return [phrase(a, b) for a, b in adjacent(text) if roles.get(a, 0) & 1 and roles.get(b, 0) & 2]

    def decisions(self, units: list[str]) -> np.ndarray:
        """The decision of each unit, of its best window if it is long; -inf for one of fewer than three letters."""
        return self.judged(units)[0]

    def judged(self, units: list[str]) -> tuple[np.ndarray, list[int]]:
        """(decisions, roles) of units, from one pass over their subsequences.

        Only windows that have enough weight on the phrase words' own subsequences can resemble one, since a kernel is at
        most that weight's norm.
        """
        parts = [windows(u) for u in units]
        flat = [w for p in parts for w in p]
        own, known, dense = self.phrase_words()
        out, resembled = np.full(len(flat), self.bias), np.zeros(len(flat), dtype=np.int64)
        for i in range(0, len(flat), BATCH):
            block = flat[i : i + BATCH]
            at, code, weight = features(block)
            here = slice(i, i + len(block))
            out[here] += np.bincount(at, self.table[code] * weight, minlength=len(block))
            out[here][np.bincount(at, minlength=len(block)) == 0] = -np.inf  # nothing is known of such a unit
            if len(known):
                shared = own[code] >= 0
                at, place, weight = at[shared], own[code[shared]], weight[shared]
                near = np.flatnonzero(np.bincount(at, weight**2, minlength=len(block)) >= (RESEMBLES - 1e-4) ** 2)
                keep = np.isin(at, near)
                kernels = np.zeros((len(block), dense.shape[1]))
                np.add.at(kernels, at[keep], dense[place[keep]] * weight[keep, None])
                alike = kernels >= RESEMBLES
                heads = len(self.heads)
                resembled[here] = alike[:, :heads].any(axis=1) + 2 * alike[:, heads:].any(axis=1)
        ends = np.cumsum([len(p) for p in parts])
        starts = np.concatenate(([0], ends[:-1])).astype(np.int64)
        if not len(parts):
            return out, []
        return np.maximum.reduceat(out, starts), np.bitwise_or.reduceat(resembled, starts).tolist()

    def phrase_words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of each subsequence code among those of heads and tails or -1, these codes, their weights by word)."""
        if self._phrase_words is None:
            words = [*self.heads, *self.tails]
            at, code, weight = features(words)
            known = np.unique(code)
            own = np.full(SYMBOLS**3, -1, dtype=np.int64)
            own[known] = np.arange(len(known))
            dense = np.zeros((len(known), len(words)))
            dense[own[code], at] = weight
            self._phrase_words = own, known, dense
        return self._phrase_words

    def probability(self, decision: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * (decision - self.centre), -30, 30)))


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 10.0, rounds: int = 60) -> tuple[np.ndarray, float]:
    """Linear SVM with squared hinge loss by Newton steps; y is -1 or 1."""
    z = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    ridge = np.eye(z.shape[1])
    ridge[-1, -1] = 1e-3
    for _ in range(rounds):
        on = y * (z @ w) < 1
        zs = z[on] * weight[on, None]
        new = np.linalg.solve(ridge + 2 * c * zs.T @ z[on], 2 * c * zs.T @ y[on])
        if np.allclose(new, w, atol=1e-7):
            break
        w = new
    return w[:-1], float(w[-1])


def _best(bags: list[list[str]], value: Callable[[str], float], least: float) -> list[str]:
    """Of each bag the WITNESSES units of most value that are above least, the best one in any case."""
    out = []
    for bag in bags:
        first = sorted(bag, key=lambda u: (-value(u), u))[:WITNESSES]
        out += [u for i, u in enumerate(first) if i == 0 or value(u) > least]
    return out


def _altered(unit: str, rng: np.random.Generator) -> list[str]:
    """The unit with a mark between all letters and with one character put in: what the kernel is to see through."""
    at = int(rng.integers(1, max(2, len(unit))))
    mark = str(rng.choice(list("-.*_1x")))
    return [mark.join(unit)[:UNIT], (unit[:at] + mark + unit[at:])[:UNIT]]


def _counts(bags: list[set], labels: list[int]) -> dict[object, list[int]]:
    """In how many clean and toxic bags each thing is."""
    count: dict[object, list[int]] = {}
    for bag, label in zip(bags, labels):
        for u in bag:
            count.setdefault(u, [0, 0])[label] += 1
    return count


def _odds(count: dict, n: list[int]) -> dict:
    return {u: np.log((c[1] + 0.5) / (n[1] + 1)) - np.log((c[0] + 0.5) / (n[0] + 1)) for u, c in count.items()}


def _trained(marks: list[str], positives: list[str], many: dict[str, int], negatives: list[str], negative_weight: np.ndarray, rng: np.random.Generator) -> Model:
    """An SVM on Nystroem features of positives (with altered ones) and negatives, written as a table of subsequences."""
    values, vectors = np.linalg.eigh(gram(marks, marks))
    good = values > 1e-4
    root = vectors[:, good] / np.sqrt(values[good])
    altered = [v for u in positives for v in _altered(u, rng)]
    x = np.vstack([gram(positives + altered, marks) @ root, gram(negatives, marks) @ root])
    y = np.concatenate([np.ones(len(positives) + len(altered)), -np.ones(len(negatives))])
    weight = np.concatenate([[1 + np.log1p(many.get(u, 1)) * 3 for u in positives], np.ones(len(altered)), negative_weight])
    w, bias = _svm(x, y, weight)
    alpha = root @ w
    at, code, value = features(marks)
    table = np.bincount(code, value * alpha[at], minlength=SYMBOLS**3)
    return Model(table, bias, 6.0, 0.0, tuple(marks), tuple(alpha.tolist()))


def fit(texts: list[str], labels: list[int], seed: int = 7) -> Model:
    """A model from labelled documents; without both classes, one that calls everything clean."""
    same: dict[str, str] = {}  # one string object for a unit wherever it stands
    bags = [sorted({same.setdefault(w, w) for u in units_of(t) for w in windows(u) if len(w) >= ORDER}) for t in texts]
    count = _counts(bags, labels)
    n = [labels.count(0), labels.count(1)]
    if not min(n) or not count:
        return Model(np.zeros(SYMBOLS**3), -1.0, 4.0, 0.0)
    odds = _odds(count, n)
    # Candidates for toxic landmarks: in several toxic documents and, for its frequency, in almost no clean one.
    ranked = sorted((u for u in count if count[u][1] >= 2 and odds[u] > 1), key=lambda u: (-count[u][1] * odds[u], u))
    rng = np.random.default_rng(seed)
    clean = sorted(u for u, c in count.items() if c[0])
    frequent = sorted(clean, key=lambda u: (-count[u][0], u))[: CLEAN_UNITS // 4]
    some = {clean[i] for i in rng.permutation(len(clean))[: CLEAN_UNITS - len(frequent)]}
    negatives = sorted(some.union(frequent))
    half = LANDMARKS // 2
    toxic = ranked[:half] or sorted(count)[:1]
    marks = list(dict.fromkeys(toxic + [negatives[i] for i in rng.permutation(len(negatives))[:half]]))
    negative_weight = np.array([1 + np.log1p(count[u][0]) for u in negatives])
    candidates = [bag for bag, label in zip(bags, labels) if label and bag]
    strong = {u: o * np.log1p(count[u][1]) for u, o in odds.items() if o > 1}
    witness = _best(candidates, lambda u: strong.get(u, -1.0), 0.0)
    everything = sorted({u for c in candidates for u in c})
    model, many = None, {}
    for _ in range(2):
        many = dict(Counter(witness))
        model = _trained(marks, sorted(many), many, negatives, negative_weight, rng)
        score = dict(zip(everything, model.decisions(everything)))
        witness = _best(candidates, score.__getitem__, 0.0)

    every = sorted(count)
    value = dict(zip(every, model.decisions(every).tolist()))
    top = np.array([max(map(value.__getitem__, bag), default=model.bias) for bag in bags])
    is_toxic = np.array(labels) == 1
    apart_from = max(0.0, float(np.quantile(top[~is_toxic], 0.98)))  # what single units must exceed to explain a label
    found = _phrases_of([t for t, y, v in zip(texts, labels, top) if y and v <= apart_from], [t for t, y in zip(texts, labels) if not y])
    if found:
        alone = sorted({w for pair in found for w in pair})
        heads, tails = sorted({a for a, _ in found}), sorted({b for _, b in found})
        explained = sorted(u for u in many if value[u] > apart_from)
        named = {phrase(*pair): k for pair, k in found.items()}
        probe = Model(model.table, 0.0, 1.0, 0.0, (), (), tuple(heads), tuple(tails))
        words = sorted({w for t, y in zip(texts, labels) if not y for w in t.split()})
        roles = dict(zip(words, probe.roles(words)))
        apart = {p for t, y in zip(texts, labels) if not y for p in probe.phrases(t, roles)}
        against = sorted({*negatives, *alone, *apart} - named.keys())
        weight = np.array([1 + np.log1p(count.get(u, [1])[0]) + 3 * (u in alone or u in apart) for u in against])
        model = _trained(list(dict.fromkeys([*marks, *named, *alone])), [*explained, *named], {**many, **named}, against, weight, rng)
        model.heads, model.tails, model._phrase_words = tuple(heads), tuple(tails), None
        top = best_decisions(model, zlib.crc32(model.table.tobytes()), texts)
    # The link: halfway between what clean and toxic documents reach at the threshold with the fewest errors.
    top = np.maximum(top, model.bias)
    at = np.unique(top)
    cuts = np.concatenate(([at[0] - 1], (at[1:] + at[:-1]) / 2, [at[-1] + 1]))
    errors = np.searchsorted(np.sort(top[is_toxic]), cuts) + is_toxic.size - is_toxic.sum() - np.searchsorted(np.sort(top[~is_toxic]), cuts)
    best = cuts[errors == errors.min()]  # ties go to the middle of the widest gap
    model.centre = float(best[len(best) // 2])
    return model


def _phrases_of(unexplained: list[str], clean: list[str]) -> dict[tuple[str, str], int]:
    """Pairs of words that follow each other in several unexplained texts and, for their frequency, in almost no clean one."""
    least = max(3, len(unexplained) // 50)
    if len(unexplained) < least:
        return {}
    def pairs(t: str) -> set[tuple[str, str]]:
        bare = [w.strip(EDGES) for w in t.lower().split()]
        ends = [bool(SENTENCE_END.search(w)) for w in t.split()]
        return {(a, b) for a, b, end in zip(bare, bare[1:], ends) if not end}


    count = _counts([pairs(t) for t in [*unexplained, *clean]], [1] * len(unexplained) + [0] * len(clean))
    odds = _odds(count, [len(clean), len(unexplained)])
    ranked = sorted((p for p in count if count[p][1] >= least and odds[p] > 1 and min(map(len, p)) > 0 and len(" ".join(p)) <= UNIT), key=lambda p: (-count[p][1] * odds[p], p))
    return {p: count[p][1] for p in ranked[:PHRASES]}


def training_rows(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, class_bytes: int = CLASS_BYTES) -> DataFrame:
    """(doc_id, text, toxic) of labelled documents outside the held-out fold: of each class the first per_class by digest
    order, and of these as many as class_bytes hold. Texts are whole.

    Texts over a 32nd of class_bytes come last, so that a large one never keeps others out. If not even one text of a
    class fits, its smallest is taken all the same, so a class that is labelled is never empty.
    """
    known = labels.where("toxic is not null and doc_id is not null").select("doc_id", "toxic").where(F.crc32(F.col("doc_id").cast("string")) % FOLDS != 0)
    digest = F.xxhash64("doc_id", F.lit("toxicity"))
    chosen = known.where("toxic = 1").orderBy(digest, "doc_id").limit(per_class).union(known.where("toxic = 0").orderBy(digest, "doc_id").limit(per_class))
    rows = staged(docs.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic"), "labelled")
    sizes = rows.select("doc_id", "toxic", F.octet_length("text").cast("long").alias("size"))  # a row for each of the sample
    order = [F.col("size") > class_bytes // 32, digest, F.col("doc_id"), F.col("size")]
    before = F.sum("size").over(W.partitionBy("toxic").orderBy(*order).rowsBetween(W.unboundedPreceding, -1))
    smallest = F.row_number().over(W.partitionBy("toxic").orderBy("size", "doc_id"))
    ranked = sizes.withColumns({"before": F.coalesce(before, F.lit(0)), "smallest": smallest})
    fits = F.col("before") + F.col("size") <= class_bytes
    some = F.max(fits.cast("int")).over(W.partitionBy("toxic"))
    taken = ranked.withColumn("some", some).where(fits | ((F.col("some") == 0) & (F.col("smallest") == 1)))
    return rows.join(F.broadcast(taken.select("doc_id", "toxic", F.col("size").alias("_size")).distinct()), ["doc_id", "toxic"]).where(F.octet_length("text") == F.col("_size")).select("doc_id", "text", "toxic")


def fit_labelled(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """The model of the labelled rows; the bounded sample is fitted on in one task, so that the driver only gets the model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(row for batch in batches for row in zip(*(batch.column(i).to_pylist() for i in range(3))))
        model = fit([t for _, t, _ in rows], [int(y) for _, _, y in rows])
        model._phrase_words = None
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    small_batches(docs.sparkSession)
    found = training_rows(docs, labels, per_class).repartition(1).mapInArrow(run, "model binary").first()
    return fit([], []) if found is None else pickle.loads(found.model)


_SCORES: dict[int, tuple[dict[str, float], dict[str, int]]] = {}
KNOWN_UNITS, KNOWN_CHARACTERS = 400_000, 1000


def best_decisions(model: Model, key: int, texts: list[str | None]) -> np.ndarray:
    """The largest decision of each text's units; a text without units gets the lowest that the link tells apart."""
    if key not in _SCORES:
        _SCORES.clear()
    known, roles = _SCORES.setdefault(key, ({}, {}))
    if len(known) > KNOWN_UNITS:
        known.clear()
        roles.clear()
    lists = [units_of(t) if t else [] for t in texts]
    new = list(set().union(*lists).difference(known))
    decided, resembled = model.judged(new)
    known.update(zip(new, decided.tolist()))
    if model.heads:
        roles.update((u, r) for u, r in zip(new, resembled) if r)
        pairs = [model.phrases(t, roles) if t else [] for t in texts]
        lists = [units + more for units, more in zip(lists, pairs)]
        spoken = list(set().union(*pairs).difference(known))
        known.update(zip(spoken, model.decisions(spoken).tolist()))
        new += spoken
    low = model.centre - 30 / model.slope
    best = np.maximum(low, np.array([max(map(known.__getitem__, units), default=low) for units in lists], dtype=float))
    for unit in new:
        if len(unit) > KNOWN_CHARACTERS:  # long ones are not worth their place
            known.pop(unit, None)
            roles.pop(unit, None)
    return best


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, decision, score) of every row of docs: the largest decision of a text's units through the link.

    Empty and null texts have no unit and score as low as the link goes. Repeated rows are scored as often as they
    came; rows without doc_id are scored too. Further columns are ignored.
    """
    key = zlib.crc32(model.table.tobytes())
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size: one weight per subsequence

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best = best_decisions(shared.value, key, batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best), pa.array(shared.value.probability(best))], names=["doc_id", "decision", "score"])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, decision double, score double")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit_labelled(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held_out = F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0
    return scores(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the model calls clean, in one pass: rows keep their columns while they are scored.

    Null and empty texts are clean. Every row is judged by its text alone, so rows that repeat go or stay together.
    """
    model = fit_labelled(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    shared, key = spark.sparkContext.broadcast(model), zlib.crc32(model.table.tobytes())
    plain = docs.select(DOCUMENT_COLUMNS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best = best_decisions(shared.value, key, batch.column(1).to_pylist())
            yield batch.filter(pa.array(shared.value.probability(best) < 0.5))

    small_batches(spark)
    return plain.mapInArrow(run, plain.schema)
