"""Toxicity: a support vector machine with a subsequence string kernel and Nyström landmarks, trained on the sentences of labelled texts.

The kernel compares strings by their subsequences of three letters, each
weighted by ``DECAY`` to the power of the span it takes, up to ``SPAN``, so that an insult with
inserted letters or with other endings stays close to the insult. Sentences are
read through units: words in lower case without punctuation, with common
digit-for-letter swaps undone, runs of single letters (``i d i o t``) joined, and
pairs of common words next to each other in a sentence, with the break as a letter, so that phrases of ordinary
words count. Start and end of a unit count as letters. Longer units are read through windows of ``LONGEST`` letters.

Landmarks are units of the labelled texts: those most typical of toxic texts
and common others, each far from the ones before. The kernel's square root on
the landmarks gives the features, on which a linear machine with
squared hinge loss is trained. It learns from the texts' labels alone, as a
machine for bags: a text is as toxic as its most toxic unit, so the examples are
the most toxic unit of each toxic text (and the next one if it is judged toxic) and, of each other text, the two
most toxic ones and one by chance. Which ones these are is judged by the machine of the round
before, ``rounds`` times; in the first round by how typical of toxic texts the
units are. The decision on a unit is a sum over landmarks of kernel values,
hence of weights per subsequence, so a unit is judged by table look-ups without
meeting the landmarks again. A text's decision is that of its most toxic unit; a logistic
curve fitted on texts turns it into a score.

Bounds, all on what is learnt, none on what is scored: ``sample_rows`` labelled
rows (the first ones by a hash of their id), of which equal texts count once;
``landmarks`` landmarks, chosen among ``candidates`` units of each kind; pairs of the
``candidates`` most common words. Nulls score as empty texts.
Without labels of both kinds the score is the smoothed share of toxic
labels (0.5 without labels). Repeated rows are scored each; an empty table
gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.arrays import slices, text_column
from tickloom.llm.quality_model import held_out, labelled
from tickloom.llm.tables import forget, give_back, lean, narrowed, written

SAMPLE_ROWS = 16_000
DECAY = 0.6
SPAN = 9
LONGEST = 24
LETTERS = 64
ROUNDS = 3
FLOOR = -3.0
CANDIDATES, LANDMARKS = 2000, 384
MEMO = 150_000
CHUNK = 1 << 14

#: Digits and signs that stand for letters.
SWAPS = (b"0134578@$", b"oieastbas")
_case = bytes(range(256)).translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))).translate(bytes.maketrans(b"\t\n\v\f\r", b"     "))
_drop = bytes(b for b in range(33, 127) if not chr(b).isalnum() and b not in b"@$")
_swap = bytes.maketrans(*SWAPS)
_has_letter = re.compile(rb"[a-z]")
_spelled = re.compile(rb"(?<![^ ])(?:[a-z0134578@$] +){2,}[a-z0134578@$](?![^ ])")
_end = re.compile(rb"[.!?]+\s|\n")
STOP = b"\1"
_class = np.array([b - 96 if 97 <= b <= 122 else 27 + b % 36 for b in range(256)], np.int64)


def units(text: bytes, common: frozenset[bytes] = frozenset()) -> set[bytes]:
    """The words of a text and the pairs of ``common`` words next to each other in a sentence."""
    clean = _end.sub(b" \1 ", text).translate(_case).translate(None, _drop)
    words = clean.split()
    found = set(words)
    if common:
        found.update([a + b" " + b for a, b in zip(words, words[1:]) if a in common and b in common])
    if b"$" in clean or b"@" in clean or any(map(clean.__contains__, b"0134578")):
        found = {w.translate(_swap) if _has_letter.search(w) else w for w in found}
    for run in _spelled.findall(clean):
        if _has_letter.search(run):
            found.add(run.replace(b" ", b"").translate(_swap))
    found.discard(STOP)
    return {x for w in found for x in windows(w)} if any(len(w) > LONGEST for w in found) else found


def windows(word: bytes) -> Iterable[bytes]:
    if len(word) <= LONGEST:
        return (word,)
    return [word[i : i + LONGEST] for i in range(0, len(word) - LONGEST // 2, LONGEST // 2)]


_places: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def places(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of strings of length n: the places of all subsequences of three, and their weights, which have length 1."""
    if n not in _places:
        at = np.array([x for x in combinations(range(n), 3) if x[2] - x[0] < SPAN], np.int64)
        weight = DECAY ** (at[:, 2] - at[:, 0] + 1)
        _places[n] = at, weight / np.sqrt((weight**2).sum())
    return _places[n]


def subsequences(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(code of each subsequence of each string, weights) for strings of one length."""
    at, weight = places(len(strings[0]) + 2)
    letters = np.zeros((len(strings), len(strings[0]) + 2), np.int64)  # letters of their own stand for start and end
    letters[:, -1] = LETTERS - 1
    letters[:, 1:-1] = _class[np.frombuffer(b"".join(strings), np.uint8).reshape(len(strings), -1)]
    return (letters[:, at[:, 0]] * LETTERS + letters[:, at[:, 1]]) * LETTERS + letters[:, at[:, 2]], weight


def by_length(strings: Iterable[bytes]) -> dict[int, list[bytes]]:
    out: dict[int, list[bytes]] = {}
    for s in strings:
        out.setdefault(len(s), []).append(s)
    return out


def features(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(dense weights of the strings' subsequences over ascending codes, the codes). Products of rows are the kernel."""
    groups = by_length(strings)
    codes = np.unique(np.concatenate([subsequences(g)[0].reshape(-1) for g in groups.values()]))
    out = np.zeros((len(strings), len(codes)), np.float32)
    place = {s: i for i, s in enumerate(strings)}
    for group in groups.values():
        c, w = subsequences(group)
        rows = np.array([place[s] for s in group])
        np.add.at(out, (np.broadcast_to(rows[:, None], c.shape), np.searchsorted(codes, c)), np.broadcast_to(w.astype(np.float32), c.shape))
    return out, codes


@dataclass
class Landmarks:
    """The Nyström map: unit to ``map[place[code]]`` summed over its subsequences by weight."""

    place: np.ndarray  # of each of LETTERS**3 codes, 0 for codes of no landmark
    map: np.ndarray  # (1 + codes, features); row 0 is zero

    @staticmethod
    def of(strings: list[bytes]) -> Landmarks:
        z, codes = features(strings)
        values, vectors = np.linalg.eigh((z @ z.T).astype(float))
        clear = values > 1e-3 * values[-1]  # directions that the landmarks determine
        map_ = z.T @ (vectors[:, clear] / np.sqrt(values[clear])).astype(np.float32)
        place = np.zeros(LETTERS**3, np.int32)
        place[codes] = np.arange(1, 1 + len(codes))
        return Landmarks(place, np.concatenate([np.zeros((1, map_.shape[1]), np.float32), map_]))

    def features(self, strings: Iterable[bytes]) -> dict[bytes, np.ndarray]:
        out: dict[bytes, np.ndarray] = {}
        for group in by_length(strings).values():
            for k in range(0, len(group), 64):
                some = group[k : k + 64]
                codes, w = subsequences(some)
                out.update(zip(some, np.einsum("ijk,j->ik", self.map[self.place[codes]], w.astype(np.float32)), strict=True))
        return out


@dataclass
class Machine:
    """Weights per subsequence and a bias, and the curve from decisions to scores."""

    weights: np.ndarray  # over all LETTERS**3 codes; or, of a first round, none
    bias: float
    slope: float = 1.0
    shift: float = 0.0
    prior: float | None = None  # of a machine that could not be trained
    common: frozenset[bytes] = frozenset()  # words whose pairs are units
    typical: dict[bytes, float] = field(default_factory=dict)  # decisions on units of a first round
    memo: dict[bytes, float] = field(default_factory=dict)

    def learn(self, new: Iterable[bytes]) -> None:
        if not len(self.weights):
            self.memo.update((u, self.typical.get(u, 0.0)) for u in new)
            return
        for n, group in by_length(new).items():
            step = max(1, CHUNK * 32 // len(places(n + 2)[0]))
            for i in range(0, len(group), step):
                some = group[i : i + step]
                codes, w = subsequences(some)
                self.memo.update(zip(some, (self.weights[codes] @ w).tolist(), strict=True))

    def judged(self, texts: list[bytes]) -> Iterator[tuple[set[bytes], Callable[[bytes], float]]]:
        """The units of each text, and the decisions on units, less the bias."""
        waiting, new = [], set()
        for text in [*texts, None]:
            if text is None or len(new) > CHUNK:
                if len(self.memo) > MEMO:
                    self.memo.clear()
                    new = set().union(*waiting)
                self.learn(new)
                yield from ((w, self.memo.__getitem__) for w in waiting)
                waiting, new = [], set()
            if text is not None:
                waiting.append(units(text, self.common))
                new |= waiting[-1].difference(self.memo)

    def decisions(self, texts: list[bytes]) -> list[float]:
        return [max(map(of, found), default=FLOOR) + self.bias for found, of in self.judged(texts)]

    def column(self, docs: DataFrame, text: str = "text") -> Column:
        """The decision on a column of ``docs``; only that column goes to Python. What a task learns of units it forgets at its end."""
        held = docs.sparkSession.sparkContext.broadcast(self)  # LETTERS**3 weights, whatever the input

        @F.arrow_udf("double")
        def decide(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
            m = held.value
            try:
                for column in columns:
                    batch = pa.RecordBatch.from_arrays([column], ["text"])
                    d = [m.decisions(text_column(part).cast(pa.binary()).to_pylist()) for part in slices(batch)]
                    yield pa.array([x for part in d for x in part], pa.float64())
            finally:
                m.memo.clear()
                give_back()

        return decide(text)


def unit_counts(texts: DataFrame, common: frozenset[bytes] = frozenset()) -> DataFrame:
    """unit, n (distinct texts that have it), toxic (those labelled so), from distinct rows with text and y."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                n: dict[bytes, list[int]] = {}
                for text, y in zip(text_column(part).cast(pa.binary()).to_pylist(), part.column("y").to_pylist(), strict=True):
                    for u in units(text, common):
                        c = n.setdefault(u, [0, 0])
                        c[0] += 1
                        c[1] += y
                yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.binary()), pa.array([c[0] for c in n.values()], pa.int64()), pa.array([c[1] for c in n.values()], pa.int64())], ["unit", "n", "toxic"])

    return texts.select("text", "y").mapInArrow(lean(run), "unit binary, n long, toxic long").groupBy("unit").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))


def chosen(rows: np.ndarray, most: int) -> list[int]:
    """Rows of about unit length, each far from those before."""
    if not len(rows):
        return []
    at, near = [0], rows @ rows[0]
    while len(at) < min(most, len(rows)):
        nxt = int(near.argmin())
        if near[nxt] > 0.95:
            break
        at.append(nxt)
        near = np.maximum(near, rows @ rows[nxt])
    return at


def squared_hinge(x: np.ndarray, y: np.ndarray, support: np.ndarray, cost: float = 10.0, steps: int = 60) -> tuple[np.ndarray, float]:
    """Weights and bias by Newton's method with halved steps where a whole one does not help; classes weigh the same in total."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    weigh = np.where(y > 0, 0.5 / support[y > 0].sum(), 0.5 / support[y < 0].sum()) * support * len(y) * cost
    ridge = np.full(x1.shape[1], 1.0)
    ridge[-1] = 1e-3

    def loss(w: np.ndarray) -> float:
        return float((ridge * w * w).sum() + (weigh * np.maximum(1 - y * (x1 @ w), 0) ** 2).sum())

    w = np.zeros(x1.shape[1])
    now = loss(w)
    for _ in range(steps):
        active = y * (x1 @ w) < 1
        a, c = x1[active], weigh[active]
        step = np.linalg.solve(np.diag(ridge) + a.T @ (a * c[:, None]), a.T @ (c * y[active])) - w
        size = 1.0
        while size > 1e-4 and (then := loss(w + size * step)) > now:
            size /= 2
        if size <= 1e-4 or now - then < 1e-9 * now:
            break
        w, now = w + size * step, then
    return w[:-1], float(w[-1])


def curve(d: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve with smoothed targets and classes of equal weight, by Newton's method."""
    n1, n0 = y.sum(), len(y) - y.sum()
    t, c = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2)), np.where(y > 0, 0.5 / n1, 0.5 / n0) * len(y)
    x, w = np.stack([d, np.ones(len(d))], 1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-(x @ w)))
        w = w + np.linalg.solve((x * (c * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (c * (t - p)) - 1e-3 * w)
    return float(w[0]), float(w[1])


def examples(texts: DataFrame, machine: Machine, landmarks: Landmarks) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, labels, how often) of the units that a round trains on: of each toxic text its most toxic ones, of each other text two and one by chance."""
    held = texts.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        try:
            for batch in batches:
                for part in slices(batch):
                    some, y = [], []
                    judged = m.judged(text_column(part).cast(pa.binary()).to_pylist())
                    for (found, of), label, h in zip(judged, part.column("y").to_pylist(), part.column("h").to_pylist(), strict=True):
                        best = sorted(found, key=lambda u: (-of(u), u))
                        if label:
                            # In the first round texts without a typical unit have no example.
                            best = [u for i, u in enumerate(best[:2]) if of(u) + m.bias > 0 or not i and len(m.weights)]
                        elif best:
                            best = [*best[:2], best[h % len(best)]]
                        some += best
                        y += [label] * len(best)
                    yield pa.RecordBatch.from_arrays([pa.array(some, pa.binary()), pa.array(y, pa.int32())], ["unit", "y"])
        finally:
            m.memo.clear()

    rows = texts.select("text", "y", "h").mapInArrow(lean(run), "unit binary, y int").groupBy("unit", "y").count().orderBy("unit", "y").collect()
    units_ = [bytes(r["unit"]) for r in rows]
    of = landmarks.features(set(units_))
    return np.stack([of[u] for u in units_]) if rows else np.empty((0, 1)), np.array([r["y"] for r in rows], float), np.array([r["count"] for r in rows], float)


def train(docs: DataFrame, labels: DataFrame, target: str = "toxic", sample_rows: int = SAMPLE_ROWS, landmarks: int = LANDMARKS, candidates: int = CANDIDATES, rounds: int = ROUNDS) -> Machine:
    sample = labelled(labels, target, sample_rows)
    texts = narrowed(docs, doc_id="doc_id", text="text").join(F.broadcast(sample), "doc_id").withColumn("h", F.xxhash64("text").bitwiseAND(F.lit((1 << 62) - 1)))
    texts = written(texts.select("text", "y", "h").dropDuplicates(["h", "y"]).repartition(max(12, sample_rows // 1000), "h"), "sample")
    n, n1 = texts.agg(F.count(F.lit(1)), F.sum("y")).first()
    share = ((n1 or 0) + 0.5) / (n + 1)
    none = Machine(np.zeros(0), 0.0, prior=float(share))
    if not n1 or n1 == n:
        return none
    words = written(unit_counts(texts), "words")
    frequent = frozenset(bytes(r["unit"]) for r in words.orderBy(F.desc("n"), "unit").limit(candidates).collect())
    forget(words)
    counts = written(unit_counts(texts, frequent), "units")
    # How many deviations more toxic texts have the unit than would by chance.
    beyond = F.expr(f"(toxic - n * {share!r}D) / sqrt((n + 1) * {share * (1 - share)!r}D)")
    typical = counts.select("unit", beyond.alias("z")).where("z > 0").orderBy(F.desc("z"), "unit").limit(candidates).collect()
    common = counts.where(beyond <= 0).orderBy(F.desc("n"), "unit").limit(candidates).collect()
    forget(counts)
    if not typical:
        return none
    marks = []
    for some, most in (([bytes(r["unit"]) for r in typical], 2 * landmarks // 3), ([bytes(r["unit"]) for r in common], landmarks // 3)):
        marks += [some[i] for i in chosen(features(some)[0], most)] if some else []
    nystroem = Landmarks.of(marks)
    least = min(4.0, typical[0]["z"] / 2)
    machine = Machine(np.zeros(0), 0.0, common=frequent, typical={bytes(r["unit"]): max(0.0, r["z"] - least) for r in typical})
    for _ in range(rounds):
        x, y, often = examples(texts, machine, nystroem)
        if not len(y) or y.min() == y.max():
            break
        w, bias = squared_hinge(x.astype(float), 2 * y - 1, np.log1p(often))
        machine = Machine((nystroem.map @ w)[nystroem.place], bias, common=frequent)
    if not len(machine.weights):
        return none
    seen = texts.select("y", machine.column(texts).alias("decision")).toPandas()
    machine.slope, machine.shift = curve(seen["decision"].to_numpy(), seen["y"].to_numpy())
    machine.memo.clear()
    forget(texts)
    return machine


def scores(docs: DataFrame, machine: Machine, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    rows = narrowed(docs, doc_id="doc_id", text="text").withColumn("held_out", F.coalesce(held_out("doc_id"), F.lit(False)))
    if machine.prior is not None:
        out = rows.select("doc_id", "held_out", F.lit(machine.prior).alias("score"))
    else:
        score = F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.col("decision") * machine.slope + machine.shift)))
        out = rows.select("doc_id", "held_out", machine.column(rows).alias("decision")).select("doc_id", "held_out", score.alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
