"""Toxicity by a weighted finite-state grammar over clauses.

Words of a clause are read as symbols: insult, threat, target, negation, report, other. Small
transducers, each a table of (state, symbol) -> (state, output), recognise one construction:

* insult and threat accept a word, which then counts with its weight;
* target tells whether someone is named;
* negation remembers a negating word for the next few words;
* reported speech remembers a verb of saying until the end of the clause.

What stands before a word decides as much as what stands after it ("not an idiot", "an idiot, not"),
so a clause is read from the left by one machine and, if it holds an accepted word, from the right by
another; each is the product of its transducers, whose states are tuples of theirs. Both
outputs at a word give its context: reported, negated, aimed at a target, or plain; a threat without a
target counts nowhere. A text's features are, by context, the sums over its matched clauses; a logistic
regression learned on labelled rows turns them into a score. So a word counts by the clause
that it stands in, and what a negation or a quotation is worth is learned.

Words of the fixed lists are only seeds; the classes are learned (``learn``):

* insults: word beginnings and whole words that stand in labelled toxic texts far more often than in
  others, weighted by log odds;
* threats: those of them that nearly always stand in a clause with a target;
* negations and reports: words after which, near or anywhere, an accepted word nearly always is harmless;
* targets: words that hardly stand in other clauses than those with an accepted word.

Learning uses at most ``SAMPLE_ROWS`` labelled rows (documented bound, chosen by a hash of the id) among
those that ``keep`` allows, and of near copies in that sample only one (else the rare words of a text with
many toxic copies would seem telling). Counts are Spark aggregates, of which the driver gets the words that
stand in LEAST_TEXTS texts of the sample or more and tell one class; the regression sees a few numbers a row.

Scoring is one pass over the scan without a shuffle; each task holds one batch of texts.

Results: null and empty texts get the score of a text without matches; texts are read whole; each
input row gives one row, repeated ids included. Labels other than 0 and 1, and ids with both, teach
nothing; without a labelled row of each class the seeds count with fixed weights. Empty
tables give an empty table; extra columns are not read, except to keep them in ``accepted``.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendspark.llm.common import byte_texts, fresh, held, labelled_sample, release, written
from trendspark.llm.ngram_join import FACTORS, ngram_sets

SAMPLE_ROWS = 12_000
CHUNK_BYTES = 1 << 20
SHORTEST, LONGEST = 4, 10
LEAST_TEXTS, LEAST_SHARE = 6, 0.75
THRESHOLD = 0.7
NEGATION_REACH, NEGATION_AFTER = 3, 2
NEARLY_ALWAYS = 0.9

INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER = range(6)
#: Seeds of the grammar's word classes; more are learned.
SEEDS = {
    INSULT: "idiot stupid moron scum loser trash".split(),
    THREAT: "kill killing murder hurt destroy punish stab shoot burn beat töten umbringen tuer matar".split(),
    TARGET: "you your yours u he she they them people du dich dein ihr euch tu toi vous tes tú ti usted vosotros".split(),
    NEGATION: "not never no nicht kein keine nie pas jamais nunca jamás isn't aren't don't".split(),
    REPORT: "said says say saying called calls wrote quoted told claims claimed sagte sagt dit disait dijo dice".split(),
}
PLAIN, AIMED, NEGATED, REPORTED = range(4)
N_FEATURES = 9

WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
CLAUSE = re.compile(r"[.!?;:,\n()\"|]+")


class Transducer:
    """States and a table (state, symbol) -> (next state, output); missing entries stay, emitting 0."""

    def __init__(self, n_states: int, moves: dict[tuple[int, int], tuple[int, int]]):
        self.n_states, self.moves = n_states, moves

    def step(self, state: int, symbol: int) -> tuple[int, int]:
        return self.moves.get((state, symbol), (state, 0))


def accept(symbol: int) -> Transducer:
    return Transducer(1, {(0, symbol): (0, 1)})


def once_seen(symbol: int) -> Transducer:
    """1 for every word after the first one of the symbol."""
    return Transducer(2, {(0, symbol): (1, 0)} | {(1, s): (1, 1) for s in range(6)})


def within(symbol: int, reach: int) -> Transducer:
    """1 for ``reach`` words after each of the symbol; states count them down."""
    return Transducer(reach + 1, {(s, x): (reach, int(s > 0)) if x == symbol else (max(0, s - 1), int(s > 0)) for s in range(reach + 1) for x in range(6)})


def grammar() -> tuple[dict[str, Transducer], dict[str, Transducer]]:
    """The transducers that read a clause from the left, and those that read it from the right."""
    left = {"insult": accept(INSULT), "threat": accept(THREAT), "target": once_seen(TARGET), "negation": within(NEGATION, NEGATION_REACH), "report": once_seen(REPORT)}
    right = {"target": once_seen(TARGET), "negation": within(NEGATION, NEGATION_AFTER), "report": once_seen(REPORT)}
    return left, right


def compose(parts: dict[str, Transducer]) -> list[list[tuple[int, frozenset[str]]]]:
    """The product machine: for each state and symbol the next state, and the names of the parts that put out 1."""
    start = (0,) * len(parts)
    index, todo, table = {start: 0}, [start], []
    while len(table) < len(todo):
        state, row = todo[len(table)], []
        for symbol in range(6):
            moves = [p.step(s, symbol) for p, s in zip(parts.values(), state, strict=True)]
            after = tuple(m[0] for m in moves)
            if after not in index:
                index[after] = len(todo)
                todo.append(after)
            row.append((index[after], frozenset(name for name, m in zip(parts, moves, strict=True) if m[1])))
        table.append(row)
    return table


def context(before: frozenset[str], after: frozenset[str]) -> int:
    """The feature of a word by what the two machines put out at it; -1: it counts nowhere."""
    said = before | after
    if not said & {"insult", "threat"} or "insult" not in said and "target" not in said:
        return -1
    return REPORTED if "report" in said else NEGATED if "negation" in said else AIMED if "target" in said else PLAIN


class Machine:
    """Both product machines of a grammar and what their outputs mean."""

    def __init__(self, left: dict[str, Transducer], right: dict[str, Transducer]):
        self.left, self.right = compose(left), compose(right)
        outputs = lambda table: {out for row in table for _, out in row}
        self.context = {(a, b): context(a, b) for a in outputs(self.left) for b in outputs(self.right)}

    def read(self, symbols: list[int]) -> list[int]:
        """The context of each word of a clause."""
        state, before = 0, []
        for s in symbols:
            state, out = self.left[state][s]
            before.append(out)
        state, after = 0, []
        for s in reversed(symbols):
            state, out = self.right[state][s]
            after.append(out)
        return [self.context[pair] for pair in zip(before, reversed(after), strict=True)]


@dataclass
class Model:
    """Word beginnings and whole words ("word$") with weights, those of them that are threats, the symbols
    of other words, and the regression's weights."""

    lexicon: dict[str, float] = field(default_factory=dict)
    weights: list[float] = field(default_factory=lambda: [-3.0, 1.5, 2.0, 0.3, 0.3, 0.5, 0.5, 0.0, 0.0])
    threats: frozenset[str] = frozenset()
    learned: dict[str, int] = field(default_factory=dict)

    def __post_init__(self):
        self.machine = Machine(*grammar())
        self.symbol = self.learned | {w: k for k, ws in SEEDS.items() if k != INSULT for w in ws}
        self.begins = [n for n in range(SHORTEST, LONGEST + 1) if any(len(w) == n and w[-1] != "$" for w in self.lexicon)]
        self.known: dict[str, tuple[int, float]] = {}

    def part(self, word: str) -> str | None:
        """The lexicon's part with the largest weight that the word has."""
        own = [p for p in (word + "$", *(word[:n] for n in self.begins if len(word) >= n)) if p in self.lexicon]
        return max(own, key=lambda p: self.lexicon[p], default=None)

    def read(self, word: str) -> tuple[int, float]:
        """Symbol and weight of a word."""
        got = self.known.get(word)
        if got is None:
            part = self.part(word)
            if part is not None:
                got = (THREAT if part in self.threats or self.symbol.get(word) == THREAT else INSULT, self.lexicon[part])
            else:
                got = (self.symbol.get(word, OTHER), 1.0)
            if len(self.known) > 300_000:
                self.known.clear()
            self.known[word] = got
        return got

    def features(self, text: str) -> np.ndarray:
        """Sum and largest of the clause weights in each context, and the constant."""
        out = np.zeros(N_FEATURES)
        out[0] = 1.0
        read = self.read
        for clause in CLAUSE.split(text.lower()):
            words = WORD.findall(clause)
            symbols = [read(w) for w in words]
            if not any(s <= THREAT for s, _ in symbols):
                continue  # nothing that the grammar accepts
            sums = [0.0] * 4
            for (_, weight), where in zip(symbols, self.machine.read([s for s, _ in symbols]), strict=True):
                if where >= 0:
                    sums[where] += weight
            for k, v in enumerate(sums):
                out[1 + k] += v
                out[5 + k] = max(out[5 + k], v)
        out[1:5] = np.log1p(out[1:5])
        return out

    def score(self, text: str) -> float:
        z = float(self.features(text) @ np.asarray(self.weights))
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, z))))


def without_copies(texts: DataFrame) -> DataFrame:
    """(text, label) without near copies: texts whose sets of word triples have the same least
    hash, by one of three hashes, count once."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            sets = [s for _, texts in byte_texts(batch.column("text"), CHUNK_BYTES) for s in ngram_sets(texts, 3)]
            least = [[int((s * k ^ (s >> np.uint64(23))).min() >> np.uint64(1)) if len(s) else -1 for s in sets] for k in FACTORS[:3]]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(v, pa.int64()) for v in least)], names=[*batch.schema.names, "h0", "h1", "h2"])

    hashed = texts.mapInArrow(run, "text string, label int, h0 long, h1 long, h2 long")
    for h in ("h0", "h1", "h2"):
        first = F.min_by(F.struct("text", "label", "h0", "h1", "h2"), F.struct(F.xxhash64("text"), "text")).alias("row")
        hashed = hashed.groupBy(h).agg(first).select("row.*")
    return written(hashed.select("text", "label"), "toxicity-sample")


def lexicon(texts: DataFrame) -> dict[str, float]:
    """Weighted word beginnings and words from (text, label)."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            counts: dict[str, list[int]] = {}
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
                words = set(WORD.findall(text.lower()))
                for part in {w[:n] for w in words for n in range(SHORTEST, min(LONGEST, len(w)) + 1)} | {w + "$" for w in words if len(w) >= SHORTEST - 1}:
                    counts.setdefault(part, [0, 0])[label] += 1
            yield pa.RecordBatch.from_pydict({"part": list(counts), "clean": [c[0] for c in counts.values()], "toxic": [c[1] for c in counts.values()]}, schema=pa.schema([("part", pa.string()), ("clean", pa.int64()), ("toxic", pa.int64())]))

    n = {r["label"]: r["n"] for r in texts.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not n.get(0) or not n.get(1):
        return {}
    counts = texts.mapInArrow(run, "part string, clean long, toxic long").groupBy("part").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    telling = counts.where((F.col("toxic") >= LEAST_TEXTS) & (F.col("toxic") >= LEAST_SHARE * (F.col("toxic") + F.col("clean"))))
    top = telling.collect()  # parts of words that stand in LEAST_TEXTS toxic texts of a bounded sample
    weight = {r["part"]: math.log((r["toxic"] + 0.5) / (n[1] + 1)) - math.log((r["clean"] + 0.5) / (n[0] + 1)) for r in top}
    # the shortest beginning stands for the longer ones that it covers, a word for the beginnings that only it has
    toxic = {r["part"]: r["toxic"] for r in top}
    of_word = {w[:k] for w in toxic if w[-1] == "$" for k in range(SHORTEST, len(w)) if toxic[w] >= 0.9 * toxic.get(w[:k], math.inf)}
    out: dict[str, float] = {}
    for part in sorted(weight, key=lambda p: (len(p.rstrip("$")), p)):
        stem = part.rstrip("$")
        if part not in of_word and not any(stem[:k] in out for k in range(SHORTEST, len(stem) + 1)):
            out[part] = weight[part]
    return out


def word_classes(texts: DataFrame, model: Model) -> tuple[frozenset[str], dict[str, int]]:
    """(threats, symbols): the lexicon's parts that are threats, and the learned targets, negations and
    reports, from (text, label) with what ``model`` accepts. Seeds keep their class."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            counts: dict[tuple[str, str], list[int]] = {}
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
                seen = set()
                for clause in CLAUSE.split(text.lower()):
                    words = WORD.findall(clause)
                    parts = [model.part(w) for w in words]
                    at = [i for i, p in enumerate(parts) if p is not None]
                    named = any(model.symbol.get(w) == TARGET for w in words)
                    for i, w in enumerate(words):
                        if parts[i] is not None:
                            seen |= {(parts[i], "stands")} | ({(parts[i], "aimed")} if named else set())
                            continue
                        seen.add((w, "any"))
                        if at:
                            seen.add((w, "in"))
                            ahead = [k - i for k in at if k > i]
                            if ahead:
                                seen.add((w, "near" if min(ahead) <= NEGATION_REACH else "ahead"))
                for key in seen:
                    counts.setdefault(key, [0, 0])[label] += 1
            yield pa.RecordBatch.from_pydict({"word": [w for w, _ in counts], "role": [r for _, r in counts], "clean": [c[0] for c in counts.values()], "toxic": [c[1] for c in counts.values()]}, schema=pa.schema([("word", pa.string()), ("role", pa.string()), ("clean", pa.int64()), ("toxic", pa.int64())]))

    counts = texts.mapInArrow(run, "word string, role string, clean long, toxic long").groupBy("word", "role").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    of = lambda role, what: F.sum(F.when(F.col("role") == role, F.col(what)).otherwise(0)).alias(f"{role}_{what}")
    wide = counts.groupBy("word").agg(*(of(r, w) for r in ("stands", "aimed", "any", "in", "near", "ahead") for w in ("clean", "toxic")))
    both = lambda r: F.col(f"{r}_clean") + F.col(f"{r}_toxic")
    harmless = lambda r: (both(r) >= LEAST_TEXTS) & (F.col(f"{r}_clean") >= LEAST_SHARE * both(r))
    kind = (
        F.when((both("stands") >= LEAST_TEXTS) & (both("aimed") >= NEARLY_ALWAYS * both("stands")), THREAT)
        .when(both("stands") > 0, None)
        .when(harmless("near"), NEGATION)
        .when(harmless("ahead"), REPORT)
        .when((F.col("in_toxic") >= LEAST_TEXTS) & (both("in") >= LEAST_SHARE * both("any")), TARGET)
    )
    found = wide.select("word", kind.alias("kind")).where("kind is not null").collect()  # words of LEAST_TEXTS texts of a bounded sample
    seeds = {w for ws in SEEDS.values() for w in ws}
    return frozenset(r["word"] for r in found if r["kind"] == THREAT), {r["word"]: r["kind"] for r in found if r["kind"] != THREAT and r["word"] not in seeds}


def regression(x: np.ndarray, y: np.ndarray, l2: float = 1.0, rounds: int = 100) -> list[float]:
    """Logistic regression by damped Newton steps, with a light penalty on the constant. A match
    never speaks against toxicity, so features with a negative weight are left out one by one."""
    used = list(range(x.shape[1]))
    while True:
        own, w = x[:, used], np.zeros(len(used))
        penalty = np.where(np.array(used) == 0, 0.01, l2)
        loss = lambda w: np.logaddexp(0, -(2 * y - 1) * (own @ w)).sum() + 0.5 * (penalty * w * w).sum()  # noqa: B023, E731
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(own @ w, -500, 500)))
            slope = own.T @ (y - p) - penalty * w
            step = np.linalg.solve(own.T @ (own * (p * (1 - p))[:, None]) + np.diag(penalty), slope)
            while loss(w + step) > loss(w) and np.abs(step).max() > 1e-9:
                step /= 2
            w += step
            if np.abs(step).max() < 1e-6:
                break
        worst = min(range(1, len(used)), key=lambda k: w[k], default=0)
        if len(used) == 1 or w[worst] >= -1e-9:
            out = np.zeros(x.shape[1])
            out[used] = w
            return out.tolist()
        del used[worst]


def learn(docs: DataFrame, labels: DataFrame, keep: Column | None = None, sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model from labelled rows; ``keep``: a condition on doc_id for the rows that may teach."""
    taught = labelled_sample(labels, "toxic", sample_rows, keep)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(taught), "doc_id").select("text", "label")
    texts = without_copies(texts)
    words = lexicon(texts)
    if not words:
        return Model({w + "$": 3.0 for w in SEEDS[INSULT]})
    classes = word_classes(texts, Model(words))
    model = Model(words, threats=classes[0], learned=classes[1])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = [model.features(t).tolist() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), batch.column("label").cast(pa.int32())], names=["x", "label"])

    rows = texts.mapInArrow(run, "x array<double>, label int").collect()  # N_FEATURES numbers for each sampled row
    return Model(words, regression(np.array([r["x"] for r in rows]), np.array([r["label"] for r in rows], float)), *classes)


def with_score(docs: DataFrame, model: Model, name: str) -> DataFrame:
    """``docs`` with one more column, the score."""
    from pyspark.sql.types import DoubleType, StructType

    schema = StructType([*docs.schema.fields]).add(name, DoubleType())

    def run(batches):
        import pyarrow as pa

        held("toxicity")
        for batch in batches:
            score = pa.array([model.score(t.decode()) for _, texts in byte_texts(batch.column("text"), CHUNK_BYTES) for t in texts], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, score], names=[*batch.schema.names, name])
        release()

    return docs.mapInArrow(run, schema)


def scored(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, predicted) for every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return with_score(rows, model, "score").select("doc_id", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` below the threshold, with their columns."""
    (name,) = fresh(docs, "toxicity_score")
    return with_score(docs, model, name).where(F.col(name) < threshold).drop(name)
