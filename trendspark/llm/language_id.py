"""Language ID in two steps: the family, then one-versus-one linear machines within it.

Features are counts of hashed character 1- to 3-grams of the lowered text, as shares. Linear
support vector machines are trained for each pair of families and, within a family of several
languages, for each pair of its languages. A text goes to the family, and then to the language,
that wins most of its pairs (ties: the larger sum of margins). The score is the product of the two
steps' confidences, each the logistic of the smallest margin of the winner.

Whether a text is in a learned language at all is decided apart from the vote, which always has a
winner: the mean log share of its grams in the closest language's profile (or in the even mix of it and
another one, as texts quote other languages) must not lie further below that of held-out training rows
than ``SLACK`` times the furthest of those does, in units of the spread that a text of so many grams has.
This doesn't depend on the number of languages. ``accepted`` drops what lies further: scripts and
languages that were never learned, and junk. A few letters, or a language spelled much like a learned one,
may lie within the limit.

Families are those of ``FAMILIES``; a language that is not listed forms a family with the listed
ones that its profile is closest to. Every language of the table is learned. Training uses at most
``ROWS_A_LANGUAGE`` rows of each language and about ``MOST_ROWS`` in all, so fewer of each if there are many
languages, but ``LEAST_ROWS`` (documented bounds; rows are chosen by a hash of the id), whole texts and two
short passages of each, so that short texts are told apart, too; their counts, as (gram, share) of the
grams that occur, are what the driver sees. The sample is a range of hashes whose width follows from the
number of ids of each language, and an id that stands in several rows gives one text, so repeated rows
change nothing and no task sees a whole language. More than ``DRIVER_PAIRS`` pairs are trained as Spark tasks over the broadcast counts; a
pair's weights are 16 kB, so the model grows with the square of a family's languages. Prediction is one pass over the scan without a shuffle, in chunks of bounded size.

Results: null texts and texts without a letter are ``und`` with score 0; texts are read whole; each
input row gives one row, repeated ids included. Rows without a language teach nothing; if there is
one language only, it is predicted for every text with a letter (score 1); with none, all are
``und``. Empty tables give an empty table; extra columns are not read, except to keep them in
``accepted``.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trendspark.llm import pieces
from trendspark.llm.common import byte_texts, chunks, fresh, held, release, written

ROWS_A_LANGUAGE, PASSAGE_WORDS, BUCKETS = 400, 12, 4096
MOST_ROWS, LEAST_ROWS, DRIVER_PAIRS = 6400, 8, 16
CHUNK_CHARS = 400_000
SMOOTHING, WHOLE_GRAMS, SLACK, LEAST_LIMIT = 0.02, 1500.0, 1.5, 12.0
HELD_OUT = 4  # one row of so many gives the limit and not the profiles
SLOPE = 10.0
UNKNOWN = "und"

#: Families of languages by their codes.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi".split(),
    "romance": "fr es pt it ro ca gl oc la".split(),
    "slavic": "ru uk be pl cs sk bg sr hr sl mk bs".split(),
    "uralic": "fi et hu".split(),
    "turkic": "tr az kk uz ky".split(),
    "semitic": "ar he am mt".split(),
    "indic": "hi bn mr ne pa gu ur".split(),
    "sinitic": "zh yue".split(),
    "japonic": ["ja"],
    "koreanic": ["ko"],
    "hellenic": ["el"],
    "dravidian": "ta te kn ml".split(),
    "malayic": "id ms".split(),
}


def gram_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shares of hashed grams (texts x BUCKETS), whether each text has a letter, and its number of grams."""
    lowered = [" " + t.lower() + " " for t in texts]
    size = np.fromiter(map(len, lowered), np.int64, len(texts))
    cps = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    kind = pieces.class_table()[cps]
    owner = np.repeat(np.arange(len(texts)), size)
    letter = kind == pieces.LETTER
    has_letter = np.bincount(owner[letter], minlength=len(texts)) > 0
    symbol = np.where(letter, cps, np.where(kind == pieces.SPACE, 32, 46))
    counts = np.zeros((len(texts), BUCKETS), np.float32)
    mix = np.int64(0x2545F4914F6CDD1D)
    h = np.zeros(len(cps), np.int64)
    for n in range(3):
        m = len(cps) - n
        if m <= 0:
            break
        h = (h[:m] * np.int64(0x100000001B3)) ^ symbol[n:]
        inside = (owner[:m] == owner[n:]) & (letter[:m] | letter[n:])
        bucket = ((h * mix) >> np.int64(48)) & np.int64(BUCKETS - 1)
        flat = np.bincount((owner[:m] * BUCKETS + bucket)[inside], minlength=len(texts) * BUCKETS)
        counts += flat.reshape(len(texts), BUCKETS)
    total = counts.sum(axis=1, keepdims=True)
    return counts / np.maximum(total, 1), has_letter, total[:, 0]


@dataclass
class Shares:
    """Rows of shares of grams, of which only those that occur are kept."""

    end: np.ndarray  # of each row, in ``gram`` and ``share``
    gram: np.ndarray
    share: np.ndarray

    @staticmethod
    def of(grams: list[bytes], shares: list[bytes]) -> Shares:
        end = np.cumsum(np.fromiter(map(len, grams), np.int64, len(grams)) // 2)
        return Shares(end, np.frombuffer(b"".join(grams), np.uint16), np.frombuffer(b"".join(shares), np.float16))

    def __len__(self) -> int:
        return len(self.end)

    def rows(self, chosen: np.ndarray, scale: np.ndarray | None = None) -> np.ndarray:
        """The chosen rows in full, each column times its scale."""
        at = np.flatnonzero(chosen)
        size = np.diff(self.end, prepend=0)[at]
        take = np.arange(int(size.sum())) + np.repeat(self.end[at] - np.cumsum(size), size)
        out = np.zeros((len(at), BUCKETS), np.float32)
        gram, share = self.gram[take], self.share[take].astype(np.float32)
        out[np.repeat(np.arange(len(at)), size), gram] = share if scale is None else share * scale[gram]
        return out

    def means(self, of: np.ndarray, n: int, power: int = 1) -> np.ndarray:
        """Mean of the shares (to a power) of the rows of each of n classes; rows of class -1 count nowhere."""
        each = np.repeat(of, np.diff(self.end, prepend=0))
        some = each >= 0
        sums = np.bincount(each[some] * BUCKETS + self.gram[some], self.share[some].astype(np.float64) ** power, n * BUCKETS)
        return sums.reshape(n, BUCKETS) / np.maximum(np.bincount(of[of >= 0], minlength=n), 1)[:, None]


def machine(x: np.ndarray, y: np.ndarray, rounds: int = 300, c: float = 20.0) -> tuple[np.ndarray, float]:
    """A linear support vector machine (squared hinge) by accelerated gradient descent; y: 1 or -1."""
    w, b, vw, vb = np.zeros(x.shape[1], np.float32), 0.0, np.zeros(x.shape[1], np.float32), 0.0
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    rate = 1.0 / (2 * c * float(((x**2).sum(axis=1) + 1).max()) + 1)
    for k in range(rounds):
        aw, ab = w + k / (k + 3) * (w - vw), b + k / (k + 3) * (b - vb)
        slack = np.maximum(0, 1 - y * (x @ aw + ab)).astype(np.float32) * weight * y
        vw, vb = w, b
        w = aw - rate * (aw - 2 * c * (x.T @ slack))
        b = ab + rate * 2 * c * float(slack.sum())
    return w, b


def spread(n_grams: np.ndarray) -> np.ndarray:
    """How far the mean over a text's grams strays, but for a factor: less for longer texts, down to a rest."""
    return np.sqrt(1 / np.maximum(n_grams, 1) + 1 / WHOLE_GRAMS)


def profiles_of(x: Shares, n_grams: np.ndarray, of: np.ndarray, held: np.ndarray, languages: int) -> tuple[np.ndarray, np.ndarray]:
    """Smoothed shares (BUCKETS x languages) of the rows that aren't held out, and the mean log share of those that are
    (a language that has only one of both takes it twice)."""
    parts = []
    for part in (~held, held):
        has = np.isin(np.arange(languages), of[part])
        parts.append(part | ~has[of])
    shares = (1 - SMOOTHING) * x.means(np.where(parts[0], of, -1), languages).T + SMOOTHING / BUCKETS
    logs, middle = np.log(shares), np.zeros(languages)
    size = np.diff(x.end, prepend=0)
    row = np.repeat(np.arange(len(x)), size)
    own = np.bincount(row, x.share.astype(np.float64) * logs[x.gram, of[row]], len(x))
    for k in range(languages):
        out = parts[1] & (of == k)
        middle[k] = np.average(own[out], weights=n_grams[out])
    return shares.astype(np.float32), middle.astype(np.float32)


def distances(x: np.ndarray, n_grams: np.ndarray, shares: np.ndarray, middle: np.ndarray, most: float) -> np.ndarray:
    """How far each text lies from the closest language; beyond ``most``, from the closest mix of that one and another."""
    apart = middle - x @ np.log(shares)
    closest, reach = apart.argmin(axis=1), spread(n_grams)
    out = apart.min(axis=1) / reach
    for i in np.flatnonzero(out > most):
        k = closest[i]
        for j in range(len(middle)):  # one at a time, over the text's own grams: little memory with many languages
            some = np.flatnonzero(x[i])
            out[i] = min(out[i], (middle[k] - x[i, some] @ np.log((shares[some, k] + shares[some, j]) / 2)) / reach[i])
    return out


@dataclass
class Model:
    languages: list[str]
    family: list[int]  # of each language
    pairs: list[tuple[str, int, int]]  # ("family" or "language", one, other)
    weights: np.ndarray  # BUCKETS x pairs
    bias: np.ndarray
    scale: np.ndarray
    shares: np.ndarray  # BUCKETS x languages
    middle: np.ndarray
    limit: float

    def predict(self, texts: list[str]) -> list[tuple[str, float, bool]]:
        """(language, score, whether the text is within the limit) of each text."""
        out: list[tuple[str, float, bool]] = []
        for a, b in chunks(texts, CHUNK_CHARS):
            for c in range(a, b, 256):  # a chunk's matrix stays small when its texts are short
                part = texts[c : min(b, c + 256)]
                x, has_letter, n_grams = gram_counts(part)
                margin = (x * self.scale) @ self.weights + self.bias if self.pairs else np.zeros((len(part), 0))
                near = distances(x, n_grams, self.shares, self.middle, self.limit) <= self.limit if self.languages else has_letter
                out += [(*self._decide(m), bool(close)) if known and self.languages else (UNKNOWN, 0.0, False) for m, known, close in zip(margin, has_letter, near, strict=True)]
        return out

    def _winner(self, step: str, of: list[int], margin: np.ndarray) -> tuple[int, float]:
        if len(of) == 1:
            return of[0], 1.0
        wins = {k: [0, 0.0, np.inf] for k in of}
        for m, (kind, p, q) in zip(margin.tolist(), self.pairs, strict=True):
            if kind == step and p in wins and q in wins:
                for k, own in ((p, m), (q, -m)):
                    wins[k] = [wins[k][0] + (own > 0), wins[k][1] + own, min(wins[k][2], own)]
        best = max(of, key=lambda k: (wins[k][0], wins[k][1], -k))
        return best, float(1 / (1 + np.exp(-np.clip(SLOPE * wins[best][2], -30, 30))))

    def _decide(self, margin: np.ndarray) -> tuple[str, float]:
        family, first = self._winner("family", sorted(set(self.family)), margin)
        language, second = self._winner("language", [k for k, f in enumerate(self.family) if f == family], margin)
        return self.languages[language], first * second


def families(languages: list[str], profiles: np.ndarray) -> list[int]:
    """A family number for each language: by the table, else that of the closest listed profile."""
    listed = {code: k for k, codes in enumerate(FAMILIES.values()) for code in codes}
    unit = profiles / np.maximum(np.linalg.norm(profiles, axis=1, keepdims=True), 1e-9)
    known = [k for k, name in enumerate(languages) if name.lower().split("-")[0] in listed]
    of = lambda k: listed[languages[k].lower().split("-")[0]]
    return [of(k) if k in known else of(max(known, key=lambda j, k=k: float(unit[j] @ unit[k]))) if known else 0 for k in range(len(languages))]


def trained(spark: SparkSession, x: Shares, scale: np.ndarray, labels: dict[str, np.ndarray], pairs: list[tuple[str, int, int]]) -> list[tuple[np.ndarray, float]]:
    """A machine for each pair; labels: of each row, by the kind of pair."""

    def one(pair, x, scale, labels):
        kind, p, q = pair
        label = labels[kind]
        own = (label == p) | (label == q)
        return machine(x.rows(own, scale), np.where(label[own] == p, 1.0, -1.0).astype(np.float32))

    if len(pairs) <= DRIVER_PAIRS:
        return [one(pair, x, scale, labels) for pair in pairs]
    context = spark.sparkContext
    shared = context.broadcast((x, scale, labels))
    try:
        return context.parallelize(pairs, min(len(pairs), 4 * context.defaultParallelism)).map(lambda pair: one(pair, *shared.value)).collect()
    finally:
        shared.destroy()


def limit_of(x: Shares, n_grams: np.ndarray, held: np.ndarray, shares: np.ndarray, middle: np.ndarray) -> float:
    """SLACK times the furthest that a held-out row lies from the learned languages, or LEAST_LIMIT
    if that is more: few rows say little of how far a text may lie."""
    furthest = 0.0
    at = np.flatnonzero(held)
    for k in range(0, len(at), 512):
        part = np.zeros(len(held), bool)
        part[at[k : k + 512]] = True
        furthest = max(furthest, float(distances(x.rows(part), n_grams[part], shares, middle, 0.0).max()))
    return max(LEAST_LIMIT, SLACK * furthest)


def fitted(spark: SparkSession, x: Shares, names: list[str], n_grams: np.ndarray, held: np.ndarray) -> Model:
    languages = sorted(set(names))
    place = {name: k for k, name in enumerate(languages)}
    of = np.array([place[n] for n in names], np.int64)
    if not languages:
        return Model([], [], [], np.zeros((BUCKETS, 0), np.float32), np.zeros(0, np.float32), np.ones(BUCKETS, np.float32), np.zeros((BUCKETS, 0), np.float32), np.zeros(0, np.float32), LEAST_LIMIT)
    every = np.zeros(len(x), np.int64)
    deviation = np.sqrt(np.maximum(x.means(every, 1, 2)[0] - x.means(every, 1)[0] ** 2, 0))
    scale = (1.0 / (deviation + 1e-4) / np.sqrt(BUCKETS)).astype(np.float32)
    family = families(languages, x.means(of, len(languages)))
    family_of = np.array([family[k] for k in of])
    pairs = [("family", p, q) for p, q in combinations(sorted(set(family)), 2)] + [("language", p, q) for p, q in combinations(range(len(languages)), 2) if family[p] == family[q]]
    machines = trained(spark, x, scale, {"family": family_of, "language": of}, pairs)
    weights, bias = [w for w, _ in machines], [b for _, b in machines]
    shares, middle = profiles_of(x, n_grams, of, held, len(languages))
    limit = limit_of(x, n_grams, held, shares, middle)
    return Model(languages, family, pairs, np.array(weights, np.float32).reshape(-1, BUCKETS).T, np.array(bias, np.float32), scale, shares, middle, limit)


def passages(text: str, key: int) -> list[str]:
    """The text and two short passages of it, at places that the key decides."""
    words = text.split()
    if len(words) <= PASSAGE_WORDS:
        return [text]
    last = len(words) - PASSAGE_WORDS // 3
    at = [key % last, (key // 7919) % last]
    return [text, " ".join(words[at[0] : at[0] + PASSAGE_WORDS]), " ".join(words[at[1] : at[1] + PASSAGE_WORDS // 3])]


def learn(docs: DataFrame, keep: Column | None = None, rows_a_language: int = ROWS_A_LANGUAGE) -> Model:
    """A model from (doc_id, text, lang); ``keep``: a condition on doc_id for rows that may teach."""
    # the sample is chosen without the texts, which are read for the chosen ids only
    known = docs.select("doc_id", "lang").where("lang is not null and lang <> '' and doc_id is not null")
    if keep is not None:
        known = known.where(keep)
    ids = written(known.groupBy("lang").agg(F.approx_count_distinct("doc_id", 0.02).alias("ids")), "language-sizes")
    n_languages = ids.count()
    rows_a_language = min(rows_a_language, max(LEAST_ROWS, MOST_ROWS // max(1, n_languages)))
    place = F.pmod(F.xxhash64("doc_id", F.lit("language sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = known.join(ids, "lang").where(place < F.lit(float(rows_a_language)) / F.col("ids")).groupBy("doc_id").agg(F.min("lang").alias("lang"), F.max("lang").alias("other")).where("lang = other").select("doc_id", "lang")
    chosen = written(chosen, "language-sample")
    if n_languages * rows_a_language <= MOST_ROWS:  # short rows: this may be broadcast
        chosen = F.broadcast(chosen)
    taught = docs.select("doc_id", "lang", "text").where("text is not null").join(chosen, ["doc_id", "lang"], "left_semi")
    one = taught.groupBy("doc_id").agg(F.min_by(F.struct("lang", "text"), F.xxhash64("text")).alias("row")).select("doc_id", "row.*")

    def run(batches):
        import pyarrow as pa

        schema = pa.schema([("lang", pa.string()), ("gram", pa.binary()), ("share", pa.binary()), ("n", pa.float64()), ("held", pa.bool_())])
        for batch in batches:
            ids, langs, texts = (batch.column(c).to_pylist() for c in ("doc_id", "lang", "text"))
            for k in range(0, len(texts), 64):
                rows = [(lang, i * 2654435761 % (1 << 31), p) for i, lang, t in zip(ids[k : k + 64], langs[k : k + 64], texts[k : k + 64], strict=True) for p in passages(t, i * 2654435761 % (1 << 31))]
                x, has_letter, n_grams = gram_counts([p for _, _, p in rows])
                own = []
                for (lang, key, _), v, known, n in zip(rows, x, has_letter, n_grams, strict=True):
                    if known:
                        some = np.flatnonzero(v)
                        own.append((lang, some.astype(np.uint16).tobytes(), v[some].astype(np.float16).tobytes(), float(n), (key >> 8) % HELD_OUT == 0))
                yield pa.RecordBatch.from_pydict(dict(zip(schema.names, map(list, zip(*own, strict=True)), strict=True)) if own else {c: [] for c in schema.names}, schema=schema)

    table = one.mapInArrow(run, "lang string, gram binary, share binary, n double, held boolean").toArrow().sort_by([("lang", "ascending"), ("n", "ascending"), ("gram", "ascending")])
    x = Shares.of(table.column("gram").to_pylist(), table.column("share").to_pylist())
    return fitted(docs.sparkSession, x, table.column("lang").to_pylist(), table.column("n").to_numpy(), table.column("held").to_numpy().astype(bool))


def with_language(docs: DataFrame, model: Model, lang_name: str, score_name: str, near_name: str) -> DataFrame:
    """``docs`` with three more columns: the language, the score and whether the text is within the limit."""
    from pyspark.sql.types import BooleanType, DoubleType, StringType, StructType

    schema = StructType([*docs.schema.fields]).add(lang_name, StringType()).add(score_name, DoubleType()).add(near_name, BooleanType())

    def run(batches):
        import pyarrow as pa

        held("languages")
        for batch in batches:
            found = [f for _, texts in byte_texts(batch.column("text"), CHUNK_CHARS) for f in model.predict([t.decode() for t in texts])]
            columns = [*batch.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, lang_name, score_name, near_name])
        release()

    return docs.mapInArrow(run, schema)


def predicted(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) for every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return with_language(rows, model, "lang_pred", "score", "near").drop("text", "near")


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` whose text is within the limit of a learned language, with their columns."""
    added = fresh(docs, "lang_pred", "lang_score", "lang_near")
    return with_language(docs, model, *added).where(F.col(added[2])).drop(*added)
